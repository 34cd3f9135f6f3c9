"""Token ids of whole texts by a public tokenizer, with a table of pieces already encoded.

Texts are cut where both tokenizers cut them whatever stands around: before white space behind something
else, behind a lone line feed or tab before a word, and between a Latin letter and a mark.  The pieces of some
megabytes are cut and numbered as columns, and each different one is looked up once.  Words recur, so
most come out of the table.  Of the others a word, a blank perhaps and Latin letters, is one pre-token, so
the library's model encodes it alone; anything else goes through the whole of the library.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from maskwright.llm.common import pa_schema, text_or_empty

# Pieces in a generation of a worker's table; it keeps two.  Bounds its memory, not the result.
PIECES_KEPT = 250_000
# Bytes of text cut at once, or one longer text.
BYTES_AT_ONCE = 1 << 22
# Kinds of bytes: white space, of it all but the blank, ASCII letters, marks (the apostrophe starts 's and the
# like), and what surely starts something that is no white space.
_SPACE, _BREAK, _LETTER, _MARK, _SOLID = 1, 2, 4, 8, 16
_KINDS = np.array([
    _SPACE if c == 32 else _SPACE | _BREAK if 9 <= c <= 13
    else _LETTER | _SOLID if chr(c).isalpha() and c < 128
    else _MARK | _SOLID if 32 < c < 127 and not chr(c).isalnum() and c != ord("'")
    else _SOLID if 32 < c < 127 or 0xC3 <= c <= 0xC9 else 0
    for c in range(256)
], np.uint8)
# White space and those characters of U+00C0 to U+027F that end no run of letters: two signs, and U+0130, which in
# lower case ends with a combining dot that joins the mark behind it.  As numbers of up to three bytes.
_WIDE_SPACES = [int.from_bytes(chr(c).encode()) for c in range(0x80, 0x3001) if chr(c).isspace()]
_NO_LETTERS = [int.from_bytes(c.encode()) for c in "×÷İ"]


def cuts_in(data: np.ndarray) -> np.ndarray:
    """Places in the UTF-8 of texts where a pre-token ends and the next one does not depend on what was before."""
    kinds = _KINDS[data]
    before, here = kinds[:-1], kinds[1:]
    blanks = np.flatnonzero((here & _SPACE > 0) & (before & _SPACE == 0)) + 1
    wide = np.flatnonzero(data[blanks - 1] >= 0x80)
    two = data[blanks[wide] - 2].astype(np.int64) << 8 | data[blanks[wide] - 1]
    three = data[blanks[wide] - 3].astype(np.int64) << 16 | two
    blanks = np.delete(blanks, wide[np.isin(two, _WIDE_SPACES) | np.isin(three, _WIDE_SPACES)])
    breaks = blanks[kinds[blanks] & _BREAK > 0]
    words = breaks[:-1] + 1 if len(breaks) and breaks[-1] + 1 == len(data) else breaks + 1
    words = words[kinds[words] & _SOLID > 0]
    marks = np.flatnonzero((here & _MARK > 0) & ((before & _LETTER > 0) | (data[:-1] >= 0x80))) + 1
    wide = np.flatnonzero(data[marks - 1] >= 0x80)
    lead = data[marks[wide] - 2]
    two = lead.astype(np.int64) << 8 | data[marks[wide] - 1]
    marks = np.delete(marks, wide[(lead < 0xC3) | (lead > 0xC9) | np.isin(two, _NO_LETTERS)])
    return np.concatenate([blanks, words, marks])


def cut(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pieces of all texts, numbered, and where in them each text starts and the last one ends."""
    sizes = pc.binary_length(texts).to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    if not ends[-1]:
        return pa.array([], pa.string()).dictionary_encode(), ends
    first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first : first + ends[-1]]
    starts = np.zeros(len(data) + 1, bool)
    starts[cuts_in(data)] = True
    starts[ends] = True
    starts = np.flatnonzero(starts)
    pieces = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data))
    return pieces.dictionary_encode(), np.searchsorted(starts, ends)


class Pieces(dict):
    """Ids of pieces as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their spelling in a text is ordinary text

        self.older: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        # letters as the model gets them, and what it gets for a blank before a word
        self.spelled = {ord(c): self.pre_tokens(c) for c in map(chr, range(ord("A"), 0x250)) if c.isalpha()}
        self.spelled = {c: s[0] for c, s in self.spelled.items() if len(s) == 1}
        self.blank = self.pre_tokens(" a")[0].removesuffix("a")
        self.spellable = re.compile(f"[{''.join(map(chr, self.spelled))}]+").fullmatch

    def pre_tokens(self, text: str) -> list[str]:
        normalizer = self.tokenizer.normalizer
        text = normalizer.normalize_str(text) if normalizer else text
        return [s for s, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, pieces: set[str]) -> None:
        """Make room, then take the pieces over from the older generation or encode them."""
        new = pieces.difference(self)
        if len(self) + len(new) > PIECES_KEPT:
            self.older = dict(self)
            self.clear()
            new = pieces
        rest, older, spelled, tokenize = [], self.older.get, self.spelled, self.model.tokenize
        for piece in new:
            code = older(piece)
            if code is None:
                word = piece.removeprefix(" ")
                if not (word.isalpha() and (word.isascii() or self.spellable(word))):
                    rest.append(piece)
                    continue
                word = word.translate(spelled)
                found = tokenize(word if piece[0] != " " else self.blank + word)
                code = array("I", [t.id for t in found]).tobytes()
            self[piece] = code
        for piece, code in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self[piece] = array("I", code.ids).tobytes()

    def ids_of(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with ``end`` behind, and where in them each starts and the last one ends."""
        pieces, at = cut(texts)
        different = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(set(different))
        codes = pa.array([*map(self.__getitem__, different), end], pa.binary())
        numbers = np.insert(pieces.indices.to_numpy(), at[1:], len(different))
        found = codes.take(pa.array(numbers))  # one behind the other in its buffer
        ends = np.frombuffer(found.buffers()[1], np.int32)[at + np.arange(len(at))] // 4
        return np.frombuffer(found.buffers()[2] or b"", "<u4")[: ends[-1]], ends

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, at = self.ids_of(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]


_TABLES: dict[str, Pieces] = {}


def pieces_of(name: str) -> Pieces:
    """The table of this worker; kept over its tasks."""
    path = name if os.path.sep in name else public_tokenizers.path(name)
    if path not in _TABLES:
        _TABLES[path] = Pieces(path)
    return _TABLES[path]


def narrowest(tokenizer: str, end_id: int) -> str:
    """The shortest type that holds all ids of a tokenizer and the end id."""
    return "<u2" if max(pieces_of(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some ``BYTES_AT_ONCE`` of its texts, its last column, and of one row at least."""
    sizes = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(), dtype=np.int64)
    starts = np.flatnonzero(np.diff(sizes // BYTES_AT_ONCE, prepend=-1))
    for start, end in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(start, end - start)


def tokenize(
    docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", kind: str = "<u4",
) -> DataFrame:
    """(key, ids): ids of every whole text and the end id, little-endian, unsigned, 32 bits unless ``kind`` says else.

    ``tokenizer`` is a file name of the public vocabularies or a path.  A null or empty text has the end
    id alone.  Rows are kept as they come, repeated ones too.
    """
    end, width = np.array([end_id], "<u4").tobytes(), np.dtype(kind).itemsize
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, ids binary"
    out = pa_schema(schema, docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces_of(tokenizer)
        for batch in batches:
            for part in parts_of(batch):
                ids, at = table.ids_of(part.column(1).cast(pa.string()), end)
                ids, at = pa.py_buffer(ids.astype(kind)), pa.py_buffer((at * width).astype(np.int32))
                found = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, at, ids])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(out[0].type), found.cast(out[1].type)], schema=out)

    return docs.select(key, text_or_empty(text).alias("_text")).mapInArrow(run, schema)
