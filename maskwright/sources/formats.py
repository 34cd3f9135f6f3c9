"""File formats as text, each a column expression over the raw text of one file."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.spans import mark_for, walk_blocks
from ..functions.text import BLANK, let, strip
from ..rules.model import FLAGS

STRINGS = "array<string>"


def universal_newlines(text: Column) -> Column:
    """What reading a file in text mode does to line ends."""
    return F.regexp_replace(text, r"\r\n?", "\n")


# ---- HTML (SRC-5)

def html_text(html: Column) -> Column:
    bare = F.regexp_replace(html, "<[^>]+>", " ")
    return strip(F.regexp_replace(bare, FLAGS + BLANK + "{2,}", "\n"))


# ---- CSV (SRC-3)

def csv_line(cells: Column) -> Column:
    """One record: trimmed, non-blank cells joined by a pipe."""
    return F.array_join(
        F.filter(F.transform(cells, lambda c: strip(c.cast("string"))), lambda c: c != ""), " | "
    )


_CSV_CELL = r"(?s)(\"(?:[^\"]|\"\")*+\"[^,\n]*|[^,\n]*)(,|\n|\z)"


def csv_text(text: Column) -> Column:
    """A whole CSV file as pipe-joined lines; quoted cells may hold commas and line ends."""
    body = universal_newlines(text)
    pieces = F.arrays_zip(
        F.regexp_extract_all(body, F.lit(_CSV_CELL), F.lit(1)).alias("cell"),
        F.regexp_extract_all(body, F.lit(_CSV_CELL), F.lit(2)).alias("stop"),
    )

    def bare(cell):
        quoted = F.regexp_replace(cell, r'(?s)\A"((?:[^"]|"")*+)"', "$1")
        return F.when(F.startswith(cell, F.lit('"')), F.replace(quoted, F.lit('""'), F.lit('"'))).otherwise(cell)

    def step(cells, piece):
        grown = F.concat(cells, F.array(bare(piece["cell"])))
        # the last stop is the end of the text; an empty row there is no row
        ends = (piece["stop"] == "\n") | (
            (piece["stop"] == "") & ((F.size(cells) > 0) | (piece["cell"] != ""))
        )
        return F.struct(
            F.when(ends, none).when(piece["stop"] == ",", grown).otherwise(cells).alias("state"),
            F.when(ends, csv_line(grown)).alias("piece"),
        )

    none = F.array().cast(STRINGS)
    # records that go on have no line yet; array_join leaves them out
    return F.array_join(walk_blocks(pieces, none, step, "string"), "\n")


# ---- JSON (SRC-4)

_JSON_STRING = r'"(?:[^"\\]|\\.)*+"'
_JSON_TOKEN = rf"(?s){_JSON_STRING}|[{{}}\[\],:]|[^\s{{}}\[\],:\"]+"


# --- fixed values: numbers that JSON does not have and that are read all the same
_JSON_NUMBERS = ("NaN", "Infinity", "-Infinity")
# ---


def _json_plain(token: Column) -> Column:
    """A token as it is written: escapes of a string only where they are needed."""
    escaped = F.startswith(token, F.lit('"')) & F.contains(token, F.lit("\\"))
    return F.when(escaped, F.to_json(F.try_parse_json(token))).otherwise(token)


def _one_json_value(text: Column) -> Column:
    """The parser stops behind the first value; inside brackets and as a member only a single value is right."""
    def read(before, after):
        return F.try_parse_json(F.concat(F.lit(before), text, F.lit(after))).isNotNull()

    return read("[", "]") & read('{"k":', "}")


def json_valid(text: Column) -> Column:
    """Whether a text is JSON, also with repeated keys and with the numbers that JSON does not have."""
    def odd(tokens):
        # keys renamed so that none repeats, odd numbers replaced
        plain = F.transform(tokens, lambda t, i: F.when(
            F.get(tokens, i + 1).eqNullSafe(F.lit(":")) & F.startswith(t, F.lit('"')), F.concat(F.lit('"k'), i, F.lit('"'))
        ).when(t.isin(*_JSON_NUMBERS), F.lit("0")).otherwise(t))
        return _one_json_value(F.array_join(plain, " "))

    nothing_else = ~F.regexp_replace(text, _JSON_TOKEN, "").rlike(r"\S")
    tokens = F.regexp_extract_all(text, F.lit(_JSON_TOKEN), F.lit(0))
    return _one_json_value(text) | (text.isNotNull() & nothing_else & let(tokens, odd))


def _json_members(tokens: Column) -> Column:
    """(container, key, first token, token behind the last) of the members of all objects, by a walk with a stack."""
    frame = "struct<id:int,object:boolean,first:int,key:string>"
    member = "struct<id:int,key:string,first:int,last:int>"

    def step(state, token):
        stack, i = state["stack"], state["i"]
        top = F.when(F.size(stack) > 0, F.element_at(stack, -1))
        below = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        opens, closes = token.isin("{", "["), token.isin("}", "]")
        fresh = F.struct(state["next"], token == "{", F.lit(-1), F.lit(None)).cast(frame)
        named = F.struct(top["id"], top["object"], i - 1, _json_plain(state["before"])).cast(frame)
        bare = F.struct(top["id"], top["object"], F.lit(-1), F.lit(None)).cast(frame)
        after = (
            F.when(opens, F.concat(stack, F.array(fresh))).when(closes | top.isNull(), below)
            .when(token == ":", F.concat(below, F.array(named))).when(token == ",", F.concat(below, F.array(bare)))
            .otherwise(stack)
        )
        done = (closes | (token == ",")) & top["object"] & (top["first"] >= 0)
        return F.struct(
            F.struct(
                after.alias("stack"), (state["next"] + F.when(opens, 1).otherwise(0)).alias("next"),
                (i + 1).alias("i"), token.alias("before"),
            ).alias("state"),
            F.when(done, F.struct(top["id"], top["key"], top["first"], i).cast(member)).alias("piece"),
        )

    start = F.struct(
        F.array().cast(f"array<{frame}>").alias("stack"), F.lit(0).alias("next"), F.lit(0).alias("i"), F.lit("").alias("before")
    )
    return F.sort_array(F.filter(walk_blocks(tokens, start, step, member), lambda m: m.isNotNull()))


def _json_last_wins(tokens: Column) -> Column:
    """Of members of one object with one key the last stands in the place of the first; the others are left out."""
    def same(a, b):
        return (a["id"] == b["id"]) & (a["key"] == b["key"])

    def reordered(members):
        def last(m, j):
            return F.coalesce(~same(m, F.get(members, j + 1)), F.lit(True))

        def begins(m, j):
            return (j == 0) | ~F.coalesce(same(m, F.get(members, j - 1)), F.lit(False))

        # sorted by container, key and place: a run of one key begins with the first and ends with the last
        dropped = F.filter(members, lambda m, j: ~last(m, j))
        later = F.filter(members, lambda m, j: ~begins(m, j))
        firsts = F.filter(F.transform(members, lambda m, j: F.when(begins(m, j) & ~last(m, j), m)), lambda m: m.isNotNull())
        moved = F.filter(F.transform(members, lambda m, j: F.when(last(m, j) & ~begins(m, j), m)), lambda m: m.isNotNull())

        def place(i):
            # where the objects around a token stand now, from the outermost on
            around = F.filter(
                F.zip_with(firsts, moved, lambda f, m: F.when((m["first"] <= i) & (i < m["last"]), f["first"])), lambda x: x.isNotNull()
            )
            return F.struct(F.concat(around, F.array(i)).alias("path"), i.alias("i"))

        kept = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: ~F.exists(
            dropped, lambda m: (m["first"] <= i) & (i < m["last"])
        ) & ~F.exists(later, lambda m: m["first"] - 1 == i))
        order = F.transform(F.sort_array(F.transform(kept, place)), lambda p: F.get(tokens, p["i"]))
        return F.when(F.size(dropped) == 0, tokens).otherwise(order)

    keys = F.filter(tokens, lambda t, i: F.get(tokens, i + 1).eqNullSafe(F.lit(":")))
    return F.when(let(keys, lambda k: F.size(F.array_distinct(k)) == F.size(k)) & ~F.exists(
        keys, lambda k: F.contains(k, F.lit("\\"))
    ), tokens).otherwise(let(_json_members(tokens), reordered))


def json_compact(text: Column) -> Column:
    """White space outside strings removed; keys keep their order."""
    return F.regexp_replace(text, rf"(?s)({_JSON_STRING})|\s+", "$1")


def json_layout(text: Column) -> Column:
    """Two blanks per level, one member per line, of repeated keys the last; NULL for invalid JSON."""
    found = F.regexp_extract_all(text, F.lit(_JSON_TOKEN), F.lit(0))

    def pad(depth):
        return F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth))

    def step(state, token):
        opens, closes = token.isin("{", "["), token.isin("}", "]")
        depth = state["depth"] - F.when(closes, 1).otherwise(0)
        fresh = state["last"].isin("{", "[")
        lead = (
            F.when(closes, F.when(fresh, F.lit("")).otherwise(pad(depth)))
            .when(fresh | (state["last"] == ","), pad(depth))
            .otherwise(F.lit(""))
        )
        piece = F.concat(lead, F.when(token == ":", F.lit(": ")).otherwise(_json_plain(token)))
        after = F.struct((depth + F.when(opens, 1).otherwise(0)).alias("depth"), token.alias("last"))
        return F.struct(after.alias("state"), piece.alias("piece"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("last"))
    return F.when(json_valid(text), let(
        let(found, _json_last_wins), lambda tokens: F.array_join(walk_blocks(tokens, start, step, "string"), "")
    ))


# ---- XML (SRC-6)

_XML_NOISE = r"(?s)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>"
_XML_TAG = r"""(?s)<(/?)([^\s/>]+)((?:\s+[^\s=/>]+\s*=\s*(?:"[^"]*"|'[^']*'))*)\s*(/?)>([^<]*)"""
_XML_ATTR = r"""(?s)([^\s=]+)\s*=\s*(?:"([^"]*)"|'([^']*)')"""
_CDATA = r"(?s)<!\[CDATA\[(.*?)\]\]>"


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _unescape(text: Column) -> Column:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def xml_outline(text: Column) -> Column:
    """One line per element: two blanks per depth, tag with attributes, own text."""
    bodies = F.concat(
        F.transform(F.regexp_extract_all(text, F.lit(_CDATA), F.lit(1)), _escape), F.array(F.lit(""))
    )
    plain = F.array_join(F.zip_with(
        F.split(text, _CDATA, -1), bodies, lambda gap, body: F.concat(gap, body)
    ), "")
    tags = F.regexp_extract_all(F.regexp_replace(plain, _XML_NOISE, ""), F.lit(_XML_TAG), F.lit(0))

    def line(tag, depth):
        pairs = F.regexp_extract_all(F.regexp_extract(tag, _XML_TAG, 3), F.lit(_XML_ATTR), F.lit(0))
        attrs = F.array_join(F.transform(pairs, lambda p: F.concat(
            F.lit(" "), F.regexp_extract(p, _XML_ATTR, 1), F.lit('="'),
            _unescape(F.concat(F.regexp_extract(p, _XML_ATTR, 2), F.regexp_extract(p, _XML_ATTR, 3))),
            F.lit('"'),
        )), "")
        own = F.when(F.regexp_extract(tag, _XML_TAG, 4) == "/", F.lit("")).otherwise(
            strip(_unescape(F.regexp_extract(tag, _XML_TAG, 5)))
        )
        return F.concat(
            F.repeat(F.lit("  "), depth), F.lit("<"), F.regexp_extract(tag, _XML_TAG, 2), attrs, F.lit(">"),
            F.when(own == "", F.lit("")).otherwise(F.concat(F.lit(" "), own)),
        )

    def step(depth, tag):
        closing = F.startswith(tag, F.lit("</"))
        alone = F.regexp_extract(tag, _XML_TAG, 4) == "/"
        return F.struct(
            F.when(closing, depth - 1).when(alone, depth).otherwise(depth + 1).alias("state"),
            F.when(~closing, line(tag, depth)).alias("piece"),
        )

    # closing tags have no line; array_join leaves them out
    return F.array_join(walk_blocks(tags, F.lit(0), step, "string"), "\n")


_XML_NAME = r"[A-Za-z_:À-\x{10FFFF}][\w:.\-·À-\x{10FFFF}]*"
_XML_WHOLE_TAG = rf"""(?s)<(?:/{_XML_NAME}\s*|{_XML_NAME}(?:\s+{_XML_NAME}\s*=\s*(?:"[^"<]*"|'[^'<]*'))*\s*/?)>"""
_XML_ENTITY = r"&(?:lt|gt|amp|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);"


def xml_error(text: Column) -> Column:
    """What is wrong with an XML text, NULL for a well-formed one.

    Tags are walked with a stack of the elements that are open.  Names of entities that a DOCTYPE declares are
    not known and count as errors.
    """
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>", ""), _CDATA, "x")
    name = rf"\A</?({_XML_NAME})"

    def walk(tags):
        def step(open_, tag):
            own = F.regexp_extract(tag, name, 1)
            closing, alone = F.startswith(tag, F.lit("</")), F.endswith(tag, F.lit("/>"))
            top = F.when(F.size(open_) > 0, F.element_at(open_, -1))
            wrong = closing & ~top.eqNullSafe(own)
            left = F.slice(open_, F.lit(1), F.greatest(F.size(open_) - 1, F.lit(0)))
            return F.struct(
                F.when(closing, left).when(alone, open_).otherwise(F.concat(open_, F.array(own))).alias("state"),
                F.when(wrong, F.lit("wrong end tag"))
                .when(~closing & (F.size(open_) == 0), F.lit("root"))
                .when(closing & (F.size(open_) == 1), F.lit("end of root")).alias("piece"),
            )

        return walk_blocks(tags, F.array().cast(STRINGS), step, "string")

    def verdict(tags):
        alone = F.size(F.filter(tags, lambda t: F.endswith(t, F.lit("/>"))))
        ends = F.size(F.filter(tags, lambda t: F.startswith(t, F.lit("</"))))
        repeated = F.exists(tags, lambda t: let(
            F.regexp_extract_all(t, F.lit(rf"\s({_XML_NAME})\s*="), F.lit(1)), lambda n: F.size(F.array_distinct(n)) < F.size(n)
        ))
        rest = F.regexp_replace(body, _XML_WHOLE_TAG, "")
        around = F.concat(F.regexp_extract(body, r"(?s)\A([^<]*)", 1), F.regexp_extract(body, r"(?s)([^>]*)\z", 1))
        return let(walk(tags), lambda found: (
            F.when(F.size(tags) == 0, F.lit("no element"))
            .when(F.contains(rest, F.lit("<")), F.lit("broken tag"))
            .when(F.contains(F.regexp_replace(body, _XML_ENTITY, ""), F.lit("&")), F.lit("broken entity"))
            .when(F.array_contains(found, "wrong end tag") | (ends * 2 + alone != F.size(tags)), F.lit("elements do not match"))
            .when(F.size(F.filter(found, lambda x: x == "root")) != 1, F.lit("more than one root"))
            .when(strip(around) != "", F.lit("text outside the root"))
            .when(repeated, F.lit("repeated attribute"))
        ))

    return let(F.regexp_extract_all(body, F.lit(_XML_WHOLE_TAG), F.lit(0)), verdict)


# ---- e-mail (SRC-7)

# --- fixed values: headers shown, in this order
MAIL_HEADERS = ("From", "To", "Cc", "Bcc", "Subject", "Date", "Reply-To")
# ---
_HEAD_BODY = r"(?s)\A(.*?)(?:\r?\n\r?\n|\z)(.*)\z"


def _head(message: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(message, _HEAD_BODY, 1), r"\r?\n([ \t])", "$1")


def _header(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)


def _boundary(head: Column) -> Column:
    """Boundary of a multipart head, '' for any other."""
    kind = _header(head, "Content-Type")
    quoted = F.regexp_extract(kind, r'(?i)boundary\s*=\s*"([^"]+)"', 1)
    bare = F.regexp_extract(kind, r'(?i)boundary\s*=\s*([^;\s"]+)', 1)
    return F.when(F.lower(kind).startswith("multipart/"), F.when(quoted != "", quoted).otherwise(bare)).otherwise("")


def _decoded(body: Column, head: Column) -> Column:
    """The body without its transfer encoding, as UTF-8 whatever charset is declared; wrong bytes are replaced."""
    def from_base64(body):
        # what is no letter of the alphabet is left out, so are letters behind the last whole group; missing padding is added
        letters = F.regexp_replace(body, r"[^A-Za-z0-9+/]+", "")
        groups = let(letters, lambda found: F.when(F.length(found) % 4 == 1, F.substring(
            found, F.lit(1), F.length(found) - 1
        )).otherwise(found))
        padded = let(groups, lambda g: F.concat(g, F.repeat(F.lit("="), F.pmod(-F.length(g), F.lit(4)).cast("int"))))
        return F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))

    def from_quoted(body):
        joined = F.regexp_replace(F.regexp_replace(body, r"[ \t]+(?=\r?\n)", ""), r"=\r?\n", "")
        escaped = F.replace(F.replace(joined, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
        return F.try_url_decode(F.regexp_replace(escaped, r"=([0-9A-Fa-f]{2})", "%$1"))

    def undone(given):
        body, encoding = given["body"], given["encoding"]
        return F.when(encoding == "base64", F.coalesce(from_base64(body), body)).when(
            encoding == "quoted-printable", F.coalesce(from_quoted(body), body)
        ).otherwise(body)

    encoding = F.lower(F.regexp_extract(_header(head, "Content-Transfer-Encoding"), r"[A-Za-z0-9-]+", 0))
    return let(F.struct(body.alias("body"), encoding.alias("encoding")), undone)


def mail_text(raw: Column) -> Column:
    """Chosen headers, a blank line, then the first plain part (else HTML without tags), transfer encodings undone."""
    return let(raw, _mail_text)


def _mail_text(raw: Column) -> Column:
    def message(head):
        shown = F.filter(
            F.array(*[
                F.when(_header(head, h) != "", F.concat(F.lit(f"{h}: "), _header(head, h)))
                for h in MAIL_HEADERS
            ]),
            lambda h: h.isNotNull(),
        )
        plain = _decoded(F.regexp_extract(raw, _HEAD_BODY, 2), head)
        multipart = F.lower(_header(head, "Content-Type")).startswith("multipart/")
        body = F.when(multipart, let(mark_for(raw), lambda mark: _part_text(raw, head, mark))).otherwise(plain)
        return F.concat(
            F.array_join(F.concat(shown, F.array(F.lit(""))), "\n"),
            let(body, lambda b: F.when(b.isNull() | ((b == "") & ~multipart), F.lit("")).otherwise(F.concat(F.lit("\n"), b))),
        )

    return let(_head(raw), message)


def _part_text(raw: Column, head: Column, mark: Column) -> Column:
    """The text of a multipart message.

    Lines that begin with two hyphens are walked with a stack of the boundaries that are open: one that names
    a boundary of the stack begins or ends a part, any other is text.  A part that is a multipart itself, or a
    message that holds one, puts its boundary on the stack; so parts may be nested and a boundary that is not
    open is never taken for one.
    """
    pieces = F.split(raw, r"(?<=\n)(?=--)", -1)

    def head_of(part):
        bare = part.rlike(r"\A\r?\n")  # a part without headers starts with its blank line
        return F.when(bare, F.lit("")).otherwise(_head(part))

    def body_of(part):
        return F.when(part.rlike(r"\A\r?\n"), F.regexp_replace(part, r"\A\r?\n", "")).otherwise(
            F.regexp_extract(part, _HEAD_BODY, 2)
        )

    def unwrapped(part):
        """The message inside a part that holds one."""
        holds = F.lower(_header(head_of(part), "Content-Type")).startswith("message/rfc822")
        return F.when(holds, body_of(part)).otherwise(part)

    def step(stack, piece):
        def read(line):
            name, ends = line["name"], line["ends"]
            opened = F.slice(stack, F.lit(1), F.greatest(F.array_position(stack, name).cast("int"), F.lit(0)))
            closed = F.slice(stack, F.lit(1), F.greatest(F.array_position(stack, ends).cast("int") - 1, F.lit(0)))

            def begun(part):
                inner = let(unwrapped(part), lambda p: _boundary(head_of(p)))
                return let(inner, lambda b: F.struct(
                    F.when(b != "", F.concat(opened, F.array(b))).otherwise(opened).alias("state"),
                    F.concat(mark, F.lit("+"), part).alias("piece"),
                ))

            return F.when(F.array_contains(stack, name), let(
                F.regexp_replace(piece, r"\A--[^\r\n]*(?:\r?\n|\z)", ""), begun
            )).when(
                F.array_contains(stack, ends), F.struct(closed.alias("state"), F.concat(mark, F.lit("-")).alias("piece"))
            ).otherwise(F.struct(stack.alias("state"), piece.alias("piece")))

        # the boundary stands in the first line, however long the piece is
        shown = F.regexp_extract(F.substring_index(piece, "\n", 1), r"\A--([^\r\n]*)", 1)
        return let(let(F.regexp_replace(shown, r"[ \t]+\z", ""), lambda name: F.struct(
            name.alias("name"), F.regexp_extract(name, r"\A(.*)--\z", 1).alias("ends"),
        )), read)

    def parsed(piece):
        def one(part):
            return let(head_of(part), lambda own: F.struct(
                F.when(_header(own, "Content-Type") == "", F.lit("text/plain")).otherwise(
                    F.lower(_header(own, "Content-Type"))
                ).alias("kind"),
                _decoded(body_of(part), own).alias("body"),
            ))

        # the line break before a boundary belongs to it
        return let(unwrapped(F.regexp_replace(F.substr(piece, F.lit(2)), r"\r?\n\z", "")), one)

    def choose(parts):
        texts = F.filter(parts, lambda p: p["kind"].startswith("text/plain") & (p["body"] != ""))
        pages = F.filter(parts, lambda p: p["kind"].startswith("text/html"))
        html = F.get(pages, F.lit(0))["body"]
        return F.coalesce(
            F.get(texts, F.lit(0))["body"],
            F.when(html != "", F.regexp_replace(html, "<[^>]+>", " ")),
        )

    top = F.filter(F.array(_boundary(head)), lambda b: b != "")
    walked = walk_blocks(F.slice(pieces, F.lit(2), F.size(pieces)), top, step, "string")
    begun = F.filter(F.split(F.array_join(walked, ""), mark, -1), lambda p: F.startswith(p, F.lit("+")))
    return let(F.transform(begun, parsed), choose)
