"""Language of texts by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram's vector binds (multiplies) its letters' vectors,
each rotated by its place; a text bundles (adds) its n-grams' vectors, a language the texts of its sample.
A text gets the language whose profile has the largest cosine with its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from maskwright.llm.common import map_rows, text_or_empty

DIMENSIONS = 1024
GRAM = 3
SEED = 7
#: Letters share so many vectors; 0 stands for any run of other characters.
LETTERS = 512
#: Sample of a language, about: documents with the smallest hashes of their key.
PER_LANGUAGE = 2000
# n-grams whose vectors a task builds at once: bounds its memory.
_AT_ONCE = 2048


class Space:
    """Letter vectors, rotated for each place of an n-gram."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = SEED):
        letters = np.random.default_rng(seed).integers(0, 2, (LETTERS, dimensions), dtype=np.int8) * 2 - 1
        self.places = [np.roll(letters, gram - 1 - i, axis=1) for i in range(gram)]
        self.gram, self.dimensions = gram, dimensions
        self.table = np.zeros(0x110000, np.uint16)
        self.known = np.zeros(0x110000, bool)

    def codes(self, text: str) -> np.ndarray:
        """Letters as numbers below ``LETTERS``, with one zero between words."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        new = np.unique(points[~self.known[points]])
        for p in new:
            self.table[p] = 1 + (int(p) - 97) % (LETTERS - 1) if chr(p).isalpha() else 0
        self.known[new] = True
        codes = self.table[points]
        return codes[(codes > 0) | (np.diff(codes, prepend=1) != 0)]

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, times); empty without a letter."""
        codes = self.codes(f" {text} ").astype(np.int64)
        if not codes.any() or len(codes) < self.gram:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = np.zeros(len(codes) - self.gram + 1, np.int64)
        for i in range(self.gram):
            grams = grams * LETTERS + codes[i : len(codes) - self.gram + 1 + i]
        return np.unique(grams, return_counts=True)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones((len(grams), self.dimensions), np.int8)
        for i in reversed(range(self.gram)):
            out *= self.places[i][grams % LETTERS]
            grams = grams // LETTERS
        return out.astype(np.float32)

    def bundle(self, texts: list[str]) -> np.ndarray:
        """A row of sums for each text."""
        counted = [self.counts(t) for t in texts]
        all_grams = np.unique(np.concatenate([g for g, _ in counted])) if counted else np.zeros(0, np.int64)
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for at in range(0, len(all_grams), _AT_ONCE):
            part = all_grams[at : at + _AT_ONCE]
            times = np.zeros((len(texts), len(part)), np.float32)
            for i, (grams, n) in enumerate(counted):
                a, b = np.searchsorted(grams, (part[0], part[-1] + 1))
                times[i, np.searchsorted(part, grams[a:b])] = n[a:b]
            out += times @ self.vectors(part)
        return out


def sample(docs: DataFrame, usable: Column, key: str, lang: str, per_language: int) -> DataFrame:
    """Rows to learn from: of each language about ``per_language``, chosen by a hash of the key."""
    labelled = docs.where(usable & F.col(lang).isNotNull())
    sizes = labelled.groupBy(F.col(lang).alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.lit(float(per_language)) / F.col("_n")
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # one row for a language, at most as many as there are language names
    rates = {r["_lang"]: r["share"] for r in sizes.select("_lang", share.alias("share")).toLocalIterator()}
    below = F.lit(False)
    for name, rate in sorted(rates.items()):
        below |= (F.col(lang) == name) & (place < min(rate, 1.0) + 1e-12)
    return labelled.where(below)


def learn(docs: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, profiles): the sum of the sampled texts' vectors, each scaled to length one, by language.

    Rows without a language, or whose text has no letter, teach nothing.
    """
    rows = sample(docs, usable, key, lang, per_language).select(F.col(lang).alias("lang"), text_or_empty(text).alias("_text"))

    def vectors(columns, space):
        sums: dict[str, np.ndarray] = {}
        for name, v in zip(columns["lang"], space.bundle(columns["_text"])):
            if v.any():
                sums[name] = sums.get(name, 0) + v.astype(np.float64) / np.linalg.norm(v)
        return {
            "lang": [name for name in sums for _ in range(DIMENSIONS)],
            "place": list(range(DIMENSIONS)) * len(sums), "x": np.concatenate([*sums.values(), np.zeros(0)]),
        }

    parts = map_rows(rows, vectors, "lang string, place int, x double", setup=Space)
    # round sums: the order of adding must not show
    total = parts.groupBy("lang", "place").agg(F.sum(F.col("x").cast("decimal(20,9)")).cast("double").alias("x"))
    got = total.toPandas()  # DIMENSIONS numbers for a language
    names = sorted(set(got["lang"]))
    profiles = np.zeros((len(names), DIMENSIONS))
    profiles[[names.index(x) for x in got["lang"]], got["place"]] = got["x"]
    return names, profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, names: list[str], profiles: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score): one row per row; ``und`` with score 0 for a text that is null or has no letter.

    ``score`` is the cosine, at least 0.  Of equal cosines the first language by name wins.  Nothing learned: ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles.astype(np.float32))
    kind = docs.schema[key].dataType.simpleString()

    def of(columns, space):
        vectors = space.bundle(columns["_text"])
        length = np.linalg.norm(vectors, axis=1)
        letters = np.array([any(map(str.isalpha, t)) for t in columns["_text"]], bool)
        if not names:
            return {key: columns[key], "lang_pred": ["und"] * len(letters), "score": [0.0] * len(letters)}
        cosines = vectors @ shared.value.T / np.maximum(length, 1e-6)[:, None]
        best = cosines.argmax(axis=1)
        score = np.clip(np.where(letters, cosines[np.arange(len(best)), best], 0), 0, 1)
        return {key: columns[key], "lang_pred": [names[b] if x else "und" for b, x in zip(best, letters)], "score": score.astype(float)}

    return map_rows(
        docs.select(key, text_or_empty(text).alias("_text")), of, f"`{key}` {kind}, lang_pred string, score double",
        setup=Space,
    )
