"""License notices in texts, with errors allowed.

A notice with at most ``k`` errors is cut into ``k + 1`` parts; by the pigeonhole principle one of them
stands in the text unchanged.  One automaton finds all parts of all notices; around each hit the text is
compared with the notice, exactly and, where that fails, by a pattern of bounded error.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame

from maskwright.llm.common import ASCII_LOWER, map_rows, text_or_empty

# The phrases and labels of the contract.
BASE = (
    ("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"),
)
#: (words of a notice, label, errors allowed): the base phrases and further short notices.
NOTICES = (
    (*BASE[0], 2), (*BASE[1], 1), (*BASE[2], 0), (*BASE[3], 1),
    ("gnu lesser general public license", "lgpl", 3), ("gnu affero general public license", "agpl", 3),
    ("mozilla public license", "mpl", 2), ("eclipse public license", "epl", 2), ("bsd license", "bsd", 1),
    ("boost software license", "bsl", 2), ("creative commons attribution", "cc-by", 2),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("permission is hereby granted free of charge", "mit", 4), ("dedicated to the public domain", "public-domain", 2),
    ("all rights reserved", "all-rights-reserved", 1),
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """(offset, part): ``errors + 1`` parts of about equal length."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=8)
def scanner(notices: tuple):
    import ahocorasick
    import regex

    parts: dict[str, list] = {}
    for i, (notice, _, errors) in enumerate(notices):
        for at, part in seeds(notice, errors):
            parts.setdefault(part, []).append((i, at))
    found = ahocorasick.Automaton()
    for part, uses in parts.items():
        found.add_word(part, (len(part), uses))
    found.make_automaton()
    patterns = [
        regex.compile(rf"(?b)(?<!\S)(?:{regex.escape(n)}){{e<={e}}}(?!\S)") if e else None for n, _, e in notices
    ]
    return found, patterns


def places(text: str, notices: tuple = NOTICES) -> tuple[int, list[tuple[int, int, int, int]]]:
    """(words, [(notice, first word, words, errors)]): where notices stand in a text, in order.

    A place with errors is left out where it overlaps one with fewer of the same notice.
    """
    words = _WORD.findall(text.translate(ASCII_LOWER))
    line = " ".join(words)
    automaton, patterns = scanner(notices)
    exact, near = set(), set()
    for end, (size, uses) in automaton.iter(line):
        for i, at in uses:
            notice, _, errors = notices[i]
            start = end + 1 - size - at
            stop = start + len(notice)
            if start >= 0 and line.startswith(notice, start) and (start == 0 or line[start - 1] == " ") and line[stop : stop + 1] in ("", " "):
                exact.add((i, start, stop))
            elif errors:
                # whole words around everything the errors can reach
                a = line.rfind(" ", 0, max(0, start - errors)) + 1
                b = line.find(" ", min(len(line), stop + errors))
                near.add((i, a, b if b >= 0 else len(line)))
    hits = [(0, i, a, b) for i, a, b in exact]
    for i, a, b in near:
        for m in patterns[i].finditer(line[a:b]):
            if found := sum(m.fuzzy_counts):
                hits.append((found, i, a + m.start(), a + m.end()))
    kept: dict[int, list] = {}
    for found, i, a, b in sorted(set(hits)):
        spans = kept.setdefault(i, [])
        # starts and ends of the places kept ascend together, so one neighbour tells
        at = bisect_left(spans, (b,))
        if not found or not at or spans[at - 1][1] <= a:
            insort(spans, (a, b, found))
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    out = [
        (i, first := bisect_right(starts, a) - 1, bisect_left(starts, b) - first, n)
        for i, spans in kept.items() for a, b, n in spans
    ]
    return len(words), sorted(out, key=lambda p: (p[1], p[0]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", notices: tuple = NOTICES) -> DataFrame:
    """(key, n_words, notices): one row per row; each place is (notice, label, first_word, words, errors, score).

    Words are runs of letters and digits, A-Z lower-cased.  Null and empty texts have none.
    """
    kind = docs.schema[key].dataType.simpleString()

    def of(columns):
        got = [places(t, notices) for t in columns["_text"]]
        return {key: columns[key], "n_words": [n for n, _ in got], "notices": [[
            {"notice": notices[i][0], "label": notices[i][1], "first_word": at, "words": n, "errors": e,
             "score": 1 - e / len(notices[i][0])} for i, at, n, e in found
        ] for _, found in got]}

    return map_rows(
        docs.select(key, text_or_empty(text).alias("_text")), of,
        f"`{key}` {kind}, n_words bigint, notices array<struct<notice:string,label:string,first_word:bigint,"
        "words:bigint,errors:int,score:double>>",
    )


def summary(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, labels and best score of each row of ``scan``; base places are those of a base phrase without errors."""
    phrases = ", ".join(f"'{p}'" for p, _ in BASE)
    return scanned.selectExpr(
        "*", f"filter(notices, x -> x.errors = 0 AND x.notice IN ({phrases})) AS base"
    ).selectExpr(
        f"`{key}`", "n_words", "cast(size(base) AS bigint) AS n_base",
        "array_min(base.first_word) AS first_word", "array_max(base.first_word) AS last_word",
        "array_join(sort_array(array_distinct(base.label)), ',') AS base_labels",
        "array_join(sort_array(array_distinct(notices.label)), ',') AS labels",
        "coalesce(array_max(notices.score), 0D) AS score", "notices",
    )
