"""Text helpers as column expressions; all run inside the JVM."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

from ..rules.model import FLAGS

# Python's str methods treat the four ASCII separators as white space too.
BLANK = r"[\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


@lru_cache(maxsize=128)
def _built(application: str, build, text: str, options: tuple) -> Column:
    return build(F.col(text), **dict(options))


def remembered(build, text: str, **options) -> Column:
    """``build(F.col(text), **options)``, made once per application.

    Putting a large expression together takes the driver longer than planning it,
    which counts for micro-batches and short queries.
    """
    frozen = tuple(sorted((k, tuple(v) if isinstance(v, list) else v) for k, v in options.items()))
    return _built(SparkContext.getOrCreate().applicationId, build, text, frozen)


def let(value: Column, body) -> Column:
    """Bind ``value`` once, so that ``body`` may use it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def constant(value, kind: str) -> Column:
    """A nested constant from plain data; folded into one literal when the plan is made."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def as_map(values: dict[str, str]) -> Column:
    return constant(values, "map<string,string>")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, FLAGS + rf"\A{BLANK}+|{BLANK}+\z", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(FLAGS + r"[^\s\x1c-\x1f]"), F.lit(False))


def split_lines(text: Column) -> Column:
    """Lines as ``str.splitlines`` gives them: a final line break opens no line."""
    def drop_last_empty(parts):
        n = F.size(parts)
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), n - 1)).otherwise(parts)

    return let(F.split(text, FLAGS + LINE_BREAK, -1), drop_last_empty)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, FLAGS + BLANK + "+", -1), lambda w: w != ""))


def line_count(text: Column) -> Column:
    return F.size(split_lines(text))


def newline_count(text: Column) -> Column:
    # a line feed is one byte, and bytes need not be counted
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def line_text(lines: Column, number: Column) -> Column:
    return F.coalesce(strip(F.get(lines, number - 1)), F.lit(""))


def snippet(lines: Column, number: Column, around: int = 2) -> Column:
    """The lines around a finding, ``around`` on each side, joined by newlines."""
    first = F.greatest(number - around, F.lit(1))
    return F.array_join(F.slice(lines, first, number + around - first + 1), "\n")


def placeholder(label: Column, number: Column) -> Column:
    return F.concat(F.lit("{{"), label, F.lit("_"), number.cast("string"), F.lit("}}"))


def kind_label(ext: Column, kinds: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(as_map(kinds), ext), F.concat(F.lit("."), ext, F.lit(" file")))


def title_case(name: Column) -> Column:
    """Underscores as blanks; every run of letters starts with a capital, also behind digits and hyphens."""
    pieces = F.regexp_extract_all(F.replace(name, F.lit("_"), F.lit(" ")), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(
        pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))
    ), "")


def percent(score: Column) -> Column:
    """A decimal score as whole per cent, cut off."""
    return (score * 100).cast("int")


def extension(path: Column) -> Column:
    """Lower-cased suffix of the file name; '' when there is none."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))
