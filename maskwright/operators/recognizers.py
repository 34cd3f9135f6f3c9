"""Recognizers other than the shipped patterns: name lists, rule tables, user code."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.spans import walk_blocks
from ..functions.text import as_map, let, newline_count, strip
from ..rules import CodeRule, ENTITY_LABELS, GAZETTEER_PCT, SpanRule
from ..rules.model import FLAGS
from .joins import checkpointed
from .scan import SCORE, add_findings

FINDING_ROWS = (
    "entity string, label string, rule string, start int, end int, score decimal(4,2), "
    "line_number int, value string"
)
MAX_RULES = 500

_WORD = r"\w+"
_CAPITAL = FLAGS + r"\A\p{Lu}"
# A word goes on over these, so a name does not end or start there.
_JOINTS = "'’-"
# Characters before a name that are looked at for the start of its word.
_BEFORE = 256


def normal_name(value):
    return F.lower(F.regexp_replace(strip(value), r"\s+", " "))


def listed_names(gazetteer: DataFrame) -> DataFrame:
    """(name, entity, small) of a table ``(name, entity)``: normal forms from first to last word character.

    ``small`` marks names such as ``van Gogh`` that hold a capital but do not start with one.
    """
    bare = F.regexp_replace("name", FLAGS + r"\A\W+|\W+\z", "")
    small = bare.rlike(FLAGS + r"\A\P{Lu}.*\p{Lu}")
    return (
        gazetteer.select(normal_name(bare).alias("name"), "entity", small.alias("small")).where("name != ''")
        .groupBy("name", "entity").agg(F.max("small").alias("small"))
    )


def word_index(gazetteer: DataFrame) -> DataFrame:
    """(word, name, entity, small, at, words): each name under its rarest word, with its place and their number.

    The rarest word is that of the fewest names, of equal ones the longest.
    """
    names = listed_names(gazetteer).withColumn("_all", F.regexp_extract_all("name", F.lit(FLAGS + _WORD), F.lit(0)))
    each = names.select("name", "entity", F.explode(F.array_distinct("_all")).alias("word"))
    known = each.groupBy("word").agg(F.count(F.lit(1)).alias("_names"))
    rarity = F.struct("_names", (-F.length("word")).alias("_length"), "word")
    rarest = each.join(known, "word").groupBy("name", "entity").agg(F.min(rarity)["word"].alias("word"))
    return names.join(rarest, ["name", "entity"]).select(
        "word", "name", "entity", "small", (F.array_position("_all", F.col("word")) - 1).cast("int").alias("at"),
        F.size("_all").alias("words"),
    )


def name_places(text: Column, wanted: Column, most: int) -> Column:
    """Where a text holds names by their words alone: for each ``wanted`` word, in each shape of the names under it.

    ``wanted`` is an array of (word, shapes), a shape of (at, words, small): the word's place in a name, the number of
    the name's words, at most ``most``, and whether such a name may start without a capital.  A struct of word, shape, start, end, line, value, the character ``after`` it and
    the part ``before`` it of the word that it stands in.  Words and the gaps between them are plain arrays; offsets
    are walked along from hit to hit, so the time grows with the text and the hits.
    """
    def joined(parts, first, n):
        return F.array_join(F.slice(parts, first + 1, n), "")

    def located(words, gaps):
        """The wanted words with their number, start and line."""
        names = wanted["word"]
        hits = F.filter(
            F.transform(words, lambda w, i: F.when(F.array_contains(names, F.lower(w)), i)), lambda i: i.isNotNull()
        )

        def step(state, i):
            passed = i - state["next"]

            def moved(between):
                start = state["at"] + F.length(between) + F.length(joined(words, state["next"], passed))
                line = state["line"] + newline_count(between)
                return let(start, lambda start: F.struct(
                    F.struct((i + 1).alias("next"), (start + F.length(F.get(words, i))).alias("at"), line.alias("line")).alias("state"),
                    F.struct(i.alias("i"), F.lower(F.get(words, i)).alias("word"), start.alias("start"), line.alias("line")).alias("piece"),
                ))

            return let(joined(gaps, state["next"], passed + 1), moved)

        begin = F.struct(F.lit(0).alias("next"), F.lit(0).alias("at"), F.lit(1).alias("line"))
        return walk_blocks(hits, begin, step, "struct<i:int,word:string,start:int,line:int>")

    def place(words, gaps, hit, shape):
        at, n = shape["at"], shape["words"]
        first = hit["i"] - at
        lead = joined(gaps, first + 1, at)
        value = F.when(n == 1, F.get(words, first)).otherwise(F.array_join(F.zip_with(
            F.slice(words, first + 1, n), F.concat(F.array(F.lit("")), F.slice(gaps, first + 2, n - 1)), lambda w, g: F.concat(g, w)
        ), ""))
        start = F.when(at == 0, hit["start"]).otherwise(hit["start"] - F.length(lead) - F.length(joined(words, first, at)))

        def before():
            """The part is looked for in so many characters before the farthest word that a name could begin with."""
            far = F.greatest(hit["i"] - most + 1, F.lit(0))
            since = F.greatest(far - _BEFORE // 2 - 1, F.lit(0))  # a word and a gap have a character each, at least
            taken = F.zip_with(
                F.slice(words, since + 1, first - since), F.slice(gaps, since + 2, first - since), lambda w, g: F.concat(w, g)
            )
            inside = F.length(joined(words, far, first - far)) + F.length(joined(gaps, far + 1, first - far))
            held = F.right(F.array_join(taken, ""), inside + F.least(F.lit(_BEFORE), start - inside))
            return F.regexp_extract(held, FLAGS + rf"(\w[\w{_JOINTS}]*)\z", 1)

        linked = (first > 0) & F.get(gaps, first).rlike(rf"\A[{_JOINTS}]+\z")
        return let(value, lambda value: F.struct(
            hit["word"].alias("word"), at.alias("at"), n.alias("words"), start.alias("start"), (start + F.length(value)).alias("end"),
            (hit["line"] - F.when(at == 0, F.lit(0)).otherwise(newline_count(lead))).alias("line"), value.alias("value"),
            F.substring(F.get(gaps, first + n), 1, 1).alias("after"), F.when(linked, before()).otherwise("").alias("before"),
        ))

    def places(words, gaps):
        def of_hit(hit):
            own = F.get(F.filter(wanted, lambda w: w["word"] == hit["word"]), F.lit(0))["shapes"]
            fitting = F.filter(own, lambda s: (hit["i"] >= s["at"]) & (hit["i"] - s["at"] + s["words"] <= F.size(words)) & (
                s["small"] | F.get(words, hit["i"] - s["at"]).rlike(_CAPITAL)
            ))
            return F.transform(fitting, lambda s: place(words, gaps, hit, s))

        return F.flatten(F.transform(located(words, gaps), of_hit))

    words = F.regexp_extract_all(text, F.lit(FLAGS + _WORD), F.lit(0))
    return let(words, lambda words: let(F.split(text, FLAGS + _WORD, -1), lambda gaps: places(words, gaps)))


def gazetteer_findings(
    df: DataFrame, gazetteer: DataFrame, key: str, text: str = "text",
) -> DataFrame:
    """PII-22 to PII-25 and JOIN-4: names of a table ``(name, entity)`` found in texts.

    Names are indexed by their rarest word.  The distinct words of the texts, single ones, meet the index in a
    join, which Spark broadcasts, filters by bloom filter or shuffles by measured size.  Only where a text holds
    such a word the words around it are put together as the names under it ask for, and meet the name that they are.
    A name counts where it starts with a capital, one written like ``van Gogh`` anywhere.
    """
    index = checkpointed(word_index(gazetteer))
    most = index.agg(F.max("words")).first()[0] or 1
    labels = as_map(ENTITY_LABELS)
    docs = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    own = F.transform(F.regexp_extract_all("_text", F.lit(FLAGS + _WORD), F.lit(0)), F.lower)
    words = docs.select("_hash", F.explode(F.array_distinct(own)).alias("word"))
    # the few places that a word has in the names under it, not the names
    shapes = index.groupBy("word", "at", "words").agg(F.max("small").alias("small")).groupBy("word").agg(
        F.collect_list(F.struct("at", "words", "small")).alias("shapes")
    )
    # copies of a text have their words once
    held = words.join(shapes, "word").groupBy("_hash").agg(F.collect_set(F.struct("word", "shapes")).alias("_wanted"))
    hits = docs.join(held, "_hash")
    places = F.explode_outer(name_places(F.col("_text"), F.col("_wanted"), most))  # see explode_findings
    candidates = hits.select("_key", places.alias("_p")).where("_p IS NOT NULL").select("_key", "_p.*")
    # one row for a place and shape meets its own name, however many names have the word
    named = candidates.withColumn("name", normal_name(F.col("value"))).join(index, ["word", "at", "words", "name"])
    whole = ~F.col("after").rlike(FLAGS + rf"[\w{_JOINTS}]") & ~F.col("before").rlike(_CAPITAL)
    capital = F.col("value").rlike(_CAPITAL)
    inner = (F.col("before") == "") | capital  # d'Artagnan holds Artagnan
    return named.where(
        ~F.col("value").rlike(r"[\r\n]") & whole & inner
    ).where(F.col("small") | capital).select(
        F.col("_key").alias(key), "entity", F.coalesce(F.try_element_at(labels, F.col("entity")), "entity").alias("label"),
        F.lit("GAZETTEER").alias("rule"), "start", "end",
        F.lit(GAZETTEER_PCT / 100).cast(SCORE).alias("score"), F.col("line").alias("line_number"), "value",
    )


def with_gazetteer(
    df: DataFrame, gazetteer: DataFrame, key: str, text: str = "text", findings: str = "findings",
    plain: DataFrame | None = None,
) -> DataFrame:
    """Add gazetteer findings to the findings of each document.

    ``plain`` are the same rows before they were scanned; without it names are looked for in ``df`` itself, whose
    findings are then made again for each pass over the texts.  They come back by key and hash of the text, so that null keys and keys of several texts get their own;
    rows that repeat both get the same.
    """
    # the texts are read here, other columns such as findings are not made for that
    marked = df.withColumn("_id", F.struct(F.col(key), F.xxhash64(text)))
    texts = df if plain is None else plain
    rows = gazetteer_findings(
        texts.select(F.struct(F.col(key), F.xxhash64(text)).alias("_id"), text), gazetteer, "_id", text
    ).distinct()
    return add_findings(marked, rows, "_id", findings).drop("_id")


def user_recognizer(
    df: DataFrame, recognize: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    key: str, text: str = "text",
) -> DataFrame:
    """UDF-3: a user function over Arrow batches of (key, text) that yields finding rows."""
    key_type = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(recognize, f"{key} {key_type}, {FINDING_ROWS}")


def _configured(table: DataFrame, fields: list[str], optional: dict[str, str], most: int) -> list:
    """Rows of a rule table; a column of ``optional`` that it lacks is null."""
    known = [F.col(c) if c in table.columns else F.lit(None).cast(kind).alias(c) for c, kind in optional.items()]
    rows = table.select(*fields, *known).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return rows


def rules_from_table(table: DataFrame, most: int = MAX_RULES) -> tuple[SpanRule, ...]:
    """UDF-1: rules kept in a table ``(entity, rule, regex, score, context)``.

    Columns that it may have besides: ``label``, ``group`` (1: only the first group of the pattern is masked) and
    ``tail`` (characters of the match behind that group).  A rule table is configuration: a table of more than
    ``most`` rules is refused, any other becomes literal expressions, so that no text is copied once per rule.
    """
    optional = {"label": "string", "group": "int", "tail": "int"}
    rows = _configured(table, ["entity", "rule", "regex", "score", "context"], optional, most)
    return tuple(
        SpanRule(
            r["entity"], r["rule"], r["regex"], int(round(float(r["score"]) * 100)),
            label=r["label"] or ENTITY_LABELS.get(r["entity"], r["entity"]), context=tuple(r["context"] or ()),
            group=r["group"] or 0, tail=r["tail"] or 0,
        )
        for r in sorted(rows, key=lambda r: (r["entity"], r["rule"]))
    )


def code_rules_from_table(table: DataFrame, most: int = MAX_RULES) -> tuple[CodeRule, ...]:
    """UDF-2: vulnerability rules kept in a table with the fields of ``CodeRule``, at most ``most``.

    The column ``languages`` (extensions, or ``any``) may be missing or null: the rule holds for all files.
    """
    fields = ["rule_id", "title", "description", "severity", "regex", "cwe", "advice"]
    rows = _configured(table, fields, {"languages": "array<string>"}, most)
    return tuple(
        CodeRule(*[r[f] for f in fields], **({"languages": tuple(r["languages"])} if r["languages"] else {}))
        for r in sorted(rows, key=lambda r: r["rule_id"])
    )
