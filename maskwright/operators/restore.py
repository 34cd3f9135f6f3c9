"""Putting real values back into texts which hold placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.spans import BLOCK, BLOCK_BITS, empty
from ..functions.text import let
from .joins import checkpointed, join_hot_keys

# --- fixed value: the form of a placeholder
TOKEN = r"\{\{([A-Za-z_][A-Za-z0-9_]*)_(\d+)\}\}"
# ---
FULL_TOKEN = rf"\A{TOKEN}\z"

ENTRY = "struct<seq:bigint,placeholder:string,value:string>"
ENTRY_LEFT = "struct<seq:bigint,placeholder:string,value:string,left:int>"


def tokens_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def _in_turn(text: Column, entries: Column) -> Column:
    """Literal replacement, entry by entry in vault order: what ``restore_column`` means, at the price of a pass each."""
    return F.aggregate(
        F.sort_array(entries), text, lambda t, e: F.replace(t, e["placeholder"], e["value"])
    )


def _looked_up(tokens: Column, entries: Column) -> Column:
    """Per token its entry (seq, value, left), or nulls; tokens and entries are sorted together.

    A run of equal placeholders starts with its entry, of two entries with the first; nothing is carried along.
    """
    kind = "struct<placeholder:string,what:int,seq:bigint,value:string,left:int>"
    items = F.sort_array(F.concat(
        F.transform(entries, lambda e: F.struct(e["placeholder"], F.lit(0), e["seq"], e["value"], e["left"]).cast(kind)),
        F.transform(tokens, lambda t, i: F.struct(t, F.lit(1), i, F.lit(None), F.lit(None)).cast(kind)),
    ))
    hit = "struct<i:bigint,seq:bigint,value:string,left:int>"

    def runs_of(found):
        def begins(j):
            return (j == 0) | ~F.get(found, j)["placeholder"].eqNullSafe(F.get(found, j - 1)["placeholder"])

        def members(starts):
            def of_run(s, r):
                size = F.coalesce(F.get(starts, r + 1), F.size(found)) - s
                wanted = F.filter(F.slice(found, s + 1, size), lambda x: x["what"] == 1)
                entry = F.get(found, s)
                return F.transform(wanted, lambda x: F.struct(x["seq"], *[
                    F.when(entry["what"] == 0, entry[c]) for c in ("seq", "value", "left")
                ]).cast(hit))

            return F.sort_array(F.flatten(F.transform(starts, of_run)))

        return let(F.filter(F.sequence(F.lit(0), F.size(found) - 1), begins), members)

    return F.when(F.size(tokens) == 0, empty(f"array<{hit}>")).otherwise(let(items, runs_of))


def _with_left(entry: Column, value: Column, left: Column) -> Column:
    return F.struct(
        entry["seq"].alias("seq"), entry["placeholder"].alias("placeholder"), value.alias("value"), left.alias("left")
    )


def _expanded(entries: Column) -> Column:
    """Entries with the placeholders inside their values replaced, and ``left``, how many stay there.

    Entries are a graph from each to the later ones in its value; an earlier one stays as it is.  Only those with
    placeholders inside, usually none, are walked, from the last to the first, so what an entry needs is
    expanded already.  What each placeholder stands for is looked up once for all, a plain entry or the number
    of a walked one, and walked entries are kept in blocks: n log n, however deep they are nested.
    """
    def holds(e):
        return F.contains(e["value"], F.lit("{{"))

    def bare(e):
        return _with_left(e, e["value"], F.lit(0))

    def tokens_of(e):
        return F.regexp_extract_all(e["value"], F.lit(TOKEN), F.lit(0))

    def walk(nested, plain):
        # a walked entry is known by its number, as -1 - number in place of ``left``
        numbered = F.transform(nested, lambda e, i: _with_left(e, F.lit(None).cast("string"), (-1 - i).cast("int")))
        hits = _looked_up(F.flatten(F.transform(nested, tokens_of)), F.concat(plain, numbered))

        def all_blocks(hits):
            def block(acc, b):
                def known(hit, current):
                    number = -1 - hit["left"]
                    return F.when(hit["left"] >= 0, F.struct(hit["value"].alias("value"), hit["left"].alias("left"))).otherwise(
                        let(F.when(number >= b * BLOCK, F.get(current, number - b * BLOCK)).otherwise(
                            F.get(F.get(acc["out"], F.shiftright(number, BLOCK_BITS)), F.pmod(number, F.lit(BLOCK)))
                        ), lambda e: F.struct(e["value"].alias("value"), e["left"].alias("left")))
                    )

                def expand(e, found, current):
                    # an earlier entry stays as it is
                    parts = F.zip_with(tokens_of(e), found, lambda t, h: F.when(
                        h["seq"] > e["seq"], known(h, current)
                    ).otherwise(F.struct(t.alias("value"), F.lit(1).alias("left"))))
                    gaps = F.split(e["value"], TOKEN, -1)
                    return let(parts, lambda parts: _with_left(e, F.concat(
                        F.get(gaps, F.lit(0)), F.array_join(F.zip_with(
                            parts, F.slice(gaps, F.lit(2), F.size(parts)), lambda part, gap: F.concat(part["value"], gap)
                        ), ""),
                    ), F.aggregate(parts, F.lit(0), lambda n, part: n + part["left"])))

                def one(state, i):
                    e = F.get(nested, i)
                    count = F.size(tokens_of(e))
                    return F.struct(
                        (state["at"] + count).alias("at"),
                        F.concat(state["out"], F.array(expand(e, F.slice(hits, state["at"] + 1, count), state["out"]))).alias("out"),
                    )

                inside = F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, F.size(nested)) - 1)
                init = F.struct(acc["at"].alias("at"), empty(f"array<{ENTRY_LEFT}>").alias("out"))
                return let(F.aggregate(inside, init, one), lambda x: F.struct(
                    x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out"),
                ))

            blocks = F.sequence(F.lit(0), F.floor((F.size(nested) - 1) / F.lit(BLOCK)).cast("int"))
            init = F.struct(F.lit(0).alias("at"), empty(f"array<array<{ENTRY_LEFT}>>").alias("out"))
            return F.aggregate(blocks, init, block, lambda acc: F.flatten(acc["out"]))

        return let(hits, all_blocks)

    def split(nested):
        plain = F.transform(F.filter(entries, lambda e: ~holds(e)), bare)
        return F.when(F.size(nested) == 0, plain).otherwise(let(plain, lambda p: F.concat(
            p, let(F.sort_array(nested, asc=False), lambda ordered: walk(ordered, p))
        )))

    return let(F.filter(entries, holds), split)


def restore_column(text: Column, entries: Column) -> Column:
    """REST-1 in one row: literal replacement, entry by entry in vault order.

    The text is cut at its placeholders once, these are looked up by merging and the text is put together once,
    which takes n log n.  Placeholders cannot overlap, so the order of entries matters only inside values:
    those are expanded first.  Where a placeholder comes up between two pieces, two entries share one, or an
    entry replaces something of another form, the entries are applied one by one instead.
    """
    def once(known):
        gaps, tokens = F.split(text, TOKEN, -1), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
        parts = F.zip_with(tokens, _looked_up(tokens, known), lambda t, h: F.struct(
            F.coalesce(h["value"], t).alias("text"), F.coalesce(h["left"], F.lit(1)).alias("left")
        ))

        def put_together(parts):
            body = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.zip_with(
                parts, F.slice(gaps, F.lit(2), F.size(parts)), lambda part, gap: F.concat(part["text"], gap)
            ), ""))
            left = F.aggregate(parts, F.lit(0), lambda n, part: n + part["left"])
            # more placeholders than are left: one has come up where two pieces meet
            return let(body, lambda t: F.when(F.regexp_count(t, F.lit(TOKEN)) == left, t).otherwise(_in_turn(text, entries)))

        return let(parts, put_together)

    names = F.transform(entries, lambda e: e["placeholder"])
    odd = F.exists(names, lambda n: ~n.rlike(FULL_TOKEN)) | (F.size(F.array_distinct(names)) < F.size(names))
    return F.when(odd, _in_turn(text, entries)).when(~F.contains(text, F.lit("{{")), text).otherwise(
        let(_expanded(entries), once)
    )


def restored_count(text: Column, entries: Column) -> Column:
    """REST-2: entries whose placeholder occurs in the text as it came."""
    def found(e):
        return F.contains(text, e["placeholder"])

    own = F.filter(entries, lambda e: e["placeholder"].rlike(FULL_TOKEN))
    other = F.filter(entries, lambda e: ~e["placeholder"].rlike(FULL_TOKEN) & found(e))
    hits = _looked_up(F.transform(own, lambda e: e["placeholder"]), F.transform(
        tokens_in(text),
        lambda t: F.struct(F.lit(0).cast("long").alias("seq"), t.alias("placeholder"), F.lit("").alias("value"), F.lit(0).alias("left")),
    ))
    return F.size(F.filter(hits, lambda h: h["seq"].isNotNull())) + F.size(other)


def as_entries(vault: Column) -> Column:
    """Vault array of a masked document in the shape ``restore_column`` takes."""
    return F.transform(vault, lambda e: F.struct(
        e["seq"].alias("seq"), e["placeholder"].alias("placeholder"), e["value"].alias("value")
    ))


def _text_tokens(texts: DataFrame, key: str, session: str, text: str) -> DataFrame:
    return (
        texts.select(
            F.col(key).alias("_key"), F.col(session).alias("session_id"),
            F.explode_outer(tokens_in(F.col(text))).alias("placeholder"),
        )
        .where(F.col("placeholder").isNotNull())
    )


def _apply(texts: DataFrame, tokens: DataFrame, vault: DataFrame, key: str, text: str) -> DataFrame:
    """One exact pass with the entries looked up for ``tokens``.

    Adds ``restored``, ``restored_count`` and ``_unseen``: tokens that came up on
    the way and were not looked up.
    """
    looked_up = tokens.groupBy("_key").agg(F.collect_set("placeholder").alias("_tokens"))
    found = join_hot_keys(
        tokens, vault.select("session_id", "placeholder", "seq", "value"), ["session_id", "placeholder"]
    )
    entries = found.groupBy("_key").agg(
        F.sort_array(F.collect_list(F.struct("seq", "placeholder", "value"))).alias("_entries")
    )
    per_text = looked_up.join(entries, "_key", "left").withColumnRenamed("_key", key)
    # Texts without a placeholder stay where they are; only the others are joined.
    holds = F.coalesce(F.contains(text, F.lit("{{")), F.lit(False))
    joined = texts.where(holds).join(per_text, key, "left")
    untouched = texts.where(~holds).select(
        "*", F.col(text).alias("restored"), F.lit(0).alias("restored_count"),
        F.array().cast("array<string>").alias("_unseen"),
    )

    replaced = (
        joined.withColumn("restored", F.when(F.col("_entries").isNull(), F.col(text)).otherwise(
            restore_column(F.col(text), F.col("_entries").cast(f"array<{ENTRY}>"))
        ))
        .withColumn("restored_count", F.when(F.col("_entries").isNull(), 0).otherwise(
            restored_count(F.col(text), F.col("_entries").cast(f"array<{ENTRY}>"))
        ))
        # what is left and was not looked up came up on the way
        .withColumn("_unseen", F.array_except(
            tokens_in(F.col("restored")), F.coalesce("_tokens", F.array().cast("array<string>"))
        ))
        .drop("_entries", "_tokens")
    )
    return replaced.unionByName(untouched)


def _nested(tokens: DataFrame, vault: DataFrame) -> DataFrame:
    """Placeholders inside the values of looked-up entries: usually none."""
    inside = vault.where(F.contains("value", F.lit("{{"))).select(
        "session_id", "placeholder", tokens_in(F.col("value")).alias("_inner")
    )
    return join_hot_keys(tokens, inside, ["session_id", "placeholder"]).select(
        "_key", "session_id", F.explode("_inner").alias("placeholder")
    )


def restore(
    texts: DataFrame, vault: DataFrame, key: str, session: str, text: str = "text", depth: int | None = None,
) -> DataFrame:
    """REST-1 and REST-2 against a vault table; adds ``restored`` and ``restored_count``.

    Each text meets only the entries whose placeholders it holds, not the vault of
    its session, so a session may have any size.  Placeholders inside restored values
    are followed to the end; a ``depth`` stops sooner, and a text that needs more then
    fails the query, it is never left half done.  A placeholder that comes up only when
    two restored values meet fails it too: ``restore_nested`` follows those.

    The texts are read twice, once for their tokens and once to be rewritten; the
    joins in between work on the checkpointed tokens alone.
    """
    tokens = checkpointed(_text_tokens(texts, key, session, text))
    level, followed = tokens, 0
    while depth is None or followed < depth:
        level = checkpointed(_nested(level, vault).distinct().join(tokens, tokens.columns, "left_anti"))
        if level.isEmpty():
            break
        tokens = checkpointed(tokens.unionByName(level))
        followed += 1
    done = _apply(texts, tokens, vault, key, text)
    checked = F.when(F.size("_unseen") > 0, F.raise_error(F.concat(
        F.lit("placeholders nested deeper than depth: "), F.array_join("_unseen", ", ")
    )).cast("string")).otherwise(F.col("restored"))
    return done.withColumn("restored", checked).drop("_unseen")


def restore_nested(
    texts: DataFrame, vault: DataFrame, key: str, session: str, text: str = "text",
) -> DataFrame:
    """``restore`` for any nesting: repeats until no text shows a new placeholder."""
    tokens = checkpointed(_text_tokens(texts, key, session, text))
    while True:
        done = checkpointed(_apply(texts, tokens, vault, key, text))
        new = done.where(F.size("_unseen") > 0).select(
            F.col(key).alias("_key"), F.col(session).alias("session_id"),
            F.explode("_unseen").alias("placeholder"),
        )
        if new.isEmpty():
            return done.drop("_unseen")
        tokens = checkpointed(tokens.unionByName(new).distinct())


def unresolved(texts: DataFrame, vault: DataFrame, key: str, session: str, text: str = "text") -> DataFrame:
    """REST-3: placeholders in a text for which its session has no vault entry."""
    tokens = checkpointed(_text_tokens(texts, key, session, text))
    names = ["session_id", "placeholder"]
    # each placeholder of a session is looked for once, however many texts hold it
    missing = tokens.select(*names).distinct().join(vault.select(*names), names, "left_anti")
    return join_hot_keys(tokens, missing.withColumn("_missing", F.lit(True)), names).select(
        F.col("_key").alias(key), *names
    )
