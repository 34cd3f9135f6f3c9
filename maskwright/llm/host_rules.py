"""Quality rules with a verdict on hosts: DataFrame functions only.

Every document is measured and judged by two rules.  Failures are summed by host, the hosts' failure rates
shrunk towards the corpus by a beta prior fitted to the rates themselves (by moments), and hosts whose
shrunk rate passes ``HOST_LIMIT`` lose their other documents too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from maskwright.functions.spans import with_once
from maskwright.llm.common import SPACES, salted_join, text_or_empty, written

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: A host is rejected when its shrunk failure rate is above this.
HOST_LIMIT = 0.5
# Stand-ins for the prior's strength where rates show no spread beyond chance, or nothing but spread.
_STRONGEST, _WEAKEST = 1e6, 1e-3


def _words(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _repeat_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that a text holds twice or more: sorts only texts that have any."""
    n = F.size(words)
    grams = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)),
        lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(WINDOW)]),
    )).otherwise(F.array().cast("array<bigint>"))

    def covered(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def of(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (
                ((j > 0) & (F.get(s, j - 1)["g"] == x["g"])) | ((j < F.size(s) - 1) & (F.get(s, j + 1)["g"] == x["g"]))
            ))
            at = F.sort_array(F.transform(twice, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last"))
            return F.aggregate(at, start, lambda a, p: F.struct(
                (a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum"), p.alias("last")
            ))["sum"]

        return F.get(F.transform(F.array(pairs), of), F.lit(0))

    counted = F.transform(F.array(grams), lambda g: F.when(
        F.size(F.array_distinct(g)) < F.size(g), covered(g)
    ).otherwise(F.lit(0)))
    return F.get(counted, F.lit(0))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of whole texts.

    A null text counts as empty, so it fails the word rule.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(host).alias("_host"), text_or_empty(text).alias("_text"))
    rows = with_once(rows, "_words", _words(F.col("_text")))
    length = F.char_length("_text")
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    lines = F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0))
    rows = rows.select(
        F.col("_key").alias(key), F.col("_host").cast("string").alias("_host"), F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        (length - F.char_length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"), _repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def host_rates(measured: DataFrame) -> DataFrame:
    """(_host, n, failed, host_rate): failure rates shrunk by an empirical beta prior.

    Mean and spread of the prior come from one row of sums over all hosts.  No document of a host is left
    out; documents without a host form one host.
    """
    hosts = measured.groupBy("_host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")
    )
    got = hosts.agg(
        F.count(F.lit(1)), F.sum("n"), F.sum("failed"), F.sum(F.col("failed") * F.col("failed") / F.col("n"))
    ).first()
    hosts_, n, failed, squares = got[0], got[1] or 0, got[2] or 0, got[3] or 0.0
    mean = failed / n if n else 0.0
    chance = mean * (1 - mean)
    spread = squares / n - mean * mean - chance * hosts_ / n if n else 0.0
    strength = min(max(chance / spread - 1, _WEAKEST), _STRONGEST) if spread > 0 else _STRONGEST
    return hosts.withColumn(
        "host_rate", F.round((F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength)), 6)
    )


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Measurements, ``host_rate`` and ``kept``: one row per row of ``docs``, whatever its key.

    A document is kept if it passes the base rules and its host's shrunk failure rate is at most ``limit``.
    """
    measured = written(measure(docs, key, text, host), "measured")
    rates = written(host_rates(measured).select("_host", "host_rate"), "hosts")
    # a null host joins as well; a host with a third of all rows is dealt out
    named = F.coalesce(F.concat(F.lit("+"), F.col("_host")), F.lit("-"))
    joined = salted_join(
        measured.withColumn("_name", named).drop("_host"), rates.select(named.alias("_name"), "host_rate"), ["_name"],
        F.xxhash64(key, "n_words", "word_chars"),
    ).drop("_name")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= limit))
