"""Quality classifier: a sparse ensemble of rules.

Shallow trees are grown on statistics of the texts; every path from a root is a conjunctive rule.  A
logistic regression with an L1 penalty weighs the rules and drops most.  What is left is one Spark column
expression over the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from maskwright.functions.spans import with_once
from maskwright.llm.common import SPACES, text_or_empty, written

#: Labelled documents to learn from, about: those with the smallest hashes of their key.
SAMPLE = 20_000
TREES, DEPTH, PENALTY = 12, 3, 0.002
THRESHOLD = 0.3
#: Statistics of a text; only these are inputs of a score.
STATISTICS = (
    "words", "word_length", "symbols", "marks", "pipes", "exclaims", "capitals", "digits", "spaces",
    "distinct_words", "repeated_lines", "line_length", "stops",
)


@dataclass(frozen=True)
class Rule:
    """(statistic, at most?, value), all of which hold; ``weight`` in the score."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_most, value in self.conditions:
            out &= F.col(name) <= value if at_most else F.col(name) > value
        return out.cast("double")


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule in self.rules:
            total += rule.column() * rule.weight
        return 1 / (1 + F.exp(-total))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``STATISTICS``, finite for every text; a null text counts as empty."""
    rows = docs.withColumn("_text", text_or_empty(text))
    trimmed = F.trim("_text", F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    rows = with_once(rows, "_w", words)
    length = F.char_length("_text")
    n, size = F.greatest(F.size("_w"), F.lit(1)), F.greatest(length, F.lit(1))

    def share(characters: str) -> Column:
        """Share of the characters of a class; cutting out runs of all others is the fastest way to count them."""
        return F.char_length(F.regexp_replace("_text", f"[^{characters}]+", "")) / size

    lines = F.split("_text", "\n")
    return rows.select(
        *docs.columns, F.size("_w").cast("double").alias("words"), (length / n).alias("word_length"),
        share(r"#*$%&<>@^~=_{}\[\]\\").alias("symbols"), share(".,;:'\"()-").alias("marks"), share("|").alias("pipes"),
        share("!?").alias("exclaims"), share("A-Z").alias("capitals"),
        share("0-9").alias("digits"), share(r"\x20\x09-\x0D").alias("spaces"),
        (F.size(F.array_distinct("_w")) / n).alias("distinct_words"),
        (1 - F.size(F.array_distinct(lines)) / F.size(lines)).alias("repeated_lines"),
        (length / F.size(lines)).cast("double").alias("line_length"), share(".").alias("stops"),
    )


def paths(model) -> list[tuple[tuple[str, bool, float], ...]]:
    """The conditions of every node below the roots of a forest, each once; its mirror image is left out."""
    found = {}

    def walk(node, conditions):
        if conditions:
            found.setdefault(conditions, None)
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        name, value = STATISTICS[split.featureIndex()], split.threshold()
        walk(node.leftChild(), merged(conditions, name, True, value))
        walk(node.rightChild(), merged(conditions, name, False, value))

    for tree in model._java_obj.trees():
        walk(tree.rootNode(), ())
    single = {(c[0][0], c[0][2]) for c in found if len(c) == 1 and c[0][1]}
    return [c for c in found if not (len(c) == 1 and not c[0][1] and (c[0][0], c[0][2]) in single)]


def merged(conditions: tuple, name: str, at_most: bool, value: float) -> tuple:
    """Add a condition; a bound on the same side of the same statistic is replaced by the tighter one."""
    rest = tuple(c for c in conditions if c[:2] != (name, at_most))
    return tuple(sorted((*rest, (name, at_most, value))))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from labelled rows for whose key (a column ``_label_key``) ``usable`` holds.

    A key labelled more than once counts with its largest label; null labels teach nothing.  With one
    class only, or no label at all, the score is the share of that class, or one half.
    """
    known = labels.select(F.col(key).alias("_label_key"), F.col(label).cast("double").alias("_label")).where(
        F.col("_label").isNotNull() & usable
    ).groupBy("_label_key").agg(F.max("_label").alias("_label"))
    n = known.count()
    place = F.pmod(F.xxhash64("_label_key"), F.lit(1 << 30))
    chosen = known.where(place < int((1 << 30) * min(1.0, sample / max(n, 1))))
    # about ``sample`` rows at any size of the corpus
    rows = docs.select(F.col(key).alias("_label_key"), F.col(text).alias("_text_in")).join(F.broadcast(chosen), "_label_key")
    train = written(statistics(rows, "_text_in").select("_label_key", "_label", *STATISTICS), "statistics")
    sums = train.agg(F.count(F.lit(1)), F.sum("_label")).first()
    if not sums[0] or sums[1] in (0, sums[0]):
        rate = min(max((sums[1] or 0) / sums[0], 1e-6), 1 - 1e-6) if sums[0] else 0.5
        return Model(math.log(rate / (1 - rate)), ())
    # the same partitions in the same order at every run, for the trees' random choices
    train = train.repartition(8, "_label_key").sortWithinPartitions("_label_key", *STATISTICS)
    vectors = written(train, "training").withColumn("x", array_to_vector(F.array(*STATISTICS)))
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="_label", numTrees=TREES, maxDepth=DEPTH, seed=17, featureSubsetStrategy="0.5"
    ).fit(vectors)
    found = [Rule(c) for c in paths(forest)]
    if not found:
        rate = sums[1] / sums[0]
        return Model(math.log(rate / (1 - rate)), ())
    ruled = vectors.select("_label", array_to_vector(F.array(*[r.column() for r in found])).alias("rules"))
    fitted = LogisticRegression(
        featuresCol="rules", labelCol="_label", elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False
    ).fit(ruled)
    weights = fitted.coefficients.toArray()
    return Model(float(fitted.intercept), tuple(Rule(r.conditions, float(w)) for r, w in zip(found, weights) if w))


def _rated(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """(_row, _score): the rows as they are, whatever their columns are called."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_in"))
    return statistics(rows, "_in").select("_row", model.score().alias("_score"))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on), one row per row.

    Columns of these two names that ``docs`` has are replaced.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    return _rated(docs, model, text).select(
        *[F.col("_row")[c].alias(c) for c in names], F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score the threshold or more, all columns unchanged."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_in"))
    # a filter on a plain column would compute the statistics anew for each rule that reads them
    rated = with_once(statistics(rows, "_in"), "_score", model.score())
    return rated.where(F.col("_score") >= threshold).select("_row.*")
