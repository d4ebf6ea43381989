"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of the whole text come from one vectorised pass. Paths of shallow random-forest trees
become conjunctive rules (a range per statistic), a lasso logistic regression keeps few of them, and
the kept rules are compiled into one Spark column expression, so scoring joins and shuffles nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moralens.functions.hashing import hash_unit
from moralens.llm.text import bytes_of, free_name, slices, word_hashes
from moralens.staging import row_count, stage

THRESHOLD = 0.3
FOLDS = 5
#: The classifier learns from at most about so many labelled rows, taken by a hash of their ids.
MAX_TRAINING_ROWS = 40_000
TREES = 24
DEPTH = 3
PENALTY = 0.0005
SEED = 10

STATISTICS = (
    "words",  # log1p of the number of words
    "word_bytes",  # mean length of a word
    "upper",  # capitals among ASCII letters
    "digit",
    "exclaim",  # these five per word
    "bar",
    "symbol",
    "mark",
    "stop",
    "lines",
    "repeat",  # words equal to the one before
    "distinct",  # different words among the words
    "high",  # bytes outside ASCII
)


def _classes() -> np.ndarray:
    """Class number of each byte: 0 other, 1 capital, 2 small, 3 digit, 4 !, 5 |, 6 symbol, 7 , ; :, 8 ., 9 line, 10 high."""
    table = np.zeros(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("a") : ord("z") + 1] = 2
    table[ord("0") : ord("9") + 1] = 3
    table[128:] = 10
    for number, characters in ((4, "!"), (5, "|"), (6, "#$%&*@^~<>{}[]=_\\"), (7, ",;:"), (8, "."), (9, "\n")):
        for c in characters:
            table[ord(c)] = number
    return table


def statistics_of(texts: pa.Array) -> pa.Array:
    """Statistics of each text as a struct; NULL and empty texts have zeros throughout."""
    flat, offsets = bytes_of(texts)
    table = _classes()
    parts: list[np.ndarray] = []
    for start, stop in slices(offsets):
        own = offsets[start : stop + 1]
        rows = own - own[0]
        part = flat[own[0] : own[-1]]
        n = stop - start
        row_of = np.repeat(np.arange(n), np.diff(rows))
        counts = np.bincount(row_of * 11 + table[part], minlength=n * 11).reshape(n, 11).astype(float)
        # white space ends words: the copy has spaces for all of it
        spaced = np.where(part <= 32, np.uint8(32), part)
        hashes, bounds = word_hashes(spaced, rows)
        words = np.diff(bounds).astype(float)
        word_row = np.repeat(np.arange(n), np.diff(bounds))
        same = np.zeros(len(hashes), dtype=bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])
        repeats = np.bincount(word_row[same], minlength=n).astype(float)
        order = np.lexsort((hashes, word_row))
        fresh = np.ones(len(hashes), dtype=bool)
        h, r = hashes[order], word_row[order]
        fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        distinct = np.bincount(r[fresh], minlength=n).astype(float)
        solid = np.bincount(row_of[spaced != 32], minlength=n).astype(float)
        some, letters = np.maximum(words, 1), np.maximum(counts[:, 1] + counts[:, 2], 1)
        total = np.maximum(np.diff(rows), 1).astype(float)
        parts.append(
            np.column_stack(
                [
                    np.log1p(words),
                    solid / some,
                    counts[:, 1] / letters,
                    counts[:, 3] / total,
                    counts[:, 4] / some,
                    counts[:, 5] / some,
                    counts[:, 6] / some,
                    counts[:, 7] / some,
                    counts[:, 8] / some,
                    counts[:, 9] / some,
                    repeats / some,
                    distinct / some,
                    counts[:, 10] / total,
                ]
            )
        )
    matrix = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in matrix.T], names=list(STATISTICS))


def text_statistics(text: Column) -> Column:
    """Struct of ``STATISTICS`` of the whole text."""

    def measured(texts: pa.Array) -> pa.Array:
        return statistics_of(texts)

    return F.arrow_udf(measured, ", ".join(f"{s} double" for s in STATISTICS))(text)


@dataclass(frozen=True)
class Rule:
    """Ranges (statistic, above, up to) that must all hold, and the weight they add."""

    ranges: tuple[tuple[str, float, float], ...]
    weight: float = 0.0

    def holds(self, stats: Column) -> Column:
        out = F.lit(True)
        for name, low, high in self.ranges:
            if low > -math.inf:
                out = out & (stats[name] > F.lit(low))
            if high < math.inf:
                out = out & (stats[name] <= F.lit(high))
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self, stats: Column) -> Column:
        """Probability of a good text, between 0 and 1."""
        margin = F.lit(self.intercept)
        for rule in self.rules:
            margin = margin + F.when(rule.holds(stats), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def tree_rules(root) -> list[tuple[tuple[str, float, float], ...]]:
    """Every path from the root to a node below it, as ranges per statistic."""
    found = []

    def walk(node, ranges: dict[str, tuple[float, float]]) -> None:
        if ranges:
            found.append(tuple((s, *ranges[s]) for s in STATISTICS if s in ranges))
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        name, cut = STATISTICS[split.featureIndex()], float(split.threshold())
        low, high = ranges.get(name, (-math.inf, math.inf))
        walk(node.leftChild(), ranges | {name: (low, min(high, cut))})
        walk(node.rightChild(), ranges | {name: (max(low, cut), high)})

    walk(root, {})
    return found


def rules_held(rules: list[Rule]):
    """An Arrow function: statistics to one 0/1 value per rule; hundreds of candidates make no column expression."""
    place = {name: k for k, name in enumerate(STATISTICS)}

    def held(stats: pa.Array) -> pa.Array:
        matrix = np.column_stack([stats.field(name).to_numpy(zero_copy_only=False) for name in STATISTICS])
        out = np.ones((len(matrix), len(rules)))
        for k, rule in enumerate(rules):
            for name, low, high in rule.ranges:
                value = matrix[:, place[name]]
                out[:, k] *= (value > low) & (value <= high)
        offsets = pa.array(np.arange(0, out.size + 1, max(len(rules), 1), dtype=np.int32)[: len(matrix) + 1])
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return F.arrow_udf(held, "array<double>")


def fit_rules(measured: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> RuleEnsemble:
    """Learn from ``measured`` (doc_id, stats) and ``labels`` (doc_id, quality).

    Rows whose crc32 of the id is divisible by ``FOLDS`` are held out. A document with several labels
    counts as the majority, good on a tie; NULL ids and labels are left out. With no labels or one
    class only, the ensemble has no rules and scores everything as the smoothed share of good texts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("double").alias("label"))
    known = known.withColumnRenamed("doc_id", "_id")
    n = known.count()
    if n > max_rows:
        known = known.where(hash_unit(SEED, F.col("_id")) < max_rows / n)
    values = F.array(*[F.col(f"stats.{s}") for s in STATISTICS])
    joined = measured.join(known, F.col("doc_id") == F.col("_id")).select("label", "stats", values.alias("_values"))
    train = stage(joined.repartition(2), "quality_training")
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(sizes) < 2:
        good, total = sizes.get(1.0, 0), sum(sizes.values())
        share = (good + 1) / (total + 2)
        return RuleEnsemble((), math.log(share / (1 - share)))
    vectors = train.select("label", "stats", array_to_vector("_values").alias("features"))
    forest = RandomForestClassifier(
        labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=5, featureSubsetStrategy="onethird"
    ).fit(vectors)
    paths = list(dict.fromkeys(p for tree in forest.trees for p in tree_rules(tree._call_java("rootNode"))))
    candidates = [Rule(p) for p in paths]
    held = rules_held(candidates)(F.col("stats"))
    lasso = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False)
    model = lasso.fit(stage(train.select("label", held.alias("_held")), "quality_rules").select("label", array_to_vector("_held").alias("features")))
    weights = model.coefficients.toArray()
    kept = tuple(Rule(r.ranges, float(w)) for r, w in zip(candidates, weights, strict=True) if w != 0.0)
    return RuleEnsemble(kept, float(model.intercept))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; empty texts are scored by zero statistics."""
    measured = stage(documents.select("doc_id", text_statistics(F.col("text")).alias("stats")), "quality_stats")
    score = fit_rules(measured, labels).score(F.col("stats"))
    return measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def good_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns, repeated rows included."""
    own = [F.col(f"`{c}`") for c in documents.columns]
    measured = documents.select("doc_id", text_statistics(F.col("text")).alias("stats"))
    ensemble = fit_rules(measured, labels)
    stats = free_name("_quality_stats", documents)
    return documents.withColumn(stats, text_statistics(F.col("text"))).where(ensemble.score(F.col(stats)) >= threshold).select(*own)
