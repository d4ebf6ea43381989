"""Classification metrics, exact under ties, from score histograms; comparison and ranking of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moralens.functions.ranking import prefix_counts

METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]
THRESHOLD = 0.5


def classify_scores(df: DataFrame, score: str, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``prediction``: 1 if the score is strictly above the threshold."""
    return df.withColumn("prediction", (F.col(score) > threshold).cast("int"))


def ratio(top: Column, bottom: Column, otherwise: float = 0.0) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(otherwise))


def score_counts(scored: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Rows and positives per distinct score; everything below needs only this reduced table."""
    return scored.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("positives")
    )


def confusion_matrix(scored: DataFrame, keys: list[str], score: str, label: str, threshold: float = THRESHOLD) -> DataFrame:
    """``actual, predicted, n`` with all four cells present."""
    predicted = (F.col(score) > threshold).cast("int")
    counts = scored.groupBy(*keys).agg(
        *[
            F.count_if((F.col(label) == a) & (predicted == p)).alias(f"c{a}{p}")
            for a in (0, 1)
            for p in (0, 1)
        ]
    )
    cells = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"c{a}{p}").alias("n"))
        for a in (0, 1)
        for p in (0, 1)
    ]
    return counts.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def binary_metrics(
    scored: DataFrame, keys: list[str], score: str = "score", label: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """Accuracy, precision, recall, F1, ROC AUC and average precision per key (e.g. model and split)."""
    anchor = [] if keys else ["_all"]
    source = scored if keys else scored.withColumn("_all", F.lit(0))
    groups = keys or anchor
    # scores in descending order: after the k best rows, cum_positives of them are hits
    counts = prefix_counts(
        score_counts(source, groups, score, label), groups, "score", ["n", "positives"], descending=True
    )
    hits, seen = F.col("cum_positives").cast("double"), F.col("cum_n").cast("double")
    positives, negatives = F.col("positives").cast("double"), (F.col("n") - F.col("positives")).cast("double")
    above = F.col("score") > threshold
    sums = counts.groupBy(*groups).agg(
        F.sum("n").cast("double").alias("total"),
        F.sum(positives).alias("n1"),
        F.sum(F.when(above, positives).otherwise(0.0)).alias("tp"),
        F.sum(F.when(above, negatives).otherwise(0.0)).alias("fp"),
        F.sum(negatives * (hits - positives / 2)).alias("area"),
        F.sum(positives * hits / seen).alias("ap"),
    )
    tp, fp, n1, total = F.col("tp"), F.col("fp"), F.col("n1"), F.col("total")
    n0 = total - n1
    one_class = (n1 == 0) | (n0 == 0)
    return sums.select(
        *keys,
        ((tp + n0 - fp) / total).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, n1).alias("recall"),
        ratio(2 * tp, tp + fp + n1).alias("f1"),
        F.when(one_class, 0.5).otherwise(ratio(F.col("area"), n1 * n0)).alias("roc_auc"),
        F.when(one_class, 0.5).otherwise(ratio(F.col("ap"), n1)).alias("pr_auc"),
    )


def roc_points(scored: DataFrame, score: str, label: str) -> DataFrame:
    """``threshold, fpr, tpr`` at every distinct score, from the highest down, plus the origin."""
    counts = score_counts(scored.withColumn("_all", F.lit(0)), ["_all"], score, label)
    totals = counts.agg(F.sum("positives").alias("n1"), F.sum(F.col("n") - F.col("positives")).alias("n0")).first()
    n1, n0 = totals["n1"] or 0, totals["n0"] or 0
    running = prefix_counts(counts, ["_all"], "score", ["n", "positives"], descending=True)
    points = running.select(
        F.col("score").alias("threshold"),
        ratio(F.col("cum_n") - F.col("cum_positives"), F.lit(float(n0))).alias("fpr"),
        ratio(F.col("cum_positives"), F.lit(float(n1))).alias("tpr"),
    )
    origin = scored.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(points)


def tall_metrics(wide: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, metric)."""
    return wide.unpivot(keys, METRICS, "metric", "value")


def train_test_table(tall: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """Train and test value of each metric side by side, with difference, relative difference and risk."""
    side = lambda name: F.max(F.when(F.col(split) == name, F.col("value")))
    wide = tall.groupBy(*keys, "metric").agg(side("train").alias("train"), side("test").alias("test"))
    matched = wide.where(F.col("train").isNotNull() & F.col("test").isNotNull())
    return overfitting(matched)


def overfitting(table: DataFrame) -> DataFrame:
    """Add ``diff``, ``pct_diff`` (0 if test is 0) and ``risk`` to a table with ``train`` and ``test``."""
    diff = F.col("train") - F.col("test")
    compared = table.withColumn("diff", diff).withColumn("pct_diff", ratio(diff * 100, F.col("test")))
    risk = F.when(F.col("pct_diff") > 10, "High").when(F.col("pct_diff") > 5, "Medium").otherwise("Low")
    return compared.withColumn("risk", risk)


def comparison_table(tall: DataFrame, method: str, process: str) -> DataFrame:
    """The published layout: Model, Metric, Train, Test, Difference, pct_diff, Method, Process."""
    return train_test_table(tall, ["model"]).select(
        F.col("model").alias("Model"),
        F.upper("metric").alias("Metric"),
        F.col("train").alias("Train"),
        F.col("test").alias("Test"),
        F.col("diff").alias("Difference"),
        "pct_diff",
        F.lit(method).alias("Method"),
        F.lit(process).alias("Process"),
    )


def stack_results(parts: list[DataFrame]) -> DataFrame:
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def leaderboard(wide: DataFrame, metric: str = "roc_auc", ties: tuple[str, ...] = ("model",)) -> DataFrame:
    """Results by metric, best first; ``pos`` numbers them. The table holds one row per result."""
    best_first = Window.partitionBy().orderBy(F.desc(metric), *ties)
    return wide.withColumn("pos", F.row_number().over(best_first)).orderBy("pos")


def best_result(wide: DataFrame, metric: str = "roc_auc", ties: tuple[str, ...] = ("model",)) -> DataFrame:
    """The first row with the largest metric."""
    return wide.orderBy(F.desc(metric), *ties).limit(1)


def metric_pivot(tall: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """One row per key, one column per (metric, split)."""
    cell = F.concat_ws("_", F.col("metric"), F.col(split))
    names = [f"{m}_{s}" for m in METRICS for s in ("train", "test")]
    return tall.withColumn("cell", cell).groupBy(*keys).pivot("cell", names).agg(F.first("value"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (2 n_c) of each class and the ratio n0 / n1 (1 without positives)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # one row per class
    n, n1 = F.sum("n").over(every), F.sum(F.when(F.col("class") == 1, F.col("n")).otherwise(0)).over(every)
    return counts.select(
        "class",
        "n",
        (n / (2 * F.col("n"))).alias("balanced_weight"),
        F.when(n1 > 0, (n - n1) / n1).otherwise(1.0).alias("scale_pos_weight"),
    )
