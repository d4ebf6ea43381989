"""Random but repeatable cuts of the rows of each class: train/test split, folds, under-sampling.

The k-th row in hash order of a class is found by counting hashes per leading digits and ranking
only inside the one group where the cut falls. What comes back is one threshold per class and cut,
so the assignment itself is a filter on the scan: no row is shuffled or sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moralens.functions.hashing import digest
from moralens.operators.columns import small_table
from moralens.staging import stage

PREFIX_DIGITS = 4


def class_sizes(df: DataFrame, label: str) -> dict:
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r[label]: r["n"] for r in sorted(counts, key=lambda r: r[label])}


def hash_order(seed: int | str, row_id: str) -> Column:
    """Total random order of the rows: digest first, row id to settle equal digests."""
    return F.struct(digest(seed, F.col(row_id)).alias("h"), F.col(row_id).cast("bigint").alias("id"))


def _keyed(df: DataFrame, row_id: str, label: str, seed: int | str) -> DataFrame:
    shown = df.where(F.col(label).isNotNull()).select(
        F.col(label).alias("label"), digest(seed, F.col(row_id)).alias("h"), F.col(row_id).cast("bigint").alias("id")
    )
    return shown.withColumn("prefix", F.substring("h", 1, PREFIX_DIGITS))


def _prefix_counts(keyed: DataFrame) -> DataFrame:
    """Rows per class and leading hash digits: at most 16^4 rows per class."""
    return stage(keyed.groupBy("label", "prefix").agg(F.count(F.lit(1)).alias("n")), "hash-prefixes")


def cut_points(keyed: DataFrame, counts: DataFrame, wanted: dict) -> dict:
    """For each class the (digest, row id) of the rows at the 1-based hash ranks ``wanted[class]``."""
    ranks = small_table(
        keyed.sparkSession,
        [(c, int(r)) for c, ranks in wanted.items() for r in sorted(set(ranks)) if r > 0],
        f"c {dict(keyed.dtypes)['label']}, rank bigint",
    )
    before = Window.partitionBy("label").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    holding = offsets.join(
        ranks,
        (F.col("label") == F.col("c")) & (F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("n")),
    ).select("label", "prefix", "before")
    inside = keyed.join(F.broadcast(holding.distinct()), ["label", "prefix"])
    within = Window.partitionBy("label", "prefix").orderBy("h", "id")
    ranked = inside.withColumn("place", F.col("before") + F.row_number().over(within))
    found = ranked.join(ranks, (F.col("label") == F.col("c")) & (F.col("rank") == F.col("place")), "left_semi")
    return {(r["label"], r["place"]): (r["h"], r["id"]) for r in found.select("label", "place", "h", "id").collect()}


def _at_or_before(order: Column, point: tuple[str, int]) -> Column:
    return order <= F.struct(F.lit(point[0]).alias("h"), F.lit(point[1]).cast("bigint").alias("id"))


def assign_parts(
    df: DataFrame,
    row_id: str,
    label: str,
    seed: int | str,
    boundaries: Callable[[int], list[int]],
    name: str = "part",
) -> DataFrame:
    """Add ``name``: how many of the class's boundary ranks lie before the row's hash rank.

    ``boundaries(class size)`` lists increasing ranks; a row at rank r gets the number of boundaries < r.
    """
    keyed = _keyed(df, row_id, label, seed)
    counts = _prefix_counts(keyed)
    sizes = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    wanted = {c: boundaries(sizes[c]) for c in sorted(sizes)}
    points = cut_points(keyed, counts, wanted)
    order = hash_order(seed, row_id)
    part = F.lit(None).cast("int")
    for c, ranks in wanted.items():
        passed = [F.lit(1) if r <= 0 else F.when(_at_or_before(order, points[c, r]), 0).otherwise(1) for r in ranks]
        part = F.when(F.col(label) == c, sum(passed[1:], passed[0])).otherwise(part)
    return df.withColumn(name, part)


def mark_test(df: DataFrame, row_id: str, label: str, test_size: float = 0.2, seed: int | str = 42) -> DataFrame:
    """Add ``is_test``: within each class the first round(test_size * n) rows in hash order."""
    share = lambda n: [int(n * test_size + 0.5)]
    return assign_parts(df, row_id, label, seed, share, "_part").withColumn("is_test", F.col("_part") == 0).drop("_part")


def split_data(
    df: DataFrame, row_id: str, label: str, test_size: float = 0.2, seed: int | str = 42
) -> tuple[DataFrame, DataFrame]:
    """Stratified (train, test); both are filters over the input."""
    marked = mark_test(df, row_id, label, test_size, seed)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def add_folds(df: DataFrame, row_id: str, label: str, k: int = 5, seed: int | str = 42, name: str = "fold") -> DataFrame:
    """Add a stratified fold number 0 .. k-1: floor(k * (hash rank - 1) / class size)."""
    ends = lambda n: [-(-n * f // k) for f in range(1, k)]
    return assign_parts(df, row_id, label, seed, ends, name)
