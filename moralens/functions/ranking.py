"""Exact ranks and cumulative counts without a single-task window.

A global ``OVER (ORDER BY v)`` puts all rows in one task. Here the rows are range-partitioned into
buckets: totals per bucket give each bucket's offset, and the window only runs inside a bucket.
Where the ranges are cut decides the balance, never the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moralens.staging import row_count, stage

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 10_000


def bucketed_prefix(
    df: DataFrame, groups: list[str], bucket: str, order: str | Column, weights: list[str]
) -> DataFrame:
    """Add ``cum_<w>``: the inclusive running sum of each weight in (bucket, order) inside each group.

    ``bucket`` must not decrease along ``order``. Group columns must not be NULL.
    """
    keys = [bucket, *groups]
    ahead = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys)
        .agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
        .select(*keys, *[F.coalesce(F.sum(f"_t_{w}").over(ahead), F.lit(0)).alias(f"_o_{w}") for w in weights])
    )
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = df.select("*", *[F.sum(w).over(inside).alias(f"_r_{w}") for w in weights])
    joined = running.join(offsets, keys)
    return joined.select(*df.columns, *[(F.col(f"_r_{w}") + F.col(f"_o_{w}")).alias(f"cum_{w}") for w in weights])


def prefix_counts(
    reduced: DataFrame,
    groups: list[str],
    value: str,
    weights: list[str],
    descending: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Running sums of ``weights`` along ``value`` in each group, over one row per (group, value).

    The input should be reduced already (``groupBy(group, value)``), so a hot value is a single row.
    """
    along = F.desc(value) if descending else F.asc(value)
    staged = stage(reduced.where(F.col(value).isNotNull()), "ranked")
    n_rows = row_count(staged)
    if n_rows <= rows_per_bucket:
        # one bucket holds it all: no offsets to add
        upto = Window.partitionBy(*groups).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
        return staged.select("*", *[F.sum(w).over(upto).alias(f"cum_{w}") for w in weights])
    n_buckets = min(MAX_BUCKETS, math.ceil(4 * n_rows / rows_per_bucket))
    ranged = staged.repartitionByRange(n_buckets, *groups, along)
    # written out, so that totals and running sums see the same cut of the ranges
    bucketed = stage(ranged.withColumn("_bucket", F.spark_partition_id()), "buckets")
    return bucketed_prefix(bucketed, groups, "_bucket", along, weights).drop("_bucket")
