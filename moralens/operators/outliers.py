"""Outlier rows, outlier counts and box statistics of numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moralens.functions.quantiles import is_finite, quantile_values
from moralens.operators.columns import classes_of, classify, long_values, numeric_summary, small_table

QUARTILES = [0.25, 0.5, 0.75]


def outlier_bounds(
    df: DataFrame,
    columns: list[str],
    method: str = "iqr",
    threshold: float = 1.5,
    quartiles: dict[tuple, float] | None = None,
) -> dict[str, tuple[float, float]]:
    """Inclusive (low, high) range of ordinary values per column; two scalars each.

    ``quartiles`` by (column, probability) are found here unless they are known.
    """
    if method.lower() == "iqr":
        if quartiles is None:
            quartiles = quantile_values(df, columns, [0.25, 0.75])
        bounds = {}
        for c in columns:
            if (c, 0.25) in quartiles:
                q1, q3 = quartiles[c, 0.25], quartiles[c, 0.75]
                bounds[c] = (q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))
        return bounds
    if method.lower() == "zscore":
        rows = numeric_summary(df, columns).collect()
        usable = [r for r in rows if is_finite(r["std"]) and r["std"] > 0]
        return {
            r["column"]: (r["mean"] - threshold * r["std"], r["mean"] + threshold * r["std"]) for r in usable
        }
    raise ValueError(f"unknown outlier method '{method}': use 'iqr' or 'zscore'")


def _outside(c: str, bounds: dict[str, tuple[float, float]]):
    low, high = bounds[c]
    return (F.col(c) < low) | (F.col(c) > high)


def outlier_rows(
    df: DataFrame,
    row_id: str,
    exempt: list[str] | None = None,
    method: str = "iqr",
    threshold: float = 1.5,
) -> DataFrame:
    """``column, row_id`` of every outlying cell: one scan against literal bounds, no join."""
    columns = [c for c in classify(df.schema, exempt).numeric if c != row_id]
    bounds = outlier_bounds(df, columns, method, threshold)
    hits = F.array(*[F.when(_outside(c, bounds), F.lit(c)) for c in bounds])
    return df.select(F.explode(hits).alias("column"), row_id).where(F.col("column").isNotNull())


def outlier_counts(
    df: DataFrame,
    exempt: list[str] | None = None,
    method: str = "iqr",
    threshold: float = 1.5,
    quartiles: dict[tuple, float] | None = None,
) -> DataFrame:
    """Outlying cells and their share of the non-null cells per column."""
    columns = classify(df.schema, exempt).numeric
    bounds = outlier_bounds(df, columns, method, threshold, quartiles)
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(_outside(c, bounds)).alias("outliers"),
            F.count(c).alias("present"),
        ).alias(c)
        for c in bounds
    ]
    tall = df.agg(*stats).select(F.explode(F.array(*bounds)).alias("s")).select("s.*")
    return tall.select(
        "column", "outliers", (F.col("outliers") / F.col("present") * 100).alias("pct_outliers")
    )


def without_outliers(
    df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5
) -> DataFrame:
    """Rows whose ``column`` is ordinary or missing."""
    bounds = outlier_bounds(df, [column], method, threshold)
    if column not in bounds:
        return df
    return df.where(~F.coalesce(_outside(column, bounds), F.lit(False)))


def box_statistics(
    df: DataFrame, columns: list[str], by: str | None = None, quartiles: dict[tuple, float] | None = None
) -> DataFrame:
    """Quartiles, whisker ends and fliers per column, per class of ``by`` if given.

    ``quartiles`` by ([class,] column, probability) are found here unless they are known.
    """
    spark = df.sparkSession
    if quartiles is None:
        quartiles = quantile_values(df, columns, QUARTILES, by)
    groups = classes_of(df, by) if by else [0]
    rows = []
    for g in groups:
        for c in columns:
            key = (g, c) if by else (c,)
            if (*key, 0.5) in quartiles:
                q1, q2, q3 = (quartiles[(*key, p)] for p in QUARTILES)
                rows.append((g, c, q1, q2, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))
    group_type = dict(df.dtypes)[by] if by else "int"
    boxes = small_table(
        spark,
        rows,
        f"g {group_type}, k string, q1 double, median double, q3 double, low double, high double",
    )
    source = df.withColumn("grp", F.col(by) if by else F.lit(0))
    values = long_values(source, columns, ["grp"], "double").where(F.col("value").isNotNull())
    boxed = values.join(boxes, (F.col("grp") == F.col("g")) & (F.col("column") == F.col("k")))
    ordinary = F.col("value").between(F.col("low"), F.col("high"))
    stats = boxed.groupBy("g", "column", "q1", "median", "q3").agg(
        F.min(F.when(ordinary, F.col("value"))).alias("whisker_low"),
        F.max(F.when(ordinary, F.col("value"))).alias("whisker_high"),
        F.count_if(~ordinary).alias("fliers"),
    )
    return stats.select(
        "column", *([F.col("g").alias(by)] if by else []), "q1", "median", "q3", "whisker_low", "whisker_high", "fliers"
    )
