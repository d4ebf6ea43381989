"""Data-quality profile of a table and the rules that gate a load."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moralens.functions.quantiles import exact_quantiles
from moralens.operators.columns import classify, frequencies, long_values, numeric_summary

# Fixed value: the reason shown beside an exempt field.
EXEMPT_REASON = "Campo identificado como ID o campo exento de análisis"
HIGH_MISSING_PCT = 50


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and rows beyond the first copy; one shuffle of the grouped rows."""
    distinct_rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("bigint") for c in df.columns])
    totals = distinct_rows.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("_copies") * nulls), F.lit(0)).alias("total_missing"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("total_duplicates"),
    )
    cells = F.col("total_rows") * len(df.columns)
    return totals.select(
        "total_rows",
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        "total_missing",
        "total_duplicates",
        F.when(cells > 0, F.col("total_missing") / cells * 100).otherwise(0.0).alias("pct_missing"),
    )


def column_quality(df: DataFrame) -> DataFrame:
    """Missing cells, distinct non-null values and constancy of every column, in one job."""
    return column_quality_of(frequencies(df, df.columns))


def column_quality_of(freq: DataFrame) -> DataFrame:
    """Column quality from an existing frequency table."""
    per_column = freq.groupBy("column").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count("value").alias("unique_values"),
    )
    return per_column.select(
        "column",
        "missing",
        F.round(F.col("missing") / F.col("total") * 100, 2).alias("pct_missing"),
        "unique_values",
        (F.col("unique_values") <= 1).alias("is_constant"),
    )


def numeric_profile(df: DataFrame, exempt: list[str] | None = None) -> DataFrame:
    """Moments, extremes, quartiles and sign checks of each numeric column."""
    columns = classify(df.schema, exempt).numeric
    quartiles = (
        exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        .groupBy("column")
        .agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(q) for p, q in QUARTILES])
    )
    summary = numeric_summary(df, columns)
    return summary.join(quartiles, "column", "left").select(
        "column", "mean", "std", "min", "q25", "q50", "q75", "max", "has_negatives", "has_zeros", "has_inf"
    )


QUARTILES = [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")]
summary_statistics = numeric_profile


def exempt_profile(df: DataFrame, exempt: list[str], row_id: str, sample: int = 5) -> DataFrame:
    """Distinct count and the first non-null values, by row id, of each exempt field."""
    columns = [c for c in exempt if c in df.columns and c != row_id]
    # a top-k per column keeps k rows per task; ranking all values would sort them
    first = [
        df.where(F.col(c).isNotNull())
        .orderBy(row_id)
        .limit(sample)
        .select(F.lit(c).alias("column"), F.col(row_id).alias("at"), F.col(c).cast("string").alias("value"))
        for c in columns
    ]
    heads = (
        reduce(lambda a, b: a.unionByName(b), first)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("head"))
        .select("column", F.array_join(F.col("head.value"), ", ").alias("sample_values"))
    )
    distinct = frequencies(df, columns).groupBy("column").agg(F.count("value").alias("unique_values"))
    return distinct.join(heads, "column", "left").select(
        "column",
        F.lit(True).alias("is_exempt"),
        F.lit(EXEMPT_REASON).alias("exempt_reason"),
        "unique_values",
        "sample_values",
    )


def top_values(freq: DataFrame, k: int) -> DataFrame:
    """The k most frequent non-null values per column, ties by value, with their share in percent."""
    present = freq.where(F.col("value").isNotNull())
    totals = present.groupBy("column").agg(F.sum("n").alias("total"))
    by_count = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    top = present.withColumn("pos", F.row_number().over(by_count)).where(F.col("pos") <= k)
    return top.join(totals, "column").select(
        "column", "pos", "value", "n", (F.col("n") / F.col("total") * 100).alias("pct")
    )


def categorical_profile(df: DataFrame, exempt: list[str] | None = None, k: int = 5) -> DataFrame:
    return top_values(frequencies(df, classify(df.schema, exempt).categorical), k)


def date_profile(df: DataFrame, exempt: list[str] | None = None) -> DataFrame:
    """First and last instant and the whole days between them, per date column."""
    columns = classify(df.schema, exempt).date
    long = long_values(df, columns, [], "timestamp_ntz")
    ends = long.groupBy("column").agg(F.min("value").alias("first"), F.max("value").alias("last"))
    return ends.select(
        "column",
        F.col("first").cast("string").alias("min_date"),
        F.col("last").cast("string").alias("max_date"),
        F.timestamp_diff("DAY", "first", "last").alias("time_span"),
    )


def missing_top(quality: DataFrame, n: int) -> DataFrame:
    """The n columns with the largest missing share."""
    return (
        quality.where(F.col("missing") > 0)
        .orderBy(F.desc("pct_missing"), "column")
        .limit(n)
        .select("column", "missing", "pct_missing")
    )


def quality_rules(df: DataFrame, target: str = "pago") -> DataFrame:
    """``severity, rule, column, value`` for every rule that fires."""
    return rules_of(column_quality(df), table_profile(df), target, target in df.columns)


def rules_of(quality: DataFrame, profile: DataFrame, target: str, has_target: bool) -> DataFrame:
    is_target = F.col("column") == target
    rows = profile.select("total_rows", "total_duplicates")
    finding = lambda severity, rule, column, value: F.when(
        value.isNotNull(),
        F.struct(
            F.lit(severity).alias("severity"),
            F.lit(rule).alias("rule"),
            column.alias("column"),
            value.cast("double").alias("value"),
        ),
    )
    only = lambda condition, value: F.when(condition, value)
    column = F.col("column")
    per_column = quality.select(
        F.explode(
            F.array(
                finding("warning", "constant_column", column, only(F.col("is_constant") & ~is_target, F.col("unique_values"))),
                finding("warning", "high_missing", column, only(F.col("pct_missing") > HIGH_MISSING_PCT, F.col("pct_missing"))),
                finding("warning", "empty_column", column, only((F.col("unique_values") == 0) & (F.col("missing") > 0), F.col("missing"))),
                finding("error", "target_constant", column, only(is_target & F.col("is_constant"), F.col("unique_values"))),
                finding("warning", "target_missing_values", column, only(is_target & (F.col("missing") > 0), F.col("missing"))),
            )
        ).alias("f")
    )
    whole = [
        finding("warning", "duplicate_rows", F.lit(None).cast("string"), only(F.col("total_duplicates") > 0, F.col("total_duplicates")))
    ]
    if not has_target:
        whole.append(finding("error", "target_absent", F.lit(target), F.lit(0)))
    per_table = rows.select(F.explode(F.array(*whole)).alias("f"))
    return per_column.unionByName(per_table).where(F.col("f").isNotNull()).select("f.*")
