"""Column classes of a table and the long form of its values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL_TABLE_ROWS = 100_000


@dataclass(frozen=True)
class ColumnClasses:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    date: list[str] = field(default_factory=list)
    exempt: list[str] = field(default_factory=list)


def classify(schema: T.StructType, exempt: list[str] | None = None) -> ColumnClasses:
    """Sort column names by type class, in schema order; exempt names absent from the table are ignored."""
    skip = set(exempt or [])
    numeric, categorical, date, kept = [], [], [], []
    for column in schema.fields:
        if column.name in skip:
            kept.append(column.name)
        elif isinstance(column.dataType, T.NumericType):
            numeric.append(column.name)
        elif isinstance(column.dataType, (T.StringType, T.BooleanType)):
            categorical.append(column.name)
        elif isinstance(column.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            date.append(column.name)
    return ColumnClasses(numeric, categorical, date, kept)


def quoted(name: str) -> str:
    """A column name as Spark reads it whole, whatever dots or backticks it has."""
    return "`" + name.replace("`", "``") + "`"


def select_classes(
    df: DataFrame, kinds: tuple[str, ...] = ("numeric",), exempt: list[str] | None = None
) -> DataFrame:
    """Keep the columns of the given classes, without exempt fields, in schema order."""
    classes = classify(df.schema, exempt)
    wanted = {name for kind in kinds for name in getattr(classes, kind)}
    return df.select(*[quoted(c) for c in df.columns if c in wanted])


def long_values(df: DataFrame, columns: list[str], ids: list[str], as_type: str) -> DataFrame:
    """One row per (row, column): ``ids``, ``column``, ``value``."""
    typed = df.select(*ids, *[F.col(quoted(c)).cast(as_type).alias(f"v_{c}") for c in columns])
    long = typed.unpivot(ids, [quoted(f"v_{c}") for c in columns], "column", "value")
    return long.withColumn("column", F.substring("column", 3, 1000))


def frequencies(
    df: DataFrame, columns: list[str], by: list[str] | None = None, as_type: str = "string"
) -> DataFrame:
    """Counts per (column, by, value), NULL included. Hot values combine before the shuffle."""
    keys = list(by or [])
    return long_values(df, columns, keys, as_type).groupBy("column", *keys, "value").agg(F.count(F.lit(1)).alias("n"))


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Broadcast table of summary figures the driver already holds; its size is checked here."""
    if len(rows) > SMALL_TABLE_ROWS:
        raise ValueError(f"{len(rows)} summary rows are too many to broadcast")
    return F.broadcast(spark.createDataFrame(rows, schema))


def numeric_summary(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """``[by], column, n, mean, std, min, max`` and sign checks, one row per column (and class).

    The long form keeps the generated code small however many columns there are; every task sends on
    one partial row per column.
    """
    keys = [by] if by else []
    source = df.where(F.col(by).isNotNull()) if by else df
    value = F.col("value")
    found = lambda condition: F.coalesce(F.bool_or(condition), F.lit(False))
    return (
        long_values(source, columns, keys, "double")
        .groupBy(*keys, "column")
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            found(value < 0).alias("has_negatives"),
            found(value == 0).alias("has_zeros"),
            found(F.abs(value) == float("inf")).alias("has_inf"),
        )
    )


def correlation(x: Column, y: Column) -> Column:
    """Pearson r over the rows where both are present; NULL if either does not vary there."""
    a, b = x.cast("double"), y.cast("double")
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.when(spread > 0, F.covar_pop(a, b) / spread)


def binary_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Numeric columns with exactly two distinct values, found by two scans and no shuffle of values."""
    if not columns:
        return []
    ends = df.agg(
        *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]
    ).first()
    spread = [c for c in columns if ends[f"lo_{c}"] is not None and ends[f"lo_{c}"] != ends[f"hi_{c}"]]
    if not spread:
        return []
    only_ends = df.agg(
        *[F.bool_and(F.col(c).isin(ends[f"lo_{c}"], ends[f"hi_{c}"])).alias(c) for c in spread]
    ).first()
    return [c for c in spread if only_ends[c]]


def classes_of(df: DataFrame, target: str) -> list:
    """Sorted distinct non-null values of the target."""
    found = df.select(target).where(F.col(target).isNotNull()).distinct().limit(SMALL_TABLE_ROWS + 1).collect()
    if len(found) > SMALL_TABLE_ROWS:
        raise ValueError(f"'{target}' has too many distinct values to be a class label")
    return sorted(row[0] for row in found)


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
