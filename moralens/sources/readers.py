"""Reading a table through the quality gate."""

from __future__ import annotations

import difflib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from moralens.operators.cleaning import nan_to_null
from moralens.operators.columns import classify
from moralens.operators.quality import (
    categorical_profile,
    column_quality,
    date_profile,
    exempt_profile,
    numeric_profile,
    rules_of,
    table_profile,
)
from moralens.sources.sinks import write_json
from moralens.staging import stage

FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json"}
NAME_SIMILARITY = 0.8
NAME_HINTS = 5


@dataclass
class Loaded:
    """The table with its quality tables: one row overall, one per column, one per finding."""

    data: DataFrame
    profile: DataFrame
    columns: DataFrame
    findings: DataFrame
    exempt_fields: tuple[str, ...] = ()
    row_id: str = "row_id"

    def statistics(self) -> dict[str, DataFrame]:
        """Statistics of the columns by kind; exempt fields are only counted and sampled."""
        return column_statistics(self.data, list(self.exempt_fields), self.row_id)


def column_statistics(df: DataFrame, exempt_fields: list[str] | None = None, row_id: str = "row_id") -> dict[str, DataFrame]:
    """``numeric``, ``categorical``, ``dates`` and ``exempt`` profiles of a table; kinds without columns are left out."""
    exempt = [c for c in exempt_fields or [] if c in df.columns]
    classes = classify(df.schema, [*exempt, row_id])
    found = {}
    if classes.numeric:
        found["numeric"] = numeric_profile(df, [*exempt, row_id])
    if classes.categorical:
        found["categorical"] = categorical_profile(df, [*exempt, row_id])
    if classes.date:
        found["dates"] = date_profile(df, [*exempt, row_id])
    if exempt and row_id in df.columns:
        found["exempt"] = exempt_profile(df, exempt, row_id)
    return found


def check_path(spark: SparkSession, path: str, max_bytes: int | None = None) -> str:
    """Raise unless the path exists, has a known extension and holds bytes; returns the format."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        raise FileNotFoundError(f"no such file or folder: {path}")
    trimmed = path.rstrip("/").lower()
    found = [fmt for suffix, fmt in FORMATS.items() if trimmed.endswith(suffix)]
    if not found:
        raise ValueError(f"unknown extension of {path}: use one of {', '.join(FORMATS)}")
    size = files.getContentSummary(target).getLength()
    if size == 0:
        raise ValueError(f"{path} is empty")
    if max_bytes is not None and size > max_bytes:
        raise ValueError(f"{path} has {size} bytes, more than the limit of {max_bytes}")
    return found[0]


def check_names(names: list[str]) -> None:
    """Raise if two names are equal once trimmed and lower-cased; the names themselves stay as they are."""
    clean = [n.strip().lower() for n in names]
    repeated = sorted({n for n in clean if clean.count(n) > 1})
    if repeated:
        raise ValueError(f"column names collide after normalisation: {repeated}")


def similar_names(names: list[str], target: str) -> list[str]:
    return difflib.get_close_matches(target.lower(), [n.lower() for n in names], NAME_HINTS, NAME_SIMILARITY)


def validate_dataframe(df: DataFrame, target: str = "pago") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table profile, column quality, findings) of any table."""
    if not isinstance(df, DataFrame):
        raise TypeError("expected a Spark DataFrame")
    columns = stage(column_quality(df), "column-quality")
    profile = stage(table_profile(df), "table-profile")
    return profile, columns, rules_of(columns, profile, target, target in df.columns)


def load_data(
    spark: SparkSession,
    path: str,
    exempt_fields: list[str] | None = None,
    schema: T.StructType | None = None,
    target: str = "pago",
    row_id: str = "row_id",
    max_bytes: int | None = None,
    report_path: str | None = None,
) -> Loaded:
    """Read a table, check names and content, and raise if a rule of severity ``error`` fires.

    A report has the table's profile, the columns' quality, the findings and the columns' statistics, those
    of ``exempt_fields`` apart.
    """
    kind = check_path(spark, path, max_bytes)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    df = nan_to_null(reader.format(kind).load(path))
    if df.isEmpty():
        raise ValueError(f"{path} holds no rows")
    check_names(df.columns)
    if target not in df.columns:
        hints = similar_names(df.columns, target)
        raise ValueError(f"no column '{target}'" + (f"; similar: {', '.join(hints)}" if hints else ""))
    content = df.drop(row_id)
    profile, columns, findings = validate_dataframe(content, target)
    if report_path:
        write_json(profile, f"{report_path}/profile")
        write_json(columns, f"{report_path}/columns")
        write_json(findings, f"{report_path}/findings")
        for name, table in column_statistics(df, exempt_fields, row_id).items():
            write_json(table, f"{report_path}/{name}")
    errors = findings.where("severity = 'error'").collect()
    if errors:
        raise ValueError("quality errors: " + "; ".join(f"{e['rule']} ({e['column']})" for e in errors))
    return Loaded(df, profile, columns, findings, tuple(exempt_fields or ()), row_id)
