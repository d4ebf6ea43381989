"""Row and value clean-up before modelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Gender codes that mean the same.
GENDER_CODES = {"genero": {"HOMBRE": "M", "MUJER": "F", " ": None}}


def nan_to_null(df: DataFrame) -> DataFrame:
    """One kind of missing value: NaN in floating columns becomes NULL; infinities stay."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if c in floating else F.col(c) for c in df.columns])


def recategorize(df: DataFrame, mapping: dict[str, dict[str, str | None]] | None = None) -> DataFrame:
    """Replace category values; a value mapped to None becomes NULL."""
    changed = {}
    for column, codes in (mapping or GENDER_CODES).items():
        chain = F
        for old, new in codes.items():
            chain = chain.when(F.col(column) == old, F.lit(new))
        changed[column] = chain.otherwise(F.col(column))
    return df.withColumns(changed)


def drop_duplicates(df: DataFrame, row_id: str, columns: list[str] | None = None) -> DataFrame:
    """One row per distinct content, the one with the smallest row id.

    Content columns are the grouping key, so the id is the only aggregate and copies combine map-side.
    """
    content = columns or [c for c in df.columns if c != row_id]
    rest = [c for c in df.columns if c not in content and c != row_id]
    kept = df.groupBy(*content).agg(
        F.min(row_id).alias(row_id), *[F.min_by(c, row_id).alias(c) for c in rest]
    )
    return kept.select(*df.columns)


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)
