"""One-hot encoding of categories without a column per category.

The dictionary is a table: every (column, value) with its number, in order of the columns, then of the
values, found by distributed ranks. Rows meet it in a join that spreads hot values, and get one sparse
vector of all their categories; so a column may have millions of values. Values unseen in the fit have no entry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moralens.functions.joins import lookup
from moralens.functions.ranking import prefix_counts
from moralens.operators.columns import frequencies, long_values, require_columns, small_table
from moralens.operators.preparation import MISSING
from moralens.staging import stage

#: The storage form of a sparse vector.
SPARSE = 0


@dataclass
class SparseCategories:
    """``dictionary``: column, value, pos (0 .. size - 1), n; ``size`` categories of ``columns`` in all."""

    dictionary: DataFrame
    columns: list[str]
    size: int
    fill: str = MISSING

    def names(self) -> DataFrame:
        """pos and the name of its category; names repeat if a column's name runs into a value, positions never do."""
        return self.dictionary.select("pos", F.concat_ws("_", "column", "value").alias("name"))

    def transform(self, df: DataFrame, row_id: str, output: str = "categories") -> DataFrame:
        """``row_id`` and the vector of every row; NULL counts as the fill label. Row ids must be unique."""
        require_columns(df, [row_id, *self.columns])
        labels = long_values(df, self.columns, [row_id], "string").select(row_id, "column", F.coalesce("value", F.lit(self.fill)).alias("value"))
        met = lookup(labels, self.dictionary, ["column", "value"], "n")
        found = met.groupBy(row_id).agg(F.array_sort(F.collect_list(F.col("pos").cast("int"))).alias("indices"))
        every = df.select(row_id).join(found, row_id, "left").withColumn("indices", F.coalesce("indices", F.array().cast("array<int>")))
        parts = F.struct(
            F.lit(SPARSE).cast("tinyint").alias("type"),
            F.lit(self.size).alias("size"),
            F.col("indices"),
            F.transform("indices", lambda _: F.lit(1.0)).alias("values"),
        )
        staged = stage(every.select(row_id, parts.alias(output)), "sparse")
        # a vector is stored as this struct: the same files, read as vectors
        schema = T.StructType([staged.schema[row_id], T.StructField(output, VectorUDT())])
        return df.sparkSession.read.schema(schema).parquet(*staged.inputFiles()) if staged.inputFiles() else df.sparkSession.createDataFrame([], schema)


def fit_categories(df: DataFrame, columns: list[str], fill: str = MISSING) -> SparseCategories:
    """Number the categories of some columns; NULL is the category ``fill``."""
    require_columns(df, columns)
    counted = frequencies(df, columns).withColumn("value", F.coalesce("value", F.lit(fill)))
    counted = counted.groupBy("column", "value").agg(F.sum("n").alias("n"), F.lit(1).alias("one"))
    ranked = stage(prefix_counts(counted, ["column"], "value", ["one"]), "categories")
    sizes = {r["column"]: r["count"] for r in ranked.groupBy("column").count().collect()}
    offsets, size = [], 0
    for c in columns:
        offsets.append((c, size))
        size += sizes.get(c, 0)
    before = small_table(df.sparkSession, offsets, "column string, before bigint")
    placed = ranked.join(before, "column").select("column", "value", (F.col("before") + F.col("cum_one") - 1).alias("pos"), "n")
    return SparseCategories(stage(placed, "categories"), list(columns), size, fill)
