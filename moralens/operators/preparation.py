"""Imputation with flags, population scaling and one-hot columns, fitted on one table and applied to any.

The fitted state is a handful of scalars per column, kept as JSON parameters, so models save and load
like any other Spark ML stage and every transform is a plain projection.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moralens.functions.quantiles import quantile_values
from moralens.operators.columns import classify, frequencies, long_values, require_columns
from moralens.operators.quality import top_values

MISSING = "missing"
MAX_CATEGORIES = 10_000


class _Columns(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to transform", TypeConverters.toListString)

    def _columns(self) -> list[str]:
        return self.getOrDefault(self.inputCols)


def flag(column: str) -> Column:
    return F.col(column).isNull().cast("int")


class NumericImputerWithFlag(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fill numeric gaps with the median, mean or mode, flag them, optionally scale by the population std."""

    strategy = Param(Params._dummy(), "strategy", "median, mean or most_frequent", TypeConverters.toString)
    scale = Param(Params._dummy(), "scale", "standardise after filling", TypeConverters.toBoolean)
    scaleFlags = Param(Params._dummy(), "scaleFlags", "standardise the flags too", TypeConverters.toBoolean)

    @keyword_only
    def __init__(
        self,
        *,
        inputCols: list[str] | None = None,
        strategy: str = "median",
        scale: bool = False,
        scaleFlags: bool = False,
    ):
        super().__init__()
        self._setDefault(strategy="median", scale=False, scaleFlags=False)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "NumericImputerModel":
        columns = self._columns()
        require_columns(dataset, columns)
        fills = fill_values(dataset, columns, self.getOrDefault(self.strategy))
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(fills[c])) for c in columns}
        state = {c: [fills[c], 0.0, 1.0, 0.0, 1.0] for c in columns}
        if self.getOrDefault(self.scale):
            moments = dataset.agg(
                *[F.avg(filled[c]).alias(f"m_{c}") for c in columns],
                *[F.stddev_pop(filled[c]).alias(f"s_{c}") for c in columns],
                *[F.avg(flag(c)).alias(f"g_{c}") for c in columns],
            ).first()
            for c in columns:
                gaps = moments[f"g_{c}"] if self.getOrDefault(self.scaleFlags) else None
                spread = (gaps * (1 - gaps)) ** 0.5 if gaps is not None else 0.0
                state[c] = [fills[c], moments[f"m_{c}"], moments[f"s_{c}"] or 1.0, gaps or 0.0, spread or 1.0]
        return NumericImputerModel(inputCols=columns, state=json.dumps(state), scaled=self.getOrDefault(self.scale))


class NumericImputerModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``{c}_scaled`` (or ``{c}_imputed``) and ``{c}_flag``."""

    state = Param(Params._dummy(), "state", "fill, mean and std of values and flags per column as JSON", TypeConverters.toString)
    scaled = Param(Params._dummy(), "scaled", "whether values are standardised", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, state: str = "{}", scaled: bool = False):
        super().__init__()
        self._setDefault(state="{}", scaled=False)
        self._set(**self._input_kwargs)

    def output_columns(self) -> list[str]:
        suffix = "scaled" if self.getOrDefault(self.scaled) else "imputed"
        return [name for c in self._columns() for name in (f"{c}_{suffix}", f"{c}_flag")]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        state = json.loads(self.getOrDefault(self.state))
        added = {}
        for c in self._columns():
            fill, mean, std, flag_mean, flag_std = state[c]
            value = F.coalesce(F.col(c).cast("double"), F.lit(fill))
            if self.getOrDefault(self.scaled):
                added[f"{c}_scaled"] = (value - F.lit(mean)) / F.lit(std)
            else:
                added[f"{c}_imputed"] = value
            plain = (flag_mean, flag_std) == (0.0, 1.0)
            added[f"{c}_flag"] = flag(c) if plain else (flag(c) - F.lit(flag_mean)) / F.lit(flag_std)
        return dataset.withColumns(added)


class BinaryImputerWithFlag(Transformer, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``{c}_imputed`` (gaps become 0) and ``{c}_flag``."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def output_columns(self) -> list[str]:
        return [name for c in self._columns() for name in (f"{c}_imputed", f"{c}_flag")]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        require_columns(dataset, self._columns())
        added = {}
        for c in self._columns():
            added[f"{c}_imputed"] = F.coalesce(F.col(c), F.lit(0))
            added[f"{c}_flag"] = flag(c)
        return dataset.withColumns(added)


class CategoricalImputerWithFlag(Transformer, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``{c}_imputed`` (gaps become the fill value) and ``{c}_flag``."""

    fillValue = Param(Params._dummy(), "fillValue", "label of missing values", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, fillValue: str = MISSING):
        super().__init__()
        self._setDefault(fillValue=MISSING)
        self._set(**self._input_kwargs)

    def output_columns(self) -> list[str]:
        return [name for c in self._columns() for name in (f"{c}_imputed", f"{c}_flag")]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        require_columns(dataset, self._columns())
        added = {}
        for c in self._columns():
            added[f"{c}_imputed"] = F.coalesce(F.col(c).cast("string"), F.lit(self.getOrDefault(self.fillValue)))
            added[f"{c}_flag"] = flag(c)
        return dataset.withColumns(added)


class OneHotColumns(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fit the sorted categories of each column, the fill label included when it has gaps."""

    fillValue = Param(Params._dummy(), "fillValue", "label of missing values", TypeConverters.toString)
    encodeFlags = Param(Params._dummy(), "encodeFlags", "one column per state of the flag", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, fillValue: str = MISSING, encodeFlags: bool = False):
        super().__init__()
        self._setDefault(fillValue=MISSING, encodeFlags=False)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "OneHotColumnsModel":
        columns = self._columns()
        require_columns(dataset, columns)
        fill = self.getOrDefault(self.fillValue)
        labels = long_values(dataset, columns, [], "string").select(
            "column", F.coalesce("value", F.lit(fill)).alias("value")
        )
        # a column per category is part of the schema; more categories are for ``sparse_encoding``
        sizes = labels.groupBy("column").agg(F.count_distinct("value").alias("n")).collect()
        wide = sorted(r["column"] for r in sizes if r["n"] > MAX_CATEGORIES)
        if wide:
            raise ValueError(f"more than {MAX_CATEGORIES} categories in {wide}: encode them with sparse_encoding")
        found = labels.distinct().collect()
        state = {c: sorted(r["value"] for r in found if r["column"] == c) for c in columns}
        flags = {c: [] for c in columns}
        if self.getOrDefault(self.encodeFlags):
            gaps, total = missing_counts(dataset, columns)
            flags = {c: [s for s, n in ((0, total - gaps[c]), (1, gaps[c])) if n > 0] for c in columns}
        model = OneHotColumnsModel(inputCols=columns, state=json.dumps(state), flags=json.dumps(flags), fillValue=fill)
        names = Counter(n.lower() for n in model.output_columns())
        twice = sorted(n for n, k in names.items() if k > 1)
        if twice:
            raise ValueError(f"two categories would share the column names {twice[:5]}: rename the columns {columns}")
        return model


class OneHotColumnsModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``{c}_{category}`` 0/1 columns and ``{c}_flag``; unseen categories are all zeros."""

    state = Param(Params._dummy(), "state", "categories per column as JSON", TypeConverters.toString)
    flags = Param(Params._dummy(), "flags", "encoded flag states per column as JSON", TypeConverters.toString)
    fillValue = Param(Params._dummy(), "fillValue", "label of missing values", TypeConverters.toString)

    @keyword_only
    def __init__(
        self, *, inputCols: list[str] | None = None, state: str = "{}", flags: str = "{}", fillValue: str = MISSING
    ):
        super().__init__()
        self._setDefault(state="{}", flags="{}", fillValue=MISSING)
        self._set(**self._input_kwargs)

    def _flag_columns(self, column: str) -> dict[str, Column]:
        states = json.loads(self.getOrDefault(self.flags)).get(column, [])
        encoded = {f"{column}_flag_{s}": (flag(column) == s).cast("int") for s in states}
        return encoded or {f"{column}_flag": flag(column)}

    def output_columns(self) -> list[str]:
        state = json.loads(self.getOrDefault(self.state))
        return [n for c in self._columns() for n in (*[f"{c}_{v}" for v in state[c]], *self._flag_columns(c))]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        state = json.loads(self.getOrDefault(self.state))
        added = {}
        for c in self._columns():
            label = F.coalesce(F.col(c).cast("string"), F.lit(self.getOrDefault(self.fillValue)))
            for category in state[c]:
                added[f"{c}_{category}"] = (label == category).cast("int")
            added |= self._flag_columns(c)
        return dataset.withColumns(added)


def _as_list(columns: list[str] | str | None) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns or [])


def create_preprocessor(
    numeric: list[str] | str | None,
    binary: list[str] | str | None,
    categorical: list[str] | str | None,
    transform_flags: bool = False,
) -> Pipeline:
    """Unfitted pipeline: scaled numerics with flags, filled binaries with flags, one-hot categories with flags.

    ``transform_flags`` treats flags like the values beside them: numeric flags are scaled and
    categorical flags become one 0/1 column per state seen in the fit.
    """
    stages = []
    if _as_list(numeric):
        stages.append(
            NumericImputerWithFlag(
                inputCols=_as_list(numeric), strategy="median", scale=True, scaleFlags=transform_flags
            )
        )
    if _as_list(binary):
        stages.append(BinaryImputerWithFlag(inputCols=_as_list(binary)))
    if _as_list(categorical):
        stages.append(OneHotColumns(inputCols=_as_list(categorical), encodeFlags=transform_flags))
    if not stages:
        raise ValueError("no columns given to preprocess")
    return Pipeline(stages=stages)


def feature_names(fitted) -> list[str]:
    """Names of the columns a fitted preprocessor adds, in order."""
    return [name for stage in fitted.stages for name in stage.output_columns()]


def manual_preprocessing(
    train: DataFrame,
    test: DataFrame,
    numeric: list[str],
    binary: list[str],
    categorical: list[str],
    keep: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Fit on train, apply to both; returns the feature columns (plus ``keep``) and their names."""
    require_columns(train, [*numeric, *binary, *categorical])
    fitted = create_preprocessor(numeric, binary, categorical).fit(train)
    names = feature_names(fitted)
    shown = lambda df: fitted.transform(df).select(*keep, *[F.col(f"`{n}`") for n in names])
    return shown(train), shown(test), names


def imputation_flags(
    df: DataFrame, columns: list[str] | None = None, strategy: str = "indicator", suffix: str = "_imputed"
) -> tuple[DataFrame, DataFrame]:
    """Add a flag for each listed column with gaps; also returns what was flagged, one row per flag."""
    if strategy not in ("indicator", "missing_mask"):
        raise ValueError(f"unknown strategy '{strategy}': use 'indicator' or 'missing_mask'")
    gaps, total = missing_counts(df, columns)
    flags = {
        f"{c}{suffix}": flag(c) if strategy == "indicator" else F.col(c).isNull() for c, n in gaps.items() if n > 0
    }
    kind = "binary" if strategy == "indicator" else "boolean"
    rows = [(f"{c}{suffix}", c, n, n / total, strategy, kind) for c, n in gaps.items() if n > 0]
    info = df.sparkSession.createDataFrame(
        rows,
        "flag string, source_column string, missing_count bigint, missing_rate double, strategy string, flag_type string",
    )
    return df.withColumns(flags), info


def missing_counts(df: DataFrame, columns: list[str] | None = None) -> tuple[dict[str, int], int]:
    """NULL cells per column (names absent from the table are ignored) and the number of rows."""
    wanted = [c for c in (columns if columns is not None else df.columns) if c in df.columns]
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in wanted], F.count(F.lit(1)).alias("_rows")).first()
    return {c: row[f"n_{c}"] for c in wanted}, row["_rows"]


def modes(df: DataFrame, columns: list[str]) -> dict:
    """Most frequent value per column, the smallest of tied ones; numbers compare as numbers."""
    numeric = set(classify(df.schema).numeric)
    found = {}
    for kind, names in (("double", [c for c in columns if c in numeric]), ("string", [c for c in columns if c not in numeric])):
        if names:
            top = top_values(frequencies(df, names, as_type=kind), 1).collect()
            found.update({r["column"]: r["value"] for r in top})
    return found


def fill_values(df: DataFrame, columns: list[str], strategy: str) -> dict[str, float]:
    """Fill value of each numeric column; 0 for a column without any value."""
    if strategy == "median":
        medians = quantile_values(df, columns, [0.5])
        return {c: float(medians.get((c, 0.5), 0.0)) for c in columns}
    if strategy == "mean":
        means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
        return {c: means[c] if means[c] is not None else 0.0 for c in columns}
    if strategy in ("mode", "most_frequent"):
        found = modes(df, columns)
        return {c: float(found.get(c, 0.0)) for c in columns}
    if strategy == "constant":
        return {c: 0.0 for c in columns}
    raise ValueError(f"unknown numeric strategy '{strategy}'")


def impute_with_flags(
    df: DataFrame,
    columns: list[str] | None = None,
    numeric_strategy: str = "mean",
    categorical_strategy: str = "mode",
    suffix: str = "_imputed",
) -> tuple[DataFrame, DataFrame]:
    """Flag and fill every listed column with gaps; also returns method and fill value per column."""
    if numeric_strategy not in ("mean", "median", "mode", "constant"):
        raise ValueError(f"unknown numeric strategy '{numeric_strategy}'")
    if categorical_strategy not in ("mode", "constant"):
        raise ValueError(f"unknown categorical strategy '{categorical_strategy}'")
    gaps, total = missing_counts(df, columns)
    gaps = {c: n for c, n in gaps.items() if n > 0}
    numeric = set(classify(df.schema).numeric)
    numbers = [c for c in gaps if c in numeric]
    others = [c for c in gaps if c not in numeric]
    fills = fill_values(df, numbers, numeric_strategy) if numbers else {}
    if others:
        found = modes(df, others) if categorical_strategy == "mode" else {}
        fills |= {c: found.get(c) or "Unknown" for c in others}
    types = dict(df.dtypes)
    rows, filled = [], {}
    for c, n in gaps.items():
        if c in numeric:
            filled[c] = F.coalesce(F.col(c).cast("double"), F.lit(fills[c]))
            method = f"numeric_{numeric_strategy}"
        else:
            # a date keeps its type when filled by a date; the text constant turns it into text
            kind = "string" if fills[c] == "Unknown" else types[c]
            filled[c] = F.coalesce(F.col(c).cast(kind), F.lit(fills[c]).cast(kind))
            method = f"categorical_{categorical_strategy}"
        rows.append((c, method, str(fills[c]), n, n / total, f"{c}{suffix}"))
    flagged = df.withColumns({f"{c}{suffix}": flag(c) for c in gaps})
    info = df.sparkSession.createDataFrame(
        rows, "column string, method string, fill_value string, missing_count bigint, missing_rate double, flag string"
    )
    return flagged.withColumns(filled), info
