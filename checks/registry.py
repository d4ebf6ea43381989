"""Every registered query: (session, table folder) -> DataFrame.

Doubles are rounded on both sides of a check, because the order of a sum changes its last digits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moralens.operators import (
    balancing,
    bivariate,
    cleaning,
    correlation,
    distributions,
    models,
    newton,
    outliers,
    preparation,
    quality,
    selection,
    sparse_encoding,
    splitting,
)
from moralens.operators import metrics as metrics_ops
from moralens.operators import tree_contributions as tree_contributions_ops
from moralens.operators.columns import classify, select_classes
from moralens.operators.neighbours import nearest_neighbours
from moralens.operators.training_matrix import training_matrix
from moralens.plans import eda, reports, training
from moralens.sources import readers, sinks
from moralens.staging import staging_root
from moralens.sources.panel import BUSINESS_COLUMNS, EXEMPT, TARGET, build_panel, staged_panel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FEATURES = ["saldo_capital", "dias_mora", "meses_desde_ultimo_pago", "duracion_llamadas_ultimos_6meses"]
CATEGORIES = ["tipo_documento", "genero", "rango_edad_probable", "departamento", "banco"]
FLAGS = ["pago_mes_anterior", "sin_pago_previo", "contacto_mes_actual", "contacto_mes_anterior", "contacto_ultimos_6meses"]


def query(build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a function of the panel under its own name."""
    QUERIES[build.__name__] = lambda spark, sf_dir: build(staged_panel(spark, sf_dir))
    return build


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    places = lambda c: special.get(c, digits)
    return df.select(
        *[F.round(F.col(c), places(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def _load_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_panel(spark, sf_dir).withColumn("antiguedad_deuda", F.col("antiguedad_deuda").cast("string"))


QUERIES["load_panel"] = _load_panel


# Portfolio reports


@query
def q_top_clients(panel):
    return reports.top_clients(panel)


@query
def q_avg_payers(panel):
    return reports.average_payers(panel)


# Columns and quality


@query
def select_by_class(panel):
    return select_classes(panel, ("numeric", "categorical"), EXEMPT)


@query
def quality_global(panel):
    return rounded(quality.table_profile(panel.select(*BUSINESS_COLUMNS)))


@query
def quality_columns(panel):
    return quality.column_quality(panel.select(*BUSINESS_COLUMNS))


@query
def profile_numeric(panel):
    return rounded(quality.numeric_profile(panel, EXEMPT), 4)


@query
def profile_exempt(panel):
    return quality.exempt_profile(panel, EXEMPT, "row_id")


@query
def profile_categorical(panel):
    return rounded(quality.categorical_profile(panel, EXEMPT))


@query
def profile_dates(panel):
    return quality.date_profile(panel)


@query
def quality_rules(panel):
    return quality.quality_rules(panel.select(*BUSINESS_COLUMNS))


@query
def missing_top(panel):
    return quality.missing_top(quality.column_quality(panel.select(*BUSINESS_COLUMNS)), 5)


@query
def recategorize(panel):
    return cleaning.recategorize(panel).select("row_id", "genero")


@query
def dedupe(panel):
    return cleaning.drop_duplicates(panel, "row_id").drop("antiguedad_deuda")


# Distributions


@query
def target_distribution(panel):
    return rounded(distributions.target_distribution(panel, TARGET))


@query
def binary_counts(panel):
    return distributions.binary_counts(panel, TARGET, EXEMPT)


def numeric_columns(panel: DataFrame) -> list[str]:
    return classify(panel.schema, EXEMPT).numeric


@query
def histogram(panel):
    return rounded(distributions.histogram(panel, numeric_columns(panel), 20), 4)


@query
def histogram_auto(panel):
    return rounded(distributions.histogram(panel, [c for c in numeric_columns(panel) if c != TARGET], "auto", TARGET), 4)


@query
def kde(panel):
    found = distributions.density(panel, [c for c in numeric_columns(panel) if c != TARGET], TARGET)
    scaled = found.withColumn("density", F.col("density") * 1e6)
    return rounded(scaled, 4)


@query
def category_top(panel):
    return distributions.category_top(panel, EXEMPT)


@query
def month_crosstab(panel):
    return rounded(distributions.month_crosstab(panel))


@query
def month_rate(panel):
    return rounded(distributions.month_rate(panel))


@query
def crosstab_binary(panel):
    return rounded(distributions.crosstab_binary(panel, TARGET, EXEMPT))


@query
def crosstab_topk(panel):
    return rounded(distributions.crosstab_topk(panel, CATEGORIES, TARGET, 10))


# Correlation and outliers


@query
def corr_pearson(panel):
    return rounded(correlation.correlation_matrix(panel, classify(panel.schema, EXEMPT).numeric, "pearson"))


@query
def corr_spearman(panel):
    return rounded(correlation.correlation_matrix(panel, numeric_columns(panel), "spearman"))


@query
def corr_kendall(panel):
    return rounded(correlation.correlation_matrix(panel, numeric_columns(panel), "kendall"))


@query
def outliers_iqr(panel):
    return outliers.outlier_rows(panel, "row_id", EXEMPT)


@query
def outliers_zscore(panel):
    return outliers.outlier_rows(panel, "row_id", EXEMPT, "zscore", 2.5)


@query
def outlier_counts(panel):
    return rounded(outliers.outlier_counts(panel, EXEMPT))


@query
def outlier_rows_removed(panel):
    return outliers.without_outliers(panel, "saldo_capital").select("row_id", "saldo_capital")


@query
def box_stats(panel):
    return rounded(outliers.box_statistics(panel, FEATURES), 4)


@query
def box_stats_by_class(panel):
    return rounded(outliers.box_statistics(panel, FEATURES, TARGET), 4)


# Relation to the target


@query
def target_type(panel):
    return bivariate.target_type(panel, TARGET)


@query
def num_vs_binary(panel):
    return rounded(bivariate.numeric_vs_binary(panel, TARGET, EXEMPT), 6, mean_0=4, mean_1=4)


@query
def num_vs_continuous(panel):
    found = bivariate.numeric_vs_continuous(panel, "saldo_capital", EXEMPT)
    return rounded(found)


@query
def anova(panel):
    return rounded(bivariate.anova(panel, "banco", EXEMPT))


@query
def group_means(panel):
    return rounded(bivariate.group_means(panel, FEATURES, "banco"), 4)


@query
def chi2(panel):
    return rounded(bivariate.chi_square(panel, TARGET, CATEGORIES))


@query
def mutual_info(panel):
    return rounded(bivariate.mutual_information(panel, TARGET, [*FEATURES, *FLAGS], CATEGORIES))


@query
def bivariate_report(panel):
    return rounded(bivariate.bivariate_report(panel, TARGET, EXEMPT), 4)


# Preparation

PREP_NUMERIC = FEATURES
PREP_CATEGORIES = CATEGORIES
IMPUTED = ["genero", "rango_edad_probable", "dias_mora", "meses_desde_ultimo_pago", "antiguedad_deuda"]


def _shown(df: DataFrame, columns: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(
        "row_id", *[F.col(c).cast("string").alias(c) if kinds[c].startswith("timestamp") else F.col(c) for c in columns]
    )


def _imputed(panel: DataFrame, numeric: str, categorical: str) -> DataFrame:
    filled, _ = preparation.impute_with_flags(panel, IMPUTED, numeric, categorical)
    return rounded(_shown(filled, [*IMPUTED, *[f"{c}_imputed" for c in IMPUTED]]))


@query
def impute_flags(panel):
    flagged, _ = preparation.imputation_flags(panel)
    return flagged.select("row_id", *[c for c in flagged.columns if c.endswith("_imputed")])


@query
def impute_flag_info(panel):
    return rounded(preparation.imputation_flags(panel, strategy="missing_mask")[1])


@query
def impute_mean(panel):
    return _imputed(panel, "mean", "mode")


@query
def impute_median(panel):
    return _imputed(panel, "median", "mode")


@query
def impute_mode(panel):
    return _imputed(panel, "mode", "mode")


@query
def impute_constant(panel):
    return _imputed(panel, "constant", "constant")


@query
def flag_counts(panel):
    return rounded(distributions.flag_counts(preparation.imputation_flags(panel)[0]))


@query
def prep_numeric(panel):
    fitted = preparation.NumericImputerWithFlag(inputCols=PREP_NUMERIC, scale=True).fit(panel)
    return rounded(fitted.transform(panel).select("row_id", *fitted.output_columns()))


@query
def prep_binary(panel):
    filler = preparation.BinaryImputerWithFlag(inputCols=FLAGS)
    return filler.transform(panel).select("row_id", *filler.output_columns())


@query
def prep_categorical(panel):
    filled = preparation.CategoricalImputerWithFlag(inputCols=["genero", "departamento"]).transform(panel)
    fitted = preparation.OneHotColumns(inputCols=PREP_CATEGORIES).fit(panel)
    filled = filled.drop("genero_flag", "departamento_flag")
    return fitted.transform(filled).select(
        "row_id", "genero_imputed", "departamento_imputed", *fitted.output_columns()
    )


@query
def prep_sparse(panel):
    """The same categories as one sparse vector per row."""
    encoder = sparse_encoding.fit_categories(panel, PREP_CATEGORIES)
    vectors = encoder.transform(panel, "row_id")
    indices = vector_indices(F.col("categories"))
    return vectors.select("row_id", F.lit(encoder.size).alias("size"), F.array_join(indices.cast("array<string>"), ",").alias("indices"))


def vector_indices(vector):
    """Places of the ones of a 0/1 vector."""
    dense = vector_to_array(vector)
    return F.filter(F.transform(dense, lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())


@query
def prep_full(panel):
    train, test = splitting.split_data(panel, "row_id", TARGET)
    a, b, _ = preparation.manual_preprocessing(train, test, PREP_NUMERIC, FLAGS, PREP_CATEGORIES, ("row_id",))
    both = a.withColumn("split", F.lit("train")).unionByName(b.withColumn("split", F.lit("test")))
    return rounded(both)


# Splits, folds and rebalancing

SMOTE_FEATURES = ["saldo_capital", "dias_mora", "duracion_llamadas_ultimos_6meses", "contacto_mes_actual"]


def _filled(panel: DataFrame) -> DataFrame:
    return panel.select("row_id", TARGET, *[F.coalesce(c, F.lit(0)).alias(c) for c in SMOTE_FEATURES])


@query
def split_stratified(panel):
    return splitting.mark_test(panel, "row_id", TARGET).select("row_id", TARGET, "is_test")


@query
def folds(panel):
    return splitting.add_folds(panel, "row_id", TARGET).select("row_id", TARGET, "fold")


@query
def undersample(panel):
    return balancing.undersample(panel.select("row_id", TARGET, "saldo_capital"), "row_id", TARGET)


@query
def oversample(panel):
    return balancing.oversample(panel.select("row_id", TARGET, "saldo_capital", "mes"), "row_id", TARGET)


@query
def smote(panel):
    return rounded(balancing.smote(_filled(panel), "row_id", TARGET, SMOTE_FEATURES), 4)


@query
def neighbours(panel):
    paying = _filled(panel.where(F.col(TARGET) == 1))
    return nearest_neighbours(paying, "row_id", SMOTE_FEATURES, 5).drop("x")


@query
def class_balance(panel):
    shown = panel.select("row_id", TARGET, *SMOTE_FEATURES)
    parts = {m: balancing.apply_balancing(shown, "row_id", TARGET, SMOTE_FEATURES, m) for m in ("undersampling", "oversampling")}
    return rounded(distributions.class_balance({"original": panel, **parts}, TARGET))


@query
def class_weights(panel):
    return rounded(metrics_ops.class_weights(panel, TARGET))


# Metrics of two fixed scores


def scored_rows(panel: DataFrame) -> DataFrame:
    older = F.when(F.col("rango_edad_probable").isin("36-40", "66+"), 0.25).otherwise(0.0)
    contact = F.col("contacto_mes_actual") * 0.5 + older + (F.col("row_id") % 10) * 0.015625
    amount = F.least(F.col("saldo_capital") / 400000.0, F.lit(1.0))
    marked = splitting.mark_test(panel, "row_id", TARGET)
    split = F.when(F.col("is_test"), "test").otherwise("train")
    both = F.array(
        F.struct(F.lit("contact").alias("model"), contact.alias("score")),
        F.struct(F.lit("amount").alias("model"), amount.alias("score")),
    )
    return marked.select(split.alias("split"), F.col(TARGET).alias("label"), F.explode(both).alias("s")).select(
        "s.model", "split", "label", "s.score"
    )


def metric_rows(panel: DataFrame) -> DataFrame:
    return metrics_ops.binary_metrics(scored_rows(panel), ["model", "split"])


def tall_metric_rows(panel: DataFrame) -> DataFrame:
    return metrics_ops.tall_metrics(metric_rows(panel), ["model", "split"])


@query
def metrics(panel):
    return rounded(metric_rows(panel))


@query
def confusion(panel):
    return metrics_ops.confusion_matrix(scored_rows(panel), ["model", "split"], "score", "label")


@query
def roc_points(panel):
    scored = scored_rows(panel).where((F.col("model") == "amount") & (F.col("split") == "test"))
    return rounded(metrics_ops.roc_points(scored, "score", "label"), 9)


@query
def overfit_table(panel):
    return rounded(metrics_ops.train_test_table(tall_metric_rows(panel), ["model"]))


@query
def comparison_table(panel):
    return rounded(metrics_ops.comparison_table(tall_metric_rows(panel), "Combinado", "Unbalanced"))


@query
def results_union(panel):
    tall = tall_metric_rows(panel)
    named = [
        metrics_ops.comparison_table(tall.where(F.col("model") == model), method, process)
        for model, method, process in (("contact", "Combinado", "Unbalanced"), ("amount", "Oversampling", "Balanced"))
    ]
    return rounded(metrics_ops.stack_results(named))


@query
def leaderboard(panel):
    return rounded(metrics_ops.leaderboard(metric_rows(panel).where(F.col("split") == "test")))


@query
def best_result(panel):
    return rounded(metrics_ops.best_result(metric_rows(panel).where(F.col("split") == "test"), "pr_auc"))


@query
def metric_pivot(panel):
    return rounded(metrics_ops.metric_pivot(tall_metric_rows(panel), ["model"]))


@query
def feature_union(panel):
    """Two rankings of the numeric columns, by AUC distance and by missing share, joined in order."""
    numeric = [*FEATURES, *FLAGS]
    by_auc = bivariate.feature_auc(panel, numeric, TARGET).select(
        F.row_number().over(Window.orderBy(F.desc(F.round(F.abs(F.col("auc") - 0.5), 9)), "column")).alias("pos"),
        F.col("column").alias("feature"),
    )
    gaps = quality.column_quality(panel.select(*numeric)).select(
        F.row_number().over(Window.orderBy(F.desc("missing"), "column")).alias("pos"),
        F.col("column").alias("feature"),
    )
    return selection.union_ranked([by_auc, gaps], 5)


@query
def lr_contributions(panel):
    weights = {"saldo_capital": 0.001, "dias_mora": -0.25, "contacto_mes_actual": 3.0}
    return rounded(models.linear_contributions(panel, weights))


# Sinks, written and read back


def _target_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark).rstrip('/')}/sinks/{uuid.uuid4().hex}/{name}"


@query
def sink_json(panel):
    found = quality_columns(panel)
    path = sinks.write_json(found, _target_path(panel.sparkSession, "report.json"))
    return panel.sparkSession.read.schema(found.schema).json(path)


@query
def sink_csv(panel):
    found = month_rate(panel)
    path = sinks.write_csv(found, _target_path(panel.sparkSession, "rates.csv"))
    return panel.sparkSession.read.schema(found.schema).option("header", True).csv(path)


@query
def sink_text(panel):
    spark = panel.sparkSession
    names = [r["column"] for r in missing_top(panel).collect()]
    path = sinks.write_lines(spark, names, _target_path(spark, "columns.txt"))
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def sink_panel(panel):
    path = sinks.write_panel(panel, _target_path(panel.sparkSession, "clientes.parquet"))
    back = panel.sparkSession.read.schema(panel.schema).parquet(path)
    return back.where(F.col("mes").between("1996-01", "1996-12")).select("row_id", "mes", "saldo_capital")


@query
def sink_model(panel):
    fitted = preparation.create_preprocessor(PREP_NUMERIC, FLAGS, PREP_CATEGORIES).fit(panel)
    path = sinks.save_model(fitted, _target_path(panel.sparkSession, "preprocessor"))
    loaded = sinks.load_model(path)
    return rounded(loaded.transform(panel).select("row_id", *preparation.feature_names(loaded)))


@query
def load_gate(panel):
    """The panel written out and read back through the quality gate."""
    path = _target_path(panel.sparkSession, "clientes.parquet")
    panel.write.parquet(path)
    return readers.load_data(panel.sparkSession, path, EXEMPT).findings


@query
def load_report(panel):
    """The numeric statistics of the gate's report, written and read back."""
    path, report = (_target_path(panel.sparkSession, name) for name in ("clientes.parquet", "report"))
    panel.write.parquet(path)
    loaded = readers.load_data(panel.sparkSession, path, EXEMPT, report_path=report)
    schema = loaded.statistics()["numeric"].schema
    return rounded(panel.sparkSession.read.schema(schema).json(f"{report}/numeric"), 4)


# Models: fits are compared by their properties in the tests, here they must run on the whole panel

_prepared: dict[str, training.Prepared] = {}


def prepared(panel: DataFrame) -> training.Prepared:
    key = panel.inputFiles()[0]
    if key not in _prepared:
        _prepared[key] = training.prepare(panel, FLAGS)
    return _prepared[key]


def _fitted(panel: DataFrame, model: str) -> DataFrame:
    data = prepared(panel)
    grid = {"all": (data.train, data.test, data.features)}
    return training.fit_grid(grid, TARGET, models.FULL, [model], balanced_data=False)[0]


@query
def fit_lr(panel):
    return rounded(_fitted(panel, models.LOGISTIC), 4)


@query
def lr_coefficients(panel):
    """The optimum of the same fit by Newton steps; the twin finds it in SQL."""
    data = prepared(panel)
    return rounded(newton.newton_logistic(data.train, TARGET, data.features).table(panel.sparkSession), 4)


@query
def tree_contributions(panel):
    """What each feature adds to the boosted model's score of the test rows."""
    data = prepared(panel)
    fitted = models.fit_model(models.BOOSTING, data.train, TARGET, data.features, models.FULL)
    added = tree_contributions_ops.tree_contributions(fitted, data.test, "row_id", data.features)
    return tree_contributions_ops.mean_contributions(added, data.features)


@query
def fit_rf(panel):
    return _fitted(panel, models.FOREST)


@query
def fit_gbt(panel):
    return _fitted(panel, models.BOOSTING)


@query
def fit_boosted_deep(panel):
    return _fitted(panel, models.DEEP_BOOSTING)


@query
def importance(panel):
    data = prepared(panel)
    return selection.feature_importance(data.train, TARGET, data.features, models.FULL)


@query
def rfe(panel):
    data = prepared(panel)
    return selection.recursive_elimination(data.train, TARGET, data.features, models.FULL)


@query
def cv_subsets(panel):
    data = prepared(panel)
    return selection.evaluate_features(data.train, "row_id", TARGET, data.features, models.FULL, selection.FOLDS)


@query
def select_features(panel):
    data = prepared(panel)
    chosen, ranking, scores = selection.select_features(
        data.train, "row_id", TARGET, data.features, "importance", 10, models.FULL, selection.FOLDS
    )
    mean, std = selection.cv_summary(scores)
    return ranking.where(F.col("feature").isin(chosen)).select(
        "*", F.lit(mean).alias("mean_cv_score"), F.lit(std).alias("std_cv_score")
    )


def _rankings(data: training.Prepared) -> tuple[list[str], list[str]]:
    """The best features by importance and by elimination, as the whole run picks them."""
    matrix = training_matrix(data.train, TARGET, data.features)
    by_importance = selection.feature_importance(matrix, TARGET, data.features, models.FULL)
    by_elimination = selection.recursive_elimination(matrix, TARGET, data.features, models.FULL)
    return selection.top_features(by_importance, 20), selection.top_features(by_elimination, 20)


@query
def train_eval(panel):
    data = prepared(panel)
    return training.train_and_evaluate_models(
        data.train, data.test, TARGET, data.features, *_rankings(data), models.FULL
    ).comparisons["general"]


@query
def train_balanced(panel):
    data = prepared(panel)
    names = selection.in_schema_order(selection.combine_features(*_rankings(data)), data.features)
    return training.train_balanced_models(
        data.train, data.test, "row_id", TARGET, names, models.FULL
    ).comparisons["general"]


REPORT_DIGITS = {"histograms": 4, "densities": 4, "boxes": 4}


@query
def eda_report(panel):
    """Every table of the exploratory report, its numbers summed per ``report, row, statistic``."""
    parts = []
    for name, table in eda.eda_report(panel, TARGET, EXEMPT).items():
        if name == "densities":
            table = table.withColumn("density", F.col("density") * 1e6)
        table = rounded(table, REPORT_DIGITS.get(name, 6))
        labels = [c for c, t in table.dtypes if t == "string"]
        values = [c for c, t in table.dtypes if t != "string"]
        typed = table.select(
            F.concat_ws("/", *labels).alias("row"), *[F.col(c).cast("double").alias(c) for c in values]
        )
        tall = typed.unpivot(["row"], values, "statistic", "value").where(F.col("value").isNotNull())
        parts.append(
            tall.groupBy("row", "statistic")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
            .select(F.lit(name).alias("report"), "row", "statistic", "n", "total")
        )
    return rounded(metrics_ops.stack_results(parts), 2)
