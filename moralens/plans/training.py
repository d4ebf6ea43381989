"""Training plans: feature sets x models, rebalancing methods x models, and the whole run."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moralens.operators.balancing import apply_balancing
from moralens.operators.cleaning import drop_duplicates, recategorize
from moralens.operators.columns import classify
from moralens.operators.distributions import class_balance
from moralens.operators.metrics import (
    binary_metrics,
    comparison_table,
    confusion_matrix,
    roc_points,
    tall_metrics,
    train_test_table,
)
from moralens.operators.models import FULL, MODEL_ORDER, ModelSettings, fit_tasks, score
from moralens.operators.preparation import create_preprocessor, feature_names
from moralens.operators.selection import combine_features, feature_importance, in_schema_order, recursive_elimination, top_features
from moralens.operators.splitting import split_data
from moralens.operators.training_matrix import FitPool, TrainingMatrix, fit_on, score_all, training_matrix
from moralens.plans.eda import eda_report
from moralens.sources.panel import EXEMPT, ROW_ID, TARGET
from moralens.sources.readers import load_data
from moralens.sources.sinks import save_model, write_csv, write_json, write_lines
from moralens.staging import stage

BALANCING_METHODS = ["undersampling", "oversampling", "smote"]


@dataclass
class TrainingResult:
    """Metrics as ``method, model, split, accuracy ... pr_auc``; models by (method, model)."""

    metrics: DataFrame
    models: dict[tuple[str, str], PipelineModel]
    features: dict[str, list[str]]
    best: tuple[str, str] | None = None
    balance: DataFrame | None = None
    comparisons: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def best_model(self) -> PipelineModel:
        return self.models[self.best]


@dataclass
class Evaluation:
    metrics: DataFrame
    overfitting: DataFrame
    confusion: DataFrame
    roc: DataFrame


def evaluate_model(fitted: PipelineModel, train: DataFrame, test: DataFrame, label: str) -> Evaluation:
    """Metrics and overfitting on both splits, confusion matrix and ROC curve on the test split."""
    named = lambda rows, split: score(fitted, rows, label).withColumn("split", F.lit(split))
    on_test = stage(named(test, "test"), "test-scores")
    found = stage(binary_metrics(named(train, "train").unionByName(on_test), ["split"]), "metrics")
    return Evaluation(
        found,
        train_test_table(tall_metrics(found, ["split"]), []),
        confusion_matrix(on_test, [], "score", "label"),
        roc_points(on_test, "score", "label"),
    )


def fit_grid(
    data: dict[str, tuple[DataFrame, DataFrame, list[str]]],
    label: str,
    settings: ModelSettings,
    models: list[str],
    balanced_data: bool,
) -> tuple[DataFrame, dict[tuple[str, str], PipelineModel]]:
    """Fit every model on every named (train, test, features) and evaluate both splits in one job."""
    # sets of features over one table share its matrix
    matrices: dict[tuple[int, int], tuple[TrainingMatrix, TrainingMatrix]] = {}
    for train, test, _ in data.values():
        if (id(train), id(test)) not in matrices:
            used = {f for t, _, features in data.values() if t is train for f in features}
            order = [f for f in train.columns if f in used]
            matrices[id(train), id(test)] = tuple(training_matrix(t, label, order) for t in (train, test))
    shared = {method: matrices[id(train), id(test)] for method, (train, test, _) in data.items()}
    jobs = [(method, model) for method in data for model in models]

    spark = next(iter(data.values()))[0].sparkSession
    with FitPool(spark, settings.parallel_fits) as pool:
        # sets that hold the same features of the same table share their fits
        alike = {(m, n): (id(shared[m][0]), tuple(data[m][2]), n) for m, n in jobs}
        one_of = {alike[j]: j for j in reversed(jobs)}
        started = {
            key: pool.submit(lambda m=m, n=n: fit_on(shared[m][0], n, data[m][2], settings, balanced_data))
            for key, (m, n) in sorted(one_of.items(), key=lambda k: jobs.index(k[1]))
        }
        fitted = {j: started[alike[j]].result() for j in jobs}
    scored = []
    for own in matrices.values():
        keyed = {j: (fitted[j], data[j[0]][2]) for j in jobs if shared[j[0]] is own}
        for split, matrix in zip(("train", "test"), own):
            scored.append(score_all(keyed, matrix, ["method", "model"]).withColumn("split", F.lit(split)))
    every = reduce(lambda a, b: a.unionByName(b), scored)
    metrics = stage(binary_metrics(every, ["method", "model", "split"]), "metrics")
    return metrics, fitted


def pick_best(metrics: DataFrame, methods: list[str], models: list[str], metric: str) -> tuple[str, str]:
    """(method, model) with the largest test metric; the first in listed order wins a tie."""
    rows = metrics.where((F.col("split") == "test") & F.col("method").isin(methods)).collect()
    place = lambda r: (methods.index(r["method"]), models.index(r["model"]))
    best = min(rows, key=lambda r: (-r[metric], place(r)))
    return best["method"], best["model"]


def _comparisons(metrics: DataFrame, methods: list[str], process: str) -> dict[str, DataFrame]:
    tall = tall_metrics(metrics, ["method", "model", "split"])
    tables = {
        m: comparison_table(tall.where(F.col("method") == m).drop("method"), m.title(), process) for m in methods
    }
    tables["general"] = reduce(lambda a, b: a.unionByName(b), [tables[m] for m in methods])
    return tables


def train_and_evaluate_models(
    train: DataFrame,
    test: DataFrame,
    label: str,
    feature_order: list[str],
    by_importance: list[str],
    by_elimination: list[str],
    settings: ModelSettings = FULL,
    models: list[str] | None = None,
    metric: str = "roc_auc",
    output: str | None = None,
) -> TrainingResult:
    """Four models on three feature sets; the best is chosen among the combined set."""
    models = models or MODEL_ORDER
    sets = {
        "combinado": combine_features(by_importance, by_elimination),
        "importancia": by_importance[:5],
        "rfe": by_elimination[:5],
    }
    data = {m: (train, test, in_schema_order(f, feature_order)) for m, f in sets.items()}
    metrics, fitted = fit_grid(data, label, settings, models, balanced_data=False)
    result = TrainingResult(metrics, fitted, sets, comparisons=_comparisons(metrics, list(sets), "Unbalanced"))
    result.best = pick_best(metrics, ["combinado"], models, metric)
    if output:
        save_model(result.best_model, f"{output}/best_model_selected_features")
        write_csv(result.comparisons["general"], f"{output}/train_test_comparison", ("Method", "Model", "Metric"))
        write_csv(metrics, f"{output}/model_results")
        write_lines(train.sparkSession, sets["combinado"], f"{output}/selected_features")
    return result


def train_balanced_models(
    train: DataFrame,
    test: DataFrame,
    row_id: str,
    label: str,
    features: list[str],
    settings: ModelSettings = FULL,
    methods: list[str] | None = None,
    models: list[str] | None = None,
    metric: str = "roc_auc",
    output: str | None = None,
) -> TrainingResult:
    """Four models on the train split rebalanced three ways; the test split is never rebalanced."""
    models, methods = models or MODEL_ORDER, methods or BALANCING_METHODS
    rebalanced = {m: stage(apply_balancing(train, row_id, label, features, m), f"train-{m}") for m in methods}
    data = {m: (rows, test, features) for m, rows in rebalanced.items()}
    metrics, fitted = fit_grid(data, label, settings, models, balanced_data=True)
    balance = class_balance({"original": train, **rebalanced}, label)
    result = TrainingResult(
        metrics, fitted, dict.fromkeys(methods, features), balance=balance,
        comparisons=_comparisons(metrics, methods, "Balanced"),
    )
    result.best = pick_best(metrics, methods, models, metric)
    if output:
        save_model(result.best_model, f"{output}/best_model_balanced_{result.best[0]}")
        write_csv(
            result.comparisons["general"], f"{output}/balanced_train_test_comparison", ("Method", "Model", "Metric")
        )
        write_csv(metrics, f"{output}/balanced_modeling_results")
        write_json(balance, f"{output}/balancing_info")
    return result


def preprocess_data(df: DataFrame, target: str = TARGET, row_id: str = ROW_ID, drop: list[str] | None = None) -> DataFrame:
    """Merged categories, no duplicate rows, no rows without target, no key or date columns."""
    skip = drop if drop is not None else EXEMPT
    clean = drop_duplicates(recategorize(df) if "genero" in df.columns else df, row_id)
    classes = classify(clean.schema, skip)
    kept = [c for c in clean.columns if c in classes.numeric or c in classes.categorical]
    return clean.where(F.col(target).isNotNull()).select(row_id, *kept)


def feature_groups(df: DataFrame, target: str, row_id: str, binary: list[str]) -> tuple[list[str], list[str], list[str]]:
    """(numeric, binary, categorical) feature columns of a prepared table."""
    classes = classify(df.schema, [row_id, target])
    flags = [c for c in classes.numeric if c in binary]
    return [c for c in classes.numeric if c not in flags], flags, classes.categorical


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    features: list[str]
    preprocessor: PipelineModel


def prepare(
    df: DataFrame, binary: list[str], target: str = TARGET, row_id: str = ROW_ID, test_size: float = 0.2, seed: int = 42
) -> Prepared:
    """Clean, split, fit the preprocessor on train and apply it to both; both parts are staged."""
    clean = preprocess_data(df, target, row_id)
    # the shuffle that drops copies may end in a few large partitions; all that follows reads these files
    tasks = fit_tasks(df.count(), df.sparkSession.sparkContext.defaultParallelism)
    clean = stage(clean.repartition(tasks) if tasks > 1 else clean, "clean")
    train, test = split_data(clean, row_id, target, test_size, seed)
    preprocessor = create_preprocessor(*feature_groups(clean, target, row_id, binary)).fit(train)
    names = feature_names(preprocessor)
    shown = lambda rows: preprocessor.transform(rows).select(row_id, target, *names)
    return Prepared(stage(shown(train), "train"), stage(shown(test), "test"), names, preprocessor)


def run(
    spark: SparkSession,
    path: str,
    output: str,
    binary: list[str],
    settings: ModelSettings = FULL,
    target: str = TARGET,
    row_id: str = ROW_ID,
    exempt: list[str] | None = None,
    top_n: int = 20,
) -> dict[str, TrainingResult]:
    """Load, report, prepare, select, train, rebalance and save, as one job."""
    exempt = exempt or EXEMPT
    df = load_data(spark, path, exempt_fields=exempt, target=target, report_path=f"{output}/data_quality_report").data
    for name, table in eda_report(df, target, exempt).items():
        write_json(table, f"{output}/eda_report/{name}")
    ready = prepare(df, binary, target, row_id)
    save_model(ready.preprocessor, f"{output}/preprocessor")
    matrix = training_matrix(ready.train, target, ready.features)
    importance = top_features(feature_importance(matrix, target, ready.features, settings), top_n)
    elimination = top_features(recursive_elimination(matrix, target, ready.features, settings), top_n)
    base = train_and_evaluate_models(
        ready.train, ready.test, target, ready.features, importance, elimination, settings, output=f"{output}/base"
    )
    balanced = train_balanced_models(
        ready.train, ready.test, row_id, target,
        in_schema_order(base.features["combinado"], ready.features), settings, output=f"{output}/balanced",
    )
    write_json(base.metrics.unionByName(balanced.metrics), f"{output}/metrics")
    return {"base": base, "balanced": balanced}
