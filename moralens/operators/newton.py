"""Weighted logistic regression by Newton steps.

Loss, gradient and curvature at a point are sums over rows: every task sends one partial row of
(p + 1)^2 numbers for p features, Spark adds them up entry by entry, and the small system is solved
on the driver. A handful of passes reaches the optimum to machine precision, where a first-order solver
stops near it, so the same code fits and checks fits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moralens.operators.models import WEIGHT, weigh, weight_scheme, LOGISTIC
from moralens.operators.splitting import class_sizes

MAX_STEPS = 50
MAX_HALVINGS = 30
TOLERANCE = 1e-9


@dataclass
class LogisticFit:
    """Coefficients by feature, the intercept, the penalised loss and the steps taken."""

    coefficients: dict[str, float]
    intercept: float
    loss: float
    steps: int
    last_step: float

    def table(self, spark) -> DataFrame:
        rows = [*self.coefficients.items(), ("(intercept)", self.intercept)]
        return spark.createDataFrame([(f, float(w)) for f, w in rows], "feature string, coefficient double")


def _partial(beta: np.ndarray):
    """Sums of one task: loss, gradient, and the curvature matrix row by row."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(beta)
        loss, gradient, curvature = 0.0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            y, w = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1))
            x = np.empty((batch.num_rows, size))
            for k in range(size - 1):
                x[:, k] = batch.column(2 + k).to_numpy(zero_copy_only=False)
            x[:, -1] = 1.0
            z = x @ beta
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
            loss += float(w @ (np.logaddexp(0.0, z) - y * z))
            gradient += x.T @ (w * (p - y))
            curvature += (x * (w * p * (1.0 - p))[:, None]).T @ x
        flat = np.concatenate([[loss], gradient, curvature.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return sums


def logistic_sums(weighted: DataFrame, label: str, features: list[str], beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature of the unpenalised loss at ``beta`` (the intercept last), in one pass."""
    shown = weighted.select(F.col(label).cast("double"), F.col(WEIGHT).cast("double"), *[F.col(f"`{f}`").cast("double") for f in features])
    parts = shown.mapInArrow(_partial(beta), "sums array<double>").select(F.posexplode("sums"))
    found = parts.groupBy("pos").agg(F.sum("col").alias("total")).collect()
    size = len(beta)
    flat = np.zeros(1 + size + size * size)
    for r in found:
        flat[r["pos"]] = r["total"]
    if not np.isfinite(flat).all():
        raise ValueError("a feature has NULL, NaN or infinite values")
    return flat[0], flat[1 : 1 + size], flat[1 + size :].reshape(size, size)


def newton_logistic(
    train: DataFrame,
    label: str,
    features: list[str],
    balanced_data: bool = False,
    c: float = 1.0,
    start: np.ndarray | None = None,
    tolerance: float = TOLERANCE,
) -> LogisticFit:
    """Minimise the weighted loss plus |beta|^2 / (2 c); the intercept is not penalised.

    Rows without a label are left out. A step that does not lower the loss is halved. One class
    only, or no rows, raises: there is no finite optimum.
    """
    known = train.where(F.col(label).isNotNull())
    sizes = class_sizes(known, label)
    if set(sizes) != {0, 1}:
        raise ValueError(f"a logistic fit needs the classes 0 and 1, found {sorted(sizes)}")
    weighted, _ = weigh(known, label, weight_scheme(LOGISTIC, balanced_data), sizes)
    penalty = np.full(len(features) + 1, 1.0 / c)
    penalty[-1] = 0.0

    def at(beta: np.ndarray):
        loss, gradient, curvature = logistic_sums(weighted, label, features, beta)
        return loss + float(penalty @ (beta * beta)) / 2, gradient + penalty * beta, curvature + np.diag(penalty)

    beta = np.zeros(len(features) + 1) if start is None else np.asarray(start, dtype=float)
    loss, gradient, curvature = at(beta)
    for steps in range(1, MAX_STEPS + 1):
        step = np.linalg.solve(curvature, gradient)
        for _ in range(MAX_HALVINGS):
            found = at(beta - step)
            if found[0] <= loss + 1e-9 * abs(loss):
                break
            step = step / 2
        beta = beta - step
        loss, gradient, curvature = found
        size = float(np.abs(step).max())
        if size < tolerance:
            break
    return LogisticFit(dict(zip(features, beta[:-1].tolist(), strict=True)), float(beta[-1]), loss, steps, size)


def newton_gap(train: DataFrame, label: str, features: list[str], coefficients: np.ndarray, intercept: float, balanced_data: bool = False) -> float:
    """The largest change a Newton step would still make to a fit found elsewhere; 0 at the optimum."""
    known = train.where(F.col(label).isNotNull())
    weighted, _ = weigh(known, label, weight_scheme(LOGISTIC, balanced_data), class_sizes(known, label))
    beta = np.append(np.asarray(coefficients, dtype=float), intercept)
    _, gradient, curvature = logistic_sums(weighted, label, features, beta)
    penalty = np.append(np.ones(len(features)), 0.0)
    return float(np.abs(np.linalg.solve(curvature + np.diag(penalty), gradient + penalty * beta)).max())
