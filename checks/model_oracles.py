"""SQL twins of the fits that have one answer: logistic regression by Newton steps, each solved by elimination.

The twin cleans, splits, imputes, scales and encodes the panel itself, then iterates in SQL: gradient and
curvature are sums of products over the rows' non-zero cells, the linear system is reduced row by row in
a recursive query.
"""

from __future__ import annotations

from checks.oracles import CATEGORIES, COLUMNS, FEATURES, FLAGS, METRIC_ROWS, NAMES, ORACLES, SCORED, flag
from checks.panel_sql import with_panel

STEPS = 12

RECODED = "CASE genero WHEN 'HOMBRE' THEN 'M' WHEN 'MUJER' THEN 'F' WHEN ' ' THEN NULL ELSE genero END AS genero"
FITTED = ", ".join(
    f"""med_{c} AS (SELECT QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5) AS fill FROM train),
fit_{c} AS MATERIALIZED (SELECT MAX(fill) AS fill, AVG(COALESCE({c}, fill)) AS mean,
  CASE WHEN STDDEV_POP(COALESCE({c}, fill)) > 0 THEN STDDEV_POP(COALESCE({c}, fill)) ELSE 1 END AS std FROM train, med_{c})"""
    for c in FEATURES
)
CATEGORY_LISTS = ", ".join(f"cat_{c} AS MATERIALIZED (SELECT list_sort(list(DISTINCT COALESCE({c}, 'missing'))) AS v_{c} FROM train)" for c in CATEGORIES)
VALUES = " || ".join(
    [
        *[f"[(COALESCE(CAST({c} AS DOUBLE), fit_{c}.fill) - fit_{c}.mean) / fit_{c}.std, CAST({flag(c)} AS DOUBLE)]" for c in FEATURES],
        *[f"[CAST(COALESCE({c}, 0) AS DOUBLE), CAST({flag(c)} AS DOUBLE)]" for c in FLAGS],
        *[f"list_transform(v_{c}, lambda v: CAST(v = COALESCE({c}, 'missing') AS DOUBLE)) || [CAST({flag(c)} AS DOUBLE)]" for c in CATEGORIES],
        "[CAST(1 AS DOUBLE)]",
    ]
)
LABELS = " || ".join(
    [
        *[f"['{c}_scaled', '{c}_flag']" for c in FEATURES],
        *[f"['{c}_imputed', '{c}_flag']" for c in FLAGS],
        *[f"list_transform(v_{c}, lambda v: '{c}_' || v) || ['{c}_flag']" for c in CATEGORIES],
        "['(intercept)']",
    ]
)
LISTS = ", ".join(f"cat_{c}" for c in CATEGORIES)
DESIGN = f""", cleaned AS MATERIALIZED (SELECT MIN(row_id) AS row_id, {', '.join(COLUMNS)}
  FROM (SELECT * REPLACE ({RECODED}) FROM clientes) WHERE pago IS NOT NULL GROUP BY {', '.join(COLUMNS)}),
split AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY pago ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id)
    <= FLOOR(COUNT(*) OVER (PARTITION BY pago) * 0.2 + 0.5) AS is_test FROM cleaned),
train AS (SELECT * FROM split WHERE NOT is_test), {FITTED}, {CATEGORY_LISTS},
labels AS MATERIALIZED (SELECT labels, len(labels) AS p FROM (SELECT {LABELS} AS labels FROM {LISTS})),
classes AS MATERIALIZED (SELECT pago AS class, (SELECT COUNT(*) FROM train) / (2.0 * COUNT(*)) AS w FROM train GROUP BY pago),
design AS MATERIALIZED (SELECT row_id, is_test, CAST(pago AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, {VALUES} AS x
  FROM split JOIN classes ON class = pago, {', '.join(f'fit_{c}' for c in FEATURES)}, {LISTS}),
cells AS MATERIALIZED (SELECT row_id, i, x[i] AS v FROM (SELECT row_id, x, UNNEST(RANGE(1, len(x) + 1)) AS i FROM design WHERE NOT is_test) WHERE x[i] <> 0),
places AS MATERIALIZED (SELECT UNNEST(RANGE(1, p + 1)) AS i FROM labels),
beta_0 AS MATERIALIZED (SELECT list_transform(labels, lambda n: CAST(0 AS DOUBLE)) AS b FROM labels)"""


def newton_step(k: int) -> str:
    """CTEs from ``beta_k`` to the next; the last coefficient, the intercept, has no penalty."""
    return f""",
slope_{k} AS MATERIALIZED (SELECT row_id, w * (q - y) AS g, w * q * (1 - q) AS h FROM
  (SELECT row_id, y, w, 1 / (1 + exp(-list_dot_product(x, b))) AS q FROM design, beta_{k} WHERE NOT is_test)),
gradient_{k} AS MATERIALIZED (SELECT i, SUM(v * g) AS total FROM cells JOIN slope_{k} USING (row_id) GROUP BY i),
curvature_{k} AS MATERIALIZED (SELECT a.i, c.i AS j, SUM(a.v * c.v * h) AS total
  FROM cells a JOIN cells c USING (row_id) JOIN slope_{k} USING (row_id) GROUP BY ALL),
system_{k} AS MATERIALIZED (SELECT i, list(COALESCE(total, 0) + CASE WHEN i = j AND i < p THEN 1 ELSE 0 END ORDER BY j)
    || [ANY_VALUE(COALESCE((SELECT total FROM gradient_{k} g WHERE g.i = grid.i), 0) + CASE WHEN i < p THEN b[i] ELSE 0 END)] AS r
  FROM (SELECT u.i, o.i AS j FROM places u, places o) grid LEFT JOIN curvature_{k} USING (i, j), labels, beta_{k} GROUP BY i),
solve_{k} AS (SELECT 0 AS step, i, r FROM system_{k}
  UNION ALL
  SELECT s.step + 1, s.i, CASE WHEN s.i = s.step + 1 THEN list_transform(s.r, lambda v: v / top_row.r[s.step + 1])
    ELSE list_transform(list_zip(s.r, top_row.r), lambda z: z[1] - s.r[s.step + 1] / top_row.r[s.step + 1] * z[2]) END
  FROM solve_{k} s JOIN solve_{k} top_row ON top_row.i = s.step + 1, labels WHERE s.step < p),
beta_{k + 1} AS MATERIALIZED (SELECT list(b[i] - r[p + 1] ORDER BY i) AS b FROM solve_{k}, beta_{k}, labels WHERE step = p)"""


FIT = DESIGN + "".join(newton_step(k) for k in range(STEPS))


def recursive(body: str) -> str:
    return with_panel(body).replace("WITH ", "WITH RECURSIVE ", 1)


ORACLES["lr_coefficients"] = recursive(
    FIT + f" SELECT labels[i] AS feature, ROUND(b[i], 4) AS coefficient FROM places, labels, beta_{STEPS}"
)
LR_SCORES = f""", scored AS MATERIALIZED (SELECT 'logistic_regression' AS model, CASE WHEN is_test THEN 'test' ELSE 'train' END AS split,
  CAST(y AS BIGINT) AS label, 1 / (1 + exp(-list_dot_product(x, b))) AS score FROM design, beta_{STEPS})"""
ORACLES["fit_lr"] = recursive(
    FIT + LR_SCORES + METRIC_ROWS.removeprefix(SCORED)
    + f" SELECT 'all' AS method, model, split, {', '.join(f'ROUND({m}, 4) AS {m}' for m in NAMES)} FROM wide"
)
