"""SQL twins of the registered queries, written independently of the Spark code."""

from __future__ import annotations

from itertools import chain

from checks.panel_sql import with_panel

ORACLES: dict[str, str] = {}

COLUMNS = (
    "mes tipo_documento identificacion genero rango_edad_probable departamento saldo_capital dias_mora banco "
    "antiguedad_deuda pago_mes_anterior meses_desde_ultimo_pago sin_pago_previo contacto_mes_actual "
    "contacto_mes_anterior contacto_ultimos_6meses duracion_llamadas_ultimos_6meses pago"
).split()
FEATURES = ["saldo_capital", "dias_mora", "meses_desde_ultimo_pago", "duracion_llamadas_ultimos_6meses"]
FLAGS = ["pago_mes_anterior", "sin_pago_previo", "contacto_mes_actual", "contacto_mes_anterior", "contacto_ultimos_6meses"]
CATEGORIES = ["tipo_documento", "genero", "rango_edad_probable", "departamento", "banco"]
NUMERIC = [
    "saldo_capital", "dias_mora", "pago_mes_anterior", "meses_desde_ultimo_pago", "sin_pago_previo",
    "contacto_mes_actual", "contacto_mes_anterior", "contacto_ultimos_6meses", "duracion_llamadas_ultimos_6meses",
]


def oracle(name: str, body: str) -> None:
    ORACLES[name] = with_panel(body)


def union(template: str, columns: list[str]) -> str:
    """The template once per column, ``{c}`` replaced, stacked."""
    return "\nUNION ALL\n".join(template.replace("{c}", c) for c in columns)


def tall(columns: list[str], extra: str = "", cast: str = "DOUBLE") -> str:
    """``col, value`` rows of the given columns."""
    return union(f"SELECT '{{c}}' AS col, CAST({{c}} AS {cast}) AS value{extra} FROM clientes", columns)


oracle("load_panel", "SELECT * REPLACE (CAST(antiguedad_deuda AS VARCHAR) AS antiguedad_deuda) FROM clientes")

oracle(
    "q_top_clients",
    """SELECT identificacion, tipo_documento, genero, departamento, banco,
       MAX(saldo_capital) AS max_saldo_capital, MAX(dias_mora) AS max_dias_mora
FROM clientes GROUP BY ALL
ORDER BY max_saldo_capital DESC, identificacion, tipo_documento, genero, departamento, banco LIMIT 10""",
)

oracle(
    "q_avg_payers",
    """SELECT departamento, ROUND(AVG(total), 2) AS promedio_clientes_con_pago, COUNT(mes) AS meses_evaluados
FROM (SELECT mes, departamento, COUNT(DISTINCT identificacion) AS total FROM clientes WHERE pago = 1
      GROUP BY mes, departamento) GROUP BY departamento""",
)

oracle(
    "select_by_class",
    f"SELECT {', '.join(c for c in COLUMNS if c in [*NUMERIC, *CATEGORIES, 'pago'])} FROM clientes",
)

# Quality

NULLS = " + ".join(f"SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in COLUMNS)
PROFILE = f"""SELECT COUNT(*) AS total_rows, CAST(18 AS BIGINT) AS total_columns, CAST({NULLS} AS BIGINT) AS total_missing,
 (SELECT CAST(COUNT(*) AS BIGINT) FROM clientes) - (SELECT COUNT(*) FROM (SELECT DISTINCT {', '.join(COLUMNS)} FROM clientes))
   AS total_duplicates FROM clientes"""
oracle("quality_global", f"SELECT *, ROUND(total_missing / (total_rows * 18.0) * 100, 6) AS pct_missing FROM ({PROFILE})")

COLUMN_QUALITY = union(
    """SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS missing,
 ROUND((COUNT(*) - COUNT({c})) / CAST(COUNT(*) AS DOUBLE) * 100, 2) AS pct_missing,
 COUNT(DISTINCT {c}) AS unique_values, COUNT(DISTINCT {c}) <= 1 AS is_constant FROM clientes""",
    COLUMNS,
)
oracle("quality_columns", COLUMN_QUALITY)

oracle(
    "profile_numeric",
    union(
        """SELECT '{c}' AS "column", ROUND(AVG(CAST({c} AS DOUBLE)), 4) AS mean, ROUND(STDDEV_SAMP(CAST({c} AS DOUBLE)), 4) AS std,
 ROUND(MIN(CAST({c} AS DOUBLE)), 4) AS min, ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25), 4) AS q25,
 ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5), 4) AS q50, ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75), 4) AS q75,
 ROUND(MAX(CAST({c} AS DOUBLE)), 4) AS max, BOOL_OR({c} < 0) AS has_negatives, BOOL_OR({c} = 0) AS has_zeros,
 BOOL_OR(ISINF(CAST({c} AS DOUBLE))) AS has_inf FROM clientes""",
        [*NUMERIC, "pago"],
    ),
)

oracle(
    "profile_exempt",
    union(
        """SELECT '{c}' AS "column", TRUE AS is_exempt,
 'Campo identificado como ID o campo exento de análisis' AS exempt_reason,
 (SELECT COUNT(DISTINCT {c}) FROM clientes) AS unique_values,
 (SELECT STRING_AGG(CAST(v AS VARCHAR), ', ' ORDER BY row_id) FROM
   (SELECT row_id, {c} AS v FROM clientes WHERE {c} IS NOT NULL ORDER BY row_id LIMIT 5)) AS sample_values""",
        ["identificacion", "mes"],
    ),
)

TOP = """, f AS (SELECT col, value, COUNT(*) AS n FROM ({tall}) WHERE value IS NOT NULL GROUP BY col, value),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY col ORDER BY n DESC, value) AS pos,
             SUM(n) OVER (PARTITION BY col) AS total FROM f)"""
oracle(
    "profile_categorical",
    TOP.format(tall=tall(CATEGORIES, cast="VARCHAR"))
    + """ SELECT col AS "column", CAST(pos AS INT) AS pos, value, n, ROUND(n / total * 100, 6) AS pct FROM r WHERE pos <= 5""",
)
oracle(
    "category_top",
    TOP.format(tall=tall(CATEGORIES, cast="VARCHAR"))
    + """ SELECT col AS "column", CAST(pos AS INT) AS pos, value, n FROM r WHERE pos <= 10""",
)
oracle(
    "profile_dates",
    """SELECT 'antiguedad_deuda' AS "column", CAST(MIN(antiguedad_deuda) AS VARCHAR) AS min_date,
 CAST(MAX(antiguedad_deuda) AS VARCHAR) AS max_date,
 CAST(FLOOR((epoch_us(MAX(antiguedad_deuda)) - epoch_us(MIN(antiguedad_deuda))) / 86400000000) AS BIGINT) AS time_span
FROM clientes""",
)
oracle(
    "quality_rules",
    f""", q AS ({COLUMN_QUALITY}), p AS ({PROFILE})
SELECT 'warning' AS severity, 'constant_column' AS rule, "column", CAST(unique_values AS DOUBLE) AS value
  FROM q WHERE is_constant AND "column" <> 'pago'
UNION ALL SELECT 'warning', 'high_missing', "column", pct_missing FROM q WHERE pct_missing > 50
UNION ALL SELECT 'warning', 'empty_column', "column", missing FROM q WHERE unique_values = 0
UNION ALL SELECT 'error', 'target_constant', "column", unique_values FROM q WHERE is_constant AND "column" = 'pago'
UNION ALL SELECT 'warning', 'target_missing_values', "column", missing FROM q WHERE missing > 0 AND "column" = 'pago'
UNION ALL SELECT 'warning', 'duplicate_rows', NULL, total_duplicates FROM p WHERE total_duplicates > 0""",
)
oracle(
    "missing_top",
    f""", q AS ({COLUMN_QUALITY}) SELECT "column", missing, pct_missing FROM q WHERE missing > 0
ORDER BY pct_missing DESC, "column" LIMIT 5""",
)
oracle(
    "recategorize",
    """SELECT row_id, CASE genero WHEN 'HOMBRE' THEN 'M' WHEN 'MUJER' THEN 'F' WHEN ' ' THEN NULL ELSE genero END AS genero
FROM clientes""",
)
oracle(
    "dedupe",
    f"""SELECT MIN(row_id) AS row_id, {', '.join(c for c in COLUMNS if c != 'antiguedad_deuda')}
FROM clientes GROUP BY {', '.join(COLUMNS)}""",
)

# Distributions

oracle(
    "target_distribution",
    "SELECT pago, COUNT(*) AS n, ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM clientes), 6) AS pct FROM clientes GROUP BY pago",
)
oracle(
    "binary_counts",
    f""", t AS ({tall(FLAGS, ', pago')}) SELECT col AS "column", pago, value, COUNT(*) AS n FROM t
WHERE value IS NOT NULL GROUP BY ALL""",
)


def histogram_sql(columns: list[str], bins: str, by: bool) -> str:
    """Equal-width bins; ``bins`` is an expression over lo, hi, n, iqr of the column."""
    key = ", pago" if by else ""
    return f""", t AS ({tall(columns, ', pago')}),
s AS (SELECT col, MIN(value) AS lo, MAX(value) AS hi, COUNT(value) AS n,
      QUANTILE_CONT(value, 0.75) - QUANTILE_CONT(value, 0.25) AS iqr FROM t GROUP BY col),
b AS (SELECT col, lo, hi, CAST({bins} AS BIGINT) AS bins FROM s),
frame AS (SELECT col, lo, hi, bins, UNNEST(RANGE(bins)) AS bin FROM b),
grid AS (SELECT * FROM frame {'CROSS JOIN (SELECT DISTINCT pago FROM clientes)' if by else ''}),
c AS (SELECT col{key}, LEAST(FLOOR((value - lo) / (hi - lo) * bins), bins - 1) AS bin, COUNT(*) AS n
      FROM t JOIN b USING (col) WHERE value IS NOT NULL GROUP BY ALL)
SELECT {'grid.pago, ' if by else ''}grid.col AS "column", CAST(grid.bin AS BIGINT) AS bin, ROUND(lo + grid.bin * ((hi - lo) / bins), 4) AS from_value,
 ROUND(lo + (grid.bin + 1) * ((hi - lo) / bins), 4) AS to_value, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM grid LEFT JOIN c ON grid.col = c.col AND grid.bin = c.bin {'AND grid.pago = c.pago' if by else ''}"""


oracle("histogram", histogram_sql([*NUMERIC, "pago"], "20", False))
oracle(
    "histogram_auto",
    histogram_sql(
        NUMERIC,
        """CEIL((hi - lo) / CASE WHEN iqr > 0 THEN LEAST((hi - lo) / (LOG2(n) + 1), 2 * iqr / POWER(n, 1.0 / 3))
 ELSE (hi - lo) / (LOG2(n) + 1) END)""",
        True,
    ),
)
def kde_sql(columns: list[str]) -> str:
    return f""", t AS ({tall(columns, ', pago')}),
s AS (SELECT col, pago, COUNT(value) AS n, STDDEV_SAMP(value) * POWER(COUNT(value), -0.2) AS h, MIN(value) AS mn, MAX(value) AS mx
      FROM t GROUP BY col, pago HAVING COUNT(value) > 1 AND STDDEV_SAMP(value) > 0),
g AS (SELECT *, mn - 3 * h AS lo, (mx + 3 * h - (mn - 3 * h)) / 199 AS step FROM s),
f AS (SELECT col, pago, value, COUNT(*) AS w FROM t WHERE value IS NOT NULL GROUP BY ALL),
p AS (SELECT *, UNNEST(RANGE(200)) AS point FROM g)
SELECT p.col AS "column", p.pago, CAST(point AS INT) AS point, ROUND(lo + point * step, 4) AS at_value,
 ROUND(SUM(w * EXP(-0.5 * POWER((lo + point * step - value) / h, 2))) / (n * h * SQRT(2 * PI())) * 1e6, 4) AS density
FROM p JOIN f ON p.col = f.col AND p.pago = f.pago GROUP BY p.col, p.pago, point, lo, step, n, h"""


oracle("kde", kde_sql(NUMERIC))
oracle(
    "month_crosstab",
    """SELECT mes, CAST(SUBSTR(mes, 1, 4) AS INT) * 12 + CAST(SUBSTR(mes, 6, 2) AS INT) AS pos,
 COUNT(*) FILTER (pago = 0) AS n_0, COUNT(*) FILTER (pago = 1) AS n_1,
 ROUND(COUNT(*) FILTER (pago = 0) * 100.0 / COUNT(*), 6) AS pct_0, ROUND(COUNT(*) FILTER (pago = 1) * 100.0 / COUNT(*), 6) AS pct_1
FROM clientes GROUP BY mes""",
)
oracle(
    "month_rate",
    """SELECT mes, CAST(SUBSTR(mes, 1, 4) AS INT) * 12 + CAST(SUBSTR(mes, 6, 2) AS INT) AS pos,
 ROUND(AVG(pago) * 100, 6) AS tasa_pago FROM clientes GROUP BY mes""",
)
CROSSTAB = """ SELECT col AS "column", CAST(value AS VARCHAR) AS value, COUNT(*) FILTER (pago = 0) AS n_0,
 COUNT(*) FILTER (pago = 1) AS n_1, ROUND(COUNT(*) FILTER (pago = 0) * 100.0 / COUNT(*), 6) AS pct_0,
 ROUND(COUNT(*) FILTER (pago = 1) * 100.0 / COUNT(*), 6) AS pct_1 FROM t WHERE value IS NOT NULL"""
oracle("crosstab_binary", f", t AS ({tall(FLAGS, ', pago', 'INT')}) {CROSSTAB} GROUP BY col, value")
oracle(
    "crosstab_topk",
    f""", t AS ({tall(CATEGORIES, ', pago', 'VARCHAR')}),
top AS (SELECT col, value FROM (SELECT col, value, ROW_NUMBER() OVER (PARTITION BY col ORDER BY COUNT(*) DESC, value) AS pos
        FROM t WHERE value IS NOT NULL GROUP BY col, value) WHERE pos <= 10)
{CROSSTAB} AND (col, value) IN (SELECT (col, value) FROM top) GROUP BY col, value""",
)

# Correlation and outliers


def pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[:i]]


SCHEMA_ORDER = [c for c in COLUMNS if c in [*NUMERIC, "pago"]]
NAN_NULL = "CASE WHEN ISNAN({0}) THEN NULL ELSE ROUND({0}, 6) END"
oracle(
    "corr_pearson",
    "\nUNION ALL\n".join(
        f"SELECT '{a}' AS var_1, '{b}' AS var_2, "
        + NAN_NULL.format(f"CORR(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))")
        + " AS r FROM clientes"
        for a, b in pairs(SCHEMA_ORDER)
    ),
)
oracle(
    "corr_spearman",
    "\nUNION ALL\n".join(
        f"""SELECT '{a}' AS var_1, '{b}' AS var_2, {NAN_NULL.format('CORR(ra, rb)')} AS r FROM (
 SELECT RANK() OVER (ORDER BY {a}) + (COUNT(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
        RANK() OVER (ORDER BY {b}) + (COUNT(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
 FROM clientes WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
        for a, b in pairs(SCHEMA_ORDER)
    ),
)
# Discordance needs pairs of distinct cells: the axis with few values is joined on its own values,
# the other is folded into running counts, so the check stays fast on whole tables.
oracle(
    "corr_kendall",
    ", "
    + ",\n".join(
        f"""k{i} AS (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y, COUNT(*) AS n FROM clientes
   WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
u{i} AS (SELECT DISTINCT y FROM k{i}),
d{i} AS (SELECT u.y AS t, k.x, SUM(CASE WHEN k.y < u.y THEN n ELSE 0 END) AS below, SUM(CASE WHEN k.y > u.y THEN n ELSE 0 END) AS above,
   SUM(CASE WHEN k.y = u.y THEN n ELSE 0 END) AS same FROM k{i} k CROSS JOIN u{i} u GROUP BY u.y, k.x),
e{i} AS (SELECT same, SUM(below) OVER w AS lower_before, SUM(above) OVER w AS higher_before FROM d{i}
   WINDOW w AS (PARTITION BY t ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s{i} AS (SELECT SUM(same * CAST(COALESCE(lower_before, 0) - COALESCE(higher_before, 0) AS DOUBLE)) AS cd FROM e{i}),
m{i} AS (SELECT SUM(n) * (SUM(n) - 1) / 2.0 AS n0 FROM k{i}),
tx{i} AS (SELECT SUM(t * (t - 1) / 2.0) AS t FROM (SELECT SUM(n) AS t FROM k{i} GROUP BY x)),
ty{i} AS (SELECT SUM(t * (t - 1) / 2.0) AS t FROM (SELECT SUM(n) AS t FROM k{i} GROUP BY y))"""
        for i, (a, b) in enumerate(
            (a, b) if a == "saldo_capital" else ((b, a) if b == "saldo_capital" else (a, b))
            for a, b in pairs(SCHEMA_ORDER)
        )
    )
    + "\n"
    + "\nUNION ALL\n".join(
        f"""SELECT '{a}' AS var_1, '{b}' AS var_2,
 CASE WHEN (n0 - tx{i}.t) * (n0 - ty{i}.t) > 0 THEN ROUND(cd / SQRT((n0 - tx{i}.t) * (n0 - ty{i}.t)), 6) END AS r
FROM s{i}, m{i}, tx{i}, ty{i}"""
        for i, (a, b) in enumerate(pairs(SCHEMA_ORDER))
    ),
)
IQR = "QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75) - QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25)"
FENCES = f"""(SELECT QUANTILE_CONT(CAST({{c}} AS DOUBLE), 0.25) - 1.5 * ({IQR}) AS lo,
 QUANTILE_CONT(CAST({{c}} AS DOUBLE), 0.75) + 1.5 * ({IQR}) AS hi FROM clientes)"""
oracle(
    "outliers_iqr",
    union(f"SELECT '{{c}}' AS \"column\", row_id FROM clientes, {FENCES} WHERE {{c}} < lo OR {{c}} > hi", [*NUMERIC, "pago"]),
)
oracle(
    "outliers_zscore",
    union(
        """SELECT '{c}' AS "column", row_id FROM clientes,
 (SELECT AVG(CAST({c} AS DOUBLE)) AS m, STDDEV_SAMP(CAST({c} AS DOUBLE)) AS s FROM clientes)
WHERE s > 0 AND ABS(({c} - m) / s) > 2.5""",
        [*NUMERIC, "pago"],
    ),
)
oracle(
    "outlier_counts",
    union(
        f"""SELECT '{{c}}' AS "column", COUNT(*) FILTER ({{c}} < lo OR {{c}} > hi) AS outliers,
 ROUND(COUNT(*) FILTER ({{c}} < lo OR {{c}} > hi) * 100.0 / COUNT({{c}}), 6) AS pct_outliers FROM clientes, {FENCES}""",
        [*NUMERIC, "pago"],
    ),
)
oracle(
    "outlier_rows_removed",
    f"SELECT row_id, saldo_capital FROM clientes, {FENCES.replace('{c}', 'saldo_capital')} WHERE saldo_capital BETWEEN lo AND hi OR saldo_capital IS NULL",
)


def box_sql(by: bool, columns: list[str] = FEATURES) -> str:
    key, using = (", pago", "(col, pago)") if by else ("", "(col)")
    return f""", t AS ({tall(columns, ', pago')}),
q AS (SELECT col{key}, QUANTILE_CONT(value, 0.25) AS q1, QUANTILE_CONT(value, 0.5) AS median, QUANTILE_CONT(value, 0.75) AS q3
      FROM t WHERE value IS NOT NULL GROUP BY ALL)
SELECT col AS "column"{key}, ROUND(q1, 4) AS q1, ROUND(median, 4) AS median, ROUND(q3, 4) AS q3,
 ROUND(MIN(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_low,
 ROUND(MAX(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high,
 COUNT(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS fliers
FROM t JOIN q USING {using} WHERE value IS NOT NULL GROUP BY col{key}, q1, median, q3"""


oracle("box_stats", box_sql(False))
oracle("box_stats_by_class", box_sql(True))

# Tail probabilities, by Simpson's rule over the densities


def integral(density: str, low: str, high: str, steps: int = 2000) -> str:
    """The integral of an SQL expression in ``v``."""
    at = f"(({low}) + (({high}) - ({low})) * i / {steps}.0)"
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return (
        f"((({high}) - ({low})) / {3 * steps}.0 * list_sum(list_transform(range(0, {steps} + 1), "
        f"lambda i: {weight} * ({density.replace('{v}', at)}))))"
    )


def beta_share(x: str, a: str, b: str) -> str:
    """Regularised incomplete beta function; its variable is exp(-v^2), which leaves no pole at either end."""
    density = (
        f"CASE WHEN {{v}} < 1e-9 THEN CASE WHEN ({b}) = 0.5 THEN 2.0 ELSE 0.0 END ELSE "
        f"2 * {{v}} * exp(-({a}) * {{v}} * {{v}}) * power(1 - exp(-{{v}} * {{v}}), ({b}) - 1) END"
    )
    low = f"sqrt(-ln({x}))"
    whole = integral(density, low, f"sqrt(-ln({x}) + 60.0 / ({a}))")
    return f"CASE WHEN ({x}) >= 1 THEN 1.0 ELSE exp(lgamma(({a}) + ({b})) - lgamma({a}) - lgamma({b})) * {whole} END"


def t_tail(r: str, n: str) -> str:
    """Two-sided p-value of a correlation over n pairs."""
    return f"CASE WHEN ({r}) * ({r}) >= 1 THEN 0.0 ELSE {beta_share(f'1 - ({r}) * ({r})', f'(({n}) - 2) / 2.0', '0.5')} END"


def f_tail(f: str, between: str, within: str) -> str:
    return beta_share(f"({within}) / (({within}) + ({between}) * ({f}))", f"({within}) / 2.0", f"({between}) / 2.0")


def chi2_tail(statistic: str, dof: str) -> str:
    half, a = f"(({statistic}) / 2)", f"(({dof}) / 2.0)"
    density = (
        f"CASE WHEN {{v}} = 0 THEN CASE WHEN {a} = 0.5 THEN 2 * exp(-lgamma({a})) ELSE 0.0 END ELSE "
        f"2 * exp((2 * {a} - 1) * ln({{v}}) - {{v}} * {{v}} - lgamma({a})) END"
    )
    whole = integral(density, f"sqrt({half})", f"sqrt({half} + {a} + 60 + 12 * sqrt({a}))")
    return f"CASE WHEN ({dof}) <= 0 THEN 1.0 ELSE {whole} END"


# Relation to the target

oracle(
    "target_type",
    "SELECT 'pago' AS target_column, 'int' AS dtype, COUNT(DISTINCT pago) AS unique_values, 'binary' AS kind FROM clientes",
)


def information(numeric: list[str], categorical: list[str], target: str, continuous: bool) -> str:
    """CTEs that end in ``mi(col, mutual_information)``."""
    deciles = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"
    binned = lambda c: f"""(SELECT LIST_DISTINCT(QUANTILE_CONT(CAST({c} AS DOUBLE), {deciles})) FROM clientes)"""
    cut = lambda c: f"LEN(LIST_FILTER({binned(c)}, lambda d: CAST({c} AS DOUBLE) > d))"
    y = cut(target) if continuous else target
    parts = [
        f"SELECT '{c}' AS col, CAST({cut(c)} AS VARCHAR) AS x, CAST({y} AS VARCHAR) AS y FROM clientes WHERE {c} IS NOT NULL"
        for c in numeric
    ] + [f"SELECT '{c}' AS col, {c} AS x, CAST({y} AS VARCHAR) AS y FROM clientes WHERE {c} IS NOT NULL" for c in categorical]
    cells = "\nUNION ALL\n".join(f"SELECT col, x, y, COUNT(*) AS n FROM ({p}) GROUP BY ALL" for p in parts)
    return f""", cells AS ({cells}),
margins AS (SELECT *, SUM(n) OVER (PARTITION BY col, x) AS nx, SUM(n) OVER (PARTITION BY col, y) AS ny,
            SUM(n) OVER (PARTITION BY col) AS total FROM cells),
mi AS (SELECT col, SUM(n / total * LN(n * CAST(total AS DOUBLE) / (CAST(nx AS DOUBLE) * ny))) AS mutual_information
       FROM margins GROUP BY col)"""


def auc_cte(columns: list[str]) -> str:
    return f""" , auct AS ({tall(columns, ', pago')}),
ar AS (SELECT col, pago, RANK() OVER (PARTITION BY col ORDER BY value)
         + (COUNT(*) OVER (PARTITION BY col, value) - 1) / 2.0 AS rank FROM auct WHERE value IS NOT NULL),
auc AS (SELECT col, (SUM(rank) FILTER (pago = 1) - COUNT(*) FILTER (pago = 1) * (COUNT(*) FILTER (pago = 1) + 1) / 2.0)
   / (CAST(COUNT(*) FILTER (pago = 1) AS DOUBLE) * COUNT(*) FILTER (pago = 0)) AS auc FROM ar GROUP BY col)"""


NUM_VS_BINARY = (
    information(NUMERIC, [], "pago", False)
    + auc_cte(NUMERIC)
    + ", base AS ("
    + union(
        """SELECT '{c}' AS col, (COUNT(*) - COUNT({c})) / CAST(COUNT(*) AS DOUBLE) AS missing_rate,
 COUNT(DISTINCT {c}) = 2 AS is_binary, CORR(CAST({c} AS DOUBLE), CAST(pago AS DOUBLE)) AS correlation,
 AVG({c}) FILTER (pago = 0) AS mean_0, AVG({c}) FILTER (pago = 1) AS mean_1 FROM clientes""",
        NUMERIC,
    )
    + """)"""
)
oracle(
    "num_vs_binary",
    NUM_VS_BINARY
    + """ SELECT base.col AS "column", ROUND(missing_rate, 6) AS missing_rate, is_binary, ROUND(auc, 6) AS auc,
 ROUND(correlation, 6) AS correlation, ROUND(mutual_information, 6) AS mutual_information, ROUND(mean_0, 4) AS mean_0,
 ROUND(mean_1, 4) AS mean_1 FROM base JOIN auc USING (col) JOIN mi USING (col)""",
)
OTHERS = [*[c for c in NUMERIC if c != "saldo_capital"], "pago"]
oracle(
    "num_vs_continuous",
    information(OTHERS, [], "saldo_capital", True)
    + ", base AS ("
    + union(
        """SELECT '{c}' AS col, ROUND((COUNT(*) - COUNT({c})) / CAST(COUNT(*) AS DOUBLE), 6) AS missing_rate,
 COUNT(DISTINCT {c}) = 2 AS is_binary, COUNT({c}) AS n, ROUND(CORR(CAST({c} AS DOUBLE), saldo_capital), 6) AS correlation,
 CORR(CAST({c} AS DOUBLE), saldo_capital) AS r FROM clientes""",
        OTHERS,
    )
    + f""") SELECT col AS "column", missing_rate, is_binary, n, correlation, ROUND({t_tail('r', 'n')}, 6) AS correlation_pvalue,
 ROUND(mutual_information, 6) AS mutual_information FROM base JOIN mi USING (col)""",
)
oracle(
    "anova",
    f""", t AS ({tall([*NUMERIC, 'pago'], ', banco')}),
g AS (SELECT col, banco, COUNT(*) AS n, AVG(value) AS m, VAR_POP(value) * COUNT(*) AS ss FROM t WHERE value IS NOT NULL GROUP BY col, banco),
a AS (SELECT col, SUM(n * m) / SUM(n) AS grand FROM g GROUP BY col),
f AS (SELECT col, CAST(SUM(n) AS BIGINT) AS n, COUNT(*) AS groups,
 (SUM(n * (m - grand) * (m - grand)) / (COUNT(*) - 1)) / (SUM(ss) / (SUM(n) - COUNT(*))) AS f FROM g JOIN a USING (col) GROUP BY col)
SELECT col AS "column", n, groups, ROUND(f, 6) AS anova_f_stat, ROUND({f_tail('f', 'groups - 1', 'n - groups')}, 6) AS anova_p_value FROM f""",
)
oracle(
    "group_means",
    f""", t AS ({tall(FEATURES, ', banco')}) SELECT col AS "column", banco, COUNT(value) AS n, ROUND(AVG(value), 4) AS mean
FROM t WHERE value IS NOT NULL GROUP BY col, banco""",
)
CHI2 = f""", t AS ({tall(CATEGORIES, ', pago', 'VARCHAR')}),
o AS (SELECT col, value, pago, COUNT(*) AS n FROM t WHERE value IS NOT NULL GROUP BY ALL),
vr AS (SELECT col, value, SUM(n) AS nv FROM o GROUP BY ALL), vc AS (SELECT col, pago, SUM(n) AS np FROM o GROUP BY ALL),
tot AS (SELECT col, SUM(n) AS total FROM o GROUP BY col),
shape AS (SELECT col, COUNT(DISTINCT value) AS r, COUNT(DISTINCT pago) AS k FROM o GROUP BY col),
full_cells AS (SELECT vr.col, vr.value, vc.pago, nv * np / CAST(total AS DOUBLE) AS e, COALESCE(o.n, 0) AS n, total
  FROM vr JOIN vc ON vr.col = vc.col JOIN tot ON vr.col = tot.col
  LEFT JOIN o ON o.col = vr.col AND o.value = vr.value AND o.pago = vc.pago),
chi AS (SELECT col, CAST(MAX(total) AS BIGINT) AS n,
  SUM(POWER(ABS(n - e) - CASE WHEN (r - 1) * (k - 1) = 1 THEN LEAST(0.5, ABS(n - e)) ELSE 0 END, 2) / e) AS chi2_statistic,
  MAX((r - 1) * (k - 1)) AS chi2_dof FROM full_cells JOIN shape USING (col) GROUP BY col)"""
oracle("chi2", CHI2 + """ SELECT col AS "column", n, ROUND(chi2_statistic, 6) AS chi2_statistic, chi2_dof,
 ROUND({}, 6) AS chi2_p_value FROM chi""".format(chi2_tail("chi2_statistic", "chi2_dof")))
oracle(
    "mutual_info",
    information([*FEATURES, *FLAGS], CATEGORIES, "pago", False)
    + """ SELECT col AS "column", ROUND(mutual_information, 6) AS mutual_information FROM mi""",
)

TALL_STATS = {
    "numeric": ["missing_rate", "is_binary", "auc", "correlation", "mutual_information", "mean_0", "mean_1"],
    "categorical": ["missing_rate", "unique_categories", "is_binary", "chi2_statistic", "chi2_dof", "chi2_p_value", "mutual_information"],
}
oracle(
    "bivariate_report",
    NUM_VS_BINARY
    + CHI2
    + ", cat AS ("
    + union(
        """SELECT '{c}' AS col, (COUNT(*) - COUNT({c})) / CAST(COUNT(*) AS DOUBLE) AS missing_rate,
 COUNT(DISTINCT {c}) AS unique_categories, COUNT(DISTINCT {c}) = 2 AS is_binary FROM clientes""",
        CATEGORIES,
    )
    + ")"
    + information([], CATEGORIES, "pago", False).replace("cells AS", "ccells AS").replace("margins AS", "cmargins AS")
    .replace("FROM cells", "FROM ccells").replace("FROM margins", "FROM cmargins").replace("mi AS", "cmi AS")
    + ", wide_n AS (SELECT * FROM base JOIN auc USING (col) JOIN mi USING (col))"
    + f", wide_c AS (SELECT *, {chi2_tail('chi2_statistic', 'chi2_dof')} AS chi2_p_value FROM cat JOIN chi USING (col) JOIN cmi USING (col))"
    + "\nSELECT * FROM ("
    + "\nUNION ALL\n".join(
        chain(
            (
                f"""SELECT '{kind}' AS kind, col AS "column", '{s}' AS statistic, ROUND(CAST({s} AS DOUBLE), 4) AS value FROM {table}"""
                for kind, table in (("numeric", "wide_n"), ("categorical", "wide_c"))
                for s in TALL_STATS[kind]
            ),
            ["SELECT 'categorical' AS kind, col AS \"column\", 'n|' || value || '|' || pago AS statistic, CAST(n AS DOUBLE) AS value FROM o"],
        )
    )
    + ") WHERE value IS NOT NULL",
)

# Preparation

PREP_NUMERIC = FEATURES
IMPUTED = ["genero", "rango_edad_probable", "dias_mora", "meses_desde_ultimo_pago", "antiguedad_deuda"]
# The categories the panel can hold, in sorted order.
CATEGORY_VALUES = {
    "tipo_documento": ["C", "E"],
    "genero": [" ", "F", "HOMBRE", "M", "missing"],
    "rango_edad_probable": ["25-30", "31-35", "36-40", "66+", "missing"],
    "departamento": sorted([*[f"NATION_{i}" for i in range(25) if i != 7], "missing"]),  # 7 is the gap
    "banco": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
}
WITH_GAPS = [
    "genero", "rango_edad_probable", "departamento", "dias_mora", "antiguedad_deuda", "meses_desde_ultimo_pago",
    "contacto_ultimos_6meses", "duracion_llamadas_ultimos_6meses",
]


def flag(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END"


oracle("impute_flags", "SELECT row_id, " + ", ".join(f"{flag(c)} AS {c}_imputed" for c in WITH_GAPS) + " FROM clientes")
oracle(
    "impute_flag_info",
    union(
        """SELECT '{c}_imputed' AS flag, '{c}' AS source_column, COUNT(*) - COUNT({c}) AS missing_count,
 ROUND((COUNT(*) - COUNT({c})) / CAST(COUNT(*) AS DOUBLE), 6) AS missing_rate, 'missing_mask' AS strategy,
 'boolean' AS flag_type FROM clientes""",
        WITH_GAPS,
    ),
)


def mode_of(c: str) -> str:
    return f"(SELECT {c} FROM clientes WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)"


def imputed(numeric: str, constant: bool) -> str:
    shown = []
    for c in IMPUTED:
        if c in NUMERIC:
            fill = mode_of(c) if numeric == "mode" else numeric.replace("{c}", c)
            shown.append(f"ROUND(COALESCE(CAST({c} AS DOUBLE), {fill}), 6) AS {c}")
        else:
            fill = "'Unknown'" if constant else f"CAST({mode_of(c)} AS VARCHAR)"
            shown.append(f"COALESCE(CAST({c} AS VARCHAR), {fill}) AS {c}")
        shown.append(f"{flag(c)} AS {c}_imputed")
    return f"SELECT row_id, {', '.join(shown)} FROM clientes"


oracle("impute_mean", imputed("(SELECT AVG(CAST({c} AS DOUBLE)) FROM clientes)", False))
oracle("impute_median", imputed("(SELECT QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5) FROM clientes)", False))
oracle("impute_mode", imputed("mode", False))
oracle("impute_constant", imputed("0.0", True))
oracle(
    "flag_counts",
    union(
        """SELECT '{c}_imputed' AS flag, COUNT({c}) AS original, COUNT(*) - COUNT({c}) AS imputed,
 ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 6) AS pct_imputed FROM clientes""",
        WITH_GAPS,
    ),
)


def scaling(source: str) -> str:
    """CTEs ``fit_<column>(fill, mean, std)`` of the numeric columns, fitted on ``source``."""
    return ", ".join(
        f"""med_{c} AS (SELECT QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5) AS fill FROM {source}),
fit_{c} AS (SELECT MAX(fill) AS fill, AVG(COALESCE({c}, fill)) AS mean,
  CASE WHEN STDDEV_POP(COALESCE({c}, fill)) > 0 THEN STDDEV_POP(COALESCE({c}, fill)) ELSE 1 END AS std FROM {source}, med_{c})"""
        for c in PREP_NUMERIC
    )


SCALED = ", ".join(
    f"ROUND((COALESCE(CAST({c} AS DOUBLE), fit_{c}.fill) - fit_{c}.mean) / fit_{c}.std, 6) AS {c}_scaled, {flag(c)} AS {c}_flag"
    for c in PREP_NUMERIC
)
FITS = ", ".join(f"fit_{c}" for c in PREP_NUMERIC)
FILLED = ", ".join(f"COALESCE({c}, 0) AS {c}_imputed, {flag(c)} AS {c}_flag" for c in FLAGS)
ONE_HOT = ", ".join(
    chain.from_iterable(
        [
            *[f"CASE WHEN COALESCE({c}, 'missing') = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for v in values],
            f"{flag(c)} AS {c}_flag",
        ]
        for c, values in CATEGORY_VALUES.items()
    )
)
oracle("prep_numeric", f", {scaling('clientes')} SELECT row_id, {SCALED} FROM clientes, {FITS}")
oracle("prep_binary", f"SELECT row_id, {FILLED} FROM clientes")
oracle(
    "prep_categorical",
    f"""SELECT row_id, COALESCE(genero, 'missing') AS genero_imputed, COALESCE(departamento, 'missing') AS departamento_imputed,
 {ONE_HOT} FROM clientes""",
)
# Categories numbered by column, then value; a row lists the numbers of its own
oracle(
    "prep_sparse",
    f""", t AS ({' UNION ALL '.join(f"SELECT row_id, {i} AS place, '{c}' AS col, COALESCE({c}, 'missing') AS value FROM clientes" for i, c in enumerate(CATEGORIES))}),
d AS (SELECT col, value, ROW_NUMBER() OVER (ORDER BY place, value) - 1 AS pos FROM (SELECT DISTINCT place, col, value FROM t))
SELECT row_id, (SELECT CAST(COUNT(*) AS INT) FROM d) AS size, STRING_AGG(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS indices
FROM t JOIN d USING (col, value) GROUP BY row_id""",
)
SPLIT = """, hashed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pago ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) AS hash_rank,
  COUNT(*) OVER (PARTITION BY pago) AS class_size FROM clientes),
split AS (SELECT *, hash_rank <= FLOOR(class_size * 0.2 + 0.5) AS is_test FROM hashed)"""
oracle(
    "prep_full",
    f"""{SPLIT}, train AS (SELECT * FROM split WHERE NOT is_test), {scaling('train')}
SELECT row_id, CASE WHEN is_test THEN 'test' ELSE 'train' END AS split, {SCALED}, {FILLED}, {ONE_HOT} FROM split, {FITS}""",
)
oracle("split_stratified", SPLIT + " SELECT row_id, pago, is_test FROM split")
oracle(
    "folds",
    SPLIT + " SELECT row_id, pago, CAST(FLOOR(5 * (hash_rank - 1) / class_size) AS INT) AS fold FROM split",
)

# Rebalancing

HASH = "CAST('0x' || SUBSTR(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 15) AS BIGINT)"
SIZES = ", sizes AS (SELECT COUNT(*) FILTER (pago = 0) AS n0, COUNT(*) FILTER (pago = 1) AS n1 FROM clientes)"
DRAWS = SIZES + ", draws AS (SELECT UNNEST(RANGE(n0 - n1)) AS j FROM sizes)"
oracle(
    "undersample",
    SPLIT + SIZES + " SELECT row_id, pago, saldo_capital FROM split, sizes WHERE hash_rank <= LEAST(n0, n1)",
)
oracle(
    "oversample",
    DRAWS
    + f""", minority AS (SELECT *, ROW_NUMBER() OVER (ORDER BY row_id) - 1 AS idx FROM clientes WHERE pago = 1)
SELECT row_id, pago, saldo_capital, mes FROM clientes
UNION ALL SELECT -1 - j, pago, saldo_capital, mes FROM draws, sizes JOIN minority ON idx = {HASH.format(seed=42, key='j')} % n1""",
)
SMOTE_FEATURES = ["saldo_capital", "dias_mora", "duracion_llamadas_ultimos_6meses", "contacto_mes_actual"]


def neighbours_sql(features: list[str]) -> str:
    """CTEs ``minority(row_id, idx, features)`` and ``near(row_id, pos, neighbour)``."""
    shown = ", ".join(f"CAST(COALESCE({c}, 0) AS DOUBLE) AS {c}" for c in features)
    gap = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in features)
    return f""", minority AS (SELECT row_id, {shown}, ROW_NUMBER() OVER (ORDER BY row_id) - 1 AS idx FROM clientes WHERE pago = 1),
near AS (SELECT row_id, pos, neighbour FROM (
  SELECT a.row_id, b.row_id AS neighbour, ROW_NUMBER() OVER (PARTITION BY a.row_id ORDER BY {gap}, b.row_id) - 1 AS pos
  FROM minority a JOIN minority b ON a.row_id <> b.row_id) WHERE pos < 5)"""


oracle("neighbours", neighbours_sql(SMOTE_FEATURES) + " SELECT row_id, CAST(pos AS INT) AS pos, neighbour FROM near")
oracle(
    "smote",
    DRAWS
    + neighbours_sql(SMOTE_FEATURES)
    + f""", picks AS (SELECT j, {HASH.format(seed='42b', key='j')} % n1 AS idx, {HASH.format(seed='42k', key='j')} % 5 AS pos,
  {HASH.format(seed='42u', key='j')} / 1152921504606846976.0 AS u FROM draws, sizes)
SELECT row_id, pago, {', '.join(f'ROUND(CAST(COALESCE({c}, 0) AS DOUBLE), 4) AS {c}' for c in SMOTE_FEATURES)} FROM clientes
UNION ALL SELECT -1 - j, 1, {', '.join(f'ROUND(m.{c} + u * (o.{c} - m.{c}), 4)' for c in SMOTE_FEATURES)}
FROM picks JOIN minority m ON m.idx = picks.idx JOIN near ON near.row_id = m.row_id AND near.pos = picks.pos
JOIN minority o ON o.row_id = near.neighbour""",
)
oracle(
    "class_balance",
    SIZES
    + """ SELECT 'original' AS stage, pago AS class, COUNT(*) AS n, ROUND(COUNT(*) * 100.0 / (SELECT n0 + n1 FROM sizes), 6) AS pct
FROM clientes GROUP BY pago
UNION ALL SELECT 'undersampling', UNNEST([0, 1]), LEAST(n0, n1), 50.0 FROM sizes
UNION ALL SELECT 'oversampling', UNNEST([0, 1]), GREATEST(n0, n1), 50.0 FROM sizes""",
)
oracle(
    "class_weights",
    SIZES
    + """ SELECT pago AS class, COUNT(*) AS n, ROUND((SELECT n0 + n1 FROM sizes) / (2.0 * COUNT(*)), 6) AS balanced_weight,
 (SELECT ROUND(CAST(n0 AS DOUBLE) / n1, 6) FROM sizes) AS scale_pos_weight FROM clientes GROUP BY pago""",
)

# Metrics of two fixed scores

SCORED = SPLIT + """, scored AS (
SELECT 'contact' AS model, CASE WHEN is_test THEN 'test' ELSE 'train' END AS split, pago AS label,
  contacto_mes_actual * CAST(0.5 AS DOUBLE) + CAST(CASE WHEN rango_edad_probable IN ('36-40', '66+') THEN 0.25 ELSE 0.0 END AS DOUBLE)
  + (row_id % 10) * CAST(0.015625 AS DOUBLE) AS score FROM split
UNION ALL SELECT 'amount', CASE WHEN is_test THEN 'test' ELSE 'train' END, pago,
  LEAST(saldo_capital / CAST(400000 AS DOUBLE), CAST(1 AS DOUBLE)) FROM split)"""
METRIC_ROWS = SCORED + """, counted AS (SELECT model, split, score, COUNT(*) AS n, SUM(label) AS p FROM scored GROUP BY ALL),
ranked AS (SELECT *, SUM(n) OVER w AS k, SUM(p) OVER w AS hits FROM counted WINDOW w AS (PARTITION BY model, split ORDER BY score DESC)),
wide AS (SELECT model, split, (tp + tn) / total AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
  tp / n1 AS recall, CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / n1) / (tp / (tp + fp) + tp / n1) ELSE 0 END AS f1, roc_auc, pr_auc
FROM (SELECT model, split, CAST(COUNT(*) AS DOUBLE) AS total, CAST(SUM(label) AS DOUBLE) AS n1,
   CAST(COUNT(*) FILTER (score > 0.5 AND label = 1) AS DOUBLE) AS tp, CAST(COUNT(*) FILTER (score > 0.5 AND label = 0) AS DOUBLE) AS fp,
   CAST(COUNT(*) FILTER (score <= 0.5 AND label = 0) AS DOUBLE) AS tn FROM scored GROUP BY model, split)
JOIN (SELECT model, split, SUM((n - p) * (hits - p / 2.0)) / (SUM(p) * CAST(SUM(n - p) AS DOUBLE)) AS roc_auc,
   SUM(p * (hits / CAST(k AS DOUBLE))) / SUM(p) AS pr_auc FROM ranked GROUP BY model, split) USING (model, split))"""
NAMES = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]
ROUNDED = ", ".join(f"ROUND({m}, 6) AS {m}" for m in NAMES)
COMPARED = (
    METRIC_ROWS
    + ", tall AS ("
    + "\nUNION ALL\n".join(f"SELECT model, split, '{m}' AS metric, {m} AS value FROM wide" for m in NAMES)
    + """), sides AS (SELECT a.model, a.metric, a.value AS train, b.value AS test, a.value - b.value AS diff,
  CASE WHEN b.value <> 0 THEN (a.value - b.value) * 100 / b.value ELSE 0 END AS pct_diff
FROM tall a JOIN tall b ON a.model = b.model AND a.metric = b.metric AND a.split = 'train' AND b.split = 'test')"""
)
oracle("metrics", METRIC_ROWS + f" SELECT model, split, {ROUNDED} FROM wide")
oracle(
    "confusion",
    SCORED
    + """, cells AS (SELECT DISTINCT model, split, UNNEST([0, 0, 1, 1]) AS actual, UNNEST([0, 1, 0, 1]) AS predicted FROM scored)
SELECT c.model, c.split, c.actual, c.predicted, COUNT(s.label) AS n FROM cells c LEFT JOIN scored s
 ON c.model = s.model AND c.split = s.split AND c.actual = s.label AND c.predicted = CASE WHEN s.score > 0.5 THEN 1 ELSE 0 END GROUP BY ALL""",
)
oracle(
    "roc_points",
    METRIC_ROWS
    + """, t AS (SELECT SUM(p) AS n1, SUM(n - p) AS n0 FROM counted WHERE model = 'amount' AND split = 'test')
SELECT NULL AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL SELECT ROUND(score, 9), ROUND((k - hits) / CAST(n0 AS DOUBLE), 9), ROUND(hits / CAST(n1 AS DOUBLE), 9) FROM ranked, t
WHERE model = 'amount' AND split = 'test'""",
)
RISK = "CASE WHEN pct_diff > 10 THEN 'High' WHEN pct_diff > 5 THEN 'Medium' ELSE 'Low' END"
SIDES = "ROUND(train, 6) AS {0}, ROUND(test, 6) AS {1}, ROUND(diff, 6) AS {2}, ROUND(pct_diff, 6) AS pct_diff"
oracle(
    "overfit_table",
    COMPARED + f" SELECT model, metric, {SIDES.format('train', 'test', 'diff')}, {RISK} AS risk FROM sides",
)


def published(where: str, method: str, process: str) -> str:
    return f"""SELECT model AS "Model", UPPER(metric) AS "Metric", {SIDES.format('"Train"', '"Test"', '"Difference"')},
 '{method}' AS "Method", '{process}' AS "Process" FROM sides {where}"""


oracle("comparison_table", COMPARED + published("", "Combinado", "Unbalanced"))
oracle(
    "results_union",
    COMPARED
    + published("WHERE model = 'contact'", "Combinado", "Unbalanced")
    + " UNION ALL "
    + published("WHERE model = 'amount'", "Oversampling", "Balanced"),
)
oracle(
    "leaderboard",
    METRIC_ROWS
    + f" SELECT model, split, {ROUNDED}, CAST(ROW_NUMBER() OVER (ORDER BY roc_auc DESC, model) AS INT) AS pos FROM wide WHERE split = 'test'",
)
oracle(
    "best_result",
    METRIC_ROWS + f" SELECT model, split, {ROUNDED} FROM wide WHERE split = 'test' ORDER BY wide.pr_auc DESC, model LIMIT 1",
)
oracle(
    "metric_pivot",
    METRIC_ROWS
    + " SELECT a.model, "
    + ", ".join(f"ROUND(a.{m}, 6) AS {m}_train, ROUND(b.{m}, 6) AS {m}_test" for m in NAMES)
    + " FROM wide a JOIN wide b ON a.model = b.model AND a.split = 'train' AND b.split = 'test'",
)
oracle(
    "feature_union",
    auc_cte([*FEATURES, *FLAGS])
    + ", g AS ("
    + union("SELECT '{c}' AS col, COUNT(*) - COUNT({c}) AS missing FROM clientes", [*FEATURES, *FLAGS])
    + """), both_lists AS (
SELECT ROW_NUMBER() OVER (ORDER BY ROUND(ABS(auc - 0.5), 9) DESC, col) AS pos, col FROM auc QUALIFY pos <= 5
UNION ALL SELECT 5 + ROW_NUMBER() OVER (ORDER BY missing DESC, col) AS pos, col FROM g QUALIFY pos <= 10)
SELECT col AS feature, CAST(MIN(pos) AS INT) AS pos FROM both_lists GROUP BY col""",
)
WEIGHTS = {"saldo_capital": 0.001, "dias_mora": -0.25, "contacto_mes_actual": 3.0}
oracle(
    "lr_contributions",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS feature, CAST({w} AS DOUBLE) AS coefficient, ROUND(AVG(ABS(CAST({w} AS DOUBLE) *
 ({c} - (SELECT AVG(CAST({c} AS DOUBLE)) FROM clientes)))), 6) AS mean_abs_contribution FROM clientes"""
        for c, w in WEIGHTS.items()
    ),
)

# Sinks give back what was written

ORACLES["sink_json"] = ORACLES["quality_columns"]
ORACLES["sink_csv"] = ORACLES["month_rate"]
oracle(
    "sink_text",
    f""", q AS ({COLUMN_QUALITY}) SELECT CAST(ROW_NUMBER() OVER (ORDER BY pct_missing DESC, "column") AS VARCHAR) || '. ' || "column" AS line
FROM q WHERE missing > 0 QUALIFY ROW_NUMBER() OVER (ORDER BY pct_missing DESC, "column") <= 5""",
)
oracle("sink_panel", "SELECT row_id, mes, saldo_capital FROM clientes WHERE mes BETWEEN '1996-01' AND '1996-12'")
oracle("sink_model", f", {scaling('clientes')} SELECT row_id, {SCALED}, {FILLED}, {ONE_HOT} FROM clientes, {FITS}")
ORACLES["load_gate"] = ORACLES["quality_rules"]
ORACLES["load_report"] = ORACLES["profile_numeric"]

# The exploratory report: each table's SQL, its numbers summed per label

AUTO_BINS = """CEIL((hi - lo) / CASE WHEN iqr > 0 THEN LEAST((hi - lo) / (LOG2(n) + 1), 2 * iqr / POWER(n, 1.0 / 3))
 ELSE (hi - lo) / (LOG2(n) + 1) END)"""
REPORT = {
    "profile": (ORACLES["quality_global"], "''", "total_rows total_columns total_missing total_duplicates pct_missing"),
    "missing": (ORACLES["missing_top"].replace("LIMIT 5", "LIMIT 15"), '"column"', "missing pct_missing"),
    "target": (ORACLES["target_distribution"], "''", "pago n pct"),
    "binary": (ORACLES["binary_counts"], '"column"', "pago value n"),
    "histograms": (with_panel(histogram_sql(FEATURES, AUTO_BINS, False)), '"column"', "bin from_value to_value n"),
    "densities": (with_panel(kde_sql(FEATURES)), '"column"', "pago point at_value density"),
    "categories": (ORACLES["profile_categorical"].replace("pos <= 5", "pos <= 10"), "\"column\" || '/' || value", "pos n pct"),
    "correlation": (ORACLES["corr_pearson"], "var_1 || '/' || var_2", "r"),
    "boxes": (with_panel(box_sql(False, [*NUMERIC, "pago"])), '"column"', "q1 median q3 whisker_low whisker_high fliers"),
    "outliers": (ORACLES["outlier_counts"], '"column"', "outliers pct_outliers"),
}
ORACLES["eda_report"] = "\nUNION ALL\n".join(
    f"""SELECT '{name}' AS report, {label} AS "row", '{statistic}' AS statistic, COUNT(*) AS n,
 ROUND(SUM(CAST({statistic} AS DOUBLE)), 2) AS total FROM ({sql}) WHERE {statistic} IS NOT NULL GROUP BY ALL"""
    for name, (sql, label, statistics) in REPORT.items()
    for statistic in statistics.split()
)
