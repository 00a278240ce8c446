"""Reference SQL for the registered queries that have a closed form."""

from __future__ import annotations

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "target"]
CATEGORICAL = ["row_id", "l_returnflag", "l_linestatus"]
NULLS_COLUMNS = ["row_id", *NUMERIC[:4], "l_returnflag", "l_linestatus", "target"]

BASE = """base AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT, round(l_extendedprice * 100)::BIGINT) AS row_id,
         l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
         CAST(l_extendedprice * (1 - l_discount) > 50000 AS INTEGER) AS target
  FROM lineitem)"""
NULLS = """nulls AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT, round(l_extendedprice * 100)::BIGINT) AS row_id,
         CASE WHEN (l_orderkey + l_linenumber) % 11 <> 0 THEN l_quantity END AS l_quantity,
         l_extendedprice, l_discount, l_tax,
         CASE WHEN (l_orderkey + l_linenumber) % 13 <> 0 THEN l_returnflag END AS l_returnflag,
         l_linestatus,
         CAST(l_extendedprice * (1 - l_discount) > 50000 AS INTEGER) AS target
  FROM lineitem)"""
SCORED = (
    BASE
    + """, rated AS (
  SELECT *, LEAST(GREATEST(FLOOR(60 * l_extendedprice / 100000 + 40 * l_quantity / 50)
                           / 100, 0.01::DOUBLE), 0.99::DOUBLE) AS p
  FROM base), scored AS (
  SELECT *, target AS label, CAST(p > 0.5 AS INTEGER) AS prediction FROM rated)"""
)
_SUM10 = " + ".join(f"abs(embedding[{i}]::DOUBLE)" for i in range(1, 11))
MULTI = (
    "multi AS (SELECT vec_id, label, ["
    + ", ".join(f"abs(embedding[{i}]::DOUBLE) / ({_SUM10})" for i in range(1, 11))
    + """] AS probability FROM embeddings), scored AS (
  SELECT vec_id, label, probability,
         CAST(list_position(probability, list_max(probability)) - 1 AS INTEGER) AS prediction
  FROM multi)"""
)

ORACLES: dict[str, str] = {}

ORACLES["confusion_matrix"] = f"""
WITH {SCORED}, axis AS (SELECT label AS c FROM scored UNION SELECT prediction FROM scored),
grid AS (SELECT a.c AS label, b.c AS prediction FROM axis a, axis b)
SELECT grid.label, grid.prediction, COUNT(s.label) AS n
FROM grid LEFT JOIN scored s ON s.label = grid.label AND s.prediction = grid.prediction
GROUP BY ALL"""

ORACLES["confusion_cells"] = f"""
WITH {SCORED}, named AS (
  SELECT CASE WHEN label = 0 AND prediction = 0 THEN 'TN' WHEN label = 0 THEN 'FP'
              WHEN prediction = 0 THEN 'FN' ELSE 'TP' END AS cell FROM scored)
SELECT cell, COUNT(*) AS value FROM named GROUP BY cell"""

ORACLES["classification_metrics"] = f"""
WITH {BASE}, ruled AS (
  SELECT target AS y, CAST(l_quantity > 25 AS INTEGER) AS z FROM base), c AS (
  SELECT COUNT(*) AS n, SUM(CAST(y = z AS INTEGER)) AS hit,
         SUM(y * z) AS tp, SUM(y) AS pos, SUM(z) AS pred FROM ruled)
SELECT round(hit / n::DOUBLE, 6) AS accuracy, round(1 - hit / n::DOUBLE, 6) AS error_rate,
       round(tp / pred::DOUBLE, 6) AS "precision", round(tp / pos::DOUBLE, 6) AS recall,
       round(2 * tp / (pos + pred)::DOUBLE, 6) AS f1
FROM c"""

_PER_CLASS = """axis AS (SELECT label AS c FROM scored UNION SELECT prediction FROM scored),
per AS (
  SELECT c, (SELECT COUNT(*) FROM scored WHERE label = c) AS support,
         (SELECT COUNT(*) FROM scored WHERE prediction = c) AS predicted,
         (SELECT COUNT(*) FROM scored WHERE prediction = c AND label = c) AS tp FROM axis)"""
ORACLES["macro_metrics"] = f"""
WITH {MULTI}, {_PER_CLASS}
SELECT round(AVG(CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted::DOUBLE END), 6) AS precision_macro,
       round(AVG(CASE WHEN support = 0 THEN 0 ELSE tp / support::DOUBLE END), 6) AS recall_macro,
       round(AVG(2 * tp / (support + predicted)::DOUBLE), 6) AS f1_macro
FROM per"""

_AUC = """counts AS (
  SELECT p, SUM(label)::DOUBLE AS pos, (COUNT(*) - SUM(label))::DOUBLE AS neg
  FROM scored GROUP BY p), ranked AS (
  SELECT *, COALESCE(SUM(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS below FROM counts), auc AS (
  SELECT SUM(pos * (below + neg / 2)) / (SUM(pos) * SUM(neg)) AS roc_auc FROM ranked)"""
ORACLES["roc_auc"] = f"WITH {SCORED}, {_AUC} SELECT round(roc_auc, 6) AS roc_auc FROM auc"

ORACLES["roc_auc_ovr"] = f"""
WITH {MULTI}, long AS (
  SELECT k, probability[k + 1] AS p, CAST(label = k AS INTEGER) AS y
  FROM scored, range(10) AS r(k)), counts AS (
  SELECT k, p, SUM(y)::DOUBLE AS pos, (COUNT(*) - SUM(y))::DOUBLE AS neg
  FROM long GROUP BY k, p), ranked AS (
  SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY k ORDER BY p
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM counts), per AS (
  SELECT k, SUM(pos * (below + neg / 2)) / (SUM(pos) * SUM(neg)) AS auc FROM ranked GROUP BY k)
SELECT round(AVG(auc), 6) AS roc_auc FROM per"""

ORACLES["log_loss_brier"] = f"""
WITH {SCORED}
SELECT round(AVG(-ln(CASE WHEN label = 1 THEN p ELSE 1 - p END)), 6) AS log_loss,
       round(AVG((p - label) * (p - label)), 6) AS brier_score
FROM scored"""

ORACLES["ordinal_error_metrics"] = f"""
WITH {MULTI}
SELECT round(AVG(abs(label - prediction)), 6) AS mae,
       round(AVG((label - prediction) * (label - prediction)), 6) AS mse,
       round(sqrt(AVG((label - prediction) * (label - prediction))), 6) AS rmse
FROM scored"""

ORACLES["metric_payload"] = f"""
WITH {SCORED}, {_AUC}, c AS (
  SELECT COUNT(*) AS n, SUM(label * prediction) AS tp, SUM(label) AS pos, SUM(prediction) AS pred,
         AVG(-ln(CASE WHEN label = 1 THEN p ELSE 1 - p END)) AS ll,
         AVG((p - label) * (p - label)) AS brier FROM scored), d AS (
  SELECT *, pred - tp AS fp, pos - tp AS fn, n - pos - pred + tp AS tn FROM c)
SELECT round((tp + tn) / n::DOUBLE, 6) AS accuracy, round(1 - (tp + tn) / n::DOUBLE, 6) AS error_rate,
       round(tp / pred::DOUBLE, 6) AS "precision", round(tp / pos::DOUBLE, 6) AS recall,
       round(2 * tp / (pos + pred)::DOUBLE, 6) AS f1,
       round((SELECT roc_auc FROM auc), 6) AS roc_auc,
       round((fp + fn) / n::DOUBLE, 6) AS mae, round((fp + fn) / n::DOUBLE, 6) AS mse,
       round(sqrt((fp + fn) / n::DOUBLE), 6) AS rmse,
       round(ll, 6) AS log_loss, round(brier, 6) AS brier_score,
       CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp,
       CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp
FROM d"""

_CURVE = """counts AS (
  SELECT p, SUM(label)::DOUBLE AS pos, (COUNT(*) - SUM(label))::DOUBLE AS neg
  FROM scored GROUP BY p), points AS (
  SELECT p, SUM(pos) OVER (ORDER BY p DESC) AS tp, SUM(neg) OVER (ORDER BY p DESC) AS fp,
         SUM(pos) OVER () AS pos_total, SUM(neg) OVER () AS neg_total FROM counts)"""
ORACLES["roc_curve"] = f"""
WITH {SCORED}, {_CURVE}
SELECT round(p, 6) AS threshold, round(fp / neg_total, 6) AS fpr, round(tp / pos_total, 6) AS tpr
FROM points UNION ALL SELECT CAST(NULL AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE"""
ORACLES["pr_curve"] = f"""
WITH {SCORED}, {_CURVE}
SELECT round(p, 6) AS threshold, round(tp / (tp + fp), 6) AS "precision",
       round(tp / pos_total, 6) AS recall
FROM points UNION ALL SELECT CAST(NULL AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE"""

ORACLES["csv_roundtrip_scan"] = f"""
WITH {NULLS}
SELECT row_id, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
       CAST(target AS BIGINT) AS target FROM nulls"""
ORACLES["profile_shape"] = 'SELECT COUNT(*) AS "rows", CAST(11 AS BIGINT) AS cols FROM lineitem'


def _each(columns: list[str], select: str, tail: str = "FROM nulls") -> str:
    return " UNION ALL ".join(f"SELECT {select.format(c=c)} {tail}" for c in columns)


_MISSING = _each(NULLS_COLUMNS, "'{c}' AS \"column\", COUNT(*) - COUNT({c}) AS missing")
ORACLES["profile_missing"] = f"WITH {NULLS} {_MISSING}"
ORACLES["profile_duplicates"] = """
SELECT 'events' AS source, (SELECT COUNT(*) FROM events)
       - (SELECT COUNT(*) FROM (SELECT DISTINCT event_type, user_id FROM events)) AS duplicate_rows
UNION ALL
SELECT 'documents', (SELECT COUNT(*) FROM documents)
       - (SELECT COUNT(*) FROM (SELECT DISTINCT text, lang FROM documents))"""
_DTYPES = {
    **dict.fromkeys(NUMERIC, "double"),
    **dict.fromkeys(CATEGORICAL, "string"),
    "target": "int",
}
ORACLES["profile_dtypes"] = f"WITH {NULLS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, COUNT({c}) AS non_null FROM nulls"
    for c, t in _DTYPES.items()
)
ORACLES["column_roles"] = f"WITH {NULLS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{'numeric' if c in NUMERIC else 'categorical'}' AS role, "
    f"COUNT({c}) AS non_null FROM nulls"
    for c in NULLS_COLUMNS
)
ORACLES["target_distribution"] = f"""
WITH {BASE} SELECT target, COUNT(*) AS "count" FROM base GROUP BY target"""
_STATS = (
    "CAST(COUNT({c}) AS {k}) AS \"count\", round(AVG({c}), 4) AS mean, "
    "round(stddev_samp({c}), 4) AS std, round(CAST(MIN({c}) AS DOUBLE), 4) AS \"min\", "
    "round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25, "
    "round(quantile_cont({c}::DOUBLE, 0.5), 4) AS q50, "
    "round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75, "
    "round(CAST(MAX({c}) AS DOUBLE), 4) AS \"max\""
)
ORACLES["describe_numeric"] = f"WITH {NULLS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {_STATS.format(c=c, k='BIGINT')} FROM nulls" for c in NUMERIC
)
ORACLES["describe_categorical"] = f"WITH {NULLS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (SELECT COUNT({c}) FROM nulls) AS "count",
        (SELECT COUNT(DISTINCT {c}) FROM nulls) AS "unique", t.v AS top, t.n AS freq
        FROM (SELECT {c} AS v, COUNT(*) AS n FROM nulls WHERE {c} IS NOT NULL
              GROUP BY {c} ORDER BY n DESC, v LIMIT 1) t"""
    for c in CATEGORICAL
)
_COUNTS = "counted AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS value, COUNT(*) AS n FROM nulls "
    f"WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in CATEGORICAL
) + """), low AS (SELECT "column", COUNT(*) AS n_distinct FROM counted
  GROUP BY "column" HAVING COUNT(*) <= 10)"""
ORACLES["low_card_columns"] = f"WITH {NULLS}, {_COUNTS} SELECT * FROM low"
ORACLES["category_counts"] = f"""
WITH {NULLS}, {_COUNTS} SELECT "column", value, n FROM counted
WHERE "column" IN (SELECT "column" FROM low)"""


def _bin(c: str, lo: str, hi: str) -> str:
    raw = f"LEAST(FLOOR(({c} - {lo}) / ({hi} - {lo}) * 15), 14)"
    step = f"(({hi} - {lo}) / 15)"
    return (
        f"CAST(CASE WHEN {c} < {lo} + {raw} * {step} THEN {raw} - 1 "
        f"WHEN {raw} < 14 AND {c} >= {lo} + ({raw} + 1) * {step} THEN {raw} + 1 "
        f"ELSE {raw} END AS BIGINT)"
    )


_LONG = "long AS (" + _each(NUMERIC, "'{c}' AS \"column\", CAST({c} AS DOUBLE) AS x") + ")"
ORACLES["histogram_15"] = f"""
WITH {NULLS}, {_LONG}, bounds AS (
  SELECT "column", MIN(x) AS lo, MAX(x) AS hi FROM long GROUP BY "column"), binned AS (
  SELECT l."column", {_bin('l.x', 'b.lo', 'b.hi')} AS bin
  FROM long l JOIN bounds b ON l."column" = b."column" WHERE l.x IS NOT NULL), counted AS (
  SELECT "column", bin, COUNT(*) AS n FROM binned GROUP BY ALL)
SELECT b."column", r.i AS bin, round(b.lo + r.i * ((b.hi - b.lo) / 15), 6) AS lower,
       round(b.lo + (r.i + 1) * ((b.hi - b.lo) / 15), 6) AS upper, COALESCE(c.n, 0) AS n
FROM bounds b CROSS JOIN range(15) AS r(i)
LEFT JOIN counted c ON c."column" = b."column" AND c.bin = r.i"""
ORACLES["correlation_matrix"] = f"WITH {NULLS} " + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS corr FROM nulls"
    for a in NUMERIC
    for b in NUMERIC
)
ORACLES["pair_grid"] = (
    f"WITH {NULLS}, complete AS (SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in NUMERIC)} FROM nulls "
    f"WHERE l_quantity IS NOT NULL), b AS (SELECT "
    + ", ".join(f"MIN({c}) AS lo_{c}, MAX({c}) AS hi_{c}" for c in NUMERIC)
    + " FROM complete), binned AS (SELECT "
    + ", ".join(f"{_bin(f'complete.{c}', f'b.lo_{c}', f'b.hi_{c}')} AS {c}" for c in NUMERIC)
    + " FROM complete, b) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, {a} AS x_bin, {b} AS y_bin, COUNT(*) AS n "
        f"FROM binned GROUP BY {a}{'' if a == b else ', ' + b}"
        for i, a in enumerate(NUMERIC)
        for b in NUMERIC[i:]
    )
)
_DUPES = (
    "(SELECT COUNT(*) FROM nulls) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM nulls))"
)
ORACLES["quality_report_json"] = (
    f"WITH {NULLS}, t AS (SELECT target, COUNT(*) AS n FROM nulls GROUP BY target) "
    "SELECT 'shape.rows' AS path, COUNT(*)::DOUBLE AS value FROM nulls "
    "UNION ALL SELECT 'shape.cols', 8::DOUBLE "
    f"UNION ALL SELECT 'duplicate_rows', ({_DUPES})::DOUBLE "
    "UNION ALL SELECT 'target_distribution.' || target, n::DOUBLE FROM t UNION ALL "
    + _each(NULLS_COLUMNS, "'missing_values.{c}', (COUNT(*) - COUNT({c}))::DOUBLE")
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT 'numeric_summary.{c}.{s}', round({e.format(c=c)}, 4) FROM nulls"
        for c in NUMERIC
        for s, e in {
            "count": "COUNT({c})::DOUBLE",
            "mean": "AVG({c})",
            "std": "stddev_samp({c})",
            "min": "MIN({c})::DOUBLE",
            "q25": "quantile_cont({c}::DOUBLE, 0.25)",
            "q50": "quantile_cont({c}::DOUBLE, 0.5)",
            "q75": "quantile_cont({c}::DOUBLE, 0.75)",
            "max": "MAX({c})::DOUBLE",
        }.items()
    )
)
ORACLES["quality_report_lines"] = (
    f"WITH {NULLS}, t AS (SELECT target, COUNT(*) AS n, "
    "row_number() OVER (ORDER BY COUNT(*) DESC, CAST(target AS VARCHAR)) AS k FROM nulls GROUP BY target), lines AS ("
    "SELECT 0 AS line_no, '# Data Quality Report' AS text UNION ALL SELECT 1, '' "
    "UNION ALL SELECT 2, '- Shape: ' || COUNT(*) || ' rows x 8 columns' FROM nulls "
    f"UNION ALL SELECT 3, '- Duplicate rows: ' || ({_DUPES}) "
    "UNION ALL SELECT 4, '' UNION ALL SELECT 5, '## Missing values' UNION ALL "
    + " UNION ALL ".join(
        f"SELECT {6 + i}, '- {c}: ' || (COUNT(*) - COUNT({c})) FROM nulls"
        for i, c in enumerate(NULLS_COLUMNS)
    )
    + " UNION ALL SELECT 14, '' UNION ALL SELECT 15, '## Target distribution' "
    "UNION ALL SELECT 15 + k, '- Class ' || target || ': ' || n FROM t) "
    "SELECT CAST(line_no AS BIGINT) AS line_no, text FROM lines"
)

ORACLES["preview_rows"] = f"""
WITH {BASE} SELECT l_extendedprice, l_quantity, target FROM base
WHERE target IN (1) ORDER BY row_id LIMIT 10"""
ORACLES["preview_shape"] = f"""
WITH {BASE} SELECT COUNT(*) AS "rows", CAST(3 AS BIGINT) AS cols FROM base WHERE target IN (1)"""
ORACLES["class_filter"] = "SELECT vec_id, label FROM embeddings WHERE label IN (1, 3, 5)"
ORACLES["prepare_dataset"] = f"""
WITH {NULLS}, first AS (
  SELECT MIN(row_id) AS row_id, l_quantity, l_returnflag, l_linestatus, target FROM nulls
  GROUP BY l_quantity, l_returnflag, l_linestatus, target)
SELECT * FROM first WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL"""
ORACLES["clean_missing_summary"] = f"""
WITH {NULLS}, c AS (
  SELECT COUNT(*) AS b, COUNT(*) FILTER (WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL)
         AS a FROM nulls)
SELECT b AS rows_before, a AS rows_after, b - a AS rows_removed FROM c"""

ORACLES["stratified_split"] = f"""
WITH {BASE}, ranked AS (
  SELECT row_id, target, row_number() OVER (PARTITION BY target
         ORDER BY md5(row_id || ':42'), row_id) AS rk FROM base), classes AS (
  SELECT target, COUNT(*) AS k, SUM(COUNT(*)) OVER () AS n FROM base GROUP BY target), sized AS (
  SELECT *, n - CAST(ceil(0.2::DOUBLE * n) AS BIGINT) AS n_train FROM classes), shares AS (
  SELECT *, k * n_train // n AS whole, k * n_train % n AS rest FROM sized), train AS (
  SELECT target, k, whole + CAST(row_number() OVER (ORDER BY rest DESC, target)
         <= n_train - SUM(whole) OVER () AS INTEGER) AS k_train FROM shares)
SELECT row_id, ranked.target, rk <= k - k_train AS is_test
FROM ranked JOIN train ON ranked.target = train.target"""
ORACLES["stratified_folds"] = f"""
WITH {BASE}, ranked AS (
  SELECT row_id, target,
         row_number() OVER (PARTITION BY target ORDER BY md5(row_id || ':42'), row_id) AS rk,
         (row_number() OVER (ORDER BY target, row_id) - 1) % 3 AS f FROM base), sizes AS (
  SELECT target, f, COUNT(*) AS c FROM ranked GROUP BY target, f), ends AS (
  SELECT target, f, c, SUM(c) OVER (PARTITION BY target ORDER BY f) AS hi FROM sizes)
SELECT r.row_id, r.target, CAST(e.f AS INTEGER) AS fold
FROM ranked r JOIN ends e ON r.target = e.target AND r.rk <= e.hi AND r.rk > e.hi - e.c"""

_FILLS = """fills AS (
  SELECT (SELECT median(l_quantity) FROM nulls) AS med,
         (SELECT l_returnflag FROM nulls WHERE l_returnflag IS NOT NULL
          GROUP BY l_returnflag ORDER BY COUNT(*) DESC, l_returnflag LIMIT 1) AS flag), filled AS (
  SELECT row_id, COALESCE(l_quantity, med) AS l_quantity, l_extendedprice, l_discount, l_tax,
         COALESCE(l_returnflag, flag) AS l_returnflag, l_linestatus FROM nulls, fills)"""
ORACLES["impute_median"] = f"WITH {NULLS}, {_FILLS} SELECT row_id, l_quantity FROM filled"
ORACLES["impute_mode"] = f"WITH {NULLS}, {_FILLS} SELECT row_id, l_returnflag FROM filled"


def _scaled(source: str) -> str:
    return ", ".join(
        f"round(({source}.{c} - m.a_{c}) / m.s_{c}, 6) AS {{p}}{c}" for c in NUMERIC[:4]
    )


def _moments(source: str) -> str:
    parts = ", ".join(f"AVG({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC[:4])
    return f"m AS (SELECT {parts} FROM {source})"


_HOT = ", ".join(
    f"CAST({c} = '{v}' AS INTEGER)::DOUBLE AS cat__{c}_{v}"
    for c, vs in {"l_returnflag": "ANR", "l_linestatus": "FO"}.items()
    for v in vs
)
ORACLES["standard_scale"] = (
    f"WITH {BASE}, {_moments('base')} SELECT row_id, {_scaled('base').format(p='')} FROM base, m"
)
ORACLES["one_hot"] = f"WITH {NULLS}, {_FILLS} SELECT row_id, {_HOT} FROM filled"
ORACLES["design_matrix"] = (
    f"WITH {NULLS}, {_FILLS}, {_moments('filled')} "
    f"SELECT row_id, {_scaled('filled').format(p='num__')}, {_HOT} FROM filled, m"
)
ORACLES["design_matrix_unscaled"] = (
    f"WITH {NULLS}, {_FILLS} SELECT row_id, "
    + ", ".join(f"round({c}, 6) AS num__{c}" for c in NUMERIC[:4])
    + f", {_HOT} FROM filled"
)

# Run log.

RUNS = """runs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderdate AS start_time,
         CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN ''
              ELSE o_orderpriority END AS algorithm,
         'unknown' AS dataset_version, 's' || o_custkey AS session_id,
         CASE WHEN o_custkey % 2 = 0 THEN 'accuracy' ELSE 'f1' END AS optimize_metric,
         'train' AS source, CAST(o_custkey AS VARCHAR) AS max_depth,
         CAST(1 AS INTEGER) AS n_parameters, o_totalprice / 500000 AS accuracy,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 500000 * 0.9::DOUBLE END AS f1,
         CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 500000 * 0.95::DOUBLE END AS roc_auc,
         o_totalprice AS price
  FROM orders), live AS (
  SELECT * FROM runs WHERE algorithm <> '' AND price >= 25000)"""
_ENTRY = """run_id, algorithm, dataset_version, session_id, optimize_metric, source, max_depth,
       n_parameters, accuracy, f1, roc_auc, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS created_at"""
_ACTIVE = """active AS (
  SELECT CASE WHEN o_totalprice >= 25000 THEN CAST(o_orderkey AS VARCHAR) END AS version
  FROM orders WHERE o_totalprice > 400000
  ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC LIMIT 1)"""
ORACLES["run_metadata"] = f"WITH {RUNS} SELECT {_ENTRY} FROM runs"
ORACLES["runs_list"] = f"""
WITH {RUNS}, {_ACTIVE}
SELECT {_ENTRY}, COALESCE(run_id = (SELECT version FROM active), FALSE) AS is_active
FROM live ORDER BY start_time DESC, run_id DESC"""
ORACLES["runs_oldest_first"] = f"""
WITH {RUNS}, {_ACTIVE}, newest AS (SELECT * FROM live ORDER BY start_time DESC, run_id DESC LIMIT 50)
SELECT row_number() OVER (ORDER BY start_time, run_id) AS place, run_id,
       COALESCE(run_id = (SELECT version FROM active), FALSE) AS is_active
FROM newest"""
ORACLES["runs_by_algorithm"] = f"""
WITH {RUNS} SELECT {_ENTRY} FROM live WHERE algorithm = '2-HIGH'"""
ORACLES["active_model"] = f"WITH {_ACTIVE} SELECT version FROM active"
SESSIONS = """scored AS (
  SELECT *, COALESCE(NULLIF(CASE WHEN first_value(optimize_metric) OVER newest = 'accuracy'
                            THEN accuracy ELSE f1 END, 0), -1) AS score
  FROM live WINDOW newest AS (PARTITION BY session_id ORDER BY start_time DESC, run_id DESC)),
best AS (
  SELECT session_id, algorithm, run_id FROM scored QUALIFY row_number() OVER (
    PARTITION BY session_id ORDER BY score DESC, start_time DESC, run_id DESC) = 1),
first_seen AS (
  SELECT session_id, algorithm, row_number() OVER (PARTITION BY session_id
         ORDER BY start_time DESC, run_id DESC) AS place
  FROM live QUALIFY row_number() OVER (PARTITION BY session_id, algorithm
                                       ORDER BY start_time DESC, run_id DESC) = 1),
named AS (SELECT session_id, string_agg(algorithm, ',' ORDER BY place) AS models
          FROM first_seen GROUP BY session_id),
heads AS (SELECT session_id, MIN(start_time) AS created, COUNT(*) AS n_results,
                 MIN(optimize_metric) AS optimize_metric FROM live GROUP BY session_id)"""
ORACLES["experiment_rollup"] = f"""
WITH {RUNS}, {SESSIONS}
SELECT h.session_id AS id, 'unknown' AS dataset_version, h.optimize_metric,
       strftime(h.created, '%Y-%m-%d %H:%M:%S') AS created_at, h.n_results, n.models,
       b.algorithm AS best_model, b.run_id AS best_version
FROM heads h JOIN named n USING (session_id) JOIN best b USING (session_id)"""
ORACLES["experiments_by_algorithm"] = f"""
WITH {RUNS}, {SESSIONS}
SELECT session_id AS id, run_id AS best_version FROM best WHERE algorithm = '5-LOW'"""
ORACLES["leaderboard"] = f"""
WITH {RUNS} SELECT run_id, algorithm, COALESCE(NULLIF(f1, 0), -1) AS score FROM runs"""
_PERF = """perf AS (
  SELECT algorithm AS model, round(accuracy * 100, 2) AS accuracy,
         round(COALESCE(f1, 0) * 100, 2) AS f1, round(COALESCE(roc_auc, 0) * 100, 2) AS auc
  FROM runs WHERE algorithm <> '' QUALIFY row_number() OVER (
    PARTITION BY algorithm ORDER BY start_time DESC, run_id DESC) = 1)"""
ORACLES["performance_table"] = f"WITH {RUNS}, {_PERF} SELECT * FROM perf"
_MODELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ORACLES["radar_pivot"] = f"WITH {RUNS}, {_PERF} " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, "
    + ", ".join(f"MAX(CASE WHEN model = '{x}' THEN {m} END) AS \"{x}\"" for x in _MODELS)
    + " FROM perf"
    for m in ("accuracy", "f1", "auc")
)
ORACLES["normalize_algorithm"] = """
WITH spelled AS (
  SELECT o_orderkey, CASE o_custkey % 11 WHEN 0 THEN ' RF ' WHEN 1 THEN 'Random Forest'
    WHEN 2 THEN 'ada boost' WHEN 3 THEN 'XGB' WHEN 4 THEN 'LogReg'
    WHEN 5 THEN 'Logistic Regression' WHEN 6 THEN 'SVM' WHEN 7 THEN 'Knn' WHEN 8 THEN 'mlp'
    WHEN 9 THEN 'Neural Network' ELSE 'naive bayes' END AS name FROM orders)
SELECT o_orderkey, name, CASE name WHEN ' RF ' THEN 'random_forest'
    WHEN 'Random Forest' THEN 'random_forest' WHEN 'ada boost' THEN 'adaboost'
    WHEN 'XGB' THEN 'xgboost' WHEN 'LogReg' THEN 'logistic_regression'
    WHEN 'Logistic Regression' THEN 'logistic_regression' WHEN 'SVM' THEN 'svm'
    WHEN 'Knn' THEN 'knn' WHEN 'mlp' THEN 'neural_network'
    WHEN 'Neural Network' THEN 'neural_network' END AS algorithm FROM spelled"""
ORACLES["run_time_ids"] = """
SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S_%f') AS id FROM events"""

ORACLES["misclassified_topk"] = f"""
WITH {SCORED}
SELECT row_id AS "index", label AS "true", prediction AS pred,
       round(GREATEST(p, 1 - p), 6) AS prob, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus
FROM scored WHERE label <> prediction ORDER BY GREATEST(p, 1 - p) DESC, row_id LIMIT 3"""
ORACLES["error_patterns"] = (
    f"WITH {SCORED} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, "
        f"round(AVG({c}) FILTER (WHERE label <> prediction), 4) AS wrong_mean, "
        f"round(AVG({c}) FILTER (WHERE label = prediction), 4) AS correct_mean, "
        "CAST(NULL AS VARCHAR) AS wrong_mode, CAST(NULL AS VARCHAR) AS correct_mode FROM scored"
        for c in NUMERIC[:4]
    )
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{c}', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), "
        + ", ".join(
            f"(SELECT {c} FROM scored WHERE label {op} prediction GROUP BY {c} "
            f"ORDER BY COUNT(*) DESC, {c} LIMIT 1)"
            for op in ("<>", "=")
        )
        for c in CATEGORICAL[1:]
    )
)

_NEIGHBOURS = """ranked AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label
         ORDER BY md5(vec_id || ':42'), vec_id) AS rk FROM embeddings), classes AS (
  SELECT label, COUNT(*) AS k, SUM(COUNT(*)) OVER () AS n FROM embeddings GROUP BY label), sized AS (
  SELECT *, n - CAST(ceil(0.2::DOUBLE * n) AS BIGINT) AS n_train FROM classes), shares AS (
  SELECT *, k * n_train // n AS whole, k * n_train % n AS rest FROM sized), train AS (
  SELECT label, k, whole + CAST(row_number() OVER (ORDER BY rest DESC, label)
         <= n_train - SUM(whole) OVER () AS INTEGER) AS k_train FROM shares), parts AS (
  SELECT vec_id, ranked.label, v, rk <= k - k_train AS is_test
  FROM ranked JOIN train ON ranked.label = train.label), near AS (
  SELECT q.vec_id, t.label, list_distance(q.v, t.v) AS d FROM parts q, parts t
  WHERE q.is_test AND NOT t.is_test QUALIFY row_number() OVER (
    PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v), t.vec_id) <= 5), votes AS (
  SELECT vec_id, label, SUM({weight}) AS w FROM near GROUP BY vec_id, label), shared AS (
  SELECT *, w / SUM(w) OVER (PARTITION BY vec_id) AS share FROM votes)
SELECT vec_id, CAST(label AS INTEGER) AS prediction, round(share, 6) AS share FROM shared
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, label) = 1"""
ORACLES["knn_predict"] = "WITH " + _NEIGHBOURS.format(weight="1.0::DOUBLE")
ORACLES["knn_predict_weighted"] = "WITH " + _NEIGHBOURS.format(weight="1 / d")

ORACLES["dataset_register"] = """
SELECT 'customers' AS version, COUNT(*) AS "rows", CAST(5 AS BIGINT) AS cols, FALSE AS is_active
FROM customer UNION ALL SELECT 'orders', COUNT(*), CAST(6 AS BIGINT), TRUE FROM orders"""
ORACLES["dataset_load_version"] = "SELECT * FROM customer"
ORACLES["dataset_list"] = f"""
WITH {NULLS}, c AS (
  SELECT COUNT(*) AS b, COUNT(*) FILTER (WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL)
         AS a FROM nulls)
SELECT 'lines' AS version, b AS "rows", CAST(8 AS BIGINT) AS cols,
       CAST(NULL AS VARCHAR) AS source_version, CAST(NULL AS BIGINT) AS rows_removed,
       FALSE AS is_active FROM c
UNION ALL SELECT 'lines_clean', a, 8, 'lines', b - a, TRUE FROM c"""
ORACLES["datasets_reset"] = """
SELECT 'seed' AS version, COUNT(*) AS "rows", TRUE AS is_active, CAST(2 AS BIGINT) AS removed FROM orders"""
ORACLES["runs_rollback"] = f"""
WITH {RUNS} SELECT run_id, algorithm, run_id = (SELECT MIN(run_id) FROM live) AS is_active FROM live"""
ORACLES["runs_reset"] = f"""
WITH {RUNS}, n AS (SELECT COUNT(*) AS live FROM live)
SELECT live + (SELECT COUNT(*) FROM runs WHERE price < 25000) AS deleted, live AS removed_model_files,
       CAST(0 AS BIGINT) AS model_registry_entries, CAST(0 AS BIGINT) AS experiment_entries FROM n"""
ORACLES["time_ids"] = """
SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y%m%d_%H%M%S_%f') AS time_id FROM orders"""
ORACLES["validated_classes"] = f"""
WITH {BASE} SELECT target, COUNT(*) AS n FROM base GROUP BY target"""
ORACLES["labels_attached"] = f"""
WITH {BASE} SELECT row_id, l_quantity, target FROM base"""


def _unpivot(source: str, columns: list[str], sums: str, by: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS f, {c}::DOUBLE AS v, {by}{sums} FROM {source} GROUP BY ALL" for i, c in enumerate(columns)
    )


def _value(columns: list[str], feature: str) -> str:
    return f"CASE {feature} " + " ".join(f"WHEN {i} THEN {c}::DOUBLE" for i, c in enumerate(columns)) + " END"


def _boosting_sql(columns: list[str], rounds: int, depth: int, rate: float) -> str:
    """Second-order trees over all cuts, lambda = 1, least Hessian 1."""
    steps = [f"WITH {BASE}, m0 AS (SELECT {', '.join(columns)}, target, COUNT(*) AS n, 0::DOUBLE AS margin FROM base GROUP BY ALL)"]
    out = []
    for r in range(rounds):
        steps.append(
            f"a{r}_0 AS (SELECT *, '' AS path, n * (1 / (1 + exp(-margin)) - target) AS g, "
            f"n * (1 / (1 + exp(-margin))) * (1 - 1 / (1 + exp(-margin))) AS h FROM m{r})"
        )
        for d in range(depth):
            now, sums = f"a{r}_{d}", "SUM(g) AS g, SUM(h) AS h"
            steps.append(f"u{r}_{d} AS ({_unpivot(now, columns, sums, 'path, ')})")
            steps.append(
                f"c{r}_{d} AS (SELECT path, f, v, MAX(v) OVER w AS top, SUM(g) OVER o AS gl, SUM(h) OVER o AS hl, SUM(g) OVER w AS g, "
                f"SUM(h) OVER w AS h FROM u{r}_{d} WINDOW w AS (PARTITION BY path, f), o AS (PARTITION BY path, f ORDER BY v))"
            )
            gain = "(gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)) / 2"
            steps.append(
                f"b{r}_{d} AS (SELECT path, f, v, {gain} AS gain FROM c{r}_{d} WHERE v < top AND hl >= 1 AND h - hl >= 1 AND {gain} > 1e-6 "
                "QUALIFY row_number() OVER (PARTITION BY path ORDER BY round(gain, 7) DESC, f, v) = 1)"
            )
            side = f"CASE WHEN b.f IS NULL THEN '' WHEN {_value(columns, 'b.f')} <= b.v THEN 'L' ELSE 'R' END"
            steps.append(f"a{r}_{d + 1} AS (SELECT a.* REPLACE (a.path || {side} AS path) FROM {now} a LEFT JOIN b{r}_{d} b ON b.path = a.path)")
            out.append(f"SELECT {r} AS tree, path, f AS feature, v AS threshold, NULL::DOUBLE AS value FROM b{r}_{d}")
        steps.append(f"l{r} AS (SELECT path, -{rate} * SUM(g) / (SUM(h) + 1) AS value FROM a{r}_{depth} GROUP BY path)")
        steps.append(f"m{r + 1} AS (SELECT {', '.join(columns)}, target, n, margin + value AS margin FROM a{r}_{depth} JOIN l{r} USING (path))")
        out.append(f"SELECT {r}, path, -1, 0, round(value, 6) FROM l{r}")
    return ",\n".join(steps) + "\n" + "\nUNION ALL ".join(out)


def _stumps_sql(columns: list[str], rounds: int, rate: float) -> str:
    """SAMME stumps over all cuts, two classes."""
    steps = [f"WITH {BASE}, w0 AS (SELECT {', '.join(columns)}, target, 1::DOUBLE AS w FROM base)"]
    for r in range(rounds):
        steps.append(f"u{r} AS ({_unpivot(f'w{r}', columns, 'SUM(w * (1 - target)) AS p, SUM(w * target) AS q')})")
        steps.append(
            f"c{r} AS (SELECT f, v, MAX(v) OVER a AS top, SUM(p) OVER o AS lp, SUM(q) OVER o AS lq, SUM(p) OVER a - SUM(p) OVER o AS rp, "
            f"SUM(q) OVER a - SUM(q) OVER o AS rq FROM u{r} WINDOW a AS (PARTITION BY f), o AS (PARTITION BY f ORDER BY v))"
        )
        steps.append(
            f"b{r} AS (SELECT *, CAST(lq > lp AS INTEGER) AS lc, CAST(rq > rp AS INTEGER) AS rc, "
            "(least(lp, lq) + least(rp, rq)) / (lp + lq + rp + rq) AS e FROM "
            f"c{r} WHERE v < top ORDER BY round(2 * lp * lq / (lp + lq) + 2 * rp * rq / (rp + rq), 7), f, v LIMIT 1)"
        )
        power = f"{rate} * ln((1 - e) / e)"
        steps.append(
            f"w{r + 1} AS (SELECT {', '.join(columns)}, target, "
            f"w * CASE WHEN (CASE WHEN {_value(columns, 'f')} <= v THEN lc ELSE rc END) <> target THEN exp({power}) ELSE 1 END AS w FROM w{r}, b{r})"
        )
    rows = [
        f"SELECT {r} AS round, f AS feature, v AS threshold, lc AS left_class, rc AS right_class, round({rate} * ln((1 - e) / e), 6) AS weight FROM b{r}"
        for r in range(rounds)
    ]
    return ",\n".join(steps) + "\n" + "\nUNION ALL ".join(rows)


ORACLES["boosted_trees"] = _boosting_sql(["l_discount", "l_quantity", "l_tax"], 3, 2, 0.1)
ORACLES["adaboost_stumps"] = _stumps_sql(["l_discount", "l_extendedprice", "l_quantity", "l_tax"], 3, 0.5)


def _held_out_sql(models: list[str], rows: str = "SELECT target FROM base", more: str = "") -> str:
    """Test rows per class by the largest-remainder rule, and facts that must be true."""
    return f"""
WITH {BASE}, rows AS ({rows}), classes AS (
  SELECT target, COUNT(*) AS k, SUM(COUNT(*)) OVER () AS n FROM rows GROUP BY target), sized AS (
  SELECT *, n - CAST(ceil(0.2::DOUBLE * n) AS BIGINT) AS n_train FROM classes), shares AS (
  SELECT *, k * n_train // n AS whole, k * n_train % n AS rest FROM sized), train AS (
  SELECT target, k, whole + CAST(row_number() OVER (ORDER BY rest DESC, target)
         <= n_train - SUM(whole) OVER () AS INTEGER) AS k_train FROM shares)
SELECT model, target::VARCHAR AS label, (k - k_train)::BIGINT AS n_test, TRUE AS metrics_hold, TRUE AS beats_majority{more}
FROM train, (VALUES {", ".join(f"('{m}')" for m in models)}) AS m(model)"""


for _query, _model in {
    "fit_logistic": "logistic_regression",
    "fit_random_forest": "random_forest",
    "fit_gbt": "xgboost",
    "fit_svm_linear": "svm",
    "fit_svm_rbf": "svm",
    "fit_adaboost": "adaboost",
    "fit_mlp": "neural_network",
    "fit_knn": "knn",
    "tune_then_train": "logistic_regression",
}.items():
    ORACLES[_query] = _held_out_sql([_model])
ORACLES["train_compare"] = _held_out_sql(["logistic_regression", "random_forest"], more=", TRUE AS best_is_active")
ORACLES["automl_leaderboard"] = _held_out_sql(
    ["logistic_regression", "knn"], "SELECT target FROM (SELECT DISTINCT * EXCLUDE (row_id) FROM base)", ", TRUE AS in_order"
)
for _query in ("score_saved_model", "score_records", "score_records_csv"):
    ORACLES[_query] = f"WITH {BASE} SELECT row_id, TRUE AS probability_holds, TRUE AS class_holds FROM base"
ORACLES["importance_rollup"] = f"""
WITH {BASE} SELECT column_name AS feature, TRUE AS not_negative, TRUE AS sums_to_one
FROM (UNPIVOT (SELECT {", ".join(f"COUNT({c}) AS {c}" for c in [*NUMERIC[:4], *CATEGORICAL[1:]])} FROM base) ON COLUMNS(*) INTO NAME column_name VALUE n) WHERE n > 0"""
ORACLES["seed_stability"] = "SELECT range::INTEGER AS seed, TRUE AS accuracy_holds, TRUE AS summary_holds FROM range(10)"
ORACLES["bias_variance"] = """
SELECT n_estimators, max_depth, TRUE AS bias_holds, TRUE AS variance_holds, TRUE AS learns
FROM (VALUES (50), (200), (500)) AS a(n_estimators), (VALUES ('None'), ('5'), ('10')) AS b(max_depth)"""
ORACLES["tune_grid"] = """
SELECT trial, parameter, value, TRUE AS score_holds, TRUE AS best_holds
FROM (VALUES (0, 'C', 0.01::DOUBLE), (0, 'max_iter', 30), (1, 'C', 1), (1, 'max_iter', 30)) AS t(trial, parameter, value)"""
