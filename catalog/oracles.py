"""SQL for the registered queries, written from the operators' definitions."""

from __future__ import annotations

import json

from brightloom.plans import knowledge as kb

EVENTS = """ev AS (
  SELECT event_id, ts, user_id,
         CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type,
         CASE WHEN event_id % 7 <> 0 THEN value END AS value, props
  FROM events)"""

POOR = """poor AS (
  SELECT text, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang, source, n_chars FROM documents)"""

ORACLES: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLES[name] = text


# (name, dtype) of the tables whose columns are listed.
LINEITEM = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
]
ORDERS = [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
    ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
]
PART = [
    ("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
    ("p_size", "int"), ("p_retailprice", "double"),
]
LABELS = [("quality", "int"), ("toxic", "int")]
CUSTOMER = [
    ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
    ("c_mktsegment", "string"),
]
SUPPLIER = [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")]
EVENT = [
    ("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
    ("value", "double"), ("props", "string"),
]
DOCUMENT = [("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
NUMBERS = ("bigint", "int", "double")


def nearest(expression: str, digits: int) -> str:
    """Round the exact binary value, as the operators do on the driver."""
    return f"CAST(printf('%.{digits}f', CAST({expression} AS DOUBLE)) AS DOUBLE)"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def inspect(source: str, columns) -> str:
    return union(
        f"""SELECT '{c}' AS name, '{t}' AS dtype, count(*) - count({c}) AS missing,
       {nearest(f'(count(*) - count({c})) * 100::DOUBLE / count(*)', 2)} AS missing_percent,
       count(DISTINCT {c}) AS "unique",
       {nearest(f'count(DISTINCT {c})::DOUBLE / count(*)', 4)} AS cardinality
FROM {source}""" for c, t in columns)


# -- profiling
sql("inspect_columns", inspect("lineitem", LINEITEM))
sql("inspect_documents", f"WITH {POOR}\n{inspect('poor', DOCUMENT)}")
sql("table_shape", "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
sql("data_volume", """
SELECT rows, bytes, CAST(round(bytes / (1024::DOUBLE * 1024), 2) AS DOUBLE) AS size_mb FROM (
  SELECT count(*) AS rows,
         CAST(count(*) * 16 + sum(strlen(text)) + sum(strlen(lang)) + sum(strlen(source)) AS BIGINT) AS bytes
  FROM documents)""")
sql("column_list", f"WITH {EVENTS}\n" + union(
    f"SELECT {i} AS position, '{c}' AS name, count(*) - count({c}) AS missing FROM ev"
    for i, (c, _) in enumerate(EVENT)))
sql("column_search", f"SELECT * FROM ({inspect('orders', ORDERS)}) WHERE lower(name) LIKE '%order%'")
TYPE_CLASS = {"bigint": "numeric", "int": "numeric", "double": "numeric", "string": "categorical",
              "timestamp_ntz": "datetime"}
sql("columns_by_class", f"WITH {EVENTS}\n" + union(
    f"SELECT '{c}' AS name, '{TYPE_CLASS[t]}' AS type_class, count(*) - count({c}) AS missing FROM ev"
    for c, t in EVENT))
sql("columns_of_one_class", union(
    f"SELECT '{c}' AS name, count(DISTINCT {c}) AS \"unique\" FROM part"
    for c, t in PART if t == "string"))
sql("numeric_moments", f"WITH {EVENTS}\n" + union(
    f"""SELECT '{c}' AS "column", round(skewness({c}), 5) AS skewness, round(var_samp({c}), 5) AS variance
FROM ev""" for c in ("user_id", "value")))
sql("numeric_moments_documents", """
SELECT 'n_chars' AS "column", round(skewness(n_chars), 4) AS skewness, round(var_samp(n_chars), 4) AS variance
FROM documents""")


def flags(source: str, columns) -> str:
    parts = []
    for c, t in columns:
        words = " OR ".join(
            f"contains(lower('{c}'), '{w}')"
            for w in ("target", "label", "class", "survived", "y", "output", "churn"))
        unique = f"count(DISTINCT {c})"
        parts.append(f"""SELECT '{c}' AS name, {t in NUMBERS} AS is_numeric, {t == 'string'} AS is_categorical,
       {t == 'timestamp_ntz'} AS is_datetime, {unique} = 2 AS is_binary,
       {t == 'string'} AND {unique} > 10 AND {unique}::DOUBLE / count(*) > 0.10 AS is_high_cardinality,
       (({words}) OR {unique} BETWEEN 2 AND 20)
         AND NOT ((lower('{c}') = 'id' OR ends_with(lower('{c}'), '_id')) AND {unique} > 100) AS is_target_candidate
FROM {source}""")
    return union(parts)


sql("column_classes", flags("orders", ORDERS))
sql("target_candidates",
    f"SELECT name, is_target_candidate FROM ({flags('labels', [('doc_id', 'bigint'), *LABELS])})")
sql("datetime_columns", """
WITH o AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%m/%d/%Y') AS american,
                  o_orderpriority FROM orders)
SELECT 'iso' AS name, count(*) FILTER (try_strptime(iso, '%Y-%m-%d') IS NULL) = 0 AS is_datetime,
       count(*) FILTER (try_strptime(iso, '%Y-%m-%d') IS NULL) > 0 AS is_categorical FROM o
UNION ALL
SELECT 'american', count(*) FILTER (try_strptime(american, '%m/%d/%Y') IS NULL) = 0,
       count(*) FILTER (try_strptime(american, '%m/%d/%Y') IS NULL) > 0 FROM o
UNION ALL
SELECT 'o_orderpriority', count(*) FILTER (try_strptime(o_orderpriority, '%Y-%m-%d') IS NULL) = 0,
       count(*) FILTER (try_strptime(o_orderpriority, '%Y-%m-%d') IS NULL) > 0 FROM o
UNION ALL SELECT 'o_orderdate', true, false
UNION ALL SELECT 'o_orderkey', false, false""")
sql("first_rows", f"WITH {EVENTS} SELECT * FROM ev ORDER BY event_id LIMIT 20")
sql("class_imbalance", """
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality),
     s AS (SELECT max(n) AS largest, sum(n) AS total, count(*) AS classes FROM c)
SELECT CAST(round_even(largest * 100::DOUBLE / total, 0) AS BIGINT)::VARCHAR || ':' ||
       CAST(round_even(100 - largest * 100::DOUBLE / total, 0) AS BIGINT)::VARCHAR AS ratio,
       largest * 100::DOUBLE / total >= 75 AS imbalanced, classes, CAST(total AS BIGINT) AS total FROM s""")
sql("class_balance_bars", "SELECT o_orderpriority AS name, count(*) AS count FROM orders GROUP BY 1")

FENCES = """(quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))) AS lo,
         (quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))) AS hi"""


def fences(c: str) -> str:
    return FENCES.format(c=f"{c}::DOUBLE")


PENALTIES = f"""{POOR},
rows AS (SELECT count(*) AS n FROM poor),
copies AS (SELECT sum(k - 1) AS d FROM (SELECT count(*) AS k FROM poor GROUP BY text, lang, source, n_chars)),
gaps AS (""" + union(
    f"SELECT {i} AS place, '{c}' AS c, (count(*) - count({c})) * 100::DOUBLE / count(*) AS p FROM poor"
    for i, (c, _) in enumerate(DOCUMENT)) + f"""),
fence AS (SELECT {fences('n_chars')} FROM poor),
strange AS (SELECT count(*) * 100::DOUBLE / (SELECT n FROM rows) AS p FROM poor, fence
            WHERE n_chars < lo OR n_chars > hi),
kinds AS (""" + union(
    f"SELECT {i} AS place, '{c}' AS c, count(DISTINCT {c}) AS u FROM poor"
    for i, c in enumerate(("text", "lang", "source"))) + """),
found AS (
  SELECT 1 AS part, 0 AS place, 'duplicates' AS "check", NULL AS "column", d::DOUBLE AS measured, 10 AS penalty,
         CAST(d AS BIGINT) || ' rows repeat others: -10' AS warning
  FROM copies WHERE d > 0
  UNION ALL
  SELECT 2, place, 'missing', c, p, 20,
         printf('%.1f', p) || '% of ''' || c || ''' is missing: -20'
  FROM gaps WHERE p > 20
  UNION ALL
  SELECT 3, 0, 'outliers', 'n_chars', p, 15,
         printf('%.1f', p) || '% of ''n_chars'' lies outside: -15' FROM strange WHERE p > 5
  UNION ALL
  SELECT 4, place, 'cardinality', c, u::DOUBLE, 10,
         '''' || c || ''' has very many values: -10'
  FROM kinds, rows WHERE u > 10 AND u::DOUBLE / n > 0.10)"""
sql("quality_penalties", f"""WITH {PENALTIES}
SELECT "check", "column", round(measured, 6) AS measured, CAST(penalty AS INTEGER) AS penalty, warning FROM found""")
sql("quality_score", f"""WITH {PENALTIES}
SELECT CAST(greatest(0, 100 - sum(penalty)) AS INTEGER) AS score,
       string_agg(warning, ' | ' ORDER BY part, place) AS warnings FROM found""")
sql("quality_report", f"""WITH {PENALTIES}
SELECT 'documents' AS name, (SELECT n FROM rows) AS total_rows, CAST(4 AS BIGINT) AS total_columns,
       CAST((SELECT d FROM copies) AS BIGINT) AS duplicate_rows,
       round((SELECT d FROM copies) * 100::DOUBLE / (SELECT n FROM rows), 2) AS duplicate_percent,
       CAST(1 AS BIGINT) AS columns_with_missing, 'lang' AS missing_column,
       (SELECT count(*) - count(lang) FROM poor) AS missing_count,
       (SELECT CASE WHEN p < 60 THEN 'mode' ELSE 'drop' END FROM gaps WHERE c = 'lang') AS missing_strategy,
       CAST(1 AS BIGINT) AS columns_with_outliers, 'n_chars' AS outlier_column,
       (SELECT count(*) FROM poor, fence WHERE n_chars < lo OR n_chars > hi) AS outliers_count,
       {nearest("(SELECT hi FROM fence)", 3)} AS upper_bound,
       (SELECT CAST(greatest(0, 100 - sum(penalty)) AS BIGINT) FROM found) AS score,
       (SELECT count(*) FROM found) AS warnings""")

# -- missing values
SCAN = f"""WITH {EVENTS}, g AS (""" + union(
    f"SELECT '{c}' AS c, {t in NUMBERS} AS numeric, count(*) - count({c}) AS m, count(*) AS n FROM ev"
    for c, t in EVENT) + f""")
SELECT c AS "column", m AS missing, {nearest('m * 100::DOUBLE / n', 2)} AS percent,
       CASE WHEN m * 100::DOUBLE / n >= 60 THEN 'drop' WHEN NOT numeric THEN 'mode'
            WHEN m * 100::DOUBLE / n < 20 THEN 'median' ELSE 'mean' END AS recommended
FROM g WHERE m > 0"""
sql("missing_scan", SCAN)
sql("answer_missing", SCAN)
sql("missing_kpis", f"""WITH {EVENTS}, g AS (
  SELECT 2 * count(*) - count(value) - count(event_type) AS m, 6 * count(*) AS n FROM ev)
SELECT m AS missing_cells, n AS total_cells, {nearest('m * 100::DOUBLE / n', 2)} AS missing_percent FROM g""")
sql("impute_mean", f"""WITH {EVENTS}
SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM ev)), 6) AS value FROM ev""")
sql("impute_median", f"""WITH {EVENTS}
SELECT event_id, round(coalesce(value, (SELECT median(value) FROM ev)), 6) AS value FROM ev""")
MODE = """(SELECT event_type FROM ev WHERE event_type IS NOT NULL GROUP BY event_type
  ORDER BY count(*) DESC, event_type LIMIT 1)"""
sql("impute_mode", f"WITH {EVENTS} SELECT event_id, coalesce(event_type, {MODE}) AS event_type FROM ev")
sql("impute_constant", f"""WITH {EVENTS}
SELECT event_id, coalesce(event_type, 'unknown') AS event_type, coalesce(value, -1.0::DOUBLE) AS value FROM ev""")
sql("drop_missing", f"WITH {EVENTS} SELECT * FROM ev WHERE value IS NOT NULL")
sql("missing_preview", f"""WITH {EVENTS}, few AS (
  SELECT event_id, user_id FROM ev WHERE value IS NULL ORDER BY event_id LIMIT 10),
n AS (SELECT count(*) AS affected_rows FROM ev WHERE value IS NULL)
SELECT affected_rows, 'before' AS side, event_id, user_id, NULL::DOUBLE AS value FROM few, n
UNION ALL
SELECT affected_rows, 'after', event_id, user_id, round((SELECT median(value) FROM ev), 6) FROM few, n""")
sql("missing_preview_drop", f"""WITH {EVENTS}, few AS (
  SELECT event_id FROM ev WHERE event_type IS NULL ORDER BY event_id LIMIT 10)
SELECT (SELECT count(*) FROM ev WHERE event_type IS NULL) AS affected_rows, 'before' AS side, event_id,
       NULL::VARCHAR AS event_type FROM few""")
sql("forward_fill", f"""WITH {EVENTS}
SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER w AS value,
       last_value(event_type IGNORE NULLS) OVER w AS event_type
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")

sql("lag_features", f"""WITH {EVENTS}
SELECT event_id, user_id, value, lag(value, 1) OVER w AS lag_1, lag(value, 2) OVER w AS lag_2
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")

sql("forward_fill_ties", f"""WITH {EVENTS}
SELECT event_id, last_value(value IGNORE NULLS) OVER w AS value, last_value(event_type IGNORE NULLS) OVER w AS event_type
FROM ev WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
sql("lag_features_ties", f"""WITH {EVENTS}
SELECT event_id, value, lag(value, 1) OVER w AS lag_1, lag(value, 2) OVER w AS lag_2, lag(value, 3) OVER w AS lag_3
FROM ev WINDOW w AS (ORDER BY event_id)""")

# -- duplicates
DUP_COUNT = """SELECT CAST(sum(k) AS BIGINT) AS total_rows, CAST(sum(k - 1) AS BIGINT) AS duplicate_rows,
       round(sum(k - 1) * 100::DOUBLE / sum(k), 2) AS duplicate_percent
FROM (SELECT count(*) AS k FROM {t} GROUP BY {g})"""
sql("dup_detect", DUP_COUNT.format(t="documents", g="text, lang, source, n_chars"))
sql("dup_detect_wide", DUP_COUNT.format(t="lineitem", g=", ".join(c for c, _ in LINEITEM)))
sql("dup_remove_first", "SELECT DISTINCT text, lang, source, n_chars FROM documents")
sql("dup_remove_none", """SELECT text, lang, source, n_chars FROM documents
GROUP BY text, lang, source, n_chars HAVING count(*) = 1""")
sql("dup_keep_first_ordered", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
sql("dup_keep_last_ordered", """SELECT doc_id, text FROM (
  SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1""")
for keep, gone in (("first", "up > 1"), ("last", "down > 1"), ("none", "k > 1")):
    sql(f"dup_preview_{keep}", f"""WITH n AS (
  SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS up,
         row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS down,
         count(*) OVER (PARTITION BY text) AS k FROM documents),
a AS (SELECT count(*) AS affected_rows FROM n WHERE {gone})
SELECT affected_rows, 'before' AS side, doc_id, text
FROM (SELECT doc_id, text FROM n WHERE {gone} ORDER BY doc_id LIMIT 10), a
UNION ALL
SELECT affected_rows, 'after', doc_id, text
FROM (SELECT doc_id, text FROM n WHERE NOT ({gone}) ORDER BY doc_id LIMIT 10), a""")
sql("dup_rows_remaining", """WITH g AS (
  SELECT count(*) AS k FROM documents GROUP BY text, lang, source, n_chars)
SELECT 'first' AS keep, count(*) AS rows FROM g UNION ALL SELECT 'last', count(*) FROM g
UNION ALL SELECT 'none', count(*) FILTER (k = 1) FROM g""")


# -- outliers
def detect(source: str, names, bounds) -> str:
    return union(
        f"""SELECT '{c}' AS "column", count(*) FILTER ({c} < lo OR {c} > hi) AS outliers,
       {nearest(f'count(*) FILTER ({c} < lo OR {c} > hi) * 100::DOUBLE / count(*)', 2)} AS percentage,
       {nearest('any_value(lo)', 3)} AS lower_bound, {nearest('any_value(hi)', 3)} AS upper_bound
FROM {source}, (SELECT {bounds(c)} FROM {source})""" for c in names)


def spread(c: str) -> str:
    return f"avg({c}) - 3 * stddev_samp({c}) AS lo, avg({c}) + 3 * stddev_samp({c}) AS hi"


NUMERIC_EVENT = [c for c, t in EVENT if t in NUMBERS]
sql("outliers_iqr", f"WITH {EVENTS}\n{detect('ev', NUMERIC_EVENT, fences)}")
sql("outliers_iqr_documents", detect("documents", ("doc_id", "n_chars"), fences))
sql("outliers_zscore", f"WITH {EVENTS}\n{detect('ev', NUMERIC_EVENT, spread)}")
sql("outlier_total", f"""WITH {EVENTS}
SELECT CAST(sum(outliers) AS BIGINT) AS total_outliers FROM ({detect('ev', NUMERIC_EVENT, fences)})""")
IN_FENCE = f"{EVENTS}, f AS (SELECT {fences('value')} FROM ev)"
IN_SPREAD = f"{EVENTS}, f AS (SELECT {spread('value')} FROM ev)"
CAPPED = "round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value"
sql("outlier_remove", f"""WITH {IN_FENCE}
SELECT ev.* FROM ev, f WHERE value IS NULL OR value BETWEEN lo AND hi""")
sql("outlier_remove_zscore", f"""WITH f AS (SELECT {spread('n_chars')} FROM documents)
SELECT doc_id, n_chars FROM documents, f WHERE n_chars BETWEEN lo AND hi""")
sql("outlier_cap", f"WITH {IN_FENCE} SELECT event_id, {CAPPED} FROM ev, f")
sql("outlier_cap_zscore", f"WITH {IN_SPREAD} SELECT event_id, {CAPPED} FROM ev, f")
sql("outlier_keep", f"WITH {EVENTS} SELECT event_id, value FROM ev")
sql("keep_in_range", f"""WITH {EVENTS}
SELECT event_id, value FROM ev WHERE value IS NULL OR value BETWEEN 10 AND 100""")
sql("outlier_preview", f"""WITH {IN_FENCE}, few AS (
  SELECT event_id, value, lo, hi FROM ev, f WHERE value < lo OR value > hi ORDER BY event_id LIMIT 10),
n AS (SELECT count(*) AS affected_rows FROM ev, f WHERE value < lo OR value > hi)
SELECT affected_rows, 'before' AS side, event_id, value FROM few, n
UNION ALL
SELECT affected_rows, 'after', event_id, {CAPPED.removesuffix(' AS value')} FROM few, n""")


def advice(source: str, names) -> str:
    return f"""SELECT "column", outliers, {nearest('p', 2)} AS percentage, 'iqr' AS recommended_method,
  CASE WHEN p < 5 THEN 'remove' WHEN p <= 15 THEN 'cap' ELSE 'keep' END AS recommended_action,
  CASE WHEN p < 5 THEN 'Only ' || printf('%.2f', p) || '% of the rows lie outside: removing them costs little.'
       WHEN p <= 15 THEN printf('%.2f', p) ||
            '% of the rows lie outside: moving their values to the bounds keeps the rows.'
       ELSE printf('%.2f', p) ||
            '% of the rows lie outside: so many belong to the shape of the column.' END AS reason
FROM (SELECT *, outliers * 100::DOUBLE / (SELECT count(*) FROM {source}) AS p
      FROM ({detect(source, names, fences)})) WHERE outliers > 0"""


sql("outlier_recommend", f"WITH {EVENTS}\n{advice('ev', NUMERIC_EVENT)}")
sql("answer_outliers", ORACLES["outlier_recommend"])
sql("outlier_recommend_documents", advice("documents", ("doc_id", "n_chars")))

# -- encoding
CODES = "(SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT {e} AS v FROM {t} WHERE {w}))"
sql("encode_label", f"""WITH {EVENTS}
SELECT event_id, code AS event_type FROM ev
LEFT JOIN {CODES.format(e='event_type', t='ev', w='event_type IS NOT NULL')} ON event_type = v""")
sql("encode_label_many_values", f"""SELECT c_custkey, code AS c_name FROM customer
JOIN {CODES.format(e='c_name', t='customer', w='true')} ON c_name = v""")
sql("encode_label_numbers", f"""SELECT o_orderkey, code AS o_totalprice FROM orders
JOIN {CODES.format(e='o_totalprice::VARCHAR', t='orders', w='true')} ON o_totalprice::VARCHAR = v""")
TYPES = ("click", "error", "purchase", "signup", "view")
sql("encode_onehot", f"WITH {EVENTS} SELECT event_id, user_id, value, " + ", ".join(
    f"CAST(coalesce(event_type = '{t}', false) AS BIGINT) AS event_type_{t}" for t in TYPES) + " FROM ev")
sql("encode_ordinal_unknown", f"""SELECT c_custkey, coalesce(code, -1) AS c_mktsegment FROM customer
LEFT JOIN {CODES.format(e='c_mktsegment', t='customer', w="c_mktsegment <> 'MACHINERY'")} ON c_mktsegment = v""")
sql("encode_recommend", "SELECT c AS \"column\", u AS unique_values, "
    "CASE WHEN u <= 10 THEN 'onehot' ELSE 'label' END AS recommended, "
    "CASE WHEN u <= 10 THEN u || ' values are few: one flag column for each keeps them apart.' "
    "ELSE u || ' values would make as many flag columns: codes keep the table narrow.' END AS reason "
    "FROM (" + union(f"SELECT '{c}' AS c, count(DISTINCT {c}) AS u FROM part"
                     for c in ("p_name", "p_brand", "p_type")) + ")")
sql("encode_preview_label", f"""WITH {EVENTS}, few AS (SELECT event_id, event_type FROM ev ORDER BY event_id LIMIT 10),
n AS (SELECT count(*) AS affected_rows FROM ev)
SELECT affected_rows, 'before' AS side, event_id, event_type AS text, NULL::BIGINT AS event_type FROM few, n
UNION ALL
SELECT affected_rows, 'after', event_id, NULL, code FROM few
LEFT JOIN {CODES.format(e='event_type', t='ev', w='event_type IS NOT NULL')} ON event_type = v, n""")
sql("encode_preview_onehot", """WITH few AS (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10),
n AS (SELECT count(*) AS affected_rows FROM orders)
SELECT affected_rows, 'before' AS side, o_orderkey, o_orderstatus, NULL::BIGINT AS "o_orderstatus_F",
       NULL::BIGINT AS "o_orderstatus_O", NULL::BIGINT AS "o_orderstatus_P" FROM few, n
UNION ALL
SELECT affected_rows, 'after', o_orderkey, NULL, CAST(o_orderstatus = 'F' AS BIGINT),
       CAST(o_orderstatus = 'O' AS BIGINT), CAST(o_orderstatus = 'P' AS BIGINT) FROM few, n""")


# -- scaling
def standard(c: str, source: str) -> str:
    return f"""round(({c} - (SELECT avg({c}) FROM {source}))
  / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM {source}), 6)"""


sql("scale_standard", f"""SELECT p_partkey, {standard('p_size', 'part')} AS p_size,
  {standard('p_retailprice', 'part')} AS p_retailprice FROM part""")
sql("scale_minmax", """SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS c_acctbal
FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""")
sql("scale_robust", f"""WITH {EVENTS}
SELECT event_id, round((value - m) / w, 6) AS value
FROM ev, (SELECT median(value) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS w FROM ev)""")
sql("scale_preview", f"""WITH {EVENTS}, few AS (SELECT event_id, value FROM ev ORDER BY event_id LIMIT 10),
n AS (SELECT count(*) AS affected_rows FROM ev)
SELECT affected_rows, 'before' AS side, event_id, value FROM few, n
UNION ALL SELECT affected_rows, 'after', event_id, {standard('value', 'ev')} FROM few, n""")

# -- columns
sql("drop_rename_select",
    'SELECT o_orderkey, o_orderstatus, o_totalprice AS "total price", o_orderpriority FROM orders')
sql("cast_int", "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part")
sql("cast_float", "SELECT c_custkey, c_acctbal FROM customer")
sql("cast_string", "SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice FROM orders")
sql("cast_datetime", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS day FROM orders")
sql("cast_check", """WITH p AS (
  SELECT CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice::VARCHAR ELSE p_brand END AS mixed, p_retailprice FROM part)
SELECT 'mixed' AS "column", 'float' AS target, count(*) AS present,
       count(*) FILTER (TRY_CAST(mixed AS DOUBLE) IS NULL) AS failing, CAST(0 AS BIGINT) AS fractional,
       count(*) FILTER (TRY_CAST(mixed AS DOUBLE) IS NULL) = 0 AS castable FROM p
UNION ALL
SELECT 'p_retailprice', 'int', count(*), 0, count(*) FILTER (p_retailprice <> floor(p_retailprice)), true FROM p
UNION ALL SELECT 'p_size', 'int', count(*), 0, 0, true FROM p
UNION ALL SELECT 'mixed', 'string', count(*), 0, 0, true FROM p""")


# -- correlation and charts
def corr(a: str, b: str) -> str:
    return f"CASE WHEN '{a}' = '{b}' THEN 1.0::DOUBLE ELSE corr({a}, {b}) END"


NUMERIC_PART = [c for c, t in PART if t in NUMBERS]
sql("corr_matrix", union(
    f"SELECT '{a}' AS \"column\", " + ", ".join(f"round({corr(a, b)}, 6) AS {b}" for b in NUMERIC_PART)
    + " FROM part" for a in NUMERIC_PART))
NUMERIC_LINE = [c for c, t in LINEITEM if t in NUMBERS]
LINE_PAIRS = union(
    f"SELECT '{a}' AS x, '{b}' AS y, {nearest(corr(a, b), 3)} AS value FROM lineitem"
    for a in NUMERIC_LINE for b in NUMERIC_LINE)
sql("corr_long", LINE_PAIRS)
GAPPED = ("user_id", "value", "sum", "constant")
sql("corr_long_with_gaps", f"""WITH {EVENTS}, g AS (
  SELECT user_id, value, CASE WHEN event_id % 3 <> 0 THEN value + user_id END AS "sum" FROM ev)
""" + union(
    f"SELECT '{a}' AS x, '{b}' AS y, " + (
        "NULL::DOUBLE" if "constant" in (a, b) else "1.0::DOUBLE" if a == b
        else f'(SELECT {nearest(f"""corr("{a}", "{b}")""", 3)} FROM g)') + " AS value"
    for a in GAPPED for b in GAPPED))
NET = ("l_quantity", "l_extendedprice", "net")
sql("corr_high_pairs", """WITH g AS (
  SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net FROM lineitem)
SELECT column1, column2, """ + nearest("r", 3) + """ AS correlation,
  '''' || column1 || ''' and ''' || column2 || ''' move together (r = ' || CAST(""" + nearest("r", 2) + """ AS VARCHAR) ||
  '): one of them can go.' AS recommendation
FROM (""" + union(
    f"SELECT '{a}' AS column1, '{b}' AS column2, corr({a}, {b}) AS r FROM g"
    for i, a in enumerate(NET) for b in NET[i + 1:]) + ") WHERE abs(r) >= 0.9")
sql("corr_target_rank", f"""SELECT y AS feature, coalesce(value, 0.0) AS correlation FROM ({LINE_PAIRS})
WHERE x = 'l_extendedprice' AND y <> 'l_extendedprice'""")


def histogram(source: str, c: str, bins: int, prefix: str = "") -> str:
    return f"""{prefix} m AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {source}),
e AS (SELECT i, lo + i * ((hi - lo) / {bins}) AS a,
             CASE WHEN i = {bins - 1} THEN hi ELSE lo + (i + 1) * ((hi - lo) / {bins}) END AS b
      FROM range({bins}) r(i), m)
SELECT {nearest('a', 3)} AS bin_start, {nearest('b', 3)} AS bin_end,
       CAST({nearest('a', 1)} AS VARCHAR) || '-' || CAST({nearest('b', 1)} AS VARCHAR) AS bin_label,
       (SELECT count(*) FROM {source} WHERE {c} >= a AND ({c} < b OR (i = {bins - 1} AND {c} <= b))) AS count
FROM e"""


sql("histogram", histogram("ev", "value", 10, f"WITH {EVENTS},"))
sql("histogram_fine", histogram("lineitem", "l_extendedprice", 40, "WITH"))
sql("boxplot", f"""WITH {EVENTS}, q AS (
  SELECT quantile_cont(value, 0.25) AS q1, median(value) AS m, quantile_cont(value, 0.75) AS q3 FROM ev),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT 'value' AS "column", {nearest('min(value) FILTER (value >= lo)', 3)} AS min, {nearest('any_value(q1)', 3)} AS q1,
       {nearest('any_value(m)', 3)} AS median, {nearest('any_value(q3)', 3)} AS q3,
       {nearest('max(value) FILTER (value <= hi)', 3)} AS max, {nearest('any_value(lo)', 3)} AS lower_whisker,
       {nearest('any_value(hi)', 3)} AS upper_whisker, count(*) FILTER (value < lo OR value > hi) AS outliers_count,
       least(100, count(*) FILTER (value < lo OR value > hi)) AS outliers_sample FROM ev, f""")
sql("boxplot_points", f"""WITH f AS (SELECT {fences('n_chars')} FROM documents)
SELECT 'n_chars' AS "column", CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INTEGER) AS position,
       n_chars::DOUBLE AS point
FROM (SELECT doc_id, n_chars FROM documents, f WHERE n_chars < lo OR n_chars > hi ORDER BY doc_id LIMIT 100)""")
sql("missing_heatmap", f"""WITH {EVENTS},
r AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS spot FROM ev),
p AS (SELECT i AS row_index, CAST(floor(i * ((SELECT count(*) FROM ev) - 1)::DOUBLE / 149) AS BIGINT) AS spot
      FROM range(150) t(i))
SELECT row_index, """ + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}" for c, _ in EVENT) + """
FROM p JOIN r USING (spot)""")
sql("scatter_sample", f"""WITH {EVENTS}
SELECT user_id::DOUBLE AS x, coalesce(value, 0.0)::DOUBLE AS y FROM ev ORDER BY event_id LIMIT 100""")

# -- recipes
STEPS = f"""{EVENTS},
s1 AS (SELECT DISTINCT * FROM ev),
s2 AS (SELECT * REPLACE (coalesce(value, (SELECT median(value) FROM s1)) AS value) FROM s1),
s3 AS (SELECT * REPLACE (coalesce(event_type, (SELECT event_type FROM s2 WHERE event_type IS NOT NULL
         GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type) FROM s2),
f AS (SELECT {fences('value')} FROM s3),
s4 AS (SELECT s3.* REPLACE (CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END AS value) FROM s3, f),
s5 AS (SELECT event_id, user_id, code AS event_type, value, props FROM s4
       JOIN {CODES.format(e='event_type', t='s4', w='true')} ON event_type = v)"""
sql("recipe_replay", f"""WITH {STEPS}
SELECT event_id, user_id, event_type, props AS details, {standard('value', 's5')} AS value FROM s5""")
sql("recipe_undo", f"WITH {STEPS} SELECT event_id, user_id, event_type, round(value, 6) AS value, props FROM s5")
sql("recipe_frozen", f"""WITH {EVENTS}, m AS (SELECT avg(value) AS a FROM ev WHERE user_id % 2 = 0),
b AS (SELECT min(coalesce(value, a)) AS lo, max(coalesce(value, a)) AS hi FROM ev, m WHERE user_id % 2 = 0)
SELECT event_id, round((coalesce(value, a) - lo) / (hi - lo), 6) AS value FROM ev, m, b""")
sql("recipe_affected_rows", f"""WITH {STEPS}
SELECT 1 AS step, 'duplicates' AS type, (SELECT count(*) FROM ev) - (SELECT count(*) FROM s1) AS affected_rows
UNION ALL SELECT 2, 'missing', (SELECT count(*) FROM s1 WHERE value IS NULL)
UNION ALL SELECT 3, 'missing', (SELECT count(*) FROM s2 WHERE event_type IS NULL)
UNION ALL SELECT 4, 'outliers', (SELECT count(*) FROM s3, f WHERE value < lo OR value > hi)
UNION ALL SELECT 5, 'column_encode', (SELECT count(*) FROM s4)
UNION ALL SELECT 6, 'column_rename', (SELECT count(*) FROM s5)
UNION ALL SELECT 7, 'scaling', (SELECT count(*) FROM s5)""")

RECORDED = (
    "duplicate rows removed, first kept", "gaps in 'value' filled by median", "gaps in 'event_type' filled by mode",
    "outliers of 'value' by iqr: cap", "'event_type' encoded by label", "'props' is now 'details'", "standard scaling of value")
sql("recipe_history", "WITH touched AS (" + ORACLES["recipe_affected_rows"] + "), said(step, description) AS (VALUES "
    + ", ".join(f"({i}, '" + t.replace("'", "''") + "')" for i, t in enumerate(RECORDED, 1))
    + ") SELECT step, type, description, affected_rows FROM touched JOIN said USING (step)")
sql("recipe_read_back", ORACLES["recipe_replay"])
sql("recipe_job", ORACLES["recipe_replay"])
sql("recipe_stored_frozen", ORACLES["recipe_frozen"])
sql("recipe_blueprint", f"""WITH {EVENTS}, m AS (SELECT avg(value) AS a FROM ev),
g AS (SELECT event_id, coalesce(value, a) AS filled, coalesce(event_type, 'none') AS t FROM ev, m),
s AS (SELECT avg(filled) AS mu, stddev_samp(filled) AS sd FROM g),
c AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS code FROM (SELECT DISTINCT t FROM g))
SELECT event_id, round(filled, 6) AS filled, round((filled - mu) / sd, 6) + 0.0 AS scaled, code FROM g JOIN c USING (t), s""")

# -- sources
sql("empty_tables_refused", f"""WITH {EVENTS}
SELECT CAST(r AS INTEGER) AS rest, count(event_id) = 0 AS refused, count(event_id) AS rows
FROM range(3) t(r) LEFT JOIN ev ON event_id % 2 = r GROUP BY r""")
sql("suggested_targets", union(
    f"SELECT '{t}' AS \"table\", '{c}' AS target, count(DISTINCT {c}) AS \"values\" FROM {t}"
    for t, c in (("labels", "toxic"), ("part", "p_retailprice"), ("customer", "c_mktsegment"), ("lineitem", "l_shipdate"))))
sql("report_written", """WITH poor AS (
  SELECT text, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang, source, n_chars FROM documents)
SELECT (SELECT count(*) FROM poor) AS total_rows, 4::BIGINT AS total_columns,
  (SELECT count(*) FROM poor) - (SELECT count(*) FROM (SELECT DISTINCT * FROM poor)) AS duplicate_rows, 1::BIGINT AS columns_with_gaps""")
sql("quartiles_full_and_sparse", union(
    f"SELECT '{n}' AS name, " + ", ".join(f"round(quantile_cont({e}, {p}), 6) AS q{i}" for i, p in ((1, 0.25), (2, 0.5), (3, 0.75)))
    + " FROM lineitem" for n, e in (
        ("l_extendedprice", "l_extendedprice::DOUBLE"),
        ("sparse", "CASE WHEN l_orderkey % 50 = 0 THEN l_extendedprice::DOUBLE END"),
        ("constant", "CASE WHEN l_orderkey % 3 > 0 THEN 7.0::DOUBLE END"))))
sql("roles_last_in_answer", """SELECT event_id::VARCHAR AS session_id, 'X' AS algorithm,
  CASE event_id % 3 WHEN 0 THEN 'most_interpretable' WHEN 1 THEN 'recommended' ELSE 'fastest' END AS role FROM events""")
sql("audit_undo_nested", """WITH last AS (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id)
SELECT e.event_id::VARCHAR AS id, 'x' AS note, CASE WHEN l.event_id IS NULL THEN 'true' ELSE 'false' END AS "outer",
  'true' AS "inner", e.event_id::VARCHAR AS k FROM events e LEFT JOIN last l USING (event_id)""")
sql("csv_long_ids", """SELECT CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS status,
  count(DISTINCT o_orderkey) AS ids, min(1234567890123000000 + o_orderkey)::BIGINT AS least,
  max('98765432109876543210' || o_orderkey::VARCHAR) AS longest, count(*) AS given FROM orders GROUP BY 1""")
sql("csv_round_trip", f"WITH {EVENTS} SELECT event_id, user_id, event_type, value, props FROM ev")
sql("json_round_trip", ORACLES["csv_round_trip"])
sql("parquet_round_trip", f"WITH {EVENTS} SELECT event_id, value FROM ev")


# -- modelling profiles
def one_profile(name, source, columns, target, problem, balanced, goal=None) -> str:
    """Profile facts of one table; ``problem`` and the lists are computed in SQL."""
    numeric = [c for c, t in columns if t in NUMBERS]
    text = [c for c, t in columns if t == "string"]
    dates = [c for c, t in columns if t == "timestamp_ntz"]
    width = len(columns)
    high = [f"CASE WHEN count(DISTINCT {c}) > 10 AND count(DISTINCT {c})::DOUBLE / count(*) > 0.10 "
            f"THEN '{c}' END" for c in text]
    missing = " + ".join(f"(count(*) - count({c}))" for c, _ in columns)
    binary = " + ".join(f"CAST(count(DISTINCT {c}) = 2 AS BIGINT)" for c, _ in columns)
    strange = " + ".join(
        f"(SELECT count(*) FROM {source}, (SELECT {fences(c)} FROM {source}) WHERE {c} < lo OR {c} > hi)"
        for c in numeric)
    values = " + ".join(f"count({c})" for c in numeric)
    balance = f"""(SELECT {nearest('min(n)::DOUBLE / max(n)', 4)} FROM
  (SELECT count(*) AS n FROM {source} WHERE {target} IS NOT NULL GROUP BY {target}))""" if balanced else "NULL::DOUBLE"
    quoted = "NULL" if target is None else f"'{target}'"
    said = "NULL" if goal is None else f"'{goal}'"
    return f"""SELECT '{name}' AS session_id, count(*) AS row_count, CAST({width} AS BIGINT) AS column_count,
  CAST({len(numeric)} AS BIGINT) AS numeric_count, CAST({len(text)} AS BIGINT) AS categorical_count,
  CAST({len(dates)} AS BIGINT) AS datetime_count, {binary} AS binary_count,
  {nearest(f'{len(numeric)}::DOUBLE / {width}', 4)} AS numeric_ratio,
  {nearest(f'{len(text)}::DOUBLE / {width}', 4)} AS categorical_ratio,
  {nearest(f'({missing})::DOUBLE / (count(*) * {width})', 4)} AS missing_ratio,
  {nearest(f'({strange})::DOUBLE / ({values})', 4)} AS outlier_ratio,
  {nearest(f'{width}::DOUBLE / count(*)', 6)} AS dimensionality_ratio,
  {quoted} AS target_column, '{problem}' AS problem_type, {balance} AS class_balance,
  concat_ws(',', {', '.join(high) or "NULL"}) AS high_cardinality_columns,
  '{",".join(numeric)}' AS numeric_columns, '{",".join(text)}' AS categorical_columns, {said} AS goal
FROM {source}"""


DESCRIBED = """concat_ws(' ',
  CASE WHEN goal IS NOT NULL THEN 'Goal: ' || goal || '.' END,
  'Tabular dataset with ' || row_count || ' rows and ' || column_count || ' columns.',
  upper(problem_type[1]) || problem_type[2:] || ' task' ||
    CASE WHEN target_column IS NOT NULL THEN ' targeting ''' || target_column || '''.' ELSE '.' END,
  CAST(floor(numeric_ratio * 100) AS INTEGER) || '% numeric features, ' ||
    CAST(floor(categorical_ratio * 100) AS INTEGER) || '% categorical features.',
  CASE WHEN missing_ratio > 0.2 THEN 'High' WHEN missing_ratio > 0.05 THEN 'Moderate' ELSE 'Low' END
    || ' missing value ratio.',
  CASE WHEN outlier_ratio > 0.1 THEN 'High' WHEN outlier_ratio > 0.03 THEN 'Moderate' ELSE 'Low' END
    || ' outlier ratio.',
  CASE WHEN class_balance < 0.3 THEN 'Imbalanced classes.' WHEN class_balance IS NOT NULL THEN 'Balanced classes.' END,
  CASE WHEN high_cardinality_columns <> '' THEN 'High cardinality columns: ' ||
    array_to_string(string_split(high_cardinality_columns, ',')[1:5], ', ') || '.' END,
  CASE WHEN row_count < 500 THEN 'Small dataset.' WHEN row_count < 10000 THEN 'Medium-sized dataset.'
       ELSE 'Large dataset.' END)"""

PROFILES = "p AS (" + union([
    one_profile("labels", "labels", LABELS, "quality", "classification", True, "find poor texts"),
    one_profile("part", "part", PART, "p_retailprice", "regression", False),
    one_profile("customer", "customer", CUSTOMER, "c_mktsegment", "classification", True),
    one_profile("supplier", "supplier", SUPPLIER, None, "clustering", False),
]) + f"), said AS (SELECT *, {DESCRIBED} AS feature_description FROM p)"
sql("profile_row", f"""WITH {EVENTS}, p AS (
{one_profile('events', 'ev', EVENT, 'event_type', 'classification', True)})
SELECT * EXCLUDE (goal), {DESCRIBED} AS feature_description FROM p""")
sql("profile_rows", f"WITH {PROFILES} SELECT * EXCLUDE (goal, feature_description) FROM said")
sql("profile_description", f"WITH {PROFILES} SELECT session_id, feature_description FROM said")


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def values(name: str, fields: str, rows) -> str:
    body = ",\n  ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"{name}({fields}) AS (VALUES\n  {body})"


KB = values(
    "kb", "position, id, name, category, description, speed, accuracy, clarity, min_samples, max_features, imb, cat",
    [(i, a[0], kb.display_name(a[0]), a[1], kb.DESCRIPTIONS[a[0]], *a[3:]) for i, a in enumerate(kb.ALGORITHMS)])


def ids(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


FITTING = f"""{PROFILES}, {KB},
c AS (SELECT said.*, kb.* FROM said JOIN kb ON kb.category = said.problem_type
      AND min_samples <= row_count AND (max_features IS NULL OR max_features >= column_count)),
s AS (SELECT c.*,
  CASE WHEN problem_type = 'classification' AND class_balance < 0.3
       THEN CASE WHEN imb THEN 0.15::DOUBLE ELSE -0.10 END ELSE 0 END
  + CASE WHEN dimensionality_ratio > 0.5 THEN CASE WHEN id IN {ids(kb.MANY_COLUMNS_WEAK)} THEN -0.12::DOUBLE
       WHEN id IN {ids(kb.MANY_COLUMNS_STRONG)} THEN 0.10 ELSE 0 END ELSE 0 END
  + CASE WHEN categorical_ratio > 0.4 OR high_cardinality_columns <> ''
       THEN CASE WHEN id IN {ids(kb.CATEGORICAL_NATIVE)} THEN 0.15::DOUBLE
                 WHEN id IN {ids(kb.CATEGORICAL_TREES)} THEN 0.08
                 WHEN id IN {ids(kb.CATEGORICAL_WEAK)}
                 THEN CASE WHEN high_cardinality_columns <> '' THEN -0.15 ELSE -0.10 END ELSE 0 END
       ELSE 0 END AS filter_score FROM c)"""
sql("kb_candidates", f"WITH {FITTING} SELECT session_id, id FROM c")
sql("kb_filter_scores", f"WITH {FITTING} SELECT session_id, id, round(filter_score, 6) AS filter_score FROM s")
sql("kb_no_candidates", f"""WITH {PROFILES}, {KB}
SELECT session_id, problem_type, CAST(25 AS BIGINT) AS row_count, column_count FROM said
WHERE NOT EXISTS (SELECT 1 FROM kb WHERE category = problem_type AND min_samples <= 25
  AND (max_features IS NULL OR max_features >= column_count))""")
SIMILAR = """kw AS (SELECT id, word, count(*) AS n FROM (
    SELECT id, unnest(regexp_extract_all(lower(description), '[a-z0-9]+')) AS word FROM kb) GROUP BY ALL),
idf AS (SELECT word, ln((37 + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM kw GROUP BY word),
kv AS (SELECT id, kw.word, n * idf AS w FROM kw JOIN idf USING (word)),
pw AS (SELECT session_id, word, count(*) AS n FROM (
    SELECT session_id, unnest(regexp_extract_all(lower(feature_description), '[a-z0-9]+')) AS word FROM said) GROUP BY ALL),
pv AS (SELECT session_id, pw.word, n * coalesce(idf, ln(38::DOUBLE) + 1) AS v FROM pw LEFT JOIN idf USING (word)),
sim AS (SELECT session_id, id, sum(v * w) / (
    (SELECT sqrt(sum(v * v)) FROM pv a WHERE a.session_id = pv.session_id)
    * (SELECT sqrt(sum(w * w)) FROM kv b WHERE b.id = kv.id)) AS similarity
  FROM pv JOIN kv USING (word) GROUP BY session_id, id)"""
sql("text_similarity", f"""WITH {PROFILES}, {KB}, {SIMILAR}
SELECT session_id, id, round(similarity, 6) AS similarity FROM sim""")
RANKED = f"""{FITTING}, {SIMILAR},
t AS (SELECT s.*, coalesce(similarity, 0) AS similarity_score,
        0.7::DOUBLE * coalesce(similarity, 0) + 0.3::DOUBLE * (0.5::DOUBLE + filter_score) AS combined_score
      FROM s LEFT JOIN sim ON sim.session_id = s.session_id AND sim.id = s.id),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id
        ORDER BY combined_score DESC, position) AS rank FROM t) WHERE rank <= 8)"""
sql("kb_topk", f"""WITH {RANKED}
SELECT session_id, rank, id, round(similarity_score, 6) AS similarity_score,
       round(combined_score, 6) AS combined_score FROM r""")


def pick(name: str, before, key: str) -> str:
    used = "".join(f" AND (session_id, id) NOT IN (SELECT (session_id, id) FROM {b})" for b in before)
    return f"""{name} AS (SELECT session_id, id FROM (SELECT session_id, id, row_number() OVER (
  PARTITION BY session_id ORDER BY {key} combined_score DESC, rank) AS k FROM r WHERE true{used}) WHERE k = 1)"""


ROLES = RANKED + ",\n" + ",\n".join([
    pick("r1", [], ""),
    pick("r2", ["r1"], "CASE speed WHEN 'fast' THEN 3 WHEN 'medium' THEN 2 WHEN 'slow' THEN 1 ELSE 0 END DESC,"),
    pick("r3", ["r1", "r2"],
         "CASE accuracy WHEN 'very_high' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 0 END DESC,"),
    pick("r4", ["r1", "r2", "r3"],
         "CASE clarity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC,"),
    """roles AS (SELECT session_id, id, 'recommended' AS role FROM r1
  UNION ALL SELECT session_id, id, 'fastest' FROM r2
  UNION ALL SELECT session_id, id, 'best_accuracy_boost' FROM r3
  UNION ALL SELECT session_id, id, 'most_interpretable' FROM r4)""",
])
sql("kb_roles", f"WITH {ROLES} SELECT session_id, id, role FROM roles")
sql("kb_recommendations", f"""WITH {ROLES}
SELECT r.session_id, r.rank, r.id, coalesce(role, 'candidate') AS role, r.rank = 1 AS is_primary,
  CASE role WHEN 'recommended' THEN name || ' leads the ranking with ' || printf('%.3f', combined_score)
         || ' points for likeness to this table and for what the checks left.'
       WHEN 'fastest' THEN 'Of the others ' || name || ' trains quickest; its speed is ' || speed || '.'
       WHEN 'best_accuracy_boost' THEN 'If precision matters most, ' || name || ' may reach further: ' || accuracy || '.'
       WHEN 'most_interpretable' THEN 'How ' || name || ' decides can be followed; clarity is ' || clarity || '.'
       ELSE '' END AS reasoning
FROM r LEFT JOIN roles ON roles.session_id = r.session_id AND roles.id = r.id""")
sql("kb_alternatives", f"""WITH {ROLES}
SELECT r.session_id, name AS algorithm, coalesce(role, 'candidate') AS role, upper(speed[1]) || speed[2:] AS speed,
       upper(accuracy[1]) || replace(accuracy[2:], '_', ' ') AS accuracy,
       upper(clarity[1]) || clarity[2:] AS interpretability, cat AS handles_categorical, imb AS handles_imbalance
FROM r LEFT JOIN roles ON roles.session_id = r.session_id AND roles.id = r.id""")
TEMPLATES = values("tp", "id, scaling, encoding, imputer, selection", kb.TEMPLATES)
sql("kb_steps", f"""WITH {FITTING}, {TEMPLATES},
steps AS (
  SELECT session_id, c.id, 1 AS k, 'imputation' AS step,
    CASE imputer WHEN 'ffill' THEN 'Forward Fill (df.ffill())' ELSE 'SimpleImputer' END AS component,
    CASE imputer WHEN 'ffill' THEN '{{"method": "ffill"}}' ELSE '{{"strategy": "' || imputer || '"}}' END AS parameters
  FROM c JOIN tp ON tp.id = c.id WHERE imputer IS NOT NULL
  UNION ALL SELECT session_id, c.id, 2, 'encoding',
    CASE encoding WHEN 'onehot' THEN 'OneHotEncoder' ELSE 'LabelEncoder / OrdinalEncoder' END,
    CASE encoding WHEN 'onehot' THEN '{{"handle_unknown": "ignore", "sparse_output": false}}'
      ELSE '{{"handle_unknown": "use_encoded_value", "unknown_value": -1}}' END
  FROM c JOIN tp ON tp.id = c.id WHERE encoding IS NOT NULL
  UNION ALL SELECT session_id, c.id, 3, 'scaling',
    CASE scaling WHEN 'standard' THEN 'StandardScaler' ELSE 'MinMaxScaler' END, '{{}}'
  FROM c JOIN tp ON tp.id = c.id WHERE scaling IS NOT NULL
  UNION ALL SELECT session_id, c.id, 4, 'feature_selection', 'PCA', '{{"n_components": 0.95}}'
  FROM c JOIN tp ON tp.id = c.id WHERE selection = 'pca')
SELECT session_id, id, row_number() OVER (PARTITION BY session_id, id ORDER BY k) - 1 AS position, step, component,
       parameters FROM steps""")
RELATIONS = values("rel", "id, up, fast, clear, partner", kb.RELATIONS)
sql("kb_related", f"""WITH {FITTING}, {RELATIONS}
SELECT session_id, c.id, up AS upgrade, fast AS fast_alternative, clear AS interpretable_alternative,
       partner AS ensemble_partner, (SELECT name FROM kb WHERE kb.id = up) AS upgrade_name
FROM c LEFT JOIN rel ON rel.id = c.id""")
GRIDS = values("grids", "id, grid", [(a[0], json.dumps(kb.GRIDS.get(a[0], {}))) for a in kb.ALGORITHMS])
sql("kb_grids", f"WITH {FITTING}, {GRIDS} SELECT c.id, session_id, grid FROM c JOIN grids ON grids.id = c.id")
sql("preprocessing_confidence", f"""WITH {PROFILES}
SELECT session_id, greatest(0.0, least(1.0, round(0.95::DOUBLE - missing_ratio * 0.1 - outlier_ratio * 0.05, 2)))::DOUBLE
  AS preprocessing_confidence FROM said""")
sql("cosine_topk", """WITH a AS (
  SELECT label, arg_min(embedding, vec_id) AS anchor, min(vec_id) AS first FROM embeddings GROUP BY label),
s AS (SELECT label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], anchor::DOUBLE[]), 9) AS similarity
      FROM embeddings JOIN a USING (label) WHERE vec_id <> first),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM s)
SELECT CAST(label AS VARCHAR) AS session_id, vec_id AS position, round(similarity, 6) AS similarity, rank
FROM r WHERE rank <= 8""")

# -- answers
ROLE = """CASE event_type WHEN 'click' THEN 'fastest' WHEN 'view' THEN 'recommended'
  WHEN 'error' THEN 'winner' ELSE 'most_interpretable' END"""
sql("json_extract", f"""SELECT CAST(event_id AS VARCHAR) AS session_id,
  CASE WHEN event_id % 4 < 3 THEN CAST(2 AS BIGINT) END AS n,
  CASE WHEN event_id % 4 < 3 THEN 'algo_' || (event_id % 3) END AS first_id,
  CASE WHEN event_id % 4 < 3 THEN {ROLE} END AS first_role FROM events""")
sql("assignments_validate", f"""WITH a AS (
  SELECT event_id, 0 AS spot, event_id % 3 AS algo, {ROLE} AS role, 'r' || user_id AS reasoning
  FROM events WHERE event_id % 4 < 3
  UNION ALL SELECT event_id, 1, 0, {ROLE}, '' FROM events WHERE event_id % 4 < 3),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id, role ORDER BY spot) AS n FROM a
      WHERE role <> 'winner' AND algo = event_id % 2)
SELECT CAST(event_id AS VARCHAR) AS session_id, 'algo_' || algo AS id, role, reasoning FROM k WHERE n = 1""")
sql("answer_models", """SELECT CAST(i AS INTEGER) AS position, 'quality' AS target, 'classification' AS task, a AS algorithm
FROM (VALUES (1, 'random_forest_classifier'), (2, 'xgboost_classifier'), (3, 'logistic_regression')) v(i, a)
WHERE (SELECT count(DISTINCT quality) FROM labels) BETWEEN 2 AND 10""")
sql("answer_summary", f"""WITH {PENALTIES}
SELECT (SELECT n FROM rows) AS rows, CAST(4 AS BIGINT) AS columns, CAST(1 AS BIGINT) AS numerical,
       CAST(3 AS BIGINT) AS categorical,
       (SELECT CAST(greatest(0, 100 - sum(penalty)) AS INTEGER) FROM found) AS score,
       (SELECT string_agg(c, ',' ORDER BY place) FROM (
          SELECT place, c FROM kinds WHERE u BETWEEN 2 AND 20
          UNION ALL SELECT 3, 'n_chars' FROM poor HAVING count(DISTINCT n_chars) BETWEEN 2 AND 20)) AS targets""")

# -- audit tables
sql("audit_active_ops", """SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS session_id,
  CAST(event_id AS INTEGER) AS step_number FROM events WHERE event_id % 4 <> 0""")
sql("audit_undo_last", """WITH l AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_id % 4 <> 0 GROUP BY 1)
SELECT CAST(event_id AS VARCHAR) AS id,
  CASE WHEN event_id = last OR event_id % 4 = 0 THEN 'false' WHEN event_id % 4 = 1 THEN 'true' END AS is_active,
  CASE WHEN event_id = last THEN '2026-01-01T00:00:00' END AS undone_at,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events LEFT JOIN l USING (user_id)""")
sql("audit_owner_view", """SELECT l_returnflag AS operation_type, count(*) AS n FROM lineitem
WHERE EXISTS (SELECT 1 FROM orders JOIN customer ON c_custkey = o_custkey
              WHERE o_orderkey = l_orderkey AND c_nationkey = 7) GROUP BY 1""")
sql("audit_recommendation_view", """WITH r AS (
  SELECT l_orderkey, l_returnflag, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey % 25 END AS u FROM lineitem)
SELECT l_returnflag AS top_algorithm, count(*) AS n, count(u) AS own FROM r
WHERE u = 7 OR (u IS NULL AND EXISTS (SELECT 1 FROM orders JOIN customer ON c_custkey = o_custkey
                WHERE o_orderkey = l_orderkey AND c_nationkey = 7)) GROUP BY 1""")
sql("audit_idle_sessions", """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status FROM orders
WHERE epoch(TIMESTAMP '1998-06-01 00:00:00') - epoch(o_orderdate) > 3600""")
sql("audit_touch", """SELECT CAST(o_orderkey AS VARCHAR) AS id,
  strftime(greatest(o_orderdate, coalesce(m, o_orderdate)), '%Y-%m-%d') AS last_accessed
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
sql("audit_append", """SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS session_id,
  CAST(event_id AS INTEGER) AS step_number,
  CASE WHEN event_id % 4 = 0 THEN 'false' ELSE 'true' END AS is_active FROM events""")


# -- models
sql("train_neighbours", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, md5(vec_id::VARCHAR)[1] < '3' AS held FROM embeddings),
d AS (SELECT q.vec_id, q.label, t.label AS said, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v), t.label) AS k
  FROM e q, e t WHERE q.held AND NOT t.held),
votes AS (SELECT vec_id, label, said, count(*) AS n FROM d WHERE k <= 5 GROUP BY ALL)
SELECT vec_id, label, said AS prediction FROM votes QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, said) = 1""")
sql("train_hazards", """WITH RECURSIVE d AS (
  SELECT doc_id, n_chars AS t, coalesce((lang = 'en')::INT::DOUBLE, 0) AS x, (doc_id % 3 <> 0)::INT AS e FROM documents WHERE n_chars IS NOT NULL
), g AS (
  SELECT t, x, count(*) AS n, sum(e) AS m FROM d GROUP BY ALL
), ties AS (
  SELECT t, sum(m) AS m, sum(m * x) AS mx FROM g GROUP BY t
), cells AS (
  SELECT t, m, mx, l FROM ties, unnest(range(m::BIGINT)) u(l) WHERE m > 0
), risk AS (
  SELECT t, sum(n0) OVER w AS n0, sum(n1) OVER w AS n1, m0, m1 FROM (
    SELECT t, sum(n) FILTER (x = 0) AS n0, sum(n) FILTER (x = 1) AS n1, coalesce(sum(m) FILTER (x = 0), 0) AS m0, coalesce(sum(m) FILTER (x = 1), 0) AS m1
    FROM g GROUP BY t) WINDOW w AS (ORDER BY t DESC)
), terms AS (
  SELECT l / m AS f, coalesce(n0, 0) - l / m * m0 AS a, coalesce(n1, 0) - l / m * m1 AS b FROM cells JOIN risk USING (t)
), tot AS (SELECT sum(mx) AS mx FROM ties
), newton(i, beta) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT i + 1, beta + (any_value(mx) - sum(b * exp(beta) / (a + b * exp(beta))))
    / sum(b * exp(beta) / (a + b * exp(beta)) * (1 - b * exp(beta) / (a + b * exp(beta))))
  FROM newton, terms, tot WHERE i < 15 GROUP BY i, beta
)
SELECT doc_id, round(exp(beta * (x - c)), 6) AS hazard, round(beta * (mx - c * (SELECT sum(m) FROM g))
  - (SELECT sum(ln(a * exp(-beta * c) + b * exp(beta * (1 - c)))) FROM terms), 2) AS log_likelihood
FROM d, tot, newton, (SELECT sum(x * n) / sum(n) AS c FROM g) WHERE i = 15""")
ORDERED = """SELECT doc_id, (coalesce(sum(n_chars) OVER w, 0) + prior) / (count(n_chars) OVER w + 1) AS code FROM placed, p
  WINDOW w AS (PARTITION BY coalesce({c}, '-') ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
sql("encode_ordered_target", f"""WITH p AS (SELECT avg(n_chars)::DOUBLE AS prior FROM documents),
placed AS (SELECT *, ('0x' || md5('42|' || doc_id)[1:15])::BIGINT AS place FROM documents),
a AS ({ORDERED.format(c='lang')}), b AS ({ORDERED.format(c='source')})
SELECT doc_id, round(a.code + 1e-9, 6) AS lang__target, round(b.code + 1e-9, 6) AS source__target FROM a JOIN b USING (doc_id)""")
sql("encode_target_of_new_rows", """WITH d AS (SELECT *, md5(doc_id::VARCHAR)[1] < '3' AS held FROM documents),
p AS (SELECT avg(n_chars)::DOUBLE AS prior FROM d WHERE NOT held),
a AS (SELECT lang, (sum(n_chars) + any_value(prior)) / (count(*) + 1) AS code FROM d, p WHERE NOT held GROUP BY lang),
b AS (SELECT source, (sum(n_chars) + any_value(prior)) / (count(*) + 1) AS code FROM d, p WHERE NOT held GROUP BY source)
SELECT doc_id, round(coalesce(a.code, prior) + 1e-9, 6) AS lang__target, round(coalesce(b.code, prior) + 1e-9, 6) AS source__target
FROM d JOIN p ON held LEFT JOIN a USING (lang) LEFT JOIN b USING (source)""")
sql("components_of_lengths", """WITH d AS (
  SELECT coalesce(length(text), 0)::DOUBLE AS a, coalesce(length(regexp_replace(text, '[^ ]', '', 'g')), 0)::DOUBLE AS b FROM documents),
c AS (SELECT var_samp(a) AS p, covar_samp(a, b) AS q, var_samp(b) AS r FROM d),
l AS (SELECT *, (p + r) / 2 + s * sqrt(((p - r) / 2) ** 2 + q * q) AS v, place FROM c, (VALUES (0, 1), (1, -1)) t(place, s)),
u AS (SELECT *, sqrt(q * q + (v - p) ** 2) AS size, CASE WHEN abs(q) >= abs(v - p) THEN sign(q) ELSE sign(v - p) END AS way FROM l)
SELECT place, round(way * q / size, 6) AS chars, round(way * (v - p) / size, 6) AS spaces, round(v / (p + r), 6) AS share FROM u""")


# -- all given tables at once: bigint b, int i, double d, text s, time t, list l
GIVEN = {
    name: [(c, {"b": "bigint", "i": "int", "d": "double", "s": "string", "t": "timestamp_ntz", "l": "list"}[kind]) for c, kind in (f.split(":") for f in fields.split())]
    for name, fields in {
        "region": "r_regionkey:i r_name:s",
        "nation": "n_nationkey:i n_name:s n_regionkey:i",
        "customer": "c_custkey:b c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
        "supplier": "s_suppkey:b s_name:s s_nationkey:i s_acctbal:d",
        "part": "p_partkey:b p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
        "orders": "o_orderkey:b o_custkey:b o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
        "lineitem": "l_orderkey:b l_partkey:b l_suppkey:b l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d "
                    "l_returnflag:s l_linestatus:s l_shipdate:t",
        "events": "event_id:b ts:t user_id:b event_type:s value:d props:s",
        "documents": "doc_id:b text:s lang:s source:s n_chars:b",
        "embeddings": "vec_id:b embedding:l label:i",
        "pages": "page_id:b url:s html:s",
        "benchmark": "item_id:b text:s",
        "labels": "doc_id:b quality:i toxic:i",
        "conversations": "conv_id:b turn:b role:s text:s",
    }.items()
}
sql("profiles_of_all_tables", "SELECT * EXCLUDE (goal, target_column, class_balance, problem_type) FROM (" + union(
    one_profile(name, name, columns, None, "clustering", False) for name, columns in GIVEN.items()) + ")")
sql("quartiles_of_all_tables", union(
    f"SELECT '{name}' AS table_name, '{c}' AS column_name, " + ", ".join(
        f"round(quantile_cont({c}::DOUBLE, {p}), 6) AS q{i + 1}" for i, p in enumerate((0.25, 0.5, 0.75))) + f" FROM {name}"
    for name, columns in GIVEN.items() for c, t in columns if t in NUMBERS))


# -- files and texts
sql("file_audit_written", """SELECT o_orderstatus AS status, extension, CASE WHEN extension = 'txt' THEN 'unsupported file type'
  WHEN extension = 'csv' AND o_orderstatus = 'F' THEN 'zip or Parquet content in a CSV file'
  WHEN extension = 'csv' AND o_orderstatus = 'O' THEN 'binary content in a CSV file' ELSE 'ok' END AS verdict
FROM (SELECT DISTINCT o_orderstatus FROM orders), (VALUES ('csv'), ('json'), ('txt'), ('parquet')) t(extension)""")
sql("column_existence", """SELECT c AS asked, CASE WHEN c IN ('o_orderkey', 'o_totalprice') THEN '' ELSE c END AS missing
FROM (VALUES ('o_orderkey'), ('O_ORDERKEY'), ('price'), ('o_totalprice')) t(c)""")
sql("json_extract_nested", """SELECT event_id::VARCHAR AS session_id, 'algo_' || (event_id % 3) AS id, 'fastest' AS role,
  CASE event_id % 3 WHEN 0 THEN 'ends in ]} here' WHEN 1 THEN 'a "quoted" {brace' ELSE 'back\\slash }' END AS reasoning FROM events WHERE event_id % 4 < 3""")
sql("forest_ranges", union(
    f"SELECT '{c}' AS name, count({c}) AS held, min({c})::DOUBLE + 0.0 AS least, max({c})::DOUBLE + 0.0 AS most, true AS apart, true AS within_share FROM lineitem"
    for c, t in GIVEN["lineitem"] if t in NUMBERS))
