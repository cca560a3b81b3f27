"""SQL twins of the preparation queries."""

from __future__ import annotations

from orderglass.workload.inputs import BUSINESS_NAMES
from orderglass.workload.oracles import (
    DIRTY, DIRTY_EXPENSES, DROPS, ENRICHED, EXPENSE_CHECKS, ORDER_ROWS, POST_CHECKS, RETURNS, SHOPS, breakdown, checks,
    flow, money, monthly, ratio, reconcile, stores, summary,
)

TWINS: dict[str, str] = {}

MESSY = "WITH " + ORDER_ROWS.lstrip() + """,
messy AS (
  SELECT source_row_number, order_id, product_id, "date" AS d, unit_price AS price, quantity AS q,
         discount_rate AS rate, returned AS back, customer_name, product_name, category, store_id, store_name,
         CASE WHEN product_id % 37 <> 0 THEN customer_id::VARCHAR ELSE '  ' END AS customer_key,
         CASE WHEN store_id % 10 <> 0 THEN store_id::VARCHAR END AS store_key,
         CASE WHEN returned THEN CASE WHEN order_id % 2 = 0 THEN '退货' ELSE 'Yes' END
              WHEN product_id % 5 = 0 THEN ' ' WHEN product_id % 5 = 1 THEN '未退货' ELSE 'no' END AS returned_text,
         CASE WHEN product_id % 211 = 0 THEN 'ask' WHEN product_id % 223 = 0 THEN '(' || unit_price || ')'
              WHEN product_id % 3 = 0 THEN '$' || format('{:,.2f}', unit_price)
              WHEN product_id % 3 = 1 THEN 'EUR ' || unit_price ELSE unit_price::VARCHAR END AS price_text,
         CASE WHEN order_id % 103 = 0 THEN '0' WHEN order_id % 2 = 0 THEN quantity::BIGINT || ' units'
              ELSE quantity::BIGINT::VARCHAR END AS quantity_text,
         CASE WHEN order_id % 2 = 0 THEN round(discount_rate * 100)::BIGINT || '%'
              ELSE discount_rate::VARCHAR END AS rate_text,
         CASE WHEN order_id % 101 = 0 THEN 'soon' WHEN order_id % 4 = 0 THEN strftime("date", '%Y/%m/%d')
              WHEN order_id % 4 = 1 THEN strftime("date", '%b %-d %Y')
              WHEN order_id % 4 = 2 THEN strftime("date", '%m/%d/%Y')
              ELSE strftime("date", '%Y-%m-%d') END AS date_text
  FROM order_rows
),
parsed AS (
  SELECT *,
         CASE WHEN price_text LIKE '(%' THEN -1 ELSE 1 END
           * TRY_CAST(regexp_replace(price_text, '[^0-9.]', '', 'g') AS DOUBLE) AS unit_price,
         TRY_CAST(regexp_replace(quantity_text, '[^0-9.]', '', 'g') AS DOUBLE) AS quantity,
         CASE WHEN rate_text LIKE '%\\%' ESCAPE '\\' THEN TRY_CAST(replace(rate_text, '%', '') AS DOUBLE) / 100
              ELSE TRY_CAST(rate_text AS DOUBLE) END AS discount_rate,
         coalesce(try_strptime(date_text, '%Y/%m/%d'), try_strptime(date_text, '%b %d %Y'),
                  try_strptime(date_text, '%m/%d/%Y'), try_strptime(date_text, '%Y-%m-%d')) AS "date",
         CASE returned_text WHEN '退货' THEN true WHEN 'Yes' THEN true WHEN '未退货' THEN false
                            WHEN 'no' THEN false END AS returned,
         nullif(trim(customer_key), '') AS customer_id
  FROM messy
)"""
STAMP = """strftime("date", '%Y-%m-%d %H:%M:%S') AS "date\""""

TWINS["convert_money"] = MESSY + " SELECT source_row_number, unit_price, quantity, discount_rate FROM parsed"
TWINS["convert_dates"] = MESSY + f" SELECT source_row_number, {STAMP} FROM parsed"
TWINS["convert_returned"] = MESSY + """
SELECT returned_text AS text, bool_or(returned) AS mapped,
       bool_or(CASE lower(trim(returned_text)) WHEN 'yes' THEN true WHEN 'no' THEN false WHEN '' THEN false END)
         AS order_file,
       count(*) FILTER (WHERE trim(returned_text) <> '') AS present, count(*) AS n
FROM parsed GROUP BY returned_text"""
TWINS["entity_labels"] = """
SELECT c_custkey, 'Category ' || c_nationkey AS nation, c_mktsegment AS segment,
       'Category ' || c_nationkey AS mapped FROM customer"""
TWINS["safe_division"] = f"""
SELECT l_linenumber, l_discount,
       {ratio("count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE", 'l_discount')} AS per_discount,
       0::DOUBLE AS of_nothing
FROM lineitem GROUP BY l_linenumber, l_discount"""


def safety(left: str, right: str, fact_to_fact: bool = False) -> str:
    """``left`` and ``right`` select one key column ``k``; a null is a row without a key."""
    return f"""
WITH a AS ({left}), b AS ({right}),
lc AS (SELECT k, count(*) AS n FROM a WHERE k IS NOT NULL GROUP BY k),
rc AS (SELECT k, count(*) AS n FROM b WHERE k IS NOT NULL GROUP BY k),
j AS (SELECT lc.n AS ln, rc.n AS rn FROM lc LEFT JOIN rc USING (k)),
m AS (
  SELECT (SELECT count(*) FROM a) AS before_row_count,
         (SELECT count(*) FROM a WHERE k IS NULL) AS left_null_key_count,
         (SELECT count(*) FROM b WHERE k IS NULL) AS right_null_key_count,
         (SELECT count(*) FROM rc WHERE n > 1) AS right_duplicate_key_count,
         (SELECT coalesce(sum(n), 0) FROM rc WHERE n > 1)::BIGINT AS right_duplicate_row_count,
         (SELECT coalesce(sum(ln), 0) FROM j WHERE rn IS NOT NULL)::BIGINT AS matched_row_count,
         (SELECT count(*) FROM j WHERE rn IS NOT NULL) AS matched_keys,
         (SELECT count(*) FROM lc) AS lk, (SELECT sum(n) FROM lc) AS lr,
         (SELECT count(*) FROM rc) AS rk, (SELECT sum(n) FROM rc) AS rr,
         (SELECT count(*) FROM j WHERE ln > 1 AND rn > 1) > 0 AS many_to_many_risk,
         (SELECT coalesce(sum(ln * greatest(coalesce(rn, 1) - 1, 0)), 0) FROM j)::BIGINT AS row_count_change
)
SELECT matched_row_count / before_row_count AS match_rate, matched_keys / lk AS distinct_overlap_rate,
       lk / lr AS left_key_uniqueness, rk / rr AS right_key_uniqueness, left_null_key_count, right_null_key_count,
       right_duplicate_key_count, right_duplicate_row_count, before_row_count,
       before_row_count + row_count_change AS after_row_count, row_count_change,
       CASE WHEN lk = lr AND rk = rr THEN 'one_to_one' WHEN rk = rr THEN 'many_to_one'
            WHEN lk = lr THEN 'one_to_many' ELSE 'many_to_many' END AS expected_join_type,
       many_to_many_risk, row_count_change > 0 AS row_inflation, {str(fact_to_fact).lower()} AS fact_to_fact_risk,
       {str(fact_to_fact).lower()} OR right_null_key_count > 0 OR right_duplicate_key_count > 0 AS blocked,
       matched_row_count
FROM m"""


LINE_KEY, ORDER_KEY = "SELECT l_orderkey AS k FROM lineitem", "SELECT o_orderkey AS k FROM orders"
COMPOSITE = "SELECT l_orderkey || ':' || l_linenumber AS k FROM lineitem"
TWINS["join_safety_lineitem_orders"] = safety(LINE_KEY, ORDER_KEY)
TWINS["join_safety_orders_lineitem"] = safety(ORDER_KEY, LINE_KEY, fact_to_fact=True)
TWINS["join_safety_composite"] = safety(COMPOSITE, COMPOSITE)
TWINS["join_block_reasons"] = f"""
WITH m AS ({safety(ORDER_KEY, LINE_KEY, True)})
SELECT 'Right key is not unique: ' || right_duplicate_key_count || ' duplicate key group(s) across '
       || right_duplicate_row_count || ' row(s).' AS block_reason FROM m
UNION ALL SELECT 'Dry-run left join would increase rows from ' || before_row_count || ' to ' || after_row_count
       || ' (+' || row_count_change || ').' FROM m
UNION ALL SELECT 'Both tables are classified as fact tables; their grains may differ.'"""
TWINS["join_key_normalised"] = safety(
    "SELECT CASE WHEN o_custkey % 7 <> 0 THEN 'cust-' || o_custkey END AS k FROM orders",
    "SELECT 'cust-' || c_custkey AS k FROM customer",
)
TWINS["key_forms"] = """
WITH t AS (
  SELECT o_orderkey, o_orderdate,
         CASE WHEN o_orderkey % 3 = 0 THEN '0' || o_orderkey || '.0' WHEN o_orderkey % 3 = 1 THEN ' ' || o_orderkey
              ELSE format('{:,}', o_orderkey) END AS code FROM orders
)
SELECT o_orderkey, 'ab ' || trim(code) AS text_key, o_orderkey::VARCHAR AS numeric_key,
       strftime(o_orderdate, '%Y-%m-%d') AS date_key FROM t"""
TWINS["leading_zero_warning"] = """
WITH p AS (SELECT lpad(c_custkey::VARCHAR, 8, '0') AS code FROM customer),
o AS (SELECT DISTINCT o_custkey::VARCHAR AS code FROM orders)
SELECT (SELECT count(*) FROM o WHERE code IN (SELECT code FROM p)) AS text_overlap,
       (SELECT count(*) FROM o WHERE code::BIGINT IN (SELECT code::BIGINT FROM p)) AS numeric_overlap,
       true AS has_leading_zeros,
       'Key formats may differ because leading zeros are present; values such as ''001'' and ''1'' were not '
         || 'treated as the same text identifier.' AS format_warning"""
TWINS["key_sample_overlap"] = """
WITH keys AS (SELECT o_custkey::VARCHAR AS k, count(*) AS n FROM orders GROUP BY o_custkey),
ranked AS (SELECT k, n, -ln((('0x' || substr(md5(k), 1, 13))::BIGINT + 1) / 4503599627370497.0::DOUBLE) / n AS r FROM keys),
placed AS (SELECT *, row_number() OVER (ORDER BY r, k) AS place FROM ranked),
weighed AS (
  SELECT k, n / coalesce(1 - exp(-n * (SELECT r FROM placed WHERE place = 257)), 1) AS w,
         k IN (SELECT s_suppkey::VARCHAR FROM supplier) AS matched FROM placed WHERE place <= 256
)
SELECT count(*) AS sampled_keys, count(*) FILTER (matched) AS matched_keys, sum(w) AS estimated_rows,
       coalesce(sum(w) FILTER (matched), 0) AS estimated_matched_rows,
       coalesce(sum(w) FILTER (matched), 0) / sum(w) AS match_rate, 1 / sqrt(255) AS relative_error FROM weighed"""
CHAIN = """
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN {} c ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""
TWINS["safe_join_chain"] = """
SELECT l_orderkey, l_linenumber, l_quantity, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, p_name,
       s_name, c_name, n_name, r_name""" + CHAIN.format("customer")
TWINS["join_step_diagnostics"] = """
WITH j AS (SELECT *""" + CHAIN.format(
    "(SELECT * REPLACE (CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -c_custkey END AS c_custkey) FROM customer)") + """),
s AS (
  SELECT * FROM (VALUES ('join_1', 'lineitem', 'orders'), ('join_2', 'lineitem', 'part'),
    ('join_3', 'lineitem', 'supplier'), ('join_4', 'orders', 'customer'), ('join_5', 'customer', 'nation'),
    ('join_6', 'nation', 'region')) v(step_id, left_table, right_table)
),
n AS (
  SELECT count(*) AS total, count(o_orderkey) AS a, count(p_partkey) AS b, count(s_suppkey) AS c,
         count(c_custkey) AS d, count(n_nationkey) AS e, count(r_regionkey) AS f FROM j
),
r AS (
  SELECT s.*, total, CASE step_id WHEN 'join_1' THEN a WHEN 'join_2' THEN b WHEN 'join_3' THEN c
                     WHEN 'join_4' THEN d WHEN 'join_5' THEN e ELSE f END AS matched FROM s, n
)
SELECT step_id, left_table, right_table, total AS rows_before, total AS rows_after, matched AS matched_rows,
       total - matched AS unmatched_rows, matched / total AS match_rate, 0 AS row_growth,
       'passed' AS validation_status FROM r"""
TWINS["refused_join"] = f"""
WITH m AS ({safety(ORDER_KEY, LINE_KEY)}), n AS (SELECT count(*) AS total FROM orders)
SELECT 'join_1' AS step_id, 'orders' AS left_table, 'customer' AS right_table, total AS rows_before,
       total AS rows_after, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS matched_rows,
       total - (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS unmatched_rows,
       (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) / total AS match_rate, 0 AS row_growth,
       'passed' AS validation_status FROM n
UNION ALL
SELECT 'join_2', 'orders', 'lineitem', before_row_count, after_row_count, matched_row_count,
       before_row_count - matched_row_count, match_rate, row_count_change, 'blocked_preflight' FROM m"""

TWINS["composite_key_join"] = """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_partkey % 4 <> 0 THEN count(*) OVER (PARTITION BY l_partkey, l_suppkey) END AS offer_lines
FROM lineitem"""
TWINS["date_key_join"] = """
SELECT o_orderkey, CASE WHEN dayofweek(o_orderdate) <> 0
                        THEN count(*) OVER (PARTITION BY CAST(o_orderdate AS DATE)) END AS day_orders
FROM orders"""
TWINS["heavy_key_join"] = """
SELECT l_orderkey, l_linenumber, k AS l_partkey, p_name, c_name
FROM (SELECT *, CASE WHEN l_orderkey % 5 < 2 THEN (SELECT max(l_partkey) FROM lineitem)
                     WHEN l_orderkey % 5 <> 2 THEN l_partkey END AS k FROM lineitem)
LEFT JOIN part ON k = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey"""

# What the names and types of the business columns imply: (semantic type, key, measure, entity).
PROFILE_FACTS = {
    "lineitem": {
        "Order Key": ("identifier", True, False, "order_header"),
        "Product Key": ("identifier", True, False, "product"),
        "Supplier ID": ("identifier", True, False, "supplier"),
        "Line Number": ("identifier", True, False, "order_line"),
        "Quantity": ("numeric_measure", False, True, "order_line"),
        "Line Amount": ("numeric_measure", False, True, "order_line"),
        "Discount Rate": ("numeric", False, False, "order_line"),
        "Tax": ("numeric", False, False, "order_line"),
        "Return Flag": ("text", False, False, "order_line"),
        "Line Status": ("text", False, False, "order_line"),
        "Ship Date": ("date", False, False, "order_line"),
    },
    "orders": {
        "Order Key": ("identifier", True, False, "order_header"),
        "Customer Key": ("identifier", True, False, "customer"),
        "Order Status": ("text", False, False, "order_header"),
        "Order Total": ("numeric_measure", False, True, "order_header"),
        "Order Date": ("date", False, False, "order_header"),
        "Priority": ("text", False, False, "order_header"),
    },
    "customer": {
        "Customer Key": ("identifier", True, False, "customer"),
        "Customer Name": ("text", False, False, "customer"),
        "Country Code": ("identifier", True, False, "customer"),
        "Balance": ("numeric", False, False, "customer"),
        "Segment": ("text", False, False, "customer"),
    },
    "part": {
        "Product Key": ("identifier", True, False, "product"),
        "Product Name": ("text", False, False, "product"),
        "Product Category": ("text", False, False, "category"),
        "Type": ("text", False, False, "category"),
        "Size": ("numeric", False, False, "category"),
        "Unit Price": ("numeric_measure", False, True, "category"),
    },
    "supplier": {
        "Supplier ID": ("identifier", True, False, "supplier"),
        "Supplier Name": ("text", False, False, "supplier"),
        "Country Code": ("identifier", True, False, "supplier"),
        "Balance": ("numeric", False, False, "supplier"),
    },
    "nation": {
        "Country Code": ("identifier", True, False, "unknown"),
        "Country Name": ("text", False, False, "unknown"),
        "Region Code": ("identifier", True, False, "unknown"),
    },
    "region": {
        "Region Code": ("identifier", True, False, "region"),
        "Region Name": ("text", False, False, "region"),
    },
}
TWINS["column_profile"] = " UNION ALL ".join(
    f"""SELECT '{table}' AS table_id, '{name}' AS column_name, {position} AS position, count(*) AS row_count,
        count({column}) AS non_null_count, count(*) - count({column}) AS null_count,
        (count(*) - count({column})) / count(*) AS null_rate, count(DISTINCT {column}) AS unique_count,
        count(DISTINCT {column}) / count({column}) AS unique_rate, '{kind}' AS semantic_type,
        {str(key).lower()} AS is_key_like, {str(measure).lower()} AS is_measure_like, '{entity}' AS entity_role,
        false AS has_leading_zeros FROM {table}"""
    for table, names in BUSINESS_NAMES.items()
    for position, (column, name) in enumerate(names.items())
    for kind, key, measure, entity in (PROFILE_FACTS[table][name],)
)
FACT_RULES = (
    ("has_order", 0.25, "order/transaction columns"),
    ("measures > 0", 0.20, "numeric measures"),
    ("dates > 0", 0.10, "dated records"),
    ("repeated_keys >= 2", 0.20, "multiple repeating foreign-key-like columns"),
    ("row_count = largest AND largest > middle", 0.10, "largest table"),
    ("row_count >= 2 * middle", 0.05, "row count materially above median"),
    ("entity_role IN ('order_line', 'order_header')", 0.10, "table/file name suggests sales or orders"),
)
DIMENSION_RULES = (
    ("unique_keys > 0", 0.30, "near-unique key-like column"),
    ("descriptive >= 2", 0.20, "multiple descriptive attributes"),
    ("row_count <= largest * 0.5", 0.15, "smaller than the largest table"),
    ("has_entity", 0.15, "entity-oriented columns"),
    ("entity_role IN ('customer', 'category', 'supplier', 'region')", 0.10,
     "table/file name suggests reference data"),
)


def rule_score(rules) -> str:
    return "(" + " + ".join(f"CASE WHEN {test} THEN {points} ELSE 0 END" for test, points, _ in rules) + ")::DOUBLE"


def rule_reasons(rules) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {test} THEN '{text}' END" for test, _, text in rules) + ")"


TWINS["table_roles"] = f"""
WITH p AS ({TWINS['column_profile']}),
named AS (
  SELECT * FROM (VALUES ('lineitem', true, true, 'order_line'), ('orders', true, true, 'order_header'),
    ('customer', false, true, 'customer'), ('part', false, true, 'category'),
    ('supplier', false, false, 'supplier'), ('nation', false, false, 'unknown'),
    ('region', false, false, 'region')) v(table_id, has_order, has_entity, entity_role)
),
t AS (
  SELECT table_id, max(row_count) AS row_count, count(*) AS column_count,
         count(*) FILTER (WHERE semantic_type = 'numeric_measure') AS measures,
         count(*) FILTER (WHERE semantic_type = 'date') AS dates,
         count(*) FILTER (WHERE is_key_like AND unique_rate >= 0.98 AND null_rate <= 0.05) AS unique_keys,
         count(*) FILTER (WHERE is_key_like AND unique_rate < 0.95) AS repeated_keys,
         count(*) FILTER (WHERE semantic_type = 'text' AND NOT is_key_like AND NOT is_measure_like) AS descriptive
  FROM p GROUP BY table_id
),
z AS (SELECT max(row_count) AS largest, median(row_count) AS middle FROM t),
s AS (
  SELECT *, round({rule_score(FACT_RULES)}, 3) AS fact_score, round({rule_score(DIMENSION_RULES)}, 3) AS dimension_score,
         {rule_reasons(FACT_RULES)} AS fact_reasons, {rule_reasons(DIMENSION_RULES)} AS dimension_reasons
  FROM t JOIN named USING (table_id), z
),
g AS (
  SELECT *, CASE WHEN fact_score >= 0.5 AND round(fact_score - dimension_score, 3) >= 0.1 THEN 'fact'
                 WHEN dimension_score >= 0.4 AND round(dimension_score - fact_score, 3) >= 0.05 THEN 'dimension'
                 ELSE 'unknown' END AS role_guess FROM s
)
SELECT table_id, row_count, column_count, entity_role, role_guess,
       round(CASE role_guess WHEN 'fact' THEN least(1.0, 0.55 + fact_score - dimension_score)
                  WHEN 'dimension' THEN least(1.0, 0.55 + dimension_score - fact_score)
                  ELSE greatest(0.2, 0.5 - abs(fact_score - dimension_score)) END, 3)::DOUBLE AS role_confidence,
       CASE role_guess WHEN 'fact' THEN fact_reasons ELSE dimension_reasons END AS role_evidence,
       fact_score, dimension_score FROM g"""
TWINS["recommended_fact_table"] = "SELECT 'lineitem' AS table_id"


# What the names of the business columns mention, and the entity that they point to by themselves.
NAME_FACTS = {
    "Order Key": (("key", "order"), "order_header"), "Product Key": (("key", "product"), "product"),
    "Supplier ID": (("key", "supplier"), "supplier"), "Line Number": (("key",), "order_line"),
    "Quantity": (("quantity",), None), "Line Amount": (("amount",), None), "Ship Date": (("date",), None),
    "Customer Key": (("customer", "key"), "customer"), "Order Status": (("order",), "order_header"),
    "Order Total": (("amount", "order"), "order_header"), "Order Date": (("date", "order"), "order_header"),
    "Customer Name": (("customer", "name"), "customer"), "Country Code": (("country", "key"), None),
    "Product Name": (("name", "product"), "product"), "Product Category": (("category", "product"), "category"),
    "Unit Price": (("price",), None), "Supplier Name": (("name", "supplier"), "supplier"),
    "Country Name": (("country", "name"), None), "Region Code": (("key",), None), "Region Name": (("name",), None),
}


def _column_rows() -> str:
    rows = []
    for listed, (table, names) in enumerate(BUSINESS_NAMES.items()):
        for name in names.values():
            concepts, pointed = NAME_FACTS.get(name, ((), None))
            kind, key, measure, _ = PROFILE_FACTS[table][name]
            number = kind in ("numeric", "numeric_measure") or (kind == "identifier")
            rows.append(f"""({listed}, '{table}', '{name}', {list(concepts)}::VARCHAR[], {name.lower().split()}::VARCHAR[],
                '{kind}', {number}, {key}, {measure}, {f"'{pointed}'" if pointed else 'NULL'})""")
    return ", ".join(rows)


CANDIDATES = f"""
WITH roles AS ({TWINS['table_roles']}), profile AS ({TWINS['column_profile']}),
named AS (SELECT * FROM (VALUES {_column_rows()}) v(listed, table_id, column_name, concepts, tokens, kind, number, is_key, is_measure, pointed)),
cols AS (
  SELECT named.*, [x FOR x IN concepts IF x NOT IN ('key', 'name')] AS own, role_guess, roles.row_count, roles.entity_role,
         unique_count, unique_rate,
         row_number() OVER (ORDER BY CASE role_guess WHEN 'fact' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END, roles.row_count DESC, listed) AS place,
         kind NOT IN ('date', 'numeric_measure') AND NOT is_measure AND unique_count >= 5
           AND (is_key OR (list_contains(concepts, 'name') AND unique_rate >= 0.98)) AS by_values
  FROM named JOIN roles USING (table_id) JOIN profile USING (table_id, column_name)
),
counts AS ({" UNION ALL ".join(
    f"SELECT '{table}' AS t, '{name}' AS c, {column}::{'DATE::VARCHAR' if PROFILE_FACTS[table][name][0] == 'date' else 'VARCHAR'} AS k, count(*) AS n FROM {table} GROUP BY ALL"
    for table, names in BUSINESS_NAMES.items() for column, name in names.items()
    if PROFILE_FACTS[table][name][1] or name in NAME_FACTS and not PROFILE_FACTS[table][name][2]
)}),
totals AS (
  SELECT t, c, sum(n) AS all_rows, coalesce(sum(n) FILTER (k IS NULL), 0) AS null_rows, count(k) AS keys,
         sum(n) FILTER (k IS NOT NULL) AS key_rows, count(*) FILTER (k IS NOT NULL AND n > 1) AS doubled,
         coalesce(sum(n) FILTER (k IS NOT NULL AND n > 1), 0) AS doubled_rows FROM counts GROUP BY t, c
),
met AS (
  SELECT l.t AS lt, l.c AS lc, r.t AS rt, r.c AS rc, sum(l.n) AS matched, count(*) AS shared, sum(l.n * (r.n - 1)) AS growth,
         bool_or(l.n > 1 AND r.n > 1) AS many FROM counts l JOIN counts r ON l.k = r.k AND l.t <> r.t GROUP BY ALL
),
pairs AS (
  SELECT l.table_id AS lt, l.column_name AS lc, r.table_id AS rt, r.column_name AS rc, l.role_guess AS lrole, r.role_guess AS rrole,
         l.row_count AS lrows, r.row_count AS rrows, l.entity_role AS lentity, r.entity_role AS rentity,
         CASE WHEN l.tokens = r.tokens THEN 25 WHEN list_intersect(l.concepts, r.concepts) = [] THEN
                CASE WHEN list_intersect(l.tokens, r.tokens) = [] THEN 0 ELSE 10 END
              WHEN list_intersect(l.concepts, r.concepts) = ['key'] THEN 8 WHEN list_intersect(l.own, r.own) = [] THEN 7
              WHEN l.own = r.own THEN CASE WHEN l.is_key <> r.is_key THEN 20 ELSE 22 END
              WHEN list_has_all(l.own, r.own) OR list_has_all(r.own, l.own) THEN 18 ELSE 15 END AS name_points,
         CASE WHEN l.kind = 'date' AND r.kind = 'date' THEN 15 WHEN l.kind = 'date' OR r.kind = 'date' THEN NULL
              WHEN (l.is_measure AND NOT l.is_key) OR (r.is_measure AND NOT r.is_key) THEN NULL
              WHEN l.number AND r.number AND (l.is_key OR r.is_key OR name_points >= 20) THEN CASE WHEN l.kind = r.kind THEN 15 ELSE 12 END
              WHEN l.kind IN ('identifier', 'text') AND r.kind IN ('identifier', 'text') THEN CASE WHEN l.kind = r.kind THEN 14 ELSE 12 END
              END AS type_points,
         l.is_key OR r.is_key OR name_points = 25
           OR list_has_any(list_concat(l.concepts, r.concepts), ['date', 'currency', 'customer', 'product', 'store', 'order', 'line_item']) AS signal,
         name_points < 12 AND l.by_values AND r.by_values AND r.unique_rate >= 0.98
           AND NOT coalesce(l.pointed <> r.pointed, false) AS weak
  FROM cols l JOIN cols r ON l.place < r.place AND l.table_id <> r.table_id
),
measured AS (
  SELECT p.*, lentity = 'order_line' AND rentity = 'order_header' AS to_header, coalesce(matched, 0) AS matched_rows,
         coalesce(matched, 0) / a.all_rows AS match_rate, coalesce(shared, 0) / a.keys AS distinct_overlap_rate,
         a.keys / a.key_rows AS left_key_uniqueness, b.keys / b.key_rows AS right_key_uniqueness, b.null_rows AS right_null_key_count,
         b.doubled AS right_duplicate_key_count, b.doubled_rows AS right_duplicate_row_count, a.all_rows AS before_row_count,
         coalesce(growth, 0) AS row_count_change, coalesce(many, false) AS many_to_many_risk, coalesce(growth, 0) > 0 AS row_inflation,
         a.keys = a.key_rows AS left_unique, b.keys = b.key_rows AS right_unique
  FROM pairs p JOIN totals a ON a.t = lt AND a.c = lc JOIN totals b ON b.t = rt AND b.c = rc LEFT JOIN met USING (lt, lc, rt, rc)
  WHERE type_points IS NOT NULL AND (weak OR name_points >= 12 AND signal)
),
judged AS (
  SELECT *, lrole = 'fact' AND rrole = 'fact' AND NOT to_header AS fact_to_fact_risk,
         concat_ws('; ', CASE WHEN right_null_key_count > 0 THEN 'right_key_nulls' END,
           CASE WHEN right_duplicate_key_count > 0 THEN 'right_key_not_unique' END, CASE WHEN many_to_many_risk THEN 'many_to_many' END,
           CASE WHEN row_inflation THEN 'row_inflation' END, CASE WHEN fact_to_fact_risk THEN 'fact_to_fact' END,
           CASE WHEN to_header AND match_rate < 0.2 THEN 'order_line_to_header_low_match' END) AS risks,
         round(name_points + type_points + round(30 * match_rate, 2) + round(20 * right_key_uniqueness, 2)
           + CASE WHEN lrole = 'fact' AND rrole = 'dimension' THEN 10
                  WHEN lrole = 'fact' AND rrole = 'unknown' OR lrole = 'unknown' AND rrole = 'dimension' THEN 7
                  WHEN lrole = 'fact' AND rrole = 'fact' THEN 0 WHEN rrows <= lrows THEN 5 ELSE 3 END
           + greatest(-30, CASE WHEN row_inflation THEN -10 ELSE 0 END + CASE WHEN fact_to_fact_risk THEN -20 ELSE 0 END
               + CASE WHEN right_null_key_count > 0 THEN -5 ELSE 0 END
               + CASE WHEN many_to_many_risk THEN -15 WHEN right_duplicate_key_count > 0 THEN -10 ELSE 0 END), 2)::DOUBLE AS total
  FROM measured
),
scored AS (
  SELECT *, least(greatest(0, least(100, total)), CASE WHEN weak THEN 79.99 ELSE 100 END)::DOUBLE AS confidence_score, risks <> '' AS blocked FROM judged
),
strong AS (SELECT * FROM scored WHERE NOT weak AND match_rate >= 0.2 AND confidence_score >= 45),
chosen AS (
  SELECT * FROM strong UNION ALL
  SELECT * FROM scored w WHERE weak AND match_rate >= 0.85 AND right_key_uniqueness >= 0.98 AND NOT blocked AND confidence_score >= 45
    AND NOT EXISTS (SELECT 1 FROM strong s WHERE NOT s.blocked AND s.lt = w.lt AND s.rt = w.rt AND (s.lc = w.lc OR s.rc = w.rc))
)
SELECT lt || '[' || lc || ']->' || rt || '[' || rc || ']' AS candidate_id, 'single_column' AS relationship_kind,
       CASE WHEN left_unique AND right_unique THEN 'one_to_one' WHEN right_unique THEN 'many_to_one'
            WHEN left_unique THEN 'one_to_many' ELSE 'many_to_many' END AS expected_join_type,
       confidence_score, CASE WHEN confidence_score >= 80 THEN 'high' WHEN confidence_score >= 60 THEN 'medium' ELSE 'low' END AS confidence_level,
       match_rate, distinct_overlap_rate, left_key_uniqueness, right_key_uniqueness, right_null_key_count::BIGINT AS right_null_key_count,
       right_duplicate_key_count, right_duplicate_row_count::BIGINT AS right_duplicate_row_count, before_row_count::BIGINT AS before_row_count,
       (before_row_count + row_count_change)::BIGINT AS after_row_count, row_count_change::BIGINT AS row_count_change, many_to_many_risk,
       row_inflation, fact_to_fact_risk, blocked, concat_ws('; ', nullif(risks, ''), CASE WHEN weak THEN 'weak_name_high_value_overlap' END) AS risk_flags,
       'pending' AS status
FROM chosen"""
TWINS["relationship_candidates"] = CANDIDATES
TWINS["candidate_overlaps"] = f"""
SELECT candidate_id, match_rate, distinct_overlap_rate, left_key_uniqueness, right_key_uniqueness, before_row_count,
       after_row_count, expected_join_type, blocked FROM ({CANDIDATES})"""

UNIFIED = MESSY + """,
unified AS (
  SELECT source_row_number, order_id::VARCHAR AS order_id, "date", 'P-' || product_id AS product_id, unit_price,
         quantity, discount_rate, customer_id, returned, customer_name, product_name, category,
         store_key AS store_id, source_row_number - 1 AS unified_row_number FROM parsed
),
flagged AS (
  SELECT *, NOT coalesce(unit_price >= 0, false) AS bad_price, NOT coalesce(quantity > 0, false) AS bad_quantity
  FROM unified
)"""
TWINS["unified_orders"] = UNIFIED + f" SELECT * EXCLUDE (\"date\"), {STAMP} FROM unified"
TWINS["conversion_diagnostics"] = MESSY + ",\nf AS (" + " UNION ALL ".join(
    f"""SELECT '{field}' AS standard_field, {str(required).lower()} AS required, '{source}' AS source_or_strategy,
        count(*) FILTER (WHERE trim({text}) <> '') AS source_non_null_count,
        count(*) FILTER (WHERE trim({text}) <> '' AND {value} IS NULL) AS conversion_failure_count,
        count(*) FILTER (WHERE {invalid}) AS invalid_value_count,
        count(*) FILTER (WHERE {value} IS NULL) AS null_count,
        count(*) FILTER (WHERE {value} IS NULL) / count(*) AS null_rate FROM parsed"""
    for field, required, source, text, value, invalid in (
        ("order_id", True, "Order Number", "order_id::VARCHAR", "order_id", "false"),
        ("date", True, "Order Date", "date_text", '"date"', "false"),
        ("product_id", True, "Product Key", "product_id::VARCHAR", "product_id", "false"),
        ("unit_price", True, "Unit Price", "price_text", "unit_price", "unit_price < 0"),
        ("quantity", True, "Quantity", "quantity_text", "quantity", "quantity <= 0"),
        ("discount_rate", False, "Discount Rate", "rate_text", "discount_rate", "discount_rate < 0 OR discount_rate > 1"),
        ("customer_id", False, "Customer Key", "customer_key", "customer_id", "false"),
        ("returned", False, "Returned", "returned_text", "returned", "false"),
        ("customer_name", False, "Customer Name", "customer_name", "customer_name", "false"),
        ("product_name", False, "Product Name", "product_name", "product_name", "false"),
        ("category", False, "Product Category", "category", "category", "false"),
        ("store_id", False, "Store Key", "store_key", "store_key", "false"),
    )
) + """)
SELECT *, CASE WHEN standard_field <> 'date' AND conversion_failure_count > 0
                    AND conversion_failure_count / source_non_null_count >= 0.05 THEN 'blocked'
               WHEN invalid_value_count > 0 AND invalid_value_count / source_non_null_count >= 0.05 THEN 'blocked'
               WHEN conversion_failure_count > 0 OR invalid_value_count > 0 OR (required AND null_count > 0)
                 THEN 'warning' ELSE 'passed' END AS status FROM f"""
TWINS["mapping_evidence"] = MESSY + " " + " UNION ALL ".join(
    f"""SELECT '{name}' AS column_name, coalesce(avg(({number})::INT) FILTER (WHERE {present}), 0) AS numeric_rate,
        coalesce(avg(({boolean})::INT) FILTER (WHERE {present}), 0) AS boolean_rate,
        coalesce(avg(({date})::INT) FILTER (WHERE {present}), 0) AS date_rate, 1.0::DOUBLE AS text_rate,
        count(*) FILTER (WHERE {present}) AS present_count FROM parsed"""
    for name, text, number, boolean, date in (
        ("source_row_number", "source_row_number::VARCHAR", "true", "source_row_number IN (0, 1)", "false"),
        ("Order Number", "order_id::VARCHAR", "true", "order_id IN (0, 1)", "false"),
        ("Order Date", "date_text", "date_text <> 'soon' AND date_text NOT LIKE '%-%'", "false", '"date" IS NOT NULL'),
        ("Customer Key", "customer_key", "true", "customer_id IN ('0', '1')", "false"),
        ("Customer Name", "customer_name", "regexp_matches(customer_name, '\\d')", "false", "false"),
        ("Product Key", "product_id::VARCHAR", "true", "false", "false"),
        ("Product Name", "product_name", "false", "false", "false"),
        ("Product Category", "category", "true", "false", "false"),
        ("Unit Price", "price_text", "unit_price IS NOT NULL", "false", "false"),
        ("Quantity", "quantity_text", "true", "quantity_text IN ('0', '1')", "false"),
        ("Discount Rate", "rate_text", "true", "rate_text IN ('0', '1')", "false"),
        ("Returned", "returned_text", "false", "returned IS NOT NULL", "false"),
        ("Store Key", "store_key", "true", "store_key IN ('0', '1')", "false"),
        ("Store Name", "store_name", "regexp_matches(store_name, '\\d')", "false", "false"),
    )
    for present in (f"trim({text}) <> ''",)
)
# Names and context words of the standard fields, as far as the source columns mention them, and what the columns are.
FIELD_FACTS = (
    # field, required, type, rate, entity, display, substitute strategy and score, names with points, context words
    ("order_id", True, "identifier", "text_rate", None, False, ("unmapped", 0), (("order number", 60),), ("order",)),
    ("date", True, "date", "date_rate", None, False, ("unmapped", 0), (("order date", 60), ("date", 44)), ("order",)),
    ("product_id", True, "identifier", "text_rate", "product", False, ("unmapped", 0), (("product key", 60),), ("product",)),
    ("unit_price", True, "money", "numeric_rate", None, False, ("unmapped", 0), (("unit price", 60), ("price", 44)), ("unit", "product")),
    ("quantity", True, "number", "numeric_rate", None, False, ("unmapped", 0), (("quantity", 60),), ("quantity",)),
    ("discount_rate", False, "rate", "numeric_rate", None, False, ("default_zero", 55), (("discount rate", 60), ("discount", 52)), ("discount",)),
    ("customer_id", False, "identifier", "text_rate", "customer", False, ("not_provided", 55), (("customer key", 60),), ("customer",)),
    ("returned", False, "boolean", "boolean_rate", None, False, ("not_provided", 55), (("returned", 60),), ("returned",)),
    ("customer_name", False, "text", "text_rate", "customer", True, ("omit", 0), (("customer name", 60), ("name", 34)), ("customer",)),
    ("product_name", False, "text", "text_rate", "product", True, ("omit", 0), (("product name", 60), ("name", 34)), ("product",)),
    ("category", False, "text", "text_rate", "category", True, ("omit", 0), (("product category", 60), ("category", 60)), ("product", "category")),
    ("store_id", False, "identifier", "text_rate", "store", False, ("omit", 0), (("store key", 60),), ("store",)),
    ("store_name", False, "text", "text_rate", "store", True, ("omit", 0), (("store name", 60),), ("store",)),
)
SOURCE_ENTITIES = {
    "Order Number": "order_header", "Order Date": "order_header", "Customer Key": "customer", "Customer Name": "customer",
    "Product Key": "product", "Product Name": "product", "Product Category": "category", "Store Key": "store", "Store Name": "store",
}


def _sql(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


TWINS["field_recommendations"] = f"""
WITH RECURSIVE evidence AS ({TWINS['mapping_evidence']}),
fields AS (SELECT * FROM (VALUES {", ".join(
    f"({place}, {', '.join(map(_sql, (*facts[:6], *facts[6])))})" for place, facts in enumerate(FIELD_FACTS))})
  v(place, field, required, kind, reads, entity, display, substitute, substitute_score)),
names AS (SELECT * FROM (VALUES {", ".join(f"('{f[0]}', '{phrase}', {points})" for f in FIELD_FACTS for phrase, points in f[7])}) v(field, phrase, points)),
contexts AS (SELECT * FROM (VALUES {", ".join(f"('{f[0]}', '{word}')" for f in FIELD_FACTS for word in f[8])}) v(field, word)),
cols AS (
  SELECT e.*, c.place AS column_place, lower(e.column_name) AS name, c.entity AS column_entity
  FROM evidence e JOIN (VALUES {", ".join(f"({i}, '{name}', {_sql(SOURCE_ENTITIES.get(name))})" for i, name in enumerate((
      "Order Number", "Order Date", "Customer Key", "Customer Name", "Product Key", "Product Name", "Product Category",
      "Unit Price", "Quantity", "Discount Rate", "Returned", "Store Key", "Store Name")))}) c(place, column_name, entity) USING (column_name)
),
points AS (
  SELECT place, field, required, kind, column_place, column_name, reads, present_count, column_entity, entity,
         CASE reads WHEN 'numeric_rate' THEN numeric_rate WHEN 'date_rate' THEN date_rate WHEN 'boolean_rate' THEN boolean_rate ELSE text_rate END AS rate,
         coalesce((SELECT max(CASE WHEN phrase = name THEN points ELSE points - 8 END) FROM names n
           WHERE n.field = f.field AND contains(' ' || name || ' ', ' ' || phrase || ' ')
             AND (phrase = name OR NOT EXISTS (SELECT 1 FROM names x WHERE x.field = f.field AND x.phrase = name))), 0) AS alias,
         CASE WHEN EXISTS (SELECT 1 FROM contexts k WHERE k.field = f.field AND contains(' ' || name || ' ', ' ' || word || ' ')) THEN 10 ELSE 0 END AS context,
         CASE WHEN column_entity = entity THEN 20 WHEN entity IS NOT NULL AND column_entity IS NOT NULL THEN -70 ELSE 0 END AS of_entity,
         CASE WHEN display AND column_name IN ('Order Number', 'Customer Key', 'Product Key', 'Store Key') THEN -45 ELSE 0 END AS penalty
  FROM fields f, cols
),
scores AS (
  SELECT *, round(greatest(0, least(alias + context + 2 * round(15 * rate, 2) + of_entity + penalty, 100,
                CASE WHEN field IN ('store_id', 'store_name') AND alias = 0 THEN 49 ELSE 100 END,
                CASE WHEN reads <> 'text_rate' AND present_count > 0 AND rate < 0.5 THEN 45 ELSE 100 END)), 2)::DOUBLE AS score FROM points
),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, required DESC, field DESC, column_place) AS r FROM scores WHERE score >= 50
),
greedy AS (
  SELECT 0::BIGINT AS r, ''::VARCHAR AS field, ''::VARCHAR AS column_name, 0::DOUBLE AS score, []::VARCHAR[] AS fields, []::VARCHAR[] AS columns
  UNION ALL
  SELECT k.r, CASE WHEN free THEN k.field END, CASE WHEN free THEN k.column_name END, k.score,
         CASE WHEN free THEN list_append(fields, k.field) ELSE fields END, CASE WHEN free THEN list_append(columns, k.column_name) ELSE columns END
  FROM (SELECT g.fields, g.columns, k.r, k.field, k.column_name, k.score,
               NOT list_contains(g.fields, k.field) AND NOT list_contains(g.columns, k.column_name) AS free
        FROM greedy g JOIN ranked k ON k.r = g.r + 1) k
)
SELECT f.field AS standard_field, f.required, f.kind AS target_type, CASE WHEN g.field IS NULL THEN substitute ELSE 'source' END AS recommended_strategy,
       g.column_name AS recommended_source, coalesce(g.score, substitute_score)::DOUBLE AS confidence_score
FROM fields f LEFT JOIN greedy g ON g.field = f.field"""
TWINS["preflight_counts"] = UNIFIED + """,
k AS (SELECT * FROM flagged WHERE NOT bad_price AND NOT bad_quantity)
SELECT (SELECT count(*) FROM flagged) AS unified_row_count,
       (SELECT count(*) FROM flagged WHERE bad_price OR bad_quantity) AS bad_price_or_quantity,
       count(*) AS calculation_row_count, 0 AS bad_order_id, 0 AS bad_discount_rate,
       count(*) - count("date") AS bad_date, count(*) - count(returned) AS unknown_returned,
       count(returned) AS known_returned, strftime(min("date"), '%Y-%m-%d %H:%M:%S') AS date_min,
       strftime(max("date"), '%Y-%m-%d %H:%M:%S') AS date_max, 0 AS null_order_id,
       count(*) - count("date") AS null_date, 0 AS null_product_id, 0 AS null_unit_price, 0 AS null_quantity
FROM k"""
TWINS["preflight_issues"] = UNIFIED + """
SELECT 'invalid_price_or_quantity' AS code, 'unit_price, quantity' AS field, 'critical' AS severity,
       count(*) AS affected_row_count,
       'Invalid unit_price or quantity rows must be fixed or explicitly excluded.' AS message, true AS excludable
FROM flagged WHERE bad_price OR bad_quantity
UNION ALL
SELECT 'invalid_date_decision_required', 'date', 'critical', count(*),
       'Invalid dates require an explicit decision before report generation.', false
FROM flagged WHERE "date" IS NULL"""
REASON = """concat_ws('; ', CASE WHEN bad_price THEN 'unit_price is missing, non-numeric, or negative' END,
  CASE WHEN bad_quantity THEN 'quantity is missing, non-numeric, or not positive' END)"""
EXCLUDED = f"""SELECT unified_row_number, order_id, {REASON} AS exclusion_reason
FROM flagged WHERE bad_price OR bad_quantity"""
TWINS["excluded_rows"] = UNIFIED + " " + EXCLUDED
TWINS["kept_rows"] = UNIFIED + """
SELECT unified_row_number, order_id, unit_price, quantity FROM flagged WHERE NOT bad_price AND NOT bad_quantity"""
TWINS["issue_preview"] = UNIFIED + f"""
SELECT unified_row_number, order_id, {STAMP}, unit_price, quantity, discount_rate, {REASON} AS reason
FROM flagged WHERE bad_price OR bad_quantity ORDER BY unified_row_number LIMIT 20"""
TWINS["date_preview"] = UNIFIED + f"""
SELECT unified_row_number, order_id, {STAMP}, unit_price, quantity, discount_rate,
       'date could not be parsed' AS reason
FROM unified WHERE "date" IS NULL ORDER BY unified_row_number LIMIT 20"""

SOURCES = {
    "order_id": "Order Number", "date": "Order Date", "product_id": "Product Key", "unit_price": "Unit Price",
    "quantity": "Quantity", "discount_rate": "Discount Rate", "returned": "Returned",
    "customer_name": "Customer Name", "product_name": "Product Name", "category": "Product Category",
}
AVAILABILITY = """,
c AS (SELECT count(*) AS total, count(customer_id) AS customers, count(store_id) AS stores FROM unified),
availability AS (
""" + " UNION ALL ".join(
    f"""SELECT '{field}' AS field_name, 'provided' AS availability_status, '{source}' AS source_column,
        true AS user_confirmed, 'Mapped from source column {source}.' AS notes, NULL::BIGINT AS provided_row_count,
        NULL::BIGINT AS total_row_count"""
    for field, source in SOURCES.items()
) + """
UNION ALL SELECT 'customer_id', 'partially_provided', 'Customer Key', true,
  'Customer data was only partially provided. Customer analysis was skipped. Non-empty customer_id rows: '
  || format('{:,}', customers) || ' / ' || format('{:,}', total) || ' valid rows.', customers, total FROM c
UNION ALL SELECT 'store_id', 'partially_provided', 'Store Key', true,
  'Non-empty store_id rows: ' || format('{:,}', stores) || ' / ' || format('{:,}', total) || ' valid rows.',
  stores, total FROM c
UNION ALL SELECT 'store_name', 'omitted', NULL, true, 'Optional standard field was not selected.', 0, total FROM c
UNION ALL SELECT 'store_analysis', 'partially_provided', 'Store Key', true,
  'Store data was partially provided. Some transactions could not be assigned to a store. Store data was available for '
  || format('{:,}', stores) || ' of ' || format('{:,}', total) || ' transaction rows.', stores, total FROM c
)"""
TWINS["field_availability"] = UNIFIED + AVAILABILITY + " SELECT * FROM availability"
TWINS["report_coverage"] = UNIFIED + AVAILABILITY + """
SELECT 'Return analysis' AS analysis, 'available' AS coverage_status, 'Return data was provided.' AS notes
UNION ALL SELECT 'Store analysis', 'available', notes FROM availability WHERE field_name = 'store_analysis'"""
TWINS["preparation_audit"] = UNIFIED + AVAILABILITY + f""",
x AS ({EXCLUDED}),
n AS (SELECT count(*) AS total, (SELECT count(*) FROM x) AS gone,
             count(*) FILTER (WHERE "date" IS NULL AND NOT bad_price AND NOT bad_quantity) AS undated FROM flagged)
SELECT 'fact_table' AS section, 'selected_fact_table' AS item, NULL::DOUBLE AS value_double,
       'lineitem' AS value_text, 'lineitem' AS notes
UNION ALL SELECT 'row_counts', 'original_fact_rows', total, NULL, 'Before approved joins.' FROM n
UNION ALL SELECT 'row_counts', 'merged_dataset_rows', total, NULL, 'After safe many-to-one joins.' FROM n
UNION ALL SELECT 'row_counts', 'unified_orders_rows', total, NULL, 'Before explicit report exclusions.' FROM n
UNION ALL SELECT 'row_counts', 'excluded_rows', gone, NULL, 'Explicitly excluded from all calculations.' FROM n
UNION ALL SELECT 'row_counts', 'monthly_analysis_excluded_rows', undated, NULL,
  'Invalid-date rows retained elsewhere but excluded from monthly analysis.' FROM n
UNION ALL SELECT 'row_counts', 'final_calculation_rows', total - gone, NULL, 'Rows passed to the report.' FROM n
UNION ALL SELECT 'field_mapping', field_name, NULL, coalesce(source_column, availability_status), notes
  FROM availability
UNION ALL SELECT 'excluded_rows', exclusion_reason, count(*), NULL, 'User-confirmed exclusion.' FROM x
  GROUP BY exclusion_reason"""
TWINS["data_limitations"] = """
SELECT 'Expense data was not provided' AS limitation, 'Finance and cash-flow analysis was skipped.' AS impact
UNION ALL SELECT 'Customer data was only partially provided. Customer analysis was skipped.',
  'Customer rankings and lifecycle analysis were skipped.'
UNION ALL SELECT 'Cost data was not provided', 'Gross-margin analysis is not available.'"""
TWINS["drop_selected_rows"] = """
SELECT * FROM (SELECT row_number() OVER () + 1 AS source_row_number, l_orderkey, l_linenumber FROM lineitem)
WHERE l_orderkey % 10 <> 0"""
TWINS["text_damage_score"] = r"""
WITH t AS (
  SELECT source, 60.0 / greatest(count(text), 60) AS scale,
         sum(length(regexp_replace(text, '[ \t\n\r\x0B\f]', '', 'g'))) + 10 AS characters,
         sum(length(text) - length(replace(text, chr(65533), ''))) AS replacements,
         sum(length(regexp_replace(text, '[^\x{01}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]', '', 'g'))) AS controls,
         sum(length(regexp_replace(text, '[^ÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞæðñþ±º»¼½¾]', '', 'g'))) AS suspicious,
         sum(len(regexp_extract_all(text, '[¡-ÿ]{4,}'))) AS runs, """ + " + ".join(
    f"sum((length(lower(text)) - length(replace(lower(text), lower('{s}'), ''))) // {len(s)})"
    for s in ("Ã ", "Ã¡", "Ã©", "Ã­", "Ã³", "Ãº", "Â ", "ï¿½", "éÌ", "Æ·", "±à", "ºÅ", "éÆ·", "锟斤拷")
) + r""" AS sequences
  FROM documents GROUP BY source
),
s AS (
  SELECT *, round(least(1.0,
      CASE WHEN replacements > 0 THEN least(1.0, replacements / characters * 20.0) ELSE 0 END
    + CASE WHEN controls > 0 THEN least(0.8, controls / characters * 20.0) ELSE 0 END
    + CASE WHEN suspicious * scale >= 4 THEN least(0.65, suspicious / characters * 2.5) ELSE 0 END
    + CASE WHEN sequences * scale >= 2 THEN least(0.7, sequences * scale * 0.12) ELSE 0 END
    + CASE WHEN runs * scale >= 2 THEN least(0.5, runs * scale * 0.12) ELSE 0 END), 4)::DOUBLE AS damage_score FROM t
)
SELECT source, characters::BIGINT AS characters, replacements::BIGINT AS replacements, controls::BIGINT AS controls,
       suspicious::BIGINT AS suspicious, sequences::BIGINT AS sequences, runs::BIGINT AS runs, damage_score,
       damage_score >= 0.55 AS looks_damaged FROM s"""

REPORT = (
    ENRICHED + "," + monthly("m", "enriched") + "," + summary("cat", "enriched", "category") + ","
    + summary("cust", "enriched", "customer_id, customer_name") + ","
    + summary("prod", "enriched", "product_id, product_name, category") + SHOPS + "," + stores("st", "shops") + ","
    + DIRTY_EXPENSES + "," + flow("dirty_expenses") + "," + breakdown("dirty_expenses") + """,
anomaly_notes AS (
  SELECT 'Monthly return rate exceeded 15%' AS label, year_month AS period, 'return_rate_over_15_percent' AS kind,
         'Monthly return rate was ' || printf('%.1f%%', return_rate * 100) || '.' AS details FROM m
  WHERE return_rate > 0.15
  UNION ALL
  SELECT 'Monthly revenue dropped by more than 20%', year_month, 'sales_drop_over_20_percent', '' FROM m
  WHERE revenue_growth_rate <= -0.2 AND NOT is_partial_period
)"""
)


def best(section: str, metric: str, source: str, label: str, amount: str, direction: str = "DESC", where: str = "true") -> str:
    return f"""SELECT * FROM (SELECT '{section}' AS section, '{metric}' AS metric, {label} AS label,
    {amount} AS value_double, NULL::VARCHAR AS value_text FROM {source} WHERE {amount} IS NOT NULL AND {where}
    ORDER BY {amount} {direction}, {label} LIMIT 1)"""


def fact(section: str, metric: str, value: str, source: str) -> str:
    return f"SELECT '{section}' AS section, '{metric}' AS metric, NULL AS label, {value} AS value_double, NULL AS value_text FROM {source}"


COMPLETE = "NOT is_partial_period"
TOTALS = f"""(SELECT {money('revenue')} AS revenue, {money('gross_revenue')} AS gross, {money('discount_amount')} AS discount,
  sum(orders) AS orders, {money('units')} AS units FROM m)"""
RAW_ORDER_COLUMNS = (
    'order_id, "date", customer_id, customer_name, product_id, product_name, category, unit_price, quantity, '
    "discount_rate, returned, store_id, store_name"
)
HEADLINES = REPORT + "," + reconcile("r", "enriched") + f""",
post AS ({checks(POST_CHECKS, "enriched")}), expense_post AS ({checks(EXPENSE_CHECKS, "dirty_expenses")}),
copies AS (SELECT coalesce(sum(n - 1), 0) AS n FROM (SELECT count(*) AS n FROM order_rows GROUP BY {RAW_ORDER_COLUMNS})),
tally AS (
  SELECT (SELECT count(*) FROM r WHERE status = 'failed') AS failed,
         (SELECT sum(issue_count) FROM post WHERE check_name NOT IN ('invalid_date_count', 'invalid_returned_count'))
           AS critical,
         (SELECT sum(issue_count) FROM post WHERE check_name IN ('invalid_date_count', 'invalid_returned_count'))
           + (SELECT sum(issue_count) FROM expense_post) + (SELECT n FROM copies) AS warnings
),
notes AS (
  SELECT anomaly_label, details, 0 AS place, period, anomaly_type, order_id FROM ({DROPS})
  UNION ALL SELECT anomaly_label, details, 0, period, anomaly_type, order_id FROM ({RETURNS})
)"""
TWINS["headline_facts"] = HEADLINES + "\n" + "\nUNION ALL ".join((
    fact("executive", "dated_revenue", "revenue", TOTALS),
    fact("executive", "dated_orders", "orders", TOTALS),
    fact("executive", "dated_units", "units", TOTALS),
    fact("executive", "dated_aov", ratio("revenue", "orders"), TOTALS),
    fact("executive", "dated_discount", "discount", TOTALS),
    fact("executive", "discount_impact_rate", ratio("discount", "gross"), TOTALS),
    best("executive", "strongest_complete_month", "m", "year_month", "revenue", where=COMPLETE),
    best("executive", "weakest_complete_month", "m", "year_month", "revenue", "ASC", COMPLETE),
    best("executive", "highest_growth_month", "m", "year_month", "revenue_growth_rate", where=COMPLETE),
    "SELECT 'executive', 'partial_month', year_month, NULL, partial_reason FROM m WHERE is_partial_period",
    best("business", "top_category", "cat", "category", "revenue"),
    best("business", "top_customer", "cust", "customer_name", "revenue"),
    best("business", "top_product", "prod", "product_name", "revenue"),
    best("business", "top_store", "st", "store_name", "revenue"),
    fact("business", "anomaly_count", "count(*)", "anomaly_notes"),
    "SELECT 'finance', 'finance_module_status', NULL, NULL, 'passed'",
    f"SELECT 'finance', 'kpi', 'total_income', {money('monthly_income')}, NULL FROM flow",
    f"SELECT 'finance', 'kpi', 'total_expenses', {money('monthly_expenses')}, NULL FROM flow",
    f"SELECT 'finance', 'kpi', 'net_cash_flow', {money('net_cash_flow')}, NULL FROM flow",
    f"""SELECT 'finance', 'kpi', 'profit_margin', {ratio(money('net_cash_flow'), money('monthly_income'))}, NULL
    FROM flow""",
    "SELECT 'finance', 'kpi', 'warning_months', count(*), NULL FROM flow WHERE cash_flow_warning <> 'ok'",
    """SELECT * FROM (SELECT 'finance', 'kpi', 'largest_expense_category', NULL::DOUBLE, expense_category FROM breakdown
    ORDER BY total_expense DESC, expense_category LIMIT 1)""",
    "SELECT 'finance', 'kpi', 'largest_expense_category_amount', max(total_expense), NULL FROM breakdown",
    best("finance", "strongest_cash_flow_month", "flow", "year_month", "net_cash_flow"),
    best("finance", "weakest_cash_flow_month", "flow", "year_month", "net_cash_flow", "ASC"),
    """SELECT * FROM (SELECT 'finance', 'largest_category_share', expense_category, share_of_expenses, NULL::VARCHAR
    FROM breakdown ORDER BY total_expense DESC, expense_category LIMIT 1)""",
    """SELECT * FROM (SELECT 'finance', 'first_cash_flow_warning', year_month, NULL::DOUBLE, w FROM (
      SELECT year_month, unnest(string_split(cash_flow_warning, '; ')) AS w FROM flow WHERE cash_flow_warning <> 'ok')
    ORDER BY year_month, w LIMIT 1)""",
    """SELECT 'executive', 'growth_not_meaningful', year_month, revenue, NULL FROM (
      SELECT *, lag(revenue) OVER (ORDER BY year_month) AS before FROM m)
    WHERE NOT is_partial_period AND before = 0 AND revenue <> 0""",
    """SELECT 'status', 'report_status',
      CASE WHEN failed > 0 OR critical > 0 THEN 'failed' WHEN warnings > 0 THEN 'review_required' ELSE 'ready' END, NULL,
      CASE WHEN failed > 0 THEN 'One or more validation checks failed.'
           WHEN critical > 0 THEN 'Critical data quality issues affect revenue calculations.'
           WHEN warnings > 0 THEN 'Warnings exist and should be reviewed.'
           ELSE 'All validations passed and no data quality warnings were found.' END FROM tally""",
    "SELECT 'quality', 'duplicates', 'duplicate_rows', n, NULL FROM copies",
    """SELECT 'quality', 'duplicates', 'repeated_order_id_rows', count(*) - count(DISTINCT order_id), NULL
    FROM order_rows""",
    """SELECT 'quality', 'order_check', check_name, issue_count, NULL FROM post
    WHERE issue_count > 0 OR check_name = 'invalid_date_count'""",
    "SELECT 'quality', 'expense_check', check_name, issue_count, NULL FROM expense_post WHERE issue_count > 0",
    "SELECT 'validation', 'check_count', NULL, count(*), NULL FROM r WHERE status <> 'info'",
    "SELECT 'validation', 'failed_check_count', NULL, failed, NULL FROM tally",
    "SELECT 'validation', 'failed_check', check_name, difference, NULL FROM r WHERE status = 'failed'",
    "SELECT 'validation', 'info', check_name, actual_value, NULL FROM r WHERE status = 'info'",
    """SELECT * FROM (SELECT 'anomaly', 'note', anomaly_label, NULL::DOUBLE, details FROM notes
    ORDER BY period, anomaly_type LIMIT 10)""",
))
TWINS["dashboard_kpis"] = REPORT + f"""
SELECT {money('final_revenue')} AS total_revenue, count(DISTINCT order_id) AS total_orders,
       {money('quantity')} AS total_units, {ratio(money('final_revenue'), 'count(DISTINCT order_id)')} AS overall_aov,
       (SELECT category FROM cat ORDER BY revenue DESC, category LIMIT 1) AS top_category,
       (SELECT product_name FROM prod ORDER BY revenue DESC, product_id LIMIT 1) AS top_product,
       (SELECT customer_name FROM cust ORDER BY revenue DESC, customer_name LIMIT 1) AS top_customer,
       (SELECT store_name FROM st ORDER BY revenue DESC, store_name LIMIT 1) AS top_store,
       (SELECT count(*) FROM anomaly_notes) AS anomaly_count FROM enriched"""
TWINS["store_extremes"] = ENRICHED + SHOPS + "," + stores("st", "shops") + """
SELECT * FROM (SELECT 'top_store' AS rank, store_name, revenue, revenue_share FROM st ORDER BY revenue DESC, grp LIMIT 1)
UNION ALL
SELECT * FROM (SELECT 'lowest_store', store_name, revenue, revenue_share FROM st ORDER BY revenue, grp LIMIT 1)"""
TWINS["action_required"] = DIRTY + "," + monthly("m", "dirty") + """,
review AS (SELECT 'Open the Anomalies detail table and investigate the affected rows.' AS action),
found AS (
  SELECT 'Order discount rate exceeded 30%' AS label FROM dirty WHERE discount_rate > 0.3
  UNION ALL SELECT 'Monthly return rate exceeded 15%' FROM m WHERE return_rate > 0.15
  UNION ALL SELECT 'Monthly revenue dropped by more than 20%' FROM m
    WHERE revenue_growth_rate <= -0.2 AND NOT is_partial_period
)
SELECT 'Report failed' AS issue, 'Critical' AS severity,
       'Fix the data quality issue, then generate the report again.' AS suggested_action, 1 AS n
UNION ALL
SELECT 'Duplicate rows', 'Review', 'Review duplicate rows before using revenue numbers.', 1
WHERE EXISTS (SELECT 1 FROM dirty GROUP BY order_id, "date", customer_id, product_id, product_name, category,
  unit_price, quantity, discount_rate, returned HAVING count(*) > 1)
UNION ALL SELECT label, 'Warning', action, count(*) FROM found, review GROUP BY label, action"""
TWINS["adapted_validation"] = UNIFIED + """,
dirty_rows AS (SELECT * FROM flagged WHERE NOT bad_price AND NOT bad_quantity),
gross AS (SELECT *, unit_price * quantity AS gross_revenue FROM dirty_rows),
disc AS (SELECT *, gross_revenue * (1 - discount_rate) AS discounted_revenue FROM gross),
dirty AS (SELECT *, CASE WHEN returned THEN 0 ELSE discounted_revenue END AS final_revenue,
                 strftime("date", '%Y-%m') AS year_month FROM disc)
,""" + reconcile("r") + f"""
SELECT check_name, CASE WHEN check_name NOT LIKE 'customer%' THEN expected_value END AS expected_value,
       CASE WHEN check_name NOT LIKE 'customer%' THEN actual_value END AS actual_value,
       CASE WHEN check_name NOT LIKE 'customer%' THEN difference END AS difference,
       CASE WHEN check_name LIKE 'customer%' THEN 'not_applicable' ELSE status END AS status FROM r
UNION ALL SELECT 'store_summary_revenue_equals_enriched_orders_final_revenue', {money('final_revenue')},
  {money('final_revenue')}, 0, 'passed' FROM dirty
UNION ALL SELECT 'store_summary_units_equals_enriched_orders_units', {money('quantity')}, {money('quantity')}, 0,
  'passed' FROM dirty"""
