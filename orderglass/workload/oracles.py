"""SQL twins of the report queries, in the dialect of the checking engine."""

from __future__ import annotations

ORDER_ROWS = """
lines AS (SELECT *, row_number() OVER () + 1 AS source_row_number FROM lineitem),
order_rows AS (
  SELECT source_row_number, l_orderkey AS order_id, o_orderdate AS "date", o_custkey AS customer_id,
         c_name AS customer_name, l_partkey AS product_id, p_name AS product_name, p_brand AS category,
         p_retailprice AS unit_price, l_quantity AS quantity, l_discount AS discount_rate,
         l_returnflag = 'R' AS returned, l_suppkey AS store_id, s_name AS store_name
  FROM lines LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey
)"""


def revenue(source: str, name: str, extra: str = "") -> str:
    """The revenue formula over typed rows of ``source``."""
    return f"""
{name}_gross AS (
  SELECT *, CASE WHEN unit_price >= 0 AND quantity > 0 THEN unit_price * quantity END AS gross_revenue
  FROM {source}
),
{name}_discounted AS (
  SELECT *, CASE WHEN discount_rate BETWEEN 0 AND 1 THEN gross_revenue * (1 - discount_rate) END
            AS discounted_revenue
  FROM {name}_gross
),
{name} AS (
  SELECT *, gross_revenue - discounted_revenue AS discount_amount,
         CASE WHEN returned AND discounted_revenue IS NOT NULL THEN 0.0::DOUBLE ELSE discounted_revenue END
           AS final_revenue,
         strftime("date", '%Y-%m') AS year_month{extra}
  FROM {name}_discounted
)"""


ENRICHED = "WITH " + ORDER_ROWS.lstrip() + "," + revenue("order_rows", "enriched")

DIRTY_TEXT = """
dirty_text AS (
  SELECT source_row_number,
         CASE WHEN order_id % 97 <> 0 THEN order_id::VARCHAR END AS order_id,
         CASE WHEN order_id % 17 = 0 THEN 'not-a-date' WHEN order_id % 19 = 0 THEN NULL
              WHEN order_id % 3 = 0 THEN strftime("date", '%Y/%m/%d')
              WHEN order_id % 3 = 1 THEN strftime("date", '%m/%d/%Y')
              ELSE strftime("date", '%Y-%m-%d') END AS "date",
         customer_id::VARCHAR AS customer_id, product_id::VARCHAR AS product_id, product_name,
         CASE WHEN product_id % 59 <> 0 THEN category END AS category,
         CASE WHEN product_id % 41 = 0 THEN NULL WHEN product_id % 43 = 0 THEN 'abc'
              WHEN product_id % 47 = 0 THEN '-5' ELSE unit_price::VARCHAR END AS unit_price,
         CASE WHEN order_id % 53 = 0 THEN '0' ELSE quantity::VARCHAR END AS quantity,
         CASE WHEN (product_id + order_id) % 29 = 0 THEN '1.25'
              WHEN (product_id + order_id) % 31 = 0 THEN 'none given'
              ELSE discount_rate::VARCHAR END AS discount_rate,
         CASE WHEN returned THEN 'yes' WHEN (product_id + order_id) % 7 = 0 THEN 'unknown' ELSE 'no' END
           AS returned
  FROM order_rows
)"""
DIRTY_TYPED = """
dirty_typed AS (
  SELECT source_row_number, order_id,
         coalesce(try_strptime("date", '%Y-%m-%d'), try_strptime("date", '%Y/%m/%d'),
                  try_strptime("date", '%m/%d/%Y')) AS "date",
         customer_id, 'Customer ' || customer_id AS customer_name, product_id, product_name, category,
         TRY_CAST(unit_price AS DOUBLE) AS unit_price, TRY_CAST(quantity AS DOUBLE) AS quantity,
         TRY_CAST(discount_rate AS DOUBLE) AS discount_rate,
         CASE returned WHEN 'yes' THEN true WHEN 'no' THEN false END AS returned
  FROM dirty_text
)"""
DIRTY_ROWS = "WITH " + ORDER_ROWS.lstrip() + "," + DIRTY_TEXT
DIRTY = DIRTY_ROWS + "," + DIRTY_TYPED + "," + revenue("dirty_typed", "dirty")

EXPENSES = """
expenses AS (
  SELECT event_id AS expense_id, ts AS "date", event_type AS expense_category, value AS amount,
         strftime(ts, '%Y-%m') AS year_month FROM events
)"""
DIRTY_EXPENSE_TEXT = """
dirty_expense_text AS (
  SELECT event_id // 2 AS expense_id,
         CASE WHEN event_id % 13 = 0 THEN 'bad-date'
              ELSE strftime(ts::DATE - to_months((event_id % 96)::INTEGER), '%Y-%m-%d') END AS "date",
         CASE WHEN event_id % 11 <> 0 THEN event_type END AS expense_category,
         CASE WHEN event_id % 23 = 0 THEN 'abc' WHEN event_id % 29 = 0 THEN '-' || value::VARCHAR
              ELSE value::VARCHAR END AS amount
  FROM events
)"""
DIRTY_EXPENSES = DIRTY_EXPENSE_TEXT + """,
dirty_expenses AS (
  SELECT expense_id, try_strptime("date", '%Y-%m-%d') AS "date",
         coalesce(expense_category, 'Unknown') AS expense_category, TRY_CAST(amount AS DOUBLE) AS amount,
         strftime(try_strptime("date", '%Y-%m-%d'), '%Y-%m') AS year_month
  FROM dirty_expense_text
)"""

TWINS: dict[str, str] = {}


def money(expression: str) -> str:
    """An exact sum, like the operators compute it."""
    return f"coalesce(sum(CAST({expression} AS DECIMAL(18,4))), 0)::DOUBLE"


def ratio(numerator: str, denominator: str) -> str:
    return f"coalesce({numerator} / nullif({denominator}, 0), 0)"


MEASURES = f"""
  {money('gross_revenue')} AS gross_revenue, {money('discount_amount')} AS discount_amount,
  {money('discounted_revenue')} AS discounted_revenue, {money('final_revenue')} AS revenue,
  count(DISTINCT order_id) AS orders, {money('quantity')} AS units,
  sum(CASE WHEN returned THEN 1 WHEN NOT returned THEN 0 END)::DOUBLE / nullif(count(returned), 0) AS return_rate,
  {money('discount_rate')} / nullif(count(discount_rate), 0) AS average_discount_rate"""
RATIOS = f"""
  {ratio('revenue', 'orders')} AS "AOV", {ratio('discount_amount', 'gross_revenue')} AS discount_impact_rate"""


def summary(name: str, source: str, keys: str) -> str:
    known = " AND ".join(f"{key.strip()} IS NOT NULL" for key in keys.split(","))
    return f"""
{name}_measures AS (SELECT {keys}, {MEASURES} FROM {source} WHERE {known} GROUP BY {keys}),
{name} AS (SELECT *, {RATIOS} FROM {name}_measures)"""


def coverage(name: str, source: str) -> str:
    return f"""
{name}_days AS (
  SELECT year_month, min("date"::DATE) AS first_day, max("date"::DATE) AS last_seen,
         count(DISTINCT "date"::DATE) AS observed_day_count, (year_month || '-01')::DATE AS month_start
  FROM {source} WHERE "date" IS NOT NULL GROUP BY year_month
),
{name} AS (
  SELECT year_month, strftime(month_start, '%Y-%m-%d') AS period_start,
         strftime(last_day(month_start), '%Y-%m-%d') AS period_end,
         strftime(first_day, '%Y-%m-%d') AS observed_min_date,
         strftime(last_seen, '%Y-%m-%d') AS observed_max_date, observed_day_count,
         day(last_day(month_start)) AS calendar_day_count,
         (year_month = (SELECT min(year_month) FROM {name}_days) AND first_day > month_start)
           OR (year_month = (SELECT max(year_month) FROM {name}_days) AND last_seen < last_day(month_start))
           AS is_partial_period,
         CASE WHEN year_month = (SELECT max(year_month) FROM {name}_days) AND last_seen < last_day(month_start)
                THEN 'Partial month through ' || strftime(last_seen, '%Y-%m-%d')
              WHEN year_month = (SELECT min(year_month) FROM {name}_days) AND first_day > month_start
                THEN 'Partial month starting ' || strftime(first_day, '%Y-%m-%d')
              ELSE '' END AS partial_reason
  FROM {name}_days
)"""


def monthly(name: str, source: str) -> str:
    return summary(f"{name}_sales", source, "year_month") + "," + coverage(f"{name}_cover", source) + f""",
{name} AS (
  SELECT s.*, c.* EXCLUDE (year_month), lag(revenue) OVER (ORDER BY s.year_month) AS previous_revenue,
         (CAST(revenue AS DECIMAL(18,4)) - lag(CAST(revenue AS DECIMAL(18,4))) OVER (ORDER BY s.year_month))::DOUBLE
           AS revenue_growth_amount,
         revenue / nullif(lag(revenue) OVER (ORDER BY s.year_month), 0) - 1 AS revenue_growth_rate
  FROM {name}_sales s JOIN {name}_cover c USING (year_month)
)"""


TWINS["enriched_orders"] = ENRICHED + """
SELECT order_id, strftime("date", '%Y-%m-%d %H:%M:%S') AS "date", customer_id, product_id, category, unit_price,
       quantity, discount_rate, returned, gross_revenue, discounted_revenue, discount_amount, final_revenue,
       year_month FROM enriched"""
TWINS["dirty_enriched_orders"] = DIRTY + """
SELECT source_row_number, order_id, strftime("date", '%Y-%m-%d %H:%M:%S') AS "date", category, customer_name,
       unit_price, quantity, discount_rate, returned, gross_revenue, discounted_revenue, final_revenue, year_month
FROM dirty"""
TWINS["monthly_summary"] = ENRICHED + "," + monthly("m", "enriched") + " SELECT * FROM m"
TWINS["monthly_growth"] = ENRICHED + "," + monthly("m", "enriched") + """
SELECT year_month, revenue, previous_revenue, revenue_growth_amount, revenue_growth_rate,
       coalesce(previous_revenue <> 0, false) AS growth_is_meaningful FROM m"""
TWINS["dirty_monthly_summary"] = DIRTY + "," + monthly("m", "dirty") + \
    " SELECT * EXCLUDE (average_discount_rate) FROM m"
TWINS["period_coverage"] = """
WITH o AS (SELECT o_orderdate AS "date", strftime(o_orderdate, '%Y-%m') AS year_month FROM orders),""" + \
    coverage("c", "o") + " SELECT * FROM c"
TWINS["category_summary"] = ENRICHED + "," + summary("c", "enriched", "category") + " SELECT * FROM c"
TWINS["dirty_category_summary"] = DIRTY + "," + summary("c", "dirty", "category") + \
    " SELECT * EXCLUDE (average_discount_rate) FROM c"
TWINS["customer_summary"] = ENRICHED + "," + summary("c", "enriched", "customer_id, customer_name") + \
    " SELECT * FROM c"
TWINS["top_customers"] = ENRICHED + "," + summary("c", "enriched", "customer_id, customer_name") + """
SELECT customer_id, customer_name, revenue FROM c ORDER BY revenue DESC, customer_id LIMIT 10"""
TWINS["top_products"] = ENRICHED + "," + summary("p", "enriched", "product_id, product_name, category") + """
SELECT * FROM p ORDER BY revenue DESC, product_id LIMIT 10"""


def stores(name: str, source: str) -> str:
    """``source`` has ``order_id, shop_id, shop_name, source_row_number`` and the revenue columns."""
    return f"""
{name}_keys AS (
  SELECT *, CASE WHEN shop_id IS NOT NULL THEN 'id:' || shop_id WHEN shop_name IS NOT NULL THEN 'name:' || shop_name
            ELSE '' END AS grp FROM {source}
),
{name}_groups AS (
  SELECT grp, max(shop_id) AS store_id,
         min_by(shop_name, source_row_number) FILTER (WHERE shop_name IS NOT NULL) AS label,
         {money('final_revenue')} AS revenue, count(DISTINCT order_id) AS orders, {money('quantity')} AS units
  FROM {name}_keys GROUP BY grp
),
{name} AS (
  SELECT grp, store_id, CASE WHEN grp = '' THEN 'Unassigned Store' ELSE coalesce(label, 'Store ' || store_id) END
           AS store_name, revenue, orders, units, {ratio('revenue', 'orders')} AS aov,
         {ratio('revenue', f"(SELECT {money('final_revenue')} FROM {source})")} AS revenue_share
  FROM {name}_groups
)"""


SHOPS = """,
shops AS (SELECT *, store_id::VARCHAR AS shop_id, store_name AS shop_name FROM enriched)"""
PARTLY_ASSIGNED = """,
shops AS (
  SELECT *, CASE WHEN store_id % 5 > 0 THEN store_id::VARCHAR END AS shop_id,
         CASE WHEN store_id % 10 <> 0 THEN store_name END AS shop_name FROM enriched
)"""
TWINS["store_summary"] = ENRICHED + SHOPS + "," + stores("s", "shops") + " SELECT * EXCLUDE (grp) FROM s"
TWINS["store_summary_partial"] = ENRICHED + PARTLY_ASSIGNED + "," + stores("s", "shops") + \
    " SELECT * EXCLUDE (grp) FROM s"
TWINS["assigned_stores"] = ENRICHED + PARTLY_ASSIGNED + "," + stores("s", "shops") + \
    " SELECT * EXCLUDE (grp) FROM s WHERE grp <> ''"
TWINS["store_status"] = ENRICHED + PARTLY_ASSIGNED + """
SELECT CASE WHEN count(*) FILTER (WHERE shop_id IS NOT NULL OR shop_name IS NOT NULL) < count(*)
            THEN 'partially_provided' ELSE 'provided' END AS availability_status,
       count(*) FILTER (WHERE shop_id IS NOT NULL OR shop_name IS NOT NULL) AS provided_row_count,
       count(*) AS total_row_count, count(shop_id) = 0 AS grouped_by_name FROM shops"""

RAW_COLUMNS = (
    "order_id", "date", "customer_id", "product_id", "product_name", "category", "unit_price", "quantity",
    "discount_rate", "returned",
)
RAW_QUALITY = """
SELECT 'file' AS section, 'file_path' AS metric, NULL::DOUBLE AS value_double, 'orders' AS value_text
UNION ALL SELECT 'file', 'status', NULL, 'passed'
UNION ALL SELECT 'file', 'row_count', count(*), NULL FROM dirty_text
UNION ALL SELECT 'file', 'column_count', 10, NULL
UNION ALL SELECT 'duplicates', 'duplicate_rows', sum(n - 1), NULL FROM
  (SELECT count(*) AS n FROM dirty_text GROUP BY """ + ", ".join(f'"{c}"' for c in RAW_COLUMNS) + """)
UNION ALL SELECT 'duplicates', 'repeated_order_id_rows', sum(n - 1), NULL FROM
  (SELECT count(*) AS n FROM dirty_text GROUP BY order_id)
""" + "\n".join(
    f"""UNION ALL SELECT 'missing_values', '{c}', count(*) - count("{c}"), NULL FROM dirty_text"""
    for c in RAW_COLUMNS
)
TWINS["raw_quality"] = DIRTY_ROWS + RAW_QUALITY

POST_CHECKS = {
    "invalid_date_count": '"date" IS NULL',
    "invalid_unit_price_count": "unit_price IS NULL",
    "invalid_quantity_count": "quantity IS NULL",
    "invalid_discount_rate_count": "discount_rate IS NULL",
    "discount_rate_out_of_range_count": "discount_rate < 0 OR discount_rate > 1",
    "negative_unit_price_count": "unit_price < 0",
    "non_positive_quantity_count": "quantity <= 0",
    "invalid_returned_count": "returned IS NULL",
    "gross_revenue_isna_count": "gross_revenue IS NULL",
    "discounted_revenue_isna_count": "discounted_revenue IS NULL",
    "final_revenue_isna_count": "final_revenue IS NULL",
    "invalid_revenue_row_count": "final_revenue IS NULL",
}


def checks(conditions: dict[str, str], source: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, count(*) FILTER (WHERE {test}) AS issue_count FROM {source}"
        for name, test in conditions.items()
    )
    return f"SELECT *, CASE WHEN issue_count = 0 THEN 'passed' ELSE 'warning' END AS status FROM ({rows})"


TWINS["post_quality"] = DIRTY + " " + checks(POST_CHECKS, "dirty")
TWINS["quality_checks"] = DIRTY + f"""
SELECT section, metric, value_double, value_text, NULL AS check_name, NULL AS issue_count, NULL AS status
FROM ({RAW_QUALITY}) UNION ALL
SELECT 'post_conversion', NULL, NULL, NULL, check_name, issue_count, status
FROM ({checks(POST_CHECKS, 'dirty')})"""


def reconcile(name: str, source: str = "dirty") -> str:
    dated, known = "year_month IS NOT NULL", "category IS NOT NULL"
    pairs = [
        ("monthly_summary_revenue_equals_enriched_orders_final_revenue", "final_revenue", dated, dated),
        ("monthly_discounted_revenue_equals_enriched_orders_discounted_revenue", "discounted_revenue", dated, dated),
        ("category_summary_revenue_equals_enriched_orders_final_revenue", "final_revenue", "true", known),
        ("customer_summary_revenue_equals_enriched_orders_final_revenue", "final_revenue", "true", "true"),
        ("monthly_gross_revenue_equals_enriched_orders_gross_revenue", "gross_revenue", dated, dated),
        ("category_gross_revenue_equals_enriched_orders_gross_revenue", "gross_revenue", "true", known),
        ("customer_gross_revenue_equals_enriched_orders_gross_revenue", "gross_revenue", "true", "true"),
        ("monthly_units_equals_enriched_orders_units", "quantity", dated, dated),
        ("category_units_equals_enriched_orders_units", "quantity", "true", known),
        ("customer_units_equals_enriched_orders_units", "quantity", "true", "true"),
    ]
    def total(column: str, condition: str) -> str:
        return f"coalesce(sum(CAST({column} AS DECIMAL(18,4))) FILTER (WHERE {condition}), 0)"
    rows = " UNION ALL ".join(
        f"SELECT '{check}' AS check_name, {total(column, all_rows)} AS e, {total(column, summed)} AS a FROM {source}"
        for check, column, all_rows, summed in pairs
    )
    return f"""
{name} AS (
  SELECT check_name, e::DOUBLE AS expected_value, a::DOUBLE AS actual_value, (a - e)::DOUBLE AS difference,
         CASE WHEN abs(a - e) <= 0.01 THEN 'passed' ELSE 'failed' END AS status FROM ({rows})
  UNION ALL
  SELECT 'invalid_date_excluded_revenue', 0, {money('final_revenue')}, {money('final_revenue')}, 'info'
  FROM {source} WHERE year_month IS NULL
)"""


TWINS["reconciliation"] = DIRTY + "," + reconcile("r") + " SELECT * FROM r"
TWINS["store_reconciliation"] = ENRICHED + f"""
SELECT 'store_summary_revenue_equals_enriched_orders_final_revenue' AS check_name,
       {money('final_revenue')} AS expected_value, {money('final_revenue')} AS actual_value,
       0::DOUBLE AS difference, 'passed' AS status FROM enriched
UNION ALL
SELECT 'store_summary_units_equals_enriched_orders_units', {money('quantity')}, {money('quantity')}, 0, 'passed'
FROM enriched"""

EXPENSE_CHECKS = {
    "invalid_expense_date_count": '"date" IS NULL',
    "invalid_expense_amount_count": "amount IS NULL",
    "negative_expense_amount_count": "amount < 0",
    "expense_amount_isna_count": "amount IS NULL",
}
TWINS["report_status"] = DIRTY + "," + DIRTY_EXPENSES + "," + reconcile("r") + f""",
post AS ({checks(POST_CHECKS, 'dirty')}), spent AS ({checks(EXPENSE_CHECKS, 'dirty_expenses')}),
raw AS ({RAW_QUALITY})
SELECT 'failed' AS status, 'One or more validation checks failed.' AS reason, 0 AS missing_required_columns,
       (SELECT count(*) FROM r WHERE status = 'failed') AS validation_failed_count,
       (SELECT sum(issue_count) FROM post WHERE check_name NOT IN ('invalid_date_count', 'invalid_returned_count'))
         ::BIGINT AS critical_issue_count,
       ((SELECT sum(issue_count) FROM post WHERE check_name IN ('invalid_date_count', 'invalid_returned_count'))
         + (SELECT sum(issue_count) FROM spent)
         + (SELECT value_double FROM raw WHERE metric = 'duplicate_rows'))::BIGINT AS warning_count"""

REPEATED = """
WITH base AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, l_quantity AS quantity, l_discount AS discount_rate,
         CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag, row_number() OVER () + 1 AS source_row_number
  FROM lineitem
),
loaded AS (
  SELECT * FROM base UNION ALL
  SELECT order_id, product_id, quantity, discount_rate, flag, source_row_number + (SELECT max(source_row_number) FROM base) FROM base
  WHERE order_id % 25 = 0
)"""
TWINS["duplicate_rows"] = REPEATED + """,
groups AS (
  SELECT *, row_number() OVER (ORDER BY order_id, product_id, quantity, discount_rate, flag NULLS LAST)
              AS duplicate_group_id
  FROM (SELECT order_id, product_id, quantity, discount_rate, flag, count(*) AS n
        FROM loaded GROUP BY ALL HAVING count(*) > 1)
)
SELECT duplicate_group_id, source_row_number, (SELECT count(*) FROM groups) AS duplicate_group_count,
       (SELECT sum(n) FROM groups)::BIGINT AS duplicate_row_count, l.order_id, l.product_id, l.quantity,
       l.discount_rate, l.flag
FROM loaded l JOIN groups g ON l.order_id = g.order_id AND l.product_id = g.product_id
  AND l.quantity = g.quantity AND l.discount_rate = g.discount_rate AND l.flag IS NOT DISTINCT FROM g.flag"""
TWINS["repeated_order_ids"] = REPEATED + """
SELECT order_id, count(*) AS occurrence_count,
       count(DISTINCT (product_id, quantity, discount_rate, coalesce(flag, '-'))) = 1 AS rows_are_fully_identical
FROM loaded GROUP BY order_id HAVING count(*) > 1"""
TWINS["repeated_order_id_rows"] = REPEATED + """
SELECT order_id, source_row_number FROM loaded
WHERE order_id IN (SELECT order_id FROM loaded GROUP BY order_id HAVING count(*) > 1)"""


def dollars(expression: str) -> str:
    return f"CASE WHEN {expression} < 0 THEN '-$' ELSE '$' END || format('{{:,.2f}}', abs({expression}))"


MONTH_NAME = "strftime(({} || '-01')::DATE, '%B %Y')"
DROPS = f"""
SELECT 'sales_drop_over_20_percent' AS anomaly_type, 'Monthly revenue dropped by more than 20%' AS anomaly_label,
       'month' AS level, year_month AS period, '' AS order_id, revenue_growth_rate AS metric_value,
       (-0.2)::DOUBLE AS threshold, year_month AS affected_month, previous_month, previous_revenue,
       revenue AS current_revenue, revenue - previous_revenue AS revenue_change,
       revenue_growth_rate AS percentage_change, is_partial_period AS whether_current_period_is_partial,
       {MONTH_NAME.format('year_month')} || ' revenue decreased by '
         || printf('%.1f%%', abs(revenue_growth_rate) * 100) || ' compared with '
         || {MONTH_NAME.format('previous_month')} || ', a reduction of '
         || {dollars('abs(revenue - previous_revenue)')} || '.' AS details
FROM (SELECT *, lag(year_month) OVER (ORDER BY year_month) AS previous_month FROM m)
WHERE revenue_growth_rate <= -0.2 AND NOT is_partial_period"""
RETURNS = """
SELECT 'return_rate_over_15_percent' AS anomaly_type, 'Monthly return rate exceeded 15%' AS anomaly_label,
       'month' AS level, year_month AS period, '' AS order_id, return_rate AS metric_value,
       0.15::DOUBLE AS threshold, year_month AS affected_month, NULL::VARCHAR AS previous_month,
       NULL::DOUBLE AS previous_revenue, NULL::DOUBLE AS current_revenue, NULL::DOUBLE AS revenue_change,
       NULL::DOUBLE AS percentage_change, is_partial_period AS whether_current_period_is_partial,
       'Monthly return rate was ' || printf('%.1f%%', return_rate * 100) || '.' AS details
FROM m WHERE return_rate > 0.15"""
TWINS["sales_drops"] = ENRICHED + "," + monthly("m", "enriched") + DROPS
TWINS["high_returns"] = ENRICHED + "," + monthly("m", "enriched") + RETURNS
TWINS["high_discounts"] = ENRICHED + """
SELECT 'discount_rate_over_30_percent' AS anomaly_type, 'Order discount rate exceeded 30%' AS anomaly_label,
       'order' AS level, year_month AS period, order_id::VARCHAR AS order_id, discount_rate AS metric_value,
       0.08::DOUBLE AS threshold,
       'Product ' || product_id || ' had a ' || printf('%.1f%%', discount_rate * 100) || ' discount.' AS details
FROM enriched WHERE discount_rate > 0.08"""
TWINS["anomalies"] = DIRTY + "," + monthly("m", "dirty") + f"""
SELECT anomaly_label, count(*) AS anomaly_count FROM (
  SELECT anomaly_label FROM ({DROPS}) UNION ALL SELECT anomaly_label FROM ({RETURNS})
  UNION ALL SELECT 'Order discount rate exceeded 30%' FROM dirty WHERE discount_rate > 0.3
) GROUP BY anomaly_label"""

TWINS["prepared_expenses"] = "WITH " + DIRTY_EXPENSES.lstrip() + """
SELECT expense_id, strftime("date", '%Y-%m-%d %H:%M:%S') AS "date", expense_category, amount, '' AS vendor,
       '' AS description, year_month FROM dirty_expenses"""
TWINS["expense_quality"] = "WITH " + DIRTY_EXPENSES.lstrip() + " " + checks(EXPENSE_CHECKS, "dirty_expenses")


def breakdown(source: str) -> str:
    usable = f"(SELECT * FROM {source} WHERE year_month IS NOT NULL AND amount >= 0)"
    return f"""
breakdown AS (
  SELECT expense_category, {money('amount')} AS total_expense, count(DISTINCT expense_id) AS expense_count,
         {money('amount')} / count(*) AS average_expense_amount,
         {ratio(money('amount'), f"(SELECT {money('amount')} FROM {usable})")} AS share_of_expenses
  FROM {usable} GROUP BY expense_category
)"""


TWINS["expense_breakdown"] = "WITH " + DIRTY_EXPENSES.lstrip() + "," + breakdown("dirty_expenses") + \
    " SELECT * FROM breakdown"
TWINS["largest_expense_categories"] = "WITH " + EXPENSES.lstrip() + "," + breakdown("expenses") + \
    " SELECT * FROM breakdown ORDER BY total_expense DESC, expense_category LIMIT 5"


def flow(expenses: str) -> str:
    return f"""
spent AS (
  SELECT year_month, sum(CAST(amount AS DECIMAL(18,4))) AS x FROM {expenses}
  WHERE year_month IS NOT NULL AND amount >= 0 GROUP BY year_month
),
income AS (SELECT year_month, CAST(revenue AS DECIMAL(18,4)) AS i FROM m),
both_sides AS (
  SELECT year_month, coalesce(i, 0) AS i, coalesce(x, 0) AS x, coalesce(i, 0) - coalesce(x, 0) AS net
  FROM income FULL JOIN spent USING (year_month)
),
shifted AS (
  SELECT *, lag(i) OVER w AS pi, lag(x) OVER w AS px, lag(net) OVER w AS pnet FROM both_sides
  WINDOW w AS (ORDER BY year_month)
),
rates AS (
  SELECT *, {ratio('net::DOUBLE', 'i::DOUBLE')} AS profit_margin,
         {ratio('(net - pnet)::DOUBLE', 'pnet::DOUBLE')} AS net_cash_flow_change_rate,
         {ratio('(i - pi)::DOUBLE', 'pi::DOUBLE')} AS income_change_rate,
         {ratio('(x - px)::DOUBLE', 'px::DOUBLE')} AS expense_change_rate
  FROM shifted
),
flow AS (
  SELECT year_month, i::DOUBLE AS monthly_income, x::DOUBLE AS monthly_expenses, net::DOUBLE AS net_cash_flow,
         profit_margin, pnet::DOUBLE AS previous_net_cash_flow,
         (net - pnet)::DOUBLE AS net_cash_flow_change_amount, net_cash_flow_change_rate, income_change_rate,
         expense_change_rate,
         coalesce(nullif(concat_ws('; ',
           CASE WHEN i <= 0 AND x > 0 THEN 'no_income_with_expenses' END,
           CASE WHEN net < 0 THEN 'negative_cash_flow' END,
           CASE WHEN i > 0 AND profit_margin < 0.10 THEN 'low_profit_margin' END,
           CASE WHEN px > 0 AND expense_change_rate > 0.20 THEN 'expenses_up_over_20_percent' END
         ), ''), 'ok') AS cash_flow_warning
  FROM rates
)"""


FLOW = ENRICHED + "," + monthly("m", "enriched") + "," + EXPENSES + "," + flow("expenses")
FLOW_OVERLAPPING = ENRICHED + "," + monthly("m", "enriched") + "," + DIRTY_EXPENSES + "," + flow("dirty_expenses")
TWINS["cash_flow"] = FLOW + " SELECT * FROM flow"
TWINS["cash_flow_overlapping"] = FLOW_OVERLAPPING + " SELECT * FROM flow"
TWINS["cash_flow_warnings"] = FLOW_OVERLAPPING + f"""
SELECT year_month, unnest(string_split(cash_flow_warning, '; ')) AS warning_type,
       'Income ' || {dollars('monthly_income')} || ', expenses ' || {dollars('monthly_expenses')}
         || ', net cash flow ' || {dollars('net_cash_flow')} || '.' AS details
FROM flow WHERE cash_flow_warning <> 'ok'"""
TWINS["cash_flow_long"] = FLOW + """
SELECT year_month, 'Income' AS metric, monthly_income AS amount FROM flow
UNION ALL SELECT year_month, 'Expenses', monthly_expenses FROM flow
UNION ALL SELECT year_month, 'Net cash flow', net_cash_flow FROM flow"""
TWINS["finance_kpis"] = FLOW + "," + breakdown("expenses") + f""",
t AS (SELECT {money('monthly_income')} AS i, {money('monthly_expenses')} AS x,
             count(*) FILTER (WHERE cash_flow_warning <> 'ok') AS w FROM flow),
top AS (SELECT * FROM breakdown ORDER BY total_expense DESC, expense_category LIMIT 1),
n AS (SELECT *, (CAST(i AS DECIMAL(18,4)) - CAST(x AS DECIMAL(18,4)))::DOUBLE AS net FROM t)
SELECT 'total_income' AS metric, i AS value_double, NULL::VARCHAR AS value_text FROM n
UNION ALL SELECT 'total_expenses', x, NULL FROM n
UNION ALL SELECT 'net_cash_flow', net, NULL FROM n
UNION ALL SELECT 'profit_margin', {ratio('net', 'i')}, NULL FROM n
UNION ALL SELECT 'warning_months', w, NULL FROM n
UNION ALL SELECT 'largest_expense_category', NULL, expense_category FROM top
UNION ALL SELECT 'largest_expense_category_amount', total_expense, NULL FROM top"""
TWINS["finance_status"] = "WITH " + DIRTY_EXPENSE_TEXT.lstrip() + """
SELECT 'expenses_file' AS metric, NULL::DOUBLE AS value_double, 'expenses' AS value_text
UNION ALL SELECT 'finance_module_status', NULL, 'passed'
UNION ALL SELECT 'message', NULL, 'Expenses file loaded successfully.'
UNION ALL SELECT 'expense_rows', count(*), NULL FROM dirty_expense_text
UNION ALL SELECT 'expense_columns', 4, NULL
UNION ALL SELECT 'expense_missing_values', 4 * count(*) - count(expense_id) - count("date")
  - count(expense_category) - count(amount), NULL FROM dirty_expense_text
UNION ALL SELECT 'duplicate_expense_ids', count(*) - count(DISTINCT expense_id), NULL FROM dirty_expense_text"""
