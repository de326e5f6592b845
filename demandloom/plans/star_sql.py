"""The queries of `star_queries` in SQL, as an independent check (DuckDB dialect)."""

from __future__ import annotations

import re

from demandloom.plans.star_queries import END, FILE_WORDS, HEADERS, LOCATION, PLAN_TYPES, START

# What the operators must look for, written out here so that the check is its own.
KINDS = "sales inventory production purchase_orders master_data external_signals".split()
KIND_WORDS = {
    "sales": "quantity qty units order product sku customer totalprice date amount volume sales".split(),
    "inventory": "stock onhand inventory warehouse location sku reorder quantity".split(),
    "production": "production line capacity machine shift schedule quantity".split(),
    "purchase_orders": "po purchase supplier eta orderdate quantity location vendor".split(),
    "master_data": "description category uom segment attribute name id".split(),
    "external_signals": "signal trend index score weather holiday sentiment date".split(),
}
SALES_ROLES = {
    "date": "date order_date orderdate".split(),
    "sku": "sku product item product_id productid".split(),
    "location": "location region store warehouse country".split(),
    "quantity": "quantity qty units orderquantity order_qty".split(),
}
REQUIRED_COLUMNS = {
    "sales": "".split(),
    "inventory": "date sku location stock_level".split(),
    "production": "date line_id sku capacity".split(),
    "purchase_orders": "po_id sku supplier location order_date eta_date".split(),
    "master_data": "sku description category uom".split(),
    "external_signals": "date location".split(),
}
DRIVERS = [
    ("trend", 0.3, "positive"),
    ("seasonality", 0.25, "positive"),
    ("promotion", 0.2, "positive"),
    ("holiday", 0.1, "positive"),
    ("price", 0.1, "negative"),
    ("weather", 0.05, "negative"),
]


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _values(rows) -> str:
    def one(value) -> str:
        return f"'{value}'" if isinstance(value, str) else str(value)

    return ", ".join("(" + ", ".join(map(one, row)) + ")" for row in rows)


# Named building blocks; `with_blocks` adds those a query needs, in this order.
BLOCKS = {
    "suppliers": """SELECT s_suppkey, s_name, r_name AS location FROM supplier
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "sales": """SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS sku, location, l_quantity AS quantity
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN suppliers ON l_suppkey = s_suppkey""",
    "brand_sales": """SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS sku, l_quantity AS quantity
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "part_sales": """SELECT CAST(l_shipdate AS DATE) AS date, 'SKU-' || l_partkey AS sku, location, l_quantity AS quantity
        FROM lineitem LEFT JOIN suppliers ON l_suppkey = s_suppkey""",
    "raw_sales": """SELECT CAST(l_shipdate AS DATE) AS date, 'SKU-' || l_partkey AS sku, location, l_quantity AS quantity,
        CAST(l_orderkey AS VARCHAR) AS "Invoice", l_linenumber AS "Line"
        FROM lineitem JOIN suppliers ON l_suppkey = s_suppkey""",
    "ordered": """SELECT CAST(o_orderdate AS DATE) AS date, r_name AS location, o_orderpriority, o_totalprice, c_acctbal
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "signals": """SELECT date, location, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS is_holiday,
        avg(c_acctbal) / 100 AS temperature, CAST(count(*) AS DOUBLE) AS google_trends_index,
        avg(CASE WHEN o_orderpriority = '2-HIGH' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS promotion, avg(o_totalprice) AS price
        FROM ordered GROUP BY date, location""",
    "steps": f"""SELECT CAST(i AS INTEGER) AS step, CAST(DATE '{START}' + CAST(i AS INTEGER) AS DATE) AS date,
        DATE '{END}' - DATE '{START}' + 1 AS steps FROM range(0, DATE '{END}' - DATE '{START}' + 1) AS t(i)""",
    "part_daily": "SELECT sku, date, sum(quantity) AS quantity FROM part_sales GROUP BY sku, date",
    "part_base": "SELECT sku, avg(quantity) AS base FROM part_daily GROUP BY sku",
    "brand_base": """SELECT sku, avg(quantity) AS base FROM
        (SELECT sku, date, sum(quantity) AS quantity FROM brand_sales GROUP BY sku, date) GROUP BY sku""",
    "shape": """SELECT step, date, 1 + 0.12::DOUBLE * sin(2.5::DOUBLE * pi() * step / steps)
            + (-0.08::DOUBLE + 0.16::DOUBLE * step / (steps - 1)) AS body,
        0.05::DOUBLE * sin(1.7::DOUBLE * 2.5::DOUBLE * pi() * step / steps) AS ripple FROM steps""",
    "part_points": "SELECT sku, date, greatest(base * body + base * ripple, 0) AS mean FROM part_base CROSS JOIN shape",
    "brand_points": "SELECT sku, date, greatest(base * body + base * ripple, 0) AS mean FROM brand_base CROSS JOIN shape",
    "demand": "SELECT sku, sum(mean) AS demand FROM part_points GROUP BY sku",
    "required": """SELECT sku, demand, demand / 30 * 10 * 1.65::DOUBLE AS safety_stock,
        demand + demand / 30 * 10 * 1.65::DOUBLE AS required FROM demand""",
    "catalog": f"""SELECT 'DS-' || l_orderkey AS dataset, ({_list(KINDS)})[l_orderkey % {len(KINDS)} + 1] AS kind,
        l_linenumber AS pos, ({_list(HEADERS)})[l_partkey % {len(HEADERS)} + 1] AS col FROM lineitem""",
    "plans": """SELECT 'PLAN-' || p_brand || '-' || p_type AS plan_id, 'FC-' || p_brand AS forecast_id, min(p_partkey) AS seq
        FROM part GROUP BY p_brand, p_type""",
    "plan_lines": """SELECT required.*, 'PLAN-' || p_brand || '-' || p_type AS plan_id
        FROM required JOIN part ON sku = 'SKU-' || p_partkey""",
    "scenarios": f"""SELECT 'SCN-' || o_orderkey AS scenario_id, 'FC-Brand#' || (o_custkey % 27 + 1) AS forecast_id,
        CASE o_orderkey % 3 WHEN 0 THEN 'PLAN-Brand#' || (o_custkey % 25 + 1) || '-' || ({_list(PLAN_TYPES)})[o_orderkey % {len(PLAN_TYPES)} + 1]
            WHEN 1 THEN '' END AS plan_id,
        nullif(o_orderpriority, '5-LOW') AS name, o_orderkey AS seq FROM orders""",
    "based": """SELECT s.*, CASE WHEN coalesce(s.plan_id, '') <> '' THEN p.plan_id ELSE f.plan_id END AS base_plan_id
        FROM scenarios s LEFT JOIN plans p ON p.plan_id = s.plan_id
        LEFT JOIN (SELECT * FROM plans QUALIFY row_number() OVER (PARTITION BY forecast_id ORDER BY seq) = 1) f
            ON f.forecast_id = s.forecast_id""",
    "factors": """SELECT 'SCN-' || l_orderkey AS scenario_id, avg(0.7503::DOUBLE + l_discount * 5) AS factor
        FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey""",
    "outcome": """SELECT scenario_id, forecast_id, name, base_plan_id, coalesce(factor, 1) AS factor,
        coalesce(volume, 0) AS base, coalesce(volume, 0) * coalesce(factor, 1) AS scenario,
        coalesce(volume, 0) * coalesce(factor, 1) - coalesce(volume, 0) AS delta
        FROM based LEFT JOIN factors USING (scenario_id)
        LEFT JOIN (SELECT plan_id AS base_plan_id, sum(required) AS volume FROM plan_lines GROUP BY plan_id) USING (base_plan_id)
        WHERE base_plan_id IS NOT NULL""",
    "told": """SELECT *, coalesce(nullif(name, ''), 'Scenario') || ': Total volume '
            || CASE WHEN delta > 0 THEN 'increase' WHEN delta < 0 THEN 'decrease' ELSE 'no change' END
            || ' from ' || printf('%.0f', base) || ' to ' || printf('%.0f', scenario) || ' units ('
            || printf('%+.1f', CASE WHEN base <> 0 THEN delta / base * 100 ELSE 0 END) || '%).'
            || CASE WHEN factor <> 1 THEN ' Average demand factor applied across shocks: x' || printf('%.2f', factor) || '.' ELSE '' END
            AS narrative FROM outcome""",
    "numbered": """SELECT sku, date, quantity, row_number() OVER (PARTITION BY sku ORDER BY date) AS i,
        count(*) OVER (PARTITION BY sku) AS n FROM part_daily""",
    "parted": "SELECT *, CASE WHEN n >= 4 THEN least(3, greatest(1, n // 4)) END AS n_val FROM numbered",
    "trained": """SELECT sku, any_value(n) AS n, any_value(n_val) AS n_val,
        avg(quantity) FILTER (WHERE i <= n - n_val) AS p_mean, max(quantity) FILTER (WHERE i <= n - n_val) AS p_max,
        max(quantity) FILTER (WHERE i = n - n_val) AS p_last FROM parted GROUP BY sku""",
    "scores": """SELECT sku,
        CASE WHEN t.n >= 4 THEN coalesce(avg(abs(quantity - p_mean) / quantity) FILTER (WHERE quantity > 0), 'inf'::DOUBLE) END AS mean_mape,
        avg(abs(quantity - p_mean)) AS mean_mae,
        CASE WHEN t.n >= 4 THEN coalesce(avg(abs(quantity - p_last) / quantity) FILTER (WHERE quantity > 0), 'inf'::DOUBLE) END AS last_mape,
        avg(abs(quantity - p_last)) AS last_mae,
        CASE WHEN t.n >= 4 THEN coalesce(avg(abs(quantity - p_max) / quantity) FILTER (WHERE quantity > 0), 'inf'::DOUBLE) END AS max_mape,
        avg(abs(quantity - p_max)) AS max_mae
        FROM trained t LEFT JOIN (SELECT sku, quantity FROM parted WHERE i > n - n_val) h USING (sku) GROUP BY sku, t.n""",
    "chosen": """SELECT *, CASE WHEN mean_mape IS NULL THEN 'stub'
        WHEN mean_mape <= last_mape AND mean_mape <= max_mape THEN 'mean'
        WHEN last_mape <= max_mape THEN 'last' ELSE 'max' END AS model FROM scores""",
    "by_date": """SELECT date, strftime(date, '%m-%d') AS label, sum(mean) AS mean, sum(mean * 0.8::DOUBLE) AS q10,
        sum(mean * 1.2::DOUBLE) AS q90 FROM part_points GROUP BY date""",
}


def with_blocks(sql: str) -> str:
    """The query with the blocks it names, directly or through other blocks."""
    def names(text: str) -> set[str]:
        return set(re.findall(r"\b[a-z_]+\b", text)) & set(BLOCKS)

    wanted, queue = set(), list(names(sql))
    while queue:
        block = queue.pop()
        if block not in wanted:
            wanted.add(block)
            queue += names(BLOCKS[block]) - {block}
    head = ", ".join(f"{name} AS ({BLOCKS[name]})" for name in BLOCKS if name in wanted)
    if not head:
        return sql
    return f"WITH {head}, {sql.removeprefix('WITH ')}" if sql.startswith("WITH ") else f"WITH {head} {sql}"


def _rounded(columns: str, digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())


_CLEAN = "replace(replace(lower(trim(col)), ' ', ''), '_', '')"
_SIGNALS = "is_holiday temperature google_trends_index promotion price".split()
_MERGED = (
    "SELECT s.*, is_holiday, temperature, google_trends_index, promotion, price FROM sales s "
    "LEFT JOIN signals g ON s.date IS NOT DISTINCT FROM g.date AND s.location IS NOT DISTINCT FROM g.location"
)
_CANDIDATES = _values(
    (role, i, c.replace("_", "")) for role, names in SALES_ROLES.items() for i, c in enumerate(names)
)
_WORDS = _values((i, kind, w) for i, (kind, words) in enumerate(KIND_WORDS.items()) for w in words)
_REQUIRED = _values((kind, c, c.replace("_", "")) for kind, names in REQUIRED_COLUMNS.items() for c in names)
_FILE_NAME = f"({_list(FILE_WORDS)})[p_partkey % {len(FILE_WORDS)} + 1] || '_' || replace(p_name, ' ', '-') || '_2024.csv'"
_SCORE_COLUMNS = "mean_mape mean_mae last_mape last_mae max_mape max_mae"


def _horizon(keep: str) -> str:
    return f"""SELECT sku, date FROM (SELECT sku, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS date
        FROM (SELECT sku, min(date) AS first, max(date) AS last FROM brand_sales GROUP BY sku)) WHERE {keep}"""


def _naive(totals: str) -> str:
    return f"""SELECT round(any_value(b), 4) AS baseline, round(avg(abs(total - b) / greatest(total, 1)), 4) AS mape
        FROM (SELECT total, avg(total) OVER () AS b FROM ({totals}))"""


#: How a raw date is written, by line number modulo 7.
_WRITTEN = "CASE \"Line\" % 7 " + " ".join(
    f"WHEN {i} THEN {text}"
    for i, text in enumerate(
        [
            "month(date) || '/' || day(date) || '/' || year(date)", "strftime(date, '%Y-%m-%d')", "month(date) || '/' || day(date) || '/' || strftime(date, '%y')",
            "strftime(date, '%Y%m%d')", "month(date) || '-' || day(date) || '-' || year(date)", "day(date) || '.' || month(date) || '.' || year(date)",
            "strftime(date, '%b ') || day(date) || ', ' || year(date)",
        ]
    )
) + " END"
_FORMATS = "['%m/%d/%Y', '%Y-%m-%d', '%m/%d/%y', '%Y%m%d', '%m-%d-%Y', '%d.%m.%Y', '%b %d, %Y']"


def _inferred() -> str:
    """Each text column judged by whether all its values pass a test, narrowest first."""
    tests = {
        "boolean": "lower({c}) IN ('true', 'false')",
        "bigint": "regexp_full_match({c}, '[+-]?(0|[1-9][0-9]{{0,17}})')",
        "double": "regexp_full_match({c}, '[+-]?((0|[1-9][0-9]*)([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')",
        "date": f"try_strptime({{c}}, {_FORMATS}) IS NOT NULL",
    }
    columns = ["Order_Date", "Product ID", "Region", "Order Qty", "Invoice", "Line", "Rush", "Mixed", "Zeros", "Empty", "Change", "Shipped"]
    parts = []
    for pos, name in enumerate(columns):
        c = f'"{name}"'
        order = ["date", "boolean", "bigint", "double"] if "date" in name.lower() else ["boolean", "bigint", "double", "date"]
        cases = " ".join(f"WHEN bool_and({tests[k].format(c=c)}) THEN '{k}'" for k in order)
        kind = {"Product ID": "'string'", "Region": "'string'", "Line": "'int'"}.get(name, f"CASE WHEN count({c}) = 0 THEN 'double' {cases} ELSE 'string' END")
        parts.append(f"SELECT {pos}::INTEGER AS pos, '{name}' AS name, {kind} AS dtype, count({c}) AS filled, count(*) - count({c}) AS missing FROM typed_text")
    return f"""WITH typed_text AS (SELECT {_WRITTEN} AS "Order_Date", sku AS "Product ID", location AS "Region",
        CAST(quantity AS VARCHAR) AS "Order Qty", "Invoice", "Line", CASE WHEN "Line" % 2 = 0 THEN 'True' ELSE 'FALSE' END AS "Rush",
        CASE WHEN "Line" = 7 THEN location ELSE CAST(quantity AS VARCHAR) END AS "Mixed", '00' || "Line" AS "Zeros", NULL::VARCHAR AS "Empty",
        CASE WHEN "Line" > 2 THEN '-' || "Line" || 'e-2' END AS "Change", {_WRITTEN} AS "Shipped" FROM raw_sales) """ + " UNION ALL ".join(parts)


def _resampled(granularity: str, daily: str = "part_daily") -> str:
    """Periods with zeros for those without sales, and whether the first and last are partial."""
    end = {"W": "date + CAST((7 - isodow(date)) % 7 AS INTEGER)", "M": "last_day(date)"}[granularity]
    start = {"W": "e - 6", "M": "CAST(date_trunc('month', e) AS DATE)"}[granularity]
    steps = {
        "W": "unnest(generate_series(first_end, last_end, INTERVAL 7 DAY))",
        "M": "last_day(CAST(unnest(generate_series(date_trunc('month', first_end), date_trunc('month', last_end), INTERVAL 1 MONTH)) AS DATE))",
    }[granularity]
    return f"""WITH dated AS (SELECT sku, date, quantity, CAST({end} AS DATE) AS e FROM {daily}),
        sums AS (SELECT sku, e, sum(quantity) AS quantity FROM dated GROUP BY sku, e),
        spans AS (SELECT sku, min(date) AS first, max(date) AS last, min(e) AS first_end, max(e) AS last_end FROM dated GROUP BY sku),
        ends AS (SELECT sku, first, last, first_end, last_end, CAST({steps} AS DATE) AS e FROM spans)
        SELECT sku, e AS date, coalesce(quantity, 0.0::DOUBLE) AS quantity, (e = first_end AND first > {start}) OR (e = last_end AND last < e) AS partial
        FROM ends LEFT JOIN sums USING (sku, e)"""


RAW_SQL = {
    "harmonized_sales": 'SELECT date, sku, location, quantity, "Invoice", "Line" FROM raw_sales',
    "unreadable_values": """SELECT count(*) AS rows, count(*) FILTER (WHERE "Line" = 7) AS bad_dates,
        count(*) FILTER (WHERE quantity = 13) AS bad_quantities FROM raw_sales""",
    "inferred_types": _inferred(),
    "bad_signals": f"""SELECT day, location, concat_ws(',', CASE WHEN day(day) = 31 THEN 'date' END,
        CASE WHEN location = '{LOCATION}' AND day(day) = 1 THEN 'is_holiday' END, CASE WHEN day(day) = 2 THEN 'price' END) AS unreadable
        FROM (SELECT date AS day, location FROM signals) WHERE day(day) IN (2, 31) OR (location = '{LOCATION}' AND day(day) = 1)""",
    "lag_rows": """SELECT sku, date, round(before / m, 6) AS previous, round(quantity / m, 6) AS value FROM (
        SELECT sku, date, quantity, lag(quantity) OVER s AS before, CASE WHEN avg(quantity) OVER p > 0 THEN avg(quantity) OVER p ELSE 1 END AS m,
            count(*) OVER p AS n FROM part_daily WINDOW s AS (PARTITION BY sku ORDER BY date), p AS (PARTITION BY sku))
        WHERE n >= 6 AND before IS NOT NULL""",
    "preview_defaults": """SELECT CAST(row_number() OVER (ORDER BY seen, sku) - 1 AS INTEGER) AS place, sku, start_date, end_date FROM (
        SELECT sku, min(struct_pack(a := "Invoice", b := "Line", c := sku, d := CAST(quantity AS VARCHAR))) AS seen FROM (
            SELECT * FROM raw_sales ORDER BY "Invoice", "Line", sku, CAST(quantity AS VARCHAR) LIMIT 20) GROUP BY sku)
        CROSS JOIN (SELECT min(date) AS start_date, max(date) AS end_date FROM (
            SELECT * FROM raw_sales ORDER BY "Invoice", "Line", sku, CAST(quantity AS VARCHAR) LIMIT 20))""",
    "forced_contract": """SELECT sku, forced, CASE WHEN n >= least_history THEN forced ELSE 'stub' END AS model,
        CASE WHEN n >= least_history THEN 30 ELSE 0 END AS steps, true AS not_below_zero
        FROM (SELECT sku, count(*) AS n FROM (
            SELECT DISTINCT 'SKU-' || l_partkey || '-' || s_nationkey AS sku, CAST(l_shipdate AS DATE) AS date FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY sku)
        CROSS JOIN (VALUES ('arima', 4), ('prophet', 4), ('xgboost', 6)) m(forced, least_history)""",
    "pooled_contract": """SELECT sku, CAST(count(*) AS INTEGER) AS history, CASE WHEN count(*) >= 6 THEN 30 ELSE 0 END AS steps, true AS not_below_zero
        FROM (SELECT DISTINCT 'SKU-' || l_partkey || '-' || s_nationkey AS sku, CAST(l_shipdate AS DATE) AS date FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
        GROUP BY sku""",
    "resampled_week": _resampled("W"),
    "resampled_month": _resampled("M"),
    "whole_weeks": f"""SELECT sku, date, quantity FROM (
        SELECT *, bool_or(NOT partial) OVER (PARTITION BY sku) AS any_whole FROM ({_resampled('W', 'brand_daily').replace('WITH dated', 'WITH brand_daily AS (SELECT sku, date, sum(quantity) AS quantity FROM brand_sales GROUP BY sku, date), dated')}))
        WHERE NOT partial OR NOT any_whole""",
    "guess_columns": f"""SELECT dataset, role, original AS "column" FROM (
        SELECT dataset, role, original, row_number() OVER (PARTITION BY dataset, role
            ORDER BY CASE WHEN cleaned = key THEN 0 ELSE 1 END, rank, place) AS r
        FROM (SELECT dataset, {_CLEAN} AS cleaned, min(printf('%04d', pos) || col) AS place,
                substr(max(printf('%04d', pos) || col), 5) AS original FROM catalog GROUP BY 1, 2) n
        JOIN (VALUES {_CANDIDATES}) c(role, rank, key) ON contains(n.cleaned, c.key)) WHERE r = 1""",
    "required_columns": f"""SELECT dataset, kind, coalesce(missing, '') AS missing,
        'Missing expected columns for ' || kind || ': ' || missing AS warning
        FROM (SELECT DISTINCT dataset, kind FROM catalog) d LEFT JOIN (
            SELECT dataset, kind, string_agg(name, ', ' ORDER BY name) AS missing
            FROM (SELECT DISTINCT dataset, kind FROM catalog) JOIN (VALUES {_REQUIRED}) r(kind, name, cleaned) USING (kind)
            ANTI JOIN (SELECT dataset, replace(replace(lower(col), ' ', ''), '_', '') AS cleaned FROM catalog) USING (dataset, cleaned)
            GROUP BY dataset, kind) USING (dataset, kind)""",
    "dataset_kind": f"""WITH cols AS (SELECT dataset, regexp_replace(lower(col), '[\\s_\\-]', '', 'g') AS cleaned FROM catalog),
        flags AS (SELECT dataset, bool_or(regexp_matches(cleaned, 'quantity|qty|units|amount|volume')) AS many,
            bool_or(regexp_matches(cleaned, 'date|time|period|sales|order|customer')) AS trade FROM cols GROUP BY dataset),
        hits AS (SELECT dataset, rank, kind, count(DISTINCT word) AS score FROM cols
            JOIN (VALUES {_WORDS}) w(rank, kind, word) ON contains(cleaned, word) GROUP BY ALL),
        best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY score DESC, rank) = 1)
        SELECT dataset, CASE WHEN score >= 2 OR (score = 1 AND kind = 'sales' AND many AND trade) THEN kind END AS kind,
            CAST(coalesce(score, 0) AS INTEGER) AS score FROM flags LEFT JOIN best USING (dataset)""",
    "file_kind": f"""SELECT p_partkey, file_name, CASE WHEN regexp_matches(f, 'sales|sell') THEN 'sales'
        WHEN regexp_matches(f, 'inventory|stock') THEN 'inventory'
        WHEN regexp_matches(f, 'production|manufacturing') THEN 'production'
        WHEN regexp_matches(f, 'purchase|po_|vendor') THEN 'purchase_orders'
        WHEN regexp_matches(f, 'master|catalog') THEN 'master_data'
        WHEN regexp_matches(f, 'signal|external|macro') THEN 'external_signals' END AS kind
        FROM (SELECT p_partkey, {_FILE_NAME} AS file_name, lower({_FILE_NAME}) AS f FROM part)""",
    "column_roles": """SELECT CAST(pos AS INTEGER) AS pos, name, dtype, role FROM (VALUES
        (0, 'Order_Date', 'string', 'date'), (1, 'Product ID', 'string', 'categorical'), (2, 'Region', 'string', 'categorical'),
        (3, 'Order Qty', (SELECT CASE WHEN count(try_cast(CAST(quantity AS VARCHAR) AS DOUBLE)) = count(*) THEN 'double' ELSE 'string' END FROM raw_sales), 'numeric'),
        (4, 'Invoice', (SELECT CASE WHEN count(try_cast("Invoice" AS BIGINT)) = count(*) THEN 'bigint' ELSE 'string' END FROM raw_sales), 'numeric'),
        (5, 'Line', 'int', 'numeric')) t(pos, name, dtype, role)""",
    "dataset_preview": "SELECT date, sku, location, quantity FROM sales ORDER BY date, sku, location, quantity LIMIT 20",
    "dataset_profile": """SELECT count(*) AS rows, 4 AS columns, 'date, sku, location, quantity' AS column_text,
        count(DISTINCT sku) AS skus, count(DISTINCT location) AS locations, min(date) AS first_date, max(date) AS last_date FROM sales""",
    "merged_profile": """SELECT count(DISTINCT year(date)) AS uploads, count(*) AS rows, true AS skus_close,
        count(DISTINCT location) AS locations, min(date) AS first_date, max(date) AS last_date FROM part_sales""",
    "default_skus": """SELECT CAST(row_number() OVER (ORDER BY seen, sku) - 1 AS INTEGER) AS place, sku FROM (
        SELECT sku, min(struct_pack(a := "Invoice", b := "Line")) AS seen FROM raw_sales GROUP BY sku ORDER BY seen, sku LIMIT 20)""",
    "default_dates": "SELECT min(date) AS start_date, max(date) AS end_date FROM raw_sales",
    "sales_with_signals": f"SELECT date, sku, location, quantity, is_holiday, {_rounded('temperature', 8)}, {_rounded(' '.join(_SIGNALS[2:]), 6)} FROM ({_MERGED})",
    "signals_filled": "SELECT date, sku, location, quantity, coalesce(is_holiday, 0) AS is_holiday, "
    + ", ".join(f"round(coalesce({c}, avg({c}) OVER ()), {8 if c == 'temperature' else 6}) AS {c}" for c in _SIGNALS[1:])
    + f" FROM ({_MERGED})",
    "repeated_signal_keys": "SELECT date, location, count(*) AS copies FROM ordered GROUP BY date, location HAVING count(*) > 1",
    "signal_summary": """SELECT 'Google search interest moved from ' || printf('%.0f', a) || ' to ' || printf('%.0f', b)
        || ' over the last 14 days (' || printf('%+.1f', CASE WHEN a > 0 THEN (b - a) / a * 100 ELSE 0 END) || '% change). '
        || 'Observed temperature range in the same window: ' || printf('%.1f', lo) || '–' || printf('%.1f', hi) || '°C.'
        || CASE WHEN holidays > 0 THEN ' Recent days include holidays, which may drive demand peaks.' ELSE '' END AS summary
        FROM (SELECT first(google_trends_index ORDER BY date, location) AS a, last(google_trends_index ORDER BY date, location) AS b,
            min(temperature) AS lo, max(temperature) AS hi, sum(is_holiday) AS holidays
            FROM signals WHERE date >= (SELECT max(date) FROM signals) - 14)""",
    "signal_facts": f"""SELECT count(*) AS rows, round(first(google_trends_index ORDER BY date), 4) AS trend_first,
        round(last(google_trends_index ORDER BY date), 4) AS trend_last, round(min(temperature), 4) AS temperature_min,
        round(max(temperature), 4) AS temperature_max, CAST(sum(is_holiday) AS DOUBLE) AS holidays
        FROM signals WHERE location = '{LOCATION}'
        AND date >= (SELECT max(date) FROM signals WHERE location = '{LOCATION}') - 60""",
    "daily_demand": "SELECT sku, date, quantity FROM part_daily",
    "daily_demand_repeated_signals": """SELECT sku, s.date AS date, sum(quantity) AS quantity
        FROM sales s LEFT JOIN ordered o ON s.date = o.date AND s.location = o.location GROUP BY sku, s.date""",
    "location_fallback": f"""SELECT sku, date, sum(quantity) AS quantity FROM
        (SELECT *, bool_or(location = '{LOCATION}') OVER (PARTITION BY sku) AS hit FROM part_sales)
        WHERE NOT hit OR location = '{LOCATION}' GROUP BY sku, date""",
    "event_demand": """SELECT CAST(ts AS DATE) AS date, 'USER-' || user_id AS sku, round(sum(value), 4) AS quantity
        FROM events WHERE event_type = 'purchase' GROUP BY ALL""",
    "horizon_day": _horizon("true"),
    "horizon_week": _horizon("dayofweek(date) = 0"),
    "horizon_month": _horizon("date = last_day(date)"),
    "baseline_forecast": "SELECT sku, date, round(mean, 4) AS mean FROM part_points",
    "forecast_band": """SELECT sku, date, round(mean, 4) AS mean, round(mean * 0.8::DOUBLE, 4) AS q10, round(mean, 4) AS q50,
        round(mean * 1.2::DOUBLE, 4) AS q90 FROM brand_points""",
    "requested_forecast": """SELECT CAST(seq AS INTEGER) AS seq, sku, date, round(greatest(coalesce(base, 100) * body + coalesce(base, 100) * ripple, 0), 4) AS mean
        FROM (SELECT 'SKU-' || (s_suppkey * 37 % 3000) AS sku, s_suppkey AS seq FROM supplier
            UNION ALL SELECT 'SKU-' || (c_custkey * 37 % 3000), -c_custkey - 1 FROM customer)
        LEFT JOIN part_base USING (sku) CROSS JOIN shape""",
    "holdout_split": """SELECT sku, CAST(any_value(n) AS INTEGER) AS history, CAST(any_value(n_val) AS INTEGER) AS n_val,
        CASE WHEN any_value(n_val) IS NOT NULL THEN CAST(count(*) FILTER (WHERE i <= n - n_val) AS INTEGER) END AS train_points,
        max(date) FILTER (WHERE i <= n - n_val) AS train_end, min(date) FILTER (WHERE i > n - n_val) AS holdout_start,
        sum(quantity) FILTER (WHERE i > n - n_val) AS holdout_total FROM parted GROUP BY sku""",
    "naive_scores": f"SELECT sku, {_rounded(_SCORE_COLUMNS, 6)} FROM scores",
    "model_select": """SELECT sku, model, CASE model WHEN 'stub' THEN 0.0::DOUBLE WHEN 'mean' THEN 1.0::DOUBLE
        WHEN 'last' THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS code FROM chosen""",
    "metric_map": "SELECT sku, key, value FROM ("
    + " UNION ALL ".join(f"SELECT sku, sku || '.{c}' AS key, round({c}, 6) AS value FROM scores" for c in _SCORE_COLUMNS.split())
    + """ UNION ALL SELECT sku, sku || '.chosen_model', CASE model WHEN 'stub' THEN 0.0::DOUBLE WHEN 'mean' THEN 1.0::DOUBLE
        WHEN 'last' THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END FROM chosen) WHERE value IS NOT NULL""",
    "best_score": """SELECT sku, model, round(CASE model WHEN 'mean' THEN mean_mape WHEN 'last' THEN last_mape WHEN 'max' THEN max_mape END, 6) AS mape,
        round(CASE model WHEN 'mean' THEN mean_mae WHEN 'last' THEN last_mae WHEN 'max' THEN max_mae END, 6) AS mae FROM chosen""",
    "model_counts": "SELECT model, count(*) AS skus FROM chosen GROUP BY model",
    "demand_summary": f"""SELECT sku, round(demand, 4) AS demand, (SELECT min(date) FROM part_points) AS first_date,
        CAST((SELECT max(date) - min(date) + 1 FROM part_points) AS INTEGER) AS horizon_days FROM demand""",
    "safety_stock": """SELECT sku, round(demand, 4) AS demand, round(s, 4) AS safety_stock, round(demand + s, 4) AS required FROM (
        SELECT sku, demand, demand / 30 * p_size * CASE WHEN p_size > 25 THEN 1.65::DOUBLE ELSE 1.0::DOUBLE END AS s
        FROM demand JOIN part ON sku = 'SKU-' || p_partkey)""",
    "supply_plan": f"""SELECT sku, 'purchase' AS line, '{LOCATION}' AS location, DATE '{START}' AS date, round(required * 0.4::DOUBLE, 4) AS quantity
        FROM required WHERE required * 0.4 > 0
        UNION ALL SELECT sku, 'LINE-1', NULL, DATE '{START}', round(required * 0.6::DOUBLE, 4) FROM required WHERE required * 0.6 > 0""",
    "plan_kpis": """SELECT 0 AS position, 'Total Volume' AS name, round(sum(required), 2) AS value, 'units' AS unit FROM required
        UNION ALL SELECT 1, 'Target Service Level', 0.95::DOUBLE, ''""",
    "kpi_lookup": """SELECT plan_id, round(sum(required), 2) AS volume, format('{:,}', CAST(round(sum(required)) AS BIGINT)) || ' units' AS volume_label,
        0.95::DOUBLE AS service_level, '95.0%' AS service_label FROM plan_lines GROUP BY plan_id""",
    "plan_summary": """SELECT plan_id, 'Key KPIs: Total Volume: ' || printf('%.2f', sum(required)) || ' units; Target Service Level: 0.95 .' AS text
        FROM plan_lines GROUP BY plan_id""",
    "latest_plan": "SELECT plan_id, forecast_id, seq FROM plans ORDER BY seq DESC LIMIT 1",
    "scenario_base_plan": """SELECT scenario_id, base_plan_id, CASE WHEN base_plan_id IS NOT NULL THEN 'ok'
        WHEN coalesce(plan_id, '') <> '' THEN 'plan_not_found' ELSE 'no_base_plan' END AS status FROM based""",
    "scenario_kpis": f"""SELECT scenario_id, base_plan_id, 'Total Volume' AS kpi, {_rounded('factor', 8)}, {_rounded('base scenario delta')}, 'units' AS unit FROM outcome""",
    "delta_percent": "SELECT scenario_id, round(100 * delta / nullif(base, 0), 4) AS delta_percent FROM outcome",
    "scenario_narrative": "SELECT scenario_id, narrative FROM told",
    "scenario_list": "SELECT scenario_id, forecast_id, plan_id, name FROM scenarios WHERE forecast_id = 'FC-Brand#7'",
    "scenario_overview": """SELECT (SELECT count(*) FROM scenarios) AS scenarios, 'There are ' || (SELECT count(*) FROM scenarios)
        || ' scenarios in the current session. Examples: ' || string_agg(coalesce(name, 'Scenario') || ' (' || substr(scenario_id, 1, 8)
        || '...) for forecast ' || forecast_id, '; ' ORDER BY seq) || '.' AS text
        FROM (SELECT * FROM scenarios ORDER BY seq LIMIT 5)""",
    "scenario_text": """SELECT scenario_id, 'Selected scenario ' || coalesce(name, 'Scenario') || ' (' || scenario_id || ') for forecast '
        || forecast_id || '. ' || narrative AS text FROM told""",
    "session_counts": """SELECT 'forecasts' AS item, count(DISTINCT p_brand) AS items FROM part
        UNION ALL SELECT 'plans', count(*) FROM plans UNION ALL SELECT 'scenarios', count(*) FROM scenarios""",
    "drivers_by_sku": f"""SELECT sku, position, feature, round(w * (1 + 0.05::DOUBLE * k), 4) AS importance, direction,
        round(w * (1 + 0.05::DOUBLE * k) * 100, 4) AS importance_percent
        FROM (SELECT sku, row_number() OVER (ORDER BY sku) - 1 AS k FROM (SELECT DISTINCT sku FROM part_sales))
        CROSS JOIN (SELECT position, feature, CAST(w AS DOUBLE) AS w, direction FROM
            (VALUES {_values((i, *d) for i, d in enumerate(DRIVERS))}) v(position, feature, w, direction))""",
    "top_skus": """SELECT CAST(row_number() OVER (ORDER BY demand DESC, sku) AS INTEGER) AS rank, sku, round(demand, 4) AS total,
        round(demand / max(demand) OVER (), 4) AS share FROM (SELECT * FROM demand ORDER BY demand DESC, sku LIMIT 5)""",
    "demand_by_date": f"SELECT date, label, {_rounded('mean q10 q90', 2)} FROM by_date",
    "first_periods": """SELECT date, strftime(date, '%m-%d') AS label, sum(quantity) AS mean, sum(quantity) AS q10, sum(quantity) AS q90
        FROM part_sales GROUP BY date ORDER BY date LIMIT 30""",
    "demand_pivot": "SELECT date, "
    + ", ".join(f"round(avg(mean) FILTER (sku = 'Brand#{i}'), 4) AS \"Brand#{i}\"" for i in range(1, 26))
    + " FROM brand_points GROUP BY date",
    "demand_long": "SELECT date, sku, round(avg(mean), 4) AS mean FROM part_points GROUP BY date, sku",
    "band_limits": """SELECT round(hi, 2) AS max_band, round(lo, 2) AS min_band, CAST(greatest(0, floor(lo * 0.9::DOUBLE)) AS BIGINT) AS axis_low,
        CAST(ceil(hi * 1.1::DOUBLE) AS BIGINT) AS axis_high FROM (
        SELECT max(greatest(coalesce(nullif(q90, 0), mean), mean)) AS hi, min(least(coalesce(nullif(q10, 0), mean), mean)) AS lo FROM by_date)""",
    "forecast_totals": """SELECT round(sum(mean), 2) AS volume, count(DISTINCT date) AS periods, count(DISTINCT sku) AS skus,
        format('{:,}', CAST(round(sum(mean)) AS BIGINT)) || ' units' AS volume_label,
        count(DISTINCT date) || ' periods · ' || count(DISTINCT sku) || ' SKUs' AS horizon_label FROM part_points""",
    "forecast_summary": """SELECT 'Forecast FC-1 uses model arima_prophet_xgb_ensemble v1.0.0. Top SKUs by volume: '
        || (SELECT string_agg(sku || ' (~' || printf('%.1f', demand) || ' units)', ', ' ORDER BY demand DESC, sku)
            FROM (SELECT * FROM demand ORDER BY demand DESC, sku LIMIT 5))
        || '. Per-SKU model selection: '
        || (SELECT string_agg(model || ': ' || n || ' SKUs', ', ' ORDER BY f) FROM (SELECT model, count(*) AS n, min(sku) AS f FROM chosen GROUP BY model))
        || '.' AS text""",
    "naive_mape": _naive("SELECT date, sum(quantity) AS total FROM part_sales GROUP BY date"),
    "naive_mape_repeated_signals": _naive(
        """SELECT s.date, sum(quantity) AS total FROM sales s
        LEFT JOIN ordered o ON s.date = o.date AND s.location = o.location GROUP BY s.date"""
    ),
    "naive_mape_of_state": _naive(
        """SELECT s.date, sum(quantity) AS total FROM sales s
        LEFT JOIN ordered o ON s.date = o.date AND s.location = o.location GROUP BY s.date"""
    ),
    "training_state": "SELECT sku AS source, date, location, sum(quantity) AS quantity, count(*) AS n FROM sales GROUP BY sku, date, location",
    "published_events": """SELECT 'events' AS topic, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type
        || '","day":"' || strftime(ts, '%Y-%m-%d') || '","value":' || CAST(value AS VARCHAR) || '}' AS value FROM events""",
    "typed_signals": f"SELECT date, location, is_holiday, {_rounded('temperature', 8)}, {_rounded(' '.join(_SIGNALS[2:]), 6)} FROM signals",
    "forced_stub_forecast": """SELECT sku, date, round(mean, 4) AS mean, round(mean * 0.8::DOUBLE, 4) AS q10, round(mean, 4) AS q50,
        round(mean * 1.2::DOUBLE, 4) AS q90 FROM brand_points""",
    "fallback_forecast": f"""WITH short_daily AS (SELECT 'SKU-' || l_partkey || '-' || s_nationkey AS sku, CAST(l_shipdate AS DATE) AS date,
            sum(l_quantity) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
        short_base AS (SELECT sku, avg(quantity) AS base FROM short_daily GROUP BY sku HAVING count(*) < 4),
        ends AS (SELECT sku, date, greatest(base * body + base * ripple, 0) AS mean FROM short_base CROSS JOIN shape)
        SELECT sku, round(max(mean) FILTER (WHERE date = DATE '{START}'), 4) AS first_mean,
            round(max(mean) FILTER (WHERE date = DATE '{END}'), 4) AS last_mean FROM ends GROUP BY sku""",
    "fit_contract": f"""SELECT sku, CAST(count(DISTINCT date) AS INTEGER) AS history, DATE '{END}' - DATE '{START}' + 1 AS steps, 6 AS scores,
        true AS least_mape, true AS whole_path, true AS band, CAST(DATE '{END}' - DATE '{START}' + 1 AS BIGINT) AS points
        FROM brand_sales GROUP BY sku""",
}

ORACLES = {name: with_blocks(sql) for name, sql in RAW_SQL.items()}
