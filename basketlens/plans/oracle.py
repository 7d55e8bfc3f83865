"""Reference SQL (DuckDB dialect) for every catalog query with a SQL form.

Each statement is self-contained: it rebuilds the bound order lines from the
base tables in a ``WITH`` clause, then computes the report the plain-SQL way
(windows over ``()``, ``count(DISTINCT)``, cross joins with one-row
thresholds) so it checks the Spark plans without sharing their strategy.
"""

from __future__ import annotations

from basketlens.operators import kmeans, segments
from basketlens.sources import tables

AS_OF = "TIMESTAMP '2001-08-01 00:00:00'"


def _sql_str(v: str | None) -> str:
    if v is None:
        return "NULL"
    parts = []
    buf = ""
    for ch in v:
        if ch == "'" or ch.isprintable() and ch != "\t":
            buf += "''" if ch == "'" else ch
        else:
            if buf:
                parts.append(f"'{buf}'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
    if buf or not parts:
        parts.append(f"'{buf}'")
    return " || ".join(parts) if len(parts) > 1 else parts[0]


def _sql_list(values: list) -> str:
    return "[" + ", ".join(f"CAST({_sql_str(v)} AS VARCHAR)" for v in values) + "]"


STRIP = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _strip(x: str) -> str:
    return STRIP.format(x=x)


def _norm(x: str) -> str:
    """NFKD-to-ASCII + lower: strip accents, lower, drop what is still not ASCII."""
    return f"regexp_replace(lower(strip_accents({x})), '[^\\x00-\\x7F]', '', 'g')"


CUST_TOTALS = """cust_tot AS (
  SELECT o_custkey AS t_custkey, count(*) AS customer_total_orders,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS customer_total_spent,
         min(o_orderdate) AS customer_first_order, max(o_orderdate) AS customer_last_order
  FROM orders GROUP BY o_custkey)"""

FIRST = _sql_list(tables.FIRST_NAMES)
LAST = _sql_list(tables.LAST_NAMES)

RAW_LINES = f"""raw_lines AS (
  SELECT l.l_orderkey AS order_number, l.l_orderkey * 8 + l.l_linenumber AS line_no,
         o.o_orderdate AS order_date, o.o_orderstatus AS order_status,
         n.n_name AS city,
         c.c_name || '@example.com' AS email,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS line_total,
         CASE WHEN o.o_orderpriority = '1-URGENT'
              THEN CAST(o.o_totalprice AS DECIMAL(18,2)) * CAST(0.05 AS DECIMAL(3,2))
              ELSE CAST(0 AS DECIMAL(3,2)) END AS refund_amount,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(4,2)) AS discount_amount,
         t.customer_total_spent, t.customer_total_orders, t.customer_first_order, t.customer_last_order,
         l.l_partkey AS item_id, p.p_name AS item_name, l.l_quantity AS quantity,
         CAST(p.p_size % 10 AS DOUBLE) AS stock_quantity,
         'Shop > ' || p.p_type || ' > ' || p.p_brand || ' ' AS category_path,
         c.c_mktsegment AS gender, o.o_orderpriority AS origin,
         ({FIRST})[c.c_custkey % 10 + 1] AS first_name,
         ({LAST})[c.c_custkey % 10 + 1] AS last_name
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN cust_tot t ON o.o_custkey = t.t_custkey)"""

LINES = """lines AS (
  SELECT *, CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month,
         line_total - discount_amount AS line_revenue
  FROM raw_lines WHERE order_status = 'F')"""

ORDERS = """order_totals AS (
  SELECT order_number, min(order_date) AS order_date, min(year) AS year, min(month) AS month,
         sum(line_revenue) AS line_revenue, arg_min(refund_amount, line_no) AS refund_amount,
         sum(line_revenue) - arg_min(refund_amount, line_no) AS net_revenue
  FROM lines WHERE order_number IS NOT NULL GROUP BY order_number)"""

MONTHLY = """monthly AS (
  SELECT year, month, sum(net_revenue) AS net_revenue FROM order_totals
  WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month)"""

RECENT = """recent AS (
  SELECT * FROM lines WHERE year IN (
    SELECT DISTINCT year FROM lines WHERE year IS NOT NULL ORDER BY year DESC LIMIT 2))"""

RECENT_ORDERS = """recent AS (
  SELECT * FROM lines WHERE year IN (
    SELECT DISTINCT year FROM lines WHERE year IS NOT NULL AND order_number IS NOT NULL
    ORDER BY year DESC LIMIT 2))"""

CITY_MAP = """city_map AS (
  SELECT n.n_name AS city, r.r_name AS county FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)"""

REGIONAL = """regional AS (
  SELECT l.year, m.county, l.city, sum(l.line_revenue) AS revenue
  FROM recent l JOIN city_map m ON l.city = m.city
  WHERE l.city IS NOT NULL AND m.county IS NOT NULL AND l.year IS NOT NULL
  GROUP BY l.year, m.county, l.city)"""

ITEMS = f"""items AS (
  SELECT item_id, item_name, coalesce(sum(quantity), 0) AS quantity,
         arg_min(stock_quantity, line_no) AS stock_quantity,
         coalesce(sum(quantity), 0) / 365.0 AS daily_avg
  FROM lines WHERE order_date >= {AS_OF} - INTERVAL 365 DAY
    AND item_id IS NOT NULL AND item_name IS NOT NULL
  GROUP BY item_id, item_name),
sorted_avg AS (SELECT daily_avg AS v, row_number() OVER (ORDER BY daily_avg) - 1 AS i
  FROM items WHERE daily_avg IS NOT NULL),
qpos AS (SELECT name, vi, least(greatest(floor(vi), 0), n - 1) AS prev,
    least(least(greatest(floor(vi), 0), n - 1) + 1, n - 1) AS nxt, vi - floor(vi) AS t
  FROM (SELECT name, CAST(n - 1 AS DOUBLE) * q AS vi, n
        FROM (SELECT count(*) AS n FROM sorted_avg),
             (VALUES ('q_high', CAST(0.8 AS DOUBLE)), ('q_low', CAST(0.2 AS DOUBLE))) AS qs(name, q))),
qval AS (SELECT p.name, p.t, lo.v AS lo, hi.v AS hi FROM qpos p
  JOIN sorted_avg lo ON lo.i = p.prev JOIN sorted_avg hi ON hi.i = p.nxt),
thresholds AS (
  SELECT max(CASE WHEN name = 'q_high' THEN q END) AS q_high, max(CASE WHEN name = 'q_low' THEN q END) AS q_low
  FROM (SELECT name, CASE WHEN t >= 0.5 THEN hi - (hi - lo) * (1.0 - t) ELSE lo + (hi - lo) * t END AS q
        FROM qval)),
flags AS (
  SELECT i.*, coalesce(i.daily_avg > t.q_high AND i.stock_quantity < i.daily_avg * 7, false) AS low_stock,
         coalesce(i.daily_avg <= t.q_low AND i.stock_quantity > i.daily_avg * 90, false) AS excess_stock
  FROM items i CROSS JOIN thresholds t)"""

EVENT_LINES = """ev_lines AS (
  SELECT event_id AS order_number, ts AS order_date, CAST(year(ts) AS INTEGER) AS year,
         CAST(value AS DECIMAL(18,2)) AS line_revenue, event_type AS origin
  FROM events)"""

SHARES = """shares AS (
  SELECT origin, count(*) AS n,
         CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100.0 AS share
  FROM ev_lines WHERE year >= 2024 AND origin IS NOT NULL GROUP BY origin)"""


def _days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS BIGINT)"


FEATURES_BASE = """SELECT email, CAST(coalesce(sum(customer_total_orders), 0) AS BIGINT) AS total_orders,
         CAST(coalesce(sum({spent}), 0) AS DOUBLE) AS total_spent,
         min(customer_first_order) AS first_order, max(customer_last_order) AS last_order
  FROM lines WHERE email IS NOT NULL GROUP BY email"""

FEATURES_ACTIVE = f"""feat AS (
  SELECT *, {_days(AS_OF, 'last_order')} AS recency_days, total_orders / 365.0 AS order_frequency
  FROM ({FEATURES_BASE.format(spent='line_revenue')})
  WHERE last_order >= {AS_OF} - INTERVAL 365 DAY)"""

FEATURES_ALL = f"""feat AS (
  SELECT *, {_days(AS_OF, 'last_order')} AS recency_days, total_orders / 365.0 AS order_frequency,
         {_days('last_order', 'first_order')} AS lifetime_days
  FROM ({FEATURES_BASE.format(spent='customer_total_spent')}))"""

SEGMENT_CASE = """CASE WHEN total_orders > 5 AND total_spent > 50000
              THEN 'Hűséges vásárlók (gyakran visszatérnek és magas költéssel)'
            WHEN total_spent > 100000 THEN 'Magas értékű vásárlók (VIP szegmens)'
            WHEN total_orders = 1 THEN 'Új vásárlók (első vásárlás)'
            WHEN recency_days > 180 THEN 'Inaktív vásárlók (hosszabb ideje nem vásároltak)'
            ELSE 'Alkalmi vásárlók (ritkán vásárlók)' END"""

CUSTOMERS = f"""cust AS (
  SELECT c.c_custkey AS customer_id, c.c_name || '@example.com' AS email,
         n.n_name AS city,
         ({FIRST})[c.c_custkey % 10 + 1] AS first_name,
         ({LAST})[c.c_custkey % 10 + 1] AS last_name
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""


def _values(vals: list) -> str:
    return "(VALUES " + ", ".join(f"({_sql_str(v)})" for v in vals) + ")"


NAMES = f"""names AS (
  SELECT name, bool_or(is_male) AS is_male, bool_or(is_female) AS is_female FROM (
    SELECT {_norm(f'lower({_strip("v")})')} AS name, true AS is_male, false AS is_female
    FROM {_values(tables.MALE_NAMES)} AS m(v)
    UNION ALL
    SELECT {_norm(f'lower({_strip("v")})')} AS name, false AS is_male, true AS is_female
    FROM {_values(tables.FEMALE_NAMES)} AS f(v))
  WHERE name IS NOT NULL AND name <> '' GROUP BY name)"""


def _gender_select(src: str, cols: str) -> str:
    fn = _norm(_strip("s.first_name"))
    ln = _norm(_strip("s.last_name"))
    return f"""SELECT {cols},
    CASE WHEN n1.is_male THEN 'Férfi' WHEN n1.is_female THEN 'Nő'
         WHEN n2.is_male THEN 'Férfi' WHEN n2.is_female THEN 'Nő'
         WHEN contains(s.fn, 'ne') OR contains(s.ln, 'ne') THEN 'Nő'
         ELSE 'Ismeretlen' END AS gender
  FROM (SELECT *, {fn} AS fn, {ln} AS ln FROM {src} s) s
  LEFT JOIN names n1 ON s.fn = n1.name
  LEFT JOIN names n2 ON s.ln = n2.name"""


def _mask(x: str) -> str:
    return f"substr(sha256({x}), 1, 10) || '@masked.com'"


def _complete(features: str) -> str:
    """Every feature of a customer is known."""
    return " AND ".join(f"{c} IS NOT NULL" for c in getattr(segments, features))


def _kmeans(features: str, feat: str = "feat", x: str = "") -> tuple[str, ...]:
    """CTEs of the reproducible k-means over ``feat``: best (centres, inertia), assigned (cluster per complete row).

    The recursion carries each start's centres as one list; a step averages the whole-number points of each centre.
    ``x`` is put behind the names, so that two of them fit into one statement.
    """
    p, cols = tables.test_params(), getattr(segments, features)
    unit = float(kmeans.UNIT)
    z = ", ".join(f"CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) OVER () > 0 THEN round((CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) "
                  f"/ stddev_pop(CAST({c} AS DOUBLE)) OVER () * {unit}) ELSE 0.0 END" for c in cols)
    varying = " + ".join(f"(CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) > 0 THEN 1 ELSE 0 END)" for c in cols)

    def far(a: str, b: str) -> str:
        return "(" + " + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in range(1, len(cols) + 1)) + ")"

    def u(step: int) -> str:
        return f"((CAST('0x' || substr(md5('{p.seed}:' || s || ':{step}:' || email), 1, 13) AS BIGINT) + 1)::DOUBLE / 4503599627370496::DOUBLE)"

    to = f"list_transform(c, lambda q: {far('z', 'q')})"
    draws = [f"c0{x} AS (SELECT s, [arg_min(z, {u(0)})] AS c FROM pts{x}, (SELECT unnest(range(0, {p.starts})) AS s) GROUP BY s)"]
    for step in range(1, p.k):
        draws.append(f"""c{step}{x} AS (SELECT s, list_append(c, coalesce(arg_min(z, w), c[1])) AS c FROM (
  SELECT s, c, z, CASE WHEN d > 0 THEN -ln({u(step)}) / d END AS w FROM (SELECT *, list_min({to}) AS d FROM pts{x}, c{step - 1}{x})) GROUP BY s, c)""")
    means = ", ".join(f"sum(z[{i}]) / count(*)" for i in range(1, len(cols) + 1))
    return (f"pts{x} AS (SELECT *, [{z}]::DOUBLE[] AS z FROM {feat} WHERE {_complete(features)})",
            f"tol{x} AS (SELECT {p.tol}::DOUBLE * ({varying}) / {len(cols)} * {unit}::DOUBLE * {unit}::DOUBLE AS tol FROM pts{x})", *draws,
            f"""km{x}(s, i, c, shift) AS (SELECT s, 0, c, CAST('inf' AS DOUBLE) FROM c{p.k - 1}{x} UNION ALL
  SELECT s, i + 1, n, list_sum(list_transform(range(1, {p.k + 1}), lambda j: {far('c[j]', 'n[j]')})) FROM (
    SELECT s, i, c, list_transform(range(1, {p.k + 1}), lambda j: coalesce(m[j], c[j])) AS n FROM (
      SELECT s, i, c, map_from_entries(list((near, mean))) AS m FROM (
        SELECT s, i, c, near, [{means}] AS mean FROM (
          SELECT s, i, c, z, list_position({to}, list_min({to})) AS near FROM pts{x}, (SELECT s, i, c FROM km{x}, tol{x} WHERE shift > tol AND i < {p.max_iter})) GROUP BY s, i, c, near)
      GROUP BY s, i, c)))""",
            f"last{x} AS (SELECT s, arg_max(c, i) AS c FROM km{x} GROUP BY s)",
            f"""best{x} AS (SELECT s, list_sort(c) AS c, inertia FROM (
  SELECT s, c, sum(CAST(floor(list_min({to})) AS HUGEINT)) AS inertia FROM pts{x}, last{x} GROUP BY s, c) ORDER BY inertia, s LIMIT 1)""",
            f"assigned{x} AS (SELECT pts{x}.* EXCLUDE (z), CAST(list_position({to}, list_min({to})) - 1 AS INTEGER) AS cluster FROM pts{x}, best{x})")


def _summary(features: str) -> str:
    cols = getattr(segments, features)
    return (_with(*L, FEATURES_ACTIVE if features == "ACTIVE_FEATURES" else FEATURES_ALL, *_kmeans(features)).replace("WITH ", "WITH RECURSIVE ", 1)
            + "SELECT cluster, " + ", ".join(f"round_even({c}, 4) AS {c}" for c in cols) + f", customers, {SEGMENT_CASE} AS segment FROM (SELECT cluster, "
            + ", ".join(f"avg({c}) AS {c}" for c in cols) + ", count(email) AS customers FROM assigned GROUP BY cluster)")


MATRIX_YEARS = range(1995, 2002)      # years of the completed orders of the test tables


def _matrix(source: str, value: str) -> str:
    """Month x year matrix with literal years, so the statement can be a view."""
    cells = ", ".join(f'max(CASE WHEN year = {y} THEN {value} END) AS "{y}"' for y in MATRIX_YEARS)
    return f"SELECT month, {cells} FROM {source} GROUP BY month"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


L = (CUST_TOTALS, RAW_LINES, LINES)

ORACLES: dict[str, str] = {
    "order_lines_clean": _with(*L) + """SELECT order_number, order_date, order_status, city, email,
    CAST(line_total AS DOUBLE) AS line_total, CAST(refund_amount AS DOUBLE) AS refund_amount,
    CAST(discount_amount AS DOUBLE) AS discount_amount,
    CAST(customer_total_spent AS DOUBLE) AS customer_total_spent, customer_total_orders,
    customer_first_order, customer_last_order, item_id, item_name, quantity, stock_quantity,
    category_path, gender, origin, year, month, CAST(line_revenue AS DOUBLE) AS line_revenue
  FROM lines""",

    "order_totals": _with(*L, ORDERS) + """SELECT order_number, order_date, year, month,
    CAST(line_revenue AS DOUBLE) AS line_revenue, CAST(refund_amount AS DOUBLE) AS refund_amount,
    CAST(net_revenue AS DOUBLE) AS net_revenue FROM order_totals""",

    "monthly_revenue": _with(*L, ORDERS, MONTHLY)
    + "SELECT year, month, CAST(net_revenue AS DOUBLE) AS net_revenue FROM monthly",

    "revenue_matrix": _with(*L, ORDERS, MONTHLY, "m2 AS (SELECT year, month, CAST(net_revenue AS DOUBLE) AS v FROM monthly)")
    + _matrix("m2", "v"),

    "revenue_matrix_text": _with(*L, ORDERS, MONTHLY, """grid AS (
  SELECT m.month, y.year, coalesce(format('{:,.2f}', CAST(v.net_revenue AS DOUBLE)), '') AS txt
  FROM (SELECT DISTINCT month FROM monthly) m CROSS JOIN (SELECT DISTINCT year FROM monthly) y
  LEFT JOIN monthly v ON v.month = m.month AND v.year = y.year)""")
    + _matrix("grid", "txt"),

    "yearly_totals": _with(*L, ORDERS, MONTHLY)
    + "SELECT year, CAST(sum(net_revenue) AS DOUBLE) AS net_revenue FROM monthly GROUP BY year",

    "revenue_formatted": _with(*L, ORDERS, MONTHLY)
    + "SELECT year, month, format('{:,.2f}', CAST(net_revenue AS DOUBLE)) AS net_revenue FROM monthly",

    "average_order_value": _with(*L, ORDERS) + """SELECT year, month,
    CAST(sum(net_revenue) AS DOUBLE) / count(*) AS avg_order_value
  FROM order_totals WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month""",

    "aov_matrix": _with(*L, ORDERS, """aov AS (SELECT year, month,
    CAST(sum(net_revenue) AS DOUBLE) / count(*) AS v
  FROM order_totals WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month)""")
    + _matrix("aov", "v"),

    "aov_matrix_text": _with(*L, ORDERS, """aov AS (SELECT year, month,
    CAST(sum(net_revenue) AS DOUBLE) / count(*) AS v
  FROM order_totals WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month)""", """grid AS (
  SELECT m.month, y.year, coalesce(format('{:,.2f}', a.v) || ' Ft', '') AS txt
  FROM (SELECT DISTINCT month FROM aov) m CROSS JOIN (SELECT DISTINCT year FROM aov) y
  LEFT JOIN aov a ON a.month = m.month AND a.year = y.year)""")
    + _matrix("grid", "txt"),

    "category_revenue": _with(*L, RECENT) + f"""SELECT year, last_category, CAST(sum(line_revenue) AS DOUBLE) AS revenue
  FROM (SELECT year, {_strip("string_split(category_path, '>')[-1]")} AS last_category, line_revenue FROM recent)
  WHERE last_category IS NOT NULL AND year IS NOT NULL GROUP BY year, last_category""",

    "category_shares": _with(*L, RECENT, f"""cat AS (
  SELECT year, last_category, sum(line_revenue) AS revenue
  FROM (SELECT year, {_strip("string_split(category_path, '>')[-1]")} AS last_category, line_revenue FROM recent)
  WHERE last_category IS NOT NULL AND year IS NOT NULL GROUP BY year, last_category)""",
        "tot AS (SELECT year, sum(revenue) AS total FROM cat GROUP BY year)",
        """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY revenue DESC, last_category) AS rank
  FROM cat) WHERE rank <= 8)""",
        """rest AS (SELECT t.year, 'Minden más' AS last_category, t.total - coalesce(s.top_sum, 0) AS revenue,
    coalesce(s.max_rank, 0) + 1 AS rank
  FROM tot t LEFT JOIN (SELECT year, sum(revenue) AS top_sum, max(rank) AS max_rank FROM top GROUP BY year) s
  ON t.year = s.year)""",
        """allrows AS (SELECT year, rank, last_category, revenue FROM top
  UNION ALL SELECT year, rank, last_category, revenue FROM rest)""")
    + """SELECT a.year, CAST(a.rank AS INTEGER) AS rank, a.last_category,
    CAST(round_even(a.revenue, 0) AS BIGINT) AS revenue,
    round_even(CAST(a.revenue AS DOUBLE) / CAST(t.total AS DOUBLE) * 100.0, 1) AS percentage
  FROM allrows a JOIN tot t ON a.year = t.year""",

    "top_products": _with(*L, RECENT_ORDERS, """prod AS (
  SELECT year, item_id, CAST(round_even(sum(line_revenue), 0) AS BIGINT) AS revenue,
         arg_min(item_name, line_no) AS item_name
  FROM recent WHERE item_id IS NOT NULL AND year IS NOT NULL GROUP BY year, item_id)""")
    + """SELECT year, CAST(rank AS INTEGER) AS rank, item_id, item_name, revenue FROM (
    SELECT *, row_number() OVER (PARTITION BY year ORDER BY revenue DESC, item_id) AS rank FROM prod)
  WHERE rank <= 8""",

    "regional_revenue": _with(*L, RECENT_ORDERS, CITY_MAP, REGIONAL)
    + "SELECT year, county, city, CAST(revenue AS DOUBLE) AS revenue FROM regional",

    "top_counties": _with(*L, RECENT_ORDERS, CITY_MAP, REGIONAL)
    + """SELECT year, CAST(rank AS INTEGER) AS rank, county, CAST(revenue AS DOUBLE) AS revenue FROM (
    SELECT *, row_number() OVER (PARTITION BY year ORDER BY revenue DESC, county) AS rank FROM (
      SELECT year, county, sum(revenue) AS revenue FROM regional GROUP BY year, county))
  WHERE rank <= 4""",

    "top_cities": _with(*L, RECENT_ORDERS, CITY_MAP, REGIONAL)
    + """SELECT year, CAST(rank AS INTEGER) AS rank, city, CAST(revenue AS DOUBLE) AS revenue FROM (
    SELECT *, row_number() OVER (PARTITION BY year ORDER BY revenue DESC, city) AS rank FROM (
      SELECT year, city, sum(revenue) AS revenue FROM regional GROUP BY year, city))
  WHERE rank <= 4""",

    "county_totals": _with(*L, RECENT_ORDERS, CITY_MAP, REGIONAL)
    + "SELECT county, CAST(sum(revenue) AS DOUBLE) AS revenue FROM regional GROUP BY county",

    "item_sales": _with(*L, ITEMS) + "SELECT item_id, item_name, quantity, stock_quantity, daily_avg FROM items",

    "stock_thresholds": _with(*L, ITEMS) + "SELECT q_high, q_low FROM thresholds",

    "low_stock": _with(*L, ITEMS)
    + "SELECT item_id, item_name, quantity, daily_avg, stock_quantity FROM flags WHERE low_stock",

    "excess_stock": _with(*L, ITEMS)
    + "SELECT item_id, item_name, quantity, daily_avg, stock_quantity FROM flags WHERE excess_stock",

    "low_stock_head": _with(*L, ITEMS) + """SELECT item_id, item_name, quantity, daily_avg, stock_quantity,
    CAST(rank AS INTEGER) AS rank, CAST(greatest(total - 10, 0) AS BIGINT) AS more FROM (
    SELECT *, row_number() OVER (ORDER BY daily_avg DESC, item_id, item_name) AS rank,
           count(*) OVER () AS total
    FROM flags WHERE low_stock)
  WHERE rank <= 10""",

    "excess_stock_head": _with(*L, ITEMS) + """SELECT item_id, item_name, quantity, daily_avg, stock_quantity,
    CAST(rank AS INTEGER) AS rank, CAST(greatest(total - 10, 0) AS BIGINT) AS more FROM (
    SELECT *, row_number() OVER (ORDER BY daily_avg, item_id, item_name) AS rank,
           count(*) OVER () AS total
    FROM flags WHERE excess_stock)
  WHERE rank <= 10""",

    "stock_risk_counts": _with(*L, ITEMS)
    + "SELECT CAST(count_if(low_stock) AS BIGINT) AS low_stock_items, "
    "CAST(count_if(excess_stock) AS BIGINT) AS excess_stock_items FROM flags",

    "discount_summary": _with(*L) + """SELECT year, CAST(sum(discount_amount) AS DOUBLE) AS discount_total,
    count(DISTINCT order_number) AS discounted_orders
  FROM lines WHERE discount_amount > 0 AND year IS NOT NULL GROUP BY year""",

    "weekday_revenue": _with(*L, RECENT) + """SELECT year, CAST(isodow(order_date) AS INTEGER) AS weekday_no,
    dayname(order_date) AS weekday, CAST(sum(line_revenue) AS DOUBLE) AS revenue
  FROM recent WHERE order_date IS NOT NULL GROUP BY year, weekday_no, weekday""",

    "hourly_revenue": _with(EVENT_LINES, """recent AS (SELECT * FROM ev_lines WHERE year IN (
    SELECT DISTINCT year FROM ev_lines WHERE year IS NOT NULL ORDER BY year DESC LIMIT 2))""")
    + """SELECT year, CAST(hour(order_date) AS INTEGER) AS hour, CAST(sum(line_revenue) AS DOUBLE) AS revenue
  FROM recent WHERE order_date IS NOT NULL GROUP BY year, hour""",

    "gender_share": _with(*L) + """SELECT gender, count(*) AS n,
    CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100.0 AS share
  FROM lines WHERE gender IS NOT NULL GROUP BY gender""",

    "gender_summary": _with(*L) + """SELECT gender, count(DISTINCT order_number) AS orders,
    CAST(coalesce(sum(line_revenue), 0) AS DOUBLE) AS revenue
  FROM lines WHERE gender IS NOT NULL GROUP BY gender""",

    "origin_share": _with(EVENT_LINES, SHARES) + "SELECT origin, n, share FROM shares",

    "origin_folded": _with(EVENT_LINES, SHARES) + """SELECT origin, n, share FROM shares
  WHERE share >= 20.0 AND NOT (origin = 'Egyéb' AND EXISTS (SELECT 1 FROM shares WHERE share < 20.0))
  UNION ALL
  SELECT 'Egyéb' AS origin, CAST(sum(n) AS BIGINT) AS n,
         CAST(sum(n) AS DOUBLE) / CAST((SELECT sum(n) FROM shares) AS DOUBLE) * 100.0 AS share
  FROM shares WHERE share < 20.0 HAVING count(*) > 0""",

    "customer_features_active": _with(*L, FEATURES_ACTIVE) + "SELECT * FROM feat",

    "customer_features_all": _with(*L, FEATURES_ALL) + "SELECT * FROM feat",

    "scaled_features": _with(*L, FEATURES_ACTIVE) + "SELECT email, " + ", ".join(
        f"round(CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) OVER () > 0 THEN "
        f"(CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / stddev_pop(CAST({c} AS DOUBLE)) OVER () "
        f"ELSE 0.0 END, 6) AS {c}_z"
        for c in ("total_orders", "total_spent", "recency_days", "order_frequency")) + " FROM feat",

    "segment_rule": _with(*L, """per_order AS (
  SELECT email, order_number, sum(line_revenue) AS revenue, max(order_date) AS last_date
  FROM lines WHERE email IS NOT NULL GROUP BY email, order_number)""", f"""per_cust AS (
  SELECT email, count(order_number) AS total_orders, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS total_spent,
         max(last_date) AS last_order FROM per_order GROUP BY email),
rec AS (SELECT *, {_days(AS_OF, 'last_order')} AS recency_days FROM per_cust)""")
    + f"SELECT email, total_orders, total_spent, last_order, recency_days, {SEGMENT_CASE} AS segment FROM rec",

    "segment_rule_summary": _with(*L, """per_order AS (
  SELECT email, order_number, max(order_date) AS last_date, sum(line_revenue) AS revenue
  FROM lines WHERE email IS NOT NULL GROUP BY email, order_number)""", f"""per_cust AS (
  SELECT email, count(order_number) AS total_orders, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS total_spent,
         max(last_date) AS last_order FROM per_order GROUP BY email),
rec AS (SELECT *, {_days(AS_OF, 'last_order')} AS recency_days FROM per_cust),
named AS (SELECT *, {SEGMENT_CASE} AS segment FROM rec)""")
    + """SELECT segment, round_even(avg(total_orders), 4) AS total_orders, round_even(avg(recency_days), 4) AS recency_days,
    count(*) AS customers FROM named GROUP BY segment""",

    "segment_summary_active": _summary("ACTIVE_FEATURES"),

    "segment_summary_all": _summary("ALL_FEATURES"),

    "segment_assignments": _with(*L, FEATURES_ACTIVE, *_kmeans("ACTIVE_FEATURES")).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT email, total_spent, order_frequency, cluster FROM assigned",

    "segment_check": _with(*L, FEATURES_ACTIVE.replace("feat AS", "feat_active AS", 1), FEATURES_ALL.replace("feat AS", "feat_all AS", 1),
                           *_kmeans("ACTIVE_FEATURES", "feat_active", "_a"), *_kmeans("ALL_FEATURES", "feat_all", "_b"), """both_sets AS (
  SELECT 'active' AS variant, (SELECT inertia FROM best_a) AS inertia, """ + _complete("ACTIVE_FEATURES") + """ AS complete FROM feat_active
  UNION ALL SELECT 'all' AS variant, (SELECT inertia FROM best_b) AS inertia, """ + _complete("ALL_FEATURES") + """ AS complete FROM feat_all)""").replace("WITH ", "WITH RECURSIVE ", 1)
    + """SELECT variant, count(*) AS customers, count(*) FILTER (NOT complete) AS left_out,
    CAST(least(4, count(*) FILTER (complete)) AS INTEGER) AS k, count(*) FILTER (complete) AS clustered,
    CAST(any_value(inertia) AS DOUBLE) AS inertia FROM both_sets GROUP BY variant""",

    "bundle_top_categories": _with(*L, RECENT, f"""cat AS (
  SELECT year, last_category, sum(line_revenue) AS revenue
  FROM (SELECT year, {_strip("string_split(category_path, '>')[-1]")} AS last_category, line_revenue FROM recent)
  WHERE last_category IS NOT NULL AND year IS NOT NULL GROUP BY year, last_category)""",
        "top AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY revenue DESC, last_category) AS rank FROM cat)")
    + "SELECT year, CAST(rank AS INTEGER) AS rank, last_category, CAST(revenue AS DOUBLE) AS revenue FROM top WHERE rank <= 8",

    "masked_emails": _with(CUSTOMERS) + f"SELECT customer_id, email, {_mask('email')} AS masked_email FROM cust",

    "normalised_names": _with(CUSTOMERS) + f"""SELECT customer_id, first_name, last_name,
    {_norm(_strip('first_name'))} AS first_name_norm, {_norm(_strip('last_name'))} AS last_name_norm FROM cust""",

    "normalised_words": f"""SELECT word, {_norm('word')} AS word_norm FROM (
  SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+')) AS word FROM documents) WHERE word <> ''""",

    "inferred_gender": _with(CUSTOMERS, NAMES) + _gender_select("cust", "s.customer_id, s.first_name, s.last_name"),

    "anonymised_customers": _with(CUSTOMERS, NAMES, "g AS (" + _gender_select(
        "cust", "s.customer_id, s.email, s.city") + ")")
    + f"SELECT customer_id, {_mask('email')} AS email, city, gender FROM g",

    "anonymised_lines": _with(CUST_TOTALS, RAW_LINES, NAMES, "g AS (" + _gender_select(
        "raw_lines", "s.order_number, s.line_no, s.order_date, s.order_status, s.city, s.email, "
        "s.line_total, s.refund_amount, s.discount_amount, s.item_id, s.item_name, s.quantity, "
        "s.category_path, s.origin") + ")")
    + f"""SELECT order_number, line_no, order_date, order_status, city, {_mask('email')} AS email,
    CAST(line_total AS DOUBLE) AS line_total, CAST(refund_amount AS DOUBLE) AS refund_amount,
    CAST(discount_amount AS DOUBLE) AS discount_amount, item_id, item_name, quantity, category_path,
    gender, origin FROM g""",
}

# The bundle's product table is the product report without the item id.
ORACLES["bundle_top_products"] = f"SELECT year, rank, item_name, revenue FROM ({ORACLES['top_products']})"

# The slices of the one-scan frame equal the queries that read the lines for themselves.
ORACLES |= {
    "grain_orders": _with(*L, ORDERS) + """SELECT year, month, CAST(coalesce(sum(net_revenue), 0) AS DOUBLE) AS net_revenue, count(net_revenue) AS orders,
    CAST(sum(net_revenue) AS DOUBLE) / count(net_revenue) AS avg_order_value
  FROM order_totals WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month""",
    "grain_categories": ORACLES["category_revenue"], "grain_top_products": ORACLES["top_products"], "grain_item_sales": ORACLES["item_sales"],
    "grain_regions": ORACLES["regional_revenue"], "grain_customers": ORACLES["customer_features_all"]}

ORACLES["item_sales_by_clock"] = _with(*L) + " UNION ALL ".join(f"""SELECT '{day}' AS as_of, item_id, item_name, coalesce(sum(quantity), 0) AS quantity, arg_min(stock_quantity, line_no) AS stock_quantity,
    coalesce(sum(quantity), 0) / 365.0 AS daily_avg
  FROM lines WHERE order_date >= TIMESTAMP '{day} 00:00:00' - INTERVAL 365 DAY AND item_id IS NOT NULL AND item_name IS NOT NULL GROUP BY item_id, item_name
""" for day in ("2001-08-01", "1999-03-15", "1996-01-01"))

ORACLES["text_dates"] = "SELECT o_orderkey AS order_number, o_orderdate AS order_date, CAST(o_orderdate AS TIMESTAMP) AS day_first FROM orders"

ORACLES["yearly_totals_text"] = f"SELECT year, format('{{:,.2f}}', CAST(net_revenue AS DOUBLE)) AS net_revenue FROM ({ORACLES['yearly_totals']})"

ORACLES |= {f"{key}_share_text": f"SELECT CAST(row_number() OVER (ORDER BY n DESC, {key}) AS INTEGER) AS rank, {key}, printf('%.2f%%', share) AS share FROM ({ORACLES[f'{key}_share']})"
            for key in ("gender", "origin")}

# the exact rows; a sketched count must lie within its stated error
ORACLES |= {f"{name}_sketch": f"SELECT *, true AS within FROM ({ORACLES[name]})" for name in ("discount_summary", "gender_summary")}

EXPORTS = """exports AS (
  SELECT CASE coalesce(o_orderstatus, '') WHEN 'O' THEN 'open' WHEN 'F' THEN 'finished' ELSE 'rest' END AS export, o_orderkey AS order_number,
         CAST(o_orderdate AS TIMESTAMP) AS order_date, o_orderstatus AS order_status, CAST(o_totalprice AS DECIMAL(18,2)) AS line_total,
         CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS origin
  FROM orders)"""

ORACLES["reconciled_exports"] = f"WITH {EXPORTS} SELECT export, order_number, order_date, order_status, CAST(line_total AS DOUBLE) AS line_total, origin FROM exports"

# whole numbers of at most 15 digits read as every number; the typed exports' prices are wider than a double holds
ORACLES["export_votes"] = f"""WITH {EXPORTS}
  SELECT export, 'order_number' AS "column", count(order_number) AS n, count(order_number) AS n_long, count(order_number) AS n_number, count(order_number) AS n_double, 0 AS n_time
  FROM exports GROUP BY export
  UNION ALL SELECT export, 'order_date', count(order_date), 0, 0, 0, count(order_date) FROM exports GROUP BY export
  UNION ALL SELECT export, 'order_status', count(nullif(order_status, '')), 0, 0, 0, 0 FROM exports GROUP BY export
  UNION ALL SELECT export, 'line_total', count(line_total), 0, count(line_total), CASE WHEN export = 'open' THEN count(line_total) ELSE 0 END, 0 FROM exports GROUP BY export
  UNION ALL SELECT 'open', 'origin', count(origin), 0, 0, 0, 0 FROM exports"""

ORACLES["split_customer_names"] = ORACLES["inferred_gender"]
