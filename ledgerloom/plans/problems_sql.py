"""DuckDB SQL for the queries of problems 1 to 6, written independently of their operators."""

from __future__ import annotations


def _p1_part(name: str, keys: list[str], fields: dict[str, int]) -> str:
    k = ", ".join(keys)
    rounded = ", ".join(f"CAST({f} AS DECIMAL(38,{s})) AS {f}" for f, s in fields.items())
    sides = f"SELECT 'l' AS side, {k}, {rounded} FROM {name} UNION ALL SELECT 'r' AS side, {k}, {rounded} FROM {name}_wh"
    listed = ", ".join(f"list_sort(list(coalesce(CAST({f} AS VARCHAR), '?')) FILTER (side = '{s}')) AS {s}_{f}, list_sort(list(DISTINCT coalesce(CAST({f} AS VARCHAR), '?')) FILTER (side = '{s}')) AS {s}d_{f}" for f in fields for s in "lr")
    user = "user_id" if "user_id" in keys else "0"
    head = f"SELECT '{name}' AS table_name, CAST({user} AS BIGINT) AS user_id, strftime(dt, '%Y-%m-%d') AS dt, "
    per = f"{name}_g AS (SELECT {k}, count(*) FILTER (side = 'l') AS nl, count(*) FILTER (side = 'r') AS nr, {listed} FROM ({sides}) GROUP BY {k})"
    rows = [f"{head} CASE WHEN nr = 0 THEN 'only_in_lake' WHEN nl = 0 THEN 'only_in_wh' ELSE 'row_count' END AS diff FROM {name}_g WHERE nl <> nr"]
    rows += [f"{head} '{f}' AS diff FROM {name}_g WHERE nl > 0 AND nr > 0 AND CASE WHEN nl = nr THEN l_{f} <> r_{f} ELSE ld_{f} <> rd_{f} END" for f in fields]
    return per, " UNION ALL ".join(rows)


def p1_found() -> str:
    money = {"order_cnt": 0, "paid_cnt": 0, "paid_amount": 2, "refund_amount": 2}
    a, ra = _p1_part("dws_user_order_day", ["user_id", "dt"], money)
    b, rb = _p1_part("ads_daily_sales", ["dt"], money | {"net_amount": 2, "avg_order_amount": 2, "pay_rate": 4})
    return f"WITH {a}, {b} {ra} UNION ALL {rb}"


_SHARES = """
  SELECT dt, 'user_id' AS column_name, 'null_rate' AS metric, count(*) FILTER (user_id IS NULL) / count(*) AS value FROM ods_order GROUP BY dt
  UNION ALL SELECT dt, 'user_id', 'invalid_rate', count(*) FILTER (user_id NOT BETWEEN 1 AND 99999999) / nullif(count(user_id), 0) FROM ods_order GROUP BY dt
  UNION ALL SELECT dt, 'user_id', 'distinct_rate', count(DISTINCT user_id) / nullif(count(user_id), 0) FROM ods_order GROUP BY dt
  UNION ALL SELECT dt, 'user_id', 'top_share', max(n) / sum(n) FROM (SELECT dt, user_id, count(*) AS n FROM ods_order WHERE user_id IS NOT NULL GROUP BY dt, user_id) GROUP BY dt
  UNION ALL SELECT dt, 'amount', 'null_rate', count(*) FILTER (amount IS NULL) / count(*) FROM ods_order GROUP BY dt
  UNION ALL SELECT dt, 'amount', 'negative_rate', count(*) FILTER (amount < 0) / nullif(count(amount), 0) FROM ods_order GROUP BY dt
  UNION ALL SELECT dt, 'amount', 'over_rate', count(*) FILTER (abs(amount) >= 100000) / nullif(count(amount), 0) FROM ods_order GROUP BY dt
  UNION ALL SELECT dt, 'amount', 'share_200_up', count(*) FILTER (abs(amount) >= 200) / nullif(count(amount), 0) FROM ods_order GROUP BY dt
  UNION ALL SELECT dt, 'status', 'null_rate', count(*) FILTER (status IS NULL) / count(*) FROM ods_order GROUP BY dt
  UNION ALL SELECT dt, 'status', 'invalid_rate', count(*) FILTER (status NOT IN ('paid', 'refund', 'cancel')) / nullif(count(status), 0) FROM ods_order GROUP BY dt
  UNION ALL SELECT dt, 'status', 'refund_share', count(*) FILTER (status = 'refund') / nullif(count(status), 0) FROM ods_order GROUP BY dt
  UNION ALL SELECT dt, 'status', 'cancel_share', count(*) FILTER (status = 'cancel') / nullif(count(status), 0) FROM ods_order GROUP BY dt
"""

P2_FOUND = f"""
SELECT strftime(dt, '%Y-%m-%d') AS dt, column_name, metric FROM ({_SHARES}) JOIN ods_order_baseline USING (column_name, metric) WHERE value < low_bound OR value > high_bound
"""


def _p2_more(column: str, number: bool) -> str:
    top = f"SELECT dt, '{column}' AS column_name, 'top_share' AS metric, max(n) / sum(n) AS value FROM (SELECT dt, {column} AS v, count(*) AS n FROM ods_order WHERE {column} IS NOT NULL GROUP BY dt, v) GROUP BY dt"
    parts = [
        f"SELECT dt, '{column}' AS column_name, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM ods_order GROUP BY dt",
        f"SELECT dt, '{column}', 'distinct', count(DISTINCT {column}) FROM ods_order GROUP BY dt",
        f"""SELECT dt, '{column}', 'ks', max(abs(now - past)) FROM (
            SELECT g.dt, v, sum(sum(a)) OVER w / max(na) AS now, sum(sum(b)) OVER w / max(nb) AS past FROM (
              SELECT dt, {column} AS v, 1 AS a, 0 AS b FROM ods_order WHERE {column} IS NOT NULL
              UNION ALL SELECT nx, {column}, 0, 1 FROM ods_order JOIN loads USING (dt) WHERE {column} IS NOT NULL AND nx IS NOT NULL) AS g
            JOIN (SELECT l.dt, (SELECT count({column}) FROM ods_order o WHERE o.dt = l.dt) AS na, (SELECT count({column}) FROM ods_order o JOIN loads p ON p.dt = o.dt WHERE p.nx = l.dt) AS nb FROM loads l) AS t ON t.dt = g.dt
            WHERE na > 0 AND nb > 0 GROUP BY g.dt, v WINDOW w AS (PARTITION BY g.dt ORDER BY v)) GROUP BY dt""",
    ]
    if column != "user_id":
        parts += [f"SELECT dt, '{column}', 'distinct_rate', count(DISTINCT {column}) / nullif(count({column}), 0) FROM ods_order GROUP BY dt", top]
    if number:
        parts += [f"SELECT dt, '{column}', '{m}', CAST({m}({column}) AS DOUBLE) FROM ods_order GROUP BY dt" for m in ("min", "max")]
        parts += [f"SELECT dt, '{column}', 'q{q}', CAST(quantile_disc({column}, {q}) AS DOUBLE) FROM ods_order GROUP BY dt" for q in ("0.25", "0.5", "0.75")]
    return " UNION ALL ".join(parts)


P2_PROFILE = f"""
WITH loads AS (SELECT dt, lead(dt) OVER (ORDER BY dt) AS nx FROM (SELECT DISTINCT dt FROM ods_order))
SELECT strftime(dt, '%Y-%m-%d') AS dt, column_name, metric, round(value, 9) AS value FROM ({_SHARES} UNION ALL {_p2_more('user_id', True)} UNION ALL {_p2_more('amount', True)} UNION ALL {_p2_more('status', False)})
WHERE value IS NOT NULL
"""

_LATEST = """
latest AS (
  SELECT product_id, snapshot_date, product_name, category, brand, price, status FROM ods_product WHERE snapshot_date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY product_id, snapshot_date ORDER BY update_time DESC NULLS LAST) = 1),
marked AS (
  SELECT *, row(product_name, category, brand, price, status) IS DISTINCT FROM lag(row(product_name, category, brand, price, status)) OVER w AS other FROM latest WINDOW w AS (PARTITION BY product_id ORDER BY snapshot_date)),
history AS (
  SELECT product_id, snapshot_date AS f, lead(snapshot_date) OVER (PARTITION BY product_id ORDER BY snapshot_date) AS nx, product_name, category, brand, price, status FROM marked WHERE other)
"""

P3_HISTORY = f"""
WITH {_LATEST}
SELECT product_id, strftime(f, '%Y-%m-%d') AS valid_from, coalesce(strftime(nx - INTERVAL 1 DAY, '%Y-%m-%d'), '9999-12-31') AS valid_to, CAST(nx IS NULL AS BIGINT) AS is_current, product_name, category, brand, price, status FROM history
"""

P3_FOUND = f"""
WITH {_LATEST},
ours AS (SELECT product_id, strftime(f, '%Y-%m-%d') AS valid_from, coalesce(strftime(nx - INTERVAL 1 DAY, '%Y-%m-%d'), '9999-12-31') AS valid_to, CAST(nx IS NULL AS BIGINT) AS is_current FROM history),
held AS (SELECT product_id, coalesce(strftime(valid_from, '%Y-%m-%d'), '') AS valid_from, coalesce(strftime(valid_to, '%Y-%m-%d'), '') AS valid_to, CAST(coalesce(is_current, -1) AS BIGINT) AS is_current FROM dim_product_scd2)
SELECT *, 'snapshots' AS side FROM (FROM ours EXCEPT FROM held) UNION ALL SELECT *, 'dim' AS side FROM (FROM held EXCEPT FROM ours)
"""

P4_FOUND = f"""
WITH {_LATEST},
days AS (SELECT d, lead(d) OVER (ORDER BY d) AS nx FROM (SELECT DISTINCT snapshot_date AS d FROM ods_product WHERE snapshot_date IS NOT NULL)),
old AS (SELECT latest.*, nx FROM latest JOIN days ON d = snapshot_date WHERE nx IS NOT NULL),
new AS (SELECT * FROM latest WHERE snapshot_date > (SELECT min(d) FROM days))
SELECT coalesce(n.product_id, o.product_id) AS product_id, strftime(coalesce(n.snapshot_date, o.nx), '%Y-%m-%d') AS snapshot_date, CASE WHEN o.nx IS NULL THEN 'added' WHEN n.snapshot_date IS NULL THEN 'removed' ELSE 'changed' END AS change_type
FROM old o FULL JOIN new n ON o.product_id IS NOT DISTINCT FROM n.product_id AND o.nx = n.snapshot_date
WHERE o.nx IS NULL OR n.snapshot_date IS NULL OR row(o.product_name, o.category, o.brand, o.price, o.status) IS DISTINCT FROM row(n.product_name, n.category, n.brand, n.price, n.status)
"""

_AT = "dwd_order_sku_detail d LEFT JOIN dim_product_scd2 v ON v.product_id = d.product_id AND d.dt BETWEEN v.valid_from AND v.valid_to"
P5_ATTRIBUTES = f"SELECT d.order_id, strftime(d.dt, '%Y-%m-%d') AS dt, d.product_id, v.category AS right_category, v.price AS right_price FROM {_AT}"
P5_FOUND = f"SELECT d.order_id FROM {_AT} WHERE d.category IS DISTINCT FROM v.category OR d.sku_price IS DISTINCT FROM v.price"

_ID = "order_id, lower(trim(event_type)) AS event_type"
P6_FOUND = f"SELECT {_ID} FROM ods_order_event WHERE order_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL HAVING count(*) > 1"
P6_COPIES = f"SELECT {_ID}, count(*) AS copies FROM ods_order_event WHERE order_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL"
P6_MESSAGES = f"""
SELECT {_ID}, event_time, user_id, product_id, amount, order_time, dt, count(*) OVER (PARTITION BY order_id, lower(trim(event_type))) AS copies FROM ods_order_event WHERE order_id IS NOT NULL AND event_type IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY order_id, lower(trim(event_type)) ORDER BY event_time NULLS LAST, user_id NULLS FIRST, product_id NULLS FIRST, amount NULLS FIRST, order_time NULLS FIRST, dt NULLS FIRST) = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": p1_found(), "p2_found": P2_FOUND, "p2_profile": P2_PROFILE, "p3_found": P3_FOUND, "p3_history": P3_HISTORY, "p3_appended": P3_HISTORY, "p4_found": P4_FOUND, "p5_found": P5_FOUND, "p5_attributes": P5_ATTRIBUTES, "p6_found": P6_FOUND, "p6_copies": P6_COPIES, "p6_messages": P6_MESSAGES}
