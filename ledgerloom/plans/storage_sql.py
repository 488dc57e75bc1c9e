"""DuckDB SQL for the queries of storage.py."""

from __future__ import annotations

from ledgerloom.plans.chain import LIFE_CUT as CUT
from ledgerloom.plans.chain_sql import DETAIL, USER_DAY, _day, _except
from ledgerloom.plans.storage import DAY, FROM, TO

_WH = "wh AS (SELECT user_id, dt, max(order_cnt) AS order_cnt, max(paid_cnt) AS paid_cnt, max(CAST(paid_amount AS DECIMAL(18,2))) AS paid_amount, max(CAST(refund_amount AS DECIMAL(18,2))) AS refund_amount FROM dws_user_order_day_wh GROUP BY user_id, dt)"
_OUT = f"user_id, {_day('dt')}, order_cnt, paid_cnt, paid_amount, refund_amount"
_LAKE = "dws_user_order_day"
_COLS = "user_id, dt, order_cnt, paid_cnt, paid_amount, refund_amount"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["table_upsert"] = f"WITH {_WH} SELECT {_OUT} FROM (SELECT {_COLS} FROM wh UNION ALL SELECT {_COLS} FROM {_LAKE} l WHERE NOT EXISTS (FROM wh WHERE wh.user_id IS NOT DISTINCT FROM l.user_id AND wh.dt IS NOT DISTINCT FROM l.dt))"
    q["table_delete_keys"] = f"SELECT {_OUT} FROM {_LAKE} WHERE user_id NOT IN (SELECT user_id FROM {_LAKE} WHERE order_cnt > 10)"
    q["table_delete_where"] = f"SELECT {_OUT} FROM {_LAKE} WHERE NOT coalesce(paid_cnt = 0 AND dt >= DATE '{FROM}', FALSE)"
    q["table_range_overwrite"] = f"WITH {_WH} SELECT {_OUT} FROM (SELECT {_COLS} FROM {_LAKE} WHERE dt NOT BETWEEN DATE '{FROM}' AND DATE '{TO}' UNION ALL SELECT {_COLS} FROM wh WHERE dt BETWEEN DATE '{FROM}' AND DATE '{TO}' AND dt <> DATE '{DAY}')"
    q["table_truncate_reload"] = q["table_replace_all"] = f"WITH {_WH} SELECT {_OUT} FROM wh"
    hit = f"is_current = 1 AND valid_from < DATE '{CUT}'"
    q["table_update"] = f"SELECT product_id, {_day('valid_from')}, strftime(CASE WHEN {hit} THEN CAST(DATE '{CUT}' - 1 AS DATE) ELSE valid_to END, '%Y-%m-%d') AS valid_to, CAST(CASE WHEN {hit} THEN 0 ELSE is_current END AS BIGINT) AS is_current, category, price FROM dim_product_scd2"
    q["table_drop_partitions"] = f"SELECT {_OUT} FROM {_LAKE} WHERE dt >= DATE '{FROM}'"
    q["table_time_travel"] = q["table_append_once"] = f"SELECT {_OUT} FROM {_LAKE}"
    count = lambda n, op, where: f"SELECT CAST({n} AS BIGINT) AS version, '{op}' AS operation, count(DISTINCT dt) AS partitions, count(*) AS rows FROM {_LAKE} WHERE {where}"
    q["table_inventory"] = " UNION ALL ".join([count(1, "append", "TRUE"), count(2, "delete", f"dt >= DATE '{FROM}'"), count(3, "truncate", "FALSE")])
    q["table_after_expiry"] = f"SELECT count(*) AS rows, CAST(sum(paid_amount) AS DECIMAL(18,2)) AS amount, CAST(1 AS BIGINT) AS versions FROM {_LAKE} WHERE order_cnt <= 5"
    s = "(SELECT min(dt) AS a, max(dt) AS b FROM ods_order)"
    run = lambda name, first: f"SELECT '{name}' AS run, strftime({first}, '%Y-%m-%d') AS first, strftime(b, '%Y-%m-%d') AS last FROM {s}"
    q["incremental_ranges"] = " UNION ALL ".join([run("empty target", "a"), run("behind", f"greatest(a, DATE '{CUT}' + 1)"), run("behind, lookback 3", f"greatest(a, DATE '{CUT}' - 2)"), run("marts, lookback 3", f"greatest(a, DATE '{CUT}' - 2)")])
    q["dry_run_days"] = f"SELECT {_day('d', 'snapshot_date')}, count(snapshot_date) AS rows FROM (SELECT CAST(unnest(generate_series(min(snapshot_date), max(snapshot_date), INTERVAL 1 DAY)) AS DATE) AS d FROM ods_product) LEFT JOIN ods_product ON snapshot_date = d GROUP BY d"
    early = f"dt < DATE '{CUT}'"
    q["drift_before_range"] = _except(f"(FROM {_LAKE} WHERE {early})", f"(FROM user_day WHERE {early})", _COLS, _OUT, f"WITH {DETAIL}, {USER_DAY}")
    q["topic_orders_of_day"] = f"SELECT order_id, user_id, product_id, amount, order_time, status, {_day('CAST(order_time AS DATE)', 'dt')} FROM ods_order WHERE CAST(order_time AS DATE) = DATE '{DAY}'"
    q["topic_events_replayed"] = f"""SELECT order_id, user_id, product_id, amount, order_time, event_type, event_time, {_day('d', 'dt')} FROM (SELECT *, CAST(event_time AS DATE) AS d FROM ods_order_event
      QUALIFY row_number() OVER (PARTITION BY d, order_id, event_type ORDER BY event_time NULLS LAST, order_time NULLS LAST, user_id NULLS LAST, product_id NULLS LAST, amount NULLS LAST) = 1)"""
    q["topic_ingested_once"] = f"SELECT {_day('d', 'dt')}, count(*) AS rows, CAST(sum(amount) AS DECIMAL(18,2)) AS amount FROM (SELECT CAST(order_time AS DATE) AS d, amount FROM ods_order) GROUP BY d"
    q["csv_snapshots_loaded"] = f"SELECT product_id, product_name, category, brand, price, status, update_time, {_day('snapshot_date')} FROM ods_product WHERE snapshot_date IS NOT NULL"
    ads = ("dt", "order_cnt", "paid_cnt", "paid_amount", "refund_amount", "net_amount", "avg_order_amount", "pay_rate")
    q["text_lines"] = f"""SELECT concat_ws(chr(9), {", ".join(f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in ads)}) AS value FROM ads_daily_sales"""
    last = "(SELECT max(dt) FROM ods_order)"
    q["realtime_checks"] = f"""
    WITH l AS (SELECT dt, count(*) AS n FROM dwd_order_sku_detail GROUP BY dt), b AS (SELECT dt, count(*) AS n FROM ods_order GROUP BY dt), m AS (SELECT avg(n) AS mean FROM b WHERE dt BETWEEN {last} - 7 AND {last} - 1)
    SELECT 'live table is fresh' AS check_name, CAST((SELECT max(dt) FROM l) IS DISTINCT FROM {last} AS BIGINT) AS violations
    UNION ALL SELECT 'live volume', CAST(NOT coalesce((SELECT coalesce(max(n), 0) FROM l WHERE dt = {last}) BETWEEN 0.7 * mean AND 1.5 * mean, FALSE) AS BIGINT) FROM m
    UNION ALL SELECT 'live equals batch', (SELECT count(*) FROM l JOIN b USING (dt) WHERE dt < {last} AND l.n <> b.n)"""
    steps = ", ".join(f"max(event_time) FILTER (event_type = '{k}') AS {k}_time" for k in ("pay", "ship", "finish", "cancel"))
    q["order_state"] = f"SELECT order_id, max(user_id) AS user_id, max(product_id) AS product_id, max(amount) AS amount, min(order_time) AS order_time, {steps} FROM ods_order_event WHERE order_id IS NOT NULL GROUP BY order_id"
    cols = ("event_time", "order_id", "event_type", "user_id", "product_id", "amount", "order_time")
    q["event_sequence"] = f"SELECT {', '.join(cols)}, row_number() OVER (ORDER BY {', '.join(f'{c} NULLS FIRST' for c in cols)}) AS position FROM ods_order_event"
    return q
