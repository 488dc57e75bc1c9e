"""DuckDB SQL for the queries of chain.py."""

from __future__ import annotations

from ledgerloom.plans.chain import AS_OF as LIFE_AS_OF
from ledgerloom.plans.chain import LIFE_CUT as CUT
from ledgerloom.plans.chain import SCOPE

DETAIL = """
detail AS (
  SELECT order_id, dt, user_id, product_id, abs(amount) AS amount, order_time, status FROM ods_order WHERE user_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dt, order_id ORDER BY abs(amount) DESC NULLS LAST, order_time DESC NULLS LAST, status DESC NULLS LAST, user_id DESC NULLS LAST, product_id DESC NULLS LAST) = 1)
"""
SNAP = """
snap AS (
  SELECT * FROM ods_product WHERE product_id IS NOT NULL AND snapshot_date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY product_id, snapshot_date ORDER BY update_time DESC NULLS LAST, product_name DESC NULLS LAST, category DESC NULLS LAST, brand DESC NULLS LAST, price DESC NULLS LAST, status DESC NULLS LAST) = 1)
"""


def _history(name: str, tracked: str) -> str:
    return f"""
{name}_m AS (SELECT *, row_number() OVER w = 1 OR row({tracked}) IS DISTINCT FROM lag(row({tracked})) OVER w AS new FROM snap WINDOW w AS (PARTITION BY product_id ORDER BY snapshot_date)),
{name} AS (
  SELECT product_id, snapshot_date AS valid_from, coalesce(CAST(lead(snapshot_date) OVER v - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') AS valid_to, CAST(lead(snapshot_date) OVER v IS NULL AS BIGINT) AS is_current, product_name, category, brand, price, status
  FROM {name}_m WHERE new WINDOW v AS (PARTITION BY product_id ORDER BY snapshot_date))
"""


H5 = _history("h", "product_name, category, brand, price, status")
H3 = _history("h", "category, price, status")
HISTORY_OUT = "SELECT product_id, strftime(valid_from, '%Y-%m-%d') AS valid_from, strftime(valid_to, '%Y-%m-%d') AS valid_to, is_current, product_name, category, brand, price, status FROM h"
_EPOCH = "TIMESTAMP '1970-01-01 00:00:00'"


def _life(where: str = "TRUE", name: str = "life", last: str = "") -> str:
    """The accumulating snapshot: the stage is the milestone at the latest event time, of equal ones the terminal one; both lags in days count from the order."""
    times = ("order_time", "pay_time", "ship_time", "finish_time", "cancel_time")
    return f"""
{name}_agg AS (
  SELECT order_id, max(user_id) AS user_id, max(product_id) AS product_id, max(amount) AS amount, {", ".join(f"max(CASE WHEN lower(trim(event_type)) = '{t.split('_')[0]}' THEN event_time END) AS {t}" for t in times)}
  FROM ods_order_event WHERE order_id IS NOT NULL AND {where} GROUP BY order_id),
{name} AS (
  SELECT order_id, user_id, product_id, amount, {", ".join(times)},
    CASE WHEN cancel_time = last_event_time THEN 'cancel' WHEN finish_time = last_event_time THEN 'finish' WHEN ship_time = last_event_time THEN 'ship' WHEN pay_time = last_event_time THEN 'pay' ELSE 'order' END AS current_stage,
    CAST(date_sub('hour', order_time, pay_time) AS BIGINT) AS pay_lag_hours, CAST(date_diff('day', CAST(order_time AS DATE), CAST(ship_time AS DATE)) AS BIGINT) AS ship_lag_days, CAST(date_diff('day', CAST(order_time AS DATE), CAST(finish_time AS DATE)) AS BIGINT) AS finish_lag_days, last_event_time{last}
  FROM (SELECT *, greatest({", ".join(f"coalesce({t}, {_EPOCH})" for t in times)}) AS last_event_time FROM {name}_agg))
"""


LIFE = _life()
LIFE_THEN = _life(f"dt < DATE '{CUT}'", "held")
LIFE_OUT = f"SELECT *, TIMESTAMP '{LIFE_AS_OF}' AS update_time FROM life"
USER_DAY = """
user_day AS (
  SELECT user_id, dt, count(*) AS order_cnt, count(*) FILTER (status = 'paid') AS paid_cnt, CAST(coalesce(sum(amount) FILTER (status = 'paid'), 0) AS DECIMAL(18,2)) AS paid_amount, CAST(coalesce(sum(amount) FILTER (status = 'refund'), 0) AS DECIMAL(18,2)) AS refund_amount
  FROM detail GROUP BY user_id, dt)
"""


def _sales(source: str, name: str = "sales") -> str:
    """Ratios by whole cents, half up, as decimals are rounded."""
    return f"""
{name} AS (
  SELECT dt, order_cnt, paid_cnt, paid_amount, refund_amount, CAST(paid_amount - refund_amount AS DECIMAL(18,2)) AS net_amount,
    CAST(((2 * CAST(paid_amount * 100 AS HUGEINT) + paid_cnt) // nullif(2 * paid_cnt, 0)) / 100.0 AS DECIMAL(18,2)) AS avg_order_amount, CAST(((20000 * paid_cnt + order_cnt) // nullif(2 * order_cnt, 0)) / 10000.0 AS DECIMAL(10,4)) AS pay_rate
  FROM (SELECT dt, CAST(sum(order_cnt) AS BIGINT) AS order_cnt, CAST(sum(paid_cnt) AS BIGINT) AS paid_cnt, CAST(sum(paid_amount) AS DECIMAL(18,2)) AS paid_amount, CAST(sum(refund_amount) AS DECIMAL(18,2)) AS refund_amount FROM {source} GROUP BY dt))
"""


def _day(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {name or c.split('.')[-1]}"


SALES_OUT = f"{_day('dt')}, order_cnt, paid_cnt, paid_amount, refund_amount, net_amount, avg_order_amount, pay_rate"
AS_OF = "detail d {how} JOIN h ON h.product_id = d.product_id AND d.dt BETWEEN h.valid_from AND h.valid_to"
SKU_OUT = f"SELECT d.order_id, {_day('d.dt')}, d.user_id, d.product_id, d.amount, d.order_time, d.status, {_day('h.valid_from')}, {_day('h.valid_to')}, h.category, h.brand, h.price AS sku_price"
CATEGORY = f"SELECT d.dt, h.category, count(*) AS orders, CAST(sum(d.amount) AS DECIMAL(18,2)) AS amount FROM {AS_OF.format(how='LEFT')} GROUP BY d.dt, h.category"


def _except(a: str, b: str, cols: str, out: str, head: str = "") -> str:
    return f"""{head} SELECT {out}, side, CAST(count(*) AS BIGINT) AS surplus FROM (
      SELECT 'stored' AS side, * FROM (SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b}) UNION ALL SELECT 'recomputed' AS side, * FROM (SELECT {cols} FROM {b} EXCEPT ALL SELECT {cols} FROM {a})) GROUP BY ALL"""


_UD = "user_id, dt, order_cnt, paid_cnt, paid_amount, refund_amount"
_SD = "dt, order_cnt, paid_cnt, paid_amount, refund_amount, net_amount, avg_order_amount, pay_rate"
_GATE_DAY = "(SELECT max(dt) FROM ods_order)"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["order_detail"] = f"WITH {DETAIL} SELECT order_id, {_day('dt')}, user_id, product_id, amount, order_time, status FROM detail"
    q["ods_replay_counters"] = f"SELECT {_day('dt')}, count(*) AS raw, count(*) FILTER (user_id IS NULL) AS null_user, count(*) FILTER (amount < 0) AS negative, count(DISTINCT order_id) AS orders FROM ods_order GROUP BY ods_order.dt"
    q["ods_event_dedup"] = f"""SELECT order_id, user_id, product_id, amount, order_time, event_type, event_time, {_day('dt')} FROM (SELECT * FROM ods_order_event
      QUALIFY row_number() OVER (PARTITION BY dt, order_id, event_type ORDER BY event_time NULLS LAST, order_time NULLS LAST, user_id NULLS LAST, product_id NULLS LAST, amount NULLS LAST) = 1)"""
    q["event_dup_ratio"] = f"SELECT {_day('dt')}, round(count(*) / count(DISTINCT (order_id, event_type)), 6) AS ratio FROM ods_order_event WHERE order_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ods_order_event.dt"
    q["product_scd1_latest"] = f"""SELECT product_id, product_name, category, brand, price, status, {_day('snapshot_date')} FROM (SELECT * FROM ods_product WHERE product_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY snapshot_date DESC NULLS LAST, update_time DESC NULLS LAST, product_name DESC NULLS LAST, category DESC NULLS LAST, brand DESC NULLS LAST, price DESC NULLS LAST, status DESC NULLS LAST) = 1)"""
    q["product_scd2_full3"] = f"WITH {SNAP}, {H3} {HISTORY_OUT}"
    q["product_scd2_full5"] = q["product_scd2_incremental"] = f"WITH {SNAP}, {H5} {HISTORY_OUT}"
    q["product_current_from_scd2"] = f"WITH {SNAP}, {H5} SELECT product_id, product_name, category, brand, price, status FROM h WHERE is_current = 1"
    q["version_counts"] = f"WITH {SNAP}, {H5} SELECT product_id, count(*) AS versions FROM h GROUP BY product_id HAVING count(*) > 1"
    q["snapshot_change_count"] = f"""WITH {SNAP}, days AS (SELECT d, lead(d) OVER (ORDER BY d) AS nx FROM (SELECT DISTINCT snapshot_date AS d FROM snap))
      SELECT {_day('b.snapshot_date')}, count(*) FILTER (a.price IS DISTINCT FROM b.price) AS changed FROM snap a JOIN days ON a.snapshot_date = days.d JOIN snap b ON b.product_id = a.product_id AND b.snapshot_date = days.nx GROUP BY b.snapshot_date"""
    q["order_sku_asof_left"] = f"WITH {DETAIL}, {SNAP}, {H5} {SKU_OUT} FROM {AS_OF.format(how='LEFT')}"
    q["order_sku_asof_inner"] = f"WITH {DETAIL}, {SNAP}, {H5} {SKU_OUT} FROM {AS_OF.format(how='INNER')}"
    q["order_sku_orphans"] = f"WITH {DETAIL}, {SNAP}, {H5} SELECT order_id, {_day('dt')}, user_id, product_id, amount, order_time, status FROM detail d WHERE NOT EXISTS (FROM h WHERE h.product_id = d.product_id AND d.dt BETWEEN h.valid_from AND h.valid_to)"
    q["order_sku_unmatched"] = f"WITH {DETAIL}, {SNAP}, {H5} SELECT {_day('d.dt')}, count(*) AS unmatched FROM {AS_OF.format(how='LEFT')} WHERE h.valid_from IS NULL GROUP BY d.dt"
    q["order_lifecycle"] = f"WITH {LIFE} {LIFE_OUT}"
    q["order_lifecycle_expected"] = f"WITH {LIFE} SELECT * FROM life"
    q["order_lifecycle_incremental"] = f"WITH {LIFE} {LIFE_OUT} WHERE order_id IN (SELECT order_id FROM ods_order_event WHERE dt BETWEEN DATE '{SCOPE[0]}' AND DATE '{SCOPE[1]}')"
    q["lifecycle_stage_distribution"] = f"WITH {LIFE} SELECT current_stage, count(*) AS orders FROM life GROUP BY current_stage"
    lags = ", ".join(f"count({c}) AS n_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}" for c in ("pay_lag_hours", "ship_lag_days", "finish_lag_days"))
    q["lifecycle_lags"] = f"WITH {LIFE} SELECT current_stage, {lags} FROM life GROUP BY current_stage"
    q["dws_user_order_day"] = f"WITH {DETAIL}, {USER_DAY} SELECT user_id, {_day('dt')}, order_cnt, paid_cnt, paid_amount, refund_amount FROM user_day"
    q["ads_daily_sales"] = f"WITH {DETAIL}, {USER_DAY}, {_sales('user_day')} SELECT {SALES_OUT} FROM sales"
    q["category_day_sales"] = f"WITH {DETAIL}, {SNAP}, {H5} SELECT {_day('dt')}, category, orders, amount FROM ({CATEGORY})"
    q["top_category_days"] = f"WITH {DETAIL}, {SNAP}, {H5} SELECT {_day('dt')}, category, orders, amount FROM (SELECT * FROM ({CATEGORY}) ORDER BY amount DESC NULLS LAST, dt, category NULLS LAST LIMIT 20)"
    q["daily_threshold_70pct"] = f"""SELECT {_day('dt')}, n, CAST((sum(n) OVER w * 7) // (count(*) OVER w * 10) AS BIGINT) AS least FROM (SELECT dt, count(*) AS n FROM ods_order GROUP BY dt) WINDOW w AS (ORDER BY dt RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)"""
    q["ods_gate"] = f"""
    WITH w AS (SELECT dt, count(*) AS n, count(order_id) - count(DISTINCT order_id) AS surplus FROM ods_order WHERE dt BETWEEN {_GATE_DAY} - 6 AND {_GATE_DAY} GROUP BY dt),
    o AS (SELECT coalesce(max(n) FILTER (dt = {_GATE_DAY}), 0) AS n, avg(n) AS mean, coalesce(max(surplus) FILTER (dt = {_GATE_DAY}), 0) AS surplus, count(*) AS days FROM w),
    e AS (SELECT count(*) AS events, count(*) FILTER (event_type IS NULL OR event_type NOT IN ('order', 'pay', 'ship', 'finish', 'cancel')) AS bad, count(DISTINCT (coalesce(order_id, -1), coalesce(event_type, ''))) AS messages FROM ods_order_event WHERE dt = {_GATE_DAY}),
    b AS (SELECT *, CASE WHEN messages > 0 THEN events / messages ELSE 99.0 END AS ratio, coalesce(n / nullif(mean, 0), 0) AS share FROM o, e)
    SELECT 'c1' AS check_id, 'day has rows' AS check_name, n > 0 AND events > 0 AS ok, round(CAST(least(n, events) AS DOUBLE), 6) AS value FROM b
    UNION ALL SELECT 'c2', 'volume', share >= 0.7, round(CAST(share AS DOUBLE), 6) FROM b UNION ALL SELECT 'c3', 'order_id unique', surplus = 0, CAST(surplus AS DOUBLE) FROM b
    UNION ALL SELECT 'c4', 'event types', bad = 0, CAST(bad AS DOUBLE) FROM b UNION ALL SELECT 'c5', 'copies', ratio <= 1.10, round(CAST(ratio AS DOUBLE), 6) FROM b UNION ALL SELECT 'c6', 'seven days', days = 7, CAST(days AS DOUBLE) FROM b"""
    h, sku = "dim_product_scd2", "dwd_order_sku_detail"
    open_end = "DATE '9999-12-31'"
    valid = f"{sku} k LEFT JOIN {h} h ON h.product_id = k.product_id AND k.dt BETWEEN h.valid_from AND h.valid_to"
    q["dim_checks"] = f"""
    WITH {DETAIL}, g AS (SELECT valid_to, lead(valid_from) OVER (PARTITION BY product_id ORDER BY valid_from) AS nx FROM {h})
    SELECT 'one current version' AS check_name, (SELECT count(*) FROM (SELECT sum(is_current) AS c FROM {h} GROUP BY product_id) WHERE c IS DISTINCT FROM 1) AS violations
    UNION ALL SELECT 'continuous versions', (SELECT count(*) FROM g WHERE nx IS NOT NULL AND (valid_to = {open_end} OR valid_to + 1 <> nx))
    UNION ALL SELECT 'current means open', (SELECT count(*) FROM {h} WHERE (is_current = 1) IS DISTINCT FROM (valid_to = {open_end}))
    UNION ALL SELECT 'wide table rows', (SELECT CAST(abs((SELECT count(*) FROM detail) - (SELECT count(*) FROM {sku})) AS BIGINT))
    UNION ALL SELECT 'wide table amount', (SELECT CAST(abs((SELECT coalesce(sum(amount), 0) FROM detail) - (SELECT coalesce(sum(amount), 0) FROM {sku})) > 0.01 AS BIGINT))
    UNION ALL SELECT 'wide table attributes', (SELECT count(*) FROM {valid} WHERE k.category IS DISTINCT FROM h.category OR k.brand IS DISTINCT FROM h.brand OR k.sku_price IS DISTINCT FROM h.price)
    UNION ALL SELECT 'no valid version', (SELECT count(*) FROM {valid} WHERE h.product_id IS NULL)"""
    p1 = lambda a, b, keys, fields: f"(SELECT count(*) FROM (SELECT {keys}, {', '.join(f'list_sort(list({f})) AS {f}' for f in fields)}, count(*) AS n FROM {a} GROUP BY {keys}) x FULL JOIN (SELECT {keys}, {', '.join(f'list_sort(list({f})) AS {f}' for f in fields)}, count(*) AS n FROM {b} GROUP BY {keys}) y USING ({keys}), unnest([{', '.join(f'CAST(x.n = y.n AND x.{f} IS DISTINCT FROM y.{f} AS INT)' for f in fields)}, CAST(x.n IS DISTINCT FROM y.n AS INT)]) AS u(bad) WHERE bad = 1)"
    atoms = ("order_cnt", "paid_cnt", "paid_amount", "refund_amount")
    q["order_checks"] = f"""
    WITH {DETAIL}, {USER_DAY}, {_sales('dws_user_order_day')}, {_sales('ads_daily_sales', 'remade')}
    SELECT 'dws is detail aggregated' AS check_name, {p1('dws_user_order_day', 'user_day', 'user_id, dt', atoms)} AS violations
    UNION ALL SELECT 'dws covers detail', (SELECT count(*) FROM (SELECT dt FROM detail EXCEPT SELECT dt FROM dws_user_order_day))
    UNION ALL SELECT 'ads is dws summed', {p1('ads_daily_sales', 'sales', 'dt', atoms)}
    UNION ALL SELECT 'derived columns', (SELECT count(*) FROM ads_daily_sales a JOIN remade r USING (dt) WHERE a.net_amount IS DISTINCT FROM r.net_amount OR a.avg_order_amount IS DISTINCT FROM r.avg_order_amount OR a.pay_rate IS DISTINCT FROM r.pay_rate OR a.paid_cnt > a.order_cnt)
    UNION ALL SELECT 'detail within raw orders', (SELECT count(*) FROM (SELECT dt, count(*) AS n FROM detail GROUP BY dt) x JOIN (SELECT dt, count(*) AS n FROM ods_order GROUP BY dt) y USING (dt) WHERE x.n > y.n)
    UNION ALL SELECT 'raw orders cover detail', (SELECT count(*) FROM (SELECT dt FROM detail EXCEPT SELECT dt FROM ods_order))"""
    def life_checks(held: str) -> str:
        return f"""SELECT 'surplus rows' AS check_name, (SELECT count(*) FROM (FROM {held} EXCEPT ALL FROM life)) AS violations UNION ALL SELECT 'missing rows', (SELECT count(*) FROM (FROM life EXCEPT ALL FROM {held}))
          UNION ALL SELECT 'row count', CAST(abs((SELECT count(*) FROM {held}) - (SELECT count(*) FROM life)) AS BIGINT) UNION ALL SELECT 'order unique', count(*) - count(DISTINCT order_id) FROM {held}
          UNION ALL SELECT 'start known', count(*) FILTER (order_time IS NULL) FROM {held}
          UNION ALL SELECT 'lags follow milestones', count(*) FILTER ((pay_lag_hours IS NOT NULL) <> (order_time IS NOT NULL AND pay_time IS NOT NULL) OR (ship_lag_days IS NOT NULL) <> (order_time IS NOT NULL AND ship_time IS NOT NULL) OR (finish_lag_days IS NOT NULL) <> (order_time IS NOT NULL AND finish_time IS NOT NULL)) FROM {held}
          UNION ALL SELECT 'stage known', count(*) FILTER (current_stage IS NULL) FROM {held}"""

    # A lifecycle that was kept up to date holds what all events say.
    q["lifecycle_checks"] = f"WITH {LIFE} {life_checks('life')} UNION ALL SELECT 'events unique', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM ods_order_event GROUP BY order_id, event_type)"
    q["lifecycle_checks_behind"] = f"WITH {LIFE}, {LIFE_THEN} {life_checks('held')}"
    marks = [(n, "dt") for n in ("ods_order", "ods_order_event", "dwd_order_sku_detail", "dws_user_order_day", "ads_daily_sales")] + [("ods_product", "snapshot_date")]
    q["recon_watermarks"] = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows, {_day(f'min({c})', 'first_dt')}, {_day(f'max({c})', 'last_dt')} FROM {n}" for n, c in marks)
    close = lambda a, b: f"SELECT {_day('dt')}, expected, actual FROM (SELECT dt, CAST(sum(e) AS BIGINT) AS expected, CAST(sum(a) AS BIGINT) AS actual FROM (SELECT dt, 1 AS e, 0 AS a FROM {a} UNION ALL SELECT dt, 0, 1 FROM {b}) GROUP BY dt) WHERE expected <> actual"
    q["recon_closure_detail"] = f"WITH {DETAIL} {close('ods_order WHERE user_id IS NOT NULL', f"""detail WHERE dt < DATE '{CUT}'""")}"
    q["recon_closure_sku"] = close("ods_order WHERE user_id IS NOT NULL", "dwd_order_sku_detail")
    q["recon_bad_days_of_closure"] = f"SELECT * FROM ({q['recon_closure_sku']}) ORDER BY dt LIMIT 10"
    q["recon_closure_lifecycle"] = f"WITH {LIFE_THEN}, e AS (SELECT DISTINCT dt, order_id FROM ods_order_event WHERE order_id IS NOT NULL) {close('e', '(SELECT e.* FROM e SEMI JOIN held USING (order_id))')}"
    q["recon_symdiff_dws"] = _except("dws_user_order_day", "user_day", _UD, f"user_id, {_day('dt')}, order_cnt, paid_cnt, paid_amount, refund_amount", f"WITH {DETAIL}, {USER_DAY}")
    q["recon_symdiff_ads"] = _except("ads_daily_sales", "sales", _SD, SALES_OUT, f"WITH {_sales('dws_user_order_day')}")
    q["recon_bad_days_topn"] = f"SELECT dt, count(*) AS rows FROM ({q['recon_symdiff_dws']}) GROUP BY dt ORDER BY rows DESC, dt LIMIT 10"
    holes = lambda t, c: f"SELECT {_day('d', 'after')}, {_day('n', 'next')}, CAST(n - d - 1 AS BIGINT) AS missing FROM (SELECT d, lead(d) OVER (ORDER BY d) AS n FROM (SELECT DISTINCT {c} AS d FROM {t} WHERE {c} IS NOT NULL)) WHERE n - d > 1"
    q["recon_date_holes"] = f"{holes('ads_daily_sales', 'dt')} UNION ALL {holes('ods_product', 'snapshot_date')}"
    q["rt_vs_batch_diff"] = f"""SELECT {_day('dt')}, a.net_amount AS "left", b.net_amount AS "right", CAST(coalesce(a.net_amount, 0) - coalesce(b.net_amount, 0) AS DECIMAL(18,2)) AS diff
      FROM ads_daily_sales a FULL JOIN (SELECT dt, max(CAST(net_amount AS DECIMAL(18,2))) AS net_amount FROM ads_daily_sales_wh GROUP BY dt) b USING (dt)"""
    text = lambda c: f"coalesce('=' || CAST({c} AS VARCHAR), '~')"
    print_of = {
        "ods_order": "order_id user_id product_id amount order_time status dt", "ods_product": "product_id product_name category brand price status update_time snapshot_date",
        "dwd_order_sku_detail": "order_id dt user_id product_id amount order_time status category brand sku_price valid_from valid_to", "dws_user_order_day": _UD.replace(",", ""), "ads_daily_sales": _SD.replace(",", ""),
    }
    q["fingerprint_marts"] = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows, CAST(coalesce(sum(CAST('0x' || md5(concat_ws('|', {', '.join(map(text, c.split()))}))[1:12] AS BIGINT)), 0) AS BIGINT) AS checksum FROM {n}" for n, c in print_of.items())
    q["table_stats"] = f"WITH {DETAIL} SELECT count(*) AS rows, CAST(coalesce(sum(amount), 0) AS DECIMAL(18,2)) AS amount, count(DISTINCT order_id) AS orders FROM detail"
    cols = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
    rest = ", ".join(f"{c} DESC NULLS LAST" for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))
    q["lineitem_dedup"] = f"SELECT {cols} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {rest}) = 1"
    return q
