"""The layered tables of one lake folder and the steps that keep them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import checks, dims, facts, incremental, recon
from ledgerloom.operators.history import HeldHistory
from ledgerloom.plans.pipeline import Step
from ledgerloom.sources.versioned import VersionedTable

#: Table: partition column.
TABLES = {"ods_order": "dt", "ods_order_event": "dt", "ods_product": "snapshot_date", "dim_product": None, "dim_product_scd2": None, "dwd_order_detail": "dt", "dwd_order_sku_detail": "dt", "dwd_order_lifecycle": "placed_month", "dws_user_order_day": "dt", "ads_daily_sales": "dt"}


FACTS = ("dwd_order_detail", "dwd_order_sku_detail", "dwd_order_lifecycle")
MARTS = ("dws_user_order_day", "ads_daily_sales")


class LifecycleTable:
    """The accumulating snapshot, stored by the month in which an order was placed: orders with new events were placed lately, so an upsert rewrites few partitions, however long the past."""

    MONTH = "placed_month"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.held = VersionedTable(spark, root, self.MONTH)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.MONTH, F.date_format("order_time", "yyyy-MM"))

    def read(self) -> DataFrame:
        return self.held.read().drop(self.MONTH)

    def rebuild(self, events: DataFrame, update_time: dt.datetime | None = None) -> int:
        return self.held.replace_all(self._placed(facts.lifecycle(events, update_time=update_time)))

    def advance(self, events: DataFrame, first: facts.Day, last: facts.Day, update_time: dt.datetime | None = None) -> int:
        """Make the orders with an event in the range anew, from all their events, and put them in place of what is held of them."""
        return self.held.upsert(self._placed(facts.lifecycle(events, facts.scope_orders(events, first, last), update_time)), ["order_id"])


class Warehouse:
    """What is written is checked after each build; a build whose tables aren't what they should be ends with Failed, and with what is wrong in its message."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.tables = {n: VersionedTable(spark, f"{root}/{n}", p) for n, p in TABLES.items()}
        self.lifecycle = LifecycleTable(spark, f"{root}/dwd_order_lifecycle")
        self.history = HeldHistory(spark, f"{root}/dim_product_history", "product_id", "snapshot_date", "update_time", dims.TRACKED_5, leaf_bits=12)

    def read(self, name: str, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
        rows = self.tables[name].read(first=first and str(first), last=last and str(last))
        return rows.drop(LifecycleTable.MONTH)

    def _bounds(self, name: str) -> tuple[dt.date | None, dt.date | None]:
        """First and last day, from the manifest alone."""
        m = self.tables[name].manifest()
        days = sorted(m["parts"]) if m else []
        days = [d for d in days if d[0].isdigit()]
        return (dt.date.fromisoformat(days[0]), dt.date.fromisoformat(days[-1])) if days else (None, None)

    def build_dims(self, full: bool = False) -> dict[str, int]:
        """History and current dimension. Incrementally from the held history: days of snapshots that are new, or were written again since the last build, however old; without any there is nothing to do. Or all anew."""
        source, held = self.tables["ods_product"], self.history
        now = source.manifest()
        last = -1 if full else held.digests.transaction("ods_product")
        before = source.manifest(last) if last in source.versions() else None
        days = [dt.date.fromisoformat(d) for d, parts in now["parts"].items() if d[0].isdigit() and (before is None or before["parts"].get(d) != parts)]
        if last == now["version"] and self.tables["dim_product_scd2"].manifest():
            return {"leaves": 0, "starts": 0}
        if full:
            for t in (held.digests, held.starts):
                if t.manifest():
                    t.truncate()
        done = held.add(self.read("ods_product"), days)
        held.digests.append(held.digests.read().limit(0), ("ods_product", now["version"]))
        history = self.tables["dim_product_scd2"]
        history.replace_all(held.read().filter("product_id IS NOT NULL"))
        self.tables["dim_product"].replace_all(dims.current_from_scd2(history.read()))
        bad = [r["check_name"] for r in checks.history_checks(history.read()).filter("violations > 0").collect()]
        if bad:
            raise incremental.Failed(f"dim_product_scd2: {bad}")
        return done

    def _by_day(self, name: str, computed: DataFrame, first: dt.date, last: dt.date, append: bool, key: str, amount: str) -> None:
        """Write the days of a range, then compare rows, distinct keys and amount of what is held there with what was computed."""
        days = [str(first + i * incremental.DAY) for i in range((last - first).days + 1)]
        if append:
            if not computed.isEmpty():
                self.tables[name].append(computed)
        else:
            self.tables[name].overwrite_partitions(computed, days)
        incremental.verify_written(self.read(name, first, last), computed, key, amount)

    def build_facts(self, lookback: int = 3, first: dt.date | None = None, last: dt.date | None = None, names: Sequence[str] = FACTS, append: bool = False, strict_closure: bool = False, update_time: dt.datetime | None = None) -> tuple[dt.date, dt.date] | None:
        """Detail, wide table and lifecycle of the days that are due, or of an explicit range; `names`: only these. A day without rows is emptied; with `append` rows are added and nothing is removed. The lifecycle is
        made for orders with events in those days, from all their events. Checked after writing: rows, keys and amounts; orders without a valid product version; and by day the closure with raw orders, which is
        a warning in `warnings`, or with strict_closure a failure."""
        if unknown := set(names) - set(FACTS):
            raise incremental.Refused(f"no tables {sorted(unknown)}")
        self.warnings: list[str] = []
        due = incremental.explicit_range(first, last) if first and last else incremental.resolve_range(self._bounds(next((n for n in names if n in TABLES and TABLES[n] == "dt"), "dwd_order_detail"))[1], *self._bounds("ods_order"), lookback)
        if due is None:
            return None
        raw = self.read("ods_order", *due).filter("user_id IS NOT NULL").select("dt", "order_id").distinct()
        for name in ("dwd_order_detail", "dwd_order_sku_detail"):
            if name not in names:
                continue
            if name == "dwd_order_detail":
                self._by_day(name, facts.order_detail(self.read("ods_order", *due)), *due, append, "order_id", "amount")
            else:
                self._by_day(name, facts.version_at(self.read("dwd_order_detail", *due), self.read("dim_product_scd2")), *due, append, "order_id", "amount")
                if n := self.read(name, *due).filter("valid_from IS NULL").count():
                    self.warnings.append(f"{name}: {n} orders without a valid version")
            bad = [str(r["dt"]) for r in recon.closure(raw, self.read(name, *due)).orderBy("dt").limit(10).collect()]
            if bad:
                self.warnings.append(f"{name} doesn't close with raw orders on {bad}")
                if strict_closure:
                    raise incremental.Failed(self.warnings[-1])
        if "dwd_order_lifecycle" in names and self.tables["ods_order_event"].manifest():
            events = self.read("ods_order_event")
            if self.lifecycle.held.manifest() is None:
                self.lifecycle.rebuild(events, update_time)
                scope = events
            else:
                self.lifecycle.advance(events, *due, update_time)
                scope = self.read("ods_order_event", *due)
            wanted = scope.filter("order_id IS NOT NULL").select("order_id").distinct()
            held = self.lifecycle.read().join(wanted, "order_id", "left_semi")
            right = facts.expected_lifecycle(events.join(wanted, "order_id", "left_semi"))
            if wrong := [r["check_name"] for r in checks.lifecycle_checks(held, right).filter("violations > 0 AND check_name IN ('surplus rows', 'missing rows', 'row count', 'order unique', 'stage known')").collect()]:
                raise incremental.Failed(f"dwd_order_lifecycle: {wrong}")
        return due

    def mart_range(self, lookback: int = 3) -> tuple[dt.date, dt.date] | None:
        return incremental.mart_range(self._bounds("dws_user_order_day"), self._bounds("dwd_order_detail"), lookback)

    def build_marts(self, lookback: int = 3, first: dt.date | None = None, last: dt.date | None = None, truncate: bool = False) -> tuple[dt.date, dt.date] | None:
        """Marts of the days that are due, of an explicit range, or of all days after emptying them; the day mart is made from the user mart. Checked after writing: rows and amounts; coverage of the range; both marts as computed anew
        from detail, row by row. Days before the range that a fresh computation would change are counted in `warnings`."""
        if truncate and first:
            raise incremental.Refused("truncate and a range exclude each other")
        self.warnings = []
        source = self._bounds("dwd_order_detail")
        if truncate:
            due = source if source[0] else None
            for n in MARTS:
                if self.tables[n].manifest():
                    self.tables[n].truncate()
        else:
            due = incremental.explicit_range(first, last) if first and last else self.mart_range(lookback)
        if due is None:
            return None
        fresh = facts.user_order_day(self.read("dwd_order_detail", *due))
        self._by_day("dws_user_order_day", fresh, *due, False, "user_id", "paid_amount")
        self._by_day("ads_daily_sales", facts.daily_sales(self.read("dws_user_order_day", *due)), *due, False, "dt", "paid_amount")
        self.check_marts(*due)
        if due[0] > source[0]:
            early = self.read("dwd_order_detail", source[0], due[0] - incremental.DAY)
            drift = incremental.drift_outside(self.read("dws_user_order_day", last=due[0] - incremental.DAY), facts.user_order_day(early), due[0]).count()
            if drift:
                self.warnings.append(f"{drift} rows of user days before {due[0]} would change")
        return due

    def check_marts(self, first: dt.date, last: dt.date) -> None:
        """The marts of a range against detail: coverage, then whole rows both ways."""
        held_days = self._bounds("dwd_order_detail")
        for n in MARTS:
            incremental.coverage_gate(self._bounds(n), max(first, held_days[0]), min(last, held_days[1]))
        fresh = facts.user_order_day(self.read("dwd_order_detail", first, last))
        for n, right in (("dws_user_order_day", fresh), ("ads_daily_sales", facts.daily_sales(fresh))):
            if wrong := recon.symmetric_difference(self.read(n, first, last).select(right.columns), right).count():
                raise incremental.Failed(f"{n}: {wrong} rows differ from detail")

    def gate(self, day: dt.date) -> list[str]:
        """Names of the raw checks that fail for the day; any is an error, as is another number of checks than six. `gate_line` is the result for machines."""
        rows = checks.ods_gate(self.read("ods_order"), self.read("ods_order_event"), day).collect()
        bad = [r["check_name"] for r in rows if not r["ok"]]
        self.gate_line = f"DQC_RESULT|{'BAD' if bad or len(rows) != 6 else 'OK'}|{day}|{len(rows)}|{len(bad)}|{','.join(bad)}"
        if len(rows) != 6:
            raise incremental.Failed(f"{len(rows)} checks in place of 6")
        if bad:
            raise incremental.Failed(f"raw checks failed: {bad}")
        return bad

    def violations(self) -> list[tuple[str, int]]:
        """The checks of dimension, wide table and chain that find something, and how much; empty: all is well."""
        history, detail, sku = self.read("dim_product_scd2"), self.read("dwd_order_detail"), self.read("dwd_order_sku_detail")
        found = checks.dim_checks(history, detail, sku).unionByName(checks.order_checks(self.read("ods_order"), detail, self.read("dws_user_order_day"), self.read("ads_daily_sales")))
        return [(r["check_name"], r["violations"]) for r in found.filter("violations > 0").collect()]

    def recon(self, strict: bool = False, first: dt.date | None = None, last: dt.date | None = None, fast: bool = False, allow_lag: int = 0, baseline: dict[str, int] | None = None) -> list[recon.Check]:
        """The reconciliation of the chain, or of a range of its days, against itself computed anew; fast: without closure. A baseline only holds for whole tables."""
        detail = self.read("dwd_order_detail", first, last)
        user_day = facts.user_order_day(detail)
        held = lambda n: self.read(n, first, last) if self.tables[n].manifest() else None
        whole = first is None and last is None
        life = self.lifecycle.read() if self.lifecycle.held.manifest() else None
        return recon.reconcile(
            self.read("ods_order", first, last), detail, held("dws_user_order_day"), held("ads_daily_sales"), user_day, facts.daily_sales(user_day), strict, allow_lag, fast,
            held("dwd_order_sku_detail"), life, held("ods_order_event"), baseline if whole else None,
        )

    def maintain(self, expire: bool = False, keep: int = 5, names: Sequence[str] | None = None) -> dict[str, dict[str, int]]:
        """Inventory of the tables: versions, files, rows; with expire their old versions are dropped first. An unknown name is an error."""
        if names and (unknown := set(names) - set(self.tables)):
            raise ValueError(f"no tables {sorted(unknown)}")
        out = {}
        for n in names or self.tables:
            t = self.tables[n]
            if t.manifest() is None:
                continue
            before = t.snapshots()[-1]["rows"]
            if expire:
                t.expire(keep)
            s = t.snapshots()
            if s[-1]["rows"] != before or (expire and len(s) > keep + 1):
                raise RuntimeError(f"{n}: expiry changed the table")
            out[n] = {"versions": len(s), "files": len(t.files()), "rows": s[-1]["rows"]}
        return out

    def steps(self) -> list[Step]:
        """The daily run after ingest: gate, dimension, facts, marts, then checks, reconciliation and maintenance side by side; old versions expire on Sundays."""

        def reconciled(_: dt.date) -> int:
            bad = [c.name for c in self.recon() if not c.ok]
            if bad:
                raise incremental.Failed(f"reconciliation failed: {bad}")
            return 0

        def checked(_: dt.date) -> int:
            if found := self.violations():
                raise incremental.Failed(f"checks failed: {found}")
            return 0

        return [
            Step("gate", self.gate), Step("dim", lambda _: self.build_dims(), ["gate"]), Step("facts", lambda _: self.build_facts(), ["dim"]), Step("marts", lambda _: self.build_marts(), ["facts"]),
            Step("checks", checked, ["marts"]), Step("recon", reconciled, ["marts"]), Step("maintain", lambda d: self.maintain(expire=d.weekday() == 6), ["marts"]),
        ]
