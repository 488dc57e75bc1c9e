"""A table of immutable Parquet folders under manifests: atomic replacement of partitions, upsert, time travel, expiry, compaction, backup."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.exprs import fresh

#: Name of the folder level that a partition's value is written under, beside the column itself, and of the partition of a table without partition column.
PART, WHOLE, NULL = "__p", "all", "__null__"


class Conflict(RuntimeError):
    """Another commit came first."""


class Store:
    """The few file operations a table needs, through Hadoop's file system, so that any shared folder will do."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self._conf)
        self.local = self.fs.getUri().getScheme() == "file"

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file in one step; False if it exists already."""
        spare = f"_meta/.{uuid.uuid4().hex}"
        out = self.fs.create(self._path(spare), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if self.local:  # a rename would replace the file here, a link doesn't
                base = self._path("").toUri().getPath()
                try:
                    os.link(f"{base}/{spare}", f"{base}/{name}")
                    return True
                except FileExistsError:
                    return False
            return self.fs.rename(self._path(spare), self._path(name))
        finally:
            self.fs.delete(self._path(spare), False)

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def modified(self, name: str) -> dt.datetime:
        return dt.datetime.fromtimestamp(self.fs.getFileStatus(self._path(name)).getModificationTime() / 1000, dt.UTC)

    def files(self, folder: str) -> list[tuple[str, int]]:
        p = self._path(folder)
        return [(x.getPath().getName(), x.getLen()) for x in self.fs.listStatus(p) if x.getPath().getName().endswith(".parquet")] if self.fs.exists(p) else []


class VersionedTable:
    """Readers see one manifest, so a whole commit or none of it. A commit that was overtaken fails with Conflict and changes nothing."""

    def __init__(self, spark: SparkSession, root: str, partition: str | None = None) -> None:
        self.spark, self.partition, self.store = spark, partition, Store(spark, root)

    # Manifests

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.store.names("_meta") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, Any] | None:
        """That version, or the last; None for a table that has none yet."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else None
        elif version not in known:
            raise ValueError(f"no version {version}")
        return None if version is None else json.loads(self.store.read(f"_meta/v{version:010d}.json"))

    def _commit(self, base: dict[str, Any] | None, parts: Mapping[str, list[dict[str, Any]]], schema: T.StructType, operation: str, txn: Mapping[str, int] | None = None) -> int:
        version = base["version"] + 1 if base else 1
        held = {k: v for k, v in sorted(parts.items()) if v}
        body = {"version": version, "parent": base and base["version"], "at": dt.datetime.now(dt.UTC).isoformat(), "operation": operation, "schema": json.loads(schema.json()), "partition": self.partition, "parts": held, "txn": {**(base["txn"] if base else {}), **(txn or {})}}
        if not self.store.create(f"_meta/v{version:010d}.json", json.dumps(body)):
            raise Conflict(f"version {version} exists")
        return version

    def transaction(self, name: str) -> int:
        """The last batch that writer `name` committed, or -1."""
        m = self.manifest()
        return m["txn"].get(name, -1) if m else -1

    # Reading

    def read(self, version: int | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
        """The rows of a version; with a range of partition values, only those partitions are listed and read."""
        m = self.manifest(version)
        if m is None:
            raise ValueError("the table has no version")
        schema = T.StructType.fromJson(m["schema"])
        inside = lambda v: v == WHOLE or ((first is None or v >= first) and (last is None or v <= last) and (v != NULL or (first is None and last is None)))
        folders = [f"{self.store.root}/{d['dir']}" for v, dirs in m["parts"].items() if inside(v) for d in dirs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def snapshots(self) -> list[dict[str, Any]]:
        """(version, parent, at, operation, partitions, rows) of every version held."""
        out = []
        for v in self.versions():
            m = self.manifest(v)
            out.append({k: m[k] for k in ("version", "parent", "at", "operation")} | {"partitions": len(m["parts"]), "rows": sum(d["rows"] for dirs in m["parts"].values() for d in dirs)})
        return out

    def files(self, version: int | None = None) -> list[dict[str, Any]]:
        """(partition, file, bytes) of a version."""
        m = self.manifest(version)
        return [{"partition": v, "file": f"{d['dir']}/{n}", "bytes": b} for v, dirs in (m["parts"] if m else {}).items() for d in dirs for n, b in self.store.files(d["dir"])]

    def manifests(self) -> list[dict[str, Any]]:
        """(version, bytes, partitions, folders) of every manifest. Each is complete, so none has to be merged or rewritten."""
        out = []
        for v in self.versions():
            text = self.store.read(f"_meta/v{v:010d}.json")
            parts = json.loads(text)["parts"]
            out.append({"version": v, "bytes": len(text.encode()), "partitions": len(parts), "folders": sum(map(len, parts.values()))})
        return out

    def refresh(self) -> None:
        """Let the session forget what it cached of the table's files and rows; for tables that another session writes."""
        self.spark.catalog.refreshByPath(self.store.root)

    # Writing

    def _value(self) -> Column:
        return F.coalesce(F.col(self.partition).cast("string"), F.lit(NULL)) if self.partition else F.lit(WHOLE)

    def _write(self, df: DataFrame) -> dict[str, list[dict[str, Any]]]:
        """Write a new folder per partition value; nobody sees it before a commit. Rows are brought together by partition only if there are partitions."""
        folder = f"data/{uuid.uuid4().hex}"
        out = df.withColumn(PART, self._value())
        if self.partition:
            # rebalance: a task or more for each day, as its size asks for, instead of one file per task and day
            out = out.hint("rebalance", PART)
        out.write.partitionBy(PART).parquet(f"{self.store.root}/{folder}")
        written = [n for n in self.store.names(folder) if n.startswith(f"{PART}=")]
        if not written:
            return {}
        counted = self.spark.read.schema(T.StructType([T.StructField(PART, T.StringType())])).parquet(f"{self.store.root}/{folder}").groupBy(PART).count().collect()
        rows = {r[0]: r[1] for r in counted}
        return {n.split("=", 1)[1]: [{"dir": f"{folder}/{n}", "rows": rows[n.split("=", 1)[1]]}] for n in written}

    def append(self, df: DataFrame, txn: tuple[str, int] | None = None) -> int:
        """Add rows. With txn (writer, batch) a batch that was committed before is left out: the present version is returned."""
        if txn and self.transaction(txn[0]) >= txn[1]:
            return self.manifest()["version"]
        base, new = self.manifest(), self._write(df)
        parts = {k: list(v) for k, v in (base["parts"] if base else {}).items()}
        for k, v in new.items():
            parts[k] = parts.get(k, []) + v
        return self._commit(base, parts, df.schema, "append", dict([txn]) if txn else None)

    def overwrite_partitions(self, df: DataFrame, partitions: Iterable[str], txn: tuple[str, int] | None = None) -> int:
        """Replace just these partitions. One for which df has no rows is empty afterwards; rows of another partition are an error."""
        if txn and self.transaction(txn[0]) >= txn[1]:
            return self.manifest()["version"]
        wanted = {str(p) for p in partitions}
        base, new = self.manifest(), self._write(df)
        if stray := set(new) - wanted:
            raise ValueError(f"rows outside the partitions to replace: {sorted(stray)[:5]}")
        parts = {k: v for k, v in (base["parts"] if base else {}).items() if k not in wanted}
        return self._commit(base, parts | new, df.schema, "overwrite", dict([txn]) if txn else None)

    def replace_all(self, df: DataFrame) -> int:
        base = self.manifest()
        return self._commit(base, self._write(df), df.schema, "replace")

    def truncate(self) -> int:
        base = self.manifest()
        return self._commit(base, {}, T.StructType.fromJson(base["schema"]), "truncate")

    def drop_partitions(self, keep: Callable[[str], bool]) -> int:
        """Leave out whole partitions whose value `keep` refuses; no file is read."""
        base = self.manifest()
        return self._commit(base, {k: v for k, v in base["parts"].items() if keep(k)}, T.StructType.fromJson(base["schema"]), "drop")

    def _rewrite(self, touched: set[str], change: Callable[[DataFrame], DataFrame], operation: str, more: DataFrame | None = None) -> int:
        base = self.manifest()
        schema = T.StructType.fromJson(base["schema"])
        folders = [f"{self.store.root}/{d['dir']}" for k in touched for d in base["parts"].get(k, [])]
        old = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        df = change(old).select(schema.names)
        if more is not None:
            df = df.unionByName(more.select(schema.names))
        new = self._write(df)
        parts = {k: v for k, v in base["parts"].items() if k not in touched}
        for k, v in new.items():
            parts[k] = parts.get(k, []) + v
        return self._commit(base, parts, schema, operation)

    def _touched(self, rows: DataFrame) -> set[str]:
        """Partition values of the rows, as many as there are partitions at most."""
        return {r[0] for r in rows.select(self._value()).distinct().collect()}

    def upsert(self, df: DataFrame, keys: Sequence[str]) -> int:
        """Rows replace those with the same keys (null-safe), wherever these are; others are added. Of several new rows with the same keys the largest is taken. Only partitions that hold such keys or get rows are rewritten."""
        if self.manifest() is None:
            return self.append(_one_per(df, keys))
        new = _one_per(df, keys)
        held = self.read()
        hit = _matching(held, new, keys, "left_semi")
        touched = self._touched(hit) | self._touched(new)
        return self._rewrite(touched, lambda old: _matching(old, new, keys, "left_anti"), "upsert", new)

    def delete_where(self, condition: Column) -> int:
        """Rows for which the condition is true go; only partitions with such rows are rewritten."""
        touched = self._touched(self.read().filter(condition))
        return self._rewrite(touched, lambda old: old.filter(~F.coalesce(condition, F.lit(False))), "delete") if touched else self.manifest()["version"]

    def delete_keys(self, df: DataFrame, keys: Sequence[str]) -> int:
        touched = self._touched(_matching(self.read(), df, keys, "left_semi"))
        return self._rewrite(touched, lambda old: _matching(old, df, keys, "left_anti"), "delete keys") if touched else self.manifest()["version"]

    def replace_keys(self, keyed: DataFrame, keys: Sequence[str], rows: DataFrame) -> int:
        """Rows with these keys go and `rows` come in their place, in one commit; only partitions that hold such keys or get rows are rewritten."""
        touched = self._touched(_matching(self.read(), keyed, keys, "left_semi")) | self._touched(rows)
        return self._rewrite(touched, lambda old: _matching(old, keyed, keys, "left_anti"), "replace keys", rows)

    def update_where(self, condition: Column, values: Mapping[str, Column]) -> int:
        """Set columns of the rows for which the condition is true."""
        if self.partition in values:
            raise ValueError("the partition column can't be set")
        touched = self._touched(self.read().filter(condition))
        kinds = {f.name: f.dataType for f in T.StructType.fromJson(self.manifest()["schema"]).fields}
        sets = {c: F.when(condition, v).otherwise(F.col(c)).cast(kinds[c]) for c, v in values.items()}
        return self._rewrite(touched, lambda old: old.withColumns(sets), "update") if touched else self.manifest()["version"]

    # Maintenance

    def compact(self, min_files: int = 4, target_bytes: int = 128 << 20) -> int:
        """Rewrite partitions of at least `min_files` files into as few files as their bytes need; rows stay as they are."""
        per: dict[str, list[int]] = {}
        for f in self.files():
            per.setdefault(f["partition"], []).append(f["bytes"])
        todo = {k: max(1, -(-sum(b) // target_bytes)) for k, b in per.items() if len(b) >= min_files and len(b) > -(-sum(b) // target_bytes)}
        base = self.manifest()
        if not todo:
            return base["version"]
        schema = T.StructType.fromJson(base["schema"])
        parts = dict(base["parts"])
        for k, n in todo.items():
            folder = f"data/{uuid.uuid4().hex}"
            self.spark.read.schema(schema).parquet(*[f"{self.store.root}/{d['dir']}" for d in parts[k]]).repartition(n).write.parquet(f"{self.store.root}/{folder}")
            parts[k] = [{"dir": folder, "rows": sum(d["rows"] for d in parts[k])}]
        return self._commit(base, parts, schema, "compact")

    def expire(self, retain_last: int = 5, older_than: dt.datetime | None = None, grace: dt.timedelta = dt.timedelta(hours=24)) -> list[int]:
        """Drop versions beyond the last `retain_last`, of these only those before `older_than`, then all data that no version holds and that is older than `grace`, in which a writer may still be at work. The present rows don't change."""
        if retain_last < 1:
            raise ValueError("the present version can't expire")
        known = self.versions()
        gone = [v for v in known[:-retain_last] if older_than is None or dt.datetime.fromisoformat(self.manifest(v)["at"]) < older_than]
        for v in gone:
            self.store.remove(f"_meta/v{v:010d}.json")
        held = {d["dir"].split("/")[1] for v in self.versions() for dirs in self.manifest(v)["parts"].values() for d in dirs}
        now = dt.datetime.now(dt.UTC)
        for folder in self.store.names("data"):
            if folder not in held and now - self.store.modified(f"data/{folder}") >= grace:
                self.store.remove(f"data/{folder}")
        return gone


def _one_per(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(*rest, F.lit(0).alias("__z"))).alias("__r")).select(*[F.col(c) if c in keys else F.col(f"__r.`{c}`").alias(c) for c in df.columns])


def _matching(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join on keys in which null equals null."""
    names = {k: fresh(rows.columns, f"__m_{k}") for k in keys}
    other = keyed.select(*[F.col(k).alias(n) for k, n in names.items()]).distinct()
    on = None
    for k, n in names.items():
        c = rows[k].eqNullSafe(other[n])
        on = c if on is None else on & c
    return rows.join(other, on, how)


def checksums(root: str) -> dict[str, str]:
    """sha256 of every file of a local table folder."""
    out = {}
    for at, _, names in os.walk(root):
        for n in names:
            if not n.endswith(".crc"):
                digest = hashlib.sha256()
                with open(os.path.join(at, n), "rb") as f:
                    while block := f.read(1 << 20):
                        digest.update(block)
                out[os.path.relpath(os.path.join(at, n), root)] = digest.hexdigest()
    return out


def backup(root: str, to: str) -> dict[str, str]:
    """Copy a local table folder and write its checksums beside the copy."""
    shutil.copytree(root, to)
    sums = checksums(to)
    with open(f"{to}.sha256.json", "w") as f:
        json.dump(sums, f, sort_keys=True)
    return sums


def verify_backup(to: str) -> list[str]:
    """Files of a backup that are missing, surplus or differ."""
    with open(f"{to}.sha256.json") as f:
        wanted = json.load(f)
    got = checksums(to)
    return sorted(k for k in wanted.keys() | got.keys() if wanted.get(k) != got.get(k))


def restore(copy: str, root: str) -> None:
    """Put a verified backup in place of a table folder; the folder that was there stays aside until the copy is complete."""
    if bad := verify_backup(copy):
        raise ValueError(f"the backup is damaged: {bad[:5]}")
    spare = f"{root}.restoring"
    shutil.copytree(copy, spare)
    if os.path.exists(root):
        os.rename(root, f"{root}.old")
    os.rename(spare, root)
    shutil.rmtree(f"{root}.old", ignore_errors=True)


def shared_checksums(spark: SparkSession, root: str) -> DataFrame:
    """(file, sha256) of every file of a table folder on any file system, by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{root}/_meta", f"{root}/data"])
    plain = root.split(":", 1)[-1].lstrip("/")
    return files.select(F.element_at(F.split("path", plain + "/", 2), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def shared_backup(spark: SparkSession, root: str, to: str) -> int:
    """Copy a table folder on any file system, and write the checksums of the source beside the copy; the number of files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(root), jvm.org.apache.hadoop.fs.Path(to)
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf):
        raise OSError(f"{root} wasn't copied")
    shared_checksums(spark, root).write.mode("overwrite").parquet(f"{to}.sha256")
    return spark.read.parquet(f"{to}.sha256").count()


def shared_verify(spark: SparkSession, to: str) -> DataFrame:
    """(file, why) of a copy: missing, surplus, differs."""
    wanted = spark.read.parquet(f"{to}.sha256").select("file", F.col("sha256").alias("w"))
    got = shared_checksums(spark, to).select("file", F.col("sha256").alias("g"))
    return wanted.join(got, "file", "full").filter(~F.col("w").eqNullSafe(F.col("g"))).select("file", F.when(F.col("g").isNull(), "missing").when(F.col("w").isNull(), "surplus").otherwise("differs").alias("why"))
