"""A versioned index of Parquet tables with an atomic pointer: a version becomes visible when it is complete.

Everything goes through the Hadoop file system of the home folder, so an index lies where all executors see it."""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.1"
#: Environment variables that name the data home, the first one set holds.
HOME_VARIABLES = ("LOAMDEX_DATA_HOME", "LOAMDEX_PLUGIN_DATA")


class SchemaMismatch(RuntimeError):
    """The index has no readable metadata or those of another schema version."""


def data_home(env: dict[str, str] | None = None, platform: str = sys.platform) -> str:
    """Folder of all indexes: a variable of HOME_VARIABLES, else the platform's folder for application data."""
    env = dict(os.environ) if env is None else env
    named = next((env[v] for v in HOME_VARIABLES if env.get(v)), None)
    if named:
        return named
    home = env.get("HOME") or env.get("USERPROFILE") or os.path.expanduser("~")
    if platform == "darwin":
        base = os.path.join(home, "Library", "Application Support")
    elif platform.startswith("win"):
        base = env.get("LOCALAPPDATA") or os.path.join(home, "AppData", "Local")
    else:
        base = env.get("XDG_DATA_HOME") or os.path.join(home, ".local", "share")
    return os.path.join(base, "loamdex")


class Files:
    """What an index needs of the Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        self.Path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(root).getFileSystem(self.conf)
        # The checksum layer of local disks keeps a file beside each file, which a replaced pointer would leave stale.
        if hasattr(self.fs, "setWriteChecksum") and root.split(":")[0] not in ("hdfs", "s3a"):
            try:
                self.fs.setWriteChecksum(False)
                self.fs.setVerifyChecksum(False)
            except Exception:  # noqa: BLE001 a file system without checksums
                pass

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.Path(path))

    def read(self, path: str) -> str:
        with_ = self.fs.open(self.Path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(with_, "UTF-8")
        finally:
            with_.close()

    def folders(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.Path(path)) if s.isDirectory())

    def sizes(self, path: str) -> list[tuple[str, int, int]]:
        """(name, length, modification time) of a file or of the files of a folder."""
        if not self.exists(path):
            return []
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in self.fs.listStatus(self.Path(path)))

    def replace(self, path: str, text: str) -> None:
        """Write a file so that readers see the old or the new one."""
        tmp = f"{path}.{uuid.uuid4().hex}"
        out = self.fs.create(self.Path(tmp), True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        to = self.fs.makeQualified(self.Path(path))
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.conf).rename(self.fs.makeQualified(self.Path(tmp)), to, how)

    def delete(self, path: str) -> None:
        self.fs.delete(self.Path(path), True)


class Catalog:
    """Indexes by name under one folder. Each write goes to a new version folder; the pointer file is replaced only
    when all tables are written, so a failed write leaves the old version in place. A table given with a key is
    laid in ``buckets`` folders by the hash of the key and sorted by it in its files, so a reader of some keys opens
    their folders only, and in them the row groups that may hold them."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home, self.files = spark, home.rstrip("/"), Files(spark, home)

    def _pointer(self, name: str) -> str:
        return f"{self.home}/{name}/CURRENT"

    def names(self) -> list[str]:
        return [n for n in self.files.folders(self.home) if self.files.exists(self._pointer(n))]

    def info(self, name: str) -> dict:
        try:
            meta = json.loads(self.files.read(self._pointer(name)))
        except Exception as e:  # noqa: BLE001 a missing file is an error of the JVM
            raise SchemaMismatch(f"{name}: unreadable") from e
        if meta.get("schema_version") != SCHEMA_VERSION:
            raise SchemaMismatch(f"{name}: schema {meta.get('schema_version')}, expected {SCHEMA_VERSION}")
        return meta

    def listing(self) -> DataFrame:
        """(name, version, schema_version, state) of every index; state tells what cannot be read."""
        rows = []
        for n in self.names():
            try:
                m = self.info(n)
                rows.append((n, m["version"], m["schema_version"], "ok"))
            except SchemaMismatch as e:
                rows.append((n, None, None, str(e).split(": ", 1)[1]))
        return self.spark.createDataFrame(rows, "name string, version long, schema_version string, state string")

    def write(
        self, name: str, tables: dict[str, DataFrame], meta: dict | None = None, partition: dict[str, list[str]] | None = None, keys: dict[str, str] | None = None, buckets: int = 16
    ) -> dict:
        """Write all tables as the next version and switch to it; tables not given are carried over unchanged."""
        try:
            old = self.info(name)
        except SchemaMismatch:
            old = {"version": 0, "tables": {}, "keys": {}}
        version = old["version"] + 1
        base = f"{self.home}/{name}/v{version}"
        self.files.delete(base)
        where, laid = dict(old["tables"]), dict(old.get("keys", {}))
        for t, df in tables.items():
            laid.pop(t, None)
            by = (partition or {}).get(t, [])
            if keys and t in keys:
                laid[t] = [keys[t], buckets]
                # A hot key may be of any size: its rows are spread within the bucket by their own hash.
                df = df.withColumn("bucket", bucket(F.col(keys[t]), buckets))
                rest = [c for c in df.columns if c not in (keys[t], "bucket") and "map" not in dict(df.dtypes)[c]]
                parts = self.spark.sparkContext.defaultParallelism
                df = df.repartition(max(parts, buckets), "bucket", F.pmod(F.xxhash64(*rest), F.lit(max(1, parts // buckets))) if rest else F.lit(0))
                df, by = df.sortWithinPartitions("bucket", keys[t]), ["bucket"]
            w = df.write.mode("overwrite")
            (w.partitionBy(*by) if by else w).parquet(f"{base}/{t}")
            where[t] = f"v{version}/{t}"
        out = {"schema_version": SCHEMA_VERSION, "version": version, "tables": where, "keys": laid, "written_at": int(time.time()), **(meta or {})}
        self.files.replace(self._pointer(name), json.dumps(out, sort_keys=True))
        return out

    def read(self, name: str, table: str, keys: list | None = None) -> DataFrame:
        """A table, or of a table laid by a key the rows of some keys, by filters that reach the scan."""
        meta = self.info(name)
        df = self.spark.read.parquet(f"{self.home}/{name}/{meta['tables'][table]}")
        if table not in meta.get("keys", {}):
            return df
        col, n = meta["keys"][table]
        if keys is not None:
            kind = dict(df.dtypes)[col]
            if not keys:
                return df.drop("bucket").limit(0)
            df = df.filter(F.col("bucket").isin(sorted({bucket_of(k, kind, n) for k in keys})) & F.col(col).isin(list(keys)))
        return df.drop("bucket")

    def vacuum(self, name: str) -> list[str]:
        """Delete versions that the pointer doesn't name any more; returns what was deleted."""
        live = {p.split("/")[0] for p in self.info(name)["tables"].values()}
        gone = [v for v in self.files.folders(f"{self.home}/{name}") if v.startswith("v") and v not in live]
        for v in gone:
            self.files.delete(f"{self.home}/{name}/{v}")
        return gone


def bucket_of(key: int | str, kind: str, n: int) -> int:
    """:func:`bucket` of one key of a column of type string, bigint or int, without a job."""
    raw = key.encode("utf-8") if kind == "string" else int(key).to_bytes(8 if kind == "bigint" else 4, "little", signed=True)
    h = xxhash.xxh64_intdigest(raw, 42)
    return (h - (1 << 64) if h >> 63 else h) % n


def bucket(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
