"""Session helpers: the Spark session used by tests and benches, and scratch tables that cut lineage.

Scratch tables live in the shared folder that ``spark.checkpoint.dir`` names. They are plain Parquet, so
they survive the loss of any executor and are read back with column pruning. Only where the setting is
absent (tests and single-machine runs) does the helper choose a folder itself.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "12g", **conf: str) -> SparkSession:
    """A ``local[cpus]`` session with the settings that the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loamdex")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that tasks can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="loamdex-code-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "loamdex_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for here, _, names in os.walk(home):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(here, n)
                    z.write(full, os.path.join("loamdex", os.path.relpath(full, home)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if it comes in fewer.

    A table in one small file is read by one task whatever is computed on it. Such a table is at most a few scan
    partitions, so moving it is cheap; a table that fills the cluster is left as it is and nothing is moved."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df  # it ends in a shuffle's partitions, and asking for their number would run it
    if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 > n:
        return df
    return df.repartition(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder for scratch tables: ``spark.checkpoint.dir`` of the session, a temporary one only in local mode."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d.rstrip("/")
    global _own
    if _own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own = tempfile.mkdtemp(prefix="loamdex-")
        atexit.register(shutil.rmtree, _own, True)
    return "file://" + _own


_own: str | None = None


class Scratch:
    """Tables written once and read again. ``keep`` replaces checkpoint(): one pass, columnar, droppable."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}
        _open.setdefault(spark.sparkContext.applicationId, []).append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the table read back; its lineage starts at the written files."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_owner = self  # keeps id(out) valid for drop()
        return out

    def drop(self, *dfs: DataFrame | None) -> None:
        """Delete tables that no later step reads."""
        for df in dfs:
            path = self.paths.pop(id(df), None) if df is not None else None
            if path:
                self._delete(path)

    def close(self) -> None:
        """Delete all that is left of this scratch."""
        self.paths.clear()
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        hp = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hp.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hp, True)


def close_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables of all queries so far of this session, once their results have been written; returns
    how many scratches there were. Results that are still to be computed read them, so a query can't do it itself."""
    n = 0
    for s in _open.pop(spark.sparkContext.applicationId, []):
        s.close()
        n += 1
    return n


_open: dict[str, list[Scratch]] = {}


@atexit.register
def _sweep() -> None:
    """At the end of the program what is left goes, if the session still answers."""
    for many in list(_open.values()):
        for s in many:
            try:
                s.close()
            except Exception:  # noqa: BLE001 the session may be gone
                return
