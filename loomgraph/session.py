"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(cpus: int = 8, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("loomgraph")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent (tests, a single machine) is a temporary
    folder made; it is removed when the process ends.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="loomgraph-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of executors, and its true size is known
    to the planner when it is read again. ``drop`` removes a table that a
    later round has replaced; whatever is left goes with the process.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/loomgraph-{uuid.uuid4().hex}"
        self._count = 0
        atexit.register(self._delete, self.base)

    def write(self, df: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.base}/{self._count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def counted(self, df: DataFrame, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
        """A written table and its number of rows, ``rows``, with more aggregates; all taken while it is written."""
        seen = Observation()
        out = self.write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(name) for name, m in measures.items()]))
        found = seen.get
        if "rows" not in found:  # a plan that was replaced by an empty one reports nothing
            found = out.agg(F.count(F.lit(1)).alias("rows"), *[m.alias(name) for name, m in measures.items()]).first().asDict()
        return out, {name: value or 0 for name, value in found.items()}

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """Written tables of one schema as a single scan."""
        return self.spark.read.schema(tables[0].schema).parquet(*[t._scratch for t in tables])

    def drop(self, df: DataFrame | None) -> None:
        if df is not None and getattr(df, "_scratch", None):
            self._delete(df._scratch)

    def _delete(self, path: str) -> None:
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # the session may be gone by then
            if path.startswith("file:"):
                path = path[5:]
            shutil.rmtree(path, ignore_errors=True)
