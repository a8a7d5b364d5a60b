"""Session helpers: a tuned SparkSession, and lineage cuts on shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "siltstone", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC time.

    Shuffle parallelism is left to adaptive execution: on a cluster pass a high
    ``spark.sql.shuffle.partitions`` and let it coalesce; locally pass a low one.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings: dict[str, object] = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession | None) -> None:
    """Cut Arrow batches by bytes: pages, term lists and packed vectors are large, and a batch stands in memory several times.

    This sets ``spark.sql.execution.arrow.maxBytesPerBatch`` of the session.
    """
    if spark is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting gets a
    temporary folder of its own; elsewhere executors would not see each other's files, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a shared folder; {master} has no common local one")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-"))
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/siltstone/{name}-{uuid.uuid4().hex}"


class Scope:
    """Owns the folders written inside a ``with scratch()`` block and removes them at its end.

    What leaves the block must have been handed to ``keep``; its folder then belongs to the block around,
    or to nobody if there is none.
    """

    def __init__(self) -> None:
        self.owned: dict[str, SparkSession] = {}
        self.kept: dict[str, SparkSession] = {}

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        """``df`` as a written table that outlives the block; one that `materialise` wrote here is taken as it is."""
        folder = getattr(df, "_folder", None)
        if folder not in self.owned:
            df = materialise(df, name)
            folder = df._folder
        self.kept[folder] = self.owned.pop(folder)
        return df

    def drop(self, *dfs: DataFrame) -> None:
        """Remove tables that nothing reads any more before the block ends (a loop's round before last)."""
        for df in dfs:
            folder = getattr(df, "_folder", None)
            if folder in self.owned:
                _remove(self.owned.pop(folder), folder)


_SCOPES: ContextVar[tuple[Scope, ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch() -> Iterator[Scope]:
    """A block whose written tables go when it ends, also when it fails."""
    scope = Scope()
    token = _SCOPES.set((*_SCOPES.get(), scope))
    try:
        yield scope
    finally:
        _SCOPES.reset(token)
        for folder, spark in scope.owned.items():
            _remove(spark, folder)
        if outer := _SCOPES.get():
            outer[-1].owned.update(scope.kept)


def _remove(spark: SparkSession, folder: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_table_name(folder)}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _table_name(folder: str) -> str:
    return "scratch_" + folder.rsplit("-", 1)[-1]


def materialise(df: DataFrame, name: str = "step", buckets: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches of a plan read the same expensive result, or where an
    iteration would otherwise grow its lineage. The table is on shared storage, so it
    outlives any executor; as Parquet it keeps column pruning and filter pushdown for
    every branch that reads it. With ``buckets`` rows are laid out by a hash of those columns in as
    many files as there are shuffle partitions: joins on them move only the other side. Inside a
    ``scratch()`` block the folder goes with the block.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    if buckets:
        number = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.mode("error").format("parquet").option("path", path).bucketBy(number, *buckets).saveAsTable(_table_name(path))
        written = spark.table(_table_name(path))
    else:
        df.write.mode("error").parquet(path)
        written = spark.read.schema(df.schema).parquet(path)
    written._folder = path
    if scopes := _SCOPES.get():
        scopes[-1].owned[path] = spark
    return written
