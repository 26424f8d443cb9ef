"""Session helpers: building a local session for tests, the shared checkpoint
folder, and size-checked broadcast."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows above which a side that is "usually small" is not broadcast; beyond it
# the join falls back to a shuffle join (and AQE may still broadcast it when
# the runtime size turns out small).
DEFAULT_BROADCAST_ROWS = 2_000_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "stoich") -> SparkSession:
    """A local session configured like the tests and the bench use it."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared folder and is used as is.  Only
    where it is unset and the master is local (tests) a scratch folder is
    created and set; with any other master an unset folder is an error, since
    a machine's own folder is not shared.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="stoich-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table over the cores if it has fewer files than
    cores: a file of one row group is one task otherwise.  Larger inputs are
    returned as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


_WRITTEN: list[str] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder
    and read it back.

    Like a reliable checkpoint it survives executor loss (unlike a local
    checkpoint) and cuts the lineage; unlike ``Dataset.checkpoint`` the
    re-read relation carries its real size, so the optimiser's size
    estimates do not compound over iterations (a checkpointed plan keeps the
    estimate of the plan it came from, and products of those estimates over
    many joined generations become astronomically large).  The tables stay
    until :func:`remove_tables` is called: later plans read them."""
    import uuid
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_tables() -> list[str]:
    """Folders of the tables written by :func:`cut_lineage` and not removed."""
    return list(_WRITTEN)


def remove_tables(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete tables written by :func:`cut_lineage` (all by default), once no
    DataFrame that reads them is needed any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in written_tables() if paths is None else paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if p in _WRITTEN:
            _WRITTEN.remove(p)


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only if it provably has at most ``max_rows`` rows.

    The table is written once and its rows are counted there, so the plan
    behind it runs once, not once for the count and once for the join.  Beyond
    the bound the written table is returned as is and the planner uses a
    shuffle join instead.
    """
    table = cut_lineage(df)
    return F.broadcast(table) if table.limit(max_rows + 1).count() <= max_rows else table
