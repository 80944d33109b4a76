"""Session defaults, the shared working folder and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_OPEN_SCOPES: list[list[str]] = []


def build_session(app: str = "vetlake", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings every operator assumes (UTC, AQE, Arrow)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # session aggregates combine before the shuffle, so a hot key sends few rows per task
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoint files go when the frame that reads them is collected
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A private temporary folder stands in only where driver and executors are one process
    (``local[*]``, as in tests).  On a cluster without the setting this is an error: files in a
    machine's own folder are lost with the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="vetlake-ckpt-")
    return _LOCAL_DIRS[app]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point reliable checkpoints at the shared folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike localCheckpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Like a checkpoint it survives lost executors and cuts lineage; unlike one it is compressed,
    column-pruned when read, and its size is known to the planner, which therefore broadcasts it
    only below the session's threshold.  Several readers do not repeat the work above it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _OPEN_SCOPES:
        _OPEN_SCOPES[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(staged: DataFrame) -> None:
    """Delete one staged table when nothing reads it any more."""
    spark = staged.sparkSession
    root = f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}/"
    for folder in {f.rpartition("/")[0] for f in staged.inputFiles()}:
        if root in folder:
            _delete(spark, folder)


def stage_result(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stage what ``build`` returns and delete the tables that it staged on the way.

    The result no longer reads them.  A failed build leaves its tables to ``drop_staged``.  For one driver thread at a time.
    """
    made: list[str] = []
    _OPEN_SCOPES.append(made)
    try:
        out = stage_table(build(), name)
    finally:
        _OPEN_SCOPES.pop()
    for folder in made[:-1]:
        _delete(spark, folder)
    if _OPEN_SCOPES:
        _OPEN_SCOPES[-1].append(made[-1])
    return out


def drop_staged(spark: SparkSession) -> None:
    """Delete every staged table of this application (call it when results have been written)."""
    _delete(spark, f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}")
