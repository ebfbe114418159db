"""Session helpers: building a session for tests/bench, and intermediate
tables on shared storage.

Library code never invents storage on a cluster: lineage is cut with written
tables, or ``DataFrame.checkpoint()``, in the folder the cluster names in
``spark.checkpoint.dir``.  Only a local-mode session without that setting
(tests, notebooks) gets a private temporary folder.  Everything written lies
below one folder per application, which ``release_scratch`` deletes.

Join sides are never hinted: Spark and AQE choose a broadcast by measured
bytes (``spark.sql.autoBroadcastJoinThreshold``).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def build_session(
    app: str = "ecotally",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    """Session for tests, the bench and local runs (a cluster brings its own)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app)
        .master(master or f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
        # let AQE coalesce the shuffles of plans that are being cached too
        .config("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    Order: a directory already set on the context, then ``spark.checkpoint.dir``
    from the session conf, then (local master only) a fresh temporary folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the context
        conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        if conf_dir:
            return conf_dir
        raise RuntimeError("spark.checkpoint.dir is not set on the server") from None
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a folder every executor "
            "can reach (e.g. on the cluster's shared file system)"
        )
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="ecotally-ckpt-"))
    return sc.getCheckpointDir()


def _scratch_root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table, below the application's scratch folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system Spark writes it with."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def release_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application.

    Results read them until they are consumed, so call it when those are done:
    at the end of a job, or between requests of a long-lived session.
    """
    delete_path(spark, _scratch_root(spark))


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the shared checkpoint folder and cut its lineage.

    Survives executor loss (unlike a local checkpoint) and keeps the output
    partitioning, so a following join or aggregate on the same keys does not
    shuffle again.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
