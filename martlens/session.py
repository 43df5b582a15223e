"""Session helpers: one place that knows how a martlens job configures Spark.

Cluster settings (executor sizing, shuffle service, checkpoint folder) belong to
whoever launches the job; the helpers here only fill in what is unset so the same
code runs in local tests and on a cluster.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every martlens job relies on. AQE re-plans joins from runtime sizes
# (sort-merge -> broadcast when a side turns out small), coalesces tiny shuffle
# partitions and splits skewed ones; the session time zone is pinned so that
# date/timestamp arithmetic never depends on the host.
DEFAULT_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def _heap() -> str:
    """A heap for a local session: 40 % of the machine's memory, so Python workers have room beside it."""
    whole = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") >> 20
    return f"{min(12_288, max(1024, whole * 2 // 5))}m"


def get_spark(app: str = "martlens", cpus: int | str = "*", shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the launcher's session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or (8 if cpus == "*" else int(cpus)))
    conf.setdefault("spark.driver.memory", os.environ.get("MARTLENS_DRIVER_MEMORY", _heap()))
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session has no SparkContext
        return None


def app_key(spark: SparkSession) -> str:
    """Identifier of the running application, for per-application memos."""
    sc = _context(spark)
    return sc.applicationId if sc is not None else (spark.conf.get("spark.app.id", None) or str(id(spark)))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared filesystem folder and is
    used as is; a cluster session without it is refused. Only a local session (a
    test, a local bench) gets a fresh temporary folder.
    """
    sc = _context(spark)
    current = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc is not None else None)
    if current:
        if sc is not None and sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    if sc is not None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="martlens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    if sc is not None:
        sc.setCheckpointDir(local)
    return local


def apply_job_conf(spark: SparkSession) -> None:
    """Set the martlens SQL settings on an existing session (driver-provided sessions)."""
    for key in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
                "spark.sql.adaptive.coalescePartitions.enabled"):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, DEFAULT_CONF[key])
