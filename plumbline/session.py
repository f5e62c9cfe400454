"""Session helpers: a local session for tests, and durable lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

BLOCK_ROWS_CONF = "spark.plumbline.blockRows"
DEFAULT_BLOCK_ROWS = 1_000_000


def local_session(cores: str | int = "*", app: str = "plumbline", **conf: str) -> SparkSession:
    """A session for one machine (tests, benchmark).  Clusters bring their own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def block_rows(spark: SparkSession, override: int | None = None) -> int:
    """Rows per block: the most rows of one series that a single task may order."""
    rows = int(override or spark.conf.get(BLOCK_ROWS_CONF, str(DEFAULT_BLOCK_ROWS)))
    if rows < 1:
        raise ValueError(f"block rows must be positive, got {rows}")
    return rows


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only a
    local session without that setting gets a folder of its own: executors of a
    cluster could not read each other's files in it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="plumbline-")
        sc.setCheckpointDir(shared)
    return df.checkpoint()
