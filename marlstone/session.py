"""Session settings that the plans of this package expect."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[8]", app: str = "marlstone", partitions: int = 8, **more: str) -> SparkSession:
    """A session with UTC times and adaptive execution; ``more`` overrides any setting."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false"} | more
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    In local mode a local folder is set where none is named. On a cluster a local folder would lose rows, so
    a session that names none raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "/tmp/marlstone-checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return path
