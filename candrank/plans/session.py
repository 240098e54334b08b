"""Session settings the jobs are tuned for; a cluster's own session works as well."""

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "candrank", memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # A repeated key in an answer keeps its last value instead of failing the parse.
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .getOrCreate()
    )
