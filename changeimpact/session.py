"""Session settings the jobs rely on, and the one way they cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "8", app: str = "changeimpact") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .getOrCreate()
    )


def literal_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small table given in the program, as a VALUES relation whose size the planner knows."""
    names = [field.split()[0] for field in schema.split(",")]
    types = [field.split()[1] for field in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)

    def written(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            # "$" is written as an escape, or SQL variable substitution would eat "${...}".
            escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024")
            return f"'{escaped}'"
        return str(value)

    values = ", ".join("(" + ", ".join(written(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types))
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(names)})")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one is used only where
    none is set in local mode (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="changeimpact-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
