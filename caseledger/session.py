"""Session settings and lineage cutting."""

import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even when that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the jobs rely on. Safe on a shared session."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    # A local session left at the cluster default would cut small tables into 200 pieces.
    context = spark.sparkContext
    if context.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(context.defaultParallelism))
    return spark


def local_session(cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("caseledger")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of the application, once, so that they find it wherever they run.

    It goes as an archive through the shared folder.
    """
    context = spark.sparkContext
    if _SHIPPED.get("application") != context.applicationId:
        root, packed = Path(__file__).resolve().parent, io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        at = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/code-{uuid.uuid4().hex}/{root.name}.zip")
        stream = at.getFileSystem(context._jsc.hadoopConfiguration()).create(at, False)
        stream.write(bytearray(packed.getvalue()))
        stream.close()
        context.addPyFile(at.toString())
        _SHIPPED["application"] = context.applicationId
    return spark


_SHIPPED: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    A folder of our own stands in only where everything runs in one process, as in tests.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="run-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder of the cluster, so that a lost executor costs little."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder as Parquet and read again: what follows reads the columns it needs."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly over as many tasks as a shuffle has, at least one a core.

    For work that is heavy per row, before it: a Parquet file is read by one task for each of its row groups, which may hold a million rows.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
