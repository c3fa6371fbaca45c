"""Session settings, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Tables that the driver lays out as one parquet file (or folder) each.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "files corpus_files corpus_sources source_findings downstream_findings pr_status "
    "bug_history eval_items license_refs"
).split()

_shipped: set[str] = set()


def local_session(app: str = "tracewright", cores: int | str = "*", memory: str = "4g", folder: str | None = None) -> SparkSession:
    """A single-node session with the settings that the operators expect of any session.

    Only the time zone matters for results; the rest are the adaptive defaults. ``folder`` takes the
    intermediate tables; without it a single-node session makes one when it first needs it.
    """
    builder = SparkSession.builder if folder is None else SparkSession.builder.config("spark.checkpoint.dir", folder)
    return (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for clusters that lack it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tracewright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{root.name}_src.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, str(file.relative_to(root.parent)))
    sc.addPyFile(f"{folder}/{root.name}_src.zip")


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read one table; the column list keeps wide columns out of the scan."""
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set, a single-node session makes a temporary
    one; a cluster, whose machines don't see each other's folders, is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder[len("file://") :], ignore_errors=True)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in reliable shared storage now and go on from the copy.

    Used where a result is read several times or an iteration would otherwise grow its plan
    without end. The copy outlives lost executors, and unlike a checkpointed RDD it tells the
    optimizer its size, so that joins with a small one need no shuffle of the large side.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/tracewright/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(df: DataFrame, times: float = 1.0, each: int = 24 << 20, most: int = 20_000) -> int:
    """Partitions for a shuffle of ``times`` the size of a scan, so that none outgrows ``each`` bytes as
    tables grow, up to ``most``; the session's own number where the size isn't known."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = spark.sparkContext.defaultParallelism
    return max(least, min(most, int(size * times) // each + 1)) if size < 1 << 55 else max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def drop_stored(df: DataFrame) -> None:
    """Delete the table behind a frame that ``cut_lineage`` returned, once nothing reads it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getParent().getParent().getName() == "tracewright":
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_all_stored(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once no frame that was made with it is read any more."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{_shared_folder(spark)}/tracewright/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
