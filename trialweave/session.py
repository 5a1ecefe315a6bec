"""Session helpers: settings, the shared work folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "trialweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library expects; a cluster supplies its own master."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_folders: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """Shared folder for written intermediates, as named by ``spark.checkpoint.dir``.

    A machine-local folder is made only where the setting is absent and the master is local.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        # The caller's settings stay as they are.
        name = spark.sparkContext.applicationId
        folder = _folders.setdefault(name, "") or tempfile.mkdtemp(prefix="trialweave-")
        _folders[name] = folder
    return folder.rstrip("/")


#: Files a task may have open; a task with more values of a partition column sorts its rows by it.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
#: Where tables made by ``written`` lie.
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str, by: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the work folder and read it back.

    This cuts the lineage, survives lost executors, and gives the table a known file size, so
    that Spark broadcasts it only when it really is below the broadcast threshold and otherwise
    takes a shuffle join with skew handling. ``by`` is a column of few values to partition by: a task
    keeps a file open for each, so that it need not sort its rows; ``codec`` names another compression than the session's, for tables of much text.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = f"{work_folder(spark)}/trialweave/{name}-{uuid.uuid4().hex}"
    if by:
        before = spark.conf.get(OPEN_FILES)
        try:
            spark.conf.set(OPEN_FILES, str(max(int(before), 16)))
            df.write.partitionBy(by).parquet(path, compression=codec)
        finally:
            # The caller's settings stay as they are.
            spark.conf.set(OPEN_FILES, before)
    else:
        df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete tables made by ``written``. No query that is still to run may read them."""
    for table in tables:
        context = table.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(_places.pop(table))
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries now.

    It deletes them once the driver's memory is collected, which may take longer than a run of many
    small queries. What is still in use stays. Spark holds the last query until another begins, so
    one of a single row comes first.
    """
    spark.range(0, 1, 1, 1).collect()
    spark.sparkContext._jvm.System.gc()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of all executors, once per session."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="trialweave-zip-")) / "trialweave.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in root.rglob("*.py"):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
