"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own configuration."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelwright")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must exist: a machine-local folder would be lost
    with its executor.  Only a local master without it gets a temporary folder,
    one per application, held here because the setting itself is read-only.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    app = context.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="panelwright-")
    return _OWN_FOLDERS[app]


def _scratch(spark: SparkSession) -> str:
    """The application's own folder below the shared one; Hadoop deletes it when the application ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/panelwright-{spark.sparkContext.applicationId}"
    if folder not in _MARKED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _MARKED.add(folder)
    return folder


_MARKED: set[str] = set()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the frame to the shared folder and reads it back.

    The table survives lost executors like a checkpoint does, and its exact
    size lets later joins broadcast it when, and only when, it is small.  The
    application's tables go when it ends; ``drop_table`` removes one earlier.
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by_year(df: DataFrame) -> DataFrame:
    """Writes the frame to the shared folder, by ``year`` for readers to prune, and reads it back.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/panel-{uuid.uuid4().hex}"
    df.write.partitionBy("year").parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def files_state(spark: SparkSession, paths: list[str]) -> tuple:
    """Length and time of change of files or folders, to tell whether what was derived from them still holds."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = [path(p) for p in paths]
    states = [p.getFileSystem(conf).getFileStatus(p) for p in found]
    return tuple((str(p), s.getLen(), s.getModificationTime()) for p, s in zip(paths, states, strict=True))


def drop_table(table: DataFrame) -> None:
    """Removes the files of a frame that ``cut_lineage`` returned and nothing reads any more."""
    spark = table.sparkSession
    folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
    for folder in folders:
        if "/cut-" not in folder:
            raise ValueError(f"not a table of cut_lineage: {folder}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
