"""Session set-up and lineage cutting.

Iterative operators cut their lineage by writing a table under the folder named by
``spark.checkpoint.dir`` (shared by all executors) and reading it back.  A lost executor
therefore never loses a finished round.  Only where that setting is missing and the session
runs in local mode is a private folder used.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "loomgraph", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores if isinstance(cores, int) else 8),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k: str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """This session's folder for written rounds, removed when the JVM ends."""
    sc = spark.sparkContext
    known = getattr(sc, "_loomgraph_dir", None)
    if known:
        return known
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    root = f"{base.rstrip('/')}/loomgraph-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    sc._loomgraph_dir = root
    return root


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it: a checkpoint in columns.

    The scan keeps the column order of ``df`` and can be pruned and filtered like any table.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("compression", "zstd").parquet(at)
    back = spark.read.schema(df.schema).parquet(at).select(*df.columns)
    back._loomgraph_path = at
    return back


def drop_cut(df: DataFrame | None) -> None:
    """Delete the files behind a frame that :func:`cut` returned and nobody reads any more."""
    at = getattr(df, "_loomgraph_path", None)
    if at:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once a session, so that they can import its functions."""
    sc = spark.sparkContext
    if getattr(sc, "_loomgraph_shipped", False):
        return
    here = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="loomgraph-")) / "loomgraph.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(at))
    sc._loomgraph_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
