"""Session helpers: building a session, shipping the package, cutting lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def build_session(app: str = "harborlight", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where PYTHONPATH doesn't hold it already."""
    root = str(ROOT.parent)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    conf = spark.sparkContext.getConf()
    if spark.sparkContext.applicationId == getattr(ship_package, "done", None) or conf.get("spark.submit.pyFiles", ""):
        return
    path = Path(tempfile.mkdtemp(prefix="harborlight-")) / "harborlight-src.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent).as_posix())
    spark.sparkContext.addPyFile(str(path))
    ship_package.done = spark.sparkContext.applicationId


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir; a local one only where that is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="harborlight-checkpoints-")
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def _own_folder(spark: SparkSession) -> str:
    """This application's folder in the checkpoint folder; it is deleted when the driver's Python ends, unless the driver is lost."""
    app = spark.sparkContext.applicationId
    path = f"{checkpoint_dir(spark).rstrip('/')}/harborlight-{app}"
    if app not in _swept:
        _swept.add(app)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        atexit.register(_sweep, jvm, conf, path)
    return path


_swept: set[str] = set()


def _sweep(jvm, conf, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone by now, and then so is the chance to tidy up
        pass


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read back: no lineage, so it survives lost executors, and
    a scan with real sizes, so that plans over many rounds don't multiply up estimates."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop_cut(*dfs: DataFrame) -> None:
    """Delete what cut() wrote for these, once nothing that is still to be computed reads it."""
    for df in dfs:
        path = getattr(df, "cut_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
