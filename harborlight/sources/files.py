"""Small files and folder swaps on whatever file system the session uses, and archives as they arrive."""

from __future__ import annotations

import gzip
import hashlib
import json
import shutil
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside the target and renamed over it: readers see the old text or the new one, never part of it."""
    part = f"{path}.partial-{uuid.uuid4().hex}"
    fs, p = _fs(spark, part)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, (_, target) = spark.sparkContext._jvm, _fs(spark, path)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(p), fs.makeQualified(target), how)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    source = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def names(spark: SparkSession, folder: str, suffix: str = "") -> list[str]:
    """Paths of the files of a folder that end so, in order; none if there is no folder."""
    fs, p = _fs(spark, folder)
    return sorted(str(s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().endswith(suffix)) if fs.exists(p) else []


def recover(spark: SparkSession, path: str) -> None:
    """Put back the table that an interrupted swap() had set aside, if the new one didn't arrive."""
    fs, p = _fs(spark, path)
    _, old = _fs(spark, f"{path.rstrip('/')}.old")
    if fs.exists(old):
        if fs.exists(p):
            fs.delete(old, True)
        else:
            fs.rename(old, p)


def swap(spark: SparkSession, staged: str, path: str) -> None:
    """The staged folder in place of path. The old one is set aside first and deleted last, so a crash at any point loses nothing: recover() finds it."""
    recover(spark, path)
    fs, new = _fs(spark, staged)
    _, target = _fs(spark, path)
    _, old = _fs(spark, f"{path.rstrip('/')}.old")
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} can't be set aside")
    if not fs.rename(new, target):
        recover(spark, path)
        raise OSError(f"{staged} can't be moved to {path}")
    fs.delete(old, True)


# --- archives: single files, handled by the driver before Spark reads what is in them

def fetch(url: str, folder: str, opener: Callable[[str], BinaryIO], force: bool = False, expected: int | None = None) -> dict:
    """Stream url into folder, hashing on the way; the manifest (name, url, bytes, sha256) lies beside it. A snapshot that is there is kept unless forced.

    opener opens an https URL; other schemes are refused. A stream shorter than `expected` bytes is an error and leaves nothing but a partial file.
    """
    if not url.startswith("https://"):
        raise ValueError(f"not an https URL: {url!r}")
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    target, manifest = root / url.rsplit("/", 1)[-1], root / "manifest.json"
    if target.exists() and not force:
        if not manifest.exists():
            raise FileExistsError(f"{target} is there without a manifest")
        return json.loads(manifest.read_text())
    digest, size, part = hashlib.sha256(), 0, target.with_name(target.name + ".partial")
    with opener(url) as source, part.open("wb") as out:
        while block := source.read(1 << 20):
            digest.update(block)
            size += len(block)
            out.write(block)
    if expected is not None and size != expected:
        raise OSError(f"{size} bytes of {expected} arrived")
    record = {"name": target.name, "url": url, "bytes": size, "sha256": digest.hexdigest()}
    part.replace(target)
    manifest.write_text(json.dumps(record, sort_keys=True))
    return record


def _only_csv(archive: zipfile.ZipFile) -> zipfile.ZipInfo:
    found = [m for m in archive.infolist() if m.filename.lower().endswith(".csv") and not m.is_dir()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} CSV members; exactly one is expected")
    return found[0]


def extract_csv(archive: str, folder: str) -> str:
    """The one CSV member of a zip file, under its bare name in folder; no other member is touched."""
    with zipfile.ZipFile(archive) as z:
        member = _only_csv(z)
        path = Path(folder) / Path(member.filename).name
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(path.name + ".partial")
        with z.open(member) as source, part.open("wb") as out:
            shutil.copyfileobj(source, out, 1 << 20)
        part.replace(path)
    return str(path)


def zip_to_gzip(archive: str, path: str) -> str:
    """The one CSV member of a zip file as a gzip file that Spark reads, without unpacking to disk in between."""
    part = Path(f"{path}.partial")
    with zipfile.ZipFile(archive) as z, z.open(_only_csv(z)) as source, gzip.open(part, "wb") as out:
        shutil.copyfileobj(source, out, 1 << 20)
    part.replace(path)
    return path


# --- small CSV with a contract

def read_strict(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV whose header is the schema's, in its order, and whose rows all have its arity and types; anything else is an error when it is read."""
    header = spark.read.option("header", True).csv(path).columns
    wanted = [f.name for f in schema]
    if header != wanted:
        raise ValueError(f"header {header}; expected {wanted}")
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def write_small(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for people: rows in the order given, formulas defused by the caller."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
