"""Raw complaint CSV: everything is read as text, the header is checked, then columns are cast one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.functions import text as T
from harborlight.sources import files

# Header of the public export, and the column each becomes.
COLUMNS = {
    "Date received": "date_received", "Product": "product", "Sub-product": "sub_product", "Issue": "issue", "Sub-issue": "sub_issue", "Consumer complaint narrative": "narrative",
    "Company public response": "company_public_response", "Company": "company_raw", "State": "state", "ZIP code": "zip_code", "Tags": "tags", "Submitted via": "submitted_via",
    "Date sent to company": "date_sent_to_company", "Company response to consumer": "company_response", "Timely response?": "timely_response", "Complaint ID": "complaint_id",
}


class HeaderMismatch(ValueError):
    pass


def read_csv(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """All columns as strings; quoted line breaks are kept. A file is one task with line breaks in quotes, so rows may be spread after."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = sorted(set(COLUMNS) - set(df.columns))
    if missing:
        raise HeaderMismatch(f"missing columns: {missing}")
    return df.repartition(partitions) if partitions else df


def typed(raw: DataFrame) -> DataFrame:
    """complaints_raw: typed, blank as null, the narrative only as a flag; rows without a whole number as id are dropped."""
    c = {new: F.col(f"`{old}`") for old, new in COLUMNS.items()}
    out = [c["complaint_id"].try_cast("long").alias("complaint_id"), T.iso_date(c["date_received"]).alias("date_received"), T.iso_date(c["date_sent_to_company"]).alias("date_sent_to_company")]
    out += [T.blank_to_null(c[n]).alias(n) for n in COLUMNS.values() if n not in ("complaint_id", "date_received", "date_sent_to_company", "narrative", "timely_response")]
    out += [T.yes_no(c["timely_response"]).alias("timely_response"), F.coalesce(F.trim(c["narrative"]) != "", F.lit(False)).alias("has_narrative")]
    return raw.select(*out).where("complaint_id is not null")


def load(raw: DataFrame, path: str, validate=None) -> DataFrame:
    """Write the typed rows beside `path`, validate what was written, then put it in place: a failed check leaves the old rows."""
    spark = raw.sparkSession
    files.recover(spark, path)
    staged = f"{path.rstrip('/')}.staged"
    typed(raw).write.mode("overwrite").parquet(staged)
    df = spark.read.parquet(staged)
    if validate:
        validate(df)
    files.swap(spark, staged, path)
    return spark.read.parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with rows of new put in or over it, by key. A key given twice in new counts once: the greatest row of its other columns."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__r")).select(*keys, "__r.*") if rest else new.distinct()
    return old.join(once.select(*keys), keys, "left_anti").unionByName(once.select(*new.columns))


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """Replace one run's partition and no other."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
