import json

import pytest

from harborlight import checks, config, ids
from harborlight.registry import Registry, SilentSuccess
from harborlight.sources import csv_raw, html_listing
from harborlight.streaming import panel
from pyspark.sql import functions as F

HEADER = ",".join(f'"{c}"' for c in csv_raw.COLUMNS)


def test_csv_load(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text(
        HEADER + '\n"2020-01-02T00:00:00Z","Loans, home",,I,,"it\nbroke",,ACME,,,Older,Web,2020-01-03,Closed,Yes,11\n'
        '2020-01-05,P,,,,"  ",,B,CA,123,None,Web,x,Closed,No,12\n2020-01-05,P,,,,,,B,CA,123,,Web,,Closed,,abc\n'
    )
    raw = csv_raw.read_csv(spark, str(p))
    df = csv_raw.load(raw, str(tmp_path / "out"), lambda d: checks.expect_unique(d, "complaint_id"))
    rows = {r.complaint_id: r for r in df.collect()}
    assert set(rows) == {11, 12} and rows[11].has_narrative and not rows[12].has_narrative and rows[12].tags is None
    assert str(rows[11].date_received) == "2020-01-02" and rows[11].timely_response is True and rows[12].date_sent_to_company is None
    with pytest.raises(checks.CheckFailed):
        csv_raw.load(raw, str(tmp_path / "out"), lambda d: checks.expect_rows(d, 5))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(csv_raw.HeaderMismatch):
        csv_raw.read_csv(spark, str(bad))


def test_upsert_and_run_partitions(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in csv_raw.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    out = str(tmp_path / "runs")
    csv_raw.write_run(old, out, "r1")
    csv_raw.write_run(old, out, "r2")
    csv_raw.write_run(new.limit(1), out, "r2")
    assert spark.read.parquet(out).groupBy("run_id").count().orderBy("run_id").collect() == [("r1", 2), ("r2", 1)]


def test_listing(spark):
    html = '<p>2 results</p><article class="x"><time datetime="2020-05-01T00"></time><a href="/a">A <b>bank</b></a></article><article><a href="/b">B</a></article>'
    got = html_listing.entries(spark.createDataFrame([(1, html), (2, None), (3, "")], "page int, html string"), "html")
    assert [(r.page, str(r.filed_date), r.link, r.title) for r in got.collect()] == [(1, "2020-05-01", "/a", "A bank"), (1, "None", "/b", "B")]
    assert html_listing.enough(got)
    pages = {1: html, 2: html.replace('"/b"', '"/c"'), 3: html}
    assert [r.page for r in html_listing.crawl(spark, pages.get).collect()] == [1, 2] and html_listing.crawl(spark, lambda page: None).count() == 0
    with pytest.raises(RuntimeError):
        html_listing.crawl(spark, lambda page: f'<article><a href="/{page}">x</a></article>', 5)
    assert spark.createDataFrame([("<p>short</p><p>" + "long " * 20 + "</p>",)], "h string").select(html_listing.paragraphs(F.col("h")).alias("p")).first().p == ("long " * 20).strip()


def test_registry_and_ids(spark, tmp_path):
    r = Registry(spark, str(tmp_path))
    with r.run("dedup", "f", cutoff=None) as run:
        run.finish(3)
    with pytest.raises(SilentSuccess), r.run("dedup", "f"):
        pass
    assert r.latest("dedup")["rows"] == 3 and r.latest("cluster") is None
    assert any(json.loads(p.read_text())["status"] == "failed" for p in tmp_path.glob("*.json"))
    assert ids.parse_id(ids.make_id("r", "s", 4)) == ("r", "s", "4")
    with pytest.raises(ValueError):
        ids.make_id("r:x", "s", 1)
    assert config.Config().fingerprint() == config.Config().fingerprint() != config.Config(seed=1).fingerprint()
    with pytest.raises(ValueError):
        config.Novelty(weights=(0.5, 0.6))


def test_checks(spark):
    df = spark.createDataFrame([(1, "2020-01-01", None)], "a int, d string, n string").withColumn("d", F.to_date("d"))
    with pytest.raises(checks.CheckFailed):
        checks.expect_no_nulls(df, "a", "n")
    with pytest.raises(checks.CheckFailed):
        checks.expect_no_leakage(df, "d", "2020-01-01")
    checks.expect_no_leakage(df, "d", "2020-01-02")
    with pytest.raises(checks.CheckFailed):
        checks.expect_in(df, "a", [2])
    drift = checks.schema_drift(df, spark.createDataFrame([], "a long, x int").schema)
    assert drift == {"missing": ["x"], "extra": ["d", "n"], "changed": ["a"]}


def test_streaming_equals_batch(spark, tmp_path):
    src = spark.sql("select id, timestamp'2020-01-01' + make_interval(0,0,0,0,id*5,0,0) as ts, concat('u', id % 2) as kind from range(20)")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = panel.windowed_counts(panel.once(stream, "id", "ts"), "ts", ["kind"], late=None).writeStream.outputMode("append").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    done = {tuple(r) for r in spark.sql("select * from counts").collect()}
    assert done and done <= {tuple(r) for r in panel.windowed_counts(src, "ts", ["kind"]).collect()}
