"""From a raw CSV to alerts and back in time, and the files on the way."""

import datetime
import gzip
import io
import random
import zipfile

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from harborlight.__main__ import main
from harborlight.config import Config
from harborlight.plans import phases
from harborlight.sources import csv_raw, files


def _csv(path):
    rng = random.Random(6)
    themes = {
        "Mortgage": ("escrow payment lost servicer transfer foreclosure notice", "appraisal refused rate lock broken closing delayed lender"),
        "Debt collection": ("collector called work daily threatened arrest caller", "validation letter ignored debt unproven buyer report"),
    }
    lines = [",".join(f'"{c}"' for c in csv_raw.COLUMNS)]
    for i in range(700):
        product = list(themes)[i % 2]
        k = rng.random() < 0.5
        day = datetime.date(2016, 1, 1) + datetime.timedelta(days=rng.randint(0, 1400))
        company = ("ACME Bank, N.A.", "Beta LLC", "Gamma Corp.")[rng.choices((0, 1, 2), (8, 1, 1) if k else (1, 4, 4))[0]]
        words = themes[product][k].split()
        text = " ".join(rng.sample(words, 5) + [f"on day {rng.randint(1, 9999)}", "call me at 555-123-4567"] + rng.choices("alpha beta gamma delta omega sigma kappa".split(), k=2))
        row = {"Date received": day, "Product": product, "Issue": ("Fees", "Service")[k], "Consumer complaint narrative": text, "Company": company, "State": "CA", "Submitted via": "Web", "Date sent to company": day, "Timely response?": "Yes", "Complaint ID": 1000 + i}
        lines.append(",".join(f'"{row.get(c, "")}"' for c in csv_raw.COLUMNS))
    lines += [lines[1], lines[-1]]  # delivered again
    path.write_text("\n".join(lines) + "\n")


def test_from_csv_to_alerts(spark, tmp_path, capsys):
    _csv(tmp_path / "raw.csv")
    folder = str(tmp_path / "tables")
    assert main([folder, "run", "load", "--source", str(tmp_path / "raw.csv")], spark) == 0
    w = phases.Work(spark, folder, Config(cutoffs=("2018-06-01", "2019-06-01")))
    for phase in ("normalize", "pairs", "embed"):
        assert phases.run_phase(w, phase)["rows"] > 0
    assert w.read("complaints").count() == 700 and {r.product_family for r in w.read("complaints").select("product_family").distinct().collect()} == {"mortgage", "debt_collection"}
    assert {r.company_id for r in w.read("company_alias").collect()} == {"acme-bank", "beta", "gamma"}
    assert {r.pattern: r.n_hits for r in w.read("redaction_stats").collect()}["phone"] == 700
    for cutoff in (None, "2018-06-01", "2019-06-01"):
        phases.run_phase(w, "groups", cutoff)
        phases.run_phase(w, "cluster", cutoff, k=5, least=0.5, min_size=20)
        phases.run_phase(w, "signals", cutoff)
    run = w.run_of("signals", "2018-06-01")
    early = w.read("signals", run)
    assert str(early.agg({"as_of": "max"}).first()[0]) < "2018-06-01" and early.where("period_month >= '2018-06-01'").count() == 0
    whole = w.read("signals", w.run_of("signals", None))
    # the two themes of a family go with different companies, which the tests find
    assert whole.where("method = 'ebgm' and q < 0.05 and statistic > 1 and company_id = 'acme-bank'").count() >= 2 and w.read("alert_scopes", w.run_of("signals", None)).count() > 0
    assert phases.run_phase(w, "signals", None, control=True)["rows"] > 0
    control = w.read("signals", w.registry.latest("signals", cutoff=None, control=True)["run_id"])
    assert control.where("method = 'ebgm' and q < 0.05").count() < whole.where("method = 'ebgm' and q < 0.05").count()
    spark.createDataFrame([(1, "acme-bank", datetime.date(2018, 9, 1)), (2, "nobody", datetime.date(2019, 9, 1)), (3, "beta", datetime.date(2015, 1, 1))], "action_id long, company_id string, day date").write.parquet(f"{folder}/enforcement_actions")
    phases.run_phase(w, "backtest")
    got = {r.action_id: r.detected for r in w.read("outcomes").collect()}
    assert got[2] is False and got[3] is None and isinstance(got[1], bool)
    assert phases.run_phase(w, "baselines")["rows"] == 1400
    phases.run_phase(w, "embed")  # nothing is left to encode, and nothing is lost
    assert w.read("embeddings").count() == w.read("embedding_map").select("row_idx").distinct().count()
    with pytest.raises(LookupError):
        w.run_of("signals", "2001-01-01")
    with pytest.raises(ValueError):
        phases.run_phase(w, "nonsense")
    capsys.readouterr()
    assert main([folder, "runs", "-n", "50"], spark) == 0 and "load" in capsys.readouterr().out


def test_archives(tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("data/rows.csv", "a,b\n1,2\n")
        z.writestr("readme.txt", "x")
    record = files.fetch("https://example.org/rows.zip", str(tmp_path), lambda url: io.BytesIO(raw.getvalue()))
    assert record["bytes"] == len(raw.getvalue()) and files.fetch("https://example.org/rows.zip", str(tmp_path), lambda url: io.BytesIO(b"other")) == record
    with pytest.raises(ValueError):
        files.fetch("http://example.org/rows.zip", str(tmp_path), lambda url: io.BytesIO(b""))
    with pytest.raises(OSError):
        files.fetch("https://example.org/more.zip", str(tmp_path), lambda url: io.BytesIO(b"abc"), expected=10)
    assert not (tmp_path / "more.zip").exists()
    assert open(files.extract_csv(str(tmp_path / "rows.zip"), str(tmp_path / "out"))).read() == "a,b\n1,2\n"
    with gzip.open(files.zip_to_gzip(str(tmp_path / "rows.zip"), str(tmp_path / "rows.csv.gz")), "rt") as f:
        assert f.read() == "a,b\n1,2\n"
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a.csv", "")
        z.writestr("b.csv", "")
    with pytest.raises(ValueError):
        files.extract_csv(str(tmp_path / "two.zip"), str(tmp_path))


def test_swaps_and_small_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    spark.range(5).write.parquet(f"{path}.staged")
    files.swap(spark, f"{path}.staged", path)
    assert spark.read.parquet(path).count() == 5 and not files.exists(spark, f"{path}.old")
    (tmp_path / "t").rename(tmp_path / "t.old")  # as a crash would leave it
    files.recover(spark, path)
    assert spark.read.parquet(path).count() == 5
    files.write_text(spark, f"{tmp_path}/a.json", "one")
    files.write_text(spark, f"{tmp_path}/a.json", "two é")
    assert files.read_text(spark, f"{tmp_path}/a.json") == "two é" and len(files.names(spark, str(tmp_path), ".json")) == 1
    schema = StructType([StructField("id", LongType()), StructField("name", StringType())])
    (tmp_path / "good.csv").write_text('id,name\n1,"a ""b"""\n')
    (tmp_path / "bad.csv").write_text("name,id\na,1\n")
    (tmp_path / "worse.csv").write_text("id,name\nx,a\n")
    assert files.read_strict(spark, str(tmp_path / "good.csv"), schema).collect() == [(1, 'a "b"')]
    with pytest.raises(ValueError):
        files.read_strict(spark, str(tmp_path / "bad.csv"), schema)
    with pytest.raises(Exception, match="(?i)malformed|fail"):
        files.read_strict(spark, str(tmp_path / "worse.csv"), schema).collect()
