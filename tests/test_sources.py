import gzip

import pytest
from pyspark.sql import functions as F

from sievework.operators import composition, index
from sievework.plans import reports
from sievework.sources import extract, synthetic
from sievework.streaming import reach


def test_extract(spark, tmp_path):
    path = tmp_path / "x.csv.gz"
    head = "\ufeffNumber ID / Numéro,Date Received / Date reçue,Fraud and Cybercrime Thematic Categories / Catégories,Other"
    path.write_bytes(gzip.compress((head + "\n1,2021-01-02, Phishing ,a\n2,2021-01-03,Phishing,b\n3,2021-02-01,Job,\n4,2021-02-01,,\n").encode()))
    rows = extract.read(spark, str(path))
    assert [tuple(r) for r in extract.base_rates(rows).collect()] == [("Phishing", 2, 0.666667), ("Job", 1, 0.333333)]
    assert tuple(extract.survey(rows).first())[:4] == (4, 2, "2021-01-02", "2021-02-01")
    with pytest.raises(ValueError):
        extract.read(spark, str(path), {"x": "No such header"})


def test_synthetic_grows_without_changing(spark):
    few, many = synthetic.background(spark, 50), synthetic.background(spark, 200)
    assert few.exceptAll(many).isEmpty() and many.count() == 200
    assert synthetic.background(spark, 50, seed=2).exceptAll(few).count() == 50


def test_composition(spark):
    placed = spark.createDataFrame([("Phishing",)] * 2 + [("Other",)], "scam_category string")
    out = {r.category: r for r in composition.compared(placed).collect()}
    assert len(out) == 11 and out["Phishing"].per_mille == 667 and out["Extortion"].per_mille == 0
    assert sum(r.posts for r in composition.shares(placed.limit(0)).collect()) == 0


def test_reports(spark):
    df = spark.createDataFrame([("a|b", 0.5, None)], "x string, y double, z int")
    assert "| a\\|b | 0.5000 |  |" in reports.markdown(df, "T")
    assert reports.console(df, "T").splitlines()[2].split() == ["x", "y", "z"]
    assert [reports.duration(s) for s in (0, 61, 3600, 90_061)] == ["0 s", "1 min 1 s", "1 h", "1 d 1 h"]
    with pytest.raises(ValueError):
        reports.console(spark.range(reports.MOST_ROWS + 1), "T")


def test_store_index(spark, tmp_path):
    rows = spark.createDataFrame([("p", "m", 2, "r"), ("q", "m", 2, "r")], "post_id string, model string, dimensions int, recipe string")
    index.check_store(rows, "m", 2, "r")
    with pytest.raises(ValueError):
        index.check_store(rows, "m", 3, "r")
    assert tuple(index.facts(rows).first()) == (2, 2, 1, 1)
    rows.write.parquet(str(tmp_path / "t"))
    plan = index.scans(spark.read.parquet(str(tmp_path / "t")).where("dimensions = 2").select("post_id", "dimensions"))
    assert any("EqualTo(dimensions,2)" in x for x in plan)


def test_streams(spark, tmp_path):
    links = "array<struct<link:string,domain:string>>"
    schema = f"received_at timestamp, post_id string, account string, links {links}"
    rows = spark.createDataFrame([("p", "a", [("l", "X.example")]), ("q", "b", [("l", "x.example."), ("l", None)])], f"post_id string, account string, links {links}").select(F.to_timestamp(F.lit("2026-01-01 10:00:00")).alias("received_at"), "*")
    rows.write.parquet(str(tmp_path / "in"))
    counted = reach.windowed_reach(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    counted.writeStream.format("memory").queryName("reached").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = spark.table("reached").collect()
    assert [(r.domain, r.posts, r.accounts) for r in got] == [("x.example", 2, 2)]

    state = {"rows": spark.createDataFrame([("p", "old"), ("z", "old")], "post_id string, account string")}
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).select("post_id", "account")
    reach.keep_store(stream, lambda: state["rows"], lambda df, n: state.update(rows=spark.createDataFrame(df.collect(), df.schema)), "post_id", str(tmp_path / "ck")).awaitTermination()
    assert {tuple(r) for r in state["rows"].collect()} == {("p", "a"), ("q", "b"), ("z", "old")}
