"""Sources, sinks, streaming, and the driver's contract."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from feedloom import entries
from feedloom.schemas import FEED
from feedloom.sources import files
from feedloom.sources.paged import fetched, paged
from feedloom.streaming.feed import keep_feed

DATA = "/root/testdata/sf0.001"


def test_json_scans(spark, tmp_path):
    assert files.read_json(spark, f"{tmp_path}/none.json", FEED).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_json(spark, f"{tmp_path}/none.json", FEED, missing="raise")
    (tmp_path / "a.json").write_text(json.dumps([{"company": "A", "extra": 1}, {"title": "t", "on_page": True}]))
    got = files.read_json(spark, f"{tmp_path}/a.json", FEED)
    assert got.count() == 2 and got.where("on_page").first()["company"] is None
    (tmp_path / "m.json").write_text(json.dumps({"A": "2027-01-01", "B": None}))
    assert {tuple(r) for r in files.read_map(spark, f"{tmp_path}/m.json").collect()} == {("A", "2027-01-01"), ("B", None)}
    assert files.read_map(spark, f"{tmp_path}/none.json").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A|B", None, "", "p", "active"), ("C", "w", "l", None, "inactive")], "company_name string, website_url string, location string, career_page_url string, status string")
    files.write_markdown(df, f"{tmp_path}/md")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/md").collect()] == ["| A\\|B | — | — | [careers](p) |"]
    assert files.write_nonempty(df.limit(0), f"{tmp_path}/p") is False
    assert files.write_nonempty(df, f"{tmp_path}/p") is True
    files.write_snapshot(df, f"{tmp_path}/s")
    files.write_snapshot(files.read_snapshot(spark, f"{tmp_path}/s").where("company_name = 'C'"), f"{tmp_path}/s")
    assert files.read_snapshot(spark, f"{tmp_path}/s").count() == 1


def test_paged_source_reads_until_there_is_no_more(spark):
    def fetch(offset, limit):
        return [(str(i),) for i in range(offset, min(offset + limit, 250))], offset + limit < 250

    got = paged(spark, "numbers", "n string", fetch)
    assert got.count() == 250 and got.agg(F.max(F.col("n").cast("int"))).first()[0] == 249


def test_injected_fetcher(spark):
    got = fetched(spark.createDataFrame([("a",), ("b",), (None,)], "url string"), lambda u: (200, u + "/", "text") if u == "a" else None)
    assert {(r["url"], r["status"], r["final_url"]) for r in got.collect()} == {("a", 200, "a/"), ("b", None, None), (None, None, None)}


def test_stream_keeps_the_feed(spark, tmp_path):
    schema = "company string, title string, url string, location string, source_board string, description string, via string, on_page boolean, ord bigint"
    rows = lambda *u: spark.createDataFrame([("C", "t", f"https://x.example/{x}", None, "own-site", "d", None, None, i) for i, x in enumerate(u)], schema)
    for day, batch in (("2027-01-01", rows("1", "2")), ("2027-01-02", rows("2", "3"))):
        batch.write.mode("append").parquet(f"{tmp_path}/in")
        keep_feed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/feed", f"{tmp_path}/cp", lambda day=day: day).awaitTermination()
    got = {r["url"][-1]: (r["status"], str(r["first_seen"])) for r in files.read_snapshot(spark, f"{tmp_path}/feed").collect()}
    assert got == {"1": ("closed", "2027-01-01"), "2": ("open", "2027-01-01"), "3": ("open", "2027-01-02")}


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["p3_found", "canon_url", "merge_history", "roster_reconcile", "coverage_buckets", "feed_summary", "bounded_bfs", "title_cascade", "group_collect_urls"])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("open_jobs", "companies_state", "sh_reconcile", "known_jobs", "scrape_state", "pointers", "documents"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = entries.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    sql = con.execute(f"select {', '.join(cols)} from ({entries.SQL[name]})").fetchall()
    plain = lambda v: str(v) if not hasattr(v, "isoformat") else v.isoformat()
    assert sorted([tuple(map(plain, (r[c] for c in cols))) for r in got.collect()]) == sorted([tuple(map(plain, r)) for r in sql])
