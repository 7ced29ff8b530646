"""Relational operators against tables of cases."""

import datetime as dt

from pyspark.sql import functions as F

from feedloom.operators import coverage, frontier, links, merge, publish, roster
from feedloom.operators.distinct import first_success, keep_first, keep_last, top_n
from feedloom.operators.snapshot_diff import snapshot_diff
from feedloom.schemas import FEED, ROSTER

FEED_ORD = FEED + ", ord bigint"
DAY = dt.date(2027, 4, 20)


def job(company="C", title="t", url="https://x.example/1", location="L", board="own-site", description="d", via=None, on_page=None, first=dt.date(2027, 1, 1), last=dt.date(2027, 4, 19), status="open", ord=0):  # noqa: A002
    return (company, title, url, location, board, description, via, on_page, first, last, status, ord)


def merged(spark, old, new, ok=()):
    out = merge.merge_history(spark.createDataFrame(old, FEED_ORD), spark.createDataFrame(new, FEED_ORD), spark.createDataFrame([(c,) for c in ok], "company string"), DAY)
    return {r["key"]: r for r in out.collect()}


def test_merge_inserts_refreshes_and_reopens(spark):
    got = merged(spark, [job(via="v", status="closed")], [job(title="new", location=None, via=""), job(url="https://x.example/2", ord=1)])
    r = got["https://x.example/1"]
    assert (r["title"], r["location"], r["via"], r["status"], r["first_seen"], r["last_seen"]) == ("new", None, "v", "open", dt.date(2027, 1, 1), DAY)
    assert got["https://x.example/2"]["first_seen"] == DAY


def test_merge_closes_by_reading_and_by_age_only(spark):
    old = [job(url=f"https://x.example/{i}", company=c, last=last, status=s, ord=i) for i, (c, last, s) in enumerate([
        ("read", dt.date(2027, 4, 19), "open"), ("other", dt.date(2027, 4, 6), "open"), ("other", dt.date(2027, 4, 7), "open"), ("other", None, "open"), ("other", DAY, "closed")])]
    got = merged(spark, old, [], ok=["read", None, "read"])
    assert [got[f"https://x.example/{i}"]["status"] for i in range(5)] == ["closed", "closed", "open", "open", "closed"]


def test_merge_keys_of_listed_roles_and_repeated_keys(spark):
    old = [job(title="A  b", on_page=True, url="https://x.example/p#1", description="first", ord=0), job(title="a B", on_page=True, url="https://x.example/q#1", description="last", ord=1)]
    got = merged(spark, old, [])
    assert [r["description"] for r in got.values()] == ["last"] and list(got) == ["onpage::c::a b"]
    new = [job(company="first", title="1", via="x", ord=0), job(company="second", title="2", ord=1)]
    r = merged(spark, [], new)["https://x.example/1"]
    assert (r["company"], r["title"], r["via"]) == ("first", "2", "x")


def test_merge_is_idempotent_and_takes_empty_tables(spark):
    assert merged(spark, [], []) == {}
    new = [job(), job(url="https://x.example/2", ord=1)]
    once = merge.merge_history(spark.createDataFrame([], FEED_ORD), spark.createDataFrame(new, FEED_ORD), spark.createDataFrame([], "company string"), DAY)
    again = merge.merge_history(once.drop("ord").withColumn("ord", F.lit(0)), spark.createDataFrame(new, FEED_ORD), spark.createDataFrame([], "company string"), DAY)
    assert sorted(map(str, once.drop("ord").collect())) == sorted(map(str, again.drop("ord").collect()))


def test_roster_keys_in_order_departed_and_ties(spark):
    r = lambda i, n, w=None, page=None, status="active", o=0: (i, n, w, "loc", page, status, None, None, o)
    prior = spark.createDataFrame([
        r("1", "One", "https://one.example", "p1"), r("2", "Two", "two.example", "p2", "failed", 1), r("3", "Gone", None, "p3", o=2), r("9", "two", "https://www.two.example", None, "failed", 3), r(None, None, "", None, o=4)],
        ROSTER + ", ord int")
    live = spark.createDataFrame([("1", "Uno", None, "", 0), ("x", "TWO", "", None, 1), ("y", "New name", "http://two.example/en", None, 2), ("z", "Fresh", None, None, 3)], "member_id string, company_name string, website_url string, location string, ord int")
    got = {x["company_name"]: x for x in roster.reconcile(live, prior).collect()}
    assert got["Uno"]["career_page_url"] == "p1" and got["Uno"]["website_url"] == "https://one.example" and got["Uno"]["location"] == "loc"
    assert got["TWO"]["status"] == "failed" and got["TWO"]["career_page_url"] is None  # the last of a name
    assert got["New name"]["career_page_url"] == "p2"  # the first of a domain
    assert (got["Fresh"]["origin"], got["Fresh"]["status"]) == ("fresh", "pending")
    assert (got["Gone"]["origin"], got["Gone"]["status"]) == ("departed", "inactive")


def test_mapping_due_edges(spark):
    t = dt.datetime(2027, 4, 1)
    rows = [("inactive", None, None), ("failed", "u", t), ("active", "", t), ("active", "u", None), ("active", "u", t - dt.timedelta(days=30, hours=23)), ("active", "u", t - dt.timedelta(days=31)), (None, "u", t)]
    df = spark.createDataFrame(rows, "status string, url string, at timestamp")
    due = roster.needs_mapping(F.col("status"), F.col("url"), F.col("at"), F.lit(t))
    assert [r["d"] for r in df.select(due.alias("d")).collect()] == [False, True, True, True, False, True, False]


def test_results_and_rotation(spark):
    state = spark.createDataFrame([("a", "old", "active", None), ("b", "old", "active", None), ("c", None, "pending", None)], "company_name string, career_page_url string, status string, map_method string")
    results = spark.createDataFrame([("a", "x", 0), ("a", "new", 1), ("b", None, 0)], "company_name string, url string, ord int")
    got = {r["company_name"]: tuple(r)[1:] for r in roster.apply_results(state, results, "heuristic").collect()}
    assert got == {"a": ("new", "active", "heuristic"), "b": ("old", "failed", None), "c": (None, "pending", None)}
    tries = spark.createDataFrame([("a", dt.date(2027, 1, 1)), ("a", dt.date(2027, 3, 1)), ("b", dt.date(2027, 2, 1)), ("c", None)], "company_name string, last_scraped date")
    due = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "company_name string, ord int")
    assert [r["company_name"] for r in roster.least_recent(due, tries, 3).orderBy(F.col("last_scraped").asc_nulls_first(), "ord").collect()] == ["c", "d", "b"]


def test_coverage_golden(spark):
    names = ["CoLab Software", "Not In Roster Ltd", "Not In Roster Ltd", "In Roster But No Jobs", "Other Company Inc."]
    external = spark.createDataFrame([(n, f"u{i}", i) for i, n in enumerate(names)] + [(None, "", 9)], "company_name string, url string, ord int")
    r = spark.createDataFrame([("CoLab",), ("In Roster But No Jobs",), ("Other Company",), (None,)], "company_name string")
    f = spark.createDataFrame([("CoLab",), ("Other Company",)], "company string")
    doc = coverage.document(coverage.buckets(coverage.grouped(external), r, f), "now").first()
    assert [(x["company_name"], x["job_count"], x["urls"]) for x in doc["not_in_roster"]] == [("Not In Roster Ltd", 2, ["u1", "u2"]), ("Unknown", 1, [])]
    assert [x["company_name"] for x in doc["scrape_gap"]] == ["In Roster But No Jobs"] and doc["overlap"] == 2


def test_new_windows_differ_on_the_seventh_day(spark):
    df = spark.createDataFrame([(dt.date(2027, 4, 13),), (dt.date(2027, 4, 12),), (dt.date(2027, 5, 1),), (None,)], "d date")
    got = df.select(publish.is_new(F.col("d"), F.lit(DAY)).alias("a"), publish.is_new_by_time(F.col("d"), F.lit(dt.datetime(2027, 4, 20, 12))).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(True, False), (False, False), (True, True), (False, False)]


def test_search_and_summary(spark):
    df = spark.createDataFrame([job(title=None, company="Ab"), job(board="", url="u2", ord=1), job(status="closed", url="u3", ord=2)], FEED_ORD)
    assert publish.search(df, q=" AB ").count() == 1 and publish.search(df, source="own-site").count() == 3 and publish.search(df, company="C").count() == 2
    s = publish.summary(df, F.lit(DAY)).first()
    assert (s["open_count"], s["total_tracked"], s["companies"], s["boards"]) == (2, 3, ["Ab", "C"], ["own-site"])
    assert publish.summary(df.limit(0), F.lit(DAY)).first()["open_count"] == 0


def test_distinct_and_top(spark, rows):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "y"), (None, 5, None), ("b", None, "z")], "k string, o int, v string")
    assert rows(keep_first(df, ["k"], F.col("o")), "k", "v") == [("a", "y"), ("b", "z"), (None, None)]
    assert rows(keep_last(df, ["k"], F.col("o")), "k", "v") == [("a", "x"), ("b", "z"), (None, None)]
    assert top_n(df, 2, ["k"], F.col("o"), F.col("v")).count() == 4
    got = first_success(df, ["k"], F.col("v") == "x", F.col("o"), F.col("v"))
    assert rows(got) == [("a", "x"), ("b", None), (None, None)]


def test_links_route_and_gates(spark):
    html = '<A class=x HREF="/jobs/12"> <b>Dev</b>\n eloper </a><a href="#x">no</a><a href="https://acme.bamboohr.com/list">All</a>'
    found = links.anchors(spark.createDataFrame([("https://x.example/c", html), ("https://y.example/", None)], "final_url string, html string"), "final_url", "html")
    assert [(r["href"], r["text"]) for r in found.orderBy("ord").collect()] == [("/jobs/12", "Dev eloper"), ("#x", "no"), ("https://acme.bamboohr.com/list", "All")]
    r = links.route(found).first()
    assert [tuple(j) for j in r["jobs"]] == [("Dev eloper", "https://x.example/jobs/12")] and r["follow"] is None
    r = links.route(found.where("ord > 0")).first()
    assert r["jobs"] is None and r["follow"] == ["https://acme.bamboohr.com/list"]
    pages = spark.createDataFrame([(404, "https://x.example/a", "t" * 200), (None, "https://x.example/b", "t" * 200), (200, "https://x.example/", "t" * 200), (200, "https://x.example/c", " " * 300), (200, "https://x.example/B?q", "t" * 120)], "status int, final_url string, text string")
    gate = links.posting_gate(pages, spark.createDataFrame([], "key string"))
    assert sorted(x["final_url"] for x in gate.collect()) == ["https://x.example/B?q", "https://x.example/b"]
    assert links.posting_gate(pages, spark.createDataFrame([("https://x.example/b",)], "key string")).count() == 0


def test_frontier_cuts_before_it_prunes(spark, rows):
    edges = spark.createDataFrame([("s", i, n) for i, n in enumerate(["s", "a", "b", "c"])] + [("a", 0, "d"), ("d", 0, "e"), ("b", 0, "a")], "node string, ord int, next string")
    got = frontier.expand(spark.createDataFrame([("s", "s")], "root string, node string"), frontier.along(edges), hops=2, most=3)
    assert rows(got, "node", "hop") == [("a", 1), ("b", 1), ("d", 2), ("s", 0)]  # c is the fourth link; e is three hops away


SNAP = "snapshot_id int, member_id string, delivered_at timestamp, website_url string, status string, snap string, k string, node bigint"


def snap(s, m, at, w, st):
    return (s, m, dt.datetime(2027, 1, 1, at), w, st, "clash", "clash", 7)


def brute(data):
    last = {}
    for s, m, at, w, st, *_ in data:
        if s is not None and m is not None:
            key = (at, w is not None, w or "", st is not None, st or "")
            if (s, m) not in last or key > last[s, m][0]:
                last[s, m] = (key, (w, st))
    order = sorted({s for s, _ in last})
    out = set()
    for a, b in zip(order, order[1:]):
        old, new = ({m: v for (s, m), (_, v) in last.items() if s == x} for x in (a, b))
        out |= {(b, m, "added") for m in new.keys() - old.keys()} | {(b, m, "removed") for m in old.keys() - new.keys()}
        out |= {(b, m, "changed") for m in new.keys() & old.keys() if new[m] != old[m]}
    return sorted(out)


def test_snapshot_diff_cases_and_clashing_columns(spark, rows):
    data = [
        snap(1, "a", 1, "w", "active"), snap(1, "b", 1, None, "active"), snap(1, "c", 1, "w", None), snap(1, None, 1, "w", "x"), snap(1, "d", 1, "w", "x"), snap(1, "d", 2, "w2", "x"),
        snap(3, "a", 1, "w", "active"), snap(3, "b", 1, "", "active"), snap(3, "d", 1, "w2", "x"), snap(3, "d", 1, "w2", "x"), snap(3, "e", 1, None, None), snap(4, "e", 1, None, None), snap(None, "z", 1, "w", "x"),
    ]
    for bits in (None, 0, 4, 12):
        assert rows(snapshot_diff(spark.createDataFrame(data, SNAP), bits=bits)) == sorted(brute(data), key=repr)
    assert snapshot_diff(spark.createDataFrame([], SNAP)).count() == 0
    assert snapshot_diff(spark.createDataFrame(data[:4], SNAP)).count() == 0


def test_snapshot_diff_with_a_hot_key_and_many_members(spark, rows):
    data = [snap(s, f"m{i}", 1, f"w{i if i % 50 else s}", "active") for s in (1, 2, 3) for i in range(s * 3, 400)] + [snap(2, "hot", h % 20, f"w{h}", "x") for h in range(500)]
    got = snapshot_diff(spark.createDataFrame(data, SNAP))
    assert got.columns == ["snapshot_id", "member_id", "change"]
    assert rows(got) == sorted(brute(data), key=repr)
