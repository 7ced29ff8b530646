"""The crawl over stored pages, its routers, and the sinks and steps around it."""

import json

import pytest
from pyspark.sql import functions as F

from feedloom.operators import crawl as K
from feedloom.operators import links, publish, roster
from feedloom.operators.distinct import numbered
from feedloom.sources import files

PAGES = "url string, final_url string, links array<struct<t:string,h:string>>, text string"
COMPANIES = "company string, url string, location string"
LONG = "careers " * 40
NAV = [("About", "/about"), ("Team", "/team"), ("Form", "mailto:x@a.example")]


def walk(spark, companies, stored_pages, router=None, **budgets):
    stored = spark.createDataFrame(stored_pages, PAGES)
    return K.crawl(spark.createDataFrame(companies, COMPANIES), lambda u: stored.join(u, "url", "left_semi"), router, **budgets)


def page(url, found, final=None, text=LONG):
    return (url, final or url, found, text)


def found(w):
    return [(r["company"], r["title"], r["url"]) for r in w.candidates.orderBy("company", "ord").collect()]


def test_postings_boards_walls_and_networks(spark):
    w = walk(
        spark, [(c, f"https://{c}.example/careers", None) for c in ("a", "b", "wall", "net", "gone", "anc")],
        [
            page("https://a.example/careers", [("One", "/jobs/1"), ("Two", "../jobs/2/"), ("One again", "https://A.example/jobs/1?x")]),
            page("https://b.example/careers", [*NAV, ("Board", "https://jobs.lever.co/b")]), page("https://jobs.lever.co/b", [("Clerk", "https://jobs.lever.co/b/0123456789ab"), ("Home", "https://b.example/careers")]),
            page("https://wall.example/careers", [], text="short"), page("https://net.example/careers", NAV, "https://www.linkedin.com/company/net"), page("https://anc.example/careers", [("Cook", "/jobs/9")]),
        ],
    )
    assert found(w) == [("a", "One", "https://a.example/jobs/1"), ("a", "Two", "https://a.example/jobs/2/"), ("anc", "Cook", "https://anc.example/jobs/9"), ("b", "Clerk", "https://jobs.lever.co/b/0123456789ab")]
    assert {tuple(r) for r in w.pointers.collect()} == {("wall", "blocked", "https://wall.example/careers"), ("net", "linkedin", "https://www.linkedin.com/company/net")}
    assert {r["company"] for r in w.scraped.collect()} == {"a", "b", "wall", "net", "anc"}
    assert {r["company"] for r in w.candidates.where("via_recruiter").collect()} == {"anc"}


def listing(n, next_page=True):
    return "So: " + json.dumps({"jobs": [{"title": f"Role {n}-{i}", "url": f"https://c.example/p{n}"} for i in range(10)], "next_page": f"p{n + 1}" if next_page else None, "is_aggregator": True})


def test_pagination_keeps_its_budget_and_stops_at_enough_candidates(spark):
    pages = [page(f"https://c.example/p{n}", NAV) for n in range(12)]
    router = K.provider(lambda prompt: listing(int(prompt.split("https://c.example/p")[1].split()[0])))
    w = walk(spark, [("c", "https://c.example/p0", "Town")], pages, router)
    assert len(found(w)) == 50 and found(w)[-1][1] == "Role 4-9"
    few = walk(spark, [("c", "https://c.example/p0", "Town")], pages, router, pages=2)
    assert {t.split("-")[0] for _, t, _ in found(few)} == {"Role 0", "Role 1", "Role 2"}
    rows = K.on_page(w.candidates, spark.createDataFrame([("c", "", "Town")], COMPANIES)).collect()
    assert len(rows) == 25 and rows[0]["via"] == "c" and rows[0]["location"] == "Town" and {r["url"] for r in rows} >= {"https://c.example/p0#role-0-0", "https://c.example/p2#role-2-4"}


def test_hops_and_follows_are_bounded_and_loops_end(spark):
    pages = [page(f"https://s{n}.example/", [*NAV, *((f"b{k}", f"https://s{n}{k}.greenhouse.io/") for k in range(5)), ("back", "https://s0.example/")]) for n in range(1)]
    pages += [page(f"https://s0{k}.greenhouse.io/", [*NAV, ("on", f"https://t{k}.lever.co/x"), ("self", f"https://s0{k}.greenhouse.io")]) for k in range(5)]
    pages += [page(f"https://t{k}.lever.co/x", [*NAV, ("far", "https://u.breezy.hr/")]) for k in range(5)] + [page("https://u.breezy.hr/", [("J", "/job/x-1")])]
    w = walk(spark, [("c", "https://s0.example/", None)], pages)
    assert {r["key"] for r in w.boards.collect()} == {"https://s0.example", *(f"https://s0{k}.greenhouse.io" for k in range(3)), *(f"https://t{k}.lever.co/x" for k in range(3))}
    assert found(w) == [] and found(walk(spark, [("c", "https://s0.example/", None)], pages, hops=3)) == [("c", "J", "https://u.breezy.hr/job/x-1")]


def test_a_failing_router_decides_nothing_and_empty_input(spark):
    pages = [page("https://c.example/", NAV)]
    assert found(walk(spark, [("c", "https://c.example/", None)], pages, K.provider(lambda p: None))) == []
    assert found(walk(spark, [("c", "https://c.example/", None)], pages, K.provider(lambda p: "no {json"))) == []
    w = walk(spark, [], pages)
    assert all(x.count() == 0 for x in w)


@pytest.mark.parametrize(("fails", "waits"), [(0, []), (2, [1, 2]), (9, [1, 2, 4, 8, 16])])
def test_retries_rotate_models_and_wait_longer(fails, waits):
    asked, slept = [], []

    def call(model, prompt):
        asked.append(model)
        if len(asked) <= fails:
            raise RuntimeError("HTTP 429 quota")
        return prompt.upper()

    answer = K.retried(call, ["x", "y", "z"], first_wait=1, sleep=slept.append)
    assert answer("p") == ("P" if fails < 6 else None) and slept == waits and asked == ["x", "y", "z", "x", "y", "z"][: fails + 1]


def test_other_errors_are_not_tried_again():
    def call(model, prompt):
        raise ValueError("bad key")

    assert K.retried(call, ["x"], sleep=lambda s: pytest.fail("waited"))("p") is None


TITLES = [  # anchor, h1, page title, structured title, url, expected (fixed values)
    ("Read more", "Explore careers", "", None, "https://x.example/o/senior-business-analyst-healthcare-transformation-2", "Senior Business Analyst Healthcare Transformation"),
    ("Apply", "Software Engineer - Backend", "", None, "https://x.example/o/1", "Software Engineer - Backend"),
    ("Apply", "Job", "", "Senior Software Engineer (Backend Systems)", "https://x.example/o/1", "Senior Software Engineer (Backend Systems)"),
    ("Apply", "Jobs", "Awesome Job - Company", None, "https://x.example/jobs/?id=3", "Awesome Job"),
    ("Apply", "", "", None, "https://x.example/o/it-support-specialist-1-2", "It Support Specialist 1"),
]


def test_validated_postings(spark):
    rows = [("c", {"wave": 0, "ord": 1, "i": i}, a, u, i == 0, False, "https://x.example/", None) for i, (a, _, _, _, u, _) in enumerate(TITLES)]
    gone = [("c", {"wave": 0, "ord": 1, "i": 9}, "t", f"https://x.example/gone/{k}", False, False, "https://x.example/", None) for k in range(5)]
    own = spark.createDataFrame(rows[:1] + rows[1:2] + rows[3:] + gone, "company string, ord struct<wave:int,ord:long,i:int>, title string, url string, via_recruiter boolean, on_page boolean, page_url string, page_text string")
    block = '<script type="application/ld+json">{"@type": "JobPosting", "title": "%s", "jobLocation": {"address": {"addressLocality": "Town"}}}</script>'
    answers = [(u, None, u, h, t, LONG, block % s if s else None) for _, h, t, s, u, _ in (TITLES[0], TITLES[1], TITLES[3], TITLES[4])]
    answers += [("https://x.example/gone/0", 404, "https://x.example/gone/0", "", "", LONG, None), ("https://x.example/gone/1", 200, "https://x.example/", "", "", LONG, None), ("https://x.example/gone/2", 200, "https://x.example/board/", "", "", LONG, None), ("https://x.example/gone/3", 200, "https://x.example/gone/3", "", "", "short", None)]
    pages = spark.createDataFrame(answers, "url string, status int, final_url string, h1 string, page_title string, text string, html string")
    got = {r["url"]: r for r in K.validated(own, spark.createDataFrame([("c", "https://x.example/board"), ("d", "https://x.example/o/1")], "company string, key string"), pages).collect()}
    assert {u: r["title"] for u, r in got.items()} == {u: want for _, _, _, s, u, want in TITLES if not s}
    assert [r["via"] for r in got.values()].count("c") == 1
    one = K.validated(own.where("url like '%/o/1'"), spark.createDataFrame([], "company string, key string"), spark.createDataFrame([("https://x.example/o/1", 200, "https://x.example/o/1", "Job", "", LONG, block % TITLES[2][3])], pages.schema)).first()
    assert one["title"] == TITLES[2][5] and one["location"] == "Town"


def test_numbered_is_the_sorted_place(spark):
    df = spark.range(5_000).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("k"), "id").repartition(7)
    got = [(r["k"], r["id"]) for r in numbered(df, F.col("k").desc(), F.col("id")).orderBy("place").collect()]
    assert got == sorted(got, key=lambda x: (-x[0], x[1])) and numbered(df.limit(0), F.col("id")).count() == 0
    assert [r["place"] for r in numbered(df, F.col("id")).orderBy("id").collect()] == list(range(1, 5_001))


def test_directory_and_detail_pages(spark):
    html = """<a HREF="//l.example/memberdirectory/Details/one-12" x>A &amp; B</a><a href="//l.example/memberdirectory/Details/two">Two</a>
      <a href="//l.example/memberdirectory/Details/again-12">Again</a><a href="//l.example/memberdirectory/Details/blank-3"> </a><a href="/other">x</a>"""
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")
    assert sorted((r["member_id"], r["company_name"], r["slug"]) for r in links.directory(df, "id", "html").collect()) == [("12", "A & B", "one-12"), ("two", "Two", "two")]
    detail = '<p class="GZ-details-website">\n<a href=" https://x.example "></a><b> St. John\'s, NL </b>'
    rows = spark.createDataFrame([(200, detail), (404, detail), (None, detail.replace("NL", "nl")), (200, None)], "s int, h string").select(links.detail_fields(F.col("s"), F.col("h")).alias("f"))
    assert [tuple(r["f"]) for r in rows.collect()] == [("https://x.example", "St. John's, NL"), (None, None), ("https://x.example", None), (None, None)]


def test_router_results_and_selection(spark):
    state = spark.createDataFrame([("A", "old", "active", "heuristic", 1), ("B", "old", "failed", None, 1), ("C", None, "pending", None, 1), ("D", "old", "active", None, 1)], "company_name string, career_page_url string, status string, map_method string, last_checked int")
    results = spark.createDataFrame([("A", None, False, 1), ("B", "new", False, 1), ("C", "x", True, 1), ("B", "older", False, 0)], "company_name string, url string, failed boolean, ord int")
    got = {r["company_name"]: tuple(r)[1:] for r in roster.router_results(state, results, F.lit(2)).select(*state.columns).collect()}
    assert got == {"A": ("old", "failed", "heuristic", 2), "B": ("new", "active", "llm", 2), "C": (None, "pending", None, 1), "D": ("old", "active", None, 1)}
    c = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "company_name string, ord int")
    tried = spark.createDataFrame([("A", "2027-01-02"), ("B", "2027-01-01")], "company_name string, last_scraped string")
    pick = lambda **k: [r["company_name"] for r in roster.selection(c, tried, **k).orderBy("ord").collect()]
    assert pick(company="b", batch=1, limit=1) == ["B"] and pick(batch=2, limit=1) == ["B", "C"] and pick(limit=1) == ["A"] and pick() == ["A", "B", "C"]
    assert {tuple(r) for r in roster.stamped(tried, c.where("ord > 1"), F.lit("now")).collect()} == {("A", "2027-01-02"), ("B", "now"), ("C", "now")}


def test_documents_and_steps(spark, tmp_path):
    feed = spark.createDataFrame([("c", "open"), ("d", "closed"), (None, None)], "company string, status string")
    files.write_open(feed, f"{tmp_path}/open")
    assert [r["company"] for r in spark.read.json(f"{tmp_path}/open").collect()] == ["c"]
    summary = spark.createDataFrame([(1, ["c"])], "open_count int, companies array<string>")
    buckets = spark.createDataFrame([([("x", 2)], 3)], "not_in_roster array<struct<name:string,n:int>>, overlap int")
    files.write_document(publish.summary_document(summary, buckets, "now"), f"{tmp_path}/summary")
    doc = json.loads(spark.read.text(f"{tmp_path}/summary").first()["value"])
    assert doc == {"generated": "now", "open_count": 1, "companies": ["c"], "coverage": {"not_in_roster": [{"name": "x", "n": 2}], "overlap": 3}}
    assert "coverage" not in json.loads(publish.summary_document(summary, None, "now").first()["value"])
    files.write_document(buckets, f"{tmp_path}/buckets")
    assert json.loads(spark.read.text(f"{tmp_path}/buckets").first()["value"])["overlap"] == 3
    df = spark.range(100).toDF("k")
    assert files.in_steps(df, "k", 3, lambda x: x, f"{tmp_path}/dry", dry_run=True) == [] and not (tmp_path / "dry").exists()
    files.in_steps(df, "k", 3, lambda x: x, f"{tmp_path}/wet")
    assert spark.read.parquet(f"{tmp_path}/wet").count() == 100
