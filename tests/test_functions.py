"""Scalar functions: facts fixed by examples, and properties."""

from urllib.parse import urljoin, urlparse

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedloom.functions import json as J
from feedloom.functions import rules, text, urls


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


TITLES = [
    (("Apply", "Join Us", "Board", None, "https://x.example/jobs/senior-business-analyst-healthcare-transformation-2"), "Senior Business Analyst Healthcare Transformation"),
    (("Apply", "Join Us", "Board", None, "https://x.example/jobs/senior-business-analyst-healthcare-transformation-2/"), "Senior Business Analyst Healthcare Transformation"),
    (("Apply", "Software Engineer - Backend", "Board", None, "https://x.example/jobs/77"), "Software Engineer - Backend"),
    (("Apply", "Engineer", "Board", "Senior  Software Engineer (Backend Systems)", "https://x.example/jobs/77"), "Senior Software Engineer (Backend Systems)"),
    (("Apply", "Careers", "Awesome Job - Company", None, "https://x.example/jobs/?id=7"), "Awesome Job"),
    (("Apply", "", "Board", None, "https://x.example/data-scientist-machine-learning"), "Data Scientist Machine Learning"),
    (("Apply", None, None, None, "https://x.example/it-support-specialist-1-2"), "It Support Specialist 1"),
    ((None, None, None, None, None), ""),
]


def test_title_cascade(spark):
    df = spark.createDataFrame([(*a, want) for a, want in TITLES], "a string, h string, p string, s string, u string, want string")
    for r in df.withColumn("got", text.pick_title(*[F.col(c) for c in "ahpsu"])).collect():
        assert r["got"] == r["want"]


def test_names_that_are_one(spark):
    pairs = [
        ("Compusult", "Compusult Limited"), ("Solace Power", "Solace Power Inc"), ("Vish", "Vish Limited"), ("Virtual Marine", "Virtual Marine Inc."), ("CoLab Software", "CoLab"),
        ("Other Company Inc. Ltd", "Other Company"), ("WSP", "wsp"), ("Test-Comp", "Test Comp"), ("Straße Inc", "strasse"), ("Café Ω", "CAFÉ ω"), ("  a\tb ", "A B"),
    ]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(text.normalize_name(F.col("a")) != text.normalize_name(F.col("b"))).count() == 0
    assert one(spark, text.normalize_name(F.lit(None).cast("string"))) is None


def test_canonical_urls(spark):
    cases = [
        ("HTTPS://WWW.X.example/Jobs/1/?q=2#f", "https://www.x.example/jobs/1"), ("https://x.example/a;p=1", "https://x.example/a"), ("x.example/a", ""), (None, None), ("", ""),
        (" \thttps://x.example/a b|c", "https://x.example/a b|c"), ("https://x.example:8080/é", "https://x.example:8080/é"),
    ]
    for r in spark.createDataFrame(cases, "u string, want string").withColumn("got", urls.canon_url(F.col("u"))).collect():
        assert r["got"] == r["want"], r


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abZ09-_./?#&=%é", max_size=20), min_size=1, max_size=30))
def test_canonical_urls_agree_with_the_standard_library_and_are_stable(spark, tails):
    given_ = ["https://Host.example/" + t for t in tails]
    df = spark.createDataFrame([(u,) for u in given_], "u string").withColumn("c", urls.canon_url(F.col("u")))
    for r in df.withColumn("again", urls.canon_url(F.col("c"))).collect():
        p = urlparse(r["u"])
        assert r["c"] == f"{p.scheme}://{p.netloc}{p.path}".rstrip("/").lower()
        assert r["again"] == r["c"]


def test_absolute_references(spark):
    bases = ["https://h.example/a/b?x=1", "https://h.example", "https://h.example/", "https://h.example/a/b/c/", "https://h.example/a/../b/c#f"]
    hrefs = ["c", "/c", "//o.example/z", "?y=2", "#f", "https://q.example", "mailto:a@b.example", "", "../d", "./e", "/a/../f", "..", ".", "../..", "../../../g", "g/../h?i=../j", "/../k", "a/./b/", "a/b/..", "/a/b/.", "..x/y", "a//b", "../d#a/../b"]
    df = spark.createDataFrame([(base, h) for base in bases for h in hrefs], "b string, h string").withColumn("u", urls.absolute(F.col("b"), F.col("h")))
    for r in df.collect():
        assert r["u"] == urljoin(r["b"], r["h"]), r


def test_domains_and_roots(spark):
    assert one(spark, urls.norm_domain(F.lit("www.X.example/p"))) == "x.example"
    assert one(spark, urls.norm_domain(F.lit(None).cast("string"))) == ""
    assert one(spark, urls.root_url(F.lit("x.example/p?q"))) == "https://x.example"
    assert one(spark, urls.root_url(F.lit(""))) is None
    assert one(spark, urls.toggle_www(F.lit("https://www.x.example"))) == "https://x.example"
    assert one(spark, urls.toggle_www(F.lit("https://x.example"))) == "https://www.x.example"


def test_posting_urls_strict_and_not(spark):
    u = F.lit("https://apply.workable.com/j/ABCDEF")
    assert one(spark, rules.is_job_post(u)) is False
    assert one(spark, rules.is_job_post(u, strict=False)) is True
    assert one(spark, rules.contains_any(F.lit("https://clever.com"), rules.BOARD_HOSTS)) is True
    assert one(spark, rules.contains_any(F.lit("50.0%"), ["50_0%", "."])) is True
    assert one(spark, rules.contains_any(F.lit("a+b"), ["aab"])) is False


def test_slug_score_and_location(spark):
    assert one(spark, text.slug(F.lit("  C++ / Développeur  "))) == "c-d-veloppeur"
    assert one(spark, text.slug(F.lit(None).cast("string"))) == "role"
    assert len(one(spark, text.slug(F.lit("x" * 500)))) == 60
    assert one(spark, text.careers_score(F.lit("https://x.example/careers"), F.lit("greenhouse.io apply apply apply job job job job job job job"))) == 15
    assert one(spark, text.location(F.lit(""), F.lit(None).cast("string"), F.lit("Canada"))) == "Canada"
    assert one(spark, text.location(F.lit(""))) is None


def test_json_in_text(spark):
    assert one(spark, J.url_answer(F.lit('ok {"career_page_url": "https://a.example"} {"x": 1}'))) == "https://a.example"
    assert one(spark, J.url_answer(F.lit('{"career_page_url": null} https://b.example'))) is None
    assert one(spark, J.url_answer(F.lit("{broken} see https://b.example"))) == "https://b.example"
    got = one(spark, J.route(F.lit('so: {"jobs": [{"title": "A", "url": "u"}], "follow": ["f"]} end')))
    assert got["jobs"][0]["title"] == "A" and got["follow"] == ["f"] and got["next_page"] is None
    assert one(spark, J.route(F.lit("nothing"))) is None
    assert one(spark, J.route(F.lit("{nothing}")))["jobs"] is None


def test_structured_postings_of_every_shape(spark):
    wrap = lambda *blocks: "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)
    pages = [
        (1, wrap('{"@type": "JobPosting", "title": " A ", "description": "<p>x &amp; y</p>", "jobLocation": {"address": {"addressLocality": "T", "addressCountry": "C"}}}')),
        (2, wrap("{broken", '[{"@type": "Thing"}, {"@type": "JobPosting", "title": "B", "jobLocation": {"address": "Town"}}]')),
        (3, wrap('{"@graph": [{"@type": ["JobPosting"], "title": "no"}, {"@type": "JobPosting", "title": "C"}]}')),
        (4, wrap('{"@type": "JobPosting", "description": "first"}', '{"@type": "JobPosting", "title": "D"}', '{"@type": "JobPosting", "title": "late"}')),
        (5, "<p>none</p>"), (6, None), (7, ""),
    ]
    df = spark.createDataFrame(pages, "id int, html string")
    got = {r["id"]: (r["title"], r["description"], r["location"]) for r in J.structured_postings(df, "id", "html").collect()}
    assert got == {1: ("A", "x & y", "T, C"), 2: ("B", None, "Town"), 3: ("C", None, None), 4: ("D", "first", None)}
