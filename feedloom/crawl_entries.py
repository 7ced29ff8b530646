"""Queries of the crawl and of what surrounds it, with SQL written from their specification.

The crawl's pages are made from the feed: every company has a careers page of one of five sorts, by the first digit of a
hash of its name: 0 links its postings, 1 links a board that does, 2 lists roles without pages over several pages that
only a router understands, 3 is a wall against robots, 4 is an outside network. The router is a table of answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import sqltext as Q
from feedloom.entries import NOW, TODAY, _bucketed, _day, _latest, _latest_sql, query
from feedloom.functions import rules, text
from feedloom.operators import coverage, crawl, links, publish, roster
from feedloom.plans.tables import table

C = F.col
_DIGIT = "instr('0123456789abcdef', substr(md5(company), {}, 1)) - 1"
#: Each posting with its company's key k, sort t, page size s, aggregator flag and place within the company.
_WORLD = f"""select row_id, company, coalesce(title, '') as title, coalesce(description, '') as description, status, location, md5(company) as k, ({_DIGIT.format(1)}) % 5 as t,
  case when ({_DIGIT.format(2)}) % 2 = 0 then 5 else 10 end as s, ({_DIGIT.format(3)}) % 2 = 0 as agg, row_number() over (partition by company order by row_id) as rn
  from open_jobs where company is not null"""
_SITE = "'https://c.example/' || k || '/'"
_PAGE_OF = f"{_SITE} || case when rn <= s then 'careers' else 'p' || cast(floor((rn - 1) / s) as int) end"


def _world(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "open_jobs").createOrReplaceTempView("open_jobs_of_the_crawl")
    return spark.sql(_WORLD.replace("from open_jobs", "from open_jobs_of_the_crawl"))


#: The walk of each session and folder; its waves are checkpointed, so several queries read one walk.
_WALKS: dict[tuple[str, str], tuple[crawl.Crawl, DataFrame]] = {}


def _walk(spark: SparkSession, d: str) -> tuple[crawl.Crawl, DataFrame]:
    at = (spark.sparkContext.applicationId, d)
    if at not in _WALKS:
        _WALKS[at] = _walked(spark, d)
    return _WALKS[at]


def _walked(spark: SparkSession, d: str) -> tuple[crawl.Crawl, DataFrame]:
    w = _world(spark, d)
    own, text_ = "array_sort(collect_list(struct(rn, title, row_id)))", "repeat('careers ', 40)"
    sites = w.groupBy("company", "k", "t").agg(F.min("location").alias("location"))
    companies = sites.select("company", F.expr(f"{_SITE} || 'careers'").alias("url"), "location")
    nav = "array(named_struct('t', 'About', 'h', '/about'), named_struct('t', 'Team', 'h', '/team'), named_struct('t', 'Form', 'h', 'mailto:x@c.example'))"
    listed = w.where("t in (0, 1)").groupBy("k", "t").agg(F.expr(own).alias("rows"))
    href = "case when t = 0 then concat('../', k, '/jobs/', x.row_id) else concat('https://jobs.lever.co/', k, '/', md5(cast(x.row_id as string))) end"
    found = f"concat({nav}, transform(rows, x -> named_struct('t', x.title, 'h', {href})))"
    page = lambda url, links_, final=None, body=text_: [F.expr(url).alias("url"), F.expr(final or url).alias("final_url"), F.expr(links_).alias("links"), F.expr(body).alias("text")]
    start = f"{_SITE} || 'careers'"
    pages = [
        listed.select(*page(f"case when t = 0 then {start} else 'https://jobs.lever.co/' || k end", found)),
        sites.where("t = 1").select(*page(start, f"concat({nav}, array(named_struct('t', 'Board', 'h', 'https://jobs.lever.co/' || k)))")),
        w.where("t = 2").selectExpr(f"{_PAGE_OF} as at").distinct().select(*page("at", nav)),
        sites.where("t = 3").select(*page(start, "slice(array(named_struct('t', '', 'h', '')), 1, 0)", body="''")),
        sites.where("t = 4").select(*page(start, nav, "'https://www.linkedin.com/company/' || k")),
    ]
    world = pages[0]
    for p in pages[1:]:
        world = world.unionByName(p)
    on_page = w.where("t = 2").withColumns({"at": F.expr(_PAGE_OF), "page": F.expr("cast(floor((rn - 1) / s) as int)")}).groupBy("at", "k", "page", "agg").agg(F.expr(own).alias("rows"))
    last = w.where("t = 2").groupBy("k").agg(F.expr("cast(floor((max(rn) - 1) / max(s)) as int)").alias("last"))
    answer = F.expr("'I see: ' || to_json(named_struct('jobs', transform(rows, x -> named_struct('title', x.title, 'url', at)), 'next_page', case when page < last then 'p' || (page + 1) end, 'is_aggregator', agg))")
    answers = on_page.join(last, "k").select(C("at").alias("final_url"), answer.alias("answer"))
    walk = crawl.crawl(companies, lambda u: world.join(u, "url", "left_semi"), lambda p: p.select("company", "final_url").join(answers, "final_url", "left"))
    return walk, companies


#: What the walk finds, from the rules alone: postings linked from a page are all candidates of it; a list stops at the page
#: that brings 50 candidates, or after its first page and six more.
_FOUND = f"""(select company, k, t, agg, rn, row_id, location, title, status, description, t = 2 as on_page, {_PAGE_OF} as page_url,
  case when t = 0 then {_SITE} || 'jobs/' || row_id when t = 1 then 'https://jobs.lever.co/' || k || '/' || md5(row_id::varchar) else {_PAGE_OF} end as url from ({_WORLD}) where t in (0, 1) or t = 2 and rn <= least(50, 7 * s))"""
_VIA = f"({Q.any_of('company', rules.RECRUITERS)} or (t = 2 and agg))"


@query(f"select company, title, url, on_page, {_VIA} as via_recruiter from {_FOUND}")
def crawl_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _walk(spark, d)[0].candidates.select("company", "title", "url", "on_page", "via_recruiter")


@query(f"select distinct company, case when t = 3 then 'blocked' else 'linkedin' end as kind, case when t = 3 then {_SITE} || 'careers' else 'https://www.linkedin.com/company/' || k end as url from ({_WORLD}) where t in (3, 4)")
def page_precedence(spark: SparkSession, d: str) -> DataFrame:
    """A wall and an outside network give a pointer, whatever else their page has."""
    return _walk(spark, d)[0].pointers.select("company", "kind", "url")


@query(f"""
with r as (select *, {Q.collapse("title")} as c from {_FOUND} where on_page), f as (select *, row_number() over (partition by company, lower(c) order by rn) as nth from r where c != ''),
o as (select *, row_number() over (partition by company order by rn) as place from f where nth = 1),
l as (select company, min(location) as location from ({_WORLD}) group by 1)
select company, left(c, 140) as title, page_url || '#' || {Q.slug("left(c, 140)")} as url, l.location, case when {_VIA} then company end as via, 'on-page' as source_board from o join l using (company) where place <= 25
""")
def on_page_split(spark: SparkSession, d: str) -> DataFrame:
    walk, companies = _walk(spark, d)
    return crawl.on_page(walk.candidates, companies).select("company", "title", "url", "location", "via", "source_board")


@query(f"select company, url from {_FOUND} where not on_page and rn <= 25")
def linked_split(spark: SparkSession, d: str) -> DataFrame:
    return crawl.linked(_walk(spark, d)[0].candidates).select("company", "url")


@query(f"""select distinct company, case when {_VIA} then company end as via from {_FOUND}""")
def via_attribution(spark: SparkSession, d: str) -> DataFrame:
    return _walk(spark, d)[0].candidates.select("company", F.when(C("via_recruiter"), C("company")).alias("via")).distinct()


@query(f"""
select company, left({Q.collapse(Q.pick_title("title", "title", "title || ' | Careers'", "cast(null as varchar)", "url"))}, 140) as title, url, {Q.label("url", rules.BOARD_LABELS, "own-site")} as source_board,
  left({Q.strip("description")}, 1500) as description from {_FOUND} where not on_page and rn <= 25 and status = 'open' and row_id % 4 != 0 and length({Q.strip("description")}) >= 120
""")
def posting_rows(spark: SparkSession, d: str) -> DataFrame:
    """Linked candidates that are postings: closed ones answer with an error here, every fourth is sent back to its board."""
    walk, _ = _walk(spark, d)
    own = crawl.linked(walk.candidates)
    rows = _world(spark, d).where("t in (0, 1)").select(
        F.expr(f"case when t = 0 then {_SITE} || 'jobs/' || row_id else 'https://jobs.lever.co/' || k || '/' || md5(cast(row_id as string)) end").alias("url"), F.expr("case when coalesce(status, '') != 'open' then 404 else 200 end").alias("status"),
        F.expr(f"case when row_id % 4 = 0 then case when t = 0 then {_SITE} || 'careers' else 'https://jobs.lever.co/' || k end end").alias("board"), C("title").alias("h1"), F.expr("title || ' | Careers'").alias("page_title"),
        C("description").alias("text"), F.lit(None).cast("string").alias("html"),
    )
    fetched = rows.withColumn("final_url", F.coalesce("board", "url")).drop("board")
    return crawl.validated(own, walk.boards, fetched).select("company", "title", "url", "source_board", "description")


_SHOWN = "'- ' || left(coalesce(title, ''), 80) || ' | ' || url"


@query(f"""
select row_id, 'Company: ' || coalesce(company, '') || chr(10) || 'Page: ' || url || chr(10) || left(coalesce(description, ''), 1500) || chr(10) || {_SHOWN} || chr(10) || '- Home | /' as prompt from open_jobs where url is not null
""")
def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    shown = F.expr("array(named_struct('t', title, 'h', url), named_struct('t', '', 'h', cast(null as string)), named_struct('t', 'Home', 'h', '/'))")
    prompt = crawl.router_prompt(F.coalesce("company", F.lit("")), C("url"), C("description"), shown)
    return table(spark, d, "open_jobs").where("url is not null").select("row_id", prompt.alias("prompt"))


# ---- directory, members' pages, responses ---------------------------------------------------------------

_MEMBER_SLUG = "case when regexp_matches(member_id, '^[0-9]+$') then 'member-' || member_id else member_id end"


@query(f"""
with m as (select snapshot_id, {_MEMBER_SLUG} as slug, {Q.strip("company_name")} as name, row_number() over (partition by snapshot_id order by delivered_at, member_id, company_name) as n
  from (select distinct snapshot_id, delivered_at, member_id, company_name from companies_state where member_id is not null and company_name is not null and delivered_at is not null)),
i as (select *, case when regexp_matches(slug, '-[0-9]+$') then regexp_extract(slug, '-([0-9]+)$', 1) else slug end as member_id from m where name != '')
select snapshot_id, member_id, arg_min(name, n) as company_name from i group by 1, 2
""")
def directory_scan(spark: SparkSession, d: str) -> DataFrame:
    """One directory page a snapshot, its rows in order of delivery."""
    rows = table(spark, d, "companies_state").where("member_id is not null and company_name is not null and delivered_at is not null").select("snapshot_id", "delivered_at", "member_id", "company_name").distinct()
    slug = F.expr(_MEMBER_SLUG.replace("regexp_matches(member_id, '^[0-9]+$')", "member_id rlike '^[0-9]+$'"))
    anchor = F.concat(F.lit('<a class="x" HREF="//list.example/memberdirectory/Details/'), slug, F.lit('" rel="r">\n'), text.escape(C("company_name")), F.lit("</a>"))
    pages = rows.groupBy("snapshot_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("delivered_at", "member_id", "company_name", anchor.alias("a")))), lambda x: x["a"]), "<br>").alias("html"))
    return links.directory(pages, "snapshot_id", "html").select("snapshot_id", "member_id", "company_name")


@query(f"""
select distinct snapshot_id, member_id, case when coalesce(status, '') != 'failed' then nullif({Q.strip("website_url")}, '') end as website,
  case when coalesce(status, '') != 'failed' and regexp_full_match(location, '[A-Z][A-Za-z.''\\- ]+') then {Q.strip("location")} || ', NL' end as location from companies_state where member_id is not null
""")
def detail_fields(spark: SparkSession, d: str) -> DataFrame:
    """Website and location of each member's page; pages of failed members answer with an error here."""
    site = F.concat(F.lit('<div CLASS="GZ-details-website">\n<a\nhref="'), F.replace("website_url", F.lit('"'), F.lit("")), F.lit('">site</a></div>'))
    html = F.concat(F.coalesce(site, F.lit("")), F.coalesce(F.concat(F.lit("<span>\n"), C("location"), F.lit(",  NL </span>")), F.lit("")))
    status = F.when(C("status") == "failed", 404).otherwise(200)
    rows = table(spark, d, "companies_state").where("member_id is not null").select("snapshot_id", "member_id", links.detail_fields(status, html).alias("f"))
    return rows.select("snapshot_id", "member_id", "f.website", F.regexp_replace("f.location", r",\s*NL$", ", NL").alias("location")).distinct()


@query("select row_id from open_jobs where row_id % 5 != 0 and (row_id % 3 = 0 or row_id % 3 = 1)")
def fetch_gate(spark: SparkSession, d: str) -> DataFrame:
    """Responses that are pages: every fifth is an error here, every third without a content type, every third not HTML."""
    kind = F.when(C("row_id") % 3 == 1, "text/html; charset=utf-8").when(C("row_id") % 3 == 2, "application/pdf")
    status = F.when(C("row_id") % 5 == 0, 404).otherwise(200)
    return table(spark, d, "open_jobs").where(links.fetch_gate(status, kind)).select("row_id")


# ---- runs, roster transitions, sinks' contents ----------------------------------------------------------


@query(f"""
with r as (select company as company_name, arg_max(coalesce(url, ''), kind || coalesce(url, '')) as url, arg_max(kind, kind || coalesce(url, '')) as kind from pointers where kind is not null group by 1)
select s.member_id, case when r.kind != 'blocked' and r.url != '' then r.url else s.career_page_url end as career_page_url,
  case when r.kind is null or r.kind = 'blocked' then s.status when r.url != '' then 'active' else 'failed' end as status, case when r.kind != 'blocked' and r.url != '' then 'llm' else s.map_method end as map_method,
  case when r.kind != 'blocked' then timestamp '{NOW}' else s.last_checked end as last_checked from {_latest_sql(8)} s left join r on s.company_name = r.company_name
""")
def router_transition(spark: SparkSession, d: str) -> DataFrame:
    """Members after a router's run; its answers are the pointers, those of kind blocked being calls that failed."""
    results = table(spark, d, "pointers").where("kind is not null").select(C("company").alias("company_name"), "url", (C("kind") == "blocked").alias("failed"), F.concat("kind", F.coalesce("url", F.lit(""))).alias("ord"))
    state = _latest(spark, d, 8)
    now = F.lit(NOW).cast(state.schema["last_checked"].dataType)
    return roster.router_results(state, results, now).select("member_id", "career_page_url", "status", "map_method", "last_checked")


_ELIGIBLE = f"(select distinct company_name from {_latest_sql(8)} where status = 'active' and career_page_url != '' and company_name is not null)"


def _eligible(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d, 8).where("status = 'active' and career_page_url != '' and company_name is not null").select("company_name", C("company_name").alias("ord")).distinct()


@query(f"""
select coalesce(c.company_name, a.company_name) as company_name, case when c.company_name is not null then date '{TODAY}' else a.last_scraped end as last_scraped
from (select company_name, max(last_scraped) as last_scraped from scrape_state group by 1) a full join {_ELIGIBLE} c on a.company_name = c.company_name
""")
def attempt_stamp(spark: SparkSession, d: str) -> DataFrame:
    return roster.stamped(table(spark, d, "scrape_state"), _eligible(spark, d), _day(TODAY))


@query(f"""
with c as {_ELIGIBLE}, a as (select company_name, max(last_scraped) as last_scraped from scrape_state group by 1), p as (select min(company_name) as one from c)
select 'company' as given, company_name from c where lower(company_name) = (select lower(one) from p) union all
select 'batch', company_name from (select company_name from c left join a using (company_name) order by last_scraped nulls first, company_name limit 7) union all
select 'limit', company_name from (select company_name from c order by 1 limit 5) union all select 'none', company_name from c
""")
def run_selection(spark: SparkSession, d: str) -> DataFrame:
    """A run's companies by what is given: a name goes before a batch, a batch before a limit."""
    c, a = _eligible(spark, d), table(spark, d, "scrape_state")
    one = (c.agg(F.min("company_name")).first()[0] or "").upper()
    given = {"company": {"company": one, "batch": 7, "limit": 5}, "batch": {"batch": 7, "limit": 5}, "limit": {"limit": 5}, "none": {}}
    parts = [roster.selection(c, a, **v).select(F.lit(k).alias("given"), "company_name") for k, v in given.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("select member_id, snapshot_id, coalesce(strftime(last_checked, '%Y-%m-%d %H:%M:%S') || ' UTC', '') as shown, count(*) as n from companies_state group by all")
def timestamp_display(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.date_format("last_checked", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return table(spark, d, "companies_state").groupBy("member_id", "snapshot_id", text.display_time(stamp).alias("shown")).agg(F.count("*").alias("n"))


@query(f"""
select row_id, coalesce(url, '') as link, coalesce(title, '') as title, coalesce(company, '') as company, nullif(location, '') as location, coalesce(nullif(source_board, ''), 'own-site') as badge,
  case when date_diff('day', first_seen, date '{TODAY}') <= 7 then 'new' end as mark, nullif(description, '') as description from open_jobs where status = 'open'
""")
def result_card(spark: SparkSession, d: str) -> DataFrame:
    shown = publish.card(C("url"), C("title"), C("company"), C("location"), C("source_board"), publish.is_new(C("first_seen"), _day(TODAY)), C("description"))
    return table(spark, d, "open_jobs").where("status = 'open'").select("row_id", shown.alias("c")).select("row_id", "c.*")


@query(f"""
select '{TODAY}' as generated, (select count(*) from open_jobs where status = 'open') as open_count, (select count(*) from open_jobs) as total_tracked,
  (select count(*) from known_buckets where bucket = 'not_in_roster') as not_in_roster, (select count(*) from known_buckets where bucket = 'scrape_gap') as scrape_gap
""".replace("(select count(*) from known_buckets", "(select count(*) from " + "{buckets}"))
def summary_document(spark: SparkSession, d: str) -> DataFrame:
    """The summary with the coverage document in it, read back from its JSON."""
    doc = publish.summary_document(publish.summary(table(spark, d, "open_jobs"), _day(TODAY)), coverage.document(_bucketed(spark, d), TODAY), TODAY)
    at = lambda p, kind: F.try_variant_get(F.parse_json("value"), p, kind)
    return doc.select(
        at("$.generated", "string").alias("generated"), at("$.open_count", "bigint").alias("open_count"), at("$.total_tracked", "bigint").alias("total_tracked"),
        F.size(at("$.coverage.not_in_roster", "array<variant>")).cast("long").alias("not_in_roster"), F.size(at("$.coverage.scrape_gap", "array<variant>")).cast("long").alias("scrape_gap"),
    )


from feedloom.entries import _BUCKETS, SQL  # noqa: E402

SQL["summary_document"] = SQL["summary_document"].replace("{buckets}", _BUCKETS)
