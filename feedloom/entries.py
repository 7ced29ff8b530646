"""The queries of the core library, and the DuckDB SQL that each is checked against.

Every query reads its tables whole. Dates are parameters fixed here, so results don't depend on the clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import sqltext as Q
from feedloom.functions import json as J
from feedloom.functions import rules, text, urls
from feedloom.operators import coverage, frontier, links, merge, publish, roster
from feedloom.operators.distinct import first_success as first_success_
from feedloom.operators.distinct import keep_first, keep_last, numbered, top_n
from feedloom.operators.snapshot_diff import snapshot_diff
from feedloom.plans.tables import table
from feedloom.sources.files import markdown_rows
from feedloom.sources.paged import paged

TODAY, NOW, SPLIT = "2027-04-20", "2027-04-20 12:00:00", "2027-01-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
C = F.col


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__.rstrip("_")] = f
        if sql:
            SQL[f.__name__.rstrip("_")] = sql
        return f

    return add


def _day(s: str) -> Column:
    return F.lit(s).cast("date")


def _latest(spark: SparkSession, d: str, snapshot: int) -> DataFrame:
    """One row a member of a roster snapshot: the latest delivered, among equals the greatest."""
    rows = table(spark, d, "companies_state").where((C("snapshot_id") == snapshot) & C("member_id").isNotNull()).drop("snapshot_id", "snapshot_date")
    rest = [c for c in rows.columns if c not in ("member_id", "delivered_at")]
    return rows.groupBy("member_id").agg(F.max(F.struct("delivered_at", *rest)).alias("m")).select("member_id", *[C(f"m.{c}") for c in rest])


_ROSTER = "company_name, website_url, location, career_page_url, status, map_method, last_checked"


def _latest_sql(snapshot: int) -> str:
    order = ", ".join(f"{c} desc nulls last" for c in ["delivered_at", *_ROSTER.split(", ")])
    return f"(select * from (select member_id, {_ROSTER}, row_number() over (partition by member_id order by {order}) as rn from companies_state where snapshot_id = {snapshot} and member_id is not null) where rn = 1)"


# ---- urls and texts ------------------------------------------------------------------------------------


@query(f"select row_id, {Q.canon('url')} as canon from open_jobs")
def canon_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "open_jobs").select("row_id", urls.canon_url(C("url")).alias("canon"))


@query(f"select row_id, {Q.host('url')} as host from open_jobs")
def host_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "open_jobs").select("row_id", urls.host_of(C("url")).alias("host"))


@query(f"select website_url, {Q.domain('website_url')} as domain, count(*) as n from companies_state group by all")
def norm_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies_state").groupBy("website_url", urls.norm_domain(C("website_url")).alias("domain")).agg(F.count("*").alias("n"))


@query(f"select website_url, {Q.root('website_url')} as root, count(*) as n from companies_state group by all")
def root_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies_state").groupBy("website_url", urls.root_url(C("website_url")).alias("root")).agg(F.count("*").alias("n"))


_SEEN = f"(select distinct {Q.root('url')} as root from open_jobs)"


@query(f"""
with base as (select distinct member_id, {Q.root("website_url")} as base from companies_state where website_url is not null and member_id is not null),
alt as (select member_id, base, 0 as ord, base as url from base union all
        select member_id, base, 1, case when regexp_matches(base, '://www\\.') then regexp_replace(base, '://www\\.', '://') else regexp_replace(base, '://', '://www.') end from base)
select a.member_id, a.base, arg_min(a.url, case when s.root is not null then a.ord end) as value
from alt a left join {_SEEN} s on a.url = s.root group by all
""")
def first_success(spark: SparkSession, d: str) -> DataFrame:
    """Of a site's root with and without www. the first that the feed has postings of."""
    base = table(spark, d, "companies_state").where("website_url is not null and member_id is not null").select("member_id", urls.root_url(C("website_url")).alias("base")).distinct()
    both = base.select("*", F.posexplode(F.array("base", urls.toggle_www(C("base")))).alias("ord", "url"))
    seen = table(spark, d, "open_jobs").select(urls.root_url(C("url")).alias("url")).distinct().withColumn("seen", F.lit(True))
    return first_success_(both.join(seen, "url", "left"), ["member_id", "base"], C("seen").isNotNull(), C("ord"), C("url"))


_HREFS = "['/a/b', '//other.example/x', '?q=1', '#part', 'c/d', 'https://full.example/y', 'mailto:a@b.example', '', '../d', './e', '/a/../f', 'g/../../h?i=../j', '..']"


@query(rf"""
with h as (select row_id, regexp_replace({Q.clean("url")}, '\s+$', '') as base, unnest({_HREFS}) as href from open_jobs),
p as (select *, regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1) as scheme, regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) as root, regexp_extract(base, '^([^?#]*)', 1) as page from h),
f as (select *, regexp_extract(page, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/]*/.*/|[A-Za-z][A-Za-z0-9+.\-]*://[^/]*/)', 1) as folder from p)
select row_id, href, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:') then href when href = '' then base when starts_with(href, '//') then scheme || ':' || href
 when href = '/a/../f' then root || '/f' when href = '../d' then up || 'd' when href = './e' then dir || 'e' when href = 'g/../../h?i=../j' then up || 'h?i=../j' when href = '..' then up
 when starts_with(href, '/') then root || href when starts_with(href, '?') then page || href when starts_with(href, '#') then regexp_extract(base, '^([^#]*)', 1) || href else dir || href end as url
from (select *, case when regexp_matches(dir, '://[^/]*/$') then dir else regexp_replace(dir, '[^/]+/$', '') end as up from (select *, case when folder = '' then root || '/' else folder end as dir from f))
""")
def links_absolute(spark: SparkSession, d: str) -> DataFrame:
    base = F.regexp_replace(urls.cleaned(C("url")), r"\s+$", "")
    rows = table(spark, d, "open_jobs").select("row_id", base.alias("base"), F.explode(F.expr("array" + _HREFS.replace("[", "(").replace("]", ")"))).alias("href"))
    return rows.select("row_id", "href", urls.absolute(C("base"), C("href")).alias("url"))


@query(f"""
select row_id, {Q.job_post("url")} as is_post, {Q.any_of("url", rules.BOARD_HOSTS)} as is_board, {Q.any_of("url", rules.MAPPER_HOSTS)} as is_mapper,
  coalesce({Q.any_of("title", rules.LINK_HINTS)}, false) or regexp_matches(lower(url), {Q.quoted(rules.CAREERS_HREF)}) as is_careers from open_jobs
""")
def url_classify(spark: SparkSession, d: str) -> DataFrame:
    u = C("url")
    return table(spark, d, "open_jobs").select(
        "row_id", rules.is_job_post(u).alias("is_post"), rules.contains_any(u, rules.BOARD_HOSTS).alias("is_board"), rules.contains_any(u, rules.MAPPER_HOSTS).alias("is_mapper"),
        links.careers_link(F.coalesce("title", F.lit("")), u).alias("is_careers"),
    )


@query(f"select row_id, {Q.label('url', rules.BOARD_LABELS, 'own-site')} as board, {Q.label(Q.host('url'), rules.EXTERNAL_KINDS)} as kind from open_jobs")
def source_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "open_jobs").select(
        "row_id", rules.first_label(C("url"), rules.BOARD_LABELS, "own-site").alias("board"), rules.first_label(urls.host_of(C("url")), rules.EXTERNAL_KINDS).alias("kind")
    )


@query(f"select row_id, {Q.feed_key('on_page', 'company', 'title', 'url')} as key from open_jobs")
def feed_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "open_jobs").select("row_id", urls.feed_key(C("on_page"), C("company"), C("title"), C("url")).alias("key"))


@query(f"select row_id, {Q.slug('title')} as slug from open_jobs")
def slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "open_jobs").select("row_id", text.slug(C("title")).alias("slug"))


@query(f"select row_id, {Q.slug_title('url')} as title from open_jobs")
def slug_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "open_jobs").select("row_id", text.slug_title(C("url")).alias("title"))


@query(f"""select row_id, {Q.pick_title("title", "case when on_page then title else 'Careers' end", "title || ' - ' || company", "case when status = 'open' then title end", "url")} as picked from open_jobs""")
def title_cascade(spark: SparkSession, d: str) -> DataFrame:
    h1, structured = F.when(C("on_page"), C("title")).otherwise("Careers"), F.when(C("status") == "open", C("title"))
    page_title = F.concat(C("title"), F.lit(" - "), C("company"))
    return table(spark, d, "open_jobs").select("row_id", text.pick_title(C("title"), h1, page_title, structured, C("url")).alias("picked"))


@query(f"select company, {Q.name('company')} as key, count(*) as n from open_jobs group by all")
def name_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "open_jobs").groupBy("company").agg(F.count("*").alias("n")).select("company", text.normalize_name(C("company")).alias("key"), "n")


@query(f"select row_id, left({Q.collapse('title')}, 140) as title, left({Q.collapse('description')}, 1500) as description from open_jobs")
def text_clip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "open_jobs").select("row_id", text.clip(text.collapse(C("title")), 140).alias("title"), text.clip(text.collapse(C("description")), 1500).alias("description"))


@query("select row_id, coalesce(title, '') || coalesce(description, '') as text from open_jobs")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("<h1>"), text.escape(C("title")), F.lit("</h1><p>"), text.escape(C("description")), F.lit("</p>"))
    return table(spark, d, "open_jobs").select("row_id", text.html_to_text(page).alias("text"))


@query("select row_id, replace(replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as escaped from open_jobs")
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "open_jobs").select("row_id", text.escape(C("title")).alias("escaped"))


@query("select row_id, nullif(concat_ws(', ', nullif(location, ''), nullif(source_board, ''), nullif(via, '')), '') as place from open_jobs")
def location_concat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "open_jobs").select("row_id", text.location(C("location"), C("source_board"), C("via")).alias("place"))


@query(f"select distinct company_name, coalesce({Q.any_of('company_name', rules.RECRUITERS)}, false) as recruiter from companies_state")
def recruiter_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies_state").select("company_name", F.coalesce(rules.contains_any(C("company_name"), rules.RECRUITERS), F.lit(False)).alias("recruiter")).distinct()


@query("select row_id, company from open_jobs where lower(company) = lower('QUELLHARROW Atlantic Group')")
def ci_equality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "open_jobs").where(F.lower("company") == F.lower(F.lit("QUELLHARROW Atlantic Group"))).select("row_id", "company")


@query(f"select doc_id, {Q.any_of('text', rules.RATE_LIMIT_SIGNS)} as flag from documents")
def text_flag_any(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rules.contains_any(C("text"), rules.RATE_LIMIT_SIGNS).alias("flag"))


@query(r"""
select row_id, regexp_extract(description, '(?:office in|bureau de) ([A-Z][A-Za-z.''\- ]+?)(?: before|\.| avant)', 1) as office, regexp_extract(description, '(?i)salary starts at (\d+)', 1) as salary from open_jobs where description is not null
""")
def regex_extract_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "open_jobs").where("description is not null").select(
        "row_id", F.regexp_extract("description", r"(?:office in|bureau de) ([A-Z][A-Za-z.'\- ]+?)(?: before|\.| avant)", 1).alias("office"),
        F.regexp_extract("description", r"(?i)salary starts at (\d+)", 1).alias("salary"),
    )


_ANSWER = """case when status = 'open' then 'Sure: {"career_page_url": "' || regexp_replace(url, '[^A-Za-z0-9:/.?=&#-]', '', 'g') || '"} done' when status = 'closed' then 'see ' || url || ' for it' end"""


@query(f"""
with a as (select row_id, {_ANSWER} as answer from open_jobs), o as (select row_id, answer, regexp_extract(answer, '(?s)\\{{.*?\\}}', 0) as obj from a)
select row_id, case when obj != '' and json_valid(obj) then json_extract_string(obj, '$.career_page_url') else nullif(regexp_extract(answer, 'https?://[^\\s"'']+', 0), '') end as url from o
""")
def json_from_text(spark: SparkSession, d: str) -> DataFrame:
    safe = F.regexp_replace("url", r"[^A-Za-z0-9:/.?=&#-]", "")
    answer = F.when(C("status") == "open", F.concat(F.lit('Sure: {"career_page_url": "'), safe, F.lit('"} done'))).when(C("status") == "closed", F.concat(F.lit("see "), C("url"), F.lit(" for it")))
    return table(spark, d, "open_jobs").select("row_id", J.url_answer(answer).alias("url"))


@query("""select row_id, 1 as jobs, title as first_title, url as next_page from open_jobs where title is not null""")
def route_from_text(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit("I think: "), F.to_json(F.struct(F.array(F.struct("title", "url")).alias("jobs"), C("url").alias("next_page"))), F.lit(" ok"))
    rows = table(spark, d, "open_jobs").where("title is not null").select("row_id", J.route(answer).alias("r"))
    return rows.select("row_id", F.size("r.jobs").alias("jobs"), C("r.jobs")[0]["title"].alias("first_title"), C("r.next_page").alias("next_page"))


@query(rf"""
select row_id, nullif({Q.strip("title")}, '') as title,
  nullif(replace(replace(replace(replace(regexp_replace(description, '(?s)<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), '') as description, concat_ws(', ', nullif(location, ''), 'NL') as location from open_jobs
""")
def jsonld_extract(spark: SparkSession, d: str) -> DataFrame:
    """Structured postings of every posting's page, built in the three shapes that occur in the wild."""
    posting = F.struct(F.lit("JobPosting").alias("@type"), "title", "description", F.struct(F.struct(C("location").alias("addressLocality"), F.lit("NL").alias("addressRegion")).alias("address")).alias("jobLocation"))
    block = lambda json: F.concat(F.lit('<script type="application/ld+json">'), F.replace(json, F.lit("</"), F.lit("<\\/")), F.lit("</script>"))
    page = F.concat(F.lit("<script type='application/ld+json'>{broken</script>"), F.when(C("status") == "open", block(F.to_json(F.array(posting)))).otherwise(block(F.to_json(F.struct(F.array(posting).alias("@graph"))))))
    return J.structured_postings(table(spark, d, "open_jobs").select("row_id", page.alias("html")), "row_id", "html")


# ---- pages and links -----------------------------------------------------------------------------------

_PAGE = """'<h1>' || coalesce(title, '') || '</h1><a class="x" href="' || url || '"> <b>' || coalesce(title, '') || '</b> </a><a href="#top">Top</a><A HREF=''mailto:jobs@x.example''>Mail us</A>'"""
_A = r"""(?is)<a\s[^>]*href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>"""


@query(rf"""
with p as (select row_id, {_PAGE} as html from open_jobs), a as (select row_id, regexp_extract_all(html, '{_A}', 1) as h, regexp_extract_all(html, '{_A}', 2) as t from p),
l as (select row_id, unnest(generate_series(1, len(h))) as i, h, t from a)
select row_id, (i - 1)::int as ord, {Q.strip("h[i]")} as href, {Q.collapse("regexp_replace(t[i], '(?s)<[^>]+>', '', 'g')")} as text,
  ({Q.strip("h[i]")} != '' and not regexp_matches({Q.strip("h[i]")}, '^(#|mailto:|tel:|javascript:)')) as leads from l
""")
def links_extract(spark: SparkSession, d: str) -> DataFrame:
    title = F.coalesce("title", F.lit(""))
    page = F.concat(F.lit("<h1>"), title, F.lit('</h1><a class="x" href="'), C("url"), F.lit('"> <b>'), title, F.lit("</b> </a><a href=\"#top\">Top</a><A HREF='mailto:jobs@x.example'>Mail us</A>"))
    found = links.anchors(table(spark, d, "open_jobs").select("row_id", page.alias("html")), "row_id", "html")
    return found.select("row_id", "ord", "href", "text", links.navigable(C("href")).alias("leads"))


_ROUTE_PAGE = "case when row_id % 5 = 0 then 'https://www.linkedin.com/company/' else 'https://board.example/' end || coalesce(source_board, 'own') || (row_id % 7)"
_ROUTE_HREF = "case when row_id % 7 = 3 then 'https://jobs.lever.co/' || (row_id % 11) when row_id % 7 > 3 then '/about' else url end"


@query(rf"""
with l as (select {_ROUTE_PAGE} as final_url, row_id, {Q.strip(_ROUTE_HREF)} as u from open_jobs where url is not null),
a as (select *, case when starts_with(u, '/') then regexp_extract(final_url, '^([a-z]+://[^/]+)', 1) || u else u end as url from l),
p as (select final_url, count(distinct {Q.canon("url")}) as jobs from a where {Q.job_post("url")} group by 1),
b as (select final_url, {Q.canon("url")} as k, min(row_id) as r, arg_min(url, row_id) as url from a where {Q.any_of("url", rules.BOARD_HOSTS)} and not {Q.job_post("url")} and {Q.host("url")} != {Q.host("final_url")} group by 1, 2),
f as (select final_url, array_to_string(list(url order by r), ' ') as follow from (select *, row_number() over (partition by final_url order by r) as n from b) where n <= 3 group by 1),
k as (select distinct final_url, {Q.label(Q.host("final_url"), rules.EXTERNAL_KINDS)} as kind from l)
select k.final_url, coalesce(p.jobs, 0)::int as jobs, case when p.jobs is null then k.kind end as external, case when p.jobs is null and k.kind is null then f.follow end as follow
from k left join p using (final_url) left join f using (final_url)
""")
def heuristic_route(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "open_jobs").where("url is not null")
    linked = rows.select(F.expr(_ROUTE_PAGE).alias("final_url"), C("row_id").alias("ord"), text.strip(F.expr(_ROUTE_HREF)).alias("href"), F.coalesce("title", F.lit("")).alias("text"))
    return links.route(linked).select("final_url", F.coalesce(F.size("jobs"), F.lit(0)).alias("jobs"), "external", F.array_join("follow", " ").alias("follow"))


@query(f"""
select row_id, coalesce({Q.any_of("url", rules.BLOCKED_MARKS)}, false) or coalesce(length(description) < 200, false) as wall from open_jobs
""")
def blocked_gate(spark: SparkSession, d: str) -> DataFrame:
    wall = links.blocked(C("url"), F.lit(1), C("description"))
    return table(spark, d, "open_jobs").select("row_id", F.coalesce(wall, rules.contains_any(C("url"), rules.BLOCKED_MARKS)).alias("wall"))


@query(f"""
with p as (select row_id, url, description, case when status = 'closed' and last_seen < date '2026-01-01' then 404 end as code from open_jobs)
select row_id from p where coalesce(code, 0) < 400 and regexp_replace({Q.path("url")}, '/+$', '') != '' and length({Q.strip("description")}) >= 120
  and {Q.canon("url")} not in (select {Q.canon("url")} from pointers where url is not null)
""")
def posting_gate(spark: SparkSession, d: str) -> DataFrame:
    code = F.when((C("status") == "closed") & (C("last_seen") < _day("2026-01-01")), 404)
    pages = table(spark, d, "open_jobs").select("row_id", code.alias("status"), C("url").alias("final_url"), C("description").alias("text"))
    boards = table(spark, d, "pointers").where("url is not null").select(urls.canon_url(C("url")).alias("key"))
    return links.posting_gate(pages, boards).select("row_id")


_SCORED = f"""(select row_id, company, url, case when {Q.any_of("url", rules.MAPPER_HOSTS)} then 10 else {Q.score("url", "description")} end as score, {Q.any_of("url", rules.MAPPER_HOSTS)} as board,
  (regexp_replace({Q.path("url")}, '/+$', '') = '' and not coalesce(on_page, false)) as bounced from open_jobs where description is not null)"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    why = F.when(F.coalesce("on_page", F.lit(False)), "homepage-careers-link").otherwise("path-probe")
    return table(spark, d, "open_jobs").where("description is not null").select("row_id", "company", C("row_id").alias("ord"), "url", why.alias("why"), C("description").alias("text"))


@query(f"select row_id, score from {_SCORED} where board or (not bounced and score >= 4)")
def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    return links.scored(_pages(spark, d)).select("row_id", "score")


@query(f"select company, arg_min(row_id, [-score, row_id]) as row_id, max(score) as score from {_SCORED} where (board or (not bounced and score >= 4)) and company is not null group by 1")
def top1_candidate(spark: SparkSession, d: str) -> DataFrame:
    best = keep_first(links.scored(_pages(spark, d)).where("company is not null"), ["company"], -C("score"), C("ord"))
    return best.select("company", "row_id", "score")


@query(f"""
with p as (select row_id, case when row_id % 3 = 0 then {Q.root("url")} || '/' else url end as url, coalesce(on_page, false) or row_id % 2 = 0 as linked from open_jobs where url is not null)
select row_id from p where not (regexp_replace({Q.path("url")}, '/+$', '') = '' and not linked and not {Q.any_of("url", rules.MAPPER_HOSTS)})
""")
def page_gate(spark: SparkSession, d: str) -> DataFrame:
    """Pages that stay after those go that a path probe was sent to the root from; every third page here was sent there."""
    url = F.when(C("row_id") % 3 == 0, F.concat(urls.root_url(C("url")), F.lit("/"))).otherwise(C("url"))
    linked = F.coalesce("on_page", F.lit(False)) | (C("row_id") % 2 == 0)
    pages = table(spark, d, "open_jobs").where("url is not null").select("row_id", url.alias("url"), F.when(linked, "homepage-careers-link").otherwise("path-probe").alias("why"))
    return pages.where(~links.soft_404(C("url"), C("why"))).select("row_id")


_PATHS = "[" + ", ".join(f"'{p}'" for p in rules.PROBE_PATHS) + "]"


@query(f"""
with r as (select distinct {Q.root("website_url")} as root from companies_state), u as (select root, unnest({_PATHS}) as path from r where root is not null)
select root, regexp_replace(regexp_extract(root || path, '^([^#]*)', 1), '/+$', '') as url from u group by all
""")
def path_probe_cross(spark: SparkSession, d: str) -> DataFrame:
    """Every root with every probe path, without repetitions; the paths are an array of the row, so nothing is joined."""
    roots = table(spark, d, "companies_state").select(urls.root_url(C("website_url")).alias("root")).where("root is not null").distinct()
    probes = roots.select("root", F.explode(F.array(*map(F.lit, rules.PROBE_PATHS))).alias("path"))
    return probes.select("root", urls.dedup_key(F.concat("root", "path")).alias("url")).distinct()


@query("""
with recursive e as (select distinct company as node, url as next from pointers where company is not null and url is not null union
                     select distinct url, kind from pointers where url is not null and kind is not null union
                     select distinct kind, company from pointers where kind is not null and company is not null),
ranked as (select node, next, row_number() over (partition by node order by next) as rn from e),
first3 as (select node, next from ranked where rn <= 3),
h0 as (select distinct kind as root, kind as node from pointers where kind is not null),
h1 as (select distinct h0.root, f.next as node from h0 join first3 f on f.node = h0.node where (h0.root, f.next) not in (select root, node from h0)),
h2 as (select distinct h1.root, f.next as node from h1 join first3 f on f.node = h1.node where (h1.root, f.next) not in (select root, node from h0 union select root, node from h1))
select root, node, 0 as hop from h0 union all select root, node, 1 from h1 union all select root, node, 2 from h2
""")
def bounded_bfs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pointers")
    edge = lambda a, b: p.where(C(a).isNotNull() & C(b).isNotNull()).select(C(a).alias("node"), C(b).alias("ord"), C(b).alias("next"))
    edges = edge("company", "url").unionByName(edge("url", "kind")).unionByName(edge("kind", "company")).distinct()
    seeds = p.where("kind is not null").select(C("kind").alias("root"), C("kind").alias("node")).distinct()
    return frontier.expand(seeds, frontier.along(edges))


# ---- distinct, top-k, groups ---------------------------------------------------------------------------


@query(f"select row_id from (select row_id, row_number() over (partition by {Q.canon('url')} order by row_id) as rn from open_jobs) where rn = 1")
def distinct_keep_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "open_jobs").select("row_id", urls.canon_url(C("url")).alias("key"))
    return keep_first(rows, ["key"], C("row_id")).select("row_id")


@query(f"select row_id from (select row_id, row_number() over (partition by {Q.canon('url')} order by row_id desc) as rn from open_jobs) where rn = 1")
def distinct_keep_last(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "open_jobs").select("row_id", urls.canon_url(C("url")).alias("key"))
    return keep_last(rows, ["key"], C("row_id")).select("row_id")


@query("select source_board, row_id, rn::int as rank from (select source_board, row_id, row_number() over (partition by source_board order by first_seen desc nulls last, row_id) as rn from open_jobs) where rn <= 25")
def topn_per_group(spark: SparkSession, d: str) -> DataFrame:
    return top_n(table(spark, d, "open_jobs").select("source_board", "row_id", "first_seen"), 25, ["source_board"], C("first_seen").desc_nulls_last(), C("row_id")).select("source_board", "row_id", "rank")


_EXTERNAL = f"""(select {Q.name("n")} as key, arg_min(n, known_id) as company_name, count(*) as job_count, array_to_string(list_sort(list_distinct(list(nullif(job_url, '')))), ' ') as urls
  from (select known_id, job_url, coalesce(nullif(company, ''), 'Unknown') as n from known_jobs) group by 1)"""


def _external(spark: SparkSession, d: str) -> DataFrame:
    return coverage.grouped(table(spark, d, "known_jobs"), "company", "job_url", "known_id")


def _joined_urls(df: DataFrame) -> DataFrame:
    return df.withColumn("urls", F.array_join("urls", " "))


@query(f"select key, company_name, job_count, coalesce(urls, '') as urls from {_EXTERNAL}")
def group_collect_urls(spark: SparkSession, d: str) -> DataFrame:
    return _joined_urls(_external(spark, d))


_R, _F = f"(select distinct {Q.name('company_name')} as key from companies_state)", f"(select distinct {Q.name('company')} as key from open_jobs)"
_BUCKETS = f"""(select x.*, case when r.key is null then 'not_in_roster' when f.key is null then 'scrape_gap' else 'overlap' end as bucket
  from {_EXTERNAL} x left join {_R} r on x.key = r.key left join {_F} f on x.key = f.key)"""


def _bucketed(spark: SparkSession, d: str) -> DataFrame:
    return coverage.buckets(_external(spark, d), table(spark, d, "companies_state").select("company_name"), table(spark, d, "open_jobs").select("company"))


@query(f"select bucket, count(*) as n, sum(job_count)::bigint as jobs from {_BUCKETS} group by 1")
def coverage_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _bucketed(spark, d).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("job_count").alias("jobs"))


@query(f"select key, company_name, job_count, coalesce(urls, '') as urls from {_BUCKETS} where bucket = 'not_in_roster'")
def coverage_not_in_roster(spark: SparkSession, d: str) -> DataFrame:
    r = coverage.keys(table(spark, d, "companies_state"), "company_name")
    return _joined_urls(_external(spark, d).join(r, "key", "left_anti"))


@query(f"select key, company_name, job_count, coalesce(urls, '') as urls from {_BUCKETS} where bucket = 'scrape_gap'")
def coverage_gap(spark: SparkSession, d: str) -> DataFrame:
    r, f = coverage.keys(table(spark, d, "companies_state"), "company_name"), coverage.keys(table(spark, d, "open_jobs"), "company")
    return _joined_urls(_external(spark, d).join(r, "key", "left_semi").join(f, "key", "left_anti"))


_LISTED = "coalesce((select array_to_string(list(company_name || ' ' || job_count || ' ' || coalesce(urls, '') order by lower(company_name), company_name, job_count), '; ') from b where bucket = '{}'), '')"


@query(f"with b as {_BUCKETS} select '{TODAY}' as generated, {_LISTED.format('not_in_roster')} as not_in_roster, {_LISTED.format('scrape_gap')} as scrape_gap, (select count(*) from b where bucket = 'overlap') as overlap")
def coverage_document(spark: SparkSession, d: str) -> DataFrame:
    doc = coverage.document(_bucketed(spark, d), TODAY)
    shown = lambda b: F.array_join(F.transform(b, lambda e: F.concat_ws(" ", e["company_name"], e["job_count"].cast("string"), F.array_join(e["urls"], " "))), "; ").alias(b)
    return doc.select("generated", shown("not_in_roster"), shown("scrape_gap"), "overlap")


@query(f"select bucket, '- ' || company_name || ' (' || job_count || '): ' || coalesce(urls, '') as line from {_BUCKETS} where bucket != 'overlap'")
def coverage_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("- "), C("company_name"), F.lit(" ("), C("job_count"), F.lit("): "), F.array_join("urls", " "))
    return _bucketed(spark, d).where("bucket != 'overlap'").select("bucket", line.alias("line"))


# ---- roster ---------------------------------------------------------------------------------------------


@query("select snapshot_id, member_id, company_name from companies_state where status = 'active' and career_page_url != ''")
def eligible_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies_state").where("status = 'active' and career_page_url != ''").select("snapshot_id", "member_id", "company_name")


@query("select snapshot_id, member_id from companies_state where status in ('failed', 'pending') and website_url != ''")
def status_in(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies_state").where(C("status").isin("failed", "pending") & (C("website_url") != "")).select("snapshot_id", "member_id")


@query(f"""
select snapshot_id, member_id, case when coalesce(status = 'inactive', false) then false when coalesce(status = 'failed', false) or coalesce(career_page_url, '') = '' then true when last_checked is null then true
  else floor(epoch(timestamp '{NOW}' - last_checked) / 86400) > 30 end as due from companies_state
""")
def needs_mapping(spark: SparkSession, d: str) -> DataFrame:
    due = roster.needs_mapping(C("status"), C("career_page_url"), C("last_checked"), F.lit(NOW).cast("timestamp"))
    return table(spark, d, "companies_state").withColumn("last_checked", C("last_checked").cast("timestamp")).select("snapshot_id", "member_id", due.alias("due"))


_LIVE, _PRIOR = _latest_sql(8), _latest_sql(7)
_RECONCILED = f"""
with live as {_LIVE}, prior as (select *, {Q.domain("website_url")} as domain from {_PRIOR}),
n as (select *, lower(company_name) as name, row_number() over (partition by lower(company_name) order by member_id desc) as k from prior where company_name is not null),
m as (select *, row_number() over (partition by domain order by member_id) as k from prior where domain != ''),
j as (select l.member_id, l.company_name, l.website_url, l.location,
  case when p1.member_id is not null then 1 when n.member_id is not null then 2 when m.member_id is not null then 3 end as how,
  {", ".join(f"case when p1.member_id is not null then p1.{c} when n.member_id is not null then n.{c} else m.{c} end as p_{c}" for c in ("website_url", "location", "career_page_url", "status", "map_method", "last_checked"))}
  from live l left join prior p1 on l.member_id = p1.member_id left join n on n.k = 1 and n.name = lower(l.company_name) left join m on m.k = 1 and m.domain = {Q.domain("l.website_url")}),
members as (select member_id, company_name, coalesce(nullif(website_url, ''), p_website_url) as website_url, coalesce(nullif(location, ''), p_location) as location,
  case when coalesce(p_career_page_url, '') != '' then p_career_page_url end as career_page_url,
  case when coalesce(p_career_page_url, '') != '' then p_status when p_status = 'failed' then 'failed' else 'pending' end as status,
  case when coalesce(p_career_page_url, '') != '' then p_map_method end as map_method,
  case when coalesce(p_career_page_url, '') != '' or p_status = 'failed' then p_last_checked end as last_checked, case when how is null then 'fresh' else 'carried' end as origin from j),
gone as (select member_id, company_name, website_url, location, career_page_url, 'inactive' as status, map_method, last_checked, 'departed' as origin from prior
  where member_id not in (select member_id from live) and (company_name is null or lower(company_name) not in (select lower(company_name) from live where company_name is not null))),
state as (select * from members union all select * from gone)
"""


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    live, prior = (_latest(spark, d, s).withColumn("ord", C("member_id")) for s in (8, 7))
    return roster.reconcile(live.select("member_id", "company_name", "website_url", "location", "ord"), prior)


@query(_RECONCILED + "select * from state")
def roster_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d)


@query(_RECONCILED + "select origin, count(*) as n from state group by 1")
def roster_counts(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d).groupBy("origin").agg(F.count("*").alias("n"))


@query(f"""
with l as (select distinct snapshot_id, member_id, company_name from companies_state where member_id is not null and snapshot_id is not null)
select distinct p.snapshot_id + 1 as snapshot_id, p.member_id, p.company_name from l p where p.snapshot_id < (select max(snapshot_id) from l)
  and not exists (select 1 from l n where n.snapshot_id = p.snapshot_id + 1 and n.member_id = p.member_id)
  and not exists (select 1 from l n where n.snapshot_id = p.snapshot_id + 1 and lower(n.company_name) = lower(p.company_name))
""")
def departed_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Of every two snapshots that follow each other, the members whose id and name are gone in the later one."""
    every = table(spark, d, "companies_state").where("member_id is not null and snapshot_id is not null").select("snapshot_id", "member_id", "company_name").distinct()
    last = every.agg(F.max("snapshot_id").alias("last"))
    prior = every.join(F.broadcast(last), F.col("snapshot_id") < F.col("last")).select((C("snapshot_id") + 1).alias("snapshot_id"), "member_id", "company_name")
    return roster.departed(every, prior, ["snapshot_id"]).select("snapshot_id", "member_id", "company_name")


@query(f"""
with r as (select company as company_name, arg_max(coalesce(url, ''), kind || coalesce(url, '')) as url from pointers where kind is not null group by 1)
select s.member_id, case when nullif(r.url, '') is not null then r.url else s.career_page_url end as career_page_url,
  case when nullif(r.url, '') is not null then 'active' when r.company_name is not null then 'failed' else s.status end as status,
  case when nullif(r.url, '') is not null then 'heuristic' else s.map_method end as map_method from {_LIVE} s left join r on s.company_name = r.company_name
""")
def status_transition(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "pointers").where("kind is not null").select(C("company").alias("company_name"), "url", F.concat("kind", F.coalesce("url", F.lit(""))).alias("ord"))
    return roster.apply_results(_latest(spark, d, 8), results, "heuristic").select("member_id", "career_page_url", "status", "map_method")


@query(f"""
with c as (select distinct company_name from {_LIVE} where status = 'active' and career_page_url != '' and company_name is not null),
a as (select company_name, max(last_scraped) as last_scraped from scrape_state group by 1)
select company_name, last_scraped, (row_number() over (order by last_scraped nulls first, company_name))::int as place from c left join a using (company_name) order by place limit 40
""")
def rolling_batch(spark: SparkSession, d: str) -> DataFrame:
    due = _latest(spark, d, 8).where("status = 'active' and career_page_url != '' and company_name is not null").select("company_name", C("company_name").alias("ord")).distinct()
    batch = roster.least_recent(due, table(spark, d, "scrape_state"), 40)
    return batch.select("company_name", "last_scraped", F.expr("row_number() over (order by last_scraped nulls first, company_name)").alias("place"))


@query("select snapshot_id, count_if(status = 'active') / greatest(count(*), 1) as rate from companies_state group by 1")
def recovery_rate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies_state").groupBy("snapshot_id").agg((F.count_if(C("status") == "active") / F.greatest(F.count("*"), F.lit(1))).alias("rate"))


@query(f"select member_id, (row_number() over (order by lower(company_name) nulls first, member_id))::int as place from {_LIVE}")
def name_order(spark: SparkSession, d: str) -> DataFrame:
    rows = _latest(spark, d, 8).select("member_id", F.lower("company_name").alias("n"))
    return numbered(rows, C("n").asc_nulls_first(), C("member_id")).select("member_id", C("place").cast("int").alias("place"))


_CELL = "replace(coalesce(nullif({0}, ''), '—'), '|', '\\|')"


@query(f"""select '| ' || concat_ws(' | ', {_CELL.format("company_name")}, case when coalesce(website_url, '') = '' then '—' else '[site](' || website_url || ')' end, {_CELL.format("location")},
  case when coalesce(career_page_url, '') = '' then '—' else '[careers](' || career_page_url || ')' end) || ' |' as line from {_LIVE} where coalesce(status, '') != 'inactive'""")
def roster_markdown(spark: SparkSession, d: str) -> DataFrame:
    rows = _latest(spark, d, 8).where("coalesce(status, '') != 'inactive'")
    return rows.select(markdown_rows(C("company_name"), C("website_url"), C("location"), C("career_page_url")).alias("line"))


@query("""
with latest as (
  select snapshot_id, member_id, website_url, status,
         row_number() over (partition by snapshot_id, member_id order by delivered_at desc, website_url desc nulls last, status desc nulls last) as rn
  from companies_state where member_id is not null and snapshot_id is not null),
one as (select snapshot_id, member_id, website_url, status from latest where rn = 1),
pair as (select snapshot_id, lag(snapshot_id) over (order by snapshot_id) as before from (select distinct snapshot_id from one)),
a as (select p.snapshot_id as pair, o.member_id, o.website_url, o.status from one o join pair p on o.snapshot_id = p.snapshot_id where p.before is not null),
b as (select p.snapshot_id as pair, o.member_id, o.website_url, o.status from one o join pair p on o.snapshot_id = p.before)
select coalesce(a.pair, b.pair) as snapshot_id, coalesce(a.member_id, b.member_id) as member_id,
       case when b.member_id is null then 'added' when a.member_id is null then 'removed' else 'changed' end as change
from a full join b on a.pair = b.pair and a.member_id = b.member_id
where a.member_id is null or b.member_id is null or a.website_url is distinct from b.website_url or a.status is distinct from b.status
""")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff(table(spark, d, "companies_state"))


# ---- the rolling feed -----------------------------------------------------------------------------------

_FEED = "company, title, url, location, source_board, description, via, on_page"
_MERGED = f"""
with j as (select *, {Q.feed_key("on_page", "company", "title", "url")} as key from open_jobs),
e as (select *, row_number() over (partition by key order by row_id desc) as last_, min(row_id) over (partition by key) as o_ord from j where coalesce(first_seen, date '1900-01-01') < date '{SPLIT}'),
o as (select * from e where last_ = 1),
n as (select *, row_number() over (partition by key order by row_id) as first_, row_number() over (partition by key order by row_id desc) as last_ from j where coalesce(last_seen, first_seen) >= date '{SPLIT}'),
f as (select a.key, a.company, a.url, a.on_page, b.title, b.location, b.source_board, b.description,
        (select arg_max(v.via, v.row_id) from n v where v.key = a.key and coalesce(v.via, '') != '') as via
      from n a join n b on a.key = b.key and a.first_ = 1 and b.last_ = 1),
ok as (select distinct company_name from scrape_state where last_scraped >= date '2027-04-10' and company_name is not null),
merged as (select coalesce(o.key, f.key) as key, case when o.key is not null then o.company else f.company end as company,
  case when f.key is not null then f.title else o.title end as title, case when o.key is not null then o.url else f.url end as url,
  case when f.key is not null then f.location else o.location end as location, case when f.key is not null then f.source_board else o.source_board end as source_board,
  case when f.key is not null then f.description else o.description end as description, coalesce(f.via, o.via) as via, case when o.key is not null then o.on_page else f.on_page end as on_page,
  case when o.key is not null then o.first_seen else date '{TODAY}' end as first_seen, case when f.key is not null then date '{TODAY}' else o.last_seen end as last_seen,
  case when f.key is not null then 'open' when coalesce(o.company, f.company) in (select company_name from ok) or coalesce(date_diff('day', o.last_seen, date '{TODAY}'), 0) >= 14 then 'closed' else o.status end as status
  from o full join f on o.key = f.key)
"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    feed = table(spark, d, "open_jobs").withColumnRenamed("row_id", "ord")
    found = feed.where(F.coalesce("last_seen", "first_seen") >= _day(SPLIT)).drop("first_seen", "last_seen", "status")
    ok = table(spark, d, "scrape_state").where(C("last_scraped") >= _day("2027-04-10")).select(C("company_name").alias("company"))
    return merge.merge_history(feed.where(F.coalesce("first_seen", _day("1900-01-01")) < _day(SPLIT)), found, ok, TODAY)


@query(_MERGED + "select * from merged")
def merge_history(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).drop("ord")


@query(_MERGED + f"select count_if(status = 'open') as open_count, count_if(status = 'open' and first_seen = date '{TODAY}') as new_today from merged")
def run_counts(spark: SparkSession, d: str) -> DataFrame:
    is_open = C("status") == "open"
    return _merged(spark, d).agg(F.count_if(is_open).alias("open_count"), F.count_if(is_open & (C("first_seen") == _day(TODAY))).alias("new_today"))


@query("select row_id, (row_number() over (order by coalesce(status != 'open', true), coalesce(first_seen::varchar, ''), row_id))::int as place from open_jobs")
def feed_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "open_jobs").select("row_id", "status", "first_seen", C("row_id").alias("ord"))
    return numbered(rows, *merge.feed_order()).select("row_id", C("place").cast("int").alias("place"))


@query("select company, title, url, location, source_board, first_seen from open_jobs where status = 'open'")
def feed_scan_projection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "open_jobs").where("status = 'open'").select("company", "title", "url", "location", "source_board", "first_seen")


_BOARD = "coalesce(nullif(source_board, ''), 'own-site')"


@query(f"""
select count_if(status = 'open') as open_count, count_if(status = 'open' and coalesce(date_diff('day', first_seen, date '{TODAY}') <= 7, false)) as new_count,
  count(distinct case when status = 'open' then company end) as company_count, count(*) as total_tracked,
  (select array_to_string(list_sort(list(distinct company)), '|') from open_jobs where status = 'open' and company is not null) as companies,
  (select array_to_string(list_sort(list(distinct {_BOARD})), '|') from open_jobs where status = 'open') as boards from open_jobs
""")
def feed_summary(spark: SparkSession, d: str) -> DataFrame:
    return publish.summary(table(spark, d, "open_jobs"), _day(TODAY)).withColumns({"companies": F.array_join("companies", "|"), "boards": F.array_join("boards", "|")})


@query(f"select distinct company, {_BOARD} as board from open_jobs where status = 'open'")
def facet_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "open_jobs").where("status = 'open'").select("company", publish.board(C("source_board")).alias("board")).distinct()


@query(f"select row_id, coalesce(date_diff('day', first_seen, date '{TODAY}') <= 7, false) as is_new from open_jobs")
def new_window(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "open_jobs").select("row_id", publish.is_new(C("first_seen"), _day(TODAY)).alias("is_new"))


@query(f"select row_id, coalesce(epoch(timestamp '{NOW}' - first_seen::timestamp) / 86400 <= 7, false) as is_new from open_jobs")
def new_window_fractional(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "open_jobs").select("row_id", publish.is_new_by_time(C("first_seen"), F.lit(NOW).cast("timestamp")).alias("is_new"))


@query(f"""select row_id from open_jobs where {_BOARD} = 'own-site' and contains(lower(coalesce(title, '') || ' ' || coalesce(company, '') || ' ' || coalesce(location, '') || ' ' || coalesce(description, '')), 'payments')""")
def faceted_search(spark: SparkSession, d: str) -> DataFrame:
    return publish.search(table(spark, d, "open_jobs"), q=" Payments ", source="own-site").select("row_id")


@query(f"""
with r as (select row_id, url, coalesce(title, '') as title, coalesce(company, '') as company, {_BOARD} as board, first_seen, coalesce(date_diff('day', first_seen, date '{TODAY}') <= 7, false) as is_new from open_jobs where status = 'open')
select row_id, title, company, board, is_new, (row_number() over (order by is_new desc, first_seen desc nulls last, url, row_id))::int as place from r
""")
def dashboard_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "open_jobs").where("status = 'open'").select(
        "row_id", "url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("company", F.lit("")).alias("company"), publish.board(C("source_board")).alias("board"),
        "first_seen", publish.is_new(C("first_seen"), _day(TODAY)).alias("is_new"),
    )
    ordered = numbered(rows, C("is_new").desc(), C("first_seen").desc_nulls_last(), C("url"), C("row_id"))
    return ordered.select("row_id", "title", "company", "board", "is_new", C("place").cast("int").alias("place"))


@query("select company, job_url from known_jobs")
def paged_source(spark: SparkSession, d: str) -> DataFrame:
    """The outside listings through the paged data source, page by page of the table's files."""
    path = f"{d}/known_jobs.parquet"

    def fetch(offset: int, limit: int) -> tuple[list[tuple], bool]:
        import pyarrow.dataset as ds

        part = ds.dataset(path).scanner(columns=["company", "job_url"]).take(list(range(offset, min(offset + limit, ds.dataset(path).count_rows()))))
        return [tuple(r.values()) for r in part.to_pylist()], part.num_rows == limit

    return paged(spark, "outside_listings", "company string, job_url string", fetch)


from feedloom import crawl_entries  # noqa: E402, F401 - registers the queries of the crawl
