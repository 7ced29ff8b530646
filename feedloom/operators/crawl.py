"""Crawling the careers pages of many companies: a bounded breadth-first walk, candidates, and the feed's rows.

All companies walk at once, one Spark round a wave: a wave holds every page that a company's queue holds, in the
queue's order, so what is queued while a wave is handled comes after it, as in a queue handled page by page.
Budgets (visited pages, pagination, the stop at enough candidates) are running counts over a company's pages in that
order. Rendering and the routing of pages that rules leave undecided are injected; waves are written to the shared
checkpoint folder, so no page is rendered twice. A company's queue is small by its budgets, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import json as J
from feedloom.functions import rules, text, urls
from feedloom.operators import links
from feedloom.plans.lineage import cut

#: Links followed at most of a page, hops from the start, pages of pagination a company, and rows of each sort a company.
FOLLOW, HOPS, PAGES, MOST = 3, 2, 6, 25
#: Characters of a description, of a title, and of a page's text and links that a router is shown.
DESCRIPTION, TITLE, SHOWN_TEXT, SHOWN_LINKS, SHOWN_LABEL = 1_500, 140, 1_500, 140, 80

#: ``url`` to ``url, final_url, links array<struct<t,h>>, text``; pages that can't be rendered are left out.
Render = Callable[[DataFrame], DataFrame]
#: ``company, final_url, links, text`` to ``company, final_url, answer``: the text of a router's decision, null where it failed.
Router = Callable[[DataFrame], DataFrame]


class Crawl(NamedTuple):
    """What a walk found: ``candidates`` (company, ord, title, url, via_recruiter, on_page, page_url, page_text),
    ``pointers`` (company, kind, url), ``boards`` (company, key) and ``scraped`` (company)."""

    candidates: DataFrame
    pointers: DataFrame
    boards: DataFrame
    scraped: DataFrame


def router_prompt(company: Column, final_url: Column, page_text: Column, page_links: Column) -> Column:
    """What a router is shown of a page: name, url, the text's beginning and the first links with a label or a target."""
    shown = F.filter(F.slice(page_links, 1, SHOWN_LINKS), lambda a: (F.coalesce(a["t"], F.lit("")) != "") | (F.coalesce(a["h"], F.lit("")) != ""))
    lines = F.transform(shown, lambda a: F.concat(F.lit("- "), F.left(F.coalesce(a["t"], F.lit("")), F.lit(SHOWN_LABEL)), F.lit(" | "), F.coalesce(a["h"], F.lit(""))))
    return F.concat_ws("\n", F.concat(F.lit("Company: "), company), F.concat(F.lit("Page: "), final_url), F.left(F.coalesce(page_text, F.lit("")), F.lit(SHOWN_TEXT)), F.array_join(lines, "\n"))


def provider(answer: Callable[[str], str | None]) -> Router:
    """A router of a function from prompt to answer, called in Arrow batches on the executors; tests give a mock."""

    @F.pandas_udf("string")
    def call(prompts):  # noqa: ANN001, ANN202
        return prompts.map(answer, na_action="ignore")

    return lambda pages: pages.select("company", "final_url", call(router_prompt(F.col("company"), F.col("final_url"), F.col("text"), F.col("links"))).alias("answer"))


def retried(call: Callable[[str, str], str], ladder: list[str], attempts: int = 6, first_wait: float = 8.0, sleep: Callable[[float], None] | None = None) -> Callable[[str], str | None]:
    """A function from prompt to answer that tries the models of ``ladder`` in turn, waiting twice as long each time.

    Errors whose text has a sign of a limit or an outage are tried again, others aren't; there is no wait after the last
    attempt. None if no attempt succeeds."""
    import time

    def answer(prompt: str) -> str | None:
        for n in range(attempts):
            try:
                return call(ladder[n % len(ladder)], prompt)
            except Exception as error:  # noqa: BLE001 - whatever a provider raises
                if not any(sign in str(error).lower() for sign in rules.RATE_LIMIT_SIGNS):
                    return None
            if n < attempts - 1:
                (sleep or time.sleep)(first_wait * 2**n)
        return None

    return answer


def routed(pages: DataFrame, router: Router | None = None) -> DataFrame:
    """``pages`` (company, final_url, links, text) with ``jobs, external, follow, next_page, is_aggregator``.

    Rules decide first; only pages that they leave undecided are shown to the router, whose failures decide nothing."""
    own = pages.select("final_url", "links").distinct().select("final_url", F.posexplode("links").alias("ord", "a")).select("final_url", "ord", F.col("a.h").alias("href"), F.col("a.t").alias("text"))
    by_rules = links.route(own.where("href is not null")).where("jobs is not null or external is not null or follow is not null")
    # a page without any link can still be one of a known network
    kind = rules.first_label(urls.host_of(F.col("final_url")), rules.EXTERNAL_KINDS)
    rows = pages.join(by_rules, "final_url", "left").withColumn("external", F.coalesce("external", F.when(F.col("jobs").isNull(), kind)))
    undecided = F.col("jobs").isNull() & F.col("external").isNull() & F.col("follow").isNull()
    if router is None:
        return rows.withColumns({"next_page": F.lit(None).cast("string"), "is_aggregator": F.lit(False)})
    answers = cut(router(rows.where(undecided).select("company", "final_url", "links", "text")).select("company", "final_url", J.route(F.col("answer")).alias("r")))
    both = rows.join(answers, ["company", "final_url"], "left")
    return both.select(
        *pages.columns, *[F.when(undecided, F.col(f"r.{c}")).otherwise(F.col(c)).alias(c) for c in ("jobs", "external", "follow")],
        F.nullif(F.col("r.next_page"), F.lit("")).alias("next_page"), F.coalesce(F.col("r.is_aggregator"), F.lit(False)).alias("is_aggregator"),
    )


def crawl(companies: DataFrame, render: Render, router: Router | None = None, hops: int = HOPS, follow: int = FOLLOW, pages: int = PAGES, most: int = MOST) -> Crawl:
    """The walk from each row of ``companies`` (company, url), whose companies are unique and whose urls aren't null.

    A page counts once a company by its canonical url. Pages that aren't rendered are skipped; walls against robots and
    pages of outside networks give a pointer, the last one of a company holds. Of a page at most ``follow`` links are
    followed, up to ``hops`` hops; the next page of a list keeps its hop, ``pages`` of them a company. A company whose
    candidates reach twice ``most`` stops. Empty input gives empty results.
    """
    in_order = Window.partitionBy("company").orderBy("ord")
    queue = companies.select("company", F.col("url"), F.lit(0).alias("hop"), F.lit(1).cast("long").alias("ord")).where("company is not null and url is not null")
    seen = None
    state = queue.select("company", F.lit(0).cast("long").alias("had"), F.lit(0).cast("long").alias("paged")).distinct()
    handled: list[DataFrame] = []
    for _ in range(1 + hops + pages):
        wave = queue.withColumn("key", urls.canon_url(F.col("url")))
        wave = wave.groupBy("company", "key").agg(F.min_by(F.struct("ord", "url", "hop"), "ord").alias("q")).select("company", "key", "q.*")
        if seen is not None:
            wave = wave.join(seen, ["company", "key"], "left_anti")
        wave = cut(wave)
        if wave.isEmpty():
            break
        keys = wave.select("company", "key")
        seen = keys if seen is None else seen.unionByName(keys)
        shown = wave.join(cut(render(wave.select("url").distinct())), "url").drop("key")
        wall = links.blocked(F.col("final_url"), F.size("links"), F.coalesce("text", F.lit("")))
        decided = routed(shown.withColumn("wall", F.coalesce(wall, F.lit(False))), router)
        own = F.when(F.col("wall") | F.col("external").isNotNull(), None).otherwise(F.filter("jobs", lambda j: F.coalesce(j["url"], F.lit("")) != ""))
        counted = decided.withColumn("jobs", own).withColumn("n", F.when(F.col("jobs").isNull(), 0).otherwise(F.size("jobs"))).join(state, "company")
        before = F.col("had") + F.sum("n").over(in_order) - F.col("n")
        active = counted.withColumn("before", before).where(F.col("before") < 2 * most)
        goes_on = ~F.col("wall") & F.col("external").isNull()
        next_ = F.when(goes_on & F.col("next_page").isNotNull(), 1).otherwise(0)
        active = cut(active.withColumn("nth", F.col("paged") + F.sum(next_).over(in_order)).withColumn("wants", next_ == 1))
        handled.append(active)
        state = (
            state.join(active.groupBy("company").agg(F.sum("n").alias("more"), F.count_if(F.col("wants") & (F.col("nth") <= pages)).alias("turned")), "company", "left")
            .select("company", (F.col("had") + F.coalesce("more", F.lit(0))).alias("had"), (F.col("paged") + F.coalesce("turned", F.lit(0))).alias("paged"))
        )
        onward = active.where(goes_on)
        links_on = onward.where(F.col("hop") < hops).select("company", "final_url", (F.col("hop") + 1).alias("hop"), "ord", F.posexplode(F.slice("follow", 1, follow)).alias("i", "to"))
        turned = onward.where("wants").where(F.col("nth") <= pages).select("company", "final_url", "hop", "ord", F.lit(follow).alias("i"), F.col("next_page").alias("to"))
        stopped = state.where(F.col("had") >= 2 * most).select("company")
        added = links_on.unionByName(turned).where("to is not null").join(stopped, "company", "left_anti")
        place = F.row_number().over(Window.partitionBy("company").orderBy("ord", "i")).cast("long")
        queue = added.select("company", urls.absolute(F.col("final_url"), F.col("to")).alias("url"), "hop", place.alias("ord"))
    if not handled:
        handled = [_nothing(companies)]
    rows = reduce(DataFrame.unionByName, [h.withColumn("wave", F.lit(i)) for i, h in enumerate(handled)])
    jobs = rows.where("jobs is not null").select("company", "wave", "ord", "is_aggregator", "final_url", "text", F.posexplode("jobs").alias("i", "j"))
    absolute = urls.absolute(F.col("final_url"), F.col("j.url"))
    found = jobs.select(
        "company", F.struct("wave", "ord", "i").alias("ord"), F.coalesce("j.title", F.lit("")).alias("title"), absolute.alias("url"), (F.col("is_aggregator") | rules.contains_any(F.col("company"), rules.RECRUITERS)).alias("via_recruiter"),
        (urls.canon_url(absolute) == urls.canon_url(F.col("final_url"))).alias("on_page"), F.col("final_url").alias("page_url"), "text",
    ).withColumn("page_text", F.when(F.col("on_page"), F.col("text"))).drop("text")
    told = rows.where("wall or external is not null").select("company", F.struct("wave", "ord").alias("at"), F.when(F.col("wall"), "blocked").otherwise(F.col("external")).alias("kind"), F.col("final_url").alias("url"))
    pointers = told.groupBy("company").agg(F.max_by(F.struct("kind", "url"), "at").alias("p")).select("company", "p.*")
    boards = rows.select("company", urls.canon_url(F.col("final_url")).alias("key")).distinct()
    return Crawl(found, pointers, boards, rows.select("company").distinct())


def _nothing(companies: DataFrame) -> DataFrame:
    return companies.sparkSession.createDataFrame(
        [], "url string, company string, ord long, hop int, final_url string, links array<struct<t:string,h:string>>, text string, wall boolean, jobs array<struct<title:string,url:string>>, external string, follow array<string>, next_page string, is_aggregator boolean",
    ).drop("links")


def _first(rows: DataFrame, key: Column, most: int | None) -> DataFrame:
    """The first row of each company and key in order, and of these the first ``most`` of a company."""
    first = rows.withColumn("__key", key).groupBy("company", "__key").agg(F.min_by(F.struct(*rows.columns), "ord").alias("r")).select("r.*")
    if most is None:
        return first
    return first.withColumn("__n", F.row_number().over(Window.partitionBy("company").orderBy("ord"))).where(F.col("__n") <= most).drop("__n")


def linked(candidates: DataFrame, most: int = MOST) -> DataFrame:
    """Candidates with a page of their own, each canonical url once a company, the first ``most`` of a company."""
    return _first(candidates.where("not on_page"), urls.canon_url(F.col("url")), most)


def on_page(candidates: DataFrame, companies: DataFrame, most: int = MOST) -> DataFrame:
    """The feed's rows of roles that stand on a careers page itself, each title once a company, whichever page it is on.

    Their url is the page's with the title's slug behind ``#``, their location that of the company (company, location);
    nothing is fetched. ``via`` names the company if it lists roles of others."""
    title = text.collapse(F.col("title"))
    roles = _first(candidates.where("on_page").withColumn("title", title).where("title != ''"), F.lower("title"), most)
    clipped = text.clip(F.col("title"), TITLE)
    return roles.join(companies.select("company", "location"), "company", "left").select(
        "company", clipped.alias("title"), F.concat("page_url", F.lit("#"), text.slug(clipped)).alias("url"), "location", F.lit("on-page").alias("source_board"),
        text.clip(F.coalesce("page_text", F.lit("")), DESCRIPTION).alias("description"), F.when(F.col("via_recruiter"), F.col("company")).alias("via"), F.lit(True).alias("on_page"),
    )


def validated(rows: DataFrame, boards: DataFrame, fetched: DataFrame) -> DataFrame:
    """The feed's rows of linked candidates whose page is a posting.

    ``fetched``: url, status, final_url, h1, page_title, text, html; a candidate without a row there couldn't be fetched
    and goes. A posting has no error status, a path, a url that is none of the company's boards (company, key), and 120
    characters of text. Title, location and description come from structured data where there are any."""
    pages = rows.join(fetched, "url")
    path = F.regexp_replace(urls.path_of(F.col("final_url")), r"/+$", "")
    fit = pages.where((F.coalesce("status", F.lit(0)) < 400) & (path != "") & (F.length(text.strip(F.col("text"))) >= 120))
    fit = fit.withColumn("key", urls.canon_url(F.col("final_url"))).join(boards, ["company", "key"], "left_anti")
    posting = J.structured_postings(fit.select("url", "html").where("html is not null").distinct(), "url", "html").select("url", F.struct("title", "description", "location").alias("s"))
    title = text.pick_title(F.col("title"), F.col("h1"), F.col("page_title"), F.col("s.title"), F.col("url"))
    return fit.join(posting, "url", "left").select(
        "company", text.clip(text.collapse(title), TITLE).alias("title"), "url", F.col("s.location").alias("location"), rules.first_label(F.col("url"), rules.BOARD_LABELS, "own-site").alias("source_board"),
        text.clip(F.coalesce(text.strip(F.col("s.description")), text.strip(F.col("text"))), DESCRIPTION).alias("description"), F.when(F.col("via_recruiter"), F.col("company")).alias("via"), F.lit(None).cast("boolean").alias("on_page"),
    )


def feed_rows(walk: Crawl, companies: DataFrame, fetch: Callable[[DataFrame], DataFrame], most: int = MOST) -> DataFrame:
    """Linked postings, fetched once by ``fetch`` (url) and validated, and on-page roles: a run's findings for the merge."""
    own = cut(linked(walk.candidates, most))
    return validated(own, walk.boards, fetch(own.select("url").distinct())).unionByName(on_page(walk.candidates, companies, most))
