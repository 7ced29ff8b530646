"""Matching rows to roster members without a shared key: a cascade of exact joins.

Each pass joins the rows that stronger passes left over with the roster on a weaker combination of attributes
and takes the matches that name a single member:

1. ``host_and_name``: own site and the name's parts
2. ``name``: the name's parts (own words in any order, given name, trade)
3. ``host_and_spelling``: own site, and the name is a spelling of the member's
4. ``spelling``: trade and a key of the own words that typing errors leave alone, checked to be spellings of one name
5. ``words``: own words alone, where the row's name leaves the trade out
6. ``words_spelling``: a key of the own words alone, in the same case
7. ``host``: own site alone, where the row has no name
8. ``slug``: the name part of a job board's url, where the row has no name

Keys make typing errors an equality, so every pass is an equi-join; no pair is formed across keys. Words of up to
SHORT letters have deletion keys (what is left without one or two letters), longer ones are cut into four pieces, of
which three errors leave one alone. Sites that several members share say nothing.

The confidence of a match is the precision of its rule, judged by evidence of the other kind: a rule on names runs
over every row that stronger rules on names leave over, whether its site resolved it or not, and is right where the
row's own site, if only one member has it, says the same; sites and slugs are judged by rows whose exact name is one
member's. Where name and site agree, the odds of both rules are multiplied, as their errors are independent. Counts
are smoothed towards the mean of all rules: (right + WEIGHT * mean) / (judged + WEIGHT).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.nameparts import allowed, edits, fold, orders, parse, same_core, same_given
from feedloom.llm.names import complete_trades
from feedloom.plans.lineage import cut

RULES = ("host_and_name", "name", "host_and_spelling", "spelling", "words", "words_spelling", "host", "slug")
#: Characters to which job boards clip the name in their urls.
SLUG = 18
#: Letters up to which a roster name has deletion keys; longer ones have pieces. A name of the length of either side may meet the other.
SHORT, ERRORS = 17, 3
#: Weight of the mean precision in each rule's.
WEIGHT = 2


def site(url: Column) -> Column:
    """A url's host in lower case without scheme, port and the usual prefixes; null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:(?:www|careers|jobs|carrieres|emplois)\.)*([^/?#:\s@]+\.[^/?#:\s@]+)", 1)
    return F.nullif(host, F.lit(""))


def _slug(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), r"^https?://[^/]+/([a-z0-9]+(?:-[a-z0-9]+)+)/jobs?/", 1), F.lit(""))


def _name_rows(df: DataFrame, places: frozenset[str], former: bool) -> DataFrame:
    """``id, core, given, trade, slug`` of ``id, name``; with ``former``, names in "(formerly X)" are names too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, name in enumerate(batch.column(1).to_pylist()):
                names = [name] if name else []
                if former and name and "formerly" in name.lower():
                    names += [x.split(")")[0] for x in name.lower().split("formerly")[1:]]
                for x in names:
                    if (p := parse(x, places)) is not None and p.core:
                        slug = "-".join("".join(c if c.isascii() and c.isalnum() else " " for c in fold(x)).split())[:SLUG].rstrip("-")
                        at.append(i)
                        out.append((" ".join(p.core), p.given, " ".join(p.trade), slug))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, pa.string()) for c in cols]], names=["id", "core", "given", "trade", "slug"])

    kind = df.schema[0].dataType.simpleString()
    return df.toDF("id", "name").mapInArrow(run, f"id {kind}, core string, given string, trade string, slug string")


def _words(core: Column) -> Column:
    return F.array_join(F.array_sort(F.split(core, " ")), " ")


def deletion_keys(word: str) -> set[str]:
    """``word`` and what is left of it without one letter (from 5 letters on) or two (from 8 on, as ``allowed`` has it)."""
    out = {word}
    for k in range(1, 1 + min(2, allowed(len(word)))):
        out |= {"".join(word[i] for i in range(len(word)) if i not in gone) for gone in combinations(range(len(word)), k)}
    return out


def piece_keys(word: str, shifted: bool) -> set[str]:
    """The ERRORS + 1 pieces of a long word with number and length of the word; ``shifted``: for each length and place that errors can lead to.

    An exchange of neighbours across the border of two pieces counts as two errors.
    """
    out = set()
    for length in range(len(word) - ERRORS, len(word) + ERRORS + 1) if shifted else [len(word)]:
        if length <= SHORT:
            continue
        ends = [length * k // (ERRORS + 1) for k in range(ERRORS + 2)]
        for k, (s, e) in enumerate(zip(ends, ends[1:])):
            for move in range(-ERRORS, ERRORS + 1) if shifted else [0]:
                if 0 <= s + move and e + move <= len(word):
                    out.add(f"{k} {length} {word[s + move : e + move]}")
    return out


def spelling_keys(word: str, shifted: bool) -> set[str]:
    """Keys of which two spellings within ``allowed`` errors share one: those of a row's word are ``shifted``, those of the roster's not."""
    short = deletion_keys(word) if len(word) <= SHORT + 2 * shifted else set()
    return short | (piece_keys(word, shifted) if len(word) > SHORT - ERRORS * shifted else set())


def _keys(df: DataFrame, of_rows: bool) -> DataFrame:
    """``df`` (id, core, given, trade) with a row for each spelling key of the words written together, for rows in each of their orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                at, keys = [], []
                for i, core in enumerate(part.column(1).to_pylist()):
                    words = tuple(core.split())
                    every = orders(words) if of_rows or len(words) > 3 else ["".join(words)]
                    own = set().union(*(spelling_keys(o, of_rows) for o in every))
                    at += [i] * len(own)
                    keys += sorted(own)
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(pa.array(at, pa.int64())) for k in range(4)], pa.array(keys, pa.string())], names=["id", "core", "given", "trade", "key"])

    kind = df.schema["id"].dataType.simpleString()
    keyed = df.select("id", "core", "given", "trade").mapInArrow(run, f"id {kind}, core string, given string, trade string, key string")
    return keyed.withColumn("key", F.xxhash64("key"))


def _spelled(pairs: DataFrame, by_trade: bool) -> DataFrame:
    """``id, member, distance`` of the pairs (id, core, given, trade, member, m_core, m_given, m_trade) that are spellings of one name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, distance = [], []
            cols = [batch.column(k).to_pylist() for k in (1, 2, 3, 5, 6, 7)]
            for i, (core, given, trade, m_core, m_given, m_trade) in enumerate(zip(*cols)):
                x, y = set(trade.split()), set(m_trade.split())
                if not same_given(given, m_given) or not (x == y if by_trade else x <= y):
                    continue
                a, b = tuple(core.split()), tuple(m_core.split())
                if same_core(a, b):
                    at.append(i)
                    distance.append(min(edits("".join(a), o, 4) for o in orders(b)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), batch.column(4).take(pa.array(at, pa.int64())), pa.array(distance, pa.int32())], names=["id", "member", "distance"])

    id_, member = (pairs.schema[c].dataType.simpleString() for c in ("id", "member"))
    return pairs.select("id", "core", "given", "trade", "member", "m_core", "m_given", "m_trade").distinct().mapInArrow(run, f"id {id_}, member {member}, distance int")


def _single(found: DataFrame, rule: str) -> DataFrame:
    """The ids whose matches name one member; with distances, whose closest matches do."""
    if "distance" in found.columns:
        least = found.groupBy("id").agg(F.min("distance").alias("distance"))
        found = found.join(least, ["id", "distance"])
    one = found.groupBy("id").agg(F.min("member").alias("member"), F.max("member").alias("other"))
    return one.where("member = other").select("id", "member", F.lit(rule).alias("rule"))


def match(
    rows: DataFrame,
    roster: DataFrame,
    places: frozenset[str] = frozenset(),
    row_id: str = "recon_id",
    name: str = "company_name",
    urls: str = "urls",
    member: str = "member_id",
    website: str = "website_url",
) -> DataFrame:
    """``row_id, member, rule, confidence``: the member each row speaks of, if any, each row at most once.

    Rows with a null id and members with a null id are left out; null, blank and meaningless names, null and
    empty url lists and null urls say nothing; repeated rows count once; rows whose evidence names two members
    alike have no match; empty tables give no rows. All snapshots' names and sites of a member count.
    """
    one = rows.where(F.col(row_id).isNotNull())
    roster = roster.where(F.col(member).isNotNull())
    members = cut(_name_rows(roster.select(F.col(member), F.col(name)).distinct(), frozenset(), True).withColumnsRenamed({"id": "member"}).distinct())
    sites = roster.select(F.col(member).alias("member"), site(F.col(website)).alias("site")).where("site is not null").distinct()
    own = sites.groupBy("site").agg(F.min("member").alias("member"), F.count("*").alias("n")).where("n = 1").drop("n")
    named = cut(_name_rows(one.select(F.col(row_id), F.col(name)).distinct(), places, False).distinct())
    linked = one.select(F.col(row_id).alias("id"), F.explode(F.col(urls)).alias("url")).where("url is not null")
    hosted = cut(linked.select("id", site(F.col("url")).alias("site")).where("site is not null").distinct().join(own, "site").select("id", "member").distinct())
    whole = rows.sparkSession.createDataFrame([(t,) for t in sorted(complete_trades(members.select("core", "trade").distinct()))] or [("",)], "trade string")

    keys = ["words", "given", "trade"]
    worded = members.withColumn("words", _words(F.col("core")))
    exact = named.withColumn("words", _words(F.col("core"))).join(worded.select(*keys, "member"), keys)
    full = cut(exact.join(whole, "trade", "left_semi").select("id", "member").distinct())
    m = members.select("member", F.col("core").alias("m_core"), F.col("given").alias("m_given"), F.col("trade").alias("m_trade"))
    member_keys = cut(_keys(members.select(F.col("member").alias("id"), "core", "given", "trade"), False))

    def near(left: DataFrame, by_trade: bool) -> DataFrame:
        # the trade is part of the key where both sides have it, so one leading name's trades don't meet
        on = ["key", "trade"] if by_trade else ["key"]
        right = member_keys.select("key", *[F.col("trade")] * by_trade, F.col("id").alias("member"), F.col("core").alias("m_core"), F.col("given").alias("m_given"), F.col("trade").alias("m_trade"))
        return _spelled(_keys(left, True).join(right, on), by_trade)

    # the rules on names, each over the rows that stronger ones leave over
    by_name = {"name": cut(_single(full, "name"))}
    left = named.join(by_name["name"], "id", "left_anti")
    by_name["spelling"] = cut(_single(near(left, True), "spelling"))
    left = cut(left.join(by_name["spelling"], "id", "left_anti").join(whole.where("trade != ''"), "trade", "left_anti"))
    by_words = left.withColumn("words", _words(F.col("core"))).join(worded.select("words", "given", "member"), ["words", "given"])
    by_name["words"] = cut(_single(by_words.select("id", "member").distinct(), "words"))
    by_name["words_spelling"] = cut(_single(near(left.join(by_name["words"], "id", "left_anti"), False), "words_spelling"))
    # the rules on sites
    nameless = one.select(F.col(row_id).alias("id")).distinct().join(named.select("id"), "id", "left_anti")
    by_host = _single(hosted, "host")
    slugs = linked.select("id", _slug(F.col("url")).alias("slug")).where("slug is not null").distinct().join(members.select("slug", "member").distinct(), "slug")
    by_slug = cut(_single(slugs.select("id", "member").distinct(), "slug"))
    agreeing = cut(_single(full.join(hosted, ["id", "member"], "left_semi"), "host_and_name"))
    unsaid = named.join(agreeing, "id", "left_anti").join(by_name["name"], "id", "left_anti")
    spelled = _single(_spelled(unsaid.join(hosted, "id").join(m, "member"), False), "host_and_spelling")
    found = reduce(DataFrame.unionByName, [agreeing, spelled, *by_name.values(), *(x.join(nameless, "id", "left_semi") for x in (by_host, by_slug))])
    rank = F.array_position(F.array(*map(F.lit, RULES)), F.col("rule"))
    done = found.groupBy("id").agg(F.min_by(F.struct("member", "rule"), rank).alias("m")).select("id", "m.*")
    return done.join(F.broadcast(_confidence(by_name, by_host, by_slug)), "rule").select(F.col("id").alias(row_id), F.col("member").alias(member), "rule", "confidence")


def _confidence(by_name: dict[str, DataFrame], by_host: DataFrame, by_slug: DataFrame) -> DataFrame:
    """``rule, confidence`` of the eight rules, from the rows that the other kind of evidence says something on."""

    def judged(found: DataFrame, by: DataFrame) -> DataFrame:
        return found.join(by.select("id", F.col("member").alias("says")), "id").select("rule", F.col("member").eqNullSafe(F.col("says")).alias("right"))

    rows = [judged(x, by_host) for x in by_name.values()] + [judged(x, by_name["name"]) for x in (by_host, by_slug)]
    counts = {r["rule"]: (r["right"], r["n"]) for r in reduce(DataFrame.unionByName, rows).groupBy("rule").agg(F.count_if("right").alias("right"), F.count("*").alias("n")).collect()}
    right, n = (sum(c[k] for c in counts.values()) for k in (0, 1))
    # without any judged row nothing is known, so the mean is a half
    mean = (right + 1) / (n + 2)
    p = {rule: (counts.get(rule, (0, 0))[0] + WEIGHT * mean) / (counts.get(rule, (0, 0))[1] + WEIGHT) for rule in RULES}
    for both, rule in (("host_and_name", "name"), ("host_and_spelling", "spelling")):
        p[both] = p[rule] * p["host"] / (p[rule] * p["host"] + (1 - p[rule]) * (1 - p["host"]))
    return by_host.sparkSession.createDataFrame([(r, float(p[r])) for r in RULES], "rule string, confidence double")
