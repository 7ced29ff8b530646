"""Queries of the operators for training data, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import bpe, canonical_dedup, langid, leakage, matching, names, residue, wrappers
from feedloom.plans.tables import table


def _typed_names(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "sh_reconcile").select(F.col("company_name").alias("name"))
        .unionByName(table(spark, d, "open_jobs").select(F.col("company").alias("name")))
        .unionByName(table(spark, d, "known_jobs").select(F.col("company").alias("name")))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_organisation(_typed_names(spark, d), names.places_of(table(spark, d, "open_jobs")))


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every typed name with its cluster."""
    return names.clusters(_typed_names(spark, d), names.places_of(table(spark, d, "open_jobs")))


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    """The member that each coverage row speaks of, with the rule that found it and its confidence."""
    return matching.match(table(spark, d, "sh_reconcile"), table(spark, d, "companies_state"), names.places_of(table(spark, d, "open_jobs")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_matches(spark, d).select("recon_id", "member_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical_dedup.later_copies(table(spark, d, "open_jobs"))


def p4_copies(spark: SparkSession, d: str) -> DataFrame:
    """Each posting once, with the number of its copies."""
    return canonical_dedup.copy_groups(table(spark, d, "open_jobs")).select("first_row_id", "copies")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "open_jobs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return wrappers.furniture_lines(table(spark, d, "open_jobs"))


def p6_wrappers(spark: SparkSession, d: str) -> DataFrame:
    """The wrapper of each block of each host."""
    return wrappers.wrappers(table(spark, d, "open_jobs"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.wrong_labels(table(spark, d, "documents"), table(spark, d, "lang_samples"))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every segment of every document."""
    return langid.language_segments(table(spark, d, "documents"), table(spark, d, "lang_samples"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_clusters, p2_found, p2_matches, p4_found, p4_copies, p5_found, p6_found, p6_wrappers, p7_ids, p8_found, p9_found, p9_segments)
}

_NOISE, _TITLE_NOISE = r"[^\p{L}\p{M}\p{N}]+", r"[^\p{L}\p{M}\p{N}+#]+"


def _name_sql(x: str) -> str:
    return f"coalesce(regexp_replace(nfc_normalize(lower({x})), '{_NOISE}', '', 'g'), '')"


def _title_sql(x: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_filter(string_split_regex(nfc_normalize(lower({x})), '{_TITLE_NOISE}'), lambda w: w != '')), ' '), '')"


_LOW_URL = "coalesce(nfc_normalize(lower(url)), '')"
_URL_SQL = f"""concat_ws(chr(1), regexp_replace(regexp_extract({_LOW_URL}, '(?s)^([^?#]*)', 1), '{_NOISE}', '', 'g'),
  coalesce(array_to_string(list_sort(list_filter(list_transform(string_split_regex(regexp_extract({_LOW_URL}, '(?s)^[^?#]*\\?([^#]*)', 1), '[&;]'), lambda q: regexp_replace(q, '{_NOISE}', '', 'g')), lambda q: q != '')), chr(2)), ''),
  regexp_replace(regexp_extract({_LOW_URL}, '(?s)#(.*)$', 1), '{_NOISE}', '', 'g'))"""
#: Rows agree as they stand, or one of them with title and company exchanged; sets are closed over two rounds, which are enough in these data.
_COPIES_SQL = f"""
with k as (select row_id, {_name_sql("title")} as tn, {_name_sql("company")} as cn, {_URL_SQL} || chr(3) || {_title_sql("title")} || chr(3) || {_name_sql("company")} as h,
  {_URL_SQL} || chr(3) || {_title_sql("company")} || chr(3) || {_name_sql("title")} as x from open_jobs where row_id is not null),
c as (select h, min(row_id) as first, count(*) as n from k group by 1),
tt as (select tn as s, count(*) as n from k group by 1), cc as (select cn as s, count(*) as n from k group by 1),
e as (select distinct k.h, k.x from k join c on k.x = c.h left join cc a on a.s = k.tn left join tt b on b.s = k.cn join tt p on p.s = k.tn join cc q on q.s = k.cn
      where k.h != k.x and coalesce(a.n, 0) + coalesce(b.n, 0) >= p.n + q.n),
l as (select h, x from e union select x, h from e),
a as (select h, least(h, min(x)) as low from l group by 1), b as (select l.h, min(a.low) as there from l join a on l.x = a.h group by 1),
r as (select c.h, c.first, c.n, coalesce(least(a.low, b.there), c.h) as root from c left join a on c.h = a.h left join b on c.h = b.h),
s as (select root, min(first) as first_row_id, sum(n)::bigint as copies from r group by 1)
"""
_WORDS_SQL = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w != '')"

SQL: dict[str, str] = {
    "p4_found": _COPIES_SQL + "select s.first_row_id, k.row_id from k join r on k.h = r.h join s on r.root = s.root where k.row_id > s.first_row_id",
    "p4_copies": _COPIES_SQL + "select first_row_id, copies from s",
    "p8_found": f"""
with d as (select doc_id, {_WORDS_SQL} as w from documents where text is not null), i as (select item_id, {_WORDS_SQL} as w from eval_items where text is not null),
dw as (select doc_id, array_to_string(w[n:n + 9], ' ') as p from (select doc_id, w, unnest(generate_series(1, len(w) - 9)) as n from d where len(w) >= 10)),
iw as (select item_id, array_to_string(w[n:n + 9], ' ') as p from (select item_id, w, unnest(generate_series(1, len(w) - 9)) as n from i where len(w) >= 10))
select distinct doc_id, item_id from dw join iw using (p)
""",
}
