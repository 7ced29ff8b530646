"""Duplicates hidden by formatting: canonicalise, hash to 128 bits, count with map-side combining.

Characters are brought into compatibility form and folded (full-width letters, composed and decomposed accents, ß
and SS are alike) in Arrow batches for the rows that aren't ASCII; all else runs inside the JVM. No canonical text
crosses a shuffle: rows are hashed once and travel as their id and a few hashes. A third, independent hash detects different texts that share a 128-bit hash and keeps them
apart, so the result is exact but for a simultaneous collision of 192 bits.

Records whose title and company stand in each other's column are found by a second hash, that of the
exchanged reading. It links classes of equal records, never records. As + and # are letters of titles only,
a straight record may look like the exchange of an exchanged one; so a record is taken as exchanged only
if its strings don't stand more often in the columns where it has them than in the other ones. The few
linked classes are settled by two rounds of taking the least neighbour: exchanged classes link to straight
ones only.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.components import components
from feedloom.plans.lineage import cut

#: Everything that is neither letter, mark nor number; in titles + and # are letters (C++, C#).
NOISE = r"[^\p{L}\p{M}\p{N}]+"
TITLE_NOISE = r"[^\p{L}\p{M}\p{N}+#]+"


def folded(text: str) -> str:
    """Compatibility characters and case folded; again composed, as folding can take letters apart."""
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def _folded(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``df`` with folded text columns; rows of ASCII alone, for which that is lower case, don't leave the JVM."""
    odd = F.coalesce(F.concat_ws("", *columns).rlike(r"[^\x00-\x7F]"), F.lit(False))
    places = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [pa.array([t if t is None else folded(t) for t in c.to_pylist()], pa.string()) if i in places else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return df.where(~odd).withColumns({c: F.lower(c) for c in columns}).unionByName(df.where(odd).mapInArrow(run, df.schema))


def canonical_name(text: Column) -> Column:
    """The letters and numbers of a folded text in their order; null becomes the empty string."""
    return F.coalesce(F.regexp_replace(text, NOISE, ""), F.lit(""))


def canonical_title(text: Column) -> Column:
    """The words of a folded text sorted, whatever separates its parts; null becomes the empty string."""
    words = F.filter(F.split(text, TITLE_NOISE), lambda w: w != "")
    return F.coalesce(F.array_join(F.array_sort(words), " "), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Letters and numbers of a folded url's path part, then of its query fields in sorted order, then of its fragment."""
    u = F.coalesce(url, F.lit(""))
    fields = F.split(F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1), "[&;]")
    clean = F.filter(F.transform(fields, lambda q: F.regexp_replace(q, NOISE, "")), lambda q: q != "")
    parts = (F.regexp_extract(u, r"(?s)^([^?#]*)", 1), F.regexp_extract(u, r"(?s)#(.*)$", 1))
    return F.concat_ws("\u0001", F.regexp_replace(parts[0], NOISE, ""), F.array_join(F.array_sort(clean), "\u0002"), F.regexp_replace(parts[1], NOISE, ""))


def _hashed(df: DataFrame, row_id: str, url: str, title: str, company: str) -> DataFrame:
    """``row_id``, the hash ``h`` of each row as it stands, and ``x``: its hash with title and company exchanged.

    A hash is 128 bits of MD5 followed by the 64 bits of another hash as collision check. ``tn`` and ``cn``
    are short hashes of title and company as names, used for counts only.
    """
    raw = df.select(*[F.col(f"`{c}`").alias(a) for c, a in ((row_id, "row_id"), (url, "u"), (title, "t"), (company, "c"))]).where(F.col("row_id").isNotNull())
    rows = _folded(raw, ("u", "t", "c")).withColumn("u", canonical_url(F.col("u")))
    key = lambda a, b: F.concat_ws("\u0003", "u", canonical_title(F.col(a)), canonical_name(F.col(b)))
    keyed = rows.select("row_id", key("t", "c").alias("k"), key("c", "t").alias("other"), F.xxhash64(canonical_name(F.col("t"))).alias("tn"), F.xxhash64(canonical_name(F.col("c"))).alias("cn"))
    checked = lambda k: F.unhex(F.concat(F.md5(k), F.lpad(F.hex(F.xxhash64(k)), 16, "0")))
    return cut(keyed.select("row_id", checked("k").alias("h"), checked("other").alias("x"), "tn", "cn"))


def _classes(rows: DataFrame) -> DataFrame:
    """``h, first_row_id, copies, root``: classes of rows that agree as they stand; ``root`` joins exchanged ones."""
    classes = rows.groupBy("h").agg(F.min("row_id").alias("first_row_id"), F.count("*").alias("copies"))
    maybe = cut(rows.where("h != x").select("h", "x", "tn", "cn").distinct().join(classes.select(F.col("h").alias("x")), "x"))
    # how often each of their strings stands as title and as company; few strings, so the rows shrink before they are counted
    wanted = maybe.select(F.explode(F.array("tn", "cn")).alias("n")).distinct()
    places = rows.select(F.inline(F.array(F.struct(F.col("tn").alias("n"), F.lit(1).alias("t"), F.lit(0).alias("c")), F.struct(F.col("cn").alias("n"), F.lit(0).alias("t"), F.lit(1).alias("c")))))
    counts = places.join(wanted, "n", "left_semi").groupBy("n").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    judged = maybe.join(counts.toDF("tn", "tt", "tc"), "tn").join(counts.toDF("cn", "ct", "cc"), "cn")
    exchanged = judged.where("tc + ct >= tt + cc")
    roots = components(exchanged, "h", "x").select(F.col("node").alias("h"), F.col("component").alias("root"))
    return classes.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))


def _sets(classes: DataFrame) -> DataFrame:
    """``root, first_row_id, copies`` of each set of copies."""
    return classes.groupBy("root").agg(F.min("first_row_id").alias("first_row_id"), F.sum("copies").alias("copies"))


def copy_groups(df: DataFrame, row_id: str = "row_id", url: str = "url", title: str = "title", company: str = "company") -> DataFrame:
    """Each set of records that agree but for formatting, once: ``first_row_id, copies``.

    Records agree if url, title and company agree apart from white space, letter case, punctuation, the
    order of a url's query fields, the order of a title's words, compatibility forms of characters, and title and
    company being exchanged. Null
    and blank values agree with each other. Rows without id are left out, repeated ids count each; an empty
    table gives no rows; further columns are not read.
    """
    return _sets(_classes(_hashed(df, row_id, url, title, company))).select("first_row_id", "copies")


def collisions(df: DataFrame, row_id: str = "row_id", url: str = "url", title: str = "title", company: str = "company") -> DataFrame:
    """128-bit hashes that different canonical texts share (expected: none), found without moving the texts."""
    classes = _hashed(df, row_id, url, title, company).groupBy("h").agg(F.count("*").alias("records"))
    return classes.groupBy(F.substring("h", 1, 16).alias("hash")).agg(F.count("*").alias("texts"), F.sum("records").alias("records")).where("texts > 1")


def later_copies(df: DataFrame, row_id: str = "row_id", url: str = "url", title: str = "title", company: str = "company") -> DataFrame:
    """``first_row_id, row_id`` for each record but the first of its set of copies.

    The sets are counted first, on the map side as far as possible; only sets of two or more meet the rows
    again. That join's hot keys (a set may hold a third of all rows) are split by AQE's skew handling: one
    side has a single row a key, and both carry a few dozen bytes. Equal ids in a set count once.
    """
    rows = _hashed(df, row_id, url, title, company)
    classes = _classes(rows)
    several = _sets(classes).where("copies > 1").select("root", "first_row_id")
    members = classes.select("h", "root").join(several, "root").select("h", "first_row_id")
    return rows.select("h", "row_id").join(members, "h").where(F.col("row_id") > F.col("first_row_id")).select("first_row_id", "row_id").distinct()
