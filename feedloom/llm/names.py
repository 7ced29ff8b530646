"""Variant spellings of names: weighted n-gram vectors, sparse cosine join, average-linkage clustering.

A name is parsed into its own words, a given name and its line of trade (``nameparts``); names with equal
parts are one node. A node's vector holds the three-letter sequences of its own words, weighted by inverse
document frequency. Nodes of one trade meet in a sparse join over an inverted index: only the heaviest
sequences of a vector are indexed, as many as needed so that no pair at or above the threshold is missed
(prefix filtering). Nodes whose trade is left out or incomplete meet those of every trade. The alphabet bounds
the sequences, so lists grow with the table and their pairs with its square; nodes of a long list meet in a
second index instead, by their letters (``signatures``): spellings of one name have the same letters in some
order but for the errors allowed, so no link is missed and few other pairs meet. A pair is linked if its
cosine reaches the threshold and an exact comparison of the parts finds spellings of one. Connected links are
then clustered by average linkage, which keeps chains of small differences from joining different organisations.

The gram statistics, one count for each three-letter sequence, are bounded by the alphabet.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.codepoints import codes, text_hash
from feedloom.llm.components import components
from feedloom.llm.nameparts import allowed, edits, fold, parse, same_core, same_given
from feedloom.plans.lineage import cut

#: Least cosine of links between nodes of one trade, and of links of nodes without a full trade.
SAME_TRADE, OPEN_TRADE = 0.3, 0.6
#: Least mean cosine at which two clusters join.
LINKAGE = 0.3
#: Entries of a list above which its nodes meet by their letters.
HOT = 16
#: Letters of a word that may stand for a name with words left out.
LONG_WORD = 8
#: Texts whose signatures are made at once, which bounds the memory of the arrays.
SLAB = 2_000
#: Sequences whose counts are kept; an alphabet of 50 letters has 125,000.
MAX_GRAMS = 200_000
#: Trades of which the counts are kept (the most frequent), and towns.
MAX_TRADES, MAX_PLACES = 20_000, 5_000
#: Nodes of a component that are clustered over a matrix; larger ones are clustered over sums of vectors.
MAX_MATRIX = 200


def grams(core: str) -> list[str]:
    """The three-letter sequences of a node's own words written together, each once."""
    text = core.replace(" ", "")
    return list(dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2))) or [text]


class Vectors:
    """Unit vectors of cores, remembered; ``counts`` holds each sequence's document frequency."""

    def __init__(self, counts: dict[str, int], n: int):
        self.counts, self.n = counts, n
        self.known: dict[str, dict[str, float]] = {}

    def of(self, core: str) -> dict[str, float]:
        """The vector, heaviest sequence first."""
        v = self.known.get(core)
        if v is None:
            if len(self.known) > 200_000:
                self.known = {}
            w = {g: math.log(1 + self.n / self.counts.get(g, 1)) for g in grams(core)}
            norm = math.sqrt(sum(x * x for x in w.values()))
            v = self.known[core] = {g: x / norm for g, x in sorted(w.items(), key=lambda gx: (-gx[1], gx[0]))}
        return v

    def prefix(self, core: str, threshold: float) -> list[str]:
        """The heaviest sequences; the rest is shorter than ``threshold``, so a pair that reaches it shares one of these."""
        out, left = [], 1.0
        for g, x in self.of(core).items():
            if left < threshold * threshold - 1e-9:
                break
            out.append(g)
            left -= x * x
        return out

    def cosine(self, a: str, b: str) -> float:
        v, w = self.of(a), self.of(b)
        if len(w) < len(v):
            v, w = w, v
        return sum(x * w[g] for g, x in v.items() if g in w)


def places_of(df: DataFrame, column: str = "location") -> frozenset[str]:
    """Folded names of the towns in a location column, at most MAX_PLACES, the most frequent."""
    town = F.trim(F.split(F.col(f"`{column}`"), ",")[0])
    rows = df.select(town.alias("t")).where("t != ''").groupBy("t").count().orderBy(F.desc("count"), "t").limit(MAX_PLACES).collect()
    return frozenset(fold(r["t"]) for r in rows)


def parsed(names: DataFrame, places: frozenset[str] = frozenset()) -> DataFrame:
    """``name, core, given, trade, node`` of each distinct name of the single column; names of nobody are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, " ".join(p.core), p.given, " ".join(p.trade)) for n in batch.column(0).to_pylist() if (p := parse(n, places)) is not None and p.core]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["name", "core", "given", "trade"])

    distinct = names.toDF("name").where("name is not null").distinct()
    out = distinct.mapInArrow(run, "name string, core string, given string, trade string")
    return out.withColumn("node", F.concat_ws("|", "core", "given", "trade"))


def complete_trades(nodes: DataFrame) -> set[str]:
    """Trades that stand for themselves: no longer trade with the same words is five times as frequent."""
    rows = nodes.where("trade != ''").groupBy("trade").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "trade").limit(MAX_TRADES).collect()
    count = {frozenset(r["trade"].split()): r["n"] for r in rows}
    by_word = defaultdict(list)
    for t in count:
        for w in t:
            by_word[w].append(t)
    best = {t: max((count[s] for s in by_word[next(iter(t))] if t < s), default=0) for t in count}
    return {" ".join(sorted(t)) for t, n in count.items() if n * 5 > best[t]}


def _vectors(nodes: DataFrame) -> Vectors:
    text = F.translate("core", " ", "")
    three = F.when(F.length(text) < 3, F.array(text)).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))
    )
    cores = nodes.select("core").distinct()
    rows = cores.select(F.explode(three).alias("g")).groupBy("g").count().orderBy(F.desc("count"), "g").limit(MAX_GRAMS).collect()
    return Vectors({r["g"]: r["count"] for r in rows}, cores.count())


def _fits(core_a: str, given_a: str, trade_a: str, open_a: bool, core_b: str, given_b: str, trade_b: str, open_b: bool) -> bool:
    """Whether two nodes can be one organisation by their parts."""
    if not same_given(given_a, given_b):
        return False
    a, b = tuple(core_a.split()), tuple(core_b.split())
    if not (open_a or open_b):
        return trade_a == trade_b and same_core(a, b)
    x, y = set(trade_a.split()), set(trade_b.split())
    if not (x <= y if open_a and not open_b else y <= x if open_b and not open_a else x <= y or y <= x):
        return False
    if same_core(a, b):
        return True
    # an own word left out: all words of the shorter side, one of them long, are on the other
    if len(b) < len(a):
        a, b, open_a, open_b = b, a, open_b, open_a
    return open_a and len(a) < len(b) and max(map(len, a)) >= 8 and all(any(edits(w, v, allowed(len(w))) <= allowed(len(w)) for v in b) for w in a)


#: Summands of the letters' classes, and of the kinds of signatures: of cores in one trade, of cores, of words.
_LETTER = np.random.default_rng(11).integers(1, 1 << 63, 32, dtype=np.uint64) | np.uint64(1)
_IN_TRADE, _CORE, _WORD = 0, 1, 2
_KIND = np.random.default_rng(12).integers(1, 1 << 63, 3, dtype=np.uint64)


def signatures(texts: list[str], most: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, key and letters left out (a bit for each class) of each text without up to ``most`` of its letters, 3 at most.

    The key is a sum over the letters, so their order doesn't matter; letters count by 32 classes, which bounds the
    keys of a text in any script. An error adds a letter, takes one away, or both, so two texts within ``most`` errors
    of each other, blanks and the order of words aside, have a key in common; one with no class left out by both is the
    key of all letters they share, so it is the only one.
    """
    n = len(texts)
    cp = codes("".join(texts))
    owner = np.repeat(np.arange(n), np.fromiter(map(len, texts), np.int64, n))
    owner, cp = owner[cp != 32], cp[cp != 32]
    count = np.bincount(owner * 32 + (cp & 31), minlength=32 * n).reshape(n, 32)
    total = (count.astype(np.uint64) * _LETTER).sum(1, dtype=np.uint64)
    at, key, gone = [np.arange(n)], [total], [np.zeros(n, np.int64)]
    errors = np.array(most, np.int64)
    for size in range(1, 4):
        some = np.flatnonzero(errors >= size)
        own = np.ascontiguousarray(count[some].T)
        for letters in combinations_with_replacement(np.flatnonzero(own.any(1)).tolist(), size) if len(some) else ():
            need = Counter(letters)
            fit = some[np.flatnonzero(np.logical_and.reduce([own[c] >= m for c, m in need.items()]))]
            if len(fit):
                at.append(fit)
                key.append(total[fit] - _LETTER[list(letters)].sum(dtype=np.uint64))
                gone.append(np.full(len(fit), sum(1 << c for c in need), np.int64))
    return np.concatenate(at), np.concatenate(key), np.concatenate(gone)


def _by_letters(crowded: DataFrame, known: Broadcast) -> DataFrame:
    """Pairs of ``node, in_trade, in_gram`` that can be spellings of one by their letters.

    Nodes of one full trade meet by their cores. A node without one asks every node by its core, and those of more
    words by its longest word, as ``_fits`` wants that word on the other side. Keys are sorted, and those that are
    equal are paired; a task holds the nodes of one key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, SLAB) for i in range(0, whole.num_rows, SLAB)):
                texts: list[str] = []
                most, at, kind, asking, answering, trades, opened = [], [], [], [], [], [], []

                def add(i: int, text: str, errors: int, of: int, asks: bool, answers: bool, trade: str = "") -> None:
                    for column, value in zip((texts, most, at, kind, asking, answering, trades, opened), (text, errors, i, of, asks, answers, trade, is_open)):
                        column.append(value)

                for i, (node, in_trade, in_gram) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(3)])):
                    core, _, trade = node.split("|")
                    is_open, size, words = trade not in known.value, len(core.replace(" ", "")), core.split()
                    if in_trade:
                        add(i, core, allowed(size), _IN_TRADE, True, True, trade)
                    if in_gram:
                        add(i, core, allowed(size), _CORE, is_open, True)
                        longest = max(words, key=len)
                        if is_open and len(longest) >= LONG_WORD:
                            add(i, longest, allowed(len(longest)), _WORD, True, False)
                        # the other's word decides on the errors, and may be longer by as many
                        for w in set(words) if len(words) > 1 else ():
                            if len(w) + allowed(len(w) + 3) >= LONG_WORD:
                                add(i, w, allowed(len(w) + 3), _WORD, False, True)
                if not texts:
                    continue
                text, key, gone = signatures(texts, most)
                shift = _KIND[kind] + np.fromiter((_hash(t) for t in trades), np.uint64, len(trades))
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key + shift[text]).view(np.int64)), pa.array(gone), batch.column(0).take(pa.array(np.array(at)[text])), *[pa.array(x, pa.bool_()).take(take) for x in (opened, asking, answering)]],
                    names=["key", "gone", "node", "open", "asks", "answers"],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in (b for b in batches if b.num_rows):
            rows = pa.Table.from_batches([batch] if left is None else [left, batch]).combine_chunks().to_batches()[0]
            # rows of the last key wait for the next batch
            key = rows.column(0).to_numpy(zero_copy_only=False)
            done = int(np.searchsorted(key, key[-1]))
            left = rows.slice(done)
            yield from pairs(rows.slice(0, done))
        if left is not None:
            yield from pairs(left)

    def pairs(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, gone, asks, answers = (rows.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 4, 5))
        for far in range(1, len(key)):
            i = np.flatnonzero(key[:-far] == key[far:])
            if not len(i):
                break
            i = i[gone[i] & gone[i + far] == 0]
            there, back = asks[i] & answers[i + far], asks[i + far] & answers[i]
            a, b = pa.array(np.where(there, i, i + far)[there | back]), pa.array(np.where(there, i + far, i)[there | back])
            if len(a):
                node, is_open = rows.column(2), rows.column(3)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.string()), node.take(a), is_open.take(a), node.take(b), is_open.take(b)], names=["gram", "a_node", "a_open", "b_node", "b_open"])

    keys = crowded.mapInArrow(run, "key bigint, gone bigint, node string, open boolean, asks boolean, answers boolean")
    met = keys.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "gram string, a_node string, a_open boolean, b_node string, b_open boolean")
    return met.where("a_node != b_node")


def _hash(text: str, cache: dict[str, int] = {}) -> int:  # noqa: B006
    """A 64-bit hash that is the same in every process."""
    if (h := cache.get(text)) is None:
        if len(cache) > MAX_TRADES:
            cache.clear()
        h = cache[text] = text_hash(text.encode())
    return h


def candidates(nodes: DataFrame, vectors: Broadcast, whole: Broadcast) -> DataFrame:
    """``gram, a_node, a_open, b_node, b_open`` of the pairs to compare, a superset of the links.

    Short lists of the index are paired; ``gram`` is the list's. Nodes of longer ones meet by letters; ``gram`` is null.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = vectors.value, whole.value
        for batch in batches:
            at, opened, of, key = [], [], [], []
            for i, node in enumerate(batch.column(0).to_pylist()):
                core, _, trade = node.split("|")
                is_open = trade not in known
                lists = [("", g) for g in v.prefix(core, OPEN_TRADE)]
                if not is_open:
                    lists += [(trade, g) for g in v.prefix(core, SAME_TRADE)]
                for t, g in lists:
                    at.append(i)
                    opened.append(is_open)
                    of.append(t)
                    key.append(g)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(opened, pa.bool_()), pa.array(of, pa.string()), pa.array(key, pa.string())], names=["node", "open", "trade", "gram"])

    # a list without a trade is for pairs with a node that has no full one
    entries = cut(nodes.select("node").mapInArrow(index, "node string, open boolean, trade string, gram string"))
    sizes = entries.groupBy("trade", "gram").agg(F.count("*").alias("n"), F.max("open").alias("any_open")).where("n > 1 and (trade != '' or any_open)").select("trade", "gram", (F.col("n") > HOT).alias("hot"))
    listed = cut(entries.join(sizes, ["trade", "gram"]))
    short = listed.where("not hot")
    a, b = (short.select("trade", "gram", F.col("node").alias(f"{x}_node"), F.col("open").alias(f"{x}_open")) for x in "ab")
    # ``allowed`` grants three errors at most; blanks don't count, as words may be written together
    size = lambda c: F.length(F.replace(F.substring_index(c, "|", 1), F.lit(" "), F.lit("")))
    near = F.abs(size("a_node") - size("b_node")) <= allowed(10**6)
    once = F.when(F.col("a_open") == F.col("b_open"), F.col("a_node") < F.col("b_node")).otherwise(F.col("a_open"))
    pairs = a.join(b, ["trade", "gram"]).where(once & F.when(F.col("trade") != "", near).otherwise(F.col("a_open"))).select("gram", "a_node", "a_open", "b_node", "b_open")
    crowded = listed.where("hot").groupBy("node").agg(F.max(F.col("trade") != "").alias("in_trade"), F.max(F.col("trade") == "").alias("in_gram"))
    return pairs.unionByName(_by_letters(crowded, whole))


def links(nodes: DataFrame) -> DataFrame:
    """``a, b, cosine``, a < b, of the linked nodes among ``node, core, given, trade``."""
    spark = nodes.sparkSession
    vectors = spark.sparkContext.broadcast(_vectors(nodes))
    whole = spark.sparkContext.broadcast(complete_trades(nodes))
    pairs = candidates(nodes, vectors, whole)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vectors.value
        for batch in batches:
            out = []
            for gram, node_a, open_a, node_b, open_b in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if open_a == open_b and node_b < node_a:
                    node_a, node_b = node_b, node_a
                (core_a, given_a, trade_a), (core_b, given_b, trade_b) = node_a.split("|"), node_b.split("|")
                least = OPEN_TRADE if open_a or open_b else SAME_TRADE
                # a pair of lists is judged in the first that it meets in
                if gram is not None and next((g for g in v.of(core_a) if g in v.of(core_b)), None) != gram:
                    continue
                c = v.cosine(core_a, core_b)
                if c >= least and _fits(core_a, given_a, trade_a, open_a, core_b, given_b, trade_b, open_b):
                    out.append((node_a, node_b, open_a, open_b, trade_a, trade_b, c))
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["a", "b", "open_a", "open_b", "trade_a", "trade_b", "cosine"])

    found = cut(pairs.mapInArrow(verify, "a string, b string, open_a boolean, open_b boolean, trade_a string, trade_b string, cosine double"))
    # a node without a full trade goes with the trade of its closest spelling, if only one has it
    sides = found.where("open_a and not open_b").select(F.col("a").alias("node"), F.col("trade_b").alias("trade"), "cosine")
    best = sides.groupBy("node").agg(F.max("cosine").alias("top"))
    close = sides.join(best, "node").where(F.col("cosine") >= F.col("top") - 0.1).groupBy("node").agg(F.count_distinct("trade").alias("trades"), F.min("trade").alias("own"))
    settled = found.join(close.select(F.col("node").alias("a"), "trades", "own"), "a", "left")
    keep = settled.where((F.col("open_a") == F.col("open_b")) | ((F.col("trades") == 1) & (F.col("own") == F.col("trade_b"))))
    return keep.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine").distinct()


def _fit(given: str, trade: str, given_: str, trade_: str, whole: set[str]) -> bool:
    """Whether given names and trades of two nodes of a component can be one organisation's."""
    return same_given(given, given_) and (trade == trade_ or ((trade not in whole or trade_ not in whole) and (set(trade.split()) <= set(trade_.split()) or set(trade_.split()) <= set(trade.split()))))


def average_linkage(nodes: list[tuple[str, str, str, str]], vectors: Vectors, whole: set[str], least: float = LINKAGE) -> list[int]:
    """The cluster number of each of a component's nodes (node, core, given, trade)."""
    n = len(nodes)
    if n == 2:
        return [0, 0]  # a link by itself reaches the threshold
    sim = [[0.0] * n for _ in range(n)]
    for i in range(n):
        _, core, given, trade = nodes[i]
        for j in range(i):
            _, other, given_, trade_ = nodes[j]
            sim[i][j] = sim[j][i] = vectors.cosine(core, other) if _fit(given, trade, given_, trade_, whole) else 0.0
    groups = {i: [i] for i in range(n)}
    while len(groups) > 1:
        top = max(((sim[i][j], -i, -j) for i in groups for j in groups if j < i))
        if top[0] < least:
            break
        i, j = -top[1], -top[2]
        a, b = len(groups[i]), len(groups[j])
        for k in groups:
            sim[j][k] = sim[k][j] = (a * sim[i][k] + b * sim[j][k]) / (a + b)
        groups[j] += groups.pop(i)
    out = [0] * n
    for c, members in groups.items():
        for m in members:
            out[m] = c
    return out


def chained_linkage(nodes: list[tuple[str, str, str, str]], vectors: Vectors, whole: set[str], least: float = LINKAGE) -> list[int]:
    """The clusters of ``average_linkage`` without its matrix, by chains of nearest neighbours.

    The sum of the cosines between two clusters is the product of their summed vectors, which are kept for each
    given name and trade, as nodes whose parts don't fit count 0. No pair is left out; memory grows with the nodes,
    time with their square. Clusters that are each other's nearest can be joined in any order with average linkage,
    and one whose nearest is below ``least`` never comes nearer to any.
    """
    kinds: dict[tuple[str, str], int] = {}
    for _, _, given, trade in nodes:
        kinds.setdefault((given, trade), len(kinds))
    fits = [[d for (given_, trade_), d in kinds.items() if _fit(given, trade, given_, trade_, whole)] for given, trade in kinds]
    groups = {i: [i] for i in range(len(nodes))}
    sums = {i: {(kinds[given, trade], g): x for g, x in vectors.of(core).items()} for i, (_, core, given, trade) in enumerate(nodes)}
    index: dict[tuple[int, str], dict[int, float]] = defaultdict(dict)
    for i, v in sums.items():
        for key, x in v.items():
            index[key][i] = x

    def nearest(i: int, before: int | None) -> int | None:
        total: dict[int, float] = defaultdict(float)
        for (c, g), x in sums[i].items():
            for d in fits[c]:
                for k, y in index.get((d, g), {}).items():
                    total[k] += x * y
        total.pop(i, None)
        mean = {k: t / (len(groups[i]) * len(groups[k])) for k, t in total.items()}
        top = max(mean.values(), default=0.0)
        if top < least:
            return None
        # rounding must not send a chain in circles
        return before if before is not None and mean.get(before, 0.0) >= top - 1e-9 else min(k for k, m in mean.items() if m >= top - 1e-9)

    def leave(i: int) -> dict[tuple[int, str], float]:
        for key in sums[i]:
            del index[key][i]
        return sums.pop(i)

    chain: list[int] = []
    while sums:
        if not chain:
            chain.append(min(sums))
        i, before = chain[-1], chain[-2] if len(chain) > 1 else None
        k = nearest(i, before)
        if k is None:
            leave(i)
            chain.pop()
        elif k != before:
            chain.append(k)
        else:
            del chain[-2:]
            i, j = max(i, k), min(i, k)
            for key, x in leave(i).items():
                sums[j][key] = index[key][j] = sums[j].get(key, 0.0) + x
            groups[j] += groups.pop(i)
    out = [0] * len(nodes)
    for c, members in groups.items():
        for m in members:
            out[m] = c
    return out


def clusters(names: DataFrame, places: frozenset[str] = frozenset()) -> DataFrame:
    """``name, cluster`` of every distinct name of the single column of ``names`` that names an organisation.

    Null and blank strings, those that name nobody (Unknown, Confidential) and job titles are left out; names
    without a link are clusters of their own. An empty table gives no rows. No cap is set on links.
    """
    every = cut(parsed(names, places))
    nodes = every.select("node", "core", "given", "trade").distinct()
    linked = components(links(nodes))
    spark = names.sparkSession
    vectors, whole = spark.sparkContext.broadcast(_vectors(nodes)), spark.sparkContext.broadcast(complete_trades(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(members: list[tuple[str, str, str, str]]) -> Iterator[tuple[str, str]]:
            linkage = average_linkage if len(members) <= MAX_MATRIX else chained_linkage
            members = sorted(members, key=lambda x: x[1])
            first = {}
            for m, c in zip(members, linkage(members, vectors.value, whole.value)):
                yield m[0], first.setdefault(c, m[0])

        out: list[tuple[str, str]] = []
        key, members = None, []
        for batch in batches:
            for component, *member in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if component != key:
                    out += judged(members) if members else []
                    key, members = component, []
                members.append(tuple(member))
        out += judged(members) if members else []
        cols = list(zip(*out)) if out else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["node", "cluster"])

    grouped = nodes.join(linked, "node").select("component", "node", "core", "given", "trade").repartition("component").sortWithinPartitions("component", "node")
    found = grouped.mapInArrow(run, "node string, cluster string")
    return every.select("name", "node").join(found, "node", "left").select("name", F.coalesce("cluster", "node").alias("cluster"))


def same_organisation(names: DataFrame, places: frozenset[str] = frozenset()) -> DataFrame:
    """``name_a, name_b``, name_a < name_b by code point, of each two different strings of one organisation."""
    members = cut(clusters(names, places))
    several = members.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    kept = members.join(several, "cluster", "left_semi")
    a, b = kept.select("cluster", F.col("name").alias("name_a")), kept.select("cluster", F.col("name").alias("name_b"))
    return a.join(b, "cluster").where("name_a < name_b").select("name_a", "name_b")
