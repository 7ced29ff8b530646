"""Main content of pages: union-free wrappers inferred from the pages of one host.

A page is a stream of line tokens; numbers, the page's own title and company and the host's name are slots
within a token. The streams of a host are aligned into a wrapper, a union-free regular expression over nodes:

* Tokens that several pages share are constants. Tokens that differ but begin with the same words are aligned
  into one node, the shared words followed by a text slot; any other mismatch is a slot by its form alone: a
  sentence, a list point, a label ending in a colon, or a short line.
* Nodes that some pages lack are optional, runs of them that come and go together are optional groups, nodes
  that follow themselves are repeated groups.
* The wrapper of a page is ``furniture* ((heading)? content+ furniture*)*``. Which group a node belongs to
  is inferred from where it stands in the aligned pages, not from its wording: every page is matched against
  the expression with the nodes' present memberships (forward-backward over the three groups), the memberships
  are counted anew from the matches of all pages, and so on for ROUNDS. A heading is what content follows, a
  menu or a button also stands at a page's edges and beside its like, a list of other roles under its title is
  a repeated group of short lines in furniture.

There are no word lists, so the language of a page doesn't matter. Hosts are cut into blocks of bounded size,
each large enough for a wrapper of its own; hosts with few pages are pooled, so that what their platforms have
in common makes the nodes. Rows travel once, keyed by block; no statistics leave a block.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages that are aligned into one wrapper, about; larger hosts are cut into blocks, hosts of less than a quarter are pooled.
BLOCK_PAGES = 2_048
#: Hosts with blocks of their own whose sizes may be sent to the tasks at once; beyond, sizes are joined by a shuffle.
MAX_LARGE_HOSTS = 5_000
#: Pages on which a token, or the words a token begins with, must stand to be a constant; and most words of such a beginning.
SUPPORT, BEGINNING = 3, 6
#: Rounds in which the nodes' memberships are counted anew, and the power that makes those of shared short lines decisive.
ROUNDS, SHARPEN = 8, 3.0
#: Cells of the arrays that pages are matched in at once, which bounds their memory.
CELLS = 500_000

#: Forms of tokens.
SENTENCE, POINT, SHORT, LABEL = range(4)
#: Groups of the expression.
FURNITURE, HEADING, CONTENT = range(3)
#: What a node of each form is before any page is seen, and the weight that this keeps against the pages.
PRIOR = np.array([[0.20, 0.02, 0.78], [0.01, 0.01, 0.98], [0.53, 0.44, 0.03], [0.20, 0.70, 0.10]])
KEPT = np.array([0.40, 0.50, 0.05, 0.10])
#: The expression: which group follows which, which begins a page, and which ends one.
NEXT = np.array([[0.80, 0.03, 0.17], [0.03, 0.02, 0.95], [0.10, 0.20, 0.70]])
FIRST, LAST = np.array([0.60, 0.02, 0.38]), np.array([0.60, 0.01, 0.39])

_POINT = re.compile(r"^[*•·‣◦▪–-]\s+")
_NUMBER = re.compile(r"\d+")
_STOP = re.compile(r"[.!?…。！？][\"')\]»]*$")
_LONG = 160


def token(line: str, title: str = "", company: str = "", host: re.Pattern[str] | None = None) -> str:
    """A line as token: white space collapsed, own title, own company, host name and numbers as slots."""
    t = " ".join(line.split())
    if title and title in t:
        t = t.replace(title, "<title>")
    if company and company in t:
        t = t.replace(company, "<company>")
    if host is not None:
        t = host.sub("<host>", t)
    return _NUMBER.sub("0", t)


def form(t: str) -> int:
    """The form of a token: a list point, a sentence (or any long line), a label with a colon, or a short line."""
    if _POINT.match(t):
        return POINT
    if len(t) > _LONG or _STOP.search(t) and (len(t.split()) >= 4 or len(t) >= 12 and " " not in t):
        return SENTENCE
    return LABEL if t.endswith((":", "：")) else SHORT


def host_name(host: str) -> re.Pattern[str] | None:
    """The longest label of a host as a pattern; none if it's short, as it might be a word of any text."""
    label = max(host.split(".")[:-1] or [""], key=len)
    return re.compile(re.escape(label), re.I) if len(label) > 4 else None


class Page:
    """One page's non-blank tokens and the numbers of their lines."""

    __slots__ = ("row", "host", "tokens", "numbers", "clipped")

    def __init__(self, row: object, host: str, text: str, title: str | None, company: str | None, name: re.Pattern[str] | None = None, clip: int | None = None):
        self.row, self.host = row, host
        title, company = " ".join((title or "").split()), " ".join((company or "").split())
        found = [(i, t) for i, line in enumerate(text.split("\n")) if (t := token(line, title, company, name))]
        self.numbers, self.tokens = [i for i, _ in found], [t for _, t in found]
        self.clipped = clip is not None and len(text) >= clip


class Wrapper:
    """The nodes of a block of pages, their memberships in the expression's groups, and each page's match."""

    def __init__(self, pages: list[Page]):
        self.pages = pages
        self.support: Counter = Counter()
        for page in pages:
            seen: set[tuple[bool, str]] = set()
            for t in set(page.tokens):
                bare = _POINT.sub("", t)
                seen.add((True, t))
                words = bare.split(" ")
                seen.update((False, (bare != t) * "* " + " ".join(words[:k])) for k in range(2, min(len(words), BEGINNING + 1)))
            self.support.update(seen)
        self.nodes: list[str] = []
        self.forms: list[int] = []
        self.constant: list[bool] = []
        self._ids: dict[tuple[int, str], int] = {}
        self._known: dict[str, int] = {}
        self.streams = [[self._node(t) for t in page.tokens] for page in pages]
        self._complete()
        self._fit()

    def _node(self, t: str) -> int:
        """The node that a token is a text of: itself, its beginning and a slot, or the slot of its form."""
        at = self._known.get(t)
        if at is None:
            kind, name, constant = form(t), "", True
            if self.support[True, t] >= SUPPORT:
                name = t
            else:
                bare = _POINT.sub("", t)
                words, mark = bare.split(" "), "* " if bare != t else ""
                for k in range(min(len(words) - 1, BEGINNING), 1, -1):
                    if self.support[False, mark + " ".join(words[:k])] >= SUPPORT:
                        name = mark + " ".join(words[:k]) + " <text>"
                        break
                else:
                    name, constant = ("<sentence>", "<point>", "<short>", "<label>")[kind], False
            at = self._ids.get((kind, name))
            if at is None:
                at = self._ids[kind, name] = len(self.nodes)
                self.nodes.append(name)
                self.forms.append(kind)
                self.constant.append(constant)
            self._known[t] = at
        return at

    def _complete(self) -> None:
        """The cut last line of a clipped page is the constant that it begins."""
        whole = sorted(t for (full, t), n in self.support.items() if full and n >= SUPPORT)
        for page, stream in zip(self.pages, self.streams):
            if page.clipped and stream and self.support[True, page.tokens[-1]] < SUPPORT and not _POINT.match(page.tokens[-1]):
                at = bisect_left(whole, page.tokens[-1])
                if at < len(whole) and whole[at].startswith(page.tokens[-1]):
                    stream[-1] = self._node(whole[at])

    def _slabs(self) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Pages of similar length together: their numbers, their nodes as a (line, page) array with -1 beyond the end, and which are clipped."""
        order = sorted((i for i, s in enumerate(self.streams) if s), key=lambda i: len(self.streams[i]))
        while order:
            n = 1
            while n < len(order) and (n + 1) * len(self.streams[order[-1]]) <= CELLS:
                n += 1
            part, order = order[-n:], order[:-n]
            at = np.full((len(self.streams[part[-1]]), len(part)), -1)
            for j, i in enumerate(part):
                at[: len(self.streams[i]), j] = self.streams[i]
            yield part, at, np.array([self.pages[i].clipped for i in part])

    def _match(self, at: np.ndarray, clipped: np.ndarray, member: np.ndarray) -> np.ndarray:
        """The probability of each group for each (line, page), by forward-backward over the expression."""
        live = at >= 0
        weight = np.where(live[..., None], member[np.where(live, at, 0)], 1.0)
        ahead = np.empty_like(weight)
        now = FIRST * weight[0]
        now /= now.sum(-1, keepdims=True)
        ahead[0] = now
        for i in range(1, len(at)):
            new = (now @ NEXT) * weight[i]
            new /= new.sum(-1, keepdims=True)
            now = np.where(live[i][:, None], new, now)
            ahead[i] = now
        end = np.where(clipped[:, None], np.full(3, 1 / 3), LAST)
        now, out = end, np.empty_like(weight)
        for i in range(len(at) - 1, -1, -1):
            now = np.where(live[i][:, None], now, end)
            out[i] = now
            new = (now * weight[i]) @ NEXT.T
            now = np.where(live[i][:, None], new / new.sum(-1, keepdims=True), now)
        out *= ahead
        return out / out.sum(-1, keepdims=True)

    def _fit(self) -> None:
        n, slabs = len(self.nodes), list(self._slabs())
        forms, constant = np.array(self.forms, int), np.array(self.constant, bool)
        prior = PRIOR[forms] if n else np.zeros((0, 3))
        count = np.zeros(n)
        for stream in self.streams:
            np.add.at(count, stream, 1)
        edges = [Counter(s[k] for s in self.streams if s) for k in (0, -1)]
        # a constant that is neither sentence nor point and mostly begins or ends its pages is no heading
        short = constant & ((forms == SHORT) | (forms == LABEL))
        for k in np.flatnonzero(short):
            moved = prior[k, 1:] * min(1.0, 2 * max(edges[0][k], edges[1][k]) / count[k])
            prior[k, 1:] -= moved
            prior[k, 0] += moved.sum()
        member = prior.copy()
        for _ in range(ROUNDS):
            found = np.zeros((n, 3))
            for _, at, clipped in slabs:
                live = at >= 0
                p = self._match(at, clipped, member)
                for g in range(3):
                    found[:, g] += np.bincount(at[live], p[..., g][live], n)
            kept = (1 + KEPT[forms] * count)[:, None] if n else 0
            member = np.maximum((found + kept * prior) / (count[:, None] + kept), 0.003) if n else member
            # a short line that several pages share is a heading or furniture (as content it would fit any place); what also
            # stands where no heading can, at a page's end or before a heading, is furniture wherever it stands
            member[short, HEADING] += member[short, CONTENT]
            member[short, CONTENT] = 0.003
            member[short] **= SHARPEN
            member[short] /= member[short].sum(-1, keepdims=True)
            member[short] = np.maximum(member[short], 0.003)
            member = np.where(constant[:, None], member, prior)
        self.member = member
        self.match: list[np.ndarray] = [np.zeros(0, int)] * len(self.streams)
        for part, at, clipped in slabs:
            p = self._match(at, clipped, member)
            for j, i in enumerate(part):
                self.match[i] = p[: len(self.streams[i]), j].argmax(-1)

    def furniture(self, i: int) -> list[int]:
        """Numbers of the lines of page ``i`` that match furniture; none on a page without any content."""
        groups = self.match[i]
        if not (groups != FURNITURE).any():
            return []
        return [n for n, g in zip(self.pages[i].numbers, groups.tolist()) if g == FURNITURE]

    def pattern(self, host: str) -> str:
        """The expression of one host's pages: ``[f]``, ``[h]`` and ``[c]`` open runs of furniture, headings and content;
        all content is one slot.

        ``(a)?`` is optional, ``(a)+`` repeated, ``(a)*`` both, ``(a b)?`` a group that comes and goes together.
        """
        own = [i for i, page in enumerate(self.pages) if page.host == host and self.streams[i]]
        line = Alignment()
        for i in own:
            line.align([("<content>" if g == CONTENT else self.nodes[k], int(g)) for k, g in zip(self.streams[i], self.match[i].tolist())])
        return line.pattern()


class Alignment:
    """Streams of (node, group) aligned one after the other; a stream's longest ordered run of known nodes is matched."""

    def __init__(self) -> None:
        self.nodes: list[tuple[str, int]] = []
        self.on: list[set[int]] = []
        self.repeated: list[bool] = []
        self.streams = 0

    def align(self, stream: list[tuple[str, int]]) -> None:
        self.streams += 1
        once: list[tuple[str, int]] = []
        many: list[bool] = []
        for x in stream:
            if once and once[-1] == x:
                many[-1] = True
            else:
                once.append(x)
                many.append(False)
        place = {x: p for p, x in reversed(list(enumerate(self.nodes)))}
        ends: list[int] = []  # the last element of the best run of each length (by patience)
        tails: list[int] = []
        back = [-1] * len(once)
        for i, x in enumerate(once):
            if (p := place.get(x)) is None:
                continue
            j = bisect_left(tails, p)
            back[i] = ends[j - 1] if j else -1
            if j == len(tails):
                tails.append(p)
                ends.append(i)
            else:
                tails[j], ends[j] = p, i
        run = {}
        i = ends[-1] if ends else -1
        while i >= 0:
            run[i] = place[once[i]]
            i = back[i]
        nodes, on, repeated, at = [], [], [], 0
        for i, x in enumerate(once):
            if i in run:
                p = run[i]
                nodes += self.nodes[at : p + 1]
                on += self.on[at : p + 1]
                repeated += self.repeated[at : p + 1]
                at = p + 1
                on[-1].add(self.streams)
                repeated[-1] |= many[i]
            elif x in place:  # met again out of order: its node is repeated
                self.on[place[x]].add(self.streams)
                self.repeated[place[x]] = True
                if place[x] < at:
                    repeated[nodes.index(x)] = True
            else:
                nodes.append(x)
                on.append({self.streams})
                repeated.append(many[i])
        self.nodes, self.on, self.repeated = nodes + self.nodes[at:], on + self.on[at:], repeated + self.repeated[at:]

    def pattern(self) -> str:
        out, i, group = [], 0, None
        while i < len(self.nodes):
            j = i + 1
            while j < len(self.nodes) and self.on[j] == self.on[i] and self.nodes[j][1] == self.nodes[i][1] and not (self.repeated[i] or self.repeated[j]):
                j += 1
            if self.nodes[i][1] != group:
                group = self.nodes[i][1]
                out.append(("[f]", "[h]", "[c]")[group])
            optional = len(self.on[i]) < self.streams
            mark = ("*" if optional else "+") if self.repeated[i] else "?" if optional else ""
            out.append("(" + " ".join(x for x, _ in self.nodes[i:j]) + ")" + mark)
            i = j
        return " ".join(out)


def _host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?([^/?#:\s]+)", 1), F.lit(""))


def _keyed(df: DataFrame, row_id: str, url: str, text: str, title: str, company: str) -> DataFrame:
    """The rows with their host and block: a large host's rows by their id, small hosts as a whole in pools."""
    rows = df.select(
        F.col(f"`{row_id}`").alias("row_id"), _host(F.col(f"`{url}`")).alias("host"), F.col(f"`{title}`").alias("title"),
        F.col(f"`{company}`").alias("company"), F.col(f"`{text}`").alias("text"),
    ).where("row_id is not null and text is not null")
    hosts = df.where(F.col(f"`{text}`").isNotNull()).select(_host(F.col(f"`{url}`")).alias("host")).groupBy("host").agg(F.count("*").alias("n"))
    is_large = F.col("n") >= BLOCK_PAGES // 4
    small = hosts.agg(F.coalesce(F.sum(F.when(~is_large, F.col("n"))), F.lit(0)).alias("n")).first()["n"]
    sizes = hosts.where(is_large)
    large = sizes.limit(MAX_LARGE_HOSTS + 1).collect()
    if len(large) <= MAX_LARGE_HOSTS:
        sizes = F.broadcast(df.sparkSession.createDataFrame([(r["host"], r["n"]) for r in large], "host string, n bigint"))
    own = F.concat(F.col("host"), F.lit("|"), F.pmod(F.xxhash64("row_id"), F.ceil(F.col("n") / BLOCK_PAGES)).cast("string"))
    pool = F.concat(F.lit("|"), F.pmod(F.xxhash64("host"), F.lit(max(1, round(small / BLOCK_PAGES)))).cast("string"))
    return rows.join(sizes, "host", "left").withColumn("block", F.when(F.col("n").isNull(), pool).otherwise(own)).drop("n")


def _wrapped(df: DataFrame, row_id: str, url: str, text: str, title: str, company: str, clip: int | None, out: Callable[[Wrapper, list[str]], dict[str, list]], schema: str) -> DataFrame:
    """The rows that ``out`` makes of each block's wrapper and its pages' texts."""
    keyed = _keyed(df, row_id, url, text, title, company).select("block", "host", "row_id", "title", "company", "text").repartition("block").sortWithinPartitions("block", "row_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pages, texts, names = None, [], [], {}

        def finish(kinds: pa.Schema) -> pa.RecordBatch:
            cols = out(Wrapper(pages), texts)
            return pa.RecordBatch.from_arrays([pa.array(v, kinds.field("row_id").type if k == "row_id" else {"line_no": pa.int32(), "pages": pa.int32()}.get(k, pa.string())) for k, v in cols.items()], names=list(cols))

        kinds = None
        for batch in batches:
            kinds = batch.schema
            for block, host, row, title_, company_, value in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if block != key:
                    if pages:
                        yield finish(kinds)
                    key, pages, texts, names = block, [], [], {}
                if host not in names:
                    names[host] = host_name(host)
                pages.append(Page(row, host, value, title_, company_, names[host], clip))
                texts.append(value)
        if pages:
            yield finish(kinds)

    return keyed.mapInArrow(run, schema)


def furniture_lines(
    df: DataFrame, row_id: str = "row_id", url: str = "url", text: str = "description", title: str = "title", company: str = "company", clip: int | None = 1_500
) -> DataFrame:
    """``row_id, line_no`` of each non-blank line that isn't part of the posting; lines are cut at U+000A from 0.

    Texts of ``clip`` characters count as cut off there (None: no text does). Null and empty texts have no lines
    of either sort; rows with a null id are left out; null and unreadable urls are a host of their own; texts
    without any line of content (error pages, mostly) have no row; repeated rows are judged each; an empty
    table gives no rows; further columns are not read. In a table of few pages, where nothing is shared by
    SUPPORT pages, the forms and places of the lines alone decide.
    """
    kind_ = df.schema[row_id].dataType.simpleString()

    def out(w: Wrapper, _: list[str]) -> dict[str, list]:
        found = [(page.row, n) for i, page in enumerate(w.pages) for n in w.furniture(i)]
        return {"row_id": [r for r, _ in found], "line_no": [n for _, n in found]}

    return _wrapped(df, row_id, url, text, title, company, clip, out, f"row_id {kind_}, line_no int").withColumnRenamed("row_id", row_id)


def wrappers(
    df: DataFrame, row_id: str = "row_id", url: str = "url", text: str = "description", title: str = "title", company: str = "company", clip: int | None = 1_500
) -> DataFrame:
    """``host, pages, wrapper``: the expression of each host's pages in each block; the groups are those that ``furniture_lines`` finds."""

    def out(w: Wrapper, _: list[str]) -> dict[str, list]:
        sizes = Counter(page.host for page in w.pages)
        return {"host": list(sizes), "pages": list(sizes.values()), "wrapper": [w.pattern(h) for h in sizes]}

    return _wrapped(df, row_id, url, text, title, company, clip, out, "host string, pages int, wrapper string")


def main_content(
    df: DataFrame, row_id: str = "row_id", url: str = "url", text: str = "description", title: str = "title", company: str = "company", clip: int | None = 1_500
) -> DataFrame:
    """``row_id, text`` with the furniture lines taken out, in the same pass; rows with a null text or id are left out."""
    kind_ = df.schema[row_id].dataType.simpleString()

    def out(w: Wrapper, texts: list[str]) -> dict[str, list]:
        kept = []
        for i, value in enumerate(texts):
            gone = set(w.furniture(i))
            kept.append("\n".join(line for n, line in enumerate(value.split("\n")) if n not in gone) if gone else value)
        return {"row_id": [page.row for page in w.pages], "text": kept}

    return _wrapped(df, row_id, url, text, title, company, clip, out, f"row_id {kind_}, text string").withColumnsRenamed({"row_id": row_id, "text": text})
