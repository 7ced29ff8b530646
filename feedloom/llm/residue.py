"""Template residue, filler and error-page text, by positive-unlabelled naive Bayes.

A field is cut into units of two kinds: marked spans (``{{x}}``, ``[x]``, ``<%= x %>`` and the like) and
passages (lines and sentences). Each kind has a naive Bayes model learnt from positives that can be trusted
and from unlabelled units by expectation-maximisation: at first every unlabelled unit counts as real text,
then, in rounds, units that the model finds positive count for the positive class, and the model is
estimated anew. A passage counts as positive only as far as the rest of its field is.

Trusted are the passages of the seed records below, and spans in syntaxes that prose doesn't use; every unit,
trusted or not, is decided by its score. Passages have two positive classes: notes to the author, which spoil
a text wherever they stand, and filler or messages, which make a field a case when they carry most of it.

Features are words and pairs of neighbouring words, hashed into 2**BITS buckets, so the model has
one size whatever the table's. Every round is a pass over all rows: the tasks score and count whole batches by
array operations and hand on sums of buckets, which are added up in two steps. Nothing else is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from feedloom.llm.codepoints import slice_hashes, text_hash

#: Logarithms of the numbers of buckets of passage and of span features.
BITS, SPAN_BITS = 18, 16
#: Rounds of expectation-maximisation, and the least posterior with which an unlabelled unit counts as positive.
ROUNDS, SURE_SHARE = 2, 0.9
#: Prior probabilities of positive passages and spans; they aren't fitted, else the classes drift.
PRIOR, SPAN_PRIOR = 0.02, 0.5
#: Weight of the smoothing and least weight of one feature, of passages and of spans, and the greatest weight: the positive examples are too few for more.
OF_PASSAGES, OF_SPANS, HIGH = (2.0, -2.0), (0.2, -1.5), 6.0
#: Share of a text's letters that filler or messages must carry to make it a case.
MOST = 0.5
#: Characters that are scored at once, which bounds the memory of the arrays; a longer text is scored by itself.
SLAB_CHARS = 2_000_000

REAL, NOTE, FILLER = 0, 1, 2

#: Seed records of positive passages (fixed values): standard texts of servers, browsers and page builders.
SEEDS = {
    FILLER: """404 Not Found|Error 404|403 Forbidden|500 Internal Server Error|Error 500 - Internal|502 Bad gateway|Bad gateway|503 Service Unavailable|Service Unavailable|504 Gateway Timeout|Access Denied
Page not found|Page introuvable|The page you requested could not be found.|The page you are looking for could not be found.|La page demandée est introuvable.|HTTP status 404.|HTTP status 500.
Oops! Something went wrong|Something went wrong while we tried to load the page.|An error occurred, please try again later.|Une erreur est survenue, veuillez réessayer.|Une erreur est survenue, veuillez revenir plus tard.
Your session has expired; please sign in again.|Session expired|You don't have permission to open this page.|We cannot complete this request right now.|The server took too long to respond.|Reference number: 1a2b3c.
Please go back or try again later.|Please go back or return to the start page.|Cannot read property 'name' of undefined|Uncaught TypeError: undefined is not a function|At render (main.1a2b.js:1:2)|[object Object]|undefined|null|NaN
This job no longer exists|Job no longer exists|This posting may have expired.|This posting may have been removed.|This posting may have moved.|Just a moment...|Attention required|Please wait while we verify you|Checking that you are not a robot before you continue...
Please enable JavaScript to continue.|Please turn on JavaScript to continue.|JavaScript is disabled in your browser.|Enable it to continue.|Enable it to view this page.|You need a browser that runs JavaScript.|This application needs JavaScript in order to run.
Your browser is not supported|Your browser is out of date; JavaScript support is required.|Loading... If nothing happens, allow scripts for this site.|If nothing happens, allow JavaScript for this site.|Veuillez activer JavaScript pour afficher cette page.
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.|Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.|Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Porta semper vitae lorem.|Sample text sample text|test test|test|Untitled document|Untitled|New Page|New Page (2)|Default title""",
    NOTE: """TODO: describe role|TODO: describe team|TODO: add description|TBD|Title TBD|TITLE TBD|Description TBD|Title goes here|Text goes here|Your text here|INSERT TEXT HERE|INSERT DUTIES HERE|Insert title here|XXXX text text XXXX|text text text|To be completed by manager|To be filled in|Add three bullets|(copy to follow)|Details to follow|Text to come""",
}
#: Syntaxes of marked spans, by name; those of the first group are trusted, as prose doesn't use them (fixed values).
SURE = {
    "braces2": r"\{\{\s*(?P<braces2>[^{}\s][^{}]{0,200}?)\s*\}\}", "erb": r"<%=?\s*(?P<erb>[^%<>]{1,200}?)\s*%>", "brackets2": r"\[\[(?P<brackets2>[^\[\]]{1,200})\]\]",
    "angles2": r"<<(?P<angles2>[^<>]{1,200})>>", "insert": r"<insert (?P<insert>[^<>]{1,200}) here>", "fill": r"\((?P<fill>[^()]{1,200}) to be filled in\)",
    "merge": r"\*\|(?P<merge>[^|*]{1,200})\|\*", "entity": r"&lt;(?P<entity>[^&<>]{1,200})&gt;", "at": r"@@(?P<at>[^@]{1,200})@@", "under": r"(?<!\w)__(?P<under>[A-Za-z][\w.\- ]{0,200}?)__(?!\w)",
    "hash": r"#\{(?P<hash>[^{}]{1,200})\}", "percent": r"(?<!\w)%(?P<percent>[A-Za-z][\w.\- ]{1,200}?)%(?!\w)", "dollars": r"(?<!\w)\$(?P<dollars>[A-Za-z](?:[\w.\- ]{0,200}?\w)?)\$(?![\w{])", "printf": r"(?<!\S)(?P<printf>%[sd])(?=[\s.,;]|$)",
}
UNSURE = {
    "shell": r"\$\{(?P<shell>[^{}]{1,200})\}", "empty": r"\{\{(?P<empty>\s*)\}\}", "brace": r"\{(?P<brace>[^{}]{1,200})\}", "bracket": r"\[(?P<bracket>[^\[\]]{1,200})\]",
    "angle": r"<(?P<angle>[A-Za-z][^<>]{0,200})>",
}
#: Inner texts of seed spans (fixed values).
SPAN_SEEDS = ("to be completed", "to be confirmed", "to be filled in", "insert text here", "add text", "enter name", "first name", "job title", "company name", "start date", "object object", "tbd", "todo")
_SPAN = re.compile("|".join([*SURE.values(), *UNSURE.values()]))
#: First characters of marked spans; the pattern is tried nowhere else.
_FIRST = re.compile(r"[{\[<(*&@_#%$]")
_INNER = re.compile(r"[a-z]+|[^\W\d_]+")
_MIX, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NUMBER = np.uint64(7)

# classes of UTF-8 bytes: 0 other, 1 letter (and any byte of a longer character), 2 digit
_BYTE = np.zeros(256, np.uint8)
_BYTE[97:123] = _BYTE[128:] = 1
_BYTE[48:58] = 2
_ENDS, _BLANK = np.isin(np.arange(256), list(b".!?;")), np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def _matches(text: str) -> list[re.Match[str]]:
    """The marked spans, from left to right, none within another."""
    out, end = [], 0
    for first in _FIRST.finditer(text):
        if first.start() >= end and (m := _SPAN.match(text, first.start())):
            out.append(m)
            end = m.end()
    return out


def _named(m: re.Match[str]) -> tuple[str, str]:
    return m.lastgroup or "", (m[m.lastgroup] or "") if m.lastgroup else ""


def spans(text: str) -> list[tuple[str, str]]:
    """(syntax, inner text) of each marked span."""
    return [_named(m) for m in _matches(text)]


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    h = h * _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    h >>= np.uint64(64 - bits)
    return h.view(np.int64)


class Units:
    """The passages of a batch of texts: ``feature`` and ``unit`` of each feature, ``record`` and ``letters`` of each unit.

    Passages are cut at line breaks and after sentence marks. All words of the batch are hashed at once: the hash
    of a word is a difference of running sums, shifted to its beginning.
    """

    def __init__(self, texts: list[str]):
        parts = [(t.lower() + "\n").encode("utf-8", "replace") for t in texts]
        self.records = len(texts)
        data = np.frombuffer(b"".join(parts), np.uint8)
        n = len(data)
        kind, blank = _BYTE[data], _BLANK[data]
        cut = data == 10
        cut[:-1] |= _ENDS[data[:-1]] & blank[1:]
        # a cut ends its part, and every text ends with one
        part, ends = np.cumsum(cut, dtype=np.int32), np.flatnonzero(cut)
        change = np.ones(n + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=change[1:n])
        worded = kind > 0
        begin = np.flatnonzero(change[:-1] & worded)
        end = np.flatnonzero(change[1:] & worded) + 1
        word = slice_hashes(data, begin, end)
        # numbers are alike but for the codes of errors
        number = np.flatnonzero(kind[begin] == 2)
        code = (end[number] - begin[number] == 3) & np.isin(data[begin[number]], (52, 53))
        word[number[~code]] = _NUMBER
        letters = np.diff(np.cumsum(~blank, dtype=np.int32)[ends], prepend=0)
        alive = letters > 0
        new = np.cumsum(alive) - 1
        unit = new[part[begin]]
        near = np.flatnonzero(unit[1:] == unit[:-1])
        pairs = word[near] * _PAIR
        pairs += word[near + 1]
        self.feature = _bucket(np.concatenate([word, pairs]), BITS)
        self.unit = np.concatenate([unit, unit[near]])
        texts_end = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        self.record = np.repeat(np.arange(len(parts)), np.diff(part[texts_end - 1], prepend=0))[alive]
        self.letters = letters[alive].astype(np.int64)

    def score(self, weights: np.ndarray) -> np.ndarray:
        """The sum of the weights of each unit's features."""
        return np.bincount(self.unit, weights[self.feature], len(self.record))


def _span_features(kind: str, inner: str) -> list[int]:
    """Buckets of a span: its words, and a trusted syntax (that another one is never trusted says nothing about its spans)."""
    words = list(dict.fromkeys(_INNER.findall(inner.lower()))) or ["(blank)"]
    return [_text_hash(x) for x in words + [f"syntax {kind}"] * (kind in SURE)]


def _text_hash(x: str, cache: dict[str, int] = {}) -> int:  # noqa: B006
    if (h := cache.get(x)) is None:
        if len(cache) > 100_000:
            cache.clear()
        h = cache[x] = int(_bucket(np.array([text_hash(x.encode("utf-8", "replace"))], np.uint64), SPAN_BITS)[0])
    return h


def _weights(positive: np.ndarray, real: np.ndarray, smooth: float, low: float) -> np.ndarray:
    """Logarithms of the ratios of a feature's probabilities in both classes, smoothed towards its frequency in both together."""
    p, r = 1 + positive.sum(), 1 + real.sum()
    back = smooth * (positive + real) / (p + r)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.log((positive + back) / (p + smooth)) - np.log((real + back) / (r + smooth))
    return np.where(positive + real > 0, np.clip(w, low, HIGH), 0.0)


def _odds(prior: float) -> float:
    return math.log(prior / (1 - prior))


def _posterior(odds: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def _mixed(seeds: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Counts of the positive class: trusted ones, and found ones with the same mass, so that the size of a table doesn't matter."""
    return seeds + found * (seeds.sum() / found.sum()) if found.sum() > 0 else seeds


def seed_records(kind: int) -> list[str]:
    return [r for r in SEEDS[kind].replace("\n", "|").split("|") if r]


class Model:
    """Both models and the decision on a field. ``seeds`` are the trusted records of each positive class."""

    def __init__(self, seeds: dict[int, list[str]] | None = None):
        seeds = seeds or {k: seed_records(k) for k in (FILLER, NOTE)}
        own = {k: np.bincount(Units(v).feature, minlength=1 << BITS).astype(float) for k, v in seeds.items()}
        self.trusted = own[FILLER] + own[NOTE]
        self.span_seeds = np.zeros(1 << SPAN_BITS)
        for inner in SPAN_SEEDS:
            np.add.at(self.span_seeds, _span_features("", inner), 1.0)
        np.add.at(self.span_seeds, [_text_hash(f"syntax {kind}") for kind in SURE], 1.0)
        notes, filler = len(seeds[NOTE]), len(seeds[FILLER])
        self.notes = _weights(own[NOTE], own[FILLER], *OF_PASSAGES) * (self.trusted > 0)
        self.note_odds = _odds(notes / max(notes + filler, 2)) if notes else -60.0
        self.prose = self.spans = None

    def fit(self, passes: Callable[[Callable[[Iterator[list[str]]], dict[str, np.ndarray]]], dict[str, np.ndarray]]) -> Model:
        """Fitted by ``passes``, which applies a counting function to all texts and adds up what it gives."""
        total = passes(_totals)
        sure = total["sure"] + self.span_seeds * max(1.0, total["sure"].sum() / self.span_seeds.sum())
        self.prose, self.spans = _weights(self.trusted, total["prose"], *OF_PASSAGES), _weights(sure, total["unsure"], *OF_SPANS)
        for _ in range(ROUNDS):
            found = passes(self.positives)
            self.prose = _weights(_mixed(self.trusted, found["prose"]), np.maximum(total["prose"] - found["prose"], 0), *OF_PASSAGES)
            self.spans = _weights(sure + found["unsure"], np.maximum(total["unsure"] - found["unsure"], 0), *OF_SPANS)
        return self

    @classmethod
    def of(cls, texts: list[str], seeds: dict[int, list[str]] | None = None) -> Model:
        """The model of texts at hand."""
        return cls(seeds).fit(lambda count: count(iter([texts])))

    def span_odds(self, kind: str, inner: str) -> float:
        return _odds(SPAN_PRIOR) + float(self.spans[_span_features(kind, inner)].sum())

    def positives(self, batches: Iterator[list[str]]) -> dict[str, np.ndarray]:
        """Counts of the features of unlabelled units that the model finds positive."""
        prose, unsure = np.zeros(1 << BITS), np.zeros(1 << SPAN_BITS)
        for texts in batches:
            marked, rest = _split(texts)
            for kind, inner in (s for own in marked for s in own):
                if kind not in SURE and (p := _posterior(self.span_odds(kind, inner))) >= SURE_SHARE:
                    np.add.at(unsure, _span_features(kind, inner), p)
            u = Units(rest)
            p = _posterior(_odds(PRIOR) + u.score(self.prose))
            letters, bad = (np.bincount(u.record, w, u.records)[u.record] for w in (u.letters, u.letters * p))
            # the share of the other letters of its field that are positive; a passage by itself stands for itself
            p = p * np.where(letters > u.letters, (bad - u.letters * p) / np.maximum(letters - u.letters, 1), 1.0)
            p[p < SURE_SHARE] = 0
            at = p[u.unit] > 0
            prose += np.bincount(u.feature[at], p[u.unit[at]], 1 << BITS)
        return {"prose": prose, "unsure": unsure}

    def judge(self, texts: list[str]) -> np.ndarray:
        """Whether each field is a case: a placeholder or a note anywhere, or filler and messages for the most part."""
        marked, rest = _split(texts)
        case = np.array([any(self.span_odds(*s) > 0 for s in own) for own in marked], bool)
        rest = [cut if cut.strip() else t for t, cut in zip(texts, rest)]
        u = Units(rest)
        bad = _odds(PRIOR) + u.score(self.prose) > 0
        note = bad & (self.note_odds + u.score(self.notes) > 0)
        case[u.record[note]] = True
        letters, filler = (np.bincount(u.record, w, u.records) for w in (u.letters, u.letters * (bad & ~note)))
        return case | (filler > MOST * letters)

    def is_residue(self, text: str) -> bool:
        return bool(text.strip()) and bool(self.judge([text])[0])


def _split(texts: list[str]) -> tuple[list[list[tuple[str, str]]], list[str]]:
    """The spans of each text, and the texts without them."""
    marked, rest = [], []
    for text in texts:
        found = _matches(text)
        marked.append([_named(m) for m in found])
        if found:
            ends = [0, *[m.end() for m in found]]
            text = " ".join([*[text[e : m.start()] for e, m in zip(ends, found)], text[ends[-1] :]])
        rest.append(text)
    return marked, rest


def _totals(batches: Iterator[list[str]]) -> dict[str, np.ndarray]:
    """Counts of the features of all passages, and of the spans in sure and in other syntaxes."""
    out = {"prose": np.zeros(1 << BITS), "sure": np.zeros(1 << SPAN_BITS), "unsure": np.zeros(1 << SPAN_BITS)}
    for texts in batches:
        marked, rest = _split(texts)
        for kind, inner in (s for own in marked for s in own):
            np.add.at(out["sure" if kind in SURE else "unsure"], _span_features(kind, inner), 1.0)
        out["prose"] += np.bincount(Units(rest).feature, minlength=1 << BITS)
    return out


def _slabs(values: Iterable[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """The values that hold a text, with their places, a bounded number of characters at once."""
    at, texts, chars = [], [], 0
    for i, v in enumerate(values):
        if v and not v.isspace():
            if texts and chars + len(v) > SLAB_CHARS:
                yield at, texts
                at, texts, chars = [], [], 0
            at.append(i)
            texts.append(v)
            chars += len(v)
    if texts:
        yield at, texts


def _added(parts: DataFrame, to: int) -> DataFrame:
    """Arrays of equal names added up in ``to`` tasks; an array is its non-zero places and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for name, at, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = sums.setdefault(name, np.zeros(1 << max(BITS, SPAN_BITS)))
                own[np.frombuffer(at, np.int32)] += np.frombuffer(value, np.float64)
        yield _packed(sums)

    return parts.repartition(to).mapInArrow(run, _PACKED)


_PACKED = "name string, at binary, value binary"


def _packed(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    at = {k: np.flatnonzero(v).astype(np.int32) for k, v in sums.items()}
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([at[k].tobytes() for k in sums], pa.binary()), pa.array([v[at[k]].tobytes() for k, v in sums.items()], pa.binary())], names=["name", "at", "value"])


def fit(df: DataFrame, fields: tuple[str, ...], seeds: dict[int, list[str]] | None = None) -> Model:
    """The model of all values of the fields, whatever their number: ROUNDS + 1 passes over the table.

    A task's counts are at most 2**BITS numbers; they are added up by as many tasks as the root of the number of
    tasks, and those sums in one, so no task and not the driver receives more than a bounded number of arrays each.
    """
    rows = df.select(*[df[f] for f in fields])

    def passes(count: Callable[[Iterator[list[str]]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        shared = df.sparkSession.sparkContext.broadcast(count)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield _packed(shared.value(texts for b in batches for c in b.columns for _, texts in _slabs(c.to_pylist())))

        parts = rows.mapInArrow(run, _PACKED)
        tasks = math.isqrt(max(1, rows.rdd.getNumPartitions()))
        out = {}
        for r in _added(_added(parts, tasks) if tasks > 1 else parts, 1).collect():
            out[r["name"]] = np.zeros(1 << (BITS if r["name"] == "prose" else SPAN_BITS))
            out[r["name"]][np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["value"], np.float64)
        return {k: out.get(k, np.zeros(1 << (BITS if k == "prose" else SPAN_BITS))) for k in ("prose", "sure", "unsure")}

    return Model(seeds).fit(passes)


def residue(df: DataFrame, fields: tuple[str, ...] = ("title", "description"), row_id: str = "row_id", model: Model | None = None) -> DataFrame:
    """``row_id, field`` of each field that holds an unfilled placeholder or is filler, an error or a script notice.

    Null, empty and blank fields are no cases; rows with a null id are left out; repeated rows count once
    each; an empty table gives no rows; further columns are not read. Long texts are read whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(model or fit(df, fields))
    kind = df.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, names = [], []
            for k, name in enumerate(fields, 1):
                for at, texts in _slabs(batch.column(k).to_pylist()):
                    own = np.array(at)[shared.value.judge(texts)].tolist()
                    found += own
                    names += [name] * len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found, pa.int64())), pa.array(names, pa.string())], names=["row_id", "field"])

    rows = df.select(df[row_id].alias("row_id"), *[df[f] for f in fields]).where("row_id is not null")
    return rows.mapInArrow(run, f"row_id {kind}, field string").withColumnRenamed("row_id", row_id)


def without_residue(df: DataFrame, fields: tuple[str, ...] = ("title", "description"), row_id: str = "row_id", model: Model | None = None) -> DataFrame:
    """``df`` without the rows that have a case in any field; rows with a null id stay."""
    return df.join(residue(df, fields, row_id, model).select(row_id).distinct(), row_id, "left_anti")
