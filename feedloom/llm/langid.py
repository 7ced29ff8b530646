"""Language of documents and of their segments by prediction by partial matching (PPM).

For each language, the labelled samples give byte contexts of every order up to ``ORDER`` with the counts
of the bytes that followed. A byte's code length is that of PPM's method C with frozen statistics: in the
longest context known to the language the byte has probability count / (total + distinct), or the coder
escapes with distinct / (total + distinct) to the next shorter context, and at last to a uniform byte. The
language of a text is the one in which its code is shortest, its confidence the posterior probability of
that language among all. The bytes of a text depend on each other, so a bit of difference between two code
lengths is worth less than a bit; how much is found on held-out labelled texts.

Strings of up to seven bytes are exact 64-bit keys. The contexts of all languages share one hash table from
key to row, so a batch's bytes are looked up once for every order and the code lengths of all languages
follow by array operations.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Longest context in bytes. Keys hold ORDER + 1 bytes, at most 7.
ORDER = 5
#: Labelled samples read for training, at most: the documented bound of the fit.
MAX_SAMPLES = 20_000
#: Labelled documents read for training besides, at most, and their length in characters, at most.
MAX_DOCUMENTS, MAX_LENGTH = 2_000, 5_000
#: Bits that changing the language between two sentences costs.
SWITCH_BITS = 14.0
#: Sentences of a language which make it one of a mixed document's.
MIXED_SENTENCES = 2
#: Bits a byte under the best language above which a sentence isn't text of any known language.
FOREIGN_BITS = 4.6
#: Letters that a sentence must have besides addresses to count; a script without blanks needs fewer.
LEAST_LETTERS = 8
#: Bytes scored at once, which bounds the memory of the arrays.
SLAB_BYTES = 400_000
#: Names of languages as labels write them (fixed values): ISO 639-1, 639-2 and 639-3 codes, English and own names.
NAMES = {
    "en": "en eng english anglais", "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol castellano",
    "pt": "pt por portuguese português portugues", "de": "de deu ger german deutsch", "nl": "nl nld dut dutch nederlands",
    "uk": "uk ukr ukrainian українська", "ja": "ja jpn japanese 日本語",
}
_LABELS = {name: code for code, names in NAMES.items() for name in names.split()}
#: Shortenings after which a full stop ends no sentence (fixed values).
_SHORT = "ltd inc corp co llp ltée ltee st dr mr mrs sr jr no vs etc"
_END = re.compile(r"\n+|(?<=[。！？])|(?<=[.!?])\s+")
_SHORT_END = re.compile(r"(?:^|\W)(?:" + "|".join(_SHORT.split()) + r")\.$|(?:^|\W)\w\.$", re.I)
_DIGITS = re.compile(r"\d+")
_ADDRESS = re.compile(r"https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.\S+")


def label_code(label: str | None) -> str | None:
    """The code of the language that ``label`` names in any spelling, region or script left out; else None."""
    if not label:
        return None
    return _LABELS.get(re.split(r"[-_.@]", label.strip().lower())[0])


def sentences(text: str) -> list[tuple[int, int]]:
    """Begin and end of each sentence: cut at line breaks and after full stops that end no shortening."""
    out, begin = [], 0
    for m in _END.finditer(text):
        start, end = m.span()
        # only a full stop within a line can end a shortening; words of more than six letters are none
        if start and text[start - 1] == "." and end > start and text[start] != "\n" and not (start - begin > 7 and text[start - 7 : start - 1].isalnum()):
            if _SHORT_END.search(text[max(begin, start - 8) : start]):
                continue
        if end > begin:
            out.append((begin, end))
            begin = end
    if begin < len(text):
        out.append((begin, len(text)))
    return [(s, e) for s, e in out if not text[s:e].isspace()]


def _plain(text: str) -> str:
    """``text`` without the marks on Latin letters, as careless writers type it."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not (0x300 <= ord(c) <= 0x36F)) if not text.isascii() else text


def normal(parts: Sequence[str]) -> tuple[bytes, np.ndarray]:
    """All parts as one string of bytes, and the length of each: lower case, no addresses, numbers as one digit, white
    space as blanks, in UTF-8 between two blanks. The parts are treated in one go."""
    plain = [_ADDRESS.sub(" ", p) if "@" in p or "://" in p or "www." in p else p for p in parts]
    whole = " \0 ".join(["", *(p.replace("\0", " ") if "\0" in p else p for p in plain), ""]).lower()
    data = np.frombuffer((" ".join(_DIGITS.sub("0", whole).split())).encode("utf-8", "replace"), np.uint8)
    # "\0 a b \0 c \0": a part runs from the blank after a mark to the blank before the next
    marks = np.flatnonzero(data == 0)
    lengths = np.diff(marks) - 1
    short = lengths < 2  # an empty part, whose two blanks are one
    if short.any():
        data = np.insert(data, marks[1:][short], 32)
        lengths = np.maximum(lengths, 2)
    return data[data > 0].tobytes(), lengths


class PPM:
    """Frozen context statistics of several languages, resolved into two tables.

    Let s be the longest known string that ends at a byte and c the longest known context before it. The
    byte's code length is ``own[s] + chain[c]``: ``chain`` sums the escapes of a context and all its
    suffixes, and ``own`` is what s costs by itself less the chain of its own context.
    """

    def __init__(self, samples: Sequence[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in samples})
        counted = []
        for lang in self.languages:
            joined, lengths = normal([v for x, text in samples if x == lang for v in sorted({text, _plain(text)})])
            data = np.frombuffer(joined, np.uint8)
            since = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            counted.append([np.unique(k[since >= size - 1], return_counts=True) for size, k in self._keys(data)])
        n = len(self.languages)
        sizes = [np.unique(np.concatenate([c[k][0] for c in counted])) for k in range(ORDER + 1)]
        offset = np.concatenate([[0], np.cumsum([len(x) for x in sizes])])
        total_rows = int(offset[-1])
        strings = np.concatenate(sizes)
        spare = total_rows  # the row of no string
        seen = np.zeros((total_rows + 1, n))
        for which, own in enumerate(counted):
            for k, (keys, count) in enumerate(own):
                seen[offset[k] + np.searchsorted(sizes[k], keys), which] = count
        context, suffix = np.full(total_rows + 1, spare), np.full(total_rows + 1, spare)
        for k in range(1, ORDER + 1):
            text = sizes[k] & np.uint64((1 << 56) - 1)
            shorter = np.uint64(k << 56)
            rows = slice(offset[k], offset[k + 1])
            context[rows] = offset[k - 1] + np.searchsorted(sizes[k - 1], text >> np.uint64(8) | shorter)
            suffix[rows] = offset[k - 1] + np.searchsorted(sizes[k - 1], text & np.uint64((1 << 8 * k) - 1) | shorter)
        total, distinct = np.zeros_like(seen), np.zeros_like(seen)  # the spare row is the empty context
        np.add.at(total, context[:spare], seen[:spare])
        np.add.at(distinct, context[:spare], (seen[:spare] > 0).astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0)
            bits = np.where(seen > 0, -np.log2(seen / (total + distinct)[context]), np.nan)
        chain, cost = np.zeros_like(seen), np.zeros_like(seen)
        cost[spare] = escape[spare] + 8
        for k in range(ORDER + 1):
            rows = slice(offset[k], offset[k + 1])
            chain[rows] = escape[rows] + chain[suffix[rows]] * (k > 0)
            cost[rows] = np.where(np.isnan(bits[rows]), (escape[context[rows]] if k else escape[spare]) + (cost[suffix[rows]] if k else 8), bits[rows])
        chain[spare] = 0
        self.own = (cost - np.where((context < spare)[:, None], chain[context], 0)).astype(np.float32)
        self.chain = chain.astype(np.float32)
        self.shorter = np.where(np.arange(total_rows + 1) >= offset[ORDER], suffix, np.arange(total_rows + 1)).astype(np.int32)
        self._table(strings)
        #: What a bit of difference between two languages is worth; less than one, as neighbouring bytes depend on each other.
        self.worth = 1.0

    @staticmethod
    def _keys(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each size the key of the string of that size that ends at each byte: its bytes and its size."""
        key = np.zeros(len(data), np.uint64)
        for size in range(1, ORDER + 2):
            if size == 1:
                key = data.astype(np.uint64)
            else:
                moved = np.zeros(len(data), np.uint64)
                moved[size - 1 :] = data[: max(0, len(data) - size + 1)]
                key = key | moved << np.uint64(8 * (size - 1))
            yield size, key | np.uint64(size << 56)

    def _table(self, strings: np.ndarray) -> None:
        """Open addressing from key to row, filled in rounds: in each, one key takes each free slot it meets."""
        self.log = max(12, int(len(strings) * 4).bit_length())
        self.keys = np.zeros(1 << self.log, np.uint64)
        self.rows = np.full(1 << self.log, len(strings), np.int32)
        slot, left, self.probes = self._slot(strings), np.arange(len(strings)), 0
        while len(left):
            at = (slot[left] + self.probes) & ((1 << self.log) - 1)
            free = np.flatnonzero(self.keys[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            taken = free[one]
            self.keys[at[taken]], self.rows[at[taken]] = strings[left[taken]], left[taken]
            left = np.delete(left, taken)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.log)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it's unknown."""
        slot, mask = self._slot(keys), (1 << self.log) - 1
        out = np.where(self.keys[slot] == keys, self.rows[slot], -1)
        open_ = np.flatnonzero(out < 0)
        for probe in range(1, self.probes):
            if not len(open_):
                break
            at = (slot[open_] + probe) & mask
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.rows[at[hit]]
            open_ = open_[~hit]
        return out

    def code_lengths(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Bits of each part of the bytes ``data`` in each language; part i begins at ``begin[i]``, contexts don't cross."""
        n = len(data)
        if not n:
            return np.zeros((0, len(self.languages)))
        since = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        row = np.full(n, -1, np.int64)
        for size, key in reversed(list(self._keys(data))):
            todo = np.flatnonzero((row < 0) & (since >= size - 1))
            row[todo] = self._find(key[todo])
        row[row < 0] = len(self.own) - 1
        before = np.full(n, len(self.own) - 1, np.int64)
        before[1:] = self.shorter[row[:-1]]
        before[since == 0] = len(self.own) - 1
        return np.add.reduceat(self.own[row] + self.chain[before], begin, axis=0)


def _smooth(cost: np.ndarray) -> np.ndarray:
    """The cheapest sequence of languages when each change costs SWITCH_BITS (Viterbi)."""
    total, back = cost[0].copy(), []
    for row in cost[1:]:
        best = int(total.argmin())
        stay = total <= total[best] + SWITCH_BITS
        back.append(np.where(stay, np.arange(len(total)), best))
        total = np.minimum(total, total[best] + SWITCH_BITS) + row
    path = [int(total.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def _confidence(cost: np.ndarray, which: int, worth: float) -> float:
    return float(1 / np.exp2(np.clip((cost[which] - cost) * worth, -60, 60)).sum())


#: Bytes of letters: Latin ones, and first bytes of longer characters but those of punctuation and symbols.
_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = _LETTERS[0xC3:0xE2] = _LETTERS[0xE3:] = True


def segments(texts: list[str], model: PPM) -> Iterator[list[tuple[int, int, str, float, int]]]:
    """For each text its segments: begin, end, language, confidence and number of sentences.

    A segment is a longest run of sentences of one language. Sentences whose bytes no language predicts
    (names, codes, symbols) belong to no segment.
    """
    at = 0
    while at < len(texts):
        low, size = at, 0
        spans = []
        while at < len(texts) and (at == low or size < SLAB_BYTES):
            spans.append(sentences(texts[at]))
            size += len(texts[at])
            at += 1
        joined, lengths = normal([t[s:e] for t, own in zip(texts[low:at], spans) for s, e in own])
        data, begin = np.frombuffer(joined, np.uint8), np.cumsum(lengths) - lengths
        if not len(lengths):
            yield from ([] for _ in spans)
            continue
        cost = model.code_lengths(data, begin)
        wide = np.fromiter((e - s for own in spans for s, e in own), np.int64, len(lengths))
        letters = np.add.reduceat(_LETTERS[data].astype(np.int32), begin)
        known = (cost.min(1) <= FOREIGN_BITS * lengths) & ((lengths > 2 * wide) | (letters >= LEAST_LETTERS))
        best = cost.argmin(1)
        k = 0
        for own in spans:
            mine = (k + np.flatnonzero(known[k : k + len(own)])).tolist()
            out: list[tuple[int, int, str, float, int]] = []
            if mine:
                first = best[mine[0]]
                # where every sentence is cheapest in one language, so is the whole
                path = [int(first)] * len(mine) if (best[mine] == first).all() else _smooth(cost[mine]).tolist()
                i = 0
                while i < len(mine):
                    j = i
                    while j < len(mine) and path[j] == path[i]:
                        j += 1
                    together = cost[mine[i:j]].sum(0)
                    out.append((own[mine[i] - k][0], own[mine[j - 1] - k][1], model.languages[path[i]], _confidence(together, path[i], model.worth), j - i))
                    i = j
            k += len(own)
            yield out


#: Share of the labelled texts that is held out to find what a bit is worth, and the worths that are tried.
HELD_OUT, WORTHS = 5, np.geomspace(0.01, 1.0, 41)


def _worth(labelled: Sequence[tuple[str, str]]) -> float:
    """The worth of a bit under which held-out sentences' confidences fit their labels best (least log loss).

    Every HELD_OUT-th text of each language is held out from a model of the rest; 1 if there are too few.
    """
    place: Counter = Counter()
    kept, out = [], []
    for lang, text in labelled:
        (out if place[lang] % HELD_OUT == HELD_OUT - 1 else kept).append((lang, text))
        place[lang] += 1
    parts = [(lang, text[s:e]) for lang, text in out for s, e in sentences(text)]
    if not parts or len({x for x, _ in kept}) < 2:
        return 1.0
    model = PPM(kept)
    joined, lengths = normal([t for _, t in parts])
    cost = model.code_lengths(np.frombuffer(joined, np.uint8), np.cumsum(lengths) - lengths)
    true = np.array([model.languages.index(x) for x, _ in parts])
    gap = np.clip(cost - cost[np.arange(len(true)), true][:, None], -900, 900)
    loss = [np.log2(np.exp2(np.clip(-gap * w, -60, 60)).sum(1)).mean() for w in WORTHS]
    return float(WORTHS[int(np.argmin(loss))])


def _samples(samples: DataFrame, lang: str, text: str) -> list[tuple[str, str]]:
    """The labelled samples: all, or of more than MAX_SAMPLES an equal number of each language, those of the lowest text hash.

    What languages with few samples leave over goes to the others; every language keeps one at least.
    """
    rows = samples.select(samples[lang].alias("lang"), samples[text].alias("text")).where("lang is not null and text is not null")
    counts = sorted(r["count"] for r in rows.groupBy("lang").count().collect())
    if sum(counts) > MAX_SAMPLES:
        left = MAX_SAMPLES
        for i, n in enumerate(counts):
            if (most := left // (len(counts) - i)) <= n:
                break
            left -= n
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
        rows = rows.withColumn("place", place).where(F.col("place") <= max(most, 1))
    return [(r["lang"], r["text"]) for r in rows.orderBy("lang", "text").collect()]


def _train(samples: DataFrame, docs: DataFrame, lang: str, text: str, more: int = MAX_DOCUMENTS) -> PPM:
    """The model of the clean samples, fitted again with labelled documents that it finds rightly labelled.

    At most MAX_SAMPLES samples, shared out among the languages, and about ``more`` documents, those of the lowest text hash, come to the driver.
    Of the documents count those in one language, by the first model and the label alike.
    """
    clean = _samples(samples, lang, text)
    if not clean:
        raise ValueError("no labelled samples")
    model = PPM(clean)
    if more <= 0 or lang not in docs.columns:
        model.worth = _worth(clean)
        return model
    wanted = F.regexp_extract(F.lower(F.trim(docs[lang])), r"^[^-_.@]*", 0).isin(sorted(_LABELS)) & (F.length(docs[text]) <= MAX_LENGTH)
    taken = docs.select(docs[lang].alias("lang"), docs[text].alias("text")).where(wanted)
    if (n := docs.count()) > more:
        taken = taken.where(F.xxhash64("text") < F.lit(int(-(2**63) + (2**64) * (more / n)))).limit(4 * more)  # repeated texts share a hash
    taken = sorted(taken.collect(), key=lambda r: (r["lang"], r["text"]))
    for r, found in zip(taken, segments([r["text"] for r in taken], model)):
        chars = Counter()
        for begin, end, language, _, _ in found:
            chars[language] += end - begin
        if chars and (own := label_code(r["lang"])) and chars[own] >= 0.8 * sum(chars.values()):
            clean.append((own, r["text"]))
    model = PPM(clean)
    model.worth = _worth(clean)
    return model


def language_segments(docs: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key, segment, begin_at, end_at, language, confidence, sentences`` of every segment of every document.

    Positions count codepoints. Null, empty, blank and symbol-only texts have no segment; an empty table
    gives no rows; repeated rows are scored each; long texts are scored whole. One pass, no shuffle. The
    model is fitted on at most ``MAX_SAMPLES`` samples and ``MAX_DOCUMENTS`` labelled documents.
    """
    model = docs.sparkSession.sparkContext.broadcast(_train(samples, docs, lang, text))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, segment int, begin_at int, end_at int, language string, confidence double, sentences int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(i, n, *s) for i, found in enumerate(segments(batch.column(1).to_pylist(), model.value)) for n, s in enumerate(found)]
            cols = list(zip(*own)) if own else [[] for _ in range(7)]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, t) for c, t in zip(cols[1:], kinds)]],
                names=["key", "segment", "begin_at", "end_at", "language", "confidence", "sentences"],
            )

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text")).where("text is not null")
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def _decide(found: list[tuple[int, int, str, float, int]]) -> list[str]:
    """The languages of a text: those with at least MIXED_SENTENCES sentences if these are several, else the longest."""
    count, chars = Counter(), Counter()
    for begin, end, language, _, n in found:
        count[language] += n
        chars[language] += end - begin
    if not chars:
        return []
    many = sorted(x for x, n in count.items() if n >= MIXED_SENTENCES)
    return many if len(many) > 1 else [max(chars, key=lambda x: (chars[x], x))]


def wrong_labels(docs: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key, language`` of each document of one language whose label is missing or wrong, and of each
    language of each mixed document.

    A label is right if it names the language in any spelling. Documents without words of a known language
    (null, empty, symbols, names only) have no row; neither have rows with a null key; equal rows count
    once. One pass over the texts; only the found rows are shuffled.
    """
    model = docs.sparkSession.sparkContext.broadcast(_train(samples, docs, lang, text))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            at, languages = [], []
            for i, found in enumerate(segments(texts, model.value)):
                own = _decide(found)
                if len(own) > 1 or own and own[0] != label_code(labels[i]):
                    at += [i] * len(own)
                    languages += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(languages, pa.string())], names=["key", "language"])

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), docs[lang].alias("lang")).where("key is not null and text is not null")
    return rows.mapInArrow(run, f"key {kind}, language string").distinct().withColumnRenamed("key", key)
