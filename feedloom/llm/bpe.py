"""Encoding with a byte-level BPE vocabulary, pre-tokenised with arrays instead of regular expressions.

A batch's texts are one array of codepoints, each mapped to its class (letter, number, space, other). A
codepoint acts on the pre-tokeniser's state as a transition function; composing those functions is
associative, and a composition over three codepoints no longer depends on the state before them, so the
scan settles after two doubling steps: whether a token starts at a codepoint follows from the classes of
its two predecessors, its successor and the contraction that may begin there. The slices so found are looked up in a cache of merged slices; only new
slices go through pair merging. Offsets are kept, so that ids can be mapped back to the text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from feedloom.llm.codepoints import LETTER, SPACE, classes, codes

#: Where the public vocabularies lie unless a path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Slices that a worker remembers before it starts anew: the bound of its cache.
CACHE_SLICES = 400_000
_QUOTE, _BLANK = ord("'"), ord(" ")


def token_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flags of the codepoints at which a pre-token starts; ``first`` flags those that begin a text."""
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[cp]
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[0], before[1:] = 255, kind[:-1]
    after[-1], after[:-1] = 255, kind[1:]
    before[first] = 255
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, first[1:]
    after[last] = 255
    run = kind != before
    space = kind == SPACE
    joined = np.zeros(n, bool)  # a plain blank goes with the run that follows it
    joined[1:] = (cp[:-1] == _BLANK) & ~first[1:]
    starts = np.where(space, run | ((after != SPACE) & (after != 255)), run & ~joined)
    quotes = np.flatnonzero((cp == _QUOTE) & starts & (after == LETTER))
    if len(quotes):
        pad = np.concatenate([cp, np.zeros(3, np.uint32)])
        a, b = pad[quotes + 1], pad[quotes + 2]
        b = np.where(np.concatenate([first, np.ones(3, bool)])[quotes + 2], 0, b)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for at, size in ((quotes[one], 2), (quotes[two], 3)):
            starts[at + 1] = False
            ends = at + size
            ends = ends[ends < n]
            starts[ends] |= True
    return starts


class Encoder:
    """Merges of one rank file, with a bounded cache of merged slices."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces: dict[int, bytes] = {v: k for k, v in self.ranks.items()}
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one slice: the adjacent pair of lowest rank is merged until none is known."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        n = len(piece)
        ends = list(range(1, n + 1))  # part i is piece[i:ends[i]]; -1 marks a part that was merged away
        left = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (r := ranks.get(piece[i : i + 2])) is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            if ends[i] < 0 or ends[i] >= e or ends[ends[i]] != e:
                continue
            j, ends[i] = ends[i], e
            ends[j] = -1
            if e < n:
                left[e] = i
                if (r := ranks.get(piece[i : ends[e]])) is not None:
                    heapq.heappush(heap, (r, i, ends[e]))
            if (h := left[i]) >= 0 and (r := ranks.get(piece[h:e])) is not None:
                heapq.heappush(heap, (r, h, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return tuple(out)

    def encode_batch(self, blob: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts, where each text's ids begin (n + 1 values), and each id's byte offset in ``blob``.

        Text i is ``blob[offsets[i]:offsets[i + 1]]`` in UTF-8.
        """
        raw = np.frombuffer(blob, np.uint8)
        cp = codes(blob.decode("utf-8"))
        char_at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=char_at[1:])
        first = np.zeros(len(cp) + 1, bool)
        first[char_at[offsets]] = True
        starts = np.flatnonzero(token_starts(cp, first[:-1]))
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        at = (np.cumsum(width) - width)[starts]
        ends = np.append(at[1:], len(raw))
        if len(self.cache) > CACHE_SLICES:
            self.cache = {}
        cache, merge, parts = self.cache, self.merge, []
        add = parts.append
        for s, e in zip(at.tolist(), ends.tolist()):
            piece = blob[s:e]
            ids = cache.get(piece)
            if ids is None:
                ids = cache[piece] = merge(piece)
            add(ids)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        total = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        ids = np.fromiter(chain.from_iterable(parts), np.int32, int(total[-1]))
        begins = total[np.searchsorted(at, offsets, "left")] if len(at) else np.zeros(len(offsets), np.int64)
        sizes = self.sizes[ids] if len(ids) else np.zeros(0, np.int64)
        where = np.cumsum(sizes) - sizes
        return ids, begins, where

    @property
    def sizes(self) -> np.ndarray:
        if not hasattr(self, "_sizes"):
            self._sizes = np.zeros(max(self.pieces) + 1, np.int64)
            for k, v in self.pieces.items():
                self._sizes[k] = len(v)
        return self._sizes

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that are no UTF-8 (a cut in a character) become U+FFFD."""
        return b"".join(self.pieces[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _flat(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """A string column's bytes and offsets; null is the empty text."""
    texts = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    blob = b"" if data is None else data.to_pybytes()[offsets[0] : offsets[-1]]
    return blob, offsets - offsets[0]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, with_offsets: bool = False) -> DataFrame:
    """``key, ids array<int>`` of each row, in one pass without a shuffle; ``with_offsets`` adds byte offsets.

    A null or empty text has the empty list. Special tokens' strings are ordinary text. Repeated rows stay,
    rows with a null key too; an empty table gives no rows; further columns are not read. ``vocabulary`` is
    a rank file which every executor can read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            ids, begins, where = enc.encode_batch(*_flat(batch.column(1)))
            lists = [pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids))]
            if with_offsets:
                base = np.repeat(where[np.minimum(begins[:-1], max(len(where) - 1, 0))] if len(where) else begins[:-1], np.diff(begins))
                lists.append(pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array((where - base).astype(np.int32))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["key", "ids", "offsets"][: 1 + len(lists)])

    out = df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>" + ", offsets array<int>" * with_offsets)
    return out.withColumnRenamed("key", key)
