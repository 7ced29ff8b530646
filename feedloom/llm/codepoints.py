"""Codepoint classes as arrays, shared by the text operators."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Unicode's White_Space property (fixed values).
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """uint8 class of each of the 0x110000 codepoints; built once in a worker (about 0.1 s)."""
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    table[list(WHITE_SPACE)] = SPACE
    return table


def codes(text: str) -> np.ndarray:
    """The codepoints of ``text`` as uint32."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_STEP = 0x200000366 | 1


def _powers(n: int, cache: dict[str, np.ndarray] = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """The powers of an odd base and of its inverse modulo 2**64."""
    if len(cache.get("up", ())) < n:
        size = 1 << max(16, n.bit_length())
        for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            k = 1
            while k < size:
                out[k : 2 * k] = out[:k] * np.uint64(pow(base, k, 1 << 64))
                k *= 2
            cache[name] = out
    return cache["up"], cache["down"]


def slice_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of ``data``, alike for alike slices: a difference of running sums, shifted to the slice's beginning."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return (sums[end] - sums[begin]) * down[begin]


def text_hash(data: bytes) -> int:
    """The hash that ``slice_hashes`` gives for a slice of these bytes."""
    return int(slice_hashes(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0])
