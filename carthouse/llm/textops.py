"""Vectorised text helpers used inside tasks: word spans and 64-bit hashes over whole batches of texts.

Everything works on numpy arrays of bytes or code points, in blocks, so that
a very long text costs memory in proportion to its own length only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BLOCK = 1 << 18
_POWERS: dict[str, np.ndarray] = {}

#: Texts of one numpy pass hold about this many characters together.
PASS_CHARS = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(_BLOCK + 1, base, dtype=_U)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span ``values[start:end]``; spans are sorted and disjoint.

    A polynomial hash from one running sum per block: the difference of the
    sums at a span's ends, scaled back to the span's start.
    """
    up, down = _powers()
    out = np.empty(len(starts), dtype=_U)
    i, n = 0, len(starts)
    while i < n:
        j = int(np.searchsorted(ends, starts[i] + _BLOCK, side="right"))
        if j <= i:  # one span longer than a block
            h, scale = 0, 1
            for a in range(int(starts[i]), int(ends[i]), _BLOCK):
                v = values[a:min(a + _BLOCK, int(ends[i]))].astype(_U) + _U(1)
                h = (h + int((v * up[:len(v)]).sum(dtype=_U)) * scale) & _MASK
                scale = scale * int(up[len(v)]) & _MASK
            out[i] = h
            i += 1
            continue
        s0 = int(starts[i])
        v = values[s0:int(ends[j - 1])].astype(_U)
        v += _U(1)
        v *= up[:len(v)]
        sums = np.zeros(len(v) + 1, dtype=_U)
        np.cumsum(v, out=sums[1:])
        a = starts[i:j] - s0
        out[i:j] = (sums[ends[i:j] - s0] - sums[a]) * down[a]
        i = j
    return mix(out)


def passes(texts: list[str], limit: int = PASS_CHARS) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` holding about ``limit`` characters each."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(inside) and inside[-1]:
        edge = np.concatenate((edge, [len(inside)]))
    return edge[0::2], edge[1::2]


def space_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of characters outside ``[\\x20\\x09-\\x0D]``,
    A-Z lower-cased) of all texts in order, and each text's first word index
    (one more entry closes the last)."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    buf = b"\n".join(raw).lower()  # bytes.lower changes A-Z only
    data = np.frombuffer(buf, dtype=np.uint8)
    starts, ends = spans(~_SPACE[data])
    lengths = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
    edges = np.concatenate(([0], np.cumsum(lengths)))
    return hash_spans(data, starts, ends), np.searchsorted(starts, edges)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, each followed by a line feed,
    and the texts' first positions (one more entry closes the last)."""
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return data, np.concatenate(([0], np.cumsum(lengths)))
