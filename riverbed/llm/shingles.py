"""Word shingles and MinHash signatures, vectorised over blocks of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at once; arrays of eight bytes per byte of text are alive meanwhile.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash's base and of its inverse modulo 2^64, n of each at least."""
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, 2 * BLOCK), base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Running sums by which the hash of data[a:b] is (prefix[b] - prefix[a]) * base^-a."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin (one entry more than texts)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    # arrays of eight bytes per byte are alive for BLOCK bytes, or one word, at a time, however long a text is; a word's hash does not depend on where it stands
    h, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(stop, start[i] + BLOCK, side="right")))
        first, last = start[i:j] - start[i], stop[i:j] - start[i]
        sums = prefix(data[start[i] : stop[j - 1]])
        _, down = powers(len(sums))
        h[i:j] = mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(start, begin)


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles: runs of `size` words, or the whole of a shorter text; empty without words."""
    h, at = word_hashes(texts)
    n = len(h) - size + 1
    if n > 0:
        s = h[:n].copy()
        for k in range(1, size):
            s = mixed(s * np.uint64(0x2545F4914F6CDD1D) + h[k : k + n])
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            yield np.unique(s[a : b - size + 1])
        elif b > a:
            x = h[a : a + 1]
            for k in range(a + 1, b):
                x = mixed(x * np.uint64(0x2545F4914F6CDD1D) + h[k : k + 1])
            yield mixed(x + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def blocks(texts: list[str | None]) -> Iterator[list[bytes]]:
    """texts as lower-cased UTF-8 (A-Z alone change), null as empty, in lists of about BLOCK bytes."""
    out, n = [], 0
    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass").lower()
        if out and n + len(b) > BLOCK:
            yield out
            out, n = [], 0
        out.append(b)
        n += len(b) + 1
    if out:
        yield out


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """A row of n minwise hashes (32 bits) for each set; zeros for an empty one."""
    a, b = coefficients(n)
    full = [s for s in sets if len(s)]
    out = np.zeros((len(sets), n), np.uint32)
    if full:
        flat, begin = np.concatenate(full), np.cumsum([0] + [len(s) for s in full])[:-1]
        where = np.flatnonzero([len(s) > 0 for s in sets])
        for j in range(n):
            out[where, j] = np.minimum.reduceat(((flat * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32), begin)
    return out
