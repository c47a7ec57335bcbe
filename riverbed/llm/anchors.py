"""Content-defined anchors: in every window of `size` bytes one position, chosen by the window's bytes alone."""

from __future__ import annotations

import numpy as np

from riverbed.llm.shingles import mixed, powers, prefix

#: Bytes of the string whose hash is compared to choose an anchor.
GRAM = 32
#: Windows whose anchors are chosen at once: positions among them fit beside a hash.
PIECE = 1 << 23


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """least of x[i:i+w] for each i, in three passes whatever w is."""
    n = len(x)
    m = -(-n // w) * w
    pad = np.full(m, np.iinfo(x.dtype).max, x.dtype)
    pad[:n] = x
    rows = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, bounds: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Anchors of texts laid end to end. bounds: where each begins, and the end.

    A row stands for the windows [lo, hi] of one text (their first bytes, from the text's start) that choose the position at. gram: hash of the GRAM bytes there; span: hash of
    all bytes that these windows cover, and of where the anchor lies in them. Windows with equal bytes choose equal anchors, since ties go to the first.
    """
    none = np.zeros(0, np.int64)
    lengths = np.diff(bounds)
    if len(data) < size or lengths.max(initial=0) < size:
        return {k: none for k in ("text", "lo", "hi", "at", "gram", "span")}
    sums = prefix(data)
    _, down = powers(len(data))
    n = len(data) - GRAM + 1
    gram = mixed((sums[GRAM:] - sums[:-GRAM]) * down[:n])
    # 40 bits of the hash, then the position: the least is the first of the least hashes
    w = size - GRAM + 1
    chosen = np.empty(n - w + 1, np.int64)
    for a in range(0, len(chosen), PIECE):
        part = gram[a : a + PIECE + w - 1]
        packed = (part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        least = _sliding_least(packed, w) & np.uint64((1 << 24) - 1)
        chosen[a : a + len(least)] = least.astype(np.int64) + a
    text = np.repeat(np.arange(len(lengths)), np.maximum(lengths - size + 1, 0))
    first = np.concatenate([np.arange(a, b - size + 1) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if b - a >= size])
    at = chosen[first]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]))))
    last = np.concatenate((new[1:], [len(at)])) - 1
    lo, hi, at, text = first[new], first[last], at[new], text[new]
    span = mixed(
        (
            sums[hi + size] - sums[lo]
        ) * down[lo] + (at - lo).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + (hi - lo).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
    )
    base = bounds[text]
    return {"text": text, "lo": lo - base, "hi": hi - base, "at": at - base, "gram": gram[at].view(np.int64), "span": span.view(np.int64)}
