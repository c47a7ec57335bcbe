"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each task reads its part of the corpus in chunks of about CHUNK characters. The distinct pieces of a chunk that are not known yet become one array of symbols,
linked to their neighbours. An inverted index maps every token pair, by the rank of what it merges to, to the positions where it occurs. Ranks are taken from a heap in
rising order; one step applies the merge in all words at once, at the leftmost valid position of each, and updates only the touched neighbours: their new pairs go into the
index, also when their rank is lower than the present one. Words that hold a pair more often return under the same rank. Since words are independent and each always merges its lowest
pair, leftmost first, the result is that of the usual encoder. Encoded pieces are kept for the next chunks up to KNOWN entries, so memory is bounded.
Nothing is shuffled: a lost executor costs the chunks of its tasks.

Edge cases: a null or empty text has no tokens. Repeated rows are encoded each. An empty table gives an empty result. Other columns are ignored. A very long piece is one word of the array.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from riverbed.llm.common import table

#: Characters whose pieces are replayed together.
CHUNK = 4_000_000
#: Pieces whose ids a worker keeps between chunks.
KNOWN = 250_000


class Vocabulary:
    """Ranks of byte strings, and the rank of what any two tokens merge to."""

    def __init__(self, path: str):
        self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.bytes: list[bytes] = [b""] * (max(self.ids.values()) + 1)
        for t, i in self.ids.items():
            self.bytes[i] = t
        self.one = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs = [
            (self.ids[t[:k]] << 20 | self.ids[t[k:]], i) for t,
            i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids
        ]
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs] + [1 << 62], np.int64)
        self.merged = np.array([p[1] for p in pairs] + [-1], np.int32)
        self.known: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of adjacent tokens' merges; -1 where they don't merge."""
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit numbers. Words are not empty."""
        size = np.array([len(w) for w in words])
        stop = np.cumsum(size)
        start = stop - size
        sym = self.one[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[stop - 1] = -1
        before[start] = -1
        live = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}

        def note(at: np.ndarray, rank: np.ndarray) -> None:
            """Adds positions to the index; new ranks go to the heap."""
            keep = rank >= 0
            at, rank = at[keep], rank[keep]
            if not len(at):
                return
            if len(at) > 1:
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
                cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                lists, heads = np.split(at, cut), rank[np.concatenate(([0], cut))].tolist()
            else:
                lists, heads = [at], rank.tolist()
            for r, a in zip(heads, lists, strict=True):
                if r in index:
                    index[r].append(a)
                else:
                    index[r] = [a]
                    heapq.heappush(heap, r)

        heap: list[int] = []
        at = np.flatnonzero(after >= 0).astype(np.int32)
        note(at, self.rank(sym[at], sym[after[at]]))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[live[at]]
            nxt = after[at]
            at, nxt = at[nxt >= 0], nxt[nxt >= 0]
            fits = self.rank(sym[at], sym[nxt]) == r
            at = at[fits]
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                w = word[at]
                head = np.concatenate(([True], w[1:] != w[:-1]))
                if not head.all():
                    index[r] = [at[~head]]
                    heapq.heappush(heap, r)
                    at = at[head]
            gone = after[at]
            sym[at] = r
            live[gone] = False
            nxt = after[gone]
            after[at] = nxt
            has = nxt >= 0
            before[nxt[has]] = at[has]
            prev = before[at]
            left = prev[prev >= 0]
            note(
                np.concatenate((left, at[has])),
                self.rank(np.concatenate((sym[left], sym[at[has]])), np.concatenate((sym[at[prev >= 0]], sym[nxt[has]])))
            )
        out = sym[live].astype("<u4").tobytes()
        ends = (np.cumsum(np.add.reduceat(live, start)) * 4).tolist()
        return [out[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, texts: list[list[str]]) -> Iterator[bytes]:
        """The ids of each text, given as its pieces."""
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        fresh = {p for t in texts for p in t if p not in known}
        words = []
        for p in fresh:
            b = p.encode("utf-8", "surrogatepass")
            if (i := self.ids.get(b)) is None:
                words.append((p, b))
            else:
                known[p] = i.to_bytes(4, "little")
        if words:
            known.update(zip((p for p, _ in words), self.replay([b for _, b in words]), strict=True))
        for t in texts:
            yield b"".join([known[p] for p in t])

    def decode(self, ids: bytes) -> bytes:
        names = self.bytes
        return b"".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _coded(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        voc, find = vocabulary(path), regex.compile(pattern).findall
        ids, texts, n = [], [], 0

        def flush() -> pa.RecordBatch:
            rows = list(voc.encode(texts))
            cols = [
                pa.array(ids, pa.int64()), pa.array([len(x) // 4 for x in rows], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in rows]),
                pa.array([hashlib.sha256(voc.decode(x)).hexdigest() for x in rows])
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                names.append("ids")
                flat = pa.array(np.frombuffer(b"".join(rows), "<u4").astype(np.int32))
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) // 4 for x in rows]), pa.int32()), flat))
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                t = t.as_py() or ""
                ids.append(i.as_py())
                texts.append(find(t))
                n += len(t)
                if n >= CHUNK:
                    yield flush()
                    ids, texts, n = [], [], 0
        if ids:
            yield flush()

    return run


def encoded(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs, and the ids themselves if asked for. path: a file of ranks that every worker can open."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_coded(path, pattern, with_ids), schema)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
