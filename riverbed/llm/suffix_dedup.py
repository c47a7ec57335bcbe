"""Exact substring dedup: removes every byte that a string of SIZE bytes covers which also starts anywhere else.

1. Anchors. Every window of SIZE bytes chooses a position in it by its bytes alone, so equal windows choose equal anchors; only suffixes that start at anchors are looked at, about one in 70 bytes.
   A row is an anchor with the windows that choose it, known by the hash of the bytes at the anchor (gram) and of all bytes of its windows (span).
2. Counts. Grams are counted with map-side combining. Rows whose span occurs twice are repeated as a whole. Left over are rows that share a gram but not their span: ends of copied passages.
3. Suffix arrays. The distinct spans of such a gram are sorted by what follows the anchor; with the common prefixes of neighbours that is an enhanced suffix array. A stack scan gives
   its common-prefix intervals; in each, a second scan over the reversed left contexts gives the groups with a common left part, and those that go on differently on either side and make up SIZE bytes are maximal
   repeat groups with all their occurrences (`maximal_repeats` lists them). Grams with more than HOT spans, such as the ends of a passage that a third of all documents share, are resolved window by window with counts
   that combine on the map side, so that no task holds such a group.
4. Removal. Intervals are made distinct, listed per text and joined to the texts.

Texts are known by two hashes (96 bits), so that copies of a text share their intervals. Texts are shuffled twice, compressed: for the bytes around anchors in step 3, and in step 4.

Edge cases: a null text is empty; texts shorter than SIZE bytes are kept as they are. Repeated rows repeat each other, so that all their bytes go. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.llm.anchors import anchors
from riverbed.llm.common import runs, scratch, table, written
from riverbed.llm.shingles import BLOCK, mixed, powers, prefix

SIZE = 200
#: Spans of a gram that one suffix array may hold; with their bytes they take about 50 MB in a task.
HOT = 50_000


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in batch.column("text")]


def _anchored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, h1, h2 = _bytes(batch), batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        done = 0
        while done < len(texts):
            end, n = done, 0
            while end < len(texts) and (end == done or n + len(texts[end]) <= BLOCK):
                n += len(texts[end])
                end += 1
            data = np.frombuffer(b"".join(texts[done:end]), np.uint8)
            a = anchors(data, np.cumsum([0] + [len(t) for t in texts[done:end]]), SIZE)
            at = a["text"] + done
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (a["gram"], a["span"], h1[at], h2[at], *(a[k].astype(np.int32) for k in ("lo", "hi", "at")))],
                ["gram", "span", "h1", "h2", "lo", "hi", "at"]
            )
            done = end


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        kept = [i for i, n in enumerate(batch.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in kept], pa.array([press(t) for t in _bytes(batch)], pa.binary())],
            [*[batch.schema.names[i] for i in kept], "blob"]
        )


def _contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each listed anchor the bytes of its windows before and after it."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows, left, right = [], [], []
        for blob, asked in zip(batch.column("blob"), batch.column("asked"), strict=True):
            text = unpack(blob.as_py())
            for x in asked.as_py():
                rows.append(x)
                left.append(text[x["lo"] : x["at"]])
                right.append(text[x["at"] : x["hi"] + SIZE])
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in ("gram", "span", "h1")]
        cols += [pa.array([r[k] for r in rows], pa.int32()) for k in ("h2", "at")] + [
            pa.array([r["single"] for r in rows], pa.bool_()), pa.array(left, pa.binary()), pa.array(right, pa.binary())
        ]
        yield pa.RecordBatch.from_arrays(cols, ["gram", "span", "h1", "h2", "at", "single", "left", "right"])


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def prefix_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each node of the common-prefix interval tree of a suffix array; lcp[i] is that of suffixes i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, d in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > d:
            depth, first = stack.pop()
            yield depth, first, i
        if d >= 0 and (not stack or stack[-1][0] < d):
            stack.append((d, first))


def repeat_groups(left: list[bytes], right: list[bytes], size: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeat groups among occurrences of one anchor: (bytes before the anchor, bytes after it, all occurrences that have these in common), `size` bytes at least.

    left and right: the bytes on either side of each occurrence. Within an interval of the suffix array, members that share their left bytes are an interval of the array of reversed left
    contexts. It is a group of its own if its members go on differently on both sides: their common left part ends where they differ, or at a context's begin, and they lie in several
    children of the right interval. Others are the same occurrences as a longer group, which another pair of intervals gives.
    """
    order = sorted(range(len(right)), key=right.__getitem__)
    lcp = [common_prefix(right[i], right[j]) for i, j in zip(order[:-1], order[1:], strict=True)]
    edge = np.array([*lcp, -1], np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    back = [x[::-1] for x in left]
    for depth, first, last in prefix_intervals(lcp):
        need = max(0, size - depth)
        members = sorted(order[first : last + 1], key=back.__getitem__)
        near = [common_prefix(back[i], back[j]) for i, j in zip(members[:-1], members[1:], strict=True)]
        # the child of the right interval that each member lies in: children end where neighbours have just `depth` bytes in common
        child = np.concatenate(([0], np.cumsum(edge[first:last] == depth)))[place[members] - first]
        for before, a, b in prefix_intervals(near):
            if before >= need and child[a : b + 1].min() != child[a : b + 1].max():
                yield before, depth, members[a : b + 1]


def _arrays(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Intervals to remove, for spans that occur once."""
    out: list[tuple] = []
    for g in runs(batches, "gram"):
        left, right, single = g["left"].tolist(), g["right"].tolist(), g["single"].tolist()
        h1, h2, at = g["h1"].tolist(), g["h2"].tolist(), g["at"].tolist()
        furthest: dict[tuple[int, int], int] = {}
        for before, after, group in repeat_groups(left, right, SIZE):
            for i in group:
                if single[i]:
                    furthest[i, after] = max(before, furthest.get((i, after), 0))
        out += [(h1[i], h2[i], at[i] - before, at[i] + after) for (i, after), before in furthest.items()]
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=["h1", "h2", "start", "stop"])
            out = []
    yield pd.DataFrame(out, columns=["h1", "h2", "start", "stop"])


def _grouped(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """group, span, before, length of every maximal repeat group, a row for each distinct context in it; a context that occurs several times is a group by itself."""
    out: list[tuple] = []
    for g in runs(batches, "gram"):
        gram, left, right, spans = int(g["gram"].iloc[0]), g["left"].tolist(), g["right"].tolist(), g["span"].tolist()
        groups = list(repeat_groups(left, right, SIZE))
        groups += [(len(left[i]), len(right[i]), [i]) for i, single in enumerate(g["single"].tolist()) if not single]
        for before, after, group in groups:
            name = hashlib.blake2b(left[group[0]][len(left[group[0]]) - before :] + b"|" + right[group[0]][:after], digest_size=16).digest()
            out += [(gram, name, spans[i], before, before + after) for i in group]
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=["gram", "group", "span", "before", "length"])
            out = []
    yield pd.DataFrame(out, columns=["gram", "group", "span", "before", "length"])


def _windows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every window of every span: a hash of its bytes and of where the anchor lies."""
    for pdf in batches:
        for k in range(0, len(pdf), 2000):
            part = pdf.iloc[k : k + 2000]
            whole = [a + b for a, b in zip(part["left"], part["right"], strict=True)]
            size = np.array([len(w) for w in whole])
            data = np.frombuffer(b"".join(whole), np.uint8)
            sums = prefix(data)
            _, down = powers(len(data) + 1)
            start, n = np.cumsum(size) - size, size - SIZE + 1
            row = np.repeat(np.arange(len(whole)), n)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = start[row] + within
            before = part["left"].map(len).to_numpy()
            h = mixed((sums[at + SIZE] - sums[at]) * down[at] + (before[row] - within).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
            take = lambda c: part[c].to_numpy()[row]  # noqa: E731, B023
            yield pd.DataFrame(
                {
                    "gram": take("gram"), "w": h.view(np.int64), "h1": take("h1"), "h2": take("h2"),
                    "start": (take("at") - before[row] + within).astype(np.int32), "single": take("single")
                }
            )


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        sizes, removed, spans, kept = [], [], [], []
        for blob, cuts in zip(batch.column("blob"), batch.column("cuts"), strict=True):
            text = unpack(blob.as_py())
            ends: list[list[int]] = []
            for c in sorted((c["start"], c["stop"]) for c in cuts.as_py() or ()):
                if ends and c[0] <= ends[-1][1]:
                    ends[-1][1] = max(ends[-1][1], c[1])
                else:
                    ends.append(list(c))
            h, last = hashlib.sha256(), 0
            for a, b in ends:
                h.update(text[last:a])
                last = b
            h.update(text[last:])
            sizes.append(len(text))
            removed.append(sum(b - a for a, b in ends))
            spans.append(len(ends))
            kept.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (sizes, removed, spans)], pa.array(kept)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def _blobs(docs: DataFrame, keep: str) -> DataFrame:
    return docs.select(*([keep] if keep else []), "h1", "h2", "text").mapInArrow(
        _packed, f"{keep} long, " * bool(keep) + "h1 long, h2 int, blob binary"
    )


def _found(docs: DataFrame, place: str) -> tuple[DataFrame, DataFrame]:
    """(anchors whose gram occurs again, with `several` where its spans differ; the spans of such grams with their count c and one occurrence)."""
    # the anchors are computed twice, which costs less than to store them
    rows = docs.select("h1", "h2", "text").mapInArrow(_anchored, "gram long, span long, h1 long, h2 int, lo int, hi int, at int")
    grams = rows.groupBy("gram").agg(
        F.count("*").alias("_n"), F.min("span").alias("_lo"), F.max("span").alias("_hi")
    ).where("_n > 1").select("gram", F.expr("_lo <> _hi").alias("several"))
    found = written(rows.join(grams, "gram"), f"{place}/found")
    spans = found.where("several").groupBy("gram", "span").agg(F.count("*").alias("c"), F.min(F.struct("h1", "h2", "lo", "hi", "at")).alias("one"))
    return found, written(spans, f"{place}/spans")


def _around(docs: DataFrame, spans: DataFrame, place: str) -> DataFrame:
    """gram, span, h1, h2, at, single, left, right of one occurrence of each span."""
    ask = spans.select(F.struct("gram", "span", "one.h1", "one.h2", "one.lo", "one.hi", "one.at", F.expr("c = 1").alias("single")).alias("x"))
    asked = ask.groupBy("x.h1", "x.h2").agg(F.collect_list("x").alias("asked"))
    texts = _blobs(docs, "").dropDuplicates(["h1", "h2"])
    made = texts.join(asked, ["h1", "h2"]).select("blob", "asked").mapInArrow(
        _contexts, "gram long, span long, h1 long, h2 int, at int, single boolean, left binary, right binary"
    )
    return written(made, f"{place}/around")


def _by_gram(around: DataFrame) -> DataFrame:
    n = max(1, int(around.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return around.repartition(n, "gram").sortWithinPartitions("gram")


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """group, h1, h2, start, length: every occurrence of each maximal repeat group that an anchor lies in, by the hashes of its text. docs: h1, h2, text.

    A group is a string of SIZE bytes or more that occurs twice at least and would lose an occurrence if it were longer on either side, as far as the windows of its anchor reach. One
    gram's distinct contexts are one task's work, about a kilobyte each.
    """
    place = scratch(docs.sparkSession)
    found, spans = _found(docs, place)
    groups = _by_gram(_around(docs, spans, place)).mapInPandas(_grouped, "gram long, group binary, span long, before int, length int")
    many = found.where("several").join(groups, ["gram", "span"]).select("group", "h1", "h2", (F.col("at") - F.col("before")).alias("start"), "length")
    whole = found.where("NOT several").select(
        F.expr("CAST(concat(hex(gram), hex(span)) AS binary)").alias("group"), "h1", "h2", F.col("lo").alias("start"),
        (F.col("hi") + SIZE - F.col("lo")).alias("length")
    )
    return many.unionByName(whole).distinct()


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """h1, h2, start, stop: intervals of each text that cover all its repeated bytes and no others; they may overlap. docs: h1, h2, text."""
    place = scratch(docs.sparkSession)
    found, spans = _found(docs, place)
    interval = ["h1", "h2", F.col("lo").alias("start"), (F.col("hi") + SIZE).alias("stop")]
    often = spans.where("c > 1").select("gram", "span")
    whole = found.where("NOT several").select(*interval).unionByName(
        found.where("several").join(often, ["gram", "span"], "left_semi").select(*interval)
    )
    around = _around(docs, spans, place)
    big = spans.groupBy("gram").agg(F.count("*").alias("_v")).where(f"_v > {HOT}").select("gram")
    ends = "h1 long, h2 int, start int, stop int"
    few = _by_gram(around.join(big, "gram", "left_anti").select("gram", "h1", "h2", "at", "single", "left", "right")).mapInPandas(_arrays, ends)
    every = around.join(big, "gram", "left_semi").mapInPandas(_windows, "gram long, w long, h1 long, h2 int, start int, single boolean")
    twice = every.groupBy("gram", "w").agg(F.count("*").alias("_c")).where("_c > 1").select("gram", "w")
    many = every.where("single").join(twice, ["gram", "w"], "left_semi").select("h1", "h2", "start", (F.col("start") + SIZE).alias("stop"))
    return whole.unionByName(few).unionByName(many).distinct()


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    t = F.coalesce("text", F.lit(""))
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(t).alias("h1"), F.hash(t).alias("h2"), t.alias("text"))
    cuts = repeated_intervals(keyed).groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))
    cuts = written(cuts, scratch(docs.sparkSession))
    return _blobs(keyed, "doc_id").join(cuts, ["h1", "h2"], "left").select("doc_id", "blob", "cuts").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
