"""MinHash near-duplicates by a chosen-path set similarity join.

Documents with equal shingle sets form a class, and classes are joined. A class stands for itself in TREES trees. In each tree a node is split by selected minwise
tokens: at the root by one coordinate of the MinHash signature, below by BRANCH coordinates that a hash of the node's path selects. Nodes of at most SMALL classes
are compared exhaustively. A pair of similarity s meets in a tree with probability s q at least, where q = 1 - (1 - s q)^BRANCH; at 0.8 and BRANCH = 2 that is 0.75 in a
tree however deep, and over 0.9999 in TREES = 8 trees. Comparison uses signatures first and then the full sets, so that every link is exact.

Large groups of near copies would never split. A first round therefore follows FIRST paths of DEEP coordinates at once, where hardly anything but near copies meets, and compares each chunk of a
large node with the same few pivots and within itself; the links it finds make components, and the trees proper drop every node whose classes are all in one component by then. Its chunks hold SMALL + PIVOTS classes.
A node with over half the classes of its parent is dense: most of its pairs share tokens, and further splitting would only multiply it. The classes of all dense nodes, and of those still large at the last level, are
joined by an exact prefix filter instead. Shingles are ordered, those that a sample of these classes has often last; a pair that is similar enough has one in common among the first fifth of the larger set and the
first ninth of the smaller. What a template determines is thus rarely looked at. Of each such shingle, all pairs of two components with a member of the latter kind are compared, in pairs of chunks of WIDE,
so that no task's group grows with a group of copies. The sample sets the order alone and so the work, not what is found.
No pairs are emitted but the links that join two components of a chunk.

Edge cases: null texts and texts without words have an empty set and stay alone, with their own doc_id as component. A text shorter than a shingle is one shingle as a whole.
Rows of equal doc_id and text are one document; rows that share a doc_id but differ are judged apart. A null doc_id takes part, but never names a component unless nothing else does. One document of each component is kept:
the one of the least doc_id, then of the least hash of its text.
An empty table gives an empty result. Other columns are ignored by `near_duplicates` and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riverbed.llm import shingles
from riverbed.llm.common import discard, runs, scratch, table, written
from riverbed.llm.graph import components

SIMILAR = 80
TREES = 8
BRANCH = 2
LEVELS = 6
FIRST = 4
DEEP = 3
#: Classes in a chunk of the comparison of dense nodes, which meets another such chunk.
WIDE = 512
#: Classes whose shingles are counted, about, and the most frequent shingles that are told from rare ones.
COUNTED = 50_000
COMMON = 100_000
SMALL = 48
PIVOTS = 3
COORDINATES = 64
#: Equal coordinates that a pair must have to be compared in full: 4.5 deviations below the mean at a similarity of 0.8.
PLAUSIBLE = 37


def _sketched(size: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            done = 0
            for block in shingles.blocks(pdf["text"].tolist()):
                sets = list(shingles.shingle_sets(block, size))
                own = {c: pdf[c].iloc[done : done + len(block)].to_numpy() for c in ("doc_id", "h1", "h2")}
                done += len(block)
                yield pd.DataFrame(
                    own | {
                        "n_shingles": [len(s) for s in sets], "cid": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                        "sig": list(shingles.signatures(sets, COORDINATES).view(np.int32))
                    }
                )

    return run


def _with_sets(size: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            for block in shingles.blocks(pdf["text"].tolist()):
                sets = [s.tobytes() for s in shingles.shingle_sets(block, size)]
                yield pd.DataFrame({"cid": [xxhash.xxh3_128_digest(s) for s in sets], "set": sets})

    return run


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _plausible(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each group the classes with a plausible partner under another label, in connected parts; the part's members name it, so that it is found once however many nodes show it."""
    import xxhash

    names, cids, labels = [], [], []
    for g in runs(batches, "grp"):
        # the most common label last: its rows need no comparison with each other
        top, most = Counter(g["label"]).most_common(1)[0]
        g = g.iloc[np.argsort((g["label"] == top).to_numpy(), kind="stable")]
        sig, cid, label = np.stack(g["sig"].to_numpy()), g["cid"].tolist(), g["label"].tolist()
        n = len(cid)
        u, hit = _Union(n), [False] * n
        for i in range(n - most):
            for j in np.flatnonzero((sig[i + 1 :] == sig[i]).sum(1) >= PLAUSIBLE) + i + 1:
                if cid[i] != cid[j] and label[i] != label[j]:
                    hit[i] = hit[j] = True
                    u.join(i, int(j))
        parts: dict[int, set] = {}
        own = dict(zip(cid, label, strict=True))
        for i in range(n):
            if hit[i]:
                parts.setdefault(u.root(i), set()).add(cid[i])
        for p in parts.values():
            name = xxhash.xxh3_128_digest(b"".join(sorted(p)))
            names += [name] * len(p)
            cids += p
            labels += [own[c] for c in p]
        if len(names) > 10_000:
            yield pd.DataFrame({"part": names, "cid": cids, "label": labels})
            names, cids, labels = [], [], []
    yield pd.DataFrame({"part": names, "cid": cids, "label": labels})


def _linked(size: int):
    """The links of each part, on full sets; pairs that are already connected in the part, or have one label, are passed over."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = [], []
        for g in runs(batches, "part"):
            sets = [s for block in shingles.blocks(g["text"].tolist()) for s in shingles.shingle_sets(block, size)]
            cid, label = g["cid"].tolist(), g["label"].tolist()
            u, first = _Union(len(cid)), {}
            for i, x in enumerate(label):
                u.join(i, first.setdefault(x, i))
            order = sorted(range(len(cid)), key=lambda i: len(sets[i]))  # noqa: B023
            sizes, top = [len(sets[i]) for i in order], Counter(label).most_common(1)[0][0]
            # rows of the most common label are in one component and need no comparison with each other
            for x, i in enumerate(order):
                if label[i] == top:
                    continue
                m = sizes[x]
                for y in range(bisect_left(sizes, m * SIMILAR / 100), bisect_right(sizes, m * 100 / SIMILAR)):
                    j, n = order[y], sizes[y]
                    if (y > x or label[j] == top) and u.root(i) != u.root(j):
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * both >= SIMILAR * (m + n - both):
                            u.join(i, j)
                            a.append(cid[i])
                            b.append(cid[j])
            if len(a) > 10_000:
                yield pd.DataFrame({"a": a, "b": b})
                a, b = [], []
        yield pd.DataFrame({"a": a, "b": b})

    return run


def _compared(groups: DataFrame, classes: DataFrame, docs: DataFrame, size: int, place: str) -> DataFrame:
    """Links (a, b) within groups. groups: grp, cid, label; classes: cid, doc_id, h1, h2, sig.

    Texts travel to the parts that ask for them, and their sets are made there: a set takes eight bytes a word that don't compress, a text less than half of it.
    """
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = groups.join(classes.select("cid", "sig"), "cid").repartition(n, "grp").sortWithinPartitions("grp")
    parts = written(rows.mapInPandas(_plausible, "part binary, cid binary, label binary").distinct(), f"{place}/parts")
    asked = parts.join(classes.selectExpr("cid", *_REP), "cid")
    full = _texts(parts, classes, docs).join(asked, F.expr(_OWN)).select("part", "cid", "label", "text")
    found = written(full.repartition(n, "part").sortWithinPartitions("part").mapInPandas(_linked(size), "a binary, b binary"), f"{place}/links")
    discard(docs.sparkSession, f"{place}/parts")
    return found


def _counted(rows: DataFrame, path: str) -> DataFrame:
    """node, n, up of nodes with several labels, one of those with the same classes, and pivots p0, p1 ... of nodes over SMALL; written to path.

    Sums and extremes of numbers are combined on the map side, and most nodes have one class: they travel as seven numbers. Pivots are looked for in the few large nodes alone.
    """
    label = F.xxhash64("label")
    same = rows.groupBy("node").agg(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(cid))").alias("x"), F.expr("sum(xxhash64(cid, 1) % 1000000007)").alias("y"),
        F.min(label).alias("lo"), F.max(label).alias("hi"), F.min("up").alias("up")
    )
    told = same.where("lo <> hi").groupBy("n", "x", "y").agg(F.min_by(F.struct("node", "up"), "node").alias("s")).select("n", "s.*")
    told = written(told, f"{path}-told")
    large = rows.join(told.where(f"n > {SMALL}").select("node"), "node", "left_semi")
    pivots = large.groupBy("node").agg(*[F.min_by(F.struct("cid", "label"), F.xxhash64("cid", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)])
    return written(told.join(pivots, "node", "left"), path)


def _chunks(rows: DataFrame, counts: DataFrame, salt: int) -> DataFrame:
    """grp, cid, label: small nodes as they are, larger ones in chunks of about SMALL, each with the node's pivots."""
    kept = rows.drop("up").join(counts, "node").withColumn("_c", F.expr(f"ceil(n / {SMALL})"))
    spread = kept.select(F.expr(f"xxhash64(node, pmod(xxhash64(cid, {salt}), _c))").alias("grp"), "cid", "label")
    pivots = counts.where(f"n > {SMALL}").select("node", "n", F.inline(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))))
    at = pivots.select(
        "cid", "label", F.explode(F.expr(f"transform(sequence(0, CAST(ceil(n / {SMALL}) AS int) - 1), i -> xxhash64(node, i))")).alias("grp")
    )
    return _mixed(spread.unionByName(at.select("grp", "cid", "label")))


def _mixed(groups: DataFrame) -> DataFrame:
    """The distinct rows of groups with more than one label: the others can't give a new link. A group is at most two closing chunks, so the window is bounded."""
    every = W.partitionBy("grp")
    return groups.distinct().select("*", (F.min("label").over(every) < F.max("label").over(every)).alias("_mixed")).where("_mixed").drop("_mixed")


#: The document that stands for a class, as columns, and the test for it.
_REP = ("doc_id AS _id", "h1 AS _h1", "h2 AS _h2")
_OWN = "doc_id <=> _id AND h1 = _h1 AND h2 = _h2"


def _texts(cids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2, text of the documents that stand for the classes of cids, each once."""
    active = classes.join(cids.select("cid"), "cid", "left_semi").selectExpr(*_REP)
    return docs.select("doc_id", "h1", "h2", "text").join(active, F.expr(_OWN), "left_semi").dropDuplicates(["doc_id", "h1", "h2"])


def _tokens(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for s in pdf["set"]:
            yield pd.DataFrame({"token": np.frombuffer(s, np.int64)})


def _prefixes(size: int, common: dict[int, int]):
    """Of each text the shingles by which it can meet one as large or smaller, rare ones first, and how many of them suffice to meet one as large or larger."""
    seen = np.array(sorted(common), np.int64)
    often = np.array([common[t] for t in seen.tolist()], np.int64)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _with_sets(size)(batches):
            first, few = [], []
            for s in pdf["set"]:
                s = np.frombuffer(s, np.int64)
                n, count = len(s), np.zeros(len(s), np.int64)
                if len(seen):
                    at = np.minimum(np.searchsorted(seen, s), len(seen) - 1)
                    count = np.where(seen[at] == s, often[at], 0)
                first.append(s[np.lexsort((s, count))][: n + 1 - -(-SIMILAR * n // 100)])
                few.append(n + 1 - -(-2 * SIMILAR * n // (100 + SIMILAR)))
            yield pd.DataFrame({"cid": pdf["cid"], "tokens": first, "few": few})

    return run


def _closing(dense: DataFrame, classes: DataFrame, docs: DataFrame, size: int, place: str) -> DataFrame:
    """grp, cid, label: groups in which all pairs of two labels meet that may be similar. dense: cid, label, distinct."""
    part = max(1, dense.count() // COUNTED)
    some = dense.where(F.expr(f"pmod(xxhash64(cid, 17), {part}) = 0"))
    tokens = _texts(some, classes, docs).mapInPandas(_with_sets(size), "cid binary, set binary").mapInPandas(_tokens, "token long")
    common = {
        r["token"]: r["n"] for r in tokens.groupBy("token").agg(
            F.count("*").alias("n")
        ).where("n > 1").orderBy(F.desc("n"), "token").limit(COMMON).collect()
    }
    first = _texts(dense, classes, docs).mapInPandas(_prefixes(size, common), "cid binary, tokens array<long>, few int")
    rows = first.join(dense, "cid").select(
        "cid", "label", "few", F.posexplode("tokens").alias("_k", "node")
    ).select("node", "cid", "label", F.expr("_k < few").alias("ix"))
    rows = written(rows, f"{place}/prefixes")
    by = rows.groupBy("node", "label").agg(
        F.count("*").alias("n"), F.count_if("ix").alias("i"), F.expr("bit_xor(xxhash64(cid, ix))").alias("x"),
        F.expr("sum(xxhash64(cid, ix, 1) % 1000000007)").alias("y")
    )
    large = F.struct("n", "label")
    by = by.groupBy("node").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.max("n").alias("m"), F.sum("i").alias("i"), F.max_by("i", large).alias("im"),
        F.max_by("label", large).alias("most"), F.expr("bit_xor(x)").alias("x"), F.sum("y").alias("y")
    ).where("k > 1 AND i > 0")
    # shingles with the same classes are one node
    by = by.groupBy("n", "x", "y").agg(F.min_by(F.struct("node", "m", "i", "im", "most"), "node").alias("s")).select("n", "s.*")
    both = rows.join(by, "node").withColumn("out", F.expr("label <> most"))
    groups = []
    # those of other labels than the most common one with all, and those of that label with the others
    for k, (side, sides, rest, rests) in enumerate((("ix AND out", "i - im", "true", "n"), ("ix AND NOT out", "im", "out", "n - m"))):
        cut = both.where(f"{sides} > 0").selectExpr("*", f"ceil(({sides}) / {WIDE}) AS s", f"ceil(({rests}) / {WIDE}) AS a")
        groups.append(
            cut.where(side).selectExpr(
                "node", "cid", "label", "explode(sequence(0L, a - 1)) AS x", "pmod(xxhash64(cid, 13), s) AS y"
            ).withColumn("k", F.lit(k))
        )
        groups.append(
            cut.where(rest).selectExpr(
                "node", "cid", "label", "pmod(xxhash64(cid, 11), a) AS x", "explode(sequence(0L, s - 1)) AS y"
            ).withColumn("k", F.lit(k))
        )
    every = groups[0].unionByName(groups[1]).unionByName(groups[2]).unionByName(groups[3])
    return _mixed(every.select(F.xxhash64("k", "node", "x", "y").alias("grp"), "cid", "label"))


def links(classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """node and root for every cid that has a link. classes: cid, doc_id, h1, h2 of the document that stands for it, sig; docs: doc_id, text, h1, h2."""
    spark = docs.sparkSession
    place = scratch(spark)
    path = lambda t, deep: "xxhash64(" + ", ".join([str(t), *[f"sig[{t * (COORDINATES // TREES) + k}]" for k in range(deep)]]) + ")"
    rooted = lambda trees, deep: classes.select(
        "cid", "label", F.lit(None).cast("long").alias("up"), F.explode(F.array(*[F.expr(path(t, deep)) for t in range(trees)])).alias("node")
    )
    # first round: every class is its own label
    plain = classes
    classes = plain.withColumn("label", F.col("cid"))
    rows = rooted(FIRST, DEEP)
    first = _compared(written(_chunks(rows, _counted(rows, f"{place}/c"), 0), f"{place}/g"), plain, docs, size, f"{place}/first")
    roots = written(components(first), f"{place}/roots")
    for done in ("c", "c-told", "g"):
        discard(spark, f"{place}/{done}")
    classes = written(
        plain.join(roots, F.col("cid") == F.col("node"), "left").select("cid", "sig", F.coalesce("root", "cid").alias("label")),
        f"{place}/classes"
    )
    # each level's groups are written at once: one plan for all levels would be planned again after each of its many stages
    rows, levels = rooted(TREES, 1), 0
    for level in range(1, LEVELS + 1):
        counts = _counted(rows, f"{place}/n{level}")
        split = f"n > {SMALL} AND NOT coalesce(2 * n > up, false)"
        last = level == LEVELS
        written(_chunks(rows, counts.where(f"n <= {SMALL}"), level), f"{place}/small{level}")
        written(
            rows.join(counts.where(f"n > {SMALL}" + f" AND NOT ({split})" * (not last)).select("node"), "node").select("cid", "label").distinct(),
            f"{place}/dense{level}"
        )
        levels = level
        large = counts.where(split).select("node", "n")
        if last or large.isEmpty():
            break
        below = rows.drop("up").join(large, "node").join(classes.select("cid", "sig"), "cid")
        step = [F.expr(f"xxhash64(node, {k}, sig[CAST(pmod(xxhash64(node, {k}), {COORDINATES}) AS int)])") for k in range(BRANCH)]
        rows = written(below.select("cid", "label", F.col("n").alias("up"), F.explode(F.array(*step)).alias("node")), f"{place}/r{level}")
    small, dense = (
        spark.read.schema(t).parquet(*[f"{place}/{kind}{k}" for k in range(1, levels + 1)]) for kind,
        t in (("small", "grp long, cid binary, label binary"), ("dense", "cid binary, label binary"))
    )
    groups = small.unionByName(_closing(written(dense.distinct(), f"{place}/dense"), plain, docs, size, place))
    groups = written(groups, f"{place}/groups")
    # what the levels wrote is not read again
    for done in ("classes", "dense", "prefixes", *[f"{kind}{k}" for k in range(1, levels + 1) for kind in ("n", "small", "dense", "r")], *[f"n{k}-told" for k in range(1, levels + 1)]):
        discard(spark, f"{place}/{done}")
    more = _compared(groups, plain, docs, size, f"{place}/more")
    roots = written(components(first.unionByName(more)), scratch(spark))
    discard(spark, place)
    return roots


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with h1 and h2, 96 bits by which texts of one doc_id are told."""
    return docs.withColumns({"h1": F.xxhash64("text"), "h2": F.hash("text")})


def _judged(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, h1, h2, n_shingles, component_id, kept for each row of docs."""
    spark = docs.sparkSession
    keyed = _keyed(docs.select("doc_id", "text"))
    schema = "doc_id long, h1 long, h2 int, n_shingles long, cid binary, sig array<int>"
    rows = written(keyed.mapInPandas(_sketched(size), schema), scratch(spark))
    # nulls last
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    classes = rows.where("n_shingles > 0").groupBy("cid").agg(F.min(key).alias("b"), F.first("sig").alias("sig"))
    classes = written(classes.select("cid", "b.doc_id", "b.h1", "b.h2", "sig", "b"), scratch(spark))
    roots = links(classes.drop("b"), keyed, size)
    named = classes.select("cid").join(roots, F.col("cid") == F.col("node"), "left").select("cid", F.coalesce("root", "cid").alias("root"))
    best = classes.select("cid", "b").join(named, "cid")
    owner = named.join(best.groupBy("root").agg(F.min("b").alias("b")), "root").select("cid", "b")
    out = rows.drop("sig").join(owner, "cid", "left")
    alone = F.col("n_shingles") == 0
    kept = alone | (F.col("doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("h1") == F.col("b.h1")) & (F.col("h2") == F.col("b.h2")))
    return out.select(
        "doc_id", "h1", "h2", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("b.doc_id")).alias("component_id"), kept.alias("kept")
    )


def near_duplicates(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    return _judged(docs, size).drop("h1", "h2")


def drop_near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """docs with one document of each component, the one that is kept, with all columns. Rows that are equal in doc_id and text are one document, of which one row stays."""
    gone = written(
        _judged(docs, size).where("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct(),
        scratch(docs.sparkSession)
    )
    own = F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.xxhash64("text") == F.col("_h1")) & (F.hash("text") == F.col("_h2"))
    return docs.join(gone, own, "left_anti").dropDuplicates(["doc_id", "text"])


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 4)
