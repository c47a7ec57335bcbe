"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is contained in a document if at least CONTAINED per cent of its distinct shingles occur there. A shingle has five words; an item of fewer words is one shingle
of all its words, so that it must occur as a whole. Items are partitioned by size (powers of two of their shingle counts); the partition's upper size u sets the length
of its items' MinHash sketch, the k smallest shingle hashes with k = floor((1 - t) u) + 1 + SPARE. At most floor((1 - t) u) shingles of a contained item may be
missing, so 1 + SPARE of the sketch must occur in the document, however long it is: the search has no false negatives, and the sketch is about a fifth of the item.
Candidate pairs are then verified with the shingles themselves: the pairs fetch their items' shingles, and these look for themselves in the pairs' documents.

Words are maximal runs of letters and digits of the lower-cased text. Documents are shingled once for each shingle length that items have, five at most.

Edge cases: null and empty texts have no words; they contain nothing and are contained in nothing. Items with equal ids, null among them, are one item with the union of
their shingles. Rows with equal doc_id, null among them, are one document in the pairs. An empty table on either side gives no pairs. Other columns are ignored by
`contaminated_pairs` and kept by `drop_contaminated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.llm.common import scratch, table, written

WORDS = 5
CONTAINED = 80
#: Sketch hits asked for beyond the one that must occur.
SPARE = 2
#: Sketches of more rows than this are joined by shuffle; this many take about 30 MB in a broadcast.
BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(docs: DataFrame, keep: list[str], text: bool, sizes: list[int] | None = None) -> DataFrame:
    """keep and s: a row for each shingle, hashed unless text. sizes: the lengths of shingles; by default WORDS, or all words of a text that has fewer."""
    w = docs.select(*keep, _words(F.col("text")).alias("_w"))

    def made(size: int) -> str:
        each = "".join(f", _w[i + {k}]" for k in range(1, size))
        one = f"concat_ws(' ', w{each})" if text else f"xxhash64(w{each})"
        return f"transform(slice(_w, 1, size(_w) - {size - 1}), (w, i) -> {one})"

    none = f"CAST(array() AS array<{'string' if text else 'bigint'}>)"
    if sizes is None:
        lists = "CASE " + " ".join(
            f"WHEN size(_w) {'>=' if k == WORDS else '='} {k} THEN {made(k)}" for k in range(WORDS, 0, -1)
        ) + f" ELSE {none} END"
    else:
        lists = "concat(" + ", ".join(f"CASE WHEN size(_w) >= {k} THEN {made(k)} ELSE {none} END" for k in sizes) + ")"
    return w.select(*keep, F.explode(F.expr(lists)).alias("s"))


def shingle_sizes(items: DataFrame) -> list[int]:
    """The lengths of shingles that items have: WORDS values at most."""
    n = F.least(F.size(_words(F.col("text"))), F.lit(WORDS))
    return sorted(r["n"] for r in items.select(n.alias("n")).where("n > 0").distinct().collect())


def item_sketches(items: DataFrame) -> DataFrame:
    """item_id, s, need: the sketch of every item and how many of its hashes a document must hold."""
    ranked = _shingles(items, ["item_id"], False).distinct().selectExpr(
        "item_id", "s", "count(*) OVER (PARTITION BY item_id) AS n", "row_number() OVER (PARTITION BY item_id ORDER BY xxhash64(s), s) AS place"
    )
    sized = ranked.withColumn("upper", F.expr("shiftleft(1L, CAST(ceil(log2(n)) AS int))"))
    lost = f"upper * {100 - CONTAINED} DIV 100"
    sized = sized.withColumn("k", F.expr(f"least(n, {lost} + 1 + {SPARE})"))
    # an item shorter than its partition's sketch is all in it, and may lack as many shingles as its own size allows
    return sized.where("place <= k").select("item_id", "s", F.expr(f"k - n * {100 - CONTAINED} DIV 100").alias("need"))


def contaminated_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shingles of the item, n_shared: every pair of a document and an item that it contains."""
    spark = docs.sparkSession
    place = scratch(spark)
    items = items.select("item_id", "text")
    sketch = written(item_sketches(items), f"{place}/sketch")
    sizes = shingle_sizes(items)
    hashed = _shingles(docs, ["doc_id"], False, sizes or [WORDS])
    small = sketch.count() <= BROADCAST_ROWS
    hits = hashed.join(F.broadcast(sketch) if small else sketch, "s").select("doc_id", "item_id", "s", "need").distinct()
    found = hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need").select(
        F.col("doc_id").alias("_d"), F.col("item_id").alias("_i")
    )
    pairs = written(found, f"{place}/pairs")
    texts = docs.select("doc_id", "text").join(pairs.select("_d").distinct(), F.expr("doc_id <=> _d"), "left_semi")
    held = _shingles(texts, ["doc_id"], True, sizes or [WORDS]).distinct()
    own = _shingles(items, ["item_id"], True).distinct().withColumn("n_shingles", F.expr("count(*) OVER (PARTITION BY item_id)"))
    asked = pairs.join(own, F.expr("item_id <=> _i")).withColumnRenamed("s", "_s")
    shared = asked.join(held, F.expr("doc_id <=> _d AND s = _s"), "left_semi").groupBy(F.col("_d").alias("doc_id"), "item_id").agg(
        F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n_shared")
    )
    return shared.where(f"100 * n_shared >= {CONTAINED} * n_shingles")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    bad = written(contaminated_pairs(docs, items).select(F.col("doc_id").alias("_bad")).distinct(), scratch(docs.sparkSession))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = f"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') FROM benchmark),
z AS (SELECT DISTINCT least(len(w), {WORDS}) AS z FROM w WHERE side = 'i' AND len(w) > 0),
s AS (SELECT DISTINCT side, id, array_to_string(w[p:p + z - 1], ' ') AS s FROM (SELECT side, id, w, z, unnest(generate_series(1, len(w) - z + 1)) AS p FROM w, z WHERE len(w) >= z AND (side = 'd' OR z = least(len(w), {WORDS})))),
i AS (SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n_shingles FROM s WHERE side = 'i')
SELECT id AS doc_id, item_id, n_shingles, count(*) AS n_shared FROM s JOIN i USING (s) WHERE side = 'd' GROUP BY ALL HAVING 100 * count(*) >= {CONTAINED} * n_shingles"""
