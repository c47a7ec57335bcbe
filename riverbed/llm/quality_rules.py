"""Quality rules with adaptive thresholds.

Each document gets counts over its whole text. A quantile sketch of every derived rate is kept per (lang, source): the sketch is a
histogram whose buckets keep the six leading bits of a whole number, so a quantile is off by at most 1/32 of its value, and two
sketches merge by adding counts. Spark therefore pre-aggregates it on the map side, and a source with a third of all rows costs a few hundred
rows in the shuffle. Thresholds are fences around the middle half of a group's documents; the documents are joined to them.
A group's sketch is merged with that of its language, and that with the sketch of all, as if PRIOR more documents of the larger one were in the smaller: a group's own
documents count in proportion to their number, at every size alike. Weights are whole numbers, so that the result doesn't depend on the order of sums.

Edge cases: a null or empty text, and one of white space alone, has no words, takes no part in sketches and fails the base rule. Null lang or
source is a group of its own. Repeated rows are judged row by row, each with the same verdict. An empty table gives an empty result. Other columns of
the input are kept by `quality_filter` and ignored by `quality_verdicts`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.llm.common import discard, scratch, table, words, written

SYMBOLS = "[#*$%&|<>]"
UPPER = "[A-Z]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Documents of the language that a group is merged with, and of all that a language is.
PRIOR = 100
#: Least distance of a fence from the quartile, in the rate's own unit: a uniform group still tolerates this much.
SLACK = {"sym": 100, "rep": 250, "dup": 250, "upp": 250, "len": 150}
#: Rates that may also be too low.
TWO_SIDED = ("len",)
#: Quartile distances between a quartile and its fence.
REACH = 3


def text_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep, then counts over the whole text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*keep, t.alias("_t"), words(F.col("text")).alias("_w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE)).alias("_l"))
    pairs = "transform(slice(_w, 1, size(_w) - 2), (w, i) -> struct(xxhash64(w, _w[i + 1], _w[i + 2]) AS h, i AS p))"
    hashed = base.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.regexp_count("_t", F.lit(UPPER)).cast("long").alias("n_upper"),
        F.expr(f"CASE WHEN size(_w) > 3 THEN sort_array({pairs}) ELSE CAST(array() AS array<struct<h:bigint,p:int>>) END").alias("_s"),
    )
    again = "sort_array(transform(filter(transform(_s, (x, j) -> IF(x.h <=> get(_s, j + 1).h OR x.h <=> get(_s, j - 1).h, x.p, -1)), p -> p >= 0), p -> p))"
    found = hashed.withColumn("_r", F.expr(again)).drop("_s")
    fresh = "aggregate(_r, struct(0L AS n, -3 AS last), (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last), a -> a.n)"
    return found.withColumn("n_repeat_words", F.expr(fresh)).drop("_r")


def rates(counts: DataFrame) -> DataFrame:
    """Whole-number rates; null without words. sym, rep: per thousand words; dup: per thousand lines; upp: per thousand characters in words; len: hundredths of characters a word."""
    per = lambda a, b, k: F.expr(f"CASE WHEN n_words > 0 THEN {a} * {k} DIV greatest({b}, 1) END")
    return counts.withColumns(
        {
            "sym": per("n_symbols", "n_words", 1000), "rep": per("n_repeat_words", "n_words", 1000), "dup": per("n_dup_lines", "n_lines", 1000),
            "upp": per("n_upper", "word_chars", 1000), "len": per("word_chars", "n_words", 100)
        }
    )


def sketches(rated: DataFrame) -> DataFrame:
    """Rows (level, lang, source, rate, bucket, n): level 0 by language and source, 1 by language, 2 for all."""
    named = F.array(*[F.struct(F.lit(m).alias("rate"), F.col(m).alias("v")) for m in SLACK])
    bucket = "shiftleft(shiftright(v, greatest(0, length(bin(v)) - 6)), greatest(0, length(bin(v)) - 6))"
    own = rated.where("n_words > 0").select("lang", "source", F.inline(named)).groupBy(
        "lang", "source", "rate", F.expr(bucket).alias("bucket")
    ).agg(F.count("*").alias("n"))
    levels = F.array(
        *[
            F.struct(F.lit(k).alias("level"), a.alias("_lang"), b.alias("_source")) for k,
            (a, b) in enumerate(
                [
                    (F.col("lang"), F.col("source")), (F.col("lang"), F.lit(None).cast("string")),
                    (F.lit(None).cast("string"), F.lit(None).cast("string"))
                ]
            )
        ]
    )
    return own.select("rate", "bucket", "n", F.inline(levels)).groupBy(
        "level", F.col("_lang").alias("lang"), F.col("_source").alias("source"), "rate", "bucket"
    ).agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): lower and upper fence of each rate, from its sketch merged with those above it.

    A group has a row for each bucket that any document is in: a few hundred a rate. Each group is worked out by itself, so they spread over tasks.
    """
    level = lambda k, *keys: sketch.where(f"level = {k}").select(*keys, "rate", "bucket", F.col("n").cast("decimal(38,0)").alias(f"n{k}"))
    groups = sketch.where("level = 0").select("lang", "source", "rate").distinct()
    # six leading bits of a 64-bit number: under 2,000 buckets a rate, whatever the input
    grid = groups.join(F.broadcast(level(2)), "rate")
    same = lambda *keys: F.expr(" AND ".join(f"g.{k} <=> h.{k}" for k in (*keys, "rate", "bucket")))
    for k, keys in ((1, ("lang",)), (0, ("lang", "source"))):
        grid = grid.alias("g").join(level(k, *keys).alias("h"), same(*keys), "left").select(
            "g.*", F.coalesce(f"h.n{k}", F.lit(0).cast("decimal(38,0)")).alias(f"n{k}")
        )
    every = "OVER (PARTITION BY lang, source, rate)"
    sized = grid.selectExpr("*", f"sum(n1) {every} AS t1", f"sum(n2) {every} AS t2")
    weight = f"n0 * t2 * (t1 + {PRIOR}) + {PRIOR} * (n1 * t2 + {PRIOR} * n2)"
    weighed = sized.selectExpr("lang", "source", "rate", "bucket", f"CAST({weight} AS decimal(38,0)) AS weight")
    ranked = weighed.selectExpr("*", "sum(weight) OVER (PARTITION BY lang, source, rate ORDER BY bucket) AS upto", f"sum(weight) {every} AS total")
    at = lambda k: f"min(CASE WHEN 4 * upto >= {k} * total THEN bucket END)"
    q = ranked.groupBy("lang", "source", "rate").agg(F.expr(at(1)).alias("q1"), F.expr(at(3)).alias("q3"))
    slack = F.expr("CASE rate " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in SLACK.items()) + " END")
    wide = F.greatest(REACH * (F.col("q3") - F.col("q1")), slack)
    f = q.withColumns({"lo": F.when(F.col("rate").isin(*TWO_SIDED), F.col("q1") - wide), "hi": F.col("q3") + wide})
    ends = [(m, e) for m in SLACK for e in ("lo", "hi") if e == "hi" or m in TWO_SIDED]
    return f.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rate") == m, F.col(e))).alias(f"{m}_{e}") for m, e in ends])


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def verdicts(rated: DataFrame, limits: DataFrame) -> DataFrame:
    """rated with base_failed and kept. The fences are small, one row a group: Spark broadcasts them if they are under its threshold, and otherwise splits the hot groups of the join at run time."""
    inside = " AND ".join([f"d.{m} <= f.{m}_hi" for m in SLACK] + [f"d.{m} >= f.{m}_lo" for m in TWO_SIDED])
    j = rated.alias("d").join(limits.alias("f"), F.expr("d.lang <=> f.lang AND d.source <=> f.source"), "left")
    return j.select("d.*", F.expr(BASE_FAILED).alias("base_failed"), F.expr(f"NOT ({BASE_FAILED}) AND coalesce({inside}, false)").alias("kept"))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id with its counts, base_failed and kept, for each row of docs."""
    spark = docs.sparkSession
    rated = written(rates(text_counts(docs, ["doc_id", "lang", "source"])), scratch(spark))
    return verdicts(rated, fences(sketches(rated)))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns.

    docs is read twice. The first scan writes counts alone; the rows that fail are told by doc_id, lang, source and 96 bits of the text, on which the verdict depends, and
    taken out in the second. So no copy of the texts stays on disk while later stages read the result.
    """
    place = scratch(docs.sparkSession)
    cols = docs.columns
    key = {"_id": F.col("doc_id"), "lang": F.col("lang"), "source": F.col("source"), "_h1": F.xxhash64("text"), "_h2": F.hash("text")}
    named = [v.alias(k) for k, v in key.items()]
    rated = written(rates(text_counts(docs.select("text", *named), list(key))), f"{place}/rated")
    gone = written(verdicts(rated, fences(sketches(rated))).where("NOT kept").select(*key), f"{place}/gone")
    discard(docs.sparkSession, f"{place}/rated")
    # the columns travel in a struct: their names can't clash with those of the key
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), *named)
    out = packed.alias("d").join(gone.alias("g").hint("merge"), F.expr(" AND ".join(f"d.{k} <=> g.{k}" for k in key)), "left_anti")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in cols])


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents")).select(*COLUMNS)


def _sql() -> str:
    bucket = "(v >> greatest(0, length(bin(v)) - 6)) << greatest(0, length(bin(v)) - 6)"
    per = lambda a, b, k: f"CASE WHEN n_words > 0 THEN {a} * {k} // greatest({b}, 1) END"
    slack = "CASE rate " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in SLACK.items()) + " END"
    inside = " AND ".join([f"d.{m} <= f.{m}_hi" for m in SLACK] + [f"d.{m} >= f.{m}_lo" for m in TWO_SIDED])
    ends = [f"{m}_{e}" for m in SLACK for e in ("lo", "hi") if e == "hi" or m in TWO_SIDED]
    return f"""
WITH txt AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS p FROM txt WHERE len(w) > 3)),
rep AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win),
cov AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, p + unnest([0, 1, 2]) AS q FROM rep WHERE c > 1) GROUP BY doc_id),
counts AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
  (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper, coalesce(n, 0)::BIGINT AS n_repeat_words FROM txt LEFT JOIN cov USING (doc_id)),
rated AS (SELECT *, {per("n_symbols", "n_words", 1000)} AS sym, {per("n_repeat_words", "n_words", 1000)} AS rep, {per("n_dup_lines", "n_lines", 1000)} AS dup,
  {per("n_upper", "word_chars", 1000)} AS upp, {per("word_chars", "n_words", 100)} AS len FROM counts),
vals AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS rate, {m} AS v FROM rated WHERE n_words > 0" for m in SLACK)}),
lev AS (SELECT 0 AS level, lang, source, rate, v FROM vals UNION ALL SELECT 1, lang, NULL, rate, v FROM vals UNION ALL SELECT 2, NULL, NULL, rate, v FROM vals),
sk AS (SELECT level, lang, source, rate, {bucket} AS bucket, count(*) AS n FROM lev GROUP BY ALL),
g AS (SELECT a.lang, a.source, rate, c.bucket, c.n::HUGEINT AS n2 FROM (SELECT DISTINCT lang, source, rate FROM sk WHERE level = 0) a JOIN (SELECT * FROM sk WHERE level = 2) c USING (rate)),
j AS (SELECT g.*, coalesce(o.n, 0)::HUGEINT AS n0, coalesce(l.n, 0)::HUGEINT AS n1 FROM g
  LEFT JOIN (SELECT * FROM sk WHERE level = 0) o ON g.lang IS NOT DISTINCT FROM o.lang AND g.source IS NOT DISTINCT FROM o.source AND g.rate = o.rate AND g.bucket = o.bucket
  LEFT JOIN (SELECT * FROM sk WHERE level = 1) l ON g.lang IS NOT DISTINCT FROM l.lang AND g.rate = l.rate AND g.bucket = l.bucket),
t AS (SELECT *, sum(n1) OVER (PARTITION BY lang, source, rate) AS t1, sum(n2) OVER (PARTITION BY lang, source, rate) AS t2 FROM j),
w AS (SELECT lang, source, rate, bucket, n0 * t2::HUGEINT * (t1::HUGEINT + {PRIOR}) + {PRIOR} * (n1 * t2::HUGEINT + {PRIOR} * n2) AS weight FROM t),
ranked AS (SELECT *, sum(weight) OVER (PARTITION BY lang, source, rate ORDER BY bucket) AS upto, sum(weight) OVER (PARTITION BY lang, source, rate) AS total FROM w),
q AS (SELECT lang, source, rate, min(CASE WHEN 4 * upto >= total THEN bucket END) AS q1, min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS q3 FROM ranked GROUP BY ALL),
f AS (SELECT *, CASE WHEN rate = 'len' THEN q1 - greatest({REACH} * (q3 - q1), {slack}) END AS lo, q3 + greatest({REACH} * (q3 - q1), {slack}) AS hi FROM q),
lim AS (SELECT lang, source, {", ".join(f"max(CASE WHEN rate = '{e[:-3]}' THEN {e[-2:]} END) AS {e}" for e in ends)} FROM f GROUP BY ALL)
SELECT d.doc_id, d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, ({BASE_FAILED}) AS base_failed, NOT ({BASE_FAILED}) AND coalesce({inside}, false) AS kept
FROM rated d LEFT JOIN lim f ON d.lang IS NOT DISTINCT FROM f.lang AND d.source IS NOT DISTINCT FROM f.source"""


SQL = _sql()
