"""Secret scan with multipart credential linking.

Every kind of part is matched leftmost and non-overlapping over the whole text with JVM regular expressions: `split` gives the gaps between matches and
`regexp_extract_all` the matches, and a running sum of their lengths gives positions in code points. Base parts are reported as they are.
Weak parts (opaque tokens, short assigned values, account names) are reported only when a complementary part that does not overlap them starts within SCOPE
code points in the same text; opaque tokens that overlap an address or an account name are pieces of those and no parts. The interval join behind that
puts parts into cells of SCOPE code points and joins each weak part to the parts of the role it asks for in its own cell and the two beside it. Parts of a kind
don't overlap and have a least length, so that a cell holds a bounded number of them, however many a text holds.

Edge cases: a null text is empty and has no spans. Repeated rows, repeated and null ids are judged row by row, because rows carry a key of their own. An empty table gives
an empty result. A span that overlaps a base span is never reported as weak. Other columns are kept by `redact` and ignored by `secret_spans`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.llm.common import scratch, table, written

#: Code points between the starts of parts that belong together.
SCOPE = 200
MARK = "[SECRET]"
ASSIGN, ACCESS, HEX, KEY, SHORT, IDENT, ENDPOINT = "assign", "access", "hex", "key", "short", "ident", "endpoint"
#: In the order in which spans with the same start are listed.
KINDS = (ASSIGN, ACCESS, HEX, KEY, SHORT, IDENT, ENDPOINT)


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: Pattern and the group whose length counts. Runs of a class are maximal, so a least length inside the pattern drops the same matches as a later test.
PATTERNS = {
    ASSIGN: ("(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key") + ")" + _VALUE + "([A-Za-z0-9+/_.=-]+)", 2),
    ACCESS: ("AKIA[A-Z0-9]{12,}", 0),
    HEX: ("[0-9a-f]{32,}", 0),
    KEY: ("[A-Za-z0-9+/_=-]{20,}", 0),
    IDENT: ("(" + "|".join(map(_any_case, ("username", "user_id", "client_id", "account", "login"))) + ")" + _VALUE + "[A-Za-z0-9_.@-]{3,}", 0),
    ENDPOINT: ("[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\\x20\\x09-\\x0D\"'<>]+", 0),
}
#: A cheap test that a text must pass before a pattern with a costly start is tried.
HINTS = {ACCESS: "AKIA", ENDPOINT: "://"}


def _parts(text: Column, kind: str) -> Column:
    """array<struct<kind, ord, gap, len, value, mixed>>, one entry a match."""
    pattern, group = PATTERNS[kind]
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), group) if group else whole
    hit = F.regexp_like(text, F.lit(pattern))
    if kind in HINTS:
        hit = F.contains(text, F.lit(HINTS[kind])) & hit
    listed = F.transform(
        F.array(F.struct(whole.alias("m"), gaps.alias("g"), value.alias("v"))),
        lambda s: F.transform(
            s["m"],
            lambda m, i: F.struct(
                F.lit(kind).alias("kind"), i.alias("ord"), F.length(F.get(s["g"], i)).alias("gap"), F.length(m).alias("len"),
                F.length(F.get(s["v"], i)).alias("value"), (F.regexp_like(m, F.lit("[0-9]")) & F.regexp_like(m, F.lit("[A-Za-z]"))).alias("mixed")
            )
        )
    )
    return F.when(hit, F.element_at(listed, 1))


def with_parts(docs: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """A row for each row of docs: _rid, keep, and _parts (null if there are none)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<kind:string,ord:int,gap:int,len:int,value:int,mixed:boolean>>")
    every = F.flatten(F.array(*[F.coalesce(_parts(text, k), none) for k in PATTERNS]))
    out = docs.select(*[c.alias(n) for n, c in keep.items()], every.alias("_parts")).withColumn("_rid", F.monotonically_increasing_id())
    return out.withColumn("_parts", F.expr("CASE WHEN size(_parts) > 0 THEN _parts END"))


def reported(rows: DataFrame) -> DataFrame:
    """_rid, kind, k, start, stop of every span to report. rows: _rid and _parts, read from storage so that _rid is stable."""
    found = rows.where("_parts IS NOT NULL").select("_rid", F.inline("_parts"))
    placed = found.withColumn(
        "stop", F.expr("sum(gap + len) OVER (PARTITION BY _rid, kind ORDER BY ord)").cast("int")
    ).withColumn("start", F.col("stop") - F.col("len"))
    kind = f"CASE WHEN kind = '{ASSIGN}' AND value < 8 THEN '{SHORT}' ELSE kind END"
    placed = placed.where(
        f"NOT (kind = '{KEY}' AND NOT mixed) AND NOT (kind = '{ASSIGN}' AND value < 4)"
    ).select("_rid", F.expr(kind).alias("kind"), "start", "stop")
    base = f"kind IN ('{ASSIGN}', '{ACCESS}', '{HEX}')"
    held = f"kind IN ('{IDENT}', '{ENDPOINT}')"
    # one sweep tells what overlaps: spans that cover others enter at their start, every span is judged at its last code point by how far those before it reach
    enter = f"IF({base} OR {held}, array(struct(start AS at, 0 AS ask), struct(stop - 1 AS at, 1 AS ask)), array(struct(stop - 1 AS at, 1 AS ask)))"
    events = placed.selectExpr("_rid", "kind", "start", "stop", f"{base} AS base", f"{held} AS held", f"inline({enter})")
    reach = "max(CASE WHEN ask = 0 AND {0} THEN stop END) OVER (PARTITION BY _rid ORDER BY at, ask ROWS UNBOUNDED PRECEDING) AS _{0}"
    swept = events.selectExpr("*", reach.format("base"), reach.format("held")).where("ask = 1")
    # a weak part that overlaps a base part goes, and a key that is a piece of an address or a name
    free = swept.where(f"base OR NOT coalesce(_base > start, false) AND NOT (kind = '{KEY}' AND coalesce(_held > start, false))")
    free = free.select("_rid", "kind", "start", "stop", "base")
    role = f"CASE WHEN kind IN ('{ACCESS}', '{IDENT}') THEN 'who' WHEN kind = '{ENDPOINT}' THEN 'where' ELSE 'what' END"
    free = free.selectExpr("*", f"{role} AS role", f"start DIV {SCOPE} AS cell")
    cells = free.selectExpr("_rid", "cell AS _cell", "role AS _role", "start AS _start", "stop AS _stop").distinct()
    weak = free.where(f"NOT base AND kind <> '{ENDPOINT}'")
    # what is secret needs a name or a place beside it; a name needs something secret
    asks = F.expr(f"explode(CASE WHEN role = 'what' THEN array('who', 'where') ELSE array('what') END)")
    asked = weak.select("*", asks.alias("_role")).select(
        "*", F.explode(F.array(*[(F.col("cell") + d).cast("bigint") for d in (-1, 0, 1)])).alias("_cell")
    )
    near = f"_start BETWEEN start - {SCOPE} AND start + {SCOPE} AND (_stop <= start OR _start >= stop)"
    linked = asked.join(cells, ["_rid", "_cell", "_role"]).where(near).select("_rid", "kind", "start", "stop").distinct()
    order = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    return free.where("base").select("_rid", "kind", "start", "stop").unionByName(linked).withColumn("k", F.expr(order))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for each row of docs."""
    rows = written(with_parts(docs, {"doc_id": F.col("doc_id")}), scratch(docs.sparkSession))
    listed = lambda cond: F.expr(
        f"array_join(transform(sort_array(collect_list(CASE WHEN {cond} THEN struct(start, k, concat_ws(':', kind, start, stop) AS s) END)), x -> x.s), ',')"
    )
    per = reported(rows).groupBy("_rid").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in (ASSIGN, ACCESS, HEX)], listed("k < 3").alias("base"),
        listed("true").alias("spans")
    )
    out = rows.select("_rid", "doc_id").join(per, "_rid", "left")
    none = F.lit("")
    return out.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in (ASSIGN, ACCESS, HEX)],
        F.sha2(F.coalesce("base", none), 256).alias("base_sha256"), F.coalesce("spans", none).alias("spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every reported span replaced by MARK, overlapping spans by one, and n_chars to match where there is such a column. All rows and columns stay.

    Only rows with a part are joined, so only their texts are shuffled.
    """
    cols = docs.columns
    # the other columns travel in a struct: their names can't clash
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"))
    rows = written(with_parts(packed, {"_row": F.col("_row")}), scratch(docs.sparkSession))
    spans = reported(rows.select("_rid", "_parts")).selectExpr(
        "_rid", "start", "stop",
        "coalesce(max(stop) OVER (PARTITION BY _rid ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past"
    )
    cuts = spans.groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct("start", "past", "stop"))).alias("_cuts"))
    hit = rows.where("_parts IS NOT NULL").join(cuts, "_rid", "left")
    joined = f"concat(array_join(transform(_cuts, c -> CASE WHEN c.past > c.start THEN '' ELSE concat(substring(_row.text, c.past + 1, c.start - c.past), '{MARK}') END), ''), substring(_row.text, aggregate(_cuts, 0, (a, c) -> greatest(a, c.stop)) + 1))"
    text = F.expr(f"CASE WHEN _cuts IS NULL THEN _row.text ELSE {joined} END")
    both = hit.select("_row", text.alias("_text"), F.expr("_cuts IS NOT NULL").alias("_cut")).unionByName(
        rows.where("_parts IS NULL").select("_row", F.col("_row.text").alias("_text"), F.lit(False).alias("_cut"))
    )
    value = lambda c: F.col("_text") if c == "text" else F.when(
        F.col("_cut"), F.length("_text").cast(docs.schema[c].dataType)
    ).otherwise(F.col("_row")[c]) if c == "n_chars" else F.col("_row")[c]
    return both.select(*[value(c).alias(c) for c in cols])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, unnest(generate_series(1, len(m))) AS ord, unnest([length(x) FOR x IN g[:len(m)]]) AS gap, unnest([length(x) FOR x IN m]) AS len, unnest([length(x) FOR x IN v]) AS value, unnest([regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]') FOR x IN m]) AS mixed"
        f" FROM (SELECT doc_id, regexp_extract_all(t, {quoted(p)}) AS m, regexp_extract_all(t, {quoted(p)}, {n}) AS v, string_split_regex(t, {quoted(p)}) AS g FROM t)"
        for k, (p, n) in PATTERNS.items()
    )
    order = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
p AS (SELECT doc_id, kind, value, mixed, (sum(gap + len) OVER (PARTITION BY doc_id, kind ORDER BY ord))::BIGINT AS stop, len FROM f),
q AS (SELECT doc_id, CASE WHEN kind = 'assign' AND value < 8 THEN 'short' ELSE kind END AS kind, stop - len AS start, stop FROM p WHERE NOT (kind = 'key' AND NOT mixed) AND NOT (kind = 'assign' AND value < 4)),
b AS (SELECT * FROM q WHERE kind IN ('assign', 'access', 'hex')),
w AS (SELECT * FROM q WHERE kind NOT IN ('assign', 'access', 'hex') AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = q.doc_id AND b.start < q.stop AND b.stop > q.start)
  AND NOT (kind = 'key' AND EXISTS (SELECT 1 FROM q h WHERE h.doc_id = q.doc_id AND h.kind IN ('ident', 'endpoint') AND h.start < q.stop AND h.stop > q.start))),
r AS (SELECT *, CASE WHEN kind IN ('access', 'ident') THEN 'who' WHEN kind = 'endpoint' THEN 'where' ELSE 'what' END AS role FROM (SELECT * FROM b UNION ALL SELECT * FROM w)),
l AS (SELECT * FROM r WHERE kind IN ('assign', 'access', 'hex') OR kind <> 'endpoint' AND EXISTS (SELECT 1 FROM r o WHERE o.doc_id = r.doc_id AND abs(o.start - r.start) <= {SCOPE} AND (o.stop <= r.start OR o.start >= r.stop) AND (r.role = 'what' AND o.role <> 'what' OR r.role = 'who' AND o.role = 'what'))),
s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, {order}) FILTER (kind IN ('assign', 'access', 'hex')) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, {order}) AS spans FROM l GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN s USING (doc_id)"""


SQL = _sql()
