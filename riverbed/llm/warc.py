"""WARC archives: written with revisits for equal payloads, read back by boundary-chain verification.

Writing: pages with equal payloads of at least LEAST bytes are found by digest, an aggregate with map-side combining; that with the largest page_id is the response, the others are revisits without payload. Each task writes one
archive of gzip members, one per record, under a name of its own, and returns its place and size, so that files of lost or repeated tasks are never read.

Reading: archives are cut into splits. A task looks for the magic bytes of a record in its split, opens each candidate, and emits its offset and its successor's; magic inside payloads makes
candidates too. In a split these pointers form a forest, since each candidate has one successor. The task numbers it so that ancestry is a test on two numbers, and gives each candidate the first offset at which
its chain leaves the split. Pointer jumping over these exits, doubled each round, finds from the file's start the offset at which the true chain enters each split; only candidates on the
path from there are records. The rounds grow with the logarithm of the splits of a file.

Edge cases: null html is an empty payload; null urls have no target header. Short payloads are always responses. Repeated rows with the largest page_id are all responses. A null page_id is kept as null
and yields to any other id. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.llm.common import scratch, table, written

LEAST = 1000
#: Repeated payloads whose winners are broadcast, at about 100 bytes each; beyond that pages are joined by shuffle, those of one digest over SALTS tasks.
BROADCAST_ROWS = 200_000
SALTS = 64
#: Bytes of an archive that one task searches for records.
SPLIT = 16 << 20
MAGIC = b"\x1f\x8b\x08"
#: Bytes asked for at a time when a record goes on behind its split.
AHEAD = 1 << 18


def _record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page)}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {name(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _packer(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        path, size, out = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for page, url, html, digest, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "winner")), strict=True):
                page, refers = page.as_py(), refers.as_py()
                revisit = refers is not None and refers != page
                raw = _record(page, url.as_py(), (html.as_py() or "").encode(), digest.as_py(), refers, revisit)
                press = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = press.compress(raw) + press.flush()
                out = out or files.open_output_stream(path, compression=None)
                out.write(data)
                size += len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size])], ["path", "size"])

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """path, size of the archives written below folder, a URI that all workers can open. pages: page_id, url, html."""
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit(""))
    sized = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload.cast("binary")).alias("digest"),
        (F.octet_length(payload) >= LEAST).alias("_long")
    )
    winners = sized.where("_long").groupBy("digest").agg(
        F.max("page_id").alias("winner"), F.count("*").alias("_n")
    ).where("_n > 1").select("digest", "winner")
    winners = written(winners, scratch(spark))
    if winners.count() <= BROADCAST_ROWS:
        # archives are written where pages are read, no page is moved; short ones look for a digest that is never there
        both = sized.withColumn("_key", F.when(F.col("_long"), F.col("digest"))).join(
            F.broadcast(winners.withColumnRenamed("digest", "_key")), "_key", "left"
        )
    else:
        # pages of one digest are dealt over SALTS tasks, and its winner goes to each of these
        salted = winners.select("digest", "winner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        dealt = sized.where("_long").withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        both = dealt.join(salted, ["digest", "_salt"], "left").unionByName(sized.where("NOT _long"), allowMissingColumns=True)
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    return both.select("page_id", "url", "html", "digest", "winner").mapInArrow(_packer(folder), "path string, size long")


class _Ahead:
    """Bytes of a file from `start` on, read as they are asked for."""

    def __init__(self, handle, start: int, size: int):
        self.handle, self.start, self.size, self.data = handle, start, size, bytearray()

    def upto(self, stop: int) -> None:
        stop = min(stop, self.size)
        if (n := stop - self.start - len(self.data)) > 0:
            self.handle.seek(self.start + len(self.data))
            self.data += self.handle.read(max(n, min(AHEAD, self.size - self.start - len(self.data))))

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The gzip member at an offset and its end, if it is whole and holds a record."""
        z, parts, n, pos = zlib.decompressobj(31), [], 0, at
        while not z.eof:
            self.upto(pos + 65536)
            chunk = bytes(self.data[pos - self.start : pos - self.start + 65536])
            if not chunk:
                return None
            try:
                parts.append(z.decompress(chunk))
            except zlib.error:
                return None
            n += len(parts[-1])
            if n >= 7 and not b"".join(parts[:2]).startswith(b"WARC/1."):
                return None
            pos += len(chunk) - len(z.unused_data)
        return b"".join(parts), pos


def _fields(raw: bytes) -> dict | None:
    """What a record says and holds; None if its length does not agree with its header."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        return None
    h = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    try:
        length = int(h["Content-Length"])
        if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
            return None
        number = lambda s: int(s[10:-1]) if s[10:-1] else None
        out = {"page_id": number(h["WARC-Record-ID"]), "record_type": h["WARC-Type"]}
        if out["record_type"] == "revisit":
            return out | {
                "payload_bytes": int(h["WARC-Payload-Length"]), "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"),
                "refers_to": number(h["WARC-Refers-To"]), "payload": None
            }
        payload = rest[:length].partition(b"\r\n\r\n")[2]
        return out | {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "refers_to": None, "payload": payload}
    except (KeyError, ValueError):
        return None


def forest(following: dict[int, int], stop: int) -> dict[int, tuple[int, int, int]]:
    """For each offset (exit, number, weight). The chain from a leaves [.., stop) at its exit, -1 if it breaks off; it passes through b if number[b] <= number[a] < number[b] + weight[b]."""
    order = sorted(following)
    weight = dict.fromkeys(order, 1)
    for a in order:
        if (b := following[a]) in weight:
            weight[b] += weight[a]
    leaves, number, taken, roots = {}, {}, {}, 0
    for a in reversed(order):
        b = following[a]
        if b in weight:
            leaves[a], number[a] = leaves[b], taken[b]
            taken[b] += weight[a]
        else:
            leaves[a], number[a] = (b if b >= stop else -1), roots
            roots += weight[a]
        taken[a] = number[a] + 1
    return {a: (leaves[a], number[a], weight[a]) for a in order}


COLUMNS = "path string, split long, off long, leave long, num long, weight long, size long, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def _searcher(folder: str, with_payload: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema(
            [
                (c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in COLUMNS.split(", ")
            ] + [("payload", pa.binary())] * with_payload
        )
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start")), strict=True):
                stop, found = min(size, start + SPLIT), {}
                with files.open_input_file(path) as handle:
                    ahead = _Ahead(handle, start, size)
                    ahead.upto(stop + len(MAGIC) - 1)
                    at = ahead.data.find(MAGIC)
                    while 0 <= at < stop - start:
                        if (m := ahead.member(start + at)) and (f := _fields(m[0])):
                            if not with_payload:
                                f.pop("payload")
                            found[start + at] = (m[1], f)
                        at = ahead.data.find(MAGIC, at + 1)
                marks = forest({a: n for a, (n, _) in found.items()}, stop)
                rows = [
                    {"path": path, "split": start, "off": a, "leave": marks[a][0], "num": marks[a][1], "weight": marks[a][2], "size": size} | f for a,
                    (_, f) in found.items()
                ]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of archives (path, size): page_id, payload_bytes, payload_digest, record_type, refers_to, path, off, and the payload if asked for."""
    spark = archives.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    splits = archives.where("size > 0").select("path", "size", F.explode(F.expr(f"sequence(0L, size - 1, {SPLIT}L)")).alias("start")).repartition(n)
    found = written(splits.mapInArrow(_searcher(folder, with_payload), COLUMNS + ", payload binary" * with_payload), scratch(spark))
    jump = found.select("path", "off", F.when(F.col("leave") < F.col("size"), F.col("leave")).otherwise(-1).alias("to")).where("to >= 0")
    reached, known = found.where("off = 0").select("path", "off").distinct(), -1
    reached = written(reached, scratch(spark))
    while not jump.isEmpty() and (now := reached.count()) != known:
        known = now
        further = reached.join(jump, ["path", "off"]).select("path", F.col("to").alias("off"))
        reached = written(reached.unionByName(further).distinct(), scratch(spark))
        jump = written(
            jump.join(
                jump.select("path", F.col("off").alias("to"), F.col("to").alias("_to")), ["path", "to"]
            ).select("path", "off", F.col("_to").alias("to")),
            scratch(spark)
        )
    entry = reached.join(found.select("path", "off", "split", F.col("num").alias("_num")), ["path", "off"]).select("path", "split", "_num")
    kept = found.join(entry, ["path", "split"]).where("num <= _num AND _num < num + weight")
    return kept.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "path", "off", *(["payload"] if with_payload else [])
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = scratch(spark)
    archives = written(write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{place}/warc"), f"{place}/list")
    return read_archives(archives, f"{place}/warc").drop("path", "off")


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, CASE WHEN payload_bytes >= {LEAST} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS winner FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM winner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM winner THEN winner END AS refers_to FROM w"""
