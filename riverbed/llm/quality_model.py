"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages, its lines. Each passage is described by FEATURES counts and shares of its bytes and words and encoded by a tanh layer; a gated attention (tanh times sigmoid) weighs the
passages; the weighted mean of their codes is scored. All weights are learned together from document labels alone, by gradient descent on the cross entropy.

Training uses at most TRAIN labelled documents, those with the least hash of their id among the rows whose crc32(doc_id as text) mod 5 is not 0; only their features reach the driver. Scoring
runs over all passages of all documents without a shuffle. Labels, lang, source and doc_id are never inputs.

Edge cases: a null or empty text is a bag of one empty passage and gets that bag's score. Of labelled rows with one doc_id, the text with the least hash is learned; of clashing labels, the larger. Repeated rows get equal scores. Without labels, or with labels of one class, all scores are the share of
label 1 (0.5 without labels). A null label is no label. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.llm.common import table
from riverbed.llm.shingles import BLOCK, mixed, powers, prefix

#: Most labelled documents that the model is fitted on.
TRAIN = 4000
CODE = 12
STEPS = 400
CUT = 0.3
FEATURES = 12
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_CLASS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "symbol": b"#*$%&<>", "bar": b"|",
    "bang": b"!", "stop": b".,;:?"
}
_TABLES = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _CLASS.items()} | {"wide": np.arange(256) >= 128}


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line that has a word, and where each text's lines begin (one more entry than texts). A text without words is one passage of zeros."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    line_end = np.flatnonzero(data == 10) + 1
    line_start = np.concatenate(([0], line_end[:-1]))
    space = _SPACE[data]
    text_start = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    count = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)[line_end - 1])))
    solid = count(~space)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    sums = prefix(data)
    _, down = powers(len(data) + 1)
    h = mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
    at = np.searchsorted(start, np.concatenate((line_start, [len(data)])))
    n = np.diff(at)
    per_word = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[at])
    line = np.repeat(np.arange(len(n)), n)
    again = np.zeros(len(h), bool)
    for k in (1, 2, 3, 4):
        again[k:] |= (h[k:] == h[:-k]) & (line[k:] == line[:-k])
    doc = np.searchsorted(text_start, line_start, side="right") - 1
    whole = mixed((sums[line_end - 1] - sums[line_start]) * down[line_start] + (line_end - line_start).astype(np.uint64))
    key = whole + mixed(doc.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    copy = np.zeros(len(key), bool)
    copy[order[1:]] = key[order[1:]] == key[order[:-1]]
    w, c = np.maximum(n, 1), np.maximum(solid, 1)
    x = np.stack(
        [
            np.log1p(n) / 5, solid / w / 10, *[count(_TABLES[k][data]) / c for k in ("upper", "digit", "wide", "stop")],
            *[np.minimum(count(_TABLES[k][data]) / w, 4) for k in ("symbol", "bar", "bang")], per_word(again) / w, copy.astype(float),
            count(_TABLES["lower"][data]) / c
        ],
        1
    )
    full = solid > 0
    x, doc = x[full], doc[full]
    lack = np.setdiff1d(np.arange(len(texts)), doc)
    if len(lack):
        x, doc = np.concatenate((x, np.zeros((len(lack), FEATURES)))), np.concatenate((doc, lack))
        order = np.argsort(doc, kind="stable")
        x, doc = x[order], doc[order]
    return x, np.searchsorted(doc, np.arange(len(texts) + 1))


def forward(m: dict, x: np.ndarray, at: np.ndarray) -> dict:
    """Scores of bags and what the gradient needs."""
    first, size = at[:-1], np.diff(at)
    code = np.tanh((x - m["mean"]) / m["sd"] @ m["We"] + m["be"])
    t, g = np.tanh(code @ m["V"]), 1 / (1 + np.exp(-(code @ m["U"])))
    s = (t * g) @ m["w"]
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, first), size))
    a = e / np.repeat(np.add.reduceat(e, first), size)
    z = np.add.reduceat(a[:, None] * code, first)
    return {"code": code, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-(z @ m["c"] + m["b"])))}


def fitted(x: np.ndarray, at: np.ndarray, y: np.ndarray, seed: int = 7) -> dict:
    """A model for bags x[at[i]:at[i + 1]] with labels y. Adam on the cross entropy with a small decay."""
    rng = np.random.default_rng(seed)
    m = {
        "mean": x.mean(0), "sd": x.std(0) + 1e-3, "We": rng.normal(0, 0.3, (x.shape[1], CODE)), "be": np.zeros(CODE),
        "V": rng.normal(0, 0.3, (CODE, CODE)), "U": rng.normal(0, 0.3, (CODE, CODE)), "w": rng.normal(0, 0.3, CODE), "c": rng.normal(0, 0.3, CODE),
        "b": np.zeros(())
    }
    names, size, xs = ["We", "be", "V", "U", "w", "c", "b"], np.diff(at), (x - m["mean"]) / m["sd"]
    first = {k: np.zeros_like(m[k]) for k in names}
    second = {k: np.zeros_like(m[k]) for k in names}
    for step in range(1, STEPS + 1):
        f = forward(m, x, at)
        dz = (f["p"] - y) / len(y)
        grad = {"c": f["z"].T @ dz, "b": dz.sum()}
        each = np.repeat(dz, size)[:, None] * m["c"]
        da = (each * f["code"]).sum(1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, at[:-1]), size))
        grad["w"] = (f["t"] * f["g"]).T @ ds
        dt = ds[:, None] * m["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = ds[:, None] * m["w"] * f["t"] * f["g"] * (1 - f["g"])
        grad["V"], grad["U"] = f["code"].T @ dt, f["code"].T @ dg
        dh = (each * f["a"][:, None] + dt @ m["V"].T + dg @ m["U"].T) * (1 - f["code"] ** 2)
        grad["We"], grad["be"] = xs.T @ dh, dh.sum(0)
        for k in names:
            d = grad[k] + 1e-4 * m[k]
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            m[k] = m[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def _lists(pdf: pd.DataFrame) -> Iterator[tuple[int, list[bytes]]]:
    out, n, begin = [], 0, 0
    for i, t in enumerate(pdf["text"]):
        b = (t or "").encode("utf-8", "surrogatepass")
        if out and n + len(b) > BLOCK:
            yield begin, out
            out, n, begin = [], 0, i
        out.append(b)
        n += len(b) + 1
    if out:
        yield begin, out


def _described(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for begin, texts in _lists(pdf):
            x, at = passages(texts)
            yield pd.DataFrame(
                {
                    "quality": pdf["quality"].to_numpy()[begin : begin + len(texts)],
                    "x": [x[a:b].ravel() for a, b in zip(at[:-1], at[1:], strict=True)]
                }
            )


def _scored(model: dict):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for begin, texts in _lists(pdf):
                x, at = passages(texts)
                p = forward(model, x, at)["p"] if "We" in model else np.full(len(texts), model["p"])
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[begin : begin + len(texts)].to_numpy(), "score": p})

    return run


#: True for rows that no model may learn from.
HELD_OUT = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0"


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model of at most TRAIN labelled documents."""
    chosen = labels.where(
        "doc_id IS NOT NULL AND quality IN (0, 1)"
    ).where(f"NOT ({HELD_OUT})").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN)
    # at most TRAIN rows of two numbers: small whatever the input
    bags = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(
        F.min_by("text", F.xxhash64("text")).alias("text")
    ).orderBy("doc_id").select(
        "text", F.col("quality").cast("int").alias("quality")
    ).mapInPandas(_described, "quality int, x array<double>").toPandas()
    y = bags["quality"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return {"p": float(y.mean()) if len(y) else 0.5}
    x = np.concatenate(bags["x"].tolist()).reshape(-1, FEATURES)
    at = np.concatenate(([0], np.cumsum([len(v) // FEATURES for v in bags["x"]])))
    return fitted(x, at, y)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_scored(train(docs, labels)), "doc_id long, score double")
    return out.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", F.expr(f"CAST(score >= {CUT} AS int)").alias("predicted"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
