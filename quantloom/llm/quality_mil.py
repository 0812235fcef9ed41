"""Quality classifier: attention-based multiple-instance learning over the passages of a text.

A text is a bag of passages of ``PASSAGE`` words. Each passage is described by shares of character classes, word
lengths, repetition inside the passage and n-grams already seen earlier in the text; an encoder e = tanh(We x + be)
follows, gated attention a = softmax(w . (tanh(V e) * sigmoid(U e))) weighs the passages of a document, and the
weighted representation z = sum a e is scored by sigmoid(c . z + d). Only document labels train all of it.

Every passage of every text is encoded and scored. Training uses a bounded sample: at most ``SAMPLE`` documents of each
label (the smallest hashes of the ids), each with all of its passages. It runs on the driver
and is deterministic. A document with several labels has their mean, 0.5 or more being 1.

Edge cases: null or empty text is one passage of zeros; labels that are null, or of unknown ids, are ignored; without
labelled documents of both kinds every score is the share of label 1, or 0.5; rows repeating an id are scored each, and
the smallest of their texts is learnt; a very long text is one bag, in a batch of its own, in work arrays of some 36
times its bytes; an empty table gives no row. Extra columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

PASSAGE = 64
SAMPLE = 3000
ENCODED, GATE, EPOCHS, RATE = 24, 12, 40, 0.01

#: Bytes of each class whose share of a passage is a feature.
_CLASSES = (
    bytes(range(65, 91)),
    bytes(range(48, 58)),
    b".,;:'\"()-",
    b"!?",
    b"|",
    b"#$%&*@^~=+<>\\/_{}[]`",
    bytes(range(128, 256)),
    b"\n",
)
_TABLE = np.zeros(256, np.uint8)
for _k, _bytes in enumerate(_CLASSES):
    _TABLE[list(_bytes)] = _k + 1
FEATURES = len(_CLASSES) + 9


def passage_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(passages x FEATURES, index of each document's first passage and one more); every document has a passage."""
    data, offsets = c.text_buffer(column)
    starts, ends, first = c.word_spans(data, offsets)
    words = c.hash_spans(data, starts, ends)
    counts = np.diff(first)
    each = np.maximum(-(-counts // PASSAGE), 1)
    bags = np.concatenate(([0], np.cumsum(each)))
    out = np.zeros((bags[-1], FEATURES))
    if not len(words):
        return out, bags
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - first[doc]
    passage = bags[doc] + place // PASSAGE
    n = np.bincount(passage, minlength=len(out)).astype(float)
    used = np.flatnonzero(n)
    lead = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
    tail = np.concatenate((lead[1:], [len(words)])) - 1
    begin, end = starts[lead], ends[tail]
    size = np.maximum(end - begin, 1).astype(float)
    kind = _TABLE[data]
    for k in range(len(_CLASSES)):
        upto = np.concatenate(([0], np.cumsum(kind == k + 1, dtype=np.int64)))
        out[used, k] = (upto[end] - upto[begin]) / size
    mean = lambda x: np.bincount(passage, x, len(out))[used] / n[used]
    length = (ends - starts).astype(float)
    out[used, 8] = mean(length) / 10
    out[used, 9] = np.sqrt(np.maximum(mean(length**2) - mean(length) ** 2, 0)) / 10
    again = np.zeros(len(words))
    again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    out[used, 10] = mean(again)
    # Words and 3-grams whose first place in the document, or passage, is earlier.
    salt = c.mix(doc.astype(np.uint64) + np.uint64(1))
    out[used, 11] = 1 - mean(_first_of(words ^ c.mix(passage.astype(np.uint64) + np.uint64(7))))
    grams = words.copy()
    grams[:-1] += words[1:] * np.uint64(0x9E3779B97F4A7C15)
    grams[:-2] += words[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
    seen = 1 - _first_of(c.mix(grams) ^ salt)
    out[used, 12] = mean(seen)
    whole = 1 - _first_of(words ^ salt)
    out[used, 13] = mean(whole)
    out[used, 14] = np.log1p(n[used]) / 5
    out[used, 15] = mean(length > 20)
    out[used, 16] = mean(length == 1)
    return out, bags


def _first_of(keys: np.ndarray) -> np.ndarray:
    """1.0 where a key occurs for the first time."""
    order = np.argsort(keys, kind="stable")
    out = np.ones(len(keys))
    out[order[1:]] = keys[order[1:]] != keys[order[:-1]]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _bag_sum(x: np.ndarray, bags: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, bags[:-1], axis=0)


def forward(model: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Scores of the bags, and what the backward pass needs."""
    e = np.tanh(((x - model["mean"]) / model["scale"]) @ model["We"] + model["be"])
    t, g = np.tanh(e @ model["V"]), _sigmoid(e @ model["U"])
    s = (t * g) @ model["w"]
    doc = np.repeat(np.arange(len(bags) - 1), np.diff(bags))
    s = np.exp(s - np.maximum.reduceat(s, bags[:-1])[doc])
    a = s / _bag_sum(s, bags)[doc]
    z = _bag_sum(a[:, None] * e, bags)
    return _sigmoid(z @ model["c"] + model["d"][0]), (e, t, g, a, z, doc)


def gradient(model: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted mean log loss by each learnt parameter."""
    p, (e, t, g, a, z, doc) = forward(model, x, bags)
    dl = (p - y) * weight / len(y)
    dz = dl[:, None] * model["c"]
    # z is a weighted mean, so a score moves it by a (e - z).
    ds = a * ((e - z[doc]) * dz[doc]).sum(1)
    dt, dg = ds[:, None] * model["w"] * g * (1 - t * t), ds[:, None] * model["w"] * t * g * (1 - g)
    de = (a[:, None] * dz[doc] + dt @ model["V"].T + dg @ model["U"].T) * (1 - e * e)
    return {"We": ((x - model["mean"]) / model["scale"]).T @ de, "be": de.sum(0), "V": e.T @ dt, "U": e.T @ dg, "w": (t * g).T @ ds, "c": z.T @ dl, "d": np.array([dl.sum()])}


def train(x: np.ndarray, bags: np.ndarray, y: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam on the balanced log loss; bags are visited in a seeded order."""
    rng = np.random.default_rng(seed)
    model = {"mean": x.mean(0), "scale": x.std(0) + 1e-3}
    init = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    learnt = {"We": init(FEATURES, ENCODED), "be": np.zeros(ENCODED), "V": init(ENCODED, GATE), "U": init(ENCODED, GATE), "w": init(GATE), "c": init(ENCODED), "d": np.zeros(1)}
    m1, m2, step = ({k: np.zeros_like(v) for k, v in learnt.items()} for _ in range(2)), None, 0
    m1, m2 = list(m1)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    rows = [np.arange(a, b) for a, b in zip(bags[:-1], bags[1:], strict=True)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 128):
            pick = order[at : at + 128]
            own = np.concatenate(([0], np.cumsum([len(rows[k]) for k in pick])))
            xs = x[np.concatenate([rows[k] for k in pick])]
            grad = gradient(model | learnt, xs, own, y[pick], weight[pick])
            step += 1
            for k, v in grad.items():
                v = v + 1e-4 * learnt[k]
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                learnt[k] = learnt[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model | learnt


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model from (doc_id, quality) of documents outside the held-out third (crc32(doc_id) mod 3 = 1)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    known = known.where(~c.is_remainder(F.col("doc_id"), 3, 1))
    present = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = present.where("y = 1").orderBy(*order).limit(SAMPLE).union(present.where("y = 0").orderBy(*order).limit(SAMPLE))
    # Of rows repeating an id the smallest text, so that reruns learn the same.
    bags = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.pieces(batches, "text"):
            x, at = passage_features(c.column_of(batch, "text"))
            parts = [x[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([c.column_of(batch, "doc_id"), c.column_of(batch, "y"), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], ["doc_id", "y", "x"])

    rows = bags.mapInArrow(encode, bags.select("doc_id", "y").withColumn("x", F.lit(b"")).schema).toArrow().sort_by("doc_id")
    y = rows.column("y").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.5}
    parts = [np.frombuffer(x, np.float32).reshape(-1, FEATURES).astype(float) for x in rows.column("x").to_pylist()]
    return train(np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))), y)


def bag_scores(model: dict, column: pa.Array) -> np.ndarray:
    if "constant" in model:
        return np.full(len(column), model["constant"])
    x, bags = passage_features(column)
    return forward(model, x, bags)[0]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.pieces(batches, "text", 4 << 20):
            p = bag_scores(shared.value, c.column_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([c.column_of(batch, "doc_id"), pa.array(p)], ["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    scored = rows.mapInArrow(run, rows.select("doc_id").withColumn("score", F.lit(0.0)).schema)
    return scored.select("doc_id", c.is_remainder(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns and whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.pieces(batches, "text", 4 << 20):
            yield batch.filter(pa.array(bag_scores(shared.value, c.column_of(batch, "text")) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
