"""Operator 6: attention-based multiple-instance quality classifier.

A document is a bag of passages. Each passage is encoded from its characters and words; a gated attention layer learns from
document labels alone how much each passage weighs; the weighted passage representation is scored. The model is fitted with
numpy on a bounded sample of labelled documents, then sent to tasks that score every passage of every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import SLICE, mix, shingle_hashes, span_hashes, text_chunks, word_spans

#: Labelled documents that the model is fitted on, at most, and passages of each (spread over the text); words of a passage.
SAMPLE, SAMPLE_PASSAGES, PASSAGE = 2000, 200, 64
HIDDEN, GATE, EPOCHS, RATE, DECAY = 16, 8, 150, 0.03, 1e-4
THRESHOLD = 0.7

#: Character classes: each mark its own, then letters, digits, white space, other ASCII and the rest.
_MARKS = "#*$%&|<>!?.,;:'\"-_/()[]{}@=+~^\\"
_CLASS = np.full(256, len(_MARKS) + 5, np.int64)
_CLASS[:128] = len(_MARKS) + 4
for _i, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = _i
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = len(_MARKS), len(_MARKS) + 1, len(_MARKS) + 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = len(_MARKS) + 3
_CLASSES = len(_MARKS) + 6
WIDTH = _CLASSES + 7


def encode(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the index of each document's first passage; a text without words has one empty passage."""
    start, end, first = word_spans(data, ends)
    n_words = np.diff(first)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    base = np.append(0, np.cumsum(n_passages))
    out = np.zeros((base[-1], WIDTH))
    if not base[-1]:
        return out, base
    doc = np.repeat(np.arange(ends.size), n_words)
    place = np.arange(start.size) - first[doc]
    passage = base[doc] + place // PASSAGE
    size = np.bincount(passage, minlength=base[-1])
    # A passage has the bytes from its first word on, a document's first one from the document's start: no document
    # counts its neighbour's.
    begin = np.empty(base[-1] + 1, np.int64)
    begin[passage[::-1]] = start[::-1]
    begin[base[:-1]] = np.append(0, ends[:-1])
    begin[-1] = data.size
    grid = np.zeros(base[-1] * _CLASSES)
    lo = 0
    while lo < base[-1]:
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + SLICE, "right")) - 1)
        for at in range(begin[lo], begin[hi], SLICE):  # more than one only where a single passage is longer
            to = min(at + SLICE, begin[hi])
            owner = np.repeat(np.arange(lo, hi), np.diff(np.clip(begin[lo : hi + 1], at, to)))
            grid[lo * _CLASSES : hi * _CLASSES] += np.bincount((owner - lo) * _CLASSES + _CLASS[data[at:to]], minlength=(hi - lo) * _CLASSES)
        lo = hi
    grid = grid.reshape(-1, _CLASSES)
    chars = np.maximum(1, grid.sum(1))
    out[:, :_CLASSES] = np.sqrt(grid / chars[:, None])
    if not start.size:
        return out, base
    word = span_hashes(data, start, end)
    length = (end - start).astype(float)
    upper = np.append(0, np.cumsum((data >= 65) & (data <= 90), dtype=np.int32))
    shout = (upper[end] - upper[start]) * 2 > length
    stutter = np.append(False, (word[1:] == word[:-1]) & (doc[1:] == doc[:-1]))
    in_doc = word ^ mix(doc.astype(np.uint64) + np.uint64(1))
    run = shingle_hashes(in_doc, 5)
    repeated = np.zeros(start.size, bool)
    again = np.zeros(start.size, bool)
    for keys, flags in ((run, repeated), (mix(in_doc), again)):
        by = np.argsort(keys, kind="stable")
        same = keys[by][1:] == keys[by][:-1]
        flags[by[1:][same]] = True
        if flags is repeated:
            flags[by[:-1][same]] = True
    mean = lambda x: np.bincount(passage, x, base[-1]) / np.maximum(1, size)
    average = mean(length)
    extra = (average / 10, np.sqrt(np.maximum(0, mean(length * length) - average**2)) / 10, mean(shout), mean(stutter), mean(repeated), mean(again), np.minimum(size, PASSAGE) / PASSAGE)
    out[:, _CLASSES:] = np.stack(extra, 1)
    return out, base


def forward(model: dict, x: np.ndarray, base: np.ndarray) -> dict:
    """Gated attention over the passages of each document: weights, representation and score."""
    first, bag = base[:-1], np.repeat(np.arange(base.size - 1), np.diff(base))
    h = np.tanh(((x - model["mean"]) / model["scale"]) @ model["W"] + model["b"])
    t, g = np.tanh(h @ model["V"]), 1 / (1 + np.exp(-(h @ model["U"])))
    e = (t * g) @ model["w"]
    a = np.exp(e - np.maximum.reduceat(e, first)[bag])
    a /= np.add.reduceat(a, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "score": 1 / (1 + np.exp(-(z @ model["c"] + model["d"])))}


def gradients(model: dict, x: np.ndarray, base: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean log loss of document scores, by backpropagation."""
    inputs = (x - model["mean"]) / model["scale"]
    f = forward(model, x, base)
    bag, h, t, g, a = f["bag"], f["h"], f["t"], f["g"], f["a"]
    ds = (f["score"] - y) / y.size
    dz = ds[:, None] * model["c"]
    da = (dz[bag] * h).sum(1)
    de = a * (da - np.add.reduceat(a * da, base[:-1])[bag])
    dt, dg = de[:, None] * model["w"] * g * (1 - t * t), de[:, None] * model["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ model["V"].T + dg @ model["U"].T) * (1 - h * h)
    return {"W": inputs.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": de @ (t * g), "c": f["z"].T @ ds, "d": ds.sum()}


def fit(x: np.ndarray, base: np.ndarray, y: np.ndarray, seed: int = 0) -> dict:
    """Adam on the log loss of document scores. Without labels, or with one class alone, every score is near that share."""
    rng = np.random.default_rng(seed)
    share = (y.sum() + 0.5) / (y.size + 1)
    model = {
        "mean": x.mean(0) if len(x) else np.zeros(WIDTH), "scale": (x.std(0) if len(x) else np.zeros(WIDTH)) + 0.05,
        "W": rng.normal(0, 0.2, (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)),
        "w": rng.normal(0, 0.3, GATE), "c": np.zeros(HIDDEN), "d": np.array(np.log(share / (1 - share))),
    }
    if not 0 < y.sum() < y.size:
        return model
    names = ("W", "b", "V", "U", "w", "c", "d")
    first_moment, second = ({k: np.zeros_like(model[k]) for k in names} for _ in range(2))
    for epoch in range(1, EPOCHS + 1):
        grads = gradients(model, x, base, y)
        for k in names:
            grad = grads[k] + DECAY * model[k] * (k not in "bd")
            first_moment[k] = 0.9 * first_moment[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            model[k] = model[k] - RATE * (first_moment[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.999**epoch)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from at most ``sample`` labelled rows that aren't held out, picked by a hash of doc_id; ties by doc_id."""
    known = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def passages(batches):
        for batch in batches:
            for lo, hi, data, ends in text_chunks(batch.column(1)):
                x, base = encode(data, ends)
                spread = lambda n: np.unique(np.linspace(0, n - 1, min(n, SAMPLE_PASSAGES)).astype(np.int64))
                rows = [x[base[i] + spread(base[i + 1] - base[i])].astype("<f4").tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(rows, pa.binary()), batch.column(2)[lo:hi]], names=["doc_id", "x", "y"])

    bags = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").mapInArrow(passages, "doc_id long, x binary, y double").collect()
    bags = sorted({r["doc_id"]: r for r in sorted(bags, key=lambda r: bytes(r["x"]))}.values(), key=lambda r: r["doc_id"])
    parts = [np.frombuffer(r["x"], "<f4").reshape(-1, WIDTH).astype(float) for r in bags]
    base = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)
    return fit(np.concatenate(parts) if parts else np.zeros((0, WIDTH)), base, np.array([r["y"] for r in bags]))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; null text is empty, which is scored like any other.

    Repeated rows give repeated rows with equal scores; an empty table gives none; only text is an input of a score, whatever
    stands beside it in its part. A null doc_id is scored too and not held out. Very long texts are encoded in slices.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches):
        for batch in batches:
            for lo, hi, data, ends in text_chunks(batch.column(1)):
                x, base = encode(data, ends)
                y = forward(shared.value, x, base)["score"]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(y)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted 1, with all their columns; judged where they stand, each by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for lo, hi, data, ends in text_chunks(batch.column(at)):
                x, base = encode(data, ends)
                yield batch.slice(lo, hi - lo).filter(pa.array(forward(shared.value, x, base)["score"] >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
