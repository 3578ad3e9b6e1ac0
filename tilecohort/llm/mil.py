"""Quality classifier by gated-attention multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded as
hashed word shares plus shares of word shapes; a hidden layer, gated attention
weights and the head on the attention-weighted passage are learned together
from document labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written
from .quality import sample_of
from .words import column, raw, slices, split, word_hashes

PASSAGE = 64
HASHED = 128
HIDDEN, GATE = 24, 12
#: Labelled documents of each class that the classifier learns from, at most.
TRAIN_DOCS = 1024
#: Passages of the documents of a class that it learns from, at most: documents are taken whole, in order of their hash, as long as they fit.
TRAIN_PASSAGES = 1 << 15
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.01, 1e-4
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>=@\\^~{}[]")] = True
#: upper-case, digit, symbol, other punctuation, non-ASCII bytes, in this order
_KINDS = np.zeros((256, 5), bool)
_KINDS[65:91, 0] = _KINDS[48:58, 1] = True
_KINDS[:, 2] = _SYMBOL
_KINDS[list(b"!?.,;:'\"()-_/`+"), 3] = True
_KINDS[128:, 4] = True
SHAPES = 12
WIDTH = HASHED + SHAPES


def shapes(vocab: pa.Array) -> np.ndarray:
    """What can be seen of a word without knowing it: SHAPES numbers from 0 to 1."""
    data, at = raw(vocab)
    size = np.maximum(1, np.diff(at))
    out = np.zeros((len(vocab), SHAPES))
    if not len(vocab):
        return out
    for j in range(5):
        count = np.add.reduceat(_KINDS[data, j].astype(np.int64), at[:-1])
        out[:, j] = count / size
        out[:, 5 + j] = count > 0
    out[:, 10] = np.minimum(size, 20) / 20
    out[:, 11] = size == 1
    return out


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(passages by WIDTH, first passage of each text). A text without a word is one passage of zeros."""
    w = split(texts)
    n = np.diff(w.bounds)
    count = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    doc = w.doc_of_word
    passage = first[:-1][doc] + (np.arange(len(doc)) - w.bounds[:-1][doc]) // PASSAGE
    cell = (word_hashes(w.vocab, seed=9) >> np.uint64(64 - HASHED.bit_length() + 1)).astype(np.int64)
    out = np.zeros((first[-1], WIDTH))
    words = np.maximum(1, np.bincount(passage, minlength=first[-1]))[:, None]
    out[:, :HASHED] = np.bincount(passage * HASHED + cell[w.codes], minlength=first[-1] * HASHED).reshape(-1, HASHED)
    shape = shapes(w.vocab)
    for j in range(SHAPES):
        out[:, HASHED + j] = np.bincount(passage, weights=shape[:, j][w.codes], minlength=first[-1])
    return np.sqrt(out / words), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, at = self.p, first[:-1]
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(at)), np.diff(first))
        a = np.exp(e - np.maximum.reduceat(e, at)[bag])
        a /= np.add.reduceat(a, at)[bag]
        z = np.add.reduceat(h * a[:, None], at)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "bag": bag, "z": z, "y": _sigmoid(z @ p["c"] + p["d"])}

    def gradient(self, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, first)
        bag, a, h, t, g = f["bag"], f["a"], f["h"], f["t"], f["g"]
        dy = (f["y"] - label) / len(label)
        dz = dy[:, None] * p["c"]
        along = (h * dz[bag]).sum(1)
        de = a * (along - np.add.reduceat(a * along, first[:-1])[bag])
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": ((t * g) * de[:, None]).sum(0), "c": f["z"].T @ dy, "d": dy.sum()}


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, seed: int = 7) -> Model:
    """Adam on the log loss over bags, all of one weight."""
    rng = np.random.default_rng(seed)
    normal = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"W": normal(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": normal(HIDDEN, GATE), "U": normal(HIDDEN, GATE), "w": normal(GATE), "c": normal(HIDDEN), "d": np.zeros(())}
    m = Model(x.mean(0), x.std(0) + 0.02, p)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(label))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            size = (first[1:] - first[:-1])[rows]
            at = np.concatenate([[0], np.cumsum(size)])
            pos = np.arange(at[-1]) + np.repeat(first[rows] - at[:-1], size)
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in m.gradient(x[pos], at, label[rows]).items():
                g = g + DECAY * p[k]
                a = 0.9 * moment[k][0] + 0.1 * g
                b = 0.999 * moment[k][1] + 0.001 * g * g
                moment[k] = (a, b)
                p[k] = p[k] - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return m


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model | float:
    """Fits on the whole texts of at most TRAIN_DOCS documents of each class, the first by hash, that have TRAIN_PASSAGES passages together; a longer document alone is left out.

    With one class or none, returns its constant score. Labels that are null or conflict, and null ids, are left out; a label given twice counts once, and rows that repeat an id are bags
    of their own. An empty table gives 0.5. The driver gets 2 * TRAIN_PASSAGES rows of numbers at most.
    """
    chosen = sample_of(labels, doc_id, TRAIN_DOCS)
    rows = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id).select(doc_id, text, "quality")  # 2 * TRAIN_DOCS ids at most

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            x, first = encode(column(part, text))
            x = x.astype(np.float16)
            yield pa.RecordBatch.from_arrays([column(part, doc_id), column(part, "quality"), pa.array(np.diff(first)), pa.array([x[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], names=["id", "quality", "n", "bag"])

    kind = docs.schema[doc_id].dataType.simpleString()
    encoded = written(rows.mapInArrow(bags, f"id {kind}, quality int, n long, bag binary"), "bags")
    order = Window.partitionBy("quality").orderBy(F.xxhash64("id"), "id", F.xxhash64("bag")).rowsBetween(Window.unboundedPreceding, 0)  # TRAIN_DOCS ids a class
    fit_in = encoded.filter(F.col("n") <= TRAIN_PASSAGES).withColumn("upto", F.sum("n").over(order)).filter(F.col("upto") <= TRAIN_PASSAGES)
    got = sorted(fit_in.select("id", "quality", "bag").collect(), key=lambda r: (r.id, r.bag))
    discard(encoded)
    label = np.array([r.quality for r in got], float)
    if not len(got) or label.min() == label.max():
        return float(label[0]) if len(got) else 0.5
    x = [np.frombuffer(r.bag, np.float16).reshape(-1, WIDTH) for r in got]
    return fit(np.concatenate(x).astype(float), np.concatenate([[0], np.cumsum([len(b) for b in x])]), label)


def score(docs: DataFrame, model: Model | float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores every passage of every whole text.

    Returns doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.5) and
    attention (array<float>, a weight for each passage). A null or empty text is one empty passage.
    Repeated rows are scored each; an empty table gives an empty result; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches, text):
            x, first = encode(column(part, text))
            if isinstance(m, float):
                y, a = np.full(len(first) - 1, m), np.repeat(1 / np.diff(first), np.diff(first))
            else:
                f = m.forward(x, first)
                y, a = f["y"], f["a"]
            out = {doc_id: column(part, doc_id), "score": pa.array(y), "predicted": pa.array((y >= 0.5).astype(np.int32)), "attention": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(a.astype(np.float32)))}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, score double, predicted int, attention array<float>")
