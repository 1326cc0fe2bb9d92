"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded by its byte classes, their transitions and the
repetition of its words; gated attention weighs the passages, and the weighted sum of their encodings is
scored. Encoder, attention and score are learned together from document labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import read_table
from ._text import SPACE, chunks, raw_bytes, words
from .toxicity import crc_mod, labelled_sample

#: Labelled documents that the model is fitted on, at most: those of the smallest hash of the id.
MAX_TRAIN = 4_000
#: Words of a passage.
PASSAGE = 48
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE = 24, 12, 14, 64, 0.01

# byte classes: lower, upper, digit, space, line end, sentence marks, brackets and quotes, then other ASCII signs in four
# groups, controls, non-ASCII leads and continuations
CLASSES = 14
CLASS = np.full(256, 11, dtype=np.int64)
CLASS[0x61:0x7B], CLASS[0x41:0x5B], CLASS[0x30:0x3A] = 0, 1, 2
for _text, _class in ((b" \t", 3), (b"\n\r", 4), (b".,;:?", 5), (b"!", 6), (b"()[]{}<>\"'`", 7), (b"#$%&", 8), (b"*+=~^_-", 9), (b"|\\/@", 10)):
    CLASS[list(_text)] = _class
CLASS[0xC0:0x100], CLASS[0x80:0xC0] = 12, 13
N_FEATURES = CLASSES + CLASSES * CLASSES + 6


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(passages, N_FEATURES) of some texts and the bounds of each text's; a text without words is one passage."""
    found = words(texts, SPACE)
    raw, offsets = raw_bytes(texts)
    raw_len = offsets[1:] - offsets[:-1]
    n_each = np.maximum(1, -(-np.diff(found.bounds) // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(n_each)])
    n = int(bounds[-1])
    text_of = np.repeat(np.arange(len(n_each)), n_each)
    rank = np.arange(n) - bounds[text_of]
    # a passage's bytes run from its first word to the next passage's, a text's first passage from the text's start
    first = found.bounds[:-1][text_of] + rank * PASSAGE
    begin = np.where(rank == 0, offsets[:-1][text_of], found.starts[np.minimum(first, len(found.starts) - 1)] if len(found.starts) else 0)
    out = np.zeros((n, N_FEATURES))
    if len(raw):
        owner = np.repeat(np.arange(n), np.diff(np.append(begin, len(raw))))
        kinds = CLASS[raw]
        single = np.bincount(owner * CLASSES + kinds, minlength=n * CLASSES).reshape(n, CLASSES)
        pairs = np.bincount(owner[1:] * CLASSES**2 + kinds[:-1] * CLASSES + kinds[1:], minlength=n * CLASSES**2).reshape(n, -1)
        size = np.maximum(single.sum(axis=1, keepdims=True), 1)
        out[:, :CLASSES] = np.sqrt(single / size)
        out[:, CLASSES : CLASSES + CLASSES**2] = np.sqrt(pairs / size)
    if len(found.starts):
        h = found.hashes()
        doc = found.text_of()
        part = bounds[doc] + (np.arange(len(h)) - found.bounds[doc]) // PASSAGE
        total = np.maximum(np.bincount(part, minlength=n), 1)
        rate = lambda x: np.bincount(part[: len(x)], weights=x, minlength=n) / total
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (part[1:] == part[:-1])
        length = (found.ends - found.starts).astype(float)
        tail = CLASSES + CLASSES**2
        out[:, tail] = rate(same)
        # distinct words of a passage: fingerprints sorted within it
        order = np.lexsort((h, part))
        fresh = np.ones(len(h))
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (part[order][1:] != part[order][:-1])
        out[:, tail + 1] = np.bincount(part[order], weights=fresh, minlength=n) / total
        mean = rate(length)
        out[:, tail + 2] = np.log1p(mean) / 4
        out[:, tail + 3] = np.sqrt(np.maximum(rate(length**2) - mean**2, 0)) / 10
        out[:, tail + 4] = np.log1p(total) / 4
    out[:, N_FEATURES - 1] = np.log1p(raw_len[text_of]) / 10
    return out, bounds


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, bounds[:-1], axis=0)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict

    def encode(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.spread

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict:
        w = self.weights
        h = np.tanh(x @ w["W"] + w["c"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
        logit = (v * u) @ w["a"]
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        e = np.exp(logit - np.maximum.reduceat(logit, bounds[:-1])[owner])
        share = e / _sums(e, bounds)[owner]
        z = _sums(share[:, None] * h, bounds)
        return {"h": h, "v": v, "u": u, "share": share, "z": z, "owner": owner, "p": 1 / (1 + np.exp(-np.clip(z @ w["o"] + w["b"], -30, 30)))}

    def predict(self, features: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the bags, and the attention of their passages."""
        got = self.forward(self.encode(features), bounds)
        return got["p"], got["share"]


def _gradients(model: Model, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict:
    w, f = model.weights, model.forward(x, bounds)
    d = (f["p"] - y) / len(y)
    dz = d[:, None] * w["o"]
    dh = f["share"][:, None] * dz[f["owner"]]
    ds = (f["h"] * dz[f["owner"]]).sum(axis=1)
    dl = f["share"] * (ds - _sums(f["share"] * ds, bounds)[f["owner"]])
    dg = dl[:, None] * w["a"]
    dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
    dh = dh + dv @ w["V"].T + du @ w["U"].T
    da = dh * (1 - f["h"] ** 2)
    return {"W": x.T @ da, "c": da.sum(axis=0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "a": ((f["v"] * f["u"]) * dl[:, None]).sum(axis=0), "o": f["z"].T @ d, "b": d.sum()}


def fit(features: np.ndarray, bounds: np.ndarray, y: np.ndarray, seed: int = 11) -> Model:
    """Adam on the bags' cross entropy; with no or one kind of label the score is their mean."""
    rng = np.random.default_rng(seed)
    mean, spread = (features.mean(axis=0), features.std(axis=0) + 0.05) if len(features) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    share = (y.sum() + 0.5) / (len(y) + 1)
    weights = {"W": rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, HIDDEN)), "c": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "a": rng.normal(0, 0.3, ATTENTION), "o": np.zeros(HIDDEN), "b": np.log(share / (1 - share))}
    model = Model(mean, spread, weights)
    if len(set(y.tolist())) < 2:
        return model
    x = model.encode(features)
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            rows = np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in own])
            cut = np.concatenate([[0], np.cumsum(bounds[own + 1] - bounds[own])])
            step += 1
            for k, g in _gradients(model, x[rows], cut, y[own]).items():
                g = g + 1e-3 * weights[k] * (k in "WVUo")
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


RESULT = "doc_id long, score double, predicted int, n_passages int, top_passage int, top_attention double"


def scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                features, bounds = passages(part.column(1))
                p, share = model.predict(features, bounds)
                top = [int(np.argmax(share[i:j])) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                cols = [pa.array(p), pa.array((p >= 0.7).astype(np.int32)), pa.array(np.diff(bounds).astype(np.int32)), pa.array(top, pa.int32()), pa.array(share[bounds[:-1] + top] if len(top) else [], pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "score", "predicted", "n_passages", "top_passage", "top_attention"])

    return run


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.7 on), passages and the passage of most attention of every document.

    ``labels`` (id, label 0 or 1) are the rows to learn from; the model is fitted on at most ``max_train`` of them, on the
    driver. Whole texts are read, in passages of PASSAGE words; null and empty texts are one empty passage. Without labels of
    both kinds every score is the labels' share of 1. Repeated rows are scored each; other columns are not read.
    """
    texts, y = labelled_sample(docs, labels, label, max_train, id_col, text_col)
    features, bounds = [], [0]
    for part in chunks(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
        x, b = passages(part.column(0))
        features.append(x.astype(np.float32))
        bounds.extend((b[1:] + bounds[-1]).tolist())
    x = np.concatenate(features) if features else np.zeros((0, N_FEATURES))
    shared = docs.sparkSession.sparkContext.broadcast(fit(x, np.array(bounds), y.astype(float)))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scorer(shared), RESULT)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = quality(docs, labels.where(crc_mod("doc_id", 4) != 2))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "n_passages", "top_passage")
