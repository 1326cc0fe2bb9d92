"""Toxic passages by maximum-scoring segments.

Tokens score by their log-odds between toxic and clean labelled documents under a Dirichlet prior; a linear-time scan
finds all maximal segments of the scores; a segment's score is compared with what chance gives in a text of that length (an
extreme-value law whose decay is solved for from the clean texts), and the significant segments of a document are summed up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import read_table
from ._text import NON_WORD, U, Words, chunks, fingerprints, words

#: Labelled documents that the model is fitted on, at most: those of the smallest hash of the id.
MAX_TRAIN = 5_000
#: Bytes of labelled texts that the driver reads, at most.
MAX_BYTES = 128 << 20
#: Strength of the Dirichlet prior in documents, and the likelihood-ratio statistic from which a token may score above 0.
PRIOR, MIN_RATIO = 10.0, 18.0
#: Besides whole words, their beginnings of so many bytes are tokens: inflected and compounded words share them.
BEGINNINGS = (5, 6)
#: Score of all other tokens: rare enough toxic words end a passage.
DRIFT = -0.35
#: Segments are significant if chance gives one in a text with at most this probability.
ALPHA = 0.05


def crc_mod(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % n


@dataclass(frozen=True)
class Model:
    hashes: np.ndarray  # sorted fingerprints of scoring tokens
    scores: np.ndarray
    decay: float  # lambda of the extreme-value law
    scale: float  # K of it
    weight: float  # logistic calibration of a document's evidence
    bias: float

    def token_scores(self, tokens: np.ndarray) -> np.ndarray:
        """Of (forms, words) fingerprints: a word scores as the best of its forms."""
        out = np.full(tokens.shape[1], DRIFT)
        if not len(self.hashes):
            return out
        for form in tokens[::-1]:
            at = np.minimum(np.searchsorted(self.hashes, form), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == form)
            out[hit] = np.maximum(out[hit], self.scores[at[hit]])
        return out

    def evidence(self, score: float, n: int) -> float:
        """-log of the probability that a text of n tokens without toxic passages has such a segment."""
        bits = self.decay * score - math.log(max(self.scale * n, 1e-9))
        # 1 - exp(-exp(-bits)), safe for large values
        return bits if bits > 30 else -math.log(max(-math.expm1(-math.exp(-bits)), 1e-300))


def forms(found: Words) -> np.ndarray:
    """(forms, words) fingerprints: the word, then its beginnings (of words that are longer)."""
    whole = found.hashes()
    size = found.ends - found.starts
    out = [whole]
    for n in BEGINNINGS:
        own = whole.copy()
        longer = np.flatnonzero(size > n)
        own[longer] = fingerprints(found.data, found.starts[longer], found.starts[longer] + n) ^ U(n)
        out.append(own)
    return np.stack(out)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score): one pass in linear time, over runs of equal sign."""
    above = scores > 0
    if not above.any():
        return []
    cuts = np.flatnonzero(np.diff(above, prepend=not above[0]))
    sums = np.add.reduceat(scores, cuts)
    ends = np.append(cuts[1:], len(scores))
    done: list[tuple[int, int, float]] = []
    # open segments: start, end, total before it, total after it, and the place of the nearest one below it with a smaller total before
    open_: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for start, end, value in zip(cuts.tolist(), ends.tolist(), sums.tolist(), strict=True):
        if value <= 0:
            total += value
            continue
        before, total = total, total + value
        while True:
            k = len(open_) - 1
            while k >= 0 and open_[k][2] >= before:
                k = open_[k][4]
            if k < 0:
                # nothing open can ever be joined with what follows
                done += [(a, b, y - x) for a, b, x, y, _ in open_]
                open_.clear()
            if k < 0 or open_[k][3] >= total:
                open_.append((start, end, before, total, k))
                break
            start, before = open_[k][0], open_[k][2]
            del open_[k:]
    return done + [(a, b, y - x) for a, b, x, y, _ in open_]


def found_segments(model: Model, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
    """Significant segments (start, end, score, evidence) of a text with these token scores."""
    limit = -math.log(ALPHA)
    out = [(a, b, s, model.evidence(s, len(scores))) for a, b, s in segments(scores)]
    return [x for x in out if x[3] >= limit]


def total_evidence(found: list[tuple[int, int, float, float]]) -> float:
    return math.log1p(sum(x[3] for x in found))


def decay_of(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(p * exp(l * s)) = 1 for scores s of negative mean."""
    p = weights / weights.sum()
    if values.max() <= 0 or (p * values).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    f = lambda x: float((p * np.exp(np.minimum(x * values, 700))).sum()) - 1.0
    while f(high) < 0:
        low, high = high, high * 2
        if high > 1e3:
            return high
    low = max(low, 1e-9)
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def learn(docs: list[np.ndarray], labels: np.ndarray) -> Model | None:
    """Token scores and the extreme-value law from documents' (forms, words); None without tokens that tell."""
    n = np.array([(labels == c).sum() for c in (0, 1)], dtype=float)
    if min(n) == 0:
        return None
    sets = [np.unique(d) for d in docs]
    vocabulary, at = np.unique(np.concatenate(sets), return_inverse=True)
    where = np.repeat(labels, [len(x) for x in sets])
    counts = np.stack([np.bincount(at[where == c], minlength=len(vocabulary)) for c in (0, 1)]).astype(float)
    prior = PRIOR * counts.sum(axis=0) / n.sum()
    odds = np.log((counts[1] + prior) / (n[1] + PRIOR - counts[1] - prior + 1e-9)) - np.log((counts[0] + prior) / (n[0] + PRIOR - counts[0] - prior + 1e-9))
    expected = np.maximum(counts.sum(axis=0) * (n / n.sum())[:, None], 1e-12)
    ratio = 2 * (counts * np.log(np.maximum(counts, 1e-12) / expected)).sum(axis=0)
    keep = np.flatnonzero((ratio >= MIN_RATIO) & (odds > 0))
    if not len(keep):
        return None
    model = Model(vocabulary[keep], np.minimum(odds[keep], 6.0), 1.0, 1.0, 1.0, 0.0)
    # the scores of clean tokens, one count more for each scoring token so that none has probability 0
    clean = [model.token_scores(d) for d, y in zip(docs, labels, strict=True) if y == 0]
    values, weights = np.unique(np.concatenate([*clean, model.scores, [DRIFT]]), return_counts=True)
    decay = decay_of(values, weights.astype(float))
    # K so that the mean of K * n * exp(-decay * best) over clean texts is 1
    rates = [math.exp(-decay * max([0.0, *(s for _, _, s in segments(x))])) * len(x) for x in clean if len(x)]
    return Model(model.hashes, model.scores, decay, 1.0 / max(np.mean(rates) if rates else 1.0, 1e-9), 1.0, 0.0)


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    """The model of labelled texts; copies count once. The calibration sees each half through the other half's model."""
    none = Model(np.zeros(0, dtype=U), np.zeros(0), 1.0, 1.0, 1.0, math.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)) if len(labels) else -2.0)
    docs, ys, seen = [], [], set()
    for part in chunks(pa.RecordBatch.from_arrays([texts, pa.array(labels)], names=["text", "y"]), "text"):
        found = words(part.column(0), NON_WORD)
        tokens = forms(found)
        for i, j, y in zip(found.bounds[:-1], found.bounds[1:], part.column(1).to_pylist(), strict=True):
            own = tokens[:, i:j]
            key = (hash(own[0].tobytes()), y)
            if key not in seen:
                seen.add(key)
                docs.append(own.copy())
                ys.append(y)
    y = np.array(ys, dtype=int)
    model = learn(docs, y)
    if model is None:
        return none
    x = np.zeros(len(docs))
    half = np.arange(len(docs)) % 2
    for h in (0, 1):
        other = learn([d for d, k in zip(docs, half, strict=True) if k != h], y[half != h]) or model
        for k in np.flatnonzero(half == h):
            x[k] = total_evidence(found_segments(other, other.token_scores(docs[k])))
    weight, bias = 1.0, 0.0
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(weight * x + bias, -30, 30)))
        g = np.array([((p - y) * x).sum() + 0.1 * (weight - 1), (p - y).sum() + 0.1 * bias])
        r = p * (1 - p) + 1e-9
        h = np.array([[(r * x * x).sum() + 0.1, (r * x).sum()], [(r * x).sum(), r.sum() + 0.1]])
        weight, bias = np.array([weight, bias]) - np.linalg.solve(h, g)
    return Model(model.hashes, model.scores, model.decay, model.scale, float(weight), float(bias))


RESULT = "doc_id long, score double, predicted int, passages array<struct<start:int,end:int,score:double,evidence:double>>"


def scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("evidence", pa.float64())]))
        for batch in batches:
            for part in chunks(batch, "text"):
                found = words(part.column(1), NON_WORD)
                values = model.token_scores(forms(found))
                scores, passages = [], []
                for i, j in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
                    own = found_segments(model, values[i:j])
                    scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, model.weight * total_evidence(own) + model.bias)))))
                    passages.append([{"start": a, "end": b, "score": s, "evidence": e} for a, b, s, e in own])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.7) for s in scores], pa.int32()), pa.array(passages, kind)], names=["doc_id", "score", "predicted", "passages"])

    return run


def bounded_sample(rows: DataFrame, n: int, *more: str) -> pa.Table:
    """(text, ``more``) of at most ``n`` rows (sid, text, ..) and MAX_BYTES of text, the same ones each time: those of the smallest hash of sid.

    Rows of one id, text and ``more`` count once. Which rows are taken is settled without their texts, so the driver never holds more.
    """
    keyed = rows.where("sid is not null").withColumn("sh", F.xxhash64("text"))
    keys = ["sid", "sh", *more]
    rank = F.md5(F.col("sid").cast("string"))
    sizes = keyed.groupBy(*keys).agg(F.max(F.octet_length("text")).alias("size")).orderBy(rank, *keys).limit(n).toArrow()
    within, total = [], 0
    for size in sizes.column("size").to_pylist():  # a text that does not fit is passed over
        within.append(total + size <= MAX_BYTES)
        total += size * within[-1]
    chosen = rows.sparkSession.createDataFrame(sizes.filter(pa.array(within, pa.bool_())).select(keys))
    got = keyed.join(F.broadcast(chosen), keys, "left_semi").dropDuplicates(keys)
    return got.orderBy(rank, *keys).select("text", *more).toArrow()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_train: int, id_col: str, text_col: str) -> tuple[pa.Array, np.ndarray]:
    """Texts and 0/1 labels of at most ``max_train`` labelled documents, the same ones each time."""
    picked = labels.where(F.col(label).isin(0, 1)).select(F.col(id_col).cast("long").alias("sid"), F.col(label).cast("int").alias("y")).distinct()
    there = docs.select(F.col(id_col).cast("long").alias("sid"))
    picked = picked.join(there, "sid", "left_semi").orderBy(F.md5(F.col("sid").cast("string")), "sid", "y").limit(max_train)
    rows = docs.select(F.col(id_col).cast("long").alias("sid"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "sid")
    got = bounded_sample(rows, max_train, "y")
    return got.column("text").combine_chunks(), got.column("y").to_numpy().astype(int)


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.7 on) and the toxic passages, as word ranges, of every document.

    ``labels`` (id, label 0 or 1) are the rows to learn from; the model is fitted on at most ``max_train`` of them, on the
    driver. Null and empty texts have no passages and get the score of a text without evidence. Without labels of both kinds nothing
    is a passage and every score is the labels' share of 1. Repeated rows are scored each; other columns are not read.
    """
    texts, y = labelled_sample(docs, labels, label, max_train, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit(texts, y))  # tokens of the bounded sample
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scorer(shared), RESULT)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = toxicity(docs, labels.where(crc_mod("doc_id", 3) != 1))
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
