"""Quality classifier with supervised subword embeddings.

Every word has a hashed vector, and so has each of its character n-grams (with
word ends marked). A document is the average of all these vectors over its
whole text, and a softmax over the labels follows. Vectors and output are
trained together by stochastic gradient descent in numpy on a bounded sample.
As the output is linear in the average, each bucket's vector times the output
matrix is folded into one number before scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .sampling import labelled_sample

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
REPEAT = 3  # a word window seen before in the text, and a word equal to the one before it, also count as a repeat marker


def word_features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its n-grams, one word after another, and len+1 offsets."""
    size = ends - starts
    wide = size + 2
    at = np.concatenate([[0], np.cumsum(wide)])
    text = np.empty(at[-1], np.uint8)
    text[at[:-1]], text[at[1:] - 1] = ord("<"), ord(">")
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    text[inner] = raw[np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
    roll = T.Rolling(T._LETTER[text], "letter")
    owner, codes = [np.arange(len(size))], [roll.spans(at[:-1], at[1:])]
    word = np.repeat(np.arange(len(size)), wide)
    for n in GRAMS:
        first = np.flatnonzero(np.arange(at[-1]) + n <= at[1:][word])
        owner.append(word[first])
        codes.append(roll.spans(first, first + n))
    owner, codes = np.concatenate(owner), np.concatenate(codes)
    order = np.argsort(owner, kind="stable")
    return (codes[order] % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(size) + 1))


def _marker() -> np.ndarray:
    mark = np.frombuffer(b"\x00repeat", np.uint8)
    return (T.hash_words(mark, np.array([0]), np.array([len(mark)])) % np.uint64(BUCKETS)).astype(np.int64)


def chunk_words(raw: np.ndarray, off: np.ndarray):
    """Distinct words of a chunk, each occurrence's number among them, each text's offsets, and repeats per text."""
    ws, we, wo = T.cut_words(raw, off)
    h = T.hash_words(raw, ws, we)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    texts = np.repeat(np.arange(len(wo) - 1), np.diff(wo))
    win = T.Rolling(h, "word").windows(REPEAT)
    whole = texts[: len(win)] == texts[REPEAT - 1: REPEAT - 1 + len(win)] if len(win) else np.zeros(0, bool)
    key = T.mix64(win[whole] + texts[: len(win)][whole].astype(np.uint64))
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    repeats = np.bincount(texts[: len(win)][whole][again], minlength=len(wo) - 1)
    twice = (h[1:] == h[:-1]) & (texts[1:] == texts[:-1])
    repeats = repeats + np.bincount(texts[1:][twice], minlength=len(wo) - 1)
    return ws[first], we[first], number, wo, repeats


@dataclass(frozen=True)
class Model:
    bucket_logit: np.ndarray
    bias: float

    def logits(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        ws, we, number, wo, repeats = chunk_words(raw, off)
        total, count = np.zeros(len(wo) - 1), np.zeros(len(wo) - 1)
        if len(ws):
            ids, at = word_features(raw, ws, we)
            upto = np.concatenate([[0.0], np.cumsum(self.bucket_logit[ids])])
            one, many = upto[at[1:]] - upto[at[:-1]], np.diff(at)
            texts = np.repeat(np.arange(len(wo) - 1), np.diff(wo))
            total = np.bincount(texts, one[number], len(wo) - 1)
            count = np.bincount(texts, many[number], len(wo) - 1).astype(float)
        weight = count / np.maximum(np.diff(wo), 1)  # a repeat marker weighs as much as a word with its n-grams
        total += repeats * weight * self.bucket_logit[_marker()[0]]
        count += repeats * weight
        return total / np.maximum(count, 1) + self.bias


def features(raw: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: buckets present and their shares of all occurrences."""
    ws, we, number, wo, repeats = chunk_words(raw, off)
    ids, at = word_features(raw, ws, we)
    out = []
    for i in range(len(wo) - 1):
        words, times = np.unique(number[wo[i]: wo[i + 1]], return_counts=True)
        many = at[words + 1] - at[words]
        flat = np.repeat(at[words] - np.cumsum(many) + many, many) + np.arange(many.sum())
        total = np.bincount(ids[flat], np.repeat(times, many), BUCKETS) if len(words) else np.zeros(BUCKETS)
        if len(words):
            total[_marker()[0]] += repeats[i] * (times @ many) / times.sum()
        used = np.flatnonzero(total)
        out.append((used.astype(np.int32), (total[used] / max(total.sum(), 1)).astype(np.float32)))
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 8, epochs: int = 12, rate: float = 2.0, batch: int = 16, seed: int = 5) -> Model:
    """Two labels (0, 1), each weighing the same. One label only: no evidence, every score follows its prior."""
    share = np.bincount(labels, minlength=2)
    if not share.all():
        return Model(np.zeros(BUCKETS), float(np.log((share[1] + 1) / (share[0] + 1))))
    rng = np.random.default_rng(seed)
    vec = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    sure = (len(labels) / (2 * share))[labels].astype(np.float32)
    steps, done = epochs * -(-len(rows) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            pick = order[lo: lo + batch]
            ids = np.concatenate([rows[i][0] for i in pick])
            val = np.concatenate([rows[i][1] for i in pick])
            at = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
            mean = np.stack([np.bincount(at, vec[ids, d] * val, len(pick)) for d in range(dim)], axis=1).astype(np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            g = p * sure[pick][:, None]
            lr = rate * (1 - done / steps)
            back = g @ out.T
            uniq, place = np.unique(ids, return_inverse=True)
            for d in range(dim):
                vec[uniq, d] -= lr * np.bincount(place, back[at, d] * val, len(uniq))
            out -= lr / len(pick) * (mean.T @ g)
            bias -= lr / len(pick) * g.sum(axis=0)
            done += 1
    return Model((vec @ (out[:, 1] - out[:, 0])).astype(float), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", per_class: int = 1500) -> Model:
    """Model from about ``per_class`` labelled rows of each of labels 0 and 1 for which ``learn`` holds.

    The sample of labels is bounded (at most twice 2 * per_class rows), so it is
    sent to the documents; texts are not shuffled. Other label values are ignored.
    """
    rows = labels.filter(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    picked = labelled_sample(rows, "label", "id", per_class)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [f for _, raw, off in T.chunks(b.column("text")) for f in features(raw, off)]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([i.tobytes() for i, _ in found], pa.binary()),
                                              pa.array([v.tobytes() for _, v in found], pa.binary())], ["label", "ids", "val"])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("label", "text")
    got = sorted((tuple(r) for r in texts.mapInArrow(scan, "label int, ids binary, val binary").collect()), key=lambda r: (r[1], r[2], r[0]))
    return fit([(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for _, i, v in got], np.array([r[0] for r in got], np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row: probability of label 1. Null, empty and blank texts have the model's score of no evidence."""
    kind = dict(docs.dtypes)[id_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.concatenate([np.zeros(0), *[model.logits(raw, off) for _, raw, off in T.chunks(b.column("text"))]])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["id", "score"])
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(scan, f"id {kind}, score double").withColumnRenamed("id", id_col))


def classify(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", per_class: int = 1500) -> DataFrame:
    """Trains on the labelled rows where ``learn`` holds (on the labels' id column) and scores every document.

    Without usable labels every score is 0.5. Equal texts get equal scores; an
    empty table gives no rows; columns other than those named are ignored.
    """
    return score(docs, train(docs, labels, learn, id_col, text_col, label_col, per_class), id_col, text_col)
