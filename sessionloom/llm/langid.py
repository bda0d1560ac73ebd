"""Language identification by string kernels.

Blended-spectrum presence kernel: for n = 1, 2, 3 the number of character
n-grams two texts share, over the root of the product of how many each has;
the three are averaged. Nyström landmarks turn it into features, on which
one-versus-rest kernel ridge regression is solved. Because the kernel is a dot
product of presence vectors, landmarks, Nyström map and regression fold into one
weight per n-gram and language, and a batch of texts is scored by one product of
its presence rows with that matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_sample

ORDERS = (1, 2, 3)
SYMBOLS = 64  # 0: not a letter, 1-26: a-z, the rest: other letters by hash
STARTS = np.cumsum([0, *[SYMBOLS**n for n in ORDERS]])
UNKNOWN = "und"
_TABLE = np.zeros(0x110000, np.uint8)
_TABLE[128:] = 27 + (np.arange(128, 0x110000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % 37
_TABLE[[ord(c) for c in "«»“”„‘’–—…·•¿¡  "]] = 0
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _TABLE[ord(_c)] = _i + 1


def grams(text: str, seen: np.ndarray) -> np.ndarray:
    """Sorted numbers of the n-grams present in the whole text; ``seen`` is a cleared flag array that is cleared again."""
    s = _TABLE[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")].astype(np.int32)
    s = np.concatenate([[0], s, [0]])
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    for n, at in zip(ORDERS, STARTS):
        if len(s) >= n:
            code = s[: len(s) - n + 1]
            for j in range(1, n):
                code = code * SYMBOLS + s[j: len(s) - n + 1 + j]
            seen[at + code] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found.astype(np.int32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def presence_weights(found: np.ndarray) -> np.ndarray:
    """1 over the root of how many n-grams of its order are present, for each present n-gram."""
    bounds = np.searchsorted(found, STARTS)
    sizes = np.diff(bounds)
    return np.repeat(1 / np.sqrt(np.maximum(sizes, 1) * len(ORDERS)), sizes)


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    column: np.ndarray  # n-gram number -> row of weights, -1: in no landmark
    weights: np.ndarray  # rows x labels
    bias: np.ndarray

    def scores(self, texts: list[str], seen: np.ndarray) -> np.ndarray:
        """Texts x labels: one product of the batch's presence rows with the weights, summed row by row."""
        rows = [grams(t, seen) for t in texts]
        held = [(self.column[r], presence_weights(r)) for r in rows]
        ids = np.concatenate([np.zeros(0, np.int64), *[c[c >= 0] for c, _ in held]]).astype(np.int64)
        val = np.concatenate([np.zeros(0), *[v[c >= 0] for c, v in held]])
        ends = np.cumsum([0, *[int((c >= 0).sum()) for c, _ in held]])
        sums = np.zeros((len(ids) + 1, len(self.labels)))
        np.cumsum(self.weights[ids] * val[:, None], axis=0, out=sums[1:])
        return sums[ends[1:]] - sums[ends[:-1]] + self.bias


def fit(found: list[np.ndarray], labels: list[str], landmarks: int = 64, ridge: float = 1e-2, seed: int = 7, in_all: int = 1024) -> Model:
    """``landmarks`` texts of each language (all, if fewer) are landmarks; the order of the examples decides which.

    With many languages each has fewer, ``in_all`` together, but at least one: the
    landmark matrix on the driver has the larger of ``in_all`` and the number of
    languages as rows.
    """
    names = tuple(sorted(set(labels)))
    landmarks = max(1, min(landmarks, in_all // len(names)))
    y = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    marks = np.concatenate([rng.permutation(np.flatnonzero(y == k))[:landmarks] for k in range(len(names))])
    used = np.unique(np.concatenate([found[i] for i in marks]))
    column = np.full(STARTS[-1], -1, np.int32)
    column[used] = np.arange(len(used))

    def dense(rows) -> np.ndarray:
        out = np.zeros((len(rows), len(used)), np.float32)
        for k, i in enumerate(rows):
            c = column[found[i]]
            out[k, c[c >= 0]] = presence_weights(found[i])[c >= 0]
        return out

    base = dense(marks)
    value, vector = np.linalg.eigh((base @ base.T).astype(float))
    good = value > 1e-6 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])
    phi = np.concatenate([(dense(range(i, min(i + 256, len(y)))) @ base.T) @ root for i in range(0, len(y), 256)])
    share = np.bincount(y, minlength=len(names))
    sure = (1 / share)[y] * len(y) / len(names)  # every language weighs the same
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    mean, middle = np.average(phi, axis=0, weights=sure), np.average(target, axis=0, weights=sure)
    x = phi - mean
    w = np.linalg.solve((x * sure[:, None]).T @ x + ridge * len(y) * np.eye(x.shape[1]), (x * sure[:, None]).T @ (target - middle))
    return Model(names, column, (base.T @ (root @ w)), middle - mean @ w)


def train(rows: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int = 400, landmarks: int = 64) -> Model | None:
    """Model from about ``per_class`` texts of each label of ``rows``; None without any labelled text that has a letter."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(STARTS[-1], bool)
        for b in batches:
            found = [grams(t, seen).tobytes() if has_letter(t) else None for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("label").cast(pa.string()), pa.array(found, pa.binary())], ["id", "label", "found"])
    named = rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    picked = labelled_sample(named, "label", "id", per_class)
    got = sorted((r["label"], r["id"] or "", r["found"]) for r in
                 picked.mapInArrow(scan, "id string, label string, found binary").filter("found IS NOT NULL").collect())
    return fit([np.frombuffer(f, np.int32) for _, _, f in got], [x for x, _, _ in got], landmarks) if got else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row. Null text, a text without a letter, or no model: ``und`` with score 0."""
    kind = dict(docs.dtypes)[id_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(STARTS[-1], bool)
        for b in batches:
            texts = b.column("text").to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if model and has_letter(t)]
            for lo in range(0, len(known), 256):
                part = known[lo: lo + 256]
                s = model.scores([texts[i] for i in part], seen)
                best = s.argmax(axis=1)
                score[part] = np.clip((s.max(axis=1) + 1) / 2, 0, 1)
                for i, k in zip(part, best):
                    lang[i] = model.labels[k]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(scan, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col))


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
             per_class: int = 400, landmarks: int = 64) -> DataFrame:
    """Learns from the rows where ``learn`` holds and the label is not null, then predicts every row.

    Equal texts get equal predictions; an empty table gives no rows; columns
    other than those named are ignored.
    """
    rows = docs.filter(learn & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    return predict(docs, train(rows, id_col, text_col, label_col, per_class, landmarks), id_col, text_col)
