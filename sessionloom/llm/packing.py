"""Vector best-fit packing of tokenized documents into fixed-length sequences.

Every sequence has three capacities: tokens, documents and attention cost (the
sum of squared piece lengths). Pieces, longest first, go to the open sequence
that the chosen score likes best among those with room in every capacity: the
smallest weighted norm of what is left (``norm``), or the largest weighted dot
product of need and room (``dot``).

A document's pieces of full length fill a sequence each, so at most one piece of
a document has to be placed. Pieces are dealt to buckets of a bounded number of
documents by a hash, and each bucket is packed in one task; only piece sizes
travel, never tokens (unless they are asked for).
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 0
BUCKET_DOCS = 8192
#: Split pattern of the byte-level tokenizer (fixed value, as its file's pre-tokenizer defines it).
GPT2_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = re.compile(r"[^\t\n\r -~¡-ÿ]|<\|").search
_LOADED: dict[str, object] = {}


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _fast_encoder(path: str):
    """The same vocabulary as merge ranks, for texts on which both libraries split alike; None if the file is of another kind."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or not pre.get("use_regex", True):
        return None
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    vocab = model["vocab"]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("ranks", pat_str=GPT2_SPLIT, mergeable_ranks=ranks, special_tokens={})


def encoder(path: str):
    """text -> token ids of the tokenizer file, without added special tokens.

    Texts of printable Latin-1 characters, tabs and line ends go through a
    faster encoder with the same vocabulary and merges; all others (and any
    that may spell a special token) through the file's own library.
    """
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole, fast = Tokenizer.from_file(path), _fast_encoder(path)
        slow = lambda text: whole.encode(text, add_special_tokens=False).ids
        _LOADED[path] = slow if fast is None else lambda text: slow(text) if _PLAIN(text) else fast.encode_ordinary(text)
    return _LOADED[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = 2048, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut only where longer than a sequence.

    Pieces of a cut document have full length but for the first. Null and empty
    text: one piece with the end id alone.
    """
    kind = dict(docs.dtypes)[id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for b in batches:
            rows, at, all_ids = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                lo, k = 0, 0
                while lo < len(ids):
                    hi = lo + (len(ids) - lo) % tokens if (len(ids) - lo) % tokens else lo + tokens
                    rows.append((k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())))
                    at.append(i)
                    if with_ids:
                        all_ids.append(ids[lo:hi].astype(np.int32))
                    lo, k = hi, k + 1
            cols = [pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)]
            arrays = [b.column("id").take(pa.array(at, pa.int64())), *cols]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"id {kind}, piece long, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, capacity: Sequence[float], weights: Sequence[float] = (1.0, 1.0, 1.0), score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; needs are (length, 1, length**2). A piece that exceeds a capacity alone gets a bin of its own."""
    n, cap = len(lengths), np.asarray(capacity, float)
    w = np.asarray(weights, float) / cap**2
    need = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], axis=1)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    room, ids, used = np.zeros((max(n, 1), 3)), np.zeros(max(n, 1), np.int64), 0  # open bins: room left and number
    smallest, made = int(lengths.min()) if n else 0, 0
    for i in np.argsort(-lengths, kind="stable"):
        v = need[i]
        open_ = room[:used]
        fits = np.flatnonzero((open_[:, 0] >= v[0]) & (open_[:, 1] >= v[1]) & (open_[:, 2] >= v[2]))
        if len(fits):
            left = open_[fits]
            k = fits[np.argmax(left @ (w * v)) if score == "dot" else np.argmin(((left - v) ** 2) @ w)]
        else:
            k, used = used, used + 1
            room[k], ids[k], made = cap, made, made + 1
        bins[i], offsets[i] = ids[k], round(cap[0] - room[k, 0])
        room[k] -= v
        if room[k, 0] < smallest or room[k, 1] < 1 or room[k, 2] < smallest**2:  # nothing fits any more
            used -= 1
            room[k], ids[k] = room[used], ids[used]
    return bins, offsets


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = 2048,
         documents: int | None = None, attention: float | None = None, weights: Sequence[float] = (1.0, 1.0, 1.0),
         score: str = "norm", bucket_docs: int = BUCKET_DOCS, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Without limits of their own, documents and attention cost get those that
    tokens imply. Every document is packed, repeated rows as often as they
    occur; an empty table gives no rows. Other columns are ignored, so their
    names cannot clash.
    """
    capacity = (tokens, documents or tokens, attention or float(tokens) ** 2)
    buckets = max(1, -(-docs.count() // bucket_docs))
    cut = pieces(docs, tokenizer_path, id_col, text_col, tokens, with_ids)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "length", "ids_crc32"), F.lit(buckets)))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins, offsets = best_fit(rows["length"].to_numpy(), capacity, weights, score)
        return rows.drop(columns="bucket").assign(sequence_id=(int(rows["bucket"].iloc[0]) << 32) + bins, offset=offsets)

    schema = ", ".join(f"{n} {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy("bucket").applyInPandas(place, schema).withColumnRenamed("id", id_col)
