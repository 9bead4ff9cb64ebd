"""Operator 9: a quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters and digits, with case, and runs of other visible characters. Tokens and pairs of neighbours are
hashed to 2^LOG2 buckets; a pair of equal tokens has a bucket of its own, whatever the token. A text's value in a bucket is the
square root of the bucket's share of its n-grams, so texts of any length have norm one. A score is one sparse dot product.

Training takes at most ``rows_most`` labelled rows, chosen by a hash of the id, dealt by another to shards of about ``ROWS_SHARD`` rows; each
shard makes FTRL-proximal updates row by row in the hash's order, and the shards' weights are averaged (parameter mixing).

Null and empty texts have no n-grams: their score is the intercept's. Without labelled rows (in an empty table, say) the score is
0.5. Rows whose label is neither 0 nor 1 are left out; a repeated labelled row counts as often as it is there. Equal texts get
equal scores, and repeated rows each give a row. Texts of any length are taken whole, long ones in pieces that end at a space. A
score column of the input gives way, other columns are carried along.
"""

from __future__ import annotations

from functools import cache, lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.llm.common import adding, hash_sample, mix, pieces, runs

LOG2, ROWS_SHARD, ROWS_MOST = 18, 2_000, 16_000
#: Of the updates: learning rate, its offset, and the two penalties; passes over a shard.
ALPHA, BETA, L1, L2, PASSES = 4.0, 1.0, 1e-3, 0.0, 10
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 2**64)


@cache
def _kinds() -> np.ndarray:
    """Of each code point: 0 space, 1 letter or digit, 2 other."""
    return np.array([0 if chr(i).isspace() else 1 if chr(i).isalnum() else 2 for i in range(0x110000)], dtype=np.int8)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    out = []
    for p in (_P, _P_INVERSE):
        factors = np.full(n, p, dtype=np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors, dtype=np.uint64))
    return out[0], out[1]


def _piece_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token and the number of the text that it is in."""
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    flat = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = _kinds()[flat]
    change = np.flatnonzero(np.diff(kind, prepend=0) != 0)
    ends = np.append(change, len(flat))[1:]
    real = kind[change] > 0
    starts, ends = change[real], ends[real]
    up, down = _powers(1 << int(np.ceil(np.log2(len(flat) + 1))))
    total = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), np.searchsorted(np.cumsum(lens), starts, side="right")


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As _piece_tokens; long texts piece by piece."""
    parts = [(i, p) for i, t in enumerate(texts) for p in pieces(t)]
    tokens, text = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for a, b in runs([p for _, p in parts]):
        found, at = _piece_tokens([p for _, p in parts[a:b]])
        tokens.append(found)
        text.append(np.array([i for i, _ in parts[a:b]])[at])
    return np.concatenate(tokens), np.concatenate(text)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, value) of all non-zero entries, by text and bucket."""
    tokens, text = _tokens(texts)
    same_text = text[1:] == text[:-1]
    a, b = tokens[:-1][same_text], tokens[1:][same_text]
    pairs = np.where(a == b, np.uint64(1), mix(a * np.uint64(3) + b))
    key = (np.concatenate([text, text[1:][same_text]]).astype(np.uint64) << np.uint64(LOG2)) | (np.concatenate([tokens, pairs]) >> np.uint64(64 - LOG2))
    found, count = np.unique(key, return_counts=True)
    row = (found >> np.uint64(LOG2)).astype(np.int64)
    n = np.bincount(row, weights=count, minlength=len(texts))
    return row, (found & np.uint64((1 << LOG2) - 1)).astype(np.int64), np.sqrt(count / n[row])


def train(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """Weights, the intercept last, after FTRL-proximal updates in the given order."""
    z, n = np.zeros((1 << LOG2) + 1), np.zeros((1 << LOG2) + 1)
    rows = []
    for a, b in runs(texts):
        row, bucket, value = features(texts[a:b])
        cut = np.searchsorted(row, np.arange(b - a + 1))
        rows += [(np.append(bucket[cut[k] : cut[k + 1]], 1 << LOG2), np.append(value[cut[k] : cut[k + 1]], 1.0)) for k in range(b - a)]

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(PASSES):
        for (at, x), y in zip(rows, labels):
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - step * w
            n[at] = ni + g * g
    return weights(z, n)


def scores(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    dot = np.full(len(texts), weights[-1])
    where = [i for i, t in enumerate(texts) if t]
    for a, b in runs([texts[i] for i in where]):
        own = np.array(where[a:b])
        row, bucket, value = features([texts[i] for i in own])
        dot[own] += np.bincount(row, weights=weights[bucket] * value, minlength=len(own))
    return 1 / (1 + np.exp(-np.clip(dot, -35, 35)))


def learn(rows: DataFrame, text: str = "text", label: str = "label", *, id_column: str = "doc_id", rows_most: int = ROWS_MOST) -> np.ndarray:
    """The averaged weights of all shards."""
    import pandas as pd

    rows = rows.select(F.col(id_column).cast("string").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)")
    shards = max(1, round(min(rows_most, rows.count()) / ROWS_SHARD))
    dealt = hash_sample(rows, "id", rows_most).withColumn("h", F.xxhash64("id", F.lit(1))).withColumn("shard", F.pmod("h", F.lit(shards)))

    def fit(pdf):
        pdf = pdf.sort_values(["h", "id", "text"])
        return pd.DataFrame({"n": [len(pdf)], "w": [train(list(pdf["text"]), pdf["label"].to_numpy(float)).astype("<f4").tobytes()]})

    # a row of 4 x 2^LOG2 bytes for each shard
    found = dealt.groupBy("shard").applyInPandas(fit, "n long, w binary").collect()
    if not found:
        return np.zeros((1 << LOG2) + 1)
    return np.average([np.frombuffer(r["w"], "<f4").astype(float) for r in found], axis=0, weights=[r["n"] for r in found])


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """docs with score; a column of that name gives way."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    return adding(docs, text, lambda: lambda texts: [scores(texts, held.value)], [T.StructField("score", T.DoubleType())])
