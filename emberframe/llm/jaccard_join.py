"""Operator 6: n-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of shingles of ``SHINGLE`` words (lower-cased, between spaces); a shorter text is one shingle. Texts with the same
words are one class of copies, represented once. Of each class, ``BANDS`` x ``ROWS`` MinHash values are kept. Classes that agree
in all values of a band share a bucket. Inside a bucket the values of all pairs are compared a few at a time; a pair goes as soon
as, given its matches so far, the posterior probability of a similarity of ``THRESHOLD`` or more is below ``TOLERANCE``. The pairs
left connect clusters, and inside a cluster every pair is verified exactly on the shingles themselves.

No task gets an unbounded bucket or cluster: members are dealt to blocks of about ``BLOCK``, or fewer if their shingles take more
than ``BLOCK_BYTES``, and each task compares two blocks. It returns a row for each member (its links, and the smallest member that
they connect it to), never the pairs. To count all links of a group of n different texts exactly, each must meet all others, so
n * n / BLOCK sets are shuffled; groups of exact copies are one text. Buckets with the same members are compared once. Which
shingles to gather is told by a bitmap of fixed size, so texts are never shuffled, and only clusters' shingles are.

The chance to lose a pair of similarity 0.8 is about (1 - 0.8^5)^30 = 7e-6, and less above.

Null texts and texts without words have no class: they are alone, with no links. A null id never represents others unless all
are null. Repeated rows count as copies. Texts of any length are taken whole, long ones in pieces that end at a space. An empty
table gives no rows. Ids may be numbers or strings, whose order says which is the smallest. Only the id and the text are carried
along, so names cannot clash. Row numbers hold only while docs give their rows in the same order each time they are read, as a
written table does.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.llm.common import by_batches, few, mix, pieces, runs, written
from emberframe.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, TOLERANCE, STEP = 30, 5, 1e-6, 15
#: Members of a block, and bytes of their shingles.
BLOCK, BLOCK_BYTES = 1_000, 1 << 22
BITMAP_LOG2 = 23
_SEED = 20240229
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 2**64)


def _space_table() -> np.ndarray:
    global _SPACES
    if _SPACES is None:
        _SPACES = np.array([chr(i).isspace() for i in range(0x110000)])
    return _SPACES


_SPACES: np.ndarray | None = None


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for p in (_P, _P_INVERSE):
        factors = np.full(n, p, dtype=np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors, dtype=np.uint64))
    return out[0], out[1]


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [f"{t.lower()} " for t in texts]
    lens = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    flat = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    space = _space_table()[flat]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(flat) + 1)
    total = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=total[1:])
    words = mix((total[ends] - total[starts]) * down[starts])
    return words, np.bincount(np.searchsorted(np.cumsum(lens), starts, side="right"), minlength=len(texts))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the number of words of each text. Long texts are hashed piece by piece."""
    parts = [(i, p) for i, t in enumerate(texts) for p in pieces(t)]
    words, counts = [np.zeros(0, dtype=np.uint64)], np.zeros(len(texts), dtype=np.int64)
    for a, b in runs([p for _, p in parts]):
        found, n = _word_hashes([p for _, p in parts[a:b]])
        words.append(found)
        np.add.at(counts, [i for i, _ in parts[a:b]], n)
    return np.concatenate(words), counts


def shingles(words: np.ndarray, counts: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles, and how many each text has: one for a text of 1 to n words."""
    begins = np.cumsum(counts) - counts
    at = np.flatnonzero(counts)
    per = np.where(counts == 0, 0, np.maximum(1, counts - n + 1))
    place = np.arange(int(per.sum())) + np.repeat((begins - (np.cumsum(per) - per))[at], per[at])
    end = np.repeat((begins + counts)[at], per[at])
    h = np.zeros(len(place), dtype=np.uint64)
    for k in range(n):
        inside = place + k < end
        value = words[np.minimum(place + k, max(0, len(words) - 1))] if len(words) else h
        h = mix(h * np.uint64(_P) + np.where(inside, value, np.uint64(k + 1)))
    return h, per


def keys(words: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """128 bits for each text's sequence of words; None without words."""
    cut = np.concatenate([[0], np.cumsum(counts)])
    data = memoryview(words.tobytes())
    return [hashlib.blake2b(data[8 * cut[k] : 8 * cut[k + 1]], digest_size=16).digest() if counts[k] else None for k in range(len(counts))]


def signatures(hashes: np.ndarray, per: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """The MinHash values of each text that has shingles."""
    some = per[per > 0]
    at = np.cumsum(some) - some
    factors = np.random.default_rng(_SEED).integers(1, 2**63, size=size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(some), size), dtype=np.uint32)
    for k, f in enumerate(factors):
        out[:, k] = np.minimum.reduceat(hashes * f, at) >> np.uint64(32)
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    h = np.zeros((len(sig), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        h[:, b] = np.uint64(b + 1)
        for k in range(ROWS):
            h[:, b] = mix(h[:, b] * np.uint64(_P) + sig[:, b * ROWS + k].astype(np.uint64))
    return h


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest matches of n at which, after a uniform prior, the similarity reaches the threshold with at least that probability: P(S >= t | m of n) = P(Bin(n + 1, t) <= m)."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n + 1


_LEAST = [(n, least_matches(n)) for n in range(STEP, BANDS * ROWS + 1, STEP)]


def surviving_pairs(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of a, j of b) that no comparison prunes; with b None, pairs i < j of a."""
    left, right = [], []
    other = a if b is None else b
    for i in range(len(a)):
        j = np.arange(i + 1 if b is None else 0, len(other))
        matches = np.zeros(len(j), dtype=np.int64)
        done = 0
        for n, least in _LEAST:
            if not len(j):
                break
            matches += (other[j, done:n] == a[i, done:n]).sum(1)
            good = matches >= least
            j, matches, done = j[good], matches[good], n
        left.append(np.full(len(j), i))
        right.append(j)
    return np.concatenate(left) if left else np.zeros(0, int), np.concatenate(right) if right else np.zeros(0, int)


def similar(sets: list[np.ndarray], split: int | None, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a similarity of at least the threshold, exactly. Sets up to split are paired with those after it; with None, all i < j."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = count > 1
    if split is not None:
        first = np.bincount(back[owner < split], minlength=len(count))
        use = (first > 0) & (first < count)
    shared = use[back]
    column = np.cumsum(use) - 1
    owner, column = owner[shared], column[back[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n, width = len(sets), 2048
    upper = n if split is None else split
    common = np.zeros((upper, n if split is None else n - split), dtype=np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [begin, begin + width])
        part = np.zeros((n, int(column[b - 1]) + 1 - begin), dtype=np.float32)
        part[owner[a:b], column[a:b] - begin] = 1
        common += part[:upper] @ (part if split is None else part[split:]).T
    i, j = np.nonzero(common if split is not None else np.triu(common, 1))
    c = common[i, j].astype(np.float64)
    if split is not None:
        j = j + split
    # c / union >= threshold, without a rounded division
    good = c >= threshold * (sizes[i] + sizes[j] - c) - 1e-9
    return i[good], j[good]


def _smallest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n members in ascending order, the first member of each one's component."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def _blocks(members: DataFrame, group: str, size: DataFrame) -> DataFrame:
    """members (group, key, ...) with x, y and own: which two blocks a task compares, and which one the member is of. size: group, blocks."""
    dealt = members.join(size, group).withColumn("own", F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return dealt.withColumn("partner", partner).withColumn("x", F.least("own", "partner")).withColumn("y", F.greatest("own", "partner")).drop("blocks", "partner")


def _signed(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """row, id, key and signature of each of docs."""
    import pandas as pd

    def sign(batches):
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for a, b in runs(texts):
                words, counts = word_hashes(texts[a:b])
                own = keys(words, counts)
                hashes, per = shingles(words, counts)
                sig = signatures(hashes, per) if len(hashes) else []
                where, out = np.flatnonzero(per), [None] * (b - a)
                for k, i in enumerate(where):
                    out[i] = sig[k].tobytes()
                yield pd.DataFrame({"row": pdf["row"].iloc[a:b], "id": pdf["id"].iloc[a:b], "key": own, "sig": out})

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    return by_batches(numbered, sign, T.StructType([T.StructField("row", T.LongType()), T.StructField("id", docs.schema[id_column].dataType), T.StructField("key", T.BinaryType()), T.StructField("sig", T.BinaryType())]))


def _bands(classes: DataFrame) -> DataFrame:
    import pandas as pd

    def spread(batches):
        for pdf in batches:
            if len(pdf):
                h = band_hashes(np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint32).reshape(len(pdf), -1))
                yield pd.DataFrame({"bucket": h.view(np.int64).ravel(), "key": np.repeat(pdf["key"].to_numpy(), BANDS)})

    return by_batches(classes.select("key", "sig"), spread, "bucket long, key binary")


def _candidate_edges(classes: DataFrame) -> DataFrame:
    """a, b: edges that connect the pairs which survive the pruning."""
    import pandas as pd

    bands = _bands(classes)
    size = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("members")).filter("n > 1")
    size = written(size.groupBy("n", "members").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "jaccard-buckets")
    units = _blocks(bands, "bucket", size).join(classes.select("key", "sig"), "key")

    def prune(pdf):
        pdf = pdf.sort_values("key", ignore_index=True)
        sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint32).reshape(len(pdf), -1)
        first = np.flatnonzero(pdf["own"] == pdf["x"])
        other = np.flatnonzero(pdf["own"] != pdf["x"])
        i, j = surviving_pairs(sig[first], None)
        label = _smallest(len(pdf), first[i], first[j])
        known = np.arange(len(pdf))
        if len(other):
            # the tasks of each block by itself give the edges inside it: only those between its groups and the other's are new
            k, m = surviving_pairs(sig[other], None)
            known = _smallest(len(pdf), np.concatenate([first[i], other[k]]), np.concatenate([first[j], other[m]]))
            k, m = surviving_pairs(sig[first], sig[other])
            label = _smallest(len(pdf), known[first[k]], known[other[m]])
        moved = np.flatnonzero((label != np.arange(len(pdf))) & (known == np.arange(len(pdf))))
        return pd.DataFrame({"a": pdf["key"].to_numpy()[label[moved]], "b": pdf["key"].to_numpy()[moved]})

    return units.repartition("bucket", "x", "y").groupBy("bucket", "x", "y").applyInPandas(prune, "a binary, b binary")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of the column h, of fixed size."""
    place = F.pmod(F.col("h"), F.lit(1 << BITMAP_LOG2))
    cells = hashes.select(F.shiftright(place, 6).alias("cell"), F.expr("shiftleft(1L, cast(pmod(h, 64) as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (BITMAP_LOG2 - 6), dtype=np.int64)
    out[cells["cell"].to_numpy(dtype=np.int64)] = cells["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def _key_number(found: list[bytes | None]) -> np.ndarray:
    return np.array([int.from_bytes(k[:8], "big", signed=True) if k else 0 for k in found], dtype=np.int64)


def _verified(docs: DataFrame, text: str, clusters: DataFrame) -> DataFrame:
    """key, links, first: exact links of each member in each task, and the smallest member they connect it to. clusters: node, label."""
    import pandas as pd

    number = F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("long")
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(clusters.select(number.alias("h"))))

    def gather(batches):
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for a, b in runs(texts):
                words, counts = word_hashes(texts[a:b])
                own = keys(words, counts)
                h = _key_number(own)
                cell = (h % (1 << BITMAP_LOG2)) >> 6
                maybe = ((bits.value[cell] >> (h % 64).astype(np.uint64)) & np.uint64(1)).astype(bool) & (counts > 0)
                if maybe.any():
                    hashes, per = shingles(words, counts)
                    cut = np.concatenate([[0], np.cumsum(per)])
                    take = np.flatnonzero(maybe)
                    yield pd.DataFrame({"key": [own[k] for k in take], "shingles": [np.unique(hashes[cut[k] : cut[k + 1]]).tobytes() for k in take]})

    sets = by_batches(docs.select(F.col(text).cast("string").alias("text")), gather, "key binary, shingles binary")
    members = clusters.select(F.col("node").alias("key"), F.col("label").alias("cluster"))
    # copies share their key and shingles: one of them is enough
    one = sets.groupBy("key").agg(F.first("shingles").alias("shingles"))
    own = written(members.join(one, "key"), "jaccard-shingles")
    size = own.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.length("shingles").cast("long")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    units = _blocks(own, "cluster", size)

    def verify(pdf):
        one = pdf["x"].iat[0] == pdf["y"].iat[0]
        pdf = pdf.assign(second=pdf["own"] != pdf["x"]).sort_values(["second", "key"], ignore_index=True)
        sets = [np.frombuffer(s, dtype=np.uint64) for s in pdf["shingles"]]
        i, j = similar(sets, None if one else int((~pdf["second"]).sum()))
        links = np.bincount(np.concatenate([i, j]), minlength=len(pdf))
        order = np.argsort(pdf["key"].to_numpy(), kind="stable")
        rank = np.empty(len(pdf), dtype=np.int64)
        rank[order] = np.arange(len(pdf))
        first = order[_smallest(len(pdf), rank[i], rank[j])][rank]
        return pd.DataFrame({"key": pdf["key"], "links": links, "first": pdf["key"].to_numpy()[first]})

    # dealt by blocks: rows that a join left together by cluster would keep a whole cluster in one task
    return units.repartition("cluster", "x", "y").groupBy("cluster", "x", "y").applyInPandas(verify, "key binary, links long, first binary")


def join(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """row, id, class_id, n_links and first_row for each of docs. row is the row's number (monotonically_increasing_id of docs); class_id the smallest id of all texts that links connect; n_links the number of other distinct texts with a similarity of at least the threshold; first_row the row to keep of the class, the one with the smallest id, then number."""
    signed = written(_signed(docs, text, id_column), "jaccard-signatures")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")
    classes = written(signed.filter("key is not null").groupBy("key").agg(least, F.first("sig").alias("sig")), "jaccard-classes")
    clusters = components(_candidate_edges(classes), "jaccard-clusters")
    checked = written(_verified(docs, text, clusters), "jaccard-links")
    linked = components(checked.filter("first != key").select(F.col("first").alias("a"), F.col("key").alias("b")), "jaccard-groups")
    links = checked.groupBy("key").agg(F.sum("links").alias("n_links"))
    known = classes.select("key", "least").join(linked.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    known = known.withColumn("label", F.coalesce("label", "key"))
    best = known.groupBy("label").agg(F.min("least").alias("best"))
    known = written(known.join(best, "label").select("key", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("best.id").alias("class_id"), F.col("best.row").alias("first_row")), "jaccard-known")
    found = signed.select("row", "id", "key").join(known, "key", "left")
    alone = F.col("key").isNull()
    return found.select("row", "id", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("row")).otherwise(F.col("first_row")).alias("first_row"))


def deduplicated(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows of docs that their class keeps: all columns, one row of each class. docs must give its rows in the same order each time it is read, as a written table does. The numbers of the rows that go are broadcast up to BROADCAST_ROWS; beyond, they are joined by shuffling."""
    number = "_row_of_docs"
    while number in docs.columns:
        number += "_"
    gone = written(join(docs, text, id_column).filter("row != first_row").select(F.col("row").alias(number)), "jaccard-gone")
    return docs.withColumn(number, F.monotonically_increasing_id()).join(few(gone), number, "left_anti").drop(number)
