"""What the operators of this subpackage share: shared folders, held-out folds, text as numpy arrays."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

#: Characters that one vectorised pass takes at once; bounds the arrays of a Python worker.
CHUNK_CHARS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set (tests on one machine), one is made."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = spark.sparkContext.getCheckpointDir()
    if made is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="emberframe-"))
        made = spark.sparkContext.getCheckpointDir()
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/emberframe/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Removes all tables that operators left below the shared folder. For use when no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/emberframe")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows, and bytes on average, that a Python worker turns into objects at once; texts may be long, and a worker holds them in several forms.
BATCH_ROWS, BATCH_BYTES = 1_000, 1 << 24


def _bounded(spark: SparkSession) -> None:
    """Asks the session for batches of BATCH_ROWS rows, since the JVM builds them too. Nothing relies on it, and a size that the session was built with stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark.sparkContext.getConf().contains(name) and not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _slices(batches):
    """Arrow batches, whatever size the session gives them, in slices of BATCH_ROWS rows at most."""
    for batch in batches:
        step = max(1, min(BATCH_ROWS, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def by_batches(df: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """function: from an iterator of pandas frames of BATCH_ROWS rows at most to such of the schema. Whole numbers stay exact beside nulls."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    _bounded(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        kind = to_arrow_schema(schema)
        for out in function(part.to_pandas(integer_object_nulls=True) for part in _slices(batches)):
            yield pa.RecordBatch.from_pandas(out, schema=kind, preserve_index=False)

    return df.mapInArrow(run, schema)


def adding(docs: DataFrame, text: str, make, fields: list[T.StructField]) -> DataFrame:
    """docs with more columns, which give way to columns of the same names. make() gives, once a task, a function from a list of texts (None for what isn't a string) to a list of values for each field. Other columns pass through untouched."""
    keep = [c for c in docs.columns if c not in {f.name for f in fields}]
    schema = T.StructType([*(docs.schema[c] for c in keep), *fields])
    _bounded(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        function, kinds = make(), [to_arrow_type(f.dataType) for f in fields]
        for part in _slices(batches):
            made = function([t if isinstance(t, str) else None for t in part.column(keep.index(text)).to_pylist()])
            names = [*part.schema, *(pa.field(f.name, k) for f, k in zip(fields, kinds))]
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, type=k) for x, k in zip(made, kinds))], schema=pa.schema(names))

    return docs.select(*keep).mapInArrow(run, schema)


#: Rows with a key and little else up to which they are broadcast.
BROADCAST_ROWS = 1_000_000


def few(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, marked for broadcast if it has ``most`` (BROADCAST_ROWS) rows or fewer. df must be cheap to count, as a written table is."""
    most = most or BROADCAST_ROWS
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def codes(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def runs(texts: list[str], most: int | None = None):
    """Slices (from, to) of texts with about ``most`` (CHUNK_CHARS) characters each; a longer text is alone."""
    most, begin, size = most or CHUNK_CHARS, 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


_SPACE = re.compile(r"\s")


def pieces(text: str, most: int | None = None):
    """The text in parts of about ``most`` (CHUNK_CHARS) characters, each but the last ending with a space; a longer run without spaces is not cut."""
    most, at = most or CHUNK_CHARS, 0
    while len(text) - at > most:
        found = _SPACE.search(text, at + most - 1)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    if at < len(text):
        yield text[at:] if at else text


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class HashTable:
    """An open-addressing table from 64-bit keys to rows of an array, built and read by numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.keys, self.values, self.full = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=values.dtype), np.zeros(size, dtype=bool)
        left, at = np.arange(len(keys)), self._slot(keys.astype(np.uint64))
        keys = keys.astype(np.uint64)
        while len(left):
            free = np.flatnonzero(~self.full[at])
            slots, first = np.unique(at[free], return_index=True)
            put = left[free[first]]
            self.keys[slots], self.values[slots], self.full[slots] = keys[put], values[put], True
            rest = np.ones(len(left), dtype=bool)
            rest[free[first]] = False
            left, at = left[rest], (at[rest] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, and which keys are there; the value of another key is 0."""
        at = self._slot(keys)
        full = self.full[at]
        there = full & (self.keys[at] == keys)
        out = np.where(there, self.values[at], self.values.dtype.type(0))
        look = np.flatnonzero(full & ~there)
        at = at[look]
        while len(look):
            at = (at + 1) % len(self.keys)
            same = self.full[at] & (self.keys[at] == keys[look])
            out[look[same]], there[look[same]] = self.values[at[same]], True
            go = self.full[at] & ~same
            look, at = look[go], at[go]
        return out, there


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights, the intercept last, by Newton's method on standardised columns."""
    if not len(y) or y.min() == y.max():
        rate = (float(y.sum()) + 0.5) / (len(y) + 1)
        return np.concatenate([np.zeros(x.shape[1]), [np.log(rate / (1 - rate))]])
    mean, scale = x.mean(0), x.std(0) + 1e-12
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge * len(y) ** 0.5)
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty) + 1e-9 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, z.T @ (p - y) + penalty * w), -4, 4)
    return np.concatenate([w[:-1] / scale, [w[-1] - float((w[:-1] * mean / scale).sum())]])


def hash_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of the key, so that the choice doesn't depend on the partitioning."""
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < int((1 << 30) * most / n))


def let(value: Column, body) -> Column:
    """body(value), where value is computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
