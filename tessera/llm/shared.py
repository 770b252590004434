"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import ship
from ..sources import work


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder for an intermediate table, where driver and executors see it."""
    return work.fresh(spark, tag)


FILE_BYTES, NARROW_BYTES = 16 << 20, 128 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, by the optimizer's statistics; unknown sources count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def file_number(df: DataFrame, narrow: bool = False) -> int:
    """One file for each core of the cluster, or more where that makes over 16 MB of input each (narrow rows: one for each 128 MB)."""
    cores, size = df.sparkSession.sparkContext.defaultParallelism, input_bytes(df)
    return max(1, size // NARROW_BYTES) if narrow else max(cores, size // FILE_BYTES)


def task_number(df: DataFrame) -> int:
    """Partitions for whole rows of df: the session's number, or more where that makes over 128 MB of input each."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df) // NARROW_BYTES)


def laid_in_order(df: DataFrame) -> bool:
    """Whether df's partitions are ranges of an order, as repartitionByRange makes them."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Sort"):
        node = node.children().head()
    if node.nodeName() != "RepartitionByExpression":
        return False
    by = node.partitionExpressions()
    return by.size() > 0 and all(by.apply(i).nodeName() == "SortOrder" for i in range(by.size()))


def fewer_files(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Many small partitions are read in turn, without a shuffle, down to file_number.  Rows laid in order stay as they
    are: coalesce joins partitions by where they lie, not by their numbers, and would mix the ranges."""
    return df if laid_in_order(df) else df.coalesce(file_number(df, narrow))


def stored(df: DataFrame, tag: str, narrow: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    narrow: the rows are a few numbers each, so few files hold them.
    """
    path = shared_dir(ship(df.sparkSession), tag)
    fewer_files(df, narrow).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is small and lies in fewer partitions: a row group is read by one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if input_bytes(df) > cores * FILE_BYTES:
        return df
    filled = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df.repartition(cores) if 0 < filled < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(ship(spark).read.parquet(f"{sf_dir}/documents.parquet"))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns of an operator's own that df does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of "name type, ..."; unlike createDataFrame([]) it starts no Python workers on the executors."""
    return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in schema.split(", "))])


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# ---------------------------------------------------------------------------
# Memory of the Python workers.  Workers outlive their tasks, two or more beside each executor's JVM, and what one has
# freed or keeps for later would stay with it through all stages of a program.

_CACHED: dict = {}
_OWNER: list[str] = [""]


def give_back() -> None:
    """Freed memory goes back to the system."""
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)


def frugal(name: str):
    """For functions given to mapInArrow: what a worker keeps in _CACHED lasts while the tasks of one operator (`name`) follow
    one another, and freed memory goes back when a task ends."""

    def wrapped(scan):
        @wraps(scan)
        def run(batches_):
            if _OWNER[0] != name:
                _CACHED.clear()
                give_back()
                _OWNER[0] = name
            try:
                yield from scan(batches_)
            finally:
                give_back()

        return run

    return wrapped


# ---------------------------------------------------------------------------
# Arrays


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often `use` (or a lambda inside it) reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


CHUNK = 128


def prefix_sums(numbers: Column) -> Column:
    """The running sums of an array of numbers, as array<bigint>.

    Sums are formed in chunks that are then shifted: appending to one growing array would copy it each time.
    """
    last = lambda c: F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(0).cast("long"))
    empty = F.array().cast("array<bigint>")
    running = lambda c: F.aggregate(c, empty, lambda acc, x: F.concat(acc, F.array(last(acc) + x)))

    def whole(a):
        starts = F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), F.lit(CHUNK))
        return bound(F.transform(starts, lambda s: running(F.slice(a, s + 1, F.lit(CHUNK)))), shifted)

    def shifted(chunks):
        sums = running(F.transform(chunks, last))
        return F.flatten(F.zip_with(chunks, sums, lambda c, b: F.transform(c, lambda x: x + b - last(c))))

    return bound(numbers, whole)


# ---------------------------------------------------------------------------
# Byte-level words of many texts at once.
#
# A word is a maximal run of bytes out of [0-9a-z_] and >= 0x80 in the lower-cased UTF-8 text.
# Its hash is a polynomial in an odd base modulo 2^64, so a prefix sum gives every word's hash.

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz_", dtype=np.uint8)] = True
_IS_WORD[0x80:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE_CODE = (np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[starts:ends].  Equal content gives equal hashes wherever it lies."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    powers, inverse = positional_powers(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * powers[:n], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def positional_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n; kept while small."""
    have = _CACHED.get("pow")
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        pow_, inv = _powers(_BASE, size), _powers(_BASE_INV, size)
        if size > 1 << 23:
            return pow_[:n], inv[:n]
        _CACHED["pow"], _CACHED["inv"] = pow_, inv
    return _CACHED["pow"][:n], _CACHED["inv"][:n]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of lower-cased bytes."""
    flags = np.zeros(len(data) + 2, dtype=np.int8)
    flags[1:-1] = _IS_WORD[data]
    edge = np.diff(flags)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, the first word of each text (length n+1),
    and the byte spans of the words in the joined lower-cased text."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    sizes = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    starts, ends = word_spans(data)
    first = np.searchsorted(starts, bounds)
    return span_hashes(data, starts, ends), first, starts, ends


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of each n consecutive words; entry i starts at word i."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    size = len(words) - n + 1
    acc = np.zeros(size, dtype=np.uint64)
    for j in range(n):
        acc = acc * _BASE + words[j : j + size]
    return mix64(acc)


def batches(texts: list[str], limit: int = 1_000_000):
    """Index ranges of texts whose joined length stays near limit characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


# ---------------------------------------------------------------------------


def connected_components(edges: DataFrame, tag: str, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in edges(a, b); component is the smallest id reached.

    Alternating large-star and small-star steps (Kiveris et al., 2014): O(log^2 n) rounds, each round
    written to the shared folder.  Star steps only ever send a node's neighbours through an aggregate
    `min` and a join, so no neighbourhood is collected.  The minima are written first, so the joins stand
    between plain exchanges, which AQE splits where one hub is hot.
    """
    pairs = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        f"{tag}-cc",
        narrow=True,
    )
    for _ in range(max_rounds):
        # no key is hot in what one task could hold, so one job does a round
        kept = (lambda df: stored(df, f"{tag}-cc", narrow=True)) if input_bytes(pairs) > FILE_BYTES else (lambda df: df)
        # large-star: every neighbour larger than u is linked to u's smallest neighbour (or u itself)
        both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = kept(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small-star: smaller neighbours of u and u itself are linked to the smallest of them
        low = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        pairs = stored(small, f"{tag}-cc", narrow=True)
        # done when every node has one parent and no parent has a parent: the set is a forest of stars
        parents = pairs.select("v").join(pairs.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        twice = pairs.groupBy("u").count().where("count > 1").select(F.col("u").alias("v"))
        if parents.unionAll(twice).isEmpty():
            break
    else:
        raise RuntimeError("connected components did not settle")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
