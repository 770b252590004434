"""Exact dedup with a log-structured merge index of content digests.  DataFrame functions only.

`LsmDigestIndex` keeps sorted runs of (digest, keep_id, copies) in the shared folder:

* *memtable*: the aggregate of one ingest batch, combined in each task before the shuffle: a row per digest.
* *lookup*: before a memtable is flushed its digests are looked up in the runs.  Every run has a filter, a blocked
  Bloom bitmap of `FILTER_WORDS` 64-bit words.  One pass over the probes counts how many each filter lets pass; runs that
  no probe can be in are skipped (`last_read` names those that were read).  Of the others only rows that pass the
  probes' bitmap meet probes that pass the run's, by a join on the digest.
* *flush*: the memtable's rows, with what the lookup found merged in, are cut into ranges of the digest, sorted and
  written as a run of level 0.  So the newest run that holds a digest knows its smallest identifier and its
  number of rows so far.
* *compaction*: once a level holds `fan_in` runs they are merged two by two by sort-merge joins into one run of the next
  level; of each digest the smallest identifier and the largest count stay.

After all batches the digests with more than one row are the hits.  A bitmap of them lets all other rows of the table pass
without a shuffle; rows that hit are compared byte by byte with the text of the row they point at.

Scale: digests are 32 bytes a row, so a run is ~1 % of the text; whole texts move for hits only, pruned by a
bitmap of their ids before the shuffle.  Bitmaps have a constant size (512 KiB); one that fills up stops pruning, and results stay the
same.  A hot digest (a third of all rows) shrinks to a row per task in the memtable; its rows meet one row of the index
through joins that AQE splits, and the row they are compared with is made distinct by digest.

Defined cases: null text counts as empty and empty texts are equal to each other; rows with the same
doc_id and the same text cannot be told apart, so each of them bears the same `kept`; a null doc_id is
kept only in a group without any other id; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, fewer_files, file_number, shared_dir, stored, text_of

SPACES = r"[\x20\x09-\x0D]+"
FILTER_WORDS = 1 << 16
MEMTABLES = 3
FAN_IN = 2
RUN_SCHEMA = "digest binary, keep_id long, copies long"


def normalised(name: str = "text") -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(text_of(name), SPACES, " ")


def _word(digest: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(words))


def _mask(digest: Column) -> Column:
    """Three of the word's 64 bits."""
    h = F.xxhash64(digest, F.lit(17))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 6 * k), F.lit(64)).cast("int")) for k in range(3)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def bloom_row(digests: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """One row holding a blocked Bloom bitmap of column `digest`: array<bigint> of `words` entries.

    The rows that meet in the last step are at most `words`, a constant.
    """
    every = digests.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bits"))
    filled = digests.select(_word(F.col("digest"), words).alias("w"), _mask(F.col("digest")).alias("bits"))
    filled = filled.unionAll(every).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    return filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("bloom"))


def may_hold(bloom: Column, digest: Column, words: int = FILTER_WORDS) -> Column:
    mask = _mask(digest)
    return F.element_at(bloom, (_word(digest, words) + 1).cast("int")).bitwiseAND(mask) == mask


class LsmDigestIndex:
    """Runs of (digest, keep_id, copies), each with its filter, under one shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = FAN_IN):
        self.spark, self.path, self.fan_in = spark, path or shared_dir(spark, "lsm"), fan_in
        self.levels: list[list[str]] = [[]]  # paths of the runs, oldest first
        self.last_read: list[str] = []
        self._next = 0

    def runs(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def run(self, path: str) -> DataFrame:
        """The rows of a run by digest.  Its files are sorted ranges, but Spark reads larger files first."""
        return self._rows(path).orderBy("digest")

    def _rows(self, path: str) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(f"{path}/rows")

    def filter_of(self, path: str) -> Column:
        return self.spark.read.schema("bloom array<bigint>").parquet(f"{path}/filter").scalar()

    def _new(self, digests: DataFrame, level: int) -> str:
        """Names a run and writes its filter."""
        path = f"{self.path}/level={level}/run={self._next}"
        self._next += 1
        bloom_row(digests.select("digest")).coalesce(1).write.parquet(f"{path}/filter")
        return path

    def _write(self, rows: DataFrame, path: str, level: int) -> None:
        """One run: a sorted range of digests in each file."""
        rows.select("digest", "keep_id", "copies").repartitionByRange(file_number(rows), "digest").sortWithinPartitions("digest").write.parquet(f"{path}/rows")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def lookup(self, probes: DataFrame, bloom: Column | None = None) -> DataFrame:
        """(digest, keep_id, copies) of the distinct probes(digest) that the index holds.  bloom: the probes' bitmap."""
        bloom = bloom_row(probes.select("digest")).scalar() if bloom is None else bloom
        filters = {p: self.filter_of(p) for p in self.runs()}
        self.last_read, out = [], self.spark.createDataFrame([], RUN_SCHEMA)
        if filters:
            passed = probes.agg(*[F.sum(may_hold(f, F.col("digest")).cast("long")).alias(f"n{i}") for i, f in enumerate(filters.values())]).first()
            self.last_read = [p for p, n in zip(filters, passed) if n]
        for p in self.last_read:
            asked = probes.where(may_hold(filters[p], F.col("digest"))).select("digest")
            out = out.unionByName(self._rows(p).where(may_hold(bloom, F.col("digest"))).join(asked, "digest"))
        return _combined(out)

    def put(self, batch: DataFrame) -> None:
        """Look up and flush one memtable: `batch` has `digest` and `id`."""
        table = stored(batch.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies")), "lsm-memtable")
        path = self._new(table, 0)
        old = self.lookup(table, self.filter_of(path)).select("digest", F.col("keep_id").alias("old_id"), F.col("copies").alias("old_copies"))
        merged = table.join(old, "digest", "left").select(
            "digest", F.least("keep_id", "old_id").alias("keep_id"), (F.col("copies") + F.coalesce("old_copies", F.lit(0))).alias("copies")
        )
        self._write(merged, path, 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fan_in:
                self.compact(level)

    def compact(self, level: int) -> None:
        """Merge every run of a level into one of the next; the smallest identifier stays."""
        paths, self.levels[level] = self.levels[level], []
        runs = [self._rows(p) for p in paths]
        while len(runs) > 1:
            runs = [_merged(a, b) for a, b in zip(runs[::2], runs[1::2])] + ([runs[-1]] if len(runs) % 2 else [])
        rows = stored(runs[0], "lsm-merged")
        self._write(rows, self._new(rows, level + 1), level + 1)

    def table(self, least: int = 1) -> DataFrame:
        """The digests of all runs that stand for `least` rows or more, with their smallest identifier and rows."""
        out = self.spark.createDataFrame([], RUN_SCHEMA)
        for p in self.runs():
            out = out.unionByName(self._rows(p).where(F.col("copies") >= least))
        return _combined(out)


def _combined(entries: DataFrame) -> DataFrame:
    """Entries of several runs: counts are running ones, so the largest is the newest."""
    return entries.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.max("copies").alias("copies"))


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sorted runs as one, by a full outer sort-merge join."""
    b = b.select("digest", F.col("keep_id").alias("b_id"), F.col("copies").alias("b_copies"))
    return a.hint("merge").join(b, "digest", "full_outer").select("digest", F.least("keep_id", "b_id").alias("keep_id"), F.greatest("copies", "b_copies").alias("copies"))


def exact_dedup(docs: DataFrame, memtables: int = MEMTABLES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    narrow_at = shared_dir(spark, "lsm-digests")
    # the batch of a row follows from its id alone, so a task run again feeds the same memtables
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(memtables)).cast("int").alias("batch")
    fewer_files(base).select("doc_id", "digest", batch).write.partitionBy("batch").parquet(narrow_at)
    narrow = spark.read.schema("doc_id long, digest binary, batch int").parquet(narrow_at)
    index = LsmDigestIndex(spark)
    for b in range(memtables):
        index.put(narrow.where(F.col("batch") == b).select("digest", F.col("doc_id").alias("id")))
    hits = stored(index.table(2), "lsm-hits")

    # rows whose digest stands for them alone pass without a shuffle
    bloom = bloom_row(hits.select("digest")).scalar()
    maybe = may_hold(bloom, F.col("digest"))
    alone = narrow.where(~maybe).select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("copies"))
    met = narrow.where(maybe).join(hits, "digest", "left")
    met = met.select("doc_id", "digest", F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("copies", F.lit(1)).alias("copies"))
    met = stored(met, "lsm-met")

    # Byte verification of the hits: the text of each row against the text of the row it points at.
    # The bitmap is of the hits' ids, so other rows are left out before their text is touched.
    bloom = bloom_row(met.where("copies > 1").select(F.col("doc_id").alias("digest"))).scalar()
    texts = base.where(may_hold(bloom, F.col("doc_id"))).select("doc_id", "norm", "digest")
    # keyed by digest and id, so the first rows of hot groups are found without gathering the groups; one for each digest
    to = hits.select(F.col("digest").alias("hit"), "keep_id")
    firsts = texts.join(to, (F.col("digest") == F.col("hit")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    firsts = firsts.groupBy("digest").agg(F.first("norm").alias("keep_norm"))
    unlike = stored(texts.join(firsts, "digest").where("norm <> keep_norm").select("doc_id", "digest", "norm"), "lsm-unlike")

    if not unlike.isEmpty():  # digest collisions: their groups are formed by the bytes themselves
        clash = unlike.select("digest").distinct()
        same = texts.join(clash, "digest", "left_semi")
        exact = same.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
        met = met.join(clash, "digest", "left_anti").unionByName(same.join(exact, ["digest", "norm"]).select("doc_id", "digest", "keep_id", "copies"))
    return alone.unionByName(met).select(
        "doc_id", "keep_id", F.col("copies").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP3_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
