"""Substring dedup with a run-length index: every byte covered by a 400-byte string that starts elsewhere too.

1. *Anchors*: of the 201 strings of 200 bytes inside a 400-byte window, the leftmost of the smallest hash is the
   window's anchor.  Equal windows have equal anchors at equal places, so a window whose anchor string occurs once
   occurs once.  A text of n bytes has about n / 100 anchors; only (hash, document, window range) is shuffled.
2. *Contexts*: for each repeated anchor the bytes that its windows cover (600 at most).  Equal contexts are
   counted, not repeated.  A context that occurs twice is repeated throughout.
3. *Run-length index*: the distinct contexts of anchors that have several are gathered by anchor into
   shards of bounded size.  A shard's Burrows-Wheeler transform is kept by runs (letter and head) with the suffix-array
   samples at both ends of each run; the suffix array itself is dropped.  The matching statistics are streamed in text order from
   these samples: a place's neighbours in the suffix array are those of the last sample before it, as far on as it is, and its match
   with the lower neighbour is the last run head's less the distance.  Windows with a match of 400 or more are marked.
   `count` searches a pattern backwards through the runs.
4. An anchor with more than `MOST` distinct contexts is not put into one shard: its windows are halved by their
   place about the anchor, each half is grouped anew by the longer string that its windows share, and so on, at
   most 8 times, until groups are small or hold one window each.
5. Marks go back to the documents by joins, and the documents' remaining bytes are hashed.

Scale: hashes are narrow; whole texts are shuffled only for documents that hold a repeated anchor (pruned by a
fixed-size bitmap before the shuffle), never collected.  Hot anchors collapse to counts per task.

Defined cases: null text counts as empty; texts under 400 bytes lose nothing; rows that repeat are documents of
their own, so both copies of a long text go whole; documents are told apart by (doc_id, hash of text); an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import ship
from .dedup import bloom_row, may_hold
from .shared import _BYTE_CODE, batches, documents, fewer_files, mix64, positional_powers, shared_dir, stored, task_number, text_of

LENGTH = 400
CORE = 200
MOST = 512
SHARD = 1_500_000

# ------------------------------------------------------------------ kernels


def anchors_of(texts: list[bytes], length: int = LENGTH, core: int = CORE):
    """(hash, text number, first window, last window, anchor place) for each run of windows with one anchor."""
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n, w = len(data), length - core + 1
    if n < length:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    powers, inverse = positional_powers(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * powers[:n], out=prefix[1:])
    m = n - core + 1
    h = mix64((prefix[core:] - prefix[:m]) * inverse[:m])
    bits = int(m).bit_length()
    mask = np.uint64((1 << bits) - 1)
    key = (h & ~mask) | np.arange(m, dtype=np.uint64)  # ties: leftmost
    rows = -(-m // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:m] = key
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    count = n - length + 1
    place = (np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]) & mask).astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[:count]
    valid = np.arange(count) + length <= ends[owner]
    start = np.flatnonzero(valid & np.concatenate(([True], (place[1:] != place[:-1]) | ~valid[:-1])))
    last = np.flatnonzero(valid & np.concatenate(((place[1:] != place[:-1]) | ~valid[1:], [True])))
    # windows of different texts never share an anchor: it lies inside the window
    text = owner[start]
    base = (ends - sizes)[text]
    return h[place[start]].view(np.int64), text, start - base, last - base, place[start] - base


def suffix_array(sym: np.ndarray, to_sep: np.ndarray) -> np.ndarray:
    """Suffix array of sym (0 separates; every separator is a symbol of its own) by prefix doubling.

    to_sep: distance of each place to the next separator.
    """
    n = len(sym)
    wide = np.concatenate([sym.astype(np.int64), np.zeros(8, dtype=np.int64)])
    h = 7
    key = np.zeros(n, dtype=np.int64)
    alive = np.ones(n, dtype=bool)
    for j in range(h):
        alive &= to_sep > j - 1
        key = key * 257 + np.where(alive, wide[j : j + n], 0)
    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, dtype=bool)
    done = to_sep[order] < h
    fresh[1:] = (key[order][1:] != key[order][:-1]) | done[1:] | done[:-1]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = 0
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = first
    while True:
        # places whose rank is shared
        single = fresh & np.concatenate((fresh[1:], [True]))
        at = np.flatnonzero(~single)
        if not len(at):
            return order
        sub = order[at]
        pair = rank[sub] * (n + 1) + rank[np.minimum(sub + h, n)] + 1
        inner = np.argsort(pair, kind="stable")
        sub, pair = sub[inner], pair[inner]
        order[at] = sub
        new = np.ones(len(at), dtype=bool)
        new[1:] = pair[1:] != pair[:-1]
        fresh[at] = new
        # the first of each old group was fresh before and stays so: its pair differs from the group before
        heads = np.maximum.accumulate(np.where(new, at, 0))
        rank[sub] = heads
        h *= 2


class RunLengthIndex:
    """Run-length Burrows-Wheeler transform of contexts, with suffix-array samples at the run ends."""

    def __init__(self, contexts: list[bytes]):
        joined = b"\0".join(contexts) + b"\0"
        raw = np.frombuffer(joined, dtype=np.uint8)
        sizes = np.fromiter((len(c) + 1 for c in contexts), dtype=np.int64, count=len(contexts))
        self.ends = np.cumsum(sizes) - 1  # separators
        self.starts = self.ends - sizes + 1
        n = len(raw)
        is_sep = np.zeros(n, dtype=bool)
        is_sep[self.ends] = True
        sym = np.where(is_sep, 0, raw.astype(np.int16) + 1)
        self.to_sep = np.repeat(self.ends, sizes) - np.arange(n)
        self.raw = raw
        sa = suffix_array(sym, self.to_sep)
        # separators differ from one another, so each makes a run of its own
        prev = sa - 1
        letters = np.where(prev >= 0, sym[prev], 0)
        head = np.ones(n, dtype=bool)
        head[1:] = (letters[1:] != letters[:-1]) | (letters[1:] == 0)
        at = np.flatnonzero(head)
        self.heads, self.letters = at, letters[at]  # run-length BWT
        self.run_starts = sa[at]  # suffix-array samples at both ends of each run
        self.run_ends = sa[np.concatenate((at[1:], [n])) - 1]
        self.n = n

    def count(self, patterns: list[bytes]) -> np.ndarray:
        """How often each pattern occurs, by backward search through the runs, one letter of all patterns at a time."""
        lengths = np.diff(np.append(self.heads, self.n))
        order = np.argsort(self.letters, kind="stable")  # runs by letter, then by place
        letters, heads, sizes = self.letters[order].astype(np.int64), self.heads[order], lengths[order]
        before = np.concatenate(([0], np.cumsum(sizes)))  # letters in the runs before, smaller letters included
        keys = letters * (self.n + 1) + heads
        smaller = before[np.searchsorted(letters, np.arange(258))]  # letters smaller than c in the whole transform

        def rank(c, i):
            """Smaller letters, and letters c among the first i."""
            k = np.searchsorted(keys, c * (self.n + 1) + i, "left") - 1
            inside = (k >= 0) & (letters[k] == c)
            return np.where(inside, before[k] + np.minimum(sizes[k], i - heads[k]), smaller[c])

        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        size = np.array([len(p) for p in patterns], dtype=np.int64)
        data = np.frombuffer(b"".join(patterns), dtype=np.uint8)
        last = np.cumsum(size)
        for step in range(1, int(size.max(initial=0)) + 1):
            live = np.flatnonzero((size >= step) & (lo < hi))
            if not len(live):
                break
            c = data[last[live] - step].astype(np.int64) + 1
            lo[live], hi[live] = rank(c, lo[live]), rank(c, hi[live])
        return np.maximum(hi - lo, 0)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefixes of suffixes a and b, eight bytes at a time."""
        most = np.minimum(self.to_sep[a], self.to_sep[b])
        words = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.raw, np.zeros(8, dtype=np.uint8)]), 8)
        out, live, off = most.copy(), np.flatnonzero(most > 0), 0
        while len(live):
            x = np.ascontiguousarray(words[np.minimum(a[live] + off, self.n)]).view(np.uint64)[:, 0]
            y = np.ascontiguousarray(words[np.minimum(b[live] + off, self.n)]).view(np.uint64)[:, 0]
            d = x ^ y
            hit = d != 0
            low = d[hit] & (~d[hit] + np.uint64(1))
            out[live[hit]] = np.minimum(out[live[hit]], off + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3))
            off += 8
            live = live[~hit]
            live = live[out[live] > off]
        return out

    def _last(self, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place in text order the run whose sample is the last at or before it, and the distance to that sample."""
        run = np.full(self.n, -1, dtype=np.int64)
        run[samples] = np.arange(len(samples))
        j = np.arange(self.n)
        at = np.maximum.accumulate(np.where(run >= 0, j, 0))  # place 0 has a run of its own
        return run[at], j - at

    def matching_statistics(self) -> np.ndarray:
        """For each text place the longest match with any other place, within contexts."""
        # the suffix before a run's first one is the end of the run before
        lcp_heads = np.zeros(len(self.heads), dtype=np.int64)
        lcp_heads[1:] = self._common(self.run_ends[:-1], self.run_starts[1:])
        run, away = self._last(self.run_starts)
        lower = np.maximum(lcp_heads[run] - away, 0)  # the match with the suffix before
        # the suffix behind a run's last one is the start of the next run; places after the sample move along
        run, away = self._last(self.run_ends)
        after = np.append(self.run_starts[1:], 0)[run] + away
        some = run < len(self.heads) - 1
        return np.maximum(lower, np.where(some, lower[np.where(some, after, 0)], 0))

    def repeated(self, length: int = LENGTH) -> list[list[tuple[int, int]]]:
        """Per context the ranges (first, last) of window starts that occur elsewhere in the index."""
        mark = (self.matching_statistics() >= length) & (self.to_sep >= length)
        edge = np.diff(np.concatenate(([0], mark.view(np.int8), [0])))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        out: list[list[tuple[int, int]]] = [[] for _ in self.starts]
        for k, x, y in zip(np.searchsorted(self.starts, a, "right") - 1, a.tolist(), b.tolist()):
            out[k].append((x - int(self.starts[k]), y - int(self.starts[k])))
        return out


# ------------------------------------------------------------------ stages

_HIT = "array<struct<h:long,lo:int,hi:int,p:int>>"
_PLACE = "h long, cd binary, amin int, amax int, d long, t long, lo int"
_CTX = "h long, cd binary, amin int, amax int, m long, ctx binary"
_RANGES = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _anchor_rows(batches_):
    for batch in batches_:
        texts = batch.column("text").to_pylist()
        d, t = batch.column("d"), batch.column("t")
        for a, b in batches(texts, 1_000_000):
            h, text, lo, hi, p = anchors_of([x.encode("utf-8", "surrogatepass") for x in texts[a:b]])
            at = pa.array(text + a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), d.take(at), t.take(at), *(pa.array(x.astype(np.int32)) for x in (lo, hi, p))],
                names=["h", "d", "t", "lo", "hi", "p"],
            )


def _digest(ctx: bytes, amax: int) -> bytes:
    return hashlib.blake2b(ctx, digest_size=16, salt=amax.to_bytes(4, "little", signed=True)).digest()


def _batch(rows, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], names=[n for n, _ in fields])


def _place_rows(batches_):
    """Each hit's context by its digest, and where it lies."""
    for batch in batches_:
        texts, hits = batch.column("text").to_pylist(), batch.column("hits").to_pylist()
        rows = []
        for text, found, d, t in zip(texts, hits, batch.column("d").to_pylist(), batch.column("t").to_pylist()):
            raw = text.encode("utf-8", "surrogatepass")
            for x in found:
                h, lo, hi, p = x["h"], x["lo"], x["hi"], x["p"]
                rows.append((h, _digest(raw[lo : hi + LENGTH], p - lo), p - hi, p - lo, d, t, lo))
        yield _batch(rows, _PLACE)


def _context_rows(batches_):
    """The bytes of the wanted contexts."""
    for batch in batches_:
        rows, size = [], 0
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            raw = text.encode("utf-8", "surrogatepass")
            for x in wanted:
                ctx = raw[x["lo"] : x["lo"] + x["amax"] - x["amin"] + LENGTH]
                size += len(ctx)
                rows.append((x["h"], x["cd"], x["amin"], x["amax"], x["m"], ctx))
            if size > 4_000_000:
                yield _batch(rows, _CTX)
                rows, size = [], 0
        yield _batch(rows, _CTX)


def _index_rows(batches_):
    """Rows (key, cd, ctx) in the order of key -> (key, cd, ranges); shards are cut between keys."""
    keys, cds, ctxs, size, seen = [], [], [], 0, set()

    def flush():
        found = RunLengthIndex(ctxs).repeated()
        rows = [(k, c, [{"first": a, "last": b} for a, b in r]) for k, c, r in zip(keys, cds, found) if r]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], _RANGES)], names=["key", "cd", "ranges"]
        )

    for batch in batches_:
        for key, cd, ctx in zip(batch.column("key").to_pylist(), batch.column("cd").to_pylist(), batch.column("ctx").to_pylist()):
            if not keys or key != keys[-1]:
                if size > SHARD:
                    yield flush()
                    keys, cds, ctxs, size = [], [], [], 0
                seen = set()
            if cd in seen:  # rows that repeat hand in their contexts again
                continue
            seen.add(cd)
            keys.append(key)
            cds.append(cd)
            ctxs.append(ctx)
            size += len(ctx)
    if keys:
        yield flush()


def _halve_rows(batches_):
    """Splits the windows of each row at the middle of its group's range of places [a0, a1].

    A window's place a is the distance from its start to the anchor; all windows with places in
    [x, y] share the bytes from anchor - x to anchor + LENGTH - y, whose hash groups them anew.
    """
    for batch in batches_:
        out = []
        for r in batch.to_pylist():
            middle = (r["a0"] + r["a1"] + 1) // 2
            for x, y in ((r["a0"], middle - 1), (middle, r["a1"])):
                amin, amax = max(x, r["amin"]), min(y, r["amax"])
                if amin > amax:
                    continue
                skip = r["amax"] - amax  # windows left out at the front
                ctx = r["ctx"][skip : skip + (amax - amin) + LENGTH]
                core = r["ctx"][r["amax"] - x : r["amax"] - y + LENGTH]
                key = hashlib.blake2b(core, digest_size=8, salt=f"{x}:{y}".encode()[:16], person=r["key"].to_bytes(8, "little", signed=True)).digest()
                out.append((r["h"], r["root"], r["shift"] + skip, int.from_bytes(key, "little", signed=True), _digest(ctx, amax), amin, amax, x, y, ctx))
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), *[pa.int32()] * 4, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 10, kinds)], names=["h", "root", "shift", "key", "cd", "amin", "amax", "a0", "a1", "ctx"])


def _indexed(contexts: DataFrame) -> DataFrame:
    """(key, cd, ranges) from distinct contexts (key, cd, ctx)."""
    dealt = contexts.select("key", "cd", "ctx").repartition(task_number(contexts), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_index_rows, "key long, cd binary, ranges array<struct<first:int,last:int>>")


def _split_marks(big: DataFrame) -> DataFrame:
    """(h, cd, ranges) of the contexts whose anchors have too many, level by level."""
    schema = "h long, root binary, shift int, key long, cd binary, amin int, amax int, a0 int, a1 int, ctx binary"
    rows = big.select("h", F.col("cd").alias("root"), F.lit(0).alias("shift"), F.col("h").alias("key"), "cd", "amin", "amax", F.lit(0).alias("a0"), F.lit(LENGTH - CORE).alias("a1"), "ctx")
    out = None
    for _ in range((LENGTH - CORE).bit_length() + 1):
        rows = stored(rows.mapInArrow(_halve_rows, schema), "rindex-split")
        stats = stored(rows.groupBy("key", "cd").agg(F.count(F.lit(1)).alias("n")), "rindex-split", narrow=True)
        groups = stored(stats.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "rindex-split", narrow=True)
        whole = rows.join(stats.where("n > 1").select("key", "cd"), ["key", "cd"]).select(
            "h", F.col("root").alias("cd"), F.array(F.struct(F.col("shift").alias("first"), (F.col("shift") + F.col("amax") - F.col("amin")).alias("last"))).alias("ranges")
        )
        wide = rows.join(groups, "key")
        small = wide.where(F.col("m") <= MOST).groupBy("key", "cd").agg(F.any_value("ctx").alias("ctx"))
        part = rows.drop("ctx").join(stored(_indexed(small), "rindex-split"), ["key", "cd"]).select(
            "h",
            F.col("root").alias("cd"),
            F.transform("ranges", lambda r: F.struct((r["first"] + F.col("shift")).alias("first"), (r["last"] + F.col("shift")).alias("last"))).alias("ranges"),
        )
        found = whole.unionByName(part)
        out = found if out is None else out.unionByName(found)
        # one window each cannot be halved: equal ones were counted, others differ
        rows = stored(wide.where((F.col("m") > MOST) & (F.col("a0") < F.col("a1"))).drop("m"), "rindex-split")
        if rows.isEmpty():
            break
    return out.groupBy("h", "cd").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(d, t, ranges): for each document (by doc_id and hash of text) the byte ranges [first, last] to remove, not merged."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), text_of().alias("text")).withColumn("t", F.xxhash64("text"))
    long_ones = texts.where(F.octet_length("text") >= LENGTH)
    anchors = stored(long_ones.mapInArrow(_anchor_rows, "h long, d long, t long, lo int, hi int, p int"), "rindex-anchors")
    repeated = stored(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "rindex-repeated", narrow=True)
    hits = anchors.join(repeated, "h").groupBy(F.col("d").alias("hd"), F.col("t").alias("ht")).agg(F.collect_set(F.struct("h", "lo", "hi", "p")).alias("hits"))
    hits = stored(hits, "rindex-hits")
    bloom = bloom_row(hits.select(F.col("hd").alias("digest"))).scalar()
    held = long_ones.where(may_hold(bloom, F.col("d"))).join(hits, F.col("d").eqNullSafe(F.col("hd")) & (F.col("t") == F.col("ht")))
    places = stored(held.select("d", "t", "text", "hits").mapInArrow(_place_rows, _PLACE), "rindex-places")

    # one of a context's places stands for it; only contexts of anchors with several are cut out
    one = F.min(F.struct("d", "t", "lo")).alias("o")
    stats = stored(places.groupBy("h", "cd").agg(F.count(F.lit(1)).alias("n"), F.min("amin").alias("amin"), F.min("amax").alias("amax"), one), "rindex-stats")
    groups = stored(stats.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "rindex-groups", narrow=True)
    wanted = stats.join(groups, "h").groupBy(F.col("o.d").alias("hd"), F.col("o.t").alias("ht")).agg(F.collect_list(F.struct("h", "cd", "amin", "amax", "m", "o.lo")).alias("wanted"))
    wanted = stored(wanted, "rindex-wanted")
    bloom = bloom_row(wanted.select(F.col("hd").alias("digest"))).scalar()
    asked = long_ones.where(may_hold(bloom, F.col("d"))).join(wanted, F.col("d").eqNullSafe(F.col("hd")) & (F.col("t") == F.col("ht")))
    at = shared_dir(docs.sparkSession, "rindex-contexts")
    fewer_files(asked.select("text", "wanted").mapInArrow(_context_rows, _CTX)).write.option("compression", "zstd").parquet(at)
    contexts = docs.sparkSession.read.schema(_CTX).parquet(at)
    small = contexts.where(F.col("m") <= MOST).select(F.col("h").alias("key"), "cd", "ctx")
    marks = _indexed(small).withColumnRenamed("key", "h")
    if not groups.where(F.col("m") > MOST).isEmpty():
        marks = marks.unionByName(_split_marks(contexts.where(F.col("m") > MOST)))
    single = stats.where("n = 1").select("h", "cd")
    marks = marks.join(single, ["h", "cd"], "left_semi")
    whole = stats.where("n > 1").select("h", "cd", F.array(F.struct(F.lit(0).alias("first"), (F.col("amax") - F.col("amin")).alias("last"))).alias("ranges"))
    marks = stored(whole.unionByName(marks), "rindex-marks")

    placed = places.select("h", "cd", "d", "t", "lo").join(marks, ["h", "cd"])
    placed = placed.select("d", "t", F.transform("ranges", lambda r: F.struct((r["first"] + F.col("lo")).alias("first"), (r["last"] + F.col("lo") + LENGTH - 1).alias("last"))).alias("r"))
    return placed.groupBy("d", "t").agg(F.flatten(F.collect_list("r")).alias("ranges"))


def _cut(raw: bytes, ranges) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs)."""
    spans: list[list[int]] = []
    for a, b in sorted((r["first"], r["last"]) for r in ranges):
        if spans and a <= spans[-1][1] + 1:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b + 1
    kept.append(raw[at:])
    return b"".join(kept), sum(b - a + 1 for a, b in spans), len(spans)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes; null where nothing went)."""
    ranges = stored(repeated_ranges(docs).select(F.col("d").alias("rd"), F.col("t").alias("rt"), "ranges"), "rindex-ranges")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("t", F.xxhash64("text"))
    bloom = bloom_row(ranges.select(F.col("rd").alias("digest"))).scalar()
    marked = texts.where(may_hold(bloom, F.col("doc_id"))).join(ranges, F.col("doc_id").eqNullSafe(F.col("rd")) & (F.col("t") == F.col("rt")))

    def cut(batches_):
        for batch in batches_:
            done = [_cut(x.encode("utf-8", "surrogatepass"), r) for x, r in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
                names=["md", "mt", "kept", "n_removed", "n_spans"],
            )

    cuts = marked.select("doc_id", "t", "text", "ranges").mapInArrow(cut, "md long, mt long, kept binary, n_removed long, n_spans long")
    # repeated rows give the same cut: one of them serves both
    cuts = cuts.withColumn("cut_sha256", F.sha2("kept", 256))
    return texts.select("doc_id", "t", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256")), cuts


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    whole, cuts = remove_repeats(docs)
    cuts = cuts.groupBy("md", "mt").agg(F.first("n_removed").alias("n_removed"), F.first("n_spans").alias("n_spans"), F.first("cut_sha256").alias("cut_sha256"))
    both = whole.join(cuts, F.col("doc_id").eqNullSafe(F.col("md")) & (F.col("t") == F.col("mt")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))
