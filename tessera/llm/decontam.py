"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over some consecutive words ignore some positions, so changed words fall into the gaps of at
least one mask.  There is a set of masks for each length of item (`MASKS`), found by search, that hits every way to change as many
words as the rule below lets pass: none that it accepts is lost (tests/llm enumerates them).  Items of up to 4 words have to
agree in all words, so their mask is the item and each hit is a place.
Words at the kept positions are hashed; hashes of the benchmark and of the documents
are joined; and around each hit the two texts are laid side by side (same distance between word
positions) and compared word by word: an overlap counts when some window of min(`WINDOW`, length of the item) words
agrees in `AGREE` of them.

Scale: the documents are read once and no text is shuffled: the join is a broadcast hash join with a table of one
block of the benchmark, which holds at most `BLOCK_WORDS` words (its size is checked; a larger benchmark
is done in blocks, one pass each, as a shuffle of the corpus's hashes, several for each word, would move many times the corpus).
Every document is independent, so hot passages only cost their own verification.

Defined cases: null and empty texts and items hold nothing; items of any number of words from one on are searched for,
and who drops documents may want `best_words` to be `LEAST_WORDS` or more, as shorter items are ordinary phrases; repeated rows
and repeated items each count; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import ship
from .shared import batches, documents, empty, frugal, mix64, text_of, words_of

# The masks for items of so many words or more.  From 5 words on one may differ, from 10 two, from 15 three,
# and four in the windows of 20; what hits each set of changes in a shorter window does so in a longer one.
MASKS = {
    1: ["1"],
    2: ["11"],
    3: ["111"],
    4: ["1111"],
    5: ["1111", "10111", "11011", "11101"],
    10: ["1101111", "11110011", "110011011", "110101011", "10111101"],
    15: ["11101011", "11100100011", "1101000111"],
    20: ["1101111", "1100010111", "1000110100011"],
}
WINDOW = 20
AGREE = 0.8
LEAST_WORDS = 5
BLOCK_WORDS = 2_000_000

_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
SCHEMA = "doc_id long, t long, item_id long, n_places long, best_start long, best_words long, best_matches long"


def masked_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the kept words of each window of len(mask) words."""
    n = len(words) - len(mask) + 1
    acc = np.zeros(max(n, 0), dtype=np.uint64)
    for j, kept in enumerate(mask):
        if kept == "1":
            acc = acc * _MULTIPLIER + words[j : j + len(acc)]
    return mix64(acc + np.uint64(len(mask)))


class SeedTable:
    """Masked hashes of one block of benchmark items."""

    BITS = 1 << 22

    def __init__(self, items: list[tuple[int, str]]):
        self.words, first, _, _ = words_of([t or "" for _, t in items])
        self.ids, self.first = [i for i, _ in items], first
        lengths = np.diff(first)
        owner = np.repeat(np.arange(len(items)), lengths)
        room = np.concatenate([np.arange(n, 0, -1) for n in lengths]) if len(items) else np.zeros(0, int)  # words left in the item
        longest = np.array(sorted(MASKS))
        group = np.where(lengths < 1, 0, longest[np.maximum(np.searchsorted(longest, lengths, "right") - 1, 0)])
        self.tables, self.short = [], []
        for g in sorted(set(group.tolist()) & set(range(1, LEAST_WORDS))):
            items_ = np.flatnonzero(group == g)
            self.short.append((MASKS[g][0], *self._sorted(masked_hashes(self.words, MASKS[g][0])[first[items_]], items_)))
        for mask in sorted({m for g in set(group.tolist()) - set(range(LEAST_WORDS)) for m in MASKS[g]}):
            h = masked_hashes(self.words, mask)
            at = np.flatnonzero(room[: len(h)] >= len(mask))
            at = at[np.isin(group[owner[at]], [g for g in MASKS if g >= LEAST_WORDS and mask in MASKS[g]])]
            self.tables.append((mask, *self._sorted(h[at], at)))
        self.owner = owner

    def _sorted(self, h: np.ndarray, places: np.ndarray):
        order = np.argsort(h, kind="stable")
        bits = np.zeros(self.BITS, dtype=bool)
        bits[(h % np.uint64(self.BITS)).astype(np.int64)] = True
        return h[order], places[order], np.packbits(bits)

    def _hits(self, words: np.ndarray, first: np.ndarray, mask: str, keys: np.ndarray, packed: np.ndarray):
        """(word, text, first key, last key + 1) of the words at which a window with a known hash begins."""
        h = masked_hashes(words, mask)
        bit = (h % np.uint64(self.BITS)).astype(np.int64)
        at = np.flatnonzero((packed[bit >> 3] << (bit & 7).astype(np.uint8)) & 0x80)  # not unpacked: that would be 4 MB for each mask and worker
        lo, hi = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        text = np.searchsorted(first, at, "right") - 1
        inside = at + len(mask) <= first[text + 1]
        return at[inside], text[inside], lo[inside], hi[inside]

    def exact(self, words: np.ndarray, first: np.ndarray):
        """(text, item, places, first word, words) for the short items, which agree as a whole."""
        for mask, keys, items, packed in self.short:
            at, text, lo, hi = self._hits(words, first, mask, keys, packed)
            n = hi - lo
            which = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, int)
            pair = np.repeat(text, n) * len(self.ids) + items[which]
            found, begin, places = np.unique(pair, return_index=True, return_counts=True)
            at = np.repeat(at - first[text], n)[begin]
            yield from zip((found // len(self.ids)).tolist(), (found % len(self.ids)).tolist(), places.tolist(), at.tolist(), itertools.repeat(len(mask)))

    def search(self, words: np.ndarray, first: np.ndarray):
        """(text, item, distance) of all hits: distance is the text's word position less the item's."""
        found = set()
        for mask, keys, places, packed in self.tables:
            hits = self._hits(words, first, mask, keys, packed)
            for p, d, a, b in zip(*(x.tolist() for x in hits)):
                for q in places[a:b].tolist():
                    item = int(self.owner[q])
                    found.add((d, item, (p - int(first[d])) - (q - int(self.first[item]))))
        return found

    def overlap(self, words: np.ndarray, item: int, distance: int) -> tuple[int, int, int] | None:
        """(first word, words, matches) of the longest agreeing stretch on this diagonal, if one is good enough."""
        bench = self.words[self.first[item] : self.first[item + 1]]
        a, b = max(0, distance), min(len(words), distance + len(bench))
        same = words[a:b] == bench[a - distance : b - distance]
        size = min(WINDOW, len(bench))
        if len(same) < size:
            return None
        sums = np.concatenate(([0], np.cumsum(same)))
        good = np.flatnonzero(sums[size:] - sums[:-size] >= math.ceil(AGREE * size))
        if not len(good):
            return None
        # good windows that touch one another form one stretch; the longest is reported
        cut = np.flatnonzero(np.diff(good) > size)
        begins, ends = good[np.concatenate(([0], cut + 1))], good[np.concatenate((cut, [len(good) - 1]))] + size
        k = int(np.argmax(ends - begins))
        return a + int(begins[k]), int(ends[k] - begins[k]), int(sums[ends[k]] - sums[begins[k]])


def _blocks(benchmark: DataFrame):
    items, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).toLocalIterator():
        items.append((r["item_id"], r["text"]))
        size += len(r["text"]) // 2 + 1  # words at most
        if size >= BLOCK_WORDS:
            yield items
            items, size = [], 0
    if items:
        yield items


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per pair of document and benchmark item that overlap: doc_id, t (hash of the text),
    item_id, n_places (diagonals), and first word, words and matching words of the best place."""
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("t", F.xxhash64("text"))
    out = empty(spark, SCHEMA)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for items in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(SeedTable(items))

        @frugal("decontamination")
        def scan(batches_, shared=shared):
            table = shared.value
            for batch in batches_:
                ids, hashes, all_texts = (batch.column(c).to_pylist() for c in ("doc_id", "t", "text"))
                for a, b in batches(all_texts):
                    words, first, _, _ = words_of(all_texts[a:b])
                    best: dict = {}
                    for d, item, distance in sorted(table.search(words, first)):
                        got = table.overlap(words[first[d] : first[d + 1]], item, distance)
                        if got:
                            n, old = best.get((d, item), (0, None))
                            best[d, item] = n + 1, got if old is None or (got[1], -got[0]) > (old[1], -old[0]) else old
                    rows = [(ids[a + d], hashes[a + d], table.ids[item], n, *got) for (d, item), (n, got) in best.items()]
                    rows += [(ids[a + d], hashes[a + d], table.ids[item], n, at, size, size) for d, item, n, at, size in table.exact(words, first)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names=names)

        out = out.unionAll(texts.mapInArrow(scan, SCHEMA))
    return out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("t")
