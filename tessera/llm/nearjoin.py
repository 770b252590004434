"""N-gram Jaccard self-join by an LSH forest over MinHash signatures, with exact verification.

Similarity is the Jaccard coefficient of the sets of 5-word shingles; pairs of 0.8 or more are linked.

1. *Classes*: texts with the same word sequence form one class.  Classes have numbers of their own; doc_id is an attribute
   (the smallest of the class).  Copies are never expanded.
2. *Forest*: each class has `TREES` label sequences of `DEPTH` MinHash labels (16 bits each), a leaf of one tree each.  Leaves that share
   no prefix of `least_depth()` labels with another are left out; the rest are stored sorted by (tree, labels), so that a
   prefix is a range of rows: the tries.
3. *Descent*: prefixes are compared at the full depth first.  Classes under one trie node are candidates, and connected
   candidates form components.  After verification the recall is measured by capture and recapture: the first and the second
   half of the trees find links independently, so of `a` and `b` links found by either half, `m` by both, about (a - m)(b - m) / m
   are missed.  While some stratum of similarity (`BINS`) falls short of the target, all matched prefixes are shortened by one label, and
   of the components that grow the pairs that are new are verified.  At `least_depth()` the recall expected at
   the threshold itself reaches the target, so the descent ends there at the latest, as it does if there is no link to measure by.
4. *Verification*: exact, by sets of 64-bit shingle hashes.  A component is compared as a whole: its largest part that has been compared before
   (its base) in blocks against blocks of the rest, and those among themselves; each pair of blocks is a unit of work.  A large component
   whose trie nodes hold fewer rows to move is compared node by node, and a pair counts in the first tree that has it under one node.
   A unit returns counts per class and a spanning forest of its links, never the pairs.
5. Links' connected components are the groups, named by their smallest doc_id.

Scale: texts are read twice; the second reading is cut down by a fixed-size bitmap to one row of each class that has
candidates.  Signatures, leaves and edges are narrow.  A hot trie node shrinks to a row per task where its ends are found, and
its members come back through a join that AQE can split.  A component of n classes costs n^2 vectorised comparisons at most;
chains of weakly similar texts cost the squares of their trie nodes instead.

Defined cases: a text of fewer than five words is one shingle made of all of them; texts without words are
one class without links to others; null counts as empty; repeated rows belong to one class; rows without doc_id and rows that
share one take part like others, by their text; a class or group without any doc_id has a null id; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import ship
from .dedup import bloom_row, may_hold
from .shared import batches, connected_components, documents, file_number, free_names, frugal, give_back, mix64, shingle_hashes, stored, text_of, words_of

WORDS = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 9
TARGET_RECALL = 0.999
BINS = [0.8, 0.84, 0.88, 0.92]
BLOCK_ROWS = 64
MAX_BLOCKS = 48
BLOCK_BYTES = 8 << 20
LARGE_UNIT = 4 << 20  # characters; after such a unit a worker gives freed memory back
NODE_SHARE = 1.0  # nodes are compared where they move fewer rows than this share of what the whole would

_SEEDS = np.random.default_rng(5).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def expected_recall(depth: int, trees: int = TREES, threshold: float = THRESHOLD) -> float:
    return 1 - (1 - threshold**depth) ** trees


def least_depth(target: float = TARGET_RECALL) -> int:
    """The longest prefix whose expected recall at the threshold reaches the target; one label at least."""
    return next((d for d in range(DEPTH, 1, -1) if expected_recall(d) >= target), 1)


def measured_recall(a: int, b: int, m: int) -> float:
    """Share of all links that two independent searches found, `a` and `b` of them and `m` both; 0 if it cannot be told."""
    if not m:
        return 0.0
    return (a + b - m) / (a + b - m + (a - m) * (b - m) / m)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words, first, _, _ = words_of(texts)
    return [_shingles(words[a:b]) for a, b in zip(first[:-1], first[1:])]


def _shingles(words: np.ndarray) -> np.ndarray:
    if not len(words):
        return words
    if len(words) < WORDS:
        return mix64(shingle_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(shingle_hashes(words, WORDS))


def signatures(texts: list[str]) -> tuple[list[bytes], list[int], list[bytes]]:
    """Per text: digest of its word sequence, number of words, and TREES label sequences of 2 * DEPTH bytes."""
    words, first, _, _ = words_of(texts)
    lengths = np.diff(first)
    keys = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1], first[1:])]
    # all shingles of all texts one after the other; those over a boundary are left out
    parts = shingle_hashes(words, WORDS)
    text = np.repeat(np.arange(len(texts)), lengths)
    inside = np.arange(len(parts)) + WORDS <= first[text[: len(parts)] + 1]
    have = np.flatnonzero(lengths >= WORDS)
    values, starts = parts[inside], np.concatenate(([0], np.cumsum(lengths[have] - WORDS + 1)))[:-1].astype(np.int64)
    labels = np.zeros((len(texts), len(_SEEDS)), dtype=np.uint16)
    short = [i for i in np.flatnonzero((lengths > 0) & (lengths < WORDS))]
    for k, seed in enumerate(_SEEDS):
        if len(have):
            labels[have, k] = (mix64(np.minimum.reduceat(values * seed, starts)) >> np.uint64(48)).astype(np.uint16)
        for i in short:
            labels[i, k] = int(mix64(_shingles(words[first[i] : first[i + 1]]) * seed)[0] >> np.uint64(48))
    return keys, lengths.tolist(), [row.astype(">u2").tobytes() for row in labels]


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), key, n_words, size and labels of every row."""

    @frugal("near_join")
    def sign(batches_):
        for batch in batches_:
            texts = batch.column("text").to_pylist()
            keys, n, labels = [], [], []
            for a, b in batches(texts, 1_000_000):
                k, w, s = signatures(texts[a:b])
                keys, n, labels = keys + k, n + w, labels + s
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), batch.column("size"), pa.array(labels, pa.binary())],
                names=["doc_id", "t", "key", "n_words", "size", "labels"],
            )

    rows = _rows(docs).withColumn("size", F.octet_length("text").cast("long"))
    return rows.select("doc_id", "t", "text", "size").mapInArrow(sign, "doc_id long, t long, key binary, n_words long, size long, labels binary")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("t", F.xxhash64("text"))


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right sets."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if not left or not right:
        return out
    lv, rv = np.concatenate(left), np.concatenate(right)
    li, ri = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    known = np.intersect1d(lv, rv)
    keep = np.isin(lv, known)
    lv, li = np.searchsorted(known, lv[keep]), li[keep]
    keep = np.isin(rv, known)
    rv, ri = np.searchsorted(known, rv[keep]), ri[keep]
    width = min(len(known), max(256, (1 << 21) // (len(left) + len(right))))  # columns at a time: bounded memory
    for at in range(0, len(known), width):
        a, b = np.zeros((len(left), width), dtype=np.float32), np.zeros((len(right), width), dtype=np.float32)
        m = (lv >= at) & (lv < at + width)
        a[li[m], lv[m] - at] = 1
        m = (rv >= at) & (rv < at + width)
        b[ri[m], rv[m] - at] = 1
        out += a @ b.T
    return out


def _depths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The longest common prefix of the labels in each tree; x and y are [n, TREES, DEPTH]."""
    return np.logical_and.accumulate(x == y, axis=2).sum(2)


def comparer(least: int, depth: int):
    """The function that compares one unit: all pairs of one block, or all pairs between two blocks.

    Pairs of one core have been compared before, and so have pairs under one node of a greater depth.  In a unit of a
    trie node (tree >= 0) a pair counts if no earlier tree has it under one node of this depth.  Besides a row per class with links there is one row of counts for the recall: for each depth from `least` on and each of BINS the
    links under one node in the first half of the trees, in the second half, and in both.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        comp, tree, same = int(pdf["comp"].iloc[0]), int(pdf["tree"].iloc[0]), bool((pdf["u"] == pdf["v"]).iloc[0])
        sets = []
        texts = pdf["text"].tolist()
        for a, b in batches(texts):
            sets += shingle_sets(texts[a:b])
        ids, sizes = pdf["id"].to_numpy(), pdf["copies"].to_numpy()
        labels = np.frombuffer(b"".join(pdf["labels"]), dtype=np.uint16).reshape(len(ids), TREES, DEPTH)
        n = np.array([len(s) for s in sets], dtype=np.float64)
        left = np.arange(len(sets)) if same else np.flatnonzero((pdf["block"] == pdf["u"]).to_numpy())
        right = left if same else np.flatnonzero((pdf["block"] == pdf["v"]).to_numpy())
        both = intersections([sets[i] for i in left], [sets[i] for i in right]).astype(np.float64)
        union = n[left][:, None] + n[right][None, :] - both
        linked = (both > 0) & (both >= THRESHOLD * union - 1e-9)
        core = pdf["core"].to_numpy()
        linked &= core[left][:, None] != core[right][None, :]
        stats = np.zeros((DEPTH - least + 1, len(BINS), 3), dtype=np.int64)
        for i in np.flatnonzero(linked.any(1)):
            at = np.flatnonzero(linked[i])
            deep = _depths(labels[left[i]][None], labels[right[at]])
            mine = deep.max(1) <= depth if depth < DEPTH else np.ones(len(at), dtype=bool)
            if tree >= 0:
                mine &= (deep[:, tree] >= depth) & (deep[:, :tree] < depth).all(1)
            linked[i, at[~mine]] = False
            at, deep = at[mine], deep[mine]
            if same:  # each pair is met twice
                deep, at = deep[at > i], at[at > i]
            kind = np.searchsorted(BINS, both[i, at] / union[i, at] + 1e-9, "right") - 1
            a, b = deep[:, : TREES // 2].max(1, initial=0), deep[:, TREES // 2 :].max(1, initial=0)
            for d in range(least, DEPTH + 1):
                for k, found in enumerate((a >= d, b >= d, (a >= d) & (b >= d))):
                    stats[d - least, :, k] += np.bincount(np.maximum(kind[found], 0), minlength=len(BINS))
        texts_, docs_ = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        texts_[left] += linked.sum(1)
        docs_[left] += (linked * sizes[right][None, :]).sum(1).astype(np.int64)
        if not same:
            texts_[right] += linked.sum(0)
            docs_[right] += (linked * sizes[left][:, None]).sum(0).astype(np.int64)
        # spanning forest of the unit's links
        root = np.arange(len(ids))
        grid = np.zeros((len(ids), len(ids)), dtype=bool)
        grid[np.ix_(left, right)] |= linked
        grid |= grid.T
        while True:
            low = np.where(grid, root[None, :], len(ids)).min(1, initial=len(ids))
            new = np.minimum(root, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        hit, told = np.flatnonzero(texts_ > 0), int(stats.any())
        if sum(map(len, texts)) > LARGE_UNIT:
            give_back()
        rows = {
            "id": pd.array([*ids[hit], *[None] * told], dtype="Int64"),
            "n_texts": [*texts_[hit], *[0] * told],
            "n_docs": [*docs_[hit], *[0] * told],
            "root": [*ids[root][hit], *[0] * told],
            "stats": pd.Series([None] * len(hit) + [stats.reshape(-1).tolist()] * told, dtype=object),
        }
        return pd.DataFrame(rows).astype({"n_texts": "int64", "n_docs": "int64", "root": "int64"}).assign(comp=comp)

    return compare


def _blocks(n, size):
    """Blocks of BLOCK_ROWS classes, MAX_BLOCKS of them unless a block would exceed BLOCK_BYTES; none for none."""
    count = F.greatest(F.least(F.ceil(n / BLOCK_ROWS), F.lit(MAX_BLOCKS)), F.ceil(size / BLOCK_BYTES), F.lit(1))
    return F.when(n > 0, count).otherwise(0).cast("int")


def _units(members: DataFrame, leaves: DataFrame, depth: int) -> tuple[DataFrame, DataFrame | None]:
    """comp, tree, prefix, id, core, block, low, high: how the components of members(id, size, comp, core) are compared; and
    the components that are done by nodes.  A row meets the blocks from `low` to `high`.

    A component goes whole (tree -1): the blocks of its base against the others, and those against all.  One that
    needs MAX_BLOCKS goes node by node if that moves fewer rows.
    """
    by_core = members.groupBy("comp", "core").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    sizes = by_core.groupBy("comp").agg(F.sum("n").alias("n"), F.sum("size").alias("bytes"), F.max(F.struct("n", "core", "size")).alias("base"))
    base = F.when(F.col("base.n") > 1, F.col("base"))
    n, size = F.coalesce(base["n"], F.lit(0)), F.coalesce(base["size"], F.lit(0))
    sizes = sizes.select("comp", "n", n.alias("n_base"), base["core"].alias("base"), _blocks(n, size).alias("old"), _blocks(F.col("n") - n, F.col("bytes") - size).alias("new")).where("n > 1")
    sizes = stored(sizes, "near-sizes", narrow=True)
    mine = F.coalesce(F.col("core") == F.col("base"), F.lit(False))
    at = F.xxhash64("id")
    whole = members.join(sizes, "comp").select(
        "comp", F.lit(-1).alias("tree"), F.lit(b"").alias("prefix"), "id", "core",
        F.when(mine, F.pmod(at, F.col("old"))).otherwise(F.col("old") + F.pmod(at, F.col("new"))).cast("int").alias("block"),
        F.when(mine, F.col("old")).otherwise(0).alias("low"), (F.col("old") + F.col("new") - 1).alias("high"),
    )
    large = sizes.where(F.col("old") + F.col("new") >= MAX_BLOCKS)
    if large.isEmpty():
        return whole, None
    rows = leaves.select("id", "size", "tree", F.substr("label", F.lit(1), F.lit(2 * depth)).alias("prefix"))
    rows = rows.join(members.select("id", "comp", "core"), "id").join(large.select("comp"), "comp")
    h = F.xxhash64("id")
    nodes = rows.groupBy("comp", "tree", "prefix").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("y")).where("n > 1")
    # nodes of the same members are compared in the first tree alone
    nodes = nodes.groupBy("comp", "n", "bytes", "x", "y").agg(F.min(F.struct("tree", "prefix")).alias("p"))
    nodes = stored(nodes.select("comp", "p.*", _blocks(F.col("n"), F.col("bytes")).alias("blocks"), "n"), "near-nodes")
    moved = nodes.groupBy("comp").agg(F.sum(F.col("n") * F.col("blocks")).alias("moved"))
    cost = F.col("n_base") * F.col("new") + (F.col("n") - F.col("n_base")) * (F.col("old") + F.col("new"))
    split = stored(large.join(moved, "comp").where(F.col("moved") < cost * NODE_SHARE).select("comp"), "near-split", narrow=True)
    by_node = rows.join(nodes.join(split, "comp", "left_semi").drop("n"), ["comp", "tree", "prefix"]).select(
        "comp", "tree", "prefix", "id", "core", F.pmod(at, F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("low"), (F.col("blocks") - 1).alias("high")
    )
    return whole.join(split, "comp", "left_anti").unionByName(by_node), split


def _verified(units: DataFrame, texts: DataFrame, depth: int, least: int) -> DataFrame:
    """comp, id, n_texts, n_docs, root, stats from the exact comparison of the units."""
    units = units.join(texts.select("id", "text", "copies", "labels"), "id").withColumn("other", F.explode(F.sequence("low", "high")))
    units = units.select("comp", "tree", "prefix", "id", "core", "text", "copies", "labels", "block", F.least("block", "other").alias("u"), F.greatest("block", "other").alias("v"))
    return units.groupBy("comp", "tree", "prefix", "u", "v").applyInPandas(comparer(least, depth), "comp long, id long, n_texts long, n_docs long, root long, stats array<long>")


def _recall(found: DataFrame, depth: int, least: int) -> float:
    """The least measured recall of the strata at this depth; 0 where there is no link."""
    sums = found.where("stats is not null").select(F.posexplode("stats").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    stats = np.zeros((DEPTH - least + 1) * len(BINS) * 3, dtype=np.int64)
    for r in sums:  # at most one row for each entry
        stats[r["k"]] = r["v"]
    rows = stats.reshape(-1, len(BINS), 3)[depth - least]
    links = stats.reshape(-1, len(BINS), 3)[0, :, :2].sum(1)  # strata with links, as far as any depth tells
    return min((measured_recall(*map(int, r)) for r, n in zip(rows, links) if n), default=0.0)


def near_links(docs: DataFrame, target: float = TARGET_RECALL, trace: list | None = None) -> DataFrame:
    """doc_id, class_id, n_links (other documents of similarity 0.8 or more, copies included), n_text_links
    (other classes), group_id (smallest doc_id of the linked group), group_size, t (hash of the text) and g (number of the group), for every row.

    trace: a list that takes (depth, measured recall) of each level of the descent.
    """
    ship(docs.sparkSession)
    least = least_depth(target)
    signed = stored(_signed(docs), "near-signed")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t", "labels", "n_words", "size")).alias("m")
    classes = signed.groupBy("key").agg(best, F.count(F.lit(1)).alias("copies"))
    # numbers are given once, as the rows are written
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), "key", "m.doc_id", "m.t", "m.labels", "m.n_words", "m.size", "copies"), "near-classes")
    searched = classes.where("n_words > 0")

    leaf = lambda t: F.substr("labels", t * (2 * DEPTH) + 1, F.lit(2 * DEPTH))
    leaves = searched.select("id", "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), leaf)).alias("tree", "label"))
    low = F.substr("label", F.lit(1), F.lit(2 * least))
    nodes = leaves.groupBy("tree", low.alias("low")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tree", "low")
    leaves = leaves.withColumn("low", low).join(stored(nodes, "near-low"), ["tree", "low"]).select("id", "size", "tree", "label")
    leaves = stored(leaves.repartitionByRange(file_number(classes), "tree", "label").sortWithinPartitions("tree", "label"), "near-forest")

    members = stored(leaves.select("id", "size").distinct().select("id", "size", F.col("id").alias("comp"), F.col("id").alias("core")), "near-members", narrow=True)
    asked = members.join(searched.select("id", F.col("doc_id").alias("rep"), F.col("t").alias("rep_t"), "labels", "copies"), "id")
    bloom = bloom_row(asked.select(F.xxhash64("rep", "rep_t").alias("digest"))).scalar()
    held = _rows(docs).where(may_hold(bloom, F.xxhash64("doc_id", "t"))).join(asked, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("t") == F.col("rep_t")))
    # rows that repeat hand in their text again
    texts = stored(held.groupBy("id").agg(F.first("text").alias("text"), F.first("labels").alias("labels"), F.first("copies").alias("copies")), "near-texts")

    found, by_node = None, None
    for depth in range(DEPTH, least - 1, -1):
        rows = leaves.select("id", "tree", F.substr("label", F.lit(1), F.lit(2 * depth)).alias("prefix")).join(members.select("id", "comp"), "id")
        ends = rows.groupBy("tree", "prefix").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("tree", "prefix", "lo")
        edges = rows.join(stored(ends, "near-ends"), ["tree", "prefix"]).where("comp <> lo").select(F.col("comp").alias("a"), F.col("lo").alias("b"))
        merged = stored(connected_components(edges, "near-candidates"), "near-merged", narrow=True)
        again = merged.select(F.col("component").alias("comp"))
        if by_node is not None:  # these were compared down to the last depth only
            again = again.unionByName(by_node.join(merged.select(F.col("id").alias("comp")), "comp", "left_anti"))
        again = stored(again.distinct(), "near-again", narrow=True)
        if not again.isEmpty():
            moved = members.join(merged.withColumnRenamed("id", "comp"), "comp", "left")
            members = moved.select("id", "size", F.coalesce("component", "comp").alias("comp"), "core")
            members = stored(members, "near-members", narrow=True)
            units, by_node = _units(members.join(again, "comp", "left_semi"), leaves, depth)
            new = stored(_verified(units, texts, depth, least), "near-found")
            found = new if found is None else found.unionByName(new)
            # what was compared as a whole is a core from now on
            if by_node is None:
                members = members.withColumn("core", F.col("comp"))
            else:
                parts = by_node.select("comp", F.lit(True).alias("by_node"))
                members = members.join(parts, "comp", "left").select("id", "size", "comp", F.when(F.col("by_node"), F.col("core")).otherwise(F.col("comp")).alias("core"))
        recall = _recall(found, depth, least) if found is not None else 0.0
        if trace is not None:
            trace.append((depth, recall))
        if recall >= target:
            break
    if found is None:
        found = docs.sparkSession.createDataFrame([], "id long, n_texts long, n_docs long, root long")
    found = found.where("id is not null")
    links = found.groupBy("id").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    groups = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "near-groups")
    linked = stored(links.join(groups, "id"), "near-linked", narrow=True)
    known = classes.select("id", "key", "doc_id", "copies").join(linked, "id", "left")
    known = known.select("key", "doc_id", "copies", F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("component", "id").alias("g"))
    known = stored(known, "near-counted")
    # most classes are groups of their own
    totals = known.where("n_texts > 0").groupBy("g").agg(F.min("doc_id").alias("group_id"), F.sum("copies").alias("group_size"))
    known = known.join(totals, "g", "left").select(
        "g", "key", F.col("doc_id").alias("class_id"), "copies", "n_texts", "n_docs",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("group_size", "copies").alias("group_size"),
    )
    return signed.select("doc_id", "t", "key").join(stored(known, "near-known"), "key").select(
        "doc_id",
        "class_id",
        (F.col("n_docs") + F.col("copies") - 1).alias("n_links"),
        F.col("n_texts").alias("n_text_links"),
        "group_id",
        "group_size",
        "t",
        "g",
    )


def _row_key(docs: DataFrame):
    return F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(text_of()))


def drop_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of gone(doc_id, t): those of the same doc_id, null included, and hash of the text.

    A fixed-size bitmap lets most rows pass without a shuffle; only rows that may be concerned are joined.
    """
    maybe = may_hold(bloom_row(gone.select(F.xxhash64("doc_id", "t").alias("digest"))).scalar(), _row_key(docs))
    flag, gone_id, gone_t = free_names(docs, "maybe", "gone_id", "gone_t")
    flagged = docs.withColumn(flag, maybe)
    rest = flagged.where(flag).drop(flag).join(
        gone.select(F.col("doc_id").alias(gone_id), F.col("t").alias(gone_t)),
        F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (F.xxhash64(text_of()) == F.col(gone_t)),
        "left_anti",
    )
    return flagged.where(~F.col(flag)).drop(flag).unionByName(rest)


def keep_one(docs: DataFrame, links: DataFrame) -> DataFrame:
    """docs with one row of each group of links(doc_id, t, g, group_size): that of the smallest doc_id (then of the smallest
    hash of the text); a row without doc_id stays only in groups without any."""
    rows = stored(links.where("group_size > 1").select("doc_id", "t", "g"), "near-rows", narrow=True)
    first = rows.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("k"), F.count(F.lit(1)).alias("n"))
    first = stored(first.select("g", F.col("k.doc_id").alias("k_id"), F.col("k.t").alias("k_t")), "near-first", narrow=True)
    stays = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("t") == F.col("k_t"))
    met = stored(rows.join(first, "g").groupBy("doc_id", "t", stays.alias("stays")).agg(F.count(F.lit(1)).alias("n")), "near-stays", narrow=True)
    docs = drop_rows(docs, met.where("not stays").select("doc_id", "t"))
    # a row that is repeated whole stays once
    again = may_hold(bloom_row(met.where("stays and n > 1").select(F.xxhash64("doc_id", "t").alias("digest"))).scalar(), _row_key(docs))
    flag, h = free_names(docs, "again", "h")
    flagged = docs.withColumn(flag, again)
    once = flagged.where(flag).withColumn(h, F.xxhash64(text_of())).dropDuplicates(["doc_id", h]).drop(flag, h)
    return flagged.where(~F.col(flag)).drop(flag).unionByName(once)


def op8_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(documents(spark, sf_dir)).drop("t", "g")
