"""Token-ID output: bit-plane shuffled blocks under zstandard, with a chunk index.

File format (one Parquet row per *frame*; Parquet gives atomic commits, so a lost executor leaves no
half-written file):

* `shard`, `frame`: a frame's place; frames follow one another by (shard, frame).
* `n_ids`, `n_docs`, `block_bytes`: what the chunk index takes, without a reading of the planes.
* `doc_ids`, `lengths`: the documents of the frame, in order, and their numbers of ids.
* `blocks`: the frame's ids in fixed-size blocks of `BLOCK` ids (the last may be short), each
  `{n, planes}`.  A block of n ids, seen as an n x 4 byte matrix, is transposed; `planes` are its 4 byte
  planes (most significant first), each compressed with zstandard.  `plane_bits=1` transposes bits
  instead (32 planes): slower, and larger on 16-bit vocabularies.  A plane of zeros is stored as an empty string.
* chunk index (second table): `shard, frame, first_start, n_ids, n_docs, block_bytes`.

Scale: documents are dealt by ranges of doc_id into shards, more of them where one would read over 128 MB; tasks stream and flush a
frame at about `FRAME` ids, so memory does not grow with a shard.  Starts come from a sum per shard
(one row a shard goes to the driver) and a sum within each shard.  Reading is frame by frame, without
a shuffle.

Defined cases: null and empty texts are one id (the end id); equal doc_ids are ordered by a hash of the text, so the
result does not depend on the partitioning; null doc_ids come first; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ship import ship
from .shared import _CACHED, batches, documents, free_names, frugal, shared_dir, span_hashes, task_number, text_of

BLOCK = 32_768
FRAME = 262_144
GROUP = 1_000_000  # characters tokenised at once
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
LEVEL = 3

FRAME_SCHEMA = (
    "shard int, frame int, n_ids long, n_docs int, block_bytes array<long>, doc_ids array<long>, lengths array<long>, "
    "blocks array<struct<n:int,planes:array<binary>>>"
)


# ------------------------------------------------------------------ codec


def to_planes(ids: np.ndarray, bits: int = 1) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, most significant first; bits is 1 or 8."""
    raw = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [raw[:, k].tobytes() if raw[:, k].any() else b"" for k in range(4)]
    cells = np.unpackbits(raw, axis=1)
    return [np.packbits(cells[:, k]).tobytes() if cells[:, k].any() else b"" for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.zeros((n, 4), dtype=np.uint8)
        for k, p in enumerate(planes):
            if p:
                raw[:, k] = np.frombuffer(p, dtype=np.uint8)
    else:
        cells = np.zeros((n, 32), dtype=np.uint8)
        for k, p in enumerate(planes):
            if p:
                cells[:, k] = np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n)
        raw = np.packbits(cells, axis=1)
    return raw.reshape(-1).view(">u4").astype(np.uint32)


def pack(ids: np.ndarray, bits: int = 1, block: int = BLOCK) -> list[dict]:
    import zstandard

    c = zstandard.ZstdCompressor(level=LEVEL)
    out = []
    for at in range(0, len(ids), block):
        part = ids[at : at + block]
        out.append({"n": len(part), "planes": [c.compress(p) if p else b"" for p in to_planes(part, bits)]})
    return out


def unpack(blocks) -> np.ndarray:
    import zstandard

    d = zstandard.ZstdDecompressor()
    parts = [from_planes([d.decompress(bytes(p)) if len(p) else b"" for p in b["planes"]], int(b["n"])) for b in blocks]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)


# ------------------------------------------------------------------ tokenizer

# Texts out of these characters are normalised by lower-casing, and their pieces are runs of letters, single
# digits and runs of other signs, exactly as the tokenizer itself does it; any other text, and one with an apostrophe
# (which may begin a contraction), goes to the tokenizer whole.
_PLAIN = re.compile("[\t\n\r\x20-\x26\x28-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_SPACE, _LETTER, _DIGIT, _SIGN = 0, 1, 2, 3
_KIND = np.full(256, _SIGN, dtype=np.uint8)
_KIND[[9, 10, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[97:123] = _LETTER
_KIND[0xDF:] = _LETTER
_KIND[0xF7] = _SIGN
_SLOTS = 1 << 19
_POOL = 4_000_000


def _first_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first 16 bytes of each piece as two numbers, bytes past its end as zeros."""
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(24, dtype=np.uint8)]), 8)
    out = np.empty((len(starts), 2), dtype=np.uint64)
    for k in (0, 1):
        x = np.ascontiguousarray(eights[starts + 8 * k]).view("<u8")[:, 0]
        room = np.clip(ends - starts - 8 * k, 0, 8).astype(np.uint64) * np.uint64(8)
        out[:, k] = np.where(room == 64, x, x & ((np.uint64(1) << np.minimum(room, np.uint64(63))) - np.uint64(1)))
    return out


class Encoder:
    """Ids of many texts at once, with a bounded table of the ids of pieces.

    The table is direct-mapped by a 64-bit hash of the piece: a slot holds the piece met last, so memory is
    bounded and frequent pieces come back soon after they are driven out.  A slot keeps the piece's 16 bytes (shorter ones are filled
    up with zeros, which no piece has), and only a piece of the same bytes takes its ids; longer pieces are not kept.
    """

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if not os.path.exists(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        self.tok = Tokenizer.from_file(name)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids that end a piece
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        kind = str(self.tok.pre_tokenizer)
        self.by_piece = "Removed" in kind and "ByteLevel" in kind and "Lowercase" in str(self.tok.normalizer)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros((_SLOTS, 2), dtype=np.uint64)
        self.at, self.size = np.zeros(_SLOTS, dtype=np.int64), np.zeros(_SLOTS, dtype=np.int64)
        self.pool, self.used = np.zeros(_POOL + (1 << 20), dtype="<u4"), 0

    def _pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and the number of each; many go through the tokenizer as one text."""
        ids, sizes = [], []
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            (e,) = self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            got = np.array(e.ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[got]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(got):
                each = [self.tok.encode(p, add_special_tokens=False).ids for p in part]
                got, cuts = np.array([x for e in each for x in e], dtype="<u4"), np.cumsum([len(e) for e in each])
            ids.append(got)
            sizes.append(np.diff(cuts, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def _plain(self, texts: list[str]) -> list[bytes]:
        parts = [t.lower().encode("latin-1") for t in texts]
        data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
        kind = _KIND[data]
        edge = np.ones(len(data), dtype=bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        cut = np.flatnonzero(edge)
        word = kind[cut] != _SPACE
        starts, ends = cut[word], np.append(cut[1:], len(data))[word]
        bounds = np.cumsum([len(p) + 1 for p in parts])
        first = np.searchsorted(starts, np.concatenate(([0], bounds)))
        if not len(starts):
            return [b""] * len(texts)
        h, same = span_hashes(data, starts, ends), _first_bytes(data, starts, ends)
        slot = (h >> np.uint64(20)).astype(np.int64) & (_SLOTS - 1)
        short = ends - starts <= 16
        missing = np.flatnonzero(~short | (self.keys[slot] != same).any(1))
        at, size = self.at[slot], self.size[slot]
        if len(missing):
            raw = data.tobytes()
            spans = list(zip(starts[missing].tolist(), ends[missing].tolist()))
            new, where, back = np.unique(h[missing], return_index=True, return_inverse=True)
            if (same[missing] != same[missing[where]][back]).any() or not short[missing].all():
                # long pieces, or two of one hash: told apart by their bytes
                numbers: dict[bytes, int] = {}
                back = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in spans])
                where = np.unique(back, return_index=True)[1]
            ids, sizes = self._pieces([raw[a:b].decode("latin-1") for a, b in (spans[k] for k in where.tolist())])
            if self.used + len(ids) > len(self.pool):  # one group's pieces need more room than the pool has left
                self.pool = np.concatenate([self.pool[: self.used], ids, np.zeros(1 << 20, dtype="<u4")])
            self.pool[self.used : self.used + len(ids)] = ids
            places = self.used + np.cumsum(sizes) - sizes
            self.used += len(ids)
            at[missing], size[missing] = places[back], sizes[back]
            keep = np.flatnonzero(short[missing[where]])
            # of two pieces in one slot one is kept, whole
            slots, last = np.unique(slot[missing[where[keep]]][::-1], return_index=True)
            keep = keep[::-1][last]
            self.keys[slots], self.at[slots], self.size[slots] = same[missing[where[keep]]], places[keep], sizes[keep]
        # ids of all pieces: each piece's place, counted up over its length
        total = np.concatenate(([0], np.cumsum(size)))
        flat = self.pool[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        raw, ends_ = flat.tobytes(), total[first].tolist()
        if self.used > _POOL:
            self._clear()
        return [raw[4 * a : 4 * b] for a, b in zip(ends_[:-1], ends_[1:])]

    def many(self, texts: list[str]) -> list[bytes]:
        plain = [i for i, t in enumerate(texts) if self.by_piece and "<|" not in t and _PLAIN.fullmatch(t)]
        out: list[bytes] = [b""] * len(texts)
        for i, raw in zip(plain, self._plain([texts[i] for i in plain]) if plain else ()):
            out[i] = raw
        rest = sorted(set(range(len(texts))).difference(plain))
        for i, e in zip(rest, self.tok.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False) if rest else ()):
            out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out


def encoder(name: str) -> Encoder:
    if ("encoder", name) not in _CACHED:
        _CACHED["encoder", name] = Encoder(name)
    return _CACHED["encoder", name]


# ------------------------------------------------------------------ write and read


def write_tokens(docs: DataFrame, path: str, order: list[str], tokenizer: str = TOKENIZER, plane_bits: int = 8, shards: int | None = None) -> None:
    """Write docs(doc_id, text) to `path`/frames and `path`/index, ordered by the columns `order`
    (`_tie` stands for a hash of the text)."""
    spark = ship(docs.sparkSession)
    n = shards or task_number(docs)
    tie = F.xxhash64(text_of())  # a sampled key must be small
    keys = [(tie if c == "_tie" else F.col(c)).alias(f"_k{i}") for i, c in enumerate(order)]
    dealt = docs.select(*keys, F.col("doc_id"), text_of().alias("text"))
    names = [f"_k{i}" for i in range(len(order))]
    # shard numbers are those of the range partitions, so they follow the order
    dealt = dealt.repartitionByRange(n, *names).sortWithinPartitions(*names).select("doc_id", "text", F.spark_partition_id().alias("shard"))

    @frugal("token_output")
    def encode(batches_):
        enc, end = encoder(tokenizer), np.array([END_ID], dtype="<u4").tobytes()
        ids, lens, parts, total, frame, shard = [], [], [], 0, 0, 0

        def flush():
            flat = np.frombuffer(b"".join(parts), dtype="<u4")
            blocks = pack(flat, plane_bits)
            room = [sum(map(len, b["planes"])) for b in blocks]
            return pd.DataFrame({"shard": [shard], "frame": [frame], "n_ids": [len(flat)], "n_docs": [len(ids)], "block_bytes": [room], "doc_ids": [list(ids)], "lengths": [list(lens)], "blocks": [blocks]})

        for batch in batches_:
            docs_, texts, shard = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("shard")[0].as_py() if len(batch) else shard
            for a, b in batches(texts, GROUP):
                for d, raw in zip(docs_[a:b], enc.many(texts[a:b])):
                    raw += end
                    ids.append(d)
                    lens.append(len(raw) // 4)
                    parts.append(raw)
                    total += lens[-1]
                    if total >= FRAME:
                        yield _arrow(flush())
                        ids, lens, parts, total, frame = [], [], [], 0, frame + 1
        if ids:
            yield _arrow(flush())

    dealt.mapInArrow(encode, FRAME_SCHEMA).write.parquet(f"{path}/frames")
    frames = read_frames(spark, path)
    sums = frames.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    before = dict(zip((r["shard"] for r in sums), itertools.accumulate((r["n"] for r in sums), initial=0)))
    starts = spark.createDataFrame(pa.table({"shard": pa.array(list(before), pa.int32()), "shard_start": pa.array(list(before.values()), pa.int64())}))
    within = Window.partitionBy("shard").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    index = frames.select("shard", "frame", "n_ids", "n_docs", "block_bytes")  # the planes are not read
    index = index.withColumn("before", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    index.join(starts, "shard").select("shard", "frame", (F.col("shard_start") + F.col("before")).alias("first_start"), "n_ids", "n_docs", "block_bytes").write.parquet(f"{path}/index")


def _arrow(pdf: pd.DataFrame) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(pdf, schema=_FRAME_ARROW, preserve_index=False)


_FRAME_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("frame", pa.int32()),
        ("n_ids", pa.int64()),
        ("n_docs", pa.int32()),
        ("block_bytes", pa.list_(pa.int64())),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("blocks", pa.list_(pa.struct([("n", pa.int32()), ("planes", pa.list_(pa.binary()))]))),
    ]
)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAME_SCHEMA).parquet(f"{path}/frames")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    frames = read_frames(ship(spark), path).join(read_index(spark, path).select("shard", "frame", "first_start"), ["shard", "frame"])

    @frugal("token_output")
    def digest(batches):
        for batch in batches:
            for doc_ids, lens, blocks, start in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "lengths", "blocks", "first_start"))):
                flat = unpack(blocks).astype("<u4")
                ends = np.cumsum(lens)
                begins = ends - lens
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(begins + start, pa.int64()),
                        pa.array(lens, pa.int64()),
                        pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(begins, ends)], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return frames.select("doc_ids", "lengths", "blocks", "first_start").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, order: list[str], tokenizer: str = TOKENIZER, plane_bits: int = 8) -> DataFrame:
    path = shared_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, order, tokenizer, plane_bits)
    return read_digests(docs.sparkSession, path)


def in_stored_order(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with columns for the order in which its rows lie in its files, and their names.

    Files of one write are ordered by the part number in their names.  Rows that come from no file are ordered by doc_id.
    """
    file, row = free_names(docs, "file", "row")
    try:
        placed = docs.select("*", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias(file), F.col("_metadata.row_index").alias(row))
        placed.schema  # noqa: B018  resolves the names
    except AnalysisException:
        return docs, ["doc_id", "_tie"]
    return placed, [file, row]


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(documents(spark, sf_dir), ["doc_id", "_tie"])
