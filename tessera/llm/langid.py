"""Language ID by a bidirectional gated recurrent network over bytes, in numpy.

Model: a forward and a backward GRU of `HIDDEN` units read the UTF-8 bytes; a linear layer over both
states labels every position, and a document's probabilities are the mean over its letter positions
(ASCII letters and bytes from 0x80).  Long texts are read whole, in stretches of `STRETCH` bytes side
by side, each with a state of its own.

Training (backpropagation through time, Adam) happens on the driver, from a bounded sample: of each language
`PER_LANGUAGE` rows of the smallest hashes (fewer if there are so many languages that `SAMPLE` rows would be exceeded, one at least), and
of each row one piece of `PIECE` characters at a hashed place.  More than `SAMPLE` languages are refused.  Rows whose crc32(doc_id) mod 5 is 0 are held out.  lang, source and doc_id
are no inputs of a prediction.

Scale: training costs the same for any table; prediction is one pass without a shuffle, in Arrow
batches; the weights (about 20 KiB) go out as a broadcast.

Defined cases: null text or text without a letter is `und` with score 0; so is every text when there is
nothing to learn from; a null doc_id counts as held out; repeated rows get equal results; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ship import ship
from .shared import batches, documents, free_names, frugal

HIDDEN = 8
STRETCH = 64
PER_LANGUAGE = 500
SAMPLE = 100_000
PIECE = 640
ROUNDS = 240
BATCH = 256
UNKNOWN = "und"
LEAST_SCORE = 0.4

_LETTER = regex.compile(r"\p{L}")
_COUNTS = np.zeros(256, dtype=np.float32)
_COUNTS[0x80:] = 1
_COUNTS[65:91] = 1
_COUNTS[97:123] = 1


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


# ------------------------------------------------------------------ the network


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGru:
    """Weights: per direction X[256, 3H] (byte to gates), U[H, 3H], b[H]; and V[2H, C], c[C]."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        h, c = hidden, len(labels)
        self.labels, self.h = labels, h
        f32 = lambda a: a.astype(np.float32)
        self.w = {}
        for d in "fb":
            self.w[f"X{d}"] = f32(rng.normal(0, 0.3, (256, 3 * h)))
            self.w[f"U{d}"] = f32(rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)))
            self.w[f"b{d}"] = np.zeros(h, dtype=np.float32)
        self.w["V"] = f32(rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, c)))
        self.w["c"] = np.zeros(c, dtype=np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool = False):
        """States after each byte, [T, B, H]; x is [T, B] in reading order."""
        t, b, h = *x.shape, self.h
        X, U, bn = self.w[f"X{d}"], self.w[f"U{d}"], self.w[f"b{d}"]
        out = np.empty((t, b, h), dtype=np.float32)
        s, kept = np.zeros((b, h), dtype=np.float32), []
        for i in range(t):
            g, a = X[x[i]], s @ U
            zr = _sigmoid(g[:, : 2 * h] + a[:, : 2 * h])
            z, r, m = zr[:, :h], zr[:, h:], a[:, 2 * h :] + bn
            n = np.tanh(g[:, 2 * h :] + r * m)
            if keep:
                kept.append((s, z, r, m, n))
            s = n + z * (s - n)
            out[i] = s
        return (out, kept) if keep else out

    def _back(self, x, d, kept, dout, grads):
        """Backpropagation through time of dout [T, B, H]."""
        t, b, h = *x.shape, self.h
        U = self.w[f"U{d}"]
        dg = np.empty((t, b, 3 * h), dtype=np.float32)
        ds, dU, db = np.zeros((b, h), dtype=np.float32), np.zeros_like(U), np.zeros(h, dtype=np.float32)
        for i in range(t - 1, -1, -1):
            s, z, r, m, n = kept[i]
            ds = ds + dout[i]
            dn = ds * (1 - z) * (1 - n * n)
            dz = ds * (s - n) * z * (1 - z)
            dr = dn * m * r * (1 - r)
            da = np.concatenate([dz, dr, dn * r], axis=1)
            dg[i] = np.concatenate([dz, dr, dn], axis=1)
            dU += s.T @ da
            db += (dn * r).sum(0)
            ds = ds * z + da @ U.T
        one = np.zeros((t * b, 256), dtype=np.float32)
        one[np.arange(t * b), x.reshape(-1)] = 1
        grads[f"X{d}"], grads[f"U{d}"], grads[f"b{d}"] = one.T @ dg.reshape(t * b, -1), dU, db

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities at every position, [T, B, C], of byte stretches x [B, T]."""
        xt = np.ascontiguousarray(x.T)
        f = self._run(xt, "f")
        b = self._run(xt[::-1], "b")[::-1]
        v = self.w["V"]
        o = f.reshape(-1, self.h) @ v[: self.h] + np.ascontiguousarray(b).reshape(-1, self.h) @ v[self.h :] + self.w["c"]
        o -= o.max(1, keepdims=True)
        np.exp(o, out=o)
        o /= o.sum(1, keepdims=True)
        return o.reshape(*xt.shape, -1)

    def loss_and_grads(self, x: np.ndarray, y: np.ndarray):
        """Mean cross entropy over the letter positions of x [B, T] with labels y [B]."""
        xt = np.ascontiguousarray(x.T)
        (f, kf), (b, kb) = self._run(xt, "f", True), self._run(xt[::-1], "b", True)
        v, h = self.w["V"], self.h
        s = np.concatenate([f, b[::-1]], axis=2).reshape(-1, 2 * h)
        o = s @ v + self.w["c"]
        o -= o.max(1, keepdims=True)
        p = np.exp(o)
        p /= p.sum(1, keepdims=True)
        weight = _COUNTS[xt].reshape(-1)
        weight /= max(weight.sum(), 1)
        at = np.arange(len(p)), np.tile(y, len(xt))
        loss = -(np.log(p[at] + 1e-12) * weight).sum()
        p[at] -= 1
        p *= weight[:, None]
        grads = {"V": s.T @ p, "c": p.sum(0)}
        back = (p @ v.T).reshape(*xt.shape, 2 * h)
        self._back(xt, "f", kf, back[:, :, :h], grads)
        self._back(xt[::-1], "b", kb, back[::-1, :, h:], grads)
        return loss, grads

    def pooled(self, texts: list[bytes], tile: int = 2048) -> np.ndarray:
        """Mean label probabilities of each text over its letter positions."""
        sizes = np.array([-(-len(t) // STRETCH) for t in texts])
        data = np.frombuffer(b"".join(t.ljust(n * STRETCH, b"\0") for t, n in zip(texts, sizes)), dtype=np.uint8).reshape(-1, STRETCH)
        owner = np.repeat(np.arange(len(texts)), sizes)
        out, n = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        for at in range(0, len(data), tile):
            x = data[at : at + tile]
            weight = _COUNTS[x.T]
            sums = np.einsum("tbc,tb->bc", self.probabilities(x), weight)
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(owner[at : at + tile], sums[:, k], len(texts))
            n += np.bincount(owner[at : at + tile], weight.sum(0), len(texts))
        return out / np.maximum(n, 1)[:, None]


def train(samples: list[tuple[str, str]], hidden: int = HIDDEN, rounds: int = ROUNDS, seed: int = 7) -> ByteGru | None:
    """A network from (lang, text) rows; None without rows."""
    labels = sorted({lang for lang, _ in samples})
    if not labels:
        return None
    stretches, ys = [], []
    for lang, text in samples:
        raw = text.encode("utf-8", "surrogatepass")
        for at in range(0, max(len(raw) - STRETCH // 2, 1), STRETCH):
            stretches.append(raw[at : at + STRETCH].ljust(STRETCH, b"\0"))
            ys.append(labels.index(lang))
    x, y = np.frombuffer(b"".join(stretches), dtype=np.uint8).reshape(-1, STRETCH), np.array(ys)
    net, rng = ByteGru(labels, hidden, seed), np.random.default_rng(seed)
    # each language gets an equal share of every batch
    places = [np.flatnonzero(y == k) for k in range(len(labels))]
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    q = {k: np.zeros_like(v) for k, v in net.w.items()}
    for step in range(1, rounds + 1):
        pick = np.concatenate([rng.choice(p, max(1, BATCH // len(labels))) for p in places])
        _, grads = net.loss_and_grads(x[pick], y[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.02 * (1 - 0.9 * step / rounds)
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            q[k] = 0.99 * q[k] + 0.01 * g * g
            net.w[k] = (net.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def training_rows(docs: DataFrame) -> list[tuple[str, str]]:
    """At most PER_LANGUAGE pieces of each language; Spark limits each task's rows before they meet."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}"))
    known = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(SAMPLE + 1).collect()}
    if not known:
        return []
    if len(known) > SAMPLE:
        raise ValueError(f"more than {SAMPLE} languages")
    most = max(1, min(PER_LANGUAGE, SAMPLE // len(known)))
    h = F.xxhash64(F.col("doc_id"), F.col("text"))
    # a share of the hashes that leaves about twice the rows wanted, so that few rows meet at any scale
    share = F.create_map(*[F.lit(x) for lang, n in known.items() for x in (lang, int((1 << 31) * min(1.0, max(2 * most, most + 30) / n)))])
    rows = rows.where(F.pmod(F.xxhash64(h), F.lit(1 << 31)) < F.element_at(share, F.col("lang")))
    begin = F.pmod(h, F.greatest(F.length("text") - PIECE, F.lit(1))).cast("int") + 1
    pieces = rows.select("lang", h.alias("h"), F.substr("text", begin, F.lit(PIECE)).alias("text"))
    w = Window.partitionBy("lang").orderBy("h", "text")
    few = pieces.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return [(r["lang"], r["text"]) for r in few.orderBy("lang", "n").collect()]


def _labeller(docs: DataFrame, net: ByteGru | None):
    """A function from texts to (languages, scores), for the executors."""
    net = net or train(training_rows(docs))
    shared = ship(docs.sparkSession).sparkContext.broadcast(net)

    def label(texts: list[str | None]) -> tuple[list[str], list[float]]:
        model = shared.value
        said, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        have = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model else []
        for a, b in batches([texts[i] for i in have]):
            p = model.pooled([texts[i].encode("utf-8", "surrogatepass") for i in have[a:b]])
            best = p.argmax(1)
            for i, k, v in zip(have[a:b], best.tolist(), p.max(1).tolist()):
                said[i], score[i] = model.labels[k], min(1.0, max(0.0, v))
        return said, score

    return label


def identify(docs: DataFrame, net: ByteGru | None = None) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, held_out, lang_pred, score."""
    label = _labeller(docs, net)

    @frugal("language_id")
    def predict(batches_):
        for batch in batches_:
            said, score = label(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(said, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def identify_all(docs: DataFrame, net: ByteGru | None = None) -> tuple[DataFrame, str, str]:
    """docs with all its columns and two more, whose names follow: predicted language and score; for filtering in one pass."""
    label = _labeller(docs, net)
    lang, score = free_names(docs, "lang_pred", "score")
    names = docs.columns

    @frugal("language_id")
    def predict(batches_):
        for batch in batches_:
            said, scores = label(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(scores, pa.float64())], names=[*names, lang, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(predict, schema), lang, score


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
