"""Secret scan: fixed patterns, and character Markov models by log-likelihood ratio.  DataFrame functions only.

*Base spans* are the leftmost non-overlapping matches of three fixed patterns.  Spark gives no match
positions, but `split` by a pattern and `regexp_extract_all` of it give the texts between and of the
matches, whose lengths add up to them.

*Markov spans* (kind `markov`): runs of key characters of `MIN_RUN` or more, of whatever characters, that overlap no base
span are scored with two first-order character models, one of random strings and one of ordinary identifiers.
A run is reported, whole, where the mean log-likelihood ratio (bits per transition) of some stretch of at least `MIN_RUN`
characters reaches `THRESHOLD`, so ordinary text around a secret hides nothing.  Transitions from and to `JOINTS` count 0 bits.
The models are trained from labelled samples: random strings drawn from digests (base64, base-16 and
mixed case, `SAMPLE` of each), and identifiers made of the words (alone, and pairs in camel, snake and upper case) of about `SAMPLE` documents without base
spans: those whose hash of doc_id falls into a share of its range.  Only transition counts, at most alphabet^2 per model, reach the
driver; they become one literal array.

Scale: one pass over the texts and no shuffle besides the transition counts of the bounded training sample.

Defined cases: null and empty texts have no spans; one result row per row of the table, repeated rows
included; without any identifier to learn from, the identifier model is uniform; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound, documents, prefix_sums, text_of

# The base patterns, in their order, and how long what they find must be.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"  # the runs of 24 or more of it
KINDS = ["assign", "access", "hex", "markov"]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
JOINTS = "+/_=-"
MIN_RUN = 16
RUN = r"[A-Za-z0-9+/_=-]{16,}"
SAMPLE = 4_000
THRESHOLD = 1.0
SMOOTHING = 10.0


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """array<struct<start,kind,end>> of the matches that `keep` accepts; empty where there is none."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ends = lambda hits: prefix_sums(F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0))))
    span = lambda h, e: F.struct((e - F.length(h)).cast("int").alias("start"), F.lit(kind).alias("kind"), e.cast("int").alias("end"))
    # behind the last match lies one more gap, whose match is null
    placed = bound(found, lambda hits: F.zip_with(hits, ends(hits), lambda h, e: F.when(h.isNotNull() & keep(h), span(h, e))))
    return F.when(text.rlike(pattern), F.filter(placed, lambda s: s.isNotNull())).otherwise(empty)


def base_spans(text: Column) -> Column:
    # the length bounds are in the quick test too: a text without a long enough match is done after it
    long_hex = F.when(text.rlike("[0-9a-f]{24}"), _spans(text, "[0-9a-f]{24,}", 2, lambda h: F.lit(True)))
    access = F.when(text.rlike("AKIA[A-Z0-9]{16}"), _spans(text, ACCESS, 1, lambda h: F.length(h) >= 20))
    assign = _spans(text, ASSIGN, 0, lambda h: F.length(F.regexp_extract(h, ASSIGN, 1)) >= 6)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.sort_array(F.concat(assign, F.coalesce(access, empty), F.coalesce(long_hex, empty)))


def _named(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


# ------------------------------------------------------------------ Markov models


def labelled_samples(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(label, word): 1 for random strings, 0 for ordinary identifiers."""
    spark = docs.sparkSession
    seeds = spark.range(sample).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    random = seeds.select(
        F.explode(F.array(F.col("h"), F.regexp_replace(F.base64(F.unhex("h")), "=+$", ""), F.upper(F.base64(F.unhex(F.sha2("h", 256)))))).alias("word")
    )
    # about `sample` texts whatever their number: those whose hash falls into the right share of its range
    share = int((1 << 31) * min(1.0, sample / max(1, docs.count())))
    texts = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < share).select(text_of().alias("text")).where(F.col("text") != "")
    words = texts.where(F.size(base_spans(F.col("text"))) == 0).select(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z_]{3,}"), F.lit(0)).alias("w"))
    a, b = F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1)
    words = words.where(F.size("w") > 1).select(
        "w", F.zip_with(a, b, lambda x, y: F.concat(F.lower(x), F.initcap(y))).alias("camel"), F.zip_with(a, b, lambda x, y: F.concat_ws("_", F.lower(x), F.lower(y))).alias("snake")
    )
    words = words.select(F.explode(F.concat("w", "camel", "snake", F.transform("snake", lambda x: F.upper(x)))).alias("word"))
    return random.select(F.lit(1).alias("label"), "word").unionAll(words.select(F.lit(0).alias("label"), "word"))


def ratio_table(samples: DataFrame) -> list[float]:
    """log2 P(b|a, random) - log2 P(b|a, identifier) at [a * n + b]; letters outside the alphabet share one place; 0 at JOINTS."""
    n = len(ALPHABET) + 1
    code = lambda c: F.instr(F.lit(ALPHABET), c) if isinstance(c, str) else F.call_function("instr", F.lit(ALPHABET), c)
    words = samples.groupBy("label", "word").agg(F.count(F.lit(1)).alias("n"))  # frequent words are taken apart once
    codes = words.select("label", "n", F.transform(F.split("word", ""), code).alias("c"))
    pairs = codes.select("label", "n", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: a * n + b)).alias("ab"))
    counts = {(r["label"], r["ab"]): r["n"] for r in pairs.groupBy("label", "ab").agg(F.sum("n").alias("n")).collect()}  # 2 * n^2 rows at most
    logs = []
    for label in (0, 1):
        # a letter's followers are smoothed by the letters' own frequencies, those by half a count each
        own = [0.5 + sum(counts.get((label, a * n + b), 0) for a in range(n)) for b in range(n)]
        all_own = sum(own)
        rows = []
        for a in range(n):
            row = [counts.get((label, a * n + b), 0) for b in range(n)]
            rows += [math.log2((c + SMOOTHING * own[b] / all_own) / (sum(row) + SMOOTHING)) for b, c in enumerate(row)]
        logs.append(rows)
    # neither sample shows how words are joined in paths and names, so joints are no evidence for either
    joints = {ALPHABET.index(c) + 1 for c in JOINTS}
    return [0.0 if {k // n, k % n} & joints else r - i for k, (i, r) in enumerate(zip(*logs))]


def best_excess(run: Column, table: list[float], threshold: float) -> Column:
    """The most by which a stretch of MIN_RUN characters or more exceeds threshold bits per transition, in bits altogether.

    It is 0 or more where some stretch has a mean of threshold or more.  Linear: sums up to each transition less the
    least sum that lies a stretch or more before it.
    """
    n = len(ALPHABET) + 1
    folded = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")  # folded to a literal
    codes = F.transform(F.split(run, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    moves = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.element_at(folded, a * n + b + 1) - threshold)
    least = MIN_RUN - 1
    late = F.concat(F.array_repeat(F.lit(0.0), least), F.slice(moves, F.lit(1), F.size(moves) - least))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("behind"), F.lit(0.0).alias("low"), F.lit(float("-inf")).alias("best"))

    def step(acc, x):
        n, total, behind = acc["n"] + 1, acc["sum"] + x["now"], acc["behind"] + x["late"]
        low = F.least(acc["low"], behind)
        best = F.when(n >= least, F.greatest(acc["best"], total - low)).otherwise(acc["best"])
        return F.struct(n.alias("n"), total.alias("sum"), behind.alias("behind"), low.alias("low"), best.alias("best"))

    return F.aggregate(F.zip_with(moves, late, lambda a, b: F.struct(a.alias("now"), b.alias("late"))), zero, step, lambda a: a["best"])


def scan_secrets(docs: DataFrame, table: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text, base (array of spans) and added (array of Markov spans)."""
    table = table or ratio_table(labelled_samples(docs))
    found = docs.select("doc_id", text_of().alias("text")).withColumn("base", base_spans(F.col("text")))
    runs = _spans(F.col("text"), RUN, 3, lambda h: best_excess(h, table, threshold) >= 0)
    return found.withColumn(
        "added", F.filter(runs, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(_named(F.col("base")), 256).alias("base_sha256"),
        _named(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )
