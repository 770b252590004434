"""Mixing sources to target weights by Pfair scheduling.

Each source is a task whose subtasks are blocks of `BLOCK` documents.  With integer weights a of sum D,
block i (from 0) of a source is released at floor(i D / a) and due at ceil((i + 1) D / a); in each slot the
released block of the earliest deadline goes (ties: source name).  On one processor at full load this
meets every deadline, so at any slot a source is less than one block off its target share.

The schedule repeats after D slots, so one period, computed once, gives the slot of every block by
arithmetic.  When a source runs out, a new phase starts for the others with their weights; there is a phase
per source at most.  No document is dropped or repeated: the mix ends when every source has.

Scale: counts per source reach the driver (at most `MAX_SOURCES` rows, checked) and the plan goes back as
a broadcast of at most `MAX_PLAN` numbers (checked).  Documents are numbered within (source, hash bin), so
a source with a third of all rows spreads over up to 65,536 bins; bin offsets come from a small table of
counts.  Whole rows move once for numbering and, in `mix_in_order`, once to be laid down in order.

Defined cases: a null source counts as the source named by the empty string; documents of a source come in
the order of md5(doc_id), then doc_id, then a hash of the text, so equal rows may swap without effect;
null text is carried along; an empty table gives an empty result; columns of any name are kept (but for those that `mix` adds).
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, file_number, free_names

BLOCK = 32
DENOMINATOR = 1000
MAX_SOURCES = 4096
MAX_PLAN = 4_000_000
BIN_ROWS = 128
MAX_BIN_DIGITS = 4


def smoothed_weights(counts: dict[str, int], power: float = 0.5) -> dict[str, int]:
    """Integer weights in proportion to count^power, 1 at least."""
    total = sum(math.pow(n, power) for n in counts.values())
    return {s: max(1, math.floor(DENOMINATOR * math.pow(n, power) / total + 0.5)) for s, n in counts.items()}


def period(weights: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks in one period of sum(weights) slots, by earliest deadline first."""
    d = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in weights}
    waiting = [(0, s) for s in weights]  # (release, source): one block of each source is pending
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    for t in range(d):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            i = len(slots[s])
            heapq.heappush(ready, (-(-(i + 1) * d // weights[s]), s))
        due, s = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline is missed")
        slots[s].append(t)
        i = len(slots[s])
        if i < weights[s]:
            heapq.heappush(waiting, (i * d // weights[s], s))
    return slots


def plan(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple]:
    """Rows (source, phase, first_block, end_block, first_slot, period, slots of a period) for all blocks."""
    left, done = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0)
    out, at, phase = [], 0, 0
    while left:
        active = {s: weights[s] for s in left}
        d, slots = sum(active.values()), period(active)
        # the phase ends with the slot in which the first source places its last block
        last = min((n - 1) // active[s] * d + slots[s][(n - 1) % active[s]] for s, n in left.items()) + 1
        for s in list(left):
            whole, rest = divmod(last, d)
            n = whole * active[s] + sum(t < rest for t in slots[s])
            out.append((s, phase, done[s], done[s] + n, at, d, slots[s][: max(n, 1)]))
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        at, phase = at + last, phase + 1
    return out


def _source() -> Column:
    return F.coalesce(F.col("source"), F.lit(""))


def _placed(docs: DataFrame, weights: dict[str, int] | None, block: int) -> tuple[DataFrame, str]:
    """docs with one more column, whose name follows: struct<block,phase,slot,position>."""
    spark = docs.sparkSession
    counts = {r[0]: r[1] for r in docs.groupBy(_source().alias("s")).count().limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: give coarser ones")
    weights = weights or smoothed_weights(counts)
    missing = sorted(set(counts) - set(weights))
    if missing:
        raise ValueError(f"no weight for {missing[:5]}")
    rows = plan({s: -(-n // block) for s, n in counts.items()}, weights)
    if sum(len(r[6]) for r in rows) > MAX_PLAN:
        raise ValueError("the plan is too long: use a smaller sum of weights")
    by_source: dict[str, list] = {}
    for s, *rest in rows:
        by_source.setdefault(s, []).append(tuple(rest))
    names = ["phase", "first", "end", "at", "period", "slots"]
    kind = pa.list_(pa.struct([(n, pa.list_(pa.int32()) if n == "slots" else pa.int64()) for n in names]))
    plans = [[dict(zip(names, p)) for p in ps] for ps in by_source.values()]
    # names that docs does not have
    src, h, bin_, t, n, before, i, plan_, mine, mix_ = free_names(docs, *"source_ hash bin text_hash n before i plan mine mix".split())
    phases = spark.createDataFrame(pa.table({src: pa.array(list(by_source), pa.string()), plan_: pa.array(plans, kind)}))

    digits = min(MAX_BIN_DIGITS, max(1, math.ceil(math.log(max(1, max(counts.values(), default=1) / BIN_ROWS), 16))))
    keyed = docs.withColumn(src, _source()).withColumn(h, F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = keyed.withColumn(bin_, F.substring(h, 1, digits)).withColumn(t, F.xxhash64("text") if "text" in docs.columns else F.lit(0))
    bins = keyed.groupBy(src, bin_).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(src).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n)
    inside = Window.partitionBy(src, bin_).orderBy(h, "doc_id", t)
    numbered = keyed.withColumn(i, F.row_number().over(inside) - 1).join(bins, [src, bin_])
    numbered = numbered.withColumn(i, F.col(i) + F.col(before))

    at = F.floor(F.col(i) / block)
    placed = numbered.join(F.broadcast(phases), src).withColumn(mine, F.element_at(F.filter(plan_, lambda p: (p["first"] <= at) & (at < p["end"])), 1))
    mine = F.col(mine)
    k, per = at - mine["first"], F.size(mine["slots"])
    # a plan shorter than a period holds all blocks of its phase
    slot = (mine["at"] + F.floor(k / per) * mine["period"] + F.get(mine["slots"], F.pmod(k, per).cast("int"))).cast("long")
    position = (slot * block + F.pmod(i, F.lit(block))).cast("long")
    out = F.struct(at.cast("long").alias("block"), mine["phase"].alias("phase"), slot.alias("slot"), position.alias("position"))
    return placed.select(*docs.columns, out.alias(mix_)), mix_


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK) -> DataFrame:
    """docs with _mix_block (number within the source), _mix_phase, _mix_slot and _mix_position, which replace columns of these names."""
    placed, mix_ = _placed(docs, weights, block)
    told = {f"_mix_{k}": F.col(f"{mix_}.{k}") for k in ("block", "phase", "slot", "position")}
    return placed.select(*[c for c in docs.columns if c not in told], *[v.alias(k) for k, v in told.items()])


def mix_in_order(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK) -> DataFrame:
    """The columns of docs, rows laid down in the order of the mix, a range of it for each file that is to be written."""
    placed, mix_ = _placed(docs, weights, block)
    position = F.col(f"{mix_}.position")
    return placed.repartitionByRange(file_number(docs), position).sortWithinPartitions(position).select(*docs.columns)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select(
        "doc_id",
        _source().alias("source"),
        F.col("_mix_block").alias("block"),
        F.col("_mix_phase").alias("phase"),
        F.col("_mix_slot").alias("slot"),
        F.col("_mix_position").alias("position"),
    )


OP1_SQL = r"""
WITH RECURSIVE c AS (
  SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1
), w AS (
  SELECT s, n, (n + 31) // 32 AS m,
         greatest(1, CAST(floor(1000 * sqrt(n) / sum(sqrt(n)) OVER () + 0.5) AS BIGINT)) AS a
  FROM c
), cfg AS (
  SELECT list(s ORDER BY s) AS ss, list(m ORDER BY s) AS ms, list(a ORDER BY s) AS aa, sum(m) AS total, count(*) AS k FROM w
), sim AS (
  SELECT CAST(0 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS phase, CAST(0 AS BIGINT) AS tau,
         list_transform(ms, lambda x: CAST(0 AS BIGINT)) AS st,
         list_transform(ms, lambda x: CAST(0 AS BIGINT)) AS dn,
         CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS of_phase
  FROM cfg
  UNION ALL
  SELECT slot + 1, CASE WHEN over THEN phase + 1 ELSE phase END, CASE WHEN over THEN 0 ELSE tau + 1 END,
         CASE WHEN over THEN nd ELSE st END, nd, pick, block, phase
  FROM (
    SELECT *, list_transform(dn, lambda x, i: CASE WHEN i = pick THEN x + 1 ELSE x END) AS nd,
           dn[pick] AS block, dn[pick] + 1 = ms[pick] AS over
    FROM (
      SELECT sim.slot, sim.phase, sim.tau, sim.st, sim.dn, d.ms,
             list_min(list_transform(
               list_filter(range(1, d.k + 1), lambda i: d.st0[i] < d.ms[i] AND ((sim.dn[i] - sim.st[i]) * d.dd) // d.aa[i] <= sim.tau),
               lambda i: [((sim.dn[i] - sim.st[i] + 1) * d.dd + d.aa[i] - 1) // d.aa[i], i]))[2] AS pick
      FROM sim, LATERAL (
        SELECT ms, aa, k, total, sim.st AS st0,
               CAST(list_sum(list_transform(range(1, k + 1), lambda i: CASE WHEN sim.st[i] < ms[i] THEN aa[i] ELSE 0 END)) AS BIGINT) AS dd
        FROM cfg) d
      WHERE sim.slot < d.total
    )
  )
), placed AS (
  SELECT cfg.ss[pick] AS s, block, of_phase AS phase, slot - 1 AS slot FROM sim, cfg WHERE pick > 0
), numbered AS (
  SELECT doc_id, coalesce(source, '') AS s,
         row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS i
  FROM documents
)
SELECT n.doc_id, n.s AS source, n.i // 32 AS block, p.phase, p.slot, p.slot * 32 + n.i % 32 AS position
FROM numbered n JOIN placed p ON p.s = n.s AND p.block = n.i // 32
"""
