"""Personal data: fixed patterns, and information-theoretic sanitisation of what reveals them.

*Base spans* are the leftmost non-overlapping matches of four fixed patterns with their checks.

*Disclosing terms* (kind `term`; after Sanchez and Batet's C-sanitisation): a base match's value is a
protected entity e.  Corpus co-occurrence in documents tells how strongly a term t (a word or number outside base spans) reveals it:
with p from document frequencies, PMI(t; e) = log2 p(t, e) / (p(t) p(e)); e's own information is
IC(e) = -log2 p(e).  Where PMI >= ALPHA * IC(e), with at least `SUPPORT` documents for the pair, t gives e
away, and all its occurrences in the documents that hold e are reported.  `sanitise` replaces base spans by their
kind and disclosing terms by a generalisation (`[term]`) or removes them.

Scale: one pass finds base spans and entities and writes these (narrow) rows to the shared
folder.  A pass over the texts counts documents per pair, only for entities that occur often enough, added up in
each task before the shuffle; another counts documents per term, only for terms seen with an entity often enough;
the last one finds the places of the disclosing pairs.  Bitmaps of fixed size tell documents and
words that matter, and exact joins follow; no text is shuffled.

Defined cases: null and empty texts have no spans; one result row per row of the table; repeated rows
count as documents of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import ship
from .shared import batches, bound, documents, free_names, span_hashes, stored, text_of, words_of

# The base patterns, in their order.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # same matches as without the bounds, in linear time
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ["email", "ip", "card", "phone", "term"]

ALPHA = 0.9
SUPPORT = 3

_DIGIT = re.compile("[0-9]")
_ATOM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TERM = re.compile("[0-9A-Za-z_\u0080-\U0010ffff]+")  # the words of shared.words_of


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _emails(text: str):
    """EMAIL.finditer, started only where an '@' shows that a match may begin: linear on long runs."""
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _ATOM:
            begin -= 1
        m = EMAIL.match(text, begin) if begin < at else None
        if m:
            yield m.start(), m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), ordered by start and then kind."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            for m in IP.finditer(text):
                parts = m.group().split(".")
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
                    out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = _digits(m.group())
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def keys_of(terms: list[str]) -> list[int]:
    """Hashes of single words, as words_of gives them."""
    data = [t.encode("utf-8", "surrogatepass") for t in terms]
    ends = np.cumsum([len(d) for d in data], dtype=np.int64)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    return span_hashes(np.frombuffer(b"".join(data), dtype=np.uint8), starts, ends).view(np.int64).tolist() if terms else []


def _terms(text: str, covered: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The terms of a text that lie outside the covered spans (ordered by start), in order."""
    out, reach, at = [], 0, 0  # reach: the furthest end of the spans that begin before the term's end
    for m in _TERM.finditer(text):
        x, y = m.span()
        while at < len(covered) and covered[at][0] < y:
            reach = max(reach, covered[at][1])
            at += 1
        if x >= reach:
            out.append((m.group().lower(), x, y))
    return out


SPAN = "array<struct<start:int,kind:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def _entities(text: str, spans) -> list[int]:
    """Hashes of the distinct protected values of a text."""
    return keys_of(sorted({text[a:b].lower() for a, _, b in spans}))


def _scan(batches_):
    """Base spans and entities of each text."""
    for batch in batches_:
        base, entities = [], []
        for text in batch.column("text").to_pylist():
            spans = find_base(text)
            base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            entities.append(_entities(text, spans))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(base, _SPANS), pa.array(entities, pa.list_(pa.int64()))], names=["doc_id", "key", "base", "entities"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("key", F.xxhash64("text"))


def scanned(docs: DataFrame) -> DataFrame:
    return _keyed(docs).mapInArrow(_scan, f"doc_id long, key long, base {SPAN}, entities array<long>")


_BITS = 1 << 22


def _bitmap(spark: SparkSession, hashes: DataFrame):
    """A broadcast bitmap of the one column of hashes: 512 KiB whatever their number."""
    at = np.array([r[0] for r in hashes.select(F.pmod(hashes[0], F.lit(_BITS)).cast("int").alias("b")).distinct().collect()], dtype=np.int64)
    bits = np.zeros(_BITS, dtype=bool)
    bits[at] = True
    return spark.sparkContext.broadcast(np.packbits(bits))


def _in(packed: np.ndarray, h: int) -> bool:
    at = h % _BITS
    return bool(packed[at >> 3] >> (7 - (at & 7)) & 1)


def _totals(totals: dict[int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], names=["term", "n"])


def term_frequencies(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, t_docs): the number of documents that hold each wanted term.

    A bitmap of the wanted hashes (512 KiB whatever their number) drops other words on the spot; what
    passes is counted per task, then by key, and joined with the wanted terms.
    """
    shared = _bitmap(texts.sparkSession, wanted)

    def count(batches_):
        known, totals = np.unpackbits(shared.value).view(bool), {}
        for batch in batches_:
            all_texts = batch.column("text").to_pylist()
            for a, b in batches(all_texts):
                words, first, _, _ = words_of(all_texts[a:b])
                doc = np.repeat(np.arange(b - a), np.diff(first))
                keep = known[(words % np.uint64(_BITS)).astype(np.int64)]
                pairs = np.unique(np.stack([words[keep], doc[keep].astype(np.uint64)]), axis=1)
                terms, n = np.unique(pairs[0], return_counts=True)
                for t, k in zip(terms.view(np.int64).tolist(), n.tolist()):
                    totals[t] = totals.get(t, 0) + k
                if len(totals) > 500_000:
                    yield _totals(totals)
                    totals = {}
        if totals:
            yield _totals(totals)

    counts = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("t_docs"))
    return counts.join(wanted, "term")


def _holders(text: str, packed: np.ndarray) -> tuple[list[int], list[tuple[str, int, int]]]:
    """The entities of a text that the bitmap may hold, and the text's terms if there is any."""
    spans = find_base(text)
    entities = [e for e in _entities(text, spans) if _in(packed, e)] if spans else []
    return entities, _terms(text, [(a, b) for a, _, b in spans]) if entities else []


def document_pairs(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, term, n): n documents hold the entity and, anywhere, the term; added up by key afterwards.

    A null entity stands for any: n documents with some entity hold the term.
    """
    shared = _bitmap(docs.sparkSession, entities)

    def count(batches_):
        packed, totals = shared.value, {}

        def told(keys):
            names = ["entity", "term", "n"]
            return pa.RecordBatch.from_arrays([pa.array([e for e, _ in keys], pa.int64()), pa.array([t for _, t in keys], pa.int64()), pa.array(list(keys.values()), pa.int64())], names=names)

        for batch in batches_:
            for text in batch.column("text").to_pylist():
                held, terms = _holders(text, packed)
                keys = keys_of(sorted({t for t, _, _ in terms}))
                for e in [None, *held] if held else ():
                    for t in keys:
                        totals[e, t] = totals.get((e, t), 0) + 1
                    if len(totals) > 200_000:
                        yield told(totals)
                        totals = {}
        if totals:
            yield told(totals)

    return _keyed(docs).mapInArrow(count, "entity long, term long, n long").groupBy("entity", "term").agg(F.sum("n").alias("docs"))


def disclosing_terms(seen: DataFrame, docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(entity, term) hashes where the term's PMI with the entity reaches alpha times the entity's information."""
    none = docs.sparkSession.range(0).select(F.col("id").alias("entity"), F.col("id").alias("term"))
    own = seen.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("e_docs"))
    # a pair has no more documents than its entity
    own = stored(own.where(F.col("e_docs") >= support), "pii-entities")
    if own.isEmpty():
        return none
    pairs = stored(document_pairs(docs, own.select("entity")).where(F.col("docs") >= support), "pii-pairs")
    n = seen.count()
    # documents that hold a term and some entity are a lower bound of those that hold it, so a pair
    # that falls short with that bound falls short with the count
    least = pairs.where("entity is null").select("term", F.col("docs").alias("least"))
    joined = pairs.join(own, "entity").join(least, "term")
    ic = F.log2(F.lit(float(n)) / F.col("e_docs"))
    pmi = lambda t_docs: F.log2(F.col("docs") * F.lit(float(n)) / (F.col(t_docs) * F.col("e_docs")))
    joined = stored(joined.where((ic > 0) & (pmi("least") >= alpha * ic)), "pii-candidates")
    wanted = joined.select("term").distinct()
    if wanted.isEmpty():
        return none
    df = term_frequencies(docs.select(text_of().alias("text")), wanted)
    return joined.join(df, "term").where(pmi("t_docs") >= alpha * ic).select("entity", "term")


def occurrences(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, key, start, end) of every occurrence of a disclosing term in a document that holds its entity.

    Bitmaps of the rules' entities and terms drop other documents and words on the spot; what passes is
    joined with the rules, a row for each pair of a document first and then the places.
    """
    spark = docs.sparkSession
    entities, terms_ = _bitmap(spark, rules.select("entity")), _bitmap(spark, rules.select("term"))
    places = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def find(batches_):
        for batch in batches_:
            rows = []
            for i, k, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text"))):
                held, terms = _holders(text, entities.value)
                at: dict = {}
                for h, (_, a, b) in zip(keys_of([t for t, _, _ in terms]), terms):
                    if _in(terms_.value, h):
                        at.setdefault(h, []).append({"start": a, "end": b})
                rows += [(i, k, held, t, p) for t, p in at.items()]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), places]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["doc_id", "key", "entities", "term", "places"])

    found = _keyed(docs).mapInArrow(find, "doc_id long, key long, entities array<long>, term long, places array<struct<start:int,end:int>>")
    found = found.select("doc_id", "key", F.explode("entities").alias("entity"), "term", "places").join(rules, ["entity", "term"])
    return found.select("doc_id", "key", F.explode("places").alias("p")).select("doc_id", "key", "p.*")


def scan_personal(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """doc_id, key (a hash of the text), base and added (arrays of spans in code points) for each row."""
    ship(docs.sparkSession)  # before any plan is built that needs the package
    seen = stored(scanned(docs), "pii-scan")
    rules = stored(disclosing_terms(seen, docs, alpha, support), "pii-rules")
    none = F.array().cast(SPAN)
    if rules.isEmpty():
        return seen.select("doc_id", "key", "base", none.alias("added"))
    span = F.struct("start", F.lit(4).alias("kind"), "end")
    told = occurrences(docs, rules).groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(span)).alias("added"))
    told = told.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "added")
    found = seen.select("doc_id", "key", "base").join(told, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return found.select("doc_id", "key", "base", F.coalesce("added", none).alias("added"))


def sanitise(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, generalise: bool = True) -> DataFrame:
    """docs with personal data replaced by `[kind]`, and disclosing terms by `[term]` (or removed)."""
    spans = scan_personal(docs, alpha, support).where(F.size("base") > 0).dropDuplicates(["doc_id", "key"])
    own, key, base, added = free_names(docs, "own", "key", "base", "added")
    spans = spans.select(F.col("doc_id").alias(own), F.col("key").alias(key), F.col("base").alias(base), F.col("added").alias(added))
    both = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(text_of()) == F.col(key)), "left")
    kinds = F.array(*[F.lit(f"[{k}]") if k != "term" or generalise else F.lit("") for k in KINDS])

    def cut(spans):
        """The pieces between spans, each with what stands for the span behind it; the spans that lie in earlier ones go."""
        # how far the spans before each one reach: it is sorted by start, so a running maximum
        reach = F.aggregate(spans, F.array().cast("array<int>"), lambda acc, s: F.concat(acc, F.array(F.greatest(s["end"], F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))))))
        return bound(reach, lambda ends: pieces(spans, ends))

    def pieces(spans, ends):
        before = F.concat(F.array(F.lit(0)), ends)
        marked = F.zip_with(spans, F.slice(before, F.lit(1), F.size(spans)), lambda s, at: F.struct(s.alias("s"), at.alias("at")))
        said = F.transform(
            F.filter(marked, lambda x: x["s"]["end"] > x["at"]),
            lambda x: F.concat(F.substr("text", x["at"] + 1, F.greatest(x["s"]["start"] - x["at"], F.lit(0))), F.element_at(kinds, x["s"]["kind"] + 1)),
        )
        return F.concat(F.array_join(said, ""), F.substr("text", F.coalesce(F.array_max(ends), F.lit(0)) + 1, F.length("text")))

    done = bound(F.sort_array(F.concat(base, added)), cut)
    return both.withColumn("text", F.when(F.col(base).isNull(), F.col("text")).otherwise(done)).select(*docs.columns)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_personal(documents(spark, sf_dir))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        number(0).alias("n_email"),
        number(1).alias("n_ip"),
        number(2).alias("n_card"),
        number(3).alias("n_phone"),
        F.sha2(said(F.col("base")), 256).alias("base_sha256"),
        said(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )
