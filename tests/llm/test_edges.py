"""Measured recall and precision, brute force for disclosing terms, and awkward tables for every pipeline stage."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c
from tessera.llm import chat, decontam, dedup, langid, mixing, nearjoin, pii, rindex, secrets, shared, tokens

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# names that the stages use for columns of their own, and some of the tables they join
CLASHING = "_maybe string, _lang_pred string, _score string, _mix_s string, _mix_bin string, _file string, _row string, _h string, t long, g long, key string, base string, _own string, _key string"


# ------------------------------------------------------------------ secrets


def random_secrets(rng, n):
    kinds = [
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
        "0123456789ABCDEF",
        "abcdefghijklmnopqrstuvwxyz0123456789",
    ]
    return ["".join(rng.choice(kinds[i % len(kinds)]) for _ in range(rng.choice((20, 24, 32, 40)))) for i in range(n)]


def test_markov_precision_and_recall(spark, sf):
    """Random strings that no base pattern finds, and identifiers made of words that were held back from the sample."""
    rng = random.Random(11)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id % 3 > 0")
    table = secrets.ratio_table(secrets.labelled_samples(docs))
    held = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 = 0 and lang is not null").select("text").collect()
    words = sorted({w for r in held for w in re.findall("[A-Za-z]{4,}", r.text or "")})
    join = [lambda a: a[0].lower() + "".join(x.title() for x in a[1:]), lambda a: "_".join(a).lower(), lambda a: "_".join(a).upper(), lambda a: "/".join(a), lambda a: "-".join(a).lower()]
    good = []
    while len(good) < 400:
        made = join[len(good) % 5]([rng.choice(words) for _ in range(4)])
        good += [made] if len(made) >= 16 else []
    bad = random_secrets(rng, 400)
    rows = [(i, f"before {x} after") for i, x in enumerate(good + bad)]
    found = {r.doc_id: [(s.start, s.end) for s in r.added] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()}
    hit = sum(found[400 + i] == [(7, 7 + len(x))] for i, x in enumerate(bad))
    wrong = sum(bool(found[i]) for i in range(400))
    print(f"recall {hit / 400:.3f}, precision {hit / (hit + wrong):.3f}")
    assert hit >= 0.95 * 400 and hit >= 0.95 * (hit + wrong)


# ------------------------------------------------------------------ disclosing terms


def brute_terms(rows, alpha=pii.ALPHA, support=pii.SUPPORT):
    """(row number, start, end) of all occurrences, from the definitions."""
    word = re.compile("[0-9A-Za-z_\u0080-\U0010ffff]+")
    holds, has, pair, seen = Counter(), Counter(), Counter(), []
    for _, text in rows:
        text = text or ""
        spans = pii.find_base(text)
        entities = {text[a:b].lower() for a, _, b in spans}
        places = [(m.group().lower(), *m.span()) for m in word.finditer(text)]
        outside = [p for p in places if not any(a < p[2] and p[1] < b for a, _, b in spans)]
        seen.append((entities, outside))
        holds.update(entities)
        has.update({w.lower() for w in word.findall(text.lower())})
        pair.update({(e, t) for e in entities for t, _, _ in outside})
    n, told = len(rows), defaultdict(set)
    for (e, t), k in pair.items():
        ic = math.log2(n / holds[e])
        if k >= support and ic > 0 and math.log2(k * n / (has[t] * holds[e])) >= alpha * ic - 1e-12:
            told[e].add(t)
    return {(i, a, b) for i, (entities, outside) in enumerate(seen) for t, a, b in outside if any(t in told[e] for e in entities)}


def test_disclosing_terms_by_brute_force(spark):
    rng = random.Random(5)
    people = [f"person{i}@corp.example" for i in range(6)] + ["+49 (30) 1234567", "10.0.0.7", "4111 1111 1111 1111"]
    common, rare = [f"common{i}" for i in range(12)], {p: [f"only{i}x{k}" for k in range(3)] + [str(70_000 + i)] for i, p in enumerate(people)}
    rows = []
    for i in range(260):
        words = rng.choices(common, k=12)
        for p in rng.sample(people, rng.choice((0, 0, 1, 1, 2))):
            words += [p, rng.choice(rare[p]), rng.choice(rare[p]).upper()]
        if rng.random() < 0.1:
            words.append(rng.choice(rng.choice(list(rare.values()))))
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    rows.append((260, None))
    got = {(r.doc_id, s.start, s.end) for r in pii.scan_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.added}
    want = brute_terms(rows)
    assert got == want and len(want) > 100


def test_sanitise_keeps_columns(spark):
    rows = [(i, f"okapi wrote to jane@corp.example {i}", "k", 1, "b") for i in range(4)] + [(100 + i, "nothing else wrote to", "k", 1, "b") for i in range(50)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, _own long, base string")
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) and got[0].text.startswith("[term] wrote to [email]") and (got[0].key, got[0]._own, got[0].base) == ("k", 1, "b") and got[None].text is None
    overlap = spark.createDataFrame([(1, "card 4111 1111 1111 1111 +4111 1111 1111 11 a@b.c")], "doc_id long, text string")
    assert re.fullmatch(r"card (\[card\]|\[phone\]| )+ \[email\]", pii.sanitise(overlap).first().text)


# ------------------------------------------------------------------ every stage on awkward tables



def with_clashes(spark, rows):
    n = len(CLASHING.split(", "))
    kinds = [x.split()[1] for x in CLASHING.split(", ")]
    more = tuple(7 if k == "long" else "mine" for k in kinds)
    assert len(more) == n
    return spark.createDataFrame([r + more for r in rows], f"{COLUMNS}, {CLASHING}"), more


def awkward_rows(sf_text):
    near = " ".join(f"word{i}" for i in range(120))
    long_text = " ".join(f"{w} {i}" for i, w in enumerate(["alpha", "beta", "gamma"] * 60_000))  # about two megabytes
    rows = [(1, near, "en", "a", 1), (2, near + " more", "en", "a", 1), (3, near, "en", None, 1), (3, near, "en", None, 1), (None, near, "en", "b", 1), (4, None, None, "b", None), (5, "", None, "b", 0)]
    rows += [(6, "!!! 12 ---", None, "c", 1), (7, long_text, "en", "c", 1), (7, "another text that shares its id", "en", "c", 1), (None, None, None, None, None)]
    return rows + [(100 + i, t, lang, "d", 1) for i, (t, lang) in enumerate(sf_text)]


@pytest.fixture(scope="module")
def awkward(spark, sf):
    some = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null").orderBy("doc_id").limit(60).collect()]
    rows = awkward_rows(some)
    docs, more = with_clashes(spark, rows)
    return shared.stored(docs, "test-awkward"), rows, more


@pytest.mark.parametrize("name,stage", c.STAGES)
def test_stage_empty(spark, sf, awkward, name, stage):
    docs = awkward[0]
    got = shared.stored(stage(spark, docs.limit(0), sf), "test-stage")
    assert got.count() == 0
    if name != "token_output":
        assert got.columns == docs.columns


@pytest.mark.parametrize("name,stage", c.STAGES)
def test_stage_awkward(spark, sf, awkward, name, stage):
    docs, rows, more = awkward
    got = shared.stored(stage(spark, docs, sf), "test-stage")
    if name == "token_output":
        assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in rows)
        return
    assert got.columns == docs.columns
    out = [tuple(r) for r in got.collect()]
    assert all(r[5:] == more for r in out)
    left = Counter((r[0], r[1]) for r in out)
    whole = Counter((r[0], r[1]) for r in rows)
    if name == "language_id":
        assert not any(r[0] in (4, 5, 6) or (r[0] is None and r[1] is None) for r in out)
        assert left[7, rows[8][1]] == 1 and left[1, rows[0][1]] == 1
    elif name == "near_duplicates":
        near = rows[0][1]
        assert left[1, near] == 1 and not any(r[0] in (2, 3) for r in out) and (None, near) not in left
        assert left[7, rows[8][1]] == 1 and left[7, rows[9][1]] == 1
        assert sum(not (r[1] or "") for r in out) == 1  # empty texts are copies of one another; null counts as empty
    elif name == "decontamination":
        assert left <= whole and all(left[k] == n for k, n in whole.items() if not k[0] or k[0] < 100)
    else:
        assert left == whole


# ------------------------------------------------------------------ very long texts, one by one


def test_long_texts(spark):
    """Texts of a megabyte or more: one long prose, one run without a blank, one of repeated words."""
    prose = " ".join(f"word{i * 7919 % 200_003}" for i in range(120_000))
    texts = [prose, "a" * 1_500_000, "é" * 500_000, "same words again " * 60_000]
    docs = shared.stored(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")}), "test-long")
    assert dedup.exact_dedup(docs).where("kept").count() == 4
    assert {r.doc_id: r.n_tokens > 0 for r in tokens.token_output(docs, ["doc_id", "_tie"]).collect()} == dict.fromkeys(range(4), True)
    assert langid.identify(docs).count() == 4
    assert {r.doc_id: r.n_links for r in nearjoin.near_links(docs).collect()} == dict.fromkeys(range(4), 0)
    bench = spark.createDataFrame([(1, prose[1_000_000:1_000_200])], "item_id long, text string")
    assert [r.doc_id for r in decontam.contaminated(docs, bench).collect()] == [0]
    assert {r.doc_id: r.n_removed for r in rindex.substring_dedup(docs).collect()} == {0: 0, 1: 1_500_000, 2: 1_000_000, 3: len(texts[3])}
    assert mixing.mix(docs).count() == 4
    assert pii.scan_personal(docs).where("size(base) > 0").count() == 0
    assert secrets.scan_secrets(docs.where("doc_id > 1")).where("size(base) > 0").count() == 0


def test_long_conversation(spark):
    rows = spark.range(20_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 3 = 0, 'user', 'assistant') AS role", "concat('text </s> ', id) AS text")
    got = chat.read_chat(chat.format_chat(rows)).selectExpr("size(turns) AS n", "size(loss_texts) AS m", "loss_texts[0] AS a").first()
    assert (got.n, got.m, got.a) == (20_000, 13_333, "text </s> 1")
