"""Chat formatting by relational means: Spark expressions only.

Template (control strings are fixed values):

* `<s>` opens a conversation.
* a run of adjacent turns of one role is one block: user `[INST] ... [/INST]`, assistant
  `[OUT] ... </s>`, any other role `[ROLE]name[/ROLE] ... [/TURN]`.  The texts inside the block are
  set off by one blank at either end and joined by `[SEP]`.
* inside texts and role names every backslash is doubled and every control string gets a backslash
  after its first character, so an escaped text contains no control string at all, and removing the
  first backslash of each pair restores it.

Output: `formatted`, and `loss_spans`: (start, end) in code points and (byte_start, byte_end) in UTF-8
bytes of each assistant text.

Scale: one aggregate on conv_id; only turn, role and text are shuffled.  A conversation is one output
row, so its turns meet in one task by contract; its turns are sorted (n log n), and runs, pieces and places
are cut by slices and chunked running sums, without growing an array turn by turn.  Hot conversations are bounded by the 2 GB that a string may have.

Defined cases: null text and null role count as empty; turns are ordered by (turn, role, text), null
turns first; repeated rows are turns of their own; a null conv_id is a conversation of its own; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound, prefix_sums

# Control strings of the template.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "[/TURN]", "[SEP]"]
_CONTROL_PATTERN = r"([<\[])(/?(?:INST|TURN|ROLE|OUT|SEP)\]|/?s>)"
_BLOCKS = r"\[INST\] ([\s\S]*?) \[/INST\]|\[OUT\] ([\s\S]*?) </s>|\[ROLE\]([\s\S]*?)\[/ROLE\] ([\s\S]*?) \[/TURN\]"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), _CONTROL_PATTERN, r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\s\S])", "$1")


def format_chat(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans from rows of (conv_id, turn, role, text)."""
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    convs = convs.select(
        "conv_id",
        F.transform("t", lambda x: x["role"]).alias("roles"),
        F.transform("t", lambda x: escape(x["text"])).alias("texts"),
    )
    # first turn of each run (1-based), and one past the end as the last entry
    starts = F.filter(
        F.sequence(F.lit(1), F.size("roles")), lambda i: (i == 1) | (F.element_at("roles", i) != F.get("roles", i - 2))
    )
    convs = convs.withColumn("starts", F.concat(starts, F.array(F.size("roles") + 1)))
    convs = convs.select(
        "conv_id",
        F.transform(
            F.slice("starts", F.lit(1), F.size("starts") - 1),
            lambda s, k: F.struct(
                F.element_at("roles", s).alias("role"), F.slice("texts", s, F.get("starts", k + 1) - s).alias("texts")
            ),
        ).alias("runs"),
    )
    role = lambda r: r["role"]
    head = lambda r: F.when(role(r) == "user", "[INST] ").when(role(r) == "assistant", "[OUT] ").otherwise(F.concat(F.lit("[ROLE]"), escape(role(r)), F.lit("[/ROLE] ")))
    tail = lambda r: F.when(role(r) == "user", " [/INST]").when(role(r) == "assistant", " </s>").otherwise(" [/TURN]")
    # pieces: template text and turn texts in turn, each marked whether the loss counts it
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    pieces = F.flatten(
        F.transform(
            "runs",
            lambda r: F.concat(
                F.array(piece(head(r), F.lit(False))),
                F.flatten(
                    F.transform(
                        r["texts"],
                        lambda t, i: F.when(i == 0, F.array(piece(t, role(r) == "assistant"))).otherwise(
                            F.array(piece(F.lit("[SEP]"), F.lit(False)), piece(t, role(r) == "assistant"))
                        ),
                    )
                ),
                F.array(piece(tail(r), F.lit(False))),
            ),
        )
    )
    convs = convs.select("conv_id", F.concat(F.array(piece(F.lit("<s>"), F.lit(False))), pieces).alias("pieces"))
    # running lengths in code points and bytes
    ends = F.zip_with(
        prefix_sums(F.transform("pieces", lambda p: F.length(p["text"]))),
        prefix_sums(F.transform("pieces", lambda p: F.octet_length(p["text"]))),
        lambda c, b: F.struct(c.cast("int").alias("c"), b.cast("int").alias("b")),
    )

    def span(p, e):
        begin, byte_begin = e["c"] - F.length(p["text"]), e["b"] - F.octet_length(p["text"])
        return F.when(p["loss"], F.struct(begin.alias("start"), e["c"].alias("end"), byte_begin.alias("byte_start"), e["b"].alias("byte_end")))

    return convs.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        F.filter(F.zip_with("pieces", ends, span), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """conv_id, turns: array<struct<role,text>>, loss_texts: array<string>, read back from the output."""
    blocks = F.regexp_extract_all("formatted", F.lit(_BLOCKS), F.lit(0))

    def parse(b):
        user, out = b.startswith("[INST] "), b.startswith("[OUT] ")
        name = F.substring_index(F.substr(b, F.lit(7)), "[/ROLE]", 1)
        cut = F.when(user, F.lit(7)).when(out, F.lit(6)).otherwise(F.length(name) + 14)
        end = F.when(user, F.lit(8)).when(out, F.lit(5)).otherwise(F.lit(8))
        body = F.substr(b, cut + 1, F.length(b) - cut - end)
        who = F.when(user, F.lit("user")).when(out, F.lit("assistant")).otherwise(unescape(name))
        return F.transform(F.split(body, r"\[SEP\]", -1), lambda t: F.struct(who.alias("role"), unescape(t).alias("text")))

    return formatted.select(
        "conv_id",
        F.flatten(F.transform(blocks, parse)).alias("turns"),
        # encoded once; each span is cut out by its bytes
        bound(
            F.encode("formatted", "UTF-8"),
            lambda raw: F.transform("loss_spans", lambda s: unescape(F.decode(F.substr(raw, s["byte_start"] + 1, s["byte_end"] - s["byte_start"]), "UTF-8"))),
        ).alias("loss_texts"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    back = read_chat(format_chat(turns.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, lag(role) OVER w AS prev, row_number() OVER w AS i,
         length(regexp_replace(replace(text, '\', '\\'),
                '([<\[])(/?(?:INST|TURN|ROLE|OUT|SEP)\]|/?s>)', '\1.\2', 'g')) AS n_text,
         length(regexp_replace(replace(role, '\', '\\'),
                '([<\[])(/?(?:INST|TURN|ROLE|OUT|SEP)\]|/?s>)', '\1.\2', 'g')) AS n_role
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(n_text + CASE WHEN prev = role THEN 5
                                  WHEN role = 'user' THEN 15
                                  WHEN role = 'assistant' THEN 11
                                  ELSE n_role + 22 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
