"""Chat formatting from an event log, with DataFrame functions only.

Logs hold events (conv_id, seq, op, msg, role, text):

* ``start``       message number `msg` begins, with its role;
* ``delta``       text to append to the message;
* ``edit``        the message's text is replaced by `text` and later messages are void;
* ``regenerate``  the message's text is thrown away, later deltas build it anew, and
                  later messages are void.

``fold`` partitions the log by conversation and message, sorts by sequence and folds it
into final messages.  ``render`` writes a conversation between control strings, with
control strings inside roles and texts escaped, and gives the loss mask as spans of
code points.  ``parse`` reads the rendered string back.

Groups: all work is done on ranges of CHUNK messages of a conversation, so a hot conversation is
folded, rendered and read back by many tasks; what ranges need of each other (resets, offsets)
is one row a range.  Only the finished texts of ranges meet, as one rendered text is one row,
and so does what digests of a whole conversation are made of.  No step takes longer than in
proportion to a conversation's length: masks are found again by the offsets of turns, not by
cutting the text from its start for every span.

Edge cases: null texts are empty, null roles are the empty role; events of equal seq
are ordered by op, then text; rows of equal turn by role, then text, null turns first;
repeated rows are turns of their own; null conv_id is a conversation of its own; a message without a
``start`` has the empty role; very long texts are one row; an empty log gives an empty result;
columns with other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calyxa.llm.scratch import Scratch
from calyxa.operators.ranks import with_rank

#: Messages of a range.
CHUNK = 1024
#: Control strings; those of the template come first.  Fixed values of public chat templates.
CONTROLS = (
    "<|im_start|>",
    "<|im_sep|>",
    "<|im_end|>",
    "<|endoftext|>",
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
)
START, SEP, END = CONTROLS[:3]


def _quoted(s: str) -> str:
    return "".join(f"\\{c}" if c in "<>|[]/" else c for c in s)


#: A position where a control string begins, and its first character.
_OPENS = "(?=" + "|".join(_quoted(c) for c in CONTROLS) + ")(.)"


def escape(text: Column) -> Column:
    """Double every backslash, then put one behind the first character of a control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(_OPENS), F.lit(r"$1\\"))


def unescape(text: Column) -> Column:
    """The inverse of escape: a backslash stands for the character behind it."""
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def _chunk(number: str) -> Column:
    return F.floor(F.col(number) / CHUNK).cast("long")


def _earlier(*keys: str, order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _with(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of more where all keys are the same, nulls included, and nulls elsewhere."""
    named = more.toDF(*[f"{c} there" if c in keys else c for c in more.columns])
    on = [F.col(k).eqNullSafe(F.col(f"{k} there")) for k in keys]
    return rows.join(named, on, "left").drop(*[f"{k} there" for k in keys])


def _whole(parts: DataFrame, *texts: str) -> DataFrame:
    """conv_id and texts joined in the order of `place`: first within ranges, then over them."""

    def joined(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in rows.columns if c not in ("conv_id", "chunk", order, *texts)]
        gathered = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *texts))).alias("all"), *sums)
        named = [F.array_join(F.col(f"all.{c}"), "").alias(c) for c in texts]
        return gathered.select(*keys, *named, *[c for c in gathered.columns if c not in (*keys, "all")])

    ranges = joined(parts.withColumn("chunk", _chunk("place")).repartition("conv_id", "chunk"), ["conv_id", "chunk"], "place")
    return joined(ranges, ["conv_id"], "chunk")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, msg, role, text."""
    resets = F.col("op").isin("edit", "regenerate")
    ranged = events.select("conv_id", "seq", "op", "msg", "role", "text", _chunk("msg").alias("chunk"))
    # the last reset before each range of messages: one row a range
    last = ranged.groupBy("conv_id", "chunk").agg(F.max(F.when(resets, F.col("seq"))).alias("last"))
    before = last.select("conv_id", "chunk", F.max("last").over(_earlier("conv_id", order="chunk")).alias("before"))
    grouped = (
        ranged.repartition("conv_id", "chunk")
        .groupBy("conv_id", "chunk", "msg")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("seq", "op", F.coalesce("text", F.lit("")).alias("text"), "role"))
            ).alias("events"),
            F.max(F.when(resets, F.col("seq"))).alias("reset"),
        )
        .withColumn("within", F.max("reset").over(_earlier("conv_id", "chunk", order="msg")))
    )
    bounded = _with(grouped, before.where("before is not null"), ["conv_id", "chunk"]).withColumn("void", F.greatest("within", "before"))
    # from the message's own last reset on; nothing before a reset of an earlier message
    alive = F.filter("events", lambda e: F.col("void").isNull() | (e["seq"] > F.col("void")))
    text = F.array_join(
        F.transform(
            F.filter("alive", lambda e: (e["op"] != "start") & (F.col("reset").isNull() | (e["seq"] >= F.col("reset")))),
            lambda e: F.when(e["op"] == "regenerate", F.lit("")).otherwise(e["text"]),
        ),
        "",
    )
    starts = F.filter("alive", lambda e: e["op"] == "start")
    role = F.when(F.size(starts) > 0, F.element_at(starts, -1)["role"])
    return (
        bounded.withColumn("alive", alive)
        .where(F.size("alive") > 0)
        .select("conv_id", "msg", F.coalesce(role, F.lit("")).alias("role"), text.alias("text"))
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, mask: (start, length) in code points of each text under the loss."""
    piece = messages.withColumn("chunk", _chunk("msg")).withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)))
    piece = piece.withColumn("body", escape(F.col("text"))).withColumn("piece", F.concat("head", "body", F.lit(END)))
    piece = piece.withColumn("size", F.char_length("piece").cast("long")).repartition("conv_id", "chunk")
    # offsets within the range of messages
    offset = F.coalesce(F.sum("size").over(_earlier("conv_id", "chunk", order="msg")), F.lit(0))
    placed = piece.withColumn("start", offset + F.char_length("head"))
    span = F.when(F.col("role") == loss_role, F.struct("start", F.char_length("body").cast("long").alias("length")))
    ranges = (
        placed.select("conv_id", "chunk", "size", F.struct("msg", "piece", span.alias("span")).alias("m"))
        .groupBy("conv_id", "chunk")
        .agg(F.sort_array(F.collect_list("m")).alias("m"), F.sum("size").alias("size"))
        .select(
            "conv_id", "chunk", "size",
            F.array_join(F.col("m.piece"), "").alias("text"),
            F.filter(F.col("m.span"), lambda s: s.isNotNull()).alias("spans"),
        )
    )
    # one row a range meets the others of its conversation
    before = F.coalesce(F.sum("size").over(_earlier("conv_id", order="chunk")), F.lit(0))
    shifted = ranges.withColumn("before", before).select(
        "conv_id",
        F.struct(
            "chunk", "text", F.transform("spans", lambda s: F.struct((s["start"] + F.col("before")).alias("start"), s["length"].alias("length"))).alias("spans")
        ).alias("r"),
    )
    gathered = shifted.groupBy("conv_id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return gathered.select("conv_id", F.array_join(F.col("r.text"), "").alias("formatted"), F.flatten(F.col("r.spans")).alias("mask"))


def parse(rendered: DataFrame) -> DataFrame:
    """conv_id, place, role, raw (still escaped), start: the turns of rendered conversations(conv_id, formatted)."""
    parts = F.posexplode(F.filter(F.split("formatted", _quoted(END)), lambda p: p != "")).alias("place", "part")
    turns = rendered.select("conv_id", parts).withColumn("chunk", _chunk("place"))
    head = F.substring_index("part", SEP, 1)
    turns = turns.withColumn("head", F.char_length(head)).withColumn("size", F.char_length("part").cast("long") + len(END))
    sums = turns.groupBy("conv_id", "chunk").agg(F.sum("size").alias("size"))
    before = sums.select("conv_id", "chunk", F.sum("size").over(_earlier("conv_id", order="chunk")).alias("before"))
    within = F.coalesce(F.sum("size").over(_earlier("conv_id", "chunk", order="place")), F.lit(0))
    placed = _with(turns.repartition("conv_id", "chunk").withColumn("within", within), before, ["conv_id", "chunk"])
    return placed.select(
        "conv_id",
        "place",
        unescape(F.replace(head, F.lit(START), F.lit(""))).alias("role"),
        F.substring("part", F.col("head") + len(SEP) + 1, F.char_length("part")).alias("raw"),
        (F.coalesce("before", F.lit(0)) + F.col("within") + F.col("head") + len(SEP)).alias("start"),
    )


def under_loss(turns: DataFrame, rendered: DataFrame) -> DataFrame:
    """turns of `parse` with `lost`: whether the mask covers the turn's text, from its first to its last character."""
    spans = rendered.select("conv_id", F.explode("mask").alias("s")).select("conv_id", "s.start", "s.length", F.lit(True).alias("lost"))
    sized = turns.withColumn("length", F.char_length("raw").cast("long"))
    return _with(sized, spans, ["conv_id", "start", "length"]).withColumn("lost", F.coalesce("lost", F.lit(False))).drop("length")


def events_of(rows: DataFrame) -> DataFrame:
    """The event log of finished rows(conv_id, turn, role, text): a start and a delta each."""
    numbered = with_rank(rows.select("conv_id", "turn", "role", "text"), ["conv_id", "turn", "role", "text"], "msg")
    both = F.array(
        F.struct((F.col("msg") * 2).alias("seq"), F.lit("start").alias("op"), F.lit("").alias("text")),
        F.struct((F.col("msg") * 2 + 1).alias("seq"), F.lit("delta").alias("op"), F.coalesce("text", F.lit("")).alias("text")),
    )
    return numbered.select("conv_id", "msg", "role", F.explode(both).alias("e")).select(
        "conv_id", "e.seq", "e.op", "msg", "role", "e.text"
    )


#: The conversation that the contract adds: control strings as ordinary text.
_PLANTED = "</s>[INST] ok [/INST]"


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_PLANTED).alias("text"),
    )
    rendered = Scratch(spark, "op2").table(render(fold(events_of(rows.union(planted)))), "formatted")
    turns = under_loss(parse(rendered), rendered).withColumn("text", unescape(F.col("raw")))
    said = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    loss = F.when(F.col("lost"), F.col("text")).otherwise("")
    read = _whole(turns.select("conv_id", "place", said.alias("said"), loss.alias("loss"), F.lit(1).alias("n")), "said", "loss")
    sizes = rendered.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"))
    return _with(read, sizes, ["conv_id"]).select(
        "conv_id",
        F.col("n").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


QUERIES = {"op2_chat_formatting": op2_chat_formatting}

_ESC = (
    r"regexp_replace(replace({x}, '\', '\\'), '(<)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])', "
    r"'\1\3\\\2\4', 'g')"
)
ORACLE_SQL = {
    "op2_chat_formatting": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_PLANTED}' UNION ALL SELECT -1, 1, 'assistant', '{_PLANTED}')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESC.format(x="role")}) + length({_ESC.format(x="text")}) + {len(START + SEP + END)}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
}
