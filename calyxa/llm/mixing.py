"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents fall into cells of (source, language, topic).  The tokens of the cells are
raked: in turn for each dimension, the weights of all cells with a value are scaled so
that their tokens meet the value's target share.  A document of weight w is taken floor(w) times,
and once more with probability w - floor(w), decided by a uniform number made from its id.  So the
expected tokens of the sample meet the target shares, each to within TOLERANCE of itself, and
are as many as those of all documents.  `reached` reports the shares of a sample.

Raking takes ROUNDS rounds, and further ones until the largest relative error of a value's
tokens is at most TOLERANCE (the registered SQL always takes ROUNDS).  Targets that contradict each other (as of a language that only
one source has) can't be met: when ROUNDS rounds lower the error by less than STALLED of
it, raking stops and a warning names the error.

Only sums per cell and per value are shuffled, by partial aggregation; every round is
written to the shared folder, so the plan of a round does not grow.

Edge cases: null source, language, topic count as the value ''; null or blank text has
no tokens (cells of a value without tokens keep weight 1); targets for values that do
not occur are shared out among those that do; a null doc_id is sampled like the id '';
repeated rows and rows of one id are sampled alike, as ids of equal numbers (ties) are; very
long texts count with all their tokens; an empty table gives an empty result; other columns
stay as they are, but those that begin with mix_ and are named below are replaced.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calyxa.llm.scratch import Scratch, free_name

DIMS = ("source", "lang", "topic")
#: Rounds before the errors are first looked at, and between looks.
ROUNDS = 10
TOLERANCE, STALLED = 1e-4, 1e-3
#: Cells of a partition while raking; their number grows with the sources.
CELLS = 100_000
#: Shares of the registered query: the tokens of a value to this power.
TEMPER = 0.7
SEED = "calyxa"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A coarse topic by form: tables, notices, and prose by length."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("License")) | F.contains(text, F.lit("All rights reserved")), "notice")
        .when(tokens < 100, "brief")
        .when(tokens >= 1000, "long")
        .otherwise("prose")
    )


def _sums(cells: DataFrame, tokens: str) -> DataFrame:
    """(dim, value, tokens) of every dimension."""
    value = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in DIMS])).alias("v")
    return cells.select(value, tokens).groupBy("v.dim", "v.value").agg(F.sum(tokens).alias("tokens"))


def tempered_targets(cells: DataFrame, temper: float = TEMPER) -> DataFrame:
    """(dim, value, share): shares in proportion to tokens ** temper, of each dimension's values."""
    return _sums(cells, "tokens").select("dim", "value", F.pow(F.col("tokens").cast("double"), F.lit(temper)).alias("share"))


def _error(at: DataFrame) -> float:
    """The largest relative difference of a value's tokens from its goal."""
    value = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value"), F.col(f"goal_{d}").alias("goal")) for d in DIMS]))
    sums = at.select(value.alias("v"), "now").groupBy("v.dim", "v.value").agg(F.sum("now").alias("is"), F.max("v.goal").alias("goal"))
    return sums.where("goal > 0").agg(F.max(F.abs(F.col("is") / F.col("goal") - 1))).first()[0] or 0.0


def rake(cells: DataFrame, targets: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """cells(source, lang, topic, tokens), targets(dim, value, share) -> cells with weight."""
    parts = 1 + cells.count() // CELLS
    goal = _sums(cells, "tokens").where("tokens > 0").join(targets, ["dim", "value"]).select("dim", "value", "share")
    whole = goal.groupBy("dim").agg(F.sum("share").alias("whole"))
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    goal = scratch.table(
        goal.join(whole, "dim").select("dim", "value", (F.col("share") / F.col("whole") * total).alias("goal")).coalesce(parts), "goal"
    )
    at = cells.withColumn("now", F.col("tokens").cast("double"))
    for d in DIMS:
        mine = goal.where(F.col("dim") == d).select(F.col("value").alias(d), F.col("goal").alias(f"goal_{d}"))
        at = at.join(mine, d, "left")
    at = scratch.table(at.coalesce(parts), "raked-0")
    k, last = 0, float("inf")
    while True:
        if k >= rounds and (k - rounds) % ROUNDS == 0:
            error = _error(at)
            if error <= TOLERANCE:
                break
            if error > (1 - STALLED) * last:
                logging.getLogger(__name__).warning("targets can't be met: largest relative error %.3g after %d rounds", error, k)
                break
            last = error
        k += 1
        for d in DIMS:
            sums = at.groupBy(d).agg(F.sum("now").alias("is"))
            scale = F.when(F.col("is") > 0, F.col(f"goal_{d}") / F.col("is"))
            at = at.join(sums, d).withColumn("now", F.col("now") * F.coalesce(scale, F.lit(1.0))).drop("is")
        at = scratch.table(at.coalesce(parts), f"raked-{k}")
        scratch.drop(f"raked-{k - 1}")
    weight = F.when(F.col("tokens") > 0, F.col("now") / F.col("tokens")).otherwise(1.0)
    return at.select(*DIMS, "tokens", weight.alias("weight"))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1, always the same for an id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def annotated(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """docs with mix_tokens and mix_topic; topic names a column, without it topics are told by form."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    made = topic_of(text, F.col("mix_tokens")) if topic is None else F.coalesce(F.col(topic).cast("string"), F.lit(""))
    return docs.withColumn("mix_tokens", n_tokens(text)).withColumn("mix_topic", made)


def weighed(rows: DataFrame, scratch: Scratch, targets: DataFrame | None = None) -> DataFrame:
    """rows(doc_id, source, lang, mix_tokens, mix_topic) with mix_weight, mix_probability (to be in the sample), mix_copies, mix_sampled.

    Without targets (dim, value, share) each dimension's shares are its tokens to the power TEMPER.
    """
    keys = {d: F.coalesce(F.col(d).cast("string"), F.lit("")) for d in DIMS[:2]} | {"topic": F.col("mix_topic")}
    cells = scratch.table(rows.groupBy(*[c.alias(d) for d, c in keys.items()]).agg(F.sum("mix_tokens").alias("tokens")), "cells")
    raked = rake(cells, tempered_targets(cells) if targets is None else targets, scratch)
    names = {d: free_name(rows, f"mix_key_{d}") for d in DIMS}
    weights = raked.select(*[F.col(d).alias(names[d]) for d in DIMS], F.col("weight").alias("mix_weight"))
    on = [c == F.col(names[d]) for d, c in keys.items()]
    weight, whole = F.col("mix_weight"), F.floor("mix_weight")
    copies = whole + F.when(uniform(F.col("doc_id")) < weight - whole, 1).otherwise(0)
    return (
        rows.drop("mix_weight")
        .join(weights, on, "left")
        .drop(*names.values())
        .withColumn("mix_probability", F.least(F.lit(1.0), weight))
        .withColumn("mix_copies", copies.cast("long"))
        .withColumn("mix_sampled", F.col("mix_copies") > 0)
    )


def mix(docs: DataFrame, scratch: Scratch, topic: str | None = None, targets: DataFrame | None = None) -> DataFrame:
    """docs with the columns that `annotated` and `weighed` add."""
    return weighed(annotated(docs, topic), scratch, targets)


def sampled(mixed: DataFrame) -> DataFrame:
    """The sample: every row of `mix` as often as its copies, with mix_copy, from 1, instead of mix_sampled."""
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))
    return mixed.where("mix_copies > 0").drop("mix_sampled").withColumn("mix_copy", copies)


def reached(mixed: DataFrame) -> DataFrame:
    """dim, value, target (expected share of tokens), share (of the sample's tokens)."""
    value = F.explode(
        F.array(
            *[
                F.struct(F.lit(d).alias("dim"), F.coalesce(F.col("mix_topic" if d == "topic" else d).cast("string"), F.lit("")).alias("value"))
                for d in DIMS
            ]
        )
    ).alias("v")
    tokens = F.col("mix_tokens")
    sums = mixed.select(value, (tokens * F.col("mix_weight")).alias("w"), (tokens * F.col("mix_copies")).alias("c"))
    sums = sums.groupBy("v.dim", "v.value").agg(F.sum("w").alias("w"), F.sum("c").alias("c"))
    whole = sums.groupBy("dim").agg(F.sum("w").alias("ws"), F.sum("c").alias("cs"))
    return sums.join(F.broadcast(whole), "dim").select("dim", "value", (F.col("w") / F.col("ws")).alias("target"), (F.col("c") / F.col("cs")).alias("share"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    scratch = Scratch(spark, "op3")
    rows = scratch.table(annotated(docs).drop("text"), "rows")
    return weighed(rows, scratch).select(
        "doc_id",
        F.col("mix_tokens").alias("n_tokens"),
        F.col("mix_topic").alias("topic"),
        F.round("mix_weight", 6).alias("weight"),
        F.round("mix_probability", 6).alias("probability"),
        F.col("mix_copies").alias("copies"),
        F.col("mix_sampled").alias("sampled"),
    )


QUERIES = {"op3_source_mixing": op3_source_mixing}


def _oracle() -> str:
    ctes = [
        r"""docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents)""",
        """topical AS MATERIALIZED (SELECT *, CASE WHEN contains(text, ' | ') THEN 'table'
  WHEN contains(text, 'License') OR contains(text, 'All rights reserved') THEN 'notice'
  WHEN n_tokens < 100 THEN 'brief' WHEN n_tokens >= 1000 THEN 'long' ELSE 'prose' END AS topic FROM docs)""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM topical GROUP BY source, lang, topic)",
        "total AS MATERIALIZED (SELECT sum(tokens) AS total FROM cells)",
    ]
    for d in DIMS:
        ctes.append(
            f"goal_{d} AS MATERIALIZED (SELECT {d}, s / sum(s) OVER () * (SELECT total FROM total) AS goal FROM "
            f"(SELECT {d}, pow(sum(tokens), {TEMPER}) AS s FROM cells GROUP BY {d} HAVING sum(tokens) > 0))"
        )
    ctes.append("at_0 AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens AS now FROM cells)")
    step = 0
    for _ in range(ROUNDS):
        for d in DIMS:
            ctes.append(
                f"at_{step + 1} AS MATERIALIZED (SELECT a.source, a.lang, a.topic, a.tokens, "
                f"a.now * coalesce(CASE WHEN s.x > 0 THEN g.goal / s.x END, 1) AS now FROM at_{step} a "
                f"JOIN (SELECT {d}, sum(now) AS x FROM at_{step} GROUP BY {d}) s ON a.{d} = s.{d} LEFT JOIN goal_{d} g ON a.{d} = g.{d})"
            )
            step += 1
    ctes.append(f"w AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN now / tokens ELSE 1 END AS weight FROM at_{step})")
    u = f"CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0"
    return "WITH " + ",\n".join(ctes) + f"""
SELECT d.doc_id, d.n_tokens, d.topic, round(w.weight, 6) AS weight, round(least(1.0, w.weight), 6) AS probability,
  CAST(floor(w.weight) AS BIGINT) + CASE WHEN {u} < w.weight - floor(w.weight) THEN 1 ELSE 0 END AS copies,
  CAST(floor(w.weight) AS BIGINT) + CASE WHEN {u} < w.weight - floor(w.weight) THEN 1 ELSE 0 END > 0 AS sampled
FROM topical d JOIN w ON d.source = w.source AND d.lang = w.lang AND d.topic = w.topic
"""


ORACLE_SQL = {"op3_source_mixing": _oracle()}
