"""Mixing sources to target weights (operator 11).

1. Capped water-filling: every source gets its weight's share of the budget; a
   source whose share passes ``max_epochs`` times its size is clamped there, and
   what it leaves is shared again by weight among the others, round by round,
   until no share passes its cap. A round is one aggregate over the sources.
2. A target is so many whole repetitions of the source and a rest. The rest is
   filled by documents in seeded order. Only the digit group of that order in
   which the rest ends is ever looked into: group sums by two more hex digits a
   round narrow it down, so documents before it are taken whole, those after it
   not at all, and at most ``BATCH`` documents of a source are ordered. The last
   document is taken in part, which brings a source to its target exactly.

No step gathers a source: a hot one is pre-aggregated in map tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from telemill.llm.common import numbered, salted_join
from telemill.session import cut

SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
BATCH = 4096  # documents of one source ordered in one task
DIGITS = 15  # hex digits of the seeded order; as many again tell repeated rows apart


def word_count(text: Column) -> Column:
    """Number of words, 0 for null; each word becomes one letter, so memory stays within the text's size."""
    marks = F.regexp_replace(text, f"{SPACE}*+{WORD}++{SPACE}*+", "w")
    return F.when(text.rlike(WORD), F.char_length(marks)).otherwise(0).cast("long")


def source_key(source: Column) -> Column:
    """A text that is never null, for joins: null has a key of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def cyclic_weights(docs: DataFrame, weights: list[float], source_col: str = "source") -> DataFrame:
    """``source, weight``: the weights dealt in turn to the sources in code point order, null last."""
    names = docs.select(F.col(source_col).cast("string").alias("source")).distinct()
    no = numbered(names, [F.col("source").asc_nulls_last()], "no")
    return no.select("source", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int")).alias("weight"))


def water_fill(sources: DataFrame, budget: int, max_epochs: int) -> DataFrame:
    """Add ``target`` to stored ``key, source_size, weight``; a budget above all caps together fills them all."""
    now = sources.select("key", "source_size", F.col("weight").cast("double").alias("weight"), (F.col("source_size") * max_epochs).alias("cap"), F.lit(False).alias("full"))
    while True:
        taken, share = now.agg(F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)), F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0))).first()
        left = float(budget - (taken or 0))
        free = F.lit(left) * F.col("weight") / F.lit(share) if share else F.lit(0.0)
        shared = now.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(free))
        over = ~F.col("full") & (F.col("target") > F.col("cap"))
        if not shared.where(over).limit(1).count():
            return shared.select("key", "source_size", "target")
        now = cut(shared.withColumn("full", F.col("full") | over).drop("target"))


def _ends(sized: DataFrame, rests: DataFrame) -> DataFrame:
    """Per source with a rest: the digit group in which it ends, and what that group gives: ``key, prefix, need``."""
    state = cut(rests.where("rest > 0").select("key", F.lit("").alias("prefix"), F.col("rest").alias("need")))
    for digits in range(2, 2 * DIGITS + 2, 2):
        inside = salted_join(sized.select("key", "place", "size"), state, "key", "place").where(F.startswith("place", "prefix"))
        sums = inside.groupBy("key", "need", F.substring("place", 1, digits).alias("prefix")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("c"))
        before = F.coalesce(F.sum("s").over(Window.partitionBy("key").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ends = sums.withColumn("b", before).where((F.col("b") < F.col("need")) & (F.col("b") + F.col("s") >= F.col("need")))
        state = cut(ends.select("key", "prefix", (F.col("need") - F.col("b")).alias("need"), "c"))
        if (state.agg(F.max("c")).first()[0] or 0) <= BATCH:
            break
    return state.select("key", "prefix", "need")


def plan_mix(
    docs: DataFrame, weights: DataFrame, max_epochs: int = 3, budget: int | None = None, seed: str = "0",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ("doc_id", "text"),
) -> DataFrame:
    """Per row of ``docs``: the columns ``carry``, ``size, source_size, target, whole, part``.

    ``whole`` copies and the first ``part`` words of one more are taken; never
    more than ``max_epochs`` times the size. ``weights`` is ``source, weight``
    (null is a source like others; the sum of repeated rows counts; a source
    without a row, or with a null, NaN or negative weight, gets 0 words), the budget
    all words unless given. Null and empty texts have size 0 and give nothing. A
    row's place in the seeded order comes from id and text, so reruns agree;
    rows equal in both follow one another and share as a group what falls on
    it. Carried columns named like a result are replaced by it, others stay.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    order = F.md5(F.concat_ws(":", F.lit(seed), named(id_col), F.coalesce(F.md5(F.col(text_col)), F.lit("-"))))
    results = ("size", "source_size", "target", "whole", "part")
    kept = [c for c in dict.fromkeys(carry) if c not in results]
    raw = docs.select(
        *[F.col(c).alias(f"in_{c}") for c in kept], source_key(F.col(source_col)).alias("key"), word_count(F.col(text_col)).alias("size"),
        F.concat(F.substring(order, 1, DIGITS), F.substring(F.md5(F.monotonically_increasing_id().cast("string")), 1, DIGITS)).alias("place"),
    )
    sized = cut(raw)
    given = weights.groupBy(source_key(F.col("source")).alias("key")).agg(F.sum("weight").alias("weight"))
    sizes = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    weight = F.coalesce(F.greatest(F.nanvl(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    sources = cut(sizes.join(given, "key", "left").select("key", "source_size", weight.alias("weight")))
    if budget is None:
        budget = sources.agg(F.sum("source_size")).first()[0] or 0
    words = F.round("target").cast("long")
    goal = water_fill(sources, budget, max_epochs).withColumn("whole", F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0))
    goal = cut(goal.withColumn("rest", words - F.col("whole") * F.col("source_size")))
    goal = cut(goal.join(_ends(sized, goal), "key", "left").drop("rest"))
    both = salted_join(sized, goal, "key", "place").withColumn("at", F.expr("substr(place, 1, length(prefix))"))
    ends = F.coalesce(F.col("at") == F.col("prefix"), F.lit(False))
    plain = both.where(~ends).withColumn("part", F.when(F.col("at") < F.col("prefix"), F.col("size")).otherwise(0))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = both.where(ends).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("need") - before)))
    done = plain.unionByName(last).withColumn("full", (F.col("part") == F.col("size")) & (F.col("size") > 0))
    whole, part = (F.col("whole") + F.col("full").cast("long")).alias("whole"), F.when(F.col("full"), 0).otherwise(F.col("part")).cast("long").alias("part")
    return done.select(*[F.col(f"in_{c}").alias(c) for c in kept], "size", "source_size", "target", whole, part)


@F.pandas_udf(StringType())
def first_words(texts: pd.Series, n: pd.Series) -> pd.Series:
    """The text up to the end of its n-th word."""
    import re

    word = re.compile(WORD + "+")

    def cut_one(text, k):
        end = 0
        for i, m in enumerate(word.finditer(text), 1):
            end = m.end()
            if i >= k:
                break
        return text[:end]

    return pd.Series([cut_one(t, k) for t, k in zip(texts, n, strict=True)])


def materialise(planned: DataFrame, text_col: str = "text") -> DataFrame:
    """The mixed corpus: one row per copy with ``copy`` from 0; the partial copy is the last one and ends at a word."""
    whole = planned.where("whole > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))))
    part = planned.where("part > 0").withColumn("copy", F.col("whole").cast("int")).withColumn(text_col, first_words(text_col, "part"))
    return whole.unionByName(part).drop("whole", "part")
