"""Mixing sources to target weights by entropy balancing; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WORDS = r"[^\x20\x09-\x0D]+"
#: Features are rounded to 1 / BINS, rates to 1 / GRAIN: the same whatever order sums were added in.
BINS, GRAIN = 32, 1 << 20
#: Rows equal in all that counts are told apart in stretches of this many.
RUN = 4096


def word_count(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def ordinal(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """sources with _at: their place by code point of source, null last. Sorted by Spark; what is added up in one task is
    a count for each partition of that sort."""
    placed = scratch.save(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_p")).count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_from"))
    return placed.withColumn("_p", part).join(starts, "_p").withColumn("_at", F.col("_from") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_p", "_id", "_from")


def targets(sources: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) with column target added.

    Weights go round the sources by code point, null last. Together they get `share` of all sizes; a target stops at
    `most` times its source's size, and what is over goes to the others by weight until none is above. Each round of
    that is one sum over the sources; the driver holds four numbers.
    """
    s = ordinal(sources, scratch).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_at") % len(weights) + 1).cast("int")))
    s = scratch.save(s.withColumn("_cap", F.col("source_size") * F.lit(most)).drop("_at"))
    size, weight = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
    total, level, known = size * share, size * share / weight if weight else 0.0, -1
    while True:
        full = F.col("_cap") / F.col("_w") < F.lit(level * (1 - 1e-12))
        n, cap, gone = s.where(full).agg(F.count("*"), F.coalesce(F.sum("_cap"), F.lit(0.0)), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
        if n == known or gone == weight:
            break
        known, level = n, (total - cap) / (weight - gone)
    target = F.col("_cap") if gone == weight else F.least("_cap", F.col("_w") * F.lit(level))
    return s.withColumn("target", target).drop("_w", "_cap")


def balance(sources: DataFrame, bins: DataFrame, scratch: Scratch, most: float, steps: int = 100) -> DataFrame:
    """sources(source, source_size, target) with lam: sum(tokens * min(most, exp(lam * x))) = target over its bins
    (source, x, tokens); null where no rate but 0 or `most` will do.

    Newton on the convex dual, all sources at once: a step is one Spark aggregation for each source's gradient and
    curvature. Rates at the bound are part of the sum, so that what they lack goes to the others. A step is cut to 2;
    one that leaves the bracket of the root, and each fourth, halves the bracket instead. The state is a table a step.
    """
    top = F.lit(math.log(most))
    live = (F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-12))
    mean = bins.groupBy("source").agg((F.sum(F.col("tokens") * F.col("x")) / F.sum("tokens")).alias("_mean"), F.min("x").alias("_low"))
    ends = mean.withColumnRenamed("source", "_s")
    state = sources.where(live).join(ends, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    state = state.withColumn("hi", top / F.col("_low")).withColumn("lam", F.least("hi", F.log(F.col("target") / F.col("source_size")) / F.col("_mean")))
    state = state.select("source", "target", "lam", F.lit(None).cast("double").alias("lo"), "hi", F.lit(False).alias("done"))
    state = scratch.save(state)
    b = bins.withColumnRenamed("source", "_s")
    for i in range(1, steps + 1):
        if state.where("not done").isEmpty():
            break
        rate = F.exp(F.col("lam") * F.col("x"))
        moments = b.join(state.where("not done"), F.col("source").eqNullSafe(F.col("_s"))).groupBy("source", "target", "lam", "lo", "hi").agg(
            F.sum(F.col("tokens") * F.least(F.lit(float(most)), rate)).alias("g"),
            F.sum(F.when(rate <= most, F.col("tokens") * F.col("x") * rate).otherwise(0.0)).alias("h"),
        )
        over = F.col("g") > F.col("target")
        m = moments.withColumn("lo", F.when(over, F.col("lo")).otherwise(F.col("lam"))).withColumn("hi", F.when(over, F.col("lam")).otherwise(F.col("hi")))
        newton = F.when(F.col("h") > 0, F.col("lam") - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (F.col("g") - F.col("target")) / F.col("h"))))
        inside = (newton < F.col("hi")) & (F.col("lo").isNull() | (newton > F.col("lo"))) & F.lit(i % 4 != 0)
        there = (F.abs(F.col("g") - F.col("target")) <= 1e-13 * F.col("target")) | (F.col("hi") - F.col("lo") <= 1e-15)
        to = F.when(there, F.col("lam")).when(inside, newton).otherwise(F.coalesce((F.col("lo") + F.col("hi")) / 2, F.col("lam") - 2))
        new = m.select("source", "target", to.alias("lam"), "lo", "hi", F.coalesce(there, F.lit(False)).alias("done"))
        old, state = state, scratch.save(new.unionByName(state.where("done")))
        scratch.drop(old)
    solved = state.select(F.col("source").alias("_s"), "lam")
    return sources.join(solved, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def mix(docs: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, tilt_by: Column | None = None, group: int = 256) -> DataFrame:
    """How often each document is taken: docs(doc_id, source, text) to doc_id, source, size, source_size, target, taken, copies, rate.

    A document's rate is min(most, exp(lambda_source * x)), x being tilt_by (positive), or log2(1 + words) unless
    given, rounded to 1/32. Of all rates up to `most` that meet each source's words, these have the least entropy relative
    to one copy a document, a document counting size / x times. Words are summed per source and x before any shuffle
    (the default has at most 2048 x), and Newton runs on those sums (see balance()).

    Rates become whole copies in groups of about `group` documents of a source, by a hash of doc_id and text: from the
    longest down, each gets the floor or ceiling of its rate, whichever brings the words taken nearest to the sum of
    rates so far, so a group is off by less than a short document. Rows equal in doc_id, source and text are one entry
    of a group with a number, however many there are.

    Null text or no words: size 0, taken 0. A null source is a source. Null and repeated doc_ids are separate rows. An
    empty table gives an empty result. Reruns agree: nothing is random.
    """
    size = word_count(F.col("text"))
    x = F.round((tilt_by if tilt_by is not None else F.log2(size + F.lit(1))) * BINS) / BINS
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    rows = docs.select("doc_id", "source", size.alias("size"), x.cast("double").alias("x"), key.alias("key"))
    rows = scratch.save(rows.groupBy("source", "key", "doc_id", "size", "x").agg(F.count("*").alias("c")))
    bins = scratch.save(rows.groupBy("source", "x").agg(F.sum(F.col("size") * F.col("c")).alias("tokens"), F.count("*").alias("n")))
    sources = scratch.save(bins.groupBy("source").agg(F.sum("tokens").alias("source_size"), F.sum("n").alias("n_docs")))
    sources = targets(sources, scratch, weights, share, most)
    sources = scratch.save(balance(sources, bins.where("tokens > 0"), scratch, most))
    d = rows.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    rate = F.when(F.col("lam").isNotNull(), F.least(F.lit(float(most)), F.round(F.exp(F.col("lam") * F.col("x")) * GRAIN) / GRAIN)).when(F.col("target") > 0, F.lit(float(most))).otherwise(0.0)
    spread = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    d = d.withColumn("rate", rate).withColumn("_g", F.pmod(spread, F.ceil(F.col("n_docs") / F.lit(group))))
    g = d.groupBy("source", "_g", "source_size", "target").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("neg"), "key", "doc_id", "rate", "c"))).alias("rows"))
    zero = F.struct(F.lit(0.0).alias("due"), F.lit(0.0).alias("got"), F.expr("cast(array() as array<bigint>)").alias("k"))

    def take(a: Column, r: Column) -> Column:
        words, due = -r["neg"], a["due"] - r["neg"] * r["rate"] * r["c"]
        near = F.floor(F.try_divide(due - a["got"], words) + 0.5)
        k = F.when(words == 0, F.lit(0)).otherwise(F.greatest(F.floor(r["rate"]) * r["c"], F.least(F.ceil(r["rate"]) * r["c"], near))).cast("long")
        return F.struct(due.alias("due"), (a["got"] + k * words).alias("got"), F.concat(a["k"], F.array(k)).alias("k"))

    g = g.withColumn("k", F.aggregate("rows", zero, take)["k"])
    out = g.select("source", "source_size", "target", F.explode(F.arrays_zip("rows", "k")).alias("r"))
    out = scratch.save(out.select("r.rows.doc_id", "source", (-F.col("r.rows.neg")).alias("size"), "source_size", "target", "r.rows.rate", "r.rows.c", "r.k"))
    many = out.where(F.col("c") > RUN).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / RUN)))).repartition("doc_id", "_run")
    many = many.withColumn("_j", F.explode(F.sequence(F.col("_run") * RUN, F.least(F.col("_run") * RUN + (RUN - 1), F.col("c") - 1)))).drop("_run")
    few = out.where(F.col("c") <= RUN).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
    copies = (F.floor(F.col("k") / F.col("c")) + F.when(F.col("_j") < F.col("k") % F.col("c"), 1).otherwise(0)).cast("int")
    out = few.unionByName(many).withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")
