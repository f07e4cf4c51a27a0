"""Mixing sources to target weights by entropy balancing.

The rates closest (in relative entropy) to one copy of every document that
meet the token target of each source are ``exp(lambda_s * size)``, cut at
``MAX_RATE``.  The dual is convex and splits by source; its Newton iterations
run as one grouped aggregation over the (source, size) histogram.  Rates become
whole copies by one threshold per source on hashed uniforms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obol.llm.common import WORD, staged

WEIGHTS = (5.0, 2.0, 1.0)
MAX_RATE = 3
NEWTON_ROUNDS = 40
TOLERANCE = 1e-9
#: Each pass over the flip points narrows a source's threshold by this factor.
GRID = 4096
GRID_PASSES = 3
FILL_ROUNDS = 6


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text (null: 0)."""
    spaced = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    words = F.length(spaced) - F.length(F.translate(spaced, " ", "")) + 1
    return F.coalesce(F.when(spaced == "", 0).otherwise(words), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """source, source_size, source_docs, target of the sources of ``sizes`` (source, size, n rows of that size).

    Weights repeat in the sources' code point order, null last.  Together the
    targets are the total size; a target stops at ``max_rate`` times its
    source's size and the excess is shared again by weight until none is above.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_docs"))
    # one row a source: the numbering and the water level are over that table only
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = staged(per.withColumn("w", cycle).withColumn("cap", max_rate * F.col("source_size").cast("double")), "sources")
    level = 0.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("w")
        s = per.agg(F.sum("source_size").alias("total"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("used"),
                    F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("open")).first()
        if not s.total or not s.open:
            break
        new = (s.total - s.used) / s.open
        if new <= level * (1 + 1e-12):
            break
        level = new
    return per.select("source", "source_size", "source_docs",
                      F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target"))


def tilts(histogram: DataFrame, targets: DataFrame, max_rate: int = MAX_RATE) -> DataFrame:
    """source, scale, lam: the dual solution per source, rate = least(max_rate, exp(lam * size / scale)).

    Newton's method on the dual's derivative (tokens drawn less target), each
    step held in the bracket found so far.  A source whose target is all
    ``max_rate`` copies gets an infinite tilt.
    """
    base = targets.where("source_size > 0").select(
        F.col("source").alias("s2"), "target", (F.col("source_size") / F.col("source_docs")).alias("scale"),
        F.lit(max_rate).cast("double").alias("cap"), "source_size")
    state = staged(base.withColumn("lam", F.lit(0.0)).withColumn("lo", F.lit(-1e6)).withColumn("hi", F.lit(1e6))
                   .withColumn("gap", F.lit(1.0)), "tilts")
    for _ in range(NEWTON_ROUNDS):
        x = F.col("size") / F.col("scale")
        rate = F.least(F.col("cap"), F.exp(F.least(F.col("lam") * x, F.lit(50.0))))
        moved = histogram.where("size > 0").join(state, F.col("source").eqNullSafe(F.col("s2"))) \
            .groupBy("s2", "target", "scale", "cap", "source_size", "lam", "lo", "hi").agg(
                F.sum(F.col("n") * F.col("size") * rate).alias("got"),
                F.sum(F.when(rate < F.col("cap"), F.col("n") * F.col("size") * rate * x).otherwise(0.0)).alias("slope"))
        over = F.col("got") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - (F.col("got") - F.col("target")) / F.greatest(F.col("slope"), F.lit(1e-300))
        open_hi, open_lo = F.col("hi2") >= 1e6, F.col("lo2") <= -1e6
        mid = F.when(open_hi, F.greatest(2 * F.col("lam"), F.lit(1.0))) \
            .when(open_lo, F.least(2 * F.col("lam"), F.lit(-1.0))).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        state = staged(
            moved.withColumn("lo2", lo).withColumn("hi2", hi).withColumn("step", step)
            .withColumn("gap", F.abs(F.col("got") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0)))
            .select("s2", "target", "scale", "cap", "source_size",
                    F.when(F.col("gap") <= TOLERANCE, F.col("lam"))
                    .when((F.col("step") > F.col("lo2")) & (F.col("step") < F.col("hi2")) & (F.abs("step") < 1e5), F.col("step"))
                    .otherwise(mid).alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "gap"), "tilts")
        unmet = (F.col("gap") > TOLERANCE) & (F.col("target") < F.col("cap") * F.col("source_size") * (1 - 1e-9))
        if state.where(unmet).isEmpty():
            break
    all_in = F.col("target") >= F.col("cap") * F.col("source_size") * (1 - 1e-9)
    return state.select(F.col("s2").alias("source"), "scale", F.when(all_in, F.lit(float("inf"))).otherwise(F.col("lam")).alias("lam"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken for every row of ``docs`` (``doc_id``, ``text``, ``source``).

    Copies: with a hashed uniform u per document, floor(rate + u + theta) in
    0..max_rate, theta chosen per source so that its words come nearest below
    the target; the rest is filled by single further copies of the largest
    documents that still fit.  The draw depends on id and text, so reruns
    agree.  Null text has size 0 and takes nothing; a null source is a source
    (last); repeated rows may share a draw and then flip together; an empty
    table gives none; other columns are not read.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"), F.lit(6))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text").cast("string")).alias("size"), key.alias("h")) \
        .withColumn("u", F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)))
    rows = staged(rows, "sizes")
    histogram = staged(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    targets = staged(source_targets(histogram, weights, max_rate), "targets")
    lam = tilts(histogram, targets, max_rate)
    per = staged(targets.join(lam.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left")
                 .select(F.col("source").alias("src"), "source_size", "target", "scale", "lam"), "tilted")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("lam") == float("inf"), float(max_rate)).otherwise(
        F.least(F.lit(float(max_rate)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0)))))
    rated = staged(rows.join(per, F.col("source").eqNullSafe(F.col("src")))
                   .select("doc_id", "source", "h", "u", "size", "source_size", "target", rate.alias("rate")), "rates")

    # flip points of theta: the j-th copy is taken when theta >= j - rate - u
    flips = rated.where("size > 0").select("source", "size", F.explode(F.sequence(F.lit(1), F.lit(max_rate))).alias("j"), "rate", "u") \
        .select("source", "size", (F.col("j") - F.col("rate") - F.col("u")).alias("at"))
    low, width = -float(max_rate + 1), 2.0 * (max_rate + 1)
    bound = staged(per.select("src", "target", F.lit(low).alias("theta"), F.lit(0.0).alias("below")), "theta")
    for _ in range(GRID_PASSES):
        step = width / GRID
        cell = F.floor((F.col("at") - F.col("theta")) / F.lit(step))
        cells = flips.join(bound, F.col("source").eqNullSafe(F.col("src"))) \
            .where((F.col("at") >= F.col("theta")) & (F.col("at") < F.col("theta") + F.lit(width))) \
            .groupBy("src", "target", "theta", "below", cell.alias("cell")).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("src").orderBy("cell"))
        first = cells.withColumn("run", F.col("below") + run).where("run > target") \
            .groupBy("src").agg(F.min(F.struct("cell", "run", "words")).alias("f"))
        total = cells.groupBy("src").agg(F.sum("words").alias("all"))
        bound = staged(
            bound.join(first.withColumnRenamed("src", "k1"), F.col("src").eqNullSafe(F.col("k1")), "left")
            .join(total.withColumnRenamed("src", "k2"), F.col("src").eqNullSafe(F.col("k2")), "left")
            .select("src", "target",
                    F.when(F.col("f").isNull(), F.col("theta") + F.lit(width)).otherwise(F.col("theta") + F.col("f.cell") * F.lit(step)).alias("theta"),
                    F.when(F.col("f").isNull(), F.col("below") + F.coalesce("all", F.lit(0)))
                    .otherwise(F.col("f.run") - F.col("f.words")).alias("below")), "theta")
        width = step
    theta = bound.select("src", "theta")
    copies = F.greatest(F.lit(0), F.least(F.lit(max_rate), F.ceil(F.col("rate") + F.col("u") + F.col("theta")) - 1)).cast("int")
    taken = staged(rated.join(theta, F.col("source").eqNullSafe(F.col("src")), "left")
                   .withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(copies)).drop("src", "theta"), "copies")
    extra = _fill(taken, max_rate)
    out = taken.join(extra, (taken.h == extra.xh) & taken.source.eqNullSafe(extra.xs) & (taken.size == extra.xz), "left") \
        .withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0)))
    return out.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def _fill(taken: DataFrame, max_rate: int) -> DataFrame:
    """xs, xh, xz, more: for each source, one document a round gets one more copy, the largest that fits the rest.

    Only documents whose (source, hash, size) is their own take part, so that a
    copy added is a copy counted.
    """
    rest = staged(taken.groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("got"))
                  .select(F.col("source").alias("xs"), (F.col("target") - F.col("got")).alias("rest")), "rest")
    single = taken.where((F.col("size") > 0) & (F.col("copies") < max_rate)).groupBy("source", "h", "size") \
        .agg(F.count(F.lit(1)).alias("c")).where("c = 1")
    used = None
    for _ in range(FILL_ROUNDS):
        pick = single.join(rest, F.col("source").eqNullSafe(F.col("xs"))).where("size <= rest")
        if used is not None:
            u = used.select(F.col("xs").alias("us"), F.col("xh").alias("uh"), F.col("xz").alias("uz"))
            pick = pick.join(u, F.col("source").eqNullSafe(F.col("us")) & (F.col("h") == F.col("uh")) & (F.col("size") == F.col("uz")), "left_anti")
        pick = staged(pick.groupBy("xs").agg(F.max(F.struct("size", "h")).alias("m"))
                      .select("xs", F.col("m.h").alias("xh"), F.col("m.size").alias("xz")), "fill")
        if pick.isEmpty():
            break
        used = staged(pick if used is None else used.union(pick), "filled")
        got = pick.select(F.col("xs").alias("ps"), F.col("xz").alias("pz"))
        rest = staged(rest.join(got, F.col("xs").eqNullSafe(F.col("ps")), "left")
                      .select("xs", (F.col("rest") - F.coalesce("pz", F.lit(0))).alias("rest")), "rest")
    if used is None:
        return taken.sparkSession.createDataFrame([], "xs string, xh long, xz long, more int")
    return used.withColumn("more", F.lit(1))
