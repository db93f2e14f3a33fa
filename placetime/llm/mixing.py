"""Mixing sources to target weights by entropy balancing, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placetime.llm.ordered import places
from placetime.llm.tables import Tables

#: No document is taken more often than this.
MOST_COPIES = 3
#: Newton's method ends when every source's expected tokens are within this share of its target.
CLOSE = 1e-9
MAX_ROUNDS = 60
#: Rounding looks for its threshold in so many steps at a time, so many times.
STEPS = 64
LEVELS = 4


def word_count(text: Column) -> Column:
    """Words of non-blank characters in a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, tables: Tables, weights: tuple[float, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources in the order of their code points, null last, take the weights in turn and share the
    total by them; no target exceeds `most` times its source's size, and what is cut off is shared
    among the others by weight until none exceeds it. Places in the order come from ranges of sources, and each
    round of sharing from two sums over all of them, so no task sees every source.
    """
    rows = places(tables.settle(sizes.withColumn("all", F.lit(0))), "all", [F.col("source").asc_nulls_last()], tables)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("index", F.lit(len(weights))).cast("int") + 1)
    rows = rows.select("source", "source_size", weight.alias("weight"), (F.col("source_size").cast("double") * most).alias("bound"))
    rows = tables.settle(rows)
    above, level = 0, float("-inf")
    while True:
        over = F.col("weight") * F.lit(level) > F.col("bound")
        sums = rows.agg(
            F.sum("source_size"), F.sum(F.when(over, F.col("bound")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)
        ).first()
        if level > float("-inf") and (sums[3] == above or not sums[2]):
            break
        above, level = sums[3], ((sums[0] or 0) - (sums[1] or 0.0)) / (sums[2] or 1.0)
    return rows.select("source", "source_size", F.least("bound", F.col("weight") * F.lit(level)).alias("target"))


def _rate(tilt: Column, size: Column, scale: Column, most: int = MOST_COPIES) -> Column:
    """The exponentially tilted rate of a document: 1 without tilt, always between 0 and `most`.

    It minimises the entropy against a rate of 1 under the bounds and its source's token
    constraint; `tilt` is the constraint's dual variable, per `scale` tokens.
    """
    grown = F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), tilt * size / scale)))
    return most * grown / (most - 1 + grown)


def balance(sizes: DataFrame, goals: DataFrame, tables: Tables) -> DataFrame:
    """(source, tilt, scale): the dual solution, by Newton iterations over all documents.

    A document's rate depends on its source and size alone, so documents are counted by
    these first, map side before the shuffle; each iteration sums gradient and Hessian of the dual per source over
    the counts. Sources whose target is their bound or nothing have no finite tilt; they get
    60 or -60. Steps are kept within a bracket that shrinks, so the iteration can't run away.
    """
    counts = tables.settle(sizes.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    scale = counts.groupBy(F.col("source").alias("s")).agg((F.sum(F.col("size") * F.col("size") * F.col("n")) / F.sum(F.col("size") * F.col("n"))).alias("scale"))
    at_most = F.col("target") >= MOST_COPIES * F.col("source_size") * (1 - 1e-12)
    state = goals.join(scale, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "target", "scale",
        F.when(at_most, 60.0).otherwise(0.0).alias("tilt"), F.lit(-4000.0).alias("low"), F.lit(4000.0).alias("high"),
        at_most.alias("done"),
    )
    state = tables.settle(state)
    for _ in range(MAX_ROUNDS):
        joined = counts.join(state, counts["source"].eqNullSafe(state["source"])).drop(counts["source"])
        rate = _rate(F.col("tilt"), F.col("size"), F.col("scale"))
        slope = rate * (MOST_COPIES - rate) / MOST_COPIES * F.col("size") / F.col("scale")
        sums = joined.groupBy("source", "target", "scale", "tilt", "low", "high", "done").agg(
            F.sum(rate * F.col("size") * F.col("n")).alias("tokens"), F.sum(slope * F.col("size") * F.col("n")).alias("slope")
        )
        low = F.when(F.col("tokens") < F.col("target"), F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("tokens") > F.col("target"), F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") + (F.col("target") - F.col("tokens")) / F.greatest(F.col("slope"), F.lit(1e-300))
        close = F.abs(F.col("tokens") - F.col("target")) <= CLOSE * F.col("target")
        inside = sums.withColumn("low", low).withColumn("high", high).withColumn("step", step)
        moved = F.when((F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
        done = F.col("done") | close
        after = tables.settle(
            inside.select("source", "target", "scale", F.when(done, F.col("tilt")).otherwise(moved).alias("tilt"), "low", "high", done.alias("done"))
        )
        tables.drop(state)
        state = after
        if state.filter(~F.col("done")).isEmpty():
            break
    tables.drop(counts)
    return state.select("source", "tilt", "scale")


def _rounded(rated: DataFrame, tables: Tables) -> DataFrame:
    """Adds `copies`, whole numbers next to the rates whose tokens meet each source's target as nearly as
    the documents at the edge allow.

    A document takes one copy more than its rate's whole part if a number drawn from a hash of it
    lies below the fraction, shifted by an amount per source. Where the source's tokens meet its
    target is found by sums over steps of that amount, finer each time; no order over a source is needed.
    """
    drawn = F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(1 << 52)) / float(1 << 52)
    whole = F.least(F.floor("rate"), F.lit(MOST_COPIES - 1)).cast("long")
    rows = rated.withColumn("whole", whole).withColumn("edge", drawn - (F.col("rate") - F.col("whole")))
    # `edge` is in [-1, 1): the extra copy is taken where it lies below the source's shift.
    rows = tables.settle(rows)
    fixed = rows.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("taken"), F.first("target").alias("target"))
    state = fixed.select(F.col("source").alias("s"), "target", "taken", F.lit(-1.0).alias("low"), F.lit(2.0).alias("width"))
    state = tables.settle(state)
    for _ in range(LEVELS):
        inside = rows.join(state.select("s", "low", "width"), F.col("source").eqNullSafe(F.col("s")))
        step = F.floor((F.col("edge") - F.col("low")) / F.col("width") * STEPS)
        summed = inside.filter((F.col("edge") >= F.col("low")) & (F.col("edge") < F.col("low") + F.col("width"))).groupBy("s", step.alias("step")).agg(F.sum("size").alias("tokens"))
        upto = Window.partitionBy("s").orderBy("step")
        rising = summed.withColumn("sum", F.sum("tokens").over(upto)).select(F.col("s").alias("of"), "step", "sum")
        joined = state.join(rising, F.col("s").eqNullSafe(F.col("of")), "left")
        # Steps that are taken whole stay below the target; the next level looks into the one after them.
        fits = F.col("taken") + F.col("sum") <= F.col("target")
        best = joined.groupBy("s", "target", "taken", "low", "width").agg(
            F.max(F.when(fits, F.col("sum"))).alias("sum"), F.min(F.when(~fits, F.col("step"))).alias("step")
        )
        after = best.select(
            "s", "target", (F.col("taken") + F.coalesce("sum", F.lit(0))).alias("taken"),
            F.when(F.col("step").isNull(), F.col("low") + F.col("width")).otherwise(F.col("low") + F.col("width") * F.col("step") / STEPS).alias("low"),
            F.when(F.col("step").isNull(), 0.0).otherwise(F.col("width") / STEPS).alias("width"),
        )
        after = tables.settle(after)
        tables.drop(state)
        state = after
    # Of the last step, all or none, whichever comes nearer.
    inside = rows.join(state.drop("target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    last = (F.col("edge") >= F.col("low")) & (F.col("edge") < F.col("low") + F.col("width"))
    rest = inside.groupBy(F.col("source").alias("s")).agg(F.sum(F.when(last, F.col("size")).otherwise(0)).alias("rest"), F.first("taken").alias("base"))
    rest = tables.settle(rest)
    joined = inside.join(rest, F.col("source").eqNullSafe(F.col("s")))
    also = last & (F.abs(F.col("base") + F.col("rest") - F.col("target")) < F.abs(F.col("base") - F.col("target")))
    extra = (F.col("edge") < F.col("low")) | also
    return joined.withColumn("copies", F.col("whole") + extra.cast("long"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per row: doc_id, row_hash, source, size, source_size, target (its source's), rate and copies.

    A document's size is the number of words in its whole text (null: 0), `target` the tokens its
    source shall give (see `targets`). Rates are the entropy-balanced weights: of all rates between 0
    and 3 that meet every source's target, those nearest 1 in relative entropy; they tilt exponentially
    with the document's size. Rounding them to whole copies keeps each source's tokens at its
    target but for the last document or two, and a document is taken 3 times at most.

    The result depends on the rows alone, not on their order or partitioning. Rows alike in
    all of id, source and text get the same number of copies. A null source is a source of its own, the
    last; documents without words have rate 1 and are taken once. Columns besides the
    three named don't matter. Texts of any length are counted whole. An empty table gives no rows. Tables with a row
    per source are written, so Spark knows their bytes and broadcasts them while they are few.
    """
    tables = Tables(docs.sparkSession, "mixing")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_hash"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
    )
    rows = tables.settle(rows)
    goals = tables.settle(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), tables, weights))
    tilts = balance(rows, goals, tables)
    per_source = goals.join(tilts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    per_source = tables.settle(per_source.withColumnRenamed("source", "s"))
    joined = rows.join(per_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    at_most = F.col("target") >= MOST_COPIES * F.col("source_size") * (1 - 1e-12)
    rate = (
        F.when(F.col("size") == 0, 1.0)
        .when(at_most, float(MOST_COPIES))
        .otherwise(_rate(F.coalesce("tilt", F.lit(0.0)), F.col("size"), F.coalesce("scale", F.lit(1.0))))
    )
    rated = joined.withColumn("rate", rate).drop("tilt", "scale")
    empty = rated.filter("size = 0").withColumn("copies", F.lit(1).cast("long"))
    rounded = _rounded(rated.filter("size > 0"), tables)
    out = "doc_id row_hash source size source_size target rate copies".split()
    return rounded.select(*out).unionAll(empty.select(*out))
