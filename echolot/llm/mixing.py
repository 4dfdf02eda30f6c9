"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document draws the exponential key -ln(u) / weight, with u from a hash of its id, text and the seed, and weight
its quality; smaller keys first is weighted sampling without replacement. A source's budget is spent in complete
epochs first, then on documents in the order of their keys while their prefix sum fits. Prefix sums don't bring a
source into one task: the keys' binary logarithm is cut into cells so narrow that none holds more than about a
quarter of bucket_rows documents, whatever the weights, for a mixture of exponentials is nowhere dense on that scale;
the cells are counted, neighbours make buckets of about bucket_rows documents, the buckets' sums are summed up in
order, and the running sum within a bucket finishes it. In the bucket where the budget runs out, later documents that
still fit are taken in up to three more passes over the same window, so a long document at the border costs little;
then one more document is taken if that comes nearer to the budget.

What meets in one task are the sources' totals, one row for each source, and a source's cells, some 15 for bucket_rows
documents. A null source is a source of its own, last. A null or empty text has size 0; it is in every complete epoch
and takes nothing. Very long texts are only counted. Equal keys are ordered by doc_id; rows with the same id and text
draw the same key. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, WS_RUN, materialize
from .quality_rules import SYMBOLS


def size_of(text: Column) -> Column:
    b = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(F.length(b) == 0, 0).otherwise(F.size(F.split(b, WS_RUN))).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 1/11 and 1: a text half of whose characters are symbols weighs a sixth of a clean one."""
    t = F.coalesce(text, F.lit(""))
    share = (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))) / F.greatest(F.length(t), F.lit(1))
    return 1 / (1 + 10 * share)


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds target to totals (source, source_size): weights repeat by code point order of source, nulls last.

    The targets sum to share times all sizes. No target exceeds most times its source; the excess goes to the others
    by weight. With capped sources sorted by cap / weight, the common level lies behind the longest prefix that is
    still above it, so two running sums replace the rounds of resharing.
    """
    if most < share:
        raise ValueError("the sources can't hold the mix")
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    t = totals.withColumn("w", weight).withColumn("cap", most * F.col("source_size")).withColumn("all", share * F.sum("source_size").over(everything))
    upto = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))).withColumn("left", F.col("all") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
    t = t.withColumn("level", F.greatest(F.col("left") / F.col("w_left"), F.lit(0.0)))
    # the first row whose cap holds the level there sets it for all behind
    held = F.when(F.col("w") * F.col("level") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))
    t = t.withColumn("level", F.min(held).over(everything)["level"])
    return t.withColumn("target", F.coalesce(F.least("cap", F.col("w") * F.col("level")), F.col("cap"))).select("source", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 1, bucket_rows: int = 2_000, carry: list[Column] | None = None, left: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs, and carry as a struct.

    left: gets the paths of the written stages that the result reads.
    """
    drawn = F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))), 1, 13), 16, 10).cast("double")
    key = -F.ln((drawn + 1) / float(2**52 + 2)) / quality_weight(F.col("text"))
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), key.alias("key"),
        F.struct(F.lit(0).alias("_"), *(carry or [])).alias("carry"))
    rows = materialize(d.withColumn("uid", F.monotonically_increasing_id()), "mix", left)
    d = rows.drop("carry")  # slim rows are sorted and summed; what they carry meets them at the end
    totals = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = materialize(targets(totals.select("source", "source_size"), weights, share, most).join(
        totals.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"), "mix-plan", left)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("buckets", F.ceil(F.col("n") / bucket_rows))
    d = d.join(plan.withColumnRenamed("source", "s2").drop("n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    # keys are above 0: the draw is below 1
    d = d.withColumn("cell", F.floor(F.log2("key") * F.col("buckets")))
    cells = d.groupBy("source", "cell").agg(F.sum("size").alias("b"), F.count("*").alias("c"))
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumns({"sum": F.sum("b").over(upto) - F.col("b"), "bucket": F.floor((F.sum("c").over(upto) - F.col("c")) / bucket_rows)})
    cells = cells.withColumn("before", F.min("sum").over(Window.partitionBy("source", "bucket")))
    cells = materialize(cells.select(F.col("source").alias("s2"), F.col("cell").alias("c2"), "bucket", "before"), "mix-cells", left)
    d = d.join(cells, F.col("source").eqNullSafe(F.col("s2")) & (F.col("cell") == F.col("c2"))).drop("s2", "c2")
    own = Window.partitionBy("source", "bucket")
    order = own.orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("sum", F.col("before") + F.sum("size").over(order))
    d = d.withColumn("in", F.col("sum") <= F.col("rest"))
    d = d.withColumn("room", F.col("rest") - F.coalesce(F.max(F.when(F.col("in"), F.col("sum"))).over(own), F.col("before")))
    for _ in range(3):
        fits = ~F.col("in") & (F.col("size") <= F.col("room"))
        d = d.withColumn("sum", F.when(fits, F.sum(F.when(fits, F.col("size"))).over(order)))
        more = F.coalesce(F.col("sum") <= F.col("room"), F.lit(False))
        d = d.withColumn("in", F.col("in") | more).withColumn("room", F.col("room") - F.coalesce(F.max(F.when(more, F.col("sum"))).over(own), F.lit(0)))
    # last, one more document if that comes nearer: the one that leaves or exceeds least
    gap = F.when(~F.col("in") & (F.col("size") < 2 * F.col("room")), F.abs(F.col("size") - F.col("room")))
    last = F.row_number().over(own.orderBy(gap.asc_nulls_last(), "key", "doc_id"))
    d = d.withColumn("in", F.col("in") | ((last == 1) & gap.isNotNull()))
    copies = F.col("epochs") + F.col("in").cast("long")
    d = d.select("uid", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    return d.join(rows.select("uid", "carry"), "uid").drop("uid") if carry else d.drop("uid")


def mixed(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def repeat_mixed(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them: a document in two epochs is there twice, one that isn't taken is gone."""
    m = mix(docs, carry=[F.struct("*").alias("row")], **how)
    return m.where("copies > 0").select(F.col("carry.row").alias("row"), F.explode(F.expr("sequence(1, cast(copies as int))"))).select("row.*")
