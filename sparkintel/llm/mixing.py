"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source has a target in words. Among all document rates w with 0 <= w <= cap and
sum(w * size) = target in each source, entropy balancing takes those nearest to 1 in relative
entropy, sum(w log w - w + 1). Its convex dual has one multiplier a source, and its solution is an
exponential tilt, w = min(cap, exp(multiplier * size / mean size)). Newton steps solve the dual for
all sources at once, kept inside a bracket that shrinks; a step is one aggregation over the counts
of documents by source and size, which are exact sufficient statistics.

Rates become copies by systematic rounding along the sizes of a source, so that the copies up to any
size differ from their expected number by less than one; what then lacks or exceeds in words is put
right by documents of the sizes nearest below it, and then by single ones of the size nearest to it. Inside a class of one source and size, copies go
by hash order, ranked in buckets of about the root of the class, so that no large class is one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkintel.llm.rows import deal_out, keyed
from sparkintel.llm.staging import Staged

WORDS = r"[^\x20\x09-\x0D]++"
CAP = 3
STEPS = 60
PRECISE = 1e-7
REPAIRS = 4


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def source_targets(sizes: DataFrame, weights: Column | None = None, cap: int = CAP) -> DataFrame:
    """One row per source with its size and target: source, source_size, target.

    Sources by code point, null last, weigh 1, 2, 3, repeating (or the given expression over their
    position `place` from 1). A target stops at cap times the source's size; the excess is shared out
    again by weight until none is above. With r = cap * size / weight, a source is at its cap exactly
    if r lies below the level that is left when all sources of smaller r are at theirs.
    """
    weights = (F.col("place") - 1) % 3 + 1 if weights is None else weights
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size").cast("double") * F.col("size")).alias("squares"), F.count(F.lit(1)).alias("documents"))
    placed = per.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = placed.withColumn("weight", weights.cast("double")).withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    free = weighed.withColumn("level", level).withColumn("level", F.when(F.col("ratio") >= F.col("level"), F.col("level")))
    shared = F.first("level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return free.withColumn("shared", shared).select(
        "source", "source_size", "squares", "documents", "place",
        F.coalesce(F.least(cap * F.col("source_size").cast("double"), F.col("weight") * F.col("shared")), F.lit(0.0)).alias("target"),
    )


def tilted_rates(classes: DataFrame, sources: DataFrame, staged: Staged, cap: int = CAP) -> DataFrame:
    """The multiplier of each source: place, mean, target, multiplier.

    classes: place, size, n (sizes above 0). Sources whose target is 0 or their cap need no search: an
    infinite multiplier gives the rates 0 or cap.
    """
    inf = F.lit(float("inf"))
    top = F.log(F.lit(float(cap)))
    ends = classes.groupBy("place").agg(F.min("size").alias("least"))
    state = sources.join(ends, "place").select(
        "place", "target", (F.col("source_size") / F.col("documents")).alias("mean"),
        F.when(F.col("target") <= 0, -inf).when(F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), inf).alias("fixed"),
        F.lit(0.0).alias("multiplier"), (-60.0 * F.col("source_size") / F.col("documents") / F.col("least")).alias("low"),
        (top * F.col("source_size") / F.col("documents") / F.col("least")).alias("high"), F.lit(False).alias("settled"),
    )
    state = state.withColumn("settled", F.col("fixed").isNotNull()).withColumn("multiplier", F.coalesce("fixed", "multiplier")).drop("fixed")
    told = ["place", "target", "mean", "multiplier"]
    state, left = staged.write_counted(state, ~F.col("settled"))
    done = [state.where("settled").select(*told)]
    for _ in range(STEPS):
        if not left:
            break
        x = F.col("size") / F.col("mean")
        inner = F.col("multiplier") * x < top
        mass = F.col("n") * F.col("size") * F.exp(F.least(F.col("multiplier") * x, top))
        # Each source that is left has classes, so that its sums can carry what is known of it.
        both = classes.join(state.where("NOT settled").drop("settled"), "place").groupBy("place", "target", "mean", "multiplier", "low", "high").agg(
            F.sum(mass).alias("value"), F.sum(F.when(inner, mass * x).otherwise(0.0)).alias("slope")
        )
        over = F.col("value") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("multiplier")), F.when(over, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - (F.col("value") - F.col("target")) / F.col("slope")
        good = F.abs(F.col("value") - F.col("target")) <= PRECISE * F.col("target")
        step = F.when((F.col("slope") > 0) & (newton > F.col("new_low")) & (newton < F.col("new_high")), newton).otherwise((F.col("new_low") + F.col("new_high")) / 2)
        state, left = staged.write_counted(
            both.withColumn("new_low", low).withColumn("new_high", high).select(
                "place", "target", "mean", F.when(good, F.col("multiplier")).otherwise(step).alias("multiplier"),
                F.when(good, F.col("low")).otherwise(F.col("new_low")).alias("low"), F.when(good, F.col("high")).otherwise(F.col("new_high")).alias("high"), good.alias("settled"),
            ),
            ~F.col("settled"),
        )
        done.append(state.where("settled").select(*told))
    done.append(state.where("NOT settled").select(*told))
    return reduce(DataFrame.union, done)


def _filled(dealt: DataFrame, cap: int) -> DataFrame:
    """`given` changed by what its source lacks or exceeds: from the largest size that is no more than
    the lack downwards, as many copies as there is room for, until the next would be too many."""
    lacks = dealt.groupBy("place").agg((F.first("target") - F.sum(F.col("size") * F.col("given"))).alias("lack"))
    rows = dealt.join(lacks, "place").withColumn("room", F.when(F.col("size") > F.abs("lack"), 0).when(F.col("lack") > 0, cap * F.col("n") - F.col("given")).otherwise(F.col("given")))
    before = F.sum(F.col("room") * F.col("size")).over(Window.partitionBy("place").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1))
    left = F.greatest(F.abs("lack") - F.coalesce(before, F.lit(0)), F.lit(0.0))
    change = F.least(F.col("room"), F.floor(left / F.col("size")))
    # Past the first class that isn't used up, nothing more is taken, so that the sum stays within the lack.
    open_before = F.coalesce(F.max(F.when(F.col("change") < F.col("room"), 1)).over(Window.partitionBy("place").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("change", change).withColumn("ended", open_before)
    return rows.withColumn("given", F.col("given") + F.when(F.col("ended") == 0, F.signum("lack").cast("long") * F.col("change")).otherwise(0)).select(*dealt.columns)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Column | None = None, cap: int = CAP) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, rate, copies, taken.

    Null texts and texts without words have size 0, rate 1 and no copies to give; they are not taken.
    A null source is a source of its own, the last. Repeated rows count as rows. An empty table gives
    an empty result. Reruns agree, as ties are cut by hash and id.
    """
    staged = Staged(docs.sparkSession, "mixing")
    sizes = staged.write(docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col]).alias("size")))
    sources = staged.write(source_targets(sizes, weights, cap))
    placed = sizes.join(sources.select(F.col("source").alias("name"), "place", "source_size", "target"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    classes = staged.write(
        sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
        .join(sources.select(F.col("source").alias("name"), "place"), F.col("source").eqNullSafe(F.col("name"))).select("place", "size", "n")
    )
    tilts = tilted_rates(classes, sources, staged, cap)
    rate = F.exp(F.least(F.col("multiplier") * (F.col("size") / F.col("mean")), F.log(F.lit(float(cap)))))
    rated = classes.join(tilts, "place").select("place", "size", "n", "target", rate.alias("rate"))
    upto = F.floor(F.sum(F.col("n") * F.col("rate")).over(Window.partitionBy("place").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)) + 0.5 - 1e-9)
    dealt = rated.withColumn("upto", upto)
    dealt = dealt.withColumn("given", F.least(F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("place").orderBy("size")), F.lit(0)), cap * F.col("n"))).drop("upto")
    dealt = staged.write(dealt)
    dealt = staged.write(_filled(dealt, cap))
    for _ in range(REPAIRS):
        lacks = dealt.groupBy("place").agg((F.first("target") - F.sum(F.col("size") * F.col("given"))).alias("lack"))
        near = dealt.join(lacks, "place").where(F.when(F.col("lack") > 0, F.col("given") < cap * F.col("n")).otherwise(F.col("given") > 0))
        near = near.groupBy("place").agg(F.min(F.struct(F.abs(F.col("size") - F.abs("lack")).alias("off"), "size", "lack")).alias("best")).where("best.off < abs(best.lack)")
        near = near.select("place", F.col("best.size").alias("size"), F.signum("best.lack").cast("long").alias("change"))
        mended = dealt.join(near, ["place", "size"], "left").withColumn("given", F.col("given") + F.coalesce("change", F.lit(0)))
        dealt, changed = staged.write_counted(mended, F.col("change").isNotNull())
        dealt = dealt.drop("change")
        if not changed:  # nor would another turn change anything
            break
    shares = dealt.select("place", "size", "n", "given", "rate", F.ceil(F.sqrt("n")).alias("buckets"))
    spread = staged.write(
        placed.join(shares, ["place", "size"], "left").withColumn("hash", F.xxhash64("id", "place")).withColumn("bucket", F.expr("pmod(hash, coalesce(buckets, 1))"))
    )
    inside = spread.where("given % n > 0").groupBy("place", "size", "bucket").agg(F.count(F.lit(1)).alias("here"), F.first("n").alias("n"), (F.first("given") % F.first("n")).alias("extra"))
    up = F.sum("here").over(Window.partitionBy("place", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("up", up).select(
        "place", "size", "bucket", (F.floor(F.col("up") * F.col("extra") / F.col("n")) - F.floor((F.col("up") - F.col("here")) * F.col("extra") / F.col("n"))).alias("extra")
    )
    # Only where some of a class get one copy more than others is there a rank; the rest, such as all texts without words, stays out of it.
    uneven = F.coalesce(F.col("given") % F.col("n") > 0, F.lit(False))
    ranked = spread.where(uneven).withColumn("rank", F.row_number().over(Window.partitionBy("place", "size", "bucket").orderBy("hash", "id"))).join(inside, ["place", "size", "bucket"], "left")
    ranked = ranked.withColumn("more", F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)).drop("rank", "extra")
    every = ranked.unionByName(spread.where(~uneven).withColumn("more", F.lit(0)))
    copies = F.coalesce(F.floor(F.col("given") / F.col("n")), F.lit(0)) + F.col("more")
    return every.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.coalesce("rate", F.lit(1.0)).alias("rate"), copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Column | None = None, cap: int = CAP) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it has copies, with the columns of docs.

    Rows of size 0 give nothing to a mix in words and stay once, so that no document is lost to it.
    """
    found = mix_sources(keyed(docs, id_col, text_col, source_col), "doc_row", "text", source_col, weights, cap)
    times = found.groupBy("doc_row").agg(F.sum(F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))).alias("times"))
    return deal_out(docs, times, id_col, text_col)
