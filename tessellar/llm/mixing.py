"""Mixing sources to target weights by Pareto order sampling.

A source with target T and size S gives each document floor(T / S) certain
whole copies. The rest is a sample of fixed size with unequal probabilities.
With p = frac(T / S) a document's inclusion odds are p / (1 - p) times its size
over the mean size of the source's documents. It draws u in (0, 1), and its
rank is the quotient of u / (1 - u) and the inclusion odds. Documents are taken
in rank order; one that no longer fits in what the source lacks is passed over,
until no document fits. In the end one more is taken if that comes nearer to
the target. So only whole documents are taken.

No source is sorted. Words are summed per source and 1/4096 of the rank range,
then per 1/4096 of the range in which the rest falls; all before that range are
taken. From there on the order is followed in spans that double in length: as
far as the sums of what fits stay within the gap, and one span further, whose
few documents are taken or passed over one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

BINS = 12  #: bits of the rank that one level of the search resolves
BITS = 48  #: bits of a draw, and of a rank
#: Up to so many sources their table is broadcast (some 100 bytes a row); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000
#: A hot source is split in so many parts where sources are joined by shuffle.
SALT = 64
_DOC = "struct<rank:bigint,id:bigint,size:bigint>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(key: Column, seed: int = 0) -> Column:
    """A number from 0 to 2**48 - 1, the same in every run, and in SQL: the first 12 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long")


def pareto_rank(draw: Column, size: Column, rest: Column, source_size: Column, docs: Column) -> Column:
    """The quotient of a draw's odds and the inclusion odds, as a whole number that keeps its order.

    Null where the odds are 0: nothing is sampled, or the document has no words.
    """
    u = (draw + F.lit(0.5)) / F.lit(float(1 << BITS))
    p = F.try_divide(rest, source_size)
    odds = F.try_divide(p / (F.lit(1.0) - p) * (size * docs), source_size)
    quotient = F.try_divide(u / (F.lit(1.0) - u), odds)
    return F.floor(quotient / (F.lit(1.0) + quotient) * F.lit(float(1 << BITS))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in code point order, null last, weigh ``weights`` in turn. The
    water level: sources fill by weight, and stop at ``most`` times their size;
    the one with the least size per weight stops first. Sources of size 0 get 0.
    Their names have a global order, so this is one task: a few dozen bytes a
    source, sorted with spilling (ten million sources are some 500 MB).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("source_size") / F.col("w"), F.col("rank"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(0, Window.unboundedFollowing)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    return (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("w", w.cast("long"))
        .withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
        # what is left, and the weights that share it, once all sources before this one have stopped
        .withColumn("left", F.col("budget") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weight", F.sum("w").over(rest))
        .withColumn("stops", most * F.col("source_size") * F.col("weight") <= F.col("left") * F.col("w"))
        # from the first that doesn't stop on, all share at its level
        .withColumn("first", F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("w"), "rank", "left", "weight"))).over(Window.partitionBy()))
        .withColumn("target", F.when(F.col("stops"), (most * F.col("source_size")).cast("double")).otherwise(F.col("first")["left"] * F.col("w") / F.col("first")["weight"]))
        .select(*sizes.columns, "target")
    )


def _with_sources(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Rows with the columns of their source; ``sources`` has ``s`` and others."""
    if few:
        return rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    salted = sources.withColumn("part", F.explode(F.array(*map(F.lit, range(SALT)))))
    rows = rows.withColumn("salt", F.pmod(F.col("draw"), F.lit(SALT)))
    return rows.join(salted, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("part"))).drop("s", "salt", "part")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    share: float = 1.0,
    most: int = 3,
    seed: int = 0,
) -> DataFrame:
    """One row per input row: ``id_col, source, size, source_size, target, taken, copies``.

    ``size`` is the number of words (a null text has none), ``taken`` is
    ``copies`` times it. Null sources are one source. Rows with the same id
    draw alike; those with equal ranks follow id and size, and full repeats
    are taken together. An empty table gives an empty result; documents
    without words have ``taken`` 0. Other columns are not read.
    """
    rows = cut(_sized(docs, id_col, text_col, source_col, seed), "sizes")
    out = _copies(rows, *_plan(rows, weights, share, most))
    return out.select(F.col("id").alias(id_col), F.col("source"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *more).withColumn("draw", draw(F.col("id"), seed))


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", pareto_rank(F.col("draw"), F.col("size"), F.col("rest"), F.col("source_size"), F.col("docs")))


def _prefix(ranked: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Of each source with a rest the rank ``cut`` before which all are taken, and the ``gap`` that they leave."""
    state = plan.select("s", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("sum"))
    for level in (1, 2):
        shift = BITS - level * BINS
        inside = _with_sources(ranked, state, few).where(F.shiftright("rank", shift + BINS) == F.col("prefix"))
        bins = inside.groupBy("source", "rest", "sum", F.shiftright("rank", shift).alias("bin")).agg(F.sum("size").alias("words"))
        over = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("to", F.col("sum") + F.sum("words").over(over))
        # the first range that passes the rest; where none does, rounding has left a word at most: the last
        pick = F.min(F.when(F.col("to") > F.col("rest"), F.struct(F.col("bin"), (F.col("to") - F.col("words")).alias("sum"))))
        last = F.max(F.struct(F.col("bin"), (F.col("to") - F.col("words")).alias("sum")))
        found = bins.groupBy("source").agg(F.coalesce(pick, last).alias("p"))
        state = cut(found.select(F.col("source").alias("s"), F.col("p")["bin"].alias("prefix"), F.col("p")["sum"].alias("sum")), "range")
    state = state.join(plan.select(F.col("s").alias("k"), "rest"), F.col("s").eqNullSafe(F.col("k")))
    return state.select("s", F.shiftleft("prefix", BITS - 2 * BINS).alias("cut"), (F.col("rest") - F.col("sum")).alias("gap"))


def _filled(ranked: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """``s, more`` (the documents beyond the prefix that are taken) and ``gap`` of each source.

    A round follows the order over one stretch of each source; it ends when no
    source has a document that fits. What a task holds of a source is the
    stretch's documents that fit: some twice the words of the gap, which is
    less than one document's after the first round.
    """
    done = None
    state = state.withColumn("at", F.col("cut")).withColumn("more", F.array().cast(f"array<{_DOC}>"))
    while True:
        state = cut(state, "gaps")
        left = _with_sources(ranked, state.select("s", "at", "gap"), few).where((F.col("rank") >= F.col("at")) & (F.col("size") <= F.col("gap")))
        # lengths of the rank from here: 0, 1, 2 to 3, 4 to 7, ...
        span = F.length(F.bin(F.col("rank") - F.col("at") + 1))
        spans = left.groupBy("source", "gap", span.alias("span")).agg(F.sum("size").alias("words"))
        over = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
        spans = spans.withColumn("to", F.sum("words").over(over))
        end = F.coalesce(F.min(F.when(F.col("to") > F.col("gap"), F.col("span"))), F.max("span"))
        ends = cut(spans.groupBy(F.col("source").alias("s")).agg(end.alias("end")), "ends")
        if ends.isEmpty():
            break
        # a span of b bits ends before at + 2**b - 1
        bounds = state.join(ends.withColumnRenamed("s", "k"), F.col("s").eqNullSafe(F.col("k"))).select("s", "at", "gap", F.expr("at + shiftleft(1L, end) - 1").alias("to"))
        stretch = _with_sources(ranked, bounds, few).where((F.col("rank") >= F.col("at")) & (F.col("rank") < F.col("to")) & (F.col("size") <= F.col("gap")))
        # full repeats become one
        stretch = stretch.groupBy("source", "gap", "to", "rank", "id", "size").agg(F.sum("size").alias("words"))
        order = F.array_sort(F.collect_list(F.struct("rank", F.coalesce("id", F.lit(-(1 << 63))).alias("by"), "size", "id", "words")))
        first = F.struct(F.col("gap").alias("gap"), F.array().cast(f"array<{_DOC}>").alias("more"))
        step = lambda acc, x: F.when(x.words <= acc.gap, F.struct((acc.gap - x.words).alias("gap"), F.concat(acc.more, F.array(F.struct(x["rank"].alias("rank"), x["id"].alias("id"), x["size"].alias("size")))).alias("more"))).otherwise(acc)
        taken = stretch.groupBy(F.col("source").alias("k"), "gap", "to").agg(order.alias("docs")).select("k", "to", F.aggregate("docs", first, step).alias("r"))
        new = state.join(taken, F.col("s").eqNullSafe(F.col("k")), "left")
        on = F.col("r").isNotNull()
        new = new.select(
            "s", "cut", F.when(on, F.col("r.gap")).otherwise(F.col("gap")).alias("gap"), F.when(on, F.col("to")).otherwise(F.col("at")).alias("at"), F.when(on, F.concat("more", "r.more")).otherwise(F.col("more")).alias("more"), on.alias("goes_on")
        )
        new = cut(new, "gaps")
        # sources where nothing fits any more are done
        done = new.where("not goes_on").drop("goes_on") if done is None else done.unionByName(new.where("not goes_on").drop("goes_on"))
        state = new.where("goes_on").drop("goes_on")
    return state if done is None else done.unionByName(state)


def _plan(rows: DataFrame, weights: tuple[int, ...], share: float, most: int, few: bool | None = None) -> tuple[DataFrame, bool]:
    """What is taken of each source, and whether the sources are few enough to be broadcast."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("docs"))
    plan = targets(sizes, weights, share, most).select(
        F.col("source").alias("s"),
        "source_size",
        "docs",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("whole"),
    )
    plan = cut(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "plan")
    few = plan.count() <= BROADCAST_SOURCES if few is None else few
    open_ = plan.where("rest > 0").select("s", "rest", "source_size", "docs")
    ranked = cut(_ranked(_with_sources(rows.where("size > 0"), open_, few)).select("source", "rest", "rank", "draw", "id", "size"), "ranked")
    filled = cut(_filled(ranked, _prefix(ranked, open_, few), few).select("s", "cut", "gap", "more"), "filled")
    # nothing fits; one document more may still come nearer
    doc = F.struct("rank", "id", "size")
    beyond = _with_sources(ranked, filled, few).where((F.col("rank") >= F.col("cut")) & (F.col("size") < 2 * F.col("gap")))
    beyond = beyond.where(~F.array_contains("more", doc)).groupBy("source", "gap", "rank", "id", "size").agg(F.sum("size").alias("words")).where("words < 2 * gap")
    miss = F.abs(F.col("words") - F.col("gap"))
    nearest = beyond.groupBy(F.col("source").alias("n")).agg(F.min(F.struct(miss.alias("miss"), F.col("rank").alias("rank"), F.coalesce("id", F.lit(-(1 << 63))).alias("by"), F.col("size").alias("size"), F.col("id").alias("id"))).alias("b"))
    filled = filled.join(nearest, F.col("s").eqNullSafe(F.col("n")), "left")
    more = F.when(F.col("b").isNull(), F.col("more")).otherwise(F.array_append("more", F.struct(F.col("b.rank").alias("rank"), F.col("b.id").alias("id"), F.col("b.size").alias("size"))))
    filled = filled.select(F.col("s").alias("k"), "cut", more.alias("more"))
    plan = plan.join(filled, F.col("s").eqNullSafe(F.col("k")), "left").drop("k")
    return cut(plan, "mix"), few


def _copies(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Rows with ``copies``, which depends on a row's source, draw, id and size alone, and the columns of the plan."""
    rows = _ranked(_with_sources(rows, plan, few))
    taken = (F.col("rank") < F.col("cut")) | F.array_contains("more", F.struct("rank", "id", "size"))
    more = (F.col("size") > 0) & F.col("cut").isNotNull() & taken
    return rows.withColumn("copies", (F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")).cast("long"))


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    share: float = 1.0,
    most: int = 3,
    seed: int = 0,
) -> DataFrame:
    """``docs`` as mixed: each row as often as ``mix`` takes it, other rows of the same id or of none notwithstanding."""
    plan, few = _plan(cut(_sized(docs, id_col, text_col, source_col, seed), "sizes"), weights, share, most)
    rows = _copies(_sized(docs, id_col, text_col, source_col, seed, F.struct("*").alias("__doc")), plan, few)
    # a product, as a filter by size alone would go below the join and count the words again
    return rows.where("size * copies > 0").select("__doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__doc.*")
