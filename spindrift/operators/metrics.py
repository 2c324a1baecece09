"""Evaluation of ranked lists against graded judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.session import small_side, stored


def recall(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """``(qid, recall)`` for every judged question: share of its judged ids (of any grade) in the first k."""
    hits = judged.join(ranked.where(F.col("rank") <= k).select("qid", "id", "rank"), ["qid", "id"], "left")
    return hits.groupBy("qid").agg((F.count("rank") / F.count("*")).alias("recall"))


def reciprocal_rank(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    hits = judged.join(ranked.where(F.col("rank") <= k).select("qid", "id", "rank"), ["qid", "id"], "left")
    return hits.groupBy("qid").agg(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("mrr"))


def gain(grade: Column, rank: Column) -> Column:
    return F.when(grade > 0, (F.pow(F.lit(2.0), grade) - 1.0) / F.log2(rank + 1.0)).otherwise(0.0)


def ndcg(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """``(qid, ndcg)`` for every judged question; 0 where no grade is positive."""
    ideal_rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "id"))
    ideal = judged.withColumn("r", ideal_rank).where(F.col("r") <= k).groupBy("qid").agg(F.sum(gain(F.col("grade"), F.col("r"))).alias("ideal"))
    hits = judged.join(ranked.where(F.col("rank") <= k).select("qid", "id", "rank"), ["qid", "id"], "left")
    got = hits.groupBy("qid").agg(F.sum(F.coalesce(gain(F.col("grade"), F.col("rank")), F.lit(0.0))).alias("dcg"))
    return got.join(ideal, "qid").select("qid", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def floor_percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float], most: int = 10_000, bins: int = 1024) -> DataFrame:
    """The value at index ``min(floor(n * share), n - 1)`` of the sorted values of each group, exactly; nulls are no values.

    Groups of at most ``most`` values are sorted as they are. In a larger one the rank is looked for: a
    histogram between the least and the greatest value, counted on the map side, shows the bin that holds
    it, and the search goes on in that bin until it is small, or has one value only. So a group of any size
    is spread over all tasks, and no more than ``most`` values or ``bins`` counts of it ever meet.
    """
    held = rows.select(F.col(group).alias("g"), F.col(value).alias("v")).where("v is not null")
    sizes = stored(held.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    place = lambda p: F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1)
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(p).alias("rank")) for name, p in shares.items()])).alias("a")
    todo = sizes.select("g", "lo", "hi", "n", asked).select("g", "lo", "hi", "n", "a.name", "a.rank")
    found = [todo.where("lo = hi").select("g", "name", F.col("lo").alias("v")), in_small(held, todo.where(f"lo <> hi and n <= {most}"))]
    todo = stored(todo.where(f"lo <> hi and n > {most}"))
    while not todo.isEmpty():
        own = within(held, todo)
        width = (F.col("hi").cast("double") - F.col("lo")) / bins
        own = own.withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / F.when(width > 0, width).otherwise(1.0)), F.lit(bins - 1)))
        counts = own.groupBy("tg", "name", "rank", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        counts = counts.groupBy("tg", "name", "rank").agg(F.sort_array(F.collect_list(F.struct("bin", "n", "lo", "hi"))).alias("bins"))
        step = "aggregate(bins, named_struct('left', rank, 'lo', bins[0].lo, 'hi', bins[0].hi, 'n', bins[0].n, 'in', false), (a, b) -> CASE WHEN a.in THEN a WHEN a.left < b.n THEN named_struct('left', a.left, 'lo', b.lo, 'hi', b.hi, 'n', b.n, 'in', true) ELSE named_struct('left', a.left - b.n, 'lo', a.lo, 'hi', a.hi, 'n', a.n, 'in', false) END)"
        now = stored(counts.select(F.col("tg").alias("g"), "name", F.expr(step).alias("s")).select("g", "s.lo", "s.hi", "s.n", "name", F.col("s.left").alias("rank")))
        found += [now.where("lo = hi").select("g", "name", F.col("lo").alias("v")), in_small(held, now.where(f"lo <> hi and n <= {most}"))]
        todo = stored(now.where(f"lo <> hi and n > {most}"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    picks = [F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares]
    return out.groupBy(F.col("g").alias(group)).agg(*picks)


def within(held: DataFrame, ranges: DataFrame) -> DataFrame:
    """Values in the ranges of their groups, with the ranges' columns; the group is ``tg``."""
    ranges = ranges.withColumnRenamed("g", "tg").withColumnRenamed("n", "size")
    return held.join(small_side(ranges, ranges.count()), held["g"].eqNullSafe(F.col("tg")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).drop("g")


def in_small(held: DataFrame, ranges: DataFrame) -> DataFrame:
    """The value of each rank in a range that holds few values."""
    each = within(held, ranges).groupBy("tg", "name", "rank").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    return each.select(F.col("tg").alias("g"), "name", F.element_at("vs", (F.col("rank") + 1).cast("int")).alias("v"))
