"""Sources mixed to target weights by Pfair scheduling, with DataFrame functions only.

Time runs in slots of one block. Block k (from 1) of a source of weight w is released at
floor((k - 1) / w) and due at ceil(k / w); in every slot the released block with the earliest
deadline runs, ties going to the first source by name. One processor, unit blocks and weights that sum to 1
make this schedule feasible, so a source's blocks differ from w * t by less than one at every slot t.

Weights are whole numbers over their sum, about 2**31, so all times are exact. Time is cut into
segments of equal length, which are scheduled side by side:

1. At its start a segment guesses which blocks are done: those due by then, and of the ones under way those with
   the earliest deadlines. From such a state earliest deadline first meets every later deadline.
2. It runs to its end. A segment is no shorter than any block's window, so the state that it reaches can be reached
   within this segment from any such start, and the next segment can go on from it.
3. Each segment runs again, from the state reached at its start to the one reached at its end; these runs
   join to one schedule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import require, stored

BLOCK_ROWS, BUCKETS, SEGMENT, TURNS = 16, 4096, 4096, 256
#: What weights sum to, the least share, and slots scheduled for each block.
WHOLE, LEAST_SHARE, STRETCH = 2**31, 2.0**-20, 4
_NEVER = 2**62


def shares(weights: DataFrame) -> DataFrame:
    """(source, q): weights (source, weight > 0) as whole numbers in proportion.

    Weights that are whole numbers already stay as they are, so they are held exactly. Others become parts of about WHOLE.
    A share under LEAST_SHARE counts as LEAST_SHARE.
    """
    whole, weight = Window.partitionBy(), F.col("weight")
    total = F.sum("weight").over(whole)
    exact = F.min(weight == F.floor("weight")).over(whole) & (total <= WHOLE) & (F.min("weight").over(whole) >= total * LEAST_SHARE)
    fine = weights.where("weight > 0").select("source", "weight", exact.alias("exact"), F.greatest(F.lit(1), F.floor(weight / F.max("weight").over(whole) * 2.0**50)).cast("decimal(20,0)").alias("f"))
    scaled = fine.withColumn("total", F.sum("f").over(whole).cast("decimal(26,0)"))
    parts = F.greatest(F.expr(f"cast(f * {WHOLE} as decimal(38,0)) div total"), F.lit(int(WHOLE * LEAST_SHARE)))
    return scaled.select("source", F.when(F.col("exact"), F.col("weight").cast("long")).otherwise(parts).cast("long").alias("q"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _next(done: Column, q: Column, whole: Column) -> Column:
    """The block after `done` blocks of a source: done, release, due."""
    return _let(done, lambda d: F.struct(d.alias("done"), _div(d * whole, q).alias("release"), _div((d + 1) * whole + q - 1, q).alias("due")))


def _guess(s: Column, slot: Column, whole: Column) -> Column:
    """Blocks of every source that are done at slot: all that are due, and as many of those under way as there are slots left, by deadline."""
    passed = lambda x: _div(slot * x["q"], whole)
    under = F.transform(s, lambda x, i: F.struct(F.when(F.pmod(slot * x["q"], whole) > 0, _div((passed(x) + 1) * whole + x["q"] - 1, x["q"])).alias("due"), i.alias("i")))
    left = (slot - F.aggregate(s, F.lit(0).cast("long"), lambda n, x: n + passed(x))).cast("int")
    first = F.transform(F.slice(F.array_sort(F.filter(under, lambda u: u["due"].isNotNull())), F.lit(1), left), lambda u: u["i"])
    return _let(first, lambda early: F.transform(s, lambda x, i: passed(x) + F.array_contains(early, i).cast("long")))


def _run(begin: Column, slot: Column, laps: Column, s: Column, whole: Column, upto: Column | None = None) -> Column:
    """(state, order): earliest deadline first from slot on for laps * TURNS slots, from `begin` blocks done of each source of s.

    order has the index of every slot's source. upto: blocks that each source must have done at the end, and no more.
    """

    def turn(now: Column, k: Column) -> Column:
        open_ = lambda x, i: x["release"] <= k if upto is None else (x["release"] <= k) & (x["done"] < F.get(upto, i))
        due = F.transform(now["state"], lambda x, i: F.when(open_(x, i), x["due"]).otherwise(F.lit(_NEVER)))
        pick = _let(due, lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int"))
        moved = lambda p: F.transform(now["state"], lambda x, i: F.when(i == p, _next(x["done"] + 1, F.get(s, i)["q"], whole)).otherwise(x))
        return _let(pick, lambda p: F.struct(moved(p).alias("state"), F.concat(now["order"], F.array(p)).alias("order")))

    def lap(now: Column, n: Column) -> Column:
        start = F.struct(now["state"].alias("state"), F.array().cast("array<int>").alias("order"))
        run = F.aggregate(F.sequence(slot + n * TURNS, slot + n * TURNS + (TURNS - 1)), start, turn)
        return _let(run, lambda r: F.struct(r["state"].alias("state"), F.concat(now["orders"], F.array(r["order"])).alias("orders")))

    state = F.transform(s, lambda x, i: _next(F.get(begin, i), x["q"], whole))
    zero = F.struct(state.alias("state"), F.array().cast("array<array<int>>").alias("orders"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), laps - 1), zero, lap, lambda r: F.struct(F.transform(r["state"], lambda x: x["done"]).alias("done"), F.flatten(r["orders"]).alias("order")))


def schedule(plan: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(source, k, slot): the slot from 0 of block k (from 0), k < n, for each source of plan (source, q, n).

    STRETCH slots are scheduled for each block there is; what a source has left then (its weight is far under its share
    of the blocks) follows in the order of k / weight, without gaps. A segment is one row, its sources an array.
    """
    s, whole, slot, laps = F.col("s"), F.col("whole"), F.col("slot"), F.col("laps")
    listed = plan.agg(F.array_sort(F.collect_list(F.struct("source", "q", "n"))).alias("s"), F.sum("q").alias("whole"), F.min("q").alias("least"), F.sum("n").alias("blocks")).where("blocks > 0")
    last = F.least(F.col("blocks") * STRETCH, F.array_max(F.transform(s, lambda x: _div(x["n"] * whole, x["q"]) + 1)))
    window = F.greatest(F.lit(segment).cast("long"), _div(whole, F.col("least")) + 1)
    sized = listed.withColumn("last", last).withColumn("laps", _div(F.least(window, F.col("last")) + (TURNS - 1), F.lit(TURNS).cast("long")))
    cut = stored(sized.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("last") - 1, laps * TURNS)))).withColumn("slot", F.col("j") * laps * TURNS).select("j", "slot", "laps", "whole", "s"))
    spread = cut.repartition(min(4096, max(1, cut.count())), "j")
    run = _let(_guess(s, slot, whole), lambda g: F.struct(_run(g, slot, laps, s, whole)["done"].alias("done")))
    reached = stored(spread.select("j", "slot", "laps", "whole", "s", run["done"].alias("upto")))
    before = reached.select((F.col("j") + 1).alias("j"), F.col("upto").alias("begin"))
    again = reached.join(before, "j", "left").withColumn("begin", F.coalesce("begin", F.transform(s, lambda x: F.lit(0).cast("long"))))
    order = again.select("slot", "s", "begin", F.posexplode(_run(F.col("begin"), slot, laps, s, whole, F.col("upto"))["order"]).alias("at", "i"))
    nth = F.row_number().over(Window.partitionBy("slot", "i").orderBy("at"))
    done = order.select(F.get(s, F.col("i")).alias("x"), (F.get(F.col("begin"), F.col("i")) + nth - 1).alias("k"), (F.col("slot") + F.col("at")).alias("slot")).where("k < x.n").select("x.source", "k", "slot")
    end = reached.groupBy().agg(F.max(F.struct("j", (slot + laps * TURNS).alias("slot"), "upto", "s")).alias("e")).where("e is not null").select("e.*")
    left = end.withColumn("s", F.transform(s, lambda x, i: F.struct(x["source"].alias("source"), x["q"].alias("q"), x["n"].alias("n"), F.least(x["n"], F.get(F.col("upto"), i)).alias("done"))))
    own = left.select("slot", "s", F.posexplode("s").alias("i", "x")).where("x.done < x.n").select("slot", "s", "i", "x", F.explode(F.sequence(F.col("x.done"), F.col("x.n") - 1)).alias("k"))
    # Blocks of other sources that come before block k: m with m / q <= (k + 1) / q of its own, ties to the first.
    ahead = lambda y, j: _div((F.col("k") + 1) * y["q"] - F.when(j > F.col("i"), 1).otherwise(0), F.col("x.q"))
    rank = F.aggregate(F.transform(s, lambda y, j: F.when(j == F.col("i"), F.col("k") - F.col("x.done")).otherwise(F.greatest(F.lit(0).cast("long"), F.least(ahead(y, j), y["n"]) - y["done"]))), F.lit(0).cast("long"), lambda a, n: a + n)
    return done.unionByName(own.select("x.source", "k", (F.col("slot") + rank).alias("slot")))


def mixed(docs: DataFrame, weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS, segment: int = SEGMENT) -> DataFrame:
    """doc_id, source, block (from 0), release, deadline, slot, place for each row of docs (doc_id, source).

    Rows of a source are shuffled by md5(doc_id) and cut into blocks of block_rows. place =
    slot * block_rows + the row's place in its block: ordering by it gives the mix. All rows stay: when a
    source ends, its later slots stand empty and the others keep their proportions; up to the slot where
    the first source ends the mix holds the target weights, each source less than one block from them.
    After STRETCH slots for each block the rest of over-full sources follows without gaps. weights (source, weight)
    default to the square root of each source's rows; sources without a positive weight there, and shares
    under LEAST_SHARE, count as LEAST_SHARE. A null source is a source named ''. Repeated rows and null ids are
    rows like others (equal rows take their places in any order). No rows give no rows. Other columns are ignored.
    """
    require(docs, "doc_id", "source")
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source")).withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    per_bucket = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = stored(per_bucket.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    totals = before.groupBy("source").agg(F.sum("n").alias("rows"))
    if weights is None:
        listed = totals.select("source", "rows", F.sqrt("rows").alias("weight"))
    else:
        given = weights.select(F.coalesce("source", F.lit("")).alias("source"), F.col("weight").cast("double").alias("weight")).groupBy("source").agg(F.max("weight").alias("weight"))
        listed = totals.join(given, "source", "left").select("source", "rows", F.when((F.col("weight") > 0) & ~F.isnan("weight") & (F.col("weight") < float("inf")), F.col("weight")).alias("weight"))
        listed = listed.withColumn("weight", F.coalesce("weight", F.when(F.max("weight").over(Window.partitionBy()).isNull(), 1.0).otherwise(F.max("weight").over(Window.partitionBy()) * 2.0**-50)))
    blocks = F.ceil(F.col("rows") / block_rows).cast("long").alias("n")
    plan = stored(shares(listed).join(listed.select("source", blocks), "source").withColumn("whole", F.sum("q").over(Window.partitionBy())))
    times = stored(schedule(plan.drop("whole"), segment))
    # A bucket is 1/4096 of a source at random, so a hot source is ranked by thousands of tasks.
    ranked = rows.withColumn("i", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id"))).join(before.drop("n").hint("merge"), ["source", "bucket"]).withColumn("i", F.col("i") + F.col("before") - 1)
    placed = ranked.withColumn("block", F.floor(F.col("i") / block_rows)).join(times.withColumnRenamed("k", "block").hint("merge"), ["source", "block"]).join(plan.select("source", "q", "whole"), "source")
    release, due = _div(F.col("block") * F.col("whole"), F.col("q")), _div((F.col("block") + 1) * F.col("whole") + F.col("q") - 1, F.col("q"))
    return placed.select("doc_id", "source", "block", release.alias("release"), due.alias("deadline"), "slot", (F.col("slot") * block_rows + F.col("i") % block_rows).alias("place"))
