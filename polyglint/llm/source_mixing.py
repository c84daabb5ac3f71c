"""Mixing sources to target weights (native DataFrame operations).

Weights are the sources' token shares raised to an exponent in [0, 1] and normalised. The
exponent is bisected inside the plan: the largest whose entropy reaches ``entropy`` times the
largest possible one, raised if need be until no source repeats more than ``max_repeats``
times. Weights are then rounded to millionths, so all that follows is integer arithmetic; a source
of fewer than ``SMALL_PPM`` gets its part from the weight itself, and one document at least, so
that no source leaves for being small, and its blocks are counted from a hashed one.

Each source gets its part of the token budget. Its documents, in a hashed order that differs
by epoch, are laid end to end until the part is spent, and the stream is cut into as many
blocks as the budget has; so every block holds every source at its weight. Rows inside a
block are in hashed order, which makes it a permutation over sources.

Running sums are two-level: tokens by (source, epoch, slice of the hash range) are summed
first, then rows are summed inside their slice. A source with a third of all rows is dealt
over thousands of slices, and no task holds a source. Only token counts and ids are shuffled.

Cases: a null source is a source of its own (it stays null); a null or empty text has one
token; a null id is allowed; repeated rows count each; an empty table gives an empty result;
columns other than the three named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, sized_join

ENTROPY, MAX_REPEATS, BLOCK_TOKENS, SEED, STEPS = 0.95, 4.0, 1 << 20, "mix", 40
#: Slices of the hash range per source and epoch.
SLICES = 1024
#: Sources of fewer millionths get their part from the exact weight, whose rounding would be more than 0.05 % of it.
SMALL_PPM = 1000


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up, at least 1."""
    return F.greatest(F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4), F.lit(1)).cast("long")


def _power_sum(shares: Column, alpha: Column) -> Column:
    return F.aggregate(shares, F.lit(0.0), lambda s, x: s + x["n"] * F.pow(x["p"], alpha))


def _entropy(shares: Column, alpha: Column) -> Column:
    z = _power_sum(shares, alpha)
    return F.log(z) - alpha * F.aggregate(shares, F.lit(0.0), lambda s, x: s + x["n"] * F.pow(x["p"], alpha) * F.log(x["p"])) / z


def _repeats(shares: Column, alpha: Column, budget_ratio: Column) -> Column:
    return budget_ratio * F.array_max(F.transform(shares, lambda x: F.pow(x["p"], alpha - 1))) / _power_sum(shares, alpha)


def _bisect(keep_low: Callable[[Column], Column]) -> Column:
    """The point in [0, 1] where ``keep_low(alpha)`` turns from true to false."""

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        return F.when(keep_low(mid), F.struct(mid.alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step)
    return ends


def source_weights(totals: DataFrame, budget: int | None = None, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """From (source, tokens) per source: source, tokens, alpha, ppm (weight in millionths), budget.

    The different totals, each with the number of its sources, are gathered in one row. Their sum
    bounds them: T tokens make at most sqrt(2 T) different totals, however many sources there are.
    """
    different = totals.filter("tokens > 0").groupBy("tokens").agg(F.count("*").alias("n"))
    one = different.agg(F.array_sort(F.collect_list(F.struct("tokens", "n"))).alias("all"), F.sum(F.col("tokens") * F.col("n")).alias("total"), F.sum("n").alias("sources"))
    one = one.withColumn("shares", F.transform("all", lambda t: F.struct((t["tokens"] / F.col("total")).alias("p"), t["n"].alias("n")))).withColumn("budget", F.col("total") if budget is None else F.lit(budget).cast("long"))
    shares, ratio = F.col("shares"), F.col("budget") / F.col("total")
    target = F.lit(entropy) * F.log(F.col("sources").cast("double"))
    by_entropy = F.when(_entropy(shares, F.lit(1.0)) >= target, 1.0).otherwise(_bisect(lambda a: _entropy(shares, a) >= target)["lo"])
    by_repeats = F.when(_repeats(shares, F.lit(0.0), ratio) <= max_repeats, 0.0).otherwise(_bisect(lambda a: _repeats(shares, a, ratio) > max_repeats)["hi"])
    one = materialise(one.withColumn("alpha", F.greatest(by_entropy, by_repeats)), "mix-exponent")  # one row; else each use bisects anew
    one = one.withColumn("z", _power_sum(shares, F.col("alpha")))
    joined = totals.join(F.broadcast(one.select("alpha", "z", "total", "budget")))  # one row
    weight = F.pow(F.col("tokens") / F.col("total"), F.col("alpha")) / F.col("z")
    ppm = F.floor(weight * 1_000_000 + 0.5).cast("long")
    return joined.select("source", "tokens", "alpha", ppm.alias("ppm"), F.expr("budget").alias("whole"), F.floor(F.col("budget") * weight + 0.5).cast("long").alias("exact")).withColumn("budget", F.when(F.col("ppm") < SMALL_PPM, F.greatest("exact", F.lit(1).cast("long"))).otherwise(F.expr("whole * ppm div 1000000"))).drop("exact")


def mix_sources(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per use of a document: doc_id, source, n_tokens, epoch, block, block_order, weight_ppm."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), token_estimate(F.col(text_col)).alias("n_tokens"))
    rows = materialise(rows, "mix-rows")
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    weights = materialise(source_weights(totals, budget, entropy, max_repeats), "mix-weights")
    plan = weights.select(
        F.col("source").alias("s"), "tokens", "ppm", "budget", F.greatest(F.expr(f"whole div {block_tokens}"), F.lit(1)).alias("blocks"), F.expr("(budget + tokens - 1) div tokens").alias("epochs")
    ).filter("budget > 0")
    plan = materialise(plan.select(F.struct("s").alias("key"), "tokens", "ppm", "budget", "blocks", "epochs"), "mix-plan")
    uses = sized_join(rows.withColumn("key", F.struct(F.col("source").alias("s"))), plan, ["key"], "inner")  # a struct, so that null equals null
    uses = uses.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    name = F.concat_ws(":", F.lit(SEED), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    uses = uses.withColumn("h", F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")).withColumn("slice", F.expr(f"h div {(1 << 32) // SLICES}"))
    keys = ["key", "epoch", "slice"]
    sums = uses.groupBy(*keys).agg(F.sum("n_tokens").alias("part"))
    before = Window.partitionBy("key", "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # at most SLICES rows
    starts = sums.select(*keys, F.coalesce(F.sum("part").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*keys).orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = uses.join(starts, keys).withColumn("at", F.col("epoch") * F.col("tokens") + F.col("start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = placed.filter("at < budget")
    block = F.expr("cast((cast(at as decimal(20,0)) * blocks) div budget as bigint)")
    block = F.when(F.col("ppm") < SMALL_PPM, (block + F.pmod(F.xxhash64("source"), "blocks")) % F.col("blocks")).otherwise(block)  # else all small sources begin in the first block
    return placed.select("doc_id", "source", "n_tokens", "epoch", block.alias("block"), F.col("h").alias("block_order"), F.col("ppm").alias("weight_ppm"))
