"""Mixing sources to target weights by temperature.

The token share of each source is raised to an exponent. The exponent is bisected until the mixture's entropy
reaches a target, or until no source is repeated more often than a limit allows; without a budget, the mixture is
just large enough to use every document once. Weights are realised exactly to the document: each pass over a source
is a permutation of its blocks and of the documents within them, and the last pass stops at the source's budget.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, add_offsets, stored, text_or_empty

MAX_REPETITION = 1.5
SEED = 7
BLOCK_DOCS = 1000
GRID, ROUNDS = 32, 8


def source_totals(docs: DataFrame) -> DataFrame:
    return docs.groupBy("key").agg(F.sum("tokens").alias("total"), F.count("*").alias("n_docs"))


def _measures(exponent: Column, share: Column, want_entropy: bool) -> dict[str, Column]:
    power = F.pow(share, exponent)
    if want_entropy:
        return {"z": F.sum(power), "x": F.sum(power * F.log(share))}
    # tokens asked from a source over tokens it has, up to the factor that the budget sets
    return {"z": F.sum(power), "x": F.max(power / share), "y": F.min(power / share)}


def choose_exponent(totals: DataFrame, max_repetition: float = MAX_REPETITION, target_entropy: float | None = None,
                    budget: int | None = None) -> float:
    """Bisects the exponent on the table of source totals. Every round tests a grid of exponents in one aggregate,
    so only a few numbers reach the driver, however many sources there are. The grid is data, not a column each: the
    plan is small and every round runs the same generated code.

    Entropy (in nats) falls with the exponent; the largest exponent that reaches the target is taken. Repetition
    falls as well while the exponent is below 1; the smallest exponent within the limit is taken. If none is, 1, but a
    budget that no exponent can meet within the limit is an error.
    """
    whole = totals.agg(F.sum("total")).first()[0] or 0
    if not whole:
        return 1.0
    share = F.col("total") / whole
    rows = totals.filter("total > 0")
    low, high = 0.0, (8.0 if target_entropy is not None else 1.0)
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        tried = rows.select(share.alias("share"), F.posexplode(F.array(*[F.lit(e) for e in grid])).alias("i", "e"))
        measures = _measures(F.col("e"), F.col("share"), target_entropy is not None)
        found = {r.i: r for r in tried.groupBy("i").agg(*[m.alias(n) for n, m in measures.items()]).collect()}
        good = []
        for i, e in enumerate(grid):
            z, x = found[i].z, found[i].x
            if target_entropy is not None:
                good.append(log(z) - e * x / z >= target_entropy - 1e-12)
            else:
                repeated = x / found[i].y if budget is None else x / z * budget / whole
                good.append(repeated <= max_repetition + 1e-12)
        if target_entropy is not None:  # good, ..., good, bad, ...
            if not good[0]:
                return low
            at = max(i for i, ok in enumerate(good) if ok)
            if at == GRID:
                return high
            low, high = grid[at], grid[at + 1]
        else:  # bad, ..., bad, good, ...
            if good[0]:
                return low
            if not good[-1]:
                if budget is not None:
                    raise ValueError(f"{budget} tokens need more than {max_repetition} uses of {whole} tokens")
                return high
            at = min(i for i, ok in enumerate(good) if ok)
            low, high = grid[at - 1], grid[at]
    return low if target_entropy is not None else high


def target_weights(totals: DataFrame, exponent: float, budget: int | None = None) -> DataFrame:
    """(key, total, n_docs, weight, target): ``target`` tokens are to be taken from the source."""
    rows = totals.withColumn("power", F.when(F.col("total") > 0, F.pow(F.col("total").cast("double"), F.lit(exponent)))
                             .otherwise(F.lit(0.0)))
    z, largest = rows.agg(F.sum("power"), F.max(F.when(F.col("total") > 0, F.col("total") / F.col("power")))).first()
    asked = float(budget) if budget is not None else (largest or 0.0) * (z or 0.0)
    weight = F.col("power") / F.lit(z or 1.0)
    # without a budget the source that sets it is used exactly once, whatever the rounding
    target = F.greatest(F.round(weight * asked), F.col("total") if budget is None else F.lit(0)).cast("long")
    return rows.select("key", "total", "n_docs", weight.alias("weight"), target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        max_repetition: float = MAX_REPETITION, target_entropy: float | None = None, budget: int | None = None,
        seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """Rows of the mixture: doc_id, source, pass int, tokens long, place double, weight double, and ``record`` with
    the columns named in ``carry``.

    ``place`` runs from 0 to 1 over every source's stream; sorting by it interleaves the sources in proportion to
    their weights. Tokens are words. Null sources are a source of their own. Documents without words are emitted
    once per full pass. Repeated rows are documents of their own. Empty tables give no rows.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    record = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("struct<x:int>")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("key"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("tokens"), record.alias("record"))
    light = stored(rows.select("doc_id", "key", "tokens"), "mix-tokens")
    totals = stored(source_totals(light), "mix-totals")
    exponent = choose_exponent(totals, max_repetition, target_entropy, budget)
    weights = stored(target_weights(totals, exponent, budget), "mix-weights")

    n_passes = F.greatest(F.ceil(F.col("target") / F.greatest("total", F.lit(1))), F.lit(1)).cast("int")
    passes = weights.select(
        "key", "total", "weight", "target", F.ceil(F.col("n_docs") / BLOCK_DOCS).alias("n_blocks"),
        F.explode(F.sequence(F.lit(0), n_passes - 1)).alias("pass"))
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("n_blocks"))
    blocks = light.join(weights.select("key", F.ceil(F.col("n_docs") / BLOCK_DOCS).alias("n_blocks")), "key").groupBy(
        "key", block.alias("block")).agg(F.sum("tokens").alias("tokens"))
    turn = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "key", "pass", "block"), 2)
    ordered = blocks.join(passes.select("key", "pass"), "key").withColumn("turn", turn)
    starts = stored(add_offsets(ordered, ["key", "pass"], "turn", "tokens", "start", block=1 << 51), "mix-starts")

    drawn = rows.join(passes, "key").withColumn("block", block).join(
        starts.select("key", "pass", "block", "start"), ["key", "pass", "block"])
    within = Window.partitionBy("key", "pass", "block").orderBy(
        F.xxhash64(F.lit(seed + 2), "pass", "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("at", F.col("pass") * F.col("total") + F.col("start") + F.coalesce(
        F.sum("tokens").over(within), F.lit(0)))
    # a pass that is not the last holds every document; the last one stops where the budget is reached
    full = (F.col("pass") + 1) * F.col("total") <= F.col("target")
    return placed.filter(full | (F.col("at") < F.col("target"))).select(
        "doc_id", "source", "pass", "tokens", (F.col("at") / F.greatest("target", F.lit(1))).alias("place"),
        "weight", "record")
