"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact word length per source. Each length gives its part of the source's budget,
so that the mix keeps the source's profile, and hands on to the next shorter length what it can't use; a
bounded-knapsack table over the lengths then fits the budget that remains, with some documents handed back
where it can't be met without them. Documents of each length are picked in a seeded order.

Defined results for odd input: a null text has size 0 and is never taken; a null source is a source
of its own, last in order; repeated rows count as separate documents, and rows may share a doc_id or have
none; an empty table gives an empty
result; other columns are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import global_rank, stage

WORDS = r"[^\x20\x09-\x0D]+"
#: Words that the knapsack table spans at most.
TABLE_WORDS = 1 << 16


def word_count(text) -> "F.Column":
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def fit_budget(lengths: np.ndarray, counts: np.ndarray, want: float, width: int = TABLE_WORDS) -> np.ndarray:
    """How many documents of each length to take, so that their words come nearest ``want``.

    Longest first, every length gives its proportional part and what lengths before it left over. What
    remains then is less than the shortest document left, and is fitted by a bounded-knapsack table (the
    lower one of two sums as near). If no sum of the documents left meets it, more and more taken ones are
    handed back, shortest first, as far as the table spans; small sources are so fitted from nothing.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if want <= 0 or not total:
        return take
    if want >= total:
        return counts.copy()
    by_length = np.argsort(-lengths, kind="stable")
    carry, taken = Fraction(0), 0
    share = Fraction(float(want)) / total
    for i in by_length:
        carry += share * int(lengths[i] * counts[i])
        take[i] = min(int(counts[i]), int(carry // int(lengths[i])))
        carry -= int(take[i] * lengths[i])
        taken += int(take[i] * lengths[i])
    best, back = take, 0
    while True:
        held, rest = take.copy(), want - taken
        for i in by_length[::-1]:
            n = min(back, int(held[i]), int((width - rest) // lengths[i]) if rest < width else 0)
            held[i] -= n
            rest += float(n * lengths[i])
        more = rest > want - taken
        if rest <= width:
            found = held + knapsack(lengths, counts - held, rest)
        else:  # the shortest document left is longer than the table: one more, or none
            i = min((j for j in by_length if counts[j] > held[j]), key=lambda j: lengths[j])
            found = held.copy()
            found[i] += lengths[i] - rest < rest
        apart, least = (abs(float((x * lengths).sum()) - want) for x in (found, best))
        if apart < least:
            best = found
        if min(apart, least) <= 0.5 or (back and not more) or (held == 0).all() or back > int(take.max()):
            return best
        back = 2 * back or 1


def knapsack(lengths: np.ndarray, left: np.ndarray, rest: float) -> np.ndarray:
    """Bounded subset sum: counts per length whose words come nearest ``rest``."""
    top = 2 * int(rest) + 1
    came = np.full(top + 1, -1, np.int64)  # the item by which a sum was first reached
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    goal = math.ceil(rest - 0.5)  # the nearest whole sum, the lower one of two
    for i in np.argsort(lengths, kind="stable"):
        n, k = min(int(left[i]), top // int(lengths[i])), 1
        while n > 0 and not reached[goal]:
            k = min(k, n)
            step = k * int(lengths[i])
            new = np.flatnonzero(reached[: top + 1 - step] & ~reached[step:]) + step
            came[new] = len(items)
            reached[new] = True
            items.append((int(i), k))
            n -= k
            k *= 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    out = np.zeros(len(lengths), np.int64)
    while at:
        i, k = items[came[at]]
        out[i] += k
        at -= k * int(lengths[i])
    return out


def source_targets(sizes: DataFrame, share: float, repeats: int, weights: tuple[int, ...]) -> DataFrame:
    """``k, source_size, target`` by source: water-filling, one row of sums to the driver a round."""
    totals = sizes.groupBy("k").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    ranked = global_rank(totals, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    sources = ranked.withColumn("weight", weight)
    cap = F.col("source_size") * float(repeats)
    level, full, known = 0.0, F.lit(False), -1
    while True:
        s = sources.agg(
            F.sum("source_size"),
            F.sum(F.when(full, F.col("source_size"))),
            F.sum(F.when(~full, F.col("weight"))),
            F.count(F.when(full, 1)),
        ).first()
        total, capped, free, n = (int(x or 0) for x in s)
        if n == known or not free:
            break
        known = n
        level = float((Fraction(share) * total - repeats * capped) / free)
        full = cap < F.col("weight") * level
    return sources.select("k", "source_size", F.when(full, cap).otherwise(F.col("weight") * level).alias("target"))


def mix(
    docs: DataFrame,
    share: float = 1.5,
    repeats: int = 2,
    weights: tuple[int, ...] = (3, 1, 2),
    seed: int = 17,
    width: int = TABLE_WORDS,
    row: str | None = None,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source``, and the column ``row`` if named, for every document.

    ``taken`` is the document's words in the mix: ``size`` times its copies, ``repeats`` at most.
    """
    named = [row] if row else []
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    sizes = docs.select(*named, "doc_id", "source", key.alias("k"), word_count("text").alias("size"), F.xxhash64("text").alias("digest"))
    sizes = stage(sizes, "mix_sizes")
    sources = source_targets(sizes, share, repeats, weights)
    # A source's table has a row per length, so n words give fewer than sqrt(2n) rows.
    lengths = sizes.groupBy("k", "size").agg(F.count("*").alias("n")).join(sources, "k")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        copies = int(target // size) if size else 0
        pdf = pdf.assign(copies=copies, quota=0)
        words = pdf["size"].to_numpy() > 0
        picked = fit_budget(pdf["size"].to_numpy()[words], pdf["n"].to_numpy()[words], target - copies * size, width)
        pdf.loc[words, "quota"] = picked
        return pdf[["k", "size", "source_size", "target", "copies", "quota"]]

    plan = lengths.groupBy("k").applyInPandas(
        fit, "k string, size long, source_size long, target double, copies long, quota long"
    )
    # Documents of a length go by a seeded hash into about sqrt(rows) shards: a running sum over the
    # shards tells what each gives, so that neither it nor a shard's ranking grows with a hot length.
    shards = max(8, math.isqrt(sizes.count()))
    sizes = sizes.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "digest"), F.lit(shards)))
    by_shard = sizes.groupBy("k", "size", "shard").agg(F.count("*").alias("n")).join(plan, ["k", "size"])
    before = Window.partitionBy("k", "size").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    give = F.greatest(F.lit(0), F.least("n", F.col("quota") - F.coalesce(F.sum("n").over(before), F.lit(0))))
    by_shard = by_shard.select("k", "size", "shard", "source_size", "target", "copies", give.alias("give"))
    within = Window.partitionBy("k", "size", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "digest"), "doc_id", "digest")
    more = (F.row_number().over(within) <= F.col("give")).cast("long")
    return sizes.join(by_shard, ["k", "size", "shard"]).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + more)).alias("taken"), "source", *named
    )
