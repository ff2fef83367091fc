"""Evaluation over many runs: confusion metrics, resampling intervals, enrichment and permutation tests.

Resampling works on counts of equal units, so it is no larger than they; generators are seeded by what they draw for,
so a resampling repeats exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(rows: DataFrame, truth: str, flag: str, by: list[str] | None = None) -> DataFrame:
    """n, tp, fp, fn, tn, precision, recall, f1 and fpr of rows(truth, flag), by groups; 0 where there is nothing to divide by."""
    t, p = F.col(truth), F.col(flag)
    x = rows.where(t.isNotNull() & p.isNotNull()).groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    c = F.col
    x = x.withColumns({"precision": _share(c("tp"), c("tp") + c("fp")), "recall": _share(c("tp"), c("tp") + c("fn")), "fpr": _share(c("fp"), c("fp") + c("tn"))})
    return x.withColumn("f1", _share(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def by_repeat(rows: DataFrame, truth: str, flags: str) -> DataFrame:
    """confusion() of each repeat k of rows(truth, flags array); rows with a missing repeat are left out."""
    whole = rows.where(F.forall(flags, lambda v: v.isNotNull()))
    return confusion(whole.select(truth, F.posexplode(flags).alias("k", "flag")), truth, "flag", ["k"])


def spread(metrics: DataFrame, column: str) -> DataFrame:
    """(mean, spread) of a metric over repeats."""
    return metrics.agg(F.avg(column).alias("mean"), (F.max(column) - F.min(column)).alias("spread"))


def flip_rate(rows: DataFrame, flags: str) -> DataFrame:
    """The share of rows whose repeats disagree."""
    return rows.where(F.size(flags) > 0).agg(_share(F.count_if(F.size(F.array_distinct(flags)) > 1), F.count("*")).alias("flip_rate"))


def _draw(seed: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)) / float(1 << 53)


def _resampled(rows: DataFrame, unit: str, truth: str, flags: list[str], draws: int, seed: int) -> DataFrame:
    """(draw, tp0, fp0, fn0, tp1, ...): counts of resampled units, draw 0 as they are.

    Units with equal counts are a class; how often a class is drawn is a Poisson number with its size as the mean: the
    sum of its units' Poisson(1) numbers. Classes are few, so nothing is multiplied by the draws but they.
    """
    t = F.col(truth)
    names = [f"{kind}{k}" for k in range(len(flags)) for kind in ("tp", "fp", "fn")]
    sums = [F.count_if(c) for f in flags for c in (t & F.col(f), ~t & F.col(f), t & ~F.col(f))]
    classes = rows.groupBy(unit).agg(*(c.alias(n) for c, n in zip(sums, names, strict=True))).groupBy(*names).agg(F.count("*").alias("units"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts, totals = b[names].to_numpy(), np.zeros((draws + 1, len(names)))
            for row, units in zip(counts, b["units"], strict=True):
                times = np.concatenate([[units], np.random.default_rng([seed, *row.tolist()]).poisson(units, draws)])
                totals += times[:, None] * row
            yield pd.DataFrame(totals.astype("int64"), columns=names).assign(draw=np.arange(draws + 1))[["draw", *names]]

    drawn = classes.mapInPandas(draw, "draw int, " + ", ".join(f"{n} long" for n in names))
    return drawn.groupBy("draw").agg(*(F.sum(n).alias(n) for n in names))


def _interval(x: DataFrame, value: Column, draws: int) -> DataFrame:
    """(point, low, high, draws) of a value of _resampled(): the 95 % percentile interval; `draws` + 1 rows."""
    xs = F.sort_array(F.collect_list(F.when(F.col("draw") > 0, F.col("v"))))
    at = lambda q: F.element_at("xs", round(q * (draws - 1)) + 1)
    return x.select("draw", value.alias("v")).agg(F.max(F.when(F.col("draw") == 0, F.col("v"))).alias("point"), xs.alias("xs")).select("point", at(0.025).alias("low"), at(0.975).alias("high"), F.size("xs").alias("draws"))


def _f1_of(k: int) -> Column:
    tp, fp, fn = (F.col(f"{n}{k}") for n in ("tp", "fp", "fn"))
    return _share(2 * tp, 2 * tp + fp + fn)


def bootstrap_f1(rows: DataFrame, unit: str, truth: str, flag: str, draws: int = 1000, seed: int = 7) -> DataFrame:
    """(point, low, high, draws): F1 with its 95 % percentile interval, resampling whole units."""
    return _interval(_resampled(rows, unit, truth, [flag], draws, seed), _f1_of(0), draws)


def paired_bootstrap_f1(rows: DataFrame, unit: str, truth: str, one: str, other: str, draws: int = 1000, seed: int = 7) -> DataFrame:
    """(point, low, high, draws, at_most_0): the difference of two flags' F1 on the same resampled units, and the share
    of draws in which it is not above 0."""
    drawn = _resampled(rows, unit, truth, [one, other], draws, seed).withColumn("d", _f1_of(0) - _f1_of(1)).select("draw", "d")
    below = drawn.where("draw > 0").agg(F.avg((F.col("d") <= 0).cast("int")).alias("at_most_0"))
    return _interval(drawn, F.col("d"), draws).crossJoin(F.broadcast(below))  # one row by one row


def _hypergeometric(rng: np.random.Generator, inside: int, outside: int, ones: int, draws: int) -> np.ndarray:
    """Draws of how many of `ones` outcomes fall inside; beyond what the generator takes, by the normal limit."""
    n = inside + outside
    if n < 10**9:
        return rng.hypergeometric(inside, outside, ones, draws)
    mean = ones * (inside / n)
    spread = (mean * (outside / n) * ((n - ones) / (n - 1))) ** 0.5
    return np.clip(np.rint(rng.normal(mean, spread, draws)), max(0, ones - outside), min(ones, inside)).astype(np.int64)


def stratified_permutation(rows: DataFrame, unit: str, stratum: str, group: str, outcome: str, draws: int = 500, seed: int = 11) -> DataFrame:
    """(observed, p, draws): the difference of mean outcome between group and the rest, and the share of permutations
    of the outcome within strata that reach it, (r + 1) / (draws + 1).

    Of a permuted stratum only the number of outcomes that fall in the group counts, which is hypergeometric in three
    counts; so strata are counted, and no row is permuted.
    """
    x = rows.select(F.col(stratum).cast("string").alias("s"), F.col(group).cast("int").alias("g"), F.col(outcome).cast("int").alias("o"))
    counts = x.groupBy("s").agg(F.count_if(F.col("g") == 1).alias("inside"), F.count_if(F.col("g") == 0).alias("outside"), F.count_if(F.col("o") == 1).alias("ones"), F.count_if((F.col("o") == 1) & (F.col("g") == 1)).alias("hits"))

    def permute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total = np.zeros(draws + 1, np.int64)
            for s, inside, outside, ones, hits in zip(b["s"], b["inside"], b["outside"], b["ones"], b["hits"], strict=True):
                rng = np.random.default_rng([seed, zlib.crc32(str(s).encode())])
                total += np.concatenate([[hits], _hypergeometric(rng, inside, outside, min(ones, inside + outside), draws)])
            yield pd.DataFrame({"draw": np.arange(draws + 1), "hits": total, "inside": b["inside"].sum(), "outside": b["outside"].sum(), "ones": b["ones"].sum()})

    sums = counts.mapInPandas(permute, "draw int, hits long, inside long, outside long, ones long").groupBy("draw").agg(*(F.sum(c).alias(c) for c in ("hits", "inside", "outside", "ones")))
    c = F.col
    d = sums.select("draw", (_share(c("hits"), c("inside")) - _share(c("ones") - c("hits"), c("outside"))).alias("d"))
    seen = d.where("draw = 0").select(F.col("d").alias("observed"))
    reached = F.count_if(F.abs("d") >= F.abs("observed") - 1e-12)
    return d.where("draw > 0").crossJoin(F.broadcast(seen)).groupBy("observed").agg(((reached + 1) / (F.count("*") + 1)).alias("p"), F.count("*").alias("draws"))


def enrichment(rows: DataFrame, hit: str, chance: str) -> DataFrame:
    """(observed, expected, ratio) of rows(hit boolean, chance): how often a label falls where chance would put it."""
    return rows.agg(F.count_if(hit).alias("observed"), F.sum(chance).alias("expected")).withColumn("ratio", F.try_divide("observed", "expected"))


def within_unit_null(rows: DataFrame, unit: str, chance: str, observed: int, draws: int = 1000, seed: int = 13) -> DataFrame:
    """(draws, reached): in how many draws independent chances give at least `observed` hits."""
    drawn = rows.select(unit, chance).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    sums = drawn.groupBy("draw").agg(F.count_if(_draw(seed, "draw", unit) < F.col(chance)).alias("hits"))
    return sums.agg(F.count("*").alias("draws"), F.count_if(F.col("hits") >= observed).alias("reached"))


def cut_table(rows: DataFrame, share: str, hit: str, cuts: tuple[float, ...] = (0.2, 0.4, 0.5, 0.6, 0.8)) -> DataFrame:
    """Hits among rows with share >= cut and below it, for each cut."""
    x = rows.withColumn("cut", F.explode(F.array(*map(F.lit, cuts)))).groupBy("cut")
    up = F.col(share) >= F.col("cut")
    return x.agg(F.count_if(up).alias("n_above"), F.count_if(up & F.col(hit)).alias("hits_above"), F.count_if(~up).alias("n_below"), F.count_if(~up & F.col(hit)).alias("hits_below"))
