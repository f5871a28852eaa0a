"""Statistics over result rows (strategy, language, value). Sums are taken by Spark; tails of distributions on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions.distributions import f_upper, t_quantile, t_two_sided

BASELINE = 0.57


def descriptive(results: DataFrame) -> DataFrame:
    """Mean, deviation, extremes and quartiles by strategy, by language and over all; one value has deviation 0."""
    sets = results.groupingSets([["strategy"], ["language"], []], "strategy", "language")
    r = lambda c: F.round(c, 6)
    return sets.agg(
        F.count("value").alias("n"), r(F.avg("value")).alias("mean"), r(F.coalesce(F.stddev_samp("value"), F.lit(0.0))).alias("std"),
        r(F.min("value")).alias("min"), r(F.max("value")).alias("max"), r(F.percentile("value", F.lit(0.5))).alias("median"),
        r(F.percentile("value", F.lit(0.25))).alias("q1"), r(F.percentile("value", F.lit(0.75))).alias("q3"))


def first_by(value: str, name: str, descending: bool = True) -> Column:
    """The name with the largest value, of equal ones the first name."""
    key = F.struct((-F.col(value) if descending else F.col(value)).alias("v"), F.col(name).alias("n"))
    return F.min(key)["n"]


def compare_languages(results: DataFrame) -> DataFrame:
    per = results.groupBy("language").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), first_by("value", "strategy").alias("best_strategy"))
    return per.select("language", "n", F.round("mean", 6).alias("mean"), "best_strategy")


def language_gap(results: DataFrame, a: str = "en", b: str = "kr") -> DataFrame:
    """One row: means of two languages, their distance and the better one (b where they are equal); nulls where one is missing."""
    of = lambda lang: F.avg(F.when(F.col("language") == lang, F.col("value")))
    per = results.agg(of(a).alias("a"), of(b).alias("b"))
    return per.select(F.round("a", 6).alias(f"{a}_mean"), F.round("b", 6).alias(f"{b}_mean"), F.round(F.abs(F.col("a") - F.col("b")), 6).alias("gap"),
                      F.when(F.col("a") > F.col("b"), a).when(F.col("a") <= F.col("b"), b).alias("better"))


def compare_strategies(results: DataFrame, a: str = "en", b: str = "kr") -> DataFrame:
    """Means per strategy over all, in two languages, and how alike those are."""
    of = lambda lang: F.avg(F.when(F.col("language") == lang, F.col("value")))
    per = results.groupBy("strategy").agg(F.avg("value").alias("mean"), of(a).alias("a"), of(b).alias("b"))
    return per.select("strategy", F.round("mean", 6).alias("mean"), F.round("a", 6).alias(f"{a}_mean"), F.round("b", 6).alias(f"{b}_mean"),
                      F.round(1 / (1 + F.abs(F.col("a") - F.col("b"))), 6).alias("consistency"))


def ensemble_effect(results: DataFrame) -> DataFrame:
    """Strategies named as ensembles against the others."""
    own = F.col("strategy").contains("ensemble")
    mean = lambda c: F.avg(F.when(c, F.col("value")))
    std = lambda c: F.stddev_pop(F.when(c, F.col("value")))
    per = results.agg(mean(own).alias("e"), mean(~own).alias("i"), std(own).alias("se"), std(~own).alias("si"), F.count_if(own).alias("n_ensemble"),
                      first_by("value", "strategy").alias("best"))
    return per.select("n_ensemble", F.round("e", 6).alias("ensemble_mean"), F.round("i", 6).alias("individual_mean"),
                      F.round(F.try_divide((F.col("e") - F.col("i")) * 100, F.col("i")), 6).alias("improvement_pct"), "best",
                      (F.col("se") < F.col("si")).alias("steadier"))


def paired_t(results: DataFrame, a: str = "en", b: str = "kr") -> DataFrame:
    """t of the differences between two languages over strategies; null below two pairs."""
    first = lambda lang: results.where(F.col("language") == lang).groupBy("strategy").agg(F.avg("value").alias(lang))
    d = first(a).join(first(b), "strategy").select((F.col(a) - F.col(b)).alias("d"))
    per = d.agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    return per.select("n", F.round("m", 6).alias("mean_difference"), F.round(F.try_divide(F.col("m"), F.col("s") / F.sqrt(F.col("n").cast("double"))), 6).alias("t"),
                      F.round(F.coalesce(F.try_divide(F.col("m"), F.col("s")), F.lit(0.0)), 6).alias("cohens_d"))


def one_sample_t(results: DataFrame, baseline: float = BASELINE) -> DataFrame:
    per = results.agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.stddev_pop("value").alias("p"))
    return per.select("n", F.round("m", 6).alias("mean"), F.round("p", 6).alias("std"),
                      F.round(F.try_divide(F.col("m") - baseline, F.col("s") / F.sqrt(F.col("n").cast("double"))), 6).alias("t"))


def pooled_t(rows: DataFrame, group: Column) -> DataFrame:
    """Independent t with equal variances between rows where `group` holds and the others; Cohen's d with it."""
    g = rows.select(F.when(group, 1).otherwise(0).alias("g"), "value")
    of = lambda k, f: f(F.when(F.col("g") == k, F.col("value")))
    s = g.agg(*[of(k, f).alias(f"{n}{k}") for k in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n0, n1 = F.col("n0"), F.col("n1")
    pooled = F.try_divide((n0 - 1) * F.coalesce("v0", F.lit(0.0)) + (n1 - 1) * F.coalesce("v1", F.lit(0.0)), (n0 + n1 - 2).cast("double"))
    diff = F.col("m1") - F.col("m0")
    return s.select("n1", "n0", F.round(diff, 6).alias("difference"),
                    F.round(F.try_divide(diff, F.sqrt(pooled * (1.0 / F.nullif(n0, F.lit(0)) + 1.0 / F.nullif(n1, F.lit(0))))), 6).alias("t"),
                    F.round(F.coalesce(F.try_divide(diff, F.sqrt(pooled)), F.lit(0.0)), 6).alias("cohens_d"))


def tests(results: DataFrame, baseline: float = BASELINE, level: float = 0.05) -> DataFrame:
    """(test, statistic, p, significant) of all tests that the values allow; tails are taken on the driver for these few numbers.

    Paired by language, against the baseline, ensembles against the others, and analysis of variance over the others.
    """
    out = []

    def add(name: str, statistic: float | None, p: Callable[[float], float]) -> None:
        if statistic is not None and math.isfinite(statistic):
            tail = p(statistic)
            out.append((name, statistic, tail, tail < level))

    paired, single = paired_t(results).first(), one_sample_t(results, baseline).first()
    own = F.col("strategy").contains("ensemble")
    both, anova = pooled_t(results, own).first(), anova_f(results.where(~own), "strategy").first()
    add("paired_languages", paired["t"], lambda t: t_two_sided(t, paired["n"] - 1))
    add("one_sample", single["t"], lambda t: t_two_sided(t, single["n"] - 1))
    if both["n0"] and both["n1"]:
        add("ensembles", both["t"], lambda t: t_two_sided(t, both["n0"] + both["n1"] - 2))
    if anova:
        add("anova", anova["f"], lambda f: f_upper(f, anova["groups"] - 1, anova["values"] - anova["groups"]))
    return results.sparkSession.createDataFrame(out, "test string, statistic double, p double, significant boolean")


def anova_f(rows: DataFrame, group: str) -> DataFrame:
    """One-way analysis of variance over groups of at least two values."""
    per = rows.groupBy(group).agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).where("n >= 2")
    t = per.agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("b")
    return t.where("g >= 2").select(F.col("g").alias("groups"), F.col("n").alias("values"), F.round(
        F.try_divide(between / (F.col("g") - 1), within / (F.col("n") - F.col("g"))), 4).alias("f"))


def effect_sizes(results: DataFrame, baseline: float = BASELINE) -> DataFrame:
    """Per strategy: distance to the baseline in population deviations, with its label."""
    per = results.groupBy("strategy").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("p"))
    d = F.coalesce(F.try_divide(F.col("m") - baseline, F.col("p")), F.lit(0.0))
    return per.select("strategy", F.round(d, 6).alias("effect"), effect_label(d).alias("label"))


def effect_label(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def interval(n: int, mean: float, std: float, level: float = 0.95) -> tuple[float, float]:
    """t interval of a mean; zeros below two values."""
    if n < 2:
        return 0.0, 0.0
    half = t_quantile(0.5 + level / 2, n - 1) * std / math.sqrt(n)
    return mean - half, mean + half


def confidence_intervals(results: DataFrame, key: str) -> DataFrame:
    """Intervals per group; the groups are few, so the quantiles are taken on the driver."""
    rows = results.groupBy(key).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("s")).collect()
    data = [(r[key], r["n"], *interval(r["n"], r["m"], r["s"])) for r in rows]
    return results.sparkSession.createDataFrame(data, f"{key} string, n bigint, low double, high double")


def analyse(results: DataFrame) -> dict:
    """All statistics with p-values, as plain values."""
    one = lambda df: df.first().asDict()
    paired, single = one(paired_t(results)), one(one_sample_t(results))
    anova = anova_f(results, "strategy").first()
    out = {
        "descriptive": [r.asDict() for r in descriptive(results).collect()], "languages": [r.asDict() for r in compare_languages(results).collect()],
        "strategies": [r.asDict() for r in compare_strategies(results).collect()], "ensembles": one(ensemble_effect(results)), "paired_t": paired, "one_sample_t": single,
        "gap": one(language_gap(results)), "tests": [r.asDict() for r in tests(results).collect()],
        "anova": anova.asDict() if anova else None, "effects": [r.asDict() for r in effect_sizes(results).collect()]}
    for test in (paired, single):
        test["p"] = t_two_sided(test["t"], test["n"] - 1) if test["t"] is not None and test["n"] > 1 else None
    if anova and anova["f"] is not None:
        out["anova"]["p"] = f_upper(anova["f"], anova["groups"] - 1, anova["values"] - anova["groups"])
    return out


def report(analysis: dict) -> str:
    """The analysis as text."""
    lines = ["Statistical report", "=================="]
    for row in analysis["strategies"]:
        lines.append(f"{row['strategy']}: mean {row['mean']}, consistency {row['consistency']}")
    for name in ("paired_t", "one_sample_t", "anova"):
        test = analysis[name]
        if test:
            lines.append(f"{name}: " + ", ".join(f"{k} {v:.4g}" if isinstance(v, float) else f"{k} {v}" for k, v in test.items()))
    return "\n".join(lines)
