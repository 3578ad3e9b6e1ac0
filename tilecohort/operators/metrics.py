"""Classification, regression and survival statistics over long tables.

Inputs are long: a group key (fold, target, class), a truth and a score. Each
operator is one or two shuffles on the group key; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import chi2_p_value, t_interval_half, t_p_value
from .bootstrap import Resampled
from .ordered import PART, concordance, ranged, running, with_group

POSITIVE, NEGATIVE, CALL_MORE = "positive", "negative", "call for more"


def percent(numerator: Column, denominator: Column) -> Column:
    """Two decimals, or an empty string for an empty denominator."""
    return F.when(denominator == 0, F.lit("")).otherwise(F.format_string("%.2f", F.bround(100.0 * numerator / denominator, 2)))


def confusion(rows: DataFrame, truth: str = "truth", predicted: str = "predicted", status: str = "status", by: list[str] | None = None) -> DataFrame:
    """Confusion summary of rows whose status isn't ``error``: a row of counts and percentages for each group.

    Predictions other than the two classes count in the total and in no cell.
    """
    by = by or []
    ok = F.col(status) != "error"
    is_true = lambda c: ok & (F.col(truth) == c)
    said = lambda c: F.col(predicted) == c
    n = lambda c: F.count_if(c)
    counted = rows.groupBy(*by).agg(
        F.count("*").alias("total_all"),
        n(ok).alias("in_statistics"),
        n(is_true(POSITIVE)).alias("positives"),
        n(is_true(NEGATIVE)).alias("negatives"),
        n(F.col(status) == "ok").alias("ok_runs"),
        n(F.col(status) == "error").alias("error_runs"),
        n(ok & said(CALL_MORE)).alias("call_more"),
        n(is_true(POSITIVE) & said(POSITIVE)).alias("tp"),
        n(is_true(NEGATIVE) & said(NEGATIVE)).alias("tn"),
        n(is_true(NEGATIVE) & said(POSITIVE)).alias("fp"),
        n(is_true(POSITIVE) & said(NEGATIVE)).alias("fn"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    balanced = F.when((tp + fn == 0) | (tn + fp == 0), F.lit("")).otherwise(F.format_string("%.2f", F.bround((100.0 * tp / (tp + fn) + 100.0 * tn / (tn + fp)) / 2, 2)))
    return counted.select(
        *by, *[c for c in counted.columns if c not in by],
        percent(tp + tn, F.col("in_statistics")).alias("accuracy"),
        percent(tp, tp + fn).alias("sensitivity"),
        percent(tn, tn + fp).alias("specificity"),
        percent(tp, tp + fp).alias("precision"),
        percent(tn, tn + fn).alias("npv"),
        percent(2 * tp, 2 * tp + fp + fn).alias("f1"),
        balanced.alias("balanced_accuracy"),
    )


def metric_rows(summary: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(metric, value) rows of a summary."""
    by = by or []
    names = [c for c in summary.columns if c not in by]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in names])
    return summary.select(*by, F.explode(pairs).alias("m")).select(*by, "m.metric", "m.value")


def _by_score(rows: DataFrame, by: list[str], truth: str, score: str) -> DataFrame:
    """Positives p and negatives n of each distinct score."""
    return rows.groupBy(*by, score).agg(F.sum(truth).cast("double").alias("p"), F.sum(1 - F.col(truth)).cast("double").alias("n"))


def auroc(rows: DataFrame, by: list[str], truth: str = "truth", score: str = "score") -> DataFrame:
    """Area under the ROC curve with ties counted half; null where a group has one class."""
    order = [F.col(score)]
    upto = running(ranged(_by_score(rows, by, truth, score), by, *order), by, order, upto=F.col("n"))
    won = F.col("p") * (F.col("upto") - F.col("n") / 2)
    return upto.groupBy(*by).agg(F.round(F.try_divide(F.sum(won), F.sum("p") * F.sum("n")), 6).alias("auroc"))


def average_precision(rows: DataFrame, by: list[str], truth: str = "truth", score: str = "score") -> DataFrame:
    """Sum of recall steps times precision, a point for each distinct score from the top."""
    down = [F.desc(score)]
    upto = running(ranged(_by_score(rows, by, truth, score), by, *down), by, down, tp=F.col("p"), fp=F.col("n"))
    return upto.groupBy(*by).agg(F.round(F.try_divide(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("p")), 6).alias("average_precision"))


def curve_points(rows: DataFrame, by: list[str], truth: str = "truth", score: str = "score") -> DataFrame:
    """Points of the ROC and precision-recall curves: a row for each distinct score, from the top."""
    down, at = [F.desc(score)], _by_score(rows, by, truth, score)
    upto = running(ranged(at, by, *down), by, down, tp=F.col("p"), fp=F.col("n"))
    sums = at.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    full = with_group(upto, sums, by)
    tp, fp = F.col("tp"), F.col("fp")
    return full.select(*by, score, F.round(F.try_divide(fp, F.col("all_n")), 6).alias("fpr"), F.round(F.try_divide(tp, F.col("all_p")), 6).alias("tpr"), F.round(tp / (tp + fp), 6).alias("precision"))


def argmax_class(scores: Column, classes: Column) -> Column:
    """The class of the first largest score."""
    return F.element_at(classes, F.array_position(scores, F.array_max(scores)).cast("int"))


def f1_by_class(rows: DataFrame, by: list[str], classes: list[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One-against-rest count and F1 of each class."""
    each = rows.select(*by, truth, predicted, F.explode(F.array(*map(F.lit, classes))).alias("class"))
    t, p = F.col(truth) == F.col("class"), F.col(predicted) == F.col("class")
    counted = each.groupBy(*by, "class").agg(F.count_if(t).alias("count"), F.count_if(t & p).alias("tp"), F.count_if(t | p).alias("union"))
    return counted.select(*by, "class", "count", F.round(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("union") + F.col("tp")), F.lit(0.0)), 6).alias("f1"))


def fold_mean_sem(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, standard error and 95 % t interval over folds; error and interval of one fold are null."""
    n = F.count(value)
    s = rows.groupBy(*by).agg(n.alias("folds"), F.avg(value).alias("mean"), F.when(n > 1, F.stddev_samp(value) / F.sqrt(n)).alias("sem"))
    half = t_interval_half("sem", (F.col("folds") - 1).cast("double"))
    return s.select(*by, "folds", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"), F.round(F.col("mean") - half, 5).alias("low"), F.round(F.col("mean") + half, 5).alias("high"))


def t_statistic(rows: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Student's two-sample t with equal variances between rows of group 1 and the others, its degrees of freedom and two-sided p.

    t is null where a side is empty, both together have two rows or fewer, or nothing varies.
    """
    one, other = F.when(F.col(group) == 1, F.col(value)), F.when(F.col(group) != 1, F.col(value))
    s = rows.groupBy(*by).agg(F.count(one).alias("n1"), F.count(other).alias("n0"), F.avg(one).alias("m1"), F.avg(other).alias("m0"), F.var_pop(one).alias("v1"), F.var_pop(other).alias("v0"))
    df = F.col("n1") + F.col("n0") - 2
    pooled = F.when(df > 0, F.try_divide(F.col("n1") * F.col("v1") + F.col("n0") * F.col("v0"), df))
    spread = F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n0"))))
    placed = s.select(*by, df.alias("df"), F.try_divide(F.col("m1") - F.col("m0"), spread).alias("t"))
    return placed.select(*by, "df", F.round("t", 6).alias("t"), t_p_value("t", F.col("df").cast("double")).alias("p"))


def regression(rows: DataFrame, by: list[str], truth: str, predicted: str) -> DataFrame:
    """R2, Pearson r and its p (null where a side is constant), mean absolute and root mean squared error, count."""
    e = F.col(truth) - F.col(predicted)
    s = rows.groupBy(*by).agg(
        F.count("*").alias("count"), F.sum(e * e).alias("sse"), F.regr_syy(truth, predicted).alias("sst"), F.regr_sxx(truth, predicted).alias("sxx"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.regr_sxy(truth, predicted).alias("sxy")
    )
    flat = (F.col("sst") == 0) | (F.col("sxx") == 0)
    s = s.withColumn("r", F.try_divide(F.col("sxy"), F.sqrt(F.col("sst") * F.col("sxx"))))
    df = F.when(F.col("count") > 2, (F.col("count") - 2).cast("double"))
    t = F.when(~flat, F.try_divide(F.col("r") * F.sqrt(df), F.sqrt(F.greatest(1 - F.col("r") * F.col("r"), F.lit(0.0)))))
    return s.select(*by, "count", F.round(1 - F.try_divide(F.col("sse"), F.col("sst")), 6).alias("r2"), F.round(F.when(~flat, F.col("r")), 6).alias("pearson_r"), t_p_value(t, df).alias("pearson_p"), F.round("mae", 6).alias("mae"), F.round(F.sqrt("mse"), 6).alias("rmse"))


def ols(rows: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Least-squares line of y on x and the standard error of its slope; null where x doesn't vary, the error with two rows as well."""
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), F.regr_avgx(y, x).alias("mx"), F.regr_avgy(y, x).alias("my"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    error = F.sqrt(F.try_divide(F.try_divide(F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0)), F.when(F.col("n") > 2, F.col("n") - 2)), F.col("sxx")))
    return s.select(*by, "n", F.round(slope, 6).alias("slope"), F.round(F.col("my") - slope * F.col("mx"), 4).alias("intercept"), F.round(error, 6).alias("stderr"))


def at_risk(rows: DataFrame, by: list[str], time: str, event: str) -> DataFrame:
    """Deaths d, rows n and rows at risk at each distinct time of a group, with the time's range partition."""
    at = rows.groupBy(*by, time).agg(F.sum(event).alias("d"), F.count("*").alias("n"))
    upto = running(ranged(at, by, F.col(time)), by, [F.col(time)], _c=F.col("n"))
    sums = at.groupBy(*by).agg(F.sum("n").alias("_all"))
    return with_group(upto, sums, by).select(PART, *by, time, "d", "n", (F.col("_all") - F.col("_c") + F.col("n")).alias("risk"))


def kaplan_meier(rows: DataFrame, by: list[str], time: str, event: str) -> DataFrame:
    """Survival after each distinct time; 0 from the time on when all at risk die."""
    logs = F.when(F.col("d") < F.col("risk"), F.log1p(-F.col("d") / F.col("risk"))).otherwise(0.0)
    r = running(at_risk(rows, by, time, event), by, [F.col(time)], gone=(F.col("d") == F.col("risk")).cast("int"), logs=logs)
    return r.select(*by, time, F.col("risk").alias("at_risk"), F.col("d").alias("events"), F.round(F.when(F.col("gone") > 0, 0.0).otherwise(F.exp("logs")), 6).alias("survival"))


def logrank_by(rows: DataFrame, by: list[str], group: str, time: str, event: str) -> DataFrame:
    """Two-group log-rank statistic (group is 0 or 1) and its p for each ``by``; null where a group is empty."""
    at = rows.groupBy(*by, time).agg(F.sum(event).alias("d"), F.count("*").alias("n"), F.sum(F.col(event) * F.col(group)).alias("d1"), F.sum(group).alias("n1"))
    down = [F.desc(time)]
    r = running(ranged(at, by, *down), by, down, y=F.col("n"), y1=F.col("n1"))
    share = F.col("y1") / F.col("y")
    var = F.when((F.col("y") > 1) & (F.col("d") > 0), F.col("d") * share * (1 - share) * (F.col("y") - F.col("d")) / (F.col("y") - 1)).otherwise(0.0)
    s = r.groupBy(*by).agg(F.sum(F.col("d1") - F.col("d") * share).alias("o"), F.sum(var).alias("v"))
    chi2 = s.select(*by, F.try_divide(F.col("o") * F.col("o"), F.col("v")).alias("x"))
    return chi2.select(*by, F.round("x", 6).alias("chi2"), chi2_p_value("x").alias("p"))


def logrank(rows: DataFrame, group: str, time: str, event: str) -> DataFrame:
    """The log-rank test over all rows, one row."""
    return logrank_by(rows, [], group, time, event)


def comparable_pairs(rows: DataFrame, by: list[str], time: str, event: str) -> DataFrame:
    """Pairs with t_i < t_j and an event at t_i, counted without a pair join: later rows times events at each time."""
    r = at_risk(rows, by, time, event)
    return r.groupBy(*by).agg(F.sum(F.col("d") * (F.col("risk") - F.col("n"))).alias("pairs"))


def c_index(rows: DataFrame, by: list[str], time: str, event: str, risk: str) -> DataFrame:
    """Concordance of risk with earlier events over comparable pairs, ties of risk counted half; no pairs are formed."""
    found, pairs = concordance(rows, by, time, event, risk), comparable_pairs(rows, by, time, event)
    return with_group(pairs, found, by, "left").select(*by, "pairs", F.round(F.try_divide(F.col("won") + F.col("tied") / 2, F.col("pairs")), 6).alias("c_index"))


def _shifted(rows: DataFrame, by: list[str], risk: str) -> DataFrame:
    """rows with z, the log risk less the group's largest."""
    top = rows.groupBy(*by).agg(F.max(risk).alias("_top"))
    return with_group(rows, top, by).withColumn("z", F.col(risk) - F.col("_top")).drop("_top")


def cox_breslow(rows: DataFrame, by: list[str], time: str, event: str, risk: str) -> DataFrame:
    """Breslow partial log-likelihood with the log risk given, shifted by its maximum for stability."""
    at = _shifted(rows, by, risk).groupBy(*by, time).agg(F.sum(event).alias("d"), F.sum(F.exp("z")).alias("e"), F.sum(F.col(event) * F.col("z")).alias("s"))
    down = [F.desc(time)]
    term = running(ranged(at, by, *down), by, down, r=F.col("e")).withColumn("l", F.col("s") - F.col("d") * F.log("r"))
    return term.groupBy(*by).agg(F.round(F.sum("l"), 4).alias("loglik"))


def common_settings(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Each column's value where it has exactly one in the group, else null."""
    return rows.groupBy(*by).agg(*[F.when(F.count_distinct(c) == 1, F.max(c)).alias(c) for c in columns])


def shannon_entropy(rows: DataFrame, by: list[str], bin_: str) -> DataFrame:
    """Entropy in bits of the histogram of bins in a group."""
    n = rows.groupBy(*by, bin_).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.sum("n").alias("n"), F.round(F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"), 6).alias("entropy"))


def cox_efron(rows: DataFrame, by: list[str], time: str, event: str, risk: str) -> DataFrame:
    """Efron's partial log-likelihood: of d deaths at one time the l-th sees the risk set less l / d of the dying."""
    z = _shifted(rows, by, risk)
    at = z.groupBy(*by, time).agg(F.sum(event).cast("int").alias("d"), F.sum(F.exp("z")).alias("e"), F.sum(F.col(event) * F.exp("z")).alias("de"), F.sum(F.col(event) * F.col("z")).alias("s"))
    down = [F.desc(time)]
    placed = running(ranged(at, by, *down), by, down, r=F.col("e")).filter("d > 0")
    logs = F.aggregate(F.sequence(F.lit(0), F.col("d") - 1), F.lit(0.0), lambda acc, l: acc + F.log(F.col("r") - l / F.col("d") * F.col("de")))
    return placed.withColumn("l", F.col("s") - logs).groupBy(*by).agg(F.round(F.sum("l"), 4).alias("loglik"))


def bootstrap_auroc(rows: DataFrame, by: list[str], key: str, truth: str = "truth", score: str = "score", samples: int = 1000, seed: int = 0) -> DataFrame:
    """Median and 95 % band of the AUROC over resamples, and how many had both classes."""
    areas = Resampled(rows, by, key, truth, score, samples, seed).areas()
    q = lambda p, n: F.round(F.percentile("a", p), 6).alias(n)
    return areas.groupBy(*by).agg(F.count("*").alias("samples"), q(0.025, "low"), q(0.5, "median"), q(0.975, "high"))


def on_grid(points: DataFrame, by: list[str], x: str, y: str, steps: int = 1000) -> DataFrame:
    """A curve's value at ``steps`` equal distances from 0 to 1, linear between its points and held flat beyond the ends.

    Each point serves the grid places up to the next one, so the join is an explosion of intervals.
    """
    best = points.groupBy(*by, x).agg(F.max(y).alias(y))
    dealt = ranged(best, by, F.col(x))
    # the next point is in the same range, or it is the first one of the next
    local = Window.partitionBy(PART, *by).orderBy(x)
    heads = dealt.groupBy(PART, *by).agg(F.min(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).alias("_h"))
    over = Window.partitionBy(*by).orderBy(PART)
    beyond = heads.select(PART, *by, F.lead("_h").over(over).alias("_next"), F.lag("_h").over(over).isNull().alias("_front"))
    ahead = dealt.withColumn("_ahead", F.lead(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).over(local)).withColumn("_i", F.row_number().over(local))
    joined = with_group(ahead, beyond, [PART, *by]).withColumn("_to", F.coalesce("_ahead", "_next"))
    ends = joined.select(*by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.col("_to.x").alias("x1"), F.col("_to.y").alias("y1"), (F.col("_front") & (F.col("_i") == 1)).alias("i"))
    first = F.when(F.col("i"), F.lit(0)).otherwise(F.ceil(F.col("x0") * (steps - 1)))
    last = F.when(F.col("x1").isNull(), F.lit(steps - 1)).otherwise(F.ceil(F.col("x1") * (steps - 1)) - 1)
    placed = ends.filter(last >= first).withColumn("step", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    at = F.col("step") / float(steps - 1)
    value = F.when(F.col("x1").isNull() | (at <= F.col("x0")), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (at - F.col("x0")) / (F.col("x1") - F.col("x0")))
    return placed.select(*by, "step", F.round(value, 6).alias(y))
