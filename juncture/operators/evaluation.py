"""How well predictors agree with measured truth.

Every curve is built from the histogram of distinct scores with running totals (see
:mod:`juncture.operators.ordering`), for each predictor and each of its three forms in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juncture.functions.columns import attach, ratio
from juncture.operators.ordering import beside, exact_quantiles, with_running

FORMS = ["raw", "neg", "abs"]


def score_histogram(df: DataFrame, truth: str, preds: list[str], keys: list[str] | None = None, forms: list[str] = FORMS) -> DataFrame:
    """Positives and negatives per distinct score of each predictor and form; missing pairs dropped.

    Rows are counted once, by their raw score; the other forms follow from that histogram.
    """
    keys = keys or []
    cells = F.array(*[F.struct(F.lit(p).alias("pred"), F.col(p).cast("double").alias("score")) for p in preds])
    long = df.filter(F.col(truth).isNotNull()).select(*keys, F.col(truth).alias("_t"), F.explode(cells).alias("c"))
    long = long.filter(F.col("c.score").isNotNull()).withColumn("score", F.col("c.score") + 0.0)
    raw = long.groupBy(*keys, F.col("c.pred").alias("pred"), "score").agg(
        F.sum(F.when(F.col("_t"), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("_t"), 0).otherwise(1)).alias("n")
    )
    make = {"raw": lambda c: c, "neg": lambda c: -c, "abs": F.abs}
    each = F.array(*[F.struct(F.lit(f).alias("form"), (make[f](F.col("score")) + 0.0).alias("score")) for f in forms])
    formed = raw.select(*keys, "pred", F.explode(each).alias("f"), "p", "n").select(*keys, "pred", "f.form", "f.score", "p", "n")
    return formed.groupBy(*keys, "pred", "form", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def _with_totals(hist: DataFrame, keys: list[str], below: str | None = None) -> DataFrame:
    on = [*keys, "pred", "form"]
    run = with_running(hist, "score", {"p": "tp", "n": "fp"}, on, below=below)
    total = hist.groupBy(*on).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    return run.join(total, on)


def _best(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The form with the largest value; the first of raw, neg, abs on a tie."""
    rank = F.array_position(F.array(*[F.lit(f) for f in FORMS]), F.col("form"))
    other = [c for c in df.columns if c not in (*keys, "pred", value)]
    top = F.max(F.struct(F.col(value), (-rank).alias("_r"), *[F.col(c) for c in other])).alias("_m")
    return df.groupBy(*keys, "pred").agg(top).select(*keys, "pred", f"_m.{value}", *[f"_m.{c}" for c in other])


def pr_points(df: DataFrame, truth: str, preds: list[str], keys: list[str] | None = None, forms: list[str] = FORMS) -> DataFrame:
    """Precision and recall at every distinct score."""
    run = _with_totals(score_histogram(df, truth, preds, keys, forms), keys or [])
    return run.withColumns({"precision": ratio("tp", F.col("tp") + F.col("fp")), "recall": ratio("tp", "positives")})


def _pr_area(run: DataFrame, keys: list[str], rescale=lambda precision: precision) -> DataFrame:
    """Trapezoid area; the point before a score follows from its own counts, the curve starts at (0, 1)."""
    tp0, fp0 = F.col("tp") - F.col("p"), F.col("fp") - F.col("n")
    here = rescale(ratio("tp", F.col("tp") + F.col("fp")))
    before = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(rescale(ratio(tp0, tp0 + fp0)))
    return run.groupBy(*keys, "pred", "form").agg(F.sum(ratio("p", "positives") * (here + before) / 2).alias("auc"), F.max("positives").alias("positives"), F.max("negatives").alias("negatives"))


def pr_curve(df: DataFrame, truth: str, preds: list[str]) -> DataFrame:
    """Area under the precision-recall curve, best of the raw, negated and absolute score."""
    run = _with_totals(score_histogram(df, truth, preds), [])
    return _best(_pr_area(run, []).drop("positives", "negatives"), [], "auc")


def balanced_pr_curve(df: DataFrame, truth: str, preds: list[str], category: str, whole: str = "Transcriptome", by: list[str] | None = None) -> DataFrame:
    """Area with precision rescaled to even classes, per category and over all of them.

    Empty where either class has fewer than two rows.
    """
    keys = [*(by or []), "group"]
    rows = df.withColumn("group", F.explode(F.array(F.col(category), F.lit(whole)))).filter(F.col("group").isNotNull())
    return _balanced_area(score_histogram(rows, truth, preds, keys, ["raw"]), keys)


def _balanced_area(hist: DataFrame, keys: list[str]) -> DataFrame:
    run = _with_totals(hist, keys)
    prior = ratio("positives", F.col("positives") + F.col("negatives"))

    def rescale(p: Column) -> Column:
        return ratio(p * (1 - prior), p * (1 - prior) + (1 - p) * prior)

    area = _pr_area(run, keys, rescale)
    enough = (F.col("positives") >= 2) & (F.col("negatives") >= 2)
    return area.select(*keys, "pred", F.when(enough, F.col("auc")).alias("pr_auc"))


def balanced_pr_bootstrap(
    df: DataFrame, truth: str, pred: str, category: str, key: str, bootstraps: int = 100, seed: int = 1124, whole: str = "Transcriptome", draw=None
) -> DataFrame:
    """Mean and 95% interval of the balanced area over resamples of each category.

    ``draw`` picks a row as in :func:`juncture.operators.statistics.bootstrap_null_by_count`.  The histograms of the
    resamples are written once to the shared folder: the running totals read them several times, and each time the
    whole resampling, with the broadcasts of the caller's joins, would be planned and run again.
    """
    from juncture.operators.statistics import hashed_draw, index_rows
    from juncture.sources.sinks import explode_range, write_once

    rows = df.withColumn("group", F.explode(F.array(F.col(category), F.lit(whole))))
    rows = rows.filter(F.col("group").isNotNull() & F.col(truth).isNotNull() & F.col(pred).isNotNull())
    rows = rows.select("group", F.col(key).cast("string").alias("_k"), truth, pred)
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("m"))
    grid = explode_range(sizes.withColumns({"_lo": F.lit(0), "_hi": F.lit(bootstraps - 1)}), "_lo", "_hi", "b").repartition(bootstraps, "group", "b")
    grid = explode_range(grid.withColumn("_hi", (F.col("m") - 1).cast("int")), "_lo", "_hi", "d").drop("_lo", "_hi")
    drawn = grid.withColumn("idx", (draw or hashed_draw(seed))(F.col("m"), F.col("b"), F.col("d"), F.col("m")))
    # the draws stand behind a table of one row per group, whose size is all that Catalyst sees of them: left to it, they are broadcast
    sample = drawn.hint("merge").join(index_rows(rows, "_k", ["group"]), ["group", "idx"])
    hist = write_once(score_histogram(sample, truth, [pred], ["group", "b"], ["raw"]), "resampled")
    area = _balanced_area(hist, ["group", "b"])
    return area.groupBy("group", "pred").agg(
        F.avg("pr_auc").alias("mean"),
        F.percentile("pr_auc", F.lit(0.025)).alias("low"),
        F.percentile("pr_auc", F.lit(0.975)).alias("high"),
    )


def roc_curve(df: DataFrame, truth: str, preds: list[str], category: str | None = None) -> DataFrame:
    """Area under the ROC curve and the threshold of the largest TPR - FPR, best of three forms.

    The highest threshold wins a tie.
    """
    keys = [category] if category else []
    run = _with_totals(score_histogram(df, truth, preds, keys), keys)
    tpr, fpr = ratio("tp", "positives"), ratio("fp", "negatives")
    before = ratio(F.col("tp") - F.col("p"), "positives")
    out = run.groupBy(*keys, "pred", "form").agg(
        F.sum(ratio("n", "negatives") * (tpr + before) / 2).alias("auc"),
        F.max(F.struct((tpr - fpr).alias("j"), F.col("score"))).alias("_y"),
    )
    # before the first threshold the difference is zero
    youden = F.when(F.col("_y.j") > 0, F.col("_y.score"))
    return _best(out.withColumn("youden", youden).drop("_y"), keys, "auc")


def youden_summary(df: DataFrame, value: str, tool: str = "tool", data: str = "data") -> DataFrame:
    """Spread of the best thresholds of each tool over the measured data sets."""
    rows = df.filter(F.col(data) != "standard")
    out = rows.groupBy(tool).agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.count_if(F.col(value).isNull()).alias("missing"),
        F.count(F.lit(1)).alias("n"),
    )
    out = beside(out, exact_quantiles(rows, [tool], {"median": F.col(value)}), [tool])
    return out.withColumn("error", F.col("std") / F.sqrt("n"))


def _best_threshold(df: DataFrame, truth: str, preds: list[str], score: Column, name: str) -> DataFrame:
    """Largest score over midpoints of neighbouring values, and the score at the first midpoint
    that calls no more positives than the truth has.

    Midpoints of the raw and absolute forms run upwards, those of the negated form downwards; the
    first one wins a tie.
    """
    run = _with_totals(score_histogram(df, truth, preds), [], below="_low").filter(F.col("_low").isNotNull())
    events = df.filter(F.col(truth)).agg(F.count(F.lit(1)).alias("_e"))
    run = attach(run, events)
    mid = (F.col("score") + F.col("_low")) / 2
    place = F.when(F.col("form") == "neg", -mid).otherwise(mid)
    run = run.select("pred", "form", mid.alias("t"), place.alias("k"), score.alias("s"), (F.col("tp") + F.col("fp") <= F.col("_e")).alias("few"))
    out = run.groupBy("pred", "form").agg(
        F.max(F.struct("s", (-F.col("k")).alias("k"), "t")).alias("_m"),
        F.min(F.when(F.col("few"), F.struct("k", "s", "t"))).alias("_p"),
        F.max(F.struct("k", "s", "t")).alias("_l"),
    )
    prop = F.coalesce("_p", "_l")
    best = _best(out.select("pred", "form", F.col("_m.s").alias(name), F.col("_m.t").alias("threshold")), [], name)
    fair = _best(out.select("pred", "form", prop["s"].alias(f"prop_{name}"), prop["t"].alias("prop_threshold")), [], f"prop_{name}")
    return best.join(fair.withColumnRenamed("form", "prop_form"), "pred")


def f1_best(df: DataFrame, truth: str, preds: list[str]) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("positives") - F.col("tp")
    return _best_threshold(df, truth, preds, F.coalesce(ratio(tp * 2, tp * 2 + fp + fn), F.lit(0.0)), "f1")


def mcc_best(df: DataFrame, truth: str, preds: list[str]) -> DataFrame:
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    fn, tn = F.col("positives") - tp, F.col("negatives") - fp
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return _best_threshold(df, truth, preds, F.coalesce(ratio(tp * tn - fp * fn, root), F.lit(0.0)), "mcc")


def pearson(df: DataFrame, y: str, preds: list[str]) -> DataFrame:
    """Absolute correlation with the raw and the absolute predictor, and the larger one."""
    cells = F.array(
        *[
            F.struct(F.lit(p).alias("pred"), F.abs(F.corr(y, p)).alias("raw"), F.abs(F.corr(F.when(F.col(p).isNotNull(), F.col(y)), F.abs(p))).alias("abs"))
            for p in preds
        ]
    )
    out = df.agg(cells.alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return out.withColumn("best", F.greatest("raw", "abs"))


def _average_ranks(pairs: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    hist = pairs.groupBy(*keys, value).agg(F.sum("c").alias("n"))
    run = with_running(hist, value, {"n": "cn"}, keys, descending=False)
    return run.select(*keys, value, (F.col("cn") - F.col("n") + (F.col("n") + 1) / 2).alias(out))


def spearman(df: DataFrame, y: str, preds: list[str]) -> DataFrame:
    """The same on average ranks.

    Equal pairs are counted first, so the ranks join to distinct pairs and the correlation is a
    weighted sum around the known mean rank.
    """
    cells = F.array(
        *[F.struct(F.lit(p).alias("pred"), F.lit(f).alias("form"), fn(F.col(p).cast("double")).alias("x")) for p in preds for f, fn in (("raw", lambda c: c), ("abs", F.abs))]
    )
    keys = ["pred", "form"]
    pairs = df.filter(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("y"), F.explode(cells).alias("c"))
    pairs = pairs.filter(F.col("c.x").isNotNull()).groupBy("c.pred", "c.form", "c.x", "y").agg(F.count(F.lit(1)).alias("c"))
    rx, ry = _average_ranks(pairs, "x", keys, "rx"), _average_ranks(pairs, "y", keys, "ry")
    size = pairs.groupBy(*keys).agg(((F.sum("c") + 1) / 2).alias("mid"))
    rows = pairs.join(rx, [*keys, "x"]).join(ry, [*keys, "y"]).join(size, keys)
    dx, dy = F.col("rx") - F.col("mid"), F.col("ry") - F.col("mid")
    c = F.col("c")
    r = ratio(F.sum(c * dx * dy), F.sqrt(F.sum(c * dx * dx) * F.sum(c * dy * dy)))
    per = rows.groupBy(*keys).agg(F.abs(r).alias("r"))
    out = per.groupBy("pred").agg(*[F.max(F.when(F.col("form") == f, F.col("r"))).alias(f) for f in ("raw", "abs")])
    return out.withColumn("best", F.greatest("raw", "abs"))


def rank_curve(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """Scores, of each class if there is one, from the largest down: rank of the first row of each tie, and its size."""
    keys = [by] if by else []
    hist = df.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    run = with_running(hist, "score", {"n": "cn"}, keys)
    total = hist.groupBy(*keys).agg(F.sum("n").alias("total"))
    out = run.join(total, keys) if keys else attach(run, total)
    out = out.withColumn("rank", F.col("cn") - F.col("n"))
    return out.withColumn("rank_share", ratio("rank", F.col("total") - 1)).drop("cn")


def value_at_percentile(df: DataFrame, col: str, percentile: float) -> DataFrame:
    """The score that calls the given percent of the rows."""
    curve = rank_curve(df, col)
    k = F.floor(F.col("total") * percentile * 0.01)
    return curve.filter((F.col("rank") <= k) & (k < F.col("rank") + F.col("n"))).select("score")


def rank_curve_area(df: DataFrame, col: str, by: str, high: str, low: str) -> DataFrame:
    """Area under each class's curve over ranks scaled to [0, 1], and the difference of two classes.

    Evenly spaced points make the trapezoid rule a closed form of the sum and the two ends.
    """
    rows = df.filter(F.col(col).isNotNull())
    n = F.count(F.lit(1))
    area = ratio(F.sum(col) - (F.max(col) + F.min(col)) / 2, n - 1)
    per = rows.groupBy(by).agg(F.when(n >= 2, area).alias("area"))
    return per.agg(
        F.max(F.when(F.col(by) == high, F.col("area"))).alias("area_high"), F.max(F.when(F.col(by) == low, F.col("area"))).alias("area_low")
    ).withColumn("difference", F.col("area_high") - F.col("area_low"))
