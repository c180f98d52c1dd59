"""Plans of the predictor-evaluation operators, over labelled documents."""

from pyspark.sql import functions as F

from juncture.operators import evaluation as E
from juncture.plans.registry import query

PREDS = ["pred_a", "pred_b"]

_LONG = " union all ".join(
    f"select doc_id, category, truth, '{p}' as pred, '{f}' as form, {e.format(p)} + 0e0 as score from fx_eval"
    for p in PREDS for f, e in (("raw", "{0}"), ("neg", "-{0}"), ("abs", "abs({0})")))


def points(keys="", src=_LONG):
    k = f"{keys}, " if keys else ""
    return f"""(select *, tp - p as tp0, fp - n as fp0 from (select *, sum(p) over w as tp, sum(n) over w as fp, sum(p) over (partition by {k}pred, form) as pp, sum(n) over (partition by {k}pred, form) as nn,
      lag(score) over (partition by {k}pred, form order by score) as low
      from (select {k}pred, form, score, count(*) filter (where truth) as p, count(*) filter (where not truth) as n from ({src}) group by {k}pred, form, score)
      window w as (partition by {k}pred, form order by score desc rows unbounded preceding)))"""


_ORDER = "case form when 'raw' then 1 when 'neg' then 2 else 3 end"


def best(src, value, keys=""):
    k = f"{keys}, " if keys else ""
    return f"(select * from (select *, row_number() over (partition by {k}pred order by {value} desc, {_ORDER}) as rk from {src}) where rk = 1)"


_AREA = f"""(select pred, form, sum(p / nullif(pp * 1e0, 0) * (tp / ((tp + fp) * 1e0) + case when tp0 + fp0 = 0 then 1 else tp0 / ((tp0 + fp0) * 1e0) end) / 2) as auc from {points()} group by pred, form)"""


@query("pr_curve", "pred:s form:s auc:d", f"select * from {best(_AREA, 'auc')}")
def _(t):
    return E.pr_curve(t("fx_eval"), "truth", PREDS)


_GROUPS = "select doc_id, truth, category as g, pred, form, score from ({0}) where form = 'raw' union all select doc_id, truth, 'Transcriptome', pred, form, score from ({0}) where form = 'raw'".format(_LONG)
_BAL = "(({x}) * (1 - r) / nullif(({x}) * (1 - r) + (1 - ({x})) * r, 0))"


@query("balanced_pr_curve", "group:s pred:s pr_auc:d",
       f"""select g as "group", pred, case when max(pp) >= 2 and max(nn) >= 2 then sum(p / (pp * 1e0) * ({_BAL.format(x='tp / ((tp + fp) * 1e0)')} + case when tp0 + fp0 = 0 then 1 else {_BAL.format(x='tp0 / ((tp0 + fp0) * 1e0)')} end) / 2) end as pr_auc
       from (select *, pp / ((pp + nn) * 1e0) as r from {points('g', _GROUPS)}) group by 1, 2""")
def _(t):
    return E.balanced_pr_curve(t("fx_eval"), "truth", PREDS, "category")


_ROWS = """(select *, row_number() over (partition by g order by md5(cast(doc_id as varchar)), doc_id) - 1 as idx, count(*) over (partition by g) as m from (
  select doc_id, truth, category as g, pred_a from fx_eval union all select doc_id, truth, 'Transcriptome', pred_a from fx_eval))"""
_DRAWN = f"""select g || '|' || b as gb, truth, 'pred_a' as pred, 'raw' as form, r.pred_a as score from (
  select g, m, b, d, (((m * 1000003 + b * 7919 + d * 104729) * 48271) % 2147483647) % m as idx from (select distinct g, m from {_ROWS}), (select unnest(range(20)) as b), lateral (select unnest(range(m)) as d)) x
  join {_ROWS} r using (g, idx)"""


@query("balanced_pr_bootstrap", "group:s pred:s mean:d low:d high:d",
       f"""select split_part(gb, '|', 1) as "group", pred, avg(a) as mean, quantile_cont(a, 0.025) as low, quantile_cont(a, 0.975) as high from (
       select gb, pred, case when max(pp) >= 2 and max(nn) >= 2 then sum(p / nullif(pp * 1e0, 0) * ({_BAL.format(x='tp / ((tp + fp) * 1e0)')} + case when tp0 + fp0 = 0 then 1 else {_BAL.format(x='tp0 / ((tp0 + fp0) * 1e0)')} end) / 2) end as a
       from (select *, pp / ((pp + nn) * 1e0) as r from {points('gb', _DRAWN)}) group by 1, 2) group by 1, 2""")
def _(t):
    from juncture.operators.statistics import arithmetic_draw

    return E.balanced_pr_bootstrap(t("fx_eval"), "truth", "pred_a", "category", "doc_id", bootstraps=20, draw=arithmetic_draw)


_ROC = f"""(select category, pred, form, sum(n / nullif(nn * 1e0, 0) * (tp / nullif(pp * 1e0, 0) + tp0 / nullif(pp * 1e0, 0)) / 2) as auc,
   case when max(tp / nullif(pp * 1e0, 0) - fp / nullif(nn * 1e0, 0)) > 0 then arg_max(score, row(tp / nullif(pp * 1e0, 0) - fp / nullif(nn * 1e0, 0), score)) end as youden from {points('category')} group by category, pred, form)"""


@query("roc_curve", "category:s pred:s form:s auc:d youden:d", f"select * from {best(_ROC, 'auc', 'category')}")
def _(t):
    return E.roc_curve(t("fx_eval"), "truth", PREDS, "category")


@query("youden_summary", "pred:s mean:d median:d std:d missing:i n:i error:d",
       f"""select pred, avg(y) as mean, median(y) as median, stddev_samp(y) as std, count(*) filter (where y is null) as missing, count(*) as n, stddev_samp(y) / sqrt(count(*)) as error
       from (select pred, case when category = 'de' then null else youden end as y from {best(_ROC, 'auc', 'category')} where category <> 'es') group by pred""")
def _(t):
    roc = E.roc_curve(t("fx_eval"), "truth", PREDS, "category")
    data = roc.withColumn("data", F.when(F.col("category") == "es", "standard").otherwise(F.col("category")))
    return E.youden_summary(data.withColumn("youden", F.when(F.col("category") != "de", F.col("youden"))), "youden", "pred")


def _threshold_sql(score, name):
    pts = f"(select *, (score + low) / 2 as t, case form when 'neg' then -(score + low) / 2 else (score + low) / 2 end as k, coalesce({score}, 0) as s, tp + fp <= (select count(*) from fx_eval where truth) as few from {points()} where low is not null)"
    top = f"(select * from (select *, row_number() over (partition by pred, form order by s desc, k) as r1 from {pts}) where r1 = 1)"
    prop = f"(select * from (select *, row_number() over (partition by pred, form order by case when few then 0 else 1 end, case when few then k else -k end) as r1 from {pts}) where r1 = 1)"
    return f"""select a.pred, a.form, a.s as {name}, a.t as threshold, b.form as prop_form, b.s as prop_{name}, b.t as prop_threshold
      from {best(top, 's')} a join {best(prop, 's')} b on a.pred = b.pred"""


@query("f1_best", "pred:s form:s f1:d threshold:d prop_form:s prop_f1:d prop_threshold:d", _threshold_sql("(tp * 2) / nullif((tp * 2 + fp + (pp - tp)) * 1e0, 0)", "f1"))
def _(t):
    return E.f1_best(t("fx_eval"), "truth", PREDS)


@query("mcc_best", "pred:s form:s mcc:d threshold:d prop_form:s prop_mcc:d prop_threshold:d",
       _threshold_sql("(tp * 1e0 * (nn - fp) - fp * 1e0 * (pp - tp)) / nullif(sqrt((tp + fp) * 1e0 * pp * nn * ((nn - fp) + (pp - tp))), 0)", "mcc"))
def _(t):
    return E.mcc_best(t("fx_eval"), "truth", PREDS)


_WITH_Y = "(select doc_id, pred_a, case when doc_id % 7 = 0 then null else pred_b end as pred_b, cast(doc_id * 31 % 1000 as double) + pred_a / 50 as y from fx_eval)"


def _y(t):
    return t("fx_eval").selectExpr("doc_id", "pred_a", "case when doc_id % 7 = 0 then null else pred_b end as pred_b", "cast(doc_id * 31 % 1000 as double) + pred_a / 50 as y")


@query("pearson", "pred:s raw:d abs:d best:d",
       f"""select *, greatest(raw, abs) as best from ({' union all '.join(f"select '{p}' as pred, abs(corr(y, {p})) as raw, abs(corr(y, abs({p}))) as abs from {_WITH_Y} where {p} is not null" for p in PREDS)})""")
def _(t):
    return E.pearson(_y(t), "y", PREDS)


def _spear(p, e):
    return f"""(select abs(corr(rx, ry)) from (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2e0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2e0 as ry
      from (select {e} as x, y from {_WITH_Y} where {p} is not null)))"""


@query("spearman", "pred:s raw:d abs:d best:d",
       f"""select *, greatest(raw, abs) as best from ({' union all '.join(f"select '{p}' as pred, {_spear(p, p)} as raw, {_spear(p, f'abs({p})')} as abs" for p in PREDS)})""")
def _(t):
    return E.spearman(_y(t), "y", PREDS)


_RANKS = "(select truth, pred_b as score, row_number() over (partition by truth order by pred_b desc) - 1 as i, count(*) over (partition by truth) as total from fx_eval)"


@query("rank_curve", "truth:b score:d n:i rank:i rank_share:d value_at_20:d area_high:d area_low:d difference:d",
       f"""with c as (select truth, score, count(*) as n, min(i) as rank, min(i) / ((max(total) - 1) * 1e0) as rank_share from {_RANKS} group by truth, score),
       a as (select truth, sum((y + y2) / 2 / (total - 1)) as area from (select truth, score as y, lead(score) over (partition by truth order by i) as y2, total from {_RANKS}) where y2 is not null group by truth),
       v as (select score as value_at_20 from (select pred_b as score, row_number() over (order by pred_b desc) - 1 as i, count(*) over () as n from fx_eval) where i = cast(floor(n * 20 * 0.01) as bigint))
       select c.*, value_at_20, h.area as area_high, l.area as area_low, h.area - l.area as difference from c, v, (select area from a where truth) h, (select area from a where not truth) l""")
def _(t):
    from juncture.functions.columns import attach

    ev = t("fx_eval")
    curve = E.rank_curve(ev, "pred_b", "truth")
    area = E.rank_curve_area(ev.withColumn("truth", F.col("truth").cast("string")), "pred_b", "truth", "true", "false")
    return attach(attach(curve, E.value_at_percentile(ev, "pred_b", 20).withColumnRenamed("score", "value_at_20")), area)
