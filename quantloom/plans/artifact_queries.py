"""Cleaning chains, models that are kept, and what is read back from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators import calendar as C
from ..operators import ml as L
from ..operators.artifacts import Trained
from ..operators.cleaning import chain
from ..sources.panel import month_panel
from ..sources.store import kept_in
from .registry import query, r

FEATURES = ("ret_0", "turnover_0")
FUZZY = (0.1, 2.0)
SPLIT = 48


_LABELLED: dict = {}


def labelled(spark, sf):
    """ticker, trade_date, date_idx, features, and the forward return less its date's mean in percent. Cached for the session: each fit reads it several times."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LABELLED:
        _LABELLED[key] = L.samples(month_panel(spark, sf), ["ret", "turnover"])[0].withColumn("y", 100 * F.col("y")).cache()
    return _LABELLED[key]


LABELLED = "y0 as (select *, lead(vwap, 2) over w / nullif(lead(vwap) over w, 0) - 1 as y0 from panel window w as (partition by ticker order by date_idx)), f as (select ticker, trade_date, date_idx, ret as x1, turnover as x2, 100 * (y0 - avg(y0) over (partition by trade_date)) as y from y0)"


def cleaned(train: str, by: str) -> str:
    """SQL of the chain over rows ``s`` (f with ``k``, the split, and ``is_train``): bounds of each split come from its training rows."""
    x = lambda c: f"least(greatest({c}, m{c} - 2.5 * w{c}), m{c} + 2.5 * w{c})"  # noqa: E731  null becomes a bound, so it is tested first
    clipped = lambda c: f"case when {c} is null or (is_train and abs({c} - m{c}) > 4 * w{c}) then null else {x(c)} end as c{c}"
    return f"""s as ({train}), fz as (select {by}, avg(y) as my, stddev_samp(y) as sy from s where is_train and abs(y) >= {FUZZY[0]} group by all),
q as (select {by}, {', '.join(f'quantile_cont({c}, 0.5) as m{c}, quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1) as w{c}' for c in ('x1', 'x2'))} from s where is_train group by all),
c0 as (select s.{by}, ticker, trade_date, date_idx, is_train, {clipped('x1')}, {clipped('x2')}, case when not is_train or (abs(y) >= {FUZZY[0]} and abs(y - my) <= {FUZZY[1]} * sy) then y end as y from s join fz using ({by}) join q using ({by})),
c as (select {by}, ticker, trade_date, date_idx, is_train, coalesce(cx1, 0) as x1, coalesce(cx2, 0) as x2, case when (cx1 is null)::int + (cx2 is null)::int <= 0.3 * 2 then y end as y from c0)"""


CLEAN = f"with {LABELLED}, {cleaned(f'select 0 as k, *, date_idx < {SPLIT} as is_train from f', 'k')}"


def clean(spark, sf, **options):
    data = labelled(spark, sf).withColumn("is_train", F.col("date_idx") < SPLIT)
    return chain(list(FEATURES), fuzzy=FUZZY, **options).fit(data).transform(data)


@query("clean_matrix", f"{CLEAN} select ticker, trade_date, is_train, {r('x1')} as ret_0, {r('x2')} as turnover_0, {r('y')} as y from c where not is_train or y is not null")
def clean_matrix(spark, sf):
    return clean(spark, sf).select("ticker", "trade_date", "is_train", *[r6(c).alias(c) for c in (*FEATURES, "y")])


@query("clean_classes", f"with {LABELLED}, q as (select {', '.join(f'quantile_cont({c}, 0.5) as m{c}, quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1) as w{c}' for c in ('x1', 'x2'))} from f where date_idx < {SPLIT}), n as (select ticker, trade_date, date_idx < {SPLIT} as is_train, y, {', '.join(f'case when {c} is null or (date_idx < {SPLIT} and abs({c} - m{c}) > 4 * w{c}) then null else (least(greatest({c}, m{c} - 2.5 * w{c}), m{c} + 2.5 * w{c}) - m{c}) / (w{c} + 1e-7) end as n{c}' for c in ('x1', 'x2'))} from f cross join q), l as (select *, case when (nx1 is null)::int + (nx2 is null)::int <= 0.6 then (y > 0)::int::double end as up from n) select ticker, trade_date, is_train, {r('nx1')} as ret_0, {r('nx2')} as turnover_0, up as y from l where not is_train or up is not null")
def clean_classes(spark, sf):
    data = labelled(spark, sf).withColumn("is_train", F.col("date_idx") < SPLIT)
    got = chain(list(FEATURES), classes=True, fuzzy=None, normalize=True, fill="ignore").fit(data).transform(data)
    return got.select("ticker", "trade_date", "is_train", *[r6(c).alias(c) for c in FEATURES], "y")


def windows(spark, sf):
    n = month_panel(spark, sf).select("date_idx").distinct().count()
    return list(C.walk_forward(n, 36, 12, 12, 1))


def trained(spark, sf) -> tuple[Trained, list]:
    """The linear models of all windows; what was saved before isn't fitted again."""
    models, split = Trained(spark, kept_in(spark, sf), "lr_36_12_12", "linear", FEATURES), windows(spark, sf)
    models.train(labelled(spark, sf), split, fuzzy=FUZZY)
    return models, split


SPLITS = "win as (select k, k * 12 as lo, k * 12 + 35 as hi, k * 12 + 37 as tlo, least(k * 12 + 48, n - 1) as thi from (select unnest(range(0, 100)) as k) cross join (select count(*) as n from cal) where k * 12 + 37 < n)"
#: Two unknowns after the means are taken off.
FITTED = f"""with {LABELLED}, {SPLITS}, {cleaned('select k, f.*, date_idx <= hi as is_train from f join win on date_idx between lo and hi or date_idx between tlo and thi', 'k')},
v as (select k, avg(y) as my, avg(x1) as m1, avg(x2) as m2, var_pop(x1) as s11, var_pop(x2) as s22, covar_pop(x1, x2) as s12, covar_pop(x1, y) as s1y, covar_pop(x2, y) as s2y from c where is_train and y is not null group by k),
b as (select *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) as b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) as b2 from v)"""
PREDICTED = f"{FITTED} select cast(k as integer) as window_id, ticker, trade_date, {r('my - b1 * m1 - b2 * m2 + b1 * x1 + b2 * x2')} as value from c join b using (k) where not is_train"


@query("predictions_loaded", PREDICTED)
def predictions_loaded(spark, sf):
    models, split = trained(spark, sf)
    return models.predict(labelled(spark, sf), split).withColumn("value", r6("value"))


@query("prediction_feature", PREDICTED)
def prediction_feature(spark, sf):
    return trained(spark, sf)[0].feature().select("window_id", "ticker", "trade_date", r6("value").alias("value"))


@query("coefficients_kept", f"{FITTED} select cast(k as integer) as window_id, 'ret_0' as feature, {r('b1')} as coefficient from b union all select cast(k as integer), 'turnover_0', {r('b2')} from b union all select cast(k as integer), '(intercept)', {r('my - b1 * m1 - b2 * m2')} from b")
def coefficients_kept(spark, sf):
    models = trained(spark, sf)[0]
    return models.store.read("coefficient", name=models.name).select("window_id", "feature", r6("coefficient").alias("coefficient"))
