"""Rolling windows and ordered operations (inventory §2.5), sorts and top-k (§2.6), time and centred windows (§2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.sort import ranked
from .registry import EVENTS, add, events, rounded

E = EVENTS
OVER = "OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
GLOBAL = "OVER (ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
#: SQL of a rolling function of {c}, and the least number of known values it needs whatever min_periods is.
ROLLING = {
    "sum": ("sum({c}) {o}", 0), "mean": ("avg({c}) {o}", 1), "min": ("min({c}) {o}", 1), "max": ("max({c}) {o}", 1), "var": ("var_samp({c}) {o}", 2), "std": ("stddev_samp({c}) {o}", 2),
    "skew": ("skewness({c}) {o}", 3), "kurt": ("kurtosis({c}) {o}", 4), "median": ("median({c}) {o}", 1),
}
IDS = {"sum": ("OP-123", "OP-138"), "mean": ("OP-124", "OP-139"), "min": ("OP-126", "OP-141"), "max": ("OP-127", "OP-142"), "var": ("OP-128", "OP-143"), "std": ("OP-129", "OP-144"), "skew": ("OP-130", "OP-145"), "kurt": ("OP-131", "OP-146"), "median": ("OP-132", "OP-147")}


#: Digits that results are rounded to: more than the exact results of these functions can have, so that none is a tie.
DIGITS = {"mean": 6, "var": 7}


def guarded(name: str, c: str, over: str, least: int) -> str:
    e, need = ROLLING[name]
    return f"CASE WHEN count({c}) {over} >= {max(least, need)} THEN round({e.format(c=c, o=over)}, {DIGITS.get(name, 4)}) END"


for name, (one, both) in IDS.items():
    add(f"roll_{name}", f"OP-122 {one}", lambda s, d, name=name: rounded(getattr(events(s, d)["v"].rolling(10, 4), name)().spark(), DIGITS.get(name, 4)), f"SELECT event_id, {guarded(name, 'v', OVER, 4)} AS v FROM {E}")
    add(f"roll_frame_{name}", both, lambda s, d, name=name: rounded(getattr(events(s, d)[["v", "w"]].rolling(10, 4), name)().spark(), DIGITS.get(name, 4)), f"SELECT event_id, {guarded(name, 'v', OVER, 4)} AS v, {guarded(name, 'w', OVER, 4)} AS w FROM {E}")

add("roll_full_periods", "OP-122", lambda s, d: rounded(events(s, d)["value"].rolling(10).mean().spark(), 6), f"SELECT event_id, CASE WHEN count(value) {OVER} >= 10 THEN round(avg(value) {OVER}, 6) END AS value FROM events")
add("roll_sum_no_periods", "OP-123", lambda s, d: rounded(events(s, d)["v"].rolling(3, 0).sum().spark(), 4), f"SELECT event_id, round(coalesce(sum(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0), 4) AS v FROM {E}")
ROWS_SO_FAR = "row_number() OVER (PARTITION BY user_id ORDER BY event_id)"
add("roll_count", "OP-125", lambda s, d: events(s, d)["v"].rolling(10, 4).count().spark(), f"SELECT event_id, CASE WHEN {ROWS_SO_FAR} >= 4 THEN CAST(count(v) {OVER} AS DOUBLE) END AS v FROM {E}")
add("roll_frame_count", "OP-140", lambda s, d: events(s, d)[["v", "w"]].rolling(10, 4).count().spark(), f"SELECT event_id, CASE WHEN {ROWS_SO_FAR} >= 4 THEN CAST(count(v) {OVER} AS DOUBLE) END AS v, CASE WHEN {ROWS_SO_FAR} >= 4 THEN CAST(count(w) {OVER} AS DOUBLE) END AS w FROM {E}")
add("roll_quantile", "OP-133", lambda s, d: rounded(events(s, d)["v"].rolling(10, 4).quantile(0.25).spark(), 4), f"SELECT event_id, CASE WHEN count(v) {OVER} >= 4 THEN round(quantile_cont(v, 0.25) {OVER}, 4) END AS v FROM {E}")
add("roll_frame_quantile", "OP-148", lambda s, d: rounded(events(s, d)[["v", "w"]].rolling(10, 4).quantile(0.9).spark(), 4), f"SELECT event_id, CASE WHEN count(v) {OVER} >= 4 THEN round(quantile_cont(v, 0.9) {OVER}, 4) END AS v, CASE WHEN count(w) {OVER} >= 4 THEN round(quantile_cont(w::DOUBLE, 0.9) {OVER}, 4) END AS w FROM {E}")
add("roll_var_ddof0", "OP-128", lambda s, d: rounded(events(s, d)["v"].rolling(10, 4).var(ddof=0).spark(), 8), f"SELECT event_id, CASE WHEN count(v) {OVER} >= 4 THEN round(var_pop(v) {OVER}, 8) END AS v FROM {E}")
PAIR = f"(SELECT event_id, user_id, CASE WHEN w IS NOT NULL THEN v END AS x, CASE WHEN v IS NOT NULL THEN w END AS y FROM {E})"
add("roll_corr", "OP-134", lambda s, d: rounded(events(s, d)[["v", "w"]].rolling(10, 4)["v"].corr("w").spark(), 4), f"SELECT event_id, CASE WHEN count(x) {OVER} >= 4 AND min(x) {OVER} < max(x) {OVER} AND min(y) {OVER} < max(y) {OVER} THEN round(corr(x, y) {OVER}, 4) END AS v FROM {PAIR}")
add("roll_cov", "OP-135 OP-136", lambda s, d: rounded(events(s, d)[["v", "w"]].rolling(10, 4)["v"].cov("w").spark(), 6), f"SELECT event_id, CASE WHEN count(x) {OVER} >= 4 THEN round(covar_samp(x, y) {OVER}, 6) END AS v FROM {PAIR}")
add("roll_frame_corr", "OP-149", lambda s, d: rounded((lambda f: f[["v", "w"]].rolling(10, 4).corr(f[["v", "value"]]).spark())(events(s, d)), 4), f"SELECT event_id, CASE WHEN count(v) {OVER} >= 4 AND min(v) {OVER} < max(v) {OVER} THEN 1.0::DOUBLE END AS v, NULL::DOUBLE AS w, NULL::DOUBLE AS value FROM {E}")
add("roll_frame_cov", "OP-150", lambda s, d: rounded((lambda f: f[["v", "w"]].rolling(10, 4).cov(f[["v"]]).spark())(events(s, d)), 7), f"SELECT event_id, CASE WHEN count(v) {OVER} >= 4 THEN round(var_samp(v) {OVER}, 7) END AS v, NULL::DOUBLE AS w FROM {E}")
add("roll_apply", "OP-137 OP-235", lambda s, d: rounded(events(s, d)["v"].rolling(5, 2).apply(lambda x: float(x.max() - x.min())).spark(), 4), f"SELECT event_id, CASE WHEN count(v) {OVER.replace('9', '4')} >= 2 THEN round(max(v) {OVER.replace('9', '4')} - min(v) {OVER.replace('9', '4')}, 4) END AS v FROM {E}")
add("roll_frame_apply", "OP-151", lambda s, d: rounded(events(s, d)[["v", "w"]].rolling(5, 2).apply(lambda x: float(x.sum())).spark(), 4), f"SELECT event_id, CASE WHEN count(v) {OVER.replace('9', '4')} >= 2 THEN round(sum(v) {OVER.replace('9', '4')}, 4) END AS v, CASE WHEN count(w) {OVER.replace('9', '4')} >= 2 THEN round((sum(w) {OVER.replace('9', '4')})::DOUBLE, 4) END AS w FROM {E}")
add("roll_global_mean", "OP-124 §7.4", lambda s, d: rounded(events(s, d, by=())["v"].rolling(10, 4).mean().spark(), 6), f"SELECT event_id, {guarded('mean', 'v', GLOBAL, 4)} AS v FROM {E}")
add("roll_center", "L15", lambda s, d: rounded(events(s, d)["v"].rolling(5, 2, center=True).mean().spark(), 6), f"SELECT event_id, CASE WHEN count(v) {{o}} >= 2 THEN round(avg(v) {{o}}, 6) END AS v FROM {E}".format(o="OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"))
add("roll_time", "L14", lambda s, d: rounded(events(s, d)[["v", "ts"]].rolling("2h", on="ts").sum().spark(), 4), f"SELECT event_id, CASE WHEN count(v) {{o}} >= 1 THEN round(sum(v) {{o}}, 4) END AS v FROM {E}".format(o="OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW)"))
add("roll_selection", "L16", lambda s, d: rounded(events(s, d)[["v", "w"]].rolling(10, 4)["v"].agg(["mean", "max"]).spark(), 6), f"SELECT event_id, {guarded('mean', 'v', OVER, 4)} AS v_mean, CASE WHEN count(v) {OVER} >= 4 THEN max(v) {OVER} END AS v_max FROM {E}")

U = "OVER (PARTITION BY user_id ORDER BY event_id)"
add("seq_shift", "OP-152", lambda s, d: events(s, d)["v"].shift(2).spark(), f"SELECT event_id, lag(v, 2) {U} AS v FROM {E}")
add("seq_shift_back", "OP-152", lambda s, d: events(s, d)["v"].shift(-1, 0.0).spark(), f"SELECT event_id, lead(v, 1, 0.0) {U} AS v FROM {E}")
add("seq_shift_global", "OP-152 §7.4", lambda s, d: events(s, d, by=())["v"].shift(3).spark(), f"SELECT event_id, lag(v, 3) OVER (ORDER BY event_id) AS v FROM {E}")
add("seq_cumsum", "OP-153", lambda s, d: rounded(events(s, d)["v"].cumsum().spark(), 4), f"SELECT event_id, CASE WHEN v IS NOT NULL THEN round(sum(v) {U}, 4) END AS v FROM {E}")
add("seq_cumsum_keepna", "OP-153", lambda s, d: rounded(events(s, d)["v"].cumsum(skipna=False).spark(), 4), f"SELECT event_id, CASE WHEN sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) {U} = 0 THEN round(sum(v) {U}, 4) END AS v FROM {E}")
add("seq_cumsum_global", "OP-153 §7.4", lambda s, d: rounded(events(s, d, by=())["v"].cumsum().spark(), 3), f"SELECT event_id, CASE WHEN v IS NOT NULL THEN round(sum(v) OVER (ORDER BY event_id), 3) END AS v FROM {E}")
CHANGE = "SELECT event_id, round(CASE WHEN b = 0 AND f = 0 THEN NULL ELSE f / b - 1 END, 4) AS v FROM (SELECT event_id, f, lag(f, {k}) {u} AS b FROM (SELECT event_id, user_id, {fill} AS f FROM {e}))"
add("seq_pct_change", "OP-154", lambda s, d: rounded(events(s, d)["v"].pct_change(2).spark(), 4), CHANGE.format(k=2, u=U, e=E, fill=f"last_value(v IGNORE NULLS) {U}"))
add("seq_pct_change_bfill", "OP-154", lambda s, d: rounded(events(s, d)["v"].pct_change(1, "bfill").spark(), 4), CHANGE.format(k=1, u=U, e=E, fill="first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"))
add("seq_pct_change_frame", "OP-100", lambda s, d: rounded(events(s, d)[["v", "value"]].pct_change(undefined=float("nan")).spark(), 4), f"SELECT event_id, round(f / lag(f) {U} - 1, 4) AS v, round(value / lag(value) {U} - 1, 4) AS value FROM (SELECT event_id, user_id, value, last_value(v IGNORE NULLS) {U} AS f FROM {E})")
add("seq_pct_change_global", "OP-154 §7.4", lambda s, d: rounded(events(s, d, by=())["v"].pct_change().spark(), 4), CHANGE.format(k=1, u="OVER (ORDER BY event_id)", e=E, fill="last_value(v IGNORE NULLS) OVER (ORDER BY event_id)"))
add("seq_argsort", "OP-155 OP-161 OP-162", lambda s, d: events(s, d)["v"].argsort().spark(), f"WITH k AS (SELECT event_id, v, row_number() OVER (ORDER BY event_id) - 1 AS n FROM {E} WHERE v IS NOT NULL), o AS (SELECT n, row_number() OVER (ORDER BY v, n) - 1 AS p FROM k) SELECT event_id, coalesce(o.n, -1) AS v FROM {E} LEFT JOIN k USING (event_id) LEFT JOIN o ON k.n = o.p")

# sorts
add("sort_values", "OP-156 OP-159 OP-160", lambda s, d: ranked(events(s, d)[["v"]].sort_values("v")).spark(), f"SELECT event_id, v, row_number() OVER (ORDER BY v NULLS LAST, event_id) - 1 AS rank FROM {E}")
add("sort_values_down", "OP-156", lambda s, d: ranked(events(s, d)[["v"]].sort_values("v", ascending=False, na_position="first")).spark(), f"SELECT event_id, v, row_number() OVER (ORDER BY v DESC NULLS FIRST, event_id) - 1 AS rank FROM {E}")
add("sort_strings", "OP-163", lambda s, d: ranked(events(s, d)[["event_type"]].sort_values("event_type")).spark(), "SELECT event_id, event_type, row_number() OVER (ORDER BY event_type, event_id) - 1 AS rank FROM events")
add("sort_frame", "OP-164 L22", lambda s, d: ranked(events(s, d)[["event_type", "value"]].sort_values(["event_type", "value"], [True, False])).spark(), "SELECT event_id, event_type, value, row_number() OVER (ORDER BY event_type, value DESC, event_id) - 1 AS rank FROM events")
add("sort_index", "L23", lambda s, d: ranked(events(s, d).set_index("user_id")[["value"]].sort_index()).sdf.select("user_id", "value", "rank"), "SELECT user_id, value, row_number() OVER (ORDER BY user_id, event_id) - 1 AS rank FROM events")
add("top_nlargest", "OP-157", lambda s, d: events(s, d)["v"].nlargest(25).spark(), f"SELECT event_id, v FROM {E} ORDER BY v DESC NULLS LAST, event_id LIMIT 25")
add("top_nsmallest", "OP-158", lambda s, d: events(s, d)["v"].nsmallest(25).spark(), f"SELECT event_id, v FROM {E} ORDER BY v NULLS LAST, event_id LIMIT 25")


def signal(s, d):
    """A trading-signal pipeline: rolling mean and spread, a shifted crossing, the mean change after it by kind of event."""
    f = events(s, d)
    w = f.window()
    mean, spread = F.avg("value").over(w.rowsBetween(-19, 0)), F.stddev_samp("value").over(w.rowsBetween(-89, 0))
    change = F.col("value") / F.when(F.lag("value").over(w) != 0, F.lag("value").over(w)) - 1
    f = f.set_column("mean", mean).set_column("spread", spread).set_column("change", change)
    f = f.set_column("signal", F.lag(F.col("value") < F.col("mean") - F.col("spread") * 0.5).over(w))
    hit = f[F.coalesce(F.col("signal"), F.lit(False))]
    return rounded(hit[["event_type", "change", "mean"]].groupby("event_type").mean().spark(), 4)


add("flagship_signal", "L39", signal, "SELECT event_type, round(avg(change), 4) AS change, round(avg(mean), 4) AS mean FROM (SELECT *, lag(value < mean - spread * 0.5) " + U + " AS signal FROM (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean, stddev_samp(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 89 PRECEDING AND CURRENT ROW) AS spread, value / nullif(lag(value) " + U + ", 0) - 1 AS change FROM events)) WHERE signal GROUP BY event_type")

add("roll_time_global", "L14", lambda s, d: rounded(events(s, d, ())[["v", "ts"]].rolling("2h", on="ts").sum().spark(), 4), f"SELECT event_id, CASE WHEN count(v) {{o}} >= 1 THEN round(sum(v) {{o}}, 4) END AS v FROM {E}".format(o="OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW)"))
add("seq_pct_change_bfill_global", "OP-154", lambda s, d: rounded(events(s, d, ())[["v"]].pct_change(fill_method="bfill", undefined=float("nan")).spark(), 4), f"SELECT event_id, round(f / lag(f) OVER (ORDER BY event_id) - 1, 4) AS v FROM (SELECT event_id, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM {E})")
