"""Reductions and group-by (inventory §2.4), pivots and describe (§2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.group import crosstab
from .registry import EVENTS, add, events, load, rounded

E = EVENTS
#: SQL of each reduction of a column.
SQL = {
    "sum": "coalesce(sum({c}), 0)", "prod": "coalesce(product({c}), 1)", "mean": "avg({c})", "median": "median({c})", "min": "min({c})", "max": "max({c})", "std": "stddev_samp({c})", "var": "var_samp({c})",
    "skew": "skewness({c})", "count": "count({c})", "nunique": "count(DISTINCT {c})",
}
ROWS = {"sum": ("OP-072", "OP-091", "OP-105 OP-114"), "prod": ("OP-073", "OP-092", "OP-110 OP-119"), "mean": ("OP-074", "OP-093", "OP-106 OP-115"), "median": ("OP-079 L38", "OP-094", "OP-107 OP-116"), "min": ("OP-075", "OP-095", "OP-108 OP-117"), "max": ("OP-076", "OP-096", "OP-109 OP-118"), "var": ("OP-077", "OP-098", "OP-112 OP-121"), "std": ("OP-078", "OP-097", "OP-111 OP-120"), "count": ("OP-082", "OP-099", "OP-104 OP-113")}
#: Products of many numbers leave the range of doubles; their query takes numbers near 1.
NEAR_ONE = "(SELECT *, 1 + v / 100000 AS q FROM " + E + ")"


def near_one(s, d):
    f = events(s, d)
    return f.set_column("q", F.lit(1) + F.col("v") / 100000)


for name, (one, whole, groups) in ROWS.items():
    if name == "prod":
        add("agg_prod", one, lambda s, d: rounded(near_one(s, d)["q"].prod(alias="r"), 4), f"SELECT round(coalesce(product(q), 1), 4) AS r FROM {NEAR_ONE}")
        add("frame_prod", whole, lambda s, d: rounded(near_one(s, d)[["q"]].prod(), 4), f"SELECT 'q' AS column, round(coalesce(product(q), 1), 4) AS value FROM {NEAR_ONE}")
        add("gb_prod", "OP-110", lambda s, d: rounded(near_one(s, d)[["event_type", "q"]].groupby("event_type").prod().spark(), 4), f"SELECT event_type, round(coalesce(product(q), 1), 4) AS q FROM {NEAR_ONE} GROUP BY event_type")
        add("gb_col_prod", "OP-119", lambda s, d: rounded(near_one(s, d).groupby("event_type")["q"].prod().spark(), 4), f"SELECT event_type, round(coalesce(product(q), 1), 4) AS q FROM {NEAR_ONE} GROUP BY event_type")
        continue
    x = SQL[name]
    r = (lambda e: e) if name == "count" else (lambda e: f"round({e}, 4)")
    add(f"agg_{name}", one, lambda s, d, name=name: rounded(events(s, d)["v"].reduce(name, "r"), 4), f"SELECT {r(x.format(c='v'))} AS r FROM {E}")
    kind = "" if name == "count" else "::DOUBLE"
    add(f"frame_{name}", whole, lambda s, d, name=name: rounded(events(s, d)[["v", "w"]].reduce(name), 4), f"SELECT 'v' AS column, {r(x.format(c='v') + kind)} AS value FROM {E} UNION ALL SELECT 'w', {r(x.format(c='w') + kind)} FROM {E}")
    a, b = groups.split()
    add(f"gb_{name}", f"OP-101 {a}", lambda s, d, name=name: rounded(events(s, d)[["event_type", "v", "w"]].groupby("event_type").reduce(name).spark(), 4), f"SELECT event_type, {r(x.format(c='v'))} AS v, {r(x.format(c='w'))} AS w FROM {E} GROUP BY event_type")
    add(f"gb_col_{name}", f"OP-103 {b}", lambda s, d, name=name: rounded(events(s, d).groupby("user_id")["v"].reduce(name).spark(), 4), f"SELECT user_id, {r(x.format(c='v'))} AS v FROM {E} GROUP BY user_id")

add("agg_var_ddof0", "OP-077", lambda s, d: rounded(events(s, d)["v"].var(alias="r", ddof=0), 4), f"SELECT round(var_pop(v), 4) AS r FROM {E}")
add("agg_std_ddof2", "OP-078", lambda s, d: rounded(events(s, d)["v"].std(alias="r", ddof=2), 4), f"SELECT round(sqrt(var_pop(v) * count(v) / (count(v) - 2)), 4) AS r FROM {E}")
add("agg_mean_keepna", "OP-074", lambda s, d: events(s, d)["v"].mean(alias="r", skipna=False), f"SELECT CASE WHEN count(v) = count(*) THEN avg(v) END AS r FROM {E}")
add("agg_quantile", "OP-080 L38", lambda s, d: rounded(events(s, d)["v"].quantile(0.3)), f"SELECT round(quantile_cont(v, 0.3), 6) AS quantile FROM {E}")
add("agg_quantiles", "OP-080", lambda s, d: events(s, d)["v"].quantile([0.1, 0.9], "q").select(F.posexplode("q").alias("i", "q")).select("i", F.round("q", 6).alias("q")), f"SELECT 0 AS i, round(quantile_cont(v, 0.1), 6) AS q FROM {E} UNION ALL SELECT 1, round(quantile_cont(v, 0.9), 6) FROM {E}")
add("agg_skew", "OP-081", lambda s, d: rounded(events(s, d)["v"].skew(alias="r"), 4), f"SELECT round(skewness(v), 4) AS r FROM {E}")
add("agg_nunique", "OP-083 L38", lambda s, d: events(s, d)["w"].nunique(alias="r"), f"SELECT count(DISTINCT w) AS r FROM {E}")
add("agg_nunique_keepna", "OP-083", lambda s, d: events(s, d)["w"].nunique(alias="r", dropna=False), f"SELECT count(DISTINCT w) + max(CASE WHEN w IS NULL THEN 1 ELSE 0 END) AS r FROM {E}")
add("agg_unique", "OP-084 L38", lambda s, d: events(s, d)["w"].unique(), f"SELECT DISTINCT w FROM {E}")
add("agg_value_counts", "OP-085", lambda s, d: events(s, d)["w"].value_counts(), f"SELECT w AS value, count(*) AS count FROM {E} WHERE w IS NOT NULL GROUP BY w")
add("agg_value_counts_keepna", "OP-085", lambda s, d: events(s, d)["w"].value_counts(dropna=False), f"SELECT w AS value, count(*) AS count FROM {E} GROUP BY w")
add("agg_idxmax", "OP-086", lambda s, d: events(s, d)["w"].idxmax(), f"SELECT min(event_id) AS label FROM {E} WHERE w = (SELECT max(w) FROM {E})")
add("agg_idxmin", "OP-087", lambda s, d: events(s, d)["v"].idxmin(), f"SELECT min(event_id) AS label FROM {E} WHERE v = (SELECT min(v) FROM {E})")
add("agg_cov", "OP-088", lambda s, d: rounded((lambda f: f["v"].cov(f["w"]))(events(s, d)), 4), f"SELECT round(covar_samp(v, w), 4) AS cov FROM {E}")
add("agg_corr", "OP-089", lambda s, d: rounded((lambda f: f["v"].corr(f["w"]))(events(s, d)), 6), f"SELECT round(corr(v, w), 6) AS corr FROM {E}")
add("agg_cov_positional", "OP-088", lambda s, d: rounded((lambda f, g: f["v"].cov(g["w"]))(events(s, d), events(s, d)[F.col("event_id") % 2 == 0]), 4), f"SELECT round(covar_samp(v, u), 4) AS cov FROM (SELECT v, row_number() OVER (ORDER BY event_id) AS p FROM {E}) JOIN (SELECT w AS u, row_number() OVER (ORDER BY event_id) AS p FROM {E} WHERE event_id % 2 = 0) USING (p)")
STATS = [("count", "count(v)"), ("mean", "avg(v)"), ("std", "stddev_samp(v)"), ("min", "min(v)"), ("25%", "quantile_cont(v, 0.25)"), ("50%", "quantile_cont(v, 0.5)"), ("75%", "quantile_cont(v, 0.75)"), ("max", "max(v)")]
add("agg_describe", "OP-090", lambda s, d: rounded(events(s, d)["v"].describe(), 4), " UNION ALL ".join(f"SELECT '{n}' AS stat, round(({e})::DOUBLE, 4) AS v FROM {E}" for n, e in STATS))
add("agg_describe_text", "OP-090", lambda s, d: load(s, d, "orders")["o_orderpriority"].describe(), "WITH c AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT v, n FROM c ORDER BY n DESC, v DESC LIMIT 1) SELECT 'count' AS stat, CAST(sum(n) AS VARCHAR) AS o_orderpriority FROM c UNION ALL SELECT 'unique', CAST(count(*) AS VARCHAR) FROM c UNION ALL SELECT 'top', v FROM t UNION ALL SELECT 'freq', CAST(n AS VARCHAR) FROM t")
add("frame_describe", "L24", lambda s, d: rounded(events(s, d)[["v", "w"]].describe(), 4), " UNION ALL ".join(f"SELECT '{n}' AS stat, round(({e})::DOUBLE, 4) AS v, round(({e.replace('(v', '(w')})::DOUBLE, 4) AS w FROM {E}" for n, e in STATS))
add("gb_series", "OP-102", lambda s, d: rounded((lambda f: f["v"].groupby(f["event_type"]).mean().spark().withColumnRenamed("__key", "event_type"))(events(s, d)), 4), f"SELECT event_type, round(avg(v), 4) AS v FROM {E} GROUP BY event_type")
add("gb_columns", "OP-103", lambda s, d: rounded(events(s, d).groupby("event_type")[["v", "w"]].max().spark(), 4), f"SELECT event_type, max(v) AS v, max(w) AS w FROM {E} GROUP BY event_type")
add("gb_missing_keys", "OP-101", lambda s, d: events(s, d)[["w", "v"]].groupby("w").count().spark(), f"SELECT w, count(v) AS v FROM {E} WHERE w IS NOT NULL GROUP BY w")
add("gb_multi_key", "L08", lambda s, d: rounded(events(s, d)[["user_id", "event_type", "v"]].groupby(["user_id", "event_type"]).sum().spark(), 4), f"SELECT user_id, event_type, round(coalesce(sum(v), 0), 4) AS v FROM {E} GROUP BY user_id, event_type")
add("gb_no_index", "L09", lambda s, d: rounded(events(s, d)[["event_type", "v"]].groupby("event_type", as_index=False).mean().spark(), 4), f"SELECT event_type, round(avg(v), 4) AS v FROM {E} GROUP BY event_type")
add("gb_agg_function", "L10", lambda s, d: rounded(events(s, d)[["event_type", "v"]].groupby("event_type").agg(lambda c: F.max(c) - F.min(c)).spark(), 4), f"SELECT event_type, round(max(v) - min(v), 4) AS v FROM {E} GROUP BY event_type")
add("gb_agg_dict", "L10 L16", lambda s, d: rounded(events(s, d).groupby("event_type").agg({"v": "mean", "w": "nunique"}).spark(), 4), f"SELECT event_type, round(avg(v), 4) AS v, count(DISTINCT w) AS w FROM {E} GROUP BY event_type")
add("gb_agg_python", "L10", lambda s, d: rounded(events(s, d)[["event_type", "v"]].groupby("event_type").agg_python(lambda x: float(x.max() - x.min())).spark(), 4), f"SELECT event_type, round(max(v) - min(v), 4) AS v FROM {E} GROUP BY event_type")
add("gb_filtered", "L11", lambda s, d: rounded((lambda f: f[f["v"] > 20.0][["event_type", "v"]].groupby("event_type").sum().spark())(events(s, d)), 4), f"SELECT event_type, round(sum(v), 4) AS v FROM {E} WHERE v > 20 GROUP BY event_type")
add("gb_pivot_table", "L12", lambda s, d: rounded(load(s, d, "lineitem").pivot_table("l_returnflag", "l_linestatus", "l_quantity", "sum", ["F", "O"]).spark(), 2), "SELECT l_returnflag, coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) AS F, coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS O FROM lineitem GROUP BY l_returnflag")
add("gb_crosstab", "L13", lambda s, d: crosstab(load(s, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"]).spark(), "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag")
add("gb_rollup", "§2.4.3 superset", lambda s, d: load(s, d, "lineitem").sdf.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")), "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
