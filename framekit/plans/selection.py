"""Projection, filters, indexing (inventory §2.2) and labels (§2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import Series
from ..operators import setops
from .registry import EVENTS, add, events, load, rounded

E = EVENTS


def orders(s, d):
    return load(s, d, "orders", order=["o_orderkey"], index=["o_orderkey"], columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])


add("sel_column", "OP-017 OP-022 OP-060", lambda s, d: orders(s, d)["o_totalprice"].values, "SELECT o_totalprice FROM orders")
add("sel_columns", "OP-018", lambda s, d: orders(s, d)[["o_orderkey", "o_orderstatus"]].spark(), "SELECT o_orderkey, o_orderstatus FROM orders")
add("sel_slice", "OP-019", lambda s, d: orders(s, d)[100:200].spark(), "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p >= 100 AND p < 200")
add("sel_mask", "OP-020", lambda s, d: (lambda f: f[f["o_totalprice"] > 100000.0].spark())(orders(s, d)), "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 100000")


def mask_of_another_frame(s, d):
    left, right = orders(s, d), orders(s, d)
    return left[right["o_orderstatus"] == "F"][["o_orderkey", "o_orderstatus"]].spark()


add("sel_mask_aligned", "OP-020 OP-070", mask_of_another_frame, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
add("sel_mask_array", "OP-021", lambda s, d: orders(s, d)[[i % 3 == 0 for i in range(30)]][["o_orderkey"]].spark(), "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p < 30 AND p % 3 = 0")
add("sel_attribute", "OP-022", lambda s, d: orders(s, d).o_orderstatus.values, "SELECT o_orderstatus FROM orders")
add("sel_iloc_int", "OP-023 OP-024", lambda s, d: orders(s, d).iloc[17][["o_orderkey", "o_totalprice"]].spark(), "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p = 17")
add("sel_iloc_list", "OP-024", lambda s, d: orders(s, d).iloc[[5, 3, 3, 100]][["o_orderkey"]].spark(), "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) JOIN (SELECT unnest([5, 3, 3, 100]) AS p) USING (p)")
add("sel_iloc_slice", "OP-024", lambda s, d: orders(s, d).iloc[10:50:5][["o_orderkey"]].spark(), "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p >= 10 AND p < 50 AND (p - 10) % 5 = 0")
add("sel_iloc_row_column", "OP-024 OP-025", lambda s, d: orders(s, d).iloc[7, 3].sdf.select("o_totalprice"), "SELECT o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p = 7")
add("sel_iloc_callable", "OP-236", lambda s, d: orders(s, d)["o_orderkey"].iloc[lambda f: [1, 2, 4]].spark(), "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p IN (1, 2, 4)")
add("sel_at", "OP-026 OP-044", lambda s, d: events(s, d).set_index("user_id").at[7, "value"], "SELECT value FROM events WHERE user_id = 7")
add("sel_loc_label", "OP-027 OP-042", lambda s, d: events(s, d).set_index("user_id").loc[7][["event_id", "value"]].sdf.select("user_id", "event_id", "value"), "SELECT user_id, event_id, value FROM events WHERE user_id = 7")
add("sel_loc_slice", "OP-039 OP-042", lambda s, d: orders(s, d)["o_totalprice"].loc[100:300].spark(), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 300")
add("sel_loc_list", "OP-039", lambda s, d: orders(s, d)["o_totalprice"].loc[[7, 3, 3]].spark(), "SELECT o_orderkey, o_totalprice FROM orders JOIN (SELECT unnest([7, 3, 3]) AS k) ON o_orderkey = k")
add("sel_iat", "OP-025 OP-043", lambda s, d: s.createDataFrame([(orders(s, d).iat[11, 3],)], "cell double"), "SELECT o_totalprice AS cell FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p = 11")
add("sel_set_column", "OP-028", lambda s, d: rounded((lambda f: f.set_column("net", f["o_totalprice"] * 0.9)[["o_orderkey", "net"]].spark())(orders(s, d))), "SELECT o_orderkey, round(o_totalprice * 0.9, 6) AS net FROM orders")
add("sel_drop", "OP-029 L21", lambda s, d: orders(s, d).drop(["o_custkey", "o_totalprice", "o_orderpriority"]).spark(), "SELECT o_orderkey, o_orderstatus FROM orders")
add("sel_head", "OP-030 OP-046", lambda s, d: orders(s, d).head(12)[["o_orderkey", "o_totalprice"]].spark(), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 12")
add("sel_copy", "OP-031 OP-048", lambda s, d: orders(s, d).copy()[["o_orderkey"]]["o_orderkey"].copy().values, "SELECT o_orderkey FROM orders")
add("sel_index", "OP-032 OP-061", lambda s, d: orders(s, d).index, "SELECT o_orderkey FROM orders")
add("sel_column_names", "OP-033", lambda s, d: s.createDataFrame([(c,) for c in load(s, d, "region").columns], "name string"), "SELECT unnest(['r_regionkey', 'r_name']) AS name")
add("sel_values", "OP-034", lambda s, d: load(s, d, "part")[["p_partkey", "p_retailprice"]].values().select(F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total")), "SELECT round(p_partkey + p_retailprice, 4) AS total FROM part")
add("sel_reset_index", "OP-035", lambda s, d: orders(s, d)[["o_orderstatus"]].reset_index().spark(), "SELECT o_orderkey AS index, o_orderstatus FROM orders")
add("sel_reset_index_drop", "OP-035", lambda s, d: orders(s, d)[["o_orderstatus"]].reset_index(drop=True).reset_index().spark(), "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS index, o_orderstatus FROM orders")
add("sel_isna_frame", "OP-036", lambda s, d: events(s, d)[["v", "w"]].isna().spark(), f"SELECT event_id, v IS NULL AS v, w IS NULL AS w FROM {E}")
add("sel_isin_values", "OP-037 OP-050", lambda s, d: load(s, d, "nation")[["n_nationkey", "n_regionkey"]].isin([1, 3]).spark(), "SELECT n_nationkey IN (1, 3) AS n_nationkey, n_regionkey IN (1, 3) AS n_regionkey FROM nation")
add("sel_isin_dict", "OP-037", lambda s, d: load(s, d, "nation")[["n_nationkey", "n_regionkey"]].isin({"n_regionkey": [2]}).spark(), "SELECT false AS n_nationkey, n_regionkey = 2 AS n_regionkey FROM nation")


def isin_series(s, d):
    f = load(s, d, "nation", index=["n_nationkey"], order=["n_nationkey"], columns=["n_regionkey"])
    other = load(s, d, "region", index=["r_regionkey"], order=["r_regionkey"], columns=["r_regionkey"])
    return f.isin(other["r_regionkey"]).spark()


add("sel_isin_series", "OP-037", isin_series, "SELECT n_nationkey, coalesce(n_regionkey = r_regionkey, false) AS n_regionkey FROM nation LEFT JOIN region ON n_nationkey = r_regionkey")


def isin_frame(s, d):
    f = load(s, d, "nation", index=["n_nationkey"], order=["n_nationkey"], columns=["n_name", "n_regionkey"])
    other = load(s, d, "nation", index=["n_nationkey"], order=["n_nationkey"], columns=["n_regionkey"])
    return f.isin(other[other["n_regionkey"] > 1]).spark()


add("sel_isin_frame", "OP-037", isin_frame, "SELECT n_nationkey, false AS n_name, n_regionkey > 1 AS n_regionkey FROM nation")
add("sel_series_label", "OP-038", lambda s, d: events(s, d).set_index("user_id")["value"][7].values, "SELECT value FROM events WHERE user_id = 7")
add("sel_series_slice", "OP-038 OP-041", lambda s, d: orders(s, d)["o_totalprice"][5:15].spark(), "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p BETWEEN 5 AND 14")
add("sel_series_mask", "OP-038", lambda s, d: (lambda f: f["value"][f["value"] > 50.0].spark())(events(s, d)), "SELECT event_id, value FROM events WHERE value > 50")
add("sel_series_iloc", "OP-039 OP-041", lambda s, d: orders(s, d)["o_totalprice"].iloc[[2, 9]].spark(), "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p IN (2, 9)")
add("sel_assign", "OP-040", lambda s, d: (lambda f: f["value"].where_set(f["value"] > 50.0, 0.0).spark())(events(s, d)), "SELECT event_id, CASE WHEN value > 50 THEN 0.0 ELSE value END AS value FROM events")
add("sel_take", "OP-045", lambda s, d: orders(s, d)["o_totalprice"].take([4, 4, 0, 20]).spark(), "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) JOIN (SELECT unnest([4, 4, 0, 20]) AS p) USING (p)")
add("sel_rename", "OP-047", lambda s, d: orders(s, d)["o_totalprice"].rename("price").values, "SELECT o_totalprice AS price FROM orders")
add("sel_astype", "OP-049", lambda s, d: (lambda f: f.set_column("i", f["v"].astype("bigint")).set_column("t", f["w"].astype("string"))[["i", "t"]].spark())(events(s, d)), f"SELECT event_id, CAST(trunc(v) AS BIGINT) AS i, CAST(w AS VARCHAR) AS t FROM {E}")
add("sel_isin", "OP-050", lambda s, d: events(s, d)["event_type"].isin(["click", "view"]).rename("hit").spark(), "SELECT event_id, event_type IN ('click', 'view') AS hit FROM events")
add("sel_isna", "OP-051 OP-052", lambda s, d: (lambda f: f.set_column("a", f["v"].isna()).set_column("b", f["v"].isnull())[["a", "b"]].spark())(events(s, d)), f"SELECT event_id, v IS NULL AS a, v IS NULL AS b FROM {E}")
add("sel_notna", "OP-053", lambda s, d: events(s, d)["v"].notna().rename("known").spark(), f"SELECT event_id, v IS NOT NULL AS known FROM {E}")
add("sel_dropna", "OP-054", lambda s, d: events(s, d)["v"].dropna().spark(), f"SELECT event_id, v FROM {E} WHERE v IS NOT NULL")
add("sel_fillna", "OP-055", lambda s, d: events(s, d)["v"].fillna(-1.0).spark("v"), f"SELECT event_id, coalesce(v, -1.0) AS v FROM {E}")
add("sel_shape", "OP-056 OP-057 OP-058 OP-063", lambda s, d: (lambda x: s.createDataFrame([(x.shape[0], x.size, x.ndim, len(x))], "shape long, size long, ndim long, length long"))(orders(s, d)["o_orderkey"]), "SELECT count(*) AS shape, count(*) AS size, 1 AS ndim, count(*) AS length FROM orders")
add("sel_transpose", "OP-059", lambda s, d: orders(s, d)["o_custkey"].T.values, "SELECT o_custkey FROM orders")
add("sel_str_accessor", "OP-062 OP-191", lambda s, d: load(s, d, "part")["p_name"].str.len().rename("n").values, "SELECT length(p_name) AS n FROM part")
add("sel_len_frame", "OP-064", lambda s, d: orders(s, d).length(), "SELECT count(*) AS length FROM orders")
add("na_fill_frame", "L19", lambda s, d: events(s, d)[["v", "w"]].fillna({"v": 0.0, "w": -1}).spark(), f"SELECT event_id, coalesce(v, 0.0) AS v, coalesce(w, -1) AS w FROM {E}")
add("na_drop_frame", "L20", lambda s, d: events(s, d)[["v", "w"]].dropna().spark(), f"SELECT event_id, v, w FROM {E} WHERE v IS NOT NULL AND w IS NOT NULL")

# labels
LEFT = "(SELECT event_id AS k, value AS a FROM events WHERE event_id % 3 <> 0)"
RIGHT = "(SELECT event_id AS k, value AS b FROM events WHERE event_id % 4 <> 0)"


def sides(s, d) -> tuple[Series, Series]:
    f, g = events(s, d), events(s, d)
    return f[F.col("event_id") % 3 != 0]["value"], g[F.col("event_id") % 4 != 0]["value"]


def label_frame(series: Series, name: str):
    return rounded(series.frame.sdf.select(F.col("__label0").alias("k"), series.expr.alias(name)))


add("align_add", "OP-065 OP-169", lambda s, d: label_frame((lambda a, b: a + b)(*sides(s, d)), "r"), f"SELECT coalesce(x.k, y.k) AS k, round(a + b, 6) AS r FROM {LEFT} x FULL JOIN {RIGHT} y ON x.k = y.k")
add("align_add_fill", "OP-065 OP-169", lambda s, d: label_frame((lambda a, b: a.add(b, fill_value=1.5))(*sides(s, d)), "r"), f"SELECT coalesce(x.k, y.k) AS k, round(coalesce(a, 1.5) + coalesce(b, 1.5), 6) AS r FROM {LEFT} x FULL JOIN {RIGHT} y ON x.k = y.k")
add("align_same_lineage", "OP-066", lambda s, d: rounded((lambda f: (f["value"] + f["w"]).rename("r").spark())(events(s, d))), f"SELECT event_id, round(value + w, 6) AS r FROM {E}")


def position_align(s, d):
    a = load(s, d, "nation", order=["n_nationkey"], columns=["n_nationkey"])["n_nationkey"]
    b = load(s, d, "region", order=["r_regionkey"], columns=["r_regionkey"])["r_regionkey"]
    return label_frame(a + b, "r")


add("align_positions", "OP-067 OP-068 OP-069", position_align, "SELECT coalesce(p, q) AS k, CAST(n_nationkey + r_regionkey AS DOUBLE) AS r FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation) FULL JOIN (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) - 1 AS q FROM region) ON p = q")


def reindex_query(s, d):
    from ..functions.index import reindex

    return reindex(s.read.parquet(f"{d}/nation.parquet").select("n_nationkey"), ["n_nationkey"], s.range(0, 40, 3).select(F.col("id").alias("label")))


add("index_reindex", "OP-071 §2.11", reindex_query, "SELECT range AS label, coalesce(p, -1) AS indexer FROM range(0, 40, 3) LEFT JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation) ON n_nationkey = range")

# rows of several frames
LOW, HIGH = "(SELECT * FROM orders WHERE o_orderkey % 5 = 0)", "(SELECT * FROM orders WHERE o_orderkey % 3 = 0)"


def halves(s, d):
    f = orders(s, d)
    return f[F.col("o_orderkey") % 5 == 0], orders(s, d)[F.col("o_orderkey") % 3 == 0]


add("set_append_series", "OP-165 OP-167 L42", lambda s, d: (lambda a, b: a["o_totalprice"].append(b["o_totalprice"]).spark())(*halves(s, d)), f"SELECT o_orderkey, o_totalprice FROM {LOW} UNION ALL SELECT o_orderkey, o_totalprice FROM {HIGH}")
add("set_append_frame", "OP-166 L17", lambda s, d: (lambda a, b: a[["o_orderkey", "o_orderstatus"]].append(b[["o_orderkey", "o_custkey"]]).spark())(*halves(s, d)), f"SELECT o_orderkey, o_orderstatus, NULL::BIGINT AS o_custkey FROM {LOW} UNION ALL SELECT o_orderkey, NULL, o_custkey FROM {HIGH}")
add("set_append_ignore_index", "OP-165 OP-168", lambda s, d: (lambda a, b: a[["o_totalprice"]].append(b[["o_totalprice"]], ignore_index=True).reset_index().spark())(*halves(s, d)), f"SELECT row_number() OVER (ORDER BY t, o_orderkey) - 1 AS index, o_totalprice FROM (SELECT 0 AS t, * FROM {LOW} UNION ALL SELECT 1, * FROM {HIGH})")
add("set_concat_columns", "L18", lambda s, d: setops.concat([load(s, d, "nation", order=["n_nationkey"], columns=["n_name"]), load(s, d, "region", order=["r_regionkey"], columns=["r_name"])], axis=1).sdf.select("n_name", "r_name"), "SELECT n_name, r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS p FROM nation) FULL JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS q FROM region) ON p = q")
add("set_union_distinct", "§2.7 superset", lambda s, d: setops.union(*[x[["o_orderkey"]] for x in halves(s, d)]).spark(), f"SELECT o_orderkey FROM {LOW} UNION SELECT o_orderkey FROM {HIGH}")
add("set_intersect", "§2.7 superset", lambda s, d: setops.intersect(*[x[["o_orderkey"]] for x in halves(s, d)]).spark(), f"SELECT o_orderkey FROM {LOW} INTERSECT SELECT o_orderkey FROM {HIGH}")
add("set_difference", "§2.7 superset", lambda s, d: setops.difference(*[x[["o_orderkey"]] for x in halves(s, d)]).spark(), f"SELECT o_orderkey FROM {LOW} EXCEPT SELECT o_orderkey FROM {HIGH}")
