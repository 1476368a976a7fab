"""Joins (inventory §2.12), sources and sinks (§2.1), streams and linear algebra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators.joins import merge_asof
from ..pinning import pin, scratch
from ..sources import images, readers
from ..streaming import events as streams
from .registry import add, load, rounded


def pair(s, d):
    return load(s, d, "orders")[["o_orderkey", "o_custkey", "o_totalprice"]], load(s, d, "customer")[["c_custkey", "c_name", "c_nationkey"]]


add("join_inner", "L01", lambda s, d: (lambda a, b: a.merge(b, left_on="o_custkey", right_on="c_custkey").spark())(*pair(s, d)), "SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
add("join_multi_key", "L02", lambda s, d: (lambda x, y: x.merge(y, on=["l_orderkey", "l_linenumber"]).spark())(load(s, d, "lineitem")[["l_orderkey", "l_linenumber", "l_quantity"]], load(s, d, "lineitem")[["l_orderkey", "l_linenumber", "l_tax"]]), "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem) JOIN (SELECT l_orderkey, l_linenumber, l_tax FROM lineitem) USING (l_orderkey, l_linenumber)")
FEW = "(SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0)"


def few(s, d):
    a, b = pair(s, d)
    return a, b[F.col("c_custkey") % 3 == 0][["c_custkey", "c_name"]]


for how, sql, row in (("left", "LEFT", "L03"), ("right", "RIGHT", "L04"), ("outer", "FULL", "L05")):
    add(f"join_{how}", row, lambda s, d, how=how: (lambda a, b: a[F.col("o_custkey") % 2 == 0].merge(b, how=how, left_on="o_custkey", right_on="c_custkey").spark())(*few(s, d)), f"SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name FROM (SELECT * FROM orders WHERE o_custkey % 2 = 0) {sql} JOIN {FEW} ON o_custkey = c_custkey")
add("join_text_key", "L06", lambda s, d: load(s, d, "nation").merge(load(s, d, "nation")[["n_name", "n_regionkey"]].rename({"n_regionkey": "k"}), on="n_name").spark(), "SELECT n_nationkey, n_name, n_regionkey, n_regionkey AS k FROM nation")
add("join_time_key", "L06", lambda s, d: load(s, d, "events")[["ts", "event_id"]].merge(load(s, d, "events")[["ts", "value"]], on="ts").spark(), "SELECT ts, event_id, value FROM events")
add("join_semi", "§2.3 superset", lambda s, d: (lambda a, b: a.merge(b, how="semi", left_on="o_custkey", right_on="c_custkey").spark())(*few(s, d)), f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM {FEW})")
add("join_anti", "§2.3 superset", lambda s, d: (lambda a, b: a.merge(b, how="anti", left_on="o_custkey", right_on="c_custkey").spark())(*few(s, d)), f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {FEW})")


def asof(s, d, by="user_id"):
    e = load(s, d, "events")
    left = e[F.col("event_type") == "purchase"][["event_id", "user_id", "ts"]]
    right = e[F.col("event_type") == "view"][["user_id", "ts", "value"]]
    return merge_asof(left, right if by else right[["ts", "value"]], "ts", by).spark()


add("join_asof_by", "L07", asof, "SELECT l.event_id, l.user_id, l.ts, r.value FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts >= r.ts")
add("join_asof", "L07", lambda s, d: asof(s, d, None), "SELECT l.event_id, l.user_id, l.ts, r.value FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.ts >= r.ts")

# sources and sinks: what is written is read again
add("io_parquet_columns", "OP-014 L27 L29", lambda s, d: readers.read_parquet(s, f"{d}/customer.parquet", ["c_custkey", "c_mktsegment"]).spark(), "SELECT c_custkey, c_mktsegment FROM customer")


def written_csv(s, d, header=True):
    path = scratch(s)
    readers.to_csv(load(s, d, "supplier"), path, header)
    return path


add("io_csv", "OP-001 OP-003 OP-004 L28", lambda s, d: readers.read_csv(s, written_csv(s, d), dtype={"s_suppkey": "int64", "s_name": "str", "s_nationkey": "int32", "s_acctbal": "float64"}).spark(), "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
add("io_csv_inferred", "OP-004", lambda s, d: readers.read_csv(s, written_csv(s, d), sample=1.0).spark().select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_acctbal"), "SELECT s_suppkey, s_acctbal FROM supplier")
add("io_csv_usecols", "OP-002 L29", lambda s, d: readers.read_csv(s, written_csv(s, d, False), names=["k", "name", "nation", "balance"], usecols=["balance", "k"], dtype={"k": "int64", "name": "str", "nation": "int32", "balance": "float64"}).spark(), "SELECT s_suppkey AS k, s_acctbal AS balance FROM supplier")
add("io_csv_converters", "OP-005 OP-237", lambda s, d: readers.read_csv(s, written_csv(s, d, False), names=["k", "name", "nation", "balance"], usecols=["k", "name", "nation"], dtype={"k": "int64", "balance": "float64"}, converters={"name": lambda c: F.lower(c), "nation": (lambda x: int(x) * 10, "bigint")}).spark(), "SELECT s_suppkey AS k, lower(s_name) AS name, CAST(s_nationkey AS BIGINT) * 10 AS nation FROM supplier")
add("io_csv_category", "OP-006", lambda s, d: readers.read_csv(s, written_csv(s, d, False), names=["k", "name", "nation", "balance"], usecols=["k", "nation"], dtype={"k": "int64", "name": "str", "nation": ("category", ["0", "1", "2"]), "balance": "float64"}).spark(), "SELECT s_suppkey AS k, CASE WHEN s_nationkey <= 2 THEN s_nationkey ELSE -1 END AS nation FROM supplier")
add("io_frame_of_dict", "OP-007", lambda s, d: readers.from_dict(s, {"a": [1, 2, 3], "b": [0.5, None, 1.5]}, schema="a long, b double").spark(), "SELECT * FROM (VALUES (1, 0.5), (2, NULL), (3, 1.5)) t(a, b)")
add("io_series_of_list", "OP-008", lambda s, d: readers.series(s, [3, 1, 2], index=["x", "y", "z"], kind="int64").spark(), "SELECT * FROM (VALUES ('x', 3), ('y', 1), ('z', 2)) t(index, value)")


def through_pandas(s, d):
    frame = load(s, d, "region", order=["r_regionkey"])
    return readers.from_pandas(s, frame.to_pandas()).spark()


add("io_pandas", "OP-009 OP-010 OP-011", through_pandas, "SELECT r_regionkey, r_name FROM region")


def rows_back(s, d):
    frame = load(s, d, "region", order=["r_regionkey"])
    return s.createDataFrame([(r.r_regionkey, r.r_name) for r in frame.itertuples()], "k int, name string")


add("io_itertuples", "L26", rows_back, "SELECT r_regionkey AS k, r_name AS name FROM region")
add("io_glob", "OP-015", lambda s, d: readers.paths(s, f"{d}/region.parquet").select(F.regexp_extract("path", "[^/]+$", 0).alias("file")), "SELECT 'region.parquet' AS file")


def raw(s, d):
    """A raw file, written in order and read again."""
    path = scratch(s) + ".bin"
    readers.to_file(s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_retailprice"), "p_retailprice", ["p_partkey"], path)
    return readers.from_file(s, path).sdf.select("pos", "value")


add("io_raw_arrays", "OP-012 OP-013", raw, "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_retailprice AS value FROM part")


def skipped(s, d):
    """Files with two lines of comment and a header, of which a data row repeats the text."""
    path = scratch(s)
    rows = s.read.parquet(f"{d}/supplier.parquet").select(F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name").alias("value"))
    lines = rows.agg(F.sort_array(F.collect_list("value")).alias("v")).select(F.explode(F.concat(F.array(*map(F.lit, ("a comment", "k,name", "k,name", "k,name"))), F.col("v"))).alias("value"))
    lines.coalesce(1).write.text(path)
    return readers.read_csv(s, path, skiprows=2, dtype={"k": "str", "name": "str"}).spark()


add("io_csv_skiprows", "OP-003", skipped, "SELECT CAST(s_suppkey AS VARCHAR) AS k, s_name AS name FROM supplier UNION ALL SELECT 'k', 'name'")


def small_images(s, d):
    """An image for each region, written as PNG, decoded and halved; a row for each pixel."""
    path = scratch(s)
    for r in s.read.parquet(f"{d}/region.parquet").select("r_regionkey").collect():
        pixels = np.add.outer(3 * np.arange(16), np.arange(12)) + 20 * r["r_regionkey"]
        readers.write_bytes(s, f"{path}/{r['r_regionkey']}.png", [images.encode_png(pixels)])
    halved = images.read_images(s, path, (8, 6)).withColumn("region", F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long"))
    place = F.expr("explode(sequence(0, height * width - 1))").alias("i")
    return halved.select("region", "height", "width", "pixels", place).select("region", F.expr("i div width").alias("y"), F.expr("i % width").cast("long").alias("x"), F.conv(F.hex(F.expr("substring(pixels, i + 1, 1)")), 16, 10).cast("long").alias("v"))


add("io_images", "OP-016", small_images, "SELECT CAST(r_regionkey AS BIGINT) AS region, y, x, 20 * r_regionkey + 6 * y + 2 * x + 2 AS v FROM region, range(8) a(y), range(6) b(x)")

# streams: a superset; the same expressions over batches are checked by SQL, tests run them as streams
add("stream_tumbling", "§2.9 superset", lambda s, d: streams.windowed(load(s, d, "events").sdf, "ts", "1 hour", by=["event_type"], n=F.count("*")), "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
add("stream_sliding", "§2.9 superset", lambda s, d: streams.windowed(load(s, d, "events").sdf, "ts", "2 hours", "1 hour", n=F.count("*")), "SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1")
add("stream_sessions", "§2.9 superset", lambda s, d: streams.sessions(load(s, d, "events").sdf, "ts", "30 minutes", ["user_id"], n=F.count("*")).select("user_id", "start", "n"), "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g")


def kernel_density(s, d):
    """Density of values at ten points by a Gaussian kernel: a stated point set against all rows, summed per task."""
    e = s.read.parquet(f"{d}/events.parquet").where("value is not null")
    points = [10.0 * i for i in range(10)]
    row = e.agg(*[F.avg(F.exp(-0.5 * F.pow((F.col("value") - x) / 5, F.lit(2.0)))).alias(f"p{i}") for i, x in enumerate(points)])
    return rounded(row.unpivot([], [f"p{i}" for i in range(10)], "point", "density"), 6)


add("ml_kernel_density", "L40", kernel_density, " UNION ALL ".join(f"SELECT 'p{i}' AS point, round(avg(exp(-0.5 * pow((value - {10.0 * i}) / 5, 2))), 6) AS density FROM events" for i in range(10)))


def linear_regression(s, d):
    """Slope and intercept by sums in one pass."""
    e = s.read.parquet(f"{d}/orders.parquet")
    return rounded(e.agg(F.regr_slope("o_totalprice", "o_custkey").alias("slope"), F.regr_intercept("o_totalprice", "o_custkey").alias("intercept")), 4)


add("ml_linear_regression", "L40", linear_regression, "SELECT round(regr_slope(o_totalprice, o_custkey), 4) AS slope, round(regr_intercept(o_totalprice, o_custkey), 4) AS intercept FROM orders")


def kmeans(s, d, k=3, rounds=5):
    """Centres of k clusters on a line; only k numbers reach the driver in each round."""
    e = pin(s.read.parquet(f"{d}/events.parquet").select(F.col("value").alias("x")).where("x is not null"))
    low, high = e.agg(F.min("x"), F.max("x")).first()
    centres = [low + (high - low) * (i + 0.5) / k for i in range(k)]
    for _ in range(rounds):
        near = F.array_position(F.transform(F.array(*map(F.lit, centres)), lambda c: F.abs(F.col("x") - c)), F.array_min(F.transform(F.array(*map(F.lit, centres)), lambda c: F.abs(F.col("x") - c))))
        found = {r[0]: r[1] for r in e.groupBy(near.alias("i")).agg(F.avg("x")).collect()}
        centres = [found.get(i + 1, c) for i, c in enumerate(centres)]
    return s.createDataFrame([(i, round(c, 6)) for i, c in enumerate(centres)], "cluster long, centre double")


def kmeans_sql(k=3, rounds=5):
    nearest = "list_position(list_transform([{}], lambda c: abs(x - c)), list_min(list_transform([{}], lambda c: abs(x - c))))"
    centres = ", ".join(f"c{i}" for i in range(k))
    steps = ["e AS (SELECT value AS x FROM events WHERE value IS NOT NULL)", "r0 AS (SELECT " + ", ".join(f"min(x) + (max(x) - min(x)) * {(i + 0.5) / k!r}::DOUBLE AS c{i}" for i in range(k)) + " FROM e)"]
    for j in range(rounds):
        means = ", ".join(f"coalesce(avg(x) FILTER (i = {i + 1}), any_value(c{i})) AS c{i}" for i in range(k))
        steps.append(f"r{j + 1} AS (SELECT {means} FROM (SELECT x, {centres}, {nearest.format(centres, centres)} AS i FROM e, r{j}))")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT {i} AS cluster, round(c{i}, 6) AS centre FROM r{rounds}" for i in range(k))


add("ml_kmeans", "L40", kmeans, kmeans_sql())
