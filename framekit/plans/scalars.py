"""Arithmetic, comparison, strings, dates, user functions (inventory §2.8, §2.10), maps, sets and categories (§2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import Series
from ..functions import collections as C
from ..functions import index as I  # noqa: E741
from ..functions import strings as S
from ..functions import temporal as T
from .registry import EVENTS, add, events, load, rounded

E = EVENTS
#: With b, which is negative, zero or missing at times.
B = f"(SELECT *, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 7 - 3 END AS b FROM {E})"


def with_b(s, d):
    return events(s, d).set_column("b", F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 7 - 3))


SQL = {
    "add": ("v + b", "OP-169"), "sub": ("v - b", "OP-170"), "mul": ("v * b", "OP-171"), "div": ("CASE WHEN b = 0 AND v = 0 THEN NULL ELSE v / b END", "OP-172"),
    "truediv": ("CASE WHEN b = 0 AND v = 0 THEN NULL ELSE v / b END", "OP-173"), "floordiv": ("CASE WHEN b = 0 AND v = 0 THEN NULL WHEN b = 0 THEN v / b ELSE floor(v / b) END", "OP-174"),
    "mod": ("CASE WHEN b <> 0 THEN v - b * floor(v / b) END", "OP-175"), "pow": ("CASE WHEN v IS NULL OR b IS NULL THEN NULL ELSE pow(v, b) END", "OP-176"),
}
for name, (sql, row) in SQL.items():
    double = sql.replace("v / b", "v / CAST(b AS DOUBLE)")
    add(f"op_{name}", f"{row} OP-183", lambda s, d, name=name: rounded((lambda f: getattr(f["v"], name)(f["b"]).rename("r").spark())(with_b(s, d)), 4), f"SELECT event_id, round(CAST({double} AS DOUBLE), 4) AS r FROM {B}")
add("op_scalar", "OP-183", lambda s, d: rounded((lambda f: f.set_column("a", f["v"] + 2).set_column("c", 10 - f["v"]).set_column("e", f["v"] * f["w"] / 2)[["a", "c", "e"]].spark())(events(s, d)), 4), f"SELECT event_id, round(v + 2, 4) AS a, round(10 - v, 4) AS c, round(v * w / 2, 4) AS e FROM {E}")
for name, sign in {"lt": "<", "gt": ">", "le": "<=", "ge": ">=", "ne": "<>", "eq": "="}.items():
    row = f"OP-{dict(lt=177, gt=178, le=179, ge=180, ne=181, eq=182)[name]}"
    default = "true" if name == "ne" else "false"
    add(f"cmp_{name}", f"{row} OP-184", lambda s, d, name=name: (lambda f: f.set_column("r", getattr(f["w"], name)(f["b"])).set_column("k", getattr(f["v"], name)(50.0))[["r", "k"]].spark())(with_b(s, d)), f"SELECT event_id, coalesce(w {sign} b, {default}) AS r, coalesce(v {sign} 50, {default}) AS k FROM {B}")
add("cmp_fill", "OP-177", lambda s, d: (lambda f: f["w"].lt(f["b"], fill_value=1).rename("r").spark())(with_b(s, d)), f"SELECT event_id, coalesce(coalesce(w, CASE WHEN b IS NOT NULL THEN 1 END) < coalesce(b, CASE WHEN w IS NOT NULL THEN 1 END), false) AS r FROM {B}")


def compare_frames(s, d):
    a, b = events(s, d), events(s, d)
    both = a["value"] < b["w"]
    return both.frame.sdf.select(F.col("__label0").alias("event_id"), both.expr.alias("r"))


add("cmp_aligned", "OP-184", compare_frames, f"SELECT event_id, coalesce(value < w, false) AS r FROM {E}")
add("cmp_strings", "OP-185", lambda s, d: (lambda f: f.set_column("r", f["event_type"] < "purchase").set_column("q", f["event_type"] == "view")[["r", "q"]].spark())(events(s, d)), "SELECT event_id, event_type < 'purchase' AS r, event_type = 'view' AS q FROM events")
add("str_concat", "OP-186 OP-188", lambda s, d: (lambda f: f["p_brand"].concat_text(f["p_type"]).rename("r").values)(load(s, d, "part")), "SELECT p_brand || p_type AS r FROM part")
add("str_repeat", "OP-187 OP-189", lambda s, d: load(s, d, "part")["p_brand"].repeat_text(3).rename("r").values, "SELECT repeat(p_brand, 3) AS r FROM part")
add("op_abs", "OP-190", lambda s, d: rounded((lambda f: (f["v"] - 50).abs().rename("r").spark())(events(s, d)), 4), f"SELECT event_id, round(abs(v - 50), 4) AS r FROM {E}")
add("op_logic", "§2.2 predicates", lambda s, d: (lambda f: ((f["value"] > 20.0) & ~(f["w"] > 30) | (f["user_id"] == 7)).rename("r").spark())(events(s, d)), f"SELECT event_id, (value > 20 AND NOT coalesce(w > 30, false)) OR user_id = 7 AS r FROM {E}")
add("op_math", "§2.8.1 math", lambda s, d: rounded(events(s, d)["value"].map(lambda c: F.sqrt(F.log1p(F.abs(c)))).rename("r").spark(), 6), "SELECT event_id, round(sqrt(ln(1 + abs(value))), 6) AS r FROM events")

# strings, over the names of parts and the first words of documents
T_ = "(SELECT p_partkey, p_name, CASE p_partkey % 5 WHEN 0 THEN '  ' || p_name || ' ' WHEN 1 THEN upper(p_name) WHEN 2 THEN '-' || p_partkey WHEN 3 THEN 'a' || p_size ELSE '' END AS t FROM part)"


def texts(s, d):
    f = load(s, d, "part", index=["p_partkey"], order=["p_partkey"], columns=["p_name", "p_size"])
    k = F.col("p_partkey") % 5
    t = F.when(k == 0, F.concat(F.lit("  "), "p_name", F.lit(" "))).when(k == 1, F.upper("p_name")).when(k == 2, F.concat(F.lit("-"), F.col("p_partkey").cast("string"))).when(k == 3, F.concat(F.lit("a"), F.col("p_size").cast("string"))).otherwise("")
    return f.set_column("t", t)["t"]


def string_query(name: str, row: str, f, sql: str) -> None:
    add(f"str_{name}", row, lambda s, d: f(texts(s, d)).rename("r").spark(), f"SELECT p_partkey, {sql} AS r FROM {T_}")


string_query("len", "OP-191", lambda x: x.str.len(), "length(t)")
string_query("lower", "OP-192", lambda x: x.str.lower(), "lower(t)")
string_query("upper", "OP-193", lambda x: x.str.upper(), "upper(t)")
string_query("capitalize", "OP-194", lambda x: x.str.capitalize(), "upper(substr(t, 1, 1)) || lower(substr(t, 2))")
string_query("title", "OP-195", lambda x: x.str.title(), "array_to_string(list_transform(range(1, length(t) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches(substr(t, i - 1, 1), '[A-Za-z]') THEN lower(substr(t, i, 1)) ELSE upper(substr(t, i, 1)) END), '')")
string_query("swapcase", "OP-196", lambda x: x.str.swapcase(), "array_to_string(list_transform(range(1, length(t) + 1), lambda i: CASE WHEN substr(t, i, 1) = upper(substr(t, i, 1)) THEN lower(substr(t, i, 1)) ELSE upper(substr(t, i, 1)) END), '')")
string_query("casefold", "OP-197", lambda x: x.str.casefold(), "lower(t)")
string_query("strip", "OP-198", lambda x: x.str.strip(), "trim(t)")
string_query("strip_chars", "OP-198", lambda x: x.str.strip("a-0"), "trim(t, 'a-0')")
string_query("lstrip", "OP-199", lambda x: x.str.lstrip(), "ltrim(t)")
string_query("rstrip", "OP-200", lambda x: x.str.rstrip(), "rtrim(t)")
string_query("center", "OP-201", lambda x: x.str.center(20, "*"), "CASE WHEN length(t) < 20 THEN repeat('*', (20 - length(t)) // 2) || t || repeat('*', 20 - length(t) - (20 - length(t)) // 2) ELSE t END")
string_query("ljust", "OP-202", lambda x: x.str.ljust(8, "."), "CASE WHEN length(t) < 8 THEN rpad(t, 8, '.') ELSE t END")
string_query("rjust", "OP-203", lambda x: x.str.rjust(8, "."), "CASE WHEN length(t) < 8 THEN lpad(t, 8, '.') ELSE t END")
string_query("zfill", "OP-204", lambda x: x.str.zfill(8), "CASE WHEN length(t) >= 8 THEN t WHEN t LIKE '-%' THEN '-' || lpad(substr(t, 2), 7, '0') ELSE lpad(t, 8, '0') END")
string_query("contains", "OP-205 OP-225", lambda x: x.str.contains("a1"), "contains(t, 'a1')")
string_query("contains_nocase", "OP-205", lambda x: x.str.contains("A", case=False), "contains(lower(t), 'a')")
string_query("contains_regex", "OP-224 L32", lambda x: x.str.contains("^a[1-3]", regex=True), "regexp_matches(t, '^a[1-3]')")
string_query("startswith", "OP-206", lambda x: x.str.startswith("-1"), "starts_with(t, '-1')")
string_query("endswith", "OP-207", lambda x: x.str.endswith("5"), "ends_with(t, '5')")
string_query("find", "OP-208", lambda x: x.str.find("1"), "instr(t, '1') - 1")
string_query("isalpha", "OP-209", lambda x: x.str.isalpha(), "regexp_full_match(t, '[A-Za-z]+')")
string_query("isalnum", "OP-210", lambda x: x.str.isalnum(), "regexp_full_match(t, '[A-Za-z0-9]+')")
string_query("isdigit", "OP-211", lambda x: x.str.isdigit(), "regexp_full_match(t, '[0-9]+')")
string_query("isdecimal", "OP-212", lambda x: x.str.isdecimal(), "regexp_full_match(t, '[0-9]+')")
string_query("isnumeric", "OP-213", lambda x: x.str.isnumeric(), "regexp_full_match(t, '[0-9]+')")
string_query("isspace", "OP-214", lambda x: x.str.isspace(), "regexp_full_match(t, '\\s+')")
string_query("islower", "OP-215", lambda x: x.str.islower(), "t = lower(t) AND t <> upper(t)")
string_query("isupper", "OP-216", lambda x: x.str.isupper(), "t = upper(t) AND t <> lower(t)")
string_query("istitle", "OP-217", lambda x: x.str.istitle(), "lower(t) <> upper(t) AND NOT regexp_matches(t, '[A-Za-z][A-Z]') AND NOT regexp_matches(t, '(^|[^A-Za-z])[a-z]')")
string_query("replace", "OP-218 L31", lambda x: x.str.replace("1", "one"), "replace(t, '1', 'one')")
string_query("replace_regex", "OP-219 OP-220 L31", lambda x: x.str.replace("[0-9]+", "#", regex=True), "regexp_replace(t, '[0-9]+', '#', 'g')")
string_query("join", "OP-221", lambda x: x._map(lambda c: S.join(F.array(c, F.lit("x"), c), "-")), "t || '-x-' || t")
string_query("to_int", "OP-222 OP-226", lambda x: x._map(S.to_int), "TRY_CAST(CASE WHEN regexp_full_match(trim(t), '-?[0-9]+') THEN trim(t) END AS BIGINT)")
string_query("to_float", "OP-226 L33", lambda x: x._map(S.to_float), "TRY_CAST(CASE WHEN regexp_full_match(trim(t), '-?[0-9]+') THEN trim(t) END AS DOUBLE)")
add("str_of_number", "OP-223", lambda s, d: load(s, d, "part")["p_size"].astype("string").rename("r").values, "SELECT CAST(p_size AS VARCHAR) AS r FROM part")
add("str_split_get", "L30", lambda s, d: (lambda x: x._map(lambda c: S.get(S.split(c, " "), 0)).rename("r").values)(load(s, d, "documents")["text"]), "SELECT string_split(text, ' ')[1] AS r FROM documents")
add("str_flatten", "L30", lambda s, d: load(s, d, "part").sdf.select("p_partkey", F.explode(S.split(F.col("p_name"), " ")).alias("r")), "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS r FROM part")

# dates
FIELDS = {"year": "year(ts)", "month": "month(ts)", "day": "day(ts)", "hour": "hour(ts)", "minute": "minute(ts)", "second": "second(ts)", "dayofyear": "dayofyear(ts)", "dayofweek": "isodow(ts) - 1", "quarter": "quarter(ts)", "week": "weekofyear(ts)", "microsecond": "microsecond(ts) % 1000000"}


def fields(s, d):
    f = events(s, d)
    for n in FIELDS:
        f = f.set_column(n, Series(f, f["ts"].expr, "ts").dt.__getattr__(n))
    return f[list(FIELDS)].spark()


add("dt_fields", "OP-227 L34 L36", fields, f"SELECT event_id, {', '.join(f'{e} AS {n}' for n, e in FIELDS.items())} FROM events")
add("dt_date", "OP-228 L36", lambda s, d: events(s, d)["ts"].dt.date.rename("day").spark(), "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
add("dt_parse", "OP-229 L34", lambda s, d: events(s, d)["ts"]._map(lambda c: T.timestamp(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))).rename("t").spark(), "SELECT event_id, date_trunc('second', ts) AS t FROM events")
add("dt_make_date", "OP-230", lambda s, d: events(s, d)["ts"]._map(lambda c: T.make_date(F.year(c), F.month(c), F.lit(1))).rename("t").spark(), "SELECT event_id, make_date(year(ts), month(ts), 1) AS t FROM events")
add("dt_make_datetime", "OP-231", lambda s, d: events(s, d)["ts"]._map(lambda c: T.make_datetime(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.lit(0), F.lit(0))).rename("t").spark(), "SELECT event_id, date_trunc('hour', ts) AS t FROM events")
add("dt_extremes", "L34", lambda s, d: events(s, d).sdf.agg(F.min("ts").alias("first"), F.max("ts").alias("last")), "SELECT min(ts) AS first, max(ts) AS last FROM events")
add("dt_compare", "L34", lambda s, d: (lambda f: (f["ts"] < F.lit("2024-01-15").cast("timestamp_ntz")).rename("r").spark())(events(s, d)), "SELECT event_id, ts < TIMESTAMP '2024-01-15' AS r FROM events")
GAP = "(SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id)) AS g FROM events)"


def deltas(s, d):
    f = events(s, d)
    f = f.set_column("g", T.difference(F.col("ts"), F.lag("ts").over(f.window())))
    p = T.parts(F.col("g"))
    return f.sdf.select("event_id", *[e.cast("long").alias(n) for n, e in p.items() if n != "nanoseconds"])


add("dt_timedelta", "L35", deltas, f"SELECT event_id, CAST(floor(g / 86400000000) AS BIGINT) AS days, CAST(floor((g - floor(g / 86400000000) * 86400000000) / 1000000) AS BIGINT) AS seconds, CAST(g - floor(g / 1000000) * 1000000 AS BIGINT) AS microseconds FROM {GAP}")
add("dt_map", "L37", lambda s, d: events(s, d)["ts"].map(lambda c: F.year(c) * 100 + F.month(c)).rename("r").spark(), "SELECT event_id, year(ts) * 100 + month(ts) AS r FROM events")

# user functions
add("udf_map_expression", "OP-232", lambda s, d: rounded(events(s, d)["v"].map(lambda c: c * 2 + 1).spark("v"), 4), f"SELECT event_id, round(v * 2 + 1, 4) AS v FROM {E}")
add("udf_map_python", "OP-232", lambda s, d: rounded(events(s, d)["v"].map(lambda x: x * 2 + 1, returns="double").spark("v"), 4), f"SELECT event_id, round(v * 2 + 1, 4) AS v FROM {E}")
add("udf_map_dict", "OP-233", lambda s, d: events(s, d)["event_type"].map({"click": 1, "view": 2}).rename("r").spark(), "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS r FROM events")
add("udf_apply", "OP-234", lambda s, d: rounded(events(s, d)["value"].apply(lambda x: abs(x) ** 0.5, returns="double").spark("value"), 4), "SELECT event_id, round(sqrt(abs(value)), 4) AS value FROM events")
add("udf_apply_rows", "L25", lambda s, d: rounded(events(s, d)[["value", "user_id"]].apply(lambda r: float(r["value"] + r["user_id"]), "double").rename("r").spark(), 4), "SELECT event_id, round(value + user_id, 4) AS r FROM events")

# maps, sets, categories, indexes
NATIONS = "SELECT n_regionkey, {e} AS r FROM nation GROUP BY n_regionkey"


def per_region(f):
    return lambda s, d: s.read.parquet(f"{d}/nation.parquet").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("ks")).select("n_regionkey", f(F.col("ks")).alias("r"))


add("map_from_arrays", "§2.11 dict", per_region(lambda ks: F.size(C.map_from(ks, F.transform(ks, lambda k: k * 2)))), NATIONS.format(e="count(*)"))
add("map_get", "§2.11 dict", per_region(lambda ks: C.map_get(C.map_from(ks, F.transform(ks, lambda k: k * 2)), F.lit(8), F.lit(-1))), NATIONS.format(e="coalesce(max(CASE WHEN n_nationkey = 8 THEN 16 END), -1)"))
add("map_update_pop", "§2.11 dict", per_region(lambda ks: F.size(C.map_pop(C.map_update(C.map_from_keys(ks, F.lit(0)), C.map_of({100: 1})), F.lit(8)))), NATIONS.format(e="count(*) + 1 - count(CASE WHEN n_nationkey = 8 THEN 1 END)"))
add("set_add_contains", "§2.11 set", per_region(lambda ks: C.set_contains(C.set_add(ks, F.lit(3)), F.lit(3))), NATIONS.format(e="true"))
add("cat_codes", "§2.11 categorical", lambda s, d: C.as_category(s.read.parquet(f"{d}/events.parquet"), "event_type", ["view", "click"]).select("event_id", "event_type"), "SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE -1 END AS event_type FROM events")
add("index_range", "§2.11 index", lambda s, d: I.range_index(s, 3, 50, 4), "SELECT range AS index FROM range(3, 50, 4)")
add("index_contains", "§2.11 index", lambda s, d: I.contains(s.read.parquet(f"{d}/nation.parquet").select("n_nationkey"), 7), "SELECT bool_or(n_nationkey = 7) AS contains FROM nation")
add("index_equals", "§2.11 index", lambda s, d: I.equals(s.range(5).toDF("a"), s.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("long").alias("b")), ["a"], ["b"]), "SELECT true AS equals")
add("index_product", "§2.11 multi-index", lambda s, d: I.from_product([("a", s.read.parquet(f"{d}/region.parquet").select("r_name")), ("b", s.range(3))]), "SELECT r_name AS a, range AS b FROM region, range(3)")
add("index_codes", "§2.11 multi-index", lambda s, d: I.codes(s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name"), "n_name"), "SELECT n_nationkey, n_name, dense_rank() OVER (ORDER BY n_name) - 1 AS code FROM nation")


def nations(s, d, where="true"):
    return s.read.parquet(f"{d}/nation.parquet").where(where).select(F.col("n_nationkey").alias("k"))


PLACED = "(SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation WHERE {})"
add("index_take", "§2.11 index", lambda s, d: I.take(nations(s, d), ["k"], s.createDataFrame([(3,), (0,), (-1,), (3,)], "at long")), f"SELECT a AS \"at\", k FROM (VALUES (3), (0), (-1), (3)) t(a) JOIN {PLACED.format('true')} ON p = CASE WHEN a < 0 THEN a + (SELECT count(*) FROM nation) ELSE a END")
add("index_append", "§2.11 index", lambda s, d: I.append(nations(s, d, "n_nationkey > 20"), nations(s, d, "n_nationkey < 3"), ["k"], ["k"]), f"SELECT p AS position, k FROM {PLACED.format('n_nationkey > 20')} UNION ALL SELECT p + (SELECT count(*) FROM nation WHERE n_nationkey > 20), k FROM {PLACED.format('n_nationkey < 3')}")
add("index_join", "§2.11 index", lambda s, d: I.join(nations(s, d, "n_nationkey % 2 = 0"), nations(s, d, "n_nationkey % 3 = 0"), ["k"], ["k"]), f"SELECT k, coalesce(x.p, -1) AS left, coalesce(y.p, -1) AS right FROM {PLACED.format('n_nationkey % 2 = 0')} x FULL JOIN {PLACED.format('n_nationkey % 3 = 0')} y USING (k)")
add("index_eq", "§2.11 index", lambda s, d: I.compare(nations(s, d), s.range(0, 50, 2).toDF("k"), ["k"], ["k"]), f"SELECT p AS position, k = 2 * p AS eq FROM {PLACED.format('true')}")
add("index_from_tuples", "§2.11 multi-index", lambda s, d: I.from_tuples(s, [("a", 2), ("b", 1), ("a", 1)], ["x", "y"]), "SELECT * FROM (VALUES (0, 'a', 2), (1, 'b', 1), (2, 'a', 1)) t(position, x, y)")
add("index_levels", "§2.11 multi-index", lambda s, d: I.levels(s.read.parquet(f"{d}/customer.parquet"), "c_mktsegment"), "SELECT row_number() OVER (ORDER BY c_mktsegment) - 1 AS code, c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)")
