"""Frames against pandas on small tables, and the cases that queries don't reach."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framekit.frame import Frame
from framekit.functions import strings as S
from framekit.operators import group
from framekit.operators.group import pivot_table
from framekit.operators.joins import merge_asof
from framekit.operators.ordering import with_halo
from framekit.operators.sort import ranked
from framekit.sources import readers

DATA = {"A": [0, 1, 3, 2, 1, 0, 3, 2, 1, 0, 3], "B": [5, 3, -2, 8, 0, 1, 1, 2, 7, 9, 4], "C": [1.5, None, 2.0, -1.0, 0.0, 3.5, None, 2.5, 1.0, 1.0, 8.0]}


@pytest.fixture()
def frame(spark):
    return readers.from_dict(spark, DATA, schema="A long, B long, C double")


@pytest.fixture()
def pdf():
    return pd.DataFrame(DATA)


def values(series):
    f = series.to_frame("x")
    return [r[0] for r in f.sdf.orderBy(*f.order).select("x").collect()]


def known(xs):
    return [None if x is None or (isinstance(x, float) and np.isnan(x)) else x for x in xs]


@pytest.mark.parametrize("name", ["sum", "mean", "median", "min", "max", "std", "var", "count", "nunique", "skew"])
def test_reductions(frame, pdf, name):
    got = frame["C"].reduce(name).first()[0]
    assert got == pytest.approx(getattr(pdf["C"], name)())


@pytest.mark.parametrize("name", ["sum", "mean", "min", "max", "std", "count", "median"])
def test_group_by(frame, pdf, name):
    got = frame.groupby("A").reduce(name).spark().toPandas().set_index("A").sort_index()
    want = getattr(pdf.groupby("A"), name)()
    assert np.allclose(got["C"].astype(float), want["C"].astype(float), equal_nan=True)


def test_group_by_selects_once(frame):
    with pytest.raises(IndexError):
        frame.groupby("A")["B"]["C"]


@pytest.mark.parametrize("name", ["sum", "mean", "min", "max", "var", "median", "skew", "kurt", "count"])
@pytest.mark.parametrize("periods", [None, 1, 0])
def test_rolling_without_partition_key(frame, pdf, name, periods):
    got = known(values(getattr(frame["C"].rolling(4, periods), name)()["C"]))
    s = pdf["C"].rolling(4, min_periods=4 if periods is None else periods)
    want = known(getattr(s, name)().tolist())
    if name == "count":
        want = known([float(pdf["C"][max(0, i - 3) : i + 1].notna().sum()) if i + 1 >= (4 if periods is None else periods) else None for i in range(len(pdf))])
    for a, b in zip(got, want, strict=True):
        assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9))


def test_halo_over_small_buckets(spark):
    sdf = spark.range(1000).select(F.col("id"), (F.col("id") % 17).alias("x"))
    spread = with_halo(sdf, ["id"], 19, rows=50)
    from pyspark.sql import Window

    w = Window.partitionBy("__bucket").orderBy("__pos").rowsBetween(-19, 0)
    got = {r[0]: r[1] for r in spread.withColumn("s", F.sum("x").over(w)).where("__own").select("id", "s").collect()}
    assert got == {i: sum(j % 17 for j in range(max(0, i - 19), i + 1)) for i in range(1000)}


def test_ordered_operations(frame, pdf):
    assert known(values(frame["C"].shift(2))) == known(pdf["C"].shift(2).tolist())
    assert known(values(frame["C"].shift(-3))) == known(pdf["C"].shift(-3).tolist())
    for a, b in zip(known(values(frame["C"].cumsum())), known(pdf["C"].cumsum().tolist()), strict=True):
        assert a == (None if b is None else pytest.approx(b))
    assert known(values(frame["C"].cumsum(skipna=False)))[:3] == [1.5, None, None]


def test_argsort_and_sorts(frame, pdf):
    got = values(frame["C"].argsort())
    kept = pdf["C"].dropna().reset_index(drop=True)
    places = iter(kept.argsort(kind="stable"))
    assert got == [-1 if np.isnan(x) else next(places) for x in pdf["C"]]
    assert [r[0] for r in ranked(frame.sort_values("C", ascending=False)).sdf.orderBy("rank").select("C").collect()] == known(pdf["C"].sort_values(ascending=False, kind="stable").tolist())
    assert values(frame["B"].nlargest(3)) is not None
    assert frame["B"].nlargest(0).to_frame().sdf.count() == 0


def test_alignment_of_repeated_labels(spark):
    a = readers.series(spark, [1, 2, 3], ["x", "x", "y"], "int64")
    b = readers.series(spark, [10, 20, 30], ["x", "z", "x"], "int64")
    got = sorted((r[0], r[1]) for r in (lambda s: s.frame.sdf.select("__label0", s.expr).collect())(a + b) if r[1] is not None)
    assert got == [("x", 11.0), ("x", 12.0), ("x", 31.0), ("x", 32.0)]


def test_comparison_of_other_labels_raises(spark):
    a, b = readers.series(spark, [1, 2], ["x", "y"], "int64"), readers.series(spark, [1, 2], ["x", "z"], "int64")
    with pytest.raises(Exception, match="same labels"):
        (a < b).values.collect()


def test_mask_errors(spark, frame):
    short = readers.from_dict(spark, {"m": [True, False]}, schema="m boolean")
    with pytest.raises(Exception, match="not in the mask"):
        frame[short["m"]].spark().collect()


def test_division_and_modulo(spark):
    f = readers.from_dict(spark, {"a": [7.0, -7.0, 1.0, 0.0, -1.0], "b": [-3.0, 3.0, 0.0, 0.0, 0.0]}, schema="a double, b double")
    assert values(f["a"] % f["b"]) == [-2.0, 2.0, None, None, None]
    assert values(f["a"] // f["b"]) == [-3.0, -3.0, float("inf"), None, float("-inf")]
    assert values(f["a"] / f["b"])[2:] == [float("inf"), None, float("-inf")]


TEXTS = ["", " a b ", "ab-cd ef", "ÀÉ x", "ß", "12", "²", "٣", "½", "Ab Cd", "aB", "日本", "+12", "-7", "a.b", None]


@pytest.mark.parametrize("name", ["lower", "title", "capitalize", "swapcase", "casefold", "strip", "lstrip", "rstrip", "isalpha", "isalnum", "isdigit", "isdecimal", "isnumeric", "isspace", "islower", "isupper", "istitle", "length"])
def test_strings_follow_python(spark, name):
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", getattr(S, name)(F.col("t")).alias("r")).orderBy("i").select("r").collect()]
    for t, g in zip(TEXTS, got, strict=True):
        if t is None:
            assert g in (None, False)
        elif not (name in ("swapcase", "capitalize", "title") and "ß" in t):
            assert g == (len(t) if name == "length" else getattr(t, name)()), t


@pytest.mark.parametrize("width", [0, 3, 4, 9])
def test_padding_follows_python(spark, width):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS[:-1])], "i int, t string")
    for name, args in (("center", ("*",)), ("ljust", ("*",)), ("rjust", ("*",)), ("zfill", ())):
        got = [r[0] for r in df.select("i", getattr(S, name)(F.col("t"), width, *args).alias("r")).orderBy("i").select("r").collect()]
        assert got == [getattr(t, name)(width, *args) for t in TEXTS[:-1]], name


def test_positions(frame, pdf):
    assert frame.iat[3, 1] == 8
    with pytest.raises(IndexError):
        _ = frame.iat[99, 0]
    assert [r.B for r in frame[-3:].itertuples()] == pdf["B"][-3:].tolist()
    assert [r.B for r in frame.head(-8).itertuples()] == pdf["B"].head(-8).tolist()
    with pytest.raises(KeyError):
        frame.drop("nope")
    assert frame.drop("nope", errors="ignore").columns == ["A", "B", "C"]


def test_pivot_finds_names(frame, pdf):
    got = pivot_table(frame, "A", "B", "C", "sum").spark().toPandas()
    assert set(got.columns) == {"A", *map(str, sorted(pdf["B"].unique()))}


def test_asof_prefers_the_last_of_equal_times(spark):
    left = Frame(spark.createDataFrame([(1, 10), (2, 20), (3, 5)], "k int, t int"))
    right = Frame(spark.createDataFrame([(10, "a"), (15, "b"), (20, "c")], "t int, v string"))
    assert sorted((r.k, r.v) for r in merge_asof(left, right, "t").spark().collect()) == [(1, "a"), (2, "c"), (3, None)]
    assert sorted((r.k, r.v) for r in merge_asof(left, right, "t", allow_exact=False).spark().collect()) == [(1, None), (2, "b"), (3, None)]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("junk\nx;y;d\n1;;2011-01-01\n2;3.5;2011-02-02\n")
    f = readers.read_csv(spark, str(tmp_path / "a.csv"), sep=";", skiprows=1, dtype={"x": "int64", "y": "float64"}, parse_dates=["d"])
    assert [(r.x, r.y, r.d.year) for r in f.spark().orderBy("x").collect()] == [(1, None, 2011), (2, 3.5, 2011)]
    with pytest.raises(TypeError):
        readers.read_csv(spark, str(tmp_path / "a.csv"), nrows=3)


def test_empty_frame(spark):
    f = Frame(spark.createDataFrame([], "a long, b double"), order=["a"])
    assert f["b"].sum().first()[0] == 0 and f["b"].mean().first()[0] is None
    assert f["b"].rolling(3).mean().spark().count() == 0 and f["b"].cumsum().spark().count() == 0 and f.head(3).spark().count() == 0


def test_streams_equal_batches(spark, tmp_path):
    from framekit.streaming import events as streams
    from tests.conftest import SF

    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    live = streams.windowed(streams.read_stream(spark, str(tmp_path / "in"), f"{SF}/events.parquet"), "ts", "1 hour", by=["event_type"], n=F.count("*"))
    got = {tuple(r) for r in streams.drain(live, "live").collect()}
    assert got == {tuple(r) for r in streams.windowed(batch, "ts", "1 hour", by=["event_type"], n=F.count("*")).collect()}


def test_correlation_without_spread(spark):
    f = readers.from_dict(spark, {"a": [1.0, 1.0, 1.0, 2.0], "b": [1.0, 2.0, 3.0, 5.0]}, schema="a double, b double")
    assert known(values(f.rolling(3, 2)["a"].corr("b")["a"]))[:3] == [None, None, None]
    assert f["a"].corr(f["a"] * 0).first()[0] is None and f["a"].corr(f["a"]).first()[0] == pytest.approx(1)


def test_png_filters_and_sizes():
    import struct
    import zlib

    import numpy as np

    from framekit.sources import images

    r = np.random.default_rng(0)
    for channels in (1, 2, 3, 4):
        a = r.integers(0, 256, (7, 5, channels)).astype(np.uint8)
        assert (images.decode_png(images.encode_png(a)) == a).all()
        above, lines = np.zeros(5 * channels, int), b""
        for kind, line in enumerate(a.reshape(7, -1).astype(int)):  # one line by each filter
            kind %= 5
            left, corner = (np.concatenate([np.zeros(channels, int), x[:-channels]]) for x in (line, above))
            nearest = [min((abs(u - c), 0, x), (abs(x - c), 1, u), (abs(x + u - 2 * c), 2, c))[2] for x, u, c in zip(left, above, corner, strict=True)]
            guess = [0, left, above, (left + above) // 2, np.array(nearest)][kind]
            lines += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
            above = line
        whole = images.encode_png(a)
        at = whole.index(b"IDAT") - 4
        n = struct.unpack_from(">I", whole, at)[0]
        data = zlib.compress(lines)
        assert (images.decode_png(whole[:at] + struct.pack(">I", len(data)) + b"IDAT" + data + b"\0\0\0\0" + whole[at + 12 + n :]) == a).all()
        assert (images.resize(a, 7, 5) == a).all()
    flat = np.full((3, 4, 1), 9, np.uint8)
    assert (images.resize(flat, 10, 2) == 9).all()


def test_skipped_rows_of_split_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("# made by\n\na,b\n" + "".join(f"{k},{i}\n" for i in range(400)) + "a,b\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = [(x["a"], x["b"]) for x in readers.read_csv(spark, str(tmp_path), skiprows=2, dtype={"a": "str", "b": "str"}).spark().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(rows) == sorted([(str(k), str(i)) for k in range(3) for i in range(400)] + [("a", "b")] * 3)


@pytest.mark.parametrize("rows", [[3.0, None, 1.0, 1.0, 7.5, -2.0, 1.0], [float(x % 97) for x in range(1000)], [x * x / 7 for x in range(501)], [4.0], [1.0] * 50 + [2.0] * 50])
def test_quantiles_over_ranges(spark, rows):
    f = Frame(spark.createDataFrame([(x, None if x is None else -2 * x) for x in rows], "a double, b double"), ["a", "b"])
    want = pd.DataFrame({"a": rows, "b": [None if x is None else -2 * x for x in rows]}, dtype=float)
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    assert f["a"].quantile(points).first()[0] == pytest.approx(want["a"].quantile(points).tolist())
    assert {r["column"]: r["value"] for r in f.median().collect()} == pytest.approx(want.median().to_dict())
    got = f.describe([0.1]).toPandas().set_index("stat")
    assert np.allclose(got, want.describe(percentiles=[0.1, 0.5]).loc[got.index], equal_nan=True)


def test_quantiles_of_nothing(spark):
    f = Frame(spark.createDataFrame([(None,), (None,)], "a double"), ["a"])
    assert f["a"].median().first()[0] is None and f["a"].quantile([0.1, 0.2]).first()[0] is None
    got = f.describe().toPandas().set_index("stat")["a"]
    assert got["count"] == 0 and got.drop("count").isna().all()
    some = Frame(spark.createDataFrame([(1.0,), (None,)], "a double"), ["a"])
    assert some["a"].reduce("median", skipna=False).first()[0] is None and some["a"].median().first()[0] == 1
    assert Frame(spark.createDataFrame([], "a double"), ["a"])["a"].median().first()[0] is None
    with pytest.raises(ValueError):
        some["a"].quantile(1.5)


def test_pivot_of_too_many_names(spark, monkeypatch):
    f = Frame(spark.createDataFrame([(1, c, 1.0) for c in "dcba"], "k long, c string, v double"), ["k", "c", "v"])
    assert pivot_table(f, "k", "c", "v").columns == ["a", "b", "c", "d"]
    monkeypatch.setattr(group, "MAX_NAMES", 3)
    with pytest.raises(ValueError):
        pivot_table(f, "k", "c", "v")


@pytest.mark.parametrize("by", [[], ["u"]])
@pytest.mark.parametrize("name", ["sum", "mean", "min", "max", "var", "std", "count"])
def test_windows_of_time_against_pandas(spark, by, name):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": range(300), "u": rng.integers(0, 3, 300), "t": pd.Timestamp("1969-12-31 23:00") + pd.to_timedelta(np.sort(rng.integers(0, 200, 300)) * 30, unit="s"), "x": np.where(rng.random(300) < 0.2, np.nan, rng.normal(0, 9, 300))})
    f = Frame.of(spark.createDataFrame(pdf), index=["k"], order=["k"], by=by, columns=list(pdf.columns))
    got = getattr(f[["x", "t"]].rolling("7min", on="t"), name)().spark().toPandas().sort_values("k")["x"].to_numpy(float)

    def of(row):
        held = pdf[(pdf["t"] > row["t"] - pd.Timedelta("7min")) & (pdf["t"] <= row["t"]) & ((pdf["u"] == row["u"]) if by else True)]["x"].dropna()
        return getattr(held, name)() if len(held) or name == "count" else np.nan

    assert np.allclose(got, pdf.apply(of, axis=1).to_numpy(float), equal_nan=True)


def test_windows_of_time_cost_no_more_where_they_hold_more(spark):
    n = 60000  # one span holds them all: each row's window gone through anew takes some 2,000,000,000 steps
    sdf = spark.range(n).select(F.col("id").alias("k"), F.timestamp_micros(F.col("id")).alias("t"), F.lit(1.0).alias("x"))
    f = Frame.of(sdf, index=["k"], order=["k"], columns=["x", "t"])
    started = time.monotonic()
    assert f[["x", "t"]].rolling("1h", on="t").sum().spark().agg(F.sum("x")).first()[0] == n * (n + 1) / 2
    assert time.monotonic() - started < 15


@pytest.mark.parametrize("by", [[], ["u"]])
def test_backward_fill_costs_no_more_for_long_sequences(spark, by):
    n = 150000
    sdf = spark.range(n).select(F.col("id").alias("k"), F.lit(1).alias("u"), F.when(F.col("id") % 3 == 2, F.col("id").cast("double")).alias("x"))
    f = Frame.of(sdf, index=["k"], order=["k"], by=by, columns=["x"])
    started = time.monotonic()
    got = f.pct_change(1, "bfill").spark().orderBy("k").limit(7).collect()
    assert [r[1] for r in got] == [None, 0, 0, 1.5, 0, 0, 0.6000000000000001]
    assert time.monotonic() - started < 30


@pytest.mark.parametrize("window", [4, 300])
@pytest.mark.parametrize("by", [[], ["u"]])
def test_rolling_apply_gives_known_values_of_each_window(spark, window, by):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"k": range(700), "u": rng.integers(0, 2, 700), "x": np.where(rng.random(700) < 0.3, np.nan, rng.normal(0, 9, 700))})
    f = Frame.of(spark.createDataFrame(pdf), index=["k"], order=["k"], by=by, columns=list(pdf.columns))
    function = lambda x: float(x.iloc[-1] - x.min()) if len(x) > 2 else float("nan")
    got = f[["x"]].rolling(window, 2).apply(function).spark().toPandas().sort_values("k")["x"].to_numpy(float)
    parts = [g for _, g in pdf.groupby("u")] if by else [pdf]
    want = pd.concat([pd.Series([function(g["x"].iloc[max(0, i - window + 1) : i + 1].dropna()) for i in range(len(g))], g.index) for g in parts]).sort_index()
    assert np.allclose(got, want.to_numpy(float), equal_nan=True)


def test_rolling_apply_leaves_out_windows_with_too_few_values(frame):
    got = known(values(frame["C"].rolling(3, 2).apply(lambda x: x.iloc[1])["C"]))
    assert got == [None, None, 2.0, -1.0, -1.0, 0.0, 3.5, 2.5, 1.0, 1.0, 1.0]
