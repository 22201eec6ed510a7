"""Prefix scans, medians of many groups, inversion counting, and folders of delimited files."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from borefield.operators import concordance, monthly, profile, selection
from borefield.operators.scan import positions, running_sum
from borefield.sources import folder
from borefield.sources.layers import LayerError, select_layer


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_running_sums_of_a_key_that_many_parts_hold(spark, many_parts):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"k": rng.choice([0.0, 1.0, np.nan], 3000, p=[0.8, 0.1, 0.1]), "t": rng.permutation(3000), "w": rng.integers(1, 9, 3000)})
    df = spark.createDataFrame(rows).withColumn("k", F.when(~F.isnan("k"), F.col("k").cast("int")))
    got = running_sum(df, ["k"], ["t"], "before", F.col("w")).toPandas()
    assert len(got) == 3000
    ordered = rows.sort_values("t")
    expect = (ordered.groupby("k", dropna=False)["w"].cumsum() - ordered["w"]).set_axis(ordered["t"])
    assert (got.set_index("t")["before"].sort_index() == expect.sort_index()).all()
    placed = positions(df, [], ["t"]).toPandas()
    assert (placed["position"] == placed["t"]).all()
    assert positions(df.limit(0), ["k"], ["t"]).count() == 0


@pytest.mark.parametrize("few", [1, 3, 40, 10_000])
def test_medians_of_all_groups_at_once(spark, few):
    rng = np.random.default_rng(2)
    groups = {
        "normal": rng.normal(size=1501), "even": rng.normal(size=1500), "codes": rng.integers(0, 5, 800).astype(float), "one value": np.full(700, 7.0),
        "mostly": np.array([7.0] * 900 + [1.0, 2.0]), "halves": np.array([1.0] * 500 + [2.0] * 500), "single": np.array([3.0]), "pair": np.array([1.0, 4.0]), None: np.arange(20.0),
        "wide": rng.normal(size=301) * 10.0 ** rng.integers(-9, 9, 301), "infinite": np.array([-np.inf, 0.0, np.inf, np.inf]),
    }
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("none", None), ("normal", None)]
    df = spark.createDataFrame(rows, "k string, value double")
    got = {r.k: r for r in selection.exact_medians(df, ["k"], few=few).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        ordered = np.sort(x)
        assert (got[k].n, got[k].lower, got[k].upper) == (len(x), ordered[(len(x) - 1) // 2], ordered[len(x) // 2]), k
    weighted = df.groupBy("k", "value").agg(F.count("*").alias("times"))
    assert {r.k: r.median for r in selection.exact_medians(weighted, ["k"], weight=F.col("times"), few=few).collect()} == {k: r.median for k, r in got.items()}
    assert selection.exact_medians(df.limit(0), ["k"]).count() == 0


def test_a_crowded_month(spark):
    df = spark.range(200_000).select(F.lit(1).alias("bore_id"), F.to_date(F.lit("2020-05-05")).alias("observed_at"), ((F.col("id") * 7919) % 200_003).cast("double").alias("value"))
    a, b = (monthly.monthly_median(df, bounded=bounded).first() for bounded in (False, True))
    assert a == b


def slow_s(x):
    return float(sum(np.sign(x[i + 1 :] - v).sum() for i, v in enumerate(x)))


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_inversions(spark, many_parts, block):
    rng = np.random.default_rng(5)
    series = {1: rng.normal(size=200), 2: rng.integers(0, 4, 333).astype(float), 3: np.arange(65.0), 4: -np.arange(64.0), 5: np.ones(9), 6: np.array([2.0]), None: rng.integers(0, 100, 150).astype(float)}
    rows = [(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)] + [(1, 1000, None), (7, 1, None)]
    df = spark.createDataFrame(rows, "k int, t int, value double").orderBy(F.rand(3))
    got = {r.k: (r.n, r.s) for r in concordance.kendall_s(df, "k", ["t"], block=block).collect()}
    assert got == {k: (len(x), slow_s(x)) for k, x in series.items()}


def test_one_long_series(spark, many_parts):
    """A single key of 200,000 readings; no task orders more than a block of it."""
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), ((F.col("id") * 48_271) % 65_537).cast("double").alias("value"))
    x = np.arange(n) * 48_271 % 65_537
    less, ranks, s = np.zeros(65_538, np.int64), x + 1, 0
    for i, r in enumerate(ranks.tolist()):  # a Fenwick tree of values seen
        k, below, upto = r - 1, 0, 0
        while k:
            below += less[k]
            k &= k - 1
        k = r
        while k:
            upto += less[k]
            k &= k - 1
        s += 2 * below + (upto - below) - i
        k = r
        while k < len(less):
            less[k] += 1
            k += k & -k
    assert concordance.kendall_s(df, "k", ["t"], block=1 << 12).first().s == float(s)


@pytest.mark.parametrize("short", [0, 100, 1000])
def test_short_and_long_series_together(spark, monkeypatch, short):
    """Series of up to so many values are gathered, the rest is counted by inversions; all give the same."""
    rng = np.random.default_rng(9)
    series = {1: rng.normal(size=300), 2: rng.integers(0, 4, 90).astype(float), 3: np.ones(9), 4: np.array([2.0]), None: rng.integers(0, 9, 150).astype(float)}
    df = spark.createDataFrame([(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)] + [(2, 99, None)], "k int, t int, value double").orderBy(F.rand(3))
    counted, real = [], concordance._by_inversions
    monkeypatch.setattr(concordance, "_by_inversions", lambda values, *a: counted.append({r.k for r in values.select("k").collect()}) or real(values, *a))
    got = {r.k: (r.n, r.s) for r in concordance.kendall_s(df, "k", ["t"], short=short).collect()}
    assert got == {k: (len(x), slow_s(x)) for k, x in series.items()}
    assert counted == ([{k for k, x in series.items() if len(x) > short}] if short < 300 else [])


FILES = {
    "a/wells.csv": (",", ["id", "name", "depth"], [[i, f"W, {i % 3}", i * 1.5] for i in range(40)]),
    "a/b/more.csv": (",", ["id", "flag"], [[i, i % 2 == 0] for i in range(5)]),
    "codes.tsv": ("\t", ["code", "n"], [["ab|c,d", 3], ["", 4], ["NA", ""], ["x", -1e3]]),
    "dates.txt": ("|", ["when", "day"], [[f"{d}/{1 + d % 2}/2004", f"{1 + d % 9}/3/2004"] for d in range(1, 29)]),
    "quoted.psv": ("|", ["q", "r"], [['say "hi"', "a|b"], ["", "c"], ["plain", "d"]]),
    "one.csv": (",", ["only"], [[i] for i in range(20)]),
    "empty.csv": (",", ["p", "q"], []),
    "gone.tsv": ("\t", ["all_missing", "n"], [["NULL", 1], ["n/a", 2]]),
    "long.csv": (",", ["key", "value"], [[f"k{i}", i % 7] for i in range(3000)]),
    "odd name [1].csv": (",", ["x"], [[2.5], [3.5]]),
}


def by_pandas(path, delimiter):
    """The profile of one file, read by another library."""
    frame = pd.read_csv(path, sep=delimiter, dtype=str)
    out = {}
    for c in frame.columns:
        x = frame[c].dropna()
        truth = x.isin(["True", "False"]).all()
        numbers = x.map({"True": 1.0, "False": 0.0}) if truth else pd.to_numeric(x, errors="coerce")
        if not len(x):
            out[c] = ("empty", len(frame), len(frame), None, None, None, None, None)
        elif numbers.notna().all():
            out[c] = ("number", len(frame), int(frame[c].isna().sum()), numbers.min(), numbers.median(), numbers.max(), None, None)
        else:
            out[c] = ("text", len(frame), int(frame[c].isna().sum()), None, None, None, x.nunique(), "|".join(sorted(x.unique())) if x.nunique() <= 12 else None)
    return out


def test_ten_files_of_three_delimiters_in_one_go(spark, tmp_path):
    for name, (delimiter, columns, rows) in FILES.items():
        path = tmp_path / "raw" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        pd.DataFrame(rows, columns=columns).to_csv(path, sep=delimiter, index=False)
    (tmp_path / "raw/springs.csv").write_text("a,b\n1,2\n")
    (tmp_path / "raw/photo.bin").write_bytes(b"\0")
    listed, found = folder.inspect_folder(spark, str(tmp_path / "raw"))
    assert listed.count() == 12 and listed.where("excluded_theme = 'spring'").count() == 1
    rows = found.collect()
    for name, (delimiter, columns, body) in FILES.items():
        own = {r.column: r for r in rows if r.source.endswith("/" + name.replace(" ", "%20").replace("[", "%5B").replace("]", "%5D")) or r.source.endswith("/" + name)}
        if not body:
            assert own == {}  # a header alone has no values
            continue
        assert [r.column for r in sorted(own.values(), key=lambda r: r.position)] == columns
        assert {r.delimiter for r in own.values()} == {delimiter}
        expect = by_pandas(tmp_path / "raw" / name, delimiter)
        assert {c: (r.kind, r.n_rows, r.n_null, r.least, r.median, r.greatest, r.n_distinct, r.codes) for c, r in own.items()} == expect
    orders = {r.column: r.date_order for r in rows if "dates" in r.source}
    assert orders == {"when": "day_first", "day": "ambiguous"}
    assert not [r for r in rows if "springs" in r.source]


def test_ragged_lines_and_crlf(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes(b'\xef\xbb\xbfa,b\r\n1,"x ""y"", z"\r\n\r\n2\r\n3,w,extra\r\n')
    found = {r.position: r for r in folder.inspect_files(spark, [str(tmp_path / "r.csv")]).collect()}
    assert (found[0].column, found[0].n_rows, found[0].greatest) == ("a", 3, 3.0)
    assert (found[1].column, found[1].n_null, found[1].codes) == ("b", 1, 'w|x "y", z')
    assert (found[2].column, found[2].n_rows, found[2].codes) == (None, 1, "extra")


def test_only_texts_are_counted_by_value(spark, tmp_path, monkeypatch):
    """Numbers are written once and meet only the medians' rounds; columns of one place and name in several files of a folder are one."""
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.csv").write_text("n,w\n" + "".join(f"{i},w{i % 5}\n" for i in range(700)) + "7,w1,more\n")
    (tmp_path / "t/b.csv").write_text("n,x\n" + "".join(f"{i}.5,{i}\n" for i in range(300)) + '1,2,"a,b",8\n')
    staged, real = [], folder.stage
    monkeypatch.setattr(folder, "stage", lambda df: staged.append(real(df)) or staged[-1])
    found = {(r.position, r.column): r for r in folder.inspect_files(spark, [str(tmp_path / "t")], by_folder=True).collect()}
    numbers = [i for i in range(700)] + [7] + [i + 0.5 for i in range(300)] + [1]
    assert (found[0, "n"].n_rows, found[0, "n"].median, found[0, "n"].greatest) == (1002, np.median(numbers), 699.0)
    assert (found[1, "w"].codes, found[1, "w"].n_rows, found[1, "x"].median, found[1, "x"].n_rows) == ("w0|w1|w2|w3|w4", 701, np.median([*range(300), 2]), 301)
    assert (found[2, None].codes, found[2, None].n_rows, found[3, None].least) == ("a,b|more", 2, 8.0) and len(found) == 5
    counted = [r for df in staged if "k" in df.columns for r in df.collect()]
    assert {r.v for r in counted} == {"w0", "w1", "w2", "w3", "w4", "a,b", "more"}


def test_a_profile_of_the_first_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(i, float(i), "t") for i in range(50)], "a int, b double, c string")
    assert {r.n_rows for r in profile.profile_columns(df, rows=7).collect()} == {7}
    empty = {r.column: r for r in profile.profile_columns(df.limit(0)).collect()}
    assert (empty["a"].n_rows, empty["a"].median, empty["c"].n_distinct, empty["c"].codes) == (0, None, 0, "")


def test_a_layer_that_is_not_there(spark):
    df = spark.createDataFrame([("bores", 1)], "layer string, id int")
    assert select_layer(df, "bores").count() == 1
    with pytest.raises(LayerError):
        select_layer(df, "wells")


def test_lags_up_to_the_first_insignificant_one(spark, monkeypatch):
    """The same factors as the kernel's; a series that has stopped is not advanced again."""
    from borefield.functions import stats
    from borefield.operators import autocorrelation

    rng = np.random.default_rng(8)

    def walk(n, phi):
        x = [0.0]
        for e in rng.normal(size=n - 1):
            x.append(phi * x[-1] + e)
        return np.round(x, 2)

    series = {1: walk(120, 0.9), 2: rng.normal(size=90).round(1), 3: np.ones(30), 4: walk(3, 0.5), 5: walk(200, 0.99), 6: walk(4, 0.2), None: walk(60, 0.8)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k int, position int, value double")
    advanced, real = [], autocorrelation._advanced
    monkeypatch.setattr(autocorrelation, "_advanced", lambda centred, frontier, *a: advanced.append({r.k for r in frontier.select("k").collect()}) or real(centred, frontier, *a))
    got = {r.k: r for r in autocorrelation.variance_factor(df, "k", lags=2).collect()}
    assert set(got) == set(series)
    for k, x in series.items():
        assert got[k].factor == pytest.approx(stats.hamed_rao_factor(x, 0.0), rel=1e-12), k
        assert got[k].effective_n == pytest.approx(len(x) / got[k].factor)
    assert 3 not in advanced[0] and 4 not in advanced[0] and len(advanced[-1]) < len(advanced[0])


@pytest.mark.parametrize("short", [100, 1000])
def test_short_series_are_gathered(spark, monkeypatch, short):
    """Series of up to so many values don't meet lag by lag; all have the kernel's factor."""
    from borefield.functions import stats
    from borefield.operators import autocorrelation

    rng = np.random.default_rng(8)
    series = {1: np.cumsum(rng.normal(size=300)).round(2), 2: rng.normal(size=90).round(1), 3: np.ones(30), 4: np.array([1.0, 2, 3]), 5: np.array([2.0]), None: np.cumsum(rng.normal(size=60)).round(1)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k int, position int, value double").orderBy(F.rand(3))
    by_lags, real = [], autocorrelation._by_lags
    monkeypatch.setattr(autocorrelation, "_by_lags", lambda known, *a: by_lags.append({r.k for r in known.select("k").collect()}) or real(known, *a))
    got = {r.k: r for r in autocorrelation.variance_factor(df, "k", short=short).collect()}
    assert {k: r.n for k, r in got.items()} == {k: len(x) for k, x in series.items()}
    assert all(got[k].factor == pytest.approx(stats.hamed_rao_factor(x, 0.0), rel=1e-12) for k, x in series.items())
    assert by_lags == ([{1}] if short < 300 else [])
