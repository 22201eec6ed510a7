from datetime import date, datetime, timedelta

import numpy as np
import pytest

from borefield.functions import dates, geodesy, naming
from borefield.jobs import tables
from borefield.operators import checks, levels, monthly, profile, readings, sufficiency, trends
from borefield.sources import delimited, inventory, layers
from borefield.streaming.readings import stream_readings


def series(kind, seed=7):
    rng, n = np.random.default_rng(seed), 9 if kind == "short" else 180
    t = np.arange(n)
    season, noise = 1.5 * np.sin(2 * np.pi * (t % 12 + 1) / 12), rng.normal(0, 0.1, n)
    x = 330 + season + noise + {"falling": -0.25, "rising": 0.18}.get(kind, 0.0) * t / 12
    keep = [i for i in range(n) if kind != "sparse" or i < 6 or i >= n - 6]
    return [(datetime(2008 + i // 12, i % 12 + 1, 15), float(x[i])) for i in keep]


@pytest.mark.parametrize("basis", levels.BASES)
def test_classes(spark, basis):
    kinds = {"falling": "falling", "rising": "rising", "flat": "no_trend", "short": "insufficient_data", "sparse": "insufficient_data"}
    rows = [(k, at, 400 - v) for k in kinds for at, v in series(k)]
    found = spark.createDataFrame(rows, "bore_id string, observed_at timestamp, depth_to_water_m double")
    collar = 400.0 if basis == levels.BASES[0] else None
    bores = spark.createDataFrame([(k, collar) for k in [*kinds, "unread"]], "bore_id string, collar_rl_m_ahd double")
    out = {r.bore_id: r for r in trends.bore_trends(found, bores).collect()}
    assert {k: out[k].trend_class for k in kinds} == kinds
    assert all(r.basis == basis for r in out.values())
    assert "missing" in out["sparse"].insufficient_reason and out["short"].p_value is None
    assert out["unread"].n_observations == 0 and out["unread"].gap_fraction == 1.0 and out["unread"].insufficient_reason.count(";") == 3
    assert out["falling"].sens_slope_m_per_year == pytest.approx(-0.25, abs=0.05) and out["falling"].deseasonalised
    assert checks.check_trends(trends.bore_trends(found, bores), bores).count() == 0


def test_monthly_cases(spark):
    rows = [("a", datetime(2020, 3, d), v) for d, v in ((2, 10.0), (15, 12.0), (28, 100.0))] + [("a", datetime(2020, 4, 10), 5.0), ("a", None, 1.0), ("a", datetime(2020, 5, 1), None), ("a", datetime(2020, 5, 2), float("nan"))]
    rows += [("g", datetime(2020, 1, 15), 1.0), ("g", datetime(2020, 6, 15), 2.0)]
    m = monthly.monthly_median(spark.createDataFrame(rows, "bore_id string, observed_at timestamp, value double"))
    assert m.where("bore_id = 'a' AND month_idx = 2020 * 12 + 2").first().value == 12.0
    c = {r.bore_id: r for r in monthly.series_coverage(m).collect()}
    assert (c["a"].n_observations, c["a"].n_months_present) == (5, 2)
    assert (c["g"].n_months_total, c["g"].n_months_present, c["g"].longest_gap_months) == (6, 2, 4) and c["g"].gap_fraction == pytest.approx(4 / 6)
    assert monthly.series_coverage(m.limit(0)).count() == 0
    assert monthly.monthly_grid(m.where("bore_id = 'g'")).count() == 6


def test_no_reading_is_lost(spark):
    r = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("orphan", 3.0), (None, 4.0), ("a", None)], "bore_id string, depth_to_water_m double")
    b = spark.createDataFrame([("a", 10.0), ("b", None)], "bore_id string, collar_rl_m_ahd double")
    out = levels.derive_levels(r, b)
    s = levels.datum_summary(out).first()
    assert (s.n_readings, s.n_with_level, s.n_without_collar) == (5, 1, 3)
    with pytest.raises(ValueError):
        levels.derive_levels(r, b.union(b))
    with pytest.raises(KeyError):
        levels.derive_levels(r.drop("bore_id"), b)


def test_reasons_and_half_even(spark):
    row = spark.createDataFrame([(4, 4, 4, 0.0, 3 / 12, 1, 4)], "n_observations long, n_months_present long, n_months_total long, gap_fraction double, span_years double, distinct_years long, months_covered long")
    got = sufficiency.assess(row).first()
    assert got.insufficient_reason == "only 4 observations (need 20); record spans 0.2 years (need 8); only 1 distinct years (need 5)" and not got.can_deseasonalise


@pytest.mark.parametrize(
    "values, order",
    [
        (["7/4/1998", "11-12-1998", "2/2/1999 08:30"], "ambiguous"),
        (["31/1/1998", "2/2/1999", "9/9/1999"], "day_first"),
        (["1/31/1998", "2/2/1999", "9/9/1999"], "month_first"),
        (["1998/1/31", "1999-2-2", " 1999/9/9"], "year_first"),
        (["7/4/1998", "11/12/1998"], None),
        (["A", "B", "", "1.5"], None),
    ],
)
def test_date_order(spark, values, order):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert df.agg(dates.date_order(F.col("v")).alias("o")).first().o == order


def test_delimited(spark, tmp_path):
    path = tmp_path / "dips.csv"
    path.write_text("WELL,TAKEN,DIP\n7,04/09/1998,11.25\n8,11/07/1999,n/a\n9,06/10/2001,\n")
    with pytest.raises(dates.AmbiguousDatesError):
        delimited.read_delimited(spark, delimited.Source(str(path), "dips.csv"))
    source = delimited.Source(str(path), "dips.csv", date_formats={"TAKEN": "%d/%m/%Y"}, types={"DIP": "double"})
    rows = delimited.read_delimited(spark, source).orderBy("WELL").collect()
    assert rows[0].TAKEN == datetime(1998, 9, 4) and [r.DIP for r in rows] == [11.25, None, None]


def test_date_formats(spark):
    when = datetime(2011, 2, 28, 13, 5, 9, 250000)
    for form in ("%d %b %Y %I:%M:%S %p", "%B %d, %Y at %H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%y %j %H%M%S", "it's %d/%m/%Y %H.%M.%S [x]"):
        df = spark.createDataFrame([(when.strftime(form),)], "t string")
        got = dates.parse_dates(df, {"t": form}).first().t
        assert got.replace(microsecond=0) == when.replace(microsecond=0) and ("%f" not in form or got == when), form
    with pytest.raises(dates.DateFormatError, match="%q"):
        dates.java_pattern("%q %Y")


def test_names(spark):
    from pyspark.sql import functions as F

    out = ["hot_spring", "SpringFlow", "oldSoaks", "soakage-2", "sacred", "mapOfSacredPlaces"]
    ok = ["pump_tests", "rain", "offspring", "Springvale", "soaked_soil", "sacredness"]
    got = {r.n: r.t for r in spark.createDataFrame([(n,) for n in out + ok], "n string").select("n", naming.excluded_theme(F.col("n")).alias("t")).collect()}
    assert {n for n in out if not got[n]} == {n for n in out if n not in got} and not any(got[n] for n in ok)
    with pytest.raises(ValueError, match="hot_spring"):
        naming.require_in_scope(spark.createDataFrame([("rain",), ("hot_spring",)], "layer string"))


def test_inventory(spark, tmp_path):
    for name in ("a.shp", "a.dbf", "a.PRJ", "b.dbf", "c.csv", "SacredSite.gpkg", "noext", "z.zip"):
        (tmp_path / name).write_bytes(b"x" * 2048)
    rows = {r.path.rsplit("/", 1)[1]: r for r in inventory.inventory(inventory.list_files(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a.shp", "b.dbf", "c.csv", "SacredSite.gpkg", "noext", "z.zip"}
    assert rows["a.shp"].kind == "spatial" and rows["SacredSite.gpkg"].excluded_theme == "sacred" and rows["c.csv"].size == "2.0KB"


def test_layers(spark, tmp_path):
    good = spark.createDataFrame([(1, 400000.0, 7600000.0, 7853)], "id long, x double, y double, srid int")
    assert layers.write_layers(str(tmp_path / "one"), {"bore": good}) == {"bore": 7853}
    for bad in ({}, {"springs": good}, {"bore": good, "other": good.withColumn("srid", good.srid + 1)}):
        with pytest.raises(ValueError):
            layers.write_layers(str(tmp_path / "no"), bad)
    assert not (tmp_path / "no").exists()
    target = str(tmp_path / "maps")
    layers.write_layers(target, {"bore": good, "old": good})
    assert layers.write_layers(target, {"bore": good.union(good), "none": good.limit(0)}) == {"bore": 7853, "none": 7853}
    assert sorted(p.name for p in (tmp_path / "maps").iterdir() if p.is_dir()) == ["bore", "none"] and spark.read.parquet(f"{target}/bore").count() == 2
    assert not [p for p in tmp_path.iterdir() if "-new-" in p.name or "-old-" in p.name]
    good.withColumn("srid", good.srid + 1).write.parquet(f"{target}/stray")
    with pytest.raises(geodesy.CrsError):
        layers.verify_layers(spark, target)
    two = spark.createDataFrame([("a", 1), ("b", 2)], "layer string, id int")
    with pytest.raises(layers.LayerError):
        layers.select_layer(two)
    assert layers.select_layer(two, "b").first().id == 2 and layers.select_layer(two.where("layer = 'a'")).count() == 1


def test_coordinates(spark):
    points = spark.createDataFrame([(1, 134.0, -21.0, 7844), (2, 400000.0, 7600000.0, 7853), (3, 135.0, 0.0, 7844)], "id int, x double, y double, epsg int")
    out = {r.id: r for r in geodesy.to_grid_xy(points).collect()}
    assert (out[2].x, out[2].y) == (400000.0, 7600000.0)
    assert out[3].x == pytest.approx(500000.0, abs=1e-6) and out[3].y == pytest.approx(10_000_000.0, abs=1e-6)
    assert out[1].x < 500000 and out[1].srid == 7853
    geodesy.require_within_zone(spark.createDataFrame([(out[1].x, out[1].y)], "x double, y double"))
    with pytest.raises(geodesy.CrsError):
        geodesy.require_within_zone(spark.createDataFrame([(out[3].x, out[3].y)], "x double, y double"))
    for code in (4283, 4326):
        with pytest.raises(geodesy.CrsError):
            geodesy.to_grid_xy(points.limit(1).selectExpr("id", "x", "y", f"{code} AS epsg"))
    back = spark.createDataFrame([(1, out[1].x, out[1].y, 7853)], "id int, x double, y double, zone0 int")
    from pyspark.sql import functions as F

    lon, lat = geodesy.unproject(F.col("x"), F.col("y"), F.lit(53))
    r = back.select(lon.alias("lon"), lat.alias("lat")).first()
    assert r.lon == pytest.approx(134.0, abs=1e-8) and r.lat == pytest.approx(-21.0, abs=1e-8)  # a millimetre


def test_points_without_a_shift_are_refused(spark):
    points = spark.createDataFrame([(1, 134.25, -21.5, 4283), (2, 170.0, -21.5, 4283)], "id int, x double, y double, epsg int")
    nodes = spark.createDataFrame([(i, j, 1e-6, 1e-6) for i in (134, 135) for j in (-22, -21)], "i long, j long, dlon double, dlat double")
    out = geodesy.to_grid_xy(points, nodes)
    assert {r.id: (r.x is None, r.srid) for r in out.collect()} == {1: (False, 7853), 2: (True, None)}
    for guard in (geodesy.require_within_zone, geodesy.require_grid_srid):
        with pytest.raises(geodesy.CrsError):
            guard(out)
        guard(out.where("id = 1"))


def test_declared_codes(spark):
    from pyspark.sql import functions as F

    said = ["EPSG:7853", "7844", "local grid", None, "epsg:4283"]
    rows = spark.createDataFrame([(s,) for s in said], "s string").select("s", geodesy.crs_verdict(F.lit(None).cast("int"), F.col("s")).alias("v")).collect()
    assert [list(r.v) for r in rows] == [["on_grid"], ["geographic_needs_projecting"], ["unparseable"], ["none_declared"], ["geographic_needs_projecting", "gda94_needs_shift_table"]]


def test_written_tables(spark, tmp_path):
    """Trends, readings with where they are from, and declared geometry columns."""
    found = spark.createDataFrame([("a", at, 400 - v, i) for i, (at, v) in enumerate(series("falling"))], "bore_id string, observed_at timestamp, depth_to_water_m double, seq int")
    bores = spark.createDataFrame([("a", 400.0), ("b", None)], "bore_id string, collar_rl_m_ahd double")
    tables.write_trends(found, bores, str(tmp_path / "trends"))
    written = spark.read.parquet(str(tmp_path / "trends"))
    assert {r.bore_id: r.trend_class for r in written.collect()} == {"a": "falling", "b": "insufficient_data"} and checks.check_trends(written, bores).count() == 0
    for _ in range(2):
        tables.append_readings(spark, str(tmp_path / "readings"), found, ["seq"], "dips.csv")
    stored = spark.read.parquet(str(tmp_path / "readings"))
    assert stored.count() == found.count() and stored.where("source_file = 'dips.csv' AND loaded_at IS NOT NULL").count() == found.count()
    raw = spark.createDataFrame([("a", 400000.0, 7600000.0, 1.0)], "bore_id string, x double, y double, collar_rl_m_ahd double")
    tables.load_bores(raw, str(tmp_path / "bores"), "bores.csv", "EPSG:7853")
    assert checks.check_bores(spark.read.parquet(str(tmp_path / "bores"))).count() == 0
    with pytest.raises(geodesy.CrsError):
        tables.load_bores(raw.selectExpr("bore_id", "CAST(NULL AS DOUBLE) AS x", "y", "collar_rl_m_ahd"), str(tmp_path / "no"), "bores.csv", "EPSG:7853")
    marked = raw.withMetadata("x", {"srid": 7853})
    assert profile.geometry_columns({"b": marked, "a": raw}) == [("b", "x", 7853)]


def test_districts(spark):
    rows = [(1, "north", "shape", 7853, "f", "c"), (2, None, "shape", None, "f", "c"), (3, "south", None, 7853, None, "c"), (3, "south", "shape", 4283, "f", "c")]
    df = spark.createDataFrame(rows, "wcd_id int, name string, geom string, srid int, source_file string, source_crs string")
    got = sorted((r.rule.removeprefix("wcd_boundary."), r.key) for r in checks.check_districts(df).collect())
    assert got == [("geom.not_null", "3"), ("name.not_null", "2"), ("primary_key", "3"), ("source_file.not_null", "3"), ("srid", "2"), ("srid", "3")]


def test_stream_merges_once(spark, tmp_path):
    schema = "bore_id string, observed_at timestamp, value double, seq int"
    day = datetime(2020, 1, 1)
    rows = [("a", day, 1.0, 1), ("a", day, 9.0, 2), ("b", day + timedelta(days=1), 2.0, 3)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(2):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream_readings(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "state"), ["seq"]).awaitTermination()
    assert sorted((r.bore_id, r.value) for r in spark.read.parquet(out).collect()) == [("a", 1.0), ("b", 2.0)]


def test_merge_and_checks(spark):
    schema = "bore_id string, observed_at date, depth_to_water_m double, level_m_ahd double, seq int"
    df = spark.createDataFrame([("a", date(2020, 1, 1), 1.0, None, 2), ("a", date(2020, 1, 1), 2.0, None, 1), ("q", date(2020, 1, 2), None, None, 3), (None, date(2020, 1, 2), 1.0, None, 4)], schema)
    assert [r.seq for r in readings.first_wins(df, ["seq"]).orderBy("seq").collect()] == [1, 3]
    bores = spark.createDataFrame([("a", 1.0, levels.MISSING, 7853)], "bore_id string, collar_rl_m_ahd double, datum_status string, srid int")
    assert {r.rule for r in checks.check_readings(df, bores).collect()} == {"water_level.unique", "water_level.bore_id.not_null", "water_level.depth_or_level", "water_level.foreign_key"}
    assert {r.rule for r in checks.check_bores(bores).collect()} == {"bore.datum_status_agrees"}
