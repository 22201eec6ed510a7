"""Readings that are appended by month, and layers that are published by version."""

from datetime import datetime, timedelta

import pytest

from borefield.functions import geodesy
from borefield.jobs import tables
from borefield.sources import layers

READINGS = "bore_id string, observed_at timestamp, value double, seq int"


def test_a_batch_meets_only_its_months(spark, tmp_path):
    path = str(tmp_path / "readings")
    days = [datetime(2019, 1, 15) + timedelta(days=30 * i) for i in range(20)]
    first = spark.createDataFrame([(f"b{i % 30}", d, float(i), i) for d in days for i in range(30)], READINGS)
    tables.append_readings(spark, path, first, ["seq"], "one.csv")
    second = spark.createDataFrame([("b1", days[3], 9.0, 1), ("b1", days[3] + timedelta(hours=1), 9.0, 2), ("new", days[5], 1.0, 3)], READINGS)
    keys = tables.stored_keys(spark, path, second)
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan or "month" in plan.split("PartitionFilters")[1].split("]")[0]
    assert len(keys.inputFiles()) > 0 and {r.bore_id for r in keys.collect()} == {"b1"} and keys.count() == 2  # of two months
    for _ in range(2):  # running it again adds nothing
        tables.append_readings(spark, path, second, ["seq"], "two.csv")
        stored = spark.read.parquet(path)
        assert stored.count() == 602 and stored.where("source_file = 'two.csv'").count() == 2
    many = spark.createDataFrame([(f"b{i}", days[0], 0.0, i) for i in range(40)], READINGS)
    tables.append_readings(spark, path, many, ["seq"], "three.csv")
    assert spark.read.parquet(path).where("source_file = 'three.csv'").count() == 10


def test_readers_see_one_whole_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "maps")
    one = spark.createDataFrame([(1, 7853)], "id int, srid int")
    with pytest.raises(layers.LayerError):
        layers.published(spark, path)
    assert layers.publish_version(path, {"bore": one, "old": one}) == {"bore": 7853, "old": 7853}
    opened = layers.published(spark, path)

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:  # a job that dies before the pointer is replaced changes nothing
        m.setattr(layers, "_point", dies)
        with pytest.raises(RuntimeError):
            layers.publish_version(path, {"bore": one.union(one)})
    assert sorted(layers.published(spark, path)) == ["bore", "old"]
    with pytest.raises(geodesy.CrsError):
        layers.publish_version(path, {"bore": one.withColumn("srid", one.srid + 1)})
    layers.publish_version(path, {"bore": one.union(one), "none": one.limit(0)})
    assert {n: df.count() for n, df in layers.published(spark, path).items()} == {"bore": 2, "none": 0}
    assert opened["old"].count() == 1  # whoever had opened the version before can finish
    layers.publish_version(path, {"bore": one})
    assert len([p for p in (tmp_path / "maps").iterdir() if p.is_dir()]) == 2


def test_the_zone_check_can_be_switched_off(spark, tmp_path):
    raw = spark.createDataFrame([("a", 1.0, 2.0, 1.0)], "bore_id string, x double, y double, collar_rl_m_ahd double")
    with pytest.raises(geodesy.CrsError):
        tables.load_bores(raw, str(tmp_path / "bores"), "f", "EPSG:7853")
    tables.load_bores(raw, str(tmp_path / "bores"), "f", "EPSG:7853", validate_zone=False)
    assert spark.read.parquet(str(tmp_path / "bores")).count() == 1
