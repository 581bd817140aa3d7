"""Nearest places: what is written for a row, and predictions that are no unit vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest

from phonolake.operators import geolocation

COLUMNS = ("key", "x", "y", "z", "lat", "lon")


def _unit(lat, lon):
    return math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)


def _stages(spark):
    """(stage, bytes written, shuffled and spilled) of the stages that Spark remembers."""
    sc = spark.sparkContext
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {x.stageId(): x.outputBytes() + x.shuffleWriteBytes() + x.diskBytesSpilled() for x in (found.apply(i) for i in range(found.size()))}


def test_places_write_little_for_a_row(spark):
    n = 4000
    rng = np.random.default_rng(7)
    lat, lon = np.radians(rng.uniform(-80, 80, n)), np.radians(rng.uniform(-175, 175, n))
    off = np.radians(rng.uniform(-1, 1, (2, n)))
    rows = [(k, *_unit(lat[k] + off[0, k], lon[k] + off[1, k]), float(lat[k]), float(lon[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "key long, x double, y double, z double, lat double, lon double")
    g = np.array([_unit(round(a, 6), round(b, 6)) for a, b in zip(lat, lon, strict=True)])
    p = np.array([r[1:4] for r in rows])
    want = 100.0 * np.mean(((p @ g.T) > (p * g).sum(1)[:, None] + 1e-13).sum(1) >= 3)
    before = max(_stages(spark), default=-1)
    assert geolocation.miss_rate(df, 3, *COLUMNS, leaf=16).first().miss_rate == pytest.approx(want)
    assert sum(size for stage, size in _stages(spark).items() if stage > before) < 600 * n


@pytest.mark.parametrize("broadcast", [geolocation.BROADCAST, 0])
def test_predictions_of_any_length(spark, monkeypatch, broadcast):
    monkeypatch.setattr(geolocation, "BROADCAST", broadcast)
    places = [(round(0.01 * (i % 20), 6), round(0.013 * (i // 20) - 3.0, 6)) for i in range(160)]
    rows = []
    for i, place in enumerate(places):
        size = (1.0, 0.0, 1e-200, 1e200, 5.0, 0.3, -1.0)[i % 7]
        rows.append((i, *(size * c for c in _unit(place[0] + 0.002 * (i % 11), place[1] - 0.004 * (i % 5))), *place))
    rows += [(900, None, 0.0, 1.0, *places[3]), (901, 1.0, 0.0, 0.0, None, 0.0)]
    df = spark.createDataFrame(rows, "key long, x double, y double, z double, lat double, lon double")

    def nearer(r):
        if None in r:
            return 0
        score = lambda g: r[1] * g[0] + r[2] * g[1] + r[3] * g[2]
        own = score(_unit(*r[4:]))
        return sum(score(_unit(*g)) > own or (score(_unit(*g)) == own and g < r[4:]) for g in places)

    want = 100.0 * sum(nearer(r) >= 3 for r in rows) / len(rows)
    assert 0 < want < 100
    if not broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert geolocation.miss_rate(df, 3, *COLUMNS, leaf=4).first().miss_rate == pytest.approx(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
