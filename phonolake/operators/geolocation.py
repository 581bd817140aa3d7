"""Geolocation: distances on the sphere and misses among the nearest targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: The evaluation's and the corpus statistics' earth radii in km.
RADIUS_KM, HAVERSINE_KM = 6378.1, 6371.0


def to_unit(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Unit vector of radians."""
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def to_radians(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.atan2(z, F.greatest(F.sqrt(x * x + y * y), F.lit(1e-8))), F.atan2(y, x)


def valid_degrees(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def angle(x: Column, y: Column, z: Column, lat: Column, lon: Column) -> Column:
    """Angle between a predicted vector and a target in radians."""
    p_lat, p_lon = to_radians(x, y, z)
    cos = F.sin(lat) * F.sin(p_lat) + F.cos(lat) * F.cos(p_lat) * F.cos(p_lon - lon)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))


def mean_distance_km(df: DataFrame, x: str, y: str, z: str, lat: str, lon: str) -> DataFrame:
    """Zero where there are no rows."""
    a = angle(*map(F.col, (x, y, z, lat, lon)))
    return df.agg((F.coalesce(F.avg(a), F.lit(0.0)) * RADIUS_KM).alias("distance_km"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Of degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * HAVERSINE_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def angular_loss(dot: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1 + 1e-7), F.least(F.lit(1 - 1e-7), dot)))


def vmf_loss(kappa: Column, dot: Column) -> Column:
    """Negative log-likelihood of the von Mises-Fisher density on the sphere, with log(1 - exp(-2k)) in a stable form."""
    norm = F.ln(kappa) - kappa - F.log1p(-F.exp(-2 * kappa)) - F.lit(1.8378770664093453)
    return -(norm + kappa * dot)


def extent(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in (lat, lon) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


#: Places of a cell that are looked at one by one, and the finest cells: three numbers of 21 bits fill a long.
LEAF, LEVELS = 64, 21
#: Cells of a level that are broadcast at most (some 80 bytes each); finer levels are joined as Spark sees fit.
BROADCAST = 1 << 17


def _cell(level: int) -> Column:
    """The cell of a unit vector among 2^level along each axis, as one number."""
    x, y, z = (F.least(F.floor((F.col(c) + 1) / 2 * (1 << level)), F.lit((1 << level) - 1)).cast("long") for c in "xyz")
    return F.shiftleft(x, 2 * LEVELS).bitwiseOR(F.shiftleft(y, LEVELS)).bitwiseOR(z)


def _cells(places: DataFrame, leaf: int) -> tuple[list[DataFrame], DataFrame]:
    """For each level the cells inside of those above that are too full, (parent, node, n, box, full), and the places of cells that
    are not, (level, cell, glat, glon).  Levels are counted over the places; only their cells are stored."""
    levels, items, active = [], [], places
    for level in range(LEVELS + 1):
        parent = _cell(level - 1) if level else F.lit(-1).cast("long")
        bounds = [f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
        full = (F.col("n") > leaf) & F.lit(level < LEVELS)
        nodes = stored(active.groupBy(parent.alias("parent"), _cell(level).alias("node")).agg(F.count("*").alias("n"), *bounds).withColumn("full", full), "cells")
        size = nodes.agg(F.count("*").alias("all"), F.count_if("full").alias("full")).first()
        near = F.broadcast if size["all"] <= BROADCAST else lambda d: d
        levels.append(near(nodes))
        inside = lambda kind: places.withColumn("node", _cell(level)).join(near(nodes.where(kind).select("node")), "node", "left_semi")  # noqa: B023, E731
        if size["full"] < size["all"]:
            items.append(inside("not full").select(F.lit(level).alias("level"), F.col("node").alias("cell"), F.col("lat").alias("glat"), F.col("lon").alias("glon")))
        if not size["full"]:
            break
        active = inside("full").drop("node")
    return levels, reduce(DataFrame.unionByName, items)


def miss_rate(df: DataFrame, k: int, key: str, x: str, y: str, z: str, lat: str, lon: str, leaf: int = LEAF) -> DataFrame:
    """Percentage of rows whose target is not among the k distinct targets nearest to the prediction.

    Targets are distinct at six decimals.  A place is nearer if its product with the prediction is larger than the target's, or equal
    and it sorts first.  Places are counted by cells of a grid on the sphere that gets finer: a cell whose bounds lie wholly nearer
    counts at once, one wholly farther is left, and only cells in between are opened, at last place by place.  A row is done when k
    are nearer or nothing is left to open, so its work goes with the cells around its target's distance and not with the number of
    places.  Equal rows are looked at once.

    A row's open cells are rows of their own, side by side in one partition from the first level to the last: levels are broadcast and
    sums are taken over neighbours, so that nothing is written between levels.  Then rows meet the places of their last cells in one
    join, and no array holds a cell's places.  Zero where there are no rows or no more than k places.
    """
    spark = df.sparkSession
    gx, gy, gz = to_unit(F.col("lat"), F.col("lon"))
    places = df.select(F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon")).distinct().where("lat is not null and lon is not null")
    # neighbours share files, so that a task's sums by cell are few
    places = stored(places.repartitionByRange("lat", "lon"), "places")
    asked = ["px", "py", "pz", "lat", "lon"]
    rows = df.select(F.col(x).alias("px"), F.col(y).alias("py"), F.col(z).alias("pz"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))
    rows = rows.groupBy(*asked).agg(F.count("*").alias("times"))
    product = lambda x, y, z: F.col("px") * x + F.col("py") * y + F.col("pz") * z
    square = lambda d: d * d
    total, missed = df.count(), 0
    if total and places.count() > k:
        levels, items = _cells(places.withColumns({"x": gx, "y": gy, "z": gz}), leaf)
        own = product(*to_unit(F.col("lat"), F.col("lon")))
        # of a box: by the signs of the prediction, and by the box's least and greatest distance from where the prediction meets the sphere
        low, high = (sum((f(F.col(p) * F.col(f"lo{c}"), F.col(p) * F.col(f"hi{c}")) for p, c in (("px", "x"), ("py", "y"), ("pz", "z"))), F.lit(0.0)) for f in (F.least, F.greatest))
        near, far = (sum((square(f(F.col(f"lo{c}") - F.col(f"q{c}"), F.col(f"q{c}") - F.col(f"hi{c}"), *rest)) for c in "xyz"), F.lit(0.0)) for f, rest in ((F.greatest, [F.lit(0.0)]), (F.least, [])))
        norm = F.when(~F.isnan("hix"), F.col("norm"))
        low, high = F.greatest(low, norm * (1 - far / 2)), F.least(high, norm * (1 - near / 2))
        edge = (F.abs("px") + F.abs("py") + F.abs("pz")) * 1e-12  # more than what products lose by rounding
        most = F.greatest(*map(F.abs, map(F.col, ("px", "py", "pz"))))
        rows = rows.withColumn("most", F.when(most.between(1e-300, 1e300), most))  # else null, and so is what comes of it
        rows = rows.withColumn("norm", F.sqrt(sum((square(F.col(c) / F.col("most")) for c in ("px", "py", "pz")), F.lit(0.0))))
        rows = rows.select(*asked, "times", (F.col("norm") * F.col("most")).alias("norm"), *[(F.col(f"p{c}") / F.col("most") / F.col("norm")).alias(f"q{c}") for c in "xyz"])
        own_rows = Window.partitionBy(*asked)
        # the cell is open where level is null, one to look into at level, and none where level is -1: k are nearer
        left = rows.withColumns({"own": own, "nearer": F.lit(0).cast("long"), "level": F.lit(None).cast("int"), "cell": F.lit(-1).cast("long")})
        for level, nodes in enumerate(levels):
            opened = F.col("level").isNull()
            none = F.xxhash64(*asked).bitwiseOR(F.lit(-(1 << 63)))  # no cell's number, and not one for all rows
            met = left.join(nodes, F.when(opened, F.col("cell")).otherwise(none) == F.col("parent"), "left")
            all_, some = opened & (low > F.col("own") + edge), ~opened | (high >= F.col("own") - edge)
            met = met.withColumns({"inside": F.when(all_, F.col("n")).otherwise(0), "meets": F.coalesce(some & ~all_, F.lit(False)), "at": F.coalesce("node", "cell")})
            met = met.withColumns({"nearer": F.col("nearer") + F.sum("inside").over(own_rows), "one": F.min(F.struct("level", "at")).over(own_rows)})
            met = met.where(F.when(F.col("nearer") < k, F.col("meets")).otherwise(F.col("one") == F.struct("level", "at")))
            into = F.when(F.col("nearer") >= k, -1).when(opened & F.col("full"), None).when(opened, level).otherwise(F.col("level"))
            left = met.select(*rows.columns, "own", "nearer", into.alias("level"), F.col("at").alias("cell"))
        done = F.col("level") == -1
        left = stored(left.select(*[F.when(~done, F.col(c)).alias(c) for c in (*asked, "own", "nearer", "cell")], "times", "level"), "asked")
        g = product(*to_unit(F.col("glat"), F.col("glon")))
        ahead = (g > F.col("own")) | ((g == F.col("own")) & (F.struct("glat", "glon") < F.struct("lat", "lon")))
        found = left.where(~done).join(items, ["level", "cell"]).where(ahead).groupBy(*asked, "times", "nearer").agg(F.count("*").alias("found"))
        for kind in (left.where(done), found.where(F.col("nearer") + F.col("found") >= k)):
            missed += kind.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("missed")).first()["missed"]
    return spark.range(1).select(F.lit(100.0 * missed / total if total else 0.0).alias("miss_rate"))
