"""The nearest earlier location in units of any size: a unit's plane is cut into tiles, and a location visits only tiles that may hold a nearer one.

Tiles hold about SLICE locations: strips of equal numbers by x, cut by y. Each tile is searched by itself first, which gives most of its
locations a bound. A location then visits those other tiles with an earlier year whose box is nearer than its bound; one that has no
bound yet first visits the nearest such tile, which surely gives it one. So tiles are read once a pass, and no pass makes a row for a pair of locations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.operators.ordered import prefix_sums
from chronopanel.sources.tables import temporary, written

#: Locations of a tile; pairs whose distances are held at once; visitors that a task takes for a tile; locations that a unit may have.
SLICE, PAIRS, VISITORS, MOST_LOCATIONS = 4096, 2_000_000, 50_000, 20_000_000
BOX = ("low_x", "high_x", "low_y", "high_y", "first_year")


def nearest_earlier(years: np.ndarray, x: np.ndarray, y: np.ndarray, own_years: np.ndarray, own_x: np.ndarray, own_y: np.ndarray) -> np.ndarray:
    """For each own point the distance to the nearest of the others with an earlier year (infinite where there is none); the others are in the order of years."""
    found = np.full(len(own_years), np.inf)
    before = np.searchsorted(years, own_years)
    order = np.argsort(before, kind="stable")
    step = max(1, PAIRS // max(1, len(years)))
    for at in range(0, len(order), step):
        some = order[at : at + step]
        if end := int(before[some].max()):
            distance = np.hypot(own_x[some, None] - x[:end], own_y[some, None] - y[:end])
            found[some] = np.where(np.arange(end) < before[some, None], distance, np.inf).min(1)
    return found


def _dealt(rows: DataFrame, group: list[str]) -> DataFrame:
    """rows with their tile."""
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"))
    checked = F.when(F.col("n") > MOST_LOCATIONS, F.raise_error(F.lit(f"a unit of more than {MOST_LOCATIONS} locations")).cast("long")).otherwise(F.col("n"))
    rows = rows.join(sizes.withColumn("n", checked).withColumn("strips", F.ceil(F.sqrt(F.col("n") / SLICE))), group)
    across = written(prefix_sums(rows, group, F.col("x_m"), [F.col("y_m"), F.col("slot")], {"place": F.lit(1)}), "tiles-strips")
    across = across.withColumn("strip", F.floor((F.col("place") - 1) * F.col("strips") / F.col("n"))).drop("place", "n", "strips")
    down = prefix_sums(across, [*group, "strip"], F.col("y_m"), [F.col("x_m"), F.col("slot")], {"place": F.lit(1)})
    return down.withColumn("tile", F.col("strip") * MOST_LOCATIONS + F.floor((F.col("place") - 1) / SLICE)).drop("strip", "place")


def _schema(rows: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields)


def _home(tiles: DataFrame, group: list[str]) -> DataFrame:
    """tiles with best: the distance to the nearest earlier location of the same tile."""
    def run(frame):
        frame = frame.sort_values("year")
        years, x, y = (frame[c].to_numpy() for c in ("year", "x_m", "y_m"))
        return frame.assign(best=nearest_earlier(years, x, y, years, x, y))

    return tiles.groupBy(*group, "tile").applyInPandas(run, f"{_schema(tiles, tiles.columns)}, best double")


def _visits(asking: DataFrame, boxes: DataFrame, group: list[str], again: bool) -> DataFrame:
    """asking (…, tile, best) with the tiles to visit (target): all nearer than best, or where it's infinite the nearest with an earlier year.

    On the second pass those who had no bound before don't visit the tile again that gave it (seen)."""
    each = boxes.select(*group, F.struct(F.col("tile").alias("target"), *BOX).alias("box")).groupBy(*group).agg(F.collect_list("box").alias("boxes"))
    names = [c for c in asking.columns if c != "target"]

    def run(left, right):
        if left.empty or right.empty:
            return pd.DataFrame({c: left[c][:0] for c in names} | {"target": np.empty(0, np.int64)})
        found = []
        target, low_x, high_x, low_y, high_y, first = (np.array([b[c] for b in right["boxes"].iloc[0]]) for c in ("target", *BOX))
        step = max(1, PAIRS // len(target))
        for at in range(0, len(left), step):
            part = left.iloc[at : at + step]
            x, y, best = (part[c].to_numpy()[:, None] for c in ("x_m", "y_m", "best"))
            apart = np.hypot(np.maximum(0, np.maximum(low_x - x, x - high_x)), np.maximum(0, np.maximum(low_y - y, y - high_y)))
            apart[(first >= part["year"].to_numpy()[:, None]) | (target == part["tile"].to_numpy()[:, None])] = np.inf
            if again:
                apart[target == part["seen"].to_numpy()[:, None]] = np.inf
            nearer = apart < best
            lost = np.flatnonzero(np.isinf(best[:, 0]))
            nearer[lost] = False
            nearest = apart[lost].argmin(1)
            some = np.isfinite(apart[lost, nearest])
            nearer[lost[some], nearest[some]] = True
            i, j = np.nonzero(nearer)
            found.append(part.iloc[i].assign(target=target[j]))
        return pd.concat(found)[[*names, "target"]]

    tiles = boxes.select(*group, "tile").join(each, group)
    return asking.groupBy(*group, "tile").cogroup(tiles.groupBy(*group, "tile")).applyInPandas(run, f"{_schema(asking, names)}, target long")


def _searched(tiles: DataFrame, visits: DataFrame, group: list[str]) -> DataFrame:
    """visits with best: the distance to the nearest earlier location of the tile visited. A tile with many visitors is given to several tasks."""
    counts = visits.groupBy(*group, "target").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("parts"))
    hosts = tiles.join(counts.withColumnRenamed("target", "tile"), [*group, "tile"]).select(*group, F.col("tile").alias("target"), "year", "x_m", "y_m", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    guests = visits.drop("best").join(counts, [*group, "target"]).withColumn("part", F.pmod(F.xxhash64("slot"), "parts").cast("int")).drop("parts")
    keys = [*group, "target", "part"]

    def run(left, right):
        right = right.sort_values("year")
        found = nearest_earlier(*(right[c].to_numpy() for c in ("year", "x_m", "y_m")), *(left[c].to_numpy() for c in ("year", "x_m", "y_m")))
        return left.assign(best=found)

    return guests.groupBy(*keys).cogroup(hosts.groupBy(*keys)).applyInPandas(run, f"{_schema(guests, guests.columns)}, best double")


def nearest(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group…, slot, target_year, last_prior_year, nearest_prior_distance_m) of rows (group…, slot, year, x_m, y_m) with an earlier one in their group."""
    names = [*group, "slot", "year", "x_m", "y_m", "tile"]
    with temporary(rows.sparkSession):
        tiles = written(_dealt(rows, group).select(*names), "tiles", keep=True)
        extents = [F.min("x_m"), F.max("x_m"), F.min("y_m"), F.max("y_m"), F.min("year")]
        boxes = written(tiles.groupBy(*group, "tile").agg(*[e.alias(c) for e, c in zip(extents, BOX, strict=True)]), "tiles-boxes")
        years = tiles.groupBy(*group).agg(F.collect_set("year").alias("years"))
        home = written(_home(tiles, group), "tiles-home")
        first = written(_searched(tiles, _visits(home, boxes, group, False), group), "tiles-first")
        # those without a bound at home have visited one tile, which gave them one
        lost = home.where(F.col("best") == float("inf")).select(*group, "slot").join(first.withColumnRenamed("target", "seen"), [*group, "slot"]).select(*names, "best", "seen")
        second = _searched(tiles, _visits(lost, boxes, group, True), group)
        found = home.select(*group, "slot", "year", "best").unionByName(first.select(*group, "slot", "year", "best")).unionByName(second.select(*group, "slot", "year", "best"))
        found = found.groupBy(*group, "slot", "year").agg(F.min("best").alias("nearest_prior_distance_m")).where(F.col("nearest_prior_distance_m") < float("inf"))
        last = F.array_max(F.filter("years", lambda y: y < F.col("year")))
        out = found.join(years, group).select(*group, "slot", F.col("year").alias("target_year"), last.alias("last_prior_year"), "nearest_prior_distance_m")
        return written(out, "tiles-nearest", keep=True)
