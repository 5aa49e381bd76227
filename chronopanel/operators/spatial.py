"""Locations of events: grid keys, one event a location, nearest earlier locations, and permutations of their years.

No row is made for a pair of locations: a task holds the locations of a unit of a tile's size, and larger units go tile by
tile (see ``tiles``). Permutations within units read lists of neighbours in the order of distance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.scalar import GAP_CATEGORIES, gap_category, quantised
from chronopanel.operators import tiles
from chronopanel.operators.ordered import prefix_sums, quantiles, text_order
from chronopanel.sources.tables import written

#: Permutations that a task takes of a unit, and places of a list of neighbours at first.
BLOCK, NEIGHBOURS = 200, 8


def clean_events(events: DataFrame, observed: list[int]) -> DataFrame:
    """Events with a unit, a point, and a year among the observed ones; years that are no numbers go."""
    year = F.col("year").cast("string").try_cast("int")
    return events.withColumn("year", year).where(F.col("su_id").isNotNull() & F.col("x_m").isNotNull() & F.col("y_m").isNotNull() & F.col("year").isin(*observed))


def with_keys(events: DataFrame, tolerance: float) -> DataFrame:
    return events.withColumns({"x_key": quantised(F.col("x_m"), tolerance), "y_key": quantised(F.col("y_m"), tolerance)})


def multiplicity(events: DataFrame) -> DataFrame:
    return events.groupBy("su_id", "x_key", "y_key").agg(F.count("*").alias("records"), F.count_distinct("year").alias("distinct_years"), F.min("year").alias("earliest_year"), F.max("year").alias("latest_year"))


def fixed_locations(events: DataFrame) -> DataFrame:
    """One event for each unit and grid key: the earliest, ties by its index as text. One aggregate, no window."""
    first = F.min(F.struct("year", F.col("source_event_index").cast("string").alias("source_event_index"), "x_m", "y_m"))
    return events.groupBy("su_id", "x_key", "y_key").agg(first.alias("f")).select("su_id", "x_key", "y_key", "f.year", "f.source_event_index", "f.x_m", "f.y_m")


def event_identity(events: DataFrame) -> DataFrame:
    """events with source_event_index: that of the table or its row number (fid) where it has one, else a hash of the row, with a count among equal rows.

    It doesn't depend on partitions. All of a row's columns are hashed, so rows alike in it are alike altogether.
    """
    if given := next((c for c in events.columns if c.lower() in ("source_event_index", "fid")), None):
        return events.withColumn("source_event_index", F.col(given).cast("string"))
    row = F.sha2(F.to_json(F.struct(*sorted(events.columns)), {"ignoreNullFields": "false"}), 256)
    same = Window.partitionBy("_row").orderBy(F.lit(0))
    numbered = events.withColumn("_row", row).withColumn("_n", F.row_number().over(same))
    return numbered.withColumn("source_event_index", F.concat_ws("-", "_row", "_n")).drop("_row", "_n")


def _large(rows: DataFrame, group: list[str]) -> DataFrame | None:
    """The groups of more than a tile's locations, or None."""
    large = rows.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > tiles.SLICE).drop("_n")
    return None if large.isEmpty() else large


def nearest_prior(labels: DataFrame, missing_years: list[int], by: list[str] | None = None) -> DataFrame:
    """(by…, su_id, slot, target_year, last_prior_year, gap_years, gap_model, nearest_prior_distance_m).

    labels has (by…, su_id, slot, year, x_m, y_m), slots once in a unit. The last earlier year of the unit sets the gap, and rows whose gap holds a missing
    year are left out; the distance is the least to any earlier location, those before a gap too. A unit of more than a tile's
    locations is searched by tiles.
    """
    group = [*(by or []), "su_id"]
    rows = labels.select(*group, "slot", F.col("year").cast("int").alias("year"), "x_m", "y_m").where(~F.isnan("x_m") & ~F.isnan("y_m"))
    large = _large(rows, group)
    few = rows if large is None else rows.join(large, group, "left_anti")
    found = _nearest_in_unit(few, group)
    if large is not None:
        found = found.unionByName(tiles.nearest(rows.join(large, group, "left_semi"), group))
    return _gaps(found, missing_years)


def _nearest_in_unit(rows: DataFrame, group: list[str]) -> DataFrame:
    """A task holds a tile's number of locations at most."""
    def run(key, frame):
        frame = frame.sort_values(["year", "slot"])
        years, x, y = (frame[c].to_numpy() for c in ("year", "x_m", "y_m"))
        asked = np.flatnonzero(years > years[0])
        out = pd.DataFrame({"slot": frame["slot"].to_numpy()[asked], "target_year": years[asked], "last_prior_year": years[np.searchsorted(years, years[asked]) - 1], "nearest_prior_distance_m": tiles.nearest_earlier(years, x, y, years[asked], x[asked], y[asked])})
        for i, c in enumerate(group):
            out.insert(i, c, key[i])
        return out

    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"{c} {fields[c]}" for c in group], f"slot {fields['slot']}", "target_year int, last_prior_year int, nearest_prior_distance_m double"])
    return rows.groupBy(*group).applyInPandas(run, schema)


def _gaps(found: DataFrame, missing_years: list[int]) -> DataFrame:
    if missing_years:
        found = found.where(~F.exists(F.array(*[F.lit(y).cast("int") for y in missing_years]), lambda y: (F.col("last_prior_year") < y) & (y < F.col("target_year"))))
    return found.withColumn("gap_years", F.col("target_year") - F.col("last_prior_year")).withColumn("gap_model", gap_category(F.col("gap_years")))


def distance_summary(distances: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number and exact median of distances, overall and for each of the five categories, which are all there.

    Without ``by`` a group may be all rows, and its medians are found by radix; with it (permutations) a group has a row for each location at most,
    and one pass counts its distances for all categories.
    """
    by = by or []
    d, names = F.col("nearest_prior_distance_m"), ["overall", *[c for c, _ in GAP_CATEGORIES]]
    own = {c: d if c == "overall" else F.when(F.col("gap_model") == c, d) for c in names}
    if by:
        parts = [F.struct(F.lit(c).alias("gap_model"), F.count(x).alias("n"), F.median(x).alias("median_distance_m")) for c, x in own.items()]
        return distances.groupBy(*by).agg(F.array(*parts).alias("parts")).select(*by, F.inline("parts"))
    each = distances.withColumn("gap_model", F.explode(F.array(F.lit("overall"), F.col("gap_model"))))
    each = written(each.select("gap_model", "nearest_prior_distance_m"), "distances", keep=True)
    middle = quantiles(each, ["gap_model"], "nearest_prior_distance_m", [0.5]).select("gap_model", F.col("quantiles")[0].alias("median_distance_m"))
    found = each.groupBy("gap_model").agg(F.count("*").alias("n")).join(middle, "gap_model")
    everything = distances.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("gap_model"))
    return everything.join(found, "gap_model", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def permuted_years(locations: DataFrame, permutations: int, seed: int, scope: str = "within_slope_unit", first: int = 0) -> DataFrame:
    """(perm, su_id, slot, year, x_m, y_m): years dealt anew to the locations, within units or over all of them (global), in the order of a seeded hash."""
    perms = locations.sparkSession.range(first, first + permutations).select(F.col("id").cast("int").alias("perm"))
    rows = locations.select("su_id", "slot", "year", "x_m", "y_m").join(F.broadcast(perms))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("perm").cast("string"), F.col("su_id"), F.col("slot").cast("string")))
    if scope == "global":  # a permutation is one group: prefix sums go slice by slice
        within = ["perm"]
        rows = rows.withColumn("_h", key)
        dealt = prefix_sums(rows, within, F.conv(F.substring("_h", 1, 12), 16, 10).cast("double"), [F.col("_h")], {"at": F.lit(1)})
        places = prefix_sums(rows, within, text_order(F.col("su_id")), [F.col("su_id"), F.col("slot")], {"at": F.lit(1)}).drop("_h")
    elif scope == "within_slope_unit":
        within = ["perm", "su_id"]
        dealt = rows.withColumn("at", F.row_number().over(Window.partitionBy(*within).orderBy(key)))
        places = rows.withColumn("at", F.row_number().over(Window.partitionBy(*within).orderBy("slot")))
    else:
        raise ValueError(f"no scope {scope}: within_slope_unit or global")
    return places.drop("year").join(dealt.select(*within, "at", "year"), [*within, "at"]).drop("at")


def neighbours(x: np.ndarray, y: np.ndarray, own: np.ndarray, first: int, last: int) -> np.ndarray:
    """For each own row the rows at places first to last of all rows in the order of distance (itself comes first, or rows at its very place)."""
    apart = np.hypot(x[own, None] - x, y[own, None] - y)
    if last < len(x):
        near = np.argpartition(apart, last - 1, axis=1)[:, :last]
        order = np.take_along_axis(near, np.argsort(np.take_along_axis(apart, near, 1), axis=1, kind="stable"), 1)
    else:
        order = np.argsort(apart, axis=1, kind="stable")
    return order[:, first:last]


def nearest_by_lists(dealt: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distance to the nearest location of an earlier year, for each permutation (row of dealt) and location; infinite where there is none.

    A permutation reads each location's list of neighbours up to the first whose year is earlier. Lists have NEIGHBOURS places at
    first, and only the (permutation, location) pairs still open are looked up in longer ones.
    """
    n = len(x)
    found = np.full(dealt.shape, np.inf)
    open_ = dealt > dealt.min(1, keepdims=True)
    first, last = 0, min(n, NEIGHBOURS)
    while True:
        own = np.flatnonzero(open_.any(0))
        step = max(1, tiles.PAIRS // n)
        for at in range(0, len(own), step):
            some = own[at : at + step]
            lists = neighbours(x, y, some, first, last)
            perm, row = np.nonzero(open_[:, some])
            for begin in range(0, len(perm), most := max(1, tiles.PAIRS // (last - first))):
                p, r = perm[begin : begin + most], row[begin : begin + most]
                earlier = dealt[p[:, None], lists[r]] < dealt[p, some[r]][:, None]
                there = np.flatnonzero(earlier.any(1))
                p, r = p[there], r[there]
                at_list, i = lists[r, earlier[there].argmax(1)], some[r]
                found[p, i] = np.hypot(x[i] - x[at_list], y[i] - y[at_list])
                open_[p, i] = False
        if last == n:
            return found
        first, last = last, min(n, 8 * last)


def permuted_nearest(locations: DataFrame, permutations: int, seed: int, missing_years: list[int], first: int = 0) -> DataFrame:
    """:func:`nearest_prior` of :func:`permuted_years` within units, by lists of neighbours: no row for a pair and permutation.

    A task holds one unit's locations, a tile's number at most, for BLOCK permutations; units of more are permuted by Spark and searched by tiles.
    """
    blocks = locations.sparkSession.range(-(-permutations // BLOCK)).withColumnRenamed("id", "block")
    located = locations.where(~F.isnan("x_m") & ~F.isnan("y_m"))
    large = _large(located, ["su_id"])
    few = located if large is None else located.join(large, "su_id", "left_anti")
    rows = few.select("su_id", "slot", F.col("year").cast("int").alias("year"), "x_m", "y_m").join(F.broadcast(blocks))

    def run(key, frame):
        unit, block = key
        frame = frame.sort_values("slot")
        slots, years, x, y = (frame[c].to_numpy() for c in ("slot", "year", "x_m", "y_m"))
        known, names = np.unique(years), [str(s).encode() for s in slots]
        perms = range(first + int(block) * BLOCK, first + min(permutations, (int(block) + 1) * BLOCK))
        dealt = np.empty((len(perms), len(slots)), years.dtype)
        for k, perm in enumerate(perms):
            begun, keys = hashlib.md5(f"{seed}|{perm}|{unit}|".encode()), []
            for name in names:
                (own := begun.copy()).update(name)
                keys.append(own.digest())
            dealt[k] = years[sorted(range(len(keys)), key=keys.__getitem__)]
        found = nearest_by_lists(dealt, x, y)
        k, at = np.nonzero(dealt > known[0])
        own = dealt[k, at]
        return pd.DataFrame({"perm": np.asarray(perms)[k], "su_id": unit, "slot": slots[at], "target_year": own, "last_prior_year": known[np.searchsorted(known, own) - 1], "nearest_prior_distance_m": found[k, at]})

    found = rows.groupBy("su_id", "block").applyInPandas(run, f"perm int, su_id string, slot {locations.schema['slot'].dataType.simpleString()}, target_year int, last_prior_year int, nearest_prior_distance_m double")
    if large is not None:
        labels = permuted_years(located.join(large, "su_id", "left_semi"), permutations, seed, first=first)
        found = found.unionByName(tiles.nearest(labels.select("perm", "su_id", "slot", F.col("year").cast("int").alias("year"), "x_m", "y_m"), ["perm", "su_id"]))
    return _gaps(found, missing_years)


def null_summary(observed: DataFrame, draws: DataFrame) -> DataFrame:
    """Observed medians against those of the draws (perm, gap_model, n, median_distance_m)."""
    obs = observed.select("gap_model", F.col("n").alias("observed_n"), F.col("median_distance_m").alias("observed_median_m"))
    joined = draws.join(F.broadcast(obs), "gap_model")
    d = F.col("median_distance_m")
    out = joined.groupBy("gap_model", "observed_n", "observed_median_m").agg(
        F.median(d).alias("null_median_m"), F.percentile(d, F.lit(0.025)).alias("null_CI_low_m"), F.percentile(d, F.lit(0.975)).alias("null_CI_high_m"),
        F.count(d).alias("n_permutations"), F.count_if(d <= F.col("observed_median_m")).alias("n_null_at_or_below_observed"),
    )
    ratio = F.when(F.col("null_median_m") > 0, F.col("observed_median_m") / F.col("null_median_m"))
    return out.withColumn("observed_null_ratio", ratio).withColumn("percent_shorter_than_null", 100 * (1 - F.col("observed_null_ratio"))).withColumn("empirical_p_one_sided", (F.col("n_null_at_or_below_observed") + 1) / (F.col("n_permutations") + 1))


def year_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events of each year before and after one is kept for each location."""
    a = before.groupBy("year").agg(F.count("*").alias("raw_valid_event_rows"))
    b = after.groupBy("year").agg(F.count("*").alias("fixed_location_rows"))
    out = a.join(b, "year", "full").na.fill(0)
    return out.withColumn("rows_removed_by_deduplication", F.col("raw_valid_event_rows") - F.col("fixed_location_rows"))
