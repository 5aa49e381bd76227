"""Tables under the input contract: fields by alias, identifiers, keys, cardinality, and checks of each kind of input."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.functions import projection
from chronopanel.functions.scalar import normalised, trimmed
from chronopanel.sources import files

# For each field the names under which a column may come; the first of them that is there is taken.
FIELDS = {
    "su_id": ("su_id", "SU_ID", "suid", "SUID", "slope_unit_id", "slopeunit_id", "cat"),
    "year": ("year", "event_year", "Year", "YEAR", "year_original"),
    "landslide_count": ("landslide_count", "n_landslides", "count"),
    "active": ("active", "landslide_occurrence", "occurrence"),
    "shallow_count": ("shallow_count", "shallow_landslide_count", "n_shallow"),
    "shallow_active": ("shallow_active", "shallow_occurrence"),
    "landslide_type": ("landslide_type", "type", "movement_type"),
    "parent_material": ("parent_material_code", "parent_material", "parent_material_name", "dominant_parent_material", "lithology"),
    "grid_id": ("grid_id", "gridcell_id", "cell_id", "grid"),
    "weight": ("weight", "overlap_weight", "area_weight", "overlap_area", "area_m2"),
    "monsoon_rainfall_mm": ("monsoon_rainfall_mm", "monsoon_mm", "monsoon_rainfall"),
    "rx1day_mm": ("rx1day_mm", "Rx1day", "rx1"),
    "rx3day_mm": ("rx3day_mm", "Rx3day", "rx3"),
    "rx5day_mm": ("rx5day_mm", "Rx5day", "rx5"),
    "rx7day_mm": ("rx7day_mm", "Rx7day", "rx7"),
    "rx10day_mm": ("rx10day_mm", "Rx10day", "rx10"),
    "rx15day_mm": ("rx15day_mm", "Rx15day", "rx15"),
    "rx30day_mm": ("rx30day_mm", "Rx30day", "rx30"),
}
RAINFALL = ("monsoon_rainfall_mm", *[f"rx{n}day_mm" for n in (1, 3, 5, 7, 10, 15, 30)])

CHECKS_SCHEMA = "file string, check string, passed boolean, detail string"


class ContractError(ValueError):
    """A table that doesn't keep the contract."""


def resolved(columns: Iterable[str], fields: Iterable[str], table: Mapping[str, tuple[str, ...]] = FIELDS) -> dict[str, str]:
    """The column of each field that has one: an alias as it is written, else one that differs in case only."""
    own = list(columns)
    spelt = {c.lower(): c for c in reversed(own)} | {c: c for c in own}
    choices = {f: [spelt[k] for alias in table.get(f, (f,)) for k in (alias, alias.lower()) if k in spelt] for f in fields}
    return {f: found[0] for f, found in choices.items() if found}


def canonicalise(df: DataFrame, required: Iterable[str] = ("su_id",), optional: Iterable[str] = ()) -> DataFrame:
    """df with fields under their canonical names; identifiers trimmed text, years whole numbers.

    All missing fields are named in one error. Null identifiers raise when read.
    """
    required, optional = list(required), list(optional)
    found = resolved(df.columns, [*required, *optional])
    if missing := [f"{f} (as any of {', '.join(FIELDS.get(f, (f,)))})" for f in required if f not in found]:
        raise ContractError(f"no column for {'; '.join(missing)} among {', '.join(df.columns)}")
    rest = [c for c in df.columns if c not in found.values() and c not in found]
    df = df.select(*[F.col(f"`{c}`").alias(f) for f, c in found.items()], *[F.col(f"`{c}`") for c in rest])
    if "su_id" in found:
        df = df.withColumn("su_id", F.coalesce(trimmed(F.col("su_id")), F.raise_error(F.lit("null su_id")).cast("string")))
    if "year" in found:
        df = df.withColumn("year", F.col("year").cast("int"))
    return df


def raw_table(spark: SparkSession, path: str, schema: str | None = None, crs: int | str | None = None) -> DataFrame:
    """Parquet, GeoPackage, or CSV with a header, by the path's suffix, with its own names; points as metres of ``crs`` if it's given.

    Tables other than GeoPackages have metres in x_m and y_m, or degrees in lon and lat, which become metres.
    """
    if path.endswith(".gpkg"):
        from chronopanel.sources.geopackage import read_geopackage

        return read_geopackage(spark, path, crs=crs)
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if {"lon", "lat"} <= set(df.columns) and not {"x_m", "y_m"} <= set(df.columns):
        if crs is None:
            raise ContractError(f"{path} has degrees: name a projected system for them")
        df = projection.reprojected(df, "lon", "lat", 4326, crs)
    return df


def read_table(spark: SparkSession, path: str, required: Iterable[str] = ("su_id",), schema: str | None = None, crs: int | str | None = None) -> DataFrame:
    return canonicalise(raw_table(spark, path, schema, crs), required)


def one_of(spark: SparkSession, folder: str, candidates: Iterable[str]) -> str:
    """The path of the one candidate that exists, in whatever file system the folder is."""
    candidates = list(candidates)
    found = [p for p in (f"{folder.rstrip('/')}/{c}" for c in candidates) if files.exists(spark, p)]
    if len(found) != 1:
        raise ContractError(f"expected one of {', '.join(candidates)} in {folder}, found {len(found)}")
    return found[0]


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def keyed(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """df itself, if no key repeats; else an error with ten such keys."""
    shown = "; ".join(" ".join(f"{k}={r[k]}" for k in keys) for r in repeated_keys(df, keys).limit(10).collect())
    if shown:
        raise ContractError(f"{label}: {', '.join(keys)} should be a key, but repeats at {shown}")
    return df


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], label: str = "right side", one_to_one: bool = False) -> DataFrame:
    """A left join, after checking that no key repeats on the right (with one_to_one on the left as well)."""
    return (keyed(left, keys, f"left of {label}") if one_to_one else left).join(keyed(right, keys, label), keys, "left")


def period_check(panel: DataFrame, expected: list[int]) -> DataFrame:
    """One row: whether the observed years are the expected ones, whether each unit has them all, and counts."""
    units = panel.groupBy("su_id").agg(F.count_distinct("year").alias("k"), F.count("*").alias("n"))
    years = panel.agg(F.array_sort(F.collect_set("year")).alias("years"))
    sizes = units.agg(F.count("*").alias("units"), F.sum("n").cast("long").alias("rows"), F.bool_and(F.col("k") == len(expected)).alias("balanced"))
    wanted = F.array(*[F.lit(y).cast("int") for y in sorted(expected)])
    return years.join(F.broadcast(sizes)).select("units", "rows", "balanced", (F.col("years") == wanted).alias("years_as_expected"))


def contract_checks(df: DataFrame, required: Mapping[str, tuple[str, ...]], name: str) -> DataFrame:
    """(file, check, passed, detail): a row for each field of ``required`` (a table of aliases) and for whether there are rows."""
    found = resolved(df.columns, required, required)
    rows = [(name, f"has {f}", f in found, found.get(f, f"none of {', '.join(aliases)}")) for f, aliases in required.items()]
    n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("file"), F.lit("has rows").alias("check"), (F.col("n") > 0).alias("passed"), F.col("n").cast("string").alias("detail"))
    return df.sparkSession.createDataFrame(rows, CHECKS_SCHEMA).unionByName(n)


def _counted(df: DataFrame, name: str, counts: Mapping[str, tuple]) -> DataFrame:
    """Check rows from one pass: each check's (count, whether it must be zero)."""
    row = df.agg(*[c.cast("long").alias(k) for k, (c, _) in counts.items()])
    long = row.unpivot([], list(counts), "check", "n")
    zero = F.col("check").isin(*[k for k, (_, z) in counts.items() if z])
    return long.select(F.lit(name).alias("file"), "check", F.when(zero, F.col("n") == 0).otherwise(F.col("n") > 0).alias("passed"), F.col("n").cast("string").alias("detail"))


def input_checks(df: DataFrame, kind: str, name: str, terrain: Iterable[str] = (), has_events: bool = False) -> DataFrame:
    """Check rows of one input by its kind.

    Kinds: response, rainfall, terrain (which must hold the columns named by ``terrain``), parent_material, grid_weights, events and slope_units.
    """
    fields = {
        "response": ["su_id", "year"], "rainfall": ["su_id", "year", *RAINFALL], "terrain": ["su_id"], "parent_material": ["su_id", "parent_material"],
        "grid_weights": ["su_id", "grid_id", "weight"], "events": ["su_id", "year", "landslide_type"], "slope_units": ["su_id"],
    }[kind]
    wanted = {f: FIELDS[f] for f in fields} | {c: (c,) for c in (terrain if kind == "terrain" else ())}
    out = [contract_checks(df, wanted, name)]
    own = resolved(df.columns, FIELDS)
    column = lambda f: F.col(f"`{own[f]}`")
    if "su_id" in own:
        out.append(_counted(df, name, {"units without a name": (F.count_if(column("su_id").isNull()), True)}))
    if kind in ("response", "rainfall", "terrain", "parent_material") and all(f in own for f in fields[:2] if f in ("su_id", "year")):
        keys = [f for f in ("su_id", "year") if f in fields]
        repeated = df.select(*[column(k).cast("string").alias(k) for k in keys]).groupBy(*keys).agg(F.count("*").alias("n"))
        out.append(_counted(repeated, name, {f"repeated {' '.join(keys)}": (F.count_if(F.col("n") > 1), True)}))
    if kind == "response":
        held = [f for f in ("landslide_count", "active", "shallow_count", "shallow_active") if f in own]
        # what is absent here is derived from events, if there are any
        rows = [(name, "response or events", bool(held) or has_events, ", ".join(held) or ("derived from events" if has_events else "no response column and no events"))]
        out.append(df.sparkSession.createDataFrame(rows, CHECKS_SCHEMA))
    if kind in ("events", "slope_units"):
        placed = {"x_m", "y_m"} <= set(df.columns)
        rows = [(name, "has points", placed, "x_m, y_m" if placed else "no x_m and y_m")]
        out.append(df.sparkSession.createDataFrame(rows, CHECKS_SCHEMA))
        if placed:
            out.append(_counted(df, name, {"rows without geometry": (F.count_if(F.col("x_m").isNull() | F.col("y_m").isNull()), True)}))
        if "srs_id" in df.columns:  # as GeoPackages have it: 0 and -1 stand for undefined ones
            out.append(_counted(df, name, {"rows without a spatial reference": (F.count_if(F.coalesce(F.col("srs_id"), F.lit(0)) <= 0), True)}))
    if kind == "events" and "landslide_type" in own:
        out.append(_counted(df, name, {"shallow events": (F.count_if(normalised(column("landslide_type")) == "shallow"), False)}))
    if kind == "slope_units" and "geometry_type" in df.columns:
        out.append(_counted(df, name, {"rows that are no polygons": (F.count_if(~F.coalesce(F.col("geometry_type").isin("Polygon", "MultiPolygon"), F.lit(False))), True)}))
    return reduce(DataFrame.unionByName, out)


def assert_passed(checks: DataFrame) -> None:
    """Raise with the checks that failed."""
    if failed := checks.where(~F.col("passed")).limit(20).collect():
        raise ContractError("; ".join(f"{r['file']}: {r['check']} ({r['detail']})" for r in failed))
