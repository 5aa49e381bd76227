"""Layers of a GeoPackage, which is an SQLite file with well-known-binary geometry.

The file is shipped to the executors once, and tasks read ranges of its row numbers. Coordinates become metres of the system asked for before anything is
measured: points keep theirs, polygons give their area and a point inside them, lines the middle of their box.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Callable
from contextlib import closing

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from chronopanel.functions import projection

#: Bytes of the envelope by its code in the header's flags.
ENVELOPE_BYTES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
NAMES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
ROWS = 20_000

Ring = list[tuple[float, float]]


def _rings(wkb: bytes, at: int = 0) -> tuple[int, list[Ring], int]:
    """A geometry's kind, its lists of coordinates (rings of polygons), and where it ends."""
    order = "<" if wkb[at] else ">"
    kind = struct.unpack_from(f"{order}I", wkb, at + 1)[0]
    wide = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)
    at += 5

    def some(n: int) -> Ring:
        nonlocal at
        out = [struct.unpack_from(f"{order}{wide}d", wkb, at + 8 * wide * i)[:2] for i in range(n)]
        at += 8 * wide * n
        return out

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(f"{order}I", wkb, at - 4)[0]

    base = kind % 1000
    if base == 1:
        return base, [some(1)], at
    if base == 2:
        return base, [some(number())], at
    if base == 3:
        return base, [some(number()) for _ in range(number())], at
    out = []
    for _ in range(number()):
        _, part, at = _rings(wkb, at)
        out += part
    return base, out, at


def area(rings: list[Ring]) -> float:
    """Of polygons: rings that lie in an odd number of others are holes, by orientation-free even-odd counting of their first points."""
    whole = 0.0
    for i, ring in enumerate(rings):
        own = abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
        depth = sum(_inside(ring[0], other) for j, other in enumerate(rings) if j != i)
        whole += -own if depth % 2 else own
    return whole


def _inside(point: tuple[float, float], ring: Ring) -> bool:
    x, y = point
    return sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1


def inner_point(rings: list[Ring]) -> tuple[float, float]:
    """A point inside polygons: the middle of the widest stretch within them at the middle height."""
    ys = sorted({y for r in rings for _, y in r})
    middle = (ys[0] + ys[-1]) / 2
    above, below = [y for y in ys if y > middle], [y for y in ys if y <= middle]
    y = (above[0] + below[-1]) / 2 if above and below else middle  # off every corner
    xs = sorted(x1 + (y - y1) * (x2 - x1) / (y2 - y1) for r in rings for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1], strict=True) if (y1 > y) != (y2 > y))
    if not xs:
        return _box_middle(rings)
    _, left, right = max((b - a, a, b) for a, b in zip(xs[::2], xs[1::2], strict=True))
    return (left + right) / 2, y


def _box_middle(rings: list[Ring]) -> tuple[float, float]:
    xs, ys = zip(*[p for r in rings for p in r], strict=True)
    return (min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2


def described(blob: bytes | None, project: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[str | None, float | None, float | None, float | None]:
    """Type, x, y and area of a geometry, of which every corner is projected first; nulls for a null or empty one."""
    if not blob or blob[:2] != b"GP" or blob[3] & 16:
        return None, None, None, None
    kind, rings, _ = _rings(blob, 8 + ENVELOPE_BYTES[blob[3] >> 1 & 7])
    if not any(rings):
        return NAMES.get(kind), None, None, None
    if project:
        x, y = project(*np.array([p for r in rings for p in r], float).T)
        corners = iter(zip(x.tolist(), y.tolist(), strict=True))
        rings = [[next(corners) for _ in r] for r in rings]
    if kind in (3, 6):
        return NAMES[kind], *inner_point(rings), area(rings)
    return NAMES.get(kind), *_box_middle(rings), None


def projection_of(db: sqlite3.Connection, layer: str, srs: int, crs: int | str | None) -> Callable | None:
    """What takes a layer's coordinates to those of ``crs`` (None: the layer's own); None where nothing is to be done.

    A layer in degrees needs a system in metres, and one without a system can't be taken to another.
    """
    codes = {}
    if db.execute("SELECT count(*) FROM sqlite_master WHERE name = 'gpkg_spatial_ref_sys'").fetchone()[0]:
        codes = {s: c for s, o, c in db.execute("SELECT srs_id, organization, organization_coordsys_id FROM gpkg_spatial_ref_sys") if str(o).upper() == "EPSG"}
    code = codes.get(srs, srs)
    if crs is None:
        if code == 4326 or code in range(4001, 4999):  # the numbers of geographic systems
            raise ValueError(f"layer {layer} is in degrees: name a projected system for it")
        return None
    target = projection.metric(crs)
    if srs in (0, -1):
        raise ValueError(f"layer {layer} has no reference system, so it can't be taken to {crs}")
    source = projection.system(code)
    return None if source == target else lambda x, y: target.forward(*source.inverse(x, y))


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None, crs: int | str | None = None) -> DataFrame:
    """A layer's attributes as text, with srs_id, geometry_type, x_m, y_m and su_area_m2 (of polygons), in metres of ``crs`` (an EPSG number) if it's given."""
    spark.sparkContext.addFile(path)
    name = path.rpartition("/")[2]
    with closing(sqlite3.connect(f"file:{SparkFiles.get(name)}?mode=ro", uri=True)) as db:
        layers = {n: (c, s) for n, c, s in db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns")}
        layer = layer or next(iter(layers))
        geometry, srs = layers[layer]
        project = projection_of(db, layer, srs, crs)
        names = [d[0] for d in db.execute(f'SELECT * FROM "{layer}" LIMIT 0').description]
        low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{layer}"').fetchone()
    plain = [n for n in names if n != geometry]
    made = [("srs_id", "int", pa.int32()), ("geometry_type", "string", pa.string()), ("x_m", "double", pa.float64()), ("y_m", "double", pa.float64()), ("su_area_m2", "double", pa.float64())]
    made = [m for m in made if m[0] not in plain]
    query = ", ".join(f'"{n}"' for n in [*plain, geometry])

    def run(batches):
        with closing(sqlite3.connect(f"file:{SparkFiles.get(name)}?mode=ro", uri=True)) as db:
            for batch in batches:
                for first in batch.column("first").to_pylist():
                    rows = db.execute(f'SELECT {query} FROM "{layer}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid', (first, min(high, first + ROWS - 1))).fetchall()
                    shapes = [described(r[-1], project) for r in rows]
                    values = {"srs_id": [srs] * len(rows), **{k: [s[i] for s in shapes] for i, k in enumerate(("geometry_type", "x_m", "y_m", "su_area_m2"))}}
                    texts = [pa.array([None if r[i] is None else str(r[i]) for r in rows], pa.string()) for i in range(len(plain))]
                    yield pa.RecordBatch.from_arrays([*texts, *[pa.array(values[k], t) for k, _, t in made]], [*plain, *[k for k, _, _ in made]])

    schema = ", ".join([*[f"`{n}` string" for n in plain], *[f"{k} {t}" for k, t, _ in made]])
    ranges = spark.range(low or 0, (high if high is not None else -1) + 1, ROWS).withColumnRenamed("id", "first")
    return ranges.mapInArrow(run, schema)
