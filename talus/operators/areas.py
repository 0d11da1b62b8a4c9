"""Points in boxes: a range join by grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.discovery import tag

#: Tags of which any makes a named feature a place of business, values of two others, and features of an area at most (fixed values).
ANY_VALUE = ["office", "company", "shop", "craft", "healthcare", "amenity", "tourism", "leisure", "industrial"]
BUILDINGS = ["commercial", "office", "industrial", "retail"]
LANDUSE = "commercial"
MOST = 6000
#: Degrees of the finest cells: the widest box of ``companies.box`` spans two or three of them.
CELL = 0.13
#: Cells to a side of those, where the first points of a box are sought.
PARTS = 8
CELLS, BORDERS = ["__level", "__y", "__x"], ["south", "west", "north", "east"]


def is_business(tags: Column) -> Column:
    """Named, with one of the eleven tags. Tags count if they are there, whatever their value, but for building and landuse."""
    there = F.greatest(*[F.coalesce(F.map_contains_key(tags, F.lit(k)), F.lit(False)) for k in ANY_VALUE])
    named = F.coalesce(F.map_contains_key(tags, F.lit("name")), F.lit(False))
    return named & (there | tag(tags, "building").isin(BUILDINGS) | (tag(tags, "landuse") == LANDUSE))


def _cell(c: Column, size: Column) -> Column:
    return F.floor(c / size)


def _sized(boxes: DataFrame, cell: float, parts: int) -> DataFrame:
    """Boxes whose borders are the right way round, with ``__level`` and the cells that they meet, ``parts`` to a side of the level.

    ``__whole`` cells lie inside: what is between the cells of two borders is between the borders, as flooring keeps order.
    """
    sides = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"))
    right = (F.col("north") >= F.col("south")) & (F.col("east") >= F.col("west")) & ~F.isnan(sides) & (sides < float("inf"))
    levels = F.greatest(F.lit(0), F.ceil(F.log2(F.nullif(sides, F.lit(0.0)) / cell))).cast("int")
    sized = boxes.where(right).withColumn("__level", F.coalesce(levels, F.lit(0)))
    ends = {k: _cell(F.col(k), _size(cell, parts)) for k in ("south", "north", "west", "east")}
    met = sized.withColumn("__y", F.explode(F.sequence(ends["south"], ends["north"]))).withColumn("__x", F.explode(F.sequence(ends["west"], ends["east"])))
    y, x = F.col("__y"), F.col("__x")
    return met.withColumn("__whole", (y > ends["south"]) & (y < ends["north"]) & (x > ends["west"]) & (x < ends["east"]))


def _size(cell: float, parts: int) -> Column:
    return F.pow(F.lit(2.0), F.col("__level")) * (cell / parts)


def _placed(points: DataFrame, used: list[int], cell: float, parts: int) -> DataFrame:
    """Points that have coordinates, in their cell of each used level."""
    placed = _somewhere(points).withColumn("__level", F.explode(F.array(*map(F.lit, used)).cast("array<int>")))
    return placed.withColumn("__y", _cell(F.col("latitude"), _size(cell, parts))).withColumn("__x", _cell(F.col("longitude"), _size(cell, parts)))


def _somewhere(points: DataFrame) -> DataFrame:
    return points.where(~F.isnan("latitude") & ~F.isnan("longitude") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def _used(cells: DataFrame) -> list[int]:
    return sorted(r[0] for r in cells.select("__level").distinct().collect())  # one for each doubling


def _met(placed: DataFrame, cells: DataFrame) -> DataFrame:
    met = placed.join(cells, CELLS).drop(*CELLS)
    return met.where(F.col("latitude").between(F.col("south"), F.col("north")) & F.col("longitude").between(F.col("west"), F.col("east")))


def inside(points: DataFrame, boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """Each pair of a point (latitude, longitude) and a box (south, west, north, east) that holds it, borders included.

    A box looks for points in the cells that it meets, at the level of a grid whose cells are as wide as its longer side, so it
    meets at most nine; levels double in size, and points are put into a cell of each level that some box has (a few tens at
    most, as each doubles). Pairs meet by equal cells, then the exact bounds decide. No point meets a box twice. Rows with a
    null or NaN coordinate, and boxes whose borders are the wrong way round, pair with nothing.
    """
    cells = _sized(boxes, cell, 1).drop("__whole")
    return _met(_placed(points, _used(cells), cell, 1), cells)


def _first(rows: DataFrame, keys: list[str], most: int, place: str = "__place") -> DataFrame:
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).where(F.col(place) <= most)


def first_inside(points: DataFrame, boxes: DataFrame, most: int, cell: float = CELL) -> DataFrame:
    """Of ``inside``, at least the first ``most`` points (``ord``) of each box, and few others.

    A box that holds a place holds all points there, so only the first ``most`` of each place meet boxes, and equal boxes are
    searched once. Of a cell that lies inside the box only the first ``most`` points meet it; cells are eighths of those of
    ``inside``, so that most of a large box is such cells.
    """
    shapes = _sized(boxes.select(*BORDERS).distinct(), cell, PARTS)
    spots = _first(_somewhere(points), ["latitude", "longitude"], most).drop("__place")
    placed = _placed(spots, _used(shapes), cell, PARTS)
    whole = _met(_first(placed, CELLS, most).drop("__place"), shapes.where("__whole").drop("__whole"))
    found = whole.unionByName(_met(placed, shapes.where("NOT __whole").drop("__whole")))
    return _first(found, BORDERS, most).drop("__place").join(boxes, BORDERS)


def businesses(features: DataFrame, boxes: DataFrame, most: int = MOST) -> DataFrame:
    """The places of business inside each area (``area``), the first ``most`` of it by ``ord``."""
    return _first(first_inside(features.where(is_business(F.col("tags"))), boxes, most), ["area"], most, "place")
