"""Location operators: hourly wide <-> long, area assignment, nearest centre, tag join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import AREA_BOXES, CLUSTER_CENTRES
from ..session import bounded_broadcast, materialize

HOURS = 24


def unpivot_hours(wide: DataFrame, keys: Sequence[str], hours: int = HOURS,
                  hour: str = "hr") -> DataFrame:
    """Wide rows -> one row per hour with a valid point (x != 0 and y != 0).

    A generator (``stack``) in one projection: no shuffle, stays in codegen.
    """
    args = ", ".join(f"{h}, x{h}, y{h}" for h in range(hours))
    long = wide.selectExpr(*[f"`{k}`" for k in keys], f"stack({hours}, {args}) as (`{hour}`, x, y)")
    return long.where("x != 0 and y != 0")


def area_table(spark: SparkSession, boxes=AREA_BOXES) -> DataFrame:
    return spark.createDataFrame(
        boxes, "areaid int, x_min double, x_max double, y_min double, y_max double")


def centre_table(spark: SparkSession, centres=CLUSTER_CENTRES) -> DataFrame:
    rows = [(a, i, x, y) for a, pts in centres.items() for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "areaid int, clusterid int, cx double, cy double")


def grid_cell(areas: DataFrame, per_side: int = 4) -> float:
    """Side of the grid cells: the largest box side over ``per_side``, so a box covers at most
    ``(per_side + 1) ** 2`` cells."""
    widest = areas.agg(F.max(F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")))).first()[0]
    return max(widest or 0.0, 1e-9) / per_side


def _cells_of(areas: DataFrame, side) -> DataFrame:
    """A row per box and grid cell of ``side`` that it touches."""
    return (areas
            .withColumn("_cell_x", F.explode(F.sequence(F.floor(F.col("x_min") / side), F.floor(F.col("x_max") / side))))
            .withColumn("_cell_y", F.explode(F.sequence(F.floor(F.col("y_min") / side), F.floor(F.col("y_max") / side)))))


def area_candidates(points: DataFrame, areas: DataFrame, x: str = "x", y: str = "y", cell: float | None = None,
                    known_bytes: int | None = None) -> DataFrame:
    """Points beside the boxes whose cells they fall in (columns of both); ``assign_area`` tests them exactly.

    With ``cell``, one grid serves all boxes. Without it a box lies on the grid
    of its own size, cells of a power of two at least as wide as the box, so it
    touches four at most, and a point looks up one cell per grid in use. A
    huge box among many small ones is then met once per point, and a small one
    only by points near it.
    """
    px, py = F.col(x), F.col(y)
    if cell is not None:
        cells = _cells_of(areas, F.lit(cell))
        keyed, on = points.withColumn("_cell_x", F.floor(px / cell)).withColumn("_cell_y", F.floor(py / cell)), ["_cell_x", "_cell_y"]
    else:
        wide = F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"), F.lit(2.0 ** -40))
        leveled = areas.withColumn("_level", F.ceil(F.log2(wide)).cast("int"))
        # One value per power of two between the smallest and the largest box.
        levels = sorted(r[0] for r in leveled.select("_level").where("_level is not null").distinct().collect())
        side = F.pow(F.lit(2.0), F.col("_level"))
        cells = _cells_of(leveled, side)
        keyed = points.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
        keyed = keyed.withColumn("_cell_x", F.floor(px / side)).withColumn("_cell_y", F.floor(py / side))
        on = ["_level", "_cell_x", "_cell_y"]
    return keyed.join(bounded_broadcast(cells, known_bytes=known_bytes), on, "inner").drop(*on)


def assign_area(points: DataFrame, areas: DataFrame, x: str = "x", y: str = "y",
                cell: float | None = None, known_bytes: int | None = None) -> DataFrame:
    """Points inside a box (closed bounds) get its ``areaid``; others are dropped.

    Boxes are cut into grid cells (``area_candidates``) and joined to the
    points on the cell, then tested exactly: no box is compared with every
    point. The cell table is broadcast after a check of its bytes, so the
    points are not shuffled; beyond the bound the same join shuffles by cell.
    Overlapping boxes give a point one row per box that holds it.
    """
    boxes = areas.select("areaid", "x_min", "x_max", "y_min", "y_max")
    found = area_candidates(points, boxes, x, y, cell, known_bytes)
    inside = F.col(x).between(F.col("x_min"), F.col("x_max")) & F.col(y).between(F.col("y_min"), F.col("y_max"))
    return found.where(inside).select(*points.columns, "areaid")


#: Parts that the points of an area are dealt to when its centres are not broadcast.
SALTS = 64


def nearest_centre(points: DataFrame, centres: DataFrame, area: str = "areaid",
                   x: str = "x", y: str = "y", max_bytes: int | None = None,
                   known_bytes: int | None = None) -> DataFrame:
    """Adds ``clusterid``: the closest centre of the point's area (squared
    Euclidean distance), ties to the lowest id; null if the area has none.

    The centres of each area are gathered into one array (the k of a
    clustering model, a model-sized bound) and each point picks its minimum
    with ``array_min(transform(...))``: no fan-out of points, no per-point
    group-by. The array table is broadcast after a check of its bytes. Beyond
    the bound the points of an area are dealt over ``SALTS`` parts and each
    part gets a copy of the arrays, so no area lands in one task.
    """
    px, py = F.col(x), F.col(y)

    def dist(c):
        dx, dy = px - c["cx"], py - c["cy"]
        return F.struct((dx * dx + dy * dy).alias("d"), c["clusterid"].alias("clusterid"))

    best = F.array_min(F.transform("_c", dist))["clusterid"].alias("clusterid")
    per_area = (centres.groupBy(area)
                       .agg(F.collect_list(F.struct("clusterid", "cx", "cy")).alias("_c")))
    limits = {} if max_bytes is None else {"max_bytes": max_bytes}
    checked = bounded_broadcast(centres, known_bytes=known_bytes, **limits)
    if checked is not centres:  # the arrays hold what the centres hold
        return points.join(F.broadcast(per_area), area, "left").select(*points.columns, best)
    dealt = points.withColumn("_salt", F.pmod(F.xxhash64(px, py), F.lit(SALTS)))
    copies = per_area.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, [area, "_salt"], "left").select(*points.columns, best)


#: A cell's list of at most the first number is final, and one of at most the second that a cut did not
#: shorten: around a point with as many centres equally near, no cut would. The third is how often a cell may be cut.
LEAF_CENTRES, LEAF_TIES, MOST_CUTS = 32, 64, 24


def centre_cells(centres: DataFrame, area: str = "areaid") -> DataFrame:
    """(area, _x0, _y0, _side, _level, _i, _j, _near): cells with the centres that can be nearest to a point in them.

    A cell's list leaves out a centre only if another one is nearer to every
    point of the cell: the least distance of the one is above the greatest
    distance of the other. An area's square, its centres and half their extent
    around them, is one cell of all centres; a cell with a long list is cut in
    four, whose lists come from its own, so the lists of a level together hold
    little more than all centres: k log k tests in all. The leaves cover the square without overlap. Of centres at one
    place the lowest id is kept.
    """
    one = centres.groupBy(area, "cx", "cy").agg(F.min("clusterid").alias("clusterid"))
    extent = F.greatest(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy"), F.lit(2.0 ** -40))
    whole = one.groupBy(area).agg(F.collect_list(F.struct("clusterid", "cx", "cy")).alias("_near"), extent.alias("_w"),
                                  F.min("cx").alias("_cx"), F.min("cy").alias("_cy"))
    zero = F.lit(0)
    open_ = materialize(whole.select(
        area, (F.col("_cx") - F.col("_w") / 2).alias("_x0"), (F.col("_cy") - F.col("_w") / 2).alias("_y0"), (F.col("_w") * 2).alias("_side"),
        zero.alias("_level"), zero.alias("_i"), zero.alias("_j"), "_near", F.lit(2 ** 31 - 1).alias("_had")))
    n = F.size("_near")
    final = (n <= LEAF_CENTRES) | ((n <= LEAF_TIES) & (n >= F.col("_had")))
    leaves = open_.where(final)
    for level in range(1, MOST_CUTS + 1):
        large = open_.where(~final).withColumn("_had", n)
        quarter = F.explode(F.array(*[F.lit(q) for q in range(4)]))
        cut = large.withColumn("_q", quarter).withColumns({
            "_level": F.lit(level), "_i": F.col("_i") * 2 + F.col("_q").bitwiseAND(1), "_j": F.col("_j") * 2 + F.shiftright("_q", 1)})
        open_ = materialize(cut.select(area, "_x0", "_y0", "_side", "_level", "_i", "_j", _that_can_be_nearest(level).alias("_near"), "_had"))
        leaves = leaves.unionByName(open_ if level == MOST_CUTS else open_.where(final))
        if level == MOST_CUTS or open_.where(~final).isEmpty():
            break
    return leaves.drop("_had")


def _that_can_be_nearest(level: int):
    step = F.col("_side") / float(2 ** level)
    slack = step * 1e-6  # rounding: a cell is taken a little larger than it is
    low_x, low_y = F.col("_x0") + F.col("_i") * step - slack, F.col("_y0") + F.col("_j") * step - slack
    high_x, high_y = low_x + step + 2 * slack, low_y + step + 2 * slack

    def least(c):
        dx = F.greatest(low_x - c["cx"], c["cx"] - high_x, F.lit(0.0))
        dy = F.greatest(low_y - c["cy"], c["cy"] - high_y, F.lit(0.0))
        return dx * dx + dy * dy

    def most(c):
        dx = F.greatest(F.abs(c["cx"] - low_x), F.abs(c["cx"] - high_x))
        dy = F.greatest(F.abs(c["cy"] - low_y), F.abs(c["cy"] - high_y))
        return dx * dx + dy * dy

    # Bound to a variable, so that it is computed once a cell and not once a centre.
    bound = F.array(F.array_min(F.transform("_near", most)) * (1 + 1e-9))
    return F.transform(bound, lambda b: F.filter("_near", lambda c: least(c) <= b))[0]


def nearest_of_many(points: DataFrame, centres: DataFrame, area: str = "areaid", x: str = "x", y: str = "y") -> DataFrame:
    """``nearest_centre`` for areas of thousands of centres: a point is tested against its cell's few.

    The cells (``centre_cells``) are computed once; a point looks its leaf up
    by one key per level, broadcast after a check of the cells' bytes. Points
    outside an area's square, which no cell speaks for, are tested against all
    of its centres. Equal to the scan: the closest centre, ties to the lowest
    id, null for an area without centres or a point without coordinates.
    """
    px, py = F.col(x), F.col(y)
    cells = centre_cells(centres, area)
    # A value per level.
    levels = sorted(r[0] for r in cells.select("_level").distinct().collect())
    squares = cells.select(area, "_x0", "_y0", "_side").distinct()  # one row per area
    placed = points.join(bounded_broadcast(squares), area, "left")
    i, j = F.floor((px - F.col("_x0")) / F.col("_side")), F.floor((py - F.col("_y0")) / F.col("_side"))
    inside = F.coalesce((i == 0) & (j == 0) & ~F.isnan(px) & ~F.isnan(py), F.lit(False))
    step = F.col("_side") / F.pow(F.lit(2.0), F.col("_level"))
    looked = placed.where(inside).withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    looked = looked.withColumns({"_i": F.floor((px - F.col("_x0")) / step).cast("int"), "_j": F.floor((py - F.col("_y0")) / step).cast("int")})

    def dist(c):
        dx, dy = px - c["cx"], py - c["cy"]
        return F.struct((dx * dx + dy * dy).alias("d"), c["clusterid"].alias("clusterid"))

    lists = bounded_broadcast(cells.select(area, "_level", "_i", "_j", "_near"), known_bytes=_list_bytes(cells))
    best = F.array_min(F.transform("_near", dist))["clusterid"].alias("clusterid")
    found = looked.join(lists, [area, "_level", "_i", "_j"]).select(*points.columns, best)
    return found.unionByName(nearest_centre(placed.where(~inside).select(*points.columns), centres, area, x, y))


def _list_bytes(cells: DataFrame) -> int:
    return cells.agg(F.sum(F.size("_near") * 40 + 128)).first()[0] or 0


#: A key with more than this share of the rows is hot: there are at most 200 of them.
HOT_SHARE = 1 / 200


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys that hold more than ``share`` of the rows: fewer than 1 / ``share``, whatever the data.

    A count per key, combined in the map tasks; null is no key.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return sorted(r[key] for r in counts.where(F.col("n") > total * share).collect())


def join_split_by_heat(left: DataFrame, right: DataFrame, left_key: str, right_key: str, hot: Sequence,
                       max_bytes: int | None = None) -> DataFrame:
    """Left outer join in which the rows of the keys ``hot`` are not dealt out by key.

    The right rows of the hot keys, few as the keys are, are broadcast after a
    check of their bytes, so the hot left rows stay where they are. Beyond the
    bound (many right rows per key) the hot left rows are dealt by key and a
    salt from their own values, and each salt gets a copy of the right rows.
    All other rows are joined as usual. The rows are the same in any case.
    """
    if not hot:
        return left.join(right, left[left_key] == right[right_key], "left")
    is_hot = F.coalesce(F.col(left_key).isin(list(hot)), F.lit(False))
    few = right.where(F.col(right_key).isin(list(hot)))
    cold = left.where(~is_hot).join(right, left[left_key] == right[right_key], "left")
    limits = {} if max_bytes is None else {"max_bytes": max_bytes}
    small = bounded_broadcast(few, **limits)
    if small is not few:
        warm = left.where(is_hot).join(small, left[left_key] == right[right_key], "left")
        return cold.unionByName(warm)
    dealt = left.where(is_hot).withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)))
    copies = few.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    warm = dealt.join(copies, (dealt[left_key] == copies[right_key]) & (F.col("_salt") == F.col("_copy")), "left")
    return cold.unionByName(warm.drop("_salt", "_copy"))


def located_with_tags(located: DataFrame, tags: DataFrame, key: str = "user_id",
                      date=None, hour=None, area=None, cluster=None,
                      date_col: str = "dt", hour_col: str = "hr", hot: Sequence = ()) -> DataFrame:
    """Located records (optionally filtered) left-joined with the tag row of their key.

    The filters apply before the join. ``hot`` (of ``hot_keys``) are keys whose
    records are kept out of the exchange; the rest of the join is left to
    AQE, which broadcasts the tag side when its materialised shuffle is under
    ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
    """
    cond = F.lit(True)
    for col, val in ((date_col, date), (hour_col, hour), ("areaid", area), ("clusterid", cluster)):
        if val is not None:
            cond = cond & (F.col(col) == val)
    return join_split_by_heat(located.where(cond), tags.withColumnRenamed(key, f"tag_{key}"), key, f"tag_{key}", hot)
