"""Nearest-site and exclusion joins on a spatial (and time) grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustfront.constants import EXCLUDE_KM, EXCLUDE_MIN, MAX_RANGE_KM
from gustfront.functions.geo import haversine_km, lat_cell, lat_cells_within, lon_cell, lon_cells_within
from gustfront.session import deal_out, materialise

SITE_CELL = 1.5
#: A cell with more candidate sites than this is cut into four, down to ``DEEPEST`` halvings (about 10 m).
CROWDED = 8
DEEPEST = 14


def _site_cells(stations: DataFrame, max_km: float) -> DataFrame:
    """Each place that holds a site (smallest id) repeated for every grid cell its range disc touches."""
    places = stations.groupBy(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")).agg(F.min("station").alias("station"))
    return (
        places.withColumn("cell_y", F.explode(lat_cells_within(F.col("s_lat"), max_km, SITE_CELL)))
        .withColumn("cell_x", F.explode(lon_cells_within(F.col("s_lat"), F.col("s_lon"), max_km, SITE_CELL)))
    )


def _quarters(rows: DataFrame) -> DataFrame:
    """Rows of cells repeated for the four quarters of each."""
    halves = lambda name: F.explode(F.array(F.col(name) * 2, F.col(name) * 2 + 1))
    return deal_out(rows).withColumn("cell_y", halves("cell_y")).withColumn("cell_x", halves("cell_x"))


def _possible(rows: DataFrame, level: int, max_km: float) -> DataFrame:
    """The sites of each cell that can be nearest somewhere inside it.

    With ``d`` the distance from a cell's centre and ``r`` the farthest point of the cell, a site farther than the
    least ``d`` plus ``2 r`` loses everywhere in the cell to the site of that least ``d``.
    """
    size = SITE_CELL / 2**level
    y, x = (F.col("cell_y") + 0.5) * size, (F.col("cell_x") + 0.5) * size
    corner = lambda n: haversine_km(y, x, (F.col("cell_y") + n) * size, F.col("cell_x") * size)
    cells = rows.withColumn("d", haversine_km(y, x, F.col("s_lat"), F.col("s_lon")))
    least = cells.groupBy("cell_y", "cell_x").agg(F.min("d").alias("least")).withColumn("r", F.greatest(corner(0), corner(1)) + 1e-6)
    reach = F.least(F.col("least") + F.col("r"), F.lit(float(max_km))) + F.col("r")
    return cells.join(least, ["cell_y", "cell_x"]).where(F.col("d") <= reach).select(*rows.columns)


def _site_tree(stations: DataFrame, max_km: float) -> tuple[DataFrame, int, bool]:
    """Candidate sites of the cells of a quadtree as rows (``level``, ``cell_y``, ``cell_x``, site), its depth, and whether a
    cell of the last level is still crowded. Only crowded cells are cut, so the rows grow with the sites, not with their density."""
    rows, leaves = materialise(_possible(_site_cells(stations, max_km), 0, max_km), "site-cells"), []
    for level in range(DEEPEST + 1):
        at_level = rows.withColumn("level", F.lit(level))
        crowded = rows.groupBy("cell_y", "cell_x").count().where(F.col("count") > CROWDED).drop("count")
        more = not crowded.isEmpty()
        if not more or level == DEEPEST:
            break
        leaves.append(at_level.join(crowded, ["cell_y", "cell_x"], "left_anti"))
        rows = materialise(_possible(_quarters(rows.join(crowded, ["cell_y", "cell_x"], "left_semi")), level + 1, max_km), "site-cells")
    if not leaves:
        return at_level, level, more
    for part in leaves:
        at_level = at_level.unionByName(part)
    return materialise(at_level, "site-tree"), level, more


def _in_tree(events: DataFrame, tree: DataFrame, depth: int) -> DataFrame:
    """``level``, ``cell_y`` and ``cell_x`` added to events, one row for each level that the tree has in the event's coarse cell."""
    placed = events.withColumn("cell_y", lat_cell(F.col("lat"), SITE_CELL)).withColumn("cell_x", lon_cell(F.col("lon"), SITE_CELL))
    if depth == 0:
        return placed.withColumn("level", F.lit(0))
    coarse = [F.expr(f"shiftright({name}, level)").alias(name) for name in ("cell_y", "cell_x")]
    # at most one row for each coarse cell of the globe
    levels = materialise(tree.select("level", *coarse).distinct().groupBy("cell_y", "cell_x").agg(F.collect_list("level").alias("levels")), "site-levels")
    spread = placed.join(levels, ["cell_y", "cell_x"]).withColumn("level", F.explode("levels")).drop("levels")
    cut = lambda name: F.floor(F.col(name) / (F.lit(SITE_CELL) / F.expr("shiftleft(1, level)"))).cast("long")
    around = F.expr(f"shiftleft({round(360 / SITE_CELL)}L, level)")
    return spread.withColumn("cell_y", cut("lat")).withColumn("cell_x", F.pmod(cut("lon"), around))


def nearest_station(
    events: DataFrame, stations: DataFrame, max_km: float = MAX_RANGE_KM, key: str = "report_id", row_by_row: bool = False
) -> DataFrame:
    """Add ``station`` and ``dist_km`` of the closest site; events out of range are dropped.

    Sites become candidate arrays of the cells of a quadtree, which is cut where many sites can be nearest and keeps in a
    cell only those that can, so an event meets a bounded number of sites however dense they lie. The join carries no
    hint: the engine broadcasts the table while its statistics say it is small, and otherwise shuffles both sides and splits
    hot cells. ``row_by_row`` joins single sites instead and reduces per event; so do sites that lie too close together
    to be told apart by cells. Ties go to the smaller site id.
    """
    tree, depth, crowded = _site_tree(stations, max_km)
    located, cell = deal_out(events), ["level", "cell_y", "cell_x"]
    if not (row_by_row or crowded):
        site = F.struct("station", "s_lat", "s_lon")
        table = tree.groupBy(*cell).agg(F.collect_list(site).alias("sites"))
        placed = _in_tree(located, tree, depth).join(table, cell)
        away = lambda s: F.struct(haversine_km(F.col("lat"), F.col("lon"), s["s_lat"], s["s_lon"]).alias("d"), s["station"].alias("station"))
        # a generator, since the engine would repeat a plain column for each of its uses
        found = placed.withColumn("_best", F.explode(F.array(F.array_min(F.transform("sites", away)))))
        kept = found.select(*events.columns, F.col("_best.station").alias("station"), F.col("_best.d").alias("dist_km"))
        return kept.where(F.col("dist_km") <= max_km)
    near = _in_tree(located.select(key, "lat", "lon"), tree, depth).join(tree, cell)
    near = near.withColumn("d", haversine_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))).where(F.col("d") <= max_km)
    best = near.groupBy(key).agg(F.min(F.struct("d", "station")).alias("best"))
    best = best.select(key, F.col("best.station").alias("station"), F.col("best.d").alias("dist_km"))
    return events.join(best, key)


def exclude_near(
    warnings: DataFrame, confirmed: DataFrame, within_km: float = EXCLUDE_KM, within_min: int = EXCLUDE_MIN, cell: float = 1.0
) -> DataFrame:
    """Warnings with no confirmed event inside both bounds (bounds included).

    Confirmed events are the small side: they are deduplicated, then repeated for the space and
    time cells they can reach, so each warning keeps one row and one equality key.
    """
    span = within_min * 60
    slot = 2 * span
    seconds = lambda c: F.unix_micros(c) / F.lit(1e6)
    reach = (
        confirmed.select(F.col("event_ts").alias("c_ts"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
        .distinct()
        .withColumn("t", seconds(F.col("c_ts")))
        .withColumn(
            "slot",
            F.explode(F.sequence(F.floor((F.col("t") - span) / slot).cast("long"), F.floor((F.col("t") + span) / slot).cast("long"))),
        )
        .withColumn("cell_y", F.explode(lat_cells_within(F.col("c_lat"), within_km, cell)))
        .withColumn("cell_x", F.explode(lon_cells_within(F.col("c_lat"), F.col("c_lon"), within_km, cell)))
        .drop("t")
    )
    keyed = (
        warnings.withColumn("slot", F.floor(seconds(F.col("event_ts")) / slot).cast("long"))
        .withColumn("cell_y", lat_cell(F.col("lat"), cell))
        .withColumn("cell_x", lon_cell(F.col("lon"), cell))
    )
    w, c = keyed.alias("w"), reach.alias("c")
    same_cell = (F.col("w.slot") == F.col("c.slot")) & (F.col("w.cell_y") == F.col("c.cell_y")) & (F.col("w.cell_x") == F.col("c.cell_x"))
    close = (F.abs(F.unix_micros("w.event_ts") - F.unix_micros("c.c_ts")) <= span * 1_000_000) & (
        haversine_km(F.col("w.lat"), F.col("w.lon"), F.col("c.c_lat"), F.col("c.c_lon")) <= within_km
    )
    return w.join(c, same_cell & close, "left_anti").drop("slot", "cell_y", "cell_x")
