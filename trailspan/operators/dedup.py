"""Merging of near-duplicate places, exactly as a walk in input order would.

In input order, a place that is within the radius of an earlier kept place of its
category (its leader) is absorbed by the first such leader. The kept row of a
leader's group is the one with most tags, the earliest on a tie.

So leaders are the first maximal independent set, in input order, of the graph that joins
places within the radius. It is found in rounds of DataFrame operations on that graph:

* Copies of one coordinate behave alike and are folded into one spot first, on the map side.
* Where spots are crowded, the first spot of each small cell is compared with those of the cells in reach alone;
  those that come before all of them are leaders and absorb what is around them. That goes on until no small
  cell holds more than ``CROWD`` open spots, so the graph that is written has few edges for each spot.
* A round makes every spot without an open earlier neighbour a leader, and takes its neighbours out.
* Along a chain that would be one leader a round. But if all open earlier neighbours of w are also neighbours of an
  earlier v, and w is not, then w is a leader if v is. Such pointers from w to v are doubled, so that a round reaches
  the whole chain after a number of steps that grows with the logarithm of its length.

No spot is decided in Python, and nothing is held but tables that Spark wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import geo
from ..scratch import scratch, written

#: Open spots of a small cell from which first spots decide alone; moves work, changes no answer.
CROWD = 16
#: Plain rounds before pointers are doubled, and the earlier neighbours a spot with a pointer has at most.
PLAIN_ROUNDS = 4
FEW = 8
_KEY = ["run_id", "category"]
_SPOT = [*_KEY, "ord", "lat", "lon", "radius"]


def adaptive_radius(count: Column, base_m: float) -> Column:
    """Radius from the number of places in the corridor."""
    # Corridor sizes and the least radius from there on.
    floor = F.when(count >= 1200, 120.0).when(count >= 700, 80.0).when(count >= 300, 60.0).otherwise(0.0)
    return F.greatest(F.lit(float(base_m)), floor)


def run_radius(pois: DataFrame, base_m: float = 50.0) -> DataFrame:
    """One row per run: its number of places and its radius."""
    return (
        pois.groupBy("run_id").agg(F.count("*").alias("n_pois"))
        .withColumn("radius", adaptive_radius(F.col("n_pois"), base_m))
    )


def _side(share: float = 1.0) -> Column:
    """Cell size in degrees: a share of the run's radius."""
    return F.col("radius") * F.lit(share / geo.METRES_PER_DEGREE)


def _home(size: Column) -> Column:
    return geo.cell_of(F.col("lat"), F.col("lon"), size)


def _reach(size: Column) -> Column:
    """Cells of the grid that a spot's radius touches."""
    pad_lat = geo.lat_margin(F.col("radius"))
    pad_lon = geo.lon_margin(F.col("radius"), F.abs("lat"))
    return geo.cells_in_box(
        F.col("lat") - pad_lat, F.col("lat") + pad_lat, F.col("lon") - pad_lon, F.col("lon") + pad_lon, size
    )


def _around(spots: DataFrame, others: DataFrame) -> DataFrame:
    """Spots with the other spots (``o_ord``) of their run and category within the radius."""
    reached = others.select(
        *_KEY, F.col("ord").alias("o_ord"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"),
        F.explode(_reach(_side())).alias("cell"),
    )
    return (
        spots.withColumn("cell", _home(_side())).join(reached, [*_KEY, "cell"]).drop("cell")
        .filter(geo.haversine(F.col("o_lat"), F.col("o_lon"), F.col("lat"), F.col("lon")) <= F.col("radius"))
    )


def _certain_leaders(open_spots: DataFrame) -> DataFrame:
    """Spots that come first in their small cell and in all cells in reach.

    Only one spot per cell takes part, so crowding does not matter.
    """
    small = _side(0.5)
    first = F.min_by(F.struct("ord", "lat", "lon", "radius"), "ord").alias("s")
    heads = open_spots.withColumn("cell", _home(small)).groupBy(*_KEY, "cell").agg(first).select(*_KEY, "cell", "s.*")
    reached = heads.select(*_KEY, "ord", F.explode(_reach(small)).alias("cell"))
    rivals = heads.select(*_KEY, "cell", F.col("ord").alias("r_ord"))
    beaten = reached.join(rivals, [*_KEY, "cell"]).filter(F.col("r_ord") < F.col("ord")).select(*_KEY, "ord").distinct()
    return heads.drop("cell").join(beaten, [*_KEY, "ord"], "left_anti").select(*_SPOT)


def _fullest(spots: DataFrame) -> int:
    return spots.groupBy(*_KEY, _home(_side(0.5)).alias("cell")).count().agg(F.max("count")).first()[0] or 0


def _sources(edges: DataFrame) -> DataFrame:
    """Spots with later neighbours and no open earlier one."""
    return edges.select("run_id", "u").distinct().join(edges.select("run_id", F.col("v").alias("u")), ["run_id", "u"], "left_anti")


def _reached(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources and all spots that are leaders because of them, by doubled pointers."""
    few = edges.join(edges.groupBy("run_id", "v").agg(F.count("*").alias("n")).where(F.col("n") <= FEW), ["run_id", "v"])
    before = edges.select("run_id", F.col("v").alias("u"), F.col("u").alias("p"))
    # p is a neighbour of all n open earlier neighbours of v, and before them.
    common = few.join(before, ["run_id", "u"]).groupBy("run_id", "v", "n", "p").agg(F.count("*").alias("c")).where("c = n")
    apart = common.join(edges.select("run_id", F.col("u").alias("p"), "v"), ["run_id", "p", "v"], "left_anti")
    pointer = written(apart.groupBy("run_id", "v").agg(F.max("p").alias("p")), "dedup-pointers")
    known = sources
    while not pointer.isEmpty():
        led = pointer.join(known.select("run_id", F.col("u").alias("p")), ["run_id", "p"], "left_semi").select("run_id", F.col("v").alias("u"))
        known = written(known.unionByName(led).distinct(), "dedup-known")
        ahead = pointer.select("run_id", F.col("v").alias("p"), F.col("p").alias("far"))
        pointer = written(pointer.join(ahead, ["run_id", "p"]).select("run_id", "v", F.col("far").alias("p")), "dedup-pointers")
    return known


def absorbed_spots(edges: DataFrame) -> tuple[list[DataFrame], int]:
    """Written tables of absorbed spots (``run_id, v``) and the number of rounds.

    ``edges``: a written table of ``run_id, u, v``, u before v and within the radius.
    """
    taken, rounds = [], 0
    while not edges.isEmpty():
        leaders = _sources(edges)
        if rounds >= PLAIN_ROUNDS:
            leaders = _reached(edges, written(leaders, "dedup-known"))
        gone = written(edges.join(leaders, ["run_id", "u"], "left_semi").select("run_id", "v").distinct(), "dedup-absorbed")
        taken.append(gone)
        left = edges.join(gone, ["run_id", "v"], "left_anti").join(gone.select("run_id", F.col("v").alias("u")), ["run_id", "u"], "left_anti")
        edges = written(left, "dedup-edges")
        rounds += 1
    return taken, rounds


def neighbours(spots: DataFrame) -> DataFrame:
    """Edges between spots within the radius: ``run_id, u, v`` with u before v."""
    return _around(spots, spots).filter("o_ord < ord").select("run_id", F.col("o_ord").alias("u"), F.col("ord").alias("v"))


def find_leaders(spots: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Leaders among spots (``run_id, category, ord, lat, lon, radius``; ``ord`` is unique in a run), as a written table."""
    with scratch(spots.sparkSession, ("dedup-leaders",)):
        open_spots, certain = written(spots.select(*_SPOT), "dedup-open"), []
        while _fullest(open_spots) > crowd:
            certain.append(written(_certain_leaders(open_spots), "dedup-certain"))
            rest = open_spots.join(certain[-1].select(*_KEY, "ord"), [*_KEY, "ord"], "left_anti")
            taken = _around(rest, certain[-1]).filter("o_ord < ord").select(*_KEY, "ord").distinct()
            open_spots = written(rest.join(taken, [*_KEY, "ord"], "left_anti"), "dedup-open")
        leaders = open_spots
        for gone in absorbed_spots(written(neighbours(open_spots), "dedup-edges"))[0]:
            leaders = leaders.join(gone.withColumnRenamed("v", "ord"), ["run_id", "ord"], "left_anti")
        leaders = leaders.select(*_SPOT)
        for more in certain:
            leaders = leaders.unionByName(more)
        return written(leaders, "dedup-leaders")


def assign_leaders(spots: DataFrame, leaders: DataFrame) -> DataFrame:
    """Earliest leader within the radius for each spot, as ``leader_ord``."""
    rest = [c for c in spots.columns if c not in (*_KEY, "ord")]
    return _around(spots, leaders).filter("o_ord <= ord").groupBy(*_KEY, "ord", *rest).agg(F.min("o_ord").alias("leader_ord"))


def dedup_pois(pois: DataFrame, radius_m: float = 50.0, crowd: int = CROWD) -> DataFrame:
    """Merge near-duplicates. Needs ``ord`` (input order); ``run_id`` is optional.

    Adds ``n_merged``, the number of input rows a kept row stands for.
    """
    if "run_id" not in pois.columns:
        return dedup_pois(pois.withColumn("run_id", F.lit("run")), radius_m, crowd).drop("run_id")
    # Read by the counts, the rounds and the final join: computed once.
    pois = written(pois, "dedup-places")
    mergeable = ~F.col("category").isin(*rules.NEVER_MERGED)
    sized = pois.select("run_id", "category", "ord", "poi_id", "lat", "lon", F.size("tags").alias("n_tags")).join(
        run_radius(pois, radius_m).select("run_id", "radius"), "run_id"
    )
    # Most tags first, then the earliest: the largest of these triples.
    best = F.max(F.struct("n_tags", (-F.col("ord")).alias("neg_ord"), "poi_id")).alias("best")
    spots = written(
        sized.filter(mergeable & (F.col("radius") > 0)).groupBy(*_KEY, "lat", "lon", "radius")
        .agg(F.min("ord").alias("ord"), best, F.count("*").alias("n")), "dedup-spots"
    )
    leaders = find_leaders(spots, crowd)
    grouped = assign_leaders(spots, leaders).groupBy(*_KEY, "leader_ord").agg(
        F.max("best").alias("best"), F.sum("n").alias("n_merged")
    )
    alone = sized.filter(~mergeable | (F.col("radius") <= 0)).select("run_id", "poi_id", F.lit(1).cast("long").alias("n_merged"))
    kept = grouped.select("run_id", F.col("best.poi_id").alias("poi_id"), "n_merged").unionByName(alone)
    return pois.join(kept, ["run_id", "poi_id"])
