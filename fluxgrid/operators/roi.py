"""Regions of interest, tables (roi_set, roi_id, y, x) of the pixels inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def add(rois: DataFrame, more: DataFrame) -> DataFrame:
    """Both sets, the added regions numbered on."""
    top = rois.agg(F.coalesce(F.max("roi_id"), F.lit(-1)).alias("top"))
    low = more.agg(F.min("roi_id").alias("low"))
    moved = more.join(top, F.lit(True)).join(low, F.lit(True)).withColumn("roi_id", F.col("roi_id") - F.col("low") + F.col("top") + 1).drop("top", "low")
    return rois.unionByName(moved)


def remove(rois: DataFrame, ids: list[int]) -> DataFrame:
    """Regions without the given ones, numbered anew; one row a region is ranked, not the pixels."""
    kept = rois.where(~F.col("roi_id").isin(ids))
    new = kept.select("roi_id").distinct().withColumn("new", F.row_number().over(Window.orderBy("roi_id")) - 1)
    return kept.join(new, "roi_id").withColumn("roi_id", F.col("new")).drop("new")


def subset(rois: DataFrame, keep: DataFrame, new_set: int) -> DataFrame:
    """The regions that keep (roi_id) names, as a new version."""
    return rois.join(keep, "roi_id", "left_semi").withColumn("roi_set", F.lit(new_set))


def latest(rois: DataFrame) -> DataFrame:
    """The rows of the highest version."""
    top = rois.agg(F.max("roi_set").alias("roi_set"))
    return rois.join(top, "roi_set")


def next_version(rois: DataFrame) -> DataFrame:
    return rois.agg((F.coalesce(F.max("roi_set"), F.lit(-1)) + 1).alias("roi_set"))


def areas(rois: DataFrame) -> DataFrame:
    return rois.groupBy("roi_id").agg(F.count("*").alias("area"))


def centroids(rois: DataFrame) -> DataFrame:
    return rois.groupBy("roi_id").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))


def bounding_box(rois: DataFrame, pad: int, h: int, w: int) -> DataFrame:
    """(roi_id, y0, y1, x0, x1): extent with a margin, within the image; ends exclusive."""
    return rois.groupBy("roi_id").agg(
        F.greatest(F.lit(0), F.min("y") - pad).alias("y0"), F.least(F.lit(h), F.max("y") + pad + 1).alias("y1"),
        F.greatest(F.lit(0), F.min("x") - pad).alias("x0"), F.least(F.lit(w), F.max("x") + pad + 1).alias("x1"),
    )


def border(rois: DataFrame) -> DataFrame:
    """Pixels of which one of the 8 neighbours is outside the region."""
    near = rois.select("roi_set", "roi_id", F.explode(F.sequence(F.col("y") - 1, F.col("y") + 1)).alias("y"), "x")
    near = near.select("roi_set", "roi_id", "y", F.explode(F.sequence(F.col("x") - 1, F.col("x") + 1)).alias("x"))
    inside = near.groupBy("roi_set", "roi_id", "y", "x").agg(F.count("*").alias("n")).where("n < 9")
    return rois.join(inside.drop("n"), ["roi_set", "roi_id", "y", "x"])


def polygon(points: DataFrame) -> DataFrame:
    """(roi_id, y, x) of pixels whose centre lies in or on a convex polygon, from its corners (roi_id, k, x, y) in order."""
    w = Window.partitionBy("roi_id").orderBy("k")
    first = points.groupBy("roi_id").agg(F.min_by(F.struct("x", "y"), "k").alias("head"))
    edge = points.join(first, "roi_id").withColumn("to", F.coalesce(F.lead(F.struct("x", "y")).over(w), F.col("head")))
    box = points.groupBy("roi_id").agg(F.ceil(F.min("y")).cast("int").alias("y0"), F.floor(F.max("y")).cast("int").alias("y1"), F.ceil(F.min("x")).cast("int").alias("x0"), F.floor(F.max("x")).cast("int").alias("x1"))
    grid = box.where("y1 >= y0 and x1 >= x0").select("roi_id", F.explode(F.sequence("y0", "y1")).alias("gy"), "x0", "x1").select("roi_id", "gy", F.explode(F.sequence("x0", "x1")).alias("gx"))
    cross = (F.col("to.x") - F.col("x")) * (F.col("gy") - F.col("y")) - (F.col("to.y") - F.col("y")) * (F.col("gx") - F.col("x"))
    sides = grid.join(edge, "roi_id").groupBy("roi_id", "gy", "gx").agg(F.min(cross).alias("lo"), F.max(cross).alias("hi"))
    return sides.where("lo >= 0 or hi <= 0").select("roi_id", F.col("gy").alias("y"), F.col("gx").alias("x"))


def pare(rois: DataFrame, y0: float, y1: float, x0: float, x1: float, least: float) -> DataFrame:
    """Regions cut to the borders, those of more than `least` pixels."""
    inside = rois.where((F.col("y") >= F.floor(F.lit(y0))) & (F.col("y") < F.ceil(F.lit(y1))) & (F.col("x") >= F.floor(F.lit(x0))) & (F.col("x") < F.ceil(F.lit(x1))))
    return inside.join(areas(inside).where(F.col("area") > least).select("roi_id"), "roi_id", "left_semi")


def overlaps(rois: DataFrame) -> DataFrame:
    """(a, b, frac): share of b's pixels that lie in a, for regions that touch: an equi-join on pixels."""
    p = rois.select("roi_id", "y", "x")
    both = p.select(F.col("roi_id").alias("a"), "y", "x").join(p.select(F.col("roi_id").alias("b"), "y", "x"), ["y", "x"]).where("a <> b")
    return both.groupBy("a", "b").agg(F.count("*").alias("n")).join(areas(rois).select(F.col("roi_id").alias("b"), "area"), "b").select("a", "b", (F.col("n") / F.col("area")).alias("frac"))


def distances(rois: DataFrame, limit: float) -> DataFrame:
    """(a, b, dist) of region pairs a < b with pixels nearer than limit.

    Border pixels meet by cells of the limit's size and their neighbours, not all with all.
    """
    cell = max(1, int(limit))
    edge = border(rois).select("roi_id", "y", "x").unionByName(rois.select("roi_id", "y", "x")).distinct()
    at = edge.withColumn("cy", F.floor(F.col("y") / cell)).withColumn("cx", F.floor(F.col("x") / cell))
    near = at.select(F.col("roi_id").alias("b"), F.col("y").alias("y2"), F.col("x").alias("x2"), F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)).alias("cy"), "cx")
    near = near.select("b", "y2", "x2", "cy", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("cx"))
    d2 = F.pow(F.col("y") - F.col("y2"), 2) + F.pow(F.col("x") - F.col("x2"), 2)
    pairs = at.join(near, ["cy", "cx"]).where("roi_id < b").groupBy(F.col("roi_id").alias("a"), "b").agg(F.sqrt(F.min(d2)).alias("dist"))
    return pairs.where(F.col("dist") < limit)


def remove_overlaps(rois: DataFrame, groups: DataFrame, limit: float = 0.5) -> DataFrame:
    """Regions without those of which more than `limit` lies in another one of their group (roi_id, comp); a group that would vanish keeps its largest."""
    o = overlaps(rois).join(groups.select(F.col("roi_id").alias("a"), F.col("comp").alias("ca")), "a").join(groups.select(F.col("roi_id").alias("b"), F.col("comp").alias("cb")), "b").where("ca = cb")
    bad = o.groupBy(F.col("b").alias("roi_id")).agg(F.max("frac").alias("f")).where(F.col("f") > limit).select("roi_id", F.lit(1).alias("bad"))
    g = groups.join(areas(rois), "roi_id").join(bad, "roi_id", "left")
    whole = g.groupBy("comp").agg(F.min(F.coalesce("bad", F.lit(0))).alias("all_bad"), F.max_by("roi_id", F.struct("area", -F.col("roi_id"))).alias("top"))
    drop = g.join(whole, "comp").where("bad = 1 and not (all_bad = 1 and roi_id = top)").select("roi_id")
    return rois.join(drop, "roi_id", "left_anti")


def merge_close(rois: DataFrame, groups: DataFrame, limit: float = 20.0) -> DataFrame:
    """Regions of one group (roi_id, comp) nearer than limit become one; merged regions come after the others, numbered anew."""
    from fluxgrid.operators.graph import components

    d = distances(rois, limit).join(groups.select(F.col("roi_id").alias("a"), F.col("comp").alias("ca")), "a").join(groups.select(F.col("roi_id").alias("b"), F.col("comp").alias("cb")), "b").where("ca = cb")
    root = components(d.select("a", "b"))
    named = rois.join(root.withColumnRenamed("node", "roi_id"), "roi_id", "left")
    named = named.withColumn("merged", F.col("root").isNotNull()).withColumn("key", F.coalesce("root", "roi_id"))
    order = named.select("merged", "key").distinct().withColumn("new", F.row_number().over(Window.orderBy("merged", "key")) - 1)
    return named.join(order, ["merged", "key"]).select("roi_set", F.col("new").alias("roi_id"), "y", "x").distinct()


def process(rois: DataFrame, traces: DataFrame, overlap: float = 0.5, similarity: tuple[float, float] = (0.5, 0.8), distance: float = 20.0) -> DataFrame:
    """Regions cleaned in two steps: of groups of traces that correlate above the first similarity those that overlap go, then of groups above the second one near ones merge.

    traces: (roi, i, v) of the regions. Regions similar to none stay as they are. Traces of merged regions are not computed anew.
    """
    from fluxgrid.operators.correlate import neighbourhoods

    kept = remove_overlaps(rois, neighbourhoods(traces, similarity[0]), overlap)
    return merge_close(kept, neighbourhoods(traces.join(kept.select(F.col("roi_id").alias("roi")).distinct(), "roi", "left_semi"), similarity[1]), distance)


def process_scaled(rois: DataFrame, traces: DataFrame, per_micron: float, borders: tuple[float, float, float, float], least_area: float, distance: float = 10.0, **limits) -> DataFrame:
    """`process` with lengths in micrometres: regions are first cut to the borders (y0, y1, x0, x1) and need least_area square micrometres."""
    inside = pare(rois, *borders, least_area * per_micron**2)
    mine = traces.join(inside.select(F.col("roi_id").alias("roi")).distinct(), "roi", "left_semi")
    return process(inside, mine, distance=distance * per_micron, **limits)
