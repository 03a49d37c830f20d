"""Registered queries of the imaging operators, each over a whole table, with the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.operators import correlate, graph, index, movie, roi, traces
from fluxgrid.operators import windows as W
from fluxgrid.plans import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None, *ctes: str) -> Callable[[Query], Query]:
    """Registers a query and its SQL; ctes name the views (of fixtures.SQL) that the SQL reads, as alias=view."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            parts = ", ".join(f"{a} AS ({X.SQL[v]})" for a, _, v in (c.partition("=") for c in ctes))
            ORACLE[name] = (f"WITH {parts} " if parts else "") + sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), digits) + F.lit(0.0))
    return df


def _dff_sql(w: int, k: int, root: bool = False, source: str = "s") -> str:
    left, h = w - 1, k // 2
    under = "sqrt(f0)" if root else "f0"
    med = f"SELECT roi, i, quantile_cont(v, 0.5) OVER (PARTITION BY roi ORDER BY i ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS v FROM pp" if k > 1 else "SELECT * FROM p"
    return f""", c AS (SELECT roi, max(i) + 1 AS c FROM {source} GROUP BY roi),
p AS (SELECT roi, i, v FROM {source} UNION ALL SELECT roi, -i, v FROM {source} WHERE i BETWEEN 1 AND {left}),
pp AS (SELECT * FROM p UNION ALL SELECT roi, {-2 * left - 1} - i, v FROM p WHERE i BETWEEN {-left} AND {-left + h - 1}
  UNION ALL SELECT p.roi, 2 * c - 1 - i, v FROM p JOIN c USING (roi) WHERE i BETWEEN c - {h} AND c - 1),
m AS ({med}), m2 AS (SELECT m.* FROM m JOIN c USING (roi) WHERE i >= {-left} AND i < c),
g AS (SELECT roi, i, min(v) OVER (PARTITION BY roi ORDER BY i ROWS BETWEEN {left} PRECEDING AND CURRENT ROW) AS f0 FROM m2)
SELECT s.roi, s.i, round(g.f0, 6) + 0.0 AS f0, round((s.v - f0) / nullif({under}, 0), 6) + 0.0 AS dff FROM {source} s JOIN g USING (roi, i)"""


def _with(sql: str) -> str:
    return sql.lstrip(", ") if sql.startswith(",") else sql


def dff(name: str, w: int, k: int | None, root: bool, view: str, trace: Query) -> None:
    sql = f"WITH s AS ({X.SQL[view]})" + _dff_sql(w, k or 1, root)
    QUERIES[name] = lambda spark, sf: rounded(traces.compute_dff(trace(spark, sf), w, k, root_f=root), "f0", "dff").select("roi", "i", "f0", "dff")
    ORACLE[name] = sql


dff("dff_min", 20, None, False, "trace_events", X.trace_events)
dff("dff_median", 20, 5, False, "trace_events", X.trace_events)
dff("dff_root", 20, 5, True, "trace_events", X.trace_events)
dff("dff_long_traces", 50, 5, False, "trace_lineitem", X.trace_lineitem)


@query("dff_step", "SELECT * FROM (WITH s AS (" + X.SQL["trace_events"] + ")" + _dff_sql(20, 1).replace("SELECT s.roi, s.i, round(g.f0, 6)", "SELECT s.roi, s.i, round(g.f0, 6)").replace("JOIN g USING (roi, i)", "JOIN g ON g.roi = s.roi AND g.i = s.i - s.i % 4") + ")")
def _(spark, sf):
    return rounded(traces.compute_dff(X.trace_events(spark, sf), 20, None, step=4), "f0", "dff").select("roi", "i", "f0", "dff")


@query("dff_pct8", "SELECT roi, i, round(f0, 6) + 0.0 AS f0, round((v - f0) / nullif(f0, 0), 6) + 0.0 AS dff FROM (SELECT roi, i, v, quantile_cont(v, 0.08) OVER (PARTITION BY roi ORDER BY i ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS f0 FROM p) WHERE i >= 0", "s=trace_events")
def _(spark, sf):
    return rounded(traces.percentile_dff(X.trace_events(spark, sf), 30), "f0", "dff").select("roi", "i", "f0", "dff")


ORACLE["dff_pct8"] = ORACLE["dff_pct8"].replace(") SELECT roi", "), p AS (SELECT * FROM s UNION ALL SELECT roi, -k, v FROM s, range(1, 30) r(k) WHERE i = 0) SELECT roi", 1)


@query("dff_legacy_window", """, m AS (SELECT *, avg(v) OVER (PARTITION BY roi ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM s),
f AS (SELECT roi, i, v, CASE WHEN i < 19 THEN (SELECT min(m) FROM m q WHERE q.roi = m.roi AND q.i < 20) ELSE min(m) OVER (PARTITION BY roi ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS f0 FROM m)
SELECT roi, i, round(f0, 6) + 0.0 AS f0, round(coalesce((v - f0) / nullif(f0, 0), v), 6) + 0.0 AS dff FROM f""", "s=trace_events")
def _(spark, sf):
    return rounded(traces.window_dff(X.trace_events(spark, sf), 5, 20), "f0", "dff").select("roi", "i", "f0", "dff")


@query("dff_legacy_smoothed", """, m AS (SELECT *, avg(v) OVER (PARTITION BY roi ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM s),
f AS (SELECT roi, i, v, CASE WHEN i < 19 THEN (SELECT min(m) FROM m q WHERE q.roi = m.roi AND q.i < 20) ELSE min(m) OVER (PARTITION BY roi ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS f0 FROM m),
d AS (SELECT roi, i, coalesce((v - f0) / nullif(f0, 0), v) AS x FROM f)
SELECT a.roi, a.i, round(sum(b.x * exp(-k / 0.5)) / sum(exp(-k / 0.5)), 6) + 0.0 AS dff FROM d a, range(8) r(k), d b WHERE b.roi = a.roi AND b.i = a.i - k GROUP BY ALL""", "s=trace_events")
def _(spark, sf):
    return rounded(traces.window_dff(X.trace_events(spark, sf), 5, 20, tao0=0.5), "dff").select("roi", "i", "dff")


@query("causal_median", "SELECT roi, i, round(CASE WHEN i < 4 THEN v ELSE quantile_cont(v, 0.5) OVER (PARTITION BY roi ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END, 6) + 0.0 AS f FROM s", "s=trace_events")
def _(spark, sf):
    return rounded(W.causal_median_filter(X.trace_events(spark, sf), 5), "f").select("roi", "i", "f")


@query("sliding_mean_center", "SELECT roi, i, round(CASE WHEN count(*) OVER w = 10 THEN avg(v) OVER w END, 6) + 0.0 AS m FROM s WINDOW w AS (PARTITION BY roi ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)", "s=trace_events")
def _(spark, sf):
    return rounded(W.sliding(X.trace_events(spark, sf), F.avg("v"), "m", 10, pos="center"), "m").select("roi", "i", "m")


@query("sliding_max_step", "SELECT roi, i, m FROM (SELECT roi, i, CASE WHEN count(*) OVER w = 8 THEN max(v) OVER w END AS m FROM s WINDOW w AS (PARTITION BY roi ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) WHERE (i - 7) % 4 = 0", "s=trace_events")
def _(spark, sf):
    return W.sliding(X.trace_events(spark, sf), F.max("v"), "m", 8, step=4).select("roi", "i", "m")


_PAIRS = ", t AS (" + X.SQL["aligned"] + "), p AS (SELECT a.roi AS ra, b.roi AS rb, a.i, a.v AS va, b.v AS vb FROM t a JOIN t b ON a.i = b.i AND a.roi < b.roi)"


@query("rolling_corr", _PAIRS + """, r AS (SELECT i, corr(va, vb) OVER w AS r, count(*) OVER w AS k FROM p WINDOW w AS (PARTITION BY ra, rb ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING))
SELECT i, round(CASE WHEN min(k) = 10 AND count(r) = count(*) THEN avg(r) END, 6) + 0.0 AS r FROM r GROUP BY i""", "s=trace_events")
def _(spark, sf):
    return rounded(correlate.rolling_correlation(X.trace_aligned(spark, sf), 10), "r")


@query("pair_corr", _PAIRS + " SELECT ra, rb, round(corr(va, vb), 6) + 0.0 AS r FROM p GROUP BY ra, rb", "s=trace_events")
def _(spark, sf):
    return rounded(correlate.pair_correlation(X.trace_aligned(spark, sf)), "r")


@query("similarity_edges", _PAIRS + " SELECT ra AS a, rb AS b FROM p GROUP BY ra, rb HAVING corr(va, vb) > 0.0", "s=trace_events")
def _(spark, sf):
    return correlate.similar(X.trace_aligned(spark, sf), 0.0)


@query("transients", """, b AS (SELECT roi, i, v, quantile_cont(v, 0.5) OVER w AS med, stddev_samp(v) OVER w AS sd FROM s WINDOW w AS (PARTITION BY roi ORDER BY i ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
e AS (SELECT roi, i, coalesce(v > med + 2.5 * sd, false) AS ab, coalesce(v <= med, false) AS be FROM b),
m AS (SELECT *, max(CASE WHEN be THEN i END) OVER (PARTITION BY roi ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lb,
 min(CASE WHEN be THEN i END) OVER (PARTITION BY roi ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nb,
 CASE WHEN ab AND NOT coalesce(lag(ab) OVER (PARTITION BY roi ORDER BY i), false) THEN 1 ELSE 0 END AS st FROM e),
q AS (SELECT *, sum(st) OVER (PARTITION BY roi ORDER BY i) AS run FROM m)
SELECT DISTINCT roi, start, stop FROM (SELECT roi, min(lb) + 1 AS start, max(nb) AS stop FROM q WHERE ab GROUP BY roi, run) WHERE start IS NOT NULL AND stop IS NOT NULL AND stop - start BETWEEN 1 AND 20""", "s=trace_events")
def _(spark, sf):
    return traces.transients(X.trace_events(spark, sf), 30, 0.0, 2.5, (1, 20))


@query("transient_mask", "SELECT t.roi, t.i, CAST(coalesce(max(1) FILTER (WHERE e.roi IS NOT NULL), 0) AS BIGINT) AS event FROM s t LEFT JOIN ev e ON e.roi = t.roi AND t.i >= e.start AND t.i < e.stop GROUP BY ALL")
def _(spark, sf):
    t = X.trace_events(spark, sf)
    return traces.transient_mask(t, traces.transients(t, 30)).select("roi", "i", F.col("event").cast("long").alias("event"))


ORACLE["transient_mask"] = f"WITH s AS ({X.SQL['trace_events']}), ev AS ({ORACLE['transients']}) " + ORACLE["transient_mask"]


@query("resample_series", ", c AS (SELECT roi, max(i) + 1 AS c FROM s GROUP BY roi) SELECT roi, i // 4 AS i, round(avg(v), 6) + 0.0 AS v FROM s JOIN c USING (roi) WHERE i < c - c % 4 GROUP BY roi, i // 4", "s=trace_events")
def _(spark, sf):
    return rounded(traces.resample(X.trace_events(spark, sf), 4), "v")


@query("decimate", "SELECT roi, i // 5 AS i, v FROM s WHERE i % 5 = 0", "s=trace_events")
def _(spark, sf):
    return traces.decimate(X.trace_events(spark, sf), 5)


@query("normalize", "SELECT roi, i, round((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 6) + 0.0 AS v FROM s WINDOW w AS (PARTITION BY roi)", "s=trace_lineitem")
def _(spark, sf):
    return rounded(traces.normalize(X.trace_lineitem(spark, sf)), "v")


@query("normalize_range", "SELECT roi, i, round((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0) * 3 - 1, 6) + 0.0 AS v FROM s WINDOW w AS (PARTITION BY roi)", "s=trace_events")
def _(spark, sf):
    return rounded(traces.normalize(X.trace_events(spark, sf), -1.0, 2.0), "v")


@query("series_stats", 'SELECT roi, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std, round(quantile_cont(v, 0.5), 6) + 0.0 AS median, round(stddev_pop(v) / sqrt(count(*)), 6) + 0.0 AS sem FROM s GROUP BY roi', "s=trace_lineitem")
def _(spark, sf):
    return rounded(traces.stats(X.trace_lineitem(spark, sf)), "mean", "std", "median", "sem")


@query("series_arithmetic", "SELECT roi, i, round(abs(-(v * 2 + 1)) / 3, 6) + 0.0 AS v FROM s", "s=trace_events")
def _(spark, sf):
    return rounded(traces.arithmetic(X.trace_events(spark, sf), F.abs(-(F.col("v") * 2 + 1)) / 3), "v")


@query("autocov", ", d AS (SELECT roi, i, v - avg(v) OVER (PARTITION BY roi) AS d, count(*) OVER (PARTITION BY roi) AS n FROM s) SELECT a.roi, b.i - a.i AS lag, round(sum(a.d * b.d) / max(a.n), 4) + 0.0 AS acov FROM d a JOIN d b ON a.roi = b.roi AND b.i BETWEEN a.i AND a.i + 10 GROUP BY 1, 2", "s=trace_events")
def _(spark, sf):
    return rounded(traces.autocovariance(X.trace_events(spark, sf), 10), "acov", digits=4)


for _name, _agg, _sql in (
    ("mean", lambda: F.avg("v"), "avg(v)"),
    ("max", lambda: F.max("v"), "max(v)"),
    ("min", lambda: F.min("v"), "min(v)"),
    ("std", lambda: F.stddev_samp("v"), "stddev_samp(v)"),
    ("median", lambda: F.percentile("v", F.lit(0.5)), "quantile_cont(v, 0.5)"),
):
    QUERIES[f"project_{_name}"] = lambda spark, sf, a=_agg: rounded(movie.project(X.pixels(spark, sf), ["y", "x"], a()), "v").selectExpr("CAST(y AS BIGINT) AS y", "CAST(x AS BIGINT) AS x", "v")
    ORACLE[f"project_{_name}"] = f"WITH p AS ({X.SQL['pixels']}) SELECT y, x, round({_sql}, 6) + 0.0 AS v FROM p GROUP BY y, x"


@query("project_frame", "SELECT frame_idx, round(avg(v), 6) + 0.0 AS v FROM p GROUP BY frame_idx", "p=pixels")
def _(spark, sf):
    return rounded(movie.project(X.pixels(spark, sf), ["frame_idx"], F.avg("v")), "v")


@query("project_blocks", "SELECT y, x, round(avg(v), 6) + 0.0 AS v FROM p GROUP BY y, x", "p=pixels")
def _(spark, sf):
    return rounded(movie.project_blocks(X.frames(spark, sf)), "v").selectExpr("CAST(y AS BIGINT) AS y", "CAST(x AS BIGINT) AS x", "v")


@query("project_equalized", ", m AS (SELECT y, x, avg(v) AS v FROM p GROUP BY y, x) SELECT y, x, round((v - (SELECT min(v) FROM m)) / (SELECT max(v) - min(v) FROM m), 6) + 0.0 AS v FROM m", "p=pixels")
def _(spark, sf):
    return rounded(movie.min_max(movie.project(X.pixels(spark, sf), ["y", "x"], F.avg("v"))), "v").selectExpr("CAST(y AS BIGINT) AS y", "CAST(x AS BIGINT) AS x", "v")


@query("roi_extract", "SELECT roi_id AS roi, frame_idx AS i, round(avg(v), 6) + 0.0 AS v FROM p JOIN r USING (y, x) GROUP BY 1, 2", "p=pixels", "r=roi_pixels")
def _(spark, sf):
    return rounded(movie.extract(X.pixels(spark, sf), X.roi_pixels(spark)), "v").withColumn("roi", F.col("roi").cast("long"))


@query("roi_extract_minsub", "SELECT roi_id AS roi, frame_idx AS i, round(avg(v) - (SELECT min(v) FROM p), 6) + 0.0 AS v FROM p JOIN r USING (y, x) GROUP BY 1, 2", "p=pixels", "r=roi_pixels")
def _(spark, sf):
    px = X.pixels(spark, sf)
    return rounded(movie.minus_global_min(movie.extract(px, X.roi_pixels(spark)), px), "v").withColumn("roi", F.col("roi").cast("long"))


@query("resample_movie", "SELECT frame_idx // 3 AS frame_idx, y, x, round(avg(v), 6) + 0.0 AS v FROM p WHERE frame_idx < (SELECT count(*) - count(*) % 3 FROM embeddings) GROUP BY 1, 2, 3", "p=pixels")
def _(spark, sf):
    return rounded(movie.resample(X.pixels(spark, sf), 3, X.frames(spark, sf).count()), "v").selectExpr("frame_idx", "CAST(y AS BIGINT) AS y", "CAST(x AS BIGINT) AS x", "v")


_CHUNKS = ", g AS (SELECT frame_idx // 50 AS chunk, (frame_idx % 50) // 3 AS g, y, x, avg(v) AS v FROM p WHERE (frame_idx % 50) // 3 < 16 GROUP BY 1, 2, 3, 4)"


@query("chunk_frames", _CHUNKS + " SELECT chunk, chunk * 16 + g AS frame_idx, y, x, round(v - (SELECT avg(v) FROM p WHERE p.y = g.y AND p.x = g.x), 6) + 0.0 AS v FROM g", "p=pixels")
def _(spark, sf):
    return rounded(movie.chunks(X.pixels(spark, sf), 50, 3, True), "v").selectExpr("chunk", "frame_idx", "CAST(y AS BIGINT) AS y", "CAST(x AS BIGINT) AS x", "v")


@query("maxmov", _CHUNKS + " SELECT chunk, y, x, round(max(v) - avg(v), 6) + 0.0 AS v FROM g GROUP BY 1, 2, 3", "p=pixels")
def _(spark, sf):
    return rounded(movie.max_movie(X.pixels(spark, sf), 50, 3), "v").selectExpr("chunk", "CAST(y AS BIGINT) AS y", "CAST(x AS BIGINT) AS x", "v")


@query("meanmov", "SELECT frame_idx - start AS rel, y, x, round(avg(v), 6) + 0.0 AS v FROM p JOIN sl ON frame_idx >= start AND frame_idx < stop GROUP BY 1, 2, 3", "p=pixels", "sl=slices")
def _(spark, sf):
    return rounded(movie.mean_movie(X.pixels(spark, sf), X.slices(spark)), "v").selectExpr("rel", "CAST(y AS BIGINT) AS y", "CAST(x AS BIGINT) AS x", "v")


@query("example_movie", ", n AS (SELECT count(*) AS n FROM embeddings), b AS (SELECT greatest(0, k * n // 4 - 20) AS lo, (k - 1) * 40 AS o FROM n, range(1, 4) r(k)), e AS (SELECT frame_idx - lo + o AS k, y, x, v FROM p JOIN b ON frame_idx >= lo AND frame_idx < lo + 40) SELECT k // 3 AS frame_idx, y, x, round(avg(v), 6) + 0.0 AS v FROM e WHERE k < 120 GROUP BY 1, 2, 3", "p=pixels")
def _(spark, sf):
    return rounded(movie.example_movie(X.pixels(spark, sf), X.frames(spark, sf).count(), 3, 40, 3), "v").selectExpr("frame_idx", "CAST(y AS BIGINT) AS y", "CAST(x AS BIGINT) AS x", "v")


@query("tile_grid", "SELECT (y // 4) * 2 + x // 4 AS tile, round(avg(v), 6) + 0.0 AS v FROM p GROUP BY 1", "p=pixels")
def _(spark, sf):
    return rounded(movie.tile_of(X.pixels(spark, sf), 8, 8, 2, 2).groupBy(F.col("tile").cast("long").alias("tile")).agg(F.avg("v").alias("v")), "v")


@query("split_channels", "SELECT vec_id % 2 AS channel, vec_id // 2 AS frame_idx, CAST(list_sum(embedding) IS NOT NULL AS INT) AS one FROM embeddings")
def _(spark, sf):
    return index.split_channels(X.frames(spark, sf), 2).select("channel", "frame_idx", F.lit(1).alias("one"))


@query("crop_borders", ", b AS (SELECT max(x) AS x0, least(8, 8 + min(x)) AS x1, max(y) AS y0, least(8, 8 + min(y)) AS y1 FROM mo) SELECT p.frame_idx, p.y, p.x, round(v, 6) + 0.0 AS v FROM p, b WHERE p.y >= floor(y0) AND p.y < ceil(y1) AND p.x >= floor(x0) AND p.x < ceil(x1)", "p=pixels", "mo=motion")
def _(spark, sf):
    b = movie.motion_borders(X.motion(spark, sf), 8, 8).first()
    return rounded(movie.crop(X.pixels(spark, sf), b["ymin"], b["ymax"], b["xmin"], b["xmax"]), "v").selectExpr("frame_idx", "CAST(y AS BIGINT) AS y", "CAST(x AS BIGINT) AS x", "v")


@query("motion_borders", "SELECT max(x) AS xmin, CAST(least(8, 8 + min(x)) AS DOUBLE) AS xmax, max(y) AS ymin, CAST(least(8, 8 + min(y)) AS DOUBLE) AS ymax FROM mo", "mo=motion")
def _(spark, sf):
    return movie.motion_borders(X.motion(spark, sf), 8, 8)


@query("shift_frames", ", m AS (SELECT p.frame_idx, p.y + CAST(mo.y AS BIGINT) AS y, p.x + CAST(mo.x AS BIGINT) AS x, v FROM p JOIN mo USING (frame_idx)) SELECT p.frame_idx, p.y, p.x, round(coalesce(m.v, 0), 6) + 0.0 AS v FROM p LEFT JOIN m USING (frame_idx, y, x)", "p=pixels", "mo=motion")
def _(spark, sf):
    return rounded(movie.shift_integer(X.pixels(spark, sf), X.motion(spark, sf), 8, 8), "v").selectExpr("frame_idx", "CAST(y AS BIGINT) AS y", "CAST(x AS BIGINT) AS x", "v")


@query("slice_take", "SELECT slice_id, roi, i - start AS rel, v FROM s JOIN sl ON i >= start AND i < stop", "s=trace_events", "sl=slices")
def _(spark, sf):
    return index.take(X.trace_events(spark, sf), X.slices(spark)).select(F.col("slice_id").cast("long").alias("slice_id"), "roi", "rel", "v")


@query("event_align", "SELECT slice_id, r.roi, g.k AS rel, s.v FROM sl, range(20) g(k), (SELECT DISTINCT roi FROM s) r LEFT JOIN s ON s.roi = r.roi AND s.i = start + g.k", "s=trace_events", "sl=slices")
def _(spark, sf):
    return index.align(X.trace_events(spark, sf), X.slices(spark)).withColumn("slice_id", F.col("slice_id").cast("long"))


@query("event_average", "SELECT roi, i - start AS rel, round(avg(v), 6) + 0.0 AS v FROM s JOIN sl ON i >= start AND i < stop GROUP BY 1, 2", "s=trace_events", "sl=slices")
def _(spark, sf):
    return rounded(index.event_average(X.trace_events(spark, sf), X.slices(spark), ["roi"]), "v")


@query("dff_stim", ", t AS (SELECT slice_id, roi, i - start AS rel, v FROM s JOIN sl ON i >= start AND i < stop) SELECT slice_id, roi, rel, round((v - b) / nullif(b, 0), 6) + 0.0 AS dff FROM (SELECT *, avg(v) FILTER (WHERE rel < 5) OVER (PARTITION BY slice_id, roi) AS b FROM t)", "s=trace_events", "sl=slices")
def _(spark, sf):
    return rounded(index.stimulus_dff(X.trace_events(spark, sf), X.slices(spark), 5), "dff").withColumn("slice_id", F.col("slice_id").cast("long"))


@query("nearest_index", ", n AS (SELECT max(i) + 1 AS n FROM s), q AS (SELECT k * 7.5 + 0.3 AS t FROM range(40) r(k)) SELECT t, arg_min(j, abs(j * 0.5 + 1 - t) * 1000000 + j) AS i FROM q, (SELECT unnest(range(n)) AS j FROM n) GROUP BY t", "s=trace_events")
def _(spark, sf):
    q = spark.range(40).select((F.col("id") * 7.5 + 0.3).alias("t"))
    n = X.trace_events(spark, sf).agg((F.max("i") + 1).alias("n"))
    return index.nearest(n, q, 0.5, 1.0)


ORACLE["nearest_index"] = ORACLE["nearest_index"].replace("k * 7.5 + 0.3", "k * CAST(7.5 AS DOUBLE) + CAST(0.3 AS DOUBLE)").replace("j * 0.5 + 1", "j * CAST(0.5 AS DOUBLE) + 1")


@query("frame_to_file", "SELECT vec_id AS frame_idx, vec_id // 100 AS file_idx, vec_id % 100 AS local FROM embeddings")
def _(spark, sf):
    return index.frame_to_file(X.frames(spark, sf).select("frame_idx"), X.files(spark, sf)).withColumn("file_idx", F.col("file_idx").cast("long"))


@query("file_to_frame", "SELECT file_idx, 7 AS local, file_idx * 100 + 7 AS frame_idx FROM f", "f=files")
def _(spark, sf):
    local = X.files(spark, sf).select("file_idx", F.lit(7).alias("local"))
    return index.file_to_frame(local, X.files(spark, sf)).selectExpr("CAST(file_idx AS BIGINT) AS file_idx", "local", "frame_idx")


@query("i2c_enrich", "SELECT event_id, file_idx * 100 + frame_idx AS abs_frame_idx, event_id // 10 AS trial, event_id % 10 AS phase FROM e", "e=events_i2c")
def _(spark, sf):
    return index.enrich_events(X.events_i2c(spark, sf), X.files(spark, sf)).selectExpr("event_id", "abs_frame_idx", "CAST(trial AS BIGINT) AS trial", "CAST(phase AS BIGINT) AS phase")


@query("stim_pulses", """, t AS (SELECT roi, 4 * avg(v) AS thr FROM s WHERE i < 50 GROUP BY roi), h AS (SELECT s.roi, i FROM s JOIN t USING (roi) WHERE v > thr),
g AS (SELECT *, sum(CASE WHEN d IS NULL OR i - d > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY roi ORDER BY i) AS g FROM (SELECT *, lag(i) OVER (PARTITION BY roi ORDER BY i) AS d FROM h))
SELECT roi, min(i) AS start, max(i) + 1 AS stop FROM g GROUP BY roi, g""", "s=trace_events")
def _(spark, sf):
    return index.pulses(X.trace_events(spark, sf), 50, 3)


@query("pixel_trace_corr", ", t AS (SELECT roi_id AS roi, frame_idx, avg(v) AS tr FROM p JOIN r USING (y, x) GROUP BY 1, 2) SELECT roi, y, x, round(corr(v, tr), 6) + 0.0 AS r FROM p JOIN t USING (frame_idx) GROUP BY roi, y, x", "p=pixels", "r=roi_pixels")
def _(spark, sf):
    px = X.pixels(spark, sf)
    return rounded(correlate.pixel_correlation(px, movie.extract(px, X.roi_pixels(spark))), "r").selectExpr("CAST(roi AS BIGINT) AS roi", "CAST(y AS BIGINT) AS y", "CAST(x AS BIGINT) AS x", "r")


@query("roi_overlap", ", a AS (SELECT roi_id, count(*) AS n FROM r GROUP BY 1) SELECT p.roi_id AS a, q.roi_id AS b, round(count(*) / max(n), 6) + 0.0 AS frac FROM r p JOIN r q USING (y, x) JOIN a ON a.roi_id = q.roi_id WHERE p.roi_id <> q.roi_id GROUP BY 1, 2", "r=roi_pixels")
def _(spark, sf):
    return rounded(roi.overlaps(X.roi_pixels(spark)), "frac").selectExpr("CAST(a AS BIGINT) AS a", "CAST(b AS BIGINT) AS b", "frac")


@query("roi_mindist", "SELECT p.roi_id AS a, q.roi_id AS b, round(sqrt(min((p.y - q.y) ** 2 + (p.x - q.x) ** 2)), 6) + 0.0 AS dist FROM r p JOIN r q ON p.roi_id < q.roi_id GROUP BY 1, 2 HAVING dist < 20", "r=roi_pixels")
def _(spark, sf):
    return rounded(roi.distances(X.roi_pixels(spark), 20), "dist").selectExpr("CAST(a AS BIGINT) AS a", "CAST(b AS BIGINT) AS b", "dist")


@query("remove_overlaps", "SELECT roi_id, y, x FROM r WHERE roi_id <> 3", "r=roi_pixels")
def _(spark, sf):
    r = X.roi_pixels(spark)
    one = r.select("roi_id").distinct().withColumn("comp", F.lit(0))
    return roi.remove_overlaps(r, one).selectExpr("CAST(roi_id AS BIGINT) AS roi_id", "CAST(y AS BIGINT) AS y", "CAST(x AS BIGINT) AS x")


@query("merge_closebys", "SELECT DISTINCT 0 AS roi_id, y, x FROM r", "r=roi_pixels")
def _(spark, sf):
    r = X.roi_pixels(spark)
    one = r.select("roi_id").distinct().withColumn("comp", F.lit(0))
    return roi.merge_close(r, one, 3.0).selectExpr("CAST(roi_id AS INT) AS roi_id", "CAST(y AS BIGINT) AS y", "CAST(x AS BIGINT) AS x")


@query("pare_roi", ", i AS (SELECT * FROM r WHERE y >= 1 AND y < 7 AND x >= 1 AND x < 7) SELECT roi_id, y, x FROM i WHERE roi_id IN (SELECT roi_id FROM i GROUP BY 1 HAVING count(*) > 8)", "r=roi_pixels")
def _(spark, sf):
    return roi.pare(X.roi_pixels(spark), 1.5, 6.2, 1.0, 7.0, 8).selectExpr("CAST(roi_id AS BIGINT) AS roi_id", "CAST(y AS BIGINT) AS y", "CAST(x AS BIGINT) AS x")


@query("roi_bbox", "SELECT roi_id, greatest(0, min(y) - 1) AS y0, least(8, max(y) + 2) AS y1, greatest(0, min(x) - 1) AS x0, least(8, max(x) + 2) AS x1 FROM r GROUP BY 1", "r=roi_pixels")
def _(spark, sf):
    return roi.bounding_box(X.roi_pixels(spark), 1, 8, 8).selectExpr(*(f"CAST({c} AS BIGINT) AS {c}" for c in ("roi_id", "y0", "y1", "x0", "x1")))


@query("roi_border", "SELECT roi_id, y, x FROM r p WHERE (SELECT count(*) FROM r q WHERE q.roi_id = p.roi_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1) < 9", "r=roi_pixels")
def _(spark, sf):
    return roi.border(X.roi_pixels(spark)).selectExpr("CAST(roi_id AS BIGINT) AS roi_id", "CAST(y AS BIGINT) AS y", "CAST(x AS BIGINT) AS x")


@query("roi_remove", "SELECT CASE WHEN roi_id > 1 THEN roi_id - 1 ELSE roi_id END AS roi_id, y, x FROM r WHERE roi_id <> 1", "r=roi_pixels")
def _(spark, sf):
    return roi.remove(X.roi_pixels(spark), [1]).selectExpr("CAST(roi_id AS BIGINT) AS roi_id", "CAST(y AS BIGINT) AS y", "CAST(x AS BIGINT) AS x")


@query("roi_add", "SELECT roi_id, y, x FROM r UNION ALL SELECT roi_id + 4, y, x FROM r", "r=roi_pixels")
def _(spark, sf):
    return roi.add(X.roi_pixels(spark), X.roi_pixels(spark)).selectExpr("CAST(roi_id AS BIGINT) AS roi_id", "CAST(y AS BIGINT) AS y", "CAST(x AS BIGINT) AS x")


@query("roi_extract_blocks", "SELECT roi_id AS roi, frame_idx AS i, round(avg(v), 6) + 0.0 AS v FROM p JOIN r USING (y, x) GROUP BY 1, 2", "p=pixels", "r=roi_pixels")
def _(spark, sf):
    import numpy as np

    masks = {k: np.zeros((8, 8), bool) for k in range(4)}
    masks[0][:4, :4] = masks[1][4:, 4:] = masks[2][2:6, 2:6] = masks[3][2:4, 2:4] = True
    return rounded(movie.extract_blocks(X.frames(spark, sf), masks), "v").withColumn("roi", F.col("roi").cast("long"))


@query("scaled_frames", "SELECT frame_idx, y, x, CAST(round_even(greatest(-0.2, least(0.2, v)) / 0.4 * 255 + 127.5, 0) AS INT) AS v FROM p", "p=pixels")
def _(spark, sf):
    return movie.scaled(X.pixels(spark, sf), -0.2, 0.2).selectExpr("frame_idx", "CAST(y AS BIGINT) AS y", "CAST(x AS BIGINT) AS x", "v")


@query("shift_kernel", ORACLE["shift_frames"])
def _(spark, sf):
    from fluxgrid.operators import kernels

    return rounded(movie.pixels(kernels.apply_shifts(X.frames(spark, sf), X.motion(spark, sf))), "v").selectExpr("frame_idx", "CAST(y AS BIGINT) AS y", "CAST(x AS BIGINT) AS x", "v")


@query("pca_components", None)
def _(spark, sf):
    from fluxgrid.operators import kernels

    comps, _ = kernels.pca(X.frames(spark, sf), 4)
    return spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(comps)], "comp int, px array<double>")


@query("magic_wand", None)
def _(spark, sf):
    from fluxgrid.operators import kernels

    images = X.frames(spark, sf).select(F.col("frame_idx").alias("image"), "h", "w", "px")
    seeds = images.select(F.col("image").cast("int").alias("seed"), "image", F.lit(4).alias("cy"), F.lit(4).alias("cx"))
    return kernels.magic_wand(images, seeds, 1, 4, spread=1)


@query("si_find", "SELECT p_partkey, brand, kind FROM (SELECT p_partkey, CASE WHEN contains(lower(p_brand), '#1') THEN p_brand END AS brand, CASE WHEN contains(lower(p_type), '#1') THEN p_type END AS kind FROM part)")
def _(spark, sf):
    from fluxgrid.sources import meta

    m = X.table(spark, sf, "part").select("p_partkey", F.create_map(F.lit("brand"), "p_brand", F.lit("kind"), "p_type").alias("m"))
    found = m.select("p_partkey", meta.find("m", "#1").alias("f"))
    return found.select("p_partkey", F.try_element_at("f", F.lit("brand")).alias("brand"), F.try_element_at("f", F.lit("kind")).alias("kind"))


@query("pixels_per_micron", "SELECT p_partkey, round(512 / (1200 / CAST(p_size AS DOUBLE) * 0.5), 6) + 0.0 AS ppm FROM part")
def _(spark, sf):
    from fluxgrid.sources import meta

    return rounded(X.table(spark, sf, "part").select("p_partkey", meta.pixels_per_micron(F.lit(512.0), F.col("p_size").cast("double"), F.lit(0.5)).alias("ppm")), "ppm")
