"""Registered queries of sources, recordings, kernels and compositions, with their SQL; see `catalogue`."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.functions import deconvolution
from fluxgrid.functions import kernels as K
from fluxgrid.operators import correlate, index, kernels, movie, roi, traces
from fluxgrid.operators.graph import checkpoint_folder
from fluxgrid.plans import fixtures as X
from fluxgrid.plans.catalogue import ORACLE, query, rounded
from fluxgrid.sources import meta, tiff
from fluxgrid.sources.recording import Recording, read_movie


def longs(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.col(n).cast("long"))
    return df


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/fluxgrid/{name}-{uuid.uuid4().hex}"


# --- sources and metadata

DESCRIPTION = "concat('SI.brand = ', p_brand, '\\r\\nplain line\\nSI.size = ', p_size, '\\nSI.list = [', p_partkey, ' ', p_size, '; 3]\\nSI.on = TRUE\\nSI.twice = a = b')"


def described(spark: SparkSession, sf: str) -> DataFrame:
    d = X.table(spark, sf, "part").withColumn("description", F.expr(DESCRIPTION.replace("\\", "\\\\").replace("\\\\", "\\")))
    return d.select("p_partkey", meta.parse_description("description").alias("m"))


@query("si_parse", "SELECT p_partkey, p_brand AS brand, CAST(p_size AS VARCHAR) AS size, 'TRUE' AS flag, 'a' AS twice, CAST(5 AS BIGINT) AS n FROM part")
def _(spark, sf):
    m = lambda k: F.col("m")["SI." + k]
    return described(spark, sf).select("p_partkey", m("brand").alias("brand"), m("size").alias("size"), m("on").alias("flag"), m("twice").alias("twice"), F.size("m").cast("long").alias("n"))


@query("val_parse", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CAST(1 AS DOUBLE) AS flag, CAST(p_partkey + p_size + 3 AS DOUBLE) AS total, CAST(NULL AS DOUBLE) AS brand FROM part")
def _(spark, sf):
    m = lambda k: F.col("m")["SI." + k]
    total = F.aggregate(meta.as_numbers(m("list")), F.lit(0.0), lambda a, x: a + x)
    return described(spark, sf).select("p_partkey", meta.as_number(m("size")).alias("size"), meta.as_number(m("on")).alias("flag"), total.alias("total"), meta.as_number(m("brand")).alias("brand"))


@query("fast_i2c", "SELECT event_id AS frame_idx, k, CAST(event_id AS DOUBLE) + k AS si_timestamp, (event_id // 10 + (event_id % 10) / 10.0) + k AS data FROM events, range(2) r(k)")
def _(spark, sf):
    pair = lambda k: F.format_string("{%d, [%.1f]}", F.col("event_id") + k, F.floor(F.col("event_id") / 10) + (F.col("event_id") % 10) / 10 + k)
    text = F.concat(F.lit("frame = 1\nI2CData = {"), pair(0), F.lit(" "), pair(1), F.lit("}"))
    pages = X.table(spark, sf, "events").select(F.col("event_id").alias("frame_idx"), text.alias("description"))
    return longs(meta.frame_events(pages), "k")


@query("sampling_period_of_frames", "SELECT (max(t) - min(t)) / (count(*) - 1) AS Ts, false AS irregular FROM (SELECT vec_id * CAST(0.5 AS DOUBLE) AS t FROM embeddings)")
def _(spark, sf):
    return index.sampling_period(X.frames(spark, sf).select(F.col("frame_idx").alias("i"), (F.col("frame_idx") * 0.5).alias("t")))


COUNTS = "CAST(round((CAST(embedding[p] AS DOUBLE) + 1) * 1000) AS BIGINT)"
TIFF_SQL = f"SELECT vec_id AS frame_idx, vec_id // 100 AS file_idx, (p - 1) // 8 AS y, (p - 1) % 8 AS x, {COUNTS} AS v FROM embeddings, generate_series(1, 64) g(p)"


def counted(spark: SparkSession, sf: str) -> DataFrame:
    """Frames as whole numbers, as a camera gives them."""
    return X.frames(spark, sf).withColumn("px", F.transform("px", lambda v: F.round((v.cast("double") + 1) * 1000)))


def tiff_folder(spark: SparkSession, sf: str) -> str:
    at = folder(spark, "tiff")
    tiff.write_tiff(counted(spark, sf), at, per_file=100).agg(F.sum("n")).first()
    return at


@query("tiff_movie", TIFF_SQL)
def _(spark, sf):
    f = read_movie(spark, tiff_folder(spark, sf) + "/*.tif")
    return longs(movie.pixels(f).join(f.select("frame_idx", "file_idx"), "frame_idx"), "file_idx", "y", "x", "v")


@query("tiff_source", "SELECT vec_id // 100 AS file_idx, vec_id % 100 AS page, 8 AS h, 8 AS w, concat('frame = ', vec_id) AS description FROM embeddings")
def _(spark, sf):
    spark.dataSource.register(tiff.TiffSource)
    pages = spark.read.format("fluxgrid_tiff").option("pages", "30").load(tiff_folder(spark, sf))
    return pages.select(F.regexp_extract("path", r"_(\d+)\.tif$", 1).cast("long").alias("file_idx"), "page", "h", "w", "description")


# --- recordings


def recording(spark: SparkSession, sf: str, **tables: DataFrame) -> Recording:
    return Recording.ingest(spark, folder(spark, "recording"), counted(spark, sf), X.files(spark, sf), **tables)


@query("recording_slice", f"SELECT * FROM ({TIFF_SQL}) WHERE frame_idx >= 37 AND frame_idx < 261")
def _(spark, sf):
    f = recording(spark, sf).frames(37, 261)
    return longs(movie.pixels(f).join(f.select("frame_idx", "file_idx"), "frame_idx"), "file_idx", "y", "x", "v")


@query("recording_shape", "SELECT count(*) AS n, CAST(8 AS BIGINT) AS y, CAST(8 AS BIGINT) AS x, CAST(0.1 AS DOUBLE) AS Ts FROM embeddings")
def _(spark, sf):
    r = recording(spark, sf)
    assert len(r) == r.shape()[0]
    return spark.createDataFrame([(*r.shape(), round(r.sampling_period(), 9))], "n long, y long, x long, Ts double")


@query("recording_versions", "SELECT 0 AS version, roi_id, y, x FROM r UNION ALL SELECT 1, roi_id, y, x FROM r WHERE roi_id IN (0, 2) UNION ALL SELECT 9, roi_id, y, x FROM r WHERE roi_id IN (0, 2)", "r=roi_pixels")
def _(spark, sf):
    r, rois = recording(spark, sf), X.roi_pixels(spark)
    for n in (r.add_version("roi", rois), r.add_version("roi", rois.where("roi_id in (0, 2)"))):
        assert n in r.versions("roi")
    parts = [r.version("roi", 0).withColumn("version", F.lit(0)), r.version("roi", 1).withColumn("version", F.lit(1)), r.version("roi").withColumn("version", F.lit(9))]
    return longs(parts[0].unionByName(parts[1]).unionByName(parts[2]).select("version", "roi_id", "y", "x"), "roi_id", "y", "x")


@query("recording_remembered", "SELECT frame_idx, round(avg(v), 6) + 0.0 AS v FROM p GROUP BY 1", "p=pixels")
def _(spark, sf):
    r = recording(spark, sf)
    make = lambda: rounded(movie.project(X.pixels(spark, sf), ["frame_idx"], F.avg("v")), "v")
    r.remembered("mean", make, axis="frame")

    def never() -> DataFrame:
        raise AssertionError("computed twice")

    return r.remembered("mean", never, axis="frame")


@query("recording_export", "SELECT 'files' AS kind, file_idx AS a, n FROM f UNION ALL SELECT 'marks', roi_id, count(*) FROM r GROUP BY ALL", "f=files", "r=roi_pixels")
def _(spark, sf):
    r = recording(spark, sf, marks=X.roi_pixels(spark))
    out = r.export(folder(spark, "export"), ["frames", "files", "marks"])
    assert not out.has("frames")
    out.put("marks", X.roi_pixels(spark).limit(1))
    out.import_from(r, ["marks"])
    files = out.table("files").select(F.lit("files").alias("kind"), F.col("file_idx").cast("long").alias("a"), F.col("n").cast("long"))
    return files.unionByName(out.table("marks").groupBy(F.lit("marks").alias("kind"), F.col("roi_id").cast("long").alias("a")).agg(F.count("*").alias("n")))


@query("frames_as_2d", "SELECT vec_id AS frame_idx, p - 1 AS col, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, generate_series(1, 64) g(p)")
def _(spark, sf):
    px = X.pixels(spark, sf)
    return px.select("frame_idx", (F.col("y") * 8 + F.col("x")).cast("long").alias("col"), "v")


# --- indexing

@query("nearest_irregular", """WITH s AS (SELECT epoch_us(ts) / CAST(1000000 AS DOUBLE) AS t, min(event_id) AS i FROM events GROUP BY 1),
q AS (SELECT (SELECT min(t) FROM s) - 10 + k * CAST(977.25 AS DOUBLE) AS t FROM range(300) r(k)),
a AS (SELECT q.t, s.t AS ta, s.i AS ia FROM q ASOF LEFT JOIN s ON s.t <= q.t), b AS (SELECT q.t, s.t AS tb, s.i AS ib FROM q ASOF LEFT JOIN s ON s.t >= q.t)
SELECT a.t, CASE WHEN tb IS NULL OR a.t - ta < tb - a.t OR (a.t - ta = tb - a.t AND ia < ib) THEN ia ELSE ib END AS i FROM a JOIN b ON a.t = b.t""")
def _(spark, sf):
    s = X.table(spark, sf, "events").select((F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"), F.col("event_id").alias("i"))
    low = s.agg(F.min("t").alias("low"))
    q = spark.range(300).join(low, F.lit(True)).select((F.col("low") - 10 + F.col("id") * 977.25).alias("t"))
    return index.nearest_irregular(s, q, 16)


@query("uniform_pulses", "SELECT roi, start, start + CAST(round_even(CAST(stop - start AS DOUBLE), -1) AS BIGINT) AS stop FROM (" + ORACLE["stim_pulses"] + ")")
def _(spark, sf):
    return index.uniform_pulses(index.pulses(X.trace_events(spark, sf), 50, 3), -1)


@query("gen_chunks", "SELECT (frame_idx - 13) // 60 AS chunk, (frame_idx - 13) % 60 AS rel, frame_idx, y, x, v FROM p WHERE frame_idx >= 13 AND frame_idx < 400", "p=pixels")
def _(spark, sf):
    return longs(movie.generate(X.pixels(spark, sf), 60, 500, 13, 400), "chunk", "rel", "y", "x")


@query("gen_padded", """SELECT frame_idx // 60 AS chunk, frame_idx % 60 AS rel, frame_idx, y, x, v FROM p WHERE frame_idx < 400
UNION ALL SELECT 6, k, NULL, c // 8, c % 8, NULL FROM range(40, 60) a(k), range(64) b(c)""", "p=pixels")
def _(spark, sf):
    return longs(movie.generate(X.pixels(spark, sf), 60, 500, 0, 400, pad=True), "chunk", "rel", "y", "x")


@query("gen_enforced", "SELECT frame_idx // 60 AS chunk, count(*) AS n FROM p WHERE frame_idx < 360 GROUP BY 1", "p=pixels")
def _(spark, sf):
    return longs(movie.generate(X.pixels(spark, sf), 60, 500, 0, 400, enforce_size=True), "chunk").groupBy("chunk").agg(F.count("*").alias("n"))


@query("camera_trace", "SELECT roi_id AS roi, frame_idx AS i, frame_idx * CAST(0.25 AS DOUBLE) + 3 AS t, round(avg(v), 6) + 0.0 AS v FROM p JOIN r USING (y, x) GROUP BY 1, 2", "p=pixels", "r=roi_pixels")
def _(spark, sf):
    times = X.frames(spark, sf).select("frame_idx", (F.col("frame_idx") * 0.25 + 3).alias("t"))
    return rounded(longs(movie.camera_trace(X.pixels(spark, sf), X.roi_pixels(spark), times), "roi"), "v")


@query("camera_example", "SELECT frame_idx, frame_idx * CAST(0.25 AS DOUBLE) AS t, y, x, v FROM p WHERE frame_idx >= 80 AND frame_idx < 200", "p=pixels")
def _(spark, sf):
    times = X.frames(spark, sf).select("frame_idx", (F.col("frame_idx") * 0.25).alias("t"))
    return longs(movie.camera_example(X.pixels(spark, sf), times, 20.0, 50.0), "y", "x")


@query("movie_append", "SELECT frame_idx, y, x, v FROM p UNION ALL SELECT frame_idx + (SELECT count(*) FROM embeddings), y, x, -v FROM p", "p=pixels")
def _(spark, sf):
    px = X.pixels(spark, sf)
    return longs(movie.append(px, px.withColumn("v", -F.col("v"))), "y", "x")


@query("series_append", "SELECT roi, i, v FROM s UNION ALL SELECT roi, i + (SELECT max(i) + 1 FROM s), v FROM s", "s=trace_events")
def _(spark, sf):
    t = X.trace_events(spark, sf)
    return movie.append(t, t, "i")


# --- regions


@query("roi_crops", """, b AS (SELECT roi_id, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM r GROUP BY 1),
c AS (SELECT roi_id, y0 - 1 + dy AS yy, x0 - 1 + dx AS xx, dy, dx FROM b, range(10) a(dy), range(10) e(dx) WHERE dy < y1 - y0 + 2 AND dx < x1 - x0 + 2)
SELECT c.roi_id, f.vec_id AS frame_idx, dy AS y, dx AS x, p.v FROM c CROSS JOIN (SELECT vec_id FROM embeddings) f LEFT JOIN p ON p.frame_idx = f.vec_id AND p.y = yy AND p.x = xx""", "p=pixels", "r=roi_pixels")
def _(spark, sf):
    boxes = roi.bounding_box(X.roi_pixels(spark), 0, 8, 8)
    return longs(movie.crop_padded(X.pixels(spark, sf), boxes, 1), "roi_id", "y", "x")


CORNERS = [(k, j, float(x + k % 3), float(y + k % 2)) for k in range(6) for j, (x, y) in enumerate([(0.5, 0.0), (6.0, 1.0), (4.0, 6.5)])]


@query("roi_polygon", f"""WITH c(roi_id, k, x, y) AS (VALUES {', '.join(f'({a}, {b}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))' for a, b, x, y in CORNERS)}),
e AS (SELECT a.roi_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM c a JOIN c b ON a.roi_id = b.roi_id AND b.k = (a.k + 1) % 3)
SELECT roi_id, gy AS y, gx AS x FROM e, range(20) u(gy), range(20) w(gx) GROUP BY ALL HAVING min((bx - ax) * (gy - ay) - (b_y - ay) * (gx - ax)) >= 0 OR max((bx - ax) * (gy - ay) - (b_y - ay) * (gx - ax)) <= 0""")
def _(spark, sf):
    return longs(roi.polygon(spark.createDataFrame(CORNERS, "roi_id int, k int, x double, y double")), "roi_id", "y", "x")


@query("roi_subset", "SELECT 1 AS roi_set, roi_id, y, x FROM r WHERE roi_id IN (1, 3)", "r=roi_pixels")
def _(spark, sf):
    r = X.roi_pixels(spark)
    both = r.unionByName(roi.subset(r, spark.createDataFrame([(1,), (3,)], "roi_id int"), 1))
    return longs(roi.latest(both), "roi_id", "y", "x").withColumn("roi_set", F.col("roi_set").cast("int"))


@query("process_roi", """, t AS (SELECT roi_id, frame_idx, avg(v) AS v FROM p JOIN r USING (y, x) GROUP BY 1, 2), c AS (SELECT a.roi_id AS a, b.roi_id AS b, corr(a.v, b.v) AS c FROM t a JOIN t b USING (frame_idx) WHERE a.roi_id < b.roi_id GROUP BY 1, 2)
SELECT roi_id, y, x FROM r WHERE (SELECT count(*) FROM c WHERE c > 0.3 AND a = 2 AND b = 3) = 0 OR roi_id <> 3""", "p=pixels", "r=roi_pixels")
def _(spark, sf):
    r = X.roi_pixels(spark)
    out = roi.process(r, movie.extract(X.pixels(spark, sf), r), similarity=(0.3, 0.9), distance=3.0)
    return longs(out.select("roi_id", "y", "x"), "roi_id", "y", "x")


# --- traces


@query("dff_filled", """, d AS (SELECT roi, i, v, min(v) OVER (PARTITION BY roi ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS f0 FROM (SELECT * FROM s UNION ALL SELECT roi, -i, v FROM s WHERE i BETWEEN 1 AND 4))
SELECT roi, i, round(coalesce((v - f0) / nullif(f0, 0), 0), 6) + 0.0 AS dff FROM d WHERE i >= 0""", "s=trace_events")
def _(spark, sf):
    return rounded(traces.dff_filled(traces.compute_dff(X.trace_events(spark, sf), 5)).select("roi", "i", "dff"), "dff")


MODE_SQL = """, h(roi, x) AS (SELECT roi, list_sort(list(v)) FROM s GROUP BY roi UNION ALL
  SELECT roi, list_slice(x, o, o + k - 1) FROM (SELECT roi, x, k, list_position(w, list_min(w)) AS o FROM (
    SELECT roi, x, k, list_transform(range(1, least(k, len(x) - k + 1) + 1), lambda j: x[j + k - 1] - x[j]) AS w FROM (SELECT roi, x, CAST((len(x) + 1) // 2 AS BIGINT) AS k FROM h WHERE len(x) > 3)))),
mode AS (SELECT roi, CASE WHEN len(x) = 3 THEN CASE WHEN x[2] - x[1] < x[3] - x[2] THEN (x[1] + x[2]) / 2 ELSE x[2] END ELSE list_avg(x) END AS m FROM h WHERE len(x) <= 3)"""


@query("half_sample_mode", MODE_SQL + " SELECT roi, round(m, 6) + 0.0 AS m FROM mode", "s=trace_events")
def _(spark, sf):
    return rounded(kernels.modes(X.trace_events(spark, sf)), "m")


@query("transient_tail", MODE_SQL + """, g AS (SELECT roi, quantile_cont(v, 0.01) AS h FROM s JOIN mode USING (roi) WHERE v < m GROUP BY roi)
SELECT roi, round(abs((avg(v) - max(m)) / max(h)), 6) + 0.0 AS tail FROM s JOIN mode USING (roi) JOIN g USING (roi) WHERE v > m + h GROUP BY roi""", "s=trace_events")
def _(spark, sf):
    t = X.trace_events(spark, sf)
    return rounded(traces.tail_metric(t, kernels.modes(t)), "tail")


for _name in ("half_sample_mode", "transient_tail"):
    ORACLE[_name] = ORACLE[_name].replace("WITH ", "WITH RECURSIVE ", 1)


def short_traces(spark: SparkSession, sf: str, n: int) -> DataFrame:
    """All events in traces of n samples."""
    t = X.trace_events(spark, sf)
    return t.select(F.concat_ws("-", "roi", F.floor(F.col("i") / n)).alias("roi"), (F.col("i") % n).alias("i"), "v")


SHORT = "t AS (SELECT roi || '-' || (i // {n}) AS roi, i % {n} AS i, v FROM s)"


@query("deconvolve_ar1_short", ", " + SHORT.format(n=24) + """, l AS (SELECT roi, max(i) AS top FROM t GROUP BY roi),
w AS (SELECT t.roi, t.i, (v - 1 - CASE WHEN t.i = top THEN 0.5 ELSE 0.5 * (1 - 0.8) END) * pow(0.8, t.i) AS a, pow(0.8, 2 * t.i) AS b FROM t JOIN l USING (roi)),
m AS (SELECT f.roi, f.i AS p, e.i AS q, sum(w.a) / sum(w.b) AS x FROM w f JOIN w e ON e.roi = f.roi AND e.i >= f.i JOIN w ON w.roi = f.roi AND w.i BETWEEN f.i AND e.i GROUP BY 1, 2, 3),
c AS (SELECT roi, i, greatest(0, max(lo)) * pow(0.8, i) AS c FROM (SELECT t.roi, t.i, m.p, min(m.x) AS lo FROM t JOIN m ON m.roi = t.roi AND m.p <= t.i AND m.q >= t.i GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT roi, i, round(c, 6) + 0.0 AS c, round(CASE WHEN i > 0 THEN c - 0.8 * lag(c) OVER (PARTITION BY roi ORDER BY i) ELSE 0 END, 6) + 0.0 AS s FROM c""", "s=trace_events")
def _(spark, sf):
    def run(t):
        t = t.sort_values("i")
        c, s = deconvolution.ar1(t["v"].to_numpy(float) - 1, 0.8, 0.5)
        return t.assign(c=c, s=s)[["roi", "i", "c", "s"]]

    return rounded(short_traces(spark, sf, 24).groupBy("roi").applyInPandas(run, "roi string, i long, c double, s double"), "c", "s")


@query("trace_noise", ", " + SHORT.format(n=32) + """, n AS (SELECT roi FROM t GROUP BY roi HAVING count(*) = 32), d AS (SELECT roi, i, (v - avg(v) OVER (PARTITION BY roi)) * (0.5 - 0.5 * cos(2 * pi() * i / 32)) AS x FROM t JOIN n USING (roi)),
f AS (SELECT roi, k, pow(sum(x * cos(2 * pi() * k * i / 32)), 2) + pow(sum(x * sin(2 * pi() * k * i / 32)), 2) AS p FROM d, range(9, 16) g(k) GROUP BY 1, 2)
SELECT roi, round(sqrt(avg(p) / (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * j / 32), 2)) FROM range(32) e(j))), 5) + 0.0 AS sn FROM f GROUP BY roi""", "s=trace_events")
def _(spark, sf):
    t = short_traces(spark, sf, 32)
    whole = t.groupBy("roi").agg(F.count("*").alias("n")).where("n = 32").select("roi")
    return rounded(kernels.trace_noise(t.join(whole, "roi")), "sn", digits=5)


@query("ar1_coefficient", """, m AS (SELECT roi, avg(v) AS m, count(*) AS n FROM s GROUP BY roi), d AS (SELECT roi, i, v - m AS d, n FROM s JOIN m USING (roi)),
a AS (SELECT x.roi, k, sum(x.d * y.d) / max(x.n) AS a FROM d x, range(7) g(k), d y WHERE y.roi = x.roi AND y.i = x.i + k GROUP BY 1, 2),
g AS (SELECT p.roi, sum((p.a - CASE WHEN p.k = 0 THEN 0.25 ELSE 0 END) * q.a) / sum(pow(p.a - CASE WHEN p.k = 0 THEN 0.25 ELSE 0 END, 2)) AS g FROM a p JOIN a q ON q.roi = p.roi AND q.k = p.k + 1 WHERE p.k < 6 GROUP BY 1)
SELECT roi, round(CASE WHEN g > 1 THEN 0.95 WHEN g < 0 THEN 0.15 ELSE g END, 5) + 0.0 AS g FROM g""", "s=trace_events")
def _(spark, sf):
    def run(t):
        y = t.sort_values("i")["v"].to_numpy(float)
        return t[["roi"]][:1].assign(g=float(K.ar_coefficients(y, 1, 0.5)[0]))

    return rounded(X.trace_events(spark, sf).groupBy("roi").applyInPandas(run, "roi string, g double"), "g", digits=5)


ORACLE["ar1_coefficient"] = ORACLE["ar1_coefficient"].replace("FROM d x, range(7) g(k), d y WHERE y.roi = x.roi AND y.i = x.i + k", "FROM (SELECT *, i + k AS j FROM d, range(7) g(k)) x JOIN d y ON y.roi = x.roi AND y.i = x.j")


@query("rolling_corr_of_rois", """, t AS (SELECT roi_id AS roi, frame_idx AS i, avg(v) AS v FROM p JOIN r USING (y, x) GROUP BY 1, 2),
c AS (SELECT a.roi AS ra, b.roi AS rb, a.i, corr(a.v, b.v) OVER w AS r, count(*) OVER w AS k FROM t a JOIN t b ON a.i = b.i AND a.roi < b.roi WINDOW w AS (PARTITION BY a.roi, b.roi ORDER BY a.i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))
SELECT i, CASE WHEN min(k) = 21 THEN round(avg(r), 6) + 0.0 END AS r FROM c GROUP BY i""", "p=pixels", "r=roi_pixels")
def _(spark, sf):
    return rounded(correlate.rolling_correlation(movie.extract(X.pixels(spark, sf), X.roi_pixels(spark)), 21), "r")


# --- kernels on frames


@query("motion_by_chunk", "SELECT vec_id AS frame_idx, vec_id // 100 AS chunk, CASE WHEN vec_id % 3 = 0 THEN 3 - vec_id % 7 ELSE 0 END AS x, CASE WHEN vec_id % 3 = 0 THEN 2 - vec_id % 5 ELSE 0 END AS y FROM embeddings")
def _(spark, sf):
    f = textured(spark, sf, 3).withColumn("chunk", F.floor(F.col("frame_idx") / 100))
    found = kernels.motion_by_chunk(f, "chunk", 4, 4, 3)
    return found.select("frame_idx", F.col("chunk").cast("long").alias("chunk"), F.round("x").cast("long").alias("x"), F.round("y").cast("long").alias("y"))


@query("resize_half", """, a AS (SELECT i AS k, i * CAST(7 AS DOUBLE) / 3 AS o FROM range(4) g(i)), w AS (SELECT k, j, CASE WHEN j = floor(o) THEN 1 - (o - floor(o)) ELSE o - floor(o) END AS f FROM a, range(8) e(j) WHERE j = floor(o) OR j = floor(o) + 1)
SELECT frame_idx, wy.k AS y, wx.k AS x, round(sum(v * wy.f * wx.f), 5) + 0.0 AS v FROM p JOIN w wy ON wy.j = y JOIN w wx ON wx.j = x GROUP BY 1, 2, 3""", "p=pixels")
def _(spark, sf):
    return rounded(longs(movie.pixels(kernels.resize(X.frames(spark, sf), 0.5)), "y", "x"), "v", digits=5)


@query("pca_reconstruction", "SELECT a.c AS a, b.c AS b, round(covar_pop(a.v, b.v), 6) + 0.0 AS cov FROM (SELECT frame_idx, y * 8 + x AS c, v FROM p) a JOIN (SELECT frame_idx, y * 8 + x AS c, v FROM p) b USING (frame_idx) GROUP BY 1, 2", "p=pixels")
def _(spark, sf):
    f = X.frames(spark, sf)
    comps, mean = kernels.pca(f, 64)
    assert np.allclose(comps @ comps.T, np.eye(64), atol=1e-8)
    axes = spark.createDataFrame([(k, c.tolist(), float(c @ mean)) for k, c in enumerate(comps)], "k int, c array<double>, m double")  # 64 images
    score = F.aggregate(F.zip_with("px", "c", lambda p, c: p.cast("double") * c), F.lit(0.0), lambda s, v: s + v) - F.col("m")
    spread = f.join(axes, F.lit(True)).groupBy("k").agg(F.var_pop(score).alias("spread"))
    cell = axes.join(spread, "k").select("spread", F.posexplode("c").alias("a", "ca"), "c").select("spread", "a", "ca", F.posexplode("c").alias("b", "cb"))
    return rounded(cell.groupBy(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).agg(F.sum(F.col("spread") * F.col("ca") * F.col("cb")).alias("cov")), "cov")


@query("pca_variances", "SELECT CAST(1 AS INT) AS ordered, round(sum(s), 6) + 0.0 AS total FROM (SELECT var_pop(v) AS s FROM p GROUP BY y, x)", "p=pixels")
def _(spark, sf):
    f = X.frames(spark, sf)
    comps, _ = kernels.pca(f, 64)
    axes = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(comps)], "k int, c array<double>")
    score = F.aggregate(F.zip_with("px", "c", lambda p, c: p.cast("double") * c), F.lit(0.0), lambda s, v: s + v)
    each = f.join(axes, F.lit(True)).groupBy("k").agg(F.var_pop(score).alias("s"))
    each = each.agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("a"))  # 64 numbers
    falls = F.forall(F.sequence(F.lit(1), F.size("a") - 1), lambda i: F.element_at("a", i)["s"] >= F.element_at("a", i + 1)["s"] - 1e-12)
    return rounded(each.select(falls.cast("int").alias("ordered"), F.aggregate("a", F.lit(0.0), lambda t, x: t + x["s"]).alias("total")), "total")


def textured(spark: SparkSession, sf: str, every: int = 1) -> DataFrame:
    """Textured frames of 24 x 24 pixels, every `every`-th moved by a known whole number of pixels."""
    moved = F.when(F.col("frame_idx") % every == 0, 1.0).otherwise(0.0)
    f = X.frames(spark, sf).select("frame_idx", (moved * (F.col("frame_idx") % 7 - 3)).alias("dx"), (moved * (F.col("frame_idx") % 5 - 2)).alias("dy"))
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(23)), lambda x: F.struct(y.alias("y"), x.alias("x")))))
    px = F.transform(cells, lambda c: 100 + 40 * F.sin((c["x"] - F.col("dx")) * 0.9 + (c["y"] - F.col("dy")) * 0.4) + 30 * F.cos((c["y"] - F.col("dy")) * 1.3 - (c["x"] - F.col("dx")) * 0.5) + 20 * F.sin((c["x"] - F.col("dx")) * (c["y"] - F.col("dy")) * 0.11))
    return f.select("frame_idx", F.lit(24).alias("h"), F.lit(24).alias("w"), px.alias("px"))


@query("motion_shifts", "SELECT vec_id AS frame_idx, -(vec_id % 7 - 3) AS x, -(vec_id % 5 - 2) AS y FROM embeddings")
def _(spark, sf):
    f = textured(spark, sf)
    still = np.array(f.where("frame_idx = 17").first()["px"]).reshape(24, 24)  # dx = dy = 0
    return kernels.motion(f, still, 4, 4).select("frame_idx", F.round("x").cast("long").alias("x"), F.round("y").cast("long").alias("y"))


@query("motion_corrected", "SELECT CAST(0 AS BIGINT) AS worse, count(*) AS n FROM embeddings")
def _(spark, sf):
    f = textured(spark, sf, 3)
    total, _ = kernels.motion_correct(f, 7, 7, 4)
    step = lambda n, k: F.when(F.col("frame_idx") % 3 == 0, F.col("frame_idx") % n - k).otherwise(0)
    left = total.select((F.col("x") + step(7, 3)).alias("x"), (F.col("y") + step(5, 2)).alias("y"))  # one offset for all frames is free
    mid = left.agg(F.percentile("x", F.lit(0.5)).alias("mx"), F.percentile("y", F.lit(0.5)).alias("my"))
    return left.join(mid, F.lit(True)).agg(F.count_if((F.abs(F.col("x") - F.col("mx")) > 0.5) | (F.abs(F.col("y") - F.col("my")) > 0.5)).alias("worse"), F.count("*").alias("n"))


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """One component image a file: two bright rectangles, placed by the file's number."""
    px = lambda k: "CASE WHEN (p DIV 16) BETWEEN 1 AND 3 AND p % 16 BETWEEN 1 + k % 2 AND 4 + k % 2 OR (p DIV 16) BETWEEN 9 AND 13 AND p % 16 BETWEEN 8 AND 12 THEN 1.0 ELSE 0.0 END"
    cells = X.files(spark, sf).select(F.col("file_idx").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(255))).alias("p"))
    v = cells.select("k", "p", F.expr(px("k")).cast("double").alias("v"))
    return v.groupBy(F.col("k").alias("comp")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda c: c["v"]).alias("px")).select("comp", F.lit(16).alias("h"), F.lit(16).alias("w"), "px")


BOXES = "b AS (SELECT file_idx AS k, c // 16 AS y, c % 16 AS x, c // 16 > 5 AS low FROM f, range(256) g(c) WHERE (c // 16 BETWEEN 1 AND 3 AND c % 16 BETWEEN 1 + file_idx % 2 AND 4 + file_idx % 2) OR (c // 16 BETWEEN 9 AND 13 AND c % 16 BETWEEN 8 AND 12))"


@query("comps_to_roi", f", {BOXES}, o AS (SELECT k, low, row_number() OVER (ORDER BY pow(avg(y), 2) + pow(avg(x), 2), k, low) - 1 AS roi_id FROM b GROUP BY k, low) SELECT roi_id, y, x FROM b JOIN o USING (k, low)", "f=files")
def _(spark, sf):
    return longs(kernels.component_regions(boxes(spark, sf), n_std=1, sigma=0.0, area=(2, -1)).select("roi_id", "y", "x"), "roi_id", "y", "x")


@query("roi_areas", ", a AS (SELECT roi_id, count(*) AS area, avg(y) AS cy, avg(x) AS cx FROM r GROUP BY 1) SELECT * FROM a", "r=roi_pixels")
def _(spark, sf):
    r = X.roi_pixels(spark)
    return longs(roi.areas(r).join(roi.centroids(r), "roi_id"), "roi_id")


RECTANGLES = "SELECT n AS roi_id, 3 + n % 5 AS y0, 2 + n % 3 AS x0, 5 + n % 4 AS h, 6 + n % 7 AS w FROM range(40) g(n)"


def rectangles(spark: SparkSession) -> DataFrame:
    """Forty filled rectangles."""
    r = spark.range(40).selectExpr("CAST(id AS INT) AS roi_id", "3 + id % 5 AS y0", "2 + id % 3 AS x0", "5 + id % 4 AS h", "6 + id % 7 AS w")
    r = r.select("roi_id", F.explode(F.expr("sequence(CAST(y0 AS INT), CAST(y0 + h - 1 AS INT))")).alias("y"), "x0", "w")
    return r.select("roi_id", "y", F.explode(F.expr("sequence(CAST(x0 AS INT), CAST(x0 + w - 1 AS INT))")).alias("x"))


@query("roi_circularity", f"SELECT roi_id, CAST(2 * (h + w) - 4 AS DOUBLE) AS perimeter, round(4 * pi() * h * w / pow(2 * (h + w) - 4, 2), 6) + 0.0 AS circularity FROM ({RECTANGLES})")
def _(spark, sf):
    return rounded(longs(kernels.circularities(rectangles(spark)), "roi_id"), "circularity")


@query("roi_contour", f"""WITH r AS ({RECTANGLES}) SELECT roi_id, k, CASE WHEN k < w THEN y0 WHEN k < w + h - 1 THEN y0 + k - w + 1 WHEN k < 2 * w + h - 2 THEN y0 + h - 1 ELSE y0 + h - 1 - (k - 2 * w - h + 3) END AS y,
CASE WHEN k < w THEN x0 + k WHEN k < w + h - 1 THEN x0 + w - 1 WHEN k < 2 * w + h - 2 THEN x0 + w - 1 - (k - w - h + 2) ELSE x0 END AS x FROM r, range(40) g(k) WHERE k < 2 * (h + w) - 4""")
def _(spark, sf):
    return longs(kernels.contours(rectangles(spark)), "roi_id", "k", "y", "x")


@query("deconvolve_ar1", "SELECT roi, count(*) AS n, CAST(1 AS INT) AS feasible, CAST(1 AS INT) AS meets_noise FROM s GROUP BY 1", "s=trace_events")
def _(spark, sf):
    t = X.trace_events(spark, sf)
    d = kernels.deconvolve(t).join(t, ["roi", "i"]).join(kernels.trace_noise(t), "roi")
    off = F.pow(F.col("v") - F.col("b") - F.col("c"), 2)
    return d.groupBy("roi").agg(F.count("*").alias("n"), (F.min("s") > -1e-9).cast("int").alias("feasible"), (F.sum(off) <= 1.05 * F.count("*") * F.pow(F.max("sn"), 2)).cast("int").alias("meets_noise"))


@query("nmf_fit", "SELECT CAST(1 AS INT) AS non_negative, CAST(1 AS INT) AS better_than_mean, count(*) AS n FROM embeddings")
def _(spark, sf):
    f = counted(spark, sf)
    images, weights = kernels.nmf(f, 4, rounds=10)
    low = f.select(F.explode("px").alias("v")).agg(F.percentile_approx("v", F.lit(0.01), F.lit(100_000))).first()[0]
    axes = F.array(*[F.array(*map(F.lit, row)) for row in images.tolist()])  # four images
    fitted = F.transform(F.sequence(F.lit(0), F.size("px") - 1), lambda p: F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda s, k: s + F.col("w")[k] * axes[k][p]))
    j = f.drop("w").join(weights, "frame_idx").select(F.arrays_zip(F.transform("px", lambda v: F.greatest(v - low, F.lit(0.0))).alias("y"), fitted.alias("z")).alias("yz"), "w")
    cells = j.select("w", F.explode("yz").alias("c"))
    return cells.agg(
        (F.min(F.array_min("w")) >= 0).cast("int").alias("non_negative"),
        (F.sum(F.pow(F.col("c.y") - F.col("c.z"), 2)) < F.var_pop("c.y") * F.count("*")).cast("int").alias("better_than_mean"),
    ).join(f.agg(F.count("*").alias("n")), F.lit(True))
