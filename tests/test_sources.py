"""TIFF files, metadata, recordings and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxgrid.operators import traces
from fluxgrid.sources import meta, tiff
from fluxgrid.sources.recording import Recording, read_movie
from fluxgrid.streaming import online

TEXT = "scanimage.SI.linePeriod = 0.001\r\nscanimage.SI.linesPerFrame = 10\nFlybackTimePerFrame = 0.002\nnote = a = b\nscanAngleMultiplierFast = 2\nI2CData = {{1.5, 7.3} {2.5, 8.1}}\nplain line"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("tiff")
    rng = np.random.default_rng(0)
    for k in range(2):
        pages = [(rng.integers(0, 1000, (8, 9)).astype("uint16"), TEXT if p == 0 else "x") for p in range(5)]
        (d / f"rec_a_{k}.tif").write_bytes(tiff.encode(pages))
    return d


def test_tiff_round_trip():
    image = np.arange(12, dtype="float32").reshape(3, 4)
    (h, w, text, px), (_, _, note, other) = tiff.decode(tiff.encode([(image, "a"), (image.astype("int16"), "long text")]))
    assert (h, w, text, note) == (3, 4, "a", "long text") and np.array_equal(px, image.ravel()) and np.array_equal(other, image.ravel())
    with pytest.raises(ValueError):
        next(tiff.decode(b"nothing"))


def test_movie_of_files(spark, folder):
    df = tiff.read_tiff(spark, str(folder / "*.tif"))
    frames, files = tiff.movie(df)
    assert sorted(r[0] for r in frames.select("frame_idx").collect()) == list(range(10))
    assert [tuple(r) for r in files.orderBy("file_idx").select("name", "n", "off").collect()] == [("rec_a_0.tif", 5, 0), ("rec_a_1.tif", 5, 5)]
    spark.dataSource.register(tiff.TiffSource)
    assert spark.read.format("fluxgrid_tiff").load(str(folder / "*.tif")).count() == 10
    assert read_movie(spark, str(folder / "*.tif")).count() == 10
    assert meta.common_name(files).first()["name"] == "rec_a"
    with pytest.raises(ValueError):
        read_movie(spark, "a.avi")


def test_written_tiff(spark, folder, tmp_path):
    frames, _ = tiff.movie(tiff.read_tiff(spark, str(folder / "*.tif")))
    assert tiff.write_tiff(frames, str(tmp_path), per_file=4).agg(F.sum("n")).first()[0] == 10
    again, _ = tiff.movie(tiff.read_tiff(spark, str(tmp_path / "*.tif")))
    a, b = (x.select("frame_idx", "px").orderBy("frame_idx").collect() for x in (frames, again))
    assert a == b


def test_metadata(spark, folder):
    d = spark.createDataFrame([(0, TEXT), (1, "I2CData = {}")], "frame_idx long, description string")
    m = d.select("frame_idx", "description", meta.parse_description("description").alias("m"))
    r = m.where("frame_idx = 0").select("m", meta.sampling_period("m").alias("Ts"), meta.find("m", "ZOOM").alias("z")).first()
    assert r["m"]["note"] == "a" and abs(r["Ts"] - 0.012) < 1e-12 and list(r["z"]) == ["scanAngleMultiplierFast"]
    e = meta.frame_events(d).orderBy("k").collect()
    assert [(x["frame_idx"], x["si_timestamp"], x["data"]) for x in e] == [(0, 1.5, 7.3), (0, 2.5, 8.1)]
    v = spark.createDataFrame([("true",), ("-3.5",), ("[1 2;3]",), ("abc",)], "v string")
    got = v.select(meta.as_number(F.col("v")).alias("n"), meta.as_numbers(F.col("v")).alias("l")).collect()
    assert [x["n"] for x in got] == [1.0, -3.5, None, None] and got[2]["l"] == [1.0, 2.0, 3.0]
    one = spark.range(1).select(meta.square_scale(F.lit(512.0), F.lit(512.0), F.lit(2.0), F.lit(1.0), F.lit(1.0)).alias("s"))
    assert one.first()["s"] == 512 / 600


def test_recording(spark, folder, tmp_path):
    frames, files = tiff.movie(tiff.read_tiff(spark, str(folder / "*.tif")))
    rec = Recording.ingest(spark, str(tmp_path / "rec"), frames.drop("description"), files.withColumn("Ts", F.lit(0.5)))
    assert len(rec) == 10 and rec.shape() == (10, 8, 9) and rec.sampling_period() == 0.5
    assert rec.frames(3, 6).count() == 3
    for k in range(11):
        assert rec.add_version("roi", spark.createDataFrame([(k, 0, 0)], "roi_id int, y int, x int")) == k
    assert rec.version("roi").first()["roi_id"] == 10 and rec.version("roi", 2).first()["roi_id"] == 2
    with pytest.raises(KeyError):
        rec.version("roi", 99)
    calls = []
    make = lambda: (calls.append(1), rec.frames())[1]
    rec.remembered("all", make, window=1)
    rec.remembered("all", make, window=1)
    rec.remembered("all", make, window=2)
    assert len(calls) == 2
    out = rec.export(str(tmp_path / "out"), ["frames", "files"])
    assert not out.has("frames") and out.has("files")
    out.import_from(rec, ["files"])
    rec.put("motion", frames.select("frame_idx", F.lit(1.0).alias("x"), F.lit(0.0).alias("y")))
    assert rec.frames(0, 1).first()["px"][0] == 0.0
    rec.register_views("r", ["files"])
    assert spark.sql("SELECT sum(n) FROM r_files").first()[0] == 10


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"r{k}", i, float((i * 7 + k * 3) % 11 + 1)) for k in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, "roi string, i long, v double")
    for part, ids in enumerate((range(0, 20), range(30, 60), range(20, 30))):
        df.where(F.col("i").isin(list(ids))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online.online_dff(stream, 8).writeStream.outputMode("append").format("memory").queryName("online").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["roi"], r["i"]): round(r["dff"], 9) for r in spark.table("online").collect()}
    want = {(r["roi"], r["i"]): round(r["dff"], 9) for r in traces.compute_dff(df, 8).collect()}
    assert got == want


def test_online_gives_up_a_missing_sample(spark, tmp_path):
    rows = [("a", i, float(10 + i % 7)) for i in range(60) if i not in (3, 20)]
    for k, part in enumerate((rows[:30], rows[30:])):
        spark.createDataFrame(part, "roi string, i long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("roi string, i long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online.online_dff(stream, 4, lateness=12).writeStream.outputMode("append").format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["i"]: r["f0"] for r in spark.table("gaps").collect()}
    v = {i: x for _, i, x in rows}
    assert set(got) == set(v)
    assert all(got[i] == min(v[j] for j in range(i - 3, i + 1) if j in v) for i in v if i >= 3)
    with pytest.raises(ValueError):
        online.online_dff(stream, 4, lateness=1)


def test_chunk_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", f"2024-01-01 00:00:{s:02d}", float(s)) for s in range(30)], "roi string, t string, v double").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = online.chunk_statistics(s, "t", "10 seconds", "5 seconds").writeStream.outputMode("complete").format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["mean"] for r in spark.table("chunks").collect()) == [4.5, 14.5, 24.5]
