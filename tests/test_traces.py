"""Hand-computed cases and properties of the trace operators."""

import pytest
from pyspark.sql import functions as F

from fluxgrid.operators import index, traces
from fluxgrid.operators import windows as W


def trace(spark, *values, roi="a"):
    return spark.createDataFrame([(roi, i, None if v is None else float(v)) for i, v in enumerate(values)], "roi string, i long, v double")


def column(df, name, by="i"):
    return [r[0] for r in df.orderBy(by).select(name).collect()]


def test_dff_by_hand(spark):
    out = traces.compute_dff(trace(spark, 2, 4, 1, 3), 3)
    assert column(out, "f0") == [1, 2, 1, 1]
    assert column(out, "dff") == [1, 1, 0, 2]


def test_dff_step_holds_the_baseline(spark):
    out = traces.compute_dff(trace(spark, 5, 4, 3, 2, 1, 6), 2, step=3)
    assert column(out, "f0") == [4, 4, 4, 2, 2, 2]


@pytest.mark.parametrize("block", [7, 50, 1 << 16])
def test_blocks_do_not_change_windows(spark, block):
    t = trace(spark, *[(i * 37) % 101 + 1 for i in range(200)])
    plain = traces.compute_dff(t, 12, 5)
    cut = traces.compute_dff(t, 12, 5, block=block)
    assert column(plain, "dff") == column(cut, "dff")
    a, b = (column(W.sliding(t, F.avg("v"), "m", 10, pos="center", block=k), "m") for k in (1 << 16, block))
    assert a == b and a[:5] == [None] * 5 and a[5] is not None


def test_zero_baseline_is_null_then_filled(spark):
    out = traces.compute_dff(trace(spark, 0, 1, 2), 2)
    assert column(out, "dff")[:2] == [None, None]
    assert column(traces.dff_filled(out), "dff")[:2] == [0, 0]


def test_bad_arguments():
    with pytest.raises(ValueError):
        W.reach(0, "right")
    with pytest.raises(ValueError):
        W.reach(3, "middle")


def test_resample_twice_is_resample_once(spark):
    t = trace(spark, *range(16))
    assert column(traces.resample(traces.resample(t, 2), 2), "v") == column(traces.resample(t, 4), "v")
    assert traces.resample(trace(spark, *range(10)), 4).count() == 2


def test_missing_values_are_skipped(spark):
    t = traces.clean(trace(spark, 1, float("nan"), 3))
    r = traces.stats(t).first()
    assert (r["mean"], r["median"]) == (2.0, 2.0) and abs(r["sem"] - 1 / 3**0.5) < 1e-12


def test_constant_trace_normalises_to_null(spark):
    assert column(traces.normalize(trace(spark, 2, 2)), "v") == [None, None]


def test_last_run_can_be_skipped(spark):
    t = trace(spark, *([1, 2] * 10 + [50, 1, 2, 1, 2, 1, 2, 60, 1, 2]))
    both = traces.transients(t, 10, 0.0, 2.0, (1, 5))
    assert both.count() == 2 and traces.transients(t, 10, 0.0, 2.0, (1, 5), skip_last=True).count() == 1
    assert traces.transient_mask(t, both).agg(F.sum("event")).first()[0] >= 2


def test_tail_is_infinite_over_a_halfwidth_of_zero(spark):
    t = trace(spark, 0, 0, 1, 4).union(trace(spark, -2, -2, 1, 4, roi="b"))
    modes = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "roi string, m double")
    assert column(traces.tail_metric(t, modes), "tail", "roi") == [float("inf"), 0.75]


def test_indexing(spark):
    files = spark.createDataFrame([(0, 3), (1, 2)], "file_idx int, n int")
    frames = spark.createDataFrame([(2,), (3,)], "frame_idx long")
    assert [tuple(r) for r in index.frame_to_file(frames, files).orderBy("frame_idx").collect()] == [(2, 0, 2), (3, 1, 0)]
    local = spark.createDataFrame([(1, 1)], "file_idx int, local int")
    assert index.file_to_frame(local, files).first()["frame_idx"] == 4
    n = spark.createDataFrame([(10,)], "n long")
    q = spark.createDataFrame([(1.5,), (-3.0,), (99.0,)], "t double")
    assert [r["i"] for r in index.nearest(n, q).orderBy("t").collect()] == [0, 1, 9]
    s = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 5.0)], "i long, t double")
    q = spark.createDataFrame([(0.5,), (3.5,), (9.0,), (-1.0,)], "t double")
    assert [r["i"] for r in index.nearest_irregular(s, q).orderBy("t").collect()] == [0, 0, 2, 2]


def test_event_phase(spark):
    files = spark.createDataFrame([(0, 10), (1, 10)], "file_idx int, n int")
    e = spark.createDataFrame([(4, 1, 7.3)], "frame_idx long, file_idx int, data double")
    r = index.enrich_events(e, files).first()
    assert (r["abs_frame_idx"], r["trial"], r["phase"]) == (14, 7, 3)


def test_pulses(spark):
    t = trace(spark, *([1] * 10 + [9] * 3 + [1] + [9] * 2 + [1] * 6 + [9]))
    p = index.pulses(t, 10, 2)
    assert sorted((r["start"], r["stop"]) for r in p.collect()) == [(10, 16), (22, 23)]
    assert index.uniform_pulses(p, -1).where("start = 10").first()["stop"] == 20
    assert index.pulses(t, 10, 2, least=2).count() == 1


def test_sampling_period(spark):
    t = spark.createDataFrame([(0, 0.0), (1, 0.5), (2, 1.0)], "i long, t double")
    r = index.sampling_period(t).first()
    assert r["Ts"] == 0.5 and not r["irregular"]
