"""Microscope metadata: description text to typed values, events, scale; all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_description(desc: str) -> Column:
    """map key -> value of the lines of a description that have '='; a value ends at a second '='; blanks and CR are stripped."""
    lines = F.filter(F.split(F.col(desc), "\n"), lambda x: F.contains(x, F.lit("=")))
    part = lambda x, k: F.trim(F.translate(F.split_part(x, F.lit("="), F.lit(k)), "\r", ""))
    pairs = F.transform(lines, lambda x: F.struct(part(x, 1).alias("k"), part(x, 2).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def as_number(v: Column) -> Column:
    """A value as double: true and false are 1 and 0; null where it is no number."""
    low = F.lower(F.trim(v))
    return F.when(low == "true", 1.0).when(low == "false", 0.0).when(low.isin("inf", "+inf"), float("inf")).when(low == "-inf", float("-inf")).when(low == "nan", float("nan")).otherwise(v.try_cast("double"))


def as_numbers(v: Column) -> Column:
    """A bracketed list as array of doubles, parted by blanks, commas or semicolons; null for other values."""
    inner = F.regexp_extract(F.trim(v), r"^\[(.*)\]$", 1)
    parts = F.filter(F.split(inner, r"[\s,;]+"), lambda x: x != "")
    return F.when(F.rlike(F.trim(v), F.lit(r"^\[.*\]$")), F.transform(parts, lambda x: x.try_cast("double")))


def frame_events(pages: DataFrame, text: str = "description") -> DataFrame:
    """(frame_idx, k, si_timestamp, data): the events {{t, x} {t, x}} that each page's description lists; pages without any have no row."""
    body = F.regexp_extract(F.col(text), r"I2CData\s*=\s*\{(.*)\}", 1)
    pair = r"\{\s*([-+0-9.eE]+)\s*,\s*\[?\s*([-+0-9.eE]+)\s*\]?\s*\}"
    t, x = F.regexp_extract_all(body, F.lit(pair), F.lit(1)), F.regexp_extract_all(body, F.lit(pair), F.lit(2))
    rows = pages.select("frame_idx", F.posexplode(F.arrays_zip(t.alias("t"), x.alias("x"))).alias("k", "e"))
    return rows.select("frame_idx", "k", F.col("e.t").try_cast("double").alias("si_timestamp"), F.col("e.x").try_cast("double").alias("data"))


def sampling_period(m: str) -> Column:
    """linePeriod * linesPerFrame + flyback time per frame, of a metadata map; missing keys count 0, 0 and 1."""
    get = lambda name, other: F.coalesce(as_number(F.try_element_at(F.filter(F.map_entries(m), lambda e: F.endswith(e["key"], F.lit(name))), F.lit(1))["value"]), F.lit(float(other)))
    return get("linePeriod", 0) * get("linesPerFrame", 0) + get("FlybackTimePerFrame", 1)


def find(m: str, text: str) -> Column:
    """Entries whose key or value holds a text, letters' case aside; a text with "zoom" also finds scan angle multipliers."""
    q = text.lower()
    hit = lambda k, v: F.contains(F.lower(k), F.lit(q)) | F.contains(F.lower(v), F.lit(q))
    return F.map_filter(m, lambda k, v: hit(k, v) | (F.contains(k, F.lit("scanAngleMultiplier")) if "zoom" in q else F.lit(False)))


def pixels_per_micron(size: Column, zoom: Column, angle: Column, field: float = 1200.0) -> Column:
    """Pixels a micron along one axis: size / (field / zoom * angle)."""
    return size / (field / zoom * angle)


def square_scale(x: Column, y: Column, zoom: Column, ax: Column, ay: Column) -> Column:
    """Pixels a micron where both axes agree; raises an error otherwise."""
    a, b = pixels_per_micron(x, zoom, ax), pixels_per_micron(y, zoom, ay)
    return F.when(F.abs(a - b) < 1e-9, a).otherwise(F.raise_error(F.lit("pixels are not square")).cast("double"))


def common_name(files: DataFrame) -> DataFrame:
    """(name): the longest prefix of parts, joined by '_', that all names (column name, without suffix) share."""
    parts = files.select(F.split(F.regexp_replace("name", r"\.tiff?$", ""), "_").alias("p"))
    rows = parts.select(F.posexplode("p").alias("k", "x"), F.size("p").alias("n"))
    total = parts.agg(F.count("*").alias("files"))
    same = rows.groupBy("k").agg(F.min("x").alias("x"), F.max("x").alias("hi"), F.count("*").alias("n")).join(total, F.lit(True))
    bad = same.where("x <> hi or n < files").agg(F.coalesce(F.min("k"), F.lit(1 << 30)).alias("bad"))
    kept = same.join(bad, F.lit(True)).where("k < bad").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("a"))
    return kept.select(F.array_join(F.transform("a", lambda e: e["x"]), "_").alias("name"))
