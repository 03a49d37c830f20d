"""Uncompressed greyscale multipage TIFF: a decoder, an encoder and a Spark data source.

`spark.dataSource.register(TiffSource)` gives `spark.read.format("fluxgrid_tiff").load(glob)`, which reads ranges of pages,
so files may be of any size, from the stores that pyarrow can open; `read_tiff` goes through Spark's own binary reader, one
value a file (2 GB at most), and also reaches stores that only Spark can read.
"""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes (offset, length) of a file.
Read = Callable[[int, int], bytes]
FRAME = "path string, page long, h int, w int, description string, px array<float>"
_SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}


def _order(head: bytes) -> str:
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    return order


def directories(read: Read) -> Iterator[int]:
    """Offset of each page's directory; only the chain of directories is read."""
    head = read(0, 8)
    order = _order(head)
    (at,) = struct.unpack(order + "I", head[4:8])
    while at:
        yield at
        (n,) = struct.unpack(order + "H", read(at, 2))
        (at,) = struct.unpack(order + "I", read(at + 2 + 12 * n, 4))


def decode_page(read: Read, at: int) -> tuple[int, int, str | None, np.ndarray]:
    """(height, width, description, pixels) of the page whose directory is at an offset."""
    order = _order(read(0, 8))
    (n,) = struct.unpack(order + "H", read(at, 2))
    rows, tags = read(at + 2, 12 * n), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", rows, 12 * k)
        if kind not in _SIZES:
            continue
        code, size = _SIZES[kind]
        value = rows[12 * k + 8 : 12 * k + 12]
        if size * count > 4:
            value = read(struct.unpack(order + "I", value)[0], size * count)
        tags[tag] = value[:count] if kind == 2 else struct.unpack_from(f"{order}{count}{code}", value)
    if tags.get(259, (1,))[0] != 1:
        raise ValueError("compressed TIFF is not supported")
    w, h, bits = tags[256][0], tags[257][0], tags.get(258, (8,))[0]
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]]
    raw = b"".join(read(o, c) for o, c in zip(tags[273], tags[279]))
    text = tags[270].rstrip(b"\0").decode("utf-8", "replace") if 270 in tags else None
    return h, w, text, np.frombuffer(raw, np.dtype(f"{kind}{bits // 8}").newbyteorder(order)).astype(np.float32)


def decode(data: bytes) -> Iterator[tuple[int, int, str | None, np.ndarray]]:
    """(height, width, description, pixels) of each page of a whole file."""

    def read(at: int, n: int) -> bytes:
        return data[at : at + n]

    for at in directories(read):
        yield decode_page(read, at)


def encode(pages: list[tuple[np.ndarray, str]]) -> bytes:
    """A little-endian TIFF file of (image, description) pages; unsigned or signed integers, or floats."""
    out, link = bytearray(struct.pack("<2sHI", b"II", 42, 0)), 4
    for image, text in pages:
        raw, note, (h, w) = np.ascontiguousarray(image).astype(image.dtype.newbyteorder("<")).tobytes(), text.encode() + b"\0", image.shape
        pixels_at = len(out)
        out += raw
        note_at = len(out)
        out += note + b"\0" * (-len(note) % 2)
        struct.pack_into("<I", out, link, len(out))
        inline = note.ljust(4, b"\0") if len(note) <= 4 else struct.pack("<I", note_at)
        entries = [(256, 4, 1, struct.pack("<I", w)), (257, 4, 1, struct.pack("<I", h)), (258, 3, 1, struct.pack("<HH", image.itemsize * 8, 0)), (259, 3, 1, struct.pack("<HH", 1, 0)), (262, 3, 1, struct.pack("<HH", 1, 0)), (270, 2, len(note), inline), (273, 4, 1, struct.pack("<I", pixels_at)), (278, 4, 1, struct.pack("<I", h)), (279, 4, 1, struct.pack("<I", len(raw))), (339, 3, 1, struct.pack("<HH", {"u": 1, "i": 2, "f": 3}[image.dtype.kind], 0))]
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI", t, k, c) + v for t, k, c, v in entries)
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, h, w, description, px) of all pages of all files that a path or glob names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for name, data in zip(t["path"], t["content"]):
                for page, (h, w, text, px) in enumerate(decode(data)):
                    yield pd.DataFrame({"path": [name], "page": [page], "h": [h], "w": [w], "description": [text], "px": [px]}).astype({"h": "int32", "w": "int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, FRAME)


def movie(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, files) of read pages: files in order of their names, frames numbered across them."""
    from fluxgrid.operators.index import offsets

    files = pages.groupBy("path").agg(F.count("*").cast("int").alias("n"), F.max("h").alias("y"), F.max("w").alias("x"))
    files = files.withColumn("file_idx", (F.row_number().over(Window.orderBy("path")) - 1).cast("int")).withColumn("name", F.element_at(F.split("path", "/"), -1))
    files = offsets(files)
    frames = pages.join(files.select("path", "file_idx", "off"), "path").select((F.col("off") + F.col("page")).alias("frame_idx"), "file_idx", "h", "w", "description", "px")
    return frames, files.drop("path")


def write_tiff(frames: DataFrame, folder: str, dtype: str = "uint16", per_file: int = 1000) -> DataFrame:
    """(file, n): frames written as TIFF files of per_file pages into a folder that all executors share."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        t = t.sort_values("frame_idx")
        system, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        name = f"{path}/frames_{int(t['_file'].iloc[0]):06d}.tif"
        system.create_dir(path, recursive=True)
        with system.open_output_stream(name) as f:
            f.write(encode([(np.asarray(p).reshape(h, w).astype(dtype), f"frame = {i}") for p, h, w, i in zip(t["px"], t["h"], t["w"], t["frame_idx"])]))
        return pd.DataFrame({"file": [name], "n": [len(t)]})

    return frames.withColumn("_file", F.floor(F.col("frame_idx") / per_file)).groupBy("_file").applyInPandas(run, "file string, n long")


def _opened(path: str) -> Read:
    """Reads of ranges of a file of any of pyarrow's file systems."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    file = system.open_input_file(name)

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return read


def _listed(path: str) -> list[str]:
    """The files that a path, folder or glob in a name names, sorted."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    lead = path[: len(path) - len(name)] if path.endswith(name) else ""
    folder, _, pattern = name.rpartition("/")
    if not any(c in pattern for c in "*?["):
        if system.get_file_info(name).type == fs.FileType.File:
            return [path]
        folder, pattern = name.rstrip("/"), "*.tif*"
    found = system.get_file_info(fs.FileSelector(folder))
    return sorted(lead + f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


class _Pages(InputPartition):
    def __init__(self, path: str, first: int, offsets: list[int]):
        self.path, self.first, self.offsets = path, first, offsets


class _Reader(DataSourceReader):
    def __init__(self, path: str, pages: int):
        self.path, self.pages = path, pages

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in _listed(self.path):
            at = list(directories(_opened(path)))
            out += [_Pages(path, lo, at[lo : lo + self.pages]) for lo in range(0, len(at), self.pages)]
        return out

    def read(self, partition: _Pages) -> Iterator[tuple]:
        read = _opened(partition.path)
        for page, at in enumerate(partition.offsets, partition.first):
            h, w, text, px = decode_page(read, at)
            yield partition.path, page, h, w, text, px.tolist()


class TiffSource(DataSource):
    """The data source fluxgrid_tiff. Option pages: pages of a partition (256 by default), so a file of any size is read in ranges."""

    @classmethod
    def name(cls) -> str:
        return "fluxgrid_tiff"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("pages", "256")))
