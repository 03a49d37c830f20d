"""A recording: one folder of Parquet tables, with versioned regions and remembered results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


#: Frames of a file that one task writes.
PART = 4096


def read_movie(spark: SparkSession, path: str) -> DataFrame:
    """Frames (frame_idx, file_idx, h, w, px) by suffix: .tif and .tiff files or globs, else Parquet. Video and HDF5 need codecs that are not part of this package."""
    from fluxgrid.sources import tiff

    low = path.lower()
    if low.endswith((".tif", ".tiff")):
        return tiff.movie(tiff.read_tiff(spark, path))[0]
    if low.endswith((".avi", ".mp4", ".h5", ".hdf5")):
        raise ValueError(f"{path}: convert to TIFF or Parquet first")
    return spark.read.parquet(path)


class Recording:
    """Lazily read tables under a folder. Frames are partitioned by file and sorted by frame, so a time slice reads few row groups."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def has(self, table: str) -> bool:
        try:
            self.spark.read.parquet(self.path(table))
        except AnalysisException:
            return False
        return True

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def put(self, name: str, df: DataFrame, by: list[str] | None = None, mode: str = "overwrite") -> DataFrame:
        w = df.write.mode(mode)
        (w.partitionBy(*by) if by else w).parquet(self.path(name))
        return self.table(name)

    @classmethod
    def ingest(cls, spark: SparkSession, folder: str, frames: DataFrame, files: DataFrame, **tables: DataFrame) -> Recording:
        """Writes frames, files and side tables. A long file is written by several tasks, PART frames each."""
        out = cls(spark, folder)
        dealt = frames.withColumn("_part", F.floor(F.col("frame_idx") / PART)).repartition("file_idx", "_part").sortWithinPartitions("file_idx", "frame_idx")
        out.put("frames", dealt.drop("_part"), ["file_idx"])
        out.put("files", files.coalesce(1))
        for name, df in tables.items():
            out.put(name, df)
        return out

    def __len__(self) -> int:
        return int(self.table("files").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    def shape(self) -> tuple[int, int, int]:
        r = self.table("files").agg(F.sum("n"), F.max("y"), F.max("x")).first()
        return int(r[0]), int(r[1]), int(r[2])

    def sampling_period(self) -> float:
        """Mean period of the files."""
        return float(self.table("files").agg(F.avg("Ts")).first()[0])

    def frames(self, start: int = 0, stop: int | None = None, corrected: bool = True) -> DataFrame:
        """Frames of a time slice, moved by the stored shifts."""
        df = self.table("frames").where(F.col("frame_idx") >= start)
        df = df if stop is None else df.where(F.col("frame_idx") < stop)
        if corrected and self.has("motion"):
            from fluxgrid.operators.kernels import apply_shifts

            return apply_shifts(df, self.table("motion"))
        return df

    def versions(self, kind: str) -> list[int]:
        return sorted(r[0] for r in self.table(kind).select("version").distinct().collect()) if self.has(kind) else []

    def add_version(self, kind: str, df: DataFrame) -> int:
        """Stores df as the next version of a kind (roi, segmentation, traces, ...)."""
        new = max(self.versions(kind), default=-1) + 1
        df.write.mode("overwrite").parquet(f"{self.path(kind)}/version={new}")
        return new

    def version(self, kind: str, n: int | None = None) -> DataFrame:
        """A version, the latest by default."""
        all_of = self.versions(kind)
        if not all_of or (n is not None and n not in all_of):
            raise KeyError(f"{kind} {n}")
        return self.table(kind).where(F.col("version") == (all_of[-1] if n is None else n)).drop("version")

    def remembered(self, op: str, make: Callable[[], DataFrame], recompute: bool = False, **params) -> DataFrame:
        """The stored result of op with these parameters, computed once."""
        key = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]
        name = f"derived/{op}/{key}"
        return self.put(name, make()) if recompute or not self.has(name) else self.table(name)

    def export(self, folder: str, tables: list[str], exclude: tuple[str, ...] = ("frames",)) -> Recording:
        """Copies tables to another folder."""
        out = Recording(self.spark, folder)
        for t in tables:
            if t not in exclude and self.has(t):
                out.put(t, self.table(t))
        return out

    def import_from(self, other: Recording, tables: list[str]) -> None:
        """Overwrites each table that both have with the other's."""
        for t in tables:
            if self.has(t) and other.has(t):
                self.put(t, other.table(t))

    def register_views(self, prefix: str, tables: list[str]) -> None:
        """Temporary views for SQL."""
        for t in tables:
            self.table(t).createOrReplaceTempView(f"{prefix}_{t}")
