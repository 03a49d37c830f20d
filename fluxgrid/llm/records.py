"""Operator 3: token ids as length-delimited binary records.

A shard file is ``MAGIC | u32 id width | records``; a record is

    u64 payload bytes | u32 masked crc of those 8 bytes | payload | u32 masked crc of the payload

with little-endian numbers and ids of 2 bytes where the vocabulary has at most
65,536 entries, else 4. The offset index is a file of its own,
``MAGIC_INDEX | per record: i64 key, u8 key is null, u64 offset, u64 ids | u32 masked crc``,
so records can be read in any order.

Layout and recovery: rows are range-partitioned by key, then by a hash of the
text and by where the row was read, so a shard holds a run of keys, a repeated
key can fill several shards and no row is collected; each task streams one shard to the
shared folder under a name of its own. A retried task writes another file and
only the file of the task that succeeded is in the manifest, which is written
once and has one row a shard.

Null texts count as empty (only the end id); null keys come first; repeated
keys stay, in the order of their texts' hashes; an empty table gives no shard and no row. Columns
other than key and text are not read, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrid.llm.shared import checkpoint_root, materialise
from fluxgrid.llm.tokens import encoder, keyed_texts, tokenizer_path

MAGIC, MAGIC_INDEX = b"FGTOKEN1", b"FGINDEX1"
_ENTRY = "<qBQQ"
MANIFEST = "part int, file string, index_file string, n_records long, n_tokens long"
READ = "key long, start long, n_tokens long, ids_crc32 long, ids binary"


def masked(data: bytes) -> int:
    """CRC-32 rotated by 15 bits plus a constant, so that a checksum of data that hold checksums stays strong."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def file_system(uri: str):
    """(file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_records(df: DataFrame, key: str, text: str, out: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encode and write every row of df in ascending key order below the folder `out`; returns the manifest."""
    order = ["key", "hash", "part"]
    rows = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(text)).alias("hash"), F.spark_partition_id().alias("part"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        width, end = (2 if enc.vocab <= 1 << 16 else 4), struct.pack("<I", end_id)
        name, at, tokens, sink, index = f"{out}/part-{part:06d}-{uuid.uuid4().hex}", len(MAGIC) + 4, 0, None, []
        for batch in batches:
            for k, t in keyed_texts(batch):
                if sink is None:
                    system, path = file_system(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    sink = system.open_output_stream(path + ".rec")
                    sink.write(MAGIC + struct.pack("<I", width))
                ids = np.frombuffer(enc.encode(t) + end, "<u4")
                record = frame((ids.astype("<u2") if width == 2 else ids).tobytes())
                sink.write(record)
                index.append(struct.pack(_ENTRY, k or 0, k is None, at, len(ids)))
                at, tokens = at + len(record), tokens + len(ids)
        if sink is None:
            return
        sink.close()
        body = b"".join(index)
        with system.open_output_stream(path + ".idx") as f:
            f.write(MAGIC_INDEX + body + struct.pack("<I", masked(body)))
        yield pa.RecordBatch.from_pylist([{"part": part, "file": name + ".rec", "index_file": name + ".idx", "n_records": len(index), "n_tokens": tokens}], pa.schema([("part", pa.int32()), ("file", pa.string()), ("index_file", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64())]))

    return materialise(rows.mapInArrow(write, MANIFEST), "records-manifest")


def read_index(data: bytes) -> list[tuple[int | None, int, int]]:
    """(key, offset, number of ids) of each record of a shard."""
    body = data[len(MAGIC_INDEX) : -4]
    if data[: len(MAGIC_INDEX)] != MAGIC_INDEX or struct.unpack("<I", data[-4:])[0] != masked(body):
        raise ValueError("not an index file, or a damaged one")
    return [(None if null else k, at, n) for k, null, at, n in struct.iter_unpack(_ENTRY, body)]


def read_record(f, at: int, width: int) -> np.ndarray:
    """The ids of the record at an offset; raises ValueError where a checksum fails."""
    f.seek(at)
    head = f.read(12)
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError(f"damaged length at {at}")
    (size,) = struct.unpack("<Q", head[:8])
    data = f.read(size + 4)
    if len(data) < size + 4 or masked(data[:size]) != struct.unpack("<I", data[size:])[0]:
        raise ValueError(f"damaged record at {at}")
    return np.frombuffer(data[:size], "<u2" if width == 2 else "<u4").astype("<u4")


def read_records(spark: SparkSession, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Rows (key, start, n_tokens, ids_crc32, ids) of all records, by way of the offset indexes.

    start counts the ids of all records before it; ids are little-endian unsigned 32-bit integers (null without with_ids).
    """
    n = max(1, manifest.count())
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("part", "file", "index_file", base.alias("base")).repartitionByRange(n, "part")
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in (s for batch in batches for s in batch.to_pylist()):
            system, path = file_system(shard["file"])
            with system.open_input_stream(file_system(shard["index_file"])[1]) as f:
                index = read_index(f.read())
            start, out = shard["base"], []
            with pa.BufferedInputStream(system.open_input_stream(path), 1 << 20) as f, system.open_input_file(path) as far:
                head = f.read(len(MAGIC) + 4)
                if head[: len(MAGIC)] != MAGIC:
                    raise ValueError(f"{shard['file']} is no record file")
                (width,) = struct.unpack("<I", head[len(MAGIC) :])
                ahead = _Forward(f, len(head), far)
                for key, at, count in index:
                    ids = read_record(ahead, at, width)
                    if len(ids) != count:
                        raise ValueError(f"record at {at} has {len(ids)} ids, its index {count}")
                    raw = ids.tobytes()
                    out.append((key, start, count, zlib.crc32(raw), raw if with_ids else None))
                    start += count
                    if len(out) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return shards.mapInArrow(read, READ)


class _Forward:
    """Sequential reads from a buffered stream, others from the random-access file."""

    def __init__(self, stream, at: int, far):
        self.stream, self.at, self.far, self.near = stream, at, far, True

    def seek(self, at: int) -> None:
        self.near = at == self.at
        if not self.near:
            self.far.seek(at)

    def read(self, n: int) -> bytes:
        if self.near:
            self.at += n
            return self.stream.read(n)
        return self.far.read(n)


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, written with byte_bpe_50k and end id 2, and read back: doc_id, start, n_tokens, ids_crc32."""
    out = f"{checkpoint_root(spark)}/fluxgrid/records-{uuid.uuid4().hex}"
    manifest = write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", out, tokenizer_path())
    return read_records(spark, manifest, with_ids=False).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
