"""Operator 9: vector best-fit packing of tokenised documents into sequences.

Pieces are vectors of three demands: tokens, documents, attention cost (length
squared). A sequence is a bin with three capacities. In order of decreasing
length, each piece goes to the open bin that has room in every dimension and
scores best: least weighted norm of the residual after placing (`score="norm"`)
or largest weighted product of demand and residual (`score="dot"`); without
such a bin a new one opens. All three demands act: bins of equal room differ
by the documents and the attention cost they hold, the weights trade that room
against tokens, and a sequence takes at most four times the mean number of
pieces (64 at least), a bound that n pieces can meet in the fewest sequences.

Packing is done in blocks of about `block` pieces, dealt by a hash of the row's
place in the written pieces (rows that repeat spread like others), so a task's
memory does not grow with the input; each block leaves at most a few
sequences partly filled, so the waste against one global packing is of the
order of 1/block. Only (id, lengths) are shuffled, never texts.

Null or empty texts are one piece of the end id; null and repeated keys are
packed like others; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm.shared import map_arrow, materialise
from fluxgrid.llm.tokens import encoder, keyed_texts, tokenizer_path

#: Weights of tokens, documents and attention cost in a bin's score.
WEIGHTS = (1.0, 0.3, 0.3)
#: Pieces a sequence may hold by default: so many, or so many times the mean.
LEAST_DOCUMENTS, TIMES_MEAN = 64, 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole, or `most` each with the shorter one first."""
    if n <= most:
        return [(0, n)]
    first = n % most
    return [(0, first)] * (first > 0) + [(s, most) for s in range(first, n, most)]


def pieces(df: DataFrame, key: str, text: str, tokenizer: str, most: int = 1024, end_id: int = 2) -> DataFrame:
    """One row for each piece of each document."""

    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        enc, end, out = encoder(tokenizer), struct.pack("<I", end_id), []
        for k, t in keyed_texts(batch):
            ids = enc.encode(t) + end
            out += [(k, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4, most))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PIECES.types)], schema=_PIECES)

    return map_arrow(df.select(F.col(key).cast("long"), F.col(text)), encode, PIECES)


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = WEIGHTS, score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length. capacity: tokens, documents, attention cost of a bin; every length must fit an empty one."""
    if score not in ("norm", "dot"):
        raise ValueError("score must be 'norm' or 'dot'")
    cap, w = np.array(capacity, float), np.array(weights, float)
    need = np.stack([lengths, np.ones(len(lengths)), np.square(lengths.astype(float))], 1) / cap
    if (need > 1 + 1e-12).any():
        raise ValueError("a piece exceeds the capacity of an empty sequence")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = need.min(0) if len(need) else None
    rest, ids, opened, size = np.ones((64, 3)), np.zeros(64, np.int64), 0, 0  # open bins: rows up to size
    for at in order:
        d = need[at]
        best = -1
        if size:
            after = rest[:size] - d
            fits = (after >= -1e-12).all(1)
            if fits.any():
                value = (after * after) @ w if score == "norm" else -(rest[:size] @ (w * d))
                best = int(np.where(fits, value, np.inf).argmin())
        if best < 0:
            if size == len(rest):
                rest, ids = np.concatenate([rest, np.ones_like(rest)]), np.concatenate([ids, np.zeros_like(ids)])
            best, rest[size], ids[size] = size, 1.0, opened
            opened, size = opened + 1, size + 1
        where[at], offset[at] = ids[best], round((1 - rest[best, 0]) * cap[0])
        rest[best] -= d
        if (rest[best] < least - 1e-12).any():  # nothing fits any more: the last open bin takes its row
            size -= 1
            rest[best], ids[best] = rest[size], ids[size]
    return where, offset


def pack(found: DataFrame, most: int = 1024, max_documents: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = WEIGHTS, score: str = "norm", block: int = 8192) -> DataFrame:
    """found (see `pieces`) with sequence_id and offset.

    max_documents: by default LEAST_DOCUMENTS or TIMES_MEAN times the mean number of pieces a sequence; max_cost: by default that of
    one piece of `most` tokens, which must fit.
    """
    found = materialise(found.withColumn("row", F.monotonically_increasing_id()), "pieces")
    rows, total = found.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    n = max(1, -(-rows // block))
    mean = rows * most / max(1, total)
    capacity = (most, max_documents or max(LEAST_DOCUMENTS, int(TIMES_MEAN * mean)), max_cost or most * most)
    dealt = found.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)).cast("long")).drop("row")
    schema = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")])
        where, offset = best_fit(t["length"].to_numpy(), capacity, weights, score)
        ids = pa.array((t["block"][0].as_py() << 32) + where)
        return t.drop(["block"]).append_column("sequence_id", ids).append_column("offset", pa.array(offset)).cast(schema)

    return dealt.groupBy("block").applyInArrow(fill, PIECES + ", sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens of byte_bpe_50k, each document ended by id 2."""
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", tokenizer_path()))
