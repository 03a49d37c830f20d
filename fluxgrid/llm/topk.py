"""Operator 10: exact top-k inner products by pivot-table elimination.

Vectors are packed in blocks; beside each block stand the distances of its
vectors to the pivots (a pivot table). For a query q and a candidate x the
triangle inequality gives d(q, x) >= max over pivots p of |d(q, p) - d(x, p)|,
so q.x = (|q|^2 + |x|^2 - d^2) / 2 has an upper bound. Candidates are evaluated
in order of that bound, until it falls below the k-th best score: exact.

Scale: the queries, packed in chunks, go to every block of candidates (the
query set against all rows, in blocks); a block of candidates moves once (a few
times where there are fewer blocks than cores), and the chunks stream past it one at a time. Each meeting returns at most k rows a
query, and merging keeps k a query before and after the shuffle. Pivots are
chosen farthest-first from a bounded hash sample (at most ``SAMPLE`` vectors).
Rows are dealt to blocks by their place in the written table, so rows that
repeat spread like others.

Scores are exact whatever the components: in doubles while every product sum
stays below 2^53, else in whole numbers of any size. A score that belongs to
the result but does not fit a long raises an error.

Vectors that are null, empty, or hold null, NaN or infinite components, and
rows with a null id take no part. Vectors of unlike lengths: missing
components count 0. Rows with equal ids are different rows; ties go to the
smaller id. With fewer than k candidates all are returned. An empty table
gives no row. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrid.llm.shared import materialise

#: Vectors that pivots are chosen from, at most about.
SAMPLE = 2000
#: Vectors in a block, about.
BLOCK = 4096
QUERY_BLOCK = 512
FOUND = "query_id long, query_row long, vec_id long, over int, score long"
_FOUND = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("over", pa.int32()), ("score", pa.int64())])


def quantised(vector: str, scale: int = 64) -> Column:
    """floor(scale * x) / scale of each component, or null where the vector takes no part.

    scale is a power of two, so the division is exact and no finite component overflows; from 2^45 on a double is whole.
    """
    if scale & (scale - 1):
        raise ValueError("scale must be a power of two")
    v = F.col(vector).cast("array<double>")
    size = float(scale)
    whole = F.transform(v, lambda x: F.when(F.abs(x) < float(1 << 45), F.floor(x * size).cast("double") / size).otherwise(x))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(v.isNotNull() & (F.size(v) > 0) & ~bad, whole)


def exact(v: np.ndarray, scale: int) -> list[int]:
    """scale times each component, as whole numbers of any size."""
    return [int(x * scale) if abs(x) < 1 << 45 else int(x) * scale for x in v.tolist()]


def small(x: np.ndarray, scale: int) -> np.ndarray:
    """Which vectors have a norm below 2^26 after scaling: inner products among those are exact in doubles."""
    with np.errstate(over="ignore"):
        return np.square(np.abs(x).max(1, initial=0) * scale) * x.shape[1] < float(1 << 52)


def matrix(rows: list, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the vector whose nearest pivot so far is farthest."""
    if not len(sample):
        return sample
    picked = [int(np.square(sample - sample.mean(0)).sum(1).argmax())]
    near = np.square(sample - sample[picked[0]]).sum(1)
    while len(picked) < min(n, len(sample)):
        picked.append(int(near.argmax()))
        near = np.minimum(near, np.square(sample - sample[picked[-1]]).sum(1))
    return sample[picked]


def table(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of every vector to every pivot."""
    out = np.zeros((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(np.square(x - p).sum(1))
    return out


def bounds(q: np.ndarray, q_table: np.ndarray, x: np.ndarray, x_table: np.ndarray) -> np.ndarray:
    """Upper bound of each query's inner product with each candidate, by the pivots; no less than it with all rounding."""
    low = np.zeros((len(q), len(x)))
    for j in range(x_table.shape[1]):
        np.maximum(low, np.abs(x_table[:, j] - q_table[:, j, None]), out=low)
    nq, nx = np.square(q).sum(1), np.square(x).sum(1)
    both = nq[:, None] + nx
    np.square(np.maximum(low - 1e-9 * np.sqrt(both), 0, out=low), out=low)
    low = (both - low) / 2
    return low + 1e-9 * both


def search(q: np.ndarray, q_table: np.ndarray, x: np.ndarray, x_table: np.ndarray, ids: np.ndarray, skip: np.ndarray, k: int, step: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the positions and scores of its k best candidates, ties to smaller ids. skip: the query's own position or -1."""
    out = []
    if not len(x):
        return [(np.zeros(0, int), np.zeros(0))] * len(q)
    bound = bounds(q, q_table, x, x_table)
    for i in range(len(q)):
        mine = bound[i]
        if skip[i] >= 0:
            mine[skip[i]] = -np.inf
        size, left = step, np.arange(len(x))
        at, score = np.zeros(0, int), np.zeros(0)
        while len(left):
            if len(left) > size:  # the next candidates in bound order
                part = np.argpartition(-mine[left], size)
                now, left = left[part[:size]], left[part[size:]]
            else:
                now, left = left, left[:0]
            now = now[mine[now] > -np.inf]
            at, score = np.concatenate([at, now]), np.concatenate([score, x[now] @ q[i]])
            best = np.lexsort((ids[at], -score))[:k]
            at, score = at[best], score[best]
            if len(at) == k:
                left = left[mine[left] >= score[-1]]  # the rest cannot come in: exact stopping
            size *= 4
        out.append((at, score))
    return out


def meeting(q: np.ndarray, q_table: np.ndarray, x: np.ndarray, x_table: np.ndarray, ids: np.ndarray, skip: np.ndarray, k: int, scale: int) -> list[list[tuple[int, int]]]:
    """The k best (score, position) of each query in a block: by the pivots among small vectors, in whole numbers where a large one is met."""
    fine, plain = small(x, scale), small(q, scale)
    where = np.flatnonzero(fine)
    place = np.full(len(x) + 1, -1)
    place[where] = np.arange(len(where))
    got = search(q[plain] * scale, q_table[plain], x[where] * scale, x_table[where], ids[where], place[skip[plain]], k)
    out: list[list[tuple[int, int]]] = [[] for _ in q]
    for i, (at, score) in zip(np.flatnonzero(plain), got):
        out[i] = [(int(s), int(j)) for s, j in zip(score, where[at])]
    if plain.all() and fine.all():
        return out
    rows = {j: exact(x[j], scale) for j in (range(len(x)) if not plain.all() else np.flatnonzero(~fine).tolist())}
    for i in range(len(q)):
        mine = exact(q[i], scale)
        more = [(sum(a * b for a, b in zip(mine, row)), j) for j, row in rows.items() if j != skip[i] and not (plain[i] and fine[j])]
        out[i] = sorted(out[i] + more, key=lambda f: (-f[0], ids[f[1]]))[:k]
    return out


def top_k(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 20, pivots: int = 24, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of df that is_query holds for, against all other rows."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("vec_id"), quantised(vector, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = materialise(rows.where("vec_id is not null and v is not null").withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(max(1, n // SAMPLE))) == 0).select("v").limit(4 * SAMPLE)
    sample = matrix([r.v for r in some.collect()], dim)
    pivot = choose_pivots(sample[small(sample, scale)] * scale, pivots).tolist()
    n_blocks, n_pivots = -(-n // BLOCK), len(pivot)
    block = "block long, q_block long, ids binary, q binary, x binary, pivots binary"
    schema = pa.schema([("block", pa.int64()), ("q_block", pa.int64()), *((c, pa.binary()) for c in ("ids", "q", "x", "pivots"))])

    def build(t: pa.Table) -> pa.Table:
        p, x = np.array(pivot).reshape(-1, dim), matrix(t["v"].to_pylist(), dim)
        fine = small(x, scale)
        distances = np.zeros((len(x), len(p)))
        distances[fine] = table(x[fine] * scale, p)
        cells = [t["vec_id"].to_numpy().tobytes(), np.array(t["q"].to_pylist(), bool).tobytes(), x.tobytes(), distances.tobytes()]
        return pa.table([[t["block"][0].as_py()], [-1], *([c] for c in cells)], schema=schema)

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("long"))
    blocks = materialise(dealt.groupBy("block").applyInArrow(build, block), "vector-blocks")

    def unpack(r: dict) -> tuple:
        m = len(r["ids"]) // 8
        return np.frombuffer(r["ids"], np.int64), r["q"], np.frombuffer(r["x"]).reshape(m, dim), np.frombuffer(r["pivots"]).reshape(m, n_pivots)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            ids, q, x, tab = unpack(r)
            at = np.flatnonzero(np.frombuffer(q, bool))
            for lo in range(0, len(at), QUERY_BLOCK):
                a = at[lo : lo + QUERY_BLOCK]
                cells = [[r["block"]], [r["block"]], *([c.tobytes()] for c in (ids[a], a, x[a], tab[a]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, schema.types)], schema=schema)

    # a block of candidates leads its task (several, where there are few blocks); the chunks of queries go to every block and stream past
    parts = max(1, -(-2 * spark.sparkContext.defaultParallelism // n_blocks))
    tasks = n_blocks * parts * (3 if n_blocks * parts < 1000 else 1)  # few keys: so that seldom two share a task
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>"))
    queries = blocks.mapInArrow(ask, block).withColumn("block", every).withColumn("part", F.pmod(F.xxhash64("ids", "q"), F.lit(parts)))
    lead = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for r in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            if r["q_block"] < 0:
                here, (ids, _, x, tab) = r["block"], unpack(r)
                continue
            q_ids, at, q, q_tab = unpack(r)
            at = np.frombuffer(at, np.int64)
            own = np.where(here == r["q_block"], at, -1)
            out = []
            for i, best in enumerate(meeting(q, q_tab, x, tab, ids, own, k, scale)):
                for score, j in best:
                    over = (score >= 1 << 63) - (score < -1 << 63)
                    out.append((int(q_ids[i]), r["q_block"] << 32 | int(at[i]), int(ids[j]), over, 0 if over else score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FOUND.types)], schema=_FOUND)

    found = lead.unionByName(queries).repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "q_block").mapInArrow(meet, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_row", "query_id").orderBy(F.desc("over"), F.desc("score"), "vec_id"))
    fits = F.when(F.col("over") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score does not fit a long")).cast("long"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", fits.alias("score"))


def op10_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of each vector whose id is divisible by 20."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)
