"""Operator 4: mixing sources to target weights by the cube method.

A source with target T and size N takes each of its documents floor(T/N) times
and once more with inclusion probability frac(T/N). Which documents get the
extra copy is decided by balanced sampling: the flight phase moves the
probabilities along the null space of the balance constraints (number of
documents, number of words) until all but two are 0 or 1, so both totals hold
exactly up to there; the landing phase decides those and a few more that waited
for it, by the best of all their roundings.

Scale: documents of one source are dealt to groups of about `block` by hash
(a hot source has many groups), each group's flight leaves at most three
undecided, and those go to the next, some hundred times smaller level until
one group per source is left, which lands at its own level, however many the
other sources need. Sources' targets are found in one
pass over the per-source totals (one row a source). Only ids and sizes are
shuffled. All choices follow from hashes of the rows, so reruns agree; only rows that repeat
wholly, more often than a block, are told apart by their place in the input.

Columns named size, source_size, target or copies are replaced; other columns
pass through. Null sources form a source of their own, last in order. Null or empty texts
have size 0 and are never taken. Null and repeated ids are rows like others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrid.llm.shared import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of a source that wait for the landing phase, beside the flight's last two.
LANDING = 14


def word_count(text: str):
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    target = min(most * source_size, level * weight), with the level at which targets sum to share * total: the fixed
    point of resharing the excess of capped sources by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", "n_docs", weight.alias("w"))
    ends = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    per = per.withColumn("cap", most * F.col("source_size"))
    total = F.sum("source_size").over(Window.partitionBy())
    capped = F.coalesce(F.sum("cap").over(ends.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_w = F.sum("w").over(ends.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (share * total - capped) / open_w)
    # the level is that of the first source, in order of cap / w, that stays below its cap; of equals, the higher one
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("o"), (-F.col("level")).alias("less")))).over(Window.partitionBy())
    return per.withColumn("at", level).select("source", "source_size", "n_docs", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", -F.col("at.less") * F.col("w"))).alias("target"))


def null_vector(rows: np.ndarray) -> np.ndarray:
    """Weights of k + 1 rows of k numbers that sum to 0 in each column: for two columns the cross product of them."""
    if rows.shape == (3, 2):
        (a, b, c), (d, e, f) = rows[:, 0], rows[:, 1]
        v = np.array([b * f - c * e, c * d - a * f, a * e - b * d])
        most = np.abs(v).max()
        if most > 1e-9 * np.abs(rows[:, 0]).max() * np.abs(rows[:, 1]).max():
            return v / most
    return np.linalg.svd(rows.T)[2][-1]


def flight(p: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Moves probabilities p until at most x.shape[1] stay fractional, keeping the sums of p and of p * x's columns.

    Walks over the rows with a window of x.shape[1] + 1 undecided ones: a null vector of their constraint matrix is
    followed to the boundary, in the direction that u (uniform numbers, one a row) chooses so that expectations hold.
    """
    p, k, eps = p.copy(), x.shape[1], 1e-9
    window: list[int] = []
    for i in range(len(p)):
        if not eps < p[i] < 1 - eps:
            continue
        window.append(i)
        while len(window) > k:
            v = null_vector(x[window])
            up = down = np.inf
            for j, vj in zip(window, v):
                if vj > 1e-12:
                    up, down = min(up, (1 - p[j]) / vj), min(down, p[j] / vj)
                elif vj < -1e-12:
                    up, down = min(up, -p[j] / vj), min(down, -(1 - p[j]) / vj)
            step = up if u[i] * (up + down) < down else -down
            p[window] = np.clip(p[window] + step * v, 0.0, 1.0)
            window = [j for j in window if eps < p[j] < 1 - eps]
    return np.where(p <= eps, 0.0, np.where(p >= 1 - eps, 1.0, p))


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decides the few fractional rows: of all choices of copies, the one nearest to p in words, then in documents."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left) > LANDING + 2:
        raise ValueError("landing is for a few rows")
    choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    words, docs = np.abs(choices @ size[left] - p[left] @ size[left]), np.abs(choices.sum(1) - p[left].sum())
    p[left] = choices[np.lexsort((docs, words))[0]]
    return p


def mix(df: DataFrame, source: str, size, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 2048) -> DataFrame:
    """df with columns size, source_size, target and copies (how often the mix takes the row). size: a column expression."""
    own = [c for c in df.columns if c not in ("size", "source_size", "target", "copies")]
    rows = materialise(df.select(*own, size.alias("size")).withColumn("__mix_row", F.monotonically_increasing_id()), "mix-rows")
    per = materialise(source_targets(rows.select(F.col(source).alias("source"), "size"), weights, share, most), "mix-targets")
    groups = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block)).cast("long")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    narrow = per.select(F.col("source").alias("__mix_s"), "source_size", "target", groups.alias("__mix_groups"), ratio.alias("__mix_ratio"))
    state = rows.join(narrow, F.col(source).eqNullSafe(F.col("__mix_s")), "left").drop("__mix_s")
    draw = F.xxhash64(*[F.col(c) for c in own], "size")
    state = state.withColumn("__mix_whole", F.floor(F.col("__mix_ratio") + 1e-12).cast("long")).withColumn("__mix_h", draw)
    hot = state.groupBy("__mix_h").agg(F.count("*").alias("__mix_n")).where(F.col("__mix_n") > block).select(F.col("__mix_h").alias("__mix_hot"))
    state = state.join(hot, F.col("__mix_h") == F.col("__mix_hot"), "left")  # rows that repeat more than a block are dealt by their place
    salted = F.when(F.col("__mix_hot").isNotNull(), F.xxhash64("__mix_h", "__mix_row")).otherwise(F.col("__mix_h"))
    state = state.withColumn("__mix_h", salted).drop("__mix_hot", "__mix_row")
    state = state.withColumn("__mix_p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("__mix_ratio") - F.col("__mix_whole"))).otherwise(F.lit(0.0)))
    done, level = [], 0
    while True:
        last = state.agg(F.max("__mix_groups")).first()[0] in (None, 1)
        state = materialise(_fly(state, source, level), f"mix-{level}")
        decided = F.col("__mix_p").isin(0.0, 1.0)
        done.append(state if last else state.where(decided))
        if last:
            break
        state = state.where(~decided).withColumn("__mix_groups", F.ceil(F.col("__mix_groups") * 3 / block).cast("long"))
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    copies = F.when(F.col("size") > 0, F.col("__mix_whole") + F.col("__mix_p").cast("long")).otherwise(F.lit(0)).cast("long")
    return out.select(*own, "size", "source_size", "target", copies.alias("copies"))


def _fly(state: DataFrame, source: str, level: int) -> DataFrame:
    """One level: flight in every group of rows, and landing where it is its source's only one."""
    schema = state.schema

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("__mix_h", "ascending"), ("size", "ascending")])
        size, h, p = t["size"].to_numpy().astype(float), t["__mix_h"].to_numpy(), t["__mix_p"].to_numpy().copy()
        x = np.stack([np.ones(len(p)), size / max(1.0, size.mean())], 1)
        u = ((h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * level)) >> np.uint64(11)) / float(1 << 53)
        if t["__mix_groups"][0].as_py() == 1:  # the largest rows and some others wait for the landing, which needs room to choose
            wait = np.flatnonzero((p > 0) & (p < 1))
            large = wait[np.argsort(-size[wait], kind="stable")[: LANDING // 2]]
            wait = np.union1d(large, np.setdiff1d(wait, large)[: LANDING - len(large)])
            held, p[wait] = p[wait], 0.0
            p = flight(p, x, u)
            p[wait] = held
            p = land(p, size)
        else:
            p = flight(p, x, u)
        at = t.schema.get_field_index("__mix_p")
        return t.set_column(at, t.schema.field(at), pa.array(p)).drop(["__mix_g"])

    grouped = state.withColumn("__mix_g", F.pmod(F.xxhash64("__mix_h", F.lit(level)), F.col("__mix_groups")))
    return grouped.groupBy(source, "__mix_g").applyInArrow(run, schema)


def op4_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1: doc_id, size, source_size, target, taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", word_count("text").alias("n_words"))
    return mix(sized, "source", F.col("n_words")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
