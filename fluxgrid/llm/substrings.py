"""Operator 5: removal of long repeated word sequences by recompression.

Recompression replaces, level by level, first every maximal run of one symbol
(of any length) and then every pair of adjacent symbols (a left one and a right
one; a hash of a symbol's name and of the level says which it is) by one symbol.
A symbol's name is a 64-bit hash of its parts' names: equal word sequences get
equal names in every task, so a level needs no dictionary and no exchange; what
the Spark rounds below settle over the whole table is which names are shared.

In a window, the first and the last run of a level may go on outside it, and so
may a pair at its first or last symbol: these few are popped, level by level.
What is left inside are whole symbols, the same ones wherever the window's words
stand. So a window is, whatever surrounds it, the sequence of its pops and of its
interior symbols; the name of that sequence is the window's own symbol. Its core is
the longest interior symbol (of several, by hash); a window that pops leave
nothing of (within a run, say) is its own core.

1. `parse`: one pass; each text's cores (about one to fifteen words), word count, digests.
2. First round: cores that occur twice or more, by an aggregation, joined back
   (a join that adaptive execution can split on hot cores). Exact copies of a
   text are represented by one of them: all their windows are repeated.
3. Second round: texts with shared cores emit the symbols of the windows at
   those cores, packed by core; each map chunk combines first, so that a passage
   that a third of all texts hold is one entry a chunk. Windows whose symbol occurs
   twice are repeated: symbols name all of a window's words, so this verifies.
4. Words covered by a repeated window are removed.

Windows are judged on the input. Null texts have no words; texts of fewer than
W words lose none. Very long texts are parsed whole, each alone in its chunk. Null
and repeated ids are rows like others (a text that occurs in two rows repeats).
An empty table gives no row. Columns other than key and text are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm.shared import map_arrow, materialise, text_chunks
from fluxgrid.llm.textops import Words, mix, powers, words

WINDOW = 35
U = np.uint64
_NAME = (U(0x8CB92BA72F3D8DD7), U(0xF1357AEA2E62A9C5))
_PARSED = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("seq", pa.int64()), ("kept_sha256", pa.string()), ("anchors", pa.list_(pa.int64()))])


def levels_for(window: int) -> int:
    """Levels after which a window of so many words still holds about four symbols: one less three pops, of which 72 % stay, a level."""
    if window < 1:
        raise ValueError("a window has a word at least")
    levels, left = 0, (window - 3) * 0.72
    while left >= 4:
        levels, left = levels + 1, (left - 3) * 0.72
    return levels


@dataclass
class Symbols:
    """Symbols of a level: name, first and past-the-end word, text."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def name_runs(s: Symbols, level: int) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """The symbols with every maximal run as one, the run of each symbol, and the bounds of the runs (one more than runs)."""
    new = np.ones(len(s.name), bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | (s.doc[1:] != s.doc[:-1])
    at = np.flatnonzero(new)
    bounds = np.append(at, len(new))
    size, name = np.diff(bounds), s.name[at]
    many = size > 1
    name[many] = mix(name[many] * _NAME[0] + size[many].astype(U) * _NAME[1] + U(2 * level + 1))
    return Symbols(name, s.start[at], s.end[bounds[1:] - 1], s.doc[at]), np.cumsum(new) - 1, bounds


def is_left(name: np.ndarray, level: int) -> np.ndarray:
    return (mix(name ^ U(0xABC98388FB8FAC03 + level)) & U(1)).astype(bool)


def name_pairs(s: Symbols, left: np.ndarray, level: int) -> tuple[Symbols, np.ndarray]:
    """The symbols with every left and right one that meet as one, and the new symbol of each."""
    first = np.zeros(len(left), bool)
    first[:-1] = left[:-1] & ~left[1:] & (s.doc[:-1] == s.doc[1:])
    name, end, at = s.name.copy(), s.end.copy(), np.flatnonzero(first)
    name[at] = mix(name[at] * _NAME[0] + name[at + 1] * _NAME[1] + U(2 * level + 2))
    end[at] = end[at + 1]
    keep = np.ones(len(left), bool)
    keep[at + 1] = False
    return Symbols(name[keep], s.start[keep], end[keep], s.doc[keep]), np.cumsum(keep) - 1


def _pop(h: np.ndarray, name: np.ndarray, many: np.ndarray | int, kind: int) -> np.ndarray:
    """What a side has popped, with `many` symbols of a name more; kind tells runs from halves of pairs."""
    return mix(h * U(0xD1342543DE82EF95) + name * _NAME[kind] + np.asarray(many).astype(U))


def cores(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol of each window, its first word, its core) and (name, text) of everything that may be a core."""
    at = np.arange(len(w.hash))
    s, n = Symbols(w.hash, at, at + 1, w.doc), len(w.hash) - window + 1
    p = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
    if not len(p):
        return np.zeros(0, U), p, np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
    lo, hi, before, after = p.copy(), p + window, np.zeros(len(p), U), np.zeros(len(p), U)
    for level in range(levels_for(window)):
        here = np.flatnonzero(lo < hi)
        runs, run, bounds = name_runs(s, level)
        a, b = lo[here], hi[here]
        cut = np.minimum(bounds[run[a] + 1], b)
        before[here] = _pop(before[here], s.name[a], cut - a, 0)
        here, a, b = here[cut < b], cut[cut < b], b[cut < b]
        lo[:], hi[:], done = 0, 0, len(here) == 0
        back = np.maximum(bounds[run[b - 1]], a)
        after[here] = _pop(after[here], s.name[b - 1], b - back, 0)
        ok = a < back
        here, a, b = here[ok], run[a[ok]], run[back[ok] - 1] + 1
        left = is_left(runs.name, level)
        out = ~left[a]  # a right symbol in front may belong to a pair with what is before it
        before[here[out]] = _pop(before[here[out]], runs.name[a[out]], 1, 1)
        a = a + out
        here, a, b = here[a < b], a[a < b], b[a < b]
        out = left[b - 1]
        after[here[out]] = _pop(after[here[out]], runs.name[b[out] - 1], 1, 1)
        b = b - out
        here, a, b = here[a < b], a[a < b], b[a < b]
        s, new = name_pairs(runs, left, level)
        lo[here], hi[here] = new[a], new[b - 1] + 1
        if done:
            break
    up, down = powers(len(s.name) + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum(s.name * up[: len(s.name)])])
    inside = mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(U))
    symbol = mix(before * _NAME[0] + after * _NAME[1] + inside)
    rank = ((s.end - s.start).clip(max=255).astype(U) << U(56)) | (mix(s.name) >> U(8))
    core, held = symbol.copy(), np.flatnonzero(lo < hi)
    if len(held):
        a, b, best = lo[held], hi[held], rank
        depth = np.floor(np.log2(b - a)).astype(np.int64)
        for k in range(int(depth.max()) + 1):  # best: the highest rank of 2**k symbols from each on
            mine = np.flatnonzero(depth == k)
            core[held[mine]] = np.maximum(best[a[mine]], best[b[mine] - (1 << k)])
            step = 1 << k
            best = np.maximum(best[: len(best) - step], best[step:]) if len(best) > step else best
    alone = np.flatnonzero(lo >= hi)
    return symbol, p, core, np.concatenate([rank, symbol[alone]]), np.concatenate([s.doc, w.doc[p[alone]]])


def _digest(w: Words) -> np.ndarray:
    """A 64-bit number of each text's word sequence."""
    first = np.cumsum(w.counts) - w.counts
    place = (np.arange(len(w.hash)) - np.repeat(first, w.counts)).astype(U)
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(w.hash + place * U(0x9E3779B97F4A7C15)))])
    return mix(total[first + w.counts] - total[first] + w.counts.astype(U)).view(np.int64)


def parse(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(id, n_words, seq, kept_sha256 of all words, anchors) of every row: the cores; one that may occur again in its text is listed twice."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, texts in text_chunks(batch.column(1)):
            w = words(texts)
            _, p, anchor, names, where = cores(w, window)
            of = mix(np.arange(len(texts), dtype=U) + U(1))
            chosen, at = np.unique(anchor ^ of[w.doc[p]], return_index=True)
            own = np.sort(names ^ of[where])
            many = np.searchsorted(own, chosen, "right") - np.searchsorted(own, chosen, "left")
            order = np.argsort(w.doc[p[at]], kind="stable")
            twice = np.repeat(order, np.minimum(many[order], 2))
            sizes = np.bincount(w.doc[p[at[twice]]], minlength=len(texts))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(anchor[at[twice]].view(np.int64)))
            sha = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(w.counts), pa.array(_digest(w)), pa.array(sha), lists], schema=_PARSED)

    return map_arrow(docs.select(F.col(key).cast("long").alias("id"), F.col(text)), run, "id long, n_words long, seq long, kept_sha256 string, anchors array<long>")


def repeated_windows(marked: DataFrame, window: int) -> DataFrame:
    """(seq, starts) from rows (seq, shared anchors, text): first words of repeated windows, packed as 32-bit numbers."""
    sent = pa.schema([("anchor", pa.int64()), ("known", pa.bool_()), ("seq", pa.int64()), ("starts", pa.binary()), ("hashes", pa.binary())])
    found = pa.schema([("seq", pa.int64()), ("starts", pa.binary())])

    def emit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, texts in text_chunks(batch.column(2)):
            seqs, shared = batch.column(0).slice(lo, len(texts)).to_numpy(), batch.column(1).slice(lo, len(texts))
            w = words(texts)
            h, p, anchor, _, _ = cores(w, window)
            of = mix(np.arange(len(texts), dtype=U) + U(1))
            sizes = pa.compute.list_value_length(shared).to_numpy()
            listed = shared.flatten().to_numpy().view(U) ^ np.repeat(of, sizes)
            good = (_digest(w) == seqs)[w.doc[p]] & np.isin(anchor ^ of[w.doc[p]], listed)
            h, p, anchor = h[good], p[good], anchor[good]
            if not len(h):
                continue
            _, first, inverse, many = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            asks = np.zeros(len(h), bool)
            asks[first] = True
            doc = w.doc[p]
            begin = np.cumsum(w.counts) - w.counts
            for known, keep in ((False, asks), (True, many[inverse] > 1)):
                at = np.flatnonzero(keep)
                if not len(at):
                    continue
                d, a = doc[at], anchor[at]
                cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | ((a[1:] != a[:-1]) & (not known))]))
                ends = np.append(cut[1:], len(at))
                starts = (p[at] - begin[d]).astype("<i4")
                cols = [a[cut].view(np.int64) if not known else seqs[d[cut]], [known] * len(cut), seqs[d[cut]], [starts[i:j].tobytes() for i, j in zip(cut, ends)], [b"" if known else h[at[i:j]].tobytes() for i, j in zip(cut, ends)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, sent.types)], schema=sent)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                sizes = [len(r[2]) // 8 for r in rows]
                h = np.frombuffer(b"".join(r[2] for r in rows), U)
                _, inverse, many = np.unique(h, return_inverse=True, return_counts=True)
                hit, cuts = many[inverse] > 1, np.cumsum([0, *sizes])
                out = [(r[0], np.frombuffer(r[1], "<i4")[hit[i:j]].tobytes()) for r, i, j in zip(rows, cuts, cuts[1:]) if hit[i:j].any()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), found.types)], schema=found)

        for batch in batches:
            known = batch.filter(batch.column(1))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(2), known.column(3)], schema=found)
            asks = batch.filter(pa.compute.invert(batch.column(1)))
            for anchor, seq, starts, hashes in zip(*(asks.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if anchor != here:
                    yield from flush()
                    here, rows = anchor, []
                rows.append((seq, starts, hashes))
        yield from flush()

    out = map_arrow(marked, emit, "anchor long, known boolean, seq long, starts binary, hashes binary")
    return out.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(meet, "seq long, starts binary")


def cut_text(text: bytes, starts: list[bytes], window: int) -> tuple[int, list[bytes]]:
    """(words removed, words kept) where windows begin at the packed starts."""
    parts = text.split()
    cover = np.zeros(len(parts) + 1, np.int64)
    at = np.unique(np.frombuffer(b"".join(starts), "<i4"))
    cover[at] += 1
    np.add.at(cover, at + window, -1)
    gone = np.cumsum(cover)[:-1] > 0
    return int(gone.sum()), [x for x, g in zip(parts, gone) if not g]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row."""
    parsed = materialise(parse(docs, key, text, window), "parsed")
    groups = parsed.where(F.col("n_words") >= window).groupBy("seq").agg(F.count("*").alias("rows"), F.min("id").alias("rep"))
    groups = materialise(groups, "sequences")
    lists = parsed.join(groups, "seq").where(F.col("id").eqNullSafe(F.col("rep"))).select("seq", F.explode("anchors").alias("anchor"))
    shared = lists.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    back = lists.join(shared, "anchor").groupBy("seq").agg(F.collect_set("anchor").alias("shared"))
    texts = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    named = back.join(groups.select("seq", "rep"), "seq")
    marked = texts.join(named, F.col("_id").eqNullSafe(F.col("rep"))).select("seq", "shared", "_text")
    hits = repeated_windows(marked, window).join(groups.where("rows = 1").select("seq", "rep"), "seq")
    hits = hits.groupBy("seq", "rep").agg(F.collect_list("starts").alias("starts"))
    schema = pa.schema([("seq", pa.int64()), ("n_removed", pa.int64()), ("sha", pa.string())])

    def clean(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, part in text_chunks(batch.column(2)):
            want = batch.column(0).slice(lo, len(part)).to_numpy()
            ok = np.flatnonzero(_digest(words(part)) == want)
            out = [cut_text(part[i], batch.column(1)[lo + i].as_py(), window) for i in ok]
            sha = [hashlib.sha256(b" ".join(kept)).hexdigest() for _, kept in out]
            yield pa.RecordBatch.from_arrays([pa.array(want[ok]), pa.array([n for n, _ in out], pa.int64()), pa.array(sha, pa.string())], schema=schema)

    cut = texts.join(hits, F.col("_id").eqNullSafe(F.col("rep"))).select("seq", "starts", "_text")
    cut = map_arrow(cut, clean, "seq long, n_removed long, sha string")
    out = parsed.drop("anchors").join(groups.select("seq", "rows"), "seq", "left").join(cut, "seq", "left")
    copied = F.coalesce(F.col("rows") > 1, F.lit(False))
    removed = F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    sha = F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "kept_sha256"))
    return out.select("id", "n_words", removed.cast("long").alias("n_removed"), sha.alias("kept_sha256"))


def op5_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 35-word sequences that occur twice: doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
