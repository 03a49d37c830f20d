"""Operator 7: quality rules as a short-circuit cascade.

A rule is a predicate over one text's measures; a text is kept if no rule
rejects it. Cost (seconds a text) and selectivity (share rejected) of each rule
are estimated on a hash sample of about ``SAMPLE`` texts, run on the executors;
rules then run in order of rejections per cost, each only on the texts that
the earlier ones left. The order changes what is computed, never the verdict.

Everything is one pass over the texts without a shuffle. Null and empty texts
have no words and fail. Null or repeated ids are rows like others; other
columns pass through `filter_quality` untouched.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm import textops
from fluxgrid.llm.shared import map_arrow, text_chunks

#: Texts that the cascade's order is estimated on, about.
SAMPLE = 1000
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"#*$%&|<>")] = True
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


class Texts:
    """A chunk of texts with measures computed when first asked for."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.w, self._got = texts, textops.words(texts), {}

    def _once(self, name: str, f: Callable[[], np.ndarray]) -> np.ndarray:
        if name not in self._got:
            self._got[name] = f()
        return self._got[name]

    def _per_text(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        ends = np.append(self.w.doc_starts[1:], len(flags))
        return total[ends] - total[self.w.doc_starts]

    @property
    def n_words(self) -> np.ndarray:
        return self.w.counts

    @property
    def word_chars(self) -> np.ndarray:
        """Code points in words: bytes that are neither blank nor continue a character."""
        return self._once("word_chars", lambda: self._per_text(((self.w.buf & 0xC0) != 0x80) & ~textops._BLANK[self.w.buf]))

    @property
    def n_symbols(self) -> np.ndarray:
        return self._once("n_symbols", lambda: self._per_text(_SIGNS[self.w.buf]))

    @property
    def n_letters(self) -> np.ndarray:
        """Code points that are ASCII letters or beyond ASCII."""
        b = self.w.buf
        return self._once("n_letters", lambda: self._per_text((((b | 32) >= 97) & ((b | 32) <= 122)) & (b < 128) | (b >= 0xC0)))

    @property
    def n_wide(self) -> np.ndarray:
        """Code points of three or more bytes, as in scripts that are written without blanks."""
        return self._once("n_wide", lambda: self._per_text(self.w.buf >= 0xE0))

    @property
    def word_bytes(self) -> np.ndarray:
        return np.bincount(self.w.doc, self.w.ends - self.w.starts, len(self.texts)).astype(np.int64)

    @property
    def n_dup_lines(self) -> np.ndarray:
        def count() -> np.ndarray:
            out = np.zeros(len(self.texts), np.int64)
            for i, t in enumerate(self.texts):
                lines = t.split(b"\n")
                if len(lines) > 1:
                    lines = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
                    out[i] = len(lines) - len(set(lines))
            return out

        return self._once("n_dup_lines", count)

    @property
    def n_repeat_words(self) -> np.ndarray:
        """Words within 3-word windows that the text holds twice or more."""

        def count() -> np.ndarray:
            g, at = textops.windows(self.w.hash, self.w.doc, 3)
            cover = np.zeros(len(self.w.hash) + 1, np.int64)
            if len(g):
                key = textops.mix(g ^ (self.w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
                hit = at[n[inverse] > 1]
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + 3, -1)
            return np.bincount(self.w.doc, np.cumsum(cover)[:-1] > 0, len(self.texts)).astype(np.int64)

        return self._once("n_repeat_words", count)

    @property
    def longest_word(self) -> np.ndarray:
        out = np.zeros(len(self.texts), np.int64)
        np.maximum.at(out, self.w.doc, self.w.ends - self.w.starts)
        return out

    @property
    def distinct_words(self) -> np.ndarray:
        key = self.w.hash ^ (self.w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(key, return_index=True)
        return np.bincount(self.w.doc[first], minlength=len(self.texts))

    def take(self, at: np.ndarray) -> Texts:
        return Texts([self.texts[i] for i in at])


#: The two rules of the base verdict.
BASE_RULES: dict[str, Callable[[Texts], np.ndarray]] = {
    "few_words": lambda t: t.n_words < 50,
    "repeated_trigrams": lambda t: 100 * t.n_repeat_words > 50 * t.n_words,
}
#: All rules; True rejects. Thresholds are wide, so that ordinary prose stays, in scripts without blanks and beside one encoded blob too.
RULES: dict[str, Callable[[Texts], np.ndarray]] = BASE_RULES | {
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "word_length": lambda t: ((t.word_chars > 15 * t.n_words) & (2 * t.n_wide <= t.word_chars) & (2 * t.longest_word <= t.word_bytes)) | (t.word_chars < 2 * t.n_words),
    "few_letters": lambda t: 10 * t.n_letters < 6 * t.word_chars,
    "endless_word": lambda t: (t.longest_word > 1000) & (2 * t.longest_word > t.word_bytes) & (2 * t.n_wide <= t.word_chars),
    "few_distinct": lambda t: 20 * t.distinct_words < np.minimum(t.n_words, 2000),
}


def cascade(texts: Texts, order: list[str], rules: dict[str, Callable] = RULES, alive: np.ndarray | None = None) -> np.ndarray:
    """Whether each text passes; each rule sees only what the rules before it left."""
    kept = np.ones(len(texts.texts), bool) if alive is None else alive.copy()
    here, at = texts, np.arange(len(kept))
    for name in order:
        left = np.flatnonzero(kept[at])
        if not len(left):
            break
        if len(left) < 0.7 * len(at):  # fewer texts are worth a table of their own
            here, at = here.take(left), at[left]
            left = np.arange(len(at))
        kept[at[left]] &= ~np.asarray(rules[name](here), bool)[left]
    return kept


def plan(df: DataFrame, text: str, key: str, rules: dict[str, Callable] = RULES, sample: int = SAMPLE) -> list[str]:
    """Rule names by rejections per second, most first, measured on a hash sample of about `sample` rows."""
    n = df.count()
    part = df.select(F.col(text)) if n <= sample else df.where(F.pmod(F.xxhash64(key, text), F.lit(n // sample)) == 0).select(text)
    schema = pa.schema([("rule", pa.string()), ("s", pa.float64()), ("rejected", pa.int64()), ("n", pa.int64())])

    def measure(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for _, texts in text_chunks(batch.column(0)):
            for name, rule in rules.items():
                fresh = Texts(texts)
                began = time.perf_counter()
                out.append({"rule": name, "rejected": int(np.count_nonzero(rule(fresh))), "s": time.perf_counter() - began, "n": len(texts)})
        yield pa.RecordBatch.from_pylist(out, schema)

    found = map_arrow(part, measure, "rule string, s double, rejected long, n long").groupBy("rule").agg(F.sum("s").alias("s"), F.sum("rejected").alias("r")).collect()
    rate = {x["rule"]: x["r"] / max(x["s"], 1e-9) for x in found}  # one row a rule
    return sorted(rules, key=lambda r: (-rate.get(r, 0.0), r))


def quality(df: DataFrame, text: str, key: str, order: list[str] | None = None) -> DataFrame:
    """(key, the five measures, base_failed, kept) of every row."""
    order = order or plan(df, text, key)
    schema = pa.schema([("key", pa.int64()), *((c.split()[0], pa.int64()) for c in STATS.split(", ")), ("base_failed", pa.bool_()), ("kept", pa.bool_())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = batch.column(0)
        for lo, texts in text_chunks(batch.column(1)):
            t = Texts(texts)
            failed = BASE_RULES["few_words"](t) | BASE_RULES["repeated_trigrams"](t)
            kept = cascade(t, [r for r in order if r not in BASE_RULES], alive=~failed)
            cols = [t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept]
            yield pa.RecordBatch.from_arrays([keys.slice(lo, len(texts)), *map(pa.array, cols)], schema=schema)

    return map_arrow(df.select(F.col(key).cast("long").alias("key"), F.col(text)), run, f"key long, {STATS}, base_failed boolean, kept boolean")


def filter_quality(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of df that the cascade keeps, with all their columns: the verdict is computed beside the row, nothing is joined."""
    order = plan(df, text, key)
    at = df.columns.index(text)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kept = [cascade(Texts(texts), order) for _, texts in text_chunks(batch.column(at))]
        yield batch.filter(pa.array(np.concatenate(kept)))

    return df.mapInArrow(lambda batches: (x for b in batches if b.num_rows for x in run(b)), df.schema)


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", "doc_id").withColumnRenamed("key", "doc_id")
