"""Operator 6: language identification by bit-sliced n-gram filters.

One Bloom filter a language, stored bit-sliced: row i of the table holds, as a
bit mask, which languages have bit i set, so the AND of an n-gram's few rows is
the mask of all languages that contain it. A text's score for a language is
the number of its n-grams (with multiplicity) whose mask has the language's
bit, corrected for the rate p of false positives: (count - n p) / (1 - p). The
highest score decides, ties by name.

Learned from a bounded hash sample of labelled rows, about ``PER_LANGUAGE`` a
language: an n-gram (``GRAM`` bytes within lower-cased letters and blanks)
belongs to a language if its relative frequency there is at least ``SHARE`` of
its highest one, however rare it is and however many there are: Spark chooses
the n-grams and gathers the rows they set, so no language can push out another.
The table has a fixed number of rows, so its size does not grow with the corpus. Prediction is one pass over whole texts, no shuffle.

Null texts and texts without a letter (Unicode category L) get `und` and score
0. Without any labelled row every text gets `und`. Null or repeated ids are
rows like others, dealt to the sample by id and text. Texts are counted whole, a
very long one alone in its chunk. Bytes that are no UTF-8 count as a sign.
Columns other than key, text and language are not read, whatever their names;
`predict` returns the key, its extra columns, lang_pred and score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrid.llm.shared import map_arrow, materialise, text_chunks
from fluxgrid.llm.textops import mix

#: Labelled rows a language that the filters are learned from, about.
PER_LANGUAGE = 1000
GRAM = 5
SHARE = 0.5
#: Rows of the bit-sliced table, and rows that an n-gram sets.
BITS, HASHES = 1 << 21, 3
_CLASS = np.full(256, 0x20, np.uint8)
_CLASS[0x80:] = np.arange(0x80, 0x100)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of a chunk of texts as numbers, and the text of each; none spans two texts, none has a blank inside a word border twice."""
    lower = [t.decode(errors="replace").lower().encode() for t in texts]
    b = _CLASS[np.frombuffer(b"\n" + b"\n".join(lower) + b"\n" * GRAM, np.uint8)]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 0x20) | (b[:-1] != 0x20)
    sizes = np.fromiter((len(t) + 1 for t in lower), np.int64, len(lower))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    keep[bounds[:-1]] = True  # the blank in front of a text, whatever the text before ends with
    where = np.flatnonzero(keep)
    doc = np.searchsorted(bounds, where, "right") - 1
    b = b[where].astype(np.uint64)
    n = max(0, len(b) - GRAM + 1)
    g = np.zeros(n, np.uint64)
    for j in range(GRAM):
        g |= b[j : j + n] << np.uint64(8 * j)
    last = doc[GRAM - 1 :]
    ok = (doc[:n] == last[:n]) & (doc[:n] < len(texts))
    return g[ok], doc[:n][ok]


def has_letter(text: bytes) -> bool:
    """Whether a text holds a character of category L."""
    return any(map(str.isalpha, text.decode(errors="replace")))


def slots(g: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(g + np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) % np.uint64(bits)).astype(np.int64) for i in range(HASHES)]


class Filters:
    """The bit-sliced filters of all languages."""

    def __init__(self, languages: list[str], found: list[tuple[np.ndarray, np.ndarray]], bits: int = BITS):
        self.languages = languages
        self.table = np.zeros((bits, -(-len(languages) // 64)), np.uint64)
        for k, (g, _) in enumerate(found):
            for at in slots(g, bits):
                np.bitwise_or.at(self.table[:, k // 64], at, np.uint64(1 << (k % 64)))
        self._measure()

    def _measure(self) -> None:
        fill = [float(((self.table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) for k in range(len(self.languages))]
        self.false = np.array(fill) ** HASHES

    def add(self, cell: np.ndarray, mask: np.ndarray) -> None:
        """Sets bits: cell is the row of the table times its words a row, plus the word."""
        self.table.reshape(-1)[cell] |= mask
        self._measure()

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected number of n-grams of each language in each text, and the number of all n-grams."""
        g, doc = grams(texts)
        masks = reduce(np.bitwise_and, [self.table[at] for at in slots(g, len(self.table))]) if len(g) else np.zeros((0, self.table.shape[1]), np.uint64)
        total = np.bincount(doc, minlength=len(texts))
        hits = [np.bincount(doc, (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1), len(texts)) for k in range(len(self.languages))]
        raw = np.stack(hits, 1) if hits else np.zeros((len(texts), 0))
        return np.maximum((raw - total[:, None] * self.false) / np.maximum(1 - self.false, 1e-9), 0), total


def learn(rows: DataFrame, lang: str, text: str, draw: Column, per_language: int = PER_LANGUAGE, bits: int = BITS) -> Filters:
    """Filters from rows with a language and a text; draw: a hash column that deals the sample."""
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    per = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # one row a language
    rate = F.lit(0.0)
    for name, n in per.items():
        rate = F.when(F.col(lang) == name, F.lit(min(1.0, per_language / n))).otherwise(rate)
    part = rows.where(F.pmod(draw, F.lit(1 << 20)) < rate * (1 << 20)).select(lang, text)
    schema = pa.schema([("lang", pa.string()), ("g", pa.int64()), ("n", pa.int64())])

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = np.array(batch.column(0).to_pylist())
        for lo, texts in text_chunks(batch.column(1)):
            g, doc = grams(texts)
            of = names[lo : lo + len(texts)]
            for name in set(of):
                u, n = np.unique(g[(of == name)[doc]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(n)], schema=schema)

    names, words = sorted(per), -(-len(per) // 64)
    filters = Filters(names, [(np.zeros(0, np.uint64), np.zeros(0))] * len(names), bits)
    counted = materialise(map_arrow(part, count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")), "grams")
    total = {r[0]: r[1] for r in counted.groupBy("lang").agg(F.sum("n")).collect()}  # one row a language
    if not total:
        return filters
    of = F.element_at(F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, k)]), F.col("lang"))
    sizes = F.element_at(F.create_map(*[F.lit(x) for pair in total.items() for x in pair]), F.col("lang"))
    own = counted.select(of.alias("k"), "g", (F.col("n") / sizes).alias("f"))
    own = own.withColumn("most", F.max("f").over(Window.partitionBy("g"))).where(F.col("f") >= SHARE * F.col("most")).select("k", "g")
    marks = pa.schema([("cell", pa.int64()), ("mask", pa.int64())])

    def mark(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        k, g = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        cell = np.concatenate([at * words + k // 64 for at in slots(g, bits)])
        mask = np.tile(np.uint64(1) << (k % 64).astype(np.uint64), HASHES)
        order = np.argsort(cell, kind="stable")
        u, first = np.unique(cell[order], return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.bitwise_or.reduceat(mask[order], first).view(np.int64))], schema=marks)

    # at most one row a cell of the table, whatever the sample
    got = map_arrow(own, mark, "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask")).toPandas()
    filters.add(got["cell"].to_numpy(np.int64), got["mask"].to_numpy(np.int64).view(np.uint64))
    return filters


def predict(docs: DataFrame, key: str, text: str, filters: Filters, extra: dict[str, Column] | None = None) -> DataFrame:
    """(key, extra columns, lang_pred, score) of every row; score is the winner's share of the corrected counts."""
    extra = extra or {}
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # fixed size: BITS rows of one word for each 64 languages
    df = docs.select(F.col(key).cast("long").alias(key), *[c.alias(k) for k, c in extra.items()], F.col(text).alias("_text"))
    out = [(f.name, f.dataType.simpleString()) for f in df.schema.fields[:-1]] + [("lang_pred", "string"), ("score", "double")]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        f: Filters = shared.value
        texts = batch.column(batch.num_columns - 1)
        for lo, part in text_chunks(texts):
            counts, _ = f.counts(part)
            sums = counts.sum(1)
            best = counts.argmax(1) if counts.shape[1] else np.zeros(len(part), int)
            letters = list(map(has_letter, part))
            names, scores = [], []
            for i, has in enumerate(letters):
                named = has and len(f.languages) > 0
                names.append(f.languages[best[i]] if named else "und")
                scores.append(float(counts[i, best[i]] / sums[i]) if named and sums[i] > 0 else 0.0)
            cols = [batch.column(c).slice(lo, len(part)) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[n for n, _ in out])

    return map_arrow(df, run, ", ".join(f"`{n}` {t}" for n, t in out))


def op6_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents: doc_id, held_out, lang_pred, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    filters = learn(docs.where(~held), "lang", "text", F.xxhash64("doc_id", "text"))
    return predict(docs, "doc_id", "text", filters, {"held_out": held})
