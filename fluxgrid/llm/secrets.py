"""Operator 8: secret scans, in DataFrame functions only.

Base spans come from three patterns (assignment, access key, long hexadecimal
run). The method adds tokens of 20 or more key characters that a Markov model
of random strings explains better than one of ordinary identifiers: the mean
log-likelihood ratio of their character pairs exceeds a threshold.

Both models are trained here from labelled samples. Random strings (label 1)
are digests of a number sequence written in six alphabets, at lengths from 20
to 64. Ordinary identifiers (label 0) are made of the words of a bounded hash
sample of documents and of common words of programs: snake, camel, Pascal,
constant and kebab case, paths, joined words, with and without numbers; beside
them long numbers, dates and rules of one or two signs. A pair's probability is
smoothed towards that of its second character. A quarter of the samples, whole
words apart, is held out: the threshold is the score that a share ``FALSE`` of the
held-out identifiers exceeds, and precision and recall there are part of the model.

One narrow pass without shuffle; the model is a literal of 67 * 67 numbers.
A text without a pattern's fixed part skips that pattern. Offsets are code
points, ends exclusive. Null texts count as empty: no spans. Null or repeated
ids are rows like others (the sample is dealt by id and text); very long texts
are scanned whole; an empty table trains on the common words alone. Other
columns pass through `redact` and `scan` untouched; `scan` adds base_spans and all_spans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm.shared import materialise

# fixed values
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
COMMON = (
    "access account action active adapter address admin agent alert alias align amount api app archive array async attribute auth "
    "backup base batch binary block body boolean border branch bucket buffer build button byte cache call cancel card category "
    "chain change channel char check child class clean client close cluster code collection color column command comment commit "
    "component config connection constant container content context control convert copy count create cursor custom customer data "
    "date debug default delete description detail device dialog dict directory disable display dist document domain download driver "
    "dynamic edit element email enable encode end engine entity entry env error event example exception exec export factory field "
    "file filter find first flag folder font form format frame function get global graph group handler hash header height help home "
    "host html http icon id image import index info init input insert instance int interface item job json key label lib limit line "
    "link list load local lock log login main manager map mask max message method min mode model module name"
)
# end of fixed values

#: Share of held-out identifiers that may exceed the threshold.
FALSE = 0.0005
#: Weight of a character's own frequency beside its pairs, in pairs.
PRIOR = 40.0
#: Documents whose words train the model of identifiers, about; words taken from one document, at even steps through it, less than twice so many.
SAMPLE_DOCS, SAMPLE_WORDS = 300, 300
#: Random strings and rows of common words in the samples.
RANDOM, PLAIN = 12_000, 12_000
_SPAN = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio of each pair of ALPHABET, row by row, the threshold and its precision and recall on held-out samples."""

    table: tuple[float, ...]
    threshold: float
    precision: float
    recall: float


def _found(text: Column, pattern: str, kind: int, value: int, least: int) -> Column:
    """Spans of a pattern's matches whose group `value` has at least `least` characters: pieces between matches give the offsets."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(match))
    group = match if value == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    rows = F.arrays_zip(between.alias("p"), match.alias("m"), group.alias("v"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["p"])
        end = start + F.length(x["m"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("pos"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(_SPAN).alias("out"))
    return F.aggregate(rows, zero, step, lambda acc: acc["out"])


def _none() -> Column:
    return F.array().cast(_SPAN)


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start, then kind as listed."""
    low = F.lower(text)
    clue = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    parts = [
        F.when(clue, _found(text, ASSIGN, 0, 2, 12)).otherwise(_none()),
        F.when(F.contains(text, F.lit("AKIA")), _found(text, ACCESS, 1, 0, 18)).otherwise(_none()),
        F.when(F.rlike(text, F.lit("[0-9a-f]{16}")), _found(text, HEX, 2, 0, 16)).otherwise(_none()),
    ]
    return F.array_sort(F.concat(*parts))


def random_strings(spark: SparkSession, n: int = RANDOM) -> DataFrame:
    """(t, held): n random strings in six alphabets: hexadecimal of either case, base 64 of either kind, letters and digits, capitals and digits."""
    digest = F.sha2(F.col("id").cast("string"), 512)
    wide = F.regexp_replace(F.base64(F.unhex(digest)), "[=\\s]", "")
    plain = F.translate(wide, "+/", "")
    forms = [digest, F.upper(digest), wide, F.translate(wide, "+/", "-_"), plain, F.upper(plain)]
    length = (F.lit(20) + F.pmod(F.xxhash64("id"), F.lit(45))).cast("int")
    picked = F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int"))
    return spark.range(n).select(F.substr(picked, F.lit(1), length).alias("t"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0).alias("held"))


def identifiers(words: DataFrame) -> DataFrame:
    """(t, held): ordinary identifiers of each row's word `w` (lower case) and two common words that a hash of it chooses; whole words are held out."""
    common = F.split(F.lit(COMMON), " ")
    n, h = len(COMMON.split()), F.xxhash64("w", "i")
    pick = lambda k: F.element_at(common, (F.pmod(F.xxhash64("w", "i", F.lit(k)), F.lit(n)) + 1).cast("int"))
    rows = words.select("w", pick(1).alias("a"), pick(2).alias("b"), pick(3).alias("c"), F.pmod(h, F.lit(100)).cast("string").alias("d"), F.pmod(h, F.lit(16)).alias("form"), F.pmod(F.xxhash64("w", F.lit(7)), F.lit(4)) == 0)
    rows = rows.toDF("w", "a", "b", "c", "d", "form", "held")
    parts = [F.col(x) for x in "awbc"]
    title = [F.initcap(x) for x in parts]
    snake, joined = F.concat_ws("_", *parts), F.concat(*parts)
    camel = F.concat(parts[0], *title[1:])
    path = F.concat(F.lit("/"), F.concat_ws("/", *parts))
    forms = [
        snake, F.upper(snake), F.concat(*title), camel, F.concat_ws("-", *parts), path, joined, F.concat(F.col("w"), F.lit("/"), camel, F.lit("/"), F.col("b"), F.col("d")),
        F.concat_ws("_", snake, "d"), F.concat(camel, F.col("d")), F.concat_ws("/", F.lit(""), "a", "w", F.concat("b", "d"), F.concat_ws("-", "c", "a")), F.concat(F.upper("w"), F.lit("_"), F.upper("a"), F.lit("_"), F.col("d")),
        F.concat_ws("_", F.initcap("w"), title[0], title[2]), F.concat(F.lit("--"), F.concat_ws("-", *parts), F.lit("="), F.col("d")), F.concat(snake, F.lit("="), camel), F.concat_ws("-", *title),
    ]
    return rows.select(F.element_at(F.array(*forms), (F.col("form") + 1).cast("int")).alias("t"), "held")


def signs_and_numbers(spark: SparkSession, n: int = 6000) -> DataFrame:
    """(t, held): rules of one or two signs, long numbers and dates."""
    kind = F.lit("-=_/+")
    one = F.substr(kind, (F.col("id") % 5 + 1).cast("int"), F.lit(1))
    two = F.substr(kind, (F.pmod(F.floor(F.col("id") / 5), F.lit(5)) + 1).cast("int"), F.lit(1))
    number = F.substr(F.regexp_replace(F.sha2(F.col("id").cast("string"), 512), "[a-f]", ""), F.lit(1), F.lit(24))
    stamp = F.concat_ws("-", F.lpad((1990 + F.col("id") % 40).cast("string"), 4, "0"), F.lpad((1 + F.col("id") % 12).cast("string"), 2, "0"), F.lpad((1 + F.col("id") % 28).cast("string"), 2, "0"), F.substr(number, F.lit(1), F.lit(10)))
    forms = [F.repeat(one, F.lit(24)), F.repeat(F.concat(one, two), F.lit(12)), F.concat(one, F.repeat(two, F.lit(20)), one), number, stamp, F.concat(F.repeat(one, F.lit(10)), F.substr(number, F.lit(1), F.lit(4)), F.repeat(two, F.lit(10)))]
    return spark.range(n).select(F.element_at(F.array(*forms), F.pmod(F.xxhash64("id"), F.lit(len(forms))).cast("int") + 1).alias("t"), (F.col("id") % 4 == 0).alias("held"))


def samples(docs: DataFrame, text: str, key: str, sample: int = SAMPLE_DOCS) -> DataFrame:
    """(t, held, label): the labelled samples; at most about 2 * sample * SAMPLE_WORDS + RANDOM + PLAIN rows, whatever the corpus."""
    spark = docs.sparkSession
    n = docs.count()
    part = docs.where(F.pmod(F.xxhash64(key, text), F.lit(max(1, n // sample))) == 0) if n > sample else docs
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?<![^\s])([A-Za-z]{2,30})(?=[\s.,;:!?]|$)"), F.lit(1))
    part = part.select(found.alias("found")).withColumn("step", F.greatest(F.lit(1), F.floor(F.size("found") / SAMPLE_WORDS)))
    words = part.select("step", F.posexplode("found").alias("i", "w")).where("i % step = 0").select(F.lower("w").alias("w"), F.col("i").cast("long"))
    common = F.split(F.lit(COMMON), " ")
    plain = spark.range(PLAIN).select(F.element_at(common, (F.col("id") % len(COMMON.split()) + 1).cast("int")).alias("w"), F.col("id").alias("i"))
    ordinary = identifiers(words.unionByName(plain)).unionByName(signs_and_numbers(spark)).withColumn("label", F.lit(0))
    return ordinary.unionByName(random_strings(spark).withColumn("label", F.lit(1))).where(F.length("t") > 1)


def train(docs: DataFrame, text: str, key: str, sample: int = SAMPLE_DOCS) -> Model:
    """The model, from the samples that are not held out; its threshold, precision and recall, from those that are."""
    both = materialise(samples(docs, text, key, sample), "secret-samples")
    pair = F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substr(F.col("t"), i, F.lit(2)))
    counts = both.where("not held").select("label", F.explode(pair).alias("ab")).groupBy("label", "ab").count()
    got = {(r["label"], r["ab"]): r["count"] for r in counts.collect()}  # at most two numbers a pair of characters
    logs = []
    for k in (0, 1):
        seen = [sum(got.get((k, a + b), 0) for a in ALPHABET) for b in ALPHABET]
        own = [(c + 1) / (sum(seen) + len(ALPHABET)) for c in seen]
        for a in ALPHABET:
            row = [got.get((k, a + b), 0) for b in ALPHABET]
            logs.append([math.log((c + PRIOR * p) / (sum(row) + PRIOR)) for c, p in zip(row, own)])
    size = len(ALPHABET)
    table = tuple(round(logs[size + i][j] - logs[i][j], 6) for i in range(size) for j in range(size))
    rated = both.where(F.col("held") & F.rlike("t", F.lit(f"^{TOKEN}$"))).select("label", ratio(F.col("t"), literal(table)).alias("s"))
    rated = materialise(rated, "secret-held-out")
    at = rated.where("label = 0").agg(F.percentile("s", F.lit(1 - FALSE))).first()[0]
    above = {r["label"]: (r["n"], r["hit"]) for r in rated.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("s") > F.lit(at)).alias("hit")).collect()}
    false, true = above[0][1], above[1][1]
    return Model(table, at, true / max(1, true + false), true / max(1, above[1][0]))


def literal(table: tuple[float, ...]) -> Column:
    return F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")


def ratio(token: Column, model: Column) -> Column:
    """Mean log-likelihood ratio of a token's character pairs."""
    at = lambda i: F.instr(F.lit(ALPHABET), F.substr(token, i, F.lit(1)))
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(model, (at(i) - 1) * len(ALPHABET) + at(i + 1)))
    return total / (F.length(token) - 1)


def scan(docs: DataFrame, text: str, model: Model, threshold: float | None = None) -> DataFrame:
    """docs with columns base_spans and all_spans, arrays of (start, kind, end)."""
    body = F.coalesce(F.col(text), F.lit(""))
    table, threshold = literal(model.table), model.threshold if threshold is None else threshold
    tokens = F.when(F.rlike(body, F.lit(TOKEN)), _found(body, TOKEN, 3, 0, 20)).otherwise(_none())
    out = docs.withColumn("base_spans", base_spans(body)).withColumn("_tokens", tokens)
    apart = lambda t: ~F.exists("base_spans", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    random = lambda t: ratio(F.substr(body, t["start"] + 1, t["end"] - t["start"]), table) > threshold
    added = F.when(F.size("_tokens") > 0, F.filter("_tokens", lambda t: apart(t) & random(t))).otherwise(_none())
    return out.withColumn("all_spans", F.array_sort(F.concat("base_spans", added))).drop("_tokens")


def written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str, model: Model, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span's characters replaced by `mark`; overlapping spans give one mark."""
    found = scan(docs, text, model)
    body = F.col(text)
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["pos"]
        upto = F.concat(acc["out"], F.substr(body, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mark))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(new, upto).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate("all_spans", zero, step, lambda acc: F.concat(acc["out"], F.substr(body, acc["pos"] + 1, F.length(body))))
    return found.withColumn(text, F.when(F.size("all_spans") > 0, whole).otherwise(body)).select(*docs.columns)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, "text", train(docs, "text", "doc_id"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written("base_spans"), 256).alias("base_sha256"), written("all_spans").alias("spans"))
