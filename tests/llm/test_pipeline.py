"""Each stage of the corpus pipeline on its own input."""

import collections
import re
import struct
import zlib

import pytest
from test_llm import ASSIGN, components_of, words

import corpus_pipeline
from fluxgrid.llm import secrets, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def rows(df):
    return collections.Counter(map(tuple, df.collect()))


def rejected(text):
    """Every rule by its definition."""
    w = words(text)
    raw = (text or "").encode()
    tri = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    repeated = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    chars, size, longest = sum(map(len, w)), sum(len(x.encode()) for x in w), max((len(x.encode()) for x in w), default=0)
    letters, wide = sum(c.isascii() and c.isalpha() or b >= 0xC0 for c, b in ((chr(b), b) for b in raw)), sum(b >= 0xE0 for b in raw)
    spaced = 2 * wide <= chars
    return (
        len(w) < 50 or 100 * len(repeated) > 50 * len(w) or 10 * sum(c in "#*$%&|<>" for c in text or "") > len(w) or chars < 2 * len(w)
        or (chars > 15 * len(w) and spaced and 2 * longest <= size) or 10 * letters < 6 * chars or (longest > 1000 and 2 * longest > size and spaced)
        or 20 * len(set(w)) < min(len(w), 2000)
    )


def test_quality_stage(stages):
    want = collections.Counter(tuple(r) for r in stages[""].collect() if not rejected(r["text"]))
    assert rows(stages["quality_rules"]) == want and 0 < sum(want.values()) < stages[""].count()


def test_near_duplicate_stage(stages):
    before = stages["quality_rules"].collect()
    least = {c for _, c in components_of([(r["doc_id"], r["text"]) for r in before]).values()}
    assert rows(stages["near_duplicates"]) == collections.Counter(tuple(r) for r in before if r["doc_id"] in least)


def marked(text, model):
    """The text with every span of the three patterns and every token of a high mean ratio replaced."""
    spans = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 12] + [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18] + [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    base, letters = list(spans), secrets.ALPHABET
    for m in re.finditer(secrets.TOKEN, text):
        at = [letters.index(c) for c in m[0]]
        rate = sum(model.table[a * len(letters) + b] for a, b in zip(at, at[1:])) / (len(at) - 1)
        if rate > model.threshold and all(a >= m.end() or e <= m.start() for a, e in base):
            spans.append(m.span())
    out, pos = "", 0
    for a, e in sorted(spans):
        out += text[pos:a] + "[SECRET]" if a >= pos else ""
        pos = max(pos, e)
    return out + text[pos:]


def test_secret_stage(stages):
    docs = stages["near_duplicates"]
    model = secrets.train(docs, "text", "doc_id")
    want, changed = collections.Counter(), 0
    for r in docs.collect():
        new = marked(r["text"] or "", model)
        changed += new != r["text"]
        fields = r.asDict()
        if r["text"] is not None:
            fields |= {"text": new, "n_chars": len(new)}
        want[tuple(fields[c] for c in docs.columns)] += 1
    assert rows(stages["secret_scans"]) == want and changed


def test_mixing_stage(stages):
    before, after = rows(stages["secret_scans"]), rows(stages["source_mixing"])
    assert set(after) <= set(before) and max(after.values()) <= 2
    words = lambda c: sum(len((r[1] or "").split()) * n for r, n in c.items())
    assert abs(words(after) - 1.5 * words(before)) < 0.05 * words(before)


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    want = collections.Counter()
    for r in stages["source_mixing"].collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r["doc_id"], n, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    got, bins = stages["best_fit_packing"].collect(), collections.defaultdict(list)
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert len(bins) <= 1.01 * sum(n * k for (_, _, _, n, _), k in want.items()) / 1024 + 1


def test_stage_columns(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == stages[""].columns


def test_odd_rows_pass(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (4, "x y z", "en", "s", 5), (4, "x y z", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        for docs in (df, df.limit(0)):
            assert stage(spark, docs, SF).count() <= 10


def test_near_duplicates_without_own_ids(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    texts = [(None, a), (None, a), (None, a + " end"), (1, b), (None, b), (2, c), (5, c), (5, d), (4, d + " end"), (None, ""), (None, None), (None, None), (7, "one of a kind"), (7, "one of a kind")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, SF).collect())
    alone = [x for x in got.elements() if x[0] is None and x[1] and x[1].startswith("a0")]
    assert len(alone) == 1
    assert got - collections.Counter(alone) == collections.Counter([(1, b), (2, c), (4, d + " end"), (None, ""), (None, None), (None, None), (7, "one of a kind")])


def test_near_duplicates_of_repeated_ids(spark):
    x, y = (" ".join(f"{k}{i}" for i in range(60)) for k in "xy")
    df = spark.createDataFrame([(i, t, None, "s", k) for k, (i, t) in enumerate([(2, y), (4, x), (4, y), (4, y), (3, y)])], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, SF).collect())
    assert got == [(2, y), (4, x)]
