"""Operator 1: Jaccard join on word shingles by count-vector R-trees.

Two texts link when their sets of 5-word shingles have a Jaccard similarity of
at least 3/4, that is when 7 * overlap >= 3 * (n1 + n2). Shingles are hashed
into groups; a set's group counts are a point; the overlap of two sets is at
most the sum of the coordinate minima of their points, and the overlap of a set
with anything in an R-tree node at most that with the node's upper corner.
Nodes and points under the bound are cut, surviving pairs are verified on the sets.

Random texts of one size have much the same counts, so one tree over a corpus
would cut little. Trees are therefore built within shards that an exact filter
makes: of the shingles in hash order, linking sets of n shingles share at
least 1 + ceil(3n/4) // 8 among their first n // 4 + 1 + n // 8. Only sets with
so many shared prefix shingles take part (few do); the steps are

1. `sign`: size and a 64-bit digest of each set; equal digests are one class.
2. `shared_prefixes`: one shuffle of packed (shingle, class) pairs; each map batch
   combines first, so a shingle that a third of all texts hold is one entry a batch.
3. `merge`: classes sharded by their first shared shingle, large shards split
   by two different random cuts, link inside each part; this joins large groups
   of near copies without pairing all of them.
4. `complete`: classes of different components that share enough prefix shingles
   are compared, so that no link is lost. Shingles of at most ``COMMON`` classes give
   pairs, counted and bounded by their points. For a commoner shingle, the
   classes that could reach their number by such shingles alone meet in an R-tree
   (in blocks) for the rarest few of them, which hands on only pairs that the bound
   allows, each once; the others share rarer ones.
5. `components` over the verified links (never all pairs of a group).

Null ids are rows like others; a component's id is its smallest id that is
not null. Null or wordless texts have an empty set and link with nothing.
Repeated ids are rows like others. An empty table gives no row.
Columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrid.llm.shared import components, map_arrow, materialise, text_chunks
from fluxgrid.llm.textops import mix, shingle_sets

SHINGLE = 5
#: Groups that shingles are hashed into: the dimensions of the points.
GROUPS = 128
#: Classes in a part of a shard, about.
PART = 128
#: Classes that a shingle may have before it counts as common.
COMMON = 64
#: Classes in a block of a common shingle's tree, about.
BLOCK = 2048
U = np.uint64


def prefix_length(n):
    return n // 4 + 1 + n // 8


def least_shared(n: str) -> Column:
    """Prefix shingles that a set of n shingles shares with any set it links with, at least."""
    return F.expr(f"1 + ((3 * {n} + 3) div 4) div 8")


def digests(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set, 0 for empty ones."""
    n = np.diff(bounds)
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(g ^ U(0x5851F42D4C957F2D)))])
    return np.where(n > 0, mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(U)), U(0)).view(np.int64)


def sign(docs: DataFrame, key: str, text: str, size: int = SHINGLE) -> DataFrame:
    """(id, n, class) of every row; class is null where the set is empty."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("class", pa.int64())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, texts in text_chunks(batch.column(1)):
            g, bounds = shingle_sets(texts, size)
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(n), pa.array(digests(g, bounds), mask=n == 0)], schema=schema)

    return map_arrow(docs.select(F.col(key).cast("long").alias("id"), F.col(text)), run, "id long, n long, class long")


def _runs(token: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, whether each pair's token has several classes, and whether it is its token's first."""
    order = np.lexsort((cls, token))
    token, cls = token[order], cls[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
    token, cls = token[new], cls[new]
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    many = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1] > 1 if len(token) else first
    return token, cls, many, first


def _packed(x: np.ndarray) -> np.ndarray:
    """The low 6 bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def shared_prefixes(docs: DataFrame, text: str, size: int = SHINGLE) -> DataFrame:
    """(class, token) of every prefix shingle that several classes hold."""
    spark = docs.sparkSession
    buckets = min(1 << 16, max(1024, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    routed = "bucket int, known boolean, tokens binary, classes binary"
    schema = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("tokens", pa.binary()), ("classes", pa.binary())])

    def route(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens, classes = [], []
        for _, texts in text_chunks(batch.column(0)):
            g, bounds = shingle_sets(texts, size)
            n = np.diff(bounds)
            take = np.where(n > 0, prefix_length(n), 0)
            rank = np.arange(len(g)) - np.repeat(bounds[:-1], n)
            tokens.append(g[rank < np.repeat(take, n)])
            classes.append(np.repeat(digests(g, bounds), take))
        token, cls, many, first = _runs(np.concatenate(tokens), np.concatenate(classes))
        # what the batch knows to be shared is dealt evenly; of each shingle one class asks the others
        for known, at in ((True, np.flatnonzero(many)), (False, np.flatnonzero(first))):
            t, c = token[at], cls[at]
            b = (((t >> U(48)) * U(buckets)) >> U(16)).astype(np.int32) if not known else (mix(c.view(U)) % U(buckets)).astype(np.int32)
            order = np.argsort(b, kind="stable")
            b, t, c = b[order], t[order], c[order]
            cuts = np.flatnonzero(np.diff(b, prepend=-1))
            ends = np.append(cuts[1:], len(b))
            raw_t, raw_c = t.astype("<u8") if known else _packed(t), c
            rows = [(int(b[i]), known, raw_t[i:j].tobytes(), raw_c[i:j].tobytes()) for i, j in zip(cuts, ends)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), schema.types)], schema=schema)

    found = pa.schema([("class", pa.int64()), ("token", pa.int64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tokens, classes = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if tokens:
                token, cls, many, _ = _runs(np.concatenate(tokens), np.concatenate(classes))
                if many.any():
                    yield pa.RecordBatch.from_arrays([pa.array(cls[many]), pa.array(token[many].view(np.int64))], schema=found)

        for batch in batches:
            for bucket, known, t, c in zip(*(col.to_pylist() for col in batch.columns)):
                c = np.frombuffer(c, np.int64)
                if known:
                    low = np.frombuffer(t, "<u8")
                    yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(_named(low, buckets).view(np.int64))], schema=found)
                    continue
                if bucket != here:
                    yield from flush()
                    here, tokens, classes = bucket, [], []
                tokens.append(_unpacked(t) | (U(bucket) << U(48)))
                classes.append(c)
        yield from flush()

    sent = map_arrow(docs.select(F.col(text)), route, routed)
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "class long, token long")


def _named(token: np.ndarray, buckets: int) -> np.ndarray:
    """A shingle hash as the reducers name it: its low 48 bits and its bucket."""
    return (token & U((1 << 48) - 1)) | ((((token >> U(48)) * U(buckets)) >> U(16)) << U(48))


def point(s: np.ndarray) -> np.ndarray:
    """Group counts of a set of shingle hashes."""
    return np.bincount((s & U(GROUPS - 1)).astype(np.int64), minlength=GROUPS)


class Tree:
    """R-tree over count vectors, packed bottom-up; nodes keep their upper corner and their range of set sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = 8):
        slices = max(1, int(np.sqrt(len(points) / fan)))
        by_size = np.array_split(np.argsort(sizes, kind="stable"), slices)
        wide = points.var(0).argmax() if len(points) else 0
        self.order = np.concatenate([s[np.argsort(points[s, wide], kind="stable")] for s in by_size])
        self.fan, self.levels = fan, [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > fan:
            upper, low, high = self.levels[-1]
            at = np.arange(0, len(upper), fan)
            self.levels.append((np.maximum.reduceat(upper, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def query(self, point: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the points whose bound allows a link, and their bounds."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, low, high = (x[at] for x in self.levels[depth])
            bound = np.minimum(upper, point).sum(1)
            keep = (7 * bound >= 3 * (size + low)) & (4 * high >= 3 * size) & (4 * size >= 3 * low)
            at, bound = at[keep], bound[keep]
            if depth:
                at = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at], bound


def links(keys: np.ndarray, sets: list[np.ndarray], groups: np.ndarray) -> list[tuple[int, int]]:
    """Verified links that connect all that is connected, among classes whose `groups` differ (equal ones count as connected)."""
    sizes = np.array([len(s) for s in sets])
    points = np.stack([point(s) for s in sets])
    tree, label, out = Tree(points, sizes), np.unique(groups, return_inverse=True)[1], []
    for i in range(len(keys)):
        at, bound = tree.query(points[i], sizes[i])
        mine = at < i
        at = at[mine][np.argsort(-bound[mine], kind="stable")]
        while len(at := at[label[at] != label[i]]):
            j, at = at[0], at[1:]
            overlap = sizes[i] + sizes[j] - len(np.union1d(sets[i], sets[j]))
            if 7 * overlap >= 3 * (sizes[i] + sizes[j]):
                out.append((int(keys[i]), int(keys[j])))
                label[label == label[j]] = label[i]
    return out


def _link_part(t: pa.Table) -> pa.Table:
    keys, at = np.unique(t["class"].to_numpy(), return_index=True)
    raw, group = t["set"].to_pylist(), t["group"].to_numpy()[at]
    got = links(keys, [_unpacked(raw[i]) for i in at], group) if len(keys) > 1 else []
    return pa.table([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], names=["a", "b"])


def merge(part: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links inside the parts of the shards of each class's first shared shingle."""
    shard = part.select("class", F.array_min("tokens").alias("shard"))
    counts = shard.groupBy("shard").count().where("count > 1").withColumn("cuts", F.ceil(F.col("count") / PART))
    shard = shard.join(counts, "shard").withColumn("cut", F.explode(F.when(F.col("cuts") > 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    shard = shard.select("class", "shard", F.concat(F.col("cut").cast("string"), F.lit("-"), F.pmod(F.xxhash64("class", "cut"), F.col("cuts")).cast("string")).alias("cell"))
    rows = shard.join(sets, "class").withColumn("group", F.col("class"))
    return rows.groupBy("shard", "cell").applyInArrow(_link_part, "a long, b long")


def candidates(part: DataFrame) -> DataFrame:
    """(a, b): pairs of classes of different components (column root) that share so many prefix shingles that they may link and
    whose count vectors (column point) allow it."""
    hit = part.select("class", "n", "root", F.explode("tokens").alias("token"))
    for _ in range(2):  # what is left of a class's shared shingles shrinks as others drop out
        several = hit.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
        hit = hit.join(several, "token")
        able = hit.groupBy("class").agg(F.count("*").alias("c"), F.max("n").alias("m")).where(F.col("c") >= least_shared("m")).select("class")
        hit = materialise(hit.join(able, "class"), "shared")
    spread = hit.groupBy("token").agg(F.count("*").alias("k")).withColumn("common", F.col("k") > COMMON)
    hit = materialise(hit.join(spread, "token"), "spread")
    commons = hit.groupBy("class").agg(F.sum(F.col("common").cast("long")).alias("commons"), F.max("n").alias("n"))
    # rare shingles: classes share at least what common ones do not make up for
    side = hit.where("not common").join(commons.select("class", (least_shared("n") - F.col("commons")).alias("least")), "class")
    side = side.select("token", F.col("class").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("least").alias("la"))
    other = side.select("token", *(F.col(c + x).alias(c + y) for c, x, y in (("", "a", "b"), ("r", "a", "b"), ("n", "a", "b"), ("l", "a", "b"))))
    near = side.join(other, "token").where("a < b and ra <> rb and 4 * na >= 3 * nb and 4 * nb >= 3 * na")
    rare = near.groupBy("a", "b").agg(F.count("*").alias("c"), F.max(F.greatest("la", "lb")).alias("least")).where("c >= least").select("a", "b")
    point = part.select("class", "point", "n")
    rare = rare.join(point.select(F.col("class").alias("a"), F.col("point").alias("pa"), F.col("n").alias("na")), "a")
    rare = rare.join(point.select(F.col("class").alias("b"), F.col("point").alias("pb"), F.col("n").alias("nb")), "b")
    bound = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    rare = rare.where(7 * bound >= 3 * (F.col("na") + F.col("nb"))).select("a", "b")
    # common shingles: classes that reach their number by common ones alone. Such a pair shares that number of them, hence one
    # among the first commons - number + 1 of each, rarest first; an R-tree for each shingle, in blocks
    warm = commons.where(F.col("commons") >= least_shared("n")).select("class", (F.col("commons") - least_shared("n") + 1).alias("lead"))
    order = Window.partitionBy("class").orderBy("k", "token")
    rows = hit.where("common").join(warm, "class").withColumn("rank", F.row_number().over(order)).where("rank <= lead")
    before = F.collect_list("token").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("token", "class", "root", "n", before.alias("before"))
    cuts = rows.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).alias("cuts"))
    rows = rows.join(cuts, "token").withColumn("cut", F.pmod(F.xxhash64("class"), F.col("cuts")))
    every = F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)
    cell = F.transform(every, lambda k: F.struct(F.least(k, F.col("cut")).alias("i"), F.greatest(k, F.col("cut")).alias("j")))
    rows = rows.withColumn("cell", F.explode(cell)).select("token", "cell.i", "cell.j", "cut", "class", "root", "n", "before").join(point.select("class", "point"), "class")
    common = rows.groupBy("token", "i", "j").applyInArrow(_near_points, "a long, b long")
    return rare.unionByName(common).distinct()


def _near_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components whose points allow a link: blocks i and j of a shingle's classes (within one block if i = j).

    A pair that also meets at a shingle before this one is left to that one. Pairs leave as they are found, so a cell holds
    its two blocks at most, however many pairs they make.
    """
    t = pa.Table.from_batches(list(batches))
    cls, root, n, cut = (t[c].to_numpy() for c in ("class", "root", "n", "cut"))
    points = t["point"].combine_chunks().flatten().to_numpy().reshape(len(cls), -1)
    lists, sets = t["before"].combine_chunks(), {}

    def before(k: int) -> frozenset:
        if k not in sets:
            sets[k] = frozenset(lists[k].as_py())
        return sets[k]

    here = np.flatnonzero(cut == t["i"][0].as_py())
    there = here if t["i"][0].as_py() == t["j"][0].as_py() else np.flatnonzero(cut == t["j"][0].as_py())
    if not len(here) or not len(there):
        return
    tree, found, held = Tree(points[there], n[there]), [], 0
    for i in here.tolist():
        at = there[tree.query(points[i], n[i])[0]]
        at = at[(root[at] != root[i]) & ((cls[at] < cls[i]) | (there is not here))]
        at = at[[before(i).isdisjoint(before(j)) for j in at.tolist()]] if len(at) else at
        found.append(np.stack([np.minimum(cls[at], cls[i]), np.maximum(cls[at], cls[i])]))
        held += len(at)
        if held >= 1 << 16:
            yield _pairs(found)
            found, held = [], 0
    if held:
        yield _pairs(found)


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate(found, 1)
    return pa.RecordBatch.from_arrays([pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], names=["a", "b"])


def complete(part: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(a, b): verified links between the components (column root) of part, or None where no two can meet."""
    pair = materialise(candidates(part), "pairs")
    if pair.isEmpty():
        return None
    ends = pair.select(F.col("a").alias("class")).unionByName(pair.select(F.col("b").alias("class"))).groupBy("class").count()
    pair = pair.join(ends.select(F.col("class").alias("a"), F.col("count").alias("ka")), "a").join(ends.select(F.col("class").alias("b"), F.col("count").alias("kb")), "b")
    hub = F.when(F.col("ka") >= F.col("kb"), F.col("a")).otherwise(F.col("b"))
    pair = pair.select(hub.alias("hub"), F.when(F.col("ka") >= F.col("kb"), F.col("b")).otherwise(F.col("a")).alias("class"))
    cuts = pair.groupBy("hub").agg(F.ceil(F.count("*") / PART).alias("cuts"))
    guests = pair.join(cuts, "hub").select("hub", F.pmod(F.xxhash64("class"), F.col("cuts")).alias("cut"), "class")
    hosts = cuts.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"), F.col("hub").alias("class"))
    rows = guests.unionByName(hosts).join(part.select("class", F.col("root").alias("group")), "class").join(sets, "class")
    return rows.groupBy("hub", "cut").applyInArrow(_link_hub, "a long, b long")


def _link_hub(t: pa.Table) -> pa.Table:
    """Links of a hub with its guests, one for each component of guests."""
    cls, group, raw = t["class"].to_numpy(), t["group"].to_numpy(), t["set"].to_pylist()
    hub, out, linked = t["hub"][0].as_py(), [], set()
    mine = _unpacked(raw[int(np.flatnonzero(cls == hub)[0])])
    for c, g, data in zip(cls.tolist(), group.tolist(), raw):
        if c != hub and g not in linked:
            other = _unpacked(data)
            overlap = len(mine) + len(other) - len(np.union1d(mine, other))
            if 7 * overlap >= 3 * (len(mine) + len(other)):
                out.append((hub, c))
                linked.add(g)
    return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component_id) of every row of docs."""
    signed = materialise(sign(docs, key, text, size), "signed")
    classes = signed.where("n > 0").groupBy("class").agg(F.min("id").alias("cid"), F.max("n").alias("n"))
    classes = materialise(classes, "classes")
    shared = shared_prefixes(docs, text, size).groupBy("class").agg(F.collect_set("token").alias("tokens"))
    part = materialise(shared.join(classes, "class").where(F.size("tokens") >= least_shared("n")), "part")
    schema = pa.schema([("class", pa.int64()), ("set", pa.binary()), ("point", pa.list_(pa.int32()))])

    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, texts in text_chunks(batch.column(1)):
            g, bounds = shingle_sets(texts, size)
            want = batch.column(0).slice(lo, len(texts)).to_numpy()
            ok = np.flatnonzero(digests(g, bounds) == want)
            raw = _packed(g)
            cells = [raw[bounds[i] : bounds[i + 1]].tobytes() for i in ok]
            points = [point(g[bounds[i] : bounds[i + 1]]) for i in ok]
            yield pa.RecordBatch.from_arrays([pa.array(want[ok]), pa.array(cells, pa.binary()), pa.array(points, schema.types[2])], schema=schema)

    named = part.select(F.col("class"), F.col("cid"))
    texts = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    chosen = texts.join(named, F.col("_id").eqNullSafe(F.col("cid"))).select("class", "_text")
    built = materialise(map_arrow(chosen, build, "class long, set binary, point array<int>"), "sets")
    sets = built.select("class", "set")
    edges = materialise(merge(part, sets), "links")
    root = components(edges, "a", "b").withColumnRenamed("node", "class")
    rooted = part.join(root, "class", "left").withColumn("root", F.coalesce("root", "class")).join(built.select("class", "point"), "class")
    rooted = materialise(rooted.dropDuplicates(["class"]), "rooted")
    more = complete(rooted, sets)
    if more is not None:
        more = materialise(more, "links")
        if not more.isEmpty():
            root = components(edges.unionByName(more), "a", "b").withColumnRenamed("node", "class")
    found = classes.join(root, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = found.groupBy("root").agg(F.min("cid").alias("component_id"))
    named = found.join(least, "root").select("class", "component_id")
    out = signed.join(named, "class", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op1_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: doc_id, n_shingles, component_id."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
