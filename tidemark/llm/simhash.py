"""SimHash fingerprints, and near duplicates by BK-trees over shards of fingerprints.

A fingerprint bit is set if it is set in over half of the XXH64 hashes of a text's word shingles. Two
fingerprints are linked if they differ in at most ``radius`` bits; a group is what links reach.

Fingerprints that differ in at most r bits agree in at least b - r of b bands, so each different fingerprint is dealt to
one bucket for each choice of b - r bands (b grows with their number, so that a bucket stays small). A
bucket is cut into shards of at most ``SHARD`` fingerprints. A shard's BK-tree (children keyed by their Hamming distance
to the parent, so a search follows only edges within the radius of the query's distance) is dealt to
the tasks that hold the bucket's queries, a tree and a shard of queries at a time; all trees together have no size bound,
so they aren't broadcast whole to every executor. A task's links go through a union-find, and at most one link a
fingerprint leaves it, so copies and clusters never become all pairs. Groups are then contracted to their smallest
member in a logarithmic number of rounds, each written to the shared folder.

Cases: null and empty texts and texts without a word have fingerprint zero, linked like any other. A text with fewer words
than a shingle has one shingle: all its words. Texts of any length are read whole. Repeated rows are kept, one row
each; rows with a null key get a group like others, but a null key is never a component's id unless no member has
another. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard, prepare, raw_texts, stored

SHINGLE, RADIUS = 4, 4
#: Fingerprints of a shard, and of a bucket on average before bands are made narrower.
SHARD, BUCKET = 1024, 96
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included. bytes.split() cuts at space and 0x09 to 0x0D."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    return np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[size - 1 :])], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit number; zero for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", size: int = SHINGLE) -> DataFrame:
    """The columns named in keep with ``fp``, the fingerprint of each whole text."""
    prepare(docs.sparkSession)
    out = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingle_hashes(x, size)) for x in raw_texts(b.column(k))]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(fps, pa.int64())], names=[*keep, "fp"])

    return out.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema[:-1]), "fp bigint"]))


class BkTree:
    """A BK-tree of fingerprints: each node's children are keyed by their distance to it (an equal one is a child at 0)."""

    def __init__(self, fps: list[int]):
        self.fps: list[int] = []
        self.children: list[dict[int, int]] = []
        for x in fps:
            self.add(x)

    def add(self, x: int) -> None:
        fps, at, i = self.fps, 0, len(self.fps)
        fps.append(x)
        self.children.append({})
        while at < i:
            d = (fps[at] ^ x).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = i
                return
            at = nxt

    def within(self, x: int, radius: int) -> list[int]:
        """Places of the fingerprints within the radius of x."""
        found, todo, fps, children = [], [0] if self.fps else [], self.fps, self.children
        while todo:
            at = todo.pop()
            d = (fps[at] ^ x).bit_count()
            if d <= radius:
                found.append(at)
            own = children[at]
            if len(own) <= 2 * radius:
                todo += [c for e, c in own.items() if d - radius <= e <= d + radius]
            else:
                todo += [own[e] for e in range(d - radius, d + radius + 1) if e in own]
        return found


def links(tree: list[int], queries: list[int], same: bool, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join what the tree's and the queries' fingerprints reach: (larger, smallest of its group here)."""
    bk, fps = BkTree(tree), tree if same else [*tree, *queries]
    root = list(range(len(fps)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    shift = 0 if same else len(tree)
    for q, x in enumerate(queries):
        a = top(q + shift)
        for i in bk.within(x, radius):
            b = top(i)
            if a != b:
                if fps[a] > fps[b]:
                    a, b = b, a
                root[b] = a
    return [(fps[i], fps[top(i)]) for i in range(len(fps)) if top(i) != i]


def _plan(n: int, radius: int) -> tuple[int, list[tuple[int, ...]]]:
    """Number of bands, and the choices of bands that linked fingerprints share at least one of."""
    bands = radius + 1
    while bands < min(2 * radius, 16) and n / 2 ** (64 * (bands - radius) / bands) > BUCKET:
        bands += 1
    return bands, list(combinations(range(bands), bands - radius))


def linked(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), a > b as signed numbers, that join all fingerprints within the radius. fps: one column fp, all different."""
    n = fps.count()
    bands, choices = _plan(n, radius)
    edges = [64 * k // bands for k in range(bands + 1)]
    masks = []
    for c in choices:
        m = 0
        for k in c:
            m |= (1 << edges[k + 1]) - (1 << edges[k])
        masks.append(m - (1 << 64) if m >> 63 else m)
    keys = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks)])
    dealt = fps.select("fp", F.col("fp").alias("node"), F.explode(keys).alias("key")).select("fp", "node", "key.choice", "key.bits")

    def joined(own: list, other: list, same: bool) -> list[tuple[int, int]]:
        return [(_signed(x), _signed(y)) for x, y in links([x for x, _ in own], [x for x, _ in other], same, radius)]

    return _searched(dealt, joined)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _searched(dealt: DataFrame, search) -> DataFrame:
    """Links (a, b) that ``search`` finds in buckets. dealt: choice, bits (the bucket), fp, node.

    A small bucket is one unit; a large one becomes a unit for each pair of its shards, so it is spread over tasks. search takes
    the tree's and the queries' (fingerprint, node) and whether both are the same shard."""
    sizes = dealt.groupBy("choice", "bits").count().where(F.col("count") > 1)
    shards = F.ceil(F.col("count") / F.lit(SHARD)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("shards")).cast("int")
    units = dealt.join(cut(sizes.select("choice", "bits", shards.alias("shards"))), ["choice", "bits"]).withColumn("own", own)
    pairs = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    units = units.withColumn("unit", F.explode(pairs)).select(F.xxhash64("choice", "bits", "unit.i", "unit.j").alias("u"), "choice", "bits", F.col("unit.i").alias("i"), F.col("unit.j").alias("j"), "own", "fp", "node")
    units = units.repartition("u").sortWithinPartitions("choice", "bits", "i", "j", "own", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        def unit(key, rows):
            if len(rows) < 2:
                return []
            _, _, i, j = key
            tree = [(x & _ALL, n) for o, x, n in rows if o == i]
            other = tree if i == j else [(x & _ALL, n) for o, x, n in rows if o == j]
            return [(max(p, q), min(p, q)) for p, q in search(tree, other, i == j)]

        held, rows, found = None, [], []
        for b in batches:
            for _, choice, bits, i, j, o, fp, node in zip(*[c.to_pylist() for c in b.columns]):
                if (key := (choice, bits, i, j)) != held:
                    found += unit(held, rows)
                    held, rows = key, []
                rows.append((o, fp, node))
            if len(found) > 4096:
                yield out(found)
                found = []
        found += unit(held, rows)
        if found:
            yield out(found)

    return units.mapInArrow(run, "a bigint, b bigint").distinct()


_ALL = (1 << 64) - 1


def contracted(edges: DataFrame) -> DataFrame:
    """For each node of the links (a, b): ``root``, the smallest node that it reaches.

    A round points each node to its smallest neighbour, if that is smaller, and follows these pointers to their ends by doubling; then
    links are taken over to the ends. At least half of the nodes that still have links go in a round, and a pointer
    chain of n nodes takes log2(n) steps, so chains end as soon as stars."""
    edges = cut(edges.select("a", "b").where("a <> b"))
    comp = None
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        up = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"), F.lit(True).alias("moved")))
        while True:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            far = cut(up.select("node", "up").join(over, "up").select("node", F.col("top").alias("up"), (F.col("up") != F.col("top")).alias("moved")))
            still = not far.where("moved").isEmpty()
            discard(up)
            up = far
            if not still:
                break
        if comp is None:
            found = cut(up.select("node", F.col("up").alias("root")))
        else:
            over = up.select(F.col("node").alias("root"), F.col("up").alias("top"))
            found = cut(comp.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        x = edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("la")), "a").select("b", "la")
        x = x.join(up.select(F.col("node").alias("b"), F.col("up").alias("lb")), "b").where("la <> lb")
        left = cut(x.select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct())
        discard(comp, edges, up)
        comp, edges = found, left
        if edges.isEmpty():
            discard(edges)
            return comp


def components(fps: DataFrame, key: str, radius: int = RADIUS) -> DataFrame:
    """The columns of fps (key, fp) with component_id, the smallest key that its fingerprint reaches."""
    fps = cut(fps)
    nodes = cut(fps.groupBy("fp").agg(F.min(key).alias("least")))
    roots = contracted(linked(nodes.select("fp"), radius))
    named = cut(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut(named.join(ids, "root").select("fp", "component_id"))
    discard(nodes, roots, named)
    return fps.join(of, "fp")


#: Near copies by their words: shingle size and least similarity (exact, of the sets of shingles).
COPY_SHINGLE, SIMILARITY = 5, 0.8
#: Minimum hashes, and bands of them (of five each) that deal texts to buckets: a pair at 0.8 shares one with odds of 0.9996.
_HASHES, _BANDS, _BAND = 200, 20, 5
#: Bands whose buckets are searched first; of the others only those are searched that still hold several groups.
_FIRST = 4
#: Bits in which fingerprints of two sets may differ to be looked at. At 0.8 a bit differs with odds of 0.15 to 0.19, so that 12 are
#: expected and more than 26 have odds of 1e-5.
COPY_RADIUS = 26
#: Agreement of minimum hashes below which a pair isn't looked at (a pair at 0.8 falls below with odds of 1e-6).
LOOSE = 0.65
#: Hashes of all sets in a shard.
SHARD_HASHES = 1 << 21
#: Bits of the map of rows whose sets are read a second time.
_SLOTS = 1 << 26
_SALT = np.random.default_rng(97).integers(0, 1 << 63, _HASHES, dtype=np.uint64)[:, None]


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest of the shingles' hashes under each of _HASHES orders, upper 32 bits."""
    low = np.full(_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 2048):
        x = (hashes[None, a : a + 2048] ^ _SALT) * np.uint64(0x9E3779B97F4A7C15)
        low = np.minimum(low, ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).min(1))
    return (low >> np.uint64(32)).astype(np.uint32)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of shingle hashes have a Jaccard similarity of SIMILARITY or more."""
    if min(len(a), len(b)) / max(len(a), len(b), 1) < SIMILARITY:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) >= SIMILARITY


def _node(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return _signed(xxh64_intdigest(hashes.tobytes(), 1))


def _joined(own: list, other: list, same: bool) -> list[tuple[int, int]]:
    """Links (larger, smaller node) that join all similar rows of a unit that no link joins yet. Rows: node, root, fp, sig, hashes.

    A BK-tree of the rows before it gives each row those whose fingerprints are near; the sketches and then the sets decide. Rows
    of one group need no look at each other, so the search ends where the tree holds the row's group alone."""
    rows = own if same else [*own, *other]
    fps = [r[2] & _ALL for r in rows]
    sigs = np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(-1, _HASHES)
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    group = np.unique([r[1] for r in rows], return_inverse=True)[1]
    tree, found = BkTree([] if same else fps[: len(own)]), []
    within = set(group[: 0 if same else len(own)].tolist())  # groups in the tree
    for q in range(0 if same else len(own), len(rows)):
        if within - {int(group[q])}:
            near = np.array(tree.within(fps[q], COPY_RADIUS), np.int64)
            near = near[group[near] != group[q]]
            agree = (sigs[near] == sigs[q]).mean(1)
            for i in near[np.argsort(-agree, kind="stable")[: (agree >= LOOSE).sum()]]:
                if group[i] != group[q] and alike(sets[i], sets[q]):
                    found.append((max(rows[i][0], rows[q][0]), min(rows[i][0], rows[q][0])))
                    within.discard(int(group[i]))
                    group[group == group[i]] = group[q]
                    within.add(int(group[q]))
        if same:
            tree.add(fps[q])
            within.add(int(group[q]))
    return found


def _together(units: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) in units: choice, bits, i, j (the shards that meet), own (the row's shard), node, root."""
    dealt = units.join(sets, "node").select(F.xxhash64("choice", "bits", "i", "j").alias("u"), "choice", "bits", "i", "j", "own", "node", "root", "fp", "sig", "hashes")
    dealt = dealt.repartition("u").sortWithinPartitions("choice", "bits", "i", "j", "own", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unit(key, rows):
            if len(rows) < 2:
                return []
            own = [r[1:] for r in rows if r[0] == key[2]]
            return _joined(own, own if key[2] == key[3] else [r[1:] for r in rows if r[0] == key[3]], key[2] == key[3])

        held, rows = None, []
        for b in batches:
            found = []
            for _, choice, bits, i, j, *row in zip(*[c.to_pylist() for c in b.columns]):
                if (key := (choice, bits, i, j)) != held:
                    found += unit(held, rows)
                    held, rows = key, []
                rows.append(row)
            yield _pairs(found)
        yield _pairs(unit(held, rows))

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def _sets(rows: DataFrame, named: DataFrame) -> DataFrame:
    """node, fp, sig, hashes of the nodes in named (node, row: one of its rows). The texts aren't shuffled: a map of fixed size tells
    most other rows apart, the join the rest. rows: row, text."""
    slot = F.pmod(F.xxhash64("row"), F.lit(_SLOTS))
    parts = named.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    bits = np.zeros((_SLOTS // 32768 + 1, 4096), np.uint8)
    for part, one in parts.collect():
        bits[part] = np.frombuffer(one, np.uint8)
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = held.value
        for b in batches:
            part, bit = (b.column(k).to_numpy() for k in (1, 2))
            b = b.filter(pa.array((seen[part, bit >> 3] >> (bit & 7)) & 1 == 1))
            sets = [np.unique(shingle_hashes(x, COPY_SHINGLE)) for x in raw_texts(b.column(0))]
            cols = [pa.array([f(h) for h in sets], t) for f, t in ((_node, pa.int64()), (fingerprint, pa.int64()), (lambda h: minima(h).tobytes(), pa.binary()), (lambda h: h.tobytes(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "fp", "sig", "hashes"])

    placed = rows.select("text", slot.alias("slot")).select("text", F.expr("bitmap_bucket_number(slot)").alias("part"), F.expr("bitmap_bit_position(slot)").alias("bit"))
    found = placed.mapInArrow(run, "node bigint, fp bigint, sig binary, hashes binary").join(named.select("node"), "node", "left_semi")
    return stored(found.groupBy("node").agg(F.first("fp").alias("fp"), F.first("sig").alias("sig"), F.first("hashes").alias("hashes")), "sets")


def _mixed(dealt: DataFrame, *unit: str) -> DataFrame:
    """The rows of units that hold several groups."""
    several = dealt.groupBy(*unit).agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select(*unit)
    return dealt.join(several, list(unit), "left_semi")


def _rooted(dealt: DataFrame, roots: DataFrame) -> DataFrame:
    return dealt.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _copies(rows: DataFrame) -> DataFrame:
    """row, key, root of every row, the root being the same number in each group of near copies. rows: row (all different), key, text.

    At a similarity of 0.8 fingerprints differ in more bits than buckets of equal bits allow; so buckets are dealt by bands of minimum
    hashes. A bucket's shards of bounded size are searched in their tasks, each by a BK-tree of the fingerprints of the
    sets; only the exact similarity of the sets makes a link, and at most one link a node leaves a task. The first bands' buckets
    join most groups. Then only those buckets are searched that still hold several groups, and at last only the large
    ones that still do have their shards meet pair by pair. Texts with the same shingles, or without a word, are one node."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(x, COPY_SHINGLE)) for x in raw_texts(b.column(2))]
            cols = [pa.array([_node(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array([minima(h).tobytes() for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *cols], names=["row", "key", "node", "n", "sig"])

    bands = F.array(*[F.xxhash64(F.substring("sig", 4 * _BAND * k + 1, 4 * _BAND)) for k in range(_BANDS)])
    made = rows.select("row", "key", "text").mapInArrow(run, f"row bigint, key {rows.schema['key'].dataType.simpleString()}, node bigint, n bigint, sig binary")
    made = stored(made.select("row", "key", "node", "n", bands.alias("bands")), "copies")
    nodes = cut(made.groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    dealt = nodes.select("node", "n", F.posexplode("bands").alias("choice", "bits"))
    sizes = dealt.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("hashes")).where("size > 1")
    shards = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("size") / SHARD, F.col("hashes") / SHARD_HASHES)).cast("int"))
    dealt = dealt.drop("n").join(sizes.select("choice", "bits", shards.alias("shards")), ["choice", "bits"])
    # shards are dealt otherwise in each band, so that a large group is mostly one after a few of them
    dealt = cut(dealt.withColumn("own", F.pmod(F.xxhash64("node", "choice"), F.col("shards")).cast("int")))
    wanted = cut(nodes.select("node", "row").join(dealt.select("node").distinct(), "node", "left_semi"))
    sets = _sets(rows, wanted)
    alone = [F.col("own").alias("i"), F.col("own").alias("j"), "own", "node", "root"]
    true = cut(_together(dealt.where(F.col("choice") < _FIRST).withColumn("root", F.col("node")).select("choice", "bits", *alone), sets))
    roots = contracted(true)
    rest = cut(_mixed(_rooted(dealt.where(F.col("choice") >= _FIRST), roots), "choice", "bits", "own"))
    more = cut(true.unionByName(_together(rest.select("choice", "bits", *alone), sets)))
    discard(true, roots, rest, nodes, wanted)
    roots = contracted(more)
    several = cut(_mixed(_rooted(dealt.where("shards > 1"), roots), "choice", "bits"))
    if not several.isEmpty():
        meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j"))))
        units = several.withColumn("unit", meet).where("unit.i < unit.j").select("choice", "bits", "unit.i", "unit.j", "own", "node", "root")
        whole = contracted(more.unionByName(_together(units, sets)))
        discard(roots)
        roots = whole
    discard(sets, dealt, more, several)
    return made.select("row", "key", "node").join(roots, "node", "left").select("row", "key", F.coalesce("root", "node").alias("root"))


def _with_rows(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written once, so that every later step and retry sees the same ones."""
    return stored(docs.withColumn("row", F.monotonically_increasing_id()), "rows")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, component_id (the smallest key of its group) of every row; rows are linked if their sets of five-word shingles are alike
    by 0.8 or more."""
    found = cut(_copies(_with_rows(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))))
    ids = found.groupBy("root").agg(F.min("key").alias("component_id"))
    return found.join(ids, "root").select(F.col("key").alias(key), "component_id")


def distinct_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each group of near copies the one with the smallest key.

    Of rows that share that key one stays, null keys coming last; rows of other groups with the same key aren't touched."""
    names = docs.columns
    table = _with_rows(docs.toDF(*[f"c{k}" for k in range(len(names))]))
    found = cut(_copies(table.select("row", F.col(f"c{names.index(key)}").alias("key"), F.col(f"c{names.index(text)}").alias("text"))))
    order = F.struct(F.col("key").isNull().alias("none"), "key", "row")
    groups = found.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "first.row")
    gone = found.join(groups.withColumnRenamed("row", "stays"), "root").where("row <> stays").select("row")
    return table.join(cut(gone), "row", "left_anti").drop("row").toDF(*names)
