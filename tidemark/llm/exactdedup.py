"""Exact deduplication by deterministic block naming.

A text (A-Z lower-cased, UTF-8) is cut into blocks of ``BLOCK`` bytes. Equal blocks get one integer name: a task first
names the blocks of its own slice, so that a block leaves it once, then the slices' blocks are sorted
and each run of equal ones is named. Adjacent pairs of names are then named the same way, level by level, until each text
has one name. No hash decides: two texts of equal length have the same name exactly if they are equal.

Task-local names and rows are written once to the shared folder, so later steps and retries see the same names; each
level's names are written there too. A block that a third of all rows hold meets other slices' copies only, and pairs that
many texts share are counted before the shuffle and joined with Spark's skew handling.

Cases: null counts as the empty text; empty texts equal each other. Of equal texts the row with the largest key stays;
of rows that also share the key exactly one; null keys are smallest. Texts of any length are read whole. Extra columns
are ignored or carried as asked; names with ``__tm_`` are reserved. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard, prepare, raw_texts, stored

BLOCK = 16384
#: Bytes of different blocks whose names a task remembers at a time.
SLICE = 16 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _sliced(docs: DataFrame, keep: list[str], text: str, block: int) -> DataFrame:
    """Rows of two kinds: texts (row, keep, length, hash, local names of blocks) and blocks (local name, bytes)."""
    prepare(docs.sparkSession)
    out = docs.select(F.col(text).alias("__tm_text"), *[F.col(c) for c in keep])
    own = [("__tm_row", "bigint", pa.int64()), ("__tm_size", "bigint", pa.int64()), ("text_sha256", "string", pa.string()), ("__tm_refs", "array<bigint>", pa.list_(pa.int64())), ("__tm_ref", "bigint", pa.int64()), ("__tm_block", "binary", pa.binary())]
    names = [x[0] for x in own] + keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        row = ref = base
        known: dict[bytes, int] = {}
        held = 0
        for b in batches:
            rows, sizes, shas, refs, new = [], [], [], [], []
            for x in raw_texts(b.column(0)):
                x = x.translate(_LOWER)
                mine = []
                for a in range(0, max(len(x), 1), block):
                    part = x[a : a + block]
                    if (name := known.get(part)) is None:
                        name = known[part] = ref
                        ref += 1
                        held += len(part) + 100
                        new.append((name, part))
                    mine.append(name)
                rows.append(row)
                row += 1
                sizes.append(len(x))
                shas.append(hashlib.sha256(x).hexdigest())
                refs.append(mine)
            n, m = len(rows), len(new)
            values = [rows + [None] * m, sizes + [None] * m, shas + [None] * m, refs + [None] * m, [None] * n + [x for x, _ in new], [None] * n + [x for _, x in new]]
            kept = [pa.concat_arrays([c, pa.nulls(m, c.type)]) for c in b.columns[1:]]
            yield pa.RecordBatch.from_arrays([*[pa.array(v, t) for v, (_, _, t) in zip(values, own)], *kept], names=names)
            if held > SLICE:
                known, held = {}, 0

    schema = ", ".join([*(f"{n} {s}" for n, s, _ in own), *(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema[1:])])
    return stored(out.mapInArrow(run, schema), "blocks")


def _named(rows: DataFrame) -> DataFrame:
    """(row, name) of each text with one name, from (row, at, name) of its blocks: pairs are named level by level."""
    done, level = None, rows
    while True:
        sizes = level.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.max("name").alias("name"))
        ended = sizes.where("n = 1").select("row", "name")
        done = ended if done is None else done.union(ended)
        pairs = level.groupBy("row", F.expr("at div 2").alias("at")).agg(F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"))
        pairs = cut(pairs.join(sizes.where("n > 1").select("row"), "row"))
        if pairs.isEmpty():
            return done
        names = cut(pairs.select("left", "right").distinct().sortWithinPartitions("left", "right").withColumn("name", F.monotonically_increasing_id()))
        level = cut(pairs.join(names, ["left", "right"]).select("row", "at", "name"))
        discard(pairs, names)


def identities(docs: DataFrame, keep: list[str], text: str = "text", block: int = BLOCK) -> DataFrame:
    """keep, text_sha256, __tm_row, __tm_size and __tm_name: rows have equal texts exactly if size and name are equal."""
    table = _sliced(docs, keep, text, block)
    blocks = table.where("__tm_ref is not null").select(F.col("__tm_ref").alias("ref"), F.col("__tm_block").alias("block"))
    # sorted by block and local name, each block's name is the first local name of its run
    named = blocks.select("ref", F.min("ref").over(Window.partitionBy("block").orderBy("ref")).alias("name"))
    texts = table.where("__tm_row is not null")
    parts = texts.select(F.col("__tm_row").alias("row"), F.posexplode("__tm_refs").alias("at", "ref"))
    level = cut(parts.join(named, "ref").select("row", "at", "name"))
    names = _named(level).select(F.col("row").alias("__tm_row"), F.col("name").alias("__tm_name"))
    return texts.drop("__tm_refs", "__tm_ref", "__tm_block").join(names, "__tm_row")


def decisions(docs: DataFrame, key: str, keep: list[str] | None = None, text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each document: keep (or the key alone), keep_id, group_size, kept and text_sha256."""
    keep = keep or [key]
    rows = identities(docs, keep, text, block)
    narrow = cut(rows.select("__tm_row", "__tm_size", "__tm_name", F.col(key).alias("__tm_key"), "text_sha256"))
    groups = narrow.groupBy("__tm_size", "__tm_name").agg(F.max(F.struct("__tm_key", "__tm_row")).alias("__tm_best"), F.count(F.lit(1)).alias("group_size"))
    groups = cut(groups.select("__tm_size", "__tm_name", F.col("__tm_best.__tm_key").alias("keep_id"), F.col("__tm_best.__tm_row").alias("__tm_stays"), "group_size"))
    found = narrow.join(groups, ["__tm_size", "__tm_name"])
    kept = (F.col("__tm_row") == F.col("__tm_stays")).alias("kept")
    if keep == [key]:
        return found.select(F.col("__tm_key").alias(key), "keep_id", "group_size", kept, "text_sha256")
    found = found.select("__tm_row", "keep_id", "group_size", kept)
    return rows.select("__tm_row", *keep, "text_sha256").join(found, "__tm_row").drop("__tm_row")


def unique(docs: DataFrame, key: str, text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows that stay, with all their columns."""
    names = docs.columns
    table = docs.toDF(*[f"__tm_c{k}" for k in range(len(names))])
    own = [f"__tm_c{k}" for k in range(len(names))]
    found = decisions(table, own[names.index(key)], own, own[names.index(text)], block).where("kept")
    return found.select(*own).toDF(*names)
