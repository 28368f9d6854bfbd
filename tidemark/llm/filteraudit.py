"""Interaction audit of corpus filters: what each of them removes alone, after the others, and on average over all orders.

Every document becomes a mask with one bit for each filter that it fails. Documents are counted by (part, mask), so all that
follows works on these cells, at most 2^filters for each part. The cells are unpivoted against every order's steps (long
form: part, mask, order, step). A running bit-or window over a cell's earlier steps tells whether an earlier filter has removed
it; conditional sums of the cells give a step's metrics, and a window over a filter's rows of all orders gives its total.

One filter may be ``duplicate``: it fails documents whose text is identical to that of any document with a smaller key,
over the whole table. Texts are compared by their SHA-256. Rows are counted by (text, part, key) before they meet, and a text's
smallest key is found over partially aggregated rows, so a text or a key that a third of all rows share is no hot spot.

Cases: a null text counts as empty; an empty text has no words and fails A alone (and ``duplicate``, if it isn't the first). A
null part is the part '', and so is an empty one. Rows with a null key never fail ``duplicate`` and aren't labelled; rows that
share key and text have no smaller key between them, so they stay or fail together. A key with several labels is good (toxic) if any
of them says so; null labels say nothing. Texts of any length are read whole. Extra columns are ignored; names with ``__fa_`` are
reserved. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space between words.
_GAP = r"[\x20\x09-\x0D]+"
#: The name of the filter that a mapping of filters gives to repeated texts.
DUPLICATE = None


def words(text: Column) -> Column:
    """The words of a text: maximal runs without ASCII white space."""
    return F.filter(F.split(text, _GAP), lambda w: w != "")


def production(text: Column) -> dict[str, Column | None]:
    """The five filters, by letter: the condition under which a text fails. E fails repeated texts."""
    all_words = words(text)
    n = F.size(all_words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(all_words)) < 80 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
        "E": DUPLICATE,
    }


def cells(docs: DataFrame, labels: DataFrame, filters=production, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """__fa_part, __fa_mask (bit k: fails the k-th filter) with the documents n, and of them good and toxic ones."""
    body = F.coalesce(F.col(text), F.lit(""))
    made = filters(body)
    bits = [F.when(c, F.lit(1 << k)).otherwise(0) for k, c in enumerate(made.values()) if c is not DUPLICATE]
    twice = sum(1 << k for k, c in enumerate(made.values()) if c is DUPLICATE)
    mask = F.lit(0)
    for b in bits:
        mask = mask.bitwiseOR(b)
    rows = docs.select(F.col(key).alias("__fa_key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("__fa_part"), F.unhex(F.sha2(body, 256)).alias("__fa_text"), mask.alias("__fa_mask"))
    group = ["__fa_text", "__fa_part", "__fa_mask"]
    rows = rows.groupBy(*group, "__fa_key").agg(F.count(F.lit(1)).alias("m"))
    told = labels.select(F.col(key).alias("__fa_key"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t")).where("__fa_key is not null")
    told = told.groupBy("__fa_key").agg(F.coalesce(F.max("g"), F.lit(False)).alias("g"), F.coalesce(F.max("t"), F.lit(False)).alias("t"))
    rows = rows.join(told, "__fa_key", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("g", "t")})
    # of a text's rows in one group: all, those without a key, and the smallest key with its rows
    first = F.min(F.when(F.col("__fa_key").isNotNull(), F.struct("__fa_key", "m")))
    texts = rows.groupBy(*group, "g", "t").agg(F.sum("m").alias("n"), F.coalesce(F.sum(F.when(F.col("__fa_key").isNull(), F.col("m"))), F.lit(0)).alias("free"), first.alias("first"))
    smallest = F.min("first.__fa_key").over(Window.partitionBy("__fa_text"))
    texts = texts.withColumn("stay", F.col("free") + F.when(F.col("first.__fa_key") == smallest, F.col("first.m")).otherwise(0))
    two = F.array(F.struct(F.col("__fa_mask").alias("mask"), F.col("stay").alias("n")), F.struct(F.col("__fa_mask").bitwiseOR(F.lit(twice)).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))
    long = texts.select("__fa_part", "g", "t", F.inline(two)).where("n > 0")
    return long.groupBy("__fa_part", F.col("mask").alias("__fa_mask")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("g"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("t"), F.col("n")).otherwise(0)).alias("toxic"))


def evaluated(table: DataFrame, names: str | list[str] | Mapping) -> DataFrame:
    """The metrics of each (part, order, step) from cells; ``names`` are the filters' one-letter names in the order of their bits."""
    letters = "".join(names)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = table.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "(?!^)(?!$)")).alias("at", "letter"))
    bit = F.expr(f"shiftleft(1, instr('{letters}', letter) - 1)")
    steps = steps.withColumn("own", F.col("__fa_mask").bitwiseAND(bit))
    before = Window.partitionBy("__fa_part", "__fa_mask", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("own").over(before), F.lit(0)))
    fails, gone = F.col("own") != 0, F.col("earlier") != 0
    summed = lambda condition, value="n": F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0)).cast("bigint")
    rows = steps.groupBy(F.col("__fa_part").alias("part"), "filter_order", (F.col("at") + 1).alias("step"), "letter").agg(
        summed(~fails & ~gone).alias("kept"), summed(fails & ~gone).alias("removed"), summed(fails & gone).alias("redundant"), summed(fails & (F.col("own") == F.col("__fa_mask"))).alias("unique_fails"),
        summed(fails & ~gone, "good").alias("good_lost"), summed(fails & ~gone, "toxic").alias("toxic_lost"))
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit(docs: DataFrame, labels: DataFrame, filters=production, **columns: str) -> DataFrame:
    """One row for each part, order of the filters and step, with zeros: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return evaluated(cells(docs, labels, filters, **columns), list(filters(F.lit(""))))
