"""Mixing sources to target weights by temperature, with DataFrame functions alone.

Each source's share p of all tokens is raised to an exponent and normalised, w = p^a / sum(p^a). The exponent in
[0, 1] is found by bisection, either to a target entropy of w or to the largest one whose repetition
(largest over smallest w / p) keeps to a limit. Budgets in tokens are w times a total; without a total
it is the least one at which no source is cut. They are realised as block permutations: a source's documents
are dealt to blocks by a hash of key and text, blocks and documents within a block are put in a hashed order of each
source, all of it is taken as many whole times as the budget holds, and of the rest every document that begins before
the rest of the budget ends. Prefix sums run over block totals and within a block, so the documents of a source that
holds a third of all rows meet in no single task (its block totals do: one number for ``BLOCK_ROWS`` documents).

A document's tokens are ceil(code points / 4), at least 1, or a column that the caller names. Cases: null texts
and empty texts have 1 token; a null source is a source of its own, apart from the empty name; one source alone has weight
1; equal sources get equal weights. Rows that share key and text are the only ones whose order isn't fixed. Repeated rows are rows of their own. Extra columns are kept; names with
``__mx_`` are reserved. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Times that a document may be taken at most, by weights (the last block may add no more than one document a source).
REPETITION_LIMIT = 2.0
#: Documents of a block, about.
BLOCK_ROWS = 500
STEPS = 60
SEED = 17


def _tokens(text: str):
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(F.col(text), F.lit(""))) / 4)).cast("long")


def _bisected(shares: str, low_fits: str) -> str:
    """SQL of the exponent in [0, 1] at which the condition in ``a`` stops to hold, by halving; it holds at 0 if anywhere."""
    mid = low_fits.replace(":a", "(acc.lo + acc.hi) / 2").replace(":shares", shares)
    full = low_fits.replace(":a", "1D").replace(":shares", shares)
    return (
        f"if({full}, 1D, aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), "
        f"(acc, i) -> if({mid}, named_struct('lo', (acc.lo + acc.hi) / 2, 'hi', acc.hi), named_struct('lo', acc.lo, 'hi', (acc.lo + acc.hi) / 2)), acc -> acc.lo))"
    )


def weights(docs: DataFrame, source: str = "source", text: str = "text", tokens: str | None = None, target_entropy: float | None = None, repetition_limit: float = REPETITION_LIMIT, total: float | None = None) -> DataFrame:
    """One row for each source: __mx_source, rows, tokens, share, exponent, weight and budget (tokens).

    target_entropy is in nats; it is met if it lies between that of the shares and that of equal weights, else
    the nearer end is taken. Sources must be few enough for one array (a million take 8 MB)."""
    size = F.col(tokens).cast("long") if tokens else _tokens(text)
    table = docs.select(_source(source), size.alias("t")).groupBy("__mx_source").agg(F.count(F.lit(1)).alias("rows"), F.sum("t").alias("tokens"))
    w = Window.partitionBy(F.lit(1))
    total_of = table.agg(F.sum("tokens").alias("all"), F.array_sort(F.collect_list(F.col("tokens").cast("double"))).alias("each"))
    total_of = total_of.select("all", F.expr("transform(each, x -> x / all)").alias("shares"))
    if target_entropy is None:
        # the largest over the smallest w / p is (p_max / p_min)^(1 - a); at a = 1 it is 1
        fits = f"pow(array_max(:shares) / array_min(:shares), 1D - :a) > {float(repetition_limit)!r}D"
    else:
        powers = "transform(:shares, p -> pow(p, :a))"
        norm = f"aggregate({powers}, 0D, (s, x) -> s + x)"
        # H = ln Z - a * sum(p^a ln p) / Z
        entropy = f"(ln({norm}) - :a * aggregate(transform(:shares, p -> pow(p, :a) * ln(p)), 0D, (s, x) -> s + x) / {norm})"
        fits = f"{entropy} >= {float(target_entropy)!r}D"
    solved = total_of.select("all", F.expr(_bisected("shares", fits)).alias("exponent"), "shares").first()
    if solved is None or solved["all"] is None:
        exponent, whole = 1.0, 1.0
    else:
        exponent, whole = float(solved["exponent"]), float(solved["all"])
    table = table.withColumn("share", F.col("tokens") / F.lit(whole)).withColumn("p", F.pow("share", F.lit(exponent)))
    table = table.withColumn("weight", F.col("p") / F.sum("p").over(w))
    least = F.max(F.col("tokens") / F.col("weight")).over(w) if total is None else F.lit(float(total))
    return table.withColumn("budget", F.col("weight") * least).select("__mx_source", "rows", "tokens", "share", F.lit(exponent).alias("exponent"), "weight", "budget")


def _source(source: str):
    """A source's name, with null apart from every name."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")).alias("__mx_source")


def copies(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", tokens: str | None = None, seed: int = SEED, **target) -> DataFrame:
    """All columns of docs with __mx_tokens, __mx_copies (times taken), __mx_weight, __mx_budget, __mx_exponent and __mx_share."""
    size = F.col(tokens).cast("long") if tokens else _tokens(text)
    plan = weights(docs, source, text, tokens, **target)
    blocks = max(1, -(-docs.count() // BLOCK_ROWS))
    # a row's place comes from its key and text, so that rows with one key (or none) are dealt to all blocks
    said = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), said).cast("binary"))
    block = F.pmod(F.conv(F.substring(draw, 1, 12), 16, 10).cast("bigint"), F.lit(blocks)).cast("int").alias("__mx_block")
    marked = [_source(source), block, size.alias("__mx_tokens")]
    totals = docs.select(*marked).groupBy("__mx_source", "__mx_block").agg(F.sum("__mx_tokens").alias("t"))
    shuffled = F.md5(F.concat_ws("|", F.lit(str(seed)), "__mx_source", F.col("__mx_block").cast("string")).cast("binary"))
    order = Window.partitionBy("__mx_source").orderBy(shuffled, "__mx_block")
    before = totals.withColumn("__mx_before", F.sum("t").over(order) - F.col("t")).drop("t")
    parts = before.join(plan, "__mx_source").select("__mx_source", "__mx_block", "__mx_before", F.col("tokens").alias("__mx_all"), F.col("budget").alias("__mx_budget"), F.col("weight").alias("__mx_weight"), F.col("exponent").alias("__mx_exponent"), F.col("share").alias("__mx_share"))
    rows = docs.select("*", *marked, draw.alias("__mx_draw"))
    own = Window.partitionBy("__mx_source", "__mx_block").orderBy(F.substring("__mx_draw", 13, 20), "__mx_draw")
    rows = rows.withColumn("__mx_at", F.sum("__mx_tokens").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__mx_tokens"))
    rows = rows.join(parts, ["__mx_source", "__mx_block"])
    times = F.floor(F.round(F.col("__mx_budget") / F.col("__mx_all"), 9))
    rest = F.round(F.col("__mx_budget") - times * F.col("__mx_all"), 3)
    taken = times + F.when(F.col("__mx_before") + F.col("__mx_at") < rest, 1).otherwise(0)
    return rows.withColumn("__mx_copies", taken.cast("long")).select(*docs.columns, "__mx_tokens", "__mx_copies", "__mx_weight", "__mx_budget", "__mx_exponent", "__mx_share")


def mixed(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The columns of docs, each row as many times as it is taken."""
    found = copies(docs, source, key, text, **options)
    return found.where("__mx_copies > 0").withColumn("__mx_n", F.explode(F.sequence(F.lit(1), F.col("__mx_copies").cast("int")))).select(*docs.columns)
