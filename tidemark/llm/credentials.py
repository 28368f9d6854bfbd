"""Secret scans with multipart credential linking, in DataFrame functions alone.

Strong spans are found by pattern and always reported: ``assign`` (a secret's name with a value), ``access`` (cloud access
identifiers) and ``hex`` (long runs of hexadecimal digits). Weak candidates are parts of a credential that alone say little:
``ident`` (a user, client or account with a value), ``secret`` (a pass phrase or the like with a value, or a long mixed run of base64) and
``endpoint`` (a URL). Parts of one text are joined by intervals: two parts are in one scope if at most ``SCOPE`` code
points lie between them. An identifier is reported if a secret is in its scope, a secret if an identifier is,
an endpoint if both are. Strong spans count as parts: access as an identifier, assign and hex as secrets.

Positions come without a user function: a text is split by a pattern, and the running sum of the lengths of gaps and matches gives each
match's place. Spans depend on the text alone, so they are found once for each different text (named by its SHA-256) after the
scan, and copies cost one row. The interval join is an equi-join on (text, cell of SCOPE code points): a part stands in
the cells that it covers, its partners also in those next to theirs, and only the roles of partners leave it,
or-ed together; so a pair is met once for each cell in common, and a cell holds no more parts than its text has room for.

Cases: null and empty texts have no spans and the hash of an empty string. Matches are leftmost and don't overlap within a kind, but spans of
different kinds may; a weak span that overlaps a strong one is left out. Letters in names match in either case, ASCII alone.
Patterns are bounded where they could run over a text again and again. Texts of any length are scanned whole. Repeated rows get equal
results, one row each; other columns are ignored or carried as asked; names with ``__cs_`` are reserved. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points between two parts of one credential, at most.
SCOPE = 300
_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: Kind -> (pattern, group whose length counts, its least length). Strong kinds first, in the order in which spans are listed.
PATTERNS: dict[str, tuple[str, int, int]] = {
    "assign": (rf"(?i)(password|passwd|secret|token|api_?key){_VALUE}([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "ident": (rf"(?i)(access_?key(?:_?id)?|client_?id|account(?:_?id)?|user(?:_?name|_?id)?|login){_VALUE}([A-Za-z0-9@._-]+)", 2, 3),
    "secret": (rf"(?i)(pwd|pass(?:phrase|code)?|credential|private_?key|signature|auth){_VALUE}([A-Za-z0-9+/_.=-]+)|[A-Za-z0-9+/]{{40,}}={{0,2}}", 0, 10),
    "endpoint": (r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x20\x09-\x0D\"'<>]+", 0, 8),
}
KINDS = tuple(PATTERNS)
STRONG = 3
#: What a kind may be of a credential: 1 identifier, 2 secret, 4 endpoint; and the roles that a weak kind's partners must have.
ROLES = (2, 1, 2, 1, 2, 4)
NEEDS = (0, 0, 0, 2, 1, 3)
_RUN = r"^[A-Za-z0-9+/]{40,}={0,2}$"


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _hits(kind: str) -> str:
    """SQL: array of (gap before, length, whether it counts) of a kind's matches, in order; empty without a match."""
    pattern, group, least = PATTERNS[kind]
    p = _literal(pattern)
    # the longest runs of hexadecimal digits are what a search for 24 of them finds, and cheaper to find; likewise for access identifiers
    p = {"hex": "r'[0-9a-f]{24,}'", "access": "r'AKIA[A-Z0-9]{16,}'"}.get(kind, p)
    ok = f"length(x.hit) >= {least}" if not group else f"length(regexp_extract(x.hit, {p}, {group})) >= {least}"
    if kind == "secret":  # a bare run has to mix capitals, small letters and digits
        ok += f" AND (NOT x.hit RLIKE {_literal(_RUN)} OR x.hit RLIKE '[A-Z]' AND x.hit RLIKE '[a-z]' AND x.hit RLIKE '[0-9]')"
    zipped = f"filter(zip_with(split(__cs_text, {p}), regexp_extract_all(__cs_text, {p}, 0), (gap, hit) -> named_struct('gap', gap, 'hit', hit)), x -> x.hit IS NOT NULL)"
    return f"CASE WHEN __cs_text RLIKE {p} THEN transform({zipped}, x -> named_struct('gap', length(x.gap), 'size', length(x.hit), 'ok', {ok})) ELSE array() END"


def _keyed(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*[F.col(c) for c in keep], F.unhex(F.sha2(body, 256)).alias("__cs_key"), body.alias("__cs_text"))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """__cs_key (of a text), kind (number), start and end of all strong spans and weak candidates of each different text."""
    kinds = ", ".join(f"named_struct('kind', {k}, 'hits', {_hits(name)})" for k, name in enumerate(KINDS))
    found = _keyed(docs, [], text).select("__cs_key", F.expr(f"inline(array({kinds}))")).where("size(hits) > 0")
    found = found.groupBy("__cs_key", "kind").agg(F.first("hits").alias("hits"))  # copies of a text have the same hits
    each = found.select("__cs_key", "kind", F.posexplode("hits").alias("at", "hit")).select("__cs_key", "kind", "at", "hit.*")
    run = Window.partitionBy("__cs_key", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum((F.col("gap") + F.col("size")).cast("bigint")).over(run)).where("ok")
    return each.select("__cs_key", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def _apart(spans: DataFrame) -> DataFrame:
    """The spans without weak ones that overlap a strong one."""
    order = Window.partitionBy("__cs_key").orderBy("start", "kind")
    strong = F.col("kind") < STRONG
    reached = F.max(F.when(strong, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(strong, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    over = (F.coalesce(reached, F.lit(-1)) > F.col("start")) | (F.coalesce(ahead, F.lit(1 << 62)) < F.col("end"))
    return spans.withColumn("__cs_over", over).where(strong | ~F.col("__cs_over")).drop("__cs_over")


def _of_kind(values: tuple[int, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("kind") + 1)


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Strong spans, and weak ones whose complementary parts are in their scope."""
    spans = _apart(spans).withColumn("role", _of_kind(ROLES))
    cell = lambda x: F.floor(x / F.lit(scope)).cast("bigint")
    own = spans.where(F.col("kind") >= STRONG).withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))))
    near = spans.select("__cs_key", F.col("role").alias("with"), F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(cell(F.col("start") - scope), cell(F.col("end") + scope))).alias("cell"))
    met = own.join(near, ["__cs_key", "cell"]).where((F.col("role") != F.col("with")) & (F.col("s") - F.col("end") <= scope) & (F.col("start") - F.col("e") <= scope))
    partners = met.groupBy("__cs_key", "kind", "start", "end").agg(F.bit_or("with").alias("with"))
    needs = _of_kind(NEEDS)
    weak = partners.where(F.col("with").bitwiseAND(needs) == needs).select("__cs_key", "kind", "start", "end")
    return spans.where(F.col("kind") < STRONG).select("__cs_key", "kind", "start", "end").unionByName(weak)


def scan(docs: DataFrame, keep: list[str], text: str = "text", scope: int = SCOPE) -> DataFrame:
    """keep with n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end by start and kind, in code points, end exclusive)."""
    found = linked(candidates(docs, text), scope)
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    said = F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string"))
    listed = found.groupBy("__cs_key").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in range(STRONG)], F.sort_array(F.collect_list(F.struct("start", "kind", said.alias("said")))).alias("__cs_all"))
    strong = F.array_join(F.transform(F.filter("__cs_all", lambda x: x["kind"] < STRONG), lambda x: x["said"]), ",")
    listed = listed.select("__cs_key", *[f"n_{KINDS[k]}" for k in range(STRONG)], strong.alias("__cs_base"), F.array_join(F.transform("__cs_all", lambda x: x["said"]), ",").alias("spans"))
    rows = _keyed(docs, keep, text).drop("__cs_text").join(listed, "__cs_key", "left")
    zero = [F.coalesce(f"n_{KINDS[k]}", F.lit(0)).cast("bigint").alias(f"n_{KINDS[k]}") for k in range(STRONG)]
    return rows.select(*keep, *zero, F.sha2(F.coalesce("__cs_base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
