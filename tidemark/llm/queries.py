"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import credentials, exactdedup, filteraudit, htmltext, langid, lzprint, mixing, piece, simhash, tokalign, toxicity, urlfilter, warc

#: The vocabularies that the queries encode with.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(_remainder(3) != 1))
    return langid.identify(docs, model, ["doc_id"]).select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.digests(_table(spark, sf_dir, "documents"), PIECE_MODEL, ["doc_id"])


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.decisions(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), ["page_id"]).select("page_id", "host", "path", "rule", "verdict")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scorer = toxicity.fit(docs, labels.where(_remainder(4) != 2))
    found = toxicity.score(docs, scorer, ["doc_id"])
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.merged(warc.read(archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = mixing.copies(docs)
    return found.select("doc_id", "source", F.col("__mx_tokens").alias("n_tokens"), F.col("__mx_copies").alias("copies"), F.round("__mx_share", 9).alias("share"), F.round("__mx_weight", 9).alias("weight"))


def op9_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.edited_pairs(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.components(simhash.fingerprints(docs, ["doc_id"]), "doc_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return filteraudit.audit(docs, labels)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokalign.align(_table(spark, sf_dir, "documents"), BYTE_MODEL, PIECE_MODEL, ["doc_id"])


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan(_table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_sentencepiece, op3_html_text, op4_exact_dedup, op5_url_filter, op6_toxicity, op7_warc, op8_mixing, op9_lz_fingerprint, op10_simhash, op11_filter_audit, op12_token_alignment, op13_secret_scan)
}



def _spans_sql() -> str:
    """Spans by splitting, running sums and a join over each text's parts; patterns with letters in either case spelled out."""
    value = """["']?\\x20*[:=]\\x20*["']?"""
    either = lambda words: "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in words)
    assign = f"({either(('password', 'passwd', 'secret', 'token', 'api_?key'))}){value}([A-Za-z0-9+/_.=-]+)"
    ident = f"({either(('access_?key(_?id)?', 'client_?id', 'account(_?id)?', 'user(_?name|_?id)?', 'login'))}){value}([A-Za-z0-9@._-]+)"
    weak = f"({either(('pwd', 'pass(phrase|code)?', 'credential', 'private_?key', 'signature', 'auth'))}){value}([A-Za-z0-9+/_.=-]+)|[A-Za-z0-9+/]{{40,}}={{0,2}}"
    tail = lambda p, g: f"length(regexp_extract(hit, {p}, {g}))"
    q = lambda p: "'" + p.replace("'", "''") + "'"
    rules = (
        (assign, f"{tail(q(assign), 2)} >= 6"), ("AKIA[A-Z0-9]+", "length(hit) >= 20"), ("[0-9a-f]+", "length(hit) >= 24"), (ident, f"{tail(q(ident), 5)} >= 3"),
        (weak, "length(hit) >= 10 AND (NOT regexp_full_match(hit, '[A-Za-z0-9+/]{40,}={0,2}') OR regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[0-9]'))"),
        (credentials.PATTERNS["endpoint"][0], "length(hit) >= 8"))
    found = " UNION ALL ".join(
        f"""SELECT x, {k} AS kind, pos - length(hit) AS "start", pos AS "end" FROM (SELECT x, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY x ORDER BY nth) AS pos FROM (
          SELECT x, unnest(regexp_extract_all(x, {q(p)}, 0)) AS hit, unnest(string_split_regex(x, {q(p)})[:-2]) AS gap, unnest(range(len(regexp_extract_all(x, {q(p)}, 0)))) AS nth FROM t)) WHERE {ok}"""
        for k, (p, ok) in enumerate(rules))
    names = "[" + ", ".join(f"'{k}'" for k in credentials.KINDS) + "]"
    return f"""
        WITH t AS (SELECT DISTINCT coalesce(text, '') AS x FROM documents), f AS ({found}),
        s AS (SELECT *, [{', '.join(map(str, credentials.ROLES))}][kind + 1] AS role, [{', '.join(map(str, credentials.NEEDS))}][kind + 1] AS needs FROM f
          WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM f g WHERE g.x = f.x AND g.kind < 3 AND g."start" < f."end" AND f."start" < g."end")),
        w AS (SELECT s.x, s.kind, s."start", s."end" FROM s JOIN s o ON o.x = s.x AND o.role <> s.role AND o."start" - s."end" <= {credentials.SCOPE} AND s."start" - o."end" <= {credentials.SCOPE}
          WHERE s.kind >= 3 GROUP BY s.x, s.kind, s."start", s."end", s.needs HAVING bit_or(o.role) & s.needs = s.needs),
        a AS (SELECT x, kind, "start", {names}[kind + 1] || ':' || "start" || ':' || "end" AS said FROM (SELECT x, kind, "start", "end" FROM s WHERE kind < 3 UNION ALL SELECT * FROM w)),
        g AS (SELECT x, count_if(kind = 0) AS n_assign, count_if(kind = 1) AS n_access, count_if(kind = 2) AS n_hex, string_agg(said, ',' ORDER BY "start", kind) FILTER (WHERE kind < 3) AS base, string_agg(said, ',' ORDER BY "start", kind) AS spans FROM a GROUP BY x)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents LEFT JOIN g ON g.x = coalesce(text, '')"""


ORACLE_SQL: dict[str, str] = {
    "op11_filter_audit": r"""
        WITH x AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
        d AS (SELECT part, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > 10 * length(x), regexp_matches(x, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false)] AS f,
          EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = x.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = x.doc_id AND toxic = 1) AS toxic FROM x),
        c AS (SELECT part, f, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM d GROUP BY ALL), l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
        o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        s AS (SELECT c.*, o, k.i AS step, f[o[k.i]] AS fails, len(list_filter(o[:k.i - 1], lambda j: f[j])) > 0 AS gone, o[k.i] AS filter FROM c, o, l k),
        m AS (SELECT part, array_to_string(list_transform(o, lambda j: chr(64 + j)), '') AS filter_order, CAST(step AS INTEGER) AS step, filter, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS removed,
          coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails AND len(list_filter(f, lambda y: y)) = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0) AS toxic_lost
          FROM s GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, filter) AS shapley FROM m""",
    "op13_secret_scan": _spans_sql(),
    "op8_mixing": f"""
        WITH d AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS s, greatest(1, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT)) AS t,
          md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS draw FROM documents),
        n AS (SELECT greatest(1, CAST(ceil(count(*) / {mixing.BLOCK_ROWS}) AS BIGINT)) AS blocks FROM documents),
        b AS (SELECT d.*, CAST('0x' || substr(draw, 1, 12) AS BIGINT) % blocks AS block FROM d, n),
        src AS (SELECT s, sum(t) AS tokens FROM d GROUP BY s), p AS (SELECT *, tokens / sum(tokens) OVER () AS share FROM src),
        a AS (SELECT CASE WHEN max(share) / min(share) <= 1 THEN 1 ELSE greatest(0, 1 - ln({mixing.REPETITION_LIMIT}) / ln(max(share) / min(share))) END AS e FROM p),
        w AS (SELECT s, tokens, share, pow(share, e) / sum(pow(share, e)) OVER () AS weight FROM p, a), g AS (SELECT *, weight * max(tokens / weight) OVER () AS budget FROM w),
        k AS (SELECT s, block, sum(t) AS t FROM b GROUP BY s, block),
        o AS (SELECT s, block, sum(t) OVER (PARTITION BY s ORDER BY md5('{mixing.SEED}|' || s || '|' || block), block ROWS UNBOUNDED PRECEDING) - t AS gone FROM k),
        r AS (SELECT b.*, sum(t) OVER (PARTITION BY s, block ORDER BY substr(draw, 13, 20), draw ROWS UNBOUNDED PRECEDING) - t AS place FROM b)
        SELECT doc_id, source, t AS n_tokens, CAST(floor(round(budget / tokens, 9)) + CASE WHEN gone + place < round(budget - floor(round(budget / tokens, 9)) * tokens, 3) THEN 1 ELSE 0 END AS BIGINT) AS copies,
          round(share, 9) AS share, round(weight, 9) AS weight FROM r JOIN o USING (s, block) JOIN g USING (s)""",
    "op4_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY x)""",
    "op7_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN payload_bytes >= 100 AND page_id <> head THEN head END AS refers_to FROM f""",
    "op5_url_filter": """
        WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        c AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, regexp_extract(rest, '^[^?#]*') AS hp FROM u),
        p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(hp, length(h) + 1) AS path FROM c),
        r AS (SELECT *, CASE
            WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
            WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
            WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
            WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM p)
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN host || path LIKE '%casino%' OR host || path LIKE '%spam-farm.%' OR host || path LIKE '%cheap-pills.%' OR host || path LIKE '%/ads/%'
              OR host || path LIKE '%.exe' OR host || path LIKE '%.zip' OR host || path LIKE 'adserver.%' OR host || path LIKE '%tracker_.%' THEN 'block'
            ELSE 'allow' END AS verdict FROM r""",
}
