"""The registered queries of this package: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barrelbook.llm import archives, conversations, latent, lexical, licenses, packing, pages, quality, secrets, simhash, suffixes, topk, urls
from barrelbook.sources.readers import read_table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: SQL of the queries that it can express.
ORACLES: dict[str, str] = {}


def _query(function):
    REGISTRY[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


@_query
def op1_main_text(spark, folder):
    """Main text of every page."""
    return pages.main_texts(_table(spark, folder, "pages"))


def encoder():
    """The byte-pair vocabulary ``byte_bpe_50k``: merges of the rank file, added tokens of the JSON file."""
    ranks, vocabulary = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("tiktoken", "json"))
    return packing.byte_pair_encoder(ranks, public_tokenizers.PATTERN, vocabulary)


def piece_digests(docs):
    """Pieces of packed documents with a checksum of their ids."""
    found = packing.pack(docs, encoder())
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@_query
def op3_packing(spark, folder):
    """Where the tokens of every document lie in sequences of 1,024."""
    return piece_digests(_table(spark, folder, "documents"))


@_query
def op4_simhash(spark, folder):
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@_query
def op5_quality(spark, folder):
    """Quality score of every document, learned from labels that are not held out."""
    return quality.scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query
def op6_topk(spark, folder):
    """The five best rows for every fiftieth vector."""
    return topk.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op6_topk"] = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


@_query
def op8_suffix_dedup(spark, folder):
    """What exact repeats of 200 bytes cover in every document."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    kept = ("kept", suffixes.kept_bytes, lambda text: F.coalesce(text, F.lit("")).cast("binary"))
    marked = suffixes.with_repeated_spans(docs, "spans", kept=kept)
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return marked.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s.end - s.start).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


@_query
def op9_url_filter(spark, folder):
    """Verdict on the URL of every page."""
    return urls.judge(_table(spark, folder, "pages"), URL_RULES)


@_query
def op10_archives(spark, folder):
    """Every page written to packaged web archives and read back."""
    records = archives.round_trip(_table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op7_decontamination(spark, folder):
    """Documents that hold passages of benchmark items, with the evidence."""
    found = latent.leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.drop("th")


@_query
def op2_licenses(spark, folder):
    """Licenses that the documents hold, with coverage and spans."""
    return licenses.licenses(_table(spark, folder, "documents"))


@_query
def op12_conversation_repair(spark, folder):
    """Faults and cheapest repair of every conversation after damage."""
    return conversations.repaired_digests(_table(spark, folder, "conversations"))


ORACLES["op12_conversation_repair"] = r"""
WITH RECURSIVE given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
    FROM conversations
), marked AS (  -- CRC-32, a byte at a time
    SELECT *, xor(list_reduce(
        list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda acc, byte: xor(acc >> 8, list_reduce(
            list_concat([xor(acc, byte) & 255], list_transform(range(8), lambda i: CAST(0 AS BIGINT))),
            lambda x, i: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1))))), CAST(4294967295 AS BIGINT)) % 20 AS kind
    FROM given
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM marked WHERE kind <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
           rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed
    FROM damaged
), faulty AS (
    SELECT *, CASE WHEN trimmed = '' THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                   WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before, 
           count(*) OVER (PARTITION BY conv_id) AS n
    FROM placed
), all_ids AS (SELECT DISTINCT conv_id FROM conversations),
steps AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS pos, [{'c': CAST(0 AS BIGINT), 'a': '', 'q': 0, 't': ''}] AS states FROM all_ids
    UNION ALL
    SELECT conv_id, pos, list_filter(list_transform([0, 1, 2, 3], lambda q: list_sort(list_filter(moved, lambda s: s.q = q))[1]), lambda s: s IS NOT NULL)
    FROM (
        SELECT f.conv_id, f.pos, list_concat(
            list_transform(s.closed, lambda s: {'c': s.c + 3, 'a': s.a || 'D', 'q': s.q, 't': s.t}),
            CASE WHEN f.fault IN ('blank', 'duplicate') THEN [] ELSE list_transform(
                list_filter(s.closed, lambda s: f.initial = '' OR (f.initial = 's' AND s.q = 0) OR (f.initial = 'u' AND s.q <> 2) OR (f.initial = 'a' AND s.q = 2)),
                lambda s: {'c': s.c + CAST(f.fault = 'truncated' AS INT), 'a': s.a || 'K',
                      'q': CASE f.initial WHEN '' THEN s.q WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 't': s.t || f.role || ':' || f.text || chr(10)}) END,
            CASE WHEN f.fault IN ('blank', 'duplicate') THEN [] ELSE list_transform(s.closed, lambda s:
                {'c': s.c + 2 + CAST(f.fault = 'truncated' AS INT), 'a': s.a || 'R', 'q': CASE WHEN s.q = 2 THEN 3 ELSE 2 END,
                 't': s.t || CASE WHEN s.q = 2 THEN 'assistant:' ELSE 'user:' END || f.text || chr(10)}) END) AS moved
        FROM (
            SELECT conv_id, pos, list_concat(once, list_transform(once, lambda s: {'c': s.c + 2, 'a': s.a || 'I', 'q': CASE WHEN s.q = 2 THEN 3 ELSE 2 END,
                     't': s.t || CASE WHEN s.q = 2 THEN 'assistant:' ELSE 'user:' END || chr(10)})) AS closed
            FROM (SELECT conv_id, pos, list_concat(states, list_transform(states, lambda s: {'c': s.c + 2, 'a': s.a || 'I', 'q': CASE WHEN s.q = 2 THEN 3 ELSE 2 END,
                     't': s.t || CASE WHEN s.q = 2 THEN 'assistant:' ELSE 'user:' END || chr(10)})) AS once FROM steps)
        ) s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.pos = s.pos + 1
    )
), ended AS (
    SELECT s.conv_id, list_sort(list_filter(list_concat(once, list_transform(once, lambda s: {'c': s.c + 2, 'a': s.a || 'I', 'q': CASE WHEN s.q = 2 THEN 3 ELSE 2 END,
                     't': s.t || CASE WHEN s.q = 2 THEN 'assistant:' ELSE 'user:' END || chr(10)})), lambda s: s.q IN (0, 3)))[1] AS best
    FROM (SELECT conv_id, pos, list_concat(states, list_transform(states, lambda s: {'c': s.c + 2, 'a': s.a || 'I', 'q': CASE WHEN s.q = 2 THEN 3 ELSE 2 END,
                     't': s.t || CASE WHEN s.q = 2 THEN 'assistant:' ELSE 'user:' END || chr(10)})) AS once,
                 row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS back FROM steps) s
    WHERE back = 1
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
       sha256(left(best.t, length(best.t) - 1)) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@_query
def op11_lexical_search(spark, folder):
    """The ten best documents for every benchmark item."""
    return lexical.ranked(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


ORACLES["op11_lexical_search"] = r"""
WITH doc_terms AS (
    SELECT doc, any_value(doc_id) AS doc_id, term, count(*) AS tf
    FROM (SELECT row_number() OVER () AS doc, doc_id,
                 unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM documents)
    GROUP BY doc, term
), lengths AS (SELECT doc, CAST(sum(tf) AS BIGINT) AS n FROM doc_terms GROUP BY doc),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
held AS (SELECT term, count(*) AS df FROM doc_terms GROUP BY term),
item_terms AS (
    SELECT item, any_value(item_id) AS item_id, term, count(*) AS qtf
    FROM (SELECT row_number() OVER () AS item, item_id,
                 unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM benchmark)
    GROUP BY item, term
), scored AS (
    SELECT item, any_value(i.item_id) AS item_id, any_value(d.doc_id) AS doc_id, CAST(sum(
        qtf * CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT)
        * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
    FROM item_terms i JOIN held USING (term) JOIN doc_terms d USING (term) JOIN lengths l USING (doc), totals
    GROUP BY item, doc
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""


@_query
def op13_secrets(spark, folder):
    """Secrets in every document, by rules and by the model."""
    return secrets.digests(_table(spark, folder, "documents"))


ORACLES["op13_secrets"] = r"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS t0 FROM documents),
rules AS (SELECT * FROM (VALUES
    (0, 'assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
    (1, 'access', 'AKIA[A-Z0-9]{12,}'), (2, 'hex', '[0-9a-f]{32,}')) AS rules(number, kind, pattern)
), m1 AS (
    SELECT d, doc_id, t0, CASE WHEN regexp_matches(t0, pattern) THEN array_to_string(list_transform(
        list_zip(string_split_regex(t0, pattern), regexp_extract_all(t0, pattern)),
        lambda z: z[1] || CASE WHEN length(regexp_extract(coalesce(z[2], ''), pattern, 2)) >= 8 THEN repeat(' ', length(z[2])) ELSE coalesce(z[2], '') END), '') ELSE t0 END AS t1
    FROM docs, rules WHERE number = 0
), m2 AS (
    SELECT d, doc_id, t0, array_to_string(list_transform(
        list_zip(string_split_regex(t1, pattern), regexp_extract_all(t1, pattern)), lambda z: z[1] || repeat(' ', length(coalesce(z[2], '')))), '') AS t2
    FROM m1, rules WHERE number = 1
), m3 AS (
    SELECT d, doc_id, t0, array_to_string(list_transform(
        list_zip(string_split_regex(t2, pattern), regexp_extract_all(t2, pattern)), lambda z: z[1] || repeat(' ', length(coalesce(z[2], '')))), '') AS rest
    FROM m2, rules WHERE number = 2
), scanned AS (
    SELECT d, number, kind, pattern, t0 AS text FROM docs, rules
    UNION ALL SELECT d, 3, 'random', '[A-Za-z0-9+/_-]{16,}={0,2}', rest FROM m3
), matched AS (
    SELECT d, number, kind, pattern, unnest(found) AS match, unnest(between[:len(found)]) AS gap, unnest(range(len(found))) AS i
    FROM (SELECT *, regexp_extract_all(text, pattern) AS found, string_split_regex(text, pattern) AS between FROM scanned)
), placed AS (
    SELECT *, sum(length(gap) + length(match)) OVER (PARTITION BY d, number ORDER BY i) AS stop FROM matched
), found AS (
    SELECT d, number, kind, match, CAST(stop - length(match) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop,
           CASE WHEN number = 0 THEN regexp_extract(match, pattern, 2) ELSE match END AS value
    FROM placed
), kept AS (SELECT * FROM found WHERE number > 0 OR length(value) >= 8),
generated AS (
    SELECT sha256(CAST(id AS VARCHAR)) AS digest,
           to_base64(unhex(sha256(CAST(id AS VARCHAR) || ':a') || sha256(CAST(id AS VARCHAR) || ':b'))) AS more
    FROM range(4096) AS ids(id)
), samples AS (
    SELECT value AS string, 'random' AS label FROM kept WHERE number < 3
    UNION SELECT unnest([left(digest, 40), left(upper(translate(more, '+/=', '')), 40), left(translate(more, '+/=', ''), 40), left(more, 40)]), 'random' FROM generated
    UNION SELECT string, 'ordinary' FROM (SELECT unnest(regexp_extract_all(rest, '[A-Za-z0-9+/_-]{8,}={0,2}')) AS string FROM m3)
    WHERE regexp_matches(string, '^([A-Za-z]+[0-9]{0,4}|[0-9]+)([+/_=-]+([A-Za-z]+[0-9]{0,4}|[0-9]+))*[+/_=-]*$')
), steps AS (
    SELECT before, after, count(*) FILTER (label = 'random') AS r, count(*) FILTER (label = 'ordinary') AS o
    FROM (SELECT label, unnest(list_transform(range(1, length(string) + 1), lambda i: CASE WHEN i = 1 THEN '' ELSE string[i - 1] END)) AS before,
                 unnest(list_transform(range(1, length(string) + 1), lambda i: string[i])) AS after FROM samples)
    GROUP BY before, after
), befores AS (SELECT before, CAST(sum(r) AS BIGINT) AS rb, CAST(sum(o) AS BIGINT) AS ob FROM steps GROUP BY before),
afters AS (SELECT after, CAST(sum(r) AS BIGINT) AS ra, CAST(sum(o) AS BIGINT) AS oa FROM steps GROUP BY after),
every AS (SELECT CAST(sum(r) AS BIGINT) AS re, CAST(sum(o) AS BIGINT) AS oe FROM steps),
judged AS (
    SELECT d, start, sum(CAST(floor(1000 * ln(
        ((coalesce(r, 0) + 67 * (CAST(coalesce(ra, 0) + 1 AS DOUBLE) / (re + 67))) / (coalesce(rb, 0) + 67))
        / ((coalesce(o, 0) + 67 * (CAST(coalesce(oa, 0) + 1 AS DOUBLE) / (oe + 67))) / (coalesce(ob, 0) + 67)))) AS BIGINT)) AS score
    FROM (SELECT d, start, unnest(list_transform(range(1, length(match) + 1), lambda i: CASE WHEN i = 1 THEN '' ELSE match[i - 1] END)) AS before,
                 unnest(list_transform(range(1, length(match) + 1), lambda i: match[i])) AS after FROM kept WHERE number = 3)
    LEFT JOIN steps USING (before, after) LEFT JOIN befores USING (before) LEFT JOIN afters USING (after), every GROUP BY d, start
), chosen AS (
    SELECT k.* FROM kept k LEFT JOIN judged j ON j.d = k.d AND j.start = k.start AND k.number = 3 WHERE k.number < 3 OR j.score >= 12000
), summed AS (
    SELECT d, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) FILTER (number < 3) AS base,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) AS spans
    FROM chosen GROUP BY d
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN summed USING (d)
"""
