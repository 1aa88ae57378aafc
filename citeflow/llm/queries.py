"""The operators of this subpackage as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.llm import bpe, jaccard, langid, packing, prefix_trie, quality, secrets, simhash, topk, toxic, turn_repair, urlfilter, warc
from citeflow.llm.frames import label_share, read

BYTE_BPE = "byte_bpe_50k.json"

URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size)
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html", headers.alias("headers"))
    records = warc.responses(pages, headers="headers")
    return warc.derive(records, keep=["page_id"])


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op4_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxic.train(docs.where(label_share("doc_id") != 0), labels)
    scored = toxic.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (label_share("doc_id") == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    digests = bpe.round_trip_digests(F.col("text"), public_tokenizers.path(BYTE_BPE), bpe.PATTERN)
    return docs.select("doc_id", digests.alias("d")).select("doc_id", "d.*")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read(spark, sf_dir, "documents")).select("doc_id", "spans")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.concat_ws(",", parts)

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id",
        *[count(kind) for kind in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs.where(label_share("doc_id") != 0))
    held_out = (label_share("doc_id") == 0).alias("held_out")
    return langid.add_language(docs.select("doc_id", "text", held_out), model).drop("text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_conversations(read(spark, sf_dir, "conversations"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_derivatives,
        op2_ngram_jaccard,
        op3_best_fit_packing,
        op4_toxicity_crf,
        op5_exact_top_k,
        op6_bpe_round_trip,
        op7_secret_scan,
        op8_quality_rules,
        op9_url_filter,
        op10_language_id,
        op11_conversation_repair,
        op12_conversation_trie,
        op13_simhash_near_dedup,
    )
}

#: crc32 has no SQL function: a table of the bytes' remainders, and a fold over an ASCII text's bytes.
CRC_TABLE = """
        crc AS (SELECT list(v ORDER BY i) AS remainders FROM (
            SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                                  lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
            FROM range(256) r(i)))"""


def _crc32(text: str) -> str:
    fold = "lambda x, y: xor(x >> 8, remainders[(xor(x, y) & 255) + 1])"
    return f"xor(list_reduce([4294967295]::BIGINT[] || list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)), {fold}), 4294967295)"


def _edit(costs_and_audit: str, cost: str, letter: str) -> str:
    """Nine digits of cost, then the audit: the smaller text is the better prefix."""
    v = costs_and_audit
    return f"lpad(CAST(CAST(left({v}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({v}, 10) || '{letter}'"


_REPAIR_SQL = rf"""
        WITH RECURSIVE {CRC_TABLE},
        coded AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS code
            FROM conversations, crc),
        hurt AS (
            SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
                   CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
            FROM coded WHERE code <> 0),
        placed AS (
            SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
        turns AS (
            SELECT conv_id, turn, role, text, i,
                   CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'b'
                        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                        WHEN regexp_matches(text, '[^.!? 	-][ 	-]*\z') THEN 't' ELSE 'k' END AS fault,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
            FROM placed),
        counts AS (
            SELECT conv_id, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
                   count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM turns GROUP BY conv_id),
        searched AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS none, CAST(NULL AS VARCHAR) AS system, CAST(NULL AS VARCHAR) AS asked, CAST(NULL AS VARCHAR) AS answered
            FROM conversations
            UNION ALL
            SELECT conv_id, i + 1, {_edit("none", "4", "D")},
                   least({_edit("system", "4", "D")}, CASE WHEN kept AND who = 's' THEN {_edit("none", "cut", "K")} END),
                   least({_edit("asks", "4", "D")}, CASE WHEN kept AND who = 'u' THEN {_edit("may_ask", "cut", "K")} END, CASE WHEN kept THEN {_edit("may_ask", "3 + cut", "R")} END),
                   least({_edit("answers", "4", "D")}, CASE WHEN kept AND who = 'a' THEN {_edit("asks", "cut", "K")} END, CASE WHEN kept THEN {_edit("asks", "3 + cut", "R")} END)
            FROM (
                SELECT conv_id, i, none, system, asks, least(answered, {_edit("asks", "3", "I")}) AS answers,
                       least(none, system, answered, {_edit("asks", "3", "I")}) AS may_ask,
                       left(role, 1) AS who, fault IN ('k', 't') AS kept, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS cut
                FROM (SELECT s.*, t.role, t.fault, least(s.asked, {_edit("s.none", "3", "I")}, {_edit("s.system", "3", "I")}, {_edit("s.answered", "3", "I")}) AS asks
                      FROM searched s JOIN turns t ON t.conv_id = s.conv_id AND t.i = s.i + 1))),
        ended AS (
            SELECT conv_id, least(none, answered, {_edit("asks", "3", "I")}) AS best
            FROM (SELECT s.*, least(s.asked, {_edit("s.none", "3", "I")}, {_edit("s.system", "3", "I")}, {_edit("s.answered", "3", "I")}) AS asks
                  FROM searched s LEFT JOIN counts c ON c.conv_id = s.conv_id WHERE s.i = coalesce(c.n, 0))),
        edits AS (
            SELECT conv_id, e, count(*) FILTER (e <> 'I') OVER before AS i, count(*) FILTER (e <> 'D') OVER before AS place
            FROM (SELECT conv_id, j, substr(best, 9 + j, 1) AS e FROM (SELECT conv_id, best, unnest(range(1, length(best) - 8)) AS j FROM ended))
            WINDOW before AS (PARTITION BY conv_id ORDER BY j)),
        spoken AS (
            SELECT e.conv_id, place, e, role, CASE WHEN e = 'I' THEN '' ELSE text END AS text,
                   max(CASE WHEN e = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS systems
            FROM edits e LEFT JOIN turns t ON t.conv_id = e.conv_id AND t.i = e.i AND e <> 'I' WHERE e <> 'D'),
        repaired AS (
            SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (place - systems) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS whole
            FROM spoken GROUP BY conv_id)
        SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(left(best, 9) AS BIGINT) AS cost,
               substr(best, 10) AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
        FROM ended LEFT JOIN counts USING (conv_id) LEFT JOIN repaired USING (conv_id)
    """

_TRIE_SQL = rf"""
        WITH {CRC_TABLE},
        turns AS (
            SELECT conv_id AS c, md5(strlen(r) || ':' || r || t) AS id, strlen(t) AS bytes,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(r) || ':' || r || t)) AS i
            FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
        convs AS (SELECT c, c - c % 5 AS base, {_crc32("CAST(c AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT c FROM turns), crc),
        rebuilt AS (
            SELECT c, id, bytes, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d
            FROM (SELECT v.c, id, bytes, i, 0 AS own FROM convs v JOIN turns t ON t.c = v.base AND i <= h
                  UNION ALL SELECT v.c, id, bytes, i, 1 FROM convs v JOIN turns t ON t.c = v.c AND i > h)),
        members AS (
            SELECT c, d, bytes, d = max(d) OVER (PARTITION BY c) AS last, string_agg(id, '') OVER (PARTITION BY c ORDER BY d) AS path FROM rebuilt
            UNION ALL SELECT c, 0, 0, c NOT IN (SELECT c FROM rebuilt), '' FROM convs),
        nodes AS (
            SELECT path, min(c) AS conv_id, min(d) AS depth, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
                   sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
            FROM members GROUP BY path),
        linked AS (
            SELECT n.*, p.path AS above, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND left(k.path, length(n.path)) = n.path) AS n_children
            FROM nodes n LEFT JOIN nodes p ON p.path = left(n.path, length(n.path) - 32) AND n.depth > 0),
        below AS (
            SELECT m.path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
            FROM linked n JOIN members m ON m.c = n.conv_id AND m.d <= n.depth GROUP BY m.path)
        SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
        FROM linked JOIN below USING (path)
    """

ORACLES = {
    "op11_conversation_repair": _REPAIR_SQL,
    "op12_conversation_trie": _TRIE_SQL,
    "op2_ngram_jaccard": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) >= 3
                                THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
            FROM words),
        elements AS (SELECT doc_id, unnest(s) AS g FROM sets),
        pairs AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM elements a JOIN elements b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT x, y FROM pairs JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y
            WHERE 100 * c >= 90 * (len(p.s) + len(q.s) - c)),
        reached(id, other) AS (
            SELECT doc_id, doc_id FROM sets
            UNION
            SELECT id, y FROM reached JOIN (FROM links UNION ALL SELECT y, x FROM links) e ON e.x = other)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, low AS component_id
        FROM sets JOIN (SELECT id, min(other) AS low FROM reached GROUP BY id) ON id = doc_id
    """,
    "op8_quality_rules": r"""
        WITH words AS (
            SELECT doc_id, lang, coalesce(text, '') AS t,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents),
        windows AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
        repeated AS (
            SELECT doc_id, count(DISTINCT i + d) AS n FROM windows, (VALUES (0), (1), (2)) v(d) WHERE n > 1 GROUP BY doc_id),
        lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words),
        counts AS (
            SELECT doc_id, lang, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                   length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
                   coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines,
                   length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_capitals
            FROM words JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
        shares AS (
            SELECT doc_id, lang, unnest(['symbol', 'line', 'word', 'capital']) AS rule,
                   unnest([CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END,
                           CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END,
                           CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END,
                           CASE WHEN word_chars > 0 THEN n_capitals / word_chars ELSE 0.0 END]) AS share
            FROM counts),
        labelled AS (
            SELECT lang, rule, share, good
            FROM shares JOIN (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id)),
        tested AS (
            SELECT lang, rule, cutoff, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND share > cutoff) AS k,
                   count(*) FILTER (WHERE NOT good AND share > cutoff) AS bad
            FROM labelled, (SELECT unnest(range(1, 50)) / 50 AS cutoff) GROUP BY ALL HAVING n > 0),
        proven AS (
            SELECT lang, rule, cutoff, bad - k AS gain
            FROM tested, (SELECT count(*) AS m FROM (SELECT DISTINCT lang, rule FROM tested))
            WHERE bad > 0 AND k < n * 0.005 AND list_sum(list_transform(range(0, k + 1), lambda i: exp(
                lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005) + (n - i) * ln(0.995)))) <= 0.05 / m),
        cutoffs AS (SELECT lang, rule, cutoff FROM proven QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, cutoff DESC) = 1),
        rejected AS (
            SELECT DISTINCT doc_id FROM shares s JOIN cutoffs c ON s.lang IS NOT DISTINCT FROM c.lang AND s.rule = c.rule WHERE share > cutoff)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
               CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
        FROM counts
    """,
    "op5_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM scores
        QUALIFY rank <= 20
    """,
    "op9_url_filter": r"""
        WITH parts AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
            FROM pages),
        rules(verdict, rule, h, p) AS (VALUES
            ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
            ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
            ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
        hits AS (
            SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
            FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
            GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parts LEFT JOIN hits USING (page_id)
    """,
}
