"""The ``opN_<name>`` queries: each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fingerprint, language_id, licenses, near_dedup, packing, pii, preference, prefix_trie, quality, resampling, sentencepiece_nbest, simhash
from .common import table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(table(spark, sf_dir, "documents"), vocabulary())


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.assign(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_neighbours(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return preference.format_pairs(turns, preference.neighbouring_pairs(turns))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations")).drop("place")


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.assign(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_sentencepiece_nbest": op4_sentencepiece_nbest,
    "op5_fingerprints": op5_fingerprints,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality": op7_quality,
    "op8_license_scan": op8_license_scan,
    "op9_preference_format": op9_preference_format,
    "op10_pii": op10_pii,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_simhash_near_dedup": op13_simhash_near_dedup,
}

def license_sql() -> str:
    """The same canonical form in DuckDB's words, over the same known texts."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    form = "replace(regexp_replace(lower(coalesce(text, '')), '(?m)^[^\\p{L}\\p{N}\\n]*(?:copyright\\b|\\(c\\)|©)[^\\n]*$', '', 'g'), 'all rights reserved', '')"
    form = f"regexp_replace({form}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    for spelling, same in licenses.EQUIVALENT:
        form = f"replace({form}, '{spelling}', '{same}')"
    one_line = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'), ' ')"
    values = ", ".join(f"({quoted(name)}, {quoted(t)})" for name, several in licenses.KNOWN.items() for t in several)
    long = ", ".join(f"({quoted(name)}, '{digest}', {quoted(first)}, {n})" for name, digest, first, n in licenses.LONG)
    blocks = f"list_filter(list_transform(string_split_regex(form, '\\n[ ]*\\n'), lambda p: {one_line('p')}), lambda p: p <> '')"
    return f"""
        WITH texts AS (SELECT license, form, {blocks} AS blocks FROM (SELECT license, {form} AS form FROM (VALUES {values}) AS v(license, text))
        ), known AS (
            SELECT license, sha256({one_line("form")}) AS digest, blocks[1] AS first, len(blocks) AS n FROM texts
            UNION SELECT * FROM (VALUES {long}) AS v(license, digest, first, n)
        ), starts AS (SELECT DISTINCT first, n FROM known WHERE n > 1
        ), d AS (SELECT doc_id, {form} AS form FROM documents
        ), b AS (SELECT doc_id, form, {blocks} AS blocks FROM d
        ), runs AS (
            SELECT doc_id, list(array_to_string(blocks[i : i + n - 1], ' ')) AS runs
            FROM (SELECT doc_id, blocks, n, first, unnest(range(1, len(blocks) - n + 2)) AS i FROM b JOIN starts ON list_contains(blocks, first))
            WHERE blocks[i] = first GROUP BY doc_id
        ), parts AS (
            SELECT doc_id, form, unnest(list_distinct(list_concat(
                [{one_line("form")}],
                list_filter(list_transform(string_split(form, chr(10)), lambda p: trim(p, ' ')), lambda p: p <> ''),
                blocks, coalesce(runs, [])))) AS part
            FROM b LEFT JOIN runs USING (doc_id)
        ), units AS (SELECT doc_id, sha256({one_line("form")}) AS text_digest, sha256(part) AS digest FROM parts)
        SELECT doc_id, text_digest, max(CASE WHEN units.digest = text_digest THEN license END) AS license, count(license) AS n_matches,
               coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses
        FROM units LEFT JOIN (SELECT DISTINCT license, digest FROM known) AS known ON known.digest = units.digest GROUP BY doc_id, text_digest
    """


def crc_sql(source: str, value: str) -> str:
    """CTEs that end in ``hashed`` (value, crc): the CRC-32 of each different ``value`` of ``source``, by its bytes."""
    return f"""crc_table AS (  -- remainders of the 256 bytes, by the reversed polynomial
            SELECT list_transform(range(256), lambda i: list_reduce(range(8),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS rest
        ), bytes AS (
            SELECT {value}, list_transform(range(octet_length(encode({value}))), lambda i: ('0x' || substr(hex(encode({value})), (2 * i + 1)::INT, 2))::BIGINT) AS b
            FROM ({source})
        ), hashed AS (
            SELECT {value}, xor(list_reduce(b, lambda c, x: xor(c >> 8, rest[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc
            FROM bytes, crc_table
        )"""


ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), links AS (
            SELECT x.doc_id AS a, y.doc_id AS b
            FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
            JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
            GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM n
            UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
        ), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id) AS component_id,
               w.doc_id = coalesce(component_id, w.doc_id) AS kept
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id
    """,
    "op6_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY norm)
    """,
    "op8_license_scan": license_sql(),
    "op9_preference_format": """
        WITH c AS (
            SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn, role, text) AS l FROM conversations GROUP BY conv_id
        ), p AS (SELECT DISTINCT conv_id // 2 AS pair_id FROM conversations
        ), m AS (
            SELECT pair_id, 2 * pair_id AS chosen_id, 2 * pair_id + 1 AS rejected_id, coalesce(x.l, []) AS a, coalesce(y.l, []) AS b
            FROM p LEFT JOIN c x ON x.conv_id = 2 * pair_id LEFT JOIN c y ON y.conv_id = 2 * pair_id + 1
        ), n AS (
            SELECT *, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false) - 1,
                               least(len(a), len(b))) AS k
            FROM m
        ), s AS (
            SELECT pair_id, chosen_id, rejected_id, k::BIGINT AS n_common, a[1:k] AS pre, a[k + 1:] AS c, b[k + 1:] AS r FROM n
        ), w AS (
            SELECT *,
                   list_transform(c, lambda t: length(t.r) + length(t.t) + 24) AS cl, list_transform(r, lambda t: length(t.r) + length(t.t) + 24) AS rl
            FROM s
        ), o AS (
            SELECT pair_id, chosen_id, rejected_id, n_common,
                   array_to_string(list_transform(pre, lambda t: '<|im_start|>' || t.r || chr(10) || t.t || '<|im_end|>' || chr(10)), '') AS prompt,
                   array_to_string(list_transform(c, lambda t: '<|im_start|>' || t.r || chr(10) || t.t || '<|im_end|>' || chr(10)), '') AS chosen,
                   array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].r = 'assistant'),
                       lambda i: (coalesce(list_sum(cl[1:i - 1]), 0) + 22)::BIGINT || ':' || (coalesce(list_sum(cl[1:i - 1]), 0) + 22 + length(c[i].t) + 10)::BIGINT), ',') AS chosen_mask,
                   array_to_string(list_transform(r, lambda t: '<|im_start|>' || t.r || chr(10) || t.t || '<|im_end|>' || chr(10)), '') AS rejected,
                   array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].r = 'assistant'),
                       lambda i: (coalesce(list_sum(rl[1:i - 1]), 0) + 22)::BIGINT || ':' || (coalesce(list_sum(rl[1:i - 1]), 0) + 22 + length(r[i].t) + 10)::BIGINT), ',') AS rejected_mask
            FROM w
        )
        SELECT *, chosen_mask <> '' AND rejected_mask <> '' AND chosen <> rejected AS usable FROM o
    """,
    "op11_importance_resampling": r"""
        WITH lower_docs AS (
            SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), words AS (SELECT doc_id, r, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lower_docs
        ), f AS (SELECT r, unnest(ws) AS w FROM words
        ), g AS (
            SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
            FROM benchmark
        ), """
    + crc_sql("SELECT w FROM f UNION SELECT w FROM g", "w")
    + r""", buckets AS (SELECT w, crc % 10000 AS bucket FROM hashed
        ), s AS (SELECT bucket, count(*)::DOUBLE AS s FROM f JOIN buckets USING (w) GROUP BY bucket
        ), t AS (SELECT bucket, count(*)::DOUBLE AS t FROM g JOIN buckets USING (w) GROUP BY bucket
        ), sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all
        ), gains AS (
            SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain
            FROM s LEFT JOIN t USING (bucket), sums
        ), weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM f JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY r
        ), scored AS (
            SELECT doc_id, r, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM words LEFT JOIN weights USING (r)
        ), placed AS (
            SELECT doc_id, r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
        )
        SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
        FROM scored LEFT JOIN placed USING (r)
    """,
    "op12_conversation_trie": r"""
        WITH c AS (
            SELECT conv_id, conv_id::VARCHAR AS name, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
                ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS l
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), """
    + crc_sql("SELECT name FROM c", "name")
    + r""", built AS (
            SELECT c.conv_id, list_concat(coalesce(b.l, [])[1 : (crc % 4)::INT], c.l[(crc % 4 + 1)::INT :]) AS l
            FROM c JOIN hashed USING (name) LEFT JOIN c b ON b.conv_id = c.conv_id - ((c.conv_id % 20) + 20) % 20
        ), p AS (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS depth FROM built
        ), members AS (SELECT conv_id, depth, l[1 : depth] AS node, len(l) = depth AS ended FROM p
        ), nodes AS (
            SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256,
                   CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(node[depth].t, '[^\x20\x09-\x0D]+')) END AS words
            FROM members GROUP BY node, depth
        ), children AS (SELECT node[1 : depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
        ), joined AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)
        ), above AS (SELECT node, n_convs, words, n_children, unnest(range(0, depth + 1)) AS up FROM joined
        ), sums AS (
            SELECT node[1 : up] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
            FROM above GROUP BY ALL
        )
        SELECT j.conv_id, j.depth, q.conv_id AS parent_conv_id, j.n_convs, j.n_children, n_leaves, saved_tokens, j.ends_sha256
        FROM joined j JOIN sums USING (node) LEFT JOIN joined q ON j.depth > 0 AND q.depth = j.depth - 1 AND q.node = j.node[1 : j.depth - 1]
    """,
}
