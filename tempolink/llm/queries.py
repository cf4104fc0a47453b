"""The corpus operators' queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import encoding_digests
from .common import documents
from .exact_dedup import dedup_exact
from .jaccard import Rule, jaccard_components
from .media import media_digests
from .minhash import near_duplicates
from .packing import pack_documents
from .pii import span_digests
from .quality import score_quality
from .spelling import spelling_variants
from .suffix_dedup import repeat_digests
from .token_count import count_tokens
from .toxicity import score_toxicity
from .whitening import whiten


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op3_bpe_monoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(documents(spark, sf_dir)).drop("in_history")


def op7_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), Rule(words=3, num=90, den=100))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(documents(spark, sf_dir))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), top=4)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


def op13_minhash_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), Rule(words=5, num=85, den=100))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii_anchors,
        op2_best_fit_packing,
        op3_bpe_monoid,
        op4_quality_crf,
        op5_suffix_dedup,
        op6_exact_dedup,
        op7_toxicity_ftrl,
        op8_token_counts,
        op9_jaccard_join,
        op10_media_columns,
        op11_embedding_whitening,
        op12_spelling_variants,
        op13_minhash_chosen_path,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_pii_anchors": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        marked AS (
            SELECT r, 'email' AS kind, regexp_replace(t, '()([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)', '\1' || chr(1) || '\2' || chr(2), 'g') AS x FROM d
            UNION ALL SELECT r, 'ip', regexp_replace(t, '()([0-9]+(?:\.[0-9]+){3})', '\1' || chr(1) || '\2' || chr(2), 'g') FROM d
            UNION ALL SELECT r, 'card', regexp_replace(t, '()([0-9](?:[ -]?[0-9])+)', '\1' || chr(1) || '\2' || chr(2), 'g') FROM d
            UNION ALL SELECT r, 'phone', regexp_replace(t, '()(\+[0-9][ ().0-9-]+[0-9])', '\1' || chr(1) || '\2' || chr(2), 'g') FROM d
            UNION ALL SELECT r, 'url', regexp_replace(t, '(^|[^\p{L}\p{N}])((?:https?|HTTPS?|Https?|ftp|FTP|Ftp)://[^ \t-\r<>"'']+)', '\1' || chr(1) || '\2' || chr(2), 'g') FROM d
            UNION ALL SELECT r, 'iban', regexp_replace(t, '(^|[^\p{L}\p{N}])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4})*(?: ?[A-Z0-9]{1,3})?)', '\1' || chr(1) || '\2' || chr(2), 'g') FROM d
            UNION ALL SELECT r, 'account', regexp_replace(t, '((?:^|[^\p{L}\p{N}])(?:account|Account|ACCOUNT|acct|Acct|ACCT|iban|Iban|IBAN|ssn|Ssn|SSN|passport|Passport|PASSPORT|routing|Routing|ROUTING)(?: *(?i:number|no\.?|nr\.?)(?:[ :#=]+)| *[:#=][ :#=]*| +))([A-Z0-9-]+)', '\1' || chr(1) || '\2' || chr(2), 'g') FROM d
            UNION ALL SELECT r, 'secret', regexp_replace(t, '((?:^|[^\p{L}\p{N}])(?:token|Token|TOKEN|secret|Secret|SECRET|password|Password|PASSWORD|api_key|Api_key|API_KEY|apikey|Apikey|APIKEY) *[=:] *["'']?)([A-Za-z0-9_+/=-]{16,})', '\1' || chr(1) || '\2' || chr(2), 'g') FROM d),
        parts AS (SELECT r, kind, string_split(x, chr(1)) AS p FROM marked WHERE contains(x, chr(1))),
        nth AS (SELECT r, kind, p, unnest(range(2, len(p) + 1)) AS j FROM parts),
        found AS (SELECT r, kind, CAST(list_sum(list_transform(p[1:j - 1], lambda q: length(q))) - (j - 2) AS BIGINT) AS a, split_part(p[j], chr(2), 1) AS s, left(split_part(p[j], chr(2), 2), 1) AS after FROM nth),
        digits AS (SELECT r, kind, a, CASE WHEN kind = 'url' THEN rtrim(s, '.,;:!?)]}') ELSE s END AS s, after, regexp_replace(s, '[^0-9]', '', 'g') AS n, replace(s, ' ', '') AS v FROM found),
        good AS (
            SELECT r, CASE WHEN kind = 'iban' THEN 'account' ELSE kind END AS kind, a, a + length(s) AS z FROM digits WHERE CASE kind
                WHEN 'email' THEN true
                WHEN 'secret' THEN true
                WHEN 'ip' THEN len(list_filter(string_split(s, '.'), lambda q: NOT regexp_matches(q, '^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$'))) = 0
                WHEN 'phone' THEN length(n) BETWEEN 9 AND 15
                WHEN 'card' THEN length(n) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN (length(n) - i) % 2 = 0 THEN CAST(n[i] AS INTEGER) WHEN n[i] > '4' THEN 2 * CAST(n[i] AS INTEGER) - 9 ELSE 2 * CAST(n[i] AS INTEGER) END)) % 10 = 0
                WHEN 'url' THEN length(s) > position('://' IN s) + 2
                WHEN 'account' THEN length(s) BETWEEN 6 AND 34 AND length(n) >= 5
                ELSE length(v) BETWEEN 15 AND 34 AND NOT regexp_matches(after, '[\p{L}\p{N}]')
                    AND list_reduce(list_transform(string_split(v[5:] || v[1:4], ''), lambda q: CASE WHEN q BETWEEN '0' AND '9' THEN CAST(q AS BIGINT) ELSE CAST(ascii(q) - 55 AS BIGINT) END), lambda x, y: (x * CASE WHEN y > 9 THEN 100 ELSE 10 END + y) % 97) = 1 END),
        named AS (SELECT r, kind || ':' || a || ':' || z AS span, a, z, list_position(['email', 'ip', 'card', 'phone', 'url', 'account', 'secret'], kind) AS k FROM good),
        summed AS (
            SELECT r, count(*) FILTER (k = 1) AS n_email, count(*) FILTER (k = 2) AS n_ip, count(*) FILTER (k = 3) AS n_card, count(*) FILTER (k = 4) AS n_phone,
                string_agg(span, ',' ORDER BY a, k, z) FILTER (k <= 4) AS base, string_agg(span, ',' ORDER BY a, k, z) AS spans
            FROM named GROUP BY r)
        SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN summed USING (r)
    """,
    "op5_suffix_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
        -- windows by way of blocks of 100 bytes, as a slice costs its distance from the start
        p AS (SELECT r, 100 * k AS base, substr(h, 200 * k + 1, 598) AS part FROM (SELECT r, h, unnest(range(0, (octet_length(b) + 99) // 100)) AS k FROM d)),
        w AS (SELECT r, base + i AS i, substr(part, 2 * i - 1, 400) AS s FROM (SELECT r, base, part, unnest(range(1, least(100, length(part) // 2 - 199) + 1)) AS i FROM p)),
        k AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
        m AS (SELECT r, i FROM w JOIN k USING (s)),
        c AS (SELECT r, i + 0 AS pos, 1 AS n FROM m UNION ALL SELECT r, i + 200, -1 FROM m),
        e AS (SELECT r, pos, sum(n) AS n FROM c GROUP BY r, pos),
        t AS (SELECT r, pos, sum(n) OVER (PARTITION BY r ORDER BY pos) AS depth FROM e),
        u AS (SELECT r, pos, depth, coalesce(lag(depth) OVER (PARTITION BY r ORDER BY pos), 0) AS before FROM t),
        g AS (SELECT r, list(pos ORDER BY pos) FILTER (depth > 0 AND before = 0) AS lo, list(pos ORDER BY pos) FILTER (depth = 0) AS hi FROM u GROUP BY r)
        SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes,
          CAST(coalesce(list_sum(hi) - list_sum(lo), 0) AS BIGINT) AS n_removed, CAST(coalesce(len(lo), 0) AS BIGINT) AS n_spans,
          sha256(CASE WHEN lo IS NULL THEN b ELSE unhex(array_to_string(list_transform(range(0, len(lo) + 1),
             lambda j: h[(CASE WHEN j = 0 THEN 0 ELSE hi[j] - 1 END) * 2 + 1 : (CASE WHEN j = len(lo) THEN octet_length(b) ELSE lo[j + 1] - 1 END) * 2]), '')) END) AS kept_sha256
        FROM d LEFT JOIN g USING (r)
    """,
    "op6_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM t GROUP BY text_sha256)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
        FROM t JOIN g USING (text_sha256)
    """,
    "op9_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS words
            FROM documents),
        sh AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS s
            FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        link AS (
            SELECT a.doc_id AS x, b.doc_id AS y
            FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id
            JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
            WHERE 100 * least(na.n, nb.n) >= 90 * greatest(na.n, nb.n)
            GROUP BY a.doc_id, b.doc_id, na.n, nb.n
            HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
        both_ways AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
        reach AS (SELECT x AS doc_id, x AS hop FROM both_ways UNION SELECT r.doc_id, e.y FROM reach r JOIN both_ways e ON e.x = r.hop),
        low AS (SELECT doc_id, min(hop) AS component_id FROM reach GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(low.component_id, d.doc_id) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
    """,
    "op12_spelling_variants": r"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, run, count(*) AS c
            FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
            WHERE length(run) >= 7 GROUP BY doc_id, run),
        -- the crc32 by the table of its bytes
        bits AS (SELECT CAST(0 AS BIGINT) AS k, b, b AS v FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)
            UNION ALL SELECT k + 1, b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
        steps AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
        coded AS (
            SELECT doc_id, run, c, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
                lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END)) AS bytes
            FROM runs),
        hashed AS (
            SELECT run, c, xor(list_reduce(bytes, lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM coded, steps),
        made AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
        words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
        less AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
        pairs AS (
            SELECT a.word, b.word AS near, b.n AS m FROM less a JOIN less b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.s = b.word
            UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.s = b.word),
        best AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS near, max(m) AS m FROM pairs GROUP BY word),
        forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN near END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
        way AS (SELECT word, word AS root FROM forms UNION ALL SELECT w.word, f.form FROM way w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL),
        last AS (SELECT w.word, w.root FROM way w JOIN forms f ON f.word = w.root WHERE f.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN last USING (word)
    """,
    "op13_minhash_chosen_path": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS words
            FROM documents),
        sh AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS s
            FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        link AS (
            SELECT a.doc_id AS x, b.doc_id AS y
            FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id
            JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
            WHERE 100 * least(na.n, nb.n) >= 85 * greatest(na.n, nb.n)
            GROUP BY a.doc_id, b.doc_id, na.n, nb.n
            HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
        both_ways AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
        reach AS (SELECT x AS doc_id, x AS hop FROM both_ways UNION SELECT r.doc_id, e.y FROM reach r JOIN both_ways e ON e.x = r.hop),
        low AS (SELECT doc_id, min(hop) AS component_id FROM reach GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(low.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(low.component_id, d.doc_id) AS kept
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
    """,
}
