"""DuckDB SQL for the rows of the contract queries, where SQL can express them: plain statements of what is asked, not of the method."""

from __future__ import annotations

from tessera.llm.licenses import BLOCK, NOTICES, PHRASES, STRIDE

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _spaced(text: str) -> str:
    return rf"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def _license_sql() -> str:
    rules = ", ".join(f"('{t.label}', string_split('{t.words}', ' '), {t.threshold}, {t.phrase})" for t in PHRASES + NOTICES)
    return f"""
        WITH t AS (
            SELECT label, phrase, words, len(list_distinct(words)) AS size, CAST(ceil(round(threshold * len(list_distinct(words)), 9)) AS BIGINT) AS need
            FROM (VALUES {rules}) x(label, words, threshold, phrase)
        ), d AS (
            SELECT doc_id, {_LETTERS} AS w FROM documents
        ), b AS (
            SELECT doc_id, list_distinct(w[k + 1 : k + {BLOCK}]) AS own FROM (SELECT doc_id, w, unnest(range(0, len(w), {STRIDE})) AS k FROM d)
        ), shares AS (
            SELECT doc_id, label, phrase, len(list_intersect(own, words)) / size AS share FROM b, t WHERE len(list_intersect(own, words)) >= need
        ), places AS (
            SELECT doc_id, label, k FROM (SELECT doc_id, w, label, words, unnest(range(0, len(w) - len(words) + 1)) AS k FROM d, t WHERE phrase) WHERE w[k + 1 : k + len(words)] = words
        ), base AS (
            SELECT doc_id, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id
        ), found AS (
            SELECT doc_id, label, share FROM shares WHERE NOT phrase UNION ALL SELECT DISTINCT doc_id, label, 1.0 FROM places
        ), named AS (
            SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY doc_id
        )
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
        FROM d LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id)
    """


ORACLE_SQL: dict[str, str] = {
    "op1_benchmark_decontamination": f"""
        WITH d AS (
            SELECT doc_id, {_LETTERS} AS w FROM documents
        ), i AS (
            SELECT item_id, {_LETTERS} AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k + 1 : k + 10], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)
        ), places AS (
            SELECT doc_id, k, n, array_to_string(w[k + 1 : k + n], ' ') AS s
            FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM windows))
        ), hits AS (
            SELECT DISTINCT doc_id, k, n, item_id FROM places JOIN windows USING (n, s)
        ), covered AS (
            SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id
        ), dw AS (
            SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d
        ), iw AS (
            SELECT item_id, unnest(w) AS word, unnest(range(0, len(w))) AS ipos FROM i
        ), counted AS (
            SELECT word, count(*) AS df FROM dw WHERE word IN (SELECT word FROM iw) GROUP BY word
        ), rarest AS (
            SELECT item_id, word, ipos, row_number() OVER (PARTITION BY item_id ORDER BY df, ipos) AS r FROM iw JOIN counted USING (word)
        ), stand AS (
            SELECT doc_id, item_id, r, ipos, pos FROM rarest JOIN dw USING (word) WHERE r <= 2
        ), near AS (
            SELECT a.doc_id, count(DISTINCT a.item_id) AS n_near FROM stand a JOIN stand b ON a.doc_id = b.doc_id AND a.item_id = b.item_id
            WHERE a.r = 1 AND b.r = 2 AND abs((a.pos - a.ipos) - (b.pos - b.ipos)) <= 3 AND sign(b.pos - a.pos) = sign(b.ipos - a.ipos) GROUP BY a.doc_id
        )
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
    """,
    "op4_minhash_near_dedup": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, {_spaced(_LOWER)} AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[k : k + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS k FROM d WHERE len(w) > 0)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
        ), edges AS (
            SELECT a, b FROM links UNION SELECT b, a FROM links
        ), reach AS (
            SELECT doc_id AS node, doc_id AS root FROM d
            UNION
            SELECT b, root FROM reach JOIN edges ON node = a WHERE root < b
        ), least_root AS (
            SELECT node, min(root) AS component_id FROM reach GROUP BY node
        )
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN least_root ON node = d.doc_id
    """,
    "op5_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
        ), r AS (
            SELECT page_id, strlen(h) AS payload_bytes, x, max(page_id) OVER (PARTITION BY h) AS kept FROM p
        )
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(32), lambda c: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, 1 + 5 * CAST(c // 4 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (c % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
            CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to
        FROM r
    """,
    "op6_license_scans": _license_sql(),
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op8_substring_dedup": f"""
        WITH d AS (
            SELECT doc_id, {_spaced("coalesce(text, '')")} AS w FROM documents
        ), g AS (
            SELECT doc_id, k, array_to_string(w[k : k + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)
        ), later AS (
            SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS first_doc FROM g) WHERE first_doc < doc_id
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS p FROM later
        ), words AS (
            SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
        ), kept AS (
            SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS kept_text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
    """,
}
