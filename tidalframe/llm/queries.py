"""The registered queries of this subpackage: each applies its operator to the whole table.

The thin functions here derive the digest columns; the operators keep their own interfaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.llm import decontaminate, embed_dedup, hard_negatives, html_text, minhash, mixing, repeats, sharding, substring_dedup, token_files, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word windows that an earlier document also holds, removed from every document."""
    out = substring_dedup.remove_repeated_windows(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that every document holds, and the fewest edits of any."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.match_benchmark(docs, _table(spark, sf_dir, "benchmark"))
    items = F.transform("hits__", lambda x: x["item"])
    return found.select("doc_id", (F.size("hits__") > 0).alias("contaminated"), F.size("hits__").alias("n_items"), items.alias("item_ids"), F.array_min(F.transform("hits__", lambda x: x["edits"])).alias("fewest_edits"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's URL."""
    return url_filter.filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels that are not held out."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte strings of 200 or more that occur again, removed from every document."""
    out = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the bit-packed token files."""
    import public_tokenizers

    return token_files.encode_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, on four-word shingles at similarity 0.8."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4).select("doc_id", "n_shingles", "component_id", "kept")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every embedding, at cosine 0.95."""
    return embed_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document along a Hilbert curve over language, source and size."""
    return sharding.hilbert_shards(_table(spark, sf_dir, "documents"))


def op11_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document along a Hilbert curve over language, source and size."""
    return sharding.hilbert_shards(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score nearly as high as each anchor's positives."""
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), relabel_every=7)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_url_filter": op3_url_filter,
    "op4_mix_sources": op4_mix_sources,
    "op5_toxicity": op5_toxicity,
    "op6_repeats": op6_repeats,
    "op7_html_text": op7_html_text,
    "op8_token_files": op8_token_files,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_hilbert_shards": op11_hilbert_shards,
    "op12_hard_negatives": op12_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        win AS (SELECT doc_id, k, array_to_string(w[k : k + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS t(k)),
        least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
        gone AS (
            SELECT DISTINCT win.doc_id, k + j AS i FROM win JOIN least USING (g), range(0, 13) AS r(j)
            WHERE win.doc_id > least.m),
        word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
        cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op3_url_filter": r"""
        WITH rest AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS r FROM pages),
        part AS (
            SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                substr(coalesce(r, ''), length(regexp_extract(coalesce(r, ''), '^[^/]*')) + 1) AS path FROM rest),
        fit AS (
            SELECT *, '.' || host AS h, CASE
                WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM part)
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(host, '(^|[.-])((cheap-(pills|meds)|spam-farm|casino|ads-track|free-bets)[.-]|adult-[a-z0-9]+[.])') THEN 'block' ELSE 'allow' END AS verdict
        FROM fit
    """,
    "op4_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, source, (source IS NULL)::INT AS gone, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS h,
                coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        s AS (SELECT source, gone, sum(size)::BIGINT AS source_size FROM d GROUP BY source, gone),
        w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY gone, source) - 1) % 3 + 1] AS w, 2 * source_size AS cap FROM s),
        r AS (SELECT *, cap::DOUBLE / w AS ratio, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS budget FROM w),
        f AS (
            SELECT *, (budget - coalesce((sum(cap) OVER q)::BIGINT, 0)) / ((sum(w) OVER ())::BIGINT - coalesce((sum(w) OVER q)::BIGINT, 0)) >= ratio AS full_
            FROM r WINDOW q AS (ORDER BY ratio, gone, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (
            SELECT source, gone, source_size, budget, CASE WHEN full_ THEN cap::DOUBLE
                ELSE w * (budget - coalesce((sum(cap) FILTER (full_) OVER ())::BIGINT, 0)) / (sum(w) FILTER (NOT full_) OVER ())::BIGINT END AS target FROM f),
        c AS (
            SELECT d.*, source_size, target, budget,
                (sum(size) OVER (PARTITION BY d.gone, d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
            FROM d JOIN t ON d.gone = t.gone AND d.source IS NOT DISTINCT FROM t.source),
        v AS (SELECT *, pass, (upto + pass * source_size) / target AS v FROM c, range(0, 2) AS p(pass) WHERE size > 0 AND target > 0),
        m AS (SELECT *, sum(size) OVER (ORDER BY v, pass, gone, source, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS total FROM v),
        k AS (SELECT doc_id, source, gone, count(*) AS n FROM m WHERE total <= budget GROUP BY doc_id, source, gone)
        SELECT c.doc_id, c.size, c.source_size, c.target, (coalesce(k.n, 0) * c.size)::BIGINT AS taken
        FROM c LEFT JOIN k ON c.doc_id = k.doc_id AND c.gone = k.gone AND c.source IS NOT DISTINCT FROM k.source
    """,
    "op6_repeats": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        w AS (SELECT r, k, hash(substr(x, 2 * k + 1, 400)) AS g FROM d, unnest(range(0, length(x) // 2 - 199)) AS t(k)),
        hit AS (SELECT r, k, lag(k) OVER (PARTITION BY r ORDER BY k) AS before FROM w SEMI JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) AS twice USING (g)),
        run AS (SELECT r, k, sum(CASE WHEN before + 200 >= k THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY k) AS i FROM hit),
        span AS (SELECT r, min(k) AS s, max(k) + 200 AS e FROM run GROUP BY r, i),
        cut AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS upto FROM span),
        gone AS (SELECT r, sum(e - s)::BIGINT AS n, count(*) AS spans, max(e) AS last FROM cut GROUP BY r),
        head AS (SELECT r, string_agg(substr(x, 2 * upto + 1, 2 * (s - upto)), '' ORDER BY s) AS t FROM cut JOIN d USING (r) GROUP BY r)
        SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
            sha256(unhex(coalesce(t, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN gone USING (r) LEFT JOIN head USING (r)
    """,
    "op9_minhash_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 2))) AS t(k) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        pair AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM sh AS p JOIN sh AS q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM pair JOIN n AS x ON a = x.doc_id JOIN n AS y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
        SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(b) AS component_id, min(b) = d.doc_id AS kept
        FROM d JOIN reach ON d.doc_id = reach.a LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id
    """,
    "op10_embedding_dedup": r"""
        WITH RECURSIVE bad AS (
            SELECT DISTINCT vec_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) AS t WHERE x IS NULL OR isnan(x) OR isinf(x)),
        v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings ANTI JOIN bad USING (vec_id)
            WHERE len(embedding) > 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
        link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v AS p JOIN v AS q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.95e0),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT vec_id, coalesce(max(n), 0)::BIGINT AS n_links, min(b) AS component_id, min(b) = vec_id AS kept
        FROM embeddings JOIN reach ON vec_id = reach.a LEFT JOIN n ON vec_id = n.a GROUP BY vec_id
    """,
    "op11_hilbert_shards": r"""
        WITH RECURSIVE
        d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS x0, lang IS NULL AS g0, coalesce(source, '') AS x1, source IS NULL AS g1,
            coalesce(strlen(text), 0)::BIGINT + 8 AS size, coalesce(hex(encode(text)), '') AS x FROM documents),
        n AS (SELECT count(*) AS every FROM d),
        q0 AS (SELECT g0, x0, (32 * (sum(count(*)) OVER (ORDER BY g0 DESC, x0) - count(*)) // any_value(every))::BIGINT AS at0 FROM d, n GROUP BY g0, x0),
        q1 AS (SELECT g1, x1, (32 * (sum(count(*)) OVER (ORDER BY g1 DESC, x1) - count(*)) // any_value(every))::BIGINT AS at1 FROM d, n GROUP BY g1, x1),
        q2 AS (SELECT size, (32 * (sum(count(*)) OVER (ORDER BY size) - count(*)) // any_value(every))::BIGINT AS at2 FROM d, n GROUP BY size),
        p AS (SELECT r, doc_id, size, at0, at1, at2 FROM d JOIN q0 USING (g0, x0) JOIN q1 USING (g1, x1) JOIN q2 USING (size)),
        walk(at0, at1, at2, b, h, e, t) AS (
            SELECT DISTINCT at0, at1, at2, 4, 0::BIGINT, 0, 0 FROM p
            UNION ALL
            SELECT at0, at1, at2, b - 1, 8 * h + w, e ^ (((en << k) | (en >> (3 - k))) & 7), (t + [0, 1, 1, 2, 2, 1, 1, 0][w + 1] + 1) % 3
            FROM (SELECT *, [0, 0, 0, 3, 3, 6, 6, 5][w + 1] AS en FROM (
                SELECT *, [0, 1, 3, 2, 7, 6, 4, 5][(((z >> k) | (z << (3 - k))) & 7) + 1] AS w FROM (
                    SELECT *, t + 1 AS k, (((at0 >> b) & 1) | (((at1 >> b) & 1) << 1) | (((at2 >> b) & 1) << 2))::INT ^ e AS z FROM walk WHERE b >= 0)))),
        nib AS (SELECT list_transform(range(16), lambda i: list_reduce(range(4), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS v),
        c AS (SELECT r, list_reduce(list_transform(range(0, length(x)), lambda i: instr('0123456789ABCDEF', x[i + (CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END)]) - 1), lambda s, k: xor(s >> 4, nib.v[xor(s & 15, k) + 1]), 4294967295::BIGINT) AS s FROM d, nib),
        f AS (SELECT p.*, h AS curve, xor(c.s, 4294967295)::BIGINT AS text_crc32 FROM p JOIN walk USING (at0, at1, at2) JOIN c USING (r) WHERE b = -1),
        o AS (SELECT *, (sum(size) OVER (ORDER BY curve, doc_id NULLS FIRST, size, text_crc32, r))::BIGINT - size AS before, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, size, text_crc32, r) AS rank, (sum(size) OVER ())::BIGINT AS every FROM f),
        s AS (SELECT *, (((2 * before + size) * 24) // (2 * every))::INT AS shard FROM o)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, rank - min(rank) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard, curve, at0, at1, at2 FROM s
    """,
    "op11_hilbert_shards": r"""
        WITH RECURSIVE
        d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS x0, lang IS NULL AS g0, coalesce(source, '') AS x1, source IS NULL AS g1,
            coalesce(strlen(text), 0)::BIGINT + 8 AS size, coalesce(hex(encode(text)), '') AS x FROM documents),
        n AS (SELECT count(*) AS every FROM d),
        q0 AS (SELECT g0, x0, (32 * (sum(count(*)) OVER (ORDER BY g0 DESC, x0) - count(*)) // any_value(every))::BIGINT AS at0 FROM d, n GROUP BY g0, x0),
        q1 AS (SELECT g1, x1, (32 * (sum(count(*)) OVER (ORDER BY g1 DESC, x1) - count(*)) // any_value(every))::BIGINT AS at1 FROM d, n GROUP BY g1, x1),
        q2 AS (SELECT size, (32 * (sum(count(*)) OVER (ORDER BY size) - count(*)) // any_value(every))::BIGINT AS at2 FROM d, n GROUP BY size),
        p AS (SELECT r, doc_id, size, at0, at1, at2 FROM d JOIN q0 USING (g0, x0) JOIN q1 USING (g1, x1) JOIN q2 USING (size)),
        walk(at0, at1, at2, b, h, e, t) AS (
            SELECT DISTINCT at0, at1, at2, 4, 0::BIGINT, 0, 0 FROM p
            UNION ALL
            SELECT at0, at1, at2, b - 1, 8 * h + w, xor(e, ((en << k) | (en >> (3 - k))) & 7), (t + [0, 1, 1, 2, 2, 1, 1, 0][w + 1] + 1) % 3
            FROM (SELECT *, [0, 0, 0, 3, 3, 6, 6, 5][w + 1] AS en FROM (
                SELECT *, [0, 1, 3, 2, 7, 6, 4, 5][(((z >> k) | (z << (3 - k))) & 7) + 1] AS w FROM (
                    SELECT *, t + 1 AS k, xor((((at0 >> b) & 1) | (((at1 >> b) & 1) << 1) | (((at2 >> b) & 1) << 2))::INT, e) AS z FROM walk WHERE b >= 0)))),
        nib AS (SELECT list_transform(range(16), lambda i: list_reduce(range(4), lambda c, _: (CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)::BIGINT, i::BIGINT)) AS v),
        c AS (SELECT r, list_reduce(list_transform(range(0, length(x)), lambda i: instr('0123456789ABCDEF', x[i + (CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END)]) - 1::BIGINT), lambda s, k: xor(s >> 4, nib.v[xor(s & 15, k) + 1])::BIGINT, 4294967295::BIGINT) AS s FROM d, nib),
        f AS (SELECT p.*, h AS curve, xor(c.s, 4294967295::BIGINT) AS text_crc32 FROM p JOIN walk USING (at0, at1, at2) JOIN c USING (r) WHERE b = -1),
        o AS (SELECT *, (sum(size) OVER (ORDER BY curve, doc_id NULLS FIRST, size, text_crc32, r))::BIGINT - size AS before, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, size, text_crc32, r) AS rank, (sum(size) OVER ())::BIGINT AS every FROM f),
        s AS (SELECT *, (((2 * before + size) * 24) // (2 * every))::INT AS shard FROM o)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, rank - min(rank) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard, curve, at0, at1, at2 FROM s
    """,
    "op12_hard_negatives": r"""
        WITH bad AS (SELECT DISTINCT vec_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) AS t WHERE x IS NULL OR isnan(x) OR isinf(x)),
        e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings ANTI JOIN bad USING (vec_id) WHERE label IS NOT NULL AND embedding IS NOT NULL),
        s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS s FROM e AS a JOIN e AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT a, b, s FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
        n AS (SELECT p.a, p.b, p.s, s.b AS c, s.s AS t, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS k FROM p JOIN s ON p.a = s.a AND NOT s.alike AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s)
        SELECT a AS anchor_id, b AS positive_id, k::INT AS rank, c AS negative_id, s AS positive_score, t AS negative_score FROM n WHERE k <= 10
    """,
}
