"""The registered queries of the ten operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out() -> Column:
    """Rows kept from learning: crc32 of the decimal doc_id leaves 1 when divided by 3."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import hexed
    from .substring import trimmed

    found = trimmed(read(spark, sf_dir, "documents"), length=13)
    return found.select("doc_id", "n_words", "n_removed", hexed(F.col("digest")).alias("kept_sha256"))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target texts are those labelled as of quality; as large a part is kept as of the labelled ones is."""
    from .resampling import resampled

    labels = read(spark, sf_dir, "labels").where(~held_out() & F.col("quality").isNotNull())
    share = labels.agg(F.avg(F.col("quality").cast("double"))).head()[0]
    return resampled(read(spark, sf_dir, "documents"), labels.where("quality = 1").select("doc_id"), share or 0.0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import scores, train

    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"), "toxic", ~held_out())
    found = scores(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import captures, header, resolved

    found = resolved(captures(read(spark, sf_dir, "pages")))
    names = ("etag", "last-modified", "cache-control", "content-type", "content-length")
    shown = [header(n).alias(n.replace("-", "_")) for n in names]
    return found.select(((F.col("record_id") - 1) / 2).cast("long").alias("page_id"), "canonical_url", (F.col("response_id") / 2).cast("long").alias("response_page_id"), "verdict", "digest", *shown)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.9)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import round_trip

    return round_trip(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import hexed
    from .suffixarray import trimmed

    found = trimmed(read(spark, sf_dir, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", hexed(F.col("digest")).alias("kept_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exactdedup import duplicates
    from .shared import hexed

    found = duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", hexed(F.col("digest")).alias("text_sha256"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"), words=3, bits=3, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_importance_resampling, op3_toxicity, op4_best_fit_packing, op5_warc_revisits, op6_embedding_near_dedup, op7_sentencepiece, op8_suffix_array_dedup, op9_exact_dedup, op10_simhash_near_dedup)
}



def canonical_sql(url: str) -> str:
    """The canonical URL in DuckDB SQL."""
    bare = f"regexp_replace(trim({url}), '#.*$', '')"
    parts = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(.*)$'"
    scheme = f"lower(regexp_extract({bare}, {parts}, 1))"
    host = f"regexp_replace(lower(regexp_extract({bare}, {parts}, 2)), '^[^@]*@', '')"
    host = f"CASE WHEN {scheme} = 'http' THEN regexp_replace({host}, ':80$', '') WHEN {scheme} = 'https' THEN regexp_replace({host}, ':443$', '') ELSE {host} END"
    path = f"regexp_replace(regexp_extract({bare}, {parts}, 3), '/+$', '')"
    query = f"regexp_replace(regexp_extract({bare}, {parts}, 4), '([?&])(utm_[a-z]+|gclid|fbclid|ref)=[^&]*', '\\1', 'g')"
    query = f"regexp_replace(regexp_replace(regexp_replace({query}, '&&+', '&', 'g'), '\\?&', '?', 'g'), '[?&]+$', '')"
    return f"CASE WHEN regexp_matches({bare}, {parts}) AND ({host}) <> '' THEN {scheme} || '://' || ({host}) || {path} || {query} END"


SQL: dict[str, str] = {
    "op1_substring_dedup": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(a[i:i + 12], ' ')) AS s FROM (SELECT doc_id, a, unnest(generate_series(1, len(a) - 12)) AS i FROM w WHERE len(a) >= 13)),
        first AS (SELECT s, min(doc_id) AS low FROM win GROUP BY s),
        gone AS (SELECT DISTINCT doc_id, i + k AS j FROM (SELECT doc_id, i FROM win JOIN first USING (s) WHERE low < doc_id), range(13) AS r(k)),
        word AS (SELECT doc_id, unnest(a) AS t, generate_subscripts(a, 1) AS j FROM w),
        kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY j) AS s, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
        SELECT doc_id, len(a) AS n_words, len(a) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op5_warc_revisits": f"""
        WITH page AS (
            SELECT page_id, url, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size,
                '2023-11-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS day,
                CASE page_id % 3 WHEN 0 THEN url || '#again' WHEN 1 THEN regexp_replace(url, '^http://([^/]*)', 'HTTP://\\1:80') ELSE url END AS spelled
            FROM pages),
        response AS (SELECT *, {canonical_sql("url")} AS canon, page_id * 60 AS at, '"' || substr(digest, 1, 16) || '"' AS tag FROM page),
        revisit AS (SELECT page_id, {canonical_sql("spelled")} AS canon, page_id * 60 + 86400 * (1 + page_id % 5) AS at, day,
                CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"changed"' ELSE 'W/"' || substr(digest, 1, 16) || '"' END AS tag,
                page_id % 11 = 0 AS undated FROM page),
        met AS (
            SELECT v.page_id, v.canon AS canonical_url, r.page_id AS response_page_id, r.digest, r.size, r.day AS r_day, v.day, v.tag, r.tag AS r_tag, v.undated,
                CASE WHEN r.page_id IS NULL THEN 'no_earlier_response'
                    WHEN v.tag IS NOT NULL THEN CASE WHEN regexp_replace(v.tag, '^W/', '') = r.tag THEN 'resolved' ELSE 'validators_differ' END
                    WHEN v.day = r.day THEN 'resolved' ELSE 'validators_differ' END AS verdict
            FROM revisit v ASOF LEFT JOIN response r ON v.canon = r.canon AND v.at > r.at)
        SELECT page_id, canonical_url, response_page_id, verdict,
            CASE WHEN verdict = 'resolved' THEN digest END AS digest,
            CASE WHEN verdict = 'resolved' THEN coalesce(tag, r_tag) END AS etag,
            CASE WHEN verdict = 'resolved' THEN CASE WHEN undated THEN day ELSE r_day END END AS last_modified,
            CASE WHEN verdict = 'resolved' THEN CASE WHEN undated THEN 'max-age=60' ELSE 'max-age=900' END END AS cache_control,
            CASE WHEN verdict = 'resolved' THEN 'text/html' END AS content_type,
            CASE WHEN verdict = 'resolved' THEN size::VARCHAR END AS content_length
        FROM met""",
    "op9_exact_dedup": """
        WITH normal AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        best AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM normal JOIN best USING (t)""",
    "op8_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        win AS (SELECT doc_id, i, sha1(h[i + 1:i + 200]) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
        again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
        hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM win SEMI JOIN again USING (s)),
        island AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
        span AS (SELECT doc_id, k, min(i) AS a, max(i) + 200 AS b FROM island GROUP BY doc_id, k),
        gap AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER w AS since, lead(a) OVER w IS NULL AS last FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
        cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(CASE WHEN a > since THEN hex(h[since + 1:a]) ELSE '' END || CASE WHEN last AND b < n THEN hex(h[b + 1:n]) ELSE '' END, '' ORDER BY a) AS kept FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN kept IS NULL THEN sha256(h) ELSE sha256(unhex(kept)) END AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)""",
    "op6_embedding_near_dedup": """
        WITH RECURSIVE fine AS (
            SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.9),
        reach AS (SELECT a AS vec_id, a AS other FROM link UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON r.other = l.a),
        part AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
        degree AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
        SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept
        FROM embeddings e LEFT JOIN part USING (vec_id) LEFT JOIN degree USING (vec_id)""",
}
