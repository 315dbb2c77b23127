"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

import secrets
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, exact_dedup, line_dedup, ngram_join, packing, pii, runs, scratch, token_counts, token_files, toxicity, url_filter, vptree

#: The rule list of the production filter.
RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pii_key(spark: SparkSession) -> bytes:
    """The key in hexadecimal that the session sets as ``spark.quillmat.pii.secret``; where it sets none, a new random one
    is put there, so equal values stay linked as long as the session lives and nobody can undo them afterwards.
    """
    held = spark.conf.get("spark.quillmat.pii.secret", None)
    if not held:
        held = secrets.token_hex(32)
        spark.conf.set("spark.quillmat.pii.secret", held)
    return bytes.fromhex(held)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), tokenizer())


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, folder, "documents"))


def op3_vantage_points(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"), url_filter.rules_table(spark, RULES))


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.link(table(spark, folder, "documents"), n=3, num=90, den=100).drop("kept")


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    out = f"{scratch.shared_dir(spark).rstrip('/')}/quillmat-tokens-{uuid.uuid4().hex}"
    token_files.write(table(spark, folder, "documents"), out, tokenizer())
    return token_files.digests(token_files.read(spark, out))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    lines = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return lines.select("doc_id", F.col("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonymise(table(spark, folder, "documents").select("doc_id", "text"), pii_key(spark))


def op9_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer())


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return runs.digests(runs.find_runs(docs.withColumn("text", runs.repeated_tails(F.col("text"), F.crc32(F.col("doc_id").cast("string"))))))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), pieces())


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_vantage_points": op3_vantage_points,
    "op4_url_filter": op4_url_filter,
    "op5_ngram_join": op5_ngram_join,
    "op6_token_files": op6_token_files,
    "op7_line_dedup": op7_line_dedup,
    "op8_pii": op8_pii,
    "op9_best_fit": op9_best_fit,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_token_counts": op13_token_counts,
}

_BLANK = "[\\x20\\x09-\\x0D]"

ORACLES = {
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '{_BLANK}', '', 'g') AS k FROM documents)
        SELECT doc_id, first_value(doc_id) OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY k) AS group_size,
               row_number() OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) = 1 AS kept, sha256(k) AS text_sha256, md5(t) AS text_md5
        FROM d""",
    "op3_vantage_points": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    "op5_ngram_join": """
        WITH RECURSIVE w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, text, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
        g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.a, r.seen FROM r JOIN l ON l.b = r.doc_id AND r.seen < l.a)
        SELECT s.doc_id, len(s.s) AS n_shingles, (SELECT min(seen) FROM r WHERE r.doc_id = s.doc_id) AS component_id, md5(coalesce(s.text, '')) AS text_md5 FROM s""",
    "op4_url_filter": """
        WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
        h AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS raw, r FROM u),
        p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM h),
        rules(action, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        m AS (SELECT p.page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
              FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY p.page_id)
        SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
    "op7_line_dedup": """
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN c ON k.key = c.key GROUP BY doc_id""",
    "op11_periodic_runs": """
        WITH h AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
                          xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b:
                              list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(c, b)), 4294967295::BIGINT), 4294967295) AS h
                   FROM documents),
        d AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS m FROM h),
        s AS (SELECT doc_id, i, CASE WHEN i >= a THEN w[a + (i - a) % (1 + (n - a) // m) + 1] ELSE w[i + 1] END AS w FROM (SELECT *, unnest(range(n)) AS i FROM d)),
        p AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i),
        g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM p),
        r AS (SELECT doc_id, start, length, min(q) AS period FROM (
                SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)) GROUP BY doc_id, start, length),
        b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
        f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DECIMAL(38, 19) / period DESC, start, period) = 1),
        k AS (SELECT s.doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = s.doc_id AND s.i >= r.start + r.period AND s.i < r.start + r.length) GROUP BY s.doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, (1000 * length // period)::BIGINT AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM d LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op12_collocations": """
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM t),
        w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
        k AS (SELECT lang, w, unnest([1, 2, 3]) AS k FROM w),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM k WHERE len(w) >= k),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
        s AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
        x AS (SELECT lang, phrase, max(a) AS longest FROM (
                SELECT lang, array_to_string(w[:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:], ' '), a FROM c WHERE k = 3) GROUP BY lang, phrase),
        y AS (SELECT c.*, unnest(range(1, k)) AS i FROM c LEFT JOIN x USING (lang, phrase) WHERE NOT coalesce(100 * longest >= 50 * a, false)),
        z AS (SELECT y.lang, y.phrase, y.a, l.a AS l, r.a AS r, i, ((1000000::HUGEINT * y.a * y.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
              FROM y JOIN f l ON l.lang = y.lang AND l.phrase = array_to_string(y.w[:i], ' ') JOIN f r ON r.lang = y.lang AND r.phrase = array_to_string(y.w[i + 1:], ' ')
              QUALIFY row_number() OVER (PARTITION BY y.lang, y.phrase ORDER BY score, i) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z JOIN s USING (lang) QUALIFY rank <= 2000""",
}
