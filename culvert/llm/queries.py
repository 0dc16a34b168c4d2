"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culvert.llm import language, quality
from culvert.llm.alignment import align_tokens
from culvert.llm.decontaminate import decontaminate
from culvert.llm.exact_dedup import exact_dedup
from culvert.llm.license_scan import license_scan
from culvert.llm.line_dedup import HTML_LINES, host_of, line_dedup
from culvert.llm.ngram_join import ngram_jaccard_components
from culvert.llm.packing import pack
from culvert.llm.simhash import simhash_components
from culvert.llm.substring_dedup import substring_dedup
from culvert.llm.suffix_dedup import suffix_dedup
from culvert.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    """Path of the public tokenizer file; PACK_TOKENIZER overrides it."""
    if path := os.environ.get("PACK_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_bpe(), with_ids=False).drop("ids")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), width=13, keep_text=False).drop("kept_text")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return found.withColumn("near_sha256", F.sha2(F.array_join("near_items", ","), 256)).drop("items", "near_items")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = line_dedup(pages, host_of("url"), "html", HTML_LINES, ratio=0.3, min_pages=3)
    return found.select("page_id", "host", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept_out = quality.held_out("doc_id", 4, 2)
    found = language.predict(docs, language.fit(docs.filter(~kept_out)))
    return found.select("doc_id", kept_out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), width=50, keep_text=False).drop("kept_text")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept_out = quality.held_out("doc_id", 5, 0)
    weights = quality.fit(docs.filter(~kept_out), table(spark, sf_dir, "labels"))
    found = quality.score(docs.select("doc_id", "text"), weights)
    return found.select("doc_id", kept_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"), width=5, percent=75)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


QUERIES = {
    "op1_pack": op1_pack,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_decontaminate": op4_decontaminate,
    "op5_line_dedup": op5_line_dedup,
    "op6_language": op6_language,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality": op9_quality,
    "op10_ngram_join": op10_ngram_join,
    "op11_simhash": op11_simhash,
    "op12_alignment": op12_alignment,
    "op13_vector_codes": op13_vector_codes,
}


def _without_windows(width: int) -> str:
    return rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + {width - 1}], ' ') AS s
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM d)),
        f AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
        cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + {width})) AS p FROM g JOIN f USING (s) WHERE least < doc_id),
        each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
        kept AS (SELECT each.doc_id, count(cut.p) AS n_removed,
                        string_agg(word, ' ' ORDER BY each.p) FILTER (cut.p IS NULL) AS text
                 FROM each LEFT JOIN cut USING (doc_id, p) GROUP BY each.doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """


def _product_codes() -> str:
    """The rounds of op13 written out. Inner products of whole numbers below 2^53 are exact in doubles."""
    product = "list_inner_product({}::DOUBLE[], {}::DOUBLE[])"
    apart = f"{product.format('v', 'v')} - 2 * {product.format('v', 'c')} + {product.format('c', 'c')}"
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) AS r,
              list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            part AS MATERIALIZED (SELECT r, p, x[p * len(x) // {PARTS} + 1:(p + 1) * len(x) // {PARTS}] AS v FROM kept, (SELECT unnest(range({PARTS})) AS p)),
            b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v AS c FROM part WHERE r <= {ENTRIES})"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (SELECT r, p, any_value(v) AS v, min({{'d': CAST({apart} AS BIGINT), 'e': e}}) AS m FROM part JOIN b{k} USING (p) GROUP BY r, p)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""m{k} AS (SELECT p, e, list(x ORDER BY i) AS c
                  FROM (SELECT p, e, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x
                        FROM (SELECT p, m.e AS e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e),
                b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e))"""
            )
    return f"""
        WITH {", ".join(steps)},
        coded AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
        books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM kept JOIN coded USING (r), books
    """


_ASCII_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"

ORACLE_SQL = {
    "op2_substring_dedup": _without_windows(13),
    "op4_decontaminate": rf"""
        WITH d AS (SELECT doc_id, {_ASCII_WORDS.format(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ASCII_WORDS.format(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM benchmark),
        t AS (SELECT DISTINCT item, w[i:i + 9] AS words, least(len(w), 10) AS n
              FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
        g AS (SELECT doc_id, i, n, w[i:i + n - 1] AS words
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM t))),
        m AS (SELECT doc_id, i, g.n, item FROM g JOIN t ON g.words = t.words),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
        x AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id),
        -- Spans of one word more around each occurrence of a window's rarest word.
        k AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
        c AS (SELECT word, count(*) AS c FROM k GROUP BY word),
        r AS (SELECT words, n, arg_min(word, (coalesce(c, 0), word)) AS word FROM (SELECT words, n, unnest(words) AS word FROM (SELECT DISTINCT words, n FROM t)) LEFT JOIN c USING (word) GROUP BY words, n),
        s AS (SELECT DISTINCT doc_id, words, n, unnest(range(greatest(1, p - n), p + 1)) AS s FROM r JOIN k USING (word)),
        o AS (SELECT DISTINCT doc_id, words FROM s JOIN d USING (doc_id)
              WHERE len(list_filter(words, lambda x: len(list_filter(w[s:s + n], lambda y: y = x)) < len(list_filter(words, lambda y: y = x)))) = 0),
        y AS (SELECT doc_id, count(*) AS n_near_items, string_agg(item, ',' ORDER BY item) AS near_items FROM (SELECT DISTINCT doc_id, item FROM o JOIN t USING (words)) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
               coalesce(n_near_items, 0) AS n_near_items, sha256(coalesce(near_items, '')) AS near_sha256
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
    """,
    "op5_line_dedup": r"""
        WITH p AS (
          SELECT page_id, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
                 list_filter(list_transform(regexp_split_to_array(coalesce(html, ''), '<[^>]*>|[\n\r]'),
                                            lambda x: trim(x, E' \t\n\x0b\x0c\r')), lambda x: x <> '') AS lines
          FROM pages),
        total AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
        seen AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
        cut AS (SELECT host, list(line) AS lines FROM seen JOIN total USING (host) WHERE n >= 3 AND n > 0.3 * pages GROUP BY host)
        SELECT page_id, host, len(p.lines) AS n_lines, len(p.lines) - len(kept) AS n_dropped, sha256(array_to_string(kept, E'\n')) AS kept_sha256
        FROM (SELECT p.*, list_filter(p.lines, lambda x: NOT coalesce(list_contains(cut.lines, x), false)) AS kept
              FROM p LEFT JOIN cut USING (host)) AS p
    """,
    "op7_suffix_dedup": _without_windows(50),
    "op10_ngram_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, {_ASCII_WORDS.format(r'[^\x20\x09-\x0D]+')} AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, w[i:i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
        reach(doc_id, other) AS (SELECT a, b FROM links UNION SELECT doc_id, b FROM reach JOIN links ON other = a)
        SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, least(d.doc_id, coalesce(min(other), d.doc_id)) AS component_id
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id
    """,
    "op13_vector_codes": _product_codes(),
    "op8_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS points,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM (SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                     first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS keep_id
              FROM d)
    """,
}
