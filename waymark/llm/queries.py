"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, exact_dedup, language_id, line_dedup, ngram_jaccard, packing, quality, token_output, toxicity, url_filter
from .common import id_bucket


#: Scores from which a document is predicted good, and toxic.
GOOD, TOXIC = 0.7, 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """The tokenizer file that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text, and how many lines went."""
    lines = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0), lambda n, x: n + x["last"] - x["first"] + 1)
    return lines.select("doc_id", "text", gone.cast("long").alias("lines_removed"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_groups(table(spark, sf_dir, "documents"), k=3, t=90)


URL_RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer(), eos=2)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.document_statistics(table(spark, sf_dir, "documents"))
    model = quality.fit(stats, table(spark, sf_dir, "labels").where(id_bucket("doc_id", 4) != 2))
    return judged(quality.score(stats, model), GOOD)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Fitted on the documents that labels marks and that aren't held out."""
    sample = toxicity.labelled_sample(docs, labels.where(id_bucket("doc_id", 4) != 2), "toxic")
    return toxicity.fit(sample, label_col="toxic")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return judged(toxicity.score(docs, model), TOXIC)


def judged(scores: DataFrame, least: float) -> DataFrame:
    held_out = F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence: its documents, where they lie, and digests of its ids and positions."""
    packed = token_output.packed_sequences(table(spark, sf_dir, "documents"), word_tokenizer(), eos=2)
    return packed.select("block", "sequence", "doc_ids", "starts", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = id_bucket("doc_id", 5)
    model = language_id.fit(docs.where(fold != 0))
    return language_id.identify(docs, model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a passage of benchmark, with the items."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_url_filter": op3_url_filter,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_output": op8_token_output,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
}

SQL = {
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, string_split(text, chr(10))[i] AS raw, trim(string_split(text, chr(10))[i], chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)
), filled AS (
  SELECT *, row_number() OVER d AS r, count(*) OVER (PARTITION BY doc_id) AS n, lead(line, 1) OVER d AS l1, lead(line, 2) OVER d AS l2,
         coalesce(lead(pos, 2) OVER d, lead(pos, 1) OVER d, pos) AS last
  FROM lines WHERE line <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), windows AS (
  SELECT doc_id, pos, last, row_number() OVER (PARTITION BY least(n, 3), line, l1, l2 ORDER BY doc_id, pos) AS seen
  FROM filled WHERE r <= greatest(n - 2, 1)
), covered AS (
  SELECT DISTINCT doc_id, unnest(generate_series(pos, last)) AS pos FROM windows WHERE seen > 1
), kept AS (
  SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL) AS text, count(c.pos) AS gone
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(gone, 0) AS lines_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
    "op2_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) END AS g FROM words
), classes AS (
  SELECT md5(array_to_string(g, chr(10))) AS c, any_value(g) AS g, min(doc_id) AS least FROM sets WHERE len(g) > 0 GROUP BY 1
), grams AS (
  SELECT c, len(g) AS n, unnest(g) AS x FROM classes
), links AS (
  SELECT a.c AS a, b.c AS b FROM grams a JOIN grams b ON a.x = b.x AND a.c <> b.c AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT c, c FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), found AS (
  SELECT r.a AS c, min(k.least) AS component_id, (SELECT count(*) FROM links l WHERE l.a = r.a) AS n_links FROM reach r JOIN classes k ON k.c = r.b GROUP BY r.a
)
SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(f.component_id, s.doc_id) AS component_id, coalesce(f.n_links, 0) AS n_links
FROM sets s LEFT JOIN found f ON len(s.g) > 0 AND f.c = md5(array_to_string(s.g, chr(10)))
""",
    "op3_url_filter": r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), urls AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), rules(rhost, rpath, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT u.*, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS best
  FROM urls u LEFT JOIN rules ON starts_with(path, rpath) AND (host = rhost OR ends_with(host, '.' || rhost))
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE best = 1
""",
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op10_decontamination": r"""
WITH marks AS MATERIALIZED (
  SELECT item_id, w, row_number() OVER (ORDER BY item_id, w) AS item, len(w) AS m, least(len(w), 5) AS width FROM (
    SELECT DISTINCT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\s\x0B!-/:-@\[-`{-~]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0
), item_grams AS (
  SELECT item, item_id, m, width, g, count(*) AS n FROM (
    SELECT *, array_to_string(w[i:i + width - 1], ' ') AS g FROM (SELECT *, unnest(generate_series(1, m - width + 1)) AS i FROM marks)) GROUP BY ALL
), weights AS (
  SELECT width, g, CAST(round(100 * (1 + ln((SELECT count(*) FROM marks) / count(*)))) AS BIGINT) AS weight FROM item_grams GROUP BY width, g
), totals AS (
  SELECT item, sum(n * weight) AS total FROM item_grams JOIN weights USING (width, g) GROUP BY item
), rows AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS d, doc_id, w FROM (
    SELECT DISTINCT doc_id, text, list_filter(string_split_regex(lower(text), '[\s\x0B!-/:-@\[-`{-~]+'), lambda x: x <> '') AS w FROM documents WHERE text <> '')
), places AS (
  SELECT d, len(w) AS n_words, width, i - 1 AS pos, array_to_string(w[i:i + width - 1], ' ') AS g FROM (
    SELECT d, w, width, unnest(generate_series(1, len(w) - width + 1)) AS i FROM rows, (SELECT DISTINCT width FROM marks))
), hits AS (
  SELECT DISTINCT d, item, item_id, m, width, least(m, n_words) AS length, unnest(generate_series(greatest(0, pos - m + width), least(pos, greatest(0, n_words - m)))) AS start
  FROM places JOIN item_grams USING (width, g)
), inside AS (
  SELECT h.*, p.g, count(*) AS k FROM hits h JOIN places p ON p.d = h.d AND p.width = h.width AND p.pos BETWEEN h.start AND h.start + h.length - h.width GROUP BY ALL
), sums AS (
  SELECT i.d, i.item, i.item_id, i.start, i.length, sum(k * coalesce(weight, CAST(round(100 * (1 + ln((SELECT count(*) FROM marks)))) AS BIGINT))) AS own, coalesce(sum(least(k, n) * weight) FILTER (n IS NOT NULL), 0) AS shared
  FROM inside i LEFT JOIN weights USING (width, g) LEFT JOIN item_grams x ON x.item = i.item AND x.g = i.g GROUP BY ALL
), alike AS (
  SELECT *, shared / (own + total - shared) AS similarity FROM sums JOIN totals USING (item) WHERE 100 * shared >= 80 * (own + total - shared)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY d, item_id ORDER BY similarity DESC, start, length DESC) AS r FROM alike
)
SELECT doc_id, item_id, CAST(similarity AS DOUBLE) AS similarity, start, length FROM best JOIN rows USING (d) WHERE r = 1
""",
}
