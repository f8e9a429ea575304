"""The corpus operators' queries, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecinity.llm import decontaminate, edit_fingerprint, html_extract, jaccard_join, language, language_model, line_dedup, packing, toxicity, warc
from vecinity.llm.language import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark, sf_dir):
    return html_extract.extract_pages(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out(F.col("doc_id"), 3, 1)), "text", "lang", "doc_id")
    return language.predict(docs.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def op3_decontaminate(spark, sf_dir):
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, o.n, i, item_id FROM occ o JOIN win USING (n, g)),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hit GROUP BY r),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM hit)) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN items USING (r) LEFT JOIN words USING (r)
"""


def op4_fingerprints(spark, sf_dir):
    return edit_fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def edit_near_duplicates(spark, sf_dir):
    """Classes of documents by the banding and verification of op4's fingerprints."""
    return edit_fingerprint.near_duplicates(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark, sf_dir):
    scored = language_model.score(table(spark, sf_dir, "documents"), "crc32(coalesce(cast(doc_id as string), '')) % 7 <> 2")
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS last FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 4), lambda k: array_to_string(list_transform(range(0, 8), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, (k * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * j)::INT) & 31)::INT + 1, 1)), '')), '') AS d FROM x)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM b
"""


def op7_line_dedup(spark, sf_dir):
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT r, source, i, x, regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '') AS t FROM (SELECT r, source, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM d WHERE text IS NOT NULL)),
pages AS (SELECT source, count(*) AS p FROM d GROUP BY source),
seen AS (SELECT source, t, count(DISTINCT r) AS c FROM lines WHERE t <> '' GROUP BY source, t),
boil AS (SELECT s.source, t FROM seen s JOIN pages p ON s.source IS NOT DISTINCT FROM p.source WHERE c >= {line_dedup.MIN_PAGES} AND c > {line_dedup.RATIO}::DOUBLE * p),
kept AS (SELECT r, string_agg(x, chr(10) ORDER BY i) AS k, count(*) AS n FROM lines l WHERE NOT EXISTS (SELECT 1 FROM boil b WHERE b.source IS NOT DISTINCT FROM l.source AND b.t = l.t) GROUP BY r)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(l) END::BIGINT AS n_lines, CASE WHEN text IS NULL THEN 0 ELSE len(l) - coalesce(n, 0) END::BIGINT AS n_dropped,
CASE WHEN text IS NOT NULL THEN length(coalesce(k, '')) END::BIGINT AS n_chars_kept, CASE WHEN text IS NOT NULL THEN md5(coalesce(k, '')) END AS text_md5
FROM d LEFT JOIN kept USING (r)
"""


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def op9_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.components(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id))::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
"""


def tokenizer_path() -> str:
    """Where the public vocabulary lies; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_language_id, op3_decontaminate, op4_fingerprints, op5_lm_scoring, op6_warc, op7_line_dedup, op8_toxicity, op9_ngram_jaccard_join, op10_packing, edit_near_duplicates)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3_SQL, "op6_warc": OP6_SQL, "op7_line_dedup": OP7_SQL, "op9_ngram_jaccard_join": OP9_SQL}
