"""Registered queries of the training-data operators; each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm import alignment, bond, decontaminate, jaccard, langid, packing, pii, quality_qda, quality_rules, slack_packing, token_files, toxicity, warc
from spanframe.llm.common import bound_batches, shared_path

#: Token that ends a document, and tokens of a packed sequence.
END_ID, CAPACITY = 2, 1024
#: Tokens of a sequence packed by least slack.
LONG_CAPACITY = 4096
#: Least quality score of a document that is kept.
KEEP_AT = 0.7
#: Least score of a toxic document.
TOXIC_AT = 0.5
#: Key of the surrogates in these queries; a production run brings its own.
SURROGATE_KEY = b"registered queries"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bound_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality_qda.learn(documents, table(spark, sf_dir, "labels"), 4, 2)
    scored = quality_qda.verdicts(quality_qda.score(documents, model, "doc_id"), KEEP_AT)
    return scored.select("doc_id", quality_qda.held_out(4, 2), "score", "predicted")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_rules.judge(documents, quality_rules.learn(documents, table(spark, sf_dir, "labels"), 4, 2), "doc_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = langid.identify(documents, langid.learn(documents, 4, 2), "doc_id")
    return found.select("doc_id", quality_qda.held_out(4, 2), "lang_pred", "score", "ambiguous")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, END_ID)
    return token_files.read_token_files(spark, path)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY, "n_entities")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), 3, 90)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END_ID)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(warc.with_revisits(table(spark, sf_dir, "pages")), shared_path(spark, "warc"))
    return warc.read_archives(files).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    codes = langid.learn(documents, 5, 0)
    net = toxicity.learn(documents, table(spark, sf_dir, "labels"), codes, 5, 0)
    scored = quality_qda.verdicts(toxicity.score(documents, net, codes, "doc_id"), TOXIC_AT)
    return scored.select("doc_id", quality_qda.held_out(5, 0), "score", "predicted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond.hard_negatives(table(spark, sf_dir, "embeddings"), label, every=50, positives=5, negatives=3, low=(50, 100), high=(95, 100))


def op12_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), LONG_CAPACITY, END_ID)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_classifier, op2_quality_rules, op3_decontamination, op4_token_files, op5_language_id, op6_pii, op7_jaccard_join, op8_best_fit_packing, op9_warc, op10_toxicity, op11_hard_negatives, op12_slack_packing, op13_tokenizer_alignment)}
#: DuckDB text where SQL says it all: links and components, page records, exact vector scores. The others depend on learnt models, edit distances, keys or a tokenizer.
ORACLES: dict[str, str] = {
    "op7_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END) AS x FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.doc_id)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r) AS component_id FROM documents d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""",
    "op9_warc": """
SELECT page_id, strlen(t) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((CAST('0x' || substring(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM (SELECT page_id, t, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS m FROM (SELECT page_id, coalesce(html, '') AS t FROM pages))""",
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT * FROM (SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM s WHERE same) WHERE k <= 5)
SELECT * FROM (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score) WHERE rank <= 3""",
}
