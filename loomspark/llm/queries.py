"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.llm import decontaminate, exact_topk, lm_score, near_dedup, secret_scan, sentencepiece_codec, substring_dedup, token_output, toxicity
from loomspark.llm.common import documents, shared_dir


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark, sf_dir):
    return near_dedup.classes(documents(spark, sf_dir))


def op2_token_output(spark, sf_dir):
    path = shared_dir(spark, "token-ids")
    parts = token_output.write(documents(spark, sf_dir), path, tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return token_output.read(spark, path, parts)


def op8_secret_scan(spark, sf_dir):
    return secret_scan.secrets_digest(spark, documents(spark, sf_dir))


def op10_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, toxicity.fold(F.col("doc_id"), 3) != 1)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (toxicity.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def op5_decontaminate(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.leaks(documents(spark, sf_dir).select("doc_id", "text"), items)
    return found.select("doc_id", (F.size("leaked_items") > 0).alias("contaminated"), F.col("leaked_items.item_id").alias("item_ids"), F.col("leaked_items.share").alias("shares"))


def op7_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encode(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model")).drop("text")


def op9_token_counts(spark, sf_dir):
    return sentencepiece_codec.token_counts(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op3_substring_dedup(spark, sf_dir):
    found = substring_dedup.dedup(documents(spark, sf_dir), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM w, unnest(range(1, len(ws) - 48)) t(i) WHERE len(ws) >= 50
), firsts AS (
  SELECT k, min(doc_id) AS first_id FROM starts GROUP BY k
), gone AS (
  SELECT DISTINCT s.doc_id, s.i + j AS p FROM starts s JOIN firsts f USING (k), unnest(range(0, 50)) t(j) WHERE f.first_id < s.doc_id
), lost AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
"""


def op4_exact_topk(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk.search(vectors, F.col("vec_id") % 20 == 0, k=20, vector="embedding", scale=64.0)


_FOLDED = r"regexp_extract_all(lower(coalesce(%s, '')), '[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+')"
_RUNS = "SELECT DISTINCT {id}, array_to_string({w}[i:i + 4], ' ') AS g FROM {t}, unnest(range(1, len({w}) - 3)) u(i)"
#: An item lies in a document if the document has four fifths of its five-word runs, and of its question and its answer one run each, or all words in a row if they are fewer than five.
_PART = "(len({x}) = 0 OR CASE WHEN len({x}) < 5 THEN contains(' ' || array_to_string(d.ws, ' ') || ' ', ' ' || array_to_string({x}, ' ') || ' ') ELSE EXISTS (SELECT 1 FROM {r} r JOIN dr USING (g) WHERE r.item_id = m.item_id AND dr.doc_id = m.doc_id) END)"
LEAKS_SQL = f"""
WITH d AS (SELECT doc_id, {_FOLDED % 'text'} AS ws FROM documents), dr AS ({_RUNS.format(id='doc_id', w='ws', t='d')}),
p AS (SELECT item_id, string_split_regex(text, '\\s+') AS s FROM benchmark),
b AS (SELECT item_id, {_FOLDED % "array_to_string(s[1:len(s) - len(s) // 4], ' ')"} AS q, {_FOLDED % "array_to_string(s[len(s) - len(s) // 4 + 1:], ' ')"} AS a FROM p),
w AS (SELECT item_id, list_concat(q, a) AS ws FROM b),
e AS ({_RUNS.format(id='item_id', w='ws', t='w')}), qr AS ({_RUNS.format(id='item_id', w='q', t='b')}), ar AS ({_RUNS.format(id='item_id', w='a', t='b')}),
n AS (SELECT item_id, count(*) AS n FROM e GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS c FROM dr JOIN e USING (g) GROUP BY doc_id, item_id),
f AS (SELECT m.doc_id, m.item_id, c / n AS share FROM m JOIN n USING (item_id) JOIN b USING (item_id) JOIN d ON d.doc_id = m.doc_id
  WHERE c >= 0.8 * n - 1e-9 AND {_PART.format(x='b.q', r='qr')} AND {_PART.format(x='b.a', r='ar')}),
l AS (SELECT doc_id, list(item_id ORDER BY item_id) AS item_ids, list(share ORDER BY item_id) AS shares FROM f GROUP BY doc_id)
SELECT doc_id, item_ids IS NOT NULL AS contaminated, coalesce(item_ids, []) AS item_ids, coalesce(shares, []) AS shares FROM documents LEFT JOIN l USING (doc_id)
"""


def op6_lm_score(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = toxicity.fold(F.col("doc_id"), 10) == 0
    model = lm_score.train(docs.filter(~held_out))
    return lm_score.score(docs, model, held_out)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

QUERIES = {"op3_substring_dedup": op3_substring_dedup, "op1_near_dedup": op1_near_dedup, "op6_lm_score": op6_lm_score, "op4_exact_topk": op4_exact_topk, "op7_sentencepiece": op7_sentencepiece, "op9_token_counts": op9_token_counts, "op5_decontaminate": op5_decontaminate, "op10_toxicity": op10_toxicity, "op2_token_output": op2_token_output, "op8_secret_scan": op8_secret_scan}
ORACLES: dict[str, str] = {"op5_decontaminate": LEAKS_SQL, "op3_substring_dedup": SUBSTRING_SQL, "op4_exact_topk": TOPK_SQL}
