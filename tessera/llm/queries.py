"""The opN_<name> queries: each applies its operator with production parameters to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontamination, infill, jaccard, katz, lines, pieces, pii, repair, sharding, topk, toxicity, warc
from tessera.llm.common import fold, piece_model, shared_dir, stored, table

ORACLES: dict[str, str] = {}


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record, then read the archives back through their index."""
    path = shared_dir(spark) + "/archives"
    index = warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages"), 1000), path)
    back = warc.read_records(index, path, with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op5_warc"] = """
WITH page AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS first_id FROM page)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM grouped
"""


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Encode and decode every text of documents with the 32k BPE pieces."""
    return pieces.encode(table(spark, sf_dir, "documents"), piece_model(model_path), whole=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every text; labels are learned from the rows outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (F.coalesce(fold("doc_id", 5), F.lit(1)) == 0).alias("held_out"), "score", "predicted")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in each document: doc_id, number of items, their ids, least edit distance."""
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.min("errors").alias("least_errors"),
    )


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's 10 best candidates by integer inner product, through the pivot-distance index."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), shared_dir(spark) + "/vectors")


ORACLES["op8_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 1024) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations, rendered."""
    return chat.render(table(spark, sf_dir, "conversations"))


ORACLES["op7_chat"] = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (
  SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns,
    list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM t GROUP BY conv_id),
p AS (
  SELECT DISTINCT turns[1:k] AS prefix FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c)),
f AS (
  SELECT turns, min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_copies FROM c GROUP BY turns)
SELECT conv_id, n_turns, n_copies,
  array_to_string(list_transform(turns, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || chr(10) || '<|end|>' || chr(10)), '') AS text
FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.prefix = f.turns)
"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: base counts and digest, and all spans."""
    cands = stored(pii.candidates(table(spark, sf_dir, "documents")), shared_dir(spark) + "/candidates")
    found = pii.spans(cands, pii.fit(cands))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[: pii.BASE])),
        F.sha2(pii.written("base"), 256).alias("base_sha256"),
        pii.written("spans").alias("spans"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without the later copies of repeated line runs of 50 words or more."""
    return lines.dedup(table(spark, sf_dir, "documents"), shared_dir(spark) + "/lines")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by four-word shingles at a Jaccard similarity of 0.85 or more."""
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"), shared_dir(spark) + "/jaccard", n=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz bigram scores of every text, learned from the texts outside fold 1 of 5."""
    held_out = F.coalesce(fold("doc_id", 5) == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), (~held_out).alias("learn"), "text")
    model = katz.Model(docs, shared_dir(spark) + "/katz")
    return model.score().select(
        F.col("key").alias("doc_id"), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a fill-in-the-middle example, and the text that is rebuilt from it."""
    made = infill.infill(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


ORACLES["op11_infill"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (
  SELECT doc_id, n, text, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, units,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (
  SELECT doc_id, n, text, form, array_to_string(units[1:a], '') AS x, array_to_string(units[a + 1:b], '') AS y, array_to_string(units[b + 1:], '') AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(x || y || z) AS restored_sha256
FROM p
"""


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on a hash ring with bounded loads, eight shards; the law that holds is that of rows."""
    placed = sharding.assign(table(spark, sf_dir, "documents"), shared_dir(spark) + "/shards", shards=8)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage the conversations by the rule, repair them at least cost, and digest what comes out."""
    rows = table(spark, sf_dir, "conversations")
    return repair.report(repair.damage(rows), rows, shared_dir(spark) + "/repair")
