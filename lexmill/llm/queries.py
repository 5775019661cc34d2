"""The registered query of each corpus operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, fingerprints, line_dedup, mixing, near_dedup, packing, prefix_trie, secrets, segmentation, sharding, token_files, toxicity, vector_codes
from .common import new_path


#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates by sets of 4-word shingles at similarity 0.8."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op2_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as ORC files and read back."""
    path = new_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, f"{TOKENIZERS}/word_bpe_49k.json", end_id=1)
    return token_files.index_token_files(spark, path)


def op3_bloom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose key at least 10 documents hold go everywhere."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.digest(line_dedup.drop_repeated_lines(docs, min_chars=1, min_docs=10))


def op4_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix as large as the corpus with weights 5, 2, 1, no source above 3 times its size."""
    docs = _table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("text_id"), mixing.word_count("text").alias("size"))
    taken = mixing.copies(sized, [5.0, 2.0, 1.0], cap=3.0, size=F.col("size"), text_id=F.col("text_id"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every text."""
    return segmentation.digest(segmentation.encode_samples(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model", k=2))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op7_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text; sources are the owners and documents the repositories."""
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents"), owner="source", repository="doc_id", max_owners=2, max_repositories=8))


def op8_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight equal shards, and where each row goes with a ninth."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), [1.0] * 8)


def op9_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of each label at cosine 0.98."""
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document, learnt from the labelled rows that are not held out."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.digest(toxicity.score_documents(_table(spark, sf_dir, "documents"), labels))


def op11_grouping_genetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json", end_id=1, capacity=4096)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_active_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of four parts of every vector, by codebooks of 256 entries after four rounds."""
    return vector_codes.digest(*vector_codes.compress(_table(spark, sf_dir, "embeddings")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_odd_sketch": op1_odd_sketch,
    "op2_orc_tokens": op2_orc_tokens,
    "op3_bloom_lines": op3_bloom_lines,
    "op4_pivotal_mix": op4_pivotal_mix,
    "op5_gumbel_pieces": op5_gumbel_pieces,
    "op6_winnowing": op6_winnowing,
    "op7_ownership": op7_ownership,
    "op8_rendezvous": op8_rendezvous,
    "op9_product_quantisation": op9_product_quantisation,
    "op10_nearest_toxicity": op10_nearest_toxicity,
    "op11_grouping_genetic": op11_grouping_genetic,
    "op12_active_lloyd": op12_active_lloyd,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op1_odd_sketch": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least_id AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id,
  coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_id ON a = d.doc_id
""",
    "op3_bloom_lines": r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
    unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM common)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
""",
    "op9_product_quantisation": r"""
WITH RECURSIVE vecs AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
edges AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a JOIN vecs b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least_id AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, e.vec_id) AS component_id,
  coalesce(c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN least_id l ON l.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
""",
    "op7_ownership": secrets.oracle_sql(max_owners=2, max_repositories=8),
    "op12_active_lloyd": vector_codes.oracle_sql(),
    "op13_prefix_trie": prefix_trie.oracle_sql(),
}
