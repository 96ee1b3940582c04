"""Driver-facing queries over the training-data tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.alignment import align
from trawl.llm.common import shared_folder, table
from trawl.llm.decontaminate import leaks
from trawl.llm.embeddings import near_vectors
from trawl.llm.html import extract
from trawl.llm.linededup import dedup_lines
from trawl.llm.packing import pack
from trawl.llm.prefixtrie import trie
from trawl.llm.quality import judge
from trawl.llm.sanitise import personal_data
from trawl.llm.sharding import numbered, resharded_files
from trawl.llm.simhash import simhash_groups
from trawl.llm.tokenfile import token_digest
from trawl.llm.toxicity import toxicity


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "perplexity", "cut", "kept")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old shards hold whole sources, as a crawl leaves them, so they are far from equal."""
    old = F.pmod(F.crc32(F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary")), F.lit(16))
    moved = numbered(resharded_files(table(spark, sf_dir, "documents"), old, f"{shared_folder(spark)}/sharding-{uuid.uuid4().hex}"))
    return moved.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_sharding": op4_sharding,
    "op5_html_extraction": op5_html_extraction,
    "op6_decontamination": op6_decontamination,
    "op7_token_output": op7_token_output,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_embedding_neardup": op10_embedding_neardup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_pii": op13_pii,
}

#: CRC-32 of a decimal number, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"

ORACLES: dict[str, str] = {
    "op11_prefix_trie": f"""WITH turns AS (SELECT conv_id AS c, turn, coalesce(text, '') AS x, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(m ORDER BY turn NULLS FIRST, m) AS ms, list(strlen(x) ORDER BY turn NULLS FIRST, m) AS ns, {_CRC} % 9 AS h FROM turns GROUP BY c),
paths AS (SELECT o.c, list_concat(list_slice(coalesce(f.ms, []), 1, o.h), list_slice(o.ms, o.h + 1, len(o.ms))) AS ms, list_concat(list_slice(coalesce(f.ns, []), 1, o.h), list_slice(o.ns, o.h + 1, len(o.ns))) AS ns FROM own o LEFT JOIN own f ON f.c = o.c - o.c % 5),
held AS (SELECT c, d, array_to_string(list_slice(ms, 1, d), '') AS node, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS size, d = len(ms) AS ends FROM (SELECT *, unnest(range(0, len(ms) + 1)) AS d FROM paths)),
nodes AS (SELECT node, d AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256, left(node, greatest(32 * (d - 1), 0)) AS above FROM held GROUP BY node, d),
kids AS (SELECT above AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
below AS (SELECT left(n.node, 32 * k) AS node, sum(saved) AS saved_tokens, count(*) FILTER (kids.node IS NULL) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM nodes) n LEFT JOIN kids ON kids.node = n.node GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.above""",
}
