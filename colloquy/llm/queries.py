"""The registered queries opN_<name> and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import align, cuckoo, decontaminate, jaccard_tree, mixing, quality, repair, sharding, suffix_dedup, token_count, toxicity, url_filter, warc
from .common import read, staging_path


def op4_jaccard_join(spark, sf_dir):
    """Classes of documents whose 3-word shingle sets reach Jaccard 0.9."""
    return jaccard_tree.classes(read(spark, sf_dir, "documents"), k=3, num=9, den=10)


def op5_token_counts(spark, sf_dir):
    """Tokens of every document as byte_bpe_50k.json gives them."""
    import public_tokenizers
    return token_count.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item, with the nearest stretch."""
    return decontaminate.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("key")


def op8_warc(spark, sf_dir):
    """Write a WARC record per page, index first, and read all records back by the index."""
    index = warc.write(read(spark, sf_dir, "pages"), staging_path(spark, "warc"))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_rules(spark, sf_dir):
    """Rule bitmask ledger over all documents."""
    return quality.quality_ledger(read(spark, sf_dir, "documents"))


def op1_toxicity(spark, sf_dir):
    """Toxicity of every document and its offending sentences."""
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_url_filter(spark, sf_dir):
    """Verdict on every page's URL."""
    rows = url_filter.judge(read(spark, sf_dir, "pages"))
    return rows.withColumns({c: F.round(c, 6) for c in ("score", "p_allow")})


def op3_source_mixing(spark, sf_dir):
    """Words that a low-discrepancy source schedule takes from every document."""
    return mixing.mix(read(spark, sf_dir, "documents"))


def op6_sharding(spark, sf_dir):
    """Shard of every document by the permutation-filled table."""
    return sharding.assign(read(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


def op10_suffix_dedup(spark, sf_dir):
    """Bytes of every document without the 400-byte strings that occur elsewhere."""
    rows = suffix_dedup.remove(read(spark, sf_dir, "documents")).drop("kept")
    return rows.withColumns({"n_kept": F.col("n_bytes") - F.col("n_removed"), "repeated": F.col("n_removed") > 0})


def op11_exact_dedup(spark, sf_dir):
    """Groups of equal texts by a cuckoo-filter index of all documents."""
    return cuckoo.groups(read(spark, sf_dir, "documents"), staging_path(spark, "cuckoo"))


def op12_conversation_repair(spark, sf_dir):
    """Cheapest repair of every conversation after the stated damage."""
    rows = read(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(rows), rows)


def op13_token_alignment(spark, sf_dir):
    """Groups and links between the tokens of two tokenizers, with corpus-wide pair counts."""
    import public_tokenizers
    return align.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


#: All pairs that share a shingle, then classes by spreading the least id.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN length(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(list_slice(ws, i, i + 2), ' ') END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(length(ws) - 1, 2)::BIGINT)) AS i FROM w WHERE length(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.id AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS id FROM r GROUP BY a) m ON m.a = w.doc_id
"""


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_url_filter, op3_source_mixing, op4_jaccard_join, op5_token_counts, op6_sharding, op7_decontamination, op8_warc, op9_quality_rules, op10_suffix_dedup, op11_exact_dedup, op12_conversation_repair, op13_token_alignment)}
ORACLE = {"op11_exact_dedup": cuckoo.ORACLE, "op2_url_filter": url_filter.ORACLE, "op8_warc": warc.ORACLE, "op3_source_mixing": mixing.ORACLE, "op4_jaccard_join": JACCARD_SQL, "op6_sharding": sharding.ORACLE, "op9_quality_rules": quality.ORACLE}
