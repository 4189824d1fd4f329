"""The pN_ queries over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import spread, table
from . import language, leaks, mixing, neighbours, overlap, pairs, scans, spam, splitting, truncation
from ._frames import once

ALPACA = "train_round2_residual_fix_alpaca"
#: The public vocabulary that sizes are counted in.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _manual(spark, sf_dir, *cols):
    return once(spread(table(spark, sf_dir, "manual_info").select("unique_id", "page_content", "metadata", "ingested_at")), "unique_id", *cols)


def p1_found(spark, sf_dir):
    d = _manual(spark, sf_dir, "page_content", ("source", F.col("metadata.source")))
    return scans.scan_noise(d).select("unique_id", "kind", "fixed").distinct()


def p1_repaired(spark, sf_dir):
    d = _manual(spark, sf_dir, "page_content", ("source", F.col("metadata.source")))
    return scans.repaired_text(d, scans.scan_noise(d))


def p2_found(spark, sf_dir):
    d = _manual(spark, sf_dir, "page_content", *((c, F.col(f"metadata.{c}")) for c in ("source", "parent_id", "chunk_level")))
    return truncation.truncated(d).where("cut").select("unique_id")


def p2_rates(spark, sf_dir):
    d = _manual(spark, sf_dir, "page_content", *((c, F.col(f"metadata.{c}")) for c in ("source", "parent_id", "chunk_level")))
    return truncation.truncation_rates(truncation.truncated(d))


def p3_found(spark, sf_dir):
    d = spread(table(spark, sf_dir, "manual_info").select("unique_id", "page_content"))
    return splitting.oversized_kinds(d, "unique_id", "page_content")


def p3_pieces(spark, sf_dir):
    return splitting.split_oversized(_manual(spark, sf_dir, "page_content"), "unique_id", "page_content")


def p4_found(spark, sf_dir):
    rows = table(spark, sf_dir, "vector_rows").select("vec_id", "embedding", "ingested_at")
    return neighbours.similar_pairs(neighbours.most_similar(rows))


def p5_found(spark, sf_dir):
    rows = spread(table(spark, sf_dir, ALPACA).select("row_id", "file_name", "input", "output"))
    rows = overlap.with_split(rows, table(spark, sf_dir, "dataset_info"))
    p = overlap.cross_split_overlaps(rows)
    return p.select(F.least("eval_key", "train_key").alias("row_id_a"), F.greatest("eval_key", "train_key").alias("row_id_b")).distinct()


def p5_report(spark, sf_dir):
    rows = spread(table(spark, sf_dir, ALPACA).select("row_id", "file_name", "input", "output"))
    rows = overlap.with_split(rows, table(spark, sf_dir, "dataset_info"))
    return overlap.overlap_report(overlap.linked_records(*overlap.cross_split_links(rows)), rows)


def p6_found(spark, sf_dir):
    rows = spread(table(spark, sf_dir, ALPACA).select("row_id", "instruction", "input", "output", "lang"))
    return pairs.broken_pairs(rows, language.fit_model(rows, "input", "lang"))


def p7_found(spark, sf_dir):
    m = table(spark, sf_dir, "manual_info").select(F.col("unique_id").alias("row_key"), F.col("page_content").alias("text"), F.col("metadata.lang").alias("label"))
    a = table(spark, sf_dir, ALPACA).select(F.col("row_id").cast("string").alias("row_key"), F.col("input").alias("text"), F.col("lang").alias("label"))
    model = language.fit_model(m.unionByName(a), "text", "label")
    out = None
    for name, d in (("manual_info", m), (ALPACA, a)):
        langs = language.document_languages(spread(d), model, "row_key", "text")
        labels = d.select("row_key", "label").dropDuplicates(["row_key"])
        bad = language.wrong_labels(langs, labels, "row_key", "label").select(F.lit(name).alias("table_name"), "row_key", "lang")
        out = bad if out is None else out.unionByName(bad)
    return out


def p7_segments(spark, sf_dir):
    m = _manual(spark, sf_dir, ("text", F.col("page_content")), ("label", F.col("metadata.lang"))).withColumnRenamed("unique_id", "row_key")
    a = once(table(spark, sf_dir, ALPACA), "row_id", ("text", F.col("input")), ("label", F.col("lang"))).select(F.col("row_id").cast("string").alias("row_key"), "text", "label")
    model = language.fit_model(m.unionByName(a), "text", "label")
    m, a = (language.segment_languages(d, model, "row_key", "text").select(F.lit(n).alias("table_name"), "*") for n, d in (("manual_info", m), (ALPACA, a)))
    return m.unionByName(a)


def p8_found(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    items = table(spark, sf_dir, "eval_inputs").select("sample_id", "gold_answer")
    return leaks.leaked_passages(docs, items)


def p9_mix(spark, sf_dir):
    return mixing.mix(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), table(spark, sf_dir, "mix_targets"), VOCABULARY)[0]


def p9_shares(spark, sf_dir):
    return mixing.mix(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), table(spark, sf_dir, "mix_targets"), VOCABULARY)[1]


def p10_found(spark, sf_dir):
    return spam.stuffed_pages(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_rates, p3_found, p3_pieces, p4_found, p5_found, p5_report, p6_found, p7_found, p7_segments, p8_found, p9_mix, p9_shares, p10_found)}


def oracle_sql() -> dict:
    from .oracles import ORACLES

    return dict(ORACLES)
