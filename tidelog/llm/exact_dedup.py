"""Exact deduplication with DataFrame functions alone (operator 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, lower_ascii, with_row_keys

#: Parts into which the rows of one text are split before their winners meet.
SALTS = 64


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the largest doc_id of a group stays.

    Each task first combines its own equal texts (Spark's partial aggregate over digest,
    salt and whole text). The salt is the input partition's number modulo `salts`, so a
    group of any size is merged by up to `salts` tasks, none of which gets more than one
    row per map task; then the salt winners, at most `salts` for a text, are combined
    globally. Both merges group by the whole text and not by the digest alone. Decisions
    go back to the documents over digest, second digest and length, a plain inner join
    whose large keys adaptive execution splits.

    Null texts count as empty; empty texts form a group as any other. Rows that repeat a
    doc_id all carry the same decision. A null doc_id loses to any other; where a group has
    null ids only, keep_id is null and all are kept. An empty table gives an empty result.
    """
    rows = id_text(docs).select("doc_id", lower_ascii(F.col("text")).alias("norm"))
    digest = F.unhex(F.sha2(F.col("norm"), 256))
    local = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy(digest.alias("digest"), "salt", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    groups = (
        local.groupBy("digest", "norm")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .select("digest", F.xxhash64("norm").alias("second"), F.octet_length("norm").alias("bytes"), "keep_id", "group_size")
    )
    marked = rows.select("doc_id", digest.alias("digest"), F.xxhash64("norm").alias("second"), F.octet_length("norm").alias("bytes"))
    return marked.join(groups, ["digest", "second", "bytes"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def exact_dedup_filter(docs: DataFrame) -> DataFrame:
    """One row of each text, with all its columns: of the largest doc_id, and one where rows repeat an id or have none."""
    rows = with_row_keys(docs)
    keep = exact_dedup(rows.select(F.col("_tidelog_row").alias("doc_id"), "text")).filter("kept").select(F.col("doc_id").alias("_tidelog_row"))
    return rows.join(keep, "_tidelog_row", "left_semi").select(docs.columns)


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
