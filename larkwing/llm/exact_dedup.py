"""Exact dedup by skew-safe combining, in DataFrame operations only.

Three stages compare full content, never digests alone: the map side of the first aggregation merges equal texts inside a
partition, its reduce side merges them inside a (digest, salt) group, and a second aggregation combines the salt winners.
A group that holds a third of all rows is thus at most one row per partition and salt when it is shuffled, and at most one
row per salt when it meets. The way back to the rows is a join on (digest, salt), so the same group is spread over as many
tasks as there are salts; no member list is ever collected.

Texts that differ but share a digest are kept apart: the second stage counts the contents of a digest, and the rows of
those digests (none, for SHA-256) go back by a join on the content itself.

Defined cases: a null text is empty; a null id never wins over another id, and an all-null group keeps null; rows that
repeat the kept id with an equal text all carry kept = true; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, row_key, sha256, shuffle_partitions, with_keys


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: (doc_id, keep_id, group_size, kept, text_sha256). Of the texts that are equal after
    lower-casing A-Z the row with the largest id is kept. digest may be any function of the text, weak ones included."""
    spark = docs.sparkSession
    salts = salts or max(64, shuffle_partitions(spark))
    norm = ascii_lower(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select("doc_id", "norm", digest(F.col("norm")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))

    salted = rows.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    contents = salted.repartition(F.col("digest")).groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    digests = contents.groupBy("digest").agg(
        F.count("*").alias("contents"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("salts"))).alias("salts"),
    )
    work = Workspace(spark, "exact-dedup")
    digests = work.table(digests, "digests")

    # the way back by (digest, salt); a singleton row has one salt, a hot digest one row per salt
    groups = digests.filter("contents = 1").select("digest", F.explode("salts").alias("salt"), "keep_id", F.col("n").alias("group_size"))
    full = F.hex if digest is sha256 else None
    sha = F.lower(full(F.col("digest"))) if full else F.sha2(F.col("norm"), 256)
    keys = rows.select("doc_id", "digest", "salt", sha.alias("text_sha256")) if digest is not sha256 else rows.select("doc_id", "digest", "salt")
    out = keys.join(groups, ["digest", "salt"])
    out = out.select("doc_id", "keep_id", "group_size", (sha if full else F.col("text_sha256")).alias("text_sha256"))
    shared = digests.filter("contents > 1")
    if not shared.isEmpty():
        clash = rows.join(shared.select("digest"), "digest")
        salted = clash.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("k"), F.count("*").alias("n"))
        winners = salted.groupBy("norm").agg(F.max("k").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts"))
        winners = winners.select("norm", F.explode("salts").alias("salt"), "keep_id", "group_size")
        out = out.unionByName(clash.join(winners, ["norm", "salt"]).select("doc_id", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256")))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, one that exact_dedup() keeps; all columns stay."""
    kept = exact_dedup(docs, id_col, text_col).filter("kept")
    kept = kept.select(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("digest"))
    return with_keys(docs, row_key(id_col, ascii_lower(F.col(text_col))), kept)
