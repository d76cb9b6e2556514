"""Substring dedup by line hashing: units are normalised and hashed, digests are grouped globally, the earliest ranked
occurrence stays and the others go, with the offsets in the original text retained.

A unit is a line. It is normalised by lower-casing A-Z and turning white space into single blanks; units of fewer than
min_words words are left alone. The query takes every line that is not blank (min_words=1); more is a choice of the caller.
Occurrences are ranked by document id, then by place.

Groups of a digest are merged on the map side, then by (digest, salt), then globally; the way back to the occurrences is a
join on (digest, salt), so a line that a third of all documents hold is spread over as many tasks as there are salts, and no
list of occurrences is collected. The units (ids, offsets, digests of 16 bytes) are a table in the shared folder.

Defined cases: null and empty texts have no units; a null id ranks last; rows that repeat an id are the same document, so an
equal unit at the same place is the kept one in each of them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Workspace, row_key, shuffle_partitions

_FOLD = str.maketrans(UPPER, LOWER)
_SPACE = re.compile(r"[\x09-\x0D\x20]+")


def units(text: str | None, min_words: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(unit, start, length, digest) of the lines with at least min_words words; start and length in code points."""
    start = 0
    for unit, line in enumerate((text or "").split("\n")):
        words = _SPACE.sub(" ", line.translate(_FOLD)).strip(" ")
        if words and words.count(" ") + 1 >= min_words:
            yield unit, start, len(line), hashlib.blake2b(words.encode("utf-8", "replace"), digest_size=16).digest()
        start += len(line) + 1


def repeated_lines(docs: DataFrame, min_words: int = 10, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """A row for each occurrence to remove: (doc_id, unit, start, length, keep_doc_id, keep_start, occurrences)."""
    spark = docs.sparkSession
    salts = salts or max(64, shuffle_partitions(spark))
    small = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            row, out = [], ([], [], [], [])
            for i, text in enumerate(part.column(1).to_pylist()):
                for found in units(text, min_words):
                    row.append(i)
                    for column, value in zip(out, found, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["doc_id", "unit", "start", "length", "digest"])

    kind = small.schema["doc_id"].dataType.simpleString()
    work = Workspace(spark, "lines")
    found = work.table(small.mapInArrow(cut, f"doc_id {kind}, unit long, start long, length long, digest binary"), "units")
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "unit"), F.lit(salts)).cast("int"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("start"))
    salted = found.groupBy("digest", "salt").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    groups = salted.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("occurrences"), F.collect_list("salt").alias("salts")).filter("occurrences > 1")
    groups = work.table(groups.select("digest", F.explode("salts").alias("salt"), F.col("first.doc_id").alias("keep_doc_id"), F.col("first.start").alias("keep_start"), "occurrences"), "groups")
    out = found.join(groups, ["digest", "salt"]).filter(~(F.col("doc_id").eqNullSafe(F.col("keep_doc_id")) & (F.col("start") == F.col("keep_start"))))
    return out.select("doc_id", "unit", "start", "length", "keep_doc_id", "keep_start", "occurrences")


def remove_repeated_lines(docs: DataFrame, min_words: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the repeated lines, all columns kept, and `removed`: array of (start, length) in the original text (a column
    of that name is replaced). A document is an id with a text: ids that are null or repeat with other texts are told apart."""
    key = row_key(id_col, F.col(text_col))
    found = repeated_lines(docs.select(key.alias("doc_id"), F.col(text_col).alias("text")), min_words)
    spans = found.select("doc_id.*", F.struct("start", "length").alias("s")).distinct()
    spans = spans.groupBy(*(F.col(c).alias(f"_key_{c}") for c in ("none", "id", "digest"))).agg(F.sort_array(F.collect_list("s")).alias("_removed"))
    same = F.col("_row_key.none").eqNullSafe(F.col("_key_none")) & F.col("_row_key.id").eqNullSafe(F.col("_key_id")) & (F.col("_row_key.digest") == F.col("_key_digest"))

    @F.pandas_udf("string")
    def without(texts: pd.Series, removed: pd.Series) -> pd.Series:
        out = []
        for text, gone in zip(texts, removed, strict=True):
            if text is not None and gone is not None and len(gone):
                starts, at, kept = {int(g["start"]) for g in gone}, 0, []
                for line in text.split("\n"):
                    if at not in starts:
                        kept.append(line)
                    at += len(line) + 1
                text = "\n".join(kept)
            out.append(text)
        return pd.Series(out, dtype=object)

    out = docs.withColumn("_row_key", key).join(spans, same, "left").withColumn(text_col, without(F.col(text_col), F.col("_removed")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c != "removed"), F.col("_removed").alias("removed"))
