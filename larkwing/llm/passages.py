"""Passages that repeat across documents, wherever their lines break.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A window is `least` consecutive words; it repeats if documents of two
ids hold it, and belongs to the smallest of these ids, nulls last. A passage is a longest run of repeated windows of a
document that belong to one id; passages of a document overlap by up to least - 1 words where the owner changes.

Of the windows only anchors are shuffled. The grams of a window are its runs of (least + 1) // 2 words; the one with the least
hash, of equal ones the last, is the window's anchor. It hangs on the window's words alone, so all occurrences of a window
have equal anchors. Consecutive windows share an anchor (about 2 in `least` / 2 words start a new one), and the words
of all windows of an anchor are its context. A gram that one document holds has no repeated window. A gram of one context in
several documents: all its windows belong to the smallest id. Only where contexts of a gram differ, as at the ends
of a passage, windows are cut and compared one by one. Nothing is sampled or capped; a clash of gram hashes costs only time.
Contexts and windows are compared by digests of 16 bytes.

Joins are on the gram's or window's hash, plain inner joins that AQE splits where a passage is very common: what is counted by
a hash is written first, as a join in the stage of its own count is not split. Anchors, grams, hits, windows and owners are
tables in the shared folder; texts are shuffled once.

Defined cases: null, empty and shorter texts have no windows; rows that repeat an id are the same document, each with its own
passages if texts differ, rows equal in both count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Odd, so it has an inverse; hashes of grams are polynomials in it, modulo 2^64.
BASE = 0x9E3779B97F4A7C15
#: Windows that are ranked, and about as many rows as are returned at once; words whose hashes a worker keeps, and the length of the longest of them.
BLOCK, KEPT, LONG = 1 << 16, 1 << 18, 64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= LONG:
            if len(self) >= KEPT:
                self.clear()
            self[word] = found
        return found


_hashes = _Hashes()


def split(text: bytes | None) -> list[bytes]:
    """bytes.lower() and bytes.split() know A-Z, blanks and \\x09-\\x0D only."""
    return (text or b"").lower().split()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def grams_of(words: list[bytes], size: int) -> np.ndarray:
    """A hash of 64 bits for each run of so many words."""
    values = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(pow(BASE, -1, 1 << 64), len(words)), dtype=np.uint64)])
    x = (sums[size:] - sums[:-size]) * _powers(BASE, len(words) - size + 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def anchors(words: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, gram) of each anchor; a window goes by its first word."""
    size = (least + 1) // 2
    across, n = least - size + 1, len(words) - least + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = grams_of(words, size)
    seen = sliding_window_view(grams, across)
    at = np.concatenate([np.arange(b, min(n, b + BLOCK)) + across - 1 - seen[b : b + BLOCK, ::-1].argmin(1) for b in range(0, n, BLOCK)])
    ends = np.flatnonzero(np.diff(at))
    return np.append(0, ends + 1), np.append(ends, n - 1), grams[at[np.append(ends, n - 1)]]


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _holders() -> list[Column]:
    return [F.min("doc_id").alias("keep_doc_id"), F.max("doc_id").alias("_last"), F.max(F.col("doc_id").isNull().cast("int")).alias("_none")]


_SHARED = "keep_doc_id <> _last OR keep_doc_id IS NOT NULL AND _none = 1"


def repeated_passages(docs: DataFrame, least: int = 51, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each passage of at least so many words: (doc_id, first_word, n_words, keep_doc_id, kept). Words count from 0; kept: the passage belongs to this document."""
    if least < 2:
        raise ValueError("a window has two words at least")
    small = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).cast("binary").alias("text"))
    kind = small.schema["doc_id"].dataType.simpleString()
    work = Workspace(docs.sparkSession, "passages")

    def packed(part: pa.RecordBatch, rows: list[int], columns: list[np.ndarray], digests: list[bytes], names: list[str]) -> pa.RecordBatch:
        of, both = pa.array(rows, pa.int64()), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), *map(pa.array, [*columns, both[:, 0], both[:, 1]])], names=["doc_id", "row", *names])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, found, digests = [], [], []
            for i, text in enumerate(part.column(2)):
                words = split(text.as_py())
                first, last, gram = anchors(words, least)
                rows += [i] * len(first)
                found.append((first, last, gram.view(np.int64)))
                digests += [_digest(words[a : b + least]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                if len(rows) >= BLOCK or rows and i + 1 == part.num_rows:
                    yield packed(part, rows, [np.concatenate(x) for x in zip(*found, strict=True)], digests, ["first", "last", "gram", "c1", "c2"])
                    rows, found, digests = [], [], []

    def windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, first, digests = [], [], []
            for i, (text, ranges) in enumerate(zip(part.column(2), part.column(3), strict=True)):
                words = split(text.as_py())
                for r in ranges.as_py():
                    places = range(r["first"], r["last"] + 1)
                    rows += [i] * len(places)
                    first += places
                    digests += [_digest(words[s : s + least]) for s in places]
                    if len(rows) >= BLOCK:
                        yield packed(part, rows, [np.array(first, np.int64)], digests, ["first", "w1", "w2"])
                        rows, first, digests = [], [], []
            if rows:
                yield packed(part, rows, [np.array(first, np.int64)], digests, ["first", "w1", "w2"])

    found = work.table(small.mapInArrow(cut, f"doc_id {kind}, row long, first long, last long, gram long, c1 long, c2 long"), "anchors")
    several = F.expr("min(c1) <> max(c1) OR min(c2) <> max(c2)").alias("several")
    grams = work.table(found.groupBy("gram").agg(*_holders(), several).filter(_SHARED).select("gram", "keep_doc_id", "several"), "grams")
    hits = work.table(found.drop("c1", "c2").join(grams, "gram").drop("gram"), "hits")

    ranges = hits.filter("several").groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    texts = small.join(ranges, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))).select("doc_id", "row", "text", "ranges")
    single = work.table(texts.mapInArrow(windows, f"doc_id {kind}, row long, first long, w1 long, w2 long"), "windows")
    owners = work.table(single.groupBy("w1", "w2").agg(*_holders()).filter(_SHARED).select("w1", "w2", "keep_doc_id"), "owners")
    single = single.join(owners, ["w1", "w2"]).select("doc_id", "row", "first", F.col("first").alias("last"), "keep_doc_id")

    runs = hits.filter("NOT several").select("doc_id", "row", "first", "last", "keep_doc_id").unionByName(single)
    by_place = Window.partitionBy("doc_id", "row", "keep_doc_id").orderBy("first")
    starts = F.coalesce(F.col("first") > F.lag("last").over(by_place) + 1, F.lit(True)).cast("long")
    runs = runs.withColumn("starts", starts).withColumn("run", F.sum("starts").over(by_place))
    runs = runs.groupBy("doc_id", "row", "keep_doc_id", "run").agg(F.min("first").alias("first_word"), F.max("last").alias("last"))
    return runs.select("doc_id", "first_word", (F.col("last") - F.col("first_word") + least).alias("n_words"), "keep_doc_id", F.col("doc_id").eqNullSafe(F.col("keep_doc_id")).alias("kept"))
