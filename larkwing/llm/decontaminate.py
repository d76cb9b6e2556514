"""Benchmark decontamination with suffix arrays over the training text.

Each batch of documents is a shard. Words that occur in no benchmark item can be in no match, so they end a run; the shard's
suffix array orders, by prefix doubling, the suffixes of the runs of benchmark words that are at least as long as the
shortest window. Every suffix of every benchmark item that a window starts is binary-searched in it, equal ones once: the
range of suffixes that begin with the window's words gives all its places, and places that follow each other in a document
and in an item make up the longest verbatim matches. Nothing
is sampled or cut, a shard needs memory in proportion to its batch, and shards meet in no shuffle.

Benchmark items pass the driver one block of BLOCK_BYTES at a time and are broadcast as codes and offsets, never as suffixes;
a worker loads one block at a time. Their total size bounds time and the cluster's disk for broadcasts, not memory.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. A window is `window` consecutive words of an item; an item
with fewer words is one window. Defined cases: null or empty texts and items have no words (a document without words is clean;
an item without words matches nothing); item ids that are null are left out of the item list but their windows count as hits;
repeated item ids count once, repeated documents each get their row; empty tables give clean or no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, row_key, without_keys
from .textops import pieces, separators, string_bytes, word_hashes

BLOCK_BYTES, SHARD_BYTES = 16 << 20, 4 << 20
_SEPARATORS = separators("alnum")


class Block:
    """Some benchmark items as word codes 1, 2, ..., one after the other; a suffix is a place in them."""

    def __init__(self, ids: list, texts: list[str | None], window: int):
        raw, offsets = string_bytes(pa.array([t or "" for t in texts], pa.large_string()))
        words, counts = word_hashes(raw, offsets, _SEPARATORS)
        self.vocabulary, codes = np.unique(words, return_inverse=True)
        self.codes = codes.astype(np.int32) + 1
        ends = np.cumsum(counts)
        self.ids = [None if i is None else str(i) for i in ids]
        self.item = np.repeat(np.arange(len(ids)), counts)  # of each suffix
        left = np.repeat(ends, counts) - np.arange(len(codes))  # words from the suffix to the item's end
        size = np.repeat(np.minimum(counts, window), counts)
        self.width = np.where(left >= size, size, 0)  # of the window that starts here, 0 if none does
        self.shortest = int(self.width[self.width > 0].min()) if (self.width > 0).any() else 0
        # equal windows are searched once: windows has a suffix of each, same all suffixes that start with it
        first: dict = {}
        starts = np.flatnonzero(self.width)
        of = np.array([first.setdefault(self.codes[i : i + self.width[i]].tobytes(), len(first)) for i in starts.tolist()], np.int64)
        order = np.argsort(of, kind="stable")
        self.same, self.cuts = starts[order], np.searchsorted(of[order], np.arange(len(first) + 1))
        self.windows = self.same[self.cuts[:-1]]


class SuffixArray:
    """The suffixes of runs of codes > 0 of at least `least` words, in order. text ends with zeros."""

    def __init__(self, codes: np.ndarray, least: int):
        self.codes = codes
        n = len(codes)
        stop = np.where(codes == 0, np.arange(n), n)
        run = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)
        self.starts = np.flatnonzero(run >= max(1, least))
        covered = np.flatnonzero(codes > 0)
        rank = np.zeros(n + 1, np.int64)
        rank[covered] = np.unique(codes[covered], return_inverse=True)[1] + 1  # at most n, as the products below need
        k, longest = 1, int(run.max(initial=0))
        while k < longest:  # order by 2k words from the order by k words
            after = rank[np.minimum(covered + k, n)]
            _, rank_new = np.unique(rank[covered] * (n + 2) + after, return_inverse=True)
            rank[covered] = rank_new + 1
            if rank_new.max(initial=0) + 1 == len(covered):
                break
            k *= 2
        self.order = self.starts[np.argsort(rank[self.starts], kind="stable")]

    def _compare(self, at: np.ndarray, block: Block, start: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of own suffixes and the block's, up to width words: length in common, and whether the own one is less."""
        common, less, open_ = np.zeros(len(at), np.int64), np.zeros(len(at), bool), np.flatnonzero(width > 0)
        k = 0
        while len(open_):
            own, other = self.codes[np.minimum(at[open_] + k, len(self.codes) - 1)], block.codes[start[open_] + k]
            less[open_[own < other]] = True
            open_ = open_[own == other]
            k += 1
            common[open_] = k
            open_ = open_[width[open_] > k]
        return common, less

    def search(self, block: Block, start: np.ndarray, width: np.ndarray, upper: bool) -> np.ndarray:
        """The first place in the order at which the suffix, cut to width words, is not less (upper: is more) than the block's."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.order), np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            common, less = self._compare(self.order[middle], block, start[open_], width[open_])
            right = less | (common == width[open_]) if upper else less
            low[open_], high[open_] = np.where(right, middle + 1, low[open_]), np.where(right, high[open_], middle)
        return low

    def places(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of all windows: place, number of the window."""
        if not len(self.order) or not len(block.windows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        width = block.width[block.windows]
        low, high = (self.search(block, block.windows, width, upper) for upper in (False, True))
        n = high - low
        return self.order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(np.arange(len(n)), n)


def longest_matches(places: np.ndarray, windows: np.ndarray, document: np.ndarray, block: Block) -> dict[int, tuple[int, int, str]]:
    """Of each document that holds a window: words, place and item of its longest verbatim match with an item, which is a run of
    windows that follow each other in both; of equal ones the first place and least item id."""
    n = (block.cuts[1:] - block.cuts[:-1])[windows]
    place = np.repeat(places, n)
    suffix = block.same[np.repeat(block.cuts[windows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    order = np.lexsort((place, place - suffix))
    place, suffix = place[order], suffix[order]
    follows = (np.diff(place) == 1) & (np.diff(suffix) == 1) & (np.diff(block.item[suffix]) == 0) if len(place) else np.zeros(0, bool)
    first = np.flatnonzero(np.concatenate([[True], ~follows])) if len(place) else place
    runs = np.diff(np.append(first, len(place)))
    words = block.width[suffix[first]] + runs - 1
    found: dict[int, tuple[int, int, str]] = {}
    for d, w, at, item in zip(document[place[first]].tolist(), words.tolist(), place[first].tolist(), (block.ids[i] for i in block.item[suffix[first]].tolist()), strict=True):
        if d not in found or (-w, at, item or "") < (-found[d][0], found[d][1], found[d][2] or ""):
            found[d] = (w, at, item)
    return found


def _codes(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(words), np.int32)
    i = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return np.where(vocabulary[i] == words, i + 1, 0).astype(np.int32)


def _shard(words: np.ndarray, counts: np.ndarray, block: Block) -> tuple[SuffixArray, np.ndarray]:
    """The suffix array of a shard, its documents set apart by one 0, and the document of each place (-1: none)."""
    document = np.repeat(np.arange(len(counts)), counts + 1)
    codes = np.zeros(len(document) + 1, np.int32)
    inside = np.ones(len(document), bool)
    inside[np.cumsum(counts + 1) - 1] = False
    codes[:-1][inside] = _codes(words, block.vocabulary)
    return SuffixArray(codes, block.shortest), document


def _items(ids: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> Iterator[Block]:
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        ids.append(r["id"])
        texts.append(r["text"])
        size += len(r["text"] or "")
        if size > BLOCK_BYTES // 4:
            yield Block(ids, texts, window)
            ids, texts, size = [], [], 0
    if ids:
        yield Block(ids, texts, window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_words, longest_item, longest_at) for each row of
    docs. The last three: the document's longest verbatim match with an item, of those of at least a window, and the word at
    which it starts; null if there is none."""
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(b) for b in _blocks(benchmark, window, item_col, item_text_col)]
    small = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw, offsets = string_bytes(part.column(1))
            for a, b in pieces(offsets, SHARD_BYTES):
                words, counts = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], _SEPARATORS)
                first = np.cumsum(counts + 1) - counts - 1
                hit = np.zeros(len(words) + len(counts) + 2, np.int64)
                items: dict[int, set[str]] = {}
                best: dict[int, tuple[int, int, str]] = {}
                for shared in blocks:
                    block = shared.value
                    array, document = _shard(words, counts, block)
                    places, window_of = array.places(block)
                    if len(places):
                        width = block.width[block.windows][window_of]
                        np.add.at(hit, places, 1)
                        np.add.at(hit, places + width, -1)
                        pairs = np.unique(document[places] * len(block.windows) + window_of)
                        for d, w in zip((pairs // len(block.windows)).tolist(), (pairs % len(block.windows)).tolist(), strict=True):
                            named = (block.ids[i] for i in block.item[block.same[block.cuts[w] : block.cuts[w + 1]]].tolist())
                            items.setdefault(d, set()).update(i for i in named if i is not None)
                        for d, (n, at, item) in longest_matches(places, window_of, document, block).items():
                            if d not in best or (-n, at, item or "") < (-best[d][0], best[d][1], best[d][2] or ""):
                                best[d] = (n, at, item)
                    if len(blocks) > 1:  # the next one is loaded from the worker's disk
                        vars(shared).pop("_value", None)
                covered = np.concatenate([[0], np.cumsum(np.cumsum(hit)[: len(words) + len(counts)] > 0)])
                n_hit = covered[first + counts] - covered[first]
                names, match = [items.get(d, set()) for d in range(b - a)], [best.get(d) for d in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in names], pa.int64()),
                        pa.array([_items(x) for x in names], pa.string()), pa.array(n_hit > 0), pa.array([m and m[0] for m in match], pa.int64()), pa.array([m and m[2] for m in match], pa.string()),
                        pa.array([m and int(m[1] - first[d]) for d, m in enumerate(match)], pa.int64()),
                    ],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_words", "longest_item", "longest_at"],
                )

    kind = small.schema["doc_id"].dataType.simpleString()
    return small.mapInArrow(giving_back(run), f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_words long, longest_item string, longest_at long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """docs without the rows that hold a benchmark window; all columns stay."""
    key = row_key(id_col, F.col(text_col))
    found = contamination(docs.select(key.alias("key"), F.col(text_col).alias("text")), benchmark, window, "key", "text", **columns)
    return without_keys(docs, key, found.filter("contaminated").select("doc_id.*"))
