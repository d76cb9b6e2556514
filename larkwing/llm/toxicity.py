"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text, compared window by window.

Training, on a bounded sample of labelled rows, splits it in halves. zstandard trains a dictionary on the toxic texts of the
first half (windows of 32 bytes, one every 16) and one on ordinary texts. Most of the toxic dictionary is language, not
toxicity, and its chance differences from the ordinary one hide the saving of a short insult (README has figures), so it is
reduced by compressed lengths alone: of its parts between blanks those are candidates that cost at least GAP bytes and a third
of their letters more given ordinary text than given the toxic texts of the second half, and at most KNOWN bytes given those.
On the second half a candidate and a threshold on its saving find some windows; those are taken, best first, whose newly found
windows are in more toxic texts than false positives outweigh. The toxic compressor has the ordinary dictionary and toxic parts, its counterpart the ordinary one
and filler of the same length; the difference of two compressed lengths is what a window saves by toxic text.

A text is lower-cased and anything but letters becomes a blank; its windows are its words, each between blanks, a lead-in that
the dictionaries hold, so that zstandard does not store it raw, and a tail, as its match finder does not look at the last
bytes. Words recur, so their results are kept in a bounded table. Every toxic part makes a pair of compressors, as together
they save more than each was calibrated for; the score is a logistic of the largest excess of a saving over its threshold.

Defined cases: a null or empty text, and a text without letters, scores 0; without labelled toxic rows, or where nothing tells
them from ordinary ones, every score is 0; rows that repeat a doc_id are scored each; labels that are null or belong to no
document are left out, an id with both labels counts as toxic, and each distinct text of an id is a text; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import gc
import math
import pickle
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back

STRATEGY = zstandard.STRATEGY_GREEDY
#: Bytes of the trained dictionaries; bytes more that a toxic part costs given ordinary text than given toxic text.
ORDINARY_BYTES, TOXIC_BYTES, GAP, KNOWN = 3600, 60_000, 2, 4
#: Bounds of the training sample: toxic and ordinary documents, each read whole; of their windows of 32 bytes (toxic) and 128
#: bytes (ordinary) every k-th trains a dictionary, so that WINDOWS to twice as many are used.
TOXIC, ORDINARY, WINDOWS = 1500, 5000, 100_000
#: When thresholds are set, a false positive costs so many times what a toxic document that is found is worth; and the least one.
COST, LEAST = 20, 3
#: A part is taken for windows of at least this share of the second half's toxic texts, and of two; fewer are chance passages.
SHARE = 0.01
#: Words whose results a worker keeps; more than any threshold.
WORDS, LONGEST = 300_000, 100
_BLANKS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_BLANKS).split())


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    log = max(14, len(content).bit_length() + 1)
    parameters = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=log, hash_log=min(20, log - 1), chain_log=min(20, log - 1), search_log=10, min_match=4, strategy=STRATEGY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(compression_params=parameters, dict_data=dictionary)


def _filler(n: int) -> bytes:
    return np.random.default_rng(n).integers(0xE0, 0xF8, n).astype(np.uint8).tobytes()


_TAIL = np.random.default_rng(999).integers(0xE0, 0xF8, 12).astype(np.uint8).tobytes()
_LEAD = np.random.default_rng(0).integers(33, 64, 48).astype(np.uint8).tobytes()


def _trained(texts: list[bytes], width: int, step: int, size: int) -> bytes:
    """What zstandard's training picks from windows of the texts, without its header."""
    windows = [t[i : i + width] for t in texts for i in range(0, max(1, len(t) - step), step)]
    windows = windows[:: max(1, len(windows) // WINDOWS)]
    try:
        return zstandard.train_dictionary(size + 512, windows, k=24, d=6, f=20, accel=1).as_bytes()[-size:]
    except zstandard.ZstdError:  # too little text to train on: it is its own dictionary
        return b" ".join(windows)[-size:]


def _cost(content: bytes) -> Callable[[bytes], int]:
    """Bytes that a word between blanks takes where the content is known."""
    press = _compressor(content + _LEAD).compress
    least = len(press(_LEAD + _TAIL))
    return lambda word: len(press(_LEAD + b" " + word + b" " + _TAIL)) - least


def _length(dictionary: bytes) -> Callable[[bytes], int]:
    """The compressed length of a word between blanks."""
    press = _compressor(_LEAD + dictionary + _LEAD).compress
    return lambda word: len(press(_LEAD + b" " + word + b" " + _TAIL))


def _grams(word: bytes) -> set[bytes]:
    word = b" " + word + b" "
    return {word[i : i + 4] for i in range(len(word) - 3)}


def _pair(ordinary: bytes, toxic: bytes) -> Callable[[bytes], int]:
    """The bytes that the toxic dictionary saves in a word, against filler of its length."""
    plain, own = _length(ordinary + _filler(len(toxic))), _length(ordinary + toxic)
    return lambda word: plain(word) - own(word)


class CompressionClassifier:
    """Fitted state is small and pickles: the ordinary dictionary and the parts of the toxic one by their threshold."""

    def __init__(self, ordinary: bytes = b"", toxic: dict[int, list[bytes]] | None = None):
        self.ordinary, self.toxic = ordinary, toxic or {}
        self._made, self._words = None, {}

    def __getstate__(self):
        return (self.ordinary, self.toxic)

    def __setstate__(self, state):
        self.__init__(*state)

    def _excess(self, word: bytes) -> int:
        if self._made is None:
            parts = [(t, p) for t in sorted(self.toxic) for p in self.toxic[t]]
            sharing: dict[bytes, list[int]] = {}  # a match has four bytes at least, so other parts save nothing
            for i, (_, part) in enumerate(parts):
                for gram in _grams(part):
                    sharing.setdefault(gram, []).append(i)
            self._made = [(t, _pair(self.ordinary, b" " + p + b" ")) for t, p in parts], sharing
        pairs, sharing = self._made
        return max((pairs[i][1](word) - pairs[i][0] for i in {i for g in _grams(word) for i in sharing.get(g, ())}), default=-LONGEST)

    def excess(self, text: bytes) -> int:
        """The most by which what a toxic dictionary saves in a window of a normalised text exceeds its threshold."""
        table, best = self._words, -LONGEST
        for word in set(text.split()):
            own = table.get(word)
            if own is None:
                if len(table) >= WORDS:
                    table.clear()
                own = table[word] = self._excess(word)
            if own > best:
                best = own
        return best

    def forget(self) -> None:
        """Drops what was made for scoring."""
        self._made, self._words = None, {}

    def score(self, text: str | None) -> float:
        words = normal(text) if self.toxic else b""
        return 1 / (1 + math.exp(-(2.0 * min(self.excess(words), 20) + 1))) if words else 0.0

    @classmethod
    def fit(cls, toxic: list[str], ordinary: list[str]) -> CompressionClassifier:
        toxic, ordinary = ([b" " + t + b" " for t in map(normal, dict.fromkeys(texts)) if t] for texts in (toxic, ordinary))
        if len(toxic) < 2 or len(ordinary) < 2:
            return cls()
        common = _trained(ordinary[::2], 128, 128, ORDINARY_BYTES)
        parts = sorted({p for p in _trained(toxic[::2], 32, 16, TOXIC_BYTES).split() if len(p) >= 4})
        by_ordinary, by_toxic = _cost(b"".join(ordinary[::2])), _cost(b"".join(toxic[1::2]))
        parts = [p for p in parts if by_ordinary(p) - (own := by_toxic(p)) >= max(GAP, len(p) / 3) and own <= KNOWN]
        if not parts:
            return cls()
        # words of the second half, and what finding them is worth
        texts = toxic[1::2], ordinary[1::2]
        held = Counter(w for t in texts[0] for w in set(t.split()))
        worth = dict.fromkeys(held, 0.0) | held
        for text in texts[1]:
            for word in set(text.split()):
                worth[word] = worth.get(word, 0.0) - COST * len(texts[0]) / len(texts[1])
        words = sorted(worth)
        value, place = np.array([worth[w] for w in words]), {w: i for i, w in enumerate(words)}
        sharing: dict[bytes, set[bytes]] = {}  # a match has four bytes at least, so a part saves nothing in other words
        for word in words:
            for gram in _grams(word):
                sharing.setdefault(gram, set()).add(word)
        choices, rows, plain = [], [], {}
        for part in parts:
            own, hits = _length(common + b" " + part + b" "), {}
            if len(part) not in plain:
                plain[len(part)] = functools.cache(_length(common + _filler(len(part) + 2)))
            for word in sorted(set().union(*(sharing.get(g, ()) for g in _grams(part)))):
                for t in range(LEAST, plain[len(part)](word) - own(word) + 1):
                    hits.setdefault(t, []).append(place[word])
            choices += [(t, part) for t in sorted(hits)]
            rows += [np.array(hits[t]) for t in sorted(hits)]
        # the part and threshold whose newly found words are worth most, again and again
        found: dict[int, list[bytes]] = {}
        while choices:
            gain = [value[row].sum() for row in rows]
            best = max(range(len(gain)), key=lambda i: (round(gain[i], 9), choices[i]))
            if gain[best] < max(2, SHARE * len(texts[0])):
                break
            t, part = choices[best]
            found.setdefault(t, []).append(part)
            value[rows[best]] = 0
            left = [i for i, (_, p) in enumerate(choices) if p != part and gain[i] > 0]
            choices, rows = [choices[i] for i in left], [rows[i] for i in left]
        return cls(common, found)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = TOXIC, ordinary: int = ORDINARY) -> DataFrame:
    """(id, text, y): at most that many toxic and ordinary texts of labelled rows that are not held out, drawn by a hash of the
    id: the labels are thinned to about twice the bound before anything is sorted, so the bound holds at any size."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    u = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("id")), F.lit(1 << 32))
    picked = None
    for y, bound in ((1, toxic), (0, ordinary)):
        part = usable.filter((F.col("y") == y) & (u < int(min(1.0, 2 * bound / max(1, counts.get(y, 0))) * (1 << 32)))).orderBy(u, "id").limit(bound)
        picked = part if picked is None else picked.unionByName(part)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id").distinct()


def _by_class(rows: Iterable[tuple]) -> tuple[list[str], list[str]]:
    rows = sorted((key, text or "", y) for key, text, y in rows)
    return [t for _, t, y in rows if y == 1], [t for _, t, y in rows if y == 0]


def training_sample(docs: DataFrame, labels: DataFrame, **options) -> tuple[list[str], list[str]]:
    """The toxic and the ordinary texts that are learnt from."""
    return _by_class(_sample(docs, labels, **options).collect())


def fit(docs: DataFrame, labels: DataFrame, **options) -> CompressionClassifier:
    """Fitted by one task: the sample and what training takes stay out of the driver, which gets a few thousand bytes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CompressionClassifier.fit(*_by_class(row for part in parts for row in zip(*(c.to_pylist() for c in part.columns), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
        gc.collect()
        give_back()

    found = _sample(docs, labels, **options).repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else CompressionClassifier()


def toxicity(docs: DataFrame, model: CompressionClassifier, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; the model is a few thousand bytes and goes with the function."""
    small = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            score = np.array([model.score(t) for t in part["text"]], float)
            yield part[["doc_id", "held_out"]].assign(score=score, predicted=(score >= threshold).astype(np.int32))
        model.forget()
        give_back()

    kind = small.schema["doc_id"].dataType.simpleString()
    return small.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: CompressionClassifier, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text scores at least the threshold; all columns stay."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(model.score).astype(float)
        model.forget()
        give_back()

    return docs.filter(score(F.col(text_col)) < threshold)
