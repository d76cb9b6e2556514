"""Language identification by hierarchical discrimination: the language family first, then one-versus-one linear support
vector machines between the languages of the family.

Features are hashed byte n-grams (1 to 4) of the whole lower-cased text, square-rooted and scaled to length 1. Both levels
vote with one-versus-one machines: between the families, then between the languages of the winner. Machines minimise the
squared hinge loss with an L2 penalty by accelerated gradient steps on a bounded, documented sample: PER_LANGUAGE documents of
each language, drawn by a hash of the id after thinning to about twice that, so that the bound holds at any size. Each
sampled text also gives a short excerpt, as short texts are the hard ones. FAMILY groups language codes; a code that is not
in it is a family of its own. One task learns: it gets the sample in order, a batch at a time, and keeps what features are
not zero; the driver gets weights only.

Defined cases: a text that is null or has no letter is `und` with score 0; rows with null lang or null id are not learnt
from; with one language, or none, every other text gets it, or `und`; repeated rows each get their row; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parameter_table

PER_LANGUAGE, BITS = 400, 13

#: Language codes by family.
FAMILY = {
    "germanic": "en de nl af da sv no nb nn is fo fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az uz kk ky tk tt",
    "indic": "hi bn pa gu mr ne si ur sd",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
    "austronesian": "id ms jv su tl",
}
_FAMILY_OF = {code: family for family, codes in FAMILY.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def family(language: str) -> str:
    return _FAMILY_OF.get(re.split("[-_]", language.lower())[0], language)


def features(text: str) -> np.ndarray:
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    counts = np.zeros(1 << BITS)
    code = np.zeros(len(raw), np.uint32)
    for n in range(1, 5):
        code = (code[: len(raw) - n + 1] << np.uint32(8)) | raw[n - 1 :]
        counts += np.bincount((code + np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS), minlength=1 << BITS)
    x = np.sqrt(counts)
    return x / max(np.sqrt((x * x).sum()), 1e-12)


class _Rows(NamedTuple):
    """Rows of features without their zeros: how many each row has, one at least, their places and their values."""

    n: np.ndarray
    place: np.ndarray
    value: np.ndarray

    def take(self, rows: np.ndarray) -> _Rows:
        inside = np.repeat(rows, self.n)
        return _Rows(self.n[rows], self.place[inside], self.value[inside])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.value * w[self.place], np.cumsum(self.n) - self.n)

    def summed(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, self.value * np.repeat(weights, self.n), 1 << BITS)


def _machine(x: _Rows, y: np.ndarray, penalty: float = 0.01, steps: int = 120) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss; y is 1 or -1, both sides weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = look = np.zeros(1 << BITS)
    rate, momentum = 1 / (2 + penalty), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * x.times(look))
        new = look - rate * (penalty * look - 2 * x.summed(weight * slack * y))
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
    return w


class _Votes:
    """One-versus-one machines between classes."""

    def __init__(self, x: _Rows, labels: np.ndarray):
        self.classes = sorted(set(labels))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        rows = [np.isin(labels, (self.classes[a], self.classes[b])) for a, b in self.pairs]
        self.weights = np.array([_machine(x.take(r), np.where(labels[r] == self.classes[a], 1.0, -1.0)) for (a, b), r in zip(self.pairs, rows, strict=True)], np.float32)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if not self.pairs:
            return self.classes[0], 1.0
        votes, sure = np.zeros(len(self.classes)), np.ones(len(self.classes))
        for (a, b), margin in zip(self.pairs, self.weights @ x, strict=True):
            p = 1 / (1 + np.exp(-4 * float(margin)))
            votes += np.bincount([a, b], [p > 0.5, p <= 0.5], len(votes))
            sure[a], sure[b] = min(sure[a], p), min(sure[b], 1 - p)
        best = max(range(len(votes)), key=lambda k: (votes[k], sure[k]))
        return self.classes[best], float(sure[best])


class LanguageModel:
    def __init__(self, sample: Iterable[tuple[str | None, str]] = ()):
        """sample: (text, language), passed through once."""
        places, values, ys = [], [], []
        for i, (text, language) in enumerate(sample):
            if text and _LETTER.search(text):
                words = text.split()
                at, n = (i * 7919) % len(words), 2 + i % 9
                part = " ".join(words[at : at + n])
                for own in (text, part) if _LETTER.search(part) else (text,):
                    x = features(own)
                    places.append(np.flatnonzero(x).astype(np.int32))
                    values.append(x[places[-1]])
                    ys.append(language)
        y, groups = np.array(ys, dtype=object), np.array([family(v) for v in ys], dtype=object)
        x = _Rows(np.array([len(p) for p in places], np.int64), np.concatenate(places), np.concatenate(values)) if ys else None
        self.families = _Votes(x, groups) if ys else None
        self.languages = {g: _Votes(x.take(groups == g), y[groups == g]) for g in set(groups)}

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or self.families is None or not _LETTER.search(text):
            return "und", 0.0
        x = features(text)
        group, p = self.families.predict(x)
        language, q = self.languages[group].predict(x)
        return language, p * q


def held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def _sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame | None:
    """(lang, k, text): at most per_language texts of each language, numbered; None if there are no languages."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    u = F.pmod(F.xxhash64(F.lit("language"), F.col("id")), F.lit(1 << 32))
    share = parameter_table(docs.sparkSession, [(k, int(min(1.0, 2 * per_language / n) * (1 << 32))) for k, n in counts.items()], "lang string, below long")
    drawn = usable.withColumn("u", u).join(share, "lang").filter("u < below")
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("u", "id", "text"))).filter(F.col("k") <= per_language)
    return drawn.select("lang", "k", "text")


def fit(docs: DataFrame, **options) -> LanguageModel:
    """Fitted by one task: the sample and what training takes stay out of the driver."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel((text, lang) for part in parts for text, lang in zip(part.column(1).to_pylist(), part.column(0).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    sample = _sample(docs, **options)
    if sample is None:
        return LanguageModel()
    found = sample.repartition(1).sortWithinPartitions("lang", "k").select("lang", "text").mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else LanguageModel()


def language_id(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs; the model's size is fixed by BITS and the languages."""
    small = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [shared.value.predict(t) for t in part["text"]]
            yield part[["doc_id", "held_out"]].assign(lang_pred=[f[0] for f in found], score=[f[1] for f in found])

    kind = small.schema["doc_id"].dataType.simpleString()
    return small.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
