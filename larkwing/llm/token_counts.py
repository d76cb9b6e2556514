"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes, not rows. Long texts are cut at safe boundaries, at which the count is additive: the byte-level
pre-tokeniser ends every token before white space that follows something else, and before a full-width stop or comma that follows a
Chinese or Japanese letter; added tokens hold neither. Only ASCII white space is cut before, and only behind characters that
no Unicode version counts as white space, so tabs, no-break spaces and separators in a text do no harm. What lies between
two cuts ("word with the blanks before it") mostly recurs: a table of counts per worker, bounded in entries and characters,
spares its encoding, and new pieces are encoded in batches. Tokenizers for which the rule is not known encode texts whole.

Defined cases: null counts as empty (0 tokens); repeated rows each get their row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a batch, entries and characters of a worker's table of piece counts, pieces encoded at once.
BATCH_BYTES, TABLE, TABLE_CHARS, AT_ONCE = 1 << 20, 500_000, 1 << 25, 8192
_PIECE = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
#: Letters and marks of Chinese and Japanese between which a cut is safe.
_LETTERS, _MARKS = r"\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5", "。，、！？；："
_HARD = re.compile(rf"[^\S\t-\r ]|[\u180e{_MARKS}]")
_CUT = re.compile(rf"(?<=[^\s\u180e])(?=[\t-\r ])|(?<=[{_LETTERS}])(?=[{_MARKS}])")
_LOADED: dict[str, _Counter] = {}


class _Counter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.chars = Tokenizer.from_file(path), {}, 0
        config = json.loads(self.tokenizer.to_str())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        before = config.get("pre_tokenizer") or {}
        self.additive = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not config.get("normalizer")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(rf"\s|[{_MARKS}]", t["content"]) for t in config.get("added_tokens", []))
        )
        self.closing = {c: n for c in ".," if (n := self.encode([c])[0]) == 1} if self.additive else {}

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: set[str]) -> None:
        """A full stop or comma after an ASCII letter is a token of its own, so the word's count serves."""
        known, self.chars = self.known, self.chars + sum(map(len, new))
        closing = {p: p[:-1] for p in new if len(p) > 2 and p[-1] in self.closing and p[-2].isascii() and p[-2].isalpha()}
        rest = [p for p in {closing.get(p, p) for p in new} if p not in known]
        for i in range(0, len(rest), AT_ONCE):
            known.update(zip(rest[i : i + AT_ONCE], self.encode(rest[i : i + AT_ONCE]), strict=True))
        known.update((p, known[q] + 1) for p, q in closing.items())

    def count(self, texts: list[str]) -> list[int]:
        if not self.additive:
            return self.encode(texts)
        out, known = [], self.known
        for text in texts:
            pieces = _CUT.split(text) if _HARD.search(text) else _PIECE.findall(text)
            try:
                out.append(sum(map(known.__getitem__, pieces)))
            except KeyError:
                own = set(pieces)
                new = {p for p in own if p not in known}
                if len(known) + len(new) > TABLE or self.chars + sum(map(len, new)) > TABLE_CHARS:
                    known.clear()
                    self.chars, new = 0, own
                self.learn(new)
                out.append(sum(map(known.__getitem__, pieces)))
        return out


def _counter(path: str) -> _Counter:
    if path not in _LOADED:
        _LOADED[path] = _Counter(path)
    return _LOADED[path]


def batches(sizes: list[int], limit: int = BATCH_BYTES) -> Iterator[slice]:
    """Row ranges with at most limit bytes each, or one row."""
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and total + n > limit:
            yield slice(a, i)
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield slice(a, len(sizes))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row; tokenizer: the place of a .json file that every worker has.
    No begin, end or other added tokens; special strings inside texts are handled as the library's default does."""
    small = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = small.schema["doc_id"].dataType.simpleString()

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = _counter(tokenizer)
        for part in parts:
            ids, texts = part.column(0), part.column(1)
            sizes = pa.compute.binary_length(texts).to_pylist()
            for cut in batches(sizes):
                n = cut.stop - cut.start
                tokens = counter.count(texts.slice(cut.start, n).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(cut.start, n), pa.array(sizes[cut], pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return small.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
