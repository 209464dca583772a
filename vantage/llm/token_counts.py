"""Exact token counts of whole texts, huge ones by overlap resynchronisation.

A byte-level tokenizer scans a text from left to right into pre-tokens and codes each by itself; where the scan goes
on from a position depends on the text after that position alone. So if two encodings of overlapping chunks both
begin a pre-token at the same position, they agree from there on, up to the end of the shorter. A huge text is encoded
in overlapping chunks with offsets and spliced at such common starts. The first chunk begins at the text's start, and
each splice hands a proven start to the next chunk. Where no common start lies in an overlap, the overlap is doubled,
at last back to the proven start itself, from which no alignment is needed.

Texts of one chunk are cut before spaces that follow a non-space, where every scan begins a pre-token, and the
distinct units are encoded in batches and remembered.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

_AFTER_SPACE = re.compile(r"\s ")
_UNIT_START = re.compile(r"(?<=\S)(?= )")


def _starts(encoding, shift: int) -> tuple[list[int], list[int]]:
    """Where pre-tokens begin in the text, and how many tokens stand before each."""
    at, before, last = [], [], object()
    for i, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word is None or word != last:
            at.append(start + shift)
            before.append(i)
        last = word
    return at, before


class ResyncCounter:
    """Counts the tokens of huge texts. chunk and overlap are in characters."""

    def __init__(self, tokenizer, chunk: int = 32_768, overlap: int = 512, longest_special: int = 0):
        self.tokenizer, self.chunk, self.overlap, self.margin = tokenizer, max(1, chunk), max(1, overlap), longest_special
        self.widened = 0

    def _encode(self, text: str, start: int, end: int) -> tuple[list[int], list[int], int]:
        encoding = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        return *_starts(encoding, start), len(encoding)

    def count(self, text: str) -> int:
        n, total = len(text), 0
        end = min(n, self.chunk + self.overlap)
        at, before, size = self._encode(text, 0, end)
        proven, done = 0, 0  # the left encoding is proven from the start `proven`, before which it has `done` tokens
        while end < n:
            overlap = self.overlap
            while True:
                start = max(proven, end - overlap)
                new_end = min(n, end + max(self.chunk, overlap))
                if start <= proven:  # from a proven start there is nothing to align
                    right, splice = self._encode(text, proven, new_end), proven
                    break
                right = self._encode(text, start, new_end)
                # a start near the left chunk's end may lie in a special token that the end cuts
                last = bisect_right(at, end - max(1, self.margin))
                common = set(right[0]).intersection(p for p in at[:last] if p > max(start, proven))
                if common:
                    splice = max(common)
                    break
                overlap *= 2
                self.widened += 1
            if splice > proven:
                total += before[at.index(splice)] - done
            at, before, size = right
            end, proven = new_end, splice
            done = before[at.index(splice)] if splice in at else 0
        return total + size - done


class UnitCounter:
    """Counts the tokens of short texts unit by unit; remembers up to ``most_units`` units.

    All units but a text's first begin with a space and are known by what follows it.
    """

    def __init__(self, tokenizer, most_units: int = 400_000):
        self.tokenizer, self.most_units, self.known = tokenizer, most_units, {}

    def _sizes(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        units = [self._units(t) for t in texts]
        first = self._sizes([row[0] for row in units])
        rest = [row[1:] for row in units]
        if len(self.known) > self.most_units:
            self.known = {}
        known = self.known
        new = list(set().union(*rest) - known.keys())
        known.update(zip(new, self._sizes([" " + u for u in new]), strict=True))
        return [n + sum(map(known.__getitem__, row)) for n, row in zip(first, rest, strict=True)]

    @staticmethod
    def _units(text: str) -> list[str]:
        """The first unit, then the others without the space that they begin with."""
        if not _AFTER_SPACE.search(text):
            return text.split(" ")
        first, *rest = _UNIT_START.split(text)
        return [first, *(u[1:] for u in rest)]


def load_tokenizer(serialized: bytes):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(serialized.decode())


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
    chunk_chars: int = 32_768, overlap_chars: int = 512,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    ``tokenizer_path`` names a byte-level BPE in the tokenizers library's JSON form; the driver reads it once and
    broadcasts it (a file of fixed size). The work is a map: no shuffle, and a task holds a few MB of text at a time.

    Null and empty texts have 0 bytes and 0 tokens. Null ids and repeated rows are kept as they are. Empty table: no rows.
    """
    with open(tokenizer_path, "rb") as f:
        serialized = f.read()
    spec = json.loads(serialized)
    if (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("chunks can be spliced for byte-level tokenizers without normalizer or prefix space only")
    longest = max([len(t["content"]) for t in spec.get("added_tokens", [])], default=0)
    shared = docs.sparkSession.sparkContext.broadcast(serialized)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are what runs in parallel
        tokenizer = load_tokenizer(shared.value)
        units, huge = UnitCounter(tokenizer), ResyncCounter(tokenizer, chunk_chars, overlap_chars, longest)
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            counts = iter(units.counts([t for t in texts if t is not None and len(t) <= chunk_chars]))
            n = [0 if t is None else next(counts) if len(t) <= chunk_chars else huge.count(t) for t in texts]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
