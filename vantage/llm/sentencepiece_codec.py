"""SentencePiece models on the tokenizers library: parse the model file, rebuild it, encode and decode, verify parity.

The model is a protobuf message. The few fields that matter are read from its wire format: the pieces with scores and
kinds, the algorithm (unigram or BPE), byte fallback and the normaliser's rules. From these a tokenizers pipeline is
put together: normaliser (precompiled character map if there is one, metaspace marker), model (unigram scores, or BPE
merges in the order of the scores), byte fallback, and the decoder that undoes them. Texts go through it unit by unit
in batches that the library encodes on its own threads. Its ids are the result. Each new unit is also encoded by the
sentencepiece library as a check: ``parity`` says whether all of a text's units gave the same ids there.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MARK = "▁"
# Fixed values of the SentencePiece model format: field numbers, kinds of pieces and of models.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2

_UNITS = re.compile(r" *[^ ]+(?: +\Z)?| +\Z")  # trailing spaces stay with the last unit


def _varint(buf: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = buf[i]
        i += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, i
        shift += 7


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) fields of one protobuf message; fixed-width values stay bytes."""
    i = 0
    while i < len(buf):
        tag, i = _varint(buf, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(buf, i)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if kind == 2:
                size, i = _varint(buf, i)
            elif size is None:
                raise ValueError(f"wire type {kind} isn't used by model files")
            value, i = buf[i : i + size], i + size
        yield tag >> 3, value


def parse_model(buf: bytes) -> dict:
    """pieces [(piece, score, kind)], model_type, byte_fallback, unk_id, charsmap, add_dummy_prefix, remove_extra_whitespaces."""
    model = {
        "pieces": [], "model_type": UNIGRAM, "byte_fallback": False, "charsmap": b"",
        "add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True,
    }
    for number, value in _fields(buf):
        if number == PIECES:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            model["pieces"].append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == TRAINER:
            trainer = dict(_fields(value))
            model |= {"model_type": trainer.get(3, UNIGRAM), "byte_fallback": bool(trainer.get(35, 0))}
        elif number == NORMALIZER:
            rules = dict(_fields(value))
            model |= {
                "charsmap": rules.get(2, b""), "add_dummy_prefix": bool(rules.get(3, 1)),
                "remove_extra_whitespaces": bool(rules.get(4, 1)), "escape_whitespaces": bool(rules.get(5, 1)),
            }
    model["unk_id"] = next(i for i, p in enumerate(model["pieces"]) if p[2] == UNKNOWN)
    return model


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every way to put a piece together from two others, best score first, as BPE in SentencePiece joins them."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, i in ids.items():
        for k in range(1, len(piece)):
            if (left := ids.get(piece[:k])) is not None and (right := ids.get(piece[k:])) is not None:
                found.append((-pieces[i][1], left, right, piece[:k], piece[k:]))
    found.sort()
    return [(left, right) for *_, left, right in found]


def build_tokenizer(model: dict):
    """The same tokenizer as a tokenizers pipeline."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    pieces = model["pieces"]
    if not model["escape_whitespaces"]:
        raise ValueError("models that keep spaces as they are aren't supported")
    if model["model_type"] == UNIGRAM:
        backend = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=model["unk_id"], byte_fallback=model["byte_fallback"])
    elif model["model_type"] == BPE:
        backend = models.BPE(
            vocab={p: i for i, (p, _, _) in enumerate(pieces)}, merges=_merges(pieces), unk_token=pieces[model["unk_id"]][0],
            fuse_unk=True, byte_fallback=model["byte_fallback"],
        )
    else:
        raise ValueError("unigram and BPE models are supported")
    tokenizer = Tokenizer(backend)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["remove_extra_whitespaces"]:
        steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] * model["add_dummy_prefix"] + [normalizers.Replace(" ", MARK)]
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + [decoders.Strip(" ", 1, 0)] * model["add_dummy_prefix"]
    )
    return tokenizer


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int32)


RUN = 50  # units that are encoded and decoded as one text


def prepared(model_bytes: bytes) -> tuple[str, np.ndarray | None]:
    """What a codec is put together from: the tokenizer as text, and which ids begin a unit (none if texts can't be coded by unit)."""
    model = parse_model(model_bytes)
    # Units can be coded apart if the text is taken as it is and no piece has a space mark after another character.
    by_unit = (
        not model["charsmap"] and not model["remove_extra_whitespaces"] and model["add_dummy_prefix"]
        and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in model["pieces"] if kind == NORMAL)
        and not any(kind == USER_DEFINED for _, _, kind in model["pieces"])
    )
    return build_tokenizer(model).to_str(), np.array([p.startswith(MARK) for p, *_ in model["pieces"]]) if by_unit else None


class Codec:
    """Encodes texts; remembers up to ``most_units`` units between batches. ``ready``: of ``prepared``, worked out once for all tasks."""

    def __init__(self, model_bytes: bytes, most_units: int = 150_000, ready: tuple[str, np.ndarray | None] | None = None):
        import sentencepiece
        from tokenizers import Tokenizer

        described, self.begins = ready or prepared(model_bytes)
        self.tokenizer = Tokenizer.from_str(described)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        self.by_unit = self.begins is not None
        self.most_units = most_units
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        # of each known unit: where its ids begin in the pool, how many they are, whether both libraries agree and decoding gives it back
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.good, self.back = np.zeros(0, bool), np.zeros(0, bool)

    def _coded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of new units after each other, how many each has, and whether decoding gives each back: unit by unit."""
        ours = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        decoded = self.tokenizer.decode_batch(ours, skip_special_tokens=False)
        return _flat(ours), np.fromiter(map(len, ours), np.int64, len(units)), np.array([a == b for a, b in zip(decoded, units, strict=True)], bool)

    def _coded_in_runs(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of units without spaces and marks, by runs of them with a space between: of each unit the first id, and no other, begins with a mark."""
        runs = [" ".join(units[i : i + RUN]) for i in range(0, len(units), RUN)]
        ours = [e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        ids = _flat(ours)
        sizes = np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids)))
        if len(sizes) != len(units) or not self.begins[ids[:1]].all():
            return self._coded(units)
        decoded = self.tokenizer.decode_batch(ours, skip_special_tokens=False)
        back = np.ones(len(units), bool)
        for i in (i for i, (a, b) in enumerate(zip(decoded, runs, strict=True)) if a != b):
            back[i * RUN : (i + 1) * RUN] = self._coded(units[i * RUN : (i + 1) * RUN])[2]
        return ids, sizes, back

    def _learn(self, units: list[str]) -> None:
        """Encode new units, decode them, and encode them by the other library for the check."""
        plain = [u for u in units if u and " " not in u and MARK not in u] if self.by_unit else []
        other = [u for u in units if not u or " " in u or MARK in u] if self.by_unit else units
        ids, sizes, back = (np.concatenate(x) for x in zip(self._coded_in_runs(plain), self._coded(other), strict=True))
        units = plain + other
        theirs = self.reference.encode(units, num_threads=1)
        good, ends = sizes == np.fromiter(map(len, theirs), np.int64, len(units)), np.cumsum(sizes)
        if good.all():
            good[np.searchsorted(ends, np.flatnonzero(ids != _flat(theirs)), "right")] = False
        else:
            good = np.array([ids[end - n : end].tolist() == b for end, n, b in zip(ends.tolist(), sizes.tolist(), theirs, strict=True)], bool)
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pool) + ends - sizes])
        self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, ids])
        self.good, self.back = np.concatenate([self.good, good]), np.concatenate([self.back, back])

    def _units(self, text: str) -> list[str]:
        """Parts that each get a mark in front: what follows a space (or the text's start) up to the next space after a non-space."""
        if not text:
            return []
        if not self.by_unit:
            return [text]
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [u[1:] for u in _UNITS.findall(" " + text)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts after each other, how many each text has, whether both libraries agree on it, and whether decoding gives it back."""
        if len(self.known) > self.most_units:
            self._forget()
        rows = [self._units(t) for t in texts]
        new = set().union(*rows) - self.known.keys()
        if new:
            self._learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(rows)), np.int64)
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        sizes = self.sizes[at]
        ids = self.pool[np.repeat(self.starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        count = lambda x: np.bincount(doc, x, len(rows)).astype(np.int64)
        return ids, count(sizes), count(~self.good[at]) == 0, count(~self.back[at]) == 0


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", threads: int = 2) -> DataFrame:
    """doc_id, n_tokens, token_ids, parity, round_trip of every whole text.

    ``parity``: the rebuilt pipeline and the sentencepiece library gave the same ids. ``round_trip``: decoding the ids
    gives the text back. The driver reads the model file once and broadcasts it (a file of fixed size). The work is a
    map: no shuffle; a task holds a few MB of text at a time. ``threads`` is what the library may use in a task.

    Null and empty texts have no tokens, parity and round trip hold for them. Null ids and repeated rows are kept as
    they are. Empty table: no rows. Other columns are ignored.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((model, prepared(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        model, ready = shared.value
        codec = Codec(model, ready=ready)
        for batch in slices(batches, "text", 2 << 20):
            ids, sizes, same, back = codec.encode([t or "" for t in batch.column("text").to_pylist()])
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(same), pa.array(back)],
                ["doc_id", "n_tokens", "token_ids", "parity", "round_trip"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens int, token_ids array<int>, parity boolean, round_trip boolean")


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id, text: the inverse of ``encode_documents``.

    Null or empty token ids give an empty text. Null document ids and repeated rows are kept as they are. Empty table: no
    rows. Other columns are ignored.
    """
    with open(model_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = build_tokenizer(parse_model(shared.value))
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts = tokenizer.decode_batch([x or [] for x in part.column("ids").to_pylist()], skip_special_tokens=False)
                yield pa.record_batch([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
