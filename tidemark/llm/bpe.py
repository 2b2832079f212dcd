"""Byte-level BPE by forced boundaries.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can
never be joined by a merge: between such bytes every encoding has a boundary.
``ForcedBoundaryCodec`` reads those pairs off the vocabulary, cuts texts there,
encodes the fragments on their own (repeated ones from a bounded cache), and
concatenates. Cuts before a space that a non-space follows are forced too and
also agree with the pre-tokenizer, whose pieces hold a space only in front;
they come first, because they need no look at the bytes.

Edge cases: null and empty texts give no ids and decode to the empty string;
texts of any length are encoded whole; a special token's string in a text is
that token, as the tokenizers library has it; rows repeat as often as given;
other columns, whatever their names, are not looked at; an empty table gives no
rows.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, pre_tokenizers

from tidemark.llm.common import Cache, bounded_batches, claim

#: Fixed value: how the byte-level pre-tokenizer splits a text.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_CODECS: dict[int, ForcedBoundaryCodec] = {}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [""] * 256
    spare = 0x100
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class ForcedBoundaryCodec:
    def __init__(self, vocabulary: str):
        """vocabulary: the text of a tokenizers JSON file with a byte-level BPE model."""
        spec = json.loads(vocabulary)
        ids = spec["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for s, i in ids.items():
            self.token[i] = bytes(byte_of[c] for c in s)
        for s, i in self.special.items():
            self.token[i] = s.encode()
        self._model = Tokenizer.from_str(vocabulary).model
        self._shown = {b: c for b, c in enumerate(byte_characters())}
        inside = np.zeros((256, 256), bool)
        for s in ids:
            raw = np.frombuffer(bytes(byte_of[c] for c in s), np.uint8)
            inside[raw[:-1], raw[1:]] = True
        #: forced[a, b]: no token holds byte a before byte b, so that every encoding has a cut between them.
        self.forced = ~inside
        # Of bytes from 0x80 a few end white space longer than a byte; there the pre-tokenizer alone makes the cut.
        if not self.forced[0x21:0x7F, 0x20].all():
            raise ValueError("this vocabulary has tokens with a space after other characters")
        self._special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self._pre = regex.compile(PRE_TOKENS)
        self._odd_space = re.compile(r" (?:\s|\Z)")
        self._cut = re.compile(r" (?=\S)")
        self._forced = self.forced.tobytes()
        self._library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self._pieces = Cache(self.encode_piece)
        self._words, self._spaced = Cache(self.encode_word), Cache(lambda word: self.encode_word(" " + word))

    def fragments(self, raw: bytes) -> list[bytes]:
        """raw, cut at every forced boundary."""
        forced = self._forced
        if len(raw) > 256:
            b = np.frombuffer(raw, np.uint8)
            cuts = (np.flatnonzero(self.forced[b[:-1], b[1:]]) + 1).tolist()
        else:
            cuts = [i for i, (a, b) in enumerate(zip(raw, raw[1:]), 1) if forced[a << 8 | b]]
        return [raw[i:j] for i, j in zip([0, *cuts], [*cuts, len(raw)])] if cuts else [raw]

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of what the pre-tokenizer leaves together: those of its fragments, one after another."""
        found: list[int] = []
        for raw in self.fragments(piece.encode()):
            found += [t.id for t in self._model.tokenize(raw.decode("latin-1").translate(self._shown))]
        return found

    def encode_word(self, word: str) -> bytes:
        if word.isascii() or max(word) < "\u0250":
            pieces = self._pre.findall(word)
        else:  # versions of Unicode differ in what is a letter; the library decides for its own
            pieces = [word[i:j] for _, (i, j) in self._library.pre_tokenize_str(word)]
        ids: list[int] = []
        for piece in pieces:
            ids += self._pieces[piece]
        return np.array(ids, "<u4").tobytes() if len(ids) > 64 else struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        if not self._odd_space.search(text):
            first, _, rest = text.partition(" ")
            return (self.encode_word(first) if first else b"") + (b"".join(map(self._spaced.__getitem__, rest.split(" "))) if len(first) < len(text) else b"")
        starts = [0, *(m.start() for m in self._cut.finditer(text)), len(text)]
        return b"".join([self._words[text[i:j]] for i, j in zip(starts, starts[1:]) if i < j])

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self._special or "<" not in text or not self._special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[at : m.start()]) if m.start() > at else b"", np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:]) if at < len(text) else b""])

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def codec(vocabulary: str) -> ForcedBoundaryCodec:
    """The codec of this vocabulary, made once in each Python worker."""
    key = hash(vocabulary)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = ForcedBoundaryCodec(vocabulary)
    return _CODECS[key]


def round_trip(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text and decode its ids: id, ids (binary, little-endian unsigned 32-bit), decoded.

    No shuffle: texts are taken where they lie. The vocabulary file is read by
    the driver and broadcast; its size is fixed.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", _CODECS)
        c = codec(shared.value)
        for batch in batches:
            ids = [c.encode(x) for x in batch.column(1).to_pylist()]
            decoded = [c.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], [id_col, "ids", "decoded"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded string")
