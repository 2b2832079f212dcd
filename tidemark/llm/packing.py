"""Packing along a Hilbert curve.

A document's token ids, hashed to random directions, give a vector of three
dimensions; cells of that space are numbered along a Hilbert curve. Documents
are range-sorted by that number (ties by id, so that copies do not pile up in
one task), and neighbours along the curve are packed together.

Each document is cut into full sequences and a tail in the pass that tokenizes
it, so that ids are never shuffled: what travels is a row a document. Tails are
packed, best fit first, among ``WINDOW`` neighbours along the curve; the least
full sequences stay open for the next window.

Edge cases: null and empty texts have the end token alone; rows of one id are
documents of their own, ordered by the rest of their row; an empty table gives
no rows; texts are never cut short; other columns, whatever their names, are not
looked at.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.bpe import byte_characters
from tidemark.llm.common import Cache, bounded_batches, claim, materialize, partitions

DIMENSIONS = 3
BITS = 10
#: Tails packed together: this many neighbours along the curve.
WINDOW = 512
#: Sequences that stay open from one window to the next.
OPEN = 64
#: Words, and pieces, of a generation of the caches.
CACHE = 400_000
#: Fixed value: the pieces of a lower-cased text that are encoded on their own.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

_TOKENIZERS: dict[int, WordTokenizer] = {}


def _raw(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordTokenizer:
    """Ids of whole texts by a tokenizer that lower-cases and drops white space.

    Spaces and line ends split a text into words that are encoded on their own, repeated ones from bounded caches.
    Words of plain letters, digits and marks go to the library's model piece by piece, all others to the library whole.
    """

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.shown = dict(enumerate(byte_characters()))
        self.words, self.pieces = Cache(self.encode_word, CACHE), Cache(self.encode_piece, CACHE)
        self.split = regex.compile(PIECES)
        self.directions = np.random.default_rng(7).standard_normal((self.tokenizer.get_vocab_size(), DIMENSIONS)).astype(np.float32)

    def encode_piece(self, piece: str) -> bytes:
        # Printable ASCII stands for itself in the vocabulary.
        shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.shown)
        return _raw([t.id for t in self.model.tokenize(shown)])

    def encode_word(self, word: str) -> bytes:
        if not word:
            return b""
        if "<" in word or not (word.isascii() or max(word) < "\u0250"):
            return _raw(self.tokenizer.encode(word, add_special_tokens=False).ids)
        low = word.lower()
        if low.isalpha():
            return self.pieces[low]
        if low[-1] in ".," and low[:-1].isalpha():
            return self.pieces[low[:-1]] + self.pieces[low[-1]]
        return b"".join([self.pieces[x] for x in self.split.findall(low)])

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


def tokenizer(spec: str) -> WordTokenizer:
    key = hash(spec)
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = WordTokenizer(spec)
    return _TOKENIZERS[key]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Numbers along the Hilbert curve of the rows of cells, integers below 2**bits (the transpose form)."""
    x = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ t) >> b & 1)
    return key


def cells(sums: np.ndarray, counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Cells of the mean directions; the squashed range is the same for inputs of any size."""
    z = sums / np.sqrt(np.maximum(counts, 1))[:, None]
    side = 1 << bits
    return np.clip(((np.tanh(z / 4) + 1) / 2 * side).astype(np.int64), 0, side - 1)


def documents(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, length: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: id, key along the curve, tokens (with the end token), and the CRC-32 of each of its pieces.

    Pieces are full sequences, then a tail. No shuffle.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing", _TOKENIZERS)
        t = tokenizer(shared.value)
        for batch in batches:
            n, crcs = [], []
            sums = np.zeros((batch.num_rows, DIMENSIONS), np.float64)
            for k, text in enumerate(batch.column(1).to_pylist()):
                raw = t.encode(text)
                for at in range(0, len(raw), 1 << 22):
                    sums[k] += t.directions[np.frombuffer(raw[at : at + (1 << 22)], "<u4")].sum(0, dtype=np.float64)
                raw += end
                n.append(len(raw) // 4)
                crcs.append([zlib.crc32(raw[at : at + 4 * length]) for at in range(0, len(raw), 4 * length)])
            key = hilbert(cells(sums, np.array(n, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], [id_col, "key", "tokens", "crcs"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, key bigint, tokens bigint, crcs array<bigint>")


class Packer:
    """Puts pieces into sequences of at most ``length`` tokens, best fit first, a window at a time."""

    def __init__(self, length: int, first: int):
        self.length, self.next = length, first
        self.open: list[tuple[int, int]] = []  # (room, sequence), sorted
        self.used: dict[int, int] = {}

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def window(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence and the offset of each piece."""
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for i in np.argsort(-lengths, kind="stable").tolist():
            n = int(lengths[i])
            at = bisect_left(self.open, (n, -1))
            if at < len(self.open):
                room, s = self.open.pop(at)
            else:
                room, s = self.length, self.new()
            seq[i], off[i] = s, self.length - room
            if room > n:
                insort(self.open, (room - n, s))
        if len(self.open) > OPEN:
            self.open = self.open[-OPEN:]
        return seq, off


def pack(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, length: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents and their places: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, key."""
    spark = docs.sparkSession
    rows = materialize(documents(docs, tokenizer_path, end_id=end_id, length=length, id_col=id_col, text_col=text_col), "tokens")
    sorted_rows = rows.repartitionByRange(partitions(spark), "key", id_col, "tokens").sortWithinPartitions("key", id_col, "tokens", "crcs")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length, TaskContext.get().partitionId() << 40)
        for batch in batches:
            key, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for at in range(0, batch.num_rows, WINDOW):
                part = slice(at, min(at + WINDOW, batch.num_rows))
                tokens = n[part]
                tail = tokens % length
                seq, off = packer.window(tail[tail > 0])
                crcs = batch.column(3).slice(at, len(tokens))
                count = -(-tokens // length)
                of = np.repeat(np.arange(len(tokens)), count)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * length
                size = np.minimum(tokens[of] - start, length)
                whole = size == length
                s, o = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
                s[whole] = packer.next + np.arange(whole.sum())
                packer.next += int(whole.sum())
                s[~whole], o[~whole] = seq, off
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(tokens)).take(take), pa.array(start), pa.array(size), crcs.flatten(), pa.array(tokens[of]), pa.array(s), pa.array(o), pa.array(key[part][of])], names
                )

    kind = dict(docs.dtypes)[id_col]
    return sorted_rows.mapInArrow(run, f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, key bigint")
