"""Substring deduplication by recompression.

Words are named by a hash of their bytes; then rounds replace runs of equal
names, and after them pairs of a left and a right name, by names made of what
they replace. Names depend on content alone, so every task gives equal
substrings the same names without talking to others, except near their ends:
each symbol carries its context, the stretch of words that alone decided it.
Two equal windows of words therefore share every symbol whose context lies
within them.

Spark counts the symbols of all texts. A window that holds the whole context of
a symbol occurring once occurs once itself; only the others are candidates,
and exact hashes of those, counted over all texts, verify the repeats. The
words that repeated windows cover are removed. Texts that are equal byte for
byte are parsed and counted once and removed whole (if as long as a window).

Edge cases: null and empty texts have no words; texts shorter than a window
lose nothing; overlapping repeats within one text count; a run of one word is
a repeat of itself; rows that repeat an id are texts of their own; other
columns stay as they are, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, claim, materialize, tidied

WINDOW = 35
ROUNDS = 6
#: Rounds that also name runs. A run is known only with both its neighbours, so that every such round widens contexts.
RUNS = (0,)
#: A side of at most this many rows of a key is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 250_000
#: Windows that occur more often than this are found without being brought together.
OFTEN = 1_000
#: Context of what touches the end of a text: no window holds it.
FAR = 1 << 40
#: Words parsed at once; longer texts are parsed on their own.
TOGETHER = 1 << 17

_M = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for the ordered pair of two."""
    return mix(a * _M[0] + mix(b ^ _M[3]))


def word_names(words: list[bytes]) -> np.ndarray:
    """64-bit names of words: a polynomial in the bytes' random values, without a loop over words."""
    if not words:
        return np.zeros(0, np.uint64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    n = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(n)
    start = end - n
    place = np.arange(len(flat)) - np.repeat(start, n)
    value = _BYTES[flat] * _POWERS[np.minimum(place, len(_POWERS) - 1)]
    long = place >= len(_POWERS)
    if long.any():
        value[long] = mix(_BYTES[flat[long]] + place[long].astype(np.uint64) * _M[0])
    total = np.add.reduceat(value, start)
    return mix(total + n.astype(np.uint64) * _M[3])


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _M[0]) | np.uint64(1)
_POWERS = np.cumprod(np.full(64, _M[1], np.uint64))


def parse(names: np.ndarray, ends: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of texts laid end to end (text k is names[ends[k-1]:ends[k]]): their names, and the first and last
    word of each one's context, counted over all texts."""
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    s, low, high = names, np.arange(len(names)), np.arange(len(names))
    for turn in range(rounds):
        if turn in RUNS:
            # Runs of equal names: decided by the run and by its neighbours, which differ.
            head = np.ones(len(s), bool)
            head[1:] = (s[1:] != s[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(head)
            size = np.diff(first, append=len(s))
            last = first + size - 1
            new, nl, nh, nt = s[first], low[first], high[last], text[first]
            run = size > 1
            new[run] = join(new[run], size[run].astype(np.uint64))
            nl, nh = _hull(nl, nh, nt, low, high, text, np.where(first > 0, first - 1, -1), last + 1)
            s, low, high, text = new, nl, nh, nt
        # Pairs of a left and a right name: decided by the two; what stays single is decided with the neighbour it might have had.
        left = (mix(s ^ mix(_M[:1] + np.uint64(turn))) & np.uint64(1)).astype(bool)  # sides are dealt anew each round
        pair = np.zeros(len(s), bool)
        pair[:-1] = left[:-1] & ~left[1:] & (text[:-1] == text[1:])
        second = np.zeros(len(s), bool)
        second[1:] = pair[:-1]
        at = np.arange(len(s))
        other = np.where(left, at + 1, at - 1)
        inside = (other >= 0) & (other < len(s))
        safe = np.where(inside, other, at)
        inside &= text[safe] == text
        nl = np.where(inside, np.minimum(low, low[safe]), np.where(left, low, -FAR))
        nh = np.where(inside, np.maximum(high, high[safe]), np.where(left, FAR, high))
        new = s.copy()
        new[pair] = join(s[pair], s[np.flatnonzero(pair) + 1])
        keep = ~second
        s, low, high, text = new[keep], nl[keep], nh[keep], text[keep]
    return s, low, high


def _hull(nl, nh, nt, low, high, text, before, after):
    """Contexts widened to the neighbours' (or without bound, at the end of a text)."""
    b = np.maximum(before, 0)
    a = np.minimum(after, len(text) - 1)
    has_b = (before >= 0) & (text[b] == nt)
    has_a = (after < len(text)) & (text[a] == nt)
    nl = np.where(has_b, np.minimum(nl, low[b]), -FAR)
    nh = np.where(has_a, np.maximum(nh, high[a]), FAR)
    return nl, nh


def anchors(names: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its symbols with a context of at most a window: names, and context as words of the text."""
    s, low, high = parse(names, ends)
    ok = (low >= 0) & (high < FAR) & (high - low < WINDOW)
    s, low, high = s[ok], low[ok], high[ok]
    of = np.searchsorted(ends, low, side="right")
    cut = np.searchsorted(of, np.arange(len(ends) + 1))
    base = np.concatenate([[0], ends[:-1]])
    return [(s[i:j], low[i:j] - base[k], high[i:j] - base[k]) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:]))]


def window_hashes(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every window of words: 64 bits and another 32."""
    n = len(names) - WINDOW + 1
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    again = mix(names ^ _M[3])
    for k in range(WINDOW):
        one = one * _M[1] + names[k : k + n]
        two = two * _M[2] + again[k : k + n]
    return mix(one), mix(two) >> np.uint64(32)


def candidates(n: int, low: np.ndarray, high: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Which windows of a text of n words hold no context of a symbol that occurs once."""
    once = ~shared
    # The window from p holds [low, high] if high - WINDOW < p <= low.
    step = np.zeros(n + 2, np.int64)
    np.add.at(step, np.maximum(high[once] - WINDOW + 1, 0), 1)
    np.add.at(step, low[once] + 1, -1)
    return np.cumsum(step)[: max(0, n - WINDOW + 1)] == 0


def covered(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of n words the windows from starts cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + WINDOW, -1)
    return np.cumsum(step)[:n] > 0


def split(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _parse_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, key, text -> id, key, words, sha, syms (each once), vacant (some window holds no
    symbol that the text has but once)."""
    claim("recompression")
    for batch in batches:
        n, sha, vacant = [], [], []
        syms: list[np.ndarray] = []
        group: list[list[bytes]] = []
        size = 0
        for k, text in enumerate(batch.column(2).to_pylist()):
            words = split(text)
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            group.append(words)
            size += len(words)
            if size < TOGETHER and k < batch.num_rows - 1:
                continue
            names = word_names([w for words in group for w in words])
            for words, (s, low, high) in zip(group, anchors(names, np.cumsum([len(words) for words in group]))):
                each, count = np.unique(s, return_counts=True)
                syms.append(each.view(np.int64))
                vacant.append(bool(candidates(len(words), low, high, np.isin(s, each[count > 1])).any()))
            group, size = [], 0
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, syms)]), pa.int32()), pa.array(np.concatenate(syms) if syms else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), lists, pa.array(vacant, pa.bool_())], ["id", "key", "words", "sha", "syms", "vacant"])


def _hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, text, syms that others share -> rid, starts, ones, twos: candidate windows of each text."""
    claim("recompression")
    for batch in batches:
        keys, starts, ones, twos = [], [], [], []
        group: list[tuple[int, int, list[int] | None]] = []
        words: list[bytes] = []
        for k, (key, text, at) in enumerate(zip(*[batch.column(i).to_pylist() for i in range(3)])):
            own = split(text)
            words += own
            group.append((key, len(own), at))
            if len(words) < TOGETHER and k < batch.num_rows - 1:
                continue
            names = word_names(words)
            ends = np.cumsum([n for _, n, _ in group])
            one, two = window_hashes(names) if len(names) >= WINDOW else (names[:0], names[:0])
            for (rid, n, shared_syms), (syms, low, high), end in zip(group, anchors(names, ends), ends.tolist()):
                each, back, count = np.unique(syms, return_inverse=True, return_counts=True)
                shared = ((count > 1) | np.isin(each, np.array(shared_syms or [], np.int64).view(np.uint64)))[back]
                where = np.flatnonzero(candidates(n, low, high, shared))
                if len(where):
                    keys.append(rid)
                    starts.append(where.astype(np.int32))
                    ones.append(one[end - n + where].view(np.int64))
                    twos.append(two[end - n + where].astype(np.int64))
            group, words = [], []
        offsets = pa.array(np.cumsum([0, *map(len, starts)]), pa.int32())
        flat = lambda x, kind: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0), kind))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), flat(starts, pa.int32()), flat(ones, pa.int64()), flat(twos, pa.int64())], ["rid", "starts", "ones", "twos"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text, starts of repeated windows -> key, removed, kept (words joined by spaces)."""
    claim("recompression")
    for batch in batches:
        removed, kept = [], []
        for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = split(text)
            gone = covered(len(words), np.array(starts, np.int64))
            removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["key", "removed", "kept"])


def _those(windows: DataFrame, twice: DataFrame) -> DataFrame:
    """The windows whose hashes are in twice. Those of a passage that very many texts share stay where they are."""
    often = OFTEN
    while (n := twice.filter(F.col("n") > often).count()) > BROADCAST_ROWS:
        often *= 4
    names = ["ones", "twos"]
    if not n:
        return windows.join(twice.select(*names).hint("merge"), names, "left_semi")
    hot = F.broadcast(twice.filter(F.col("n") > often).select(*names))
    cold = twice.filter(F.col("n") <= often).select(*names).hint("merge")
    return windows.join(hot, names, "left_semi").unionByName(windows.join(hot, names, "left_anti").join(cold, names, "left_semi"))


def _among(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The texts with one of the keys, without moving others if the keys are few; keys must be a written table."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return texts.join(F.broadcast(keys) if few else keys.hint("merge"), "key", "left_semi")


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Parsed rows (id, key, words, sha, whole: other rows have this text), and for texts that lose words
    (key, removed, kept). key: the MD5 of a text."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))
    parsed = keyed.select("id", "key", "text").mapInArrow(tidied(_parse_texts), f"id {dict(docs.dtypes)[id_col]}, key binary, words bigint, sha string, syms array<bigint>, vacant boolean")
    parsed = materialize(parsed.withColumn("rid", F.monotonically_increasing_id()), "parsed")
    copies = materialize(parsed.groupBy("key").agg(F.min("rid").alias("rid"), F.count("*").alias("copies")), "copies")
    spare = materialize(parsed.select("rid", "key").join(copies.filter("copies > 1").select("key", F.col("rid").alias("kept")), "key").filter("rid != kept").select("rid"), "spare")
    few = spare.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    once = parsed.select("rid", "key", "words", "syms", "vacant").filter(f"words >= {WINDOW}").join(F.broadcast(spare) if few else spare.hint("merge"), "rid", "left_anti")

    symbols = once.select("rid", F.explode("syms").alias("sym"))
    shared = symbols.groupBy("sym").agg(F.count("*").alias("n")).filter("n > 1").select("sym")
    found = materialize(symbols.join(shared, "sym").groupBy("rid").agg(F.collect_list("sym").alias("at")), "shared")
    marked = once.select("rid", "key", "vacant").join(found, "rid", "left").filter("vacant or at is not null")
    marked = materialize(marked.select("rid", "key", "at"), "marked")
    texts = _among(keyed.select("key", "text"), marked.select("key")).dropDuplicates(["key"])
    hashed = materialize(texts.join(marked, "key").select("rid", "text", "at").mapInArrow(tidied(_hash_windows), "rid bigint, starts array<int>, ones array<bigint>, twos array<bigint>"), "windows")

    windows = hashed.select("rid", F.explode(F.arrays_zip("starts", "ones", "twos")).alias("w")).select("rid", "w.starts", "w.ones", "w.twos")
    twice = materialize(windows.groupBy("ones", "twos").agg(F.count("*").alias("n")).filter("n > 1"), "twice")
    starts = materialize(_those(windows, twice).groupBy("rid").agg(F.collect_list("starts").alias("starts")), "starts")
    losing = materialize(starts.join(marked.select("rid", "key"), "rid").select("key", "starts"), "losing")
    texts = _among(keyed.select("key", "text"), losing.select("key")).dropDuplicates(["key"])
    cut = texts.join(losing, "key").select("key", "text", "starts").mapInArrow(tidied(_cut), "key binary, removed bigint, kept string")
    rows = parsed.select("id", "key", "words", "sha").join(copies.select("key", (F.col("copies") > 1).alias("whole")), "key")
    return rows, cut


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for every row of docs."""
    rows, cut = repeats(docs, id_col=id_col, text_col=text_col)
    lost = materialize(cut.select("key", "removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha")), "lost")
    all_gone = F.col("whole") & (F.col("words") >= WINDOW)
    out = rows.join(lost, "key", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("words").alias("n_words"),
        F.when(all_gone, F.col("words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with repeated windows cut out of the texts (kept words joined by one space); a document of which no word
    is left goes. Texts that lose nothing stay as they are."""
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("key"))
    found, cut = repeats(docs.withColumn("row_number", F.lit(0)), id_col="row_number", text_col=text_col)
    whole = found.filter(F.col("whole") & (F.col("words") >= WINDOW)).select("key", F.lit("").alias("kept"))
    lost = materialize(cut.select("key", "kept").unionByName(whole).groupBy("key").agg(F.min("kept").alias("kept")), "lost")
    few = lost.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    touched = _among(rows, materialize(lost.select("key"), "touched")).join(lost, "key").filter("kept != ''")
    keys = lost.select("key")
    clean = rows.join(F.broadcast(keys) if few else keys.hint("merge"), "key", "left_anti")
    changed = [F.col("kept").alias(c) if c == text_col else F.col(f"row.{c}") for c in names]
    return clean.select("row.*").unionByName(touched.select(*changed))
