"""SimHash near-duplicates by pivot distance tables.

A fingerprint has a bit set where over half of a text's word shingles have it
set in their XXH64. Fingerprints link at ``MAX_DISTANCE`` or fewer differing
bits. Texts of one fingerprint are one node, so that groups of copies, however
large, cost what their distinct fingerprints cost.

Where fingerprints may link, two of their four 16-bit bands are equal; blocks
by pairs of bands hold all candidates. Inside a block every fingerprint has a
row of Hamming distances to ``PIVOTS`` reference fingerprints. By the triangle
inequality a pair whose rows differ anywhere by more than the distance sought
is no link: the block is sorted by its distances to the pivot that tells most,
which leaves the pairs within a window, and the other pivots discard most of
those. What the table leaves is verified bit by bit. Of the verified pairs of a
block, a spanning forest is kept, never all pairs.

A block of over ``BLOCK`` fingerprints (a cloud of near copies) is not examined
pair by pair: its members are hung on each of their 65 neighbours within one
bit. Two fingerprints within two bits share such a neighbour and two that share
one are within two bits, so this way is exact, linear, and no neighbour has
over 65 members.

Edge cases: null and empty texts, and those of white space alone, have
fingerprint zero and link like any other; fewer words than a shingle count as
one shingle; rows of one id are rows of their own; a null id is never a
component's name unless all its rows have none; other columns, whatever their
names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import graph
from tidemark.llm.common import bounded_batches, claim, materialize

SEED = 42
MAX_DISTANCE = 2
BANDS = 4
PIVOTS = 32
BLOCK = 4096
#: Pairs of a block that are looked at together.
TOGETHER = 1 << 18
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """The XXH64 of every word shingle of a whole text, in chunks; none for a text without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    ends = [e - 1 for e in accumulate([len(w) + 1 for w in found])]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    spans = zip(starts, ends[words - 1 :] or ends[-1:])
    while len(h := np.array([digest(joined[i:j], SEED) for i, j in islice(spans, CHUNK)], "<u8")):
        yield h


def _majority(chunks: Iterator[np.ndarray]) -> int:
    total, n = np.zeros(64, np.int64), 0
    for h in chunks:
        n += len(h)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a whole text, unsigned."""
    return _majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp), the fingerprint as a signed long. No shuffle."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in batches:
            fp = np.array([fingerprint(x, words) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fp bigint")


def pivots() -> np.ndarray:
    """The reference fingerprints, the same everywhere."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def distance_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints to the pivots, a row each."""
    return np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.int8)


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of the edges (a, b) that connect parts which were not connected; root (every node's least known) is kept up."""
    kept = []
    new = root[a] != root[b]
    for i, j in zip(a[new].tolist(), b[new].tolist()):
        x, y = i, j
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        root[i] = root[j] = root[x] = root[y] = min(x, y)
        if x != y:
            kept.append((i, j))
    while (root[root] != root).any():
        root[:] = root[root]
    return kept


def block_links(fp: np.ndarray, table: np.ndarray, distance: int = MAX_DISTANCE) -> list[tuple[int, int]]:
    """Indices of linked pairs of one block, enough to connect all that link."""
    n, found, root = len(fp), [], np.arange(len(fp))
    # Pivots by how few pairs have equal distances to them.
    order = np.argsort([(np.bincount(table[:, p]) ** 2).sum() for p in range(PIVOTS)], kind="stable")
    row = np.argsort(table[:, order[0]], kind="stable")
    first = table[row, order[0]]
    count = np.searchsorted(first, first + distance, side="right") - np.arange(n) - 1
    total = np.cumsum(count)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TOGETHER, side="right")))
        some = count[at:end]
        a = np.repeat(np.arange(at, end), some)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(some) - some, some)
        a, b, at = row[a], row[b], end
        for p in order[1:]:
            near = np.abs(table[a, p] - table[b, p]) <= distance
            a, b = a[near], b[near]
        true = np.bitwise_count(fp[a] ^ fp[b]) <= distance
        found += _join(root, a[true], b[true])
    return found


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) between the distinct fingerprints (fp), enough to connect all within ``MAX_DISTANCE`` bits."""
    width = 64 // BANDS
    band = [F.expr(f"shiftrightunsigned(fp, {width * k}) & {(1 << width) - 1}") for k in range(BANDS)]
    keys = [F.lit(k << 2 * width).bitwiseOR(F.shiftleft(band[i], width)).bitwiseOR(band[j]) for k, (i, j) in enumerate(combinations(range(BANDS), 2))]
    blocks = distinct.select("fp", F.explode(F.array(*keys)).alias("block"))
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialize(blocks.join(sizes, "block"), "blocks")

    def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            fp = lists.flatten().to_numpy().view(np.uint64)
            table = distance_table(fp)
            u, v = [], []
            for i, j in zip(at[:-1], at[1:]):
                for a, b in block_links(fp[i:j], table[i:j]):
                    u.append(fp[i + a])
                    v.append(fp[i + b])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)], ["u", "v"])

    small = members.filter(f"n <= {BLOCK}").groupBy("block").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(examine, "u bigint, v bigint")
    flips = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << b) - ((1 << 64) if b == 63 else 0)).cast("long")) for b in range(64)]]
    near = members.filter(f"n > {BLOCK}").select("fp").distinct().select("fp", F.explode(F.array(*flips)).alias("near"))
    hung = near.groupBy("near").agg(F.collect_set("fp").alias("fps")).filter("size(fps) > 1").select(F.array_min("fps").alias("u"), F.explode("fps").alias("v"))
    return small.unionByName(hung.filter("u != v"))


def classes(prints: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """For (id, fp): the same rows with component_id, the least id reachable over links."""
    distinct = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    distinct = materialize(distinct, "prints")
    stars = graph.components(links(distinct.select("fp")))
    rooted = distinct.join(stars.withColumnsRenamed({"u": "fp", "v": "root"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.join(names, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row of docs."""
    return classes(materialize(fingerprints(docs, words=words, id_col=id_col, text_col=text_col), "simhash"), id_col=id_col)


#: For similar texts rather than equal fingerprints: how alike the sets of shingles must be, the least hashes of a
#: text that name its blocks, the members and shingles of a tile of a block, and the members of a large block that go
#: to all of its tiles.
SIMILARITY = 0.8
NAMES = 4
MEMBERS = 2_048
SHINGLES = 2_000_000
HEADS = 8


def _set(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's shingles, each once, sorted."""
    chunks = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(chunks)) if chunks else np.zeros(0, np.uint64)


def similar(sets: list[np.ndarray], known: int = 0) -> list[tuple[int, int]]:
    """Indices of pairs of similar sets, enough to connect all that are similar. The first ``known`` are connected already.

    Every set's hashes are looked up among those of the sets before it, which counts what it has in common with each.
    """
    size = np.array([len(x) for x in sets])
    at = np.concatenate([[0], np.cumsum(size)])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(ids, kind="stable")
    holders = np.repeat(np.arange(len(sets)), size)[order]
    upto = np.empty_like(order)
    upto[order] = np.arange(len(order))
    since = np.concatenate([[0], np.cumsum(np.bincount(ids))])[ids]
    cluster, found = np.arange(len(sets)), []
    cluster[:known] = 0
    for k in range(max(known, 1), len(sets)):
        low, high = since[at[k] : at[k + 1]], upto[at[k] : at[k + 1]]
        some = high > low
        if not some.any():
            continue
        common = np.bincount(np.concatenate([holders[i:j] for i, j in zip(low[some].tolist(), high[some].tolist())]), minlength=k)
        like = np.flatnonzero(common >= SIMILARITY * (size[:k] + size[k] - common))
        joined, first = np.unique(cluster[like], return_index=True)
        found += [(k, i) for i in like[first].tolist()]
        if len(joined):
            cluster[k] = joined[0]
        if len(joined) > 1:
            cluster[:k][np.isin(cluster[:k], joined)] = joined[0]
    return found


def _link(words: int):
    """Members sorted by block and pair of tiles, connected ones first -> links (u, v) between the similar ones."""

    def links_of(sigs: list[int], sets: list[np.ndarray], known: int) -> pa.RecordBatch:
        found = similar(sets, known)
        return pa.RecordBatch.from_arrays([pa.array([sigs[x[i]] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        last, sigs, sets, known = None, [], [], 0
        for batch in batches:
            for *place, apart, sig, text in zip(*[c.to_pylist() for c in batch.columns]):
                if place != last:
                    if len(sigs) > 1:
                        yield links_of(sigs, sets, known)
                    last, sigs, sets, known = place, [], [], 0
                known += not apart
                sigs.append(sig)
                sets.append(_set(text, words))
        if len(sigs) > 1:
            yield links_of(sigs, sets, known)

    return run


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in batches:
            sets = [_set(text, words) for text in batch.column(1).to_pylist()]
            sig = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64)
            names = pa.array([x[:NAMES].view(np.int64).tolist() for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig.view(np.int64)), pa.array([len(x) for x in sets], pa.int32()), names], ["rid", "sig", "size", "names"])

    return run


def similar_groups(docs: DataFrame, *, words: int = 5, rid: str = "rid", id_col: str = "doc_id", text_col: str = "text", linked_rows: DataFrame | None = None) -> DataFrame:
    """(rid, stays) for every row: of the texts whose word shingles resemble each other, that of the least id stays.

    ``linked_rows``: (rid, component_id) of rows that are linked already; their links are links of the groups like those
    found here. Texts with the same set of shingles are one. Others meet in blocks named by their least shingle hashes (of four
    names; the README has how often two texts at 0.8 miss each other). In a block, the whole sets of shingle hashes,
    made again from the texts, decide for every pair; links kept are one for each pair of clusters that meet. A block
    of over ``MEMBERS`` texts or ``SHINGLES`` shingles is cut into tiles, a task each, and ``HEADS`` of its members go to
    all of them: copies of one text are like these, and so connected. What of a block is not connected to the largest
    part of it then meets the texts of every other tile, so that no link is lost, and work is linear where blocks are
    groups of copies.
    Null ids stay last; texts without words are alike.
    """
    bounded_batches(docs.sparkSession)
    marked = docs.select(F.col(rid).alias("rid"), text_col).mapInArrow(_signatures(words), "rid bigint, sig bigint, size int, names array<bigint>")
    marked = materialize(marked, "signatures")
    distinct = materialize(marked.groupBy("sig").agg(F.min("rid").alias("rid"), *[F.first(c).alias(c) for c in ("size", "names")]), "distinct")
    names = distinct.select("sig", "rid", "size", F.explode("names").alias("block"))
    tiles = F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("size") / SHINGLES))
    blocks = names.groupBy("block").agg(F.count("*").alias("n"), tiles.alias("tiles")).filter("n > 1")
    members = materialize(names.join(blocks, "block").withColumn("own", F.pmod(F.xxhash64("sig"), "tiles").cast("int")).select("block", "rid", "sig", "tiles", "own"), "members")
    texts = docs.select(F.col(rid).alias("rid"), F.col(text_col).alias("text"))

    def linked(dealt: DataFrame) -> DataFrame:
        """Links between the texts that are in one tile or two (block, tile, other); those not apart are connected already."""
        rows = dealt.join(texts, "rid").select("block", "tile", "other", "apart", "sig", "text")
        return rows.repartition("block", "tile", "other").sortWithinPartitions("block", "tile", "other", "apart", "sig").mapInArrow(_link(words), "u bigint, v bigint")

    own = members.select("block", F.col("own").alias("tile"), F.lit(0).alias("other"), "rid", "sig")
    large = members.filter("tiles > 1")
    few = [F.min(F.struct(F.xxhash64("sig", F.lit(k)).alias("h"), "sig", "rid", "own", "tiles")) for k in range(HEADS)]
    heads = large.groupBy("block").agg(F.array_distinct(F.transform(F.array(*few), lambda x: x.dropFields("h"))).alias("heads")).select("block", F.explode("heads").alias("x")).select("block", "x.*")
    heads = heads.select("block", F.explode(F.sequence(F.lit(0), F.col("tiles").cast("int") - 1)).alias("tile"), F.lit(0).alias("other"), "rid", "sig", "own").filter("tile != own").drop("own")
    links = linked(own.unionByName(heads).withColumn("apart", F.lit(True)))
    if linked_rows is not None:
        members_of = materialize(linked_rows.join(marked.select("rid", "sig"), "rid").select("component_id", "sig").distinct(), "linked")
        least = members_of.groupBy("component_id").agg(F.min("sig").alias("v"), F.count("*").alias("n")).filter("n > 1")
        links = links.unionByName(members_of.join(least, "component_id").filter("sig != v").select(F.col("sig").alias("u"), "v"))
    links = materialize(links, "links")
    stars = graph.components(links)
    parts = large.join(stars.toDF("sig", "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    main = parts.groupBy("block", "root").count().groupBy("block").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    told = materialize(parts.join(main, "block").select("block", "rid", "sig", "own", "tiles", (F.col("root") != F.col("main")).alias("apart")), "told")
    where = told.filter("apart").groupBy("block").agg(F.collect_set("own").alias("theirs"))  # at most as many as the block has tiles
    if not where.isEmpty():
        # Every two tiles meet, unless neither has a text that is apart.
        met = F.filter(F.sequence(F.lit(0), F.col("tiles").cast("int") - 1), lambda t: (t != F.col("own")) & (F.array_contains("theirs", t) | F.array_contains("theirs", F.col("own"))))
        pairs = told.join(where, "block").select("block", "rid", "sig", "own", "apart", F.explode(met).alias("t"))
        pairs = pairs.select("block", F.least("own", "t").alias("tile"), F.greatest("own", "t").alias("other"), "rid", "sig", "apart")
        stars = graph.components(stars.unionByName(linked(pairs)))  # the stars connect what the links do
    rooted = marked.select("rid", "sig").join(docs.select(F.col(rid).alias("rid"), F.col(id_col).alias("id")), "rid").join(stars.toDF("sig", "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    order = F.struct(F.col("id").isNull().alias("null"), F.col("id"), F.col("rid"))
    staying = rooted.groupBy("root").agg(F.min(order).alias("least")).select(F.col("least.rid").alias("rid"), F.lit(True).alias("stays"))
    return rooted.select("rid").join(staying, "rid", "left").select("rid", F.coalesce("stays", F.lit(False)).alias("stays"))


def drop_similar(docs: DataFrame, *, words: int = 5, fingerprint_words: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the texts that resemble one with a smaller id; all columns stay as they are, whatever their names.

    With ``fingerprint_words``, texts that ``near_duplicates`` links by fingerprints of shingles of so many words are of
    one group as well: groups are what the links of fingerprints and of sets connect together.
    """
    rows = materialize(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("rid")), "rows")
    texts = rows.select("rid", F.col(f"row.{id_col}").alias(id_col), F.col(f"row.{text_col}").alias(text_col))
    linked = None
    if fingerprint_words is not None:
        linked = near_duplicates(texts, words=fingerprint_words, id_col="rid", text_col=text_col).select("rid", "component_id")
    groups = similar_groups(texts, words=words, id_col=id_col, text_col=text_col, linked_rows=linked)
    gone = materialize(groups.filter("not stays").select("rid"), "gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone.hint("merge"), "rid", "left_anti").select("row.*")


#: Ids of dropped rows are broadcast up to so many; more are joined by a shuffle.
BROADCAST_ROWS = 250_000
