"""WARC archives: written by Spark's text sink, read back by boundary chains.

Writing. A record ends with two line ends, which is the sink's line separator,
so that archives go to any file system Spark knows, with its commit protocol.
Payloads of at least ``REVISIT_BYTES`` that are equal have one response, that
of the largest page id; the others are revisits of it.

Reading. Archives are split at the magic wherever it stands, payloads included;
splits of a large archive are read by different tasks. Each piece that parses
as a header is a candidate with a link to where its record should end. Links
are first followed within a split, then by pointer jumping between splits, and
only what a chain from the start of the file reaches is a record: magic inside
a payload starts no chain and is rejected. Pieces between two reachable starts
are one record's.

Edge cases: a null page is an empty payload; rows that repeat a page id and its
payload are records of their own, all of the type of that pair; a null page id
is written as ``none`` and read as null, and is never revisited unless no other
has that payload; a null url is empty; a chain that breaks (a damaged archive)
yields its records up to the break; other columns, whatever their names, are not
looked at; an empty table gives an empty archive and no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialize, scratch_path

MAGIC = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
REVISIT_BYTES = 1000
#: A side of at most this many rows (of under 200 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of a stretch of an archive: records that hold magic, and pieces, are brought together stretch by stretch.
STRETCH = 1 << 20
#: Fixed date of the records, as the tables have none.
DATE = "2024-01-01T00:00:00Z"


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its rows are few; df must be a written table."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


def _payload(html_col: str) -> Column:
    return F.coalesce(F.col(html_col), F.lit("")).cast("binary")


def revisits(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, digest, refers_to) of the pages that are to revisit another."""
    seen = pages.select(F.col(id_col).alias("id"), F.sha1(_payload(html_col)).alias("digest"), F.octet_length(_payload(html_col)).alias("n")).filter(f"n >= {REVISIT_BYTES}")
    kept = seen.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1")
    return seen.join(kept, "digest").filter("id != refers_to").select("id", "digest", "refers_to").distinct()


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for every row of pages under path."""
    again = materialize(revisits(pages, id_col=id_col, html_col=html_col), "revisits")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\\r\\n]", "").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    rows = rows.join(_small(again), ["id", "digest"], "left")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    is_revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(BLANK))
    rows = rows.withColumn("block", F.concat(http, F.when(is_revisit, "").otherwise(F.col("html"))))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")), F.lit("\r\nWARC-Target-URI: "), F.col("url"), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(is_revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col("refers_to")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit(BLANK), F.col("block"),
    )
    rows.select(record.alias("value")).write.option("lineSep", BLANK).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magics: file, block (its split), value."""
    read = spark.read.option("lineSep", MAGIC).text(path)
    return read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?:^|\r\n){name}: *([^\r\n]*)", 1)


def _parsed(pieces: DataFrame) -> DataFrame:
    """A row a piece: its place, length and hash, and what its header says, if it has one."""
    raw, head = F.col("value").cast("binary"), F.substring_index("value", BLANK, 1)
    out = pieces.withColumn("mid", F.monotonically_increasing_id()).withColumn("size", F.octet_length("value").cast("long"))
    out = out.withColumn("head", F.octet_length(head).cast("long") + 4).withColumn("http", F.octet_length(F.substring_index("value", BLANK, 2)).cast("long") - F.col("head") + 4)
    length = _field(head, "Content-Length").try_cast("long")
    out = out.withColumn("content", F.when(F.length(_field(head, "WARC-Type")) > 0, length))
    whole = F.col("head") + F.col("content") + 4 == F.col("size")
    body = F.substring(raw, (F.col("head") + F.col("http") + 1).cast("int"), (F.col("content") - F.col("http")).cast("int"))
    http_lines = F.substring_index(F.substring_index("value", BLANK, 2), BLANK, -1)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    return out.select(
        "file", "block", "mid", "size", "head", "http", "content", F.xxhash64("value").alias("hash"), F.coalesce(whole, F.lit(False)).alias("whole"),
        F.when(whole, F.sha1(body)).alias("sha1"), _field(head, "WARC-Type").alias("record_type"), number(_field(head, "WARC-Record-ID")).alias("page_id"),
        number(_field(head, "WARC-Refers-To")).alias("refers_to"), F.regexp_extract(_field(head, "WARC-Payload-Digest"), "sha1:([0-9a-f]+)", 1).alias("stated"),
        _field(http_lines, "Content-Length").try_cast("long").alias("payload_bytes"), _field(head, "WARC-Target-URI").alias("url"),
    )


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the candidates of one split: where the chain from each first leaves the split."""
    rows = rows.sort_values("off")
    leaves: dict[int, int] = {}
    for off, end in zip(rows["off"].to_numpy()[::-1].tolist(), rows["end"].to_numpy()[::-1].tolist()):
        leaves[off] = leaves.get(end, end)
    return rows.assign(exit=[leaves[x] for x in rows["off"].tolist()])


def _reached(rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of one split that a chain from one of its entries reaches."""
    rows = rows.sort_values("off")
    known, kept = set(rows.loc[rows["entry"], "off"].tolist()), []
    for off, end in zip(rows["off"].tolist(), rows["end"].tolist()):
        kept.append(off in known)
        if kept[-1]:
            known.add(end)
    return rows[kept][["file", "block", "off"]]


def index(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under path: file, off, page_id, url, record_type, refers_to, payload_bytes,
    payload_digest (of responses: computed from what was read)."""
    pieces = _pieces(spark, path)
    parsed = materialize(_parsed(pieces), "pieces")
    m = len(MAGIC)
    splits = parsed.groupBy("file", "block").agg(F.sum(F.col("size") + m).alias("length"))
    base = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("base", F.coalesce(F.sum("length").over(base), F.lit(0)))
    ahead = Window.partitionBy("file", "block").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    placed = parsed.join(splits.select("file", "block", "base"), ["file", "block"]).withColumn("off", F.col("base") + F.coalesce(F.sum(F.col("size") + m).over(ahead), F.lit(0)) - m)
    placed = materialize(placed.drop("base", "mid"), "placed")

    candidates = placed.filter("content is not null").select("file", "block", "off", (F.col("off") + m + F.col("head") + F.col("content") + len(BLANK)).alias("end"))
    local = materialize(candidates.groupBy("file", "block").applyInPandas(_exits, "file string, block bigint, off bigint, end bigint, exit bigint"), "exits")
    # Between splits: only starts of files and places where some chain enters a split take part in the jumping.
    doors = local.select("file", F.col("exit").alias("off")).unionByName(local.select("file").distinct().withColumn("off", F.lit(0).cast("long"))).distinct()
    jumps = materialize(local.join(doors, ["file", "off"]).select("file", "off", "exit"), "jumps")
    entries, n = jumps.filter("off = 0").select("file", "off"), -1
    while True:
        entries = materialize(entries, "entries")
        now = entries.count()
        if now == n or jumps.count() == now:
            break
        n = now
        to = jumps.select("file", F.col("off").alias("exit"), F.col("exit").alias("then"))
        onward = entries.join(jumps, ["file", "off"]).join(jumps.select("file", F.col("off").alias("exit")), ["file", "exit"]).select("file", F.col("exit").alias("off"))
        entries = entries.unionByName(onward).distinct()
        jumps = materialize(jumps.join(to, ["file", "exit"], "left").select("file", "off", F.coalesce("then", "exit").alias("exit")), "jumps")
    flagged = local.join(entries.withColumn("entry", F.lit(True)), ["file", "off"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    reached = flagged.groupBy("file", "block").applyInPandas(_reached, "file string, block bigint, off bigint")

    records = materialize(placed.join(reached, ["file", "block", "off"]), "records")
    digest = _spanning(pieces, placed, records)
    found = records.join(digest, ["file", "off"], "left").withColumn("payload_digest", F.when(F.col("record_type") == "response", F.coalesce("sha1", "spanning")).otherwise(F.col("stated")))
    return found.select("file", "off", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")


def _spanning(pieces: DataFrame, placed: DataFrame, records: DataFrame) -> DataFrame:
    """(file, off, spanning): digests of the payloads that hold magic, put together from their pieces."""
    spans = records.filter("not whole").select("file", F.col("off").alias("start"), "head", "http", "content", F.expr(f"off + {len(MAGIC)} + head + content + {len(BLANK)}").alias("stop"))
    spans = spans.withColumn("stretch", F.explode(F.expr(f"sequence(start div {STRETCH}, (stop - 1) div {STRETCH})")))
    pieces_at = placed.select("file", "block", "off", "size", "hash", F.expr(f"off div {STRETCH}").alias("stretch"))
    inside = pieces_at.join(spans.hint("merge"), ["file", "stretch"]).filter("off >= start and off < stop")
    inside = materialize(inside, "spans")
    # Pieces of one split with equal contents stand for each other.
    wanted = materialize(inside.select("file", "block", "hash").distinct(), "wanted")
    values = pieces.withColumn("hash", F.xxhash64("value")).join(_small(wanted), ["file", "block", "hash"]).dropDuplicates(["file", "block", "hash"])
    parts = inside.join(values, ["file", "block", "hash"]).groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("parts"), F.first("head").alias("head"), F.first("http").alias("http"), F.first("content").alias("content"))
    whole = F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC).cast("binary")
    return parts.select("file", F.col("start").alias("off"), F.sha1(F.substring(whole, (F.col("head") + F.col("http") + 1).cast("int"), (F.col("content") - F.col("http")).cast("int"))).alias("spanning"))


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages to archives in the shared folder and index them."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, id_col=id_col, url_col=url_col, html_col=html_col)
    return index(pages.sparkSession, path)
