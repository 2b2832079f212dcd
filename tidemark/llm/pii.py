"""Personal data by fixed patterns, and information-theoretic sanitisation around it.

Every pattern match is a protected entity. Terms near its mentions may give it
away: from document frequencies over the whole corpus, the pointwise mutual
information of a term and an entity is what seeing the term tells of the
entity, out of the information content that the entity has. A term that tells
at least 1 / ``ALPHA`` of its content discloses it, and is marked, or
generalised, wherever it stands near a mention of that entity. Counts are of
distinct texts, and ``DISCOUNT`` is taken from the number of texts that hold
both, as few of them may be chance: rare entities are judged like others.

Near means anywhere in a text that mentions the entity, or, where a reach is
given, within so many code points of a mention, up to the next match of the
mention's kind. Words that the reach cuts, and those of e-mail addresses, are
no terms. Over whole texts, entities that stand in the same texts are judged as
one, and pairs that one common text decides are not counted, so that a text of
many entities and many terms does not pair them all.

All of this is DataFrame expressions. Positions count code points; they come
from the lengths of what stands between matches, added up in chunks of
``CHUNK`` matches, so that the work is linear in a text but for a small part.
Patterns are possessive and start only where a match can, so that they take
linear time and no stack.

Edge cases: null and empty texts have no spans; rows that repeat an id are
documents of their own; equal texts count once as evidence; other columns are
kept whatever their names, one called as the spans are gives way to them; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: The kinds, in their order, each with a Java pattern.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
#: Code points looked at on either side of a mention where ``find`` is not told to look at whole texts, and the shortest term.
REACH = 64
SHORTEST = 4
#: The most frequent words that can disclose nothing, so many of them, are left out before words are dealt.
HOT = 1_000
#: Taken from the number of texts in which a term stands near an entity.
DISCOUNT = 0.5
ALPHA = 1.25
#: Matches whose places are added up one by one.
CHUNK = 256

_SPANS = "array<struct<kind:string,start:int,end:int,value:string,left:string,right:string>>"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _located(text: Column, pattern: str, kind: str, reach: int | None) -> Column:
    """All matches of pattern as spans, with what stands on either side of them (up to the next match, and ``reach``; nothing without one)."""
    none = F.array().cast(_SPANS)

    def some(found: Column) -> Column:
        # Most texts have no match, and are not split.
        return F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), lambda between: placed(found, between))).otherwise(none)

    def placed(found: Column, between: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int"))
        sizes = F.transform(found, lambda x, i: F.char_length(x) + F.char_length(F.get(between, i)))

        def chunked(sizes: Column) -> Column:
            sums = F.transform(chunks, lambda k: _total(F.slice(sizes, k * CHUNK + 1, F.lit(CHUNK))))
            return _let(sums, lambda sums: F.flatten(F.transform(chunks, lambda k: chunk(k, sums))))

        def chunk(k: Column, sums: Column) -> Column:
            begin = F.struct(_total(F.slice(sums, F.lit(1), k)).alias("at"), none.alias("spans"))
            places = F.sequence(k * CHUNK, F.least(k * CHUNK + CHUNK, F.size(found)) - 1)
            return F.aggregate(places, begin, step, lambda done: done["spans"])

        def step(done: Column, i: Column) -> Column:
            value, before, after = F.get(found, i), F.get(between, i), F.get(between, i + 1)
            start = done["at"] + F.char_length(before)
            end = start + F.char_length(value)
            span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"), _edge(before, True, reach).alias("left"), _edge(after, False, reach).alias("right"))
            return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

        return _let(sizes, chunked)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)


def _edge(piece: Column, last: bool, reach: int | None) -> Column:
    """The end of a piece (or its beginning) that is within reach, without what the reach cuts."""
    if reach is None:
        return F.lit("")
    near = F.substring(piece, -reach if last else 1, reach)
    return F.when(F.char_length(piece) > reach, F.regexp_replace(near, r"^\S+" if last else r"\S+$", "")).otherwise(near)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column, reach: int | None = REACH) -> Column:
    """The spans of the patterns, by kind and start: kind, start, end (exclusive), value, left, right."""
    keep = {
        "ip": lambda s: s["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": lambda s: _luhn(s["value"]),
        "phone": lambda s: F.length(_digits(s["value"])).between(8, 15),
    }
    return F.concat(*[F.filter(s, keep[k]) if k in keep else s for k, p in PATTERNS.items() for s in [_located(text, p, k, reach)]])


def _entity(span: Column) -> Column:
    numeric = span["kind"].isin("card", "phone")
    return F.concat(span["kind"], F.lit(":"), F.when(numeric, _digits(span["value"])).otherwise(F.lower(span["value"])))


def _words(side: Column) -> Column:
    """The words of what stands beside a mention: value, start. Addresses are taken whole, and left out."""
    email = PATTERNS["email"].replace(r"\G|", "")
    found = _located(side, rf"(?:{email})|\p{{L}}{{{SHORTEST},}}+", TERM, None)
    return F.filter(found, lambda t: ~F.contains(t["value"], F.lit("@")))


def _terms(spans: Column) -> Column:
    """Terms near each span: entity, term, start, end."""

    def near(span: Column) -> Column:
        term = lambda t, base: F.struct(_entity(span).alias("entity"), F.lower(t["value"]).alias("term"), (t["start"] + base).alias("start"), (t["end"] + base).alias("end"))
        left = F.transform(_words(span["left"]), lambda t: term(t, span["start"] - F.char_length(span["left"])))
        return F.concat(left, F.transform(_words(span["right"]), lambda t: term(t, span["end"])))

    return F.flatten(F.transform(spans, near))


def _all_words(text: Column) -> Column:
    """The words of a whole text: term, start, end. Addresses are taken whole, with letters they follow on, and left out."""
    found = _located(text, rf"\p{{L}}*?(?:{PATTERNS['email']})|\p{{L}}{{{SHORTEST},}}+", TERM, None)
    words = F.filter(found, lambda t: ~F.contains(t["value"], F.lit("@")))
    return F.transform(words, lambda t: F.struct(F.lower(t["value"]).alias("term"), t["start"].alias("start"), t["end"].alias("end")))


def _discloses(together: Column, of_term: Column, of_entity: Column, n: int) -> Column:
    """Whether a term tells enough of an entity. For one term and entity the more, the more texts hold both."""
    told = F.log2((together - DISCOUNT) * F.lit(float(n)) / (of_term * of_entity))
    content = -F.log2(of_entity / F.lit(float(max(n, 1))))
    return (content > 0) & (told * ALPHA >= content)


def _frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, of_term): the number of distinct texts that hold a word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(text.alias("text"), F.xxhash64(text).alias("hash")).dropDuplicates(["hash"])
    # Words are lower-cased one by one, as those beside a mention are: a text as a whole may give other letters.
    words = texts.select(F.explode(F.array_distinct(F.transform(F.split("text", r"[^\p{L}]+"), F.lower))).alias("term"))
    # Counted before they are joined, so that a frequent word is one row a task.
    return words.groupBy("term").agg(F.count("*").alias("of_term"))


def _disclosing(found: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(entity, term) where the term discloses the entity. found: hash, base and terms of every document. All counts are of distinct texts."""
    n = found.select("hash").distinct().count()
    found = found.filter("size(base) > 0")
    entities = found.select(F.explode(F.transform("base", _entity)).alias("entity"), "hash").groupBy("entity").agg(F.countDistinct("hash").alias("of_entity"))
    pairs = found.select(F.explode("terms").alias("t"), "hash").groupBy("t.entity", "t.term").agg(F.countDistinct("hash").alias("together"))
    pairs = materialize(pairs, "pairs")
    scored = pairs.join(_frequencies(docs, text_col), "term").join(entities, "entity")
    return materialize(scored.filter(_discloses(F.col("together"), F.col("of_term"), F.col("of_entity"), n)).select("entity", "term"), "disclosing")


def _marks_near(found: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(rid, start, end) of the terms within reach of a mention that disclose it."""
    bad = _disclosing(found, docs, text_col)
    return found.filter("size(base) > 0").select("rid", F.explode("terms").alias("t")).select("rid", "t.*").join(bad, ["entity", "term"]).select("rid", "start", "end").distinct()


def _marks_anywhere(found: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(rid, start, end) of the terms that disclose an entity mentioned anywhere in their text. All counts are of distinct texts.

    Entities with the same texts are one: ``texts`` tells the sets apart. What the rarest entity of a text decides for a
    term that no other text need hold with it (``sure``) is not paired; nor is what no number of common texts could decide.
    """
    n = found.select("hash").distinct().count()
    some = found.filter("size(base) > 0")
    held = some.select("hash", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity")).distinct()
    sets = held.groupBy("entity").agg(F.count("*").alias("of_entity"), F.struct(F.bit_xor("hash"), F.bit_xor(F.xxhash64("hash"))).alias("texts"))
    held = materialize(held.join(sets, "entity").select("hash", "of_entity", "texts").distinct(), "held")
    most = held.agg(F.max("of_entity")).first()[0] or 1
    # Of all entities, one in as many texts as the term would be told most by it.
    best = F.least("of_term", F.lit(most))
    counts = materialize(_frequencies(docs, text_col).withColumn("may", _discloses(best, F.col("of_term"), best, n)), "counts")
    hot = counts.filter("not may and length(term) < 64").orderBy(F.desc("of_term")).limit(HOT).select("term")
    words = some.select("rid", "hash", F.explode("terms").alias("t")).select("rid", "hash", "t.*").join(F.broadcast(hot), "term", "left_anti")
    rarest = held.groupBy("hash").agg(F.min("of_entity").alias("rarest"))
    said = words.select("hash", "term").distinct().join(counts.filter("may").drop("may"), "term").join(rarest, "hash")
    said = materialize(said.select("hash", "term", "of_term", _discloses(F.lit(1), F.col("of_term"), F.col("rarest"), n).alias("sure")), "said")
    judged = lambda together: _discloses(together, F.col("of_term"), F.col("of_entity"), n)
    pairs = said.join(held.filter("of_entity > 1"), "hash").filter(judged(F.least("of_term", "of_entity")) & ~judged(F.lit(1)))
    pairs = materialize(pairs.select("hash", "texts", "of_entity", "term", "of_term"), "pairs")
    bad = pairs.groupBy("texts", "of_entity", "term", "of_term").agg(F.count("*").alias("together")).filter(judged(F.col("together")))
    bad = pairs.join(bad, ["texts", "of_entity", "term"], "left_semi").select("hash", "term")
    bad = materialize(said.filter("sure").select("hash", "term").unionByName(bad).distinct(), "disclosing")
    return words.join(bad, ["hash", "term"]).select("rid", "start", "end")


def find(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, spans_col: str = "pii_spans", reach: int | None = REACH) -> DataFrame:
    """The columns ``keep`` of docs (all by default) with ``spans_col``: base spans, then disclosing terms, each by
    start, as an array of kind, start, end. Terms are looked for within ``reach`` of a mention; None: in the whole text."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != spans_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("row"), text.alias("text")).withColumn("hash", F.xxhash64("text")).withColumn("near", base_spans(F.col("text"), reach))
    plain = F.transform("near", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    terms = _all_words(F.col("text")) if reach is None else _terms(F.col("near"))
    rows = rows.select("row", "hash", plain.alias("base"), F.when(F.size("near") > 0, terms).otherwise(F.array()).alias("terms"))
    found = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "found")
    marks = (_marks_anywhere if reach is None else _marks_near)(found.select("rid", "hash", "base", "terms"), docs, text_col)
    marks = marks.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("marks"))
    span = lambda kind, s: F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    joined = found.join(materialize(marks, "marks"), "rid", "left")
    extra = F.coalesce(F.transform("marks", lambda s: span(F.lit(TERM), s)), F.array())
    return joined.select("row.*", F.concat(F.transform("base", lambda s: span(s["kind"], s)), extra).alias(spans_col))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """text with each span generalised to its kind in brackets; of spans that overlap, what the first has left of the others goes too."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cut(parts: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int"))
        some = lambda k: F.slice(parts, k * CHUNK + 1, F.lit(CHUNK))
        ends = F.transform(chunks, lambda k: F.aggregate(some(k), F.lit(0), lambda a, x: F.greatest(a, x["end"])))
        upto = lambda ends, k: F.coalesce(F.array_max(F.slice(ends, F.lit(1), k)), F.lit(0))

        def chunk(k: Column, ends: Column) -> Column:
            """The text from where the chunks before end to where this one does."""
            inside = F.struct(upto(ends, k).alias("low"), F.substring(text, upto(ends, k) + 1, upto(ends, k + 1) - upto(ends, k)).alias("text"))
            return _let(inside, lambda own: F.aggregate(some(k), F.struct(own["low"].alias("at"), F.lit("").alias("out")), lambda done, s: step(done, s, own), lambda done: done["out"]))

        def step(done: Column, s: Column, own: Column) -> Column:
            fresh = s["start"] >= done["at"]
            more = F.when(fresh, F.concat(F.substring(own["text"], done["at"] - own["low"] + 1, s["start"] - done["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
            return F.struct(F.greatest(s["end"], done["at"]).alias("at"), F.concat(done["out"], more).alias("out"))

        whole = lambda ends: F.concat(F.array_join(F.transform(chunks, lambda k: chunk(k, ends)), ""), F.substring(text, F.array_max(ends) + 1, F.char_length(text)))
        return _let(ends, whole)

    return F.when(F.size(spans) > 0, _let(ordered, cut)).otherwise(text)
