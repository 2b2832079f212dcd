import math
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{s}:{e}" for k, s, e in out)


def test_base_spans_match_brute_force(spark):
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "@x.y", "é", "漢", "😀", " ", "-", ".", "+", "_", "(", ")", "1", "23", "255", "256", "0007", "1.2.3.4", "999.1.2.3.4.5.6.7", "4111 1111 1111 1111", "4111111111111111", "+1 (017) 555-7713", "me.55@mail4.example.com", "\n", "\t", "12345678"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += [None, "", "a@b.c_d@e.f", "a@b.c@d.e", "x" * 50_000 + "@" + "a." * 20_000 + "b", "1" * 60_000, "1 " * 30_000, "1-" * 8 + "1", "+" + "1 " * 20_000, "1." * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.s for r in df.select("doc_id", pii.as_text(pii.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), repr(t)[:200]


def test_disclosing_terms(spark):
    rng = random.Random(3)
    filler = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    say = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(i, say(30), "x") for i in range(200)]
    rows += [(300 + i, f"{say(10)} Zanzibar consul jo@x.org {say(10)}", "x") for i in range(4)]
    rows += [(400 + i, f"{say(20)} Zanzibar far away", "x") for i in range(1)]
    rows += [(500, "copy Quokka al@x.org", "x")] * 5 + [(None, None, "x"), (7, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_note string").repartition(3)
    found = pii.find(df)
    assert found.columns == ["doc_id", "text", "pii_note", "pii_spans"] and found.count() == len(rows)
    clean = {(r.doc_id, r.t) for r in found.select("doc_id", pii.sanitised(F.coalesce("text", F.lit("")), F.col("pii_spans")).alias("t")).collect()}
    for i in range(300, 304):
        text = next(t for j, t in clean if j == i)
        assert "[TERM] [TERM] [EMAIL]" in text and "Zanzibar" not in text
    assert (500, "[TERM] [TERM] [EMAIL]") in clean
    assert any(i == 400 and "Zanzibar" in t for i, t in clean)  # far from any mention
    plain = {i: t for i, t, _ in rows if i is not None and i < 200}
    assert all(plain[i] == t for i, t in clean if i in plain and i != 7)


def test_disclosing_term_in_copies(spark):
    letters = "abcdefghij"
    rows = [(i, f"plain words {letters[i % 10] * 4}{letters[i // 10 % 10]}{letters[i // 100]}") for i in range(300)]
    rows += [(400 + i, f"nr {i} Zanzibar jo@x.org") for i in range(3)] + [(1000 + i, "nr 0 Zanzibar jo@x.org") for i in range(1000)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    marked = found.filter(F.exists("pii_spans", lambda s: s["kind"] == pii.TERM))
    assert marked.count() == 1003


def mentions(text):
    """Base spans with the words near them, worked out as the docstring says."""
    found = []
    for kind, regex in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        all_of = [m for m in regex.finditer(text) if kind != "card" or 16 <= len(digits(m[0])) <= 19]
        for k, m in enumerate(all_of):
            if f"{kind}:{m.start()}:{m.end()}" not in brute(text).split(","):
                continue
            low = all_of[k - 1].end() if k else 0
            high = all_of[k + 1].start() if k + 1 < len(all_of) else len(text)
            left, right = text[max(low, m.start() - 64) : m.start()], text[m.end() : min(high, m.end() + 64)]
            if m.start() - low > 64:
                left = re.sub(r"^\S+", "", left)
            if high - m.end() > 64:
                right = re.sub(r"\S+$", "", right)
            words = []
            for side, base in ((left, m.start() - len(left)), (right, m.end())):
                words += [(w[0].lower(), base + w.start(), base + w.end()) for w in re.finditer(EMAIL.pattern + r"|[^\W\d_]{4,}", side) if "@" not in w[0]]
            entity = kind + ":" + ("".join(map(str, digits(m[0]))) if kind in ("card", "phone") else m[0].lower())
            found.append((entity, words))
    return found


def brute_terms(texts):
    """The spans of disclosing terms of every text."""
    distinct = set(texts)
    n = len(distinct)
    of_entity, of_term, together = {}, {}, {}
    for t in distinct:
        for w in set(re.findall(r"[^\W\d_]+", t.lower())):
            of_term[w] = of_term.get(w, 0) + 1
        near = mentions(t)
        for e in {e for e, _ in near}:
            of_entity[e] = of_entity.get(e, 0) + 1
        for pair in {(e, w) for e, words in near for w, _, _ in words}:
            together[pair] = together.get(pair, 0) + 1
    told = lambda e, w: math.log2((together[e, w] - 0.5) * n / (of_entity[e] * of_term[w]))
    content = lambda e: -math.log2(of_entity[e] / n)
    bad = {(e, w) for e, w in together if content(e) > 0 and told(e, w) * 1.25 >= content(e)}
    return [sorted({(a, z) for e, words in mentions(t) for w, a, z in words if (e, w) in bad}) for t in texts]


def test_term_spans_match_brute_force(spark):
    rng = random.Random(5)
    filler = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)]
    rare = [f"rare{'abcdefghij'[i % 10] * 2}{'klmnopqrst'[i // 10]}" for i in range(60)]
    things = ["jo@x.org", "Al.B@mail.example.com", "10.0.0.7", "999.1.1.1", "4111 1111 1111 1111", "+1 (017) 555-7713", "é漢😀", "sub.al@y.net,next"]
    texts = [" ".join(rng.choice(rng.choices([filler, rare, things], [80, 4, 6])[0]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += texts[:5] * 40 + [f"the only copy of zebraword near q{i}@z.org" for i in range(2)]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.pii_spans if s["kind"] == pii.TERM] for r in found.collect()}
    want = brute_terms(texts)
    assert sum(map(len, want)) > 200
    for i, t in enumerate(texts):
        assert got[i] == want[i], t


def brute_terms_anywhere(texts):
    """The spans of disclosing terms of every text, looked for in whole texts."""
    distinct = set(texts)
    n = len(distinct)
    words = lambda t: [(m[0].lower(), m.start(), m.end()) for m in re.finditer(EMAIL.pattern + r"|[^\W\d_]{4,}", t) if "@" not in m[0]]
    entities = {t: {e for e, _ in mentions(t)} for t in distinct}
    of_entity, of_term, together = {}, {}, {}
    for t in distinct:
        for w in set(re.findall(r"[^\W\d_]+", t.lower())):
            of_term[w] = of_term.get(w, 0) + 1
        for e in entities[t]:
            of_entity[e] = of_entity.get(e, 0) + 1
            for w in {w for w, _, _ in words(t)}:
                together[e, w] = together.get((e, w), 0) + 1
    content = lambda e: -math.log2(of_entity[e] / n)
    told = lambda e, w: math.log2((together[e, w] - 0.5) * n / (of_entity[e] * of_term[w]))
    bad = lambda e, w: content(e) > 0 and told(e, w) * 1.25 >= content(e)
    return [[(a, z) for w, a, z in words(t) if any(bad(e, w) for e in entities[t])] for t in texts]


def test_terms_of_whole_texts_match_brute_force(spark):
    rng = random.Random(7)
    filler = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)]
    rare = [f"rare{'abcdefghij'[i % 10] * 2}{'klmnopqrst'[i // 10]}" for i in range(80)]
    people = [(f"jo{i}@x.org", f"tell{'abcdefghij'[i] * 2}") for i in range(10)]
    things = ["Al.B@mail.example.com", "10.0.0.7", "999.1.1.1", "4111 1111 1111 1111", "+1 (017) 555-7713", "é漢😀", "sub.al@y.net,next"]
    texts = [" ".join(rng.choice(rng.choices([filler, rare, things], [200, 5, 1])[0]) for _ in range(rng.randint(1, 150))) for _ in range(400)]
    for i, (mail, term) in enumerate(people):  # a term far from what it tells, or between two matches of a kind
        for _ in range(i // 2 + 1):
            texts.append(f"{term} {' '.join(rng.choices(filler, k=40))} {mail} {rng.choice(people)[0]} {' '.join(rng.choices(filler, k=40))} {term.upper()}")
    texts += texts[:5] * 40 + texts[-1:] * 30 + [f"the only copy of zebraword {' '.join(filler)} q{i}@z.org" for i in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    terms = lambda found: {r.doc_id: [(s["start"], s["end"]) for s in r.pii_spans if s["kind"] == pii.TERM] for r in found.collect()}
    got, want = terms(pii.find(docs, reach=None)), brute_terms_anywhere(texts)
    assert sum(map(len, want)) > 100
    for i, t in enumerate(texts):
        assert got[i] == want[i], t


def test_terms_far_from_a_mention(spark):
    rows = [(i, f"plain words {'abcdefghij'[i % 10] * 4}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100]}") for i in range(300)]
    far = "plain words " * 100
    rows += [(400 + i, f"nr {i} Zanzibar consul {far} jo@x.org {far} Quokka") for i in range(3)] + [(500, f"Okapi {far}"), (501, f"Okapi {far} al@x.org {far} Éabcd@x.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clean = {r.doc_id: r.t for r in pii.find(docs, reach=None).select("doc_id", pii.sanitised(F.col("text"), F.col("pii_spans")).alias("t")).collect()}
    for i in range(3):
        assert clean[400 + i] == f"nr {i} [TERM] [TERM] {far} [EMAIL] {far} [TERM]"
    assert clean[500] == f"Okapi {far}"  # mentions nothing
    assert clean[501].startswith("Okapi") and clean[501].endswith("É[EMAIL]")  # half of two texts tells too little


def test_query_looks_at_whole_texts(spark, tmp_path):
    far = "plain words " * 100
    rows = [(i, f"{far} {'abcdefghij'[i % 10] * 4}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100]}") for i in range(300)]
    rows += [(400 + i, f"\u0130stanbul {far} jo@x.org {far} \u03a3\u0391\u03a3'\u0391\u039d\u0391\u03a3\u0391 Quokka") for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.spans for r in queries.op9_pii(spark, str(tmp_path)).collect()}
    for i, text in rows:
        places = [("email", "jo@x.org"), ("term", "\u0130stanbul"), ("term", "\u0391\u039d\u0391\u03a3\u0391"), ("term", "Quokka")] if i >= 400 else []
        assert got[i] == ",".join(f"{k}:{text.index(v)}:{text.index(v) + len(v)}" for k, v in places)


def test_many_entities_and_terms_of_one_text(spark):
    name = lambda i: "name" + "".join("abcdefghij"[int(c)] for c in f"{i:05d}")
    text = " ".join(f"{name(i)} u{i}@host.org" for i in range(20_000))
    rows = [(0, text)] + [(1 + i, f"nr {i} plain {'abcdefghij'[i % 10] * 4}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100]}") for i in range(1000)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), reach=None)
    sizes = {r.doc_id: r.n for r in found.select("doc_id", F.size("pii_spans").alias("n")).collect()}
    assert sizes.pop(0) == 40_000 and set(sizes.values()) == {0}


def test_text_of_many_addresses(spark):
    text = " ".join(f"name{i} u{i}@host{i % 7}.org" for i in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, "plain"), (3, "mail jo@x.org")], "doc_id long, text string")
    found = pii.find(docs).withColumn("clean", pii.sanitised(F.col("text"), F.col("pii_spans")))
    rows = {r.doc_id: r for r in found.select("doc_id", F.size("pii_spans").alias("n"), F.get("pii_spans", F.lit(99_999)).alias("last"), "clean").collect()}
    assert rows[1].n >= 100_000 and rows[1].clean.count("[EMAIL]") == 100_000 and text[rows[1].last.start : rows[1].last.end] == f"u99999@host{99_999 % 7}.org"
    assert rows[2].clean == "plain"


def test_clashing_column(spark):
    docs = spark.createDataFrame([(1, "mail jo@x.org", "a", "b", 5)], "doc_id long, text string, pii_spans string, row string, hash int")
    found = pii.find(docs)
    assert found.columns == ["doc_id", "text", "row", "hash", "pii_spans"] and found.first().pii_spans[0]["kind"] == "email"
    assert pii.find(docs, spans_col="pii_spans_").columns == [*docs.columns, "pii_spans_"]


def test_empty(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
