"""The contracts of the registered queries, on a small folder of tables, against brute force or the tokenizers library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import queries, sketches
from tidemark.llm.sketches import resemblance

EN = "the house and the garden were quiet when the morning came with rain over the fields and hills".split()
DE = "das haus und der garten waren still als der morgen kam mit regen über den feldern und hügeln".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rng = np.random.default_rng(31)
    docs = []
    for i in range(60):
        words = rng.choice(DE if i % 3 == 0 else EN, int(rng.integers(5, 80))).tolist()
        if i % 4 == 1:
            words[2] = "grumbleton"
        docs.append((i, " ".join(words), "de" if i % 3 == 0 else "en", "s", 0, "x"))
    passage = " ".join(f"p{k}" for k in range(50))
    docs += [(100, f"one {passage} two", "en", "s", 0, "x"), (101, f"three {passage} four", "en", "s", 0, "x"), (102, "mail jo@x.org or +1 (017) 555-7713, 10.0.0.7", None, None, None, None)]
    docs += [(103, None, "en", "s", 0, "x"), (104, "", "en", "s", 0, "x"), (105, docs[0][1], "de", "s", 0, "x"), (106, "1234 !?", "en", "s", 0, "x")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(320)] + [(400, None), (500, [0.0] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    pages = [(i, f"http://x.org/{i}", "<p>" + "WARC/1.1\r\n" * (i % 3) + "y" * (i % 5) * 400) for i in range(20)] + [(50, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(f"{folder}/pages.parquet")
    return str(folder), {i: t for i, t, *_ in docs}, dict(vectors), {i: h for i, _, h in pages}


def run(spark, tables, name, kinds):
    df = queries.QUERIES[name](spark, tables[0])
    have = dict(df.dtypes)
    assert {c: have.get(c) for c in kinds} == kinds
    return df.collect()


def remainder(doc, n):
    return zlib.crc32(str(doc).encode()) % n


def test_op1(spark, tables):
    rows = run(spark, tables, "op1_packing", dict.fromkeys(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "bigint"))
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in tables[1].items()}
    assert {r.doc_id for r in rows} == set(ids) and sum(r.length for r in rows) == sum(map(len, ids.values()))
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) for r in rows)


def test_op2(spark, tables):
    rows = run(spark, tables, "op2_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert sorted(r.doc_id for r in rows) == sorted(tables[1])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (remainder(r.doc_id, 5) == 0) for r in rows)
    assert all(r.predicted == ("grumbleton" in (tables[1][r.doc_id] or "")) for r in rows)


def test_op3(spark, tables):
    rows = run(spark, tables, "op3_neighbours", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"})
    vectors = {i: np.array(v) for i, v in tables[2].items() if v and any(v)}
    want = {}
    for q in vectors:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(np.add.accumulate((v - vectors[q]) ** 2)[-1])), i) for i, v in vectors.items() if i != q)[:10]
            want |= {(q, k): (i, d) for k, (d, i) in enumerate(near, 1)}
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in rows} == want


def test_op4(spark, tables):
    rows = run(spark, tables, "op4_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows:
        ids = whole.encode(tables[1][r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op5(spark, tables):
    rows = run(spark, tables, "op5_langid", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    pred = {r.doc_id: r.lang_pred for r in rows}
    assert sorted(pred) == sorted(tables[1]) and all(0 <= r.score <= 1 and r.held_out == (remainder(r.doc_id, 4) == 2) for r in rows)
    assert all(pred[i] == ("de" if i % 3 == 0 else "en") for i in range(60)) and [pred[i] for i in (103, 104, 106)] == ["und"] * 3


def test_op6(spark, tables):
    rows = run(spark, tables, "op6_warc", {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"})
    body = {i: (h or "").encode() for i, h in tables[3].items()}
    last = {b: i for i, b in sorted(body.items()) if len(b) >= 1000}
    want = {(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if last.get(b, i) != i else "response", last[b] if last.get(b, i) != i else None) for i, b in body.items()}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_op7(spark, tables):
    from tidemark.llm.simhash import fingerprint

    rows = run(spark, tables, "op7_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    fp = {i: fingerprint(t) for i, t in tables[1].items()}
    root = {i: i for i in fp}
    for i in sorted(fp):
        for j in sorted(fp):
            if (fp[i] ^ fp[j]).bit_count() <= 2 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{fp[i]:016x}", root[i]) for i in fp}


def test_op8(spark, tables):
    rows = run(spark, tables, "op8_sketches", {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"})
    order = sorted(tables[1], reverse=True)
    for r in rows:
        text, after = (tables[1][i] or "" for i in (r.doc_id, order[(order.index(r.doc_id) + 1) % len(order)]))
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        own, other, near = (sketches.sketch(x.encode()) for x in (text, edit, after))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (sketches.to_text(own), sketches.to_text(other), resemblance(own, other), resemblance(own, near))
    assert len(rows) == len(order)


def test_op9(spark, tables):
    rows = run(spark, tables, "op9_pii", {"doc_id": "bigint", **dict.fromkeys(["n_email", "n_ip", "n_card", "n_phone"], "bigint"), "base_sha256": "string", "spans": "string"})
    assert len(rows) == len(tables[1])
    r = {r.doc_id: r for r in rows}[102]
    text = tables[1][102]
    spans = [(k, text.index(v), text.index(v) + len(v)) for k, v in (("email", "jo@x.org"), ("ip", "10.0.0.7"), ("phone", "+1 (017) 555-7713"))]
    joined = ",".join(f"{k}:{a}:{z}" for k, a, z in spans)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (1, 1, 0, 1, hashlib.sha256(joined.encode()).hexdigest()) and r.spans.startswith(joined)


def test_op10(spark, tables):
    rows = run(spark, tables, "op10_recompression", {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"})
    words = {i: (t or "").split() for i, t in tables[1].items()}
    seen = {}
    for i, w in words.items():
        for a in range(len(w) - 34):
            seen.setdefault(tuple(w[a : a + 35]), []).append((i, a))
    gone = {(i, k) for places in seen.values() if len(places) > 1 for i, a in places for k in range(a, a + 35)}
    for r in rows:
        kept = " ".join(x for k, x in enumerate(words[r.doc_id]) if (r.doc_id, k) not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words[r.doc_id]), sum(i == r.doc_id for i, _ in gone), hashlib.sha256(kept.encode()).hexdigest())
    assert len(rows) == len(words)
