import numpy as np
import xxhash

from tidemark.llm import simhash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    root = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_fingerprint():
    for text in [None, "", " \t", "One", "a b", "a b c", "The THE the the the", "É b\x0bc d\x1ce f a b c", "x y z " * 50]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_long_text_counts_all(monkeypatch):
    text = " ".join(str(i % 97) for i in range(1000))
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_classes_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    fps = []
    for c in rng.integers(0, 1 << 64, 12, dtype=np.uint64).tolist():
        for _ in range(12):
            fps.append(c)
            for b in rng.integers(0, 64, rng.integers(0, 3)).tolist():
                c ^= 1 << b
    expected = brute_classes(fps)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    for block in (256, 2):  # 2: nearly all goes the way of large blocks
        monkeypatch.setattr(simhash, "BLOCK", block)
        out = simhash.classes(spark.createDataFrame(rows, "doc_id long, fp long")).toPandas().sort_values("doc_id")
        assert out.component_id.tolist() == expected


def test_edges(spark):
    docs = spark.createDataFrame([(3, None, "a"), (2, "", "b"), (7, "same words here again", "c"), (7, "same words here again", "c"), (None, "same words here again", "d")], "doc_id long, text string, fp string")
    out = simhash.near_duplicates(docs).toPandas()
    assert len(out) == 5
    assert set(out[out.doc_id.isin([2, 3])].component_id) == {2}
    assert set(out[~out.doc_id.isin([2, 3])].component_id) == {7}
    assert simhash.near_duplicates(docs.filter("doc_id > 100")).count() == 0
