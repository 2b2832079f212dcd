import hashlib

import numpy as np
import pytest

from tidemark.llm import sketches


def shingles(raw):
    whole = bytes(sketches.WIDTH - 1) + raw
    return {whole[i : i + sketches.WIDTH] for i in range(len(raw))}


def test_estimates():
    rng = np.random.default_rng(2)
    a = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))
    b = a[:15_000] + bytes(rng.integers(97, 123, 9_000, dtype=np.uint8))
    x, y = sketches.sketch(a), sketches.sketch(b)
    sa, sb = shingles(a), shingles(b)
    assert sketches.resemblance(x, y) == pytest.approx(len(sa & sb) / len(sa | sb), abs=0.13)
    assert sketches.containment(x, y) == pytest.approx(len(sa & sb) / len(sa), abs=0.2)
    assert sketches.distinct(x) == pytest.approx(len(sa), rel=0.3)
    assert sketches.resemblance(x, x) == 1 and (sketches.from_text(sketches.to_text(x)) == x).all()


def test_parts_merge_and_chunks_do_not_show(monkeypatch):
    raw = bytes(np.random.default_rng(4).integers(97, 100, 5_000, dtype=np.uint8)) * 3
    whole = sketches.sketch(raw)
    parts = [sketches.sketch(raw[:700]), sketches.sketch(raw[700:], raw[700 - sketches.WIDTH + 1 : 700])]
    assert (sketches.merge(*parts) == whole).all()
    monkeypatch.setattr(sketches, "CHUNK", 1000)
    assert (sketches.sketch(raw) == whole).all()
    short = b"ab" * 40
    assert len(sketches.sketch(short)) == len(shingles(short)) == sketches.distinct(sketches.sketch(short))


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1] or ""
        text = text or ""
        edit = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, part, follow = (shingles(x.encode()) for x in (text, edit, after))
        like = lambda p, q: len(p & q) / len(p | q) if p and q else float(len(p) == len(q))
        out.append((i, len(text), hashlib.sha256(edit.encode()).hexdigest(), like(own, part), like(own, follow)))
    return out


@pytest.mark.parametrize("n", [1, 2, 57])
def test_edits(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), None if i % 11 == 5 else "".join(rng.choice(list("aé漢 b"), rng.integers(0, 30)))) for i in rng.choice(1000, n, replace=False) - 300]
    got = sketches.edited_fingerprints(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, range string").repartition(3)).collect()
    want = sorted(expected(rows))
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3:] for g in got] == [pytest.approx(w[3:]) for w in want]


def test_edges(spark):
    assert sketches.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (None, None), (5, "a")]
    got = sketches.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 7 and len({r.fingerprint for r in got if r.n_chars}) == 3
