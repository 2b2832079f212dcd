import hashlib
import pathlib
import re
import sys
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import recompression as rc


def brute(rows):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[p : p + rc.WINDOW]) for _, w in words for p in range(len(w) - rc.WINDOW + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - rc.WINDOW + 1):
            if seen[tuple(w[p : p + rc.WINDOW])] > 1:
                gone[p : p + rc.WINDOW] = [True] * rc.WINDOW
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}é" for i in range(60)]
    make = lambda n: [str(x) for x in rng.choice(vocabulary, n)]
    passages = [make(n) for n in (34, 35, 36, 60, 120)]
    rows = []
    for i in range(60):
        text = make(int(rng.integers(0, 90)))
        for _ in range(int(rng.integers(0, 3))):
            p = passages[int(rng.integers(0, len(passages)))]
            a, b = sorted(rng.integers(0, len(p) + 1, 2).tolist()) if rng.random() < 0.4 else (0, len(p))
            at = int(rng.integers(0, len(text) + 1))
            text[at:at] = p[a:b]
        rows.append((i, " ".join(text)))
    rows += [(100, "same " * 36), (101, "same " * 50), (102, "same " * 35), (103, "a b c d e " * 8), (104, "x a b c d e " + "a b c d e " * 20), (105, " ".join(make(200)))]
    rows += [(106, rows[5][1]), (107, rows[-1][1]), (107, rows[-1][1]), (108, rows[-1][1].replace(" ", "\n")), (109, None), (110, ""), (None, "z " + rows[-1][1]), (111, "q\x1cr " * 20)]
    return rows


def test_contexts_decide_symbols():
    """What a window shares with another place in another text, both parse alike."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        passage = rng.integers(0, 5, 50)
        one, two = (np.concatenate([rng.integers(0, 5, rng.integers(0, 40)), passage, rng.integers(0, 5, rng.integers(0, 40))]) for _ in range(2))
        found = []
        for x in (one, two):
            at = next(i for i in range(len(x)) if (x[i : i + 50] == passage).all())
            s, low, high = rc.anchors(rc.mix(x.astype(np.uint64)), np.array([len(x)]))[0]
            inside = (low >= at) & (high < at + 50)
            found.append(set(zip(s[inside].tolist(), (low[inside] - at).tolist(), (high[inside] - at).tolist())))
        assert found[0] == found[1]


def test_texts_together_parse_as_alone():
    rng = np.random.default_rng(6)
    texts = [rc.mix(rng.integers(0, 9, n).astype(np.uint64)) for n in (0, 50, 1, 0, 80, 35, 0)]
    together = rc.anchors(np.concatenate(texts), np.cumsum([len(t) for t in texts]))
    for t, got in zip(texts, together):
        alone = rc.anchors(t, np.array([len(t)]))[0]
        assert all((a == b).all() for a, b in zip(got, alone))


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, words int").repartition(4)
    got = rc.remove_repeats(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute(rows)


def test_empty(spark):
    assert rc.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_workers_give_back_what_they_have_freed(spark, monkeypatch):
    """Idle workers stand beside the JVM of the stages that follow: what no task uses any more is not theirs."""
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i, 100 + i))) for i in range(3)], "doc_id long, text string")
    steps, kind = [], type(docs)
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, step, *a, **b: steps.append(step) or real(self, step, *a, **b))
    assert {r.n_removed for r in rc.remove_repeats(docs).collect()} == {99, 100}
    assert len(steps) == 3
    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", pathlib.Path("/proc/self/status").read_text())[1]) / 1024
    for step in steps:
        before = held()
        blocks = [bytes(2000) for _ in range(100_000)]
        pins = blocks[::1000]
        del blocks
        assert held() > before + 100
        assert not list(step(iter([])))
        assert held() < before + 50 and len(pins) == 100
