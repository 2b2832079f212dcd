import numpy as np

import corpus_pipeline
from tidemark.llm import simhash


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_copies(rng, vocabulary):
    make = lambda n: [str(x) for x in rng.choice(vocabulary, n)]
    rows, groups = [], []
    for g in range(12):
        base = make(int(rng.integers(120, 400)))
        ids = []
        for c in range(6):
            text = list(base)
            for _ in range(c // 2):
                text[int(rng.integers(0, len(text)))] = "edited"
            ids.append(g * 100 + c)
            rows.append((ids[-1], " ".join(text)))
        groups.append(ids)
    for i in range(40):
        rows.append((5000 + i, " ".join(make(60))))
        groups.append([5000 + i])
    return rows, groups


def test_one_of_each_group_stays(spark):
    rng = np.random.default_rng(8)
    rows, groups = near_copies(rng, [f"w{i}" for i in range(400)])
    rows += [(9000, None), (9001, ""), (9002, " \n"), (7777, rows[0][1]), (7777, rows[0][1]), (None, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = simhash.drop_similar(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert ids == sorted([g[0] for g in groups] + [9000])
    text = dict((i, t) for i, t in rows)
    for g in groups:
        for i in g[1:]:
            a, b = shingles(text[g[0]]), shingles(text[i])
            assert len(a & b) / len(a | b) >= 0.75


def test_large_blocks_are_dealt(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows, groups = near_copies(rng, [f"w{i}" for i in range(300)])
    monkeypatch.setattr(simhash, "MEMBERS", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_similar(docs).collect()) == sorted(g[0] for g in groups)


def edited(rng, text, edits):
    """text with edits of its words, each in shingles of its own."""
    text = list(text)
    for at in (rng.choice(len(text) // 10, edits, replace=False) * 10 + 5).tolist():
        text[at] = f"e{rng.integers(1 << 60)}"
    return text


def least_of_groups(rows):
    """The least id of every component of texts of similarity 0.8, all pairs compared."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for r, (i, _) in zip(root, rows):
        least[r] = min(i, least.get(r, i))
    return sorted(least.values())


def test_stars_and_chains_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = []
    for g in range(8):
        star = [f"w{x}" for x in rng.integers(0, 1 << 40, 100)]
        rows += [(g * 100 + c, " ".join(edited(rng, star, 2))) for c in range(14)] + [(g * 100 + 99, " ".join(star))]
        chain = [f"w{x}" for x in rng.integers(0, 1 << 40, 100)]
        for c in range(14):
            rows.append((10_000 + g * 100 + c, " ".join(chain)))
            chain = edited(rng, chain, 2)
    expected = least_of_groups(rows)
    assert len(expected) == 16
    monkeypatch.setattr(simhash, "MEMBERS", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.drop_similar(docs).collect()) == expected
    monkeypatch.setattr(simhash, "MEMBERS", 8000)
    monkeypatch.setattr(simhash, "SHINGLES", 300, raising=False)
    assert sorted(r.doc_id for r in simhash.drop_similar(docs).collect()) == expected


def test_stage_links_by_fingerprints_too(spark, monkeypatch):
    rng = np.random.default_rng(16)
    rows = []
    bits = lambda a, b: (simhash.fingerprint(" ".join(a)) ^ simhash.fingerprint(" ".join(b))).bit_count()
    for g in range(6):
        near = None
        while near is None or bits(text, near) > 2:
            text = [f"w{x}" for x in rng.integers(0, 1 << 40, 400)]
            near = edited(rng, text, 9)  # 0.796 alike
        far = next(x for x in iter(lambda: edited(rng, text, 9), None) if bits(text, x) > 2)
        rows += [(g * 10 + c, " ".join(x)) for c, x in enumerate((text, near, edited(rng, near, 6), far))]
    sets, prints, root = [shingles(t) for _, t in rows], [simhash.fingerprint(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    expected = sorted({rows[r][0] for r in root})
    assert expected == sorted([g * 10 for g in range(6)] + [g * 10 + 3 for g in range(6)]) and len(least_of_groups(rows)) == 18
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for members in (simhash.MEMBERS, 2):
        monkeypatch.setattr(simhash, "MEMBERS", members)
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == expected


def test_repeated_lines_do_not_part_near_copies(spark):
    rng = np.random.default_rng(13)
    rows = []
    for g in range(40):
        text, line = ([f"w{x}" for x in rng.integers(0, 1 << 40, n)] for n in (100, 8))
        rows += [(g * 10, " ".join(text + line * 2)), (g * 10 + 1, " ".join(edited(rng, text, 1) + line * 60))]
    expected = least_of_groups(rows)
    assert len(expected) == 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.drop_similar(docs).collect()) == expected


def test_long_texts_at_the_threshold(spark):
    rng = np.random.default_rng(14)
    rows = []
    for g in range(80):
        text = [f"w{x}" for x in rng.integers(0, 1 << 40, 600)]
        rows += [(g * 10, " ".join(text)), (g * 10 + 1, " ".join(edited(rng, text, 13 + g % 2)))]  # 0.803 or 0.790
    expected = least_of_groups(rows)
    assert len(expected) == 80 + 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.drop_similar(docs).collect()) == expected


def test_similar_sets_match_brute_force():
    rng = np.random.default_rng(15)
    for n, alphabet in ((1, 5), (30, 12), (120, 40), (60, 400)):
        sets = [np.unique(rng.integers(0, alphabet, rng.integers(1, 40)).astype(np.uint64)) for _ in range(n)]
        sets += [np.union1d(x[: len(x) - len(x) // 6], rng.integers(0, 1 << 60, len(x) // 9).astype(np.uint64)) for x in sets]
        groups = lambda pairs: brute_groups(len(sets), pairs)
        true = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
        got = simhash.similar(sets)
        assert set(got) <= set(true) and groups(got) == groups(true)
        known = [(i, 0) for i in range(n // 3)]  # as if these were connected already
        assert groups(known + simhash.similar(sets, n // 3)) == groups(known + [p for p in true if max(p) >= n // 3])


def brute_groups(n, pairs):
    root = list(range(n))
    for i, j in pairs:
        root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return root


def test_pipeline_runs_on_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(10)
    vocabulary = [f"word{i}" for i in range(500)]
    make = lambda n: " ".join(str(x) for x in rng.choice(vocabulary, n))
    passage = make(60)
    rows = [(i, make(80), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, f"you grumbleton {make(60)} nitwitted {make(10)}", "en", "s", 0) for i in range(30)]
    rows += [(200, f"{make(40)} {passage} {make(40)}", "en", "s", 0), (201, f"{make(40)} {passage} {make(40)}", "en", "s", 0), (202, f"mail me jo@x.org {make(50)}", None, None, None)]
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0), (None, make(70), "en", "s", 0), (303, rows[0][1], "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 0, int(100 <= r[0] < 130)) for r in rows[:80]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not any(i is not None and 100 <= i < 130 for i in seen["toxicity"]) and len(seen["toxicity"]) == 67
    assert 303 not in seen["simhash_near_dedup"] and {0, 59, 300, None} <= set(seen["simhash_near_dedup"])
    assert passage not in seen["substring_dedup"][200] and len(seen["substring_dedup"][200].split()) == 80
    assert seen["substring_dedup"][1] == rows[1][1]
    assert "[EMAIL]" in seen["pii"][202] and seen["pii"][1] == rows[1][1]
    assert out.count() == corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["pii"])


def test_pipeline_keeps_clashing_columns_and_empty_tables(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, toxicity_score string, pii_spans string, row string, rid long, score double, key string, kept string"
    rows = [(i, f"mail jo{i}@x.org {' '.join(f'w{i}x{k}' for k in range(30))}", "en", "s", 0, "a", "b", "c", 7, 0.5, "d", "e") for i in range(20)]
    for name, some in (("full", rows), ("empty", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(some, kinds).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, 0, int(i < 3)) for i, *_ in some], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            out.write.parquet(f"{folder}/{k}")
            if name != "packing":
                docs = spark.read.parquet(f"{folder}/{k}")
                assert docs.columns == [c.split()[0] for c in kinds.split(", ")]
        got = docs.collect()
        assert len(got) <= len(some) and all((r.toxicity_score, r.pii_spans, r.row, r.rid, r.score, r.key, r.kept) == ("a", "b", "c", 7, 0.5, "d", "e") and "[EMAIL]" in r.text for r in got)
        assert bool(got) == bool(some) and corpus_pipeline.run(spark, folder).count() == len(got)


def test_names_rarely_miss_similar_texts():
    """How often two texts at a similarity of 0.8 and 0.9 share none of the least hashes that name their blocks."""
    rng = np.random.default_rng(21)
    for like, most in ((0.8, 0.001), (0.9, 0.0001)):
        n, missed, tries = 300, 0, 20_000
        own = round(n * (1 - like) / (1 + like))
        for _ in range(tries):
            h = rng.integers(0, 1 << 62, n + own)
            missed += not np.intersect1d(np.sort(h[:n])[: simhash.NAMES], np.sort(h[own:])[: simhash.NAMES]).size
        assert missed <= most * tries
