import numpy as np

from tidemark.llm import strings, toxicity


def brute_kernel(a, b):
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(a)), strings.LENGTH):
        for j in combinations(range(len(b)), strings.LENGTH):
            if [a[x] for x in i] == [b[x] for x in j]:
                total += strings.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_matches_brute_force():
    pairs = [("^idiot", "^idiot"), ("^id1iot", "^idiot"), ("^banana", "^ananas"), ("abc", "xyz"), ("ab", "abc"), ("aaaa", "aaa")]
    got = strings.kernel(strings.codes([a for a, _ in pairs])[0], strings.codes([b for _, b in pairs])[0])
    assert np.allclose(got, [brute_kernel(a, b) for a, b in pairs], rtol=1e-4)


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghilmnoprst"), rng.integers(3, 9))) for _ in range(400)]
    bad = ["nitwit", "bozohead", "grumbleton"]
    out = []
    for i in range(n):
        text = [str(x) for x in rng.choice(words, 40)]
        toxic = int(rng.random() < 0.3)
        if toxic:
            text[int(rng.integers(0, 40))] = str(rng.choice(bad))
            text[int(rng.integers(0, 40))] = str(rng.choice(bad))
        out.append((i, " ".join(text), toxic))
    return out


def test_learns_and_tolerates_gaps(spark):
    rows = corpus(400)
    train, test = rows[:300], rows[300:]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in train], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == x for i, _, x in test]) > 0.95
    score = toxicity.Scorer(model)
    for text in ["what a n i t w i t you", "bo.zo.head", "GRUMBLETON!!", "nit-wit"]:
        assert model.score(score([text]))[0] >= 0.5, text


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (3, "x" * 100_000, 0.5), (None, "some text", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 1), (2, None), (9, 0)], "doc_id long, toxic int")):
        got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0
