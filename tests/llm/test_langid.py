from tidemark.llm import langid

EN = "the house and the garden were quiet when the morning came with rain over the fields and hills"
DE = "das haus und der garten waren still als der morgen kam mit regen über den feldern und hügeln"


def model_of(spark, rows):
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_words_then_ngrams(spark):
    model = model_of(spark, [(i, EN, "en") for i in range(5)] + [(10 + i, DE, "de") for i in range(5)] + [(50, None, "en"), (51, "x", None), (None, "y", "en")])
    assert model.languages == ["de", "en"]
    docs = [(1, "The garden of the house"), (2, "Der Garten und das Haus"), (3, "hügelfeld gartenregens"), (4, "mornings quietly"), (5, None), (6, ""), (7, "1234 !?"), (8, "漢字"), (8, "漢字"), (None, "the the")]
    got = langid.identify(spark.createDataFrame([(*d, "zz") for d in docs], "doc_id long, text string, lang_pred string"), model).collect()
    pred = {r.doc_id: r.lang_pred for r in got}
    assert [pred[i] for i in range(1, 8)] == ["en", "de", "de", "en", "und", "und", "und"]
    assert pred[8] in ("de", "en") and len(got) == 10 and all(0 <= r.score <= 1 for r in got)


def test_backoff_gets_shorter():
    model = langid.Model({"aa": {"abcd": 5, "abce": 5}, "bb": {"wxyz": 5}})
    assert "abcd" in model.words and "abcx" not in model.words
    assert model.word("abzz") and model.word("12") == b""
    words = langid.Cache(model.word)
    assert model.predict("abcx", words)[0] == "aa" and model.predict("z", words)[0] == "bb"


def test_every_language_of_the_sample_is_learned(spark):
    model = model_of(spark, [(i, f"{chr(0x4E00 + i) * 3} " * (130 - i), f"l{i:03}") for i in range(120)])
    assert model.languages == [f"l{i:03}" for i in range(120)]
    assert model.predict(chr(0x4E00 + 119) * 3, langid.Cache(model.word))[0] == "l119"


def test_nothing_learned(spark):
    model = model_of(spark, [])
    got = langid.identify(spark.createDataFrame([(1, "words")], "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
