import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_hilbert_steps_to_neighbours():
    side = np.arange(8)
    grid = np.stack([x.ravel() for x in np.meshgrid(side, side, side)], axis=1)
    key = packing.hilbert(grid, bits=3)
    assert sorted(key.tolist()) == list(range(512))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_words_encode_as_whole_texts():
    t, whole = packing.WordTokenizer(open(PATH).read()), Tokenizer.from_file(PATH)
    for text in ["", " ", "Hello, World!  It's\n\n1234 x", "tab\tand\r\nÉté ΣΑΣ ñ 漢字", "a<|endoftext|> b <|startoftext|>", "x\x1cy z é ́a", "don't  'll"]:
        assert np.frombuffer(t.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("length", [8, 64])
def test_pack_is_whole_and_gapless(spark, length):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma's", "delta."], rng.integers(0, 60))) for _ in range(60)]
    rows = [(i, x, 1) for i, x in enumerate(texts)] + [(1000, None, 2), (1001, "", 3), (1001, "", 3), (1002, "word " * 500, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(5)
    out = packing.pack(docs, PATH, length=length).toPandas()
    whole = Tokenizer.from_file(PATH)
    ids = {i: np.array(whole.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for i, x, _ in rows}
    for r in out.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id]) and 1 <= r.length
    assert out.groupby("doc_id").length.sum().to_dict() == {i: len(x) * (2 if i == 1001 else 1) for i, x in ids.items()}
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= length


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
