import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [" ", "  ", "\n", "\t", "\x1c", "\x85", "　", "\xa0", "a", "b", "'s", "'ll", "é", "ß", "漢字", "1", "½", "!", "<|endoftext|>", "🙂", "é", "​", "=", "-", "<|", "\r\n", "don't", " the"]


def test_codec_equals_library():
    t, c = Tokenizer.from_file(PATH), bpe.ForcedBoundaryCodec(open(PATH).read())
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14)))
        ids = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(c.encode(text), "<u4").tolist() == ids, repr(text)
        assert c.decode(c.encode(text)) == t.decode(ids, skip_special_tokens=False)


def test_forced_pairs_are_inside_no_token():
    c = bpe.ForcedBoundaryCodec(open(PATH).read())
    inside = {(a, b) for t in c.token[:50256] for a, b in zip(t, t[1:])}
    assert all(c.forced[a, b] == ((a, b) not in inside) for a in range(256) for b in range(256))
    raw = "naïve—漢字🙂xyz".encode()
    assert b"".join(c.fragments(raw)) == raw and len(c.fragments(raw)) > 1


def test_round_trip(spark):
    rows = [(1, "Hello  world\n\n x", "i"), (2, None, "i"), (2, "", "i"), (3, "=" * 50_000 + "ab" * 9_000, "i"), (None, "x", "i"), (None, "x", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.round_trip(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == sorted((i or 0, x or "") for i, x, _ in rows)
    t = Tokenizer.from_file(PATH)
    assert all(np.frombuffer(r.ids, "<u4").tolist() == t.encode(r.decoded, add_special_tokens=False).ids for r in got)
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
