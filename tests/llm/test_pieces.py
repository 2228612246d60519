import os
import random
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pieces as pc

pytestmark = pytest.mark.skipif(not os.path.exists(pc.MODEL), reason="no tokenizer model here")


@pytest.fixture(scope="module")
def own():
    return pc.Encoder(pc.Model(pc.load()))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pc.MODEL)


def split(own, texts):
    ids, ends = own.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


TEXTS = ["", " ", "  ", "Hello world", " Hello  world\n\tx  ", "a\n\nb", "\n", "naïve café 漢字 🙂 \u0000 ▁ ab▁c", "x" * 400, "   " * 40, "The 1234567890 <s> </s> <unk> <0x0A>", "é ‍﻿"]


def test_as_the_library(own, library):
    assert split(own, TEXTS) == [library.encode(t) for t in TEXTS]
    for t in TEXTS:
        assert own.decode(library.encode(t)) == library.decode(library.encode(t))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text(own, library, texts):
    assert split(own, texts) == [library.encode(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=30))
def test_decodes_any_pieces(own, library, ids):
    assert own.decode(ids) == library.decode(ids)


def test_words_of_one_trie_reuse_states(own):
    """Each word alone has the pieces that it has among words with its prefixes."""
    rng = random.Random(1)
    words = {"▁" + "".join(rng.choice("thernwaio") for _ in range(rng.randint(1, 14))) for _ in range(3000)}
    together = dict(own.encode_words(words))
    for w in rng.sample(sorted(words), 300):
        assert together[w] == own.merged(w)


def test_unigram_scores():
    """The best-scored segmentation of each word, against all segmentations."""
    model = pc.Model.__new__(pc.Model)
    model.pieces = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "▁ab"]
    model.scores = [0.0, -2.0, -3.0, -3.1, -2.9, -4.0, -3.5, -4.2, -5.9, -5.0]
    model.types = [pc.UNKNOWN] + [pc.NORMAL] * 9
    model.kind, model.dummy_prefix, model.trim, model.fallback = pc.UNIGRAM, True, False, False
    own = pc.Encoder(model)

    def best(word):
        if not word:
            return 0.0, []
        options = [(s + own.m.scores[own.ids[word[:k]]], [own.ids[word[:k]], *p]) for k in range(1, len(word) + 1) if word[:k] in own.ids for s, p in [best(word[k:])]]
        return max(options)

    words = {"▁" + "".join(w) for n in range(5) for w in product("abc", repeat=n)}
    for word, got in own.encode_words(words):
        assert sum(own.m.scores[k] for k in got) == pytest.approx(best(word)[0])
    assert dict(own.encode_words(["▁axxb"]))["▁axxb"] == [own.ids["▁a"], 0, own.ids["b"]]


def test_table(spark, library):
    rows = [(1, "Hello world", 5), (1, "Hello world", 5), (None, "x y", 0), (2, None, None), (3, "", 1), (4, "word " * 20_000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces int")
    got = pc.encode(docs, pc.load(), check=True).collect()
    assert sorted((r.doc_id or 0, r.n_pieces) for r in got) == sorted((i or 0, len(library.encode(t or ""))) for i, t, _ in rows)
    assert all(r.round_trip for r in got)
    back = pc.decode(pc.encode(docs, pc.load()), pc.load()).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert pc.encode(docs.limit(0), pc.load()).collect() == []
