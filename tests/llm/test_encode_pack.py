import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekiln.llm.encode import VOCABULARY, ChunkEncoder, chunks, encode_texts, vocabulary_encoder
from lorekiln.llm.lexicon import Transducer
from lorekiln.llm.pack import pack_documents, sum_of_squares

MERGE = vocabulary_encoder(open(VOCABULARY, "rb").read())
LEX = Transducer.build({w.encode(): MERGE(w) for w in (" the", " then", " them", " hen", " 中", " a")})


def test_transducer_finds_exactly_its_words():
    words = [w.encode() for w in (" the", " then", " th", " thens", "", " 中", " hen", "the")]
    r = LEX.ranks(words)
    assert (r >= 0).tolist() == [True, True, False, False, False, True, True, False]
    for w, k in zip(words, r):
        if k >= 0:
            assert LEX.ids[LEX.offsets[k] : LEX.offsets[k + 1]].tolist() == MERGE(w.decode())
    assert Transducer.build({}).ranks([b"x"]).tolist() == [-1]


def test_transducer_round_trip_on_disk(tmp_path):
    (tmp_path / "lex").write_bytes(LEX.to_bytes())
    mapped = Transducer.map(str(tmp_path / "lex"))
    assert mapped.ranks([b" them"])[0] == LEX.ranks([b" them"])[0] and (mapped.ids == LEX.ids).all()


def test_suffixes_are_shared():
    words = {f" {p}ation".encode(): [1] for p in ("n", "st", "rot", "cre", "don")}
    assert len(Transducer.build(words).final) < sum(map(len, words))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab the'S1é \n\t\xa0\x1c²½_.,-中ñ", max_size=40))
def test_ids_equal_the_tokenizers(text):
    got = np.frombuffer(ChunkEncoder(LEX, MERGE).encode([text])[0], np.int32).tolist()
    assert got == MERGE(text)
    assert " ".join(chunks(text)) == text


def test_encode_all_rows(spark):
    texts = ["the hen the hen", None, "", "  \n ", "x" * 5000, "naïve café 中文 the", "the hen the hen", "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(0, "again", "c")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode_texts(df).collect())
    assert got == sorted((i, MERGE(t) if t else []) for i, t in [*enumerate(texts), (0, "again")])
    sizes = sorted(tuple(r) for r in encode_texts(df, sizes_only=True).collect())
    assert sizes == sorted((i, len(x)) for i, x in got)
    assert encode_texts(df.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_bins_hold_their_capacity(sizes):
    b = sum_of_squares(np.array(sizes, np.int64), 50)
    fill = np.bincount(b, weights=sizes) if sizes else np.zeros(0)
    assert (fill <= 50).all() and (fill > 0).all()


@pytest.mark.parametrize("block", [7, 1000])
def test_pack(spark, block):
    rnd = random.Random(1)
    docs = [(i, rnd.choice([0, None, 3, 17, 40, 100, 101, 250, 399])) for i in range(200)] + [(1, 30), (1, 30)]
    win = spark.createDataFrame([(1, "a", 100), (2, "b", 60), (3, "c", None), (4, "d", 0)], "window_id int, window_name string, capacity_tokens int")
    df = spark.createDataFrame(docs, "doc_id long, n_tokens int")
    rows = pack_documents(df, win, block_items=block).collect()
    for w, cap in ((1, 100), (2, 60)):
        mine = [r for r in rows if r.window_id == w]
        fill, total = {}, {}
        for r in mine:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
            if r.prompt_id is not None:
                fill[r.prompt_id] = fill.get(r.prompt_id, 0) + r.n_tokens
            else:
                assert r.n_tokens == 0
        assert max(fill.values()) <= cap
        want = {}
        for i, n in docs:
            want[i] = want.get(i, 0) + (n or 0)
        assert total == want
        if block > 100:
            assert len(fill) <= 1.15 * sum(n or 0 for _, n in docs) / cap + 2
        whole = {i for i, n in docs if (n or 0) <= cap}
        assert all(r.piece_no == 0 for r in mine if r.doc_id in whole)
    assert {r.window_id for r in rows} == {1, 2}
    assert pack_documents(df.limit(0), win).count() == 0
    assert pack_documents(df, win.limit(0)).count() == 0


def test_every_window_is_packed(spark):
    win = spark.createDataFrame([(i, 10 + i % 7) for i in range(1500)] + [(0, 99), (None, 5)], "window_id int, capacity_tokens int")
    df = spark.createDataFrame([(1, 4), (2, 30)], "doc_id long, n_tokens int")
    rows = pack_documents(df, win).collect()
    total = {}
    for r in rows:
        total[r.window_id] = total.get(r.window_id, 0) + r.n_tokens
    assert total == dict.fromkeys(range(1500), 34)
    assert all(r.n_tokens == 30 for r in rows if r.window_id == 0 and r.doc_id == 2)
