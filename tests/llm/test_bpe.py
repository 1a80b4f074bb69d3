import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import bpe
from loomgraph.llm.bpe import WordBpe, bpe_decode, bpe_encode, public_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_path())


@pytest.fixture(scope="module")
def own():
    return WordBpe(public_path(), cache_entries=50)


def same(library, own, text):
    ids = library.encode(text, add_special_tokens=False).ids
    raw = own.encode(text)
    assert np.frombuffer(raw, "<u4").tolist() == ids
    assert own.decode(raw) == library.decode(ids, skip_special_tokens=False)


ODD = ["", " \t\n", "ΣΑΣ ΟΔΟΣ", "a\x1cb \x1d\x1f", "it's WE'RE 'start '", "<|endoftext|>Hi<|startoftext|><|x|>", "İstanbul ǅ ﬁ ½²Ⅷ ١٢ 一二", "á q̣̇ 각", "x  y​z\xa0w", "x" * 4000, "ab" * 700 + "é" * 400, "👍🏽 \0 �", "</w>"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, own, text):
    same(library, own, text)


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.characters(max_codepoint=0x24FF, exclude_categories=("Cs", "Cn")), max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer

    library = test_any_text.__dict__.setdefault("library", Tokenizer.from_file(public_path()))
    own = test_any_text.__dict__.setdefault("own", WordBpe(public_path()))
    same(library, own, text)


def test_heap_and_scan_agree(monkeypatch, own):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("thehanderingtion"), n)) for n in (1, 2, 3, 20, 200)]
    scanned = [own.merge(w) for w in words]
    monkeypatch.setattr(bpe, "SCAN_SYMBOLS", 0)
    assert [own.merge(w) for w in words] == scanned


def test_frame_cases(spark, library):
    rows = [(1, None, "a"), (1, "same text", "b"), (1, "same text", "b"), (None, "", None)] + [(k, t, "x") for k, t in enumerate(ODD)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, decoded_by string").repartition(3)
    encoded = bpe_encode(frame)
    assert encoded.columns == ["doc_id", "decoded_by", "ids"]
    out = bpe_decode(encoded.withColumnRenamed("ids", "raw"), "raw").collect()
    expected = [library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, t, _ in rows]
    assert sorted(r["decoded"] for r in out) == sorted(expected)
    empty = bpe_decode(bpe_encode(spark.createDataFrame([], "doc_id long, text string")))
    assert empty.count() == 0


def test_clashing_columns_are_refused(spark):
    frame = spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, ids string")
    with pytest.raises(ValueError):
        bpe_encode(frame)
    with pytest.raises(ValueError):
        bpe_decode(frame.withColumnRenamed("text", "decoded"))
