import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chainloom.llm import encoding

PATH = f"{encoding.FOLDER}/byte_bpe_50k.json"
tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


def reference(texts):
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_texts(spark):
    texts = ["", None, "hello world", "aaaaaaaaaaaaaaaaaa aaaa a", "  \r\n\t x ", "<|endoftext|> don't we'll", "日本語 🙂 e\u0301 ß", "x" * 5000 + " y" * 3000, "\x00\x01", "\u00a0\u2003 z"]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(2, texts[2], [1])], "doc_id long, text string, ids array<int>")
    got = encoding.encode(df, "doc_id", "text").collect()
    assert len(got) == len(texts) + 1
    want = reference([t or "" for t in texts])
    assert all(r.ids == want[r.doc_id] for r in got)
    counts = encoding.count_tokens(df, ("doc_id", "text"), "text").collect()
    assert all(r.tokens == len(want[r.doc_id]) for r in counts)


def test_empty_table_and_forgetting(spark, monkeypatch):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encoding.encode(df, "doc_id", "text").count() == 0
    memory = encoding.Memory(encoding.Merges(PATH))
    monkeypatch.setattr(encoding, "REMEMBERED", 1)
    for words in (["ab", "cd"], ["ef"], ["ab"]):
        at = memory.lookup(words)
        ids = [memory.ids[0][memory.start[0][i] : memory.start[0][i] + memory.length[0][i]].tolist() for i in at]
        assert ids == reference(words)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Z", "P", "N", "S", "C", "M")), min_size=1, max_size=25), min_size=1, max_size=6))
def test_replay_of_words(words):
    merges = test_replay_of_words.__dict__.setdefault("merges", encoding.Merges(PATH))
    ids, lengths = encoding.replay([w.encode() for w in words], merges)
    flat = [i for w in reference(words) for i in w]
    if all(len(w) == 1 or w.isalpha() for w in words):
        assert ids.tolist() == flat and lengths.sum() == len(flat)
