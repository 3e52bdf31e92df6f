import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm.token_counts import Counter, merger, with_token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "", " \t\n", "<|endoftext|>", "x<|endoftext|>y <|startoftext|><|endoftext|>'s", "İstanbul ΣΑΣ é é", "a\x1cb\x85c\xa0d　e",
    "'S'T don't I'LL ''s", "a" * 3000, "!" * 3000, "ab" * 999, "日本語 한국어", "😀😀 ½²", "\x00\x01", "<|EndOfText|>", "word, word. (word)",
]


def expected(texts):
    return [len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_odd_texts():
    assert Counter(PATH)(ODD) == expected(ODD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet="abst're!?.<|1é́ \n Σς", max_size=80), max_size=5))
def test_any_text(texts):
    assert Counter(PATH)(texts) == expected(texts)


def test_ids_are_the_library_s():
    words = [w.encode() for w in ("internationalisation", "aaaaaaa", "the", "x")]
    ids, counts = merger(PATH).merge(words)
    assert ids.tolist() == [i for w in words for i in LIBRARY.encode(w.decode(), add_special_tokens=False).ids]
    assert counts.sum() == len(ids)


def test_rows(spark):
    rows = [(1, "one two", 9), (1, "one two", 9), (None, None, 8), (2, "", 7), (3, "long " * 50_000, 6)]
    got = with_token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH)
    assert sorted(r["n_tokens"] for r in got.collect()) == sorted(expected([r[1] for r in rows]))
    assert with_token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        merger(public_tokenizers.path("byte_bpe_50k.json"))
