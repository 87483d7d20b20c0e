import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm.text import Sequences, text_bytes, word_hashes, words
from vellum.llm.tokens import encoder

TEXTS = ["", "a", " ", "\n", "a b\n c  d\te\r\nf", " lead", "trail ", None, "a ́b é c", "don't 's 12 345 $$ a\nb\n\nc", "日本 語 テスト\n日", "a\x1c b \x1dc", "İ I ß Σς ΑΣ Β", "😀 😀😀", "a\x85 b", "x" * 300_000, "One. Two, three!\nFour <|endoftext|> five"]


def test_words_are_ascii_split():
    raw, at = text_bytes(pa.array(TEXTS))
    start, end, first = words(raw, at)
    for i, text in enumerate(TEXTS):
        own = [raw[a:b].tobytes() for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]])]
        assert own == (text or "").encode().split()


def test_names_follow_content():
    raw, at = text_bytes(pa.array(["one two one two", "two  one\ttwo one", "x" * 200_000 + " one"]))
    start, end, _ = words(raw, at)
    names = word_hashes(raw, start, end)
    by = {}
    for a, b, n in zip(start, end, names):
        assert by.setdefault(raw[a:b].tobytes(), n) == n
    assert len(set(by.values())) == len(by)
    sequence = Sequences(names)
    assert sequence.of(np.array([0]), 3) == sequence.of(np.array([5]), 3) != sequence.of(np.array([1]), 3)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_gives_the_library_s_ids(name):
    enc = encoder(public_tokenizers.path(name))
    for texts in (TEXTS[:-2], TEXTS[:-2], TEXTS[-1:]):  # twice: from the library, then from the memo
        ids, at = enc.encode(*text_bytes(pa.array(texts)))
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == enc.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcÉéß.,;'! \n\t  ́日1#")), max_size=6))
def test_memo_on_odd_texts(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = encoder(public_tokenizers.path(name))
        ids, at = enc.encode(*text_bytes(pa.array(texts, pa.string())))
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
