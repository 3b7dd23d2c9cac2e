"""A packing task remembers a word once, whatever its case and the marks after it; ids are the library's."""

import random

import numpy as np

from votelake.llm import packing
from votelake.llm.queries import tokenizer_path


def _tokenizer():
    with open(tokenizer_path(), encoding="utf-8") as f:
        return packing.WordTokenizer(f.read())


def test_a_word_is_remembered_once():
    tokenizer = _tokenizer()
    tokenizer.encode(["Été été, ÉTÉ. été!?", "été...\nété!?"])
    assert set(tokenizer.known) == {"", "été", ",", ".", "!?", "..."}


def test_words_used_lately_stay(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 20)
    tokenizer, asked = _tokenizer(), []
    word = tokenizer._word
    tokenizer._word = lambda w: asked.append(w) or word(w)
    for i in range(40):
        tokenizer.encode(["always " + " ".join(chr(97 + i % 26) * (k + 2 + i // 26) for k in range(4))])
        assert len(tokenizer.known) + len(tokenizer.before) <= packing.MEMORY + 10
    assert asked.count("always") == 1


def test_ids_of_odd_texts_are_the_librarys():
    tokenizer, draw = _tokenizer(), random.Random(3)
    letters = "aeÉßÿµ×÷ªº.,!?%$#&*|:;()+=@/-'\"̸́ \x85\t\r\n\xa05²ΣσİıſDz中’…\x1c‍̈sSdDlLmM"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(30))) for _ in range(4000)]
    texts += ["a<|endoftext|>, b.", "<|ENDOFTEXT|>. Été", "x<|startoftext|>y.", "漢<|EndOfText|>a."]
    for text, ids in zip(texts, tokenizer.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.inner.encode(text, add_special_tokens=False).ids, ascii(text)
