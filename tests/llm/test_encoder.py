"""Words of texts are tokenised once, whatever marks are beside them, and found again exactly."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tapeloom.llm import packing
from tapeloom.llm.texts import Words, slices


class Counted:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.seen = tokenizer, 0

    def encode_batch(self, texts, **options):
        self.seen += sum(map(len, texts))
        return self.tokenizer.encode_batch(texts, **options)

    def encode_batch_fast(self, texts, **options):
        self.seen += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


@pytest.fixture
def encoder():
    made = packing.Encoder(packing.default_tokenizer())
    made.tokenizer, made.plain = Counted(made.tokenizer), Counted(getattr(made, "plain", made.tokenizer))
    return made


def seen(encoder, texts) -> int:
    """Checks the ids of texts; gives the characters that the tokenizer got for them."""
    before = encoder.tokenizer.seen + encoder.plain.seen
    got = [x for _, _, data, offs in slices(pa.array(texts, pa.string())) for x in encoder.encode(data, offs)]
    after = encoder.tokenizer.seen + encoder.plain.seen
    want = encoder.tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [e.ids for e in want]
    return after - before


def words(n: int) -> list[str]:
    letters = "abcdefghijklmnopqrstuvwxyzäéß"
    rng = random.Random(8)
    return ["".join(rng.choices(letters, k=rng.randrange(6, 16))) for _ in range(n)]


def test_marks_beside_a_word_do_not_make_it_new(encoder):
    first = words(200)
    assert seen(encoder, [" ".join(first)]) > 1000
    marks = "*$%&#()[]{}<>/\\|=+-_~^`@\".,:;!?"
    beside = [f"{m}{w} {w}{m}{m}" for m in marks for w in first]
    assert seen(encoder, [" ".join(beside), *beside[:300]]) <= 6 * len(marks)


def test_many_words_stay_known(encoder, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 8 << 20)
    many = words(60_000)
    texts = [" ".join(many[k : k + 500]) for k in range(0, len(many), 500)]
    assert seen(encoder, texts) > 600_000
    assert seen(encoder, texts) == 0


@pytest.mark.parametrize("cache", [0, 20_000, 1 << 30])
def test_forgetting_and_equal_hashes_change_no_ids(encoder, monkeypatch, cache):
    monkeypatch.setattr(packing, "CACHE", cache)
    few = words(900)
    texts = [" ".join(few[k : k + 100]) for k in (0, 100, 0, 300, 200, 0, 800)] + ["", " ", "\n", few[0]]
    for text in texts:
        seen(encoder, [text])
    monkeypatch.setattr(Words, "hashes", lambda self, form: np.full(len(self.start), 7, np.uint64))
    for text in (texts, texts[:3], texts[2:], [""], []):
        seen(encoder, text)


def test_marks_quotes_and_letters_mixed(encoder):
    rng, parts = random.Random(9), [*map(chr, range(33, 127)), "'s", "'RE", "'ll", "é", "É", "ß", "ÿ", "÷", "×", "µ", "ª", " ", "\t", "\xa0", "　", "ſ", "İ", "中", "١", "½", "😀"]
    pool = [x for x in parts if x != "|"]  # so that no text is kept as it is
    texts = ["".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(1500)]
    seen(encoder, texts)
    seen(encoder, texts)
    for mark in map(chr, range(33, 127)):
        seen(encoder, [f"{mark}a", f"a{mark}", f"{mark}'s", f"a{mark}'s", f"a'{mark}s", f"é{mark}é", f"3{mark}a{mark}3"])
