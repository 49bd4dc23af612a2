"""Texts encoded part by part against the tokenizers library alone."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from fathom.llm import encoding
from fathom.llm.queries import vocabulary

ODD = ["", None, " ", "  \n", "it's 'tis o'clock 's", "foo.bar, baz;  qux\n\n\nx \t y ", "é.è,ß;×y÷ ɏ. ɐ", "a b  c  d  　e f", "<|endoftext|> hi", "x<|y", "日本語。テスト, ok", "\x00\x01 a\x00b \x1c x\x1d.", "🙂 .🙂, a🙂.b", "ABC İI Ǆ", "a.́b", "12.5,7 a1b2.c3", "a" * 40 + " " + "b" * 25 + ".", "\n ", " \n", "a \n b", "a\r\n\r\nb", "x  'y", "don't-'s"]


@pytest.mark.parametrize(("name", "mode"), [("byte_bpe_50k.json", "blank before word"), ("word_bpe_49k.json", "blanks dropped")])
def test_equals_the_library(name, mode, monkeypatch):
    random.seed(5)
    letters = [*"aBé1ß  \n.,'s- 日🙂×<|_\t", " ", "́", " ", "ŉ"]
    texts = ODD + ["".join(random.choices(letters, k=random.randint(1, 14))) for _ in range(4000)]
    for limit, piece in ((500_000, 1 << 20), (3000, 2000)):
        monkeypatch.setattr(encoding, "_SLICE", piece)
        own = encoding.Encoder(vocabulary(name), mode, limit)
        want = [x.ids for x in own.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        assert [x.tolist() for x in own(pa.array(texts, pa.string()))] == want
        long = " and so on ".join(t for t in texts if t and "<|" not in t and t.isascii())
        assert next(iter(own(pa.array([long])))).tolist() == own.tokenizer.encode(long, add_special_tokens=False).ids
    assert list(own(pa.array([], pa.string()))) == []
