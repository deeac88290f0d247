"""The encoder against the tokenizers library, on random texts made to fall on the rules' edges."""

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm.encode import TextEncoder

PARTS = [
    *("the", "The", "WORLD", "don't", "we'll", "I'd", "'s", "'", "x1", "42", "3.14", "naïve", "été", "ΣίσυφοΣ", "İ", "İ...", "Iİ?!"),
    *("ſ", "ẞ", "ß", "K", "ﬁn", "字字", "ไทย", "\U0001f600", "\U0001f468‍\U0001f469", "١٢", "²", "Ⅷ", "_", "-", "...", "?!", ".,;", "…"),
    *("<|endoftext|>", "<|startoftext|>", "<|endoftext|", "<|ENDOFTEXT|>", "̈", "ä", "한", "\x00", "\x1f", "​", "﻿", "co’op", "ǅ", "ʰ"),
]
GAPS = [" ", " ", " ", "", "  ", "\n", "\n\n", "\t", " \n", "\n ", "\r\n", "\xa0", " ", "　", "\x85", "\x0b", "\x0c", "   "]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_library(name):
    rng = np.random.default_rng(8)
    texts = [None, "", " ", "\n"]
    for n in rng.integers(1, 9, 20_000):
        texts.append("".join(PARTS[p] + GAPS[g] for p, g in zip(rng.integers(0, len(PARTS), n), rng.integers(0, len(GAPS), n), strict=True)))
    library = Tokenizer.from_file(public_tokenizers.path(name))
    ids, offsets = TextEncoder(public_tokenizers.path(name), 1).encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 1], repr(t)
