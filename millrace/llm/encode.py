"""Token ids of whole texts, by the tokenizers library, at the cost of one look-up a distinct word and batch.

The pre-tokenizers of the public vocabularies never join what a blank parts, so a text's ids are those of its pieces
in order. Arrow cuts a batch of texts and finds the distinct pieces; the library is asked for each piece's ids once
and a bounded number of answers is kept. Texts that hold one of the vocabulary's own control strings, and all texts for
a vocabulary with any other pre-tokenizer, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters with the Unicode property White_Space, which is what ``\s`` means to the library.
WHITE = "\t-\r \x85\xa0  -     　"
_WHITE = re.compile(f"[{WHITE}]")
#: GPT-2's rule gives one blank to the word behind it and leaves the others together.
_BYTE_LEVEL = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]").findall
#: Marks that the rules part from the letters before them, and that never begin a contraction.
TAIL = ".,;:!?"
#: Pieces kept, and the longest piece kept: about 200 MB a Python worker at most.
KEPT_PIECES, LONGEST_KEPT = 800_000, 48
#: Byte-level models spell a byte as a visible character: itself, or the next free one from U+0100.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_CHARS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
#: Bytes of text cut at a time.
STEP_BYTES = 8_000_000


def steps(texts: pa.Array, size: int = STEP_BYTES) -> Iterator[pa.Array]:
    """Slices of about ``size`` bytes; a longer text is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size, "right")))
        yield texts.slice(at, to - at)
        at = to


class TextEncoder:
    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.end_id = end_id
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.control = [t["content"] for t in spec.get("added_tokens") or []]
        pre = spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers") or [{}]
        self.rule = "whole"
        self.unusual: dict[str, bytes] = {}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            self.rule = "blank before"
        elif pre.get("type") == "Sequence" and len(parts) == 2 and parts[0].get("behavior") == "Removed" and parts[1].get("type") == "ByteLevel" and "\\s" in str(parts[0].get("pattern")):
            self.rule = "blanks dropped"
        self.usual = " " if self.rule == "blank before" else ""

    def _letters(self, word: str) -> str | None:
        """How the model spells a word of letters, which is one pre-token; None where only the library can tell."""
        if word.isascii():
            return word.lower() if self.rule == "blanks dropped" else word
        if self.rule == "blanks dropped":
            word = unicodedata.normalize("NFC", word)
            low = word.lower()
            if "\u03a3" in word or not low.isalpha():  # a last sigma, or letters that fall apart
                return None
            word = low
        return word.encode().decode("latin-1").translate(BYTE_CHARS)

    def _ask(self, piece: str, blank: str) -> bytes:
        """The ids of a piece that has not been seen, with the blank (or nothing) before it."""
        core = piece.rstrip(TAIL)
        if core.isalpha() and self.rule != "whole":
            word = self._letters(core)
            if word is not None and len(core) < len(piece):
                return self.ids_of_one(core, blank) + self.ids_of_one(piece[len(core) :], "")
            if word is not None:
                return array("I", [t.id for t in self.model.tokenize("\u0120" + word if blank else word)]).tobytes()
        if self.rule == "blank before" and _WHITE.search(piece):
            parts = _BYTE_LEVEL(blank + piece)
            if len(parts) > 1:
                return b"".join(self.ids_of_one(x[x.startswith(" ") :], " " * x.startswith(" ")) for x in parts)
        return array("I", self.tokenizer.encode(blank + piece, add_special_tokens=False).ids).tobytes()

    def forget(self) -> None:
        self.known.clear()
        self.unusual.clear()

    def ids_of_one(self, piece: str, blank: str) -> bytes:
        known = self.known if blank == self.usual else self.unusual
        ids = known.get(piece)
        if ids is None:
            ids = self._ask(piece, blank)
            if len(piece) <= LONGEST_KEPT:
                known[piece] = ids
        return ids

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as it usually stands, encoded by itself: little-endian unsigned 32-bit integers."""
        if len(self.known) + len(self.unusual) > KEPT_PIECES:
            self.forget()
        out = list(map(self.known.get, pieces))
        one, usual = self.ids_of_one, self.usual
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = one(pieces[i], usual)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id, and the offsets of the texts in them. Null: empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if self.rule == "blank before":
            lists = pc.split_pattern(texts, " ")
        elif self.rule == "blanks dropped":
            lists = pc.ascii_split_whitespace(texts)
        else:
            lists = pa.LargeListArray.from_arrays(np.arange(n + 1), texts)
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        coded = pc.list_flatten(lists).dictionary_encode()
        codes, pieces = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        ids = self.ids_of(pieces)
        if self.rule == "blank before" and n:
            codes = self._with_blanks(texts, bounds, codes, coded.dictionary, pieces, ids)
        if self.control and n:
            codes = self._with_control(texts, bounds, codes, ids)
        codes = np.insert(codes.astype(np.int64), bounds[1:], len(ids))
        ids.append(np.uint32(self.end_id).tobytes())
        length = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        flat, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(length, dtype=np.int64) - length
        each = length[codes]
        total = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        out = np.repeat(start[codes] - total[:-1], each)
        out += np.arange(total[-1])
        return flat[out], total[bounds + np.arange(n + 1)]

    def _with_control(self, texts, bounds, codes, ids) -> np.ndarray:
        """A text that holds a control string of the vocabulary is one piece, which the library encodes."""
        holds = [pc.match_substring(texts, c).to_numpy(zero_copy_only=False) for c in self.control]
        some = np.flatnonzero(np.logical_or.reduce(holds))
        if len(some):
            codes = codes.copy()
            nothing = len(ids)
            ids.append(b"")
        for d in some.tolist():
            codes[bounds[d] : bounds[d + 1]] = nothing
            codes[bounds[d]] = len(ids)
            ids.append(array("I", self.tokenizer.encode(texts[d].as_py(), add_special_tokens=False).ids).tobytes())
        return codes

    def _with_blanks(self, texts, bounds, codes, distinct, pieces, ids) -> np.ndarray:
        """First pieces have no blank before them; a text in which a blank stands inside white space is one piece."""
        empty = pc.equal(distinct, "")
        begins, ends = (pc.or_(empty, pc.match_substring_regex(distinct, p)).to_numpy(zero_copy_only=False) for p in (rf"^[{WHITE}]", rf"[{WHITE}]$"))
        first = np.zeros(len(codes), bool)
        first[bounds[:-1]] = True  # every text has a piece, if an empty one
        unsure = np.flatnonzero(begins[codes[1:]] & ends[codes[:-1]] & ~first[1:]) + 1
        odd = set(np.unique(np.searchsorted(bounds, unsure, "right") - 1).tolist())
        codes = codes.copy()
        places: dict[bytes, int] = {}
        for d, at in enumerate(bounds[:-1].tolist()):
            if d in odd:
                codes[at : bounds[d + 1]] = places.setdefault(b"", len(ids) + len(places))
                found = b"".join(self.ids_of_one(x[x.startswith(" ") :], " " * x.startswith(" ")) for x in _BYTE_LEVEL(texts[d].as_py()))
            else:
                found = self.ids_of_one(pieces[codes[at]], "")
            codes[at] = places.setdefault(found, len(ids) + len(places))
        ids.extend(places)
        return codes


@lru_cache(maxsize=4)
def encoder(path: str, end_id: int = 1) -> TextEncoder:
    """One encoder a Python worker and vocabulary, so that what it has learnt serves the worker's next tasks."""
    return TextEncoder(path, end_id)
