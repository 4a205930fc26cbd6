"""Ids of the word-end BPE vocabulary, equal to the tokenizers library's, with words remembered.

A text is cut at white space, which no token spans; each run is normalised and cut into pieces once
and its ids kept, since words repeat. Pieces are merged by tiktoken over the same vocabulary, with
a byte that UTF-8 never uses as the word end. Runs with rare traits go to the tokenizers library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_ODD = re.compile("[\x1c-\x1f\ud800-\udfff]")
_END = b"\xff"


def _byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in own}
    for i, b in enumerate(x for x in range(256) if x not in set(own)):
        out[chr(256 + i)] = b
    return out


class _Memo(dict):
    """Values made by a function on first use."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class WordBpe:
    """ids(text) as little-endian unsigned 16-bit bytes, without special tokens."""

    def __init__(self, path: str | None = None, remember: int = 400_000) -> None:
        path = path or public_tokenizers.path("word_bpe_49k.json")
        self.reference = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:  # a vocabulary that ships with the Python environment
            vocab = json.load(f)["model"]["vocab"]
        chars = _byte_chars()
        ranks = {}
        for token, i in vocab.items():
            body, end = (token[:-4], _END) if token.endswith("</w>") else (token, b"")
            if body and all(c in chars for c in body):
                ranks[bytes(chars[c] for c in body) + end] = i
        self.core = tiktoken.Encoding("word", pat_str=r".", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pieces = _Memo(lambda p, merge=self.core.encode_single_piece: array("H", merge(p.encode() + _END)).tobytes())
        self.runs = _Memo(self._run)
        self.remember = remember

    def _run(self, run: str) -> bytes:
        if not run.isascii():
            run = unicodedata.normalize("NFC", run)
        low = run.lower()
        if low.isalpha() and "Σ" not in run:
            return self.pieces[low]
        if "Σ" in run or "<|" in run:
            return array("H", self.reference.encode(run, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(low)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.runs) > self.remember:
            self.runs.clear()
        if len(self.pieces) > self.remember:
            self.pieces.clear()
        out, run = [], self.runs.__getitem__
        for text in texts:
            if _ODD.search(text):
                out.append(array("H", self.reference.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join(map(run, text.split())))
        return out
