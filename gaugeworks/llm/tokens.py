"""Byte-level BPE ids as packed little-endian 32-bit integers, at several MB a second.

The vocabulary file is the one that ``tokenizers`` reads. Texts whose characters are all in
a set where Python's ``re`` splits words as the vocabulary's own pattern does are split
here, and each distinct word is encoded once per worker; any other text goes through
``tokenizers`` itself. Both ways give the same ids.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache

#: Words whose ids a worker remembers at most; then it starts anew.
CACHE = 400_000

_LETTER = r"A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGIT = r"0-9²³¹¼½¾"
_SPACE = r"\t-\r\x20\x85\xa0"
_SAFE = re.compile(r"[\x00-\x1b!-~\x20\x7f-ɏ‐-‧‰-⁞€]*")
_WORD = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pack_ids(ids) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _Words(dict):
    """Word to packed ids; a miss is encoded and kept."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word):
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = pack_ids(self.encode(word.encode()))
        return found


class PackedTokenizer:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        self.bpe = tiktoken.Encoding("gw", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.words = _Words(self.bpe.encode_single_piece)

    def split_safely(self, text: str) -> bool:
        return bool(_SAFE.fullmatch(text)) and not (self.special and self.special.search(text))

    def packed(self, text: str) -> bytes:
        """The text's ids, four bytes each."""
        if self.split_safely(text):
            return b"".join(map(self.words.__getitem__, _WORD.findall(text)))
        return pack_ids(self.whole.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> PackedTokenizer:
    return PackedTokenizer(path)
