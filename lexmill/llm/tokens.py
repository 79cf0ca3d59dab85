"""Byte-level BPE ids, equal to those of the tokenizers library for the same file; encoders are made once in each worker."""

from __future__ import annotations

import functools
import json

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

BYTE_BPE = "byte_bpe_50k.json"


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level BPE files write for each byte, and that byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


class ByteBpe:
    """The encoder for a tokenizer.json of byte-level BPE without prefix space, with its special tokens.

    tiktoken encodes; a text that its pattern's matcher gives up on (some hundred thousand white-space characters in a row) goes
    to the tokenizers library, which encodes it alike and takes longer.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.path = path
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): rank for token, rank in parts["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding(f"file:{path}", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @functools.cached_property
    def library(self) -> Tokenizer:
        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)
        except ValueError:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(encoder: ByteBpe, text: str | None) -> np.ndarray:
    """The ids of a whole text as 32-bit integers; special tokens written in the text are single ids, as in the library."""
    return encoder.encode(text or "")
