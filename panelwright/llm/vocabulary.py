"""Vocabulary files of byte-level BPE: symbols as bytes, merges by rank, special tokens."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: The pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass
class ByteBpe:
    """``left``, ``right``, ``made``: ids of the merge of each rank; ``symbol``: bytes by id."""

    left: np.ndarray
    right: np.ndarray
    made: np.ndarray
    symbol: list[bytes]
    byte_id: np.ndarray
    special: dict[str, int]


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in the file: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def parse(content: bytes) -> ByteBpe:
    """Reads a tokenizer file of a byte-level BPE without normaliser or prefix space."""
    spec = json.loads(content)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
        raise ValueError("not a plain byte-level BPE file")
    to_byte = printable_bytes()
    ids = model["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    symbol = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for text, i in ids.items():
        symbol[i] = bytes(to_byte[c] for c in text)
    for text, i in special.items():
        symbol[i] = text.encode()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    byte_id = np.zeros(256, np.int64)
    for c, b in to_byte.items():
        byte_id[b] = ids[c]
    return ByteBpe(
        np.array([ids[a] for a, _ in pairs], np.int64),
        np.array([ids[b] for _, b in pairs], np.int64),
        np.array([ids[a + b] for a, b in pairs], np.int64),
        symbol,
        byte_id,
        special,
    )


class PreTokens:
    """Cuts a text into pre-tokens and special tokens, a bounded piece at a time."""

    def __init__(self, special: dict[str, int], piece: int = 1 << 18) -> None:
        import regex

        self._find = regex.compile(PATTERN).findall
        self._special = special
        self._cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self._piece = piece

    def __call__(self, text: str):
        """Yields lists of pre-tokens; a special token is a list of its own, marked by being a tuple."""
        from panelwright.llm.text import safe_pieces

        for piece in safe_pieces(text, self._piece):
            begin = 0
            if self._cut is not None and any(s in piece for s in self._special):
                for m in self._cut.finditer(piece):
                    if m.start() > begin:
                        yield self._find(piece[begin : m.start()])
                    yield (m.group(),)
                    begin = m.end()
            if begin < len(piece):
                yield self._find(piece[begin:] if begin else piece)
