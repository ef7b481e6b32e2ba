"""Byte-level BPE ids for Python tasks.

Ids are those of the given vocabulary file of the `tokenizers` library in its default setting: the file's added tokens
become their own ids where they stand in a text (`ids_with_added`; `ids` reads them as ordinary text). The file's ranks
are handed to a faster encoder of the same algorithm; that both agree is tested.
"""

from __future__ import annotations

import json
from functools import partial

import numpy as np

#: Fixed value: the vocabulary's pre-tokenizer pattern, with possessive repeats (same matches, less backtracking).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def default_vocabulary() -> str:
    """Path on this machine of the vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_symbol() -> dict[str, int]:
    """The vocabulary file writes each byte as a printable character: printable Latin-1 as itself, the others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """ids(text), ids_with_added(text), plus the byte strings of all ids."""

    def __init__(self, vocabulary: str | None = None):
        import tiktoken

        with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
            described = json.load(f)
        special = {t["content"]: t["id"] for t in described.get("added_tokens", ())}
        of = _byte_of_symbol()
        ranks = {bytes(of[c] for c in k): v for k, v in described["model"]["vocab"].items() if k not in special}
        self.pieces = {v: k for k, v in ranks.items()} | {v: k.encode() for k, v in special.items()}
        encoding = tiktoken.Encoding("ordinary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.ids = encoding.encode_ordinary
        self.ids_with_added = partial(encoding.encode, allowed_special="all")

    def flags(self, wanted) -> np.ndarray:
        """A table over ids: whether `wanted` holds for the id's bytes."""
        table = np.zeros(max(self.pieces) + 1, bool)
        table[[k for k, v in self.pieces.items() if wanted(v)]] = True
        return table
