"""Counting tokens of a public tokenizer's rank file, whose path is a parameter and which is sent along with the job."""

from __future__ import annotations

from loomtree.functions.bpe import RANKS, encoding, shipped

__all__ = ["RANKS", "count", "encoding", "shipped"]


def count(text: str, path: str = RANKS) -> int:
    return len(encoding(path).encode_ordinary(text))
