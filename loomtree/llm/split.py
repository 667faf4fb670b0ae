"""Texts over a token limit cut into overlapping pieces at natural boundaries.

Per text: the start offset of every token (one vectorised pass over code points), so the number of tokens before any
character is a binary search; and per kind of boundary a sorted array of the tokens it stands before. A piece ends at
the last boundary under its limit, taken from the strongest kind that leaves it at least ``FULL`` full, else the
last boundary of any kind, else a hard cut at the limit. The next piece starts ``overlap`` tokens earlier. Nothing is
looked at twice, so a text of any length takes linear time. Rows are independent: no shuffle but for the
removal of rows delivered twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtree.llm.arrow import emit, schema
from loomtree.session import ship

#: Strongest first.
KINDS = ("heading", "paragraph", "list item", "line", "sentence")
#: A stronger boundary is preferred to a later one only from this share of the limit on.
FULL = 0.75

_SPACES = np.zeros(129, bool)
_SPACES[[32, 9, 10, 13, 12]] = True
_ALNUM = np.zeros(129, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True

_LINE = re.compile(r"(?:\r\n|\n|\r)([ \t\f]*(?:\r\n|\n|\r))?[ \t\f\r\n]*")
_HEADING = re.compile(
    r"#{1,6}[ \t]|@[ \t]*-+[ \t]|\\(?:part|chapter|(?:sub){0,2}section|paragraph)\b|(?:Chapter|CHAPTER|Section|SECTION)[ \t]+\d|(?:\d+\.)+\d+[ \t]+[A-Z]"
)
_ITEM = re.compile(r"(?:[-*+•][ \t]|\(?(?:\d{1,3}|[A-Za-z]|[ivx]{1,5})[.)][ \t]|\\item\b)")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]}]*\s+(?=\S)")

PIECES = (
    "plan_id bigint,piece_no int,n_pieces int,total_tokens bigint,token_limit int,start_token bigint,end_token bigint,"
    "n_tokens int,overlap int,start_char bigint,end_char bigint,cut string,text string"
)


def token_starts(text: str) -> np.ndarray:
    """Start offsets of the tokens: longest runs of ASCII letters and digits, other single non-space characters."""
    if text.isascii():
        codes = np.frombuffer(text.encode("ascii"), np.uint8)
    else:
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)
    word = _ALNUM[codes]
    start = ~_SPACES[codes]
    start[1:] &= ~(word[1:] & word[:-1])
    return np.flatnonzero(start)


def boundaries(text: str, starts: np.ndarray) -> list[np.ndarray]:
    """For each of KINDS the sorted numbers of the tokens before which a unit of that kind, or a stronger one, begins."""
    at: list[list[int]] = [[] for _ in KINDS]
    after_heading = False
    for m in _LINE.finditer(text):
        here = m.end()
        heading = bool(_HEADING.match(text, here))
        kind = 0 if heading and not after_heading else 1 if m.group(1) is not None else 2 if _ITEM.match(text, here) else 3
        if after_heading:  # never leave a heading alone at the end of a piece if anything else will do
            kind = 4
        after_heading = heading
        at[kind].append(here)
    at[4].extend(m.end() for m in _SENTENCE.finditer(text))
    out, held = [], []
    for positions in at:
        held = held + positions
        tokens = np.unique(np.searchsorted(starts, np.array(held, np.int64)))
        out.append(tokens[(tokens > 0) & (tokens < len(starts))])
    return out


def _last(tokens: np.ndarray, least: int, most: int) -> int | None:
    k = int(np.searchsorted(tokens, most, "right")) - 1
    return int(tokens[k]) if k >= 0 and tokens[k] >= least else None


def cut(total: int, limit: int, overlap: int, edges: list[np.ndarray]) -> list[tuple[int, int, str]]:
    """(start, end, kind of cut) in tokens, for a text of ``total`` tokens over ``limit``."""
    overlap = max(0, min(overlap, limit - 1))
    pieces, start = [], 0
    while total - start > limit:
        least, most = start + overlap + 1, start + limit
        full = max(least, start + int(limit * FULL))
        end, kind = most, "hard"
        for name, tokens in zip(KINDS, edges):
            if (found := _last(tokens, full, most)) is not None:
                end, kind = found, name
                break
        else:
            if (found := _last(edges[-1], least, most)) is not None:
                end = found
                kind = next(n for n, tokens in zip(KINDS, edges) if _last(tokens, found, found) is not None)
        pieces.append((start, end, kind))
        start = end - overlap
    pieces.append((start, total, "end"))
    return pieces


def split_text(text: str, limit: int | None, overlap: int | None) -> Iterator[tuple]:
    """(piece_no, n_pieces, total, start, end, overlap, start_char, end_char, cut) of one text."""
    starts = token_starts(text)
    total = len(starts)
    if limit is None or limit < 1 or total <= limit:
        yield 0, 1, total, 0, total, 0, 0, len(text), "whole"
        return
    pieces = cut(total, limit, overlap or 0, boundaries(text, starts))
    before = 0
    for n, (a, b, kind) in enumerate(pieces):
        first = 0 if n == 0 else int(starts[a])
        last = len(text) if b == total else int(starts[b])
        yield n, len(pieces), total, a, b, before - a if n else 0, first, last, kind
        before = b


def split_oversized(plans: DataFrame, *, with_text: bool = True) -> DataFrame:
    """Pieces of every plan's raw_content: see PIECES; with_text=False leaves the text column null.

    Each piece has at most clean_token_target tokens and each after the first starts with exactly the last
    overlap_tokens tokens of the one before. Characters between tokens go with the token before them, so the pieces
    without their overlaps are the text.

    Defined results: a null or non-positive limit, and a text within its limit, gives one piece, cut 'whole'; a null
    overlap is 0, one not below the limit is taken as the limit less one; null text gives no piece, empty text one of
    no tokens; a plan delivered twice counts once; a stored token count is not used; other columns are ignored. A piece
    adds limit - overlap tokens at least, so the output has at most limit / (limit - overlap) times the text: an overlap
    just under the limit asks for nearly the whole limit again with every token.
    """
    ship(plans.sparkSession)
    rows = plans.select("plan_id", "raw_content", "clean_token_target", "overlap_tokens").where(
        F.col("raw_content").isNotNull()
    )
    if with_text:
        rows = rows.distinct()
    to = schema(PIECES)

    def run(batches):
        def rows_of():
            for b in batches:
                for plan, text, limit, overlap in zip(*(b.column(i).to_pylist() for i in range(4))):
                    for n, of, total, a, z, lap, first, last, kind in split_text(text, limit, overlap):
                        piece = text[first:last] if with_text else None
                        yield plan, n, of, total, limit, a, z, z - a, lap, first, last, kind, piece

        yield from emit(rows_of(), to, 2_000 if with_text else 20_000)

    out = rows.mapInArrow(run, PIECES)
    return out if with_text else out.distinct()


def oversized_plans(plans: DataFrame) -> DataFrame:
    """The plans whose text had to be cut."""
    pieces = split_oversized(plans, with_text=False)
    return pieces.where((F.col("piece_no") == 0) & (F.col("total_tokens") > F.col("token_limit"))).select("plan_id")

