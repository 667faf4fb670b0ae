"""Telling page furniture from running text in one scanned text.

Page numbers: a line that is nothing but a decorated number ("- 12 -", "[12]", "Page 12") is one by its form. Bare and
roman numbers, and numbers at the outer end of a line of furniture, are one only as members of a sequence: chains of
candidates whose values rise with the pages, as many as there are. Letters that scanners put for digits are read as digits.

Headers and footers: a line is a *candidate* if it is no wrapped running text (it would have had room for the next
word), no heading, formula or list line and no sentence end. A candidate is furniture if it carries a number of the
sequence, if its letters fuzzily repeat those of another candidate, or if it stands at a page edge, that is beside a
page number, a form feed or other furniture, or inside a sentence that runs on over it. A line that is drawn as a title
but has neither is *lone*: only the other texts of the same layout can tell what it is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np

# Letters read where a digit stands.
AS_DIGITS = str.maketrans("lI|OoSBZ", "11100582")
_DIGITS = r"[0-9lI|OoSBZ]{1,4}"
_ROMAN = r"[ivxlcdm]{1,8}|[IVXLCDM]{1,8}"
_DECORATED = re.compile(
    rf"(?:[-–—~*·•=|]{{1,3}}\s*({_DIGITS}|{_ROMAN})\s*[-–—~*·•=|]{{1,3}}|[\[<{{]\s*({_DIGITS}|{_ROMAN})\s*[\]>}}]"
    rf"|(?:[Pp]age|PAGE|[Pp]\.|[Pp]g\.|Seite|[Ss]\.|стр\.|с\.)\s*({_DIGITS}|{_ROMAN}))\.?"
)
_BARE = re.compile(rf"(?:\(\s*({_DIGITS})\s*\)|({_DIGITS})\.?)")
_ROMAN_LINE = re.compile(rf"({_ROMAN})\.?")
_LEADING = re.compile(rf"({_DIGITS})(?:\s{{2,}}|\s*[|·•—–]\s*)(\S.*\D)")
_TRAILING = re.compile(rf"(\D.*?\S)(?:\s{{2,}}|\s*[|·•—–]\s*)({_DIGITS})")
_NUMBERED = re.compile(r"[0-9lIO]{1,3}(?:\s*\.\s*[0-9lIO]{1,3})+\.?\s")
_MARKED = re.compile(r"(?:#{1,6}\s|@\s*-|\\|[-*+•]\s|>\s|\||```|\$\$|\([0-9a-z]{1,3}\)\s|[0-9]{1,3}[.)]\s)")
_CHAPTER = re.compile(r"(?:\w{5,8}\s\s?[0-9lIO]\w{0,3}\s?\.\s?|[0-9lIO]{1,3}\.?\s(?=[A-Z.]))")
_MARKS = frozenset("#@\\-*+•>|`$(0123456789lIO")
_FORMULA = re.compile(r"[=<>≤≥≠±∑∫\\^]|\(\d+\.\d+\)")
_HYPHENS = "-¬\xad‐"
_STARTS, _ENDS = frozenset("0123456789lI|OoSBZ-–—~*·•=[<{("), frozenset("0123456789lI|OoSBZ-–—~*·•=]>}).")
_DIGIT = re.compile(r"[0-9]")
_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
#: Letters of two lines of furniture agree in this share, as scanning noise alters some.
ALIKE = 0.8
#: The same for lines that could be running text.
SURE = 0.9
#: Characters that running text leaves free at most at the end of a line.
ROOM = 18
#: So few distinct keys are compared without an index.
FEW = 24
#: Words of a title, and roman page numbers, at most.
TITLE_WORDS, MOST_ROMAN = 6, 400
#: Pages whose number is lost, at most, between two members of a sequence.
LOST = 3
#: Lines of a page, at most: numbers farther apart do not follow each other.
PAGE = 200


def _roman(text: str) -> int | None:
    total, values = 0, [_VALUES[c] for c in text.lower()]
    for a, b in zip(values, [*values[1:], 0]):
        total += a if a >= b else -a
    return total if total and _to_roman(total) == text.lower() else None


def _to_roman(n: int) -> str:
    out = ""
    for value, sign in zip(
        (1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split()
    ):
        out += sign * (n // value)
        n %= value
    return out


def _arabic(text: str) -> int | None:
    if not any(c.isdigit() for c in text) and len(text) > 1:
        return None
    text = text.translate(AS_DIGITS)
    return int(text) if text.isdigit() else None


def _numbers(stripped: list[str]) -> list[tuple[int, int, str]]:
    """(line, value, form) of every line that may show a page number; form 'd', 'b', 'r' or 'h' (inside furniture)."""
    out = []
    for i, s in enumerate(stripped):
        if not s or len(s) > 120 or len(s) > 18 and (s[0] not in _STARTS and s[-1] not in _ENDS or not _DIGIT.search(s)):
            continue
        if m := _DECORATED.fullmatch(s):
            text = next(g for g in m.groups() if g)
            out.append((i, _arabic(text) or _roman_or_none(text) or -1, "d"))
            continue
        if m := _BARE.fullmatch(s):
            if (value := _arabic(m.group(1) or m.group(2))) is not None and any(c.isdigit() for c in s):
                out.append((i, value, "b"))
        if m := _ROMAN_LINE.fullmatch(s):
            if (value := _roman(m.group(1))) is not None:
                out.append((i, value, "r"))
                continue
        for pattern, group in ((_LEADING, 1), (_TRAILING, 2)):
            m = pattern.fullmatch(s)
            if m and any(c.isdigit() for c in m.group(group)) and (value := _arabic(m.group(group))) is not None:
                out.append((i, value, "h"))
    return out


def _roman_or_none(text: str) -> int | None:
    return _roman(text) if re.fullmatch(_ROMAN, text) else None


def _chains(found: list[tuple[int, int, str]]) -> set[tuple[int, str]]:
    """The members of all sequences of two or more, the heaviest first: numbering may restart, or skip many pages."""
    members: set[tuple[int, str]] = set()
    while len(found) > 1 and (more := _disjoint(found)):
        members |= {(found[k][0], found[k][2]) for k in more}
        found = [x for k, x in enumerate(found) if k not in more]
    return members


def _disjoint(found: list[tuple[int, int, str]]) -> set[int]:
    """Members of disjoint sequences that rise by one a page, or by a few where numbers are lost.

    One pass: for each value and way of writing the best sequence that ends in it is kept. Sequences are then taken by
    falling weight, each back to its start or to a member of a heavier one, which it goes on if that is the last.
    """
    weight = {"d": 3.0, "h": 2.0, "r": 1.1, "b": 1.0}
    mates = {"r": ("r", "d"), "d": ("r", "d", "a"), "h": ("d", "a"), "b": ("d", "a")}
    best: list[tuple[float, int]] = []
    ends: dict[tuple[int, str], int] = {}
    late: list[int] = []  # those of the current line, which cannot follow each other
    for j, (line, value, form) in enumerate(found):
        if late and found[late[0]][0] < line:
            for k in late:
                at = (found[k][1], found[k][2] if found[k][2] in "rd" else "a")
                if at not in ends or best[ends[at]][0] <= best[k][0] or found[k][0] - found[ends[at]][0] > PAGE:
                    ends[at] = k
            late = []
        top = (weight[form], -1)
        for step in range(1, LOST + 2):
            for mate in mates[form]:
                i = ends.get((value - step, mate))
                if i is not None and value >= 0 and line - found[i][0] <= step * PAGE:
                    total = best[i][0] + weight[form] - 0.4 * (step - 1)
                    if total > top[0]:
                        top = (total, i)
        best.append(top)
        late.append(j)
    taken: set[int] = set()
    followed: set[int] = set()
    for at in sorted(range(len(best)), key=lambda k: -best[k][0]):
        chain = []
        while at >= 0 and at not in taken:
            chain.append(at)
            at = best[at][1]
        if len(chain) > 1 or chain and at >= 0 and at not in followed:
            taken.update(chain)
            followed.update(chain[1:], [at])
    return taken


def letters(text: str) -> str:
    return re.sub(r"[\W\d_]+", "", text.lower())


@lru_cache(1 << 16)
def alike(a: str, b: str, least: float = ALIKE) -> bool:
    """Whether two normalised lines repeat each other but for scanning noise."""
    if a == b:
        return True
    if not a or not b or min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


def is_heading(s: str) -> bool:
    return s[:1] in _MARKS and bool(_MARKED.match(s) or _NUMBERED.match(s))


def furniture(lines: list[str]) -> dict[int, str]:
    """'header' or 'page_number' for each line (from 0) that is furniture."""
    return told(lines)[0]


def told(lines: list[str], known: Iterable[int] = ()) -> tuple[dict[int, str], list[int]]:
    """The furniture, with ``known`` headers among it, and the lone lines: titles without page edge or repetition."""
    stripped = [x.strip() for x in lines]
    lengths = sorted(len(x.rstrip()) for x, s in zip(lines, stripped) if s)
    if not lengths:
        return {}, []
    width = lengths[min(len(lengths) - 1, int(len(lengths) * 0.93))]
    numbers = _numbers(stripped)
    members = _chains(numbers)
    romans = [i for i, value, form in numbers if form == "r" and value <= MOST_ROMAN]
    if any(len(stripped[i]) > 1 or (i, "r") in members for i in romans):
        members |= {(i, "r") for i in romans}
    out: dict[int, str] = dict.fromkeys(known, "header")
    for i, _, form in numbers:
        if form == "d" or form in "br" and (i, form) in members:
            out[i] = "page_number"
        elif form == "h" and (i, form) in members and not is_heading(stripped[i]):
            out[i] = "header"
    following = [-1] * len(lines)  # next line that is not blank
    nxt = -1
    for i in range(len(lines) - 1, -1, -1):
        following[i] = nxt
        if stripped[i]:
            nxt = i
    candidates = {}
    for i, s in enumerate(stripped):
        if not s or s[1:5].islower() and s.count(" ") > TITLE_WORDS and "|" not in s and "  " not in s and "." not in s[:14]:
            continue  # running text, as most lines are
        if i not in out and (sure := _candidate(lines, stripped, i, following[i], width)) is not None:
            candidates[i] = sure
    _edges(lines, stripped, following, width, candidates, out)
    open_ = {i: sure for i, sure in candidates.items() if i not in out}
    repeated = _repeated(stripped, open_, [i for i in {*candidates, *out} if out.get(i, "header") == "header"])
    if repeated:
        out.update((i, "header") for i in repeated if open_[i])
        _edges(lines, stripped, following, width, {i: sure or i in repeated for i, sure in open_.items()}, out)
    _lone_numbers(lines, numbers, out)
    return out, [i for i, sure in open_.items() if sure and i not in out and _drawn(stripped[i])]


def _repeated(stripped: list[str], candidates: dict[int, bool], known: list[int]) -> set[int]:
    """Candidates whose letters repeat, but for noise, those of another or of known furniture, anywhere in the text."""
    keys = {i: letters(stripped[i]) for i in {*candidates, *known}}
    times = Counter(keys.values())
    found = {i for i in candidates if len(keys[i]) >= 4 and times[keys[i]] > 1}
    asking = {(keys[i], ALIKE if sure else SURE) for i, sure in candidates.items() if i not in found and len(keys[i]) >= 4}
    if not asking:
        return found
    keeper = Keys(times)
    alike_ = {ask for ask in asking if keeper.repeats(*ask)}
    return found | {i for i, sure in candidates.items() if (keys[i], ALIKE if sure else SURE) in alike_}


def _shared(n: int, least: float) -> int:
    """Pairs of neighbouring letters that two keys of ``n`` letters together share at least if they are alike.

    Of m common letters in order, each letter that the keys do not share parts at most one of the m - 1 pairs.
    """
    m = math.ceil(least * n / 2 - 1e-9)
    return 3 * m - 1 - n


def _pairs(key: str) -> list[tuple[str, int]]:
    """The pairs of neighbouring letters, numbered where they repeat."""
    times: Counter = Counter()
    out = []
    for k in range(len(key) - 1):
        pair = key[k : k + 2]
        out.append((pair, times[pair]))
        times[pair] += 1
    return out


class Keys:
    """Distinct keys that are asked for others like them; the filter before ``alike`` loses none.

    Two alike keys share at least ``_shared`` pairs. The keys of each pair are listed, and a key's lists are counted
    together, so only keys with enough pairs in common are compared.
    """

    def __init__(self, keys: Iterable[str]) -> None:
        self.keys = list(dict.fromkeys(keys))
        if len(self.keys) <= FEW:
            return
        lists: dict[tuple[str, int], list[int]] = {}
        for k, key in enumerate(self.keys):
            for x in _pairs(key):
                lists.setdefault(x, []).append(k)
        self.index = {x: np.array(found, np.int32) for x, found in lists.items()}
        self.sizes = np.array([len(key) for key in self.keys])

    def repeats(self, key: str, least: float = ALIKE) -> bool:
        """Whether a key other than ``key`` is alike."""
        return next(self.like(key, least), None) is not None

    def like(self, key: str, least: float = ALIKE) -> Iterator[str]:
        """The keys other than ``key`` that are alike."""
        near: Iterable[str] = self.keys
        if len(self.keys) > FEW:
            lists = [self.index[x] for x in _pairs(key) if x in self.index]
            if not lists:
                return
            counts = np.bincount(np.concatenate(lists), minlength=len(self.keys))
            some = np.flatnonzero(counts)
            need = [max(1, _shared(n, least)) for n in range(len(key), len(key) + int(len(key) / least) + 2)]
            more = self.sizes[some]
            some, more = some[more < len(need)], more[more < len(need)]
            near = [self.keys[k] for k in some[counts[some] >= np.array(need)[more]]]
        yield from (other for other in near if other != key and alike(key, other, least))


def _candidate(lines: list[str], stripped: list[str], i: int, following: int, width: int) -> bool | None:
    """None for what cannot be furniture, True for what cannot be running text, False for what could be either."""
    s = stripped[i]
    if len(s) < 4 or not s[0].isalnum() and "\f" not in lines[i] and s[0] != ".":
        return None
    words = s.split()
    drawn = "|" in s or not s[1:5].islower() and _capitals(s)
    if len(words) > 12 or len(words) > TITLE_WORDS + 1 and not drawn and not _CHAPTER.match(s):
        return None
    if is_heading(s) or _FORMULA.search(s) or s[0] in _STARTS and _BARE.fullmatch(s) or len(s) < 10 and _ROMAN_LINE.fullmatch(s):
        return None
    if drawn:
        return True
    if not any(c.isalpha() for c in s):
        return None
    if s[-1] in "!?:;," + _HYPHENS or s[-1] == "." and s[-2:-1].isalnum():
        return None
    rest = _CHAPTER.sub("", s)
    if re.search(r"[.!?;:]\s", rest) or "," in rest and len(words) > TITLE_WORDS:
        return None
    if _title(s):
        return True
    numbered = _LEADING.fullmatch(s) or _TRAILING.fullmatch(s)
    if len(words) > TITLE_WORDS + bool(numbered):
        return None
    if s[0].islower():  # a lost or misread capital
        return False
    if numbered and re.search(r"\s{2,}", s):
        return True
    room = width - len(lines[i].rstrip())
    if room >= ROOM:
        return True
    if following == i + 1 and room > len(re.match(r"\S*", stripped[following]).group()):
        return True
    return False


def _drawn(s: str) -> bool:
    """Whether a line looks like furniture: a title, or one with a number at its outer end."""
    return _title(s) or bool(_LEADING.fullmatch(s) or _TRAILING.fullmatch(s))


def _capitals(s: str) -> bool:
    capitals = sum(map(str.isupper, s))
    return capitals >= 4 and capitals >= 0.8 * sum(map(str.isalpha, s))


def _title(s: str) -> bool:
    """Drawn as a title: capitals, or every long word capitalised, or a chapter's name."""
    words = [w for w in re.findall(r"[^\W\d_]+", s) if len(w) > 3]
    return "|" in s or _capitals(s) or bool(_CHAPTER.match(s)) or len(words) > 1 and all(w[0].isupper() for w in words)


def _edges(
    lines: list[str], stripped: list[str], following: list[int], width: int, candidates: dict[int, bool], out: dict[int, str]
) -> None:
    """Sure or repeated candidates beside a page edge, and any that ends the text, until no more are found."""
    preceding = {k: i for i, k in enumerate(following) if k >= 0 and stripped[i]}
    changed = True
    while changed:
        changed = False
        for i, sure in candidates.items():
            if i in out:
                continue
            before, after = preceding.get(i), following[i] if following[i] >= 0 else None
            if sure:
                edge = "\f" in lines[i] or before is None or before in out
                edge = edge or after is not None and (after in out or "\f" in lines[after])
                edge = edge or _within(lines, stripped, before, i, after, width)
            else:
                edge = False
            # a title at the very end, behind furniture or alone
            edge = edge or after is None and (before in out or i > 0 and not stripped[i - 1])
            if edge:
                out[i] = "header"
                changed = True


def _within(lines: list[str], stripped: list[str], before: int | None, i: int, after: int | None, width: int) -> bool:
    """Whether a title that is no wrapped text stands inside a sentence, as only the end of a page puts it there."""
    if before is None or after is None or not stripped[after][0].islower() or not _drawn(stripped[i]):
        return False
    s = stripped[before]
    if not s[-1].isalnum() and s[-1] not in ",;" + _HYPHENS or is_heading(s) or _FORMULA.search(s) or _FORMULA.search(stripped[after]):
        return False
    room = width - len(lines[i].rstrip())
    apart = "|" in stripped[i] or "  " in stripped[i] or _capitals(stripped[i]) or room >= ROOM
    return apart and width - len(lines[before].rstrip()) < ROOM


def _lone_numbers(lines: list[str], numbers: list[tuple[int, int, str]], out: dict[int, str]) -> None:
    """Without a sequence, a roman number counts, and a bare one beside furniture, a form feed or the end."""
    if any(kind == "page_number" for kind in out.values()):
        return
    last = max((i for i, x in enumerate(lines) if x.strip()), default=-1)
    for i, value, form in numbers:
        if form in "br" and value < 1000:
            near = [k for k in (i - 1, i + 1) if 0 <= k < len(lines)]
            edge = i == last or any(out.get(k) == "header" or "\f" in lines[k] for k in near)
            if edge or form == "r" and len(lines[i].strip()) > 1:
                out[i] = "page_number"
