"""Repairing the text of scanned pages.

1. Every word of all texts is counted (``vocabulary``): halves of words broken over lines are left out.
2. Wrong readings are found by word type, not by occurrence: a type is a misread form of another if undoing one
   scanner confusion gives a word at least ``RATIO`` times as frequent. One join of the vocabulary with itself.
3. Each text is looked at once, and the few with a lone title again. Page furniture comes from ``pages.furniture``. A word broken at a line's end is joined
   with the first word of the next line of running text; words that are not surely right become questions.
4. The most frequent right words, ``SURE_WORDS`` at most, are broadcast as a filter: they answer nearly all questions on
   the spot. What they cannot answer meets the whole vocabulary in one join by the same rules, and a word that the
   filter lacks is less frequent than all it holds, so nothing depends on its size.
5. A lone title (``pages``) is a header if its letters fuzzily repeat a header or a lone title of another text of its
   run. Only letters of titles travel for that: each run's headers in blocks, each block with all lone titles of the run.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtree.checkpoints import checkpointed
from loomtree.llm.arrow import emit, schema
from loomtree.llm.pages import Keys, is_heading, letters, told
from loomtree.session import ship

# What a scanner reads, and what may stand on the page.
CONFUSIONS = [
    ("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("c", "e"), ("e", "c"), ("f", "t"), ("b", "h"),
    ("0", "o"), ("0", "O"), ("1", "i"), ("1", "l"), ("1", "I"), ("5", "s"), ("5", "S"), ("9", "g"), ("6", "b"), ("8", "B"),
    ("m", "rn"), ("d", "cl"),
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
]
#: How many times as frequent the right word must be.
RATIO = 8
#: Shorter words are not questioned.
SHORTEST = 4
#: The filter's size: some 4 MB.
SURE_WORDS = 65_536
HYPHENS = "-¬\xad‐"
_TAILS = frozenset(HYPHENS + " \t")

_WORD = re.compile(r"[^\W_]+(?:[-’'][^\W_]+)*")
_BROKEN = re.compile(rf"([^\W_]+(?:[-’'][^\W_]+)*)[{HYPHENS}][ \t]*$")
_GOES_ON = re.compile(r"[ \t]*([^\W_]+(?:[-’'][^\W_]+)*)")
_LINE_HYPHEN = re.compile(rf"[{HYPHENS}][ \t]*\n\s*")
_CONFUSED = re.compile("|".join(sorted({a for a, _ in CONFUSIONS}, key=len, reverse=True)))


def _broken(line: str) -> re.Match | None:
    """The first half of a word that a line without blanks at its end breaks off; it has no blank in it."""
    return _BROKEN.search(line, line.rfind(" ") + 1)


@lru_cache(1 << 16)
def _read_as(word: str) -> frozenset[str]:
    return frozenset(readings(word))


def readings(word: str) -> list[str]:
    """The words that ``word`` may be a wrong reading of, by one confusion."""
    found = []
    for read, drawn in CONFUSIONS:
        at = word.find(read)
        while at >= 0:
            found.append(word[:at] + drawn + word[at + len(read) :])
            at = word.find(read, at + 1)
    return found


def _without_broken(text: str) -> str:
    """The text without the words that are broken over lines."""
    parts, done = [], 0
    for m in _LINE_HYPHEN.finditer(text):
        start = m.start()
        if start <= done or not text[start - 1].isalnum():
            continue
        begin = max(text.rfind(" ", done, start), text.rfind("\n", done, start)) + 1 or done
        ends = [e for e in (text.find(" ", m.end()), text.find("\n", m.end())) if e >= 0]
        parts.append(text[done:begin])
        done = min(ends, default=len(text))
    parts.append(text[done:])
    return " ".join(parts)


def vocabulary(contexts: DataFrame) -> DataFrame:
    """(word, n) over all texts; each task counts before it sends, blank-separated strings first and words then."""
    ship(contexts.sparkSession)
    to = schema("word string,n bigint")

    def words_of(strings: Counter):
        counts: Counter = Counter()
        for string, n in strings.items():
            for word in _WORD.findall(string):
                if not word.isdigit():
                    counts[word] += n
        yield from emit(counts.items(), to)

    def run(batches):
        strings: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                strings.update(_without_broken(text).split())
            if len(strings) > 500_000:
                yield from words_of(strings)
                strings = Counter()
        yield from words_of(strings)

    rows = contexts.select("raw_content").where(F.col("raw_content").isNotNull()).mapInArrow(run, "word string,n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(words: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """(word, n, reading): reading is the right word where ``word`` is a wrong reading, else null."""
    ship(words.sparkSession)
    to = schema("word string,n bigint,reading string")

    def run(batches):
        def rows():
            for b in batches:
                for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if len(word) >= SHORTEST and _CONFUSED.search(word):
                        for reading in readings(word):
                            yield word, n, reading

        yield from emit(rows(), to)

    asked = words.mapInArrow(run, "word string,n bigint,reading string")
    known = words.select(F.col("word").alias("reading"), F.col("n").alias("m"))
    right = (
        asked.join(known, "reading")
        .where(F.col("m") >= F.col("n") * ratio)
        .groupBy("word")
        .agg(F.max_by("reading", F.struct("m", "reading")).alias("reading"))
    )
    return words.join(right, "word", "left").select("word", "n", "reading")


ASKED = "context_id bigint,line_no int,kind string,slot string,form string,cost int,value string"
TITLES = ASKED + ",run_id bigint"
#: Headers of a run are set against its lone titles in so many blocks.
BLOCKS = 16


def _questionable(word: str, sure: dict[str, int]) -> bool:
    """Whether a word is not surely right."""
    return word not in sure and len(word) >= SHORTEST and _CONFUSED.search(word) is not None


class Seen:
    """Blank-separated strings of earlier texts, with and without a word that must be questioned."""

    def __init__(self, most: int = 500_000) -> None:
        self.clear: set[str] = set()
        self.doubtful: set[str] = set()
        self.most = most

    def forget(self) -> None:
        if len(self.clear) + len(self.doubtful) > self.most:
            self.clear, self.doubtful = set(), set()


def examine(text: str, sure: dict[str, int], seen: Seen, known: list[int] | None = None) -> Iterator[tuple]:
    """(line_no, kind, slot, form, cost, value): cost 2 is an answer, 0 and 1 forms that the lexicon must weigh,
    3 and 4 the halves of a word, which must both be right words if it is to keep its hyphen (form null: it is one).

    Without ``known``, the lines that other texts of the run have told to be headers, a text with lone titles gives only
    its titles (kinds 'lone' and 'shown', the letters in slot) and itself (kind 'text').
    """
    lines = text.split("\n")
    kinds, lone = told(lines, known or ())
    if known is None:
        yield from ((0, "shown", key, None, 2, "") for key in {letters(lines[i]) for i, k in kinds.items() if k == "header"})
        if lone:
            yield 0, "text", "", None, 2, text
            yield from ((i + 1, "lone", letters(lines[i]), None, 2, "") for i in lone)
            return
    for i, kind in sorted(kinds.items()):
        yield i + 1, kind, "", None, 2, ""
    running = [i for i, line in enumerate(lines) if i not in kinds and line and not line.isspace()]
    halves: set[int] = set()
    open_: set[int] = set()
    for n, i in enumerate(running):
        line = lines[i]
        if line[-1] not in _TAILS:  # most lines
            continue
        line = line.rstrip(" \t")
        if line[-1] not in HYPHENS or not (broken := _broken(line)):
            continue
        open_.add(i)
        if n + 1 == len(running):
            continue
        follows = _GOES_ON.match(lines[running[n + 1]])
        head = broken.group(1)
        if not follows or not head[-1].isalpha() or follows.group(1)[0].isupper() and not head.isupper():
            continue
        halves.add(running[n + 1])
        yield from _joined(i + 1, head, follows.group(1), sure)
    strings = set(text.split())
    fresh = strings - seen.clear - seen.doubtful
    for string in fresh:
        (seen.doubtful if any(_questionable(w, sure) for w in _WORD.findall(string)) else seen.clear).add(string)
    doubtful = strings & seen.doubtful
    seen.forget()
    if doubtful:
        for i in _lines_with(text, doubtful):
            if i not in kinds and not is_heading(lines[i].strip()):
                words = _WORD.findall(lines[i])
                for word in words[(i in halves) : len(words) - (i in open_)]:
                    if _questionable(word, sure):
                        yield i + 1, "misread", word, word, 0, None


def _lines_with(text: str, strings: set[str]) -> list[int]:
    """The lines of a text that hold one of some strings, which have no blanks."""
    if len(strings) > 200:
        return [i for i, line in enumerate(text.split("\n")) if not strings.isdisjoint(line.split())]
    places = set()
    for string in strings:
        at = text.find(string)
        while at >= 0:
            places.add(at)
            at = text.find(string, at + len(string))
    found, line, done = [], 0, 0
    for at in sorted(places):
        ends = text.count("\n", done, at)
        if ends or not found:
            line += ends
            found.append(line)
        done = at
    return found


def _forms(word: str) -> set[str]:
    return {word, word.lower(), word.capitalize()}


def _joined(line: int, head: str, tail: str, sure: dict[str, int]) -> Iterator[tuple]:
    whole, hyphened = head + tail, f"{head}-{tail}"
    weight = {x: max(sure.get(form, 0) for form in _forms(x)) for x in (whole, hyphened)}
    if max(weight.values()):  # what the filter does not hold is less frequent than all it holds
        yield line, "hyphen", whole, None, 2, whole if weight[whole] >= weight[hyphened] else hyphened
        return
    parts = [w for w in (head.split("-")[-1], tail.split("-")[0])]
    yield line, "hyphen", whole, None, 2, whole
    if all(len(w) >= 3 for w in parts):
        for cost, part in zip((3, 4), parts):
            known = part in sure or part.lower() in sure
            for form in {None} if known else {part, part.lower()}:
                yield line, "hyphen", whole, form, cost, hyphened
    for value in (whole, hyphened):
        for form in _forms(value):
            yield line, "hyphen", whole, form, 0, value
        if _CONFUSED.search(value):
            for reading in readings(value):
                for form in {reading, reading.lower()}:
                    yield line, "hyphen", whole, form, 1, reading


def _sure(words: DataFrame, most: int) -> dict[str, int]:
    """The right words more frequent than some bound, ``most`` of them at most; a word outside is never more frequent."""
    right = words.where(F.col("reading").isNull() & (F.col("n") > 1)).select("word", "n")
    rows = right.orderBy(F.desc("n"), "word").limit(most + 1).collect()
    least = rows[most].n if len(rows) > most else 0
    return {r.word: r.n for r in rows if r.n > least}


def _answers(asked: DataFrame, words: DataFrame) -> DataFrame:
    """Weighs the forms of each question. Answers carry a key of their own, so that no key is hot."""
    alone = F.concat(F.lit("\u0001"), F.col("context_id").cast("string"), F.lit(" "), F.col("line_no").cast("string"))
    keyed = asked.withColumn("key", F.coalesce("form", alone))
    lex = words.select(F.col("word").alias("key"), "n", "reading")
    # one shuffle by text serves the questions, their distinct answers and whatever is gathered by text later
    joined = keyed.join(lex, "key", "left").repartition("context_id")

    def best(cost: int, what: Column | str) -> Column:
        chosen = F.when((F.col("cost") == cost) & (F.col("n") > 0), F.struct("n", F.col("value").alias("v")))
        return F.max(chosen)[what]

    def half(cost: int) -> Column:
        word = F.col("form").isNull() | (F.col("n") > 0) & F.col("reading").isNull()
        return F.max(F.when((F.col("cost") == cost) & word, F.col("value")))

    right = (F.col("cost") == 0) & (F.col("n") > 1) & F.col("reading").isNull()
    found = joined.groupBy("context_id", "line_no", "kind", "slot").agg(
        F.max(F.when(right, F.struct("n", F.when(F.col("value") == F.col("slot"), 1).otherwise(0).alias("w"), F.col("value").alias("v"))))["v"].alias("right"),
        F.max("reading").alias("reading"),
        best(0, "n").alias("n0"),
        best(0, "v").alias("v0"),
        best(1, "n").alias("n1"),
        best(1, "v").alias("v1"),
        F.max(F.when(F.col("cost") == 2, F.col("value"))).alias("given"),
        half(3).alias("first"),
        half(4).alias("second"),
    )
    seen = F.greatest(F.coalesce("n0", F.lit(0)), F.lit(1))
    fixed = (
        F.when(F.col("kind") == "misread", F.col("reading"))
        .when(F.col("right").isNotNull(), F.col("right"))
        .when(F.col("n1") >= seen * RATIO, F.col("v1"))
        .otherwise(F.coalesce("v0", F.when(F.col("first").isNotNull(), F.col("second")), "given"))
    )
    return found.select("context_id", "line_no", "kind", fixed.alias("fixed")).where(F.col("fixed").isNotNull()).distinct()


def scan_repairs(contexts: DataFrame, *, sure_words: int = SURE_WORDS) -> DataFrame:
    """(context_id, line_no, kind, fixed): every line that is furniture, ends in a broken word or holds a misread one.

    Defined results: null and empty texts have no repairs; lines end at line feeds only; a row delivered twice counts
    once; a word broken over lines whose next line is missing, or starts a new sentence, is no hyphen; with no
    evidence in the corpus a word keeps its hyphen only if both halves are words; ties go to the joined form; empty
    tables give no rows; without a run_id no other text is of the same run; other columns are ignored. ``sure_words`` bounds
    the broadcast filter and changes no row. Counts words when called (one pass), then examines lazily.
    """
    words = checkpointed(lexicon(checkpointed(vocabulary(contexts))))
    sent = contexts.sparkSession.sparkContext.broadcast(_sure(words, sure_words))
    to, titles_to = schema(ASKED), schema(TITLES)

    def first(batches):
        def rows():
            sure, seen = sent.value, Seen()
            for b in batches:
                for ident, text, run in zip(*(b.column(i).to_pylist() for i in range(3))):
                    for row in examine(text, sure, seen):
                        yield ident, *row, run if row[0] == 0 or row[1] == "lone" else None

        yield from emit(rows(), titles_to)

    def again(batches):
        def rows():
            sure, seen = sent.value, Seen()
            for b in batches:
                for ident, text, known in zip(*(b.column(i).to_pylist() for i in range(3))):
                    for row in examine(text, sure, seen, [n - 1 for n in known or []]):
                        yield ident, *row

        yield from emit(rows(), to)

    run_id = F.col("run_id").cast("bigint") if "run_id" in contexts.columns else F.lit(None).cast("bigint")
    texts = contexts.select("context_id", "raw_content", run_id.alias("run_id")).where(F.col("raw_content").isNotNull())
    looked = checkpointed(texts.mapInArrow(first, TITLES))
    known = _repeated_titles(looked).groupBy("context_id").agg(F.collect_set("line_no").alias("known"))
    put_off = looked.where("kind = 'text'").select("context_id", F.col("value").alias("raw_content")).distinct()
    late = put_off.join(known, "context_id", "left").select("context_id", "raw_content", "known").mapInArrow(again, ASKED)
    return _answers(looked.where("kind NOT IN ('lone', 'shown', 'text')").drop("run_id").unionByName(late), words)


def _repeated_titles(looked: DataFrame) -> DataFrame:
    """(context_id, line_no) of the lone titles that repeat a title of another text of their run."""
    titles = looked.where("kind IN ('lone', 'shown') AND run_id IS NOT NULL AND length(slot) >= 4")
    lone = titles.where("kind = 'lone'").select("run_id", "context_id", "line_no", "slot").distinct()
    keys = titles.join(lone.select("run_id").distinct(), "run_id", "left_semi").groupBy("run_id", "slot")
    blocked = keys.agg(F.min("context_id").alias("least"), F.max("context_id").alias("most")).withColumn(
        "block", F.pmod(F.hash("slot"), F.lit(BLOCKS))
    )
    asking = lone.join(blocked.select("run_id", "block").distinct(), "run_id")

    def meet(left, right):
        asked: dict[str, list[tuple[int, int]]] = {}
        for ident, line, key in zip(*(left.column(c).to_pylist() for c in ("context_id", "line_no", "slot"))):
            asked.setdefault(key, []).append((ident, line))
        keys, found = Keys(asked), set()
        for other, least, most in zip(*(right.column(c).to_pylist() for c in ("slot", "least", "most"))):
            for key in (*keys.like(other), *([other] if other in asked else [])):
                found |= {(ident, line) for ident, line in asked[key] if least != ident or most != ident}
        return pa.table({"context_id": pa.array([x for x, _ in found], "int64"), "line_no": pa.array([x for _, x in found], "int32")})

    by = ("run_id", "block")
    asking, blocked = (x.toDF(*x.columns) for x in (asking, blocked))  # columns of their own, as both come from titles
    return asking.groupBy(*by).cogroup(blocked.groupBy(*by)).applyInArrow(meet, "context_id bigint, line_no int")


REPAIRED = "context_id bigint,paragraph_no int,text string"


def repair(text: str, fixes: list[tuple[int, str, str]]) -> list[str]:
    """The paragraphs of a text without furniture, with broken and misread words put right."""
    lines = text.split("\n")
    gone = {n for n, kind, _ in fixes if kind in ("header", "page_number")}
    hyphen = {n: fixed for n, kind, fixed in fixes if kind == "hyphen"}
    wrong: dict[int, list[str]] = {}
    for n, kind, fixed in fixes:
        if kind == "misread":
            wrong.setdefault(n, []).append(fixed)
    paragraphs: list[list[str]] = [[]]
    carried = None
    for n, line in enumerate(lines, 1):
        if n in gone:
            continue
        s = line.strip()
        if not s:
            if paragraphs[-1] and carried is None and paragraphs[-1][-1][-1:] in ".!?:)∎□":
                paragraphs.append([])
            continue
        if n in wrong:
            s = _WORD.sub(lambda m: next((r for r in wrong[n] if r in _read_as(m.group())), m.group()), s)
        if is_heading(s):
            if carried is not None:
                paragraphs[-1].append(carried)
                carried = None
            paragraphs += [[s], []] if paragraphs[-1] else [[]]
            if not paragraphs[-2:-1] or paragraphs[-2] != [s]:
                paragraphs[-1].append(s)
                paragraphs.append([])
            continue
        if carried is not None:  # the broken word is whole now, and keeps what followed its second half
            m = _GOES_ON.match(s)
            s = carried + s[m.end() :] if m else carried + s
            carried = None
        if n in hyphen and (m := _broken(s)):
            carried = s[: m.start()] + hyphen[n]
            continue
        paragraphs[-1].append(s)
    if carried is not None:
        paragraphs[-1].append(carried)
    return [" ".join(p) for p in paragraphs if p]


def repaired_texts(contexts: DataFrame) -> DataFrame:
    """(context_id, paragraph_no, text): continuous paragraphs; a text's own repairs are bounded by its lines."""
    fixes = scan_repairs(contexts)
    each = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "kind", "fixed"))), lambda x: F.concat_ws("\t", x["line_no"], x["kind"], x["fixed"]))
    per = fixes.groupBy("context_id").agg(F.array_join(each, "\n").alias("fixes"))  # no word has a blank
    texts = contexts.select("context_id", "raw_content").where(F.col("raw_content").isNotNull())
    once = texts.repartition("context_id").distinct()  # one shuffle serves the removal of repeats and the join
    to = schema(REPAIRED)

    def run(batches):
        def rows():
            for b in batches:
                for ident, text, found in zip(*(b.column(i).to_pylist() for i in range(3))):
                    marks = [mark.split("\t") for mark in found.split("\n")] if found else []
                    for k, paragraph in enumerate(repair(text, [(int(n), kind, fixed) for n, kind, fixed in marks])):
                        yield ident, k, paragraph

        yield from emit(rows(), to, 2_000)

    return once.join(per, "context_id", "left").select("context_id", "raw_content", "fixes").mapInArrow(run, REPAIRED)


