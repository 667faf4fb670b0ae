"""One consistent form for texts that look the same.

Every code point has a quick-check property, derived here from the Unicode data of the interpreter: *stable* ones can
neither change nor take part in a change. One compiled class finds the unstable ones; a maximal run of them, with the
one character before it as boundary context (a base that a following mark may compose with), is a segment. Only
segments are decomposed, folded and composed again, and the results are spliced into the unchanged text. Texts
without an unstable character, most of them, are returned as they are after one scan.

Folding, per decomposed code point:
* no width (format characters, variation selectors, control characters but line ends and tab): removed;
* any blank (tab and the space separators that print nothing): a space;
* full-width and half-width forms, Latin and Armenian ligatures and digraphs: their ordinary characters;
* letters of another script, or phonetic letters, that are drawn the same: the ordinary Latin letter.
Case, digits, superscripts, circled digits, double-struck letters and all accents keep their own form.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtree.checkpoints import checkpointed
from loomtree.llm.arrow import emit, schema
from loomtree.session import ship

# Letters drawn the same as an ordinary Latin letter, then that letter.
LOOK_ALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y",
    # Armenian
    "օ": "o", "Օ": "O", "Տ": "S", "Լ": "L", "ս": "u", "հ": "h", "ց": "g", "զ": "q",
    # Phonetic and Latin variants
    "ɡ": "g", "ɑ": "a",
}
#: Hyphens drawn as the ordinary one.
HYPHENS = {"‐": "-", "‑": "-"}
# Format characters that are drawn.
DRAWN_FORMATS = range(0x0600, 0x0606), (0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD)
#: Beyond the first plane only these hold unstable characters.
PLANES = range(0xD800), range(0xE000, 0x1D200), range(0x2F800, 0x2FA20), range(0xE0000, 0xE0200)


def _fold_of(char: str) -> str | None:
    """What a decomposed character becomes; None if it stays."""
    code, kind = ord(char), unicodedata.category(char)
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    if char in HYPHENS:
        return HYPHENS[char]
    if char == "\t" or kind == "Zs" and code != 0x1680 or code == 0x2800:
        return " "
    if kind == "Cf" and not any(code in drawn for drawn in DRAWN_FORMATS):
        return ""
    if kind == "Cc" and char not in "\n\r\x0b\x0c\x85\x1c\x1d\x1e":
        return ""
    if code == 0x034F or 0x180B <= code <= 0x180F or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
        return ""
    shape = unicodedata.decomposition(char)
    if shape.startswith(("<wide>", "<narrow>")):
        return unicodedata.normalize("NFKD", char)
    if shape.startswith("<compat>") and kind[0] == "L":
        name = unicodedata.name(char, "")
        pair = name.startswith("LATIN") and len(shape.split()) == 3 and "LETTER N PRECEDED" not in name
        if pair and ("LIGATURE" in name or code < 0x0200) or name.startswith(("LATIN SMALL LIGATURE", "ARMENIAN SMALL LIGATURE")):
            return unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in shape.split()[1:]))
    return None


@cache
def _tables() -> tuple[dict[int, str], re.Pattern, re.Pattern]:
    """The folding table, the pattern of runs of unstable characters, and the same within ASCII."""
    folds: dict[int, str] = {}
    unstable: set[int] = set()
    for plane in PLANES:
        for code in plane:
            char = chr(code)
            fold = _fold_of(char)
            if fold is not None and fold != char:
                # a folded character may itself fold: half-width kana, digraphs of look-alikes
                folds[code] = "".join(x if (y := _fold_of(x)) is None else y for x in fold)
                unstable.add(code)
            if unicodedata.combining(char) or not unicodedata.is_normalized("NFC", char):
                unstable.add(code)
            shape = unicodedata.decomposition(char)
            if shape and shape[0] != "<":
                parts = [int(x, 16) for x in shape.split()]
                if len(parts) == 2 and not 0xAC00 <= code <= 0xD7A3:
                    unstable.add(parts[1])  # may compose with what stands before it
                if any(x in folds or chr(x) in LOOK_ALIKES for x in map(ord, unicodedata.normalize("NFD", char))):
                    unstable.add(code)  # composed from a letter that folds
    unstable.update(range(0x1161, 0x1176))
    unstable.update(range(0x11A8, 0x11C3))
    unstable -= {code for code in unstable if code < 0x80 and code not in folds}
    ranges: list[list[int]] = []
    for code in sorted(x for x in unstable if x < 0x10000):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    inside = "".join(re.escape(chr(a)) + ("" if a == b else "-" + re.escape(chr(b))) for a, b in ranges)
    # All of the other planes counts as unstable: one range keeps the class a table look-up, and a stable segment is
    # its own normal form.
    ascii_ = "".join(re.escape(chr(x)) for x in sorted(folds) if x < 0x80)
    return folds, re.compile(f"[{inside}\U00010000-\U0010ffff]+"), re.compile(f"[{ascii_}]")


def canonical(text: str) -> str:
    """The form in which texts that look the same are equal."""
    folds, runs, ascii_runs = _tables()
    if not (ascii_runs if text.isascii() else runs).search(text):
        return text
    nf = unicodedata.normalize
    parts, done = [], 0
    for m in runs.finditer(text):
        start = max(m.start() - 1, done)  # with the boundary context
        parts.append(text[done:start])
        parts.append(nf("NFC", nf("NFD", text[start : m.end()]).translate(folds)))
        done = m.end()
    parts.append(text[done:])
    return "".join(parts)


def stored(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


CANONICAL = "doc_id bigint,canonical string,changed boolean"


def canonical_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, canonical, changed): every document's text in the consistent form, one row per row.

    Defined results: null stays null and is not changed; empty text stays empty; other columns are ignored.
    """
    ship(docs.sparkSession)
    to = schema(CANONICAL)

    def run(batches):
        def rows():
            for b in batches:
                for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    form = None if text is None else canonical(text)
                    yield ident, form, form != text

        yield from emit(rows(), to, 2_000)

    return docs.select("doc_id", "text").mapInArrow(run, CANONICAL)


PRINTS = "doc_id bigint,look binary,exact binary"


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, look, exact): 128-bit digests of the consistent form and of the text itself; no row for null text."""
    ship(docs.sparkSession)
    to = schema(PRINTS)

    def run(batches):
        def rows():
            for b in batches:
                for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if text is None:
                        continue
                    form = canonical(text)
                    exact = blake2b(stored(text), digest_size=16).digest()
                    yield ident, exact if form is text or form == text else blake2b(stored(form), digest_size=16).digest(), exact

        yield from emit(rows(), to)

    return docs.select("doc_id", "text").mapInArrow(run, PRINTS)


def _mixed(prints: DataFrame) -> DataFrame:
    """The forms that more than one text takes. Partial aggregation keeps one row per form and task."""
    forms = prints.groupBy("look").agg(F.min("exact").alias("a"), F.max("exact").alias("z"))
    return forms.where(F.col("a") != F.col("z")).select("look")


def look_alike_pairs(docs: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: different texts with one consistent form.

    Pairs are made between the distinct texts of a form first and then given to the documents that hold them, so exact
    copies, however many, never meet each other. The rows are as many as there are such pairs; ``look_alike_links`` says
    the same in one row per document. Defined results: null texts look like nothing; empty texts look like texts of
    characters without width; repeated rows give a pair once; other columns are ignored. Reads the texts once, when called.
    """
    prints = checkpointed(fingerprints(docs))
    kept = checkpointed(prints.join(_mixed(prints), "look", "left_semi").distinct())
    texts = kept.select("look", "exact").distinct()
    other = texts.select("look", F.col("exact").alias("exact_b"))
    differing = texts.join(other, "look").where(F.col("exact") != F.col("exact_b"))
    a = kept.select(F.col("doc_id").alias("doc_a"), "look", "exact")
    b = kept.select(F.col("doc_id").alias("doc_b"), "look", F.col("exact").alias("exact_b"))
    pairs = a.join(differing, ["look", "exact"]).join(b, ["look", "exact_b"]).where(F.col("doc_a") < F.col("doc_b"))
    return pairs.select("doc_a", "doc_b")


def look_alike_classes(docs: DataFrame) -> DataFrame:
    """One row per document with text: class_id is the smallest doc_id of its form; texts and documents per class.

    Counted per text first, so a hot form is combined where it is read. Reads the texts once, when called.
    """
    prints = checkpointed(fingerprints(docs))
    return prints.join(_classes(_texts(prints)), "look").select("doc_id", "class_id", "n_documents", "n_texts")


def _texts(prints: DataFrame) -> DataFrame:
    """(look, exact, text_id, n_copies), one row per distinct text; text_id is the smallest doc_id that holds it."""
    return prints.groupBy("look", "exact").agg(F.min("doc_id").alias("text_id"), F.count(F.lit(1)).alias("n_copies"))


def _classes(texts: DataFrame) -> DataFrame:
    return texts.groupBy("look").agg(
        F.min("text_id").alias("class_id"), F.sum("n_copies").alias("n_documents"), F.count(F.lit(1)).alias("n_texts")
    )


def look_alike_links(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, text_id, n_links), one row per document of a class with several texts.

    Two documents look alike and differ exactly where they share class_id and differ in text_id, so every pair of
    ``look_alike_pairs`` follows from the rows and none has to be written; n_links counts a document's. Defined results as
    there; a row given twice has its row twice.
    """
    prints = checkpointed(fingerprints(docs))
    texts = checkpointed(_texts(prints.distinct()))
    mixed = _classes(texts).where(F.col("n_texts") > 1)
    known = texts.join(mixed, "look").select("look", "exact", "class_id", "text_id", (F.col("n_documents") - F.col("n_copies")).alias("n_links"))
    return prints.join(known, ["look", "exact"]).select("doc_id", "class_id", "text_id", "n_links")
