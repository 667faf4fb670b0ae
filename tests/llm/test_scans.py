"""Page furniture, broken and misread words of small books whose repairs are known."""

import random

from loomtree.llm import scans
from loomtree.llm.pages import Keys, alike, furniture
from loomtree.llm.scans import repair, repaired_texts, scan_repairs

CONTEXTS = "context_id bigint, raw_content string, kind string, fixed string, n int, word string"
WORDS = "matrix kernel every theorem shows closed filter another function measure determinant chapter normal finite continuous section".split()


def book(seed, pages=4):
    """A text of several pages with its true repairs."""
    rnd = random.Random(seed)
    lines, truth, number = [], set(), rnd.randint(30, 200)
    for page in range(pages):
        lines.append(["THE BOOK OF FILTERS", "Chapter 3. Closed Kernels"][page % 2])
        truth.add((len(lines), "header", ""))
        for k in range(14):
            words = [rnd.choice(WORDS) for _ in range(7)]
            if k == 4:
                lines.append(" ".join(words[:6]) + " deter-")
                truth.add((len(lines), "hyphen", "determinant"))
                lines.append("minant " + " ".join(words[:5]) + " again so.")
            elif k == 7:
                lines.append(" ".join(words[:6]) + " well-")
                truth.add((len(lines), "hyphen", "well-known"))
                lines.append("known " + " ".join(words[:6]) + " and so.")
            elif k == 9 and page == 1:
                lines.append(" ".join(words[:6]) + " theorern " + words[0] + ".")
                truth.add((len(lines), "misread", "theorem"))
            elif k == 11:
                lines.append(rnd.choice(["(3.12)", "B = n - 20 -", "4711"]))
            else:
                lines.append(" ".join(words) + " the well-known determinant.")
        lines.append(["", f"- {number + page} -"][1])
        truth.add((len(lines), "page_number", ""))
    return "\n".join(lines), truth


def test_repairs_of_books(spark):
    books = [book(k) for k in range(20)]
    rows = [(k, text, "k", "f", 1, "w") for k, (text, _) in enumerate(books)]
    rows += [(90, None, "", "", 0, ""), (91, "", "", "", 0, ""), (92, "\n\n", "", "", 0, "")]
    df = spark.createDataFrame(rows + rows[:3], CONTEXTS)
    got = [tuple(r) for r in scan_repairs(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(k, *t) for k, (_, truth) in enumerate(books) for t in truth}
    assert scan_repairs(df.limit(0)).count() == 0
    text = " ".join(r.text for r in repaired_texts(df).where("context_id = 0").orderBy("paragraph_no").collect())
    assert "theorern" not in text and "THE BOOK" not in text and "deter-" not in text and "determinant" in text


def test_number_sequences():
    body = "a line of running text that is long enough here."
    page = [body] * 6
    roman = [x for n in ("xii", "xiii", "xiv") for x in [*page, n]]
    assert [i for i, k in furniture(roman).items() if k == "page_number"] == [6, 13, 20]
    bare = [x for n in ("l09", "110", "111") for x in [*page, "7120", n]]
    assert sorted(i for i, k in furniture(bare).items() if k == "page_number") == [7, 15, 23]
    inline = [x for n in (8, 9, 10) for x in [f"Open filters      {n}", *page]]
    assert furniture(inline) == {0: "header", 7: "header", 14: "header"}
    assert furniture(["B = n - 9 -", "    - t", *page, "(3.4)"]) == {}


def test_a_word_broken_over_pages():
    text = "The first line ends in a bro¬\nOPEN FILTERS\nken word.\nA new paragraph."
    assert repair(text, [(1, "hyphen", "broken"), (2, "header", "")]) == ["The first line ends in a broken word. A new paragraph."]


def test_long_text_takes_linear_time(spark):
    text = "\n".join(book(k)[0] for k in range(400))
    df = spark.createDataFrame([(1, text, "", "", 0, "")], CONTEXTS)
    assert scan_repairs(df).count() > 400 * 10


def test_lone_titles_need_a_page_edge_or_a_repetition(spark):
    body = ["a line of running text that is long enough to be full here.", "another line of running text that is quite as long."] * 4
    for title in ("Measures and Integrals", "ON MEASURES", "Emmy Noether | Erlangen", "Open Filters      212"):
        assert furniture([*body, "", title, "", *body]) == {}
        assert furniture([*body, title, "- 12 -", *body])[8] == "header"
        assert furniture([*body, title, *body, title, *body]) == {8: "header", 17: "header"}
    cut = [*body, "a line of running text that is cut by the end of the page,", "Measures and Integrals", "and goes on in the next one.", *body]
    assert furniture(cut) == {9: "header"}
    lone = "\n".join([*body, "", "Measures and Integrals", "", *body])
    noisy = "\n".join([*body, "Mcasures and Intcgrals", "- 12 -", *body])
    rows = [(1, 1, lone), (2, 1, noisy), (3, 2, lone), (3, 2, lone), (4, None, lone), (5, None, noisy)]
    df = spark.createDataFrame(rows, "context_id bigint, run_id bigint, raw_content string")
    got = {(r.context_id, r.line_no) for r in scan_repairs(df).where("kind = 'header'").collect()}
    assert got == {(1, 10), (2, 9), (5, 9)}
    assert any("Measures and Integrals" in r.text for r in repaired_texts(df).where("context_id = 3").collect())


def test_bare_numbers_restart_and_skip_pages():
    page = ["a line of running text that is long enough here."] * 30
    parts = [range(1, 41), range(1, 31), [*range(7, 20), *range(23, 30)], [*range(100, 110), *range(140, 150)], [51, 52, 56]]
    lines, truth = [], []
    for k, n in enumerate(n for part in parts for n in part):
        lines += [*page, *([str(7000 - 300 * (k % 20))] if k % 3 == 0 else []), *page[:5], str(n)]
        truth.append(len(lines) - 1)
        lines += page[:4]
    assert sorted(i for i, k in furniture(lines).items() if k == "page_number") == truth


def test_fuzzy_repetition_has_no_window():
    rnd = random.Random(5)
    verse = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(8, 14)))
    wide = "a line of running text that is long enough to tell the width of this page."
    short = [x for _ in range(300) for x in (wide, verse().capitalize())]
    lines = [*short, wide, "Ordinals and Lattices", *short[:400], wide, "Ordina1s and Latticcs", wide, *short[400:]]
    told = furniture(lines)
    assert told.get(601) == "header" and told.get(601 + 402) == "header"
    for letters_ in ("ab", "abcdefgh"):
        keys = sorted({"".join(rnd.choice(letters_) for _ in range(rnd.randint(4, 12))) for _ in range(250)})
        keys += [k[:3] + "x" + k[4:] for k in keys[::3]]
        index = Keys(keys)
        for key in keys:
            for least in (0.8, 0.9):
                assert set(index.like(key, least)) == {o for o in keys if o != key and alike(key, o, least)}


def test_halves_of_words_do_not_depend_on_the_filter(spark, monkeypatch):
    text = "The kernel of the quasi norm, a matrix and a tensor.\nLet the quasi-\ntensor be a kernel-\nquasi of the mat-\nrixes."
    df = spark.createDataFrame([(1, text)], "context_id bigint, raw_content string")
    for most in (65_536, 1, 0):
        monkeypatch.setattr(scans, "SURE_WORDS", most)
        got = {r.fixed for r in scan_repairs(df).where("kind = 'hyphen'").collect()}
        assert got == {"quasi-tensor", "kernel-quasi", "matrixes"}


def test_nothing_depends_on_the_size_of_the_filter(spark):
    from oracle import DATA

    contexts = spark.read.parquet(f"{DATA}/sf0.001/batch_contexts.parquet")
    want = {tuple(r) for r in scan_repairs(contexts).collect()}
    assert want and all({tuple(r) for r in scan_repairs(contexts, sure_words=n).collect()} == want for n in (0, 1, 300))
    text = "the well spring of well and spring words\nwell-spring Wellspring Theory\nthe well-\nspring of fil-\nters and fil-\nter words runs on here\n"
    small = spark.createDataFrame([(k, text, "", "", 0, "") for k in range(3)], CONTEXTS)
    want = {tuple(r) for r in scan_repairs(small).collect()}
    assert want and all({tuple(r) for r in scan_repairs(small, sure_words=n).collect()} == want for n in (0, 1, 3, 5))
