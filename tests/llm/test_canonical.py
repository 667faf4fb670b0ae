import random
import unicodedata

from loomtree.llm.canonical import _tables, canonical, canonical_texts, look_alike_classes, look_alike_links, look_alike_pairs

DOCS = "doc_id bigint, text string, look string, exact string, class_id int"


def everywhere(text):
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_tables()[0]))


def test_splicing_equals_normalising_everything():
    rnd = random.Random(3)
    pool = [chr(c) for r in ((32, 0x600), (0x900, 0xA00), (0x1100, 0x1200), (0x1E00, 0x2100), (0x3040, 0x3100), (0xAC00, 0xAC40), (0xFB00, 0xFB20), (0xFF00, 0xFFEF), (0x1D158, 0x1D170)) for c in range(*r)]
    for _ in range(20_000):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))
        assert canonical(text) == everywhere(text) and canonical(canonical(text)) == canonical(text)


def test_what_looks_the_same_and_what_does_not():
    same = [("ｆｕｌｌ　ａ１！", "full a1!"), ("ﬁnite oﬃce", "finite office"), ("é", "é"), ("a​b﻿", "ab"), ("a b", "a b"), ("a\tb", "a b"), ("Ѕсоре", "Scope"), ("ё", "ё"), ("so­ft", "soft"), ("ɡo", "go")]
    for a, b in same:
        assert canonical(a) == canonical(b)
    for a, b in [("x²", "x2"), ("①", "1"), ("ℝ", "R"), ("é", "e"), ("ñ", "n"), ("A", "a"), ("a  b", "a b"), ("a\nb", "a b"), ("α", "a")]:
        assert canonical(a) != canonical(b)


def test_pairs_and_classes_equal_brute_force(spark):
    rnd = random.Random(4)
    forms = ["abc", "аbc", "ab​c", "ａbc", "abd", "", "​", "é", "é", None]
    rows = [(i, rnd.choice(forms)) for i in range(60)]
    df = spark.createDataFrame([(*r, "l", "e", 0) for r in rows + rows[:5]], DOCS)
    want = {(a, b) for a, s in rows for b, t in rows if a < b and s is not None and t is not None and s != t and canonical(s) == canonical(t)}
    got = [tuple(r) for r in look_alike_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    classes = {r.doc_id: r.class_id for r in look_alike_classes(df).collect()}
    assert classes == {i: min(j for j, t in rows if t is not None and canonical(t) == canonical(s)) for i, s in rows if s is not None}
    links = {r.doc_id: r for r in look_alike_links(df).collect()}
    ids = sorted(links)
    implied = {(a, b) for a in ids for b in ids if a < b and links[a].class_id == links[b].class_id and links[a].text_id != links[b].text_id}
    assert implied == want and all(links[i].n_links == sum(i in pair for pair in want) for i in ids)
    assert look_alike_pairs(df.limit(0)).count() == look_alike_links(df.limit(0)).count() == 0
    texts = {r.doc_id: (r.canonical, r.changed) for r in canonical_texts(df).collect()}
    assert all(texts[i] == ((None, False) if s is None else (canonical(s), canonical(s) != s)) for i, s in rows)


def test_many_copies_do_not_meet_each_other(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id = 7 THEN 'x y' ELSE 'x y' END AS text")
    assert look_alike_pairs(df).count() == 2999
