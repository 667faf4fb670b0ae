import random

import numpy as np

from loomtree.llm import leaks
from loomtree.llm.leaks import leak_report, leaked_passages, leaked_windows, words_of

DOCS = "doc_id bigint, text string, item_id int, word string"
ITEMS = "item_id bigint, suite string, text string, doc_id int"


def brute(docs, items, n):
    grams = lambda t: {tuple(w[i : i + n]) for w in [words_of(t)] for i in range(len(w) - n + 1)}
    return {(d, i) for d, s in docs if s for i, t in items if t and grams(s) & grams(t)}


def make(seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(12)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 14)))) for i in range(12)] + [(90, None), (91, "")]
    docs = []
    for d in range(50):
        body = [rnd.choice(words) for _ in range(rnd.randint(0, 30))]
        piece = (rnd.choice(items)[1] or "").split()
        a = rnd.randint(0, 5)
        body[5:5] = [w.upper() + rnd.choice([",", "**", "\r\n", "​"]) for w in piece[a : a + rnd.randint(2, 12)]]
        docs.append((d, " ".join(body)))
    return docs + [(200, None), (201, "")], items


def test_found_equals_brute_force_with_any_filter(spark, monkeypatch):
    for seed, size, shingle in ((1, 5, 5), (2, 4, 2), (3, 6, 3)):
        docs, items = make(seed)
        d = spark.createDataFrame([(*r, 1, "w") for r in docs + docs[:4]], DOCS)
        i = spark.createDataFrame([(a, "s", t, 3) for a, t in items + items[:2]], ITEMS)
        for full in (False, True):
            # a filter that lets everything through changes nothing
            with monkeypatch.context() as m:
                if full:
                    m.setattr(leaks.bloom, "bloom_array", lambda table, rows: np.full(1, 2**64 - 1, np.uint64))
                    m.setattr(leaks, "KEPT", 40)
                got = [tuple(r) for r in leaked_windows(d, i, words=size, shingle=shingle).select("doc_id", "item_id").collect()]
            assert len(got) == len(set(got)) and set(got) == brute(docs, items, size)


def test_rows_of_one_item_with_different_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(14)) for x in "ab")
    d = spark.createDataFrame([(1, a, 0, ""), (2, b, 0, ""), (3, b + " " + a, 0, "")], DOCS)
    i = spark.createDataFrame([(7, "s", a, 0), (7, "t", b, 0), (None, "u", a, 0)], ITEMS)
    got = {(r.doc_id, r.item_id): (r.shingles, r.longest_words, r.first_word) for r in leaked_passages(d, i).collect()}
    assert got == {(1, 7): (3, 14, 0), (2, 7): (3, 14, 0), (3, 7): (6, 14, 0)}


def test_copies_of_an_item_are_compared_once(spark, monkeypatch):
    text = " ".join(f"word{k}" for k in range(40))
    d = spark.createDataFrame([(k, text, 0, "") for k in range(3)], DOCS)
    i = spark.range(2000).selectExpr("id AS item_id", f"CASE WHEN id = 5 THEN 'other' ELSE '{text}' END AS text")
    met = []
    verified = leaks._verified
    monkeypatch.setattr(leaks, "_verified", lambda rows, *more: met.append(rows.count()) or verified(rows, *more))
    assert leaked_passages(d, i).count() == 3 * 1999 and met[0] <= 3 * 40


def test_stretches():
    assert leaks.stretches(np.array([1, 2, 3, 5, 6, 9, 10, 11]), 3) == [(1, 3), (9, 11)]
    assert leaks.stretches(np.array([4, 5]), 3) == [] and leaks.stretches(np.array([4, 5, 6]), 3) == [(4, 6)]


def test_every_window_has_its_rarest_shingle_as_prefix():
    rnd = random.Random(4)
    for _ in range(50):
        n, span = rnd.randint(1, 30), rnd.randint(1, 8)
        rarity = [rnd.choice([None, (1, 5), (2, 7), (9, 1)]) if rnd.random() < 0.3 else (rnd.randint(1, 9), k) for k in range(n)]
        windows = max(0, n - span + 1)
        chosen = leaks.prefix_places(rarity, windows, span)
        for w in range(windows):
            part = rarity[w : w + span]
            if None not in part:
                assert min(part) in [rarity[k] for k in chosen if w <= k < w + span]


def test_passage_lengths_and_look_alikes(spark):
    words = [f"term{k}" for k in range(30)]
    docs = [(1, "x " + " ".join(words[3:20]) + " y"), (2, " ".join(words[:11])), (3, " ".join(words[:12]).replace("e", "е").upper())]
    d = spark.createDataFrame([(*r, 0, "") for r in docs], DOCS)
    i = spark.createDataFrame([(7, "s", " ".join(words), 0), (8, "s", "short text", 0)], ITEMS)
    got = {(r.doc_id, r.item_id): (r.shingles, r.longest_words, r.first_word) for r in leaked_passages(d, i).collect()}
    assert got == {(1, 7): (6, 17, 1), (3, 7): (1, 12, 0)}
    assert {(r.item_id, r.n_documents, r.longest_words) for r in leak_report(d, i).collect()} == {(7, 2, 17), (8, 0, 0)}
    assert leaked_passages(d.limit(0), i).count() == leaked_passages(d, i.limit(0)).count() == 0
