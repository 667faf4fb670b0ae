import random
import re

from loomtree.llm.split import oversized_plans, split_oversized, split_text, token_starts

PLANS = "plan_id bigint, raw_content string, clean_token_target int, overlap_tokens int, n_tokens int, cut string, text string"
TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r\f]")


def text_of(rnd):
    parts = ["Word one two.", "# Heading\n", "\n\n", "\r\n", "- item x\n", " ", "é∎", "Ünder 12!", "\f", "a1b2 ", "? Next "]
    return "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 80)))


def check(text, limit, overlap):
    tokens = [m.start() for m in TOKEN.finditer(text)]
    assert list(token_starts(text)) == tokens
    pieces = list(split_text(text, limit, overlap))
    assert pieces[0][1] == len(pieces)
    if limit is None or limit < 1 or len(tokens) <= limit:
        assert len(pieces) == 1 and pieces[0][6:8] == (0, len(text))
        return
    lap = max(0, min(overlap or 0, limit - 1))
    whole, before = "", None
    for n, (k, _, total, a, b, back, first, last, _) in enumerate(pieces):
        body = text[first:last]
        assert k == n and total == len(tokens) and len(TOKEN.findall(body)) == b - a <= limit
        if n:
            assert TOKEN.findall(body)[:lap] == (TOKEN.findall(before)[-lap:] if lap else []) and back == lap
            whole += body[int(len(body) - (last - (tokens[a + back] if a + back < len(tokens) else last))) :]
        else:
            whole += body
        before = body
    assert whole == text and pieces[-1][4] == len(tokens)


def test_pieces_keep_limits_overlap_and_text():
    for seed in range(400):
        rnd = random.Random(seed)
        check(text_of(rnd), rnd.choice([None, 0, 1, 2, 5, 12, 40]), rnd.choice([None, 0, 1, 3, 11, 99]))


def test_natural_boundaries_come_first():
    text = "One two three.\n\nFour five six seven.\n\n# Head\n\nEight nine ten eleven twelve."
    assert [p[8] for p in split_text(text, 12, 0)] == ["heading", "end"]
    assert [p[8] for p in split_text("a " * 30, 10, 2)] == ["hard"] * 3 + ["end"]


def test_edges(spark):
    rows = [(1, None, 5, 1), (2, "", 5, 1), (3, "a b c", None, None), (4, "a b c", 2, None), (4, "a b c", 2, None), (5, "a b c", 2, 7), (6, "x" * 200_000 + " y" * 50_000, 1000, 10)]
    df = spark.createDataFrame([(*r, 0, "c", "t") for r in rows], PLANS)
    got = split_oversized(df).collect()
    assert {(r.plan_id, r.n_pieces) for r in got if r.plan_id < 6} == {(2, 1), (3, 1), (4, 2), (5, 2)}
    assert len([r for r in got if r.plan_id == 4]) == 2
    assert sorted(r.plan_id for r in oversized_plans(df).collect()) == [4, 5, 6]
    assert split_oversized(df.limit(0)).count() == 0
