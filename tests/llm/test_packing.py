import random

import numpy as np
import pytest

from loomtree.llm import packing, tokens
from loomtree.llm.packing import containers, pack, packed

DOCS = "doc_id bigint, text string, block int, n_tokens int, position string"


def fill(size, loss, where, capacity, segments, quiet):
    used = {}
    for s, q, c in zip(size, loss, where):
        t = used.setdefault(int(c), [0, 0, 0])
        t[0] += s
        t[1] += 1
        t[2] += q
    assert all(t[0] <= capacity and t[1] <= segments and t[2] <= quiet for t in used.values())
    return len(used)


def test_limits_hold_and_space_is_used():
    for seed in range(30):
        rnd = np.random.default_rng(seed)
        size = rnd.integers(1, 2049, rnd.integers(1, 400))
        loss = np.minimum(size * rnd.random(len(size)), 1500).astype(int)
        where, position = pack(size, loss, 2048, 8, 1500)
        n = fill(size, loss, where, 2048, 8, 1500)
        assert n == where.max() + 1 and len({(c, p) for c, p in zip(where, position)}) == len(size)
    size = np.random.default_rng(9).integers(1, 700, 20_000)
    n = pack(size, size)[0].max() + 1
    assert n <= 1.002 * size.sum() / 2048 + 1


def test_each_limit_alone_binds():
    ones = np.ones(10, int)
    assert pack(ones, ones * 0, 100, 3, 100)[0].max() == 3
    assert pack(ones * 5, ones * 5, 100, 64, 10)[0].max() == 4
    with pytest.raises(ValueError):
        pack(np.array([11]), np.array([1]), 10)


def test_texts_are_whole_unless_they_exceed_a_container(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choice(["alpha", "beta", "@ - id=x\n", "Größe"]) for _ in range(rnd.randint(0, 300)))) for k in range(80)]
    rows += [(100, "word " * 5000), (101, None), (102, "")]
    df = spark.createDataFrame([(*r, 0, 0, "") for r in rows], DOCS)
    for block, tasks in ((40_000, 9), (20, 9), (8, 3)):
        monkeypatch.setattr(packing, "MOST_TASKS", tasks)
        got = packed(df, block_items=block).collect()
        by = {}
        for r in got:
            by.setdefault(r.doc_id, []).append(r)
        for doc, text in rows:
            n = len(tokens.encoding().encode_ordinary(text)) if text else 0
            assert sum(r.n_tokens for r in by[doc]) == n
            assert len(by[doc]) == max(1, -(-n // 2048))
            assert all((r.container_id is None) == (r.n_tokens == 0) for r in by[doc])
        used = containers(packed(df, block_items=block)).collect()
        assert all(0 <= r.unused < 2048 and r.n_segments <= 64 for r in used)
    assert packed(df.limit(0)).count() == 0
    tight = packed(df, loss_capacity=500).groupBy("container_id").sum("loss_tokens").collect()
    assert max(r[1] for r in tight if r[0] is not None) <= 500


def test_small_items_are_shared_out_where_slots_are_few():
    rnd = np.random.default_rng(1)
    size = np.concatenate([rnd.integers(600, 1500, 400), rnd.integers(1, 200, 800)])
    where, _ = pack(size, size, 2048, 4, 2048)
    n = fill(size, size, where, 2048, 4, 2048)
    assert n <= 1.08 * max(-(-len(size) // 4), -(-size.sum() // 2048))


def test_all_three_limits_bind(spark):
    from loomtree.llm.queries import QUERIES

    row = QUERIES["p6_summary"](spark, "/root/testdata/sf0.01").first()
    assert min(row.token_limit, row.segment_limit, row.loss_limit) > 10
    assert row.least_containers <= row.n_containers <= 1.1 * row.least_containers


def test_a_long_book_does_not_enlarge_a_block(spark):
    df = spark.createDataFrame([(1, "word " * 60_000), (2, "short text"), (3, "another")], "doc_id bigint, text string")
    got = packed(df, block_items=2).collect()
    full = [r for r in got if r.n_tokens == 2048]
    assert len(full) == 60_000 // 2048 and len({r.container_id for r in full}) == len(full) and all(r.container_id < 0 for r in full)
    rest = [r for r in got if r.n_tokens < 2048]
    assert len(rest) == 3 and all(r.container_id >= 0 for r in rest)


def test_the_limited_query_is_held_by_its_loss_limit(spark):
    from loomtree.llm.queries import LOSS_LIMIT, QUERIES

    rows = containers(QUERIES["p6_loss_limited"](spark, "/root/testdata/sf0.001")).collect()
    assert rows and all(r.n_tokens <= 2048 and r.n_segments <= 64 and r.loss_tokens <= LOSS_LIMIT for r in rows)
    assert any(r.loss_tokens > LOSS_LIMIT - 16 and r.unused > 0 for r in rows)
