import datetime as dt
import random

from pyspark.sql import functions as F

from loomtree.functions import bloom
from loomtree.operators.references import orphan_references, orphan_report

EVENTS = (
    "event_id bigint, run_id bigint, chunk_number int, line_number int, event_type string, id string, proves string, "
    "deps array<string>, received_at timestamp, place string, gone string, maybe string, field string"
)
REMOVALS = "removal_id bigint, run_id bigint, node_id string, removed_in_chunk int, reason string"
T = dt.datetime(2024, 5, 6)


def brute(events, removals):
    places, gone, out = {}, {}, set()
    for e in events:
        if e[4] == "header" and e[5] is not None and e[1] is not None:
            key = (e[1], e[5])
            places[key] = min(places.get(key, (9**9, 9**9)), (e[2], e[3]))
    for r in removals:
        if r[1] is not None and r[2] is not None and r[3] is not None:
            gone[r[1], r[2]] = min(gone.get((r[1], r[2]), 9**9), r[3])
    for e in events:
        if e[4] != "header":
            continue
        for field, targets in (("deps", e[7] or []), ("proves", [e[6]])):
            for t in set(targets) - {None, ""}:
                key = (e[1], t)
                if key not in places:
                    out.add((e[0], field, t, "missing"))
                elif places[key] > (e[2], e[3]):
                    out.add((e[0], field, t, "late"))
                elif gone.get(key, 9**9) <= e[2]:
                    out.add((e[0], field, t, "deleted"))
    return out


def events(n, seed):
    rnd = random.Random(seed)
    ids = [None, "", *[f"i{k}" for k in range(15)]]
    rows = []
    for k in range(n):
        deps = rnd.choice([None, [], [rnd.choice(ids) for _ in range(4)]])
        rows.append((k, rnd.choice([1, 1, 2, None]), rnd.randint(0, 5), rnd.randint(1, 9), rnd.choice(["header", "header", "cutoff", None]), rnd.choice(ids), rnd.choice(ids), deps, T, "p", "g", "m", "f"))
    return rows + rows[:10]


def test_orphans_equal_brute_force(spark, monkeypatch):
    for seed, size, sent in ((1, None, 1 << 20), (2, 1, 1 << 20), (3, 3, 0)):
        monkeypatch.setattr(bloom, "BROADCAST_BYTES", sent)
        rows = events(150, seed)
        gone = [(k, 1, f"i{k}", k % 6, "r") for k in range(10)] + [(90, None, "i1", 1, ""), (91, 2, None, 1, ""), (92, 2, "i2", None, "")]
        got = orphan_references(spark.createDataFrame(rows, EVENTS), spark.createDataFrame(gone + gone, REMOVALS), rows=size)
        found = [tuple(r) for r in got.select("event_id", "field", "target_id", "reason").collect()]
        assert len(found) == len(set(found)) and set(found) == brute(rows, gone)


def test_the_filter_loses_no_key_and_is_selective_at_any_number_of_keys(spark):
    for n in (10, 30_000, 200_000):
        keys, rows = spark.range(n).select(F.xxhash64("id").alias("h")), bloom.n_rows(n)
        table = bloom.bloom_table(keys, F.col("h"), rows)
        assert table.count() == rows
        asked = spark.range(0, 2 * n).select("id", F.when(F.col("id") % 1000 < 999, F.xxhash64("id")).alias("h"))
        got = bloom.with_maybe(asked, table, F.col("h"), rows)
        counted = got.select((F.col("id") < n).alias("kept"), F.col("h").isNull().alias("no"), "maybe").groupBy("kept", "no", "maybe").count().collect()
        times = {(r.kept, r.no, r.maybe): r["count"] for r in counted}
        assert (True, False, False) not in times and not any(m and no for _, no, m in times)
        assert times.get((False, False, True), 0) <= 0.05 * n + 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], REMOVALS)
    assert orphan_references(spark.createDataFrame([], EVENTS), none).count() == 0
    one = [(1, 1, 1, 1, "header", None, "x", ["y"], T, "", "", "", "")]
    got = orphan_references(spark.createDataFrame(one, EVENTS), none)
    assert {(r.field, r.target_id, r.reason) for r in got.collect()} == {("proves", "x", "missing"), ("deps", "y", "missing")}
    report = orphan_report(got).collect()
    assert {(r.field, r.month, r.n_references) for r in report} == {("deps", "2024-05", 1), ("proves", "2024-05", 1)}
