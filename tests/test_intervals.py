from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomtree.operators.intervals import merge_intervals, owned_lines

SPANS = "span_id bigint, run_id bigint, chunk_number int, first_line int, last_line int, lo string, block string, kind string"


def brute(rows):
    owned = {}
    for run, chunk, first, last in rows:
        if None not in (run, chunk, first, last) and first <= last:
            owned.setdefault((run, chunk), set()).update(range(first, last + 1))
    out = set()
    for key, lines in owned.items():
        periods, start, prev = [], None, None
        for n in sorted(lines):
            if prev is None or n > prev + 1:
                if prev is not None:
                    periods.append((start, prev))
                start = n
            prev = n
        periods.append((start, prev))
        out |= {(*key, "period", a, b) for a, b in periods}
        out |= {(*key, "gap", a[1] + 1, b[0] - 1) for a, b in zip(periods, periods[1:])}
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([1, 2, None]), st.sampled_from([0, 1, None]), st.one_of(st.none(), st.integers(-20, 60)), st.one_of(st.none(), st.integers(-20, 60))), max_size=40), st.sampled_from([1, 4, 16, 1 << 16]))
def test_merge_equals_brute_force(spark, rows, block):
    df = spark.createDataFrame([(i, r, c, f, z, "x", "y", "k") for i, (r, c, f, z) in enumerate(rows + rows[:3])], SPANS)
    assert found(merge_intervals(df, ["run_id", "chunk_number"], "first_line", "last_line", block=block)) == brute(rows)


def test_empty_table_and_touching_spans(spark):
    assert owned_lines(spark.createDataFrame([], SPANS)).count() == 0
    df = spark.createDataFrame([(1, 1, 1, 1, 3, "", "", ""), (2, 1, 1, 4, 4, "", "", ""), (3, 1, 1, 9, 9, "", "", "")], SPANS)
    assert found(owned_lines(df)) == {(1, 1, "period", 1, 4), (1, 1, "gap", 5, 8), (1, 1, "period", 9, 9)}


def test_null_keys_can_form_their_own_entity(spark):
    df = spark.createDataFrame([(1, None, None, 1, 2, "", "", ""), (2, None, None, 5, 6, "", "", "")], SPANS)
    got = found(merge_intervals(df, ["run_id", "chunk_number"], "first_line", "last_line", skip_null_keys=False))
    assert got == {(None, None, "period", 1, 2), (None, None, "gap", 3, 4), (None, None, "period", 5, 6)}
