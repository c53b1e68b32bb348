"""Histories and states do not depend on how changes were batched, repeated or ordered."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lakeloom.operators import merge, scd2
from tests.conftest import rows

SCHEMA = "id int, ts_ms bigint, lsn bigint, deleted boolean, v string"
KEYS = ["id"]
FEW = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

change = st.tuples(st.integers(1, 3), st.integers(0, 6).map(lambda n: n * 1000), st.integers(0, 1), st.booleans(),
                   st.sampled_from("ab")).map(lambda c: (*c[:4], None if c[3] else c[4]))
log = st.lists(change, min_size=1, max_size=14)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def at(ts_ms):
    return datetime(1970, 1, 1) + timedelta(milliseconds=ts_ms)


def winner(changes):
    """Of changes with one sequence, the one that counts: deletes first, then by content."""
    return max(changes, key=lambda c: (c[3], c[4] or ""))


def expected_history(data):
    out = []
    for key in {c[0] for c in data}:
        seqs = sorted({c[1:3] for c in data if c[0] == key})
        chain = [winner([c for c in data if c[0] == key and c[1:3] == seq]) for seq in seqs]
        for one, two in zip(chain, chain[1:] + [None]):
            if not one[3]:
                out.append((key, one[4], at(one[1]), None if two is None else at(two[1]), two is None))
    return sorted(out, key=repr)


@FEW
@given(data=log, cut=st.integers(0, 14), again=st.booleans())
def test_scd2_of_any_split(spark, data, cut, again):
    history = None
    for batch in [data[:cut], data[cut:]] + ([data[:cut]] if again else []):
        history = scd2.scd2(history, frame(spark, batch[::-1]), KEYS)
    columns = ["id", "v", "valid_from", "valid_to", "is_current"]
    assert rows(scd2.visible(history), *columns) == expected_history(data)


@FEW
@given(data=log, cut=st.integers(0, 14), again=st.booleans())
def test_upsert_of_any_split(spark, data, cut, again):
    state = None
    for batch in [data[cut:], data[:cut]] + ([data[cut:]] if again else []):
        state = merge.upsert(state, frame(spark, batch), KEYS)
    last = []
    for key in {c[0] for c in data}:
        seq = max(c[1:3] for c in data if c[0] == key)
        one = winner([c for c in data if c[0] == key and c[1:3] == seq])
        last += [] if one[3] else [(key, one[4])]
    assert rows(merge.visible(state), "id", "v") == sorted(last, key=repr)


@FEW
@given(data=log)
def test_intervals_of_a_key_do_not_overlap(spark, data):
    versions = scd2.versions(frame(spark, data), KEYS).collect()
    for key in {v.id for v in versions}:
        own = sorted((v for v in versions if v.id == key), key=lambda v: (v.ts_ms, v.lsn))
        assert all(one.valid_to == two.valid_from for one, two in zip(own, own[1:]))
        assert own[-1].valid_to is None and sum(v.is_current for v in own) <= 1


def test_late_change_before_a_delete_does_not_bring_the_row_back(spark):
    first = [(1, 1000, 0, False, "a"), (1, 3000, 0, True, None)]
    late = [(1, 2000, 0, False, "b")]
    state = merge.upsert(merge.upsert(None, frame(spark, first), KEYS), frame(spark, late), KEYS)
    assert merge.visible(state).count() == 0
    history = scd2.scd2(scd2.scd2(None, frame(spark, first), KEYS), frame(spark, late), KEYS)
    assert rows(scd2.visible(history), "v", "valid_from", "valid_to", "is_current") == [
        ("a", at(1000), at(2000), False), ("b", at(2000), at(3000), False)]


def test_purged_delete_markers(spark):
    state = merge.upsert(None, frame(spark, [(1, 1000, 0, True, None), (2, 5000, 0, True, None), (3, 0, 0, False, "x")]), KEYS)
    assert rows(merge.purge(state, 2000), "id") == [(2,), (3,)]


def test_tracked_columns(spark):
    data = [(1, 1000, 0, False, "a"), (1, 2000, 0, False, "a"), (1, 3000, 0, False, "b"), (1, 4000, 0, True, None),
            (1, 5000, 0, False, "b"), (1, 6000, 0, False, "b")]
    got = rows(scd2.visible(scd2.versions(frame(spark, data), KEYS, tracked=["v"])), "v", "valid_from", "valid_to")
    assert got == [("a", at(1000), at(3000)), ("b", at(3000), at(4000)), ("b", at(5000), None)]


def test_two_updates_at_one_instant_leave_an_empty_interval(spark):
    data = [(1, 1000, 0, False, "a"), (1, 1000, 1, False, "b")]
    got = rows(scd2.visible(scd2.versions(frame(spark, data), KEYS)), "v", "valid_from", "valid_to")
    assert got == [("a", at(1000), at(1000)), ("b", at(1000), None)]


def test_current_rows(spark):
    data = [(1, 1000, 0, False, "a"), (1, 2000, 0, False, "b"), (2, 1000, 0, True, None)]
    assert rows(scd2.current(scd2.versions(frame(spark, data), KEYS)), "id", "v") == [(1, "b")]


@pytest.mark.parametrize("tracked", [None, ["v"]])
def test_hot_key_history_equals_plain_history(spark, tracked):
    data = [(1 if i % 3 else i % 40 + 2, i * 37 % 5000 * 1000, i, i % 11 == 0, None if i % 11 == 0 else "ab"[i % 7 % 2])
            for i in range(3000)]
    plain = scd2.versions(frame(spark, data), KEYS, tracked)
    split = scd2.versions(frame(spark, data), KEYS, tracked, task_rows=100)
    assert "_slice" in split._jdf.queryExecution().optimizedPlan().toString()
    assert rows(plain) == rows(split)
