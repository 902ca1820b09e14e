"""State processors are called for buckets of keys: a call costs what the keys' pages cost, not a call to the state for each key."""

from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql.types import LongType, StructField, StructType
from test_pages import State
from test_streams import SIDED, by_hand

from ebbflow.operators.aggregates import count, greatest, kmax, kmin
from ebbflow.signed import SIGN
from ebbflow.streaming import pages
from ebbflow.streaming.processors import KEY, ROW, CogroupDelta, ExtremeDelta, JoinDelta, MultisetDelta

TEXT = '{"f0":%d}'
VALUES = StructType([StructField("v", LongType())])


def calls(handle) -> int:
    done = sum(s.calls for s in handle.maps.values())
    for s in handle.maps.values():
        s.calls = 0
    return done


def test_one_call_joins_many_keys():
    call, handle = by_hand(JoinDelta("left"), SIDED)
    out = call([(f"k{i}", True, 0, f"r{i}", 1) for i in range(1000)])
    assert out == sorted([(f"k{i}", f"r{i}", None, 1) for i in range(1000)], key=str) and calls(handle) <= 40
    out = call([(f"k{i}", True, 1, "s", 1) for i in range(0, 1000, 2)] + [("k1", True, 0, "r1", -1)])
    want = [(f"k{i}", f"r{i}", *r) for i in range(0, 1000, 2) for r in (("s", 1), (None, -1))] + [("k1", "r1", None, -1)]
    assert out == sorted(want, key=str) and calls(handle) <= 60


def test_one_call_groups_many_keys():
    call, handle = by_hand(MultisetDelta([count("n"), greatest("v", "hi")], VALUES), [KEY, ROW, SIGN])
    assert len(call([(f"k{i}", TEXT % v, 1) for i in range(500) for v in (i, i + 1)])) == 500 and calls(handle) <= 40
    assert call([("k7", TEXT % 8, -1)]) == sorted([("k7", '{"f0": 1, "f1": 7}', 1), ("k7", '{"f0": 2, "f1": 8}', -1)], key=str)
    assert call([(f"k{i}", TEXT % v, -1) for i in range(500) for v in (i, i + 1) if (i, v) != (7, 8)]) and not any(key[1] for key in handle.maps["rows"])


def test_a_side_that_grows_and_goes():
    """Few rows lie beside those of other keys, many have pages of their own, and none are left of a key that is empty."""
    call, handle = by_hand(CogroupDelta(), SIDED)
    for i in range(0, 300, 20):
        call([("k", True, 0, f"r{j:03d}", 1) for j in range(i, i + 20)] + [(f"o{i}", True, 1, "s", 1)])
    (k, left, right, sign), *_ = [r for r in call([("k", True, 1, '"t"', 1)]) if r[3] == 1]
    assert left == "[" + ",".join(f"r{j:03d}" for j in range(300)) + "]" and right == '["t"]'
    assert any(owner == "k" for owner, _ in handle.maps["left"])
    call([("k", True, 0, f"r{j:03d}", -1) for j in range(300)])
    assert not handle.maps["left"]


def test_extremes_of_groups_that_grow():
    call, _ = by_hand(ExtremeDelta([kmin("v", "lo"), kmax("v", "hi")], VALUES), [KEY, ROW, SIGN])
    held: Counter = Counter()
    for step in range(12):
        change = [("k", TEXT % (step * 10 + i), 1) for i in range(10)] + ([("k", TEXT % (step - 6), -1)] if step >= 6 else [])
        held.update({r: n for _, r, n in change})
        out = [r for r in call(change) if r[2] == 1]
        want = sorted(json.loads(r)["f0"] for r, n in held.items() for _ in range(n) if n > 0)
        assert out == [("k", '{"f0": %d, "f1": %d}' % (want[0], want[-1]), 1)]


@pytest.mark.parametrize("ttl", [None, 100])
def test_tables_of_many_keys_are_dictionaries(ttl):
    state, want = State(), {}
    for step in range(8):
        tables = pages.Tables(state, ttl, step)
        for k in range(0, 40, step % 3 + 1):
            table = tables.table(f"k{k}")
            for r in range(step * 5, step * 5 + (30 if k % 7 == 0 else 3)):
                table.put(f"r{r}", [step])
                want.setdefault(f"k{k}", {})[f"r{r}"] = [step]
            tables.close(f"k{k}", table)
        tables.flush()
        again = pages.Tables(state, ttl, step)
        assert {k: dict(again.table(k).items()) for k in again.keys()} == want
