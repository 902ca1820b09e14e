"""State in pages against plain dictionaries and sorted lists."""

from __future__ import annotations

import random
from bisect import bisect_left
from datetime import date, datetime
from decimal import Decimal

import pytest

from ebbflow.operators.ordering import order_text
from ebbflow.streaming import pages


class State(dict):
    """A map state in memory that counts its calls."""

    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.pop(key, None)


@pytest.mark.parametrize("size", [1, 4, 128])
@pytest.mark.parametrize("seed", range(3))
def test_a_table_is_a_dictionary(monkeypatch, size, seed):
    monkeypatch.setattr(pages, "PAGE_KEYS", size)
    r, state, want = random.Random(seed), State(), {}
    for step in range(30):
        table = pages.Pages(state)
        for _ in range(r.choice([0, 1, 5, 400])):
            k = f"k{r.randrange(600)}"
            assert table.get(k) == want.get(k)
            v = None if r.random() < 0.4 else [step, "x"]
            table.put(k, v)
            want.pop(k, None) if v is None else want.update({k: v})
        table.total = len(want)
        assert dict(table.items()) == want
        table.flush()
        again = pages.Pages(state)
        assert dict(again.items()) == want and again.total == len(want)
    assert pages.body((i, v[0]) for (i,), v in state.items()) == want


def test_a_jump_and_then_known_keys_only():
    state = State()
    for step in range(3):
        table = pages.Pages(state)
        for i in range(5000):
            table.put(f"k{i}", [(table.get(f"k{i}") or [0])[0] + 1])
        table.flush()
        assert all(v == [step + 1] for _, v in table.items())
    assert len(list(pages.Pages(state).items())) == 5000 and max(len(v[0]) for v in state.values()) < 5000 * 10 / 8


def test_one_key_touches_two_pages_of_a_large_table():
    state = State()
    table = pages.Pages(state)
    for i in range(20_000):
        table.put(f"k{i}", [1])
    table.flush()
    state.calls = 0
    table = pages.Pages(state)
    table.put("k77", [2])
    table.flush()
    assert state.calls <= 8 and len(table._loaded) <= 4  # a long page asks for one split


def test_time_to_live_is_each_keys_own():
    state = State()
    for now, keys in ((0, range(500)), (60, range(100)), (90, range(400, 900))):
        table = pages.Pages(state, 100, now)
        for i in keys:
            table.put(f"k{i}", [now])
        table.flush()
    alive = {k for k, _ in pages.Pages(state, 100, 159).items()}
    assert alive == {f"k{i}" for i in [*range(100), *range(400, 900)]}
    assert pages.Pages(state, 100, 159).get("k5") == [60] and pages.Pages(state, 100, 160).get("k5") is None


@pytest.mark.parametrize("size", [2, 3, 128])
@pytest.mark.parametrize("seed", range(3))
def test_a_tree_is_a_sorted_list(monkeypatch, size, seed):
    monkeypatch.setattr(pages, "PAGE_KEYS", size)
    r, state, want = random.Random(seed), State(), {}
    for step in range(40):
        tree, change = pages.Sorted(state, 7), {}
        for _ in range(r.choice([1, 2, 60])):
            k = f"{r.randrange(300):03d}"
            n = r.choice([1, 1, 2]) if step < 25 and r.random() < 0.7 else -want.get(k, 0)
            if n and k not in change:
                change[k] = (f"v{k}", n)
        for k, (_, n) in change.items():
            want[k] = want.get(k, 0) + n
        want = {k: n for k, n in want.items() if n}
        tree.change(change)
        tree = pages.Sorted(state, 7)
        keys = sorted(want)
        assert tree.extreme(False) == (f"v{keys[0]}" if keys else None) and tree.extreme(True) == (f"v{keys[-1]}" if keys else None)
        assert list(tree.between("100", "220")) == [(f"v{k}", want[k]) for k in keys if "100" <= k <= "220"]
    for k in sorted(want):
        pages.Sorted(state, 7).change({k: (f"v{k}", -want[k])})
    assert not state


def test_an_extreme_reads_one_way_through_the_tree():
    state = State()
    pages.Sorted(state, 0).change({f"{i:06d}": (str(i), 1) for i in range(100_000)})
    state.calls = 0
    tree = pages.Sorted(state, 0)
    tree.change({"000000": ("0", -1)})
    assert tree.extreme(False) == "1" and state.calls <= 8


NAN = float("nan")


@pytest.mark.parametrize("values", [
    [float("-inf"), -1e300, -2.5, -5e-324, 0.0, 5e-324, 1.0, 1e300, float("inf"), NAN], [-(2**63), -1, 0, 7, 2**63 - 1], [False, True], ["", "a", "ab", "b", "é", "漢", "😀"],
    [Decimal("-10.5"), Decimal("-10.25"), Decimal("0"), Decimal("0.00001"), Decimal("99999999999999999999999999999999999999")], [date(1, 1, 1), date(1969, 12, 31), date(9999, 12, 31)],
    [datetime(1, 1, 1), datetime(1960, 1, 1, 0, 0, 0, 1), datetime(1960, 1, 1, 0, 0, 0, 2), datetime(2024, 1, 1)], [b"", b"\x00", b"\x00\x01", b"\xff"],
])
def test_texts_order_as_values(values):
    texts = [order_text(v) for v in values]
    assert texts == sorted(texts) and len(set(texts)) == len(texts)
    assert order_text(-0.0) == order_text(0.0) and bisect_left(texts, texts[0]) == 0
