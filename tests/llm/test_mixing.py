from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from enthyme.llm.mixing import MOST_SOURCES, exact, mixed_rows, period, phases, shares


@settings(max_examples=80, deadline=None)
@given(st.lists(st.floats(0.001, 1000), min_size=1, max_size=25))
def test_a_period_never_strays_by_a_block(weights):
    parts = shares({str(i): w for i, w in enumerate(weights)}, max(200, 10 * len(weights)))
    q = sum(parts.values())
    assert q == max(200, 10 * len(weights)) and min(parts.values()) >= 1
    slots = period(parts)
    assert sorted(s for own in slots.values() for s in own) == list(range(q))
    for k, n in parts.items():
        for i, s in enumerate(slots[k]):
            assert i * q // n <= s < -(-(i + 1) * q // n)  # inside the block's window, so the lag is below one block


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.tuples(st.integers(0, 700), st.integers(0, 90).map(lambda x: x / 10)), min_size=1, max_size=9))
def test_phases_place_every_block_once(sources):
    blocks = {k: n for k, (n, _) in sources.items()}
    plan = phases(blocks, {k: w for k, (_, w) in sources.items()})
    taken = Counter()
    for p in plan:
        for b in range(p["first"], p["last"] + 1):
            j = b - p["first"]
            taken[p["begin"] + j // len(p["slots"]) * p["q"] + p["slots"][j % len(p["slots"])]] += 1
    assert sorted(taken) == list(range(sum(blocks.values()))) and set(taken.values()) <= {1}
    for k, n in blocks.items():
        assert sorted(b for p in plan if p["source"] == k for b in range(p["first"], p["last"] + 1)) == list(range(n))


def test_rows_are_all_there_and_on_target(documents):
    sizes = {"big": 3000, "mid": 700, "low": 90, None: 40}
    rows = [(i, "t", "en", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))] + [(5, "t", "en", "big"), (None, None, None, "low")]
    weights = {"big": 0.5, "mid": 0.3, "low": 0.15, None: 0.05}
    df = documents(rows)
    out = mixed_rows(df, weights, block_rows=10, bucket_rows=200)
    assert out.columns == [*df.columns, "mix_slot", "mix_seat", "mix_block", "mix_weight"]
    got = out.collect()
    assert Counter(map(str, (r.doc_id for r in got))) == Counter(str(r[0]) for r in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.mix_slot, []).append(r)
    assert sorted(slots) == list(range(len(slots)))
    for own in slots.values():
        assert len({(r.source, r.mix_block) for r in own}) == 1 and sorted(r.mix_seat for r in own) == list(range(len(own)))
    had = Counter()
    for s in range(len(slots)):
        had[slots[s][0].source] += 1
        if s < 60:  # no source is used up yet
            for k, w in weights.items():
                assert abs(had[k] - Fraction(str(w)) * (s + 1)) < 1


def test_odd_tables(documents):
    assert mixed_rows(documents([])).collect() == []
    assert mixed_rows(documents([(1, None, None, None)])).first().mix_slot == 0
    many = documents([(i, "t", "en", f"s{i}") for i in range(300)])
    assert sorted(r.mix_slot for r in mixed_rows(many).collect()) == list(range(300)) and MOST_SOURCES >= 300
    nulls = mixed_rows(documents([(None, f"t{i}", "en", "a") for i in range(400)]), block_rows=10, bucket_rows=50)
    assert sorted(10 * r.mix_slot + r.mix_seat for r in nulls.collect()) == list(range(400))
    left = mixed_rows(documents([(i, "t", "en", "ab"[i % 2]) for i in range(200)]), {"a": 1.0}, block_rows=10).collect()
    assert len(left) == 200 and max(r.mix_slot for r in left if r.source == "a") < min(r.mix_slot for r in left if r.source == "b")


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": Fraction(1, 3), "b": Fraction(1, 7), "c": Fraction(11, 21)}, {"a": 0.0001, "b": 0.9999}, {"a": 0.5, "b": 0.4997, "c": 0.0003}])
def test_exact_weights_over_many_slots(weights):
    """After any of 200 000 slots each source is less than one block from its exact share."""
    total = sum(Fraction(str(w)) for w in weights.values())
    plan = {p["source"]: p for p in reversed(phases(dict.fromkeys(weights, 10**9), weights))}  # the first phase of each
    for k, w in weights.items():
        p, share = plan[k], Fraction(str(w)) / total
        for had in range(int(share * 200_000)):
            slot = p["begin"] + had // len(p["slots"]) * p["q"] + p["slots"][had % len(p["slots"])]
            # `had` blocks before this slot, one more after it
            assert abs(had - share * slot) < 1 and abs(had + 1 - share * (slot + 1)) < 1


def test_weights_without_a_period_raise():
    with pytest.raises(ValueError, match="common denominator"):
        exact({"a": 0.1234567, "b": 0.3333333})
