"""Mixing against exact targets, on more slots than a cycle of the rounded weights would have."""

from fractions import Fraction

import numpy as np
import pytest

from tallyweave.llm import mixing


def _shares(blocks, weights):
    """Blocks of each source after every slot if all were served at once, in exact fractions."""
    got, out, left = dict.fromkeys(blocks, Fraction(0)), [], {s: Fraction(n) for s, n in blocks.items()}
    for _ in range(sum(blocks.values())):
        room = Fraction(1)
        while room and (live := [s for s in blocks if left[s]]):
            total = sum(Fraction(weights[s]) for s in live)
            step = min([room, *(left[s] * total / Fraction(weights[s]) for s in live)])
            for s in live:
                x = step * Fraction(weights[s]) / total
                got[s], left[s] = got[s] + x, left[s] - x
            room -= step
        out.append(dict(got))
    return out


@pytest.mark.parametrize(
    ("blocks", "weights"),
    [
        ({"a": 40, "b": 25, "c": 7, "d": 1, "e": 90}, {"a": 0.5, "b": 0.3, "c": 0.19, "d": 0.01, "e": 0.2}),
        ({s: 11 + i for i, s in enumerate("abcdefg")}, {s: 1 / 3 + i**0.7 for i, s in enumerate("abcdefg")}),
        ({"a": 60, "b": 60, "c": 60}, {"a": 1, "b": 1, "c": 1}),
        ({"a": 3, "b": 200}, {"a": 0.0007, "b": 0.9993}),
    ],
)
def test_within_one_block_of_the_exact_share_to_the_end(blocks, weights):
    slots = mixing.schedule(blocks, weights)
    placed = {s: mixing.slots_of(slots, s, np.arange(n)) for s, n in blocks.items()}
    assert sorted(t for x in placed.values() for t in x) == list(range(sum(blocks.values())))
    for t, share in enumerate(_shares(blocks, weights)):
        for s in blocks:
            assert abs(int((placed[s] <= t).sum()) - share[s]) < 1


@pytest.mark.parametrize(
    ("weights", "total"),
    [(dict.fromkeys(map(str, range(20)), 0.05), 20_000), ({"large": 0.9, **{f"small{i}": 0.1 / 500 for i in range(500)}}, 12_000)],
)
def test_targets_hold_on_many_slots(weights, total):
    """Sources with blocks enough for all slots looked at: after any of these each is within a block of its target."""
    whole = sum(map(Fraction, weights.values()))
    blocks = {s: int(total * w) + 2 for s, w in weights.items()}
    slots, t = mixing.schedule(blocks, weights), np.arange(1, total + 1)
    for s, w in weights.items():
        taken = np.searchsorted(np.sort(mixing.slots_of(slots, s, np.arange(blocks[s]))), t)
        assert np.abs(taken - float(Fraction(w) / whole) * t).max() < 1 + 1e-6


def test_every_source_is_scheduled_on_its_own(spark):
    """600 equal sources beside a large one, more than were once told apart, and one with a given weight."""
    rows = [(i, "large") for i in range(6000)] + [(10_000 + i, f"small{i % 600:03}") for i in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    power = {"large": (6000 / 18_000) ** 0.7, **{f"small{i:03}": (20 / 18_000) ** 0.7 for i in range(600)}}
    targets = {s: x / sum(power.values()) for s, x in power.items()} | {"small599": 0.05}
    for limit in (mixing.BROADCAST_BLOCKS, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(mixing, "BROADCAST_BLOCKS", limit)
            got = mixing.mix(df, {"small599": 0.05}, block=1).orderBy("position").collect()
        assert [r.position for r in got] == list(range(len(rows))) and {r.doc_id for r in got} == {i for i, _ in rows}
        assert all(r.stream == r.source for r in got)
        order, total = np.array([r.source for r in got]), sum(targets.values())
        t = np.arange(1, 301)  # before the given weight's source ends
        for s, x in targets.items():
            assert np.abs(np.cumsum(order[:300] == s) - x / total * t).max() < 1 + 1e-6


def test_short_blocks_leave_no_gaps(spark):
    rows = [(i, None if i % 7 == 0 else f"s{i % 7 % 3}") for i in range(1000)]
    got = mixing.mix(spark.createDataFrame([*rows, *rows[:30]], "doc_id long, source string"), block=8).collect()
    assert sorted(r.position for r in got) == list(range(1030))
    for s in {r.stream for r in got}:
        for b in {r.block for r in got if r.stream == s}:
            own = sorted(r.position for r in got if (r.stream, r.block) == (s, b))
            assert own == list(range(own[0], own[0] + len(own)))
