"""Edits located by aligned branches of two fingerprints."""

import random

from tallyweave.llm import fingerprint

LINES = [f"Line {i} has words of its own." for i in range(60)]  # two leaves each


def _edits(a, b):
    return fingerprint.locate_edits(*(fingerprint.fingerprint("\n".join(x)) for x in (a, b)))


def test_deletions_moves_and_copies_are_reported():
    gone = _edits(LINES, [*LINES[:30], *LINES[31:]])
    assert gone and {e.kind for e in gone} == {"deleted"} and all(e.after is None for e in gone)
    moved = _edits(LINES, [*LINES[:10], *LINES[11:40], LINES[10], *LINES[40:]])
    assert "moved" in {e.kind for e in moved} and "changed" not in {e.kind for e in moved}
    copied = _edits(LINES, [*LINES[:30], LINES[5], *LINES[31:]])
    assert copied and {e.kind for e in copied} == {"changed"}
    assert {e.kind for e in _edits(LINES, [*LINES[:20], "", *LINES[20:]])} == {"added"}


def test_no_edit_goes_unseen():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.choice(LINES[:12]) for _ in range(rng.randrange(1, 30))]
        b = list(a)
        for _ in range(rng.randrange(1, 4)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = [rng.choice(["", *LINES[:12]])] if rng.random() < 0.6 else []
        assert bool(_edits(a, b)) == ("\n".join(a) != "\n".join(b))
