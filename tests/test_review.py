"""Review operators on inputs longer than their loops once were."""

from tallyweave.operators import review


def test_long_chains_reach_their_root(spark):
    rows = [(f"c{i}", f"c{i - 1}" if i else None, "open" if i % 2 else "done") for i in range(45)] + [("x", "y", "open"), ("y", "x", "open")]
    got = {(r.root, r.state): r.n for r in review.cards_by_root(spark.createDataFrame(rows, "id string, parent string, state string").coalesce(1)).collect()}
    assert got == {("c0", "done"): 23, ("c0", "open"): 22, ("x", "open"): 1, ("y", "open"): 1}
