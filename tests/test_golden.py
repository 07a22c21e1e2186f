"""The per-template oracle values equal what the standard library computes."""

from golden_gen import all_golden

from progcorpus.plans.golden import GOLDEN, TOKENS


def test_golden_values_are_current():
    fresh = all_golden()
    for v, g in fresh.items():
        tokens = g.pop("tokens")
        g.pop("kinds")
        assert g == GOLDEN[v], v
        assert [tuple(t) for t in tokens] == [tuple(t) for t in TOKENS[v]], v


def test_fixture_node_counts():
    # FIXTURES.md §4
    assert [GOLDEN[v]["n_nodes"] for v in range(20)] == [17, 17, 12, 19, 24, 21, 0, 0, 0, 12, 15, 44, 12, 12, 1, 248,
                                                            26, 26, 16, 16]
