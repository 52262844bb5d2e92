"""Components within a task, links coming in parts; intersections by ranges of hashes."""

import numpy as np

from tidemark.llm.components import Joined, local_labels
from tidemark.llm.jaccard_join import overlaps


def test_links_in_parts_join_as_all_at_once():
    rnd = np.random.default_rng(5)
    for links in (0, 1, 60, 400):
        left, right = rnd.integers(0, 200, (2, links))
        joined = Joined(200)
        for part in np.array_split(np.arange(links), 7):
            joined.link(left[part], right[part])
        assert (joined.label == local_labels(200, left, right)).all()
    assert len(Joined(0).moved()) == 0


def test_overlaps_over_several_ranges():
    rnd = np.random.default_rng(6)
    pool = rnd.integers(0, 2**64, 40_000, dtype=np.uint64)
    sets = [np.unique(rnd.choice(pool, 30_000)) for _ in range(200)]
    found = overlaps(sets, np.arange(80), np.arange(80, 200))
    for i, j in [(0, 0), (7, 50), (79, 119)]:
        assert found[i, j] == len(np.intersect1d(sets[i], sets[80 + j]))


def test_a_worker_forgets_other_operators():
    from tidemark.llm import common
    from tidemark.llm.shingles import HASHES, word_hashes

    first = word_hashes([b"a", b"b"])
    common.forget_others("tidemark.llm.jaccard_join")
    assert len(HASHES) >= 2
    common.forget_others("tidemark.llm.toxicity")
    assert not HASHES and (word_hashes([b"a", b"b"]) == first).all()
