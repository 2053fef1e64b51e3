"""Families of near copies that are cut into many blocks."""

import random

import pytest

from marquee.llm import parity_join
from tests.llm import brute


@pytest.mark.parametrize("docs,hubs", [(4, 8), (3, 0.01)])
def test_families_in_blocks_equal_brute_force(spark, monkeypatch, docs, hubs):
    """Chains, stars and strangers that share half a text, in blocks of a few documents."""
    monkeypatch.setattr(parity_join, "BLOCK_DOCS", docs)
    monkeypatch.setattr(parity_join, "HUBS", hubs)
    rnd, rows = random.Random(5), []
    for family in range(4):
        base = [f"f{family}w{k}" for k in range(160)]
        for copy in range(30):
            words = list(base)
            for k in rnd.sample(range(160), (0, 2, 4, 7)[copy % 4]):
                words[k] = f"c{copy}x{k}"
            rows.append((len(rows), " ".join(words)))
        for step in range(0, 60, 6):  # a chain that drifts away
            rows.append((len(rows), " ".join(base[step:] + [f"d{family}t{k}" for k in range(step)])))
    rnd.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.jaccard_groups(table, size=5, percent=80).collect()}
    assert got == brute.jaccard(rows, 5, 80)
