"""What operators leave behind, and what a text has to travel for."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import line_dedup, parity_join
from marquee.llm import text as T
from marquee.runtime import checkpoint_root, passing, staged


def tables_of(spark):
    folder = f"{checkpoint_root(spark).removeprefix('file:')}/marquee/{spark.sparkContext.applicationId}"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_operators_leave_only_what_their_result_reads(spark):
    rnd, rows = random.Random(3), []
    for i in range(60):
        base = random.Random(i // 6)
        words = [f"w{base.randrange(900)}" for _ in range(60)]
        words[rnd.randrange(60)] = f"c{i}"
        rows.append((i, " ".join(words[:30]) + "\n" + " ".join(words[30:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = tables_of(spark)
    groups = parity_join.jaccard_groups(docs)
    assert {x.rsplit("-", 1)[0] for x in tables_of(spark) - before} == {"parity-groups"}
    assert groups.count() == 60
    before = tables_of(spark)
    assert line_dedup.dedup_lines(docs).agg(F.sum("n_lines")).first()[0] == 120
    assert line_dedup.without_lines(docs).count() == 60
    assert {x.rsplit("-", 1)[0] for x in tables_of(spark) - before} == {"gone-lines", "line-counts"}


def test_passing_keeps_tables_of_outer_blocks(spark):
    before = tables_of(spark)
    with passing(spark) as kept:
        outer = staged(spark.range(5), "outer")
        with passing(spark) as inner_kept:
            staged(spark.range(6), "inner")
            result = inner_kept(spark.range(7), "result")
        assert {x.rsplit("-", 1)[0] for x in tables_of(spark) - before} == {"outer", "result"}
        assert outer.count() + result.count() == 12
        last = kept(result, "last")
    assert {x.rsplit("-", 1)[0] for x in tables_of(spark) - before} == {"last"}
    assert last.count() == 7


def test_wide_sketches_miss_no_link_and_part_strangers():
    """Sets of all sizes and overlaps, some of them at the threshold itself."""
    rng, sets, percent = np.random.default_rng(4), [], 80
    for n in (1, 3, 40, 700, 2600, 9000):
        base = T.mix(rng.integers(0, 1 << 62, 4 * n).astype(np.uint64))
        sets.append(np.unique(base[:n]))
        for share in (0.5, 0.8, 0.88, 0.89, 0.95):
            k = round(share * n)
            sets.append(np.unique(np.concatenate([base[:k], base[n + len(sets):2 * n - k + len(sets)]])))
    n = np.array([len(x) for x in sets])
    wide = [parity_join._wide(x) for x in sets]
    want = np.zeros(len(sets), bool)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            want[i] |= i != j and 100 * both >= percent * (len(a) + len(b) - both)
    own = np.arange(len(sets))
    got = parity_join._may_link(wide, n, own, own, percent)
    assert got[want].all()
    strangers = [np.unique(T.mix(rng.integers(0, 1 << 62, m).astype(np.uint64))) for m in (3000, 3000, 3300, 9000, 9100)]
    apart = parity_join._may_link([parity_join._wide(x) for x in strangers], np.array([len(x) for x in strangers]), own[:5], own[:5], percent)
    assert not apart.any()
