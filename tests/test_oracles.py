"""A sample of the registered queries against their oracle SQL on the smallest tables."""

import pytest

from check_oracle import compare, connect
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "dedup_keep_last", "kcore_filter", "temporal_split", "build_id_map", "mean_center", "item_imdb",
    "history_embedding", "propagate", "score_pairs", "compare_models", "sample_triplets", "ease_gram",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    result = compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name])
    assert result.startswith("ok"), result


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert {r.segment for r in rows} == {"overall", "warm", "cold"}
    assert all(0 <= r.value <= 1 for r in rows if r.metric != "n_users")
