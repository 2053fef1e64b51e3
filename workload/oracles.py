"""DuckDB SQL for the registered queries, composed from shared WITH clauses."""

from __future__ import annotations

CTES = {
    "raw": """raw AS (
        SELECT o_custkey AS user_key, l_partkey AS movie_id,
               (floor((l_quantity - 1) / 5) + 1) * 0.5 AS rating, epoch(l_shipdate)::BIGINT AS ts,
               l_orderkey, l_linenumber, l_suppkey
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "ratings": """ratings AS (
        SELECT 'ML_' || user_key AS user_id, movie_id::INTEGER AS movie_id, rating::DOUBLE AS rating, ts AS "timestamp"
        FROM raw WHERE rating BETWEEN 0.5 AND 5.0
        QUALIFY row_number() OVER (PARTITION BY user_key, movie_id
            ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) = 1)""",
}


def _core(name: str, source: str, min_user: int, min_item: int, rounds: int) -> str:
    """k-core unrolled: a movie pass then a user pass per round."""
    parts, last = [], source
    for r in range(rounds):
        parts.append(f"""{name}_m{r} AS (SELECT * FROM {last}
            WHERE movie_id IN (SELECT movie_id FROM {last} GROUP BY 1 HAVING count(*) >= {min_item}))""")
        parts.append(f"""{name}_u{r} AS (SELECT * FROM {name}_m{r}
            WHERE user_id IN (SELECT user_id FROM {name}_m{r} GROUP BY 1 HAVING count(*) >= {min_user}))""")
        last = f"{name}_u{r}"
    parts.append(f"{name} AS (SELECT * FROM {last})")
    return ",\n".join(parts)


CTES["core"] = _core("core", "ratings", 10, 10, 3)
CTES["split"] = """ranked AS (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp", movie_id) AS rk,
               count(*) OVER (PARTITION BY user_id) AS n FROM core),
    sized AS (SELECT *, greatest(1, floor(n * 0.8::DOUBLE))::BIGINT AS t0, greatest(1, floor(n * 0.1::DOUBLE))::BIGINT AS v0 FROM ranked),
    fixed AS (SELECT *, CASE WHEN n - t0 - v0 < 1 THEN greatest(1, n - 2) ELSE t0 END AS nt,
                     CASE WHEN n - t0 - v0 < 1 THEN 1 ELSE v0 END AS nv FROM sized),
    split AS (SELECT user_id, movie_id, rating, "timestamp",
        CASE WHEN rk <= nt THEN 'train' WHEN rk <= nt + nv THEN 'val' ELSE 'test' END AS split FROM fixed)"""
CTES["maps"] = """user_map AS (SELECT user_id, (row_number() OVER (ORDER BY user_id) - 1)::INTEGER AS user_idx
        FROM (SELECT DISTINCT user_id FROM split)),
    movie_map AS (SELECT movie_id, (row_number() OVER (ORDER BY movie_id) - 1)::INTEGER AS movie_idx
        FROM (SELECT DISTINCT movie_id FROM split))"""
CTES["inter"] = """indexed AS (SELECT * FROM split JOIN movie_map USING (movie_id) JOIN user_map USING (user_id)),
    umeans AS (SELECT user_id, avg(rating) AS um FROM indexed WHERE split = 'train' GROUP BY 1),
    inter AS (SELECT indexed.*, rating - coalesce(um, (SELECT avg(rating) FROM indexed WHERE split = 'train')) AS rating_centered
        FROM indexed LEFT JOIN umeans USING (user_id)),
    train AS (SELECT * FROM inter WHERE split = 'train'),
    val AS (SELECT * FROM inter WHERE split = 'val'),
    test AS (SELECT * FROM inter WHERE split = 'test')"""

RATINGS = ["raw", "ratings"]
CORE = [*RATINGS, "core"]
SPLIT = [*CORE, "split"]
MAPS = [*SPLIT, "maps"]
TRAIN = [*MAPS, "inter"]


def with_ctes(names: list[str], body: str) -> str:
    """``body`` after the named clauses; a body may start with a comma and add its own."""
    return "WITH " + ",\n".join(CTES[n] for n in names) + "\n" + body if names else body
