"""Features, graph, ranking and evaluation."""

from pyspark.sql import functions as F

from marquee.functions import scalars as S
from marquee.functions import vectors as V
from marquee.functions.ranking import top_n_per_key
from marquee.operators import clean, describe, features, graph, prepare, ranking_eval, sampling, score
from workload.adapter import TEXT_DIM, VOCAB, Tables
from workload.core_queries import IMDB, LINKS, NOT_WS, TEXT, WS
from workload.oracles import CTES, TRAIN
from workload.registry import query

_VOCAB_SQL = "[" + ", ".join(f"'{g}'" for g in VOCAB) + "]"

CTES["norm"] = f"""norm AS (SELECT tconst, list_filter(string_split(coalesce(genres, ''), ','), lambda g: list_contains({_VOCAB_SQL}, g)) AS gl,
        (CASE WHEN runtime IS NULL THEN 100 ELSE least(greatest(runtime, 60), 240) END - 60) / 180 AS rn,
        (coalesce("averageRating", (SELECT median("averageRating") FROM imdb)) - 1) / 9 AS vn,
        ln(1 + coalesce("numVotes", 0)) / (SELECT max(ln(1 + coalesce("numVotes", 0))) FROM imdb) AS ln FROM imdb)"""
CTES["item_imdb"] = """item_imdb AS (SELECT movie_idx, n.*, n.tconst IS NOT NULL AS matched
        FROM movie_map LEFT JOIN keyed USING (movie_id) LEFT JOIN norm n ON n.tconst = keyed.tconst)"""
CTES["item_text"] = f"""item_text AS (SELECT movie_idx, CASE WHEN length(regexp_replace(overview, '^{WS}+|{WS}+$', '', 'g')) > 0 THEN overview END AS overview
        FROM movie_map LEFT JOIN links USING (movie_id) LEFT JOIN tmdb ON tmdb.tmdb_id = nullif(links.tmdb_id, 0))"""
ITEM_IMDB = [*TRAIN, *LINKS, "keyed", *IMDB, "norm", "item_imdb"]
ITEM_TEXT = [*TRAIN, *LINKS, "tmdb", "item_text"]

CTES["iv"] = """iv_raw AS (SELECT movie_idx, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x
        FROM movie_map JOIN embeddings ON vec_id = movie_id),
    iv AS (SELECT movie_idx, pos, x * (1 / sqrt(sum(x * x) OVER (PARTITION BY movie_idx))) AS x FROM iv_raw)"""
CTES["hist"] = """hist_sum AS (SELECT user_idx, pos, sum(rating * x) AS s FROM train JOIN iv USING (movie_idx) GROUP BY ALL),
    hist_mean AS (SELECT user_idx, pos, coalesce(s, 0) / w AS s FROM (SELECT user_idx, sum(rating) AS w FROM train GROUP BY 1)
        CROSS JOIN (SELECT unnest(range(64)) AS pos) LEFT JOIN hist_sum USING (user_idx, pos)),
    hist AS (SELECT user_idx, pos, CASE WHEN nn = 0 THEN 0 ELSE s / nn END AS x FROM (
        SELECT *, sqrt(sum(s * s) OVER (PARTITION BY user_idx)) AS nn FROM hist_mean))"""
CTES["content"] = """uvec AS (SELECT user_idx, list(x ORDER BY pos) AS p FROM hist GROUP BY 1),
    ivec AS (SELECT movie_idx, coalesce(q, list_resize([]::DOUBLE[], 64, 0.0)) AS q FROM movie_map LEFT JOIN (
        SELECT movie_idx, list(x ORDER BY pos) AS q FROM iv GROUP BY 1) USING (movie_idx)),
    content AS (SELECT user_idx, movie_idx, 5 * list_dot_product(p, q) AS score FROM uvec CROSS JOIN ivec),
    content_masked AS (SELECT * FROM content ANTI JOIN train USING (user_idx, movie_idx)),
    content_top AS (SELECT user_idx, movie_idx, score, row_number() OVER (PARTITION BY user_idx ORDER BY round(score, 9) DESC, movie_idx) AS rank
        FROM content_masked QUALIFY rank <= 20)"""
CTES["pop_top"] = """pop AS (SELECT movie_idx, count(*)::DOUBLE AS score FROM train GROUP BY 1),
    pop_top AS (SELECT user_idx, movie_idx, score, row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, movie_idx) AS rank
        FROM (SELECT user_idx, movie_idx, coalesce(score, 0) AS score FROM user_map CROSS JOIN movie_map LEFT JOIN pop USING (movie_idx))
        ANTI JOIN train USING (user_idx, movie_idx) QUALIFY rank <= 20)"""
VECS = [*TRAIN, "iv"]
HIST = [*VECS, "hist"]
CONTENT = [*HIST, "content"]
POP = [*TRAIN, "pop_top"]

CTES["truth"] = "truth AS (SELECT DISTINCT user_idx, movie_idx FROM test WHERE rating >= 4.0)"


def eval_ctes(top: str, name: str, prefix: str) -> str:
    """Metrics of the top-k CTE ``top`` as the CTE ``prefix``_report."""
    ks = (5, 10, 20)
    cols = ", ".join(
        f"coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= {k}), 0) / any_value((SELECT sum(1 / log2(r + 1)) FROM range(1, least(n_rel, {k})::BIGINT + 1) t(r))) AS \"ndcg@{k}\", "
        f"count(*) FILTER (hit AND rank <= {k}) / any_value(n_rel)::DOUBLE AS \"recall@{k}\"" for k in ks)
    names = [f"{m}@{k}" for k in ks for m in ("ndcg", "recall")]
    means = ", ".join(f'avg("{n}") AS "{n}"' for n in names)
    cells = ", ".join(f"('{n}', \"{n}\")" for n in names)
    return f"""{prefix}_users AS (SELECT user_idx, count(*) AS n_rel FROM truth GROUP BY 1
        HAVING user_idx IN (SELECT user_idx FROM {top} GROUP BY 1 HAVING count(*) >= 20)),
    {prefix}_hits AS (SELECT t.user_idx, rank, n_rel, truth.movie_idx IS NOT NULL AS hit FROM {top} t JOIN {prefix}_users USING (user_idx)
        LEFT JOIN truth ON truth.user_idx = t.user_idx AND truth.movie_idx = t.movie_idx),
    {prefix}_per AS (SELECT user_idx, {cols} FROM {prefix}_hits GROUP BY user_idx),
    {prefix}_seg AS (SELECT *, unnest(['overall', CASE WHEN (SELECT count(*) FROM train WHERE train.user_idx = p.user_idx) < 20 THEN 'cold' ELSE 'warm' END]) AS segment
        FROM {prefix}_per p),
    {prefix}_wide AS (SELECT segment, {means}, count(*)::DOUBLE AS n_users FROM {prefix}_seg GROUP BY 1),
    {prefix}_report AS (SELECT '{name}' AS model, segment, metric, value FROM {prefix}_wide,
        LATERAL (VALUES {cells}, ('n_users', n_users)) v(metric, value))"""


CTES["pop_report"] = eval_ctes("pop_top", "Popularity", "pop")
CTES["content_report"] = eval_ctes("content_top", "TwoTower", "content")
CTES["report"] = "report AS (SELECT * FROM pop_report UNION ALL SELECT * FROM content_report)"
REPORT = [*HIST, "content", "pop_top", "truth", "pop_report", "content_report", "report"]


def popularity_factors(t: Tables):
    """Popularity as a rank-1 factor model, so it shares the block scorer."""
    users = t.user_map.select("user_idx", F.array(F.lit(1.0)).alias("vec"), F.lit(0.0).alias("bias"))
    counts = t.train.groupBy("movie_idx").agg(F.count("*").cast("double").alias("cnt"))
    items = t.movie_map.join(counts, "movie_idx", "left").select(
        "movie_idx", F.array(F.coalesce("cnt", F.lit(0.0))).alias("vec"), F.lit(0.0).alias("bias"))
    return users, items


def popularity_top(t: Tables):
    return score.top_k_dot(*popularity_factors(t), score.seen_items(t.train))


def content_factors(t: Tables):
    users = t.history.select("user_idx", V.scaled(F.col("vec"), F.lit(5.0)).alias("vec"), F.lit(0.0).alias("bias"))
    return users, t.item_vectors.withColumn("bias", F.lit(0.0))


def content_top(t: Tables):
    return score.top_k_dot(*content_factors(t), score.seen_items(t.train))


def report_of(t: Tables):
    return ranking_eval.union_reports([
        ranking_eval.evaluate_model("Popularity", popularity_top(t), t.test, t.train),
        ranking_eval.evaluate_model("TwoTower", content_top(t), t.test, t.train),
    ])


def long(df, key: str, name: str = "x", digits: int = 6):
    """Vector rows as (key, pos, value) rounded."""
    return df.select(key, F.posexplode("vec").alias("pos", name)).withColumn(
        name, F.round(name, digits) + F.lit(0.0)).withColumn("pos", F.col("pos").cast("bigint"))


# -- item features ---------------------------------------------------------------


@query("movies_only", ["basics"], """SELECT tconst, TRY_CAST("runtimeMinutes" AS DOUBLE) AS runtime, TRY_CAST("startYear" AS DOUBLE) AS year, genres
    FROM basics WHERE "titleType" = 'movie'""")
def _(t: Tables):
    return features.movies_only(t.raw_basics())


@query("genre_list", IMDB, f"""SELECT tconst, i AS pos, g AS genre FROM (SELECT tconst, unnest(gl) AS g, generate_subscripts(gl, 1) - 1 AS i FROM (
    SELECT tconst, list_filter(string_split(coalesce(genres, ''), ','), lambda g: list_contains({_VOCAB_SQL}, g)) AS gl FROM imdb))""")
def _(t: Tables):
    known = S.genre_list(F.col("genres"), ",", VOCAB)
    return t.imdb().select("tconst", F.posexplode(known).alias("pos", "genre")).withColumn(
        "pos", F.col("pos").cast("bigint"))


@query("imdb_join", IMDB, """SELECT tconst, runtime, round("averageRating", 6) AS "averageRating", "numVotes" FROM imdb""")
def _(t: Tables):
    return t.imdb().select("tconst", "runtime", F.round("averageRating", 6).alias("averageRating"), "numVotes")


for _name, _col in (("runtime_norm", "rn"), ("avg_vote_norm", "vn"), ("log_votes_norm", "ln")):
    @query(_name, [*IMDB, "norm"], f"SELECT tconst, round({_col}, 6) AS {_name} FROM norm")
    def _(t: Tables, name=_name):
        return features.normalised_imdb(t.imdb(), VOCAB).select("tconst", F.round(name, 6).alias(name))


@query("genre_multi_hot", [*IMDB, "norm"], f"""SELECT tconst, pos, list_contains(gl, ({_VOCAB_SQL})[pos + 1])::INT::DOUBLE AS x
    FROM norm, (SELECT unnest(range({len(VOCAB)})) AS pos)""")
def _(t: Tables):
    hot = S.genre_multi_hot(F.col("genre_list"), VOCAB).alias("vec")
    return long(features.normalised_imdb(t.imdb(), VOCAB).select("tconst", hot), "tconst")


@query("item_imdb", ITEM_IMDB, "SELECT movie_idx, tconst, matched, round(rn, 6) AS runtime_norm FROM item_imdb")
def _(t: Tables):
    items = features.item_imdb(t.movie_map, t.links(), features.normalised_imdb(t.imdb(), VOCAB))
    return items.select(
        "movie_idx", F.when(F.col("matched"), F.col("tconst")).alias("tconst"), "matched",
        F.round("runtime_norm", 6).alias("runtime_norm"))


@query("build_imdb_features", ITEM_IMDB, f"""SELECT movie_idx, pos, round(CASE WHEN NOT matched THEN 0 WHEN pos = {len(VOCAB)} THEN rn WHEN pos = {len(VOCAB) + 1} THEN vn
    WHEN pos = {len(VOCAB) + 2} THEN ln ELSE list_contains(gl, ({_VOCAB_SQL})[pos + 1])::INT END, 6)::DOUBLE AS x
    FROM item_imdb, (SELECT unnest(range({len(VOCAB) + 3})) AS pos)""")
def _(t: Tables):
    return long(features.build_imdb_features(t.movie_map, t.links(), t.imdb(), VOCAB), "movie_idx")


@query("primary_genre", ITEM_IMDB, f"""SELECT movie_idx, coalesce(list_position({_VOCAB_SQL}, gl[1]) - 1, {len(VOCAB)})::INTEGER AS genre_idx FROM item_imdb""")
def _(t: Tables):
    return features.primary_genre(t.movie_map, t.links(), features.movies_only(t.raw_basics()), VOCAB)


@query("item_text", ITEM_TEXT, "SELECT * FROM item_text")
def _(t: Tables):
    return features.item_text(t.movie_map, t.links(), t.tmdb())


@query("match_rate", [*ITEM_IMDB, "tmdb", "item_text"], """SELECT count(*) AS n_items, count(*) FILTER (matched) AS n_matched, count(overview) AS n_with_text,
    round(count(*) FILTER (matched) / count(*)::DOUBLE * 100, 6) AS pct_matched, round(count(overview) / count(*)::DOUBLE * 100, 6) AS pct_with_text
    FROM item_imdb JOIN item_text USING (movie_idx)""")
def _(t: Tables):
    imdb = features.build_imdb_features(t.movie_map, t.links(), t.imdb(), VOCAB)
    both = imdb.join(features.item_text(t.movie_map, t.links(), t.tmdb()), "movie_idx")
    return describe.match_rate(both, F.col("matched"), F.col("overview").isNotNull()).withColumns(
        {c: F.round(c, 6) for c in ("pct_matched", "pct_with_text")})


@query("text_embed", ITEM_TEXT, """, words AS (SELECT movie_idx, unnest(regexp_extract_all(lower(overview), '[\\p{L}\\p{N}]+')) AS word FROM item_text WHERE overview IS NOT NULL),
    tf AS (SELECT movie_idx, ('0x' || substr(md5('slot:' || word), 1, 15))::BIGINT % 384 AS slot, count(*) AS tf FROM words GROUP BY ALL),
    weighted AS (SELECT movie_idx, slot, tf * ln(((SELECT count(overview) FROM item_text) + 1) / (df + 1.0::DOUBLE)) AS w
        FROM tf JOIN (SELECT slot, count(*) AS df FROM tf GROUP BY 1) USING (slot)),
    normed AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY movie_idx)) AS nn FROM weighted)
    SELECT movie_idx, slot, round(w / nn, 6) + 0.0 AS weight FROM normed WHERE nn > 0""")
def _(t: Tables):
    texts = features.item_text(t.movie_map, t.links(), t.tmdb())
    return features.text_embed(texts, 384).withColumn("weight", F.round("weight", 6) + F.lit(0.0))


@query("attach_vectors", VECS, """SELECT movie_idx, pos, round(coalesce(x, 0), 6) + 0.0 AS x FROM (SELECT movie_idx, unnest(range(64)) AS pos FROM movie_map)
    LEFT JOIN iv USING (movie_idx, pos)""")
def _(t: Tables):
    return long(t.item_vectors, "movie_idx")


@query("popularity", TRAIN, """SELECT movie_idx, round(ln(1 + coalesce(n, 0)) / (SELECT max(ln(1 + c)) FROM (SELECT count(*) AS c FROM train GROUP BY movie_idx)), 6) AS pop
    FROM movie_map LEFT JOIN (SELECT movie_idx, count(*) AS n FROM train GROUP BY 1) USING (movie_idx)""")
def _(t: Tables):
    return features.popularity(t.train, t.movie_map).withColumn("pop", F.round("pop", 6))


@query("popularity_minmax", TRAIN, """SELECT movie_idx, round((l - min(l) OVER ()) / (max(l) OVER () - min(l) OVER () + 1e-8), 6) AS pop_norm FROM (
    SELECT movie_idx, ln(1 + coalesce(n, 0)) AS l FROM movie_map LEFT JOIN (SELECT movie_idx, count(*) AS n FROM train GROUP BY 1) USING (movie_idx))""")
def _(t: Tables):
    counts = t.train.groupBy("movie_idx").agg(F.count("*").alias("cnt"))
    raw = t.movie_map.join(counts, "movie_idx", "left").select("movie_idx", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    return features.popularity_minmax(raw, "cnt").withColumn("pop_norm", F.round("pop_norm", 6))


@query("history_embedding", HIST, "SELECT user_idx, pos, round(x, 6) + 0.0 AS x FROM hist")
def _(t: Tables):
    return long(features.history_embedding(t.train, t.item_vectors, TEXT_DIM), "user_idx")


@query("recency_history", VECS, """SELECT user_idx, pos, round(sum(coalesce(x, 0) * pow(0.5, r - 1)) / (SELECT sum(pow(0.5, i)) + 1e-8 FROM range(50) t(i)), 6) + 0.0 AS x
    FROM (SELECT user_idx, movie_idx, row_number() OVER (PARTITION BY user_idx ORDER BY "timestamp" DESC, movie_idx DESC) AS r FROM train QUALIFY r <= 50)
    CROSS JOIN (SELECT unnest(range(64)) AS pos) LEFT JOIN iv USING (movie_idx, pos) GROUP BY ALL""")
def _(t: Tables):
    return long(features.recency_history(t.train, t.item_vectors, TEXT_DIM), "user_idx")


@query("cosine_score", CONTENT, "SELECT user_idx, movie_idx, round(score, 6) + 0.0 AS score FROM content SEMI JOIN test USING (user_idx, movie_idx)")
def _(t: Tables):
    pairs = t.test.select("user_idx", "movie_idx").join(
        t.history.withColumnRenamed("vec", "p"), "user_idx").join(t.item_vectors.withColumnRenamed("vec", "q"), "movie_idx")
    return pairs.select(
        "user_idx", "movie_idx", (F.round(V.cosine_score(F.col("p"), F.col("q")), 6) + F.lit(0.0)).alias("score"))


# -- graph -----------------------------------------------------------------------

CTES["edges"] = """edges AS (SELECT user_idx AS src, (movie_idx + (SELECT count(*) FROM user_map))::INTEGER AS dst, 1.0::DOUBLE AS w FROM train
        UNION ALL SELECT (movie_idx + (SELECT count(*) FROM user_map))::INTEGER, user_idx, 1.0::DOUBLE FROM train),
    deg AS (SELECT src AS node, sum(w) AS d FROM edges GROUP BY 1),
    adj AS (SELECT src, dst, w / sqrt(a.d) / sqrt(b.d) AS w FROM edges JOIN deg a ON a.node = src JOIN deg b ON b.node = dst)"""
GRAPH = [*TRAIN, "edges"]


@query("bidirectional_edges", TRAIN, "SELECT user_idx AS src, movie_idx AS dst FROM train UNION ALL SELECT movie_idx, user_idx FROM train")
def _(t: Tables):
    return graph.bidirectional_edges(t.train)


@query("bipartite_edges", GRAPH, "SELECT * FROM edges")
def _(t: Tables):
    return graph.bipartite_edges(t.train, t.n_users)


@query("node_degree", GRAPH, "SELECT node AS src, d AS degree FROM deg")
def _(t: Tables):
    return graph.node_degree(graph.bipartite_edges(t.train, t.n_users))


@query("sym_normalise", GRAPH, "SELECT src, dst, round(w, 6) AS w FROM adj")
def _(t: Tables):
    return graph.sym_normalise(graph.bipartite_edges(t.train, t.n_users)).withColumn("w", F.round("w", 6))


CTES["node_vecs"] = """e0 AS (SELECT user_idx AS node, pos, x FROM hist UNION ALL
        SELECT (movie_idx + (SELECT count(*) FROM user_map))::INTEGER, pos, coalesce(x, 0)
        FROM movie_map CROSS JOIN (SELECT unnest(range(64)) AS pos) LEFT JOIN iv USING (movie_idx, pos)),
    e1 AS (SELECT dst AS node, pos, sum(w * x) AS x FROM adj JOIN e0 ON node = src GROUP BY ALL),
    e2 AS (SELECT dst AS node, pos, sum(w * x) AS x FROM adj JOIN e1 ON node = src GROUP BY ALL)"""
NODES = [*HIST, "edges", "node_vecs"]


def node_vectors(t: Tables):
    items = t.item_vectors.select((F.col("movie_idx") + t.n_users).alias("node"), "vec")
    return t.history.select(F.col("user_idx").alias("node"), "vec").unionByName(items)


@query("edge_join", NODES, "SELECT node, pos, round(x, 6) + 0.0 AS x FROM e1")
def _(t: Tables):
    return long(graph.neighbour_sum(t.sliced_adjacency, node_vectors(t), TEXT_DIM), "node")


@query("propagate", NODES, """SELECT node, pos, round(sum(x) / 3, 6) + 0.0 AS x FROM (SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2) GROUP BY ALL""")
def _(t: Tables):
    return long(graph.propagate(t.sliced_adjacency, node_vectors(t), TEXT_DIM), "node")


# -- scoring and ranking -----------------------------------------------------------


@query("score_pairs", CONTENT, "SELECT user_idx, movie_idx, rank, round(score, 6) + 0.0 AS score FROM content_top")
def _(t: Tables):
    return content_top(t).withColumns({"score": F.round("score", 6) + F.lit(0.0), "rank": F.col("rank").cast("bigint")})


@query("seen_items", TRAIN, "SELECT DISTINCT user_idx, movie_idx FROM train")
def _(t: Tables):
    return score.seen_items(t.train)


@query("mask_seen", TRAIN, "SELECT user_idx, movie_idx, rating AS score FROM inter WHERE split <> 'train'")
def _(t: Tables):
    scores = t.interactions.select("user_idx", "movie_idx", F.col("rating").alias("score"))
    return score.mask_seen(scores, score.seen_items(t.train))


@query("top_k", TRAIN, """SELECT user_idx, movie_idx, round(rating_centered, 6) AS score, row_number() OVER (PARTITION BY user_idx ORDER BY round(rating_centered, 9) DESC, movie_idx) AS rank
    FROM train QUALIFY rank <= 20""")
def _(t: Tables):
    scores = t.train.select("user_idx", "movie_idx", F.col("rating_centered").alias("score"))
    return score.top_k(scores).withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("bigint")})


@query("item_rank", TRAIN, """SELECT user_idx, movie_idx, rank FROM (SELECT user_idx, movie_idx, split, row_number() OVER (
    PARTITION BY user_idx ORDER BY round(rating_centered, 9) DESC, movie_idx) AS rank FROM inter) WHERE split = 'test'""")
def _(t: Tables):
    scores = t.interactions.select("user_idx", "movie_idx", F.col("rating_centered").alias("score"))
    return score.item_rank(scores, t.test.select("user_idx", "movie_idx"))


@query("ground_truth", [*TRAIN, "truth"], "SELECT * FROM truth")
def _(t: Tables):
    return ranking_eval.ground_truth(t.test)


@query("candidate_guard", POP, "SELECT user_idx FROM pop_top GROUP BY 1 HAVING count(*) >= 20")
def _(t: Tables):
    return ranking_eval.candidate_guard(popularity_top(t))


PER_USER = [*POP, "truth", "pop_report"]


@query("recall_at_k", PER_USER, 'SELECT user_idx, ' + ", ".join(f'round("recall@{k}", 6) AS "recall@{k}"' for k in (5, 10, 20)) + " FROM pop_per")
def _(t: Tables):
    per = ranking_eval.per_user_metrics(popularity_top(t), ranking_eval.ground_truth(t.test))
    return per.select("user_idx", *[F.round(f"`recall@{k}`", 6).alias(f"recall@{k}") for k in (5, 10, 20)])


@query("ndcg_at_k", PER_USER, 'SELECT user_idx, ' + ", ".join(f'round("ndcg@{k}", 6) AS "ndcg@{k}"' for k in (5, 10, 20)) + " FROM pop_per")
def _(t: Tables):
    per = ranking_eval.per_user_metrics(popularity_top(t), ranking_eval.ground_truth(t.test))
    return per.select("user_idx", *[F.round(f"`ndcg@{k}`", 6).alias(f"ndcg@{k}") for k in (5, 10, 20)])


@query("segment_metrics", PER_USER, "SELECT segment, metric, round(value, 6) AS value FROM pop_report")
def _(t: Tables):
    per = ranking_eval.per_user_metrics(popularity_top(t), ranking_eval.ground_truth(t.test))
    segments = prepare.user_segment(per.select("user_idx"), t.train)
    return ranking_eval.segment_metrics(per, segments).withColumn("value", F.round("value", 6))


@query("evaluate_popularity", PER_USER, "SELECT model, segment, metric, round(value, 6) AS value FROM pop_report")
def _(t: Tables):
    return ranking_eval.evaluate_model("Popularity", popularity_top(t), t.test, t.train).withColumn(
        "value", F.round("value", 6))


@query("evaluate_model", [*CONTENT, "truth", "content_report"], "SELECT model, segment, metric, round(value, 6) AS value FROM content_report")
def _(t: Tables):
    return ranking_eval.evaluate_model("TwoTower", content_top(t), t.test, t.train).withColumn(
        "value", F.round("value", 6))


def _cell(segment: str, metric: str) -> str:
    return f"round(coalesce(max(value) FILTER (segment = '{segment}' AND metric = '{metric}@10'), 0), 6) AS {segment}_{metric}"


@query("compare_models", REPORT, "SELECT model, " + ", ".join(
    _cell(s, m) for s in ("overall", "cold") for m in ("ndcg", "recall")) + " FROM report GROUP BY 1")
def _(t: Tables):
    table = ranking_eval.compare_models(report_of(t))
    return table.select("model", *[F.round(c, 6).alias(c) for c in table.columns if c != "model"])


@query("flatten_report", REPORT, """SELECT model AS "Model", upper(segment[1]) || segment[2:] AS "Segment",
    round(max(value) FILTER (metric = 'ndcg@10'), 6) AS "NDCG@10", round(max(value) FILTER (metric = 'recall@10'), 6) AS "Recall@10" FROM report GROUP BY ALL""")
def _(t: Tables):
    flat = ranking_eval.flatten_report(ranking_eval.nested_report(report_of(t)))
    return flat.select("Model", "Segment", F.round("NDCG@10", 6).alias("NDCG@10"), F.round("Recall@10", 6).alias("Recall@10"))


CTES["user0"] = "user0 AS (SELECT * FROM content WHERE user_idx = 0)"


def first_user_scores(t: Tables):
    user = t.history.where(F.col("user_idx") == 0).select(V.scaled(F.col("vec"), F.lit(5.0))).scalar()
    return score.score_user(t.item_vectors.withColumn("bias", F.lit(0.0)), user)


@query("score_stats", [*CONTENT, "user0"], """SELECT round(min(score), 6) AS min, round(max(score), 6) AS max, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std,
    count(DISTINCT round_even(score, 4)) AS n_distinct, count(*) AS n_scores FROM user0""")
def _(t: Tables):
    return ranking_eval.score_stats(first_user_scores(t)).withColumns(
        {c: F.round(c, 6) for c in ("min", "max", "mean", "std")})


@query("uncentred_range", [*CONTENT, "user0"], """SELECT round(um, 6) AS user_mean, round(min(score + um), 6) AS min, round(max(score + um), 6) AS max, round(avg(score + um), 6) AS mean
    FROM user0, (SELECT avg(rating) AS um FROM train WHERE user_idx = 0) GROUP BY um""")
def _(t: Tables):
    mean = t.train.where(F.col("user_idx") == 0).agg(F.avg("rating")).scalar()
    return ranking_eval.uncentred_range(first_user_scores(t), mean).withColumns(
        {c: F.round(c, 6) for c in ("user_mean", "min", "max", "mean")})


@query("relevant_by_centred", TRAIN, "SELECT user_idx, movie_idx FROM test WHERE rating_centered > 0")
def _(t: Tables):
    return clean.relevant_by_centred(t.test).select("user_idx", "movie_idx")


# -- sampling ----------------------------------------------------------------------


def _triplet_sql(positives: str, popularity: str, members: str, n: str, seed: int) -> str:
    def h(*parts):
        return "('0x' || substr(md5(concat_ws(':', '" + str(seed) + "', " + ", ".join(parts) + ")), 1, 15))::BIGINT"
    return f""", pos AS (SELECT user_idx, movie_idx, row_number() OVER (PARTITION BY user_idx ORDER BY movie_idx) - 1 AS pos_no,
        count(*) OVER (PARTITION BY user_idx) AS n_pos FROM (SELECT DISTINCT user_idx, movie_idx FROM {positives})),
    mem AS ({members}),
    users AS (SELECT user_idx, n_pos, row_number() OVER (ORDER BY user_idx) - 1 AS user_no FROM (SELECT DISTINCT user_idx, n_pos FROM pos)),
    line AS (SELECT movie_idx, row_number() OVER (ORDER BY movie_idx) - 1 AS spot FROM {popularity}),
    numbers AS (SELECT i AS sample_id, {h("'user'", "i")} % (SELECT count(*) FROM users) AS user_no, {h("'pos'", "i")} AS pos_hash
        FROM (SELECT unnest(range({n})) AS i)),
    draws AS (SELECT sample_id, user_idx, pos_hash % n_pos AS pos_no FROM numbers JOIN users USING (user_no)),
    chosen AS (SELECT sample_id, user_idx, movie_idx AS pos_idx FROM draws JOIN pos USING (user_idx, pos_no)),
    tried AS (SELECT sample_id, user_idx, pos_idx, k, {h("'neg'", "sample_id", "k")} % (SELECT count(*) FROM {popularity}) AS spot
        FROM chosen CROSS JOIN (SELECT unnest(range(20)) AS k)),
    located AS (SELECT tried.*, movie_idx AS neg_idx FROM tried JOIN line USING (spot)),
    flagged AS (SELECT l.*, m.user_idx IS NOT NULL AS hit FROM located l LEFT JOIN mem m ON m.user_idx = l.user_idx AND m.movie_idx = l.neg_idx)
    SELECT sample_id, user_idx, pos_idx, coalesce(arg_min(neg_idx, k) FILTER (NOT hit), arg_max(neg_idx, k)) AS neg_idx,
        count(*) FILTER (NOT hit) = 0 AS is_false_negative FROM flagged GROUP BY sample_id, user_idx, pos_idx"""


@query("sample_triplets", TRAIN, _triplet_sql("train", "train", "SELECT DISTINCT user_idx, movie_idx FROM train", "(SELECT count(*) FROM train)", 42))
def _(t: Tables):
    return sampling.sample_triplets(t.train, prepare.item_popularity(t.train), t.train.count())


@query("eligible_users", TRAIN, "SELECT user_idx, count(*) AS n_pos FROM train WHERE rating >= 4.0 GROUP BY 1")
def _(t: Tables):
    return sampling.eligible_users(clean.positives(t.train))


CTES["val_pos"] = "val_pos AS (SELECT * FROM val WHERE rating >= 4.0)"


@query("val_triplets", [*TRAIN, "val_pos"], _triplet_sql(
    "val_pos", "train", "SELECT DISTINCT user_idx, movie_idx FROM val_pos", "greatest(10000, (SELECT count(*) FROM train) // 10)", 43))
def _(t: Tables):
    return sampling.val_triplets(clean.positives(t.val), prepare.item_popularity(t.train), t.train.count())
