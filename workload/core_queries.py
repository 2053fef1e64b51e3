"""Sources, cleaning, splitting and indexing."""

from pyspark.sql import functions as F

from marquee.functions import scalars as S
from marquee.operators import clean, describe, prepare
from marquee.plans.preprocess import preprocess
from marquee.sources import readers
from workload.adapter import RATING_ORDER, Tables
from workload.oracles import CORE, CTES, MAPS, RATINGS, SPLIT, TRAIN, _core
from workload.registry import query

CTES["core_strict"] = _core("core_strict", "ratings", 25, 20, 6)

LINKS_SQL = """links AS (SELECT p_partkey::INTEGER AS movie_id,
        CASE WHEN p_size <> 13 THEN p_partkey * 7919 + 5 END AS imdb_id,
        CASE WHEN p_size = 7 THEN 0 WHEN p_size IN (9, 11) THEN NULL ELSE p_partkey END AS tmdb_id FROM part)"""
CTES["links"] = LINKS_SQL
CTES["basics"] = """basics AS (SELECT 'tt' || lpad((p_partkey * 7919 + 5)::VARCHAR, greatest(7, length((p_partkey * 7919 + 5)::VARCHAR))::INTEGER, '0') AS tconst,
        CASE WHEN p_type = 'ECONOMY' THEN 'short' ELSE 'movie' END AS "titleType",
        CASE WHEN p_size = 4 THEN NULL ELSE (p_size * 2 + 1915)::VARCHAR END AS "startYear",
        CASE WHEN p_size = 2 THEN NULL WHEN p_size = 5 THEN 'unknown' ELSE (p_size * 6)::VARCHAR END AS "runtimeMinutes",
        CASE WHEN p_size = 3 THEN NULL ELSE replace(p_name, ' ', ',') END AS genres FROM part)"""
CTES["votes"] = """votes AS (SELECT 'tt' || lpad((p_partkey * 7919 + 5)::VARCHAR, greatest(7, length((p_partkey * 7919 + 5)::VARCHAR))::INTEGER, '0') AS tconst,
        1 + (p_retailprice - 900) / 20 AS "averageRating", n AS "numVotes"
        FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE p_size > 10)"""
CTES["tmdb"] = """tmdb AS (SELECT doc_id AS tmdb_id, source AS title,
        CASE WHEN source = 'src5' THEN '' ELSE "text" END AS overview,
        CASE WHEN lang = 'es' THEN 'unknown' ELSE (DATE '1990-01-01' + n_chars::INTEGER)::VARCHAR END AS release_date,
        NULL::DOUBLE AS vote_average, n_chars::BIGINT AS vote_count
        FROM documents WHERE source <> 'src3')"""
CTES["movies"] = "movies AS (SELECT p_partkey AS movie_id, p_name AS title, replace(p_name, ' ', '|') AS genres FROM part)"
CTES["imdb"] = """imdb AS (SELECT b.tconst, TRY_CAST("runtimeMinutes" AS DOUBLE) AS runtime, TRY_CAST("startYear" AS DOUBLE) AS year,
        genres, "averageRating", "numVotes" FROM basics b LEFT JOIN votes v USING (tconst) WHERE "titleType" = 'movie')"""
TSV = {"sep": "\t", "nullValue": "\\N", "quote": ""}
LINKS, IMDB = ["links"], ["basics", "votes", "imdb"]


# -- sources --------------------------------------------------------------------


@query("read_links", LINKS, "SELECT movie_id, imdb_id, tmdb_id FROM links")
def _(t: Tables):
    return readers.read_links(t.spark, t.file(t.raw_links(), "links", quote='"', escape='"'))


@query("read_imdb_basics", ["basics"], "SELECT * FROM basics")
def _(t: Tables):
    full = t.raw_basics().select(
        "tconst", "titleType", F.lit('a "stray quote').alias("primaryTitle"), F.lit(None).cast("string").alias("originalTitle"),
        F.lit("0").alias("isAdult"), "startYear", F.lit(None).cast("string").alias("endYear"), "runtimeMinutes", "genres")
    return readers.read_imdb_basics(t.spark, t.file(full, "basics", **TSV))


@query("read_imdb_ratings", ["votes"], 'SELECT tconst, round("averageRating", 6) AS "averageRating", "numVotes" FROM votes')
def _(t: Tables):
    votes = readers.read_imdb_ratings(t.spark, t.file(t.votes(), "votes", **TSV))
    return votes.withColumn("averageRating", F.round("averageRating", 6))


@query("read_tmdb", ["tmdb"], "SELECT * FROM tmdb")
def _(t: Tables):
    return readers.read_tmdb(t.spark, t.file(t.raw_tmdb(), "tmdb", quote='"', escape='"'))


@query("read_movies", ["movies"], "SELECT movie_id::INTEGER AS movie_id, title, genres FROM movies")
def _(t: Tables):
    return readers.read_movies(t.spark, t.file(t.movies().withColumnRenamed("movie_id", "movieId"), "movies", quote='"', escape='"'))


@query("read_ratings", ["raw"], """SELECT user_key::INTEGER AS user_id, movie_id::INTEGER AS movie_id, rating::DOUBLE AS rating, ts AS "timestamp" FROM raw""")
def _(t: Tables):
    raw = t.raw_ratings().select(
        F.col("user_id").alias("userId"), F.col("movie_id").alias("movieId"), "rating", "timestamp")
    return readers.read_ratings(t.spark, t.file(raw, "ratings", quote='"', escape='"'))


@query("preview", RATINGS, 'SELECT * FROM ratings ORDER BY "timestamp", user_id, movie_id LIMIT 10')
def _(t: Tables):
    return clean.preview(t.ratings, [F.col("timestamp"), F.col("user_id"), F.col("movie_id")], 10)


@query("id_range", ["raw"], "SELECT count(*) AS n_rows, min(movie_id)::BIGINT AS min_id, max(movie_id)::BIGINT AS max_id FROM raw")
def _(t: Tables):
    return clean.id_range(t.raw_ratings(), "movie_id")


# -- scalar steps ---------------------------------------------------------------


@query("standardise_ratings", ["raw"], """SELECT 'ML_' || user_key AS user_id, movie_id::INTEGER AS movie_id,
    rating::DOUBLE AS rating, ts AS "timestamp" FROM raw""")
def _(t: Tables):
    return clean.standardise_ratings(t.raw_ratings()).select("user_id", "movie_id", "rating", "timestamp")


@query("validate_ratings", ["raw"], """SELECT user_key AS user_id, movie_id, rating::DOUBLE AS rating FROM raw
    WHERE rating BETWEEN 1.0 AND 4.5""")
def _(t: Tables):
    return clean.validate_ratings(t.raw_ratings(), 1.0, 4.5).select("user_id", "movie_id", "rating")


@query("dedup_keep_last", RATINGS, "SELECT * FROM ratings")
def _(t: Tables):
    return clean.clean_ratings(t.raw_ratings(), RATING_ORDER)


@query("drop_report", RATINGS, """SELECT count(*) AS n_ratings, count(DISTINCT user_id) AS n_users,
    count(DISTINCT movie_id) AS n_movies, (SELECT count(*) FROM raw) - count(*) AS n_dropped FROM ratings""")
def _(t: Tables):
    return clean.drop_report(t.raw_ratings(), t.ratings)


@query("imdb_key", LINKS, """SELECT movie_id, 'tt' || lpad(imdb_id::VARCHAR, greatest(7, length(imdb_id::VARCHAR))::INTEGER, '0') AS tconst
    FROM links""")
def _(t: Tables):
    return t.links().select("movie_id", S.imdb_key(F.col("imdb_id")).alias("tconst"))


@query("epoch_parts", RATINGS, """SELECT user_id, movie_id, to_timestamp("timestamp")::TIMESTAMP::DATE AS "date",
    year(to_timestamp("timestamp")::TIMESTAMP)::INTEGER AS "year",
    date_trunc('month', to_timestamp("timestamp")::TIMESTAMP)::DATE AS "month" FROM ratings""")
def _(t: Tables):
    parts = S.epoch_parts(F.col("timestamp"))
    return t.ratings.select("user_id", "movie_id", *[c.alias(n) for n, c in parts.items()])


@query("parse_year", ["tmdb"], "SELECT tmdb_id, year(TRY_CAST(release_date AS DATE))::INTEGER AS year FROM tmdb")
def _(t: Tables):
    return t.tmdb().select("tmdb_id", S.parse_year(F.col("release_date")).alias("year"))


@query("positives", TRAIN, "SELECT user_idx, movie_idx, rating FROM train WHERE rating >= 4.0")
def _(t: Tables):
    return clean.positives(t.train).select("user_idx", "movie_idx", "rating")


# -- k-core, split, index, centring ----------------------------------------------


@query("support_semi_join", RATINGS, """SELECT * FROM ratings WHERE movie_id IN
    (SELECT movie_id FROM ratings GROUP BY 1 HAVING count(*) >= 30)""")
def _(t: Tables):
    return prepare.support_semi_join(t.ratings, "movie_id", 30).select(*t.ratings.columns)


@query("kcore_filter", CORE, "SELECT * FROM core")
def _(t: Tables):
    return prepare.kcore_filter(t.ratings).select(*t.ratings.columns)


@query("kcore_filter_strict", [*RATINGS, "core_strict"], "SELECT * FROM core_strict")
def _(t: Tables):
    return prepare.kcore_filter(t.ratings, 25, 20).select(*t.ratings.columns)


@query("temporal_split", SPLIT, "SELECT * FROM split")
def _(t: Tables):
    return prepare.temporal_split(prepare.kcore_filter(t.ratings)).select(*t.ratings.columns, "split")


@query("all_ids", MAPS, "SELECT movie_id FROM movie_map")
def _(t: Tables):
    return prepare.all_ids("movie_id", t.train, t.val, t.test)


@query("build_id_map", MAPS, "SELECT * FROM user_map")
def _(t: Tables):
    return prepare.build_id_map(t.interactions, "user_id", "user_idx")


@query("build_id_map_movies", MAPS, "SELECT * FROM movie_map")
def _(t: Tables):
    return prepare.build_id_map(t.interactions, "movie_id", "movie_idx")


@query("apply_id_map", TRAIN, 'SELECT user_idx, movie_idx, rating, "timestamp", split FROM indexed')
def _(t: Tables):
    plain = t.interactions.select("user_id", "movie_id", "rating", "timestamp", "split")
    return prepare.apply_id_map(plain, t.user_map, t.movie_map).select(
        "user_idx", "movie_idx", "rating", "timestamp", "split")


@query("user_means", TRAIN, "SELECT user_id, round(um, 6) AS user_mean FROM umeans")
def _(t: Tables):
    return prepare.user_means(t.train).select("user_id", F.round("user_mean", 6).alias("user_mean"))


@query("join_user_means", TRAIN, """SELECT r.user_id, r.movie_id, round(coalesce(um, (SELECT avg(rating) FROM train)), 6) AS user_mean
    FROM ratings r LEFT JOIN umeans USING (user_id)""")
def _(t: Tables):
    means = prepare.user_means(t.train)
    return prepare.join_user_means(t.ratings, means, t.train).select(
        "user_id", "movie_id", F.round("user_mean", 6).alias("user_mean"))


@query("mean_center", TRAIN, "SELECT user_idx, movie_idx, split, round(rating_centered, 6) AS rating_centered FROM inter")
def _(t: Tables):
    return prepare.mean_center(t.interactions.drop("rating_centered"), t.train).select(
        "user_idx", "movie_idx", "split", F.round("rating_centered", 6).alias("rating_centered"))


@query("matrix_stats", TRAIN, """SELECT count(*) AS nnz, round(min(rating_centered), 6) AS min_value, round(max(rating_centered), 6) AS max_value,
    round(avg(rating_centered), 6) + 0.0 AS mean_value, (SELECT count(*) FROM user_map) AS n_users, (SELECT count(*) FROM movie_map) AS n_items,
    round(count(*) / ((SELECT count(*) FROM user_map) * (SELECT count(*) FROM movie_map))::DOUBLE * 100, 6) AS density_pct FROM train""")
def _(t: Tables):
    stats = prepare.matrix_stats(
        t.train, t.user_map.agg(F.count("*")).scalar(), t.movie_map.agg(F.count("*")).scalar())
    return stats.select(
        "nnz", "n_users", "n_items", (F.round("mean_value", 6) + F.lit(0.0)).alias("mean_value"),
        *[F.round(c, 6).alias(c) for c in ("min_value", "max_value", "density_pct")])


@query("user_positives", TRAIN, "SELECT DISTINCT user_idx, movie_idx FROM train")
def _(t: Tables):
    return prepare.user_positives(t.train).select("user_idx", F.explode("items").alias("movie_idx"))


@query("item_popularity", TRAIN, """SELECT movie_idx, count(*) AS cnt, round(count(*) / (SELECT count(*) FROM train)::DOUBLE, 9) AS prob
    FROM train GROUP BY 1""")
def _(t: Tables):
    return prepare.item_popularity(t.train).withColumn("prob", F.round("prob", 9))


@query("cold_users", TRAIN, "SELECT user_idx, user_id, count(*) AS n_train FROM train GROUP BY ALL HAVING count(*) < 20")
def _(t: Tables):
    return prepare.cold_users(t.train)


@query("user_segment", TRAIN, """SELECT user_idx, CASE WHEN n < 20 THEN 'cold' ELSE 'warm' END AS segment
    FROM user_map LEFT JOIN (SELECT user_idx, count(*) AS n FROM train GROUP BY 1) USING (user_idx)""")
def _(t: Tables):
    return prepare.user_segment(t.user_map.select("user_idx"), t.train)


@query("run_preprocessing", TRAIN, """SELECT (SELECT count(*) FROM user_map) AS n_users, (SELECT count(*) FROM movie_map) AS n_movies,
    (SELECT count(*) FROM train) AS n_train, (SELECT count(*) FROM val) AS n_val, (SELECT count(*) FROM test) AS n_test,
    (SELECT count(*) FROM (SELECT user_idx FROM train GROUP BY 1 HAVING count(*) < 20)) AS n_cold,
    round((SELECT count(*) FROM train)::DOUBLE / ((SELECT count(*) FROM user_map) * (SELECT count(*) FROM movie_map)) * 100, 6) AS density""")
def _(t: Tables):
    stats = preprocess(t.raw_ratings(), RATING_ORDER).stats
    return stats.withColumn("density", F.round("density", 6))


@query("user_sequences", TRAIN, """SELECT user_idx, row_number() OVER (PARTITION BY user_idx ORDER BY "timestamp", movie_idx) - 1 AS pos, movie_idx
    FROM train QUALIFY count(*) OVER (PARTITION BY user_idx) >= 3""")
def _(t: Tables):
    return prepare.user_sequences(t.train)


# -- description -----------------------------------------------------------------


@query("dataset_stats", RATINGS, """SELECT count(*) AS n_ratings, count(DISTINCT user_id) AS n_users, count(DISTINCT movie_id) AS n_movies,
    min(rating) AS min_rating, max(rating) AS max_rating, round(avg(rating), 6) AS mean_rating,
    round(count(*)::DOUBLE / (count(DISTINCT user_id) * count(DISTINCT movie_id)) * 100, 6) AS density_pct,
    round(100 - count(*)::DOUBLE / (count(DISTINCT user_id) * count(DISTINCT movie_id)) * 100, 6) AS sparsity_pct FROM ratings""")
def _(t: Tables):
    return describe.dataset_stats(t.ratings).withColumns(
        {c: F.round(c, 6) for c in ("mean_rating", "density_pct", "sparsity_pct")})


@query("value_distribution", RATINGS, "SELECT rating, count(*) AS n FROM ratings GROUP BY 1 ORDER BY 1")
def _(t: Tables):
    return describe.value_distribution(t.ratings, "rating")


for _key in ("user_id", "movie_id"):
    @query(f"support_summary_{_key}", RATINGS, f"""SELECT round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median,
        round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS max FROM (SELECT count(*) AS n FROM ratings GROUP BY {_key})""")
    def _(t: Tables, key=_key):
        return describe.support_summary(t.ratings, key).withColumns(
            {"mean": F.round("mean", 6), "p95": F.round("p95", 6)})

    @query(f"below_threshold_{_key}", RATINGS, f"""SELECT count(*) FILTER (n < 30) AS n_below, round(avg((n < 30)::INT * 100.0), 6) AS pct_below
        FROM (SELECT count(*) AS n FROM ratings GROUP BY {_key})""")
    def _(t: Tables, key=_key):
        return describe.below_threshold(t.ratings, key, 30).withColumn("pct_below", F.round("pct_below", 6))

    @query(f"top_share_{_key}", RATINGS, f"""SELECT f::DOUBLE AS fraction, max(k)::BIGINT AS n_top, round(sum(n) FILTER (r <= k) / sum(n) * 100, 6) AS pct_rows
        FROM (SELECT n, r, f, greatest(1, floor(n_keys * f::DOUBLE)) AS k
              FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS r, count(*) OVER () AS n_keys
                    FROM (SELECT count(*) AS n FROM ratings GROUP BY {_key})), (VALUES (0.01), (0.1)) v(f)) GROUP BY f""")
    def _(t: Tables, key=_key):
        return describe.top_share(t.ratings, key).withColumns(
            {"pct_rows": F.round("pct_rows", 6), "n_top": F.col("n_top").cast("bigint")})

    @query(f"lorenz_curve_{_key}", RATINGS, f"""SELECT {_key}, row_number() OVER w AS rank, n,
        round((row_number() OVER w - 1) * 100.0::DOUBLE / (count(*) OVER () - 1), 6) AS pct_keys,
        round(sum(n) OVER w / sum(n) OVER () * 100, 6) AS pct_rows
        FROM (SELECT {_key}, count(*) AS n FROM ratings GROUP BY 1) WINDOW w AS (ORDER BY n, {_key} ROWS UNBOUNDED PRECEDING)""")
    def _(t: Tables, key=_key):
        return describe.lorenz_curve(t.ratings, key).withColumns(
            {c: F.round(c, 6) for c in ("pct_keys", "pct_rows")})

    @query(f"rank_frequency_{_key}", RATINGS, f"""SELECT {_key}, row_number() OVER (ORDER BY n DESC, {_key}) AS rank, n,
        round(min(n) OVER () * count(*) OVER () / (row_number() OVER (ORDER BY n DESC, {_key}))::DOUBLE, 6) AS reference
        FROM (SELECT {_key}, count(*) AS n FROM ratings GROUP BY 1)""")
    def _(t: Tables, key=_key):
        return describe.rank_frequency(t.ratings, key).withColumn("reference", F.round("reference", 6))


def _histogram_sql(values: str, bins: int, lo: str, hi: str, keep: str = "v BETWEEN lo AND hi") -> str:
    return f"""SELECT bin, count(v) AS n FROM (SELECT unnest(range({bins})) AS bin) LEFT JOIN (
        SELECT v, least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1})::BIGINT AS slot FROM (
            SELECT v, {lo} AS lo, {hi} AS hi FROM ({values})) WHERE {keep}) ON slot = bin GROUP BY bin"""


@query("histogram_support", RATINGS, _histogram_sql(
    "SELECT count(*)::DOUBLE AS v FROM ratings GROUP BY user_id", 100, "min(v) OVER ()", "max(v) OVER ()"))
def _(t: Tables):
    return describe.histogram(describe.support(t.ratings, "user_id"), F.col("n"), 100)


@query("histogram_year", IMDB, _histogram_sql("SELECT year AS v FROM imdb", 60, "1920.0::DOUBLE", "2024.0::DOUBLE"))
def _(t: Tables):
    return describe.histogram(t.imdb(), F.col("year"), 60, 1920, 2024)


@query("histogram_runtime", IMDB, _histogram_sql("SELECT runtime AS v FROM imdb", 60, "30.0::DOUBLE", "240.0::DOUBLE"))
def _(t: Tables):
    return describe.histogram(t.imdb(), F.col("runtime"), 60, 30, 240)


@query("histogram_votes", IMDB, _histogram_sql(
    'SELECT log10(greatest("numVotes", 1)) AS v FROM imdb WHERE "numVotes" IS NOT NULL', 40, "min(v) OVER ()", "max(v) OVER ()"))
def _(t: Tables):
    return describe.histogram(t.imdb(), F.log10(F.when(F.col("numVotes").isNotNull(), F.greatest("numVotes", F.lit(1)))), 40)


WS = r"[\t\n\x{0B}\f\r\x{1C}\x{1D}\x{1E}\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
CTES["stats"] = f"""stats AS (SELECT tmdb_id, len(regexp_extract_all(overview, '{NOT_WS}+')) AS word_count,
    length(regexp_replace(overview, '^{WS}+|{WS}+$', '', 'g')) > 20 AS has_overview FROM tmdb)"""
TEXT = ["tmdb", "stats"]


@query("histogram_words", TEXT, _histogram_sql(
    "SELECT least(greatest(word_count, 0), 300)::DOUBLE AS v FROM stats WHERE has_overview", 50, "0.0::DOUBLE", "300.0::DOUBLE"))
def _(t: Tables):
    texts = describe.text_stats(t.tmdb()).where("has_overview")
    return describe.histogram(texts, F.col("word_count"), 50, 0, 300, clip=True)


@query("genre_counts", ["movies"], """SELECT genre, count(*) AS n FROM (SELECT unnest(string_split(genres, '|')) AS genre FROM movies)
    WHERE genre <> '(no genres listed)' GROUP BY 1 ORDER BY n DESC, genre LIMIT 20""")
def _(t: Tables):
    return describe.genre_counts(t.movies())


@query("genre_counts_imdb", IMDB, """SELECT genre, count(*) AS n FROM (SELECT unnest(string_split(genres, ',')) AS genre FROM imdb)
    GROUP BY 1 ORDER BY n DESC, genre LIMIT 20""")
def _(t: Tables):
    return describe.genre_counts(t.imdb(), sep=",")


@query("top_genres", ["movies"], """SELECT genre, count(*) AS n FROM (SELECT unnest(string_split(genres, '|')) AS genre FROM movies)
    GROUP BY 1 ORDER BY n DESC, genre LIMIT 5""")
def _(t: Tables):
    return describe.genre_counts(t.movies(), top=5)


@query("genres_per_movie", ["movies"], """SELECT n_genres, count(*) AS n, round(any_value(m), 6) AS pct_multi FROM (
    SELECT len(string_split(genres, '|')) AS n_genres, avg((len(string_split(genres, '|')) > 1)::INT) OVER () * 100 AS m FROM movies) GROUP BY 1""")
def _(t: Tables):
    return describe.genres_per_movie(t.movies()).withColumn("pct_multi", F.round("pct_multi", 6))


CTES["dated"] = 'dated AS (SELECT *, to_timestamp("timestamp")::TIMESTAMP AS d FROM ratings)'


@query("ratings_per_year", [*RATINGS, "dated"], """SELECT year(d)::INTEGER AS year, count(*) AS n, min(d)::DATE AS first_date, max(d)::DATE AS last_date
    FROM dated GROUP BY 1""")
def _(t: Tables):
    return describe.ratings_per_year(t.ratings)


@query("rating_period", [*RATINGS, "dated"], """SELECT min(f) AS first_date, max(l) AS last_date, arg_max(y, n * 10000 - y)::INTEGER AS peak_year, max(n) AS peak_n
    FROM (SELECT year(d) AS y, count(*) AS n, min(d)::DATE AS f, max(d)::DATE AS l FROM dated GROUP BY 1)""")
def _(t: Tables):
    return describe.rating_period(t.ratings)


@query("monthly_cumulative", [*RATINGS, "dated"], """SELECT month, n, sum(n) OVER (ORDER BY month)::BIGINT AS cumulative FROM (
    SELECT date_trunc('month', d)::DATE AS month, count(*) AS n FROM dated GROUP BY 1)""")
def _(t: Tables):
    return describe.monthly_cumulative(t.ratings)


@query("user_activity_segments", RATINGS, """SELECT CASE WHEN n <= 20 THEN '<= 20' WHEN n <= 50 THEN '20-50' WHEN n <= 200 THEN '50-200'
    WHEN n <= 500 THEN '200-500' ELSE '500+' END AS bucket, count(*) AS n_users, sum(n)::BIGINT AS n_ratings,
    round(sum(n) / (SELECT count(*) FROM ratings)::DOUBLE * 100, 6) AS pct_ratings
    FROM (SELECT count(*) AS n FROM ratings GROUP BY user_id) GROUP BY 1""")
def _(t: Tables):
    return describe.user_activity_segments(t.ratings).withColumn("pct_ratings", F.round("pct_ratings", 6))


@query("non_null_coverage", IMDB, """SELECT c AS "column", n AS n_present, round(n / total::DOUBLE * 100, 6) AS pct_present FROM (
    SELECT count(*) AS total, count("averageRating") AS a, count(runtime) AS r, count(genres) AS g FROM imdb) s,
    LATERAL (VALUES ('averageRating', a), ('runtime', r), ('genres', g)) v(c, n)""")
def _(t: Tables):
    return describe.non_null_coverage(t.imdb(), ["averageRating", "runtime", "genres"]).withColumn(
        "pct_present", F.round("pct_present", 6))


CTES["keyed"] = """keyed AS (SELECT *, 'tt' || lpad(imdb_id::VARCHAR, greatest(7, length(imdb_id::VARCHAR))::INTEGER, '0') AS tconst FROM links)"""


@query("key_membership", [*LINKS, "keyed", *IMDB], """SELECT movie_id, tconst, coalesce(tconst IN (SELECT tconst FROM imdb), false) AS matched FROM keyed""")
def _(t: Tables):
    links = t.links().select("movie_id", S.imdb_key(F.col("imdb_id")).alias("tconst"))
    return describe.key_membership(links, "tconst", t.imdb())


@query("link_coverage", [*LINKS, "keyed", *IMDB], """SELECT count(*) AS n_total, count(tconst) AS n_linked, count(*) FILTER (m) AS n_matched,
    count(*) - count(*) FILTER (m) AS n_unmatched, round(count(tconst) / count(*)::DOUBLE * 100, 6) AS pct_linked,
    round(count(*) FILTER (m) / count(*)::DOUBLE * 100, 6) AS pct_matched
    FROM (SELECT tconst, coalesce(tconst IN (SELECT tconst FROM imdb), false) AS m FROM keyed)""")
def _(t: Tables):
    links = t.links().select("movie_id", S.imdb_key(F.col("imdb_id")).alias("tconst"))
    return describe.link_coverage(links, "tconst", t.imdb()).withColumns(
        {c: F.round(c, 6) for c in ("pct_linked", "pct_matched")})


@query("text_stats", TEXT, "SELECT * FROM stats")
def _(t: Tables):
    return describe.text_stats(t.tmdb()).select("tmdb_id", "word_count", "has_overview")


@query("text_coverage", TEXT, """SELECT count(*) AS n_rows, count(*) FILTER (has_overview) AS n_with_text,
    round(avg(word_count) FILTER (has_overview), 6) AS mean_words, round(avg((NOT has_overview)::INT) * 100, 6) AS pct_zero_vector FROM stats""")
def _(t: Tables):
    return describe.text_coverage(t.tmdb()).withColumns(
        {c: F.round(c, 6) for c in ("mean_words", "pct_zero_vector")})


@query("coverage_funnel", [*RATINGS, *LINKS, "keyed", *IMDB, *TEXT], """SELECT step, n, round(n / base::DOUBLE * 100, 6) AS pct FROM (
    SELECT (SELECT count(DISTINCT movie_id) FROM ratings) AS base, count(*) FILTER (tconst IN (SELECT tconst FROM imdb)) AS i,
        count(tmdb_id) AS l, count(*) FILTER (tmdb_id IN (SELECT tmdb_id FROM stats WHERE has_overview)) AS s
    FROM keyed WHERE movie_id IN (SELECT movie_id FROM ratings)) x,
    LATERAL (VALUES ('rated', base), ('imdb_match', i), ('tmdb_link', l), ('synopsis', s)) v(step, n)""")
def _(t: Tables):
    return describe.coverage_funnel(t.ratings, t.links(), t.imdb(), t.tmdb()).withColumn("pct", F.round("pct", 6))
