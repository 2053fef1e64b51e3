"""Scalar column functions for identifiers, text, dates and item numerics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the whitespace code points that word counting and trimming recognise.
WHITESPACE = (
    "\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x85\xA0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202F\u205F\u3000"
)


def imdb_key(imdb_id: Column) -> Column:
    """``tt`` plus the id padded to at least seven digits; longer ids keep every digit."""
    number = imdb_id.cast("bigint")
    return F.when(number.isNotNull(), F.format_string("tt%07d", number))


def genre_list(genres: Column, sep: str, vocab) -> Column:
    """Split, keep known genres only, keep their order."""
    words = F.split(F.coalesce(genres, F.lit("")), _literal(sep))
    return F.filter(words, lambda g: g.isin(list(vocab)))


def genre_multi_hot(genres: Column, vocab) -> Column:
    """One 0/1 slot per vocabulary word, given an array column of genres."""
    return F.array(*[F.array_contains(genres, g).cast("double") for g in vocab])


def primary_genre(genres: Column, vocab) -> Column:
    """Vocabulary index of the first genre; ``len(vocab)`` where there is none."""
    index = {g: i for i, g in enumerate(vocab)}
    first = F.get(genres, F.lit(0))
    known = F.create_map(*[F.lit(x) for pair in index.items() for x in pair])
    return F.coalesce(F.try_element_at(known, first), F.lit(len(index)))


def epoch_parts(ts: Column) -> dict[str, Column]:
    """UTC date, year and first day of the month of unix seconds, in any session time zone."""
    date = F.date_from_unix_date(F.floor(ts / 86_400).cast("int"))
    return {"date": date, "year": F.year(date), "month": F.trunc(date, "month")}


def parse_year(date_text: Column) -> Column:
    """Year of a date string, null when it is not a date."""
    return F.year(F.try_to_timestamp(date_text))


def stripped(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))


def word_count(text: Column) -> Column:
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITESPACE, " " * len(WHITESPACE))
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("bigint")


def has_overview(text: Column) -> Column:
    """Synopsis long enough to describe the item (the coverage statistics use this)."""
    return F.length(stripped(text)) > 20


def has_text(text: Column) -> Column:
    """Synopsis not blank (the vector step uses this)."""
    return F.length(stripped(text)) > 0


def runtime_norm(runtime: Column) -> Column:
    """Minutes clipped to 60..240 and scaled to 0..1; unknown counts as 100 minutes."""
    clipped = F.least(F.greatest(runtime, F.lit(60.0)), F.lit(240.0))
    return (F.when(runtime.isNull(), F.lit(100.0)).otherwise(clipped) - 60.0) / 180.0


def avg_vote_norm(vote: Column, fallback: Column) -> Column:
    return (F.coalesce(vote, fallback) - 1.0) / 9.0


def log_votes(votes: Column) -> Column:
    return F.log1p(F.coalesce(votes, F.lit(0)).cast("double"))


def hash_draw(*parts: Column | str | int) -> Column:
    """Deterministic 60-bit draw from its arguments.

    A keyed hash instead of ``rand()``: retried tasks and other partitionings redraw the
    same numbers.
    """
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, 15), 16, 10).cast("bigint")


def activity_bucket(n: Column, edges) -> Column:
    """Label of the right-closed interval of ``edges`` that holds ``n``."""
    bounds = [0, *edges]
    out = F.when(n <= edges[0], F.lit(f"<= {edges[0]}"))
    for low, high in zip(bounds[1:], bounds[2:]):
        out = out.when(n <= high, F.lit(f"{low}-{high}"))
    return out.otherwise(F.lit(f"{edges[-1]}+"))


def _literal(sep: str) -> str:
    return "\\" + sep if sep in "|.+*?^$()[]{}\\" else sep
