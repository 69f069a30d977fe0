"""Song records: quoted-CSV parsing into a typed 34-field record, and the
record's derived features. Row-local throughout (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.functions.numeric import ieee_div, java_double, java_int
from clusterlens.functions.strings import quoted_csv_split
from clusterlens.functions.text import java_split

# The record layout, in field order (i = int, d = double,
# s = string).
TRACK_FIELDS = [
    ("sampleRate", "i"), ("artist7Id", "i"), ("artistFamiliarity", "d"), ("artistHotness", "d"),
    ("artistId", "s"), ("artistLong", "d"), ("artistLocation", "s"), ("artistLat", "d"),
    ("artistMbid", "s"), ("artistName", "s"), ("artistPlaymeId", "i"), ("audioMd5", "s"),
    ("danceability", "d"), ("duration", "d"), ("endOfFadeIn", "d"), ("energy", "d"),
    ("key", "i"), ("keyConfidence", "d"), ("loudness", "d"), ("mode", "i"),
    ("modeConfidence", "d"), ("unknown", "s"), ("release", "s"), ("release7Id", "i"),
    ("songHotness", "d"), ("songId", "s"), ("startOfFadeOut", "d"), ("tempo", "d"),
    ("timeSignature", "i"), ("timeSignatureConfidence", "d"), ("title", "s"), ("trackId", "i"),
    ("track7Id", "s"), ("year", "i"),
]
TRACK_ARITY = len(TRACK_FIELDS)

# Title words left out of song-word counts.
SONG_STOP_WORDS = ["a", "the", "you", "he", "she", "me", "i", "they", "yours", "there's"]

_PARSERS = {"i": java_int, "d": java_double, "s": lambda c: c}


def _typed(fields: Column, names: list[str] | None = None, safe: bool = False) -> list[Column]:
    """Typed fields; ``safe`` reads positions with ``get`` (NULL when the
    array is shorter) so the parse can run before the arity check."""
    item = (lambda i: F.get(fields, i)) if safe else (lambda i: fields.getItem(i))
    return [_PARSERS[kind](item(i)).alias(name)
            for i, (name, kind) in enumerate(TRACK_FIELDS) if names is None or name in names]


def parse_tracks(lines: DataFrame, col: str = "value", fields: list[str] | None = None) -> DataFrame:
    """One row per line with a nullable ``track`` struct: NULL when the line
    does not have exactly 34 fields, otherwise every field (or only
    ``fields``) typed, with 0 / 0.0 for numbers that do not parse."""
    return (lines.select(quoted_csv_split(F.col(col)).alias("_f"))
            .select(F.when(F.size("_f") == TRACK_ARITY, F.struct(*_typed(F.col("_f"), fields)))
                    .alias("track")))


def tracks(lines: DataFrame, col: str = "value", fields: list[str] | None = None) -> DataFrame:
    """The parsed records as flat columns; lines of the wrong arity dropped.

    The record leaves through a generator (``inline`` of a zero- or
    one-element array) rather than a filter: a filter on the field count
    would be pushed below the projection with the split inlined into it,
    splitting every line twice. The fields are typed in a projection first
    (where repeated casts are shared by subexpression elimination); the
    generator only picks the columns. ``fields`` limits the typed fields (the
    optimizer cannot prune struct fields through the generator)."""
    typed = _typed(F.col("_f"), fields, safe=True)
    names = [name for name, _ in TRACK_FIELDS if fields is None or name in fields]
    one = F.when(F.col("_ok"), F.array(F.struct(*[F.col(n) for n in names])))
    return (lines.select(quoted_csv_split(F.col(col)).alias("_f"))
            .select((F.size("_f") == TRACK_ARITY).alias("_ok"), *typed)
            .select(F.inline(one)))


def record_counts(parsed: DataFrame) -> DataFrame:
    """All lines (the workload reports this figure as 'tracks') and the parsed ones."""
    return parsed.agg(F.count(F.lit(1)).alias("lines"),
                      F.count(F.col("track")).alias("tracks"))


def value_pairs(track_df: DataFrame, value: str, name: str = "x") -> DataFrame:
    """``(track7Id, value)`` for records whose value is not 0 (NaN passes)."""
    return (track_df.where(F.col(value) != 0)
            .select("track7Id", F.col(value).alias(name)))


def hot_pairs(track_df: DataFrame) -> DataFrame:
    return value_pairs(track_df, "songHotness", "hotness")


def tempo_pairs(track_df: DataFrame) -> DataFrame:
    return value_pairs(track_df, "tempo", "tempo")


def fade_ratio(track_df: DataFrame) -> DataFrame:
    """((duration - startOfFadeOut) + (danceability - endOfFadeIn)) / duration,
    with IEEE division."""
    num = ((F.col("duration") - F.col("startOfFadeOut"))
           + (F.col("danceability") - F.col("endOfFadeIn")))
    return track_df.select("track7Id", ieee_div(num, F.col("duration")).alias("fade_ratio"))


def title_words(title: Column) -> Column:
    """Lower-cased title split on single spaces (JVM split), stop words out."""
    words = java_split(F.lower(title), " ", " ")
    stop = F.array(*[F.lit(w) for w in SONG_STOP_WORDS])
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def song_words(track_df: DataFrame) -> DataFrame:
    """``(track7Id, word, one)`` per kept title word."""
    return track_df.select("track7Id", F.explode(title_words(F.col("title"))).alias("word"),
                           F.lit(1).alias("one"))


def song_word_counts(track_df: DataFrame, by_artist: bool = False) -> DataFrame:
    """Word counts over all titles, or per artist (``artistId``)."""
    keys = ["artistId", "word"] if by_artist else ["word"]
    words = track_df.select("artistId", F.explode(title_words(F.col("title"))).alias("word"))
    return words.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def playme_flag(track_df: DataFrame) -> DataFrame:
    """1 when the playme id is present (not negative), else 0."""
    return track_df.select("track7Id", F.when(F.col("artistPlaymeId") < 0, 0).otherwise(1)
                           .alias("playme_present"))


def track_label(track_df: DataFrame) -> DataFrame:
    return track_df.select("track7Id", F.concat(F.lit("Artist:\t"), F.col("artistName"),
                                                F.lit("\nSongTitle:\t"), F.col("title")).alias("label"))
