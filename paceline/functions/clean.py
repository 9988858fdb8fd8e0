"""Names, genders, placeholders, ids and other text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import fixed, strip

# Gender words, age bands and placeholder texts.
MEN_WORDS = ("M", "MALE", "MAN")
WOMEN_WORDS = ("W", "F", "FEMALE", "WOMAN")
AGE_BANDS = ((9, "Age 7 - 9"), (12, "Age 10 - 12"), (15, "Age 13 - 15"), (19, "Age 16 - 18"))
AGE_REST = "Age 19 and up"
UNKNOWN_AGE = 100
UNKNOWN_RUNNER = "Unknown Runner"
NO_BIB = "No Bib"


def filled(text: Column) -> Column:
    """The text, or NULL when it is empty."""
    return F.nullif(text, F.lit(""))


def norm_gender(text: Column) -> Column:
    """Upper-case; known words become M or W; empty is unset; nothing is trimmed."""
    up = F.upper(text)
    return (
        F.when(up.isin(*MEN_WORDS), F.lit("M"))
        .when(up.isin(*WOMEN_WORDS), F.lit("W"))
        .otherwise(filled(up))
    )


def recode_gender(text: Column) -> Column:
    return (
        F.when(text == "M", F.lit("Male")).when(text == "F", F.lit("Female")).otherwise(text)
    )


def age_band(age: Column) -> Column:
    """Band label; a missing age falls through to the last band."""
    band = F
    for limit, label in AGE_BANDS:
        band = band.when(age <= limit, F.lit(label))
    return band.otherwise(F.lit(AGE_REST))


def default_age(age: Column, unknown: int = UNKNOWN_AGE) -> Column:
    return F.coalesce(age, F.lit(unknown)).cast("int")


def split_name(name: Column) -> Column:
    """``struct<first, last>``: first token, and the rest joined by one blank."""
    tokens = F.split(strip(F.coalesce(name, F.lit(""))), r"\s+", -1)
    rest = F.array_join(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), " ")
    return F.struct(F.get(tokens, F.lit(0)).alias("first"), rest.alias("last"))


def bib_sort_key(bib: Column) -> Column:
    """Integer bibs in numeric order, all others after them."""
    return F.coalesce(bib.try_cast("decimal(38,0)").cast("double"), F.lit(float("inf")))


def unknown_bib(track: Column) -> Column:
    return F.concat(F.lit("Unknown-"), track.cast("string"))


def track_name(track: Column) -> Column:
    return F.concat(F.lit("Racer "), track.cast("string"))


def bib_name(bib: Column) -> Column:
    return F.concat(F.lit("Racer #"), bib)


def quick_bib(typed: Column, n_finishers: Column) -> Column:
    """The typed bib, or a numbered placeholder when it is blank."""
    numbered = F.concat(F.lit("No-Bib-"), (n_finishers + 1).cast("string"))
    return F.coalesce(filled(strip(typed)), numbered)


def runner_name(name: Column) -> Column:
    return F.coalesce(filled(name), F.lit(UNKNOWN_RUNNER))


def medal(position: Column) -> Column:
    """Podium colour of the first three positions (counted from 1)."""
    return (
        F.when(position == 1, F.lit("gold"))
        .when(position == 2, F.lit("silver"))
        .when(position == 3, F.lit("bronze"))
    )


def track_label(track: Column, bib: Column, locked_conf: Column) -> Column:
    """Label of a tracked runner; the confidence shows only for a locked bib."""
    plain = F.concat(
        F.lit("Racer ID "), track.cast("string"), F.lit(" | Bib: "), F.coalesce(bib, F.lit(""))
    )
    return F.when(locked_conf.isNull(), plain).otherwise(
        F.concat(plain, F.lit(" ("), fixed(locked_conf, 2), F.lit(")"))
    )


def finisher_id(*parts: Column) -> Column:
    """Replay-safe id: a digest of the identifying columns instead of a random one."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_ext(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"(?<=.)\.([^.]*)$", 1)
