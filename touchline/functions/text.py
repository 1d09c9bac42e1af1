"""Column builders that make names, dates and ids comparable."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that are dropped at the ends of a team name.
PREFIXES, SUFFIXES = ("as", "ac", "fc", "sc", "sv", "real", "us"), ("fc", "cf", "afc", "sc", "united", "co")
DATE_FORMATS = ("dd/MM/yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yy")
_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def fold_accents(x: Column) -> Column:
    return F.translate(x, *_ACCENTS)


def _latin() -> tuple[str, str]:
    """Latin letters that are an ASCII letter and marks, and those ASCII letters: what decomposing and dropping marks gives."""
    pairs = {}
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalpha():
            pairs[chr(point)] = base
    return "".join(pairs), "".join(pairs.values())


_LATIN = _latin()
#: Tokens dropped in front of and behind a club's name as often as they stand there, and words dropped anywhere.
CLUB_PREFIXES = ("a", "as", "ac", "acf", "ss", "us", "ud", "fc", "cf", "rc", "cd", "sd", "sv")
CLUB_SUFFIXES = ("afc", "calcio", "cf", "club", "cp", "fc", "football", "futbol", "sc", "ud")
CLUB_WORDS = ("de", "of", "the")


def without_marks(x: Column) -> Column:
    """Every Latin letter with marks as its bare letter, and without marks that stand alone."""
    return F.regexp_replace(F.translate(x, *_LATIN), "[\u0300-\u036f]", "")


def club_key(name: Column) -> tuple[Column, Column]:
    """A club's key, and the key without its prefixes, suffixes and small words (empty if nothing else is in it).  Unknown names are empty."""
    plain = F.replace(F.lower(without_marks(F.coalesce(name, F.lit("")))), F.lit("&"), F.lit(" and "))
    key = F.trim(F.regexp_replace(F.regexp_replace(plain, "['`\u00b4\u2019]", ""), "[^a-z0-9]+", " "))
    edge = F.regexp_replace(F.concat(key, F.lit(" ")), f"^(?:(?:{'|'.join(CLUB_PREFIXES)}) )+", "")
    edge = F.regexp_replace(F.concat(F.lit(" "), F.trim(edge)), f"(?: (?:{'|'.join(CLUB_SUFFIXES)}))+$", "")
    words = F.filter(F.split(F.trim(edge), " "), lambda w: ~w.isin(*CLUB_WORDS))
    return key, F.array_join(words, " ")


def team_key(name: Column) -> Column:
    """Lower case, & spelt out, quotes dropped, everything else but letters and digits a single space."""
    plain = F.regexp_replace(F.replace(fold_accents(F.lower(name)), F.lit("&"), F.lit(" and ")), "['`.]", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def stripped_team_key(name: Column) -> Column:
    """team_key without club tokens at either end (kept if nothing else is left)."""
    key = team_key(name)
    bare = F.regexp_replace(F.regexp_replace(key, f"^((?:{'|'.join(PREFIXES)}) )+", ""), f"( (?:{'|'.join(SUFFIXES)}))+$", "")
    return F.when(bare == "", key).otherwise(bare)


def compact_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def parse_date(raw: Column) -> Column:
    """First format that fits; null if none does."""
    return F.coalesce(*[F.try_to_date(raw, f) for f in DATE_FORMATS])


def season_key(day: Column) -> Column:
    start = F.year(day) - F.when(F.month(day) < 7, 1).otherwise(0)
    return F.coalesce(F.concat(start.cast("string"), F.lit("-"), (start + 1).cast("string")), F.lit("unknown"))


def first_existing(columns: list[str], aliases: list[str]) -> Column:
    """coalesce over those aliases that the frame has; null if it has none."""
    found = [F.col(c) for c in aliases if c in columns]
    return F.coalesce(*found) if found else F.lit(None)


def parse_day_first(raw: Column) -> Column:
    """A year in front if four digits and a dash or slash begin the text, else the day in front; null if neither fits."""
    fit = lambda *formats: F.coalesce(*[F.try_to_date(raw, f) for f in formats])
    return F.when((F.length(raw) >= 10) & raw.rlike("^[0-9]{4}[-/]"), fit("yyyy-MM-dd", "yyyy/MM/dd")).otherwise(fit("dd/MM/yyyy", "dd-MM-yyyy"))


def season_years(code: Column) -> tuple[Column, Column]:
    """First and last year of a code such as 2425; 2000 and 2001 if it is none."""
    first, last = F.substring(code, 1, 2).try_cast("int"), F.substring(code, 3, 100).try_cast("int")
    known, base = first.isNotNull() & last.isNotNull(), F.when(first >= 10, 2000).otherwise(1900)
    return F.when(known, base + first).otherwise(2000), F.when(known, base + last).otherwise(2001)
