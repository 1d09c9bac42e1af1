"""Fixtures in the text of schedule pages: lines under a date, segments behind a date, or one line alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that say nothing, and beginnings of such lines.
NOISE = ["advertisement", "show more matches", "show more", "live standings", "standings", "form", "over/under", "ht/ft", "top scorers"]
NOISE_STARTS = ["round ", "scheduled", "latest scores", "football", "summary", "odds", "news", "results", "fixtures", "standings", "archive"]
HEADER = r"^(\d{2}\.\d{2}\.)\s+(\d{1,2}:\d{2})$"
DATE = r"(?<!\d)(\d{2}\.\d{2}\.)\s+"
#: Two teams with a word or a dash between them, up to a time, a score or the end.
PAIRS = [r"(?i)^(.+?)\s+(?:vs\.?|v\.?|versus)\s+(.+?)(?:\s+\d{1,2}:\d{2}|\s+\d+-\d+|\s+LIVE|$)", r"(?i)^(.+?)\s+-\s+(.+?)(?:\s+\d{1,2}:\d{2}|\s+\d+-\d+|$)"]
KICKOFF, SCORE = r"\b\d{1,2}:\d{2}\b", r"\b(\d+)\s*[-:]\s*(\d+)\b"
_FIXTURE = "struct<home: string, away: string, kickoff: string, hg: int, ag: int>"


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _name(x: Column) -> Column:
    return F.regexp_replace(x, r"^[ \-|]+|[ \-|]+$", "")


def is_noise(line: Column) -> Column:
    """Lines without a team: nothing, a known word, a known beginning, or a number of one or two digits."""
    low = F.lower(line)
    return (line == "") | low.isin(NOISE) | low.rlike("^(" + "|".join(NOISE_STARTS) + ")") | line.rlike(r"^\d{1,2}$")


def _on_day(date: Column, day: Column) -> Column:
    """Whether a date without a year is the wanted day; one that is no date counts as it."""
    return F.coalesce(F.try_to_date(F.concat(date, F.year(day).cast("string")), "dd.MM.yyyy"), day) == day


def _fixture(home: Column, away: Column, kickoff: Column, hg: Column, ag: Column) -> Column:
    return F.struct(home.alias("home"), away.alias("away"), kickoff.alias("kickoff"), hg.cast("int").alias("hg"), ag.cast("int").alias("ag"))


def _inferred(text: Column) -> Column:
    """The fixture that a piece of text names; null if it names none.  A kick-off before the goals is read as the score, as it stands first."""
    kickoff = F.nullif(F.regexp_extract(text, KICKOFF, 0), F.lit(""))
    goals = [F.regexp_extract(text, SCORE, k).try_cast("int") for k in (1, 2)]
    found = F.lit(None).cast(_FIXTURE)
    for pattern in reversed(PAIRS):
        home, away = (_name(F.regexp_extract(text, pattern, k)) for k in (1, 2))
        found = F.when(text.rlike(pattern), _fixture(home, away, kickoff, *goals)).otherwise(found)
    return found


def under_dates(text: Column, day: Column) -> Column:
    """Fixtures of lines ``dd.MM. HH:mm``, followed by a home and an away team.

    The home team must stand right below; lines without meaning may follow it.  Lines that say something are filtered once and
    each is laid beside the next two, so the time is linear in the page."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), _strip)
    placed = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~is_noise(s["x"]))
    n = F.size(placed)
    later = lambda k: F.slice(placed, k + 1, F.greatest(n - k, F.lit(0)))
    three = F.arrays_zip(placed.alias("a"), later(1).alias("b"), later(2).alias("c"))
    heads = F.filter(three, lambda s: s["a"]["x"].rlike(HEADER) & _on_day(F.regexp_extract(s["a"]["x"], HEADER, 1), day) & (s["b"]["i"] == s["a"]["i"] + 1) & (s["c"]["x"] != s["b"]["x"]))
    return F.transform(heads, lambda s: _fixture(_name(s["b"]["x"]), _name(s["c"]["x"]), F.regexp_extract(s["a"]["x"], HEADER, 2), F.lit(None), F.lit(None)))


def behind_dates(text: Column, day: Column) -> Column:
    """Fixtures of comma-separated pieces behind a date, up to the next one; of the whole text if it has no date."""
    clean = _strip(F.regexp_replace(text, r"\s+", " "))
    # a blank at the end lets a date without anything behind it end there
    dates = F.regexp_extract_all(clean, F.lit(DATE), F.lit(1))
    parts = F.split(clean, DATE)
    behind = F.arrays_zip(dates.alias("date"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("said"))
    own = F.filter(behind, lambda s: _on_day(s["date"], day) & (s["said"] != ""))
    trimmed = lambda x: F.regexp_replace(F.replace(x, F.lit("Show more"), F.lit("")), r"^[ ,;]+|[ ,;]+$", "")
    pieces = F.filter(F.transform(F.flatten(F.transform(own, lambda s: F.split(trimmed(s["said"]), ","))), _strip), lambda x: x != "")
    several = F.filter(F.transform(pieces, lambda x: _inferred(_strip(F.regexp_replace(x, r"\s+", " ")))), lambda f: f.isNotNull())
    alone = F.array_compact(F.array(_inferred(clean)))
    return F.when(F.size(dates) > 0, several).when(clean != "", alone).otherwise(F.array().cast(f"array<{_FIXTURE}>"))


def parse_schedules(pages: DataFrame, keys: list[str], text: str, day: str) -> DataFrame:
    """keys, home, away, kickoff, hg, ag of each page's fixtures on its ``day`` (a date column); pages without a text or day give none.

    Lines under dates count first; only a page without any such fixture is read by segments."""
    wanted = F.col(day)
    found = pages.filter(F.col(text).isNotNull() & wanted.isNotNull()).withColumn("_lines", under_dates(F.col(text), wanted))
    every = F.when(F.size("_lines") > 0, F.col("_lines")).otherwise(behind_dates(F.col(text), wanted))
    return found.select(*keys, F.explode(every).alias("f")).select(*keys, "f.*")
