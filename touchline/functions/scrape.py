"""Column builders for scraped text: names, scores, JSON in prose, URL templates, timestamps, sentiment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases behind which a scraped team name ends.
NAME_ENDS = ("Advancing to next round:", "Winner:", "After Penalties:", "After Extra Time:")
#: Marks of a form sequence, and momentum levels from the highest down.
FORM_MARKS = {"W": "📈", "D": "➖", "L": "📉"}
MOMENTUM_MARKS = ((1.10, "🔥"), (1.00, "📈"), (0.90, "➖"))
LOWEST_MOMENTUM = "📉"
_PLACES = ("date", "date_compact", "date_ddmmyyyy", "date_slash", "league", "league_slug")


def scraped_team_name(raw: Column) -> Column:
    """One space between words, cut before the first status phrase, without dashes and bars at the ends; null is empty."""
    text = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\s+", " "))
    for end in NAME_ENDS:
        text = F.trim(F.substring_index(text, end, 1))
    return F.btrim(text, F.lit(" -|"))


def json_list_text(raw: Column) -> Column:
    """The outermost [...] of a text, inside its first code fence if it has one; null without brackets."""
    fence = lambda mark: F.regexp_extract(raw, rf"(?s)```{mark}\s*(.*?)\s*```", 1)
    body = F.when(raw.contains("```json"), fence("json")).when(raw.contains("```"), fence("")).otherwise(raw)
    return F.nullif(F.regexp_extract(body, r"(?s)\[.*\]", 0), F.lit(""))


def sparkline(results: Column) -> Column:
    """W, D and L as marks; any other result, null included, is level. An empty or null sequence is 'No Data'."""
    mark = lambda x: F.when(x == "W", FORM_MARKS["W"]).when(x == "L", FORM_MARKS["L"]).otherwise(FORM_MARKS["D"])
    return F.when(F.size(F.coalesce(results, F.array().cast("array<string>"))) == 0, "No Data").otherwise(F.array_join(F.transform(results, mark), ""))


def momentum_mark(score: Column) -> Column:
    """Mark of the highest level that a score reaches; an unknown score is level."""
    found = F.when(score.isNull(), FORM_MARKS["D"])
    for level, mark in MOMENTUM_MARKS:
        found = found.when(score >= level, mark)
    return found.otherwise(LOWEST_MOMENTUM)


def split_score(score: Column) -> tuple[Column, Column]:
    """Goals of '2-1'; 0 and 0 if either part is no whole number."""
    parts = F.split(score, "-", 2)
    number = lambda i: F.when(F.trim(F.get(parts, F.lit(i))).rlike(r"^[+-]?\d+$"), F.trim(F.get(parts, F.lit(i))).try_cast("int"))
    fits = number(0).isNotNull() & number(1).isNotNull()
    return F.when(fits, number(0)).otherwise(0), F.when(fits, number(1)).otherwise(0)


def full_time_result(result: Column) -> Column:
    """W, D, L of the home side as H, D, A; anything else stays."""
    return F.when(result == "W", "H").when(result == "L", "A").otherwise(result)


def render_template(template: Column, day: Column, league: Column) -> Column:
    """Fill date and league into a URL template; one with an unknown placeholder stays as it is.

    A day that is no ISO date is used as text."""
    parsed = F.try_to_date(F.substring(day, 1, 10), "yyyy-MM-dd")
    bare = F.replace(day, F.lit("-"), F.lit(""))
    slug = F.btrim(F.regexp_replace(F.lower(F.trim(league)), "[^a-z0-9]+", "-"), F.lit("-"))
    dated = lambda fmt, other: F.coalesce(F.date_format(parsed, fmt), other)
    values = (day, dated("yyyyMMdd", bare), dated("ddMMyyyy", F.when(F.length(bare) > 8, F.substring(bare, -8, 8)).otherwise(bare)), dated("dd/MM/yyyy", day), league, slug)
    text = template
    for place, value in zip(_PLACES, values, strict=True):
        text = F.replace(text, F.lit("{" + place + "}"), F.coalesce(value, F.lit("")))
    unknown = F.regexp_replace(template, r"\{(" + "|".join(_PLACES) + r")\}", "").rlike("[{}]")
    return F.when(unknown, template).otherwise(text)


def utc_timestamp(raw: Column, local_zone: str) -> Column:
    """Timestamp without zone, in UTC: a T between date and time means UTC already, a blank means ``local_zone``, an
    offset at the end is taken off; null if the text is none of these."""
    text = F.trim(raw)
    plain = text.try_cast("timestamp_ntz")
    offset = r"(?:Z|[+-]\d{2}:?\d{2})$"
    instant = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp").cast("timestamp_ntz")
    local = F.convert_timezone(F.lit(local_zone), F.lit("UTC"), plain)
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?$"), plain)
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), local)
        .when(text.rlike(r"\d{2}:\d{2}.*" + offset), F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), plain)
    )


def normalised(value: Column, scale: float, default: float = 0.0) -> Column:
    """value / scale held to 0..1; null, NaN and infinities give the default."""
    x = value.try_cast("double")
    bad = x.isNull() | F.isnan(x) | F.abs(x).eqNullSafe(F.lit(float("inf")))
    return F.when(bad, default).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / scale)))


def mean_sentiment(news: Column, fallback: Column) -> Column:
    """Mean of the known sentiment scores of an array of structs; without any, the fallback or 0."""
    known = F.filter(F.transform(news, lambda n: n["sentiment_score"].cast("double")), lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return F.when(F.size(known) > 0, mean).otherwise(F.coalesce(fallback.cast("double"), F.lit(0.0)))


def present_share(columns: list[str]) -> Column:
    """Share of the columns that are not null."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) / F.lit(float(len(columns)))


def event_quality(core: list[str], advanced: list[str], events: Column) -> Column:
    """Data quality of a match with event data, 1 at most."""
    score = 0.18 + 0.58 * present_share(core) + 0.16 * present_share(advanced) + F.when(events > 0, 0.08).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def core_quality(core: list[str]) -> Column:
    """Data quality of backfilled statistics: the share that is known, 0.2 at least."""
    return F.greatest(F.lit(0.2), present_share(core))


def probability_quality(log_loss: Column, loss: Column, brier: Column, draw_recall: Column) -> Column:
    """Quality of a model's probabilities, lower is better; null without any loss. A missing Brier score counts 0.70."""
    recall = F.coalesce(draw_recall, F.lit(0.0))
    return F.coalesce(log_loss, loss) + 0.35 * F.coalesce(brier, F.lit(0.70)) + 0.03 * F.greatest(F.lit(0.0), 0.10 - recall)


def promoted(champion: Column, best: Column, champion_accuracy: Column, best_accuracy: Column, least: float = 0.002) -> Column:
    """A candidate is promoted if there is no champion, if its quality is better by more than ``least``, or if the
    champion never was right and it was."""
    lift = F.coalesce(champion - best > least, F.lit(False))
    return champion.isNull() | lift | F.coalesce((champion_accuracy == 0) & (best_accuracy > 0), F.lit(False))


def graph_model_enabled(rows: Column, coverage: Column, weight: Column, accuracy_lift: Column, loss_lift: Column) -> Column:
    """Gate of the graph model: enough rows, market coverage, a weight in the blend, and a lift in either measure."""
    return F.coalesce((rows >= 30) & (coverage >= 0.8) & (weight > 0) & ((accuracy_lift >= 0.02) | (loss_lift >= 0.002)), F.lit(False))
