"""Scraped text, data quality, promotion gates, alias sweeps, lookups and orderings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.bindings import ctes, frame
from touchline.functions import scrape as S
from touchline.functions import text as X
from touchline.operators import matches as M
from touchline.operators import merge as G
from touchline.queries.merge import _KEY
from touchline.queries.quality import CANON, canon, contests
from touchline.queries.text import load
from touchline.registry import query

_DECORATED = "concat('  ', name, CASE id % 5 WHEN 0 THEN ' Winner: home' WHEN 1 THEN '   Advancing to next round: x Winner: y' WHEN 2 THEN ' - After Penalties: 4-3' WHEN 3 THEN ' - |' ELSE '' END)"
_CUT = "trim(regexp_replace(raw, '\\s+', ' ', 'g'))"
for _end in S.NAME_ENDS:
    _CUT = f"trim(split_part({_CUT}, '{_end}', 1))"


@query("f13_scraped_names", ctes("names") + f", r AS (SELECT id, {_DECORATED} AS raw FROM names) SELECT id, trim({_CUT}, ' -|') AS team FROM r")
def f13(spark, sf_dir):
    rows = frame(spark, sf_dir, "names").select("id", F.expr(_DECORATED).alias("raw"))
    return rows.select("id", S.scraped_team_name(F.col("raw")).alias("team"))


_FENCED = "CASE event_id % 4 WHEN 0 THEN concat('Found:\n```json\n[', props, ']\n``` done') WHEN 1 THEN concat('```\n[', props, ', ', props, ']\n```') WHEN 2 THEN concat('here [', props, '] it is') ELSE props END"


@query("f14_fenced_json", f"""WITH r AS (SELECT event_id, {_FENCED} AS raw FROM events), b AS (SELECT event_id, CASE WHEN contains(raw, '```json') THEN regexp_extract(raw, '```json\\s*(.*?)\\s*```', 1, 's') WHEN contains(raw, '```') THEN regexp_extract(raw, '```\\s*(.*?)\\s*```', 1, 's') ELSE raw END AS body FROM r),
 j AS (SELECT event_id, nullif(regexp_extract(body, '\\[.*\\]', 0, 's'), '') AS js FROM b) SELECT event_id, CAST(json_array_length(js) AS INT) AS n, CAST(json_extract_string(js, '$[0].k') AS BIGINT) AS k FROM j""")
def f14(spark, sf_dir):
    found = F.from_json(S.json_list_text(F.expr(_FENCED)), "array<struct<k: bigint>>")
    return load(spark, sf_dir, "events").select("event_id", found.alias("j")).select("event_id", F.when(F.col("j").isNotNull(), F.size("j")).alias("n"), F.get("j", F.lit(0))["k"].alias("k"))


def _letter(column: str) -> str:
    return f"CASE {column} % 4 WHEN 0 THEN 'W' WHEN 1 THEN 'D' WHEN 2 THEN 'L' END"


@query("f15_form_marks", ctes("contests") + f""", r AS (SELECT ok, ln, pk, sk, [{_letter('ok')}, {_letter('pk')}, {_letter('sk')}] AS form, (80 + pk % 41) / 100e0 AS score FROM contests)
 SELECT ok, ln, pk, sk, array_to_string(list_transform(form, lambda x: CASE WHEN x = 'W' THEN '📈' WHEN x = 'L' THEN '📉' ELSE '➖' END), '') AS line, CASE WHEN score >= 1.10e0 THEN '🔥' WHEN score >= 1.00e0 THEN '📈' WHEN score >= 0.90e0 THEN '➖' ELSE '📉' END AS mark FROM r""")
def f15(spark, sf_dir):
    form = F.array(*[F.expr(_letter(c)) for c in ("ok", "pk", "sk")])
    return contests(spark, sf_dir).select(*M.TIE, S.sparkline(form).alias("line"), S.momentum_mark((80 + F.col("pk") % 41) / 100.0).alias("mark"))


_SCORE = "CASE ok % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat(' ', CAST(hg AS STRING), ' - ', CAST(ag AS STRING)) WHEN 3 THEN 'x-1' WHEN 4 THEN '4' WHEN 5 THEN '2-1-1' ELSE concat(CAST(hg AS STRING), '-', CAST(ag AS STRING)) END"


@query("f16_score_split", ctes("contests") + f""", r AS (SELECT ok, ln, pk, sk, {_SCORE} AS s, {_letter('pk')} AS res FROM contests), p AS (SELECT *, TRY_CAST(trim(split_part(s, '-', 1)) AS INT) AS a, CASE WHEN strpos(s, '-') > 0 AND regexp_full_match(trim(substr(s, strpos(s, '-') + 1)), '[0-9]+') THEN CAST(trim(substr(s, strpos(s, '-') + 1)) AS INT) END AS b FROM r)
 SELECT ok, ln, pk, sk, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE a END AS gf, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE b END AS ga, CASE res WHEN 'W' THEN 'H' WHEN 'L' THEN 'A' ELSE res END AS ftr FROM p""")
def f16(spark, sf_dir):
    gf, ga = S.split_score(F.expr(_SCORE))
    return contests(spark, sf_dir).select(*M.TIE, gf.alias("gf"), ga.alias("ga"), S.full_time_result(F.expr(_letter("pk"))).alias("ftr"))


_TEMPLATES = ("https://scores.test/{league_slug}/{date_ddmmyyyy}?c={date_compact}", "https://scores.test/{date}/{league}#{date_slash}", "https://scores.test/{round}/{date}")
_TEMPLATE = f"CASE id % 3 WHEN 0 THEN '{_TEMPLATES[0]}' WHEN 1 THEN '{_TEMPLATES[1]}' ELSE '{_TEMPLATES[2]}' END"


@query("f17_url_templates", ctes("raw_dates") + f""", r AS (SELECT id, raw, {_TEMPLATE} AS t, TRY_CAST(CASE WHEN regexp_matches(raw, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN substr(raw, 1, 10) END AS DATE) AS d FROM raw_dates WHERE raw IS NOT NULL), v AS (SELECT *, replace(raw, '-', '') AS bare FROM r)
 SELECT id, CASE WHEN id % 3 = 2 THEN t ELSE replace(replace(replace(replace(replace(replace(t, '{{date}}', raw), '{{date_compact}}', coalesce(strftime(d, '%Y%m%d'), bare)), '{{date_ddmmyyyy}}', coalesce(strftime(d, '%d%m%Y'), right(bare, 8))), '{{date_slash}}', coalesce(strftime(d, '%d/%m/%Y'), raw)), '{{league}}', 'La Liga 2'), '{{league_slug}}', 'la-liga-2') END AS url FROM v""")
def f17(spark, sf_dir):
    rows = frame(spark, sf_dir, "raw_dates").filter("raw is not null")
    return rows.select("id", S.render_template(F.expr(_TEMPLATE), F.col("raw"), F.lit("La Liga 2")).alias("url"))


_STAMP = "CASE event_id % 5 WHEN 0 THEN concat(d, 'T', t) WHEN 1 THEN concat(d, ' ', t) WHEN 2 THEN concat(d, 'T', t, '+02:00') WHEN 3 THEN 'soon' END"


@query("f24_utc_timestamps", f"""WITH r AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS t FROM events), s AS (SELECT event_id, {_STAMP} AS raw FROM r)
 SELECT event_id, strftime(CASE event_id % 5 WHEN 0 THEN strptime(raw, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strptime(raw, '%Y-%m-%d %H:%M:%S') - INTERVAL 1 HOUR WHEN 2 THEN strptime(raw, '%Y-%m-%dT%H:%M:%S+02:00') - INTERVAL 2 HOUR END, '%Y-%m-%d %H:%M:%S') AS utc FROM s""")
def f24(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("d"), F.date_format("ts", "HH:mm:ss").alias("t"))
    return rows.select("event_id", F.date_format(S.utc_timestamp(F.expr(_STAMP), "+01:00"), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("f26_event_minutes", """WITH e AS (SELECT user_id, CAST(floor((event_id * 37) % 5700 / 60) AS BIGINT) AS minute FROM events)
 SELECT user_id, CAST(count(*) FILTER (WHERE minute <= 15) AS BIGINT) AS early, CAST(count(*) FILTER (WHERE minute >= 75) AS BIGINT) AS late FROM e GROUP BY user_id""")
def f26(spark, sf_dir):
    """Early and late events by the minute of an event's second."""
    minute = F.floor((F.col("event_id") * 37) % 5700 / 60)
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(minute <= 15).alias("early"), F.count_if(minute >= 75).alias("late"))


@query("f48_normalised", ctes("contests") + " SELECT ok, ln, pk, sk, CASE WHEN hs IS NULL THEN 0.4e0 ELSE round(greatest(0e0, least(1e0, hs / 15e0)), 9) END AS shots, round(greatest(0e0, least(1e0, (hg - ag) / 3e0)), 9) AS lead FROM contests")
def f48(spark, sf_dir):
    held = lambda x, scale, default, name: F.round(S.normalised(x, scale, default), 9).alias(name)
    return contests(spark, sf_dir).select(*M.TIE, held(F.col("hs"), 15.0, 0.4, "shots"), held(F.col("hg") - F.col("ag"), 3.0, 0.0, "lead"))


_NEWS = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 100 END", "CASE WHEN event_id % 2 = 0 THEN NULL ELSE user_id / 10e0 END"


@query("f55_sentiment", f"WITH n AS (SELECT event_id, {_NEWS[0]} AS a, {_NEWS[1]} AS b, CASE WHEN event_id % 4 = 0 THEN user_id / 50e0 END AS own FROM events) SELECT event_id, round(CASE WHEN a IS NULL AND b IS NULL THEN coalesce(own, 0e0) ELSE (coalesce(a, 0e0) + coalesce(b, 0e0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) END, 6) AS sentiment FROM n")
def f55(spark, sf_dir):
    news = F.array(*[F.struct(F.expr(x).cast("double").alias("sentiment_score")) for x in _NEWS])
    own = F.expr("CASE WHEN event_id % 4 = 0 THEN user_id / 50e0 END")
    return load(spark, sf_dir, "events").select("event_id", F.round(S.mean_sentiment(news, own), 6).alias("sentiment"))


def _club(side: str) -> str:
    return f"concat(CASE ln % 3 WHEN 0 THEN 'Só ' WHEN 1 THEN ' A.S. ' ELSE '' END, {side}, ' & Co')"


def _key_of(side: str) -> str:
    return _KEY.replace("lower(name)", f"lower({_club(side)})")


@query("f04_fixture_keys", ctes("contests") + f" SELECT ok, ln, pk, sk, trim(league) AS league, substr(concat(CAST(match_date AS VARCHAR), 'T18:00'), 1, 10) AS day, {_key_of('home')} AS home_key, {_key_of('away')} AS away_key FROM contests")
def f04(spark, sf_dir):
    """Canonical fixture keys: league, day, and both team keys."""
    stamp = F.concat(F.col("match_date").cast("string"), F.lit("T18:00"))
    return contests(spark, sf_dir).select(*M.TIE, F.trim("league").alias("league"), F.substring(F.trim(stamp), 1, 10).alias("day"), X.team_key(F.expr(_club("home"))).alias("home_key"), X.team_key(F.expr(_club("away"))).alias("away_key"))


def _share(columns: list[str]) -> str:
    return "(" + " + ".join(f"({c} IS NOT NULL)::INT" for c in columns) + f") / {len(columns)}e0"


_CORE, _ADVANCED = ["hs", "aws", "hc", "ac", "hy", "ay"], ["xg_h", "xg_a", "referee", "conf"]


@query("a30_data_quality", ctes("contests") + f" SELECT ok, ln, pk, sk, round(least(1e0, 0.18e0 + 0.58e0 * {_share(_CORE)} + 0.16e0 * {_share(_ADVANCED)} + CASE WHEN pk % 3 > 0 THEN 0.08e0 ELSE 0e0 END), 6) AS event_quality, round(greatest(0.2e0, {_share(_CORE)}), 6) AS core_quality FROM contests")
def a30(spark, sf_dir):
    return contests(spark, sf_dir).select(*M.TIE, F.round(S.event_quality(_CORE, _ADVANCED, F.col("pk") % 3), 6).alias("event_quality"), F.round(S.core_quality(_CORE), 6).alias("core_quality"))


_METRICS = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 0.9e0 + p / 10 END AS champion, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE p + 0.5e0 END AS log_loss, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE p + 0.6e0 END AS loss, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE p_h END AS brier, p_d / 2 AS recall, p_a AS acc, CASE WHEN doc_id % 11 = 0 THEN 0e0 ELSE p_h END AS champion_acc FROM scored"


@query("d16_promotion_gates", ctes("scored") + f""", m AS ({_METRICS}), q AS (SELECT *, coalesce(log_loss, loss) + 0.35e0 * coalesce(brier, 0.7e0) + 0.03e0 * greatest(0e0, 0.1e0 - recall) AS quality FROM m)
 SELECT doc_id, round(quality, 6) AS quality, champion IS NULL OR coalesce(champion - quality > 0.002e0, false) OR (champion_acc = 0 AND acc > 0) AS promoted, doc_id >= 30 AND acc >= 0.3e0 AND champion_acc > 0 AND (acc - champion_acc >= 0.02e0 OR recall - acc >= 0.002e0) AS graph_enabled FROM q""")
def d16(spark, sf_dir):
    """Each labelled document stands for one candidate's metrics."""
    m = spark.sql(_METRICS.replace("FROM scored", "FROM {s}"), s=frame(spark, sf_dir, "scored"))
    quality = S.probability_quality(F.col("log_loss"), F.col("loss"), F.col("brier"), F.col("recall"))
    enabled = S.graph_model_enabled(F.col("doc_id"), F.col("acc") + 0.5, F.col("champion_acc"), F.col("acc") - F.col("champion_acc"), F.col("recall") - F.col("acc"))
    return m.select("doc_id", F.round(quality, 6).alias("quality"), S.promoted(F.col("champion"), quality, F.col("champion_acc"), F.col("acc")).alias("promoted"), enabled.alias("graph_enabled"))


def _swept(side: str) -> str:
    return f"CASE WHEN CAST(substr({side}, 6) AS INT) >= 15 THEN concat('team_', CAST(CAST(substr({side}, 6) AS INT) - 15 AS VARCHAR)) ELSE {side} END"


@query("k12_alias_sweep", CANON + f""", s AS (SELECT *, {_swept('home')} AS h, {_swept('away')} AS a FROM canon), o AS (SELECT *, row_number() OVER (PARTITION BY league, match_date, h, a ORDER BY CASE WHEN h = home AND a = away THEN 0 ELSE 1 END, ok, ln, pk, sk) AS r FROM s)
 SELECT concat_ws('_', CAST(match_date AS VARCHAR), h, a) AS id, league, CAST(count(*) AS BIGINT) AS n, arg_min(ok, r) AS ok, arg_min(ln, r) AS ln, arg_min(pk, r) AS pk, arg_min(sk, r) AS sk, arg_min(hc, r) FILTER (hc IS NOT NULL) AS hc, arg_min(referee, r) FILTER (referee IS NOT NULL) AS referee FROM o GROUP BY league, match_date, h, a""")
def k12(spark, sf_dir):
    c = canon(spark, sf_dir)
    teams = c.select("league", F.explode(F.array("home", "away")).alias("alias")).distinct()
    number = F.substring("alias", 6, 9).cast("int")
    aliases = teams.filter(number >= 15).select("league", "alias", F.concat(F.lit("team_"), (number - 15).cast("string")).alias("canonical"))
    return G.alias_sweep(c, aliases, ["hc", "referee"])


@query("j15_intel_lookup", CANON + """, i AS (SELECT lower(trim(concat(' ', upper(home)))) AS h, lower(trim(away)) AS a, match_date, xg_h AS intel, ok AS io, row_number() OVER (PARTITION BY lower(trim(home)), lower(trim(away)), match_date ORDER BY ok DESC, ln DESC, pk DESC, sk DESC) AS r FROM contests WHERE source = 'Flashscore_live')
 SELECT c.ok, c.ln, c.pk, c.sk, i.io AS intel_ok, round(i.intel, 6) AS intel FROM canon c LEFT JOIN i ON i.r = 1 AND i.h = lower(trim(c.home)) AND i.a = lower(trim(c.away)) AND i.match_date = c.match_date""")
def j15(spark, sf_dir):
    """Fixtures with the last intel report of the same teams and day, whatever its league."""
    seen = contests(spark, sf_dir).filter("source = 'Flashscore_live'").select(F.concat(F.lit(" "), F.upper("home")).alias("home"), "away", F.concat(F.col("match_date").cast("string"), F.lit("T00:00:00")).alias("day"), F.col("xg_h").alias("intel"), *M.TIE)
    fixtures = canon(spark, sf_dir).withColumn("day", F.col("match_date").cast("string"))
    return G.intel_lookup(fixtures, seen, "intel").select(*M.TIE, F.col("intel_ok"), F.round("intel", 6).alias("intel"))


@query("p13_mock_gate", ctes("contests") + " SELECT league, CAST(count(*) AS BIGINT) AS n FROM contests WHERE coalesce(CASE WHEN pk % 10 = 0 THEN 1 WHEN pk % 10 = 1 THEN NULL ELSE 0 END, 0) = 0 GROUP BY league")
def p13(spark, sf_dir):
    marked = contests(spark, sf_dir).withColumn("is_mock", F.expr("CASE WHEN pk % 10 = 0 THEN 1 WHEN pk % 10 = 1 THEN NULL ELSE 0 END"))
    return G.without_mocks(marked).groupBy("league").agg(F.count("*").alias("n"))


_PRIORITY = ("EUROPE", "ASIA", "AMERICA")


@query("w18_batch_order", ctes("contests") + """, b AS (SELECT league, match_date, bool_or(pk % 50 = 0) AS done FROM contests GROUP BY ALL)
 SELECT CAST(CASE league WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 WHEN 'AMERICA' THEN 2 ELSE 999 END AS INT) AS priority, league, match_date, CAST(row_number() OVER (PARTITION BY league ORDER BY match_date DESC) AS INT) AS place FROM b WHERE NOT done""")
def w18(spark, sf_dir):
    """Days that are still to be fetched, leagues by priority, newest first; days are aggregated before they are ranked."""
    listed = F.array_position(F.array(*[F.lit(x) for x in _PRIORITY]), F.col("league")).cast("int")
    days = contests(spark, sf_dir).groupBy("league", "match_date").agg(F.bool_or(F.col("pk") % 50 == 0).alias("done")).filter("not done")
    place = F.row_number().over(Window.partitionBy("league").orderBy(F.desc("match_date")))
    return days.select(F.when(listed > 0, listed - 1).otherwise(999).alias("priority"), "league", "match_date", place.alias("place")).orderBy("priority", "league", F.desc("match_date"))


@query("t08_history_order", ctes("raw_dates") + " SELECT id, CASE WHEN raw IS NULL OR raw = '' THEN '0' ELSE array_to_string(list_reverse(string_split(raw, '/')), '') END AS sort_key FROM raw_dates ORDER BY sort_key DESC, id")
def t08(spark, sf_dir):
    """History, newest first, by day-first dates turned around; rows without a date come last."""
    key = F.when(F.coalesce(F.col("raw"), F.lit("")) == "", "0").otherwise(F.array_join(F.reverse(F.split("raw", "/")), ""))
    return frame(spark, sf_dir, "raw_dates").select("id", key.alias("sort_key")).orderBy(F.desc("sort_key"), "id")


@query("k17_event_log", "SELECT event_id, event_type AS status, user_id AS run_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def k17(spark, sf_dir):
    """The rolling log keeps its ten newest entries (the limit is the feature)."""
    return load(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", F.col("event_type").alias("status"), F.col("user_id").alias("run_id"))
