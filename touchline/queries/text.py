"""Text, URL and JSON parsing, event statistics, source selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.bindings import ctes, frame
from touchline.functions import text as X
from touchline.operators import events as E
from touchline.operators import matches as M
from touchline.operators import schedules as H
from touchline.queries.quality import CANON, canon, contests
from touchline.registry import query


def load(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("f08_urls", "SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS canonical, sha1(url) AS cache_key FROM pages".replace("sha1(url)", "substring(md5(url), 1, 24)"))
def f08(spark, sf_dir):
    url = F.col("url")
    return load(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(url, "://([^/?#]+)", 1)).alias("host"), F.regexp_extract(url, "[?&]page=([^&#]*)", 1).alias("page"), F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", "").alias("canonical"), F.substring(F.md5(url), 1, 24).alias("cache_key"))


@query("f09_match_text", CANON + " SELECT ok, ln, pk, sk, home, away, lpad(CAST(ok % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(pk % 60 AS VARCHAR), 2, '0') AS kickoff, hg, ag FROM canon")
def f09(spark, sf_dir):
    """Parse ``Home v Away 15:00 2-1`` lines back into columns."""
    line = F.format_string("%s v %s  %02d:%02d  %d-%d", "home", "away", F.col("ok") % 24, F.col("pk") % 60, "hg", "ag")
    return E.parse_match_lines(canon(spark, sf_dir).select(*M.TIE, line.alias("line")), "line").drop("line")


@query("f11_stat_lines", CANON + " SELECT ok, ln, pk, sk, CAST(hc AS DOUBLE) AS home_corners, CAST(ac AS DOUBLE) AS away_corners, CAST(hs + 0.5e0 AS DOUBLE) AS home_shots, CAST(aws AS DOUBLE) AS away_shots FROM canon WHERE hc IS NOT NULL OR hs IS NOT NULL")
def f11(spark, sf_dir):
    """Statistics from page text: the line above a label is the home value, the line below the away value."""
    n = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    half = F.when(F.col("hs").isNotNull(), F.concat(F.col("hs").cast("string"), F.lit(",5"))).otherwise("-")
    page = F.concat_ws("\n", F.lit("Match report"), n("hc"), F.lit("Corner kicks"), n("ac"), half, F.lit("Total shots"), n("aws"))
    pages = canon(spark, sf_dir).filter("hc is not null or hs is not null").select(*M.TIE, page.alias("page"))
    return E.parse_stat_lines(pages, M.TIE, "page", {"Corner kicks": "corners", "Total shots": "shots"})


@query("f50_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing, CAST(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) % 4 AS BIGINT) AS tag FROM events")
def f50(spark, sf_dir):
    parsed = F.from_json("props", "k bigint, none string")
    return load(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), parsed["none"].alias("missing"), (F.coalesce(parsed["k"], F.lit(0)) % 4).alias("tag"))


@query("a19_event_stats", """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, value, hour(ts) * 60 + minute(ts) AS m FROM events), t AS (SELECT day, count(*) AS total FROM e GROUP BY day)
 SELECT e.user_id, e.day, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT event_type) AS BIGINT) AS kinds, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS on_target, round(sum(value), 4) AS total_value, CAST(sum(CASE WHEN m <= 720 THEN 1 ELSE 0 END) AS BIGINT) AS early,
 round(count(*) / max(t.total), 9) AS share FROM e JOIN t ON e.day = t.day GROUP BY ALL""")
def a19(spark, sf_dir):
    return E.event_stats(load(spark, sf_dir, "events"))


@query("a20_tag_stats", """WITH e AS (SELECT user_id, [CAST(event_id % 3 + 100 AS INT), CAST(event_id % 7 + 1700 AS INT)] AS tags FROM events)
 SELECT user_id, CAST(sum(CASE WHEN list_contains(tags, 101) THEN 1 ELSE 0 END) AS BIGINT) AS goals, CAST(sum(CASE WHEN list_contains(tags, 1702) THEN 1 ELSE 0 END) AS BIGINT) AS yellow, CAST(sum(CASE WHEN list_contains(tags, 1701) OR list_contains(tags, 1703) THEN 1 ELSE 0 END) AS BIGINT) AS red FROM e GROUP BY user_id""")
def a20(spark, sf_dir):
    tag = lambda m, base: F.struct((F.col("event_id") % m + base).cast("int").alias("id"))
    return E.tag_stats(load(spark, sf_dir, "events").select("user_id", F.array(tag(3, 100), tag(7, 1700)).alias("tags")), "user_id", {"goals": [101], "yellow": [1702], "red": [1701, 1703]})


@query("p19_noise_lines", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN trim(line) = '' OR length(trim(line)) < 3 OR regexp_matches(line, '^[^a-z]*$') THEN 1 ELSE 0 END) AS BIGINT) AS noise FROM l GROUP BY doc_id""")
def p19(spark, sf_dir):
    lines = load(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    bad = lambda x: (F.trim(x) == "") | (F.length(F.trim(x)) < 3) | x.rlike("^[^a-z]*$")
    return lines.select("doc_id", F.size("lines").cast("bigint").alias("n_lines"), F.size(F.filter("lines", bad)).cast("bigint").alias("noise"))


@query("s22_source_cascade", ctes("contests") + """, s AS (SELECT *, CASE WHEN source = 'closed_prediction' THEN 1 WHEN source = 'historical_csv' THEN 2 WHEN source = 'browser' THEN 3 WHEN source IS NULL THEN 5 ELSE 4 END AS source_rank FROM contests),
 m AS (SELECT *, min(source_rank) OVER (PARTITION BY league, match_date) AS best FROM s) SELECT league, match_date, CAST(best AS INT) AS source_rank, CAST(count(*) AS BIGINT) AS n FROM m WHERE source_rank = best GROUP BY ALL""")
def s22(spark, sf_dir):
    """The first source that has any match of a league's day wins the day."""
    src = F.col("source")
    rank = F.when(src == "closed_prediction", 1).when(src == "historical_csv", 2).when(src == "browser", 3).when(src.isNull(), 5).otherwise(4)
    per = contests(spark, sf_dir).groupBy("league", "match_date", rank.alias("source_rank")).agg(F.count("*").alias("n"))
    return per.groupBy("league", "match_date").agg(F.min(F.struct("source_rank", "n")).alias("m")).select("league", "match_date", "m.source_rank", "m.n")


@query("s12_first_source_wins", CANON + """, u AS (SELECT 0 AS rk, league, match_date, home, away, ok, ln, pk, sk FROM canon WHERE referee IS NOT NULL UNION ALL SELECT 1, league, match_date, home, away, ok, ln, pk, sk FROM contests)
 SELECT league, match_date, home, away, rk, ok FROM (SELECT *, row_number() OVER (PARTITION BY league, match_date, home, away ORDER BY rk, ok, ln, pk, sk) AS r FROM u) WHERE r = 1""")
def s12(spark, sf_dir):
    """Canonical rows that know their referee come first, then reports of any kind; each fixture is taken from the first source that has it."""
    cols = ["league", "match_date", "home", "away", *M.TIE]
    both = canon(spark, sf_dir).filter("referee is not null").select(F.lit(0).alias("rk"), *cols).unionByName(contests(spark, sf_dir).select(F.lit(1).alias("rk"), *cols))
    first = both.groupBy(*cols[:4]).agg(F.min(F.struct("rk", *M.TIE)).alias("m"))
    return first.select(*cols[:4], "m.rk", "m.ok")


@query("s16_conversation_order", """SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, string_agg(substring(role, 1, 1), '' ORDER BY turn, substring(role, 1, 1)) AS roles, CAST(max(turn) - min(turn) AS BIGINT) AS span FROM conversations GROUP BY conv_id""")
def s16(spark, sf_dir):
    """Roles of each conversation in turn order; a repeated turn is ordered by its role's letter."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.substring("role", 1, 1).alias("r")))), lambda x: x["r"]), "")
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), ordered.alias("roles"), (F.max("turn") - F.min("turn")).alias("span"))


@query("w13_top_per_pair", CANON + """, o AS (SELECT league, least(home, away) AS a, greatest(home, away) AS b, match_date, hg + ag AS goals, row_number() OVER (PARTITION BY league, least(home, away), greatest(home, away) ORDER BY match_date DESC, ok DESC, ln DESC, pk DESC, sk DESC) AS r FROM canon)
 SELECT league, a, b, CAST(count(*) AS BIGINT) AS n, CAST(sum(goals) AS BIGINT) AS goals, max(match_date) AS latest FROM o WHERE r <= 20 GROUP BY ALL""")
def w13(spark, sf_dir):
    pair = canon(spark, sf_dir).select("league", F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b"), "match_date", (F.col("hg") + F.col("ag")).alias("goals"), *M.TIE)
    w = Window.partitionBy("league", "a", "b").orderBy(F.desc("match_date"), *[F.desc(c) for c in M.TIE])
    return pair.withColumn("r", F.row_number().over(w)).filter("r <= 20").groupBy("league", "a", "b").agg(F.count("*").alias("n"), F.sum("goals").alias("goals"), F.max("match_date").alias("latest"))


@query("f10_schedule_pages", CANON + " SELECT league, match_date, home, away, lpad(CAST(ok % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(pk % 60 AS VARCHAR), 2, '0') AS kickoff, CAST(count(*) AS BIGINT) AS n FROM canon WHERE pk % 5 > 0 AND sk % 4 > 0 AND home <> away GROUP BY ALL")
def f10(spark, sf_dir):
    """One page for each league's day: a date and a time, then the teams, with lines between that say nothing.  A fifth of the
    dates is another day's, and a quarter of the home teams does not stand right below its date."""
    c = canon(spark, sf_dir)
    date = F.date_format(F.when(F.col("pk") % 5 == 0, F.date_add("match_date", 1)).otherwise(F.col("match_date")), "dd.MM.")
    rows = F.concat_ws("\n", F.format_string("%s %02d:%02d", date, F.col("ok") % 24, F.col("pk") % 60), F.when(F.col("sk") % 4 == 0, "Round 7"), F.concat(F.lit("  "), "home"), F.when(F.col("ok") % 3 == 0, "Advertisement\n12"), F.concat("away", F.lit(" |")), F.lit("Show more"))
    pages = c.groupBy("league", "match_date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*M.TIE, rows.alias("x")))), lambda s: s["x"]), "\n").alias("page"))
    return H.parse_schedules(pages, ["league", "match_date"], "page", "match_date").groupBy("league", "match_date", "home", "away", "kickoff").agg(F.count("*").alias("n"))


@query("f01_folded_texts", "SELECT doc_id, md5(lower(strip_accents(coalesce(text, '')))) AS folded, CAST(length(text) - length(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')) AS BIGINT) AS beyond_ascii FROM documents")
def f01(spark, sf_dir):
    """Whole texts without marks on their letters, as a digest, and how many characters are beyond ASCII then."""
    bare = X.without_marks(F.coalesce("text", F.lit("")))
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower(bare)).alias("folded"), (F.length("text") - F.length(F.regexp_replace(X.without_marks(F.col("text")), "[^\\x00-\\x7F]", ""))).cast("bigint").alias("beyond_ascii"))


_CLUB = "concat_ws(' ', CASE CAST(regexp_extract(name, '[aeiou]') AS STRING) WHEN 'a' THEN 'F.C.' WHEN 'e' THEN 'AC US' WHEN 'i' THEN 'The' ELSE 'Cd' END, name, CASE WHEN id % 3 = 0 THEN 'Calcio CF' WHEN id % 3 = 1 THEN 'of Club & Co' ELSE NULL END)"


@query("f03_club_keys", ctes("names") + f""", c AS (SELECT id, {_CLUB.replace(" AS STRING", " AS VARCHAR")} AS club FROM names), k AS (SELECT id, trim(regexp_replace(regexp_replace(replace(lower(strip_accents(club)), '&', ' and '), '[''`´’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS key FROM c),
 e AS (SELECT *, trim(regexp_replace(' ' || trim(regexp_replace(key || ' ', '^((a|as|ac|acf|ss|us|ud|fc|cf|rc|cd|sd|sv) )+', '')), '( (afc|calcio|cf|club|cp|fc|football|futbol|sc|ud))+$', '')) AS edge FROM k)
 SELECT id, key, array_to_string(list_filter(string_split(edge, ' '), lambda w: w NOT IN ('de', 'of', 'the')), ' ') AS bare FROM e""")
def f03(spark, sf_dir):
    club = frame(spark, sf_dir, "names").select("id", F.expr(_CLUB.replace("'[aeiou]'", "'[aeiou]', 0")).alias("club"))
    key, bare = X.club_key(F.col("club"))
    return club.select("id", key.alias("key"), bare.alias("bare"))
