"""Domain frames derived from the test tables.

Each frame is one SELECT that Spark and DuckDB read alike; the oracles use it as a common table expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FRAMES: dict[str, str] = {
    # the central fact: one row per reported match, duplicates included
    "contests": """SELECT r_name AS league, CAST(l_shipdate AS DATE) AS match_date,
  concat('team_', CAST(l_suppkey % 20 AS STRING)) AS home,
  concat('team_', CAST((l_suppkey % 20 + 1 + l_partkey % 19) % 20 AS STRING)) AS away,
  CAST(CAST(l_quantity AS BIGINT) % 5 AS INT) AS hg, CAST((l_linenumber + l_partkey) % 4 AS INT) AS ag,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE 1.0e0 + (l_partkey % 40) / 10.0e0 END AS odds_h,
  2.5e0 + (l_suppkey % 17) / 10.0e0 AS odds_d,
  CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE 1.3e0 + (l_orderkey % 50) / 10.0e0 END AS odds_a,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_partkey % 20 AS INT) END AS hs,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_suppkey % 15 AS INT) END AS aws,
  CASE WHEN l_orderkey % 5 = 1 THEN NULL ELSE CAST(l_orderkey % 12 AS INT) END AS hc,
  CASE WHEN l_orderkey % 5 = 1 THEN NULL ELSE CAST(l_partkey % 9 AS INT) END AS ac,
  CASE WHEN l_suppkey % 6 = 2 THEN NULL ELSE CAST(l_linenumber % 5 AS INT) END AS hy,
  CASE WHEN l_suppkey % 6 = 2 THEN NULL ELSE CAST(l_partkey % 4 AS INT) END AS ay,
  CAST(CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS INT) AS hr, CAST(CASE WHEN l_partkey % 41 = 0 THEN 1 ELSE 0 END AS INT) AS ar,
  CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE (l_partkey % 10) / 10.0e0 END AS conf,
  CASE l_partkey % 6 WHEN 0 THEN 'closed_prediction' WHEN 1 THEN 'Flashscore_live' WHEN 2 THEN 'historical_csv' WHEN 3 THEN 'openfootball_repo' WHEN 4 THEN NULL ELSE 'browser' END AS source,
  CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE concat('Ref ', CAST(l_partkey % 31 AS STRING)) END AS referee,
  l_discount * 20.0e0 AS xg_h, l_tax * 20.0e0 AS xg_a,
  l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk
FROM {lineitem} JOIN {region} ON r_regionkey = l_orderkey % 5""",
    # an odds log: several snapshots of a match
    "odds_log": """SELECT CAST(user_id AS BIGINT) AS match_key, ts, event_id, event_type AS kind, 1.01e0 + value / 100.0e0 AS odd,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 2.0e0 + (event_id % 30) / 10.0e0 END AS odd_d, props FROM {events}""",
    # probabilities with outcomes
    "scored": """SELECT d.doc_id, d.lang AS grp, (d.n_chars % 97 + 1) / 98.0e0 AS p, l.quality AS y,
  (d.n_chars % 7 + 1) / 20.0e0 AS p_h, (d.n_chars % 5 + 1) / 20.0e0 AS p_d, (d.n_chars % 11 + 1) / 20.0e0 AS p_a,
  CASE d.n_chars % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'D' ELSE 'A' END AS ftr
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    # free text of any kind
    "names": """SELECT CAST(p_partkey AS BIGINT) AS id, concat(CASE p_partkey % 5 WHEN 0 THEN 'FC ' WHEN 1 THEN '  AS ' WHEN 2 THEN 'Real ' WHEN 3 THEN 'SV ' ELSE '' END, p_name,
  CASE p_partkey % 4 WHEN 0 THEN ' & Co' WHEN 1 THEN '''s United FC' WHEN 2 THEN ' CF' ELSE '.' END) AS name FROM {part}""",
    # dates as sources write them
    "raw_dates": """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 7
  WHEN 0 THEN {fmt:o_orderdate:dmy/} WHEN 1 THEN {fmt:o_orderdate:ymd-} WHEN 2 THEN {fmt:o_orderdate:ymd/} WHEN 3 THEN {fmt:o_orderdate:dmy-}
  WHEN 4 THEN '' WHEN 5 THEN 'soon' ELSE NULL END AS raw FROM {orders}""",
}
_FORMATS = {"dmy/": ("dd/MM/yyyy", "%d/%m/%Y"), "ymd-": ("yyyy-MM-dd", "%Y-%m-%d"), "ymd/": ("yyyy/MM/dd", "%Y/%m/%d"), "dmy-": ("dd-MM-yyyy", "%d-%m-%Y")}
_TABLE = re.compile(r"\{(\w+)\}")
_FORMAT = re.compile(r"\{fmt:(\w+):([^}]+)\}")


def duck(name: str) -> str:
    """The frame as a DuckDB SELECT."""
    sql = _FORMAT.sub(lambda m: f"strftime({m[1]}, '{_FORMATS[m[2]][1]}')", FRAMES[name])
    return _TABLE.sub(lambda m: m[1], sql)


def ctes(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for oracles."""
    return "WITH " + ", ".join(f"{n} AS ({duck(n)})" for n in names)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _FORMAT.sub(lambda m: f"date_format({m[1]}, '{_FORMATS[m[2]][0]}')", FRAMES[name])
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(_TABLE.findall(sql))}
    return spark.sql(sql, **tables)
