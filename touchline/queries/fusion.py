"""The fused probabilities of every match; the models' own are stand-ins derived from keys, and each is unknown for some matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import fusion as U
from touchline.operators import matches as M
from touchline.queries.markets import PRED, pred
from touchline.registry import query


def _third(k: str, n: str, never: str) -> dict[str, str]:
    """Three columns in (0, 1) that sum to 1, null where ``never`` holds."""
    parts = {"h": f"({k} % 7 + 2)", "d": f"({k} % 5 + 2)", "a": f"({k} % 6 + 2)"}
    total = " + ".join(parts.values())
    return {f"{n}_{s}": f"CASE WHEN {never} THEN NULL ELSE {p} * 1.0e0 / ({total}) END" for s, p in parts.items()}


COLUMNS = {
    **_third("ok", "first", "ok % 3 = 0"), **_third("pk", "second", "pk % 8 = 0"), **_third("sk", "graph", "sk % 4 = 1"), **_third("(pk + 2)", "tree", "pk % 5 = 2"), **_third("(ok + pk)", "goal", "ok % 6 = 5"), **_third("(sk + 1)", "iso", "sk % 2 = 0"),
    "first_btts": "(pk % 40 + 40) / 100e0", "first_o25": "CASE WHEN pk % 9 = 0 THEN NULL ELSE (ok % 45 + 40) / 100e0 END", "second_o15": "(ok % 30 + 60) / 100e0", "goal_btts": "CASE WHEN ok % 6 = 5 THEN NULL ELSE (sk % 50 + 30) / 100e0 END", "goal_o25": "CASE WHEN ok % 6 = 5 THEN NULL ELSE (sk % 60 + 20) / 100e0 END",
    "news_h": "CASE WHEN pk % 3 = 0 THEN NULL ELSE (pk % 9 - 4) / 10e0 END", "news_a": "(sk % 9 - 4) / 10e0", "graph_recommended": "CASE WHEN ok % 10 = 0 THEN NULL ELSE (ok % 20) / 100e0 END", "graph_loss_lift": "(pk % 11 - 3) / 1000e0", "graph_accuracy_lift": "(sk % 7 - 3) / 100e0",
    "press_h": "CASE WHEN pk % 7 = 3 THEN NULL ELSE (ok % 10) / 10e0 END", "press_a": "(pk % 10) / 10e0", "rank_h": "(ok % 20) / 20e0", "rank_a": "(pk % 20) / 20e0", "bias_h": "0.9e0 + (ok % 4) / 10e0", "bias_d": "CASE WHEN ok % 5 = 0 THEN NULL ELSE 1.1e0 END", "bias_a": "1.0e0 + (pk % 3) / 20e0",
}
FLAGS = {"goal_fitted": "pk % 2 = 0", "must_h": "ok % 4 = 1", "must_a": "pk % 4 = 1"}


def _twin() -> str:
    held = lambda x, a, b: f"least({b}e0, greatest({a}e0, {x}))"
    steps = []

    def step(name: str, before: str, raw: dict[str, str], when: str = "TRUE", low: str = "0.01", high: str = "0.98", more: str = "") -> None:
        parts = ", ".join(f"{held(x, low, high)} AS c_{s}" for s, x in raw.items())
        steps.append(f"{name}c AS (SELECT *, {parts} FROM {before}), {name} AS (SELECT * EXCLUDE (ph, pd, pa, c_h, c_d, c_a){more}, " + ", ".join(f"CASE WHEN {when} THEN c_{s} / (c_h + c_d + c_a) ELSE p{s} END AS p{s}" for s in "hda") + f" FROM {name}c)")

    mixed = lambda m, w: {s: f"p{s} * (1 - {w}) + coalesce({m}_{s}, 0e0) * {w}" for s in "hda"}
    columns = ", ".join(f"{x} AS {n}" for n, x in (COLUMNS | FLAGS).items())
    news = "((coalesce(news_h, 0e0) - coalesce(news_a, 0e0)) * 0.4e0)"
    first = "first_h IS NOT NULL"
    h, a = held(f"coalesce(first_h, 0.3e0) + {news}", "0.05", "0.95"), held(f"coalesce(first_a, 0.3e0) - {news}", "0.05", "0.95")
    line = lambda x: f"CASE WHEN {first} THEN {'coalesce(first_' + x + ', 0.5e0)' if f'first_{x}' in COLUMNS else '0.5e0'} ELSE {'coalesce(second_' + x + ', 0.5e0)' if f'second_{x}' in COLUMNS else '0.5e0'} END"
    blended = lambda x: f"CASE WHEN goal_{x} IS NULL THEN {x} ELSE {held(f'{x} * 0.65e0 + goal_{x} * 0.35e0', '0.01', '0.99')} END"
    steps.append(f"b AS (SELECT ok, ln, pk, sk, {columns} FROM pred), n AS (SELECT *, {h} AS nh, {a} AS na FROM b), s0 AS (SELECT * EXCLUDE (nh, na), CASE WHEN {first} THEN nh / (nh + first_d + na) ELSE coalesce(second_h, 0.33e0) END AS ph, CASE WHEN {first} THEN first_d / (nh + first_d + na) ELSE coalesce(second_d, 0.34e0) END AS pd, CASE WHEN {first} THEN na / (nh + first_d + na) ELSE coalesce(second_a, 0.33e0) END AS pa, {', '.join(f'{line(x)} AS {x}' for x in U.LINES)},"
                 " CASE WHEN graph_h IS NULL THEN 0e0 ELSE least(0.20e0, greatest(0.04e0, greatest(0e0, coalesce(graph_recommended, 0e0))) + least(0.06e0, greatest(0e0, graph_loss_lift) * 8e0 + greatest(0e0, graph_accuracy_lift))) END AS gw FROM n)")  # fmt: skip
    step("s1", "s0", mixed("graph", "gw"), "graph_h IS NOT NULL")
    step("s2", "s1", mixed("tree", "0.15e0"), "tree_h IS NOT NULL")
    step("s3", "s2", mixed("goal", "(CASE WHEN goal_fitted THEN 0.22e0 ELSE 0.12e0 END)"), "goal_h IS NOT NULL")
    steps.append("mv AS (SELECT *, least(0.065e0, greatest(-0.065e0, (coalesce(press_h, 0e0) - press_a) * 0.045e0 + CASE WHEN must_h AND NOT must_a THEN 0.014e0 ELSE 0e0 END - CASE WHEN must_a AND NOT must_h THEN 0.014e0 ELSE 0e0 END + CASE WHEN press_h >= 0.65e0 AND rank_a - rank_h >= 0.30e0 THEN 0.010e0 ELSE 0e0 END - CASE WHEN press_a >= 0.65e0 AND rank_h - rank_a >= 0.30e0 THEN 0.010e0 ELSE 0e0 END)) AS move, CASE WHEN press_h >= 0.45e0 AND press_a >= 0.45e0 THEN 0.010e0 ELSE 0e0 END AS dr FROM s3)")
    step("s4", "mv", {"h": "ph + move", "d": "pd + dr", "a": "pa - move"}, "press_h IS NOT NULL", "0.03", "0.94")
    step("s5", "s4", {s: f"p{s} * sqrt(coalesce(bias_{s}, 1e0))" for s in "hda"})
    step("s6", "s5", mixed("iso", "0.70e0"), "iso_h IS NOT NULL")
    out = ", ".join(f"round(p{s}, 9) AS p_{s}" for s in "hda") + ", " + ", ".join(f"round({blended(x) if f'goal_{x}' in COLUMNS else x}, 9) AS p_{x}" for x in U.LINES)
    return f"{PRED}, {', '.join(steps)} SELECT ok, ln, pk, sk, {out}, round(gw, 9) AS graph_weight FROM s6"


@query("m14_fusion", _twin())
def m14(spark, sf_dir):
    rows = pred(spark, sf_dir).select(*M.TIE, *[F.expr(x.replace("e0", "D")).alias(n) for n, x in (COLUMNS | FLAGS).items()])
    made = [f"p_{x}" for x in (*U.THREE, *U.LINES)]
    return U.fuse(rows).select(*M.TIE, *[F.round(c, 9).alias(c) for c in (*made, "graph_weight")])
