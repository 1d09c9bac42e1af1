"""Conversation repair against a plain search over edits, and the grammar against its input."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from touchline.llm import conversation_repair as C
from touchline.llm import grammar as G
from touchline.llm import queries as Q
from touchline.llm.common import table

INK = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    """Rows after damage, by conversation; the contract's words."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        own = out[conv]
        say = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        own += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain(rows):
    """The contract's columns of one conversation's rows by a search for the cheapest, least audit (Dijkstra over strings)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        ink = INK.findall(text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum((a + b) not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, last, lines = heapq.heappop(queue)
        if at == len(rows) and last in ("", "a"):
            break
        if (at, last) in done:
            continue
        done.add((at, last))
        may = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        word = {"u": "user", "a": "assistant"}
        for x in set(may) & {"u", "a"}:
            heapq.heappush(queue, (cost + 3, audit + "I", at, x, (*lines, word[x] + ":")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, last, lines))
            if faults[at] in ("", "truncated"):
                lame = 3 * (faults[at] == "truncated")
                if role[:1] and role[:1] in may:
                    heapq.heappush(queue, (cost + lame, audit + "K", at + 1, role[:1], (*lines, f"{role}:{text}")))
                for x in set(may) & {"u", "a"}:
                    heapq.heappush(queue, (cost + lame + 3, audit + "R", at + 1, x, (*lines, f"{word[x]}:{text}")))
    count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def key(r):
    return tuple((v is not None, v) for v in r)


def rows_of(seed, convs, most):
    r, out = random.Random(seed), []
    for c in range(convs):
        for t in range(r.randrange(1, most)):
            role = r.choice(["user", "assistant"]) if r.random() < 0.3 else ["user", "assistant"][t % 2]
            role = "system" if t == 0 and r.random() < 0.3 else r.choice(["tool", "", None, "System"]) if r.random() < 0.08 else role
            text = r.choice(["Yes.", "no", "\t \n", "", None, "What? ", "Right!\n", "same words.", "x. "]) if r.random() < 0.5 else f"line {r.randrange(10**6)}."
            out.append((c if c else None, None if r.random() < 0.05 else t * r.choice([1, 1, 1, 2]), role, text))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def check(df, rows):
    want = sorted(((c, *plain(x)) for c, x in damaged(rows).items()), key=key)
    assert sorted(map(tuple, df.collect()), key=key) == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_conversations(spark, seed):
    rows = rows_of(seed, 120, 12)
    check(C.repair_conversations(*C.damage(spark.createDataFrame(rows, SCHEMA))), rows)


def test_small_blocks(spark, monkeypatch):
    """Blocks of five symbols: nearly all conversations are made of pieces."""
    rows = rows_of(7, 25, 40) + [(500, t, ["user", "assistant"][t % 2], f"t{t % 90}.") for t in range(300)]
    monkeypatch.setattr(C, "BLOCK_SYMBOLS", 5)
    code = C.repair_conversations
    check(code(*C.damage(spark.createDataFrame(rows, SCHEMA).repartition(7))), rows)


def test_query(spark, sf_dir):
    df = Q.op13_conversation_repair(spark, sf_dir)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    check(df, [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, sf_dir, "conversations").collect()])


def test_awkward_tables(spark):
    assert C.repair_conversations(*C.damage(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = [("x", "a", 4, "user", "Hello there.", 1), ("x", "a", 4, "user", "Hello there.", 2), ("x", "a", 5, "assistant", "long " * 50_000 + ".", 3), ("x", "b", None, None, None, 4)]
    odd = spark.createDataFrame(rows, "name string, kind string, turn int, role string, text string, copies int")
    got = {r.conv_id: r for r in C.repair_conversations(odd, conv_col="kind").collect()}
    assert (got["a"].duplicate, got["a"].audit, got["a"].cost, got["a"].gaps) == (1, "KDK", 4, 0)
    assert (got["b"].blank, got["b"].audit, got["b"].repaired_sha256) == (1, "D", hashlib.sha256(b"").hexdigest())
    none = C.repair_conversations(odd, odd["copies"] - odd["copies"], conv_col="kind").collect()
    assert sorted(tuple(r) for r in none) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in "ab"]


def expand(symbol, rules, first):
    if symbol < first:
        return [symbol]
    a, b = rules[symbol - first]
    return expand(a, rules, first) + expand(b, rules, first)


def test_grammar_round_trip():
    r = random.Random(5)
    for _ in range(300):
        sequences = [[r.randrange(r.choice([1, 2, 4])) for _ in range(r.randrange(0, 25))] for _ in range(r.randrange(0, 8))]
        packed, rules = G.repair(sequences, 9)
        assert [[x for s in p for x in expand(s, rules, 9)] for p in packed] == sequences
        left = defaultdict(int)
        for p in packed:
            k = 0
            for a, b in zip(p, p[1:], strict=False):
                left[a, b] += 1
                k += 1
        assert all(n == 1 or a == b for (a, b), n in left.items())


def test_ropes_compare_like_strings():
    r = random.Random(6)

    def rope(text):
        if len(text) < 2 or r.random() < 0.2:
            return text
        k = r.randrange(len(text) + 1)
        return (rope(text[:k]), rope(text[k:])) if 0 < k < len(text) else text

    for _ in range(2000):
        a = "".join(r.choice("DIK") for _ in range(r.randrange(0, 12)))
        b = a[: r.randrange(len(a) + 1)] + "".join(r.choice("DIK") for _ in range(r.randrange(0, 4)))
        x = rope(a)
        y = rope(b)
        assert G.less(x, y) == (a < b) and G.flat(x) == a
        assert G.less((x, y), (x, x)) == (a + b < a + a)
