"""Personal data: patterns against the contract's expressions, the field's messages against enumeration, and whole texts."""

import hashlib
import itertools
import random
import re

import numpy as np

from tests.llm.fixtures import documents, empty
from touchline.llm import pii_crf as P
from touchline.llm import queries as Q
from touchline.llm.common import table

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def checksum(d):
    double = [int(x) * (1 + k % 2) for k, x in enumerate(reversed(d))]
    return sum(x - 9 * (x > 9) for x in double) % 10 == 0


def contract(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    keep = {
        EMAIL: lambda m: True,
        IP: lambda m: all(int(x) <= 255 for x in m.split(".")),
        CARD: lambda m: 13 <= len(digits(m)) <= 19 and checksum(digits(m)),
        PHONE: lambda m: 9 <= len(digits(m)) <= 15,
    }
    return [[m.span() for m in re.finditer(p, text) if ok(m.group())] for p, ok in keep.items()]


def listed(spans):
    return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(P.KINDS, spans, strict=True) for a, b in own)


def with_checksum(r, n):
    d = "".join(r.choice("0123456789") for _ in range(n - 1))
    return next(d + x for x in "0123456789" if checksum(d + x))


def test_patterns_equal_the_expressions():
    r = random.Random(3)
    pieces = ["a@b.c", "x.y_%", "@", ".", "..", "1.2.3.4", "300.1.1.1", "010.0.0.1", "9.9.9", "+1 (212) 555-0000", "+", "(", ") ", "-", " ", "\n", "é", "7", "12", "4465758382889437", "٣", "é@é.com", "-a-@-.-"]
    for _ in range(6000):
        text = "".join(r.choice(pieces) if r.random() < 0.8 else with_checksum(r, r.randrange(12, 21)) for _ in range(r.randrange(1, 9)))
        assert P.patterns(text)[0] == contract(text), text
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 50_000, "a@b." * 50_000, "0" * 5000 + "1.1.1.1"):
        assert [len(x) for x in P.patterns(text)[0]] is not None


def test_messages_are_exact_on_trees():
    r = np.random.default_rng(1)
    field = P.Field(["f", "g", "h"])
    field.unary, field.trans, field.skip = r.normal(size=(3, P.LABELS)), r.normal(size=(P.LABELS, P.LABELS)), np.array([0.7, -0.4])
    g = P.Graph()
    g.add([[0], [1, 2], [2], []], np.array([-1, -1, 3, -1]), [(0, 1)], [(1, 2)], [(1, 3)])
    nodes, edges = field.beliefs(g.close(), True)
    want, joint, total = np.zeros((4, P.LABELS)), np.zeros((3, P.LABELS, P.LABELS)), 0.0
    for y in itertools.product(range(P.LABELS), repeat=4):
        if y[2] != 3:
            continue
        score = sum(field.unary[f, y[k]] for k, own in enumerate([[0], [1, 2], [2], []]) for f in own)
        p = np.exp(score + field.trans[y[0], y[1]] + 0.7 * (y[1] == y[2]) - 0.4 * (y[1] == y[3]))
        total += p
        for k in range(4):
            want[k, y[k]] += p
        for e, (u, v) in enumerate(((0, 1), (1, 2), (1, 3))):
            joint[e, y[u], y[v]] += p
    assert np.allclose(nodes, want / total, atol=1e-6) and np.allclose(edges, joint / total, atol=1e-6)


def test_texts_do_not_touch_each_other():
    r = np.random.default_rng(2)
    field = P.Field(["bias", "digits 7", "digits 10"])
    field.unary, field.trans = r.normal(size=(3, P.LABELS)), r.normal(size=(P.LABELS, P.LABELS))
    texts = ["call 5550000 or 5550000 now 12 13", "+1 212 555-0000 and 2125550000", "", "x@y.zz x@y.zz 5550000"]
    assert P.label_texts(field, texts) == [P.label_texts(field, [t])[0] for t in texts]


def corpus(spark):
    r, out = random.Random(8), []
    for i in range(400):
        phone = f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"
        card, ip = with_checksum(r, 16), ".".join(str(r.randrange(1, 255)) for _ in range(4))
        some = [phone, card, ip, f"re.{i % 90:02}@mail{i % 7}.example.com", str(r.randrange(10_000)), f"v{r.randrange(9)}", f"{r.randrange(1900, 2030)}."]
        words = [f"word{chr(97 + r.randrange(26))}" if r.random() < 0.8 else r.choice(some) for _ in range(40)]
        out.append(("en", 1000 + i, " ".join(words).replace("word", "w"), "s", "k", "w"))
    return documents(spark, out)


def test_repeated_mentions_share_a_label(spark):
    field = P.train_pii(corpus(spark))
    assert field.skip.min() > 0
    one = "reach us at +1 (743) 555-3824 today. " + "nothing here " * 300 + "again: 743-555-3824 was the one; room 12, year 1999, 42 of 7"
    (spans,) = P.label_texts(field, [one])
    assert ("phone", 12, 29, False) in spans
    added = [one[a:b] for _, a, b, new in spans if new]
    assert added == ["743-555-3824"] and {k for k, _, _, new in spans if new} == {"phone"}
    two = "cards 4465758382889437 4465758382889437 twice"  # one match of 32 digits, which its check drops
    assert [(k, two[a:b]) for k, a, b, _ in P.label_texts(field, [two])[0]] == [("card", "4465758382889437")] * 2
    plain = "chapter 12 of 1999 has 250 pages and version 3.2 costs 17.50 or 1,000 in 2024."
    assert P.label_texts(field, [plain]) == [[]]


def test_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = {r.doc_id: r for r in Q.op11_pii(spark, sf_dir).collect()}
    assert len(got) == docs.count() and list(next(iter(got.values())).asDict())[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    for r in docs.collect():
        want, own = contract(r.text), got[r.doc_id]
        assert [own.n_email, own.n_ip, own.n_card, own.n_phone] == [len(x) for x in want]
        assert own.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        spans = own.spans.split(",") if own.spans else []
        assert set(listed(want).split(",")) - {""} <= set(spans) and len(spans) == sum(map(len, want)) + own.n_added
        order = [(P.KINDS.index(k), int(a)) for k, a, _ in (s.split(":") for s in spans)]
        assert order == sorted(order)
        if not re.search("[0-9@]", r.text or ""):
            assert own.spans == ""


def test_awkward_rows(spark):
    docs = corpus(spark)
    field = P.train_pii(docs)
    assert P.find_pii(docs, field).count() == docs.count() and P.find_pii(empty(spark), field).count() == 0
    for r in P.pii_report(docs, field).join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").filter("doc_id > 900").collect():
        assert r.base_sha256 == hashlib.sha256(listed(contract(r.text)).encode()).hexdigest()
    nothing = P.train_pii(empty(spark))
    assert nothing.index == {} and P.label_texts(nothing, ["call 5550000 5550000"]) == [[]]
    odd = spark.createDataFrame([("me@x.yy and me@x.yy", None, "é", 1), (None, "b", "é", 2), ("+1 (743) 555-3824 é +1 (743) 555-3824", "c", "é", 3)], "text string, masked string, found string, _masked int")
    out = P.mask_pii(odd, field)
    assert out.columns == odd.columns
    assert [r.text for r in out.orderBy("_masked").collect()] == ["[email] and [email]", None, "[phone] é [phone]"]
    assert [r.found for r in out.collect()] == ["é"] * 3
