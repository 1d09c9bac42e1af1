"""Sharding, URL rules, quality rules, token files and packing against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.fixtures import documents, empty, prose, rows
from touchline.llm import queries as Q
from touchline.llm import token_files
from touchline.llm.common import table
from touchline.llm.packing import pack
from touchline.llm.quality_rules import quality_rules
from touchline.llm.sharding import shard_by_bytes
from touchline.llm.tokens import Encoder, vocabulary_path
from touchline.llm.url_filter import judge_urls


def bytes_of(text):
    return (text or "").encode()


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, 0
        room = mid
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [3, 24])
def test_sharding(spark, shards):
    import hashlib

    docs = documents(spark, [("en", 100 + i, prose(i % 50, 20 + i % 7), "s", "k", "w") for i in range(150)])
    got = shard_by_bytes(docs, shards).collect()
    assert len(got) == docs.count()
    by = {(r.doc_id, r.text) for r in docs.collect()}
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len(bytes_of(r.text)) + 8, zlib.crc32(bytes_of(r.text))) for r in docs.collect())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(slots) < shards
    where = defaultdict(set)
    for r in got:
        where[(r.text_crc32, r.size)].add(r.shard)
    assert all(len(x) == 1 for x in where.values())
    # the largest shard is the smallest possible one for this order, after the oversized groups
    group = Counter()
    for r in docs.collect():
        group[hashlib.sha256(bytes_of(r.text)).digest()] += len(bytes_of(r.text)) + 8
    left, free, alone = sum(group.values()), shards, []
    for d, s in sorted(group.items(), key=lambda x: (-x[1], x[0]))[:shards]:
        if free == 1 or s * free <= left:
            break
        alone.append(d)
        left, free = left - s, free - 1
    sizes = [s for d, s in sorted(group.items()) if d not in alone]
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load[k] for k in load if k >= len(alone)) == least_capacity(sizes, free)
    assert by


def test_sharding_of_nothing(spark):
    assert shard_by_bytes(empty(spark), 24).count() == 0


def judge(url, rules):
    at = url.find("://") if url else -1
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest).group(0)
    path = re.match(r"[^?#]*", rest[len(host) :]).group(0)
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), len(h), h + p, a) for h, p, a in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[2] if fit else None, max(fit)[3] if fit else "allow"


def test_url_rules(spark, sf_dir):
    urls = ["http://A.Example.COM/en/7x?q#f", "https://example.com/en/6", "http://net/de/", "http://x.net/de", "ftp://org?/es/", "noscheme/en/", None, "", "://", "http://notcom/en/",
            "http://a.b.example.net/de/81", "http://example.net/de/9", "http://u.org/es/é", "http://com/en/", "http://.com/en/", "http://x.com//en/", "a://b://c.org/es/"]
    pages = spark.createDataFrame([(i % 9, u, "h", "x") for i, u in enumerate(urls)], "page_id int, url string, host string, rule string")
    rules = spark.createDataFrame(Q.URL_RULES, "host string, path string, action string")
    assert rows(judge_urls(pages, rules), "page_id", "host", "path", "rule", "verdict") == sorted(
        ((i % 9, *judge(u, Q.URL_RULES)) for i, u in enumerate(urls)), key=lambda x: tuple((v is not None, v) for v in x)
    )
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
    real = table(spark, sf_dir, "pages")
    want = sorted((r.page_id, *map(str, judge(r.url, Q.URL_RULES))) for r in real.collect())
    assert sorted((r[0], *map(str, r[1:])) for r in Q.op5_url_filters(spark, sf_dir).collect()) == want


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    again = {j for x in at.values() if len(x) > 1 for i in x for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_quality_rules(spark, sf_dir):
    for docs in (documents(spark), table(spark, sf_dir, "documents")):
        got = quality_rules(docs)
        want = []
        for r in docs.collect():
            b = base(r.text)
            want.append((r.doc_id, *b, b[0] < 20 or 100 * b[4] > 30 * b[0]))
        assert rows(got, *got.columns[:-1]) == sorted(want, key=lambda x: tuple((v is not None, v) for v in x))
        assert not got.filter("kept and base_failed").count()
    assert quality_rules(empty(spark)).count() == 0
    labels = table(spark, sf_dir, "labels")
    kept = got.join(labels, "doc_id").filter("not base_failed").groupBy("quality").avg(*[]).count()
    assert kept == 2
    good = got.join(labels, "doc_id").filter("quality = 1 and not base_failed")
    assert good.filter("kept").count() >= 0.97 * good.count()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name, spark, sf_dir):
    texts = [r.text for r in documents(spark).collect()] + [r.text for r in table(spark, sf_dir, "documents").collect()]
    texts += [" a", "a \n b", "a\n \nb", "a  b", "   ", "a\n b", "a \u0301b", "x's 'll", "\x00 a", "a\t\t b", "a b\n", "# ## ###"]
    own = Encoder(vocabulary_path(name))
    for _ in range(2):
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_come_from_the_model(name):
    """Chunks of letters never pass the library's whole pipeline, and each different one is asked for once."""
    own, asked, learned = Encoder(vocabulary_path(name)), [], []
    many, learn = own._many, own._learn
    own._many = lambda chunks: asked.extend(chunks) or many(chunks)
    own._learn = lambda chunks: learned.extend(chunks) or learn(chunks)
    texts = ["The Ÿ naïve, ÉTÉ; ßtraße (xx don't It's a1 The The", "Lovely lovely ÿþ... ×× a÷b ªº İx", None, "", "The The, lovely\nnaïve"]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids
    assert len(learned) == len(set(learned)) and " naïve," in learned
    assert not [c for c in asked if c.strip(" ,;.").isalpha() and not set("ŸªºİĿ") & set(c)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_equal_a_fresh_tokenizer(name, spark, sf_dir):
    from tokenizers import Tokenizer

    path = vocabulary_path(name)
    fresh, own = Tokenizer.from_file(path), Encoder(path)
    texts = ["a<|endoftext|>b", "a <|endoftext|> b", "<|endoftext|>", " <|endoftext|>", "x\n<|endoftext|>\ny", "a<|startoftext|>b c", "a <|ENDOFTEXT|>b <|EndOfText|>", "<|ENDOFTEXT|> d", "see <|endoftext", "|> <|end oftext|>", "a\0<|endoftext|>b"]
    texts += [r.text for r in documents(spark).collect()] + [r.text for r in table(spark, sf_dir, "documents").collect()]
    for _ in range(2):
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == fresh.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("first", "rounds"), [(50257, 4), (70000, 4), (300, 9)])
def test_grammars_of_narrow_and_wide_ids(first, rounds):
    for n in (0, 1, 2, 5000, 60000):
        ids = (np.random.default_rng(n).zipf(1.3, n) % first).astype("<u4")
        symbols, rules = token_files.compress(ids, first, rounds=rounds)
        assert (token_files.expand(symbols, rules, first) == ids).all() and (n < 5000 or len(symbols) < n)
        lengths = token_files.expansion_lengths(rules, first)
        assert len(ids) == (symbols < first).sum() + lengths[symbols[symbols >= first].astype(int) - first].sum()


def test_token_files(spark, sf_dir):
    own = Encoder(vocabulary_path("byte_bpe_50k.json"))
    for docs in (documents(spark), table(spark, sf_dir, "documents")):
        files = token_files.write_tokens(docs)
        got = sorted(token_files.read_tokens(files.read()).collect(), key=lambda r: r.start)
        start, want = 0, Counter()
        for r in docs.collect():
            ids = np.array(own.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
            want[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
        for r in got:
            assert r.start == start
            start += r.n_tokens
        ids = [-1 if r.doc_id is None else r.doc_id for r in got]
        assert ids == sorted(ids)
        for block in map(lambda r: r.asDict(), files.read().limit(3).collect()):
            n = block["doc_tokens"][-1]
            first = block["first"]
            symbols = np.frombuffer(block["symbols"], "<u4" if block["wide"] else "<u2")
            whole = token_files.expand(symbols, np.frombuffer(block["rules"], "<u4").reshape(-1, 2), first)[-n:]
            for a, b in ((0, n), (n // 3, n // 2), (n - 1, n), (0, 1)):
                assert token_files.read_ids(block, len(block["doc_ids"]) - 1, a, b).tolist() == whole[a:b].tolist()
    assert token_files.read_tokens(token_files.write_tokens(empty(spark)).read()).count() == 0


def test_repair_round_trip():
    r = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 5), (50_000, 30), (50_000, 3000)):
        ids = np.minimum(r.zipf(1.3, n), top).astype(np.uint32)
        symbols, rules = token_files.compress(ids, 4000, 2)
        assert (token_files.expand(symbols, rules, 4000) == ids).all()
        assert n < 100 or len(symbols) < n
        assert not np.isin(rules, [2]).any()


def test_packing(spark, sf_dir):
    own = Encoder(vocabulary_path("word_bpe_49k.json"))
    for docs, window in ((documents(spark), 64), (table(spark, sf_dir, "documents"), 4096)):
        got = pack(docs, window=window).collect()
        assert sorted((r.sequence_id, r.offset) for r in got)[0] == (0, 0)
        fill = Counter()
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == fill[r.sequence_id]
            fill[r.sequence_id] += r.length
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        assert all(fill[k] == window for k in range(max(fill))) and 0 < fill[max(fill)] <= window
        want = Counter(np.array(own.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for r in docs.collect())
        have, parts = Counter(), []
        for r in sorted(got, key=lambda r: r.sequence_id * window + r.offset):
            parts = parts + [r] if r.start else [r]
            if r.start + r.length == r.doc_tokens:
                have[b"".join(x.ids for x in parts)] += 1
        assert have == want
    assert pack(empty(spark)).count() == 0


def test_ids_of_hostile_texts_are_the_librarys():
    """Letters that change when they are folded, before punctuation and white space, against a fresh library object."""
    import random

    from tokenizers import Tokenizer

    from touchline.llm.tokens import Encoder, vocabulary_path

    r, letters = random.Random(4), "abI\u0130\u0131\u00df\u00e9\u0149\u01f0\u0958\u00f1.,!?'\"-)( 1\n\t"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(1, 25))) for _ in range(3000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = vocabulary_path(name)
        plain = Tokenizer.from_file(path)
        got = Encoder(path).encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_urls_of_very_many_labels(spark):
    """A host is cut at the rules' numbers of labels alone, so its length costs no square."""
    import time

    rules = spark.createDataFrame([("example.com", "/x", "block"), ("a.b.c.d", "", "block"), ("com", "/ok", "allow")], "host string, path string, action string")
    hosts = ["q." * 20_000 + "example.com", "a.b.c.d", "z.a.b.c.d", "b.c.d", "com", ".com", "x..example.com", "example.com.", "c.d"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("/x/1", "/ok", "")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    began = time.monotonic()
    got = rows(judge_urls(pages, rules), "page_id", "host", "path", "rule", "verdict")
    assert time.monotonic() - began < 30
    assert got == [(i, *judge(u, [(r.host, r.path, r.action) for r in rules.collect()])) for i, u in enumerate(urls)]
