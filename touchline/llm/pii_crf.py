"""Operator 11: personal data by patterns, and by a skip-chain conditional random field beside them.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers.  The field labels words: each word that
holds a digit or an at sign is a node (every other word is labelled "none" and parts the chain).  Nodes have unary
potentials from the word's shape and its neighbours, neighbouring nodes share a transition potential, and distant nodes
that repeat each other (the same number or address, or the same last seven digits) share a skip potential that pulls
them to one label.  Words inside a pattern's span are clamped to its kind, so that its later mentions in another form
are labelled alike.  Loopy belief propagation passes all messages of a document at once, ROUNDS times.

The potentials are fitted here, on SAMPLE documents with nodes (by the order of a text hash, copies once) and at most
TOKENS neighbouring nodes of each: words in spans bear the kind, words in matches that a check drops (a wrong checksum,
too many digits) are hidden, all others are labelled "none".  The gradient is the difference of the expected features with and
without those labels.

Every text is searched whole and by itself: scoring has no shuffle, and memory in a task follows the longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import claim_worker, free_names, text_chunks

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0 is "none"
SAMPLE, TOKENS = 1500, 200
ROUNDS, STEPS, RATE = 10, 120, 0.1
#: Marginal probability from which a word is labelled.
SURE = 0.8
#: Ridge of all potentials, and what skip potentials are pulled to: repeated words tend to one label.
RIDGE, SKIP_PRIOR, SKIP_RIDGE = 2e-4, 6.0, 1e-2
#: A repeated number links words if it has so many digits.
LEAST_DIGITS, SAME_TAIL = 5, 7
CLAMP = 40.0
HINT = "[0-9@]"

# ---------------------------------------------------------------------------------------------------------------
# patterns

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """The local part is the run of its characters before the at sign, back to the span before."""
    out, done = [], 0
    for m in _DOMAIN.finditer(text):
        a = m.start()
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            out.append((a, m.end()))
            done = m.end()
    return out


def _addresses(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chains of dotted numbers, taken four by four: the leftmost matches that do not overlap."""
    found, dropped = [], []
    for m in _CHAIN.finditer(text):
        if m.group().count(".") < 3:
            continue
        at, parts = m.start(), m.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            small = all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four)
            (found if small else dropped).append((at, end))
            at = end + 1
    return found, dropped


def patterns(text: str) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int]]]:
    """Spans of each kind, and the matches that a check dropped.  Linear in the text."""
    ips, dropped = _addresses(text)
    cards, phones = [], []
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        (cards if 13 <= len(d) <= 19 and luhn(d) else dropped).append(m.span())
    for m in _PHONE.finditer(text):
        (phones if 9 <= len(_digits(m.group())) <= 15 else dropped).append(m.span())
    return [_emails(text), ips, cards, phones], dropped


# ---------------------------------------------------------------------------------------------------------------
# nodes

_OUTER = "#*$%&|<>,;:!?\"'.-_=/\\[]{}"
_RUN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)


def shape(word: str) -> str:
    """Digits as 9 and their number, letters as a, other characters themselves."""
    parts = [f"9{min(len(p), 20)}" if "0" <= p[0] <= "9" else "a" if p[0].isalpha() else p for p in _RUN.findall(word[:64])]
    return "".join(parts)[:24]


class Nodes:
    """The nodes of one text: places, features, labels known (-1: unknown), and links."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        ink = ~((points == 32) | ((points >= 9) & (points <= 13)))
        edge = np.diff(np.concatenate([[False], ink, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        seen = np.concatenate([[0], np.cumsum(((points >= 48) & (points <= 57)) | (points == 64))])
        self.word = np.flatnonzero(seen[ends] > seen[starts])
        self.start, self.end = starts[self.word].tolist(), ends[self.word].tolist()
        self.words = [text[a:b] for a, b in zip(self.start, self.end, strict=True)]
        self.spans, self.dropped = patterns(text)
        self._text, self._starts, self._ends = text, starts, ends

    def __len__(self) -> int:
        return len(self.words)

    def features(self, k: int) -> list[str]:
        core = self.words[k].strip(_OUTER)
        n = _digits(core)
        out = ["bias", "shape " + shape(core), f"digits {min(len(n), 20)}"]
        if 13 <= len(n) <= 19 and luhn(n):
            out.append("luhn")
        if "@" in core:
            out.append("at" + "." * ("." in core.partition("@")[2]))
        if core.count(".") == 3 and _addresses(core)[0] == [(0, len(core))]:
            out.append("four parts")
        i = self.word[k]
        for name, j in (("before ", i - 1), ("after ", i + 1)):
            if 0 <= j < len(self._starts):
                word = self._text[self._starts[j] : min(self._ends[j], self._starts[j] + 40)].strip(_OUTER)
                out.append(name + (shape(word) if re.search(HINT, word) else word.lower()[:12]))
            else:
                out.append(name)
        return out

    def _touched(self, spans: list[tuple[int, int]]) -> Iterator[int]:
        k = 0
        for a, b in sorted(spans):
            while k < len(self.end) and self.end[k] <= a:
                k += 1
            j = k
            while j < len(self.start) and self.start[j] < b:
                yield j
                j += 1

    def known(self, open_label: int) -> np.ndarray:
        """Labels of words in spans (the first kind that holds them); others are ``open_label``."""
        out = np.full(len(self), open_label, np.int64)
        for kind in range(len(KINDS), 0, -1):
            for j in self._touched(self.spans[kind - 1]):
                out[j] = kind
        return out

    def training_labels(self) -> np.ndarray:
        out = self.known(0)
        for j in set(self._touched(self.dropped)):
            if out[j] == 0:
                out[j] = -1
        return out

    def chain(self) -> list[tuple[int, int]]:
        return [(k, k + 1) for k in np.flatnonzero(np.diff(self.word) == 1).tolist()]

    def skips(self) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Links to the last word that was the same, and to the last one with the same tail of digits: linear in the nodes."""
        same, alike, last = [], [], {}
        for k, word in enumerate(self.words):
            core = word.strip(_OUTER).lower()
            n = _digits(core)
            if "@" not in core and len(n) < LEAST_DIGITS:
                continue
            twin = last.get(core)
            if twin is not None:
                same.append((twin, k))
            last[core] = k
            if len(n) >= SAME_TAIL:
                tail = ("tail", n[-SAME_TAIL:])
                other = last.get(tail)
                if other is not None and other != twin:
                    alike.append((other, k))
                last[tail] = k
        return same, alike


# ---------------------------------------------------------------------------------------------------------------
# the field


class Graph:
    """Nodes and links of several texts, one behind the other.  Edge kinds: 0 chain, 1 same, 2 alike."""

    def __init__(self) -> None:
        self.n, self._u, self._v, self._kind, self._node, self._feature = 0, [], [], [], [], []
        self.known: list[np.ndarray] = []

    def add(self, features: list[list[int]], known: np.ndarray, chain: list, same: list, alike: list) -> None:
        for k, own in enumerate(features):
            self._node += [self.n + k] * len(own)
            self._feature += own
        for kind, links in enumerate((chain, same, alike)):
            for u, v in links:
                self._u.append(self.n + u)
                self._v.append(self.n + v)
                self._kind.append(kind)
        self.known.append(known)
        self.n += len(features)

    def close(self) -> Graph:
        self.u, self.v, self.kind = (np.array(x, np.int64) for x in (self._u, self._v, self._kind))
        self.node, self.feature = np.array(self._node, np.int64), np.array(self._feature, np.int64)
        self.labels = np.concatenate(self.known) if self.known else np.zeros(0, np.int64)
        return self


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Field:
    """unary: weight of each feature and label; trans: of neighbouring labels; skip: of equal labels, by kind of link."""

    def __init__(self, names: list[str]) -> None:
        self.index = {f: i for i, f in enumerate(names)}
        self.unary, self.trans, self.skip = np.zeros((len(names), LABELS)), np.zeros((LABELS, LABELS)), np.full(2, SKIP_PRIOR)

    def ids(self, features: list[str]) -> list[int]:
        return [i for f in features if (i := self.index.get(f)) is not None]

    def pair(self, kind: np.ndarray) -> np.ndarray:
        return np.stack([self.trans, self.skip[0] * np.eye(LABELS), self.skip[1] * np.eye(LABELS)])[kind]

    def beliefs(self, g: Graph, clamped: bool) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of nodes and of edges after ROUNDS of messages along all edges, both ways at once."""
        unary = np.zeros((g.n, LABELS))
        np.add.at(unary, g.node, self.unary[g.feature])
        if clamped:
            fixed = np.flatnonzero(g.labels >= 0)
            unary[fixed] -= CLAMP
            unary[fixed, g.labels[fixed]] += CLAMP
        pair = self.pair(g.kind)
        source, target = np.concatenate([g.u, g.v]), np.concatenate([g.v, g.u])
        both = np.concatenate([pair, pair.transpose(0, 2, 1)])
        e = len(g.u)
        back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
        messages = np.zeros((2 * e, LABELS))
        total = unary.copy()
        for _ in range(ROUNDS if e else 0):
            out = total[source] - messages[back]
            messages = _lse(out[:, :, None] + both, 1)
            messages -= _lse(messages, 1)[:, None]
            total = unary.copy()
            np.add.at(total, target, messages)
        nodes = np.exp(total - _lse(total, 1)[:, None]) if g.n else total
        if not e:
            return nodes, np.zeros((0, LABELS, LABELS))
        joint = pair + (total[g.u] - messages[e:])[:, :, None] + (total[g.v] - messages[:e])[:, None, :]
        joint = joint.reshape(e, -1)
        return nodes, np.exp(joint - _lse(joint, 1)[:, None]).reshape(e, LABELS, LABELS)

    def fit(self, g: Graph) -> Field:
        """Adam on the likelihood of the known labels (hidden ones are summed out), with ridges.  The same sample gives the same potentials."""
        params = [self.unary, self.trans, self.skip]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        scale = max(1, g.n)
        for step in range(1, STEPS + 1 if g.n else 1):
            (n1, e1), (n0, e0) = self.beliefs(g, True), self.beliefs(g, False)
            up = np.zeros_like(self.unary)
            np.add.at(up, g.feature, (n1 - n0)[g.node])
            more = e1 - e0
            equal = np.trace(more, axis1=1, axis2=2)
            skips = np.array([equal[g.kind == k].sum() for k in (1, 2)])
            grads = [up / scale - RIDGE * self.unary, more[g.kind == 0].sum(0) / scale - RIDGE * self.trans, skips / scale - SKIP_RIDGE * (self.skip - SKIP_PRIOR)]
            for k, x in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.999 * v[k] + 0.001 * x * x
                params[k] += RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _hinted(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(text.alias("text")).filter(F.col("text").rlike(HINT)).withColumn("h", F.xxhash64("text"))


_EXAMPLE = "h long, features array<array<string>>, labels array<int>, chain array<array<int>>, same array<array<int>>, alike array<array<int>>"


def train_pii(docs: DataFrame, text_col: str = "text") -> Field:
    """A field fitted to at most SAMPLE texts of the table.  Without texts that hold nodes it labels nothing."""
    spark, hinted = docs.sparkSession, _hinted(docs, text_col)
    drawn = [r.h for r in hinted.select("h").distinct().orderBy("h").limit(SAMPLE).collect()]  # bounded by SAMPLE
    if not drawn:
        return Field([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("pii")
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nodes = Nodes(text)
                low = max(0, min(h % max(1, len(nodes)), len(nodes) - TOKENS))
                high = min(len(nodes), low + TOKENS)
                inside = lambda links: [[u - low, v - low] for u, v in links if low <= u and v < high]  # noqa: E731, B023
                same, alike = nodes.skips()
                row = {"h": h, "features": [nodes.features(k) for k in range(low, high)], "labels": nodes.training_labels()[low:high].tolist(), "chain": inside(nodes.chain()), "same": inside(same), "alike": inside(alike)}
                yield pa.RecordBatch.from_pylist([row], schema)

    pairs = pa.list_(pa.list_(pa.int32()))
    schema = pa.schema([("h", pa.int64()), ("features", pa.list_(pa.list_(pa.string()))), ("labels", pa.list_(pa.int32())), ("chain", pairs), ("same", pairs), ("alike", pairs)])
    mine = F.broadcast(spark.createDataFrame([(h,) for h in drawn], "h long"))  # at most SAMPLE numbers
    examples = hinted.join(mine, "h").dropDuplicates(["h"]).select("h", "text").mapInArrow(run, _EXAMPLE).collect()  # at most SAMPLE * TOKENS nodes
    examples.sort(key=lambda r: r.h)
    count: dict[str, int] = {}
    for r in examples:
        for own in r.features:
            for f in own:
                count[f] = count.get(f, 0) + 1
    field, graph = Field(sorted(f for f, n in count.items() if n > 1)), Graph()
    for r in examples:
        graph.add([field.ids(own) for own in r.features], np.array(r.labels, np.int64), r.chain, r.same, r.alike)
    return field.fit(graph.close())


# ---------------------------------------------------------------------------------------------------------------
# spans

_CORE = {
    1: re.compile(r"[A-Za-z0-9].*[A-Za-z0-9]", re.S),
    2: re.compile(r"[0-9].*[0-9]", re.S),
    3: re.compile(r"[0-9].*[0-9]", re.S),
    4: re.compile(r"[+(0-9].*[0-9)]", re.S),
}
#: Kinds whose spans may take several words, and the most digits they may have.
_SEVERAL = {3: 19, 4: 15}


def added_spans(nodes: Nodes, labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of labelled words outside the patterns' spans; neighbouring parts of a number are one span."""
    out: list[list[int]] = []
    taken = sorted(s for spans in nodes.spans for s in spans)
    for k, kind in enumerate(labels.tolist()):
        if not kind:
            continue
        m = _CORE[kind].search(nodes.words[k])
        if m is None:
            continue
        a, b, n = nodes.start[k] + m.start(), nodes.start[k] + m.end(), len(_digits(m.group()))
        if out and out[-1][0] == kind and out[-1][3] == nodes.word[k] - 1 and out[-1][4] + n <= _SEVERAL.get(kind, 0):
            out[-1][2:] = [b, int(nodes.word[k]), out[-1][4] + n]
        else:
            out.append([kind, a, b, int(nodes.word[k]), n])
    spans, at = [], 0
    for kind, a, b, _, _ in out:
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if all(y <= a or x >= b for x, y in taken[max(0, at - 2) : at + 3]):
            spans.append((kind, a, b))
    return spans


def label_texts(field: Field, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, added) of each text's spans, by kind and start."""
    every, graph = [Nodes(t) for t in texts], Graph()
    for nodes in every:
        graph.add([field.ids(nodes.features(k)) for k in range(len(nodes))], nodes.known(-1), nodes.chain(), *nodes.skips())
    marginals, _ = field.beliefs(graph.close(), True)
    out, a = [], 0
    for nodes in every:
        own, known = marginals[a : a + len(nodes)], graph.labels[a : a + len(nodes)]
        a += len(nodes)
        best = own[:, 1:].argmax(1) + 1 if len(own) else np.zeros(0, np.int64)
        sure = np.where((own[np.arange(len(own)), best] >= SURE) & (known < 0), best, 0)
        spans = [(k, x, y, False) for k, s in enumerate(nodes.spans) for x, y in s]
        spans += [(k - 1, x, y, True) for k, x, y in added_spans(nodes, sure)]
        out.append([(KINDS[k], x, y, new) for k, x, y, new in sorted(spans)])
    return out


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))


def _found(field: Field, column: pa.Array) -> Iterator[pa.Array]:
    """Spans of the texts of a column, step by step; texts without digit or at sign have none."""
    column = column.fill_null("")
    hinted = pc.match_substring_regex(column, HINT).to_numpy(zero_copy_only=False)
    for a, b, _, _ in text_chunks(column):
        out: list[list] = [[] for _ in range(b - a)]
        own = np.flatnonzero(hinted[a:b])
        if len(own):
            texts = column.slice(a, b - a).take(pa.array(own)).to_pylist()
            for k, spans in zip(own.tolist(), label_texts(field, texts), strict=True):
                out[k] = [{"kind": kind, "start": x, "end": y, "added": new} for kind, x, y, new in spans]
        yield pa.array(out, _FOUND)


def find_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found, an array of (kind, start, end, added) by kind and start, of every row; places are code points, ends exclusive.

    ``added`` spans come from the field, the others from the patterns.  Null, empty and blank texts have none.  Repeated rows
    and rows with null ids are searched each, very long texts whole; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # at most the features of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("pii")
        for batch in batches:
            row = 0
            for found in _found(shared.value, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(found)), found], ["doc_id", "found"])
                row += len(found)

    bare = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bare.mapInArrow(run, "doc_id long, found array<struct<kind: string, start: long, end: long, added: boolean>>")


def mask_pii(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows with all their columns; each span of the text is replaced by its kind in brackets, a word for a kind.

    Null texts stay null; columns may have any names; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf("string")
    def masked(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        claim_worker("pii")
        for column in columns:
            spans = [s for found in _found(shared.value, column) for s in found.to_pylist()]
            yield pa.array([None if t is None else mask(t, s) for t, s in zip(column.to_pylist(), spans, strict=True)], pa.string())

    (name,) = free_names(docs, "masked")
    made = docs.withColumn(name, masked(F.col(text_col).cast("string")))
    return made.select(*[F.col(name).alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in docs.columns])


def mask(text: str, spans: list[dict]) -> str:
    """Spans of several kinds may overlap; what they cover together is named by the one that starts first."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["end"] <= at:
            continue
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        at = s["end"]
    return "".join([*out, text[at:]])


def listed(found: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def pii_report(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts and digest of the patterns' spans, all spans as a string, n_added."""
    found = find_pii(docs, field, id_col, text_col)
    base = F.filter("found", lambda s: ~s["added"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    added = (F.size("found") - F.size("base")).cast("long").alias("n_added")
    return found.withColumn("base", base).select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), added)
