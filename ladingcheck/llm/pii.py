"""Personal data: patterns with checks, and a skip-chain conditional random field over the tokens that could be such.

Tokens are runs of non-space with a digit or an @. Neighbouring tokens share a chain potential; tokens of a document that
are equal or alike (same digits, same first digits, same letters) share a skip potential with the next of their kind, so
a number that is recognised once pulls its other spellings along. Weights are learnt by pseudo-likelihood from what the
patterns find in a bounded sample; sum-product messages run a fixed number of rounds over the graph of a whole batch.
Found spans are added to those of the patterns and never replace one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field is fitted on, about; chosen by the hash of their id.
SAMPLE_DOCS = 20_000
BUCKETS = 1 << 12
#: Messages of a document go on until none changes by more than this, so evidence reaches all occurrences of a spelling.
TOLERANCE = 1e-7
#: Documents whose messages keep swinging end after as many rounds as they have tokens, or these if that is more.
ROUNDS = 200
#: Least belief of an added span.
SURE = 0.8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MAYBE = re.compile("[0-9@]")
_TOKEN = re.compile(r"[^\s]*[0-9@][^\s]*")
_NOT_DIGIT = re.compile("[^0-9]+")
_SHAPES = ((re.compile("[0-9]"), "9"), (re.compile("[a-z]+"), "a"), (re.compile("[A-Z]+"), "A"), (re.compile("[^0-9aA@.+()-]+"), "x"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = []
    if not _MAYBE.search(text):
        return out
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _feature(kind: int, value: str) -> int:
    return kind * BUCKETS + zlib.crc32(value.encode("utf-8", "surrogatepass")) % BUCKETS


def graph(text: str) -> tuple[list[tuple[int, int]], list[list[int]], list[tuple[int, int, int]]]:
    """Tokens, three features of each, and edges (token, token, 0 chain or 1 skip)."""
    tokens, features, edges, last = [], [], [], {}
    for m in _TOKEN.finditer(text):
        word, i = m.group(), len(tokens)
        shape = word
        for pattern, sign in _SHAPES:
            shape = pattern.sub(sign, shape)
        digits = _NOT_DIGIT.sub("", word)
        before = text[max(0, m.start() - 24):m.start()].split()
        features.append([_feature(0, shape), _feature(1, f"{min(len(digits), 24)} {min(len(word), 40) // 4}"),
                         _feature(2, before[-1].lower() if before else "")])
        chained = bool(tokens) and m.start() - tokens[-1][1] < 3 and not text[tokens[-1][1]:m.start()].strip(" ")
        if chained:
            edges.append((i - 1, i, 0))
        keys = {("d", digits), ("p", digits[:6])} if len(digits) >= 7 else {("w", word.strip(".,;:()").lower())}
        for key in sorted(keys):
            if (other := last.get(key)) is not None and (other, chained) != (i - 1, True):
                edges.append((other, i, 1))  # twice for numbers that are equal and so alike
            last[key] = i
        tokens.append(m.span())
    return tokens, features, edges


def _marks(tokens: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """1 + kind of the first span that overlaps a token, else 0."""
    out, k = [], 0
    for a, b in tokens:
        while k < len(spans) and spans[k][2] <= a:
            k += 1
        out.append(next((1 + s[1] for s in spans[k:k + 4] if s[0] < b and s[2] > a), 0))
    return out


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            if text and _MAYBE.search(text):
                tokens, features, edges = graph(text)
                rows.append({"features": [f for x in features for f in x], "marks": _marks(tokens, base_spans(text)),
                             "edges": [v for e in edges for v in e]})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.list_(pa.int64())) for n in (
            "features", "marks", "edges")]))


def _join(graphs: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Features and edges of several graphs as one."""
    at, features, edges = 0, [], []
    for f, e in graphs:
        features.append(f)
        if len(e):
            edges.append(e + np.array([at, at, 0]))
        at += len(f)
    return (np.concatenate(features) if features else np.zeros((0, 3), np.int64),
            np.concatenate(edges) if edges else np.zeros((0, 3), np.int64))


def fit(rows: list) -> dict[str, np.ndarray] | None:
    """Weights by gradient steps on the likelihood of each mark given its neighbours' marks."""
    rows = sorted(rows, key=lambda r: (r["features"], r["marks"], r["edges"]))
    marks = np.array([m for r in rows for m in r["marks"]], np.int64)
    if not marks.any():
        return None
    features, edges = _join([(np.array(r["features"], np.int64).reshape(-1, 3), np.array(r["edges"], np.int64).reshape(-1, 3))
                             for r in rows])
    n, k = len(marks), len(KINDS) + 1
    node, edge, bias = np.zeros((3 * BUCKETS, k)), np.zeros((2, k, k)), np.zeros(k)
    seen = [np.full(a.shape, 1e-6) for a in (node, edge, bias)]
    target = np.eye(k)[marks]
    a, b, kind = edges.T
    for _ in range(60):
        score = node[features].sum(axis=1) + bias
        np.add.at(score, b, edge[kind, marks[a]])
        np.add.at(score, a, edge[kind, :, marks[b]])
        p = np.exp(score - score.max(axis=1, keepdims=True))
        rest = target - p / p.sum(axis=1, keepdims=True)
        g_node, g_edge = np.zeros_like(node), np.zeros_like(edge)
        for j in range(3):
            np.add.at(g_node, features[:, j], rest)
        np.add.at(g_edge, (kind, marks[a]), rest[b])
        np.add.at(g_edge.transpose(0, 2, 1), (kind, marks[b]), rest[a])
        for w, g, s in ((node, g_node / n - 1e-5 * node, seen[0]), (edge, g_edge / n - 1e-5 * edge, seen[1]),
                        (bias, rest.mean(axis=0), seen[2])):
            s += g * g
            w += 0.3 * g / np.sqrt(s)
    return {"node": node, "edge": edge, "bias": bias}


def beliefs(weights: dict[str, np.ndarray], features: np.ndarray, edges: np.ndarray, sizes: list[int] | None = None) -> np.ndarray:
    """Marginals of loopy sum-product when messages have settled; one row a token. sizes: tokens of each document (of one, if None).

    A document stops by its own messages, so what it gets does not depend on the others.
    """
    own = weights["node"][features].sum(axis=1) + weights["bias"]
    a, b, kind = edges.T
    table = np.concatenate([weights["edge"][kind], weights["edge"][kind].transpose(0, 2, 1)])
    source, goal = np.concatenate([a, b]), np.concatenate([b, a])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    message = np.zeros((len(source), own.shape[1]))
    sizes = np.array([len(own)] if sizes is None else sizes, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)[source]
    active, most, rounds = np.arange(len(source)), np.maximum(sizes, ROUNDS), 0
    while len(active):
        total = own.copy()
        np.add.at(total, goal[active], message[active])
        sent = (total[source[active]] - message[back[active]])[:, :, None] + table[active]
        top = sent.max(axis=1, keepdims=True)
        new = (top + np.log(np.exp(sent - top).sum(axis=1, keepdims=True)))[:, 0]
        new = 0.5 * message[active] + 0.5 * (new - new.max(axis=1, keepdims=True))
        change = np.zeros(len(sizes))
        np.maximum.at(change, doc[active], np.abs(new - message[active]).max(axis=1))
        message[active] = new
        rounds += 1
        active = active[((change > TOLERANCE) & (rounds < most))[doc[active]]]
    total = own.copy()
    np.add.at(total, goal, message)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _added(tokens: list[tuple[int, int]], p: np.ndarray, base: list[tuple[int, int, int]], text: str) -> list[tuple[int, int, int]]:
    """Runs of neighbouring sure tokens of one kind that overlap no span of the patterns."""
    kind, taken, out = p.argmax(axis=1), _marks(tokens, base), []
    for i, (a, b) in enumerate(tokens):
        if not kind[i] or p[i, kind[i]] < SURE or taken[i]:
            continue
        last = out[-1] if out else None
        if last and last[1] == kind[i] - 1 and a - last[2] < 3 and not text[last[2]:a].strip(" "):
            out[-1] = (last[0], last[1], b)
        else:
            out.append((a, int(kind[i]) - 1, b))
    trimmed = []
    for a, k, b in out:
        while b > a and text[b - 1] in ".,;:)":
            b -= 1
        while a < b and text[a] in "(":
            a += 1
        if a < b:
            trimmed.append((a, k, b))
    return trimmed


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _finder(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, nothing = sent.value, hashlib.sha256(b"").hexdigest()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n = batch.num_rows
                counts, digest, spans = np.zeros((len(KINDS), n), np.int64), [nothing] * n, [""] * n
                base, graphs, where = {}, [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    if not text or not _MAYBE.search(text):
                        continue
                    base[i] = base_spans(text)
                    for _, k, _ in base[i]:
                        counts[k, i] += 1
                    spans[i] = _listed(base[i])
                    digest[i] = hashlib.sha256(spans[i].encode()).hexdigest()
                    if weights is not None:
                        tokens, features, edges = graph(text)
                        graphs.append((np.array(features, np.int64).reshape(-1, 3), np.array(edges, np.int64).reshape(-1, 3)))
                        where.append((i, tokens, text))
                if graphs:
                    p, row = beliefs(weights, *_join(graphs), [len(f) for f, _ in graphs]), 0
                    for i, tokens, text in where:
                        more = _added(tokens, p[row:row + len(tokens)], base[i], text)
                        row += len(tokens)
                        if more:
                            spans[i] = _listed(base[i] + more)
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id"), **{f"n_{k}": pa.array(c) for k, c in zip(KINDS, counts)},
                    "base_sha256": pa.array(digest), "spans": pa.array(spans)})

    return run


def find_pii(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row; null text counts as empty.

    spans lists kind:start:end (code points, end exclusive) of the patterns and the field, base_sha256 stands for those of
    the patterns alone. Without any pattern in the sample there is no field and nothing is added. Repeated rows and null
    ids are answered row by row; only doc_id and text are read.
    """
    docs = documents.select("doc_id", "text")
    n = docs.count()
    share = 1 << 20 if n <= sample_docs else max(1, (1 << 20) * sample_docs // n)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    lists = ", ".join(f"{c} array<long>" for c in ("features", "marks", "edges"))
    weights = fit(sample.select("text").mapInArrow(_observed, lists).collect())
    sent = documents.sparkSession.sparkContext.broadcast(weights)
    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    id_type = documents.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_finder(sent), f"doc_id {id_type}, {kinds}, base_sha256 string, spans string")
