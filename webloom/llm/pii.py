"""Personal data: fixed patterns, and a skip-chain conditional random field.

The patterns give base spans. The field labels the tokens of a document that hold a digit
or an at sign: neighbours share a potential along the chain, and tokens with the same
digits or the same address share one however far apart they are, so that a mention in
another form takes the label that the document gives elsewhere. Loopy sum-product message
passing gives each token's marginals. The weights are learned by pseudo-likelihood from
sequences made by rule.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: A token's marginal that is needed for a span of the field's own.
CERTAIN = 0.9
#: Messages are passed until they change less; where loops keep them from settling, for so many rounds and
#: three for each token.
SETTLED, ROUNDS = 1e-6, 100

# The base patterns. Look-behinds only save work: a match cannot begin inside
# a run of its first class, other than right where the match before it ended.
_LOCAL = "A-Za-z0-9._%+-"
_EMAIL = re.compile(rf"[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_FROM_START = re.compile(rf"(?<![{_LOCAL}])[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NODE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while at <= len(text) and text.find("@", at) >= 0:
        m = (_EMAIL.match(text, at) if at else None) or _EMAIL_FROM_START.search(text, at)
        if m is None:
            return
        yield m.span()
        at = m.end()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, in order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def key(token: str) -> str:
    """What similar mentions share: seven digits or more, or an address without case and edges; else nothing."""
    if "@" in token:
        return token.strip(".,;:()<>[]\"'").lower()
    digits = _digits(token)
    return digits if len(digits) >= 7 and sum(c.isalpha() for c in token) <= 2 else ""


FEATURES = 20


def features(token: str, base: int) -> np.ndarray:
    """A token's own features; ``base`` is the kind of the base span it lies in, or -1."""
    digits, letters = sum("0" <= c <= "9" for c in token), sum(c.isalpha() for c in token)
    out = np.zeros(FEATURES)
    out[0] = 1
    if base >= 0:
        out[1 + base] = 1
    else:
        out[5] = 1
    out[6] = "@" in token
    out[7] = bool(re.search(r"@[A-Za-z0-9-]+\.[A-Za-z]", token))
    out[8] = token.count(".") == 3 and letters == 0
    out[9] = digits <= 4
    out[10] = 5 <= digits <= 9
    out[11] = 10 <= digits <= 13
    out[12] = 14 <= digits <= 19
    out[13] = digits > 19
    out[14] = letters > 0
    out[15] = letters > digits
    out[16] = token[:1] == "+"
    out[17] = token[:1] == "("
    out[18] = bool(re.search(r"[0-9]-[0-9]", token))
    out[19] = 14 <= digits <= 19 and luhn(_digits(token))
    return out


class Graph:
    """A document's tokens with a digit or an at sign, and the edges between them."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]) -> None:
        self.places = [m.span() for m in _NODE.finditer(text)]
        tokens = [text[a:b] for a, b in self.places]
        base, names, k, named = [], [], 0, -1
        for (a, b), token in zip(self.places, tokens, strict=True):
            while k < len(spans) and spans[k][2] <= a:
                k += 1
            inside = k < len(spans) and spans[k][0] < b
            base.append(spans[k][1] if inside else -1)
            # The first token of a base span stands for all of it.
            names.append([key(token), key(text[spans[k][0] : spans[k][2]]) if inside and named != k else ""])
            named = k if inside else named
        self.base = base
        self.x = np.stack([features(t, y) for t, y in zip(tokens, base, strict=True)]) if tokens else np.zeros((0, FEATURES))
        # All equal mentions are joined to one of them, the first in a base span if there is one: no
        # mention is more than two edges from another, and the edges grow with the text.
        edges, hub = [], {}
        for i in sorted(range(len(base)), key=lambda i: base[i] < 0):
            for name in {*names[i]} - {""}:
                hub.setdefault(name, i)
        for i, (a, _) in enumerate(self.places):
            if i and not text[self.places[i - 1][1] : a].strip():
                edges.append((i - 1, i, 0))
            for name in {*names[i]} - {""}:
                if hub[name] != i:
                    edges.append((hub[name], i, 1))
        self.edges = np.array(edges, dtype=np.int64).reshape(-1, 3)


def _samples(n: int = 500, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Sequences made by rule: (text, label of each token with a digit or an at sign)."""
    r = random.Random(seed)
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))

    def card() -> str:
        d = r.choice("345") + number(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def mention(kind: str, held: str, base: bool) -> str:
        if kind == "email":
            return held if base else r.choice([held.upper() + ",", "<" + held + ">", held + ";"])
        if kind == "ip":
            return held if base else r.choice([held + ":8080", held + "/24"])
        if kind == "card":
            return held if base else r.choice([".".join(held[i : i + 4] for i in range(0, 16, 4)), "_".join(held[i : i + 4] for i in range(0, 16, 4))])
        return "+" + held if base else r.choice([held, "00" + held, "tel:" + held])

    out = []
    for _ in range(n):
        parts: list[tuple[str, str]] = []
        for _ in range(r.randint(1, 4)):
            kind = r.choice(KINDS)
            held = {"email": lambda: f"{word()}.{number(2)}@{word()}.com", "ip": lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), "card": card, "phone": lambda: r.choice("123456789") + number(r.randint(9, 11))}[kind]()
            parts.append((mention(kind, held, True), kind))
            parts += [(mention(kind, held, r.random() < 0.4), kind) for _ in range(r.randint(0, 2))]
        for _ in range(r.randint(2, 8)):
            parts.append((r.choice([number(r.randint(1, 6)), str(r.randint(1900, 2030)), number(r.randint(7, 19)), f"v{number(1)}.{number(1)}", f"{number(2)},{number(3)}", f"{word()}{number(2)}", hashlib.md5(number(9).encode()).hexdigest(), f"@{word()}", f"{number(2)}:{number(2)}", f"{number(4)}-{number(2)}-{number(2)}"]), "none"))
        r.shuffle(parts)
        text, labels = [], []
        for said, kind in parts:
            text += [word() for _ in range(r.randint(0, 3))] + [said]
            labels += [kind] * len(_NODE.findall(said))
        out.append((" ".join(text), labels))
    return out


@cache
def model(rounds: int = 150, rate: float = 2.0, penalty: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """(token weights, edge weights [chain or skip, label, label]) by pseudo-likelihood."""
    xs, ys, edges, n = [], [], [], 0
    for text, labels in _samples():
        g = Graph(text, base_spans(text))
        if len(g.places) != len(labels):
            continue
        xs.append(g.x)
        ys += [LABELS.index(y) for y in labels]
        edges.append(g.edges + np.array([n, n, 0]))
        n += len(labels)
    x, y, e = np.concatenate(xs), np.array(ys), np.concatenate(edges)
    k = len(LABELS)
    target = np.eye(k)[y]
    w, v = np.zeros((FEATURES, k)), np.zeros((2, k, k))
    mw, mv = np.zeros_like(w), np.zeros_like(v)
    for _ in range(rounds):
        odds = x @ w
        for a, b in ((0, 1), (1, 0)):
            np.add.at(odds, e[:, a], v[e[:, 2], :, y[e[:, b]]])
        p = np.exp(odds - odds.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gap = target - p
        gv = np.zeros_like(v)
        for a, b in ((0, 1), (1, 0)):
            np.add.at(gv, (e[:, 2], slice(None), y[e[:, b]]), gap[e[:, a]])
        gv = (gv + gv.transpose(0, 2, 1)) / 2
        mw = 0.9 * mw + x.T @ gap / n * 5 - penalty * w
        mv = 0.9 * mv + gv / n * 5 - penalty * v
        w, v = w + rate * mw * 0.1, v + rate * mv * 0.1
    return w, v


def marginals(g: Graph, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Each token's label marginals by damped loopy sum-product message passing, to convergence."""
    n, k = len(g.places), len(LABELS)
    own = g.x @ w
    m = len(g.edges)
    if m:
        a = np.concatenate([g.edges[:, 0], g.edges[:, 1]])
        b = np.concatenate([g.edges[:, 1], g.edges[:, 0]])
        pair = v[np.concatenate([g.edges[:, 2], g.edges[:, 2]])]
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        sent = np.zeros((2 * m, k))
        for _ in range(ROUNDS + 3 * n):
            belief = own.copy()
            np.add.at(belief, b, sent)
            out = (belief[a] - sent[back])[:, :, None] + pair
            top = out.max(axis=1, keepdims=True)
            fresh = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            fresh -= fresh.max(axis=1, keepdims=True)
            if np.abs(fresh - sent).max() < SETTLED:
                break
            sent = 0.5 * sent + 0.5 * fresh
        np.add.at(own, b, sent)
    p = np.exp(own - own.max(axis=1, keepdims=True)) if n else own
    return p / p.sum(axis=1, keepdims=True) if n else p


def find(text: str, weights: tuple[np.ndarray, np.ndarray]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind, end) in order."""
    base = base_spans(text)
    g = Graph(text, base)
    if not g.places or all(y >= 0 for y in g.base):
        return base, base
    # A token without a base span takes a label only from what it looks like and what it is linked to.
    free = [i for i, y in enumerate(g.base) if y < 0]
    p = marginals(g, *weights)
    best = p.argmax(axis=1)
    added: list[tuple[int, int, int]] = []
    for i in free:
        if best[i] and p[i, best[i]] >= CERTAIN:
            a, b = g.places[i]
            kind = int(best[i]) - 1
            if added and added[-1][1] == kind and i - 1 in free and not text[added[-1][2] : a].strip() and added[-1][2] == g.places[i - 1][1]:
                added[-1] = (added[-1][0], kind, b)
            else:
                added.append((a, kind, b))
    return base, sorted(base + added)


def scan(spark: SparkSession, text: Column) -> Column:
    """Struct (base, spans) of arrays of structs (start, end, kind) of each whole text.

    Null counts as empty. Offsets are code points, ends exclusive; base spans are all in
    spans too. Rows are independent of each other, so a lost task is simply run again.
    """
    sent = spark.sparkContext.broadcast(model())
    shape = "array<struct<start:int,end:int,kind:string>>"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tell = lambda spans: [{"start": a, "end": b, "kind": KINDS[k]} for a, k, b in spans]
        for texts in batches:
            found = [find(t or "", sent.value) for t in texts]
            yield pd.DataFrame({"base": [tell(b) for b, _ in found], "spans": [tell(s) for _, s in found]})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, f"base {shape}, spans {shape}")(text)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    from webloom.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", scan(spark, F.col("text")).alias("f"))
    number = lambda kind: F.size(F.filter("f.base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in KINDS], F.sha2(joined(F.col("f.base")), 256).alias("base_sha256"), joined(F.col("f.spans")).alias("spans"))
