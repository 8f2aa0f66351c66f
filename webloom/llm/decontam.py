"""Benchmark decontamination: BM25 over an inverted index of test items, with block maxima.

Every passage of every training text is a query. Postings hold each term's share of an
item's own BM25 score, so a passage's score for an item is between 0 and 1 and one
threshold fits all items. Items are grouped in blocks, and block-max WAND walks them in
order: the pivot is the next block in which the maxima of the passage's terms reach the
threshold; the walk skips to it, and postings in front of it are never read. As the threshold
is fixed and everything above it is asked for, the pivots of a passage do not depend on what
has been found, so they are all found at once, from the maxima alone. All items at or above
the threshold are retrieved, and what is retrieved is then verified on words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import fresh

K1, B = 1.2, 0.75
BLOCK = 16
THRESHOLD = 0.6
SHINGLE = 5
OVERLAP = 0.8
PART_OVERLAP = 0.5
#: An index holds so many items at most; larger benchmarks are split into several indexes.
MAX_ITEMS = 20_000

_WORD = re.compile(r"\w+")
HIT = "item_id long, score double, overlap double, question double, answer double, passage int"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(own: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    """The distinct n-word shingles; the whole sequence if it is shorter, none of an empty one."""
    if len(own) < n:
        return {tuple(own)} if own else set()
    return set(zip(*(own[i:] for i in range(n)), strict=False))


def parts(own: list[str]) -> tuple[list[str], list[str]]:
    """Question and answer of an item: the answer is its last fifth, five words at least;
    an item under ten words is a question only."""
    if len(own) < 2 * SHINGLE:
        return own, []
    cut = len(own) - max(SHINGLE, len(own) // 5)
    return own[:cut], own[cut:]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The concatenated ranges starts[i]..ends[i]."""
    sizes = ends - starts
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    return np.arange(total) + np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)


class Index:
    """An inverted index of items (item_id, text); items without a word are left out."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        known = [(i, w) for i, t in items if t is not None and (w := words(t))]
        # Neighbours in a block should share terms: items are laid out in the order of their words.
        known.sort(key=lambda x: (sorted(x[1]), x[0]))
        self.item_ids = [i for i, _ in known]
        self.words = [w for _, w in known]
        self.longest = max(map(len, self.words), default=1)
        n, mean = len(known), float(np.mean([len(w) for w in self.words])) if known else 1.0
        counts = [dict(zip(*np.unique(w, return_counts=True), strict=True)) for w in self.words]
        found: dict[str, int] = {}
        for own in counts:
            for term in own:
                found[term] = found.get(term, 0) + 1
        self.terms = {t: k for k, t in enumerate(sorted(found))}
        rows = []
        for i, own in enumerate(counts):
            score = {t: np.log(1 + (n - found[t] + 0.5) / (found[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(self.words[i]) / mean)) for t, c in own.items()}
            total = sum(score.values())
            rows += [(self.terms[t], i, s / total) for t, s in score.items()]
        rows.sort()
        self.post_item = np.array([r[1] for r in rows], dtype=np.int64)
        self.post_share = np.array([r[2] for r in rows], dtype=np.float64)
        term = np.array([r[0] for r in rows], dtype=np.int64)
        self.post_at = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.blocks = (n + BLOCK - 1) // BLOCK
        block = self.post_item // BLOCK
        first = np.flatnonzero(np.concatenate(([True], (np.diff(term) != 0) | (np.diff(block) != 0)))) if len(rows) else np.zeros(0, dtype=np.int64)
        self.max_block = block[first] if len(rows) else np.zeros(0, dtype=np.int64)
        self.max_share = np.maximum.reduceat(self.post_share, first) if len(rows) else np.zeros(0)
        # The postings of each (term, block) lie between two neighbours of these.
        self.max_post = np.concatenate((first, [len(rows)]))
        self.max_at = np.searchsorted(term[first] if len(rows) else np.zeros(0), np.arange(len(self.terms) + 1))
        self.shingles = [shingles(w) for w in self.words]
        self.parts = [parts(w) for w in self.words]

    def pivots(self, terms: np.ndarray, threshold: float, only: np.ndarray | None = None) -> np.ndarray:
        """The (term, block) entries, as places in the maxima, of the blocks that can hold an item
        with at least ``threshold`` for a query of distinct ``terms``; ``only`` rules out blocks."""
        at = _ranges(self.max_at[terms], self.max_at[terms + 1])
        block = self.max_block[at]
        bound = np.bincount(block, weights=self.max_share[at], minlength=self.blocks)
        alive = bound >= threshold - 1e-9
        return at[(alive if only is None else alive & only)[block]]

    def retrieve(self, terms: np.ndarray, threshold: float, only: np.ndarray | None = None) -> list[tuple[int, float]]:
        """All (item, score) with a score of at least ``threshold``; only postings of pivot blocks are read."""
        entries = self.pivots(terms, threshold, only)
        if not len(entries):
            return []
        at = _ranges(self.max_post[entries], self.max_post[entries + 1])
        item, where = np.unique(self.post_item[at], return_inverse=True)
        score = np.bincount(where, weights=self.post_share[at], minlength=len(item))
        return [(int(i), float(s)) for i, s in zip(item, score, strict=True) if s >= threshold - 1e-9]

    def verify(self, item: int, passage: list[str]) -> tuple[float, float, float] | None:
        """(overlap, question overlap, answer overlap) if the passage holds the item, else None."""
        own = shingles(passage, min(SHINGLE, len(self.words[item])))
        overlap = len(self.shingles[item] & own) / len(self.shingles[item])
        if overlap < OVERLAP:
            return None
        question, answer = self.parts[item]
        asked = shingles(question)
        said = shingles(answer, 2)
        q = len(asked & shingles(passage, min(SHINGLE, len(question)))) / len(asked)
        a = len(said & shingles(passage, 2)) / len(said) if said else 1.0
        return (overlap, q, a) if q >= PART_OVERLAP and a >= PART_OVERLAP else None

    def search(self, text: str, threshold: float = THRESHOLD) -> list[tuple[int, float, float, float, float, int]]:
        """Verified hits of a whole text, the best passage of each item: see ``HIT``.

        Passages are windows of twice the longest item (64 words at least) in steps of half
        a window, so each run of words as long as an item lies within one. The whole text is
        bounded first; a text that cannot reach the threshold has no passage that can.
        """
        own = words(text)
        get = self.terms.get
        coded = np.array([get(w, -1) for w in own], dtype=np.int64)
        seen = np.unique(coded[coded >= 0])
        if not len(seen):
            return []
        # A passage holds no term that its text lacks, so the text's own scores bound its passages'.
        reached = self.retrieve(seen, threshold)
        if not reached:
            return []
        alive = np.zeros(self.blocks, dtype=bool)
        alive[[item // BLOCK for item, _ in reached]] = True
        step = max(64, self.longest)
        best: dict[int, tuple] = {}
        for k, at in enumerate(range(0, max(1, len(own) - step), step)):
            terms = coded[at : at + 2 * step]
            terms = np.unique(terms[terms >= 0])
            if not len(terms):
                continue
            for item, score in self.retrieve(terms, threshold, alive):
                held = self.verify(item, own[at : at + 2 * step])
                if held and (item not in best or (held[0], score) > (best[item][2], best[item][1])):
                    best[item] = (self.item_ids[item], score, *held, k)
        return sorted(best.values())


def indexes(benchmark: DataFrame, max_items: int = MAX_ITEMS) -> Iterator[Index]:
    """Indexes over all items of ``benchmark`` (item_id, text), ``max_items`` or so in each.

    The driver holds one index at a time. Rows with a null id or text are passed over,
    repeated rows count once.
    """
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    n = items.count()
    many = max(1, -(-n // max_items))
    for k in range(many):
        own = items if many == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k)
        yield Index([(r["item_id"], r["text"]) for r in own.collect()])


def hits(spark: SparkSession, text: Column, index: Index, threshold: float = THRESHOLD) -> Column:
    """Array of ``HIT`` structs for each whole text; a null text has none."""
    sent = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        names = [x.split()[0] for x in HIT.split(", ")]
        for texts in batches:
            yield pd.Series([[dict(zip(names, h, strict=True)) for h in own.search(t, threshold)] if t else [] for t in texts], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<struct<" + ", ".join(x.replace(" ", ":") for x in HIT.split(", ")) + ">>")(text)


def scan(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, max_items: int = MAX_ITEMS, column: str = "hits") -> DataFrame:
    """``docs`` with ``column``: the verified benchmark items that each whole text holds.

    Row by row, without a shuffle, so repeated rows have the same hits each. A column of the name
    is replaced, all others stay. An empty benchmark gives no hits; empty and null texts have none.
    """
    spark = docs.sparkSession
    found = [hits(spark, F.col("text"), index, threshold) for index in indexes(benchmark, max_items)]
    return docs.withColumn(column, F.concat(*found))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, once for each such item."""
    from webloom.llm.common import table

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    out = found.select("doc_id", F.explode("hits").alias("h"))
    return out.select("doc_id", "h.item_id", "h.score", "h.overlap", F.col("h.question").alias("question_overlap"), F.col("h.answer").alias("answer_overlap"))


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    held = fresh(docs, "benchmark_hits")[0]
    return scan(docs, benchmark, column=held).where(F.size(held) == 0).drop(held)
