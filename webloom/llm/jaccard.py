"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct word shingles. Under one order of all shingles, two
sets that are similar enough share a shingle among the first few (the prefix) of both.
Documents with the same prefix and size form one group; groups that share a prefix
shingle are compared by size, by the shingle's place and by the number of prefix shingles
they share; what remains is expanded to the groups' distinct sets and verified on texts.

Only connected classes are asked for, so pairs within a class need not all be made. The
groups of each shingle are first compared with the shingle's first group alone. Then all
pairs that are still in different components are compared, which leaves no link out: a
large class of near copies costs a comparison for each member, not for each pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.common import components, discard, stored

WORDS = 5
#: Two sets link if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: So many frequent shingles, at most, are broadcast to be put last in the order.
FREQUENT = 500_000
#: Shingles are counted in pieces of about this many; only repeats within a piece are sent on.
PIECE = 4_000_000

#: Words of the bitmap of wanted documents, 64 bits each: what is broadcast to pick texts, whatever the input.
WANTED = 1 << 18
#: Words of up to so many bytes are hashed side by side, longer ones one by one.
SHORT = 32

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RNG = np.random.default_rng(20240229)
_PLACES = _RNG.integers(1, 2**63, size=WORDS + 1, dtype=np.uint64) | np.uint64(1)
_SEEDS = _RNG.integers(1, 2**63, size=SHORT // 8 + 1, dtype=np.uint64) | np.uint64(1)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words: eight bytes at a time, mixed after each, so that no algebra makes words collide;
    words of over ``SHORT`` bytes by BLAKE2b. A word's hash does not depend on the words beside it."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(sizes) - sizes
    raw = b"".join(words) + bytes(8)
    eight = np.ndarray((len(raw) - 7,), dtype=np.uint64, buffer=raw, strides=(1,))  # the eight bytes from each place on
    h = _mix(sizes.astype(np.uint64) * _SEEDS[-1])
    for k in range(-(-min(int(sizes.max()), SHORT) // 8)):
        own = np.flatnonzero(sizes > 8 * k)
        chunk = eight[starts[own] + 8 * k] & _MASKS[np.minimum(sizes[own] - 8 * k, 8)]
        h[own] = _mix((h[own] ^ chunk) * _SEEDS[k])
    for i in np.flatnonzero(sizes > SHORT):
        h[i] = np.frombuffer(hashlib.blake2b(words[i], digest_size=8).digest(), dtype=np.uint64)[0]
    return h


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles of the whole text.

    A-Z are lower-cased; words lie between spaces and the characters 9 to 13. Fewer words
    make one shingle of all of them, none make an empty set.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = _hashes(words)
    if len(h) < WORDS:
        return _mix((h * _PLACES[: len(h)]).sum(keepdims=True, dtype=np.uint64) + _PLACES[WORDS] * np.uint64(len(h)))
    out = h[: len(h) - WORDS + 1] * _PLACES[0]
    for i in range(1, WORDS):
        out = out + h[i : len(h) - WORDS + 1 + i] * _PLACES[i]
    return np.unique(_mix(out))


def prefix_size(n: int) -> int:
    """How many shingles, in order, must be looked at: any similar set shares one of them."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


class Order:
    """The order of shingles: those that are not known to be frequent by hash, then the frequent, rarest first."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray) -> None:
        by_hash = np.argsort(frequent)
        self.frequent = frequent[by_hash]
        rank = np.empty(len(frequent), dtype=np.int64)
        rank[np.lexsort((frequent, counts))] = np.arange(len(frequent))
        self.rank = rank[by_hash]

    def prefix(self, own: np.ndarray) -> np.ndarray:
        p = prefix_size(len(own))
        if not len(self.frequent):
            return own[:p]
        at = np.minimum(np.searchsorted(self.frequent, own), len(self.frequent) - 1)
        hot = self.frequent[at] == own
        rare = own[~hot]
        if len(rare) >= p:
            return rare[:p]
        late = own[hot][np.argsort(self.rank[at[hot]])]
        return np.concatenate([rare, late[: p - len(rare)]])


def _digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of frequent shingles, ``FREQUENT`` at most.

    Counted within pieces of the input; only shingles that a piece has more than once are
    sent on and summed. The counts set the order of the prefixes, thus the work, but never
    the result: any order gives the same links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(counts[keep])], names=["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = shingle_set(text)
                # Copies within a piece count once: they will be one group.
                if not len(own) or (name := _digest(own)) in seen:
                    continue
                seen.add(name)
                held.append(own)
                n += len(own)
                if n >= PIECE:
                    yield flush()
                    held, n, seen = [], 0, set()
        if held:
            yield flush()

    spark = docs.sparkSession
    counted = stored(docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "frequent")
    least, total = 1, 0
    for row in sorted(counted.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).count().collect(), key=lambda r: -r["n"]):
        total += row["count"]
        if total > FREQUENT:
            least = row["n"] + 1
            break
    top = counted.where(F.col("n") >= least).limit(FREQUENT).toArrow()  # two longs a row, never Python rows
    discard(counted)
    return top["token"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.int64)


def _wanted_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (doc_id, text): for each row of ``wanted`` (doc_id, whole) the text whose set has the digest ``whole``.

    A bitmap of fixed size tells in the scan which documents can be wanted, so that few texts
    are shuffled; it is exact only together with the join behind it.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(64 * WANTED))
    bits = wanted.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("mask"))
    seen = docs.withColumn("at", place).withColumn("word", F.shiftright("at", 6)).join(F.broadcast(bits), "word")
    seen = seen.where(F.expr("shiftrightunsigned(mask, CAST(at & 63 AS INT)) & 1L = 1L")).select("doc_id", "text").join(wanted, "doc_id")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_digest(shingle_set(t)) == w for t, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    # Repeated rows of a doc_id: only the one that stands for it, and of equal sets one text.
    return seen.select("doc_id", "text", "whole").mapInArrow(same, "doc_id long, text string").groupBy("doc_id").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, docs: DataFrame, wholes: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose whole texts' shingle sets link, as a written table.

    ``wholes`` (doc_id, whole) has the digest of the set that stands for each document.
    """
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    needed = stored(needed.join(wholes, "doc_id"), "needed")
    texts = stored(_wanted_texts(docs, needed), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = lru_cache(maxsize=32)(shingle_set)
        for batch in batches:
            keep = []
            for ta, tb in zip(batch["ta"], batch["tb"], strict=True):
                a, b = own(ta), own(tb)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(common > 0 and 100 * common >= PERCENT * (len(a) + len(b) - common))
            yield batch.loc[keep, ["a", "b"]]

    out = stored(both.mapInPandas(check, "a long, b long"), "links")
    discard(pairs, needed, texts)
    return out


def _fits(a: Column, b: Column) -> Column:
    """Sizes that a link allows: the smaller is at least PERCENT of the larger."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _needs(common: Column, a: Column, b: Column) -> Column:
    """Whether sets of sizes ``a`` and ``b`` can link with ``common`` shared shingles at most."""
    return (100 + PERCENT) * common >= PERCENT * (a + b)


def _reaches(a: str, b: str) -> Column:
    """Whether sets that share a prefix shingle can link, by its place in both.

    What they share in front of it lies in both prefixes, so among the shingles there that
    other groups have; what they share behind it is at most the shorter rest. This holds at
    every shared shingle of a pair that links.
    """
    before = F.least(F.col(a + "ahead"), F.col(b + "ahead"))
    behind = F.least(F.col(a + "n") - F.col(a + "pos"), F.col(b + "n") - F.col(b + "pos")) - 1
    return _needs(before + 1 + behind, F.col(a + "n"), F.col(b + "n"))


def _rest(n: Column) -> Column:
    """Shingles behind the prefix."""
    return F.ceil(F.lit(PERCENT) * n / 100).cast("long") - 1


def classes(docs: DataFrame) -> DataFrame:
    """Every document's n_shingles and component_id (see ``op2_ngram_jaccard_join``), and
    set_id, the smallest doc_id with the same set.

    ``docs``: doc_id, text. Null texts count as empty; documents without a shingle are
    components of their own. Rows without a doc_id are left out. Of repeated rows of a doc_id
    the one with the smallest set stands for it, of equally large ones that with the least digest.
    Tables that the result does not need are deleted before it is returned.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = spark.sparkContext.broadcast(Order(*frequent_shingles(docs)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t) for t in batch.column(1).to_pylist()]
            heads = [order.value.prefix(x) for x in own]
            offsets = np.concatenate(([0], np.cumsum([len(h) for h in heads]))).astype(np.int32)
            values = np.concatenate(heads).view(np.int64) if heads else np.zeros(0, dtype=np.int64)
            columns = [batch.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([_digest(x) for x in own], pa.binary()), pa.array([_digest(h) for h in heads], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "whole", "head", "prefix"])

    rows = stored(docs.mapInArrow(sign, "doc_id long, n long, whole binary, head binary, prefix array<long>"), "shingled", "snappy")
    signed = stored(rows.groupBy("doc_id").agg(F.min(F.struct("n", "whole", "head")).alias("s")).select("doc_id", "s.*"), "signed")
    # A set's first document stands for it; a group's first document stands for the group.
    sets = stored(signed.where("n > 0").groupBy("n", "head", "whole").agg(F.min("doc_id").alias("set_id")), "sets")
    groups = sets.groupBy("n", "head").agg(F.min("set_id").alias("gid"))
    of_group = stored(sets.join(groups, ["n", "head"]).select("gid", "set_id", "n", "head", "whole"), "groups")
    wholes = of_group.select(F.col("set_id").alias("doc_id"), "whole")
    # The prefix of the one row that gave its group the name: same document, same digests.
    named = of_group.where("gid = set_id").select(F.col("gid").alias("doc_id"), "n", "head", "whole")
    heads = rows.join(named, ["doc_id", "n", "head", "whole"], "left_semi").dropDuplicates(["doc_id"])
    postings = heads.select(F.col("doc_id").alias("gid"), "n", F.posexplode("prefix").alias("pos", "token"))
    shared = postings.withColumn("many", F.count("*").over(Window.partitionBy("token"))).where("many > 1").select("token", "gid", "n", F.col("pos").cast("long").alias("pos"))
    # How many of a group's shingles in front of this one any other group has, too.
    shared = stored(shared.withColumn("ahead", F.row_number().over(Window.partitionBy("gid").orderBy("pos")).cast("long") - 1), "shared")
    # First, each group with the first group of the same shingle and about the same size.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT)))
    alike = Window.partitionBy("token", "band")
    star = shared.withColumn("band", band).withColumn("h", F.min(F.struct("gid", "n", "pos", "ahead")).over(alike)).where(F.col("gid") != F.col("h.gid"))
    star = star.where(_fits(F.col("n"), F.col("h.n")) & _reaches("", "h.")).groupBy("gid", F.col("h.gid").alias("hub"), "n", F.col("h.n").alias("hub_n")).agg(F.count("*").alias("common"))
    star = star.where(_needs(F.col("common") + F.greatest(_rest(F.col("n")), _rest(F.col("hub_n"))), F.col("n"), F.col("hub_n")))
    first = star.join(of_group.select("gid", "set_id"), "gid").select(F.col("set_id").alias("a"), F.col("hub").alias("b"))
    inside = of_group.where("set_id <> gid").select(F.col("set_id").alias("a"), F.col("gid").alias("b"))
    discard(rows)
    links = verified(first.union(inside), docs, wholes)
    # Then all pairs of sets that share a prefix shingle and are not in one component yet.
    comp = components(links)
    placed = shared.join(of_group.select("gid", "set_id"), "gid").join(comp.withColumnRenamed("node", "set_id"), "set_id", "left")
    placed = placed.select("token", "set_id", "n", "pos", "ahead", F.coalesce("component", "set_id").alias("component"))
    token = Window.partitionBy("token")
    placed = placed.withColumns({"main": F.min("component").over(token), "last": F.max("component").over(token)}).where("main <> last").drop("last")
    # Sets in no group of several share a shingle only within their group; they were compared above.
    placed = stored(placed, "placed")
    discard(shared)
    a, b = placed.where("component <> main").alias("a"), placed.alias("b")
    open_pairs = a.join(
        b,
        (F.col("a.token") == F.col("b.token"))
        & (F.col("a.component") != F.col("b.component"))
        & ((F.col("b.component") == F.col("b.main")) | (F.col("a.set_id") < F.col("b.set_id")))
        & _fits(F.col("a.n"), F.col("b.n"))
        & _reaches("a.", "b."),
    )
    # Which side a pair's sets stand on differs from shingle to shingle; counted together, in one order.
    ends = [f(F.struct(F.col("a.set_id").alias("id"), F.col("a.n").alias("n")), F.struct(F.col("b.set_id").alias("id"), F.col("b.n").alias("n"))) for f in (F.least, F.greatest)]
    open_pairs = open_pairs.select(ends[0].alias("x"), ends[1].alias("y")).groupBy("x", "y").agg(F.count("*").alias("common"))
    open_pairs = open_pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), "common")
    open_pairs = open_pairs.where(_needs(F.col("common") + F.greatest(_rest(F.col("na")), _rest(F.col("nb"))), F.col("na"), F.col("nb")))
    more = verified(open_pairs.select("a", "b").union(_inside_rest(of_group, comp)), docs, wholes)
    whole = components(links.union(more))
    discard(links, more, comp, placed, of_group)
    named = signed.join(sets, ["n", "head", "whole"], "left").join(whole.withColumnRenamed("node", "set_id"), "set_id", "left")
    own = F.coalesce("set_id", "doc_id")
    named = named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", own).alias("component_id"), own.alias("set_id"))
    out = stored(named, "classes")
    discard(signed, sets, whole)
    return out


def _inside_rest(of_group: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs within groups of sets that are still in different components.

    Sets of a group agree on the prefix and differ behind it; groups of several sets whose
    sets are not all one component are rare, and their open pairs are compared here.
    """
    placed = of_group.join(comp.withColumnRenamed("node", "set_id"), "set_id", "left").select("gid", "set_id", "n", F.coalesce("component", "set_id").alias("component"))
    group = Window.partitionBy("gid")
    placed = placed.withColumns({"main": F.min("component").over(group), "last": F.max("component").over(group)}).where("main <> last")
    a, b = placed.where("component <> main").alias("a"), placed.alias("b")
    pairs = a.join(b, (F.col("a.gid") == F.col("b.gid")) & (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("b.main")) | (F.col("a.set_id") < F.col("b.set_id"))))
    return pairs.select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set's size and the smallest doc_id reachable by links."""
    from webloom.llm.common import table

    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(docs: DataFrame) -> DataFrame:
    """One document of each component of ``docs``: that with the smallest doc_id.

    Rows without a doc_id stay; of repeated rows of a kept doc_id all stay.
    """
    found = classes(docs.select("doc_id", "text"))
    kept = stored(found.where(F.col("component_id") == F.col("doc_id")).select("doc_id"), "kept")
    discard(found)
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
