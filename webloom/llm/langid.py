"""Language identification with string kernels.

The kernel of two texts is the normalised number of character n-grams (one to four
long, a blended spectrum) that both hold; each length has places of its own, more of them
the longer it is, so that long texts do not fill those of the short ones. Landmarks and the Nyström method turn it into
a bounded feature map; one-versus-rest kernel ridge regression is solved on that map.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.common import fresh

#: Places of the n-grams of each length.
SPACES = {1: 2048, 2: 8192, 3: 8192, 4: 16384}
DIMENSIONS = sum(SPACES.values())
#: Bounds of the training sample: rows of a language, rows in all, and landmarks in all.
ROWS_PER_LANGUAGE = 400
ROWS = 40_000
LANDMARKS = 192
RIDGE = 1e-2
SHARPNESS = 4.0
#: The stage rejects texts whose score is under so many times that of a guess.
OVER_GUESS = 1.2
UNDETERMINED = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
#: So many code points are turned into n-grams at a time; pieces overlap by the longest order.
_PIECE = 1 << 20


def presence(text: str, out: np.ndarray) -> None:
    """Mark in ``out`` (bool, DIMENSIONS) each hashed n-gram of the whole lower-cased text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, len(codes), _PIECE):
        piece = codes[at : at + _PIECE + max(SPACES) - 1]
        value, first = np.zeros(len(piece), dtype=np.uint32), 0
        for n, size in SPACES.items():
            if len(piece) < n:
                break
            value = (value[: len(piece) - n + 1] + np.uint32(n)) * np.uint32(0x01000193) ^ (piece[n - 1 :] * _FACTORS[n - 1])
            out[(value ^ (value >> np.uint32(15))) % np.uint32(size) + np.uint32(first)] = True
            first += size


def _rows(texts) -> np.ndarray:
    out = np.zeros((len(texts), DIMENSIONS), dtype=bool)
    for i, text in enumerate(texts):
        presence(text or "", out[i])
    return out


def _kernel(rows: np.ndarray, landmarks: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Normalised common n-grams of each row and each landmark, as one matrix product."""
    own = np.sqrt(np.maximum(rows.sum(axis=1), 1)).astype(np.float32)
    return (rows.astype(np.float32) @ landmarks.T) / own[:, None] / roots[None, :]


@dataclass
class Model:
    """Landmarks (bits), the Nyström map times the ridge weights, and the languages."""

    landmarks: np.ndarray
    weights: np.ndarray
    languages: list[str]

    def margins(self, rows: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_ready"):
            own = np.unpackbits(self.landmarks, axis=1)[:, :DIMENSIONS].astype(np.float32)
            self._ready = (own, np.sqrt(np.maximum(own.sum(axis=1), 1)).astype(np.float32))
        return _kernel(rows, *self._ready) @ self.weights


def fit(bits: np.ndarray, languages: list[str], landmarks: int = LANDMARKS) -> Model:
    """Kernel ridge regression on Nyström features of packed presence rows."""
    names = sorted(set(languages))
    if not names:
        return Model(np.zeros((1, DIMENSIONS // 8), dtype=np.uint8), np.zeros((1, 0), dtype=np.float32), [])
    label = np.array([names.index(x) for x in languages])
    each = max(1, landmarks // len(names))
    chosen = np.concatenate([np.flatnonzero(label == k)[:each] for k in range(len(names))])
    marks = np.unpackbits(bits[chosen], axis=1).astype(np.float32)
    roots = np.sqrt(np.maximum(marks.sum(axis=1), 1)).astype(np.float32)
    kernel = np.concatenate([_kernel(np.unpackbits(bits[i : i + 512], axis=1), marks, roots) for i in range(0, len(bits), 512)]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    target = np.where(label[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    # Each language weighs the same, however many samples it has.
    weight = 1.0 / np.bincount(label)[label]
    gram = (features * weight[:, None]).T @ features
    solved = np.linalg.solve(gram + RIDGE / len(names) * np.eye(gram.shape[0]) * np.trace(gram) / gram.shape[0], (features * weight[:, None]).T @ target)
    return Model(bits[chosen], (root @ solved).astype(np.float32), names)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from at most ``per_language`` labelled rows of each language, ``ROWS`` in all.

    Rows without a language or a text are passed over. The rows kept are those whose
    hashed doc_id is least, so the sample does not depend on partitions; of repeated rows of a
    doc_id and language the least text counts, so the sample keeps its bound. The driver
    receives one bit for each dimension of a row, never a text. Without a labelled row nothing is learned.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select("doc_id", F.col(lang).alias("lang"), F.col(text).alias("text"))
    ids = labelled.select("doc_id", "lang").distinct()
    languages = labelled.agg(F.count_distinct("lang")).first()[0]
    each = min(per_language, ROWS // max(1, languages))
    if languages and not each:
        raise ValueError(f"over {ROWS} languages; raise ROWS")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).collect()
    few = docs.sparkSession.createDataFrame([(r["doc_id"], r["lang"], r["n"]) for r in chosen], f"doc_id {dict(labelled.dtypes)['doc_id']}, lang string, n int")
    sample = labelled.alias("a").join(F.broadcast(few.alias("b")), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.lang") == F.col("b.lang")))
    sample = sample.groupBy("a.lang", "b.n").agg(F.min("a.text").alias("text"))

    def pack(batches):
        for b in batches:
            rows = _rows(b["text"])
            yield pd.DataFrame({"lang": b["lang"], "n": b["n"], "bits": [x.tobytes() for x in np.packbits(rows, axis=1)]})

    rows = sample.mapInPandas(pack, "lang string, n int, bits binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["n"], r["bits"]))
    bits = np.stack([np.frombuffer(r["bits"], dtype=np.uint8) for r in rows]) if rows else np.zeros((0, DIMENSIONS // 8), dtype=np.uint8)
    return fit(bits, [r["lang"] for r in rows])


def predict(spark: SparkSession, model: Model, text: Column) -> Column:
    """Struct (lang_pred, score) of each text.

    A text that is null or has no letter gives ``und`` with score 0, and so does any text
    if nothing was learned. The score is a softmax over the languages' margins. Rows are
    scored 64 at a time, so that a batch's presence matrix stays at 9 MB of floats.
    """
    sent = spark.sparkContext.broadcast(model)

    def score(batches):
        own = sent.value
        for texts in batches:
            names, scores = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
            values = texts.to_numpy()
            known = np.array([i for i, t in enumerate(values) if t is not None and own.languages and any(map(str.isalpha, t))], dtype=int)
            for at in range(0, len(known), 64):
                part = known[at : at + 64]
                margins = own.margins(_rows(values[part])).astype(np.float64) * SHARPNESS
                share = np.exp(margins - margins.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                best = share.argmax(axis=1)
                names[part] = [own.languages[k] for k in best]
                scores[part] = share[np.arange(len(part)), best]
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    from collections.abc import Iterator

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(score, "lang_pred string, score double")(text)


def remainder(by: int) -> Column:
    """crc32 of doc_id as text, modulo ``by``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % by


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the rows that are not held out."""
    from webloom.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(remainder(5) != 0))
    out = docs.select("doc_id", (remainder(5) == 0).alias("held_out"), predict(spark, model, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def stage(spark: SparkSession, docs: DataFrame, over_guess: float = OVER_GUESS) -> DataFrame:
    """``docs`` without the rows whose language cannot be told: null texts, texts without a
    letter, and those whose best language scores under ``over_guess`` times an even share of all
    languages, where the kernels prefer none. Learns from the labelled rows of ``docs`` that are
    not held out; with one language or none only the first two kinds go. Repeated rows go or stay together."""
    model = train(docs.where(remainder(5) != 0))
    many = len(model.languages)
    told = fresh(docs, "language_told")[0]
    out = docs.withColumn(told, predict(spark, model, F.col("text")))
    sure = F.col(f"{told}.score") >= (over_guess / many if many > 1 else 0.0)
    return out.where((F.col(f"{told}.lang_pred") != UNDETERMINED) & sure).drop(told)
