"""Secret scan: fixed patterns, and character Markov models compared by log-likelihood ratio.

DataFrame functions only. A match's place is derived from the pieces between matches:
``split`` gives the gaps, ``regexp_extract_all`` the matches, and running sums of their
lengths the starts, counted in code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import fresh

# The kinds of base spans, their patterns and the least length of what counts.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_LEAST = 12

#: The characters that a candidate token may hold; each is a state of the two models.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: The mean ratio that a candidate needs. Of strings that the models have not seen, 99 % of random ones of 24
#: characters lie above 0.25, and all of 4,000 identifiers with a number below -0.25.
LEAST_RATIO = 0.2
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"

# Parts that ordinary identifiers are made of.
PARTS = (
    "get set user name file path list map key value index count size data type node tree item group order line page "
    "request response client server handler manager factory builder service config option default create update delete "
    "insert select query result table column row field record schema session context event stream buffer reader writer "
    "parse format encode decode string number integer double boolean array object class method function module package "
    "import export test main init start stop open close read write send receive connect load save cache store fetch "
    "merge sort filter reduce apply join split match replace search find check valid error warning message status code "
    "height width color image button window dialog panel view model controller component render layout style theme "
    "customer account address phone email payment invoice product price total amount currency date time zone year month "
    "language country region city street house number internationalization responsibility characteristics"
).split()


def samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled samples (text, random): ``n`` random strings and ``n`` ordinary identifiers.

    Random strings are base64 and hex digests of running numbers; identifiers join two
    to four parts in camel case, snake case, kebab case or as one run of lower case.
    """
    ids = spark.range(n)
    digest = F.sha2(F.concat(F.lit("r"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    random = ids.select(
        F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 3 == 1, F.substring(b64, 1, 40)).otherwise(F.substring(F.upper(F.base64(F.unhex(F.sha2(b64, 256)))), 1, 32)).alias("text"),
        F.lit(True).alias("random"),
    )
    parts = F.array(*[F.lit(p) for p in PARTS])
    pick = [F.element_at(parts, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(PARTS))) + 1).cast("int")) for k in range(4)]
    many = (F.col("id") % 3 + 2).cast("int")
    chosen = F.slice(F.array(*pick), 1, many)
    camel = F.array_join(F.transform(chosen, F.initcap), "")
    word = (
        F.when(F.col("id") % 4 == 0, camel)
        .when(F.col("id") % 4 == 1, F.array_join(chosen, "_"))
        .when(F.col("id") % 4 == 2, F.array_join(chosen, "-"))
        .otherwise(F.array_join(chosen, ""))
    )
    return random.union(ids.select(word.alias("text"), F.lit(False).alias("random")))


def train(labelled: DataFrame) -> list[float]:
    """First-order models of both labels from rows (text, random), add-one smoothed.

    Returns the log-likelihood ratio of each step from one state to the next, row by row;
    its size is that of the alphabet, squared, whatever the samples. Null and one-character
    texts give no step; characters outside the alphabet are skipped. Without samples all
    ratios are 0.
    """
    n = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    steps = (
        labelled.where("text is not null and random is not null")
        .select("random", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(2)))).alias("step"))
        .where(F.length("step") == 2)
        .groupBy("random", "step")
        .count()
    )
    counts = {label: [[1.0] * n for _ in range(n)] for label in (True, False)}
    for row in steps.collect():  # at most two labels times the alphabet squared, and what is outside it
        a, b = row["step"]
        if a in at and b in at:
            counts[row["random"]][at[a]][at[b]] += row["count"]
    out = []
    for i in range(n):
        sums = {label: sum(counts[label][i]) for label in counts}
        out += [math.log(counts[True][i][j] / sums[True]) - math.log(counts[False][i][j] / sums[False]) for j in range(n)]
    return out


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Array of (start, end, body) of the leftmost matches that do not overlap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    body = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.transform(found, F.length), F.zip_with(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), body, lambda g, b: F.struct(F.length(g).alias("gap"), b.alias("body"))), lambda n, x: F.struct(n.alias("n"), x["gap"].alias("gap"), x["body"].alias("body")))
    empty = F.array().cast("array<struct<start:int,end:int,body:string>>")
    spans = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["n"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end"), x["body"].alias("body")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(empty)


def _score(body: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the steps of ``body``, which holds the alphabet's characters only."""
    n = len(ALPHABET)
    model = F.lit(ratios).cast("array<double>") if ratios else F.array().cast("array<double>")
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(body, i, F.lit(1)))
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(body) - 1, F.lit(1))),
        F.lit(0.0),
        lambda acc, i: acc + F.coalesce(F.try_element_at(model, ((place(i) - 1) * n + place(i + 1)).cast("int")), F.lit(0.0)),
    )
    return total / F.greatest(F.length(body) - 1, F.lit(1))


def scan(docs: DataFrame, ratios: list[float], text: str = "text", least_ratio: float = LEAST_RATIO) -> DataFrame:
    """``docs`` with ``spans``, an array of (start, kind, end, body, score) by start, then kind.

    Base spans (assign, access, hex) are the fixed patterns'. The models add a span of kind
    markov for each run of 20 or more characters of the alphabet that holds a digit and a
    letter, overlaps no base span, and whose mean log-likelihood ratio is at least
    ``least_ratio``. A null text counts as empty and has no span; repeated rows have the same
    spans each, and an empty table gives none. Text columns of any name work; a column named
    spans is replaced, all others stay.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    tag = lambda found, kind: F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["body"].alias("body"), F.lit(None).cast("double").alias("score")))
    assign = tag(F.filter(_matches(t, ASSIGN, 1), lambda x: F.length(x["body"]) >= ASSIGN_LEAST), 0)
    base = F.concat(assign, tag(_matches(t, ACCESS, 0), 1), tag(_matches(t, HEX, 0), 2))
    more = F.filter(_matches(t, CANDIDATE, 0), lambda x: x["body"].rlike("[0-9]") & x["body"].rlike("[A-Za-z]"))
    b, m = fresh(docs, "base_spans", "more_spans")
    out = docs.withColumns({b: base, m: more})
    scored = F.transform(m, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end"), x["body"].alias("body"), _score(x["body"], ratios).alias("score")))
    added = F.filter(scored, lambda x: (x["score"] >= least_ratio) & ~F.exists(b, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))
    return out.withColumn("spans", F.array_sort(F.concat(b, added))).drop(b, m)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    from webloom.llm.common import table

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), train(samples(spark)))
    base = F.filter("spans", lambda x: x["kind"] < 3)
    number = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
