"""Queries of the training-data operators against plain versions of the same rule, and the pipeline on odd tables."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import common, decontam, knn, langid, lines, secrets, toxicity


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# 1
def test_secret_spans_against_plain_python(spark):
    ratios = secrets.train(secrets.samples(spark))
    at, n = {c: i for i, c in enumerate(secrets.ALPHABET)}, len(secrets.ALPHABET)
    base = (
        (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 12),
        (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    )

    def plain(text):
        spans = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(base) for m in p.finditer(text) if ok(m)]
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text):
            body = m[0]
            score = sum(ratios[at[a] * n + at[b]] for a, b in zip(body, body[1:], strict=False)) / (len(body) - 1)
            free = all(e <= m.start() or s >= m.end() for s, _, e in spans if _ < 3)
            if re.search("[0-9]", body) and re.search("[A-Za-z]", body) and score >= secrets.LEAST_RATIO and free:
                spans.append((m.start(), 3, m.end()))
        return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))

    r = random.Random(11)
    pieces = ["token", "password", "API_KEY", "api key", "=", ":", " ", '"', "é", "AKIA", "ABCDEFGH12", "0123abcd", "f" * 9, "Zq9", "userName", "x-y", ".", "\n", "9fK2mQ7xLr4TnB8v", "getCustomerAddressLine"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(1, 14))) for _ in range(600)]
    got = {x["doc_id"]: x["s"] for x in secrets.scan(docs(spark, list(enumerate(texts))), ratios).select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]


def test_secret_models_tell_unseen_samples_apart(spark):
    ratios = secrets.train(secrets.samples(spark))
    r = random.Random(12)
    chars = secrets.ALPHABET[:62]
    random_texts = ["".join(r.choice(chars) for _ in range(24)) for _ in range(400)]
    words = [f"{r.choice(secrets.PARTS)}{r.choice(secrets.PARTS).title()}{r.choice(secrets.PARTS).title()}{r.choice(secrets.PARTS).title()}{r.randint(0, 9)}" for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(random_texts + [w for w in words if len(w) >= 20])]
    found = {x["doc_id"] for x in secrets.scan(docs(spark, rows), ratios).where("size(spans) > 0").select("doc_id").collect()}
    assert len(found & set(range(400))) >= 0.95 * 400
    assert len(found - set(range(400))) <= 0.02 * (len(rows) - 400)


# 3
def test_long_random_texts_do_not_fill_the_kernel():
    r = random.Random(13)
    text = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(60_000))
    out = np.zeros(langid.DIMENSIONS, dtype=bool)
    langid.presence(text, out)
    first = 0
    filled = []
    for size in langid.SPACES.values():
        filled.append(out[first : first + size].mean())
        first += size
    assert filled[0] < 0.05 and filled[1] < 0.15


def test_language_sample_keeps_its_bound(spark):
    rows = [(1, f"abc def {i}", "en") for i in range(300)] + [(2, "xyz", "de"), (None, "uvw uvw", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert sorted(model.languages) == ["de", "en"] and len(model.landmarks) == 3


# 5
def test_decontamination_against_overlap_alone():
    r = np.random.default_rng(14)
    vocabulary = [f"t{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocabulary, int(r.integers(8, 60))))) for i in range(60)]
    index = decontam.Index(items)
    step = max(64, index.longest)
    missed = want = 0
    for _ in range(200):
        own = [str(w) for w in r.choice(vocabulary, int(r.integers(20, 400)))]
        item = items[int(r.integers(0, 60))][1].split()
        for _ in range(int(r.integers(0, 3))):
            item[int(r.integers(0, len(item)))] = str(r.choice(vocabulary))
        at = int(r.integers(0, len(own)))
        own[at:at] = item
        held = {i for i in range(60) for k in range(0, max(1, len(own) - step), step) if index.verify(i, own[k : k + 2 * step])}
        got = {h[0] for h in index.search(" ".join(own))}
        assert got <= {index.item_ids[i] for i in held}
        want += len(held)
        missed += len(held) - len(got)
    assert want > 100 and missed == 0


# 6
def edits(a, b):
    row = np.arange(len(b) + 1)
    b = np.array(list(b))
    for i, x in enumerate(a, 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (b != x))))
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


@pytest.mark.parametrize(("kind", "least"), [("letter", 0.98), ("words", 0.9)])
def test_recall_on_lines_of_6_to_30_words(spark, kind, least):
    r = random.Random(15)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(2, 9)))
    vocabulary = [word() for _ in range(3000)]
    pairs = []
    for k in range(200):
        a = [r.choice(vocabulary) for _ in range(6 + k % 25)]
        b = list(a)
        if kind == "letter":
            i = r.randrange(len(b))
            j = r.randrange(len(b[i]))
            b[i] = b[i][:j] + "z" + b[i][j + 1 :]
        else:
            for i in r.sample(range(len(b)), r.randint(1, max(1, len(b) // 5))):
                b[i] = r.choice(vocabulary)
        a, b = " ".join(a), " ".join(b)
        if a != b and edits(a, b) <= (1 - lines.SIMILARITY) * max(len(a), len(b)):
            pairs.append((len(pairs), f"{a}\n{b}"))
    found = {x["doc_id"] for x in lines.dropped(docs(spark, pairs)).collect()}
    assert len(pairs) > 120 and len(found) >= least * len(pairs)


def variants(seed, families=4, each=40):
    """Lines of families that share a passage, their edit similarities about ``lines.SIMILARITY``."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(2, 9)))
    out = []
    for _ in range(families):
        passage, own = [word() for _ in range(12)], [word() for _ in range(24)]
        for _ in range(each):
            out.append(" ".join(passage + [word() if r.random() < 0.16 else w for w in own]))
    return out


def candidate_groups(spark, texts):
    """Each line's first line in its component of all candidates, compared one by one: those that agree on a block."""
    signed = lines.with_simhash(lines.split_lines(docs(spark, list(enumerate(texts))))).collect()
    rows = {x["doc_id"]: (x["sim"], {x[k] for k in lines.KEYS} - {None}) for x in signed}
    first = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            (sa, ka), (sb, kb) = rows[a], rows[b]
            apart = ((sa ^ sb) & (1 << 64) - 1).bit_count()
            if first[a] != first[b] and (apart <= lines.DISTANCE or apart <= lines.LOOSE and ka & kb):
                if edits(texts[a], texts[b]) <= (1 - lines.SIMILARITY) * max(len(texts[a]), len(texts[b])):
                    low, high = sorted((first[a], first[b]))
                    first = [low if x == high else x for x in first]
    return first


def test_all_candidates_of_a_block_are_compared(spark):
    texts = variants(21)
    table = common.stored(lines.split_lines(docs(spark, list(enumerate(texts)))), "test-lines")
    found = {(x["id"], x["id2"]): x["doc_id"] for x in lines.groups(table).collect()}
    got = [found.get((x["id"], x["id2"]), x["doc_id"]) for x in table.orderBy("doc_id").collect()]
    assert got == candidate_groups(spark, texts)


def test_stage_keeps_one_line_of_all_that_candidates_join(spark):
    texts = variants(22)
    kept = sorted(x["doc_id"] for x in lines.stage(docs(spark, list(enumerate(texts)))).collect())
    assert kept == [i for i, first in enumerate(candidate_groups(spark, texts)) if i == first]


def test_each_round_joins_components_by_its_own_links_only(spark, monkeypatch):
    rounds, join = [], lines.components

    def joined(links):
        nodes = join(links)
        rounds.append(({x for r in links.collect() for x in (r["a"], r["b"])}, {r["node"] for r in nodes.collect() if r["node"] != r["component"]}))
        return nodes

    monkeypatch.setattr(lines, "components", joined)
    table = common.stored(lines.split_lines(docs(spark, list(enumerate(variants(24, 3, 30))))), "test-lines")
    lines.groups(table)
    assert sum(bool(seen) for seen, _ in rounds) > 1
    gone = set()
    for seen, moved in rounds:  # a line whose component got another name is not looked at again
        assert not seen & gone
        gone |= moved


def test_driver_lets_go_between_rounds(spark, monkeypatch):
    calls, release = [], lines.release
    monkeypatch.setattr(lines, "release", lambda session: (calls.append(1), release(session)))
    assert lines.dropped(docs(spark, [(1, "one line of a few words here"), (2, "One line of a  few words here")])).count() == 1
    assert len(calls) >= 2 * len(lines.STEPS)


def test_letters_leave_out_only_pairs_that_cannot_link(spark):
    texts = variants(23, 2, 12) + ["e" * 300 + "é漢" * 9, "e" * 290 + "é漢" * 9, "", "zz zz é", *("qxj " * n for n in (70, 80))]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, norm string")
    bags = lines._with_bags(rows).withColumns({"key": F.lit(1), "keys": F.array(F.lit(1)), "sim": F.lit(0), "component": F.col("rid")})
    chars = rows.select(F.col("row").alias("rid"), F.length("norm").alias("chars"))
    got = {(x["a"], x["b"]) for x in lines._rest(bags.join(chars, "rid"), 0).collect()}

    def bag(text):
        known = Counter(c if c in lines.LETTERS else "" for c in text)
        return Counter({c: min(n, 255) for c, n in known.items()})

    want, fits, link = set(), 0, set()
    for b, tb in enumerate(texts):
        for a, ta in enumerate(texts[:b]):
            longer, most = max(len(ta), len(tb)), int(max(len(ta), len(tb)) * (1 - lines.SIMILARITY) + 1e-9)
            if min(len(ta), len(tb)) >= lines.SIMILARITY * longer:
                fits += 1
                x, y = bag(ta), bag(tb)
                if max((x - y).total(), (y - x).total()) <= most:
                    want.add((a, b))
                if edits(ta, tb) <= most:
                    link.add((a, b))
    assert got == want and link <= got and len(got) < fits


def test_line_columns_of_any_name(spark):
    df = docs(spark, [(1, "the same line of some words\nown one of the first"), (2, "the same line of some words\nown one of the second")])
    df = df.withColumns({"lost_id": F.lit(1), "lost_places": F.lit(2), "_drop": F.lit(3), "n_chars": F.length("text")})
    out = {x["doc_id"]: x for x in lines.stage(df).collect()}
    assert out[2]["text"] == "own one of the second" and out[2]["n_chars"] == 21 and out[2]["_drop"] == 3 and out[1]["lost_places"] == 2


# 9
def test_bounds_hold_and_repeated_ids_are_defined(spark):
    r = np.random.default_rng(16)
    vectors = r.integers(-3000, 3000, (300, 40))
    cells = knn.Cells(vectors.min(axis=0), vectors.max(axis=0), 6)
    scaled, constant = cells.prepared(vectors[:50].astype(float))
    upper = scaled @ cells.codes(vectors).astype(np.float32).T + constant[:, None]
    assert (upper >= vectors[:50] @ vectors.T).all()
    rows = [(0, [2, 0]), (0, [1, 1]), (1, [3, 3]), (1, [3, 3]), (2, [0, 0])]
    df = spark.createDataFrame(rows, "vec_id long, q array<long>")
    got = [tuple(x) for x in knn.top_k(df, F.col("vec_id") == 0, k=5).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 6), (0, 2, 1, 6), (0, 3, 2, 0)]


# 10
def test_toxicity_sample_keeps_its_bound(spark):
    rows = [(1, f"vile words {i}") for i in range(300)] + [(i, f"kind words {i}") for i in range(2, 40)]
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 40)], "doc_id long, toxic int")
    model = toxicity.train(docs(spark, rows), labels)
    assert 0 <= model.score("vile words") <= 1


# The pipeline
def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(17)
    word = {x: [x + "".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(300)] for x, letters in (("a", "bcdefgh"), ("ü", "ßöäxyz"))}
    say = lambda x, n: " ".join(r.choice(word[x]) for _ in range(n))
    item, copied, line = say("a", 30), say("a", 80), say("a", 20)
    rows = [(i, say("aü"[i % 2], 60), "aü"[i % 2], f"s{i % 3}") for i in range(60)]
    rows += [(100, copied, "a", "s0"), (101, copied, "a", "s1"), (102, copied.replace(" ", "  "), "a", None), (103, f"{say('a', 50)}\n{line}", "a", "s0"), (104, f"{say('a', 50)}\n{line}", "a", "s1")]
    rows += [(105, f"{say('a', 40)} {item} {say('a', 40)}", "a", "s2"), (106, None, None, "s0"), (107, "", "a", "s0"), (108, "12345", None, "s0"), (7, rows[7][1], "ü", "s1"), (None, say("a", 60), "a", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.length("text"), "hits": F.lit(1), "_lang": F.lit(2), "lost_id": F.lit(3), "mix_order": F.lit(4)})
    folder = str(tmp_path)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = df
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = corpus_pipeline.stored(stage(spark, got, folder), name)
        assert got.columns == df.columns
        kept[name] = {x["doc_id"]: x["text"] for x in got.collect()}
    clean = {i for i in range(60)}
    assert not {106, 107, 108} & set(kept["language_id"]) and clean <= set(kept["language_id"])
    assert line not in kept["line_dedup"][104] and line in kept["line_dedup"][103] and clean <= set(kept["line_dedup"])
    assert {100, 101, 102} & set(kept["ngram_jaccard"]) == {100} and clean <= set(kept["ngram_jaccard"])
    assert 105 not in kept["benchmark_decontamination"] and clean <= set(kept["benchmark_decontamination"])
    mixed = corpus_pipeline.STAGES[-1][1](spark, got, folder)
    assert set(mixed.columns) == set(df.columns) | {"mix_epoch", "mix_block"} and mixed.count() > 40
    none = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, folder)
        assert none.count() == 0
