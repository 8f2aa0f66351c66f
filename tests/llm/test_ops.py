"""The training-data operators on small fixtures: odd rows, brute force, round trips, held-out accuracy."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import chat, common, decontam, jaccard, knn, langid, lines, mixing, pii, secrets, toxicity

LONG = "word " * 60_000
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, LONG), (6, "é ß 日本 \U0001f600"), (7, "1" * 50_000), (7, "1" * 50_000)]


def docs(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"spans": F.lit(1), "hits": F.lit(2), "n": F.lit(3), "source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}) if extra else df


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD, True)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [], True)


# 1
def test_secret_places(spark):
    texts = ["é token = \"abcdef123456\" x", "secret=short", "AKIA" + "B" * 14 + " AKIA" + "C" * 13, "f" * 16 + " " + "0" * 15, "token=secret: abcdefghijklmnop", "k 9Qz7Lr2Xv8Tn4Kp1Wd6Yb3Hs0Jm5 z", "getUserProfileDataFromServer2 x"]
    out = {r["doc_id"]: r for r in secrets.scan(docs(spark, list(enumerate(texts))), secrets.train(secrets.samples(spark))).select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()}
    assert [out[i]["s"] for i in range(5)] == ["assign:2:23", "", "access:0:18", "hex:0:16", ""]
    assert out[5]["s"] == "markov:2:30" and out[6]["s"] == ""


def test_secrets_odd(spark, odd, none):
    model = secrets.train(secrets.samples(spark))
    assert secrets.scan(odd, model).count() == len(ODD) and secrets.scan(none, model).count() == 0
    assert secrets.scan(odd, model).where("size(spans) > 0").select("doc_id").distinct().collect()[0]["doc_id"] == 7
    assert set(secrets.train(spark.createDataFrame([], "text string, random boolean"))) == {0.0}


# 2
def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  two"), (4, "x"), (5, LONG)]
    for k in range(25):
        base = list(rng.choice(vocabulary, int(rng.integers(5, 120))))
        for _ in range(int(rng.integers(1, 6))):
            own = list(base)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(0, len(own)))] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs(spark, rows)).collect()}
    assert got == brute_components(rows)
    kept = [r["doc_id"] for r in jaccard.stage(docs(spark, rows)).collect()]
    assert sorted(kept) == sorted({c for _, c in got.values()})


def test_jaccard_odd(spark, odd, none):
    assert {r["doc_id"]: r["n_shingles"] for r in jaccard.classes(odd.select("doc_id", "text")).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 1}
    assert jaccard.classes(none.select("doc_id", "text")).count() == 0


def test_shingle_hashes_follow_texts():
    a = jaccard.shingle_set("a b c d e f")
    assert len(a) == 2 and set(a) == set(jaccard.shingle_set("A  b\tC d\ne f")) and set(a) != set(jaccard.shingle_set("b a c d e f"))
    assert len(np.intersect1d(jaccard.shingle_set("a b c d e"), jaccard.shingle_set("a b c d"))) == 0


# 3
def test_language(spark):
    rows = [(i, "the quick brown fox and the lazy dog " * (i % 3 + 1) + f"number {i}", "en") for i in range(60)] + [(100 + i, "der schnelle braune fuchs und der faule hund " * (i % 3 + 1) + f"nummer {i}", "de") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where(langid.remainder(5) != 0))
    out = df.where(langid.remainder(5) == 0).withColumn("p", langid.predict(spark, model, F.col("text"))).collect()
    assert out and all(r["p"]["lang_pred"] == r["lang"] and 0 <= r["p"]["score"] <= 1 for r in out)


def test_language_odd(spark, odd, none):
    model = langid.train(odd)
    assert model.languages == []
    got = odd.withColumn("p", langid.predict(spark, model, F.col("text"))).collect()
    assert len(got) == len(ODD) and all(r["p"]["lang_pred"] == "und" and r["p"]["score"] == 0 for r in got)
    assert langid.train(none).languages == [] and langid.stage(spark, none).count() == 0
    trained = langid.train(spark.createDataFrame([(1, "abc def", "en"), (2, "xyz", "de")], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r["p"]["lang_pred"] for r in odd.withColumn("p", langid.predict(spark, trained, F.col("text"))).collect()}
    assert [got[i] for i in (1, 2, 3, 7)] == ["und"] * 4


# 4
def test_chat_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", "a\\b\\\\", "", None, "</turn></turn>### User:", "日本 \U0001f600", LONG]
    turns = [(9, k, ["user", "assistant", "tool", None, "critic </turn>"][k % 5], t) for k, t in enumerate(said)] + [(None, 0, "assistant", "x"), (8, 1, "assistant", "b"), (8, 0, "user", "a"), (8, 1, "assistant", "b")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("body", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df)).collect()}
    for conv in (9, 8, None):
        own = sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "</turn>", "\\</turn>", "### User:### User:", "#\\## User:"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


# 5
def test_decontamination(spark, odd, none):
    rng = np.random.default_rng(2)
    vocabulary = [f"t{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choice(vocabulary, 30))) for i in range(40)] + [(40, None), (41, ""), (42, "only three words"), (0, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = lambda n: " ".join(rng.choice(vocabulary, n))
    rows = [(i, f"{filler(300)} {items[i][1].upper()}. {filler(500)}") for i in range(40)] + [(100 + i, filler(400)) for i in range(40)]
    edited = items[3][1].split()
    edited[10] = "other"
    rows += [(200, filler(100) + " " + " ".join(edited)), (201, " ".join(items[4][1].split()[:15])), (202, "x only three words y")]
    got = {(r["doc_id"], h["item_id"]) for r in decontam.scan(docs(spark, rows), bench).collect() for h in r["hits"]}
    assert got == {(i, i) for i in range(40)} | {(200, 3), (202, 42)}
    assert {(r["doc_id"], h["item_id"]) for r in decontam.scan(docs(spark, rows), bench, max_items=7).collect() for h in r["hits"]} == got
    assert decontam.stage(odd, bench).count() == len(ODD) and decontam.stage(odd, bench.limit(0)).count() == len(ODD) and decontam.stage(none, bench).count() == 0


def test_retrieval_is_exhaustive():
    rng = np.random.default_rng(3)
    vocabulary = [f"t{i}" for i in range(60)]
    index = decontam.Index([(i, " ".join(rng.choice(vocabulary, 12))) for i in range(100)])
    dense = np.zeros((len(index.terms), len(index.item_ids)))
    for t in range(len(index.terms)):
        at = slice(index.post_at[t], index.post_at[t + 1])
        dense[t, index.post_item[at]] = index.post_share[at]
    for _ in range(50):
        terms = np.unique(rng.integers(0, len(index.terms), 25))
        score = dense[terms].sum(axis=0)
        assert {i for i, _ in index.retrieve(terms, 0.5)} == set(np.flatnonzero(score >= 0.5 - 1e-9))


# 6
def test_lines(spark):
    base = [" ".join(f"w{(i * 37 + k * 11) % 997}" for k in range(90)) for i in range(8)]
    near = base[0].replace("w11 ", "zz ", 1)
    rows = [(1, f"{base[0]}\n{base[1]}\nshort one"), (2, f"{base[2]}\n{base[0].upper()}\nshort one"), (3, f"{near}\n{base[3]}"), (4, base[1]), (5, None), (6, "")]
    got = {r["doc_id"]: r["drop"] for r in lines.dropped(docs(spark, rows)).collect()}
    sims = {r["doc_id"]: r["sim"] for r in lines.with_simhash(lines.split_lines(docs(spark, [(0, base[0]), (1, near)]))).collect()}
    close = bin((sims[0] ^ sims[1]) & (1 << 64) - 1).count("1") <= lines.DISTANCE
    assert got == {2: [1], 4: [0]} | ({3: [0]} if close else {})
    out = {r["doc_id"]: r["text"] for r in lines.stage(docs(spark, rows)).collect()}
    assert 4 not in out and out[2] == f"{base[2]}\nshort one" and out[5] is None and out[6] == ""


def test_simhash_of_long_lines_is_the_same_in_both_lanes(spark):
    df = lines.split_lines(docs(spark, [(1, " ".join(f"w{i}" for i in range(300)))]))
    assert lines._simhash(df, 4).first()["sim"] == lines._simhash(df, 2).first()["sim"]
    short = df.withColumn("norm", F.expr("array_join(slice(split(norm, ' '), 1, 100), ' ')"))
    assert lines._simhash(short, 8).first()["sim"] == lines._simhash(short, 2).first()["sim"]


def test_block_choices_find_all_close_hashes():
    rng = np.random.default_rng(4)
    for n in (10, 1 << 25, 1 << 30, 1 << 36):
        choices = lines.masks(n)
        for _ in range(200):
            x = int(rng.integers(0, 1 << 62))
            y = x
            for b in rng.choice(64, lines.DISTANCE, replace=False):
                y ^= 1 << int(b)
            assert any(x & m == y & m for m in choices)


def edits(a, b):
    """Edit distance, row by row."""
    row = np.arange(len(b) + 1)
    b = np.array(list(b))
    for i, x in enumerate(a, 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (b != x))))
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


def test_lines_of_enough_edit_similarity_are_found(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnoprstu"), int(rng.integers(2, 10)))) for _ in range(3000)]
    pairs = []
    for k in range(600):
        a = [str(w) for w in rng.choice(vocabulary, (5, 10, 20, 30, 50, 100)[k % 6])]
        b = list(a)
        for at in rng.choice(len(a), max(1, int(len(a) * rng.uniform(0, 0.2))), replace=False):
            b[at] = str(rng.choice(vocabulary)) if k % 2 else b[at][:-1] + "z"
        a, b = " ".join(a), " ".join(b)
        if a != b and edits(a, b) <= (1 - lines.SIMILARITY) * max(len(a), len(b)):
            pairs.append((len(pairs), f"{a}\n{b}"))
    found = {r["doc_id"] for r in lines.dropped(docs(spark, pairs)).collect()}
    assert len(pairs) > 450 and len(found) >= 0.95 * len(pairs)


def test_long_lines_with_characters_put_in(spark):
    rng = np.random.default_rng(9)
    base = "".join(rng.choice(list("abcdefgh "), 20_000))
    near = "#" + base[1:500] + "".join(rng.choice(list("abcdefgh "), 300)) + base[500:-1] + "#"
    far = "#" + base[1:500] + "".join(rng.choice(list("abcdefgh "), 6000)) + base[500:-1] + "#"
    pairs = spark.createDataFrame([(1, 2, base, near), (1, 3, base, far)], "a long, b long, ta string, tb string")
    assert [(r["a"], r["b"]) for r in lines.similar(pairs).collect()] == [(1, 2)]


def test_short_and_unspaced_lines(spark):
    rng = np.random.default_rng(10)
    han = "".join(chr(0x4E00 + int(i)) for i in rng.integers(0, 3000, 200))
    near = han[:60] + "日" + han[61:150] + "本" + han[150:]
    rows = [(1, f"All rights reserved.\nChapter 10\n{han}"), (2, f"{han}\nall  rights reserved."), (3, f"{near}\nChapter 11\n}}"), (4, "}\n" + han[::-1])]
    assert {r["doc_id"]: r["drop"] for r in lines.dropped(docs(spark, rows)).collect()} == {2: [0, 1], 3: [0]}


def test_lines_odd(spark, odd, none):
    assert lines.stage(odd).count() == len(ODD)
    assert lines.stage(none).count() == 0


# 7
def test_mixing(spark, odd, none):
    rows = [(i, "w " * (i % 7 + 1), "big" if i % 3 else f"s{i % 5}") for i in range(3000)] + [(9000, None, None), (9001, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("full", F.lit(1))
    a = mixing.mix(df, blocks=16)
    got = a.collect()
    words = {i: len((t or "").split()) for i, t, _ in rows}
    total = sum(words.values())
    used = Counter()
    for r in got:
        used[r["source"]] += words[r["doc_id"]]
    tokens = Counter()
    for i, t, s in rows:
        tokens[s or ""] += words[i]
    want = mixing.weights(tokens, mixing.solve(tokens, total, mixing.ENTROPY, mixing.MAX_EPOCHS))
    for s, n in used.items():
        if s:
            assert want[s] * total - 8 <= n <= want[s] * total + 1
    assert mixing.entropy(want) >= mixing.ENTROPY * np.log(sum(n > 0 for n in tokens.values())) - 1e-6 or max(want[s] * total / n for s, n in tokens.items() if n) > mixing.MAX_EPOCHS - 1e-6
    key = lambda rs: sorted((r["doc_id"], r["mix_epoch"], r["mix_block"], r["mix_order"]) for r in rs)
    assert key(got) == key(mixing.mix(df.repartition(5), blocks=16).collect())
    epochs = defaultdict(set)
    for r in got:
        assert r["mix_epoch"] not in epochs[r["doc_id"]]
        epochs[r["doc_id"]].add(r["mix_epoch"])
    assert mixing.mix(none).count() == 0 and mixing.mix(odd).count() > 0


# 8
def test_pii_against_plain_patterns():
    plain = (
        (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
        (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
        (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 14 <= len(d := re.sub(r"[^0-9]", "", s)) <= 19 and pii.luhn(d)),
        (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 10 <= len(re.sub(r"[^0-9]", "", s)) <= 15),
    )
    rng = np.random.default_rng(5)
    pieces = ["1", "2", "255", ".", "-", " ", "@", "a", ".", "+", "(", ")", "_", "\n", "4111111111111111"]
    for _ in range(5000):
        t = "".join(rng.choice(pieces, int(rng.integers(1, 25))))
        assert pii.base_spans(t) == sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(plain) for m in p.finditer(t) if ok(m[0]))


def test_pii_field_carries_labels():
    base, spans = pii.find("+14565552186 then 14565552186 and 2021 and 42", pii.model())
    assert base == [(0, 3, 12)] and spans == [(0, 3, 12), (18, 3, 29)]
    assert pii.find("in 2021 we had 42 of 7,000", pii.model())[1] == []


def test_pii_field_carries_labels_over_many_mentions():
    for text in ("+467788428984934 then " + "467788428984934 so " * 50, "467788428984934 so " * 50 + "+467788428984934"):
        phone = pii.marginals(pii.Graph(text, pii.base_spans(text)), *pii.model())[:, pii.LABELS.index("phone")]
        alike = np.delete(phone, text.split().index("+467788428984934") // 2)
        assert len(alike) == 50 and (alike > 0.5).all() and np.ptp(alike) < 1e-3


def test_pii_odd(spark, odd, none):
    assert all(r["f"]["spans"] == [] for r in odd.where("doc_id < 7").select(pii.scan(spark, F.col("text")).alias("f")).collect())
    assert none.select(pii.scan(spark, F.col("text"))).count() == 0


# 9
def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(400)]
    rows += [(400 + i, rows[50][1]) for i in range(60)] + [(1000, None), (1050, []), (1100, [1.0, None]), (1150, [float("nan")] * 16), (1200, [float("inf")] * 16), (1250, [0.5] * 3), (1251, [0.25] * 3), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in knn.top_k(knn.quantised(df), F.col("vec_id") % 50 == 0, block=3).collect()}
    known = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = {}
    for q in known:
        if q % 50 == 0:
            best = sorted((-int(known[q] @ v), i) for i, v in known.items() if i != q and len(v) == len(known[q]))[:5]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert knn.top_k(knn.quantised(df.limit(0)), F.lit(True)).count() == 0


# 10
def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(7)
    clean, bad = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"], ["vilest", "foulest", "rottenish"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        rows.append((i, " ".join([*rng.choice(clean, 30), *(rng.choice(bad, 3) if toxic else [])])))
        labels.append((i, 1, int(toxic)))
    lab = spark.createDataFrame(labels + [(5000, 1, 1), (None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(spark, rows), lab.where(langid.remainder(3) != 1))
    out = docs(spark, rows).where(langid.remainder(3) == 1).withColumn("s", toxicity.score(spark, model, F.col("text"))).collect()
    right = sum((r["s"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in out)
    assert right >= 0.97 * len(out)
    assert all(0 <= r["s"] <= 0.7 for r in odd.select(toxicity.score(spark, model, F.col("text")).alias("s")).collect())
    assert toxicity.train(none, lab.limit(0)).score("x") <= 0.5


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 105), (105, 103), (200, 200)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 103: 100, 105: 100}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_with_repeated_doc_ids(spark):
    x = " ".join(f"x{i}" for i in range(50))
    rows = [(1, x), (2, x + " extra"), (2, " ".join(f"y{i}" for i in range(90))), (3, x + " extra2")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs(spark, rows)).collect()}
    assert got == {1: (46, 1), 2: (47, 1), 3: (47, 1)}


def test_shingles_of_words_that_polynomials_confuse():
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    words = ["w1", "w2", a, "w3", "w4", "w1", "w2", b, "w3", "w4"]
    want = {tuple(words[i : i + 5]) for i in range(6)}
    assert len(jaccard.shingle_set(" ".join(words))) == len(want) == 6
    hashes = [jaccard.shingle_set(w)[0] for w in ("a", "ab", "a" * 8, "a" * 9, "a" * 16, "a" * 32, "a" * 33, "a\0", "a" * 8 + "\0")]
    assert len(set(hashes)) == len(hashes)
    assert jaccard.shingle_set("x " + "a" * 9)[0] == jaccard.shingle_set("X  " + "A" * 9)[0]
