"""Operators against brute-force versions on small tables with every odd case."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import (
    decontamination,
    licenses,
    packing,
    pii,
    quality_model,
    quality_rules,
    sharding,
    simhash,
    substrings,
    toxicity,
)
from tessera.llm.common import components, gapless_rank, intermediate, single_spaces
from tessera.llm.queries import OPERATORS, oracle_sql, queries, word_tokenizer

SF = "/root/testdata/sf0.001"
#: Columns of `documents` and some whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, component_id long, shard int, words string, h string, base string, size long, digest string, text_hash long, host string, kept boolean"
WS = r"[^\x20\x09-\x0D]+"


def odd_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "er", "tion", "ou", "Le", "é"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(40)
    texts = [None, None, "", "", "   \n\t ", "one", "a b c", "a b c", "\x00", "🙂 é́ x", "x" * 5000, "ab " * 3000, "\n".join(["same line"] * 20)]
    texts += [prose(30) + " " + passage + " " + prose(10) for _ in range(4)]
    texts += [prose(60)] * 5
    texts += [prose(rng.randint(1, 120)) for _ in range(30)]
    base = prose(80).split()
    for i in range(8):
        near = list(base)
        near[i * 7 % 80] = word()
        texts.append(" ".join(near))
    texts += ["mail a.b@c-d.org or x@y_z.com, @none@, a@b.c_d@e.f", "10.0.0.1 300.1.1.1 1.2.3 1.2.3.4.5 0255.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112 and +1 (234) 555-6789.", "+49 30 1234567890123456 +1 +12 +123456789-"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"src{i % 3}", None, 0.9, 7, -1, 3, "w", "h", "b", 9, "d", 1, "x", False) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def labels_of(spark, texts):
    return spark.createDataFrame([(i, k % 3 and 1, k % 2) for k, i in enumerate(texts)] + [(None, 1, 1), (10**9, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")


# 1


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def spans(text):
    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            total = sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits)))
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    found = [(m.start(), r, k, m.end()) for r, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if good(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_pii_base(spark, docs, texts):
    got = rows_of(pii.personal_data(docs))
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert got[i]["base_sha256"] == hashlib.sha256(spans(t).encode()).hexdigest(), t
        assert sum(got[i][f"n_{k}"] for k in PATTERNS) == len(list(filter(None, spans(t).split(","))))


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="a1.@+- ()25\n🙂", max_size=60), min_size=30, max_size=60))
def test_pii_random(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.base_spans(df).select("doc_id", pii.base_array().alias("base")).select("doc_id", pii._digest("base").alias("spans"))
    for i, r in rows_of(found).items():
        assert r["spans"] == spans(texts[i]), texts[i]


def test_pii_bootstrap(spark):
    seeds = [(i, f"please call +1 (234) 555-{1000 + i} today") for i in range(20)]
    df = spark.createDataFrame([*seeds, (50, "please call 7788-ABC-99 today"), (51, "in year 19999-2000 nothing")], "doc_id long, text string")
    got = rows_of(pii.personal_data(df))
    assert got[50]["spans"] == "other:12:23" and got[50]["n_other"] == 1
    assert got[51]["spans"] == ""


def test_pii_common_words_stay_unknown(spark):
    rows = [f"please call +1 (234) 555-{1000 + i} today" for i in range(20)]
    rows += [f"so the +1 (234) 555-{2000 + i} now" for i in range(20)]
    rows += [f"so the x12345{i} now" for i in range(200)]
    rows += ["please call 7788-ABC-99 today", "so the 7788-ABC-99 now"]
    # What any word may follow is no pattern, even if no other identifier does.
    rows += [f"this is of the +1 (234) 555-{3000 + i} kind that" for i in range(20)]
    rows += ["this is of the word kind that"] * 60 + ["this is of the st0pid kind that"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = rows_of(pii.personal_data(df))
    assert {i for i, r in got.items() if r["n_other"]} == {240, 241}


def test_pii_labels_and_rounds(spark):
    secret = lambda i: hashlib.sha256(str(i).encode()).hexdigest()[:40]
    rows = [(f"w{i} token = \"{secret(i)}\" v{i}", 1) for i in range(400)]
    rows += [(f"your pin code is {secret(i)} as of now", 1) for i in range(40)]
    rows += [("ab token=\"short7\" and", 1), (f"lonely {secret(999)} words", 0), ("hm, your pin code is 0151 234 5678 as of now", 1), ("plain words 123456 here", 0), (None, 0), ("", 0)]
    # A second round: found by the first label, these make another one.
    rows += [(f"x{i} token = \"pq{i}rs7\" y", 1) for i in range(30)] + [(f"then account: pq{i}rs7, z{i}", 1) for i in range(30)] + [("last account: zz12yy", 1)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = rows_of(pii.personal_data(df))
    assert [got[i]["n_other"] for i in range(len(rows))] == [n for _, n in rows]
    assert got[440]["spans"] == "other:10:16" and got[442]["spans"] == "other:21:34"
    first = rows_of(pii.personal_data(df, max_rounds=1))
    assert [first[i]["n_other"] for i in range(len(rows))] == [n for _, n in rows[:-1]] + [0]


def test_pii_of_nothing(empty):
    assert pii.personal_data(empty).count() == 0


def test_pii_finds_the_secrets_of_the_tables(spark):
    from tessera.llm.common import table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = rows_of(pii.personal_data(docs))
    planted, found = 0, 0
    for d in docs.collect():
        want = {m.span(1) for m in re.finditer(r'(?:token = "|password=)([0-9a-f]+)', d["text"] or "")}
        have = {tuple(map(int, x.split(":")[1:])) for x in got[d["doc_id"]]["spans"].split(",") if x.startswith("other")}
        assert have <= want
        planted, found = planted + len(want), found + len(have)
    assert found >= 0.9 * planted > 10


# 2


def test_quality_two_grades_held_out(spark):
    from tessera.llm.common import table

    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = rows_of(quality_model.classify(docs, quality_model.fit(docs, labels)))
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = sum(got[r["doc_id"]]["kept"] == bool(r["quality"]) for r in held)
    assert right / len(held) > 0.9


def test_quality_ordered_grades(spark):
    rng = random.Random(1)
    rows, ratings = [], []
    for i in range(400):
        grade = i % 4
        rows.append((i, " ".join(rng.choice(["good"] * (1 + 3 * grade) + ["bad"] * (10 - 3 * grade)) for _ in range(60))))
        ratings.append((i, grade))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_model.fit(df, spark.createDataFrame(ratings, "doc_id long, quality int"))
    assert (np.diff(model.thresholds) > 0).all()
    got = rows_of(quality_model.classify(df, model, least_grade=2))
    mean = [np.mean([got[i]["expected_grade"] for i in range(g, 400, 4)]) for g in range(4)]
    assert mean == sorted(mean) and mean[3] - mean[0] > 2
    assert np.mean([got[i]["kept"] == (i % 4 >= 2) for i in range(400)]) > 0.9


def test_quality_fit_is_flat():
    """The slopes of the penalised likelihood, by differences, are near zero at the fitted weights."""
    rng = np.random.default_rng(3)
    n = 200
    cols = rng.choice([5, 9, 11, 70], (n, 2))
    rows, values = np.repeat(np.arange(n), 2), np.ones(2 * n)
    effect = {5: -1.0, 9: 0.5, 11: 1.0, 70: 0.0}
    z = np.array([sum(effect[c] for c in r) for r in cols.tolist()]) + rng.logistic(size=n)
    y = (z > -0.5).astype(int) + (z > 0.8)

    def loss(w, t):
        s = np.array([w[r].sum() for r in cols])
        p = np.concatenate((np.ones((n, 1)), 1 / (1 + np.exp(t[None, :] - s[:, None])), np.zeros((n, 1))), 1)
        return -np.log(p[np.arange(n), y] - p[np.arange(n), y + 1]).mean() + 0.5 * 1e-4 * (w**2).sum()

    w, t = quality_model.fit_ordinal(rows, cols.ravel(), values, y, epochs=2000)
    assert set(np.flatnonzero(w)) <= {5, 9, 11, 70} and t[0] < t[1]
    for k in (5, 9, 11, 70):
        step = np.zeros_like(w)
        step[k] = 1e-4
        assert abs(loss(w + step, t) - loss(w - step, t)) / 2e-4 < 1e-3
    for k in (0, 1):
        step = np.zeros(2)
        step[k] = 1e-4
        assert abs(loss(w, t + step) - loss(w, t - step)) / 2e-4 < 1e-3


def test_quality_scores_against_loops(spark):
    rng = np.random.default_rng(5)
    model = quality_model.Model([0, 2, 3], rng.normal(size=quality_model.BUCKETS), np.array([-0.5, 0.7]))
    texts = ["some Words here 12 x", "", None, "ONE one\n\none one", "a " * 300]
    got = rows_of(quality_model.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, least_grade=3))
    for i, t in enumerate(texts):
        words = (t or "").split()
        z = sum(model.weights[b] for w in words for b in quality_model.word_features(w)) / max(len(words), 1)
        z += sum(model.weights[b] for b in quality_model.text_features(t or "", words))
        above = [1 / (1 + np.exp(c - z)) for c in model.thresholds]
        assert got[i]["expected_grade"] == pytest.approx(2 * above[0] + above[1])
        assert got[i]["tail_prob"] == pytest.approx(above[1]) and got[i]["kept"] == (got[i]["tail_prob"] >= 0.5)


def test_quality_odd(spark, docs, texts, empty):
    model = quality_model.fit(docs, labels_of(spark, texts))
    assert len(rows_of(quality_model.classify(docs, model))) == len(texts)
    none = quality_model.fit(docs, labels_of(spark, texts).limit(0))
    assert all(r["kept"] for r in quality_model.classify(docs, none).collect())
    assert quality_model.classify(empty, quality_model.fit(empty, labels_of(spark, texts))).count() == 0


# 3


def without_repeats(texts):
    first = {}
    for i in sorted(texts):
        raw = texts[i].encode()
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], i)
    out = {}
    for i, t in texts.items():
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(raw)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("block, hot", [(1 << 20, substrings.HOT), (3000, 2)])
def test_substrings(docs, texts, block, hot):
    got = rows_of(substrings.remove_repeats(docs, block, hot))
    assert {i: tuple(r)[1:] for i, r in got.items()} == without_repeats(texts)


def test_substrings_of_repetitive_texts(spark):
    """Strings of a run of one character share a minimizer, however long it is."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    rows = ["a" * (3000 + i) for i in range(12)]
    rows += [" ".join(word() for _ in range(20)) + "-" * rng.randint(40, 900) for _ in range(60)]
    rows += ["".join(rng.choice("ab-") * rng.randint(1, 70) for _ in range(8)) for _ in range(60)]
    rows += ["".join(rng.choice(["ab", "abc-", "-"]) * rng.randint(1, 40) for _ in range(6)) for _ in range(60)]
    texts = dict(enumerate(rows))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for hot in (substrings.HOT, 2000):
        got = rows_of(substrings.remove_repeats(df, 9000, hot))
        assert {i: tuple(r)[1:] for i, r in got.items()} == without_repeats(texts)


def test_substrings_large_repetitive_texts(spark):
    df = spark.range(200).selectExpr("id as doc_id", "repeat('a', cast(100000 + id as int)) as text")
    got = rows_of(substrings.remove_repeats(df))
    assert [got[i]["n_removed"] for i in range(200)] == [0, *(100000 + i for i in range(1, 200))]
    tails = spark.range(3000).selectExpr("id as doc_id", "concat(sha2(cast(id as string), 256), repeat('-', cast(9000 + id as int))) as text")
    got = rows_of(substrings.remove_repeats(tails))
    assert got[0]["n_removed"] == 0
    assert all(9000 + i <= got[i]["n_removed"] <= 9010 + i for i in range(1, 3000))


def test_substrings_of_nothing(empty):
    assert substrings.remove_repeats(empty).count() == 0


def test_substrings_merge_is_sorted():
    rng = random.Random(4)
    strings = ["".join(rng.choice("ab\0") for _ in range(rng.randint(50, 140))).encode() for _ in range(25)]
    strings += [strings[0][10:] + b"aa", strings[3][:60]]
    docs = np.arange(len(strings))
    low = substrings.smallest_documents(strings, docs, 4)
    at = 0
    for s in strings:
        for p in range(len(s) - 49):
            assert low[at + p] == min(i for i, o in enumerate(strings) if s[p : p + 50] in o)
        at += len(s) + 1


def test_substrings_repeated_ids(spark):
    t = "abcdefghij" * 12
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (7, t + "zz")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 99, r["n_removed"]) for r in substrings.remove_repeats(df).collect())
    assert got == [(5, 0), (5, 0), (7, 120), (99, 120)]


# 4


def test_line_rules_base(docs, texts):
    got = rows_of(quality_rules.line_rules(docs))
    assert set(got) == set(texts)
    for i, t in texts.items():
        words = re.findall(WS, t)
        windows = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {p for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search(WS, x)]
        want = (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])


def test_line_rules_removes_boilerplate(spark):
    unique = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, f"Subscribe to our  newsletter now\n{unique(i, 30 if i % 2 else 3)} a b c d e f g h", "host") for i in range(40)]
    rows += [(100 + i, "copy " + unique(7, 40), "other") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = rows_of(quality_rules.line_rules(df))
    assert all(got[i]["lost_lines"] == 1 for i in range(40))
    assert all(got[i]["kept"] == i % 2 for i in range(40))
    assert not any(got[100 + i]["kept"] for i in range(40))
    got = rows_of(quality_rules.line_rules(df, copies=False))
    assert all(got[i]["kept"] == i % 2 for i in range(40)) and all(got[100 + i]["kept"] for i in range(40))


def test_line_rules_against_loops(spark, empty):
    rng = random.Random(9)
    stock = [" ".join(f"s{rng.randrange(400)}" for _ in range(rng.randint(1, 6))) for _ in range(60)]
    rows = []
    for i in range(500):
        lines = [rng.choice(stock) if rng.random() < 0.5 else f"own {i} line {k} with several words" for k in range(rng.randint(1, 8))]
        text = None if i == 7 else "\n".join(x.upper() if rng.random() < 0.2 else "  " + x for x in lines)
        rows.append((None if i == 9 else i - i % 50 // 49, text, rng.choice(["a", "a", "a", "b", None])))
    holders = collections.defaultdict(set)
    hosts = collections.defaultdict(set)
    tidy = lambda x: " ".join(x.lower().split())
    for i, t, h in rows:
        if i is not None:
            hosts[h].add(i)
            for x in (t or "").split("\n"):
                holders[h, tidy(x)].add(i)
    got = collections.defaultdict(list)
    for r in quality_rules.line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_docs=20).collect():
        got[r["doc_id"]].append((r["n_words"], r["lost_lines"], r["lost_words"], r["kept"]))
    seen = 0
    for i, t, h in rows:
        lines = [x for x in (t or "").split("\n") if x.split()]
        lost = [x for x in lines if i is not None and len(holders[h, tidy(x)]) > max(10, min(20, 0.01 * len(hosts[h])))]
        words, gone = sum(len(x.split()) for x in lines), sum(len(x.split()) for x in lost)
        chars, less = (sum(len("".join(x.split())) for x in y) for y in (lines, lost))
        windows = collections.Counter(w for k in range(words - 4) for w in [tuple((t or "").split()[k : k + 5])])
        tokens = (t or "").split()
        covered = {p for k in range(words - 4) if windows[tuple(tokens[k : k + 5])] > 1 for p in range(k, k + 5)}
        failed = words < 10 or 100 * len(covered) > 20 * words
        depleted = bool(lost) and (less > 0.5 * chars or words - gone < 10)
        assert (words, len(lost), gone, not failed and not depleted) in got[i]
        seen += bool(lost)
    assert seen > 100
    assert quality_rules.line_rules(empty).count() == 0


# 5


def trigrams(*texts):
    total = np.zeros(1 << 15)
    for t in texts:
        c = np.frombuffer(f" {t} ".encode().translate(toxicity._CODE_BYTES), np.uint8).astype(int)
        total += np.bincount((c[:-2] << 10) | (c[1:-1] << 5) | c[2:], minlength=1 << 15)
    return toxicity.log_model(total)


def readings(text):
    """Every reading of a short word without separators, with the channel's costs."""
    out = [("", 0.0)]
    for k, c in enumerate(text):
        steps = [(c, 0.0)] if c.isalpha() else []
        steps += [(x, toxicity.SWAPPED + (c == "*")) for x in toxicity.LOOKALIKES.get(c, "")]
        if k and c == text[k - 1]:
            steps.append(("", toxicity.REPEATED if c.isalpha() else toxicity.SPACED))
        if not c.isalpha():
            steps.append((c, toxicity.KEPT_SIGN))
        out = [(o + s, p + q) for o, p in out for s, q in steps]
    return out


def test_decode_finds_the_cheapest_reading():
    cost = trigrams(*["the idiot said that this idiot is an idiot"] * 30, *["it is in the tin and on the dot"] * 30)
    code = lambda c: ord(c) - 96 if "a" <= c <= "z" else toxicity._SPACE if c == " " else toxicity._OTHER if c.isalpha() else toxicity._SIGN
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("iidott10!@s") for _ in range(rng.randint(1, 6)))

        def price(reading, channel):
            c = [0, 0, *map(code, reading), 0]
            return channel + sum(float(cost[a, b, d]) for a, b, d in zip(c, c[1:], c[2:], strict=False))

        prices = {}
        for reading, channel in readings(text):
            prices[reading] = min(price(reading, channel), prices.get(reading, np.inf))
        assert prices[toxicity.decode(text, cost)] <= min(prices.values()) + 1e-4


def test_toxicity_of_long_words():
    restorer = toxicity.Restorer(trigrams(*["the idiot said that this idiot is an idiot"] * 30, *["it is in the tin and on the dot"] * 30))
    assert restorer["1d10t"] == restorer["i" * 300 + "d10t"] == restorer["1d1ooo" + "o" * 5000 + "t"] == toxicity._features("idiot")
    assert restorer["1d10t" + "said" * 30] == toxicity._features("idiot" + "said" * 30)


def test_toxicity_of_inflected_words(spark):
    """Endings that no labelled row has; the stem is known."""
    rng = random.Random(14)
    rows, labels = [], []
    for i in range(500):
        words = [rng.choice(["house", "tree", "water", "stone", "light", "idea", "that"]) for _ in range(20)]
        if i % 4 == 0:
            words[3] = "grobl" + "".join(rng.choices("aeiourst", k=4))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    got = rows_of(toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")))
    held = [i for i in got if got[i]["held_out"]]
    assert all(got[i]["predicted"] == (i % 4 == 0) for i in held)


@pytest.mark.parametrize("word", ["1d10t", "i d i o t", "i.d.i.o.t", "idiooot", "idiot"])
def test_decode(word):
    texts = ["the idiot said that this idiot is an idiot"] * 30 + ["it is in the tin and on the dot"] * 30
    total = np.zeros(1 << 15)
    for t in texts:
        c = np.frombuffer(f" {t} ".encode().translate(toxicity._CODE_BYTES), np.uint8).astype(int)
        total += np.bincount((c[:-2] << 10) | (c[1:-1] << 5) | c[2:], minlength=1 << 15)
    assert toxicity.decode(word, toxicity.log_model(total)) == "idiot"


def test_decontamination_makes_canonical_texts_once(spark, capsys):
    """A filter on them would be pushed below their projection and make them a second time."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, ""), (3, " .. ,"), (4, "Ab 5 m")], "doc_id long, text string")
    rows = decontamination.windows(docs, ["doc_id"])
    assert sorted((r["doc_id"], r["at"]) for r in rows.filter("form = 0").collect()) == [(1, 0), (1, 1), (4, 0)]
    rows.explain()
    # The longest unit stands once in each making.
    assert capsys.readouterr().out.count("kilograms|") == 1


def test_single_spaces(spark):
    for given in ("", " ", "\t", "a\tb", "a \t b", "\n\n a  b c\r\n", "\u00a0 a", "a b"):
        got = spark.createDataFrame([(given,)], "c string").select(single_spaces(F.col("c")).alias("x")).first()["x"]
        assert got == re.sub("[\x20\x09-\x0d]+", " ", given)


def test_toxicity_of_few_labels():
    """Eight toxic rows among seventy with three of each insult are enough to rank further rows."""
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 900, 60)).astype(np.int32) for _ in range(70)]
    insults = [(1000, 1001), (1001, 1002), (1002, 1003), (1003, 1000), (1000, 1002), (1001, 1003), (1000,), (1002,)]
    rows = [np.concatenate([r, np.array(insults[i] if i < 8 else (), np.int32)]) for i, r in enumerate(rows)]
    bias, weights = toxicity.fit_words(rows, np.arange(70) < 8)
    score = lambda r: bias + sum(weights.get(int(f), 0.0) for f in r)
    clean = [np.unique(rng.integers(0, 900, 60)) for _ in range(100)]
    toxic = [np.concatenate([r, [1000 + i % 4]]) for i, r in enumerate(clean)]
    assert np.mean([score(a) > score(b) for a in toxic for b in clean]) > 0.9


def test_toxicity_scores_against_plain_sums(spark):
    """A score is the logistic of the bias and the weights of a text's known features, each once; unknown ones are never held."""
    rng = random.Random(11)
    cost = toxicity.log_model(np.ones(1 << 15))
    words = ["idiot", "fool", "nice", "m0ron", "s t u p i d", "d.u.m.b", "a b", "!!!", "looooser", "x"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(60)] + [None, "", " ".join(rng.choice("abcdei") for _ in range(900))]
    everything = toxicity.Restorer(cost)
    full = [everything.features(t) for t in texts]
    known = sorted({f for x in full[:-1] for f in x})[::2]
    model = toxicity.Model(cost, -0.3, {f: rng.uniform(-3, 3) for f in known})
    restorer = toxicity.Restorer(cost, model.weights)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    scores = {r["id"]: r["score"] for r in toxicity.scored(df, model).collect()}
    for i, (t, features) in enumerate(zip(texts, full, strict=True)):
        held = restorer.features(t)
        assert held == features & set(known)
        assert scores[i] == pytest.approx(1 / (1 + np.exp(0.3 - sum(model.weights[f] for f in held))))
    assert len(full[-1]) > 10_000 > len(known)


def test_toxicity_segments_spaced_runs():
    texts = ["you are a moron and a stupid idiot"] * 30 + ["i said that this is the stupid thing that a moron did"] * 30
    total = np.zeros(1 << 15)
    for t in texts:
        c = np.frombuffer(f" {t} ".encode().translate(toxicity._CODE_BYTES), np.uint8).astype(int)
        total += np.bincount((c[:-2] << 10) | (c[1:-1] << 5) | c[2:], minlength=1 << 15)
    restorer = toxicity.Restorer(toxicity.log_model(total))
    found = lambda t, *words: {toxicity._hash(w) for w in words} <= restorer.features(t)
    assert found("you are a m o r o n", "moron")
    assert found("s t u p i d i d i o t", "stupid", "idiot")
    assert found("you are s t u p 1 d and", "stupid")
    for pad in range(6):
        run = "a" * pad + "stupididiotmoron" * 40
        assert found(" ".join(run), "stupid", "idiot", "moron")
    run = " ".join("said" * 15 + "idiot" + "said" * 15)
    assert found(run, "idiot", "said")
    assert found("this i d i o t did", "idiot")


def test_toxicity(spark, docs, texts, empty):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(["house", "tree", "water", "stone", "light", "idea", "that"]) for _ in range(30)]
        if i % 3 == 0:
            words[rng.randrange(30)] = rng.choice(["idiot", "1d10t", "i d i o t", "idiooot", "idiot!!"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = rows_of(toxicity.toxicity(df, marks))
    held = [i for i in got if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([got[i]["predicted"] == (i % 3 == 0) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = rows_of(toxicity.toxicity(docs, labels_of(spark, texts)))
    assert set(odd) == set(texts)
    assert toxicity.toxicity(docs, marks.limit(0)).count() == len(texts)
    assert toxicity.toxicity(empty, marks).count() == 0


# 6


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(word_tokenizer())
    rows = packing.pack(docs, word_tokenizer(), 256).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert set(by) == set(texts)
    for i, t in texts.items():
        ids = np.array([*coder.encode(t, add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(ids) // 256)
        at = 0
        for r in pieces:
            assert r["start"] == at and zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    check_bins(rows, 256)
    assert packing.pack(empty, word_tokenizer()).count() == 0


def check_bins(rows, capacity):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_packing_plan(counts):
    runs, bins = packing.plan(counts, 40)
    rows, placed = [], collections.Counter()
    for size, a, b, per, first, offset in runs:
        assert a == placed[size]
        placed[size] = b
        rows += [{"sequence_id": first + (r - a) // per, "offset": offset + (r - a) % per * size, "length": size} for r in range(a, b)]
    assert placed == collections.Counter(counts)
    assert check_bins(rows, 40) == bins if rows else bins == 0
    least = max(-(-sum(k * n for k, n in counts.items()) // 40), sum(n for k, n in counts.items() if k > 20))
    assert bins <= 1.5 * least + 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet="aAéÉİß's.,!<|>endoftx \u0301ﬁ12", max_size=60), max_size=4))
def test_chunks_equal_whole_texts(texts):
    chunks = packing.coder(word_tokenizer())
    want = [np.array(chunks.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert chunks.encode(texts) == want


# 7


def slow_fingerprint(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    words = re.findall(WS, t)
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), 42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("limit, long_keys", [(8192, 10**6), (3, 10**6), (8192, 0)])
def test_simhash(docs, texts, limit, long_keys):
    got = rows_of(simhash.near_duplicates(docs, limit, long_keys))
    fps = {i: slow_fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == slow_components(fps)


def test_simhash_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("limit, long_keys", [(8192, False), (20, False), (8192, True), (20, True)])
def test_simhash_links_of_clusters(spark, limit, long_keys):
    rng = random.Random(6)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                f ^= 1 << b
            fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = simhash.links(nodes, limit, long_keys)
    crowded = found.filter("b is null").selectExpr("a as fp").distinct()
    pairs = found.filter("b is not null").unionByName(simhash.midpoint_links(crowded))
    roots = {r["node"]: r["root"] for r in components(pairs).collect()}
    want = slow_components(dict(zip(signed, [f % (1 << 64) for f in signed], strict=True)))
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups({f: roots.get(f, f) for f in signed}) == groups(want)


# 8


def test_licenses(spark, docs, empty):
    mit, apache = licenses.TEMPLATES["mit"], licenses.TEMPLATES["apache-2.0"]
    words = mit.split()
    altered = " ".join(words[:40] + ["slightly"] + words[40:])
    half = " ".join(words[: len(words) // 2])
    middle = apache.split()
    middle = " ".join(middle[:35] + [f"inserted{i}" for i in range(80)] + middle[35:])
    rows = [(1, "intro text " + mit.upper() + " outro"), (2, altered), (3, half), (4, None), (5, ""), (6, "x Licensed under CC BY-NC 4.0. y"), (7, "Licensed under nothing at all."), (8, middle), (9, "\u201cReleased\u201d un-der the\n\nMIT (license)!"), (None, mit)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["template_id"]): r["containment"] for r in licenses.scan(df, licenses.template_table(spark)).collect()}
    assert set(got) == {(1, "mit"), (2, "mit"), (6, "cc-by-nc-4.0-line"), (8, "apache-2.0"), (8, "apache-2.0-line"), (9, "mit-line")}
    assert got[1, "mit"] == 1.0 and 0.8 <= got[2, "mit"] < 1 and 0.9 < got[8, "apache-2.0"] < 1
    assert licenses.scan(docs, licenses.template_table(spark)).count() == 0
    assert licenses.scan(empty, licenses.template_table(spark)).count() == 0
    assert licenses.scan(df, licenses.template_table(spark, {})).count() == 0
    assert licenses.scan(df, licenses.template_table(spark, {"e": "", "n": None})).count() == 0


def shingle_set(text):
    words = [w for w in (re.sub(r"[^\w]|_", "", w) for w in text.lower().split()) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


@pytest.mark.parametrize("limit", [licenses.CHOOSE_FOR, 0])
def test_licenses_against_whole_text_containment(spark, monkeypatch, limit):
    """Damaged notices among other words, with and without the test by words."""
    monkeypatch.setattr(licenses, "CHOOSE_FOR", limit)
    rng = random.Random(21)
    rows = []
    for i in range(300):
        words = rng.choice(list(licenses.TEMPLATES.values())).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = [f"w{k}" for k in range(rng.randint(0, 30))]
        rows.append((i, " ".join([*(f"a{k}" for k in range(rng.randint(0, 9))), *words, *(f"b{k}" for k in range(rng.randint(0, 9)))])))
    rows.append((300, None))
    want = {}
    for i, t in rows:
        for name, template in licenses.TEMPLATES.items():
            a, b = shingle_set(template), shingle_set(t or "")
            if a & b and len(a & b) >= 0.8 * len(a):
                want[i, name] = len(a & b)
    got = {(r["doc_id"], r["template_id"]): r["matched"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.template_table(spark)).collect()}
    assert got == want and len(want) > 150


# 9


def test_sharding(docs, texts, empty):
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(texts)
    by_text = collections.defaultdict(set)
    slots = collections.defaultdict(list)
    for r in got:
        t = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 8, zlib.crc32(t.encode()))
        by_text[t].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty).count() == 0


def slow_schedule(sizes, shards):
    loads = [0] * shards
    for size, n in sorted(sizes, reverse=True):
        for _ in range(n):
            loads[loads.index(min(loads))] += size
    return loads


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 200), max_size=12), st.integers(1, 7))
def test_schedule_is_that_of_single_groups(sizes, shards):
    placed = list(sharding.placements(sorted(sizes.items(), reverse=True), shards))
    assert {size: n for size, n, _ in placed} == sizes
    assert all(sum(taken) == n and min(taken) >= 0 for _, n, taken in placed)
    assert [sum(size * taken[s] for size, _, taken in placed) for s in range(shards)] == slow_schedule(sizes.items(), shards)


@pytest.mark.parametrize("sizes", [0, 100_000])
def test_sharding_with_and_without_broadcast(spark, monkeypatch, sizes):
    """The plan's rows meet their groups by broadcast or by a shuffle; some sizes are common."""
    monkeypatch.setattr(sharding, "BROADCAST_SIZES", sizes)
    monkeypatch.setattr(sharding, "BLOCK", 3)
    texts = [f"{i:04d}" for i in range(900)] + ["x" * (i % 40) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard(df, 5).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(1200))
    groups = collections.Counter()
    for t in set(texts):
        groups[(len(t) + 8) * texts.count(t)] += 1
    loads = collections.Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert [loads[s] for s in range(5)] == slow_schedule(groups.items(), 5)
    for s in range(5):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert len({(texts[r["doc_id"]], r["shard"]) for r in rows}) == len(set(texts))


def test_sharding_loads(spark):
    texts = [f"text {i % 1500} " * (i % 17) for i in range(2000)] + ["the same"] * 3000
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    loads, shard_of = collections.Counter(), collections.defaultdict(set)
    for r in sharding.shard(df, 5).collect():
        loads[r["shard"]] += r["size"]
        shard_of[texts[r["doc_id"]]].add(r["shard"])
    groups = collections.Counter()
    for t in texts:
        groups[t] += len(t) + 8
    sizes = collections.Counter(groups.values())
    assert sorted(loads.values()) == sorted(slow_schedule(sizes.items(), 5))
    assert all(len(x) == 1 for x in shard_of.values())


def test_gapless_rank(spark):
    df = spark.createDataFrame([("a", i) for i in range(500)] + [("b", i) for i in range(3)], "k string, o long")
    got = gapless_rank(df, "k", ["o"], {"a": 500, "b": 3}, "r", rows=40).collect()
    assert sorted(r["r"] for r in got if r["k"] == "a") == list(range(500))
    assert sorted(r["r"] for r in got if r["k"] == "b") == [0, 1, 2]


# 10


ITEMS = [(1, "If Alice has 3 apples and Bob gives her 5 kg of pears, how many fruits does Alice have after 3 days?"), (2, "a short one"), (3, None), (4, ""), (5, "No?"), (6, "== -- ==")]


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [
        (1, "so. If Carol has 7 apples and Dave gives her 9 kg of pears, how many fruits does Carol have after 7 days? yes"),
        (2, "so. If Carol has 7 apples and Dave gives her 9 kg of pears, how many fruits does Erin have after 8 days? yes"),
        (3, None),
        (4, "a short one"),
        (5, "there is a short one in here"),
        (6, ITEMS[0][1].upper()),
        (7, "=" * 80 + " no end\nIf Carol has 7 apples and Dave gives her 9 kg of pears == how many fruits does Carol have after 7 days? yes"),
        (8, ITEMS[0][1].upper().replace("3", "17").replace("5", "6")),
        (9, "no"),
        (10, "no, and here are many other words"),
        (11, "-- == !!"),
        (12, "if  Carol has\t7 apples, and Dave gives her 9 KG of pears... how many fruits does Carol have after 7 days"),
        (None, ITEMS[0][1]),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(df, items).collect()}
    assert got == {(1, 1), (4, 2), (5, 2), (6, 1), (7, 1), (8, 1), (9, 5), (12, 1)}
    assert decontamination.contaminated(docs, items).count() == 0
    assert decontamination.contaminated(empty, items).count() == 0
    assert decontamination.contaminated(df, items.limit(0)).count() == 0


def test_decontamination_verbatim_copies(spark):
    items = [(1, "Tall trees grow near rivers here"), (2, "She bought 12, then sold 12 of those old red apples again")]
    docs = [(1, "a line without end\nTall trees grow near rivers here"), (2, "yes: She bought 12 then sold 12, of those old red apples again")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 2)}


def test_decontamination_of_mostly_placeholders(spark):
    items = spark.createDataFrame([(1, "Solve 12 + 7"), (2, "is 12 34 56 78 90 then")], "item_id long, text string")
    docs = [(1, "Solve 12 + 7"), (2, "so what is 12 34 56 78 90 then or not"), (3, "so what is 13 35 57 79 91 then or not"), (4, "please solve 12 + 7 now or later")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["matched"], r["windows"]) for r in decontamination.contaminated(df, items).collect()}
    assert got == {(1, 1, 1, 1), (2, 2, 3, 3), (4, 1, 1, 1)}


def slow_contaminated(doc, item):
    """Windows of words with numbers as placeholders, by loops; every item here has plain words and numbers only."""
    split = lambda t: [w for w in (re.sub(r"[^\w]|_", "", w) for w in t.lower().split()) if w]
    a, b = split(item), split(doc)
    kind = lambda w: "#" if w.isdigit() else w
    pairs = collections.defaultdict(lambda: collections.defaultdict(set))
    places = collections.defaultdict(set)
    written = set()
    for i in range(len(a) - 4):
        for j in range(len(b) - 4):
            x, y = a[i : i + 5], b[j : j + 5]
            if x == y:
                written.add(i)
            if list(map(kind, x)) == list(map(kind, y)) and sum(w.isdigit() for w in x) <= 2:
                places[j - i].add(i)
                for u, v in zip(x, y, strict=True):
                    if u.isdigit():
                        pairs[j - i][u].add(v)
    matched = set(written)
    for shift, found in places.items():
        if all(len(v) == 1 for v in pairs[shift].values()):
            matched |= found
    typed = {i for i in range(len(a) - 4) if sum(w.isdigit() for w in a[i : i + 5]) <= 2}
    return bool(typed) and len(matched & typed) >= 0.8 * len(typed) or len(matched) >= 0.8 * (len(a) - 4)


def test_decontamination_slots_against_loops(spark):
    rng = random.Random(12)
    vocabulary = ["red", "blue", "tree", "stone", "river", "light", "house", "cold"]
    items = []
    for i in range(12):
        words = [str(rng.randint(1, 4)) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randint(6, 18))]
        items.append((i, " ".join(words)))
    docs = []
    for d in range(240):
        words = items[d % 12][1].split()
        new = {str(n): str(rng.randint(1, 9)) for n in range(1, 5)}
        if d % 3:
            words = [new.get(w, w) for w in words]
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice([*vocabulary, "5"])
        docs.append((d, " ".join([*rng.choices(vocabulary, k=3), "=" * rng.choice([1, 70]), *words, "- ,", *rng.choices(vocabulary, k=3)])))
    want = {(d, i) for d, x in docs for i, t in items if slow_contaminated(x, t)}
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 60
    planted = {(d, d % 12) for d in range(240) if d % 3 == 1}
    assert len(planted & want) < len(planted)  # some lost words to the changes


NAMES = ["Maria", "Boston", "Peter", "Paris", "Anna", "Oslo", "Tom", "Rome", "Clara", "Lima"]
PLACES = ["New York", "Los Angeles", "San Marino", "Buenos Aires"]


def question(rng):
    """A question with three names, three numbers and two units: its words, and where they are."""
    filler = "buys sells carries measures stores counts finds mixes fills moves red old cold large small boxes bags jars crates rolls then later before after with from into under".split()
    words = ["In", "town", "a", "trader", "called"]
    for kind in rng.sample(["name", "name", "name", "number", "number", "unit", "unit"], 7):
        if kind == "name":
            words.append(rng.choice(NAMES))
        else:
            words.append(str(rng.randint(2, 900)))
            if kind == "unit":
                words.append(rng.choice(["km", "hours", "dollars", "liters"]))
        words += rng.sample(filler, rng.randint(2, 4))
    return words


def other(rng, words, names=(), numbers=True):
    """The question with each name and number replaced by another, the same one each time."""
    new = {}
    for w in words:
        if w in NAMES and names:
            new.setdefault(w, rng.choice([n for n in names if n != w]))
        elif w.isdigit() and numbers:
            new.setdefault(w, str(rng.randint(2, 900)))
    return [new.get(w, w) for w in words]


def test_decontamination_recall(spark):
    """Recall on 500 copies of each kind, and no hit among as many documents of the same words."""
    rng = random.Random(77)
    items = [(i, question(rng)) for i in range(500)]
    kinds = {
        "as written": lambda w: w,
        "other numbers": lambda w: other(rng, w),
        "other names": lambda w: other(rng, w, NAMES, numbers=False),
        "other names and numbers": lambda w: other(rng, w, NAMES),
        "lower case": lambda w: [x.lower() for x in w],
        "lower case, other numbers": lambda w: [x.lower() for x in other(rng, w)],
        "capitals, other numbers": lambda w: [x.upper() for x in other(rng, w)],
        "names of two words": lambda w: other(rng, w, PLACES),
        "money as a sign": lambda w: re.sub(r"([0-9]+) dollars", r"$\1", " ".join(other(rng, w))).split(),
        "lower case, other names": lambda w: [x.lower() for x in other(rng, w, NAMES)],
    }
    docs, wanted = [], {}
    for kind, change in kinds.items():
        for i, words in items:
            wanted[len(docs)] = kind, i
            docs.append((len(docs), "so it was said. " + " ".join(change(words)) + ". and nothing else"))
    for _ in range(500):
        words = question(rng)
        rng.shuffle(words)
        docs.append((len(docs), " ".join(words)))
    found = decontamination.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    )
    hits = {(r["doc_id"], r["item_id"]) for r in found.select("doc_id", "item_id").collect()}
    recall = collections.Counter(wanted[d][0] for d, i in hits if d in wanted and wanted[d][1] == i)
    print({k: recall[k] / 500 for k in kinds}, len([d for d, _ in hits if d not in wanted]))
    assert all(recall[k] >= 450 for k in list(kinds)[:9])
    assert not [d for d, _ in hits if d not in wanted]


def test_decontamination_beyond_the_broadcast(spark, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame([(1, "so. " + ITEMS[0][1]), (2, "nothing of that kind in here")], "doc_id long, text string")
    for hashes in (1_000_000, 0):
        monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
        monkeypatch.setattr(decontamination, "BROADCAST_HASHES", hashes)
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(df, items).collect()}
        assert got == {(1, 1)}


def test_decontamination_passages(spark):
    from tessera.llm.common import table

    docs, items = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()}
    texts, passages = docs.select("doc_id", "text").collect(), items.collect()
    assert got == {(d["doc_id"], b["item_id"]) for d in texts for b in passages if b["text"][20:70] in d["text"]}


# pipeline


def test_pipeline_loses_no_text_of_a_shared_id(spark):
    a, b, c = "one text about a river and a stone", "quite another text, which occurs only once in here", "the third of these has different words again"
    rows = [(3, a, "x", 1), (5, a, "y", 2), (5, b, "y", 3), (7, c, "z", 4), (5, b, "y", 3), (None, c + " not", "n", 5), (8, None, "o", 6), (8, b + " and more words follow here", "o", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, fingerprint long")
    kept = sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()), key=str)
    assert kept == sorted([rows[0], rows[2], rows[3], rows[5], rows[6], rows[7]], key=str)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(1, "so: " + item, "s", 1), (1, a, "s", 2), (2, b, "s", 3), (3, item, "s", 4), (None, item, "s", 5), (1, b, "s", 6)]
    kept = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows, df.schema), SF)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[2], rows[4], rows[5]], key=str)


def test_pipeline_stages(spark, docs, texts, empty, tmp_path):
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes, name
    rows = out.collect()
    comps = slow_components({i: slow_fingerprint(t) for i, t in texts.items()})
    assert {r["doc_id"] for r in rows} <= set(comps.values())
    masked = [r for r in rows if "<email>" in (r["text"] or "")]
    assert masked and all(r["n_chars"] == len(r["text"]) and r["score"] == 0.9 for r in masked)
    assert corpus_pipeline.STAGES[-1][1](spark, out, SF).count() >= len(rows)
    nothing = empty
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, SF)
    assert nothing.count() == 0


def test_pipeline_masks(spark):
    df = spark.createDataFrame([(1, "write to a@b.org and 10.0.0.1.", 30), (2, "none", 4), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.mask_personal_data(spark, df, SF).collect()}
    assert got == {1: ("write to <email> and <ip>.", 26), 2: ("none", 4), 3: (None, None)}


def test_near_duplicates_keep_one(spark):
    df = spark.createDataFrame([(4, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (9, "other words in this text"), (None, "lonely row")], "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, df, SF)
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 2, 9]


@pytest.mark.parametrize("f", OPERATORS, ids=lambda f: f.__name__)
def test_queries_run(spark, f):
    assert f(spark, SF).count() > 0


@pytest.mark.parametrize("key", sorted(oracle_sql()))
def test_queries_against_sql(spark, key):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    want = con.execute(oracle_sql()[key]).df()
    got = queries()[key](spark, folder).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    # Whole numbers beside nulls are floats in one frame and nullable in the other.
    full = [c for c in got.columns if not got[c].isna().any()]
    told = lambda x: "null" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)
    plain = lambda df: sorted(tuple(map(told, row)) for row in df[sorted(df.columns)].itertuples(index=False))
    assert plain(got) == plain(want) and len(want) > 10
    assert {c: str(got[c].dtype) for c in full} == {c: str(want[c].dtype) for c in full}


def test_pipeline_runs(spark):
    before = intermediate()
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert intermediate() == before
