"""Spelling variants, conversation repair and the language model against plain versions."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import conversations, language_model, spelling
from tessera.llm.queries import queries

from .test_operators import SCHEMA, SF, docs, empty, odd_texts, rows_of  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 11
def plain_words(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(CAPITALS)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_near(a, b):
    """Words one edit from a, listed by all edits of the shorter over the letters of the longer."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(words):
    out, form = {}, {}
    for w, n in words.items():
        near = [v for v in words if plain_near(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = len(near)
    found = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        found[w] = (form[w], root, n, out[w], words[form[w]] if form[w] else None)
    return found


def told(df):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_spelling_against_loops(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert told(spelling.spelling_variants(docs)) == plain_forms(plain_words(rows))


def test_spelling_query_against_loops(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    words = plain_words(rows)
    found = told(queries()["op11_spelling"](spark, SF))
    assert {w: x[2] for w, x in found.items()} == words
    index = collections.defaultdict(set)
    for w in words:
        for x in spelling.deletions(w):
            index[x].add(w)
    near = {w: [v for v in set().union(*(index[x] for x in spelling.deletions(w))) if plain_near(w, v)] for w in words}
    assert {w: x[3] for w, x in found.items()} == {w: len(v) for w, v in near.items()}
    for w, (form, root, n, _, form_n) in found.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        best = best if best is not None and words[best] >= 2 * n else None
        assert (form, form_n) == (best, words.get(best))
        assert root == (found[form][1] if form else w)


@pytest.mark.parametrize("capacity", [7, 40, None])
def test_spelling_crowded_segments_and_squares_of_shards(spark, capacity):
    """Few letters, so that segments are crowded, and shards so small that pairs become squares."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randint(5, 8))): rng.randint(3, 60) for _ in range(400)}
    words |= {"aaaaa": 1000, "bbbbb": 500, "anything": 3, "anythingg": 7}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert told(spelling.group_variants(df, capacity=capacity)) == plain_forms(words)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=0, max_size=7), st.text("abc", min_size=0, max_size=7))
def test_one_edit(a, b):
    assert spelling.one_edit(a, b) == plain_near(a, b)


def test_spelling_edges(spark, empty):
    assert told(spelling.spelling_variants(empty)) == {}
    rows = [(None, "Hello hello hello× HELLO"), (None, None), (3, ""), (4, "hellö hellö hellö " + "x" * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(spelling.spelling_variants(df)) == plain_forms(plain_words(rows))
    # Chains end at their last word.
    chain = {"abcdefg": 2**5, "abcdefx": 2**6, "abcdeyx": 2**7, "abcdzyx": 2**8, "abcqzyx": 2**9, "abqqzyx": 2**10}
    found = told(spelling.group_variants(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert {x[1] for x in found.values()} == {"abqqzyx"} and found["abcdefg"][0] == "abcdefx"


# 12
ROLES = {"u": "user", "a": "assistant"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows, everyone):
    """By a table over (turns read, state), all audits of least cost compared as text."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, *(" " if x is None else x for x in (role, text))))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    found = dict.fromkeys(everyone, none)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        grammar = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
        best = {"": (0, "", [])}

        def inserts(table):
            for _ in range(3):
                for q, (c, a, kept) in list(table.items()):
                    for x in "ua":
                        if x in grammar[q]:
                            new = (c + 3, a + "I", [*kept, (ROLES[x], "")])
                            table[x] = min(table.get(x, new), new, key=lambda v: v[:2])
            return table

        best = inserts(best)
        for (_, role, text), fault in zip(own, faults):
            after = {}
            for q, (c, a, kept) in best.items():
                options = [(q, (c + 4, a + "D", kept))]
                if fault not in ("b", "d"):
                    more = 3 * (fault == "t")
                    if role[:1] in grammar[q]:
                        options.append((role[:1], (c + more, a + "K", [*kept, (role, text)])))
                    options += [(x, (c + 3 + more, a + "R", [*kept, (ROLES[x], text)])) for x in "ua" if x in grammar[q]]
                for x, new in options:
                    after[x] = min(after.get(x, new), new, key=lambda v: v[:2])
            best = inserts(after)
        cost, audit, kept = min((best[q] for q in ("", "a") if q in best), key=lambda v: v[:2])
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((x[1][:1] + y[1][:1]) not in ("su", "ua", "au") for x, y in itertools.pairwise(own))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        found[conv] = (gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return found


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def summary(df):
    rows = df.collect()
    found = {r["conv_id"]: tuple(r[c] for c in FIELDS) for r in rows}
    assert len(found) == len(rows)
    return found


def test_conversation_query_against_loops(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert summary(queries()["op12_conversations"](spark, SF)) == plain_repair(plain_damage(rows), {r[0] for r in rows})


def conversation_rows(seed):
    rng = random.Random(seed)
    say = ["", " ", None, "Yes.", "No", "Why? ", "a\nb!", "x" * 3000, "Eh…", "Ok."]
    rows = []
    for conv in [None, 1, 2, 3, 2**60 + 1]:
        for turn in range(rng.randint(0, 9)):
            turn = rng.choice([turn, turn, turn, None, -turn])
            rows.append((conv, turn, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "agent"]), rng.choice(say)))
    # A conversation that is most of the table, over many blocks and tasks.
    rows += [(7, t, rng.choice(["user", "assistant"]), rng.choice([f"turn {t}.", f"turn {t}", "Ok.", ""])) for t in range(300)]
    return rng.sample(rows, len(rows))


@pytest.mark.parametrize(("seed", "block", "fan"), [(1, 4, 2), (2, 1, 3), (3, 256, 64)])
def test_conversations_over_blocks_and_tasks(spark, seed, block, fan):
    rows = conversation_rows(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        found = conversations.repair(df, block, fan)
        expected = plain_repair(rows, {r[0] for r in rows})
        cost = {r["conv_id"]: (r["cost"], r["audit"], r["illegal"], r["gaps"], r["duplicate"]) for r in found.conversations.collect()}
        assert cost == {k: (v[5], v[6], v[4], v[0], v[2]) for k, v in expected.items()}
        hashed = {r["conv_id"]: r["repaired_sha256"] for r in conversations.digests(found.rows).collect()}
        none = hashlib.sha256(b"").hexdigest()
        assert {k: hashed.get(k, none) for k in expected} == {k: v[7] for k, v in expected.items()}
    finally:
        spark.conf.unset(coalesce)


def test_cheapest_against_all_edits():
    """Dijkstra against every sequence of edits of bounded length."""
    grammar = re.compile("(s?(ua)+)?")
    rng = random.Random(4)
    for _ in range(40):
        rows = [(rng.choice("suaat"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 3))]
        best = None
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            for edits in itertools.product(*(["D"] if f in (1, 2) else ["D", "K", "Ru", "Ra"] for _, f in rows)):
                cost, audit, slots = 0, "", []
                for (initial, fault), edit, n in zip([*rows, ("", 0)], [*edits, ""], inserts):
                    audit += "I" * n + edit[:1]
                    cost += 3 * n + {"D": 4, "R": 3}.get(edit[:1], 0) + 3 * (fault == 3 and edit != "D" and edit != "")
                    slots += ["ua"] * n + ([initial] if edit == "K" else [edit[1]] if edit[:1] == "R" else [])
                if best is None or (cost, audit) < best:
                    if any(grammar.fullmatch("".join(x)) for x in itertools.product(*slots)):
                        best = (cost, audit)
        ((_, found),) = conversations.cheapest(rows, "", conversations.ENDS).items()
        assert found == best


def test_conversation_edges(spark):
    schema = "conv_id long, turn int, role string, text string, audit string, cost long, data string"
    none = spark.createDataFrame([], schema)
    assert summary(conversations.repaired_summary(conversations.damaged(none), none)) == {}
    rows = [(None, None, None, None, "x", 1, "y")] * 3 + [(5, 1, "user", "Hi.", "x", 1, "y")] * 2
    df = spark.createDataFrame(rows, schema)
    plain = [r[:4] for r in rows]
    assert summary(conversations.repaired_summary(conversations.damaged(df), df)) == plain_repair(plain_damage(plain), {None, 5})


# 13
def tokens_of(text):
    return [*re.findall(WORD, (text or "").translate(CAPITALS)), None]


def plain_model(texts, order):
    """Counts as dictionaries of tuples; None is the end and 0 the start of a text."""
    top = collections.Counter()
    for text in texts:
        full = [0] * (order - 1) + tokens_of(text)
        top.update(tuple(full[i : i + order]) for i in range(len(full) - order + 1))
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    d = {}
    for k, c in counts.items():
        n = [sum(x == j for x in c.values()) for j in (1, 2, 3, 4)]
        d[k] = [0, 0.5, 1, 1.5]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            found = [j + 1 - (j + 2) * y * n[j + 1] / n[j] for j in range(3)]
            if all(0 <= x <= j + 1 for j, x in enumerate(found)):
                d[k] = [0, *found]
    after = {k: collections.defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            after[k][g[:-1]].append(n)
    after = {k: {g: (sum(ns), sum(d[k][min(x, 3)] for x in ns)) for g, ns in found.items()} for k, found in after.items()}

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        low, found = p(gram[1:]), after[k].get(gram[:-1])
        if not found:
            return low
        n = counts[k].get(gram, 0)
        return (n - d[k][min(n, 3)] + found[1] * low) / found[0]

    return p, counts


def plain_scores(rows, order, train):
    texts = [t for i, t in rows if train(i)]
    p, _ = plain_model(texts, order)
    raw = collections.Counter(w for t in texts for w in tokens_of(t))
    total, types = sum(raw.values()), len(raw)
    out = []
    for i, text in rows:
        full = [0] * (order - 1) + tokens_of(text)
        own = full[order - 1 :]
        base = sum(math.log10((raw[w] + 0.5) / (total + 0.5 * (types + 1))) for w in own)
        score = sum(math.log10(p(tuple(full[k : k + order]))) for k in range(len(own)))
        out.append((i, len(own), sum(raw[w] > 0 for w in own), total, base, score))
    return out


def learned(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1


def same_scores(found, expected):
    assert len(found) == len(expected)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[4])
    for a, b in zip(sorted(found, key=key), sorted(expected, key=key), strict=True):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_against_dictionaries(spark, docs, order):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    out = language_model.perplexity_scores(docs, order).collect()
    assert all(r["held_out"] == (not learned(r["doc_id"])) for r in out)
    same_scores([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out], plain_scores(rows, order, learned))


def test_language_model_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = queries()["op13_language_model"](spark, SF).collect()
    same_scores([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out], plain_scores(rows, language_model.ORDER, learned))
    # Unseen texts are likelier under the model than by their words alone.
    unseen = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_probabilities_add_up_to_one():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    p, counts = plain_model(texts, 3)
    for context in [(0, 0), (0, "a"), ("a", "b"), ("z", "z")]:
        assert sum(p((*context, w)) for (w,) in counts[1]) + p((*context, "unseen")) == pytest.approx(1)


def test_token_hashes_in_pieces(monkeypatch):
    """Texts cut into pieces and portions have the n-grams of whole texts, and equal words equal hashes."""
    texts = [(t or "").encode() for t in odd_texts()] * 2
    whole = list(language_model.chunks(iter(texts), 3, 10**6))
    assert len(whole) == 1
    hashes = dict(zip([w for t in texts for w in [*t.lower().split(), None]], whole[0][1][2].tolist(), strict=True))
    assert len(set(hashes.values())) == len(hashes)
    assert whole[0][1][2].tolist() == [hashes[w] for t in texts for w in [*t.lower().split(), None]]
    monkeypatch.setattr(language_model, "PIECE", 50)
    parts = list(language_model.chunks(iter(texts), 3, 90))
    assert len(parts) > 20
    assert np.concatenate([n for n, _ in parts]).tolist() == whole[0][0].tolist()
    for k in range(3):
        assert np.concatenate([t[k] for _, t in parts]).tolist() == whole[0][1][k].tolist()


def test_language_model_edges(spark, empty):
    assert language_model.perplexity_scores(empty).collect() == []
    rows = [(None, None), (6, ""), (6, "a A b"), (2, "a b c"), (11, None)]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    out = language_model.perplexity_scores(df).collect()
    same_scores([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out], plain_scores(rows, 2, learned))
    untrained = next(i for i in range(100) if not learned(i))
    only = spark.createDataFrame([(untrained, "a b")], "doc_id long, text string")
    assert [(r["train_tokens"], r["n_known"], r["score"]) for r in language_model.perplexity_scores(only).collect()] == [(0, 0, 0.0)]
