"""Joins by content against comparing every text with every word."""

import random

import pyarrow as pa
import pytest

from tessera.operators import contents
from tessera.operators.contents import contains_join
from tessera.operators.routing import dispatch, match_voice, route, signal_hits


def plain(texts, words):
    return sorted((i, o, w) for i, t in texts for o, w in words if t is not None and w is not None and w in t)


def case(seed, n_texts, n_words):
    rng = random.Random(seed)
    letters = "abcé🙂"
    make = lambda k: "".join(rng.choice(letters) for _ in range(rng.randint(0, k)))
    texts = [(i, make(60)) for i in range(n_texts)] + [(-1, None), (-2, ""), (-3, "abc" * 400)]
    words = [(i, make(5)) for i in range(n_words)] + [(-1, None), (-2, ""), (-3, "a"), (-4, "a")]
    return texts, words


@pytest.mark.parametrize(("nested", "pass_words"), [(0, 37), (0, 10**6), (50, 10**6), (10**6, 10**6)])
def test_contains_join(spark, monkeypatch, nested, pass_words):
    """By automata of one or several passes, with few texts, and by nested loop."""
    monkeypatch.setattr(contents, "NESTED", nested)
    monkeypatch.setattr(contents, "PASS_WORDS", pass_words)
    texts, words = case(1, 200 if nested != 50 else 30, 120)
    t = spark.createDataFrame(texts, "id long, content string").repartition(3)
    w = spark.createDataFrame(words, "ord long, signal string")
    found = signal_hits(t, w)
    assert set(found.columns) == {"id", "content", "ord", "signal"}
    assert sorted((r["id"], r["ord"], r["signal"]) for r in found.collect()) == plain(texts, words)
    kept = contains_join(t, w, "content", "signal", ["id"])
    assert set(kept.columns) == {"id", "ord", "signal"}
    assert sorted((r["id"], r["ord"], r["signal"]) for r in kept.collect()) == plain(texts, words)


def test_half_a_million_signals(spark):
    """No list is too long: 500,000 signals in several passes find what a dictionary of substrings finds."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [tuple(r) for r in docs.collect()]
    rng = random.Random(7)
    present = {t[p : p + 12] for _, t in texts if len(t) > 20 for p in rng.sample(range(len(t) - 12), min(300, len(t) - 12))}
    absent = {f"{k:012d}" for k in range(500_000 - len(present))}
    words = spark.createDataFrame([(w,) for w in present | absent], "signal string").repartition(8)
    found = {tuple(r) for r in signal_hits(docs, words, "text", ["doc_id"]).select("doc_id", "signal").collect()}
    assert found == {(i, t[p : p + 12]) for i, t in texts for p in range(len(t) - 11) if t[p : p + 12] in present}


def test_empty_sides(spark):
    t = spark.createDataFrame([(1, "x")], "id long, content string")
    none = spark.createDataFrame([], "ord int, domain string, signal string")
    assert signal_hits(t, none).collect() == []
    assert signal_hits(t.limit(0), none).collect() == []
    assert [tuple(r) for r in route(t, none, "id").collect()] == [(1, 0, None, True)]


@pytest.mark.parametrize("nested", [0, 1000])
def test_voices_without_a_limit(spark, monkeypatch, nested):
    monkeypatch.setattr(contents, "NESTED", nested)
    rng = random.Random(2)
    voices = [(i, "".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))), f"v{i}") for i in range(60)]
    names = [f"v{i}" for i in range(0, 60, 7)] + ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 7))) for _ in range(150)] + [None]
    expected = {}
    for asked in names:
        ranked = [(0 if i == asked else 1 if label[:3] in asked else 2, o, i) for o, label, i in voices if i == asked or label[:3] in asked or asked in label] if asked is not None else []
        expected[asked] = min(ranked)[2] if ranked else None
    df = spark.createDataFrame([(n,) for n in names], "asked string")
    found = match_voice(df, spark.createDataFrame(voices, "ord int, label string, id string")).collect()
    assert len(found) == len(names) and {r["asked"]: r["voice"] for r in found} == expected


def test_dispatch_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr("tessera.operators.routing.MAX_LISTED", 1)
    calls = spark.createDataFrame([(1, "a"), (2, "z"), (3, "b"), (4, "a")], "id int, name string")
    tools = spark.createDataFrame([("a", "A"), ("b", "B")], "name string, description string")
    assert {r["id"]: r["answer"] for r in dispatch(calls, tools).collect()} == {1: "A", 2: "unknown tool: z", 3: "B", 4: "A"}


@pytest.mark.parametrize("names", [["id", "word"], ["id", "content", "word"]])
def test_scan_is_bounded(names):
    """Long texts with many words are repeated beside them only where they are kept, some at a time."""

    class Sent:
        value = [f"{k:03d}." for k in range(40)]

    texts = ["".join(Sent.value) + "x" * 200_000] * 20
    batch = pa.RecordBatch.from_pydict({"id": list(range(20)), "content": texts})
    before = pa.default_memory_pool().max_memory()
    seen = []
    for out in contents._scan(Sent, next(contents._NUMBERS), "content", names)(iter([batch])):
        assert out.nbytes < 17_000_000 and out.schema.names == names
        seen += zip(out.column("id").to_pylist(), out.column("word").to_pylist(), strict=True)
        assert names[1] == "word" or set(out.column("content").to_pylist()) == {texts[0]}
    assert sorted(seen) == [(i, w) for i in range(20) for w in Sent.value]
    assert pa.default_memory_pool().max_memory() - before < 60_000_000
