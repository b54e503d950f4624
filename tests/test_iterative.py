"""Chains, stacks and percentiles against plain loops, also where one key has nearly all rows."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import notes, stacks
from tessera.operators.memory import chains, supersede_with_deletes
from tessera.operators.metrics import percentiles


@pytest.fixture
def spread(spark):
    """Ranges as they are, so that a key spans many tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_chain(parents):
    out = {}
    for start in parents:
        seen, at = [], start
        while at not in seen:
            seen.append(at)
            if parents.get(at) not in parents:
                out[start] = (at, len(seen) - 1, False)
                break
            at = parents[at]
        else:
            out[start] = (min(seen[seen.index(at) :]), None, True)
    return out


def found_chains(df):
    rows = chains(df).collect()
    out = {r["id"]: (r["root"], r["depth"], r["cyclic"]) for r in rows}
    assert len(out) == len(rows)
    return out


def chain_table(spark, parents):
    return spark.createDataFrame(list(parents.items()), "id long, supersedes_id long").repartition(3)


def test_chains_against_loops(spark):
    rng = random.Random(6)
    for n in (1, 2, 60, 300):
        parents = {i: rng.choice([None, rng.randrange(n), rng.randrange(n), i - 1 if i else None, n + 5]) for i in range(n)}
        assert found_chains(chain_table(spark, parents)) == plain_chain(parents)
    parents = {1: 2, 2: 3, 3: 1, 4: 1, 5: 4, 6: 6, 7: None, 8: 7, 9: 99}
    assert found_chains(chain_table(spark, parents)) == plain_chain(parents)
    assert found_chains(chain_table(spark, {1: 1}).limit(0)) == {}


def test_chain_of_ten_thousand_links(spark):
    order = random.Random(1).sample(range(10**12), 10_001)
    parents = dict(zip(order, [None, *order], strict=False))
    found = found_chains(chain_table(spark, parents))
    assert found == {x: (order[0], k, False) for k, x in enumerate(order)}


def test_star_and_long_cycle(spark):
    """All rows on one parent, and one cycle of all rows."""
    star = {0: None} | {i: 0 for i in range(1, 3000)}
    assert found_chains(chain_table(spark, star)) == {0: (0, 0, False)} | {i: (0, 1, False) for i in range(1, 3000)}
    ring = {i: (i + 1) % 3000 for i in range(3000)}
    assert found_chains(chain_table(spark, ring)) == dict.fromkeys(ring, (0, None, True))


def plain_stack(log):
    stacks_of, status, link = {}, {}, {}
    for user, dimension, i, action, target in sorted(log, key=lambda r: (r[2], r[3])):
        stack = stacks_of.setdefault((user, dimension), [])
        if action == "delete":
            if target in stack:
                stack.remove(target)
                status[user, dimension, target] = "deleted"
        elif action in ("new", "supersede"):
            own = (user, dimension, i)
            link[own] = None
            if action == "supersede" and stack:
                link[own] = stack.pop()
                status[user, dimension, link[own]] = "superseded"
            stack.append(i)
            status[own] = "active"
    return {k: (status[k], link[k]) for k in status}


LOG = "user_id long, dimension string, id long, action string, target long"


def found_stack(df):
    rows = supersede_with_deletes(df).collect()
    out = {(r["user_id"], r["dimension"], r["id"]): (r["status"], r["supersedes_id"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize(("seed", "fan"), [(1, 64), (2, 2), (3, 3), (4, 2)])
def test_stacks_against_loops(spread, monkeypatch, seed, fan):
    """One user has most rows, over all ranges; deletes hit tops, middles, gone rows and rows to come."""
    rng = random.Random(seed)
    kinds = ["new"] * rng.randint(1, 4) + ["supersede"] * rng.randint(1, 4) + ["delete"] * rng.randint(1, 5) + ["skip"]
    log = []
    for i in range(1500):
        user = rng.choice([7] * 20 + [1, 2, None])
        action = rng.choice(kinds)
        target = i - rng.randint(-3, rng.choice([3, 30, 900])) if action == "delete" else None
        log.append((user, rng.choice(["a", "a", "a", None, "b"]), i, action, target))
    links = stacks.links
    monkeypatch.setattr("tessera.operators.memory.links", lambda rows, keys: links(rows, keys, fan))
    assert found_stack(spread.createDataFrame(rng.sample(log, len(log)), LOG).repartition(5)) == plain_stack(log)


def test_stack_edges(spark):
    assert found_stack(spark.createDataFrame([], LOG)) == {}
    # A delete and a supersede of one id: the delete is first.
    log = [(1, "a", 1, "new", None), (1, "a", 2, "new", None), (1, "a", 3, "supersede", None), (1, "a", 3, "delete", 2)]
    assert found_stack(spark.createDataFrame(log, LOG)) == {(1, "a", 1): ("superseded", None), (1, "a", 2): ("deleted", None), (1, "a", 3): ("active", 1)}


def test_stack_of_a_user_with_a_million_rows(spread):
    """New rows, then as many supersedes, each deleted at once: every one takes a row further down, through all ranges."""
    n = 250_000
    rows = spread.range(3 * n).select(F.lit(1).cast("long").alias("user_id"), F.lit("a").alias("dimension"), "id")
    late = (F.col("id") - n) % 2
    action = F.when(F.col("id") < n, "new").when(late == 0, "supersede").otherwise("delete")
    log = rows.select("*", action.alias("action"), F.when((F.col("id") >= n) & (late == 1), F.col("id") - 1).alias("target"))
    out = supersede_with_deletes(log)
    wrong = out.filter(F.col("supersedes_id").isNotNull() & (F.col("supersedes_id") != n - 1 - (F.col("id") - n) / 2))
    assert wrong.count() == 0
    assert {r["status"]: r["count"] for r in out.groupBy("status").count().collect()} == {"superseded": n, "deleted": n}


def nearest(values, p):
    known = sorted(v for v in values if v is not None)
    return known[max(1, math.ceil(p * len(known))) - 1] if known else 0


def test_percentiles_against_sorting(spread):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 8 + ["cold", None]), rng.choice([None, 1.5, rng.random(), round(rng.random(), 1), -rng.random()])) for _ in range(3000)]
    rows += [("none", None), ("one", 3.25)]
    df = spread.createDataFrame(rows, "k string, v double").repartition(4)
    expected = {}
    for k in {k for k, _ in rows}:
        own = [v for x, v in rows if x == k]
        expected[k] = (*(nearest(own, p) for p in (0.01, 0.5, 0.95, 1)), len(own))
    found = {r["k"]: tuple(r)[1:] for r in percentiles(df, "v", ["k"], (0.01, 0.5, 0.95, 1)).collect()}
    assert found == expected
    assert [tuple(r) for r in percentiles(df, "v").collect()] == [(nearest([v for _, v in rows], 0.5), nearest([v for _, v in rows], 0.95), len(rows))]
    assert [tuple(r) for r in percentiles(df.limit(0), "v").collect()] == [(0.0, 0.0, 0)]
    assert percentiles(df.limit(0), "v", ["k"]).collect() == []


def test_percentiles_of_ten_million_different_doubles(spread):
    """Known by construction: a permutation of 0 .. n - 1."""
    n = 10_000_019
    df = spread.range(n).select(((F.col("id") * 7_654_321) % n / 4).alias("v"))
    out = percentiles(df, "v").first()
    assert (out["p50"], out["p95"], out["n"]) == ((math.ceil(0.5 * n) - 1) / 4, (math.ceil(0.95 * n) - 1) / 4, n)


def plain_notes(calls, shown):
    """One user after the other, call by call."""
    held, out = {}, {}
    for call, user, args in sorted(calls):
        own = held.setdefault(user, {})
        try:
            a = json.loads(args)
        except (TypeError, ValueError):
            out[call] = {"error": "笔记操作异常"}
            continue
        op, content = str(a.get("operation") or "").strip(), str(a.get("content") or "").strip()
        if not (user or "").strip():
            out[call] = {"error": "缺少用户上下文，无法操作记忆"}
        elif op == "write":
            out[call] = {"success": True, "note_id": call, "message": "已记住，后续对话会自动参考该笔记"} if content else {"error": "content 不能为空"}
            if content:
                own[call] = content
        elif op == "list":
            newest = sorted(own, reverse=True)[:shown]
            out[call] = {"success": True, "notes": [{"note_id": n, "content": own[n]} for n in newest]}
        elif op == "delete":
            target = int(a.get("note_id") or -1)
            own.pop(target, None)
            out[call] = {"success": True, "message": "笔记已删除"} if target > 0 else {"error": "note_id 无效"}
        else:
            out[call] = {"error": f"不支持的操作: {op}，可用操作: write/list/delete"}
    return out


@pytest.mark.parametrize(("seed", "shown"), [(1, 3), (2, 1), (3, 50)])
def test_notes_against_loops(spread, seed, shown):
    rng = random.Random(seed)
    calls = []
    for call in range(1, 1500):
        user = rng.choice(["hot"] * 12 + ["a", "b", " ", None])
        kind = rng.choice(["write", "write", "list", "list", "delete", "delete", "other"])
        if kind == "write":
            args = json.dumps({"operation": kind, "content": rng.choice(["", "  ", f' n "{call}" é '])}, ensure_ascii=False)
        elif kind == "delete":
            args = json.dumps({"operation": kind, "note_id": rng.choice([call - rng.randint(1, rng.choice([4, 60, 1400])), -1, str(call - 1)])})
        elif kind == "list":
            args = '{"operation":" list "}'
        else:
            args = rng.choice(["{", None, "{}", '{"operation":"read"}'])
        calls.append((call, user, args))
    df = spread.createDataFrame(rng.sample(calls, len(calls)), "call_id long, user_id string, args string").repartition(4)
    rows = notes.remember(df, shown).collect()
    assert len(rows) == len(calls)
    assert {r["call_id"]: json.loads(r["answer"]) for r in rows} == plain_notes(calls, shown)
    assert notes.remember(df.limit(0)).collect() == []


def test_ended_chains_stay_out_of_joins(spark, monkeypatch):
    """In the rounds only rows that still go on are joined; the others would meet in one task by their null pointer."""
    from tessera.operators import memory

    rounds = []
    keep = memory.stored
    monkeypatch.setattr(memory, "stored", lambda df, *more: (rounds.append(df), keep(df, *more))[1])
    rows = spark.range(40).selectExpr("id", "case when id % 10 > 0 then id - 1 end as supersedes_id")
    found = memory.chains(rows)
    assert sorted(map(tuple, found.collect())) == [(i, i - i % 10, i % 10, False) for i in range(40)]
    assert len(rounds) == 5
    assert all("isnotnull(to#" in df._jdf.queryExecution().optimizedPlan().toString() for df in rounds[1:])
