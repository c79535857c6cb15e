import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_repair as cr


def brute(roles):
    """The least cost over all ways to treat every turn."""
    best = {0: 0}
    for r in roles:
        new = {}
        for q, cost in best.items():
            for x in (1, 2, 3):
                label = 0 if x == r else (cr.RELABEL if r else cr.UNKNOWN)
                ways = []
                if q == x:
                    ways.append(cr.MERGE)
                if (q, x) in cr.LEGAL:
                    ways.append(0)
                if any((q, y) in cr.LEGAL and (y, x) in cr.LEGAL for y in (1, 2, 3)):
                    ways.append(cr.INSERT)
                for w in ways:
                    new[x] = min(new.get(x, 10**9), cost + label + w)
        best = new
    return min(c + cr.INSERT * len(cr.ENDING[q]) for q, c in best.items())


def rendered(rows):
    return "".join(r.piece for r in rows)


def legal(text):
    roles = [x.split("|>")[0] for x in text.split("<|")[1::2]]
    state = 0
    for r in roles:
        x = cr.ROLES.index(r) + 1
        assert (state, x) in cr.LEGAL
        state = x
    return state == 3


@pytest.mark.parametrize("block", [3, 256])
def test_least_cost_and_legal(spark, block):
    rng = random.Random(block)
    rows = []
    for conv in range(60):
        n = rng.choice([1, 2, 3, 5, 9, 40])
        rows += [(conv, t, rng.choice(["user", "assistant", "assistant", "user", "system", None, "tool"]), f"t{t}") for t in range(n)]
    rows += [(1000, t, rng.choice(["user", "assistant"]), "x") for t in range(700)]
    rows += [(None, 0, "user", None), (None, None, "user", "a"), (5, 1, "user", "dup"), (5, 1, "user", "dup")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, piece string").repartition(5)
    got = cr.repair_roles(df, block).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.conv_id, []).append(r)
    tied = df.withColumn("tie", F.xxhash64("role", "text")).collect()
    for conv, out in by.items():
        source = sorted((r for r in tied if r.conv_id == conv), key=lambda r: (r.turn is not None, r.turn or 0, r.tie))
        roles = [cr._role(r[2]) for r in source]
        assert sum(r.cost for r in out) == brute(roles)
        out.sort(key=lambda r: (r.turn is not None, r.turn or 0, r.out_turn))
        text = rendered(out)
        assert legal(text)
        assert all((r[3] or "") in text for r in source)


def test_blocks_do_not_change_the_result(spark):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), str(t)) for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one, many = (sorted(map(tuple, cr.repair_roles(df, b).collect()), key=lambda r: r[1]) for b in (1000, 7))
    assert one == many


@pytest.mark.parametrize("turn", [0, None])
def test_ties_have_one_order_under_any_partitioning(spark, turn):
    rng = random.Random(8)
    rows = [(1, turn, rng.choice(["user", "assistant", "system", None]), rng.choice(["", None, "a", "b" * 50_000, str(rng.random())])) for _ in range(400)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, cost int")
    tied = df.withColumn("tie", F.xxhash64("role", "text")).collect()
    tied.sort(key=lambda r: (r.tie, r.role is not None, r.role or "", r.text is not None, r.text or ""))
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in (1, 4, 50):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = cr.repair_roles(df.repartition(n), 16).collect()
        assert sum(r.cost for r in got) == brute([cr._role(r.role) for r in tied])
        seen.append(sorted(map(str, got)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_clean_conversation_is_kept_and_empty_table(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(cr.repair_roles(df).collect(), key=lambda r: r.turn)
    assert {r.action for r in got} == {"keep"} and sum(r.cost for r in got) == 0
    assert rendered(got) == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n"
    assert cr.repair_roles(df.limit(0)).count() == 0


def test_composition():
    for roles in itertools.product(range(4), repeat=3):
        assert (cr.times(cr._effect(list(roles[:1])), cr._effect(list(roles[1:]))) == cr._effect(list(roles))).all()
