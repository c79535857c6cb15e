"""How many rows operators shuffle."""

import math
import random
import re
from collections import Counter

import pytest

from tessera.operators import intervals, protocol, vectors


@pytest.fixture
def shuffled(spark):
    """Rows that f's jobs write for shuffles, and the rows that it returns; tables of this size would be broadcast, as large ones are not."""

    def run(f):
        sc = spark.sparkContext._jsc.sc()
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

        def total():
            sc.listenerBus().waitUntilEmpty(30_000)
            stages = sc.statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
            return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

        before = total()
        rows = f().collect()
        return total() - before, rows

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield run
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_frequent_values_are_not_shuffled_row_by_row(spark, shuffled):
    """2,000 rows of five values, and null."""
    left = spark.range(2000).selectExpr("CASE WHEN id % 5 > 0 THEN id % 5 END AS k")
    right = spark.range(2000).selectExpr("id % 3 AS k")
    n, rows = shuffled(lambda: protocol.leakage_kinds(left, right, ["k"]))
    assert [(r.kind, r.shared) for r in rows] == [("k", 2)]
    assert n < 500


def test_long_windows_are_not_shuffled_in_pieces(spark, shuffled):
    """Windows of 1 to 10,000 cells over 1,000 points: two rows a window and a row for each of the five lengths and point at most."""
    rng = random.Random(8)
    points = [("k", rng.uniform(0, 20000)) for _ in range(1000)]
    windows = [("k", float(s := rng.randrange(20000)), float(s + 10 ** rng.randrange(5))) for _ in range(500)]
    w, p = spark.createDataFrame(windows, "k string, start_sec double, end_sec double"), spark.createDataFrame(points, "k string, ts double")
    n, rows = shuffled(lambda: intervals.interval_join(w, p, "k").groupBy("start_sec", "end_sec").count().coalesce(1))
    assert {(r.start_sec, r.end_sec): r["count"] for r in rows} == {(s, e): c * k for (s, e), c in Counter((s, e) for _, s, e in windows).items() if (k := sum(s <= t < e for _, t in points))}
    assert n < 5 * 1000 + 2 * 500 + 8 * 500


def test_words_are_not_shuffled_text_by_text(spark, shuffled):
    """200 texts of 60 words out of 100, in two cases; a text twice under one key is one document but two rows."""
    rng = random.Random(5)
    own = [(f"c{k % 2}", k, " ".join(f"Wort{rng.randrange(100)}" for _ in range(60))) for k in range(200)] + [("c0", 4, "wort1 wort2 einzig"), ("none", 900, "wort1")]
    ref = [(c, " ".join(f"wort{rng.randrange(100)}" for _ in range(80))) for c in ("c0", "c1")]
    n, rows = shuffled(lambda: vectors.text_fallback(spark.createDataFrame(own, "c string, k long, t string"), "c", "k", "t", spark.createDataFrame(ref, "c string, t string"), ["wort7"]))
    plain = Counter()
    for c, theirs in ref:
        count = lambda t: Counter(w for w in re.findall(r"\w{2,}", t.lower()) if w != "wort7")
        texts = {}
        for q, k, t in own:
            if q == c:
                texts[k] = texts.get(k, Counter()) + count(t)
        r, size = count(theirs), 1 + sum(q == c for q, _, _ in own)
        df = Counter(w for d in [r, *texts.values()] for w in d)
        idf = {w: math.log((1 + size) / (1 + f)) + 1 for w, f in df.items()}
        norm = lambda d: math.sqrt(sum((x * idf[w]) ** 2 for w, x in d.items()))  # noqa: E731, B023
        for q, k, _ in own:
            if q == c:
                s = sum(x * r[w] * idf[w] ** 2 for w, x in texts[k].items()) / norm(texts[k]) / norm(r)
                plain[c, k, round(min(0.95, max(0.15, 0.85 * s + 0.10)), 3)] += 1
    assert Counter((r.c, r.k, r.score) for r in rows) == plain
    assert n < 4000
