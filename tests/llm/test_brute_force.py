"""Operators that SQL cannot express against plain versions of their methods."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence, kd_shards, quality_knn, secret_automata as sa
from tests.llm.test_secrets import brute as base_text

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_terms(text):
    """Trigram counts by bucket, and words that repeat one of the two before them."""
    d, out = (text or "").encode(), Counter()
    for i in range(len(d) - 2):
        h = ((d[i] * 0x9E3779B1) & 0xFFFFFFFF) ^ ((d[i + 1] * 0x85EBCA6B) & 0xFFFFFFFF) ^ ((d[i + 2] * 0xC2B2AE35) & 0xFFFFFFFF)
        out[((h * 0x27D4EB2F) & 0xFFFFFFFF) >> 20] += 1
    w = [x.encode().lower() for x in WORD.findall(text or "")]
    if len(d) >= 3:
        out[quality_knn.TRIGRAMS] = sum(w[i] in w[max(0, i - 2) : i] for i in range(len(w)))
    return out


def test_scores_are_plain_cosine_votes(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality_knn.fit(docs, labels)
    assert np.allclose(model.axes.T @ model.axes, np.eye(model.axes.shape[1]), atol=1e-3)
    rows = docs.select("doc_id", "text").collect()
    df = Counter(t for r in rows for t, n in plain_terms(r.text).items() if n)
    idf = {t: (math.log((1 + len(rows)) / (1 + df[t])) + 1) * (math.sqrt(quality_knn.REPEATS) if t == quality_knn.TRIGRAMS else 1) for t in range(quality_knn.DIMS)}
    got = {r.doc_id: r.score for r in quality_knn.classify(docs, labels).collect()}
    for r in rows:
        v = np.zeros(quality_knn.DIMS)
        for t, n in plain_terms(r.text).items():
            v[t] = math.log1p(n) * idf[t]
        latent = v @ model.axes.astype(np.float64)
        if not v.any():
            assert got[r.doc_id] == 0
            continue
        near = sorted(((float(latent @ s / np.linalg.norm(latent)), q) for s, q in zip(model.vectors.astype(np.float64), model.labels)), reverse=True)[:25]
        votes = [(max(c, 0) ** 4, q) for c, q in near]
        assert got[r.doc_id] == pytest.approx(sum(w * q for w, q in votes) / sum(w for w, _ in votes), abs=2e-3)


def plain_tree(points, first, k, out):
    """Shards of points (key, weight, coordinates, tie): halved at the weighted quantile along the widest dimension."""
    if k == 1 or not points:
        out.update((p[0], first) for p in points)
        return
    spread = [(min(p[2][d] for p in points), max(p[2][d] for p in points)) for d in range(4)]
    d = max(range(4), key=lambda d: spread[d][1] - spread[d][0])
    low, high = spread[d]
    place = lambda p: min(max(math.floor((p[2][d] - low) / max(high - low, 1e-300) * kd_shards.BINS), 0), kd_shards.BINS - 1)
    points = sorted(points, key=lambda p: (place(p), p[3]))
    goal, before, cut = sum(p[1] for p in points) * (k // 2) / k, 0.0, 0
    for p in points:
        if before + p[1] >= goal:
            cut += goal - before > p[1] / 2
            break
        before, cut = before + p[1], cut + 1
    plain_tree(points[:cut], first, k // 2, out)
    plain_tree(points[cut:], first + k // 2, k - k // 2, out)


@pytest.mark.parametrize("shards", [5, 24])
def test_shards_are_those_of_a_plain_tree(spark, docs, shards):
    copies = spark.createDataFrame([(10**6 + i, "copy " * 3000, "en", "s") for i in range(40)], "doc_id long, text string, lang string, source string")
    df = docs.select("doc_id", "text", "lang", "source").unionByName(copies)
    rows = kd_shards.sized_rows(df)
    points = kd_shards.group_points(rows, shards, 1.25).collect()
    out = {}
    plain_tree([((p.g1, p.part), p.w, [p[d] for d in kd_shards.DIMENSIONS], p.tie) for p in points], 0, shards, out)
    parts = {p.g1: p.parts for p in points}
    assert max(parts.values()) > 1
    want = Counter((r.doc_id, out[r.g1, r.h % parts[r.g1]]) for r in rows.withColumn("h", F.xxhash64("doc_id", "g1")).collect())
    got = kd_shards.kd_shards(df, shards).collect()
    assert Counter((r.doc_id, r.shard) for r in got) == want
    for s in range(shards):
        mine = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine))) and [r.doc_id for r in mine] == sorted(r.doc_id for r in mine)


def js(p, q):
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q)) / 2))


def rest(shares):
    return [*shares, max(0.0, 1 - sum(shares))]


def test_distances_and_verdicts_of_the_rules(spark, docs):
    odd = spark.createDataFrame([(10**6, "zzz qqq " * 60 + "x y z", "en"), (10**6 + 1, "| # " * 80, None), (10**6 + 2, None, "en"), (10**6 + 3, "THE " * 30 + "a b c d e f g " * 9, "en")], "doc_id long, text string, lang string")
    df = docs.select("doc_id", "text", "lang").unionByName(odd)
    rows = [(r.doc_id, r.text or "", r.lang or "und") for r in df.collect()]
    classes = [r"[A-ZÀ-ÖØ-Þ]", "[0-9]", r"[.,;:!?'\"()\-]", r"[#*$%&|<>]", r"[\x20\x09-\x0D]"]
    count = lambda t: [len(re.findall(p, t)) for p in classes]
    words, all_words, sums, chars = {}, Counter(), {}, Counter()
    for _, t, lang in rows:
        words.setdefault(lang, Counter()).update(WORD.findall(t.lower()))
        sums[lang] = [a + b for a, b in zip(sums.get(lang, [0] * 5), count(t))]
        chars[lang] += len(t)
    ref = {}
    for lang, c in words.items():
        top = sorted(c.items(), key=lambda x: (-x[1], x[0]))[:16]
        ref[lang] = ([w for w, _ in top], rest([n / c.total() for _, n in top]))
    got = {r.doc_id: r for r in divergence.distribution_rules(df).collect()}
    seen = Counter()
    for i, t, lang in rows:
        r, w = got[i], WORD.findall(t.lower())
        class_distance = js(rest([n / max(len(t), 1) for n in count(t)]), rest([n / max(chars[lang], 1) for n in sums[lang]])) if len(t) >= 200 else None
        word_distance = None
        far = class_distance is not None and class_distance > 0.32
        if len(w) >= 50:
            top, share = ref[lang]
            c = Counter(w)
            word_distance = js(rest([c[x] / len(w) for x in top]), share)
            none = js(rest([0.0] * len(top)), share)
            far |= word_distance > 0.42 or (lang != "und" and word_distance > math.sqrt((0.6 * none) ** 2 + len(top) / (8 * math.log(2) * len(w))))
        assert r.class_distance == (class_distance if class_distance is None else pytest.approx(class_distance, abs=1e-9))
        assert r.word_distance == (word_distance if word_distance is None else pytest.approx(word_distance, abs=1e-9))
        assert r.kept == (not r.base_failed and not far)
        seen[r.kept, r.base_failed] += 1
    assert len(seen) == 3


class PlainAutomaton:
    """State merging on sets of prefixes: a state is a set, its numbers are sums over it."""

    def __init__(self, strings, alpha=0.05):
        self.total, self.final = Counter(), Counter()
        for s in strings:
            s = "".join(map(sa.symbol, s))
            self.total.update(s[:i] for i in range(len(s) + 1))
            self.final[s] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.of = {p: p for p in self.total}
        self.members = {p: [p] for p in self.total}
        self.lengths, self.n = Counter(map(len, strings)), len(strings)
        red = [""]
        while True:
            blue = next(((r, y) for r in red for y in self.symbols(r) if self.child(r, y) not in red), None)
            if blue is None:
                break
            state = self.child(*blue)
            for r in red:
                if self.compatible(r, state):
                    self.fold(r, state)
                    break
            else:
                red.append(state)
        self.red = red

    def symbols(self, s):
        return sorted({y for p in self.members[s] for y in sa.ALPHABET if p + y in self.total})

    def child(self, s, y):
        return next((self.of[p + y] for p in self.members[s] if p + y in self.total), None)

    def numbers(self, s):
        m = self.members[s]
        return sum(self.total[p] for p in m), sum(self.final[p] for p in m), {y: sum(self.total[p + y] for p in m) for y in self.symbols(s)}

    def compatible(self, a, b):
        (n, f, c), (m, g, d) = self.numbers(a), self.numbers(b)
        for x, y in [(f, g), *((c.get(y, 0), d.get(y, 0)) for y in c.keys() | d.keys())]:
            if abs(x / n - y / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m)):
                return False
        return all(self.compatible(self.child(a, y), self.child(b, y)) for y in c.keys() & d.keys())

    def fold(self, a, b):
        shared = [(self.child(a, y), self.child(b, y)) for y in self.symbols(b) if self.child(a, y) is not None]
        for p in self.members.pop(b):
            self.of[p] = a
            self.members[a].append(p)
        for x, y in shared:
            if x != y:
                self.fold(self.of[x], y)

    def log_likelihood(self, text, smooth=0.5):
        n, at = len(text), ""
        out = math.log((self.lengths[n] + smooth / (n * (n + 1))) / (self.n + smooth))
        for c in text:
            y = sa.symbol(c)
            total, final, count = self.numbers(at)
            out += math.log((count.get(y, 0) + smooth / len(sa.ALPHABET)) / (total - final + smooth)) - math.log(sa.CLASS_SIZE.get(y, 1))
            after = self.child(at, y)
            at = at if after is None else after
        return out


@pytest.mark.parametrize("seed", range(4))
def test_automata_are_those_of_plain_merging(seed):
    rng = random.Random(seed)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    strings = sorted({rng.choice([f"sk-{hexed(6)}", f"AKIA{hexed(4).upper()}", hexed(rng.randint(6, 9)), "pass" + str(rng.randrange(10**4))]) for _ in range(60)})
    one, plain = sa.Automaton(strings), PlainAutomaton(strings)
    assert len(one.total) == len(plain.red)
    for text in strings[:20] + [hexed(8), "hello.world", "sk-zzzzzz", "A" * 30]:
        assert one.log_likelihood(text) == pytest.approx(plain.log_likelihood(text), abs=1e-9)


def test_all_spans_are_those_of_plain_scoring(spark, docs):
    rng = random.Random(6)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    more = [(10**6 + i, f"see {hexed(18)} and token={hexed(18)} or {hexed(30)}, plain words-only here") for i in range(60)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    spans, values = {}, {k: set() for k in (*sa.KINDS, "ordinary")}
    for i, t in rows:
        spans[i] = [(int(s), int(e), k) for k, s, e in (x.split(":") for x in base_text(t).split(",") if x)]
        for s, e, k in spans[i]:
            values[k].add(t[s:e] if k != "assign" else sa.ASSIGN.fullmatch(t[s:e])[2])
    outside = lambda i, t: [m for m in re.finditer(r"[A-Za-z0-9+/_.=-]{6,}", t) if all(e <= m.start() or m.end() <= s for s, e, _ in spans[i])]
    for i, t in rows:
        values["ordinary"].update(m[0] for m in outside(i, t))
    first = lambda v, n: [x for _, x in sorted(zip(sa._places(sorted(v)).tolist(), sorted(v)))[:n]]
    models = {k: sa.Automaton(sorted(first(v, 1000 if k != "ordinary" else 16000))) for k, v in values.items() if v}
    plain = models.pop("ordinary")
    want, found = {}, 0
    for i, t in rows:
        own = [(s, sa.KINDS.index(k), f"{k}:{s}:{e}") for s, e, k in spans[i]]
        for m in outside(i, t):
            best, label = max(((a.log_likelihood(m[0]) - plain.log_likelihood(m[0])) / len(m[0]), k) for k, a in models.items())
            if best > 0.5:
                own.append((m.start(), 9, f"auto_{label}:{m.start()}:{m.end()}"))
                found += 1
        want[i] = ",".join(x[2] for x in sorted(own))
    assert found >= 50
    for parts in (1, 7):
        got = sa.scan_secrets(df.repartition(parts)).collect()
        assert {r.doc_id: r.spans for r in got} == want
        assert all(r.base_sha256 == hashlib.sha256(base_text(dict(rows)[r.doc_id]).encode()).hexdigest() for r in got[:50])
