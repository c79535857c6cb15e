"""Packing, vector codes and the filter audit against plain versions and SQL."""

import hashlib
import math
import random
import re
import zlib
from itertools import combinations, permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.llm import filter_audit, queries, slack_packing as sp, vector_codes as vc

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def library_ids(texts, end_id=0):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return [e.ids + [end_id] for e in tok.encode_batch(texts, add_special_tokens=False)]


def check_packing(rows, wanted, capacity):
    """wanted: (doc_id, ids) of each document. Pieces, digests and places are right; returns the number of sequences."""
    pieces = [(i, k, k * capacity, len(ids[k * capacity : (k + 1) * capacity]), zlib.crc32(np.array(ids[k * capacity : (k + 1) * capacity], "<u4").tobytes())) for i, ids in wanted for k in range(-(-len(ids) // capacity))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(pieces, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(by) == list(range(len(by)))
    return len(by)


def plain_fill(lengths, capacity):
    """One sequence at a time, by sets of sums: the fullest combination, the longest pieces of equally full ones."""
    lengths, fills = sorted(lengths, reverse=True), []
    while lengths:
        reach = [{0}]  # of the shortest ones
        for n in reversed(lengths):
            reach.append(reach[-1] | {s + n for s in reach[-1] if s + n <= capacity})
        left = max(reach[-1])
        fills.append(left)
        kept = []
        for i, n in enumerate(lengths):
            if n <= left and left - n in reach[len(lengths) - 1 - i]:
                left -= n
            else:
                kept.append(n)
        lengths = kept
    return fills


def fills(patterns):
    return [sum(n * k for n, k in taken) for times, taken in patterns for _ in range(times)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=60), st.integers(24, 40))
def test_fill_equals_one_bin_at_a_time(lengths, capacity):
    counts = [lengths.count(n) for n in range(capacity + 1)]
    plain = sp._fill(list(counts), capacity, False)
    assert fills(plain) == plain_fill(lengths, capacity)
    for patterns in (plain, sp._fill(list(counts), capacity, True)):
        used = [0] * (capacity + 1)
        for times, taken in patterns:
            assert times > 0 and sum(n * k for n, k in taken) <= capacity
            for n, k in taken:
                used[n] += times * k
        assert used == counts


def test_each_sequence_of_the_second_rule_is_the_fullest_with_the_longest_piece():
    rng = random.Random(3)
    lengths = [rng.randrange(1, 30) for _ in range(25)]
    left = sorted(lengths)
    for times, taken in sp._fill([lengths.count(n) for n in range(41)], 40, True):
        for _ in range(times):
            rest = left[:-1]
            best = max(sum(c) for k in range(5) for c in combinations(rest, k) if sum(c) <= 40 - left[-1])
            assert taken[0][0] == left[-1] and sum(n * k for n, k in taken) >= left[-1] + best
            for n, k in taken:
                for _ in range(k):
                    left.remove(n)
    assert not left


def test_long_pieces_are_not_left_alone():
    counts = {1100: 40, 512: 160}
    assert len(fills(sp.fill_patterns(counts, 2048))) == 70  # the fullest alone would take 40 * 2


def test_steps_do_not_grow_with_the_documents():
    rng = random.Random(5)
    counts = {n: rng.randrange(1, 50) for n in range(1, 257)}
    few, many = (len(sp.fill_patterns({n: k * f for n, k in counts.items()}, 256)) for f in (1, 100_000))
    assert few < 700 and many < 700


def test_pack(spark, docs):
    rows = sp.pack(docs.repartition(7), PATH).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    wanted = list(zip([i for i, _ in texts], library_ids([t for _, t in texts])))
    n = check_packing(rows, wanted, 2048)
    assert n == math.ceil(sum(len(x) for _, x in wanted) / 2048)


def test_sequences_hold_the_tokens(spark):
    texts = [(i, f"text number {i} " * (i % 9)) for i in range(60)] + [(None, "no id"), (3, "again"), (3, "again"), (4, None)]
    docs = spark.createDataFrame([(*t, 1, "x") for t in texts], "doc_id long, text string, length int, offset string").repartition(5)
    ids = library_ids([t or "" for _, t in texts])
    packed = sp.pack(docs, PATH, capacity=16, tokens=True)
    rows = packed.collect()
    check_packing(rows, [(i, x) for (i, _), x in zip(texts, ids)], 16)
    again = {}
    for s in sp.sequences(packed).collect():
        assert len(s.tokens) == sum(s.lengths) <= 16
        at = 0
        for i, p, n in zip(s.doc_ids, s.pieces, s.lengths):
            again.setdefault(i, []).append((p, s.tokens[at : at + n]))
            at += n
    whole = {i: sum((x for _, x in sorted(p)), []) for i, p in again.items() if i not in (3, None)}
    assert whole == {i: x for (i, _), x in zip(texts, ids) if i not in (3, None)} | {4: whole[4]}
    assert sp.pack(docs.limit(0), PATH).count() == 0


def test_pack_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "word " * 200_000), (2, "x" * 300_000), (3, "")], "doc_id long, text string")
    wanted = [(r.doc_id, x) for r, x in zip(docs.collect(), library_ids([r.text for r in docs.collect()]))]
    check_packing(sp.pack(docs, PATH).collect(), wanted, 2048)


# --- vector codes


def plain_codes(rows, parts, entries, rounds):
    """(vec_id, code, error, label_error), digest: all distances, Python integers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    ints = [[math.floor(1024 * x) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    seeds = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, ints[k]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(ints[k], p) for k in seeds] for p in range(parts)]
    near = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for v in ints:
                own.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, qs in own.items():
                books[p][e] = [sum(c) // len(qs) for c in zip(*qs)]
    out, by = [], {}
    for (i, _, label), v in zip(kept, ints):
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        by[label] = by.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, by[label]) for i, c, e, label in out), key=str), digest


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 70), st.integers(1, 4), st.sampled_from([1, 2, 6, 2**26]), st.sampled_from([2, 8, 32]), st.integers(0, 10**6))
def test_tree_finds_the_lowest_of_the_nearest(entries, width, spread, leaf, seed):
    rng = np.random.default_rng(seed)
    book, q = rng.integers(-spread, spread + 1, (entries, width)), rng.integers(-2 * spread, 2 * spread + 1, (50, width))
    index, d = vc.nearest(vc.build_tree(book, leaf=leaf), book, q)
    every = ((q[:, None] - book) ** 2).sum(2)
    assert (index == every.argmin(1)).all() and (d == every.min(1)).all()


def test_search_prunes(monkeypatch):
    rng = np.random.default_rng(1)
    book, q = rng.integers(-1000, 1000, (256, 2)), rng.integers(-1000, 1000, (100, 2))
    seen, own = [], vc._least
    monkeypatch.setattr(vc, "_least", lambda q, node: seen.append(len(q)) or own(q, node))
    vc.nearest(vc.build_tree(book, leaf=8), book, q)
    assert sum(seen) < 100 * 62 / 3  # of the 62 nodes below the root


def test_codes(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1, 0, 1, 2]) * 0.1 + rng.randrange(3) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(300)]
    rows += [(7, rows[7][1], 1), (400, None, 1), (401, [0.1] * 7 + [None], 1), (402, [math.inf] * 8, 2), (403, [math.nan] + [0.0] * 7, 2), (404, [0.5, -0.3], 2), (None, [-0.0001] * 8, 3), (405, [], 3), (406, [100_000.0] * 8, 4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, v int").repartition(5)
    for entries in (16, 256):
        got = vc.compress(df, entries=entries, rounds=3).collect()
        wanted, digest = plain_codes(rows, 4, entries, 3)
        assert sorted((tuple(r)[:4] for r in got), key=str) == wanted
        assert {r.codebooks_sha256 for r in got} == {digest}


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert vc.compress(spark.createDataFrame([], schema)).count() == 0
    assert vc.compress(spark.createDataFrame([(1, None, "a"), (2, [None], "b")], schema)).count() == 0
    got = vc.compress(spark.createDataFrame([(1, [1e38, -1e38, 0.0, 1.0, 2.0], "a"), (2, [3e38, 5.0, 0.0, 1.0, 2.0], None), (2, [3e38, 5.0, 0.0, 1.0, 2.0], None)], schema)).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == [(1, "00000000", 0, 0), (2, "01000000", 0, 0), (2, "01000000", 0, 0)]


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_filter_audit"])
def test_query_equals_sql(spark, name):
    df = getattr(queries, name)(spark, DATA)
    db = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel = db.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.collect()) == sorted(rel.select(*df.columns).fetchall())


# --- filter audit


def plain_audit(rows, labels):
    """Every order run over all documents, one filter after the other."""
    quality, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = {}
    for k, (i, t, lang) in enumerate(rows):
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        docs.setdefault(lang or "", {})[k] = (i, {f for f, x in fails.items() if x})
    out = []
    for part, own in docs.items():
        removed = {}
        for order in map("".join, permutations("ABCDE")):
            left = dict(own)
            for step, f in enumerate(order, 1):
                gone = {k for k, (_, x) in left.items() if f in x}
                left = {k: v for k, v in left.items() if k not in gone}
                removed[order, step] = gone
                ids = [own[k][0] for k in gone]
                out.append([part, order, step, len(left), len(gone), sum(f in x for _, x in own.values()) - len(gone), sum({f} == x for _, x in own.values()), sum(i in quality for i in ids), sum(i in toxic for i in ids)])
        for r in out:
            if r[0] == part:
                r.append(sum(len(g) for (o, s), g in removed.items() if o[s - 1] == r[1][r[2] - 1]))
    return sorted(map(tuple, out))


def audited(df, labels):
    return sorted(tuple(r) for r in filter_audit.audit(df, labels).collect())


def test_audit(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("alpha Beta gamma DELTA x#y é日本 delta".split()) + (str(rng.randrange(400)) if rng.random() < 0.7 else "") for _ in range(rng.choice([5, 150, 260])))
    rows = [(i, text(), rng.choice(["en", "de", None, ""])) for i in range(120)]
    rows += [(200 + i, rows[i % 7][1], "en") for i in range(60)] + [(3, rows[3][1], "de"), (None, rows[0][1], "en"), (None, None, "fr"), (500, "", None), (501, None, "fr"), (502, "w " * 150_000, "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(250)] + [(3, 1, 1), (None, 1, 1), (9, 1, 0)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, mask int, good string").repartition(6)
    marks = spark.createDataFrame([(*r, "p") for r in labels], "doc_id long, quality int, toxic int, part string")
    assert audited(df, marks) == plain_audit(rows, labels)
    assert audited(df.limit(0), marks) == []


def test_audit_of_many_parts(spark, monkeypatch):
    rows = [(i, "a b c", f"p{i % 150}") for i in range(300)]
    got = audited(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert len(got) == 150 * 600 and got == plain_audit(rows, [])


def test_flags_use_whole_texts(spark):
    df = spark.createDataFrame([(1, "word " * 300_000 + "#", "en")], "doc_id long, text string, lang string")
    assert filter_audit.failure_masks(df).first().mask == 2 + 8
    assert filter_audit.failure_masks(df.withColumn("text", F.upper("text"))).first().mask == 2 + 4 + 8
