import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tessera.llm import sp_dropout as sd

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["  hi  there\n x y Ⅷ ﬁ é \x00 z", "", None, "   ", "\n\n", " \n ", "a" * 3000, "日本語 \U0001f600 x́", "▁ under ▁▁", "trailing  "]


def test_library_ids_without_dropout(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    for r in sd.encode(df, PATH, rate=0.0).collect():
        if "▁" not in (r.text or ""):
            assert r.tokens == sp.encode(r.text or "")


def test_lossless_and_varied(spark, docs):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(None, "no id", 1)], "doc_id long, text string, tokens int")
    df = df.unionByName(docs.select("doc_id", "text"), allowMissingColumns=True)
    a = sd.round_trip(df, PATH, tokens=True).collect()
    assert all(r.lossless for r in a) and len(a) == df.count()
    again, other = sd.round_trip(df, PATH).collect(), sd.round_trip(df, PATH, seed=18).collect()
    assert sorted(r.ids_crc32 for r in a) == sorted(r.ids_crc32 for r in again)
    assert sum(x.ids_crc32 != y.ids_crc32 for x, y in zip(a, other)) > 150
    assert sum(r.n_tokens for r in a) > sum(len(r.tokens) for r in sd.encode(df, PATH, rate=0.0).collect())


def test_one_merge_at_a_time():
    """The side-by-side agenda against a plain one."""
    m = sd.DropoutModel(PATH, 0.3, 5, 4)
    words = [" hello", " therefore", "internationalisation", " a", "aaaaaaa"]
    variant = np.array([0, 1, 2, 3, 1])
    ids, count = m.merge(words, variant)
    for w, v, got in zip(words, variant, np.split(ids, np.cumsum(count)[:-1])):
        s = m._symbols([w])[0].tolist()
        pieces = [(p, i) for i, p in enumerate(s)]
        while len(pieces) > 1:
            a, b = (np.array([p for p, _ in x]) for x in (pieces[:-1], pieces[1:]))
            rank = m._rank(a, b, np.array([i for _, i in pieces[:-1]]), np.full(len(a), v))
            k = int(rank.argmin())
            if rank[k] == 2**31 - 1:
                break
            new = m.pair_id[np.searchsorted(m.pair_key, int(a[k]) * len(m.pieces) + int(b[k]))]
            pieces[k : k + 2] = [(int(new), pieces[k][1])]
        assert [p for p, _ in pieces] == got.tolist()


def test_each_occurrence_draws_for_itself():
    """Drop rates hold for every word, and cached agendas equal those merged place by place."""
    m = sd.DropoutModel(PATH, 0.1, 17)
    short, long = " an", " internationalisation"
    assert len(m.merge([short], None)[0]) == 1
    n = 4000
    words = [" of", " the", short, " is", " to", " in", " be"]
    ids, count = m.encode(["".join([w] * n)[1:] for w in words], np.arange(len(words)))
    for w, got in zip(words, np.split(ids, np.cumsum(count)[:-1])):
        met = []
        m.merge([w], None, met)
        candidates = sum(len(c) for _, c in met)
        whole = m.merge([w], None)[0]
        assert len(whole) == 1 and candidates >= 1
        rate = 1 - (got == whole[0]).sum() / n
        assert 0.07 < rate < 1 - 0.9**candidates + 0.03
    ids, _ = m.encode([(long * n)[1:]], np.array([3]))
    text = b"".join(m.bytes_of[i] for i in ids.tolist()).decode()
    assert text == long * n
    seen, at = set(), []
    for i in ids.tolist():
        at.append(i)
        if sum(len(m.bytes_of[x]) for x in at) == len(long):
            seen.add(tuple(at))
            at = []
    assert len(seen) > 20
    # against merging every occurrence
    texts = ["the old man and the sea of the north", "", (long * 50)[1:]]
    got, count = m.encode(texts, np.array([5, 6, -1]))
    for t, i, x in zip(texts, (5, 6, -1), np.split(got, np.cumsum(count)[:-1])):
        chunks = sd.CHUNK.findall(" " + t) if t else []
        doc = np.full(len(chunks), i, np.int64).view(np.uint64)
        draw = sd.mix(sd.mix(doc + m.key) + np.arange(len(chunks), dtype=np.uint64))
        assert m.merge(chunks, draw)[0].tolist() == x.tolist()


WRAP = (1 << 64) - 1


def splitmix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & WRAP
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & WRAP
    return x ^ (x >> 31)


def plain_ids(sp, text, doc_id, rate, seed):
    """The agenda of every chunk in plain Python: scores from the library, hashes in whole numbers."""
    golden, n = 0x9E3779B97F4A7C15, sp.get_piece_size()
    key = splitmix((seed + golden) & WRAP)
    normal = lambda i: not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))
    name, text_of = {i: sp.id_to_piece(i) for i in range(n) if normal(i)}, {}
    text_of = {p: i for i, p in name.items()}
    out = []
    for number, chunk in enumerate(re.findall(r" *[^ \n]+| +|\n+", " " + text) if text else []):
        draw = splitmix((splitmix((doc_id + key) & WRAP) + number) & WRAP)
        ids = []
        for c in chunk:
            i = text_of.get("▁" if c == " " else c) if c != "▁" else None
            ids += [i] if i is not None else [sp.piece_to_id(f"<0x{b:02X}>") for b in c.encode()]
        at = list(range(len(ids)))
        while True:
            best = None
            for k in range(len(ids) - 1):
                made = text_of.get(name[ids[k]] + name[ids[k + 1]]) if ids[k] in name and ids[k + 1] in name else None
                if made is None or (best and best[0] <= -sp.get_score(made)):
                    continue
                if (splitmix(((ids[k] * n + ids[k + 1]) * golden + at[k] + key + draw) & WRAP) >> 11) * 2.0**-53 >= rate:
                    best = (-sp.get_score(made), k, made)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2], at[k : k + 2] = [best[2]], [at[k]]
        out += ids
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.4])
def test_against_an_agenda_and_hash_of_its_own(docs, rate):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(1)
    run = lambda of, k: "".join(rng.choice(of) for _ in range(k))
    texts = ["internationalisation of the therefore  a\n\nx", "aaaaaaa banana", "", run("abcdefghinorst", 300), run("的一是在不了有和人这日本語", 300), "x " + run("ACGT0123456789+/", 700) + " y"]
    texts += [r.text[:1500] for r in docs.limit(4).collect() if r.text]
    ids = np.array([*range(len(texts) - 1), -1])
    m = sd.DropoutModel(PATH, rate, 23)
    got, count = m.encode(texts, ids)
    for t, i, x in zip(texts, ids.tolist(), np.split(got, np.cumsum(count)[:-1])):
        assert x.tolist() == plain_ids(sp, t, i & WRAP, rate, 23)
        assert m.decode(x) == t if t else not len(x)


def test_long_runs_take_time_in_proportion():
    rng = random.Random(2)
    m = sd.DropoutModel(PATH, 0.1, 17)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789") for _ in range(200_000))
    began = time.process_time()
    ids, _ = m.encode([text], np.array([1]))
    assert time.process_time() - began < 20
    assert m.decode(ids) == text and not m.index


def test_empty(spark):
    assert sd.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
