"""Very long texts, repeated doc_ids, clashing columns: the same defined results as for ordinary rows."""

import random
import zlib

import pytest

from tessera.llm import decontam, divergence, kd_shards, near_dedup, quality_knn, secret_automata, substring_dedup, token_store
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_others import removed

RNG = random.Random(12)
LONG = [f"w{RNG.randrange(5000)}" for _ in range(150_000)]


@pytest.fixture(scope="module")
def long_rows():
    """Two near copies of a text of a megabyte, a part of it, an unbroken run, and short texts."""
    other = list(LONG)
    other[77] = "changed"
    return [(1, " ".join(LONG)), (2, " ".join(other)), (3, " ".join(LONG[1000:1100])), (4, "x" * 1_000_000), (5, "short text of six words here"), (6, None)]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    return spark.createDataFrame([(*r, "en", "s") for r in long_rows], "doc_id long, text string, lang string, source string").repartition(3)


def test_near_duplicates(long_docs, long_rows):
    assert sorted(map(tuple, near_dedup.near_duplicates(long_docs, 5).collect()), key=str) == near_brute(long_rows, 5)


def test_passages(long_docs, long_rows):
    assert sorted((tuple(r)[:4] for r in substring_dedup.substring_dedup(long_docs).collect()), key=str) == removed(long_rows)


def test_containment(spark, long_docs):
    items = spark.createDataFrame([(7, " ".join(LONG[5000:5020])), (8, "not in any of the texts at all")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.n_shared) for r in decontam.contamination(long_docs, items).collect()) == [(1, 7, 16), (2, 7, 16)]


def test_containment_with_clashing_columns(spark):
    items = spark.createDataFrame([(7, "a b c d e f g", 1, "x")], "item_id long, text string, doc_id int, k1 string")
    docs = spark.createDataFrame([(1, "0 a b c d e f g", "mine", 2, 3.0)], "doc_id long, text string, item_id string, k1 int, h double")
    got = decontam.contamination(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.n_item) for r in got] == [(1, 7, 3)]
    assert decontam.decontaminate(docs, items).columns == docs.columns


def test_shards_rules_and_scores(spark, long_docs, long_rows):
    size = {i: len((t or "").encode()) + 8 for i, t in long_rows}
    assert {r.doc_id: r.size for r in kd_shards.kd_shards(long_docs, 3).collect()} == size
    assert {r.doc_id: r.size for r in kd_shards.kd_shards(long_docs.drop("lang", "source"), 3).collect()} == size
    rules = {r.doc_id: r for r in divergence.distribution_rules(long_docs).collect()}
    assert rules[1].n_words == 150_000 and rules[1].n_repeat_words == 0 and rules[4].n_words == 1 and rules[4].base_failed
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    got = quality_knn.classify(long_docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)


def test_secrets(spark):
    """A long dump of keys and runs takes time in proportion."""
    text = " ".join(f"token={zlib.crc32(str(i).encode()):08x}{i:08x} plain-run-{i}" for i in range(30_000))
    df = spark.createDataFrame([(1, text), (2, "k" * 500_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_automata.scan_secrets(df).collect()}
    assert got[1].n_assign == 30_000 and got[2].n_assign == 0


def test_tokens(spark, long_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 2] for r in long_docs.where("doc_id <> 4").collect()}
    out = token_store.write_tokens(long_docs.where("doc_id <> 4"), path)
    assert {r.doc_id: r.tokens for r in token_store.read_tokens(spark, out).collect()} == want


def test_repeated_doc_ids_are_one_document(spark):
    rows = [(3, "a b c d"), (5, "a b c d"), (5, "x y z w"), (9, "x y z w"), (5, ""), (8, "k l m n"), (9, "k l m n"), (2, "q r s t"), (2, "q r s t"), (None, "a b c d")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    got = sorted(map(tuple, near_dedup.near_duplicates(df, 2).collect()), key=str)
    want = [(i, n, 3 if i in (3, 5, 8, 9) and n else i, i is None or i in (2, 3) or not n) for i, n in [(i, max(len((t or "").split()) - 1, 0)) for i, t in rows]]
    assert got == sorted(want, key=str)
    kept = near_dedup.keep_first(df, 2).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(3, "a b c d"), (5, ""), (2, "q r s t"), (2, "q r s t"), (None, "a b c d")], key=str)
    many = [(RNG.randrange(40), " ".join(RNG.choice("abcdefgh") for _ in range(RNG.choice([4, 5])))) for _ in range(300)]
    got = sorted(map(tuple, near_dedup.near_duplicates(spark.createDataFrame(many, "doc_id long, text string"), 2).collect()), key=str)
    assert got == near_brute(many, 2)


def test_store_layout(spark, docs, tmp_path):
    """Version 2 pages, delta or dictionary, row groups and pages of the size asked for, page indexes."""
    import public_tokenizers
    import pyarrow.parquet as pq

    path = public_tokenizers.path("word_bpe_49k.json")
    for kind in ("delta", "dictionary"):
        out = token_store.write_tokens(docs.repartition(1), path, f"{tmp_path}/{kind}", encoding=kind, row_group_bytes=1 << 17, page_rows=20, batch_rows=50)
        groups, coded = 0, set()
        for f in sorted((tmp_path / kind).glob("*.parquet")):
            meta = pq.ParquetFile(f).metadata
            groups += meta.num_row_groups
            for g in range(meta.num_row_groups):
                for c in range(meta.num_columns):
                    col = meta.row_group(g).column(c)
                    assert col.has_offset_index and (col.has_column_index or "tokens" in col.path_in_schema)
                    coded |= set(col.encodings) if "tokens" in col.path_in_schema else set()
        # a small chunk whose dictionary would not pay falls back to delta
        assert groups >= 2 and ("RLE_DICTIONARY" in coded) == (kind == "dictionary") and (kind == "dictionary" or "DELTA_BINARY_PACKED" in coded)
    few = token_store.read_tokens(spark, out, 10, 12)
    assert {r.doc_id for r in few.collect()} == {10, 11, 12}


def test_rules_without_a_language(spark):
    """One language, und, where there is no such column: as if it were null."""
    rows = [(i, f"some words of text number {i} and more of the same words " * 3) for i in range(8)] + [(9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, null = ([tuple(r) for r in divergence.distribution_rules(d).orderBy("doc_id").collect()] for d in (df, df.selectExpr("*", "cast(null as string) as lang")))
    assert got == null and len(got) == 9


def test_windows_rank_before_the_shuffle(spark, long_docs):
    words = divergence.common_words(long_docs)
    assert "WindowGroupLimit" in words._jdf.queryExecution().executedPlan().toString()
    assert {r.lang: len(r.top_words) for r in words.collect()} == {"en": 16}


def test_a_doc_id_of_many_rows(spark):
    """Tokens: rows of one doc_id and of none are dealt over tasks; passages: copies of a doc_id's text stay one class."""
    import public_tokenizers

    rows = [(None if i % 2 else 7, f"row {i}") for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tiny ones would be put together again
    path = token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), public_tokenizers.path("word_bpe_49k.json"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_store.token_digests(spark, path).collect()
    assert len(got) == 400 and token_store.read_index(spark, path).select("part").distinct().count() > 2
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None] * 200 + [7] * 200
    text = " ".join(f"w{i}" for i in range(80))
    docs = [(9, text), (9, text), (4, text), (4, text), (12, "x " + text + " y"), (3, "other " * 60)]
    assert sorted((tuple(r)[:4] for r in substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()), key=str) == removed(docs)
