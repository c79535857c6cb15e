import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, normalizers

from tessera.llm import token_store as ts

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    tok, at, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


ODD = [
    (5, "It's  we'll O'NEIL'S ... a,b.c !?? x\ty\n\nz İΣΑΣ é <|endoftext|>a 12½ ñandú| *** éa"), (1, None), (2, ""), (3, "word " * 30_000), (None, "no id"),
    (4, "same"), (4, "same"), (9, "​  x \x1c y\x85z ﬁ Ǆ µ ×÷ ª.b |\n|"),
]


def test_odd_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, t, -1, "x") for i, t in ODD], "doc_id long, text string, n_tokens int, tokens string")
    path = ts.write_tokens(df, PATH)
    got = [tuple(r) for r in ts.token_digests(spark, path).collect()]
    assert sorted(got, key=str) == sorted(expected(ODD), key=str)


def test_documents_and_selective_reads(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    path = ts.write_tokens(docs, PATH, encoding="dictionary")
    assert sorted(tuple(r) for r in ts.token_digests(spark, path).collect()) == sorted(expected(rows))
    part = ts.read_tokens(spark, path, 10, 12)
    assert {r.doc_id for r in part.collect()} == {10, 11, 12}
    assert "PushedFilters" in part._jdf.queryExecution().toString()
    assert {(r.doc_id, r.start) for r in ts.read_index(spark, path).collect()} == {x[:2] for x in expected(rows)}


def test_empty_table_and_bad_encoding(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ts.token_digests(spark, ts.write_tokens(empty, PATH)).count() == 0
    with pytest.raises(ValueError):
        ts.write_tokens(empty, PATH, encoding="plain")


class Spy:
    """A tokenizer that notes the texts it gets."""

    def __init__(self, tok):
        self.tok, self.seen = tok, []

    def encode_batch_fast(self, texts, **more):
        self.seen += texts
        return self.tok.encode_batch_fast(texts, **more)


def test_new_words_of_letters_pass_by_the_normaliser():
    """Normalising and splitting words that are lower-case letters already was most of their cost; pieces of one word in several forms were all kept."""
    whole, enc = Tokenizer.from_file(PATH), ts.WordEncoder(PATH)
    enc.tok = Spy(whole)
    forms = [f(a + b) + tail for a in ("thing", "ßchver", "éaux", "ÿþð", "ñ") for b in ("ou", "ÀÖ", "Ø", "y") for f in (str, str.title, str.swapcase) for tail in ("", "!!", ".,*")]
    texts = [" ".join(forms), " ".join(forms[::-1]) + " don't it's 4th <|endoftext|> Œuvre e\u0301t\u00e9", None, "\n"]
    ids, size = enc.encode(pa.array(texts), 2)
    expected = [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert ids.tolist() == sum(expected, []) and size.tolist() == [len(x) for x in expected]
    assert not {"thingou", "ñy"} & set(" ".join(enc.tok.seen).lower().split())
    assert max(len(x) for x in vars(enc).values() if isinstance(x, dict)) < len(set(forms)) / 2


def test_file_of_another_normaliser(tmp_path):
    tok = Tokenizer.from_file(PATH)
    tok.normalizer = normalizers.Sequence([normalizers.NFD(), normalizers.StripAccents(), normalizers.Lowercase()])
    tok.save(path := str(tmp_path / "other.json"))
    text = "Été ñandú über, naïve!! plain"
    assert ts.WordEncoder(path).encode(pa.array([text]), 2)[0].tolist() == [*tok.encode(text, add_special_tokens=False).ids, 2]
