import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from lorekiln.llm import token_files

PATH = P.path("byte_bpe_50k.json")
ODD = ["", " ", "  two  spaces ", "it's they'll I'VE '' 'x", "line\n\n  indented\r\n\ttab", "日本語 text", "a b\u0085c\x1cd\x0be", "<|endoftext|> plain", "é" * 50, "😀 ½ ²³ ª", "ꬰ new", "x" * 3000, "1234567890 12a3"]


def whole(texts):
    return [e.ids for e in token_files.tokenizer(PATH).encode_batch(texts, add_special_tokens=False)]


def test_pieces_encode_like_whole_texts(monkeypatch):
    rnd = random.Random(1)
    alphabet = "ab é'sßñ. \n\t12-—’“Ωж中  \x1f²ªǅ'll 've"
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    for path in (PATH, P.path("word_bpe_49k.json")):
        made = token_files.Encoder(path, 2)
        assert made.by_pieces == (path == PATH)
        want = [e.ids for e in token_files.tokenizer(path).encode_batch(texts, add_special_tokens=False)]
        for size in (20, 500_000):
            monkeypatch.setattr(token_files, "MEMO_PIECES", size)
            got = [x for a in range(0, len(texts), 100) for x in made.encode(texts[a : a + 100])]
            assert [np.frombuffer(x, "<u2").tolist() for x in got] == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the test tables aren't here")
def test_every_document_encodes_as_the_library_does():
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    texts += [f"a{x}b {x}\n{x}" for x in ("<|endoftext|>", "<|endoftext|", "|endoftext|>")] + ODD
    made = token_files.Encoder(PATH, 2)
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in made.encode(texts)] == want
    assert any(50256 in x for x in want)


@pytest.fixture
def many_partitions(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, old)


def test_round_trip(spark, tmp_path, many_partitions):
    rnd = random.Random(2)
    rows = [(k * 7 % 101, t, 5) for k, t in enumerate(ODD)] + [(None, "null id", 1), (3, None, 1), (50, "again", 1), (50, "again", 1), (50, "other", 1)]
    rows += [(1000 + k, " ".join(rnd.choice(ODD) for _ in range(5)), 1) for k in range(200)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(5)
    parts = token_files.write(df, PATH, str(tmp_path))
    assert len(parts) > 1
    out = sorted(token_files.read(spark, parts).collect(), key=lambda r: r.start)
    assert [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out])[:-1]]
    ids = [r.doc_id for r in out]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    assert sorted((str(r.doc_id), r.ids) for r in out) == sorted((str(i), [*x, 2]) for (i, _, _), x in zip(rows, whole([t or "" for _, t, _ in rows])))
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in out)
    part = token_files.Part(parts[1][0])
    assert part.width == 2 and part.tokens(0).tolist() == next(r.ids for r in out if r.start == parts[1][1])


def test_empty_table_and_damage(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.write(df, PATH, str(tmp_path)) == []
    assert token_files.read(spark, []).count() == 0
    ((stem, *_),) = token_files.write(spark.createDataFrame([(1, "a b")], df.schema), PATH, str(tmp_path))
    with open(stem + ".bin", "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        token_files.Part(stem)
