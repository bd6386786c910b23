import os
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lorekiln.llm import bpe
from lorekiln.llm import queries as Q

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "\n", "  two  spaces ", "it's they'll I'VE '' 'x", "line\n\n  indented\r\n\ttab", "日本語 text", "a b\u0085c\x1cd\x0be", "é" * 50, "😀 ½ ²³ ª", "ꬰ new", "x" * 3000, "1234567890 12a3", "a\x00b", "퟿"]
ADDED = ["<|endoftext|> plain", "<|endoftext|><|endoftext|> a <|endoftext|", "|endoftext|>x<|endoftext|>\n日本"]


def of_library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def in_rank_order(text):
    """The pieces of the library's pre-tokenizer, each merged by scanning for its least pair again and again."""
    made, out = bpe.loaded(PATH), []
    for piece, _ in LIBRARY.pre_tokenizer.pre_tokenize_str(text):
        s = [made.char_id[c] for c in piece]
        while known := [(made.rank[p], k) for k, p in enumerate(zip(s, s[1:])) if p in made.rank]:
            r, k = min(known)
            s[k : k + 2] = [made.makes[r]]
        out += s
    return out


def encode(made, text):
    raw = made.encode(text)
    return [int.from_bytes(raw[k : k + 4], "little") for k in range(0, len(raw), 4)]


@pytest.mark.parametrize("size", [30, 1_000_000])
def test_equals_the_library_and_a_plain_scan(monkeypatch, size):
    monkeypatch.setattr(bpe, "MEMO_PIECES", size)
    rnd, made = random.Random(1), bpe.Bpe(PATH)
    texts = ODD + ADDED
    for alphabet, long in (("ab é'sßñ. \n\t12-—’“Ωж中  \x1f²ªǅ'll 've", 60), ("abcdehtinrs", 300), ("aab", 200)):
        texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, long))) for _ in range(400)]
    for t in texts:
        ids = encode(made, t)
        assert ids == of_library(t), t
        assert bpe.text_of(bpe.vocabulary(PATH), ids) == t == LIBRARY.decode(ids, skip_special_tokens=False)
        if t not in ADDED:
            assert ids == in_rank_order(t)


def test_decoding_of_any_ids_is_the_librarys():
    rnd = random.Random(2)
    for _ in range(1500):
        ids = [rnd.randrange(50_300) for _ in range(rnd.randint(0, 30))]
        assert bpe.text_of(bpe.vocabulary(PATH), ids) == LIBRARY.decode(ids, skip_special_tokens=False)
    assert bpe.text_of(bpe.vocabulary(PATH), [72, None, -1, 10**6, 73]) == bpe.text_of(bpe.vocabulary(PATH), [72, 73])


def test_a_word_of_a_megabyte():
    made, text = bpe.loaded(PATH), "abcdefghijklmnopqrstuvwxyzé" * 40_000
    assert encode(made, text) == of_library(text)
    assert text not in made.memo


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError, match="isn't a plain"):
        bpe.Bpe(P.path("word_bpe_49k.json"))


def test_rows(spark):
    rows = [(k, t, k % 2, "kept") for k, t in enumerate(ODD + ADDED)] + [(None, "null id", 1, None), (3, None, 1, ""), (50, "again", 1, "x"), (50, "again", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, T string").repartition(3)
    ids = bpe.encoded(docs, PATH)
    assert ids.columns == ["doc_id", "T", "ids"]
    key = lambda r: (str(r[0]), str(r[1]), str(r[2]))
    assert sorted(map(tuple, ids.collect()), key=key) == sorted(((i, x, of_library(t or "")) for i, t, _, x in rows), key=key)
    whole = bpe.decoded(ids, PATH)
    assert sorted(map(tuple, whole.select("doc_id", "T", "text").collect()), key=key) == sorted(((i, x, t or "") for i, t, _, x in rows), key=key)
    assert bpe.encoded(docs.limit(0), PATH).count() == 0 and bpe.decoded(ids.limit(0), PATH).count() == 0
    odd = spark.createDataFrame([(1, None, "old"), (2, [], "old"), (3, [72, None, 99999999, -4, 73], "old")], "k int, ids array<int>, text string")
    assert sorted(map(tuple, bpe.decoded(odd, PATH).select("k", "text").collect())) == [(1, None), (2, ""), (3, bpe.text_of(bpe.vocabulary(PATH), [72, 73]))]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test tables aren't here")
def test_query_over_the_whole_table(spark):
    import hashlib

    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for r in table:
        ids = of_library(r["text"] or "")
        want[r["doc_id"]] = (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False)))
    out = Q.op11_bpe(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == want
