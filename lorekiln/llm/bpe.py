"""Byte-pair encoding of whole texts to token ids, and decoding of ids to texts, on a byte-level tokenizer file.

A text is cut at added tokens, then into the pieces of the byte-level pre-tokenizer. The bytes of a piece form a doubly linked
list of symbols, and every neighbouring pair that the merge table knows lies in a priority queue under (rank, position). The least
entry is taken out; it is stale, and is skipped, where its symbol was swallowed or the pair now standing there makes
another symbol. Else the pair becomes one symbol, and the pairs it makes with both neighbours enter the queue. So a piece of n bytes
costs O(n log n), also one of several megabytes. A worker remembers the ids of pieces, which changes no result.

Decoding joins the vocabulary strings of the ids, as bytes, and reads them as UTF-8; a malformed sequence becomes U+FFFD.

Texts of usual characters, for which all Unicode versions agree, are cut by one regular expression; of others only the
cutting is left to the library's pre-tokenizer, since letters and digits are what its version of Unicode says.

Defined cases: null and empty texts have no ids; null ids decode to null, no ids to an empty text; null or unknown ids among others
are passed over, as the library does; repeated rows are repeated; empty tables give empty results; what else a table
holds is carried along, whatever it is called, and a column with the name of the result is replaced by it.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lorekiln.llm import shared, token_files

#: Pieces that a worker keeps, and the longest it keeps; past the first it forgets all and begins anew.
MEMO_PIECES, MEMO_CHARS = 1_000_000, 64


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


class Bpe:
    """Vocabulary, merges and cutting rules of a tokenizer file. Files of other kinds than plain byte-level BPE are refused."""

    def __init__(self, path: str):
        self.made = token_files.tokenizer(path)
        form = json.loads(self.made.to_str())
        model, cut, added = form["model"], form.get("pre_tokenizer") or {}, form.get("added_tokens", [])
        fits = model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not form.get("normalizer")
        fits = fits and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not fits or any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} isn't a plain byte-level BPE tokenizer")
        vocab, alphabet = model["vocab"], byte_alphabet()
        self.byte_id = [vocab[c] for c in alphabet]
        self.char_id = dict(zip(alphabet, self.byte_id, strict=True))
        #: pair of symbols -> rank of its merge; rank -> the symbol it makes
        self.rank: dict[tuple[int, int], int] = {}
        self.makes: list[int] = []
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = k
            self.makes.append(vocab[a + b])
        self.added = {x["content"]: x["id"] for x in added}
        self.cut_added = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")").split if added else lambda t: [t]
        self.usual_pieces, self.unusual = re.compile(token_files.pieces()).findall, re.compile(f"[^{token_files.USUAL}]").search
        self.memo: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, by rank and then from the left."""
        n, rank, makes = len(symbols), self.rank, self.makes
        queue = [(r, k) for k, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank.get(pair)) is not None]  # noqa: B905
        if not queue:
            return symbols
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            r, k = heappop(queue)
            left, j = symbols[k], after[k]
            if left < 0 or j == n:
                continue
            now, made = rank.get((left, symbols[j])), makes[r]
            if now is None or makes[now] != made:
                continue
            symbols[k], symbols[j], after[k] = made, -1, (j2 := after[j])
            if j2 < n:
                before[j2] = k
                if (r := rank.get((made, symbols[j2]))) is not None:
                    heappush(queue, (r, k))
            if (i := before[k]) >= 0 and (r := rank.get((symbols[i], made))) is not None:
                heappush(queue, (r, i))
        return [s for s in symbols if s >= 0]

    def _learn(self, pieces: set[str]) -> None:
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        byte_id = self.byte_id.__getitem__
        for piece in pieces.difference(self.memo):
            self.memo[piece] = array("i", self.merge(list(map(byte_id, piece.encode())))).tobytes()

    def _segment(self, text: str) -> bytes:
        """The ids of a text without added tokens. Only pieces of a usual length are remembered."""
        if self.unusual(text):
            found = self.made.pre_tokenizer.pre_tokenize_str(text)
            return b"".join(array("i", self.merge([self.char_id[c] for c in piece])).tobytes() for piece, _ in found)
        pieces = self.usual_pieces(text)
        memo = self.memo
        try:
            return b"".join(map(memo.__getitem__, pieces))
        except KeyError:
            self._learn(set(pieces))
        out = b"".join(map(self.memo.__getitem__, pieces))
        for piece in {p for p in pieces if len(p) > MEMO_CHARS}:
            del self.memo[piece]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text, as 32-bit integers."""
        if not any(x in text for x in self.added):
            return self._segment(text)
        parts = self.cut_added(text)
        return b"".join(array("i", [self.added[x]]).tobytes() if k % 2 else self._segment(x) for k, x in enumerate(parts) if x)

def vocabulary(path: str) -> list[bytes]:
    """The bytes of each id. Read from the file alone: what decodes needs neither merges nor the library."""
    if path not in _strings:
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        known = [*form["model"]["vocab"].items(), *((x["content"], x["id"]) for x in form.get("added_tokens", []))]
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        strings = [b""] * (1 + max(k for _, k in known))
        for token, k in known:
            strings[k] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        _strings[path] = strings
    return _strings[path]


_strings: dict[str, list[bytes]] = {}


def text_of(strings: list[bytes], ids: list[int | None]) -> str:
    try:
        found = b"".join(map(strings.__getitem__, ids)) if not ids or min(ids) >= 0 else None
    except (IndexError, TypeError):
        found = None
    if found is None:
        found = b"".join(strings[k] for k in ids if k is not None and 0 <= k < len(strings))
    return found.decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The tokenizer of a file, once for each worker process."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    """The batch with a column at its end."""
    return pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])


def _carried(df: DataFrame, name: str) -> DataFrame:
    """Without the column that a result replaces."""
    return df.drop(*[c for c in df.columns if c.lower() == name.lower()])


def encoded(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the token ids of their texts (array<int>). Without a shuffle."""
    t, out = shared.fresh(docs.columns, "t", ids_col)
    rows = docs.withColumn(t, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).drop(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path)
        for part in shared.slices(batches, t):
            found = [bpe.encode(x) for x in part.column(t).to_pylist()]
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
            yield _with(part.drop_columns([t]), out, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32))))

    schema = StructType([*[f for f in rows.schema if f.name != t], StructField(out, ArrayType(IntegerType()))])
    made = rows.mapInArrow(each, schema)
    return made if out == ids_col else _carried(made, ids_col).withColumnRenamed(out, ids_col)


def decoded(tokens: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """tokens with the texts of their ids. Without a shuffle."""
    (out,) = shared.fresh(tokens.columns, text_col)
    at = next(k for k, c in enumerate(tokens.columns) if c.lower() == ids_col.lower())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = vocabulary(tokenizer_path)
        for batch in batches:
            step = max(1, (shared.SLICE_BYTES * max(1, batch.num_rows)) // max(1, batch.column(at).nbytes))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                texts = [None if ids is None else text_of(strings, ids) for ids in _lists(part.column(at))]
                yield _with(part, out, pa.array(texts, pa.string()))

    made = tokens.mapInArrow(each, StructType([*tokens.schema, StructField(out, StringType())]))
    return made if out == text_col else _carried(made, text_col).withColumnRenamed(out, text_col)


def _lists(column: pa.ListArray) -> Iterator[list[int | None] | None]:
    values, valid = column.flatten().to_pylist() if column.flatten().null_count else column.flatten().to_numpy(zero_copy_only=False).tolist(), column.is_valid().to_pylist()
    ends = np.cumsum(np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)).tolist()
    begin = 0
    for ok, end in zip(valid, ends, strict=True):
        yield values[begin:end] if ok else None
        begin = end
