"""Sequence packing along a space-filling curve.

1. Tokenise; hash each document's tokens to a small vector, project it to few
   dimensions and take its Hilbert key. Written once, ids as compact binary.
2. Range-sort the keys (no texts or ids) and turn token counts into one global
   running offset: sums inside range partitions plus one total per partition.
3. Join offsets back by row id and cut each document where its tokens cross a
   sequence boundary. Neighbours on the curve share sequences.

Only the last sequence has padding. What reaches the driver is one total per range
partition. Null text: only the end id. Repeated document ids: each row is its own
document. Empty table: no pieces. Ties in the key fall by row id. A very long text is
tokenised in one task and cut like any other. Other columns, whatever their names, play
no part.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeloom.llm.common import Scratch, small_batches, with_text

DIMS, BITS, HASHED = 4, 12, 64
KEEP_CHUNKS = 300_000


class ChunkTokenizer:
    """ids of a text, with a store of ids by space-separated chunk.

    In this vocabulary's splitting pattern a chunk after a single space is split and
    merged alike wherever it stands, as long as no space is followed by more white
    space; other texts, and those with a special token's string, go to the
    tokenizer whole.
    """

    ODD = re.compile(r" \s|\s\Z")
    STEM = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[!-/:-@\[-`{-~\n]|\Z)")

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.whole.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.fast = self._same_ranks() if self.whole.get_vocab_size() > 256 else None
        rng = np.random.default_rng(20)
        n = self.whole.get_vocab_size() + 1
        self.bucket = rng.integers(0, HASHED, n)
        self.sign = rng.choice([-1.0, 1.0], n)
        self.project = rng.standard_normal((HASHED, DIMS))

    def _same_ranks(self):
        """The vocabulary as merge ranks for a faster library, if a piece's id is its rank."""
        import json

        import public_tokenizers
        import tiktoken

        model = json.loads(self.whole.to_str())["model"]
        merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model.get("merges", [])]
        if model["type"] != "BPE" or None in merged or merged != sorted(merged):
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in printable]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(map(to_byte.get, t)): i for t, i in model["vocab"].items() if t not in self.special}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _chunk_ids(self, chunks: list[str]) -> list[bytes]:
        if self.fast is None:
            return self._ids(chunks)
        encode, code, stems, tails, out = self.fast.encode_ordinary, "H" if self.dtype.itemsize == 2 else "I", self.stems, self.tails, []
        for c in chunks:
            if m := self.STEM.match(c):
                # letters end a piece of the pattern, so what follows them is split by itself
                stem, tail = m[0], c[m.end() :]
                if (x := stems.get(stem)) is None:
                    x = stems[stem] = array(code, encode(stem)).tobytes()
                if tail:
                    if (y := tails.get(tail)) is None:
                        y = tails[tail] = array(code, encode(tail)).tobytes()
                    x += y
                out.append(x)
            else:
                out.append(array(code, encode(c)).tobytes())
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """ids as little-endian bytes, the end id last."""
        for kept in (self.later, self.first, self.stems, self.tails):
            if len(kept) > KEEP_CHUNKS:
                kept.clear()
        end = np.asarray([end_id], self.dtype).tobytes()
        split = [None if self.ODD.search(t) or any(s in t for s in self.special) else t.split(" ") for t in texts]
        new = list(set().union(*(c[1:] for c in split if c)).difference(self.later))
        self.later.update(zip(new, self._chunk_ids([" " + c for c in new]), strict=True))
        head = list({c[0] for c in split if c}.difference(self.first))
        self.first.update(zip(head, self._chunk_ids(head), strict=True))
        odd = [i for i, c in enumerate(split) if c is None]
        whole = dict(zip(odd, self._ids([texts[i] for i in odd]), strict=True))
        later, out = self.later.__getitem__, []
        for i, c in enumerate(split):
            out.append(whole[i] + end if c is None else self.first[c[0]] + b"".join(map(later, c[1:])) + end)
        return out

    def vectors(self, rows: list[np.ndarray]) -> np.ndarray:
        """Hashed, normalised and projected: one row of DIMS values near [-1, 1] per document."""
        v = np.stack([np.bincount(self.bucket[r], self.sign[r], HASHED) for r in rows])
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        return v @ self.project / 3


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer cells (rows of coordinates below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


_tokenizers: dict[str, ChunkTokenizer] = {}


def _tokenizer(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def pack(docs: DataFrame, tokenizer_path: str, *, length: int = 2048, end_id: int = 1, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids (array) if asked for."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "packing")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = with_text(docs.select(id_col, text_col), text_col)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer_path)
        for b in batches:
            if not b.num_rows:
                continue
            ids = tok.encode(b.column(1).to_pylist(), end_id)
            flat = [np.frombuffer(x, tok.dtype) for x in ids]
            cells = ((np.clip(tok.vectors(flat), -1, 1) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in flat], pa.int64()), pa.array(hilbert_keys(cells, BITS), pa.int64()), pa.array(ids, pa.binary()), pa.array([tok.dtype.itemsize] * len(ids), pa.int32())],
                names=[id_col, "doc_tokens", "key", "ids", "width"],
            )

    tokens = scratch.save(
        rows.mapInArrow(tokenise, f"{id_col} {kind}, doc_tokens long, key long, ids binary, width int").withColumn("rid", F.monotonically_increasing_id()),
        "tokens",
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = scratch.save(tokens.select("rid", "key", "doc_tokens").repartitionByRange(parts, "key", "rid").withColumn("part", F.spark_partition_id()), "keys")
    totals = sorted(tuple(r) for r in keys.groupBy("part").agg(F.sum("doc_tokens")).collect())
    bases, base = [], 0
    for part, total in totals:
        bases.append((part, base))
        base += total
    before = Window.partitionBy("part").orderBy("key", "rid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keys.withColumn("at", F.coalesce(F.sum("doc_tokens").over(before), F.lit(0)))
        .join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part")
        .select("rid", (F.col("at") + F.col("base")).alias("at"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, ids, width, at in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                flat = np.frombuffer(ids, f"<u{width}").astype("<u4")
                start = 0
                while start < len(flat):
                    offset = (at + start) % length
                    piece = flat[start : start + length - offset]
                    out.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(flat), (at + start) // length, offset, piece))
                    start += len(piece)
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            arrays = [pa.array(cols[0], b.column(0).type), *(pa.array(c, pa.int64()) for c in cols[1:7])]
            if with_ids:
                arrays.append(pa.array([p.astype(np.int32) for p in cols[7]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "ids"][: len(arrays)])

    return (
        tokens.select("rid", id_col, "ids", "width")
        .join(offsets, "rid")
        .select(id_col, "ids", "width", "at")
        .mapInArrow(cut, f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
    )
