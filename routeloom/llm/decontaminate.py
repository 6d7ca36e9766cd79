"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may be found with at most e = n // ``chars_per_edit``
edits. Cut into e + 1 pieces, any such occurrence holds one piece unchanged, so the
exact hits of all pieces (one automaton) are the only places to look; each is
verified with Myers' bit-parallel distance over the stretch of text around it.

Both sides are compared in lower case with white space collapsed. Items travel in
blocks of bounded size (``block_chars``): where there are several, each is fetched,
searched for and its result written before the next is fetched, so a large benchmark
takes more passes, not more memory. Texts are searched whole, however long.

Items shorter than ``min_chars`` after normalising are found unedited only, and not
inside a longer word of letters or digits; writing systems without spaces have no such
words. Null or empty texts match nothing, null or blank items nowhere. Repeated rows
each give their matches, repeated items one. Ties between places go to the least
distance, then the first. Empty tables: no matches. Other columns, whatever their
names, play no part and pass through ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm.common import Scratch, small_batches, with_text


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def cut_pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of edits + 1 pieces of near-equal length."""
    n = edits + 1
    at = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:], strict=False)]


class Myers:
    """Least edit distance of a pattern to any substring, by Myers' bit vectors in one big integer."""

    def __init__(self, pattern: str):
        self.n = len(pattern)
        self.mask = (1 << self.n) - 1
        self.top = 1 << (self.n - 1)
        self.eq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.eq[c] = self.eq.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end) of the best substring; the first end on ties."""
        pv, mv, score, mask, top, eq = self.mask, 0, self.n, self.mask, self.top, self.eq
        least, at = score, 0
        for j, c in enumerate(text):
            e = eq.get(c, 0)
            xv = e | mv
            xh = (((e & pv) + pv) ^ pv) | e
            ph = mv | ~(xh | pv) & mask
            mh = pv & xh
            if ph & top:
                score += 1
            if mh & top:
                score -= 1
            ph = ph << 1 & mask  # a substring may begin anywhere
            pv = (mh << 1 & mask) | ~(xv | ph) & mask
            mv = ph & xv
            if score < least:
                least, at = score, j + 1
        return least, at


def _stands_alone(text: str, a: int, b: int) -> bool:
    spaced = lambda c: c.isalnum() and c < "\u2e80"
    return not (a > 0 and spaced(text[a - 1]) and spaced(text[a]) or b < len(text) and spaced(text[b - 1]) and spaced(text[b]))


class Matcher:
    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int, min_chars: int):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.items: list[tuple[int, str, int, Myers]] = []
        self.short: list[bool] = []
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            item = normalise(raw)
            if not item:
                continue
            edits = len(item) // chars_per_edit if len(item) >= min_chars else 0
            self.short.append(len(item) < min_chars)
            for at, piece in cut_pieces(item, edits):
                where.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, item, edits, Myers(item)))
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def match(self, raw: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text) of each item found."""
        if not self.items or not raw:
            return []
        text = normalise(raw)
        starts: dict[int, list[int]] = {}
        for end, (n, places) in self.automaton.iter(text):
            for k, at in places:
                starts.setdefault(k, []).append(end + 1 - n - at)
        out = []
        for k, found in starts.items():
            item_id, item, edits, myers = self.items[k]
            if self.short[k]:
                at = next((s for s in found if _stands_alone(text, s, s + len(item))), None)
                if at is not None:
                    out.append((item_id, 0, at + len(item)))
                continue
            exact = text.find(item)
            if exact >= 0:
                out.append((item_id, 0, exact + len(item)))
                continue
            best, upto = None, -1
            # stretches around hits, joined where they overlap
            stretches: list[list[int]] = []
            for s in sorted(set(found)):
                a, b = max(0, s - 2 * edits), s + len(item) + 2 * edits
                if stretches and a <= stretches[-1][1]:
                    stretches[-1][1] = max(stretches[-1][1], b)
                else:
                    stretches.append([a, b])
            for a, b in stretches:
                d, end = myers.best(text[a:b])
                if d <= edits and (best is None or d < best):
                    best, upto = d, a + end
            if best is not None:
                out.append((item_id, best, upto))
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> tuple[DataFrame, int]:
    """The items (i, t, block) and the number of blocks."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    blocks = -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // block_chars)
    return items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(max(1, blocks)))), blocks


def _fetched(items: DataFrame, block: int) -> list[tuple[int, str]]:
    return [(r["i"], r["t"]) for r in items.where(F.col("block") == block).orderBy("i", "t").collect()]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, chars_per_edit: int = 16, min_chars: int = 24, block_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per document and item found in it: id, item id, distance, end."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = with_text(docs.select(F.col(id_col), F.col(text_col).alias("text")))
    schema = f"{id_col} {rows.schema[id_col].dataType.simpleString()}, {item_col} long, distance long, end long"

    def search(rows: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, chars_per_edit, min_chars)
            for b in batches:
                out = [(r, *hit) for r, t in enumerate(b.column(1).to_pylist()) for hit in matcher.match(t)]
                cols = list(zip(*out, strict=True)) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[id_col, item_col, "distance", "end"])

        return rows.mapInArrow(run, schema)

    items, blocks = _blocks(benchmark, item_col, item_text_col, block_chars)
    scratch, found = Scratch(spark, "contaminated"), spark.createDataFrame([], schema)
    for b in range(blocks):
        hits = search(rows, _fetched(items, b))
        found = hits if blocks == 1 else found.unionByName(scratch.save(hits, f"block-{b}"))
    return found


def clean(
    docs: DataFrame, benchmark: DataFrame, *, chars_per_edit: int = 16, min_chars: int = 24, block_chars: int = 4_000_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows of docs in whose text no item is found, whatever their id."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def search(rows: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, chars_per_edit, min_chars)
            for b in batches:
                yield b.filter(pa.array([not matcher.match(t or "") for t in b.column(at).to_pylist()], pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    items, blocks = _blocks(benchmark, item_col, item_text_col, block_chars)
    scratch, left = Scratch(docs.sparkSession, "clean"), docs
    for b in range(blocks):
        left = search(left, _fetched(items, b))
        left = left if blocks == 1 else scratch.save(left, f"block-{b}")
    return left
