"""Token counts under a unigram vocabulary, by dynamic programming shared over a trie.

A pre-token is a white-space word with the word mark in front. Distinct pre-tokens
are visited in sorted order, which is the depth-first order of their trie: the
forward score of a prefix is computed once and reused by every pre-token below it,
and the count at each terminal is stored. A document's count is the sum of the
stored counts of its words. Tasks are independent: no shuffle, no collected state.

Scores: the vocabulary file lists pieces by rank, and a piece's log-probability is
taken by Zipf's law on that rank, in fixed point so that sums are exact. Among the
best segmentations the one with fewest tokens counts. A character outside the
vocabulary costs one token for each of its UTF-8 bytes.

Null or empty text: zero tokens. Repeated rows: counted each. Empty table: no rows. A
very long text is split in one task; a very long word takes time in proportion to its
length. Other columns of the input, whatever their names, do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from routeloom.llm.common import small_batches, with_text

MARK = "▁"
SCALE = 1 << 20
COUNT_BITS = 32
#: Words whose counts a worker keeps between batches.
KEEP_WORDS = 300_000


class UnigramCounter:
    def __init__(self, pieces: dict[str, int]):
        """pieces: piece to rank, from 0."""
        self.cost = {p: (round(math.log(r + 2) * SCALE) << COUNT_BITS) + 1 for p, r in pieces.items()}
        worst = round((math.log(len(pieces) + 2) + 10) * SCALE)
        self.byte_cost = (worst << COUNT_BITS) + 1
        self.tails = {p[i:] for p in pieces for i in range(len(p))}
        self.counts: dict[str, int] = {}

    @classmethod
    def from_sentencepiece(cls, path: str) -> UnigramCounter:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        return cls({sp.id_to_piece(i): rank for rank, i in enumerate(kept)})

    def insert(self, words: Iterable[str]) -> None:
        """Store the counts of words, in one walk over their trie."""
        cost, tails, counts, mask = self.cost, self.tails, self.counts, (1 << COUNT_BITS) - 1
        path, forward = "", [0]
        for word in sorted(words):
            s = MARK + word
            shared, most = 0, min(len(s), len(path))
            while shared < most and s[shared] == path[shared]:
                shared += 1
            del forward[shared + 1 :]
            for end in range(shared + 1, len(s) + 1):
                best = forward[end - 1] + len(s[end - 1].encode("utf-8", "surrogatepass")) * self.byte_cost
                start = end - 1
                while start >= 0 and (tail := s[start:end]) in tails:
                    if tail in cost and (total := forward[start] + cost[tail]) < best:
                        best = total
                    start -= 1
                forward.append(best)
            path = s
            counts[word] = forward[-1] & mask

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(words, tokens) of each text."""
        if len(self.counts) > KEEP_WORDS:
            self.counts.clear()
        split = [t.split() for t in texts]
        new = set().union(*split).difference(self.counts) if split else set()
        self.insert(new)
        get = self.counts.__getitem__
        return [(len(words), sum(map(get, words))) for words in split]


_counters: dict[str, UnigramCounter] = {}


def _counter(path: str) -> UnigramCounter:
    if path not in _counters:
        _counters[path] = UnigramCounter.from_sentencepiece(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_tokens``."""
    small_batches(docs.sparkSession)
    rows = with_text(docs.select(id_col, text_col), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocab_path)
        for b in batches:
            n = counter.count(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in n], pa.int64()), pa.array([x[1] for x in n], pa.int64())], names=[id_col, "n_words", "n_tokens"])

    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, n_words long, n_tokens long")
