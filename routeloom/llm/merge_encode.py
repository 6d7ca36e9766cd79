"""Exact merge-type encoding by backtracking, and decoding.

A merge-type vocabulary joins the best adjacent pair of symbols, again and again. What
it ends with is the only sequence of pieces whose every adjacent pair is *compatible*:
the two pieces' text, merged by itself, gives just these two. So no merge queue over the
text is needed:

1. one Aho-Corasick pass gives the longest piece at every position;
2. pieces are laid from left to right, longest first, each checked against the one
   before it by re-merging the two (answers are kept per pair of pieces);
3. where nothing fits, the last piece is taken back and shortened, and the position is
   marked in a bitfield as failed, so that it is never tried again. Every position fails
   at most once: time grows with the text, not with the number of its splits.

Characters outside the vocabulary are walls that no merge crosses; they become their
bytes' pieces, or the unknown piece (one for a run) where the vocabulary has no bytes.
No merge crosses a place whose two characters stand side by side in no piece. Texts fall
apart there: before every run of space marks, and between letters and other characters,
as far as the vocabulary's own pieces allow. Workers keep the ids of short chunks in a
bounded store.

Encoding and decoding are column expressions over Arrow batches: no shuffle, no state
between rows. Null or empty text: no ids; null ids: null text. Repeated rows are encoded
each. Empty table: no rows. A very long text is encoded in one task, in time linear in its
length. Other columns are left as they are; the result column is the caller's choice.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.llm.common import small_batches

MARK = "▁"
#: Bounds of what a worker keeps: chunks, characters of a kept chunk, pairs of pieces.
KEEP_CHUNKS, CHUNK_CHARS, KEEP_PAIRS = 400_000, 48, 2_000_000
#: How the vocabulary must treat white space and composed letters: kept, but for one mark in front.
PROBE = "  a  b é é ﬁ\t\n c "


class Pieces:
    """A vocabulary: texts, scores and kinds of its pieces."""

    def __init__(self, texts: dict[str, tuple[int, float]], byte_ids: list[int] | None, unknown: int, names: list[str] | None = None, silent: frozenset[int] = frozenset()):
        """texts: piece to (id, score), a higher score merges first. byte_ids: ids of the 256 bytes, or None."""
        import ahocorasick

        self.texts, self.byte_ids, self.unknown = texts, byte_ids, unknown
        self.ids_of = {t: [i] for t, (i, _) in texts.items()}
        self.letters = {c for t in texts for c in t}
        self.chunk = self._chunk_pattern()
        self.pairs: dict[str, dict[str, bool]] = {}
        self.kept_pairs = 0
        self.chunks: dict[str, bytes] = {}
        # a letter may lack a piece of its own; it still takes part in merges
        self.usable = {t for t in texts if self._merge(t) == [t]} | self.letters
        self.shorter = {t: next((t[:n] for n in range(len(t) - 1, 0, -1) if t[:n] in self.usable), None) for t in self.usable}
        self.automaton = ahocorasick.Automaton()
        for t in self.usable:
            self.automaton.add_word(t, (len(t) - 1, t))
        self.automaton.make_automaton()
        self.walls = re.compile("([^" + "".join(map(re.escape, sorted(self.letters))) + "]+)")
        self.names, self.silent = names or [], silent
        self.raw = [(b"" if i in silent else n.replace(MARK, " ").encode()) for i, n in enumerate(self.names)]
        for value, i in enumerate(byte_ids or ()):
            self.raw[i] = bytes([value])
        self.bytes_of = {i: v for v, i in enumerate(byte_ids or ())}

    @classmethod
    def from_sentencepiece(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(PROBE) != MARK + PROBE.replace(" ", MARK):
            raise ValueError("only vocabularies that keep the text as it is, with one mark in front, are supported")
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in plain):
            raise ValueError("vocabularies with unused pieces are not supported")
        as_bytes = [i for i in range(n) if sp.is_byte(i)]
        silent = frozenset(i for i in range(n) if sp.is_control(i))
        shown = ["⁇".join("  ") if sp.is_unknown(i) else t for i, t in enumerate(names)]
        return cls({names[i]: (i, sp.get_score(i)) for i in plain}, sorted(as_bytes, key=names.__getitem__) if as_bytes else None, sp.unk_id(), shown, silent)

    def _merge(self, text: str) -> list[str]:
        """The merges themselves, for texts of two pieces at most."""
        at, texts = list(text), self.texts
        while len(at) > 1:
            best, where = None, 0
            for i in range(len(at) - 1):
                known = texts.get(at[i] + at[i + 1])
                if known is not None and (best is None or known[1] > best):
                    best, where = known[1], i
            if best is None:
                break
            at[where : where + 2] = [at[where] + at[where + 1]]
        return at

    def _chunk_pattern(self) -> re.Pattern | None:
        """What texts are cut into. Letters that stand beside a non-letter in some piece count as non-letters."""
        if any(MARK in t.lstrip(MARK) for t in self.texts):
            return None
        beside = {t[i : i + 2] for t in self.texts for i in range(len(t) - 1) if t[i] != MARK}
        letters = {c for c in self.letters if c.isalpha()}
        while mixed := {c for b in beside if (b[0] in letters) != (b[1] in letters) for c in b} & letters:
            letters -= mixed
        known = "".join(map(re.escape, sorted(letters)))
        return re.compile(f"{MARK}*[{known}]+|{MARK}*[^{known}{MARK}]+|{MARK}+" if known else f"{MARK}*[^{MARK}]+|{MARK}+")

    def _fits(self, left: str, right: str) -> bool:
        """Merged by themselves, the two stay the two."""
        if self.kept_pairs > KEEP_PAIRS:
            self.pairs.clear()
            self.kept_pairs = 0
        self.kept_pairs += 1
        known = self.pairs.setdefault(left, {})[right] = self._merge(left + right) == [left, right]
        return known

    def split(self, text: str) -> list[str]:
        """Pieces of a text of known letters."""
        n = len(text)
        longest: list[str] = [""] * n
        for end, (before, piece) in self.automaton.iter(text):
            longest[end - before] = piece  # ends ascend, so the longest is the last
        if n and len(longest[0]) == n:
            return [text]
        pos, out, failed, none = 0, [], bytearray(n // 8 + 1), {}
        pairs, fits, shorter, last = self.pairs, self._fits, self.shorter, None
        piece = longest[0] if n else None
        while pos < n:
            near = pairs.get(last, none)
            while piece is not None:
                end = pos + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    known = last is None or near.get(piece)
                    if known or known is None and fits(last, piece):
                        break
                piece = shorter[piece]
            if piece is None:
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = out.pop()
                pos -= len(piece)
                piece = shorter[piece]
                last = out[-1] if out else None
            else:
                out.append(piece)
                last, pos = piece, end
                piece = longest[pos] if pos < n else None
        return out

    def _of_wall(self, run: str) -> list[int]:
        return [self.unknown] if self.byte_ids is None else [self.byte_ids[b] for b in run.encode("utf-8", "replace")]

    def _of_piece(self, piece: str) -> list[int]:
        known = self.ids_of.get(piece)
        return self._of_wall(piece) if known is None else known

    def chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        if not self.walls.search(chunk):
            for piece in self.split(chunk):
                out += self._of_piece(piece)
            return out
        for i, part in enumerate(self.walls.split(chunk)):
            if i % 2:
                out += self._of_wall(part)
            else:
                for piece in self.split(part):
                    out += self._of_piece(piece)
        return out

    def _stored(self, chunks: Iterable[str]) -> None:
        for c in chunks:
            self.chunks[c] = array("i", self.chunk_ids(c)).tobytes()

    def _cut(self, text: str) -> list[str]:
        """Chunks that no merge crosses."""
        marked = MARK + text.replace(" ", MARK)
        return self.chunk.findall(marked) if self.chunk else [marked]

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text, as little-endian 32-bit integers."""
        if len(self.chunks) > KEEP_CHUNKS:
            self.chunks.clear()
        cut = [self._cut(t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.chunks)
        self._stored(c for c in new if len(c) <= CHUNK_CHARS)
        known = self.chunks.get
        return [b"".join([known(c) or array("i", self.chunk_ids(c)).tobytes() for c in chunks]) for chunks in cut]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, the first one goes, bytes become characters."""
        if not self.silent.isdisjoint(ids):
            return self._decode_runs(ids)
        joined = b"".join(map(self.raw.__getitem__, ids))
        if ids and self.names[ids[0]].startswith(MARK) and ids[0] not in self.bytes_of:
            joined = joined[1:]
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return self._decode_runs(ids)

    def _decode_runs(self, ids: list[int]) -> str:
        """As decode, with a replacement character for every byte that starts no character in its run of byte pieces."""
        out, run, lead = [], bytearray(), True
        for i in [*ids, None]:
            if i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                del run[:n]
                lead = False
            if i is None or i in self.silent:
                continue
            text = self.names[i]
            out.append((text[1:] if lead and text.startswith(MARK) else text).replace(MARK, " "))
            lead = False
        return "".join(out)


_loaded: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces.from_sentencepiece(path)
    return _loaded[path]


def encoded(text: Column, path: str) -> Column:
    """ids (array<int>) of a text column."""

    def ids(texts: pa.Array) -> pa.Array:
        out = _pieces(path).encode(texts.to_pylist())
        ends = np.cumsum([0, *(len(x) // 4 for x in out)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(out), "<i4")))

    # else the planner chains a decoder with a second run of the encoder
    return F.arrow_udf(ids, "array<int>").asNondeterministic()(text.cast("string"))


def decoded(ids: Column, path: str) -> Column:
    """Text of a column of ids (array<int>)."""

    def texts(rows: pa.Array) -> pa.Array:
        decode = _pieces(path).decode
        return pa.array([None if r is None else decode(r) for r in rows.to_pylist()], pa.string())

    return F.arrow_udf(texts, "string")(ids.cast("array<int>"))


def encode(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The rows with their ids in ``ids_col``, which replaces a column of that name."""
    small_batches(docs.sparkSession)
    return docs.withColumn(ids_col, encoded(F.col(text_col), path))


def decode(rows: DataFrame, path: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows with the text of their ids in ``text_col``, which replaces a column of that name."""
    small_batches(rows.sparkSession)
    return rows.withColumn(text_col, decoded(F.col(ids_col), path))
