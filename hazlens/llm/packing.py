"""Packing of tokenized documents into training sequences of several context sizes.

Hierarchical: a document's whole windows of the longest tier become sequences
of their own, and what is left of it goes to the tier with the least size that
holds it. Each tier is packed into windows of its own size, the longest tier
first: a window begins with the largest piece of its tier, and its gap takes the
pieces of shorter tiers by best fit. What no whole piece fills is filled by
cutting one, so every window ends full. Where nothing is left to fill with, the
windows with the most room are emptied into the others, and what then remains
becomes a few sequences of powers of two, of which the last is padded.
Sequences of all tiers are dealt into step groups, the longest first, each to
the group with the fewest tokens.

All of this happens in the task that tokenized the documents, over groups of
bounded size, so nothing is shuffled and no group grows with the input. A
sequence's number is made of the partition, the group and its place there;
running a lost task again gives the same numbers.

Defined results: null text counts as empty and gives one piece with the closing
id; an empty table gives an empty table; a null doc_id is packed like any other;
repeated rows are packed as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from hazlens.llm import bpe, runs

TIERS = (2048, 1024, 512, 256)
CLOSING_ID = 1
#: Bytes of text tokenized at once; what is made of them takes some thirty times that.
PIECE_BYTES = 4 << 20
#: Documents packed together. Bounds memory, and the share of sequences that stay short.
GROUP_TOKENS = 1 << 22
#: What is left of a group at last, padded in one sequence.
SHORT_TAIL = 64
#: Tokens of one training step, for balancing.
STEP_TOKENS = 8 * 2048

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class _Pool:
    """Pieces (document, start) by their size; the sizes that there are as bits of a number."""

    def __init__(self) -> None:
        self.of: dict[int, list[tuple[int, int]]] = {}
        self.sizes = 0

    def add(self, size: int, doc: int, start: int) -> None:
        self.of.setdefault(size, []).append((doc, start))
        self.sizes |= 1 << size

    def largest(self, most: int) -> int:
        """The largest size up to ``most``, 0 if there is none."""
        return (self.sizes & ((2 << most) - 1)).bit_length() - 1 if self.sizes & ((2 << most) - 1) else 0

    def take(self, size: int) -> tuple[int, int]:
        found = self.of[size].pop()
        if not self.of[size]:
            self.sizes &= ~(1 << size)
        return found


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths.

    Every position of a document is in one piece. Every sequence is as long as one
    of the tiers but the last few, whose lengths are powers of two.
    """
    longest = tiers[0]
    pieces: list[tuple[int, int, int, int, int]] = []
    pool, sequences = _Pool(), 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - longest + 1, longest):
            pieces.append((doc, start, longest, sequences, 0))
            sequences += 1
        if left := n % longest:
            pool.add(left, doc, n - left)
    unfilled: list[tuple[int, list[tuple[int, int, int]]]] = []  # room, and (document, start, length) of a window's pieces

    for tier, shorter in zip(tiers, (*tiers[1:], 0)):
        # of the tier's own pieces no two fit in one window, but for the least tier's
        while size := pool.largest(tier):
            if size <= shorter:
                break
            held, room = [(*pool.take(size), size)], tier - size
            while room and (size := pool.largest(min(room, shorter or tier))):
                held.append((*pool.take(size), size))
                room -= size
            if room and (size := pool.largest(shorter or tier)):  # all that is left is larger than the room: cut one
                doc, start = pool.take(size)
                held.append((doc, start, room))
                pool.add(size - room, doc, start + room)
                room = 0
            if room:
                unfilled.append((room, held))
                continue
            at = 0
            for doc, start, size in held:
                pieces.append((doc, start, size, sequences, at))
                at += size
            sequences += 1
    return _closed(pieces, unfilled, sequences, longest)


def _closed(pieces: list, unfilled: list, sequences: int, longest: int) -> list[tuple[int, int, int, int, int]]:
    """Windows with room are filled from those with the most room; what then remains becomes powers of two."""
    unfilled.sort(key=lambda w: w[0])
    rest: list[tuple[int, int, int]] = []
    low, high = 0, len(unfilled) - 1
    while low <= high:
        room, held = unfilled[low]
        while room and (rest or high > low):
            if not rest:
                rest = unfilled[high][1]
                high -= 1
            doc, start, size = rest.pop()
            part = min(size, room)
            held.append((doc, start, part))
            room -= part
            if part < size:
                rest.append((doc, start + part, size - part))
        if room:  # the last one
            rest = held
            break
        at = 0
        for doc, start, size in held:
            pieces.append((doc, start, size, sequences, at))
            at += size
        sequences += 1
        low += 1
    total = sum(size for _, _, size in rest)
    while total:
        span = min(longest, 1 << (total.bit_length() - 1)) if total > SHORT_TAIL else total
        at = 0
        while at < span:
            doc, start, size = rest.pop()
            part = min(size, span - at)
            pieces.append((doc, start, part, sequences, at))
            at += part
            if part < size:
                rest.append((doc, start + part, size - part))
        total -= span
        sequences += 1
    return pieces


def _packer(path: str, tiers: tuple[int, ...], closing: int, group_tokens: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = bpe.coder(path, bpe.WordCoder), TaskContext.get().partitionId()
        held: list[tuple[object, np.ndarray]] = []
        size = base = 0
        for batch in runs.pieces(batches, limit=PIECE_BYTES):
            values, ends = tokens.encode(batch.column("text"))
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), ends.tolist(), ends[1:].tolist()):
                held.append((doc, np.append(values[a:b], np.uint32(closing))))
                size += b - a + 1
            if size >= group_tokens:
                out, base = _emit(held, tiers, part, base)
                yield out
                held, size = [], 0
        if held:
            yield _emit(held, tiers, part, base)[0]

    return work


def _emit(held: list, tiers: tuple[int, ...], part: int, base: int) -> tuple[pa.RecordBatch, int]:
    packed = pack([len(ids) for _, ids in held], tiers)
    filled: dict[int, int] = {}
    for _, _, n, seq, _ in packed:
        filled[seq] = filled.get(seq, 0) + n
    # equal tokens a step: the longest sequences first, each to the step with the fewest tokens
    steps = [(0, k) for k in range(max(1, -(-sum(filled.values()) // STEP_TOKENS)))]
    step_of = {}
    for seq in sorted(filled, key=lambda s: (-filled[s], s)):
        load, step = heapq.heappop(steps)
        heapq.heappush(steps, (load + filled[seq], step))
        step_of[seq] = (part << 33) + base + step
    number = {seq: (part << 33) + base + k for k, seq in enumerate(sorted(filled))}
    columns = list(
        zip(
            *(
                (held[d][0], s, n, zlib.crc32(held[d][1][s : s + n].astype("<u4").tobytes()), len(held[d][1]), number[q], o, next(t for t in reversed(tiers) if t >= filled[q]), step_of[q])
                for d, s, n, q, o in packed
            )
        )
    )
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names), base + len(filled)


def packed(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, closing_id: int = CLOSING_ID, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece. ``tiers`` falls from the longest window; each is half or less of the one before."""
    return runs.mapped(docs.selectExpr("cast(doc_id as long) doc_id", "text"), _packer(tokenizer_path, tuple(tiers), closing_id, group_tokens), SCHEMA, tokenizer_path)
