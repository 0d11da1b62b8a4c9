"""Vector bin packing of tokenised examples into training sequences.

Every example (or piece of one) is a vector of demands: tokens, segments (one), loss-bearing tokens. A bin is a
sequence with a limit for each. An open bin takes, among the pieces that fit whole, the one with the largest dot
product of demands and what the bin has left, both as shares of the limits. When none fits and examples may be cut,
a piece is cut to fill the bin exactly. Each task packs its own rows with a bounded pool of waiting pieces, so nothing
is shuffled and memory does not grow with the input; sequence ids carry the partition, so they are unique.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from talus.llm.bpe import REMEMBERED, codec, default_vocabulary
from talus.llm.common import map_batches, table

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. ``pool``: pieces that wait in a task, at most."""

    tokens: int = 1024
    segments: int = 1024
    loss_tokens: int = 1024
    pool: int = 2048


@dataclass
class Packer:
    """Packs one task's pieces. ``add`` and ``finish`` yield (piece, sequence, offset).

    A piece is (example, start, length, loss start): ``loss`` counts of an example lie at its end, from token
    ``loss_from`` on.
    """

    limits: Limits
    cut: bool = True
    sequence: int = 0
    waiting: list = field(default_factory=list)

    def loss(self, piece: tuple) -> int:
        _, start, length, loss_from = piece
        return max(0, start + length - max(start, loss_from))

    def add(self, example, n: int, loss_from: int = 0) -> Iterator[tuple]:
        """Full sequences are cut off at once; the rest waits for company."""
        top = self.limits
        start = 0
        if self.cut:
            whole = min(top.tokens, top.loss_tokens)
            while n - start >= whole:
                yield (example, start, whole, loss_from), self.sequence, 0
                self.sequence += 1
                start += whole
        elif n > top.tokens or n - min(n, loss_from) > top.loss_tokens:
            raise ValueError(f"an example of {n} tokens does not fit and may not be cut")
        if n > start:
            self.waiting.append((example, start, n - start, loss_from))
            if len(self.waiting) >= top.pool:
                yield from self.pack(len(self.waiting) // 2)

    def finish(self) -> Iterator[tuple]:
        yield from self.pack(0)

    def pack(self, keep: int) -> Iterator[tuple]:
        """Fill sequences until at most ``keep`` pieces wait."""
        top = self.limits
        limit = np.array([top.tokens, top.segments, top.loss_tokens], float)
        pieces = self.waiting
        need = np.array([[p[2], 1, self.loss(p)] for p in pieces], float).reshape(-1, 3)
        there = np.ones(len(pieces), bool)
        count = len(pieces)
        while count > keep:
            left, offset, placed = limit.copy(), 0, []
            while count and left[0] > 0 and left[1] > 0:
                fits = there & (need <= left).all(axis=1)
                if fits.any():
                    value = (need / limit) @ (left / limit)
                    i = int(np.where(fits, value, -1).argmax())
                    piece = pieces[i]
                    there[i] = False
                    count -= 1
                    left -= need[i]
                elif self.cut:
                    i = int(np.where(there, need[:, 0], -1).argmax())
                    example, start, length, loss_from = pieces[i]
                    room = int(min(left[0], length - 1))
                    if start + room > loss_from:  # as far as loss-bearing tokens allow
                        room = int(min(room, max(loss_from - start, 0) + left[2]))
                    if room <= 0:
                        break
                    piece = (example, start, room, loss_from)
                    pieces[i] = (example, start + room, length - room, loss_from)
                    left -= [room, 1, self.loss(piece)]
                    need[i] = [length - room, 1, self.loss(pieces[i])]
                else:
                    break
                placed.append((piece, offset))
                offset += piece[2]
            yield from self.close(placed, offset)
        self.waiting = [p for p, t in zip(pieces, there, strict=True) if t]

    def close(self, placed: list[tuple], used: int) -> Iterator[tuple]:
        """A sequence that came out short is dealt to sequences of powers of two, which need no padding."""
        if not self.cut or used >= self.limits.tokens or used & (used - 1) == 0:
            for piece, offset in placed:
                yield piece, self.sequence, offset
            self.sequence += 1
            return
        room = offset = 0
        for (example, start, length, loss_from), _ in placed:
            while length:
                if not room:
                    room, offset = 1 << (used.bit_length() - 1), 0
                    used -= room
                n = min(room, length)
                yield (example, start, n, loss_from), self.sequence, offset
                start, length, offset, room = start + n, length - n, offset + n, room - n
                if not room:
                    self.sequence += 1


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    limits: Limits = Limits(),  # noqa: B008
    end_id: int = 0,
    ranks: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    remembered: int = REMEMBERED,
) -> DataFrame:
    """One row for each piece of each document: where it starts in the document, and its sequence and offset there.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Repeated rows are packed as
    documents of their own. Tokens count as loss-bearing throughout. Very long texts, runs of white space among them, are
    cut to sequences like any other. ``remembered``: words that a worker keeps, which
    changes its memory and time only. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        c, end = codec(vocabulary, ranks, remembered), np.array([end_id], "<u4").tobytes()
        packer = Packer(limits, sequence=TaskContext.get().partitionId() << 40)

        def rows(placed: Iterator[tuple]) -> dict:
            out = [
                (doc, start, n, zlib.crc32(ids[4 * (start - base) : 4 * (start - base + n)]), total, seq, offset)
                for ((doc, ids, base, total), start, n, _), seq, offset in placed
            ]
            return dict(zip((x.split()[0] for x in PIECES.split(", ")), zip(*out, strict=True) if out else [()] * 7, strict=True))

        for b in batches:
            placed = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = c.encode(text.as_py()) + end
                placed += packer.add((doc, ids, 0, len(ids) // 4), len(ids) // 4)
                if packer.waiting and packer.waiting[-1][1] and packer.waiting[-1][0][1] is ids:
                    # Only the rest of a long document waits.
                    example, start, n, loss_from = packer.waiting[-1]
                    packer.waiting[-1] = ((doc, ids[4 * start :], start, example[3]), start, n, loss_from)
            yield rows(iter(placed))
        yield rows(packer.finish())

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, PIECES)


def pack_examples(
    examples: DataFrame, limits: Limits, cut: bool = False, id_col: str = "example_id", tokens_col: str = "n_tokens", loss_from_col: str = "loss_from"
) -> DataFrame:
    """Instruction data whose token counts are known: (example_id, start, length, sequence_id, offset).

    Of an example's ``n_tokens`` those from ``loss_from`` on bear loss (null: all of them). Null or non-positive counts
    take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        packer = Packer(limits, cut, sequence=TaskContext.get().partitionId() << 40)

        def rows(placed) -> dict:
            out = [(ex, start, n, seq, offset) for (ex, start, n, _), seq, offset in placed]
            return dict(zip(("example_id", "start", "length", "sequence_id", "offset"), zip(*out, strict=True) if out else [()] * 5, strict=True))

        for b in batches:
            placed = []
            for ex, n, loss_from in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if n and n > 0:
                    placed += packer.add(ex, n, loss_from or 0)
            yield rows(iter(placed))
        yield rows(packer.finish())

    e = examples
    return map_batches(
        e.select(e[id_col].cast("long").alias("example_id"), e[tokens_col].cast("long").alias("n"), e[loss_from_col].cast("long").alias("loss_from")),
        run,
        "example_id long, start long, length long, sequence_id long, offset long",
    )


def ranks_beside() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_vocabulary(), ranks=ranks_beside(), remembered=2 * REMEMBERED)
