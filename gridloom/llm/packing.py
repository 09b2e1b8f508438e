"""Operator 9, packing: vector bin packing of examples into training sequences by the dot-product heuristic.

A sequence has three limits at once: tokens, segments (pieces in it) and loss-bearing tokens. One sequence is open at a
time; of the examples that fit all three, the one whose demand has the largest dot product with what is left goes in.
Where none fits, the example with most tokens is cut to fill the gap, as far as the limits allow; once no more loss may go
in, the one with most tokens without any at its front. Examples longer than a sequence fill whole sequences from their front first. A sequence that must close early is parted into lengths that are
powers of two, which need no padding.

Which tokens bear loss, in two forms. pack_documents takes a number of last tokens from a column, as of prompt and answer.
Without one, an example counts as a dialogue of turns: of every TURN tokens the first PROMPT are asked and bear none. The
query does the latter, with at most LOSS loss-bearing tokens in SEGMENTS pieces a sequence; all three limits close
sequences on mixed documents (Packer.closed counts them).

Work is by windows within a task's rows, so memory is bounded and nothing is shuffled; what a window leaves over starts
the next one. Rows. Null or empty texts have the end id alone; a null doc_id stays null; repeated rows are packed each;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import binary_rows, crc32, prepare, table, text_bytes, tokenizer_path, word_cache

#: Limits of a sequence: tokens, pieces, loss-bearing tokens.
TOKENS, SEGMENTS, LOSS = 4096, 16, 3056
#: Tokens of a dialogue's turn, and its first ones, that are asked and bear no loss.
TURN, PROMPT = 256, 64
#: Tokens and examples of a window.
WINDOW_TOKENS, WINDOW_ROWS = 1 << 22, 2048


@dataclass
class Example:
    """What is left of an example: tokens from `at` to `end`. Of those from `loss_from` on, all but the first `prompt` of
    every `turn` tokens bear loss."""

    key: object
    at: int
    end: int
    loss_from: int = 0
    turn: int = 1
    prompt: int = 0

    def borne(self, to: int) -> int:
        """Loss-bearing tokens among the first `to`."""
        turns, rest = divmod(max(0, to - self.loss_from), self.turn)
        return turns * (self.turn - self.prompt) + max(0, rest - self.prompt)

    def loss(self, length: int) -> int:
        return self.borne(self.at + length) - self.borne(self.at)

    def longest(self, tokens: int, loss: int) -> int:
        """Tokens from the front that keep within both limits."""
        turns, rest = divmod(self.borne(self.at) + loss, self.turn - self.prompt)
        return min(self.end - self.at, tokens, self.loss_from + turns * self.turn + self.prompt + rest - self.at)


@dataclass
class Packer:
    tokens: int = TOKENS
    segments: int = SEGMENTS
    loss: int = LOSS
    waiting: list[Example] = field(default_factory=list)
    number: int = 0
    #: How many sequences each limit closed; "end" where nothing was left to put in.
    closed: Counter = field(default_factory=Counter)

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("each limit is 1 at least")

    def add(self, x: Example) -> Iterator[tuple[object, int, int, int, int]]:
        """Takes an example in; gives the whole sequences at its front, as pack() does, while they keep all limits."""
        while x.longest(self.tokens, self.loss) == self.tokens:
            self.closed["tokens"] += 1
            yield from self.close([(x.key, x.at, self.tokens)])
            x.at += self.tokens
        if x.at < x.end:
            self.waiting.append(x)

    def close(self, pieces: list[tuple[object, int, int]]) -> Iterator[tuple[object, int, int, int, int]]:
        """(key, start, length, sequence, offset) of a sequence's pieces; of several shorter ones if it isn't full."""
        left = sum(n for _, _, n in pieces)
        room, offset = (left if left == self.tokens else 1 << (left.bit_length() - 1)), 0
        for key, start, n in pieces:
            while n:
                if not room:
                    self.number += 1
                    room, offset = 1 << (left.bit_length() - 1), 0
                m = min(n, room)
                yield key, start, m, self.number, offset
                start, n, room, offset, left = start + m, n - m, room - m, offset + m, left - m
        self.number += 1

    def pack(self, last: bool) -> Iterator[tuple[object, int, int, int, int]]:
        """(key, start, length, sequence, offset) of pieces, while what waits can fill a sequence, or to its end."""
        items = self.waiting
        size = np.array([x.end - x.at for x in items], np.float64)
        a, b, c = size / self.tokens, np.full(len(items), 1 / self.segments), np.array([x.loss(x.end - x.at) for x in items], np.float64) / self.loss
        free = np.array([x.longest(self.tokens, 0) for x in items], np.float64)
        total, slack = int(size.sum()), 1e-9
        alive = np.ones(len(items), bool)
        while total and (last or total >= self.tokens):
            left, pieces, why = [self.tokens, self.segments, self.loss], [], "end"
            while total:
                if not left[0] or not left[1]:
                    why = "segments" if left[0] else "tokens"
                    break
                p, q, r = left[0] / self.tokens, left[1] / self.segments, left[2] / self.loss
                fits = alive & (a <= p + slack) & (c <= r + slack)
                if fits.any():
                    i = int(np.where(fits, a * p + b * q + c * r, -1.0).argmax())
                    n = items[i].end - items[i].at
                else:
                    i = int(np.where(alive, size, -1.0).argmax())
                    if not (n := items[i].longest(left[0], left[2])):
                        i = int(np.where(alive, free, -1.0).argmax())
                        n = items[i].longest(left[0], left[2]) if alive[i] else 0
                    if not n:
                        why = "loss"
                        break
                x = items[i]
                left = [left[0] - n, left[1] - 1, left[2] - x.loss(n)]
                pieces.append((x.key, x.at, n))
                x.at += n
                total -= n
                size[i] = x.end - x.at
                alive[i] = x.at < x.end
                a[i], c[i], free[i] = size[i] / self.tokens, x.loss(x.end - x.at) / self.loss, x.longest(self.tokens, 0)
            self.closed[why if total or left[0] else "tokens"] += 1
            yield from self.close(pieces)
        self.waiting = [x for x, y in zip(items, alive, strict=True) if y]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, end_id: int, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, bearing: str | None = None) -> DataFrame:
    """Every document's ids and end_id in pieces of sequences. One row a piece.

    bearing: a column that says how many of a document's last tokens, end_id among them, bear loss; all do where it is
    null or above their number. Without it documents are dialogues of turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        cache, end = word_cache(path), np.array([end_id], "<u4").tobytes()
        turns = {} if bearing else {"turn": TURN, "prompt": PROMPT}
        packer = Packer(tokens, segments, loss)
        kept: dict[int, tuple[int | None, bytes]] = {}
        out: list[tuple] = []

        def take(pieces) -> None:
            for key, start, n, sequence, offset in pieces:
                doc_id, ids = kept[key]
                out.append((doc_id, start, n, crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, base + sequence, offset))

        def rows() -> pa.RecordBatch:
            names = SCHEMA.replace(" long", "").split(", ")
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * len(names))], names)
            out.clear()
            return batch

        number = held = 0
        for batch in batches:
            for doc_id, ids, some in zip(batch.column(0).to_pylist(), cache.encode_all(binary_rows(batch, "body")), binary_rows(batch, "bearing"), strict=True):
                ids = ids.tobytes() + end
                kept[number] = doc_id, ids
                n = len(ids) // 4
                take(packer.add(Example(number, 0, n, 0 if some is None else n - max(0, min(n, some)), **turns)))
                number, held = number + 1, held + n
                if held >= WINDOW_TOKENS or len(packer.waiting) >= WINDOW_ROWS:
                    take(packer.pack(False))
                    kept = {x.key: kept[x.key] for x in packer.waiting}
                    held = 0
                    yield rows()
        take(packer.pack(True))
        yield rows()

    prepare(docs.sparkSession)
    own = F.lit(None) if bearing is None else F.col(bearing)
    return docs.select("doc_id", text_bytes().alias("body"), own.cast("long").alias("bearing")).mapInArrow(run, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
