"""Operator 1, token-id output: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A segment is some whole documents' ids in a row. Its header lists the ids that occur, each with a class and a share of
that class, under a checksum of its own. A segment is cut into blocks; each block starts from an empty model and an own
coder state and carries the crc32 of its ids, so any block can be decoded, and found damaged, alone. Within a block hashed
contexts of one and of two ids before predict one id each, with a confidence; for each pair of confidences an adaptive
pair of weights mixes order 2, order 1 and order 0 into one distribution. Order 0 is how often each class of ids came in
the block of late, times the id's share of its class. The distribution drives a carry-less
range coder with 64-bit state and 32-bit output words. All blocks of a segment go through the coder in step, one vector
element a block. A segment of more distinct ids than one header takes is coded in two halves.

Rows. Null or empty texts have the end id alone. Rows with a null doc_id come first. Repeated rows are kept, each with a
place of its own. Columns other than doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import BATCH_BYTES, binary_rows, crc32, prepare, staged, table, text_bytes, tokenizer_path, word_cache

MAGIC = b"CMR2"
#: Ids of a segment (a segment ends with the document that reaches it), of a block, and blocks that a segment aims at.
SEGMENT, BLOCK, LANES = 1 << 22, 2048, 2048
ORDER2, ORDER1 = 11, 10
#: Bits of the whole distribution, of the weights, of the class shares; classes, and the least share of one; the weights'
#: speed; ids after which the class shares move halfway to what these were.
TOTAL, WEIGHT, SHARE, CLASSES, LEAST_SHARE, SPEED, ROUND = 28, 24, 12, 8, 32, 5, 16
#: The most that order 2 and 1 have together, and the least that each has.
MOST_WEIGHT, LEAST_WEIGHT = (15 << WEIGHT - 4) - 64, 32
MOST_SYMBOLS = 1 << 16
_32, _28 = np.uint64(32), np.uint64(TOTAL)
_LOW32 = np.uint64(0xFFFFFFFF)


class BadBlock(ValueError):
    """A block's ids don't have its checksum, or a segment or its header is damaged or cut short."""


def scaled(counts: np.ndarray, total: int, least: int = 1) -> np.ndarray:
    """Counts scaled to the sum `total`, each `least` at least."""
    n = len(counts)
    out = least + counts * (total - least * n) // max(1, int(counts.sum()))
    out[counts.argmax()] += total - int(out.sum())
    return out.astype(np.int64)


class Alphabet:
    """The ids that occur in a segment, by number; their classes, and their shares of them."""

    def __init__(self, symbols: np.ndarray, classes: np.ndarray, shares: np.ndarray, first: np.ndarray, bits: int):
        self.symbols, self.classes, self.shares, self.first, self.bits = symbols, classes.astype(np.int32), shares.astype(np.int32), first, bits
        self.small = self.classes.astype(np.int8)
        #: The type of an id's number with a confidence: the smaller, the more of a model's table a processor's cache holds.
        self.kind = np.int16 if len(symbols) <= 1 << 13 else np.int32
        order = np.argsort(self.classes, kind="stable")
        ends = np.cumsum(shares[order])
        self.place = np.empty(len(shares), np.int32)
        self.place[order] = (ends - shares[order]) % (1 << bits)
        self.owner = np.zeros(CLASSES << bits, self.kind)
        for c in range(CLASSES):
            own = order[self.classes[order] == c]
            if len(own):
                self.owner[c << bits : c + 1 << bits] = np.repeat(own, shares[own])

    @staticmethod
    def of(symbols: np.ndarray, counts: np.ndarray) -> Alphabet:
        """Classes of about equal weight, the most frequent ids first."""
        order = np.argsort(-counts, kind="stable")
        before = np.cumsum(counts[order]) - counts[order]
        classes = np.empty(len(counts), np.int64)
        classes[order] = np.minimum(CLASSES - 1, before * CLASSES // max(1, int(counts.sum())))
        bits = max(12, int(np.bincount(classes).max() - 1).bit_length() + 1)
        shares = np.empty(len(counts), np.int64)
        for c in range(CLASSES):
            if len(own := np.flatnonzero(classes == c)):
                shares[own] = scaled(counts[own], 1 << bits)
        return Alphabet(symbols, classes, shares, scaled(np.bincount(classes, counts, CLASSES).astype(np.int64), 1 << SHARE, LEAST_SHARE), bits)

    def header(self) -> bytes:
        return b"".join((np.diff(self.symbols, prepend=0).astype("<u4").tobytes(), self.shares.astype("<u4").tobytes(), self.classes.astype("u1").tobytes(), self.first.astype("<u4").tobytes()))

    @staticmethod
    def read(data: bytes, m: int, bits: int) -> tuple[Alphabet, bytes]:
        """From a header, and what follows."""
        ints = np.frombuffer(data, "<u4", 2 * m)
        classes, first = np.frombuffer(data, "u1", m, 8 * m), np.frombuffer(data, "<u4", CLASSES, 9 * m)
        return Alphabet(np.cumsum(ints[:m], dtype=np.uint32), classes, ints[m:].astype(np.int64), first.astype(np.int64), bits), data[9 * m + 4 * CLASSES :]


class Model:
    """The adaptive part of the prediction for all blocks in step: candidates by context, mixing weights, class shares."""

    def __init__(self, lanes: int, alphabet: Alphabet):
        self.alphabet = alphabet
        self.table = np.full((lanes << ORDER2) + (lanes << ORDER1), -4, alphabet.kind)  # of order 2, then of order 1: id and confidence
        weights = np.zeros((4, 4, 2, 2), np.int32)
        weights[..., 0] = (np.arange(4, dtype=np.int32) * (1 << 21) + (1 << 20))[:, None, None]
        weights[:, :, 0, 1] = np.array([1 << 19, 1 << 20, 3 << 20, 1 << 22])
        weights[:, :, 1, 1] = 1 << 9
        self.weights = np.tile(weights.reshape(-1, 2).view(np.int64).ravel(), lanes)
        lane = np.arange(lanes, dtype=np.int32)
        self.base = np.stack([lane << ORDER2, (lanes << ORDER2) + (lane << ORDER1)])
        self.lane, self.state = lane, (lane << 5).astype(np.intp)
        start = np.cumsum(alphabet.first) - alphabet.first
        self.starts = np.tile(np.append(start, 1 << SHARE).astype(np.int32)[:, None], (1, lanes))
        hit = np.full((3, 2), LEAST_WEIGHT, np.int32)
        hit[1, 0] = hit[2, 1] = MOST_WEIGHT
        self.goal = hit.view(np.int64).ravel()

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The places in the table, of order 2 and of order 1, after the ids a and b; of one step or of several."""
        b = b.astype(np.int32)
        at = b[..., None, :] * _MULTIPLIERS
        at[..., 0, :] += a * np.int32(-1028477379)
        at >>= _SHIFTS
        at &= _MASKS
        at += self.base
        return at.astype(np.intp)

    def predict(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates of order 2 and 1, and how much of 2**28 each has; order 0 has the rest, 2**24 at least."""
        self.at = at
        self.entry = e = self.table.take(at)
        self.candidates = c = e >> 2
        self.sure = s = e & 3
        iw = s[0] << 3
        iw += s[1] << 1
        iw += c[0] == c[1]
        self.iw = iw = iw + self.state
        self.w = w = self.weights.take(iw).view(np.int32)
        return c, w[::2] << TOTAL - WEIGHT, w[1::2] << TOTAL - WEIGHT

    def class_interval(self, unit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of the classes at these places of `starts` in order 0's part, and the width of a share in them."""
        low = self.starts.take(at)
        inner = self.starts.take(at + len(self.lane))
        inner -= low
        inner *= unit
        inner >>= self.alphabet.bits
        low *= unit
        return low, inner

    def order0(self, rest: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the ids x where neither candidate hits; of several steps between two turns."""
        at = self.alphabet.classes.take(x).astype(np.intp)
        at *= len(self.lane)
        at += self.lane
        low, inner = self.class_interval(((1 << TOTAL) - rest) >> SHARE, at)
        low += rest
        start = self.alphabet.place.take(x)
        start *= inner
        start += low
        inner *= self.alphabet.shares.take(x)
        return start, inner

    def find0(self, rest: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of order 0 to which the points v belong, with start and width; any id where v is a candidate's."""
        unit = ((1 << TOTAL) - rest) >> SHARE
        v = v - rest
        np.maximum(v, 0, out=v)
        q = (v / unit).astype(np.int32)
        np.minimum(q, (1 << SHARE) - 1, out=q)
        c = (self.starts[1:CLASSES] <= q).view(np.int8).sum(0, dtype=np.int8).astype(np.intp)
        at = c * len(unit)
        at += self.lane
        low, inner = self.class_interval(unit, at)
        v -= low
        place = (v / inner).astype(np.int32)
        np.minimum(place, (1 << self.alphabet.bits) - 1, out=place)
        c <<= self.alphabet.bits
        c += place
        x = self.alphabet.owner.take(c)
        low += rest
        at = x.astype(np.intp)
        start = self.alphabet.place.take(at)
        start *= inner
        start += low
        inner *= self.alphabet.shares.take(at)
        return x, start, inner

    def update(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        w = self.w
        goal = self.goal.take(hit2 + (hit1.view(np.int8) << 1)).view(np.int32)
        goal -= w
        goal >>= SPEED
        goal += w
        self.weights[self.iw] = goal.view(np.int64)
        right = self.candidates == ids
        wrong = ~right
        # a candidate gains confidence, up to 3, or loses it; without any it gives way to the id
        new = self.entry + (right & (self.sure != 3))
        new -= wrong.view(np.int8)
        wrong &= self.sure == 0
        change = new ^ (ids << 2)
        change &= -wrong.view(np.int8).astype(new.dtype)
        new ^= change
        self.table[self.at] = new

    def turn(self, ids: np.ndarray) -> None:
        """After ROUND steps with these ids: the class shares move."""
        recent = self.alphabet.small.take(ids)
        unit = ((1 << SHARE) - CLASSES * LEAST_SHARE) // ROUND
        for j in range(1, CLASSES):
            goal = (recent < j).view(np.int8).sum(0, dtype=np.int8) * np.int32(unit)
            goal += j * LEAST_SHARE
            goal -= self.starts[j]
            goal >>= 1
            self.starts[j] += goal


_MULTIPLIERS, _SHIFTS, _MASKS = (np.array(x, np.int32)[:, None] for x in ((-2048144789, -1640531527), (9, 8), ((1 << ORDER2) - 1, (1 << ORDER1) - 1)))


def chosen(start: np.ndarray, width: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, f2: np.ndarray, f1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and width of what is coded: a candidate's share where one hits, else order 0's."""
    two, one = -hit2.view(np.int8).astype(np.int32), -hit1.view(np.int8).astype(np.int32)
    none = ~(two | one)
    start &= none
    start |= f2 & one
    width &= none
    width |= f1 & one
    width |= f2 & two
    return start.astype(np.uint64), width.astype(np.uint64)


def renewed(low: np.ndarray, rng: np.ndarray, due: np.ndarray) -> np.ndarray:
    """Where a range is `due`, being under 2**32: cuts it to what `low` leaves of its upper 32 bits, so that no carry can
    reach these, and drops these from both. Returns by how many bits each was shifted."""
    room = ~low
    room &= _LOW32
    room += np.uint64(1)
    np.minimum(rng, room, out=rng, where=due)
    bits = due.astype(np.uint64)
    bits <<= np.uint64(5)
    low <<= bits
    rng <<= bits
    return bits


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids in order, the number of each id among them, and their counts."""
    top = int(ids.max()) + 1 if len(ids) else 0
    if top > max(1 << 20, 4 * len(ids)):
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids, minlength=top)
    symbols = np.flatnonzero(counts)
    number = np.zeros(top, np.int32)
    number[symbols] = np.arange(len(symbols))
    return symbols.astype("<u4"), number.take(ids), counts[symbols]


_HALVES, _CODED = "<BQQ", "<BQIIIII"


def encode(ids: np.ndarray, block: int = BLOCK, lanes: int = LANES, most: int = MOST_SYMBOLS) -> bytes:
    """A segment's file form. Ids are unsigned 32-bit integers. Every block has a checksum and can be read alone."""
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    symbols, at, counts = counted(ids)
    if len(symbols) > most:
        halves = [encode(x, block, lanes, most) for x in (ids[: n // 2], ids[n // 2 :])]
        fields = struct.pack(_HALVES, 2, n, len(halves[0]))
        return MAGIC + fields + struct.pack("<I", crc32(fields)) + b"".join(halves)
    size = min(block, max(256, -(-n // lanes)))
    k = -(-n // size)
    sums = np.array([crc32(ids[i * size : (i + 1) * size].tobytes()) for i in range(k)], "<u4")
    alphabet = Alphabet.of(symbols, counts.astype(np.int64)) if n else None
    who, words = _encode_blocks(at, alphabet, size, k) if n else (np.zeros(0, np.int32), np.zeros(0, "<u4"))
    payload = words[np.argsort(who.astype(np.int16) if k < 1 << 15 else who, kind="stable")].tobytes()
    lengths = np.bincount(who, minlength=k).astype("<u4")
    head = zlib.compress((alphabet.header() if n else b"") + lengths.tobytes() + sums.tobytes(), 6)
    fields = struct.pack(_CODED, 1, n, len(symbols), size, k, alphabet.bits if n else 0, len(head))
    return MAGIC + fields + struct.pack("<I", crc32(fields + head)) + head + payload


def _encode_blocks(at: np.ndarray, alphabet: Alphabet, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that come out, and the block of each."""
    grid = np.zeros(k * size, alphabet.kind)
    grid[: len(at)] = at
    grid = np.concatenate([np.zeros((2, k), alphabet.kind), grid.reshape(k, size).T])  # two steps of number 0 before the first
    low, rng = np.zeros(k, np.uint64), np.full(k, 0xFFFFFFFFFFFFFFFF, np.uint64)
    model, who, words = Model(k, alphabet), [], []
    for first in range(2, size + 2, ROUND):
        # the model learns from some steps, then these go to the coder
        x = grid[first : first + ROUND]
        n = len(x)
        places = model.places(grid[first - 2 : first - 2 + n], grid[first - 1 : first - 1 + n])
        f2, f1, hit2, hit1 = np.empty((n, k), np.int32), np.empty((n, k), np.int32), np.empty((n, k), bool), np.empty((n, k), bool)
        for i in range(n):
            c, f2[i], f1[i] = model.predict(places[i])
            np.equal(c[0], x[i], out=hit2[i])
            np.greater(c[1] == x[i], hit2[i], out=hit1[i])
            model.update(x[i], hit2[i], hit1[i])
        start, width = chosen(*model.order0(f2 + f1, x), hit2, hit1, f2, f1)
        if n == ROUND:
            model.turn(x)
        high, due = np.empty((n, k), "<u4"), np.empty((n, k), bool)
        for i in range(n):
            r = rng >> _28
            start[i] *= r
            low += start[i]
            rng = width[i]
            rng *= r
            np.less_equal(rng, _LOW32, out=due[i])
            high[i] = low >> _32
            renewed(low, rng, due[i])
        who.append(np.nonzero(due)[1].astype(np.int32))
        words.append(high[due])
    for _ in range(2):
        who.append(np.arange(k, dtype=np.int32))
        words.append((low >> _32).astype("<u4"))
        low = low << _32
    return np.concatenate(who), np.concatenate(words)


def _opened(data: bytes) -> tuple[tuple, bytes, bytes]:
    """The fields of a segment, its header (none of two halves), and what follows."""
    form = {1: _CODED, 2: _HALVES}.get(data[4]) if data[:4] == MAGIC else None
    if form is None:
        raise BadBlock("not a segment")
    at = 4 + struct.calcsize(form)
    fields = struct.unpack_from(form, data, 4)
    end = at + 4 + (fields[-1] if data[4] == 1 else 0)
    if crc32(data[4:at] + data[at + 4 : end]) != struct.unpack_from("<I", data, at)[0]:
        raise BadBlock("the header")
    return fields, data[at + 4 : end], data[end:]


def blocks(data: bytes) -> int:
    """How many blocks a segment has."""
    fields, _, rest = _opened(data)
    return fields[4] if fields[0] == 1 else blocks(rest[: fields[2]]) + blocks(rest[fields[2] :])


def decode(data: bytes, only: int | None = None) -> np.ndarray:
    """The ids of a segment, or of its block number `only`. Raises BadBlock where a checksum doesn't hold."""
    try:
        return _decode(data, only)
    except (struct.error, zlib.error, IndexError) as e:
        raise BadBlock(f"a segment is cut short: {e}") from e


def _decode(data: bytes, only: int | None) -> np.ndarray:
    fields, head, rest = _opened(data)
    if fields[0] == 2:
        one, two = rest[: fields[2]], rest[fields[2] :]
        if only is None:
            return np.concatenate([_decode(one, None), _decode(two, None)])
        return _decode(one, only) if only < blocks(one) else _decode(two, only - blocks(one))
    _, n, m, size, k, bits, _ = fields
    if not n:
        return np.zeros(0, "<u4")
    alphabet, of_blocks = Alphabet.read(zlib.decompress(head), m, bits)
    lengths, sums = np.frombuffer(of_blocks, "<u4", k).astype(np.int64), np.frombuffer(of_blocks, "<u4", k, 4 * k)
    if len(rest) != 4 * lengths.sum():
        raise BadBlock("a segment is cut short")
    payload = np.frombuffer(rest, "<u4")
    firsts = np.cumsum(lengths) - lengths
    which = np.arange(k) if only is None else np.array([only])
    grid = _decode_blocks(np.append(payload, np.zeros(2, "<u4")), firsts[which], alphabet, size, len(which))
    out = alphabet.symbols[grid.T.ravel()]
    out = out[:n] if only is None else out[: min(size, n - only * size)]
    for i, b in enumerate(which):
        if crc32(out[i * size : (i + 1) * size].tobytes()) != sums[b]:
            raise BadBlock(f"block {b}")
    return out.astype("<u4")


def _decode_blocks(payload: np.ndarray, place: np.ndarray, alphabet: Alphabet, size: int, k: int) -> np.ndarray:
    end, word = len(payload) - 1, payload.astype(np.uint64)
    code = (word[place] << _32) | word[place + 1]
    place = place + 2
    low, rng = np.zeros(k, np.uint64), np.full(k, 0xFFFFFFFFFFFFFFFF, np.uint64)
    model, grid = Model(k, alphabet), np.empty((size, k), alphabet.kind)
    most = np.uint64((1 << TOTAL) - 1)
    a = b = np.zeros(k, alphabet.kind)
    for step in range(size):
        c, f2, f1 = model.predict(model.places(a, b))
        r = rng >> _28
        v = code - low
        v //= r
        np.minimum(v, most, out=v)
        v = v.astype(np.int32)
        rest = f2 + f1
        hit2 = v < f2
        hit1 = (v < rest) & ~hit2
        x, start, width = model.find0(rest, v)
        np.copyto(x, c[1], where=hit1)
        np.copyto(x, c[0], where=hit2)
        start, width = chosen(start, width, hit2, hit1, f2, f1)
        model.update(x, hit2, hit1)
        grid[step] = x
        a, b = b, x
        if step % ROUND == ROUND - 1:
            model.turn(grid[step + 1 - ROUND : step + 1])
        start *= r
        low += start
        width *= r
        rng = width
        due = rng <= _LOW32
        code <<= renewed(low, rng, due)
        code |= word.take(np.minimum(place, end)) * due
        place += due
    return grid


FILE_SCHEMA = "shard int, segment int, before long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def write_segments(docs: DataFrame, path: str, end_id: int, segment: int = SEGMENT) -> DataFrame:
    """The documents in ascending doc_id order as a table of segments, one row each. A shard is a range of doc_id; before:
    the ids before a segment in its shard."""
    spark = prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number, before = TaskContext.get().partitionId(), 0, 0
        cache, end = word_cache(path), np.array([end_id], "<u4")
        own: list[np.ndarray] = []
        names: list[int | None] = []
        held = 0

        def row() -> pa.RecordBatch:
            lengths = [len(a) + 1 for a in own[::2]]
            values = [[shard], [number], [before], [held], [names], [lengths], [encode(np.concatenate(own))]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["shard", "segment", "before", "n_ids", "doc_ids", "lengths", "payload"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), cache.encode_all(binary_rows(batch, "body"), BATCH_BYTES), strict=True):
                own += [ids, end]
                names.append(doc_id)
                held += len(ids) + 1
                if held >= segment:
                    yield row()
                    before += held
                    own, names, held, number = [], [], 0, number + 1
        if own:
            yield row()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", text_bytes().alias("body"))
    # rows that share a doc_id, or have none, are spread as well; their order among themselves is free
    dealt = rows.repartitionByRange(parts, "doc_id", F.rand(7)).sortWithinPartitions("doc_id", "body")
    return staged(dealt.mapInArrow(run, FILE_SCHEMA), "token-segments")


def read_segments(segments: DataFrame) -> DataFrame:
    """Of each document: doc_id, start (ids before it), n_tokens, ids_crc32, from the decoded segments."""
    # a row for each shard, of which there are as many as shuffle partitions
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    starts = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    rows = segments.join(F.broadcast(starts), "shard").select((F.col("first") + F.col("before")).alias("start"), "doc_ids", "lengths", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, names, lengths, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = decode(payload).tobytes()
                n = np.array(lengths, np.int64)
                last = np.cumsum(n)
                first = last - n
                sums = [crc32(ids[4 * a : 4 * b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(first + start), pa.array(n), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_segments(write_segments(docs, tokenizer_path("word_bpe_49k.json"), end_id=1))
