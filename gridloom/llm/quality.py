"""Operator 2, quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

Every word has a sparse ternary index vector of its own, by its hash. Its word vector is the sum of the index vectors of
all words that stand within two places of it anywhere in the corpus, in whole numbers, so the order of partial sums doesn't
matter. The sums are kept in a sketch of fixed size: a plain word adds to one unit in each of two tables, by two parts of
its hash, and is read from the one of these that fewer words have added to, so a common word has a unit nearly to itself
and a rare one the emptier of two. Any other token (a number, a code, a word with odd signs) has the unit of its shape: its
runs of letters, digits and signs. A document is its word vectors' mean and spread and a few ratios of repetition. A network
with one hidden layer is trained on a bounded sample of labelled documents, and its logits are divided by a temperature
fitted on rows kept apart, so that scores are calibrated probabilities.

Rows. A null or empty text has vectors of 0 and gets the score that goes with them. Rows with a null label, and labels of
rows that are held out, teach nothing; without both labels nothing is learned and every score is the share of label 1, or
0.5. Repeated rows are scored each; a null doc_id is scored and not held out; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import TwoGenerations, binary_rows, light, mix64, prepare, shingle_hashes, table, text_bytes, word_values

#: Units of each of the two tables of plain words, and of shapes; dimensions, entries of an index vector, reach of contexts.
WORDS, SHAPES, DIM, ENTRIES, REACH = 1 << 14, 512, 32, 4, 2
UNITS = 2 * WORDS + SHAPES
#: Labelled rows that the network is trained on, at most (expected number, drawn by a hash of the id).
SAMPLE = 20_000
HIDDEN, EPOCHS, SEED = 32, 60, 7
CUT = 0.7


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as A, a and 0, runs of a sign as that sign."""
    out = ""
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if out[-1:] != k:
            out += k
    return out


class Units(TwoGenerations):
    """A word's hash, above one bit that says whether it is plain, by its bytes. Words in lower case or with a capital first
    and with one stop at most are plain, and case and stop don't matter for them."""

    def compute(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        bare = text.rstrip(".,;:?")
        s = shape(bare)
        plain = s in ("a", "Aa", "A") and (s != "A" or len(bare) == 1) and len(text) - len(bare) < 2
        h = xxhash.xxh3_64_intdigest(bare.lower().encode() if plain else b"\0" + shape(text).encode())
        return h >> 1 << 1 | plain


def units_of(hashes: np.ndarray) -> np.ndarray:
    """[2, n]: the units of words, the same twice for a shape."""
    one, two = (hashes >> np.uint64(8)) % np.uint64(WORDS), (hashes >> np.uint64(36)) % np.uint64(WORDS) + np.uint64(WORDS)
    other = np.uint64(2 * WORDS) + (hashes >> np.uint64(8)) % np.uint64(SHAPES)
    plain = (hashes & np.uint64(1)).astype(bool)
    return np.stack([np.where(plain, one, other), np.where(plain, two, other)]).astype(np.int64)


def index_entries(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[n, ENTRIES]: the dimensions and signs of the words' index vectors."""
    h = mix64(hashes[:, None] + np.arange(1, ENTRIES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(40) & np.uint64(1), 1, -1)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """[n, DIM] index vectors."""
    out = np.zeros((len(hashes), DIM), np.int8)
    at, sign = index_entries(hashes)
    row = np.arange(len(hashes))
    for j in range(ENTRIES):
        out[row, at[:, j]] += sign[:, j].astype(np.int8)
    return out


def add_contexts(total: np.ndarray, load: np.ndarray, texts: list[np.ndarray]) -> None:
    """Adds to total[unit, dimension] the index vectors of all neighbours, and to load[unit] the words."""
    if not sum(map(len, texts)):
        return
    h = np.concatenate(texts)
    # places with a gap before, between and after the texts, so that nothing is beside what isn't its neighbour
    place = np.arange(len(h)) + np.repeat(np.arange(1, len(texts) + 1) * REACH, [len(t) for t in texts])
    order = np.argsort(h, kind="stable")
    h, place = h[order], place[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    words, counts = h[first], np.diff(np.append(first, len(h)))
    index = np.zeros((int(place.max()) + 1 + REACH, DIM), np.int8)
    index[place] = index_vectors(words).take(np.repeat(np.arange(len(words)), counts), axis=0)
    around = np.zeros_like(index)
    for d in range(1, REACH + 1):
        around[:-d] += index[d:]
        around[d:] += index[:-d]
    sums = np.add.reduceat(around.take(place, axis=0), first, axis=0, dtype=np.int64)
    units = units_of(words)
    for side in range(2):
        own = np.arange(len(words)) if not side else np.flatnonzero(units[0] != units[1])  # a shape has one unit
        own = own[np.argsort(units[side][own], kind="stable")]
        if len(own):
            unit = units[side][own]
            start = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            total[unit[start]] += np.add.reduceat(sums[own], start, axis=0)
            load[unit[start]] += np.add.reduceat(counts[own], start)


CHUNKS, SALTS = 8, 16
PARTIAL = "chunk int, salt int, data binary"


@dataclass
class Sketch:
    """The sums and loads of all units; word vectors read from them."""

    sums: np.ndarray
    load: np.ndarray

    def __post_init__(self):
        f = self.sums.astype(np.float64)
        self.vectors = (f / np.maximum(1.0, np.linalg.norm(f, axis=1, keepdims=True))).astype(np.float32)

    def chosen(self, hashes: np.ndarray) -> np.ndarray:
        """The unit that each word is read from."""
        one, two = units_of(hashes)
        return np.where(self.load[two] < self.load[one], two, one)


def context_sums(docs: DataFrame) -> Sketch:
    """The sketch of all documents. docs: a binary column body."""
    width = UNITS * (DIM + 1) // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        units, total, load = Units(), np.zeros((UNITS, DIM), np.int64), np.zeros(UNITS, np.int64)
        for batch in batches:
            some, held = [], 0
            for words in word_values(binary_rows(batch, "body"), units.__getitem__, np.uint64):
                for at in range(0, max(1, len(words)), 1 << 18):  # a longer text bit by bit, with what precedes as context
                    some.append(words[at : at + (1 << 18)])
                    held += len(some[-1])
                    if held >= 1 << 18:
                        add_contexts(total, load, some)
                        some, held = [], 0
            add_contexts(total, load, some)
        parts = np.concatenate([total.ravel(), load]).reshape(CHUNKS, width)
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([salt] * CHUNKS, pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in parts])], ["chunk", "salt", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(data), "<i8")
                total[chunk] = total[chunk] + x if chunk in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([0] * len(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()])], ["chunk", "salt", "data"])

    partial = docs.select("body").mapInArrow(light("units", count), PARTIAL)
    rows = partial.repartition(CHUNKS * SALTS, "chunk", "salt").mapInArrow(light("units", add), PARTIAL).repartition(CHUNKS, "chunk").mapInArrow(light("units", add), PARTIAL).collect()  # the sketch itself, of fixed size
    out = np.zeros((CHUNKS, width), np.int64)
    for r in rows:
        out[r.chunk] += np.frombuffer(zlib.decompress(r.data), "<i8")
    return Sketch(out.ravel()[: UNITS * DIM].reshape(UNITS, DIM), out.ravel()[UNITS * DIM :])


FEATURES = 4 * DIM + 5


def pooled(text: bytes, hashes: np.ndarray, sketch: Sketch) -> np.ndarray:
    """A document's mean and spread of word vectors beside index vectors, and ratios of repetition."""
    out = np.zeros(FEATURES)
    n = len(hashes)
    if n:
        words, counts = np.unique(hashes, return_counts=True)
        unit, share = sketch.chosen(words), counts / n
        vectors = np.concatenate([sketch.vectors[unit], index_vectors(words) / 2], 1)
        mean = share @ vectors
        out[: 2 * DIM] = mean
        out[2 * DIM : 4 * DIM] = np.sqrt(np.maximum(0.0, share @ vectors**2 - mean**2))
        lines = text.split(b"\n")
        shingles = shingle_hashes(hashes, 6)
        out[4 * DIM :] = np.log1p(n), len(set(lines)) / len(lines), len(np.unique(shingles)) / len(shingles), share[unit >= 2 * WORDS].sum(), len(text) / n / 10
    return out


def pooled_all(texts: list[bytes], sketch: Sketch, units: Units) -> np.ndarray:
    x = [pooled(t, h, sketch) for t, h in zip(texts, word_values(texts, units.__getitem__, np.uint64), strict=True)]
    return np.array(x).reshape(len(texts), FEATURES)


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    learned: bool = True

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


DECAY = 1e-4


def log_loss(z: np.ndarray, y: np.ndarray, p: list[np.ndarray], t: float = 1.0) -> float:
    """The logistic loss of the network with parameters p = [w1, b1, w2, b2] at temperature t."""
    s = (np.tanh(z @ p[0] + p[1]) @ p[2] + p[3]) / t
    return float(np.mean(np.logaddexp(0, s) - y * s))


def gradients(z: np.ndarray, y: np.ndarray, p: list[np.ndarray]) -> list[np.ndarray]:
    """Of the loss and half of DECAY times the weights' squares."""
    h = np.tanh(z @ p[0] + p[1])
    d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y) / len(y)
    dh = np.outer(d, p[2]) * (1 - h * h)
    return [z.T @ dh + DECAY * p[0], dh.sum(0), h.T @ d + DECAY * p[2], np.array([d.sum()])]


def train(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Adam on the logistic loss over four fifths of the rows, temperature by the loss on the rest. Rows' order matters."""
    width = x.shape[1]
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 10 or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), learned=False)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    kept, fit = order[: len(y) // 5], order[len(y) // 5 :]
    net = Network(x[fit].mean(0), x[fit].std(0) + 1e-3, rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z = (x - net.centre) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    best, step = (np.inf, [p.copy() for p in params]), 0

    def loss(rows: np.ndarray, p: list[np.ndarray], t: float = 1.0) -> float:
        return log_loss(z[rows], y[rows], p, t)

    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for at in range(0, len(fit), 256):
            rows = fit[at : at + 256]
            grads = gradients(z[rows], y[rows], params)
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - 2e-3 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        now = loss(kept, params)
        if now < best[0]:
            best = now, [p.copy() for p in params]
    net.w1, net.b1, net.w2 = best[1][:3]
    net.b2 = float(best[1][3][0])
    net.temperature = min((0.25 * 1.1**i for i in range(40)), key=lambda t: loss(kept, best[1], t))
    return net


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def features(rows: DataFrame, sketch: Sketch) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        for batch in batches:
            x = list(pooled_all(binary_rows(batch, "body"), sent.value, units))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    return rows.select("doc_id", F.col("quality").cast("int").alias("quality"), "body").mapInArrow(light("units", run), "doc_id long, quality int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Sketch, Network]:
    """The sketch of word vectors from all documents, and a network from labels of rows that aren't held out."""
    body = docs.select("doc_id", text_bytes().alias("body"))
    sketch = context_sums(body)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder() != 2)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < sample * (1 << 20) // n)
    got = features(body.join(F.broadcast(known), "doc_id"), sketch).collect()  # `sample` rows, so the broadcast is as small
    got.sort(key=lambda r: (r.doc_id, r.x))
    return sketch, train(np.array([r.x for r in got]).reshape(len(got), FEATURES), np.array([r.quality for r in got], np.float64))


def scores(docs: DataFrame, sketch: Sketch, net: Network) -> DataFrame:
    """Adds score, the probability of label 1, to all columns of docs."""
    sent = docs.sparkSession.sparkContext.broadcast((sketch, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        for batch in batches:
            sketch, net = sent.value
            x = pooled_all(binary_rows(batch, "_body"), sketch, units)
            keep = [i for i, name in enumerate(batch.schema.names) if name != "_body"]
            yield batch.select(keep).append_column("score", pa.array(net.probabilities(x), pa.float64()))

    prepare(docs.sparkSession)
    return docs.withColumn("_body", text_bytes()).mapInArrow(light("units", run), docs.select("*", F.lit(0.0).alias("score")).schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sketch, net = fit(docs, labels)
    out = scores(docs.select("doc_id", "text"), sketch, net)
    held = F.coalesce(remainder() == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
