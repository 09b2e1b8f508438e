"""Operator 10, benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Runs of two words of the test items are the seeds: a copy with a third of its words changed may hold no longer run. An
alignment of half the score or more holds one, unless words are inserted after nearly each of the item's. How
many documents hold each seed is counted over the whole corpus; an item's rare seeds are those no more common than the
median one of its seeds that occur. No seed is dropped. Seeds join documents to items: where one rare seed of an item or
any two (one, if it has fewer than nine words, or no other seed) lie near each other, the passage around them is aligned with the item word by word
(match 2, other word -1, gap -1), unless its words alone bound the score below the threshold. A document is reported for
an item when the best alignment reaches half of the item's own score, so edited and paraphrased copies count too. Items
go out in blocks whose size is bounded; a larger benchmark makes more passes.

Words are lower-cased and stripped of punctuation at their ends. Rows. Items of one or two words are found where they are
a whole document, for alignment would find them anywhere; items with a null id or without words take no part; null or empty texts match nothing; repeated documents are reported each, equal items each; a null doc_id
stays null; without documents or items there are no rows; other columns are ignored, or kept by annotate().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import TwoGenerations, binary_rows, light, mix64, prepare, table, text_bytes, word_values

SEED = 2
#: Words of an item that is aligned, and of one of which two seeds are asked for.
ITEM_WORDS, LONG_WORDS = 3, 9
LEAST = 0.5
#: Items, and bytes of their texts, of a block.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20


_SIGNS = bytes(c for c in range(128) if not chr(c).isalnum())


def normal(word: bytes) -> bytes:
    """A word in lower case, from its first letter or digit to its last; empty without any."""
    bare = word.strip(_SIGNS)
    if bare.isascii():
        return bare.lower()
    text = bare.decode("utf-8", "replace").lower()
    if text[0].isalnum() and text[-1].isalnum():
        return text.encode()
    keep = [i for i, c in enumerate(text) if c.isalnum()]
    return text[keep[0] : keep[-1] + 1].encode() if keep else b""


class Vocabulary(TwoGenerations):
    """Number of a word among the items' words: 0 for others, -1 for what holds no word."""

    MOST = 1 << 19

    def __init__(self, known: dict[bytes, int]):
        super().__init__()
        self.known = known

    def compute(self, word: bytes) -> int:
        w = normal(word)
        return self.known.get(w, 0) if w else -1


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score, and the passage's word at which that alignment ends."""
    n = len(passage)
    place = np.arange(n + 1)
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    for w in item.tolist():
        t = np.maximum(row - 1, 0)
        t[1:] = np.maximum(t[1:], row[:-1] + np.where(passage == w, 2, -1))
        row = np.maximum.accumulate(t + place) - place
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def bound(passage: np.ndarray, known: np.ndarray, least: float = 0) -> int:
    """No alignment scores more: the best run of the passage's words, 2 for a word of the item, -1 for another. Where
    the passage holds too few of the item's words for `least`, twice their number."""
    own = known[passage]
    if (n := 2 * int(np.count_nonzero(own))) < least:
        return n
    total = np.zeros(len(passage) + 1, np.int64)
    np.cumsum(own * 3 - 1, out=total[1:])
    return int((total - np.minimum.accumulate(total)).max())


class Block:
    """Test items, their words by number, and their seeds."""

    def __init__(self, items: list[tuple[int, str]], seed: int = SEED, least: float = LEAST):
        self.seed, self.least = seed, least
        texts = [(i, [w for w in map(normal, t.encode("utf-8", "replace").split()) if w]) for i, t in items]
        self.known = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
        self.base = len(self.known) + 1
        self.whole: dict[bytes, list[int]] = {}
        for i, ws in sorted(texts):
            if 0 < len(ws) < max(seed, ITEM_WORDS):
                self.whole.setdefault(np.array([self.known[w] for w in ws], np.int64).tobytes(), []).append(i)
        texts = sorted((i, ws) for i, ws in texts if len(ws) >= max(seed, ITEM_WORDS))
        self.ids = [i for i, _ in texts]
        self.words = [np.array([self.known[w] for w in ws], np.int64) for _, ws in texts]
        codes = [self.code(w)[1] for w in self.words]
        self.codes = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        owner = np.concatenate([np.full(len(np.unique(c)), k) for k, c in enumerate(codes)]) if codes else np.zeros(0, np.int64)
        at = np.searchsorted(self.codes, np.concatenate([np.unique(c) for c in codes])) if codes else owner
        order = np.lexsort((owner, at))
        self.seed_of, self.item_of = at[order], owner[order]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.rare = np.ones(len(self.seed_of), bool)
        self.first = np.searchsorted(self.seed_of, np.arange(len(self.codes) + 1))
        self.enough = np.where(self.sizes < LONG_WORDS, 1, np.minimum(2, np.bincount(self.item_of, minlength=len(self.ids))))
        self.marks = np.zeros(0, bool)

    def code(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the runs of `seed` words that are all items' words, and their codes: exact where they fit 63 bits,
        else hashes, which may add a seed that the alignment then refuses."""
        m = len(n) - self.seed + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = n > 0
        ok = known[:m].copy()
        for k in range(1, self.seed):
            ok &= known[k : k + m]
        place = np.flatnonzero(ok)
        out = n[place]
        for k in range(1, self.seed):
            out = out * self.base + n[place + k] if self.base**self.seed < 1 << 63 else mix64((out * self.base + n[place + k]).view(np.uint64)).view(np.int64)
        return place, out

    def mark_rare(self, documents: np.ndarray) -> None:
        """Of each item, marks the seeds no more common than the median one of those that occur. documents: how many hold each seed."""
        common = documents[self.seed_of]
        occurs = np.flatnonzero(common)
        order = occurs[np.lexsort((common[occurs], self.item_of[occurs]))]
        sizes = np.bincount(self.item_of[order], minlength=len(self.ids))
        median, some = np.zeros(len(self.ids), np.int64), sizes > 0
        median[some] = common[order][(np.cumsum(sizes) - sizes + (sizes - 1) // 2)[some]]
        self.rare = common <= median[self.item_of]

    def numbers(self, texts: list[bytes], vocabulary: Vocabulary) -> Iterator[np.ndarray]:
        """Of each text in turn, its words' numbers."""
        return (n[n >= 0] for n in word_values(texts, vocabulary.__getitem__))

    def seeds(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a document at which seeds stand, and the seeds' numbers."""
        place, code = self.code(n)
        if not len(place) or not len(self.codes):
            return place[:0], place[:0]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[at] == code
        return place[hit], at[hit]

    def matches(self, n: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item_id, share of the item's own score, first word, end) of the document's best alignments."""
        if 0 < len(n) < ITEM_WORDS and (same := self.whole.get(n.tobytes())):
            return [(i, 1.0, 0, len(n)) for i in same]
        place, seed = self.seeds(n)
        times = self.first[seed + 1] - self.first[seed]
        if not times.any():
            return []
        place = np.repeat(place, times)
        start = np.repeat(self.first[seed] - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
        pair = start + np.arange(len(place))
        item, rare = self.item_of[pair], self.rare[pair]
        seed = np.repeat(seed, times)
        order = np.argsort(item, kind="stable")  # places are in order already
        place, item, seed, rare = place[order], item[order], seed[order], rare[order]
        # near each other: hits of an item with no more than one and a half of its length between them
        sizes = self.sizes[item]
        cut = np.append(True, (item[1:] != item[:-1]) | (np.diff(place) > (sizes + sizes // 2)[1:]))
        edges = np.flatnonzero(cut)
        several = np.minimum.reduceat(seed, edges) < np.maximum.reduceat(seed, edges)
        open_ = np.logical_or.reduceat(rare, edges) | several | (self.enough[item[edges]] == 1)
        ends = np.append(edges[1:], len(item)) - 1
        best: dict[int, tuple[float, int, int]] = {}
        if not open_.any():
            return []
        if len(self.marks) != self.base:
            self.marks = np.zeros(self.base, bool)
        known = self.marks  # none is set between calls
        for k, a, b in zip(item[edges[open_]].tolist(), place[edges[open_]].tolist(), place[ends[open_]].tolist(), strict=True):
            words = self.words[k]
            reach = len(words)
            first = max(0, a - reach)
            passage = n[first : b + self.seed + reach]
            known[words] = True
            most = bound(passage, known, self.least * 2 * reach)
            known[words] = False
            if most < self.least * 2 * reach:
                continue
            score, end = align(words, passage)
            share = score / (2 * reach)
            if share >= self.least and share > best.get(k, (0.0,))[0]:
                best[k] = share, max(0, first + end - reach), first + end
        return [(self.ids[k], *found) for k, found in best.items()]


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of bounded size."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield [(r.item_id, r.text) for r in own.collect()]


def count_seeds(docs: DataFrame, block: Block) -> np.ndarray:
    """In how many documents each seed of the block stands. docs: a binary column body."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        vocabulary, total = Vocabulary(block.known), np.zeros(len(block.codes), np.int64)
        for batch in batches:
            for n in block.numbers(binary_rows(batch, "body"), vocabulary):
                total[np.unique(block.seeds(n)[1])] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["seed", "n"])

    out = np.zeros(len(block.codes), np.int64)
    for r in docs.select("body").mapInArrow(light("seeds", run), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect():  # as many rows as the block has seeds
        out[r.seed] = r.n
    return out


MATCHES = "array<struct<item_id: long, similarity: double, first_word: long, last_word: long>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))


def annotate(docs: DataFrame, benchmark: DataFrame, keep: list[str], least: float = LEAST) -> DataFrame:
    """The columns `keep` of every document, and matches, the items that it holds a copy of."""
    prepare(docs.sparkSession)
    out = docs.select(*keep, text_bytes().alias("_body"), F.array().cast(MATCHES).alias("matches"))
    for items in blocks(benchmark):
        block = Block(items, least=least)
        if not block.ids and not block.whole:
            continue
        block.mark_rare(count_seeds(docs.select(text_bytes().alias("body")), block))
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            vocabulary = Vocabulary(block.known)
            for batch in batches:
                found = [[dict(zip(("item_id", "similarity", "first_word", "last_word"), m, strict=True)) for m in block.matches(n)] for n in block.numbers(binary_rows(batch, "_body"), vocabulary)]
                at = batch.schema.get_field_index("matches")
                found = [a + b for a, b in zip(batch.column(at).to_pylist(), found, strict=True)]
                yield batch.set_column(at, "matches", pa.array(found, _ARROW))

        out = out.mapInArrow(light("seeds", run), out.schema)
    return out.drop("_body")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", F.inline("matches"))
