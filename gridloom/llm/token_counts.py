"""Operator 7, token counts: edit-aware counting with a segment tree of pre-token counts for each document.

A document's bytes are cut into leaves of whole pre-tokens, at the first place after some hundred bytes where two
characters are parted whatever stands around them: beside white space or a digit, or between a letter and a sign. A leaf
has its bytes and its token count; the balanced tree above has bytes and tokens of each subtree. An edit replaces a byte
range: the leaves that it touches, and a neighbour where it comes close to a leaf's end (the context that decides how the
ends are parted), are joined, changed and encoded anew, and the sums on the paths to them are set right. No other text is
encoded again, and no other node of the tree is made again.

Trees can be kept as a table of leaf sizes and counts (build_trees), from which a tree is put together without encoding
anything; apply_edits joins it with a table of edits and the documents. The query's edits follow from each document alone,
so there trees are built and edited in one task (count_edited), and no text is shuffled. Rows. A null text counts as empty, with no tokens;
edits are clamped to the text; repeated rows have equal trees and are counted each; a null doc_id stays null; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import WordCache, binary_rows, prepare, table, text_bytes, tokenizer_path, word_cache

LEAF_BYTES = 512
#: An edit that comes so near to a leaf's end takes the neighbour in.
CONTEXT = 8
_WHITE = frozenset(b"\x20\x09\x0a\x0b\x0c\x0d")


class Node(NamedTuple):
    """A leaf, with its text, or a node above two."""

    size: int
    tokens: int
    height: int
    left: Node | None = None
    right: Node | None = None
    text: bytes = b""


def above(a: Node, b: Node) -> Node:
    return Node(a.size + b.size, a.tokens + b.tokens, 1 + max(a.height, b.height), a, b)


def joined(a: Node | None, b: Node | None) -> Node | None:
    """Two trees in a row as one balanced tree; only nodes on the way to the seam are made."""
    if a is None or b is None:
        return a or b
    if a.height > b.height + 1:
        right = joined(a.right, b)
        if right.height <= a.left.height + 1:
            return above(a.left, right)
        if right.left.height > right.right.height:
            return above(above(a.left, right.left.left), above(right.left.right, right.right))
        return above(above(a.left, right.left), right.right)
    if b.height > a.height + 1:
        left = joined(a, b.left)
        if left.height <= b.right.height + 1:
            return above(left, b.right)
        if left.right.height > left.left.height:
            return above(above(left.left, left.right.left), above(left.right.right, b.right))
        return above(left.left, above(left.right, b.right))
    return above(a, b)


def over(leaves: list[Node]) -> Node | None:
    """A balanced tree over leaves."""
    while len(leaves) > 1:
        leaves = [above(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else None


def parted(tree: Node | None, at: int) -> tuple[Node | None, Node | None]:
    """The leaves that end at byte `at` or before, and the others."""
    if tree is None or at >= tree.size:
        return tree, None
    if tree.left is None:
        return None, tree
    if at < tree.left.size:
        a, b = parted(tree.left, at)
        return a, joined(b, tree.right)
    a, b = parted(tree.right, at - tree.left.size)
    return joined(tree.left, a), b


def leaves_of(tree: Node | None) -> Iterator[Node]:
    todo = [tree] if tree else []
    while todo:
        x = todo.pop()
        if x.left is None:
            yield x
        else:
            todo += [x.right, x.left]


class Borders:
    """Where a tokenizer's pre-tokens are parted whatever stands around."""

    def __init__(self, cache: WordCache):
        self.normal = cache.tokenizer.normalizer
        self.special = {c for t in cache.tokenizer.get_added_tokens_decoder().values() for c in t.content if not c.isalnum()}
        self.known: dict[str, tuple[str, str]] = {}

    def kinds(self, c: str) -> tuple[str, str]:
        """The kinds of the first and the last character that c becomes: white space, Letter, Number, sign; "" if unsure."""
        if c not in self.known:
            n = self.normal.normalize_str(c)
            kinds = ["W" if x.isspace() else unicodedata.category(x)[0] if unicodedata.category(x)[0] in "LN" else "S" for x in n] or [""]
            joins = unicodedata.category(c)[0] == "M" or "ᄀ" <= c <= "ᇿ" or c in self.special
            self.known[c] = ("" if joins else kinds[0], "" if c in self.special else "'" if n.endswith("'") else kinds[-1])
        return self.known[c]

    def between(self, a: str, b: str) -> bool:
        left, right = self.kinds(a)[1], self.kinds(b)[0]
        if not left or not right:
            return False
        return "W" in left + right or "N" in left + right or left == "L" and right == "S" or left == "S" and right == "L"

    def after(self, text: bytes, at: int) -> int:
        """The first border at byte `at` or after it, or the text's end."""
        while at < len(text):
            if text[at] in _WHITE:
                return at
            if text[at] & 0xC0 != 0x80:  # a character begins
                first = at - 1
                while first and text[first] & 0xC0 == 0x80:
                    first -= 1
                last = at + 1
                while last < len(text) and text[last] & 0xC0 == 0x80:
                    last += 1
                if self.between(text[first:at].decode("utf-8", "replace")[-1], text[at:last].decode("utf-8", "replace")[0]):
                    return at
            at += 1
        return len(text)


class CountTree:
    """Token counts of a text under edits. `encoded` is how many bytes have been given to the tokenizer so far."""

    def __init__(self, text: bytes, cache: WordCache, leaves: Iterable[tuple[int, int]] | None = None):
        """leaves: bytes and tokens of each leaf, if they are known."""
        self.cache, self.encoded = cache, 0
        if not hasattr(cache, "borders"):
            cache.borders = Borders(cache)
        if leaves is None:
            own = self._cut(text)
        else:
            own, at = [], 0
            for size, tokens in leaves:
                own.append(Node(size, tokens, 0, text=text[at : at + size]))
                at += size
        self.root = over(own)

    def _cut(self, text: bytes) -> list[Node]:
        out, at = [], 0
        while at < len(text):
            end = self.cache.borders.after(text, at + LEAF_BYTES)
            out.append(text[at:end])
            at = end
        self.encoded += len(text)
        counts = [len(x) for x in self.cache.encode_all(out)] if len(out) > 4 else [len(self.cache.encode(x)) // 4 for x in out]
        return [Node(len(x), n, 0, text=x) for x, n in zip(out, counts, strict=True)]

    @property
    def tokens(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def size(self) -> int:
        return self.root.size if self.root else 0

    def leaves(self) -> list[tuple[int, int]]:
        return [(x.size, x.tokens) for x in leaves_of(self.root)]

    def text(self) -> bytes:
        return b"".join(x.text for x in leaves_of(self.root))

    @staticmethod
    def _whole(text: bytes, at: int) -> int:
        """The next place from `at` on that doesn't lie within a character."""
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        return at

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replaces the bytes from start to end; an end within a character moves past it."""
        start = max(0, min(start, self.size))
        end = max(start, min(end, self.size))
        before, rest = parted(self.root, max(0, start - CONTEXT))
        first = before.size if before else 0
        # the leaf in which the edit and its context end goes too; one more if a character's rest reaches beyond
        reach = min(self.size, end + CONTEXT + 4) - first
        own, after = parted(rest, reach)
        if own is None or own.size < reach:
            leaf, after = next(leaves_of(after), None), after
            if leaf is not None:
                _, after = parted(after, leaf.size)
                own = joined(own, leaf)
        text = b"".join(x.text for x in leaves_of(own))
        start, end = (self._whole(text, x - first) for x in (start, end))
        self.root = joined(joined(before, over(self._cut(text[:start] + new + text[end:]))), after)


def tree_key() -> Column:
    """Rows that share it have the same doc_id, length and hashes of the text, and so equal trees."""
    return F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("d"), F.octet_length("body").alias("n"), F.xxhash64("body").alias("h"), F.crc32("body").alias("c"))


def build_trees(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, key, n_bytes, n_tokens, sizes and tokens of the leaves, of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(path)
        for batch in batches:
            trees = [CountTree(text, cache) for text in binary_rows(batch, "body")]
            leaves = [t.leaves() for t in trees]
            own = [pa.array([t.size for t in trees], pa.int64()), pa.array([t.tokens for t in trees], pa.int64()), *(pa.array([[x[i] for x in own] for own in leaves], pa.list_(pa.int64())) for i in range(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], ["doc_id", "key", "n_bytes", "n_tokens", "sizes", "tokens"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).select("doc_id", tree_key().alias("key"), "body")
    schema = rows.select("doc_id", "key", *(F.lit(0).cast("long").alias(x) for x in ("n_bytes", "n_tokens")), *(F.array().cast("array<long>").alias(x) for x in ("sizes", "tokens"))).schema
    return rows.mapInArrow(run, schema)


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """The counts of every document after its edits. trees: from build_trees. edits: key, as there, and edits, an array of
    (start, end, new) that are made in a row; documents without any keep their counts. Rows with one key have equal text,
    so they are edited alike. A document's text is read, but only what edits touch is encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(path)
        for batch in batches:
            doc_id, body, sizes, tokens, edits = (batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("doc_id", "body", "sizes", "tokens", "edits"))
            out = []
            for text, own, counts, some in zip(body, sizes, tokens, edits, strict=True):
                tree = CountTree(text, cache, zip(own, counts, strict=True))
                before = tree.tokens, tree.size
                for e in some or []:
                    tree.edit(e["start"], e["end"], e["new"])
                out.append((*before, len(some or []), tree.tokens, tree.size, tree.encoded))
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), *(pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 6))], [x.split()[0] for x in SCHEMA.split(", ")])

    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).withColumn("key", tree_key())
    # an empty text without an id may come many times: it needs no tree, and with the key null no join
    key = F.when(F.col("key.n") > 0, F.col("key"))
    known = trees.where("n_bytes > 0").dropDuplicates(["key"]).select("key", "sizes", "tokens").join(edits.select("key", "edits"), "key", "left")
    empty = edits.where("key.n = 0").select(F.col("key").alias("empty"), F.col("edits").alias("first"))
    rows = rows.withColumn("empty", F.when(F.col("key.n") == 0, F.col("key"))).withColumn("key", key).join(known, "key", "left").join(empty, "empty", "left")
    none = F.array().cast("array<long>")
    return rows.select("doc_id", "body", F.coalesce("sizes", none).alias("sizes"), F.coalesce("tokens", none).alias("tokens"), F.coalesce("edits", "first").alias("edits")).mapInArrow(run, SCHEMA)


def sample_edits(trees: DataFrame) -> DataFrame:
    """Three edits of each document, fixed by its size and id: a replacement, an insertion, a deletion."""
    def spot(k: int) -> Column:
        return F.pmod(F.floor(F.col("n_bytes") * (2 * k + 1) / 7) + F.coalesce("doc_id", F.lit(0)) * 31, F.col("n_bytes") + 1).cast("long")

    def one(k: int, length: int, new: str) -> Column:
        return F.struct(spot(k).alias("start"), (spot(k) + length).alias("end"), F.lit(new).cast("binary").alias("new"))

    own = F.array(one(0, 11, "revised"), one(1, 0, " inserted passage, "), one(2, 40, ""))
    return trees.dropDuplicates(["key"]).select("key", own.alias("edits"))


def sample_edits_of(size: int, number: int) -> list[tuple[int, int, bytes]]:
    """The same edits, for a text of so many bytes and a doc_id."""
    spots = [(size * (2 * k + 1) // 7 + number * 31) % (size + 1) for k in range(3)]
    return [(spots[0], spots[0] + 11, b"revised"), (spots[1], spots[1], b" inserted passage, "), (spots[2], spots[2] + 40, b"")]


SCHEMA = "doc_id long, n_tokens long, n_bytes long, n_edits long, n_tokens_after long, n_bytes_after long, bytes_reencoded long"


def count_edited(docs: DataFrame, path: str, edits=sample_edits_of) -> DataFrame:
    """Token counts of each document before and after its edits, edits(bytes, doc_id or 0) -> [(start, end, new)]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(path)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), binary_rows(batch, "body"), strict=True):
                tree = CountTree(text, cache)
                before, tree.encoded = (tree.tokens, tree.size), 0
                own = edits(tree.size, doc_id or 0)
                for e in own:
                    tree.edit(*e)
                out.append((doc_id, *before, len(own), tree.tokens, tree.size, tree.encoded))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 7)], [x.split()[0] for x in SCHEMA.split(", ")])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).mapInArrow(run, SCHEMA)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edited(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
