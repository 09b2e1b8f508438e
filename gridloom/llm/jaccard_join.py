"""Operator 5, n-gram Jaccard join: signature trees within routed groups, exact verification, connected components.

A document's set are its distinct shingles of k words, as 64-bit hashes. Documents with equal sets are one node. Two nodes
whose Jaccard coefficient reaches the threshold share a shingle among the first n - ceil(t n) + 1 of each (in any one
order of all shingles), so nodes are routed to groups by those; the order puts shingles that a bounded sample finds
common last, which changes costs alone. Groups with the same members are one group.

In a group, members are the leaves of a signature tree whose nodes hold the OR of their bitmaps, the range of their sizes
and the most shingles that share a bit. Two tree nodes are traversed together and left when the most overlap that their
bitmaps and sizes allow is too small, or when all their members are joined already. Surviving pairs are verified on the
sets themselves. The first round takes only pairs that join different components (a large group of near copies then gives
as many pairs as members, not their square), the second a few surviving pairs of each member, drawn by a hash; the last
one takes every surviving pair between different components. Components come from repeated hooking to a neighbour and
contraction, in tables. These stops serve components alone: links() verifies every surviving pair of distinct sets, and
gives those that are similar and which document has which set.

Rows. Null and empty texts have an empty set, link with nothing and are their own component. Repeated rows and copies are
kept. A null doc_id takes part; a component's id is its smallest doc_id, null if it has none. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import HOT_ROWS, HOT_SHARE, binary_rows, collect_heaps, light, mix64, prepare, release, shingle_hashes, spread_join, staged, table, text_bytes, text_key, word_hashes

WORDS = 16  # of 64 bits in a bitmap
LEAF, FAN = 16, 8
#: The sample that finds common shingles: so many documents, or one in so many if that is more; and the most shingles
#: that count as common. These change the order of shingles, and with it costs, but no result.
SAMPLE, ONE_IN, COMMON = 4000, 16, 1 << 20
#: Pairs that a task gives at a time.
PAIRS = 1 << 16
#: Members of a group that one task takes; larger groups are parted.
BLOCK = 5000
#: The most of its groups, the first ones, that a node lists; see candidates.
KEYS = 64
#: Keys of two numbers that may be broadcast.
BROADCAST_ROWS = 500_000


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Of each text in turn, the distinct shingles' hashes in ascending order; words part at white space, A-Z in lower case."""
    return (np.unique(shingle_hashes(words, k)) for words in word_hashes([t.lower() for t in texts]))


def fingerprint(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def bitmap(own: np.ndarray, bits: int) -> np.ndarray:
    """A bit for each shingle by its hash; bits: a power of two, 64 at least."""
    out = np.zeros(bits, bool)
    out[(mix64(own) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def wide(own: np.ndarray) -> np.ndarray:
    """A bitmap with two to four bits a shingle."""
    return bitmap(own, 1 << max(6, (2 * len(own) - 1).bit_length()))


def most_shared(n: int, bits: np.ndarray, m: int, other: np.ndarray) -> int:
    """The most shingles that two sets of n and m can share by their wide bitmaps, the larger one folded."""
    while len(bits) > len(other):
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    while len(other) > len(bits):
        other = other[: len(other) // 2] | other[len(other) // 2 :]
    return min(n - int(np.bitwise_count(bits & ~other).sum()), m - int(np.bitwise_count(other & ~bits).sum()))


class Common:
    """Which shingles are common."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.maybe = np.zeros(1 << 21, bool)
        self.maybe[(self.hashes & np.uint64(len(self.maybe) - 1)).astype(np.int64)] = True

    def among(self, own: np.ndarray) -> np.ndarray:
        out = self.maybe[(own & np.uint64(len(self.maybe) - 1)).astype(np.int64)]
        some = np.flatnonzero(out)
        if len(some):
            at = np.minimum(np.searchsorted(self.hashes, own[some]), len(self.hashes) - 1)
            out[some] = self.hashes[at] == own[some]
        return out


def prefix(own: np.ndarray, common: Common, num: int, den: int) -> np.ndarray:
    """The shingles of which a similar set shares one: rare ones first, by their hashes."""
    n = len(own)
    size = n - (-(-num * n // den)) + 1
    rare = common.among(own)
    return np.concatenate([own[~rare][:size], own[rare]])[:size]


def common_shingles(docs: DataFrame, k: int, sample: int = SAMPLE, one_in: int = ONE_IN, most: int = COMMON) -> np.ndarray:
    """Shingles of three or more documents of the sample, the most common ones first."""
    n = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(shingle_sets(binary_rows(batch, "body"), k))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64) if own else [], pa.int64())], ["s"])

    some = docs if n <= sample else docs.where(F.pmod(F.xxhash64("body"), F.lit(1 << 30)) < max(sample * (1 << 30) // n, (1 << 30) // one_in))
    got = some.mapInArrow(light("shingles", run), "s long").groupBy("s").count().where("count >= 3").orderBy(F.desc("count"), "s").limit(most)
    return got.select("s").toArrow()["s"].to_numpy().view(np.uint64)  # eight bytes each, `most` at most


SETS = "doc_id long, h binary, n long, node long, bits binary, prefix array<long>"


def nodes_of(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Of each document (doc_id, h, body): the size, fingerprint, bitmap and prefix of its set."""
    common = Common(common_shingles(docs.select("body"), k))
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, bits, pre = [], [], [], []
            for own in shingle_sets(binary_rows(batch, "body"), k):
                n.append(len(own))
                node.append(fingerprint(own) if len(own) else None)
                bits.append(bitmap(own, 64 * WORDS).tobytes() if len(own) else None)
                pre.append(prefix(own, sent.value, num, den).view(np.int64) if len(own) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bits, pa.binary()), pa.array(pre, pa.list_(pa.int64()))], ["doc_id", "h", "n", "node", "bits", "prefix"])

    return docs.select("doc_id", "h", "body").mapInArrow(light("shingles", run), SETS)


class Tree:
    """A signature tree over members in the order of their components and sizes."""

    ANCHORS, TRIES = 4, 8

    def __init__(self, n: np.ndarray, bits: np.ndarray, labels: np.ndarray, node: np.ndarray):
        self.n, self.bits, self.labels, self.node = n, bits, labels, node.view(np.uint64)
        self.anchors = np.argsort(node)[: self.ANCHORS].tolist()
        pop = np.bitwise_count(bits).sum(1).astype(np.int64)
        self.slack = n - pop
        first = np.arange(0, len(n), LEAF)
        last = np.minimum(first + LEAF, len(n))
        level = {"first": first, "last": last, "or": np.bitwise_or.reduceat(bits, first), "least": np.minimum.reduceat(n, first), "most": np.maximum.reduceat(n, first), "slack": np.maximum.reduceat(self.slack, first)}
        self.levels = [level]
        while len(level["first"]) > 1:
            at = np.arange(0, len(level["first"]), FAN)
            end = np.minimum(at + FAN, len(level["first"])) - 1
            level = {"first": level["first"][at], "last": level["last"][end], "or": np.bitwise_or.reduceat(level["or"], at), "least": np.minimum.reduceat(level["least"], at), "most": np.maximum.reduceat(level["most"], at), "slack": np.maximum.reduceat(level["slack"], at)}
            self.levels.append(level)

    def joined(self, k: int, i: int, j: int) -> bool:
        x = self.levels[k]
        one = self.labels[x["first"][i]]
        return bool((self.labels[x["first"][i] : x["last"][i]] == one).all() and (self.labels[x["first"][j] : x["last"][j]] == one).all())

    def possible(self, k: int, i: int, j: int, num: int, den: int) -> bool:
        """Whether members of two nodes can overlap enough."""
        x = self.levels[k]
        if x["most"][i] * den < x["least"][j] * num or x["most"][j] * den < x["least"][i] * num:
            return False
        shared = int(np.bitwise_count(x["or"][i] & x["or"][j]).sum()) + int(min(x["slack"][i], x["slack"][j]))
        overlap = min(shared, int(x["most"][i]), int(x["most"][j]))
        return overlap * (num + den) >= num * int(x["least"][i] + x["least"][j])

    def partnered(self, num: int, den: int) -> np.ndarray:
        """Which members may be similar to another one."""
        self.labels = -1 - np.arange(len(self.n))  # 0, alike for all, once a partner is found
        for a, b, ok, _ in self._leaves(num, den):
            p, q = np.nonzero(ok)
            self.labels[a[p]] = self.labels[b[q]] = 0
        return self.labels == 0

    def drawn(self, num: int, den: int) -> Iterator[tuple[int, int]]:
        """About TRIES of each member's pairs with members of other components that may be similar, drawn by a hash."""
        degree = np.zeros(len(self.n), np.int64)
        for a, b, ok, _ in self._leaves(num, den):
            degree[a] += ok.sum(1)
            degree[b] += ok.sum(0)
        for a, b, ok, _ in self._leaves(num, den):
            p, q = np.nonzero(ok)
            p, q = a[p], b[q]
            take = mix64(self.node[p] + self.node[q]) / 2.0**64 * np.minimum(degree[p], degree[q]) < self.TRIES
            yield from zip(p[take].tolist(), q[take].tolist(), strict=True)

    def pairs(self, num: int, den: int, every: bool) -> Iterator[tuple[int, int]]:
        """Pairs of members of different components that may be similar: all, or such as join what isn't joined yet.

        In the latter case a few members are tried against all others first. They are the least by their nodes' numbers,
        so the groups that near copies share give the same pairs.
        """
        for u in [] if every else self.anchors:
            rest = np.flatnonzero(self.labels != self.labels[u])
            if not len(rest):
                break
            mine, other = self.bits[u][None], self.bits[rest]
            over = np.minimum(self.n[u] - np.bitwise_count(mine & ~other).sum(1).astype(np.int64), self.n[rest] - np.bitwise_count(other & ~mine).sum(1).astype(np.int64))
            for v in rest[over * (num + den) >= num * (self.n[u] + self.n[rest])].tolist():
                if self.labels[u] != self.labels[v]:
                    yield u, v
                    self.labels[self.labels == self.labels[v]] = self.labels[u]
        for a, b, ok, share in self._leaves(num, den):
            p, q = np.nonzero(ok)
            if every:
                yield from zip(a[p].tolist(), b[q].tolist(), strict=True)
                continue
            for at in np.argsort(-share[p, q], kind="stable").tolist():
                u, v = int(a[p[at]]), int(b[q[at]])
                if self.labels[u] != self.labels[v]:
                    yield u, v
                    self.labels[self.labels == self.labels[v]] = self.labels[u]

    def _leaves(self, num: int, den: int) -> Iterator[tuple[np.ndarray, ...]]:
        """The dual traversal: members of two leaves, which pairs may be similar, and the most that they can share."""
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            k, i, j = todo.pop()
            if self.joined(k, i, j) or not self.possible(k, i, j, num, den):
                continue
            if k:
                a = range(i * FAN, min((i + 1) * FAN, len(self.levels[k - 1]["first"])))
                b = range(j * FAN, min((j + 1) * FAN, len(self.levels[k - 1]["first"])))
                todo += [(k - 1, p, q) for p in a for q in b if i != j or p <= q][::-1]
                continue
            x = self.levels[0]
            a, b = np.arange(x["first"][i], x["last"][i]), np.arange(x["first"][j], x["last"][j])
            left, right = self.bits[a][:, None], self.bits[b][None]
            na, nb = self.n[a][:, None], self.n[b][None]
            over = np.minimum(na - np.bitwise_count(left & ~right).sum(2).astype(np.int64), nb - np.bitwise_count(right & ~left).sum(2).astype(np.int64))
            ok = (over * (num + den) >= num * (na + nb)) & (self.labels[a][:, None] != self.labels[b][None])
            if i == j:
                ok &= a[:, None] < b[None]
            if ok.any():
                yield a, b, ok, over / (na + nb)


def candidates(members: DataFrame, num: int, den: int, mode: str) -> DataFrame:
    """Pairs (a, b), a < b, of nodes; in mode "screen", (node, node) of each that has a partner.

    members: key, node, n, bits, comp; the rows of a key stand for a group's block, or for two blocks of it. In modes
    "some" and "every" also grp, the group, and keys, the first of a node's groups: a group leaves a pair to an earlier
    group that both list. The first group that both are in has none before it, so it gives the pair, and as a rule no other does.
    """
    columns = ["key", "node", "n", "bits", "comp", *(["grp", "keys"] if mode in ("some", "every") else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        now = None

        def solved() -> Iterator[pa.RecordBatch]:
            order = np.lexsort((held["node"], held["n"], held["comp"]))
            node, n, comp = (np.array(held[c], np.int64)[order] for c in ("node", "n", "comp"))
            bits = np.frombuffer(b"".join(held["bits"]), np.uint64).reshape(-1, WORDS)[order]
            tree = Tree(n, bits, np.unique(comp, return_inverse=True)[1], node)
            if mode == "screen":
                found = pa.array(node[tree.partnered(num, den)], pa.int64())
                yield pa.RecordBatch.from_arrays([found, found], ["a", "b"])
                return
            pairs = iter(tree.drawn(num, den) if mode == "some" else tree.pairs(num, den, mode == "every"))
            if mode != "span":
                grp = held["grp"][0]
                before = [{x for x in held["keys"][i] if x < grp} for i in order.tolist()]
                pairs = ((u, v) for u, v in pairs if before[u].isdisjoint(before[v]))
            while some := list(islice(pairs, PAIRS)):
                ends = node[np.array(some, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(ends.min(1)), pa.array(ends.max(1))], ["a", "b"])

        for batch in batches:
            for key, *row in zip(*(batch.column(i).to_pylist() for i in range(len(columns))), strict=True):
                if key != now:
                    if now is not None and len(held["node"]) > 1:
                        yield from solved()
                    now, held = key, {c: [] for c in columns[1:]}
                for c, v in zip(held, row, strict=True):
                    held[c].append(v)
        if now is not None and len(held["node"]) > 1:
            yield from solved()

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select(*columns).repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(light("pairs", run), "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sets are similar. sets: node, n, wide, own. Their wide bitmaps are compared before the sets."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, x, m, y = (batch.column(i).to_pylist() for i in range(6))
            over = [most_shared(i, np.frombuffer(p, np.uint64), j, np.frombuffer(q, np.uint64)) for i, p, j, q in zip(n, x, m, y, strict=True)]
            keep = [o * (num + den) >= num * (i + j) for o, i, j in zip(over, n, m, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * den >= num * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def joined(left: DataFrame, columns: list[str]) -> DataFrame:
        for side in ("a", "b"):
            left = left.join(sets.select(F.col("node").alias(side), *(F.col(c).alias(c + side) for c in columns)), side)
        return left.select("a", "b", *(c + side for side in ("a", "b") for c in columns))

    some = staged(joined(pairs, ["n", "wide"]).mapInArrow(light("pairs", bounded), "a long, b long"), "bounded")
    return joined(some, ["own"]).mapInArrow(light("pairs", exact), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, comp of every node of the links (a, b): hook each to its first neighbour in a hashed order, contract, repeat."""
    edges, labels, turn = staged(links.distinct(), "edges"), None, 0
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("p"))).alias("m"))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("p"))
        parent = staged(best.select("a", F.least(own, F.col("m"))["p"].alias("p")), "parents")
        if labels is None:
            labels = parent.select(F.col("a").alias("node"), F.col("p").alias("comp"))
        else:
            labels = staged(labels.join(parent, labels.comp == parent.a, "left").select("node", F.coalesce("p", "comp").alias("comp")), "labels")
        to_a, to_b = parent.select("a", F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(to_a, "a").join(to_b, "b").where("pa <> pb")
        edges = staged(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels
        turn += 1


def _routed(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The documents as bytes; their sets, all and those with shingles; and the groups that the sets are routed to."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("h"), text_bytes().alias("body"))
    every = staged(nodes_of(rows, k, num, den), "sets")
    some = every.where("node is not null")
    # one row for each distinct set, then for each shingle of its prefix, then for each group with several members
    own = staged(some.groupBy("node").agg(F.first("prefix").alias("prefix")).select(F.explode("prefix").alias("s"), "node"), "prefixes")
    sizes = own.groupBy("s").agg(F.count("*").alias("size"), F.sum(F.xxhash64("node").bitwiseAND(F.lit((1 << 40) - 1))).alias("sum"), F.min("node").alias("least"), F.max("node").alias("most")).where("size > 1")
    keys = sizes.select("s", "size", F.xxhash64("size", "sum", "least", "most").alias("key"))
    # shingles of very many nodes are few and broadcast, so their rows stay spread
    limit = max(HOT_ROWS, own.count() // HOT_SHARE)
    keys = staged(keys, "shingle-keys")
    own = own.join(F.broadcast(keys.where(F.col("size") > limit)), "s").unionByName(own.join(keys.where(F.col("size") <= limit), "s"))
    groups = staged(own.select("key", "node", "size").distinct(), "groups")
    return rows, every, some, groups


def links(docs: DataFrame, k: int, num: int, den: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All links between different texts: (a, b), a < b, each pair of distinct sets with Jaccard of num / den or more; and
    membership: doc_id, h (a hash of its text), n_shingles, node, the document's set as in a and b, null for an empty set.

    Documents of one node have equal sets, and so are linked with each other.
    """
    rows, every, some, groups = _routed(docs, k, num, den)
    membership = every.select("doc_id", "h", F.col("n").alias("n_shingles"), "node")
    if groups.isEmpty():
        return docs.sparkSession.createDataFrame([], "a long, b long"), membership
    grouped, sets = _members(groups, some, rows, k, num, den, block)
    # each set is a component of its own, so nothing counts as joined already
    pairs = candidates(parted(_listed(grouped.withColumn("comp", F.col("node"))), block, "every"), num, den, "every")
    return staged(verified(staged(pairs, "pairs"), sets, num, den).distinct(), "links"), membership


def classes(docs: DataFrame, k: int, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """Of each document: doc_id, h (a hash of its text), n_shingles, component_id. Similar: Jaccard of num / den or more."""

    def make() -> DataFrame:
        rows, every, some, groups = _routed(docs, k, num, den)
        collect_heaps(docs.sparkSession)
        labels = None if groups.isEmpty() else _links(groups, some, rows, k, num, den, block)
        least = some.groupBy("node").agg(F.min("doc_id").alias("least"))
        if labels is not None:
            both = least.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            least = spread_join(staged(both, "nodes"), both.groupBy("comp").agg(F.min("least").alias("first")), "comp").select("node", F.col("first").alias("least"))
        out = spread_join(every.select("doc_id", "h", "n", "node"), least, "node")
        # an empty set is its own component
        return out.select("doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))

    return release(make, "classes")


def parted(members: DataFrame, block: int, mode: str) -> DataFrame:
    """Large groups in blocks: each block alone (span, some), or every two blocks of a group together, once."""
    parts = F.ceil(F.col("size") / block).cast("int")
    part = F.pmod(F.xxhash64("node", F.lit(mode)), parts).cast("int")
    if mode in ("span", "some"):
        return members.withColumn("key", F.xxhash64("key", part))
    pair = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.xxhash64("key", F.least(p, F.col("part")), F.greatest(p, F.col("part"))))
    return members.withColumn("part", part).withColumn("key", F.explode(pair))


def _listed(members: DataFrame) -> DataFrame:
    """Adds grp, the group, and keys, the first of the node's groups."""
    keys = members.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, KEYS).alias("keys"))
    return members.join(keys, "node").withColumn("grp", F.col("key"))


def _members(groups: DataFrame, every: DataFrame, rows: DataFrame, k: int, num: int, den: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The members of groups that may be similar to another one, and their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(shingle_sets(binary_rows(batch, "body"), k))
            columns = [[fingerprint(x) for x in own], [len(x) for x in own], [wide(x).tobytes() for x in own], [x.tobytes() for x in own]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["node", "n", "wide", "own"])

    nodes = every.join(groups.select("node").distinct(), "node", "left_semi").groupBy("node")
    nodes = nodes.agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min(F.struct(F.coalesce("doc_id", F.lit(-1)).alias("d"), "h")).alias("rep"))
    members = groups.join(nodes, "node").withColumn("comp", F.col("node"))
    members = staged(members.select("key", "node", "size", "n", "bits", "comp", "rep"), "members")
    alive = staged(candidates(parted(members, block, "screen"), num, den, "screen").select(F.col("a").alias("node")), "partnered")
    grouped = staged(members.join(alive, "node", "left_semi").drop("comp"), "partnered-members")
    wanted = staged(grouped.select(F.col("rep.d").alias("d"), F.col("rep.h").alias("h")).distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = rows.withColumn("d", F.coalesce("doc_id", F.lit(-1))).join(wanted, ["d", "h"], "left_semi")
    sets = staged(texts.select("body").mapInArrow(light("shingles", run), "node long, n long, wide binary, own binary"), "verify-sets")
    return grouped.drop("rep"), sets


def _links(groups: DataFrame, every: DataFrame, rows: DataFrame, k: int, num: int, den: int, block: int) -> DataFrame | None:
    """node, comp of the nodes that are linked with others."""
    grouped, sets = _members(groups, every, rows, k, num, den, block)
    found, labels = None, None
    for turn in ("span", "some", "every"):
        now = grouped.withColumn("comp", F.col("node")) if labels is None else grouped.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        if labels is not None:
            open_ = now.groupBy("key").agg(F.min("comp").alias("one"), F.max("comp").alias("other")).where("one < other").select("key")
            now = spread_join(staged(now, "turn"), staged(open_.withColumn("open", F.lit(True)), "open"), "key").where("open").drop("open")
        if turn != "span":
            now = _listed(now)
        pairs = staged(candidates(parted(now, block, turn), num, den, turn), "pairs")
        if pairs.isEmpty():
            continue
        fresh = staged(verified(pairs, sets, num, den), "links")
        found = fresh if found is None else found.unionAll(fresh)
        if not fresh.isEmpty():
            labels = components(found)
    return labels


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), 4, 85, 100).drop("h")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), u AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id AS id, doc_id AS seen FROM documents
  UNION
  SELECT r.id, u.b FROM r JOIN u ON u.a = r.seen
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(m.least AS BIGINT) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT id, min(seen) AS least FROM r GROUP BY id) m ON m.id = d.doc_id
"""
