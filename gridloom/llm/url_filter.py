"""Operator 6, URL filters: character language-model ratio beside allow and block rules.

Two smoothed Markov models of variable order over the bytes of host and path, one of URLs that the rules allow and one of
those that they block, are counted over all pages. An order's estimate is drawn towards the next lower order's by a fixed
weight, so unseen contexts fall back. A URL without a rule is judged by the difference of the two log-likelihoods a byte,
against a threshold set on a held-out fifth of the rule-judged URLs. Counts are exact: each context, and each context with
a byte, is a number of its own and a row of a distributed table that grows with the pages. Chunks of pages ask that table
for what they hold, each key once, so that a common one doesn't gather in a task; nothing of it goes to the driver.

Rows. A null URL, or one without "://", has an empty host and path and no rule; an empty one scores 0 for the models.
Without URLs of both kinds to learn from, the method allows. Repeated rows are judged each; a null page_id stays null;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import binary_rows, release, staged, table

#: (rule, verdict), a host and the start of a path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
ORDERS, WEIGHT = 6, 3.0
#: Pages of a chunk, as a power of two, and bytes of URLs that are taken apart at once.
CHUNK, PIECE = 11, 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_and_verdict(rules=RULES) -> tuple[Column, Column]:
    """Of the longest rule that fits columns host and path; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all bytes of the texts: keys of the context and of context and byte, by order; and the text's number.

    A key holds the bytes themselves, and above them the order and whether the byte is among them."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    pad = b"\0" * ORDERS
    data = np.frombuffer(b"".join(pad + t + b"\1" for t in texts), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths + ORDERS)
    first = np.cumsum(lengths + ORDERS) - (lengths + ORDERS)
    place = np.flatnonzero(np.arange(len(data)) - first[owner] >= ORDERS) if len(texts) else np.zeros(0, np.int64)
    h, before, after = np.zeros(len(place), np.int64), [], []
    for k in range(ORDERS):
        if k:
            h = h | data[place - k] << 8 * (k - 1)
        before.append(h | 2 * k << 8 * ORDERS)
        after.append(h << 8 | data[place] | (2 * k + 1) << 8 * ORDERS)
    return np.array(before), np.array(after), owner[place]


def pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, in lists of bounded size."""
    own, size = [], 0
    for t in texts:
        if own and size + len(t) > PIECE:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t) + ORDERS + 1
    if own:
        yield own


def distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The keys that the texts hold, in order, and how often."""
    found = [np.unique(np.concatenate([x.ravel() for x in contexts(own)[:2]]), return_counts=True) for own in pieces(texts)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)


def count_contexts(judged: DataFrame) -> DataFrame:
    """key, blocked, allowed: how often each context, and context with a byte, stands in URLs of either kind. judged: url, kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, urls = batch.column(1).to_pylist(), binary_rows(batch, "url")
            for kind in range(2):
                keys, n = distinct([u for u, k in zip(urls, kinds, strict=True) if k == kind])
                counts = [n, np.zeros_like(n)] if kind == 0 else [np.zeros_like(n), n]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, *counts)], ["key", "blocked", "allowed"])

    return judged.mapInArrow(run, "key long, blocked long, allowed long").groupBy("key").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))


def log_ratio(texts: list[bytes], keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log-likelihood as allowed less as blocked, a byte, of each text. keys in order; counts [kind, key]."""
    keys, counts = np.append(keys, np.int64(1) << 62), np.pad(counts, ((0, 0), (0, 1)))

    def count(asked: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, asked)
        return np.where(keys[at] == asked, counts[:, at], 0)

    out = [np.zeros(0)]
    for own in pieces(texts):
        before, after, owner = contexts(own)
        p = np.full((2, len(owner)), 1 / 256)
        for k in range(ORDERS):
            p = (count(after[k]) + WEIGHT * p) / (count(before[k]) + WEIGHT)
        out.append(np.bincount(owner, np.log(p[1]) - np.log(p[0]), minlength=len(own)) / np.array([len(t) + 1 for t in own]))
    return np.concatenate(out)


def calibrated(scored: DataFrame, bins: int = 4096, reach: float = 8.0) -> float:
    """Where allowed (kind 1) and blocked (0) rows part best by llr, both kinds counted alike, to a bin; 0 without either."""
    at = F.floor((F.greatest(F.lit(-reach), F.least(F.lit(reach), F.col("llr"))) + reach) * (bins / (2 * reach)))
    rows = scored.groupBy(at.alias("bin"), "kind").count().collect()  # twice the bins at most
    if not rows:
        return 0.0
    scores = np.array([r.bin * 2 * reach / bins - reach for r in rows])
    order = np.argsort(scores, kind="stable")
    kinds, weights = np.array([r.kind for r in rows])[order], np.array([r["count"] for r in rows], np.float64)[order]
    if kinds.min() == kinds.max():
        return 0.0
    s = scores[order]
    right = np.cumsum(weights * (kinds == 0)) / weights[kinds == 0].sum() - np.cumsum(weights * (kinds == 1)) / weights[kinds == 1].sum()
    right[:-1][s[:-1] == s[1:]] = -np.inf
    return float(s[int(right.argmax())] + 2 * reach / bins)


def scored(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds llr, the ratio for the binary column url. rows: also chunk, the number of a bounded set of rows."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = binary_rows(batch, "url")
            chunks = np.array(batch.column(0).to_pylist(), np.int64)
            for chunk in np.unique(chunks).tolist():
                keys, _ = distinct([urls[i] for i in np.flatnonzero(chunks == chunk)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk)), pa.array(keys)], ["chunk", "key"])

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        keys, first = np.unique(found.column("key").to_numpy(), return_index=True)
        counts = np.array([found.column(x).to_numpy()[first] for x in ("blocked", "allowed")], np.int64).reshape(2, -1)
        return rows.append_column("llr", pa.array(log_ratio(rows.column("url").to_pylist(), keys.astype(np.int64), counts), pa.float64()))

    found = rows.select("chunk", "url").mapInArrow(ask, "chunk long, key long").join(counts, "key")
    return rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(score, rows.select("*", F.lit(0.0).alias("llr")).schema)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the ratio and threshold that verdicts without a rule come from; held: rows
    that a rule judges and the models haven't learnt from."""
    return release(lambda: _judged(pages, rules), "judged-pages")


def _judged(pages: DataFrame, rules) -> DataFrame:
    host, path = host_and_path()
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_and_verdict(rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"), F.concat("host", "path").cast("binary").alias("url"))
    rows = rows.withColumn("kind", (F.col("by_rule") == "allow").cast("int")).withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK))
    rows = staged(rows, "pages")
    held, known = F.pmod(F.crc32("url"), F.lit(5)) == 0, F.col("kind").isNotNull()
    learnt = rows.where(known & ~held).select("url", "kind")
    both = learnt.select("kind").distinct().count() == 2
    out = staged(scored(rows, count_contexts(learnt)), "scored-pages")
    cut = calibrated(out.where(known & held).select("kind", "llr")) if both else 0.0
    says = F.when((F.col("llr") >= cut) | F.lit(not both), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", says).alias("verdict"), "llr", F.lit(cut).alias("threshold"), (known & held).alias("held"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
