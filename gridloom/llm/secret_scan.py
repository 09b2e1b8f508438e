"""Operator 4, secret scans: multipart credential linking, in DataFrame functions alone.

Base kinds are found as they are: assign, access and hex. The method adds weak candidates, which mean nothing alone:
ident (a user or client name), weak (a short password-like value), blob (forty characters of base 64) and endpoint (an
address). An interval join of parts within a scope, so many code points around a part, reports a weak candidate only
when a complementary part lies there: identifiers and endpoints with secrets, and secrets with them (a blob only with an
identifier). Base parts take part as access identifiers (access) and secrets (assign, hex).

Offsets come from the lengths of the texts between matches, summed by a window over the matches of a kind; the join is an
equi-join on row and bucket of the text with the distance as its condition, so no row pairs beyond the scope are made.

Rows. Null texts count as empty. A row's result depends on its doc_id and text alone, so repeated rows get equal results
and one result each; a null doc_id stays null; a row without spans has counts of 0 and empty spans; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import staged, table, text_key

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: (kind, pattern, group whose length counts, its least length), in the order in which equal starts are listed.
KINDS = (
    ("assign", rf"(?i:password|passwd|secret|token|api_?key){_VALUE}([A-Za-z0-9+/_.=-]+)", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("ident", rf"(?i:user_?name|login|client_?id|account_?id|access_?key_?id){_VALUE}([A-Za-z0-9@._-]+)", 1, 4),
    ("weak", rf"(?i:pwd|pass_?phrase|pass|credential|private_?key|secret_?key){_VALUE}([A-Za-z0-9+/_.=!@#$%^&*-]+)", 1, 6),
    ("blob", r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 40),
    ("endpoint", r"(?i:https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", 0, 10),
)
BASE = 3
SCOPE = 256
_ORDER = {k: i for i, (k, *_) in enumerate(KINDS)}
_SECRETS, _NAMES, _PLACES = ("assign", "hex", "weak", "blob"), ("access", "ident"), ("endpoint",)


def row_key() -> Column:
    """A key that rows share only if they have the same id and text."""
    return F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("d"), text_key().alias("h"))


def match_lengths(docs: DataFrame) -> DataFrame:
    """Of each row: row, doc_id, and of each kind its matches' (gap before it, length, length that counts)."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = out.select(row_key().alias("row"), "doc_id", "text", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p, _, _ in KINDS))

    def lengths(kind: str, pattern: str, group: int) -> Column:
        found = F.col(f"m_{kind}")
        gaps = F.split("text", pattern, -1)
        counts = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else found
        zipped = F.zip_with(F.arrays_zip(gaps.alias("g"), found.alias("m")), counts, lambda a, v: F.struct(F.length(a["g"]).alias("gap"), F.length(a["m"]).alias("length"), F.length(v).alias("counts")))
        return F.when(F.size(found) > 0, F.filter(zipped, lambda x: x["length"].isNotNull()))

    return out.select("row", "doc_id", *(lengths(k, p, g).alias(k) for k, p, g, _ in KINDS))


def parts(lengths: DataFrame) -> DataFrame:
    """One row for each part: row, kind, start, end (code points, end exclusive)."""
    least = F.create_map(*(x for k, _, _, n in KINDS for x in (F.lit(k), F.lit(n))))
    some = lengths.where(F.greatest(*(F.col(k).isNotNull() for k, *_ in KINDS)))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("of")) for k, *_ in KINDS))
    rows = some.dropDuplicates(["row"]).select("row", F.explode(kinds).alias("x")).select("row", F.col("x.kind").alias("kind"), F.posexplode("x.of").alias("i", "m"))
    end = F.sum(F.col("m.gap") + F.col("m.length")).over(Window.partitionBy("row", "kind").orderBy("i"))
    spans = rows.select("row", "kind", "m.length", "m.counts", end.cast("long").alias("end"))
    return spans.where(F.col("counts") >= least[F.col("kind")]).select("row", "kind", (F.col("end") - F.col("length")).alias("start"), "end")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts of found that a complementary part lies within the scope of."""
    def dealt(kinds: tuple[str, ...], reach: int) -> DataFrame:
        first, last = F.floor(F.greatest(F.col("start") - reach, F.lit(0)) / scope), F.floor((F.col("end") + reach) / scope)
        return found.where(F.col("kind").isin(*kinds)).withColumn("bucket", F.explode(F.sequence(first, last)))

    def beside(kinds: tuple[str, ...], others: tuple[str, ...]) -> DataFrame:
        a, b = dealt(kinds, scope).alias("a"), dealt(others, 0).alias("b")
        near = (F.col("a.start") - F.col("b.end") <= scope) & (F.col("b.start") - F.col("a.end") <= scope)
        return a.join(b, (F.col("a.row") == F.col("b.row")) & (F.col("a.bucket") == F.col("b.bucket")) & near, "left_semi").select("row", "kind", "start", "end")

    return beside(("ident",), _SECRETS).unionAll(beside(_PLACES, ("assign", "hex", "weak"))).unionAll(beside(("weak",), _NAMES + _PLACES)).unionAll(beside(("blob",), _NAMES))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Of each document: row, doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    lengths = staged(match_lengths(docs), "secret-lengths")
    found = staged(parts(lengths), "secret-parts")
    base = tuple(k for k, *_ in KINDS[:BASE])
    order = F.create_map(*(F.lit(x) for kv in _ORDER.items() for x in kv))
    every = found.where(F.col("kind").isin(*base)).unionAll(linked(found, scope)).withColumn("k", order[F.col("kind")])
    rows = every.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "k", "kind", "end"))).alias("s"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    rows = rows.select("row", *map(count, base), listed(F.filter("s", lambda s: s["k"] < BASE)).alias("base"), listed(F.col("s")).alias("spans"))
    # rows without any match need no join, and may be many with one key
    some = F.greatest(*(F.col(k).isNotNull() for k, *_ in KINDS))
    out = lengths.where(some).select("row", "doc_id").join(rows, "row", "left").unionByName(lengths.where(~some).select("row", "doc_id"), allowMissingColumns=True)
    zero = [F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in base]
    return out.select("row", "doc_id", *zero, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("row")
