"""What the training-data operators share: tables, staged tables, cached tokenisation, text hashing."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a worker holds a bounded amount of text at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one is made if driver and executors are
    one process (tests); on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = getattr(spark, "_llm_shared_dir", None) or tempfile.mkdtemp(prefix="llm-shared-")
        spark._llm_shared_dir = path
    return path.rstrip("/")


#: Folders of the tables that the query in hand has staged, while release() may remove them.
_STAGED: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage is cut, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(make, name: str) -> DataFrame:
    """The table that make() gives, staged; the tables that were staged on the way to it are removed."""
    held = len(_STAGED)
    out = staged(make(), name)
    *mine, path = _STAGED[held:]
    _STAGED[held:] = [path]
    for x in mine:
        remove(out.sparkSession, x)
    return out


#: Rows of a key from which on a join spreads them, at least; and how many such keys there are at most, in shares of all.
HOT_ROWS, HOT_SHARE = 1000, 10_000


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join on `key`, of which right has one row each. Rows of a key with very many are dealt to several tasks: such
    keys, HOT_SHARE at most, are broadcast."""
    counts = staged(left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")), "key-counts")
    limit = max(HOT_ROWS, (counts.agg(F.sum("_n")).first()[0] or 0) // HOT_SHARE)
    hot = counts.where(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts")).cast("int"))
    # rows without a key are spread too: they get one that right doesn't have
    salt = F.coalesce(part, F.when(F.col(key).isNull(), (F.rand(5) * 1e6).cast("int")), F.lit(0))
    left = left.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_parts")
    many = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    right = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(many)).drop("_parts")
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def text_key(column: str = "text") -> Column:
    """Sixteen bytes of a text's SHA-256, none for null: rows that share it have the same text."""
    digest = F.unhex(F.substring(F.sha2(F.col(column).cast("binary"), 256), 1, 32))
    return F.when(F.col(column).isNull(), F.lit("").cast("binary")).otherwise(digest)


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes, null as none."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TwoGenerations(dict):
    """A dictionary that computes what it lacks and holds a bounded number of entries: when the young ones are too
    many they become the old ones, from which what is still asked for returns."""

    MOST = 1 << 18

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def __missing__(self, key: bytes):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.keep(key, value)
        return value

    def keep(self, key: bytes, value) -> None:
        if len(key) <= 64:
            if len(self) >= self.MOST:
                self.old = dict(self)
                self.clear()
            self[key] = value


#: ASCII signs that are a pre-token of their own beside a word: all but the apostrophe (contractions) and what special
#: tokens begin with.
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<")
#: The characters by which byte-level vocabularies write bytes: printable ones of Latin 1 stand for themselves, the others
#: follow from U+0100 on.
BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate(x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255))}
#: The same by number, for UTF-32; a space stays.
_VOCABULARY = np.array([32 if b == 32 else BYTE_CHARACTERS.get(b, b) for b in range(256)], "<u4")
#: A word in lower case of ASCII letters and of those that UTF-8 writes with 0xC3.
_PLAIN_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_SIGN, _LETTER = (np.array([chr(c).isalpha() and c < 128 if letter else c in SIGNS for c in range(256)]) for letter in (False, True))
#: Bytes of text that are taken apart at once.
CHUNK = 4 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


class WordCache(TwoGenerations):
    """Ids of a white-space-free piece as little-endian unsigned 32-bit bytes, by the piece's UTF-8 bytes.

    A tokenizer that never joins text across white space gives a text the ids of its pieces in order. Pieces are cut at
    ASCII white space alone, so any other white space stays inside a piece and is the tokenizer's own business. A piece of
    letters below U+0100 between ASCII signs is taken as the word in lower case and its signs: none of these characters
    changes the class or is joined by the normaliser. Whether a vocabulary's normaliser and pre-tokenizer allow that is
    read from its file; if they don't, whole texts go to the tokenizer.
    """

    MOST = 1 << 19

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        with open(path, encoding="utf-8") as f:
            self.parted = self.permits(json.load(f))

    @staticmethod
    def permits(spec: dict) -> bool:
        """Whether white space parts tokens, letters and signs are parted, and case doesn't matter."""
        def steps(x: dict | None, inner: str) -> list[dict]:
            return [] if x is None else x[inner] if x["type"] == "Sequence" else [x]

        normal, parting = steps(spec["normalizer"], "normalizers"), steps(spec["pre_tokenizer"], "pretokenizers")
        split = [x for x in parting if x["type"] == "Split"]
        pattern = split[0]["pattern"].get("Regex", "") if len(split) == 1 else ""
        signs = not any(set(t["content"].encode()) & set(b" \t\n\r") or not t["content"].startswith("<") for t in spec["added_tokens"])
        level = all(x["type"] == "Split" or x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in parting)
        known = [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"] and normal[1]["pattern"] == {"Regex": r"\s+"} and normal[1]["content"] == " "
        return known and level and signs and spec["post_processor"] is None and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and split[0]["invert"] and split[0]["behavior"] == "Removed"

    @staticmethod
    def parts(piece: bytes) -> tuple[bytes, bytes, bytes]:
        """The signs before a piece's word, the word in lower case, the signs after it; where it isn't so plain, the piece."""
        if piece.isalpha():
            return b"", piece.lower(), b""
        if b"<" not in piece and b"'" not in piece and (word := piece.strip(SIGNS)):
            if word.isalpha():
                low = word.lower()
            else:
                text = word.decode("utf-8", "replace")
                low = text.lower().encode() if text.isalpha() and max(text) < "\u0100" else b""
            if low:
                front, _, back = piece.partition(word)
                return front, low, back
        return b"", piece.lower() if piece.isascii() else piece, b""

    def compute(self, piece: bytes) -> bytes:
        front, word, back = self.parts(piece)
        if word != piece:
            ids = self[word]
            return self[front] + ids + self[back] if front else ids + self[back] if back else ids
        letters = piece.decode("utf-8", "replace")
        if letters.isalpha() and max(letters) < "\u0100":  # in lower case, or parts() had changed it
            return b"".join([self.packed[t.id] for t in self.model.tokenize(piece.decode("latin-1").translate(BYTE_CHARACTERS))])
        return self.whole(piece)

    def whole(self, text: bytes) -> bytes:
        return np.asarray(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def ids_of(self, units: list[bytes]) -> list[bytes]:
        """Of each of these distinct units (see units_of), the ids; words that are new are made ready for the model together."""
        out = list(map(self.get, units))
        new = [i for i, x in enumerate(out) if x is None]
        words = [i for i in new if units[i] not in self.old and _PLAIN_WORD.fullmatch(units[i])]
        # bytes as the vocabulary's characters; the spaces between words stay
        text = _VOCABULARY[np.frombuffer(b" ".join([units[i] for i in words]), np.uint8)].tobytes().decode("utf-32-le")
        tokenize, packed = self.model.tokenize, self.packed
        for i, word in zip(words, text.split(" "), strict=False):
            out[i] = ids = b"".join([packed[t.id] for t in tokenize(word)])
            self.keep(units[i], ids)
        for i in new:
            if out[i] is None:
                out[i] = self[units[i]]
        return out

    def encode(self, text: bytes) -> bytes:
        """The ids of a short text."""
        return b"".join(map(self.__getitem__, text.split())) if self.parted else self.whole(text)

    def encode_all(self, texts: list[bytes], chunk: int = CHUNK) -> Iterator[np.ndarray]:
        """Of each text in turn, the ids. Texts are taken apart together, `chunk` bytes at once, long ones bit by bit."""
        if not self.parted:
            yield from (np.frombuffer(self.whole(t), "<u4") for t in texts)
            return

        def flat(pieces: pa.BinaryArray, own: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            units, counts = units_of(pieces)
            code = units.dictionary_encode()
            ids = self.ids_of(byte_strings(code.dictionary))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            values, after = gathered(np.frombuffer(b"".join(ids), "<u4"), np.append(0, np.cumsum(sizes)), code.indices.to_numpy())
            values, after = gathered(values, after[np.append(0, np.cumsum(counts))], own)
            return values, after[ends]

        # characters below U+0100 are in lower case the same before and after the normaliser; special tokens are not
        yield from by_text((t.lower() if b"<" not in t and t and np.frombuffer(t, np.uint8).max() < 0xC4 else t for t in texts), flat, chunk)


def units_of(pieces: pa.BinaryArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The units of the pieces in turn, and how many each piece has: the signs before its word, the word in lower case, the
    signs after it, where the word has only ASCII letters and those that UTF-8 writes with 0xC3; else the piece."""
    _, offsets, buffer = pieces.buffers()
    n = len(pieces)
    bounds = np.frombuffer(offsets, np.int32, n + 1, 4 * pieces.offset) if n else np.zeros(1, np.int32)
    base, size = int(bounds[0]), int(bounds[-1] - bounds[0])
    data = np.frombuffer(buffer, np.uint8, size, base).copy() if size else np.zeros(0, np.uint8)
    bounds = bounds - np.int32(base)
    start, end = bounds[:-1], bounds[1:]
    signs, letters = _SIGN[data], _LETTER[data]
    # the second byte of a letter of two; none begins a piece
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    x = data[second]
    first_of_piece = np.zeros(size + 1, bool)
    first_of_piece[start] = True
    second = second[(x >= 0x80) & (x <= 0xBF) & (x != 0x97) & (x != 0xB7) & ~first_of_piece[second]]
    letters[second] = letters[second - 1] = True
    other = np.flatnonzero(~signs).astype(np.int32)
    before = np.append(0, np.cumsum(~signs, dtype=np.int32))
    i, j = before[start], before[end]
    other = np.append(other, np.int32(size))
    some = i < j
    word, after = np.where(some, other[i], end), np.where(some, other[j - 1] + np.int32(1), end)
    known = np.append(0, np.cumsum(letters, dtype=np.int32))
    plain = some & (known[after] - known[word] == after - word)
    # all signs, or not so plain: a unit of its own
    word, after = np.where(plain, word, end), np.where(plain, after, end)
    upper = (data >= 65) & (data <= 90)
    upper[second] = data[second] <= 0x9E
    if upper.any():
        data[upper & np.repeat(plain, end - start)] += 32
    cuts = np.stack([start, word, after], 1).ravel()
    full = np.diff(np.append(cuts, np.int32(size))) > 0
    places = np.append(cuts[full], np.int32(size)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)]), full.reshape(-1, 3).sum(1)


def gathered(values: np.ndarray, bounds: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the items `own` in turn, item i having those from bounds[i] to bounds[i + 1]; and the places in them
    at which the items end, with 0 before."""
    n = np.diff(bounds)[own]
    ends = np.append(0, np.cumsum(n))
    place = np.repeat(bounds[own] - ends[:-1], n)
    place += np.arange(len(place))
    return values[place], ends


def pieces_of(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """The distinct pieces between ASCII white space, the number of each piece of the texts in turn, and the places in
    these at which texts end, with 0 before. Empty pieces may be among them."""
    data = pa.array(texts, pa.binary())
    pieces = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(data), *data.buffers()[1:]))
    code = pieces.flatten().cast(pa.binary()).dictionary_encode()
    return code.dictionary, code.indices.to_numpy(), pieces.offsets.to_numpy()


def by_text(texts, flat, chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """Of each text in turn, its part of what flat(*pieces_of(some texts)) gives: values, and where texts end in them."""
    own: list[bytes] = []
    size = 0

    def done(some: list[bytes]) -> Iterator[np.ndarray]:
        if some:
            values, ends = flat(*pieces_of(some))
            ends = ends.tolist()
            for a, b in zip(ends, ends[1:], strict=False):
                yield values[a:b]

    for text in texts:
        if size + len(text) > chunk:
            yield from done(own)
            own, size = [], 0
        if len(text) > chunk:
            yield np.concatenate([next(done([t])) for t in slices(text, chunk)])
        else:
            own.append(text)
            size += len(text)
    yield from done(own)


def word_values(texts: list[bytes], value, dtype=np.int64) -> Iterator[np.ndarray]:
    """Of each text in turn, value(word) of its words between ASCII white space."""

    def flat(distinct: pa.BinaryArray, own: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces = byte_strings(distinct)
        if b"" in pieces:
            keep = own != pieces.index(b"")
            ends = np.append(0, np.cumsum(keep))[ends]
            own = own[keep]
            values = np.fromiter((value(p) if p else 0 for p in pieces), dtype, len(pieces))
        else:
            values = np.fromiter(map(value, pieces), dtype, len(pieces))
        return values[own], ends

    return by_text(texts, flat)


def slices(text: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of `size` bytes or little more, cut before white space."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def byte_strings(column: pa.Array) -> list[bytes]:
    """A binary column without nulls as a list."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset).tolist()
    view = data.to_pybytes() if data else b""
    return [view[a:b] for a, b in zip(ends, ends[1:], strict=False)]


_CACHES: dict[str, WordCache] = {}


_LAST = ""


def begin(kind: str) -> None:
    """Called by a task before its rows: where the worker's last task was of another kind, the caches of that go."""
    global _LAST
    if _LAST != kind:
        import gc

        gc.collect()
        empty()
        _LAST = kind


def empty() -> None:
    """The caches go, and what the allocators hold in reserve goes back to the system."""
    import ctypes

    _CACHES.clear()
    for x in (_WORDS, _WORDS.old):
        x.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def collect_heaps(spark: SparkSession) -> None:
    """The driver lets go of broadcasts and shuffles that nothing refers to any more, then the executors' JVMs collect their
    garbage and give the system what that frees: a stage whose workers need memory doesn't begin beside a heap at its
    largest. There are as many tasks as cores, so each executor gets one where none is busy; one without keeps its heap."""
    import gc

    gc.collect()
    spark._jvm.java.lang.System.gc()
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def light(kind: str, run):
    """run(batches) as a task of its kind that leaves nothing behind: a worker that waits beside its executor's JVM, which
    may be at its largest then, holds neither caches nor freed memory."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(kind)
        yield from run(batches)
        empty()

    return task


def word_cache(path: str) -> WordCache:
    """One cache for each vocabulary and worker process."""
    begin("tokens")
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHash(TwoGenerations):
    """64-bit hashes of words as they are, by their bytes."""

    def compute(self, word: bytes) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest(word)


_WORDS = WordHash()


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Of each text in turn, the hashes of its words between ASCII white space (space and 0x09 to 0x0D)."""
    return word_values(texts, _WORDS.__getitem__, np.uint64)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order; of the whole sequence if it is shorter; none of none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    h = words[: n - k + 1].copy()
    for i in range(1, k):
        h = mix64(h * _STEP + words[i : n - k + 1 + i])
    return mix64(h + np.uint64(k))


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def binary_rows(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
