"""The training-data operators against brute force, on small tables that hold nulls, empty texts, ties and repeats."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import common as C
from gridloom.llm import decontaminate, jaccard_join, license_scan, packing, quality, secret_scan, token_counts, token_output, topk_search, url_filter

SF = "/root/testdata/sf0.001"
PATH = C.tokenizer_path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, matches string"
TEXTS = [None, "", " \n", "one two three", "Hello, World! don't <|endoftext|> x́ 漢字 1234 " * 40, "word " * 9000, "same text as another one here", "same text as another one here"]


def documents(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, None, "s", None, 1.0, "clash") for i, t in zip(ids, texts, strict=True)], DOCS)


TOKENIZER = Tokenizer.from_file(PATH)


def encoded(text, end):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, [*TEXTS, "no id"], [*range(len(TEXTS)), None])


# ---- 1


def test_codec_round_trip_and_damage():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0), np.array([7]), rng.zipf(1.3, 20000) % 49000, np.zeros(5000), rng.integers(0, 2**32, 70000)):
        ids = ids.astype("<u4")
        assert (token_output.decode(token_output.encode(ids, 512, 64)) == ids).all()
    ids = (rng.zipf(1.5, 9000) % 49000).astype("<u4")
    data = token_output.encode(ids, 512, 64)
    size = min(512, max(256, -(-len(ids) // 64)))
    assert (token_output.decode(data, 3) == ids[3 * size : 4 * size]).all()
    bad = bytearray(data)
    bad[-40] ^= 255
    with pytest.raises(token_output.BadBlock):
        token_output.decode(bytes(bad))


@pytest.mark.parametrize(("symbols", "form"), [(49_408, 1), (65_000, 1), (70_000, 2)])
def test_blocks_of_segments_with_many_distinct_ids(symbols, form):
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.permutation(symbols), rng.zipf(1.3, 150_000) % symbols]).astype("<u4")
    data = token_output.encode(ids)
    assert data[4] == form and len(data) < 0.85 * ids.nbytes
    assert (token_output.decode(data) == ids).all()
    each = [token_output.decode(data, i) for i in (0, 3, token_output.blocks(data) - 1)]
    assert (each[0] == ids[: len(each[0])]).all() and (each[1] == ids[3 * len(each[0]) :][: len(each[1])]).all() and (each[2] == ids[len(ids) - len(each[2]) :]).all()
    bad = bytearray(data)
    bad[-40] ^= 255
    with pytest.raises(token_output.BadBlock, match=r"block \d+"):
        token_output.decode(bytes(bad))
    assert (token_output.decode(bytes(bad), 0) == each[0]).all()


def test_more_symbols_than_a_header_takes():
    ids = np.random.default_rng(2).integers(0, 2**32, 5000).astype("<u4")
    data = token_output.encode(ids, 512, 64, most=700)
    assert data[4] == 2 and (token_output.decode(data) == ids).all()
    assert (np.concatenate([token_output.decode(data, i) for i in range(token_output.blocks(data))]) == ids).all()


@pytest.mark.parametrize("at", [0, 4, 5, 9, 30, 37, 60, 200])
def test_damage_anywhere_is_found(at):
    data = bytearray(token_output.encode((np.random.default_rng(3).zipf(1.5, 9000) % 49000).astype("<u4"), 512, 64))
    data[at] ^= 41
    with pytest.raises(token_output.BadBlock):
        token_output.decode(bytes(data))
    with pytest.raises(token_output.BadBlock):
        token_output.decode(bytes(data[: at + 1]))


def test_order_0_adapts_within_a_block():
    rng = np.random.default_rng(6)
    kinds = np.repeat(rng.integers(0, 2, 400), 512)  # each block has ids of one half of the alphabet alone
    ids = np.where(kinds == 0, rng.zipf(1.2, len(kinds)) % 16, 1000 + rng.integers(0, 1000, len(kinds))).astype("<u4")
    symbols, counts = np.unique(ids, return_counts=True)
    entropy = -(counts * np.log2(counts / counts.sum())).sum() / 8
    assert len(token_output.encode(ids, 512, 400)) < 0.97 * entropy


def test_ids_are_the_tokenizers_own():
    """Every character before and after every kind of neighbour, and texts longer than what is taken apart at once."""
    cache = C.word_cache(PATH)
    texts = [f"{c}. A{c}, ({c}) x{c}! E{c}e; {c}'s _{c}_ 5{c}: {c}?" for c in map(chr, range(0x30000)) if not 0xD800 <= ord(c) < 0xE000]
    texts += ["", " ", "\n\nb c  ", "İSTANBUL DİLİ.", "Ankara'da YENİ, bir", "word " * 2_000_000]
    own = cache.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert cache.parted and all(a.ids == b.tolist() for a, b in zip(own, cache.encode_all([t.encode() for t in texts]), strict=True))
    other = C.WordCache(C.tokenizer_path("byte_bpe_50k.json"))
    assert not other.parted and next(other.encode_all([b"two  words"])).tolist() == other.tokenizer.encode("two  words", add_special_tokens=False).ids


def test_a_word_is_tokenised_once_whatever_signs_and_case_it_has():
    cache = C.WordCache(PATH)
    texts = ["Été, (été) ÉTÉ. été!? #été", "Anblewh, anblewh. ANBLEWH #anblewh", " ", "×été÷ ªb b. <été> 'b", "anblewh" * 20 + ", été"]
    got = [x.tolist() for x in cache.encode_all([t.encode() for t in texts])]
    assert got == [encoded(t, 0)[:-1] for t in texts]
    plain = {w for w in cache if w.decode().isalpha() and w.decode() != "ªb"}
    assert plain == {"été".encode(), b"anblewh", b"b"}
    assert {w for w in cache if w not in plain} == {b",", b"(", b")", b".", b"!?", b"#", *(w.encode() for w in ("×été÷", "ªb", "<été>", "'b"))}


@pytest.mark.parametrize(("symbols", "kind", "sum_of_words"), [(8192, np.int16, 664057889), (8193, np.int32, 886277558)])
def test_entries_take_the_smaller_type_that_holds_them(symbols, kind, sum_of_words):
    """And the blocks are those that entries of 32 bits gave."""
    ids = (np.arange(40_000) * 7919 % 65_536 % symbols).astype("<u4")
    ids[20_000:] = ids[:20_000] // 50
    ids[:symbols] = np.arange(symbols)
    assert token_output.Alphabet.of(*np.unique(ids, return_counts=True)).kind == kind
    data = token_output.encode(ids, 700, 64)
    assert (token_output.decode(data) == ids).all() and (token_output.decode(data, 5) == ids[5 * 625 : 6 * 625]).all()
    assert zlib.crc32(token_output._opened(data)[2]) == sum_of_words  # without the header, which zlib packs

def test_token_output(spark, odd):
    got = token_output.read_segments(token_output.write_segments(odd, PATH, 1, segment=50)).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *range(len(TEXTS))]
    start = 0
    for r in got:
        ids = encoded("no id" if r.doc_id is None else TEXTS[r.doc_id], 1)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert token_output.read_segments(token_output.write_segments(odd.where("false"), PATH, 1)).count() == 0


# ---- 2


def test_quality_on_held_out_rows(spark):
    labels = C.table(spark, SF.replace("0.001", "0.01"), "labels")
    got = quality.op2_quality(spark, SF.replace("0.001", "0.01")).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert (got.predicted == got.quality).mean() > 0.9


def test_quality_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors, net = quality.fit(odd, none)
    got = quality.scores(odd.select("doc_id", "text"), vectors, net).collect()
    assert len(got) == len(TEXTS) + 1 and {r.score for r in got} == {0.5}
    assert quality.scores(odd.where("false").select("doc_id", "text"), vectors, net).count() == 0


def plain_index(h):
    out = np.zeros(quality.DIM)
    for at, sign in zip(*(x[0] for x in quality.index_entries(np.array([h], np.uint64))), strict=True):
        out[at] += sign
    return out


def test_quality_against_plain_loops(spark):
    """Context sums, loads, pooled features and scores of whole documents, word by word."""
    texts = [None, "", "One two, three. one", "two three\ntwo three", "x1 AB-9! one", "Dos uno: tres", "one", "a b " * 300]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    docs = documents(spark, texts).repartition(3)
    sketch, net = quality.fit(docs, labels)
    units = quality.Units()
    sums, load = np.zeros((quality.UNITS, quality.DIM), int), np.zeros(quality.UNITS, int)
    words = [[units[w.encode()] for w in (t or "").split()] for t in texts]
    assert units[b"One"] == units[b"one,"] and units[b"x1"] == units[b"y77"] != units[b"xy"]
    place = {h: sorted({int(x) for x in quality.units_of(np.array([h], np.uint64))[:, 0]}) for own in words for h in own}
    for own in words:
        for i, h in enumerate(own):
            for u in place[h]:
                load[u] += 1
                for j in range(max(0, i - quality.REACH), min(len(own), i + quality.REACH + 1)):
                    if j != i:
                        sums[u] += plain_index(own[j]).astype(int)
    assert (sketch.sums == sums).all() and (sketch.load == load).all()
    got = {r.doc_id: r.score for r in quality.scores(documents(spark, texts).select("doc_id", "text"), sketch, net).collect()}
    for i, own in enumerate(words):
        rows = []
        for h in own:
            u = min(place[h], key=lambda u: (load[u], place[h].index(u)))
            f = sums[u].astype(float)
            rows.append(np.concatenate([(f / max(1.0, np.sqrt((f**2).sum()))).astype(np.float32), plain_index(h) / 2]))
        x = np.zeros(quality.FEATURES)
        if rows:
            mean = sum(rows) / len(rows)
            lines, t = texts[i].split("\n"), texts[i].encode()
            runs = {tuple(own[j : j + 6]) for j in range(max(1, len(own) - 5))}
            x[:] = [*mean, *np.sqrt(sum((r - mean) ** 2 for r in rows) / len(rows)), np.log1p(len(own)), len(set(lines)) / len(lines), len(runs) / max(1, len(own) - 5), sum(h & 1 == 0 for h in own) / len(own), len(t) / len(own) / 10]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-net.logits(x[None])[0] / net.temperature)), abs=1e-6)


def test_gradients_and_temperature():
    rng = np.random.default_rng(5)
    z, y = rng.normal(size=(40, 6)), rng.integers(0, 2, 40).astype(float)
    p = [rng.normal(size=(6, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=1)]
    full = lambda: quality.log_loss(z, y, p) + quality.DECAY / 2 * ((p[0] ** 2).sum() + (p[2] ** 2).sum())
    for part, grad in zip(p, quality.gradients(z, y, p), strict=True):
        for at in np.ndindex(part.shape):
            keep, step = part[at], 1e-6
            part[at] = keep + step
            up = full()
            part[at] = keep - step
            assert grad[at] == pytest.approx((up - full()) / (2 * step), abs=1e-6)
            part[at] = keep
    x = rng.normal(size=(2000, 5))
    y = (x[:, 0] + 0.7 * rng.normal(size=2000) > 0).astype(float)
    net = quality.train(x[:1500], y[:1500])
    score = net.probabilities(x[1500:])
    assert net.learned and ((score > 0.5) == (y[1500:] > 0)).mean() > 0.7
    for a in np.arange(0, 1, 0.2):  # calibrated: among rows scored alike, the share of label 1 is near the score
        own = (score >= a) & (score < a + 0.2)
        assert own.sum() < 20 or abs(y[1500:][own].mean() - score[own].mean()) < 0.15


def test_context_sums_do_not_depend_on_partitions(spark):
    docs = C.table(spark, SF, "documents").select(C.text_bytes().alias("body"))
    a, b = quality.context_sums(docs.repartition(5)), quality.context_sums(docs.coalesce(1))
    assert (a.sums == b.sums).all() and (a.load == b.load).all()


# ---- 3


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = np.round(rng.normal(size=(300, 6)), 1).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(i, [0.5] * 6) for i in range(300, 400)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6), (500, [0.5] * 6)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(5)
    for block, shard in ((4096, 1 << 16), (2, 1 << 16), (4096, 7)):
        got = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 100 == 0, 10, block=block, shard=shard).collect()))
        ok = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
        want = []
        for i, q in ok:
            if i % 100 == 0:
                best = sorted((-int(q @ v), j) for j, v in ok if j != i)[:10]
                want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
        assert got == sorted(want)
    assert topk_search.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_topk_keeps_ties_beside_repeated_ids(spark):
    rows = [(i, [0.5, 1.0]) for i in [100] * 2 + list(range(101, 111)) + [200] * 15 + [300] * 12 + [301, 302] + [99] * 3] + [(i, [0.1, 0.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id").isin(99, 100, 200, 300), 10).collect()))
    want = []
    for q in (99, 100, 200, 300):
        best = sorted((-512 * int(1024 * np.float32(v[0])) - 1024 * int(1024 * np.float32(v[1])), i) for i, v in rows if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


# ---- 4


def test_secret_spans(spark):
    texts = [None, "", "password=short", 'API_KEY: "abcdefghijkl" and token=password=aaaaaaaaaaaaaaa', "AKIAABCDEFGHIJKLMN 0123456789abcdef", "é漢 Secret : 'Zz9+/_.=-Zz9abc' é deadbeefdeadbeefdeadbeef", "login=robert pwd=hunter22 https://example.com/x", "https://example.com/x alone", "pwd=hunter22 " + "x " * 400 + "login=robert", "token=api_key:abcdefghijklmnop"]
    texts += ["".join(p) for p in itertools.islice(itertools.product(["token=", "AKIA", "0f" * 9, '"', " ", "Zz9" * 5], repeat=3), 216)]
    got = {r.doc_id: r for r in secret_scan.scan(documents(spark, texts)).collect()}
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    for i, t in enumerate(texts):
        t = t or ""
        base = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[1]) >= 12]
        base += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        base += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        listed = [s for _, _, s in sorted(base)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for _, x, _ in base) for k in range(3))
        assert set(listed) <= set(got[i].spans.split(",")) | {""}
    assert {s.split(":")[0] for s in got[6].spans.split(",")} == {"ident", "weak", "endpoint"}
    assert got[7].spans == "" and got[8].spans == ""
    same = secret_scan.scan(documents(spark, ["secret=abcdefghijklmnop"] * 3, [1, 1, None])).collect()
    assert len(same) == 3 and {r.spans for r in same} == {"assign:0:23"}
    assert secret_scan.scan(documents(spark, ["x"]).where("false")).count() == 0


def test_weak_parts_against_all_pairs(spark):
    rng = np.random.default_rng(13)
    found = []
    for row in range(40):
        for _ in range(rng.integers(0, 12)):
            a = int(rng.integers(0, 2000))
            found.append((str(row), str(rng.choice([k for k, *_ in secret_scan.KINDS])), a, a + int(rng.integers(4, 300))))
    found = sorted(set(found))
    partners = {"ident": ("assign", "hex", "weak", "blob"), "endpoint": ("assign", "hex", "weak"), "weak": ("access", "ident", "endpoint"), "blob": ("access", "ident")}
    want = set()
    for row, kind, a, b in found:
        for other, what, c, d in found:
            if row == other and what in partners.get(kind, ()) and a - d <= 256 and c - b <= 256:
                want.add((row, kind, a, b))
    df = spark.createDataFrame(found, "row string, kind string, start long, end long")
    got = [tuple(r) for r in secret_scan.linked(df).collect()]
    assert set(got) == want and len(want) > 50 and len(want) < sum(k in partners for _, k, *_ in found)


def test_many_equal_rows_and_a_long_text(spark):
    many = documents(spark, [None] * 300 + [""] * 300 + ["x " * 2_000_000 + "token=abcdefghijklmnop"], [None] * 600 + [1])
    got = secret_scan.scan(many).collect()
    assert len(got) == 601 and [r.spans for r in got if r.doc_id == 1] == ["assign:4000000:4000022"]


# ---- 5


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    comp = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) * den >= num * len(sets[a] | sets[b]):
            p, q = sorted((comp[a], comp[b]))
            comp = [p if c == q else c for c in comp]
    return [len(s) for s in sets], comp


@pytest.mark.parametrize("block", [20_000, 5])
def test_jaccard_components(spark, block):
    rng = np.random.default_rng(2)
    base = [[f"w{v}" for v in rng.integers(0, 500, n)] for n in (3, 7, 40, 40, 120)]
    texts = [None, "", "A b", "a B", "one"]
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(0, len(w))] = f"n{rng.integers(0, 9)}"
            texts.append(" ".join(w))
    texts += texts[5:9]
    n, comp = brute_components(texts, 4, 85, 100)
    got = {r.doc_id: r for r in jaccard_join.classes(documents(spark, texts), 4, 85, 100, block).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == n
    assert [got[i].component_id for i in range(len(texts))] == comp


@pytest.mark.parametrize("block", [20_000, 5])
def test_jaccard_links_of_all_distinct_sets(spark, block):
    rng = np.random.default_rng(11)
    texts = [None, "", "A b", "a B", "one"]
    for b in [[f"w{v}" for v in rng.integers(0, 500, n)] for n in (150, 250, 350)]:
        for _ in range(14):  # near copies, most of them similar to each other
            w = list(b)
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(0, len(w))] = f"n{rng.integers(0, 9)}"
            texts.append(" ".join(w))
    texts += texts[5:9]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset())
    want = {frozenset((a, b)) for a, b in itertools.combinations(set(sets) - {frozenset()}, 2) if 100 * len(a & b) >= 85 * len(a | b)}
    pairs, membership = jaccard_join.links(documents(spark, texts), 4, 85, 100, block)
    rows = membership.collect()
    node = {r.node: sets[r.doc_id] for r in rows if r.node is not None}
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    assert all(node.get(r.node, frozenset()) == sets[r.doc_id] and r.n_shingles == len(sets[r.doc_id]) for r in rows)
    got = [frozenset((node[r.a], node[r.b])) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 2 * len(set(sets))
    assert [x.count() for x in jaccard_join.links(documents(spark, texts).where("false"), 4, 85, 100)] == [0, 0]


def test_jaccard_of_odd_rows(spark, odd):
    assert jaccard_join.classes(odd.where("false"), 4, 85, 100).count() == 0
    got = jaccard_join.classes(documents(spark, ["a b c d e"] * 3 + [None], [None, None, 4, None]), 4, 85, 100).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got if r.n_shingles) == [(-1, 4), (-1, 4), (4, 4)]
    assert [r.component_id for r in got if not r.n_shingles] == [None]


# ---- 6


def test_url_rules_and_models(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7x?q#f", "x://com/en/", "http://foocom/en/", "https://b.net/de/?x", "https://example.net/de/8", "https://c.org/es/1/2#t", "https://c.org", "u://q/p?a://b"]
    urls += [f"https://s{i}.com/en/{i}" for i in range(40)] + [f"https://k.example.com/en/7{i}" for i in range(40)]
    df = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (3, 4, 6, 7, 8)] == [("a.example.com", "/en/7x", "example.com/en/7", "allow"), ("com", "/en/", "com/en/", "block"), ("b.net", "/de/", "net/de/", "block"), ("example.net", "/de/8", "example.net/de/8", "block"), ("c.org", "/es/1/2", "org/es/", "block")]
    assert got[5].rule is None and (got[10].host, got[10].path) == ("q", "/p") and (got[0].host, got[0].path, got[2].host) == ("", "", "")
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    learnt = [r.llr for r in got.values() if r.rule == "example.com/en/7"]
    assert min(learnt) > max(r.llr for r in got.values() if r.rule == "com/en/")
    assert url_filter.judge(df.where("false")).count() == 0
    assert url_filter.judge(df.where("page_id < 3")).where("verdict = 'allow'").count() == 3


def test_url_rules_say_what_their_contract_lists(spark, tmp_path):
    listed = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert dict(url_filter.RULES) == listed and len(url_filter.RULES) == len(listed)
    urls = [f"https://{sub}{rule}{end}" for rule in listed for sub in ("", "A.b.") for end in ("", "9/x?q#f")]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.op6_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: (rule, listed[rule]) for i, rule in enumerate(r for r in listed for _ in range(4))}


def test_urls_are_parsed_as_by_hand(spark):
    rng = np.random.default_rng(14)
    bits = ["http", "://", "a.COM", "example.com", "EXAMPLE.net", "org", ".", "/en/", "/de/8", "/es/", "7", "?q=", "#f", "/", "é", ":", "İ.com"]
    urls = ["".join(rng.choice(bits, rng.integers(1, 7))) for _ in range(1500)]
    df = spark.createDataFrame([(i % 1400 if i % 7 else None, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict if r.rule else "") for r in url_filter.judge(df).collect())
    want = []
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if "://" in u else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "")
        want.append((str(i % 1400 if i % 7 else None), host, path, str(rule), verdict))
    assert got == sorted(want)


def test_url_models_tell_held_out_rows_apart(spark):
    got = url_filter.judge(C.table(spark, SF.replace("0.001", "0.1"), "pages")).where("held").select("rule", "llr", "threshold").toPandas()
    allowed = got.rule == "example.com/en/7"
    right = (got.llr >= got.threshold) == allowed
    assert len(got) > 100 and right[allowed].mean() > 0.8 and right[~allowed].mean() > 0.8, (right[allowed].mean(), right[~allowed].mean())


def test_url_models_count_every_context_by_itself(spark):
    rng = np.random.default_rng(9)
    parts = ["".join(chr(97 + v) for v in rng.integers(0, 26, 30)) for _ in range(1500)]
    urls = [f"https://{p[:8]}.{('com/en/', 'example.com/en/7', 'org/fr/')[i % 3]}{p[8:]}" for i, p in enumerate(parts)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    counts = [{}, {}]
    texts = [u.removeprefix("https://").encode() for u in urls]

    def grams(t):
        padded = bytes(url_filter.ORDERS) + t + b"\1"
        for i in range(url_filter.ORDERS, len(padded)):
            yield [(padded[i - k : i], padded[i]) for k in range(url_filter.ORDERS)]

    for i, t in enumerate(texts):
        if i % 3 < 2 and zlib.crc32(t) % 5:
            for key in itertools.chain(*grams(t)):
                for x in (key, key[0]):
                    counts[i % 3][x] = counts[i % 3].get(x, 0) + 1
    for i, t in enumerate(texts):
        llr = 0
        for own in grams(t):
            p = [1 / 256, 1 / 256]
            for key in own:
                p = [(c.get(key, 0) + url_filter.WEIGHT * q) / (c.get(key[0], 0) + url_filter.WEIGHT) for c, q in zip(counts, p, strict=True)]
            assert max(p) < 1
            llr += np.log(p[1] / p[0])
        assert got[i].llr == pytest.approx(llr / (len(t) + 1), abs=1e-9)


# ---- 7


def test_edits_keep_counts_right():
    cache, rng = C.word_cache(PATH), np.random.default_rng(4)
    alphabet = ["a", "Z", "é", "é", "İ", "漢", "字", "。", "'", "'s", "'S", " ", "\n", "5", ".", "--", "<|endoftext|>", "<", "|", ">", "\u00a0", "ᄀ", "ᅡ", "<|", "endoftext", "|>"]
    mixed = ["".join(rng.choice(alphabet, n)) for n in (40, 700, 3000, 9000)]
    for t in ["", "a", "word, " * 700, "don't é́ x1y2 " * 200, "漢字。" * 3000, "漢" * 3000, *mixed]:
        tree, text = token_counts.CountTree(t.encode(), cache), t.encode()
        for turn in range(25):
            a = int(rng.integers(0, len(text) + 2))
            b = a + int(rng.integers(0, (900, 4)[turn % 2]))
            new = ["", "zz", " q ", "ab cd " * 200, "".join(rng.choice(alphabet, 3)), "".join(rng.choice(alphabet, 900))][rng.integers(0, 6)].encode()
            ends = [max(0, min(x, len(text))) for x in (a, b)]
            ends = [next(x for x in range(e, len(text) + 1) if x == len(text) or text[x] & 0xC0 != 0x80) for e in ends]
            text = text[: ends[0]] + new + text[ends[1] :]
            tree.edit(a, b, new)
            assert tree.text() == text and tree.tokens == len(encoded(text.decode(), 0)) - 1
            heights = [x for x in token_counts.leaves_of(tree.root)]
            assert (tree.root.height if tree.root else 0) <= 2 * np.log2(len(heights) + 2)


def test_edits_encode_little_even_without_white_space():
    cache = C.word_cache(PATH)
    for t in ("漢字、" * 40_000, "word " * 200_000, "1" * 100_000):
        tree = token_counts.CountTree(t.encode(), cache)
        tree.encoded = 0
        for at in (0, 5000, tree.size // 2, tree.size):
            tree.edit(at, at + 9, " new。".encode())
        assert tree.encoded < 12_000 and tree.tokens == len(encoded(tree.text().decode(), 0)) - 1


def test_edits_by_a_table(spark, odd):
    trees = C.staged(token_counts.build_trees(odd, PATH), "trees")
    got = token_counts.apply_edits(odd, trees, token_counts.sample_edits(trees), PATH).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(encoded(t, 0)) - 1 for t in [*TEXTS, "no id"])
    for r in got:
        text = ("no id" if r.doc_id is None else TEXTS[r.doc_id] or "").encode()
        n = len(text)
        spots = [(n * (2 * k + 1) // 7 + (r.doc_id or 0) * 31) % (n + 1) for k in range(3)]
        for at, length, new in zip(spots, (11, 0, 40), (b"revised", b" inserted passage, ", b""), strict=True):
            ends = [max(0, min(x, len(text))) for x in (at, at + length)]
            ends = [next(x for x in range(e, len(text) + 1) if x == len(text) or text[x] & 0xC0 != 0x80) for e in ends]
            text = text[: ends[0]] + new + text[ends[1] :]
        assert (r.n_bytes, r.n_edits, r.n_bytes_after, r.n_tokens_after) == (n, 3, len(text), len(encoded(text.decode(), 0)) - 1)
    long = next(r for r in got if r.doc_id == 5)
    assert long.bytes_reencoded < long.n_bytes / 5
    kept = token_counts.apply_edits(odd, trees, token_counts.sample_edits(trees).where("false"), PATH).collect()
    assert all((r.n_tokens, r.n_edits, r.bytes_reencoded) == (r.n_tokens_after, 0, 0) for r in kept) and len(kept) == len(TEXTS) + 1
    direct = token_counts.count_edited(odd, PATH).collect()
    assert sorted(map(str, direct)) == sorted(map(str, got))
    docs = C.table(spark, SF, "documents").where("doc_id < 60")
    whole = {r.doc_id: r for r in token_counts.count_edited(docs, PATH).collect()}
    assert all(whole[r.doc_id].n_tokens == len(encoded(r.text, 0)) - 1 for r in docs.collect())
    empty = odd.where("false")
    none = token_counts.build_trees(empty, PATH)
    assert token_counts.apply_edits(empty, none, token_counts.sample_edits(none), PATH).count() == 0
    twice = odd.unionAll(odd)
    trees = C.staged(token_counts.build_trees(twice, PATH), "trees")
    assert token_counts.apply_edits(twice, trees, token_counts.sample_edits(trees), PATH).count() == 2 * len(got)


# ---- 8


def best_windows(s, text):
    """Of each template whose best window reaches the threshold, (Dice, first bigram, bigrams), from all windows."""
    n = [s.vocabulary[w] for w in text.encode().split()]
    n = [x for x in n if x >= 0]
    g, out = [a * s.base + b for a, b in itertools.pairwise(n)], {}
    for k, (_, template) in enumerate(s.templates):
        size = sum(template.values())
        for i, j in itertools.combinations(range(len(g) + 1), 2):
            shared = sum((license_scan.Counter(g[i:j]) & template).values())
            d = 2 * shared / (j - i + size)
            if shared and d >= s.least and d > out.get(k, (0,))[0]:
                out[k] = d, i, j - i
    return out


def test_licence_windows_against_all_windows(spark, odd):
    s = license_scan.Scanner(license_scan.GRANTS)
    texts = ["Released under the MIT License.", "xx Licensed under CC BY-NC 4.0. yy", "this work is licensed under the gnu general public license version 3", "Licensed under the Apache Licence, Version 2.0", "nothing here at all", "", "MIT " * 20]
    for t in texts:
        got = {k: x for k, *x in s.windows(s.numbers(t.encode()))}
        assert {k: d for k, (d, *_) in got.items()} == {k: d for k, (d, *_) in best_windows(s, t).items()}
    assert license_scan.scan_documents(odd).count() == 0
    assert license_scan.scan_documents(documents(spark, texts)).count() >= 3
    twice = license_scan.scan_documents(documents(spark, [texts[0], texts[0]], [5, None])).collect()
    assert sorted((str(r.doc_id), r.license) for r in twice) == [("5", "MIT"), ("None", "MIT")]
    assert license_scan.scan_documents(documents(spark, texts).where("false")).count() == 0


def test_licence_passages_of_all_sizes():
    s = license_scan.Scanner()
    got = s.scan(b"Licensed under the MIT License, see the file for more. " + b"other words " * 20)
    assert got[0][:2] == ("MIT", 1.0)
    short = license_scan.Scanner((("MIT", "Released under the MIT License."), ("rep", "a b a b a c")))
    assert short.scan(b"Licensed under the MIT License, see the file for more.") == [("MIT", 6 / 7, 1, 4)]
    rng = np.random.default_rng(10)
    for _ in range(150):
        words = [("released", "under", "the", "mit", "license", "x"), ("a", "b", "c", "x")][rng.integers(0, 2)]
        text = " ".join(rng.choice(words, rng.integers(0, 25)))
        got = {k: d for k, d, *_ in short.windows(short.numbers(text.encode()))}
        assert got == {k: d for k, (d, *_) in best_windows(short, text).items()}


GPL_NOTICE = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."


@pytest.mark.parametrize(
    ("text", "licences"),
    [
        (GPL_NOTICE, ["GPL-2.0"]),
        (GPL_NOTICE.replace("version 2", "version 3"), ["GPL-3.0"]),
        (GPL_NOTICE.replace("GNU General", "GNU Lesser General").replace("version 2", "version 2.1").replace("program", "library"), ["LGPL-2.1"]),
        (GPL_NOTICE.replace("GNU General", "GNU Affero General").replace("version 2", "version 3"), ["AGPL-3.0"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
        ("Licensed under CC BY-ND 4.0. Else", ["CC-BY-ND-4.0"]),
        ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("Licensed under the Apache License, Version 1.1.", []),
        ("The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.", ["MIT"]),
        ("Licensed under CC BY 4.0. " + "words " * 30 + "Licensed under CC BY-NC 4.0.", ["CC-BY-4.0", "CC-BY-NC-4.0"]),
    ],
)
def test_the_best_template_and_its_decisive_words_decide(text, licences):
    s = license_scan.Scanner()
    for t in (text, "Some words first. " + text + " And some after it."):
        assert [x[0] for x in s.scan(t.encode())] == licences


def test_whole_licence_texts_are_found():
    s = license_scan.Scanner()
    texts = [(name, t) for name, t in license_scan.TEMPLATES if len(t) > 500]
    assert {"MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "Unlicense"} <= {name for name, _ in texts}
    for name, t in texts:
        w = t.split()
        assert name in (found := [x[0] for x in s.scan(("before " * 50 + " ".join(w) + " after" * 50).encode())])
        assert len(t) > 5000 or found == [name]
        del w[:: len(w) // 10]
        assert name in {x[0] for x in s.scan(("before " * 50 + " ".join(w) + " after" * 50).encode())}
        assert s.scan(" ".join(w[: len(w) // 2 : 3]).encode()) == []


# ---- 9


@pytest.mark.parametrize("limits", [(64, 8, 64), (64, 8, 40), (16, 100, 16)])
def test_packer_keeps_all_limits(limits):
    rng = np.random.default_rng(3)
    p, out, sizes = packing.Packer(*limits), [], {}
    for i in range(300):
        n = int(rng.choice([1, 2, 3, 30, 63, 64, 65, 200]))
        sizes[i] = n, int(rng.integers(0, n + 1))
        out += p.add(packing.Example(i, 0, n, n - sizes[i][1]))
    out += list(p.pack(False)) + list(p.pack(True))
    for i, (n, _) in sizes.items():
        own = sorted((s, m) for k, s, m, _, _ in out if k == i)
        assert sum(m for _, m in own) == n and all(a + m == b for (a, m), (b, _) in zip(own, own[1:], strict=False))
    for q in {r[3] for r in out}:
        own = sorted((o, m, k, s) for k, s, m, x, o in out if x == q)
        total = sum(m for _, m, _, _ in own)
        assert [o for o, *_ in own] == [sum(m for _, m, _, _ in own[:j]) for j in range(len(own))]
        assert len(own) <= limits[1] and sum(max(0, s + m - max(s, sizes[k][0] - sizes[k][1])) for _, m, k, s in own) <= limits[2]
        assert total == limits[0] or total & (total - 1) == 0


def plain_packing(sizes, tokens, segments, loss, turn, prompt):
    """The dot-product rule by plain loops over all examples: the pieces (key, start, length) of each sequence in turn."""
    bears = lambda key, i: i % turn >= prompt
    left, out = {k: [0, n] for k, n in enumerate(sizes)}, []

    def front(k, most, room):
        a, b = left[k]
        n = 0
        while a + n < b and n < most and (room > 0 or not bears(k, a + n)):
            room -= bears(k, a + n)
            n += 1
        return n

    for k in left:
        while front(k, tokens, loss) == tokens:
            out.append([(k, left[k][0], tokens)])
            left[k][0] += tokens
    left = {k: x for k, x in left.items() if x[0] < x[1]}
    while left:
        room, now = [tokens, segments, loss], []
        while left and room[0] and room[1]:
            best = None
            for k, (a, b) in left.items():
                need = b - a, sum(bears(k, i) for i in range(a, b))
                if need[0] <= room[0] and need[1] <= room[2]:
                    dot = need[0] / tokens * (room[0] / tokens) + 1 / segments * (room[1] / segments) + need[1] / loss * (room[2] / loss)
                    if best is None or dot > best[0]:
                        best = dot, k, b - a
            if best is None:
                k = max(left, key=lambda k: left[k][1] - left[k][0])
                if not (n := front(k, room[0], room[2])):
                    k = max(left, key=lambda k: front(k, tokens, 0))
                    n = front(k, room[0], room[2])
                if not n:
                    break
                best = 0, k, n
            _, k, n = best
            a = left[k][0]
            now.append((k, a, n))
            room = [room[0] - n, room[1] - 1, room[2] - sum(bears(k, i) for i in range(a, a + n))]
            left[k][0] += n
            if left[k][0] == left[k][1]:
                del left[k]
        out.append(now)
    return out


def test_the_dot_product_chooses_and_all_limits_close_sequences():
    closed = packing.Counter()
    for seed in range(12):
        rng = np.random.default_rng(seed)
        sizes = rng.choice([1, 2, 5, 9, 30, 63, 64, 65, 200], 60).tolist()
        limits = (64, 6, (40, 44, 48)[seed % 3])
        sequences = []

        class Recorded(packing.Packer):
            def close(self, pieces):
                sequences.append(list(pieces))
                return super().close(pieces)

        p = Recorded(*limits)
        for i, n in enumerate(sizes):
            list(p.add(packing.Example(i, 0, n, 0, 16, 4)))
        list(p.pack(True))
        closed += p.closed
        assert sequences == plain_packing(sizes, *limits, 16, 4)
    assert min(closed[k] for k in ("tokens", "segments", "loss")) > 10


def test_packed_documents(spark, odd):
    got = packing.pack_documents(odd, PATH, 2).collect()
    for i, t in [*enumerate(TEXTS), (None, "no id")]:
        ids, at = encoded(t, 2), 0
        for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    assert packing.pack_documents(odd.where("false"), PATH, 2).count() == 0
    twice = packing.pack_documents(odd.unionAll(odd), PATH, 2)
    assert twice.agg(F.sum("length")).first()[0] == 2 * sum(r.length for r in got)


def test_packed_table_keeps_the_contract(spark):
    got = packing.op9_packing(spark, SF.replace("0.001", "0.01")).toPandas()
    last = got.groupby("doc_id").agg({"length": "sum", "doc_tokens": "first"})
    assert (last.length == last.doc_tokens).all() and len(last) == C.table(spark, SF.replace("0.001", "0.01"), "documents").count()
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        ends = own.offset + own.length
        assert own.offset.iloc[0] == 0 and (own.offset.to_numpy()[1:] == ends.to_numpy()[:-1]).all()
        n = int(ends.iloc[-1])
        assert len(own) <= packing.SEGMENTS and n <= 4096 and n & (n - 1) == 0
        bears = sum(int((np.arange(a, a + m) % packing.TURN >= packing.PROMPT).sum()) for a, m in zip(own.start, own.length, strict=True))
        assert bears <= packing.LOSS


def test_packed_conversations_keep_the_loss_limit(spark):
    turns = {}
    for r in C.table(spark, SF, "conversations").orderBy("conv_id", "turn").limit(400).collect():
        turns.setdefault(r.conv_id, []).append(r.text or "")
    sizes, rows = {}, []
    for i, own in turns.items():
        text = " ".join(own)
        n, answer = len(encoded(text, 2)), len(encoded(own[-1], 2))
        sizes[i] = n, min(n, answer)
        rows.append((i, text, answer))
    sizes[-1] = len(encoded("all of it", 2)), len(encoded("all of it", 2))
    df = spark.createDataFrame([*rows, (-1, "all of it", None)], "doc_id long, text string, answer long").withColumn("none", F.lit(None)).coalesce(1)
    totals = []
    for bearing in ("answer", "none"):
        sequences = {}
        got = packing.pack_documents(df, PATH, 2, 512, 64, 48, bearing).collect()
        for r in got:
            n, some = sizes[r.doc_id][0], sizes[r.doc_id][0 if bearing == "none" else 1]
            assert r.doc_tokens == n
            now = sequences.setdefault(r.sequence_id, [0, 0])
            now[0] += r.length
            now[1] += max(0, r.start + r.length - max(r.start, n - some))
        assert sum(x for x, _ in sequences.values()) == sum(n for n, _ in sizes.values())
        assert all(x <= 512 and y <= 48 for x, y in sequences.values())
        totals.append(len(sequences))
        if bearing == "answer":
            assert max(x for x, _ in sequences.values()) > 48
    assert totals[0] < totals[1]


# ---- 10


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = rng.integers(1, 5, rng.integers(1, 9)), rng.integers(1, 5, rng.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def test_copies_are_found_and_clean_rows_left(spark, odd):
    rng = np.random.default_rng(7)
    items = [" ".join(f"b{v}" for v in rng.integers(0, 400, 30)) for _ in range(5)]
    clean = [" ".join(f"c{v}" for v in rng.integers(0, 400, 200)) for _ in range(5)]
    copies = [f"{c} {b}. {c}" for c, b in zip(clean, items, strict=True)]
    edited = []
    for b in items:
        w = b.split()
        w[5] = w[17] = "changed"
        del w[11]
        edited.append("Start " + " ".join(w).upper() + " end")
    bench = spark.createDataFrame([*((i, t) for i, t in enumerate(items)), (8, None), (9, "Two words"), (7, "..."), (None, items[0])], "item_id long, text string")
    df = documents(spark, [*clean, *copies, *edited, "two, WORDS!", "two words more", "two"])
    got = {(r.doc_id, r.item_id) for r in decontaminate.annotate(df, bench, ["doc_id"]).select("doc_id", F.inline("matches")).collect()}
    assert got == {(5 + i, i) for i in range(5)} | {(10 + i, i) for i in range(5)} | {(15, 9)}
    assert decontaminate.annotate(odd, bench, ["doc_id"]).where("size(matches) > 0").count() == 0
    assert decontaminate.annotate(odd, bench.where("false"), ["doc_id"]).count() == len(TEXTS) + 1


@pytest.mark.parametrize("every", [3, 4, 5])
def test_edited_copies_that_lack_most_seeds_are_found(spark, every):
    items = [" ".join(f"b{k}x{v}" for v in range(40)) for k in range(2)]
    edited = [" ".join(f"z{v}" if v % every == every - 1 else w for v, w in enumerate(b.split())) for b in items]
    clean = " ".join(f"c{v}" for v in range(300))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    # item 0 has an edited copy alone; of item 1 a few documents quote the copy's gaps, which makes those seeds the rarer ones
    texts = [f"{clean} {edited[0]} {clean}", *[f"{clean} {edited[1]} {clean}"] * 9, *(" ".join(items[1].split()[v - 1 : v + 2]) for v in range(every - 1, 39, every))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.annotate(documents(spark, texts), bench, ["doc_id"]).select("doc_id", F.inline("matches")).collect()}
    assert got == {(0, 0)} | {(i, 1) for i in range(1, 10)}


def test_recall_against_alignment_of_all_pairs(spark):
    """Items of all lengths, edited at random by a tenth to a third, among documents that share their common words."""
    rng = np.random.default_rng(12)
    common = [f"c{v}" for v in range(60)]
    word = lambda: str(rng.choice(common)) if rng.random() < 0.5 else f"r{rng.integers(0, 4000)}"
    items = [[word() for _ in range(n)] for n in (3, 4, 5, 6, 8, 9, 12, 20, 30, 45, 60) for _ in range(4)]
    texts = []
    for item in items:
        for share in (0.1, 0.2, 0.3, 0.35):
            w = []
            for x in item:
                kind = rng.random() / share
                w += [x] if kind >= 1 else [[f"n{rng.integers(0, 999)}"], [], [x, word()]][int(kind * 3)]
            texts.append([*(word() for _ in range(60)), *w, *(word() for _ in range(60))])
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    rows = decontaminate.annotate(documents(spark, [" ".join(t) for t in texts]), bench, ["doc_id"]).select("doc_id", F.inline("matches")).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in rows}
    number = {w: i for i, w in enumerate(sorted({w for t in texts + items for w in t}))}
    code = [[np.array([number[w] for w in t]) for t in own] for own in (texts, items)]
    want = {(d, i): s for d, t in enumerate(code[0]) for i, m in enumerate(code[1]) if (s := decontaminate.align(m, t)[0] / (2 * len(m))) >= decontaminate.LEAST}
    assert len(want) > 150 and set(got) <= set(want) and all(s <= want[k] for k, s in got.items())
    assert len(set(got)) >= 0.95 * len(want) and all(len(items[i]) < 8 for _, i in set(want) - set(got))


def test_items_of_very_many_words():
    rng = np.random.default_rng(1)
    big = " ".join(f"q{v}" for v in range(1 << 21))
    block = decontaminate.Block([(0, big), (1, "one two three four five")])
    n = next(block.numbers([b"x one two three four five y"], decontaminate.Vocabulary(block.known)))
    assert [m[0] for m in block.matches(n)] == [1]
    hashed = decontaminate.Block([(0, " ".join(f"w{v}" for v in rng.permutation(3000)))], seed=6)
    assert hashed.base**6 > 1 << 63
    n = next(hashed.numbers([" ".join(w.decode() for w in sorted(hashed.known, key=lambda w: list(hashed.words[0]).index(hashed.known[w]))).encode()], decontaminate.Vocabulary(hashed.known)))
    assert hashed.matches(n)[0][1] == 1.0


def test_bound_is_never_below_the_alignment():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = rng.integers(1, 6, rng.integers(3, 9)), rng.integers(0, 9, rng.integers(1, 30))
        assert decontaminate.bound(b, np.isin(np.arange(10), a)) >= decontaminate.align(a, b)[0]


# ---- pipeline


def test_pipeline_stage_by_stage(spark):
    docs = C.table(spark, SF, "documents")
    kept = {r.doc_id: r.text for r in docs.collect()}
    before, now = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = C.staged(stage(spark, before, SF), "test-stage")
        assert now.columns == list(C.DOCUMENT_COLUMNS)
        rows = {r.doc_id: r.text for r in now.collect()}
        gone = {k: v for k, v in kept.items() if k not in rows}
        assert rows and all(kept[k] == v for k, v in rows.items())
        if name.startswith("n-gram"):
            ids = sorted(kept)
            _, comp = brute_components([kept[i] for i in ids], 5, 80, 100)
            assert set(rows) == {ids[c] for c in comp}
        if name.startswith("secret"):
            assert not any(re.search("AKIA[A-Z0-9]{14}|[0-9a-f]{16}", t) for t in rows.values())
        if name.startswith("benchmark"):
            items = [r.text for r in C.table(spark, SF, "benchmark").collect()]
            assert not any(b in t for t in rows.values() for b in items)
            assert set(gone) <= set(kept)
        before, kept = now, rows
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d"))
    assert pieces.where("n <> d").isEmpty() and pieces.count() == len(kept)


def test_pipeline_of_odd_rows(spark, tmp_path):
    for n, rows, schema in (("documents", [(i, t, None, None, None, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long, score string"), ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{n}.parquet")
    docs = C.table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = C.staged(stage(spark, docs, str(tmp_path)), "odd")
    assert docs.select("doc_id").distinct().count() == len(TEXTS) - 1
    empty = C.table(spark, str(tmp_path), "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        empty = C.staged(stage(spark, empty, str(tmp_path)), "empty")
    assert empty.count() == 0


def test_a_light_task_leaves_no_memory_behind():
    def resident():
        return int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024

    held = []

    def run(batches):
        for batch in batches:
            list(C.word_hashes([b" ".join(b"w%d" % i for i in range(50_000))]))
            assert len(C._WORDS) >= 50_000
            some = [np.ones(8000) for _ in range(4000)]  # 256 MB in small pieces
            held.append(some[-1])  # which keeps the heap from shrinking by itself
            held.append(resident())
            yield batch

    assert list(C.light("test", run)(iter([1]))) == [1]
    assert not C._WORDS and not C._WORDS.old and resident() < held[1] - 150


@pytest.fixture
def full_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    old = [b for b in beans if re.search("Old|MarkSweep|MSC", b.getName())]
    return lambda: sum(b.getCollectionCount() for b in old)


def test_heaps_are_collected_by_driver_and_executors(spark, full_collections):
    before = full_collections()
    C.collect_heaps(spark)
    assert full_collections() >= before + 2  # in local mode both are one JVM


def test_every_pipeline_stage_begins_with_small_heaps(spark, full_collections):
    docs = C.table(spark, SF, "documents").limit(20)
    for _, stage in corpus_pipeline.STAGES:
        before = full_collections()
        stage(spark, docs, SF)
        assert full_collections() >= before + 2


def test_tasks_of_quality_and_decontamination_are_light(spark, monkeypatch):
    made = []
    for module in (quality, decontaminate):
        monkeypatch.setattr(module, "light", lambda kind, run: made.append(kind) or C.light(kind, run))
    docs = C.table(spark, SF, "documents")
    for _, stage in (corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[2]):
        stage(spark, docs, SF)
    assert made == ["units"] * 5 + ["seeds"] * 2
