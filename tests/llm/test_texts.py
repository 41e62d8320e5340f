"""Text operators against plain Python, other libraries or an exact round trip."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepgrid.llm import bpe, langid, mixing, ngram_join, queries, secrets, toxicity, webp


def pairs(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------------------------------------------------------- media
def test_media_round_trip(odd, empty):
    got = webp.digests(webp.store(odd))
    want = []
    for i, t in texts(odd):
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert pairs(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=repr)
    forms = {}
    for r in got.collect():
        assert forms.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    assert webp.digests(webp.store(empty)).count() == 0


@pytest.mark.parametrize("payload", [bytes(64), bytes(range(256)) * 4, b"ab" * 96, b"x" * 64 * 20_000, np.random.default_rng(1).bytes(64 * 999)])
def test_media_payloads(payload):
    stored = webp.encode_samples(payload)
    assert webp.decode_samples(stored)[0] == payload


def test_media_over_a_mebibyte(spark):
    rng = np.random.default_rng(8)
    noise, passage = rng.bytes(1 << 20), rng.bytes(4096)
    few = rng.integers(0, 200, 64 * 65539, np.uint8).tobytes()
    far = passage + noise[: (1 << 20) - 8192] + passage
    payloads = [noise + rng.bytes(1050304 - len(noise)), noise + bytes(64 * 3), few, far, far + passage * 2, passage + noise + noise + passage]
    for payload in payloads:
        data, sizes = webp.decode_samples(webp.encode_samples(payload))
        assert data == payload and all(w * h <= webp.STRIP for w, h in sizes)
    spread = noise[: (1 << 20) - 48]
    for data in (np.frombuffer(passage + spread + passage, np.uint8), np.frombuffer(passage + spread[:-8192] + passage, np.uint8)):
        assert all(webp.prefix_of(back + len(webp.NEAR))[0] < 40 for _, _, back in webp.repeats(data))
    assert len(webp.repeats(data)) == 1
    edge = rng.bytes(64) + noise[: (1 << 20) - 128]
    edge += edge[:64]
    assert webp.decode_samples(webp.encode_samples(edge))[0] == edge
    text = "".join(map(chr, rng.integers(32, 127, 1050304)))
    df = spark.createDataFrame([(1, text), (2, text[:100])], "doc_id long, text string")
    got = {r.doc_id: r.payload_sha256 for r in webp.digests(webp.store(df)).collect()}
    assert got[1] == hashlib.sha256(text.encode()).hexdigest() and len(got) == 2


def test_pixels_of_a_media_column(spark, odd, empty):
    w = header(3, 2)
    w.put(0, 1)
    argb = np.array([0xFF102030, 0x80FF0001, 0, 0xFFFFFFFF, 0x7F000000, 0x01020304])
    flat_image(w, argb, True)
    own, two = file_of(w), webp.encode_samples(b"ab" * 96)
    df = spark.createDataFrame([(1, bytearray(own), "x"), (2, bytearray(own + two), "y"), (3, None, "z")], "id long, media binary, more string")
    got = {r.id: [(i.width, i.height, [v & 0xFFFFFFFF for v in i.argb]) for i in r.images] for r in webp.pixels(df).collect()}
    second = (64, 3, [0xFF000000 | v << 8 for v in b"ab" * 96])
    assert got == {1: [(3, 2, argb.tolist())], 2: [(3, 2, argb.tolist()), second], 3: []}
    stored = webp.store(odd)
    read = webp.pixels(stored)
    assert read.columns == [*stored.columns, "images"] and webp.pixels(webp.store(empty)).count() == 0
    for r in read.collect():
        data, sizes = webp.decode_samples(bytes(r.media))
        assert [(i.width, i.height) for i in r.images] == sizes and bytes(v >> 8 & 255 for i in r.images for v in i.argb) == data


FLAT = {i: 8 for i in range(256)}


def flat_image(w, argb, main, cache_bits=0):
    """An image with eight-bit codes for every channel; with a cache, pixels that it holds are written as its entries."""
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    green = {i: 9 for i in range(280 + (1 << cache_bits if cache_bits else 0))}
    size = len(green)
    full = 1 << (size - 1).bit_length()
    green = {i: (full.bit_length() - 1) - (1 if i < full - size else 0) for i in range(size)}
    for code in (green, FLAT, FLAT, FLAT, {0: 0}):
        webp.write_code(w, code)
    g, c = webp.canonical(green), webp.canonical(FLAT)
    cache = [0] * (1 << cache_bits)
    for p in argb.tolist():
        slot = (webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if cache_bits and cache[slot] == p:
            w.put(*g[280 + slot])
        else:
            for code, s in ((g, 8), (c, 16), (c, 0), (c, 24)):
                w.put(*code[p >> s & 255])
        if cache_bits:
            cache[slot] = p


def file_of(w):
    body = w.bytes()
    pad = len(body) & 1
    return b"RIFF" + (12 + len(body) + pad).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + bytes(pad)


def header(width, height):
    w = webp.Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    return w


def split4(p):
    return [p >> s & 255 for s in (24, 16, 8, 0)]


def half(a, b):
    return (a + b) // 2


def guess(mode, left, top, tl, tr):
    """Predictors from the format's description, one channel after the other."""
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        to_left, to_top = sum(abs(t - x) for t, x in zip(top, tl)), sum(abs(a - x) for a, x in zip(left, tl))
        return left if to_left < to_top else top
    one = {
        0: None, 1: lambda a, t, x, r: a, 2: lambda a, t, x, r: t, 3: lambda a, t, x, r: r, 4: lambda a, t, x, r: x, 5: lambda a, t, x, r: half(half(a, r), t), 6: lambda a, t, x, r: half(a, x),
        7: lambda a, t, x, r: half(a, t), 8: lambda a, t, x, r: half(x, t), 9: lambda a, t, x, r: half(t, r), 10: lambda a, t, x, r: half(half(a, x), half(t, r)),
        12: lambda a, t, x, r: clamp(a + t - x), 13: lambda a, t, x, r: clamp(half(a, t) + int((half(a, t) - x) / 2)),
    }[mode]
    return [255, 0, 0, 0] if one is None else [one(*v) for v in zip(left, top, tl, tr)]


def test_decoder_inverts_every_predictor():
    rng, width, height = np.random.default_rng(3), 9, 60
    pixels = rng.integers(0, 1 << 32, width * height).tolist()
    modes = [k % 14 for k in range(-(-width // 4) * -(-height // 4))]
    left_over = []
    for i, p in enumerate(pixels):
        y, x = divmod(i, width)
        at = lambda k: split4(pixels[k])
        if i == 0:
            g = [255, 0, 0, 0]
        elif y == 0:
            g = at(i - 1)
        elif x == 0:
            g = at(i - width)
        else:
            g = guess(modes[(y >> 2) * 3 + (x >> 2)], at(i - 1), at(i - width), at(i - width - 1), at(i - width + 1))
        a, r, gr, b = ((v - k) & 255 for v, k in zip(split4(p), g))
        left_over.append(a << 24 | r << 16 | gr << 8 | b)
    w = header(width, height)
    for value, n in ((1, 1), (webp.PREDICTOR, 2), (0, 3)):
        w.put(value, n)
    flat_image(w, np.array([m << 8 for m in modes]), False)
    w.put(0, 1)
    flat_image(w, np.array(left_over), True)
    assert webp.decode(file_of(w))[2].tolist() == pixels


def test_decoder_inverts_colours_and_reads_the_cache():
    rng, width, height = np.random.default_rng(4), 16, 12
    pixels = rng.choice(rng.integers(0, 1 << 32, 20), width * height).tolist()
    red_by_green, blue_by_green, blue_by_red = 17, 200, 99
    signed = lambda v: v - 256 if v > 127 else v
    coded = []
    for p in pixels:
        a, r, g, b = split4(p)
        delta = lambda f, v: signed(f) * signed(v) >> 5
        b = (b - delta(blue_by_green, g) - delta(blue_by_red, r)) & 255
        r = (r - delta(red_by_green, g)) & 255
        r, b = (r - g) & 255, (b - g) & 255
        coded.append(a << 24 | r << 16 | g << 8 | b)
    w = header(width, height)
    for value, n in ((1, 1), (webp.CROSS_COLOUR, 2), (2, 3)):
        w.put(value, n)
    flat_image(w, np.array([255 << 24 | blue_by_red << 16 | blue_by_green << 8 | red_by_green]), False)
    w.put(1, 1)
    w.put(webp.SUBTRACT_GREEN, 2)
    w.put(0, 1)
    flat_image(w, np.array(coded), True, cache_bits=5)
    assert webp.decode(file_of(w))[2].tolist() == pixels


# ------------------------------------------------------------------------------------------------------------------ BPE
def test_bpe_equals_tiktoken(spark, odd, empty, sf):
    import tiktoken

    path, pattern = queries.tokenizer()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.vocabulary(path).ranks, special_tokens={})
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")):
        want = []
        for i, t in texts(df):
            ids = np.array(own.encode_ordinary(t), "<u4")
            want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
        assert pairs(bpe.round_trip(df, path, pattern), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    coded = bpe.encode(odd, path, pattern)
    assert pairs(bpe.decode(coded, path).select("doc_id", F.col("data").cast("string")), "doc_id", "data") == sorted(texts(odd), key=repr)
    assert bpe.round_trip(empty, path, pattern).count() == 0


def test_long_pieces_cost_little():
    v = bpe.vocabulary(queries.tokenizer()[0])
    for piece in (b"a" * 5000, b"ab" * 3001, b" " * 4096, bytes(range(128, 256)) * 9):
        ids = bpe.merge_one(piece, v)
        assert b"".join(v.bytes[i] for i in np.frombuffer(ids, "<u4").tolist()) == piece
    for n in range(1, 33):
        piece = b"nananabanana internationalisation"[:n]
        assert bpe.merge([piece], v) == [bpe.merge_one(piece, v)]


# -------------------------------------------------------------------------------------------------------------- secrets
def base_spans(text):
    out = []
    for k, (name, pattern, least, group) in enumerate((("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1), ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]+", 24, 0))):
        flags = re.IGNORECASE | re.ASCII if name == "assign" else 0
        out += [(m.start(), k, name, m.end()) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    return [f"{n}:{a}:{b}" for a, _, n, b in sorted(out)]


def test_secret_spans(spark, odd, empty, sf):
    more = [(1, "AKIA" + "A" * 15 + " AKIA" + "B" * 16), (2, "paſsword=abcdefgh toKen = 'abcdef' APIKEY:=x secret=short apikey=" + "f" * 30), (3, "🙂 token=abcdef1 🙂 " + "0" * 23 + " " + "0" * 24), (4, "password: password: abcdef1"), (5, "api_key api_key=qwerty12")]
    tables = [odd, spark.createDataFrame(more, "doc_id long, text string").withColumn("source", F.lit("s")), spark.read.parquet(f"{sf}/documents.parquet")]
    for df in tables:
        got = secrets.report(secrets.scan(df))
        want = []
        for i, t in texts(df):
            s = base_spans(t)
            n = Counter(x.split(":")[0] for x in s)
            want.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(s).encode()).hexdigest()))
        assert pairs(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want, key=repr)
    assert secrets.report(secrets.scan(empty)).count() == 0


def test_ownership_separates_examples_from_credentials(spark):
    rows = [(i, "password=correcthorse77 ok", f"owner{i % 4}") for i in range(8)] + [(100, "token=Zx81kQp7Lw22 here", "owner0"), (101, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: (r.n_example, r.n_live) for r in secrets.report(secrets.scan(df)).collect()}
    assert found[0] == (1, 0) and found[100] == (0, 1) and found[101] == (0, 0)
    out = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert out[0] == "password=correcthorse77 ok" and out[100] == "[SECRET] here" and out[101] is None and len(out) == 10


def private_key(seed, width=64, kind="RSA ", end=True, line="\n"):
    body = base64.b64encode(np.random.default_rng(seed).bytes(600)).decode()
    lines = [body[i : i + width] for i in range(0, len(body), width)]
    return line.join([f"-----BEGIN {kind}PRIVATE KEY-----", *lines, *([f"-----END {kind}PRIVATE KEY-----"] if end else [])])


def test_private_keys_are_whole_values(spark):
    jwt = "eyJ" + "hA" * 2000 + ".eyJ" + "z9" * 3000 + "." + "sig_-" * 700
    rows = [(i, f"before {private_key(i)} after", f"owner{i}") for i in range(6)]
    rows += [(10 + i, "copied " + private_key(99, width=(64, 32, 70)[i % 3]) + "\n", f"owner{i}") for i in range(4)]
    cut = {
        20: "x\n" + private_key(20, end=False) + "\nand so on, in words", 21: private_key(21, end=False)[:-5], 22: f'{{"k": "{private_key(22, line=chr(92) + "n")}", "n": 1}}',
        23: "Y " + private_key(23).replace("KEY-----\n", "KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A\n\n", 1) + " Z", 24: private_key(24, end=False) + "\n" + private_key(25), 25: "auth " + jwt + " end",
        26: "t ghp_" + "aB3" * 120 + " u", 27: "t xoxb-" + "12-ab" * 100 + " u", 28: "-----BEGIN PRIVATE KEY-----\nMIIabc\nDEF=\nmore of it", 29: "eyJ" * 100_000,
    }
    want = {
        20: "x\n[SECRET]\nand so on, in words", 21: "[SECRET]", 22: '{"k": "[SECRET]", "n": 1}', 23: "Y [SECRET] Z", 24: "[SECRET]\n[SECRET]", 25: "auth [SECRET] end",
        26: "t [SECRET] u", 27: "t [SECRET] u", 28: "[SECRET]\nmore of it", 29: cut[29],
    }
    rows += [(i, t, "owner0") for i, t in cut.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: (r.n_example, r.n_live) for r in secrets.report(secrets.scan(df)).collect()}
    assert all(found[i] == (0, 1) for i in range(6)) and all(found[10 + i] == (1, 0) for i in range(4))
    out = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert all(out[i] == "before [SECRET] after" for i in range(6)) and all(out[10 + i] == rows[6 + i][1] for i in range(4))
    assert {i: out[i] for i in cut} == want


def test_entropy_reads_the_whole_value(spark):
    values = ["a" * 300 + "".join(f"{i * 7919 % 3600:x}Zq" for i in range(300)), "a" * 5000 + "b", "ab" * 400, "aabbcdef", "", "Zx81kQp7Lw22"]
    want = [-sum(n / len(v) * np.log2(n / len(v)) for n in Counter(v).values()) for v in values]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, v string")
    assert [r.b for r in df.select("doc_id", secrets.bits(F.col("v")).alias("b")).orderBy("doc_id").collect()] == pytest.approx(want)
    docs = df.select("doc_id", F.concat(F.lit("token="), "v").alias("text"), F.lit("s").alias("source"))
    found = {r.doc_id: r.n_live for r in secrets.report(secrets.scan(docs)).collect()}
    assert [found[i] for i in range(6)] == [1, 0, 0, 1, 0, 1]


def test_owners_are_counted_in_the_corpus_too(spark):
    """A value that copies outside ``docs`` show to be an example stays."""
    rows = [(i, "password=correcthorse77 ok", f"owner{i}") for i in range(4)] + [(9, "token=Zx81kQp7Lw22 here", "owner0")]
    corpus = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = corpus.filter("doc_id in (0, 9)")
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == {0: "[SECRET] ok", 9: "[SECRET] here"}
    assert {r.doc_id: r.text for r in secrets.redact(docs, corpus=corpus).collect()} == {0: "password=correcthorse77 ok", 9: "[SECRET] here"}


def test_redaction_keeps_rows_and_columns(odd):
    out = secrets.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert pairs(out.filter("doc_id = 1"), *odd.columns) == pairs(odd.filter("doc_id = 1"), *odd.columns)


# --------------------------------------------------------------------------------------------------------------- mixing
def mix_rules(df):
    got = [r.asDict() for r in mixing.taken(mixing.mix(df)).collect()]
    assert sorted(map(repr, got)) == sorted(repr(r.asDict()) for r in mixing.taken(mixing.mix(df)).collect())
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((i or -1, size(t)) for i, t in texts(df))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    return got


def test_mix(spark, odd, empty, sf):
    mix_rules(odd)
    assert mixing.taken(mixing.mix(empty)).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in mix_rules(docs)}
    by = {}
    for r in docs.select("doc_id", "source").collect():
        by.setdefault(r.source, []).append(got[r.doc_id])
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = mixing.targets([sum(r["size"] for r in by[s]) for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    for s, t in zip(order, want):
        taken = sum(r["taken"] for r in by[s])
        assert by[s][0]["target"] == pytest.approx(t) and abs(taken - t) < max(200, 0.01 * t)


def test_mix_equals_a_replay_of_its_slots(spark, odd, sf):
    """``taken`` from every slot's block, one after the other, in plain Python."""
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        mixed = mixing.mix(df)
        docs, slots = [r.asDict() for r in mixed.docs.collect()], [r.asDict() for r in mixed.slots.collect()]
        by = {}
        for d in docs:
            by.setdefault(d["src"], []).append(d)
        drawn = {}
        for x in slots:
            drawn.setdefault(x["src"], []).append(x)
        taken = Counter()
        for src, ds in by.items():
            ds = sorted((d for d in ds if d["size"]), key=lambda d: d["start"])
            starts = [d["start"] for d in ds]
            assert starts == list(itertools.accumulate([0, *(d["size"] for d in ds)]))[:-1]
            blocks = -(-sum(d["size"] for d in ds) // mixing.BLOCK)
            own = drawn.get(src, [])
            assert sorted(x["slot"] for x in own) == list(range(len(own))) and all(0 <= x["block"] < blocks and x["pass"] == x["slot"] // blocks for x in own)
            assert len({(x["pass"], x["block"]) for x in own}) == len(own)
            for x in own:
                low, high = x["block"] * mixing.BLOCK, (x["block"] + 1) * mixing.BLOCK
                for d in ds[max(0, np.searchsorted(starts, low, "right") - 1) :]:
                    if d["start"] >= high:
                        break
                    taken[d["key"], d["start"]] += max(0, min(high, d["start"] + d["size"]) - max(low, d["start"]))
        want = sorted((repr(d["doc_id"]), d["size"], d["source_size"], d["target"], taken[d["key"], d["start"]] if d["size"] else 0) for d in docs)
        assert sorted((repr(r.doc_id), r["size"], r.source_size, r.target, r.taken) for r in mixing.taken(mixed).collect()) == want


def test_targets_share_the_excess():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([200, 166.6666667, 83.3333333])
    assert mixing.targets([10, 0], [1, 1]) == pytest.approx([15, 0]) and mixing.targets([0], [1]) == [0]


def test_mixed_documents_keep_columns_and_words(odd):
    mixed = mixing.mix(odd)
    out = mixing.mixed_documents(odd, mixed)
    assert out.columns == odd.columns
    assert {r.v for r in out.select("v").collect()} == {"v"}


def test_permutation_is_one():
    for n in (1, 2, 5, 64, 1000):
        got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 7))
        assert sorted(got.tolist()) == list(range(n))


# ---------------------------------------------------------------------------------------------------------- n-gram join
def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    different = sorted({t for _, t in rows})
    sets = [shingles(t) for t in different]
    parent, links = list(range(len(different))), [0] * len(different)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 5 * (n := len(a & b)) >= 4 * (len(a) + len(b) - n):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    number = {t: root(i) for i, t in enumerate(different)}
    ids: dict = {}
    for i, t in rows:
        if i is not None:
            ids[number[t]] = min(ids.get(number[t], i), i)
    copies = Counter(t for _, t in rows)
    at = {t: i for i, t in enumerate(different)}
    return sorted(((i, ids.get(number[t]), links[at[t]], copies[t]) for i, t in rows), key=repr)


def planted(spark):
    """Groups of near copies of very different sizes, one of them with chains, and frequent words."""
    rng = np.random.default_rng(5)
    rows = []
    for size, words in ((400, 60), (3, 30), (2, 200), (40, 12), (1, 5)):
        base = [f"w{x}" for x in rng.integers(0, 3000, words)]
        for k in range(size):
            own = list(base)
            if k:
                own[int(rng.integers(0, words))] = f"x{k % 9}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, " ".join(["common"] * 30 + [f"own{i}"] * (1 + i % 4))) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("which", ["odd", "planted", "tables"])
def test_join_equals_brute_force(spark, odd, sf, which):
    df = {"odd": lambda: odd, "planted": lambda: planted(spark), "tables": lambda: spark.read.parquet(f"{sf}/documents.parquet")}[which]()
    got = pairs(ngram_join.join(df), "doc_id", "class_id", "n_links", "n_copies")
    assert got == brute_classes(texts(df))


def test_one_of_each_class_stays(odd, empty):
    out = ngram_join.keep_one(odd)
    assert out.columns == odd.columns
    classes = {c for _, c, _, _ in brute_classes(texts(odd)) if c is not None}
    assert sorted(r.doc_id for r in out.collect()) == sorted(classes)
    assert ngram_join.keep_one(empty).count() == 0 and ngram_join.join(empty).count() == 0


# ---------------------------------------------------------------------------------------------------------- classifiers
def held_out_of(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_language_id(spark, sf).collect()}
    right = [got[r.doc_id].lang_pred == r.lang for r in docs.select("doc_id", "lang").filter("lang is not null").collect() if held_out_of(r.doc_id)]
    assert len(got) == docs.count() and np.mean(right) > 0.95
    assert all(r.held_out == held_out_of(i) and 0 <= r.score <= 1 for i, r in got.items())


def test_language_equals_a_plain_count(spark, odd, sf):
    """Counts, weights and cosines letter by letter in plain Python, against the model's centroids."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    learned = [r.text for r in docs.select("doc_id", "lang", "text").collect() if not held_out_of(r.doc_id) and r.lang is not None and r.text is not None]

    def counted(text):
        data = [32, 32] + [int(langid._FOLD[b]) for b in text.lower().encode("utf-8", "surrogatepass")] + [32, 32]
        bins = Counter(int(langid._HASH[0][a] ^ langid._HASH[1][b] ^ langid._HASH[2][c]) for a, b, c in zip(data, data[1:], data[2:]))
        bins.pop(langid._BLANK, None)
        return bins

    df = Counter(b for t in learned for b in counted(t))
    assert [max(0.0, math.log((len(learned) + 1) / (df[b] + 0.5))) for b in range(langid.BINS)] == pytest.approx(model.idf.tolist(), abs=1e-5)
    for table in (docs, odd):
        got = {}
        for r in langid.predict(table, model).collect():
            got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
        for i, t in texts(table):
            v = {b: math.log1p(n) * float(model.idf[b]) for b, n in counted(t).items()}
            norm = math.sqrt(sum(x * x for x in v.values())) or 1
            cosine = [sum(x * float(c[b]) for b, x in v.items()) / norm for c in model.centroids]
            by = [max(0.0, max(c for c, o in zip(cosine, model.owner) if o == k)) for k in range(len(model.langs))]
            known = any(c.isalpha() for c in t)
            top = max(by) if known else 0.0
            near = {m for m, x in zip(model.langs, by) if x > top - 1e-4} if known else {langid.UNKNOWN}
            assert any(lang in near and abs(score - top) < 1e-4 for lang, score in got[i]), i


def test_language_of_odd_rows(odd, empty):
    found = langid.predict(odd, langid.train(odd))
    for r in found.join(odd.select("doc_id", "text").filter("text is null or trim(text) in ('', '1 2 3 4 5')"), "doc_id").collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert found.count() == odd.count()
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.train(empty)).collect()} == {"und"}
    kept = langid.keep_known(odd, langid.train(odd))
    assert kept.columns == odd.columns and kept.filter("text is null or text = ''").count() == 0


def test_toxicity_on_held_out_rows(spark, sf):
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op2_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    known = [(r.predicted, label[r.doc_id]) for r in got if r.held_out and label.get(r.doc_id) is not None]
    assert np.mean([a == b for a, b in known]) > 0.9
    assert all(r.held_out == held_out_of(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_viterbi_equals_all_paths(spark, sf):
    model = toxicity.log_model(toxicity.trigram_counts(spark.read.parquet(f"{sf}/documents.parquet").select("text")))

    def cost(choice):
        a = b = 0
        score = 0.0
        for letters, paid in choice:
            score -= paid
            for c in letters:
                z = toxicity._SYMBOL.get(c, toxicity.SYMBOLS - 1)
                score, a, b = score + float(model[a, b, z]), b, z
        return score + float(model[a, b, 0])

    for span in ("1d10t", "a$$", "h3ll0!", "k.i.l.l", "s  t o p", "looooser", "b@d", "5tup1d", "(x)", "***", "st00", "f*ck", "i d i o t"):
        scored = [(cost(c), "".join(x for x, _ in c)) for c in itertools.product(*toxicity.options(span))]
        best = max(s for s, _ in scored)
        assert toxicity.viterbi(span, model) in {w for s, w in scored if s > best - 1e-4}, span


def test_toxicity_equals_a_plain_count(spark, sf, odd):
    """Stems, evidence and score word by word in plain Python, from the model's tables."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    chances = dict(zip(model.bins.tolist(), model.chances.tolist()))
    restorer, bins = toxicity.Restorer(model.characters), {}

    def chance(stem):
        if stem not in bins:
            spans = toxicity.Spans(np.frombuffer(stem, np.uint8))
            bins[stem] = int(spans.hash(np.array([0]), np.array([len(stem)]))[0] >> np.uint64(64 - toxicity.STEM_BITS))
        return chances.get(bins[stem], 0.0)

    for table in (docs, odd):
        got = {}
        for r in toxicity.score(table, model).collect():
            got.setdefault(r.doc_id, []).append((r.score, r.predicted))
        for i, t in texts(table):
            restored = restorer.restored([t.lower().encode()])[0].tobytes()
            words = re.findall(rb"[a-z\x80-\xff]+", restored)
            each = [max(map(chance, {w, *(w[:n] for n in toxicity.PREFIXES if len(w) > n)})) for w in words]
            worst = max([0.01, *each])
            x = [1, math.log(worst / (1 - worst)), math.log1p(sum(c > 0 for c in each)), math.log1p(sum(c >= np.float32(0.7) for c in each)), math.log1p(len(words))]
            score = 1 / (1 + math.exp(-min(40, max(-40, sum(a * b for a, b in zip(x, model.weights))))))
            assert any(abs(g - score) < 1e-6 and p == int(g >= 0.5) for g, p in got[i]), i


def test_disguised_words_are_restored(spark):
    df = spark.createDataFrame([("you are a stupid moron idiot stupid moron idiot",)] * 50, "text string")
    model = toxicity.log_model(toxicity.trigram_counts(df))
    for word in ("stup1d", "m0ron", "1d10t", "stuuuupid", "$tupid"):
        want = {"1d10t": "idiot", "m0ron": "moron"}.get(word, "stupid")
        assert toxicity.viterbi(word, model) == want
    restored, _ = toxicity.Restorer(model).restored(["i d i o t you".encode(), b"m o r o n"])
    assert b"idiot" in restored.tobytes() and b"moron" in restored.tobytes()


def test_spaced_sentences_are_restored_whole(spark):
    df = spark.createDataFrame([("you are an idiot and a stupid ass too",)] * 200, "text string")
    model = toxicity.log_model(toxicity.trigram_counts(df))
    restored = lambda t: toxicity.Restorer(model).restored([t.encode()])[0].tobytes().decode()[len(t) + 1 :]
    spaced = lambda t, gap=" ", wide="  ": wide.join(gap.join(w) for w in t.split())
    sentence = "you are an idiot and a stupid ass too"
    for gap, wide in ((" ", "  "), (" ", " "), (".", " ."), ("  ", "  ")):
        assert restored(spaced(sentence, gap, wide)) == sentence
    long = " ".join([sentence] * 40)
    assert restored(spaced(long)) == long and restored(spaced(long, " ", " ")) == long
    assert restored("st" + "u" * 90 + "pid") == "stupid" and restored("you a$$") == "ass" and restored("idiot!") == "" and restored("idi0t!!") == "idiot"
    assert len(restored(spaced("idiot " * 5000))) == 5000 * 6 - 1
    assert restored("an id.iot too") == "idiot" and restored("stu-pid") == "stupid" and restored("s - t - u - p - i - d") == "stupid" and restored("a55") == "ass"


def test_toxicity_of_spaced_sentences(spark):
    rng = np.random.default_rng(6)
    words = "house river garden window letter morning paper bridge summer music table number".split()
    rows, labels = [], []
    for i in range(1200):
        own = [words[k] for k in rng.integers(0, len(words), 8)]
        if i % 4 == 0:
            own[3:3] = ["you", "stupid", "idiot"]
        rows.append((i, " ".join(own)))
        labels.append((i, int(i % 4 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    asked = [(1, "y o u  s t u p i d  i d i o t"), (2, "y o u s t u p i d i d i o t " * 9), (3, "h o u s e  r i v e r  g a r d e n"), (4, "m u s i c t a b l e " * 9)]
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (7, None), (1, 0)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.train(odd, labels)).count() == odd.count()
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(odd, toxicity.train(odd, none)).collect()} == {0}
    assert toxicity.score(empty, toxicity.train(empty, none)).count() == 0
