"""Vector, chat and page operators, and the pipeline."""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stepgrid.llm import ann, chat, queries, url_filter


# ------------------------------------------------------------------------------------------------------------- neighbours
def brute_neighbours(rows, asked, k=5):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], float)
    u = m / np.linalg.norm(m, axis=1)[:, None]
    out = {}
    for q in asked:
        s = u @ u[ids == q][0]
        s[ids == q] = -np.inf
        out[q] = ids[np.lexsort((ids, -s.round(12)))[:k]].tolist()
    return out


def test_recall_on_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    asked = [i for i, _ in rows if i % 50 == 0]
    found = {}
    for r in queries.op1_multiprobe_lsh(spark, sf).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_neighbours(rows, asked)
    assert all(len(found[q]) == 5 for q in asked)
    assert np.mean([len(set(found[q]) & set(want[q])) / 5 for q in asked]) >= 0.9


def test_examined_share_falls_as_the_table_grows(spark):
    """Vectors around many centres: recall stays, and the share of rows that a query is compared with falls."""
    shares = []
    for n in (2000, 16_000):
        rng = np.random.default_rng(6)
        m = rng.normal(size=(n // 20, 32))[rng.integers(0, n // 20, n)] + 0.6 * rng.normal(size=(n, 32))
        rows = [(i, v.tolist()) for i, v in enumerate(m)]
        asked = list(range(0, n, 50))
        got, seen = {}, {}
        for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
            seen[r.query_id] = r.examined
        want = brute_neighbours(rows, asked)
        assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in asked]) >= 0.9
        shares.append(np.mean(list(seen.values())) / n)
    assert shares[1] < 0.6 * shares[0] and shares[1] < 0.2, shares


def test_odd_vectors(spark):
    bad = [(900, None), (901, [0.0, 0.0, 0.0]), (902, [1.0, None, 0.0]), (903, [math.nan, 1.0, 0.0]), (904, [math.inf, 1.0, 0.0]), (905, []), (None, [1.0, 1.0, 1.0])]
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "keys": F.lit("x")})
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)] and [g[3] for g in got] == pytest.approx([1, 1, 0])
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_one_bucket_may_hold_a_third(spark):
    rng = np.random.default_rng(2)
    same = rng.normal(size=16)
    rows = [(i, (same if i % 3 == 0 else rng.normal(size=16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(got) == 60 and got[0] == [3, 6, 9, 12, 15] and got[300] == [0, 3, 6, 9, 12]


def test_isolated_vectors_get_all_their_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + 0.001 * rng.normal(size=24)).tolist()) for i in range(1, 4001)]
    rows += [(50 * (100 + i), (-50 * rng.normal(size=24)).tolist()) for i in range(20)]
    rows += [(50 * 100, rows[-20][1]), (0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    asked = {i for i, v in rows if i % 50 == 0 and len(v) == 24}
    assert set(got) == asked and all(len(set(v)) == 5 and q not in v for q, v in got.items())


# ------------------------------------------------------------------------------------------------------------------ chats
def test_chats_read_back(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "a \\ <| b <|im_end|>\n"), (1, 2, "assistant", "x" * 3000), (1, 3, "user", None), (1, 4, "assistant", "\\\\| \\^ <\\|"), (1, 5, None, "?"),
        (2, 0, "assistant", ""), (None, 0, "user", "hi"), (None, None, "assistant", "yes"), (3, 0, "us\ner<|im_start|>", "\n"), (3, 0, "us\ner<|im_start|>", "\n"),
    ] + [(4, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 40)) for i in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit(1), "window": F.lit(2), "rank": F.lit("z")})
    formatted = chat.windows(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-math.inf if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[c]
        assert g.n_turns == len(turns) and g.loss_chars == len(loss)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    later = formatted.filter("conv_id = 1 and window > 0").collect()
    assert [r.over for r in later].count(True) == 1 and all(r.over or r.text.startswith("<|im_start|>system\nbe kind<|im_end|>\n") for r in later)
    assert formatted.filter("conv_id = 4").count() > 5
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0


def brute_windows(turns):
    """(turns, repeats) of the windows of one conversation of (role, tokens), turn by turn."""
    system = turns[0][1] if turns[0][0] == "system" and turns[0][1] <= chat.BUDGET // 2 else 0
    room, at, cells, out = chat.BUDGET - system, 0, {}, []
    for i, (_, n) in enumerate(turns):
        if i or not system:
            cells.setdefault(at // room, []).append((i, n, (at + n - 1) // room != at // room))
            at += n
        else:
            cells[0] = [(0, 0, False)]
    for c in sorted(cells):
        inner, cross = [x for x in cells[c] if not x[2]], [x for x in cells[c] if x[2]]
        for part in [cells[c]] if not inner or sum(n for _, n, _ in cells[c]) <= room else [inner, cross] if cross else [inner]:
            own = [i for i, _, _ in part]
            used, again = sum(turns[i][1] for i in own), []
            for k in [0] if system and 0 not in own else []:
                again += [k] if used + system <= chat.BUDGET else []
            before = own[0] - 1
            if before >= 0 and not (system and before == 0) and used + sum(turns[k][1] for k in again) + turns[before][1] <= chat.BUDGET:
                again.append(before)
            out.append((again + own, len(again)))
    return out


def test_windows_keep_the_budget(spark, sf):
    rng = np.random.default_rng(9)
    rows = [(c, i, "system" if i == 0 and c % 2 else ("user", "assistant")[i % 2], " ".join(["x" * 9] * int(rng.choice([0, 3, 30, 70, 83, 84, 85, 86, 200])))) for c in range(24) for i in range(60)]
    rows += [(50, i, ("user", "assistant")[i % 2], "y" * 384) for i in range(3)] + [(None, None, "user", "a <| b")]
    rows += [(51, i, ("system", "user", "assistant", "user")[i], "z" * (384 if i else 40)) for i in range(4)]
    rows += [(52, i, "system" if not i else "user", "z" * (600 if not i else 40)) for i in range(9)]
    odd = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    for df in (odd, table):
        by = {}
        for r in df.collect():
            by.setdefault(r.conv_id, []).append((-1 if r.turn is None else r.turn, r.role or "", r.text or ""))
        want = {}
        for c, turns in by.items():
            turns.sort()
            sized = [(r, len(re.findall(chat.PIECES, x)) + chat.TURN_TOKENS) for _, r, x in turns]
            want[c] = [(sum(sized[i][1] for i in w), n, [turns[i][2] for i in w]) for w, n in brute_windows(sized)]
        got = {}
        for r in chat.windows(df).orderBy("window").collect():
            texts = [p.split("\n", 1)[1].replace("<\\|", "<|").replace("\\\\", "\\") for p in r.text.split("<|im_end|>\n")[:-1]]
            assert r.over == (r.tokens > chat.BUDGET) and (not r.over or len(texts) == 1 and r.repeated == 0)
            got.setdefault(r.conv_id, []).append((r.tokens, r.repeated, texts))
        assert got == want


# -------------------------------------------------------------------------------------------------------------------- URLs
def test_url_verdicts(spark):
    d = datetime.date
    entries = [("block", "bad.org", "add", d(2024, 1, 1)), ("block", "bad.org", "remove", d(2024, 2, 1)), ("block", "bad.org", "add", d(2024, 3, 1)), ("allow", "ok.bad.org", "add", d(2024, 1, 15)), ("allow", "bad.org", "add", d(2024, 3, 1)), ("block", "org", "add", d(2024, 6, 1)), ("block", "x.org", "add", None)]
    captures = [
        ("http://bad.org/a", d(2024, 1, 1), "block"), ("http://bad.org/a", d(2024, 1, 1), "block"), ("https://u:p@WWW.Bad.org.:80/?q", d(2024, 1, 31), "block"), ("http://bad.org", d(2024, 2, 1), "none"), ("http://ok.bad.org", d(2024, 1, 20), "allow"),
        ("http://ok.bad.org", d(2024, 1, 14), "block"), ("http://bad.org", d(2024, 3, 1), "allow"), ("http://notbad.org", d(2024, 1, 5), "none"), ("http://any.org", d(2024, 6, 1), "block"), ("http://x.org", d(2024, 1, 5), "none"),
        (None, d(2024, 6, 1), "none"), ("not a url", d(2024, 6, 1), "none"), ("http://bad.org", None, "none"),
    ]
    df = spark.createDataFrame([(i, *c, "mine") for i, c in enumerate(captures)], "id int, url string, fetched date, want string, domain string")
    table = spark.createDataFrame(entries, "list string, domain string, action string, since date")
    got = url_filter.judge(df, table)
    assert [(r.id, r.want) for r in got.collect() if r.verdict != r.want] == [] and got.count() == len(captures)
    assert got.columns == ["id", "url", "fetched", "want", "host", "verdict", "domain", "since"]
    assert url_filter.judge(df.limit(0), table).count() == 0 and url_filter.judge(df, table.limit(0)).filter("verdict != 'none'").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    rows = lambda rs: sorted(repr(tuple(r)) for r in rs)
    assert rows(got.select(names).collect()) == rows(want.fetchall())


# ---------------------------------------------------------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        n = docs.count()
        assert n > 0 and (name in ("mix", "encode") or n <= before)
        before = n
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_equals_brute_force(spark, sf, tmp_path):
    """Every stage's rows from its predecessor's, in plain Python and by the tiktoken library."""
    import tiktoken
    from test_texts import base_spans, brute_classes

    from stepgrid.llm import bpe, langid, mixing, secrets

    raw = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [raw.collect()]
    for name, stage in corpus_pipeline.STAGES:
        df = raw if len(kept) == 1 else spark.read.parquet(str(tmp_path / str(len(kept) - 1)))
        stage(spark, df, sf).write.parquet(str(tmp_path / str(len(kept))))
        kept.append(spark.read.parquet(str(tmp_path / str(len(kept)))).collect())
    start, lang, one, clean, mixed, coded = kept
    rows = lambda rs: sorted(map(repr, rs))
    rejected = {r.doc_id for r in langid.predict(raw, langid.train(raw)).collect() if r.rejected}
    assert rows(lang) == rows(r for r in start if r.doc_id not in rejected)
    classes = {i: c for i, c, _, _ in brute_classes([(r.doc_id, r.text or "") for r in lang])}
    assert rows(one) == rows(r for r in lang if classes[r.doc_id] == r.doc_id)

    owners, found = {}, {}
    for r in [*start, *one]:
        found[r.doc_id] = []
        for s in base_spans(r.text or ""):
            kind, a, b = s.split(":")
            hit = r.text[int(a) : int(b)]
            value = re.search(r"[A-Za-z0-9+/_.=-]+$", hit).group() if kind == "assign" else hit
            owners.setdefault(value, set()).add(r.source)
            found[r.doc_id].append((int(a), int(b), value))
    want = {}
    for r in one:
        at, out = 0, ""
        for a, b, value in sorted(found[r.doc_id]):
            if len(owners[value]) < secrets.EXAMPLE_OWNERS:
                out, at = (out + r.text[at:a] + "[SECRET]" if a >= at else out), max(at, b)
        want[r.doc_id] = out + (r.text or "")[at:] if at else r.text
    assert {r.doc_id: r.text for r in clean} == want and any(v != r.text for r in one for v in [want[r.doc_id]])
    assert rows(r.asDict() | {"text": "", "n_chars": 0} for r in clean) == rows(r.asDict() | {"text": "", "n_chars": 0} for r in one)

    size = lambda t: len(re.findall(mixing.WORD, t or ""))
    spent = {}
    for r in mixed:
        spent[r.doc_id] = spent.get(r.doc_id, 0) + size(r.text)
    taken = {r.doc_id: r.taken for r in mixing.taken(mixing.mix(spark.read.parquet(str(tmp_path / "3")))).collect()}
    assert spent == {i: n for i, n in taken.items() if n}
    whole = {r.doc_id: re.findall(mixing.WORD, r.text or "") for r in clean}
    assert all(set(re.findall(mixing.WORD, r.text)) <= set(whole[r.doc_id]) for r in mixed)

    path, pattern = queries.tokenizer()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.vocabulary(path).ranks, special_tokens={})
    ids = [(r.doc_id, np.array(library.encode_ordinary(r.text), "<u4"), r.text) for r in mixed]
    assert rows((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded) == rows((i, len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, x, t in ids)


def test_pipeline_of_odd_rows(spark, odd, empty, sf):
    for df in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, sf)
            assert df.columns == odd.columns
            df = df.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df
