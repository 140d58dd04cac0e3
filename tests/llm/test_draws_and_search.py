"""Resampling, nearest neighbours and infilling against brute force, and their defined cases."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm import infill, neighbours, oracles, resample  # noqa: E402
from tidemark.llm.words import PUNCTUATION, Words, buffers  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, score long, rank int, output string, id string, row int, n string"


def frame(spark, rows, schema=DOCS):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *([None] * (width - len(r)))) for r in rows], schema)


TEXTS = [
    (1, None), (2, ""), (3, "one"), (4, "One two, THREE."), (5, "a\nb\n"), (6, "\n\n\n"), (7, "no end\nof line"), (8, "holds <P> a mark\nx"),
    (9, "über\nÜBER naïve 漢字 x1\n" * 40), (10, "w" * 70 + " short " + "é" * 90 + " " + "v" * 65), (11, "line " * 30_000), (12, "\n".join("abc")),
    (13, "x" * 200_000), (4, "One two, THREE."), (None, "an unnamed text of many words " * 9), (14, "\x00ctl\x7f mixed\ttabs\r\n"), (15, "😀 smile\n" * 30),
    *[(20 + i, " ".join(f"word{(i * j) % 17}" for j in range(15 + i % 12)) + "\nend") for i in range(80)],
]


# -- infilling -------------------------------------------------------------------
def plain_infill(key, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_plain_loop_and_restores(spark):
    docs = frame(spark, TEXTS).repartition(4)
    cut = infill.fill_in_middle(docs)
    got = sorted(map(repr, (tuple(r) for r in cut.collect())))
    assert got == sorted(repr((k, *plain_infill(k, t))) for k, t in TEXTS)
    back = cut.select("doc_id", infill.restored(cut["output"], cut["form"]).alias("text")).collect()
    assert collections.Counter((r[0], r[1]) for r in back) == collections.Counter((k, t or "") for k, t in TEXTS)
    assert {"plain", "psm", "spm"} == {r["form"] for r in cut.select("form").collect()}
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def test_infill_rates_units_and_bad_units(spark):
    docs = frame(spark, TEXTS)
    assert {r["form"] for r in infill.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    assert "psm" not in {r["form"] for r in infill.fill_in_middle(docs, spm=100).collect()}
    by_char = infill.fill_in_middle(docs.filter("doc_id = 7"), unit=r"(?s:.)").first()
    assert by_char["n"] == len("no end\nof line")
    with pytest.raises(ValueError, match="cover"):
        infill.rearranged("a\nb", "1", infill.regex.compile("(?:([a-z]))*+"), 100, 50, 7)


def test_infill_marks_across_cuts(spark):
    # pieces of marks at a cut never read as a mark
    docs = frame(spark, [(i, t) for i in range(40) for t in ["<\nP>\n<S\n>\n<<\nM>>"]])
    cut = infill.fill_in_middle(docs)
    assert {r[0] for r in cut.select(infill.restored(cut["output"], cut["form"])).collect()} == {"<\nP>\n<S\n>\n<<\nM>>"}


# -- resampling ----------------------------------------------------------------------
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resample(docs, target, percent=5):
    found = [(k, *grams(t)) for k, t in docs]
    s = collections.Counter(zlib.crc32(f.encode()) % 10000 for _, _, fs in found for f in fs)
    t = collections.Counter(zlib.crc32(f.encode()) % 10000 for x in target for f in grams(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for k, n, fs in found:
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in fs)
        h = None if k is None else int(hashlib.sha256(f"42:{k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(fs), weight, None if k is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    open_rows = sorted((r for r in rows if r[4] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(open_rows[: percent * len(open_rows) // 100])}
    return sorted((repr((*r[:4], rank.get(id(r)))) for r in rows))


@pytest.mark.parametrize("percent", [0, 5, 37, 100])
def test_resample_equals_sorting_everything(spark, percent):
    target = ["word1 word3 word5 naïve", None, "three", "an unnamed text"]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resampled(frame(spark, TEXTS).repartition(5), benchmark, percent=percent).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_resample(TEXTS, target, percent)


def test_resample_edges(spark):
    docs = frame(spark, TEXTS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.resampled(docs.limit(0), none).count() == 0
    assert sorted(repr(tuple(r)) for r in resample.resampled(docs, none).collect()) == plain_resample(TEXTS, [])
    # repeated rows tie in score and id: each takes a place of its own
    same = frame(spark, [(5, "b c d e " * 8)] * 30 + [(6, "b c d e " * 8)] * 30).repartition(7)
    got = resample.resampled(same, none, percent=70).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 43))
    first = max(got, key=lambda r: (r["score"], -r["doc_id"]))["doc_id"]
    assert sum(r["rank"] is not None for r in got if r["doc_id"] == first) == 30


@pytest.mark.parametrize("pivots", [1, 2, 7, 64])
def test_quickselect_finds_every_place(spark, pivots):
    rng = np.random.default_rng(3)
    rows = [(int(s), int(d), i) for i, (s, d) in enumerate(zip(rng.integers(0, 4, 60), rng.integers(0, 5, 60), strict=True))]
    scored = spark.createDataFrame(rows, "score long, id long, row long").repartition(3).cache()
    ordered = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    for k in (1, 2, 29, 60):
        assert resample.select_key(scored, k, pivots) == ordered[k - 1]
    with pytest.raises(ValueError, match="no place"):
        resample.select_key(scored, 61, pivots)


def test_run_crcs_equal_zlib():
    import pyarrow as pa

    texts = [t for _, t in TEXTS]
    raw, offs = buffers(pa.array(texts))
    w = Words(raw, offs, 0, len(texts), PUNCTUATION)
    got = collections.Counter(int(c) for _, crc in resample.features(w) for c in crc)
    assert got == collections.Counter(zlib.crc32(f.encode()) for t in texts for f in grams(t)[1])


def test_sql_twins_on_odd_texts(spark):
    rows = [(k, t) for k, t in TEXTS if k is not None and k != 4 and len(t or "") < 50_000]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(k, t) for k, t in rows if "\x00" not in (t or "")])
    con.execute("CREATE TABLE benchmark AS SELECT 1 AS item_id, 'word1 word2 naïve' AS text")
    docs = frame(spark, [(k, t) for k, t in rows if "\x00" not in (t or "")])
    benchmark = spark.createDataFrame([(1, "word1 word2 naïve")], "item_id long, text string")
    for sql, df in ((oracles.OP13, infill.digests(infill.fill_in_middle(docs))), (oracles.OP11, resample.resampled(docs, benchmark))):
        names = [d[0] for d in con.execute(sql).description]
        assert sorted(map(repr, con.execute(sql).fetchall())) == sorted(repr(tuple(r)) for r in df.select(*names).collect())


# -- neighbours ------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<double>, score double, rank int, vec binary, dims int, key string"


def brute(rows, k=10, every=100):
    """{(query id, vector): [(distance, id)]} over all rows."""
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)}
    out = {}
    for i, v in ok:
        if i % every == 0:
            found = {(float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for j, w in ok if j != i and len(w) == len(v)}
            out[i, v] = sorted(found)[:k]
    return out


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 24))
    rows = [(i, [float(x) for x in centres[i % 20] * rng.uniform(0.5, 2) + rng.normal(size=24) * 0.4]) for i in range(3000)]
    got = collections.defaultdict(list)
    for r in neighbours.nearest_neighbours(frame(spark, rows, VECTORS).repartition(4)).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    want = brute(rows)
    by_id = dict(rows)
    hit = 0
    for (i, v), near in want.items():
        found = sorted(got[i])
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(s, j) for _, s, j in found] == sorted((s, j) for _, s, j in found)
        for _, s, j in found:
            assert s == pytest.approx(math.dist(by_id[j], v), abs=1e-12)
        hit += len({j for _, _, j in found} & {j for _, j in near})
    assert hit >= 0.95 * 10 * len(want)


def test_neighbours_defined_cases(spark, monkeypatch):
    # small cells: a hot vector, whose copies outnumber every cell, is cut over many
    monkeypatch.setattr(neighbours, "CELL_ROWS", 3)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 2)
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 1500, 3)]  # 500 copies, five of them queries
    rows += [(i, [float(x) for x in rng.normal(size=3)]) for i in range(1, 300, 3)]
    rows += [(2, None), (5, []), (8, [0.0, 0.0, 0.0]), (11, [1.0, None, 2.0]), (14, [math.nan, 1.0, 1.0]), (17, [math.inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(1700, [1.0, 2.0, 3.0])] * 3  # repeated rows are one
    rows += [(1800, [1.0, 2.0, 3.0]), (1800, [-1.0, 0.5, 0.0])]  # one id with two vectors
    rows += [(1900, [1.0, 1.0]), (1901, [1.0, 0.0]), (1902, [0.0, -0.0, 1.0]), (1903, [0.0, 0.0, 1.0])]  # another length; two zeros
    rows += [(2000, [1e-200, 2e-200, 0.0]), (2100, [1.0, 2.0, 3.0, 4.0, 5.0])]  # tiny; alone
    df = frame(spark, rows, VECTORS)
    # every key probed: what is found is then exact
    got = collections.defaultdict(list)
    for r in neighbours.nearest_neighbours(df, recall=1.0).collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    want = collections.defaultdict(list)
    for (i, _), near in brute(rows).items():
        want[i] += near
    assert set(got) == {i for i, near in want.items() if near}
    hit = sum(len(set(got.get(i, [])) & set(want[i])) for i in want)
    assert hit >= 0.97 * sum(map(len, want.values()))
    assert 2100 not in got and sorted(got[1900]) == [(1.0, 1901)]
    # ties of the hot vector go to the smallest ids, the own left out
    assert sorted(got[300])[:10] == [(0.0, i) for i in range(0, 30, 3)] and sorted(got[0])[:10] == [(0.0, i) for i in range(3, 33, 3)]
    assert neighbours.nearest_neighbours(df.limit(0)).count() == 0
    assert neighbours.nearest_neighbours(df.filter("vec_id = 300")).count() == 0
    assert neighbours.nearest_neighbours(df.filter("vec_id = 1")).count() == 0


def test_rotation_keeps_lengths_and_keys_are_nearest_axes():
    rng = np.random.default_rng(7)
    x = neighbours.units(rng.normal(size=(50, 20)))
    y = neighbours.rotated(x, 12, 3)
    assert y.shape == (50, 32) and np.allclose((y * y).sum(axis=1), 1)
    assert np.allclose(y @ y.T, x @ x.T)
    h = neighbours.Hashing(tables=2, depth=2)
    near = neighbours.key_closeness(x, 1, h)
    assert near.shape == (50, 64 * 64) and (near.argmax(axis=1) == neighbours.keys_of(x, 1, h)).all()
