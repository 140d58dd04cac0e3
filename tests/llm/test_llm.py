"""Each corpus operator against brute force on small fixtures, and its defined cases."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tidemark.llm")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidemark.llm import decontaminate, fingerprint, htmltext, jaccard, lines, pieces, pii, quality, suffixes, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, low string, region string, key string"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def frame(spark, rows, schema=SCHEMA):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *([None] * (width - len(r)))) for r in rows], schema)


@pytest.fixture(scope="module")
def texts(spark):
    got = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    rows = [(r[0], r[1]) for r in got]
    base = rows[1][1].split(" ")
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(0, 24, 2)]
    return rows + [(10_000 + i, t) for i, t in enumerate(near)] + [(10_100, None), (10_101, ""), (10_102, "one two"), (10_103, "one two"), (10_104, "x" * 30_000), (None, "one two")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_equals_all_pairs(docs, texts, k, percent):
    sets = [shingles(t, k) for _, t in texts]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    ids = collections.defaultdict(list)
    for x, (doc, _) in zip(label, texts, strict=True):
        if doc is not None:
            ids[x].append(doc)
    want = sorted(((d, len(s), min(ids[x]) if ids[x] else None) for (d, _), s, x in zip(texts, sets, label, strict=True)), key=repr)
    got = jaccard.jaccard_groups(docs, words=k, percent=percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_jaccard_clump_is_compared_whole(spark, monkeypatch):
    # many sets at a distance just beyond the limit of one another, but for a chain of links
    monkeypatch.setattr(jaccard, "LEAF", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = np.random.default_rng(5)
    common = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(30):
        w = list(common)
        for p in rng.choice(200, 3 + d % 5, replace=False):
            w[p] = f"e{d}_{p}"
        rows.append((d, " ".join(w)))
    sets = [shingles(t, 4) for _, t in rows]
    label = list(range(30))
    for i in range(30):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    want = [min(j for j in range(30) if label[j] == label[i]) for i in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(frame(spark, rows)).collect()}
    assert [got[d] for d in range(30)] == want


def test_suffixes_equal_brute_force(docs, texts):
    got = collections.Counter(map(tuple, suffixes.digests(docs).collect()))
    order = sorted(texts, key=lambda r: (r[0] is None, r[0] or 0))
    first, want = {}, collections.Counter()
    for doc, text in order:
        data = (text or "").encode()
        mark = bytearray(len(data))
        for s in range(len(data) - 49):
            if first.setdefault(data[s : s + 50], (doc is None, doc)) < (doc is None, doc):
                mark[s : s + 50] = b"\1" * 50
        kept = bytes(b for b, m in zip(data, mark, strict=True) if not m)
        want[doc, len(data), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest()] += 1
    assert got == want


def test_suffix_array_is_sorted():
    text = np.frombuffer(b"mississippi banana bandana mississippi" * 3, np.uint8)
    padded = np.concatenate([text, np.zeros(64, np.uint8)]).astype(np.uint64)
    table = sum(padded[b : len(padded) - 7 + b] << np.uint64(56 - 8 * b) for b in range(8))
    got = [bytes(text[i:])[:50] for i in suffixes.suffix_array(text, table)]
    assert got == sorted(got) and len(got) == len(text)


def test_pieces_equal_library(docs, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    odd = ["  a  b\tc\n\n ﬁ 日本 😀 \x00", " " * 300, "▁a ▁", "aab" * 200, "=-=- --\r\n"]
    own = pieces.pieces(MODEL)
    for t in odd:
        assert own.encode(t) == model.encode(t) and own.decode(own.encode(t)) == model.decode(model.encode(t))
    for row in pieces.encoded(docs, MODEL).collect():
        text = dict(texts)[row["doc_id"]] or ""
        assert row["ids"] == model.encode(text) and row["decoded"] == model.decode(model.encode(text))


def test_fingerprints(docs, texts):
    rows = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(docs).collect()}
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        assert rows[doc]["n_chars"] == len(text)
        assert rows[doc]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        a, b = shingles(text, 5), shingles(changed, 5)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(rows[doc]["near_edited"] - true) < (1e-9 if len(a) < 128 and len(b) < 128 else 0.2)


def test_jaccard_in_passes(docs, monkeypatch):
    """Sets that travel in four passes, not all at once, give the same components."""
    want = sorted(jaccard.jaccard_groups(docs).collect(), key=str)
    monkeypatch.setattr(jaccard, "ENOUGH", 3)
    written, stage = [], jaccard.stage
    monkeypatch.setattr(jaccard, "stage", lambda df, name: written.append(name) or stage(df, name))
    assert sorted(jaccard.jaccard_groups(docs).collect(), key=str) == want
    assert written.count("measured") >= jaccard.PASSES


def test_jaccard_sends_few_sets(spark, monkeypatch):
    """Sets that share a passage but are no near copies go no further than their parts; regions of one set are united."""
    rng = np.random.default_rng(9)
    made = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage = made(60)
    rows = [(k, " ".join(made(120 + k) + passage + made(120))) for k in range(40)]
    words = rows[7][1].split(" ")
    rows += [(40 + k, " ".join([*words[:k], "edit", *words[k + 1 :]])) for k in range(20)]
    written, stage = {}, jaccard.stage

    def counted(df, name):
        out = stage(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "stage", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(frame(spark, rows)).collect()}
    assert got == {k: 7 if k >= 40 else k for k in range(60)}
    assert written["sets"] <= 30 and written["shared_parts"] > written["regions"]


def test_jaccard_regions_of_one_set_are_united(spark):
    regions = [(r, m, m) for r, members in enumerate([[1, 2, 3], [1, 2, 4], [1, 3, 4], [5, 6, 7]]) for m in members]
    regions = spark.createDataFrame(regions, "region long, member long, label long")
    sets = {m: np.arange(100 * (m > 4), 100 * (m > 4) + 50 + m % 3, dtype=np.uint64) for m in range(1, 8)}
    found = spark.createDataFrame([(m, h.tobytes()) for m, h in sets.items()], "set_hash long, hashes binary")
    written, links = [], []

    def counted(df, name, stage=jaccard.stage):
        out = stage(df, name)
        written.append((name, out.count()))
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(jaccard, "stage", counted)
        links = {tuple(sorted(r)) for r in jaccard._together(regions, found, 85).collect()}
    # 12 rows before; a spanning forest of {1, 2, 3, 4} and {5, 6, 7} has five links
    assert dict(written)["together_rows"] == 7 and len(links) == 5 and all((a > 4) == (b > 4) for a, b in links)


def test_merged_sketch_is_the_sketch_of_the_union(spark, docs, texts):
    parts = fingerprint.sketches(docs).selectExpr("1 AS one", "fingerprint")
    got = fingerprint.from_text(fingerprint.merged(parts, ["one"]).first()["fingerprint"])
    every = np.unique(np.concatenate([a for a in fingerprint.sketch_arrays(pa.array([t for _, t in texts]), k=10**6)]))
    assert np.array_equal(got, every[:128])


def test_pii_learns_from_every_document(spark):
    """Candidates that stand only in documents far down any order of hashes still teach the trees."""
    ids = [r[0] for r in spark.range(4300).selectExpr("id").orderBy(F.xxhash64("id"), "id").collect()]
    told = {doc: f"write to a{doc} (at) b{doc} (dot) org" if k % 2 else f"number 1234 5678 9012 {1000 + doc} is none" for k, doc in enumerate(ids[-300:])}
    got = pii.digests(pii.detected(frame(spark, [(doc, told.get(doc, "nothing here")) for doc in ids]))).filter("n_added > 0").collect()
    assert {r["doc_id"] for r in got} == {doc for doc, text in told.items() if "(at)" in text}
    assert all(r["spans"] == f"email:9:{len(told[r['doc_id']])}" for r in got)


def test_pii_base_spans(spark):
    checks = [
        (1, "mail a.b@c-d.org_x@y.z, 1.2.3.4.5.6.7.8 999.1.1.1 card 4111 1111 1111 1111 and 4111-1111-1111-1112"),
        (2, "é😀 +49 (30) 1234-5678 +1 2 001.002.003.004"), (3, None), (4, ""), (4, ""), (None, "x@y.zz"), (6, "+" * 50 + "1" * 5000), (7, "a" * 20_000 + "@")]
    got = collections.Counter((r["doc_id"], r["base_sha256"]) for r in pii.digests(pii.detected(frame(spark, checks))).collect())
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def holds(kind, value):
        d = [int(x) for x in re.sub("[^0-9]", "", value)][::-1]
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    want = collections.Counter()
    for doc, text in checks:
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, (text or "")[:19_000]) if holds(k, m[0])]
        want[doc, hashlib.sha256(",".join(spans).encode()).hexdigest()] += 1
    assert got == want


def test_lines_keep_one_of_each_group(spark):
    line = "Several words make up this quite ordinary licence line for testing purposes here today"
    rows = [(3, f"{line}\nshort one\nown words of document three are here"), (1, f"short one\n{line}"), (2, line.replace("ordinary", "ordinari") + "\n" + line.upper()), (4, None), (5, ""), (None, line)]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in lines.deduplicated(frame(spark, rows)).collect()}
    assert got[1] == (f"short one\n{line}", 2, 0)
    assert got[3] == ("short one\nown words of document three are here", 3, 1)
    assert got[2][2] >= 1 and got[None] == ("", 1, 1) and got[4] == ("", 1, 0) and got[5] == ("", 1, 0)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_of_one_large_key_equal_all_pairs(spark):
    """Short words have no weight here, so all lines have one SimHash, but they form seven groups."""
    long = "measured tonight between several harbours towards evening"
    made = [" ".join([chr(97 + g) * 3] * 9 + ["xy"] * (g % 3) + [f"{chr(107 + k)}z"] + [long] + [chr(107 + g) * 4] * 8) for k in range(9) for g in range(7)]
    label = list(range(len(made)))
    for i, a in enumerate(made):
        for j, b in enumerate(made[:i]):
            if _distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
                label = [label[j] if x == label[i] else x for x in label]
    first = {x: label.index(x) for x in label}
    assert len(first) == 7
    docs = frame(spark, list(enumerate(made))).repartition(3)
    _, classes = lines.line_classes(docs, "doc_id", "text")
    assert classes.select("b0", "b1", "b2", "b3").distinct().count() == 1
    near = lines.candidate_pairs(lines.shared_keys(classes))
    assert near.count() < len(made) * (len(made) - 1) // 2
    got = {r["doc_id"]: r["n_removed"] for r in lines.deduplicated(docs).collect()}
    assert got == {i: int(first[x] != i) for i, x in enumerate(label)}
    # every pair of different groups that differ in at most two bits is met, whatever the grid
    keyed = spark.createDataFrame([(n, 1, int(b), n % 5, n % 5 == 0) for n, b in enumerate(np.random.default_rng(5).integers(0, 16, 300))], "line long, key long, bits long, label long, main boolean")
    rows = [r.asDict() for r in keyed.collect()]
    want = {(a["line"], b["line"]) for a in rows for b in rows if a["line"] < b["line"] and a["label"] != b["label"] and (a["bits"] ^ b["bits"]).bit_count() <= 2}
    cell, lines.CELL = lines.CELL, 16
    try:
        assert {tuple(r) for r in lines.divided_pairs(keyed).collect()} == want
    finally:
        lines.CELL = cell


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog near the old river bank"), (2, None), (3, "two words")], "item_id long, text string")
    rows = [(1, "Noise here. the QUICK brown fox, jumps over a lazy dog near the old river bank! more"), (2, "nothing to see in this document at all"), (3, None), (None, bench.first()["text"]), (5, "two words")]
    got = {r["doc_id"]: r["leaks"] for r in decontaminate.with_matches(frame(spark, rows), bench).collect()}
    assert [x["item"] for x in got[1]] == [1] and [x["item"] for x in got[None]] == [1] and got[None][0]["score"] == 1.0
    assert got[2] is None and got[3] is None and got[5] is None


def test_alignment_equals_plain_table():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.integers(0, 5, 12), rng.integers(0, 5, 30)
        h = np.zeros((13, 31))
        for i in range(1, 13):
            for j in range(1, 31):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1, j] - 0.5, h[i, j - 1] - 0.5)
        assert decontaminate.align(a, b)[0] == h.max()


def test_quality_learns_grades(spark):
    sound = [(i, f"Plain sentence number {i} tells a story. It ends here.", i) for i in range(60)]
    poor = [(100 + i, f"buy### now$$$ {i}%%% &&&*** best###", 0) for i in range(60)]
    docs = frame(spark, [(d, t) for d, t, _ in sound + poor] + [(500, None), (None, "")])
    grades = spark.createDataFrame([(d, 0 if d >= 100 else 1 + d % 2) for d, _, _ in sound + poor] + [(None, 1), (7, None)], "doc_id long, grade int")
    model = quality.train(docs, grades, 3)
    got = {r["doc_id"]: r["quality"] for r in quality.graded(docs, model).collect()}
    assert all(got[d]["keep"] for d, _, _ in sound) and not any(got[d]["keep"] for d, _, _ in poor)
    assert len(got) == 122 and (np.diff(model.thresholds) > 0).all()
    empty = quality.train(docs.limit(0), grades, 3)
    assert not empty.weights.any()


def test_ordinal_gradient_matches_differences():
    row = [(np.array([0, 3], np.int32), np.array([0.5, 0.5], np.float32)), (np.array([1], np.int32), np.array([1.0], np.float32))] * 10
    model = quality.fit_ordinal(row, np.array([2, 0] * 10), 3)
    tails = model.tails(np.array([model.weights[0] * 0.5 + model.weights[3] * 0.5, model.weights[1]]))
    assert tails[0, 1] > 0.8 and tails[1, 0] < 0.2


def test_toxicity_nearest_is_exact(spark):
    rng = np.random.default_rng(1)
    terms = np.sort(rng.integers(1, 2**62, 12).astype(np.uint64))
    examples = []
    for _ in range(700):
        places = np.unique(rng.integers(0, 12, rng.integers(0, 4)))
        examples.append((places, rng.integers(1, 4, len(places))))
    index = toxicity.Index(terms, np.linspace(1, 3, 12), examples, rng.integers(0, 2, 700), np.arange(700))
    dense = np.zeros((700, 12))
    for e, x in enumerate(examples):
        p, w = index.vector(*x)
        dense[e, p] = w
    for e in range(0, 700, 7):
        p, w = index.vector(*examples[e])
        cosine = np.round(dense[:, p] @ w, 12)
        want = [r for r in np.lexsort((np.arange(700), -cosine)) if cosine[r] > 0][: index.k]
        assert index.nearest(p, w)[0].tolist() == want


def test_toxicity_scores(spark):
    docs = frame(spark, [(i, f"calm text number{i}" + (" you idiot." if i % 4 == 0 else "")) for i in range(200)] + [(900, None), (None, "IDIOT!")])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, toxicity.build(docs, labels)).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(200)) and got[900] < 0.5 <= got[None]
    none = toxicity.build(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.scored(docs, none).collect()} == {0.0} or none.no_term < 0.5


PAGE = ("<html><head><title>T</title><script>var a='</p><p>no';</script></head><body><header class=top>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>"
        "<div class=\"cookie-notice\">We use cookies</div><article><h1>Title &amp; more</h1><p>First <b>bold</b>\n  text.<p>Second&nbsp;one&hellip;<form><input>Name</form></article>"
        "<aside class=sidebar>Related</aside><div id=comments><p>Great post</p></div><footer>&copy; me</footer>")


def test_html_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = htmltext.train(pages)
    assert htmltext.main_text(PAGE, model) == "Title & more First bold text. Second one…"
    assert htmltext.main_text(None, model) == "" and htmltext.main_text("", model) == "" and htmltext.main_text("<p", model) == ""
    wanted = {r["page_id"]: r["html"] for r in pages.collect()}
    for row in htmltext.extracted(pages, model).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", wanted[row["page_id"]], re.S)
        plain = re.sub(r"</?(p|h1|br)[^>]*(>|$)", " ", body[1]) if body else ""
        assert row["text"] == " ".join(__import__("html").unescape(re.sub(r"<[^>]*(>|$)", "", plain)).split()) and row["n_chars"] == len(row["text"])


def test_tree_marginals_equal_enumeration():
    model = htmltext.TreeModel({("tag:div", 0): 5, ("tag:p", 1): 6, ("tag:part", 0): 4}, {(0, 0, 0): 9, (0, 0, 1): 2, (0, 1, 1): 7, (0, 1, 0): 1, (1, 0, 0): 3})
    nodes, _ = htmltext.parse("<div><p>aa</p><nav>b<i>c</i></nav></div><p>ccc</p>")
    own, tables = model.potentials(nodes)
    total, one = 0.0, [0.0] * len(nodes)
    for bits in range(1 << len(nodes)):
        s = [bits >> i & 1 for i in range(len(nodes))]
        p = np.exp(sum(o * x for o, x in zip(own, s, strict=True)) + sum(tables[n.index][s[n.parent]][s[n.index]] for n in nodes[1:]))
        total += p
        one = [a + p * x for a, x in zip(one, s, strict=True)]
    assert np.allclose(model.marginals(nodes), [x / total for x in one])


def test_empty_tables(spark):
    none = frame(spark, [])
    assert suffixes.digests(none).count() == jaccard.jaccard_groups(none).count() == lines.deduplicated(none).count() == 0
    assert pieces.digests(none, MODEL).count() == fingerprint.edited_fingerprints(none).count() == pii.digests(pii.detected(none)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    have = {r["doc_id"] for r in docs.collect()}
    bench = [" ".join(words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, SF), "test_stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    rows = docs.collect()
    left = {r["doc_id"] for r in rows}
    assert left and left <= have
    assert not any(b in " ".join(words(r["text"])) for r in rows for b in bench)
    sets = [shingles(r["text"], 5) for r in rows]
    assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def _copies(sizes, edits, seed):
    """Lines of made-up words, each followed by copies with one word replaced."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(3, 10)))
    made = []
    for size in sizes:
        base = [word() for _ in range(size)]
        made.append(" ".join(base))
        for _ in range(edits):
            at = int(rng.integers(0, size))
            made.append(" ".join([*base[:at], word(), *base[at + 1 :]]))
    return made


def test_line_recall_of_one_word_edits(spark):
    """Near copies with one word replaced go, at all lengths."""
    made = _copies([8, 10, 12, 15, 20, 30, 60, 120] * 6, 1, 1)
    want = {2 * i + 1 for i in range(len(made) // 2) if _distance(made[2 * i], made[2 * i + 1]) <= 0.2 * max(map(len, made[2 * i : 2 * i + 2])) + 1e-9}
    got = {r["doc_id"] for r in lines.deduplicated(frame(spark, list(enumerate(made)))).filter("n_removed > 0").collect()}
    assert len(want) >= 40 and got <= want and len(got) >= 0.95 * len(want)


def test_line_pairs_of_a_large_key_have_no_bit_rule(spark, monkeypatch):
    """In a key of any size all pairs of different groups are met, whatever their SimHash bits, on any grid."""
    monkeypatch.setattr(lines, "CELL", 16)
    rows = [(n, n % 3, n * 2654435761 % 2**32, n % 7 if n % 3 else 0, n % 7 == 0) for n in range(120)]
    keyed = spark.createDataFrame(rows, "line long, key long, bits long, label long, main boolean")
    text = spark.createDataFrame([(n, "x" * (10 + n % 2 * 40)) for n in range(120)], "line long, norm string")
    want = {(a, b) for a, k, _, u, m in rows for b, j, _, v, o in rows if a < b and k == j and u != v and not (m and o) and a % 2 == b % 2}
    assert {tuple(r) for r in lines.apart_pairs(keyed, text).collect()} == want
    # copies of one line that differ in many bits all go, also among many
    made = _copies([12], 30, 4)
    made = [made[0]] + [m for m in made[1:] if _distance(made[0], m) <= 0.2 * max(len(made[0]), len(m))]
    _, classes = lines.line_classes(frame(spark, list(enumerate(made))), "doc_id", "text")
    blocks = [sum(r[f"b{j}"] << 16 * j for j in range(4)) for r in classes.collect()]
    assert len(blocks) > 8 and max((a ^ b).bit_count() for a in blocks for b in blocks) > 2
    got = lines.deduplicated(frame(spark, list(enumerate(made)))).agg({"n_removed": "sum"}).first()[0]
    assert got == len(made) - 1


def test_short_and_blank_free_lines(spark):
    wide = "".join(chr(0x4E00 + k * 7919 % 20000) for k in range(60))
    few = "of the cat and a dog in our old hut by the sea we saw"
    made = ["short one", "Short one ", "   ", "   ", "\t", "\t", wide, wide[:30] + "x" + wide[31:], "one\ttwo\tthree\tfour\tfive\tsix words", "one\ttwo\tthree\tfour\tfive\tsix wards", few, few.replace("hut", "den")]
    got = {r["doc_id"]: r["n_removed"] for r in lines.deduplicated(frame(spark, list(enumerate(made))), short=True).collect()}
    assert got == {k: int(k in (1, 7, 9, 11)) for k in range(len(made))}


def test_html_stray_quotes():
    """A quote opens a value only right after the equals sign."""
    said = lambda page: [t for _, _, t in htmltext.parse(page)[1]]
    assert said('<p title="a"b">First words <a href="x">link</a> last') == ["First words ", "link", " last"]
    assert said("<a href=/it's>First</a> words <b>more</b>") == ["First", " words ", "more"]
    assert said("<p it's>One <i \">two</i> <b a = 'x>y' c=\"u>v\" d=e=\"f>three") == ["One ", "two", " ", "three"]
    assert htmltext.parse("<div class = 'side bar' id=main>x</div>")[0][1].names == ("side", "bar", "main")
    assert said('<p title="never closed>x') == []


def test_near_stage_repeated_rows_and_shared_ids(spark):
    import corpus_pipeline

    base = [f"word{k}" for k in range(60)]
    one, edited = " ".join(base), " ".join([*base[:-1], "changed"])
    other, third = " ".join(f"other{k}" for k in range(40)), " ".join(f"third{k}" for k in range(40))
    rows = [(2, one), (2, one), (3, edited), (3, other), (None, edited), (None, third), (None, third), (5, None), (5, None), (6, "")]
    left = corpus_pipeline.near_stage(spark, frame(spark, rows).repartition(3), SF)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = collections.Counter((r["doc_id"], r["text"]) for r in left.collect())
    assert got == collections.Counter([(2, one), (3, other), (None, third), (5, None), (5, None), (6, "")])


def test_decontamination_of_a_popular_item_with_either_half_edited(spark):
    item = [f"item{k}" for k in range(16)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    first, second = item[:8] + [f"new{k}" for k in range(8)], [f"new{k}" for k in range(8)] + item[8:]
    rows = [(n, " ".join(item)) for n in range(40)] + [(100, " ".join(first)), (101, " ".join(second))]
    got = {r["doc_id"]: r["leaks"] for r in decontaminate.with_matches(frame(spark, rows), bench).collect()}
    assert all(got[n] and got[n][0]["item"] == 1 for n in [*range(40), 100, 101])
