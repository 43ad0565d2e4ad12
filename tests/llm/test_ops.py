"""The training-text operators against brute force, round trips and held-out accuracy, and their corner cases."""

import hashlib
import itertools
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.llm import blocks as B
from dialoom.llm import (
    op01_substring,
    op02_toxicity,
    op03_quality,
    op04_wrappers,
    op05_packing,
    op06_url_filters,
    op07_suffix_tree,
    op08_jaccard,
    op09_media,
    op10_decontaminate,
    queries,
)
from dialoom.llm.components import connected_components
from dialoom.session import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text, fold=False):
    data = (text or "").encode()
    return (data.translate(FOLD) if fold else data).split()


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, shared passages, nulls in every column, blank, short, long and unusual texts, equal ids."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = say(60), say(300)
    texts = [None, "", " \t\n", "one", "one", "One two", "é è x", "a " * 50, say(20000), base, base, base]
    for _ in range(8):
        w = base.split()
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [say(rng.randint(1, 200)) + " " + passage + "\n" + say(rng.randint(0, 200)) for _ in range(6)]
    texts += [say(rng.randint(1, 120)) for _ in range(20)]
    texts += [passage[:-3], "x" * 5000, "中文 text <|endoftext|> don't " * 12]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, "no id here at all", None, None, None), rows[9], (5, base, "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def widened(df):
    """The same rows with extra columns of clashing names."""
    out = df
    for name in ("key", "_key", "copies", "bucket", "payload", "shard", "n_words", "score", "label", "host", "hits", "w", "h"):
        out = out.withColumn(name, F.lit("clash"))
    return out


def test_op1_brute_force(docs, empty):
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    seen = Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    expected = Counter()
    for doc, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected[doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    got = op01_substring.digest(widened(docs)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == expected
    assert any(r.n_removed for r in got)
    assert op01_substring.digest(empty).count() == 0


def test_op1_cover_meets_every_shift():
    cover, period = op01_substring.COVER, op01_substring.PERIOD
    for shift in range(period):
        assert any((k in cover) and ((k + shift) % period in cover) for k in range(period))


def test_clashing_columns_survive(spark, docs):
    wide = widened(docs).withColumn("_label", F.lit("x")).withColumn("_row", F.lit(1)).withColumn("n_shingles", F.lit(2)).withColumn("_kept", F.lit(3))
    bench = spark.createDataFrame([(1, "some words that no text at all holds")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").limit(0)
    for out in (op01_substring.without_passages(wide), op08_jaccard.keep_one(wide), op10_decontaminate.decontaminate(wide, bench), op03_quality.keep_good(wide, labels)):
        assert out.columns == wide.columns
        assert out.where("_label = 'x' and _row = 1 and key = 'clash'").count() == out.count() > 0


def test_op1_columns(docs):
    out = op01_substring.without_passages(docs)
    assert out.columns == docs.columns
    assert out.count() == docs.count()
    full = op01_substring.substring_dedup(docs)
    assert full.where("text is not null and n_removed > 0").where(F.length("text") != F.col("n_chars")).count() == 0


def test_op2_learns_and_scores(spark, empty):
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    rows, labels = [], []
    for i in range(500):
        toxic = i % 4 == 0
        w = say(rng.randint(5, 200)).split()
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["badword", "vileword"]))
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(9000, None, None, None, None), (None, "", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame(labels + [(None, None, None), (3, None, None)], "doc_id long, quality int, toxic int")
    got = op02_toxicity.score_toxicity(widened(docs), lab).collect()
    assert len(got) == len(rows)
    truth = {d: t for d, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert op02_toxicity.score_toxicity(docs, lab.limit(0)).where("score = 0").count() == len(rows)
    assert op02_toxicity.score_toxicity(empty, lab).count() == 0


def test_op2_gradient():
    net = op02_toxicity.Network(np.array([5], np.uint64), np.zeros(1, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x = rng.standard_normal((7, 3, 6 * op02_toxicity.HIDDEN))
    length, y = np.array([7, 4, 1]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = op02_toxicity._sigmoid(net.forward(x, length))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    keep = {}
    p = op02_toxicity._sigmoid(net.forward(x, length, keep))
    g, dx = net.backward(keep, p - y)
    for name in ("u0", "u1", "a", "v", "w", "b"):
        i = tuple(0 for _ in net.p[name].shape)
        old = net.p[name][i]
        net.p[name][i] = old + 1e-5
        up = loss()
        net.p[name][i] = old - 1e-5
        down = loss()
        net.p[name][i] = old
        assert g[name][i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-5)
    old = x[2, 1, 3]
    x[2, 1, 3] = old + 1e-5
    up = loss()
    x[2, 1, 3] = old - 1e-5
    assert dx[2, 1, 3] == pytest.approx((up - loss()) / 2e-5, rel=1e-3, abs=1e-5)


def test_op2_windows_cover_all_words():
    for n in (0, 1, 47, 48, 49, 84, 85, 1000):
        start, length, _ = op02_toxicity.windows(np.array([0, n]))
        assert set(itertools.chain.from_iterable(range(a, a + k) for a, k in zip(start, length, strict=True))) == set(range(n))


def test_op3_held_out(spark, docs, empty):
    d, lab = table(spark, SF.replace("sf0.001", "sf0.01"), "documents"), table(spark, SF.replace("sf0.001", "sf0.01"), "labels")
    truth = {r.doc_id: r.quality for r in lab.collect()}
    got = op03_quality.score_quality(d, lab).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in got)
    odd = op03_quality.score_quality(widened(docs), lab).collect()
    assert len(odd) == docs.count()
    assert all(0 <= r.score <= 1 for r in odd)
    assert op03_quality.score_quality(empty, lab).count() == 0
    assert {r.score for r in op03_quality.score_quality(docs, lab.limit(0)).collect()} == {0.5}
    kept = op03_quality.keep_good(d, lab)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site {h}</header><nav><ul><li><a href=/a>Menu {i}</a></li></ul></nav>
<div class="ad">Buy {i}</div>{open}<h1>Title {i}</h1><p>First &amp; {i}<br>line<p><b>Second   {i}</p><div class="comments"><p>nice {i}</p></div>{close}<div class=sidebar>Side {i}</div><footer>&copy; {h}</footer></body></html>"""


def test_op4_extracts(spark):
    rows = [(i, f"http://h{i % 2}.org/p{i}", PAGE.format(i=i, h=i % 2, open="<article>", close="</article>")) for i in range(12)]
    rows += [(100 + i, f"http://plain.org/p{i}", PAGE.format(i=i, h="x", open="<div>", close="<p>Always the same words</p></div>")) for i in range(6)]
    rows += [(200, None, None), (201, "nonsense", ""), (202, "http://cut.org/", "<article><p>half a sent"), (203, "http://cut.org/", "<p>x<scr"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = defaultdict(list)
    for r in op04_wrappers.extract(widened(pages)).collect():
        got[r.page_id].append(r)
    for i in range(12):
        assert got[i][0].text == f"Title {i}\nFirst & {i} line\nSecond {i}"
    for i in range(6):
        assert got[100 + i][0].text == f"Title {i}\nFirst & {i} line\nSecond {i}"
    assert len(got[0]) == 2
    assert [got[k][0].text for k in (200, 201, 202, 203)] == ["", "", "half a sent", "x"]
    assert all(len(r.text) == r.n_chars for rs in got.values() for r in rs)
    assert op04_wrappers.extract(pages.limit(0)).count() == 0


def test_op4_tree_matching():
    assert op04_wrappers.align("a(b()c())", "a(b()x()c())") == {0: 0, 1: 1, 2: 3}
    assert op04_wrappers.align("a(b(d())c())", "a(c())")[2 + 1] == 1
    root, blocks = op04_wrappers.parse("<ul><li>a<li>b<ul><li>c</ul></ul>" + "<div>" * 3000 + "deep")
    assert [t for _, t, _ in blocks] == ["a", "b", "c", "deep"]


def test_op4_aligns_trees_of_any_size(spark, monkeypatch):
    def size(a, b):
        if a[0] != b[0]:
            return 0
        best = defaultdict(int)
        for i, p in enumerate(a[1], 1):
            for j, q in enumerate(b[1], 1):
                best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + size(p, q))
        return 1 + best[len(a[1]), len(b[1])]

    grow = lambda d: (rng.choice("ab"), [grow(d - 1) for _ in range(rng.randint(0, 3))] if d else [])
    write = lambda t: f"{t[0]}({''.join(write(c) for c in t[1])})"
    rng = random.Random(2)
    for cells in (1, op04_wrappers.CELLS):
        monkeypatch.setattr(op04_wrappers, "CELLS", cells)
        for _ in range(150):
            a, b = grow(4), grow(4)
            got = op04_wrappers._match(write(a), write(b))
            assert len(got) == len(set(got.values())) == size(a, b)
            labels = [[x for x in write(t) if x in "ab"] for t in (a, b)]
            assert all(labels[0][i] == labels[1][j] for i, j in got.items())


def test_op4_large_pages_lose_template(spark):
    page = lambda n, k: "<article>" + "".join(f"<div class='{chr(97 + i % 23)}'><p>word{k} number{i}</p></div>" for i in range(n)) + "<div class='tail'>The same line on each page.</div></article>"
    rows = [(k, f"https://large{h}.org/{k}", page(6 + k if k < 5 else 300, 10 * h + k)) for h in range(6) for k in range(6)]
    for r in op04_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert "number4" in r.text and "same line" not in r.text


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(op05_packing.tokenizer_path())
    ids = defaultdict(list)
    for doc, text in texts:
        ids[doc].append(np.array(tk.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, held in ids.items():
        assert sum(n for _, n in pieces[doc]) == sum(map(len, held))
        if len(held) == 1:
            assert [a for a, _ in sorted(pieces[doc])] == list(itertools.accumulate([n for _, n in sorted(pieces[doc])], initial=0))[:-1]
    waste = 0
    for held in sequences.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 2048
        waste += (2048 - at) if at & (at - 1) else 0
    return waste


def test_op5_round_trip(docs, empty):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert check_packing(op05_packing.packed(widened(docs)).collect(), texts) == 0
    assert op05_packing.packed(empty).count() == 0


def test_op5_tokenizer_fuzz():
    from tokenizers import Tokenizer

    tk, own = Tokenizer.from_file(op05_packing.tokenizer_path()), op05_packing.encoder(op05_packing.tokenizer_path())
    rng = random.Random(1)
    alphabet = "abZ's'tLL ééß×²x1,.!?_-<|endoftext|> 中ﬁİǅ\x00\x1c 　 \U0001f600"
    cases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for case, got in zip(cases, own([c.encode() for c in cases]), strict=True):
        assert np.array(tk.encode(case, add_special_tokens=False).ids, dtype="<u4").tobytes() == got


def test_op5_placement_minimises_squares():
    rng = np.random.default_rng(2)
    levels = op05_packing.LevelArray(16)
    for _ in range(400):
        size, c = int(rng.integers(1, 16)), levels.count[:17].copy()
        options = {}
        for h in range(0, 17 - size):
            if h == 0 or c[h] > 0:
                d = c.copy()
                d[h] -= h > 0
                d[h + size] += h + size < 16
                options[h] = int((d[1:16] ** 2).sum())
        _, level = levels.place(size)
        assert options[level] == min(options.values())


def test_op6_rules_and_aliases(spark):
    canon = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.example.org/en/123", None),
        (2, "HTTP://A.Example.ORG/es/x?y#z", ""),
        (3, "http://x.com/de/1", ""),
        (4, "http://mirror.net/1", canon.format("https://x.com/de/1")),
        (5, "http://mirror.net/2", '<meta http-equiv="refresh" content="0; url=http://mirror.net/1">'),
        (6, "http://x.com/fr/1", canon.format("http://mirror.net/2/")),
        (7, "http://other.net/", canon.format("/home")),
        (8, None, canon.format("http://x.com/de/1")),
        (9, "no scheme", ""),
        (10, "http://norg/x", ""),
        (10, "http://org?x", ""),
        (11, "http://org/#f", ""),
    ]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in op06_url_filters.judge(widened(spark.createDataFrame(rows, "page_id long, url string, html string")).drop("host")).collect()]
    assert set(got) == {
        (1, "a.example.org", "/en/123", "example.org/en/1", "block"),
        (2, "a.example.org", "/es/x", "example.org/es/", "block"),
        (3, "x.com", "/de/1", "com/de/", "block"),
        (4, "mirror.net", "/1", None, "block"),
        (5, "mirror.net", "/2", None, "block"),
        (6, "x.com", "/fr/1", "com/fr/", "allow"),
        (7, "other.net", "/", None, "allow"),
        (8, "", "", None, "allow"),
        (9, "", "", None, "allow"),
        (10, "norg", "/x", None, "allow"),
        (10, "org", "", None, "allow"),
        (11, "org", "/", "org/", "allow"),
    }
    con = duckdb.connect()
    con.sql("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    assert sorted(map(str, con.sql(op06_url_filters.ORACLE).fetchall())) == sorted(map(str, got))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, j) for j in range(1, 50)] + [(7, 7), (None, 3), (500, 501)]
    got = {r.id: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100}
    assert {got[i] for i in range(50)} == {0}
    assert got[501] == 500
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op7_counts_and_base(docs, empty):
    rows = [(r.doc_id, words(r.text, True) + [None]) for r in docs.collect()]
    c = Counter(w for d, ws in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    expected = Counter((d, None if d is None else zlib.crc32(str(d).encode()) % 7 == 2, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for d, ws in rows)
    got = op07_suffix_tree.score_texts(widened(docs)).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == expected
    assert op07_suffix_tree.score_texts(empty).count() == 0


def brute_scores(rows, depth):
    """Scores of (held out, words) by dictionaries, and the retained contexts; a missing word is the end."""
    train = [["<s>", *ws] for held, ws in rows if held is False]
    n, root = sum(len(t) - 1 for t in train), Counter(w for t in train for w in t[1:])
    v = len(root)
    counts = Counter(tuple(t[i - k : i + 1]) for t in train for i in range(1, len(t)) for k in range(1, depth + 1) if i - k >= 0)
    totals = Counter((w,) for t in train for w in t[:-1]) + counts
    entries = defaultdict(dict)
    for g, c in counts.items():
        if c >= 2:
            entries[g[:-1]][g[-1]] = c
    retained = {}

    def p(context, w):
        out = (root[w] + 1) / (n + v + 1)
        for k in range(1, len(context) + 1):
            c = context[-k:]
            if c not in retained:
                break
            out = (entries[c][w] - 0.75) / totals[c] + retained[c] * out if w in entries[c] else retained[c] * out
        return out

    for c in sorted(entries, key=len):
        if len(c) > 1 and c[1:] not in retained:
            continue
        under = {w: counts[c[1:] + (w,)] / totals[c[1:]] if len(c) > 1 else root[w] / n for w in entries[c]}
        total, kept = totals[c], sum(entries[c].values())
        gain = sum(x * math.log(x / total / under[w]) for w, x in entries[c].items())
        if kept < total:
            gain += (total - kept) * math.log((total - kept) / total / max(1 - sum(under.values()), 1e-12))
        if gain >= op07_suffix_tree.RETAIN:
            retained[c] = 1 - sum(x - 0.75 for x in entries[c].values()) / total
    return [sum(math.log10(p(tuple(["<s>", *ws][max(0, i + 1 - depth) : i + 1]), w)) for i, w in enumerate(ws)) for _, ws in rows], retained


@pytest.mark.parametrize(("depth", "tokens"), [(1, 1 << 20), (2, 1 << 20), (3, 1 << 20), (2, 300)])
def test_op7_scores_by_brute_force(spark, docs, monkeypatch, depth, tokens):
    """Contexts of one, two and three symbols; with texts cut into blocks of 300 symbols too. A null doc_id stands beside one of more than 53 bits."""
    rng = random.Random(6)
    more = [(100 + i, " ".join(f"k{k} x y p{k} z y q" for k in rng.choices(range(6), k=30))) for i in range(12)] + [((1 << 53) + 1, "k1 x y p1"), (None, "k1 x y p2")]
    given = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r.doc_id, words(r.text, True) + [None]) for r in given.collect()]
    expected, retained = brute_scores([(None if d is None else zlib.crc32(str(d).encode()) % 7 == 2, ws) for d, ws in rows], depth)
    assert (b"y",) in retained and ((b"x", b"y") in retained) == (depth > 1) and (depth < 3 or (b"k1", b"x", b"y") in retained)
    given = given.coalesce(2)
    if tokens < 1 << 20:
        cutting = op07_suffix_tree._tokenise.__globals__
        monkeypatch.setitem(cutting, "BLOCK_TOKENS", tokens)
        frame = given.toPandas()
        held = [d == d and zlib.crc32(str(int(d)).encode()) % 7 == 2 for d in frame["doc_id"]]
        plain = [(0 if d != d else int(d), d != d, h, t) for d, h, t in zip(frame["doc_id"], held, frame["text"], strict=True)]
        got = local_scores(plain, depth)
        for score, e in zip(got, brute_scores([(None if v else h, words(t, True) + [None]) for _, v, h, t in plain], depth)[0], strict=True):
            assert score == pytest.approx(e, rel=1e-5, abs=1e-5)
        return
    got = op07_suffix_tree.score_texts(given, depth).collect()
    key = lambda r: (r[0] or -1, r[1], r[2])
    want = sorted(((d or -1, len(ws), e) for (d, ws), e in zip(rows, expected, strict=True)), key=key)
    for (d, n, score), r in zip(want, sorted(((r.doc_id, r.n_tokens, r.score) for r in got), key=key), strict=True):
        assert (d, n) == (r[0] or -1, r[1])
        assert r[2] == pytest.approx(score, rel=1e-5, abs=1e-5)


def local_scores(rows, depth, n_buckets=5):
    """The operator's blocks, questions and answers in this process; the scores in the order of ``rows`` (doc, void, held, text)."""
    import pandas as pd
    import pyspark

    o = op07_suffix_tree
    context = pyspark.TaskContext.get
    pyspark.TaskContext.get = classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})())
    try:
        blocks = pd.concat(list(o._tokenise(iter([pd.DataFrame(rows, columns=["doc", "void", "held", "text"])]), depth)), ignore_index=True)
    finally:
        pyspark.TaskContext.get = context
    assert len(blocks) > 5
    answers, n, v = pd.DataFrame(columns=["block", "round", "bucket", "payload"]), 0, 0
    for number in range(1, depth + 2):
        asked = pd.concat([o._asked(o._play(r, answers[answers["block"] == r["block"]], depth, n, v, number - 1), r["block"], number, n_buckets) for _, r in blocks.iterrows()])
        new = pd.concat([o._answers(number)(g) for _, g in asked.groupby("bucket")])
        if number == 1:
            n, v = int(new["n"].sum()), int(new["v"].sum())
        answers = pd.concat([answers, new[new["block"] >= 0]])
    parts = pd.concat([o._play(r, answers[answers["block"] == r["block"]], depth, n, v, depth + 1).scores() for _, r in blocks.iterrows()])
    return parts.groupby("row")["score"].sum().tolist()


def test_op7_without_training_rows(spark):
    """Every row held out or without id: nothing is known, and the scores are those of the base, 0."""
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = op07_suffix_tree.score_texts(spark.createDataFrame([(held, "a b c"), (None, "a b c"), (held, None)], "doc_id long, text string")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 0, 0, 0.0, 0.0), (4, 0, 0, 0.0, 0.0), (4, 0, 0, 0.0, 0.0)]


def test_op7_rare_phrase_stays_in_a_large_corpus(spark):
    """Five times in 120,000 tokens, under a share of 2**-14, as are many words: its words and runs are learned as in a small corpus."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    seldom = [f"s{i}" for i in range(4000)]
    phrase = " ".join(f"rare{i}" for i in range(12))
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = next(i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(i, " ".join(rng.choice(seldom if j % 8 == 0 else vocabulary) for j in range(400)) + (" " + phrase if k < 5 else "")) for k, i in enumerate(ids)] + [(held, phrase)]
    got = {r.doc_id: r for r in op07_suffix_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held].train_tokens > 5 << 14
    assert got[held].score > got[held].base_score + 30


def brute_components(rows):
    sets = []
    for d, t in rows:
        w = words(t, True)
        sets.append((d, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), (least.get(find(i)) if s else d)) for i, (d, s) in enumerate(sets))


def test_op8_brute_force(docs, empty):
    got = op08_jaccard.digest(widened(docs)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert op08_jaccard.digest(empty).count() == 0


def test_op8_large_groups(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"v{rng.randrange(999)}" for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(120)] = f"z{rng.randrange(9999)}"
        rows.append((i, " ".join(w), "en", "s", 1))
    monkeypatch.setattr(op08_jaccard, "LOCAL", 8)
    monkeypatch.setattr(op08_jaccard, "CHUNK", 16)
    got = op08_jaccard.digest(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components([r[:2] for r in rows])


def test_op8_signatures_lose_no_pair():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        keep = a[rng.random(len(a)) > rng.random() * 0.3]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 6) + 1)), dtype=np.uint64)]))
        if op08_jaccard.linked(a, b):
            codes, owner = op08_jaccard.signatures([a, b])
            assert set(codes[owner == 0].tolist()) & set(codes[owner == 1].tolist())
            assert 7 * op08_jaccard.distance(op08_jaccard.parity(a), op08_jaccard.parity(b)) <= len(a) + len(b)


def test_op8_keeps_one_of_each(docs):
    kept = op08_jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    parts = op08_jaccard.components(docs).collect()
    assert kept.count() == len({r._label for r in parts if r.n_shingles}) + sum(1 for r in parts if not r.n_shingles)


def test_op9_round_trip(docs, empty):
    got = op09_media.digest(widened(docs)).collect()
    expected = Counter()
    for r in docs.collect():
        t = (r.text or "").encode()
        p = t + b"\0" * (-len(t) % 64 or (0 if t else 64))
        expected[r.doc_id, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == expected
    assert op09_media.digest(empty).count() == 0
    media = op09_media.store(docs.where("length(text) < 3000"))
    t = op09_media.tensors(media).first()
    assert len(t.rgb) == t.height * t.width * 3


def test_op9_symbolwise_equals_arrays(monkeypatch):
    for n in (64, 384, 640, 6400):
        p = os.urandom(n)
        jpeg = op09_media.encode(p)
        fast = op09_media.read(jpeg)[0].coefficients
        with monkeypatch.context() as m:
            m.setattr(op09_media.Huffman, "fixed", lambda self, runs: 0)
            slow = op09_media.read(jpeg)[0].coefficients
        assert all((a == b).all() for a, b in zip(fast, slow, strict=True))


def ac_scans(blocks, start, end):
    """Bits of a first (point transform 1) and a refining AC scan with runs, long runs and ends of blocks, symbol lengths 8."""
    table = op09_media._table({s: 8 for s in range(255)})
    of = op09_media.Huffman(*table).of
    first, second = [], []

    def put(out, value, n):
        out += [value >> i & 1 for i in range(n - 1, -1, -1)]

    for b in blocks:
        run = 0
        for k in range(start, end + 1):
            v = int(np.sign(b[k])) * (abs(int(b[k])) >> 1)
            if not v:
                run += 1
                continue
            while run > 15:
                put(first, *of[0xF0])
                run -= 16
            size = abs(v).bit_length()
            put(first, *of[run << 4 | size])
            put(first, v if v > 0 else v + (1 << size) - 1, size)
            run = 0
        if run:
            put(first, *of[0])
        known = [abs(int(b[k])) > 1 for k in range(64)]
        fresh = [k for k in range(start, end + 1) if abs(int(b[k])) == 1]
        k = start
        for f in fresh:
            zeros = [i for i in range(k, f) if not known[i]]
            while len(zeros) > 15:
                put(second, *of[0xF0])
                stop = zeros[15]
                second += [abs(int(b[i])) & 1 for i in range(k, stop + 1) if known[i]]
                k, zeros = stop + 1, zeros[16:]
            put(second, *of[len(zeros) << 4 | 1])
            second.append(int(b[f] > 0))
            second += [abs(int(b[i])) & 1 for i in range(k, f) if known[i]]
            k = f + 1
        if k <= end:
            put(second, *of[0])
            second += [abs(int(b[i])) & 1 for i in range(k, end + 1) if known[i]]
    return table, first, second


def test_op9_general_scans():
    rng = np.random.default_rng(6)
    blocks = np.where(rng.random((12, 64)) < 0.25, rng.integers(-60, 61, (12, 64)), 0)
    table, first, second = ac_scans(blocks, 1, 63)
    got = np.zeros((12, 64), np.int16)
    data = lambda bits: np.packbits(np.array(bits + [1] * (-len(bits) % 8), np.uint8)).tobytes()
    op09_media._ac_first(op09_media._Bits(data(first)), op09_media.Huffman(*table), got, 1, 63, 1)
    assert (got[:, 1:] == np.sign(blocks[:, 1:]) * (np.abs(blocks[:, 1:]) >> 1) * 2).all()
    op09_media._ac_refine(op09_media._Bits(data(second)), op09_media.Huffman(*table), got, 1, 63, 0)
    assert (got[:, 1:] == blocks[:, 1:]).all()


def test_op9_flat_colour():
    im = op09_media.Image(b"\x08" + (16).to_bytes(2, "big") * 2 + b"\x03" + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    im.coefficients[0][:, :, 0] = 8 * 20
    rgb = op09_media.to_rgb(im, {0: np.ones(64, np.int32)})
    assert rgb.shape == (16, 16, 3)
    assert (rgb == 148).all()


def test_op10_brute_force(spark, docs, empty):
    texts = {r.doc_id: r.text for r in docs.collect()}
    passage = " ".join(texts[22].split()[-40:-5])
    half = " ".join(texts[9].split()[10:30]) + " changed " + " ".join(texts[9].split()[31:50])
    items = [(1, passage), (2, half), (3, None), (4, " "), (5, "one"), (6, "nowhere to be found in any text"), (None, passage), (1, passage)]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def shingles(t):
        w = (t or "").lower().encode().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    expected = Counter()
    for r in docs.collect():
        own = shingles(r.text)
        for item, t in items:
            s = shingles(t)
            if s and 100 * len(own & s) >= 75 * len(s):
                expected[r.doc_id, item, len(own & s), len(s)] += 1
    got = op10_decontaminate.contaminated(widened(docs), bench.withColumn("key", F.lit(1))).collect()
    assert expected
    assert Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got) == expected
    clean = op10_decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    bad = {k[0] for k in expected}
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in docs.collect() if not (r.text and any(shingles(t) and 100 * len(shingles(r.text) & shingles(t)) >= 75 * len(shingles(t)) for _, t in items)))
    assert bad
    assert op10_decontaminate.contaminated(empty, bench).count() == 0
    assert op10_decontaminate.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    expected = con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(expected.columns)
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(str(tuple(dict(zip(expected.columns, r, strict=True))[c] for c in cols)) for r in expected.fetchall())


def test_words_in_long_texts_match(monkeypatch):
    monkeypatch.setattr(B, "PIECE_BYTES", 64)
    rng = random.Random(0)
    texts = [" ".join("ab"[rng.randrange(2)] * rng.randint(1, 90) for _ in range(rng.randint(0, 40))).encode() for _ in range(20)]
    short, owner = B.words_of(texts)
    monkeypatch.setattr(B, "PIECE_BYTES", 1 << 21)
    whole, other = B.words_of(texts)
    assert (short == whole).all()
    assert (owner == other).all()
    assert len(whole) == sum(len(t.split()) for t in texts)
