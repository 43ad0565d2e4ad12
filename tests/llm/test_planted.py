"""Planted cases: links between pages, exact ids, a foreign encoder's images."""


import duckdb
import numpy as np
import pytest

from dialoom.llm import op02_toxicity, op03_quality, op04_wrappers, op05_packing, op06_url_filters, op07_suffix_tree, op09_media

BIG = (1 << 53) + 1


def verdicts(spark, rows):
    """(page_id, verdict) of the operator, which must be the rows of the SQL too."""
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in op06_url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    con = duckdb.connect()
    con.sql("create table pages (page_id bigint, url varchar, html varchar)")
    if rows:
        con.executemany("insert into pages values (?, ?, ?)", rows)
    assert sorted(map(str, con.sql(op06_url_filters.ORACLE).fetchall())) == sorted(map(str, got))
    return {p: v for p, _, _, _, v in got}


def test_op6_all_links_of_a_page(spark):
    """Several links, a slash before ://, relative targets, character references, order of attributes, comments, chains."""
    refresh = '<META content="5;URL=\'{}\'" http-equiv=Refresh>'
    rows = [
        (1, "http://good.net/a", '<link rel=canonical href="/r?u=http://x.com/de/1">'),
        (2, "http://many.net/a", '<link rel="canonical" href="/own"><link rel="alternate canonical" href=\'http://x.com/de/2\'>' + refresh.format("/three")),
        (3, "http://many.net/three", None),
        (4, "http://many.net/own", ""),
        (5, "http://rel.net/x/y/z.html", '<link href="../w.html" rel="canonical">'),
        (6, "http://rel.net/x/w.html", '<link rel="canonical" href="./v/../../top?q=1&amp;r=2">'),
        (7, "http://rel.net/top?q=1&r=2", refresh.format("http://example.org/en/1x")),
        (8, "http://note.net/", '<!-- <link rel="canonical" href="http://x.com/de/3"> --><link rel="stylesheet canonicals" href="http://x.com/de/4">'),
        (9, "http://shut.net/1", '<link rel="canonical" href="https://y.com/de/">'),
        (10, "http://shut.net/2", '<link rel="canonical" href="mailto:a@x.com/de/">' + refresh.format("#top")),
        (11, "http://x.com/fr/9", '<link rel="canonical" href="http://shut.net/1#part">'),
        (12, "http://q.net/p?a=1", '<link rel="canonical" href="?b=2">'),
        (13, "http://q.net/p?b=2", '<link rel="canonical" href="//z.com/de/5">'),
        (14, "http://lone.net/", '<link rel="canonical" href="http://lone.net">'),
    ]
    got = verdicts(spark, rows)
    assert {p for p, v in got.items() if v == "block"} == {2, 3, 4, 5, 6, 7, 9, 12, 13}
    chain = [(i, f"http://c{i}.net/", f'<link rel="canonical" href="http://c{i + 1}.net/">') for i in range(12)] + [(12, "http://c12.net/", '<link rel=canonical href=http://com/de/>'), (13, "http://c12.org/", '<link rel=canonical href="http://c3.net">')]
    assert verdicts(spark, chain) == {i: "block" for i in range(13)} | {13: "allow"}
    assert verdicts(spark, []) == {}


def test_ids_stay_exact(spark):
    """A null id and one of more than 53 bits in one batch."""
    docs = spark.createDataFrame([(BIG, "some words of a text"), (None, "other words here"), (3, "x y")], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    want = {BIG, None, 3}
    for out in (
        op02_toxicity.score_toxicity(docs, labels),
        op03_quality.score_quality(docs, labels),
        op05_packing.packed(docs),
        op07_suffix_tree.score_texts(docs),
        op09_media.digest(docs),
        op09_media.tensors(op09_media.store(docs)),
    ):
        assert dict(out.dtypes)["doc_id"] == "bigint"
        assert {r.doc_id for r in out.collect()} == want
    pages = spark.createDataFrame([(BIG, "http://a.b/", "<p>one</p>"), (None, "http://a.b/", "<p>two</p>")], "page_id long, url string, html string").coalesce(1)
    assert {r.page_id for r in op04_wrappers.extract(pages).collect()} == {BIG, None}


def test_op9_wide_images():
    """More MCUs than rows allow make the image wider; nothing is lost."""
    assert op09_media.grid(1) == (1, 1) and op09_media.grid(64 * 4095) == (4095, 64)
    rows, columns = op09_media.grid(64 * 4095 + 1)
    assert rows <= 4095 and rows * columns > 64 * 4095
    payload = np.random.default_rng(2).integers(0, 256, 64 * 6 * 64 * 5, dtype=np.uint8).tobytes()
    jpeg = op09_media.encode(payload, most_rows=3)
    image, quantisers, comment = op09_media.read(jpeg)
    assert image.height == 48 and op09_media.payload_of(image, comment) == payload
    assert op09_media.to_rgb(image, quantisers).shape == (image.height, image.width, 3)


def java_jpeg(spark, rgb, grey=False):
    """A progressive JPEG by the Java runtime's encoder, and its decoder's RGB."""
    jvm = spark._jvm
    height, width = rgb.shape[:2]
    image = jvm.java.awt.image.BufferedImage(width, height, 10 if grey else 1)
    if grey:
        image.getRaster().setPixels(0, 0, width, height, ints(spark, rgb[:, :, 0].ravel()))
    else:
        image.getRaster().setPixels(0, 0, width, height, ints(spark, rgb.ravel()))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    settings = writer.getDefaultWriteParam()
    settings.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), settings)
    stream.flush()
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(out.toByteArray()))
    pixels = np.array(list(back.getRaster().getPixels(0, 0, width, height, ints(spark, np.zeros(rgb[:, :, :1].size if grey else rgb.size, int)))))
    return data, pixels.reshape(height, width, -1)


def ints(spark, values):
    array = spark.sparkContext._gateway.new_array(spark._jvm.int, len(values))
    for i, v in enumerate(values.tolist()):
        array[i] = v
    return array


@pytest.mark.parametrize("grey", [True, False])
def test_op9_decodes_a_foreign_progressive_jpeg(spark, grey):
    """Spectral selection, successive approximation and interleaved scans of another encoder; its own decoder is the reference."""
    y, x = np.mgrid[0:37, 0:45]
    rgb = np.stack([128 + 90 * np.sin(x / 9), 100 + 2 * y, 40 + 3 * x], axis=2).clip(0, 255).astype(int)
    if grey:
        rgb = np.repeat(rgb[:, :, :1], 3, axis=2)
    data, want = java_jpeg(spark, rgb, grey)
    assert b"\xff\xc2" in data and data.count(b"\xff\xda") > 4
    got = op09_media.decode(data).astype(int)
    assert got.shape == rgb.shape
    far = np.abs(got[:, :, : want.shape[2]] - want)
    assert far.max() <= (2 if grey else 24) and far.mean() < (0.6 if grey else 3)  # chroma is repeated here and smoothed there


def test_op9_features_come_from_the_stored_tensor(spark):
    docs = spark.createDataFrame([(1, "a text that is stored " * 40), (2, None)], "doc_id long, text string")
    tensors = {r.doc_id: np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3) for r in op09_media.tensors(op09_media.store(docs)).collect()}
    for r in op09_media.digest(docs).collect():
        means = [float(m) for m in r.feature.split(":")[1].split(",")]
        assert means == pytest.approx(tensors[r.doc_id].reshape(-1, 3).mean(axis=0).tolist(), abs=1e-4)


def test_op2_scores_by_brute_force():
    """The array form against a window by window, step by step computation in plain floats."""
    rng = np.random.default_rng(3)
    say = lambda k: " ".join(rng.choice([f"w{i}" for i in range(60)] + (["vile", "hateful"] if k else []), 70))
    texts = [say(i % 3 == 0).encode() for i in range(60)]
    net = op02_toxicity.train(texts, np.array([i % 3 == 0 for i in range(60)], float))
    check = [*texts[:6], b"", b"one", (" ".join(f"w{i % 60}" for i in range(200))).encode(), "Ünï cödé x-y".encode()]
    got = op02_toxicity.score_texts(net, check)
    want = [plain_score(net, t) for t in check]
    assert got == pytest.approx(want, abs=2e-4)


def plain_score(net, text):
    p, h = net.p, op02_toxicity.HIDDEN
    folded = bytes(b + 32 if 65 <= b <= 90 else b for b in text)
    words = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in folded).split()
    vectors = []
    for word in words:
        place, _, hashes, _, _ = op02_toxicity.words_of([word])
        codes = []
        for i in range(len(word)):
            b, c = (word[i + 1] if i + 1 < len(word) else 0), (word[i + 2] if i + 2 < len(word) else 0)
            codes.append((word[i] * 37 + b * 1009 + c * 30011) % op02_toxicity.TRIPLES)
        vectors.append(np.concatenate([p["words"][net.word_ids(hashes)[0]], np.mean([p["triples"][c] for c in codes], axis=0)]).astype(float) @ p["in"] + p["bias"])
    best = -np.inf
    starts = range(0, max(len(words) - op02_toxicity.WINDOW, 0) + op02_toxicity.STEP, op02_toxicity.STEP) if len(words) > op02_toxicity.WINDOW else [0]
    for s in starts:
        part = vectors[s : s + op02_toxicity.WINDOW]
        states = []
        for rows, u, off in ((part, p["u0"], 0), (part[::-1], p["u1"], 3 * h)):
            state, run = np.zeros(h), []
            for v in rows:
                x = v[off : off + 3 * h]
                gate = 1 / (1 + np.exp(-(x[: 2 * h] + state @ u[:, : 2 * h])))
                z, r = gate[:h], gate[h:]
                state = state + z * (np.tanh(x[2 * h :] + (r * state) @ u[:, 2 * h :]) - state)
                run.append(state)
            states.append(run if off == 0 else run[::-1])
        if part:
            rows = np.concatenate([np.array(states[0]), np.array(states[1])], axis=1)
            e = np.tanh(rows @ p["a"]) @ p["v"]
            alpha = np.exp(e - e.max())
            pooled = alpha / alpha.sum() @ rows
        else:
            pooled = np.zeros(2 * h)
        best = max(best, float(pooled @ p["w"] + p["b"][0]))
    return 1 / (1 + np.exp(-best))


def test_op3_scores_by_brute_force():
    """Sparse dot products against a dictionary of n-grams, with weights learned by a plain FTRL loop."""
    rng = np.random.default_rng(5)
    texts = [(" ".join(rng.choice(["good", "well", "made"] if i % 2 else ["bad", "spam!!", "BUY"], 12)) + f" x{i}").encode() for i in range(40)] + [b"", b" "]
    places, _, first = op03_quality.features(texts)
    rows = [(*op03_quality.example(places, int(first[i]), int(first[i + 1])), i % 2) for i in range(40)]
    weights = op03_quality.train(rows)
    z, n = {}, {}
    o = op03_quality

    def weight(k):
        a = z.get(k, 0.0)
        return 0.0 if abs(a) <= o.L1 else (np.sign(a) * o.L1 - a) / ((o.BETA + np.sqrt(n.get(k, 0.0))) / o.ALPHA + o.L2)

    for _ in range(o.EPOCHS):
        for at, value, label in rows:
            w = [weight(k) for k in at.tolist()]
            g = 1 / (1 + np.exp(-np.clip(sum(a * b for a, b in zip(w, value, strict=True)), -35, 35))) - label
            for k, v, old in zip(at.tolist(), value.tolist(), w, strict=True):
                step = (np.sqrt(n.get(k, 0.0) + (g * v) ** 2) - np.sqrt(n.get(k, 0.0))) / o.ALPHA
                z[k] = z.get(k, 0.0) + g * v - step * old
                n[k] = n.get(k, 0.0) + (g * v) ** 2
    for i, got in enumerate(op03_quality.scores(texts, weights).tolist()):
        at, value = op03_quality.example(places, int(first[i]), int(first[i + 1]))
        dot = sum(weight(k) * v for k, v in zip(at.tolist(), value.tolist(), strict=True))
        assert got == pytest.approx(1 / (1 + np.exp(-dot)), abs=1e-5)


def neutral_pages(n=12, seed=4):
    """(html, article) of pages of one host without a telling tag or name: a varying menu of links, a varying line, an article, a constant notice, a varying footer."""
    rng = np.random.default_rng(seed)
    say = lambda k: " ".join(rng.choice([f"w{i}" for i in range(500)], k))
    out = []
    for i in range(n):
        article = [say(int(rng.integers(8, 40))) for _ in range(int(rng.integers(1, 9)))]
        menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in say(4).split())
        body = "".join(f"<p>{t}</p>" for t in article[1:])
        html = f'<body><div class="c1"><ul>{menu}</ul></div><div class="c2">{say(5)}</div><div class="c3"><h1>{article[0]}</h1>{body}</div><div class="c4">All rights are kept by us</div><div class="c5">{say(4)}</div></body>'
        out.append((html, "\n".join(article)))
    return out


def test_op4_finds_content_without_names(spark, monkeypatch):
    """Only alignment and what varies tell the article; wrappers that are joined, by salted hosts, give the same as broadcast ones."""
    given = neutral_pages()
    rows = [(i, f"http://neutral.net/{i}", h) for i, (h, _) in enumerate(given)] + [(100, "http://alone.net/", given[0][0]), (101, None, None), (102, "http://neutral.net/x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in op04_wrappers.extract(pages).collect()}
    for i, (_, article) in enumerate(given):
        assert got[i] == article
    assert got[100] and got[101] == got[102] == ""
    monkeypatch.setattr(op04_wrappers, "BROADCAST_BYTES", -1)
    assert {r.page_id: r.text for r in op04_wrappers.extract(pages).collect()} == got


def test_op4_markup_inside_words_and_several_articles(spark):
    html = '<body><div><a href="/x">menu</a></div><article><h2>One</h2><p>super<wbr>cali <img src="x">fra<b>gi</b>l<br>istic</p></article><article><p>Second text stands here.</p></article><article class="comment"><p>a reader</p></article></body>'
    pages = spark.createDataFrame([(1, "http://two.net/", html)], "page_id long, url string, html string")
    row = op04_wrappers.extract(pages).first()
    assert row.text == "One\nsupercali fragil istic\nSecond text stands here." and row.n_chars == len(row.text)


def test_op4_ties_are_stable(spark):
    """Pages of equal texts and different shapes, and repeated rows: the same result in any order."""
    rows = [(i, "http://tie.net/", f"<div>{'<p>same text</p>' if i % 2 else '<section><p>same text</p></section>'}</div>") for i in range(8)]
    schema = "page_id long, url string, html string"
    one, two = (sorted((r.page_id, r.text) for r in op04_wrappers.extract(spark.createDataFrame(x, schema)).collect()) for x in (rows, rows[::-1]))
    assert one == two
