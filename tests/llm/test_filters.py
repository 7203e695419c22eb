"""Quality rules, classifier, decontamination and HTML extraction."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tributary.llm import arrays, decontaminate, html_text, quality_classifier, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(0x41, 0x5B)}


def test_rule_counts(docs, no_docs, texts):
    want = Counter()
    for i, t in texts:
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = [False] * len(w)
        for k in range(len(w) - 2):
            if grams[tuple(w[k : k + 3])] > 1:
                again[k : k + 3] = [True] * 3
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * sum(again) > 50 * len(w)
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(again), failed] += 1
    out = quality_rules.quality_rules(docs)
    assert Counter(tuple(r)[:7] for r in out.collect()) == want
    assert out.where("kept and base_failed").count() == 0 and out.where("kept").count() > 3
    assert quality_rules.quality_rules(no_docs).count() == 0


def test_viterbi_equals_all_labellings():
    import itertools

    rng = np.random.default_rng(1)
    bounds = np.array([0, 1, 1, 6, 13])
    for _ in range(50):
        e, stay = rng.normal(0, 2, 13), float(rng.uniform(0.1, 2))
        got = quality_rules.viterbi(e, bounds, stay)
        for a, b in zip(bounds[:-1], bounds[1:]):
            score = lambda y: sum(x for x, s in zip(e[a:b], y) if s) + stay * sum(1 if p == q else -1 for p, q in zip(y, y[1:]))
            best = max(itertools.product((False, True), repeat=int(b - a)), key=score)
            assert score(got[a:b].tolist()) == pytest.approx(score(best))


def test_field_fits_and_keeps_clean_text():
    rng = np.random.default_rng(2)
    sequences = []
    for k in range(40):
        y = np.full(6, k % 2 == 0)
        sequences.append((np.stack([np.ones(6), rng.normal(1 if y[0] else -1, 1, 6)], 1), y))
    weights, stay = quality_rules.fit(sequences, 60)
    assert weights[1] > 0.3 and stay > 0.1
    clean = "\n".join(f"This is line {k} of a plain text, which says something about topic {k * 7} and no more." for k in range(12))
    items = "\n".join(f"- item number {k} with a few words" for k in range(20))
    junk = " ".join(f"w{k}###" for k in range(80))
    parts = list(arrays.slices(pa.array([clean, items, junk])))
    _, share = quality_rules.content_shares(quality_rules.Lines(parts[0]), quality_rules.WEIGHTS, quality_rules.STAY)
    assert share[0] == 1 and share[1] == 1 and share[2] == 0


def test_field_is_reproducible(spark):
    """The module's weights are what its own sample of labelled documents gives."""
    d = "/root/testdata/sf0.1"
    weights, stay = quality_rules.fitted(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    assert np.abs(weights - quality_rules.WEIGHTS).max() < 0.006 and abs(stay - quality_rules.STAY) < 0.006


def test_marginals_equal_all_labellings():
    import itertools

    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 1, (5, 2)), np.array([True, True, False, True, False])
    before = quality_rules.fit([(x, y)], 3)[0], quality_rules.fit([(x, y)], 3)[1]
    # One step of gradient ascent from there, by sums over all labellings.
    weights, stay = before
    labels = list(itertools.product((0, 1), repeat=5))
    agree = [sum(1 if a == b else -1 for a, b in zip(t, t[1:])) for t in labels]
    score = np.array([np.dot(x @ weights, t) + stay * a for t, a in zip(labels, agree)])
    p = np.exp(score - np.logaddexp.reduce(score))
    slope = x.T @ (y - p @ np.array(labels))
    slope_stay = sum(1 if a == b else -1 for a, b in zip(y, y[1:])) - p @ np.array(agree)
    after = quality_rules.fit([(x, y)], 4)
    assert after[0] == pytest.approx(weights + 0.3 * (slope / 5 * 10 - 1e-3 * weights)) and after[1] == pytest.approx(np.clip(stay + 0.3 * slope_stay / 5, 0.05, 2))


def test_classifier_features_and_scores_by_loops(spark):
    """Word vectors, pooling and the network's score from their definitions, on a few texts."""
    q = quality_classifier
    texts = ["the cat sat, the cat ran", "dogs ran!! the end", "", "é ü é ü x", None, "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    bucket = lambda w: int(q.bucketed(next(iter(arrays.slices(pa.array([w], pa.binary())))))[0][0])
    split = [[bucket(w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    sums = {}
    for words in split:
        for k, b in enumerate(words):
            for j in range(max(0, k - q.REACH), min(len(words), k + q.REACH + 1)):
                v = sums.setdefault(b, [0.0] * q.DIM)
                for at, sign in zip(q.INDEX_AT[words[j]], q.INDEX_SIGN[words[j]]) if j != k else ():
                    v[at] += sign
    sums = {b: v for b, v in sums.items() if any(v)}
    centre = [sum(v[d] for v in sums.values()) / len(sums) for d in range(q.DIM)]
    unit = {}
    for b, v in sums.items():
        moved = [a - c for a, c in zip(v, centre)]
        length = max(sum(a * a for a in moved) ** 0.5, 1e-9)
        unit[b] = [a / length for a in moved]
    want = []
    for words in split:
        row = [0.0] * q.FEATURES
        if words:
            found = [unit.get(b, [0.0] * q.DIM) for b in words]
            mean = [sum(v[d] for v in found) / len(words) for d in range(q.DIM)]
            spread = [max(sum(v[d] ** 2 for v in found) / len(words) - mean[d] ** 2, 0) ** 0.5 for d in range(q.DIM)]
            row = [*mean, *spread, sum(a == b for a, b in zip(words, words[1:])) / len(words), np.log1p(len(words)) / 8, 1.0]
        want.append(row)
    vectors = q.word_vectors(df)
    got = {r.doc: np.frombuffer(bytes(r.features), np.float32) for r in q.features(df, vectors).collect()}
    assert np.allclose([got[k] for k in range(len(texts))], want, atol=2e-3)
    network = q.Network(3)
    x = np.array([[0.5, -1.0, 2.0], [0.0, 0.0, 0.0]])
    network.fit(np.random.default_rng(1).normal(0, 1, (40, 3)), np.arange(40) % 2.0, epochs=2)
    w1, b1, w2, b2 = network.weights
    for row, score in zip(x, network.score(x)):
        z = [(a - m) / s for a, m, s in zip(row, network.mean, network.scale)]
        hidden = [max(0.0, sum(z[i] * w1[i][h] for i in range(3)) + b1[h]) for h in range(q.HIDDEN)]
        logit = sum(h * w for h, w in zip(hidden, w2)) + b2[0]
        assert score == pytest.approx(1 / (1 + np.exp(-logit / network.temperature)))


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = quality_classifier.op1_quality_classifier(spark, d).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 40 and np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    assert np.mean([(r.score - labels[r.doc_id]) ** 2 for r in held]) < 0.05
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_classifier_edges(spark, docs, no_docs):
    labels = spark.createDataFrame([(10, 1), (30, 0), (30, None), (None, 1), (999, 0)], "doc_id long, quality int")
    assert quality_classifier.classify(docs, labels).count() == docs.count()
    unlabelled = quality_classifier.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}
    assert quality_classifier.classify(no_docs, labels).count() == 0


def test_held_out_labels_are_not_learned(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    scores = lambda x: {r.doc_id: round(r.score, 9) for r in quality_classifier.classify(docs, x).collect()}
    assert scores(labels) == scores(flipped)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 10])
def test_contamination(spark, docs, no_docs, texts, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    item = ALNUM.findall(dict(texts)[22].translate(FOLD))
    items = [(1, " ".join(item[5:40]).upper()), (2, "one"), (3, None), (4, ""), (5, "w1 w2 w3"), (2, "ONE"), (6, "nothing of this is in any document at all, " * 3), (7, "b c")]
    benchmark = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc string")
    windows = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(FOLD))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    want = Counter()
    for i, t in texts:
        w = ALNUM.findall((t or "").translate(FOLD))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit[k : k + n] = [True] * n
        want[i, len(w), sum(hit), tuple(sorted(found)), sum(hit) > 0 and 20 * sum(hit) >= len(w)] += 1
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.contamination(docs, benchmark).collect())
    assert got == want
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if not k[-1])
    assert decontaminate.contamination(no_docs, benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/x">x</a></ul></nav>'
    '<div class="cookie-notice">We use cookies</div><main><h2>Head &amp; more</h2><p>one &lt;b&gt; <b>two<p>three<br>four &nbsp;five<div class="share">tweet</div><ul><li>x<li>y</ul>'
    '<form>f<input></form><!-- <p>no</p> --><script>var t="</p>";</script><section id="comments"><p>hi</p></section></main><aside>s</aside><footer>&copy; f</footer></body></html>'
)


def test_structure():
    assert html_text.settle([html_text.blocks(PAGE)]) == ["Head & more\none <b> two\nthree four five\nx\ny"]
    assert html_text.settle([html_text.blocks("")]) == [""]
    assert html_text.blocks("x<script>var a='</p>'</script>y<script>") == [("x", 1), ("y", 1)]


def test_host_repetition_settles_open_blocks():
    pages = [f"<body><div>Home About Contact Login Register Now Please</div><p>unique text number {k} is here {'abc' * k}</p><div>All rights reserved by the big company inc</div>" for k in range(6)]
    assert [x.count("\n") for x in html_text.settle([html_text.blocks(p) for p in pages])] == [0] * 6
    same = ["<article><p>" + "the same article on every page of this host " * 3 + "</p></article>"] * 5
    assert all(html_text.settle([html_text.blocks(p) for p in same]))


def test_unique_runs_of_open_blocks_stay():
    menu = "Home About Contact Login Register Now Please"
    unique = lambda k: " ".join(f"u{k}x{j}" for j in range(10))
    pages = [f"<body><div>{menu} {unique(k)}</div><div>{menu} page {k}</div></body>" for k in range(6)]
    assert html_text.settle([html_text.blocks(p) for p in pages]) == [unique(k) for k in range(6)]


def test_headings_of_an_article():
    text = lambda page: html_text.settle([html_text.blocks(page)])[0]
    assert text("<body><header><h1>Site</h1></header><article><header><h1>The <b>title</b></h1><p>by me</p><nav>x</nav></header><p>one <label>two</label> three</p></article>") == "The title\none two three"
    assert text('<article class="article-header"><h1>A</h1>b</article>') == "A\nb"


def test_pages(spark):
    rows = [(1, "http://a.example/x", PAGE, "h"), (1, "http://a.example/x", PAGE, "h"), (2, None, None, "h"), (None, "", "", "h"), (3, "odd", "<p>" + "long text " * 20_000, "h"), (4, "http://a.example/y", "<article>z</article>", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = html_text.main_texts(df).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter((a, b) for a, b, _, _ in rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert next(r for r in got if r.page_id == 3).n_chars == len("long text " * 20_000) - 1
    assert html_text.main_texts(df.limit(0)).count() == 0


def test_loose_marks_drop_nothing():
    text = lambda page: html_text.settle([html_text.blocks(page)])[0]
    article = "<article><p>main text</p></article>"
    for attributes in ('style="overflow:hidden"', 'aria-hidden="false"', "data-hidden", 'data-hidden="x"', 'title="hidden"', 'class="has-sidebar"', 'class="no-sidebar wide"', 'id="content-with-header"', 'data-class="menu"', "class='sidebar'", 'class="header"'):
        assert text(f"<body><div {attributes}>{article}</div></body>") == "main text", attributes
        for name in ("body", "main", "article"):
            assert text(f"<{name} {attributes}><p>main text</p></{name}>") == "main text", (name, attributes)
    for attributes in ("hidden", 'hidden=""', 'class="x" hidden', "aria-hidden=true", 'class="comments"'):
        assert text(f"<body><div {attributes}>{article}</div></body>") == "", attributes
    for attributes in ('class="cookie-notice"', 'class="x site-footer"', "id=sidebar", 'role="navigation"', 'class="sidebar_left"', 'class="social-links"'):
        assert text(f"<body><div {attributes}>no</div><p>yes</p></body>") == "yes", attributes
        assert text(f"<body><div {attributes}><article>teaser</article></div>{article}</body>") == "main text", attributes


@pytest.mark.parametrize("group", [256, 20])
def test_repetition_is_counted_over_the_whole_host(spark, monkeypatch, group):
    """Small hosts beside a hot one, and a menu on 12 % of the hot host's pages."""
    monkeypatch.setattr(html_text, "GROUP_PAGES", group)
    body = lambda h, k: f"<p>{' '.join(f'{h}word{k}x{j}' for j in range(30))}</p>"
    menu = "<div>Home About Contact Login Register Now Please</div>"
    pages = {"hot": [menu * (k % 8 == 0) + body("hot", k) for k in range(600)]}
    pages |= {f"h{i}": [menu + body(f"h{i}", k) for k in range(4)] for i in range(40)}
    pages["closed"] = [f"<main>{body('c', k)}</main>{menu}" for k in range(30)]
    rows = [(k, f"http://{h}/{k}", p) for h, ps in pages.items() for k, p in enumerate(ps + ps[:1])]
    # Small hosts share whatever buckets there are with the hot one.
    monkeypatch.setattr(html_text, "HOST_BUCKETS", 1, raising=False)
    got = Counter((r.url, r.text) for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == Counter((u, re.search("<p>(.*)</p>", p).group(1)) for _, u, p in rows)
    assert [html_text.settle([html_text.blocks(p) for p in ps]) for ps in pages.values()] == [[re.search("<p>(.*)</p>", p).group(1) for p in ps] for ps in pages.values()]


def test_article_text_of_all_pages(spark):
    import html as h

    d = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    for r in html_text.op7_html_text(spark, d).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.DOTALL).group(1)
        parts = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in parts if x)


def test_forms():
    text = lambda page: html_text.settle([html_text.blocks(page)])[0]
    body = "<h1>Title of it</h1><p>Here is a paragraph of more than six words.</p>"
    # Whole pages in one form: with an article, with a marked div, plain, and inside main.
    kept = "Title of it\nHere is a paragraph of more than six words."
    assert text(f"<body><form id='aspnetForm'><input><div><nav><a>menu</a></nav><article>{body}</article></div></form></body>") == kept
    assert text(f"<form id='aspnetForm'><div class='sidebar'>side</div><div class='main-content'>{body}</div></form>") == kept
    assert text(f"<form method='post'><div>{body}<label>Name <input></label><button>Send</button><select><option>x</select></div></form><p>few</p>").startswith(kept)
    assert text(f"<main><form><label>Search</label>{body}</form></main>") == kept
    # Forms of a page with main text elsewhere, small ones, searches and comments stay out.
    assert text(f"<article>{body}<form><h2>Subscribe now</h2><p>Get all of our news by mail each week.</p></form></article>") == kept
    assert text(f"{body}<form><h2>Subscribe</h2><p>Get news.</p></form>") == kept
    assert text(f"<form class='search-form'>{body}</form>") == "" and text("<form><h1>Log in</h1><label>Your user name and your password please</label></form>") == ""
    assert text(f"<form class='comment-form'><article>{body}</article></form><p>open text</p>") == "open text"
    assert text("<article><header><h1>H</h1><p class='lead big'>The lead.</p><p class='byline'>By me</p></header><p>Text</p></article>") == "H\nThe lead.\nText"


def test_repetition_equals_an_independent_count():
    """Random hosts of open pages: covered tokens by counting every string of six tokens on the distinct pages."""
    rng = random.Random(4)
    for _ in range(30):
        phrases = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(3, 14))] for _ in range(8)]
        pages = []
        for _ in range(rng.randrange(2, 25)):
            page = [[x for _ in range(rng.randrange(1, 4)) for x in (rng.choice(phrases) if rng.random() < 0.6 else [f"u{rng.randrange(10_000)}" for _ in range(rng.randrange(1, 12))])] for _ in range(rng.randrange(1, 5))]
            pages.append(page if rng.random() < 0.85 or not pages else rng.choice(pages))
        distinct = {tuple(map(tuple, p)) for p in pages}
        seen = Counter()
        for p in distinct:
            flat = [w for b in p for w in b]
            seen.update({tuple(flat[k : k + 6]) for k in range(len(flat) - 5)})
        want = []
        for p in pages:
            flat = [w for b in p for w in b]
            gone = set()
            for k in range(len(flat) - 5):
                if seen[tuple(flat[k : k + 6])] >= max(3, 0.1 * len(distinct)):
                    gone |= set(range(k, k + 6))
            at, lines = 0, []
            for b in p:
                held = [k not in gone for k in range(at, at + len(b))]
                runs, run = [], 0
                for h in held:
                    run = run + 1 if h else 0
                    runs.append(run)
                scraps = not all(held) and held.count(False) / len(held) >= 0.5 and max(runs) < 6
                lines.append("" if scraps else " ".join(w for w, h in zip(b, held, strict=True) if h))
                at += len(b)
            want.append("\n".join(x for x in lines if x))
        assert html_text.settle([html_text.blocks("".join(f"<div>{' '.join(b)}</div>" for b in p)) for p in pages]) == want


def test_odd_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for page in ("<a " * 30_000, "<a b='" * 20_000, '<a b="' * 20_000 + ">", "< " * 50_000, "<div>" * 20_000, "<!-- a " * 20_000, "<p" * 30_000):
        html_text.blocks(page)
    assert time.perf_counter() - began < 10
