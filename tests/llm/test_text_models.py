"""Quality classifier, HTML extraction and archives: accuracy, brute force and round trips."""

import base64
import gzip
import hashlib
import os
import random
import time
import zlib

import numpy as np
import pytest
from comparing import same_rows
from pages_by_hand import AROUND, HAND_PAGES

from docsieve.llm import html_extract, quality, warc
from docsieve.llm.common import new_path

SF = "/root/testdata/sf0.01"
real = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@real
def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([r.predicted == q for r, q in held]) > 0.95
    # held-out labels are never seen
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    assert {r.doc_id: r.score for r in quality.classify(docs, flipped).collect()} == {i: r.score for i, r in got.items()}


def test_quality_odd_inputs(docs, docs_rows, clashing, no_docs, spark):
    labels = spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(docs_rows)] + [(4, 1), (4, None), (10**9, 1), (None, 0)], "doc_id long, quality int")
    got = quality.classify(clashing, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in docs_rows)
    texts = {r[0]: r[1] for r in docs_rows if r[0] is not None}
    assert len({r.score for r in got if r.doc_id is not None and not (texts[r.doc_id] or "").strip()}) == 1  # the bias
    assert quality.classify(no_docs, labels).collect() == []
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.keep_good(clashing, labels).columns == clashing.columns
    kept = quality.keep_good(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in got if r.predicted)


def test_training_samples_bound_rows(spark, monkeypatch):
    """An id with many rows is learned from once, whatever their order."""
    rows = [(8, f"<p>copy {i}</p>") for i in range(300)] + [(i, f"<p>text {i}</p>") for i in range(100, 120)] + [(8, None), (8, "<p>copy 0</p>")] * 3
    frames = [spark.createDataFrame(part, "doc_id long, text string").repartition(4) for part in (rows, rows[::-1])]
    labels = spark.createDataFrame([(i, i % 2) for i in (8, *range(100, 120))], "doc_id long, quality int")
    folder = new_path(spark, "seen").removeprefix("file://")
    os.makedirs(folder)

    def seen(batches):
        texts = sorted(t for batch in batches for t in batch.column(0).to_pylist())
        with open(f"{folder}/{hashlib.sha1(os.urandom(8)).hexdigest()}", "w") as f:
            f.write("\n".join(texts))
        return iter(())

    monkeypatch.setattr(quality, "_train_task", seen)
    monkeypatch.setattr(html_extract, "_train_task", seen)
    counts, known = [], [8, *range(100, 120)]
    for frame in frames:
        quality.fit(frame, labels)
        html_extract.fit(frame.selectExpr("doc_id as page_id", "text as html"))
    for name in os.listdir(folder):
        with open(f"{folder}/{name}") as f:
            counts.append(sorted(line for line in f.read().split("\n") if line))
    learned = [i for i in known if zlib.crc32(str(i).encode()) % 4 != 2]
    assert 8 in learned and sorted(map(len, counts)) == sorted([len(learned)] * 2 + [len(known)] * 2)
    assert len(set(map(tuple, counts))) == 2  # the same rows in either order


def test_features_by_hand():
    texts = ["Reed,*** one one", "", "x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    ends, index, value = quality.features(data, offsets)
    # words: 3, of which 2 differ; pairs: 2; shapes Aa,* a a: 2; shape pairs: 2
    assert ends.tolist() == [8, 8, 10]
    assert abs((value[:8] ** 2).sum() - 1) < 1e-6 and len(set(index[:8].tolist())) == 8


def test_ftrl_learns_a_rule():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        f = rng.choice(50, 8, replace=False)
        rows.append((*quality._with_bias(f, np.full(8, 8**-0.5, np.float32)), int(3 in f)))
    w = quality.train(rows)
    assert np.mean([(w[i] @ v > 0) == y for i, v, y in rows]) > 0.98 and (w == 0).mean() > 0.9


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{x:1}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Start</a><li><a href="/b">More</a></ul></nav><div class="ad">Buy this now</div>
<article><h1>A   head &amp; line</h1><p>First&nbsp;paragraph,
 <b>bold</b> and <i>more</i> of it.<p>Second one &lt;here&gt; with some words in it.<br>And a line.</article>
<div class="comments"><div class="comment"><p>I liked this very much, thanks.</p></div></div><form class="newsletter"><label>Your address</label></form>
<footer>&copy; 2024 All rights</footer></body></html>"""
TEXT = "A head & line\nFirst paragraph, bold and more of it.\nSecond one <here> with some words in it. And a line."


@real
def test_extraction(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_extract.fit(pages)
    rows = [r.html for r in pages.collect()]
    wrong = blocks = 0
    for html, text in zip(rows, html_extract.main_text(rows, model)):
        cut = html_extract.blocks(html)
        want = [t for (_, t, _), y in zip(cut, html_extract.taught(cut)) if y]
        wrong += text != "\n".join(want)
    assert wrong <= len(rows) // 100
    # layouts that the markup rule cannot label: composed from other pages, other seed
    rng = np.random.default_rng(77)
    taught = [(html_extract.blocks(h), html_extract.taught(html_extract.blocks(h))) for h in rows[:60]]
    texts = [t for page, _ in taught for _, t, _ in page]
    composed = [html_extract._composed(p, y, rng, texts) for p, y in taught]
    chances = html_extract.probabilities([html_extract.vectors(p) for p, _ in composed], model)
    assert np.mean(np.concatenate([(c >= 0.5) == y for c, (_, y) in zip(chances, composed)])) > 0.97
    assert html_extract.main_text([PAGE, ""], model) == [TEXT, ""]
    # every page is labelled alike alone and in company
    alone = [html_extract.main_text([h], model)[0] for h in rows[:20]]
    assert alone == html_extract.main_text(rows, model)[:20]


@real
def test_pages_by_hand(spark):
    """Lists, tables, code, quotes, captions, heads and adverts inside articles, block by block."""
    model = html_extract.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    wrong = []
    for (name, _, keep, drop), text in zip(HAND_PAGES, html_extract.main_text([p for _, p, _, _ in HAND_PAGES], model)):
        own = text.split("\n")
        assert not set(own) & {*AROUND, *drop}, name
        wrong += [name] if own != keep else []
    assert wrong == []


@pytest.mark.parametrize("unit", ["<svg ", "<div ", '<a b="', "<div>x", "<b>x", "<b><h1>x", "<i></b>", "<head><b><basefont>x", "<p '>", "<script></script ", "<i><div><b></i>x", "<!--", "&#x", None])
def test_broken_pages_take_linear_time(unit):
    page = lambda n: unit * (n // len(unit)) if unit else "".join(f'<div class="c{i}">x' for i in range(n // 18))
    took = []
    for n in (100_000, 1_000_000):
        start = time.process_time()
        html_extract.blocks(page(n))
        took.append(time.process_time() - start)
    assert took[1] < 6 and took[1] < 40 * max(took[0], 0.02)


def test_paths_and_vectors_of_deep_pages():
    """Vectors kept up to date while elements open and close are those of the whole path."""
    rng = random.Random(3)
    bits = ["<p>", "</p>", '<div class="a b a">', "</div>", "<b>", "</b>", '<a href="x>y">', "</a>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "<head>", "<body>", "t", " u ", "<br/>", "<h1 id=Q>", "</h1>", "<header>", "<dt>", "<main role='main'>"]
    for _ in range(500):
        for path, _, _ in html_extract.blocks("".join(rng.choice(bits) for _ in range(60))):
            assert path.vector == html_extract._path_vector(path.names) and path.hidden == ("head" in path.names)
    names = html_extract.blocks('<div class="' + " ".join(f"n{'x' * i}" for i in range(30)) + '">t')[0][0].names
    assert len(names) == 31  # every word of an attribute counts


def test_extraction_odd_inputs(spark):
    rows = [(1, "http://a", PAGE), (1, "http://a", PAGE), (2, None, None), (3, "", ""), (None, "u", "<p>"), (5, "u", "a < b & c <unclosed"),
            (6, "u", "<article>" + "<p>word and words.</p>" * 3000 + "</article>"), (7, "u", "<!-- never closed"), (8, "u", "<script>x")]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r for r in got}
    assert by[2].text == by[3].text == by[7].text == by[8].text == "" and by[2].url is None
    assert by[6].text.count("\n") == 2999
    assert html_extract.extract(spark.createDataFrame([], pages.schema)).collect() == []


def test_extraction_open_head_and_closed_svg(spark):
    """Optional </head> and <body> left out, and icons that end at their slash: no text is lost."""
    icon = '<svg class="i" viewBox="0 0 1 1"/>'
    variants = [PAGE.replace("</head><body>", "<body>"), PAGE.replace("</head><body>", ""), PAGE.replace("<p>First", f"<p>{icon}First"),
                PAGE.replace("<header>", f"<header>{icon}<SVG/><svg\n/>"), PAGE.replace("<body>", "<body><svg><title>No</title><path d='M0'/></svg>")]
    assert all(v != PAGE for v in variants)
    rows = [(i, "u", html) for i, html in enumerate([PAGE, *variants])]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert "First paragraph" in got[0] and set(got.values()) == {got[0]}
    whole = [t for _, t, _ in html_extract.blocks(PAGE)]
    assert all([t for _, t, _ in html_extract.blocks(v)] == whole for v in variants)
    for html, texts in [('<p>one <svg class="i"/> two</p><p>three</p>', ["one two", "three"]), ("<head><title>x</title>bare <b>text</b>", ["bare text"]),
                        ("<head><bgsound src=a><meta name=b><p>one", ["one"]), ("<p>one<svg><g/><text>drawn</text></svg> two", ["one two"])]:
        cut = html_extract.blocks(html)
        assert [t for _, t, _ in cut] == texts and not any("head" in path.names for path, _, _ in cut)
    # what stands in the head, and only that, keeps its path
    kept = html_extract.blocks("<head><noframes>old</noframes><link href=a></head><body><p>one")
    assert [(path.hidden, t) for path, t, _ in kept] == [(True, "old"), (False, "one")]


def test_gradients_are_right():
    rng = np.random.default_rng(2)
    model = {k: v.astype(np.float64) for k, v in html_extract.new_model(rng).items()}
    pages = [rng.standard_normal((n, html_extract.DIM)) for n in (3, 5)]
    labels = [np.array([1, 0, 1.0]), np.array([0, 0, 1, 1, 0.0])]

    def loss():
        p = html_extract.probabilities(pages, model)
        return -sum((y * np.log(q) + (1 - y) * np.log(1 - q)).sum() for q, y in zip(p, labels)) / 8

    grads = html_extract._gradients(pages, labels, model)
    for name, g in grads.items():
        for at in [tuple(rng.integers(s) for s in g.shape) for _ in range(4)]:
            keep = model[name][at]
            model[name][at] = keep + 1e-2
            up = loss()
            model[name][at] = keep - 1e-2
            down = loss()
            model[name][at] = keep
            assert abs((up - down) / 2e-2 - g[at]) < 2e-3


def expected_warc(rows, least=0):
    groups = {}
    for page_id, _, html in rows:
        groups.setdefault(html or "", []).append(page_id)
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        keep = max((i for i in groups[html or ""] if i is not None), default=None)
        revisit = page_id != keep and len(body) >= least
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page_id, len(body), digest, "revisit" if revisit else "response", keep if revisit else None))
    return out


PAGES = [(1, "http://www.Example.com/b?x=1", "<p>é</p>"), (2, "http://example.com/a", "<p>é</p>"), (3, "https://sub.example.com:8080/", "other\r\n\r\nWARC/1.1"),
         (4, None, None), (5, "", ""), (6, "not a url\r\nX: y", "z"), (7, "http://[bad", "z"), (7, "http://[bad", "z"), (None, "http://e.org", "<p>é</p>"),
         (9, "http://long.example.com/", "y" * 300_000)]


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, least):
    pages = spark.createDataFrame([(*r, "own") for r in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    assert same_rows(warc.warc_round_trip(pages, least).collect(), expected_warc(PAGES, least))
    assert warc.warc_round_trip(spark.createDataFrame([], pages.schema)).collect() == []


def test_archive_files_and_lookups(spark):
    rows = [(i, f"http://h{i % 7}.example.com/p/{i % 50}", f"<p>{i % 90}</p>") for i in range(300)]
    folder = new_path(spark, "warc")
    captures = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), folder)
    directory = warc.write_index(captures, folder, block_lines=16)
    blocks = directory.collect()
    assert sum(b.lines for b in blocks) == 300 and len(blocks) >= 300 // 16 and all(b.first_key <= b.last_key and b.lines <= 16 for b in blocks)
    want = {r[0] for r in rows if r[1] == "http://h3.example.com/p/3"}
    found = [r.asDict() for r in warc.lookup_urls(spark.createDataFrame([("http://H3.example.com/p/3",), ("http://nowhere.example.com/",), ("http://h3.example.com/p/3",)], "url string"), directory, folder).collect()]
    assert {r["page_id"] for r in found} == want and all(r["url"] == "http://h3.example.com/p/3" for r in found)
    assert all(r["payload"] == f"<p>{r['page_id'] % 90}</p>".encode() for r in found if r["record_type"] == "response")
    assert warc.lookup_urls(spark.createDataFrame([("http://none.example.com/",)], "url string"), directory, folder).collect() == []
    # an archive is a file of gzip members that any reader of WARC/1.1 can walk
    path = folder.removeprefix("file://")
    whole = b"".join(gzip.open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".warc.gz"))
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == 300
    all_rows = warc.read_archives(directory, folder).collect()
    assert {r.page_id: r.url for r in all_rows} == {r[0]: r[1] for r in rows}


def test_damaged_records_are_noticed():
    data = warc.record(1, "http://a", b"payload", None, False)
    assert warc.parse_record(data)["payload"] == b"payload"
    for bad in (data.replace(b"payload\r", b"pay1oad\r"), data[:-1], data.replace(b"WARC/1.1", b"WARC/9.9")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_surt():
    assert warc.surt("http://www.Example.com/B?x=1") == "com,example)/b?x=1"
    assert warc.surt("https://a.b.org:81") == "org,b,a:81)/" and warc.surt(None) == warc.surt("") == ""
