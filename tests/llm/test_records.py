"""Operators 1, 2, 3, 4, 7 and 10, and the pipeline, against brute force, round trips and held-out labels."""

import base64
import hashlib
import json
import random
import wave
import zlib
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lawfinder.llm import html, linededup, logistic, media, quality, registry, toxicity, warc
from lawfinder.llm.common import table

# ---- 1: pages


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<nav>menu</nav><article><h1>A &amp; B</h1><p>one\n\n two<p>three<br>four</article><footer>f</footer>", "A & B\n\none two\n\nthree four"),
        ("<main><div class='cookie-notice'>c</div><p>x<script>var a='</p>'</script> y</p><ul><li>i<li>j</ul></main>", "x y\n\ni\n\nj"),
        ("<header>site</header><div class=content><p>text</p></div><aside>s</aside><div id=comments><p>c</p></div><form>q</form>", "text"),
        ("<article><header class=entry-header><h1>T</h1><p>by line</p></header><p>a<!-- x --> b</p><section class='comments'><p>c</p></section></article>", "T\n\na b"),
        ("<article><p>a &lt;b&gt; <b>c</b>d &#233; &am</p><table><tr><td>1<td>2</table></article>", "a <b> cd é &am\n\n1\n\n2"),
        ("<article><p>2 < 3 and <unclosed", "2 < 3 and"),
        ("<div>top</div><div class='post-content'><p>mine</p><div class='related-posts'>r</div></div>", "mine"),
        ("<div>top</div><article></article>", ""),
        ("<article><p>a</p></article><div class=content>b</div><section>c</section>", "a"),
        ("<div class=story><p>a</p></div><section id=comments><article class=comment><p>c</p></article></section>", "a"),
        ("<div class=page-header>site</div><div class=article-header><h1>T</h1><p>by line</p></div><div class=article-body><p>b</p></div>", "T\n\nb"),
        ("", ""),
    ],
)
def test_main_text(spark, body, want):
    df = spark.createDataFrame([(1, "http://h.example/a", page(body))], "page_id long, url string, html string")
    assert html.extract(df).first()["text"] == want


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_extract_odd_pages(spark, small):
    art = lambda i: page(f"<nav>m</nav><article><p>t {i}</p></article>")
    bare = lambda i: page(f"<div class=top>Welcome to us</div><div class=c><p>story {i}</p></div>")
    rows = [(1, None, art(1), "x"), (2, "no url", None, None), (3, "http://a.example/", "", "x"), (4, "http://a.example/2", art(4), None), (4, "http://a.example/2", art(4), None)]
    rows += [(20, "http://b.example/20", art(20), "x"), (21, "http://b.example/21", page("<div>plain</div>"), None)]  # a host may mix its templates
    rows += [(10 + i, f"http://b.example/{i}", bare(i), "x") for i in range(5)] + [(30, "http://c.example", page("<article>" + "<p>w</p>" * 20_000 + "</article>"), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df, small=small).collect()}
    assert got[1] == ("t 1", 3) and got[2] == ("", 0) and got[3] == ("", 0) and got[4] == ("t 4", 3)
    assert [got[10 + i][0] for i in range(5)] == [f"story {i}" for i in range(5)]  # what all pages share is template
    assert got[20][0] == "t 20" and got[21][0] == "plain"
    assert got[30][1] == 20_000 * 3 - 2
    assert html.extract(df).count() == len(rows) and html.extract(df.limit(0)).count() == 0
    copies = spark.createDataFrame([(i, "http://d.example/", page("<div>one</div><p>two</p>")) for i in range(5)], "page_id long, url string, html string")
    assert {r.text for r in html.extract(copies, small=small).collect()} == {"one\n\ntwo"}


def test_copies_and_rare_slots_are_no_template(spark):
    """A story at three addresses is one page, and a slot that few different pages have is not the template's."""
    story = page("<div>Top</div><div class=content><p>a story</p><blockquote>quoted</blockquote></div>")
    odd = page("<div>Top</div><section class=own><p>an odd one</p></section>")
    plain = lambda i: page(f"<div>Top</div><div class=content><p>text {i}</p></div>")
    headed = lambda i: page(f"<div>Top</div><div class=content><h3>Sources</h3><p>note {i}</p></div>")
    rows = [(i, f"http://e.example/{i}", x) for i, x in enumerate([story] * 3 + [odd] * 3 + [plain(i) for i in range(6)] + [headed(i) for i in range(3)])]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(3)} == {"a story\n\nquoted"} and {got[i] for i in range(3, 6)} == {"an odd one"}
    assert [got[6 + i] for i in range(6)] == [f"text {i}" for i in range(6)]
    assert [got[12 + i] for i in range(3)] == [f"Sources\n\nnote {i}" for i in range(3)]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><div class='notice-of-hearing post-social'><p>main</p></div></article>", "main"),
        ("<article><p>one</p><noscript><p>two</article><footer>f</footer>", "one"),
        ("<article><p>one</p><svg><text>two</article><p>x</p>", "one"),
        ("<article><p>one</p><svg><g><svg><text>q</text></svg><text>r</text></g></svg><p>two</p></article>", "one\n\ntwo"),
        ("<article><p>one</p><script src='a'/>var x=1;</script><p>two</p></article>", "one\n\ntwo"),
        ("<article><p title=\"it>one</p><p>two</p></article>", "one\n\ntwo"),
        ("<article></article><div class=content>real</div>", "real"),
        ("<article><p title='a>b'>x</p><p data-x=a>y</p><p it's>z</p> don't</article>", "x\n\ny\n\nz\n\ndon't"),
        ("<article><span class=ad>q<span>r</span>s</span>t<span>u</span></article>", "tu"),
        ("<article><p>a<button>b<p>c</button>d</article>", "a\n\nd"),
        ("<article><p>a</p><iframe><p>b</article>", "a\n\nb"),
        ("<article><p>a<![CDATA[ x > y ]]>b<?php 1 ?>c</article>", "abc"),
    ],
)
def test_malformed_pages(body, want):
    assert html.main_text(page(body)) == want


@pytest.mark.parametrize("part", ["<a ", "<div>x", "<p>w</p>", "<a x='>", "<", "<iframe>", "<![CDATA[", "<li>", "<i><div class=a>y"])
def test_long_odd_pages_take_time_in_proportion(part):
    """A megabyte of tags that never end or nest without bound is read within seconds."""
    import time

    began = time.process_time()
    text = html.main_text("<article>" + part * (1_000_000 // len(part)))
    assert time.process_time() - began < 8
    assert text.replace("\n\n", "") == {"<div>x": "x", "<p>w</p>": "w", "<": "<", "<i><div class=a>y": "y"}.get(part, "") * (1_000_000 // len(part)) or part == "<a x='>"


def expression(body, *more):
    items = html.filled(html.Page(body))
    for m in more:
        items = html.align(items, html.filled(html.Page(m)), html.summed)
    return html.as_text(items)


def test_expressions():
    assert expression("<ul><li>a<li>b<li>c</ul><p>x</p>") == "<ul>(<li>#</li>)+</ul><p>#</p>"
    assert expression("<p>x</p><div>y</div>", "<p>x</p>") == "<p>#</p>(<div>#</div>)?"  # what one lacks is optional
    assert expression("<p>x</p><p>y</p>", "<p>x</p><p>y</p>") == "<p>#</p><p>#</p>"
    assert expression("<p>x</p><p>y</p>", "<p>x</p><p>y</p><p>z</p>") == "(<p>#</p>)+"  # what one has more of is repeated
    assert expression("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>a<dd>b</dl>") == "<dl>(<dt>#</dt><dd>#</dd>)+</dl>"
    menu, story, foot = "<div><ul><li>m</ul></div>", "<div><p>s</p></div>", "<div>f</div>"
    assert expression(menu + story + foot, menu + foot) == "<div><ul><li>#</li></ul></div>(<div><p>#</p></div>)?<div>#</div>"
    # beyond the table's size what differs is one group of optional items in any order
    many = lambda r: "".join(f"<div class={c}>t</div>" for c in r.choices(["a", "b", "c", "d"], k=900))
    assert expression(many(random.Random(1)), many(random.Random(2))).count("<div") <= 12
    long = "".join(f"<div class=k{chr(97 + i % 26)}{chr(97 + i // 26)}>t</div>" for i in range(450))
    assert expression(long, long.replace("class=kaa", "class=other")).count(")?") == 2  # and long ones are still aligned


def test_wrapper_decides_without_names(spark):
    """No article, no telling class: the wrapper's slots say which of four like elements is the story."""
    words = lambda r, n: " ".join(r.choice(["rain", "sun", "wind", "snow", "hail"]) + str(r.randint(0, 99)) for _ in range(n))
    rows = []
    for i in range(12):
        r = random.Random(i)
        story = [words(r, 30) for _ in range(r.randint(1, 6))]
        menu = "".join(f"<li><a href=/{j}>{words(r, 2)}</a>" for j in range(5))
        notice = f"<div class=xq>{words(r, 4)}</div>" if i % 3 == 0 else ""
        body = f"<div class=xa><ul>{menu}</ul></div>{notice}<div class=xb>" + "".join(f"<p>{p}</p>" for p in story) + "<p>Read the same line here</p></div><div class=xc>Our own address</div>"
        rows.append((i, f"http://n.example/{i}", page(body), "\n\n".join(story)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    for r in html.extract(df).collect():
        assert r.text == r.want
        assert html.main_text(r.html) != r.want  # without the wrapper the menu and all else stay
    plain = df.withColumn("html", F.regexp_replace("html", " class=x[a-z]", ""))  # then only the order and contents tell
    got = html.extract(plain).collect()
    assert sum(r.text == r.want for r in got) >= 11


def test_rounds_of_alignment(spark, monkeypatch):
    rows = [(i, f"http://h{i % 2}.example/{i}", page(f"<div>{'<p>a b c</p>' * (i % 4)}<h2>t{i}</h2></div>")) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    found = {r.host: html.as_text(json.loads(r.wrapper)) for r in html.infer_wrappers(df).collect()}
    monkeypatch.setattr(html, "FAN_IN", 2)
    assert found == {r.host: html.as_text(json.loads(r.wrapper)) for r in html.infer_wrappers(df).collect()}
    assert set(found) == {"h0.example", "h1.example"} and "(<p>#</p>)*<h2>#</h2>" in found["h0.example"] and "(<p>#</p>)+<h2>#</h2>" in found["h1.example"]


def test_extract_is_the_articles_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").collect()
    got = {r.page_id: r.text for r in html.extract(table(spark, sf_dir, "pages")).collect()}
    for r in rows:
        import html as references
        import re

        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article)
        text = [" ".join(references.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts]
        assert got[r.page_id] == "\n\n".join(t for t in text if t)


# ---- 2: archives


def test_archives_round_trip(spark):
    rows = [(1, "http://b.example/x", "same"), (2, "http://a.example/Y?q#f", "same"), (3, None, None), (4, "http://a.example", ""), (5, "http://a.example:80/é", "é" * 5), (None, "http://z.example", "same"), (7, "http://q.example/a\r\nb", "x\r\n\r\nWARC/1.1"), (5, "http://a.example:80/é", "é" * 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archived(df).collect()
    assert [r.capture_seq for r in sorted(got, key=lambda r: (r.url_key, r.captured, r.page_id or 0))] == list(range(len(rows)))
    for r in got:
        payload = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    by = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    # of the rows that repeat page 5, one is the response
    assert by == [("1", "response", None), ("2", "revisit", 1), ("3", "response", None), ("4", "revisit", 3), ("5", "response", None), ("5", "revisit", 5), ("7", "response", None), ("None", "revisit", 1)]
    assert all(r.record_type == "response" for r in warc.archived(df, least_bytes=100).collect())
    assert warc.archived(df.limit(0)).count() == 0


def test_archives_of_odd_pages(spark, tmp_path):
    """URLs that parsers refuse, page numbers of 64 bits, rows that repeat the smallest page_id, and shuffled decisions."""
    rows = [(2**62, "http://[bad/x", "p"), (-(2**63), "http://ex\u2100mple.com/", "q"), (2**63 - 1, "http://[::1]:80/y", "q"), (-5, "//no scheme", ""), (2**40, "http://u:p@b.example:x/", "q")]
    rows += [(9, f"http://r.example/{i % 2}", "again") for i in range(6)] + [(9, None, "again"), (10, "http://r.example/", "again")] + [(None, "http://n.example/", "z")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(
        [(str(2**62), "response", None), (str(-(2**63)), "response", None), (str(2**63 - 1), "revisit", -(2**63)), ("-5", "response", None), (str(2**40), "revisit", -(2**63)), ("9", "response", None), ("10", "revisit", 9)]
        + [("9", "revisit", 9)] * 6 + [("None", "response", None)] * 2,
        key=str,
    )
    folder = tmp_path / "archives"
    got = warc.archived(df, str(folder)).collect()
    assert sorted([(str(r.page_id), r.record_type, r.refers_to) for r in got], key=str) == want
    assert sorted(r.capture_seq for r in got) == list(range(len(rows)))
    assert list(folder.glob("*.warc.gz")) and not list(folder.glob("*.part"))
    shuffled = warc.with_decisions(df, small=0).collect()
    assert sorted([(str(r.page_id), r.kind, r.refers) for r in shuffled], key=str) == want
    assert all(r.payload is not None for r in shuffled)
    keys = {r.page_id: r.url_key for r in got}
    assert keys[2**62] == "[bad)/x" and keys[2**63 - 1] == "[::1])/y" and keys[2**40] == "example,b)/" and keys[-5] == "//no scheme"


def test_index_does_not_depend_on_ranges(spark):
    rows = [(i % 7, f"http://h{i % 3}.example/", "x" * (i % 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"{warc.shared_dir(spark)}/warc-test"
    runs = warc.written(warc.read_archives(warc.write_archives(warc.with_decisions(df), folder, file_bytes=2000), folder, 10), "warc-runs")
    order = lambda rows: [(r.url_key, r.captured, r.page_id) for r in sorted(rows, key=lambda r: r.capture_seq)]
    got = order(warc.merged_index(runs, 20).collect())
    assert len(got) == 300 and got == sorted(got) == order(warc.merged_index(runs).collect())


def test_loser_tree():
    r = random.Random(5)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(warc._order((r.choice("abc"), r.randint(0, 3), r.choice([None, 4, 9]))) for _ in range(r.randint(0, 8))) for _ in range(k)]
        assert [runs[i][at] for i, at in warc.LoserTree(runs)] == sorted(x for run in runs for x in run)


# ---- 3 and 10: classifiers


@pytest.mark.parametrize(("name", "label"), [("op3_toxicity", "toxic"), ("op10_quality", "quality")])
def test_classifiers_on_held_out_rows(spark, name, label):
    sf = "/root/testdata/sf0.1"
    got = registry.queries()[name](spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(table(spark, sf, "labels"), "doc_id").where("held_out").select("score", "predicted", label).toPandas()
    assert len(rows) > 500 and rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    y = rows[label]
    assert (rows.predicted == y).mean() > 0.96
    assert rows.predicted[y == 1].mean() > 0.85


@pytest.mark.parametrize("fit", [toxicity, quality])
def test_classifiers_on_odd_rows(spark, fit):
    rows = [(i, ("bad idiot word " if i % 2 else "a nice word ") * (1 + i % 7), 1) for i in range(80)] + [(None, "x", 2), (500, None, 3), (501, "", 4), (502, "long " * 100_000, 5), (3, "bad idiot word", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score long")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(80)] + [(None, 1, 1), (4, None, None), (6, 7, 7)], "doc_id long, quality int, toxic int")
    model = fit.fit(df, labels)
    got = fit.scored(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    if fit is toxicity:
        means = [np.mean([r.score for r in got if r.doc_id is not None and r.doc_id < 80 and r.doc_id % 2 == k]) for k in (0, 1)]
        assert means[1] > 0.8 > 0.2 > means[0]
    none = fit.fit(df, labels.limit(0))
    assert {r.score for r in fit.scored(df, none).collect()} == {0.5}
    assert fit.scored(df.limit(0), model).count() == 0


def test_kneser_ney_probabilities_sum_to_one():
    words = [b"abc", b"abd", b"b", b"abcabc"]
    grams, size = toxicity.spelt(words)
    assert list(size) == [4, 4, 2, 7] and len(grams) == 17
    keys, n = np.unique(grams, return_counts=True)
    model = toxicity.Spelling(keys, np.stack([n, n, 0 * n]))
    context = int.from_bytes(b"\x01\x01\x01ab", "big")
    every = (context << 8) + np.arange(256)
    p = model.single[every & 0xFF]
    for order, level in zip(range(2, 7), model.shared, strict=True):
        g = every & ((1 << 8 * order) - 1)
        p = level.smooth(toxicity.find(level.grams, g), toxicity.find(level.contexts, g >> 8), p, 0.0)
        assert p.sum() == pytest.approx(1)


@pytest.mark.parametrize("broadcast", [1 << 20, 3])
def test_toxicity_keeps_rare_sequences(spark, broadcast):
    """A word seen twice in a class of millions of sequences keeps its evidence, that of the in-memory model."""
    filler = "alpha beta gamma delta " * 12_000
    rows = [(i, filler + ("zqxvile " if i in (3, 9) else "")) for i in range(80)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, broadcast=broadcast)
    use = {i for i in range(80) if zlib.crc32(str(i).encode()) % 4 != 2 and zlib.crc32(str(i).encode()) // 4 % 4 != 0}
    assert use >= {3, 9}
    counts = {}
    for i, text in rows:
        for w in (text or "").split():
            n = counts.setdefault(w.encode(), [0, 0, 0])
            n[0] += 1
            if i in use:
                n[1 + i % 2] += 1
    words = sorted(counts)
    g, size = toxicity.spelt(words)
    n = np.repeat(np.array([counts[w] for w in words]), size, axis=0)
    keys, back = np.unique(g, return_inverse=True)
    n = np.stack([np.bincount(back, c, len(keys)) for c in n.T])
    assert n[1].sum() > 2**21 * 2 and n[2].sum() > 2**21 * 2
    want = toxicity.Spelling(keys, n).evidence(keys)
    found = dict(zip(*[x.tolist() for x in model.evidence.sent.value], strict=True))
    if broadcast == 3:
        found |= {r.g: r.e for r in model.evidence.rare.collect()}
    assert found == pytest.approx(dict(zip(keys.tolist(), want, strict=True)), abs=1e-9)
    assert sum(found[g] for g in toxicity.spelt([b"zqxvile"])[0].tolist()) > 0.5
    own = {r.doc_id: r.score for r in toxicity.scored(df, model).collect()}
    again = {r.doc_id: r.score for r in toxicity.scored(df.select("*"), model).collect()}  # words counted anew
    assert len(own) == len(rows) and own == pytest.approx(again)


def test_toxicity_scores_are_brute_force(spark):
    """Every score again, from counts in dictionaries, Kneser-Ney by recursion, and the layer fitted to the rows set apart."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("sun rain wind snow hail fog".split()) for _ in range(r.randint(0, 30))) + (" vile scum" * (i % 2) if i % 5 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    crc = lambda i: zlib.crc32(str(i).encode())
    seen = [{}, {}, {}]
    for i, text in rows:
        for w in text.split():
            b = bytes([1] * 5) + w.encode() + bytes([2])
            for k in range(6, len(b) + 1):
                kinds = [0] + ([1 + i % 2] if crc(i) % 4 != 2 and crc(i) // 4 % 4 != 0 else [])
                for c in kinds:
                    seen[c][b[k - 6 : k]] = seen[c].get(b[k - 6 : k], 0) + 1
    orders = {6: seen[0]}
    for n in range(5, 0, -1):
        orders[n] = {}
        for g in orders[n + 1]:
            orders[n][g[1:]] = orders[n].get(g[1:], 0) + 1

    def shared(g):
        if len(g) == 1:
            return (1e-6 + orders[1].get(g, 0) / sum(orders[1].values())) / (256e-6 + 1)
        same = [c for h, c in orders[len(g)].items() if h[:-1] == g[:-1]]
        return (max(orders[len(g)].get(g, 0) - 0.75, 0) + 0.75 * len(same) * shared(g[1:])) / sum(same) if same else shared(g[1:])

    def given(c, g):
        same = [n for h, n in seen[c].items() if h[:-1] == g[:-1]]
        return (max(seen[c].get(g, 0) - 0.75, 0) + (40 + 0.75 * len(same)) * shared(g)) / (sum(same) + 40)

    evidence = {g: np.log(given(2, g)) - np.log(given(1, g)) for g in seen[0]}
    word = lambda w: sum(evidence[b[k - 6 : k]] for b in [bytes([1] * 5) + w.encode() + bytes([2])] for k in range(6, len(b) + 1))
    x = {}
    for i, text in rows:
        e = [min(word(w), 20) for w in text.split()]
        x[i] = [0.0] * 8
        if e:
            means = [np.mean([np.log(1 - s + s * np.exp(v)) for v in e]) for s in (0.003, 0.01, 0.03, 0.1, 0.3, 1.0)]
            x[i] = [np.sign(m) * np.log(1 + 100 * abs(m)) for m in means] + [max(e), np.log(1 + len(e))]
    held = [i for i, _ in rows if crc(i) % 4 != 2 and crc(i) // 4 % 4 == 0]
    layer = logistic.fit(np.array([x[i] for i in held]), np.array([i % 2 for i in held], float))
    got = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()}
    assert got == pytest.approx({i: float(logistic.apply(layer, np.array([x[i]]))[0]) for i, _ in rows}, abs=1e-6)


def test_quality_scores_are_brute_force(spark):
    """The network and the layer after it, with plain loops over chunks, filters and places."""
    r = random.Random(3)
    rows = [(i, "".join(r.choice("abc d\né") for _ in range(r.choice([0, 5, 511, 513, 900])))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int"))
    net, (means, scales, w) = model.network, model.combine
    first = net.first.reshape(4, 8, 2, 32)

    def odds(chunk):
        top = []
        for f in range(32):
            best = -np.inf
            for at in range(0, 512 - 4, 4):
                v = sum(float(net.embed[chunk[at + 4 * half + k]] @ first[k, :, half, f]) for half in (0, 1) for k in range(4))
                best = max(best, v)
            top.append(max(best + float(net.bias[f]), 0))
        hidden = np.maximum(np.array(top) @ net.hidden + net.hidden_bias, 0)
        return float(hidden @ net.out + net.out_bias[0])

    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    for i, text in rows[:5]:
        raw = text.encode()
        starts = range(0, max(1, len(raw) - 512 + 384), 384) if len(raw) > 512 else [0]
        each = [odds(raw[s : s + 512].ljust(512, b"\0")) for s in starts]
        x = (np.array([np.mean(each), min(each), max(each), np.log(1 + len(raw))]) - means) / scales
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(w[0] + x @ w[1:]))), abs=2e-3)


def test_learnt_rows_are_bounded(spark):
    rows = [(1, f"text {i}") for i in range(500)] + [(i, "x" * 1000) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    every = F.lit(False)
    got = quality.learnt(docs, labels, "quality", every, 20, "text", "doc_id").collect()
    assert len(got) == 20 and len({r._id for r in got}) <= 20
    assert quality.fit(docs, labels, most_bytes=3000).network is not None


def test_network_gradients():
    r = np.random.default_rng(1)
    data, y = r.integers(0, 256, (4, quality.CHUNK)).astype(np.uint8), np.array([0, 1, 1, 0], np.float32)
    net = quality.Network.start(3)
    loss = lambda: float(np.mean(np.logaddexp(0, net.odds(data)) - y * net.odds(data)))
    for a, g in zip(net.arrays(), net.gradients(data, y), strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, e = a[i], 1e-2
        a[i] = was + e
        up = loss()
        a[i] = was - e
        assert (up - loss()) / (2 * e) == pytest.approx(float(g[i]), rel=0.15, abs=2e-4)
        a[i] = was


def test_chunks_cover_the_text():
    for n in (0, 1, 511, 512, 513, 896, 897, 5000):
        raw = bytes(i % 251 for i in range(n))
        c = quality.chunks(raw)
        seen = b"".join(bytes(x[: quality.STEP]) for x in c[:-1]) + bytes(c[-1])
        assert seen[:n] == raw and not any(seen[n:])


def test_logistic():
    x = np.arange(-10.0, 10)[:, None]
    p = logistic.apply(logistic.fit(x, (x[:, 0] > 0).astype(float)), x)
    assert p[0] < 0.1 and p[-1] > 0.9
    assert logistic.apply(logistic.fit(x, np.ones(20)), x).min() > 0.9


# ---- 4: lines


def brute_lines(docs):
    seen, out = {}, {}
    for d, t in sorted({(d, t) for d, t in docs if d is not None and t is not None}):
        ls = t.split("\n")
        for i in range(len(ls) - 2):
            w = tuple(ls[i : i + 3])
            if any(x.strip() for x in w):
                seen.setdefault(w, (d, i))
    for d, t in docs:
        ls = t.split("\n") if t is not None else []
        gone = set()
        for i in range(len(ls) - 2 if d is not None else 0):
            w = tuple(ls[i : i + 3])
            if w in seen and seen[w] < (d, i):
                gone.update((i, i + 1, i + 2))
        out[d, t] = ("\n".join(x for i, x in enumerate(ls) if i not in gone) if t is not None else None, len(gone))
    return out


def test_line_dedup_is_brute_force(spark):
    r = random.Random(2)
    docs = [(i, "\n".join(r.choice(["a", "b", "c", "", "d e"]) for _ in range(r.randint(0, 12)))) for i in range(80)]
    docs += [(None, "a\nb\nc"), (200, None), (201, ""), (202, "\n\n\n\n"), (203, "q\nr\ns\nq\nr\ns"), (203, "q\nr\ns\nq\nr\ns"), (204, "\n".join(map(str, range(50_000)))), (205, "\n".join(map(str, range(50_000))))]
    df = spark.createDataFrame([(*d, "old") for d in docs], "doc_id long, text string, n_lines string")
    want = brute_lines(docs)
    key = lambda x: (str(x[0]), str(x[1]))
    for small in (linededup.SMALL_LATER, 0):  # broadcast, and shuffled
        got = linededup.dedup_lines(df, small=small).collect()
        assert sorted([(g.doc_id, g.text, g.n_removed) for g in got], key=key) == sorted([(d[0], *want[d]) for d in docs], key=key)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


# ---- 7: sound


def test_media_round_trip(spark):
    texts = ["", None, "é" * 288, "x" * 577, "tone" * 3000, "tone" * 3000, "".join(chr(33 + i % 90) for i in range(200_000))]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    files = media.to_media(df)
    rows = {r.doc_id: r for r in media.described(files).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        with wave.open(BytesIO(bytes(rows[i].media))) as w:
            assert w.readframes(w.getnframes()) == payload
        assert rows[i].payload_bytes == len(payload) and rows[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert rows[i].tail_crc32 == zlib.crc32(payload[-32:]) and rows[i].media_bytes == len(payload) + 44
        assert rows[i].pair_frames == sorted(rows[i].pair_frames) and len(rows[i].pair_codes) == len(rows[i].pair_frames)
    assert rows[4].pair_codes == rows[5].pair_codes and rows[6].pair_codes
    assert media.described(files.withColumn("media", F.lit(None).cast("binary"))).first()["payload_bytes"] is None
    assert media.described(media.to_media(df.limit(0))).count() == 0


def test_fingerprint_is_brute_force():
    """Peaks and pairs again, by the plain sum of a discrete Fourier transform in double precision."""
    n, hop, bands = media.FRAME, media.HOP, media.BANDS
    for seed, size in ((1, 576), (2, 512 * 9 + 64), (3, 576 * 5)):
        raw = np.random.default_rng(seed).integers(0, 256, size).astype(np.uint8).tobytes()
        x = [(b - 128) / 128 for b in raw]
        count = max(1, 1 + -(-(len(x) - n) // hop))
        x += [0.0] * ((count - 1) * hop + n - len(x))
        wave_ = np.exp(-2j * np.pi * np.outer(np.arange(1, n // 2 + 1), np.arange(n)) / n)
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
        power = [np.abs(wave_ @ (np.array(x[t * hop : t * hop + n]) * hann)) ** 2 for t in range(count)]
        width = n // 2 // bands
        top = [[max((p[b * width + k], -k) for k in range(width)) for b in range(bands)] for p in power]
        found = []
        for t in range(count):
            for b in range(bands):
                level = lambda u: top[u][b][0] if 0 <= u < count else -1.0  # noqa: B023, E731
                if level(t) > level(t - 1) and level(t) >= level(t + 1) and level(t) > 1e-6:
                    found.append((t, b * width - top[t][b][1] + 1))
        pairs = sorted((t, (f << 20) | (g << 8) | (u - t)) for i, (t, f) in enumerate(found) for u, g in found[i + 1 : i + 1 + media.FAN] if u - t <= media.REACH)
        codes, frames = media.fingerprint(raw)
        assert list(zip(frames.tolist(), codes.tolist(), strict=True)) == pairs


def test_peaks_do_not_depend_on_blocks(monkeypatch):
    raw = np.random.default_rng(4).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    whole = media.fingerprint(raw)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, media.fingerprint(raw), strict=True))


def test_tone_has_its_peak():
    t = np.arange(20_000)
    raw = (128 + 100 * np.sin(2 * np.pi * 1000 * t / media.RATE) * (t % 4000 < 2000)).astype(np.uint8).tobytes()
    _, bins = media.peaks(raw)
    assert np.isin([63, 64, 65], bins).any()


# ---- the pipeline


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
        kept = {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()}
        assert kept <= {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        assert 0.5 * docs.count() < len(kept) <= docs.count()
        docs = out.select(docs.columns)
    empty = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
