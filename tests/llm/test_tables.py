"""The operators on vectors and pages, and the pipeline as a whole."""

import gzip
import io

import helpers as h
import numpy as np
import pytest

from marlspike.llm import mixing, topk, warc, wrappers

VECTORS = "vec_id long, embedding array<float>, label int"


def test_top_k_equals_sql(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=12) * 0.3], 0) for i in range(260)] + [(300 + i, [0.5] * 12, 1) for i in range(60)]
    rows += [(100, rows[100][1], 0), (100, [0.25] * 12, 0), (400, None, 0), (401, [1.0, None], 0), (402, [float("nan")] * 12, 0), (403, [float("inf")] * 12, 0), (None, [0.1] * 12, 0), (450, [0.5, 0.5], 0), (500, [], 0)]
    sf = h.save(spark.createDataFrame(rows, VECTORS), tmp_path, "embeddings")
    h.same(topk.op4_segment_top_k(spark, sf), topk.SQL, {"embeddings": sf})
    assert topk.op4_segment_top_k(spark, h.empty(spark, tmp_path / "none", "embeddings", VECTORS)).count() == 0


def test_bounds_hold_and_blocks_agree():
    r = np.random.default_rng(5)
    for _ in range(30):
        n = int(r.integers(1, 40))
        q, x = np.floor(r.normal(size=(3, n)) * 256), np.floor(r.normal(size=(50, n)) * 256)
        for s in topk.SEGMENTS:
            assert (topk.statistics(q, s) @ topk.statistics(x, s).T >= q @ x.T - 1e-6 * np.abs(q @ x.T).max()).all()
        ids = r.permutation(50)
        for i, (at, scores) in enumerate(topk.best(topk.Rows(q), topk.Rows(x), ids, 5)):
            exact = x @ q[i]
            assert at.tolist() == sorted(range(50), key=lambda j: (-exact[j], ids[j]))[:5] and scores == exact[at].tolist()
    big = [np.full((1, 3), 2.0**40), np.full((2, 3), 2.0**40)]
    assert topk.best(topk.Rows(big[0]), topk.Rows(big[1]), np.array([7, 5]), 1)[0][0].tolist() == [1]


@pytest.mark.parametrize("kind", ["given", "clustered"])
def test_bounds_prune(kind):
    import pyarrow.parquet as pq

    r = np.random.default_rng(1)
    if kind == "given":
        x = topk.vectors_of(pq.read_table("/root/testdata/sf0.1/embeddings.parquet").column("embedding"))[64][1]
    else:
        x = np.floor(256 * (r.normal(size=(40, 64))[r.integers(0, 40, 4000)] + 0.1 * r.normal(size=(4000, 64))))
    rows = topk.Rows(x)
    shares = []
    for i in range(0, len(x), 100):
        least = np.sort(x @ x[i])[-6]
        left = topk.survivors(rows, i, rows, least)
        assert set(np.flatnonzero(x @ x[i] >= least)) <= set(left[-1])
        shares.append([len(p) / len(x) for p in left])
    assert np.mean(shares, axis=0)[-1] < 0.25, np.mean(shares, axis=0)


def test_top_k_in_many_blocks_of_queries(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(r.normal(size=(1500, 8)))]
    sf = h.save(spark.createDataFrame(rows, VECTORS).repartition(5), tmp_path, "embeddings")
    for name, value in (("QUERY_BYTES", 500), ("SAMPLE", 40), ("ROWS", 70)):
        monkeypatch.setattr(topk, name, value)
    h.same(topk.op4_segment_top_k(spark, sf), topk.SQL, {"embeddings": sf})


PAGE = "page_id long, url string, html string"


def test_archives_equal_sql_and_round_trip(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}.example.com/{i}\r\n", f"<p>{i % 7}</p>é\x00") for i in range(60)] + [(100, None, None), (101, "u", ""), (102, "u", "x" * 300_000), (5, "again", "<p>5</p>é\x00")]
    sf = h.save(spark.createDataFrame(rows, PAGE), tmp_path, "pages")
    h.same(warc.op8_warc(spark, sf), warc.SQL, {"pages": sf})
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    folders = [f"file://{tmp_path}/{x}" for x in "ab"]
    made = [warc.write_archives(pages, f, file_bytes=2000) for f in folders]
    assert made[0] == made[1] and len(made[0]["files"]) > 4
    for f in made[0]["files"]:
        a, b = ((tmp_path / x / f["name"]).read_bytes() for x in "ab")
        assert a == b and len(a) == f["bytes"] and gzip.decompress(a).count(b"WARC/1.1\r\n") == f["records"]
    assert not [p for p in (tmp_path / "a").iterdir() if p.name.startswith(".tmp")]
    back = warc.read_archives(spark, folders[0], with_html=True).where("record_type = 'response'").collect()
    want = {(r[0], r[2] or "") for r in rows}
    assert {(r.key, r.html) for r in back} <= want and {r.html for r in back} == {x for _, x in want}
    heads = [x for f in made[0]["files"] for x, _ in warc.records_of(io.BytesIO((tmp_path / "a" / f["name"]).read_bytes()))]
    ids = [x["WARC-Record-ID"] for x in heads]
    assert len(set(ids)) == len(ids) == len(rows) and {x["WARC-Refers-To"] for x in heads if x["WARC-Type"] == "revisit"} <= {x["WARC-Record-ID"] for x in heads if x["WARC-Type"] == "response"}
    nulls = spark.createDataFrame([(None, "u", "same"), (None, "u", "same"), (3, "u", "other")], PAGE)
    warc.write_archives(nulls, f"file://{tmp_path}/n")
    assert sorted(r.record_type for r in warc.read_archives(spark, f"file://{tmp_path}/n").collect()) == ["response"] * 3
    assert warc.op8_warc(spark, h.empty(spark, tmp_path / "none", "pages", PAGE)).count() == 0


def test_damaged_records_are_found():
    a = warc.record(1, "u", b"abc", None)
    assert [x[1] for x in warc.records_of(io.BytesIO(a + a))][1].endswith(b"abc")
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(a[: len(a) // 2])))
    bad = gzip.compress(gzip.decompress(a).replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(bad)))


CASES = {
    "<article><h1>T</h1><p>a &amp; b<br>c <b>d</b>e</article><footer>f</footer>": "T\n\na & b c de",
    "<html><head><title>t</title></head><body><nav>m</nav><div class=ad>x</div><main><h1>H</h1><p>p</p></main><aside>s</aside></body></html>": "H\n\np",
    "<article><header><h1>T</h1></header><p>one</p><form>f</form><div id='comments'><p>nice</p></div></article>": "T\n\none",
    "<div class='content'><p>x<p>y<ul><li>1<li>2</ul></div><div class='cookie-notice'>c</div>": "x\n\ny\n\n1\n\n2",
    "<p>plain</p><script>var a='<p>no</p>'</script><!-- <p>no</p> -->tail": "plain\n\ntail",
    "just text": "just text", "": "", "<": "<", "<p>a < b & c</p>": "a < b & c", "<article><p>x&nbsp;&nbsp; y\n\tz</p></article>": "x y z",
    "<article>" + "<div>" * 300 + "deep" + "</div>" * 300 + "</article>": "deep", "<table><tr><td>a<td>b<tr><td>c</table>": "a\n\nb\n\nc",
    "<div class='siteHeader'>h</div><div id='content' class='with-sidebar'><p>in</p><p class='newsletter-box'>n</p></div><div class='post-footer'>f</div>": "in",
    "<article class='comment'><p>c</p></article><article><p>a</p></article>": "a",
}


@pytest.mark.parametrize("page", CASES)
def test_main_text(page):
    assert wrappers.main_text(page, wrappers.Roles(wrappers.skeleton(page))) == CASES[page]


def test_deep_elements_close_themselves_only():
    deep = "<div>" * 70
    page = f"<div><article><p>head</p>{deep}<p>low</p><div class='advert'>buy</div>{'</div>' * 70}<p>tail</p></article></div>"
    assert wrappers.main_text(page, wrappers.Roles(wrappers.skeleton(page))) == "head\n\nlow\n\ntail"
    page = f"<article>{'<div>' * 5000}low</article>"
    assert wrappers.main_text(page, wrappers.Roles(wrappers.skeleton(page))) == "low"


def test_wrappers_align_to_optional_and_repeated():
    one = wrappers.skeleton("<body><h1>a</h1><p>b</p></body>")
    two = wrappers.skeleton("<body><h1>a</h1><p>b</p><p>c</p><div>x</div></body>")
    body = wrappers.align(one, two)[3][0]
    assert [(x[0], x[1]) for x in body[3]] == [("h1", "1"), ("p", "+"), ("div", "?")]
    pairs = wrappers.skeleton("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")[3][0][3]
    assert [x[0] for x in pairs] == ["()"] and [x[0] for x in pairs[0][3]] == ["dt", "dd"]
    wide = wrappers.skeleton("".join(f"<c{i}>x</c{i}>" for i in range(400)))
    assert {x[1] for x in wide[3]} == {"*"}


def test_extraction_over_hosts(spark, tmp_path):
    rows = [(i, f"http://{'abc'[i % 3]}.example.com/{i}", f"<nav>n</nav><article><p>{i}</p>{'<p>more</p>' * (i % 4)}</article>{'<div class=widget>w</div>' * (i % 2)}") for i in range(40)]
    rows += [(100, None, None), (101, "no host", ""), (100, None, None)]
    sf = h.save(spark.createDataFrame(rows, PAGE), tmp_path, "pages")
    got = sorted(map(tuple, wrappers.op7_wrapper_extraction(spark, sf).collect()), key=str)
    want = [(i, u, "\n\n".join([str(i)] + ["more"] * (i % 4)) if i < 100 else "") for i, u, _ in rows]
    assert got == sorted(((*x, len(x[2])) for x in want), key=str)
    assert wrappers.op7_wrapper_extraction(spark, h.empty(spark, tmp_path / "none", "pages", PAGE)).count() == 0


def test_text_that_all_pages_of_a_host_share_is_template(spark, tmp_path):
    page = "<div class='qa'><ul><li>Home<li>About</ul><p>Pages of ours</p></div><div class='qb'><h1>T{0}</h1><p>text {0}</p></div><div class='qc'>Buy now</div>"
    same = "<div class='qa'>menu {0}</div><article><p>the same</p></article>"  # an article of all pages is one still
    rows = [(i, f"http://a.example.com/{i}", page.format(i)) for i in range(12)] + [(20 + i, f"http://b.example.com/{i}", same.format(i)) for i in range(12)]
    rows += [(40 + i, f"http://c.example.com/{i}", page.format(i)) for i in range(2)]  # too few pages to tell
    sf = h.save(spark.createDataFrame(rows, PAGE), tmp_path, "pages")
    got = {r.page_id: r.text for r in wrappers.op7_wrapper_extraction(spark, sf).collect()}
    assert all(got[i] == f"T{i}\n\ntext {i}" and got[20 + i] == "the same" for i in range(12))
    assert "Home" in got[40] and "text 0" in got[40]


def test_menus_without_names_are_told_by_their_links(spark, tmp_path):
    # the links differ from page to page, no name means anything, and there is no article element
    page = "<div class='qa'><div class='qb'><a href=/a>{0}a</a> <a href=/b>{0}b</a></div><div class='qc'><h2><a href=/x>Title {0}</a></h2><p>see <a href=/c>{0}c</a> and text {0}</p></div><section><a href=/d>next {0}</a></section></div>"
    pages = [page.format(i) for i in range(9)]
    wrapper = wrappers.skeleton(pages[0])
    for x in pages[1:]:
        wrapper = wrappers.align(wrapper, wrappers.skeleton(x))
    want = [f"Title {i}\n\nsee {i}c and text {i}" for i in range(9)]
    assert [wrappers.main_text(x, wrappers.Roles(wrapper)) for x in pages] == want
    # without the wrapper nothing tells them apart
    assert all("next" in wrappers.main_text(x, wrappers.Roles(None)) for x in pages)
    sf = h.save(spark.createDataFrame([(i, f"http://a.example.com/{i}", x) for i, x in enumerate(pages)], PAGE), tmp_path, "pages")
    assert {r.page_id: r.text for r in wrappers.op7_wrapper_extraction(spark, sf).collect()} == dict(enumerate(want))


def test_wrappers_are_expressions_that_all_their_pages_match():
    import random
    import re

    def expression(nodes):
        return "".join(f"(?:{expression(x[3]) if x[0] == '()' else f'<{re.escape(x[0])}>{expression(x[3])}</>'}){'' if x[1] == '1' else x[1]}" for x in nodes)

    def stream(page):
        return "".join(f"<{x}>" if kind == 1 else "</>" for kind, x in wrappers.events(page) if kind in (1, -1))

    r = random.Random(11)

    def made(depth):
        return "".join(f"<{t}>{made(depth - 1) if depth else 'x'}</{t}>" for t in r.choices("abcd", k=r.randint(0, 4)) for t in ["c" + t])

    for _ in range(150):
        pages = [made(2) for _ in range(r.randint(2, 6))]
        wrapper = wrappers.skeleton(pages[0])
        for x in pages[1:]:
            wrapper = wrappers.align(wrapper, wrappers.skeleton(x))
        pattern = re.compile(expression(wrapper[3]))
        for x in pages:
            assert "<" not in x or pattern.fullmatch(stream(x) + "</>" * (stream(x).count("<c") - stream(x).count("</>"))), (x, pattern.pattern)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    good = [(i, h.words(80, i) + "\nA line that stands in very many of these documents here\n" + h.words(20, i + 500), "en", f"s{i % 3}", 1) for i in range(12)]
    docs = good + [(100, good[0][1], "en", "s", 1), (101, h.edited(good[1][1], 4, 1), "en", "s", 1), (102, "too short", "en", "s", 1), (103, "word " * 90, "en", "s", 1), (104, None, "en", "s", 1)]
    sf = h.save(spark.createDataFrame(docs, h.SCHEMA), tmp_path)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == list(range(12)) and all(r.n_tokens > 50 for r in rows)
    # the mix: sources of four documents each, one block each, in the order of their deadlines
    at = mixing.positions(spark.createDataFrame([x for x in docs if x[0] < 12], h.SCHEMA)).collect()
    assert {(r.doc_id, r.slot, r.place) for r in rows} == {tuple(r) for r in at} and {r.slot for r in rows} == {0, 1, 2}
    assert corpus_pipeline.run(spark, h.empty(spark, tmp_path / "none")).count() == 0


def test_pipeline_tokens_follow_the_mix_that_its_stage_made(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    stages, docs = dict(corpus_pipeline.STAGES), spark.createDataFrame([(i, h.words(9, i), "en", f"s{i % 2}", 1) for i in range(40)], h.SCHEMA)
    placed = stages["mix_sources"](spark, docs, "")
    at = {r.doc_id: (r.slot, r.place) for r in placed.collect()}
    assert at == {r["_id"]: (r.slot, r.place) for r in mixing.positions(docs).collect()} and len(set(at.values())) == 40
    other = placed.withColumns({"slot": 1000 - placed.slot, "place": placed.place + 7})
    got = {r.doc_id: (r.slot, r.place) for r in stages["bpe_encode"](spark, other, "").collect()}
    assert got == {k: (1000 - slot, place + 7) for k, (slot, place) in at.items()}
