"""WARC, page text and embeddings against plain versions, on odd inputs."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re

import numpy as np
import pytest
from conftest import SMALL

from lakeloom.llm import components, embeddings, extraction, queries, warc
from lakeloom.session import scratch_path

PAGES = "page_id long, url string, html string, payload string, record_type int"


@pytest.fixture(scope="module")
def page_rows():
    rows = [
        (5, "http://a.example/5", "<p>same</p>"),
        (3, "http://a.example/3 x\r\nWARC-Type: bad", "<p>same</p>"),
        (9, None, "<p>same</p>"),
        (3, "http://a.example/3", "<p>same</p>"),
        (4, "u", None),
        (2, "u", ""),
        (None, "u", "<p>no id</p>"),
        (None, None, "<p>same</p>"),
        (7, "ü", "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40),
        (8, "long", "0123456789 ü" * 60_000),
    ]
    return [(*r, "x", 1) for r in rows]


@pytest.fixture(scope="module")
def pages(spark, page_rows):
    return spark.createDataFrame(page_rows, PAGES).repartition(3)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected_records(rows, least=0):
    for i, _, text, *_ in rows:
        same = [r[0] for r in rows if (r[2] or "") == (text or "") and r[0] is not None]
        size = len((text or "").encode())
        first = min(same, default=None) if size >= least else None
        revisit = first is not None and i != first
        yield i, size, digest(text), "revisit" if revisit else "response", first if revisit else None


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in row)


@pytest.mark.parametrize("least", [0, 5, 10**9])
def test_archive_and_back(spark, pages, page_rows, least):
    path = scratch_path(spark, "warc-test")
    warc.archive(pages, path, least_bytes=least)
    got = warc.read(spark, path).collect()
    assert sorted(((r.row_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_row) for r in got), key=key) == sorted(
        expected_records(page_rows, least), key=key
    )
    for r in got:
        if r.record_type == "response":
            assert digest(r.payload.decode()) == r.payload_digest
        else:
            assert r.payload is None and r.refers_to == warc.record_name(r.refers_to_row, r.payload_digest)
    names = {r.record_id for r in got}
    assert all(r.refers_to in names for r in got if r.record_type == "revisit")


def test_filters_are_pushed_down(spark, pages):
    path = scratch_path(spark, "warc-test")
    warc.archive(pages, path)
    revisits = warc.read(spark, path, payload=False).where("record_type = 'revisit' and target_uri is not null and payload_bytes > 3")
    assert "record_type" not in str(revisits._jdf.queryExecution().executedPlan()).split("Filter", 1)[-1].split("BatchScan")[0]
    assert revisits.count() == 1
    assert warc.read(spark, path).where("record_type in ('response') and target_uri like 'http%'").count() == 2
    assert warc.read(spark, path).where("row_id is null").count() == 2


def test_a_skipped_payload_is_not_inflated(spark, tmp_path):
    row = {"row_id": 1, "target_uri": "u", "date": "d", "payload_digest": "X", "payload_bytes": 9, "refers_to_row": None, "payload": b"p" * 10**6}
    good = warc.member(*warc.record(row))
    broken = bytearray(warc.member(*warc.record(row | {"row_id": 2, "payload": bytes(range(256)) * 4000})))
    broken[-3000:-8] = bytes(2992)
    (tmp_path / "a.warc.gz").write_bytes(bytes(broken) + good)
    got = warc.read(spark, str(tmp_path)).where("row_id = 1").collect()
    assert [r.row_id for r in got] == [1] and len(got[0].payload) == 10**6
    assert [r.row_id for r in warc.read(spark, str(tmp_path), payload=False).collect()] == [2, 1]


def test_archives_of_others(spark, tmp_path):
    """Plain records, plain gzip members, one member of several records; any gzip reader reads ours."""
    row = {"row_id": 1, "target_uri": "u", "date": "d", "payload_digest": "X", "payload_bytes": 4, "refers_to_row": None, "payload": b"text"}
    plain = [b"".join(warc.record(row | {"row_id": i})) + b"\r\n\r\n" for i in range(4)]
    (tmp_path / "a.warc").write_bytes(plain[0] + plain[1])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(plain[2]) + gzip.compress(plain[3] + plain[0]))
    got = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r.row_id for r in got) == [0, 0, 1, 2, 3] and {r.payload for r in got} == {b"text"}
    assert warc.read(spark, str(tmp_path)).where("row_id = 3").count() == 1
    assert gzip.decompress(warc.member(*warc.record(row))) == b"".join(warc.record(row)) + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", [True, False])
def test_http_headers_of_any_length(spark, tmp_path, zipped):
    """The payload's length is found behind a long header, with the payload asked for or not, and is unknown without one."""
    long = "HTTP/1.1 200 OK\r\nX-Long: " + "y" * 9000 + "\r\nContent-Length: 5\r\n\r\nhello"
    blocks = [long.encode(), long.encode() + b"x" * 5000, b"no header at all " * 400, b"HTTP/1.1 200 OK\r\nwithout an end" * 300, b""]
    data = b""
    for i, block in enumerate(blocks):
        head = f"WARC/1.1\r\nWARC-Type: response\r\nRow-ID: {i}\r\nContent-Length: {len(block)}\r\n\r\n".encode()
        data += warc.member(head, block) if zipped else head + block + b"\r\n\r\n"
    (tmp_path / "long.warc").write_bytes(data)
    for payload in (True, False):
        got = warc.read(spark, str(tmp_path), payload).select("row_id", "payload_bytes").collect()
        assert sorted(map(tuple, got)) == [(0, 5), (1, 5), (2, None), (3, None), (4, None)]


def test_names_of_an_object_store():
    for scheme in ("s3a", "s3n", "s3"):
        system, inner = warc.file_system(f"{scheme}://bucket/folder/?region=us-east-1")
        assert system.type_name == "s3" and inner == "bucket/folder"


def test_no_pages(spark, pages):
    path = scratch_path(spark, "warc-test")
    warc.archive(pages.where("page_id = -1"), path)
    assert warc.read(spark, path).collect() == []


# Page text


def test_main_text_of_the_small_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r for r in extraction.extract(pages).collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*?)</article>", page.html, re.DOTALL)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article))
        assert got[page.page_id].text == "\n".join(p for p in parts if p)
        assert got[page.page_id].n_chars == len(got[page.page_id].text)


SENTENCE = "The cat and the dog of the house went to the park with all of their friends and it was a good day for them."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>Hello", "Hello"),
        ("a &amp; b &lt;c&gt; &#233;&nbsp;x", "a & b <c> é x"),
        ("<script>var a = '<p>no</p>';</script><p>yes</p><style>p{}</style>", "yes"),
        (f"<nav><a href=x>Menu</a></nav><p>{SENTENCE}</p><p>Short.</p><p>{SENTENCE}</p>", f"{SENTENCE}\nShort.\n{SENTENCE}"),
        (f"<h2>Title</h2><p>{SENTENCE}</p><p>by us</p><div class='sidebar'>{SENTENCE}</div>", f"Title\n{SENTENCE}"),
        (f"<p>{SENTENCE}</p><div id=comments><p>{SENTENCE}</p></div><footer>{SENTENCE}</footer>", SENTENCE),
        (f"<article><p>One.<br>Two<p>Three</article><form><p>{SENTENCE}</p></form>", "One. Two\nThree"),
        (f"<p>{SENTENCE}</p><p><a href=x>{SENTENCE}</a></p>", SENTENCE),
        (f"<!-- <p>no</p> --><article>x<div class='ad'>{SENTENCE}</div>y</article>", "x\ny"),
        ("<p a=\"b>c</p>d", "c\nd"),
        ("<p>x</div></section></p><!-- never closed <p>y", "x"),
    ],
)
def test_block_rules(page, text):
    assert extraction.main_text(page) == text


LINKS = "<ul>" + "<li><a href=x>Some other page</a></li>" * 6 + "</ul>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><main>{LINKS}<h1>Title</h1><p>{SENTENCE}</p><p>Short.</p>{LINKS}<p>Popular now</p>{LINKS}</main>", f"Title\n{SENTENCE}\nShort."),
        (f"<article><p>{SENTENCE}</p><p>{'Lamps 1999 ' * 9}</p><p>{SENTENCE}</p></article>", f"{SENTENCE}\n{('Lamps 1999 ' * 9).strip()}\n{SENTENCE}"),
        (f"<article><p>{SENTENCE}</p><p><a href=x>{SENTENCE}</a></p></article>", SENTENCE),
        (f"<div>{LINKS}<h1>Title</h1><p>{SENTENCE}</p><p>{SENTENCE}</p>{LINKS}</div>", f"Title\n{SENTENCE}\n{SENTENCE}"),
        ("<main><p>One.</p><p>Two.</p></main>", "One.\nTwo."),
    ],
)
def test_block_rules_decide_inside_articles(page, text):
    assert extraction.main_text(page) == text


BODY = f"<p>{SENTENCE}</p><p>{SENTENCE}</p>"
BODY_TEXT = f"{SENTENCE}\n{SENTENCE}"


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-sidebar", "with-comments", "page with-nav"])
@pytest.mark.parametrize("inner", [f"<article>{BODY}</article>", f"<main>{BODY}</main>", BODY])
def test_one_word_of_a_name_puts_no_page_out(name, inner):
    page = f"<body><div class='{name}'>{inner}<div class='sidebar'><p>{SENTENCE}</p></div></div><div id=comments><p>{SENTENCE}</p></div></body>"
    assert extraction.main_text(page) == BODY_TEXT


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form action=x><div>{BODY}</div></form></body>",
        f"<form><article>{BODY}</article></form>",
        f"<div class=sidebar><main>{BODY}</main></div>",
        f"<article>{BODY}</article><div class='comments'><article><p>{SENTENCE}</p></article></div>",
        f"<div class='has-sidebar'><article>{BODY}</article><div class='related'><article><p>{SENTENCE}</p></article></div></div>",
        f"{BODY}<div class='comments'><article><p>{SENTENCE}</p></article></div>",
    ],
)
def test_forms_and_names_around_the_page(page):
    assert extraction.main_text(page) == BODY_TEXT


@pytest.mark.parametrize("tag", ["svg", "math", "object", "select", "canvas", "audio", "video", "iframe", "noscript"])
def test_a_raw_tag_without_an_end_cuts_nothing(tag):
    assert extraction.main_text(f"<p>{SENTENCE}</p><{tag} a=b><p>{SENTENCE}</p>") == BODY_TEXT


TOLD = "It was told that the history of the town is as long as that of the river and of all who have lived there. "


@pytest.mark.parametrize(
    "part",
    [
        '<section class="share-price"><p>{}</p></section>', '<div class="article-header"><p>{}</p></div>', '<div id="notice-of-1848"><p>{}</p></div>',
        '<p class="banner-text">{}</p>', '<p class="social-history">{}</p>', "<fieldset><p>{}</p></fieldset>", '<p title="the hidden gems of the city">{}</p>',
        '<section aria-label="Hidden places"><p>{}</p></section>', """<div data-x='{{"hidden":false}}'><p>{}</p></div>""",
    ],
)
def test_ordinary_names_and_words_in_values_put_nothing_out(part):
    page = f"<body><article><p>{TOLD}</p>{part.format('Another: ' + TOLD)}</article></body>"
    assert "Another" in extraction.main_text(page)


@pytest.mark.parametrize(
    "part",
    [
        '<div class="comment-body"><p>{}</p></div>', '<div class="ad-slot"><p>{}</p></div>', "<p hidden>{}</p>", '<p style="display: none">{}</p>',
        '<div class="share-buttons"><a href="x">{}</a></div>', '<div class="notice"><p>{}</p></div>', '<div class="related-posts share"><p>{}</p></div>',
    ],
)
def test_parts_that_say_what_they_are_go(part):
    page = f"<body><article><p>{TOLD}</p>{part.format('Another: ' + TOLD)}</article></body>"
    assert "Another" not in extraction.main_text(page)


def test_raw_tags_without_ends():
    assert extraction.main_text(f"<p>{SENTENCE}</p><script>x<p>{SENTENCE}</p>") == SENTENCE
    assert extraction.main_text(f"<p>{SENTENCE}</p><select><p>{SENTENCE}</p><select><option>x</select>") == BODY_TEXT
    assert extraction.main_text("<select>" * 30_000 + f"<p>{SENTENCE}</p>" + "</select>") in ("", SENTENCE)


OTHERS = {
    "ru": "Вчера вечером жители города собрались на площади, чтобы послушать музыку и поговорить о том, что случилось за год.",
    "pl": "Wczoraj wieczorem mieszkańcy miasta zebrali się na rynku, żeby posłuchać muzyki i porozmawiać o tym, co się wydarzyło.",
    "zh": "昨天晚上，城市的居民们聚集在广场上，一起听音乐，谈论这一年里发生的事情，孩子们在旁边高兴地跑来跑去。",
    "ja": "昨日の夜、町の人々は広場に集まり、音楽を聴きながら、この一年に起きた出来事について長いあいだ語り合っていました。",
    "ar": "اجتمع سكان المدينة مساء أمس في الساحة ليستمعوا إلى الموسيقى ويتحدثوا عن كل ما حدث خلال هذا العام الطويل.",
}


@pytest.mark.parametrize("language", sorted(OTHERS))
def test_pages_in_other_languages(language):
    text = OTHERS[language]
    page = f"<nav><a href=x>{text}</a></nav><h1>{text[:12]}</h1><p>{text}</p><p>{text}</p><div>{LINKS}</div><footer>{text}</footer>"
    title = text[:12].strip()
    assert extraction.main_text(page) == f"{title}\n{text}\n{text}"
    # On a page of a known language, long blocks without its stop words are still none of the text.
    assert extraction.main_text(f"<p>{SENTENCE}</p><p>{SENTENCE}</p><p>{'Lamps 1999 ' * 9}</p>") == BODY_TEXT


def test_pages_that_are_broken_or_deep():
    assert extraction.main_text("<div>" * 30_000 + "x" + "</div>" * 30_000) == "x"
    assert extraction.main_text('<p a="' * 30_000) == ""
    assert extraction.main_text("<" * 30_000) in ("", "<" * 30_000)


def test_odd_pages(spark, pages, page_rows):
    got = extraction.extract(pages).collect()
    assert len(got) == len(page_rows)
    assert all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert extraction.extract(pages.where("page_id = -1")).collect() == []


# Embeddings


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(300, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.04
    crowd = base[0] + rng.normal(size=(120, 16)) * 0.05
    rows = [list(map(float, v)) for v in np.concatenate([base, near, near[:5], crowd, base[:3] * 1e-30, base[3:5] * 1e30])]
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 15 + [None], [1.0, 2.0], [2.0, 4.0], [1.0, -2.0]]
    return [(None if i == 7 else i - 3 if i % 50 == 0 else i, v) for i, v in enumerate(rows)]


def plain_links(rows, cosine=0.95):
    n = len(rows)
    unit = []
    for _, v in rows:
        x = np.array(v if v and None not in v else [0.0], np.float32).astype(float)
        good = v and np.isfinite(x).all() and x.any()
        unit.append(x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) if good else None)
    linked = [
        (i, j) for i in range(n) for j in range(i)
        if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine
    ]
    counts, group = [0] * n, list(range(n))
    for i, j in linked:
        counts[i] += 1
        counts[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            if group[i] != group[j]:
                group[i] = group[j] = min(group[i], group[j])
                changed = True
    least = {}
    for i, g in enumerate(group):
        least[g] = min((x for x in (least.get(g), rows[i][0]) if x is not None), default=None)
    return [(rows[i][0], counts[i], least[group[i]]) for i in range(n)]


@pytest.mark.parametrize(("recall", "block"), [(1.0, 2048), (1.0, 16), (0.99, 2048)])
def test_links_and_groups(spark, monkeypatch, recall, block):
    monkeypatch.setattr(embeddings.links, "__defaults__", (block,))
    rows = vectors()
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, uid string")
    got = embeddings.near_duplicates(table, recall=recall).collect()
    expected = plain_links(rows)
    assert len(got) == len(rows)
    if recall == 1:
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(expected, key=key)
        assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    else:
        assert sum(r.n_links for r in got) >= 0.95 * sum(x[1] for x in expected)


@pytest.mark.parametrize(("recall", "least"), [(None, 1.0), (0.9999, 0.999), (0.99, 0.97)])
def test_links_along_the_directions_of_the_data(spark, monkeypatch, recall, least):
    """Vectors of four directions in 64 dimensions, each with a neighbour along them, and many cells."""
    monkeypatch.setattr(embeddings, "CELL_ROWS", 16)
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base, moves = unit(rng.normal(size=(1500, 4))), rng.normal(size=(1500, 4))
    moves = unit(moves - (moves * base).sum(axis=1, keepdims=True) * base)
    flat = np.concatenate([base, 0.952 * base + np.sqrt(1 - 0.952**2) * moves])
    rows = (flat @ np.linalg.qr(rng.normal(size=(64, 4)))[0].T).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    got = embeddings.near_duplicates(table, **({} if recall is None else {"recall": recall})).collect()
    exact = unit(rows.astype(float))
    expected = (exact @ exact.T >= 0.95).sum(axis=1) - 1
    found = {r.vec_id: r.n_links for r in got}
    if recall is None:
        assert [found[i] for i in range(len(rows))] == expected.tolist()
    assert expected.sum() >= sum(found.values()) >= least * expected.sum()


def test_links_and_groups_at_the_first_recall(spark, monkeypatch):
    test_links_and_groups(spark, monkeypatch, 0.9999, 2048)


def test_components_that_floats_do_not_hold(spark):
    """Doubles are compared as doubles, however large or small, and numbers of other kinds as doubles, too."""
    rows = [(1, [1e300, 2e300]), (2, [1e-300, 2e-300]), (3, [0.5, 1.0]), (4, [1e300, -2e300]), (5, [1e-320, 0.0]), (6, [0.0, 0.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6)]
    whole = spark.createDataFrame([(1, [2**40, 1]), (2, [2**41, 2]), (3, [1, 2**40])], "vec_id long, embedding array<bigint>")
    assert sorted((r.vec_id, r.n_links) for r in embeddings.near_duplicates(whole).collect()) == [(1, 1), (2, 1), (3, 0)]


def test_no_vectors(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(table).collect() == []
    table = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(table).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}


def test_traversal_is_in_order_and_complete():
    rng = np.random.default_rng(1)
    first, second = rng.random(9), rng.random(7)
    found = embeddings.traverse(first, second, 0.8)
    costs = [first[i] ** 2 + second[j] ** 2 for i, j in found]
    assert costs == sorted(costs)
    assert set(found) == {(i, j) for i in range(9) for j in range(7) if first[i] ** 2 + second[j] ** 2 <= 0.64}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(7, 7), (None, 3), (3, None), (200, 201), (201, 200)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r.node: r.root for r in got}
    assert all(roots.get(i, 0) == 0 for i in range(61)) and all(roots[x] == 100 for x in range(101, 140)) and roots[201] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_queries_are_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_beside_their_sql(spark, name):
    from check_oracle import compare, connect

    ok, text = compare(spark, connect(SMALL), SMALL, name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, text
