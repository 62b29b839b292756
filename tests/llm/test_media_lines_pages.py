import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docjson.llm import audio, html_extract, line_templates, queries


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=200))
def test_wave_round_trip(text):
    payload, n = audio.payload_of(text)
    assert len(payload) % 64 == 0 and len(payload) > 0 and payload[:n] == text.encode() and set(payload[n:]) <= {0}
    assert audio.read_wave(audio.store_wave(payload)) == payload


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 3), (3, 2), (5, 8), (1, 1)])
def test_polyphase_equals_stuffing_and_filtering(up, down):
    x = np.random.default_rng(0).normal(size=3000).astype(np.float32)
    phases = audio._phases(up, down)
    h, delay = phases.T.reshape(-1), (phases.shape[1] * up - 1) // 2
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    full = np.convolve(stuffed, h)
    m = np.arange(-(-len(x) * up // down)) * down + delay
    want = np.where(m < len(full), full[np.minimum(m, len(full) - 1)], 0)
    assert np.allclose(audio.resample(x, up, down), want, atol=1e-4)


def test_blocks_do_not_matter(monkeypatch):
    x = np.random.default_rng(1).normal(size=5000).astype(np.float32)
    whole = audio.resample(x)
    monkeypatch.setattr(audio, "BLOCK", 100)
    assert np.allclose(audio.resample(x), whole, atol=1e-6)


def test_a_tone_is_heard_where_it_is():
    rate = audio.RATE * audio.UP // audio.DOWN
    t = np.arange(3 * audio.RATE) / audio.RATE
    x = (0.5 * np.sin(2 * np.pi * 1000 * t) * ((t > 1) & (t < 2)) + 1e-3 * np.random.default_rng(2).normal(size=len(t))).astype(np.float32)
    mels, energy = audio.log_mel(audio.resample(x), rate)
    (a, b), = audio.active_spans(energy)
    assert abs(a * audio.STEP / rate - 1) < 0.05 and abs(b * audio.STEP / rate - 2) < 0.05
    centre = np.argmax(audio._filterbank(rate)[round(1000 * audio.FFT / rate)])
    assert np.argmax(mels[len(mels) // 2]) == centre


def test_hysteresis():
    assert audio.active_spans(np.array([0, 0, 4, 7, 4, 2, 4, 0, 0, 0, 0.0])) == [(2, 5)]


def test_audio_table(odd, empty):
    made = audio.text_audio(odd)
    for r in made.collect():
        table = audio.read_tensors(r["tensors"])
        kind = table.schema.field("log_mel").type
        assert isinstance(kind, pa.FixedShapeTensorType) and list(kind.shape) == [audio.TENSOR, audio.BANDS]
        assert table.num_rows == -(-r["n_frames"] // audio.TENSOR)
    rows = {}
    texts = {(r["doc_id"], r["text"]) for r in odd.collect()}
    for r in audio.digests(made).collect():
        rows[r["doc_id"]] = r
    for i, t in texts:
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert rows[6]["feature"] == rows[7]["feature"] and rows[1]["media_sha256"] == rows[2]["media_sha256"]
    assert audio.digests(audio.text_audio(empty)).count() == 0


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=12), st.lists(st.sampled_from("abcdef"), max_size=12))
def test_common_lines(a, b):
    found = sorted(html_extract.common_lines(a, b))
    assert len(found) == lcs(a, b)
    rest = iter(b)
    assert all(any(x == y for y in rest) for x in (a[i] for i in found))


def text(source, other=None):
    page = html_extract.Page(1, "http://h/a", html_extract.parse(source))
    return html_extract.main_text(page, *([html_extract.Page(2, "http://h/b", html_extract.parse(other))] if other else []))[0]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<article><h1>T</h1><p>a <b>b</b>c<p>d&amp;e &lt;x&gt; &eacute;&#33;</article>", "T a bc d&e <x> é!"),
        ("<body><header>H</header><main><header><h1>T</h1></header><p>x</p></main><footer>f</footer>", "T x"),
        ("<nav>n</nav><div class='ad box'>a</div><article>x<aside>y</aside><div id=comments><p>c</div>z</article>", "x z"),
        ("<div class='cookie-notice'>c</div><p>only p</p><form><p>f</p></form>", "only p"),
        ("<script>var a='</p>';</script><style>p{}</style><p>x<!-- y --> z</p>", "x z"),
        ("<p>a<br>b</p><ul><li>c<li>d</ul><table><tr><td>e<td>f</table>", "a b c d e f"),
        ("<article><p hidden>no</p><p style='display:none'>no</p><p aria-hidden=true>no</p><p>yes</p></article>", "yes"),
        ("<p>broken <b>never closed", "broken never closed"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<article>a<script>never closed", "a"),
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a&nbsp; \n b</p>", "a b"),
        ("<div class=sidebar><div>x</div></div><p>y</p>", "y"),
        ("<p>Hello <span class='ad'>Buy now</span> world</p>", "Hello world"),
        ("<p>a<span class='ad'>buy <span>it</span> now</span>b <span>c <i>d</i></span></p>", "ab c d"),
        ("<article><p class='search-note'>x</p><div class='reply-to-critics'>y</div><div class='comment-list'>no</div><math><mi>z</mi></math></article>", "x y z"),
        ("<div class='page has-sidebar'><article><p>x</p></article><div class='main sidebar'>z</div></div>", "x"),
    ],
)
def test_structure(source, want):
    assert text(source) == want


def test_difference_deletes_template_lines_and_spares_articles():
    a = "<div>Welcome to Host</div><div>story one</div><div>All rights</div>"
    b = "<div>Welcome to Host</div><div>story two</div><div>All rights</div>"
    assert text(a) == "Welcome to Host story one All rights" and text(a, b) == "story one"
    art = "<article><p>quoted line</p><p>mine</p></article>"
    assert text(art, "<article><p>quoted line</p><p>other</p></article>") == "quoted line mine"


def site(n, host="site", copies=()):
    """Pages of one host without any mark of structure: a template around a story, with a sentence that two stories quote."""
    body = lambda i: f"<div>Site {host}</div><div>Home News Sport</div><div>story {i} of {host} told at length</div>{'<div>a quoted line</div>' if i in (3, 4) else ''}<div>All rights reserved</div>"
    rows = [(i, f"https://{host}.org/x/{i:04}", body(i)) for i in range(n)]
    return rows + [(n + k, f"https://{host}.org/x/{i:04}?again={k}", body(i)) for k, i in enumerate(copies)]


def test_differencing_decides_where_nothing_is_marked(spark):
    rows = site(40, copies=(7, 7, 7, 12)) + site(300, "large") + site(1, "alone")
    docs = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "page_id long, url string, html string")
    told = {parts: {r["page_id"]: (r["text"], r["n_deleted"]) for r in html_extract.extract(docs, parts).collect()} for parts in (1, 3, 12)}
    assert told[1] == told[3] == told[12] and len(told[1]) == len(rows)
    for k, (i, url, _) in enumerate(rows[:-1]):
        host, number = ("site" if k < 44 else "large"), int(url.split("?")[0][-4:])
        quote = " a quoted line" if number in (3, 4) else ""
        assert told[1][k] == (f"story {number} of {host} told at length{quote}", 3)
    assert told[1][len(rows) - 1] == ("Site alone Home News Sport story 0 of alone told at length All rights reserved", 0)


def test_pages(spark):
    page = lambda i, body: f"<div>Site name</div><div>{body}</div><div>Imprint</div>"
    rows = [(i, f"https://www.host{'a' if i < 6 else 'b'}.org/x/{i}?q=1", page(i, f"story {i}")) for i in range(9)]
    rows += [(20, None, "<p>no url</p>"), (21, "http://lonely.org/", "<p>alone</p>"), (22, "http://[bad", None), (None, "http://n.org/", "<p>t</p>"), (3, "https://www.hosta.org/x/3?q=1", page(3, "story 3"))]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), parts=2).collect()
    assert len(got) == len(rows)
    found = {r["page_id"]: r["text"] for r in got if r["page_id"] != 3}
    assert all(found[i] == f"story {i}" for i in range(9) if i != 3)
    assert found[20] == "no url" and found[21] == "alone" and found[22] == "" and found[None] == "t"
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_every_family_of_a_leaf_has_a_template(spark):
    """Six families with one token count and one beginning, whose variable words, early or late, have no digit."""
    words = lambda k: chr(97 + k) * 3
    rows, at = [], 0
    for f in range(6):
        fixed = " ".join(f"fix{words(f)}{words(j)}" for j in range(5))
        for k in range(5 + f):
            rows.append((at, f"one two three {words(k)} {fixed} {words(k + 9)}" if f % 2 else f"one two three {fixed} {words(k)} {words(k + 9)}"))
            at += 1
    rows.append((at, "one two three four five six seven eight nine ten"))
    got = {r["doc_id"]: r["n_dropped"] for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i < at) for i, _ in rows}


def test_lines_equal_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = {r[0]: r[1:] for r in con.execute(f"select doc_id, text, n_lines, n_dropped from ({queries.ORACLES['op10_line_templates']})").fetchall()}
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in queries.op10_line_templates(spark, sf).collect()}
    assert got == want and any(n for *_, n in want.values())


def test_variable_fields_and_odd_rows(spark, odd, empty):
    rows = [(i, f"Licensed under Version {i}.0 of it\nown line number {i} of doc alpha{i}\nshort") for i in range(5)] + [(9, "Licensed under Version x of it\nunique words stay here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(docs).collect()}
    assert all("Licensed" not in r["text"] for r in got.values())
    assert got[9]["text"] == "unique words stay here" and got[0]["text"] == "short" and got[0]["n_dropped"] == 2
    out = line_templates.drop_recurring_lines(odd)
    rest = [c for c in odd.columns if c != "text"]
    assert [c for c in out.columns if c not in ("text", "n_lines", "n_dropped")] == rest and out.count() == odd.count()
    assert line_templates.drop_recurring_lines(empty).count() == 0


def test_differencing_decides_within_articles(spark):
    """A notice and a byline in every article go; a sentence that many quote at varying places, titles and a reprint stay."""
    words = lambda i: " ".join(f"word{i}x{k}" for k in range(12))
    quote = "<p>a sentence that all of them quote</p>"
    story = lambda i: f"<p>{words(i)}</p>" + (f"{quote}<p>{words(i + 100)}</p>" if i % 3 else f"<p>{words(i + 100)}</p><p>{words(i + 200)}</p>{quote}<p>{words(i + 300)}</p>")
    page = lambda i: f"<article><h1>Title {i}</h1><p>By the staff</p>{story(i)}<p>Write to us</p></article>"
    rows = [(i, f"http://many.org/a/{i:03}", page(i)) for i in range(20)]
    rows += [(30 + i, f"http://two.org/a/{i:03}", page(i)) for i in range(3)]
    rows += [(40 + i, f"http://reprints.org/a/{i:03}", f"<article><p>{words(1)}</p><p>{words(2)}</p><p>{words(i + 10)}</p></article>") for i in range(9)]
    told = {parts: {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), parts).collect()} for parts in (1, 5)}
    assert told[1] == told[5] and len(told[1]) == len(rows)
    whole = {i: html_extract.main_text(html_extract.Page(i, u, html_extract.parse(s)))[0] for i, u, s in rows}
    for i, want in whole.items():
        assert told[1][i] == (want.replace("By the staff ", "").replace(" Write to us", "") if i < 20 else want)


def test_differencing_decides_on_doubtful_names_in_articles():
    page = lambda own, kind: f"<article><p>{own}</p><div class='{kind}'>one and the same</div><div class='reply-to-critics'>reply of {own}</div></article>"
    read = lambda own, kind: html_extract.Page(1, "http://h/a", html_extract.parse(page(own, kind)))
    for kind, want in (("subscribe-now-please", "a reply of a"), ("quotation", "a one and the same reply of a")):
        assert html_extract.main_text(read("a", kind), read("b", kind), read("c", kind))[0] == want
    assert html_extract.main_text(read("a", "subscribe-now-please"))[0] == "a one and the same reply of a"
