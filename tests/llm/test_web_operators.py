"""Archives, URL filter and page text on small tables, against plain computations."""

import gzip
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspan.llm import html_lstm, url_reputation, warc
from tallyspan.session import new_folder

LONG = "<p>" + "ä b\r\n\r\nWARC/1.1\r\n" * 30_000 + "</p>"


@pytest.fixture(scope="module")
def pages():
    same = "<html>" + "same text " * 20 + "</html>"
    return [(3, "http://a.net/x y\r\nEvil: 1", same), (1, "http://a.net/", same), (2, None, same), (4, "x", "short"), (5, "y", "short"), (6, "z", None), (7, "z", ""), (8, "long", LONG), (9, "long", LONG),
            (8, "long", LONG), (None, "n", same), (None, None, None), (10, "e", "\r\n\r\n0\r\n\r\n")]


def page_rows(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return df.select("*", *[F.lit("clash").alias(c) for c in ("uid", "digest", "size", "block", "kind", "host", "rule", "bound", "text", "n", "k", "least")])


def test_archives_round_trip(spark, pages):
    found = warc.round_trip(page_rows(spark, pages)).collect()
    first = {}
    for key, _, text in pages:
        data = (text or "").encode()
        if key is not None and len(data) >= 100:
            first[data] = min(key, first.get(data, key))
    expected = []
    for key, _, text in pages:
        data = (text or "").encode()
        origin = first.get(data, key) if key is not None else None
        revisit = origin is not None and origin < key
        expected.append((str(key), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", str(origin if revisit else None), True))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"]), r["intact"]) for r in found) == sorted(expected)
    assert warc.round_trip(page_rows(spark, [])).count() == 0


def test_long_payloads_are_split_and_joined(spark, pages):
    path = new_folder(spark, "warc")
    warc.write_archives(page_rows(spark, pages), path)
    records = warc.read_records(spark, path)
    kinds = {r["kind"]: r["n"] for r in records.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds["continuation"] >= 10
    texts = sorted(bytes(r["payload"]).decode() for r in warc.payloads(spark, path).collect())
    assert texts.count(LONG) == 2 and "short" in texts
    without = records.filter("not (kind = 'continuation' and segment = 3)")
    assert warc.reassemble(without).filter("not complete").count() == 2
    headless = records.filter("not (kind = 'response' and segment = 1)")
    assert warc.reassemble(headless).filter("record_id is null and not complete").count() == 2


def test_chunks():
    for text in ("", "a", "äöü" * 5000, "x" * warc.CHUNK, "\r\n0\r\n\r\n"):
        assert warc.dechunked(warc.chunked(text).encode()) == text.encode()
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.parse(b"nonsense\r\n\r\n"))


def test_archives_are_plain_warc(spark, pages):
    path = new_folder(spark, "warc")
    warc.write_archives(page_rows(spark, pages), path)
    local = path.removeprefix("file:")
    if not os.path.isdir(local):
        pytest.skip("the shared folder is not a local one here")
    for name in os.listdir(local):
        if name.endswith(".gz"):
            data = gzip.open(f"{local}/{name}").read()
            assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n") or not data


URLS = [
    ("https://m.Example.NET/en/1", "m.example.net", "/en/1", "example.net/en/", "allow"), ("http://example.net", "example.net", "", None, None), ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
    ("http://a.example.com/de/x?y#z", "a.example.com", "/de/x", "example.com/de/", "block"), ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"), ("http://notexample.com/de/", "notexample.com", "/de/", None, None),
    ("http://h?q/en/", "h", "", None, None), ("ftp://u@h.co.uk:80/a#b", "u@h.co.uk:80", "/a", None, None), ("nothing", "", "", None, None), (None, "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("line\n://host/p\nq", "host", "/p\nq", None, None),
]


def test_urls_and_rules(spark):
    rows = page_rows(spark, [(i, u[0], None) for i, u in enumerate(URLS)] + [(None, URLS[0][0], None), (0, URLS[0][0], None)])
    none = spark.createDataFrame([], "page_id bigint, bad boolean")
    found = url_reputation.judge(rows, none).collect()
    assert len(found) == len(URLS) + 2
    for r in found:
        url, host, path, rule, verdict = URLS[r["page_id"] or 0]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert url_reputation.judge(page_rows(spark, []), none).count() == 0


def test_hosts_are_shrunk_towards_their_domains(spark):
    rows, outcomes = [], []
    for host, n, bad in (("bad.farm.com", 200, 190), ("new.farm.com", 0, 0), ("also.farm.com", 60, 55), ("good.site.com", 300, 5), ("one.site.com", 1, 1), ("ok.other.co.uk", 100, 2)):
        for i in range(max(1, n)):
            rows.append((len(rows), f"http://{host}/{i}", None))
            if n:
                outcomes.append((len(rows) - 1, i < bad))
    outcomes += [(None, True), (10**9, True), (0, None), (1, True), (1, False)]
    found = url_reputation.host_reputation(page_rows(spark, rows).select("page_id", url_reputation.host_of(F.col("url")).alias("host")), spark.createDataFrame(outcomes, "page_id bigint, bad boolean"))
    rate = {r["host"]: (r["rate"], r["bound"]) for r in found.collect()}
    assert rate["bad.farm.com"][1] > 0.8 and rate["good.site.com"][0] < 0.1
    assert rate["one.site.com"][1] < 0.3 < rate["new.farm.com"][0]
    verdicts = {r["host"]: r["verdict"] for r in url_reputation.judge(page_rows(spark, rows), spark.createDataFrame(outcomes, "page_id bigint, bad boolean"), ()).collect()}
    assert verdicts["bad.farm.com"] == "block" and verdicts["one.site.com"] == verdicts["good.site.com"] == "allow"


# --- pages


def test_blocks_of_broken_markup():
    page = """<!doctype html><head><title>no</title><style>p{}</style><body class="a"><nav><ul><li><a href=x>one</a><li>two</ul></nav><p>first &amp; <b>bold<br>more<p>second &lt;tag&gt; &eacute &#65;
    <script>var t="</p><p>no</p>";</script><!-- <p>no --><div id='x y'>third 1 < 2 <a title="a>b">link</a></div></span></body><p>open"""
    found = html_lstm.blocks(page)
    assert [b.text for b in found] == ["one", "two", "first & bold more", "second <tag> é A", "third 1 < 2 link", "open"]
    assert found[4].path[-3:] == ("div", "x", "y") and found[0].linked == 1 and 0 < found[4].linked < 1
    assert html_lstm.blocks(None) == html_lstm.blocks("") == [] and [b.text for b in html_lstm.blocks("just text")] == ["just text"]
    assert html_lstm.blocks("<script>never closed") == [] and html_lstm.blocks("<p") == []
    many = html_lstm.blocks("<div>" * 3000 + "deep" + "</div>" * 3000)
    assert [b.text for b in many] == ["deep"]


def test_gradients_of_the_labeller():
    random = np.random.default_rng(0)
    labeller = html_lstm.Labeller(hidden=3)
    labeller.w = {k: v.astype(np.float64) for k, v in labeller.w.items()}
    x, mask = html_lstm.padded([random.normal(size=(n, html_lstm.WIDTH)).astype(np.float32) for n in (4, 2)])
    y = random.integers(0, 2, mask.shape).astype(np.float32)

    def loss():
        p = labeller.read(x, mask)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    found = labeller._gradients(x, mask, y)
    for name, weight in labeller.w.items():
        at = tuple(int(i) for i in np.unravel_index(int(np.abs(found[name]).argmax()), weight.shape))
        start = weight[at]
        weight[at] = start + 1e-3
        above = loss()
        weight[at] = start - 1e-3
        below = loss()
        weight[at] = start
        assert found[name][at] == pytest.approx((above - below) / 2e-3, rel=0.02, abs=1e-5)


def test_articles_without_the_rest(spark):
    texts = [f"Sentence number {i} of the story goes on with some words and ends here." for i in range(30)]
    story = "".join(f"<p>{t}</p>" for t in texts[:8])
    around = lambda body: f"""<html><body><header class="site-header"><div>Site name</div></header><nav><ul><li><a href="/">Home</a></li><li><a href="/b">About us</a></li></ul></nav>
      <div class="cookie-notice">We use cookies on this site. <button>OK</button></div>{body}<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/c">Other story</a></li></ul></aside>
      <form><label>Mail</label><input><button>Send</button></form><section id="comments"><h3>Comments</h3><div class="comment"><p>{texts[20]}</p></div></section>
      <footer>&copy; 2020 Site &middot; rights</footer></body></html>"""  # noqa: E731
    rows = [(i, f"u{i}", around(f"<article><h1>Title {i} of it</h1>{story}</article>")) for i in range(20)]
    rows += [(100, "v", around(f'<div class="content"><h1>Title of this</h1>{story}<div class="ad">Buy now</div><ul><li>{texts[9]}</li></ul></div>')), (101, None, None), (102, "w", ""), (None, "x", rows[0][2]), (103, "y", "<script>x</script>"),
             (104, "z", around("<article>" + "".join(f"<p>{texts[i % 30]}</p>" for i in range(3000)) + "</article>")), (0, "u0", rows[0][2])]
    found = html_lstm.extract(page_rows(spark, rows)).collect()
    assert len(found) == len(rows)
    by_id = {r["page_id"]: r for r in found}
    assert all(by_id[i]["text"] == "\n".join([f"Title {i} of it", *texts[:8]]) for i in range(20)) and by_id[None]["text"] == by_id[0]["text"]
    assert by_id[100]["text"] == "\n".join(["Title of this", *texts[:8], texts[9]])
    assert by_id[101]["text"] == by_id[102]["text"] == by_id[103]["text"] == "" and by_id[101]["url"] is None
    assert by_id[104]["text"] == "\n".join(texts[i % 30] for i in range(3000)) and by_id[104]["n_chars"] == len(by_id[104]["text"])
    assert html_lstm.extract(page_rows(spark, [])).count() == 0
