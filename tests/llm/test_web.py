"""WARC salvage and main-text extraction."""

import base64
import gzip
import hashlib
import html
import re

import duckdb
import numpy as np

from stratus.llm import html_blocks, html_extract, queries, warc

SF001 = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, payload_bytes int, kind string, text string, refers_to string"


def odd_pages(spark):
    rows = [(1, "http://a/ b\n", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "u", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (5, "u", "x"), (None, "n", "<p>same</p>"), (None, "n", "only here"), (6, "long", "<p>" + "wörd " * 40_000)]
    return spark.createDataFrame([(*r, 1, "k", "t", "r") for r in rows], PAGES)


def round_trip(spark, pages, tmp_path, **options):
    path = f"file://{tmp_path}/warc"
    warc.write_warc(warc.plan_records(pages, **options), path)
    return warc.read_warc(spark, path)


def test_warc_query_equals_plain_reading(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.QUERIES["op7_warc_salvage"](spark, SF001).collect()}
    last = {}
    for p in pages:
        last[p.html] = max(p.page_id, last.get(p.html, p.page_id))
    assert sorted(got) == sorted(p.page_id for p in pages)
    for p in pages:
        r, raw = got[p.page_id], p.html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[p.html] == p.page_id else ("revisit", last[p.html]))


def test_warc_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF001}/pages.parquet'")
    want = con.sql(queries.ORACLE["op7_warc_salvage"])
    got = queries.QUERIES["op7_warc_salvage"](spark, SF001)
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_warc_of_odd_rows(spark, tmp_path):
    read = round_trip(spark, odd_pages(spark), tmp_path)
    rows = read.withColumn("page_id", warc.page_number(read.record_id)).withColumn("to", warc.page_number(read.refers_to)).collect()
    assert len(rows) == 9 and all(r.kind == "record" for r in rows)
    found = sorted(((r.page_id or 0, r.record_type, r.to, r.payload_bytes) for r in rows), key=str)
    assert found == sorted([(0, "response", None, 9), (0, "revisit", 2, 11), (1, "revisit", 2, 11), (2, "response", None, 11), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 1), (5, "response", None, 38), (6, "response", None, 240_003)], key=str)
    for r in rows:
        if r.record_type == "response":
            assert base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest
    assert round_trip(spark, odd_pages(spark).limit(0), tmp_path / "none").count() == 0


def test_smaller_payloads_than_the_threshold_are_all_responses(spark, tmp_path):
    read = round_trip(spark, odd_pages(spark), tmp_path, min_payload=1)
    assert read.where("record_type = 'revisit' and payload_bytes = 0").count() == 0


def record(n, payload, digest=None, length=None):
    digest = digest or base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n" % (n, digest.encode(), length or len(block)) + block + b"\r\n\r\n"


def salvaged(data):
    records, gaps = [], []
    for kind, start, end, header, _, reason in warc.salvage(data):
        if kind == "record":
            records.append(int(re.search(r"\d+", header["warc-record-id"])[0]))
        else:
            gaps.append((start, end, reason))
    return records, gaps


def test_salvage_of_plain_records():
    good = [record(i, b"payload %d" % i) for i in range(4)]
    assert salvaged(b"".join(good)) == ([0, 1, 2, 3], [])
    bad_digest = record(9, b"x", digest="A" * 32)
    records, gaps = salvaged(good[0] + bad_digest + good[1])
    assert records == [0, 1] and gaps == [(len(good[0]), len(good[0] + bad_digest), "payload digest differs")]
    long = record(9, b"x", length=10_000)
    assert salvaged(good[0] + long + good[1])[0] == [0, 1]
    assert salvaged(good[0] + long)[1][0][2] == "block cut off"
    records, gaps = salvaged(b"junk\n" + good[0] + b"\0\n" + good[1] + b"tail")
    assert records == [0, 1] and [(a, b) for a, b, _ in gaps] == [(0, 5), (5 + len(good[0]), 7 + len(good[0])), (7 + len(good[0] + good[1]), 11 + len(good[0] + good[1]))]
    assert salvaged(b"") == ([], [])


def test_salvage_of_gzip_members():
    members = [gzip.compress(record(i, b"payload %d" % i * 50)) for i in range(5)]
    broken = bytearray(members[2])
    broken[len(broken) // 2] ^= 255
    data = members[0] + members[1] + bytes(broken) + members[3] + record(7, b"plain") + members[4]
    records, gaps = salvaged(data)
    assert records == [0, 1, 3, 7, 4]
    start = len(members[0] + members[1])
    assert [(a, b) for a, b, _ in gaps] == [(start, start + len(broken))]
    assert salvaged(members[0] + members[1][:-20])[0] == [0]
    two = gzip.compress(record(1, b"a") + record(2, b"b"))
    assert salvaged(two) == ([1, 2], [])


def test_every_cut_and_flip_spares_the_other_records():
    parts = [record(i, b"payload %d" % i) for i in range(3)]
    data = b"".join(parts)
    a, b = len(parts[0]), len(parts[0] + parts[1])
    for at in range(a, b):
        flipped = bytearray(data)
        flipped[at] ^= 1
        assert {0, 2} <= set(salvaged(bytes(flipped))[0])


# --- main text

def test_blocks():
    page = "<html><head><title>no</title><style>p{}</style></head><body><div class='Main-Content bigText'><p>One &amp; <b>two</b>three<p>four<br>five<script>var x='</p>'</script></div><!-- no --><ul><li>a<li><a href=x>b c</a></ul>end &lt;"
    inside = ("html", "body", "div", ".main", ".content", ".big", ".text", "p")
    assert html_blocks.blocks_of(page) == [
        (inside, "One & twothree", 0),
        (inside, "four five", 0),
        (("html", "body", "ul", "li"), "a", 0),
        (("html", "body", "ul", "li"), "b c", 3),
        (("html", "body"), "end <", 0),
    ]
    assert html_blocks.blocks_of(None) == html_blocks.blocks_of("") == html_blocks.blocks_of("<p> </p>") == []
    assert [t for _, t, _ in html_blocks.blocks_of('<p title="a>b">x</p> 1 < 2')] == ["x", "1 < 2"]


def test_optional_and_unclosed_tags_lose_no_text():
    def found(page):
        return [t for _, t, _ in html_blocks.blocks_of(page)]

    page = "<html><head><title>T</title><meta charset=utf-8><style>a {}</style><article><p>Main</p></article>"
    assert html_blocks.blocks_of(page) == [(("html", "article", "p"), "Main", 0)]
    assert found('<p>a</p><svg class="i"/><article>Main</article>') == ["a", "Main"]
    assert found('<svg class="i"/><article>Main</article><svg><text>no</text></svg><p>b</p>') == ["Main", "b"]
    for tag in ("svg", "template", "noscript"):
        assert found(f"<body><{tag}><article>Main</article>") == ["Main"]
        assert found(f"<body><{tag}><article>Main</article><{tag}>no</{tag}><p>b</p>") == ["Main", "b"]
    assert found("<p>a<svg>no<svg>no</svg>no</svg> b</p>") == ["a b"]
    assert found("<svg><script>'</svg>'</script>no</svg><p>b</p>") == ["b"]


def article_of(page):
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    text = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))
    return " ".join(html.unescape(text).split())


def test_query_extracts_the_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()}
    rows = queries.QUERIES["op9_html_extraction"](spark, SF001).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    exact = sum(r.text == article_of(pages[r.page_id]) for r in rows)
    assert exact >= 0.95 * len(rows) and all(r.n_chars == len(r.text) for r in rows)


def test_labeller_on_unseen_layouts(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()]
    weights = html_extract.fit(html_extract.examples_of(pages))
    unseen = html_extract.examples_of(pages, seed=77)
    right = np.concatenate([(s > 0) == (y > 0) for s, (_, y) in zip(html_extract.logits(weights, [x for x, _ in unseen]), unseen, strict=True)])
    assert right.mean() > 0.97


def test_lstm_gradients():
    rng = np.random.default_rng(1)
    x, mask = rng.normal(size=(5, 2, html_extract.INPUTS)).astype(np.float32), np.ones((5, 2), np.float32)
    mask[3:, 1] = 0
    w = {k: v.astype(np.float64) for k, v in html_extract.new_weights(rng).items()}
    upper = rng.normal(size=(5, 2, html_extract.HIDDEN)) * mask[:, :, None]

    def value(wh):
        return float((html_extract.lstm(x, mask, w["wxf"], wh, w["bf"])[0] * upper).sum())

    _, kept = html_extract.lstm(x, mask, w["wxf"], w["whf"], w["bf"], True)
    _, dwh, _ = html_extract.lstm_back(x, mask, w["wxf"], w["whf"], kept, upper.astype(np.float64))
    for i, j in ((0, 0), (3, 40), (10, 70)):
        up, down = w["whf"].copy(), w["whf"].copy()
        up[i, j] += 1e-2
        down[i, j] -= 1e-2
        assert abs((value(up) - value(down)) / 2e-2 - dwh[i, j]) < 2e-3


def test_extraction_of_odd_rows(spark):
    pages = odd_pages(spark)
    rows = html_extract.extract(pages).collect()
    assert len(rows) == 9 and all(r.n_chars == len(r.text) for r in rows)
    assert {r.text for r in rows if r.page_id in (3, 4)} == {""}
    assert html_extract.extract(pages.limit(0)).count() == 0
