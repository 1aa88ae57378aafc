"""Secret scan, URL filter, byte-pair encoding, packing and WARC derivatives on small inputs, against plain versions."""

import glob
import gzip
import html.entities
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citeflow.llm import bpe, packing, secrets, urlfilter, warc
from citeflow.llm.queries import URL_RULES

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", "é́ 漢字 🎉🎉 \x00\x1f", "a<|endoftext|>b <|endoftext|>", "aA" * 3000, "'s'll  't", "İı K ſ ²½"]


def texts(seed, alphabet, n=40, size=200):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n)]


def base_spans(text):
    kinds = [
        ("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[1]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    ]
    found = [(k, m.start(), m.end()) for k, e, flags, ok in kinds for m in re.finditer(e, text or "", flags) if ok(m)]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secrets_match_plain_expressions():
    rng = random.Random(0)
    parts = ["password", "PassWd", "api_key", "APIKEY", "token", "secret", "AKIA", "ABCDEF0123456789", "=", ": ", " ", '"', "'", "é", "K", "ſecret", "0123456789abcdef", "xyz789", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [s for s in secrets.scan_text(text) if s[0] in ("assign", "access", "hex")] == base_spans(text)


def test_checksums_decide():
    body = "A1" * 15
    good = "ghp_" + body + secrets.checksum62(body)
    assert secrets.scan_text(f"x {good} y") == [("github", 2, 42)]
    assert secrets.scan_text("x " + good[:-1] + ("0" if good[-1] != "0" else "1")) == []
    assert secrets.scan_text("4111111111111111") == [("card", 0, 16)] and secrets.scan_text("4111111111111112") == []


def test_private_keys_close_by_label_in_linear_time():
    def plain(text):
        return [m.span() for m in re.finditer(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----.*?-----END \1-----", text, re.DOTALL)]

    parts = ["-----BEGIN A PRIVATE KEY-----", "-----END A PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "-", "x\n", "END PRIVATE KEY-----"]
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert [(a, b) for kind, a, b in secrets.scan_text(text) if kind == "pem"] == plain(text), text
    begun = time.monotonic()
    assert secrets.scan_text("-----BEGIN RSA PRIVATE KEY-----\nabc\n" * 40_000) == []
    assert time.monotonic() - begun < 5


def test_many_rules_of_one_host():
    rules = [("block", f"example.com/p{k}") for k in range(50_000)] + [("allow", "example.com/p1234/x"), ("allow", "com/")]
    root = urlfilter.build_trie(rules)
    begun = time.monotonic()
    for _ in range(2000):
        assert urlfilter.match(root, "www.example.com", "/p12345678/y") == ("block", "example.com/p12345")
        assert urlfilter.match(root, "example.com", "/p1234/xy") == ("allow", "example.com/p1234/x")
        assert urlfilter.match(root, "example.com", "/q") == ("allow", "com/")
    assert time.monotonic() - begun < 2


def test_secret_columns(spark):
    rows = [(1, t, "x") for t in [*ODD, "İ password = hunter22 done", "password = hunter22 done"]] * 2
    df = spark.createDataFrame(rows, "id int, text string, spans string")
    got = secrets.scan_secrets(df).collect()
    assert [[tuple(s) for s in r.spans] for r in got] == [secrets.scan_text(t) for _, t, _ in rows]
    clean = [r.text for r in secrets.redact_secrets(df).collect()]
    assert clean[11] == "[assign] done" and clean[10] == "İ [assign] done" and clean[0] is None
    assert secrets.redact_secrets(df).columns == df.columns and secrets.redact_secrets(df.limit(0)).count() == 0


def plain_rule(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = []
    for verdict, rule in URL_RULES:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "x://net", "x://net/es", "x://net/es/", "x://a.net/fr/1", "x://net/de/",
            "x://com", "x://com/", "x://example.com/en", "x://xexample.com/en/", "x://a.example.com/en/", "x://www.example.com/en/#", "a://b://c/d", "x://example.com?/en/", "x://É.com/\n/y"]
    df = spark.createDataFrame([(i, u, "keep") for i, u in enumerate(urls * 2)], "id int, url string, Host string")
    got = urlfilter.filter_urls(df, URL_RULES).orderBy("id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [plain_rule(u) for u in urls * 2]
    unfinished = urlfilter.build_trie([("block", "a.com/pre"), ("allow", "a.com/prefix/x"), ("block", "b.com")])
    assert urlfilter.match(unfinished, "a.com", "/prefab") == ("block", "a.com/pre")
    assert urlfilter.match(unfinished, "a.com", "/prefix/xy") == ("allow", "a.com/prefix/x")
    assert urlfilter.match(unfinished, "c.b.com", "") == ("block", "b.com")
    with pytest.raises(ValueError):
        urlfilter.build_trie([("maybe", "a/")])


def test_bpe_is_the_library(spark):
    plain = Tokenizer.from_file(PATH)
    some = [*ODD, *texts(1, "ab cde.\né🎉'1 x"), *texts(2, "aA"), *texts(3, "   \n\t\x0b\x85\xa0x"), *texts(4, "'sltm ")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "id int, text string")
    rows = df.select("id", "text", bpe.encode(F.col("text"), PATH, bpe.PATTERN).alias("ids"))
    rows = rows.withColumn("back", bpe.decode(F.col("ids"), PATH, bpe.PATTERN)).orderBy("id").collect()
    for r in rows:
        ids = plain.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.back == plain.decode(ids, skip_special_tokens=False)


def test_compatible_pairs_are_those_that_merging_keeps():
    coder, rng = bpe.tokenizer(PATH, bpe.PATTERN), random.Random(5)
    ids = [i for i in coder.parts if i != 50256]
    for _ in range(4000):
        a, b = rng.choice(ids), rng.choice(ids)
        merged = coder.merged([coder.ids[bytes([c])] for c in coder.parts[a] + coder.parts[b]])
        assert coder.compatible(a, b) == (merged == [a, b])


@pytest.mark.parametrize("capacity", [7, 64])
def test_packing_places_every_piece(spark, capacity):
    plain = Tokenizer.from_file(PATH)
    some = [*ODD, *texts(6, "ab cde. x", 60, 400)] * 2
    df = spark.createDataFrame([(i % 60 if i % 7 else None, t, i) for i, t in enumerate(some)], "doc_id long, text string, piece int").repartition(3)
    got = packing.pack_documents(df, PATH, capacity=capacity, keep_ids=True).toPandas()
    wanted = []
    for _, t, _ in df.collect():
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % capacity + 1
        wanted += [ids[:head], *(ids[k : k + capacity] for k in range(head, len(ids), capacity))]
    assert sorted(map(list, got.ids)) == sorted(wanted)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got.itertuples())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= capacity
    assert got.sequence_id.nunique() <= 1.1 * -(-got.length.sum() // capacity) + 1
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def test_plan_holds_the_histogram():
    rng = random.Random(7)
    for capacity in (1, 5, 50, 200):
        histogram = {n: rng.randint(1, 30) for n in range(1, capacity + 1) if rng.random() < 0.6 or n == capacity}
        runs = packing.plan_runs(histogram, capacity)
        held: dict = {}
        for run in runs:
            assert 0 < run.used() <= capacity
            for n, many in run.items:
                held[n] = held.get(n, 0) + many * run.count
        assert held == histogram
        fits_at_most = max(sum(c for n, c in histogram.items() if 2 * n > capacity), sum(n * c for n, c in histogram.items()) / capacity)
        assert sum(r.count for r in runs) <= 1.1 * fits_at_most + 2


@pytest.mark.parametrize(("shortest", "longest", "at_most"), [(200, 341, 1.02), (257, 400, 1.001), (1, 200, 1.0), (100, 700, 1.005)])
def test_plan_keeps_small_pieces_and_never_needs_more_than_best_fit(shortest, longest, at_most):
    """Next to a lower bound: the volume, or the number of pieces over the most that fit into one sequence."""
    rng = random.Random(11)
    histogram: dict = {}
    for _ in range(60_000):
        n = rng.randint(shortest, longest)
        histogram[n] = histogram.get(n, 0) + 1
    planned = sum(r.count for r in packing.plan_runs(histogram, 1024))
    bound = max(-(-sum(n * c for n, c in histogram.items()) // 1024), -(-60_000 // (1024 // shortest)))
    assert planned <= sum(r.count for r in packing.best_fit([], histogram, 1024))
    assert bound <= planned <= at_most * bound + 1


def test_warc(spark, tmp_path):
    html = "<!DOCTYPE html><html lang=\"fr\"><head><meta charset=\"UTF-8\"><title>T &amp; U</title><style>p{}</style></head>a<!-- x --><p>b &#233;&#xE9;&lt;</p><script>'</p>'</script><a href=\"/x?a&amp;b\">c</a>   d"
    pages = [(1, "http://a/", html), (1, "http://a/", html), (2, None, None), (3, "u", ""), (4, "u", "1 < 2 <!-- open")]
    df = spark.createDataFrame(pages, "page_id int, url string, html string").withColumn("headers", F.lit("HTTP/1.1 200 OK\r\nServer: x"))
    got = warc.derive(warc.responses(df, headers="headers"), keep=["page_id"]).orderBy("page_id", "warc_type").collect()
    assert len(got) == 10 and got[0].content == "a\nb éé<\nc d" and got[0].warc_type == "conversion"
    meta = got[2]
    assert meta.refers_to == got[0].refers_to and "title: T & U\r\ncharset: utf-8\r\nlanguage: fr\r\nlinks: 1\r\noutlink: /x?a&b" in meta.content
    assert f"conversion: {got[0].record_id}" in meta.content and got[0].block_digest in meta.content
    assert [r.content for r in got if r.warc_type == "conversion"][2:] == ["", "", "1 < 2"]
    assert len({r.record_id for r in got}) == 8
    warc.write_warc(warc.derive(warc.responses(df, headers="headers")), str(tmp_path / "w"), F.lit("2024-01-01T00:00:00Z"))
    data = b"".join(gzip.open(f).read() for f in glob.glob(str(tmp_path / "w" / "*.gz")))
    records = 0
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and b"X-Source-Header: Server: x" in head and data[size : size + 4] == b"\r\n\r\n"
        data, records = data[size + 4 :], records + 1
    assert records == 10
    assert warc.derive(warc.responses(df.limit(0))).count() == 0


def test_warc_decodes_all_references(spark):
    numbers = [9, 34, 128, 133, 150, 159, 233, 0xFEFF, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFFFD, 0x10000, 128512, 0x10FFFD, 0x110000, 99999999, 0]
    odd = ["&middot; &mdash;&rsquo;&eacute;&euro;", "&#128512;&#x1F600;&#X1f600", "&amp;lt; &amp;amp; &#38;lt; &amp;#65;", "&copy 2 &notit; &notin; &AMPx",
           "& && &; &#; &#x; &#xg; &nosuch; &nosuch &Z", "&#000000000065;&#x0000000041;", "a&", "&", "&fjlig;&NotEqualTilde;&CounterClockwiseContourIntegral;", "[&zwj;]^&_;"]
    some = [*odd, *[f"x&{name}y" for name in html.entities.html5], *[f"&#{n};-&#x{n:X};" for n in numbers]]
    got = spark.createDataFrame(list(enumerate(some)), "i int, text string").select("i", warc._references(F.col("text")).alias("t")).collect()
    assert [r.t for r in sorted(got)] == [html.unescape(t) for t in some]
    page = spark.createDataFrame([("u", "<title>T &middot; U</title><p>a &middot; b&mdash;&#128512;</p>")], "url string, html string")
    got = {r.warc_type: r for r in warc.derive(warc.responses(page)).collect()}
    assert got["conversion"].content == "T · U\na · b—😀" and got["metadata"].content.startswith("title: T · U\r\n")
    assert got["conversion"].content_length == len("T · U\na · b—😀".encode())


def test_warc_unclosed_elements_and_links(spark):
    pages = {
        "<html><head><meta charset=utf-8><title>T</title><link rel=x><body>a<p>b": ("a\nb", []),
        "<head><title>T</title><script>x</script><div>a</div>b": ("a\nb", []),
        "<head>\n<title>T</title>\n a": ("a", []),
        "<head><title>T</title></head>a": ("a", []),
        "<HEAD></HEAD><header>h</header>a": ("h\na", []),
        "a<script>var s = '<!--';</script>b<p>c</p>": ("a\nb\nc", []),
        "a<!-- <script> -->b<style>/* <!-- */</style>c": ("ab\nc", []),
        "a<!-->b<!--->c<!-- x --!>d": ("abcd", []),
        "a<script>b": ("a", []),
        "a<!-- b": ("a", []),
        "a<noscript>b<p>c": ("ab\nc", []),
        "a<svg/>b<svg><g>x</g></svg>c<template>y</template>d": ("ab\nc\nd", []),
        "<title>The <script> tag</title>a": ("The tag\na", []),
        "<a href='x y'>1</a><a class=c href=/z?a&amp;b>2</a><A\nHREF = \"q'\">3</A>": ("123", ["x y", "/z?a&b", "q'"]),
        "<a title=\"no href='n'\" data-href=m href=h/>1</a><a class='c'href=k>2</a><abbr href=n>3</abbr><a>4</a><a href=''>": ("1234", ["h/", "k", ""]),
        "<!-- <a href=n> --><script>'<a href=' + u + '>'</script><a href=y>1</a>": ("1", ["y"]),
        "<head>" + "<meta name=a>" * 20000 + "<p>a" + "<a" + " b=c" * 20000 + " href=x>": ("a", ["x"]),
    }
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "_shown int, url string, html string")
    got = {(r._shown, r.warc_type): r.content for r in warc.derive(warc.responses(df), keep=["_shown"]).collect()}
    for i, (text, found) in enumerate(pages.values()):
        assert got[i, "conversion"] == text
        lines = got[i, "metadata"].split("\r\n")
        assert f"links: {len(found)}" in lines and [x[9:] for x in lines if x.startswith("outlink: ")] == found
    both = df.select("_shown", warc.plain_text(F.col("html")).alias("t"), warc.links(F.col("html")).alias("l")).orderBy("_shown").collect()
    assert [(r.t, r.l) for r in both] == list(pages.values())
