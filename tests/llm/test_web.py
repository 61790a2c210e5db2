"""URL filters and WARC derivatives."""

import base64
import gzip
import hashlib
import html.parser
import re
import time

import pytest
from pyspark.sql import functions as F

from llm import url_filter, warc

PATHS = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("a.com/X/", "block"))
PATTERNS = tuple((p, "block") for p in url_filter.SPAM)
URLS = ["http://example.org/es/1", "HTTPS://Www.Example.ORG/es/", "http://notexample.org/es/", "http://example.org/en/12?x#y", "http://example.org/en/2", "http://b.com/fr/", "http://b.com/FR/", "http://b.com/de/x", "http://a.com/X/", "http://a.com/x/",
        "http://casino.b.net/", "http://b.net/p/free-software/download/x-crack", "http://b.net/decasino/", "http://casino.org/", "http://org", "http://org/", None, "", "no scheme/es/", "x://", "http://h.com?de/", "http://É.com/de/é", "a://b://example.org/es/", "http://a.com/X/\n?x", "line\n://casino.net"]


def brute(url, paths=PATHS, patterns=PATTERNS):
    """(host, path, rule, verdict) by trying every rule."""
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(r, v) for r, v in paths if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    rule = max(fits, key=lambda r: (len(r[0]), r[0]), default=None)
    words = []
    for p, v in patterns:
        at, place = 0, (host + path).lower()
        for part in p.split("*"):
            m = re.compile(rf"(?<![a-z0-9]){re.escape(part)}(?![a-z0-9])").search(place, at) if at is not None else None
            at = m and m.end()
        if at and place:
            words.append((v != "allow", p, v))
    return host, path, rule and rule[0], rule[1] if rule else min(words)[2] if words else "allow"


def test_every_rule_that_fits_is_fetched(spark):
    pages = spark.createDataFrame([(k, u, "z", "z") for k, u in enumerate(URLS)] * 2, "page_id long, url string, rule string, verdict string")
    rules = url_filter.table_of(spark, PATHS, PATTERNS)
    found = url_filter.judge(pages, rules).collect()
    assert len(found) == 2 * len(URLS)
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == brute(URLS[r.page_id]), URLS[r.page_id]
    assert url_filter.judge(pages.limit(0), rules).count() == 0 and url_filter.judge(pages, rules.limit(0)).where("verdict <> 'allow'").count() == 0


def test_thousands_of_rules_against_trying_every_one(spark):
    """Rules of few words, so that URLs fit several; in one slice and in many."""
    import random

    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("news", "shop", "blog", "cdn", "img", "forum") for b in range(40)]
    paths = sorted({(f"{rng.choice(words)}.{rng.choice(('com', 'net'))}/{'/'.join(rng.sample(words, rng.randrange(3)))}", rng.choice(("allow", "block"))) for _ in range(1500)})
    paths = [(r, v) for k, (r, v) in enumerate(paths) if not k or paths[k - 1][0] != r]
    patterns = [(p, rng.choice(("allow", "block"))) for p in sorted({"*".join(rng.sample(words, rng.choice((1, 2, 2, 3)))) for _ in range(2000)})]
    urls = [f"http://{rng.choice(('', 'www.', rng.choice(words) + '.'))}{rng.choice(words)}.{rng.choice(('com', 'net'))}/{'/'.join(rng.sample(words, rng.randrange(6)))}" for _ in range(250)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = url_filter.table_of(spark, paths, patterns)
    expected = [brute(u, paths, patterns) for u in urls]
    assert len({e[2] for e in expected}) > 20 and {e[3] for e in expected} == {"allow", "block"}
    for slice_chars in (1 << 20, 6000):
        found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules, slice_chars=slice_chars).collect()}
        assert [found[k] for k in range(len(urls))] == expected


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = url_filter.located(spark.createDataFrame([(k, f"http://common.org/{'rare' if k < 2 else 'x'}") for k in range(9)], "page_id long, url string"))
    rules = url_filter.table_of(spark, [], [("common*rare", "block"), ("common", "block"), ("*", "allow")])
    assert {(r.rule, r.token) for r in url_filter.filed(urls, rules).collect()} == {("common*rare", "rare"), ("common", "common"), ("*", None)}


PAGE = """<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><style>p{}</style></head><body><script>x("</p>")</script><!-- no -->
<p>One <b>two</b>&nbsp;3 &lt; 4<br>next</p><ul><li><a href="/rel?a=1&amp;b=2">l</a></li><li><a href='http://[bad'>m</a></ul><div>é</div></body></html>"""


def test_plain_text_and_links():
    assert warc.plain_text(PAGE) == "One two 3 < 4\nnext\nl\nm\né"
    metadata, conversion = (next(warc.read_records(r)) for r in warc.derivatives(warc.response_record(1, "http://h.example/d/", PAGE)))
    assert b"title: A & B\r\n" in metadata[1] and b"language: fr\r\n" in metadata[1]
    assert b"outlink: http://h.example/rel?a=1&b=2\r\n" in metadata[1] and b"http-content-type: text/html; charset=utf-8" in metadata[1]
    assert conversion[1].decode() == warc.plain_text(PAGE)


def test_text_of_pages_that_leave_out_closing_tags():
    head = '<html><head lang="x"><title>x < y</title>\n<meta a="b"><!-- c --><style>p{}</style><script>s("<p></head>")</script><noscript><link></noscript>'
    for end in ("</head><body>", "<body>", "</HEAD >", "", "<noscript>", "</head><template>"):
        assert warc.plain_text(f"{head}{end}<p>All the text<div>more</head></div>") == "All the text\nmore", end
    assert warc.plain_text("<html><head><title>x</title><body><p>All the text...") == "All the text..."
    assert warc.plain_text("<head><title>x</title>text at once") == "text at once"
    assert warc.plain_text("<head><title>x</head><body>a<svg><title>b</title></svg>") == "a\nb"
    assert warc.plain_text("<head><noscript></head><body>a <noscript>no</noscript> b") == "a b"
    assert warc.plain_text("a<noscript>b</noscript>c<noscript>d<template>e<p>f") == "a c d e\nf"
    assert warc.plain_text("<header>a</header>b<!-- c") == "a\nb" and warc.plain_text("a<script>b") == "a" and warc.plain_text("a<style>b") == "a"
    assert warc.plain_text("<noscript>" * 50_000 + "a" + "<head><title>" * 20_000 + "<p>b") == "a\nb"


@pytest.mark.parametrize("part", ["<a ", "<title>", "<noscript>", "<!--", "<", "<a href='", "<head><title>", "<script>", "</title>", "<template><a>", "<html lang=", "<p <", "&lt;<x"])
def test_long_pages_take_time_that_grows_with_them(part):
    began = time.perf_counter()
    warc.derivatives(warc.response_record(1, "http://h.example/", part * (1_000_000 // len(part))))
    assert time.perf_counter() - began < 20


def test_derivatives_keep_identifiers_and_digests():
    source = warc.response_record(1, "http://h.example/", PAGE)
    fields, block = next(warc.read_records(source))
    payload = "sha1:" + base64.b32encode(hashlib.sha1(PAGE.encode()).digest()).decode()
    assert warc.field(fields, "WARC-Payload-Digest") == payload
    ids = set()
    for kind, record in zip(("metadata", "conversion"), warc.derivatives(source), strict=True):
        own, content = next(warc.read_records(record))
        assert warc.field(own, "WARC-Type") == kind and warc.field(own, "WARC-Refers-To") == warc.field(fields, "WARC-Record-ID")
        assert warc.field(own, "WARC-Refers-To-Target-URI") == "http://h.example/" and warc.field(own, "Source-WARC-Payload-Digest") == payload
        assert warc.field(own, "WARC-Block-Digest") == warc.digest(content) and int(warc.field(own, "Content-Length")) == len(content)
        ids.add(warc.field(own, "WARC-Record-ID"))
    assert len(ids) == 2 and warc.derivatives(source) == warc.derivatives(source) and warc.derivatives(warc.derivatives(source)[0]) == []


def test_files_of_other_writers(spark, tmp_path):
    one = warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("warc-date", "2021-05-05T00:00:00Z")], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>\xe9")
    (tmp_path / "a.warc").write_bytes(one * 2)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) * 3)
    assert warc.read_warc(spark, str(tmp_path)).count() == 5
    assert next(warc.read_records(warc.derivatives(one)[1]))[1].decode() == "é"
    with pytest.raises(ValueError):
        list(warc.read_records(b"GET / HTTP/1.1\r\n\r\n"))
    big = b"".join(gzip.compress(bytes([k % 251]) * (k * 7)) for k in range(400))
    assert b"".join(warc.unzipped(big)) == gzip.decompress(big)


def test_pages_through_files(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", PAGE, "z"), (2, None, None, "z"), (2, None, None, "z"), (3, "", "", "z"), (None, "http://b.example/", "<p>x" * 3000, "z")], "page_id long, url string, html string, record string")
    out = warc.derivative_records(pages)
    rows = out.collect()
    assert len(rows) == 10 and out.where("refers_to IS NULL OR block_digest IS NULL").count() == 0
    text = {r.page_id: bytes(r.content).decode() for r in rows if r.type == "conversion"}
    assert text[1] == warc.plain_text(PAGE) and text[2] == text[3] == "" and text[None].count("x") == 3000
    assert warc.derivative_records(pages.limit(0)).count() == 0
    assert {r.target_uri for r in rows if r.page_id in (2, 3)} == {None}
    assert out.select(F.element_at("fields", "WARC-Refers-To-Date")).distinct().count() == 1


class _Plain(html.parser.HTMLParser):
    """What a page shows, by the standard library's parser: hidden elements dropped, blocks on lines of their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head", "noscript", "template"):
            self.hidden.append(tag)
            self.out.append("" if tag in ("head",) else " ")
        elif tag in warc._BREAKS:
            self.out.append("\n")

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if self.hidden and tag in self.hidden:
            del self.hidden[self.hidden.index(tag) :]
        elif tag in warc._BREAKS:
            self.out.append("\n")

    def handle_comment(self, data):
        self.out.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def _shown(page):
    parser = _Plain()
    parser.feed(page)
    parser.close()
    return "\n".join(line for raw in "".join(parser.out).split("\n") if (line := " ".join(raw.split())))


def test_plain_text_is_that_of_another_parser(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").where("html IS NOT NULL").collect()]
    pages += [PAGE, "a<br/>b<!-- c -->d", "<div>x<span>y</span> z</div>tail &amp; &#233; &eacute;", "<table><tr><td>1</td><td>2</td></tr></table>", "<p>1 < 2 and 3 > 2</p>", "<body><noscript>no</noscript>yes<template><p>t</p></template></body>", "plain text\nof two lines", ""]
    assert len(pages) > 100
    for page in pages:
        assert warc.plain_text(page) == _shown(page), page[:300]
