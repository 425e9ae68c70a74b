"""Licence scan, derived archive records, placement and token rollups."""

import hashlib
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import check
import duckdb
import numpy as np
import pytest
from conftest import SF
from llm_helpers import awkward, empty
from pyspark.sql import functions as F

from caseledger.llm.licenses import KNOWN, all_known, known_licenses, license_scan
from caseledger.llm.placement import lookup_table, placed
from caseledger.llm.queries import ORACLES, QUERIES
from caseledger.llm.shared import new_path, prepare
from caseledger.llm.token_rollups import Rollup, counted, revised, signed
from caseledger.llm.tokens import token_ids
from caseledger.llm.warc import derived, plain_text, responses


@pytest.mark.parametrize("name", ["op2_license_scan", "op3_warc_derivatives"])
def test_query_equals_sql(spark, name):
    problem, n = check.compare(QUERIES[name](spark, SF), check.duck(SF), ORACLES[name])
    assert problem is None and n > 0


def test_licenses_in_other_dress(spark):
    isc = dict(KNOWN)["ISC"]
    texts = [
        "Copyright (c) 2020 Jane Roe\nAll rights reserved.\n\n" + isc.upper().replace(",", " ,\n"),
        isc.replace("and/or", "and / or") + " And more.", "Some prose.\n* Released under the M.I.T. Licence!\n",
        "Some prose.\n* released under the mit LICENCE\n(c) 1999 X\nLicensed under CC BY NC 4 0", "© 2001", None, "",
    ]
    df = prepare(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["license_id"], r["line_licenses"]) for r in license_scan(df, known_licenses(spark)).collect()}
    assert got == {
        0: ("ISC", None), 1: (None, None), 2: (None, None), 3: (None, "CC-BY-NC-4.0,MIT"), 4: (None, None),
        5: (None, None), 6: (None, None),
    }


_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""


def test_whole_licenses_and_usual_notices(spark):
    holder = "Copyright (c) 2020 Jane Roe\n\n"
    zero = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
    texts = {
        "MIT License\n\n" + holder + _MIT: ("MIT", None), "The MIT License (MIT)\n\n" + holder + _MIT: ("MIT", None),
        holder + _MIT: ("MIT", None), "/*\n * " + _MIT.replace("\n", "\n * "): ("MIT", None), _MIT[:-40]: (None, None),
        "ISC License\n\n" + holder + _ISC: ("ISC", None), holder + zero: ("0BSD", None), _MIT + _ISC: (None, None),
        "Prose.\n// SPDX-License-Identifier: Apache-2.0": (None, "Apache-2.0"),
        "Prose.\nThis project is licensed under the MIT license": (None, "MIT"),
        "Prose.\nThis work is licensed under a Creative Commons.": (None, None),
        "Prose.\nThis work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.": (None, "CC-BY-SA-4.0"),
    }
    long = [(name, text) for name, text in all_known() if len(text) > 5000]
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= {name for name, _ in long}
    df = prepare(spark).createDataFrame(list(enumerate([*texts, *[t for _, t in long]])), "doc_id long, text string")
    got = {r["doc_id"]: (r["license_id"], r["line_licenses"]) for r in license_scan(df, known_licenses(spark)).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    assert [got[len(texts) + i][0] for i in range(len(long))] == [name for name, _ in long]


def test_license_scan_of_awkward_rows(spark):
    df = awkward(prepare(spark))
    assert license_scan(df, known_licenses(spark)).count() == df.count()
    assert license_scan(empty(spark), known_licenses(spark)).count() == 0
    assert license_scan(df, known_licenses(spark).limit(0)).filter("line_licenses IS NOT NULL").count() == 0


def test_records_are_linked(spark):
    html = (
        "<!DOCTYPE html><head><title> A  &amp; B </title><style>p{}</style></head><body><script>var x='<p>';</script>"
        "<h1>Head</h1><p>One <b>two</b>&nbsp;three<br>four &lt;tag&gt;</p><!-- no --><a href='/x?a=1'>link</a></body>"
    )
    pages = prepare(spark).createDataFrame(
        [(1, "http://a/", html, "y"), (2, None, None, "y"), (None, "http://b/", "", "y"), (1, "http://a/", html, "y")],
        "page_id long, url string, html string, record_id string",
    )
    rows = derived(responses(pages)).collect()
    assert len(rows) == 8
    source = {(r["page_id"], r["target_uri"]): r for r in responses(pages).collect()}
    for r in rows:
        of = source[(r["page_id"], r["target_uri"])]
        assert r["refers_to"] == of["record_id"] and f"WARC-Refers-To: <{of['record_id']}>\r\n" in r["header"]
        assert f"WARC-Source-Payload-Digest: {of['payload_digest']}\r\n" in r["header"]
        block = r["block"].encode()
        assert f"Content-Length: {len(block)}\r\n" in r["header"] and hashlib.sha256(block).hexdigest() in r["header"]
        assert r["header"].endswith("\r\n\r\n") and ("WARC-Target-URI" in r["header"]) == (r["target_uri"] is not None)
    first = {r["record_type"]: r["block"] for r in rows if r["page_id"] == 1}
    assert first["conversion"] == "Head\nOne two three\nfour <tag>\nlink"
    assert "title: A & B\r\n" in first["metadata"] and first["metadata"].endswith("outlink: /x?a=1\r\n")
    assert {r["block"] for r in rows if r["record_type"] == "conversion" and r["page_id"] != 1} == {""}
    assert len({r["record_id"] for r in rows}) == 6
    assert derived(responses(pages.limit(0))).count() == 0


def test_character_references(spark):
    body = "It&#8217;s caf&#xE9; &eacute;t&eacute; f&uuml;r &amp;lt; &amp;#39; &#39;&apos; &Ntilde;&bdquo;x&ldquo; &copy;&rarr; a&#160;b&#xa0;c &unknown; &#0; AT&T"
    html = f"<p>{body}</p><a href='/x?a=1&amp;b=&eacute;&#38;c=2'>l</a>"
    pages = prepare(spark).createDataFrame([(1, "http://a/", html)], "page_id long, url string, html string")
    got = {r["record_type"]: r["block"] for r in derived(responses(pages)).collect()}
    known = body.replace("&unknown; &#0;", "@")
    want = unescape(known).replace("\u00a0", " ").replace("@", "&unknown; &#0;")
    assert got["conversion"] == want + "\nl"
    assert got["metadata"].endswith("outlink: /x?a=1&b=é&c=2\r\n")


class Anchors(HTMLParser):
    """Links and title as the standard library reads them."""

    def __init__(self):
        super().__init__()
        self.links, self.title, self.inside = [], [], False

    def handle_starttag(self, tag, attrs):
        self.inside = tag == "title"
        href = [v for k, v in attrs if k == "href"]
        if tag == "a" and href and href[0] is not None:
            self.links.append(href[0])

    def handle_endtag(self, tag):
        self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.title.append(data)


def test_links_and_titles_equal_a_parser(spark):
    pages = [
        '<a data-href="no" href="yes.html">x</a><a href=plain.html>y</a><!-- <a href="hidden">z</a> -->',
        """<title>It&#8217;s A &amp; B</title><a title="see href=no" class='c' HREF = 'up.html' id=z>x</a><a name=top>y</a>""",
        """<a class="b"href="glued.html">x</a><a disabled href="/a?b=1&amp;c=2&uuml;">y</a><abbr href="no">z</abbr><a/href=slash>s</a>""",
        """<script>var s = '<a href="script.html">';</script><style>a[href="x"] {}</style><A\n  HREF\n=\n"line.html"\n>n</A><a href="">e</a>""",
        """<a title="a > b" href="late.html">x</a><a xhref="no" my-href='no'>y</a><a href='one.html' href="two.html">z</a><link href="no">""",
        "<!-- <title>old</title> --><head><title>\n New \n title </title></head><a href='/x y'>b</a><area href=no><a>n</a>",
        "<a " + " ".join(f'data-k{i}="v{i}"' for i in range(150)) + " href=far.html>x</a>" + "<p " + "x" * 5000 + ">",
    ]
    df = prepare(spark).createDataFrame([(i, "http://a/", p, 1) for i, p in enumerate(pages)], "page_id long, url string, html string, markup int")
    got = {r["page_id"]: r["block"] for r in derived(responses(df)).collect() if r["record_type"] == "metadata"}
    for i, page in enumerate(pages):
        parser = Anchors()
        parser.feed(page)
        lines = got[i].split("\r\n")
        assert [x.removeprefix("outlink: ") for x in lines if x.startswith("outlink: ")] == parser.links, page
        title = " ".join("".join(parser.title).split())
        assert [x.removeprefix("title: ") for x in lines if x.startswith("title: ")] == ([title] if title else []), page
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    plain = [p.replace("&#8217;", "&ndash;").replace("&uuml;", "&copy;") for p in pages]
    con.executemany("INSERT INTO pages VALUES (?, 'http://a/', ?)", [[i, p] for i, p in enumerate(plain)])
    df = spark.createDataFrame([(i, "http://a/", p) for i, p in enumerate(plain)], "page_id long, url string, html string")
    mine = derived(responses(df)).select("page_id", "record_type", F.md5("block").alias("m")).collect()
    theirs = con.execute(f"SELECT page_id, record_type, block_md5 FROM ({ORACLES['op3_warc_derivatives']}) q").fetchall()
    assert sorted(map(tuple, mine)) == sorted(theirs)


def test_long_page(spark):
    html = "<p>" + "word " * 200_000 + "</p>" * 1000
    df = prepare(spark).createDataFrame([(html,)], "html string")
    assert df.select(F.length(plain_text(F.col("html"))).alias("n")).first()["n"] == 5 * 200_000 - 1


def filled(shards, size):
    """The table by plain turns over whole preference lists."""
    lists = []
    for name in shards:
        h = hashlib.sha256(name.encode()).digest()
        start, step = int.from_bytes(h[:8], "big") % size, int.from_bytes(h[8:16], "big") % (size - 1) + 1
        lists.append([(start + k * step) % size for k in range(size)])
    table = [-1] * size
    while -1 in table:
        for k, wanted in enumerate(lists):
            free = next((s for s in wanted if table[s] == -1), None)
            if free is not None:
                table[free] = k
    return table


def test_table():
    shards = [f"s{k}" for k in range(7)]
    table = lookup_table(shards, 503)
    assert table.tolist() == filled(shards, 503)
    counts = Counter(table.tolist())
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = lookup_table(shards[:-1], 503)
    moved = np.mean((table != fewer)[table < 6])
    assert moved < 0.25
    for wrong in (504, 5, 4_000_039):
        with pytest.raises(ValueError):
            lookup_table(shards, wrong)
    with pytest.raises(ValueError):
        lookup_table(["a", "a"], 503)


def test_placement(spark):
    df = awkward(prepare(spark)).withColumnRenamed("v", "slot")
    out = placed(df, "doc_id", ["a", "b", "c"], size=503)
    assert out.columns == [*df.columns, "shard"]
    rows = out.collect()
    assert len(rows) == df.count()
    table = filled(["a", "b", "c"], 503)
    for r in rows:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == "abc"[table[int(hashlib.md5(key.encode()).hexdigest()[:12], 16) % 503]]
    assert placed(out, "doc_id", ["z"], size=503).select("shard").distinct().collect()[0]["shard"] == "z"
    assert placed(empty(spark), "doc_id", ["a"]).count() == 0


def test_placement_query(spark):
    rows = QUERIES["op5_shard_placement"](spark, SF).collect()
    shards = [f"shard-{k:03d}" for k in range(64)]
    table = lookup_table(shards)
    assert len(rows) == 200
    for r in rows:
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:12], 16) % 65537
        assert r["shard"] == shards[table[slot]]


def test_rollup_query(spark):
    got = {tuple(r)[:3]: tuple(r)[3:] for r in QUERIES["op8_token_rollups"](spark, SF).collect()}
    want, seen = {}, set()
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        version = "byte_bpe_multi_50k" if r["lang"] == "de" else "byte_bpe_50k"
        if r["text"] not in seen:
            n, t = want.get(key := (r["source"], r["lang"], version), (0, 0))
            want[key] = (n + 1, t + len(token_ids(r["text"], version)))
        seen.add(r["text"])
    assert got == want


def test_batches_commit_once(spark):
    df = awkward(prepare(spark))
    rollup = Rollup(spark, new_path(spark, "rollup"))
    assert rollup.totals().count() == 0 and rollup.batches() == []
    rows = counted(df, "byte_bpe_50k")
    assert rollup.commit("b1", signed(rows, 1)) and not rollup.commit("b1", signed(rows, 1))
    before = sorted(map(tuple, rollup.totals().collect()), key=repr)
    assert sum(r[3] for r in before) == df.count() and {None, ""} <= {r[0] for r in before}
    other = rows.withColumn("version", F.lit("v2")).withColumn("n_tokens", F.col("n_tokens") + 1)
    rollup.commit("b2", revised(rows, other))
    now = rollup.totals().collect()
    assert {r["version"] for r in now} == {"v2"} and sum(r["n_docs"] for r in now) == df.count()
    rollup.commit("b3", signed(other, -1))
    assert rollup.totals().count() == 0
    # A writer that died left data but no mark: the batch does not count and is written anew.
    rows.limit(0).select("source").write.parquet(rollup._batch("b4"))
    at, fs = rollup._fs(rollup._batch("b4") + "/_SUCCESS")
    fs.delete(at, False)
    assert "b4" not in rollup.batches() and rollup.commit("b4", signed(rows, 1)) and rollup.batches() == ["b1", "b2", "b3", "b4"]
    rollup.commit("nothing", signed(counted(empty(spark), "byte_bpe_50k"), 1))
    assert sorted(map(tuple, rollup.totals().collect()), key=repr) == before
    with pytest.raises(ValueError):
        rollup.commit("a/b", signed(rows, 1))
