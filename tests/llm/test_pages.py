"""WARC archives: round trip, revisits, order. Main text: small pages and the test pages' articles."""

import gzip
import hashlib
import html
import itertools
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import html_text, warc
from quern.llm.common import shared_path

from . import brute
from .conftest import SF

BIG = "<p>" + "same payload " * 20 + "</p>"
PAGES = [
    (5, "http://b.example.com/x?q=1", BIG),
    (3, "http://a.example.com/", BIG),
    (9, None, BIG),
    (7, "http://a.example.com/", None),
    (20, "http://a.example.com/", "ends in a line end\r\n"),
    (21, "http://a.example.com/", "ends in three\r\n\r\n\r\n"),
    (22, "http://a.example.com/", "\r\n"),
    (23, "http://a.example.com/", "\r\n\r\n\r\nbegins with them\n\r\n\r"),
    (8, "not a url\r\nX-Evil: 1", "small"),
    (11, "http://[bad", "small"),
    (12, "http://a.example.com/", "line\r\n\r\nWARC/1.1\r\n\r\n" + "ß\U0001f600" * 90),
    (12, "http://a.example.com/", "line\r\n\r\nWARC/1.1\r\n\r\n" + "ß\U0001f600" * 90),
    (None, "http://c.example.com/", BIG),
    (None, "http://c.example.com/", "no id at all " * 20),
]


def expected(pages):
    first = {}
    for i, _, h in pages:
        data = (h or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    for i, _, h in pages:
        data = (h or "").encode()
        to = first.get(data)
        again = to is not None and to != i
        yield i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", to if again else None


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, record string").repartition(3)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_round_trip(spark):
    path = shared_path(spark, "t")
    got = warc.capture_index(frame(spark), path).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == sorted(expected(PAGES), key=repr)
    by_id = {i: h for i, _, h in PAGES}
    for file in spark.read.format("binaryFile").load(path).collect():
        for _, headers, block in warc.Parser().feed(gzip.decompress(file.content)):
            payload = block.partition(b"\r\n\r\n")[2]
            if headers["warc-type"] == "response" and "x-page-id" in headers:
                assert payload == (by_id[int(headers["x-page-id"])] or "").encode()
            assert "x-evil" not in headers
    assert warc.capture_index(frame(spark, []), shared_path(spark, "t")).count() == 0


def test_query_matches_the_pages(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = warc.op4_loser_tree_warc(spark, SF).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == sorted(expected(pages), key=repr)
    index = warc.capture_index(spark.read.parquet(f"{SF}/pages.parquet"), shared_path(spark, "t"))
    keys = [(r.urlkey.encode(), r.captured, r.page_id) for r in index.collect()]
    assert len(keys) == len(pages) and keys == sorted(keys)


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        lists = [sorted((rng.randrange(50), i) for _ in range(rng.randrange(30))) for i in range(k)]
        assert list(warc.LoserTree(lists, key=lambda x: x)) == sorted(x for part in lists for x in part)


def test_records_come_piece_by_piece():
    """However the bytes are cut, and whatever line ends a payload holds or ends in."""
    blocks = [b"", b"\r\n", b"x\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\n", b"a" * 1000]
    data = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\nN: v:w\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)
    rng = random.Random(3)
    for _ in range(50):
        parser, got, at = warc.Parser(), [], 0
        while at < len(data):
            n = rng.randrange(1, 200)
            got += parser.feed(data[at : at + n])
            at += n
        assert [b for _, _, b in got] == blocks and all(h["n"] == "v:w" for _, h, _ in got)
        assert all(data[s:].startswith(b"WARC/1.1") for s, _, _ in got)


def test_merge_of_many_ranges_and_large_pages(spark, monkeypatch):
    """Ranges by count, also of captures that tie in URL, time and id; pages of a MB."""
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 30)
    pages = [(i % 90, "http://hot.example.com/" if i % 3 else f"http://h{i}.example.com/", f"page {i} " * 30) for i in range(300)]
    pages += [(None, "http://hot.example.com/", f"no id {i}") for i in range(100)] + [(1000, "http://big.example.com/", "<p>line</p>\r\n\r\n" * 70_000)]
    index = warc.capture_index(frame(spark, pages), shared_path(spark, "t"))
    got = index.withColumn("range", F.spark_partition_id()).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == sorted(expected(pages), key=repr)
    keys = [(r.urlkey.encode(), r.captured, r.page_id is not None, r.page_id or 0) for r in got]
    assert keys == sorted(keys)
    held = Counter(r.range for r in got)
    assert len(held) > 5 and max(held.values()) < 120
    assert len({r.archive for r in got}) > 10


def test_url_key():
    assert warc.url_key("http://www.Example.com/A?b=C") == "com,example)/a?b=c"
    assert warc.url_key("http://x.org") == "org,x)/" and warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


def test_main_text():
    page = (
        '<html><head><title>x</title></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><main><h1>Title &amp; more</h1>'
        '<p>First para, long enough to be <b>te</b>xt. Really it is.<p>Second<br>line.</p><div class="comments"><p>A comment here, with words.</p></div>'
        "<form><label>Name</label></form><script>var x='</p>text, more text.'</script></main><aside>Side</aside><div id=cookie-notice>We use cookies.</div><footer>(c)</footer></body></html>"
    )
    assert html_text.content(page) == ["Title & more", "First para, long enough to be text. Really it is.", "Second line."]
    assert html_text.content("plain < text &amp; more") == ["plain < text & more"]
    assert html_text.content(None) == html_text.content("") == html_text.content("<p> \n </p>") == []
    unclosed = '<div><p>Text, and text.</p><a href="never closed>' + "x " * 5000
    assert html_text.content(unclosed)[0] == "Text, and text."
    wrapped = "<div class=wrap><div class=post><h2>Head</h2><p>One is long, and has commas, dots. Yes.</p></div><div class=rel><a href=1>Read more</a><a href=2>Other</a></div></div>"
    assert html_text.content(wrapped) == ["Head", "One is long, and has commas, dots. Yes."]


def test_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in html_text.op5_tag_paths(spark, SF).collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>|$)", pages[r.page_id], re.S)
        text = re.sub(r"<(p|br|h1|/p|/h1)>", " ", article[1]).replace("<b>", "").replace("</b>", "")
        assert r.text == " ".join(html.unescape(text).split()) and r.n_chars == len(r.text)
    assert html_text.extract(frame(spark, [])).count() == 0
    assert html_text.extract(frame(spark)).count() == len(PAGES)


def test_parts_that_are_no_article():
    text = "Words of the article, more than a few; they end here."
    page = f"""<body><div class="site-header">Site name</div><div class="topbar menu"><ul><li>Home</li></ul></div><div class=content>
    <article class="post"><div class="entry-header"><h1>Title</h1></div><p>{text}</p><ul><li>one</li><li>two</li></ul><table><tr><td>1</td><td>b</td></tr></table>
    <div class="ad-slot">Buy now, it is cheap. Really, it is.</div><form><p>Your name, please.</p></form><section id="comments"><article class="comment"><p>I disagree, strongly. No!</p></article></section></article>
    <div class="right-rail">Most read, this week.</div><p>Loose.</p></div><div role="alert">Notice: we moved.</div></body>"""
    assert html_text.content(page) == ["Title", text, "one", "two", "1", "b"]


def test_names_of_the_layout_bar_nothing():
    text = "Words of the article, more than a few; they end here."
    for name in ("container has-sidebar", "layout with-sidebar", "overflow-hidden", "no-comments", "page-with-header", "sidebar-layout", "header-fixed"):
        for tag in ("article", "main", "div class=post"):
            page = f"<body><nav>Home</nav><div class='{name}'><div class=inner><{tag}><p>{text}</p></{tag.split()[0]}></div><div class=sidebar>Most read.</div></div><div class=comments><article><p>I disagree, strongly.</p></article></div></body>"
            assert html_text.content(page) == [text], (name, tag)
    assert html_text.content(f"<div class=related><div class=item><p>{text}</p></div></div><p>Short.</p>")[0] == text
    cards = f"<div class=post><p>{text}</p><p>{text}</p></div><div class=related><article><p>Another story.</p></article></div>"
    assert html_text.content(cards) == [text, text]


def test_ratios_decide_without_names():
    """Neither telling tags nor telling names: running text stays, adverts, notices, remarks, lists of links and closing lines go."""
    para = "This paragraph tells something at length, as the text of an article does; it goes on, with marks. It has a second sentence, too."
    remark = "<div class=q8><p>Nice read.</p></div><div class=q8><p>No, not at all!</p></div>"
    for holder in ("div class=k1", "div", "section id=z9", "td"):
        tag = holder.split()[0]
        page = f"""<html><body><div class=a1><ul><li><a href=/>Home</a></li><li><a href=/b>News and more</a></li></ul></div><div class=b2>Buy it now.</div>
        <{holder}><h1>A title</h1><p>{para}</p><h2>A part</h2><p>Short.</p><p>{para}</p><blockquote>Quoted.</blockquote><ul><li>item</li></ul><table><tr><th>1</th></tr></table>
        <div class=c3><h3>Remarks</h3>{remark}</div><p>{para}</p></{tag}><div class=d4><p>We use small files. <a href=/p>Fine</a></p></div><div class=e5>All of it ours, 2024.</div></body></html>"""
        page = page.replace("<td>", "<table><tr><td>").replace("</td>", "</td></tr></table>") if tag == "td" else page
        assert html_text.content(page) == ["A title", para, "A part", "Short.", para, "Quoted.", "item", "1", para], holder


def _renamed(page):
    """The tables' pages with every telling tag and class name replaced by one that tells nothing."""
    for tag, name in (("nav", "x1"), ("article", "x2"), ("footer", "x4")):
        page = re.sub(rf"<{tag}\b", f'<div class="{name}"', page).replace(f"</{tag}>", "</div>")
    return page.replace('class="ad"', 'class="x3"')


def test_ratios_on_renamed_pages(spark):
    """On the tables' pages without telling tags and names, most characters kept are the article's, and most of it is kept."""
    kept = right = all_ = everything = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = html_text.content(r.html)
        blocks = html_text.content(_renamed(r.html))
        size = lambda texts: sum(map(len, texts))
        kept, all_ = kept + size(blocks), all_ + size(article)
        right += size((Counter(article) & Counter(blocks)).elements())
        plain = [" ".join(html.unescape("".join(n.pieces)).split()) for n in html_text.nodes(_renamed(r.html)) if not n.barred]
        everything += size(plain)
    print("precision", right / kept, "recall", right / all_, "precision of keeping all", all_ / everything)
    assert right >= 0.98 * kept and right >= 0.98 * all_


def test_linked_headings_and_items_of_an_article():
    text = "Words of the article, more than a few; they end here."
    page = f"""<body><div class=menu><a href=/>Home</a></div><article><header><h1 class='entry-title'><a href=/t>Title</a></h1></header><p>{text}</p><h2><a href=#s>Part</a></h2><p>{text}</p>
    <ol><li><a href=/r1>First reference, 2001.</a></li><li><a href=/r2>Second</a></li></ol></article><ul><li><a href=/n>Next page</a></li></ul></body>"""
    assert html_text.content(page) == ["Title", text, "Part", text, "First reference, 2001.", "Second"]


def test_ratios_against_a_plain_version():
    """Random small trees: what the passes over path numbers keep is what sums over all blocks keep."""
    rng = random.Random(12)
    words = ["Word", "a longer word", "text, with marks;", "and so on.", "more of it, then."]

    def grown(depth, path, blocks, links):
        for _ in range(rng.randrange(1, 4)):
            tag = rng.choice(["div", "div", "section", "p", "h2", "ul", "article"]) if depth < 5 else "p"
            number = next(numbers)
            inner = [*path, (number, tag)]
            if tag in ("p", "h2") or rng.random() < 0.2:
                text = " ".join(rng.choices(words, k=rng.randrange(1, rng.choice((3, 12)))))
                linked = rng.random() < 0.15
                blocks.append((tuple(inner), text, len(text) if linked else 0, any(t in ("article", "main") for _, t in inner), any(t in html_text._LINKABLE for _, t in inner), False))
                links.append(f"<{tag}>" + (f"<a href=x>{text}</a>" if linked else text) + f"</{tag}>")
            elif tag == "ul":
                links.append("<ul>")
                for _ in range(rng.randrange(1, 4)):
                    item, text = next(numbers), rng.choice(words)
                    own = (*inner, (item, "li"))
                    blocks.append((own, text, 0, any(t in ("article", "main") for _, t in own), True, False))
                    links.append(f"<li>{text}</li>")
                links.append("</ul>")
            else:
                links.append(f"<{tag}>")
                grown(depth + 1, inner, blocks, links)
                links.append(f"</{tag}>")

    some = 0
    for _ in range(400):
        numbers, blocks, page = itertools.count(), [], []
        grown(0, [], blocks, page)
        want = [blocks[i][1] for i in brute.kept_paths(blocks)]
        assert html_text.content("".join(page)) == want, "".join(page)
        some += 0 < len(want) < len(blocks)
    assert some > 50


PARA = "This paragraph tells something at length, as the text of an article does; it goes on, with marks. It has a second sentence, too."


@pytest.mark.parametrize("tag", ["article", "main", "div class=post", "div"])
def test_sections_and_short_blocks_of_an_article_stay(tag):
    """Ids made from headings name nothing; captions, formulas, boxes and dialogue are the article's."""
    ids = ["related-work", "discussion", "search-algorithms", "social-impact", "legal-history", "comment-on-method", "introduction"]
    parts, want = [], []
    for i in ids:
        title = i.replace("-", " ").capitalize()
        parts.append(f"<section id='{i}'><h2>{title}</h2><p>{PARA}</p><p>{PARA}</p></section>" if i != "introduction" else f"<h2 id='discussion'>{title}</h2><p>{PARA}</p>")
        want += [title, PARA, PARA] if i != "introduction" else [title, PARA]
    parts.append("<div class=box><p>Short.</p></div><div class=caption>Fig. 1</div><div class=eq>E = mc2</div>")
    want += ["Short.", "Fig. 1", "E = mc2"]
    talk = ["Who is there?", "Me.", "Who?", "You know."]
    parts.append("<div class=talk>" + "".join(f"<p>{t}</p>" for t in talk) + "</div>")
    want += talk
    remarks = "<div id=comments><h2>Comments</h2><div class=q><p>Nice read.</p></div></div><div id=related-posts><p>Other stories, of today.</p></div><section id=sidebar><p>Most read.</p></section>"
    page = f"<body><nav>Home</nav><{tag}><h1>Title</h1>{''.join(parts)}{remarks}</{tag.split()[0]}><footer>ours</footer></body>"
    assert html_text.content(page) == ["Title", *want]


def test_deep_and_large_pages():
    """Time in proportion to the page: nested elements by the thousand, with and without names, and pages of several MB."""
    for open_, close in (("<div>", "</div>"), ("<div class=ad>", "</div>"), ("<section><p>Line, of text.", "</section>")):
        n = 40_000
        began = time.process_time()
        html_text.content(f"<body>{open_ * n}<p>{PARA}</p>{close * n}</body>")
        assert time.process_time() - began < 30
    page = "<body><article>" + f"<p>{PARA}</p><ul><li>an item</li></ul>" * 30_000 + "</article></body>"
    began = time.process_time()
    assert len(html_text.content(page)) == 60_000 and time.process_time() - began < 30
