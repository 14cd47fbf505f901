"""WARC round trips and main text."""

import base64
import hashlib
import time

import pytest

from papyra.llm.html import Page, host_of, main_text
from papyra.llm.scratch import Scratch
from papyra.llm.warc import GAP, _index_file, archive_round_trip, coalesce_ranges, index_archives, read_records, write_archives

PAGES = [
    (1, "http://a.example/x", "<p>é</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (2, None, "<p>é</p>"), (3, "http://a.example/\r\ny", "<p>é</p>"), (4, "u", None), (5, "u", ""),
    (6, "u", "x" * 3_000_000), (7, "u", "x" * 3_000_000), (None, "u", "<p>é</p>"), (8, "u", "same"), (8, "u", "same"), (9, "u", "same"), (None, None, "alone"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
def test_round_trip(spark, broadcast_bytes):
    df = spark.createDataFrame([(*p, "y") for p in PAGES], "page_id long, url string, html string, payload string")
    got = archive_round_trip(df, broadcast_bytes=broadcast_bytes).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        r = first.get(h or "")
        kind = "response" if r is None or i == r else "revisit"
        want.append((i, len((h or "").encode()), digest(h), kind, r if kind == "revisit" else None))
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha1(bytes(r["payload"])).digest() == base64.b32decode(r["payload_digest"])
    assert {r["url"] for r in got} == {"http://a.example/x", None, "http://a.example/%20%20y", "u"}


def test_selected_records_and_coalesced_ranges(spark):
    df = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k}</p>" * (k + 1)) for k in range(200)], "page_id long, url string, html string")
    scratch = Scratch(spark, "t")
    path = scratch.path("archives")
    write_archives(df.coalesce(1), path, scratch)
    index = index_archives(spark, path).cache()
    assert index.count() == 200
    few = index.where("url IN ('http://h/3', 'http://h/150')")
    assert sorted(r["page_id"] for r in read_records(few).collect()) == [3, 150]
    runs = coalesce_ranges(index).collect()
    assert sum(len(r["ranges"]) for r in runs) == 200 and len(runs) < 200 and all(r["start"] == r["ranges"][0]["offset"] for r in runs)
    assert GAP > 0


def test_cut_off_archive(tmp_path):
    file = tmp_path / "a.warc"
    file.write_bytes(b"WARC/1.1\r\nContent-Length: 100\r\n\r\nshort\r\n\r\n")
    with pytest.raises(ValueError, match="cut off"):
        list(_index_file(f"file:{file}"))


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert archive_round_trip(df).count() == 0
    assert main_text(df).count() == 0


ARTICLE = "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>menu</ul></nav><main><article><header><h1>A &amp; B</h1><p>by me</p></header>"
ARTICLE += '<p>One<br>two&nbsp;x<p>Three <b>bold<p>Four</b> x<script>var a="</p>"</script><div class="share-bar">share</div><ul><li>a<li>b</ul><table><tr><td>1<td>2</table><form><p>mail</form>'
ARTICLE += '<section id="comments"><article class="comment"><p>c1</p></article></section><div style="display: none">no</div><!-- <p>gone</p> --><pre> a\n b</pre></article></main><aside>s</aside><div class="cookie-notice">ok?</div><footer>f</footer>'


def test_pages():
    assert Page(ARTICLE).text(set()) == "A & B\nOne two x\nThree bold\nFour x\na\nb\n1 2\na b"
    assert Page("<p>x</p><div class=ad>q</div>y <p").text(set()) == "x\ny"
    assert Page("").text(set()) == "" and Page("plain <3 text &amp; more").text(set()) == "plain <3 text & more"
    assert Page("<nav>only</nav>").text(set()) == ""
    assert host_of("HTTP://User@Www.Example.COM:80/x?y") == "www.example.com" and host_of(None) == "" and host_of("nonsense") == ""


def test_site_templates(spark):
    body = "<div><p>Subscribe here</p></div><p>story {0}</p><div><p>All rights kept</p></div>"
    rows = [(k, f"http://h.example/{k}", "<body>" + body.format(k)) for k in range(8)] + [(20, "http://other.example/1", "<body>" + body.format(20))]
    rows += [(30 + k, f"https://art.example/{k}", f"<article><p>same line</p><div><p>p {k}</p></div></article>") for k in range(8)]
    rows += [(50, None, None), (51, "", ""), (52, "x", "<p>é</p>")]
    got = {r["page_id"]: r for r in main_text(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")).collect()}
    assert got[3]["text"] == "story 3" and got[20]["text"] == "Subscribe here\nstory 20\nAll rights kept"
    assert got[33]["text"] == "same line\np 3"  # an article's paragraphs stay, however often they recur
    assert (got[50]["text"], got[51]["text"], got[52]["n_chars"]) == ("", "", 1) and len(got) == len(rows)


@pytest.mark.parametrize(
    "html, text",
    [
        ('<div class="content has-sidebar"><p>Story text</p></div>', "Story text"),
        ('<article class="post with-comments"><p>Story</p></article>', "Story"),
        ('<div class="social-science"><p>Story</p></div>', "Story"),
        ('<div class="cookie-banner">We use cookies</div><p>Story</p><div id="site-footer">end</div><section class="commentList">me too</section>', "Story"),
        ("<article><p>Teaser</p></article><div id='content'><p>" + "A long story. " * 20 + "</p></div>", "Teaser\n" + ("A long story. " * 20).strip()),
        ("<p>Press the <label>red</label> button</p>", "Press the red button"),
        ("<article><header><span>by me</span><h1>Title</h1></header><p>Body</p></article>", "Title\nBody"),
        ("<div><i>a<article><b>b</i>c</b></article></div>", "bc"),
        ("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>", "one\ntwo\nx y"),
        *[(f'<p>Story</p><div class="{c}"><p>{"not the story " * 12}</p></div>', "Story") for c in ("comment-body", "js-comments", "ad-300x250", "site-footer-v2", "related-articles", "cookie-law-info")],
        *[(f'<div class="{c}"><h1>Title</h1><p>{"The story. " * 10}</p><p>{"More of it. " * 10}</p></div><nav>menu</nav>', "Title\n" + ("The story. " * 10).strip() + "\n" + ("More of it. " * 10).strip()) for c in ("alert", "share")],
        ("<article><p>" + "The story. " * 10 + "</p><div class='share'><p>" + "Tell all of your friends about it. " * 4 + "</p></div></article>", ("The story. " * 10).strip()),
        ("<p>Short</p><div class='comments'><p>" + "A long comment. " * 30 + "</p></div>", "Short"),
    ],
)
def test_roles_of_elements(html, text):
    assert Page(html).text(set()) == text


@pytest.mark.parametrize("html", ["<b>" * 150_000 + "</i>" * 150_000, "<article><header>" + "<span>x" * 150_000, "<i><article>" + "<b>" * 100_000 + "</i>" * 200_000, "<p>" * 300_000, "<a \"'>" * 150_000, "<div class='a b'>" * 60_000])
def test_long_odd_pages_take_linear_time(html):
    begin = time.process_time()
    Page(html).candidates()
    assert time.process_time() - begin < 8


def test_copies_do_not_make_a_template(spark):
    story = "<body><div class='menu'>Home</div><div><p>{}</p></div><div>Shared legal line of this host</div></body>"
    rows = [(k, "http://h/x", story.format("The very same story")) for k in range(6)] + [(10 + k, "http://h/x", story.format(f"Other story {k}")) for k in range(8)]
    rows += [(30, None, None), (31, "http://h/y", ""), (30, "http://h/x", story.format("Other story 0"))]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in main_text(df).collect())
    want = [(i, "The very same story", 19) for i in range(6)] + [(10 + k, f"Other story {k}", 13) for k in range(8)] + [(30, "", 0), (31, "", 0), (30, "Other story 0", 13)]
    assert got == sorted(want)
    assert main_text(df.limit(0)).collect() == []
