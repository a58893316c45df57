"""Pages whose main text is known."""

import pytest

from seqspark.llm.html_text import extract_text, main_text

LONG = "A sentence that is long enough to be the text of an article, with a few more words in it."
PAGES = [
    (None, ""), ("", ""), ("   ", ""), ("plain text", "plain text"),
    (f"<html><head><title>t</title><style>p{{}}</style><script>var t='<p>x</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class=\"ad\">Buy this now, it is a very good thing to buy.</div><article><h1>Head &amp; line</h1><p><b>{LONG}<br><p>Short.</p><p>a  b\n c &eacute;&#x41;</article><footer>&copy; site with a long legal line that nobody ever reads at all</footer>", f"Head & line\n\n{LONG}\n\nShort.\n\na b c éA"),
    (f"<body><div><a href=x>one</a> <a href=y>two</a></div><div><p>{LONG}</p><p>Be.</p><p>{LONG}</p></div><div id='comments'><p>{LONG} I say!</p></div></body>", f"{LONG}\n\nBe.\n\n{LONG}"),
    (f"<article><header><h1>T</h1></header><p>{LONG}</p><aside>{LONG}</aside><form><p>{LONG}</p></form><section class='comments'><article>{LONG}</article></section></article>", f"T\n\n{LONG}"),
    (f"<div class='ad'>open <article><p>{LONG}</p></article>", LONG),
    ("<article>x</article><footer>" + LONG, "x"),
    ("<!-- open comment <p>text", ""), (f"<p title='a>b'>{LONG}</p>", LONG), ("<p>a < b and c</p>", "a < b and c"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert main_text(page) == text


JSON = '{"a": "<div class=ad><p>not text</p>", "b": [' + "1, " * 2000 + "]}"
TAGS = [
    (f"<article data-x='{JSON}' class='post'><p>{LONG}</p></article>", LONG),
    (f"<div data-x='{JSON}' class='ad'><p>{LONG} Buy!</p></div><p>{LONG}</p>", LONG),
    (f"<article><p class='a''>{LONG}</p><p>it's</p></article>", f"{LONG}\n\nit's"),
    (f"<article><p class=\"a>{LONG}</p>", LONG),
    (f"<article><svg class='i'/><p>{LONG}</p><svg/><p>{LONG}</p></article>", f"{LONG}\n\n{LONG}"),
    (f"<article><svg-icon name='x'></svg-icon><p>{LONG}</p><title-bar></title-bar><template-x>y</template-x></article>", f"{LONG}\n\ny"),
    (f"<article><svg><title>no</title></svg ><p>{LONG}</p><script>'</scripts>'</script></article>", LONG),
    (f"<article><p><a href=http://x/>link</a> {LONG}</p></article>", f"link {LONG}"),
]


@pytest.mark.parametrize("page,text", TAGS)
def test_tags_are_scanned_whole(page, text):
    assert main_text(page) == text


WHOLE = [
    (f"<article><h1><a href=/x>Title</a></h1><p>{LONG}</p><ul><li><a href=/y>One</a></li><li>Two</li></ul><figcaption><a>Cap</a></figcaption></article>", f"Title\n\n{LONG}\n\nOne\n\nTwo\n\nCap"),
    (f"<div><h1>Title</h1></div><div><p>{LONG}</p></div><ul><li>a<li>b</ul><table><tr><td>x<td>y</table><div>{LONG}</div>", f"Title\n\n{LONG}\n\na\n\nb\n\nx\n\ny\n\n{LONG}"),
    (f"<div><h1><a href=/x>Title</a></h1></div><div><p>{LONG}</p><p><a href=/z>All of it</a></p><p>{LONG}</p></div>", f"Title\n\n{LONG}\n\nAll of it\n\n{LONG}"),
    (f"<div><a href=/x>one</a></div><div><p>{LONG}</p></div><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul>", LONG),
    (f"<div id='page' class='layout has-sidebar'><div class='sidebar'>Not this, never.</div><div><p>{LONG}</p></div></div>", LONG),
    (f"<div class='menu-open'><nav>{LONG} nav</nav><div class='content'><p>{LONG}</p></div></div><div class=ad>Buy.</div>", LONG),
]

FORMS = [
    # a page whose body lies in one form, as some servers write it
    (f"<body><form id=f action=/><input type=hidden value=x><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><select><option>a</select></form><footer>{LONG}</footer>", f"Title\n\n{LONG}\n\n{LONG}"),
    (f"<form><article><p>{LONG}</p><form><p>Subscribe to our letter</p><label>Mail</label><input></form></article></form>", LONG),
    (f"<div><p>{LONG}</p><p>{LONG}</p></div><form><p>{LONG} Sign up!</p><label>Your mail</label><input></form>", f"{LONG}\n\n{LONG}"),
    ("<form><label>Name of the user that wants to log in here, please</label><input><legend>Password</legend><button>Go</button></form>", ""),
]


@pytest.mark.parametrize("page,text", FORMS)
def test_forms_go_unless_they_hold_the_page(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page,text", WHOLE)
def test_short_and_linked_blocks_stay(page, text):
    assert main_text(page) == text


def test_the_scan_is_linear():
    for part in ("<p a=\"", "<p a='", "<a b=<", "<svg ", "<p = ", "<x y=\"'"):
        main_text(part * 20_000)


def test_nothing_is_cut_from_long_articles():
    texts = [f"{LONG} {i}" if i % 3 else f"{i}" for i in range(20_000)]
    page = "<nav>menu</nav><main>" + "".join(f"<p>{x}" for x in texts) + "</main>"
    assert main_text(page) == "\n\n".join(texts)


def test_extract_text(spark):
    rows = [(i, f"u{i}", p, "clash") for i, (p, _) in enumerate(PAGES)] + [(None, None, PAGES[3][0], None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract_text(pages).collect()
    assert {r["page_id"]: r["text"] for r in found if r["page_id"] is not None} == dict(enumerate(t for _, t in PAGES))
    assert all(r["n_chars"] == len(r["text"]) for r in found) and len(found) == len(rows)
    assert extract_text(pages.limit(0)).count() == 0
