"""Pages whose wrappers are named after what they have beside the article, and texts cut into parts."""

import random
import time

import pytest

from graphloom.llm import chat_format, html_extract

BODY = "".join(f"<p>Paragraph {i} says a good deal about one thing, and then about another.</p>" for i in range(8))
LINES = [f"Paragraph {i} says a good deal about one thing, and then about another." for i in range(8)]
PAGES = {
    f'<body><div class="content has-sidebar"><h1>Name</h1>{BODY}</div><div class="sidebar">Elsewhere</div></body>': ["Name", *LINES],
    f'<body><div class="post share-enabled">{BODY}</div><div class="share">Send it</div></body>': LINES,
    f"<body><form action='x'><h1>Name</h1>{BODY}<input name=q></form></body>": ["Name", *LINES],
    f'<body><article><div class="entry-header"><h1>Name</h1></div>{BODY}</article><footer>End</footer></body>': ["Name", *LINES],
    f'<body><div id="comments">{BODY * 3}</div><article><h1>Name</h1>{BODY}</article></body>': ["Name", *LINES],
    f'<body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use them</div><main>{BODY}<form>Your name</form></main></body>': LINES,
    f"<body><article>{BODY}<p>AT&<b>amp;</b>T &amp; all</p></article></body>": [*LINES, "AT&amp;T & all"],
    "<body><aside><p>All there is</p></aside></body>": [],
    f"<body><article><p>Short.</p></article><div class='ad'>{BODY}</div><footer>{BODY}</footer></body>": ["Short."],
    "": [],
    None: [],
}


@pytest.mark.parametrize("source", list(PAGES), ids=range(len(PAGES)))
def test_article_is_found(source):
    assert html_extract.extract(source) == "\n".join(PAGES[source])


def test_main_texts_of_a_table(spark):
    rows = [(2**53 + 1 + i if i else None, f"u{i}", h, "own") for i, h in enumerate(PAGES)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_extract.main_texts(pages).collect()}
    assert got == {(i, u): ("\n".join(PAGES[h]), len("\n".join(PAGES[h]))) for i, u, h, _ in rows}
    assert html_extract.main_texts(pages.limit(0)).count() == 0


def test_texts_cut_anywhere_read_back_as_one_turn():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["<", "|", "\\", "im_end|>", "<|im_end|>", "\n<|im_start|>assistant\nok", "a", "<|image|>"]) for _ in range(rng.randint(0, 9)))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 4)))
        parts = [{"type": "text", "text": text[a:b]} for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        formatted, (first, last), _ = chat_format.format_turn("assistant", parts)
        assert chat_format.read_turns(formatted) == [("assistant", text)]
        assert chat_format.unescape(formatted[first:last]) == text


def test_attachments_keep_their_places(spark):
    part = lambda **p: tuple(p.get(c) for c in ("type", "text", "ref", "width", "height", "seconds", "pages"))
    parts = [part(type="text", text="see <"), part(type="text", text="|x"), part(type="image", ref="i1", width=56, height=29), part(type="document", ref="d", pages=2), part(type="text", text="end")]
    turns = spark.createDataFrame([(2**53 + 1, 1, "user", parts), (None, 1, "user", []), (None, 2, None, None)], f"conv_id bigint, turn bigint, role string, parts {chat_format.PARTS}")
    done = chat_format.format_turns(turns)
    row = done.where("conv_id IS NOT NULL").first()
    assert row.conv_id == 2**53 + 1 and row.formatted == "<|im_start|>user\nsee <\\|x<|image|><|document|>end<|im_end|>\n"
    assert [(a.kind, a.ref, row.formatted[a.offset :].index("<|"), a.tokens) for a in row.attachments] == [("image", "i1", 0, 4), ("document", "d", 0, 1024)]
    digests = {r.conv_id: r.n_turns for r in chat_format.conversation_digests(done.withColumn("text", done.formatted)).collect()}
    assert digests == {2**53 + 1: 1, None: 2}
    assert chat_format.conversation_digests(done.limit(0).withColumn("text", done.formatted)).count() == 0


def test_names_cannot_empty_a_page():
    prose = "<p>" + "A sentence of plain prose that goes on for a while. " * 4 + "</p>"
    for box in ('<div class="related-content">%s</div>', '<div class="comment-post"><h1>Title</h1>%s</div>', '<div class="search-article"><h2>T</h2>%s</div>'):
        assert "plain prose" in html_extract.extract(f"<body>{box % prose}</body>")
    short = '<body><div class="ad">%s</div><article><h1>Title</h1><p>Short.</p></article><div class="comments">%s</div></body>' % (prose, prose * 3)
    assert html_extract.extract(short) == "Title\nShort."


def test_deep_markup_is_linear():
    begun = time.process_time()
    assert html_extract.extract("<blockquote>" * 20_000 + "word") == "word"
    assert time.process_time() - begun < 5


def test_an_article_in_two_boxes_is_whole():
    box = lambda n: "<div>" + "".join("<p>" + f"Paragraph {i} of {n} says a good deal about one thing. " * 25 + "</p>" for i in range(n)) + "</div>"
    lines = html_extract.extract(f"<body>{box(4)}{box(2)}</body>").split("\n")
    assert len(lines) == 6
