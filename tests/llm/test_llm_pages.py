"""Pages whose markup misleads: template lines without an article, copies side by side, teasers, forms, odd attributes."""

import time

from docstruct.llm import pages as P


def read(spark, htmls, host="h.x"):
    rows = [(k, f"http://{host}/a/{k}", h) for k, h in enumerate(htmls)]
    return {r.page_id: r for r in P.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def texts(html):
    return [t for t, kind in P.marked_lines(html) if kind != P.ASIDE_LINE]


def test_attributes_with_odd_quotes():
    assert texts("<p title=don't>Hello world</p><p>It's here</p><p>last</p>") == ["Hello world", "It's here", "last"]
    assert texts("<p a='>' b=\"<p>x\" c>one</p><p =x>two</p><p / hidden/>gone</p>") == ["one", "two"]
    assert texts("<p>one</p><p title='never closed>two</p>") == ["one"]


def test_forms_around_pages_are_no_forms():
    assert texts("<form><nav>Menu</nav><h1>T</h1><p>Story</p></form>") == ["T", "Story"]
    assert texts("<h1>T</h1><form><p>Your mail</p></form><p>Story</p>") == ["T", "Story"]


def test_time_is_linear_in_open_tags():
    for piece, close in (("<a ", ""), ("<b>", "</i>"), ("<p title='", ""), ("<form>", "</p>")):
        start = time.time()
        P.page_lines(piece * 100_000 + close * 100_000)
        assert time.time() - start < 10


def test_long_template_around_a_short_line_goes(spark):
    template = "".join(f"<div>Template line {k} of the shop</div>" for k in range(8))
    got = read(spark, [f"{template}<div>Own {k}</div>" for k in range(4)])
    assert {k: r.text for k, r in got.items()} == {k: f"Own {k}" for k in range(4)}


def test_a_copy_beside_a_page_is_no_template(spark):
    story = "<div>Shop</div><p>A story of some length</p><p>It goes on here</p><p>{0}</p><div>Bye</div>"
    other = "<div>Shop</div><p>Quite another text {0}</p><div>Bye</div>"
    got = read(spark, [other.format(0), other.format(1), story.format("end"), story.format("END"), other.format(4), other.format(5), story.format("end")])
    assert got[2].text == got[6].text == "A story of some length\nIt goes on here\nend"
    assert got[3].text == "A story of some length\nIt goes on here\nEND"
    assert [got[k].text for k in (0, 1, 4, 5)] == [f"Quite another text {k}" for k in (0, 1, 4, 5)]


def test_teasers_do_not_hide_the_story(spark):
    page = "<div>Shop</div><div><p>The story number {0} is a long one</p><p>with {0} lines</p></div><article>Read {0}</article><div>Bye</div>"
    got = read(spark, [page.format(k) for k in range(4)])
    assert {k: r.text for k, r in got.items()} == {k: f"The story number {k} is a long one\nwith {k} lines\nRead {k}" for k in range(4)}
    plain = "<div>Shop</div><div>Note {0}</div><article>The story number {0} is here</article><div>Bye</div>"
    assert {r.text for r in read(spark, [plain.format(k) for k in range(4)]).values()} == {f"The story number {k} is here" for k in range(4)}
