"""Layout of small pages, and what is left out."""

import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest
from llm_cases import ordered, table

from fleetlens.llm import html_layout
from fleetlens.llm.html_layout import extract, visible_text
from fleetlens.llm.ship import ship_code

CASES = [
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<p>a<p>b", "a\n\nb"),
    ("<p>a</p>\n<p>b</p>", "a\n\nb"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<b>a</b> <i>b</i>c", "a bc"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
    ("<ul><li><p>a</p><p>b</p></ul>", "- a\n\n  b"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<table><tr><th>Name<th>Qty<tr><td>pear<td>3</table>", "Name  Qty\npear  3"),
    ("<table><tbody><tr><td>a</td><td>b</td></tr><tr><td colspan=2>wide cell</td></tr></tbody></table>", "a  b\nwide cell"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<table><tr><td><table><tr><td>x<td>y</table><td>z</table>", "x  y  z"),
    ("<table><td>a<td>b</table>", "a  b"),
    ("<p>x<table><tr><td>a</table>y", "x\n\na\n\ny"),
    ("<pre> a\n  b </pre>", " a\n  b"),
    ("<blockquote>q<p>r</p></blockquote>s", "  q\n\n  r\n\ns"),
    ("<title>t</title><style>a{}</style><script>x='</p>'</script>v", "v"),
    ("<head><meta charset=x><title>t</title></head><body>v", "v"),
    ("<div hidden>n</div><div style='display : NONE'>n</div>v", "v"),
    ("<span style='visibility:hidden'>n<i style='visibility:visible'>v</i></span>", "v"),
    ("<noscript>n</noscript><template>n</template><iframe>n</iframe><dialog>n</dialog><dialog open>v</dialog>", "v"),
    ("<details><summary>s</summary>n</details><details open><summary>s</summary>v</details>", "s\ns\nv"),
    ("a &amp; b &lt;c&gt; &eacute;&#x41;&nope;", "a & b <c> éA&nope;"),
    ("<!-- n -->v<!--> w<!-- unclosed", "v w"),
    ('<a title="x>y" href=z>v</a>', "v"),
    ("a < b > c <3", "a < b > c <3"),
    ("</div></p>v</td>", "v"),
    ("<p>a<b>b<p>c", "ab\n\nc"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<textarea> <b>x</b>\n y</textarea>", " <b>x</b>\n y"),
    ("v<a href='x", "v"),
    ("<h1>T</h1>x<hr>y", "T\n\nx\n\ny"),
    ("日本<p>é", "日本\n\né"),
    ("<table><tr><td>" + "word " * 20 + "<td>b<td>c<tr><td>x<td>y<td>z</table>", "word " * 11 + "word  b  c\n" + "word " * 7 + "word\nx" + " " * 60 + "y  z"),
    ("<table><tr><td>" + "w" * 70 + "<td>b<td>c<tr><td>x<td>y<td>z</table>", "w" * 70 + "\n" + " " * 62 + "b  c\nx" + " " * 61 + "y  z"),
    ("<table><tr><td>x<td>" + "word " * 20 + "</table>", "x  " + "word " * 20),
    ("<table><tr><td colspan=2>a wide cell<td>c<tr><td>x<td>y<td>z</table>", "a wide cell\n      c\nx  y  z"),
]


@pytest.mark.parametrize("page, want", CASES)
def test_layout(page, want):
    assert visible_text(page) == "\n".join(line.rstrip() for line in want.strip("\n").split("\n"))


def test_long_and_broken_pages_take_time_in_proportion():
    began = time.time()
    for page in ("<div>" * 50_000 + "x", "<" * 100_000, "<a " * 50_000, "<a b='" * 20_000, "<td>" * 30_000, "<li>" * 30_000, "</p>" * 30_000, "<table>" * 20_000, "&amp" * 30_000, "<!--" * 30_000):
        visible_text(page)
    assert visible_text("<p>word</p>" * 100_000).count("word") == 100_000
    assert time.time() - began < 90


def slow_table(rows):
    """Tables on a sheet of single characters, cell by cell. A cell is its columns and its lines."""
    last = max(sum(n for n, _ in row) for row in rows)
    placed = []  # (row, first column, columns, lines)
    for i, row in enumerate(rows):
        c = 0
        for n, lines in row:
            pieces = []
            for line in lines:
                rest = line.split()
                while rest and c + n < last:
                    take = 1
                    while take < len(rest) and len(" ".join(rest[: take + 1])) <= 60:
                        take += 1
                    pieces.append(" ".join(rest[:take]))
                    rest = rest[take:]
                pieces += [" ".join(rest)] if rest else []
            placed.append((i, c, n, pieces))
            c += n
    width = [max([0, *(min(60, len(p)) for _, c, n, ps in placed if (c, n) == (k, 1) for p in ps)]) for k in range(last)]
    # A column in which no cell begins takes no room.
    left = [sum(width[j] + 2 for j in range(k) if any(c == j for _, c, _, _ in placed)) for k in range(last)]
    out = []
    for i in range(len(rows)):
        sheet = {}
        for _, c, _, pieces in (p for p in placed if p[0] == i):
            y = 0
            for piece in pieces:
                while any((y, x) in sheet for x in range(max(left[c] - 2, 0), left[c] + 200)):
                    y += 1
                sheet.update({(y, left[c] + x): ch for x, ch in enumerate(piece)})
                y += 1
        for y in range(max((y for y, _ in sheet), default=-1) + 1):
            out.append("".join(sheet.get((y, x), " ") for x in range(max((x for v, x in sheet if v == y), default=-1) + 1)).rstrip())
    return "\n".join(out).strip("\n")


def test_tables_equal_a_sheet_of_characters():
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([1, 2, 5, 9, 9, 30, 75])))
    for _ in range(400):
        columns = rnd.randint(1, 5)
        rows = []
        for _ in range(rnd.randint(1, 5)):
            row, c = [], 0
            while c < columns:
                n = rnd.choice([1, 1, 1, 1, 2])
                n = min(n, columns - c)
                row.append((n, [" ".join(word() for _ in range(rnd.choice([1, 2, 4, 20]))) for _ in range(rnd.choice([1, 1, 1, 3]))]))
                c += n
            rows.append(row)
        page = "".join("<tr>" + "".join(f"<td colspan={n}>" + "<br>".join(lines) for n, lines in row) for row in rows)
        assert visible_text(f"<table>{page}</table>") == slow_table(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_words_of_the_pages_equal_those_of_a_plain_parser(sf):
    """Each visible word comes as often as html.parser gives it; list markers are left out on both sides."""
    pages = pq.read_table(f"/root/testdata/{sf}/pages.parquet", columns=["html"]).column("html").to_pylist()
    words = lambda t: Counter(w for w in t.split() if not re.fullmatch(r"-|-?\d+\.", w))
    for page in pages:
        seen = Visible()
        seen.feed(page or "")
        seen.close()
        assert words(visible_text(page or "")) == words("".join(seen.parts))


class Visible(HTMLParser):
    """Text outside of elements that are never shown, with a space at the edges of blocks and cells."""

    EDGES = html_layout.BLOCK | {"br", "td", "th", "tr"}

    def __init__(self):
        super().__init__()
        self.parts, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        self.parts.append(" " if tag in self.EDGES else "")
        if tag in html_layout.VOID:
            return
        style = (given.get("style") or "").replace(" ", "").lower()
        if self.hidden or tag in html_layout.UNSEEN or "hidden" in given or "display:none" in style or "visibility:hidden" in style:
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        self.parts.append(" " if tag in self.EDGES else "")
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def test_extract_of_messy_rows(spark):
    ship_code(spark)
    rows = [(i, page, "x") for i, (page, _) in enumerate(CASES)] + [(None, None, None), (5, None, None), (5, None, None), (6, "<p>again", "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = extract(pages)
    assert table(got, "page_id", "text") == ordered([(r[0], visible_text(r[1] or "")) for r in rows])
    assert extract(pages.limit(0)).count() == 0
