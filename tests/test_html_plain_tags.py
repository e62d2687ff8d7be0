import random
from html.parser import HTMLParser

from tabulon.sources import html_tables as ht


class _ByBase(ht._TableParser):
    parse_starttag, parse_endtag = HTMLParser.parse_starttag, HTMLParser.parse_endtag


def _rows(parser, html):
    parser.feed(html)
    return [(i, list(ht._expand(t.rows))) for i, t in parser.finish()]


def test_plain_tags_read_as_by_the_base_class():
    rng = random.Random(5)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<th rowspan=2>", "<td colspan='2'>", "<TD>",
            "</TD >", "<thead>", "</thead>", "<tbody>", "<br>", "<br/>", "<p>", "</p>", "a &amp; b", " x < y ", "<script>",
            "</script>", "<!-- <td> -->", "<title>", "</title>", "<textarea>", "</textarea>", "<a href='>'>", "<td", "é"]
    for _ in range(3000):
        html = "<table>" + "".join(rng.choices(bits, k=rng.randint(1, 25)))
        assert _rows(ht._TableParser(), html) == _rows(_ByBase(), html), html


def test_plain_tags_skip_the_base_class(monkeypatch):
    seen = []
    monkeypatch.setattr(HTMLParser, "check_for_whole_start_tag", lambda self, i, of=HTMLParser.check_for_whole_start_tag: (
        seen.append(i) or of(self, i)))
    assert ht.parse_tables("<table><tr><th>a</th></tr><tr><td>1</td></tr></table>") == [
        (0, 0, True, ["a"]), (0, 1, False, ["1"])]
    assert not seen
    assert ht.parse_tables("<table><tr><td class=x>1") == [(0, 0, False, ["1"])] and seen

