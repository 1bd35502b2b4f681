"""Golden pages: visibility, lists, tables, preformatted text."""

import pytest

from leafmark.llm.html_text import text_of

PAGES = {
    "visible inside hidden": ('<div style="visibility:hidden">no<p style="visibility: visible">yes</p>no</div>after', "yes\n\nafter"),
    "nothing inside not displayed": ('<div style="color:red;display:none">no<p style="visibility:visible">no</p></div>after', "after"),
    "hidden cell keeps its column": ('<table><tr><td>a</td><td style="visibility:hidden">b</td><td>c</td></tr><tr><td>dd</td><td>ee</td><td>f</td></tr></table>', "a       c\ndd  ee  f"),
    "rows spanned": ("<table><tr><td rowspan=2>both</td><td>1</td></tr><tr><td>2</td></tr><tr><td>last</td><td>3</td></tr></table>", "both  1\n      2\nlast  3"),
    "columns and rows spanned": ("<table><tr><td colspan=2 rowspan=2>x</td><td>1</td></tr><tr><td>2</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>", "x     1\n      2\na  b  c"),
    "rowspan ends with its group": ("<table><thead><tr><th rowspan=0>h</th><th>i</th></tr></thead><tbody><tr><td>a</td><td>b</td></tr></tbody></table>", "h  i\na  b"),
    "list values": ("<ol start=3><li>c<li value=7>g<li>h</ol>", "3. c\n4. g\n5. h".replace("4. g", "7. g").replace("5. h", "8. h")),
    "list backwards": ("<ol reversed><li>x<li>y<li>z</ol>", "3. x\n2. y\n1. z"),
    "list letters": ("<ol type=a start=26><li>x<li>y</ol><ol type=I start=4><li>v</ol>", "z. x\naa. y\n\nIV. v"),
    "wide characters": ("<table><tr><td>日本</td><td>a</td></tr><tr><td>x</td><td>b</td></tr></table>", "日本  a\nx     b"),
    "combining characters": ("<table><tr><td>e\u0301e\u0301</td><td>a</td></tr><tr><td>xyz</td><td>b</td></tr></table>", "e\u0301e\u0301   a\nxyz  b"),
    "pre in a cell": ("<table><tr><td><pre>1\n2</pre></td><td><pre>if x:\n    y</pre></td></tr><tr><td>end</td></tr></table>", "1    if x:\n2        y\nend"),
    "text areas and selects": ("<textarea>a &lt; b\n c</textarea><select><option>one<option selected>two</select><select><option>three<option>four</select>", "a < b\n c\ntwo\nthree"),
    "nested tables": ("<table><tr><td>a<table><tr><td>b</td><td>c</td></tr></table></td><td>d</td></tr></table>", "a b c  d"),
    "spacing": ("<h1>T</h1><p>one\n two</p><p>three<br>four</p><ul><li>x<ul><li>y</ul><li>z</ul>", "T\n\none two\n\nthree\nfour\n\n- x\n  - y\n- z"),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_golden(name):
    page, want = PAGES[name]
    assert text_of(page) == want


def test_deep_tables():
    assert text_of("<table><tr><td>" * 60 + "deep" + "</td></tr></table>" * 60) == "deep"
    assert "deep" in text_of("<table><tr><td>" * 3000 + "deep")
