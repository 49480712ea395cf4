"""Citation links: which are rewritten, and which ids a reader is shown, case by case."""

import pytest

from larkspur.operators.citations import cited, normalise

KNOWN = {str(i) for i in range(1, 10)}


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        # Blocks that are no text.
        ("    [1] indented code\n\n[2]", "2"),
        ("words\n    [1] goes on with them\n\n[2]", "12"),
        ("```\n[1]\n```\n[2]", "2"),
        ("~~~ x\n[1]\n```\n~~~\n[2]", "2"),
        ("```\n[1] never closed", ""),
        ("   ```\n[1]\n  ````\n[2]", "2"),
        ("<div>[1]</div>\n[2]\n\n[3]", "3"),
        ("<!-- [1]\n\n[2] -->\n[3]", "3"),
        ("<script>\n[1]\n\n</script>\n[2]", "2"),
        ("<x-y a='[1]'>\n[2]\n\n[3]", "3"),
        ("# [1]\nx\n===\n[2]\n---\n[3]", "123"),
        ("> [1]\n> ```\n> [2]\n> ```\n\n- [3]\n  - [4]\n\n        [5] code\n1. [6]", "1346"),
        # Inside a text.
        ("<b title='[1]'> [2]", "2"),
        ("<http://x/[1]> [2] <a@b.c> [3]", "23"),
        ("a < b [1] > c", "1"),
        ("`[1]` ``x ` [2]`` [3] ` [4]", "34"),
        ("`a\n[1]` [2]", "2"),
        (r"\[1\] \`[2]\` \\[3]", "123"),
        ("![1](x) ![a [2]](y) [3](z)", "3"),
        ("[4](https://e.x), [docs [5]](https://e.x) [**6**](u)", "46"),
        ("[a [1](u) b](v) [2]", "12"),
        ("[1](no end [2]", "12"),
        ("[1](a b) [2](<a b>) [3](u \"t\") [4](u (t))", "1234"),
        ("[0] [01] [x] [1\n] [ 2 ] [3", ""),
        ("[1][2]", "12"),
        ("[1][2]\n\n[2]: http://e.x", "1"),
        ("[1].\n\n[1]: http://e.x", "1"),
        ("[1]: http://e.x", ""),
        ("[1]:\nhttp://e.x\n[2]: <>\n\"t\"\n\n[3]", "3"),
        ("words\n[1]: http://e.x", "1"),
        ("[1]: http://e.x and words", "1"),
        ("[1][Source A] [label][3] [2][]\n\n[source  a]: u\n[3]: u\n[2]: u", "12"),
        ("[x [1]][none] [2]", "12"),
        ("[9] [1] [9]", "91"),
        ("", ""),
    ],
)
def test_cited(text, ids):
    assert "".join(cited(text, KNOWN)) == ids


def test_only_known_ids():
    assert cited("[1] [22] [3]", {"22", "3"}) == ["22", "3"] and cited(None, KNOWN) == []


@pytest.mark.parametrize(
    ("text", "now"),
    [
        ("[1](citation:1) [ x ](citation:2) [3](citation:)", "[1] [x] [3]"),
        ("[1](http://x) ![2](y) [0](z) [3](a\nb)", "[1] ![2](y) [0](z) [3](a\nb)"),
        ("[1][a] [2][] [3][b] ![4][a]\n\n[A]: u\n[2]: u", "[1] [2] [3][b] ![4][a]\n\n[A]: u\n"),
        # Code: whole fences of backticks and pairs in a line; nothing else.
        ("`[1](u)` ```[2](u)\n\n[3](u)``` [4](u)", "`[1](u)` ```[2](u)\n\n[3](u)``` [4]"),
        ("```\n[1](u)", "```\n[1]"),
        ("~~~\n[1](u)\n~~~", "~~~\n[1]\n~~~"),
        ("`a\n[1](u)`", "`a\n[1]`"),
        ("`[1](a` [2](b)", "`[1](a` [2](b)"),
        # Definitions go with the lines behind them that are set in.
        ("[1]:\nfoo", "foo"),
        ("[2]: http://x\n  more\n \nfoo", "foo"),
        ("\t[2]: http://x\nfoo", "foo"),
        (" [2]: http://x\nfoo", " [2]: http://x\nfoo"),
        ("[a]: http://x\n[12]: y\n[0]: z", "[a]: http://x\n[0]: z"),
        ("text [1]: x", "text [1]: x"),
        ("", ""),
    ],
)
def test_normalise(text, now):
    assert normalise(text) == now


def test_long_and_odd_texts_end():
    for text in ("[" * 3000, "[1](" * 1500, "`" * 3000, "<a " * 1500, "> " * 1500, "- " * 800, "\\" * 3001, "[1]: " * 1500, "![" * 1500 + "]" * 1500):
        assert isinstance(cited(text, KNOWN), list) and isinstance(normalise(text), str)
