"""Ends of tags with markup in quoted attributes."""

import random

from tidemark.llm import extraction


def plain_tag_end(page, at):
    """One state after the other, as the standard has them."""
    state = "name"
    for k in range(at, len(page)):
        c = page[k]
        if state in "\"'":
            state = "name" if c == state else state
        elif c == ">":
            return k
        elif state == "before":
            state = c if c in "\"'" else state if c.isspace() else "plain"
        elif state == "plain":
            state = "name" if c.isspace() else state
        elif c == "=":
            state = "before"
    return page.find(">", at)


def test_tags_end_outside_quotes():
    for number in (1, 7, 8, 9, 40, 1000):
        for quote, other in ("\"'", "'\""):
            inside = "".join(f"<p class={other}ad{other}>tip {k}</p>" for k in range(number))
            page = f"<div data-tip={quote}{inside}{quote} id=a>Some words to keep</div>"
            assert extraction.extract(page, {}) == "Some words to keep", number
    pick = random.Random(8)
    for _ in range(3000):
        page = "<a" + "".join(pick.choice(["=", "=", '"', "'", ">", " ", "x", "<b"]) for _ in range(pick.randint(0, 30)))
        stuck = set()
        for _ in range(2):  # what is known to be stuck changes nothing
            assert extraction.tag_end(page, 0, stuck) == plain_tag_end(page, 0), page


def test_unclosed_quotes_take_linear_time():
    page = "<p>first words</p>" + "<a b='>'" * 60_000 + '<i c="'
    assert len(list(extraction.pieces(page))) > 60_000
