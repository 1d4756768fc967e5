"""Labelled pages: the training data of the HTML extraction.

Each layout is a tree written by hand, in which every element carries its label: ``+``
belongs to the article, ``-`` does not, and children without a sign inherit.  ``pages``
fills the layouts with words of a seeded generator, so the labelled pages are the same
everywhere; their number is a parameter.

A layout line is ``depth sign tag attributes | content``; content is ``text N`` (about N words),
``links N`` (N linked entries) or ``short`` (one or two words).
"""
from __future__ import annotations

import random

LAYOUTS = ["""
0 - body |
1 - header class=site-header |
2 - div class=logo | short
2 - nav |
3 - ul |
4 - li | links 1
4 - li | links 1
4 - li | links 1
1 - div class=cookie-notice | text 14
1 + article |
2 + h1 | text 7
2 + p | text 60
2 - div class=ad | text 12
2 + p | text 8
2 + h2 | text 4
2 + p | text 90
2 + ul |
3 + li | text 9
3 + li | text 12
2 + blockquote | text 25
1 - aside class=sidebar |
2 - h3 | short
2 - ul |
3 - li | links 1
3 - li | links 1
1 - section class=comments |
2 - h3 | text 2
2 - div class=comment |
3 - p | text 20
2 - div class=comment |
3 - p | text 35
1 - form class=newsletter | text 6
2 - label | short
2 - button | short
1 - footer | text 6
2 - p | links 3
""", """
0 - body |
1 - nav |
2 - ul |
3 - li | links 1
3 - li | links 1
3 - li | links 1
3 - li | links 1
1 - div class=ad | text 9
1 + article |
2 + h1 | text 9
2 + p | text 12
2 + p | text 45
2 + p | text 2
2 + p | text 70
2 + p | text 1
1 - footer | text 10
""", """
0 - body |
1 - div id=header | short
2 - ul class=menu |
3 - li | links 1
3 - li | links 1
1 - div id=wrapper |
2 + div id=content class=post |
3 + h1 | text 8
3 - div class=share | links 3
3 + div class=entry-content |
4 + p | text 50
4 + p | text 30
4 + h3 | text 3
4 + p | text 80
4 - div class=related |
5 - h4 | text 2
5 - p | links 2
4 + p | text 3
2 - div id=sidebar |
3 - div class=widget | text 20
3 - div class=widget | links 4
1 - div id=footer | text 12
""", """
0 - body |
1 - div class=topbar | links 4
1 - div class=breadcrumb | links 3
1 + main |
2 + section |
3 + h1 | text 6
3 + p | text 100
3 + figure |
4 + figcaption | text 10
3 + p | text 65
3 + table |
4 + tr |
5 + td | text 3
5 + td | text 2
4 + tr |
5 + td | text 5
5 + td | text 1
2 - section id=comments |
3 - ol |
4 - li class=comment | text 40
4 - li class=comment | text 15
3 - form | short
4 - textarea | short
1 - aside | text 30
1 - div class=legal | text 40
""", """
0 - body |
1 - header | text 3
1 - nav class=main-nav | links 6
1 - div class=popup consent | text 25
2 - button | short
1 + div class=story |
2 + h1 | text 10
2 + div class=text | text 120
2 + div class=text | text 6
2 - aside class=promo | text 18
2 + div class=text | text 55
1 - div class=discussion |
2 - p | text 25
2 - p | text 12
1 - div class=banner sponsor | text 15
1 - footer class=site-footer |
2 - ul |
3 - li | links 1
3 - li | links 1
2 - p | text 9
""", """
0 - body |
1 - div class=page |
2 - div class=masthead | short
2 - div class=nav | links 5
2 + div class=main |
3 + article class=article-body |
4 + header |
5 + h1 | text 7
5 - p class=share | links 2
4 + p | text 40
4 + pre | text 20
4 + p | text 75
4 + ol |
5 + li | text 15
5 + li | text 7
4 - div class=advert | text 10
4 + p | text 28
4 - footer class=tags | links 4
2 - div class=aside right-rail |
3 - h2 | short
3 - p | text 22
2 - div class=subscribe newsletter | text 16
2 - div class=copyright | text 8
""", """
0 - body |
1 + p | text 70
1 + p | text 45
1 + h2 | text 4
1 + p | text 90
1 - p | links 4
1 - div | links 6
""", """
0 - body |
1 - div | links 7
1 + div |
2 + h1 | text 8
2 + p | text 60
2 + p | text 40
2 + p | text 5
1 - div | links 5
1 - div | text 7
""", """
0 - body |
1 - section class=notice alert | text 30
1 - section role=navigation | links 5
1 + section role=main |
2 + h1 | text 6
2 + p | text 35
2 + p | text 55
2 + dl |
3 + dt | text 2
3 + dd | text 12
1 - section role=complementary | text 33
1 - section class=reader-comments |
2 - article class=comment |
3 - p | text 45
2 - article class=comment |
3 - p | text 18
1 - section role=contentinfo | text 14
"""]

_SYLLABLES = "ba do ri mu ten lo sha ve ki or an est ul pra co ni".split()


def _words(n: int, rng: random.Random) -> str:
    n = max(1, round(n * rng.uniform(0.4, 1.8)))
    words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for i in range(9, n, 10):
        words[i] += "."
    return " ".join(words).capitalize() + ("." if n > 4 else "")


def _content(what: str, rng: random.Random) -> str:
    kind, _, n = what.strip().partition(" ")
    if kind == "text":
        return _words(int(n), rng)
    if kind == "links":
        return " ".join(f'<a href="/{rng.randint(1, 999)}">{_words(2, rng)}</a>' for _ in range(int(n)))
    return _words(1, rng) if kind == "short" else ""


def page(layout: str, rng: random.Random) -> str:
    """A page whose elements say their label in the attribute ``data-label``."""
    out, open_tags = ["<!DOCTYPE html><html><head><title>", _words(4, rng), "</title></head>"], []
    for line in layout.strip().splitlines():
        head, _, content = line.partition("|")
        depth, sign, tag, *attributes = head.split(maxsplit=3)
        while len(open_tags) > int(depth):
            out.append(f"</{open_tags.pop()}>")
        pairs = [a.partition("=") for a in _attributes(attributes[0] if attributes else "")]
        out.append(f'<{tag} data-label="{sign}"' + "".join(f' {k}="{v}"' for k, _, v in pairs) + ">" + _content(content, rng))
        open_tags.append(tag)
    out += [f"</{t}>" for t in reversed(open_tags)] + ["</html>"]
    return "".join(out)


def _attributes(text: str) -> list[str]:
    """``class=a b id=c`` to its pairs: a word without ``=`` goes on with the pair before."""
    out: list[str] = []
    for word in text.split():
        if "=" in word or not out:
            out.append(word)
        else:
            out[-1] += " " + word
    return out


def pages(copies: int = 12, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    return [page(layout, rng) for _ in range(copies) for layout in LAYOUTS]
