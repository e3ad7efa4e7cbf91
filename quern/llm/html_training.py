"""The labelled table of operator 2: small pages whose elements say by data-main whether their text is the article (1) or not (0).

LAYOUTS are written by hand for this operator. In them {S} stands for a short line, {T} for a title, {P} for a sentence or more, {L} for a
long paragraph, {A} for a link, {N} for a name, {C} for a class or id that says nothing; each is filled in anew, so that the pages
of one layout differ in their lengths. A label holds for all text within its element that has no label of its own.
"""

from __future__ import annotations

import random
import re

_WORDS = "the of river valley notes spring old boxes survey town water year paper measured north long bridge road archive winter snow by and was were from after".split()
_NAMES = "x1 box wrap2 col inner grid-4 c7 two-col side-by-side block_9 u-flow zone".split()

LAYOUTS = (
    # Semantic elements; an advert with a telling name, links around.
    """<html><head><title>{T}</title></head><body><header data-main=0><a href=/>{S}</a><p>{P}</p></header><nav data-main=0><ul><li>{A}</li><li>{A}</li><li>{A}</li></ul></nav>
    <div class="ad" data-main=0>{P}</div><article data-main=1><h1>{T}</h1><p>{L}</p><p>{S}</p><p>{P}</p><h2>{T}</h2><p>{S}</p><p>{L}</p></article>
    <aside data-main=0><h3>{S}</h3><p>{P}</p><p>{L}</p></aside><footer data-main=0>{P}</footer></body></html>""",
    # Linked headings and list items within the article; comments after it under a neutral name.
    """<body><nav data-main=0>{A} {A}<p>{P}</p></nav><main data-main=1><h1>{T}</h1><p>{L}</p><h2>{A}</h2><p>{P}</p><ul><li>{A}</li><li>{A}</li><li>{S}</li></ul><h3>{A}</h3><p>{S}</p><p>{A}</p></main>
    <div class="{C}" data-main=0><div class="{C}">{N}</div><p>{P}</p><div class="{C}">{N}</div><p>{L}</p></div><footer data-main=0><p>{P}</p><p>{S}</p></footer></body>""",
    """<body><nav data-main=0>{A} {A}</nav><article data-main=1><h1>{T}</h1><h2>{A}</h2><p>{L}</p><h3>{S}</h3><ul><li>{A}</li><li>{A}</li></ul><h2>{A}</h2><p>{A}</p></article><div data-main=0><h3>{S}</h3><p>{A}</p></div></body>""",
    # Adverts and comments under neutral names inside the article element.
    """<body><div class="{C}" data-main=0>{P}</div><article class="{C}" data-main=1><h1>{T}</h1><p>{L}</p><div class="{C}" data-main=0>{P}</div><p>{P}</p><p>{S}</p><div class="{C}" data-main=0>{S}</div><p>{L}</p>
    <div class="{C}" data-main=0><div>{N}</div><p>{P}</p><div>{N}</div><p>{S}</p><div>{N}</div><p>{L}</p></div></article><footer data-main=0>{S}</footer></body>""",
    # The same with names as spans that stand before their comments.
    """<body><article data-main=1><h1>{T}</h1><p>{S}</p><p>{L}</p><p>{L}</p><blockquote>{P}</blockquote><section class="{C}" data-main=0><div>{N}</div><p>{L}</p><div>{N}</div><p>{P}</p></section></article>
    <div data-main=0>{P}</div></body>""",
    # Nothing but div and p under neutral names.
    """<body><div class="{C}" data-main=0>{A} {A} {A}</div><div class="{C}" data-main=1><h1>{T}</h1><p>{L}</p><p>{P}</p><p>{L}</p><p>{L}</p></div><div class="{C}" data-main=0>{A} {A}</div>
    <div class="{C}" data-main=0>{S} {A}</div></body>""",
    """<body><div class="{C}" data-main=0><div>{A}</div><div>{A}</div><div>{A}</div></div><div class="{C}"><div data-main=0>{S}</div><div class="{C}" data-main=1><h2>{T}</h2><p>{L}</p><p>{L}</p><p>{P}</p></div></div>
    <div class="{C}" data-main=0><div>{N}</div><p>{P}</p><div>{N}</div><p>{L}</p></div><div data-main=0>{A} | {A} | {S}</div></body>""",
    # Text right in div elements.
    """<body><div id="{C}" data-main=0>{A} {A}</div><div class="{C}" data-main=1><h1>{T}</h1><div>{L}</div><div>{L}</div><div>{L}</div></div><div data-main=0>{S}</div><div data-main=0>{A}</div></body>""",
    # Forms, notices and a sidebar with telling names; a form around the whole page.
    """<body><form action=x><div class="cookie-notice" data-main=0><p>{L}</p><button>{S}</button></div><div class="sidebar" data-main=0><p>{L}</p>{A}</div><div class="{C}" data-main=1><h1>{T}</h1><p>{L}</p><p>{L}</p><p>{P}</p></div></form>
    <form data-main=0><p>{P}</p><input name=q><button>{S}</button></form><div class="share social" data-main=0>{P}</div></body>""",
    """<body><section class="newsletter" data-main=0><p>{L}</p></section><article data-main=1><header><h1>{T}</h1></header><p>{P}</p><p>{S}</p><div class="related" data-main=0>{A}<p>{L}</p></div><p>{L}</p><form data-main=0><p>{P}</p></form><p>{S}</p></article>
    <section id="comments" data-main=0><h3>{S}</h3><p>{L}</p><p>{S}</p></section></body>""",
    # Tables, lists, code and captions in an article.
    """<body><nav data-main=0><p>{P}</p></nav><article data-main=1><h1>{T}</h1><table><tr><td>{S}</td><td>{S}</td></tr><tr><td>{A}</td><td>{S}</td></tr></table><pre>{P}</pre><ol><li>{S}</li><li>{P}</li></ol>
    <figure><figcaption>{P}</figcaption></figure><p>{S}</p><dl><dt>{S}</dt><dd>{P}</dd></dl></article><footer data-main=0>{A} {P}</footer></body>""",
    # A wrapper of two columns, and one whose name sounds like a sidebar's.
    """<body><div class="two-col side-by-side"><div class="{C}" data-main=1><h1>{T}</h1><p>{L}</p><p>{L}</p><p>{L}</p></div><div data-main=0>{A} {A}</div></div><div class="footer" data-main=0><p>{L}</p></div></body>""",
    """<body><div class="sidebar-layout main more"><ul data-main=0><li>{A}</li><li>{A}</li><li>{A}</li></ul><article data-main=1><h1>{T}</h1><p>{L}</p><p>{P}</p><p>{S}</p></article></div><div class="banner" data-main=0><p>{P}</p></div></body>""",
    # No article element: lists of links and side matter under neutral names, lists within the article too.
    """<body><nav data-main=0><ul><li>{A}</li><li>{S}</li></ul><p>{L}</p></nav><div class="{C}" data-main=1><h1>{T}</h1><p>{L}</p><ul><li>{S}</li><li>{P}</li><li>{A}</li></ul><p>{P}</p></div><aside data-main=0><p>{L}</p></aside><footer data-main=0><p>{L}</p></footer></body>""",
    """<body><ul class="{C}" data-main=0><li>{A}</li><li>{A}</li><li>{A}</li></ul><div class="{C}" data-main=1><h1>{T}</h1><p>{L}</p><ul><li>{P}</li><li>{S}</li></ul><p>{L}</p></div>
    <div class="{C}" data-main=0><h3>{S}</h3><ul><li>{A}</li><li>{A}</li><li>{A}</li></ul></div><div data-main=0><p>{A}</p><p>{A}</p></div></body>""",
    """<body><div class="{C}" data-main=0><p>{A}</p><p>{A}</p><p>{A}</p></div><div class="{C}" data-main=1><h1>{T}</h1><p>{L}</p><h2>{A}</h2><p>{L}</p><p>{S}</p><h2>{T}</h2><p>{L}</p></div><div data-main=0><h4>{S}</h4><p>{A}</p><p>{A}</p></div></body>""",
    # Articles of few words.
    """<body><nav data-main=0><ul><li>{A}</li><li>{A}</li></ul></nav><div class="ad" data-main=0>{S}</div><article data-main=1><h1>{T}</h1><p>{S}</p></article><footer data-main=0>{P}</footer></body>""",
    """<body><div class="ad" data-main=0>{P}</div><article data-main=1><h1>{T}</h1><p><b>{T}</b><br><p>{P}</p><p>{S}</p><p>{L}</p></article><footer data-main=0>{S}</footer></body>""",
)


def _filled(layout: str, r: random.Random) -> str:
    def some(low: int, high: int) -> str:
        return " ".join(r.choices(_WORDS, k=r.randint(low, high))).capitalize()

    make = {
        "S": lambda: some(1, 7) + ".", "T": lambda: some(1, 12), "P": lambda: some(5, 16) + ".", "L": lambda: some(18, 90) + ".", "N": lambda: " ".join(x.capitalize() for x in r.choices(_WORDS, k=r.randint(1, 3))),
        "A": lambda: f"<a href=/{r.randrange(99)}>{some(1, 6)}</a>", "C": lambda: r.choice(_NAMES),
    }
    return re.sub(r"\{([STPLNAC])\}", lambda m: make[m[1]](), layout)


def pages(seed: int, each: int) -> list[str]:
    """Pages of every layout, as many as said of each."""
    r = random.Random(seed)
    return [_filled(layout, r) for layout in LAYOUTS for _ in range(each)]


TRAINING_PAGES = tuple(pages(1, 6))
