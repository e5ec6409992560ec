"""Main text of web pages: flat text blocks judged by a small decision tree.

A page becomes a flat list of text blocks (text between block-level tags).  Each block is
described by its words and link density, those of its neighbours, and where it stands (inside a
main element, inside a boilerplate element or one whose class, id or role says so, or a heading).
Decision trees, grown on the labelled blocks below, tell content from boilerplate: blocks inside a
main element have a tree of their own, so length and neighbours never outweigh where they stand;
the other tree also knows whether the page has a main text elsewhere.
Inside a main element a class or id marks boilerplate only if all its words do (``share-buttons``, not ``share-prices``).

Scripts, styles, templates, comments, frames and form controls never give text.  Character
references are decoded, white space inside a block becomes one space, blocks are joined by \\n.

Defined results: null or empty html, or a page without content, gives an empty text; a page cut
off anywhere is read up to its end (an unclosed comment, tag or script swallows the rest, as in
browsers); an open head ends where a browser ends it, with or without ``</head>``; very long pages
are read whole, in one forward scan; repeated rows give equal results; an empty table gives no rows.
Only page_id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossrank.llm.common import ship

ship(__name__)

# Fixed values of HTML: elements whose content is no text, those that can stand in a head, elements
# without content, and elements that begin a new block.
SILENT = frozenset("script style template noscript svg math iframe object select option textarea button canvas audio video head title".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
MAIN = frozenset(("article", "main"))
ASIDE = frozenset("nav footer aside form menu dialog search fieldset".split())
# Words in a class, id or role that name what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies disqus footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices pagination popup promo promoted promotion related respond replies sharing "
    "share sidebar signup skip social sponsor sponsored subscribe tags toolbar widget widgets".split()
)
# Words that leave the meaning of a mark as it is.
PLAIN = frozenset(
    "area bar block box btn button buttons col column container content form group header heading holder icon icons inner "
    "item items label link links list main outer panel post posts row section slot text title top bottom unit wrap wrapper".split()
)
FEATURES = (
    "words", "link_density", "previous_words", "previous_density", "next_words", "next_density",
    "in_aside", "heading", "main_elsewhere",
)

# Labelled blocks: the features above, then 1 for content and 0 for boilerplate.
IN_MAIN = [
    # paragraphs and short lines of an article
    (85, 0.00, 40, 0.00, 60, 0.00, 0, 0, 0, 1), (120, 0.02, 85, 0.00, 30, 0.00, 0, 0, 0, 1),
    (3, 0.00, 90, 0.00, 70, 0.00, 0, 0, 0, 1), (1, 0.00, 45, 0.00, 1, 0.00, 0, 0, 0, 1),
    (2, 0.00, 1, 0.00, 12, 0.00, 0, 0, 0, 1), (12, 0.00, 6, 0.00, 110, 0.00, 0, 0, 0, 1),
    (40, 0.30, 80, 0.00, 25, 0.10, 0, 0, 0, 1), (8, 1.00, 60, 0.00, 75, 0.00, 0, 0, 0, 1),
    (2, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 1), (2, 1.00, 30, 0.00, 50, 0.00, 0, 0, 0, 1),
    # headings of an article
    (7, 0.00, 4, 1.00, 90, 0.00, 0, 1, 0, 1), (2, 0.00, 60, 0.00, 33, 0.00, 0, 1, 0, 1),
    (5, 1.00, 1, 1.00, 80, 0.00, 0, 1, 0, 1),
    # menus, adverts, side bars, forms and reader comments inside it
    (2, 1.00, 5, 0.00, 4, 1.00, 1, 0, 0, 0), (7, 0.60, 80, 0.00, 8, 0.70, 1, 0, 0, 0),
    (30, 0.10, 45, 0.00, 50, 0.00, 1, 0, 0, 0), (90, 0.00, 70, 0.00, 45, 0.00, 1, 0, 0, 0),
    (3, 0.00, 30, 0.00, 1, 0.00, 1, 1, 0, 0),
]
OUTSIDE = [
    # paragraphs, short ones and the last one included, of pages without a main element
    (70, 0.00, 4, 1.00, 55, 0.00, 0, 0, 0, 1), (55, 0.05, 70, 0.00, 3, 0.00, 0, 0, 0, 1),
    (9, 0.00, 65, 0.00, 80, 0.00, 0, 0, 0, 1), (4, 0.00, 48, 0.00, 52, 0.00, 0, 0, 0, 1),
    (22, 0.00, 7, 0.00, 31, 0.00, 0, 0, 0, 1), (16, 0.10, 50, 0.00, 2, 1.00, 0, 0, 0, 1),
    (18, 0.00, 3, 1.00, 0, 0.00, 0, 0, 0, 1), (3, 0.00, 6, 0.00, 0, 0.00, 0, 0, 0, 1),
    (1, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 1), (2, 0.00, 1, 0.00, 9, 0.00, 0, 0, 0, 1),
    (2, 0.00, 1, 1.00, 4, 0.00, 0, 0, 0, 1), (2, 0.00, 12, 0.00, 1, 1.00, 0, 0, 0, 1),
    (20, 0.40, 30, 0.00, 25, 0.00, 0, 0, 0, 1), (40, 0.00, 2, 1.00, 2, 1.00, 0, 0, 0, 1),
    (12, 0.00, 3, 1.00, 3, 1.00, 0, 0, 0, 1), (3, 0.00, 3, 0.00, 2, 1.00, 0, 0, 0, 1),
    # headings of such pages
    (6, 0.00, 2, 1.00, 90, 0.00, 0, 1, 0, 1), (3, 0.00, 75, 0.00, 40, 0.00, 0, 1, 0, 1),
    (2, 0.00, 0, 0.00, 2, 0.00, 0, 1, 0, 1),
    # menus, link lists and bread crumbs
    (1, 1.00, 0, 0.00, 1, 1.00, 1, 0, 0, 0), (2, 1.00, 1, 1.00, 9, 0.00, 1, 0, 0, 0),
    (4, 1.00, 3, 1.00, 5, 1.00, 0, 0, 0, 0), (6, 0.80, 2, 1.00, 2, 1.00, 0, 0, 0, 0),
    (3, 1.00, 60, 0.00, 2, 1.00, 0, 0, 0, 0), (2, 1.00, 2, 1.00, 70, 0.00, 0, 0, 0, 0),
    (15, 0.90, 4, 1.00, 6, 1.00, 0, 0, 0, 0), (3, 0.60, 4, 0.50, 2, 0.00, 0, 0, 0, 0),
    # labels of menus: short and among links
    (4, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0, 0), (1, 0.00, 1, 1.00, 1, 1.00, 0, 0, 0, 0),
    # footers, notices, adverts, side bars, forms and reader comments
    (9, 0.00, 80, 0.00, 0, 0.00, 1, 0, 0, 0), (25, 0.00, 60, 0.00, 0, 0.00, 1, 0, 0, 0),
    (60, 0.00, 3, 1.00, 20, 0.00, 1, 0, 0, 0), (8, 0.00, 2, 1.00, 7, 0.00, 1, 0, 0, 0),
    (45, 0.00, 4, 0.00, 38, 0.00, 1, 0, 0, 0), (2, 0.00, 45, 0.00, 38, 0.00, 1, 1, 0, 0),
    (14, 0.00, 3, 0.00, 0, 0.00, 1, 0, 0, 0), (2, 0.00, 1, 0.00, 4, 0.00, 1, 0, 0, 0),
    # whatever stands outside the main element of a page that has one
    (12, 0.00, 1, 1.00, 7, 0.00, 0, 0, 1, 0), (60, 0.00, 40, 0.00, 30, 0.00, 0, 0, 1, 0),
    (3, 0.00, 90, 0.00, 0, 0.00, 0, 0, 1, 0), (5, 0.00, 2, 1.00, 60, 0.00, 0, 1, 1, 0),
    (1, 0.00, 0, 0.00, 2, 0.00, 0, 0, 1, 0), (30, 0.00, 20, 0.00, 15, 0.00, 0, 0, 1, 0),
    (9, 0.00, 8, 0.00, 80, 0.00, 0, 0, 1, 0), (2, 0.00, 30, 0.00, 9, 0.00, 0, 0, 1, 0),
]


def grow(rows: list[tuple], depth: int = 6):
    """A decision tree by Gini impurity: (feature, limit, below, above), or a leaf's label."""
    labels = [r[-1] for r in rows]
    share = sum(labels) / len(labels)
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)

    def impurity(side):
        p = sum(r[-1] for r in side) / len(side)
        return len(side) * 2 * p * (1 - p)

    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:]):
            limit = (low + high) / 2
            below, above = [r for r in rows if r[f] < limit], [r for r in rows if r[f] >= limit]
            cost = impurity(below) + impurity(above)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, limit, below, above)
    if best is None:
        return int(share >= 0.5)
    _, f, limit, below, above = best
    return f, limit, grow(below, depth - 1), grow(above, depth - 1)


def classify(tree, features: tuple) -> bool:
    while isinstance(tree, tuple):
        f, limit, below, above = tree
        tree = above if features[f] >= limit else below
    return bool(tree)


def _marked(attributes: str, inside: bool) -> bool:
    """Whether class, id or role holds one of the marks, as a word of its own; ``inside`` a main element
    one of its names must hold no other meaning."""
    import re

    for name, a, b, c in re.findall(
        r"""(?i)(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", attributes
    ):
        value = re.sub(r"([a-z])([A-Z])", r"\1-\2", a or b or c).lower()
        for part in value.split() if inside and name.lower() != "role" else [value]:
            words = {w for w in re.split(r"[^a-z]+", part) if w}
            if not MARKS.isdisjoint(words) and not (inside and words - MARKS - PLAIN):
                return True
    return False


def blocks(html: str) -> list[tuple[str, int, float, bool, bool, bool]]:
    """(text, words, link density, in main, in aside, heading) of each block, in page order."""
    import html as references

    found = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, opens main, opens aside, silent
    main = aside = silent = link = heading = 0
    parts: list[str] = []
    linked: list[str] = []

    def flush():
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                words = text.count(" ") + 1
                in_links = len(references.unescape(" ".join(linked)).split()) if linked else 0
                found.append((text, words, min(1.0, in_links / words), main > 0, aside > 0, heading > 0))
            parts.clear()
            linked.clear()

    def close(k):
        nonlocal main, aside, silent, link, heading
        while len(stack) > k:
            tag, m, s, q = stack.pop()
            main, aside, silent = main - m, aside - s, silent - q
            link -= tag == "a"
            heading -= len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()

    def leave_head():  # its end tag is optional: text or a tag that cannot stand in it ends it
        if stack and stack[-1][0] == "head":
            close(len(stack) - 1)

    at, n = 0, len(html)
    while at < n:
        start = html.find("<", at)
        if start < 0:
            start = n
        if silent and html[at:start].strip(" \t\n\r\f"):
            leave_head()
        if start > at and not silent:
            parts.append(html[at:start])
            if link:
                linked.append(html[at:start])
        if start == n:
            break
        after = html[start + 1 : start + 2]
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if after in ("!", "?"):
            end = html.find(">", start)
            at = n if end < 0 else end + 1
            continue
        closing = after == "/"
        first = html[start + 1 + closing : start + 2 + closing]
        if not (first.isascii() and first.isalpha()):  # a bare "<" is text
            if closing:
                end = html.find(">", start)
                at = n if end < 0 else end + 1
            else:
                leave_head()
                if not silent:
                    parts.append("&lt;")
                at = start + 1
            continue
        end = _tag_end(html, start, n)
        inside = html[start + 1 + closing : end]
        at = end + 1
        cut = 0
        while cut < len(inside) and inside[cut] not in " \t\n\r\f/":
            cut += 1
        tag, attributes = inside[:cut].lower(), inside[cut:]
        if not closing and tag not in HEAD:
            leave_head()
        if tag in BLOCK:
            flush()
        elif tag == "br" and not silent:
            parts.append(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break  # an inline end tag does not close a block
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = _raw_end(html, tag, at)
            at = n if end < 0 else end
            continue
        if tag == "p" or tag == "li":  # these close an open one of their kind in the same parent
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        m = tag in MAIN
        s = tag in ASIDE or (tag == "header" and not main) or (
            tag not in ("html", "body", "article", "main") and "=" in attributes and _marked(attributes, main > 0)
        )
        q = tag in SILENT
        stack.append((tag, m, s, q))
        main, aside, silent = main + m, aside + s, silent + q
        link += tag == "a"
        heading += len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
    flush()
    return found


def _tag_end(html: str, start: int, n: int) -> int:
    """Position of the tag's ``>``, quotes respected; the page's end if there is none."""
    end = html.find(">", start)
    if end < 0:
        return n
    quote = min((q for q in (html.find('="', start, end), html.find("='", start, end)) if q >= 0), default=-1)
    at = start
    while quote >= 0:
        close = html.find(html[quote + 1], quote + 2)
        if close < 0:
            return end
        at = close + 1
        if at > end:
            end = html.find(">", at)
            if end < 0:
                return n
        quote = min((q for q in (html.find('="', at, end), html.find("='", at, end)) if q >= 0), default=-1)
    return end


def _raw_end(html: str, tag: str, at: int) -> int:
    """Where the end tag of a raw text element ends; its case may differ."""
    import re

    found = re.compile(rf"</{tag}[^>]*>", re.I).search(html, at)
    return found.end() if found else -1


def main_text(html: str | None, trees: tuple) -> str:
    inside, outside = trees
    rows = blocks(html or "")
    elsewhere = any(main and not aside for *_, main, aside, _ in rows)
    kept = []
    for i, (text, words, density, main, aside, heading) in enumerate(rows):
        before = rows[i - 1] if i else ("", 0, 0.0)
        after = rows[i + 1] if i + 1 < len(rows) else ("", 0, 0.0)
        features = (words, density, before[1], before[2], after[1], after[2], aside, heading, elsewhere and not main)
        if classify(inside if main else outside, features):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, in_main: list[tuple] = IN_MAIN, outside: list[tuple] = OUTSIDE) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    trees = grow(in_main), grow(outside, depth=8)

    def texts(batches):
        for batch in batches:
            yield pd.DataFrame({
                "page_id": batch["page_id"], "url": batch["url"],
                "text": [main_text(h, trees) for h in batch["html"]],
            })

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    found = rows.mapInPandas(texts, "page_id string, url string, text string")
    return found.select(
        F.col("page_id").cast(pages.schema["page_id"].dataType).alias("page_id"), "url", "text",
        F.length("text").cast("long").alias("n_chars"),
    )
