"""A forgiving HTML reader: elements as parallel lists, with the features of each."""

from __future__ import annotations

import html as entities
import math
import re

import numpy as np

# Elements by what the language says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
UNSEEN = frozenset(
    "script style head title noscript template iframe svg math textarea select option button input object canvas".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
# What an opening tag closes if it is open, and where the search for it ends.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
CONTENT_TAGS = frozenset("article main".split())
OUTSIDE_TAGS = frozenset("nav header footer aside form dialog menu".split())
# Words in class, id and role that tell what an element is for.
CONTENT_WORDS = frozenset("article content main post entry story body text".split())
OUTSIDE_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer contentinfo sidebar aside complementary notice notices "
    "notification notifications cookie cookies consent gdpr banner ad ads advert adverts advertisement "
    "advertisements advertising sponsor sponsored sponsors promo promos promoted promotion form newsletter "
    "subscribe subscription signup signin login search comment comments commentlist reply replies respond disqus "
    "discussion share sharing social related recommended recommendations widget widgets breadcrumb breadcrumbs "
    "pagination pager popup modal dialog overlay toolbar copyright hidden alert disclaimer skip legal teaser".split()
)

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>?")
_ATTRIBUTE = re.compile(r"""([^\s=/"']++)(?:\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Page:
    """Elements in document order; ``runs`` are (element, text) pairs in page order."""

    def __init__(self, source: str):
        self.tags: list[str] = ["#root"]
        self.parents: list[int] = [-1]
        self.attributes: list[str] = [""]
        self.runs: list[tuple[int, str]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        open_now = [0]
        at, size, tags = 0, len(source), self.tags
        while at < size:
            start = source.find("<", at)
            if start < 0:
                start = size
            if start > at:
                self._text(open_now[-1], source[at:start])
            if start == size:
                break
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = size if end < 0 else end + 3
                continue
            if source.startswith(("<!", "<?"), start):
                end = source.find(">", start)
                at = size if end < 0 else end + 1
                continue
            match = _TAG.match(source, start) or _LOOSE.match(source, start)
            if not match:
                if source.startswith("</", start):  # an end tag without a name is a comment
                    end = source.find(">", start)
                    at = size if end < 0 else end + 1
                else:
                    self._text(open_now[-1], "<")
                    at = start + 1
                continue
            at = match.end()
            tag = match[2].lower()
            if match[1]:
                for place in range(len(open_now) - 1, 0, -1):
                    if tags[open_now[place]] == tag:
                        del open_now[place:]
                        break
                else:
                    if tag == "br":
                        self._text(open_now[-1], "\n")
                continue
            if tag in CLOSES_P:
                self._close(open_now, {"p"}, OUTSIDE_TAGS | CONTENT_TAGS | {"td", "th", "button"})
            elif tag in IMPLIED:
                self._close(open_now, *IMPLIED[tag])
            if tag == "br":
                self._text(open_now[-1], "\n")
                continue
            tags.append(tag)
            self.parents.append(open_now[-1])
            self.attributes.append(match[3])
            number = len(tags) - 1
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else size
                close = source.find(">", at)
                at = size if close < 0 else close + 1
            elif tag not in VOID:  # a closing slash means nothing on an HTML element
                open_now.append(number)

    def _close(self, open_now: list[int], closed, limits) -> None:
        for place in range(len(open_now) - 1, 0, -1):
            tag = self.tags[open_now[place]]
            if tag in closed:
                del open_now[place:]
                return
            if tag in limits:
                return

    def _text(self, element: int, text: str) -> None:
        self.runs.append((element, entities.unescape(text) if "&" in text else text))


FEATURES = 30


def attribute_words(attributes: str) -> set[str]:
    """Words of class, id and role, in lower case; ``hidden`` if the element is not shown."""
    words: set[str] = set()
    if not attributes.strip(" /"):
        return words
    for match in _ATTRIBUTE.finditer(attributes):
        name = match[1].lower()
        value = match[2] or match[3] or match[4] or ""
        if name in ("class", "id", "role", "itemprop"):
            words.update(w.lower() for w in _WORD.findall(value))
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            words.add("hidden")
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            words.add("hidden")
    return words


def features(page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every element, its weak label (1 content, 0 outside, -1 unknown), and its own text length."""
    size = len(page.tags)
    tags, parents = page.tags, page.parents
    own, links, commas, words = [0] * size, [0] * size, [0] * size, [0] * size
    first = [0] * size
    unseen, in_link, depth = [False] * size, [False] * size, [0] * size
    outside, content = [0] * size, [0] * size
    own_outside, own_content = [0] * size, [0] * size
    children, order = [0] * size, [0] * size
    same: dict[tuple[int, str], int] = {}
    for i in range(1, size):
        p, tag = parents[i], tags[i]
        depth[i] = depth[p] + 1
        order[i] = children[p]
        children[p] += 1
        same[p, tag] = same.get((p, tag), 0) + 1
        unseen[i] = unseen[p] or tag in UNSEEN
        in_link[i] = in_link[p] or tag == "a"
        marks = attribute_words(page.attributes[i]) if page.attributes[i] else ()
        if tag not in ("html", "body") and (tag in OUTSIDE_TAGS or marks and not OUTSIDE_WORDS.isdisjoint(marks)):
            own_outside[i] = 1
        elif tag in CONTENT_TAGS or marks and tag not in ("html", "body") and not CONTENT_WORDS.isdisjoint(marks):
            own_content[i] = 1
        outside[i] = outside[p] + own_outside[i]
        content[i] = content[p] + own_content[i]
    total = 0
    for element, text in page.runs:
        if unseen[element]:
            continue
        length = len(text.strip())
        if not length:
            continue
        if not own[element]:
            first[element] = total
        total += length
        own[element] += length
        words[element] += text.count(" ") + 1
        commas[element] += text.count(",") + text.count(".")
        if in_link[element]:
            links[element] += length
    below, nodes, paragraphs = own[:], [1] * size, [int(t == "p") for t in tags]
    for i in range(size - 1, 0, -1):
        p = parents[i]
        below[p] += below[i]
        links[p] += links[i]
        commas[p] += commas[i]
        words[p] += words[i]
        nodes[p] += nodes[i]
        paragraphs[p] += paragraphs[i]
        if below[i] and (not own[p] or first[i] < first[p]):
            first[p] = min(first[p] or first[i], first[i])
    rows = []
    log = math.log1p
    for i in range(size):
        p = max(parents[i], 0)
        tag, b = tags[i], below[i]
        rows.append((
            own_outside[i], own_content[i], min(outside[i], 3), min(content[i], 3),
            tag == "p", len(tag) == 2 and tag[0] == "h" and tag[1].isdigit(), tag == "li", tag in ("ul", "ol", "dl"),
            tag == "div", tag == "section", tag == "a", tag in INLINE, tag in ("table", "tr", "td", "th"),
            tag in ("html", "body", "#root"), depth[i], order[i], children[p], same.get((p, tag), 1) / max(1, children[p]),
            log(own[i]), log(b), links[i] / max(1, b), b / nodes[i] / 100, commas[i] / max(1, words[i]),
            log(words[i]), log(paragraphs[i]), b / max(1, total), b / max(1, below[p]), first[i] / max(1, total),
            log(nodes[i]), links[p] / max(1, below[p]),
        ))
    label = [
        -1 if unseen[i] or not below[i] else 0 if outside[i] else 1 if content[i] else -1 for i in range(size)
    ]
    shown = np.array([0 if u else o for u, o in zip(unseen, own, strict=True)])
    return np.array(rows, dtype=np.float32), np.array(label), np.where(unseen, -1, shown)


# Features that say what an element is called, for learning without them too.
NAMED = 4


def kept_text(page: Page, keep: np.ndarray) -> str:
    """Text of the kept elements: white space to one space, and one space between blocks."""
    out, last = [], None
    blocks: list[int] = []
    for i, tag in enumerate(page.tags):
        inline = tag in INLINE and i > 0
        blocks.append(blocks[page.parents[i]] if inline else i)
    for element, text in page.runs:
        if not keep[element]:
            continue
        if blocks[element] != last:
            out.append(" ")
            last = blocks[element]
        out.append(text)
    return " ".join("".join(out).split())
