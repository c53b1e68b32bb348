"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classes each block by its length, its link density (share of
characters inside links) and its stop-word density, with the containers it stands in: blocks of menus, page headers and footers,
sidebars, notices, adverts, forms and comments are bad whatever they say. Short blocks and blocks without stop words are
left undecided. A container that holds most of what the page says is none of these, whatever it is called: a form around the
body, a menu that was never closed. The article is what `article` or `main` hold, if that is most of the text that is left, and
not a card or a teaser. On pages in a language whose stop words are not known length and links decide. The second pass gives each undecided block the label of the nearest decided neighbours in the page.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.shared import map_rows

TEXT = {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64()}

# Fixed values of HTML: elements whose content is not text, that start a new block, and that have no end tag.
UNSEEN = {"script", "style", "noscript", "template", "head", "title", "svg", "math", "iframe", "object", "canvas", "audio",
          "video", "noframes", "xmp"}
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noframes", "xmp"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl",
         "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
         "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table",
         "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BAD_ELEMENTS = {"nav", "footer", "aside", "form", "menu", "button", "select", "textarea", "fieldset", "dialog", "label",
                "option"}
MAIN_ELEMENTS = {"article", "main"}
CLOSED_BY = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}, "option": {"option"}}

# Class and id words of containers that are not the article.
BAD_NAMES = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|adbox|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|sidebar|side|footer|"
    r"foot|masthead|site-header|page-header|topbar|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|"
    r"signup|login|share|sharing|social|related|recommend\w*|comments?|disqus|respond|replies|pagination|pager|widget|"
    r"toolbar|copyright|legal|disclaimer|tags?|skip)(?:$|[_-])", re.I)
COMMENT = re.compile(r"(?:^|[_-])(?:comments?|replies|respond|ads?|advert\w*|sponsor\w*)(?:$|[_-])", re.I)
# Words that mean such a container only by themselves or beside words for parts of a page, as `side-bar` but not `side-by-side`.
WEAK = {"side", "foot", "legal", "notice", "notices", "alert", "tag", "tags", "skip", "social", "banner", "login", "share", "related",
        "copyright", "disclaimer", "widget", "menu", "ad", "ads"}
PARTS = re.compile(r"(?:bar|box|wrap\w*|container|block|section|list|area|content|inner|links?|buttons?|items?|row|col\w*|main|left|right|"
                   r"top|bottom|site|page|post|posts|article|text|widget|panel|group|message|info|icons?|title|header?|footer|nav|modal|"
                   r"overlay|popup|policy|consent|cookies?|slot|unit|form|media|cloud|stories|story|news|to|global|primary|secondary|"
                   r"small|large|sticky|fixed|\d+|[a-z])", re.I)
# Such names say what a container of the article has beside it.
LAYOUT = re.compile(r"(?:^|[_-])(?:has|no|with|without|layout|wrap\w*|container)(?:$|[_-])", re.I)
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu",
             "menubar", "toolbar"}

# Frequent function words of the languages read here.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or that the they this to was were "
    "which who will with you au aux avec ce ces dans de des du elle en est et il je la le les leur mais ne nous ou où par pas "
    "plus pour qui que sa se ses son sont sur un une vous als am auch auf aus bei bin das dass dem den der die ein eine einem "
    "einen einer er es für hat ich im ist mit nach nicht noch oder sich sie sind so um und von war wie wir wird zu zum zur "
    "como con cuando del el ella ellos esta este ha han hay las lo los más me mi muy no nos o para pero por sin sobre su sus "
    "también te tu y ya".split())

TOKEN = re.compile(r"[^<]+|</?[a-zA-Z][^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*(?:>|$)|<!--.*?(?:-->|$)|"
                   r"<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</[^>]*(?:>|$)|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"[\s/\"'](class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Rules:
    """Thresholds of the first pass, in characters and shares."""

    short: int = 70
    long: int = 200
    links: float = 0.33
    most: float = 0.6
    stop_low: float = 0.15
    stop_high: float = 0.28


@dataclass
class Block:
    inside: tuple[int, ...]  # the bad containers around it
    main: bool
    heading: bool
    bad: bool = False
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        raw = "".join(self.parts)
        return " ".join((entities.unescape(raw) if "&" in raw else raw).split())


def attributes(tag: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(tag)}


def name_of(tag: str) -> str:
    named = NAME.match(tag)
    return named[1].lower() if named else ""


@functools.cache
def raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>]|$)", re.I)


def bad_names(given: dict[str, str], names: re.Pattern) -> bool:
    """Whether a class or the id says that this is no part of the article."""
    return any(is_bad_name(x, names) for x in (given.get("class", "") + " " + given.get("id", "")).split())


@functools.lru_cache(10_000)
def is_bad_name(name: str, names: re.Pattern) -> bool:
    if not names.search(name) or LAYOUT.search(name):
        return False
    words = [word for word in re.split("[_-]", name.lower()) if word]
    strong = [word for word in words if names.search(word) and word not in WEAK]
    return bool(strong) or all(word in WEAK or PARTS.fullmatch(word) for word in words) or bool(names.search("-".join(
        word if word not in WEAK else "" for word in words)))


def blocks(page: str) -> tuple[list[Block], list[bool]]:
    """The blocks of a page in order, with the containers each stands in, and of each bad container whether it may turn out to be
    the page itself (which comments and adverts never are)."""
    # Open elements: (name, is bad, is main, is unseen, is a link).
    stack: list[tuple[str, bool, bool, bool, bool]] = []
    containers: list[bool] = []
    inside: tuple[int, ...] = ()
    found: list[Block] = []
    # The blocks of the current paragraph: its text, and that of bad or main elements in it, by (bad containers, is main).
    here: dict[tuple[tuple[int, ...], bool], Block] = {}
    main = unseen = linked = 0
    headings = 0
    opened: dict[str, int] = {}

    def close(depth: int) -> None:
        nonlocal inside, main, unseen, linked, headings
        while len(stack) > depth:
            name, *flags = stack.pop()
            opened[name] -= 1
            inside = inside[:-1] if flags[0] else inside
            main, unseen, linked = main - flags[1], unseen - flags[2], linked - flags[3]
            headings -= name in HEADINGS

    tokens = TOKEN.finditer(page)
    while (match := next(tokens, None)) is not None:
        token = match[0]
        if token[0] != "<" or token == "<":
            if unseen:
                continue
            current = here.get((inside, main > 0))
            if current is None:
                current = here[inside, main > 0] = Block(inside, main > 0, headings > 0)
                found.append(current)
            current.parts.append(token)
            if linked:
                current.linked += len("".join(token.split()))
            continue
        name = name_of(token)
        if not name:
            if token.startswith("<![CDATA[") and not unseen and (inside, main > 0) in here:
                here[inside, main > 0].parts.append(entities.escape(token[9:-3]))
            continue
        if token[1] == "/":
            if opened.get(name):
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            if name in BLOCK:
                here = {}
            continue
        if name in BLOCK:
            here = {}
            if stack and name in CLOSED_BY.get(stack[-1][0], ()):
                close(len(stack) - 1)
            elif name != "br" and opened.get("p"):
                # A block ends an open paragraph with what is left open in it.
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"))
        if name in VOID or token.endswith("/>") and name not in BLOCK | RAW:
            continue
        given = attributes(token) if " " in token or "\n" in token or "\t" in token else {}
        is_main = name in MAIN_ELEMENTS or given.get("role", "").lower() in ("main", "article")
        is_bad = (name in BAD_ELEMENTS or name == "header" and not main or bool(given) and (
            given.get("role", "").lower() in BAD_ROLES
            or name not in ("html", "body") and bad_names(given, COMMENT if is_main else BAD_NAMES)))
        is_unseen = (name in UNSEEN or "hidden" in given or given.get("aria-hidden", "").lower() == "true"
                     or "display:none" in given.get("style", "").lower().replace(" ", ""))
        flags = is_bad, is_main, is_unseen, name == "a"
        stack.append((name, *flags))
        opened[name] = opened.get(name, 0) + 1
        if is_bad:
            inside += (len(containers),)
            containers.append(not bad_names(given, COMMENT))
        main, unseen, linked = main + flags[1], unseen + flags[2], linked + flags[3]
        headings += name in HEADINGS
        if name in RAW:
            # Nothing in such an element is a tag but its own end.
            end = raw_end(name).search(page, match.end())
            tokens = TOKEN.finditer(page, end.start() if end else len(page))
    return found, containers


HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
GOOD, BAD, SHORT = "good", "bad", "short"


def excluded(block: Block, text: str, rules: Rules) -> bool:
    """Whether containers or links rule a block out."""
    return block.bad or block.linked / max(1, len(text.replace(" ", ""))) > rules.links


def stop_words(text: str) -> tuple[int, int]:
    """(stop words, words) of a text."""
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def is_read(held: list[tuple[Block, str]], rules: Rules) -> bool:
    """Whether the longer blocks of a page are together in a language whose stop words are known."""
    counts = [stop_words(text) for b, text in held if len(text) >= rules.short and not excluded(b, text, rules)]
    return sum(s for s, _ in counts) >= rules.stop_low * sum(n for _, n in counts)


def classify(block: Block, text: str, rules: Rules, read: bool, main: bool) -> str:
    """The first pass: good, bad, or short for undecided; without stop words if the page is not `read`."""
    if excluded(block, text, rules):
        return BAD
    if "\N{COPYRIGHT SIGN}" in text and len(text) < rules.long and not main:
        return BAD
    if main:
        # The page itself says that this is the article; only what the rules above exclude is not.
        return GOOD
    if len(text) < rules.short:
        return SHORT
    if not read:
        return GOOD
    known, words = stop_words(text)
    stops = known / max(1, words)
    if stops >= rules.stop_high or stops >= rules.stop_low and len(text) >= rules.long:
        return GOOD
    return SHORT if stops >= rules.stop_low else BAD


def unbound(found: list[tuple[Block, str]], containers: list[bool], rules: Rules) -> None:
    """Decide which containers are bad: not those that hold most of the text outside links."""
    sizes = [max(0, len(text.replace(" ", "")) - b.linked) for b, text in found]
    held = [0] * len(containers)
    for (b, _), size in zip(found, sizes):
        for container in b.inside:
            held[container] += size
    bad = [not (may_be and size > rules.most * sum(sizes)) for may_be, size in zip(containers, held)]
    for b, _ in found:
        b.bad = any(bad[container] for container in b.inside)


def labelled(held: list[tuple[Block, str]], rules: Rules, main: bool) -> list[str]:
    """Both passes: the label of each block, by the article's own element with `main`, else by rules alone."""
    read = main or is_read(held, rules)
    labels = [classify(b, text, rules, read, main and b.main) for b, text in held]
    # What is short in an `article` that is not the article is a card.
    labels = [BAD if main and not b.main or b.main and not main and label == SHORT else label
              for label, (b, _) in zip(labels, held)]
    before = nearest(labels)
    after = [None if j is None else len(labels) - 1 - j for j in reversed(nearest(labels[::-1]))]
    final = list(labels)
    for i, label in enumerate(labels):
        if label == SHORT:
            left, right = before[i], after[i]
            if held[i][0].heading and right is not None and labels[right] == GOOD:
                final[i] = GOOD
            elif left is not None and right is not None and labels[left] != labels[right]:
                final[i] = labels[left] if i - left < right - i else labels[right] if right - i < i - left else BAD
            else:
                final[i] = BAD if left is None and right is None else labels[right if left is None else left]
    return final


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    """The main text of a page: its good blocks in order, two line feeds between; empty if there is none."""
    found, containers = blocks(page or "")
    held = [(b, text) for b in found if (text := b.text())]
    unbound(held, containers, rules)
    sizes = [0, 0]
    for b, text in held:
        sizes[b.main] += 0 if excluded(b, text, rules) else len(text)
    other, own = sizes
    final = labelled(held, rules, own > 0)
    if 0 < own < other:
        # Text outside the article's element counts against it only where it reads like an article.
        plain = labelled(held, rules, False)
        if sum(len(text) for (b, text), label in zip(held, plain) if label == GOOD and not b.main) > own:
            final = plain
    return "\n\n".join(text for (_, text), label in zip(held, final) if label == GOOD)


def nearest(labels: list[str]) -> list[int | None]:
    """For each block the last decided one before it."""
    out, last = [], None
    for i, label in enumerate(labels):
        out.append(last)
        if label != SHORT:
            last = i
    return out


def extract(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages`, from the whole html; text is empty if there is none.

    A null page is an empty one. Rows that repeat are each extracted, and other columns are not read. Each page is
    extracted by itself where it is scanned, so nothing is shuffled.
    """
    def start():
        def one(row: tuple) -> Iterator[tuple]:
            page_id, url, page = row
            text = main_text(page, rules)
            yield page_id, url, text, len(text)
        return one

    return map_rows(pages.select(F.col("page_id"), "url", "html"), ["page_id", "url", "html"], start, TEXT, size=500)
