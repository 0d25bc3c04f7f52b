"""Main text of web pages by two passes of block rules.

A page is cut into blocks of text. The first pass judges each block by itself: by what it
stands in, its share of link text, its share of stop words and its length; where the stop
words' languages are not those of the page, by the others alone. It leaves short
blocks, and those with few stop words inside an article, undecided; the second pass gives
these the label of the nearest decided neighbours in the same part of the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gaugeworks.llm.common import column, map_arrow

#: Frequent function words of English, German, French, Spanish, Italian, Portuguese, Dutch,
#: Danish, Norwegian and Swedish; in any other language a page has few of them.
STOP = frozenset(
    """
    a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its
    just like me more my no not of on one only or our out over she so some than that the their them then there these they this to up us
    was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für haben hat ich
    ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wer wie wir wird zu zum zur
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son
    sont sur un une vous
    al como con cuando de del el ella en entre era es esta este ha hay la las lo los más me mi muy no nos o para pero por porque que se ser si
    sin sobre son su sus también un una y ya
    che da della di gli ha il non per più questo sono una
    ao das dos em foi mais não na nas no nos os pela pelo seu uma
    dat de een het niet op te van voor zijn
    af alle at att av blev blir ble da det efter eller enn ett fra från før för ha han hade har hun ikke inte jag jeg kan man med meg mig mot nå når något noe noget
    nu och og også om på så sig skal ska som till til under ut vara var ved vi vid ville är
    """.split()
)
#: Elements whose text is none, that frame a page, that hold its article, and that break a block.
RAW = ("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "select", "title", "canvas", "audio", "video")
FRAME = frozenset("nav header footer aside form menu dialog button fieldset".split())
MAIN = frozenset("article main".split())
BREAK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role names of parts that are not the article.
PARTS = frozenset(
    "ad ads adbox advert adverts advertisement alert alerts banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo promoted promotion related "
    "replies reply respond responses search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that may stand beside these in such a name, and in names of the heads of articles.
BESIDE = frozenset(
    "all area articles bar block blocks body bottom box btn button buttons column container content count desktop entries entry feed fixed floating form global "
    "grid group holder icon icons inline inner item items js large left link links list main media mobile module news outer overlay page panel policy post posts "
    "primary reader readers right row secondary section side signup site slot small sticky stories story text thread title top unit up user users visitor visitors web widgets wrap wrapper".split()
)
HEADED = frozenset("article post entry story content news blog page section title".split())
LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH, LINKS = 70, 200, 0.15, 0.30, 0.33
#: A page's share of stop words below which its language is none of theirs, and the letters that a wide one counts as.
STOP_KNOWN, WIDE = 0.20, 3

#: What a heading over readers' comments says, in the stop words' languages, and
#: what stands in its part if they are comments: boxes for writing, names of writers.
_TALK = re.compile(
    r"(?:\d+\s+)?(?:(?:reader|user|all|latest|recent|leave|post|add|write|join)s?\s+(?:(?:an?|the|your)\s+)?)?"
    r"(?:comments?|repl(?:y|ies)|responses?|discussion|kommentare?r?|commentaires?|comentarios?|comentários?|commenti|reacties)"
    r"(?:\s*\(?\d+\)?)?(?:\s+(?:on|to)\s.{1,200})?\s*[:.!]?",
    re.I | re.S,
)
_TALKERS = re.compile(r"comment|repl(?:y|ies)|respon[ds]|avatar|author", re.I)
#: How a line of rights begins.
_RIGHTS = re.compile(r"\s*(?:©|\(c\)\s|copyright\s+(?:©|\(c\)|\d{4}))", re.I)

_TOKEN = re.compile(
    r"(?P<text>[^<]++)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[/!?a-zA-Z][^>]*+>"
    r"|(?P<lone><)"
)
_START = {tag: re.compile(rf"<{tag}[\s/>]", re.I) for tag in RAW}
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
#: Where code ends that has no end tag.
_AFTER_CODE = re.compile(r"</?(?:html|head|body|main|article|section|div|p|h[1-6]|ul|ol|table|nav|header|footer|aside)\b", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)(?![\w-])", re.I)
_PART = re.compile(r"[a-z]+|\d+")
_LETTERS = re.compile(r"[^\W\d_]+")
_OTHER = re.compile(r"[^\W\d_\u0000-\u024f\u1e00-\u1eff\uff21-\uff5a]")
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")


@dataclass
class Block:
    text: str
    links: int
    framed: bool
    main: int
    heading: bool
    part: int = 0
    label: str = ""


@lru_cache(maxsize=1 << 16)
def _names_part(name: str, main: int) -> bool:
    """Whether a class, id or role name is, as a whole, that of a part which is not the
    article: such a word and at most words of place and form beside it (sidebar-left,
    related-posts); not has-sidebar, ad-free or related-work, nor the head of an article."""
    words = set(_PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name.partition("--")[0] or name).lower()))
    found = PARTS & words
    if not found or not all(w in PARTS or w in BESIDE or w in HEADED or w.isdigit() for w in words):
        return False
    return found != {"header"} or not main and HEADED.isdisjoint(words)


def _outside(tag: str, attributes: str, main: int) -> str:
    """Why an element and all in it is no part of an article: frame, part (by its name
    alone), or nothing."""
    if tag in FRAME:
        return "frame" if tag != "header" or not main else ""
    if not attributes or tag in ("html", "body") or tag in MAIN and not re.search("comment", attributes, re.I):
        return ""
    part = ""
    for found in _ATTRIBUTE.findall(attributes):
        key, value = found[0].lower(), found[1] or found[2] or found[3]
        if key == "hidden" and value.lower() != "until-found" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return "frame"
        if key in ("class", "id", "role") and not part:
            # classes like md:hidden and group/nav are rules of layout, not names
            names = [n for n in value.split() if key != "class" or not re.search(r"[:/\[(]", n)]
            part = "part" if any(_names_part(n, main) for n in names) else ""
    return part


def _tokens(page: str):
    """(text, "", "") and ("", tag, attributes) in order, an end tag as /tag. What comments
    and elements without text hold is passed over. Such an element without an end tag, or
    one that closes itself, holds nothing: no page is lost to it."""
    at, last = 0, page.rfind(">")
    gone: set = set()  # what does not come again from here on, so each is looked for once

    def ahead(pattern, what):
        found = None if what in gone else pattern.search(page, at)
        if not found:
            gone.add(what)
        return found

    while at < len(page):
        if at > last:
            # a tag that never ends is none, and no text
            yield re.split(r"<[/!?a-zA-Z]", page[at:], maxsplit=1)[0], "", ""
            return
        if page.startswith("<!--", at):
            end = -1 if "-->" in gone else page.find("-->", at + 2)
            if end < 0:
                gone.add("-->")
            at = end + 3 if end >= 0 else page.find(">", at) + 1
            continue
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["tag"] is None:
            if m["text"] or m["lone"]:
                yield m[0], "", ""
            continue
        tag, more = m["tag"].lower(), m["more"]
        if tag not in _END:
            yield "", m["end"] + tag, more
            continue
        if m["end"]:
            continue
        end = ahead(_END[tag], "/" + tag)
        if more.endswith("/"):
            # script and style may go on all the same
            if tag not in ("script", "style") or not end or (again := ahead(_START[tag], tag)) and again.start() < end.start():
                continue
        if end:
            at = end.end()
        elif tag in ("script", "style"):
            found = _AFTER_CODE.search(page, at)
            at = found.start() if found else len(page)


def blocks(page: str) -> list[Block]:
    """The page's blocks of text, in order; references decoded, white space folded."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple] = []  # (tag, frames, mains, links, headings, named part, article) of what is open
    opened: Counter = Counter()
    frames = links = headings = main = mains = 0
    named, above = 0, [0]  # the innermost open element that is outside by its name alone, and what each stands in
    sizes: Counter = Counter()  # characters without links directly in each of these
    articles: list[list] = []  # [size, named part around it] of each article
    held: set[int] = set()  # named parts that hold the page's article after all
    # under a heading that names comments: how deep, its level, its block, whether they are
    talk: list = []

    def close():
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, min(linked, len(text)), frames > 0, main, headings > 0, named))
            if not frames:
                sizes[named] += len(text) - out[-1].links
        parts.clear()
        linked = 0

    def leave():
        nonlocal frames, links, headings, main, named
        name, f, a, l, h, n, article = stack.pop()
        opened[name] -= 1
        frames, links, headings = frames - f, links - l, headings - h
        named = above[named] if n else named
        main = 0 if a else main
        if article:
            article[0] = sizes[article[1]] - article[0]
        return name

    def settle_talk():
        """Of a part under such a heading nothing is the article, if readers write there."""
        if talk and talk[3]:
            for b in out[talk[2] :]:
                b.framed = True
        talk.clear()

    def headed(level):
        """A heading has ended: it may open readers' comments, or end them."""
        here = out[-1] if out and out[-1].heading else None
        if here and _TALK.fullmatch(here.text):
            if not talk or level <= talk[1]:
                settle_talk()
                talk.extend((len(stack), level, len(out) - 1, False))
        elif talk and level <= talk[1]:
            last = [out.pop()] if here else []
            settle_talk()
            out.extend(last)

    def hold(part):
        while part and part not in held:
            held.add(part)
            part = above[part]

    for text, tag, more in _tokens(page):
        if not tag:
            parts.append(text)
            if links:
                linked += len("".join(html.unescape(text).split()))
            continue
        name = tag.lstrip("/")
        if name == "head":
            # what a head may hold is skipped by itself; anything else ends it, as </head> may be left out
            continue
        if name in BREAK:
            close()
        elif name == "br":
            parts.append(" ")
        if tag != name:
            while opened[name] and leave() != name:
                pass
            if talk and len(stack) < talk[0]:
                settle_talk()
            if len(name) == 2 and name[0] == "h" and name[1] in "123456":
                headed(int(name[1]))
        elif name not in VOID and not more.endswith("/"):
            # an open p ends where the next begins; li, dt, dd, td, th, tr and option likewise
            if name in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == name:
                leave()
            if talk and (name in ("article", "form") or _TALKERS.search(more)):
                talk[3] = True
            why = _outside(name, more, main)
            f, n = int(why == "frame"), int(why == "part")
            if n:
                above.append(named)
                named = len(above) - 1
            a, article = 0, None
            if name in MAIN and not (frames or f or n) and named:
                if name == "main":
                    hold(named)
                else:
                    articles.append(article := [sizes[named], named])
            if name in MAIN and not main:
                mains += 1
                a = main = mains
            l, h = int(name == "a"), int(name in ("h1", "h2", "h3", "h4", "h5", "h6"))
            frames, links, headings = frames + f, links + l, headings + h
            opened[name] += 1
            stack.append((name, f, a, l, h, n, article))
    close()
    settle_talk()
    while stack:
        leave()
    # a named part also holds the page's article if an article in it has more text than stands free
    if articles and (most := max(articles, key=lambda x: x[0]))[0] > sizes[0]:
        hold(most[1])
    for b in out:
        b.framed = b.framed or b.part > 0 and b.part not in held
    return out


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text) + (WIDE - 1) * len(_WIDE.findall(text))


def _other_script(text: str) -> bool:
    """Whether most letters are of a script that no list of stop words is in."""
    return not text.isascii() and 2 * len(_OTHER.findall(text)) > sum(map(len, _LETTERS.findall(text)))


def _stops(text: str) -> tuple[int, int]:
    """The stop words and all words."""
    words = _LETTERS.findall(text.lower())
    return sum(w in STOP for w in words), len(words)


def judge(block: Block, has_main: bool, known: bool = True) -> str:
    """The first pass: good, bad, or near or short (undecided). ``known``: whether the page
    is in one of the stop words' languages."""
    if block.framed or (has_main and not block.main):
        return "bad"
    size = _size(block.text)
    density = block.links / len(block.text)
    if density > LINKS:
        # inside an article only what is links and nothing else is a menu
        return "short" if block.main and density < 0.9 else "bad"
    if size < LENGTH_HIGH and _RIGHTS.match(block.text):
        return "bad"
    if size < LENGTH_LOW or block.heading:
        return "bad" if density > 0 and not block.main else "short"
    hits, words = _stops(block.text)
    share = hits / words if words else 0.0
    if words and (not known or _other_script(block.text)):
        share = STOP_HIGH
    if share >= STOP_HIGH:
        return "good" if size > LENGTH_HIGH or block.main else "near"
    if share >= STOP_LOW:
        return "near"
    return "short" if block.main or size <= LENGTH_HIGH else "bad"


def _known(found: list[Block], has_main: bool) -> bool:
    """Whether the page's long blocks of text hold the stop words of any list."""
    hits = words = 0
    for b in found:
        if not b.framed and (b.main or not has_main) and len(b.text) >= LENGTH_LOW and b.links <= LINKS * len(b.text) and not _other_script(b.text):
            h, n = _stops(b.text)
            hits, words = hits + h, words + n
    return not words or hits >= STOP_KNOWN * words


def extract(page: str) -> str:
    """The article's blocks, joined by an empty line."""
    found = blocks(page)
    has_main = any(b.main and not b.framed for b in found)
    known = _known(found, has_main)
    labels = [judge(b, has_main, known) for b in found]
    final = list(labels)
    # the nearest decided block of the same part before and behind each
    nearest = []
    for step in (range(len(found)), range(len(found) - 1, -1, -1)):
        seen: dict = {}
        side = [None] * len(found)
        for k in step:
            side[k] = seen.get(found[k].main)
            if labels[k] in ("good", "bad") and not (found[k].framed and found[k].main):
                seen[found[k].main] = (labels[k], k)
        nearest.append(side)
    for k, label in enumerate(labels):
        if label in ("good", "bad"):
            continue
        sides = [s for s in (nearest[0][k], nearest[1][k]) if s]
        if found[k].main and not any(s[0] == "good" for s in sides):
            # an article without a decided block, or only bad ones around, keeps its short blocks
            final[k] = "good"
        elif not sides:
            final[k] = "good" if label == "near" else "bad"
        elif label == "near":
            final[k] = "good" if any(s[0] == "good" for s in sides) or len(sides) < 2 else "bad"
        else:
            final[k] = min(sides, key=lambda s: (abs(s[1] - k), s[0] == "bad"))[0]
            if len(sides) == 2 and sides[0][0] == sides[1][0]:
                final[k] = sides[0][0]
    if "good" not in final:
        # a page of short blocks alone has no neighbour to go by
        final = ["good" if label in ("short", "near") else "bad" for label in labels]
    return "\n\n".join(b.text for b, label in zip(found, final) if label == "good")


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` (empty where there is none) in place of the html column.

    Null and empty pages give an empty text. A column named text is replaced; other columns
    pass through; rows that repeat are extracted each for itself; an empty table gives an
    empty result. Text is never cut, however long.
    """
    kept = [f for f in pages.schema.fields if f.name not in (html_col, "text")]
    schema = T.StructType([*kept, T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            text = pa.array([extract(p.as_py() or "") for p in batch.column(len(kept))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], text], names=schema.names)

    return map_arrow(pages.select(*[column(f.name) for f in kept], column(html_col)), run, schema)
