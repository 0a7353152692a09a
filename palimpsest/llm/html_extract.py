"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent words of the languages the pages are in.
STOP_WORDS = frozenset(
    """
a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their there
they this to was we were which who will with would you
aber als am an auch auf aus bei bin bis da das dass dem den der des die durch ein eine einem einen einer er es für
haben hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir zu zum zur
au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui mais mes ne nous on ou où par pas
plus pour qu que qui sa se ses son sont sur un une vous
al como con cual de del el ella ellos en entre era es esta este ha hay la las lo los más mi muy no o para pero por que se sin sobre su sus también un una y ya
""".split()
)
SKIPPED_TAGS = frozenset("nav footer aside form button select textarea iframe object dialog menu datalist fieldset video audio canvas".split())
RAW = frozenset("script style noscript template svg annotation-xml annotation head title".split())
BLOCK_TAGS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr".split())
# Parts of class and id tokens: certain names, names that may as well be a topic or a layout, and words that add nothing to either.
NAMED = frozenset(
    """
ad ads advert adverts advertisement adbox banner promo sponsored cookie cookies gdpr popup modal newsletter subscribe signup
menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead toolbar sharing comments disqus replies login pagination pager
""".split()
)
DOUBTFUL = frozenset("promotion sponsor consent notice alert overlay widget header share social related recommended comment respond reply search copyright legal skip".split())
NEUTRAL = frozenset("site page main global top bottom primary secondary inner outer wrapper wrap container box bar block section area list links link item items post posts user panel".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog".split())
KEPT_NAMES = re.compile(r"(?<![a-z])(?:article|entry|post|content|main)[-_]?(?:header|body|content|text|title)")
NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
MARK = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Rules:
    short: int = 70
    long: int = 200
    few_stops: float = 0.12
    few_stops_inside: float = 0.06
    many_stops: float = 0.25
    most_links: float = 0.2
    most_links_inside: float = 0.5


@dataclass
class Block:
    text: str
    links: int
    inside: bool
    heading: bool
    skipped: bool
    code: bool = False
    doubtful: bool = False


def token_says(token: str) -> str:
    """"certain" if all parts of a class or id token are boilerplate names or neutral words, "doubt" if no name is a certain one, else ""."""
    parts = {x.lower() for x in NAME_PARTS.findall(KEPT_NAMES.sub(" ", token))}
    if not parts <= NAMED | DOUBTFUL | NEUTRAL:
        return ""
    return "certain" if parts & NAMED else "doubt" if parts & DOUBTFUL else ""


def markup_says(tag: str, attributes: str) -> str:
    """"certain" if attributes say that an element is hidden or no content, "doubt" if they only hint at it, else ""."""
    said = ""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "style" and NOT_SHOWN.search(value)) or (name == "aria-hidden" and value.strip().lower() == "true"):
            return "certain"
        if name == "role" and value.strip().lower() in ROLES:
            return "certain"
        if name not in ("class", "id", "aria-label"):
            continue
        for token in value.split() if name == "class" else [value]:
            says = token_says(token)
            if says == "certain" and (name == "class" or (name == "id" and tag in ("div", "ul", "ol", "table"))):
                return "certain"
            said = said or says and "doubt"
    return said


class TagEnds:
    """Where tags end, in time linear in the page: a place from which no end was found is never searched from again."""

    def __init__(self, page: str):
        self.page, self.dead = page, set()
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def find(self, at: int) -> int:
        """The position after the > that ends a tag whose name ends here, or -1. Quoted ones do not count, unless no other is left."""
        seen, i = [], at
        while True:
            m = MARK.search(self.page, i)
            if m is None or m.start() in self.dead:
                self.dead.update(seen)
                return self.page.find(">", at) + 1 or -1 if at <= self.last[">"] else -1
            c, i = m[0], m.end()
            if c == ">":
                return i
            seen.append(m.start())
            if m.start() < self.last[c]:
                i = self.page.index(c, i) + 1


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text, "", False, "") or ("", tag, whether it closes, attributes) in order; comments and elements without text are left out.

    A < that starts no tag is text, so is one that no > follows. An unclosed comment or script goes to the end of the page.
    """
    ends, at, n = TagEnds(page), 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            yield page[at:start], "", False, ""
        if start == n:
            return
        at = start + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            at = n if end < 0 else end + 3
            continue
        name = NAME.match(page, at)
        end = -1
        if start < ends.last[">"] and (name or page[at : at + 1] in ("!", "?")):
            end = ends.find(name.end()) if name else page.find(">", at) + 1
        if end < 0:
            yield "<", "", False, ""
            continue
        at = end
        if not name:
            continue
        tag, closes = name[2].lower(), name[1] == "/"
        if tag in RAW and not closes:
            m = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = m.end() if m else n
            continue
        yield "", tag, closes, page[name.end() : end - 1]


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order, with the link characters in each, whether an article holds it, and whether markup says it is no content or hints at it."""
    out: list[Block] = []
    parts: list[str] = []
    links = inside = anchors = nested = doubts = code = 0
    skip = doubt = ""
    heading = False

    def close() -> None:
        nonlocal links, heading
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, links, inside > 0, heading, bool(skip), code > 0, bool(doubt)))
        parts.clear()
        links, heading = 0, False

    for text, tag, ending, attributes in tokens(page):
        if not tag:
            parts.append(text)
            if anchors:
                links += len(text.strip())
            continue
        if tag == "a":
            anchors = 0 if ending else 1
            continue
        if tag == "br" or tag == "img" or tag == "wbr":
            parts.append(" ")
            continue
        if skip:
            leaves = tag in ("article", "main", "body") and skip not in ("article", "main")
            implied = skip in PARAGRAPH and not ending and tag in BLOCK_TAGS and tag != skip
            if leaves or implied or (tag == skip and ending and nested == 1) or (tag == skip and not ending and skip in ("p", "li")):
                close()
                anchors, same = 0, tag == skip and ending
                skip = ""
                if same:
                    continue
            else:
                if tag == skip:
                    nested += -1 if ending else 1
                if tag in BLOCK_TAGS:
                    close()
                continue
        void = attributes.rstrip().endswith("/") or tag in ("input", "hr", "meta", "link", "img", "source")
        opens = not ending and not void and tag not in ("body", "html", "article", "main")
        says = markup_says(tag, attributes) if opens and attributes else ""
        if opens and (tag in SKIPPED_TAGS or (tag == "header" and not inside) or says == "certain"):
            close()
            skip, nested = tag, 1
            continue
        if doubt and tag in (doubt, "article", "main", "body"):
            doubts += 0 if void else -1 if ending else 1
            if tag != doubt or not doubts:
                close()
                doubt = ""
        elif says and not doubt and tag in BLOCK_TAGS and tag not in PARAGRAPH:
            close()
            doubt, doubts = tag, 1
        if tag in BLOCK_TAGS:
            close()
            heading = tag[0] == "h" and tag[1:].isdigit() and not ending
            if tag in ("article", "main"):
                inside = max(0, inside + (-1 if ending else 1))
            if tag == "pre":
                code = 0 if ending else 1
    close()
    return out


def stop_density(text: str) -> float:
    words = [w for w in re.split(r"[\W\d_]+", text.lower()) if w]
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def no_prose(b: Block) -> bool:
    """Code, or a plain-text table with a bar at least every four words: the share of frequent words says nothing of it."""
    return b.code or b.text.count("|") >= max(3, len(b.text.split()) / 5)


def first_pass(found: list[Block], rules: Rules) -> list[str]:
    """Each block alone: good, bad, near good or short, by link density, length and the share of stop words.

    In an <article> or <main> more links and fewer stop words are allowed. Where the text in it as a whole lacks stop words
    (another language), or a block is no prose, their share decides nothing there. Where a name only hints at no content,
    the container is no evidence.
    """
    article = any(b.inside and not b.skipped for b in found)
    told = not article or stop_density(" ".join(b.text for b in found if b.inside and not b.skipped and not no_prose(b))) >= rules.few_stops_inside
    labels = []
    for b in found:
        linked, inside = b.links / max(1, len(b.text)), b.inside and not b.doubtful
        if b.skipped or linked > (rules.most_links_inside if inside else rules.most_links):
            labels.append("bad")
        elif len(b.text) < rules.short:
            labels.append("bad" if b.links and not inside else "short")
        else:
            stops = stop_density(b.text)
            if stops >= rules.many_stops:
                labels.append("good" if len(b.text) >= rules.long or inside else "near")
            elif inside and (not told or no_prose(b)):
                labels.append("near")
            else:
                labels.append("near" if stops >= (rules.few_stops_inside if inside else rules.few_stops) else "bad")
    return labels


def second_pass(found: list[Block], labels: list[str]) -> list[str]:
    """Short and near blocks take the labels of the nearest decided blocks on both sides.

    Beyond the edges of an <article> or <main> stands a good neighbour for blocks in it, a bad one for those outside, and one good
    neighbour is enough for a short block in it; beyond those of a page without either a bad one, if any block is good. Where a
    name only hints at no content, both neighbours must be good.
    """
    article = any(b.inside and not b.skipped for b in found)
    edge = "bad" if "good" in labels else None

    def nearest(order: list[int]) -> list[str | None]:
        out: list[str | None] = [None] * len(found)
        last, region = None, None
        for i in order:
            if found[i].inside != region:
                region = found[i].inside
                last = ("good" if region else "bad") if article else edge
            out[i] = last
            last = labels[i] if labels[i] in ("good", "bad") else last
        return out

    before, after = nearest(list(range(len(found)))), nearest(list(range(len(found)))[::-1])
    out = []
    for b, label, p, n in zip(found, labels, before, after, strict=True):
        if label in ("short", "near"):
            around = {p, n} - {None}
            if around == {"good"}:
                label = "good"
            elif "good" in around and not b.doubtful:
                label = "good" if label == "near" or b.inside or (b.heading and n == "good") else "bad"
            else:
                label = "good" if label == "near" and not around else "bad"
        out.append(label)
    return out


def main_blocks(found: list[Block], rules: Rules) -> list[Block]:
    return [b for b, label in zip(found, second_pass(found, first_pass(found, rules)), strict=True) if label == "good"]


def main_text(page: str | None, rules: Rules | None = None) -> str:
    return " ".join(b.text for b in main_blocks(blocks(page or ""), rules or Rules()))


def extract(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Markup says first what is no content (menus, forms, footers, notices and the like, by tag, role, or whole names in class or id); the
    other blocks are judged by link density, length and the share of frequent words, then short and doubtful ones by the
    nearest decided blocks. That a page marks its article is evidence for the blocks in it and against the others, see
    first_pass() and second_pass().

    Null html counts as empty, and a page without main text gives ''. Character references are decoded; white space in
    a block becomes one space, and one space joins the blocks. Pages are judged one by one, whatever their length:
    repeated rows alike, an empty table gives no rows, other columns are ignored.
    """
    rules = rules or Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [main_text(x, rules) for x in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
