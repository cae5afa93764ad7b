"""Main-text extraction from HTML with two-pass block rules.

First pass: length, stop-word density and link density, with the landmark a block
stands in as further evidence, decide which blocks are text and which are
boilerplate. Second pass: short or doubtful blocks inherit the label of the nearest
decided neighbours in their landmark, or else of the nearest anywhere.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = {
    "en": frozenset("a an and are as at be but by for from has have he her his in is it its not of on or that the their they this to was were which will with you".split()),
    "de": frozenset("aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht oder sein sich sie sind so über um und uns von vor war was wie wir zu zum zur".split()),
    "fr": frozenset("au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous ont ou où par pas plus pour qu que qui sa se ses son sont sur un une vous".split()),
    "es": frozenset("al como con de del el ella en entre es esta este fue ha la las lo los más no nos o para pero por que se ser sin sobre su sus también un una y ya".split()),
}
#: Elements that end a block of text.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is no text of the page.
RAW_TAGS = frozenset("script style noscript template textarea select svg iframe object canvas title".split())
#: Landmarks that never hold main text, and those that do.
OFF_TAGS = frozenset("nav header footer aside form dialog head menu".split())
ON_TAGS = frozenset("article main".split())
#: Parts of names (class, id, role) that mark boilerplate whatever else the name says, and those that a contrary part outweighs.
OFF_WORDS = frozenset("ad ads adv advert advertisement adverts breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr menu modal nav navbar navigation newsletter notice pagination popup promo promoted related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget contentinfo dialog".split())
SOFT_WORDS = frozenset("aside banner complementary form header masthead search tags".split())
#: Such words also count where a part without a separator begins or ends with them.
LONG_WORDS = ("comment", "sidebar", "footer", "cookie", "newsletter", "breadcrumb", "advert", "sponsor", "pagination", "navbar", "navigation", "disclaimer")
#: Parts that contradict: as the last one (soft words), before a word (no-sidebar), and beside a sidebar (a wrapper of both).
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
#: A phrase within a text is left out for these alone: others may mark a word of it.
PHRASE_WORDS = frozenset("ad ads adv advert advertisement adverts promo promoted sponsor sponsored".split())
DENIALS = frozenset("no has with without hide not".split())
OTHER_WORDS = frozenset("commentary commentaries commentator commentators".split())
AUTHOR_BOXES = frozenset("bio box card info profile".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# a quote opens a value right after the equals sign, and nowhere else
_ATTRS = r"(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)({_ATTRS})(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=>/\"'][^\s=>/]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_CASES = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"[A-Za-z]+")
#: Scripts without spaces between words: two signs count as a word.
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_STOP = re.compile(r"[.!?\u2026\u3002\uff01\uff1f\u0964\u061f\u06d4][\"'\u00bb\u201d\u2019)\u300d\u300f]*$")
_OWNED = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)


@dataclass
class Block:
    text: str
    tag: str
    landmark: int  # number of the innermost landmark, 0 for none
    linked: int  # characters inside links
    off: bool = False  # inside boilerplate
    on: bool = False  # inside article or main
    label: bool | None = None


@dataclass
class Landmark:
    """An element that says what its content is, by its tag or by its names."""

    parent: int
    on: bool
    weak: bool  # a page without article may have its text in it all the same
    soft: bool  # a page's article may lie in it all the same
    holds: bool = False  # holds an article or main


def _parts(name: str) -> list[str]:
    return [p.lower() for p in _PART.findall(_CASES.sub(" ", name))]


def _off_name(name: str) -> int:
    """What a whole name says: 2 for boilerplate, 1 for what is so unless the page's text lies in it, 0 for nothing."""
    parts, said = _parts(name), 0
    for i, p in enumerate(parts):
        if p in OTHER_WORDS or i and parts[i - 1] in DENIALS or p == "sidebar" and "content" in parts:
            continue
        if p in OFF_WORDS or p.startswith(LONG_WORDS) or p.endswith(LONG_WORDS) or p.endswith("comments"):
            return 2
        if p == "author" and AUTHOR_BOXES & {*parts[i + 1 :]}:
            return 2
        if p in SOFT_WORDS and parts[-1] not in CONTENT_WORDS and not (p == "header" and CONTENT_WORDS & {*parts[:i]}):
            said = 1
    return said


def _attributes(raw: str) -> dict[str, str]:
    """Names in small letters and values; the first of equal names counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _marked(raw: str, phrase: bool = False) -> int:
    """What an element's attributes say, as ``_off_name`` does (of a phrase: 2 for adverts alone); 3 if it is hidden."""
    if not raw or "=" not in raw and "hidden" not in raw.lower():
        return 0
    found = _attributes(raw)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _NONE.search(found.get("style", "")):
        return 3
    said = (lambda n: 2 * (not PHRASE_WORDS.isdisjoint(_parts(n)))) if phrase else _off_name
    return max((said(n) for k in ("class", "id", "role") for n in found.get(k, "").split()), default=0)


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; white space is one space, references are decoded. Tags
    of phrases and void tags never end a block; a phrase that is hidden or an advert, or a button, is left out of its block."""
    out: list[Block] = []
    marks = [Landmark(0, False, False, False)]
    stack: list[tuple[str, int]] = []  # open elements: tag, landmark outside of it
    opened: Counter = Counter()  # how many of them by tag
    landmark = 0
    parts: list[str] = []
    linked, in_link, tag = 0, 0, "body"
    mute, depth = "", 0  # the phrase that is left out, and how deep it nests in itself

    def close() -> None:
        nonlocal linked, mute
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, tag, landmark, min(linked, len(text))))
        parts.clear()
        linked, mute = 0, ""

    def say(raw: str) -> None:
        nonlocal linked
        if mute:
            return
        text = html.unescape(raw)
        parts.append(text)
        if in_link:
            linked += len("".join(text.split()))

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if name in RAW_TAGS and not closing:
            if not m[0].endswith("/>"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID_TAGS and name != "hr":
            continue
        if name not in BLOCK_TAGS:  # a phrase
            if name == "a":
                in_link = 0 if closing else 1
            if mute:
                if name == mute:
                    depth += -1 if closing else 1
                    if depth == 0:
                        mute = ""
            elif not closing and not m[0].endswith("/>") and (name == "button" or _marked(m[3] or "", phrase=True)):
                mute, depth = name, 1
            continue
        close()
        in_link = 0
        if closing:
            while opened[name]:
                last, landmark = stack.pop()
                opened[last] -= 1
                if last == name:
                    break
            tag = stack[-1][0] if stack else "body"
        elif name not in VOID_TAGS and not m[0].endswith("/>"):
            if name in ("p", "li", "td", "tr", "dt", "dd") and stack and stack[-1][0] == name:
                landmark = stack.pop()[1]  # these end where the next begins
                opened[name] -= 1
            stack.append((name, landmark))
            opened[name] += 1
            tag = name
            said = _marked(m[3] or "") if name not in ("html", "body") else 0
            named = said == 3 or said > 0 and name not in ON_TAGS
            off_tag = name in OFF_TAGS and not (name == "header" and _inside_article(marks, landmark))
            if name in ON_TAGS and not named:
                k = landmark
                while k and not marks[k].holds:
                    marks[k].holds = True
                    k = marks[k].parent
            if name in ON_TAGS or off_tag or named:
                marks.append(Landmark(landmark, name in ON_TAGS and not named, said == 1 and not off_tag or name == "form" and said < 2, name == "form" or not off_tag))
                landmark = len(marks) - 1
    close()
    _settle(out, marks)
    return out


def _inside_article(marks: list[Landmark], k: int) -> bool:
    """Whether the innermost landmark is an article or main."""
    return k > 0 and marks[k].on


def _settle(found: list[Block], marks: list[Landmark]) -> None:
    """Which blocks are inside boilerplate. If every article is, landmarks that hold one and
    are boilerplate by name only (or a form) don't count; nor do weak ones where nothing else is left."""
    for lenient in (0, 1, 2):
        off, on, free = [False] * len(marks), [False] * len(marks), not any(x.on for x in marks)
        for i, x in enumerate(marks[1:], 1):
            off[i] = off[x.parent] or not x.on and not (lenient and x.soft and x.holds) and not (lenient > 1 and x.weak)
            on[i] = x.on or on[x.parent] and not off[i]
            free = free or x.on and not off[i]
        for b in found:
            b.off, b.on = off[b.landmark], on[b.landmark]
        if free and not all(b.off for b in found):
            break


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _length(words: list[str], text: str) -> float:
    """Words of a block; where signs are written without spaces, two of them are one."""
    dense = len(_DENSE.findall(text))
    return len(words) + max(0.0, dense / 2 - sum(bool(_DENSE.match(w)) for w in words)) if dense else len(words)


#: Share of a page's words that have to be in a language's list for the list to count.
LISTED = 0.12


def language(found: list[Block]) -> frozenset[str] | None:
    """The function words that the page's blocks use, if they are of a language that has a list."""
    count: Counter = Counter()
    for b in found:
        if not b.off:
            count.update(_words(b.text))
    total = count.total()
    best, share = None, LISTED
    for words in STOP_WORDS.values():
        own = sum(count[w] for w in words) / total if total else 0.0
        if own > share:
            best, share = words, own
    return best


def evidence(b: Block, stops: frozenset[str] | None, min_words: int, min_stop: float, max_link: float) -> bool | None:
    """The first pass: text, boilerplate or undecided, by length, densities and landmark. Without a list of function words a block
    has to be twice as long, or to end like a sentence."""
    letters = len("".join(b.text.split()))
    if b.off or letters and b.linked / letters > max_link or _OWNED.match(b.text) and len(b.text) < 200:
        return False
    words = _words(b.text)
    long = _length(words, b.text)
    if long < min_words:
        return None
    if stops is not None:
        return True if sum(w in stops for w in words) / max(1, len(words)) >= min_stop else None
    return True if long >= 2 * min_words or _STOP.search(b.text) else None


def classify(found: list[Block], min_words: int = 8, min_stop: float = 0.08, max_link: float = 0.4) -> None:
    """Labels every block: True is main text. Linear in the number of blocks."""
    stops = language(found)
    first = [evidence(b, stops, min_words, min_stop, max_link) for b in found]
    own, any_ = _neighbours(found, first, True), _neighbours(found, first, False)
    for i, b in enumerate(found):
        b.label = first[i]
        if b.label is not None:
            continue
        before, after = own[i]
        if before is None and after is None:
            if b.on:
                b.label = True
                continue
            before, after = any_[i]
        if b.tag in HEADINGS and after is not None:
            b.label = after[1]
        elif before is None or after is None:
            b.label = (before or after or (0, b.on))[1]
        elif before[0] != after[0]:
            b.label = min(before, after)[1]
        else:
            b.label = before[1] if before[1] == after[1] else b.on
    if not any(b.label for b in found):
        for b in _longest_run(found, first):
            b.label = True


def _longest_run(found: list[Block], first: list[bool | None]) -> list[Block]:
    """The undecided blocks in a row that hold the most text."""
    best, here, most, size = [], [], 0, 0
    for b, label in zip(found, first, strict=True):
        if label is None:
            here.append(b)
            size += len(b.text)
            if size > most:
                best, most = here, size
        else:
            here, size = [], 0
    return best


def _neighbours(found: list[Block], first: list[bool | None], same: bool) -> list[tuple]:
    """For each block the nearest decided ones before and after it that are not inside boilerplate, as (distance, label);
    ``same``: of the same landmark."""
    sides = []
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict[int, tuple[int, bool]] = {}
        side: list[tuple[int, bool] | None] = [None] * len(found)
        for i in order:
            k = found[i].landmark if same else 0
            if k in last:
                side[i] = (abs(i - last[k][0]), last[k][1])
            if first[i] is not None and not found[i].off:
                last[k] = (i, first[i])
        sides.append(side)
    return list(zip(*sides, strict=True))


def main_text(page: str) -> str:
    found = blocks(page)
    classify(found)
    return "\n".join(b.text for b in found if b.label)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Null html is empty and gives an
    empty text; repeated rows, null ids and null urls stay as they are; an empty table gives an empty result;
    other columns are ignored. Pages cut off in a tag, comment or script lose that part alone."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    schema = C.struct(C.id_field(src, "page_id"), C.id_field(src, "url"), ("text", "string"), ("n_chars", "bigint"))
    arrow = C.arrow_schema(schema)

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=arrow)

    return C.map_batches(src, run, schema)
