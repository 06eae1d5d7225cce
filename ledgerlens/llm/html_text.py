"""HTML extraction by two passes of block rules.

A page is cut into blocks at block-level tags.  Pass one classifies a block by
its region, length, link density and stop-word density as good, bad, nearly
good or short; pass two gives the undecided ones the label of their nearest
decided neighbours.  Regions come from the open elements: an ``article`` or
``main`` holds content, a ``nav``, ``aside``, ``footer``, form, advert, notice
or comment section does not, and is dropped.  The blocks of marked content and
those outside it are classified alike but for this: inside, few stop words or a
single link leave a block undecided, lists of links are bad, and undecided blocks
look to their own neighbours inside.  Unmarked prose outside content is kept.

The stop-word lists serve four languages.  On a page without marked content whose
long unlinked blocks mostly have few of these words, length and links alone decide,
and one such block among prose looks to its neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a block below SHORT code points says little by itself; one above LONG with many stop words is prose
SHORT, LONG = 70, 200
#: shares of stop words and of linked characters
STOP_LOW, STOP_HIGH, LINKED = 0.06, 0.12, 0.3
#: in content: the share of linked characters that is no text, and the linked blocks in a row that make a list
LINK_LIST, MANY = 0.7, 3

#: letters of scripts that write a word in one or two of them; one counts for WIDE code points
WIDE_LETTER, WIDE = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff]"), 3

#: frequent function words of the languages served
STOP_WORDS = {
    "en": "the of and to in a is that for it on as with was be by at this are from or an not have but which they you",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er",
    "fr": "le la les de des et en un une du que qui dans pour pas au sur est il elle par ce ne se plus avec sont",
    "es": "el la los las de del y en un una que por con para es no se su al lo como más pero sus o este ha mi",
}
STOPS = [frozenset(w.split()) for w in STOP_WORDS.values()]

BLOCK_TAGS = frozenset((
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead title tr ul").split())
VOID = frozenset(["hr"])
#: elements whose end tags are often left out: a block starts, only those marked as around are tracked
LOOSE = frozenset("p li dt dd tr td th option optgroup hr thead tbody tfoot".split())
_ROW, _TABLE = {"tr", "td", "th", "p"}, {"thead", "tbody", "tfoot", "tr", "td", "th", "p"}
#: loose elements that end with the start or the end of one, and those that only its start ends
ENDED = ({"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": _ROW, "option": {"option"},
          "optgroup": {"option", "optgroup"}, "hr": {"p"}}
         | dict.fromkeys(("dt", "dd"), {"dt", "dd", "p"}) | dict.fromkeys(("thead", "tbody", "tfoot"), _TABLE))
#: elements beyond which a loose element is not ended
HOLDERS = frozenset("ul ol menu dl table select".split())
RAW = "script|style|noscript|template|textarea|svg|math|iframe|object|canvas|audio|video"

#: elements and the words in class, id or role that mark text around an article
AROUND = frozenset("head title aside footer select dialog menu button".split())
SOFT_AROUND = frozenset("nav header form".split())
CONTENT = frozenset("article main".split())
AROUND_WORDS = frozenset((
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations comment comments reply replies respond disqus discussion breadcrumb breadcrumbs menu "
    "nav navbar navigation footer pager pagination widget widgets toolbar copyright complementary contentinfo search hidden").split())
#: a name marks text around an article if it is made of these and at least one of the words above
FORM_WORDS = frozenset((
    "area bar block body bottom box button buttons btn card cards column col container count counter cta entry first form google group "
    "head header heading icon icons info inner item items label last law leaderboard left link links list main media outer page panel "
    "policy post posts primary rectangle right row secondary section site slot small sticky text this title top trail unit wrap wrapper "
    "zone").split())
#: words that mark a part for good; others may stand on a wrapper of the whole page
FINAL_WORDS = frozenset((
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr comment comments reply replies "
    "respond disqus").split())
NAMED = -3

ATTRIBUTES = r"""(?:[^>"']++|"[^"<]*"|'[^'<]*'|["'])*+"""
#: comments, drawings closed in themselves, raw elements, tags (custom names whole), declarations, text
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/>]){ATTRIBUTES}(?<=/)>|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:_.-]*)({ATTRIBUTES})(?:>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]++|<",
    re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
HIDDEN_NAME = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
QUOTED = re.compile(r"""\"[^\"]*\"|'[^']*'""")
PART = re.compile(r"[a-z0-9]+")
SIZE = re.compile(r"[0-9]+(?:x[0-9]+)?")


@lru_cache(maxsize=10_000)
def _marked(name: str) -> int:
    """Whether a whole class, id or role marks text around an article: 2 for good."""
    words = PART.findall(name)
    if not AROUND_WORDS.intersection(words) or any(w not in AROUND_WORDS and w not in FORM_WORDS and not SIZE.fullmatch(w) for w in words):
        return 0
    return 2 if FINAL_WORDS.intersection(words) else 1


def _region(tag: str, attributes: str, inside: int) -> tuple[int, bool]:
    """0: as around; 1: content; -1: around the article, for good; -2: around it
    unless content opens inside; NAMED: around it by name, unless ``main`` opens
    inside.  And whether it may be a wrapper of the page after all."""
    if tag in ("html", "body"):
        return 0, False
    if attributes:
        if HIDDEN.search(attributes) or HIDDEN_NAME.search(QUOTED.sub('""', attributes)):
            return -1, False
        if tag not in CONTENT:
            found = [_marked(w) for x in NAMES.findall(attributes) for w in x.strip("\"'").lower().split()]
            if any(found) and tag not in AROUND:
                return NAMED, max(found) == 1
    if tag in CONTENT:
        return 1, False
    if tag in AROUND:
        return -1, False
    return (-2, tag == "form") if tag in SOFT_AROUND and not (tag == "header" and inside == 1) else (0, False)


def blocks(html: str) -> list[tuple[str, int, float, int]]:
    """(text, linked characters, is a heading, region) of the blocks that have
    text; the region is 1 in content, 0 elsewhere, -1 around an article.

    Where no prose is left otherwise, a form or an element around by its name that
    holds more than half of the page's prose is a wrapper, and read once more
    without its mark."""
    found, marks = _parse(html, frozenset())
    if marks and not any(first_pass(*b) in (("good", "near") if b[3] == 1 else ("good",)) for b in found if b[3] >= 0):
        prose = [0]
        for text, linked, heading, _ in found:
            prose.append(prose[-1] + (len(text) if first_pass(text, linked, heading, 0) in ("good", "near") else 0))
        wrappers = frozenset(at for at, (a, b) in marks.items() if 2 * (prose[b] - prose[a]) > prose[-1])
        if wrappers:
            found, _ = _parse(html, wrappers)
    return found


def _parse(html: str, wrappers: frozenset[int]) -> tuple[list[tuple[str, int, bool, int]], dict[int, tuple[int, int]]]:
    """The blocks, and for the place of every possible wrapper its first block and
    the one after its last.  Those in ``wrappers`` leave the region as it is."""
    out: list[tuple[str, int, bool, int]] = []
    open_tags: list[tuple[str, int, int | None]] = []
    marks: dict[int, tuple[int, int]] = {}
    region, parts, linked, in_link, heading, breaks = 0, [], 0, 0, False, 0
    loose = 0                                                      # marked loose elements that are open

    def close() -> None:
        nonlocal parts, linked, breaks
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((text, linked, heading, max(region, -1)))
        parts, linked, breaks = [], 0, 0

    def leave(i: int) -> None:
        nonlocal region, loose
        region = open_tags[i][1]                                   # as it was outside
        for name, _, at in open_tags[i:]:
            loose -= name in LOOSE
            if at is not None:
                marks[at] = marks[at][0], len(out)
        del open_tags[i:]

    def end_loose(tag: str, ends: bool) -> None:
        """Restore the region around the marked loose elements that this tag ends."""
        which = ENDED.get(tag) or (set() if ends else {"p"})       # a paragraph ends where any block starts
        cut = None
        for i in range(len(open_tags) - 1, -1, -1):
            name = open_tags[i][0]
            if name in which:
                cut = i
            elif name in HOLDERS or which == {"p"}:
                break
        if cut is not None:
            leave(cut)

    for m in TOKEN.finditer(html):
        token = m[0]
        if token[0] != "<" or token == "<":
            parts.append(token)
            if breaks and not token.isspace():
                breaks = 0
            if in_link:
                linked += len(" ".join(token.split()))
            continue
        if m[3] is None:
            continue                                               # comment, raw element, declaration
        tag, ends = m[3].lower(), bool(m[2])
        if tag == "a":
            in_link = 0 if ends else 1
        elif tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                close()
        elif tag in BLOCK_TAGS or tag == "button":
            close()
            heading, in_link = not ends and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit(), 0
            if loose:
                end_loose(tag, ends)
            if tag in LOOSE and (ends or not m[4] or _region(tag, m[4], region)[0] not in (-1, NAMED)):
                continue
            if ends:
                for i in range(len(open_tags) - 1, -1, -1):
                    if open_tags[i][0] == tag:
                        leave(i)
                        break
            elif tag not in VOID:
                new, may_wrap = _region(tag, m[4], region)
                at = m.start() if may_wrap and region != -1 else None
                if at in wrappers:
                    new, at = 0, None
                if at is not None:
                    marks[at] = len(out), len(out)
                open_tags.append((tag, region, at))
                loose += tag in LOOSE
                if tag == "body":
                    region = 0
                elif new and region != -1 and (region != NAMED or new == -1 or tag == "main"):
                    region = new
    close()
    if open_tags:
        leave(0)
    return out, marks


def extent(text: str) -> int:
    """Length of a text, as Latin letters would take it."""
    return len(text) if text.isascii() else len(text) + (WIDE - 1) * len(WIDE_LETTER.findall(text))


def stop_density(text: str) -> float:
    words = [w.strip(".,;:!?()\"'").lower() for w in text.split()]
    return max(sum(map(stops.__contains__, words)) for stops in STOPS) / len(words)


def first_pass(text: str, linked: int, heading: bool, region: int) -> str:
    if region < 0:
        return "bad"
    if linked / len(text) > LINKED:
        if region == 1 and (heading or len(text) < SHORT):
            return "short"                                         # a by-line, or an entry of a list of links
        if region == 1 and linked / len(text) < LINK_LIST and stop_density(text) >= STOP_HIGH:
            return "near"                                          # prose with many links
        return "short" if region == 1 and linked / len(text) < LINK_LIST else "bad"
    if extent(text) < SHORT:
        return "short" if region == 1 or heading or not linked else "bad"
    density = stop_density(text)
    if density >= STOP_HIGH:
        return "good" if extent(text) > LONG else "near"
    if density >= STOP_LOW:
        return "near"
    return "short" if region == 1 else "bad"


def extract(html: str | None) -> str:
    """Main text of a page: its good blocks in order, one a line.

    All blocks that are not in a region around an article go through both
    passes.  Marked content is one piece of evidence: its undecided blocks look
    to each other only, and win a tie; those outside it are held by prose outside
    it alone.  A heading follows the text below it."""
    found = [b for b in blocks(html or "") if b[3] >= 0]
    inside = [b for b in found if b[3] == 1]
    kept = second_pass(inside, True)
    kept_outside = second_pass([b for b in found if b[3] == 0], not any(kept))
    both = {1: iter(kept), 0: iter(kept_outside)}
    return "\n".join(b[0] for b in found if next(both[b[3]]))


def second_pass(found: list[tuple[str, int, bool, int]], trusted: bool) -> list[bool]:
    """Whether each block is kept.  Where nothing is decided the blocks are, if
    they are the page's content or none is kept there (``trusted``)."""
    kinds = [first_pass(*b) for b in found]
    content = bool(found) and found[0][3] == 1
    if not content and trusted:
        _other_languages(found, kinds)
    if content:
        _link_lists(found, kinds)
        if "good" not in kinds:                                    # short texts, or a language without stop words here
            kinds = ["good" if k == "near" or k == "short" and len(b[0]) >= SHORT and b[1] / len(b[0]) <= LINKED else k
                     for b, k in zip(found, kinds)]
        if "good" not in kinds:
            kinds = ["good" if k == "short" else k for k in kinds]
    before, after = _decided(kinds), [len(kinds) - 1 - x if x is not None else None for x in _decided(kinds[::-1])][::-1]
    keep = []
    for i, kind in enumerate(kinds):
        if kind in ("short", "near"):
            a, b = before[i], after[i]
            if a is None and b is None:
                kind = "good" if trusted else "bad"                # nothing is decided around it
            elif content and found[i][2] and a is None:
                kind = "good"                                      # the heading that opens the content
            elif a is None or b is None or kinds[a] == kinds[b]:
                kind = kinds[b if a is None else a]
            elif found[i][2]:
                kind = kinds[b]
            else:
                kind = kinds[a] if i - a < b - i else kinds[b] if i - a > b - i else "good" if kind == "near" or content else "bad"
        keep.append(kind == "good")
    return keep


def _other_languages(found: list[tuple[str, int, bool, int]], kinds: list[str]) -> None:
    """Without marked content: long unlinked blocks with few stop words are prose
    where they are most of the page's long unlinked text; elsewhere those with next
    to none are undecided.  Where no block is good then, those nearly good are."""
    long = [(i, extent(b[0])) for i, b in enumerate(found) if b[1] / len(b[0]) <= LINKED and extent(b[0]) >= SHORT]
    few = [(i, n) for i, n in long if kinds[i] == "bad" or kinds[i] == "near" and stop_density(found[i][0]) < STOP_HIGH]
    other = 2 * sum(n for _, n in few) > sum(n for _, n in long)
    for i, n in few:
        if other:
            kinds[i] = "good" if n > LONG else "near"
        elif kinds[i] == "bad":
            kinds[i] = "short"
    if "good" not in kinds:
        kinds[:] = ["good" if k == "near" else k for k in kinds]


def _link_lists(found: list[tuple[str, int, bool, int]], kinds: list[str]) -> None:
    """In content, MANY blocks in a row that are links for the most part are a list
    of links: bad.  References, which name authors and years beside the link, stay."""
    row: list[int] = []
    for i, (text, linked, heading, _) in enumerate([*found, ("", 0, True, 1)]):
        if not heading and linked / len(text) >= LINK_LIST and kinds[i] != "near":
            row.append(i)
            continue
        if len(row) >= MANY:
            for k in row:
                kinds[k] = "bad"
        row = []


def _decided(kinds: list[str]) -> list[int | None]:
    """For every block the last one before it that is good or bad."""
    out, last = [], None
    for i, kind in enumerate(kinds):
        out.append(last)
        if kind in ("good", "bad"):
            last = i
    return out


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row.  Null or empty html gives an
    empty text; rows with equal identifiers each get their row; pages are read
    whole, in Arrow batches, without a shuffle."""
    small = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    from pyspark.sql import types as T

    schema = T.StructType([*small.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return small.mapInArrow(run, schema)
