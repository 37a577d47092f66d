"""Main text of HTML pages by a maximum-scoring subsequence.

A page becomes a sequence of words and tags. Words score above zero and tags
below it, with weights fitted to labelled pages (``labelled_pages`` writes them,
``fit`` takes the log odds of each kind of token inside against outside the main
text); one linear scan finds the contiguous region with the largest sum. Before
the scan, what no reader takes for the article (scripts, styles, menus, headers,
footers, sidebars, forms, adverts, notices, reader comments, by element or by
words in class, id or role) is marked: each such part scores like one tag, so
that the region bridges an advert inside an article but doesn't start or end in
a menu, and its text is never returned. Tags without text between them score
RUN at least, so that nested empty containers cost no more than an advert. The
region is then rounded to whole blocks, and to the ``article`` or ``main``
element that holds it.

Null and empty pages, and pages without words, give an empty text. Of regions
with equal sums the first counts. Repeated rows are each extracted; an empty
table gives an empty table. Only the named columns are read, so that no other
column can clash. Markup that is cut off or never closed is read up to the
page's end; pages of any length take time in proportion to it.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import lru_cache
from math import log

from pyspark.sql import DataFrame

from .common import load, map_rows

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
#: Elements by what they do.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style textarea title noscript template iframe xmp noembed noframes head nav header footer aside form button select option svg math canvas object audio video dialog menu input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Words in class or id that mark what is not the article.
HINTS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus dropdown footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted reader recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
KEEP = frozenset("article body content entry main post story text".split())
#: Elements that a new block of the same kind closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKY = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul p".split())
ATTR = re.compile(r"([a-zA-Z:-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
SPACE = re.compile(r"\s+")
NAMES = re.compile(r"[a-z]+")


@lru_cache(maxsize=4096)
def unwanted(name: str, attributes: str) -> bool:
    if name in DROPPED:
        return True
    low = attributes.lower()
    if not low.strip() or name in ("html", "body", "main", "article"):
        return False
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*.?true|display\s*:\s*none", low):
        return True
    for key, value in ATTR.findall(low):
        value = value.strip("\"'")
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id"):
            for part in value.split():
                names = NAMES.findall(part)
                if HINTS.intersection(names) and not (len(names) > 1 and KEEP.intersection(names[-1:]) and names[0] in ("post", "entry", "article")):
                    return True
    return False


def sequence(page: str) -> list[tuple[str, str, bool]]:
    """(kind, value, dropped): kind is text, open, close or gap (a block's edge)."""
    out: list[tuple[str, str, bool]] = []
    stack: list[tuple[str, bool]] = []
    at, raw, n = 0, "", len(page)
    while at < n:
        if raw:
            m = re.compile(rf"</{re.escape(raw)}(?=[\s/>])", re.I).search(page, at)
            if not m:
                break
            at, raw = m.start(), ""
        m = TOKEN.search(page, at)
        bad = bool(stack) and stack[-1][1]
        if (text := page[at : m.start() if m else n]).strip():
            cut = re.search(r"<[a-zA-Z/!][^>]*\Z", text) if not m else None
            out.append(("text", text[: cut.start()] if cut else text, bad))
        elif text:
            out.append(("text", " ", bad))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        attributes = m[3] or m[6] or ""
        if m[1] or m[4]:
            while any(x[0] == name for x in stack) and stack.pop()[0] != name:
                pass
            out.append(("close", name, bad))
            continue
        if name in BLOCKY:
            while stack and stack[-1][0] == "p":
                stack.pop()
        ends = CLOSES.get(name, ())
        while ends and stack and stack[-1][0] in ends:
            stack.pop()
        bad = (bool(stack) and stack[-1][1]) or unwanted(name, attributes)
        out.append(("open", name, bad))
        if name not in VOID and not attributes.rstrip().endswith("/"):
            stack.append((name, bad))
            if name in RAW:
                raw = name
    return out


#: Kinds of tokens that have a weight of their own, and the elements of each kind of tag.
GROUPS = {"p": "p br", "head": "h1 h2 h3 h4 h5 h6", "item": "li dt dd", "list": "ul ol dl", "cell": "td th", "table": "table thead tbody tfoot tr caption", "quote": "blockquote pre figure figcaption img hr"}
KIND = {name: kind for kind, names in GROUPS.items() for name in names.split()}
KINDS = ("word", "linked", "dropped", "block", "inline", "a", *GROUPS)
#: The least that tags without text between them score together, and the most that a tag does.
RUN, MOST = -3.0, -0.05


def kinds(tokens: list[tuple[str, str, bool]]) -> list[tuple[str, int]]:
    """The kind of each token and how often it counts; a dropped part counts once, however long."""
    out, inside, links = [], False, 0
    for kind, value, bad in tokens:
        if bad:
            out.append(("dropped", 0 if inside else 1))
        elif kind == "text":
            out.append(("linked" if links > 0 else "word", len(value.split())))
        else:
            out.append(("a" if value == "a" else KIND.get(value) or ("inline" if value in INLINE else "block"), 1))
        if value == "a" and kind != "text":
            links = 1 if kind == "open" else 0
        elif kind != "text" and value in BLOCKY:
            links = 0
        inside = bad
    return out


def scores(tokens: list[tuple[str, str, bool]], weights: dict[str, float]) -> list[float]:
    """Each token's score."""
    out, run = [], 0.0
    for (kind, n), (what, _, bad) in zip(kinds(tokens), tokens, strict=True):
        x = weights[kind] * n
        if what == "text" and not bad:
            run = 0.0 if n else run
        elif not bad:
            x = max(x, RUN - run)
            run += x
        out.append(x)
    return out


def region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous part with the largest sum; (0, 0) if none is above 0."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, found = total, (start, i + 1)
    return found


def fit(labelled: list[tuple[str, str]]) -> dict[str, float]:
    """Weights from (html, main text) pairs: log odds of each kind of token inside against outside the main text, scaled so that a word has 1."""
    counts = {k: [1.0, 1.0] for k in KINDS}
    for page, truth in labelled:
        tokens = sequence(page or "")
        flat = " ".join(truth.split())
        marks = [k == "text" and bool(v.strip()) and not bad and " ".join(entities.unescape(v).split()) in flat for k, v, bad in tokens]
        # the first and last pieces of the main text that stand there in order
        lo, hi = (marks.index(True), len(marks) - marks[::-1].index(True)) if any(marks) else (0, 0)
        for i, (kind, n) in enumerate(kinds(tokens)):
            counts[kind][not lo <= i < hi] += n
    inside, outside = (sum(c[k] for c in counts.values()) for k in (0, 1))
    odds = {k: log(c[0] / inside) - log(c[1] / outside) for k, c in counts.items()}
    unit = max(odds["word"], 0.1)
    return {k: 1.0 if k == "word" else min(1.0, x / unit) if k == "linked" else min(MOST, x / unit) for k, x in odds.items()}


def labelled_pages(n: int = 300, seed: int = 11) -> list[tuple[str, str]]:
    """(html, main text) pairs: articles of paragraphs, lists, links, tables, figures and quotes, some with adverts inside, in several containers, among menus, notices, comments and link lists with and without telling names."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(900)]

    def words(lo: int, hi: int) -> str:
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randint(lo, hi)))

    def inline(text: str) -> str:
        own = text.split(" ")
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(own))
            own[i] = rng.choice(("<b>%s</b>", "<em>%s</em>", '<a href="/x">%s</a>', "%s<br>")) % own[i]
        return " ".join(own)

    def several(k: int, lo: int, hi: int) -> list[str]:
        return [words(lo, hi) for _ in range(k)]

    def part() -> tuple[str, list[str]]:
        x = rng.random()
        if x < 0.55:
            text = words(1, 6) if rng.random() < 0.2 else words(8, 60)
            return f"<p>{inline(text)}</p>", [text]
        if x < 0.65:
            own = several(rng.randint(2, 6), 1, 9)
            return "<ul>" + "".join(f"<li>{rng.choice((w, inline(w)))}</li>" for w in own) + "</ul>", own
        if x < 0.75:
            own = several(rng.choice((4, 6, 8)), 1, 2)
            rows = "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in zip(own[::2], own[1::2], strict=True))
            return f"<table>{rows}</table>", own
        if x < 0.82:
            text = words(2, 6)
            return f'<figure><img src="/i.png"><figcaption>{text}</figcaption></figure>', [text]
        if x < 0.88:
            text = words(5, 30)
            return f"<blockquote>{text}</blockquote>", [text]
        if x < 0.94:
            text = words(2, 5)
            return f"<h2>{text}</h2>", [text]
        return rng.choice((f'<div class="ad">{words(3, 40)}</div>', '<div><div><div><img src="/i.png"></div></div></div>', "<script>x</script>")), []

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in several(k, 1, 2)) + "</ul>"

    out = []
    for _ in range(n):
        head = words(1, 8)
        parts = [(f"<h1>{head}</h1>", [head]), *(part() for _ in range(rng.randint(1, 9))), (f"<p>{(last := words(10, 40))}</p>", [last])]
        body = "".join(x for x, _ in parts)
        holder = rng.choice(("<article>%s</article>", "<main>%s</main>", '<div id="content">%s</div>', "<section>%s</section>", "%s"))
        around = lambda: rng.choice(("", f"<nav>{links(5)}</nav>", f"<div>{links(6)}</div>", f'<div class="notice">{words(3, 20)}</div>', f"<aside><p>{words(5, 30)}</p></aside>"))
        behind = lambda: rng.choice(("", f"<footer>{words(2, 12)}</footer>", f"<div>{links(6)}</div>", f'<section class="comments"><p>{words(5, 60)}</p></section>', f'<div class="related">{links(4)}</div>'))
        page = f"<html><head><title>{head}</title></head><body><header>{words(1, 4)}</header>{around()}{around()}{holder % body}{behind()}{behind()}</body></html>"
        out.append((page, " ".join(w for _, own in parts for w in own)))
    return out


@lru_cache(maxsize=1)
def fitted() -> tuple[tuple[str, float], ...]:
    """The weights that the labelled pages give; found once in a session."""
    return tuple(fit(labelled_pages()).items())


#: What the region grows over at its edges, and dropped elements that it may hop.
EDGE = frozenset("p h1 h2 h3 h4 h5 h6 br hr img li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption".split())
HOPPED = frozenset("div ins span p iframe script style noscript form button svg".split())


def grown(tokens: list[tuple[str, str, bool]], lo: int, hi: int) -> tuple[int, int]:
    """The region with what of its blocks it cuts off, and of the ``article`` or ``main`` that holds it."""
    if lo >= hi:
        return lo, hi

    def joins(x: tuple[str, str, bool]) -> bool:
        return not x[2] and (x[0] == "text" or x[1] in INLINE or x[1] in EDGE)

    def reach(at: int, step: int) -> int:
        """The last token that joins, going by step from the one at the edge."""
        last = at
        while 0 <= at + step < len(tokens):
            at += step
            if tokens[at][2]:
                start = at
                while 0 <= at + step < len(tokens) and tokens[at + step][2]:
                    at += step
                outer = tokens[start if step > 0 else at]
                if outer[0] != "open" or outer[1] not in HOPPED:
                    break
            elif joins(tokens[at]):
                last = at
            else:
                break
        return last

    lo, hi = reach(lo, -1), reach(hi - 1, 1) + 1
    opened: list[int] = []
    best = None
    for i, (kind, value, bad) in enumerate(tokens):
        if kind == "text" or bad or value not in ("article", "main"):
            continue
        if kind == "open":
            opened.append(i)
        elif opened:
            start = opened.pop()
            if start <= lo and hi <= i + 1 and best is None:
                best = (start, i + 1)
    if best is None and opened and opened[-1] <= lo:
        best = (opened[-1], len(tokens))
    return best or (lo, hi)


def extract(page: str | None, weights: dict[str, float] | None = None) -> str:
    if not page:
        return ""
    tokens = sequence(page)
    lo, hi = grown(tokens, *region(scores(tokens, weights or dict(fitted()))))
    parts: list[str] = []
    for kind, value, bad in tokens[lo:hi]:
        if kind == "text" and not bad:
            parts.append(entities.unescape(value) if "&" in value else value)
        elif kind != "text" and value not in INLINE:
            parts.append(" ")
    return " ".join("".join(parts).split())


def extract_pages(pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Per row: id, url, text, n_chars (code points)."""
    own = weights or dict(fitted())

    def row(_, key: int, url: str | None, page: str | None) -> tuple:
        text = extract(page, own)
        return key, url, text, len(text)

    return map_rows(pages, [id_col, url_col, html_col], row, f"{id_col} long, {url_col} string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(load(spark, sf_dir, "pages"))
