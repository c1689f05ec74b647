"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags. Each block has features
of its ancestors (tags, words of their class, id and role) and of its text (length, share inside
links, punctuation, place on the page). The field has a weight per feature and label and weights
for pairs of neighbouring labels; it is fitted by maximum likelihood on labelled pages, which are
few and bounded (``labelled_pages``), and decoded by Viterbi. Extraction is a map over pages:
the model (about 100 kB) is broadcast, nothing is shuffled, and batches of pages are decoded together.

Character references are decoded, white space in a block becomes one space, blocks are joined by
one newline in page order; nothing else is dropped. Not shown, and so no block: comments, script,
style, textarea and iframe up to their end or the page's, as browsers read them; template
and svg with an end tag; title, select, option, button and datalist. A null or empty page, or one without a content
block, has an empty text. Unclosed and stray tags are accepted: a head ends with the first tag or text that
is not allowed in it, a button or title without an end tag with the next block-level tag; a tag ends at the next
``>`` if its quotes are never closed. Pages of any length are read whole, in time in proportion to their
length: an element keeps only the features that its ancestors lack, and the weights of a block's ancestors are
sums that are carried from element to element. Repeated pages give equal rows; an
empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import html as html_module
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag, up to the ``>`` outside quoted values; and one whose quotes are never closed.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Read as text by browsers, up to the end tag or the end of the page.
RAW = frozenset("script style textarea iframe".split())
#: Left out if there is an end tag.
SKIPPED = frozenset("template svg".split())
ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW | SKIPPED}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("head title select option button datalist".split())
#: Hidden elements with a required end tag: their next start or end.
ENDED = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in ("title", "select", "button", "datalist")}
#: Tags whose start ends an open element of the same kind.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
NO_CLOSES = {"p"}
TAG_START = re.compile(r"</?[a-zA-Z]")
#: Tags that may start inside a head; any other start ends it.
IN_HEAD = frozenset("base link meta title style script noscript template".split())
#: Blocks that are decoded at once, padding included.
MOST_BLOCKS = 100_000
BITS = 13
LABELS = 2


def ended(page: str, tag: str, at: int) -> bool:
    """Whether an end tag follows before the next start of the same kind, which cannot be inside."""
    m = ENDED[tag].search(page, at)
    return m is not None and m.group(1) == "/"


class Path:
    """Features of an element that its ancestors lack, and those ancestors that have others."""

    __slots__ = ("above", "depth", "new")

    def __init__(self, new: list[int], above: Path | None):
        self.new, self.above, self.depth = new, above, above.depth + 1 if above else 1


class Element:
    """An open element: its tag, the features of its own, and its path. ``active`` has the features of all open elements."""

    __slots__ = ("ended", "new", "own", "path", "tag")

    def __init__(self, tag: str, words: list[str], above: Path | None, ended: bool, active: set[int]):
        self.tag, self.ended = tag, ended
        self.own = frozenset([feature(f"own:{tag}"), *[feature(f"own-attr:{w}") for w in words]])
        self.new = [i for i in {feature(f"in:{tag}"), *[feature(f"attr:{w}") for w in words]} if i not in active]
        self.path = Path(self.new, above) if self.new else above
        active.update(self.new)


def leaf_blocks(page: str) -> list[tuple[str, list[int]]]:
    """Text and feature ids of each leaf block, in page order."""
    cut = cut_blocks(page)
    return [(t, features(t, share, at, k, len(cut))) for k, (t, share, at) in enumerate(cut)]


def labelled_blocks(page: str) -> list[tuple[str, list[int], int]]:
    """Text, features and label of each block of a labelled page; the label is taken off the text."""
    cut = [(t[1:], share, at, int(t[0])) for t, share, at in cut_blocks(page) if len(t) > 1]
    return [(t, features(t, share, at, k, len(cut)), y) for k, (t, share, at, y) in enumerate(cut)]


def cut_blocks(page: str) -> list[tuple[str, float, tuple]]:
    """Text, share of it inside links, and place of each leaf block: its element, and whether it begins in a link."""
    stack: list[Element] = []
    opened: dict[str, int] = {}  # open elements by tag
    hidden = 0  # open elements that are not shown
    unended: int | None = None  # depth of the outermost hidden element without an end tag
    link: int | None = None  # depth at which a link was opened
    out: list[tuple[str, float, tuple]] = []
    text: list[str] = []
    linked, at = 0, (None, False)
    active: set[int] = set()  # features of open elements
    missing: set[str] = set()  # tags without an end tag in the rest of the page
    last, tags = page.rfind(">"), TAG

    def cut(depth: int) -> None:
        nonlocal hidden, unended, link
        for e in stack[depth:]:
            opened[e.tag] -= 1
            hidden -= e.tag in HIDDEN
            active.difference_update(e.new)
        del stack[depth:]
        if unended is not None and unended >= depth:
            unended = None
        if link is not None and link > depth:
            link = None

    def add(run: str) -> None:
        nonlocal linked, at
        if stack and stack[-1].tag == "head" and not run.isspace():
            cut(len(stack) - 1)
        if hidden:
            return
        if not text:
            at = (stack[-1] if stack else None, link is not None)
        text.append(run)
        if link is not None:
            linked += len(run)

    def flush() -> None:
        nonlocal text, linked
        if text:
            raw = "".join(text)
            joined = " ".join(html_module.unescape(raw).split())
            if joined:
                out.append((joined, linked / len(raw), at))
        text, linked = [], 0

    pos, size = 0, len(page)
    while pos < size:
        start = page.find("<", pos)
        if start < 0 or start > last:
            add(page[pos:] if start < 0 or not page.startswith("<!--", start) else page[pos:start])
            break
        if start > pos:
            add(page[pos:start])
        follow = page[start + 1 : start + 2]
        if follow == "!" or follow == "?":
            comment = page.startswith("<!--", start)
            end = page.find("-->", start + 2) if comment else page.find(">", start)
            pos = size if end < 0 else end + (3 if comment else 1)
            continue
        m = tags.match(page, start)
        if m is None and tags is TAG and TAG_START.match(page, start):
            tags = LOOSE_TAG
            m = tags.match(page, start)
        if m is None:
            add("<")
            pos = start + 1
            continue
        pos = m.end()
        close, tag, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if tag in ENDS and not close:
            if tag == "svg" and attributes.endswith("/"):
                end = m
            else:
                end = None if tag in missing else ENDS[tag].search(page, pos)
            if end is None:
                missing.add(tag)
            if end is not None or tag in RAW:
                if text:
                    text.append(" ")
                pos = end.end() if end is not None else size
            continue
        if not close:
            if tag == "body" and opened.get("head"):
                cut(next(k for k, e in enumerate(stack) if e.tag == "head"))
            elif stack and stack[-1].tag == "head" and tag not in IN_HEAD:
                cut(len(stack) - 1)
        if tag == "br":
            if text:
                text.append("\n")
        elif tag == "a":
            link = None if close else len(stack)
        elif tag in INLINE:
            continue
        else:
            flush()
            if tag in VOID:
                continue
            if close:
                if opened.get(tag):
                    depth = len(stack) - 1
                    while stack[depth].tag != tag:
                        depth -= 1
                    cut(depth)
                continue
            if unended is not None and tag not in ("option", "optgroup"):
                cut(unended)
            ends = CLOSES.get(tag, NO_CLOSES)
            while stack and stack[-1].tag in ends:
                cut(len(stack) - 1)
            words: list[str] = []
            if attributes:
                for x in ATTRIBUTE.finditer(attributes):
                    words += WORD.findall((x.group(1) or x.group(2) or x.group(3) or "").lower())
            has_end = tag not in ENDED or ended(page, tag, pos)
            if not has_end and unended is None:
                unended = len(stack)
            stack.append(Element(tag, words, stack[-1].path if stack else None, has_end, active))
            opened[tag] = opened.get(tag, 0) + 1
            hidden += tag in HIDDEN
    flush()
    return out


@lru_cache(1 << 16)
def feature(name: str) -> int:
    h = 2166136261
    for b in name.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) & ((1 << BITS) - 1)


def own_features(text: str, link_share: float, at: tuple, k: int, n: int) -> set[int]:
    words = text.count(" ") + 1
    names = {"bias", f"words:{min(words.bit_length(), 8)}", f"links:{0 if link_share == 0 else 1 if link_share < 0.4 else 2 if link_share < 0.8 else 3}"}
    names.add(f"end:{text[-1] if text[-1] in '.!?:;' else 'letter' if text[-1].isalnum() else 'other'}")
    names.add(f"stops:{min(sum(text.count(c) for c in '.!?'), 4)}")
    names.add(f"commas:{min(text.count(','), 3)}")
    if "©" in text or "opyright" in text:
        names.add("copyright")
    names.add(f"place:{0 if k * 10 < n else 2 if (k + 1) * 10 > 9 * n else 1}")
    element, in_link = at
    if in_link:
        names |= {"own:a", "in:a"}
    elif element is None:
        names.add("own:none")
    own = {feature(x) for x in names}
    return own if in_link or element is None else own | element.own


def path_features(element: Element | None) -> list[int]:
    path, out = element.path if element else None, []
    while path:
        out += path.new
        path = path.above
    return out


def features(text: str, link_share: float, at: tuple, k: int, n: int) -> list[int]:
    """All features of block k of n: its own, and those of its ancestors."""
    return [*own_features(text, link_share, at, k, n).union(path_features(at[0]))]


class Field:
    """Weights of a fitted field."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray, stop: np.ndarray):
        self.emit, self.move, self.start, self.stop = emit, move, start, stop

    def scores(self, pages: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores padded to the longest page (pages, blocks, labels), and page lengths."""
        sizes = np.array([len(p) for p in pages], np.int64)
        blocks = [b for p in pages for b in p]
        out = np.zeros((len(pages), max(int(sizes.max()) if len(sizes) else 0, 1), LABELS))
        if blocks:
            counts = np.array([len(b) for b in blocks])
            flat = np.fromiter((i for b in blocks for i in b), np.int64, int(counts.sum()))
            mask = np.arange(out.shape[1]) < sizes[:, None]
            out[mask] = np.add.reduceat(self.emit[flat], np.cumsum(counts) - counts, axis=0)
        return out, sizes

    def page_scores(self, cut: list[tuple[str, float, tuple]]) -> np.ndarray:
        """Emission scores of a page's blocks. From block to block only the paths that end and begin are looked at, so
        the time does not depend on how deep the page is."""
        sums: list[tuple[float, float]] = [(0.0, 0.0)]  # of the open paths, the outermost first
        opened: list[Path] = []
        active: set[int] = set()
        own, counts, above = [], [], []
        for k, (text, share, at) in enumerate(cut):
            path, new = at[0].path if at[0] else None, []
            while path and (len(opened) < path.depth or opened[path.depth - 1] is not path):
                new.append(path)
                path = path.above
            for gone in opened[path.depth if path else 0 :]:
                active.difference_update(gone.new)
            del opened[path.depth if path else 0 :], sums[len(opened) + 1 :]
            for p in reversed(new):
                x = self.emit[p.new].sum(axis=0)
                sums.append((sums[-1][0] + x[0], sums[-1][1] + x[1]))
                opened.append(p)
                active.update(p.new)
            ids = own_features(text, share, at, k, len(cut)) - active
            own.extend(ids)
            counts.append(len(ids))
            above.append(sums[-1])
        ends = np.cumsum(counts)
        total = np.concatenate([np.zeros((1, LABELS)), np.cumsum(self.emit[own], axis=0)])
        return total[ends] - total[ends - counts] + np.array(above)

    def decode(self, pages: list[list[list[int]]]) -> list[np.ndarray]:
        """The most probable labels of each page, given the features of its blocks."""
        return self.viterbi(*self.scores(pages))

    def decode_scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The same, given the scores of its blocks."""
        sizes = np.array([len(p) for p in pages], np.int64)
        out = np.zeros((len(pages), max(int(sizes.max(initial=0)), 1), LABELS))
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate([np.zeros((0, LABELS)), *[p for p in pages if len(p)]])
        return self.viterbi(out, sizes)

    def viterbi(self, score: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The most probable labels of padded pages, all at once."""
        n, t_max, _ = score.shape
        best = score[:, 0] + self.start
        back = np.zeros((n, t_max, LABELS), np.int8)
        for t in range(1, t_max):
            step = best[:, :, None] + self.move
            back[:, t] = step.argmax(axis=1)
            live = (t < sizes)[:, None]
            best = np.where(live, step.max(axis=1) + score[:, t], best)
        label = (best + self.stop).argmax(axis=1)
        out = np.zeros((n, t_max), np.int8)
        for t in range(t_max - 1, -1, -1):
            out[:, t] = label
            label = np.where((t < sizes) & (t > 0), back[np.arange(n), t, label], label)
        return [out[i, :s] for i, s in enumerate(sizes)]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(pages: list[list[tuple[list[int], int]]], *, rounds: int = 90, rate: float = 0.1, penalty: float = 1e-3) -> Field:
    """Maximum likelihood with an L2 penalty: forward-backward gradients, Adam steps."""
    feats = [[f for f, _ in p] for p in pages if p]
    gold = [np.array([y for _, y in p]) for p in pages if p]
    field = Field(np.zeros((1 << BITS, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS), np.zeros(LABELS))
    blocks = [b for p in feats for b in p]
    counts = np.array([len(b) for b in blocks])
    flat = np.fromiter((i for b in blocks for i in b), np.int64, int(counts.sum()))
    of = np.repeat(np.arange(len(blocks)), counts)
    sizes = np.array([len(p) for p in feats])
    n, t_max = len(feats), int(sizes.max())
    mask = np.arange(t_max) < sizes[:, None]
    y = np.zeros((n, t_max), np.int64)
    y[mask] = np.concatenate(gold)
    hot = np.eye(LABELS)[y]
    rows, last = np.arange(n), sizes - 1
    true_move = np.zeros((LABELS, LABELS))
    both = mask[:, 1:]
    np.add.at(true_move, (y[:, :-1][both], y[:, 1:][both]), 1)
    params = [field.emit, field.move, field.start, field.stop]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for r in range(1, rounds + 1):
        score, _ = field.scores(feats)
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[:, 0] = field.start + score[:, 0]
        for t in range(1, t_max):
            alpha[:, t] = _log_sum(alpha[:, t - 1, :, None] + field.move, 1) + score[:, t]
        z = _log_sum(alpha[rows, last] + field.stop, 1)
        beta[rows, last] = field.stop
        for t in range(t_max - 2, -1, -1):
            step = _log_sum(field.move + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where((t < last)[:, None], step, beta[:, t])
        node = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        pair = np.exp(alpha[:, :-1, :, None] + field.move + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        rest = (hot - node)[mask]
        emit = np.stack([np.bincount(flat, rest[of, k], 1 << BITS) for k in range(LABELS)], axis=1)
        grads = [emit, true_move - pair.sum(axis=(0, 1)), hot[:, 0].sum(0) - node[:, 0].sum(0), (hot - node)[rows, last].sum(0)]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            g = g / n - penalty * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return field


# --- labelled pages -----------------------------------------------------------------------------

#: Class, id and role words of page parts; fixed values.
CONTENT_WORDS = "article articlebody body content entry main maincontent page post postbody prose richtext story text".split()
PARTS = {
    "nav": "breadcrumb breadcrumbs categories links menu nav navbar navigation pagination pager tabs toc topnav".split(),
    "header": "banner branding head header masthead site sitetitle tagline topbar".split(),
    "footer": "bottom colophon copyright credits foot footer legal".split(),
    "aside": "aside box complementary more popular recommended related rail secondary sidebar teaser trending widget".split(),
    "ad": "ad ads adslot advert advertisement banner promo promoted promotion sponsor sponsored".split(),
    "notice": "alert announcement consent cookie cookies gdpr message modal notice notification overlay popup privacy warning".split(),
    "form": "form login newsletter search searchform signup subscribe subscription".split(),
    "comments": "comment commentlist comments discussion disqus feedback replies reply respond responses reviews thread".split(),
    "share": "author byline date meta share sharing social tags timestamp tools".split(),
}


#: Words of page parts in German, French, Spanish, Italian and Dutch; fixed values.
OTHER_WORDS = {
    "content": "artikel artikeltext beitrag inhalt hauptinhalt contenu texte contenido cuerpo texto articolo contenuto inhoud".split(),
    "nav": "navigationsleiste navigacion seitennavigation hauptmenue kopfmenue rubriques sommaire menu navigazione navigatie".split(),
    "header": "kopf kopfzeile entete cabecera encabezado testata intestazione".split(),
    "footer": "fuss fusszeile fussbereich pied pieddepage piedepagina pie impressum voet voettekst".split(),
    "aside": "seitenleiste randspalte verwandt barre laterale colonne barra lateral relacionados correlati zijbalk".split(),
    "ad": "werbung anzeige publicite pub publicidad anuncio pubblicita reclame advertentie".split(),
    "notice": "hinweis meldung avis aviso avviso melding einwilligung".split(),
    "form": "suche suchfeld anmeldung recherche formulaire buscar formulario ricerca zoeken".split(),
    "comments": "kommentar kommentare leserbriefe diskussion commentaires commentaire comentario comentarios commenti reacties".split(),
    "share": "teilen autor datum partager auteur compartir fecha condividi delen".split(),
}


def labelled_pages(n: int = 900, seed: int = 7) -> list[str]:
    """``n`` labelled pages in many layouts: a block's label is its first character, 1 for main text.

    This is the bounded training set; its size and seed are parameters."""
    return [_page(random.Random(seed * 100_003 + i)) for i in range(n)]


def varied_pages(n: int = 300, seed: int = 8) -> list[str]:
    """Labelled pages with class words of other languages, laid out in tables, deeply nested, or with text for
    browsers without scripts."""
    out = []
    for i in range(n):
        rng = random.Random(seed * 100_019 + i)
        page = _page(rng, OTHER_WORDS if rng.random() < 0.6 else None, tables=rng.random() < 0.3)
        if rng.random() < 0.3:
            note = rng.choice(("Please enable JavaScript to see this page.", "JavaScript ist ausgeschaltet.", "Ce site utilise JavaScript.", "Active JavaScript para ver esta página."))
            page = page.replace("<body>", f"<body><noscript>0{note}</noscript>" if rng.random() < 0.5 else f"<body><noscript><p>0{note}</p></noscript>")
        if rng.random() < 0.2:
            k = rng.randint(5, 80)
            page = page.replace("<body>", "<body>" + "<div>" * k).replace("</body>", "</div>" * k + "</body>")
        out.append(page)
    return out


def _page(rng: random.Random, other: dict[str, list[str]] | None = None, tables: bool = False) -> str:
    def word() -> str:
        return "".join(rng.choice(("ba", "den", "ol", "ki", "ra", "sun", "te", "é", "lor", "mi", "x", "ous")) for _ in range(rng.randint(1, 4)))

    def sentence(lo: int, hi: int) -> str:
        s = " ".join(word() + ("," if rng.random() < 0.08 else "") for _ in range(rng.randint(lo, hi)))
        return s.capitalize() + rng.choice("....!?") if rng.random() < 0.95 else s

    def prose(most: int = 6) -> str:
        return " ".join(sentence(2, 22) for _ in range(rng.randint(1, most)))

    def label() -> str:
        return " ".join(word() for _ in range(rng.randint(1, 4))).capitalize()

    semantic, named = rng.random() < 0.6, rng.random() < 0.75

    def attrs(kind: str) -> str:
        if not named or rng.random() < 0.15:
            return ""
        pool = other[kind] if other else CONTENT_WORDS if kind == "content" else PARTS[kind]
        joined = rng.choice("-_ ").join([*rng.sample(pool, rng.randint(1, 2)), *([word()] if rng.random() < 0.3 else [])])
        return f' {rng.choice(("class", "class", "id"))}="{joined}"'

    def wrap(tag: str, kind: str, inner: str) -> str:
        tag = (tag if rng.random() < 0.85 else "section") if semantic else "div"
        marked = attrs(kind)
        if tag in ("div", "section") and not marked and kind in ("ad", "notice", "comments", "share"):
            marked = f' class="{rng.choice((other or PARTS)[kind])}"'  # else nothing tells such a block apart
        elif tag == "section" and not marked and kind != "content":
            marked = f' class="{rng.choice((other or PARTS)[kind])}"'
        return f"<{tag}{marked}>{inner}</{tag}>"

    def links(k: int) -> str:
        items = [f'<a href="/{word()}">0{label()}</a>' for _ in range(k)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else "".join(f"<div>{x}</div>" for x in items)

    def part(kind: str) -> str:
        if kind == "nav":
            return wrap("nav", kind, links(rng.randint(2, 9)))
        if kind == "header":
            return wrap("header", kind, f"<h1>0{label()}</h1>" * (rng.random() < 0.3) + f"<div>0{label()}</div>" + (links(3) if rng.random() < 0.4 else ""))
        if kind == "footer":
            own = f"0&copy; {label()} &middot; {sentence(3, 10)}" if rng.random() < 0.7 else f"0{sentence(3, 12)}"
            return wrap("footer", kind, (f"<p>{own}</p>" if rng.random() < 0.5 else own) + (links(3) if rng.random() < 0.4 else ""))
        if kind == "aside":
            return wrap("aside", kind, f"<h3>0{label()}</h3>" + links(rng.randint(2, 6)) + (f"<p>0{prose(2)}</p>" if rng.random() < 0.5 else ""))
        if kind == "form":
            return f"<form{attrs(kind)}>" + f"<label>0{label()}</label>" + f"<p>0{sentence(3, 14)}</p>" * (rng.random() < 0.6) + "<input><button>go</button></form>"
        if kind == "comments":
            tag = rng.choice(("div", "section"))
            return wrap(tag, kind, f"<h3>0{label()}</h3>" + "".join(f"<{t}>0{prose(3)}</{t}>" for t in rng.choices(("p", "div", "li"), k=rng.randint(1, 6))))
        if kind == "share":
            return wrap("div", kind, f"0{label()}")
        return wrap("div", kind, f"0{prose(2)}" if rng.random() < 0.6 else f"<p>0{prose(2)}</p>")

    def content() -> str:
        out = [f"<h1>1{label() if rng.random() < 0.5 else sentence(4, 14)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 12))):
            x = rng.random()
            if x < 0.72:
                bold = f"<b>{sentence(2, 14)}<br>" if rng.random() < 0.2 else ""
                linked = f' <a href="/x">{word()}</a>' if rng.random() < 0.15 else ""
                out.append(f"<p>1{bold}{prose() if not bold or rng.random() < 0.4 else ''}{linked}" + ("</p>" if rng.random() < 0.8 else ""))
            elif x < 0.80:
                out.append(f"<h2>1{label()}</h2>")
            elif x < 0.87:
                t = rng.choice(("ul", "ol"))
                out.append(f"<{t}>" + "".join(f"<li>1{sentence(2, 14)}</li>" for _ in range(rng.randint(2, 5))) + f"</{t}>")
            elif x < 0.91:
                out.append(f"<blockquote>1{prose(3)}</blockquote>")
            elif x < 0.94:
                out.append("<table>" + "".join(f"<tr><td>1{label()}</td><td>1{sentence(1, 5)}</td></tr>" for _ in range(3)) + "</table>")
            elif x < 0.96:
                out.append(f"<pre>1{prose(2)}</pre>")
            else:
                out.append(f"<div>1{prose()}</div>")
        if rng.random() < 0.2:  # a last paragraph cut short
            out.append(f"<p>1{word().capitalize()}</p>")
        for _ in range(rng.choice((0, 0, 0, 1, 2))):
            out.insert(rng.randint(0, len(out)), "</p>" + part(rng.choice(("ad", "share", "aside", "form", "notice"))))
        if rng.random() < 0.15:
            out.append("</p>" + part("comments"))
        if rng.random() < 0.1:
            out.append("</p>" + part("nav"))
        inner = "".join(out)
        return wrap(rng.choice(("article", "article", "main", "section")), "content", inner) if rng.random() < 0.9 else f"<div><div{attrs('content')}>{inner}</div></div>"

    before = [part(k) for k in ("notice", "header", "nav", "ad", "form", "share") if rng.random() < 0.4]
    after = [part(k) for k in ("aside", "ad", "comments", "form", "nav", "footer") if rng.random() < 0.4]
    rng.shuffle(before)
    if rng.random() < 0.12:  # an article and nothing else
        before, after = [], []
    if tables:
        row = lambda x: f"<tr><td>{x}</td></tr>"
        bar = "".join(f'<td><a href="/{word()}">0{label()}</a></td>' for _ in range(rng.randint(2, 6))) if rng.random() < 0.5 else "<td>0" + " | ".join(f'<a href="/{word()}">{label()}</a>' for _ in range(rng.randint(2, 6))) + "</td>"
        body = f"<table><tr>{bar}</tr></table><table>" + "".join(row(x) for x in before) + row(content()) + "".join(row(x) for x in after) + "</table>"
    else:
        body = "".join([*before, content(), *after])
    if rng.random() < 0.2:
        body = f"<div{attrs('content')}>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>{label()}</title><script>x</script></head><body>{body}</body></html>"


@lru_cache(2)
def default_field(n: int = 900, seed: int = 7) -> Field:
    """A field fitted on ``labelled_pages(n, seed)`` and half as many ``varied_pages``."""
    pages = [*labelled_pages(n, seed), *varied_pages(n // 2, seed + 1)]
    return fit([[(f, y) for _, f, y in labelled_blocks(html)] for html in pages])


def alike(order: list[int], sizes: list[int]) -> Iterator[list[int]]:
    """Runs of pages, shortest first, that take at most ``MOST_BLOCKS`` blocks when padded to the longest, or one page."""
    group: list[int] = []
    for k in order:
        if group and (len(group) + 1) * sizes[k] > MOST_BLOCKS:
            yield group
            group = []
        group.append(k)
    if group:
        yield group


def extract(pages: DataFrame, field: Field | None = None, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row per page: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    src = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                cut, scores = [], []
                for x in part.column(2).to_pylist():
                    found = cut_blocks(x) if x else []
                    scores.append(model.page_scores(found) if found else np.zeros((0, LABELS)))
                    cut.append([t for t, *_ in found])
                texts = [""] * len(cut)
                order = sorted(range(len(cut)), key=lambda k: len(cut[k]))
                # pages of like length are decoded together, so padding stays small
                for group in alike(order, [len(x) for x in cut]):
                    for k, labels in zip(group, model.decode_scores([scores[k] for k in group]), strict=True):
                        texts[k] = "\n".join(t for t, y in zip(cut[k], labels, strict=True) if y)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, f"page_id {kinds[key]}, url {kinds[url]}, text string, n_chars long").toDF(key, "url", "text", "n_chars")
