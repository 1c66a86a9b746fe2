"""Main-text extraction from HTML by a linear-chain conditional random field.

A page is read into leaf blocks (runs of text between block-level tags) in document order. Each block has features of
its ancestors (tags, words of class, id and role) and of its text (length, link share, punctuation, position). A
chain CRF with the labels boilerplate and main is fitted on labelled pages by gradient ascent on the conditional
likelihood and decoded by Viterbi. Scripts, styles and other text that no reader sees never become blocks.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SCHEMA = "page_id long, url string, text string, n_chars long"

# Fixed lists of HTML elements by their role.
UNSEEN = frozenset("script style noscript template svg iframe object canvas audio video head title annotation annotation-xml".split())
#: Of these an unclosed one goes to the page's end in the standard too.
RAW = frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var ruby rt rp wbr img input picture map math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle mpadded msub msup msubsup munder mover munderover mtable mtr mtd mspace semantics".split())
#: Start tags that end an open element of the listed names.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"), "optgroup": ("option", "optgroup")}
#: Start tags that end an open paragraph in the standard; a hidden one ends by these only.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split())
#: What such an end can't reach beyond.
SCOPES = frozenset("ul ol dl table select html body article section div nav aside main footer header form blockquote".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)", re.S)
#: One attribute: its name and its value in double, single or no quotes.
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
MARKING = frozenset("class id role aria-label itemprop".split())
NAME_WORD = re.compile(r"[a-z]+")


@lru_cache(maxsize=64)
def same_tag(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>?", re.I)


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[str, ...]  # tags from the root down
    marks: frozenset[str]  # words of class, id and role of all ancestors
    linked: int = 0  # characters inside links


@dataclass(slots=True)
class _Open:
    tag: str
    marks: frozenset[str] = field(default_factory=frozenset)
    hidden: bool = False


def _attributes(raw: str) -> tuple[frozenset[str], bool]:
    if not raw or "=" not in raw and "hidden" not in raw.lower():
        return frozenset(), False
    words, gone = set(), False
    for name, a, b, c in ATTRIBUTE.findall(raw):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden":
            gone = True
        elif name == "style":
            gone = gone or "display:none" in value.replace(" ", "")
        elif name in MARKING:
            words.update(NAME_WORD.findall(value))
    return frozenset(words), gone


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page with their white space collapsed, empty ones left out."""
    stack: list[_Open] = []
    out: list[Block] = []
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                marks = frozenset().union(*(o.marks for o in stack)) if any(o.marks for o in stack) else frozenset()
                out.append(Block(joined, tuple(o.tag for o in stack if o.tag not in INLINE), marks, linked))
            text.clear()
        linked = 0

    def data(raw: str) -> None:
        nonlocal linked
        if raw and not any(o.hidden for o in stack):
            text.append(html.unescape(raw) if "&" in raw else raw)
            if any(o.tag == "a" for o in stack):
                linked += len(text[-1])

    unclosed: set[str] = set()
    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            data(page[at:])
            break
        data(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                data(m[0][9:].removesuffix("]]>"))
            continue
        tag, raw = tag.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:  # an end tag
            if tag not in INLINE and any(o.tag == tag for o in stack):
                flush()
                while stack.pop().tag != tag:
                    pass
            elif tag in INLINE:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag == tag:
                        del stack[k]
                        break
                    if stack[k].tag not in INLINE:
                        break
            elif tag == "p":
                flush()
            continue
        marks, gone = _attributes(raw)
        if tag == "br":
            data(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        closed = raw.rstrip().endswith("/")
        if tag in UNSEEN and not closed:
            # the text up to the matching end tag is never seen; nested elements of the same name count. No block ends
            # here: a script inside a sentence leaves the sentence whole
            depth, to = 1, at
            if tag not in unclosed:
                nests = tag not in ("script", "style", "head", "title")
                for end in same_tag(tag).finditer(page, at):
                    to = end.end()
                    depth += -1 if end[1] else nests
                    if not depth:
                        break
            if not depth:
                at = to
            elif tag in RAW:
                at = n
            else:  # without an end tag only the tag itself goes, and the text up to the next one
                unclosed.add(tag)
                after = page.find("<", at)
                at = at if tag == "head" else n if after < 0 else after
            continue
        gone = gone and not closed
        if tag in INLINE:
            stack.append(_Open(tag, marks, gone))
            continue
        flush()
        for k in range(len(stack) - 1, -1, -1):  # an open paragraph ends here, with what is open inside it
            if stack[k].tag == "p":
                if tag in CLOSES_P or not stack[k].hidden:
                    del stack[k:]
                break
            if stack[k].tag not in INLINE:
                break
        else:
            stack[:] = [o for o in stack if o.tag not in INLINE or o.hidden]
        ends = len(stack)
        for k in range(len(stack) - 1, -1, -1):  # a cell ends with its row, a row with its group
            if stack[k].tag in SCOPES:
                break
            if stack[k].tag in CLOSES.get(tag, ()):
                ends = k
        del stack[ends:]
        stack.append(_Open(tag, marks, gone))
    flush()
    return out


def featurise(page: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out = []
    for k, b in enumerate(page):
        n_words, n = b.text.count(" ") + 1, len(b.text)
        f = ["bias", f"tag={b.path[-1] if b.path else ''}", f"words={min(6, n_words.bit_length())}", f"linked={min(4, 4 * b.linked // n)}", f"place={4 * k // len(page)}"]
        f += [f"in={t}" for t in set(b.path)]
        f += [f"mark={w}" for w in b.marks]
        f.append(f"ends={b.text[-1] if b.text[-1] in '.!?:;,|' else ''}")
        if k == 0 or page[k - 1].path != b.path:
            f.append("path-changes")
        out.append(f)
    return out


class Crf:
    """Two-label linear-chain CRF. Features unseen in fitting weigh nothing."""

    def __init__(self, index: dict[str, int]):
        self.index = index
        self.unary = np.zeros((len(index) + 1, 2))  # the last row stays zero
        self.pair = np.zeros((2, 2))

    def potentials(self, features: list[list[str]]) -> np.ndarray:
        none = len(self.index)
        return np.array([self.unary[[self.index.get(x, none) for x in f]].sum(axis=0) for f in features]).reshape(-1, 2)

    def decode(self, features: list[list[str]]) -> list[int]:
        """The best label sequence (Viterbi)."""
        if not features:
            return []
        u, p = self.potentials(features).tolist(), self.pair.tolist()
        s0, s1 = u[0]
        back = []
        for a, b in u[1:]:
            from0, from1 = s0 + p[0][0] < s1 + p[1][0], s0 + p[0][1] < s1 + p[1][1]
            back.append((from0, from1))
            s0, s1 = (s1 + p[1][0] if from0 else s0 + p[0][0]) + a, (s1 + p[1][1] if from1 else s0 + p[0][1]) + b
        label = int(s1 > s0)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    @classmethod
    def fit(cls, pages: list[tuple[list[list[str]], list[int]]], steps: int = 80, rate: float = 0.15, l2: float = 1e-3) -> Crf:
        """Gradient ascent with per-weight rates on the mean conditional log-likelihood. Pages of equal length run
        their forward and backward sums together."""
        names = sorted({x for features, _ in pages for f in features for x in f})
        model = cls({x: k for k, x in enumerate(names)})
        by_length: dict[int, list] = {}
        for features, labels in pages:
            if labels:
                by_length.setdefault(len(labels), []).append((features, labels))
        groups = []
        for n, members in by_length.items():
            rows = [(m * n + t, model.index[x]) for m, (features, _) in enumerate(members) for t, f in enumerate(features) for x in f]
            at, what = np.array(rows).T
            groups.append((len(members), n, at, what, np.array([labels for _, labels in members])))
        total = sum(m * n for m, n, *_ in groups)
        sums_u, sums_p = np.full_like(model.unary, 1e-8), np.full_like(model.pair, 1e-8)
        for _ in range(steps):
            grad_u, grad_p = -l2 * model.unary * total, -l2 * model.pair * total
            for m, n, at, what, y in groups:
                u = np.zeros((m * n, 2))
                np.add.at(u, at, model.unary[what])
                u = u.reshape(m, n, 2)
                forward, backward = np.zeros((m, n, 2)), np.zeros((m, n, 2))
                forward[:, 0] = u[:, 0]
                for t in range(1, n):
                    forward[:, t] = u[:, t] + np.logaddexp.reduce(forward[:, t - 1, :, None] + model.pair, axis=1)
                for t in range(n - 2, -1, -1):
                    backward[:, t] = np.logaddexp.reduce(model.pair + (u[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
                z = np.logaddexp.reduce(forward[:, -1], axis=1)
                marginal = np.exp(forward + backward - z[:, None, None])
                error = (np.eye(2)[y] - marginal).reshape(m * n, 2)
                np.add.at(grad_u, what, error[at])
                if n > 1:
                    joint = forward[:, :-1, :, None] + model.pair + (u[:, 1:] + backward[:, 1:])[:, :, None, :]
                    grad_p -= np.exp(joint - z[:, None, None, None]).sum(axis=(0, 1))
                    np.add.at(grad_p, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            grad_u[-1] = 0
            sums_u += (grad_u / total) ** 2
            sums_p += (grad_p / total) ** 2
            model.unary += rate * grad_u / total / np.sqrt(sums_u)
            model.pair += rate * grad_p / total / np.sqrt(sums_p)
        return model


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages in common layouts with the true label of each leaf block, for fitting and testing. Words are invented;
    layout, class names and order vary."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        noise = ("", "", "", "", ",", ".", "***", "$$", "!!")
        mark = rng.choice((True, False, False))
        return " ".join("".join(rng.choice(("ka", "lo", "mi", "ren", "tu", "é", "so", "und", "th")) for _ in range(rng.randint(1, 4))) + (rng.choice(noise) if mark else "") for _ in range(rng.randint(low, high)))

    def sentence(low: int, high: int) -> str:
        return words(low, high).capitalize() + rng.choice((".", ".", ".", "!", "", "?"))

    pages = []
    for _ in range(n):
        parts: list[tuple[str, list[int]]] = []

        def links(k: int) -> str:
            return "".join(f'<li><a href="/{words(1, 1)}">{words(1, 2)}</a></li>' for _ in range(k))

        def menu() -> tuple[str, list[int]]:
            k = rng.randint(2, 9)
            box = rng.choice(("<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul class="nav navbar">{}</ul>', '<div id="navigation"><ul>{}</ul></div>', '<nav role="navigation"><ol class="breadcrumb">{}</ol></nav>'))
            return box.format(links(k)), [0] * k

        def advert() -> tuple[str, list[int]]:
            box = rng.choice(('<div class="ad">{}</div>', '<div class="ads banner"><p>{}</p></div>', '<div id="ad-top"><span>{}</span></div>', '<aside class="advert sponsored"><p>{}</p></aside>', '<ins class="advertisement"><div>{}</div></ins>', '<div class="promo">{}</div>'))
            return box.format(sentence(3, 30)), [0]

        def notice() -> tuple[str, list[int]]:
            box = rng.choice(('<div class="cookie notice"><p>{}</p></div>', '<div id="cookie-banner" role="dialog">{}</div>', '<div class="consent popup">{}</div>', '<div class="newsletter subscribe"><p>{}</p></div>', '<div class="alert notice" role="alert">{}</div>'))
            return box.format(sentence(4, 35)), [0]

        def form() -> tuple[str, list[int]]:
            box = rng.choice(('<form action="/s"><label>{}</label><input name="q"><button>{}</button></form>', '<form class="search"><div>{} {}</div></form>'))
            return box.format(words(1, 3), words(1, 2)), [0] * (1 if "<div>" in box else box.count("{}"))

        def side() -> tuple[str, list[int]]:
            k = rng.randint(1, 5)
            if rng.random() < 0.5:
                return '<aside class="sidebar"><h3>' + words(1, 4) + "</h3><ul>" + links(k) + "</ul></aside>", [0] * (k + 1)
            box = rng.choice(("<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="related" class="widget">{}</div>', '<section class="related posts">{}</section>', '<div class="share social">{}</div>'))
            return box.format("".join(f"<p>{sentence(3, 25)}</p>" for _ in range(k))), [0] * k

        def header() -> tuple[str, list[int]]:
            box = rng.choice(("<header><h1>{}</h1><p>{}</p></header>", '<div class="header"><div class="logo">{}</div><div class="tagline">{}</div></div>', '<header role="banner"><div>{}</div><div>{}</div></header>'))
            return box.format(words(1, 4), words(2, 8)), [0, 0]

        def comments() -> tuple[str, list[int]]:
            k = rng.randint(1, 6)
            outer, inner = rng.choice((('<section class="comments">{}</section>', "<p>{}</p>"), ('<div id="comments"><h2>' + words(1, 2) + "</h2>{}</div>", '<div class="comment">{}</div>'), ('<ol class="commentlist comment-list">{}</ol>', '<li class="comment reply">{}</li>'), ('<div class="discussion replies">{}</div>', "<p>{}</p>")))
            return outer.format("".join(inner.format(sentence(3, 60)) for _ in range(k))), [0] * (k + ("<h2>" in outer))

        def footer() -> tuple[str, list[int]]:
            box = rng.choice(("<footer>{}</footer>", "<footer><p>{}</p></footer>", '<div id="footer" class="footer copyright">{}</div>', '<footer role="contentinfo"><div>{}</div></footer>'))
            return box.format(rng.choice(("&copy; 2024 ", "", "Copyright ")) + words(2, 20)), [0]

        def article() -> tuple[str, list[int]]:
            body, labels = [], []
            if rng.random() < 0.8:
                body.append(rng.choice(("<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", '<h1 class="title headline">{}</h1>')).format(words(2, 12)))
                labels.append(1)
            for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14))):
                kind = rng.random()
                if kind < 0.78:
                    body.append(rng.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>")).format(sentence(*rng.choice(((1, 6), (8, 40), (30, 200))))))
                    labels.append(1)
                elif kind < 0.84:
                    body.append(f"<h2>{words(1, 8)}</h2>")
                    labels.append(1)
                elif kind < 0.9:
                    body.append(f"<blockquote><p>{sentence(5, 40)}</p></blockquote>")
                    labels.append(1)
                elif kind < 0.95:
                    k = rng.randint(1, 4)
                    body.append("<ul>" + "".join(f"<li>{sentence(2, 25)}</li>" for _ in range(k)) + "</ul>")
                    labels += [1] * k
                else:
                    inner, no = rng.choice((advert, notice, side))()
                    body.append(inner)
                    labels += no
            box = rng.choice(("<article>{}</article>", "<article>{}</article>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main" class="post entry">{}</div>', "<main>{}</main>", '<section class="article body">{}</section>', '<div class="story text">{}</div>'))
            return box.format("".join(body)), labels

        for make, chance in ((notice, 0.2), (header, 0.3), (menu, 0.8), (form, 0.2), (advert, 0.5)):
            if rng.random() < chance:
                parts.append(make())
        parts.append(article())
        for make, chance in ((comments, 0.35), (side, 0.35), (advert, 0.25), (form, 0.15), (menu, 0.1), (footer, 0.9), (notice, 0.1)):
            if rng.random() < chance:
                parts.append(make())
        if rng.random() < 0.25:  # a column beside the article, before it
            parts.insert(0, side())
        page = "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(p for p, _ in parts) + "</body></html>"
        labels = [x for _, ls in parts for x in ls]
        if len(blocks(page)) == len(labels):
            pages.append((page, labels))
    return pages


def fit_pages(pages: list[tuple[str, list[int]]]) -> Crf:
    return Crf.fit([(featurise(blocks(page)), labels) for page, labels in pages])


@lru_cache(maxsize=1)
def default_model() -> Crf:
    return fit_pages(labelled_pages())


def main_text(page: str, model: Crf) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, y in zip(found, model.decode(featurise(found))) if y)


def extract(pages: DataFrame, model: Crf | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every whole page, one row per input row, without a shuffle.

    Null or empty html gives an empty text, as does a page without main blocks; null ids and urls are carried along;
    repeated rows come back each; an empty table gives an empty result; other columns are ignored. The model is
    fitted once on the driver and is of fixed size."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t, model) for t in common.as_text(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return common.pick(pages, page_id=id_col, url=url_col, html=html_col).mapInArrow(run, SCHEMA)
