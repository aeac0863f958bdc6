"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags. Each block is a
vector of its tag path, of the words in the class and id attributes on that path, of its hashed words and
of a few sizes. A bidirectional LSTM, written in numpy, reads the whole sequence and labels each block as
main text or not, so a label depends on everything before and after it. The model is trained on the driver
on pages composed here: layouts drawn from a seeded generator, filled with the text of a bounded sample of
the table's pages (SAMPLE_PAGES), so every label is known. It has a fixed size and is broadcast.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

SAMPLE_PAGES, TRAIN_PAGES, EPOCHS, HIDDEN = 200, 900, 10, 24

#: Tags whose content is no text.
RAW = "script|style|noscript|template|iframe|svg|math|object|textarea|select|title"
#: A tag's attributes. A quoted value may hold <, > and the other quote; one that does not close within so many
#: characters opens no quote, and the tag ends at its first >.
QUOTED = 4096
_QUOTES = rf"(?:[^>\"']|\"[^\"]{{0,{QUOTED}}}\"|'[^']{{0,{QUOTED}}}')*+"
MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:{_QUOTES}|[^>]*+)(?:/>|>.*?(?:</\1\s*>|\Z)|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)(?:({_QUOTES})(?:>|\Z)|([^>]*)(?:>|\Z))|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr button picture source link meta base".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes first, if open in the same container.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CONTAINERS = frozenset("body div article main section nav aside header footer form table ul ol dl td th blockquote fieldset figure details".split())

PATH_TAGS = "html head body main article section nav aside header footer form div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption address fieldset details summary button a label".split()
CLASS_WORDS = (
    "ad ads advert advertisement banner promo sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs header head masthead footer foot bottom copyright legal sidebar side aside widget related recommended more share social "
    "comment comments reply discussion respond notice notices cookie cookies consent alert message warning popup modal newsletter subscribe signup login form search content main article post entry story body text page wrapper container "
    "title headline author byline meta date tags pagination pager rail toolbar skip hidden"
).split()
_TAG_AT = {t: k for k, t in enumerate(PATH_TAGS)}
_CLASS_AT = {t: k for k, t in enumerate(CLASS_WORDS)}
WORD_DIMS, SIZES = 32, 9
DIMS = 2 * len(PATH_TAGS) + len(CLASS_WORDS) + WORD_DIMS + SIZES


@dataclass
class Block:
    """A run of text, and what is open around it: PATH_TAGS then CLASS_WORDS, the innermost tag, the depth."""

    around: bytes
    inner: int
    depth: int
    text: str
    linked: int


class _Open:
    """The open elements, with running counts, so that a block costs the same at every depth."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[int, ...]]] = []
        self.names: dict[str, int] = {}
        self.counts = [0] * (len(PATH_TAGS) + len(CLASS_WORDS))
        self.around = bytes(len(self.counts))

    def push(self, name: str, words: list[str]) -> None:
        at = [_TAG_AT[name]] if name in _TAG_AT else []
        at += {len(PATH_TAGS) + _CLASS_AT[w] for w in words if w in _CLASS_AT}
        self.stack.append((name, tuple(at)))
        self.names[name] = self.names.get(name, 0) + 1
        self._add(at, 1)

    def pop(self) -> None:
        name, at = self.stack.pop()
        self.names[name] -= 1
        self._add(at, -1)

    def _add(self, at: Iterable[int], n: int) -> None:
        for k in at:
            self.counts[k] += n
            if self.counts[k] == (n > 0):  # now there, or now gone
                self.around = self.around[:k] + bytes([n > 0]) + self.around[k + 1 :]

    def close(self, name: str) -> None:
        """Up to the innermost element of that name; a tag that closes nothing is passed over."""
        while self.names.get(name) and self.stack:
            found = self.stack[-1][0] == name
            self.pop()
            if found:
                return


HEADINGS = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6"))


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks that hold text, in order; character references decoded, white space single."""
    out: list[Block] = []
    open_ = _Open()
    parts: list[str] = []
    linked = in_link = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        text = "".join(parts)
        parts.clear()
        if "&" in text:
            text = entities.unescape(text)
        text = " ".join(text.split())
        if text:
            inner = _TAG_AT.get(open_.stack[-1][0], -1) if open_.stack else -1
            out.append(Block(open_.around, inner, len(open_.stack), text, linked))
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(piece)

    for m in MARKUP.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            if m[1] and m[1].lower() in ("iframe", "object", "textarea", "select"):
                text(" ")
            continue
        name, closing = name.lower(), bool(m[2])
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            continue
        if name == "br":
            text(" ")
            continue
        flush()
        in_link = 0
        if closing:
            open_.close(name)
            continue
        if name in VOID:
            continue
        closes = CLOSES.get(name, {"p"})
        while open_.stack and (open_.stack[-1][0] in closes or (open_.stack[-1][0] in HEADINGS and name in HEADINGS)):
            open_.pop()
        attributes = m[4] or m[5]
        open_.push(name, WORD.findall(" ".join(x for y in NAMES.findall(attributes) for x in y).lower()) if attributes else [])
    text(page[at:])
    flush()
    return out


def vectors(seq: list[Block]) -> np.ndarray:
    """One row per block."""
    out = np.zeros((len(seq), DIMS), np.float32)
    tags, n = len(PATH_TAGS), max(1, len(seq) - 1)
    total = sum(len(b.text) for b in seq) or 1
    done, base = 0, 2 * tags + len(CLASS_WORDS)
    for k, b in enumerate(seq):
        row = out[k]
        around = np.frombuffer(b.around, np.uint8)
        row[:tags], row[2 * tags : base] = around[:tags], around[tags:]
        if b.inner >= 0:
            row[tags + b.inner] = 1
        words = b.text.lower().split()
        h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
        row[base : base + WORD_DIMS] = np.bincount(h % WORD_DIMS, np.where(h >> 31, 1.0, -1.0), WORD_DIMS) / math.sqrt(len(words) or 1)
        size = len(b.text)
        row[-SIZES:] = (
            math.log1p(size) / 8, math.log1p(len(words)) / 6, min(1.0, b.linked / size), k / n, done / total, size / total,
            sum(map(b.text.count, ".,;:!?")) / size * 10, b.text[-1] in ".!?…", min(b.depth, 40) / 10,
        )
        done += size
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one logistic output a block."""

    def __init__(self, seed: int = 1, dims: int = DIMS, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w["x" + d] = (rng.standard_normal((dims, 4 * hidden)) / math.sqrt(dims) * 2).astype(np.float32)
            self.w["h" + d] = (rng.standard_normal((hidden, 4 * hidden)) / math.sqrt(hidden)).astype(np.float32)
            self.w["c" + d] = np.zeros(4 * hidden, np.float32)
            self.w["c" + d][hidden : 2 * hidden] = 1
        self.w["o"] = (rng.standard_normal(2 * hidden) / math.sqrt(hidden)).astype(np.float32)
        self.w["k"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction over x (time, batch, dims); a padded step leaves the state as it is."""
        n, batch, _ = x.shape
        z = self.hidden
        h, c = np.zeros((batch, z), np.float32), np.zeros((batch, z), np.float32)
        out, tape = np.zeros((n, batch, z), np.float32), []
        pre = x @ self.w["x" + d] + self.w["c" + d]
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            g = pre[t] + h @ self.w["h" + d]
            i, f, o = _sigmoid(g[:, :z]), _sigmoid(g[:, z : 2 * z]), _sigmoid(g[:, 2 * z : 3 * z])
            u = np.tanh(g[:, 3 * z :])
            m = mask[t][:, None]
            new = f * c + i * u
            th = np.tanh(new)
            if keep:
                tape.append((t, h, c, i, f, o, u, th, m))
            c = np.where(m, new, c)
            h = np.where(m, o * th, h)
            out[t] = h
        return out, tape

    def predict(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of each block of each page; pages of like length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            n = len(pages[order[0]])
            take = [k for k in order[:128] if len(pages[k]) <= 1.3 * n + 4]
            order = order[len(take) :]
            x, mask = _padded([pages[k] for k in take])
            p = _sigmoid(np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], axis=2) @ self.w["o"] + self.w["k"])
            for j, k in enumerate(take):
                out[k] = p[: len(pages[k]), j]
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = 2) -> None:
        """Adam on the mean cross-entropy of the blocks."""
        rng = np.random.default_rng(seed)
        first, second, step = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        by_length = np.argsort([len(p) for p in pages], kind="stable")
        starts = np.arange(0, len(pages), batch)
        for _ in range(epochs):
            for s in rng.permutation(starts):
                some = by_length[s : s + batch]
                x, mask = _padded([pages[k] for k in some])
                y = _padded([labels[k][:, None] for k in some])[0][..., 0]
                grads = self._grads(x, mask, y)
                step += 1
                for k, g in grads.items():
                    np.clip(g, -1, 1, out=g)
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + rate * 1e-4 * self.w[k]

    def _grads(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z = self.hidden
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        e = (_sigmoid(states @ self.w["o"] + self.w["k"]) - y) * mask / mask.sum()
        g = {"o": np.einsum("tb,tbh->h", e, states), "k": np.array([e.sum()], np.float32)}
        for n, d in enumerate("fb"):
            wh = self.w["h" + d]
            gw, gp = np.zeros_like(wh), np.zeros((*x.shape[:2], 4 * z), np.float32)
            dh = dc = np.zeros((x.shape[1], z), np.float32)
            for t, h, c, i, f, o, u, th, m in reversed(runs[d][1]):
                dh = dh + e[t][:, None] * self.w["o"][n * z : n * z + z]
                dn = np.where(m, dh, 0)
                ds = np.where(m, dc, 0) + dn * o * (1 - th * th)
                dg = np.concatenate([ds * u * i * (1 - i), ds * c * f * (1 - f), dn * th * o * (1 - o), ds * i * (1 - u * u)], axis=1)
                gw += h.T @ dg
                gp[t] = dg
                dh = np.where(m, dg @ wh.T, dh)
                dc = np.where(m, ds * f, dc)
            g |= {"h" + d: gw, "x" + d: np.einsum("tbd,tbg->dg", x, gp, optimize=True), "c" + d: gp.sum(axis=(0, 1))}
        return g


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, pages))
    x, mask = np.zeros((n, len(pages), pages[0].shape[1]), np.float32), np.zeros((n, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


MARK = "\x02"  # starts each block of a composed page that is main text
#: Words that pages use around their text whatever it is about; they fill half of the composed pages' other parts.
AROUND = {
    "menu": "Home|About us|Contact|News|Products|Services|Blog|Archive|Search|Log in|Sign up|Help|Sitemap|Start|Über uns|Kontakt|Accueil|Actualités|Inicio|Noticias",
    "notice": "We use cookies to improve this site.|Please accept our terms of use.|This site uses cookies and similar techniques.|Your browser is out of date.|Wir verwenden Cookies.|Ce site utilise des cookies.|Este sitio utiliza cookies.",
    "advert": "Advertisement|Sponsored|Buy now and save|Special offer ends soon|Limited time deal|Anzeige|Publicité|Publicidad|Free shipping on all orders",
    "form": "Your email address|Subscribe to our newsletter|Search this site|Name|Password|Send|Submit|Remember me|Message",
    "side": "Related articles|Most read|Popular posts|Recent posts|Tags|Categories|Share this page|Follow us|You may also like|Read more",
    "comment": "Great post, thanks!|I do not agree with this.|Reply|Posted by a reader|2 days ago|Thanks for sharing|Report this comment",
    "foot": "All rights reserved.|Privacy policy|Terms of use|Imprint|Copyright|Powered by|Impressum|Mentions légales|Aviso legal|Back to top",
}
_AROUND = {k: v.split("|") for k, v in AROUND.items()}
_NAMED = {
    "menu": "menu nav navigation top-menu main-menu navbar breadcrumbs site-nav pagination", "notice": "notice alert cookie-notice cookie-consent message banner popup",
    "advert": "ads advert ad-slot ad-banner sponsored promo", "form": "search login newsletter-form signup", "side": "sidebar side related widget right-rail recommended",
    "comments": "comments comment-list discussion reader-comments responses", "head": "header masthead site-header top", "foot": "footer site-footer copyright bottom",
    "main": "content article post entry-content story-body article-text main body", "page": "page wrapper container",
}


def compose(rng: random.Random, lines: list[str]) -> str:
    """A page of a random layout; the blocks of its main text start with MARK.

    A page is drawn as a tree: parts in random order and depth, each by its element (nav, aside, footer, ...) or by a
    class name or by neither; end tags of paragraphs, items and inline elements are left out at random, as
    authors do, and inline elements, comments and scripts stand anywhere.
    """
    pick, chance = rng.choice, lambda p: rng.random() < p
    line = lambda: entities.escape(pick(lines), quote=False)
    short = lambda n=5: " ".join(line().split()[: rng.randint(1, n)]) or "x"
    sloppy = pick([0.0, 0.0, 0.15, 0.6])  # how often this page's author leaves an end tag out
    spaced = pick(["", "", "\n", "\n  "])

    def attr(kind: str) -> str:
        return f' {pick(["class", "class", "id"])}={pick(chr(34) + chr(39))}{pick(_NAMED[kind].split())}'

    def el(name: str, inner: str, kind: str | None = None) -> str:
        named = attr(kind) if kind else ""
        start = f"<{name}{named}{named[named.index('=') + 1] if named else ''}>"
        ends = name in ("p", "li", "dd", "dt", "td", "b", "i", "em", "span") and chance(sloppy)
        return spaced + start + inner + ("" if ends else f"</{name}>")

    def inline(text: str) -> str:
        """text with some of its words in inline elements, or a line break after one."""
        words = text.split(" ")
        for _ in range(pick([0, 0, 0, 1, 1, 2])):
            k = rng.randrange(len(words))
            words[k] = pick([lambda w: el(pick(["b", "i", "em", "strong", "span", "code"]), w), lambda w: f'<a href="/{k}">{w}</a>', lambda w: w + pick(["<br>", "<br/>", "<img src=x.png alt='a > b'>", "<!-- x -->"])])(words[k])
        return " ".join(words)

    def said(kind: str, n: int = 6) -> str:
        return pick([lambda: entities.escape(pick(_AROUND[kind])), lambda: short(n), line])() if chance(0.8) else entities.escape(pick(_AROUND[kind])) + " " + short(n)

    def wrapped(inner: str, element: str, kind: str) -> str:
        """By the element, by a class name, or by both."""
        return pick([lambda: el(element, inner), lambda: el(element, inner, kind), lambda: el("div", inner, kind), lambda: el("section", inner, kind)])()

    def items(kind: str, n: int) -> str:
        links = [pick([f'<a href="#{k}">{said(kind, 3)}</a>', f"<a href='/{k}'>{short(3)}</a>", said(kind, 3)]) for k in range(n)]
        return pick([lambda: el("ul", "".join(el("li", x) for x in links)), lambda: pick([" | ", " &middot; ", " "]).join(links), lambda: "".join(el("div", x) for x in links), lambda: el("ol", "".join(el("li", x) for x in links))])()

    def some(kind: str, n: int = 3) -> str:
        return "".join(pick([lambda: el("p", inline(said(kind))), lambda: el("div", said(kind)), lambda: el(pick(["h2", "h3", "h4"]), said(kind, 4)), lambda: said(kind), lambda: items(kind, 3)])() for _ in range(rng.randint(1, n)))

    menu = lambda: wrapped(items("menu", rng.randint(2, 9)), "nav", "menu")
    notice = lambda: el(pick(["div", "div", "section", "aside"]), some("notice", 2) + pick(["", "<button>OK</button>"]), "notice")
    advert = lambda: el(pick(["div", "div", "aside", "section"]), some("advert", 2), "advert")
    form = lambda: el("form", some("form", 3) + f"<input name=q><button>{said('form', 2)}</button>", pick([None, "form"]))
    side = lambda: wrapped(some("side", 4), "aside", "side")
    head = lambda: wrapped(pick([el("h1", said("menu", 4)), "", el("div", said("menu", 4))]) + pick([el("p", said("menu", 9)), "", items("menu", 4)]), "header", "head")
    foot = lambda: wrapped(pick(["&copy; ", "", "Copyright "]) + some("foot", 3), "footer", "foot")

    def comments() -> str:
        one = lambda: el(pick(["div", "li", "article", "p", "section"]), pick(["", el("b", short(2))]) + pick([el("p", inline(said("comment"))), said("comment"), el("div", line())]), pick([None, "comments"]))
        return wrapped(pick(["", el("h2", "Comments"), el("h3", short(3))]) + "".join(one() for _ in range(rng.randint(1, 5))), "section", "comments") if chance(0.8) else el("div", "".join(one() for _ in range(3)), "comments")

    def body() -> str:
        """The main text: headings, paragraphs, lists, quotes, tables; adverts and notices may stand within."""
        parts = [el(pick(["h1", "h1", "h2"]), MARK + pick([lambda: short(9), line])())] if chance(0.85) else []
        for _ in range(pick([1, 1, 2, 3, 4, 6, 9, 14, 25])):
            parts.append(
                pick(
                    [lambda: el("p", MARK + inline(line()))] * 14
                    + [lambda: el("div", MARK + inline(line())), lambda: el(pick(["h2", "h3"]), MARK + short(6)), lambda: el("blockquote", MARK + line()), lambda: el("pre", MARK + line())]
                    + [lambda: el(pick(["ul", "ol"]), "".join(el("li", MARK + inline(short(12))) for _ in range(rng.randint(2, 4)))), lambda: el("table", "".join(el("tr", el("td", MARK + short()) + el("td", MARK + short())) for _ in range(2)))]
                    + [advert] + [lambda: pick([notice, side, form])()]
                )()
            )
        inner = "".join(parts)
        return pick(
            [lambda: el("article", inner)] * 3
            + [lambda: el("main", inner), lambda: el("main", el("article", inner)), lambda: el("article", inner, "main"), lambda: el("section", inner, "main"), lambda: el("div", inner)]
            + [lambda: el("div", inner, "main")] * 3
        )()

    before = [f() for f in (head, menu, advert, notice, form, side) if chance(0.6 if f is menu else 0.28)]
    after = [f() for f in (comments, side, form, notice, advert, menu) if chance(0.35 if f is comments else 0.2)]
    rng.shuffle(before)
    rng.shuffle(after)
    inner = "".join(before) + (body() if chance(0.98) else "") + "".join(after) + (foot() if chance(0.85) else "")
    for _ in range(pick([0, 0, 0, 1, 2])):
        inner = el("div", inner, pick([None, "page"]))
    junk = pick(["", f"<script>if (a < b) {{ write('{short(3)}') }}</script>", f"<style>.{short(1)[:3]} {{ color: red }}</style>", "<meta charset=utf-8>", '<link rel="x" href="y">'])
    return pick(["<!DOCTYPE html>", ""]) + f"<html><head><title>{short(8)}</title>{junk}</head><body>{inner}{junk}" + pick(["</body></html>", ""])


def train(sample: list[str], seed: int = 3, n_pages: int = TRAIN_PAGES) -> Labeller:
    """A labeller fitted on n_pages composed pages filled with the sample's block texts."""
    lines = [t for page in sample for b in blocks(page) if (t := " ".join(b.text.replace(MARK, " ").split()))]
    lines = lines or ["a few words of text.", "Another line, somewhat longer than the first one.", "Menu"]
    rng = random.Random(seed)
    pages, labels = [], []
    for _ in range(n_pages):
        seq = blocks(compose(rng, lines))
        y = np.array([b.text.startswith(MARK) for b in seq], np.float32)
        for b in seq:
            b.text = b.text.lstrip(MARK).strip() or "x"
        if seq:
            pages.append(vectors(seq))
            labels.append(y)
    model = Labeller()
    model.fit(pages, labels)
    return model


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """pages without html, plus text (blocks labelled as main text, one a line) and n_chars.

    A null or empty html, or one without main text, gives an empty text. Repeated rows are labelled alike.
    Columns named text or n_chars are replaced, the others stay.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in pages.columns if c not in ("html", "text", "n_chars")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            found = [blocks(x) for x in texts(b.column("html"))]
            labels = shared.value.predict([vectors(x) if x else np.zeros((0, DIMS), np.float32) for x in found])
            out = ["\n".join(x.text for x, p in zip(seq, y.tolist(), strict=True) if p > 0.5) for seq, y in zip(found, labels, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], [*columns, "text", "n_chars"])

    rows = pages.select(*columns, F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, rows.drop("html").withColumns({"text": F.lit("").cast("string"), "n_chars": F.lit(0).cast("long")}).schema)


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    sample = pages.select("html", F.xxhash64("page_id", "html").alias("h")).orderBy("h").limit(SAMPLE_PAGES).toArrow()
    return extract(pages, train(texts(sample.column("html"))))
