"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks (``html_blocks``). A bidirectional LSTM in
numpy reads the blocks' vectors (hashed tag path with the words of class, id and
role; hashed words; a few measures) and labels every block as main text or not,
seeing the whole page on either side. The model is trained when first used, on
pages that ``synthetic_page`` builds from layouts of the usual kinds with
invented words and known labels; the seed is fixed, so every run has the same
weights. They are a few hundred kilobytes, whatever the corpus.

The labeller alone decides; what it knows of navigation, footers, forms and the like
it has from the training pages, some of which are wrapped in one form as a whole.
Blocks' vectors are projected ``PIECE`` at a time, so a page of any length takes some
hundred bytes a block.

Edge cases: a null or empty page, or one without main text, gives the empty
string; unclosed elements end where HTML ends them or with the page; repeated
rows are all returned; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import WIDTH, Block, blocks, vectors

HIDDEN = 24
STEPS = 420
BATCH = 24
RATE = 0.01
SEED = 42
MARK = "\u2063"
PIECE = 2048
PADDED = 1 << 15  # blocks in a batch of pages, with padding


# --- training pages -------------------------------------------------------------

_SYLLABLES = "ka lo mi ren tas ver ul sho dra pe nix or bel un zar qui fe gho ym eth".split()
_COMMON = "the of and to in a is that for on der die und von el la de que les est un".split()


class _Writer:
    """Pieces of HTML with invented words; ``main`` marks text as main."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def word(self) -> str:
        r = self.rng
        if r.random() < 0.35:
            return r.choice(_COMMON)
        w = "".join(r.choices(_SYLLABLES, k=r.randint(1, 4)))
        return w + r.choice(["%%%", "***", "&amp;", "$$$"]) if r.random() < 0.03 else w

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def prose(self, low: int = 2, high: int = 70) -> str:
        r = self.rng
        text = self.words(low, high).capitalize() + r.choice([".", ".", ".", "", "!", "?"])
        # tables run together, shouting, numbers, very long paragraphs
        odd = r.random()
        if odd < 0.03:
            return " | ".join(self.word() for _ in range(r.randint(3, 300)))
        if odd < 0.05:
            return text.upper().replace(" ", "!! ").replace("&AMP;", "&amp;")
        if odd < 0.07:
            return text + f" {r.randint(1, 99999)} +{r.randint(1, 99)} ({r.randint(100, 999)}) {r.randint(10**9, 10**15)}"
        if odd < 0.09:
            return self.words(100, 600)
        return f"<b>{text}<br>" if r.random() < 0.1 else f"{text} <a href='/x'>{self.word()}</a> {self.word()}" if r.random() < 0.1 else text

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f"<li><a href='/{k}'>{self.words(1, 3).capitalize()}</a></li>" for k in range(n)) + "</ul>"

    def named(self, names: str, tag: str = "div") -> tuple[str, str]:
        name = self.rng.choice(names.split())
        if self.rng.random() < 0.4:
            # what surrounds the telling word says nothing
            extra = self.rng.choice("content area container box wrapper section block inner item body main post site page left right wide".split())
            name = self.rng.choice([f"{name}-{extra}", f"{extra}-{name}", f"{name}{extra.capitalize()}", f"{name}_{extra}"])
        how = self.rng.choice([f' class="{name}"', f' id="{name}"', f' class="box {name} {self.word()[:5]}"'])
        return f"<{tag}{how}>", f"</{tag}>"

    def inside(self, wrap: tuple[str, str], body: str) -> str:
        return wrap[0] + body + wrap[1]

    # parts that aren't main text
    def navigation(self) -> str:
        r = self.rng
        wrap = r.choice([("<nav>", "</nav>"), self.named("menu navbar nav navigation topnav main-menu breadcrumbs breadcrumb"), self.named("menu nav", "ul")])
        return self.inside(wrap, self.links(r.randint(2, 9)) if r.random() < 0.8 else " | ".join(f"<a href='#'>{self.word()}</a>" for _ in range(5)))

    def masthead(self) -> str:
        wrap = self.rng.choice([("<header>", "</header>"), self.named("header masthead site-header top-bar branding")])
        inner = self.rng.choice([f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(2, 8)}</p>", f"<div>{self.words(1, 4)}</div>"])
        return self.inside(wrap, inner + (self.navigation() if self.rng.random() < 0.4 else ""))

    def advert(self) -> str:
        wrap = self.named("ad ads advert advertisement banner sponsor sponsored sponsored promo promoted ad-slot adsense")
        return self.inside(wrap, self.rng.choice([self.prose(3, 25), f"<p>{self.prose(3, 25)}</p>", f"Advertisement {self.words(1, 6)}"]))

    def notice(self) -> str:
        wrap = self.named("cookie cookie-banner consent gdpr notice alert popup modal newsletter subscribe paywall")
        return self.inside(wrap, f"<p>{self.rng.choice(['We use cookies', 'Subscribe', 'Sign up', ''])} {self.prose(4, 25)}</p><button>{self.word()}</button>")

    def aside(self) -> str:
        wrap = self.rng.choice([("<aside>", "</aside>"), self.named("sidebar widget side-bar related recommended popular tags share social aside rail author-box")])
        return self.inside(wrap, f"<h3>{self.words(1, 3)}</h3>" + self.rng.choice([self.links(self.rng.randint(2, 6)), f"<p>{self.prose(5, 60)}</p>", f"<p>{self.prose(5, 60)}</p><p>{self.prose(2, 40)}</p>"])) if self.rng.random() < 0.7 else self.inside(wrap, f"<p>{self.prose(5, 60)}</p>")

    def form(self) -> str:
        wrap = self.rng.choice([("<form action='/s'>", "</form>"), ("<form class='search'>", "</form>")])
        return self.inside(wrap, f"<label>{self.words(1, 3)}</label><input name=q><button>{self.word()}</button>" + (f"<p>{self.prose(3, 12)}</p>" if self.rng.random() < 0.4 else ""))

    def footer(self) -> str:
        wrap = self.rng.choice([("<footer>", "</footer>"), self.named("footer site-footer copyright legal colophon bottom")])
        inner = self.rng.choice([f"&copy; {self.word()}.example.org &middot; {self.prose(3, 12)}", f"<p>&copy; {self.words(2, 8)}</p>", f"<p>{self.prose(3, 25)}</p>" + self.links(3)])
        return self.inside(wrap, inner)

    def comments(self) -> str:
        r = self.rng
        wrap = r.choice([self.named("comments comment-list disqus responses discussion replies"), self.named("comments user-comments", "section")])
        one = lambda: self.inside(self.named("comment reply comment-body"), r.choice(["", f"<h4>{self.words(1, 2)}</h4>"]) + f"<p>{self.prose(3, 50)}</p>")
        level = r.choice(["h2", "h3", "h4", "p", "div"])
        return self.inside(wrap, f"<{level}>{r.choice(['Comments', self.words(1, 3)])}</{level}>" + "".join(one() for _ in range(r.randint(1, 5))))

    # main text
    def main(self, text: str) -> str:
        return MARK + text

    def content(self) -> str:
        r, m = self.rng, self.main
        out = [f"<h1>{m(self.words(2, 10))}</h1>"] if r.random() < 0.85 else []
        if r.random() < 0.15:
            out = [f"<header>{out[0]}<p>{m(self.prose(2, 20))}</p></header>"] if out else []
        tag = "div" if r.random() < 0.12 else "p"
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12, 20])):
            kind = r.random()
            if kind < 0.72:
                text = m(self.prose(1, r.choice([4, 30, 90])))
                out.append(f"<div>{text}</div>" if tag == "div" else f"<p>{text}" + ("</p>" if r.random() < 0.9 else ""))
            elif kind < 0.79:
                out.append(f"<h{(k := r.randint(2, 4))}>{m(self.words(1, 6))}</h{k}>")
            elif kind < 0.85:
                kind = r.choice(["ul", "ol"])
                out.append(f"<{kind}>" + "".join(f"<li>{m(self.prose(1, 15))}</li>" for _ in range(r.randint(2, 5))) + f"</{kind}>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{m(self.prose(4, 30))}</p></blockquote>")
            elif kind < 0.90:
                out.append("<table>" + "".join(f"<tr><td>{m(self.words(1, 3))}</td><td>{m(self.words(1, 3))}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.905:
                out.append(f"<pre>{m(self.words(3, 20))}</pre>")
            elif kind < 0.915:
                out.append(f"<figure><figcaption>{m(self.words(2, 9))}</figcaption></figure>")
            else:
                out.append(r.choice([self.advert, self.aside, self.form, self.notice])())
        return "".join(out)


def synthetic_page(rng: random.Random) -> str:
    """A page of one of the usual layouts; main blocks begin with ``MARK``."""
    w = _Writer(rng)
    some = lambda p, f: f() if rng.random() < p else ""
    body = w.content()
    wrap = rng.choice(
        [
            ("<article>", "</article>"),
            ("<article>", "</article>"),
            ("<main>", "</main>"),
            ("<main><article>", "</article></main>"),
            ("<div class='wrap'><article class='post'>", "</article></div>"),
            w.named("content article post entry-content story article-body main page-body text"),
            w.named("content post main", "section"),
            ("<div>", "</div>"),
            ("", ""),
        ]
    )
    if rng.random() < 0.2:
        body += w.comments()
    main = w.inside(wrap, body) if rng.random() < 0.94 else ""
    top = [some(0.25, w.notice), some(0.4, w.masthead), some(0.7, w.navigation), some(0.15, w.form), some(0.4, w.advert)]
    end = [some(0.2, w.comments), some(0.35, w.aside), some(0.15, w.advert), some(0.15, w.navigation), some(0.8, w.footer), some(0.1, w.notice)]
    if rng.random() < 0.15:
        top.append(w.aside())
    head = f"<!DOCTYPE html><html><head><title>{w.words(1, 5)}</title><style>p{{}}</style></head><body>"
    page = "".join(top) + main + "".join(end)
    if rng.random() < 0.1:
        # some servers wrap the whole page in a form
        page = f"<form method='post' action='./' id='{rng.choice(['form1', 'aspnetForm', 'page'])}'>{page}</form>"
    return head + page + ("</body></html>" if rng.random() < 0.8 else "")


def labelled(html: str) -> tuple[list[Block], np.ndarray]:
    """Blocks of a training page without their marks, and which are main text."""
    page = blocks(html)
    y = np.array([MARK in b.text for b in page], np.float32)
    return [replace(b, text=b.text.replace(MARK, "")) for b in page], y


# --- the labeller ---------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over block vectors with one output per block."""

    def __init__(self, hidden: int = HIDDEN, seed: int = SEED):
        rng, h = np.random.default_rng(seed), hidden
        draw = lambda *s: (rng.standard_normal(s) / s[0] ** 0.5).astype(np.float32)
        self.w: dict[str, np.ndarray] = {}
        for d in ("f", "b"):
            self.w |= {f"x{d}": draw(WIDTH, 4 * h), f"h{d}": draw(h, 4 * h), f"c{d}": np.zeros(4 * h, np.float32)}
            self.w[f"c{d}"][h : 2 * h] = 1  # forget gates begin open
        self.w |= {"o": draw(2 * h, 1), "p": np.zeros(1, np.float32)}

    def project(self, x: np.ndarray, d: str) -> np.ndarray:
        """What the vectors add to the gates of one direction."""
        return x @ self.w[f"x{d}"] + self.w[f"c{d}"]

    def _run(self, pre: np.ndarray, mask: np.ndarray, d: str, keep: bool = False):
        """States (time, page, hidden) of one direction; pre: (time, page, gates)."""
        steps, pages, _ = pre.shape
        h = self.w[f"h{d}"].shape[0]
        state, cell = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
        out, tape = np.zeros((steps, pages, h), np.float32), {}
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + state @ self.w[f"h{d}"]
            gates, new = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            m = mask[t][:, None]
            before, last = cell, state
            made = f * cell + i * new
            squashed = np.tanh(made)
            # beyond a page's end, its state stays as it is
            cell, state = m * made + (1 - m) * cell, m * o * squashed + (1 - m) * state
            out[t] = state
            if keep:
                tape[t] = (i, f, o, new, before, squashed, last, m)
        return out, tape

    def power(self, pre: dict[str, np.ndarray], mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(pre[d], mask, d)[0] for d in ("f", "b")], axis=2)
        return (both @ self.w["o"])[:, :, 0] + self.w["p"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        runs = {d: self._run(self.project(x, d), mask, d, keep=True) for d in ("f", "b")}
        both = np.concatenate([runs[d][0] for d in ("f", "b")], axis=2)
        p = _sigmoid((both @ self.w["o"])[:, :, 0] + self.w["p"])
        n = mask.sum()
        loss = -(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n
        error = (mask * (p - y) / n)[:, :, None]
        g = {"o": np.einsum("tph,tpk->hk", both, error), "p": error.sum((0, 1))}
        steps, pages, _ = x.shape
        h = self.w["hf"].shape[0]
        for k, d in enumerate(("f", "b")):
            wanted = error * self.w["o"][k * h : (k + 1) * h, 0]
            dz, dh, dc = np.zeros((steps, pages, 4 * h), np.float32), np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
            gh = np.zeros_like(self.w[f"h{d}"])
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                i, f, o, new, before, squashed, last, m = runs[d][1][t]
                dh = dh + wanted[t]
                d_out = dh * m
                d_made = d_out * o * (1 - squashed**2) + dc * m
                dz[t] = np.concatenate([d_made * new * i * (1 - i), d_made * before * f * (1 - f), d_out * squashed * o * (1 - o), d_made * i * (1 - new**2)], axis=1)
                gh += last.T @ dz[t]
                dh, dc = dz[t] @ self.w[f"h{d}"].T + dh * (1 - m), d_made * f + dc * (1 - m)
            flat = dz.reshape(steps * pages, -1)
            g |= {f"x{d}": x.reshape(steps * pages, -1).T @ flat, f"h{d}": gh, f"c{d}": flat.sum(0)}
        return float(loss), g

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page's vectors, which of its blocks are main text."""
        return self._labelled([{d: self.project(x, d) for d in ("f", "b")} for x in pages])

    def label_blocks(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text."""
        every = []
        for page in pages:
            pieces = [vectors(page, at, at + PIECE) for at in range(0, max(1, len(page)), PIECE)]
            every.append({d: np.concatenate([self.project(x, d) for x in pieces]) for d in ("f", "b")})
        return self._labelled(every)

    def _labelled(self, pages: list[dict[str, np.ndarray]]) -> list[np.ndarray]:
        sizes = [len(p["f"]) for p in pages]
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order, at = sorted(range(len(pages)), key=lambda k: sizes[k]), 0
        while at < len(order):
            # pages of similar length together, few enough for the padded size
            end = at + 1
            while end < len(order) and sizes[order[end]] * (end + 1 - at) <= PADDED:
                end += 1
            group = order[at:end]
            if sizes[group[-1]]:
                padded = {d: _padded([pages[k][d] for k in group]) for d in ("f", "b")}
                power = self.power({d: x for d, (x, _) in padded.items()}, padded["f"][1])
                for j, k in enumerate(group):
                    out[k] = power[: sizes[k], j] > 0
            at = end
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def train(steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Labeller:
    """Fit a labeller to synthetic pages (Adam, a new batch each step)."""
    rng, model = random.Random(seed), Labeller(seed=seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pages = []
        while len(pages) < batch:
            page, y = labelled(synthetic_page(rng))
            if 0 < len(page) <= 64:
                pages.append((vectors(page), y))
        x, mask = _padded([v for v, _ in pages])
        target = np.zeros_like(mask)
        for k, (_, y) in enumerate(pages):
            target[: len(y), k] = y
        _, g = model.gradients(x, mask, target)
        norm = sum(float((v**2).sum()) for v in g.values()) ** 0.5
        pace = rate * min(1, 2 * (1 - step / (steps + 1))) * min(1, 1 / (norm + 1e-9))
        for k, v in g.items():
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v**2
            model.w[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


_TRAINED: list[Labeller] = []


def trained() -> Labeller:
    if not _TRAINED:
        _TRAINED.append(train())
    return _TRAINED[0]


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    """Main text of each page."""
    found = [blocks(p) for p in pages]
    kept = model.label_blocks(found)
    return ["\n".join(b.text for b, ok in zip(p, k, strict=True) if ok) for p, k in zip(found, kept, strict=True)]


_SLAB = 64


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _SLAB):
                part = b.slice(at, _SLAB)
                texts = main_texts(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(given.dtypes)
    return given.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
