"""Main-text extraction by a recurrent block labeller.

A page becomes its sequence of leaf blocks. Each block is a vector of its tag path (hashed tags, classes and ids of all
open elements and of inline elements inside, and whether most of its text is in links) and of its hashed words. A bidirectional LSTM in numpy reads
the whole sequence and labels every block as main text or not, so a block is judged by all blocks before and after it.

No labelled pages exist here, so the model is trained on the driver on pages that page_of() composes from common page
parts with known labels (a fixed seed, the same model in every run); its size does not depend on the input. A part of the pages has no telling
names: other tags, classes without meaning, an article without an element of its own or in a table cell.

Long pages are read in windows with the LSTM's state carried on, forward and backward, so a page of any length costs one window of vectors and a number for each
block, and its labels are the same.

Defined results: null or empty html gives empty text. Markup that ends early counts up to its end; an unclosed tag at the
end is dropped. Scripts, styles, templates, form fields and comments never become blocks; formulas and the content of embedded elements are text. White
space is what str.split() splits at. A block at the threshold itself is kept. Repeated rows get equal texts; other columns pass through, one named as the
output is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm.common import U64, map_texts, word_hashes

PATH_DIMS, WORD_DIMS, HIDDEN, WINDOW = 256, 32, 16, 4096
INPUT = PATH_DIMS + WORD_DIMS + 3
RAW = frozenset("script style template textarea select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics annotation"
    " svg g path circle rect line polygon polyline ellipse text tspan defs use object canvas iframe embed audio video picture".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
BLOCKS_CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[a-zA-Z/][^<>]*\Z", re.S)
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


@lru_cache(maxsize=1 << 14)
def _tokens(tag: str, attrs: str) -> tuple[str, ...]:
    out = [tag]
    for _, a, b, c in _NAME.findall(attrs):
        for w in re.split(r"[^a-z]+", (a or b or c).lower()):
            if w:
                out.append("." + w)
    return tuple(out)


def blocks(page: object) -> list[tuple[str, tuple[str, ...]]]:
    """(text, tag-path tokens) of each leaf block, in page order; blocks without text are left out."""
    if not isinstance(page, str) or not page:
        return []
    out: list[tuple[str, tuple[str, ...]]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    inner: list[tuple[str, ...]] = []
    at, raw, links, linked = 0, "", 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                mark = ("@linked",) if 2 * linked > sum(len(p.strip()) for p in parts) else ()
                out.append((text, tuple(t for _, own in stack for t in own) + tuple(t for own in dict.fromkeys(inner) for t in own) + mark))
            parts.clear()
        inner.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text.strip())

    for m in _TAG.finditer(page):
        if raw:
            if m[2] is None and m[5] is None or (m[2] or m[5]).lower() != raw or not (m[1] or m[4]):
                continue
            raw, at = "", m.end()
            continue
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        close, attrs = m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if not close:
                raw = tag
                at = _raw_end(page, m.end(), tag)
                if at == len(page):
                    break
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if close else 1
            if tag == "br":
                parts.append(" ")
            elif not close:
                inner.append(_tokens(tag, attrs))
            continue
        flush()
        if close:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        shut = CLOSES.get(tag, {"p"} if tag in BLOCKS_CLOSE_P else set())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in shut:
                del stack[k:]
                if stack[k - 1 : k] and stack[-1][0] not in shut:
                    break
            elif stack[k][0] in SCOPE.get(tag, BLOCKS_CLOSE_P):
                break
        if tag not in VOID:  # a slash at the end of a tag closes nothing
            stack.append((tag, _tokens(tag, attrs)))
    if not raw and at < len(page):
        add(page[at:])
    flush()
    return out


def _raw_end(page: str, start: int, tag: str) -> int:
    """Where the raw element's closing tag begins; the end of the page if it never closes."""
    m = re.compile(rf"</{tag}\b", re.I).search(page, start)
    return m.start() if m else len(page)


@lru_cache(maxsize=1 << 14)
def _path_vector(tokens: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_DIMS, np.float32)
    for t in set(tokens):
        v[zlib.crc32(t.encode()) % PATH_DIMS] = 1.0
    return v


def vectors(page_blocks: list[list[tuple[str, tuple[str, ...]]]]) -> np.ndarray:
    """(block, INPUT) of all blocks of all pages."""
    flat = [b for page in page_blocks for b in page]
    x = np.zeros((len(flat), INPUT), np.float32)
    if not flat:
        return x
    words, offsets = word_hashes([t for t, _ in flat])
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(flat)), counts)
    hashed = np.bincount(owner * WORD_DIMS + (words & U64(WORD_DIMS - 1)).astype(np.int64), minlength=len(flat) * WORD_DIMS).reshape(-1, WORD_DIMS)
    for i, (_, tokens) in enumerate(flat):
        x[i, :PATH_DIMS] = _path_vector(tokens)
    x[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = 0.3 * hashed / np.maximum(1, counts)[:, None]
    x[:, -3] = np.log1p(counts) / 5
    x[:, -2] = [t[-1] in ".!?:;" for t, _ in flat]
    x[:, -1] = 1.0
    return x


class BiLSTM:
    """Two LSTM passes of HIDDEN units and a logistic output; weights in a flat dict."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 0.15, (INPUT, 4 * HIDDEN)).astype(np.float32)
            self.w[f"h{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.w[f"c{d}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
        self.w["o"] = rng.normal(0, 0.3, 2 * HIDDEN + INPUT).astype(np.float32)

    @staticmethod
    def _sig(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, state: tuple[np.ndarray, np.ndarray] | None = None):
        steps, batch = mask.shape
        pre = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = state or (np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32))
        out, tape = np.zeros((steps, batch, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.w[f"h{d}"]
            s = self._sig(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = (f * c + i * g) * m
            tc = np.tanh(c2)
            h2 = o * tc * m
            if keep:
                tape.append((t, h, c, i, f, o, g, tc, m))
            h, c = h2, c2
            out[t] = h
        return out, tape, (h, c)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: (step, page, INPUT), mask: (step, page). (probability of main text, what backward() needs)."""
        hf, tf, _ = self._pass(x, mask, "f", keep)
        hb, tb, _ = self._pass(x, mask, "b", keep)
        top = np.concatenate([hf, hb, x], axis=2)
        return self._sig(top @ self.w["o"]), (top, tf, tb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        p, (top, tf, tb) = self.forward(x, mask, keep=True)
        n = mask.sum()
        err = ((p - y) * mask / n).astype(np.float32)
        grad = {"o": np.tensordot(err, top, 2)}
        for d, tape, dh_all in (("f", tf, err[:, :, None] * self.w["o"][:HIDDEN]), ("b", tb, err[:, :, None] * self.w["o"][HIDDEN : 2 * HIDDEN])):
            gx, gh, gc = (np.zeros_like(self.w[k + d]) for k in "xhc")
            dh, dc = np.zeros_like(dh_all[0]), np.zeros_like(dh_all[0])
            for t, h, c, i, f, o, g, tc, m in reversed(tape):
                dht = (dh + dh_all[t]) * m
                dct = (dc + dht * o * (1 - tc * tc)) * m
                dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dht * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1)
                gx += x[t].T @ dz
                gh += h.T @ dz
                gc += dz.sum(axis=0)
                dh, dc = dz @ self.w[f"h{d}"].T, dct * f
            grad |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
        loss = -(np.log(np.where(y > 0.5, p, 1 - p) + 1e-9) * mask).sum() / n
        return grad, float(loss)

    def label_long(self, page: list[tuple[str, tuple[str, ...]]], window: int = WINDOW) -> np.ndarray:
        """Probability of each block of one page, by windows of `window` blocks."""
        logit, starts = np.zeros(len(page), np.float32), range(0, len(page), window)
        o = self.w["o"]
        for d, order, part in (("f", starts, o[:HIDDEN]), ("b", reversed(starts), o[HIDDEN : 2 * HIDDEN])):
            state = None
            for a in order:
                x = vectors([page[a : a + window]])[:, None, :]
                h, _, state = self._pass(x, np.ones(x.shape[:2], np.float32), d, False, state)
                logit[a : a + window] += h[:, 0] @ part + (x[:, 0] @ o[2 * HIDDEN :] if d == "f" else 0)
        return self._sig(logit)

    def label(self, pages: list[list[tuple[str, tuple[str, ...]]]], cells: int = 1 << 17) -> list[np.ndarray]:
        """Probability of each block of each page. Pages of like length go together, at most `cells` vectors at a time."""
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and (j == i or len(pages[order[j]]) * (j - i + 1) * INPUT <= cells * 16):
                j += 1
            group = [k for k in order[i:j] if pages[k]]
            i = j
            if group and len(pages[group[-1]]) > WINDOW:
                for k in group:
                    out[k] = self.label_long(pages[k])
            elif group:
                x, mask = padded([pages[k] for k in group])
                p, _ = self.forward(x, mask)
                for col, k in enumerate(group):
                    out[k] = p[: len(pages[k]), col]
        return out


def padded(pages: list[list[tuple[str, tuple[str, ...]]]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(p) for p in pages]
    flat = vectors(pages)
    x = np.zeros((max(sizes), len(pages), INPUT), np.float32)
    mask = np.zeros((max(sizes), len(pages)), np.float32)
    at = 0
    for k, n in enumerate(sizes):
        x[:n, k], mask[:n, k] = flat[at : at + n], 1
        at += n
    return x, mask


@lru_cache(maxsize=1)
def _words(n: int = 5000) -> list[str]:
    """Invented words of one to four syllables."""
    rng = np.random.default_rng(9)
    syllables = ["an", "el", "or", "ti", "se", "ma", "ru", "ko", "in", "ed", "th", "ou", "ch", "ä", "é", "ñ"]
    return ["".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(n)]


def page_of(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A composed page and the label of each of its blocks: 1 for main text."""
    pool = _words()
    labels: list[int] = []
    word = lambda: pool[rng.integers(len(pool))]

    def say(lo: int, hi: int, label: int, dot: bool = True) -> str:
        labels.append(label)
        return " ".join(pool[i] for i in rng.integers(0, len(pool), rng.integers(lo, hi))).capitalize() + ("." if dot else "")

    pick = lambda *xs: xs[rng.integers(len(xs))]
    plain = rng.random() < 0.45  # a page whose furniture and article have no telling names

    def name(*xs: str) -> str:
        if plain:
            made = pick(word(), f"x{rng.integers(1, 30)}", f"{word()}-{word()}", f"c{rng.integers(100, 999)}")
            return pick("", f' class="{made}"', f' class={made}', f' id="{made}"', f' class="{made} {word()}"')
        return pick(*[f' class="{x}"' for x in xs], *[f' id="{x}"' for x in xs], f' class="{pick("box", "wrap", "col")} {xs[0]}"')

    def wrapped(inner: str, tag: str, attrs: str = "") -> str:
        """inner in the element, on plain pages often in another one."""
        if plain and rng.random() < 0.7:
            tag, attrs = pick("div", "div", "section", "td"), name("x")
        if tag == "td":
            return f"<table><tr><td{attrs}>{inner}</td></tr></table>"
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def links(n: int, tag: str = "ul") -> str:
        items = "".join(f'<li><a href="/{word()}">{say(1, 4, 0, False)}</a></li>' for _ in range(n))
        return f"<{tag}>{items}</{tag}>"

    def menu() -> str:
        return pick(
            lambda: wrapped(links(rng.integers(2, 9)), "nav"), lambda: f"<div{name('menu', 'navbar', 'nav', 'breadcrumb')}>{links(rng.integers(2, 8))}</div>",
            lambda: wrapped(f"<a href='/'>{say(1, 3, 0, False)}</a> {pick('', '| ')}<a href='/x'>{word()}</a>", "nav"))()

    def header() -> str:
        return wrapped(f"<div{name('logo', 'site-title', 'banner')}>{say(1, 5, 0, False)}</div>" + pick(lambda: menu(), lambda: f"<p>{say(3, 12, 0)}</p>" if not plain else "", lambda: "")(), "header")

    def telling(make: Callable[[], str]) -> Callable[[], str]:
        """Parts of prose that only their names tell from the article keep them on plain pages."""

        def run() -> str:
            nonlocal plain
            before, plain = plain, False
            out = make()
            plain = before
            return out

        return run

    @telling
    def advert() -> str:
        return f"<div{name('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner-ad')}>{pick(lambda: say(3, 30, 0), lambda: f'<p>{say(3, 40, 0)}</p><a href=x>{say(1, 4, 0, False)}</a>')()}</div>"

    @telling
    def notice() -> str:
        return f"<div{name('cookie', 'cookie-banner', 'notice', 'consent', 'gdpr', 'popup', 'modal', 'newsletter', 'alert')}><p>{say(5, 40, 0)}</p>{pick(lambda: f'<button>{say(1, 3, 0, False)}</button>', lambda: '')()}</div>"

    @telling
    def form() -> str:
        return f"<form{pick('', ' class=search', ' id=subscribe')}><p>{say(2, 12, 0)}</p><input type=text><button>{say(1, 3, 0, False)}</button></form>"

    def sidebar() -> str:
        tag, attrs = pick(("aside", ""), ("aside", name("sidebar", "related")), ("div", name("sidebar", "related", "widget", "share", "social", "recommended")))
        if plain and tag == "div":  # without names, only links tell a side box from the article
            return f"<{tag}{attrs}>{f'<h3>{say(1, 4, 0, False)}</h3>' if rng.random() < 0.5 else ''}{links(rng.integers(2, 7))}</{tag}>"
        body = "".join(pick(lambda: f"<h3>{say(1, 5, 0, False)}</h3>", lambda: links(rng.integers(1, 6)), lambda: f"<p>{say(4, 50, 0)}</p>")() for _ in range(rng.integers(1, 4)))
        return f"<{tag}{attrs}>{body}</{tag}>"

    @telling
    def comments() -> str:
        tag = pick("section", "div")
        head = pick(lambda: f"<h2>{say(1, 4, 0, False)}</h2>", lambda: "")()
        one = lambda: pick(lambda: f"<div{name('comment', 'comment-body', 'reply')}><p>{say(3, 60, 0)}</p></div>", lambda: f"<li class=comment><p>{say(3, 60, 0)}</p></li>", lambda: f"<article class=comment><p>{say(3, 60, 0)}</p></article>", lambda: f"<p>{say(3, 60, 0)}</p>")()
        return f"<{tag}{name('comments', 'comment-list', 'discussion', 'responses', 'disqus')}>{head}{''.join(one() for _ in range(rng.integers(1, 5)))}</{tag}>"

    def footer() -> str:
        if plain:
            line = pick("&copy; ", "© 2024 ", "Copyright ") + say(1, 10, 0)
            return wrapped(line + (links(rng.integers(1, 5)) if rng.random() < 0.3 else ""), "div", name("x"))
        return pick(lambda: f"<footer>&copy; {say(1, 14, 0)}</footer>", lambda: f"<footer><p>{say(3, 25, 0)}</p>{links(rng.integers(1, 5))}</footer>", lambda: f"<div{name('footer', 'copyright', 'legal')}>{say(3, 20, 0)}</div>")()

    def main() -> str:
        body = [f"<h1>{say(2, 14, 1, False)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.integers(1, 18)):
            body.append(pick(
                *[lambda: f"<p>{say(1, 120, 1, rng.random() < 0.85)}</p>"] * 8, lambda: f"<p><b>{say(1, 20, 1)}<br>", lambda: f"<h2>{say(1, 8, 1, False)}</h2>",
                lambda: "<ul>" + "".join(f"<li>{say(1, 25, 1, rng.random() < 0.5)}</li>" for _ in range(rng.integers(1, 5))) + "</ul>",
                lambda: f"<blockquote>{say(5, 50, 1)}</blockquote>", lambda: f"<pre>{say(2, 20, 1, False)}</pre>", lambda: f"<div>{say(3, 60, 1)}</div>",
                lambda: f"<figure><figcaption>{say(2, 15, 1)}</figcaption></figure>", lambda: f"<table><tr><td>{say(1, 6, 1, False)}</td><td>{say(1, 6, 1, False)}</td></tr></table>",
            )())
            if rng.random() < 0.06:
                body.append(pick(advert, sidebar, form, notice)())
        inner = "".join(body)
        if plain or rng.random() < 0.12:  # no element of its own, a nameless one, a table cell
            wrap = pick("none", "div", "div", "section", "td", "two", "article", "main")
            if wrap == "none":
                return f"<div></div>{inner}"
            if wrap == "td":
                before = f"<td{name('x')}>{links(0)}</td>"
                return f"<table><tr>{before}<td{name('x')}>{inner}</td></tr></table>"
            return f"<div><div{name('x')}>{inner}</div></div>" if wrap == "two" else f"<{wrap}{name('x') if wrap != 'article' else ''}>{inner}</{wrap}>"
        # an open <p><b> at the end is closed by what follows
        tag, attrs = pick(("article", ""), ("article", ""), ("article", name("post", "entry")), ("main", ""), ("div", name("content", "article", "post", "entry-content", "story")), ("section", name("content", "article-body")))
        return f"<{tag}{attrs}>{inner}</{tag}>"

    parts = ["<!DOCTYPE html><html><head>", f"<title>{say(2, 12, 0, False)}</title>", "<style>p{margin:0}</style></head><body>"]
    for make, chance in ((header, 0.4), (menu, 0.75), (notice, 0.25), (advert, 0.45), (form, 0.12), (sidebar, 0.2)):
        if rng.random() < chance:
            parts.append(make())
    if plain and rng.random() < 0.2:  # a table layout: the menu in the cell beside the article's
        cell = f"<td{name('x')}>{links(rng.integers(2, 8))}</td>"
        body = main()
        parts.append(f"<table><tr>{cell}<td{name('x')}>{body}</td></tr></table>")
    else:
        parts.append(main())
    for make, chance in ((comments, 0.35), (sidebar, 0.3), (advert, 0.25), (form, 0.15), (notice, 0.15), (footer, 0.75)):
        if rng.random() < chance:
            parts.append(make())
    return "".join(parts) + "</body></html>", labels


def train(pages: int = 1500, epochs: int = 14, batch: int = 32, rate: float = 0.012, seed: int = 5) -> BiLSTM:
    """A labeller fitted by Adam on composed pages."""
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(pages):
        page, labels = page_of(rng)
        got = blocks(page)
        if len(got) == len(labels):
            data.append((got, labels))
    if len(data) < 0.9 * pages:
        raise RuntimeError(f"only {len(data)} of {pages} composed pages parse to their own blocks")
    model = BiLSTM()
    m1 = {k: np.zeros_like(v) for k, v in model.w.items()}
    m2 = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][0]))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for g in rng.permutation(len(groups)):
            chosen = [data[i] for i in groups[g]]
            x, mask = padded([c[0] for c in chosen])
            y = np.zeros_like(mask)
            for k, (_, labels) in enumerate(chosen):
                y[: len(labels), k] = labels
            grad, _ = model.gradients(x, mask, y)
            step += 1
            now = rate * (1 - 0.9 * epoch / epochs)
            norm = float(np.sqrt(sum((v * v).sum() for v in grad.values())))
            for k, v in grad.items():
                v = v * min(1.0, 1.0 / max(norm, 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                model.w[k] -= now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return model


@lru_cache(maxsize=1)
def default_model() -> BiLSTM:
    return train()


def extract(pages: DataFrame, model: BiLSTM | None = None, threshold: float = 0.5, *, html: str = "html", text: str = "text") -> DataFrame:
    """pages with html replaced by the main text in column `text`; other columns stay. A narrow scan."""
    held = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def make() -> Callable[[list], list]:
        lstm = held.value

        def go(texts: list) -> list:
            found = [blocks(h) for h in texts]
            keep = lstm.label(found)
            return [["\n".join(t for (t, _), p in zip(b, s, strict=True) if p >= threshold) for b, s in zip(found, keep, strict=True)]]

        return go

    return map_texts(pages, html, make, {text: ("string", pa.string())}, drop_text=html != text, rows=256)
