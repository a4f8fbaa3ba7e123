"""Main text of pages by a linear-chain conditional random field over leaf blocks.

Each block is labelled content or boilerplate, from features of its ancestors'
tags and class words and of its text, together with its neighbours' labels. The
field is trained by stochastic gradient ascent of the likelihood on labelled
pages and decoded by Viterbi. Labelled pages are a bounded sample of the pages
at hand (``sample``) whose markup marks the article, each taken once with that mark
and once without it, and generated pages in many layouts whose labels are known,
filled with the sample's sentences.

Defined results: a null or empty page, and a page without content blocks, has
the empty text; broken markup is read as far as it goes; repeated rows give the
same text each; an empty table gives no rows; further columns are ignored;
nothing of a content block is capped.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from html import escape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemloom.llm.html_blocks import WORD, Block, blocks
from stemloom.llm.store import chosen, fitted

FEATURES = 1 << 13
# fixed values: names that page templates give to the parts of a page
CONTENT_NAMES = "content article post entry story body main text page post-content article-body entry-content story-body main-content".split()
NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav main-menu site-nav".split(),
    "header": "header masthead site-header page-header branding topbar banner".split(),
    "footer": "footer site-footer copyright legal colophon bottom".split(),
    "aside": "sidebar aside widget related recommended popular share social tags sidebar-right".split(),
    "notice": "cookie cookies consent notice alert gdpr popup modal cookie-banner paywall".split(),
    "ad": "ad ads advert advertisement sponsored promo promotion adsense sponsor".split(),
    "form": "form newsletter subscribe login signup search contact search-form".split(),
    "comments": "comments comment comment-list reader-comments discussion respond replies comment-body disqus".split(),
}
TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "notice": ["div", "section"], "ad": ["div", "aside", "section"], "form": ["form", "div"], "comments": ["section", "div", "ol"]}


def features(page: list[Block]) -> list[list[int]]:
    """Buckets of each block's features."""
    out = []
    held: dict[tuple[tuple[str, str], ...], list[str]] = {}
    for k, b in enumerate(page):
        if b.path not in held:
            names = {f"t:{t}" for t, _ in b.path} | {f"c:{w.lower()}" for _, n in b.path if n for w in WORD.findall(n)}
            last = b.path[-1] if b.path else ("", "")
            inner = next((t for t, _ in reversed(b.path) if t not in ("p", "li", "ul", "ol", "blockquote")), "")
            held[b.path] = [*names, f"o:{last[0]}", f"i:{inner}", f"d:{min(8, len(b.path))}"]
        n = len(b.text)
        own = [f"n:{n.bit_length()}", f"l:{int(b.linked * 4)}", f"e:{b.text[-1] in '.!?:;'}", f"s:{k == 0}", f"z:{k == len(page) - 1}", f"m:{'©' in b.text}", "1"]
        out.append([crc32(f.encode()) % FEATURES for f in [*held[b.path], *own]])
    return out


def forward_backward(u: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the labels and of neighbouring pairs."""
    n = len(u)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    a[0] = u[0]
    for k in range(1, n):
        a[k] = u[k] + np.logaddexp(a[k - 1, 0] + t[0], a[k - 1, 1] + t[1])
    for k in range(n - 2, -1, -1):
        x = u[k + 1] + b[k + 1]
        b[k] = np.logaddexp(t[:, 0] + x[0], t[:, 1] + x[1])
    z = np.logaddexp(*a[-1])
    pair = np.exp(a[:-1, :, None] + t[None] + (u[1:] + b[1:])[:, None, :] - z)
    return np.exp(a + b - z), pair.sum(0) if n > 1 else np.zeros((2, 2))


def viterbi(u: np.ndarray, t: np.ndarray) -> list[int]:
    best, back = u[0], []
    for x in u[1:]:
        score = best[:, None] + t
        back.append(score.argmax(0))
        best = score.max(0) + x
    path = [int(best.argmax())]
    for p in reversed(back):
        path.append(int(p[path[-1]]))
    return path[::-1]


def fit(pages: list[tuple[list[list[int]], list[int]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    w, t = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    pages = [p for p in pages if p[0]]
    for k in range(epochs):
        step = rate / (1 + k)
        for i in rng.permutation(len(pages)):
            x, y = pages[i]
            u = np.array([w[f].sum(0) for f in x])
            p, pair = forward_backward(u, t)
            for f, m, label in zip(x, p, y, strict=True):
                g = -m
                g[label] += 1
                w[f] += step * (g - decay * w[f])
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:-1], y[1:]), 1)
            t += step * 0.1 * (seen - pair)
    return w, t


def generated(sentences: list[str], n: int, seed: int = 11) -> Iterator[tuple[str, list[str]]]:
    """Pages in many layouts, with their content blocks in order."""
    r = random.Random(seed)
    words = " ".join(sentences).split() or ["word"]
    few = lambda a, b: " ".join(r.choice(words) for _ in range(r.randint(a, b)))
    para = lambda: " ".join(r.choice(sentences) for _ in range(r.randint(1, 4))) if sentences and r.random() < 0.8 else few(1, 40)

    def junk(kind: str) -> str:
        tag = r.choice(TAGS[kind])
        name = f' class="{r.choice(NAMES[kind])}"' if tag in ("div", "section", "ul", "ol") or r.random() < 0.4 else ""
        if kind == "nav" or kind == "aside" and r.random() < 0.4:
            items = "".join(f'<li><a href="/x">{escape(few(1, 3))}</a></li>' for _ in range(r.randint(2, 7)))
            inner = items if tag in ("ul", "ol") else f"<ul>{items}</ul>"
        elif kind == "comments":
            item = "li" if tag == "ol" else "div"
            inner = "".join(f'<{item} class="comment"><p>{escape(para())}</p></{item}>' for _ in range(r.randint(1, 4)))
        elif kind == "form":
            inner = f"<label>{few(1, 3)}</label><input name=q><button>{few(1, 2)}</button>" + (f"<p>{escape(few(3, 12))}</p>" if r.random() < 0.5 else "")
        elif kind == "footer" and r.random() < 0.5:
            inner = f"&copy; {few(1, 2)} &middot; {few(2, 8)}"
        else:
            inner = escape(para()) if r.random() < 0.4 else f"<p>{escape(para())}</p>"
        return f"<{tag}{name}>{inner}</{tag}>"

    for _ in range(n):
        truth: list[str] = []

        def good(truth: list[str] = truth) -> str:
            text = para()
            truth.append(" ".join(text.split()))
            tag = r.choice(["p"] * 8 + ["h2", "blockquote", "li"])
            return f"<ul><li>{escape(text)}</li></ul>" if tag == "li" else f"<{tag}>{escape(text)}</{tag}>"

        head = [junk(k) for k in ("notice", "header", "nav", "ad") if r.random() < 0.6]
        inside = []
        if r.random() < 0.8:
            title = few(2, 9)
            truth.append(title)
            inside.append(f"<h1>{escape(title)}</h1>")
        for _ in range(r.randint(1, 9)):
            inside.append(good())
            if r.random() < 0.12:
                inside.append(junk(r.choice(["ad", "aside", "form", "notice", "comments"])))
        outer = r.choice(["article", "article", "main", "div", "section"])
        name = f' class="{r.choice(CONTENT_NAMES)}"' if outer in ("div", "section") or r.random() < 0.3 else ""
        body = f"<{outer}{name}>{''.join(inside)}</{outer}>"
        if r.random() < 0.4:
            body = f'<{r.choice(["main", "div"])} class="{r.choice(["wrapper", "container", "layout", "main"])}">{body}{junk(r.choice(["aside", "comments"])) if r.random() < 0.5 else ""}</div>'
        tail = [junk(k) for k in ("comments", "aside", "form", "ad", "footer") if r.random() < 0.5]
        yield f"<html><body>{''.join(head)}{body}{''.join(tail)}</body></html>", truth


def marked(page: list[Block]) -> list[int] | None:
    """Labels from markup: content is what stands in an article and in nothing marked as something else; None without one."""
    if not any(t == "article" for b in page for t, _ in b.path):
        return None
    other = {w for k in NAMES for w in NAMES[k]}
    return [int(any(t == "article" for t, _ in b.path) and not any(t in ("nav", "aside", "footer", "form", "header") or set(n.lower().split()) & other for t, n in b.path)) for b in page]


def learnt(pages: list[str], made: int) -> tuple[np.ndarray, np.ndarray]:
    known, sentences = [], []
    for html in pages:
        page = blocks(html)
        labels = marked(page)
        if labels:
            known.append((features(page), labels))
            # once more without the mark, so that what stands around and in an article must tell it too
            known.append((features([b._replace(path=tuple(("div", "") if t == "article" else (t, n) for t, n in b.path)) for b in page]), labels))
            sentences += [s for b, y in zip(page, labels, strict=True) if y for s in b.text.split(". ")][:40]
    for html, truth in generated(sentences, made):
        page, at, labels = blocks(html), 0, []
        for b in page:
            hit = at < len(truth) and b.text == truth[at]
            at += hit
            labels.append(int(hit))
        if at == len(truth):
            known.append((features(page), labels))
    return fit(known)


def train(pages: DataFrame, sample: int = 150, made: int = 450) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions from at most ``sample`` distinct pages of any length, the ones of least hash, and ``made`` generated ones; from fewer pages where they exceed ``store.BYTES``."""
    rows = pages.select(F.col("html").cast("string").alias("html")).where(F.col("html").isNotNull()).select(F.xxhash64("html").alias("h"), "html")
    ids, most = chosen(rows.select("h", F.octet_length("html").alias("size")).distinct(), sample)
    some = rows.join(F.broadcast(ids.select("h").distinct()), "h", "left_semi").dropDuplicates(["h", "html"])

    def run(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return learnt(t.sort_by([("h", "ascending"), ("html", "ascending")]).column("html").to_pylist()[:most], made)

    return tuple(fitted(some, run))


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # of fixed size
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = []
                for html in part.column(2).to_pylist():
                    page = blocks(html or "")
                    kept = viterbi(np.array([w[f].sum(0) for f in features(page)]), t) if page else []
                    texts.append("\n".join(b.text for b, y in zip(page, kept, strict=True) if y))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
