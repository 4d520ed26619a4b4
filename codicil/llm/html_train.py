"""Training of the block labeller on composed pages: ``python -m codicil.llm.html_train``.

Pages are composed from random invented words in varied layouts: semantic tags or plain divisions, helpful,
useless or no class tokens, boilerplate as long as prose and prose as short as a line. Labels come from the
composition. Training is deterministic for a seed; back-propagation through time and Adam are written in NumPy.
"""

from __future__ import annotations

import random

import numpy as np

from codicil.llm import html_blocks as hb

GOOD = "content post entry story article body main text page prose copy single post-content entry-content article-body articleBody main-content story-text blog-post".split()
#: Class tokens by kind of boilerplate.
BAD = {
    "nav": "nav menu navbar navigation main-menu site-nav top-nav breadcrumb breadcrumbs pagination pager skip-links toc tabs".split(),
    "head": "header site-header masthead topbar branding logo top-bar banner hero-bar".split(),
    "foot": "footer site-footer bottom colophon copyright legal foot page-footer".split(),
    "side": "sidebar side-bar widget widget-area related recommended more-links aside rail trending popular read-next also-like".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion ad-slot ad-box banner-ad partner adsense".split(),
    "notice": "cookie cookie-banner consent notice alert gdpr modal popup overlay warning message privacy-notice announcement".split(),
    "form": "form search search-form newsletter subscribe signup login contact-form subscription".split(),
    "comment": "comment comments comment-list comment-body reply respond discussion disqus responses user-comments feedback".split(),
    "share": "share social sharing share-buttons tags post-tags toolbar social-links".split(),
}
SEMANTIC = {"nav": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form", "ad": "aside"}
STOCK = "home about contact news search menu login sign up subscribe share tweet follow us privacy policy terms cookies accept all rights reserved read more next previous reply comments by posted in tags related advertisement sponsored newsletter email your name submit".split()


class Composer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        return "".join(r.choice(self.syllables) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))

    def sentence(self, n: int) -> str:
        words = [self.word() for _ in range(max(1, n))]
        text = "".join(w + (", " if self.r.random() < 0.06 else " ") for w in words).strip(", ")
        return text[:1].upper() + text[1:] + "."

    def prose(self) -> str:
        return " ".join(self.sentence(self.r.randint(2, 22)) for _ in range(self.r.choice((1, 1, 2, 3, 4, 6, 9))))

    def inline(self, text: str) -> str:
        r = self.r
        if r.random() < 0.35:
            words = text.split(" ")
            i = r.randrange(len(words))
            tag = r.choice(("b", "i", "em", "strong", "a", "span", "code"))
            words[i] = f'<{tag}{" href=x" if tag == "a" else ""}>{words[i]}' + (f"</{tag}>" if r.random() < 0.9 else "")
            text = " ".join(words)
        if r.random() < 0.15:
            text = text.replace(". ", ".<br>", 1)
        return text.replace("and", "&amp;") if r.random() < 0.1 else text

    def attrs(self, kind: str, tagged: float = 0.85) -> str:
        r = self.r
        pool = GOOD if kind == "good" else BAD[kind]
        names = [r.choice(pool)] if r.random() < tagged else []
        if r.random() < 0.3:
            names.append(r.choice(("x", "css", "col", "row", "block", "box", "wrap", "inner", "section", "module", "js")) + str(r.randint(1, 99)))
        r.shuffle(names)
        if not names:
            return ""
        key = "class" if r.random() < 0.75 else "id"
        return f' {key}="{" ".join(names)}"'

    def boiler(self, kind: str, out: list, inside: bool = False) -> None:
        """A boilerplate part; out gets strings, and (text,) for a text that must not be kept."""
        r = self.r
        semantic = kind in SEMANTIC and r.random() < 0.6
        tag = SEMANTIC[kind] if semantic else r.choice(("div", "div", "section", "ul") if not inside else ("div", "div", "aside"))
        out.append(f"<{tag}{self.attrs(kind, 0.6 if semantic else 1.0)}>")
        short = lambda: " ".join(r.choice((self.word(), r.choice(STOCK))) for _ in range(r.randint(1, 5)))
        style = {"nav": "links", "share": "links", "side": r.choice(("links", "prose", "mixed")), "form": "form"}.get(kind) or r.choice(("prose", "short", "mixed"))
        if style == "links":
            wrap = r.choice(("li", "li", "span", "p"))
            if wrap == "li" and tag != "ul":
                out.append("<ul>")
            for _ in range(r.randint(1, 9)):
                out.append(f'<{wrap}><a href="/{self.word()}">')
                out.append((short(),))
                out.append(f"</a></{wrap}>")
            if wrap == "li" and tag != "ul":
                out.append("</ul>")
        elif style == "form":
            for _ in range(r.randint(1, 3)):
                out += ["<label>", (short(),), "</label><input name=q>", r.choice(("<p>", "<div>")), (self.sentence(r.randint(2, 12)),)]
            out += ["<button>", (short(),), "</button>"]
        else:
            for _ in range(r.choice((1, 1, 2, 4)) if kind != "comment" else r.randint(1, 6)):
                inner = r.choice(("p", "p", "div", "span", "", ""))
                if kind == "comment" and r.random() < 0.6:
                    out += [f'<div class="{r.choice(BAD["comment"])}"><{r.choice(("h4", "div", "p"))}>', (self.word(),)]
                    inner = "p"
                text = self.prose() if style == "prose" or style == "mixed" and r.random() < 0.5 else short()
                if r.random() < 0.35:  # a line like one of the article's
                    text = self.sentence(r.choice((1, 1, 2, 3, 6, 10)))
                if kind == "foot" and r.random() < 0.6:
                    text = "&copy; " + text
                out += [f"<{inner}>" if inner else "", (self.inline(text),), f"</{inner}>" if inner else r.choice((" <hr>", ""))]
        out.append(f"</{tag}>")

    def page(self) -> tuple[str, list[tuple[str, bool]]]:
        """(html, [(text piece, whether it is main text), ...] in page order)."""
        r = self.r
        letters = r.choice(("aeiou", "aeiouäöü", "aeioué", "aeiouñ"))
        self.syllables = ["".join(r.choice(("bcdfghlmnprstvw", letters, "nrst")[k % 3]) for k in range(r.randint(1, 3))) for _ in range(40)]
        out: list = ["<!DOCTYPE html><html><head><meta charset=utf-8><title>" + self.sentence(5) + "</title>", r.choice(("", "<style>p{margin:0}</style>")), r.choice(("", '<script>var t="</p>";</script>')), "</head>", r.choice(("<body>", "<body>", '<body class="page">'))]
        wrapped = r.random() < 0.3
        if wrapped:
            out.append(f'<div class="{r.choice(("wrapper", "container", "site", "page", "layout"))}">')
        for kind in ("notice", "head", "nav", "ad", "form", "nav", "ad"):
            if r.random() < 0.45:
                self.boiler(kind, out)
        if r.random() < 0.2:
            self.boiler("side", out)
        style = r.random()
        if style < 0.45:
            tag, attrs = "article", self.attrs("good", 0.4)
        elif style < 0.6:
            tag, attrs = "main", self.attrs("good", 0.3)
        else:
            tag, attrs = r.choice(("div", "div", "section", "td")), self.attrs("good", 0.9)
        if tag == "td":
            out.append("<table><tr>")
        out.append(f"<{tag}{attrs}>")
        inner = r.random() < 0.2
        if inner:
            out.append(f"<div{self.attrs('good', 0.5)}>")
        good: list = []
        if r.random() < 0.85:
            h = r.choice(("h1", "h1", "h2"))
            out += [f"<{h}>", [self.sentence(r.randint(1, 12)).rstrip(r.choice((".", "")))], f"</{h}>"]
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14, 20))):
            kind = r.random()
            if kind < 0.72:
                out += ["<p>", [self.inline(r.choice((self.prose(), self.prose(), self.sentence(r.randint(1, 6)), self.word() + ".")))], r.choice(("</p>", "</p>", ""))]
            elif kind < 0.78:
                out += [f"<{(h := r.choice(('h2', 'h3')))}>", [self.sentence(r.randint(1, 7)).rstrip(".")], f"</{h}>"]
            elif kind < 0.85:
                out.append("<ul>")
                for _ in range(r.randint(2, 6)):
                    out += ["<li>", [self.inline(self.sentence(r.randint(1, 14)))], r.choice(("</li>", ""))]
                out.append("</ul>")
            elif kind < 0.9:
                out += [f"<{(q := r.choice(('blockquote', 'pre', 'figcaption', 'div')))}>", [self.sentence(r.randint(3, 20))], f"</{q}>"]
            elif kind < 0.93:
                out += ["<table><tr><td>", [self.word()], "</td><td>", [self.sentence(3)], "</td></tr></table>"]
            else:
                self.boiler(r.choice(("ad", "side", "share", "form", "notice")), out, True)
        if r.random() < 0.2:
            self.boiler(r.choice(("share", "comment", "side")), out, True)
        if inner:
            out.append("</div>")
        out.append(f"</{tag}>" + ("</tr></table>" if tag == "td" else ""))
        for kind in ("share", "comment", "side", "ad", "form", "nav", "foot", "notice"):
            if r.random() < (0.8 if kind == "foot" else 0.4):
                self.boiler(kind, out)
        if r.random() < 0.8:
            out.append(("</div>" if wrapped else "") + "</body></html>")
        del good
        pieces = [(x[0], isinstance(x, list)) for x in out if not isinstance(x, str)]
        return "".join(x if isinstance(x, str) else x[0] for x in out), pieces


def labelled(seed: int) -> tuple[list[hb.Block], np.ndarray]:
    """Blocks of a composed page and whether each is main text."""
    page, pieces = Composer(seed).page()
    marked = page
    own = hb.blocks(marked)
    want = [(" ".join(t.split()), good) for text, good in pieces for _, t, _ in hb.blocks(text)]
    labels, k = [], 0
    for _, text, _ in own:
        while k < len(want) and want[k][0] not in text:
            k += 1
        labels.append(want[k][1] if k < len(want) else False)
        k += k < len(want)
    return own, np.array(labels, bool)


def init(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    n = hb.PATH_DIM + hb.WORD_DIM + hb.LEAF_DIM + hb.MEASURES
    p = {"path": r.normal(0, 0.3, (hb.PATHS, hb.PATH_DIM)), "word": r.normal(0, 0.1, (hb.WORDS, hb.WORD_DIM)), "leaf": r.normal(0, 0.3, (hb.LEAVES, hb.LEAF_DIM)), "v": r.normal(0, 0.2, (2 * hb.HIDDEN, 1)), "c": np.zeros(1)}
    for d in "fb":
        p |= {f"w_{d}": r.normal(0, 1 / np.sqrt(n), (n, 4 * hb.HIDDEN)), f"u_{d}": r.normal(0, 1 / np.sqrt(hb.HIDDEN), (hb.HIDDEN, 4 * hb.HIDDEN)), f"b_{d}": np.concatenate([np.zeros(hb.HIDDEN), np.ones(hb.HIDDEN), np.zeros(2 * hb.HIDDEN)])}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _forward(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    h = c = np.zeros((len(x), hb.HIDDEN), np.float32)
    out, kept, z_in = np.empty((*x.shape[:2], hb.HIDDEN), np.float32), [], x @ w + b
    for t in range(x.shape[1]):
        z = z_in[:, t] + h @ u
        i, f, o = np.split(1 / (1 + np.exp(-z[:, : 3 * hb.HIDDEN])), 3, axis=1)
        g = np.tanh(z[:, 3 * hb.HIDDEN :])
        on = mask[:, t, None]
        new = f * c + i * g
        tc = np.tanh(new)
        kept.append((h, c, i, f, o, g, tc, on))
        c, h = np.where(on, new, c), np.where(on, o * tc, h)
        out[:, t] = h
    return out, kept


def _backward(x: np.ndarray, u: np.ndarray, kept: list, d_out: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of w, u, b and x."""
    dh = dc = np.zeros((len(x), hb.HIDDEN), np.float32)
    d_u, dz_all = np.zeros_like(u), np.empty((*x.shape[:2], 4 * hb.HIDDEN), np.float32)
    for t in reversed(range(x.shape[1])):
        h, c, i, f, o, g, tc, on = kept[t]
        dh = dh + d_out[:, t]
        d_o = dh * tc * on
        d_new = (dh * o * (1 - tc * tc) + dc) * on
        dz = np.hstack([d_new * g * i * (1 - i), d_new * c * f * (1 - f), d_o * o * (1 - o), d_new * i * (1 - g * g)])
        dz_all[:, t] = dz
        d_u += h.T @ dz
        dh = dz @ u.T + np.where(on, 0, dh)
        dc = np.where(on, d_new * f, dc)
    flat = dz_all.reshape(-1, dz_all.shape[2])
    return x.reshape(-1, x.shape[2]).T @ flat, d_u, flat.sum(0), dz_all @ w.T


def train(steps: int = 600, batch: int = 24, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights after that many batches of fresh pages."""
    p = init(seed)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        data = [labelled(1000 + step * batch + i) for i in range(batch)]
        data = [d for d in data if len(d[0])]
        f = hb.features([d[0] for d in data])
        y = np.concatenate([d[1] for d in data]).astype(np.float32)[:, None]
        x = hb.inputs(p, f)
        rng = np.random.default_rng(step)
        hide = np.ones_like(x)  # now and then a page's paths or words are hidden, so that the others are learned too
        for a, b in zip(f[6][:-1], f[6][1:], strict=True):
            if rng.random() < 0.1:
                hide[a:b, : hb.PATH_DIM] = 0
            if rng.random() < 0.3:
                hide[a:b, hb.PATH_DIM : hb.PATH_DIM + hb.WORD_DIM] = 0
        x = x * hide
        xb, mask, page, at = hb.padded(x, f[6])
        hf, kf = _forward(xb, mask, p["w_f"], p["u_f"], p["b_f"])
        hr, kr = _forward(xb[:, ::-1], mask[:, ::-1], p["w_b"], p["u_b"], p["b_b"])
        h = np.concatenate([hf, hr[:, ::-1]], axis=2)[page, at]
        q = 1 / (1 + np.exp(-(h @ p["v"] + p["c"])))
        dz = (q - y) / len(y)
        g = {"v": h.T @ dz, "c": dz.sum(0)}
        dh = np.zeros((*mask.shape, 2 * hb.HIDDEN), np.float32)
        dh[page, at] = dz @ p["v"].T
        g["w_f"], g["u_f"], g["b_f"], dxf = _backward(xb, p["u_f"], kf, dh[:, :, : hb.HIDDEN], p["w_f"])
        g["w_b"], g["u_b"], g["b_b"], dxb = _backward(xb[:, ::-1], p["u_b"], kr, dh[:, ::-1, hb.HIDDEN :], p["w_b"])
        dx = ((dxf + dxb[:, ::-1])[page, at]) * hide
        g |= {k: np.zeros_like(p[k]) for k in ("path", "word", "leaf")}
        for k, ids, bounds, part in (("path", f[0], f[1], dx[:, : hb.PATH_DIM]), ("word", f[2], f[3], dx[:, hb.PATH_DIM : hb.PATH_DIM + hb.WORD_DIM])):
            n = np.diff(bounds)
            np.add.at(g[k], ids, np.repeat(part / n[:, None], n, axis=0))
        np.add.at(g["leaf"], f[4], dx[:, hb.PATH_DIM + hb.WORD_DIM : hb.PATH_DIM + hb.WORD_DIM + hb.LEAF_DIM])
        rate = 0.01 * min(1, 2 * (1 - step / steps) + 0.02)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k, v in p.items():
            d = g[k] / max(1.0, norm)
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            p[k] = v - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in p.items()}


def accuracy(p: dict[str, np.ndarray], seeds: range) -> float:
    """Share of blocks of unseen composed pages labelled right."""
    data = [labelled(s) for s in seeds]
    y = np.concatenate([d[1] for d in data])
    return float(((hb.chances(p, [d[0] for d in data]) >= 0.5) == y).mean())


if __name__ == "__main__":
    trained = train()
    print(accuracy(trained, range(300)))
    np.savez_compressed(hb.WEIGHTS, **trained)
