"""Main text of HTML pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A block is the text between two block-level borders. Its features are the tags and the words in class, id and role of
its ancestors, and properties of its text. The field has two labels (main text or not), is trained by its conditional
likelihood on labelled pages, and is decoded by Viterbi. `labelled_pages` makes the pages it learns from: many layouts,
with every block's label known from the way it was made.

Defined results: null, empty and tag-only pages have an empty text; scripts, styles, comments and what is in <head> are
no blocks; unclosed and stray tags are recovered from, an open <head> by the first tag that cannot stand in it; the text
of formulas belongs to its block; <br> is white space; repeated rows are extracted each; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter
from collections.abc import Container
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairloom.llm.common import map_texts

BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript head title svg iframe object select textarea canvas audio video map".split())
#: An opening tag ends these open ones, unless one of the borders stands between.
ENDS = {"li": ({"li", "p"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt", "p"}, {"dl"}), "dt": ({"dd", "dt", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NAME_WORD = re.compile(r"[a-z]+")


#: What <head> may hold: any other tag ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())


class Blocks(HTMLParser):
    """blocks: (features of the ancestors, text, share of it in links) in page order.

    known: the names that matter; what is held of the ancestors is bounded by it, however deep tags are nested.
    """

    def __init__(self, known: Container[str] | None = None):
        super().__init__(convert_charrefs=True)
        self.known = known
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.open: Counter[str] = Counter()
        self.names: dict[str, int] = {}  # of the open tags, and how often
        self.owners = ["none"]  # the open block tags
        self.blocks: list[tuple[list[str], str, float]] = []
        self.parts: list[str] = []
        self.silent = self.linked = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(([*self.names, f"own:{self.owners[-1]}"], text, self.linked / len(text)))
            self.parts, self.linked = [], 0

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag, names = self.stack.pop()
            self.open[tag] -= 1
            self.silent -= tag in SILENT
            if tag in BLOCK_TAGS:
                self.owners.pop()
            for n in names:
                self.names[n] -= 1
                if not self.names[n]:
                    del self.names[n]

    def close_open(self, tags: set[str], borders: set[str]) -> None:
        left = sum(self.open[t] for t in tags)
        for i in range(len(self.stack) - 1, -1, -1):
            if not left or self.stack[i][0] in borders:
                return
            if self.stack[i][0] in tags:
                left -= sum(t in tags for t, _ in self.stack[i:])
                self.pop(i)

    def handle_starttag(self, tag, attrs):
        if self.open["head"] and tag not in IN_HEAD:
            self.close_open({"head"}, set())
        if tag in BLOCK_TAGS:
            self.flush()
            if tag in ENDS:
                self.close_open(*ENDS[tag])
            else:
                self.close_open({"p"}, BLOCK_TAGS - {"p"})
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag == "a":
            self.close_open({"a"}, set(BLOCK_TAGS))
        names = [f"tag:{tag}"] if tag in BLOCK_TAGS else []
        names += [f"name:{w}" for k, v in attrs if k in ("class", "id", "role") and v for w in NAME_WORD.findall(v.lower())]
        names = tuple(n for n in names if self.known is None or n in self.known)
        self.stack.append((tag, names))
        self.open[tag] += 1
        self.silent += tag in SILENT
        if tag in BLOCK_TAGS:
            self.owners.append(tag)
        for n in names:
            self.names[n] = self.names.get(n, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.pop(i)
                return
            if tag not in BLOCK_TAGS and self.stack[i][0] in BLOCK_TAGS:
                return

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.open["a"]:
                self.linked += len(data)


def blocks_of(html: str | None, known: Container[str] | None = None) -> list[tuple[list[str], str, float]]:
    parser = Blocks(known)
    if html:
        parser.feed(html)
        parser.close()
        parser.flush()
    return parser.blocks


def text_features(text: str, linked: float) -> list[str]:
    n = text.count(" ") + 1
    return [f"words:{min(n.bit_length(), 8)}", f"linked:{min(int(linked * 4), 4)}", f"ends:{'.' if text[-1] in '.!?…:' else 'x'}", f"sign:{'©' in text or '|' in text}", f"commas:{min(text.count(','), 3)}"]


class Field:
    """Weights of features by label, and of neighbouring labels."""

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], steps: int = 220, rate: float = 0.15, ridge: float = 3e-5) -> Field:
        names = sorted({f for page, _ in pages for block in page for f in block})
        self.index = {f: i for i, f in enumerate(names)}
        longest = max(len(p) for p, _ in pages)
        x = np.zeros((len(pages), longest, len(names)), np.float32)
        y, mask = np.zeros((len(pages), longest), np.int64), np.zeros((len(pages), longest), bool)
        for i, (page, labels) in enumerate(pages):
            y[i, : len(labels)], mask[i, : len(labels)] = labels, True
            for t, block in enumerate(page):
                x[i, t, [self.index[f] for f in block]] = 1
        flat, total = x.reshape(-1, len(names)), mask.sum()
        w, pair = np.zeros((len(names), 2)), np.zeros((2, 2))
        pairs = mask[:, 1:] & mask[:, :-1]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
        moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)]
        add = lambda a: np.logaddexp(a[..., 0], a[..., 1])
        for step in range(1, steps + 1):
            e = (flat @ w.astype(np.float32)).astype(float).reshape(*y.shape, 2) * mask[..., None]
            ahead, back = np.zeros_like(e), np.zeros_like(e)
            ahead[:, 0] = e[:, 0]
            for t in range(1, longest):
                ahead[:, t] = np.where(mask[:, t, None], e[:, t] + add((ahead[:, t - 1, :, None] + pair).swapaxes(1, 2)), ahead[:, t - 1])
            for t in range(longest - 2, -1, -1):
                back[:, t] = np.where(mask[:, t + 1, None], add(pair + (e[:, t + 1] + back[:, t + 1])[:, None, :]), 0)
            norm = add(ahead[:, -1])
            p = np.exp(ahead + back - norm[:, None, None]) * mask[..., None]
            both = np.exp(ahead[:, :-1, :, None] + pair + (e[:, 1:] + back[:, 1:])[:, :, None, :] - norm[:, None, None, None]) * pairs[..., None, None]
            own = np.eye(2)[y] * mask[..., None]
            g = [flat.T @ (p - own).reshape(-1, 2).astype(np.float32) / total + ridge * w, (both.sum((0, 1)) - seen) / total + ridge * pair]
            for k, (value, slope) in enumerate(zip((w, pair), g, strict=True)):
                m, v = moments[2 * k], moments[2 * k + 1]
                m += 0.1 * (slope - m)
                v += 0.01 * (slope * slope - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.pair = w, pair.tolist()
        self.gain = (w[:, 1] - w[:, 0]).tolist()
        return self

    def decode(self, blocks: list[list[str]]) -> list[int]:
        """Viterbi: the likeliest sequence of labels."""
        if not blocks:
            return []
        (a, b), (c, d) = self.pair
        index, gain, back = self.index, self.gain, []
        off, on = 0.0, None
        for block in blocks:
            e = sum(gain[index[f]] for f in block if f in index)
            if on is None:
                on = e
            else:
                from_off, from_on = (off + a >= on + c), (on + d > off + b)
                off, on = (off + a if from_off else on + c), (on + d if from_on else off + b) + e
                back.append((0 if from_off else 1, 1 if from_on else 0))
        label = int(on > off)
        out = [label]
        for was in reversed(back):
            label = was[label]
            out.append(label)
        return out[::-1]


def labelled_pages(n: int = 480, seed: int = 3) -> list[tuple[str, list[str]]]:
    """Pages and the blocks of their main text. Their words are random; layouts, tags and names vary as on the web."""
    rng = random.Random(seed)
    pick, chance = rng.choice, lambda p: rng.random() < p
    word = lambda: "".join(pick("aeioubcdfghlmnprstvw") for _ in range(rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def prose(a=1, b=5):
        return " ".join((words(4, 18).capitalize() + pick([", ", " "]) + words(2, 9) + pick("....?!")) for _ in range(rng.randint(a, b)))

    def links(k=None, tag="li", outer="ul"):
        inner = "".join(f"<{tag}><a href='/{word()}'>{words(1, 4)}</a></{tag}>" for _ in range(k or rng.randint(3, 9)))
        return f"<{outer}>{inner}</{outer}>" if outer else inner

    name = lambda *w: f' {pick(["class", "class", "id"])}="{pick(w)}{pick(["", "", "-" + pick(["box", "wrap", "inner", "area", "section", "block"])])}"'
    div = lambda attrs, inner, tag="div": f"<{tag}{attrs}>{inner}</{tag}>"
    mixed = lambda: pick([f"<p>{prose(1, 2)}</p>", prose(1, 2), links(), f"<h3>{words(1, 4)}</h3>{links()}", f"<h4>{words(1, 5)}</h4><p>{prose(1, 3)}</p>"])

    def other(where):
        kinds = {
            "top": [
                lambda: div("", links(), "nav"), lambda: div(name("nav", "menu", "navbar", "topbar", "navigation"), links()),
                lambda: div(name("", "site-header", "masthead", "header", "top"), f"<h{pick('12')}>{words(1, 4)}</h2><p>{words(2, 8)}</p>" + pick(["", links()]), "header"),
                lambda: div(name("header", "masthead", "banner", "branding", "logo"), f"<a href='/'>{words(1, 3)}</a> {words(1, 5)}"),
                lambda: div(name("breadcrumb", "breadcrumbs", "crumbs"), links(3, "span", "")),
                lambda: div(name("search", "searchform", "login"), f"<label>{words(1, 3)}</label><input type=text><button>{words(1, 2)}</button>", "form"),
            ],
            "any": [
                lambda: div(name("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"), pick([prose(1, 2), f"<p>{prose(1, 2)}</p>", words(2, 8)])),
                lambda: div(name("cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal"), f"<p>{prose(1, 3)}</p><button>{words(1, 2)}</button>"),
                lambda: div(name("newsletter", "subscribe", "signup", "contact"), f"<h3>{words(2, 5)}</h3><p>{prose(1, 2)}</p><input><button>{words(1, 2)}</button>", pick(["div", "form", "section"])),
                lambda: div(pick(["", name("sidebar", "side", "widget", "related")]), mixed(), "aside"),
                lambda: div("", f"<p>{prose(1, 2)}</p><label>{words(1, 3)}</label><select><option>{word()}</select>", "form"),
            ],
            "end": [
                lambda: div(name("related", "recommended", "more", "popular", "trending", "latest"), f"<h3>{words(1, 4)}</h3>{links()}", pick(["div", "section", "aside"])),
                lambda: div(name("share", "social", "sharing", "tags", "meta", "pagination", "pager", "toolbar"), links(None, "span", "")),
                lambda: div(name("comments", "comment-list", "responses", "discussion", "respond", "replies"), f"<h{pick('23')}>{words(1, 3)}</h2>" + "".join(div(pick(["", ' class="comment"', ' class="comment-body"', ' class="reply"']), f"<p>{prose(1, 4)}</p>", pick(["div", "li", "article"])) for _ in range(rng.randint(1, 5))), pick(["div", "section", "ol"])),
                lambda: div(name("sidebar", "side", "rail", "widget", "widgets"), mixed() + mixed()),
                lambda: div(pick(["", name("footer", "site-footer", "bottom")]), pick([f"&copy; {word()}.com &middot; {prose(1, 1)}", f"<p>© 20{rng.randint(10, 25)} {words(1, 4)}</p>{links()}", prose(1, 2), f"<p>{prose(1, 2)}</p>"]), "footer"),
                lambda: div(name("footer", "copyright", "legal", "disclaimer", "colophon"), f"<p>{prose(1, 2)}</p>" + pick(["", links()])),
            ],
        }
        return pick(kinds[where])()

    pages = []
    for _ in range(n):
        main: list[str] = []

        def keep(text, main=main):
            main.append(" ".join(text.split()))
            return text

        parts = [f"<h1>{keep(words(2, 12) + pick(['', '.']))}</h1>"] if chance(0.85) else []
        for _ in range(rng.randint(1, 10)):
            kind = rng.random()
            if kind < 0.60:
                parts.append(f"<p>{keep(prose())}</p>")
            elif kind < 0.67:
                parts.append(f"<p><b>{keep(words(1, 12) + pick(['.', '']))}<br>")
            elif kind < 0.73:
                parts.append(f"<h{(h := pick('2234'))}>{keep(words(1, 7))}</h{h}>")
            elif kind < 0.79:
                parts.append("<ul>" + "".join(f"<li>{keep(words(2, 14))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.83:
                parts.append(f"<blockquote>{keep(prose(1, 2))}</blockquote>")
            elif kind < 0.86:
                parts.append("<table>" + "".join(f"<tr><td>{keep(word())}</td><td>{keep(words(1, 4))}</td></tr>" for _ in range(rng.randint(2, 4))) + "</table>")
            elif kind < 0.88:
                parts.append(f"<pre>{keep(words(3, 15))}</pre>")
            elif kind < 0.90:
                parts.append(f"<figure><img src=x><figcaption>{keep(words(3, 10))}</figcaption></figure>")
            elif kind < 0.93:
                ahead, linked, behind = words(3, 12), words(1, 3), prose(1, 2)
                keep(f"{ahead} {linked}, {behind}")
                parts.append(f"<p>{ahead} <a href='/x'>{linked}</a>, {behind}</p>")
            else:
                parts.append(other("any"))
        holder = rng.random()
        box = (lambda s: div("", s, "article")) if holder < 0.45 else (lambda s: div("", s, "main")) if holder < 0.6 else (lambda s: div(name("content", "article", "post", "entry", "story", "main", "text", "article-body", "post-content", "entry-content"), s, pick(["div", "div", "section"])))
        inner = "".join(parts)
        if chance(0.3):
            inner += other("end").replace("<footer", "<div").replace("</footer", "</div")
        body = "".join(other(pick(["top", "top", "any"])) for _ in range(rng.randint(0, 3))) + f"<!-- {words(1, 3)} -->" + pick(["", other("any")])
        body += pick([lambda s: s, lambda s: s, lambda s: div(name("wrapper", "page", "container", "row"), s), lambda s: div("", s, "section")])(box(inner))
        body += "".join(other(pick(["end", "end", "any"])) for _ in range(rng.randint(0, 4)))
        head = f"<head><title>{words(1, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        pages.append((f"<!DOCTYPE html><html>{head}<body>{body}" + pick(["</body></html>", ""]), main))
    return pages


def featured(html: str | None, known: Container[str] | None = None) -> tuple[list[list[str]], list[str]]:
    found = blocks_of(html, known)
    return [names + text_features(text, linked) for names, text, linked in found], [text for _, text, _ in found]


@functools.lru_cache(maxsize=2)
def trained(pages: int = 480, seed: int = 3) -> Field:
    """The field, trained on labelled pages; a block is main text if it is the next of the page's main blocks."""
    rows = []
    for html, main in labelled_pages(pages, seed):
        features, texts = featured(html)
        labels, at = [], 0
        for text in texts:
            hit = at < len(main) and text == main[at]
            labels.append(int(hit))
            at += hit
        if at != len(main):
            raise AssertionError(f"a labelled page lost its main text: {main[at]!r}")
        if features:
            rows.append((features, labels))
    return Field().fit(rows)


def extract(html: str | None, field: Field) -> list[str]:
    """The blocks of a page's main text."""
    features, texts = featured(html, field.index)
    return [t for t, label in zip(texts, field.decode(features), strict=True) if label]


def main_texts(pages: DataFrame, keep: list[str], html: str = "html", field: Field | None = None) -> DataFrame:
    """The columns `keep`, text and n_chars of every page."""
    field = field or trained()
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def run(htmls):
        texts = ["\n".join(extract(h, field)) for h in htmls]
        return texts, [len(t) for t in texts]

    return map_texts(pages, html, keep, fields, run)
