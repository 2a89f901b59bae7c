"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks, the runs of text between block-level tags. Each block is a vector: its tag path with class and id words, its words,
both hashed, and a few counts. A bidirectional LSTM in numpy reads the blocks of a page in order, so each label rests on the whole
page, and says for each whether it belongs to the article.

The labeller is trained here, on the driver, with pages laid out by a grammar of layouts from a bounded number of pages' own paragraphs: of
TRAINING_TEXTS pages' texts at most, TRAINING_PAGES layouts. Everything else covers all pages.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyspan.llm.common import bounded, shared

#: Tags that start or end a block, tags whose content is no text, tags without an end.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN_TAGS = frozenset("head iframe noscript object script style svg template textarea title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that end an open paragraph or item of their kind.
CLOSES = {t: ("p",) for t in BLOCK_TAGS} | {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "option": ("option",)}
PATH_SLOTS, WORD_SLOTS, COUNTS = 192, 32, 8
WIDTH = PATH_SLOTS + WORD_SLOTS + COUNTS
HIDDEN = 24
TRAINING_TEXTS, TRAINING_PAGES = 200, 1_200
#: Pages that the labeller reads side by side, and blocks that it has in memory at once.
SIDE_BY_SIDE, BLOCKS_AT_ONCE = 256, 30_000

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|<(?=/?[a-zA-Z])[^<]*$", re.S)
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    """Text as it reads, its tag path from the outside in with class and id words, and the share of its characters in links."""

    text: str
    path: tuple[str, ...]
    linked: float


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order. Broken markup is read as browsers do, near enough: paragraphs and items end where the next begins,
    an end tag closes what is open inside it, one without a start is passed over, and what is open at the end of the page ends there."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked = total = links = 0
    at, page = 0, page or ""

    def close() -> None:
        nonlocal linked, total
        if not pieces:
            return
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            out.append(Block(text, tuple(x for name, marks in stack for x in (name, *marks)), linked / max(1, total)))
        pieces.clear()
        linked = total = 0

    def say(raw: str) -> None:
        nonlocal linked, total
        if raw:
            pieces.append(raw)
            total += len(raw)
            linked += len(raw) if links else 0

    while at < len(page):
        found = _TOKEN.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at:found.start()])
        at = found.end()
        if not found[2]:
            continue
        name = found[2].lower()
        if found[1]:
            if any(n == name for n, _ in stack):
                if name in BLOCK_TAGS or any(n in BLOCK_TAGS for n, _ in stack[next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name):]):
                    close()
                while True:
                    ended = stack.pop()[0]
                    links -= ended == "a"
                    if ended == name:
                        break
            continue
        if name in HIDDEN_TAGS:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif name != "head":
                at = len(page)
            if name in BLOCK_TAGS:
                close()
            continue
        if name in BLOCK_TAGS:
            close()
            for other in CLOSES.get(name, ()):
                inner = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == other), None)
                if inner is not None and not any(n in ("table", "ul", "ol", "dl", "div", "article", "section") for n, _ in stack[inner + 1:]):
                    links -= sum(n == "a" for n, _ in stack[inner:])
                    del stack[inner:]
        if name == "br":
            say(" ")
        if name in VOID_TAGS or found[3].rstrip().endswith("/"):
            continue
        marks = tuple(w for m in _MARKS.findall(found[3]) for w in _WORD.findall("".join(m).lower())) if found[3] else ()
        links += name == "a"
        stack.append((name, marks))
    close()
    return out


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed steps of a tag path with their signs, the last three at most weight, and the steps' first letters, for names are made of
    others. Paths repeat, so a task remembers them."""
    found = _PATHS.get(path)
    if found is None:
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        found = np.zeros(PATH_SLOTS, np.float32)
        for depth, step in enumerate(reversed(path)):
            for part, weight in ((step, 1.0), ("~" + step[:3], 0.6)):
                h = zlib.crc32(part.encode())
                found[h % PATH_SLOTS] += (1.0 if h >> 16 & 1 else -1.0) * (weight if depth < 3 else weight / 2)
        _PATHS[path] = found
    return found


def _word_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of every text, scaled to length one, and its number of words; all characters of all texts at once."""
    joined = [t.lower().encode() for t in texts]
    sizes = np.array([len(t) + 1 for t in joined])
    flat = np.frombuffer(b" ".join(joined) + b" ", np.uint8)
    inside = flat != 32
    starts = np.nonzero(inside & ~np.concatenate(([False], inside[:-1])))[0]
    place = np.arange(len(flat)) - np.repeat(starts, np.diff(np.append(starts, len(flat)))) if len(starts) else np.zeros(0, np.int64)
    powers = np.cumprod(np.full(64, 0x01000193, np.uint64)) & np.uint64(0xFFFFFFFF)
    skipped = int(starts[0]) if len(starts) else 0
    mixed = np.where(inside[skipped:], flat[skipped:].astype(np.uint64) * powers[place[-(len(flat) - skipped):] % 64], 0)
    hashes = (np.add.reduceat(mixed, starts - skipped) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    owner = np.searchsorted(np.cumsum(sizes), starts, "right")
    sign = np.where(hashes >> np.uint64(20) & np.uint64(1), 1.0, -1.0)
    slots = np.bincount(owner * WORD_SLOTS + (hashes % np.uint64(WORD_SLOTS)).astype(np.int64), weights=sign, minlength=len(texts) * WORD_SLOTS)
    slots = slots.reshape(len(texts), WORD_SLOTS)
    return slots / np.maximum(1.0, np.linalg.norm(slots, axis=1, keepdims=True)), np.bincount(owner, minlength=len(texts))


def vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page, one row of WIDTH numbers for each block. All words count."""
    flat = [b for page in pages for b in page]
    if not flat:
        return [np.zeros((0, WIDTH), np.float32) for _ in pages]
    words, n = _word_vectors([b.text for b in flat])
    counts = np.array([(b.linked, b.text[-1] in ".!?", "©" in b.text, "a" in b.path, len(b.path) / 8) for b in flat], np.float32)
    shape = np.stack([np.log1p(n) / 4, n < 4, np.ones(len(flat))], axis=1)
    rows = np.concatenate([np.stack([_path_vector(b.path) for b in flat]), words, counts, shape], axis=1).astype(np.float32)
    return np.split(rows, np.cumsum([len(p) for p in pages])[:-1])


class Labeller:
    """A bidirectional LSTM with a logistic output, for pages padded to one length: x is (steps, pages, WIDTH)."""

    def __init__(self, seed: int = 7, hidden: int = HIDDEN) -> None:
        random = np.random.default_rng(seed)
        self.hidden = hidden
        self.w: dict[str, np.ndarray] = {}
        for side in "fb":
            self.w[side + "x"] = random.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 4 * hidden))
            self.w[side + "h"] = random.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            self.w[side + "b"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.w["o"], self.w["c"] = random.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, 1)), np.zeros(1)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _side(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction; where the mask is 0 the state stays as it was."""
        steps, pages, _ = x.shape
        n = self.hidden
        given = (x.reshape(-1, WIDTH) @ self.w[side + "x"] + self.w[side + "b"]).reshape(steps, pages, 4 * n)
        h, c = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
        out, kept = np.zeros((steps, pages, n), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ self.w[side + "h"]
            gates = 1 / (1 + np.exp(-z[:, :3 * n]))
            i, f, o, g = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:], np.tanh(z[:, 3 * n:])
            new = f * c + i * g
            squashed, m = np.tanh(new), mask[t][:, None]
            if keep:
                kept.append((t, h, c, i, f, o, g, squashed, m))
            h, c = m * o * squashed + (1 - m) * h, m * new + (1 - m) * c
            out[t] = h
        return out, kept

    def read(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._side(x, mask, side, False)[0] for side in "fb"], axis=2)
        return 1 / (1 + np.exp(-(both @ self.w["o"] + self.w["c"])[..., 0]))

    def _gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        states, kept = zip(*(self._side(x, mask, side, True) for side in "fb"), strict=True)
        both = np.concatenate(states, axis=2)
        p = 1 / (1 + np.exp(-(both @ self.w["o"] + self.w["c"])[..., 0]))
        d = ((p - y) * mask / mask.sum())[..., None].astype(np.float32)
        out = {"o": both.reshape(-1, 2 * self.hidden).T @ d.reshape(-1, 1), "c": d.sum((0, 1))}
        back = d @ self.w["o"].T
        n = self.hidden
        for k, side in enumerate("fb"):
            dh, dc = np.zeros_like(states[k][0]), np.zeros_like(states[k][0])
            dz_all = np.zeros((*x.shape[:2], 4 * n), np.float32)
            wh = np.zeros_like(self.w[side + "h"])
            for t, h, c, i, f, o, g, squashed, m in reversed(kept[k]):
                dh = dh + back[t][:, k * n:(k + 1) * n]
                own, pass_h, pass_c = dh * m, dh * (1 - m), dc * (1 - m)
                dnew = dc * m + own * o * (1 - squashed**2)
                dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), own * squashed * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
                dz_all[t] = dz
                wh += h.T @ dz
                dh, dc = dz @ self.w[side + "h"].T + pass_h, dnew * f + pass_c
            out[side + "x"] = x.reshape(-1, WIDTH).T @ dz_all.reshape(-1, 4 * n)
            out[side + "h"], out[side + "b"] = wh, dz_all.sum((0, 1))
        return out

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 14, batch: int = 32, rate: float = 0.01, seed: int = 11) -> None:
        """Adam over padded batches of pages (vectors, labels)."""
        random = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for turn in range(rounds):
            # Pages of like length stand together, so that little of a batch is padding; the batches come in any order.
            order = np.argsort([len(v) for v, _ in pages] + random.uniform(0, 6, len(pages)))
            for i in random.permutation(range(0, len(order), batch)):
                chosen = [pages[j] for j in order[i:i + batch]]
                x, mask = padded([v for v, _ in chosen])
                y = np.zeros(mask.shape, np.float32)
                for j, (_, labels) in enumerate(chosen):
                    y[:len(labels), j] = labels
                step += 1
                for k, g in self._gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    pace = rate * (0.5 if turn >= rounds * 2 // 3 else 1.0)
                    self.w[k] = (self.w[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[:len(p), j], mask[:len(p), j] = p, 1
    return x, mask


#: Class and id words under which sites keep the parts of a page.
NAMES = {
    "main": ("article", "content", "post", "entry", "story", "main", "body", "text", "page"),
    "header": ("header", "masthead", "top", "brand", "banner", "site", "branding"),
    "menu": ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "links", "tabs"),
    "notice": ("notice", "cookie", "cookies", "consent", "alert", "message", "newsletter", "subscribe", "popup", "gdpr", "warning"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "banner", "adsense"),
    "side": ("sidebar", "side", "related", "widget", "aside", "recommended", "popular", "trending", "tags", "share", "social"),
    "form": ("form", "search", "login", "signup", "contact"),
    "comments": ("comments", "comment", "replies", "reply", "discussion", "responses", "disqus", "reader"),
    "footer": ("footer", "bottom", "copyright", "legal", "imprint", "foot"),
}
#: Put before text that belongs to the article while a training page is laid out.
_MAIN = "\u2060"


class _Layouts:
    """Draws training pages: which parts a page has, in which order, in which tags, under which names, and how broken the markup is."""

    def __init__(self, texts: list[str], seed: int) -> None:
        self.random = np.random.default_rng(seed)
        self.texts = texts

    def chance(self, p: float) -> bool:
        return bool(self.random.random() < p)

    def pick(self, found: tuple[str, ...] | list[str]) -> str:
        return found[int(self.random.integers(len(found)))]

    def words(self, least: int, most: int) -> str:
        own = self.pick(self.texts).split()
        start = int(self.random.integers(max(1, len(own) - least)))
        return entities.escape(" ".join(own[start:start + int(self.random.integers(least, most + 1))]))

    def name(self, part: str) -> str:
        found = {self.pick(NAMES[part]) for _ in range(1 if self.chance(0.6) else 2)}
        if self.chance(0.3):
            found.add(self.pick(("box", "wrap", "inner", "block", "container", "col", "row", "item", "list")))
        return f' {self.pick(("class", "class", "id"))}="{self.pick(("-", " ")).join(sorted(found))}"'

    def wrap(self, part: str, inside: str, *tags: str) -> str:
        tag = self.pick(tags)
        named = tag in ("div", "section", "ul") or self.chance(0.4)
        return f"<{tag}{self.name(part) if named else ''}>{inside}</{tag}>"

    def links(self, n: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(n)]
        if self.chance(0.7):
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.pick((" ", " | ", "\n")).join(items)

    def prose(self, n: int, main: bool) -> str:
        mark, out = _MAIN if main else "", []
        for _ in range(n):
            text = mark + self.words(1, self.pick((6, 30, 90)))
            if self.chance(0.15):
                text = f"<b>{text}<br>"
            elif self.chance(0.2):
                text += f' <a href="/x">{self.words(1, 4)}</a> {self.words(2, 20)}'
            out.append(f"<p>{text}" + ("</p>" if self.chance(0.85) else ""))
        return "".join(out)

    def article(self) -> str:
        heading = f"<h1>{_MAIN}{self.words(2, 12)}</h1>"
        out = [f"<header>{heading}</header>" if self.chance(0.15) else heading] if self.chance(0.85) else []
        if self.chance(0.1):
            return self.wrap("main", "".join(out) + self.prose(1, True), "article", "main", "div", "section")
        for _ in range(int(self.random.integers(1, 5))):
            if self.chance(0.3):
                out.append(f"<h2>{_MAIN}{self.words(2, 8)}</h2>")
            out.append(self.prose(int(self.random.integers(1, 5)), True))
            if self.chance(0.03):
                out.append(self.prose(int(self.random.integers(20, 120)), True))
            kind = self.random.random()
            if kind < 0.12:
                out.append("<ul>" + "".join(f"<li>{_MAIN}{self.words(3, 25)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.2:
                out.append(f"<blockquote>{_MAIN}{self.words(8, 40)}</blockquote>")
            elif kind < 0.26:
                out.append("<table>" + "".join(f"<tr><td>{_MAIN}{self.words(1, 3)}</td><td>{_MAIN}{self.words(1, 6)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.46:
                out.append(self.part(self.pick(("advert", "advert", "side", "notice", "form", "menu"))))
            elif kind < 0.51:
                out.append(f"<div>{_MAIN}{self.words(10, 60)}</div>")
        return self.wrap("main", "".join(out), "article", "article", "main", "div", "section")

    def part(self, kind: str) -> str:
        if kind == "header":
            return self.wrap(kind, f"<div>{self.words(1, 6)}</div>" + (f"<p>{self.words(3, 14)}</p>" if self.chance(0.5) else "") + (self.links(4) if self.chance(0.4) else ""), "header", "div")
        if kind == "menu":
            return self.wrap(kind, self.links(int(self.random.integers(3, 9))), "nav", "nav", "div")
        if kind == "notice":
            return self.wrap(kind, f"<p>{self.words(5, 40)}</p><button>{self.words(1, 2)}</button>" if self.chance(0.6) else self.words(4, 40), "div", "section", "aside")
        if kind == "advert":
            return self.wrap(kind, self.words(2, 30) if self.chance(0.6) else f'<p><a href="/ad">{self.words(3, 20)}</a></p>', "div", "div", "aside", "section")
        if kind == "side":
            heading = f"<h3>{self.words(1, 4)}</h3>" if self.chance(0.6) else ""
            return self.wrap(kind, heading + (self.links(5) if self.chance(0.5) else self.prose(int(self.random.integers(1, 5)), False)), "aside", "div", "div")
        if kind == "form":
            fields = "".join(f"<label>{self.words(1, 4)}</label><input name=x>" for _ in range(3))
            return f"<form{self.name(kind) if self.chance(0.5) else ''}>{f'<p>{self.words(4, 25)}</p>' if self.chance(0.5) else ''}{fields}<select><option>{self.words(1, 2)}</option><option>{self.words(1, 2)}</option></select><button>{self.words(1, 2)}</button></form>"
        if kind == "comments":
            one = lambda: f"<{'li' if listed else 'div'}{self.name(kind) if self.chance(0.6) else ''}><b>{self.words(1, 2)}</b>{self.prose(int(self.random.integers(1, 3)), False)}</{'li' if listed else 'div'}>"
            listed = self.chance(0.4)
            inside = "".join(one() for _ in range(int(self.random.integers(1, 6)))) if self.chance(0.7) else self.prose(int(self.random.integers(1, 7)), False)
            heading = f"<h3>{self.words(1, 3)}</h3>" if self.chance(0.7) else ""
            return self.wrap(kind, heading + (f"<ul>{inside}</ul>" if listed else inside), "section", "div", "div")
        return self.wrap(kind, self.pick((f"&copy; {self.words(1, 4)} &middot; {self.words(4, 20)}", f"<p>&copy; {self.words(1, 6)}</p>", f"<p>{self.words(5, 30)}</p>" + self.links(4))), "footer", "footer", "div")

    def page(self) -> str:
        some = lambda *kinds: [self.part(k) for k in kinds if self.chance(0.45)]
        before, after = some("header", "menu", "notice", "advert", "form", "side"), some("comments", "side", "advert", "form", "menu")
        self.random.shuffle(before)
        self.random.shuffle(after)
        end = [self.part("footer")] if self.chance(0.85) else []
        inside = "".join([*before, self.article(), *after])
        inside = f"<div{self.name('main')}>{inside}</div>" if self.chance(0.25) else inside
        return "<html><body>" + inside + "".join(end) + ("</body></html>" if self.chance(0.9) else "")


def training_pages(texts: list[str], n: int, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of pages laid out with the given texts."""
    layouts, out = _Layouts(texts, seed), []
    for _ in range(n):
        page = blocks(layouts.page())
        labels = np.array([_MAIN in b.text for b in page], np.float32)
        page = [Block(text, b.path, b.linked) for b in page if (text := b.text.replace(_MAIN, "").strip())]
        if page and len(page) == len(labels):
            out.append((page, labels))
    return list(zip(vectors([page for page, _ in out]), [labels for _, labels in out], strict=True))


def train(pages: DataFrame, seed: int = 5) -> Labeller | None:
    """A labeller trained with the texts of at most TRAINING_TEXTS pages, chosen by the hash of their number; None if there are none."""
    place = F.xxhash64("page_id", "url")
    # Few rows pass this bound whatever the table's size, so tasks send little to the driver; the first of them are taken.
    share = min(1.0, 5 * TRAINING_TEXTS / max(1, pages.count()))
    few = pages.filter(F.col("html").isNotNull() & (F.pmod(place, F.lit(1_000_000)) < math.ceil(share * 1_000_000)))
    chosen = few.select(place.alias("place"), F.substring("html", 1, 20_000).alias("html")).orderBy("place", "html").limit(TRAINING_TEXTS)
    texts = [b.text for row in chosen.collect() for b in blocks(row["html"]) if len(b.text.split()) > 3]
    if not texts:
        return None
    labeller = Labeller()
    labeller.train(training_pages(texts, TRAINING_PAGES, seed))
    return labeller


def label(pages: list[list[Block]], labeller: Labeller) -> list[np.ndarray]:
    """For each page, the probability of every block that it belongs to the article; pages of like length are read side by side."""
    order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = [i for i in order if pages[i]]
    read = vectors(pages)
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and stop - at < SIDE_BY_SIDE and (stop + 1 - at) * len(pages[order[stop]]) <= BLOCKS_AT_ONCE:
            stop += 1
        found = order[at:stop]
        x, mask = padded([read[i] for i in found])
        p = labeller.read(x, mask)
        for j, i in enumerate(found):
            out[i] = p[:len(pages[i]), j]
        at = stop
    return out


SCHEMA = "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_main bigint"


def extract(pages: DataFrame, labeller: Labeller | None = None, least: float = 0.5) -> DataFrame:
    """The article of every page, one row per row of `pages` (page_id, url, html), as SCHEMA names them.

    Character references are decoded, white space inside a block is one space, blocks are joined by line feeds in page order; blocks
    with a probability of at least `least` are taken whole. Null and empty pages, and pages without a block of the article, have an empty
    text. Repeated rows and null ids are pages like any others; other columns are ignored; an empty table gives an empty table.
    """
    model = shared(pages.sparkSession, labeller or train(pages))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = model()
        for batch in bounded(batches, "html"):
            found = [blocks(h.as_py()) for h in batch.column("html")]
            rows = []
            for page, p in zip(found, label(found, labeller) if labeller else [np.zeros(len(x)) for x in found], strict=True):
                main = [b.text for b, share in zip(page, p.tolist(), strict=True) if share >= least]
                text = "\n".join(main)
                rows.append((text, len(text), len(page), len(main)))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    return pages.select("page_id", "url", "html").mapInArrow(of, SCHEMA)
