"""Main text of web pages: a bidirectional LSTM labels every leaf block of a page."""

from __future__ import annotations

import html
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .hashing import LETTERS, LOWER, word_hashes

#: Bound on the pages that the labeller is fitted on, by hash of their id, and on blocks of such a page.
MAX_TRAIN, MAX_TRAIN_BLOCKS = 400, 200
PATH_SIZE, WORD_SIZE, DIM, HIDDEN, NUMBERS = 1 << 11, 1 << 12, 10, 12, 8
EPOCHS, BATCH, RATE = 14, 16, 0.01
#: Innermost elements of a tag path that are read.
DEPTH = 10

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
#: An attribute up to its value, or the end of the tag.
_ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*(=)\s*)?)")
_UNQUOTED = re.compile(r"[^\s>]*")
_NAMED = {"class", "id", "role"}
_RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q",
           "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOUNDS = {"ul", "ol", "dl", "table", "div", "article", "section", "body"}

# Names that containers carry, by what they hold: labels of the training pages and their variants.
MAIN = ("article", "main", "div content", "div post", "div entry content", "div article body", "section story", "div main text", "div page body")
REST = {
    "menu": ("nav", "div menu", "div nav", "ul navbar", "div breadcrumb", "header", "div header top", "div topbar"),
    "foot": ("footer", "div footer", "div copyright", "div bottom", "section footer links"),
    "advert": ("div ad", "div ads", "div advert", "div sponsored", "aside promo", "div banner ad", "ins adsbygoogle"),
    "side": ("aside", "div sidebar", "aside sidebar", "div related", "section widget", "div recommended", "aside related posts"),
    "notice": ("div notice", "div cookie", "div cookie banner", "div alert", "div consent", "div gdpr notice", "div newsletter"),
    "form": ("form", "form search", "div subscribe", "form login", "fieldset", "div search"),
    "comments": ("div comments", "section comments", "ol comment list", "div comment", "div respond", "section reader comments"),
}
_REST_NAMES = {name for names in REST.values() for n in names for name in n.split()} - {"div", "ul", "ol", "section", "ins", "top", "body", "posts", "links", "list"}
_SHORT = ("Home", "About us", "Contact", "Privacy", "Log in", "Search", "Sign up", "Read more", "Share", "Cookies help us.", "Accept all", "Reply", "All rights reserved.", "Your e-mail")


class Block:
    """Text of a leaf, the names on its path from the inside out, and its characters inside links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: list[str], linked: int) -> None:
        self.text, self.path, self.linked = text, path, linked


class _Tags:
    """Tags of a page in order, by the rules of HTML, each character looked at a bounded number of times.

    A quote opens a value only after an equals sign. A quote that is never closed is part of
    an unquoted value, and a `<` whose tag never ends is text.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.gone: set[str] = set()  # what was looked for in vain and stands nowhere in the rest

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag(self, at: int) -> tuple[int, bool, str, list[str], bool] | None:
        """(end, closing, name, names it carries, self-closed) of the tag at a `<`; None where there is none."""
        page = self.page
        closing = page.startswith("</", at)
        name = _NAME.match(page, at + 1 + closing)
        if not name or self.find(">", at) < 0:
            return None
        at, carried, slash = name.end(), [], False
        while True:
            found = _ATTRIBUTE.match(page, at)
            if not found:
                return None
            if found[1]:
                # A slash before the end counts where it is not part of a value.
                return found.end(), closing, name[0].lower(), carried, slash or "/" in found[0]
            at, value = found.end(), ""
            if found[3]:
                close = self.find(page[at], at + 1) if page[at : at + 1] in ("'", '"') else -1
                if close >= 0:
                    value, at = page[at + 1 : close], close + 1
                else:
                    value = _UNQUOTED.match(page, at)[0]
                    at += len(value)
            if found[2].lower() in _NAMED:
                carried += [n for n in re.split(r"[^a-z]+", value.lower()) if n]

    def raw_end(self, name: str, at: int) -> int:
        """Where the contents of a script or the like and its end tag end; -1 where there is no end tag."""
        found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(self.page, at)
        end = self.find(">", found.end()) if found else -1
        return end + 1 if end >= 0 else -1


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order: decoded, with white space made single; comments, scripts and styles are skipped."""
    page = page or ""
    tags = _Tags(page)
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    held: list[str] = []
    linked = links = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append(Block(text, [n for _, names in stack[: -DEPTH - 1 : -1] for n in names], min(linked, len(text))))
        held.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        piece = html.unescape(piece)
        held.append(piece)
        linked += len(piece) if links else 0

    while at < len(page):
        start = tags.find("<", at)
        # A `<` that begins no tag stays in the text before the next one.
        tag, end = None, -1
        while start >= 0:
            if page.startswith("<!--", start):
                end = tags.find("-->", start + 4)
                end = len(page) if end < 0 else end + 3
            elif page[start + 1 : start + 2] in ("!", "?"):
                end = tags.find(">", start)
                end = len(page) if end < 0 else end + 1
            else:
                tag = tags.tag(start)
                end = tag[0] if tag else -1
            if end >= 0:
                break
            start = tags.find("<", start + 1)
        if start < 0:
            say(page[at:])
            break
        if start > at:
            say(page[at:start])
        at = end
        if tag is None:
            continue
        _, closing, name, carried, closed = tag
        if name in _RAW:
            if not closing and not (closed and name == "svg"):
                end = tags.raw_end(name, at)
                at = end if end >= 0 else at if closed else len(page)
            continue
        if name not in _INLINE:
            flush()
        if name in _VOID:
            continue
        if name == "a":
            links = 0 if closing else 1
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            closes = _SELF_CLOSING.get(name)
            if closes:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in closes:
                        del stack[k:]
                        break
                    if stack[k][0] in _BOUNDS:
                        break
            if name not in _INLINE:
                stack.append((name, [name, *carried]))
    flush()
    return out


def _numbers(b: Block) -> list[float]:
    words = b.text.count(" ") + 1
    return [
        np.log1p(len(b.text)) / 5, np.log1p(words) / 4, b.linked / len(b.text), float(b.text[-1] in ".!?…\"'”’)"), len(b.text) / words / 10,
        float("h1" in b.path[:1] or "h2" in b.path[:1] or "h3" in b.path[:1]), float("li" in b.path[:2]), sum(b.text.count(c) for c in "|©»") / words,
    ]


def inputs(page: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(path features, their block, word features, their block, numbers) of a sequence of blocks."""
    path, path_n = word_hashes([" ".join(b.path).encode() for b in page], LETTERS)
    word, word_n = word_hashes([b.text.encode().translate(LOWER) for b in page], LETTERS)
    at = np.arange(len(page))
    return (
        (path & np.uint64(PATH_SIZE - 1)).astype(np.int32), np.repeat(at, path_n), (word & np.uint64(WORD_SIZE - 1)).astype(np.int32),
        np.repeat(at, word_n), np.array([_numbers(b) for b in page], np.float32).reshape(-1, NUMBERS),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embedding bags of path and words, one LSTM each way over a page, and a logistic output."""

    def __init__(self) -> None:
        rng = np.random.default_rng(3)
        size = 2 * DIM + NUMBERS
        self.p = {"path": rng.normal(0, 0.3, (PATH_SIZE, DIM)), "word": rng.normal(0, 0.1, (WORD_SIZE, DIM)), "out": rng.normal(0, 0.3, 2 * HIDDEN), "out_b": np.zeros(1)}
        for way in "fb":
            self.p |= {f"x{way}": rng.normal(0, 0.3, (size, 4 * HIDDEN)), f"h{way}": rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), f"c{way}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Labeller:
        model = cls()
        with np.load(io.BytesIO(data)) as held:
            model.p = {k: held[k] for k in held.files}
        return model

    def vectors(self, seen: tuple[np.ndarray, ...]) -> np.ndarray:
        """Input vector per block: mean path and word embeddings, and numbers."""
        path, path_at, word, word_at, numbers = seen
        bags = []
        for ids, at, table in ((path, path_at, self.p["path"]), (word, word_at, self.p["word"])):
            bag = np.zeros((len(numbers), DIM), np.float32)
            n = np.maximum(np.bincount(at, minlength=len(numbers)), 1)[:, None]
            for d in range(DIM):
                bag[:, d] = np.bincount(at, table[ids, d], minlength=len(numbers))
            bags.append(bag / n)
        return np.concatenate([*bags, numbers], axis=1).astype(np.float32)

    def run(self, x: np.ndarray, order: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """States of one direction. order: (steps, pages) block numbers with -1 past a page's end."""
        p, k = self.p, HIDDEN
        gates = x @ p[f"x{way}"] + p[f"c{way}"]
        states = np.zeros((len(x), k), np.float32)
        h = c = np.zeros((order.shape[1], k), np.float32)
        for at in order:
            n = int((at >= 0).sum())  # pages are sorted from the longest on
            h, c, at = h[:n], c[:n], at[:n]
            a = gates[at] + h @ p[f"h{way}"]
            i, f, o, g = _sigmoid(a[:, :k]), _sigmoid(a[:, k : 2 * k]), _sigmoid(a[:, 2 * k : 3 * k]), np.tanh(a[:, 3 * k :])
            new = f * c + i * g
            if keep is not None:
                keep.append((at, h, c, i, f, o, g, new))
            h, c = o * np.tanh(new), new
            states[at] = h
        return states

    @staticmethod
    def orders(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block numbers by step for both directions, pages sorted from the longest on."""
        by = np.argsort(-lengths, kind="stable")
        first, n = (np.cumsum(lengths) - lengths)[by], lengths[by]
        step = np.arange(int(lengths.max(initial=0)))[:, None]
        inside = step < n
        return np.where(inside, first + step, -1), np.where(inside, first + n - 1 - step, -1)

    def probabilities(self, seen: tuple[np.ndarray, ...], lengths: np.ndarray) -> np.ndarray:
        x = self.vectors(seen)
        ahead, back = self.orders(lengths)
        states = np.concatenate((self.run(x, ahead, "f"), self.run(x, back, "b")), axis=1)
        return _sigmoid(states @ self.p["out"] + self.p["out_b"])

    def gradients(self, seen: tuple[np.ndarray, ...], lengths: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, k = self.p, HIDDEN
        x = self.vectors(seen)
        kept: dict[str, list] = {"f": [], "b": []}
        states = [self.run(x, order, way, kept[way]) for way, order in zip("fb", self.orders(lengths), strict=True)]
        both = np.concatenate(states, axis=1)
        error = (_sigmoid(both @ p["out"] + p["out_b"]) - labels) / len(labels)
        g = {name: np.zeros_like(v) for name, v in p.items()}
        g["out"], g["out_b"] = both.T @ error, error.sum(keepdims=True)
        into = error[:, None] * p["out"]
        dx = np.zeros_like(x)
        for side, way in enumerate("fb"):
            dh = dc = np.zeros((0, k), np.float32)
            for at, h, c, i, f, o, u, new in reversed(kept[way]):
                pad = ((0, len(at) - len(dh)), (0, 0))
                dh = np.pad(dh, pad) + into[at, side * k : (side + 1) * k]
                t = np.tanh(new)
                dnew = np.pad(dc, pad) + dh * o * (1 - t * t)
                da = np.concatenate((dnew * u * i * (1 - i), dnew * c * f * (1 - f), dh * t * o * (1 - o), dnew * i * (1 - u * u)), axis=1)
                g[f"x{way}"] += x[at].T @ da
                g[f"h{way}"] += h.T @ da
                g[f"c{way}"] += da.sum(axis=0)
                dx[at] += da @ p[f"x{way}"].T
                dh, dc = da @ p[f"h{way}"].T, dnew * f
        path, path_at, word, word_at, numbers = seen
        for name, ids, at, part in (("path", path, path_at, dx[:, :DIM]), ("word", word, word_at, dx[:, DIM : 2 * DIM])):
            n = np.maximum(np.bincount(at, minlength=len(numbers)), 1)
            np.add.at(g[name], ids, (part / n[:, None])[at])
        return g

    def learn(self, pages: list[tuple[list[Block], list[int]]]) -> None:
        """Adam over batches of pages, with back-propagation through each whole page."""
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        rng, done = np.random.default_rng(5), 0
        for epoch in range(EPOCHS):
            for at in np.array_split(rng.permutation(len(pages)), max(1, len(pages) // BATCH)):
                group = [varied(*pages[i], rng) for i in at]
                flat = [b for page, _ in group for b in page]
                if not flat:
                    continue
                labels = np.array([y for _, ys in group for y in ys], np.float32)
                g = self.gradients(inputs(flat), np.array([len(page) for page, _ in group]), labels)
                done += 1
                rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**done) / (1 - 0.9**done)
                for name, v in g.items():
                    first[name] += 0.1 * (v - first[name])
                    second[name] += 0.001 * (v * v - second[name])
                    self.p[name] -= (rate * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)


def taught(page: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article: 1 inside it and outside anything else; else None."""
    labels = []
    for b in page:
        nearest = next((1 if n in ("article", "main") else 0 for n in b.path if n in ("article", "main") or n in _REST_NAMES), 0)
        labels.append(nearest)
    return labels if any(labels) else None


def varied(page: list[Block], labels: list[int], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A training page as other sites might build it: containers renamed, boilerplate added.

    Added blocks borrow the page's own text, so that only place and path tell them apart.
    """
    main = MAIN[rng.integers(len(MAIN))].split() if rng.random() < 0.5 else None
    renamed: dict[str, list[str]] = {}
    out: list[tuple[Block, int]] = []
    for b, y in zip(page, labels, strict=True):
        path = []
        for n in b.path:
            kind = next((k for k, names in REST.items() if n in names[0].split() and n != "div"), None)
            if n in ("article", "main") and main:
                path += main
            elif kind and not y:
                path += renamed.setdefault(n, REST[kind][rng.integers(len(REST[kind]))].split() if rng.random() < 0.5 else [n])
            else:
                path.append(n)
        out.append((Block(b.text, path, b.linked), y))
    texts = [b.text for b, y in zip(page, labels, strict=True) if y]
    for kind, names in REST.items():
        if rng.random() < 0.3:
            holder = names[rng.integers(len(names))].split()
            inner = ["p"] if kind in ("comments", "advert", "notice", "side") and rng.random() < 0.7 else ["li"] if rng.random() < 0.5 else []
            added = []
            for _ in range(rng.integers(1, 6)):
                long = rng.random() < (0.8 if kind == "comments" else 0.3)
                words = texts[rng.integers(len(texts))].split()
                text = " ".join(words[: rng.integers(3, 40)]) if long else _SHORT[rng.integers(len(_SHORT))] if rng.random() < 0.6 else " ".join(words[: rng.integers(1, 6)])
                added.append((Block(text, [*inner, *holder, "body", "html"], len(text) if kind in ("menu", "side") and not long else 0), 0))
            inside = [k for k, (_, y) in enumerate(out) if y]
            place = {"menu": 0, "notice": 0}.get(kind, len(out)) if rng.random() < 0.7 or not inside else int(inside[rng.integers(len(inside))])
            out[place:place] = added
    return [b for b, _ in out], [y for _, y in out]


def fit(pages: DataFrame, id_col: str, html_col: str, max_train: int = MAX_TRAIN) -> bytes:
    """Weights fitted in one task on about max_train pages, which teach by marking their article."""
    n = pages.count()
    share = min(1.0, max_train / max(n, 1))
    if share < 1:
        pages = pages.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(13)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for place, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = blocks(page)
                labels = taught(found) if 0 < len(found) <= MAX_TRAIN_BLOCKS else None
                if labels:
                    rows.append((place, found, labels))
        rows.sort(key=lambda r: (r[0], len(r[1])))
        model = Labeller()
        model.learn([(found, labels) for _, found, labels in rows])
        yield pa.record_batch([pa.array([model.save()], pa.binary())], names=["model"])

    rows = pages.select(F.xxhash64(id_col).alias("place"), F.col(html_col).alias("html")).repartition(1)
    fitted = rows.mapInArrow(learn, "model binary").first()
    return bytes(fitted["model"]) if fitted else Labeller().save()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_train: int = MAX_TRAIN) -> DataFrame:
    """(id, url, text, n_blocks, n_kept) per row: blocks labelled as main text, joined by a space.

    The labeller is fitted on a bounded sample of the pages themselves and sent to all
    tasks (a fixed 0.3 MB). Every block of a page is read in the context of all its blocks,
    both ways; nothing is cut. A null page is empty; a page without blocks has an empty
    text; repeated rows repeat; other columns are not read; an empty table gives no rows.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(fit(pages, id_col, html_col, max_train))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller.load(sent.value)
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                found = [blocks(p) for p in batch.column(2).to_pylist()]
                lengths = np.array([len(f) for f in found])
                flat = [b for f in found for b in f]
                main = model.probabilities(inputs(flat), lengths) >= 0.5 if flat else np.zeros(0, bool)
                ends = np.cumsum(lengths)
                texts = [" ".join([b.text for b, m in zip(f, main[e - n : e], strict=True) if m]) for f, n, e in zip(found, lengths, ends, strict=True)]
                kept = [int(main[e - n : e].sum()) for n, e in zip(lengths, ends, strict=True)]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(lengths), pa.array(kept, pa.int64())], names=["id", "url", "text", "n_blocks", "n_kept"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(label, f"id {kind}, url string, text string, n_blocks bigint, n_kept bigint")
