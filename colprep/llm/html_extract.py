"""Main text of pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, inline markup removed. Every block becomes a
vector of its tag path (hashed tags and words of class, id and role, nearer elements count more), its hashed words
and a few lengths and shares. A bidirectional LSTM in numpy reads the blocks of a page in order, so each block is
labelled in the light of the whole page; the blocks labelled as main text, in page order and with an empty line
between them, are the result.

The labeller is fitted here, on about ``SAMPLE`` pages drawn by a hash from the whole table. Their labels come from
the page's own structure (inside or outside article-like and menu-like elements). Copies of the pages are altered
while fitting: containers are renamed, or lose their names, and runs of comments, notices, forms, sidebars, footers and
adverts, as often in the words of the main text as not, are woven in before, inside and behind it.

Cases: a null or empty html gives an empty text; unclosed and misnested tags, comments, scripts, styles and character
references without end are handled as browsers do, nearly enough for text; repeated rows give repeated results; pages
of any length are read whole; a null url stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprep.llm.common import mixed, row_number_of, span_hashes, texts_as_bytes, words

SAMPLE = 300
PATH_BINS, WORD_BINS, PLAIN = 256, 64, 8
INPUT = PATH_BINS + WORD_BINS + PLAIN
HIDDEN = 16
MAX_STEPS = 64  # consecutive blocks, from a drawn place on, that a copy takes from a page while fitting; prediction reads all

# Tags that end a block, tags whose content is no text, tags without content.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p "
    "pre section select summary table tbody td tfoot th thead title tr ul button textarea label iframe".split()
)
SKIPPED_TAGS = frozenset("script style noscript template svg title head textarea select button iframe object math".split())
RAW_TAGS = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript object script style template title".split())  # what can stand in head
CLOSED_BY_SAME = frozenset("p li dt dd tr td th option".split())
# Words of tags, classes and ids that speak for or against main text; used for labels only.
MAIN_WORDS = frozenset("article main content post entry story body text".split())
SIDE_WORDS = frozenset(
    "nav menu footer header aside sidebar ad ads advert advertisement banner promo sponsored cookie consent notice alert popup modal form newsletter subscribe signup login search comment comments reply "
    "respond related share social breadcrumb breadcrumbs pagination widget toolbar copyright disclaimer".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


def blocks(page: str) -> list[tuple[tuple, str, float]]:
    """(path, text, share of the text inside links) of every leaf block with text, in page order.

    A path is a tuple of elements from the outside in; an element is a tuple of its tag and the words of its names.
    """
    out: list[tuple[tuple, str, float]] = []
    stack: list[tuple[str, tuple]] = []
    parts: list[str] = []
    linked = total = skip = links = 0
    path: tuple = ()
    position, end = 0, len(page)

    def flush():
        nonlocal linked, total
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((path, text, linked / max(1, total)))
            parts.clear()
        linked = total = 0

    def pop_to(index: int):
        nonlocal skip, links
        while len(stack) > index:
            tag = stack.pop()[0]
            skip -= tag in SKIPPED_TAGS
            links -= tag == "a"

    while position < end:
        match = _TOKEN.match(page, position)
        if match is None:  # a tag that never ends
            match_end, text = end, ""
        else:
            match_end, text = match.end(), match.group(4)
        if text:
            if stack and stack[-1][0] == "head" and text.strip():
                pop_to(len(stack) - 1)  # or where text stands
                path = tuple(e for _, e in stack if e[0] in BLOCK_TAGS)
            if not skip:
                parts.append(text)
                total += len(text)
                linked += len(text) if links else 0
        elif match is not None and match.group(2):
            tag = match.group(2).lower()
            block = tag in BLOCK_TAGS
            if stack and stack[-1][0] == "head" and not match.group(1) and tag not in HEAD_TAGS and tag != "head":
                pop_to(len(stack) - 1)  # head ends where a tag opens that cannot stand in it
                path = tuple(e for _, e in stack if e[0] in BLOCK_TAGS)
            if block:
                flush()
            elif tag == "br" and not skip:
                parts.append(" ")
            if match.group(1):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        pop_to(k)
                        break
                    if not block and stack[k][0] in BLOCK_TAGS:
                        break  # an inline end tag does not close blocks
            elif tag not in VOID_TAGS:
                if block:
                    for k in range(len(stack) - 1, -1, -1):
                        # a paragraph ends where a block starts, an item where the next one does
                        if stack[k][0] == "p" or stack[k][0] == tag and tag in CLOSED_BY_SAME:
                            pop_to(k)
                            break
                        if stack[k][0] in BLOCK_TAGS:
                            break
                names = " ".join(a or b or c for a, b, c in _NAMES.findall(match.group(3))) if match.group(3) else ""
                stack.append((tag, (tag, *_WORD.findall(names.lower())) if names else (tag,)))
                skip += tag in SKIPPED_TAGS
                links += tag == "a"
                if tag in RAW_TAGS:
                    close = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, match_end)
                    match_end = close.end() if close else end
                    pop_to(len(stack) - 1)
            if block:
                path = tuple(e for _, e in stack if e[0] in BLOCK_TAGS)
        position = max(match_end, position + 1)
    flush()
    return out


def weak_label(path: tuple) -> int | None:
    """1 in article-like elements, 0 in menu-like ones or outside any, judged from the inside out; None if unclear."""
    for element in reversed(path):
        if SIDE_WORDS.intersection(element):
            return 0
        if MAIN_WORDS.intersection(element) and element[0] != "body":
            return 1
    return 0 if any(e[0] in ("title", "head") for e in path) else None


_PATHS: dict[tuple, np.ndarray] = {}


def _path_vector(path: tuple) -> np.ndarray:
    found = _PATHS.get(path)
    if found is None:
        found = np.zeros(PATH_BINS, np.float32)
        for depth, element in enumerate(reversed(path)):
            for k, name in enumerate(element):
                code = row_number_of(f"{'tag' if k == 0 else 'name'}:{name}", 3)
                for place in (code, code >> 32):  # two places, so that no two names are the same
                    found[place % PATH_BINS] += (1 if place >> 20 & 1 else -1) / (1 + 0.5 * depth)
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        _PATHS[path] = found
    return found


def vectors(rows: list[tuple[tuple, str, float]]) -> np.ndarray:
    """Input vectors of blocks."""
    out = np.zeros((len(rows), INPUT), np.float32)
    if not rows:
        return out
    out[:, :PATH_BINS] = np.stack([_path_vector(path) for path, _, _ in rows])
    data, offsets = texts_as_bytes(pa.array([text.lower() for _, text, _ in rows], pa.string()))
    starts, ends, before = words(data, offsets)
    count = np.diff(before)
    code = mixed(span_hashes(data, starts, ends))
    sign = np.where(code >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    row = np.repeat(np.arange(len(rows)), count)
    bins = np.bincount(row * WORD_BINS + (code % np.uint64(WORD_BINS)).astype(np.int64), sign, len(rows) * WORD_BINS).reshape(-1, WORD_BINS)
    out[:, PATH_BINS : PATH_BINS + WORD_BINS] = 2 * bins / np.maximum(np.linalg.norm(bins, axis=1, keepdims=True), 1e-6)
    chars = np.diff(offsets)
    stops = np.concatenate([[0], np.cumsum((data == 46) | (data == 44) | (data == 33) | (data == 63))])
    stops = stops[offsets[1:]] - stops[offsets[:-1]]
    plain = [np.log1p(count) / 3, np.log1p(chars) / 5, [share for _, _, share in rows], stops / np.maximum(count, 1), count < 3, count > 20, [len(path) / 8 for path, _, _ in rows], np.minimum(chars / np.maximum(count, 1) / 10, 3)]
    out[:, PATH_BINS + WORD_BINS :] = np.array(plain, np.float32).T
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Labeller:
    """Bidirectional LSTM with one output per block. Weights are a dict of arrays."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 11):
        if weights is None:
            rng = np.random.default_rng(seed)
            weights = {}
            for way in "fb":
                weights["x" + way] = rng.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * HIDDEN)).astype(np.float32)
                weights["h" + way] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32)
                weights["c" + way] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
            weights["o"] = rng.normal(0, 0.3, (2 * HIDDEN, 1)).astype(np.float32)
            weights["bias"] = np.zeros(1, np.float32)
        self.w = weights

    def _pass(self, way: str, inputs: np.ndarray, alive: np.ndarray, keep: bool):
        """inputs: (steps, pages, 4 hidden) in reading order; alive: (steps, pages). Returns outputs and what backward needs."""
        steps, pages, _ = inputs.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, saved = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps):
            z = inputs[t] + h @ self.w["h" + way]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            on = alive[t][:, None]
            new = np.where(on, f * c + i * g, c)
            squashed = np.tanh(new)
            if keep:
                saved.append((h, c, i, f, o, g, squashed, on))
            c = new
            h = np.where(on, o * squashed, h)
            out[t] = h
        return out, saved

    def forward(self, pages: list[np.ndarray], keep: bool = False):
        """Chances of the blocks of several pages, (steps, pages); rows beyond a page's end mean nothing."""
        steps = max(len(p) for p in pages)
        alive = np.arange(steps)[:, None] < np.array([len(p) for p in pages])[None, :]
        x = np.zeros((steps, len(pages), INPUT), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k] = p
        flat = x.reshape(-1, INPUT)
        forth, saved_f = self._pass("f", (flat @ self.w["xf"] + self.w["cf"]).reshape(steps, len(pages), -1), alive, keep)
        back, saved_b = self._pass("b", (flat @ self.w["xb"] + self.w["cb"]).reshape(steps, len(pages), -1)[::-1], alive[::-1], keep)
        both = np.concatenate([forth, back[::-1]], axis=2)
        chance = _sigmoid((both @ self.w["o"])[:, :, 0] + self.w["bias"])
        return chance, (x, alive, both, saved_f, saved_b)

    def _back(self, way: str, d_out: np.ndarray, saved: list):
        steps, pages, _ = d_out.shape
        dz_all = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
        dh, dc, d_w = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32), np.zeros_like(self.w["h" + way])
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, squashed, on = saved[t]
            dh = dh + d_out[t]
            live = np.where(on, dh, 0)
            dc_here = np.where(on, dc + live * o * (1 - squashed**2), 0)
            dz = np.concatenate([dc_here * g * i * (1 - i), dc_here * c * f * (1 - f), live * squashed * o * (1 - o), dc_here * i * (1 - g**2)], axis=1)
            dz_all[t] = dz
            d_w += h.T @ dz
            dc = np.where(on, dc_here * f, dc)
            dh = np.where(on, 0, dh) + dz @ self.w["h" + way].T
        return dz_all, d_w

    def gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]):
        """Mean loss and gradients; labels hold nan where a block has none."""
        chance, (x, alive, both, saved_f, saved_b) = self.forward(pages, True)
        y = np.full(chance.shape, np.nan, np.float32)
        for k, label in enumerate(labels):
            y[: len(label), k] = label
        known = alive & ~np.isnan(y)
        d = np.where(known, chance - np.nan_to_num(y), 0).astype(np.float32) / max(1, known.sum())
        loss = -np.where(known, np.where(np.nan_to_num(y) > 0.5, np.log(chance + 1e-7), np.log(1 - chance + 1e-7)), 0).sum() / max(1, known.sum())
        flat = x.reshape(-1, INPUT)
        grad = {"o": both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, 1), "bias": np.array([d.sum()], np.float32)}
        d_both = d[:, :, None] * self.w["o"][:, 0]
        dz, grad["hf"] = self._back("f", d_both[:, :, :HIDDEN], saved_f)
        grad["xf"], grad["cf"] = flat.T @ dz.reshape(-1, 4 * HIDDEN), dz.sum((0, 1))
        dz, grad["hb"] = self._back("b", d_both[::-1, :, HIDDEN:], saved_b)
        dz = dz[::-1]
        grad["xb"], grad["cb"] = flat.T @ dz.reshape(-1, 4 * HIDDEN), dz.sum((0, 1))
        return float(loss), grad

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 11, batch: int = 32, rate: float = 0.01, seed: int = 5) -> None:
        """Adam over shuffled batches, with a rate that falls to a tenth."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(epochs):
            falling = rate * (1 - 0.9 * epoch / epochs)
            order = rng.permutation(len(pages))
            for k in range(0, len(order), batch):
                chosen = order[k : k + batch]
                _, grad = self.gradients([pages[i] for i in chosen], [labels[i] for i in chosen])
                step += 1
                for name, g in grad.items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    self.w[name] = (self.w[name] - falling * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def chances(self, pages: list[np.ndarray], group: int = 64) -> list[np.ndarray]:
        """Chance of every block; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        start = 0
        while start < len(order):
            stop = start + 1
            while stop < len(order) and stop - start < group and len(pages[order[stop]]) * (stop - start + 1) <= 8192:
                stop += 1
            chosen = order[start:stop]
            chance, _ = self.forward([pages[k] for k in chosen])
            for column, k in enumerate(chosen):
                out[k] = chance[: len(pages[k]), column]
            start = stop
        return out


# Make-ups that pages are given while fitting: containers of the main text, and of what stands beside it.
MAIN_ELEMENTS = (
    ("article",), ("main",), ("div", "content"), ("div", "post", "body"), ("section", "story"), ("div", "entry", "text"), ("div",), ("td",), ("div", "article"), ("div", "main"),
    ("section",), ("div", "page"),
)
SIDE_ELEMENTS = {
    "sidebar": (("div", "sidebar"), ("aside",), ("aside", "sidebar"), ("div", "side"), ("div", "widget"), ("section", "sidebar"), ("ul", "sidebar")),
    "comments": (("div", "comments"), ("section", "comments"), ("ol", "comment", "list"), ("div", "comment"), ("div", "replies"), ("section", "discussion"), ("li", "comment"), ("article", "comment")),
    "form": (("form",), ("form",), ("form",), ("form",), ("form", "newsletter"), ("form", "search"), ("div", "newsletter", "form"), ("div", "subscribe"), ("form", "contact")),
    "footer": (("footer",), ("footer",), ("div", "footer"), ("footer", "site"), ("div", "copyright")),
    "notice": (("div", "cookie", "notice"), ("div", "notice"), ("div", "alert"), ("div", "consent"), ("div", "cookie", "banner")),
    "advert": (("div", "banner", "ad"), ("div", "ad"), ("div", "advert"), ("aside", "promo"), ("div", "sponsored"), ("div", "ads")),
    "menu": (("header",), ("div", "header"), ("nav",), ("div", "menu"), ("ul", "nav"), ("div", "related"), ("section", "related"), ("div", "share"), ("div", "breadcrumb")),
}
INNER_ELEMENTS = ((("p",),), (("p",),), (("li",),), (("div",),), (("ul",), ("li",)), (("div", "text"), ("p",)), (("div",), ("p",)), ())


def altered(rows: list[tuple[tuple, str, float]], rng: np.random.Generator) -> tuple[list[tuple[tuple, str, float]], list[float]]:
    """A page in another make-up, with labels.

    Containers are renamed or lose their names. Side blocks, as often in the words of the main text as in their own,
    are woven in before, inside and behind it, so that neither words nor length nor place alone tell them apart.
    """
    label = [weak_label(path) for path, _, _ in rows]
    known = [float("nan") if v is None else float(v) for v in label]
    style = rng.integers(0, 6)
    main = MAIN_ELEMENTS[rng.integers(0, len(MAIN_ELEMENTS))]
    out, marks = [], []
    side_texts = [text for (_, text, _), v in zip(rows, label, strict=True) if v == 0] or ["menu"]
    main_texts = [text for (_, text, _), v in zip(rows, label, strict=True) if v == 1] or ["text"]
    body = (("html",), ("body",)) if rng.random() < 0.7 else (("html",), ("body",), ("div",))
    for (path, text, share), mark in zip(rows, known, strict=True):
        if mark == 1 and style:
            at = [k for k, e in enumerate(path) if MAIN_WORDS.intersection(e) and e[0] != "body"]
            path = (*(path[: at[0]] if rng.random() < 0.5 else body), main, *path[at[-1] + 1 :]) if at else path
        elif style == 3 and mark == 0:
            path = tuple((e[0],) if e[0] == "div" else e for e in path)
        out.append((path, text, share))
        marks.append(mark)
    kinds = list(SIDE_ELEMENTS)
    for _ in range(int(rng.integers(4, 10))):
        kind = SIDE_ELEMENTS[kinds[rng.integers(0, len(kinds))]]
        side = kind[rng.integers(0, len(kind))]
        inner = INNER_ELEMENTS[rng.integers(0, len(INNER_ELEMENTS))]
        pool = main_texts if rng.random() < 0.6 else side_texts
        main_places = [k for k, v in enumerate(marks) if v == 1]
        where = rng.random()
        if where < 0.45 or not main_places:
            place = int(rng.integers(main_places[-1] + 1 if main_places else 0, len(out) + 1))
        elif where < 0.75:
            place = int(rng.integers(0, main_places[0] + 1))
        else:
            place = int(rng.integers(0, len(out) + 1))
        base = body
        if main_places and rng.random() < 0.3:  # inside the main text's own container
            path = out[main_places[0]][0]
            base = path[: max(2, len(path) - 1)]
        woven = []
        for _ in range(int(rng.integers(1, 6))):
            text = pool[rng.integers(0, len(pool))]
            if rng.random() < 0.3:
                text = " ".join(text.split()[: int(rng.integers(1, 40))]) or "x"
            woven.append(((*base, side, *inner), text, float(rng.random() < 0.2)))
        out[place:place] = woven
        marks[place:place] = [0.0] * len(woven)
    return out, marks


def fit(pages: DataFrame, sample: int = SAMPLE, copies: int = 5, id_col: str = "page_id", html_col: str = "html") -> Labeller:
    """Fit on about ``sample`` pages drawn by hash from all."""
    rows = pages.select(F.col(id_col).alias("k"), F.col(html_col).cast("string").alias("html")).where("html IS NOT NULL")
    total = rows.count()
    draw = F.pmod(F.xxhash64("k", "html"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / max(1, total))))

    def run(batches):
        for batch in batches:
            for page in batch.column(0).to_pylist():
                found = blocks(page)
                rng = np.random.default_rng(row_number_of(page[:2000], 1) >> 1)
                for _ in range(copies):
                    first = int(rng.integers(0, max(1, len(found) - MAX_STEPS + 1)))
                    made, marks = altered(found[first : first + MAX_STEPS], rng)
                    yield pa.RecordBatch.from_arrays([pa.array([vectors(made).tobytes()], pa.binary()), pa.array([np.array(marks, np.float32).tobytes()], pa.binary())], names=["x", "y"])

    found = rows.where(draw).select("html").mapInArrow(run, "x binary, y binary").toArrow()
    x = [np.frombuffer(v.as_py(), np.float32).reshape(-1, INPUT) for v in found.column("x")]
    y = [np.frombuffer(v.as_py(), np.float32) for v in found.column("y")]
    keep = sorted((k for k in range(len(x)) if len(x[k])), key=lambda k: (len(x[k]), x[k].tobytes()[:256]))
    model = Labeller()
    if keep:
        model.fit([x[k] for k in keep], [y[k] for k in keep])
    return model


def main_text(pages: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [blocks(page or "") for page in part.column(2).to_pylist()]
                flat = vectors([row for rows in found for row in rows])
                cuts = np.cumsum([0, *map(len, found)])
                chance = model.chances([flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
                texts = ["\n\n".join(text for (_, text, _), c in zip(rows, own, strict=True) if c > 0.5) for rows, own in zip(found, chance, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on the table's pages and extract all of them."""
    return main_text(pages, fit(pages, sample))
