"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: texts between block-level tags, each with its path of tags,
classes and ids. A bidirectional LSTM in numpy reads a vector of the path and a vector of the hashed words of
every block and labels all blocks with the context of the whole page. Main blocks are joined in page order.

There are no labels to learn from, so the training pages name their own: on a bounded sample, blocks inside
an article element and outside any named boilerplate are main. The sampled texts are also set into other
page layouts (other containers, notices, forms, side bars, reader comments), so the labeller learns paths
rather than one site.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from quillon.llm.common import needs, slices, texts_of

# Element kinds of HTML.
BLOCKS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary
    table tbody td textarea tfoot th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of these kinds.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("tbody", "thead"), "tfoot": ("tbody", "thead"),
}
#: Elements past which an implied end does not reach.
SCOPES = frozenset("article aside body div fieldset footer form header html main nav section table td th ul ol dl".split())
INLINE_FLOW = BLOCKS - {"button", "dd", "dt", "head", "html", "body", "li", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "title", "caption", "legend"}
#: Elements whose content is not text of the page; those of NESTED may hold their own kind.
UNSEEN = frozenset("iframe noscript select svg template textarea".split())
NESTED = frozenset(("svg", "template"))
#: Start tags that a head may hold; any other ends it, as its own end tag is optional.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript template title".split())
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*>",
    re.S | re.I,
)
TITLE_END = re.compile(r"<(?:(?P<own>/title)|/?head|/?body|title)(?:\s[^>]*)?>", re.I)
TAG_START = re.compile(r"<[!/?a-zA-Z]|\Z")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME_PARTS = re.compile(r"[a-z]+")
# Names that mark boilerplate and main containers when the training sample is labelled.
BOILERPLATE = frozenset(
    """nav menu header masthead banner footer copyright aside sidebar related widget ad ads advert advertisement adsbygoogle sponsored
    sponsor promo cookie consent notice alert popup form newsletter subscribe login search comment comments discussion respond share
    social breadcrumb breadcrumbs pagination tags""".split()
)
PATH_SIZE, WORD_BUCKETS, WORD_SIZE, HIDDEN = 48, 64, 12, 24
INPUT = PATH_SIZE + WORD_SIZE + 6
SAMPLE_PAGES, SAMPLE_CHARS = 300, 50_000
#: Steps of all pages whose gates are made at a time when blocks are labelled.
STEPS = 2048
#: Marks the main texts of a training layout while it is built.
OWN = "\ue000"


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def hidden_ends(source: str, kind: str, position: int) -> dict[int, int]:
    """End of each closed element of a kind from `position` on, by the place where its start tag ends.

    An element that cannot nest is unclosed if another one starts before its end tag.
    """
    text = r"" if kind in ("iframe", "textarea") else r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|"
    tags = re.compile(text + rf"<(?P<end>/?){kind}(?P<attributes>(?:[\s/](?:[^>\"']|\"[^\"]*\"|'[^']*')*+)?)>", re.S | re.I)
    ends: dict[int, int] = {}
    starts: list[int] = []
    for found in tags.finditer(source, position):
        if found["end"] is None:
            continue
        if found["end"]:
            if starts:
                ends[starts.pop()] = found.end()
            if kind not in NESTED:
                starts.clear()
        elif kind != "svg" or not found["attributes"].endswith("/"):
            starts.append(found.end())
    return ends


def leaf_blocks(source: str) -> list[Block]:
    """Blocks with text, in page order: references decoded, white space turned into single spaces and trimmed.

    Hidden elements are left out where they are closed; the start tag of an unclosed one is passed over, so that it hides nothing.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(t for t, _ in pieces)).split())
            if text:
                linked = sum(len(t) for t, in_link in pieces if in_link)
                blocks.append(Block(text, stack[-1][1] if stack else (), min(linked, len(text))))
            pieces.clear()

    def pop_to(place: int) -> None:
        nonlocal links
        for tag, _ in stack[place:]:
            links -= tag == "a"
        del stack[place:]

    position = 0
    in_head = False
    hidden: dict[str, dict[int, int]] = {}
    while found := MARKUP.search(source, position):
        if found.start() > position:
            in_head = in_head and source[position : found.start()].isspace()
            pieces.append((source[position : found.start()], links > 0))
        position = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if found["end"]:
            in_head = in_head and tag not in ("head", "body", "html", "br")
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag in BLOCKS:
                flush()
            if place is not None:
                pop_to(place)
            continue
        in_head = tag == "head" or in_head and tag in IN_HEAD
        if tag == "head":
            flush()
            continue
        if in_head and tag == "title":
            found = TITLE_END.search(source, position)
            position = found.end() if found and found["own"] else TAG_START.search(source, position).start()
            continue
        if tag in UNSEEN:
            if tag in BLOCKS:
                flush()
            if tag not in hidden:
                hidden[tag] = hidden_ends(source, tag, found.start())
            position = hidden[tag].get(position, position)
            continue
        if tag == "br":
            pieces.append((" ", links > 0))
            continue
        if tag in BLOCKS:
            flush()
            if tag in INLINE_FLOW:
                ended: tuple[str, ...] = ("p",)
            else:
                ended = ENDS.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ended:
                    pop_to(i)
                    break
                if stack[i][0] in SCOPES and stack[i][0] not in ended:
                    break
        if tag in VOID:
            continue
        attributes = found["attributes"]
        names = [tag]
        if attributes and not attributes.isspace():
            for parts in NAMES.findall(attributes):
                names += NAME_PARTS.findall("".join(parts).lower())
        links += tag == "a"
        # A path names each name once, the innermost last, and nested elements that add none share it.
        path = stack[-1][1] if stack else ()
        if not (path and path[-1] == names[-1] and set(names) <= set(path)):
            path = (*(name for name in dict.fromkeys([*path, *names]) if name != names[-1]), names[-1])
        stack.append((tag, path))
    pieces.append((source[position:], links > 0))
    flush()
    return blocks


def token_vector(token: str) -> np.ndarray:
    """A fixed random direction for each name."""
    return np.random.default_rng(xxhash.xxh64_intdigest(token)).choice([-1.0, 1.0], PATH_SIZE)


WORD_DIRECTIONS = np.random.default_rng(29).normal(size=(WORD_BUCKETS, WORD_SIZE))


class Vectors:
    """Input vectors of blocks; remembers those of paths."""

    def __init__(self):
        self.tokens: dict[str, np.ndarray] = {}
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        known = self.paths.get(path)
        if known is None:
            if len(self.paths) > 20_000 or len(self.tokens) > 20_000:
                self.paths.clear()
                self.tokens.clear()
            total = np.zeros(PATH_SIZE)
            for token in set(path):
                if token not in self.tokens:
                    self.tokens[token] = token_vector(token)
                total += self.tokens[token]
            known = self.paths[path] = total / 2
        return known

    def of(self, pages: list[list[Block]]) -> np.ndarray:
        """(blocks, INPUT), the pages' blocks one after another."""
        blocks = [b for page in pages for b in page]
        if not blocks:
            return np.zeros((0, INPUT))
        paths = np.array([self.path(b.path) for b in blocks])
        size = np.array([len(b.text) for b in blocks], float)
        linked = np.array([b.linked for b in blocks], float)
        place = np.concatenate([(np.arange(len(p)) + 0.5) / len(p) for p in pages if p])
        heading = np.array([bool(b.path) and b.path[-1][:1] == "h" and b.path[-1][1:].isdigit() for b in blocks], float)
        ends = np.array([b.text[-1] in ".!?:;" for b in blocks], float)
        other = np.stack([np.log1p(size) / 4 - 1, linked / size, place, 1 - place, heading, ends], 1)
        return np.concatenate([paths, word_counts([b.text for b in blocks]) @ WORD_DIRECTIONS, other], 1)


def word_counts(texts: list[str]) -> np.ndarray:
    """Share of each text's words in each hash bucket."""
    encoded = [t.encode() for t in texts]
    data = np.frombuffer(b" ".join(encoded) + b" " * 9, np.uint8)
    solid = data != 32
    start = np.flatnonzero(solid & np.append(True, ~solid[:-1]))
    end = np.flatnonzero(~solid & np.append(False, solid[:-1]))
    size = np.minimum(end - start, 8)
    head = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))[start]
    head = head & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - size.astype(np.uint64) * np.uint64(8)))
    mixed = (head ^ (end - start).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (mixed >> np.uint64(64 - 6)).astype(np.int64)
    bounds = np.cumsum([len(e) + 1 for e in encoded])
    owner = np.searchsorted(bounds, start, "right")
    counts = np.bincount(owner * WORD_BUCKETS + bucket, minlength=len(texts) * WORD_BUCKETS).reshape(len(texts), WORD_BUCKETS)
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Labeller:
    """Bidirectional LSTM with one hidden layer each way and a logistic output per block."""

    def __init__(self, seed: int = 19):
        random = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {"out": np.zeros(2 * HIDDEN), "bias": np.zeros(1)}
        for way in ("f", "b"):
            self.p[f"{way}x"] = random.normal(size=(INPUT, 4 * HIDDEN)) / np.sqrt(INPUT)
            self.p[f"{way}h"] = random.normal(size=(HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)
            self.p[f"{way}c"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)

    def run(self, way: str, x: np.ndarray, mask: np.ndarray, taped: bool = True) -> tuple[np.ndarray, list]:
        """Hidden states (b, t, h) and, if taped, what the backward pass needs. Steps beyond a page's end leave its state as it is.

        Without a tape the gates are made for some steps at a time, so memory follows the inputs and states alone.
        """
        b, t, _ = x.shape
        some = t if taped else STEPS
        h, c = np.zeros((b, HIDDEN)), np.zeros((b, HIDDEN))
        out, tape = np.zeros((b, t, HIDDEN)), []
        for i in range(t):
            if i % max(some, 1) == 0:
                gates = x[:, i : i + some] @ self.p[f"{way}x"] + self.p[f"{way}c"]
            z = gates[:, i % some] + h @ self.p[f"{way}h"]
            s = sigmoid(z[:, : 3 * HIDDEN])
            put, keep, show, new = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, i : i + 1]
            cell = keep * c + put * new
            squashed = np.tanh(cell)
            if taped:
                tape.append((h, c, put, keep, show, new, squashed, m))
            h, c = np.where(m, show * squashed, h), np.where(m, cell, c)
            out[:, i] = h
        return out, tape

    def back(self, way: str, x: np.ndarray, tape: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
        d_gates, d_h = np.zeros((*x.shape[:2], 4 * HIDDEN)), np.zeros((HIDDEN, 4 * HIDDEN))
        for i in range(x.shape[1] - 1, -1, -1):
            h, c, put, keep, show, new, squashed, m = tape[i]
            dh = dh + d_out[:, i]
            inside, through = np.where(m, dh, 0), np.where(m, 0, dh)
            d_cell = np.where(m, dc, 0) + inside * show * (1 - squashed**2)
            dz = np.concatenate(
                [d_cell * new * put * (1 - put), d_cell * c * keep * (1 - keep), inside * squashed * show * (1 - show), d_cell * put * (1 - new**2)], 1
            )
            d_gates[:, i] = dz
            d_h += h.T @ dz
            dh = through + dz @ self.p[f"{way}h"].T
            dc = np.where(m, d_cell * keep, dc)
        flat = d_gates.reshape(-1, 4 * HIDDEN)
        return {f"{way}x": x.reshape(-1, INPUT).T @ flat, f"{way}h": d_h, f"{way}c": flat.sum(0)}

    @staticmethod
    def reverse(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each page's own steps in reverse order, the padding where it was."""
        steps = np.arange(x.shape[1])[None, :]
        at = np.where(steps < lengths[:, None], lengths[:, None] - 1 - steps, steps)
        return np.take_along_axis(x, at[:, :, None], 1)

    def scores(self, x: np.ndarray, lengths: np.ndarray, taped: bool = True) -> tuple[np.ndarray, tuple]:
        mask = np.arange(x.shape[1])[None, :] < lengths[:, None]
        turned = self.reverse(x, lengths)
        forward, tape_f = self.run("f", x, mask, taped)
        backward, tape_b = self.run("b", turned, mask, taped)
        both = np.concatenate([forward, self.reverse(backward, lengths)], 2)
        return sigmoid(both @ self.p["out"] + self.p["bias"]), (x, turned, tape_f, tape_b, both, mask)

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 23) -> Labeller:
        """Adam on the cross-entropy of all blocks of pages (inputs, labels)."""
        pages = [p for p in pages if len(p[0])]
        random = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = sorted(random.permutation(len(pages)).tolist(), key=lambda i: len(pages[i][0]) // 16)
            groups = [order[i : i + batch] for i in range(0, len(order), batch)]
            for g in random.permutation(len(groups)).tolist():
                chosen = [pages[i] for i in groups[g]]
                lengths = np.array([len(x) for x, _ in chosen])
                x, y = np.zeros((len(chosen), lengths.max(), INPUT)), np.zeros((len(chosen), lengths.max()))
                for i, (inputs, labels) in enumerate(chosen):
                    x[i, : len(inputs)], y[i, : len(inputs)] = inputs, labels
                guess, (x, turned, tape_f, tape_b, both, mask) = self.scores(x, lengths)
                wrong = np.where(mask, guess - y, 0) / mask.sum()
                gradient = {"out": np.einsum("bt,bth->h", wrong, both), "bias": np.array([wrong.sum()])}
                d_both = wrong[:, :, None] * self.p["out"]
                gradient |= self.back("f", x, tape_f, d_both[:, :, :HIDDEN])
                gradient |= self.back("b", turned, tape_b, self.reverse(d_both[:, :, HIDDEN:], lengths))
                norm = np.sqrt(sum((g * g).sum() for g in gradient.values()))
                step += 1
                for k, g in gradient.items():
                    g = g * min(1.0, 1.0 / max(norm, 1e-12))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def label(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of being main for all blocks of pages that follow each other."""
        out = np.zeros(len(x))
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        for a, b in padded_groups(lengths[order].tolist()):
            own = order[a:b]
            size = lengths[own]
            steps = np.arange(size.max())[None, :]
            at = starts[own][:, None] + np.minimum(steps, size[:, None] - 1)
            guess, (*_, mask) = self.scores(x[at], size, taped=False)
            out[at[mask]] = guess[mask]
        return out


def padded_groups(sizes: list[int], most: int = 40_000) -> Iterator[tuple[int, int]]:
    """Ranges of ascending sizes whose padded total is bounded, or that hold one."""
    start = 0
    for i, size in enumerate(sizes):
        if i > start and (i + 1 - start) * size > most:
            yield start, i
            start = i
    if start < len(sizes):
        yield start, len(sizes)


def own_labels(blocks: list[Block]) -> list[bool] | None:
    """Labels that a page names itself: inside its article or main element and outside named boilerplate; None without such an element."""
    if not any("article" in b.path or "main" in b.path for b in blocks):
        return None
    return [("article" in b.path or "main" in b.path) and not BOILERPLATE & set(b.path) for b in blocks]


# Containers of main text and of boilerplate in the training layouts; {} holds the text.
MAIN_CONTAINERS = (
    "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="content"><div class="post">{}</div></div>',
    '<div class="post-body">{}</div>', '<div class="entry-content">{}</div>', '<section class="story">{}</section>', '<div class="article-body">{}</div>',
)
MAIN_PARTS = ("<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<div>{}</div>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>")
BEFORE = (
    "<header><h2>{}</h2></header>", '<div class="header"><p>{}</p></div>', '<div id="masthead"><a href="/">{}</a></div>', "<nav><ul><li><a href='/'>{}</a></li></ul></nav>",
    '<ul class="menu"><li><a href="/">{}</a></li></ul>', '<div class="breadcrumb"><a href="/">{}</a></div>', '<div class="ad">{}</div>', '<div class="cookie-notice"><p>{}</p></div>',
    '<div id="consent">{}</div>', '<div class="notice">{}</div>', '<div class="alert"><p>{}</p></div>', '<div class="banner">{}</div>', '<form class="search"><label>{}</label></form>',
)
INSIDE = ('<div class="ad">{}</div>', '<div class="advert"><p>{}</p></div>', '<aside class="related"><p>{}</p></aside>', '<div class="share"><a href="/">{}</a></div>', '<div class="newsletter"><form><p>{}</p></form></div>')
AFTER = (
    "<footer>{}</footer>", "<footer><p>{}</p></footer>", '<div class="footer"><p>{}</p></div>', '<div id="copyright">{}</div>', "<aside><h3>{}</h3></aside>", "<aside><p>{}</p></aside>",
    '<div class="sidebar"><p>{}</p></div>', '<div id="related"><ul><li><a href="/">{}</a></li></ul></div>', '<section class="comments"><div class="comment"><p>{}</p></div></section>',
    '<div id="comments"><ol><li><p>{}</p></li></ol></div>', '<div class="reader-comments"><p>{}</p></div>', '<div class="sponsored">{}</div>', '<div class="promo"><p>{}</p></div>',
    '<form action="/"><p>{}</p></form>', '<div class="subscribe"><p>{}</p></div>', '<div class="widget"><p>{}</p></div>', '<div class="pagination"><a href="/">{}</a></div>', '<div class="tags"><a href="/">{}</a></div>',
)


def laid_out(texts: list[str], random: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """A training page of the given texts in a random layout, with its labels."""

    def text() -> str:
        words = texts[int(random.integers(len(texts)))].split()
        return html.escape(" ".join(words[: int(random.integers(1, 40))]))

    def one(layouts: tuple[str, ...], own: bool) -> str:
        return layouts[int(random.integers(len(layouts)))].replace("{}", ("" if own else "") + text())

    parts = ["<h1>" + text() + "</h1>" if random.random() < 0.8 else "<header><h1>" + text() + "</h1></header>"]
    for _ in range(int(random.integers(1, 12))):
        parts.append(one(MAIN_PARTS[:1] if random.random() < 0.6 else MAIN_PARTS, True))
        if random.random() < 0.1:
            parts.append("</p>" + one(INSIDE, False))
    body = [one(BEFORE, False) for _ in range(int(random.integers(0, 5)))]
    body.append(MAIN_CONTAINERS[int(random.integers(len(MAIN_CONTAINERS)))].replace("{}", "".join(parts)))
    body += [one(AFTER, False) for _ in range(int(random.integers(0, 5)))]
    blocks = leaf_blocks("<html><body>" + "".join(body) + "</body></html>")
    labels = ["" in b.text for b in blocks]
    for block in blocks:
        block.text = block.text.replace("", "")
    return [b for b in blocks if b.text], [y for b, y in zip(blocks, labels) if b.text]


def train(pages: list[str], layouts: int = 900, seed: int = 31) -> Labeller:
    """A labeller of sampled pages; the same pages give the same labeller."""
    random = np.random.default_rng(seed)
    examples, texts = [], []
    for source in pages:
        blocks = leaf_blocks(source)
        texts += [b.text for b in blocks]
        if (labels := own_labels(blocks)) is not None:
            examples.append((blocks, labels))
    if texts:
        examples += [laid_out(texts, random) for _ in range(layouts)]
    vectors = Vectors()
    return Labeller().train([(vectors.of([blocks]), np.array(labels, float)) for blocks, labels in examples])


def training_sample(pages: DataFrame, key: str = "page_id", source: str = "html", most: int = SAMPLE_PAGES) -> list[str]:
    """At most `most` pages of at most SAMPLE_CHARS characters, chosen by a hash of the key."""
    able = pages.where(F.length(source).between(1, SAMPLE_CHARS)).select(F.xxhash64(key).alias("draw"), F.col(source).alias("html"))
    n = pages.count()
    rate = min(1.0, 3 * most / max(n, 1))
    drawn = able.where(F.pmod("draw", F.lit(1 << 30)) < int(rate * (1 << 30)))
    return [row["html"] for row in drawn.orderBy("draw", "html").limit(most).collect()]


def extracted(pages: DataFrame, labeller: Labeller, key: str = "page_id", source: str = "html", into: str = "text") -> DataFrame:
    """The key, other columns but the source, and the main text.

    Null and empty sources, and pages without a main block, give the empty text. Rows are independent: repeated rows
    give repeated results, an empty table an empty one. A column named like `into` is replaced.
    """
    needs(pages, key, source)
    kept = pages.drop(into)
    place = kept.columns.index(source)
    shared = pages.sparkSession.sparkContext.broadcast(labeller)
    schema = T.StructType([*[f for f in kept.schema.fields if f.name != source], T.StructField(into, T.StringType(), False)])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            sources = texts_of(batch.column(place))
            for a, b in slices(list(map(len, sources)), 1 << 21):
                found = [leaf_blocks(s) for s in sources[a:b]]
                lengths = np.array([len(x) for x in found])
                main = shared.value.label(vectors.of(found), lengths) >= 0.5
                ends = np.cumsum(lengths)
                texts = ["\n".join(block.text for block, y in zip(page, main[end - len(page) : end]) if y) for page, end in zip(found, ends.tolist())]
                columns = [c.slice(a, b - a) for i, c in enumerate(batch.columns) if i != place]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=schema.names)

    return kept.mapInArrow(extract, schema)
