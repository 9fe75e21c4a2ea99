"""Main text of HTML pages with a tree-structured graphical model.

A page becomes a tree of block elements with runs of text as leaves. Every node has a hidden
state, content or not. The state of an element depends on its parent's through a potential of its
tag; class and id words of an element and the shape of a run (length, links, sentence end) add
evidence, each once, at the node that carries it, and like items of a list share theirs. One upward and one downward pass of sum-product
messages yield each node's marginal; runs whose marginal is at least one half are the page's
text. All potentials are counted from labelled pages, and the weight of the evidence against the
edges is chosen on pages that were not counted.

Reading a page takes time in proportion to its length, also where quotes, tags and comments are
not closed: quotes without a partner are plain characters, and open elements are found by tag.

Defined results: null and empty html give an empty text; unclosed, crossed and unknown tags are
accepted; a page in which nothing is content gives an empty text; repeated rows are read
one by one; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from razao.llm.common import stored

MAX_LABELLED = 2_000
FIT_TASKS = 16
SMOOTHING = 0.5
PAIR_STRENGTH = 4.0

# Elements of HTML by how they take part in the page's text.
SILENT = frozenset("script style template head select textarea title".split())
RAW = frozenset("script style textarea title template".split())
EMBEDDED = frozenset("svg noscript iframe object canvas audio video".split())  # their text is a run of the block they stand in
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var"
    " math semantics annotation mrow mi mn mo ms mtext mspace mstyle mfrac msup msub msubsup msqrt mroot munder mover munderover mpadded mphantom menclose merror mfenced".split()
)
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
ITEMS = frozenset("li dt dd td th".split())
SCOPE = frozenset("body html table ul ol dl article section main div nav aside header footer form td th blockquote".split())
TAG_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
IN_TAG = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
SENTENCE_END = tuple(".!?…:;\"'”»")
SPACE = re.compile(r"[\s ]+")


@dataclass
class Node:
    tag: str
    parent: int
    marks: tuple[str, ...] = ()
    text: list = field(default_factory=list)  # of a run: (text, inside a link)


@dataclass
class Page:
    nodes: list  # parents come before their children
    runs: list  # positions of the text runs, in page order


def tag_end(source: str, at: int, last: dict[str, int]) -> int:
    """The position after the tag whose attributes begin at ``at``.

    A quote after an equals sign runs to its partner; without one, or elsewhere, it is a plain
    character. ``last`` has the last position of each kind of quote.
    """
    while True:
        m = IN_TAG.search(source, at)
        if m is None:
            return len(source)
        at = m.end()
        if m[0] == ">":
            return at
        k = at - 2
        while k >= 0 and source[k] in " \t\r\n\f":
            k -= 1
        if source[k] == "=" and last[m[0]] >= at:
            at = source.index(m[0], at) + 1


class _Open:
    """The open elements, found by tag without a walk."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("#page", 0)]  # with their block node
        self.where: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, tag: str, node: int) -> None:
        self.where.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, node))

    def pop(self) -> str:
        tag, _ = self.stack.pop()
        self.where[tag].pop()
        if tag in SCOPE:
            self.scopes.pop()
        return tag

    def topmost(self, tags) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def bounded(self, position: int) -> bool:
        """Whether an element that bounds a scope is open above the position."""
        return bool(self.scopes) and self.scopes[-1] > position


def parse(source: str) -> Page:
    """Blocks and text runs; inline elements only mark their text."""
    nodes, runs = [Node("#page", -1)], []
    held = _Open()
    run: Node | None = None
    links = silent = drawn = 0
    at, n = 0, len(source)
    last = {quote: source.rfind(quote) for quote in "\"'"}

    def say(text: str) -> None:
        nonlocal run
        if not text or silent:
            return
        if run is None:
            if not text.strip():
                return
            run = Node("#text", held.stack[-1][1])
            nodes.append(run)
            runs.append(len(nodes) - 1)
        run.text.append((text, links > 0))

    def close(position: int) -> None:
        nonlocal run, links, silent, drawn
        while len(held.stack) > position:
            tag = held.pop()
            if tag == "a":
                links -= 1
            if tag == "svg":
                drawn -= 1
            if tag in SILENT:
                silent -= 1
            if tag not in INLINE:
                run = None

    while at < n:
        start = source.find("<", at)
        if start < 0:
            say(source[at:])
            break
        if start > at:
            say(source[at:start])
        at = start + 1
        if source.startswith("!--", at):
            end = source.find("-->", at + 1)
            at = end + 3 if end >= 0 else n
            continue
        if source.startswith("![CDATA[", at):
            end = source.find("]]>", at)
            say(entities_off(source[at + 8 : end if end >= 0 else n]))
            at = end + 3 if end >= 0 else n
            continue
        if source[at : at + 1] in ("!", "?"):
            end = source.find(">", at)
            at = end + 1 if end >= 0 else n
            continue
        m = TAG_NAME.match(source, at)
        if m is None:
            say("<")
            continue
        at = tag_end(source, m.end(), last)
        attributes = source[m.end() : at].removesuffix(">")
        tag = m[2].lower()
        if m[1]:
            found = held.topmost((tag,))
            if found and not ((tag in INLINE or tag in ("p", "li")) and held.bounded(found)):
                close(found)
            if tag not in INLINE:
                run = None
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                run = None
            continue
        if tag not in SILENT and (drawn or tag in EMBEDDED):
            if tag not in INLINE:
                run = None
            if not attributes.endswith("/"):
                held.push(tag, held.stack[-1][1])
                drawn += tag == "svg"
                links += tag == "a"
            continue
        ended = CLOSES.get(tag) or ({"p"} if tag not in INLINE and not drawn else ())
        found = held.topmost(ended)
        if found and not held.bounded(found):
            close(found)
        if attributes.endswith("/") and (tag in RAW or tag not in INLINE and tag in SILENT):
            continue
        if tag in INLINE:
            held.push(tag, held.stack[-1][1])
            links += tag == "a"
            continue
        run = None
        nodes.append(Node(tag, held.stack[-1][1], _marks(attributes)))
        held.push(tag, len(nodes) - 1)
        if tag in SILENT:
            silent += 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else n
            close(len(held.stack) - 1)
    return Page(nodes, runs)


def entities_off(text: str) -> str:
    """CDATA text is taken as it stands, so its ampersands are protected from decoding."""
    return text.replace("&", "&amp;")


def _marks(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes and "hidden" not in attributes.lower():
        return ()
    out = []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if "hidden" in name:
            if value.lower() != "false":
                out.append("hidden")
        else:
            out += [w.lower() for w in WORDS.findall(value)]
    return tuple(dict.fromkeys(out))


def run_text(node: Node) -> str:
    return SPACE.sub(" ", entities.unescape("".join(t for t, _ in node.text))).strip()


def shape(node: Node, text: str) -> str:
    """Length, share of links, sentence end and copyright signs of a run, as one category."""
    words = max(text.count(" ") + 1, len(text) // 12)
    size = sum(words > k for k in (3, 12, 40))
    linked = sum(len(t) for t, in_link in node.text if in_link)
    links = 0 if not linked else 2 if linked >= 0.9 * len(text) else 1
    return f"shape:{size}:{links}:{text[-1:] in SENTENCE_END}:{'©' in text or '·' in text}"


def features(page: Page, texts: list[str]) -> list[tuple[str, ...]]:
    """Per node its evidence: class and id words of elements, the shape of runs."""
    out = [tuple(f"mark:{m}" for m in node.marks) for node in page.nodes]
    for i, text in zip(page.runs, texts, strict=True):
        out[i] = (shape(page.nodes[i], text),)
    return out


# ---------------------------------------------------------------- model


@dataclass
class Model:
    """Counts of labelled nodes, as potentials."""

    unary: dict  # feature -> log odds of content
    edge: dict  # child tag, or parent>child -> (P(content | parent content), P(content | parent not))
    default_edge: tuple[float, float]
    root: float  # log odds of the page node

    weight: float = 1.0  # of the features against the edges

    def edge_of(self, parent: str, tag: str) -> tuple[float, float]:
        return self.edge.get(f"{parent}>{tag}") or self.edge.get(tag, self.default_edge)

    def own(self, feats: tuple[str, ...]) -> float:
        return self.weight * sum(self.unary.get(f, 0.0) for f in feats)


def marginals(page: Page, feats: list[tuple[str, ...]], model: Model) -> list[float]:
    """Log odds of content for every node: messages upward, then downward."""
    n = len(page.nodes)
    belief = [model.own(f) for f in feats]
    # items of one shape in a list or row are one piece of evidence together
    items = [(i, (page.nodes[page.nodes[i].parent].parent, feats[i])) for i in page.runs if page.nodes[page.nodes[i].parent].tag in ITEMS]
    alike = Counter(group for _, group in items)
    for i, group in items:
        belief[i] /= alike[group]
    edges = [model.edge_of(page.nodes[node.parent].tag, node.tag) for node in page.nodes]
    up = [0.0] * n
    for i in range(n - 1, 0, -1):
        a, c = edges[i]
        e = math.exp(max(-30.0, min(30.0, belief[i])))
        up[i] = math.log((a * e + 1 - a) / (c * e + 1 - c))
        belief[page.nodes[i].parent] += up[i]
    total = belief
    total[0] += model.root
    for i in range(1, n):
        a, c = edges[i]
        e = math.exp(max(-30.0, min(30.0, total[page.nodes[i].parent] - up[i])))
        total[i] += math.log((a * e + c) / ((1 - a) * e + 1 - c))
    return total


def semantic_labels(page: Page) -> list[bool]:
    """Pages that mark up their article label themselves: the nearest article or aside decides."""
    out: list[bool] = []
    for node in page.nodes:
        if node.tag in ASIDE or not BOILERPLATE.isdisjoint(node.marks):
            out.append(False)
        elif node.tag in ("article", "main") or "articlebody" in node.marks:
            out.append(True)
        else:
            out.append(bool(out) and out[node.parent])
    return out


def part_labels(page: Page) -> list[bool]:
    """Layouts name their parts by two helper elements."""
    out: list[bool] = []
    for node in page.nodes:
        out.append(node.tag == "in-part" if node.tag in PARTS else bool(out) and out[node.parent])
    return out


def node_states(page: Page, texts: list[str], labels: list[bool]) -> list[int | None]:
    """The state of most of the text under each node; None without text."""
    weight = [[0, 0] for _ in page.nodes]
    for i, text in zip(page.runs, texts, strict=True):
        weight[i][int(labels[i])] += len(text)
    for i in range(len(page.nodes) - 1, 0, -1):
        p = page.nodes[i].parent
        weight[p][0] += weight[i][0]
        weight[p][1] += weight[i][1]
    return [int(b > a) if a + b else None for a, b in weight]


def without_parts(page: Page) -> Page:
    """The tree without the layouts' helper elements: their children belong to their parents."""
    number, nodes, runs = [], [], []
    for i, node in enumerate(page.nodes):
        if node.tag in PARTS:
            number.append(number[node.parent])
            continue
        number.append(len(nodes))
        nodes.append(Node(node.tag, number[node.parent] if i else -1, node.marks, node.text))
        if node.tag == "#text":
            runs.append(len(nodes) - 1)
    return Page(nodes, runs)


def labelled(source: str, dressed: bool) -> tuple[Page, list[str], list[bool]]:
    """A page as the model sees it, the texts of its runs, and whether each node is content."""
    page = parse(source)
    labels = part_labels(page) if dressed else semantic_labels(page)
    if dressed:
        kept = [node.tag not in PARTS for node in page.nodes]
        page, labels = without_parts(page), [x for x, k in zip(labels, kept, strict=True) if k]
    return page, [run_text(page.nodes[i]) for i in page.runs], labels


def labelled_counts(page: Page, texts: list[str], labels: list[bool]) -> Counter:
    """Counts for training: (feature, state), (edge, tag, parent state, state), (root, state)."""
    out: Counter = Counter()
    states = node_states(page, texts, labels)
    for i, (node, feats) in enumerate(zip(page.nodes, features(page, texts), strict=True)):
        if states[i] is None:
            continue
        for f in feats:
            out["f", f, states[i]] += 1
        if i:
            for name in (node.tag, f"{page.nodes[node.parent].tag}>{node.tag}"):
                out["e", name, states[node.parent], states[i]] += 1
        else:
            out["r", "", states[0]] += 1
        out["n", "#text" if node.tag == "#text" else "", states[i]] += 1
    return out


# Elements and class words that name the parts around an article.
ASIDE = frozenset("nav header footer aside form button menu dialog".split())
BOILERPLATE = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer footer form gdpr header"
    " hidden login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted recommended related"
    " reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)

PARTS = ("in-part", "out-part")

# Labelled layouts: how the text of a page at hand is dressed, so that training also sees pages
# with other elements. s, t, u, v are a few words, m and n a line, x and y a paragraph; w is a word of
# the list above, so that each word is learnt from layouts that use it.
PARTS_OUT = (
    '<nav><a href="/">{s}</a><a href="/b">{t}</a></nav>', "<nav><ul><li><a href='/'>{s}</a></li><li><a href='/'>{t}</a></li><li>{u}</li></ul></nav>",
    '<div class="{w}"><ul><li><a href="/">{s}</a></li><li><a href="/c">{t}</a></li></ul></div>', "<header><h1>{s}</h1><p>{m}</p></header>",
    '<header><a href="/">{s}</a><nav><a href="/x">{t}</a></nav></header>', '<div id="{w}"><a href="/">{s}</a></div>', "<footer><p>{m}</p></footer>",
    "<footer>&copy; {s} &middot; {m}</footer>", '<div class="{w}">&copy; {s} &middot; {t}</div>', "<aside><h3>{s}</h3><p>{x}</p><a href='/r'>{t}</a></aside>",
    "<aside><ul><li>{s}</li><li>{t}</li></ul></aside>", '<div class="{w}"><p>{m}</p><ul><li><a href="/s">{s}</a></li></ul></div>', '<div class="{w}">{m}</div>',
    '<div class="{w}"><p>{x}</p></div>', '<div class="{w}">{x}</div>', '<section class="{w}"><h3>{s}</h3><p>{x}</p><p>{m}</p></section>', '<div id="{w}"><h2>{s}</h2><ol><li><p>{x}</p></li><li><p>{y}</p></li></ol></div>',
    '<section class="comments"><div class="comment"><p>{x}</p></div><div class="comment"><p>{m}</p></div></section>', '<ul class="{w}"><li>{s}</li><li>{t}</li></ul>', '<p class="{w}">{m}</p>',
    "<form action='/s'><label>{s}</label><p>{m}</p><input><button>{t}</button></form>", '<div class="{w}"><a href="/x">{m}</a><p>{n}</p></div>', "<div hidden><p>{x}</p></div>", "<dialog><p>{m}</p></dialog>", '<span class="{w}">{s}</span>',
    "<div><a href='/'>{s}</a> <a href='/b'>{t}</a> <a href='/c'>{u}</a></div>", "<ul><li><a href='/'>{s}</a></li><li><a href='/b'>{t}</a></li><li><a href='/c'>{u}</a></li></ul>", )
PARTS_IN = (
    "<h1>{m}</h1><p>{x}</p><p>{y}</p>", "<h1>{s}</h1><ul><li>{t}</li><li>{u}</li><li>{v}</li></ul>", "<h1>{m}</h1><p>{x}</p><ul><li>{s}</li><li>{n}</li><li>{y}</li></ul>",
    "<h2>{s}</h2><p>{x}</p><p><a href='/k'>{y}</a></p>", "<h1>{m}</h1><p><a href='/k'>{n}</a></p><p>{x}</p>", "<h1>{m}</h1><p>{x} <a href='/k'>{s}</a> {n}</p><p>{t}</p>",
    "<h1>{m}</h1><p>{x}</p><table><tr><th>{s}</th><th>{t}</th></tr><tr><td>{u}</td><td>{v}</td></tr></table>", "<p>{s}</p><p>{t}</p><p>{x}</p><p>{u}</p>", "<table><tr><td>{s}</td><td>{m}</td></tr><tr><td>{t}</td><td>{n}</td></tr></table>",
    "<h1>{s}</h1><p>{x}</p><ol><li><a href='/k'>{m}</a></li><li><a href='/l'>{n}</a></li></ol>", "<h1>{m}</h1><div><p>{x}</p><blockquote><p>{y}</p></blockquote></div>", "<p>{x}<p>{y}<h3>{s}</h3><p>{m}",
    "<h1>{m}</h1><section><h2>{s}</h2><p>{y}</p></section><pre>{x}</pre>", "<h1>{m}</h1><dl><dt>{s}</dt><dd>{n}</dd><dt>{t}</dt><dd>{x}</dd></dl>", "<h1>{m}</h1><figure><figcaption>{n}</figcaption></figure><p>{x}</p>",
    "<h1>{s}</h1><ol><li>{m}</li><li>{n}</li><li>{t}</li><li>{u}</li></ol><p>{v}</p>", "<h1>{m}</h1><div>{x}</div><div>{y}</div>", "<h1>{m}</h1><p>{n}</p><ul><li><a href='/k'>{s}</a></li><li><a href='/l'>{t}</a></li></ul><p>{m}</p>",
    "<h2>{s}</h2><p>{x}</p><ul><li><a href='/k'>{t}</a></li><li><a href='/l'>{u}</a></li><li><a href='/m'>{v}</a></li></ul>", "<h1>{m}</h1><p>{x}</p><ul><li><a href='/k'>{m}</a></li><li><a href='/l'>{s}</a></li></ul>",
)
FRAMES = (
    "<body>{out}<article>{inside}{within}</article>{out2}</body>", "<body>{out}<main>{inside}</main>{out2}</body>", "<body>{out}<main><article>{inside}</article>{within}</main>{out2}</body>",
    '<body>{out}<div class="content">{inside}{within}</div>{out2}</body>', '<body><div id="page">{out}<div class="post entry-content">{inside}</div>{out2}</div></body>',
    "<body>{out}<article>{inside}</article>{out2}</body>", '<body>{out}<div class="article-body">{inside}</div>{out2}</body>', "<body><article>{inside}</article></body>", "<body>{out}<article><header>{inside}</header>{inside2}</article>{out2}</body>",
)
LAYOUTS = 4


def pieces_of(texts: list[str], number: int) -> dict[str, str]:
    """Words, lines and paragraphs of a page's own text, to fill layouts with."""
    words = " ".join(texts).split() or ["words"]

    def cut(k: int, n: int) -> str:
        start = (number * 31 + k * 97) % len(words)
        return entities.escape(" ".join((words[start:] + words)[:n]), quote=False)

    sizes = {"s": 1, "t": 2, "u": 3, "v": 1, "m": 6 + number % 5, "n": 9, "x": 25 + number % 40, "y": 45}
    ends = {"m": "", "n": ".", "x": ".", "y": "."}
    return {k: cut(i, n).rstrip(".,;:") + ends.get(k, "") for i, (k, n) in enumerate(sizes.items())}


def layouts(source: str, number: int) -> list[str]:
    """Dressed forms of a page's own text; helper elements name what is content."""
    page = parse(source)
    texts = [run_text(page.nodes[i]) for i in page.runs]
    words = sorted(BOILERPLATE)
    out = []
    for k in range(LAYOUTS):
        j = number * LAYOUTS + k

        def part(of: tuple[str, ...], step: int, j: int = j) -> str:
            fill = pieces_of(texts, j + step)
            return of[(j + step * 5) % len(of)].format(w=words[(j * 3 + step) % len(words)], **fill)

        # the last parts of the list, links without any name, only stand outside of an article
        dress = ["<out-part>" + part(PARTS_OUT if step < 4 else PARTS_OUT[:-2], step) + "</out-part>" for step in range(5)]
        inside = ["<in-part>" + part(PARTS_IN, step) + "</in-part>" for step in (0, 1)]
        # the outside may hold much or little of the page
        left = "".join(dress[: 1 + j % 3])
        out.append(FRAMES[(j // 2) % len(FRAMES)].format(out=left, out2=dress[3], within=dress[4], inside=inside[0], inside2=inside[1]))
    return out


def training_pages(number: int, source: str) -> Iterator[tuple[Page, list[str], list[bool]]]:
    """The page itself where it marks up its article, and its layouts."""
    own = labelled(source, False)
    if any(own[2][i] for i in own[0].runs):
        yield own
    for dressed in layouts(source, number):
        yield labelled(dressed, True)


def fit(pages: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Potentials from at most ``max_labelled`` pages, chosen by a hash of the id; equal pages count once.

    Pages that mark up their article label themselves; each also lends its text to labelled layouts
    of other kinds. One page in four is not counted and serves to choose the weight of the evidence.
    """
    usable = pages.where("html IS NOT NULL AND page_id IS NOT NULL").select("page_id", "html", F.xxhash64("html").alias("mark"))
    # Ids are picked before any html moves, so that only the picked pages' html meets.
    picked = usable.select("page_id", "mark").distinct().orderBy(F.xxhash64("page_id"), "page_id", "mark").limit(max_labelled)
    chosen = usable.join(F.broadcast(picked), ["page_id", "mark"], "left_semi").dropDuplicates(["page_id", "mark"])
    number = F.pmod(F.xxhash64(F.lit("layout"), "page_id"), F.lit(1 << 20)).alias("number")
    chosen = stored(chosen.select(number, F.col("html").cast("string").alias("html")).repartition(FIT_TASKS, "number"), "labelled-pages")

    def numbered(batches, held_out: bool):
        for batch in batches:
            for number, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (number % 4 == 3) == held_out:
                    yield from training_pages(number, source)

    def count(batches):
        total: Counter = Counter()
        for example in numbered(batches, False):
            total.update(labelled_counts(*example))
        rows = [(k[0], k[1], k[2], k[3] if len(k) > 3 else -1, n) for k, n in total.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), *[pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3, 4)]],
            names=["kind", "name", "a", "b", "n"],
        )

    rows = chosen.mapInArrow(count, "kind string, name string, a long, b long, n long").groupBy("kind", "name", "a", "b").agg(F.sum("n").alias("n")).collect()
    model = model_of({(r.kind, r.name, r.a) if r.b < 0 else (r.kind, r.name, r.a, r.b): r.n for r in rows})

    def judge(batches):
        loss = [0.0] * len(WEIGHTS)
        for page, texts, labels in numbered(batches, True):
            feats = features(page, texts)
            for k, weight in enumerate(WEIGHTS):
                total = marginals(page, feats, replace(model, weight=weight))
                loss[k] += sum(math.log1p(math.exp(-max(-30.0, min(30.0, total[i] if labels[i] else -total[i])))) for i in page.runs)
        yield pa.RecordBatch.from_arrays([pa.array(WEIGHTS), pa.array(loss)], names=["weight", "loss"])

    judged = chosen.mapInArrow(judge, "weight double, loss double").groupBy("weight").agg(F.sum("loss").alias("loss")).collect()
    best = min(((round(r.loss, 6), -r.weight) for r in judged), default=(0.0, -1.0))
    return replace(model, weight=-best[1])


WEIGHTS = (0.1, 0.2, 0.35, 0.5, 0.75, 1.0)


def model_of(counts: dict) -> Model:
    def odds(name: str, base: str) -> float:
        c0, c1 = (counts.get(("f", name, s), 0) for s in (0, 1))
        n0, n1 = (counts.get(("n", base, s), 0) for s in (0, 1))
        return math.log((c1 + SMOOTHING) / (n1 + 2 * SMOOTHING)) - math.log((c0 + SMOOTHING) / (n0 + 2 * SMOOTHING))

    unary = {k[1]: odds(k[1], "#text" if k[1].startswith("shape:") else "") for k in counts if k[0] == "f"}

    def edge(name: str, towards: tuple[float, float], strength: float) -> tuple[float, float]:
        out = []
        for parent, prior in zip((1, 0), towards, strict=True):
            no, yes = (counts.get(("e", name, parent, s), 0) for s in (0, 1))
            out.append((yes + strength * prior) / (yes + no + strength))
        return out[0], out[1]

    # pairs lean on their tag, tags on the rule that a child is like its parent
    default = (0.9, 0.1)
    names = {k[1] for k in counts if k[0] == "e"}
    edges = {t: edge(t, default, 2 * SMOOTHING) for t in names if ">" not in t}
    edges |= {t: edge(t, edges[t.split(">")[1]], PAIR_STRENGTH) for t in names if ">" in t}
    root = math.log((counts.get(("r", "", 1), 0) + 1) / (counts.get(("r", "", 0), 0) + 1))
    return Model(unary, edges, default, root)


def extract_text(source: str, model: Model) -> str:
    """The runs whose marginal is at least one half, one line each."""
    page = parse(source)
    texts = [run_text(page.nodes[i]) for i in page.runs]
    total = marginals(page, features(page, texts), model)
    return "\n".join(t for i, t in zip(page.runs, texts, strict=True) if t and total[i] >= 0)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def read(batches):
        for batch in batches:
            texts = [extract_text(s, model) if s else "" for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")


def html_extract(pages: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    return extract(pages, fit(pages, max_labelled))
