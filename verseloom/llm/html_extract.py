"""Main text of HTML pages by tag-path ratios.

Text nodes are grouped by their root-to-leaf tag path. A path's score is its
text per node times its punctuation per node, each damped; scores are smoothed
over the paths in page order and fused along the tree to find the best container.
Its paths above the threshold give the content nodes: text elements by their
smoothed score, so that a short list shares that of the paragraphs around it,
others by their own. Headings in the container always stay. Containers that name themselves as
menus, adverts and the like aren't content unless the page's content lies within;
those of readers' comments never are.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame

#: Elements without an end tag; without content text; that aren't content; that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes")
APART = frozenset(
    "nav footer header aside form script style noscript template iframe textarea select option button head svg "
    "object audio video canvas dialog menu title noembed noframes".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
#: An element and the open ones that its start ends.
CLOSED_BY_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = frozenset("p li dd dt td th caption pre blockquote figcaption".split())
#: What reader text calls itself, and what else isn't content: whole words of class, id and role.
_more = r"(?:[_-]+(?:\d+|list|box|bar|area|section|block|slot|unit|wrap|wrapper|container|form|links|menu|buttons?|posts?|top|bottom|left|right))*"
READERS = re.compile(rf"(?:comments?|comment-\w+|disqus|replies|respond|shoutbox){_more}", re.I)
NOT_CONTENT = re.compile(
    r"(?:(?:site|page|top|bottom|left|right|global|primary|secondary)[_-]+)?(?:ads?|advert\w*|adsense|banner|breadcrumbs?|cookies?"
    r"|consent|footer|header|menu|masthead|modal|nav|navbar|newsletter|notices?|popup|promos?|promotions?|related|share|sharing"
    r"|sidebar|side-bar|social|sponsor\w*|subscribe|toolbar|widget|navigation|complementary|contentinfo|search|dialog|alert)" + _more,
    re.I,
)
THRESHOLD = 0.1  # of the best path's score in the container
ARTICLE_THRESHOLD = 0.15  # of the best path's ratio in a named article
ENOUGH = math.log1p(12)  # the ratio of a line of twelve letters without a mark: more stays in any article
_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.S)
_attribute = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_not_shown = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_space = re.compile(r"\s+")
_marks = re.compile(r"[.,;:!?。、，！？…]")


class Paths:
    """The tag paths of a page as a tree: each is a number, known by its parent's number and its last tag; 0 is the empty path."""

    def __init__(self) -> None:
        self.parent, self.tag = [0], [""]
        self.known: dict[tuple[int, str], int] = {}
        self.main = [False]  # whether main is on the path
        self.article = [False]

    def below(self, path: int, tag: str) -> int:
        if (found := self.known.get((path, tag))) is None:
            found = self.known[path, tag] = len(self.tag)
            self.parent.append(path)
            self.tag.append(tag)
            self.main.append(self.main[path] or tag == "main")
            self.article.append(self.article[path] or tag == "article")
        return found

    def inside(self, best: int) -> list[bool]:
        """For each path whether ``best`` is it or lies above it; parents have smaller numbers."""
        out = [best == 0]
        for path in range(1, len(self.tag)):
            out.append(path == best or out[self.parent[path]])
        return out


class Block:
    __slots__ = ("path", "text", "apart", "links", "named")

    def __init__(self, path: int, text: str, apart: bool, links: int, named: tuple[tuple[int, bool, bool], ...]) -> None:
        self.path, self.text, self.apart, self.links = path, text, apart, links
        #: elements around it whose names aren't content: number, whether of readers, whether the article lies within
        self.named = named


class _Open:
    """The open elements, with counts of what the parser asks about all of them."""

    __slots__ = ("rows", "names", "apart", "named", "articles", "serial")

    def __init__(self) -> None:
        self.rows: list[tuple[str, bool, int, bool, int, int]] = []  # tag, set apart, number if named, named as of readers, path, serial
        self.names: Counter[str] = Counter()
        self.apart = self.serial = 0
        self.named: list[tuple[int, bool, int]] = []  # number, of readers, serial
        self.articles: list[int] = []  # serials of article and main elements that aren't named

    def push(self, name: str, apart: bool, number: int, readers: bool, path: int) -> None:
        self.serial += 1
        self.rows.append((name, apart, number, readers, path, self.serial))
        self.names[name] += 1
        self.apart += apart
        if number:
            self.named.append((number, readers, self.serial))
        elif name in ("article", "main"):
            self.articles.append(self.serial)

    def _gone(self, row: tuple[str, bool, int, bool, int, int]) -> None:
        self.names[row[0]] -= 1
        self.apart -= row[1]
        if row[2]:
            self.named.remove((row[2], row[3], row[5]))
        elif row[0] in ("article", "main"):
            self.articles.remove(row[5])

    def cut(self, k: int) -> None:
        while len(self.rows) > k:
            self._gone(self.rows.pop())

    def drop(self, k: int) -> None:
        self._gone(self.rows.pop(k))

    @property
    def path(self) -> int:
        return self.rows[-1][4] if self.rows else 0


def _hidden(attributes: dict[str, str]) -> bool:
    return (
        "hidden" in attributes
        or attributes.get("aria-hidden", "").strip().lower() == "true"
        or bool(_not_shown.search(attributes.get("style", "")))
    )


def _fold(text: str) -> str:
    return _space.sub(" ", html.unescape(text)).strip()


RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


def blocks(page: str) -> tuple[list[Block], Paths]:
    """The page's blocks of text in page order, and its tag paths: path of block elements, text with single spaces, whether set apart.

    An element costs the same however deep it lies.
    """
    out: list[Block] = []
    paths, opened = Paths(), _Open()
    stack, count = opened.rows, opened.names
    number = 0
    held: list[str] = []
    linked: list[bool] = []  # whether each of these stands in a link

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = _fold("".join(held))
            if text:
                last = opened.articles[-1] if opened.articles else -1
                named = tuple((n, readers, serial < last) for n, readers, serial in opened.named)
                links = sum(len(_fold("".join(t for t, _ in run))) for a, run in groupby(zip(held, linked), itemgetter(1)) if a)
                out.append(Block(opened.path, text, opened.apart > 0, min(links, len(text)), named))
            held, linked = [], []

    at, size, last_end = 0, len(page), page.rfind(">")
    while at < size:
        if at > last_end and not page.startswith(("<!", "<?"), at):
            # no tag ends any more: all up to the next comment is text
            stop = min((k for k in (page.find("<!", at), page.find("<?", at)) if k >= 0), default=size)
            held.append(page[at:stop])
            linked.append(count["a"] > 0)
            at = stop
            continue
        m = _token.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            if not m[0].startswith("<") or m[0] == "<":
                held.append(m[0])
                linked.append(count["a"] > 0)
            continue
        name = name.lower()
        if m[1]:
            if name == "p" and not count["p"]:
                flush()
            if count[name]:
                k = len(stack) - 1
                across = False
                while stack[k][0] != name:
                    across = across or stack[k][0] not in INLINE
                    k -= 1
                if across or name not in INLINE:
                    if name in INLINE:
                        # an inline end tag closes no block
                        opened.drop(k)
                        continue
                    flush()
                opened.cut(k)
            continue
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else size
            continue
        if name == "br":
            held.append(" ")
            linked.append(linked[-1] if linked else False)
            continue
        if name not in INLINE:
            flush()
            if name in CLOSES_P:
                if count["p"]:
                    # an inline element left open by the paragraph has no use after it
                    opened.cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"))
            elif name in CLOSED_BY_LIKE and any(count[x] for x in CLOSED_BY_LIKE[name]):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select", "tr") and stack[k][0] != name:
                        break
                    if stack[k][0] in CLOSED_BY_LIKE[name]:
                        opened.cut(k)
                        break
        if name in VOID or m[3].rstrip().endswith("/") and name in ("svg", "path"):
            continue
        inside = count["article"] or count["main"]
        apart, named, readers = name in APART and not (name == "header" and inside), False, False
        if m[3] and name not in ("html", "body"):
            attributes: dict[str, str] = {}
            for key, *values in _attribute.findall(m[3]):
                attributes.setdefault(key.lower(), "".join(values))
            apart = apart or _hidden(attributes)
            tokens = [x for key in ("class", "id", "role") for x in attributes.get(key, "").split()]
            readers = any(map(READERS.fullmatch, tokens))
            named = readers or name not in ("article", "main") and any(map(NOT_CONTENT.fullmatch, tokens))
        number += named
        opened.push(name, apart, number if named else 0, readers, opened.path if name in INLINE else paths.below(opened.path, name))
    flush()
    return out, paths


class Score:
    """What a tag path's text says, smoothed (or its own, if larger) and its own: by all its text, and by the text of an element."""

    __slots__ = ("weight", "own_weight", "ratio", "own_ratio")

    def __init__(self, weight: float, own_weight: float, ratio: float, own_ratio: float) -> None:
        self.weight, self.own_weight, self.ratio, self.own_ratio = weight, own_weight, ratio, own_ratio

    def level(self, article: bool, smoothed: bool) -> float:
        """What is held against the threshold: in a named article a line of its own kind is as good as a paragraph, so how many there are doesn't matter."""
        if article:
            return self.ratio if smoothed else self.own_ratio
        return self.weight if smoothed else self.own_weight


def _smoothed(values: list[float]) -> list[float]:
    """Each value or its mean with the paths beside it, whichever is larger."""
    shares = ((-1, 0.25), (0, 0.5), (1, 0.25))
    mean = [
        sum(w * values[k + d] for d, w in shares if 0 <= k + d < len(values)) / sum(w for d, w in shares if 0 <= k + d < len(values))
        for k in range(len(values))
    ]
    return list(map(max, mean, values))


def _scores(found: list[Block]) -> dict[int, Score]:
    """Scores of each tag path, in order of first place: text without links and punctuation an element, with and without the weight of all its text."""
    rows: dict[int, list[float]] = {}
    for b in found:
        row = rows.setdefault(b.path, [0.0, 0.0, 0.0])
        row[0] += len(b.text) - b.links
        row[1] += len(_marks.findall(b.text))
        row[2] += 1
    ratios = [math.log1p(t / n) * (1 + math.log1p(p / n)) for t, p, n in rows.values()]
    weights = [r * math.log1p(t) for r, (t, _, _) in zip(ratios, rows.values())]
    return {path: Score(*x) for path, *x in zip(rows, _smoothed(weights), weights, _smoothed(ratios), ratios)}


def _without_named(found: list[Block], paths: Paths) -> list[Block]:
    """The blocks outside elements named as no content; such a name doesn't count where the page's content lies within.

    That is where its article or main element does, or else most of the path
    with the highest score. What is named as of readers stays apart.
    """
    found = [b for b in found if not any(readers for _, readers, _ in b.named)]
    free = [b for b in found if not b.named]
    size = lambda rows: sum(len(b.text) for b in rows)
    within = [b for b in found if any(holds for _, _, holds in b.named)]
    in_main = [b for b in free if paths.main[b.path]]
    opened: set[int] = set()
    if any(paths.article[b.path] for b in free):
        pass
    elif within and size(within) > size(in_main):
        opened = {n for b in within for n, _, holds in b.named if holds}
    elif found and not in_main:
        scores = _scores(found)
        best = max(scores, key=lambda p: scores[p].weight)
        rows = [b for b in found if b.path == best]
        held = [b for b in rows if b.named]
        if 2 * size(held) > size(rows):
            opened = {n for b in held for n, _, _ in b.named}
    return [b for b in found if all(n in opened for n, _, _ in b.named)]


def main_blocks(page: str) -> list[str]:
    """Texts of the content blocks of a page, in page order."""
    found, paths = blocks(page)
    found = _without_named([b for b in found if not b.apart], paths)
    if not found:
        return []
    scores = _scores(found)
    # fuse: the text of a path counts for every container above it, less the further above
    weight, depth, there = [0.0] * len(paths.tag), [0] * len(paths.tag), [False] * len(paths.tag)
    for path, score in scores.items():
        weight[path], there[path] = score.weight, True
    for path in range(len(paths.tag) - 1, 0, -1):
        weight[paths.parent[path]] += 0.7 * weight[path]
        there[paths.parent[path]] |= there[path]
    for path in range(1, len(paths.tag)):
        depth[path] = depth[paths.parent[path]] + 1
    held = [c for c in range(len(paths.tag)) if there[c]]
    named = [c for c in held if paths.tag[c] in ("article", "main")]
    inner = [c for c in named if paths.tag[c] == "article"] or named
    if inner:
        best = max(inner, key=lambda c: (weight[c], -depth[c]))
    else:
        best = max((c for c in held if paths.tag[c] not in HEADINGS | {"p"}), key=lambda c: (weight[c], depth[c]))
    lies = paths.inside(best)
    inside = {p: s for p, s in scores.items() if lies[p]}
    most = max(s.level(bool(inner), True) for s in inside.values())
    limit = min(ARTICLE_THRESHOLD * most, ENOUGH) if inner else THRESHOLD * most
    content = {p for p, s in inside.items() if paths.tag[p] in HEADINGS or s.level(bool(inner), paths.tag[p] in TEXTUAL) >= limit}
    if not inner:
        # without an article a path that is half link or more is a menu
        chars, links = Counter(), Counter()
        for b in found:
            chars[b.path] += len(b.text)
            links[b.path] += b.links
        content = {p for p in content if paths.tag[p] in HEADINGS or 2 * links[p] < chars[p]}
    return [b.text for b in found if b.path in content]


def extract_text(page: str | None) -> str:
    """Main text of a page, its blocks joined by two line feeds; empty for null, empty and textless pages."""
    return "\n\n".join(main_blocks(page)) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of each row of ``pages(page_id, url, html)``.

    Whole pages are read, cut-off ones to their end. A null page counts as empty
    and has an empty text; repeated rows and null ids stay; other columns are
    not read.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [extract_text(x) for x in frame["html"]]
            yield pd.DataFrame(
                {"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": list(map(len, texts))}
            )

    return pages.select("page_id", "url", "html").mapInPandas(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
