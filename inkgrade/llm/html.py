"""HTML extraction: wrappers inferred per host as union-free regular expressions over token streams."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b
from functools import reduce
from html import unescape
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from inkgrade.llm.common import lower_ascii
from inkgrade.operators.lineage import cut_lineage

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?|<[!?][^>]*>?|[^<]+|<",
                    re.S)
_CLASS = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "xmp", "noembed"}
_BLOCKS = set(
    "html head body title article section main nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "table thead tbody tfoot tr td th caption form fieldset legend blockquote pre figure figcaption details summary "
    "address hr center dialog menu option select button label hgroup search".split()
)
_VOID = {"hr", "br", "img", "meta", "link", "input", "wbr", "area", "base", "col", "embed", "source", "track"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}}
_OUT_TAGS = {"head", "title", "nav", "footer", "aside", "form", "select", "option", "button", "dialog", "menu",
             "label", "fieldset", "search"}
_OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?\w*|consent|gdpr|notices?|popup|modal|"
    r"newsletter|subscribe|sidebar|side|menu|nav\w*|breadcrumbs?|footer|masthead|share|sharing|social|comments?|"
    r"disqus|respond|replies|reply|related|recommend\w*|widget|toolbar|login|signup|search|pag(?:er|ination)|alert|"
    r"copyright|contentinfo|complementary|navigation|skip)(?:$|[\s_-])", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|topbar|top-bar|banner)(?:$|[\s_-])", re.I)
_MAIN = {"article", "main"}

#: Levels that a wrapper nests; elements below hang side by side from the last one, marked with what is around them.
DEPTH = 48
#: A text that more than half of a host's pages with its slot hold, and at least so many, belongs to the template.
SAME_PAGES = 5
#: Bytes of all wrappers up to which they are broadcast; beyond, they are joined by host.
BROADCAST_BYTES = 8 << 20


def page_tree(html: str | None) -> tuple[list, list[tuple[str, int]]]:
    """The page as a nested token stream, and its texts in order as (text, characters inside links).

    A node is [name, children, repeated, optional, own]; the name is the tag and its classes, a text is ``#`` and
    ``own`` lists the numbers of its texts. Inline tags belong to the text around them. In front of a name from below
    ``DEPTH`` levels stand ``!`` if an element around it down there is no main text, and ``+`` if one is an article.
    """
    html = html or ""
    root = ["", [], 0, 0, None]
    stack, names, texts, run, linked, in_link = [root], [""], [], [], 0, 0
    at, end = 0, len(html)

    def close_run() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(run)).split())
        if text:
            texts.append((text, min(linked, len(text))))
            stack[-1][1].append(["#", [], 0, 0, [len(texts) - 1]])
        run.clear()
        linked = 0

    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if not m[0].startswith(("<!", "<?")):
                run.append(m[0])
                linked += len(m[0]) * bool(in_link)
            continue
        tag = tag.lower()
        if tag in _RAW:
            if not m[1] and not m[3].endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
                at = stop.end() if stop else end
            continue
        if tag not in _BLOCKS:
            if tag == "br":
                run.append(" ")
            if tag == "a":
                in_link = 0 if m[1] else 1
            continue
        close_run()
        in_link = 0
        if m[1]:
            if tag in names:
                last = len(names) - 1 - names[::-1].index(tag)
                del stack[last:], names[last:]
            continue
        if "p" in names:
            first = names.index("p")
            del stack[first:], names[first:]
        for same in _SAME.get(tag, ()):
            if names[-1] == same:
                stack.pop()
                names.pop()
        if tag in _VOID:
            continue
        label = " ".join(c.strip("\"'") for c in _CLASS.findall(m[3] or ""))
        name = f"{tag}.{re.sub('[0-9]+', '', label)}" if label else tag
        node = [_around(stack[-1][0], names) + name if len(stack) > DEPTH else name, [], 0, 0, None]
        stack[min(len(stack), DEPTH) - 1][1].append(node)
        stack.append(node)
        names.append(tag)
    close_run()
    return root, texts


def _parts(name: str) -> tuple[str, str, str]:
    """Marks, tag and classes of a name."""
    tag, _, label = name.partition(".")
    plain = tag.lstrip("!+")
    return tag[: len(tag) - len(plain)], plain, label


def _around(parent: str, names: list[str]) -> str:
    """Marks of what stands in the parent, whose tag is the last of the names."""
    marks, tag, label = _parts(parent)
    out = "!" in marks or _outside(tag, label, not _MAIN.isdisjoint(names[:-1]))
    return "!" * out + "+" * ("+" in marks or tag in _MAIN)


def _merge(a: list, b: list) -> list:
    """One expression for two nodes of the same name."""
    own = a[4] + b[4] if isinstance(a[4], list) else _add(a[4], b[4])
    return [a[0], align(a[1], b[1]), a[2] | b[2], a[3] | b[3], own]


def _add(x, y):
    if x is None or y is None:
        return x or y
    return {k: x[k] + y[k] for k in x}


def _matching(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of the two streams' names."""
    x, y = [n[0] for n in a], [n[0] for n in b]
    if x == y:
        return [(i, i) for i in range(len(x))]
    if len(x) * len(y) > 40_000:
        return _long_matching(x, y)
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _long_matching(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """The same for long streams, by Hunt and Szymanski: time grows with the pairs of equal names."""
    places: dict[str, list[int]] = {}
    for j in range(len(y) - 1, -1, -1):
        places.setdefault(y[j], []).append(j)
    last, chains = [], []
    for i, name in enumerate(x):
        for j in places.get(name, ()):
            k = bisect_left(last, j)
            chain = (i, j, chains[k - 1] if k else None)
            if k == len(last):
                last.append(j)
                chains.append(chain)
            else:
                last[k], chains[k] = j, chain
    out, chain = [], chains[-1] if chains else None
    while chain:
        out.append(chain[:2])
        chain = chain[2]
    return out[::-1]


def align(a: list, b: list) -> list:
    """One stream for two: matched entries merge, what only one has becomes optional."""
    out, i, j = [], 0, 0
    for p, q in [*_matching(a, b), (len(a), len(b))]:
        out += [[*n[:3], 1, n[4]] for n in a[i:p]] + [[*n[:3], 1, n[4]] for n in b[j:q]]
        if p < len(a):
            out.append(_merge(a[p], b[q]))
        i, j = p + 1, q + 1
    return fold(out)


def fold(items: list) -> list:
    """Tandem repeats become repeated entries: three or more of a name, or any next to one that already repeats, then
    groups of two and three. Two alike stay apart, as they may be the template's and the page's."""
    out: list = []
    for _, same in groupby(items, key=lambda n: n[0]):
        run = list(same)
        if len(run) > 2 or len(run) > 1 and any(n[2] for n in run):
            run = [[*reduce(_merge, run)]]
            run[0][2] = 1
        out += run
    for p in (2, 3):
        names, i, folded = [n[0] for n in out], 0, []
        while i < len(out):
            times = 1
            while names[i:i + p] == names[i + times * p:i + (times + 1) * p] and i + (times + 1) * p <= len(out):
                times += 1
            if times > 1:
                group = out[i:i + p]
                for t in range(1, times):
                    group = [_merge(x, y) for x, y in zip(group, out[i + t * p:i + (t + 1) * p], strict=True)]
                folded.append(["(" + " ".join(names[i:i + p]) + ")", group, 1, 0, None])
                i += p * times
            else:
                folded.append(out[i])
                i += 1
        out = folded
    return out


def folded(node: list) -> list:
    return [node[0], fold([folded(c) for c in node[1]]), *node[2:]]


def with_stats(node: list, texts: list[tuple[str, int]]) -> list:
    """The expression with counts instead of text numbers."""
    own = node[4]
    if own:
        own = {"chars": sum(len(texts[i][0]) for i in own), "linked": sum(texts[i][1] for i in own)}
    return [node[0], [with_stats(c, texts) for c in node[1]], node[2], node[3], own]


def _has_main(node: list) -> bool:
    """Whether the node holds an article or main element outside of what is no main text."""
    for child in node[1]:
        marks, tag, label = _parts(child[0])
        if tag == "#":
            continue
        if tag.startswith("(") or "!" not in marks and not _outside(tag, label, "+" in marks):
            if tag in _MAIN or "+" in marks or _has_main(child):
                return True
    return False


def numbered(wrapper: list) -> list:
    """The wrapper with a number for every slot."""
    at, todo = 0, [wrapper]
    while todo:
        node = todo.pop()
        if node[4]:
            node[4]["slot"] = at
            at += 1
        todo += node[1]
    return wrapper


def mark(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def slots_of(page: list, wrapper: list) -> Iterator[tuple[int, int]]:
    """(text number, slot number) of the page's texts that have a slot."""
    todo = [(page, wrapper)]
    while todo:
        node, model = todo.pop()
        for child, twin in _twins(node[1], model[1]):
            if child[0] == "#" and twin:
                yield from ((i, twin[4]["slot"]) for i in child[4])
            elif twin:
                todo.append((child, twin))


def kept_texts(page: list, wrapper: list, texts: list[tuple[str, int]], same: set[str] = frozenset()) -> list[str]:
    """The texts of the page that stand in content slots of its host's wrapper, in page order; ``same`` are the
    template's texts as ``slot:mark``. An article that is template throughout, like that of pages that differ in
    nothing but their menus, is kept."""
    main, keep, constant = _has_main(page), set(), set()

    def walk(node: list, model: list | None, inside: bool) -> None:
        for child, twin in _twins(node[1], model[1] if model else []):
            if child[0] == "#":
                if inside or not main and not _links(twin):
                    for i in child[4]:
                        (constant if _constant(i, twin) else keep).add(i)
                continue
            marks, tag, label = _parts(child[0])
            here = inside or "+" in marks
            if tag.startswith("("):
                walk(child, twin, inside)
            elif "!" not in marks and not _outside(tag, label, here):
                walk(child, twin, here or tag in _MAIN)

    def _constant(i: int, twin: list | None) -> bool:
        return bool(twin) and f"{twin[4]['slot']}:{mark(texts[i][0])}" in same

    walk(page, wrapper, False)
    if main and not keep:
        keep = constant
    return [t for i, (t, _) in enumerate(texts) if i in keep]


def _outside(tag: str, label: str, inside: bool) -> bool:
    """Whether tag or names say that this is no main text. Headers count as the page's unless in the article."""
    if tag in ("html", "body"):
        return False
    return tag in _OUT_TAGS or bool(_OUT_NAMES.search(label)) or (
        not inside and (tag == "header" or bool(_HEADER.search(label))))


def _twins(items: list, models: list) -> Iterator[tuple[list, list | None]]:
    """Every entry with its entry of the wrapper: the aligned one, else one of its name that repeats."""
    twin = {i: models[j] for i, j in _matching(items, models)}
    repeats = {m[0]: m for m in models if m[2]}
    for i, n in enumerate(items):
        yield n, twin.get(i) or repeats.get(n[0])


def _links(slot: list | None) -> bool:
    """Whether the slot holds mostly links."""
    return bool(slot) and 2 * slot[4]["linked"] > slot[4]["chars"]


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"),
                        F.col(html_col).alias("html"))


_PART = "host string, wrapper string"


def infer_wrappers(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """(host, wrapper): one union-free expression for all pages of a host, as JSON.

    Every task folds its pages into one expression per host, and these are folded again by host, read as a stream,
    so that a host with a third of all pages sends one row per task. Slots carry counts of characters and of
    characters in links.
    """
    def first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, list] = {}
        for pdf in parts:
            for host, html in zip(pdf["host"], pdf["html"], strict=True):
                tree, texts = page_tree(html)
                tree = with_stats(folded(tree), texts)
                found[host] = _merge(found[host], tree) if host in found else tree
            if len(found) > 5000:
                yield _rows(found)
                found = {}
        yield _rows(found)

    def second(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tree = None, None
        for pdf in parts:
            done: dict[str, list] = {}
            for host, text in zip(pdf["host"], pdf["wrapper"], strict=True):
                if host == now:
                    tree = _merge(tree, json.loads(text))
                else:
                    if now is not None:
                        done[now] = tree
                    now, tree = host, json.loads(text)
            yield _rows(done)
        if now is not None:
            yield _rows({now: tree})

    parts = _pages(pages, id_col, url_col, html_col).select("host", "html").mapInPandas(first, _PART)
    return parts.repartition("host").sortWithinPartitions("host").mapInPandas(second, _PART)


def _rows(found: dict[str, list]) -> pd.DataFrame:
    return pd.DataFrame({"host": list(found), "wrapper": [json.dumps(t) for t in found.values()]}, dtype=object)


def _with(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Pages beside their host's row."""
    size = wrappers.agg(F.sum(sum(F.coalesce(F.length(n), F.lit(0)) for n in wrappers.columns))).first()[0] or 0
    return pages.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left")


def template_texts(rows: DataFrame) -> DataFrame:
    """(host, same): the texts, as ``slot:mark`` between blanks, that more than half of the different pages of the host
    with that slot hold there, and at least ``SAME_PAGES``. Pages of the same texts count once."""
    def seen(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list] = {}
        for pdf in parts:
            out = []
            for host, html, model in zip(pdf["host"], pdf["html"], pdf["wrapper"], strict=True):
                if host not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[host] = numbered(json.loads(model))
                tree, texts = page_tree(html)
                page = mark("\n".join(t for t, _ in texts))
                found = {(slot, mark(texts[i][0])) for i, slot in slots_of(folded(tree), known[host])}
                out += [(host, page, slot, m) for slot, m in found]
                out += [(host, page, slot, None) for slot in {slot for slot, _ in found}]
            yield pd.DataFrame(out, columns=["host", "page", "slot", "mark"], dtype=object)

    marks = rows.select("host", "html", "wrapper").mapInPandas(seen, "host string, page long, slot int, mark long")
    counts = marks.distinct().groupBy("host", "slot", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= SAME_PAGES)
    of_slot = F.max(F.when(F.col("mark").isNull(), F.col("n"))).over(W.partitionBy("host", "slot"))
    same = counts.withColumn("of", of_slot).where("mark is not null and 2 * n > of")
    return same.groupBy("host").agg(F.array_join(F.collect_list(F.concat_ws(":", "slot", "mark")), " ").alias("same"))


def extract_text(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """(page_id, url, text, blocks): the main text of every page and its number of blocks.

    The page's token stream is laid along its host's wrapper. Texts in menus, headers, footers, side bars, notices,
    adverts, forms and comments (by tag, class, id or role) are left out, and so are texts that most of the host's pages
    have in that slot, inside an article or not. Of a page with an article or main element outside of those only that
    stays; of other pages slots of mostly links go too.
    References are decoded, white space in a block becomes one blank, blocks are joined by an empty line.

    Null html is empty and gives an empty text; null urls and urls without ``://`` share the host ``""``; repeated
    rows are extracted one by one; an empty table gives no rows; other columns are left out.
    """
    wrappers = cut_lineage(infer_wrappers(pages, id_col=id_col, url_col=url_col, html_col=html_col))
    hosts = _pages(pages, id_col, url_col, html_col)
    wrappers = cut_lineage(wrappers.join(template_texts(_with(hosts, wrappers)), "host", "left"))
    rows = _with(hosts, wrappers)

    def texts_of(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[list, set[str]]] = {}
        for hosts, htmls, models, sames in parts:
            out = []
            for host, html, model, same in zip(hosts, htmls, models, sames, strict=True):
                if host not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[host] = numbered(json.loads(model)), set((same or "").split())
                tree, texts = page_tree(html)
                blocks = kept_texts(folded(tree), known[host][0], texts, known[host][1])
                out.append(("\n\n".join(blocks), len(blocks)))
            yield pd.DataFrame(out, columns=["text", "blocks"]).astype({"text": object, "blocks": "int64"})

    extracted = F.pandas_udf(texts_of, "text string, blocks long")
    return rows.select("page_id", "url", extracted("host", "html", "wrapper", "same").alias("x")).select("page_id", "url", "x.*")
