"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged: a node of the tree is a host and a path of containers (tag and
first class). A page's presentation of the node is the sequence of its child tags; its content features
are the text blocks that stand in it and in no container below it. Over the m pages that hold a node, its
presentation importance is the entropy of the presentations to the base m, and the importance of its own text
is 1 minus the mean entropy, to the base m, of the features' spread over the pages: blocks that every page repeats
make it 0. Importance is carried up: that of a branch joins the presentation importance of its top, which counts
the more the more presentations there are, with those of its text and of the branches below, each by its share of
the branch's characters. Branches of low importance are the site's, not the page's, and are cut from each page
whole; in what stays, text of low importance is cut where it stands by itself. Pages that are equal count once.

The tree cannot judge a host with few pages, so branches whose tag or name states their role (menus,
footers, forms, adverts and so on) are cut everywhere. A name is a whole class, id or role, or a compound of such
names and of words that only place them. A branch cut by its name stays if the page's marked article is in it and
is most of the text; a page of furniture alone has no main text. The tree also judges inside the branch that a page marks as its article, but never takes
half of it or more: a copied page keeps its text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

# Tag names of HTML and usual names of page furniture.
NAME, FIRM = 1, 2  # furniture by the name of a wrapper outside the article; furniture by anything else
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "canvas", "math")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("body div section article main header footer nav aside form ul ol dl table figure details dialog fieldset menu".split())
BLOCKS = CONTAINERS | frozenset("html head p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption thead tbody tfoot blockquote pre address hgroup figcaption summary legend center option select button label hr".split())
FURNITURE_TAGS = frozenset("head nav footer aside form select button menu dialog".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie consent disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Words that may stand beside a name of FURNITURE_NAMES in a compound: site-header, share-buttons.
BESIDE = frozenset("area bar block bottom box button buttons container global icons inner item items left links list panel posts primary right secondary section site top wrap wrapper".split())
MAIN_TAGS = frozenset(("article", "main"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
#: One attribute after another, each with its whole value, so that no word of a value is taken for a name.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>]+)))?|["'][^"']*["']?""")
NAMING = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
END_OF_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}


@lru_cache(4096)
def _named_furniture(value: str) -> bool:
    for name in value.split():
        parts = {p for p in re.split(r"[^a-z]+", name) if p}
        if name in FURNITURE_NAMES or parts & FURNITURE_NAMES and parts <= FURNITURE_NAMES | BESIDE:
            return True
    return False


def _furniture(tag: str, attrs: str, inside_main: bool) -> tuple[int, str]:
    """FIRM or NAME if a branch's tag or names tell that it is no main text, else 0; its first class."""
    if tag in FURNITURE_TAGS or tag == "header" and not inside_main:
        return FIRM, ""
    first, cut = "", 0
    if "=" in attrs or "hidden" in attrs:
        for name, *values in ATTRIBUTE.findall(attrs):
            name = name.lower()
            if name not in NAMING:
                continue
            value = "".join(values).lower()
            if name == "class":
                first = value.split()[0] if value.split() else ""
            if name == "hidden" or name == "aria-hidden" and value == "true":
                cut = FIRM
            elif _named_furniture(value):
                cut = max(cut, FIRM if inside_main else NAME)
    return 0 if tag in ("body", "html") else cut, first


def parse(page: str | None, children: dict[str, list[str]] | None = None) -> list[tuple[str, str, int, bool]]:
    """Text blocks in page order: (path of containers, text, furniture, in the marked article).

    children gets the tags that stand in each path."""
    page = page or ""
    out: list[tuple[str, str, int, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, str, int, bool]] = []  # tag, path, furniture, in the article
    path, cut, main = "", 0, False

    def flush():
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                out.append((path, words, cut, main))
            text.clear()

    def close(depth: int):
        nonlocal path, cut, main
        flush()
        del stack[depth:]
        _, path, cut, main = stack[-1] if stack else ("", "", 0, False)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text.append(page[at:])
            break
        if lt > at:
            text.append(page[at:lt])
        m = TOKEN.match(page, lt)
        if m is None:
            text.append("&lt;")
            at = lt + 1
            continue
        at = m.end()
        if m["cdata"] is not None:
            text.append(html.escape(m["cdata"]))
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag in END_OF_RAW and not m["end"]:
            if tag not in ("svg", "math") or not SELF_CLOSED.search(m["attrs"]):
                over = END_OF_RAW[tag].search(page, at)
                at = over.end() if over else n
            text.append(" ")
        elif tag == "br":
            text.append(" ")
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif tag not in BLOCKS:
            continue
        elif m["end"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is None:
                flush()
            elif tag in CONTAINERS or not any(s[0] in CONTAINERS for s in stack[depth + 1 :]):
                close(depth)
        else:  # a slash before the end closes no block
            flush()
            # a block of running text ends an open paragraph; an item ends the item before
            ends = ("li",) if tag == "li" else ("dt", "dd") if tag in ("dt", "dd") else ("p",)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in CONTAINERS:
                    break
            furniture, name = _furniture(tag, m["attrs"], main)
            main = main or tag in MAIN_TAGS
            cut = max(cut, furniture)
            if children is not None:
                children.setdefault(path, []).append(tag)
            if tag in CONTAINERS:
                path = f"{path}/{tag}.{name}" if name else f"{path}/{tag}"
            stack.append((tag, path, cut, main))
    flush()
    return out


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def style_tree(pages: DataFrame, decay: float = 0.9) -> DataFrame:
    """(host, path, m, own, branch) of every node: pages that hold it, importance of its own text (null without any)
    and of the branch. decay: how fast the presentations outweigh what is below as their number grows."""

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, page, of in zip(batch["host"], batch["html"], batch["of"]):
                seen: dict[str, dict[str, int]] = {}
                tags: dict[str, list[str]] = {}
                for path, text, _, _ in parse(page, tags):
                    seen.setdefault(path, {})[text] = len(text)
                for path in seen.keys() | tags.keys():
                    rows.append((host, path, -1, hash_text(" ".join(tags.get(path, ()))), 0, of))
                    rows += [(host, path, 1, hash_text(t), n, of) for t, n in seen.get(path, {}).items()]
            yield pd.DataFrame(rows, columns=["host", "path", "kind", "feature", "chars", "of"])

    # equal pages, told by a hash, give equal rows and count once
    named = pages.select("host", "html", F.xxhash64("html").alias("of"))
    rows = named.mapInPandas(nodes, "host string, path string, kind int, feature long, chars long, of long")
    counted = rows.distinct().groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("c"), F.max("chars").alias("chars"))
    style = F.col("kind") < 0
    spread = counted.groupBy("host", "path").agg(
        F.sum(F.when(style, F.col("c"))).alias("m"), F.count_if(style).alias("looks"),
        F.sum(F.when(style, F.col("c") * F.log("c"))).alias("c_log_c"),
        F.avg(F.when(~style, F.log("c"))).alias("log_c"), F.sum(F.col("c") * F.col("chars")).alias("chars"),
    )
    m = F.log(F.col("m").cast("double"))
    # of the depth of a path its ancestors: "/body/div" and "/body" for "/body/div"; the top of all is ""
    above = F.expr("transform(sequence(0, size(split(path, '/')) - 1), i -> array_join(slice(split(path, '/'), 1, i + 1), '/'))")
    node = save(
        spread.select(
            "host", "path", "m", "looks", "chars", above.alias("above"),
            F.when(F.col("m") > 1, F.col("c_log_c") / (-F.col("m") * m) + 1).otherwise(1.0).alias("style"),
            F.when(F.col("m") > 1, 1 - F.col("log_c") / m).otherwise(F.when(F.col("log_c").isNotNull(), 1.0)).alias("own"),
        ),
        "nodes",
    )
    # below each node: the characters of its branch; above each node: how many presentations its ancestors have
    pairs = node.select("host", F.explode("above").alias("top"), "path", "chars")
    held = pairs.groupBy("host", "top").agg(F.sum("chars").alias("held"))
    looks = node.select("host", F.col("path").alias("top"), "looks")
    depth = pairs.where("top <> path").join(looks.hint("merge"), ["host", "top"]).groupBy("host", "path").agg(F.sum("looks").alias("before"))
    full = node.join(held.withColumnRenamed("top", "path").hint("merge"), ["host", "path"]).join(depth.hint("merge"), ["host", "path"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
    full = save(full, "tree")
    # a branch is the sum of what its nodes hand up: their looks by the characters below them, their text by its own
    weight = F.pow(F.lit(decay), F.col("looks").cast("double"))
    gives = (1 - weight) * F.col("style") * F.col("held") + weight * F.coalesce("own", F.lit(0.0)) * F.col("chars")
    handed = full.select("host", F.explode("above").alias("top"), "before", gives.alias("gives"))
    tops = full.select("host", F.col("path").alias("top"), F.col("before").alias("top_before"), F.col("held").alias("top_held"))
    up = handed.join(tops.hint("merge"), ["host", "top"]).where("top_held > 0")
    up = up.groupBy("host", "top").agg(F.sum(F.col("gives") / F.col("top_held") * F.pow(F.lit(decay), (F.col("before") - F.col("top_before")).cast("double"))).alias("branch"))
    return full.select("host", "path", "m", "own").join(up.withColumnRenamed("top", "path").hint("merge"), ["host", "path"])


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 0) - (1 << 63)


def _low(path: str, text: frozenset[str] | set[str], branches: frozenset[str] | set[str]) -> bool:
    while path:
        if path in text or path in branches:
            return True
        text, path = (), path.rpartition("/")[0]
    return False


def main_text(page: str | None, text: frozenset[str] | set[str] = frozenset(), branches: frozenset[str] | set[str] = frozenset()) -> str:
    """Kept blocks joined by a line end; the marked article if the page has one. text: paths whose own blocks are of
    low importance; branches: paths of branches that are."""
    every = [x for x in parse(page) if x[2] != FIRM]
    high = [not _low(x[0], text, branches) for x in every] if text or branches else [True] * len(every)
    size = lambda blocks: sum(len(x[1]) for x in blocks)
    article = [x for x in every if x[3]]
    if 2 * size([x for x, ok in zip(every, high) if x[3] and ok]) <= size(article):
        high = [ok or x[3] for x, ok in zip(every, high)]
    blocks = [x for x, ok in zip(every, high) if ok]
    kept = [x for x in blocks if not x[2]]
    if not any(x[3] for x in kept):
        # a wrapper may have a name of furniture; an article in it counts if it is most of the text
        article = [x for x in blocks if x[3]]
        if size(article) > size(kept):
            kept = article
    kept = kept or [x for x in every if not x[2]]
    if any(x[3] for x in kept):
        kept = [x for x in kept if x[3]]
    return "\n".join(x[1] for x in kept)


def extract(pages: DataFrame, low: float = 0.25, least_pages: int = 8, shared_bytes: int = 32_000_000, salts: int = 32) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    low: nodes under this importance are cut, on hosts with least_pages different pages or more that hold them.
    shared_bytes: the cuts are broadcast while their paths have no more characters than this; beyond, pages meet them by a shuffle, each host's dealt over `salts` parts. Null html: empty text. Null
    url: a host of its own. Very long pages are read whole. Repeated rows and page_ids each keep a row. Empty table:
    empty result. Other columns are ignored, whatever their names.
    """
    named = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    tree = style_tree(named).where((F.col("m") >= least_pages) & (F.col("path") != "/body") & (F.col("path") != ""))
    cut = tree.where((F.col("own") < low) | (F.col("branch") < low)).groupBy("host").agg(
        F.collect_set(F.when(F.col("own") < low, F.col("path"))).alias("texts"), F.collect_set(F.when(F.col("branch") < low, F.col("path"))).alias("branches")
    )
    cut = save(cut, "style_tree")
    if (cut.agg(F.sum(sum(F.length(F.array_join(c, "/")) for c in ("texts", "branches")))).first()[0] or 0) <= shared_bytes:
        joined = named.join(F.broadcast(cut), "host", "left")
    else:
        salted = cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = named.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(salted.hint("merge"), ["host", "salt"], "left")

    @F.pandas_udf("string")
    def text(page: pd.Series, texts: pd.Series, branches: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, *(frozenset() if c is None else frozenset(c) for c in cut)) for p, *cut in zip(page, texts, branches)], dtype=object)

    out = joined.select("page_id", "url", text("html", "texts", "branches").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
