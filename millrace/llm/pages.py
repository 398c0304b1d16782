"""Main text of web pages by a site style tree.

The pages of a host are merged by the path of their block elements (tag, class, id, role).
A node's content importance is the entropy of the texts that stand there, each counted once
a page, its presentation importance the entropy of its child sequences, both against the
evenly spread case; a branch is worth the mean of what hangs below and, for a tenth, its own
presentation. Marks are weights on that: ``article`` and ``main`` raise it, a class or id
that names furniture lowers it at the element that carries it, and so does standing beside
an article that leads its page; the share of the host's text raises it. Texts at a node
below ``LOW`` are removed from every page, in articles too; a named branch at ``LOW`` or
more stays. Elements whose tag or role is furniture (menus, forms, scripts) always go.

An article leads a page if the longest one holds as much as what is left outside of all;
then only articles are given. Smaller ones, like teaser cards, do not push out the rest.

Each block is one line: references decoded, white space folded, trimmed.

Defined cases. Null or empty html, and pages without text outside of furniture: empty
text. A null url is a host of its own name, ``""``. Nodes on fewer than ``LEAST_PAGES``
pages of a host are judged by tags and names alone; a page of a host without judged nodes
that has nothing else gives its named branches. A page that the tree would empty is judged
by tags and names. Equal pages come out as often as they came in. No rows: no result rows;
extra columns stay, clashing ones are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import stored

LEAST_PAGES = 8
LOW = 0.5
#: Share of a branch's importance that comes from what hangs below it.
BELOW = 0.9
#: Weights on importance: in an article, at a name of furniture, beside a leading article.
IN_MAIN, NAMED, BESIDE = 1.5, 0.35, 0.35
CHUNK = 256

# Element names of HTML by their part in a page.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = "script|style|noscript|template|textarea|title|svg|math|iframe|object|select|audio|video|canvas|xmp"
EMPTY = set(UNSEEN.split("|"))  # where such an element closes itself
FURNITURE = set("nav footer aside form button menu dialog fieldset head input".split())
#: An opening tag ends these open elements of the same kind.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
#: Elements that a paragraph cannot hold, so that they end it.
ENDS_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
# Words in a class or id that name furniture.
NAMES = set(
    "ad adbox ads adsbygoogle adslot adv advert advertisement adverts alert alerts banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies copyright disclaimer disqus footer form gdpr header legal login masthead menu modal "
    "nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related reply "
    "replies respond responses search share sharing sidebar signup skyscraper social sponsor sponsored subscribe tags "
    "toolbar topbar widget widgets".split()
)
#: In an article these name parts of it.
OF_ARTICLE = {"header", "tags", "form"}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({UNSEEN})\b[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?][^>]*>",
    re.S | re.I,
)
_NAME = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    tag: str
    path: str
    tagged: bool
    named: tuple[str, ...]
    main: int
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    """``named``: paths of the elements around it whose names say furniture; ``main``: number
    of the outermost article or main around it, 0 outside."""

    path: str
    text: str
    tagged: bool
    named: tuple[str, ...]
    main: int


def _signature(tag: str, attributes: str) -> tuple[str, set[str], str]:
    if "=" not in attributes:
        return tag, set(), ""
    names, role = set(), ""
    for key, *values in _NAME.findall(attributes):
        value = next((v for v in values if v), "")
        if key.lower() == "role":
            role = value.lower()
        else:
            for word in value.split():
                parts = [p.lower() for p in _PART.findall(word)]
                names.update(parts)
                names.update(a + b for a, b in zip(parts, parts[1:]) if a + b in NAMES)
    name = f"{tag}.{'.'.join(sorted(names))}" if names else tag
    return f"{name}@{role}" if role else name, names, role


def _is_tagged(tag: str, role: str, in_main: bool) -> bool:
    if tag in FURNITURE or role in ("navigation", "banner", "contentinfo", "complementary", "search", "form"):
        return True
    return tag == "header" and not in_main


def _is_named(tag: str, names: set[str], in_main: bool) -> bool:
    if tag in ("html", "body", "main") or names & {"no", "has", "with"}:
        return False
    return bool(names & (NAMES - OF_ARTICLE if in_main or tag == "article" else NAMES))


def parse(page: str | None) -> tuple[list[Block], list[tuple[str, str]]]:
    """Text blocks in page order, and (path, child sequence) of every block element
    outside of furniture tags."""
    stack = [Node("", "", False, (), 0)]
    mains = 0
    blocks: list[Block] = []
    shapes: list[tuple[str, str]] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            top = stack[-1]
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append(Block(top.path, text, top.tagged, top.named, top.main))

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            node = stack.pop()
            if not node.tagged:
                shapes.append((node.path, " ".join(node.children)))

    page, at = page or "", 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag or tag in INLINE or tag in EMPTY:
            continue
        flush()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag in VOID:
            continue
        ends = ENDS.get(tag, {"p"} if tag in ENDS_P else set())
        if stack[-1].tag in ends:
            close(len(stack) - 1)
        name, names, role = _signature(tag, m[4])
        top = stack[-1]
        path = f"{top.path}>{name}" if top.path else name
        tagged = top.tagged or _is_tagged(tag, role, top.main > 0)
        named = (*top.named, path) if _is_named(tag, names, top.main > 0) else top.named
        main = top.main
        if not main and (tag in ("article", "main") or role == "main"):
            mains += 1
            main = mains
        if not top.children or top.children[-1] != name:
            top.children.append(name)
        stack.append(Node(tag, path, tagged, named, 0 if tagged else main))
    held.append(page[at:])
    flush()
    close(1)
    return blocks, shapes


def _main_leads(blocks: list[Block]) -> bool:
    """Whether the longest article holds as much text as all blocks outside of articles."""
    chars: Counter = Counter()
    for b in blocks:
        chars[b.main] += len(b.text)
    outside = chars.pop(0, 0)
    return bool(chars) and max(chars.values()) >= outside


def main_text(page: str | None, low: set[str], lifted: set[str] = frozenset()) -> str:
    """The page's lines outside of furniture and of the low nodes of its host; branches
    named like furniture count where their host's tree has ``lifted`` them."""
    blocks = [b for b in parse(page)[0] if not b.tagged]
    free = [b for b in blocks if lifted.issuperset(b.named)]
    if not free and not low and not lifted:
        free = blocks
    kept = [b for b in free if b.path not in low] or free
    if _main_leads(kept):
        kept = [b for b in kept if b.main]
    return "\n".join(b.text for b in kept)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\w+://([^/?#]*)", 1), F.lit("")))


def node_counts(pages: DataFrame) -> DataFrame:
    """``host, path, kind, h, n``, added up in each batch. By kind, pages that have a text
    (``text``) or a child sequence (``shape``) at a path; pages that have the path (``pages``),
    have it in an article (``main``), beside a leading one (``side``) or as an element named
    like furniture (``named``); characters there (``mass``)."""
    schema = "host string, path string, kind string, h long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        def h(s: str) -> int:
            return xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)

        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                counts: Counter = Counter()
                for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    blocks, shapes = parse(page)
                    blocks = [b for b in blocks if not b.tagged]
                    plain = [b for b in blocks if not b.named]
                    once = {(host, b.path, "text", h(b.text)) for b in blocks}
                    once.update((host, p, "shape", h(s)) for p, s in shapes)
                    once.update((host, p, "pages", 0) for p, _ in shapes)
                    once.update((host, b.path, "main", 0) for b in blocks if b.main)
                    once.update((host, p, "named", 0) for b in blocks for p in b.named)
                    if _main_leads(plain):
                        once.update((host, b.path, "side", 0) for b in plain if not b.main)
                    counts.update(once)
                    for b in blocks:
                        counts[host, b.path, "mass", 0] += len(b.text)
                rows = [(*k, n) for k, n in counts.items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.string()] * 3 + [pa.int64()] * 2)],
                    names=["host", "path", "kind", "h", "n"],
                )

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, schema)


def style_tree(pages: DataFrame) -> DataFrame:
    """``host, path, seen, named, importance, own`` of every node of every host's merged tree:
    pages with the node, whether its names say furniture, the weighted importance of its
    branch and, where text stands at the node itself, of that text alone."""
    each = node_counts(pages).groupBy("host", "path", "kind", "h").agg(F.sum("n").alias("n"))
    kinds = each.groupBy("host", "path", "kind").agg(
        F.sum("n").alias("n"), F.sum(-F.col("n") * F.log("n")).alias("s")
    )
    entropy = F.when(F.col("n") > 1, (F.log("n") + F.col("s") / F.col("n")) / F.log("n")).otherwise(1.0)

    def of(kind: str, value: Column) -> Column:
        return F.max(F.when(F.col("kind") == kind, value))

    n = F.col("n")
    nodes = kinds.groupBy("host", "path").agg(
        of("text", n).alias("texts"), of("text", entropy).alias("e"), of("shape", entropy).alias("shape"),
        F.coalesce(of("pages", n), F.lit(0)).alias("seen"), of("main", n).isNotNull().alias("main"),
        of("named", n).isNotNull().alias("named"), F.coalesce(of("side", n), F.lit(0)).alias("side"),
        F.coalesce(of("mass", n), F.lit(0)).alias("mass"),
    )
    nodes = stored(nodes, "style-nodes")

    steps = F.split("path", ">")
    ups = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), ">"))
    texts = nodes.where("texts IS NOT NULL").select("host", F.explode(ups).alias("path"), "texts", "e", "mass")
    below = texts.groupBy("host", "path").agg(
        (F.sum(F.col("texts") * F.col("e")) / F.sum("texts")).alias("below"), F.sum("mass").alias("held")
    )
    whole = nodes.groupBy("host").agg(F.sum("mass").alias("whole"))
    both = below.join(nodes, ["host", "path"]).join(whole, "host")
    shape = (1 - BELOW) * F.coalesce("shape", F.lit(0.0))
    beside = 1 - (1 - BESIDE) * F.col("side") / F.greatest("seen", F.lit(1))
    place = F.when(F.col("main"), IN_MAIN).otherwise(beside) * (1 + F.col("held") / F.greatest("whole", F.lit(1)))
    name = F.when(F.col("named"), NAMED).otherwise(1.0)
    return both.select(
        "host", "path", "seen", "named", ((BELOW * F.col("below") + shape) * place * name).alias("importance"),
        ((BELOW * F.col("e") + shape) * place).alias("own"),
    )


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, low: float = LOW, into: str = "text") -> DataFrame:
    """``pages`` with their main text in the column ``into``."""
    tree = style_tree(pages).where(F.col("seen") >= least_pages)
    cut = tree.groupBy("host").agg(
        F.collect_set(F.when(F.col("own") < low, F.col("path"))).alias("low"),
        F.collect_set(F.when(F.col("named") & (F.col("importance") >= low), F.col("path"))).alias("lifted"),
        F.collect_set(F.when(F.col("named"), F.col("path"))).alias("named"),
    )
    cut = cut.where((F.size("low") > 0) | (F.size("lifted") > 0) | (F.size("named") > 0))
    # A named branch that is not lifted is low as a whole.
    cut = cut.select("host", F.array_union("low", F.array_except("named", "lifted")).alias("low"), "lifted")
    cut = stored(cut, "low-branches")
    names = [c for c in pages.columns if c != into]
    # The row travels as one value, so that no column of it can clash.
    rows = pages.select(F.struct(*names).alias("row"), F.col("html").alias("page"), host_of(F.col("url")).alias("host"))
    rows = rows.join(cut, "host", "left").select("row", "page", "low", "lifted")
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                each = zip(*(part.column(i).to_pylist() for i in (1, 2, 3)))
                texts = [main_text(p, set(low or ()), set(lifted or ())) for p, low, lifted in each]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=schema.names)

    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in names], into)
