"""HTML main-text extraction by equivalence-class template deduction.

Pages of a host share a template. A token is a structural element by its path of elements with their class and role, and, in a second
role, by its place: the same path with each element's number among its like siblings. A block of text is a token by the path it stands on.
Tokens that occur equally often on each of the host's pages have the same occurrence vector; those are an equivalence class. A class is
valid if it is on enough pages and has more than one token. The elements of valid classes, each below one of another, are the
template, a tree. Blocks of text that recur on many of a host's pages, beside other text each time, are the template's text (copies of a
page are no evidence of one); what else stands in the tree, the slots, is the pages' own.

The main slot is found by going down the tree of places, to the element that holds nearly all of the host's own text, and no further than
where own text stands directly, or an ``article`` or ``main``. An ``article`` or ``main`` further down, with much of the text, is a hint
that is followed. Without a main slot, the slots are all elements that hold much text of their own, if together they hold nearly all of it;
like elements that each page has equally many of are told apart by place. A page's text is what stands in the slots, without containers that hold template text alone and
lines that all pages have; a line that only recurs, among text of the page's own, stays.

Names are a hint. Elements such as ``nav`` and names that say wholly what they are (``advert``) are left out. A name that has such a
word in it (``left-sidebar``, ``social-security``) leaves an element out if the template confirms it: the element is part of the tree and
holds less than half of the text; where there is no template, by its name. Headings, paragraphs, cells and articles are left out only
where such a word is a whole name, a page's body never. Pages that have none of their template's slots, and those of hosts without a
template, give their ``article`` or ``main``, or else all blocks that are not mostly links.

At scale: an occurrence vector is kept as a sum of hashes over pages, pre-aggregated where pages are read, so that a host
with a third of all pages is no single group. A host's template is one row, bounded by the tokens of a page. Pages meet it in a
join by host; hosts of more than a ``HOT`` th of all pages (at most ``HOT`` of them) are dealt out by a salt too, and their templates
repeated for each salt. Pages are parsed twice and shuffled once at most, in time linear in their length and depth. What stands
beside a block is a hash, counted in two steps, so that a block of all pages is no single group either.

A page whose blocks are all of the template keeps them. Null html gives an empty text. Pages without a host are one host. Repeated
pages are extracted each; extra columns are kept, those named ``text`` and ``n_chars`` replaced. Unclosed, misnested and cut tags are
read as far as they go.
"""

from __future__ import annotations

import bisect
import functools
import html
import itertools
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: A class is part of the template if it is on this share of a host's pages, and on 2 of them; a text block, if it stands beside
#: this share of the host's distinct contents, and beside CONTENTS. Names need as many contents to be confirmed or refuted.
ON_PAGES = 0.5
TEXT_ON_PAGES = 0.2
CONTENTS = 3
#: What stands beside a block: the longest other blocks of the page that have this share of its other text.
BESIDE = 0.9
#: The main slot has this share of a host's own text; an article or main that is followed as a hint, this one.
MAIN_SHARE = 0.8
ARTICLE_SHARE = 0.2
#: Without a main slot, a slot is content if it has this share of the text of the host's largest one.
TEXT_SHARE = 0.2
#: An element with this share of a host's text isn't left out by a word in its name.
NAME_SHARE = 0.5
#: A host with more than a HOT th of all pages is dealt out by a salt.
HOT = 1000

#: Elements whose content is no text of the page (if never closed, the rest of the page is theirs; of the second, nothing),
#: elements that end a block, that have no end tag, that are left out.
RAW = frozenset("script style noscript template iframe textarea title".split())
EMBEDDED = frozenset("svg math select object audio video canvas".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("nav header footer aside form head button dialog menu label legend fieldset".split())
CONTAINERS = frozenset("article body center details div footer form header main nav section aside table tbody tr td ul ol dl figure blockquote".split())
#: Elements that an opening tag of the same kind closes.
NO_NESTING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of names of what is left out; first words of names that say that something is, or isn't, elsewhere.
HINTS = r"ad|ads|adv|advert\w*|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|cookiebar|disqus|disclaimer|footer|gdpr|header|login|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|notice|notification|outbrain|overlay|pagination|pager|popup|promo|promoted|recommended|related|replies|reply|respond|rss|search|searchbox|share|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|subscription|taboola|tags|toolbar|topbar|widget"
PART = re.compile(rf"(?:^|[_-])(?:{HINTS})(?=$|[_-])", re.I)
WHOLE = re.compile(rf"(?:{HINTS})", re.I)
#: Words that decide in any part of a name: readers' comments vary as a page's own text does.
COMMENTS = re.compile(r"(?:^|[_-])(?:comments?|commentlist|disqus|replies|reply|respond)(?=$|[_-])", re.I)
ELSEWHERE = re.compile(r"(?:no|non|not|has|with|without|is)(?:[_-]|$)", re.I)
#: Elements that only a whole name leaves out, and that none does.
BY_WHOLE_NAME = frozenset("article h1 h2 h3 h4 h5 h6 p li dd dt td th tr blockquote pre code figure figcaption".split())
NEVER = frozenset("html body main".split())
TAGS = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-z][a-z0-9:-]*+)([^>]*+)(?:>|\Z)|[^<]++|<",
    re.S | re.I,
)
CLOSE = {name: re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I) for name in RAW | EMBEDDED}
NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


@functools.lru_cache(maxsize=100_000)
def left_out(element: str, names: tuple[str, ...]) -> int:
    """2 if an element's names (its class, id and role) leave it out, 1 if a part of a name only says so, else 0."""
    if element in NEVER:
        return 0
    words = [w for n in names for w in n.split()]
    if any(map(WHOLE.fullmatch, words)):
        return 2
    if element in BY_WHOLE_NAME:
        return 0
    parts = [w for w in words if PART.search(w) and not ELSEWHERE.match(w)]
    return 0 if not parts else 2 if any(map(COMMENTS.search, parts)) or element not in BLOCKS else 1


class Node:
    """A structural element: its token by path and by place, what is above, its depth and rank (2 for article and main, 0 for body, html
    and the page, else 1), whether a part of its name would leave it out, the characters of text in it and in all below that are
    not links."""

    __slots__ = ("token", "place", "up", "depth", "rank", "weak", "chars", "below")

    def __init__(self, token, place, up, rank, weak):
        self.token, self.place, self.up, self.rank, self.weak = token, place, up, rank, weak
        self.depth = up.depth + 1 if up else 0
        self.chars = self.below = 0


class Element:
    __slots__ = ("name", "out", "node", "link", "main", "like")

    def __init__(self, name, out, node, link, main):
        self.name, self.out, self.node, self.link, self.main = name, out, node, link, main
        self.like = {}


class Block:
    """A block of text: its words, the structural element that it stands in, what it is part of."""

    __slots__ = ("text", "node", "main", "linked")

    def __init__(self, text, node, main, linked):
        self.text, self.node, self.main, self.linked = text, node, main, linked

    def token(self) -> int:
        return _hash(f"{self.node.token} {self.text}")


#: The page itself, by path and by place.
PAGE, PAGE_PLACE = _hash(""), _hash("#")


def parse(page: str) -> tuple[list[Block], list[Node]]:
    """The page's blocks in order, without what is left out, and its structural elements, each after those above it."""
    nodes = [Node(PAGE, PAGE_PLACE, None, 0, False)]
    root = Element("", False, nodes[0], False, False)
    stack, blocks, buffer = [root], [], []
    linked = size = 0
    seen_main = False
    never_closed = set()

    def flush():
        nonlocal linked, size
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                home = next(e for e in reversed(stack) if e.name in BLOCKS or e is root)
                block = Block(text, home.node, home.main, linked * 2 > size)
                blocks.append(block)
                if not block.linked:
                    home.node.chars += len(text)
            buffer.clear()
        linked = size = 0

    at, end = 0, len(page)
    while at < end:
        m = TAGS.match(page, at)
        at = m.end()
        got = m.group()
        if got[0] != "<" or got == "<":
            if not stack[-1].out:
                buffer.append(got)
                size += len(got)
                linked += len(got) if stack[-1].link else 0
            continue
        name = m.group(2) or m.group(5)
        if not name:
            continue
        name = name.lower()
        closing = m.group(1) or m.group(4)
        attributes = m.group(3) if m.group(3) is not None else m.group(6) or ""
        if name in CLOSE:
            if not closing and name not in never_closed and not (name in ("svg", "math") and attributes.endswith("/")):
                close = CLOSE[name].search(page, at)
                if close:
                    at = close.end()
                elif name in RAW:
                    at = end
                else:
                    never_closed.add(name)
            continue
        if name in BLOCKS:
            flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            continue
        if name in VOID:
            continue
        for k in range(len(stack) - 1, 0, -1):  # an element that can't hold its like ends it
            if stack[k].name in CONTAINERS and stack[k].name not in NO_NESTING.get(name, ()):
                break
            if stack[k].name in NO_NESTING.get(name, ()):
                del stack[k:]
                break
        top = stack[-1]
        named = {a.lower(): x or y or z for a, x, y, z in NAMES.findall(attributes)} if "=" in attributes or "hidden" in attributes.lower() else {}
        said = left_out(name, (named.get("class", ""), named.get("id", ""), named.get("role", ""))) if named else 0
        by_name = said == 2 or "hidden" in named or named.get("aria-hidden", "") == "true"
        out = top.out or name in LEFT_OUT or by_name
        main = top.main or name in ("article", "main")
        if name in ("article", "main") and not seen_main and not any(e.name in ("aside", "footer") for e in stack):
            seen_main, out = True, by_name  # a part that was never closed doesn't swallow it
        node = top.node
        if name in CONTAINERS or named.get("class") or named.get("id") or said == 1:
            kind = f"{name} {named.get('class', '')} {named.get('role', '')}"
            number = top.like[kind] = top.like.get(kind, -1) + 1
            rank = 2 if name in ("article", "main") else int(name not in ("body", "html"))
            node = Node(_hash(f"{node.token} {kind}"), _hash(f"{node.place} {kind} #{number}"), node, rank, said == 1)
            nodes.append(node)
        stack.append(Element(name, out, node, top.link or name == "a", main))
    flush()
    for node in reversed(nodes):
        node.below += node.chars
        if node.up:
            node.up.below += node.below
    return blocks, nodes


def beside(blocks: list[Block]) -> list[int]:
    """For each block the hash of what stands beside it, and last that of the page's content."""
    hashes = [_hash(b.text) for b in blocks]
    order = sorted(range(len(blocks)), key=lambda k: (-len(blocks[k].text), hashes[k]))
    held = [0, *itertools.accumulate(len(blocks[k].text) for k in order)]
    sums = [0, *itertools.accumulate(hashes[k] for k in order)]
    out = [0] * (len(blocks) + 1)
    for place, k in enumerate([*order, len(blocks)]):
        size, own = (len(blocks[k].text), hashes[k]) if k < len(blocks) else (0, 0)
        least = (held[-1] - size) * BESIDE
        n = bisect.bisect_left(held, least)
        out[k] = (sums[n] if n <= place else sums[bisect.bisect_left(held, least + size)] - own) % (1 << 63)
    return out


def host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


TOKEN = "host string, token long, tag boolean, parent long, depth int, rank int, of long, weak boolean, n long, vector long, chars long, below long, beside long"


def _tokens(pages: DataFrame, column: str) -> DataFrame:
    """host, token, whether it is an element, parent, depth and rank, the token by path of one by place, whether its name is in doubt, its
    count on this page, this page's part of its occurrence vector, characters of text in it and in all below that are not links, and
    what it stands beside. Token 0 is the page, beside its content."""
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), *[pa.int64()] * 5]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                rows = []
                part = batch.slice(a, 200)
                for h, key, page in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    blocks, nodes = parse(page or "")
                    found = {}
                    for node in nodes[1:]:
                        for token, parent, of in ((node.token, node.up.token, None), (node.place, node.up.place, node.token)):
                            row = found.setdefault(token, [True, parent, node.depth, node.rank, of, node.weak, 0, 0, 0, 0])
                            row[6] += 1
                            row[7] += node.chars
                            row[8] += node.below
                    *others, content = beside(blocks)
                    for b, other in zip(blocks, others, strict=True):
                        row = found.setdefault(b.token(), [False, b.node.place, 0, 0, None, False, 0, 0, 0, other])
                        row[6] += 1
                        row[7] += 0 if b.linked else len(b.text)
                    rows.append((h, 0, False, 0, 0, 0, None, False, 1, _hash(f"{key}") >> 16, 0, nodes[0].below, content))
                    for token, (*what, n, chars, below, other) in found.items():
                        rows.append((h, token, *what, n, _hash(f"{key} {n}") >> 16, chars, below, other))
                columns = zip(*rows, strict=True) if rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=[x.split()[0] for x in TOKEN.split(", ")])

    return pages.select(host().alias("host"), F.xxhash64("page_id", "url").alias("key"), F.col(column).alias("html")).mapInArrow(run, TOKEN)


def slots(total: int, named: bool, nodes: list[dict], texts: list[dict]) -> tuple[list[int], list[int]]:
    """The slots of a template, and the elements that their names leave out, from the elements of valid classes and the recurring texts.

    Fields of elements: token, parent, depth, rank, of, weak, constant (equally often on each page, more than once), chars, below.
    """
    tree = {PAGE: None, PAGE_PLACE: None}
    for e in sorted(nodes, key=lambda e: e["depth"]):
        if e["parent"] in tree:
            tree[e["token"]] = e
    tree = {t: e for t, e in tree.items() if e}
    out = {t for t, e in tree.items() if e["of"] is None and e["weak"] and e["below"] < total * NAME_SHARE} if named else set()

    # Of each place, text that isn't the pages' own: recurring, or of an element that its name leaves out.
    chars, below = ({t: e[c] for t, e in tree.items()} for c in ("chars", "below"))
    own = total

    def take(token, n):
        nonlocal own
        own -= n
        while token in tree:
            below[token] -= n
            token = tree[token]["parent"]

    gone = set()
    for t, e in tree.items():
        if e["of"] is not None and (e["parent"] in gone or e["of"] in out):
            if e["parent"] not in gone:
                take(t, e["below"])
            gone.add(t)
    for x in texts:
        if x["parent"] in tree and x["parent"] not in gone:
            for t in (x["parent"], tree[x["parent"]]["of"]):
                if t in chars:
                    chars[t] -= x["chars"]
            take(x["parent"], x["chars"])

    kids = {}
    for t, e in tree.items():
        if e["of"] is not None and t not in gone:
            kids.setdefault(e["parent"], []).append(t)
    at, end = PAGE_PLACE, False
    while not end:
        best = max(kids.get(at, ()), key=lambda t: (below[t], t), default=None)
        end = best is None or below[best] <= 0 or below[best] < own * MAIN_SHARE
        if not end:
            at = best
            end = tree[at]["rank"] == 2 or (tree[at]["rank"] == 1 and chars[at] > 0)
    if at in tree and tree[at]["rank"] == 2:
        return [at], sorted(out)
    hints = [e for t, e in tree.items() if e["of"] is None and e["rank"] == 2 and e["below"] > 0 and e["below"] >= total * ARTICLE_SHARE]
    if hints:
        return [min(hints, key=lambda e: (e["depth"], e["token"]))["token"]], sorted(out)
    if at in tree and tree[at]["rank"] > 0:
        return [at], sorted(out)
    split = {t for t, e in tree.items() if e["of"] is None and e["constant"]}
    # Elements by path, and by place where those of one path are told apart.
    rest = {t: chars[t] for t, e in tree.items() if (t not in split if e["of"] is None else e["of"] in split) and t not in out and t not in gone and e["rank"] > 0}
    most = max(rest.values(), default=0)
    found = {t: n for t, n in rest.items() if n > 0 and n >= most * TEXT_SHARE}
    return sorted(found) if sum(found.values()) >= own * MAIN_SHARE else [], sorted(out)


def templates(pages: DataFrame, column: str = "html") -> DataFrame:
    """host, pages, slots (elements whose text is content), fixed (text blocks of the template), always (those on all pages) and doubted
    (elements that a part of their name leaves out; null: all such): one row for each host."""
    per_token = cut(
        _tokens(pages, column).groupBy("host", "token", "tag")
        .agg(
            *[F.min(c).alias(c) for c in ("parent", "depth", "rank", "of")], F.max("weak").alias("weak"), F.count("*").alias("pages"),
            ((F.min("n") == F.max("n")) & (F.min("n") > 1)).alias("constant"), *[F.sum(c).alias(c) for c in ("vector", "chars", "below")], F.count_distinct("beside").alias("contents"),
        )
        .where("pages > 1 or token = 0")  # a token of one page is in no class
    )
    # Every page of a host has token 0, which so counts its pages, text and distinct contents.
    of_host = per_token.where("token = 0").select("host", F.col("pages").alias("on"), F.col("below").alias("total"), F.col("contents").alias("of_contents"))
    sizes = per_token.groupBy("host", "pages", "vector").agg(F.count("*").alias("alike"))
    classed = per_token.where("token != 0").join(sizes, ["host", "pages", "vector"]).join(of_host, "host", "right")
    valid = F.col("tag") & (F.col("pages") >= F.col("on") * ON_PAGES) & (F.col("alike") > 1)
    fixed = ~F.col("tag") & (F.col("contents") >= CONTENTS) & (F.col("contents") >= F.col("of_contents") * TEXT_ON_PAGES)
    element = F.struct("token", "parent", "depth", "rank", "of", "weak", "constant", "chars", "below")
    grouped = classed.groupBy("host").agg(
        F.max("on").alias("pages"), F.max("total").alias("total"), (F.max("of_contents") >= CONTENTS).alias("named"),
        F.collect_list(F.when(valid, element)).alias("nodes"),
        F.collect_list(F.when(fixed, F.struct("token", "parent", "chars"))).alias("texts"),
        F.collect_list(F.when(fixed & (F.col("pages") == F.col("on")), F.col("token"))).alias("always"),
    )

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                found, out = slots(r["total"], r["named"], r["nodes"], r["texts"])
                yield pa.RecordBatch.from_pylist(
                    [{"host": r["host"], "pages": r["pages"], "slots": found, "fixed": [x["token"] for x in r["texts"]], "always": r["always"], "doubted": out if r["named"] else None}],
                    schema=pa.schema([("host", pa.string()), ("pages", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("slots", "fixed", "always", "doubted")]]),
                )

    return grouped.mapInArrow(run, "host string, pages long, slots array<long>, fixed array<long>, always array<long>, doubted array<long>")


def main_text(page: str | None, slots=(), fixed=(), always=(), doubted=None) -> str:
    """The text of a page's content slots, without lines that all pages have and containers that hold template text alone. What stands
    directly in the body has no container: there, recurring lines are left out each."""
    slots, fixed, always, doubted = set(slots or ()), set(fixed or ()), set(always or ()), doubted if doubted is None else set(doubted)
    blocks, nodes = parse(page or "")
    inside, out = {}, {}
    for node in nodes:
        inside[node] = node.token in slots or node.place in slots or (node.up is not None and inside[node.up])
        out[node] = (node.weak and (doubted is None or node.token in doubted)) or (node.up is not None and out[node.up])
    blocks = [b for b in blocks if not out[b.node]]
    found = [b for b in blocks if inside[b.node]] or [b for b in blocks if b.main]
    if not found:
        found = [b for b in blocks if not b.linked] or blocks
    if fixed:
        tokens = [b.token() for b in found]
        own = {b.node for b, t in zip(found, tokens, strict=True) if t not in fixed}
        found = [b for b, t in zip(found, tokens, strict=True) if t not in always and b.node in own and (b.node.rank or t not in fixed)] or found
    return " ".join(b.text for b in found)


def _free(columns: list[str], name: str) -> str:
    while name.lower() in map(str.lower, columns):
        name += "_"
    return name


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text``, its main text, and ``n_chars``, the text's code points."""
    kept = pages.drop("text", "n_chars")
    n, place = len(kept.columns), kept.columns.index(column)
    of_host, salt = _free(kept.columns, "of_host"), _free(kept.columns, "salt")
    learned = {c: _free(kept.columns, c) for c in ("slots", "fixed", "always", "doubted")}
    found = cut(templates(pages, column))
    total = found.agg(F.sum("pages")).first()[0] or 0
    # At most HOT hosts have so many pages.
    hot = {r.host: -(-r.pages * HOT // total) for r in found.where(F.col("pages") * HOT > total).where(F.col("pages") > HOT).select("host", "pages").collect()}
    salts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), F.col(of_host)), F.lit(1)) if hot else F.lit(1)
    repeated = found.select(F.col("host").alias(of_host), *[F.col(c).alias(to) for c, to in learned.items()]).withColumn(salt, F.explode(F.sequence(F.lit(0), salts - 1)))
    salted = kept.withColumn(of_host, host()).withColumn(salt, F.pmod(F.xxhash64("page_id", "url"), salts).cast("int"))
    met = salted.join(repeated, [of_host, salt], "left").select(*kept.columns, *learned.values())

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts = [main_text(*x) for x in zip(*(part.column(c).to_pylist() for c in (place, *range(n, n + len(learned)))), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*part.schema.names[:n], "text", "n_chars"])

    return met.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
