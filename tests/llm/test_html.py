"""Main text of pages: what is left out, what a template decides, and a brute-force template."""

from collections import defaultdict
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from wardline.llm import html_template as h

PAGE = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r.text for r in h.digest(spark.createDataFrame(rows, PAGE)).collect()}


@pytest.mark.parametrize(("page", "text"), [
    ("<article><p>a b</p><svg class='i'/><p>c d</p></article>", "a b c d"),
    ("<article><p>a</p><svg><text>no</text></svg><p>b</p><canvas><p>c</p></article>", "a b c"),
    ("<p>good <button>Share</button> text</p>", "good text"),
    ("<p>good <span class='advert'>BUY NOW</span> text", "good text"),
    ("<p>good <b>text <span class=advert>BUY</p><p>more</p>", "good text more"),
    ("<article class='post-header-left'><p>a</p></article>", "a"),
    ("<body class='no-sidebar'><div class='content has-sidebar'><p>a</p></div><div class='left-sidebar'>b</div></body>", "a"),
    ("<article><h2 class='article-header'>T</h2><p class='related-work'>r</p><p class='advert'>no</p></article>", "T r"),
    ("<main><p>a</p></main><article class='comment'>nice</article>", "a"),
    ("<p>a</p><script>never closed <p>b</p>", "a"),
    ("<p>a&nbsp;b\n c</p>d<!-- no --><p>e<br>f", "a b c d e f"),
    ("<title>t</title><p>a<title>never closed", "a"),
    ("<aside>b<article>a</article></aside>", ""),
    ("<div class=menu>m<article>a</article>", "a"),
    ("x" * 100_000 + "<p>" * 1000, "x" * 100_000),
    ("<svg>" * 20_000 + "a", "a"),
])
def test_what_is_left_out(page, text):
    assert h.main_text(page, (), ()) == text


def test_template_decides_without_names(spark):
    """The text is what the pages' template leaves open: a page by itself gives more."""
    rows = [(k, "http://h.example/", f"<body><div class=q1>Welcome, it is day {k}</div><div class=q2><h1>Title {k}</h1><div class=q3><p>{f'word{k} ' * 40}</p></div><div class=q4>Pass it on to your friends</div></div><div class=q5>Seen {k} times</div></body>") for k in range(8)]
    got = texts(spark, rows)
    for k, _, page in rows:
        assert got[k] == f"Title {k} " + " ".join([f"word{k}"] * 40)
        assert len(h.main_text(page, (), ())) > len(got[k]) + 30
    assert texts(spark, [rows[0]])[0] == h.main_text(rows[0][2], (), ())


class Tree(HTMLParser):
    """Lines of a page as (place, text), and how often each path and place is met: plain strings, without the operator's parser."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.lines, self.seen = [("", "", {})], [], defaultdict(int)
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        path, place, like = self.stack[-1]
        if tag != "p" and tag != "h1":
            kind = f"{tag}.{dict(attrs).get('class', '')}"
            like[kind] = like.get(kind, 0) + 1
            path, place = f"{path}/{kind}", f"{place}/{kind}[{like[kind]}]"
            self.seen[path] += 1
            self.seen[place] += 1
        self.stack.append((path, place, {}))

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.lines.append((self.stack[-1][1], " ".join(data.split())))


def brute(pages):
    """Texts of one host's pages, by whole occurrence vectors, whole sets of contents, and a walk down from the body."""
    trees = [Tree(p) for p in pages]
    n = len(trees)
    vectors = {t: tuple(x.seen.get(t, 0) for x in trees) for x in trees for t in x.seen}
    line_vectors = {line: tuple(x.lines.count(line) for x in trees) for x in trees for line in x.lines}
    all_vectors = [*vectors.values(), *(v for v in line_vectors.values() if n - v.count(0) > 1)]
    places = {t for t, v in vectors.items() if t.endswith("]") and n - v.count(0) >= max(2, n / 2) and all_vectors.count(v) > 1}
    places = {t for t in places if all(t[: i] in places for i in range(1, len(t)) if t[i] == "/")}
    on = {line: {tuple(y for y in x.lines if y != line) for x in trees if line in x.lines} for x in trees for line in x.lines}
    fixed = {line for line, others in on.items() if len(others) >= max(3, len({tuple(x.lines) for x in trees}) / 5)}
    own = [line for x in trees for line in x.lines if line not in fixed]

    def held(place):
        return sum(len(t) for at, t in own if f"{at}/".startswith(f"{place}/"))

    at = ""
    while True:
        below = [t for t in places if t.startswith(f"{at}/") and "/" not in t[len(at) + 1:] and held(t) >= 0.8 * held("")]
        if not below or (at.count("/") > 2 and any(place == at for place, _ in own)):
            break
        at = below[0]
    out = []
    for x in trees:
        lines = [line for line in x.lines if f"{line[0]}/".startswith(f"{at}/")]
        alive = {place for place, t in lines if (place, t) not in fixed}
        out.append(" ".join(t for place, t in lines if place in alive and not ((place, t) in fixed and all(line_vectors[place, t]))))
    return out


def test_template_as_brute_force(spark):
    """Elements without names or meaning: an independent parser, whole vectors and whole contents give the same texts."""
    hosts = {}
    for k in range(60):
        own = f"<h1>Title {k}</h1><p>{f'w{k} ' * (40 + k)}</p><p>Terms apply</p>"
        more = f"<p>A line of some pages</p><p>{f'v{k} ' * 20}</p>" if k % 4 == 3 else ""
        shapes = (
            f"<div>Menu of it</div><div>Pool {k % 4}</div><div>{own}{more}<div>Pass it on</div></div><div>Bye {k % 2} now</div>",
            f"<div>Top</div><div><div>Side {k % 5}</div><div>{own}{more}</div></div>",
            f"<div><div><div>{own}</div></div></div><div>Seen {k} times</div>",
        )
        hosts.setdefault(k % 3, []).append((k, f"http://h{k % 3}.example/{k}", f"<html><body>{shapes[k % 3]}</body></html>"))
    got = texts(spark, [r for rows in hosts.values() for r in rows])
    for rows in hosts.values():
        assert [got[k] for k, _, _ in rows] == brute([page for _, _, page in rows])
    assert got[3] == "Title 3 " + " ".join(["w3"] * 43) + " A line of some pages " + " ".join(["v3"] * 20)
    assert all(got[k] != h.main_text(page) for rows in hosts.values() for k, _, page in rows)


def test_places_without_names(spark):
    """Menu, advert, article and footer as like elements: their places tell them apart; without templates no page is right."""
    rows, want = [], {}
    for k in range(30):
        want[k] = f"Title {k} " + " ".join([f"word{k}"] * 60)
        parts = ["<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul>", f"Buy {k % 7}", f"<h1>Title {k}</h1><p>{f'word{k} ' * 60}</p>", f"About us {k % 3}"]
        rows.append((k, f"http://h{k % 2}.example/{k}", "<html><body>" + "".join(f"<div class=x>{x}</div>" for x in parts) + "</body></html>"))
    assert texts(spark, rows) == want
    assert not any(h.main_text(page) == want[k] for k, _, page in rows)


def test_names_are_confirmed_by_the_template(spark):
    """A word in a name leaves out what the template has on its pages beside the text, not what holds the text or a page's own part."""
    rows = []
    for k in range(10):
        rare = "<div class=social-security>Of pensions</div>" if k == 4 else ""
        rows.append((k, f"http://h.example/{k}", f"<body><div class=content-with-ads><div class=left-sidebar>Side of {k}</div><div class=t><p>{f'word{k} ' * 60}</p>{rare}<div class=post-comments>Nice {k}</div></div></div></body>"))
    got = texts(spark, rows)
    assert all(got[k] == " ".join([f"word{k}"] * 60) + (" Of pensions" if k == 4 else "") for k in range(10))
    assert texts(spark, rows[:1])[0] == ""


def test_sections_of_varying_number(spark):
    """Where elements of the template hold little of the text, no section is lost, however many there are; template text goes."""
    rows = [(k, f"http://h.example/{k}", "<body><div class=nav2>Home</div>" + "".join(f"<section><p>{f'part{j}of{k} ' * 20}</p></section>" for j in range(1 + k % 5)) + f"<div class=z>{k} were here</div></body>") for k in range(20)]
    got = texts(spark, rows)
    assert all(got[k] == " ".join(f"part{j}of{k}" for j in range(1 + k % 5) for _ in range(20)) + f" {k} were here" for k in range(20))


def test_deep_pages_in_linear_time():
    assert h.main_text("<div>" * 30_000 + "a") == "a"
    assert h.main_text("<div>a" * 30_000) == " ".join("a" * 30_000)


def test_hot_host_is_salted(spark, monkeypatch):
    rows = [(k, f"http://{'hot' if k % 3 else k}.example/{k}", f"<body><div class=a><p>Read our terms.</p><p>Story {k} of its own</p></div>") for k in range(90)]
    want = texts(spark, rows)
    monkeypatch.setattr(h, "HOT", 7)
    assert texts(spark, rows) == want and want[1] == "Story 1 of its own"


def test_odd_tables(spark):
    rows = [(1, "http://h.example/", "<p>a</p>"), (1, "http://h.example/", "<p>a</p>"), (None, None, None), (2, "", "<p>" + "long " * 200_000)]
    d = spark.createDataFrame(rows, PAGE).select("*", *[F.lit(k).alias(c) for k, c in enumerate(("slots", "fixed", "salt", "of_host", "host", "pages", "text"))])
    got = h.extract(d)
    assert got.columns == [c for c in d.columns if c != "text"] + ["text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars, r.slots, r.pages) for r in got.collect()) == [(0, 0, 0, 5), (1, 1, 0, 5), (1, 1, 0, 5), (2, 999_999, 0, 5)]
    assert h.digest(d.limit(0)).count() == 0
