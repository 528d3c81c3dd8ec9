"""Wrapper induction: planted templates, page forms that are easily cut, a brute-force wrapper, deep and odd pages."""

from __future__ import annotations

import collections
import random
import re

from tidemark.llm import html_extract
from tidemark.llm.html_extract import Tree

SCHEMA = "page_id long, url string, html string"


def extracted(spark, sources: list[tuple[str, str]]) -> list[str]:
    """Texts of (host, html) pages, in order."""
    rows = [(i, f"http://{host}/{i}", source) for i, (host, source) in enumerate(sources)]
    found = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    return [found[i] for i in range(len(sources))]


SITE = "<body><div><p>Best site since 1999</p></div><div class=text><p>Story {0} of the day</p><p>{1}</p></div><div><ul><li><a href=/{0}>See {0}</a></li></ul></div></body>"


def test_wrapper(spark):
    """Constant slots are template, slots of varying links navigation, other varying slots content, whatever they are named.

    A page that says the template's words in a content slot keeps them.
    """
    more = [f"More about number{i}" for i in range(11)] + ["Best site since 1999"]
    sources = [("host.example", SITE.format(f"number{i}", x)) for i, x in enumerate(more)] * 2  # each page twice
    wanted = [f"Story number{i} of the day\n{x}" for i, x in enumerate(more)] * 2
    assert extracted(spark, sources) == wanted
    copies = [("copies.example", SITE.format("one", "same"))] * 9  # one page only: nothing is known to be template
    assert set(extracted(spark, copies)) == {"Best site since 1999\nStory one of the day\nsame\nSee one"}


def test_alignment_decides(spark, monkeypatch):
    """Without the alignment the slots have one name, and the page's own words would go with the template's."""
    more = [f"More about number{i}" for i in range(11)] + ["Best site since 1999"]
    sources = [("host.example", SITE.format(f"number{i}", x)) for i, x in enumerate(more)]
    sound = extracted(spark, sources)
    monkeypatch.setattr(html_extract, "slots_of", lambda skeleton, wrapper: ([0] * len(skeleton.split(" ")), ""))
    assert extracted(spark, sources) != sound


def test_two_layouts(spark):
    """Ids, numbered classes and two layouts of one host do not hide its template."""
    one = "<body><article id=post-{0} class='post p{0}'><p>All rights are ours</p><h1>Title {0}</h1><p>Text {0}</p></article></body>"
    two = "<body><main><section><h2>Topic {0}</h2><div>Answer {0}</div></section><section class=fine><div>Terms apply to all</div></section></main></body>"
    sources = [("h.example", (one if i % 2 else two).format(i)) for i in range(20)]
    assert extracted(spark, sources) == [f"Title {i}\nText {i}" if i % 2 else f"Topic {i}\nAnswer {i}" for i in range(20)]


def test_page_forms(spark):
    """Articles count where they hold most of the text, siblings stay, teasers of links go; names that only look like other things stay."""
    long = "A long text of the page that goes on and on."
    teaser = "<article class=card><a href=/x>Read this</a></article>"
    forms = [
        (f"<main><p>{long}</p><article class=card>teaser</article></main>", f"{long}\nteaser"),
        (f"<body><p>{long}</p><main><article>short</article></main></body>", f"{long}\nshort"),
        (f"<body><article><p>Part one of it.</p></article>{teaser}<article><p>Part two, which is longer.</p></article></body>", "Part one of it.\nPart two, which is longer."),
        (f"<article><div class='entry-header'><h1>Title</h1></div><p>{long}</p><div class='share-price'>12.50</div></article>", f"Title\n{long}\n12.50"),
        (f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{long}</p><footer>by x</footer></article>", f"Title\n{long}"),
        (f"<body><div class='cookie-notice'>c</div><div id=ad-top>a</div><div class='comment-list'><p>me first</p></div><p>{long}</p><div class='post-comments'>kept</div></body>", f"{long}\nkept"),
        ("<p>a<br>b &amp; c&nbsp;d  e<p>f<b>g</b>h", "a b & c d e\nfgh"),
        ("<table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y<ul><li>z</ul></ul>tail", "a\nb\nc\nx\ny\nz\ntail"),
        ("<script>var a = '<p>no</p>';</script><style>p{}</style>x<textarea>no</textarea><!-- <p>no</p> -->y", "xy"),
        ("", ""), ("<", "<"), ("</p></div>x", "x"),
        (f"<body><form id=x><input><label>Find</label><article><h1>T</h1><p>{long}</p></article><button>go</button></form></body>", f"T\n{long}"),
        (f"<body><form method=post><p>{long}</p><select><option>no</select></form></body>", long),
        (f"<body><p>{long}</p><form><label>Name</label><p>Sign up here</p></form></body>", long),
        (f"<body><div role=alert><main><p>{long}</p></main></div></body>", long),
        (f"<body><nav><ul><li><a href=/a>Home page</a></li><li><a href=/b>News</a></li></ul><article><p>{long}</p></article></body>", long),
        (f"<body><nav><ul><li><a href=/a>Home page</a></li></ul><p>{long}</p></body>", long),
        (f"<body><aside><p>Side box</p></aside><nav><a href=/a>x</a></nav><p>{long}</p></body>", long),
    ]
    assert extracted(spark, [(f"h{i}.example", f) for i, (f, _) in enumerate(forms)]) == [t for _, t in forms]


def test_the_wrapper_finds_the_content_without_its_tag_and_classes(spark, monkeypatch):
    """Articles renamed to div and classes taken away: the alignment finds the same texts, and without its rules adverts come in."""
    rng = random.Random(21)
    prose = lambda n: " ".join(rng.choice(["river", "stage", "flood", "gauge", "rain", "crest", "level"]) + str(rng.randint(0, 99)) for _ in range(n))
    marked, bare, texts = [], [], []
    for i in range(40):
        title, parts = prose(4), [prose(rng.randint(15, 40)) for _ in range(rng.randint(2, 5))]
        links = "".join(f"<li><a href=/{k}>{prose(1)}</a></li>" for k in range(5))
        inside = f"<h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in parts)}"
        page = f"<body><nav><ul>{links}</ul></nav><div class=ad>{prose(4)}</div><article>{inside}</article><div class=legal>{prose(3)}</div></body>"
        marked.append((f"h{i % 2}.example", page))
        bare.append((f"h{i % 2}.example", re.sub(r"(</?)article", r"\1div", re.sub(r" class=\w+", "", page))))
        texts.append("\n".join([title, *parts]))
    assert extracted(spark, marked) == texts and extracted(spark, bare) == texts
    real = html_extract.rules
    monkeypatch.setattr(html_extract, "rules", lambda parsed: real(parsed).filter("false"))
    assert not set(extracted(spark, bare)) & set(texts)


def brute_wrapper(sources: list[str]) -> list[str]:
    """Slots by their path of tags and classes; for pages of flat, regular markup that is what alignment finds."""
    pages = []
    for source in sources:
        path, out = [], []
        for tag, attributes, text in re.findall(r"<(/?\w+)([^>]*)>|([^<]+)", source):
            if text:
                out.append(("/".join(path), text))
            elif tag[0] == "/":
                path.pop()
            else:
                path.append(tag + attributes)
        pages.append(out)
    distinct = [list(x) for x in {tuple(p) for p in pages}]
    has = collections.Counter(s for p in distinct for s in {s for s, _ in p})
    shows = collections.Counter(b for p in distinct for b in set(p))
    return ["\n".join(t for s, t in p if not (has[s] >= 4 and shows[(s, t)] >= 0.9 * has[s])) for p in pages]


def test_brute_force(spark):
    rng = random.Random(5)
    sources = []
    for _ in range(60):
        parts = ["<div class=top><p>Welcome to us</p></div>"] if rng.random() < 0.8 else []
        parts.append(f"<div class=body>{''.join(f'<p>words {rng.randint(0, 10**6)}</p>' for _ in range(rng.randint(1, 5)))}</div>")
        if rng.random() < 0.7:
            parts.append(f"<div class=low><h3>{rng.choice(['Ours'] * 19 + ['Yours'])}</h3><p>line {rng.randint(0, 3)}</p></div>")
        if rng.random() < 0.1:
            parts.append("<section><p>Welcome to us</p></section>")
        sources.append(f"<body>{''.join(parts)}</body>")
    assert extracted(spark, [("h.example", x) for x in sources]) == brute_wrapper(sources)


def test_deep_pages(spark):
    """Pages of one host 20,000 elements deep, and one with very many stray ends, neither recurse nor take quadratic time."""
    deep = ["<div>" * 20_000 + f"text {i}" for i in range(5)]
    stray = "<i>" * 20_000 + "</b></p>" * 20_000 + "<p>x</p>" * 1000
    wide = "".join(f"<div class={'ab'[i % 2] * (1 + i % 7)}><p>w{i}</p></div>" for i in range(3000))
    found = extracted(spark, [*[("deep.example", x) for x in deep], ("s.example", stray), ("w.example", wide)])
    assert found[:5] == [f"text {i}" for i in range(5)]
    assert found[5] == "\n".join(["x"] * 1000) and found[6] == "\n".join(f"w{i}" for i in range(3000))


def random_tree(rng: random.Random, size: int) -> Tree:
    parents = [0] + sorted(rng.randrange(i) if i else 0 for i in range(size - 1))
    parents = [0] + [min(p, i) for i, p in enumerate(parents[1:])]
    return Tree(["a"] + [rng.choice("abc") for _ in range(size - 1)], parents)


def best_match(a: Tree, b: Tree, i: int = 0, j: int = 0) -> int:
    """Pairs of the best match, by plain recursion over all order-preserving matches of children."""
    if a.labels[i] != b.labels[j]:
        return 0

    def rows(x: list[int], y: list[int]) -> int:
        if not x or not y:
            return 0
        return max(rows(x[1:], y), rows(x, y[1:]), best_match(a, b, x[0], y[0]) + rows(x[1:], y[1:]))

    return 1 + rows(a.kids[i], b.kids[j])


def test_tree_matching():
    rng = random.Random(9)
    for _ in range(150):
        a, b = random_tree(rng, rng.randint(1, 9)), random_tree(rng, rng.randint(1, 9))
        pairs = html_extract.aligned(a, b)
        assert len(pairs) == best_match(a, b) == len(set(i for i, _ in pairs)) == len(set(j for _, j in pairs))
        assert all(a.labels[i] == b.labels[j] and (not i or (a.parents[i], b.parents[j]) in pairs) for i, j in pairs)
        both = html_extract.merged(a, b)
        assert len(both.labels) == len(a.labels) + len(b.labels) - len(pairs)
        assert len(html_extract.aligned(a, both)) == len(a.labels) and len(html_extract.aligned(b, both)) == len(b.labels)
        assert Tree.read(both.text()).text() == both.text()
