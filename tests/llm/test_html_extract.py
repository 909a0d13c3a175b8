import math
import random

from corvane.llm import html_extract as he

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";x(0);</script></head>
<body><header><a href="/">Home</a></header><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div>
<article><header><h1>Title&nbsp;one</h1></header><p><b>Bold  start.<br><p>Second &lt;b&gt; para
line</p><ul><li>one<li>two</ul><div class="comments"><p>I like it</p></div></article>
<aside>Side</aside><div id="cookie-notice">We use cookies</div><form><p>Search</p></form><footer>&copy; x</footer></body></html>"""


def texts(spark, *pages, host="s.example"):
    rows = [(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in he.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[i] for i in range(len(pages))]


def test_single_pages_go_by_names(spark):
    # one page a call: nothing is known of it but its names
    assert texts(spark, PAGE) == ["Title one\nBold start.\nSecond <b> para line\none\ntwo"]
    for html, want in (("<article><p>cut off &am", "cut off &am"), ("<article><p>cut</p><p cla", "cut"), ("<article>a < b <x", "a < b"), (None, ""), ("", ""), ("<!-- open", ""), ("no markup at all", "no markup at all")):
        assert texts(spark, html) == [want], html


def test_names_inside_an_article_do_not_decide(spark):
    article = '<body class="no-sidebar"><article><div class="entry-header"><h1>Title {0}</h1></div><p class="related-work">Work {0} of {0}</p><section id="search-results-study"><p>Found {0} things</p></section></article></body>'
    want = "Title {0}\nWork {0} of {0}\nFound {0} things"
    for n in (1, 6):
        words = ["alpha", "beta gamma", "delta", "epsilon zeta", "eta", "theta"][:n]
        assert texts(spark, *[article.format(w) for w in words]) == [want.format(w) for w in words]


def test_style_tree_removes_what_repeats(spark):
    html = lambda i: f'<body><div class="x1">Daily offers and more</div><div class="x2"><p>Story {i} tells of {i * i}</p><p>and ends {i}</p></div><div class="x3">Partner links</div></body>'
    rows = [(i, f"http://Site.example/{i}", html(i), "c") for i in range(8)] + [(91, "http://other.example/", None, "c"), (92, "bad url", "", "c"), (3, "http://Site.example/3", html(3), "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    for limit in (he.BROADCAST_NODES, 0):  # broadcast, and by a shuffle with dealt hosts
        result = he.extract(df, broadcast_nodes=limit).collect()
        got = {r.page_id: r for r in result}
        assert len(result) == len(rows)
        for i in range(8):
            assert got[i].text == f"Story {i} tells of {i * i}\nand ends {i}" and got[i].n_chars == len(got[i].text)
        assert got[91].text == got[92].text == ""
    assert he.extract(df.limit(0)).count() == 0


def test_a_share_bar_in_the_article_goes_and_a_form_page_stays(spark):
    rng = random.Random(2)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randrange(5, 60)))
    stories = [[prose() for _ in range(rng.randrange(1, 7))] for _ in range(12)]
    pages = ["<body><form><main>" + "".join(f"<p>{x}</p>" for x in s) + '<div class="tools">Send this page to a friend</div></main></form></body>' for s in stories]
    assert texts(spark, *pages) == ["\n".join(s) for s in stories]


def test_long_and_deep_pages(spark):
    deep = "<div>" * 3000 + "<p>bottom" + "</section></p>" * 10
    assert texts(spark, deep, "<article>" + "<p>" + "word " * 200_000, host="d.example")[1].count("word") == 200_000


def entropy(values, base):
    n = len(values)
    return -sum(values.count(v) / n * math.log(values.count(v) / n) for v in set(values)) / math.log(base)


def test_importance_equals_plain_entropies(spark):
    rng = random.Random(7)
    pages = []
    for i in range(9):
        items = "".join(f"<li>{rng.choice(['Home', 'News', 'Contact us today'])}</li>" for _ in range(rng.choice([2, 2, 3])))
        pages.append(f"<body><ul>{items}</ul>" + "".join(f"<p>{rng.choice('abc')} {rng.random()} text</p>" for _ in range(rng.randrange(1, 5))) + "</body>")
    rows = [("h", p) for p in pages]
    nodes = {r.node: r for r in he.style_nodes(spark.createDataFrame(rows, "host string, html string").repartition(2)).collect()}
    want, below = {}, {}
    m = len(pages)
    parsed = [he.Page(p) for p in pages]
    states = {s for p in parsed for s, _ in p.blocks} | {s for p in parsed for s in p.children}
    for state in states:
        looks, spread, chars = [], {}, 0
        for p in parsed:
            own = [t for s, t in p.blocks if s == state]
            look = f"{len(own).bit_length()} {sum(map(len, own)).bit_length()} False" if own else ""
            looks.append(look + "".join(" " + " ".join(x) for s, x in p.children.items() if s == state))
            chars += sum(map(len, own))
            for feature in {x for t in own for x in (t, "^" + " ".join(t.split(" ", 3)[:3]))}:
                spread[feature] = spread.get(feature, 0) + 1
        shared = lambda x: ((m - 1) * x + he.SHARED_PAGES * ((m - 1) * x + he.UNKNOWN) / m) / (m - 1 + he.SHARED_PAGES)
        look = shared(min(1.0, entropy(looks, min(m, he.MOST_BASE))))
        # a text feature that is on n pages has the entropy log n / log m over them
        content = shared(1 - sum(n * math.log(n) for n in spread.values()) / sum(spread.values()) / math.log(m)) if spread else None
        want[state[3]] = (look, (1 - he.TEXT_WEIGHT) * look + he.TEXT_WEIGHT * content if spread else look, chars)
    for chain, (look, own, _) in want.items():
        node = chain[-1] if chain else 0
        assert abs(nodes[node].own - own) < 1e-9 and nodes[node].pages == m
        below = [(o, c) for other, (_, o, c) in want.items() if other[: len(chain)] == chain and (chain or not other)]
        mass = sum(c for _, c in below)
        branch = own if len(below) == 1 else he.OWN_WEIGHT * look + (1 - he.OWN_WEIGHT) * sum(o * c for o, c in below) / mass if mass else look
        assert abs(nodes[node].importance - branch) < 1e-9
    assert len(nodes) == len(want)


def test_the_tree_decides_without_names(spark):
    """Most blocks of the synthetic pages get the same verdict without any name."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host, _ = he.host_path(he.F.col("url"))
    nodes = he.style_nodes(pages.select(host.alias("host"), "html")).collect()
    own = {(r.host, r.node): r.own for r in nodes}
    parsed = [(r.host, he.Page(r.html).blocks) for r in pages.select(host.alias("host"), "html").collect()]
    best = {}
    for h, blocks in parsed:
        for state, _ in blocks:
            for x in state[3]:
                best[h, x] = max(best.get((h, x), 0), own[h, state[3][-1]])
    with_names = {(r.host, r.node) for r in nodes if r.node and r.importance + r.prior < he.LEAST and (r.best or 0) < he.CLEAR}
    names = {}
    for _, blocks in parsed:
        for state, _ in blocks:
            names[state[3][-1]] = he._prior(state)
    alone = {(r.host, r.node) for r in nodes if r.node and r.importance + r.prior - names.get(r.node, r.prior) < he.LEAST and best.get((r.host, r.node), 0) < 1.0}
    many = {(r.host, r.node) for r in nodes if r.pages >= 8}
    same = total = 0
    for h, blocks in parsed:
        for state, _ in blocks:
            path = {(h, x) for x in state[3]}
            if path <= many:
                total += 1
                same += path.isdisjoint(with_names) == path.isdisjoint(alone)
    assert total > 500 and same / total > 0.9, (same, total)


def test_pages_that_all_look_alike_keep_their_text(spark):
    pages = [f"<body><div>{a} {b} {c}</div></body>" for a, b, c in zip("abcdefgh", "ijklmnop", "qrstuvwx")]
    assert texts(spark, *pages, host="plain.example") == [f"{a} {b} {c}" for a, b, c in zip("abcdefgh", "ijklmnop", "qrstuvwx")]


def test_comments_and_sidebars_go_however_they_vary(spark):
    rng = random.Random(3)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randrange(3, 90)))
    many = lambda: "".join(f"<p>{prose()}</p>" for _ in range(rng.randrange(1, 20)))
    stories = [prose() for _ in range(12)]
    pages = [f'<body><article><p>{s}</p><section class="comments">{many()}</section></article><aside>{many()}</aside><div id="sidebar">{many()}</div></body>' for s in stories]
    assert texts(spark, *pages) == stories
