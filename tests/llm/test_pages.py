import random
import time

from updatelens.llm import pages as P

from .made import prose


def text_of(source):
    return "\n\n".join(b["t"] for b in P.Reader().read(source, None)[0])


def page(title, blocks, extra="", main="article"):
    body = "".join(f"<p>{b}</p>" for b in blocks)
    end = main.split(" ")[0]
    return (
        f'<html><head><title>{title}</title><style>p{{}}</style></head><body><nav><ul><li><a href="/">Home</a><li>News</ul></nav>'
        f'<div class="ad">Buy {title}</div><{main}><h1>{title}</h1>{body}{extra}</{end}><footer>&copy; host</footer>'
    )


def test_blocks_of_a_page():
    source = page(
        "A &amp; B", ["One<br>two <i>th</i>ree", "x &lt; y&nbsp;z"],
        '<aside>no</aside><form>f<input></form><div id="comments"><p>c</div><script>"</p>"</script><!-- <p>no --><p>last',
    )
    assert text_of(source) == "A & B\n\nOne two three\n\nx < y z\n\nlast"
    assert text_of(None) == "" and text_of("") == ""
    assert text_of("plain words only") == "plain words only"
    assert text_of("a < b and a <b>c</b> < d <1> & more") == "a < b and a c < d <1> & more"
    assert text_of('<p title="a > b" data-x=\'<p>\'>kept</p><p>too <!-- un') == "kept\n\ntoo"
    assert text_of("<p>one</ x>two<!DOCTYPE x><?pi ?> three<![CDATA[ <b> ]]>") == "onetwo three <b>"


def test_names_of_parts():
    source = '<body class="sidebar"><div class="page has-sidebar"><main><div class="post-header"><h1>Title</h1></div><p>Text.</main>'
    assert text_of(source + '<div class="page-header">Top</div><div id="cookieNotice">We</div></div>') == "Title\n\nText."
    assert text_of('<article><p>One.</article><article class="comment"><p>Two.</article>') == "One."
    assert text_of('<div class="with-comments"><p>One.</p></div><div class="comments"><p>Two.</div>') == "One."
    # Inside an article only whole names speak.
    kept = '<article><div class="discussion">We discuss.</div><section id="related-work">Others did.</section><p title="a hidden gem" data-class="ad">Gem.</p>'
    assert text_of(kept + '<ul class="comments"><li>c</ul></article>') == "We discuss.\n\nOthers did.\n\nGem."
    assert text_of("<article><p hidden>x<p style='display: none'>y<p>z") == "z"


def test_inline_parts_end_where_they_end():
    assert text_of('<p>Good <span class="ad">x <span>y</span> Z</span> end.') == "Good end."
    assert text_of('<p>Good <span class="ad">x <p>Next <b>one</i></b>.') == "Good\n\nNext one."


def test_a_teaser_is_not_the_article():
    teaser = '<article class="teaser"><p>Short teaser.</article>'
    assert text_of(f"<div>{teaser}<div><p>{prose(1, 80)}</div></div>").endswith(" ".join(prose(1, 80).split()))
    assert text_of(f"<article><p>{prose(1, 80)}</article><div>Something else here.</div>") == " ".join(prose(1, 80).split())


def test_odd_pages_take_linear_time():
    deep = "<div>" * 100_000 + "deep" + "</div>" * 100_000
    odd = [
        deep, "<a " * 350_000, "<b>" * 100_000 + "x" + "</i>" * 100_000, '<span class="ad">' * 50_000 + "y" + "</span>" * 50_000,
        "<y><div>" + "<x>" * 50_000 + "</y>" * 50_000 + "z", "<svg>" + "</svg " * 150_000, '<a "' * 250_000, "<p>" * 200_000 + "&amp" * 200_000,
        "</" * 400_000, "<li>" * 100_000 + "</li>" * 100_000, "<table><tr><td>" * 30_000, "<p class='" + "a b " * 200_000 + "'>c",
    ]
    for source in odd:
        start = time.perf_counter()
        P.Reader().read(source, [page("T", ["one", "two"]), deep])
        P.frame(source)
        assert time.perf_counter() - start < 15, source[:20]
    assert text_of(deep) == "deep"


def test_wide_pages_are_aligned_fast():
    rng = random.Random(4)
    flat = ["".join(f"<p>{rng.random()}</p>" + ("<p>fixed %d</p>" % i if i % 500 == 0 else "") for i in range(n)) for n in (4000, 4300)]
    cells = ["<table>" + "".join("<tr>" + "".join(f"<td>{rng.random()}" for _ in range(60)) for _ in range(60)) + "</table>" for _ in range(2)]
    for a, b in (flat, cells):
        start = time.perf_counter()
        nodes, other = P.parse(a), P.parse(b)
        P.measure(nodes), P.measure(other)
        pairs = [(x.text, y.text) for x, y in P.align(nodes[0], other[0], {}) if x.tag == "#"]
        assert time.perf_counter() - start < 10
        same = [x for x, y in pairs if x == y]
        assert a is not flat[0] or len(same) == 8


def plain_match(a, b):
    """The recurrence of simple tree matching as it stands."""
    if a.key != b.key:
        return 0
    table = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + plain_match(x, y))
    return 1 + table[-1][-1]


def test_tree_matching_equals_the_plain_recurrence():
    rng = random.Random(7)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["x", "y", "<p>z</p>"])
        tag = rng.choice(["div", "ul", "section"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    for _ in range(150):
        a, b = P.parse(tree(4)), P.parse(tree(4))
        P.measure(a), P.measure(b)
        want = plain_match(a[0], b[0])
        assert P._match(a[0], b[0], {}) == want
        pairs = list(P.align(a[0], b[0], {}))
        assert len(pairs) <= want and all(x.key == y.key for x, y in pairs)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


def test_tree_matching_is_the_same_for_pages_of_any_size():
    """Wide, nested and deep pages are matched by the recurrence as small ones are, with the first of equal partners."""
    rng = random.Random(11)

    def flat(n):
        return "".join(rng.choice(["<p>x</p>", "<pre>y</pre>", "<ul><li>a</ul>", "<ul><li>a<li>b</ul>"]) for _ in range(n))

    def rows(n):
        return "<table>" + "".join("<tr>" + "".join(f"<td>{rng.choice(['', 'x'])}" for _ in range(n)) for _ in range(n)) + "</table>"

    made = [(flat(n), flat(m)) for n, m in [(90, 100), (150, 40), (20, 300)]] + [(rows(25), rows(24))]
    made += [("<div>" * 200 + flat(6), "<div>" * 200 + flat(7)), (f"<div>{flat(80)}</div>" * 2, f"<div>{flat(70)}</div>" * 3)]
    for one, other in made:
        a, b = P.parse(one), P.parse(other)
        P.measure(a), P.measure(b)
        want, memo = plain_match(a[0], b[0]), {}
        assert P._match(a[0], b[0], memo) == want
        pairs = list(P.align(a[0], b[0], memo))
        assert len(pairs) == want
        assert sorted((x.at, y.at) for x, y in pairs) == sorted((x.at, y.at) for x, y in plain_pairs(a[0], b[0]))


def plain_pairs(a, b):
    """The pairs of the recurrence as it stands: from the end, what can be left out is left out, first on the left."""
    yield a, b
    table = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + plain_match(x, y))
    i, j = len(a.children), len(b.children)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            yield from plain_pairs(a.children[i], b.children[j])


NOTE = "This notice stands on every page of the host and says nothing."


def host_pages(host, n, first, layout="div class='body'"):
    return [
        (first + i, f"http://{host}/{i}", page(f"T{first + i}", [prose(first + i, 40), NOTE, prose(first + i + 5000, 30)], f"<div>More at {host}.</div>", layout))
        for i in range(n)
    ]


def test_templates_are_counted_over_all_pages_and_layouts(spark):
    rows = host_pages("a.example", 30, 0) + host_pages("a.example", 20, 100, "section class='other'") + host_pages("few.example", 3, 200)
    rows += [(300 + i, "http://copy.example/x", host_pages("copy.example", 1, 300)[0][2]) for i in range(12)]
    rows += [(400, "http://a.example/odd", "<p>An odd page.")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = {r.page_id: r for r in P.main_text(df).collect()}

    def want(i):
        return f"T{i}\n\n{' '.join(prose(i, 40).split())}\n\n{' '.join(prose(i + 5000, 30).split())}"

    for i in [*range(30), *range(100, 120)]:
        assert got[i].text == want(i) and got[i].n_template == 2
    # Too few pages, or copies of one page, tell nothing about a template.
    assert all(NOTE in got[i].text for i in [200, 201, 202, *range(300, 312)])
    assert got[400].text == "An odd page."
    assert P.main_text(df).count() == len(rows)


def test_large_layout_pages_reach_all_pages(spark, monkeypatch):
    rows = host_pages("a.example", 40, 0) + host_pages("b.example", 6, 100) + [(7, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, P.main_text(df).collect()), key=repr)
    monkeypatch.setattr(P, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, P.main_text(df).collect()), key=repr) == want


def test_page_rows(spark):
    rows = [(n, f"http://h.example/{n}", page(f"T{n}", [prose(n, 20)])) for n in range(6)]
    rows += [(7, None, None), (8, "http://x.example", ""), (None, "no url", "<p>text"), rows[0], (2**60 + 1, "http://h.example/7", "<p>" * 3000 + "long " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS layouts", "3 AS text", "4 AS h")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in P.main_text(df).collect()}
    assert got[2, rows[2][1]][0] == "T2\n\n" + " ".join(prose(2, 20).split())
    assert got[7, None] == ("", 0) and got[8, "http://x.example"] == ("", 0) and got[None, "no url"] == ("text", 4)
    assert got[2**60 + 1, "http://h.example/7"][1] == 50_000 * 5 - 1
    assert P.main_text(df).count() == len(rows)
    assert P.main_text(df.limit(0)).collect() == []
