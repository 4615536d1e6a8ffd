import pytest

from palimpsest.llm import wrappers as w
from palimpsest.llm.dom import Page, folded, tree_matching






@pytest.mark.parametrize(
    "html, expected",
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("a < b &lt;c&gt; &eacute;&#233;&#x1F389; &nbsp; &copy", "a < b <c> éé🎉 ©"),
        ("<article><h1>T</h1><p><b>x<br><p>y</p>tail</article><footer>no</footer>", "T\nx\ny\ntail"),
        ("<body><nav>no</nav><header>no</header><div class='main-content'><p>yes<script>var t='</p>';</script></div><aside>no</aside></body>", "yes"),
        ("<article><p>a<div class=ad>no</div>b</p><form><p>no</form><section id='comments'><article><p>no</p></article></section></article>", "a\nb"),
        ("<main><p>in</p></main><p>out</p>", "in"), ("<main>m<article>a</article></main>", "m\na"), ("<div role=navigation>no</div><div role=main>yes</div>", "yes"),
        ("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>", "one\ntwo\nx\ny"), ("<p>cut <a href='x", "cut"), ("<!-- <p>no</p> --><p title='a>b'>yes", "yes"),
        ("<article><header><h1>kept</h1></header><p>x</p></article>", "kept\nx"), ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"),
        ("<p>a<span class='share-buttons'>no</span>b</p>", "a b"), ("<textarea>no</textarea><noscript>no</noscript><title>no</title>yes", "yes"), ("<script>never closed", ""),
        ("<div class='cookie-notice'>no</div><div class='ArticleBody'>yes</div><p>no</p>", "yes"), ("<P>A</P><DIV CLASS=\"SideBar\">no</DIV>", "A"), ("</p></div><p>ok</b></p>", "ok"),
        # a word of class or id, a form or a header that surrounds the content doesn't blank it
        ("<div class='site has-sidebar'><article><p>x y</p></article></div>", "x y"), ("<div id='content-with-menu'><article>x y</article></div>", "x y"),
        ("<main><p>intro</p><article>a</article><p>outro</p></main>", "intro\na\noutro"), ("<article>teaser</article><div class='post-content'><p>the long story</p></div>", "teaser\nthe long story"),
        ("<article class='post comments-open'>x</article>", "x"), ("<form id=aspnet><div>menu</div><article><p>whole site in a form</p></article></form>", "whole site in a form"),
        ("<section class='story social-policy'><p>only text</p></section>", "only text"), ("<div class=sidebar-first><p>all the text there is</p></div>", "all the text there is"),
        ("<article><p>short</p></article><section class=comments><article class=comment><p>a reader says very much more than the article does, at length</p></article></section>", "short"),
        ("<article><p>let <math><mi>x</mi></math> be</p><svg><text>label</text></svg></article>", "let x be\nlabel"), ("<article><p>a</p><aside><article>b</article></aside></article>", "a"),
        ("<p>" + "<i>" * 3000 + "deep", "deep"), ("<p " + "a='" * 500 + ">x", "x"),
    ],
)
def test_page_text(html, expected):
    assert w.page_text(html) == expected


def test_tree_matching_is_maximal():
    a = [(-1, "r"), (0, "x"), (0, "y"), (2, "p"), (0, "z")]
    b = [(-1, "r"), (0, "y"), (1, "q"), (1, "p"), (0, "w"), (0, "z")]
    assert tree_matching(a, b) == [0, -1, 1, 3, 5] and tree_matching(a, a) == [0, 1, 2, 3, 4] and tree_matching([(-1, "s")], a) == [-1]
    shape, node = folded(Page("<ul><li>a<li>b<li><p>c</ul>"))
    assert [s for _, s, _ in shape] == ["#page", "ul", "li", "p"] and node == [0, 1, 2, 2, 2, 3]


def classic_matching(a, b):
    """Size of the largest matching by the textbook recursion over all pairs of siblings."""
    kids = [[[k for k, n in enumerate(t) if n[0] == p] for p in range(len(t))] for t in (a, b)]

    def size(i, j):
        if a[i][1] != b[j][1]:
            return 0
        one, two = kids[0][i], kids[1][j]
        m = [[0] * (len(two) + 1) for _ in range(len(one) + 1)]
        for x in range(len(one)):
            for y in range(len(two)):
                m[x + 1][y + 1] = max(m[x][y + 1], m[x + 1][y], m[x][y] + size(one[x], two[y]))
        return m[-1][-1] + 1

    return size(0, 0)


def test_tree_matching_equals_the_textbook(monkeypatch):
    import random

    r = random.Random(5)
    for _ in range(300):
        trees = []
        for _ in range(2):
            tree, used = [(-1, "r", 0)], {(-1, "r")}
            for _ in range(r.randrange(9)):
                key = (r.randrange(len(tree)), r.choice("abcd"))
                if key not in used:
                    used.add(key)
                    tree.append((*key, 0))
            trees.append(tree)
        a, b = trees
        got = tree_matching(a, b)
        met = [(k, x) for k, x in enumerate(got) if x >= 0]
        assert len(met) == classic_matching(a, b)
        assert all(a[k][1] == b[x][1] and (k == 0 or got[a[k][0]] == b[x][0]) for k, x in met)
        assert all((k < q) == (x < y) for k, x in met for q, y in met if a[k][0] == a[q][0] and k != q)


def test_very_large_and_deep_pages_take_linear_time():
    wide = "".join(f"<div class={'x' * (1 + k % 50)}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}><p>t{k}</p></div>" for k in range(10_000))
    tree = w.page_blocks(wide)[0]
    assert len(tree) == 20_001 and tree_matching(tree, tree) == list(range(len(tree)))
    deep = "<div>" * 5000 + "<b>" * 5000 + "<p>x</p>" * 2000 + "</i>" * 5000
    assert w.page_text(deep).split("\n") == ["x"] * 2000


def test_without_any_mark_the_same_nodes_are_content(spark):
    """Marks taken off every node of real hosts: alignment and density find the same articles as the pages' own marks."""
    from collections import Counter, defaultdict

    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()
    hosts = defaultdict(list)
    for row in rows:
        hosts[w._host(row.url)].append(w.page_blocks(row.html))
    for parsed in hosts.values():
        if len(parsed) < 3:
            continue
        assert len({w._shape(p[0]) for p in parsed}) == 1
        tree = parsed[0][0]
        each = {tuple(f.items()): f for f in (w.node_figures(p[1], p[2]) for p in parsed)}.values()
        figures = {}
        for n in range(len(tree)):
            own = [f[n] for f in each if n in f]
            if own:
                figures[n] = (len(own), max(Counter(x[0] for x in own).values()), sum(x[1] for x in own) / len(own), sum(x[2] for x in own) / len(own))
        content, template = w.decided([(p, s, 0) for p, s, _ in tree], figures, w.Evidence())
        article = next(n for n, (_, s, _) in enumerate(tree) if s == "article")
        inside = {n for n in range(len(tree)) if n == article or tree[n][0] == article}
        assert inside <= set(content) and not {n for n in content if n not in inside and n in figures}
        assert {tree[n][1] for n in template} >= {"style"} or len(each) < 3


def test_template_equals_a_count_by_hand(spark):
    """Template nodes of a small host against a plain loop over paths."""
    import json
    from collections import Counter, defaultdict

    rows = [(k, "http://h.example/" + str(k), layout(f"text {k} " * (k + 1), k, "<ul class=links><li><a>Home</a></ul>")) for k in range(7)]
    texts = defaultdict(list)
    for _, _, html in rows:
        tree, blocks, _ = w.page_blocks(html)

        def path(n):
            return () if n < 0 else (*path(tree[n][0]), tree[n][1])

        for n in {b[0] for b in blocks}:
            texts[path(n)].append("|".join(b[2] for b in blocks if b[0] == n))
    expected = {p for p, t in texts.items() if len(t) >= 3 and max(Counter(t).values()) > len(t) / 2}
    shapes, _ = w.slots(pages(spark, rows))
    found = {r.shape: r.template for r in w.induced(pages(spark, rows)).collect()}
    for r in shapes.collect():
        tree = json.loads(r.tree)
        got = set()
        for n in found[r.shape]:
            at, p = n, ()
            while at >= 0:
                p, at = (tree[at][1], *p), tree[at][0]
            got.add(p)
        assert got == expected and got


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def layout(body, k, extra=""):
    return f"<html><body><div class=top>Welcome to the site</div>{extra}<div class=story><p>{body}</p><p>more of {k}</p></div><div class=end>All rights reserved</div></body></html>"


@pytest.mark.parametrize("broadcast", [8 << 20, -1])
def test_constant_nodes_are_template(spark, monkeypatch, broadcast):
    monkeypatch.setattr(w, "BROADCAST_BYTES", broadcast)
    rows = [(k, f"http://Host.example/{k}", layout(f"text {k}", k, "<div class=x>odd</div>" if k == 3 else "")) for k in range(6)]
    rows += [(10 + k, "http://host.example:80/x", layout("lone", k)) for k in range(1)] + [(20, None, "<p>a</p>"), (21, "http://host.example/z", None)]
    got = {r.page_id: r.text for r in w.main_text(pages(spark, rows)).collect()}
    assert all(got[k] == (f"odd\ntext {k}\nmore of {k}" if k == 3 else f"text {k}\nmore of {k}") for k in range(6))
    assert got[10] == "Welcome to the site\nlone\nmore of 0\nAll rights reserved" and got[20] == "a" and got[21] == ""


def test_copies_do_not_make_a_template(spark):
    same = layout("copied", 1)
    rows = [(k, "http://a.example/x", same) for k in range(50)] + [(99, "http://a.example/y", layout("other", 2))]
    got = {r.page_id: r.text for r in w.main_text(pages(spark, rows)).collect()}
    assert got[7] == "Welcome to the site\ncopied\nmore of 1\nAll rights reserved" and got[99].startswith("Welcome")


def test_marked_articles_need_strong_evidence(spark):
    page = "<article><h1>Daily</h1><p>text {k}</p></article>"
    few = [(k, "http://few.example/", page.replace("{k}", str(k))) for k in range(8)]
    many = [(100 + k, "http://many.example/", page.replace("{k}", str(k))) for k in range(30)]
    got = {r.page_id: r.text for r in w.main_text(pages(spark, few + many)).collect()}
    assert got[3] == "Daily\ntext 3" and got[103] == "text 3"


def test_columns_and_empty_table(spark):
    df = pages(spark, [(1, "u", "<p>x &amp;  y</p>"), (1, "u", "<p>x &amp;  y</p>")]).selectExpr("*", "'t' AS text", "7 AS shape", "8 AS host", "9 AS node")
    rows = w.main_text(df).collect()
    assert len(rows) == 2 and rows[0].asDict() == {"page_id": 1, "url": "u", "shape": 7, "host": 8, "node": 9, "text": "x & y", "n_chars": 5}
    assert w.main_text(pages(spark, [])).collect() == []


def texts(spark, body, n=12, wrap="<html><body><div class=top>Welcome to the site</div>{}<div class=end>All rights reserved</div></body></html>"):
    rows = [(k, f"http://one.example/{k}", wrap.format(body(k))) for k in range(n)]
    return {r.page_id: r.text for r in w.main_text(pages(spark, rows)).collect()}


def test_only_the_common_text_of_a_slot_goes(spark):
    body = lambda k: f"<div class=story><div class=summary>{'Warm' if k % 4 == 3 else 'No change.'}</div><p>text {k} goes on for a while</p></div>"
    got = texts(spark, body)
    assert all(t == ("Warm\n" if k % 4 == 3 else "") + f"text {k} goes on for a while" for k, t in got.items())


def test_lists_of_links_that_vary_stay(spark):
    body = lambda k: f"<div class=post-content><p>story {k} is told here</p><h2>References</h2><ul><li><a href=a{k}>paper {k}</a><li><a href=b{k}>another of {k}</a></ul></div>"
    got = texts(spark, body, 8)
    assert all(t == f"story {k} is told here\nReferences\npaper {k}\nanother of {k}" for k, t in got.items())


def test_words_give_way_to_what_a_host_shows(spark):
    body = lambda k: f"<article><section class=cookies><h2>How to bake cookies, part {k}</h2><p>flour {k}</p></section><p>rest {k}</p><div class=comment-policy-change>The policy of {k}</div><div class=cookie-bar>We use cookies</div></article>"
    got = texts(spark, body, 14)
    assert all(t == f"How to bake cookies, part {k}\nflour {k}\nrest {k}\nThe policy of {k}" for k, t in got.items())
    heads = texts(spark, lambda k: f"<div class=story><header><h1>Title {k}</h1></header><p>long text of {k}</p></div>")
    assert all(t == f"Title {k}\nlong text of {k}" for k, t in heads.items())


@pytest.mark.parametrize("token, soft", [("comment-policy-change", False), ("comment-list", True), ("cookie-banner-wrapper", True), ("policy-comments", True), ("ads", True), ("loads", False), ("AdSlotLabel", True)])
def test_names_of_elements(token, soft):
    from palimpsest.llm.dom import SOFT, marks_of, words_of

    assert bool(marks_of("div", "", [words_of(token)]) & SOFT) is soft


@pytest.mark.parametrize("seed", range(3))
def test_induction_against_plain_rules(spark, seed):
    """Random hosts of one layout: every slot by itself, from the texts that all pages have in it."""
    import random
    from collections import Counter

    r = random.Random(seed)
    names = ["a", "b", "c", "d", "e", "f"]
    same = {x: r.choice([0.0, 0.2, 0.7, 1.0]) for x in names}
    n = r.randint(4, 9)
    values = [{x: (f"common {x}" if r.random() < same[x] else f"own {x} {k}") for x in names} for k in range(n)]
    wrap = "<html><body><main>{}</main></body></html>"
    rows = [(k, "http://r.example/", wrap.format(f"<p>page {k} itself</p>" + "".join(f"<section class=s{x}>{v[x]}</section>" for x in names))) for k, v in enumerate(values)]
    evidence = {"sure_share": 0.5, "sure_pages": 3}
    got = {x.page_id: x.text for x in w.main_text(pages(spark, rows), **evidence).collect()}
    for k, v in enumerate(values):
        lines = [f"page {k} itself"]
        for x in names:
            text, count = Counter(u[x] for u in values).most_common(1)[0]
            if not (count >= 0.5 * n and v[x] == text):
                lines.append(v[x])
        assert got[k] == "\n".join(lines)
