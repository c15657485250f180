"""Templates of sites against counts of plain trees, and pages nested without bound."""

import random
import time
from collections import Counter, defaultdict

import pytest

from opsmetrics.llm import html_text


@pytest.mark.parametrize("html", [
    "<b>" * 100_000 + "</h9>" * 100_000 + "x",
    "<b>" * 100_000 + "<h1>" * 100_000 + "x",
    "<p><b>" * 50_000 + "<li>" * 100_000 + "x",
    "<div " + "a" * 200_000 + " class=b>x",
    "<a title=\"" * 100_000 + "\">x",
])
def test_nested_pages_cost_what_they_close(html):
    begin = time.process_time()
    text = html_text.main_text(html)
    assert text.endswith("x")
    assert time.process_time() - begin < 10


def test_open_elements_end_as_the_standard_says():
    text = html_text.main_text
    assert text("<p>one<div>two</div>three") == "one\ntwo\nthree"
    assert text("<p>one<table><td>two<p>three</table>four") == "one\ntwo\nthree\nfour"
    assert text("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul>") == "a\nb\nc\nd\ne"
    assert text("a</p></div><b>b</i></b>c") == "abc"
    assert text("<nav>x</p>y</nav>z<p>in<script>1 < 2</script> on") == "z\nin on"


SHARED = [("div", [f"notice {i}", ("p", [f"more of {i}"])]) for i in range(6)]
MENU = ("nav", ["menu", ("ul", [("li", ["home"]), ("li", ["news"])])])


def html_of(node):
    if isinstance(node, str):
        return node
    return f"<{node[0]}>{''.join(map(html_of, node[1]))}</{node[0]}>"


def plain_subtrees(node):
    """Each element, listed ones too; a listed one is no part of the elements around it."""
    if isinstance(node, str):
        return []
    return [bare(node)] + [s for c in node[1] for s in plain_subtrees(c)]


def bare(node):
    return (node[0], tuple(c if isinstance(c, str) else bare(c) for c in node[1]
                           if isinstance(c, str) or c[0] != "nav"))


def plain_blocks(node, templates):
    """Text blocks of what is neither listed nor a template."""
    if bare(node) in templates or node[0] == "nav":
        return []
    out = []
    for child in node[1]:
        out += [child] if isinstance(child, str) else plain_blocks(child, templates)
    return out


def test_templates_match_counts_of_plain_trees(spark):
    random.seed(3)
    pages = []
    for i in range(120):
        host = random.choice(["a.org"] * 6 + ["b.org", "c.org"])
        body = [MENU] if random.random() < 0.8 else []
        body += [node for k, node in enumerate(SHARED) if random.random() < 0.15 * (k + 1)]
        body.append(("article", [("p", [f"own {random.randrange(60)}"]),
                                 *random.sample(SHARED, 1), ("p", ["end"])]))
        pages.append((i, host, random.choice(["", "s/", "t/"]), ("div", body)))
    # Pages of one main text count once, so the plain counts take main texts that occur once.
    alone = [k for k, n in Counter(
        (host, folder, tuple(plain_blocks(tree[1][-1], set())))
        for _, host, folder, tree in pages).items() if n == 1]
    chosen = [p for p in pages if (p[1], p[2], tuple(plain_blocks(p[3][1][-1], set()))) in alone]
    counts, totals = defaultdict(Counter), Counter()
    for _, host, folder, tree in chosen:
        for site in {host, f"{host}/{folder}" if folder else host}:
            totals[site] += 1
            counts[site].update(set(plain_subtrees(tree)))
    expected = {site: {s for s, n in counts[site].items()
                       if n >= 3 and n >= min(10, totals[site]) and n >= 0.5 * totals[site]}
                for site in totals}
    rows = spark.createDataFrame(
        [(host, f"{host}/{folder}" if folder else host, html_of(tree))
         for _, host, folder, tree in chosen], "host string, site string, html string")
    found = Counter(r.site for r in html_text.site_templates(rows).collect())
    assert found == Counter({site: len(s) for site, s in expected.items() if s})
    assert len(found) > 2

    table = spark.createDataFrame(
        [(i, f"http://{host}/{folder}{i}", html_of(tree)) for i, host, folder, tree in chosen],
        "page_id bigint, url string, html string")
    texts = {r.page_id: r for r in html_text.extract_text(table).collect()}
    for i, host, folder, tree in chosen:
        gone = expected[host] | (expected[f"{host}/{folder}"] if folder else set())
        article = tree[1][-1]
        assert texts[i].text == "\n".join(plain_blocks(article, gone))
        assert texts[i].n_listed == (12 if MENU in tree[1] else 0)
    menu = {i for i, host, _, tree in chosen if MENU in tree[1] and bare(MENU) in expected[host]}
    assert menu and all(texts[i].n_template >= 12 for i in menu)


def test_removed_texts_are_counted_for_both():
    html = "<nav>menu</nav><article><div>notice</div><p>own</p></article>"
    values = {e.tag: v for e, v in html_text.subtrees(html_text.parse(html))}
    assert html_text.article(html) == ("notice\nown", 4, 0)
    assert html_text.article(html, {values["nav"], values["div"]}) == ("own", 4, 10)
    alone = "<nav>menu</nav>" + "<p>own</p>"
    assert html_text.article(alone, {values["nav"]}, lists=False) == ("own", 4, 4)
    assert html_text.article("") == ("", 0, 0)
