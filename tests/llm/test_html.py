import pytest

from sparkpanel.llm import op7_html as op7

P = "<p>" + "Lorem ipsum dolor sit amet. " * 8 + "</p>"
TEXT = ("Lorem ipsum dolor sit amet. " * 8).strip()


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        ("<p>a &lt;b&gt; c&nbsp;d<br>e &#233;&amp;</p>", "a <b> c d e é&"),
        ("<p>tail <a hre", "tail"),
        ("<!-- never ends", ""),
        ("<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav>" + P + P + "<footer>f</footer></body></html>", TEXT + "\n" + TEXT),
        ("<body><div class='cookie-notice'>" + P + "</div><article><h1>Head</h1>" + P + "<p>Short.</p><div class='comments'>" + P + "</div></article><aside>" + P + "</aside></body>", "Head\n" + TEXT + "\nShort."),
        ("<body><article><p><b>Bold line.<br><p>" + TEXT + "</p></article>", "Bold line.\n" + TEXT),
        ("<body><header><h1>Site</h1></header><main><header><h2>Own</h2></header>" + P + "<form><p>mail</p></form></main></body>", "Own\n" + TEXT),
        ("<body><div id=menu><ul><li><a href=a>A</a><li><a href=b>B</a></ul></div><div class=content><h2>Q</h2>" + P * 3 + "<ul><li>one<li>two</ul></div></body>", "Q\n" + "\n".join([TEXT] * 3) + "\none\ntwo"),
        ("<body><div class='content-sidebar-wrap'><div class=content>" + P + P + "</div><div class=sidebar>" + P + "</div></div></body>", TEXT + "\n" + TEXT),
        ("<body><div class=advertBox>" + P + "</div><div class=mainText>" + P + "</div><section id=userComments><article>" + P + "</article></section></body>", TEXT),
        ("<body><p hidden>no</p><p style='display: none'>no</p>" + P + "</body>", TEXT),
    ],
)
def test_text(html, text):
    assert op7.main_text(html) == text


def test_densities_prefer_text_to_links():
    page = op7.Page("<body><div>" + "<a href=x>some link text</a> " * 20 + "</div><div>" + P * 3 + "</div></body>")
    density, _ = page.densities()
    links, body = (k for k, t in enumerate(page.tag) if t == "div")
    assert density[body] > 3 * density[links]
    assert page.text() == "\n".join([TEXT] * 3)


def test_frame(spark):
    data = [(1, "u", "<p>é 1</p>", "x"), (1, "u", "<p>é 1</p>", "x"), (None, None, None, "x"), (2, "v", "<div>" * 3000 + "deep", "x"), (3, "w", "<p>" + "long words " * 200_000, "x")]
    frame = spark.createDataFrame(data, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text[:8], r.n_chars) for r in op7.extract(frame).collect()), key=repr)
    assert got == sorted([(1, "u", "é 1", 3), (1, "u", "é 1", 3), (None, None, "", 0), (2, "v", "deep", 4), (3, "w", "long wor", 2_199_999)], key=repr)
    assert op7.extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    "html, text",
    [
        ("<body><div class='social-history'>" + P * 5 + "</div><div><p>Other small words here.</p></div></body>", "\n".join([TEXT] * 5)),
        ("<body><div class='post has-sidebar'>" + P * 4 + "</div><p>one line</p></body>", "\n".join([TEXT] * 4)),
        ("<body><article><h1>H</h1>" + P + "<div class='share social'><p>Tell others</p></div>" + P + "</article></body>", f"H\n{TEXT}\n{TEXT}"),
        ("<body><main><article>" + P * 3 + "</article><ul>" + "<li><a href=x>Some other story</a></li>" * 6 + "</ul></main></body>", "\n".join([TEXT] * 3)),
        ("<body><main><h1>T</h1>" + P * 3 + "<ul>" + "<li><a href=x>Some other story</a></li>" * 6 + "</ul></main></body>", "T\n" + "\n".join([TEXT] * 3)),
        ("<body><main><article>" + P * 3 + "</article><article>" + P * 2 + "</article><article><a href=x>Teaser</a></article></main></body>", "\n".join([TEXT] * 5)),
        ("<body><div class='related-links'>" + "<a href=x>Some other story</a> " * 9 + "</div><div>" + P * 3 + "</div></body>", "\n".join([TEXT] * 3)),
        ("<body><main><div id='menu-recipe'>" + P + "</div><p>one line</p></main></body>", TEXT + "\none line"),
        ("<body><main><p class='ad-hoc'>" + TEXT + "</p><p>one line</p></main></body>", TEXT + "\none line"),
        ("<body><div class='share-this'>" + P * 3 + "</div><p>one line</p></body>", "\n".join([TEXT] * 3)),
        ("<body><div class=story>" + P * 2 + "<p>one line</p><div class='ad-box'>" + P + "</div><div class=comments>" + P * 30 + "</div></div></body>", "\n".join([TEXT] * 2) + "\none line"),
        ("<body><article><p>See <a href=x>one</a>, <a href=y>two</a> and <a href=z>three</a>, which say more.</p>" + P + "</article></body>", "See one, two and three, which say more.\n" + TEXT),
    ],
)
def test_names_and_lists_weigh(html, text):
    assert op7.main_text(html) == text


@pytest.mark.parametrize("html", ["<div>" * 200_000 + "deep", "<p>deep" + "<b>" * 100_000 + "</i>" * 100_000, "<table><tr><td>" * 60_000 + "deep", "<div>" * 100_000 + "deep" + "</p>" * 100_000])
def test_time_is_linear_in_nesting(html):
    import time

    began = time.process_time()
    assert op7.main_text(html) == "deep"
    assert time.process_time() - began < 10  # a walk of the stack for each tag takes minutes


class Naive:
    """Densities, core and selection by their definitions, over a tree of (tag, parts) with text or trees as parts."""

    def __init__(self, root):
        self.root = root
        self.chars_of = lambda node, link=False: sum((len(x.strip()) if link else 0) if isinstance(x, str) else self.chars_of(x, link or x[0] == "a") for x in node[1])
        self.all_of = lambda node: sum(len(x.strip()) if isinstance(x, str) else self.all_of(x) for x in node[1])
        self.tags_of = lambda node, tag=None: sum((tag in (None, x[0])) + self.tags_of(x, tag) for x in node[1] if not isinstance(x, str))
        self.share = self.chars_of(root) / max(1, self.all_of(root))

    def density(self, node, link=False):
        import math

        c = self.all_of(node)
        lc = c if link or node[0] == "a" else self.chars_of(node)
        t, lt = max(1, self.tags_of(node)), max(1, self.tags_of(node, "a"))
        if not c:
            return 0.0
        base = max(math.e, math.log(c / max(1, c - lc) * lc + self.share * c + math.e))
        return c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(base)

    def total(self, node):
        return sum(self.density(x, node[0] == "a") for x in reversed(node[1]) if not isinstance(x, str))

    def best(self, node):
        found = node
        for x in reversed(node[1]):
            if not isinstance(x, str) and self.total(self.best(x)) > self.total(found):
                found = self.best(x)
        return found

    def nodes(self, node):
        yield node
        for x in node[1]:
            if not isinstance(x, str):
                yield from self.nodes(x)

    def path(self, node, to):
        if node is to:
            return [node]
        for x in node[1]:
            if not isinstance(x, str) and (rest := self.path(x, to)):
                return [node, *rest]
        return []

    def blocks(self):
        core = self.best(self.root)
        threshold = min(self.density(x) for x in self.path(self.root, core))
        kept = {id(y) for x in self.nodes(self.root) if self.density(x) >= threshold and self.density(x) > 0 for y in self.nodes(self.best(x))}
        return [x[1][0] for x in self.nodes(self.root) if x[0] == "p" and id(x) in kept]


@pytest.mark.parametrize("seed", range(30))
def test_selection_against_its_definition(seed):
    import random

    rng = random.Random(seed)

    def grown(depth):
        if depth == 0 or rng.random() < 0.4:
            text = " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.choice([1, 4, 30, 80])))
            return ("p", [text]) if rng.random() < 0.7 else ("div", [("a", [text])])
        return ("div", [grown(depth - 1) for _ in range(rng.randint(1, 4))])

    spelled = lambda node: node if isinstance(node, str) else f"<{node[0]}>{''.join(spelled(x) for x in node[1])}</{node[0]}>"
    tree = ("html", [("body", [grown(4) for _ in range(3)])])
    page = op7.Page(spelled(tree[1][0]))
    page.hinted = page.named = [False] * len(page.tag)
    naive = Naive(tree)
    density, _ = page.densities()
    assert density == pytest.approx([naive.density(x, False) if x[0] != "a" else naive.density(x, True) for x in naive.nodes(tree)])
    marked = page.selected()
    texts = {node: text for node, _, text in page.segments}
    got = [texts[k] for k in range(len(marked)) if marked[k] and page.tag[k] == "p"]
    lists = {k for k in range(len(page.tag)) if page.dead[k]}
    if not lists:  # lists of links go besides
        assert got == naive.blocks()


def test_precision_and_recall_over_layouts():
    """Words of the article found, over pages of many layouts whose article is known."""
    import collections
    import random

    rng = random.Random(4)
    say = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}" for _ in range(n))
    hit = found = there = 0
    for k in range(300):
        body = [("h1", say(6))] + [(rng.choice(["p", "p", "p", "h2", "li", "blockquote"]), say(rng.choice([3, 12, 40, 90]))) for _ in range(rng.randint(3, 14))]
        inner = "".join(f"<ul><li>{t}</li></ul>" if tag == "li" else f"<{tag}>{t}</{tag}>" for tag, t in body)
        inner = inner.replace("</p>", f"</p><div class='{rng.choice(['share', 'ad', 'newsletter-signup', 'promo'])}'><p>{say(6)}</p></div>", 1)
        links = "".join(f"<li><a href=/{j}>{say(3)}</a></li>" for j in range(8))
        open_, close = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post has-sidebar'>", "</div>"), ("<div id=content><div class=entry>", "</div></div>"), ("<section>", "</section>"), ("<main><article class=story>", "</article></main>")])
        around = [f"<nav><ul>{links}</ul></nav>", f"<div class=menu><ul>{links}</ul></div>", f"<header><p>{say(5)}</p></header>", f"<div id='cookie-banner'><p>{say(25)}</p></div>"]
        after = [f"<aside>{say(40)}</aside>", f"<div class=sidebar><p>{say(60)}</p></div>", f"<section class=comments>{''.join(f'<article><p>{say(30)}</p></article>' for _ in range(6))}</section>", f"<footer>{say(15)}</footer>", f"<form><label>{say(4)}</label></form>", f"<div class=related><ul>{links}</ul></div>"]
        html = "<html><head><title>t</title></head><body>" + "".join(rng.sample(around, 3)) + open_ + inner + close + "".join(rng.sample(after, 4)) + "</body></html>"
        want = collections.Counter(" ".join(t for _, t in body).split())
        got = collections.Counter(op7.main_text(html).split())
        hit, found, there = hit + (want & got).total(), found + got.total(), there + want.total()
    print(f"precision {hit / found:.4f} recall {hit / there:.4f}")
    assert hit / found > 0.98 and hit / there > 0.98
