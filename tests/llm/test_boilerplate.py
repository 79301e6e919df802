import random
from collections import defaultdict

import numpy as np
import pytest
from llm_support import llm  # noqa: F401

from shoal.llm.boilerplate import HEAD, main_text, suffix_places
from shoal.llm.common import WordHashes, hash_words
from shoal.llm.html_blocks import ARTICLE, OPEN, SHUT, parse

SCHEMA = "page_id long, url string, html string, text string, host string, tokens int"


def pages(llm, rows):
    return llm.createDataFrame([(i, u, h, "x", "y", 1) for i, u, h in rows], SCHEMA)


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


ARTICLES = [
    ("<article><h1>A &amp; B</h1><p>one\n  two<br>three</p><p><b>x</b>y</article>", "A & B\n\none two three\n\nxy"),
    ("<nav>m</nav><article><p>a</p><div class='ad'>buy</div><p>b<aside>s</aside>c</article><footer>f", "a\n\nb\n\nc"),
    ("<div id=comments><article class=comment>no</article></div><article>yes<div class='comment-list'>no</div></article>", "yes"),
    ("<article><header><h1>T</h1></header><form><p>mail</p></form>end<footer>by</footer></article>", "T\n\nend"),
    ("<nav><ul><li>left open<article>in</article>", "in"),
    ("<main><p>m</p><article>a</article></main>", "a"),
    ("<main><p>m</p><p hidden>h</p></main><p>out</p>", "m"),
    ("<body class='has-sidebar menu'><article>a<script>var x='<p>no</p>';</script><style>p{}</style>b</article>", "ab"),
    ("<article>1 < 2 &lt;b&gt; &#233;&eacute;&nbsp;z &amp;amp; &am</article>", "1 < 2 <b> éé z &amp; &am"),
    ("<title>t</title><article><!-- c > <p>no</p> -->a<p class='x>y'>b</p></article>", "a\n\nb"),
    ('<article><p class="x>b</p><p>c</p></article>', "b\n\nc"),
    ("<p class=notice>n<p>kept", "kept"),
    ("", ""),
    (None, ""),
    ("<article></article>", ""),
    ("<ul><li><a href=/x>link</a></ul><p>text", "text"),
    ("no markup at all", "no markup at all"),
]


@pytest.mark.parametrize("by_url", [False, True])
def test_articles(llm, by_url):
    rows = [(k, f"http://h{k}/" if by_url else None, h) for k, (h, _) in enumerate(ARTICLES)]
    rows += rows[:2]
    got = main_text(pages(llm, rows)).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.text for r in got} == {k: t for k, (_, t) in enumerate(ARTICLES)}
    assert all(r.n_chars == len(r.text) for r in got)
    assert main_text(pages(llm, [])).collect() == []


def test_zones_and_tokens():
    page = parse("<nav><a>m</a></nav><div>o</div><article>a b</article>")
    assert list(zip(page.texts, page.zones, page.linked)) == [("m", SHUT, True), ("o", OPEN, False), ("a b", ARTICLE, False)]
    assert page.tokens[page.starts[2] :] == ["</div", "<article", "a", "b"]


def test_odd_markup_takes_linear_time():
    for piece in ("<", "<a", "<a '", '<p class="', "<!-- ", "</", "<script>", "<p>" * 3 + "</div>", "<div></p>", "<div class=ad><article>"):
        parse(piece * 100_000 + ">")


def _word(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def site(seed, n=40):
    """Pages without an article: a menu, a notice, own paragraphs, a foot, of three hosts and two templates."""
    rng = random.Random(seed)
    rows, want = [], {}
    for host in range(3):
        menus = [_word(rng, 14) for _ in range(2)]
        notice, foot = _word(rng, 12), _word(rng, 20)
        for k in range(n if host == 0 else 6):
            own = [_word(rng, rng.randrange(10, 60)) for _ in range(4)]
            i = len(rows)
            rows.append((i, f"https://h{host}.example/{k}", f"<div>{menus[k % 2]}</div><div>{notice}</div>" + "".join(f"<p>{p}</p>" for p in own) + f"<div>{foot} page {k}</div>"))
            want[i] = "\n\n".join(own)
    return rows, want


def test_unique_runs_stay_and_repeated_ones_go(llm):
    rows, want = site(1)
    # An exact copy repeats nothing; a page of its own host keeps everything.
    rows += [(100, "https://h0.example/copy", rows[0][2]), (101, "https://alone.example/", rows[0][2])]
    got = texts(main_text(pages(llm, rows)))
    assert {k: got[k] for k in want} == want
    assert got[100] == want[0] and got[101].count("\n\n") == 6


def test_a_page_that_copies_all_keeps_its_text(llm):
    body = "".join(f"<p>{_word(random.Random(k), 30)}</p>" for k in range(4))
    rows = [(0, "http://h/a", body), (1, "http://h/b", body + "<p>more</p>"), (2, "http://h/c", body + "<div></div>")]
    got = texts(main_text(pages(llm, rows)))
    assert got[0] == got[2] and got[0].count("\n\n") == 3


def test_places_find_every_long_repeat():
    rng = np.random.default_rng(2)
    known = WordHashes()
    for _ in range(40):
        shared = [b"s%d" % k for k in rng.integers(0, 50, int(rng.integers(16, 40)))]
        streams, at = [], []
        for _ in range(2):
            left = [b"l%d" % k for k in rng.integers(0, 10**6, int(rng.integers(0, 30)))]
            right = [b"r%d" % k for k in rng.integers(0, 10**6, int(rng.integers(0, 30)))]
            streams.append(left + shared + right)
            at.append(len(left))
        heads = defaultdict(set)
        for n, s in enumerate(streams):
            for p in suffix_places(hash_words(s, known), np.array([0])):
                heads[tuple(s[p : p + HEAD])].add((n, p - at[n]))
        assert any(len({n for n, _ in v}) == 2 for v in heads.values())


def test_articles_count_among_what_a_host_repeats(llm):
    """The streams are whole pages: a passage that another page of the host has in its article is repeated."""
    rng = random.Random(5)
    passage, own = _word(rng, 40), _word(rng, 30)
    rows = [(0, "http://h/a", f"<nav>{_word(rng, 9)}</nav><article><p>{passage}</p><p>{_word(rng, 20)}</p></article>")]
    rows += [(1, "http://h/b", f"<div>{passage}</div><p>{own}</p>"), (2, "http://other/b", f"<div>{passage}</div><p>{own}</p>")]
    got = texts(main_text(pages(llm, rows)))
    assert got[0].startswith(passage) and got[0].count("\n\n") == 1
    assert got[1] == own and got[2] == f"{passage}\n\n{own}"


def test_repeated_heads_are_found_across_batches(llm):
    from shoal.llm.boilerplate import repeated_heads

    rng = random.Random(3)
    rows = [(rng.randrange(3), 0, rng.randrange(12)) for _ in range(60)] + [(7, 0, 50)] * 9 + [(8 + k // 5, 0, 51) for k in range(9)]
    pages_of, want = defaultdict(set), defaultdict(set)
    for p1, _, h in rows:
        pages_of[h].add(p1)
    for p1, _, h in rows:
        if len(pages_of[h]) > 1:
            want[p1].add(h)
    before = llm.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 2, 3, 100):
            llm.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            table = llm.createDataFrame([(a, b, [h]) for a, b, h in rows], "p1 long, p2 long, heads array<long>")
            got = repeated_heads(table.repartition("heads"))
            assert {r.p1: set(r.heads) for r in got.collect()} == dict(want)
    finally:
        llm.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
