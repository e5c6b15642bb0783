"""Main text of pages: what repeats on a host goes, what is unique stays, articles are whole."""

import random
from collections import Counter, defaultdict

import pytest

from tallyforge.llm import main_text

SCHEMA = "page_id long, url string, html string, row int, text string, host string, block int, content string, main int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", "b", 2, "c", 3) for r in rows], SCHEMA).repartition(3)


def found(spark, rows):
    return {r.page_id: r.text for r in main_text.main_text(table(spark, rows)).collect()}


CASES = {
    "<article><h1>A &amp; B</h1><p>one\n  two<br>three&nbsp;four<p>five</article>": "A & B\none two three four\nfive",
    "<nav>menu</nav><article>x<nav>in</nav><div class='comments'><article>c</article></div><p class=ad>buy<p>y</article><footer>f</footer>": "x\ny",
    "<article><header><h2>Title</h2></header>t<footer>by</footer></article>": "Title\nt",
    "<form id=all><main>m</main><input value=v></form>": "m",
    "<script>var t='</p>';</script><style>p{}</style><main>a<!-- <p>no</p> -->b<script>c</script></main>": "ab",
    "<main>a < b &lt; c &#65;&#x42;&#0000000000000067; &am &amp</main>": "a < b < c ABC &am &",
    "<main>&#99999999999999; &#xD800; &bogus; x</main>": "� � &bogus; x",
    "<main><a title='a > b' href=\"x>y\">link</a> it's \"so\"</main>": "link it's \"so\"",
    "<main>cut <b>off": "cut off",
    "<main>seen<!-- never closed": "seen",
    "<main>seen<script>never closed": "seen",
    "<main>a<span class=share>S<span>h</span></span>b</main>": "ab",
    "<h1>Head</h1><article>body</article><h1>other</h1>": "Head\nbody",
    "<main><ul><li>a<li>b</ul><table><tr><td>c</td><td>d</td></tr></table><pre>e\n  f</pre></main>": "a\nb\nc d\ne f",
    "<main><div hidden>h</div><div aria-hidden=true>h</div><div style='display: none'>h</div>z</main>": "z",
    "<body class='with-sidebar'><div class='page no-sidebar'>only words</div></body>": "only words",
    "": "",
    None: "",
    "plain text": "plain text",
    "<DIV CLASS=AD>x</DIV><ARTICLE>y</ARTICLE>": "y",
}


@pytest.mark.parametrize("html", CASES, ids=range(len(CASES)))
def test_blocks(html):
    blocks = main_text.Reader(html or "").blocks
    main = [t for t, say, _ in blocks if say == main_text.MAIN]
    rest = [t for t, say, head in blocks if say == main_text.OPEN and (not main or head) and not (main and blocks.index((t, say, head)) > 1)]
    assert "\n".join(rest + main) == CASES[html]


def test_cases_through_spark(spark):
    rows = [(k, f"http://h{k}/", html) for k, html in enumerate(CASES)]
    assert found(spark, rows) == {k: text for k, text in enumerate(CASES.values())}


def say(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def soup(rng, article, ads):
    """A page without any telling element."""
    paragraphs = "".join(f"<div>{x}</div>" for x in article)
    return f"<div>Daily Paper of the Town and Country</div><div>Home</div><div>News</div><div>Sports</div><div>Contact us today</div>{paragraphs}<div>{rng.choice(ads)}</div><div>© Daily Paper, all rights reserved by us</div>"


def test_what_a_host_repeats_is_taken_away(spark):
    rng = random.Random(1)
    ads = [say(rng, 12) for _ in range(3)]
    articles = {k: [say(rng, 8), say(rng, 120), say(rng, 3)] for k in range(30)}
    rows = [(k, "https://paper.example/%d" % k, soup(rng, a, ads)) for k, a in articles.items()]
    rows += [(100 + k, "https://paper.example/copy%d" % k, rows[0][2]) for k in range(8)]  # copies are no boilerplate
    rows += [(200, "https://other.example/", rows[1][2])]  # of its host the only page
    got = found(spark, rows)
    for k, a in articles.items():
        assert got[k] == "\n".join(a)
    assert {got[100 + k] for k in range(8)} == {"\n".join(articles[0])}
    assert got[200].startswith("Daily Paper")


def brute_covered(pages):
    """Blocks in a substring of tokens, of LONG words or to its stream's end, on PAGES pages of a host with different content."""
    seen, spots = defaultdict(set), defaultdict(set)
    for row, host, content, blocks in pages:
        stream = [(*t, k) for k, b in enumerate(blocks) for t in main_text.tokens(b)]
        for a in range(len(stream)):
            b, words = a, 0
            while b < len(stream) and words < main_text.LONG:
                words += stream[b][1]
                b += 1
            key = host, tuple(t for t, _, _ in stream[a:b])
            seen[key].add(content)
            spots[key] |= {(row, k) for k in range(stream[a][2], stream[b - 1][2] + 1)}
    return set().union(*(s for key, s in spots.items() if len(seen[key]) >= main_text.PAGES))


def test_covered_blocks_against_brute_force(spark):
    rng = random.Random(7)
    lines = [say(rng, n) for n in (1, 1, 2, 3, 6, 9, 40, 90)]
    pages = [(k, rng.randrange(3), rng.randrange(12), [rng.choice([*lines, say(rng, 5)]) for _ in range(rng.randrange(9))]) for k in range(80)]
    rows = [(k, k, "u", h, c, False, "", [{"text": b, "says": 0, "headline": False, "after": 0} for b in blocks]) for k, h, c, blocks in pages]
    got = main_text.covered(spark.createDataFrame(rows, main_text._PARSED).repartition(5))
    assert {tuple(r) for r in got.collect()} == brute_covered(pages)


def test_repeated_rows_nulls_and_empty_tables(spark):
    rows = [(1, "http://a/", "<main>x</main>")] * 2 + [(None, None, None), (None, None, "<p>free words</p>")]
    got = main_text.main_text(table(spark, rows)).collect()
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in got) == Counter([(1, "http://a/", "x", 1)] * 2 + [(None, None, "", 0), (None, None, "free words", 10)])
    assert main_text.main_text(table(spark, [])).count() == 0


def test_long_and_broken_pages_take_time_in_proportion():
    for piece in ("<p>word ", "<b class='ad'>", "<a href=\"x", "&#", "<", "</", "<!", "<div>", "'=\"", "<ul><li>x"):
        main_text.Reader("<main>" + piece * 60_000).blocks  # noqa: B018
    text = "word " * 400_000
    assert main_text.Reader(f"<article><p>{text}</article>").blocks[0][0] == text.strip()


def test_repeats_are_found_wherever_they_begin_in_a_block(spark):
    rng = random.Random(11)
    notice = "printed by the Daily Paper of the Town and Country, all rights reserved"
    articles = {k: say(rng, 60) for k in range(4)}
    quote = say(rng, 7)  # in the middle of articles: the rest of those is unique
    pages = {k: f"<div>{a} {quote} {say(rng, 60)} end.</div>" for k, a in articles.items()}
    rows = [(k, f"http://paper.example/{k}", f"{p}<div>Issue {k} of week {k + 20}, {notice} - page {k + 7}</div>") for k, p in pages.items()]
    assert found(spark, rows) == {k: p[5:-6] for k, p in pages.items()}
