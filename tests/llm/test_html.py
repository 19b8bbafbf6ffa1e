import random

from pyspark.sql import functions as F

from contingo.llm import html as h


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randrange(12))] for _ in range(2))
        own = [a[i] for i in sorted(h.common_lines(a, b))]
        assert len(own) == lcs(a, b)
        it = iter(b)
        assert all(x in it for x in own)


def article(page):
    return "\n".join(t for t, p in h.page_lines(page) if p == h.ARTICLE)


def test_blocks_and_markup():
    page = """<html><head><title>no</title><style>p{}</style></head><body><header>no</header><nav><a>no</a></nav>
    <div class="ad">no</div><aside>no</aside><article class="post"><h1>Title &amp; more</h1><p>One  <b>bold</b>
    line<p>Two&nbsp;x &#228;<script>if (a < b) "</p>"</script><ul><li>a<li>b</ul><div class="comments"><p>no</div>
    <div id="share-bar">no</div><!-- <p>no</p> --><table><tr><td>1<td>2</table><form>no</form><p hidden>no</p>
    <div style="display:none">no</div></article><div role="complementary">no</div><footer>no</footer>"""
    assert article(page) == "Title & more\nOne bold line\nTwo x ä\na\nb\n1\n2"


def test_broken_markup():
    assert h.page_lines(None) == [] and h.page_lines("") == []
    assert article("<article><p>a<p>b</article") == "a\nb"
    assert article("<article><p>5 < 6 & 7 &am</p></div></article>") == "5 < 6 & 7 &am"
    assert article("<main><p>x</main><p>no") == "x"
    assert article("<article>" + "<div>" * 500 + "deep" + "</article>") == "deep"


FRAME = "<body><p>Menu of site</p>{}<p>All rights reserved</p></body>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_differencing_deletes_shared_lines(spark):
    rows = [(i, f"https://a.example/x/{i}", FRAME.format(f"<p>Own text {i}</p><p>More {i}</p>")) for i in range(40)]
    rows += [(100, "http://b.example/only", FRAME.format("<p>z</p>")), (101, None, None), (102, "", ""),
             (None, "https://c.example/1", "<p>q</p>"), (104, "https://d.example/1", FRAME.format("<p>same</p>")),
             (105, "https://d.example/1?x", FRAME.format("<p>same</p>")), (105, "https://d.example/1?x", FRAME.format("<p>same</p>"))]
    got = h.extract(pages(spark, rows).withColumn("path", F.lit(1)).withColumn("part", F.lit(2))).collect()
    text = {}
    for r in got:
        text.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    for i in range(40):
        assert text[i] == [f"Own text {i}\nMore {i}"]
    assert text[100] == ["Menu of site\nz\nAll rights reserved"]
    assert text[101] == [""] and text[102] == [""] and text[None] == ["q"]
    assert text[104] == ["Menu of site\nsame\nAll rights reserved"] and len(text[105]) == 2


def test_shared_article_lines_stay(spark):
    rows = [(i, f"https://a.example/{i}", f"<nav>n</nav><article><p>quoted line</p><p>own {i}</p></article>") for i in range(5)]
    assert {r.page_id: r.text for r in h.extract(pages(spark, rows)).collect()} == {i: f"quoted line\nown {i}" for i in range(5)}


def test_ranges_do_not_matter(spark):
    rows = [(i, f"https://h.example/p{i:03d}", FRAME.format(f"<p>Own {i}</p>" + f"<p>pair {i // 2}</p>")) for i in range(60)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("1", "7", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted((r.page_id, r.text) for r in h.extract(pages(spark, rows)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]
    assert h.extract(pages(spark, [])).count() == 0


def test_unshared_lines_outside_the_article_stay(spark):
    page = "<p>Menu</p><h1>Title {0}</h1><article><p>teaser {0}</p></article><div><p>body {0}</p></div><p>Rights</p><footer>f {0}</footer>"
    rows = [(i, f"https://a.example/{i}", page.format(i)) for i in range(5)]
    assert {r.page_id: r.text for r in h.extract(pages(spark, rows)).collect()} == {
        i: f"Title {i}\nteaser {i}\nbody {i}" for i in range(5)}


def test_ambiguous_names_and_formulas_inside_an_article(spark):
    page = """<article><div class="header">head {0}</div><section id="discussion"><p>talk {0}</p></section><h2 id="related-work">Work {0}</h2>
    <div class="social">Follow us</div><p>x <math><mi>y</mi></math> z<object>o {0}</object></p><noscript>n {0}</noscript>
    <div class="ad">no {0}</div><div class="comments">no {0}</div></article>"""
    rows = [(i, f"https://a.example/{i}", page.format(i)) for i in range(5)]
    assert {r.page_id: r.text for r in h.extract(pages(spark, rows)).collect()} == {
        i: f"head {i}\ntalk {i}\nWork {i}\nx y zo {i}\nn {i}" for i in range(5)}
