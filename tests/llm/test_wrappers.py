import json
import random
import time
from html.parser import HTMLParser

from plumbline.llm import queries, wrappers
from pyspark.sql import functions as F


def page(title, paragraphs, extra="", site="Menu"):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<html><head><title>{title}</title><style>p{{}}</style></head><body><header>{site}</header><nav><ul><li><a href='/'>Home</a><li><a href='/x'>{site}</a></ul></nav>{extra}<article><h1>{title}</h1>{body}</article><div class='comments'><p>nice post</p></div><footer>&copy; {site}</footer></body></html>"


def test_expression_has_groups_options_and_slots():
    one, two = (wrappers.lift(wrappers.parse(page(f"T{i}", ["a"] * i, "<div id='notice-1' class='n'>wait</div>" if i == 2 else ""))) for i in (1, 2))
    text = wrappers.expression(wrappers.merge(one, two))
    assert "(<p>TEXT</p>)+" in text or "(<p>'" in text
    assert "<h1>TEXT</h1>" in text and ")?" in text and "|" not in text


def test_pages(spark):
    cases = {
        1: (page("A &amp; B", ["first  line", "se<b>co</b>nd<br>part &lt;x&gt;"]), "A & B\nfirst line\nsecond part <x>"),
        2: (page("C", ["<a href='#'>linked</a> words"], '<div class="ad banner">buy</div><script>if (a < b) { "</p>" }</script><!-- <p>no</p> -->'), "C\nlinked words"),
        3: (None, ""),
        4: ("", ""),
        5: ("<p>unclosed <article><p>one<p>two<aside>side</aside><form><p>f</p></form>", "one\ntwo"),
        6: ("<article>" + "<p>many words</p>" * 20_000 + "</article>", "\n".join(["many words"] * 20_000)),
        8: ('<title>t</title><div class="page has-sidebar"><article class="post" data-id="ad"><p>kept</p><p style="display: none">hidden</p><div id="comments"><article class="comment"><p>nice</p></article></div></article></div>', "kept"),
        7: ("<article><p>a &nbsp; b\n\tc 1 < 2</p></article>", "a b c 1 < 2"),
    }
    rows = [(i, "https://one.example/a" if i < 7 else None, h, "x") for i, (h, _) in cases.items()] + [(4, "nothing", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    out = wrappers.extract(df)
    assert out.columns == ["page_id", "url", "html", "host", "text"] and out.count() == len(rows)
    assert {r.page_id: r.text for r in out.collect()} == {i: t for i, (_, t) in cases.items()}
    assert wrappers.extract(df.limit(0)).count() == 0


def test_without_an_article_what_varies_is_the_text(spark):
    rng = random.Random(1)
    rows = []
    for i in range(12):
        text = [" ".join(f"w{rng.randrange(999)}" for _ in range(40)) for _ in range(3)]
        html = f"<body><div class=top><span>My site</span></div><div class=main><div class=intro>Always the same words</div>{''.join(f'<p>{t}</p>' for t in text)}</div><div class=side><ul><li><a href=x>one w{i}</a><li><a href=y>two</a></ul></div></body>"
        rows.append((i, "http://two.example/", html, "\n".join(text)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    assert all(r.text == r.want for r in wrappers.extract(df).collect())


def test_wrapper_does_not_depend_on_partitions(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    one, many = ({r.host: r.text for r in wrappers.extract(p).groupBy(wrappers.host_of(F.col("url")).alias("host")).agg(F.sort_array(F.collect_list("text")).cast("string").alias("text")).collect()} for p in (pages.coalesce(1), pages.repartition(9)))
    assert one == many
    assert all(json.loads(r.wrapper)[wrappers.PAGES] > 0 for r in wrappers.infer(pages).collect())


def test_query(spark, sf):
    rows = queries.QUERIES["op6_html"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) > 0 and "<" not in r.text and "track(" not in r.text for r in rows)


def read(spark, pages):
    df = spark.createDataFrame([(i, "http://three.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in wrappers.extract(df).orderBy("page_id").collect()]


def test_articles_that_are_comments_do_not_hide_posts_in_divs(spark):
    posts = [f"post {i} " + f"w{i} " * 30 for i in range(8)]
    pages = [f'<body><div class=post><p>{p}</p></div><article class="comment"><p>nice {i}</p></article></body>' for i, p in enumerate(posts)]
    assert read(spark, pages) == [p.strip() for p in posts]


def test_a_host_with_and_without_articles(spark):
    texts = [f"text {i} " + f"w{i} " * 30 for i in range(12)]
    pages = [f"<body><nav>menu</nav><{tag}><p>{t}</p></{end}><ul><li><a href=x>more {i}</a></ul></body>" for i, t in enumerate(texts) for tag, end in [("article", "article") if i % 2 else ("div class=plain", "div")]]
    assert read(spark, pages) == [t.strip() for t in texts]


def test_copies_are_no_boilerplate(spark):
    one = "<body><div class=box><p>the only page</p><p>has two paragraphs</p></div></body>"
    for n in (1, 4, 5, 30):
        assert read(spark, [one] * n) == ["the only page\nhas two paragraphs"] * n
    # a paragraph that copies alone fill
    rest = [f"<body><div class=box><p>{f'w{i} ' * 20}</p></div></body>" for i in range(6)]
    extra = f"<body><div class=box><p>{'v ' * 20}</p><blockquote>said by copies</blockquote></div></body>"
    assert read(spark, [*rest, *[extra] * 6])[6:] == ["v " * 19 + "v\nsaid by copies"] * 6
    # different pages whose text is the same: the rule empties none of them
    same = [f'<body><div class=box><p>same text</p></div><div class="n{i}"></div></body>' for i in range(7)]
    assert read(spark, same) == ["same text"] * 7


def test_heading_lead_and_linked_text_stay(spark):
    pages = [f"<body><div class=top><span>user {i}</span></div><div class=page><h1><a href=x>Title {i}</a></h1><p class=lead>Lead {i}</p><div class=body><p>{f'w{i} ' * 60}</p><p>{f'v{i} ' * 60}</p><blockquote><a href=y>quoted {i}</a></blockquote></div><ul><li><a href=z>other {i}</a></ul></div></body>" for i in range(7)]
    want = [f"Title {i}\nLead {i}\n{(f'w{i} ' * 60).strip()}\n{(f'v{i} ' * 60).strip()}\nquoted {i}" for i in range(7)]
    assert read(spark, pages) == want


class Truth(HTMLParser):
    """Blocks of the article, read by the standard library's parser: another way than the module's."""

    BLOCKS = frozenset("article h1 p li blockquote".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.off, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        if tag in ("script", "style", "aside", "form", "nav"):
            self.off += 1
        if tag == "br":
            self.blocks[-1] += " "
        elif tag in self.BLOCKS:
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag == "article":
            self.depth -= 1
        if tag in ("script", "style", "aside", "form", "nav"):
            self.off -= 1
        if tag in self.BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth and not self.off:
            self.blocks[-1] += data


def truth(html):
    parser = Truth()
    parser.feed(html or "")
    parser.close()
    return "\n".join(t for t in (" ".join(b.split()) for b in parser.blocks) if t)


def test_pages_against_another_parser(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: truth(r.html) for r in rows.collect()}
    assert all(want.values())
    assert {r.page_id: r.text for r in wrappers.extract(rows).collect()} == want
    # the same texts where no tag says what an article is, and where half the pages have none
    bare = rows.withColumn("html", F.regexp_replace("html", "(</?)article", "$1div"))
    assert {r.page_id: r.text for r in wrappers.extract(bare).collect()} == want
    gone = rows.withColumn("html", F.when(F.col("page_id") % 2 == 0, F.regexp_replace("html", "</?article>", "")).otherwise(F.col("html")))
    assert {r.page_id: r.text for r in wrappers.extract(gone).collect()} == want


def test_the_wrapper_decides(spark):
    # a short post beside a long sidebar without any mark, on a host of long posts
    long = ["post %d " % i + f"w{i} " * 80 for i in range(9)]
    pages = [f"<body><div class=top><b>Site</b></div><div class=one><h1>Title {i}</h1><div class=two><p>{p}</p></div></div><div class=three><div><p>{f's{i} ' * 25}</p></div></div></body>" for i, p in enumerate([*long, "tiny post"])]
    got = read(spark, pages)
    assert got[:9] == [f"Title {i}\n{p.strip()}" for i, p in enumerate(long)] and got[9] == "Title 9\ntiny post"
    alone = wrappers.Extractor(wrappers.lift(wrappers.parse("")))(pages[9])
    assert "s9" in alone
    # template inside an article: the wrapper alone knows it
    pages = [f"<body><article><h1>T{i}</h1><div class=x>Read us every day</div><p>{f'v{i} ' * 20}</p><p>The same closing words.</p></article></body>" for i in range(7)]
    assert read(spark, pages) == [f"T{i}\n{(f'v{i} ' * 20).strip()}\nThe same closing words." for i in range(7)]
    assert "every day" in wrappers.Extractor(wrappers.lift(wrappers.parse("")))(pages[0])


def test_class_names_inside_articles(spark):
    inside = '<div class="search results"><p>found it</p></div><div class="social-science"><p>a science</p></div><div class="related"><p>told in words</p></div><div class="ad-hoc"><p>hoc</p></div>'
    outside = '<div class="social"><a href=x>share</a> <a href=y>like</a></div><div class="comment-list"><p>nice</p></div><div class="notice"><p>we moved</p></div><div class="ad-slot-3"><p>buy</p></div>'
    pages = [f"<body><article><p>text {i}</p>{inside}{outside}</article></body>" for i in range(2)]
    assert read(spark, pages) == [f"text {i}\nfound it\na science\ntold in words\nhoc" for i in range(2)]
    assert [wrappers.marked(n) for n in ("ad", "ads-left", "post-comments", "address", "social-science", "share-bar", "main-content")] == [2, 2, 2, 0, 0, 1, 0]


def test_deep_and_wide_pages(spark):
    deep = "<article>" + "<div>" * 5_000 + "one<p>two</p>" + "<nav>menu</nav>" + "</div>" * 5_000 + "<p>three</p></article>"
    assert read(spark, [deep, deep.replace("one", "uno")]) == ["one\ntwo\nthree", "uno\ntwo\nthree"]
    wide = ["<article>" + "".join(f"<p class={chr(97 + k % 26) + chr(97 + k // 26 % 26) + chr(97 + k // 676)}{end}>t{k}</p>" for k in range(3_000)) + "</article>" for end in ("", "x", "y")]
    began = time.time()
    assert read(spark, wide) == ["\n".join(f"t{k}" for k in range(3_000))] * 3
    assert time.time() - began < 60


def test_alignment_is_a_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(9))] for _ in range(2))
        pairs = wrappers.common(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert wrappers.common(list("abc"), list("abxc")) == [(0, 0), (1, 1), (2, 3)]


def test_wrappers_survive_being_written():
    one = wrappers.lift(wrappers.parse(page("A", ["b", "c"])))
    assert wrappers.load(wrappers.dump(one)) == one


def text_of(html):
    return wrappers.Extractor(wrappers.lift(wrappers.parse(html)))(html)


def test_attribute_values_are_no_attributes():
    assert text_of('<article title="the hidden valley"><p>words</p></article>') == "words"
    assert text_of('<article><div data-note="a hidden gem"><p>kept</p></div><p hidden>gone</p><p aria-hidden=true>gone</p><p aria-hidden="false">stays</p></article>') == "kept\nstays"
    assert text_of("<article><p title='class=\"comments\"'>one</p><p data-class=ad>two</p><div class='ad'>gone</div></article>") == "one\ntwo"


def test_a_head_without_an_end():
    assert text_of("<html><head><title>t</title><meta charset=utf-8><body><article><p>words</p></article>") == "words"
    assert text_of("<head><title>t</title><script>x</script><div><p>first words of it</p><p>second words</p></div>") == "first words of it\nsecond words"
    assert text_of("<head><title>t</title>bare text") == "bare text"


def test_a_page_within_one_form():
    frame = "<body><form id=main method=post><input type=hidden><div><h1>Head</h1><p>many words of the page</p><p>and more of them</p></div><select><option>a<option>b</select></form>"
    assert text_of(frame) == "Head\nmany words of the page\nand more of them"
    assert text_of("<article><p>an article with more words than that</p><form><p>your name</p><button>send</button></form></article>") == "an article with more words than that"


def test_ids_inside_articles_are_targets():
    assert text_of('<article><h2 id="cookies">Cookies</h2><p>about cookies</p><section id="comments"><h2 id="comments">Remarks</h2><p>of the author</p></section></article>') == "Cookies\nabout cookies\nRemarks\nof the author"
    assert text_of('<div id="comments"><p>nice post, thank you all</p></div><div><p>the text of the page, which is longer</p><p>than its comments</p></div>') == "the text of the page, which is longer\nthan its comments"
    assert text_of('<article><p>text</p><div class="comments"><p>nice</p></div></article>') == "text"


def test_unclosed_quotes_and_tags():
    assert text_of('<p title="abc>first words</p>') == "first words"
    assert text_of("<article><p class='x>one</p><p>two</p></article>") == "one\ntwo"
    assert text_of("<article><p>one</p><p class=x") == "one"
    assert text_of("<article><p>a < b and c > d</p></article>") == "a < b and c > d"
    assert text_of('<article><p title="x > y">kept</p></article>') == "kept"


def test_time_is_in_proportion():
    inputs = ["<a ", "<div>x", "<p title=", '<p title="', "<!-- ", "<script>", "<div class='ad'>x", "</p>", "<", "<a b=   ", "<form>x", "&amp"]
    for one in inputs:
        took = []
        for n in (10_000, 40_000):
            began = time.process_time()
            wrappers.parse(one * n)
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.5 and took[1] < 5, one
    began = time.process_time()
    wrappers.parse("<div>" * 20_000 + "</p>" * 20_000)
    assert time.process_time() - began < 5
