from lineweave.llm import html_extract as he

PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<header><a href='/'>Home</a></header><nav><ul><li>Menu</li></ul></nav><!-- x --><div class=\"ad\">Buy</div>"
        "<div id='cookie-notice'>We use</div><div class='has-sidebar'><article><header><h1>Head</h1></header>"
        "<p><b>One &amp;\n two<br>three.<br><p>Four &lt;b&gt; <a href=x>five</a></p><form><p>Sign</p></form>"
        "<div class='comments'><article><p>nice</p></article></div></article></div><aside>Side</aside><footer>&copy; x</footer>")


def test_page_rules():
    assert he.page_text(PAGE, None) == "Head\n\nOne & two three.\n\nFour <b> five"
    assert he.page_text(PAGE + "</body></html>", None) == he.page_text(PAGE, None)
    assert he.page_text("<body><p>a</p><div class=menu>m</div>tail", None) == "a\n\ntail"
    assert he.page_text("plain < 3 & more", None) == "plain < 3 & more"
    assert he.page_text("", None) == "" and he.page_text("<script>alert(1)", None) == ""
    assert he.page_text("<nav>menu<article><p>text</article>", None) == "text"
    assert he.page_text("<p hidden>no</p><p>yes<img alt='>'>", None) == "yes"


def page(i, host="a.example.com"):
    body = "".join(f"<p>Text {i} {k}</p>" for k in range(i % 4 + 1))
    return (i, f"https://{host}/p{i}?x=1", f"<html><body><div class=top>Site name</div><div class=box><p>Read this first</p></div>"
            f"<div class=c>{body}</div><div class=end>Terms of use</div></body></html>")


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r["page_id"]: r for r in he.main_texts(df).collect()}


def test_texts_of_the_template_go(spark):
    rows = [page(i) for i in range(24)] + [page(100, "b.example.com"), (200, None, PAGE), (201, "https://c.example.com/", None), (None, None, "<p>x")]
    got = run(spark, rows)
    for i in range(24):
        assert got[i]["text"] == "\n\n".join(f"Text {i} {k}" for k in range(i % 4 + 1)) and got[i]["has_template"]
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert got[100]["text"].startswith("Site name") and not got[100]["has_template"]
    assert got[200]["text"].startswith("Head") and (got[201]["text"], got[201]["n_chars"]) == ("", 0)
    assert got[None]["text"] == "x"


def test_a_line_that_many_articles_share_stays(spark):
    rows = [(i, "http://h.example.com/", f"<body><nav>m</nav><article><h1>T{i}</h1><p>Shared line.</p><p>Own {i}</p></article>") for i in range(9)]
    assert all(r["text"] == f"T{i}\n\nShared line.\n\nOwn {i}" for i, r in run(spark, rows).items())


def test_shared_lines_of_articles_stay_at_every_size(spark):
    rows = [(1000 * n + i, f"http://h{n}.example.com/{i}", f"<body><nav>m</nav><div>Site</div><article><h1>T{i}</h1><h2>Introduction</h2>"
             f"<p>Shared line.</p><p>Own {i}</p></article><div>Terms</div>") for n in (9, 10, 30) for i in range(n)]
    rows += [(50 + i, f"http://copies.example.com/{i}", "<body><div><p>One</p><p>Two</p><p>Three</p></div>") for i in range(10)]
    got = run(spark, rows)
    for n in (9, 10, 30):
        assert all(got[1000 * n + i]["text"] == f"T{i}\n\nIntroduction\n\nShared line.\n\nOwn {i}" for i in range(n))
    assert got[9000]["has_template"] is False and got[10000]["has_template"] and got[30000]["has_template"]
    assert all(got[50 + i]["text"] == "One\n\nTwo\n\nThree" for i in range(10))


def test_short_titles_and_endings_stay(spark):
    rows = [(i, f"http://d.example.com/{i}", f"<body><div class=top>Site name</div><div class=post><h1>Title {i}</h1><p class=byline>By us</p>"
             f"<div class=text><p>{f'long {i} ' * 80}</p><h2>Closing</h2><p>End {i}</p></div></div><div class=end>Terms</div></body>")
            for i in range(12)]
    got = run(spark, rows)
    for i in range(12):
        assert got[i]["has_template"]
        parts = got[i]["text"].split("\n\n")
        assert parts[0] == f"Title {i}" and parts[-2:] == ["Closing", f"End {i}"] and "Site name" not in parts and "Terms" not in parts


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([page(1), page(1)], "page_id bigint, url string, html string")
    assert he.main_texts(df.limit(0)).count() == 0 and len({r["text"] for r in he.main_texts(df).collect()}) == 1


def test_inline_noise_goes_and_leaves_its_block_whole():
    text = lambda body: he.page_text(f"<article>{body}</article>", None)
    assert text("<p>Hello <button>Share</button> world</p>") == "Hello world"
    assert text('<p>Read this <span class="ad">Buy now</span> sentence.</p>') == "Read this sentence."
    assert text("<p>a <label>L</label><select><option>o</select> b <a class=share href=x>s</a> c</p>") == "a b c"
    assert text("<p>a <span class=ad>never closed</p><p>b</p>") == "a\n\nb"
    assert text("<p>a <button><div>x</div><p>y</p></button> b</p><p>c</p>") == "a\n\nb\n\nc"
    assert text("<p>one</p><menu><li>m<li>n</menu><p>two</p>") == "one\n\ntwo"


def test_article_text_stays():
    text = lambda body: he.page_text(f"<article>{body}</article>", None)
    assert text("<p>E <math><mi>x</mi></math> and <svg><title>t</title><text>label</text></svg></p>") == "E x and label"
    assert text("<section class=search-results><p>a</p></section><section id=related-work><p>b</p></section>") == "a\n\nb"
    assert text("<div class=market-share><p>a</p></div><div class='share-buttons'>s</div><div class=comments>c</div>") == "a"
    assert he.page_text("<div class=search-results>x</div><p>y", None) == "y"


def test_tags_and_quotes():
    names = lambda source: [t[3] for t in he.tags_of(source) if t[3]]
    assert names("<p title=\"a > b\">x<img alt='>'>y<a href=it's>z</a>") == ["p", "img", "a", "a"]
    assert names("<!-- <p> --><![CDATA[<b>]]><!doctype x><?php <i> ?><u>") == ["u"]
    assert names("a < b <3 </ x> <em") == [] and names("<a b='c <d> e") == ["a"]


def test_broken_pages_take_time_and_memory_in_proportion():
    import time
    import tracemalloc

    started = time.perf_counter()
    for source in ("<p>hello</p> a <b " + '"a" ' * 300_000, '<a "' * 250_000, "<a " * 300_000, "<a '\"" * 200_000 + ">", "<!--" * 200_000,
                   "<script" * 100_000, "<script>" + "</script" * 100_000, "<x y='" * 100_000 + ">" * 1000, "</b>" * 200_000,
                   "<div>" * 50_000 + "</section>" * 50_000):
        he.page_text(source, None)
    assert time.perf_counter() - started < 30
    tracemalloc.start()
    text = he.page_text("<div class=row>x" * 100_000, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) == 100_000 * 3 - 2 and peak < 200 << 20


def test_templates_by_brute_force(spark):
    """The template of a host against the definition, worked out token by token."""
    import random

    rng = random.Random(4)
    pages = []
    for i in range(14):
        parts = ["<div class=top>Site</div>", "<p>Welcome</p>", "".join(f"<p>own {rng.randrange(40)}</p>" for _ in range(rng.randint(0, 4)))]
        parts += ["<div class=side>Side</div>"] * (i != 3) + ["<p>Now and then</p>"] * (i % 2) + ["<div class=end>Terms</div>"]
        pages.append("<html><body>" + "".join(parts) + "</body></html>")
    pages[5] = pages[4]
    rows = spark.createDataFrame([("h", i, p) for i, p in enumerate(pages)], "host string, page bigint, html string")
    got = he.templates(rows).collect()
    distinct = sorted(set(pages), key=pages.index)
    seen = [[t[1] for t in he.Page(p).tokens] for p in distinct]
    groups = {}
    for key in {k for keys in seen for k in keys}:
        vector = tuple(keys.count(key) for keys in seen)
        if sum(n > 0 for n in vector) >= 0.9 * len(distinct):
            groups.setdefault(vector, []).append((sum((keys.index(key) + 1) / (len(keys) + 1) for keys in seen if key in keys) / sum(n > 0 for n in vector), key))
    want = sorted(x for g in groups.values() if len(g) >= 3 for x in g)
    assert len(got) == 1 and got[0]["template"] == he._hashes([k for _, k in want]).view("int64").tolist()
    assert len(want) >= 6
