import random

from foliant.llm import html as H

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav>
<!-- x --><div class="ad">buy</div><article><h1>Head &amp; more</h1><p><b>One  two<br>three<p>Four <i>fi</i>ve.</p><div class="comments"><p>nice!</p></div></article>
<aside>side</aside><form><p>mail</p></form><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert H.main_text(PAGE, "article") == "Head & more One two three Four five."
    assert H.main_text(None, "article") == "" and H.main_text("", "") == ""


def test_pages_without_the_container_fall_back_to_the_body():
    assert H.main_text("<body><nav>m</nav><p>a<p>b &lt;c&gt;", "article") == "a b <c>"


def test_broken_markup():
    assert H.main_text("<p>a</div></p></b><p>b <", "") == "a b <"
    assert H.main_text("<script>x", "") == ""
    assert H.main_text("plain & text", "") == "plain & text"
    assert H.main_text("<p title='a>b'>c</p>", "") == "c"


def test_repeats_become_groups():
    a, _ = H.skeleton("<ul><li>a</li><li>b</li><li>c</li></ul>")
    b, _ = H.skeleton("<ul><li>a</li><li>b</li></ul>")
    assert a == b == [["<", "ul", [["+", [["<", "li", ["#"]]]]]]]


def test_mismatches_become_optional():
    a, _ = H.skeleton("<div><h1>a</h1><p>b</p></div>")
    b, _ = H.skeleton("<div><h1>a</h1><span></span><h2>x</h2><p>b</p></div>")
    w = H.align(a, b)
    assert w == [["<", "div", [["<", "h1", ["#"]], ["?", [["<", "h2", ["#"]]]], ["<", "p", ["#"]]]]]
    assert H.align(w, a) == w and H.align(w, b) == w


def test_single_and_repeated_forms_align():
    a, _ = H.skeleton("<ul><li>a</li></ul>")
    b, _ = H.skeleton("<ul><li><p>a</p></li><li><p>b</p></li></ul>")
    assert H.align(a, b) == [["<", "ul", [["+", [["<", "li", [["?", ["#", ["<", "p", ["#"]]]]]]]]]]]


def test_deep_and_long_pages():
    assert H.main_text("<div>" * 3000 + "x" + "</div>" * 3000, "") == "x"
    deep, mass = H.skeleton("<div>" * 3000 + "x" + "</div>" * 3000)
    assert sum(mass.values()) == 1 and H.align(deep, deep) == deep
    long, _ = H.skeleton("<body>" + "<p>a</p><h2>b</h2>" * 20_000 + "</body>")
    assert long == [["<", "body", [["+", [["<", "p", ["#"]], ["<", "h2", ["#"]]]]]]]


def test_irregular_pages_stay_small():
    rng = random.Random(0)
    pages = ["<body>" + "".join(rng.choice(("<p>a</p>", "<h2>b</h2>", "<ul><li>c</li></ul>", "<pre>d</pre>")) for _ in range(n)) + "</body>" for n in (3000, 5000, 40)]
    wrapper, mass = H.merge(H.skeleton(p) for p in pages)
    assert len(H._key(wrapper)) < 6000 and sum(mass.values()) == 8040


def test_wrapper_finds_the_container_of_a_host_without_article(spark):
    body = lambda i: f'<div class="top">Site</div><div class="menu"><p>{"menu " * 40}</p></div><div class="story"><p>{"text " * 30}{i}</p><p>more {i}</p></div><div class="legal">c</div>'
    rows = [(i, f"https://u:p@h.example:8{i % 2}/x{i}", f"<html><body>{body(i)}</body></html>", "clash") for i in range(30)]
    rows += [(100, None, None, ""), (100, None, None, ""), (101, "not a url", "<p>z", ""), (None, "http://h.example/y", "<p>only</p>", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {(r.page_id, r.text) for r in H.extract_text(df).collect()}
    assert (3, "text " * 29 + "text 3 more 3") in got
    assert {(100, ""), (101, "z"), (None, "only")} <= got
    assert H.extract_text(df).count() == len(rows)
    assert H.extract_text(df.limit(0)).count() == 0


def test_merging_is_the_same_in_any_order():
    pages = [f"<body><p>a</p>{x}<p>b</p></body>" for x in ("", "<h2>h</h2>", "<ul><li>1</li><li>2</li></ul>", "<h2>h</h2><ul><li>1</li></ul>")]
    one = H.merge(H.skeleton(p) for p in pages)
    assert one == H.merge(H.skeleton(p) for p in reversed(pages))


def test_equal_texts_stay_and_differing_ones_become_slots(spark):
    page = lambda i: f'<body><article><p>Sign up for our letter</p><h1>Title {i}</h1><p>{f"story {i} " * 9}</p><p>more {i * i}</p></article></body>'
    a, b = (H.skeleton(page(i), True)[0] for i in (1, 2))
    article = H.align(a, b)[0][2][0][2]
    assert article[0][2][0].startswith("=") and "*2*" in article[0][2][0] and article[1][2] == ["#"]
    df = spark.createDataFrame([(i, "http://h.example/x", page(i)) for i in range(12)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract_text(df).collect()}
    assert got == {i: f"Title {i} " + f"story {i} " * 9 + f"more {i * i}" for i in range(12)}


def test_near_copies_keep_their_text(spark):
    rows = [(i, "http://h.example/x", f"<article><p>{'one long story ' * 9}</p><h2>copy {i}</h2></article>") for i in range(5)]
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "one long story " * 9 + f"copy {i}" for i in range(5)}


def test_names_mark_boilerplate_as_whole_names_only(spark):
    text = "long words of a story " * 5
    page = lambda attr, i: f'<html><body class="single has-sidebar search"><{attr}><h1 id="how-to-share-photos">t{i}</h1><p>{text}{i}</p></{attr.split()[0]}><div class="share">x</div></body></html>'
    opens = ('article class="post category-social-media comments-open"', 'main class="search"', "section class='social'")
    rows = [(k * 10 + i, f"http://h{k}.example/", page(a, i)) for k, a in enumerate(opens) for i in range(4)]
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k * 10 + i: f"t{i} {text}{i}" for k in range(3) for i in range(4)}


def test_ids_and_templates_of_one_host(spark):
    page = lambda i: f'<body><div class="top">bar {i}</div><article id="post-{i}" data-id="x{i}" class="{"post" if i % 2 else "news"} cat-{i}"><h1>T{i}</h1><p>{f"story {i} " * 9}</p></article></body>'
    df = spark.createDataFrame([(i, "http://h.example/x", page(i)) for i in range(300)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract_text(df).collect()}
    assert got == {i: f"T{i} " + f"story {i} " * 8 + f"story {i}" for i in range(300)}
    assert len(H.infer_wrappers(df).first().wrapper) < 1000


def test_labels_without_end_stay_bounded():
    words = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    pages = [f'<body><article class="slug-{words(i)}"><p>story {i}</p></article></body>' for i in range(6000)]
    wrapper, mass = H.merge(H.skeleton(p) for p in pages)
    assert len(H._key(wrapper)) < 20_000 and len(mass) <= H.MANY + 1
    assert H.main_text(pages[5], H.containers(wrapper, mass)) == "story 5"


def texts_of(pages):
    """Every page's text by the wrapper of all of them, as one host."""
    wrapper, mass = H.merge((H.skeleton(p, True) for p in pages), False)
    n = len(pages)
    held, free = H.containers(wrapper, mass, n), H.overruled(H.slot_mass(wrapper, mass, n))
    return [H.main_text(p, held, wrapper, n, free) for p in pages]


def test_an_article_is_found_at_any_depth():
    for depth in (1, 50, 60, 200, 900):
        page = lambda i: f'<body><div class="top">The name of the site</div>{"<div>" * depth}<article><section class="a"><p>first {i} {"words " * 9}</p></section><p>Read it all here</p><section class="b"><p>second {i}</p></section></article>{"</div>" * depth}<div>a line of rights</div></body>'
        assert texts_of([page(i) for i in range(8)]) == [f"first {i} {'words ' * 9}second {i}" for i in range(8)], depth


def test_constants_of_equal_neighbours_are_told_from_slots():
    """The constant paragraphs stand in one repeated group with the story's own."""
    page = lambda i: f'<body><div class="c"><p>Welcome to our site</p>{"".join(f"<p>story {i} part {k} is told here</p>" for k in range(i % 4 + 2))}<p>All rights are ours</p></div></body>'
    want = [" ".join(f"story {i} part {k} is told here" for k in range(i % 4 + 2)) for i in range(12)]
    assert texts_of([page(i) for i in range(12)]) == want


def test_levels_of_many_items_in_no_order_keep_their_constants():
    rng = random.Random(1)
    kinds = "p h2 h3 pre blockquote ul ol table figure".split()

    def page(i):
        parts = [(k, f"{k} {i} {rng.randint(0, 10**6)}") for k in rng.choices(kinds, k=150)]
        body = "".join(f"<{k}>{x}</{k}>" for k, x in parts)
        return f"<body><div><h1>Welcome to our site</h1></div>{body}<p>All rights are ours</p></body>", " ".join(x for _, x in parts)

    made = [page(i) for i in range(9)]
    assert texts_of([p for p, _ in made]) == [x for _, x in made]


def test_alignment_decides_the_text(monkeypatch):
    page = lambda i: f'<body><div class="c"><h4>Welcome to our site</h4><p>story {i} is told at some length</p></div></body>'
    pages = [page(i) for i in range(6)]
    want = [f"story {i} is told at some length" for i in range(6)]
    assert texts_of(pages) == want
    monkeypatch.setattr(H, "align", lambda left, right, pages=True: left + right)
    assert texts_of(pages) != want


def test_wrappers_are_bounded_whatever_the_number_of_pages(spark):
    rng = random.Random(3)
    page = lambda i: f'<body><div class="top">bar {i}</div><div class="story">{"".join(rng.choice(("<p>%d</p>", "<h2>%d</h2>", "<ul><li>%d</li></ul>")) % rng.randint(0, 10**9) for _ in range(rng.randint(1, 90)))}</div></body>'
    size = {}
    for n in (60, 600):
        df = spark.createDataFrame([(i, "http://h.example/x", page(i)) for i in range(n)], "page_id long, url string, html string")
        size[n] = len(H.infer_wrappers(df).first().wrapper)
    assert size[600] < 1.5 * size[60] + 500


def test_hosts_with_layouts_of_their_own_against_what_was_put_in(spark):
    """No page has an article element; the texts that were put in are the plain version."""
    rng = random.Random(7)
    rows, want = [], {}
    for host in range(12):
        own = rng.sample("story entry post body text content main-copy page-text".split(), 2)
        bar, legal, call = (" ".join(f"{w}{host}" for w in words) for words in (("home", "about", "news"), ("all", "rights", "kept"), ("sign", "up", "today")))
        for i in range(9):
            key = host * 100 + i
            parts = [f"line {key} {k} " + " ".join(str(rng.randint(0, 999)) for _ in range(rng.randint(8, 30))) for k in range(rng.randint(2, 7))]
            blocks = "".join(f"<{t}>{x}</{t}>" for t, x in zip(rng.choices(("p", "h2", "blockquote"), k=len(parts)), parts))
            inner = f'<div class="{own[1]}">{blocks}</div>' if host % 2 else blocks
            page = f'<html><head><title>t{key}</title></head><body><div class="bar-{host}">{bar}</div><div class="{own[0]} n{i}"><h6>{call}</h6>{inner}</div><ul class="menu"><li>x{key}</li></ul><div>{legal}</div><script>var a="</p>{key}"</script></body></html>'
            rows.append((key, f"https://h{host}.example/p{i}", page))
            want[key] = " ".join(" ".join(parts).split())
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
