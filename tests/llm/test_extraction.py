"""Text extraction where adverts, nested articles and teasers stand in the text."""

import time

from locusframe.llm import html_text

_P = "<p>" + "A sentence of the text. " * 6 + "</p>"


def test_removed_elements_lose_no_text():
    body, end = _P * 20, "<p>One closing line.</p><p>Another.</p><p>Last words.</p>"
    for cut in ("<div class=ad>no</div>", "<div class=share-bar><a href=x>no</a></div>", "<form>no</form><aside><p>no</p></aside>"):
        want = ["A sentence of the text. " * 5 + "A sentence of the text."] * 20 + ["One closing line.", "Another.", "Last words."]
        assert html_text.extract(f"<body><div id=content>{body}{cut}{end}</div></body>").split("\n") == want
        assert html_text.extract(f"<body><div>{body}</div>{cut}<div>{end}</div></body>").split("\n") == want
        assert html_text.extract(f"<body><div>{end}{cut}{body}{cut}</div></body>").split("\n") == want[20:] + want[:20]


def test_surges_of_links_are_dropped():
    links = "".join(f"<p>On <a href=/{i}>A long headline, number {i}</a></p>" for i in range(5))
    got = html_text.extract(f"<body><div>{_P * 5}</div><nav>no</nav><div>{links}</div></body>")
    assert got.count("\n") == 4 and "headline" not in got
    assert html_text.extract(f"<body><div>{links}</div></body>").count("headline") == 5


def test_text_in_several_articles_and_outside_of_them_is_kept():
    one, two, three = ("<p>" + f"The {n} part of the text, of some length. " * 4 + "</p>" for n in ("first", "second", "third"))
    get = lambda page: [x.split()[1] for x in html_text.extract(page).split("\n")]
    assert get(f"<body><article>{one}</article><article>{two * 2}</article><article>{three}</article></body>") == ["first", "second", "second", "third"]
    assert get(f"<body><article>{one}<article>{two}</article>{three * 3}</article></body>") == ["first", "second", "third", "third", "third"]
    teaser = "<article><h3><a href=/x>A headline that leads elsewhere, at length</a></h3><p>Read on</p></article>"
    assert get(f"<body><div>{one * 3}</div>{teaser}</body>") == ["first"] * 3
    # an article's header stays after an inner article's close, and its lines of links stay with it
    assert html_text.extract(f"<article>{one}<article>{two}</article><header>Head</header></article>").endswith("Head")
    links = "".join(f"<p><a href=/{i}>Source {i}</a></p>" for i in range(6))
    assert html_text.extract(f"<article>{one * 3}{links}</article>").count("Source") == 6


def test_names_that_the_text_may_bear_are_judged_by_its_lines():
    want = "\n".join(["A sentence of the text. " * 5 + "A sentence of the text."] * 5)
    assert html_text.extract(f"<body><div class='share price'>{_P * 5}</div></body>") == want
    assert html_text.extract(f"<body><article>{_P * 3}<div class='search results'>{_P * 2}</div></article></body>") == want
    bar = "<div class='share-bar'>Share this</div><div id=search><b>Find</b></div><div class=banner><div>Hello</div></div>"
    assert html_text.extract(f"<body><div>{_P * 3}{bar}{_P * 2}</div></body>") == want
    assert html_text.extract(f"<body><article>{_P * 5}<section class='comments'>{_P}</section></article></body>") == want


def test_equal_articles_are_both_kept_and_names_that_clash_are_replaced(spark):
    assert html_text.extract(f"<article>{_P}</article><article>{_P}</article>").count("\n") == 1
    rows = [(1, "u", f"<p>{'word ' * 30}</p>", "old", 5)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).first()
    assert got.text == ("word " * 30).strip() and got.n_chars == 149


def test_hostile_pages_take_linear_time():
    begin = time.time()
    for page in ("<nav>" * 100_000, "<a href=\"x" * 100_000, "<a \"" * 100_000, "<a \">\" " * 50_000 + "<p>", "<div class='ad'>" * 100_000, "<script>" * 100_000, "<head>" * 50_000, "<div class=search>" * 50_000 + "x", "<!" * 100_000, "<a" * 100_000, "<article>" * 50_000):
        html_text.extract(page)
    assert time.time() - begin < 60
    for page in ("<nav>" * 100_000, "<a href=\"x" * 100_000):
        begin = time.time()
        html_text.extract(page)
        assert time.time() - begin < 5
    assert html_text.extract('<p>one <a href="x>two</a> three</p><p>four</p>').startswith("one two three")


def test_tokens_of_well_formed_markup():
    page = "<!-- a > b --><p class='x > y'>1 < 2</p><br/><![CDATA[z]]><?php x ?>"
    assert [(t[2], t[3], t[4]) for t in html_text.tokens_of(page)] == [("", "", ""), ("", "p", " class='x > y'"), ("/", "p", ""), ("", "br", "/"), ("", "", ""), ("", "", "")]
