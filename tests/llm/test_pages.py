import pytest

from spanloom.llm.pages import extract_pages, main_text

LONG = "A longer sentence, with commas, that says what the article is about and goes on for a while, as articles do."


@pytest.mark.parametrize("page, want", [
    ("", ""), ("no markup at all", "no markup at all"), ("<p>one<p>two", "one\ntwo"),
    ('<nav><a href="/">menu</a></nav><div class="ad">buy</div><article><h1>T</h1><p><b>T.<br><p>x  &amp;\n y</p></article><footer>&copy;</footer>', "T\nT.\nx & y"),
    ('<script>var t="</p>";if(a<b)c()</script><style>p{}</style><article><p>a&nbsp;b</p><!-- <p>no</p> --></article>', "a b"),
    (f'<header><h1>Site</h1></header><div id="content"><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div><div class="sidebar"><p>{LONG}</p></div>', f"Head\n{LONG}\n{LONG}"),
    (f'<body><div class="cookie-notice">We use cookies</div><main><p>{LONG}</p><section class="comments"><p>{LONG}</p></section><form><p>q</p></form></main></body>', LONG),
    (f"<div><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></div>", f"{LONG}\none\ntwo\nc1\nc2"),
    ("<article><p>cut &am", "cut &am"), ("<article><p>1 < 2 and a <b>bold</b>word</p></article>", "1 < 2 and a boldword"),
])
def test_pages(page, want):
    assert main_text(page) == want


def test_links_are_discounted():
    links = "".join(f'<li><a href="/{i}">{LONG}</a></li>' for i in range(30))
    assert main_text(f"<div><ul>{links}</ul></div><div><p>{LONG}</p><p>{LONG}</p></div>") == f"{LONG}\n{LONG}"


def test_siblings_of_the_best_are_kept():
    page = f"<body><div><div>{f'<p>{LONG}</p>' * 5}</div><div>{f'<p>{LONG}</p>' * 3}</div><div><a href=x>{LONG}</a></div></div></body>"
    assert main_text(page) == "\n".join([LONG] * 8)


@pytest.mark.parametrize("name", ["sidebar-content", "footer-text", "newsletter-body", "cookie-content", "menu-main", "widget-text", "blog-sidebar"])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_a_bad_name_with_a_good_one_is_boilerplate_beside_an_article(name, tag):
    article = f"<div><p>{LONG}</p><p>{LONG}</p></div>"
    for box in (f'<{tag} class="{name}"><p>{LONG}</p></{tag}>', f'<{tag} id="{name}"><p>Short.</p></{tag}>'):
        assert main_text(f"<body>{article}{box}</body>") == main_text(f"<body>{box}{article}</body>") == f"{LONG}\n{LONG}"
    box = f'<{tag} class="{name}"><p>{LONG}</p><p>{LONG}</p></{tag}>'
    assert main_text(f"<body><article><p>{LONG}</p></article>{box}</body>") == LONG


def test_a_frame_named_after_its_sidebar_keeps_the_article():
    page = f'<body><div class="content-with-sidebar"><div><p>{LONG}</p><p>{LONG}</p></div><div class="sidebar"><p>{LONG}</p></div></div></body>'
    assert main_text(page) == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("page, want", [
    (f"<div><div><p>Intro text here.</p></div><div><p>{LONG}</p></div><div><p>Short end.</p></div></div>", f"Intro text here.\n{LONG}\nShort end."),
    (f"<body><article><p>{LONG}</p></article><article><p>{LONG}</p><p>More.</p></article></body>", f"{LONG}\n{LONG}\nMore."),
    (f'<body><article><p>{LONG}</p></article><article class="comment"><p>{LONG}</p></article></body>', LONG),
    (f"<body><p>First.</p><div><p>{LONG}</p><p>{LONG}</p></div><p>Last.</p></body>", f"First.\n{LONG}\n{LONG}\nLast."),
    (f'<body><div class="wrap"><div class="top">Site</div><div id="content"><p>{LONG}</p></div></div></body>', LONG),
    (f"<body><div><p>{LONG}</p></div><div><p>{LONG}</p></div></body>", f"{LONG}\n{LONG}"),
])
def test_parts_of_an_article_are_kept_however_short(page, want):
    assert main_text(page) == want


def test_of_equal_containers_the_first_is_the_best():
    page = f"<body><table><tr><td><p>{LONG}</p></td></tr></table><ul><li>a</li></ul><table><tr><td><p>{LONG[:-1]}!</p></td></tr></table></body>"
    assert main_text(page) == LONG


def test_table(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>x"), (3, "v", "<p>" + "long, text " * 20000), (3, "v", "<nav>n</nav>"), (4, "w", "<div" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = extract_pages(pages.selectExpr("*", "1 AS text", "2 AS n_chars", "3 AS k")).collect()
    assert len(got) == len(rows) and got[0].text == "" and got[2].text == "x"
    assert got[3].n_chars == len("long, text " * 20000) - 1 and all(r.n_chars == len(r.text) for r in got)
    assert extract_pages(pages.limit(0)).count() == 0
