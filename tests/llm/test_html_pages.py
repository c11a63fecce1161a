"""Main text of pages written by hand, none of them from the generator; the wanted text stands beside each."""

from __future__ import annotations

from veilmark.llm import html_text

LONG = "It had rained since the morning, and nobody in the village expected the bridge to hold for another night."
MORE = "By noon the water stood at the third step of the old mill, where children used to fish in better years."
PAGES = [
    (
        "<article><h1>Title</h1><p>t</p><div class='comments'><p>nice post, thanks</p></div></article>",
        ["Title", "t"],
    ),
    (
        f"<body><header><a href='/'>Daily</a></header><main><h1>Flood</h1><section class='story-body'><p>{LONG}</p><p>{MORE}</p></section></main><footer>Terms © 2020 in prose</footer></body>",
        ["Flood", LONG, MORE],
    ),
    (
        f"<html><body><div id='top-nav'><ul><li><a href=/a>Home</a><li><a href=/b>World</a></ul></div><div class='post'><h2>On rivers</h2><p>{LONG}<p>{MORE}</div><div id='comments'><h3>2 comments</h3><div class='comment'><p>I was there and it was worse than you say in this piece.</p></div></div><div class='sidebar'><h4>Popular</h4><ul><li><a href=/c>Ten bridges</a></ul></div></body></html>",
        ["On rivers", LONG, MORE],
    ),
    (
        f"<body><div class='cookie-banner'>We use cookies to make this site better. <button>Accept</button></div><article class='entry'><header><h1>The mill</h1></header><p>{LONG}</p><aside class='related'><h3>Read next</h3><ul><li><a href='/x'>Old mills</a></li><li><a href='/y'>New mills</a></li></ul></aside><p>{MORE}</p><div class='share'><a href='#'>Post</a> <a href='#'>Mail</a></div></article><footer><p>Imprint and privacy</p></footer></body>",
        ["The mill", LONG, MORE],
    ),
    (
        f"<body><nav><a href=/>Home</a> | <a href=/n>News</a></nav><div id='content'><div class='article-body'><p>{LONG}</p><ul><li>two bridges</li><li>one mill</li></ul><p>{MORE}</p></div><form class='newsletter'><p>Get our letter every Sunday.</p><input type=email></form></div><div class='footer'>&copy; 2021 The Paper</div></body>",
        [LONG, "two bridges", "one mill", MORE],
    ),
    (
        f"<html><body><table><tr><td>Year</td><td>1931</td></tr></table><p>{LONG}</p><p>{MORE}</p></body></html>",
        ["Year", "1931", LONG, MORE],
    ),
    (
        f"<body><div class='wrapper'><div class='masthead'><h1>The Paper</h1><p>News since 1890</p></div><div class='main'><h2>Water rises</h2><div class='ad'>Buy boots now, all sizes in stock.</div><p>{LONG}</p><blockquote>We never saw it so high.</blockquote><p>{MORE}</p></div><section id='comments'><p>First!</p><p>Great photos, where were they taken?</p></section></div></body>",
        ["Water rises", LONG, "We never saw it so high.", MORE],
    ),
    (
        f"<body><main><article><h1>R&eacute;sum&eacute;</h1><p>{LONG}</p><script>var a='<p>no</p>'</script><section><h2>After</h2><p>{MORE}</p></section><section class='comments'><h2>Responses</h2><ol><li><p>Thank you for this.</p></li></ol></section></article></main></body>",
        ["Résumé", LONG, "After", MORE],
    ),
    (
        f"<body><div class='promo'>Subscribe for 1 a month</div><div class='story'><p>{LONG}</p></div><div class='story'><p>{MORE}</p></div><div class='legal'>All rights reserved.</div></body>",
        [LONG, MORE],
    ),
    (
        f"<body><header class='site-header'><h1>Blog</h1><nav><ul><li><a href=/>Home</a></li></ul></nav></header><div class='container'><div class='content'><h1>Notes</h1><p>{LONG}</p><pre>x = 1\n  y = 2</pre><p>{MORE}</p><div class='reader-comments'><p>You forgot the mill.</p></div></div><div class='widget'><p>About me: I write.</p></div></div></body>",
        ["Notes", LONG, "x = 1 y = 2", MORE],
    ),
    (
        f"<div id=header>Logo</div><div id=menu><a href=1>A</a><a href=2>B</a></div><div id=body><h3>Plain</h3>{LONG}<br>{MORE}</div><div id=footer>Contact us</div>",
        ["Plain", f"{LONG} {MORE}"],
    ),
    (
        f"<html><body><div class=topnav><a href=/a>Start</a> <a href=/b>Archive</a></div><div class=entry><h2>{MORE}</h2><p>{LONG}</p><dl><dt>Mill</dt><dd>closed</dd></dl></div><div class=pagination><a href=/1>1</a> <a href=/2>2</a></div><div class=copyright>&copy; A. Writer, all texts under licence</div></body></html>",
        [MORE, LONG, "Mill", "closed"],
    ),
    (
        f"<body><section class='alert'><p>The office is closed on Monday.</p></section><main><div><p>{LONG}</p><div class='sponsored'><p>This boat was given to us by Boats and Sons.</p></div><p>{MORE}</p></div></main><aside><p>Written by a local.</p></aside></body>",
        [LONG, MORE],
    ),
    (
        f"<body><div class='page'><article><h1>Bridge</h1><p>{LONG}</p><h2>Mill</h2><table><tr><th>Step</th><td>three</td></tr></table><p>{MORE}</p></article><div class='comment-list'><article class='comment'><p>My aunt lived there.</p></article><article class='comment'><p>Mine too, next door.</p></article></div></div></body>",
        ["Bridge", LONG, "Mill", "Step", "three", MORE],
    ),
    (
        "<body><nav><a href=/>Home</a></nav><div class=login><form><p>Please sign in to read on.</p><input></form></div><footer>Imprint</footer></body>",
        [],
    ),
    (
        f"<body><article><p>{LONG}</p><div class='notice'>This article is for subscribers.</div><p>{MORE}</p><footer>Filed under: weather</footer></article><div class='recommended'><p>You may also like this other long story about rivers and rain.</p></div></body>",
        [LONG, MORE],
    ),
]


def test_pages_written_by_hand():
    model, hit, said, wanted, whole = html_text.made_model(), 0, 0, 0, 0
    for html, want in PAGES:
        got = [x for x in model.text(html)[0].split("\n\n") if x]
        rest = list(want)
        for x in got:
            if x in rest:
                rest.remove(x)
                hit += 1
        said, wanted, whole = said + len(got), wanted + len(want), whole + (got == want)
        if got != want:
            print(html[:60], "\n  more", [x for x in got if x not in want], "less", rest)
    print("precision", hit / said, "recall", hit / wanted, "whole pages", whole, "of", len(PAGES))
    assert hit / said >= 0.9 and hit / wanted >= 0.9
    assert "nice post" not in model.text(PAGES[0][0])[0] and LONG in model.text(PAGES[1][0])[0] and "Terms" not in model.text(PAGES[1][0])[0]


def test_model_fitted_to_given_pages(spark):
    """Labels that go against custom: here the nav is the text."""
    pages = [f"<body><nav>{html_text.MARK}menu {i} says this</nav><article><p>noise {i} noise</p></article></body>" for i in range(40)]
    model = html_text.fit(pages)
    df = spark.createDataFrame([(1, "u", "<body><nav>the text</nav><article><p>noise, noise</p></article></body>")], "page_id long, url string, html string")
    assert html_text.main_text(df, model).first().text == "the text"
