"""Names of classes and ids on wrappers of an article and inside it."""

import pytest

from tessera.llm import page_text

WORDS = "word " * 40

CASES = {
    f'<h1>Title here</h1><div class="site has-sidebar"><article><p>{WORDS}</p></article></div>': WORDS.strip(),
    '<p>Tagline</p><div class="content-widget"><main><p>main text here</p></main></div>': "main text here",
    '<article><p>one</p><p class="social">two</p><section id="privacy"><p>three</p></section><h2 id="comments">four</h2></article>': "one\ntwo\nthree\nfour",
    '<article><p>one</p><div class="ad">buy</div><div id="comments"><p>nice</p></div><ul class="share"><li>x</li></ul></article>': "one",
    '<article><p>one</p></article><div class="related"><article>teaser</article></div>': "one",
    '<article><p>one</p><section id="comments"><p>nice</p></section></article>': "one",
    '<aside><article>teaser</article></aside><p>the page has no article that is read</p>': "the page has no article that is read",
    '<article><p>let <math><mi>x</mi></math> be</p><p><label>a label</label></p></article>': "let x be\na label",
    '<div class="footer"><p>only text</p></div>': "only text",
}


@pytest.mark.parametrize("html", CASES)
def test_names_of_parts(html):
    assert page_text.main_texts([html]) == [CASES[html]]
