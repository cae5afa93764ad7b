"""Pages whose text only the rules can find: other languages, odd attributes, names of comments and adverts."""

import pytest

from tidemark.llm.html_text import main_text

TEXTS = {
    "zh": "这是一个关于城市交通的新闻报道，记者昨天在现场看到了许多人。政府表示将继续改善公共交通系统。",
    "ja": "昨日、市内に新しい図書館が開館し、多くの市民が訪れました。館長は今後の計画について話しました。",
    "ru": "Вчера в городе открылась новая библиотека, куда пришли сотни жителей. Директор рассказал о планах на будущее.",
    "it": "Ieri è stata aperta una nuova biblioteca nel centro della città, dove sono arrivati centinaia di abitanti.",
    "en": "The council met on the second day of the month and it was said that the plans for the new bridge are to be drawn up.",
    "de": "Der Rat kam am zweiten Tag des Monats zusammen und es hieß, dass die Pläne für die neue Brücke nun gezeichnet werden.",
}
SHELLS = [
    "<body><nav><a href=/>x</a> <a href=/y>y</a></nav><div class='content'><h1>{h}</h1><p>{t}</p><p>{t}</p></div><footer>© us, all of it</footer></body>",
    "<body><div class=menu><ul><li><a href=/>x</a><li><a href=/y>y</a></ul></div><div><p>{t}</p><p>{t}</p></div><div id='cookie-law-info-bar'>{t}</div></body>",
    "<body><div id=mainMenu>{t}</div><table><tr><td><p>{t}</p><p>{t}</p></td></tr></table><div class='related-posts'><p>{t}</p></div></body>",
    "<body><form id=f><div class='page-wrap'><p>{t}</p><div class='ad-slot-inline'>{t}</div><p>{t}</p></div></form><div class=commentlist><p>{t}</p></div></body>",
]


@pytest.mark.parametrize("lang", TEXTS)
@pytest.mark.parametrize("k", range(len(SHELLS)))
def test_pages_without_article(lang, k):
    t = TEXTS[lang]
    want = f"{t}\n{t}" if k else f"{t[:6].strip()}\n{t}\n{t}"
    assert main_text(SHELLS[k].format(t=t, h=t[:6].strip())) == want


def test_single_short_blocks():
    assert main_text("<body><p>Short news.</p></body>") == "Short news."
    assert main_text("<nav><a href=/>Home</a></nav><p>Short news.</p><footer>foot</footer>") == "Short news."
    assert main_text("<nav><a href=/>Home</a></nav><footer>foot</footer>") == main_text("") == ""


@pytest.mark.parametrize("tag", ["<img alt='it's'>", "<i data-t=it's>", '<i data-q=a"b>', "<i title='>'>", '<i title="see hidden here">', "<i '>", "<i a=>", "<i x='1'y=\"2\">"])
def test_attributes(tag):
    t = TEXTS["en"]
    assert main_text(f"<article><p>{tag}{t}</p><p>It's \"so\".</p></article>") == f"{t}\nIt's \"so\"."


@pytest.mark.parametrize("attr", ["hidden", "hidden=''", "HIDDEN", "aria-hidden=true", "style='color:red; display : none'", 'style="visibility:hidden"'])
def test_hidden(attr):
    t = TEXTS["en"]
    assert main_text(f"<article><p>{t}</p><p {attr}>{t} gone</p><div title=x {attr}><p>{t} gone</p></div></article>") == t


@pytest.mark.parametrize("name", ["article-comments", "post-comments", "commentlist", "comment-body", "comment-content", "ad-slot-inline", "cookie-law-info-bar", "post-footer", "author-box", "main-menu", "mainMenu", "x sidebar-left"])
def test_names_of_boilerplate(name):
    t = TEXTS["en"]
    for kind in ("class", "id", "role"):
        assert main_text(f"<article><p>{t}</p><div {kind}='{name}'><section><p>{t} gone</p></section></div><p>{t}</p></article>") == f"{t}\n{t}"


@pytest.mark.parametrize("name", ["post-header", "entry-content", "content-sidebar-wrap", "no-sidebar", "hasFooter has-footer", "commentary", "page-content", "banner-story", "headline"])
def test_names_of_content(name):
    t = TEXTS["en"]
    assert main_text(f"<div class='{name}'><p>{t}</p></div>") == main_text(f"<article><div class='{name}'><p>{t}</p></div></article>") == t


def test_words_in_named_phrases():
    assert main_text("<article><p>The <span class='share'>share</span> of the market has <span class=ad>Buy!</span>grown by a lot.</p></article>") == "The share of the market has grown by a lot."


def test_long_attributes_are_linear():
    main_text("<a b=\"" * 40_000)
    main_text("<p " + "x=' " * 100_000)
    main_text("<p " + "a b " * 100_000 + "<div " * 20_000)
