"""HTML extraction: the article of every given page, and hand-made pages."""

import html
import re

import pyarrow.parquet as pq

from ledgerlens.llm.html_text import blocks, extract, extract_text, stop_density
from ledgerlens.llm.queries import QUERIES

from .conftest import SF

PROSE = ("The work of the group was shown to the public in the spring, and it is now on view at the hall for the "
         "rest of the year. It was not planned that way, but the board was for it and the town was with them.")


def article_by_hand(page):
    body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", body))
    return "\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts) if x)


def test_query_against_marked_articles(llm):
    pages = {r["page_id"]: r for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    got = QUERIES["op3_html_text"](llm, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])
        assert r["text"] == article_by_hand(pages[r["page_id"]]["html"])


def test_everything_around_an_article_goes():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1><p>{PROSE}</p></header>
    <div class="cookie-notice"><p>{PROSE}</p></div><nav><a href="/">Home</a></nav>
    <main><article id=a1><h1>Head &amp; line</h1><p>{PROSE}</p><p>Short.</p><aside><p>{PROSE}</p></aside>
    <div class='ad'>Buy &lt;now&gt;</div><script>var x = "<p>{PROSE}</p>";</script><!-- <p>{PROSE}</p> -->
    <form action="x"><label>Mail</label><p>{PROSE}</p><select><option>One</select></form>
    <ul><li>first<li>second &copy;</ul><p>a <b>b</b>c&nbsp;d<br>e</p>
    <section class="comments"><article><p>{PROSE}</p></article></section></article></main>
    <div id="sidebar"><p>{PROSE}</p></div><footer><p>{PROSE}</p></footer></body></html>"""
    assert extract(page) == "\n".join(["Head & line", PROSE, "Short.", "first", "second ©", "a bc d e"])


def test_pages_without_marks_use_both_passes():
    menu = "".join(f'<div><a href="/{x}">Link {x}</a></div>' for x in range(5))
    page = f"<body>{menu}<h2>The title</h2><div>{PROSE}</div><div>Yes.</div><div>{PROSE}</div>{menu}<div>Imprint</div>{menu}</body>"
    assert extract(page) == f"The title\n{PROSE}\nYes.\n{PROSE}"
    # long unlinked text in no language listed is the page's prose where there is no other
    noise = ("qwx zzk vbn " * 12).strip()
    assert extract(f"<div>{noise}</div><div>ok</div><div>{noise}</div>") == f"{noise}\nok\n{noise}"
    assert extract("<p>Only this") == "Only this" and stop_density(PROSE) > 0.3


def test_broken_markup():
    assert extract(None) == extract("") == extract("<!-- x") == extract("<script>x") == ""
    assert extract(f"<article><p title='a>b' {PROSE}") == ""
    assert extract(f"<article><p title=\"it's\">{PROSE}</p> 1 < 2 & 3 &#233;&eacute;") == PROSE + "\n1 < 2 & 3 éé"
    assert extract(f"<nav><ul><li>x<article><p>{PROSE}") == PROSE
    assert extract("<article>" + "<div>" * 3000 + PROSE) == PROSE
    assert len(blocks("<p>" + "a<b>" * 20_000)) == 1 and extract("<a '" * 30_000) == ""


def test_marked_loose_elements_end():
    for marked in ('<p class="share">Share</p>', '<p class="share">Share', '<p hidden>Share</p>', '<ul><li class="share">Share</li><li>Kept</ul>',
                   '<ul><li class="share">Share<ul><li>Share</li></ul><li>Kept</ul>', '<dl><dd class="share">Share<dt>Kept</dl>',
                   '<table><tr><td class="sidebar"><p>Share</p><table><tr><td>Share</td></table></td><td>Kept</td></table>',
                   '<table><tr><td class="sidebar">Share<tr><td>Kept</table>', '<table><tr class="ad"><td>Share</td><td>Share</tr><tr><td>Kept</table>'):
        kept = "Kept\n" if "Kept" in marked else ""
        assert extract(f"<article><p>{PROSE}</p>{marked}<p>{PROSE}</p></article>") == f"{PROSE}\n{kept}{PROSE}", marked
    assert extract(f'<article><p class="share">Share<div>{PROSE}</div></article>') == PROSE


def test_custom_and_self_closed_elements_swallow_nothing():
    for tag in ("<svg-icon>", "<video-player src=x>", "<object-view></object-view>", "<svg viewBox='0 0 1 1'/>", '<svg title="a>b" />', "<math/>"):
        assert extract(f"<article><p>{PROSE}</p>{tag}<p>{PROSE}</p></article>") == f"{PROSE}\n{PROSE}", tag
        assert extract(f"<article>{tag}<p>{PROSE}</p><svg><text>no</text></svg></article>") == PROSE, tag
    assert extract(f"<article-list><p>{PROSE}</p></article-list><nav-bar></nav-bar><p>{PROSE}</p>") == f"{PROSE}\n{PROSE}"
    assert extract(f"<svg\n><p>no</p></svg><p>{PROSE}</p><svg><p>no") == PROSE


def test_content_is_one_piece_of_evidence():
    links = "<ul>" + "".join(f'<li><a href="/{x}">Other story {x}</a></li>' for x in range(5)) + "</ul>"
    noise = "qwx zzk vbn " * 12
    # lists of links inside, with the heading over them and what stands between them; prose, by-line and other languages stay
    page = f"<article><h1>Title</h1><p>By <a>Jo</a></p><p>{PROSE}</p><p>Yes.</p><p>{noise}</p><p>{PROSE}</p><h3>More</h3>{links}<p>{noise}</p>{links}</article>"
    assert extract(page) == "\n".join(["Title", "By Jo", PROSE, "Yes.", noise.strip(), PROSE])
    assert extract(f"<main><h1>Title</h1>{links}<p>{PROSE}</p><p>End.</p></main>") == f"Title\n{PROSE}\nEnd."
    assert extract(f"<main><p>{noise}</p>{links}<p>{noise}</p></main>") == f"{noise.strip()}\n{noise.strip()}"
    assert extract(f"<main><p><a>{PROSE[:90]}</a>{PROSE[90:]}</p><p>{PROSE}</p></main>") == f"{PROSE}\n{PROSE}"
    # prose in a div beside article cards, its heading and short blocks; unmarked bits around an article go
    cards = "".join(f'<article><h3><a href="/{x}">Card {x}</a></h3></article>' for x in range(3))
    got = extract(f"<body><h1>Title</h1><div>{PROSE}</div><div>Yes.</div><div>{PROSE}</div>{cards}</body>").split("\n")
    assert got[:4] == ["Title", PROSE, "Yes.", PROSE]
    assert extract(f"<div>Imprint</div>{links}<article><p>{PROSE}</p></article><div>{noise}</div><div>Imprint</div>") == PROSE
    assert extract(f"<article><p>{PROSE}</p></article><div>Imprint</div>") == PROSE


def test_wrappers_are_not_around():
    text, part = f"<p>{PROSE}</p><p>{PROSE}</p>", f"<p>Part {PROSE}</p>"
    for start in ('<body class="single has-sidebar">', '<body class="sidebar" style="display:none">', '<div class="layout with-sidebar">',
                  '<div class="comments-open">', '<form id="aspnetForm">', '<div class="sidebar-right">', '<div id="search"><div class=widget>'):
        side = f'<div class="sidebar">{part}</div><div class="comment-list">{part}</div><footer>{part}</footer>'
        assert extract(f"{start}{text}{side}") == extract(f"{start}<article>{text}</article>{side}") == f"{PROSE}\n{PROSE}", start
    for start in ('<article class="post comments-open">', '<main id="search">', '<article class="post hidden x">', '<div class="widget"><main>'):
        assert extract(f"{start}{text}") == f"{PROSE}\n{PROSE}", start
    # what is around stays around, however much of it there is
    many = f"<article>{part}</article>" * 5
    for name in ("comments", "comment-list", "cookie-notice", "post-comments", "ad-300x250", "sidebar-2", "widget__inner"):
        assert extract(f'<div>{text}</div><div id="{name}">{many}</div>') == f"{PROSE}\n{PROSE}", name
        assert extract(f'<article><p>{PROSE[:130]}</p></article><div class="x {name}">{many}</div>') == PROSE[:130].strip(), name
    assert extract(f'<div class="cookie-consent">{text}</div>') == extract(f"<div hidden>{text}</div>") == extract(f"<article hidden>{text}") == ""
    deep = '<div class="widget">' * 3000
    assert extract(deep + text) == f"{PROSE}\n{PROSE}"


def test_rows(llm):
    df = llm.createDataFrame([(1, "u", None, "x"), (1, None, "<p>a</p>", "y"), (None, "v", "<main><p>" + "word " * 50_000, "z")],
                             "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["url"] or "", r["n_chars"]) for r in extract_text(df).collect()))
    assert got == [(0, "v", 249_999), (1, "", 1), (1, "u", 0)]
    assert extract_text(df.limit(0)).count() == 0


OTHER = {
    "it": "Il consiglio comunale ha approvato ieri sera un nuovo progetto per la biblioteca. I lavori cominceranno in autunno e dureranno due anni, "
          "mentre gli uffici resteranno aperti nella sede di via Roma. Secondo il sindaco, ogni quartiere avrà presto una sala di lettura.",
    "pl": "Rada miasta przyjęła wczoraj wieczorem nowy projekt biblioteki. Prace rozpoczną się jesienią i potrwają dwa lata, a biura pozostaną "
          "otwarte przy ulicy Długiej. Według burmistrza każda dzielnica będzie wkrótce miała własną czytelnię.",
    "ru": "Городской совет вчера вечером одобрил новый проект библиотеки. Работы начнутся осенью и продлятся два года, а отделы останутся "
          "открытыми на главной улице. По словам мэра, скоро в каждом районе появится свой читальный зал.",
    "zh": "市议会昨晚通过了新图书馆的建设方案。工程将于秋季开始，预计持续两年，期间办公室仍在中山路开放。市长表示，每个城区很快都会有自己的阅览室，居民可以免费借阅图书、报纸和杂志，并参加周末的讲座。",
    "ja": "市議会は昨夜、新しい図書館の計画を承認した。工事は秋に始まり二年間続く見込みで、その間も事務所は本町通りで開いている。市長によると、まもなくすべての地区に閲覧室が設けられ、住民は無料で本を借りられる。",
    "fi": "Kaupunginvaltuusto hyväksyi eilen illalla uuden kirjastohankkeen. Työt alkavat syksyllä ja kestävät kaksi vuotta, mutta toimistot "
          "pysyvät avoinna Pääkadulla. Pormestarin mukaan jokaiseen kaupunginosaan tulee pian oma lukusali.",
    "tr": "Belediye meclisi dün akşam yeni kütüphane projesini onayladı. Çalışmalar sonbaharda başlayacak, iki yıl sürecek; ofisler ana caddede "
          "açık kalacak. Belediye başkanına göre yakında her mahallede bir okuma salonu bulunacak.",
    "ar": "وافق مجلس المدينة مساء أمس على مشروع المكتبة الجديدة. تبدأ الأعمال في الخريف وتستمر عامين، بينما تبقى المكاتب مفتوحة في الشارع الرئيسي. "
          "وقال رئيس البلدية إن كل حي سيحصل قريبا على قاعة للقراءة يستعير منها السكان الكتب مجانا.",
}


def test_languages_without_a_list_and_without_marks():
    menu = "<ul>" + "".join(f'<li><a href="/{x}">Seite {x}</a></li>' for x in range(5)) + "</ul>"
    for code, text in OTHER.items():
        want = f"Titolo\n{text}\n{text[:20]}\n{text}"
        body = f"<h2>Titolo</h2><div>{text}</div><div>{text[:20]}</div><div>{text}</div>"
        assert extract(f"<title>T</title>{menu}{body}{menu}") == want, code
        assert extract(f"<nav>{menu}</nav><div class=\"cookie-notice\">{PROSE}</div>{body}<footer>{PROSE}</footer>") == want, code
        assert extract(f"<article>{body}</article><div>{menu}</div>") == want, code
        assert extract(f"<div>{text}</div>") == text, code
    # one such block among prose that is served stays, one among links goes
    other = OTHER["it"]
    assert extract(f"<div>{PROSE}</div><div>{other}</div><div>{PROSE}</div>") == f"{PROSE}\n{other}\n{PROSE}"
    assert extract(f"<div>{PROSE}</div><div>{PROSE}</div>{menu}<div>{other[:120]}</div>{menu}") == f"{PROSE}\n{PROSE}"


def test_reference_lists_stay_lists_of_links_go():
    names = ["Smith, J. and Brown, K.", "Olsen, P., Weber, T.", "Garcia, M."]
    refs = "".join(f'<li>{n} (20{i}1): <a href="/{i}">A title of paper {i} on libraries</a>, Journal of Halls {i}</li>' for i, n in enumerate(names))
    text = "\n".join(f"{n} (20{i}1): A title of paper {i} on libraries, Journal of Halls {i}" for i, n in enumerate(names))
    page = f"<article><h1>Title</h1><p>{PROSE}</p><h2>References</h2><ol>{refs}</ol></article>"
    assert extract(page) == f"Title\n{PROSE}\nReferences\n{text}"
    links = "".join(f'<li><a href="/{i}">Another story number {i} of the day</a></li>' for i in range(4))
    assert extract(f"<article><h1>Title</h1><p>{PROSE}</p><h2>More</h2><ul>{links}</ul></article>") == f"Title\n{PROSE}"
