"""Pages that are long, broken, in other languages or full of others' articles; and what each pass decides."""

import random
import time

import pytest

from tessera.llm import html_text

PROSE = "This is the long text of an article that has many of the words which one finds in such a text, and it goes on for a while so that it is not short."

RUSSIAN = "В начале было слово, и каждый житель города знал, что весна придёт поздно, а река вскроется только к маю, когда лёд станет тонким и серым, как старая бумага на окнах."
CHINESE = "城市的每一位居民都知道春天会来得很晚，河流要到五月才会解冻，那时冰会变得又薄又灰，就像窗户上的旧纸一样，孩子们在岸边等待着第一艘船从南方驶来，老人们则坐在门前谈论过去的岁月和远方的亲人。"
POLISH = "Każdy mieszkaniec miasta wiedział, że wiosna przyjdzie późno, a rzeka ruszy dopiero w maju, gdy lód stanie się cienki i szary jak stary papier w oknach domów nad brzegiem."


@pytest.mark.parametrize("text", [RUSSIAN, CHINESE, POLISH])
def test_languages_without_a_list(text):
    page = f"<body><nav><a href=/>{text}</a></nav><div><h1>{text[:12]}</h1><p>{text}</p><p>{text[:20]}</p><p>{text}</p></div><footer>{text}</footer></body>"
    assert html_text.main_text(page) == f"{text[:12]}\n{text}\n{text[:20]}\n{text}"
    assert html_text.main_text(f"<article><p>{text}</p><ul><li><a>{text}</a></li></ul></article>") == text


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (f"<article><p>{PROSE}</p></article><article class='sponsored ad'><p>{PROSE}</p></article>", PROSE),
        (f"<main><p>{PROSE}</p><article class='comment'><p>{PROSE}</p></article><article id='comment-12 body' class=reply><p>{PROSE}</p></article></main>", PROSE),
        (f"<main><article class='promo-box'><article><p>{PROSE}</p></article></article><p>{PROSE}</p></main>", PROSE),
        (f"<article class='post has-comments comments-open'><p>{PROSE}</p></article>", PROSE),
        (f"<article class='related-work'><p>{PROSE}</p></article>", PROSE),
        (f"<div id=comments><div id=respond><p>x</p></div><article><p>{PROSE}</p></article></div><div><p>{PROSE}</p></div>", PROSE),
    ],
)
def test_articles_of_others(page, expected):
    assert html_text.main_text(page) == expected


@pytest.mark.parametrize(
    "piece",
    ["<a ", "<div>", "</p>", "<a href='", '<a href="x', "<!-- ", "<!", "<svg>", "<select><p>", "<", "<p <b", "<button><canvas>", "<x y=' z=\" >", "<table><tr><td>", "<form><article class=ad>"],
)
def test_time_is_linear_in_the_page(piece):
    def seconds(n):
        page = f"<article><p>{PROSE}</p>" + piece * n + "</p></article>" + "</div>" * (n // 4)
        began = time.perf_counter()
        html_text.main_text(page)
        return time.perf_counter() - began

    seconds(1000)
    few, many = max(min(seconds(20_000) for _ in range(2)), 0.02), min(seconds(160_000) for _ in range(2))
    assert many < 24 * few


def test_tags_against_a_plain_reader():
    """On random markup with closed quotes: the tags are those of a pattern that looks at one tag at a time."""
    import re

    tag = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
    rng, seen = random.Random(4), 0
    pieces = ["<p>", "</p>", "<a href='x>y'>", '<b t="<i>">', "<!-- c -->", "<!doctype html>", "text", " < ", "<br/>", "<x y=1 z>", "&amp;", "\n", "<?xml?>", "> "]
    for _ in range(2000):
        page = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        tags, at, found = html_text.Tags(page), 0, []
        while (t := tags.next(at)) is not None:
            found.append((t.start, t.end, t.name, t.closing, t.raw))
            at = t.end
        assert found == [(m.start(), m.end(), (m[2] or "").lower(), bool(m[1]), m[3] or "") for m in tag.finditer(page)]
        seen += len(found)
    assert seen > 5000


def test_first_pass_by_its_measures():
    """The label of a block against its measures computed word by word, for all combinations of zone, links, length and stop words."""
    rng = random.Random(2)
    for _ in range(2000):
        words = [rng.choice(["the", "of", "Mmrx,", "kqpt", "zzyx.", "and"]) for _ in range(rng.choice([1, 3, 8, 20, 60]))]
        text = " ".join(words)
        block = html_text.Block(text, rng.choice([0, len(text) // 3, len(text)]), rng.choice([0, 1, 2]), False)
        known = rng.random() < 0.7
        share = sum(w in ("the", "of", "and") for w in words) / len(words)
        if block.zone == 0 or 2 * block.linked > len(text):
            expected = html_text.AWAY_LABEL
        elif not known:
            expected = html_text.TEXT if len(text) >= 140 else html_text.OPEN
        elif block.zone == 1:
            expected = html_text.TEXT if len(text) >= 140 or share >= 0.12 else html_text.OPEN
        elif len(text) < 140:
            expected = html_text.TEXT if share >= 0.3 and len(words) >= 8 else html_text.OPEN
        else:
            expected = html_text.TEXT if share >= 0.12 else html_text.AWAY_LABEL
        assert html_text.first_pass(block, known) == expected


def test_clashing_names(spark):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{PROSE}</p></article>", "x", 3)], "page_id bigint, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in html_text.extract(pages).collect()] == [(1, "u", PROSE, len(PROSE))]
