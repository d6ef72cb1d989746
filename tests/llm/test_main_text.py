"""Main text of pages whose markup misleads."""

import pytest

from tickloom.llm import tagpaths
from tickloom.llm.tagpaths import main_text

LINE = "The river had risen overnight, and the people of the town, who were used to it, moved their things upstairs; nobody complained."
STORY = f"<p>{LINE}</p>" * 6
SIDE = "<nav><ul><li>Home</li></ul></nav><div class='sidebar'><p>About me.</p></div>"


@pytest.mark.parametrize(
    "body",
    [
        f"<div>{STORY}</div>{SIDE}",
        f"<div class='story'>{STORY}</div><article class='teaser'><span>Read more</span></article>",
        f"<div class='content with-sidebar'>{STORY}{SIDE}</div>",
        f"<article class='has-comments'>{STORY}<div class='comments'><p>Nice.</p></div></article>",
        f"<form><div>{STORY}</div></form>",
        f"<article>{STORY}</article><div class='comments'>{STORY * 3}</div>",
        f"<article>{STORY}<div class='x'><div>Tags</div></div></article>",
    ],
)
def test_story_is_kept(body):
    assert [x for x in main_text(f"<html><body>{body}</body></html>").split("\n") if x != "Read more"] == [LINE] * 6


def lines(body):
    return main_text(f"<html><body>{body}</body></html>").split("\n")


def test_ratios_decide_without_names():
    """Paths of links and of short texts go, with no name or tag to tell them by."""
    links = "<div><div>" + "".join(f"<a href='/{i}'>Read how town {i} met the river, again.</a>, " for i in range(9)) + "</div></div>"
    short = "<div>" + "".join(f"<section>Item {i}</section>" for i in range(9)) + "</div>"
    assert lines(f"{links}<div><h2>Flood</h2>{STORY}</div>{short}") == ["Flood", *[LINE] * 6]


@pytest.mark.parametrize(
    "body,more",
    [
        (f"<div id='side-story'>{STORY}</div>{SIDE}", []),
        (f"<article>{STORY}<div class='box17'><p>Buy now</p></div></article>", []),
        (f"<article>{STORY}<p class='alert'>{LINE}</p><p class='legal'>{LINE}</p></article>", [LINE, LINE]),
        (f"<article>{STORY}<ul><li>One thing</li><li>Another</li></ul></article>", ["One thing", "Another"]),
        (f"<article>{STORY}<ul><li><a href='/a'>More</a></li></ul></article>", []),
        (f"<article><h1>Flood</h1>{STORY}</article><div><h2>Pick</h2><p>Cheap</p></div>", None),
        (f"<article>{STORY}<section id='comments'><p>{LINE}</p></section></article>", []),
    ],
)
def test_names_do_not_decide(body, more):
    assert lines(body) == (["Flood", *[LINE] * 6] if more is None else [LINE] * 6 + more)


def test_other_ratios_give_other_texts(monkeypatch):
    """The text hangs on the ratios: turned upside down they keep what was dropped."""
    page = f"<html><body><div>{STORY}</div><section><div>Short.</div></section></body></html>"
    assert main_text(page).split("\n") == [LINE] * 6
    monkeypatch.setattr(tagpaths, "_smoothed", lambda ratio, paths: 1 / (1 + ratio))
    assert main_text(page) == "Short."


def test_long_page():
    page = f"<html><body><nav><a href='/'>Home</a></nav><div>{STORY * 3000}</div></body></html>"
    assert main_text(page) == "\n".join([LINE] * 18_000)


SHORT = "It rained."
TWO = f"<p>{LINE}</p><p>{LINE}</p>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<h1>Title</h1><p class='byline'>By A</p>{TWO}", ["Title", "By A", LINE, LINE]),
        (f"<h1>Title</h1><p class='intro'>{SHORT}</p>{TWO}", ["Title", SHORT, LINE, LINE]),
        (f"<h1>Title</h1><div class='lead'>{SHORT}</div>{TWO}", ["Title", SHORT, LINE, LINE]),
        (f"<h1>Title</h1><div class='meta'>May 3</div>{TWO}", ["Title", "May 3", LINE, LINE]),
        (f"<header><h1>Title</h1><p>By A</p></header>{TWO}", ["Title", "By A", LINE, LINE]),
        (f"<section class='a'><h2>One</h2>{TWO}</section><section class='b'><h2>Two</h2><p>{SHORT}</p></section>", ["One", LINE, LINE, "Two", SHORT]),
        (f"{TWO}<div><div><p>{SHORT}</p></div></div>", [LINE, LINE, SHORT]),
        (f"<p>{LINE} <span class='advert'>Buy <b>now</b></span></p><p>{LINE}</p>", [LINE, LINE]),
        (f"<p>{LINE} <span class='advert'>Buy <span>now</span></p><p>{LINE}</p>", [LINE, LINE]),
        (f"<h2>One</h2><h3>Part</h3>{TWO}<h2>Links</h2><ul><li><a href='/a'>More</a></li></ul>", ["One", "Part", LINE, LINE]),
        (f"<p>{LINE}</p><blockquote><p>{SHORT}</p></blockquote><div class='ad'>Buy</div><p>{LINE}</p>", [LINE, SHORT, LINE]),
        (f"<h1>Title</h1>{TWO}<form><p>Your mail</p></form><p class='x'>{SHORT}</p>", ["Title", LINE, LINE, SHORT]),
    ],
)
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<nav><a href='/'>Home</a></nav><main><article>{}</article></main><footer>End</footer>"])
def test_article_stays_whole(body, want, frame):
    """Headlines, bylines, leads, headers of the article and short sections stay; what is none of the article goes."""
    assert lines(frame.format(body)) == want


def test_ratios_by_brute_force():
    """Sums, smoothing and fusion of a page against their definition, node by node."""
    page = f"<body><div><p>{LINE}</p><p>{SHORT}</p><p>{LINE} {LINE}</p></div><section><ul><li>{SHORT}</li><li><a>Some link here</a></li></ul></section><div><p>{LINE}</p></div></body>"
    nodes = tagpaths._blocks(page)
    paths = [b.path for b in nodes]
    own, marks = {}, {}
    for b in nodes:
        own.setdefault(b.path, []).append(len(b.text) - b.linked)
        marks.setdefault(b.path, []).append(1 + sum(c in ".,;:!?-" for c in b.text) * (1 - b.linked / len(b.text)))
    mean = lambda x, p: sum(x[p]) / len(x[p])
    seen = []

    def spied(ratio, given):
        seen.append(list(ratio))
        out = []
        for i, p in enumerate(paths):
            top, base = mean(own if len(seen) == 1 else marks, p), 1.0
            for j in (i - 1, i + 1):
                if 0 <= j < len(paths):
                    shared = 0
                    while shared < min(len(p), len(paths[j])) and p[shared] == paths[j][shared]:
                        shared += 1
                    w = 2.718281828459045**-0.5 * (1 / 16) ** (max(len(p), len(paths[j])) - shared)
                    top, base = top + w * mean(own if len(seen) == 1 else marks, paths[j]), base + w
            out.append(top / base)
        assert list(real(ratio, given)) == pytest.approx(out)
        return real(ratio, given)

    real, tagpaths._smoothed = tagpaths._smoothed, spied
    try:
        assert main_text(page).count("\n") == 3
    finally:
        tagpaths._smoothed = real
    assert seen[0] == pytest.approx([mean(own, p) for p in paths]) and seen[1] == pytest.approx([mean(marks, p) for p in paths])
