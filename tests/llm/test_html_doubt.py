"""Pages whose names, forms and tags rule out too much, and pages that would take long."""

import time

import pytest

pytest.importorskip("tidemark.llm.queries")
from tidemark.llm.html_extract import main_text

LONG = "The house of the old man is in the valley and it was built by the people who came from the sea to live there with all of their animals and the trees. It is the best of all that there are in the land."
P = f"<p>{LONG}</p>"
MENU = "<ul><li><a href=x>Home</a></li><li><a href=y>More of this</a></li></ul>"


@pytest.mark.parametrize("page", [
    f'<body><div class="page comments-open">{MENU}{P}{P}</div></body>', f'<body><div class="elementor widget">{P}{P}</div></body>', f'<body><div class="site social-theme">{MENU}{P}{P}</div></body>', f'<body><form id="aspnetForm"><input name=a>{P}{P}</form></body>',
    f"<body><form><article>{P}{P}</article></form></body>", f"<body><nav>{MENU}<article>{P}{P}</article></body>", f'<body>{P}{P}<div class="comments">{P}{P}{P}</div></body>', f'<body><article>{P}{P}<ol class="responses"><li>{P}</li></ol><div class="cta-box">Buy now</div><div class="more-stories"><p>Other things</p></div></article></body>',
])
def test_article_is_found(page):
    assert main_text(page) == f"{LONG} {LONG}"


def test_pages_without_a_decided_block():
    short = [f"Kissa {k} istui matolla ja katseli ulos kun sade ropisi pihalla." for k in range(20)]
    assert main_text(f"<body>{MENU}" + "".join(f"<p>{x}</p>" for x in short) + "<footer>(c)</footer></body>") == " ".join(short)
    table = "".join(f"<tr><td>name {k}</td><td>{k * k}</td></tr>" for k in range(30))
    assert main_text(f"<body>{MENU}<table>{table}</table>{MENU}</body>") == " ".join(f"name {k} {k * k}" for k in range(30))
    assert main_text(f"<body>{MENU}</body>") == main_text("<nav>a</nav>") == ""


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</ul>" * 20_000, "<!" * 100_000, "<?" * 100_000, "<a ='" * 40_000, "<a href=x><p>" * 16_000, '<div class="comments">' * 9_000 + P, "<b class=ad>" * 16_000])
def test_hostile_pages_are_quick(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 3
