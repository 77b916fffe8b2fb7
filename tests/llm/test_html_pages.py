"""Main text of pages whose wrappers were never trained on, and what a page's own shape must decide."""

import random

import pytest

from greenspark.llm import html_main

SAID = "The council met on Tuesday to discuss the plans for the new bridge over the river."
THOUGHT = "I think this is a very good idea for our whole town."


@pytest.fixture(scope="module")
def field():
    return html_main.trained()


@pytest.mark.parametrize("page, kept", [
    (f'<ul><li><a>Home</a></li><li><a>News</a></li></ul><div class="wrap"><div class="col1"><h1>Bridge</h1><p>{SAID}</p><p>{SAID}</p></div></div>',
     ["Bridge", SAID, SAID]),
    (f'<article><h1>T</h1><p>{SAID}</p><p>{SAID}</p><section class="comments"><h3>Comments</h3><p>{THOUGHT}</p><p>No.</p></section></article>',
     ["T", SAID, SAID]),
    (f'<article><h1>T</h1><p>{SAID}</p><div class="comment-list"><p>{THOUGHT}</p><p>{THOUGHT}</p></div></article>', ["T", SAID]),
    (f'<main><h1>T</h1><p>{SAID}</p><div class="promo-box"><p>Buy now</p></div><p>{SAID}</p></main>', ["T", SAID, SAID]),
    (f'<article><h1>T</h1><p>{SAID}</p><aside><p>{THOUGHT}</p></aside><p>{SAID}</p></article>', ["T", SAID, SAID]),
    (f'<table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td><h1>T</h1><p>{SAID}</p><p>{SAID}</p></td></tr></table>', ["T", SAID, SAID]),
    (f'<table><tr><td><a href=/>Home</a></td><td><a href=/n>News</a></td></tr><tr><td>{SAID}<br>{SAID}</td></tr></table>', [f"{SAID} {SAID}"]),
    (f'<div id="q1"><div class="zz top"><a>A</a> <a>B</a></div><div class="yy"><h2>Head</h2><div>{SAID}</div><div>{SAID}</div></div><div class="vv">Imprint</div></div>',
     ["Head", SAID, SAID]),
    ("<html><body><article><p>Short.</p></article></body></html>", ["Short."]),
    (f"<p>{SAID}</p><p>{SAID}</p>", [SAID, SAID])])
def test_shape_of_the_page_decides(field, page, kept):
    assert html_main.main_text(page, field) == "\n\n".join(kept)


# wrappers and class words that the labelled pages do not have; $ few words, @ prose
UNSEEN_FURNITURE = """<div class="hx9"><span><a>$</a></span> <span><a>$</a></span> <span><a>$</a></span></div>
<ul class="qq"><li><a>$</a></li><li><a>$</a></li><li><a>$</a></li><li><a>$</a></li></ul>
<div class="j-foot7"><div>© $</div></div>
<dl><dt><a>$</a></dt><dd><a>$</a></dd></dl>
<div id="kk"><div class="uu"><ul><li><a>$</a></li><li><a>$</a></li></ul></div></div>""".split("\n")
UNSEEN_CONTENT = """<div id="z4"><div class="r2"><div class="hh"><h1>$</h1><p>@</p><p>@</p></div></div></div>
<div class="story"><h2>$</h2><p>@</p><h4>$</h4><p>@</p><p>@</p></div>
<section class="vv"><div class="ww"><p>@</p><p>@</p><p>@</p></div></section>
<div class="tt"><span>@</span><p>@</p><ol><li>@</li><li>@</li></ol></div>
<table><tbody><tr><td width=600><p>@</p><p>@</p></td></tr></tbody></table>
<center><div class="mm"><p>@</p><p>@</p></div></center>""".split("\n")
UNSEEN_INSIDE = ["", '<div class="ads-slot"><p>@</p></div>', '<div class="user-comment"><p>@</p></div>', '<aside class="qz"><p>$</p></aside>']


def test_wrappers_that_were_never_trained(field):
    rnd = random.Random(11)
    words = "garden stone letter winter bread music window paper silver morning under between carried found little early slowly".split()

    def fill(wrapper, label, truth):
        out = ""
        for c in wrapper:
            if c in "$@":
                n = rnd.randrange(1, 4) if c == "$" else rnd.randrange(12, 60)
                text = " ".join(rnd.choice(words) for _ in range(n)) + ("." if c == "@" else "") + f" n{len(truth)}"
                truth.append((text, label))
                out += text
            else:
                out += c
        return out

    right = total = 0
    for k in range(120):
        truth = []
        before = [fill(f, False, truth) for f in rnd.sample(UNSEEN_FURNITURE, rnd.randrange(0, 3))]
        content, (front, back) = UNSEEN_CONTENT[k % len(UNSEEN_CONTENT)], (None, None)
        cut = content.rindex("</p>") + 4
        front, back = content[:cut], content[cut:]
        middle = fill(front, True, truth) + fill(rnd.choice(UNSEEN_INSIDE), False, truth) + fill(back, True, truth)
        after = [fill(f, False, truth) for f in rnd.sample(UNSEEN_FURNITURE, rnd.randrange(0, 3))]
        kept = html_main.main_text("<html><body>" + "".join([*before, middle, *after]) + "</body></html>", field)
        for text, label in truth:
            total, right = total + 1, right + ((text in kept) == label)
    assert total > 700 and right >= 0.9 * total, right / total


def test_training_all_chains_together_equals_the_gradient_of_the_likelihood():
    import itertools

    import numpy as np

    chains = [[(("a",), 1), (("b", "c"), 0), (("a", "c"), 1)], [(("c",), 0)], [(("b",), 1), (("a", "b"), 1)]]

    def likelihood(field):
        out = 0.0
        for chain in chains:
            def worth(y, chain=chain):
                return sum(field.score(f)[k] for (f, _), k in zip(chain, y, strict=True)) + sum(field.move[i, j] for i, j in itertools.pairwise(y))
            out += worth([y for _, y in chain]) - np.log(sum(np.exp(worth(y)) for y in itertools.product((0, 1), repeat=len(chain))))
        return out - 0.05 / 2 * len(chains) * ((field.emit ** 2).sum() + (field.move ** 2).sum())

    best = html_main.train(chains, rounds=800, decay=0.05, least=1)
    top = likelihood(best)
    rnd = np.random.default_rng(1)
    for _ in range(30):
        moved = html_main.Field(best.names, best.emit + rnd.normal(0, 0.05, best.emit.shape), best.move + rnd.normal(0, 0.05, best.move.shape))
        assert likelihood(moved) < top + 1e-6
    assert html_main.train([]).decode([("a",)]) == [0]


def test_deeply_nested_page_stays_small(field):
    assert html_main.main_text("<div class='a b'>" * 20_000 + f"<p>{SAID}</p>", field) == SAID
