"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read tag by tag; a leaf block is the text between two block-level tags.  Its features are the tags and the
class and id words of its ancestors, those of the innermost section or marked element once more, its own tag, length, link share and ending of its text, and what it is to its page:
the share of the page's prose that stands in its parent and in the parent's parent, the kinds of the blocks before and after
it, how many blocks of its kind stand beside it, and whether it stands before, in or after the element with the most prose.
The field scores each block's label (content or furniture) and each pair of neighbouring labels; it is trained on labelled
pages by gradient ascent on the likelihood (forward-backward) and decoded by Viterbi.

The labelled pages are made by rule from lists of content and furniture wrappers, see ``labelled_pages``.  Two thirds of them carry
no telling class word, only layout words and meaningless ones, so that the field does not depend on known names; a feature
seen on one labelled page only is not learnt.  Furniture, comments and adverts included, also stands inside the content.

Defined results: a null or empty page has an empty text; unclosed and unopened tags are repaired as a browser would
(a new paragraph ends the last one, a closing tag ends all tags inside it); comments, scripts, styles, drawings, templates and
markup never reach the text; a drawing ends where a paragraph or the like starts in it; a drawing, template, noscript or iframe that is
closed in its own tag or nowhere is empty, so the text after it stays; a page without any content block gives an empty text; repeated rows give equal rows; ties in the decoding go to furniture;
other columns stay unread.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Kinds of HTML tags.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol optgroup option p pre section select summary table tbody
td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe".split())
DROPPED = frozenset("svg template noscript".split())
ENDS_SVG = frozenset("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta
nobr ol p pre ruby s small span strong strike sub sup table tt u ul var""".split())
IN_SVG = frozenset("foreignobject desc title template noscript".split())
SECTIONS = frozenset("article aside footer form header main nav section table".split())
TELLING = BLOCK - {"html", "body"}  # all blocks stand in these two
ENDS_PARAGRAPH = BLOCK - {"option", "optgroup"}
SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",)}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>?", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")


def blocks_of(html: str | None) -> list[tuple[str, tuple[str, ...], float, bool]]:
    """(text, structure features, share of the text inside links, label mark) of the leaf blocks in page order."""
    out: list = []
    if not html:
        return out
    stack: list[tuple[str, tuple[str, ...], bool]] = [("#", (), False)]
    places: list[tuple[int, int]] = []  # parent and parent's parent of each block, by the number of their tags
    numbers = [0]  # of the open tags
    made = 0
    parts: list[str] = []
    linked = 0
    hidden = 0  # place in the stack of the outermost dropped element
    last: dict[str, int] = {}
    at, end = 0, len(html)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                above = []
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in BLOCK or not k:
                        above.append(k)
                        if len(above) == 3:
                            break
                own, parent, higher = (above + [0, 0])[:3]
                places.append((numbers[parent], numbers[higher]))
                out.append((text, (*stack[-1][1], "leaf:" + stack[own][0]), min(1.0, linked / len(text)), stack[-1][2]))
            parts.clear()
            linked = 0

    def close(names: tuple[str, ...], within: frozenset | None = None) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                del stack[k:], numbers[k:]
                return
            if within is not None and stack[k][0] in within:
                return

    def closed_later(name: str) -> bool:
        if name not in last:
            last[name] = max((m.start() for m in re.finditer(f"</{name}(?![a-z0-9:-])", html, re.I)), default=-1)
        return last[name] >= at

    while at < end:
        found = _TOKEN.search(html, at)
        text = html[at:found.start() if found else end]
        if text and not hidden:
            parts.append(text)
            if any(t == "a" for t, _, _ in stack[-4:]):
                linked += len(text.strip())
        if not found:
            break
        at = found.end()
        tag = found.group()
        name = _NAME.match(tag)
        if not name:
            continue
        name = name.group(1).lower()
        if tag[1] == "/":
            if hidden:
                inside = any(t == name for t, _, _ in stack[hidden:])
                if not inside and all(t != name for t, _, _ in stack):
                    continue
            if name in BLOCK and not (hidden and inside):
                flush()
            close((name,))
            hidden = hidden if len(stack) > hidden else 0
            continue
        if name in RAW:
            if name == "iframe" and not closed_later(name):
                continue
            stop = re.compile(f"</{name}[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else end
            if name in ("textarea", "iframe") and not hidden:
                parts.append(" ")
            continue
        if hidden and name in ENDS_SVG:
            within = next(t for t, _, _ in reversed(stack) if t in IN_SVG or t in DROPPED)
            if within == "svg":
                close(("svg",))
                hidden = hidden if len(stack) > hidden else 0
        if name in DROPPED and not hidden:
            if not tag.endswith("/>") and closed_later(name):
                hidden = len(stack)
                stack.append((name, *stack[-1][1:]))
                numbers.append(0)
            continue
        if hidden:
            if name not in VOID and not tag.endswith("/>"):
                stack.append((name, *stack[-1][1:]))
                numbers.append(0)
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCK:
            flush()
            if name in ENDS_PARAGRAPH:
                close(("p",), BLOCK - {"p"})
            if name in SAME:
                close(SAME[name], frozenset(("ul", "ol", "dl", "table", "select", "tbody")))
        if name in VOID or tag.endswith("/>"):
            continue
        features = stack[-1][1]
        marks = [w for m in _MARKS.findall(tag) for w in _WORDS.findall("".join(m).lower())]
        new = [f for f in (["in:" + name] if name in TELLING else []) + ["mark:" + w for w in marks] if f not in features]
        if marks or name in SECTIONS:
            near = dict.fromkeys(["near:" + w for w in marks] + (["near:" + name] if name in SECTIONS else []))
            features = (*[f for f in features if not f.startswith("near:")], *near)
        if new:
            features = (*features, *new)
        stack.append((name, features, stack[-1][2] or " y>" in tag))
        made += 1
        numbers.append(made)
    flush()
    return _with_page(out, places)


def _kind(text: str, links: float) -> str:
    if links >= 0.5:
        return "links"
    return "prose" if text.count(" ") >= 7 else "short"


def _with_page(blocks: list, places: list[tuple[int, int]]) -> list:
    """``blocks`` with features of their place on the page."""
    kinds = [_kind(t, links) for t, _, links, _ in blocks]
    prose: Counter = Counter()
    beside: Counter = Counter()
    for (text, _, _, _), kind, (parent, higher) in zip(blocks, kinds, places, strict=True):
        beside[parent, kind] += 1
        if kind == "prose":
            prose[parent] += len(text)
            prose["up", higher] += len(text)
    total = sum(n for key, n in prose.items() if isinstance(key, int)) or 1
    lead = max((key for key in prose if isinstance(key, int)), key=lambda key: (prose[key], -key), default=None)
    inside = [k for k, (parent, _) in enumerate(places) if parent == lead]
    first, last = (inside[0], inside[-1]) if inside else (-1, -1)

    def share(part: int) -> str:
        return "most" if part * 2 >= total else "some" if part * 8 >= total else "little" if part else "none"

    out = []
    for k, ((text, structure, links, kept), (parent, higher)) in enumerate(zip(blocks, places, strict=True)):
        n = beside[parent, kinds[k]]
        page = ("parent:" + share(prose[parent]), "higher:" + share(prose["up", higher]),
                "before:" + (kinds[k - 1] if k else "none"), "after:" + (kinds[k + 1] if k + 1 < len(kinds) else "none"),
                kinds[k] + ":" + ("one" if n == 1 else "few" if n < 4 else "many"),
                "at:" + ("none" if lead is None else "before" if k < first else "after" if k > last else "lead"))
        out.append((text, (*structure, *page), links, kept))
    return out


def features_of(text: str, structure: tuple[str, ...], links: float) -> tuple[str, ...]:
    n = text.count(" ") + 1
    size = "words:" + ("1" if n < 3 else "few" if n < 8 else "some" if n < 25 else "many")
    share = "links:" + ("none" if links == 0 else "few" if links < 0.5 else "most")
    ending = "ends:" + ("stop" if text[-1] in ".!?…" else "word")
    return (*dict.fromkeys(structure), size, share, ending, *(["rights"] if "©" in text else []))


class Field:
    """Weights of a two-label chain: label 1 is content."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move
        self.memo: dict[tuple[str, ...], tuple[float, float]] = {}

    def score(self, features: tuple[str, ...]) -> tuple[float, float]:
        known = self.memo.get(features)
        if known is None:
            if len(self.memo) > 1 << 16:
                self.memo.clear()
            rows = [self.names[f] for f in features if f in self.names]
            known = self.memo[features] = tuple(self.emit[rows].sum(axis=0)) if rows else (0.0, 0.0)
        return known

    def decode(self, chain: list[tuple[str, ...]]) -> list[int]:
        """Viterbi."""
        if not chain:
            return []
        m = self.move
        best, back = self.score(chain[0]), []
        for features in chain[1:]:
            s = self.score(features)
            step, nxt = [], []
            for y in (0, 1):
                a, b = best[0] + m[0, y], best[1] + m[1, y]
                step.append(1 if b > a else 0)
                nxt.append(max(a, b) + s[y])
            back.append(step)
            best = tuple(nxt)
        labels = [1 if best[1] > best[0] else 0]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def train(pages: list[list[tuple[tuple[str, ...], int]]], rounds: int = 300, rate: float = 1.5, decay: float = 2e-4,
          least: int = 2) -> Field:
    """Fit on chains of (features, label); features of fewer than ``least`` chains are left out.  All chains go forward and back together."""
    pages = [page for page in pages if page]
    if not pages:
        return Field({}, np.zeros((0, 2)), np.zeros((2, 2)))
    seen = Counter(f for page in pages for f in {f for features, _ in page for f in features})
    names = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    blocks = [(features, y) for page in pages for features, y in page]
    owner = np.array([k for k, (features, _) in enumerate(blocks) for f in features if f in names], dtype=np.int64)
    ids = np.array([names[f] for features, _ in blocks for f in features if f in names], dtype=np.int64)
    truth = np.eye(2)[[y for _, y in blocks]]
    size = np.array([len(page) for page in pages])
    start, longest = np.cumsum(size) - size, int(size.max())
    steps = np.arange(longest)
    valid = steps[None, :] < size[:, None]
    cell = np.minimum(start[:, None] + steps[None, :], len(blocks) - 1)
    joined = valid[:, 1:, None, None] * 1.0
    pairs = np.einsum("nti,ntj->ij", truth[cell[:, :-1]] * valid[:, 1:, None], truth[cell[:, 1:]])
    emit, move = np.zeros((len(names), 2)), np.zeros((2, 2))
    speed_e, speed_m = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    for _ in range(rounds):
        flat = np.stack([np.bincount(owner, emit[ids, y], len(blocks)) for y in (0, 1)], axis=1)
        s = flat[cell]
        fore, aft = s.copy(), np.zeros_like(s)
        for t in range(1, longest):
            step = s[:, t] + np.logaddexp(fore[:, t - 1, 0, None] + move[0], fore[:, t - 1, 1, None] + move[1])
            fore[:, t] = np.where(valid[:, t, None], step, fore[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = s[:, t + 1] + aft[:, t + 1]
            step = np.logaddexp(move[:, 0] + ahead[:, 0, None], move[:, 1] + ahead[:, 1, None])
            aft[:, t] = np.where(valid[:, t + 1, None], step, 0.0)
        total = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])[:, None, None]
        p = np.exp(fore + aft - total)[valid]
        both = np.exp(fore[:, :-1, :, None] + move + (s + aft)[:, 1:, None, :] - total[..., None], where=joined > 0, out=np.zeros_like(joined * move))
        grad_e = np.stack([np.bincount(ids, (truth - p)[owner, y], len(names)) for y in (0, 1)], axis=1) - decay * emit * len(pages)
        grad_m = pairs - both.sum(axis=(0, 1)) - decay * move * len(pages)
        speed_e += grad_e ** 2
        speed_m += grad_m ** 2
        emit += rate * grad_e / np.sqrt(speed_e)
        move += rate * grad_m / np.sqrt(speed_m)
    return Field(names, emit, move)


# Wrappers of the labelled pages and words they hold.  # any text, @ prose, ~ few words, % class words without meaning.
FURNITURE = """<nav><ul><li><a>#</a></li><li><a>#</a></li></ul></nav>
<header><h1>#</h1><p>#</p></header>
<div class="ad">#</div>
<div class="advert sponsored"><p>#</p></div>
<div class="ads advertisement"><p>#</p><p>#</p></div>
<div id="banner" class="promo"><p>#</p></div>
<div class="promo offer"><h3>~</h3><p>#</p></div>
<div class="cookie notice"><p>#</p></div>
<div class="cookies consent popup"><p>#</p></div>
<div role="alert" class="warning message"><p>#</p></div>
<aside><h3>#</h3><p>#</p><ul><li><a>#</a></li></ul></aside>
<div class="sidebar widget"><h2>#</h2><p>#</p></div>
<div id="menu" class="navigation"><ul><li><a>#</a></li><li><a>#</a></li></ul></div>
<form><p>#</p><label>#</label></form>
<div class="newsletter subscribe"><p>#</p></div>
<section class="comments"><h2>#</h2><div class="comment"><p>#</p></div><div class="comment"><p>#</p></div></section>
<div id="comments"><ol><li class="comment">#</li><li class="comment">@</li></ol></div>
<div class="comment"><p>#</p></div>
<div id="disqus" class="replies"><p>#</p></div>
<section class="discussion responses"><h3>~</h3><p>@</p><p>@</p></section>
<div class="related share social"><ul><li><a>#</a></li></ul></div>
<div class="breadcrumb"><a>#</a> <a>#</a></div>
<footer>#</footer>
<footer><p>© #</p><ul><li><a>#</a></li></ul></footer>""".split("\n")
UNNAMED_FURNITURE = """<div %><ul><li><a>~</a></li><li><a>~</a></li><li><a>~</a></li></ul></div>
<div %><div %><a>~</a> <a>~</a> <a>~</a></div></div>
<div %>~</div>
<div %><p>© ~</p></div>
<table><tr><td><a>~</a></td><td><a>~</a></td><td><a>~</a></td></tr></table>
<p><a>~</a> | <a>~</a></p>""".split("\n")
CONTENT = """<article y><h1>#</h1><p>#</p><p>#</p><p>#</p></article>
<article y><h1>#</h1><p>#</p><h2>#</h2><p>#</p><ul><li>#</li><li>#</li></ul><p>#</p></article>
<article y><h1>#</h1><p>#</p><blockquote>#</blockquote><pre>#</pre><p>#</p></article>
<article y><header><h1>#</h1></header><p>#</p><table><tr><td>#</td><td>#</td></tr></table><p>#</p></article>
<article y><h1>#</h1><p>#</p><h3>#</h3><ol><li>#</li><li>#</li></ol><figure><figcaption>#</figcaption></figure><p>#</p></article>
<main><article y><h1>#</h1><p>#</p><p>#</p></article></main>
<main y><h1>#</h1><p>#</p><h3>#</h3><p>#</p><p>#</p></main>
<div class="content post" y><h1>#</h1><p>#</p><p>#</p><p>#</p></div>
<div id="article" class="body entry text" y><p>#</p><p>#</p><p>#</p></div>
<article y><h1>#</h1>#<p>#</p></article>
<article y><h1>~</h1><p>~</p></article>
<article y><p>~</p></article>""".split("\n")
UNNAMED_CONTENT = """<div % y><p>@</p></div>
<div %><div % y><p>@</p></div></div>
<div % y><h1>~</h1><p>@</p><p>@</p><p>@</p></div>
<div %><div % y><p>@</p><p>@</p></div></div>
<div %><div % y><h1>~</h1><p>@</p><h3>~</h3><p>@</p><ul><li>~</li><li>@</li></ul><p>@</p></div></div>
<div % y><h2>~</h2><div %>@</div><div %>@</div><p>@</p></div>
<section % y><h1>~</h1><p>@</p><blockquote>@</blockquote><p>@</p></section>
<table><tr><td %><a>~</a><br><a>~</a></td><td % y><h1>~</h1><p>@</p><p>@</p></td></tr></table>
<table><tr><td><a>~</a></td><td><a>~</a></td></tr><tr><td y>@<p>@</p></td></tr></table>
<div % y><h1>~</h1><p>@</p><table><tr><td>~</td><td>~</td></tr></table><p>@</p></div>""".split("\n")
BODIES = "<p>@</p>|<p>~</p>|@|~|<h3>~</h3><p>@</p>|<p>@</p><p>@</p>|<ul><li><a>~</a></li></ul>|<div>@</div>".split("|")
LAYOUT = "wrap wrapper container row inner outer page section box block left center grid column".split()
WORDS = "the river runs past old mills and towns where people work on boats in spring and tell of high water".split()


def labelled_pages(n: int = 160, seed: int = 5, named: bool = True) -> list[str]:
    """Pages with furniture before, inside and after the content; content wrappers carry the mark ``y``.

    With ``named`` the wrappers of the content have telling tags or class words, else only layout words and meaningless ones.
    """
    rng = np.random.default_rng(seed)

    def words(kind: str) -> str:
        if kind == "%":
            made = ["".join(rng.choice(list("bcdfgklmnprstvz"), 3)) for _ in range(2)] + [str(w) for w in rng.choice(LAYOUT, 2)]
            return f'class="{" ".join(rng.permutation(made)[:int(rng.integers(1, 4))])}"'
        k = int(rng.choice({"#": [1, 2, 4, 9, 20, 45], "@": [9, 15, 20, 45, 80], "~": [1, 2, 3, 5]}[kind]))
        text = " ".join(rng.choice(WORDS, k))
        if kind == "#" and rng.random() < 0.04:
            return f"<a>{text}</a>"
        return text + str(rng.choice({"#": [".", ".", "", "!"], "@": [".", ".", ".", "!", ""], "~": ["", "", "", "."]}[kind]))

    def furniture(wrapper: str) -> str:
        """Half of the time with a layout word beside its class words, half of the time around another text."""
        if rng.random() < 0.5:
            wrapper = wrapper.replace('class="', f'class="{rng.choice(LAYOUT)}-', 1)
        if rng.random() < 0.5:
            wrapper = re.sub("(?s)^(<[^>]*>).*(</[^>]*>)$", lambda m: m[1] + str(rng.choice(BODIES)) + m[2], wrapper)
        return wrapper

    inner = [f for f in FURNITURE if "<header" not in f]
    pages = []
    for _ in range(n):
        inside = str(rng.choice(CONTENT if named else UNNAMED_CONTENT))
        for _ in range(int(rng.choice([0, 1, 1, 2, 3]))):
            ends = [m.end() for m in re.finditer("</p>", inside)]
            cut = ends[-1] if rng.random() < 0.5 else int(rng.choice(ends))
            inside = inside[:cut] + furniture(str(rng.choice(inner))) + inside[cut:]
        some = FURNITURE if named else UNNAMED_FURNITURE * 2 + FURNITURE
        around = [furniture(str(x)) for x in rng.permutation(some)[:int(rng.integers(0, 8))]]
        half = int(rng.integers(0, len(around) + 1))
        body = "".join([*around[:half], inside, *around[half:]])
        if rng.random() < 0.4:
            body = f"<div %>{body}</div>"
        page = f"<html><head><title>#</title></head><body>{body}</body></html>"
        pages.append(re.sub("[#@~%]", lambda m: words(m.group()), page))
    return pages


@cache
def _furniture_only() -> frozenset[str]:
    """Tags and marks that only furniture wrappers have."""
    def names(wrappers: list[str]) -> set[str]:
        plain = [re.sub("[#@~]", "x", w.replace("%", "")) for w in wrappers]
        return {f for w in plain for _, s, _, _ in blocks_of(w) for f in s if f.startswith(("in:", "mark:"))}

    return frozenset(names(FURNITURE) - names(CONTENT + UNNAMED_CONTENT))


def _is_furniture(structure: tuple[str, ...]) -> bool:
    """Furniture inside a marked wrapper: any mark or tag that only furniture wrappers have."""
    return not _furniture_only().isdisjoint(structure)


def trained(n: int = 160) -> Field:
    """Fit on ``n`` pages with telling names and twice as many without."""
    chains = []
    for page in labelled_pages(n) + labelled_pages(2 * n, seed=6, named=False):
        chain = [(features_of(t, s, links), int(kept and not _is_furniture(s))) for t, s, links, kept in blocks_of(page)]
        chains.append(chain)
    return train(chains)


def main_text(html: str | None, field: Field) -> str:
    blocks = blocks_of(html)
    labels = field.decode([features_of(t, s, links) for t, s, links, _ in blocks])
    return "\n\n".join(b[0] for b, y in zip(blocks, labels, strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of ``pages(page_id, url, html)``."""
    field = field or trained()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = batch[["page_id", "url"]].copy()
            made["page_id"] = made["page_id"].astype("Int64")
            made["text"] = [main_text(h if isinstance(h, str) else None, field) for h in batch["html"]]
            made["n_chars"] = [len(t) for t in made["text"]]
            yield made

    return pages.selectExpr("cast(page_id as bigint) page_id", "url", "html").mapInPandas(
        rows, "page_id bigint, url string, text string, n_chars bigint")
