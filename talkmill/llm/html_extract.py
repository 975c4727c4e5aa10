"""Main text of web pages: a linear-chain conditional random field labels the leaf blocks of the page as text or not.

A block is the text between two block-level tags. Its features are its ancestors' tags, the words of their class, id and role,
and the text's shape. The field has a weight for each feature and label, and one for each pair of neighbouring labels; it is
trained on labelled pages by gradient ascent of the likelihood, and decoded by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.llm.common import with_columns

# Fixed values of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table select body article section div".split())

_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|([^<]++|<)", re.S)
_attribute = re.compile(r"([^\s=>\"'/]++)\s*+(?:=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NAMED = frozenset(("class", "id", "role", "aria-label"))
CLOSED = frozenset().union(*CLOSES.values())


class Element:
    """An open element: the features that it adds to its ancestors', and the innermost block's tag. `total` is the features' score
    once it is known, so that neither a deep page's paths nor their features are ever written out."""

    __slots__ = ("parent", "fresh", "inner", "total")

    def __init__(self, parent: Element | None, fresh: tuple[str, ...], inner: str):
        self.parent, self.fresh, self.inner, self.total = parent, fresh, inner, None


@dataclass
class Block:
    """A leaf block: its text, the innermost open element, and how many of its characters are in links."""

    text: str
    element: Element
    linked: int


def names_of(attributes: str) -> set[str]:
    """The words of class, id, role and aria-label, in lower case."""
    return {w.lower() for name, value in _attribute.findall(attributes) if name.lower() in NAMED for w in _words.findall(value)} if attributes else set()


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks that have text, in order. Time and memory are linear in the page, however deep it is."""
    out: list[Block] = []
    stack: list[tuple[str, Element, list[str]]] = []  # tag, element, features
    marks: list[int] = []  # places in the stack of tags that a tag may close, or that end the search for one
    held: dict[str, int] = {}  # how many open elements have a feature
    text: list[str] = []
    linked = at = 0
    last_end = page.rfind(">")
    root = Element(None, (), "none")

    def flush():
        nonlocal linked
        if text:
            plain = " ".join("".join(text).split())
            if plain:
                out.append(Block(plain, stack[-1][1] if stack else root, linked))
            text.clear()
        linked = 0

    def pop() -> str:
        tag, _, features = stack.pop()
        for f in features:
            held[f] -= 1
        if marks and marks[-1] == len(stack):
            marks.pop()
        return tag

    while at < len(page):
        if at > last_end:  # no tag ends here or later
            m, plain = None, page[at:]
            at = len(page)
            if plain.startswith("<!--"):
                break
        else:
            m = _token.match(page, at)
            at = m.end()
            plain = m.group(7)
        if plain is not None:
            plain = html.unescape(plain)
            text.append(plain)
            if held.get("in a"):
                linked += len(plain)
            continue
        end, tag, attributes = m.group(1, 2, 3) if m.group(2) is not None else m.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            if tag not in INLINE:
                flush()
            if held.get(f"in {tag}"):
                while pop() != tag:
                    pass
            continue
        if tag in RAW:
            done = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = done.end() if done else len(page)
            continue
        if tag not in INLINE:
            flush()
            if held.get("in p") and tag != "br":
                while pop() != "p":
                    pass
            closes = CLOSES.get(tag, ())
            if any(held.get(f"in {t}") for t in closes):
                place = len(marks) - 1
                while place >= 0 and stack[marks[place]][0] not in SCOPE:
                    if stack[marks[place]][0] in closes:
                        depth = marks[place]
                        while len(stack) > depth:
                            pop()
                        place = len(marks)
                    place -= 1
        if tag not in VOID and not attributes.endswith("/"):
            features = [f"in {tag}", *(f"named {w}" for w in sorted(names_of(attributes)))]
            parent = stack[-1][1] if stack else root
            fresh = tuple(f for f in features if not held.get(f))
            for f in features:
                held[f] = held.get(f, 0) + 1
            if tag in SCOPE or tag in CLOSED:
                marks.append(len(stack))
            stack.append((tag, Element(parent, fresh, parent.inner if tag in INLINE else tag), features))
    flush()
    return out


def path_features(element: Element) -> list[str]:
    """Features of the ancestors: their tags, the innermost block's tag, and the words of their class, id and role."""
    out = [f"block {element.inner}"]
    while element is not None:
        out += element.fresh
        element = element.parent
    return out


def text_features(block: Block) -> list[str]:
    """Features of a block's text: its length, its links, its end."""
    n, share = len(block.text), block.linked / max(1, len(block.text))
    return [f"length {min(n.bit_length(), 10)}", "no link" if not block.linked else "all link" if share > 0.8 else "some link", "stop" if block.text[-1] in ".!?…。" else "no stop", *(["copyright"] if "©" in block.text else [])]


@dataclass
class ChainField:
    """Weights: of each feature, for text over not; of neighbouring labels; of the first label."""

    weights: dict[str, float]
    between: np.ndarray
    first: np.ndarray

    def path_score(self, element: Element) -> float:
        """The weights of path_features; each element's sum is kept, so a page's sums take time linear in its elements."""
        todo = []
        while element.total is None and element.parent is not None:
            todo.append(element)
            element = element.parent
        get, total = self.weights.get, element.total or 0.0
        for element in reversed(todo):
            total = element.total = total + sum(get(f, 0.0) for f in element.fresh)
        return total + get(f"block {element.inner}", 0.0)

    def decode(self, found: list[Block]) -> list[bool]:
        """Viterbi: the most likely labels."""
        if not found:
            return []
        (b00, b01), (b10, b11) = self.between.tolist()
        get = self.weights.get
        back = []
        zero, one = self.first.tolist()
        for i, block in enumerate(found):
            score = self.path_score(block.element) + sum(get(f, 0.0) for f in text_features(block))
            if i:
                from_zero, from_one = zero + b01 >= one + b11, zero + b00 >= one + b10
                zero, one = (zero + b00 if from_one else one + b10), (zero + b01 if from_zero else one + b11)
                back.append((0 if from_one else 1, 0 if from_zero else 1))
            one += score
        label = int(one > zero)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return [bool(x) for x in reversed(labels)]


def fit(pages: list[tuple[str, list[str]]], rounds: int = 150, rate: float = 0.2, decay: float = 1e-3) -> ChainField:
    """The field of labelled pages: (html, texts of the blocks that are main text). All pages are padded to the longest."""
    seen: dict[str, int] = {}
    rows = []
    for page, main in pages:
        found, wanted = blocks(page), set(main)
        rows.append([([seen.setdefault(f, len(seen)) for f in [*path_features(b.element), *text_features(b)]], b.text in wanted) for b in found])
    rows = [r for r in rows if r]
    n, longest = len(rows), max(map(len, rows))
    mask, gold = np.zeros((n, longest), bool), np.zeros((n, longest), np.int64)
    where, which = [], []
    for i, row in enumerate(rows):
        for t, (features, label) in enumerate(row):
            mask[i, t], gold[i, t] = True, label
            where += [i * longest + t] * len(features)
            which += features
    where, which = np.array(where), np.array(which)
    values = [np.zeros(len(seen)), np.zeros((2, 2)), np.zeros(2)]
    slope, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    one_hot = np.eye(2)[gold] * mask[..., None]
    pairs = np.einsum("nti,ntj->ij", one_hot[:, :-1], one_hot[:, 1:])
    for step in range(1, rounds + 1):
        score = np.zeros((n, longest, 2))
        score[..., 1] = np.bincount(where, values[0][which], n * longest).reshape(n, longest)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = score[:, 0] + values[2]
        for t in range(1, longest):
            go = np.logaddexp.reduce(ahead[:, t - 1, :, None] + values[1], axis=1) + score[:, t]
            ahead[:, t] = np.where(mask[:, t, None], go, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            go = np.logaddexp.reduce(values[1] + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(mask[:, t + 1, None], go, 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None, None]
        single = np.exp(ahead + behind - total) * mask[..., None]
        both = np.exp(ahead[:, :-1, :, None] + values[1] + (score + behind)[:, 1:, None, :] - total[..., None]) * mask[:, 1:, None, None]
        slopes = [np.bincount(which, (one_hot - single)[..., 1].ravel()[where], len(seen)), pairs - both.sum((0, 1)), (one_hot - single)[:, 0].sum(0)]
        for v, g, m, s in zip(values, slopes, slope, square, strict=True):
            g = g / n - decay * v
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return ChainField({f: float(values[0][i]) for f, i in seen.items()}, values[1], values[2])


def labelled_pages(n: int = 500, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Labelled pages made by rule: an article in one of several frames, among page parts that are not text."""
    r = random.Random(seed)
    syllables = "an be con der el for ga hi in ka lo mi ne or pa que ra sol ti um va wer".split()
    serial = iter(range(10**9))

    def words(k):
        return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(k))

    def text(k, stop=True):
        return f"{words(k).capitalize()} n{next(serial)}{'.' if stop and r.random() < 0.8 else ''}"

    def link(k=2):
        return f'<a href="/{words(1)}">{text(k, False)}</a>'

    def links(tag="ul"):
        return f"<{tag}>" + "".join(f"<li>{link(r.randint(1, 3))}</li>" for _ in range(r.randint(2, 7))) + f"</{tag}>"

    def named(*names, tag="div"):
        return f'<{tag} {r.choice(["class", "class", "id"])}="{r.choice(names)}">'

    def part(kind):
        body = text(r.randint(2, 30))
        if kind == "menu":
            return r.choice([f"<nav>{links()}</nav>", f"{named('menu', 'main-nav', 'navbar', 'breadcrumb', 'nav-menu')}{links()}</div>", f'<ul class="menu">{"".join(f"<li>{link()}</li>" for _ in range(4))}</ul>', f'<div role="navigation">{links()}</div>'])
        if kind == "header":
            inner = r.choice([f"<h1>{text(3, False)}</h1>", f"<p>{text(4, False)}</p>", text(3, False), f"{link()}<p>{body}</p>"])
            return r.choice([f"<header>{inner}</header>", f"{named('header', 'site-header', 'masthead', 'page-header', 'topbar')}{inner}</div>", f'<header class="site-header">{inner}</header>'])
        if kind == "footer":
            inner = r.choice([f"&copy; {text(5)}", f"<p>&copy; {body}</p>", f"<p>{body}</p>{links()}", body])
            return r.choice([f"<footer>{inner}</footer>", f"{named('footer', 'site-footer', 'page-footer', 'copyright', 'legal')}{inner}</div>"])
        if kind == "sidebar":
            inner = r.choice([f"<h3>{text(2, False)}</h3>{links()}", f"<p>{body}</p>", f"<h2>{text(2, False)}</h2><p>{body}</p>", body])
            return r.choice([f"<aside>{inner}</aside>", f"{named('sidebar', 'related', 'widget', 'recommended', 'side', 'rail', 'popular')}{inner}</div>", f'<aside class="sidebar">{inner}</aside>', f'<div role="complementary">{inner}</div>'])
        if kind == "notice":
            inner = r.choice([body, f"<p>{body}</p>", f"<p>{body}</p><button>{text(1, False)}</button>"])
            return r.choice([f"{named('cookie', 'cookie-banner', 'cookie-notice', 'consent', 'notice', 'alert', 'gdpr', 'banner', 'popup', 'modal', 'disclaimer', 'subscribe', 'newsletter', 'paywall', 'share', 'social')}{inner}</div>", f'<div role="alert">{inner}</div>', f'<section class="notice">{inner}</section>', f'<p class="notice">{body}</p>', f'<div role="dialog">{inner}</div>', f"<dialog>{inner}</dialog>", f"<noscript>{inner}</noscript>"])
        if kind == "advert":
            inner = r.choice([body, f"<p>{body}</p>", link(6), f"<span>{body}</span>"])
            return r.choice([f"{named('ad', 'ads', 'advert', 'advertisement', 'ad-slot', 'sponsor', 'sponsored', 'promo', 'promotion', 'adsbygoogle', 'banner-ad')}{inner}</div>", f'<aside class="ad">{inner}</aside>', f'<p class="ad">{body}</p>', f'<section class="advert">{inner}</section>', f'<ins class="ads">{body}</ins>'])
        if kind == "form":
            inner = f"<label>{text(2, False)}</label><input name=q><select><option>{text(1, False)}<option>{text(1, False)}</select><textarea>{text(3)}</textarea><button>{text(1, False)}</button>"
            return r.choice([f"<form>{inner}</form>", f'<form class="search"><p>{body}</p>{inner}</form>', f'<div class="login"><form>{inner}</form></div>', f"<form><fieldset><legend>{text(2, False)}</legend>{inner}</fieldset></form>"])
        one = lambda: r.choice([f'<div class="comment"><p>{text(r.randint(3, 40))}</p></div>', f"<li><p>{text(r.randint(3, 30))}</p></li>", f'<article class="comment"><h4>{text(2, False)}</h4><p>{text(r.randint(3, 30))}</p></article>', f"<p>{text(r.randint(3, 30))}</p>"])
        inner = f"<h3>{text(2, False)}</h3>" + "".join(one() for _ in range(r.randint(1, 4)))
        return r.choice([f"{named('comments', 'comment-list', 'comment', 'disqus', 'replies', 'responses', 'discussion', 'respond')}{inner}</div>", f'<section class="comments">{inner}</section>', f'<section id="comments">{inner}</section>', f'<ol class="commentlist">{"".join(one() for _ in range(3))}</ol>', f'<aside class="comments">{inner}</aside>', f'<footer class="comments">{inner}</footer>'])

    kinds = ["menu", "header", "footer", "sidebar", "notice", "advert", "form", "comments"]
    out = []
    for _ in range(n):
        main: list[str] = []

        def say(k, stop=True, main=main):
            main.append(text(k, stop))
            return main[-1]

        def piece():
            k = r.random()
            if k < 0.55:
                return f"<p>{say(r.randint(1, 80))}</p>"
            if k < 0.62:
                return f"<p>{say(r.randint(4, 20))}<br>{say(r.randint(1, 20))}"
            if k < 0.68:
                return f"<h{r.randint(2, 4)}>{say(r.randint(1, 6), False)}</h3>"
            if k < 0.74:
                return "<ul>" + "".join(f"<li>{say(r.randint(1, 12))}</li>" for _ in range(r.randint(1, 4))) + "</ul>"
            if k < 0.80:
                return f"<blockquote><p>{say(r.randint(4, 30))}</p></blockquote>"
            if k < 0.84:
                return "<table>" + "".join(f"<tr><td>{say(1, False)}</td><td>{say(2, False)}</td></tr>" for _ in range(2)) + "</table>"
            if k < 0.88:
                return f"<pre>{say(8)}</pre>"
            if k < 0.92:
                return f"<div>{say(r.randint(3, 40))}</div>"
            if k < 0.96:
                a, b = words(3), words(2)
                main.append(f"{a} {b} n{next(serial)}")
                return f'<p>{a} <a href="/x">{b}</a> n{main[-1].rpartition("n")[2]}</p>'
            return f"<figure><figcaption>{say(r.randint(2, 9))}</figcaption></figure>"

        body = (f"<h1>{say(r.randint(2, 9), False)}</h1>" if r.random() < 0.7 else "") + "".join(piece() for _ in range(r.randint(1, 12)))
        if r.random() < 0.3:  # a part within the article
            cut = body.find("</p><p>")
            extra = part(r.choice(["sidebar", "notice", "advert", "form", "comments"]))
            body = f"{body[: cut + 4]}{extra}{body[cut + 4 :]}" if cut > 0 else body + extra
        opened, closed = r.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div class="post-body">', "</div>"), ('<div id="article">', "</div>"), ('<div class="entry-content">', "</div>"), ('<section class="story">', "</section>"), ('<div id="main"><article class="post">', "</article></div>"), ('<article class="article">', "</article>"), ('<div role="main">', "</div>")])
        before = "".join(part(k) for k in r.sample(kinds, r.randint(0, 4)))
        after = "".join(part(k) for k in r.sample(kinds, r.randint(0, 5)))
        end = r.choice(["</body></html>", "</body></html>", ""])
        out.append((f"<!DOCTYPE html><html><head><title>{text(4, False)}</title><style>p{{}}</style><script>x='</p>'</script></head><body>{before}{opened}{body}{closed}{after}{end}", main))
    return out


def with_main_text(pages: DataFrame, model: ChainField, source: str = "html", name: str = "text") -> DataFrame:
    """pages and their main text: the blocks labelled as text, white space inside as one blank, joined by one blank.

    A null, empty or textless page gives the empty text. Nothing of a text block is dropped.
    """
    held = pages.sparkSession.sparkContext.broadcast((model.weights, model.between, model.first))

    def make():
        model = ChainField(*held.value)

        def extract(column):
            out = []
            for page in column.to_pylist():
                found = blocks(page or "")
                out.append(" ".join(b.text for b, keep in zip(found, model.decode(found), strict=True) if keep))
            return [pa.array(out, pa.string())]

        return extract

    return with_columns(pages, source, [(name, pa.string(), T.StringType())], make)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages, with a field trained on labelled_pages(). Repeated rows stay."""
    rows = with_main_text(pages.select("page_id", "url", "html"), fit(labelled_pages()))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
