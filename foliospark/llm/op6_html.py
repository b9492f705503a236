"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page becomes its leaf blocks (html_blocks). Every block has features of its ancestors (tags, the words of their
class, id and role, those of the nearest named ancestor, and which sectioning element lies in which) and of its text (length, share of links, punctuation, place). The field's labels are main text and
rest; transitions depend on whether two neighbours share their container. Weights come from labelled pages by gradient
ascent on the conditional likelihood (AdaGrad), a page is decoded by Viterbi.

The labelled pages are made by layouts(): pages of many layouts whose main blocks are known, TRAINING_PAGES of them. Names
carry the affixes and the company that they have on real pages; the tests hold pages written by hand.

Defined cases: null or empty html, and html without text, give the empty text; unclosed tags, comments and quotes end
with the page; pages of any length are read whole; equally likely labels go to the rest; repeated rows are extracted each; an empty table gives no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced
from .html_blocks import Block, blocks

TRAINING_PAGES = 1500
EPOCHS = 8
RATE, DECAY = 0.3, 1e-4


SECTIONS = set("article main section header footer nav aside form td body".split())


def path_features(path: tuple[str, ...]) -> list[str]:
    out, tags = set(), []
    for x in path:
        tag, *names = x.split(".")
        tags.append(tag)
        out.add(f"in {tag}")
        out.update(f"name {n}" for n in names)
    nearest = next((x.split(".") for x in reversed(path) if "." in x), [])
    out.update(f"own {n}" for n in nearest[1:])
    out.update(f"own {nearest[0]} {n}" for n in nearest[1:])
    sections = [t for t in tags if t in SECTIONS]
    out.update(f"{a} in {b}" for b, a in zip(sections, sections[1:]))
    out.add(f"inner {sections[-1] if sections else ''}")
    out.add(f"parent {tags[-1] if tags else ''}")
    out.add(f"last {'>'.join(tags[-2:])}")
    return sorted(out)


def text_features(b: Block) -> list[str]:
    t = b.text
    n, words = len(t), t.count(" ") + 1
    out = ["bias", f"words {min(8, words.bit_length())}", f"links {min(4, 4 * b.linked // max(n, 1))}", f"stop {t[-1] in '.!?…:;。”\"'}", f"commas {min(3, t.count(','))}"]
    if "©" in t or "(c)" in t[:20].lower():
        out.append("copyright")
    if "|" in t or "»" in t or "·" in t or "•" in t:
        out.append("bars")
    if words > 6 and t[-1] in ".!?":
        out.append("sentence")
    return out


class Field:
    """Weights of the field, and scores from them."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.w = weights
        self.paths: dict[tuple[str, ...], float] = {}

    def score(self, b: Block) -> float:
        """How much more main text than rest speaks of a block on its own."""
        if (s := self.paths.get(b.path)) is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            s = self.paths[b.path] = sum(self.w.get(f, 0.0) for f in path_features(b.path))
        return s + sum(self.w.get(f, 0.0) for f in text_features(b))

    def steps(self, same: bool) -> list[list[float]]:
        return [[self.w.get(f"step {same} {i}{j}", 0.0) for j in (0, 1)] for i in (0, 1)]

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi: the most likely labels; ties go to the rest."""
        if not page:
            return []
        between = {s: self.steps(s) for s in (False, True)}
        best, back = [0.0, self.score(page[0])], []
        for a, b in zip(page, page[1:]):
            t, s = between[container(a) == container(b)], self.score(b)
            here, come = [], []
            for j in (0, 1):
                from0, from1 = best[0] + t[0][j], best[1] + t[1][j]
                come.append(int(from1 > from0))
                here.append(max(from0, from1) + s * j)
            best = here
            back.append(come)
        out = [int(best[1] > best[0])]
        for come in reversed(back):
            out.append(come[out[-1]])
        return out[::-1]


def container(b: Block) -> tuple[str, ...]:
    return b.path[:-1]


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS) -> Field:
    """Gradient ascent on the likelihood of the labels given the blocks, page after page."""
    w: dict[str, float] = {}
    squares: dict[str, float] = {}
    ready = [(page, labels, [path_features(b.path) + text_features(b) for b in page], [container(a) == container(b) for a, b in zip(page, page[1:])]) for page, labels in pages if page]
    for epoch in range(epochs):
        random.Random(epoch).shuffle(ready)
        for page, labels, features, same in ready:
            n, get = len(page), w.get
            score = [sum(get(f, 0.0) for f in fs) for fs in features]
            steps = {s: [[get(f"step {s} {i}{j}", 0.0) for j in (0, 1)] for i in (0, 1)] for s in (False, True)}
            ahead = [[0.0, score[0]]]
            for k in range(1, n):
                t, a = steps[same[k - 1]], ahead[-1]
                ahead.append([_log_sum(a[0] + t[0][j], a[1] + t[1][j]) + score[k] * j for j in (0, 1)])
            behind = [[0.0, 0.0]]
            for k in range(n - 1, 0, -1):
                t, b = steps[same[k - 1]], behind[-1]
                behind.append([_log_sum(t[i][0] + b[0], t[i][1] + score[k] + b[1]) for i in (0, 1)])
            behind.reverse()
            total = _log_sum(*ahead[-1])
            gradient: dict[str, float] = {}
            for k in range(n):
                error = labels[k] - math.exp(ahead[k][1] + behind[k][1] - total)
                for f in features[k]:
                    gradient[f] = gradient.get(f, 0.0) + error
                if k:
                    t = steps[same[k - 1]]
                    for i in (0, 1):
                        for j in (0, 1):
                            p = math.exp(ahead[k - 1][i] + t[i][j] + score[k] * j + behind[k][j] - total)
                            f = f"step {same[k - 1]} {i}{j}"
                            gradient[f] = gradient.get(f, 0.0) + (labels[k - 1] == i and labels[k] == j) - p
            for f, g in gradient.items():
                g -= DECAY * w.get(f, 0.0)
                squares[f] = squares.get(f, 1e-6) + g * g
                w[f] = w.get(f, 0.0) + RATE * g / math.sqrt(squares[f])
    return Field(w)


def layouts(n: int, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Labelled pages: html of varied layouts, and the texts of its main blocks in order."""
    r = random.Random(seed)
    made = [r.choice("bcdfglmnprstvé") + r.choice("aeiouäèó") + r.choice(["", "n", "r", "s", "tion", "ung", "ing"]) for _ in range(400)]

    def words(a: int, b: int) -> str:
        return " ".join(r.choice(made) + r.choice(["", "", "", r.choice(made)]) for _ in range(r.randint(a, b)))

    def sentence() -> str:
        t = words(5, 18)
        return (t[:1].upper() + t[1:]).replace(" ", ", ", r.random() < 0.5) + r.choice("...!?")

    def prose(a: int, b: int) -> str:
        text = " ".join(sentence() for _ in range(r.randint(a, b)))
        if style == "bars":
            return text.replace(" ", " | ")
        if style == "symbols":
            return " ".join(w + r.choice(["***", "%%%", "", "###"]) for w in text.split())
        return text.upper() if style == "capitals" else text

    def link() -> str:
        return f'<a href="/{r.randint(0, 999)}">{words(1, 3)}</a>'

    def company() -> str:
        """Words that class lists hold besides, on any kind of element."""
        some = ["row", "col", "inner", "clearfix", "block", "js", "wp", "has", "text", "post", "entry", "page", "site", "main", "content", "article", "section", "item", "list", "box", "hentry", "status", "publish", "default", "single", "mw", "ltr", "heading", "output", "body", "view", "wrap", "group", "title", *made[:40]]
        return " ".join("-".join(r.sample(some, r.randint(1, 2))) for _ in range(r.randint(0, 3)))

    def called(kinds: str) -> str:
        """A class or id of one of these words, with an affix."""
        name = r.choice(["", "", "", "site-", "page-", "main-", "post-", "c-", "article-", "story-", "mw-", "wp-block-"]) + r.choice(kinds.split()) + r.choice(["", "", "", "-area", "-wrapper", "-container", "-box", "-section", "-slot", "--inline", "_list", "-inner", "s", "-content"])
        key, more = r.choice(["class", "class", "class", "id", "CLASS"]), company() if r.random() < 0.5 else ""
        return f'{key}="{name}{" " + more if more and key.lower() == "class" else ""}"' + (f' class="{more}"' if more and key == "id" else "")

    def menu(names: str) -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(r.randint(3, 9)))
        return r.choice([f"<nav{names}><ul>{items}</ul></nav>", f'<nav {called("navigation nav menu ressorts breadcrumb")}>{items}</nav>', f'<div {called("menu nav navbar navigation breadcrumb topbar toc breadcrumbs pager")}><ul>{items}</ul></div>', f'<div role="navigation"><ul>{items}</ul></div>', f'<ul id="menu" class="links">{items}</ul>', f"<nav>{' | '.join(link() for _ in range(4))}</nav>"])

    def main_blocks(said: list[str]) -> str:
        out = []

        def add(form: str, text: str) -> None:
            said.append(text)
            out.append(form.format(text))

        if r.random() < 0.85:
            if r.random() < 0.1:
                add('<span class="kicker">{}</span>', words(1, 2))
            add(r.choice(["<h1>{}</h1>", "<h1 class=\"title\">{}</h1>", "<h2 class='entry-title'>{}</h2>", "<header class=\"entry-header\"><h1>{}</h1></header>", "<header><h1 class=\"entry-title\">{}</h1></header>", f'<h1 class="{company()}">{{}}</h1>']), r.choice([words(2, 9), sentence(), prose(1, 3)]))
        short = r.random() < 0.25
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.68:
                add(r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<p><b>{}<br></p>", "<div>{}</div>", "<p class=\"text\">{}</p>", f'<p class="{company() or "lead"}">{{}}</p>', '<div class="highlight"><pre>{}</pre></div>', '<div class="admonition note"><p>{}</p></div>']), words(1, 6) + "." if short or r.random() < 0.12 else prose(1, 6))
            elif kind < 0.76:
                add(r.choice(["<h2>{}</h2>", "<h3>{}</h3>", f'<h2 class="{company()}">{{}}</h2>', '<h3 class="wp-block-heading">{}</h3>', f'<div class="heading {company()}"><h2 id="{r.choice(made)}">{{}}</h2></div>']), words(1, 7))
            elif kind < 0.82:
                add("<blockquote><p>{}</p></blockquote>", prose(1, 3))
            elif kind < 0.92:
                out.append("<ul>")
                for _ in range(r.randint(2, 4)):
                    add("<li>{}</li>", r.choice([words(3, 10), sentence()]))
                out.append("</ul>")
            elif kind < 0.96:
                out.append("<table>")
                for _ in range(2):
                    out.append("<tr>")
                    add("<td>{}</td>", words(1, 4))
                    add("<td>{}</td>", words(1, 4))
                    out.append("</tr>")
                out.append("</table>")
            else:
                add("<figure><img src=x><figcaption>{}</figcaption></figure>", words(3, 9))
        return "".join(out)

    def named(kinds: str, body: str, tags: str = "div div section aside") -> str:
        tag = r.choice(tags.split())
        return f"<{tag} {called(kinds)}>{body}</{tag}>"

    def advert() -> str:
        label = r.choice(["", "", f"<span>{words(1, 1)}</span>", f'<span class="ad-label">{words(1, 1)}</span>'])
        return named("ad ads advert advertisement sponsored promo banner adbox sponsor ad-slot", label + r.choice([prose(1, 2), words(3, 8), f"<p>{prose(1, 3)}</p>", f"<p>{prose(1, 3)}</p>"]), "div div aside")

    def notice() -> str:
        return named("cookie notice consent alert newsletter subscribe popup paywall gdpr message cookie-banner", r.choice([prose(1, 3), f"<p>{prose(1, 2)}</p>"]) + r.choice(["", "<button>OK</button>", link()]))

    def side() -> str:
        part = lambda: r.choice([f"<h3>{words(1, 3)}</h3>", f"<ul><li>{link()}</li><li>{link()}</li></ul>", f"<p>{prose(1, 3)}</p>", f'<section class="widget {company()}"><h2 class="widget-title">{words(1, 3)}</h2><p>{prose(1, 2)}</p></section>', f'<div class="teaser"><a href="/x"><h3>{words(2, 6)}</h3><p>{prose(1, 1)}</p></a></div>'])
        body = "".join(part() for _ in range(r.randint(1, 4)))
        return r.choice([f"<aside>{body}</aside>", f'<aside {called("sidebar secondary rail widget complementary")}>{body}</aside>', named("sidebar related widget share social tags recommended popular trending side rail most-read teaser", body)])

    def form() -> str:
        return r.choice([f"<form><label>{words(1, 3)}</label><input name=q><button>{words(1, 1)}</button></form>", f'<form class="search"><p>{sentence()}</p><input><button>Go</button></form>', f"<form><fieldset><legend>{words(1, 2)}</legend><label>{words(1, 4)} <input></label></fieldset></form>"])

    def comments() -> str:
        one = lambda: r.choice([f'<div class="comment"><span class="author">{words(1, 2)}</span><p>{prose(1, 5)}</p></div>', f'<li class="comment even depth-1"><p>{prose(1, 4)}</p></li>', f'<article class="comment"><p>{prose(1, 4)}</p></article>', f'<li id="comment-9" class="comment {company()}"><article class="comment-body"><footer class="comment-meta"><b>{words(1, 2)}</b></footer><div class="comment-content"><p>{prose(1, 3)}</p></div></article></li>'])
        respond = f'<div id="respond" class="comment-respond"><h3>{words(1, 3)}</h3><form><p class="comment-notes">{prose(1, 2)}</p></form></div>' * (r.random() < 0.3)
        return r.choice(['<section class="comments">{}</section>', '<div id="comments">{}</div>', '<div id="comments" class="comments-area">{}</div>', '<section id="respond" class="discussion">{}</section>', '<div class="comment-list">{}</div>', '<ol class="commentlist replies">{}</ol>']).format(r.choice(["", f"<h3>{words(1, 3)}</h3>", f'<h2 class="comments-title">{words(2, 7)}</h2>']) + "".join(one() for _ in range(r.randint(1, 4))) + respond)

    def footer() -> str:
        body = r.choice([f"&copy; {words(1, 3)} &middot; {prose(1, 2)}", f"<p>{prose(1, 2)}</p>", f"<ul><li>{link()}</li><li>{link()}</li></ul><p>© 2024 {words(1, 3)}</p>", f"{link()} | {link()}", f"<ul><li>{prose(1, 1)}</li><li>{prose(1, 2)}</li></ul>"])
        return r.choice([f"<footer>{body}</footer>", f'<footer {called("footer bottom info")}>{body}</footer>', named("footer bottom copyright legal colophon contentinfo", body, "div"), f'<div role="contentinfo">{body}</div>'])

    def header() -> str:
        body = r.choice([f"<h1>{words(1, 3)}</h1>", f'<a class="logo" href="/">{words(1, 2)}</a>', f"<p>{sentence()}</p>", f"<h1>{words(1, 3)}</h1><p>{words(3, 8)}</p>", f'<p class="site-title"><a href="/">{words(1, 3)}</a></p><p class="site-description">{words(3, 8)}</p>', f'<div class="header-date">{words(2, 4)}</div>'])
        return r.choice([f"<header>{body}</header>", f'<header {called("header masthead branding")} role="banner">{body}</header>', named("header masthead branding top logo", body, "div")])

    def table(main: str) -> str:
        """A page laid out by a table of cells."""
        links = "<br>".join(link() for _ in range(r.randint(3, 6)))
        rows = [f'<tr><td colspan=2 class="{r.choice(["header", "top", "banner", "logo"])}"><font>{words(1, 3)}</font></td></tr>'] * (r.random() < 0.9)
        rows.append(f'<tr><td class="{r.choice(["menu", "nav", "left", "navigation"])}">{links}</td><td class="{r.choice(["content", "main", "text", "body"])}">{main}</td></tr>')
        rows += [f'<tr><td colspan=2 class="{r.choice(["footer", "bottom", "copyright"])}"><hr><font>{prose(1, 3)}</font></td></tr>'] * (r.random() < 0.9)
        whole = f"<table>{''.join(rows)}</table>"
        return re.sub(r"<(/?)(table|tr|td|font)\b", lambda m: f"<{m[1]}{m[2].upper()}", whole).replace("class=", "CLASS=") if r.random() < 0.5 else whole

    out, style = [], ""
    for _ in range(n):
        said: list[str] = []
        style = r.choice(["bars", "symbols", "capitals"]) if r.random() < 0.15 else ""
        main = main_blocks(said)
        style = ""
        if r.random() < 0.3:
            cut = main.find("</p>")
            if cut > 0:
                main = main[: cut + 4] + r.choice([advert, advert, side, notice, form])() + main[cut + 4 :]
        wrap = r.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div id="content">{}</div>', '<div class="post"><div class="entry-content">{}</div></div>', '<div class="article-body">{}</div>', '<section class="story main">{}</section>', "<table><tr><td>{}</td></tr></table>", '<div role="main">{}</div>', "{}"])
        if r.random() < 0.4:
            wrap = r.choice([f'<article class="{company()}">{{}}</article>', f'<main id="content" class="{company()}">{{}}</main>', f'<main role="main"><article class="post {company()}"><div class="entry-content">{{}}</div></article></main>', f'<div {called("content body text story post entry")}>{{}}</div>', f'<div {called("content body text story post entry")}><div {called("content text body output")}>{{}}</div></div>', f'<main class="{company()}"><div {called("content body text")}>{{}}</div></main>', f'<div role="main" class="document"><div itemprop="articleBody"><section>{{}}</section></div></div>', f'<div class="{company()}"><div class="post"><div class="post-body">{{}}</div></div></div>'])
        before = [f() for f in r.sample([header, lambda: menu(""), advert, notice, form, side], r.randint(0, 4))]
        after = [f() for f in r.sample([side, advert, comments, form, notice, lambda: menu(' class="related"')], r.randint(0, 4))] + [footer()] * (r.random() < 0.9)
        middle = wrap.format(main)
        if r.random() < 0.25:  # what follows the text stands in the same element
            middle = r.choice(["<main>{}</main>", '<div id="content">{}</div>', '<main id="main" class="site-main" role="main">{}</main>']).format(middle + "".join(after[:1]))
            after = after[1:]
        inner = table(main) if r.random() < 0.08 else "".join(before) + middle + "".join(after)
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            inner = f'<div class="{r.choice(["wrapper", "container", "page", "row", "site", "layout"])} {company()}">{inner}</div>'
        if r.random() < 0.4:
            inner = f'</div><div id="{r.choice(["page", "content", "root", "app"])}" class="{company()}">{inner}</div><div>' if r.random() < 0.5 else f'<section class="{company()}">{inner}</section>'
        out.append((f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title></head><body{r.choice(['', '', f' class="{company()}"'])}>{inner}</body></html>", said))
    return out


_FIELD: list[Field] = []


def trained() -> Field:
    """The field of the made pages; fitted once in a process."""
    if not _FIELD:
        pages = []
        for page, said in layouts(TRAINING_PAGES):
            found, left = blocks(page), list(said)
            labels = []
            for b in found:
                labels.append(int(bool(left) and b.text == " ".join(left[0].split())))
                if labels[-1]:
                    left.pop(0)
            pages.append((found, labels))
        _FIELD.append(fit(pages))
    return _FIELD[0]


def main_text(field: Field, page: str | None) -> str:
    found = blocks(page)
    return " ".join(b.text for b, y in zip(found, field.decode(found)) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text: the main text of every page."""
    weights = pages.sparkSession.sparkContext.broadcast((field or trained()).w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(weights.value)
        for b in sliced(batches):
            texts = [main_text(own, p) for p in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string")
