"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A tolerant reader turns HTML into its leaf blocks: runs of text between block-level tags, each with the open tags above
it and the words of their class and id attributes. Features are the ancestor tags, those words, the text (length, links,
punctuation, place in the page), and what the parts around a block hold: the share of the page's text outside links that
its parent and grandparent element have, and how much of them is links. So pages without telling names or tags, articles
in tables and pages that are nothing but an article are read too. A chain over the blocks of a page with two labels, trained by gradient ascent on
the conditional likelihood, is decoded by Viterbi, and the blocks labelled as article are the text.

The chain is trained on labelled pages that `labelled_pages` lays out by rule from TRAINING_PAGES seeds: articles among
menus, headers, footers, sidebars, notices, adverts, forms and reader comments, with telling, strange and no names, in
elements that tell, nested division or table cells, and articles alone. Nothing of the corpus is used in training, and every
page is decoded whole.

Defined cases: null and empty html and pages without article blocks give an empty text; unclosed tags, comments and
scripts are closed where the page or the enclosing tag ends; repeated pages give repeated rows; very long pages are read
in one pass; extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import trimmed

TRAINING_PAGES = 600
ROUNDS = 150

# HTML's block-level, void and raw-text elements.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html iframe legend li main menu nav noscript ol option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul video".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
HIDDEN = frozenset("head title script style noscript iframe template textarea select option button svg xmp noembed noframes".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body article section main nav header footer aside div table td th ul ol form blockquote figure".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>?))", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ENDS = frozenset(".!?…\"”»")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    names: tuple[str, ...]
    link_share: float
    #: For the parent and grandparent element of the block's own: the share of the page's text outside links, the share of links, and blocks that end a sentence.
    around: tuple[tuple[float, float, int], ...] = ((0.0, 0.0, 0), (0.0, 0.0, 0))


@dataclass
class _Open:
    tag: str
    names: tuple[str, ...] = field(default=())
    #: Signs outside links and in links, and blocks that end a sentence, below the element.
    plain: float = 0.0
    linked: float = 0.0
    sentences: int = 0


def leaf_blocks(page: str | None) -> list[Block]:
    """Runs of visible text in page order."""
    out: list[Block] = []
    page_part = _Open("")
    stack: list[_Open] = []
    parents: list[tuple[_Open, _Open]] = []
    text: list[str] = []
    linked = 0
    hidden = 0
    in_link = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                names = tuple(n for o in stack for n in o.names)
                share = min(1.0, linked / max(1, len(joined)))
                out.append(Block(joined, tuple(o.tag for o in stack), names, share))
                for o in (page_part, *stack):
                    o.plain += len(joined) * (1 - share)
                    o.linked += len(joined) * share
                    o.sentences += joined[-1] in ENDS
                above = [o for o in stack if o.tag in BLOCKS][-3:-1]
                above = [page_part] * (2 - len(above)) + above
                parents.append((above[1], above[0]))
            text.clear()
        linked = 0

    def pop(n: int) -> None:
        nonlocal hidden, in_link
        while len(stack) > n:
            tag = stack.pop().tag
            hidden -= tag in HIDDEN
            in_link -= tag == "a"

    at, page = 0, page or ""
    end = len(page)
    while at < end:
        found = _TAG.search(page, at)
        stop = found.start() if found else end
        if stop > at and not hidden:
            text.append(page[at:stop])
            linked += (stop - at) * (in_link > 0)
        if not found:
            break
        at = found.end()
        if not (name := found[2]):
            continue
        tag = name.lower()
        if found[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    if any(o.tag in BLOCKS for o in stack[k:]):
                        flush()
                    pop(k)
                    break
                if stack[k].tag in ("body", "html") or (tag not in SCOPES and stack[k].tag in SCOPES):
                    if tag in BLOCKS:
                        flush()
                    break
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p" or stack[k].tag in SELF_CLOSING.get(tag, ()):
                    pop(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        if tag in VOID or found[3].endswith("/>") and tag not in BLOCKS:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        names = tuple(w for m in _NAMES.finditer(found[3]) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())) if found[3] != ">" else ()
        stack.append(_Open(tag, names))
        hidden += tag in HIDDEN
        in_link += tag == "a"
    flush()
    for block, two in zip(out, parents, strict=True):
        block.around = tuple((o.plain / max(1.0, page_part.plain), o.linked / max(1.0, o.plain + o.linked), o.sentences) for o in two)
    return out


# Words in class and id attributes that tell what a part is for.
PART_WORDS = {
    "content": "article content entry main post story text body prose".split(),
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs tabs toc".split(),
    "frame": "header footer masthead topbar site copyright legal".split(),
    "side": "sidebar aside widget related recommended popular more tags share social".split(),
    "notice": "cookie cookies notice consent banner alert gdpr popup modal newsletter subscribe".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion".split(),
    "comment": "comment comments reply replies discussion disqus respond".split(),
    "form": "form login search signup".split(),
}
_PART_OF = {w: part for part, words in PART_WORDS.items() for w in words}
ANCESTORS = "article main section nav header footer aside form ul ol li table blockquote figure figcaption p div a h1 h2 h3 body pre".split()
FEATURES = [
    "bias", *[f"in_{a}" for a in ANCESTORS], *[f"part_{p}" for p in PART_WORDS], "own_p", "own_heading", "own_li", "own_div", "own_td", "words_3", "words_10", "words_25", "words_60",
    "ends_sentence", "commas", "linked_some", "linked_most", "copyright", "first", "last", "upper", "few_blocks", "longest",
    *[f"{who}_{what}" for who in ("parent", "grand") for what in ("share_20", "share_50", "share_80", "linked_20", "linked_50", "sentences_2", "sentences_4")],
]
_AT = {name: k for k, name in enumerate(FEATURES)}


def _context(tags: tuple[str, ...], names: tuple[str, ...]) -> list[int]:
    found = {_AT["bias"]} | {_AT[f"in_{t}"] for t in tags if f"in_{t}" in _AT} | {_AT[f"part_{_PART_OF[n]}"] for n in names if n in _PART_OF}
    own = next((t for t in reversed(tags) if t in BLOCKS), "")
    kind = "own_heading" if re.fullmatch("h[1-6]", own) else f"own_{own}"
    return sorted(found | ({_AT[kind]} if kind in _AT else set()))


def features(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), len(FEATURES)), np.float64)
    contexts: dict[tuple, list[int]] = {}
    for k, b in enumerate(blocks):
        if (context := contexts.get((b.tags, b.names))) is None:
            context = contexts[b.tags, b.names] = _context(b.tags, b.names)
        x[k, context] = 1
        words = b.text.count(" ") + 1
        for size in (3, 10, 25, 60):
            x[k, _AT[f"words_{size}"]] = words >= size
        x[k, _AT["ends_sentence"]] = b.text[-1] in ENDS
        x[k, _AT["commas"]] = "," in b.text
        x[k, _AT["linked_some"]] = b.link_share > 0.2
        x[k, _AT["linked_most"]] = b.link_share > 0.7
        x[k, _AT["copyright"]] = "©" in b.text
        x[k, _AT["upper"]] = b.text.isupper()
        for who, (share, linked, sentences) in zip(("parent", "grand"), b.around, strict=True):
            at = _AT[f"{who}_share_20"]
            x[k, at : at + 7] = share >= 0.2, share >= 0.5, share >= 0.8, linked >= 0.2, linked >= 0.5, sentences >= 2, sentences >= 4
    if len(blocks):
        x[0, _AT["first"]] = x[-1, _AT["last"]] = 1
        x[:, _AT["few_blocks"]] = len(blocks) <= 3
        x[int(np.argmax([len(b.text) * (1 - b.link_share) for b in blocks])), _AT["longest"]] = 1
    return x


@dataclass
class Chain:
    """Emission weights (features, 2) and transition weights (2, 2)."""

    emission: np.ndarray
    transition: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0, int)
        scores = x @ self.emission
        best, back = scores[0], np.zeros((len(x), 2), int)
        for t in range(1, len(x)):
            step = best[:, None] + self.transition
            back[t] = step.argmax(0)
            best = step.max(0) + scores[t]
        path = np.zeros(len(x), int)
        path[-1] = best.argmax()
        for t in range(len(x) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path


def train(pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, rate: float = 0.3, ridge: float = 2.0) -> Chain:
    """Conditional maximum likelihood by full-batch Adagrad; forward and backward run over all pages at once."""
    longest, width = max(len(y) for _, y in pages), len(FEATURES)
    x, y, mask = np.zeros((len(pages), longest, width)), np.zeros((len(pages), longest), int), np.zeros((len(pages), longest), bool)
    for k, (rows, labels) in enumerate(pages):
        x[k, : len(labels)], y[k, : len(labels)], mask[k, : len(labels)] = rows, labels, True
    gold = np.eye(2)[y] * mask[..., None]
    pair_mask = mask[:, 1:] & mask[:, :-1]
    gold_pairs = np.einsum("pta,ptb,pt->ab", gold[:, :-1], gold[:, 1:], pair_mask.astype(float))
    w, v = np.zeros((width, 2)), np.zeros((2, 2))
    seen_w, seen_v = np.full_like(w, 1e-6), np.full_like(v, 1e-6)
    for _ in range(rounds):
        s = (x @ w) * mask[..., None]
        forward, backward = np.zeros_like(s), np.zeros_like(s)
        forward[:, 0] = s[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(forward[:, t - 1, :, None] + v, axis=1) + s[:, t]
            forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(v + (s[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        single = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        joint = forward[:, :-1, :, None] + v + (s[:, 1:] + backward[:, 1:])[:, :, None, :]
        pairs = (np.exp(np.minimum(joint - total[:, None, None, None], 0)) * pair_mask[..., None, None]).sum((0, 1))
        grad_w = np.einsum("ptf,pta->fa", x, gold - single) - ridge * w
        grad_v = gold_pairs - pairs - ridge * v
        seen_w += grad_w**2
        seen_v += grad_v**2
        w += rate * grad_w / np.sqrt(seen_w)
        v += rate * grad_v / np.sqrt(seen_v)
    return Chain(w, v)


def labelled_pages(count: int = TRAINING_PAGES, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages laid out by rule, each with the texts of its article's blocks."""
    r = random.Random(seed)
    syllables = "ka lo mi ren sta ver un do pe ri tal os en qua shi bra".split()

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(r.randint(low, high)))

    def sentence(low: int = 5, high: int = 18) -> str:
        s = words(low, high).capitalize()
        return (s.replace(" ", ", ", 1) if r.random() < 0.4 else s) + r.choice("....!?")

    def attr(kind: str) -> str:
        """A telling name, a strange one or none."""
        name = r.choice([r.choice(PART_WORDS[kind])] * 5 + [word()] * 2 + [""] * 3)
        return f' {r.choice(["class", "id"])}="{name}"' if name else ""

    def link(low: int, high: int) -> str:
        return f'<a href="/{word()}">{words(low, high)}</a>'

    def menu() -> str:
        t = r.choice(["li", "li", "li", "span", "td", "p"])
        items = "".join(f"<{t}>{link(1, 2)}</{t}>" for _ in range(r.randint(3, 8)))
        items = {"li": f"<ul>{items}</ul>", "td": f"<table><tr>{items}</tr></table>"}.get(t, items)
        return f"<nav{attr('menu')}>{items}</nav>" if r.random() < 0.5 else f"<div{attr('menu')}>{items}</div>"

    def head() -> str:
        t = r.choice(["header", "header", "div"])
        return f"<{t}{attr('frame')}><p>{r.choice([words(2, 5), link(1, 3)])}</p></{t}>"

    def foot() -> str:
        t = r.choice(["footer", "footer", "div"])
        return f"<{t}{attr('frame')}>{r.choice(['&copy; ', '&copy; ', '' if t == 'footer' else '&copy; '])}{words(2, 4)} {r.choice([sentence(), link(1, 3) + ' ' + link(1, 2)])}</{t}>"

    def side() -> str:
        body = f"<h3>{words(1, 3)}</h3>" + "".join(f"<p>{link(2, 6)}</p>" for _ in range(r.randint(1, 4))) + (f"<p>{sentence()}</p>" if r.random() < 0.4 else "")
        return f"<aside{attr('side')}>{body}</aside>" if r.random() < 0.6 else f'<div class="{r.choice(PART_WORDS["side"])}">{body}</div>'

    def boxed(kind: str) -> str:
        inner = sentence(4, 25)
        inner = f"<p>{inner}</p>" if r.random() < 0.5 else inner
        return f'<div class="{r.choice(PART_WORDS[kind])}">{inner}</div>'

    def comments() -> str:
        rows = "".join(f"<{t}><b>{word()}</b> {sentence(4, 20)}</{t}>" for t in [r.choice(["p", "li", "div"])] for _ in range(r.randint(1, 5)))
        return f'<{(t := r.choice(["section", "div"]))} class="{r.choice(PART_WORDS["comment"])}"><h2>{words(1, 2)}</h2>{rows}</{t}>'

    def form() -> str:
        return f"<form{attr('form')}><label>{words(1, 3)}</label><input name=q><p>{words(2, 5)}</p></form>"

    def article(alone: bool) -> tuple[str, list[str]]:
        out, texts = [], []
        own = r.choice(["p"] * 7 + ["div"])
        for k in range(r.choice([1, 2, *range(1, 10)])):
            t = "h1" if k == 0 and r.random() < 0.6 else r.choice([own] * 7 + ["h2", "li", "blockquote", "figcaption"])
            body = words(2, 7) if t[0] == "h" else " ".join(sentence() for _ in range(r.randint(1, 6)))
            body = body.upper() if r.random() < 0.06 else body
            body = words(1, 6) if t == "figcaption" or t == "p" and r.random() < 0.1 else body
            texts.append(body)
            body = f'<a href="/{word()}">{body.split()[0]}</a>{body[len(body.split()[0]):]}' if t == "p" and r.random() < 0.2 else body
            body = f"<b>{body}" if r.random() < 0.1 else body
            whole = f"<{t}>{body}" + ("" if t == "p" and r.random() < 0.1 else f"</{t}>")
            out.append({"li": f"<ul>{whole}</ul>", "figcaption": f"<figure><img src=x>{whole}</figure>"}.get(t, whole))
            if not alone and r.random() < 0.06:
                out.append(boxed("advert"))
        if all(len(t.split()) < 12 for t in texts):
            texts.append(" ".join(sentence(8, 18) for _ in range(r.randint(1, 4))))
            out.append(f"<p>{texts[-1]}</p>")
        whole = "".join(out)
        shape = r.random()
        if shape < 0.35:
            return f"<article{attr('content')}>{whole}</article>", texts
        if shape < 0.5:
            t = r.choice(["main", "main", "section"])
            return f"<{t}{attr('content')}>{whole}</{t}>", texts
        if shape < 0.8:
            for _ in range(r.choice([1, 1, 2, 3])):
                whole = f"<div{attr('content')}>{whole}</div>"
            return whole, texts
        return (f"<table><tr><td>{whole}</td></tr></table>" if shape < 0.9 else whole), texts

    pages = []
    for _ in range(count):
        alone = r.random() < 0.08
        body, texts = article(alone)
        before = [p() for p in (menu, head, lambda: boxed("notice"), lambda: boxed("advert"), form, side) if not alone and r.random() < 0.5]
        after = [p() for p in (side, comments, form, lambda: boxed("advert"), lambda: boxed("notice")) if not alone and r.random() < 0.45]
        last = foot() if not alone and r.random() < 0.8 else ""
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.12:  # a table lays the page out
            cells = [f"<td>{''.join(x)}</td>" for x in (before, [body], after) if x]
            whole = f"<table><tr>{''.join(cells)}</tr><tr><td>{last}</td></tr></table>"
        else:
            whole = "".join([*before, body, *after, last])
        whole = f"<div{attr('content')}>{whole}</div>" if r.random() < 0.2 else whole
        pages.append((f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title></head><body>{whole}</body></html>", texts))
    return pages


def labels_for(blocks: list[Block], texts: list[str]) -> np.ndarray:
    """Mark, in order, the blocks whose text is the next article text."""
    y, at = np.zeros(len(blocks), int), 0
    for k, b in enumerate(blocks):
        if at < len(texts) and b.text == texts[at]:
            y[k], at = 1, at + 1
    return y


@lru_cache(1)
def trained_chain() -> Chain:
    pages = []
    for page, texts in labelled_pages():
        blocks = leaf_blocks(page)
        pages.append((features(blocks), labels_for(blocks, texts)))
    return train([p for p in pages if len(p[1])])


def main_text(page: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, label in zip(blocks, chain.decode(features(blocks)), strict=True) if label)


def extract(pages: DataFrame, *, html_col: str = "html", out_col: str = "text", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns with the main text of each page."""
    source = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))
    weights = source.sparkSession.sparkContext.broadcast((trained_chain().emission, trained_chain().transition))
    schema = source.select(*keep, F.lit("").alias(out_col)).schema

    def run(batches):
        chain = Chain(*weights.value)
        for batch in batches:
            texts = [main_text(p, chain) for p in batch["__html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keep], pa.array(texts, pa.string())], names=[*keep, out_col])

    return source.mapInArrow(trimmed(run), schema)


def extraction_report(pages: DataFrame) -> DataFrame:
    """The result of op8."""
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))
