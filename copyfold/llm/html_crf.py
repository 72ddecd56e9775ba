"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, each
with the path of its open elements. Features of the path (tags, and words of
class, id and role) and of the text score each block as main text or not;
transitions tie neighbours; Viterbi decodes the page as a whole. Features of shape (lengths, links, how much of the
page is in the boxes around a block) tell text where names don't. The weights are
trained by maximum likelihood on labelled pages, which ``labelled_pages``
writes from layouts in common use, a part of them with opaque or foreign names.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from copyfold.llm.common import broadcast_object

#: Training: labelled pages, passes over them, step size, seed.
PAGES, PASSES, RATE, SEED = 1600, 5, 0.3, 3
#: Share of the training pages whose names say nothing of their parts.
DISGUISED = 0.4
#: Rows and characters of an output batch.
BATCH_ROWS, BATCH_CHARS = 1024, 4 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without markup inside, or with none of the page's text.
RAW = ("script", "style", "template", "iframe", "svg", "textarea", "title")
#: Form controls, in a form or not; what they say is no text of the page.
CONTROLS = ("button", "datalist", "label", "legend", "optgroup", "option", "select")
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img ins kbd map mark math merror mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder"
    " munderover nobr object output picture q rb rp rt ruby s samp semantics slot small span strike strong sub sup time tt u var video wbr".split()
)
#: Elements that say what their content is for.
SEMANTIC = frozenset("article main nav aside header footer form section dialog noscript".split())
#: Tags that don't end the head; elements whose names say something of the page, not of its parts.
HEAD, WHOLE = frozenset("html head base link meta title style script noscript template".split()), frozenset(("html", "body"))
#: Open elements that a start tag ends, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_P_ENDS = ({"p"}, {"button", "table", "article", "section", "aside", "div"})
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*|[^>]*)(>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_ENDS_RAW = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
# a drawing that is left open ends where the page's own markup goes on
_ENDS_RAW["svg"] = re.compile(r"</svg\b[^>]*(?:>|\Z)|(?=<(?:article|aside|blockquote|body|div|d[dlt]|footer|h[1-6]|header|img|li|main|menu|nav|ol|p|pre|section|table|ul)[\s/>])", re.I)
_NEXT_CONTROL = {name: re.compile(rf"<(/?){name}(?=[\s/>])", re.I) for name in CONTROLS}
_TAG_START = re.compile(r"<[a-zA-Z/!]")


class Node:
    """An open element, linked to the one around it, with the text in its blocks.

    fresh and below are the features that it adds to those of the elements around it: to all of them, and to those up to the
    nearest semantic element, ``around``.
    """

    __slots__ = ("tag", "names", "parent", "in_head", "words", "linked", "chars", "blocks", "around", "fresh", "below", "score")

    def __init__(self, tag: str, names: str, parent: Node | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.in_head = tag == "head" or (parent is not None and parent.in_head)
        self.words = self.linked = self.chars = self.blocks = 0
        self.around = "none" if parent is None else tag if tag in SEMANTIC else parent.around
        self.fresh, self.below, self.score = (), (), None

    def path(self) -> tuple:
        """(tag, names) of the open elements, this one last."""
        out, node = [], self
        while node.parent is not None:
            out.append((node.tag, node.names))
            node = node.parent
        return tuple(reversed(out))


class Known:
    """Which features the open elements have, so that each is named where it comes first. Elements come and go as on a stack."""

    def __init__(self):
        self.all: set[str] = set()
        self.frames: list[set[str]] = [set()]

    def enter(self, node: Node) -> None:
        words = node.names.split()
        node.fresh = tuple(f for f in dict.fromkeys((f"tag={node.tag}", *(f"name={w}" for w in words))) if f not in self.all)
        self.all.update(node.fresh)
        if node.tag in SEMANTIC:
            self.frames.append(set())
        node.below = tuple(f for w in dict.fromkeys(words) for f in (f"below={w}", f"{node.around}>{w}") if f not in self.frames[-1])
        self.frames[-1].update(node.below)

    def leave(self, node: Node) -> None:
        self.all.difference_update(node.fresh)
        if node.tag in SEMANTIC:
            self.frames.pop()
        else:
            self.frames[-1].difference_update(node.below)


class Block:
    """A leaf block: its text, the characters of it inside links, its words and the element around it."""

    __slots__ = ("text", "linked", "words", "node")

    def __init__(self, text: str, linked: int, node: Node):
        self.text, self.linked, self.words, self.node = text, linked, text.count(" ") + 1, node

    @property
    def path(self) -> tuple:
        return self.node.path()


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order, in time linear in the page's length and depth.

    Scripts, styles and other raw elements have none, nor have form controls, up to their end tags. Raw elements that close
    themselves are empty; of one that is never closed only the tag is passed over, and of a
    script or style what stands before the next tag. Tags that are left open
    end with an ancestor or the page; end tags without a start are passed over, and so is a tag that the page's end cuts.
    """
    blocks: list[Block] = []
    top = Node("", "", None)
    path: list[Node] = []
    open_at: dict[str, list[int]] = {}
    pieces: list[str] = []
    state = [0, 0]  # open links, characters inside links
    unclosed: set[str] = set()
    known = Known()
    silent = 0  # where the last form control ends

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                node = path[-1] if path else top
                if not node.in_head:
                    blocks.append(Block(text, state[1], node))
            pieces.clear()
        state[1] = 0

    def nearest(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

    def close(tags, until=()) -> None:
        i = nearest(tags)
        if i >= 0 and i > nearest(until):
            flush()
            for node in reversed(path[i:]):
                open_at[node.tag].pop()
                known.leave(node)
            del path[i:]

    def say(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if state[0]:
                state[1] += len(text)

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            tail = page[at:]
            cut = tail.rfind("<")
            say(tail[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z]*\Z", tail[cut:]) else tail)
            break
        if at >= silent:
            say(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                state[0] = 0
            elif name not in INLINE and name not in CONTROLS:
                if name == "p" and not open_at.get("p"):
                    flush()
                close((name,))
            continue
        if name in _ENDS_RAW:
            if m[3].endswith("/"):
                continue
            end = None if name in unclosed else _ENDS_RAW[name].search(page, at)
            if end is not None:
                at = end.end()
            else:
                unclosed.add(name)
                if name in ("script", "style"):
                    following = _TAG_START.search(page, at)
                    at = following.start() if following else n
            continue
        if name in CONTROLS:
            if at >= silent and name not in unclosed and not m[3].endswith("/"):
                following = _NEXT_CONTROL[name].search(page, at)
                if following is None:
                    unclosed.add(name)
                elif following[1] or name in ("optgroup", "option"):
                    silent = following.start()
            continue
        if name == "a":
            state[0] = 1
        if name in INLINE:
            if name in ("br", "img"):
                pieces.append(" ")
            continue
        flush()
        if name not in HEAD:
            close(("head",))
        if name in ENDS:
            close(*ENDS[name])
        else:
            close(*_P_ENDS)
        if name not in VOID and not m[3].endswith("/"):
            names = " ".join(dict.fromkeys(_WORD.findall(" ".join(_NAMED.findall(m[3])).lower()))) if m[3] and name not in WHOLE else ""
            open_at.setdefault(name, []).append(len(path))
            path.append(Node(name, names, path[-1] if path else top))
            known.enter(path[-1])
    flush()
    for block in blocks:
        box = block.node
        for _ in range(3):
            if box is None:
                break
            box.words, box.linked, box.chars, box.blocks = box.words + block.words, box.linked + block.linked, box.chars + len(block.text), box.blocks + 1
            box = box.parent
    return blocks


def path_features(path: tuple) -> list[str]:
    """Tags and names on the way to a block, the nearest tag and semantic element, and the names below the latter."""
    out = {f"tag={tag}" for tag, _ in path}
    around, below = "none", []
    for tag, names in path:
        words = names.split()
        out.update(f"name={word}" for word in words)
        if tag in SEMANTIC:
            around, below = tag, words
        else:
            below = below + words
    out.update(f"below={word}" for word in below)
    out.update(f"{around}>{word}" for word in below)
    if path:
        out.add(f"own={path[-1][0]}")
    out.add(f"nearest={around}")
    return sorted(out)


def _shape(block: Block) -> str:
    """Length and share of links of a block, coarsely."""
    return f"{min(block.words.bit_length(), 7) // 2},{min(2, 3 * block.linked // max(1, len(block.text)))}"


def text_features(blocks: list[Block], i: int, words: int) -> list[str]:
    """Length, links, punctuation and place of a block, its neighbours, and the boxes around it; ``words`` is the page's number.

    None of them depends on a language or on names.
    """
    block, n = blocks[i], len(blocks)
    text, node = block.text, block.node
    linked = min(4, 5 * block.linked // max(1, len(text)))
    out = [f"words={min(block.words.bit_length(), 7)}", f"linked={linked}"]
    ends = text[-1] in ".!?…\"”»。！？"
    if ends:
        out.append("sentence")
    if "©" in text or "opyright" in text or "all rights" in text.lower():
        out.append("rights")
    if "·" in text or "|" in text:
        out.append("bars")
    if "cookie" in text.lower():
        out.append("cookie")
    out.append("first" if i == 0 else "last" if i == n - 1 else f"at={4 * i // n}")
    out.append(f"before={_shape(blocks[i - 1])}" if i else "before=none")
    out.append(f"after={_shape(blocks[i + 1])}" if i < n - 1 else "after=none")
    own, box, hull = node.tag, node.parent or node, (node.parent.parent if node.parent else None) or node.parent or node
    for name, around in (("box", box), ("hull", hull)):
        share = 8 * around.words // max(1, words)
        out.append(f"{name}={share}")
        out.append(f"{name} links={min(4, 5 * around.linked // max(1, around.chars))}")
        out.append(f"{name} blocks={min(around.blocks.bit_length(), 4)}")
    out.append(f"{own},{int(ends)},{min(linked, 1)},{min(4, 8 * box.words // max(1, words))}")
    return out


class ChainField:
    """Weights of a two-label linear chain; label 1 is main text."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.move = np.zeros((2, 2))

    def _score(self, node: Node) -> tuple[float, float]:
        """What all features of the elements around a block sum up to, and those up to the nearest semantic element; found from the nearest element whose sums are known."""
        get, above, at = self.weights.get, [], node
        while at is not None and at.score is None:
            above.append(at)
            at = at.parent
        whole, below = at.score if at is not None else (0.0, 0.0)
        for at in reversed(above):
            if at.tag in SEMANTIC:
                below = 0.0
            whole += sum(get(f, 0.0) for f in at.fresh)
            below += sum(get(f, 0.0) for f in at.below)
            at.score = whole, below
        return node.score

    def emissions(self, blocks: list[Block]) -> list[float]:
        """For each block, how much more label 1 scores than label 0."""
        out, get, words = [], self.weights.get, sum(b.words for b in blocks)
        for i, block in enumerate(blocks):
            node = block.node
            score = sum(self._score(node)) + get(f"nearest={node.around}", 0.0) + (get(f"own={node.tag}", 0.0) if node.parent is not None else 0.0)
            out.append(score + sum(get(f, 0.0) for f in text_features(blocks, i, words)))
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels of a page, by Viterbi."""
        if not blocks:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        emissions = self.emissions(blocks)
        zero, one, back = 0.0, emissions[0], []
        for e in emissions[1:]:
            from0 = 0 if zero + m00 >= one + m10 else 1
            from1 = 0 if zero + m01 > one + m11 else 1
            zero, one = max(zero + m00, one + m10), max(zero + m01, one + m11) + e
            back.append((from0, from1))
        label = int(one > zero)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]

    def fit(self, pages: list[tuple[list[Block], list[int]]], passes: int = PASSES, rate: float = RATE, seed: int = SEED) -> ChainField:
        """Raise the likelihood of the labels, page by page, with step sizes from past gradients."""
        rng = random.Random(seed)
        past: dict = {}
        rows = []
        for blocks, labels in pages:
            if blocks:
                words = sum(b.words for b in blocks)
                feats = [path_features(b.path) + text_features(blocks, i, words) for i, b in enumerate(blocks)]
                rows.append((feats, labels))
        for _ in range(passes):
            rng.shuffle(rows)
            for feats, labels in rows:
                e = np.array([sum(self.weights.get(f, 0.0) for f in fs) for fs in feats])
                single, pair = _marginals(e, self.move)
                for fs, p, y in zip(feats, single, labels):
                    g = y - p
                    if abs(g) > 1e-4:
                        for f in fs:
                            past[f] = past.get(f, 1e-3) + g * g
                            self.weights[f] = self.weights.get(f, 0.0) * (1 - 1e-4) + rate * g / past[f] ** 0.5
                seen = np.zeros((2, 2))
                np.add.at(seen, (labels[:-1], labels[1:]), 1)
                g = seen - pair
                past["move"] = past.get("move", 1e-3) + g * g
                self.move += rate * g / np.sqrt(past["move"])
        return self


def _marginals(e: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of label 1 for each block, and expected counts of the moves between neighbours."""
    n = len(e)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = 0, e[0]
    for i in range(1, n):
        ahead[i] = np.logaddexp(ahead[i - 1, 0] + move[0], ahead[i - 1, 1] + move[1])
        ahead[i, 1] += e[i]
    for i in range(n - 2, -1, -1):
        onward = behind[i + 1] + (0, e[i + 1])
        behind[i] = np.logaddexp(move[:, 0] + onward[0], move[:, 1] + onward[1])
    total = np.logaddexp(*ahead[-1])
    single = np.exp(ahead[:, 1] + behind[:, 1] - total)
    onward = behind[1:] + np.stack([np.zeros(n - 1), e[1:]], axis=1)
    pair = np.exp(ahead[:-1, :, None] + move[None] + onward[:, None, :] - total).sum(axis=0)
    return single, pair


#: Marks main text in the pages that labelled_pages writes.
MARK = "\x02"
#: Names that sites in other languages give the parts of a page, by the English one.
FOREIGN = {
    "menu": ("menue", "menú", "menü", "navigazione", "navegacion", "hauptmenue"),
    "nav": ("navegacao", "navi", "navigation", "navegación"),
    "header": ("kopf", "kopfzeile", "entete", "cabecera", "cabeçalho", "intestazione", "encabezado"),
    "footer": ("fuss", "fusszeile", "pied", "pie", "rodape", "rodapé", "piede", "fußzeile"),
    "sidebar": ("seitenleiste", "barra", "colonne", "lateral", "seite"),
    "related": ("verwandt", "relacionados", "connexes", "correlati", "weitere"),
    "comments": ("kommentare", "commentaires", "comentarios", "comentários", "commenti", "reacties", "leserbriefe", "kommentarer"),
    "comment": ("kommentar", "commentaire", "comentario", "comentário", "commento", "reactie"),
    "reply": ("antwort", "reponse", "respuesta", "resposta", "risposta"),
    "advert": ("werbung", "anzeige", "publicidad", "publicite", "pubblicita", "publicidade"),
    "ad": ("anzeigen", "pub", "anuncio"),
    "newsletter": ("rundbrief", "boletin", "infolettre", "boletim"),
    "search": ("suche", "recherche", "buscar", "busca", "ricerca"),
    "notice": ("hinweis", "aviso", "avis", "avviso"),
    "article": ("artikel", "articulo", "artigo", "articolo", "artículo", "beitrag"),
    "content": ("inhalt", "contenu", "contenido", "conteudo", "contenuto"),
    "text": ("texte", "texto", "testo", "fliesstext"),
}


def _disguised(page: str, rng: random.Random) -> str:
    """The page with class names and ids that say nothing, or say it in other languages, and mostly without semantic tags."""
    foreign, opaque = rng.random() < 0.65, {}

    def name(word: str) -> str:
        if foreign:
            return rng.choice(FOREIGN[word]) if word in FOREIGN else word
        return opaque.setdefault(word, rng.choice(("x", "css", "c", "jsx", "sc", "u")) + rng.choice(("", "-", "_")) + "".join(rng.choice("abcdefghkmnpqrstvwxyz0123456789") for _ in range(rng.randint(1, 6))))

    page = re.sub(r'(class|id)="([^"]*)"', lambda m: f'{m[1]}="{" ".join("-".join(name(part) for part in re.split("[-_]", w)) for w in m[2].split())}"', page)
    page = re.sub(r' role="[^"]*"', "", page)
    for tag in sorted(SEMANTIC - {"form", "noscript"}):
        if rng.random() < 0.6:
            page = re.sub(rf"<(/?){tag}\b", r"<\1div", page)
    return page


def labelled_pages(n: int = PAGES, seed: int = SEED, disguised: float = 0.0) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of ``n`` pages in varied layouts: semantic or plain tags, menus, adverts, notices, forms, comments, sloppy markup.

    A share of ``disguised`` has names that don't tell what a part is for.
    """
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(("ta", "re", "on", "schu", "é", "los", "ing", "pa")) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(low, high)))

    def sentence(low=4, high=40) -> str:
        return words(low, high).capitalize() + rng.choice((".", ".", ".", "!", "?", ""))

    def main(text: str) -> str:
        return MARK + text

    def named(*names: str) -> str:
        tail = rng.choice(("", "", "-1", " box", "-wrap", " clearfix", "_main"))
        return f'{rng.choice(("class", "class", "id"))}="{rng.choice(names)}{tail}"'

    def links(count: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(count))

    def menu() -> str:
        inner = f"<ul>{links(rng.randint(1, 9))}</ul>"
        return rng.choice((f"<nav>{inner}</nav>", f'<div {named("menu", "nav", "navbar", "breadcrumb", "topnav", "navigation")}>{inner}</div>', f"<nav>{words(1, 3)} <a href=/>{words(1, 2)}</a></nav>"))

    def advert() -> str:
        name = named("ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "sponsor", "adbox")
        return rng.choice((f"<div {name}>{sentence(3, 25)}</div>", f"<div {name}><p>{sentence(3, 25)}</p></div>", f"<aside {name}><a href=/x>{sentence(3, 12)}</a></aside>", f"<section {name}>{sentence()}</section>"))

    def notice() -> str:
        name = named("cookie", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "paywall", "disclaimer", "message", "warning", "banner")
        text = rng.choice((sentence(), f"We use cookies. {sentence()}", f"{words(2, 5)} cookie {sentence()}"))
        return rng.choice((f"<div {name}><p>{text}</p><button>{words(1, 2)}</button></div>", f"<div {name}>{text}</div>", f'<div role="{rng.choice(("dialog", "alert", "banner"))}"><p>{text}</p></div>', f"<dialog>{text}</dialog>", f"<p {name}>{text}</p>", f"<noscript>{text}</noscript>", f"<noscript><p>{text}</p></noscript>"))

    def form() -> str:
        inner = f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button>"
        return rng.choice((f"<form>{inner}</form>", f"<form {named('search', 'login', 'newsletter', 'contact', 'signup')}><p>{sentence(3, 20)}</p>{inner}</form>", f"<form><select><option>{words(1, 2)}<option>{words(1, 2)}</select><p>{sentence(3, 12)}</form>"))

    def share() -> str:
        name = named("share", "social", "sharing", "share-bar", "social-links", "toolbar", "actions", "sharebuttons", "share-buttons")
        return rng.choice((f"<p {name}><a href=/s>{words(1, 2)}</a></p>", f"<div {name}>{''.join(f'<a href=/s>{words(1, 1)}</a> ' for _ in range(rng.randint(1, 4)))}</div>", f"<ul {name}>{links(rng.randint(1, 4))}</ul>"))

    def sidebar() -> str:
        inner = "".join(rng.choice((f"<h3>{words(1, 4)}</h3>", f"<p>{sentence()}</p>", f"<ul>{links(rng.randint(1, 5))}</ul>")) for _ in range(rng.randint(1, 4)))
        return rng.choice((f"<aside>{inner}</aside>", f'<div {named("sidebar", "side", "widget", "related", "recommended", "trending", "popular", "share", "social", "tags", "rail")}>{inner}</div>', f'<section {named("related", "sidebar", "more", "recommended")}>{inner}</section>'))

    def comments() -> str:
        each = [rng.choice((f"<p>{sentence()}</p>", f"<p>{sentence()}</p><p>{sentence()}</p>", sentence(), f"<b>{words(1, 2)}</b>: {sentence()}")) for _ in range(rng.randint(1, 5))]
        name = named("comments", "comment", "comment-list", "discussion", "responses", "replies", "disqus", "user-comments", "reader-comments", "respond", "feedback", "commentlist", "comments-area", "usercomments")
        inner = rng.choice(("".join(f"<div {named('comment', 'reply', 'response', 'post')}>{c}</div>" for c in each), "".join(f"<li>{c}</li>" for c in each), "".join(f"<article {named('comment', 'reply')}>{c}</article>" for c in each), "".join(each)))
        return f"<{(tag := rng.choice(('div', 'section', 'ol', 'ul', 'aside')))} {name}><h{(k := rng.choice('234'))}>{words(1, 3)}</h{k}>{inner}</{tag}>"

    def paragraphs() -> str:
        out = []
        # where names tell nothing, what is brief can't be told from a notice
        brief = rng.random() < 0.15 and not hidden
        for i in range(rng.randint(1, 3 if brief else 12)):
            text = main(sentence(1, 4) if brief or rng.random() < 0.06 else " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 3, 6)))))
            out.append(rng.choices((
                f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text} <a href=/y>{words(1, 4)}</a> {words(1, 9)}</p>", f"<h2>{main(words(1, 6))}</h2>", f"<ul><li>{text}</li><li>{main(words(1, 9))}</li></ul>",
                f"<blockquote>{text}</blockquote>", f"<blockquote><p>{text}</p></blockquote>", f"<table><tr><td>{main(words(1, 3))}</td><td>{text}</td></tr></table>", f"<pre>{text}</pre>", f"<div>{text}</div>", f"<section><h3>{main(words(1, 4))}</h3><p>{text}</p></section>", f"<figure><img src=a><figcaption>{text}</figcaption></figure>", f"<p>{main(words(1, 4))}</p>", f"<p>{text} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {words(1, 9)}</p>", f"<ol><li>{text}<li>{text}</ol>", f"<p><i>{text}</i><br>{words(3, 9)}</p>",
            ), (40, 12, 12, 6, 5, 3, 2, 2, 2, 1, 4, 3, 1, 4, 1, 2, 3))[0])
            if rng.random() < 0.13:
                out.append(rng.choice((advert, notice, form, sidebar, share))())
        if rng.random() < 0.12:
            line = rng.choice(("All rights reserved.", "Copyright 2021 " + words(1, 3), sentence(3, 9) + " All rights reserved.", words(2, 9) + " cookie " + sentence(3, 9), words(1, 5) + " | " + words(1, 5)))
            out.insert(rng.choice((0, len(out), len(out))), f"<p>{main(line)}</p>")
        text = "".join(out)
        return re.sub(r"<(/?)p>", r"<\1div>", text) if rng.random() < 0.12 else text

    def page() -> str:
        head = "<!DOCTYPE html><html><head><title>" + words(1, 5) + "</title><style>p{}</style><script>var a='</p>';</script></head><body>"
        title = rng.choice((f"<h1>{main(words(2, 10))}</h1>", f"<h1>{main(words(2, 10))}</h1>", f"<header><h1>{main(words(2, 10))}</h1></header>", f"<h2>{main(words(2, 8))}</h2>", ""))
        body = title + paragraphs()
        name = named("content", "article", "post", "entry", "story", "main", "body", "text", "post-content", "article-body", "entry-content", "page")
        body = rng.choices((f"<article>{body}</article>", f"<main>{body}</main>", f"<main><article {name}>{body}</article></main>", f"<div {name}>{body}</div>", f"<div {name}><div>{body}</div></div>", f"<section {name}>{body}</section>", f"<div>{body}</div>", body), (10, 4, 4, 6, 3, 2, 2, 1))[0]
        if rng.random() < 0.12:
            body = body.replace("</article>", comments() + "</article>") if "</article>" in body else body
        top = "".join(p() for p, chance in ((lambda: f"<header><h1>{words(1, 3)}</h1><p>{sentence(2, 9)}</p>{menu()}</header>", 0.2), (lambda: f'<div {named("header", "masthead", "top", "site-header", "logo")}>{words(1, 6)}</div>', 0.25), (menu, 0.7), (notice, 0.3), (advert, 0.5), (form, 0.15), (sidebar, 0.2)) if rng.random() < chance)
        rights = rng.choice(("&copy; ", "", "Copyright 2020 ", "&copy; example.org &middot; "))
        tail = "".join(p() for p, chance in ((comments, 0.6), (sidebar, 0.35), (advert, 0.3), (form, 0.2), (menu, 0.2), (notice, 0.2)) if rng.random() < chance)
        foot = rng.choice((f"<footer>{rights}{sentence(2, 25)}</footer>", f"<footer><p>{rights}{sentence(2, 25)}</p><ul>{links(3)}</ul></footer>", f'<div {named("footer", "bottom", "site-footer", "colophon", "legal", "copyright")}>{rights}{sentence(2, 25)}</div>', ""))
        text = head + top + body + tail + foot
        return text + "</body></html>" if rng.random() < 0.9 else text

    out = []
    for _ in range(n):
        hidden = rng.random() < disguised
        text = page()
        blocks = leaf_blocks(_disguised(text, rng) if hidden else text)
        labels = [int(MARK in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(MARK, "").strip() or "x"
        out.append((blocks, labels))
    return out


def trained(pages: list[tuple[list[Block], list[int]]] | None = None) -> ChainField:
    """A chain field fitted to ``pages``; by default to those of labelled_pages, a part of them disguised."""
    return ChainField().fit(labelled_pages(disguised=DISGUISED) if pages is None else pages)


def main_text(page: str, field: ChainField) -> str:
    """The blocks of ``page`` that ``field`` decodes as main text, one in a line."""
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, label in zip(blocks, field.decode(blocks)) if label)


def extract_main_text(pages: DataFrame, field: ChainField | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text; ids and urls pass as they are, so
    null or repeated ones do no harm. Whole pages are read, of any length and depth. An
    empty table gives no rows. Further columns are not read.
    """
    model = broadcast_object(pages.sparkSession, field or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = model()
        names = ["page_id", "url", "text", "n_chars"]
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                texts, chars, start = [], 0, at
                while at < whole.num_rows and at - start < BATCH_ROWS and chars < BATCH_CHARS:
                    texts.append(main_text(whole.column(2)[at].as_py() or "", chain))
                    chars += len(texts[-1])
                    at += 1
                part = whole.slice(start, at - start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=names)

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
