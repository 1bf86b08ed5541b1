"""HTML pages as sequences of leaf blocks, and the features of a block.

A block is the text between two boundaries of block-level elements. It knows the
open elements above it, by tag name and by the words of class, id and role, and how
much of it is link text. Scripts, styles and other undisplayed elements are
skipped, as are comments, but the text of formulas and what stands in for an object is kept; character references are decoded; white space becomes
one space; ``br`` is white space.

Reading a page takes time in proportion to its length, also where tags, quotes or
elements aren't closed: what is known to have no end is not searched for again, and a
block knows its open elements by one number that adds up on the way down.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from html import unescape
from zlib import crc32

import numpy as np

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe".split())
#: Elements that are skipped as a whole if they have an end tag; an unclosed one hides nothing.
SKIPPED = frozenset("template svg annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav noscript ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the key ends an open element of these.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body div section article".split())

#: A tag whose attributes hold no angle brackets, which is nearly every tag.
_TAG = re.compile(r"""<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>"']*+)(?P<rest>(?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_LETTER = re.compile(r"</?[a-zA-Z]")
_COMMENT_END, _EMPTY_COMMENT = re.compile("--!?>"), re.compile("<!---?>")
#: A slash that ends an unquoted value, not the element.
_VALUE_SLASH = re.compile(r"""=\s*[^\s"']*/\Z""")
_NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

PATH, WORDS, STATS = 512, 128, 10
WIDTH = PATH + WORDS + STATS


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, ...], ...]  # the two innermost open elements: tag, then words of class, id and role
    link: float  # share of the characters inside links
    marks: int = 0  # bits of all open elements' marks


def _names(rest: str) -> tuple[str, ...]:
    if "=" not in rest:
        return ()
    found = (a or b or c for a, b, c in _NAMES.findall(rest))
    return tuple(p.lower() for v in found for p in _PARTS.findall(v))


class _Ends:
    """Where unusual tags of a page end."""

    def __init__(self, html: str):
        self.html = html
        self.at: dict[str, list[int]] | None = None
        self.failed: set[int] = set()

    def _next(self, kind: str, begin: int) -> int:
        if self.at is None:
            self.at = {c: [m.start() for m in re.finditer(c, self.html)] for c in ("\"", "'", ">")}
        found = self.at[kind]
        k = bisect_left(found, begin)
        return found[k] if k < len(found) else -1

    def after(self, begin: int) -> int:
        """Where the tag that begins here ends: at a bracket outside quotes or else the first one; -1 if it has none."""
        at, tried = begin, []
        while at not in self.failed:
            tried.append(at)
            closing = self._next(">", at)
            quotes = [q for q in (self._next('"', at), self._next("'", at)) if q >= 0]
            opening = min(quotes, default=-1)
            if closing >= 0 and not 0 <= opening < closing:
                return closing + 1
            other = self._next(self.html[opening], opening + 1) if closing >= 0 else -1
            if other < 0:
                break
            at = other + 1
        # from these places on every bracket is inside quotes
        self.failed.update(tried)
        return self._next(">", begin) + 1 or -1


def blocks(html: str | None) -> list[Block]:
    """The page's blocks in order."""
    out: list[Block] = []
    #: tag and words of each open element, and the marks of it and all above
    stack: list[tuple[tuple[str, ...], int]] = []
    #: where the elements of a name stand in the stack, and those that end the reach of implied end tags
    places: dict[str, list[int]] = {}
    scopes: list[int] = []
    endless: set[str] = set()
    pieces: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked, in_link
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, tuple(x[0] for x in stack[-2:]), min(1.0, linked / len(text)), stack[-1][1] if stack else 0))
            pieces.clear()
        linked, in_link = 0, False

    def cut(k: int) -> None:
        for x, _ in stack[k:]:
            places[x[0]].pop()
            if x[0] in SCOPE:
                scopes.pop()
        del stack[k:]

    def close(names: tuple[str, ...]) -> None:
        k = max((places[x][-1] for x in names if places.get(x)), default=-1)
        if k >= 0 and (not scopes or k > scopes[-1]):
            cut(k)

    html, at = html or "", 0
    ends = _Ends(html)
    while True:
        begin = html.find("<", at)
        text = html[at:begin] if begin >= 0 else html[at:]
        if text:
            pieces.append(unescape(text) if "&" in text else text)
            linked += len(text.strip()) if in_link else 0
        if begin < 0:
            break
        m = _TAG.match(html, begin)
        if m:
            at, ending, name, rest = m.end(), m["end"], m["name"].lower(), m["rest"]
        elif html.startswith("<!--", begin):
            # without anything in it a comment may end at once
            m = _COMMENT_END.search(html, begin + 4) if not _EMPTY_COMMENT.match(html, begin) else _EMPTY_COMMENT.match(html, begin)
            at = m.end() if m else len(html)
            continue
        elif html.startswith(("<!", "<?", "</"), begin) and not _LETTER.match(html, begin):
            end = html.find(">", begin)
            at = end + 1 if end >= 0 else len(html)
            continue
        elif _LETTER.match(html, begin) and (end := ends.after(begin)) > 0:
            m = _NAME.match(html, begin, end)
            at, ending, name, rest = end, html[begin + 1] == "/", m[1].lower(), html[m.end() : end - 1]
        else:
            # a bracket that is text, or a tag that the page ends in
            at = begin + 1
            if _LETTER.match(html, begin) and html.find("<", at) < 0:
                break
            pieces.append("<")
            continue
        if ending:
            if name in BLOCK:
                flush()
                if places.get(name):
                    cut(places[name][-1])
            elif name == "a":
                in_link = False
            continue
        if name in RAW or name in SKIPPED:
            # to its own end tag, or in raw text to the end of the page
            empty = name == "svg" and rest.endswith("/") and not _VALUE_SLASH.search(rest)
            if not empty and name not in endless:
                found = re.compile(rf"</{re.escape(name)}\b[^>]*+(?:>|\Z)", re.IGNORECASE).search(html, at)
                if found:
                    at = found.end()
                else:
                    endless.add(name)
                    at = len(html) if name in RAW else at
            pieces.append(" ")
        elif name in BLOCK:
            flush()
            if name != "hr":
                if stack and stack[-1][0][0] == "p":
                    cut(len(stack) - 1)
                if name in IMPLIED:
                    close(IMPLIED[name])
                element = (name, *_names(rest))
                places.setdefault(name, []).append(len(stack))
                if name in SCOPE:
                    scopes.append(len(stack))
                stack.append((element, (stack[-1][1] if stack else 0) | _marks(element)))
        elif name == "br":
            pieces.append(" ")
        elif name == "a":
            in_link = True
    flush()
    return out


_CACHED = 50_000
_BUCKETS: dict[str, int] = {}
_MARKS: dict[tuple[str, ...], int] = {}
_ROWS: dict[tuple[int, str, str], np.ndarray] = {}


def _kept(cache: dict, key, made):
    """``made(key)``, remembered within bounds."""
    if key not in cache:
        if len(cache) >= _CACHED:
            cache.clear()
        cache[key] = made(key)
    return cache[key]


def _bit(mark: str) -> int:
    return 1 << crc32(mark.encode()) % PATH


def _marks(element: tuple[str, ...]) -> int:
    """Bits of an open element: its tag, and the words of its class, id and role."""

    def made(x: tuple[str, ...]) -> int:
        out = _bit(f"has:{x[0]}")
        for w in x[1:]:
            out |= _bit(f"name:{w}")
        return out

    return _kept(_MARKS, element, made)


def _path_row(b: Block) -> np.ndarray:
    def made(key: tuple[int, str, str]) -> np.ndarray:
        bits = key[0] | _bit(f"leaf:{key[1]}") | _bit(f"above:{key[2]}")
        return np.unpackbits(np.frombuffer(bits.to_bytes(PATH // 8, "little"), np.uint8), bitorder="little")

    return _kept(_ROWS, (b.marks, b.path[-1][0] if b.path else "", b.path[-2][0] if len(b.path) > 1 else ""), made)


def _word_bucket(word: str) -> int:
    return crc32(word.encode("utf-8", "replace")) % WORDS


def vectors(blocks_of_page: list[Block], begin: int = 0, end: int | None = None) -> np.ndarray:
    """One row of features for each block, or each from ``begin`` to ``end``."""
    page, total = blocks_of_page[begin:end], len(blocks_of_page)
    n = len(page)
    x = np.zeros((n, WIDTH), np.float32)
    if not n:
        return x
    words = [b.text.lower().split() for b in page]
    sizes = np.array([len(w) for w in words])
    at = np.fromiter((_kept(_BUCKETS, w, _word_bucket) for ws in words for w in ws), np.int64, sizes.sum())
    counted = np.bincount(np.repeat(np.arange(n) * WORDS, sizes) + at, minlength=n * WORDS).reshape(n, WORDS)
    x[:, :PATH] = [_path_row(b) for b in page]
    x[:, PATH : PATH + WORDS] = counted / np.sqrt(sizes)[:, None]
    # code points of all blocks, a line break after each
    chars = np.frombuffer("".join(f"{b.text}\n" for b in page).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.array([len(b.text) for b in page])
    starts = np.cumsum(letters + 1) - letters - 1
    of = lambda *ranges: np.add.reduceat(np.logical_or.reduce([(chars >= ord(lo)) & (chars <= ord(hi)) for lo, hi in ranges]).astype(np.int64), starts)
    x[:, PATH + WORDS :] = np.column_stack(
        (
            np.log1p(sizes) / 3,
            np.log1p(letters) / 5,
            [b.link for b in page],
            of(("0", "9")) / letters,
            of(("A", "Z"), ("À", "Þ")) / letters,
            [b.text[-1] in ".!?…\"”»" for b in page],
            np.minimum(8, of((".", "."), (",", ","))) / 8,
            np.arange(begin, begin + n) / total,
            np.full(n, min(total, 64) / 64),
            of(("©", "©"), ("|", "|"), ("·", "·")) > 0,
        )
    )
    return x
