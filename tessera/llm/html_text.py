"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative: by how often words
in such an element and such tags lie inside the main region of labelled pages, which are pages
whose markup names that region. One linear scan finds the contiguous stretch of the largest
score; what is no text of the article inside it (forms, asides, adverts, comments) is left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin and end blocks of text; all others stand within a line.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never text of an article, wherever they stand.
NEVER = frozenset("aside button dialog fieldset footer form head iframe input label menu nav noscript object option script select style svg template textarea title".split())
#: Words of classes and ids of what is not the article.
ASIDE = frozenset(
    "ad ads adsense advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer menu menubar nav navbar navigation newsletter notice notices popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Elements that hold the article whatever their classes say.
WHOLE = frozenset("html body main article".split())
#: Scores: a word in an element of no labelled page, and a tag that never lies inside the main region.
UNKNOWN_WORD, OUTSIDE_TAG = 0.5, -40.0

# A tag that is not closed ends where the next one begins: no start is tried over the rest of the page.
_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style|textarea|title|noscript|template|svg|iframe)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|(?=<)|\Z)", re.S | re.I)
_attributes = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_undisplayed = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
#: The mark of what is not shown, in place of a class.
HIDDEN = "[hidden]"


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): text with its value, or a start or end tag with its signature (name and class words)."""
    at = 0
    for m in _token.finditer(page):
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        if m[3]:
            name = m[3].lower()
            if m[2]:
                yield "end", name, ""
            else:
                yield "void" if name in VOID or m[4].endswith("/") else "start", name, _words(m[4]) if m[4] else ""
    if at < len(page):
        yield "text", "", page[at:]


def _words(attributes: str) -> str:
    """The class and role names and the id of a tag, and HIDDEN if its attributes hide it."""
    out, hidden = [], False
    for name, value in _attributes.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            out.append(value.lower())
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _undisplayed.search(value):
            hidden = True
    return " ".join([*out, HIDDEN] if hidden else out)


def _aside(name: str, words: str) -> bool:
    if name in NEVER:
        return True
    own = words.split()
    return HIDDEN in own or name not in WHOLE and not ASIDE.isdisjoint(own)


_PARTS = BLOCKS - {"address", "div", "p"}
#: Starting elements, which open ones they close where the end may be left out, and which ones these are not sought beyond.
CLOSES = {
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "li": ({"li"}, _PARTS - {"li"}),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, _PARTS - {"dt", "dd"})),
    **dict.fromkeys(("td", "th"), ({"td", "th", "caption"}, {"table", "tr"})),
    "tr": ({"tr", "caption"}, {"table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"})),
    **dict.fromkeys("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split(), ({"p"}, {*BLOCKS, "button", "object"} - {"p"})),
}


class Walk:
    """Keeps the open elements while tokens pass; an end tag closes what was left open inside."""

    def __init__(self):
        self.open: list[tuple[str, str, bool, str]] = []  # name, signature, within something that is aside, signature of the innermost block
        self.skipped = False  # whether the last tag was of an element within something that is aside
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of a name

    def _innermost(self, names: Iterable[str]) -> int:
        return max((at[-1] for n in names if (at := self.places.get(n))), default=-1)

    def _close(self, k: int) -> None:
        for name, *_ in self.open[k:]:
            self.places[name].pop()
        del self.open[k:]

    def step(self, kind: str, name: str, words: str) -> str:
        """The signature of a tag."""
        if kind == "end":
            k = self._innermost((name,))
            if k < 0:
                self.skipped = self.aside()
                return f"/{name}"
            _, signature, self.skipped, _ = self.open[k]
            self._close(k)
            return f"/{signature}"
        signature = f"{name}.{words}" if words else name
        if name in CLOSES:
            closed, bounds = CLOSES[name]
            least = min((at[-1] for n in closed if (at := self.places.get(n)) and at[-1] > self._innermost(bounds)), default=-1)
            if least >= 0:
                self._close(least)
        self.skipped = self.aside() or _aside(name, words)
        if kind == "start":
            place = signature if name in BLOCKS else self.place()
            self.places[name].append(len(self.open))
            self.open.append((name, signature, self.skipped, place))
        return signature

    def place(self) -> str:
        """The signature of the innermost block that is open."""
        return self.open[-1][3] if self.open else ""

    def aside(self) -> bool:
        return bool(self.open) and self.open[-1][2]


def _main(name: str, words: str) -> bool:
    return name in ("article", "main") or words in ("main", "article")


def learn(pages: Iterable[str]) -> dict[str, float]:
    """Scores of words by the block they stand in (``w`` and a signature) and of tags (``t`` and one), from the pages that name one main region."""
    inside, outside = Counter(), Counter()
    for page in pages:
        walk, depth, region, seen, got = Walk(), None, None, 0, []
        for kind, name, value in tokens(page):
            if kind == "text":
                n = len(value.split())
                if n:
                    got.append((f"w{walk.place()}", n, depth is not None))
                continue
            begins = kind == "start" and depth is None and _main(name, value)
            was = depth is not None
            signature = walk.step(kind, name, value)
            if begins:
                depth, seen, region = len(walk.open), seen + 1, walk.open[-1]
            elif depth is not None and (len(walk.open) < depth or walk.open[depth - 1] is not region):
                depth, was = None, False
            got.append((f"t{signature}", 1, was and not begins))
        if seen == 1:
            for key, n, within in got:
                (inside if within else outside)[key] += n
    out = {}
    for key in inside.keys() | outside.keys():
        share = inside[key] / (inside[key] + outside[key])
        out[key] = share if key[0] == "w" else OUTSIDE_TAG * (1 - share) - 0.01
    return out


def extract(page: str | None, scores: dict[str, float]) -> str:
    """The blocks of the best stretch, one to a line."""
    if not page:
        return ""
    walk, parts, total, begin, best = Walk(), [], 0.0, 0, (0.0, 0, 0)
    for kind, name, value in tokens(page):
        if kind == "text":
            n = len(value.split())
            gain = n * scores.get(f"w{walk.place()}", UNKNOWN_WORD) if n and not walk.aside() else 0.0
            parts.append((value, walk.aside(), False))
        else:
            signature = walk.step(kind, name, value)
            gain = 0.0 if walk.skipped else scores.get(f"t{signature}")  # what is left out says nothing, as its text
            if gain is None:  # of no labelled page: by what it is
                gain = scores.get(f"t{name}", -0.5)
            parts.append(("br" if name == "br" else "", True, name in BLOCKS))
        if total <= 0:
            total, begin = 0.0, len(parts) - 1
        total += gain
        if total > best[0]:
            best = (total, begin, len(parts))
    blocks, line = [], []
    for value, skip, breaks in [*parts[best[1] : best[2]], ("", True, True)]:
        if breaks:
            text = " ".join(html.unescape("".join(line)).split())
            if text:
                blocks.append(text)
            line = []
        elif value == "br" and skip:
            line.append(" ")
        elif not skip:
            line.append(value)
    return "\n".join(blocks)


def learn_scores(pages: DataFrame, html_col: str = "html", most: int = 1000) -> dict[str, float]:
    """:func:`learn` from at most ``most`` pages that name a main region: those of the least hashes."""
    named = pages.select(F.col(html_col).cast("string").alias("html")).where(F.col("html").rlike(r"(?i)<(article|main)\b"))
    rows = named.select("html", F.xxhash64("html").alias("h")).orderBy("h", "html").limit(most).select("html").collect()
    return learn(r["html"] for r in rows)


def main_text(pages: DataFrame, scores: dict[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)``, one row per row of ``pages``.

    Character references are decoded, white space within a block is one space, blocks are joined
    by line ends; ``br`` is white space. Null and empty pages and pages without words give an empty text. Null and
    repeated ids and urls are carried, pages are read whole, no other column is read. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [extract(h, scores) for h in batch["html"].array]
            yield batch.drop(columns="html").assign(text=text, n_chars=list(map(len, text)))

    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInPandas(run, "id bigint, url string, text string, n_chars bigint").withColumnRenamed("id", id_col)
