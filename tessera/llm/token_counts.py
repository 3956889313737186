"""Token counts of a sentence-piece BPE vocabulary by rank-synchronous array merging.

Pre-tokens, the stretches that no piece of the vocabulary reaches across, are held together as
one ragged array of symbols. In each round every pre-token applies its own best pair (lowest
rank, leftmost), all of them at once in a few array operations; those without a pair are done
and leave. What survives is counted. Counts of pre-tokens seen before are looked up. A very long
pre-token would need a round over its whole array for each of its merges: its library divides it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import bound_batches

#: The sign that stands for a space.
SPACE = "▁"
#: Counts of pre-tokens that a worker holds before it starts anew: some 40 MB.
CACHED = 300_000
#: Pre-tokens of more characters are divided by the library.
MERGED = 1_000
#: Longer pre-tokens are counted but not held.
LONGEST = 48
_NONE = np.iinfo(np.int32).max
_counters: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts the pieces into which a BPE model file divides texts, as its library would."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, size = self.library, self.library.get_piece_size()
        usable = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        pieces = {lib.id_to_piece(i): lib.get_score(i) for i in usable}
        self.bytes = any(lib.is_byte(i) for i in range(size))
        # Where this fails, a pre-token can't end at a space or the text is changed before it is divided.
        probe = f"{SPACE}a{SPACE}{SPACE}B"
        self.splits = self.bytes and "".join(lib.encode("a  B", out_type=str)) == probe and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        symbols = {c: k for k, c in enumerate(dict.fromkeys([*pieces, *(c for p in pieces for c in p)]))}
        self.symbol_of = {c: k for c, k in symbols.items() if len(c) == 1}
        self.width = len(symbols) + 1
        self.known = np.zeros(self.width, bool)
        self.known[[symbols[p] for p in pieces]] = True
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        rules = [(symbols[p[:k]] * self.width + symbols[p[k:]], order[s], symbols[p]) for p, s in pieces.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        rules.sort()
        self.pair = np.array([r[0] for r in rules], np.int64)
        self.rank = np.array([r[1] for r in rules], np.int32)
        self.made = np.array([r[2] for r in rules], np.int64)
        self.held: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> PieceCounter:
        """This worker's counter: it outlives a task, so what it holds is used again."""
        if path not in _counters:
            _counters[path] = cls(path)
        return _counters[path]

    def _rule(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], _NONE), at

    def merge(self, pretokens: list[str]) -> np.ndarray:
        """How many pieces each pre-token (not empty) ends as."""
        size = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        text = "".join(pretokens)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, back = np.unique(code, return_inverse=True)
        chars = [chr(c) for c in distinct]
        unknown = self.width - 1
        symbol = np.array([self.symbol_of.get(c, unknown) for c in chars], np.int64)[back]
        # A symbol that is no piece when all is merged falls back to its bytes.
        spread = np.array([len(c.encode("utf-8", "surrogatepass")) for c in chars], np.int64)[back]
        counts = np.zeros(len(pretokens), np.int64)
        owner = np.repeat(np.arange(len(pretokens)), size)
        rank, rule = self._ranks(symbol, owner)
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lengths = np.diff(np.concatenate([starts, [len(owner)]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            done = best == _NONE
            if done.any():
                final = np.where(self.known[symbol[done]], 1, spread[done])
                np.add.at(counts, owner[done], final)
                keep = ~done
                symbol, owner, spread, rank, rule, best = (x[keep] for x in (symbol, owner, spread, rank, rule, best))
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == best)
            at = at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])]  # the leftmost of each
            symbol[at] = self.made[rule[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            spread[at] += spread[at + 1]
            at = at - np.arange(len(at))  # places after the removal
            symbol, owner, spread, rank, rule = (x[keep] for x in (symbol, owner, spread, rank, rule))
            for place in (at, at - 1):
                place = place[place >= 0]
                self._refresh(symbol, owner, rank, rule, place)
        return counts

    def _ranks(self, symbol: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, rule = np.full(len(symbol), _NONE, np.int32), np.zeros(len(symbol), np.int64)
        self._refresh(symbol, owner, rank, rule, np.arange(len(symbol)))
        return rank, rule

    def _refresh(self, symbol, owner, rank, rule, place) -> None:
        inside = place[place < len(symbol) - 1]
        rank[place] = _NONE
        inside = inside[owner[inside] == owner[inside + 1]]
        rank[inside], rule[inside] = self._rule(symbol[inside], symbol[inside + 1])

    def pretokens(self, text: str) -> list[str]:
        """The text's stretches, each with the spaces before it as signs."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
            return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + text.replace(" ", SPACE))
        return text.split(" ")  # a sign before each is understood

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [len(x) for x in self.library.encode(texts, num_threads=1)]
        if len(self.held) > CACHED:
            self.held.clear()
        held, once = self.held, {}
        split = [self.pretokens(t) for t in texts]
        new = list(set().union(*split).difference(held))
        long = [w for w in new if len(w) > MERGED]
        if long:
            new = [w for w in new if len(w) <= MERGED]
            # the library puts the first sign before a text itself
            once.update(zip(long, map(len, self.library.encode([w.removeprefix(SPACE) for w in long], num_threads=1)), strict=True))
        if new:
            for word, n in zip(new, self.merge([w if w[0] == SPACE else SPACE + w for w in new]).tolist(), strict=True):
                (held if len(word) <= LONGEST else once)[word] = n
        if once:
            return [sum(held[w] if w in held else once[w] for w in words) for words in split]
        return [sum(map(held.__getitem__, words)) for words in split]


def _counter(path: str):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = PieceCounter.of(path)
        for batch in batches:
            texts = [t or "" for t in batch["text"].array]
            n = [c for at in range(0, len(texts), 1000) for c in counter.count(texts[at : at + 1000])]
            yield pd.DataFrame({"id": batch["id"], "n_bytes": batch["n_bytes"], "n_tokens": n})

    return count


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``, by the model file ``model``.

    No begin, end or other added tokens; strings like those of control tokens are ordinary text.
    Models that change texts first or hold pieces across spaces are counted by their library.
    Null and empty texts have 0 bytes and tokens; null and repeated ids are carried as they are.
    Texts are read whole; the longest allowed is what a string column holds. No shuffle.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    out = rows.mapInPandas(_counter(model), "id bigint, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
