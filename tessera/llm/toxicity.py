"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two strings sums, over the letter sequences ``a..b..c`` that both contain within a
span of five letters, the products of their weights, ``DECAY ** span`` for each occurrence; it is
normalised. Letters put into an insult or left out of it leave most of its subsequences intact.
Landmarks are strings of the training sentences; the machine is a linear one in the Nyström map
of the kernel. A string's decision value, ``sum of b_l * k(x, l)`` over the landmarks, is linear in
its subsequences, so the landmarks fold into one weight for each, and a string costs a few
lookups. A text is as toxic as its worst string.

Labels are of whole texts. Which strings of a toxic text make it so is learned in rounds: first
the strings that cover most toxic texts and no clean ones, then each toxic text's highest one.
Toxic texts that the machine leaves unexplained are tested among themselves: the fewer they are,
the fewer of them must share a string, or two neighbouring words, that clean texts lack. Such
insults are known by their letters (strings also with a letter put in), beside the machine.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import bound_batches, cut, discard, small_table

DECAY = 0.7
#: Offsets of the second and third letter; the span is the latter plus one.
GAPS = [(a, b) for b in range(2, 5) for a in range(1, b)]
#: Shorter strings are scaled like strings of this length: they say less.
SHORT = 5
#: Subsequences are numbered by hash into so many bits.
BITS = 21
#: Longer strings are cut into overlapping pieces of this length.
PIECE = 40
#: Values of tokens that a worker holds before it starts anew: some 15 MB.
CACHED = 100_000
#: Tokens that are valued at once.
VALUED = 5_000

_letters = re.compile(r"[^\W_]+")
_spelled = re.compile(r"(?<!\S)\S(?:[ \t]+\S){2,}(?!\S)")


def tokens(text: str | None) -> list[str]:
    """Lower-cased tokens of a text, and what its spelled-out words ("s o") say."""
    text = (text or "").lower()
    return text.split() + [re.sub(r"\s", "", m) for m in _spelled.findall(text)]


def neighbours(text: str | None) -> set[tuple[str, str]]:
    """Pairs of words that follow each other."""
    words = _letters.findall((text or "").lower())
    return set(zip(words, words[1:]))  # noqa: B905


def strings(token: str) -> list[str]:
    """What a token may say: its letters, with and without what stands between them."""
    runs = _letters.findall(token)
    if not runs:
        return []
    out = [*runs, "".join(runs)] if len(runs) > 1 else runs
    return [s[k : k + PIECE] for s in out for k in range(0, max(1, len(s) - PIECE // 2), PIECE // 2)]


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word, subsequence, weight) of all occurrences, one group of arrays for each spacing.

    A mark stands before each word, so that its beginning counts. The squares of a word's weights
    sum up to 1, or less for words of under SHORT letters.
    """
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    code = np.frombuffer("".join(f"^{w}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))
    squares = sum(np.maximum(np.maximum(size, SHORT + 1) - b, 0) * DECAY ** (2 * (b + 1)) for _, b in GAPS)
    scale = 1 / np.sqrt(squares)
    for b in sorted({b for _, b in GAPS}):
        at = np.flatnonzero(left > b)
        word, ends = owner[at], code[at] * np.uint64(0x9E3779B97F4A7C15) + code[at + b] * np.uint64(0x165667B19E3779F9)
        weight = DECAY ** (b + 1) * scale[word]
        for a in (a for a, c in GAPS if c == b):
            x = ends + code[at + a] * np.uint64(0xC2B2AE3D27D4EB4F)
            yield word, ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64), weight


class Landmarks:
    """The landmarks' subsequences, and the kernel of other strings with the landmarks."""

    def __init__(self, marks: list[str]):
        parts = list(subsequences(marks))
        self.features = np.unique(np.concatenate([f for _, f, _ in parts]))
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[self.features] = np.arange(len(self.features))
        self.folded = self.vectors(marks).T

    def sparse(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, place of the subsequence, weight) of what the words share with any landmark."""
        out = []
        for word, feature, weight in subsequences(words):
            at = self.place[feature]
            hit = at >= 0
            out.append((word[hit], at[hit], weight[hit]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def vectors(self, words: list[str]) -> np.ndarray:
        word, at, weight = self.sparse(words)
        return np.bincount(word * len(self.features) + at, weight, len(words) * len(self.features)).reshape(len(words), -1)

    def kernel(self, words: list[str]) -> np.ndarray:
        return np.concatenate([self.vectors(words[k : k + 500]) @ self.folded for k in range(0, len(words), 500)])


def gapped(word: str) -> list[str]:
    """The word with a letter put in: one of its own doubled, or a strange one."""
    return [word[:k] + c + word[k:] for k in range(1, len(word)) for c in (word[k], "x")] if len(word) > 3 else []


class ToxicityModel:
    """Weights of subsequences, the machine's offset and the scale of its scores."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, offset: float, low: float, high: float):
        self.features, self.weights, self.offset, self.low, self.high = features, weights, offset, low, high
        #: Strings and pairs of neighbouring words that are insults whatever the machine says.
        self.known_strings: frozenset[str] = frozenset()
        self.known_pairs: frozenset[tuple[str, str]] = frozenset()
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def values(self, words: list[str]) -> np.ndarray:
        """Decision values of strings."""
        if self._table is None:
            self._table = np.zeros(1 << BITS)
            self._table[self.features] = self.weights
        out = np.full(len(words), self.offset)
        for word, feature, weight in subsequences(words):
            out += np.bincount(word, weight * self._table[feature], len(words))
        return out

    @property
    def sure(self) -> float:
        """The value of what is known to be an insult."""
        return max(self.low, self.high)

    def token_values(self, toks: list[str]) -> list[float]:
        parts = [strings(t) for t in toks]
        flat = [s for p in parts for s in p]
        value = [max(v, self.sure) if s in self.known_strings else v for s, v in zip(flat, self.values(flat).tolist(), strict=True)] if flat else []
        out, at = [], 0
        for p in parts:
            out.append(max(value[at : at + len(p)], default=self.offset))
            at += len(p)
        return out

    def score(self, value: np.ndarray) -> np.ndarray:
        """0 to 1; 0.7 at three tenths of the way from the highest clean text to where toxic ones begin."""
        middle, width = self.low + 0.3 * (self.high - self.low), max(self.high - self.low, 1e-3)
        return 1 / (1 + np.exp(-np.clip(np.log(7 / 3) + 8 * (value - middle) / width, -60, 60)))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 50.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps over the current violators."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w, before = np.zeros(x.shape[1]), None
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        if before is not None and (inside == before).all():
            break
        before = inside
        part = x[inside] * (cost * weight[inside])[:, None]
        w = np.linalg.solve(ridge + part.T @ x[inside], part.T @ y[inside])
    return w[:-1], float(w[-1])


class _Sample:
    """Labelled texts as arrays of numbers of their strings, all strings being held once."""

    def __init__(self, samples: Iterable[tuple[str | None, int]]):
        number: dict[str, int] = {}
        self.toxic, self.clean, self.texts = [], [], ([], [])
        for text, label in samples:
            own = {number.setdefault(s, len(number)) for t in set(tokens(text)) for s in strings(t)}
            if own:
                (self.toxic if label else self.clean).append(np.fromiter(own, np.int32, len(own)))
                self.texts[bool(label)].append(text)
        self.strings = list(number)
        self.common = sum((np.bincount(x, minlength=len(number)) for x in _joined(self.clean)), np.zeros(len(number), np.int64))


def _joined(arrays: list[np.ndarray], many: int = 500) -> Iterator[np.ndarray]:
    for k in range(0, len(arrays), many):
        yield np.concatenate(arrays[k : k + many])


def _by_chance(held: int | np.ndarray, open_texts: int, clean: int, tried: int) -> bool | np.ndarray:
    """Whether one of ``tried`` strings may well be in so many of the open toxic texts and in no clean one without being an insult."""
    return held * np.log(1 + clean / open_texts) < np.log(tried)


def _shared_string(left: list[np.ndarray], sample: _Sample, known: np.ndarray) -> int | None:
    """The string that most unexplained toxic texts share, by more than chance, and that no clean text has; of equals the likest to an insult.

    One at a time: copies of a text share all their strings, and only one need be the insult.
    """
    held = sum((np.bincount(x, minlength=len(sample.strings)) for x in _joined(left)), np.zeros(len(sample.strings), np.int64))
    new = np.flatnonzero((held > 1) & (sample.common == 0) & ~_by_chance(held, len(left), len(sample.clean), len(sample.strings)))
    return max((int(s) for s in new if len(sample.strings[s]) > 2), key=lambda s: (held[s], known[s], sample.strings[s]), default=None)


def _shared_pairs(left: list[str], sample: _Sample) -> frozenset[tuple[str, str]]:
    """Likewise the pairs of neighbouring words, each of which explains a text that no other one does."""
    held = Counter(pair for text in left for pair in neighbours(text))
    found = {pair for pair, n in held.items() if n > 1 and not _by_chance(n, len(left), len(sample.clean), len(held) + len(sample.strings))}
    for text in sample.texts[0] if found else ():
        found -= neighbours(text)
    rest, out = [neighbours(text) & found for text in left] if found else [], set()
    for pair in sorted(found, key=lambda x: (-held[x], x)):
        if any(pair in own for own in rest):
            out.add(pair)
            rest = [own for own in rest if pair not in own]
    return frozenset(out)


def fit(samples: Iterable[tuple[str | None, int]], landmarks: int = 160, rounds: int = 4, negatives: int = 4000, hard: int = 1500) -> ToxicityModel | None:
    """A model of texts labelled 1 (toxic) or 0; None unless both occur.

    ``landmarks`` bounds the map only, not the insults learned. Of the strings of clean texts,
    ``negatives`` (those of the least hashes) train the machine, and after each of the ``rounds`` the
    ``hard`` ones that it values highest as well; its offset is set on all of them. An insult that a single text holds,
    and that resembles no other, cannot be told from the text's other rare words and is not learned.
    """
    sample = _Sample(samples)
    toxic, clean, every, common = sample.toxic, sample.clean, sample.strings, sample.common
    if not toxic or not clean:
        return None
    # Strings that cover the toxic texts, most first, and that clean texts as good as lack.
    holders: dict[int, list[int]] = defaultdict(list)
    ratio = len(clean) / len(toxic)
    held = sum((np.bincount(x, minlength=len(every)) for x in _joined(toxic)), np.zeros(len(every), np.int64))
    useful = [int(s) for s in np.flatnonzero(20 * common < held * ratio) if len(every[s]) > 2]
    # Those that so many toxic texts would not share by chance, if there are such.
    useful = [s for s in useful if not _by_chance(held[s], len(toxic), len(clean), len(every))] or useful
    wanted = np.zeros(len(every), bool)
    wanted[useful] = True
    for k, words in enumerate(toxic):
        for s in words[wanted[words]].tolist():
            holders[s].append(k)
    useful.sort(key=lambda s: (-held[s], every[s]))
    covered, positive = Counter(), []
    for s in useful:
        if any(covered[k] < 3 for k in holders[s]):
            positive.append(s)
            covered.update(holders[s])
    if not positive:
        pairs = _shared_pairs(sample.texts[1], sample)
        if not pairs:
            return None
        machine = ToxicityModel(np.empty(0, np.int64), np.empty(0), 0.0, 0.0, 1.0)
        machine.known_pairs = pairs
        return machine
    everyday = sorted(np.flatnonzero(common).tolist(), key=lambda s: zlib.crc32(every[s].encode("utf-8", "surrogatepass")))
    spanning = positive[: landmarks // 2]
    marks = [every[s] for s in [*spanning, *everyday[: landmarks - len(spanning)]]]
    land = Landmarks(marks)
    value, vector = np.linalg.eigh(land.kernel(marks))
    keep = value > 1e-6
    root = vector[:, keep] / np.sqrt(value[keep])  # k(x, marks) @ root: the Nyström map

    negative, chosen = dict.fromkeys(everyday[:negatives]), dict.fromkeys(positive)
    clean_words = {every[s] for s in everyday}
    extra, pairs, rest = set(), set(), list(range(len(toxic)))

    def explain(level: float) -> list[int]:
        """What toxic texts share of which the machine's value is no more than a level: strings, else pairs, while any are found. Gives the texts that hold none."""
        left = [k for k in rest if known[toxic[k]].max() <= level]
        while left:
            s = _shared_string([toxic[k] for k in left], sample, known)
            more = set() if s is not None else _shared_pairs([sample.texts[1][k] for k in left], sample)
            if s is None and not more:
                break
            extra.update(() if s is None else (s,))
            pairs.update(more)
            left = [k for k in left if (s is None or not (toxic[k] == s).any()) and (not more or more.isdisjoint(neighbours(sample.texts[1][k])))]
        return [k for k in rest if extra.isdisjoint(toxic[k].tolist()) and (not pairs or pairs.isdisjoint(neighbours(sample.texts[1][k])))]

    for step in range(rounds):
        words = [every[s] for s in chosen]
        plus = list(dict.fromkeys([*words, *(v for s in words for v in gapped(s) if v not in clean_words)]))
        train = [*plus, *(every[s] for s in negative)]
        y = np.array([1.0] * len(plus) + [-1.0] * len(negative))
        balance = np.where(y > 0, 1 / len(plus), 1 / len(negative))
        w, offset = _machine(land.kernel(train) @ root, y, balance / balance.mean())
        machine = ToxicityModel(land.features, land.folded @ (root @ w), offset, 0.0, 1.0)
        known = np.concatenate([machine.values(every[k : k + 5000]) for k in range(0, len(every), 5000)])
        negative |= dict.fromkeys(sorted(everyday, key=lambda s: (-known[s], every[s]))[:hard])
        if step == 0:
            rest = explain(max(float(known[words].max()) for words in clean))
        best = [max(toxic[k].tolist(), key=lambda s: (known[s], every[s])) for k in rest]
        chosen = dict.fromkeys([*positive, *(s for s in best if known[s] > 0 and not common[s])])
    for _ in range(2):  # of those, too, that the scores would still call clean
        machine.low, machine.high = _bounds(known, clean, [toxic[k] for k in rest] or toxic)
        rest = explain(machine.low + 0.3 * (machine.high - machine.low))
    machine.known_strings = frozenset({every[s] for s in extra} | {v for s in extra for v in gapped(every[s]) if v not in clean_words})
    machine.known_pairs = frozenset(pairs)
    return machine


def _bounds(known: np.ndarray, clean: list[np.ndarray], toxic: list[np.ndarray]) -> tuple[float, float]:
    """The value of the highest clean text, and where toxic ones begin."""
    ends, tops = (sorted(float(known[words].max()) for words in texts) for texts in (clean, toxic))
    low, high = ends[-1], tops[len(tops) // 20]
    if high <= low:  # they overlap: between the bulk of either
        low, high = ends[int(len(ends) * 0.98)], float(np.median(tops))
    return low, high


def training_rows(docs: DataFrame, labels: DataFrame, most: int = 4000, most_bytes: int = 256 << 20) -> list[tuple[str | None, int]]:
    """At most ``most`` toxic and ``most`` clean labelled texts, those of the least hashes of their ids.

    Rows whose ``crc32(id) mod 3`` is 1 are held out. Ids are chosen first, from ids alone; only the
    chosen rows' texts are read out, without a shuffle of texts. Of each label no more texts are
    taken, in the order of the hashes, than ``most_bytes`` / 2 hold (one at least): this bounds the
    driver. Null ids have no label; of rows that repeat a chosen id the least text is taken.
    """
    spark = docs.sparkSession
    known = labels.where("toxic in (0, 1) and crc32(cast(doc_id as string)) % 3 <> 1").select("doc_id", "toxic", F.xxhash64("doc_id").alias("h")).distinct()
    there = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    rows = []
    for y in (1, 0):
        ids = [(r["doc_id"], r["h"]) for r in there.where(f"toxic = {y}").orderBy("h", "doc_id").limit(most).collect()]  # ``most`` numbers
        chosen = F.broadcast(small_table(spark, ids, "doc_id bigint, h bigint"))
        texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
        part = cut(texts.groupBy("h", "doc_id").agg(F.min("text").alias("text")), "training")
        sizes = part.select("h", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0))).collect()  # ``most`` numbers
        fits = sum(total <= most_bytes // 2 for total in accumulate(r[2] for r in sorted(map(tuple, sizes))))
        taken = part if fits == len(sizes) else part.orderBy("h", "doc_id").limit(max(1, fits))
        rows += [(r["text"], y) for r in taken.select("text").toLocalIterator()]
        discard(part)
    return rows


_worker: tuple[str, dict[str, float]] = ("", {})


def _held(name: str) -> dict[str, float]:
    """This worker's values of tokens by the model of this name: they outlive a task, but not the next model."""
    global _worker
    if _worker[0] != name:
        _worker = name, {}
    return _worker[1]


def _scorer(model: ToxicityModel, name: str, keep_text: bool = False):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _held(name)
        for batch in batches:
            top = []
            for at in range(0, len(batch), 500):
                split = [tokens(t) for t in batch["text"].iloc[at : at + 500]]
                if len(held) > CACHED:
                    held.clear()
                new = list(set().union(*split).difference(held))
                for k in range(0, len(new), VALUED):
                    held.update(zip(new[k : k + VALUED], model.token_values(new[k : k + VALUED]), strict=True))
                part = [max(map(held.__getitem__, words), default=-np.inf) for words in split]
                if model.known_pairs:
                    part = [max(v, model.sure) if v < model.sure and not model.known_pairs.isdisjoint(neighbours(t)) else v for v, t in zip(part, batch["text"].iloc[at : at + 500], strict=True)]
                top += part
            value = np.array(top, float)
            yield (batch if keep_text else batch.drop(columns="text")).assign(score=np.where(np.isfinite(value), model.score(np.where(np.isfinite(value), value, 0)), 0.0))

    return score


def toxicity_scores(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, score, predicted)``, one row per row of ``docs``; predicted is 1 from a score of 0.7.

    Null and empty texts and texts without letters score 0, as all do without a model (no toxic or
    no clean row to learn from). Whole texts are read. Null and repeated ids are carried. Columns in ``keep``,
    which may be the text's own (as ``text``), pass through; no other is read. No shuffle.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias("text"), *(F.col(c) for c in keep if c not in (id_col, text_col, "text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text" or text_col in keep)
    if model is None:
        out = (rows if text_col in keep else rows.drop("text")).withColumn("score", F.lit(0.0))
    else:
        out = rows.mapInPandas(_scorer(model, uuid.uuid4().hex, text_col in keep), f"{schema}, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))
