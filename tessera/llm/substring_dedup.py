"""Substring de-duplication by seed and extend over winnowed anchors.

A window is ``window`` consecutive words. Winnowing gives each window one anchor, the least hash
among its runs of ``gram`` words, so equal windows have equal anchors at equal places, and about
two of ``window - gram + 2`` positions are anchors. The windows that share an anchor occurrence
follow each other; the stretch of words they cover is that anchor's extension in its document.

1. Seed: documents meet on anchors. 2. Extend: where whole extensions agree, the repeat is as
long as the extension and runs on into the next anchor's; where they differ (the ends of a
repeat, chance meetings), the single windows under the anchor are compared. 3. The maximal
repeats are the unions of the windows found. Only the smallest document of each repeat keeps it,
which needs first documents, never pairs: every step is linear in the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import bound_batches, cut, discard
from tessera.llm.words import STEP, WordHash, grams, mix

_BASE = int(STEP)
_INVERSE = pow(_BASE, -1, 1 << 64)


class Extensions:
    """Finds the anchors of texts, their extensions and the hashes of stretches of words."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram, self.seen = window, gram, WordHash()
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            size = max(size, 4096)
            for name, base in (("powers", _BASE), ("inverses", _INVERSE)):
                factors = np.full(size, np.uint64(base))
                factors[0] = 1
                setattr(self, name, np.cumprod(factors))

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, last window, anchor hash, extension hash) of each anchor, in order."""
        n = len(words) - self.window + 1
        if n <= 0:
            none = np.empty(0, np.int64)
            return none, none, none.view(np.uint64), none.view(np.uint64)
        hashes = self.seen.of(words)
        self._grow(len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.powers[: len(words)])])
        gram = grams(hashes, self.gram)
        least, where = gram[:n].copy(), np.zeros(n, np.int64)
        for k in range(1, self.window - self.gram + 1):
            other = gram[k : k + n]
            less = other < least
            least[less] = other[less]
            where[less] = k
        at = where + np.arange(n)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        anchor = least[first]
        return first, last, anchor, self.stretch(first, last + self.window)

    def stretch(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the words from ``begin`` to before ``end`` of the text read last."""
        value = (self.sums[end] - self.sums[begin]) * self.inverses[begin]
        return mix(value ^ mix((end - begin).astype(np.uint64)))


def _seeds(window: int, gram: int):
    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ext = Extensions(window, gram)
        for batch in batches:
            out, held = [], 0
            for i, text in zip(batch["id"].array, batch["text"].array, strict=True):
                _, _, anchor, whole = ext.read(bytes(text).split())
                whole, at = np.unique(whole, return_index=True)  # the extension holds its anchor
                out.append((i, anchor[at], whole))
                held += len(whole)
                if held > 200_000:
                    yield _rows(out)
                    out, held = [], 0
            if out:
                yield _rows(out)

    return seeds


def _rows(out: list) -> pd.DataFrame:
    """Rows (anchor, whole, id, late), once for each; late: these rows hold it with a smaller id too, which settles it here."""
    ids, anchor, whole = zip(*out, strict=True)
    anchor, whole, ids = np.concatenate(anchor).view(np.int64), np.concatenate(whole).view(np.int64), np.repeat(ids, list(map(len, whole)))
    order = np.lexsort((ids, anchor, whole))
    anchor, whole, ids = anchor[order], whole[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (whole[1:] != whole[:-1]) | (anchor[1:] != anchor[:-1])
    first = ids[np.flatnonzero(new)[np.cumsum(new) - 1]]
    once = new.copy()
    once[1:] |= ids[1:] != ids[:-1]
    return pd.DataFrame({"anchor": anchor, "whole": whole, "id": ids, "late": ids > first})[once]


SEEDS = "anchor bigint, whole bigint, id bigint, late boolean"


def _together(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key in one task, but those that are settled, so that of a very common one a task gets a row from each batch at most."""
    spread = F.when(F.col("late"), F.xxhash64("id", "whole")).otherwise(F.xxhash64(*keys))
    return rows.withColumn("to", spread).repartition("to").drop("to").sortWithinPartitions("anchor", "whole", "id")


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (anchor, whole, id) to rows (id, whole, later).

    later: a smaller document has this extension. Otherwise the row is the first document of an
    extension whose anchor has others too, to be compared window by window.
    """
    old = None  # (anchor, whole, id of its first row) seen last
    open_row = None  # (whole, id, has an earlier extension) of the last extension, not yet settled
    for batch in batches:
        late = batch["late"].to_numpy(bool)
        if late.any():
            yield batch.loc[late, ["id", "whole"]].assign(later=True)
            batch = batch[~late]
        if not len(batch):
            continue
        anchor, whole, ids = (batch[c].to_numpy() for c in ("anchor", "whole", "id"))
        new_anchor = np.concatenate([[old is None or anchor[0] != old[0]], anchor[1:] != anchor[:-1]])
        new_whole = new_anchor | np.concatenate([[old is None or whole[0] != old[1]], whole[1:] != whole[:-1]])
        starts = np.flatnonzero(new_whole)
        order = np.cumsum(new_whole) - 1
        first_id = np.where(order >= 0, ids[starts[np.maximum(order, 0)]] if len(starts) else 0, old[2] if old else 0)
        later = ~new_whole & (ids > first_id)
        out = [pd.DataFrame({"id": ids[later], "whole": whole[later], "later": True})]
        if len(starts):
            if open_row and (open_row[2] or not new_anchor[starts[0]]):
                out.append(pd.DataFrame({"id": [open_row[1]], "whole": [open_row[0]], "later": False}))
            earlier = ~new_anchor[starts]
            settled = starts[:-1][earlier[:-1] | earlier[1:]]
            out.append(pd.DataFrame({"id": ids[settled], "whole": whole[settled], "later": False}))
            open_row = (whole[starts[-1]], ids[starts[-1]], bool(earlier[-1]))
        old = (anchor[-1], whole[-1], first_id[-1])
        yield pd.concat(out)
    if open_row and open_row[2]:
        yield pd.DataFrame({"id": [open_row[1]], "whole": [open_row[0]], "later": False})


def _windows(window: int, gram: int):
    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ext = Extensions(window, gram)
        for batch in batches:
            out, held = [], 0
            for i, text, check in zip(batch["id"].array, batch["text"].array, batch["check"].array, strict=True):
                first, last, anchor, whole = ext.read(bytes(text).split())
                chosen = np.flatnonzero(_among(whole, check))
                size = last[chosen] - first[chosen] + 1
                start = np.repeat(first[chosen] - np.cumsum(size) + size, size) + np.arange(size.sum())
                out.append((i, np.repeat(anchor[chosen], size), ext.stretch(start, start + window)))
                held += len(start)
                if held > 200_000:
                    yield _rows(out)
                    out, held = [], 0
            if out:
                yield _rows(out)

    return windows


def _among(hashes: np.ndarray, wanted) -> np.ndarray:
    """Which of the hashes are in a list of them."""
    known = np.sort(np.asarray(wanted, np.int64))
    at = np.searchsorted(known, hashes.view(np.int64))
    return known[np.minimum(at, len(known) - 1)] == hashes.view(np.int64) if len(known) else np.zeros(len(hashes), bool)


def _later(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for out in _meet(batches):
        yield out.loc[out["later"], ["id", "whole"]]


def _cleaner(window: int, gram: int, keep_spacing: bool):
    import re

    spaced = re.compile(rb"[ \t-\r]*[^ \t-\r]+")

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ext = Extensions(window, gram)
        for batch in batches:
            texts, total, removed = [], [], []
            for text, wholes, singles in zip(batch["text"].array, batch["wholes"].array, batch["singles"].array, strict=True):
                text = b"" if text is None else bytes(text)
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int64)
                if wholes is not None or singles is not None:
                    first, last, _, whole = ext.read(words)
                    if wholes is not None:
                        hit = _among(whole, wholes)
                        np.add.at(gone, first[hit], 1)
                        np.add.at(gone, last[hit] + window, -1)
                    if singles is not None:
                        start = np.arange(len(words) - window + 1)
                        hit = start[_among(ext.stretch(start, start + window), singles)]
                        np.add.at(gone, hit, 1)
                        np.add.at(gone, hit + window, -1)
                out = np.cumsum(gone)[:-1] > 0
                total.append(len(words))
                removed.append(int(out.sum()))
                if keep_spacing:
                    texts.append(b"".join(w for w, o in zip(spaced.findall(text), out, strict=True) if not o).lstrip() if out.any() else text)
                else:
                    texts.append(b" ".join([w for w, o in zip(words, out, strict=True) if not o] if out.any() else words))
            out = pd.DataFrame({"id": batch["id"], "n_words": total, "n_removed": removed, "kept": texts})
            yield out.assign(carried=batch["carried"]) if "carried" in batch else out

    return clean


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int | None = None, keep_spacing: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, n_words, n_removed, kept_text)``, one row per row of ``docs``.

    Words are split at ASCII white space. A word goes if a window of ``window`` words that covers
    it also occurs in a document of a smaller id; windows are judged on the input. The kept words
    stand as they stood (``keep_spacing``; the text is untouched if no word goes) or joined by
    one space.

    Null and empty texts have no words and give an empty text; texts of under ``window`` words are
    kept. Rows of a null id are kept whole and are no one's source. Rows that repeat an id are one
    document's: they remove nothing from each other. Columns in ``keep`` pass through; no other is read.
    """
    gram = gram or max(2, window // 3)
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    whole = texts.where("id is not null and octet_length(text) >= %d" % (2 * window - 1))

    seeds = whole.mapInPandas(_seeds(window, gram), SEEDS)
    met = _together(seeds, "anchor").mapInPandas(_meet, "id bigint, whole bigint, later boolean")
    lists = met.groupBy("id").agg(F.collect_set(F.expr("case when later then whole end")).alias("wholes"), F.collect_set(F.expr("case when not later then whole end")).alias("check"))
    first = cut(lists, "met")

    todo = whole.join(first.where("size(check) > 0").select("id", "check").hint("shuffle_hash"), "id")
    windows = todo.mapInPandas(_windows(window, gram), SEEDS)
    single = _together(windows, "anchor", "whole").mapInPandas(_later, "id bigint, whole bigint")
    second = single.groupBy("id").agg(F.collect_set("whole").alias("singles"))
    found = cut(first.where("size(wholes) > 0").select("id", "wholes").join(second, "id", "full").select("id", "wholes", "singles"), "repeats")
    discard(first)

    carried = texts if not keep else docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"), F.struct(*keep).alias("carried"))
    also = ", carried " + carried.schema["carried"].dataType.simpleString() if keep else ""
    kept = carried.join(found.hint("shuffle_hash"), "id", "left").mapInPandas(_cleaner(window, gram, keep_spacing), f"id bigint, n_words bigint, n_removed bigint, kept binary{also}")
    return kept.select(F.col("id").alias(id_col), *(F.col("carried")[c].alias(c) for c in keep), "n_words", "n_removed", F.decode("kept", "utf-8").alias("kept_text"))
