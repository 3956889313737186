"""Sequence packing: concatenate all documents and cut into windows of a fixed length.

Pass one tokenises each document once and stores its ids with their offset inside the task that
wrote them. The prefix sums of the tasks' totals, one number a task, give every task its global
offset. Pass two reads the stored ids and cuts at the multiples of the length: each piece of a
document is a boundary record of the sequence that it lies in. Only the last sequence is short.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from contextlib import suppress
from functools import cache
from itertools import accumulate

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from tessera.llm.scratch import bound_batches, cut, small_table

#: The pattern by which byte-level tokenizers divide a text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that both tokenizer libraries are tested to put into the same classes; texts with others go to the first one.
TESTED = "\x00-\u024f\u0370-\u052f\u0600-\u06ff\u0900-\u097f\u1e00-\u1eff\u2000-\u206f\u20a0-\u20bf\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff00-\uffef"
_coders: dict[tuple[str, bool], ByteCoder] = {}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _tokenizer(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _twin(path: str) -> tiktoken.Encoding | None:
    """The file's byte-level BPE in the faster library; None where its rules are not that library's."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    if not plain or file.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    byte_of, vocab = _byte_of(), model["vocab"]
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if None in merged or merged != sorted(set(merged)):  # it merges in the order of ids
        return None
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items() if all(c in byte_of for c in t)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) >= len(merged) + 256 else None


@cache
def agrees(path: str) -> bool:
    """Whether the faster library gives every vocabulary entry, taken as a text, the ids of the file's own library."""
    twin = _twin(path)
    if twin is None:
        return False
    words = []
    for token in twin.token_byte_values():
        with suppress(UnicodeDecodeError):  # part of a character: never a whole piece of a text
            words.append(token.decode())
    theirs = _tokenizer(path).encode_batch_fast(words, add_special_tokens=False)
    return all(list(e.ids) == twin.encode_ordinary(w) for w, e in zip(words, theirs, strict=True))


class ByteCoder:
    """A byte-level BPE tokenizer file.

    Its ids are those of ``tokenizers``. Where :func:`agrees` holds, texts of tested characters
    without the file's added tokens are encoded by ``tiktoken`` with the same merges, several
    times as fast; the others, and all texts of other files, by ``tokenizers`` itself.
    """

    def __init__(self, path: str, quick: bool):
        self.tokenizer, self.twin = _tokenizer(path), _twin(path) if quick else None
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.slow = re.compile("|".join([f"[^{TESTED}]", *added]))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    @classmethod
    def of(cls, path: str, quick: bool) -> ByteCoder:
        """This worker's coder: it outlives a task."""
        if (path, quick) not in _coders:
            _coders[path, quick] = cls(path, quick)
        return _coders[path, quick]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        if not self.twin:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        own = [self.twin.encode_ordinary(t) if not self.slow.search(t) else None for t in texts]
        rest = iter(self.tokenizer.encode_batch_fast([t for t, ids in zip(texts, own, strict=True) if ids is None], add_special_tokens=False))
        return [next(rest).ids if ids is None else ids for ids in own]


def _encoder(path: str, end_id: int, quick: bool):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, task, offset = ByteCoder.of(path, quick), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                ids = [np.array([*x, end_id], coder.dtype) for x in coder.encode([t or "" for t in part["text"].array])]
                size = list(map(len, ids))
                begin = list(accumulate(size, initial=offset))
                offset = begin.pop()
                yield pd.DataFrame({"task": task, "begin": begin, "id": part["id"].array, "tokens": size, "ids": [x.tobytes() for x in ids]})

    return encode


def _cutter(dtype: np.dtype, length: int, with_ids: bool):
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, base, begin, ids in zip(batch["id"].array, batch["base"], batch["begin"], batch["ids"], strict=True):
                at, ids = base + begin, np.frombuffer(ids, dtype).astype("<u4")
                edges = [0, *range(length - at % length, len(ids), length), len(ids)]
                for a, b in zip(edges, edges[1:], strict=False):
                    piece = ids[a:b]
                    out.append((i, a, b - a, zlib.crc32(piece.tobytes()), len(ids), (at + a) // length, (at + a) % length, *([piece.astype(np.int32)] if with_ids else [])))
            if out:
                frame = pd.DataFrame(out, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])])
                yield frame.assign(id=frame["id"].astype("Int64"))

    return pieces


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``.

    A document is the ids of its text by the byte-level BPE file ``tokenizer``, then ``end_id``.
    Every id lies in one piece; sequence s holds the global offsets from ``s * length``, so all
    but the last are full. ``ids_crc32`` is over little-endian unsigned 32-bit ids.

    A null text is an empty one: just ``end_id``. Null ids are carried as they are and rows that
    repeat an id are documents of their own. An empty table gives no rows. No other column is read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    quick = agrees(tokenizer)
    stored = cut(texts.mapInPandas(_encoder(tokenizer, end_id, quick), "task int, begin bigint, id bigint, tokens bigint, ids binary"), "ids")
    totals = stored.groupBy("task").agg(F.sum("tokens").alias("n")).orderBy("task").collect()  # one number a task
    bases = accumulate((r["n"] for r in totals), initial=0)
    bases = small_table(spark, [(r["task"], b) for r, b in zip(totals, bases, strict=False)], "task int, base bigint")
    schema = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    return stored.join(F.broadcast(bases), "task").mapInPandas(_cutter(ByteCoder.of(tokenizer, quick).dtype, length, with_ids), schema).withColumnRenamed("id", id_col)
