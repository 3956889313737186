"""MinHash near-duplicate detection with SuperMinHash signatures.

SuperMinHash gives every element of a set a random order of the signature's slots and, at rank j
of that order, a value in [j, j + 1); a slot keeps the least value it is given. All ranks of one
element exclude each other, which lowers the variance against independent hashes, and once every
slot holds a value under j + 1 no later rank can change anything: the signature is finished early.

Stages: signatures and set digests (one pass), one representative per distinct set, banding,
leaders of buckets, confirmation on the full sets, union-find grouping. A bucket's members are
first compared with its smallest one only. Where members of different components then still meet
in a bucket, the bucket is dealt into blocks of bounded size and pairs of blocks are compared in
the tasks, on the full sets; two blocks of one component are never paired. Only links come out,
so that no bucket is ever expanded into rows of all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.scratch import bound_batches, cut, discard
from tessera.llm.words import STEP, WordHash, grams, mix

#: Elements for which signatures are computed at once in a task.
BATCH_ELEMENTS = 50_000
#: A block of a bucket holds about so many elements; each member counts ROW more.
BLOCK, ROW = 100_000, 100
#: Up to so many candidates are broadcast to pick their texts out; more are joined by a shuffle.
BROADCAST = 1_000_000
#: Ranks for which swaps are replayed instead of holding whole orders.
REPLAYED = 6


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; fewer words are one shingle."""
    return np.unique(grams(hashes, min(n, len(hashes)))) if len(hashes) else np.empty(0, np.uint64)


def shingle_set(text: bytes | None, n: int) -> set:
    words = (text or b"").lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(n)), strict=False))


def superminhash(elements: np.ndarray, owner: np.ndarray, owners: int, slots: int) -> np.ndarray:
    """Signatures, one row per owner, of the elements that each owns (distinct within an owner).

    Rank j is handled for all elements together. Their slot orders are Fisher-Yates shuffles
    driven by the element's own random numbers: for the first ranks the few swaps are replayed,
    later, when only small sets are unfinished, whole orders are held.
    """
    values = np.full(owners * slots, np.inf)
    base, swaps, order = mix(elements), [], None
    for rank in range(slots):
        draw = mix(base + np.uint64((rank + 1) * int(STEP) & (1 << 64) - 1))
        value = rank + (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        pick = rank + (((mix(draw) >> np.uint64(32)) * np.uint64(slots - rank)) >> np.uint64(32)).astype(np.int64)
        if rank == REPLAYED:
            order = np.tile(np.arange(slots, dtype=np.uint16), (len(base), 1))
            for step, swap in enumerate(swaps):
                order[np.arange(len(base)), swap] = order[:, step]
        if order is None:
            slot = pick
            for step in range(rank - 1, -1, -1):
                slot = np.where(swaps[step] == slot, step, slot)
            swaps.append(pick)
        else:
            rows = np.arange(len(base))
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, rank]
        np.minimum.at(values, owner * slots + slot, value)
        active = (values.reshape(owners, slots).max(axis=1) >= rank + 1)[owner]
        if not active.any():
            break
        if not active.all():
            base, owner = base[active], owner[active]
            swaps = [s[active] for s in swaps] if order is None else []
            order = None if order is None else order[active]
    return values.reshape(owners, slots)


def _signer(n: int, bands: int, rows: int):
    slots = bands * rows

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHash()

        def finish(ids, sets):
            full = [s for s in sets if len(s)]
            keys = iter(())
            if full:
                owner = np.repeat(np.arange(len(full)), [len(s) for s in full])
                cells = superminhash(np.concatenate(full), owner, len(full), slots).view(np.uint64).reshape(len(full), bands, rows)
                key = np.zeros((len(full), bands), np.uint64)
                for r in range(rows):
                    key = mix(key * STEP + cells[:, :, r])
                keys = iter(key.view(np.int64))
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            return pd.DataFrame({"id": pd.array(ids, "Int64"), "n_shingles": [len(s) for s in sets], "digest": digests, "bands": [next(keys) if len(s) else None for s in sets]})

        for batch in batches:
            ids, sets, held = [], [], 0
            for i, text in zip(batch["id"].array, batch["text"].array, strict=True):
                sets.append(shingle_hashes(seen.of((text or b"").lower().split()), n))
                ids.append(i)
                held += len(sets[-1])
                if held >= BATCH_ELEMENTS:
                    yield finish(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield finish(ids, sets)

    return sign


def _confirmer(n: int, percent: int):
    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = None, set()
        for batch in batches:
            keep = []
            for a, text_a, text_b in zip(batch["a"].array, batch["text_a"].array, batch["text_b"].array, strict=True):
                if a != last:
                    last, left = a, shingle_set(text_a, n)
                right = shingle_set(text_b, n)
                shared = len(left & right)
                keep.append(100 * shared >= percent * (len(left) + len(right) - shared))
            yield batch.loc[keep, ["a", "b"]]

    return confirm


def _same_size(a: str, b: str, percent: int) -> Column:
    """Sets whose sizes differ by more than the threshold allows can't be linked."""
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _dealt(named: DataFrame, texts: DataFrame) -> DataFrame:
    """``(meeting, side, rep, comp, text)``: the members of buckets in which components meet, once for each pair of blocks that they belong to.

    A component that fills more than one block of its bucket has blocks of its own, which are
    paired with all others but each other; the smaller ones share blocks, paired with all.
    """
    parts = named.groupBy("bucket", "comp").agg(F.sum(F.col("n") + ROW).alias("w"))
    big = F.when(F.col("w") > BLOCK, F.struct("comp", F.ceil(F.col("w") / BLOCK).cast("int").alias("blocks")))
    rest = F.coalesce(F.sum(F.when(F.col("w") <= BLOCK, F.col("w"))), F.lit(0))
    meet = parts.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.collect_list(big).alias("bigs"), F.ceil(rest / BLOCK).cast("int").alias("shared")).where("lo < hi").drop("lo", "hi")

    def block(kind: int, comp: Column, k: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), comp.cast("bigint").alias("comp"), k.cast("int").alias("k"))

    def numbers(n: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: k < n)

    alone = F.get(F.filter("bigs", lambda x: x["comp"] == F.col("comp")), F.lit(0))["blocks"]
    at = F.pmod(F.xxhash64("rep", F.lit(1)), F.coalesce(alone, "shared")).cast("int")
    own = F.when(alone.isNotNull(), block(1, F.col("comp"), at)).otherwise(block(0, F.lit(0), at))
    every = F.concat(F.transform(numbers(F.col("shared")), lambda k: block(0, F.lit(0), k)), F.flatten(F.transform("bigs", lambda x: F.transform(numbers(x["blocks"]), lambda k: block(1, x["comp"], k)))))
    others = F.filter("every", lambda x: ~((x["kind"] == 1) & (F.col("own.kind") == 1) & (x["comp"] == F.col("own.comp"))))
    members = named.join(meet, "bucket").select("bucket", "rep", "comp", own.alias("own"), every.alias("every")).select("bucket", "rep", "comp", "own", others.alias("others"))
    rows = members.join(texts, "rep").select("bucket", "rep", "comp", "text", "own", F.explode("others").alias("other"))
    return rows.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("meeting"), F.when(F.col("own") < F.col("other"), 1).when(F.col("own") > F.col("other"), 2).otherwise(0).alias("side"), "rep", "comp", "text")


def _links_of(reps, comps, sides, texts, n: int, percent: int, seen: WordHash) -> list[tuple[int, int]]:
    """Links between members of different components, enough of them to join all that are linked here."""
    sets = [shingle_hashes(seen.of((t or b"").lower().split()), n) for t in texts]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    elements = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    names, comp = np.unique(comps, return_inverse=True)
    root = np.arange(len(names))
    two = (sides == 1).any() and (sides == 2).any()
    if two:  # of two blocks, the one of fewer members asks the other
        asking = 1 if (sides == 1).sum() <= (sides == 2).sum() else 2
        ask, answer = np.flatnonzero(sides == asking), sides != asking
    else:
        ask, answer = np.flatnonzero(comp != np.bincount(comp).argmax()), np.ones(len(sets), bool)
    flag, found = np.zeros(elements.max() + 1, np.uint8), []
    exact = cache(lambda k: shingle_set(texts[k], n))
    for x in ask.tolist():
        if not (answer & (root[comp] != root[comp[x]])).any():
            continue
        mine = elements[starts[x] : starts[x] + size[x]]
        flag[mine] = 1
        common = np.add.reduceat(flag[elements], starts, dtype=np.int64)
        flag[mine] = 0
        like = np.flatnonzero(answer & (100 * common >= percent * (size[x] + size - common)))
        for y in like[np.argsort(-common[like], kind="stable")].tolist():
            if root[comp[x]] != root[comp[y]]:
                both = len(exact(x) & exact(y))
                if 100 * both >= percent * (len(exact(x)) + len(exact(y)) - both):
                    found.append((min(reps[x], reps[y]), max(reps[x], reps[y])))
                    root[root == root[comp[y]]] = root[comp[x]]
    return found


def _linker(n: int, percent: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by meeting; the last one of a batch may go on in the next. Texts become Python's only one meeting at a time."""
        seen, left = WordHash(), None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([left, rows]).combine_chunks() if left is not None else rows
            key = rows["meeting"].to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()] if len(key) else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                yield links(rows.slice(a, b - a), seen)
            left = rows.slice(edges[-1])
        if left is not None and len(left):
            yield links(left, seen)

    def links(part: pa.Table, seen: WordHash) -> pa.RecordBatch:
        comps = part["comp"].to_numpy()
        found = _links_of(part["rep"].to_pylist(), comps, part["side"].to_numpy(), part["text"].to_pylist(), n, percent, seen) if (comps != comps[0]).any() else []
        ends = ([x[k] for x in found] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], ["a", "b"])

    return link


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, bands: int = 48, rows: int = 6) -> DataFrame:
    """``(id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    Two documents are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of
    ``n``-word shingles (A-Z lower-cased; words are split at ASCII white space); components are
    the connected groups, named by their smallest id, whose row is kept.

    Candidates share one of ``bands`` bands of ``rows`` slots: a pair at similarity s is missed
    with probability ``(1 - s**rows) ** bands``, 5e-7 at 0.8 with the defaults. Every candidate
    that could join two components is compared on the full sets, and each link is confirmed on
    sets of words, not of hashes.

    Null and empty texts have no shingles and are linked with nothing. Rows of a null id get a
    null component and are kept. Rows that repeat an id share the id's component (their texts
    are all compared). An empty table gives no rows. Texts of any length are read whole. No other
    column is read, so clashing names do no harm.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    signed = cut(texts.mapInPandas(_signer(n, bands, rows), "id bigint, n_shingles bigint, digest binary, bands array<bigint>"), "signed")

    # One representative for each distinct set: exact copies are not compared with each other.
    sets = signed.where("digest is not null and id is not null")
    firsts = cut(sets.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "firsts")
    owned = cut(signed.select("id", "n_shingles", "digest").join(firsts.select("digest", "rep"), "digest", "left").drop("digest"), "owned")

    entries = firsts.select("rep", "n", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "rep", "n")
    buckets = entries.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    shared = cut(entries.join(buckets, "bucket"), "shared")
    discard(signed, firsts)

    # A representative's set is that of any row of its id with its digest; rows that repeat an id may differ.
    reps = cut(shared.select("rep").distinct(), "reps")
    wanted = F.broadcast(reps) if reps.count() <= BROADCAST else reps
    picked = cut(texts.join(wanted, F.col("id") == F.col("rep")).select("rep", "text"), "picked")

    stars = shared.where("first.rep < rep").where(_same_size("n", "first.n", percent)).select(F.col("first.rep").alias("a"), F.col("rep").alias("b")).distinct()
    both = stars.join(picked.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b").join(picked.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    lowest = owned.where("id is not null").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("top")).where("a < top").drop("top")
    repeated = owned.join(lowest, "id").where("rep <> a").select("a", F.col("rep").alias("b"))
    links = cut(both.select("a", "b", "text_a", "text_b").mapInPandas(_confirmer(n, percent), "a bigint, b bigint").union(repeated), "links")
    grouped = components(links)

    # What the leaders left apart: members of different components that meet in a bucket.
    named = cut(shared.join(grouped, shared["rep"] == grouped["node"], "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("comp")), "named")
    meetings = _dealt(named, picked).repartition("meeting").sortWithinPartitions("meeting")
    more = cut(meetings.mapInArrow(_linker(n, percent), "a bigint, b bigint").distinct(), "links")
    if more.limit(1).count():
        grouped = components(links.union(more))
    discard(shared, reps, picked, named)
    out = owned.join(grouped, owned["rep"] == grouped["node"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
