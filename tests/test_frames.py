"""The query form on seeded random frames: names and values against a few lines of plain Python for each operator."""

import itertools
import math as pymath
import random

import pytest

import tessera as dt
from tessera import by, f, g, join, math, sort, strings, times
from tessera.functions import categories, codes
from tessera.operators import models

pytestmark = pytest.mark.usefixtures("spark")


def drawn(seed, n=40, missing=0.2):
    """Columns of a few keys, whole numbers, dyadic numbers (exact in any order of adding) and words, some of them NA."""
    rng = random.Random(seed)
    pick = lambda make: [None if rng.random() < missing else make() for _ in range(n)]
    return {"k": pick(lambda: rng.randint(0, 4)), "i": pick(lambda: rng.randint(-50, 50)), "x": pick(lambda: rng.randint(-99, 99) / 8), "s": pick(lambda: "".join(rng.choices("abcd", k=rng.randint(0, 6))))}


def na_first(x):
    return (x is not None, x)


def groups_of(keys):
    """Each key, NA first, with the places of its rows."""
    return [(k, [at for at, y in enumerate(keys) if y == k]) for k in sorted(set(keys), key=na_first)]


@pytest.fixture(params=[11, 12])
def columns(request):
    return drawn(request.param)


def test_rows_of_groups_come_together_in_their_order(columns):
    out = dt.Frame(columns)[:, [f.i, f.s], by("k")].to_tuples()
    assert out == [(k, columns["i"][at], columns["s"][at]) for k, rows in groups_of(columns["k"]) for at in rows]
    assert dt.Frame(columns)[:, [f.k, f.i + f.x], by("k")].names == ["k", "k.0", "C0"]


@pytest.mark.parametrize("nth", [0, 1, 3, 50, -1, -2])
def test_nth_of_groups(columns, nth):
    out = dt.Frame(columns)[nth, [f.i], by(f.k)].to_tuples()
    assert out == [(k, columns["i"][rows[nth]]) for k, rows in groups_of(columns["k"]) if -len(rows) <= nth < len(rows)]


@pytest.mark.parametrize("part", [slice(1, 3), slice(-2, None), slice(None, None, 2), slice(None, None, -1), slice(4, 1, -2)])
def test_slices_of_groups(columns, part):
    out = dt.Frame(columns)[part, [f.i], by(f.k)].to_tuples()
    assert out == [(k, columns["i"][at]) for k, rows in groups_of(columns["k"]) for at in rows[part]]


def test_reducers(columns):
    def known(rows, name):
        return [columns[name][at] for at in rows if columns[name][at] is not None]

    out = dt.Frame(columns)[:, {"n": dt.count(), "c": dt.count(f.i), "na": dt.countna(f.i), "sum": dt.sum(f.i), "min": dt.min(f.x), "max": dt.max(f.x), "u": dt.nunique(f.i)}, by(f.k)].to_tuples()
    want = []
    for k, rows in groups_of(columns["k"]):
        i, x = known(rows, "i"), known(rows, "x")
        want.append((k, len(rows), len(i), len(rows) - len(i), sum(i), min(x, default=None), max(x, default=None), len(set(i))))
    assert out == want
    positive = dt.Frame(columns)[f.i > 0, {"sum": dt.sum(f.i)}, by(f.k)].to_tuples()
    assert positive == [(k, sum(t)) for k, rows in groups_of(columns["k"]) if (t := [v for v in known(rows, "i") if v > 0])]


def test_joins(columns):
    names = {n: w for n, w in zip(range(4), ("nil", "uno", "due", "tre"), strict=True)}
    table = dt.Frame(k=list(names), w=list(names.values()))
    table.key = "k"
    assert dt.Frame(columns)[:, g.w, join(table)].to_list() == [[names.get(k) for k in columns["k"]]]
    d = dt.Frame(columns)
    means = d[:, {"m": dt.mean(f.i)}, by(f.k)]
    means.key = "k"
    d[:, "m", join(means)] = g.m
    want = {k: sum(v) / len(v) for k, rows in groups_of(columns["k"]) if (v := [columns["i"][at] for at in rows if columns["i"][at] is not None])}
    assert d.to_dict()["m"] == pytest.approx([want.get(k) for k in columns["k"]])
    with pytest.raises(TypeError):
        dt.Frame(k=["word"])[:, :, join(table)]
    with pytest.raises(ValueError):
        twice = dt.Frame(k=[7, 7])
        twice.key = "k"


def running(values, add, reverse):
    out, so_far = [], None
    for v in values[::-1] if reverse else values:
        so_far = v if so_far is None else so_far if v is None else add(so_far, v)
        out.append(so_far)
    return out[::-1] if reverse else out


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("block", [7, 1_000_000])
def test_windows(columns, grouped, block, monkeypatch):
    monkeypatch.setattr("tessera.plans.rows.BLOCK", block)
    d, extra = dt.Frame(columns), (by(f.k),) if grouped else ()
    parts = [rows for _, rows in groups_of(columns["k"])] if grouped else [range(len(columns["k"]))]
    j = {f"lag{n}": dt.shift(f.i, n) for n in (1, 3, 9, -1, -8)}
    for back in (False, True):
        j |= {f"sum{back}": dt.cumsum(f.x, back), f"min{back}": dt.cummin(f.i, back), f"max{back}": dt.cummax(f.i, back), f"fill{back}": dt.fillna(f.s, reverse=back), f"n{back}": dt.cumcount(back)}
    out = d[:, j, *extra].to_dict()
    want = {name: [] for name in j}
    for rows in parts:
        i, x, s = ([columns[c][at] for at in rows] for c in "ixs")
        for n in (1, 3, 9, -1, -8):
            want[f"lag{n}"] += [i[at - n] if 0 <= at - n < len(i) else None for at in range(len(i))]
        for back in (False, True):
            want[f"sum{back}"] += [v or 0 for v in running(x, lambda a, b: a + b, back)]
            want[f"min{back}"] += running(i, min, back)
            want[f"max{back}"] += running(i, max, back)
            want[f"fill{back}"] += running(s, lambda a, b: b, back)
            want[f"n{back}"] += [*range(len(i))][:: -1 if back else 1]
    for name in j:
        assert out[name] == want[name], name


def test_assigning_what_depends_on_order(columns, monkeypatch):
    monkeypatch.setattr("tessera.plans.rows.BLOCK", 6)
    d = dt.Frame(columns)
    d[:, "before"] = dt.shift(f.i, 2)
    assert d.to_dict() == columns | {"before": [None, None, *columns["i"][:-2]]}
    codes_of = {v: n for n, v in enumerate(sorted({v for v in columns["s"] if v is not None}))}
    assert dt.Frame(columns)[:, {"c": codes(f.s)}].to_list() == [[codes_of.get(v) for v in columns["s"]]]
    assert categories(dt.Frame(columns), "s").to_list() == [list(codes_of)]


def test_na_rules(columns):
    d = dt.Frame(columns)
    pairs = list(zip(columns["i"], columns["k"], strict=True))
    out = d[:, {"eq": f.i == f.k, "ne": f.i != f.k, "lt": f.i < f.k, "le": f.i <= f.k, "div": f.i // f.k, "mod": f.i % f.k, "add": f.i + f.k}].to_dict()
    both = lambda a, b: a is not None and b is not None
    assert out["eq"] == [a == b for a, b in pairs] and out["ne"] == [a != b for a, b in pairs]
    assert out["lt"] == [both(a, b) and a < b for a, b in pairs] and out["le"] == [a <= b if both(a, b) else a is b for a, b in pairs]
    assert out["div"] == [a // b if both(a, b) and b else None for a, b in pairs] and out["mod"] == [a % b if both(a, b) and b else None for a, b in pairs]
    assert out["add"] == [a + b if both(a, b) else None for a, b in pairs]


def test_sets():
    rng = random.Random(3)
    a, b, c = ([rng.randint(0, 20) for _ in range(n)] for n in (15, 9, 12))
    x, y, z = (dt.Frame(v) for v in (a, b, c))
    a, b, c = set(a), set(b), set(c)
    assert dt.union(x, y, z).to_list() == [sorted(a | b | c)] and dt.intersect(x, y).to_list() == [sorted(a & b)]
    assert dt.setdiff(x, y, z).to_list() == [sorted(a - b - c)] and dt.symdiff(x, y, z).to_list() == [sorted(a ^ b ^ c)]


def test_binding(columns):
    a, b = dt.Frame(columns), dt.Frame(drawn(13, n=9) | {"more": list(range(9))})
    with pytest.raises(ValueError, match="force=True"):
        dt.rbind(a, b)
    out = dt.rbind(a, b, force=True).to_dict()
    assert out == {n: v + drawn(13, n=9)[n] for n, v in columns.items()} | {"more": [None] * 40 + list(range(9))}
    side = dt.cbind(a[:, ["i"]], dt.Frame(z=list(range(40))), dt.Frame(one=["x"])).to_dict()
    assert side == {"i": columns["i"], "z": list(range(40)), "one": ["x"] * 40}
    with pytest.raises(ValueError):
        dt.cbind(a, b)


@pytest.mark.parametrize("i", [slice(None, None, -1), slice(3, 20), slice(-7, None), slice(30, 4, -5), slice(2, None, 7), slice(0, 0), [5, 0, -1, 5], [slice(2, 4), 9], range(4, 12, 3), [True, False] * 20])
def test_rows(columns, i):
    places = list(range(40))
    if isinstance(i, slice):
        want = places[i]
    else:
        want = [k for k, x in enumerate(i) if x] if isinstance(i, list) and i[0] is True else list(itertools.chain(*(places[x] if isinstance(x, slice) else [places[x]] for x in i)))
    assert dt.Frame(columns)[i, "i"].to_list() == [[columns["i"][k] for k in want]]
    d = dt.Frame(columns)
    d[i, "x"] = 0.5
    assert d.to_dict()["x"] == [0.5 if k in want else v for k, v in enumerate(columns["x"])]
    d = dt.Frame(columns)
    del d[i, :]
    assert d.to_dict()["i"] == [v for k, v in enumerate(columns["i"]) if k not in want]


def test_single_rows_and_errors(columns):
    d = dt.Frame(columns)
    assert [d[k, "i"] for k in (0, 17, -1, -40)] == [columns["i"][k] for k in (0, 17, -1, -40)]
    assert d.head(3).to_dict()["s"] == columns["s"][:3] and d.tail(4).to_dict()["s"] == columns["s"][-4:]
    for bad in (40, -41, [1, 40], [True] * 3):
        with pytest.raises(ValueError):
            d[bad, :].to_list()
    with pytest.raises(KeyError, match="nowhere"):
        d[:, "nowhere"]
    with pytest.raises(TypeError):
        d["i", :]
    with pytest.raises(TypeError):
        bool(f.i > 1)
    assert d[:, f["s":"i"]].names == ["s", "x", "i"] and d[:, str].names == ["s"]


def test_numpy_and_pandas_choose_rows(columns):
    np, pd = pytest.importorskip("numpy"), pytest.importorskip("pandas")
    want = [columns["i"][k] for k in (3, 1)]
    assert dt.Frame(columns)[np.array([3, 1]), "i"].to_list() == dt.Frame(columns)[pd.Series([3, 1]), "i"].to_list() == [want]
    assert dt.Frame(columns)[np.array([True] + [False] * 39), "i"].to_list() == [columns["i"][:1]]


def test_updates_and_deletes(columns):
    d = dt.Frame(columns)
    d[f.i > 10, "i"] = 10
    d[:, "twice"] = f.i * 2
    capped = [v if v is None else min(v, 10) for v in columns["i"]]
    assert d.to_dict() == columns | {"i": capped, "twice": [v if v is None else 2 * v for v in capped]}
    del d[:, "twice"]
    del d[f.i == 10, "s"]
    assert d.names == list(columns) and d.to_dict()["s"] == [None if v == 10 else s for v, s in zip(capped, columns["s"], strict=True)]


def test_strings_and_numbers(columns):
    out = dt.Frame(columns)[:, {"n": strings.len(f.s), "back": f.s[::-1], "part": f.s[1:4], "m": strings.match(f.s, "a.*"), "root": math.sqrt(f.x)}].to_dict()
    s = columns["s"]
    each = lambda call: [None if v is None else call(v) for v in s]
    assert out["n"] == each(len) and out["back"] == each(lambda v: v[::-1]) and out["part"] == each(lambda v: v[1:4]) and out["m"] == each(lambda v: v.startswith("a"))
    assert out["root"] == pytest.approx([None if v is None or v < 0 else pymath.sqrt(v) for v in columns["x"]])
    days = dt.Frame(y=[1999, 2024, 2023, 1900], m=[12, 2, 2, 2], d=[31, 29, 29, 28])[:, times.ymd(f.y, f.m, f.d)].to_list()[0]
    assert [str(v) for v in days] == ["1999-12-31", "2024-02-29", "None", "1900-02-28"]


@pytest.mark.parametrize("by_name", [False, True])
def test_nhot_columns(by_name):
    rows = ["pear; fig", None, "fig;apple ;fig", "", "kiwi"]
    out = strings.split_into_nhot(dt.Frame(t=rows), sep=";", sort=by_name)
    tokens = [None if r is None else [w.strip() for w in r.split(";") if w.strip()] for r in rows]
    names = list(dict.fromkeys(w for row in tokens for w in row or ()))
    assert out.names == (sorted(names) if by_name else names)
    assert out.to_dict() == {n: [None if row is None else n in row for row in tokens] for n in out.names}


def test_text_round_trip(columns):
    d = dt.Frame({n: v for n, v in columns.items() if n != "s"} | {"s": [None if not v else f'{v},"{v}"' for v in columns["s"]]})
    assert dt.fread(d.to_csv()).to_dict() == d.to_dict()


def test_positions_over_many_partitions(spark):
    """200,000 wide rows: positions are dense, each row comes once, whatever columns a later plan reads."""
    from pyspark.sql import functions as F

    n = 200_000
    wide = spark.range(n).repartition(16).select("id", F.xxhash64("id").alias("h"), *(F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 256).alias(f"w{k}") for k in range(4)))
    d = dt.Frame(wide).sort("h")
    order = [r.id for r in spark.range(n).orderBy(F.xxhash64("id")).collect()]
    assert [r[0] for r in d[::1000, "id"].to_tuples()] == order[::1000]
    assert [r[0] for r in d[-150_000:-149_990, "id"].to_tuples()] == order[-150_000:-149_990]
    assert [r[0] for r in d[[199_999, 0, 77_777], "id"].to_tuples()] == [order[k] for k in (199_999, 0, 77_777)]
    folds = models.kfold(d, 4).df.groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("id").alias("u"), F.sum("id").alias("s")).orderBy("fold").collect()
    assert [(r.n, r.u, r.s) for r in folds] == [(n // 4, n // 4, sum(order[k * n // 4 : (k + 1) * n // 4])) for k in range(4)]
    both = dt.cbind(d[:, ["id"]], dt.Frame(spark.range(n).select(F.col("id").alias("p"))).sort("p"))
    rows = both.df.select("id", "p").collect()
    assert len(rows) == n and all(order[r.p] == r.id for r in rows)
    numbered = d[:, {"id": f.id, "g": dt.ngroup()}, by(f.h)].df.select("id", "g").collect()
    assert len(numbered) == n and all(order[r.g] == r.id for r in numbered)
    ends = dt.rbind(d[:, ["id"]], d[:, ["id"]])[[0, n - 1, n, 2 * n - 1], "id"].to_tuples()
    assert [r[0] for r in ends] == [order[0], order[-1], order[0], order[-1]]


#: A frame from each row to the last one is read anew for each row: time grows with the square of a group.
REREAD = "currentrow$(), unboundedfollowing$()"


def test_reversed_counts_of_a_group_take_linear_time(columns):
    out = dt.Frame(columns)[:, [dt.functions.cumcount(reverse=True)], by("k"), sort("i")]
    assert REREAD not in out.df._jdf.queryExecution().toString()
    assert [r[1] for r in out.to_tuples()] == [n for _, rows in groups_of(columns["k"]) for n in reversed(range(len(rows)))]


@pytest.mark.parametrize("keys", [(), (by("k"),)])
def test_what_runs_backwards_takes_linear_time(columns, keys):
    fn = dt.functions
    out = dt.Frame({**columns, "at": list(range(40))})[:, {"at": f.at, "fill": fn.fillna(f.x, reverse=True), "s": fn.cumsum(f.i, reverse=True), "lo": fn.cummin(f.i, reverse=True)}, *keys, sort("s", "at")]
    assert REREAD not in out.df._jdf.queryExecution().toString()
    want = {}
    for _, group in groups_of(columns["k"]) if keys else [(None, range(40))]:
        rows = sorted(group, key=lambda at: (na_first(columns["s"][at]), at))
        for n, at in enumerate(rows):
            after = rows[n:]
            known = [columns["i"][y] for y in after if columns["i"][y] is not None]
            want[at] = (next((columns["x"][y] for y in after if columns["x"][y] is not None), None), sum(known), min(known, default=None))
    assert {r[-4]: r[-3:] for r in out.to_tuples()} == want


def test_backwards_fills_keep_the_places_of_ties():
    rows = dt.Frame({"k": [1] * 6, "i": [0] * 6, "x": [1, None, 2, None, 3, None]})
    out = rows[:, {"x": f.x, "n": dt.functions.cumcount(), "bwd": dt.functions.fillna(f.x, reverse=True)}, by("k"), sort("i")].to_tuples()
    placed = sorted((r[2], r[1], r[3]) for r in out)
    for n, _, bwd in placed:
        assert bwd == next((x for _, x, _ in placed[n:] if x is not None), None)
