"""Type objects, frames as columns, row counts, iteration and arrays."""

import random

import numpy as np
import pandas as pd
import pytest

import tessera as dt
from tessera import Frame, Type, by, f, ltype, stype

pytestmark = pytest.mark.usefixtures("spark")


def drawn(seed, n=40):
    rng = random.Random(seed)
    return {"a": [rng.randint(-99, 99) for _ in range(n)], "b": [rng.choice([None, 1.5, -2.0]) for _ in range(n)], "s": [rng.choice("xyz") for _ in range(n)]}


def test_types_and_kinds():
    data = drawn(1)
    frame = Frame(data)
    assert frame.stypes == (Type.int32, Type.float64, Type.str32) and stype is Type
    assert frame.ltypes == (ltype.int, ltype.real, ltype.str)
    assert frame[:, ltype.real].names == ["b"] and frame[:, [Type.int32, Type.str32]].names == ["a", "s"]
    assert frame[:, {"x": f.a.as_type(Type.str64)}].to_dict() == {"x": list(map(str, data["a"]))}
    frame[:, "a"] = ltype.real
    assert frame.types[0] == Type.float64 and frame.to_dict()["a"] == data["a"]
    assert Type.arr32(int).elementType == Type.int64 and dt.FExpr is type(f.a)


def test_frames_and_arrays_as_columns():
    data = drawn(2)
    frame, other = Frame(data), Frame({"p": list(range(40)), "q": data["s"]})
    assert frame[:, other].to_dict() == other.to_dict()
    assert frame[f.a > 0, other].to_dict()["p"] == [k for k, a in enumerate(data["a"]) if a > 0]
    assert frame[5:9, np.arange(40)].to_list() == [[5, 6, 7, 8]]
    assert frame[:, pd.DataFrame({"z": range(40)})].to_dict() == {"z": list(range(40))}
    assert frame[-1, other, by("s")].names == ["s", "p", "q"]
    bound = dt.cbind(frame, other)
    assert bound[5:9, "p"].to_list() == [[5, 6, 7, 8]] and bound[-3, "p"] == 37 and bound[::20, "p"].to_list() == [[0, 20]]
    with pytest.raises(ValueError):
        frame[:, Frame([1, 2, 3])]


@pytest.mark.parametrize("value", [range(40), np.arange(40), pd.DataFrame({"z": range(40)}), None], ids=["range", "numpy", "pandas", "frame"])
def test_frames_and_arrays_are_assigned(value):
    data = drawn(3)
    value = Frame({"z": list(range(40))}) if value is None else value
    frame = Frame(data)
    frame[:, "k"] = value
    frame[:, "a"] = value
    assert frame.to_dict() == data | {"a": list(range(40)), "k": list(range(40))}
    with pytest.raises(ValueError):
        frame[:, "k"] = range(39)
    with pytest.raises(ValueError):
        frame[f.a > 3, "k"] = value


def test_number_of_rows_is_set():
    data = drawn(4)
    for n in (0, 7, 40, 55):
        frame = Frame(data)
        frame.nrows = n
        assert frame.to_dict() == {c: (v + [None] * 99)[:n] for c, v in data.items()}
    for wrong, error in ((-1, ValueError), (2.0, TypeError), (True, TypeError)):
        with pytest.raises(error):
            frame.nrows = wrong


def test_iteration_and_arrays():
    data = drawn(5)
    frame = Frame(data)
    assert [x.names for x in frame] == [["a"], ["b"], ["s"]] and [x.to_list()[0] for x in reversed(frame)] == list(data.values())[::-1]
    assert frame.to_numpy(column="a").tolist() == data["a"]
    assert frame[:, "a"].to_numpy(type=float).dtype == float
    masked = Frame({"k": [4, None, -1]}).to_numpy(column=0)
    assert masked.mask.tolist() == [False, True, False] and masked.tolist() == [4, None, -1]
