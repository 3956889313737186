"""Text sources and sinks: dialects, types, quotes, widths, archives."""

import bz2
import csv
import gzip
import io
import random
import tarfile
import zipfile

import pytest

import tessera as dt
from tessera.sources.files import iread

pytestmark = pytest.mark.usefixtures("spark")


def table(seed, n=60, odd=True):
    rng = random.Random(seed)
    words = ["plain", "with, comma", 'a "quoted" one', "tab\there"] + ["two\nlines", "\n"] * odd
    return [[k, rng.randint(-(10**12), 10**12), rng.randint(-999, 999) / 4, rng.choice(words), rng.choice(["true", "false"]), f"20{rng.randint(10, 29)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}"] for k in range(n)]


def written(rows, sep=",", header=("id", "big", "part", "word", "flag", "day")):
    out = io.StringIO()
    w = csv.writer(out, delimiter=sep, lineterminator="\n")
    w.writerows([header, *rows])
    return out.getvalue()


def expected(rows):
    return [(*r[:4], r[4] == "true", r[5]) for r in rows]


def plain(frame):
    return [(*r[:5], str(r[5])) for r in frame.to_tuples()]


@pytest.mark.parametrize("sep", [",", ";", "|", "\t"])
def test_types_and_quotes(sep, tmp_path):
    rows = table(1)
    path = tmp_path / "t.csv"
    path.write_text(written(rows, sep))
    for frame in (dt.fread(written(rows, sep), sep=sep), dt.fread(str(path), sep=sep)):
        assert frame.names == ["id", "big", "part", "word", "flag", "day"]
        assert [k.simpleString() for k in frame.types] == ["int", "bigint", "double", "string", "boolean", "date"]
        assert plain(frame) == expected(rows)


def test_separator_and_header_are_guessed(tmp_path):
    for sep in ",;|\t":
        assert dt.fread("a{0}b\n1{0}2\n3{0}4\n".format(sep)).to_dict() == {"a": [1, 3], "b": [2, 4]}
    assert dt.fread("1,2\n3,4\n").names == ["C0", "C1"] and dt.fread("1,2\n3,4\n", header=True).names == ["1", "2"]


@pytest.mark.parametrize("line", [3, 101, 151, 1500])
def test_wide_lines_anywhere(line, tmp_path):
    lines = ["a,b", *(f"{k},{k}" for k in range(1600))]
    lines[line] += ",777"
    path = tmp_path / "wide.csv"
    path.write_text("\n".join(lines))
    for source in ("\n".join(lines), str(path)):
        with pytest.raises(ValueError, match="fill"):
            dt.fread(source)
        out = dt.fread(source, fill=True).to_dict()
        assert list(out) == ["a", "b", "C0"] and out["C0"] == [777 if k == line - 1 else None for k in range(1600)] and out["b"] == list(range(1600))
    short = dt.fread("a,b,c\n1,2,3\n4\n").to_dict()
    assert short == {"a": [1, 4], "b": [2, None], "c": [3, None]}


@pytest.mark.parametrize("blank", [0, 5, 1200])
def test_skipping(blank, tmp_path):
    text = "\n".join(["remark, of, no use"] * 3 + [""] * blank + ["x" * 5] * 1100 + ["id,name", "1,one", "2,two"])
    path = tmp_path / "skip.csv"
    path.write_text(text)
    for source in (text, str(path)):
        assert dt.fread(source, skip_to_string="id,na").to_dict() == {"id": [1, 2], "name": ["one", "two"]}
        assert dt.fread(source, skip_to_line=1104 + blank).to_dict() == {"id": [1, 2], "name": ["one", "two"]}
        with pytest.raises(ValueError):
            dt.fread(source, skip_to_string="nowhere")
    assert dt.fread("\n" * 1500 + "a\n1\n").to_dict() == {"a": [1]}
    assert dt.fread("a\n1\n2\n3\n", max_nrows=2).to_dict() == {"a": [1, 2]}


def test_line_ends_and_encodings(tmp_path):
    assert dt.fread("a,b\r\n1,x\r\n2,y z\x0bw\r\n").to_dict() == {"a": [1, 2], "b": ["x", "y z\x0bw"]}
    for code in ("utf-8-sig", "latin-1", "utf-16"):
        path = tmp_path / f"{code}.csv"
        path.write_text("name,n\nGrüße,1\n", encoding=code)
        assert dt.fread(str(path), encoding=None if code == "utf-8-sig" else code).to_dict() == {"name": ["Grüße"], "n": [1]}


def test_columns_and_missing_values():
    text = "a,b,c\n1,-,x\n2,5,NA\n"
    assert dt.fread(text, na_strings=["-"]).to_dict() == {"a": [1, 2], "b": [None, 5], "c": ["x", "NA"]}
    assert dt.fread(text, columns={"a", "c"}).names == ["a", "c"] and dt.fread(text, columns=["p", None, "q"]).names == ["p", "q"]
    assert dt.fread(text, columns={"a": str, "b": None}).to_dict() == {"a": ["1", "2"], "c": ["x", None]}
    assert dt.fread("v\n1,5\n-2,25\n", dec=",", sep=";").to_dict() == {"v": [1.5, -2.25]}


def test_archives_and_many_sources(tmp_path):
    one, two = "a\n1\n", "a\n2\n"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/one.csv", one)
        z.writestr("two.csv", two)
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as tar:
        for name, text in (("one.csv", one), ("two.csv", two)):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    (tmp_path / "g.csv.gz").write_bytes(gzip.compress(one.encode()))
    (tmp_path / "b.csv.bz2").write_bytes(bz2.compress(two.encode()))
    assert dt.fread(f"{tmp_path}/z.zip/in/one.csv").to_dict() == {"a": [1]} and dt.fread(f"{tmp_path}/t.tar.gz/two.csv").to_dict() == {"a": [2]}
    with pytest.raises(ValueError, match="members"):
        dt.fread(f"{tmp_path}/z.zip")
    assert [x.to_dict()["a"] for x in iread([f"{tmp_path}/z.zip", f"{tmp_path}/?.csv.*"])] == [[1], [2], [2], [1]]
    assert dt.fread(cmd="printf 'a\\n7\\n'").to_dict() == {"a": [7]} and dt.fread(file=str(tmp_path / "g.csv.gz")).to_dict() == {"a": [1]}


def test_rejected_sources(tmp_path):
    with pytest.raises(OSError):
        dt.fread("<!DOCTYPE html><p>no\n</p>")
    with pytest.raises(ValueError):
        dt.fread(f"{tmp_path}/x.feather")
    with pytest.raises(ValueError):
        dt.fread(["a", "b"])


def test_written_folders(tmp_path):
    rows = table(4)
    frame = dt.fread(written(rows))
    frame.to_csv(f"{tmp_path}/out")
    assert sorted(plain(dt.fread(f"{tmp_path}/out/*.csv"))) == sorted(expected(rows))
    frame.key = "id"
    frame.to_jay(f"{tmp_path}/kept")
    again = dt.fread(f"{tmp_path}/kept")
    assert again.key == ("id",) and plain(again) == expected(rows)
    with pytest.raises(ValueError):
        frame.to_csv(f"{tmp_path}/bom", bom=True)
    assert frame.to_csv(bom=True).startswith("﻿id,")
