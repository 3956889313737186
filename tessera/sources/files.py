"""Text and Parquet files. Separators and headers are guessed from the first lines; Spark reads the rest."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import types as t

#: Separators in the order in which they are tried.
SEPARATORS = (",", "|", ";", "\t", " ")


def _guess(lines: list[str], quote: str) -> str:
    """The first separator that divides all sampled lines into the same number of fields, more than one."""
    plain = [re.sub(f"{re.escape(quote)}[^{re.escape(quote)}]*{re.escape(quote)}", "", x) for x in lines if x.strip()]
    best = ","
    for sep in SEPARATORS[::-1]:
        counts = {x.strip(" ").count(sep) for x in plain}
        if len(counts) == 1 and counts != {0}:
            best = sep
    return best


def _value_like(x: str) -> bool:
    return bool(re.fullmatch(r"\s*(|NA|[-+]?[\d.,]+(e[-+]?\d+)?|true|false|\d{4}-\d\d-\d\d.*)\s*", x, re.I))


def fread(source=None, *, file=None, text=None, cmd=None, url=None, columns=None, sep=None, dec=".", header=None, na_strings=None, fill=False, encoding=None, skip_to_line=None, skip_to_string=None, skip_blank_lines=True, strip_whitespace=True, quotechar='"', max_nrows=None):
    """One frame of a text file, text, the output of a command, a URL, or a written frame.

    Types are inferred over all rows; ``columns`` renames, drops or retypes: a list of names (None
    drops), a set of names to keep, or a dict of names to types, names or None. A first line none
    of whose fields looks like a value is a header. ``na_strings`` are NA, as an empty field is.
    Line ends within quotes belong to their field. A line of more fields than the first is an error
    unless ``fill`` is set; one of fewer is filled with NA. Texts, commands, URLs and archives are
    read by the driver, files and folders by the tasks.
    """
    import glob
    import os
    import subprocess
    import urllib.request

    from tessera.frame import Frame, Order, unique_names

    spark = SparkSession.active()
    if isinstance(source, (list, tuple)):
        raise ValueError("many sources are read by iread")
    if source is not None:
        source = os.fspath(source) if hasattr(source, "__fspath__") else source
        if hasattr(source, "read"):
            text = source.read()
            text = text.decode(encoding or "utf-8-sig") if isinstance(text, bytes) else text
        elif "\n" in source:
            text = source
        elif re.match(r"(https?|ftp)://", source):
            url = source
        else:
            file = source
    if cmd is not None:
        text = subprocess.run(cmd, shell=True, check=True, capture_output=True, text=True).stdout
    if url is not None:
        with urllib.request.urlopen(url) as r:
            text = r.read().decode(encoding or "utf-8-sig")
    if file is not None and (file.endswith((".parquet", ".jay")) or glob.glob(f"{file}/*.parquet")):
        return load(file)
    if file is not None and (archive := re.match(r"(.+?\.(?:zip|tar|tgz|tar\.gz|xz))(?:/(.+))?$", file)):
        members = list(_archive(archive[1], encoding, archive[2]))
        if len(members) != 1:
            raise ValueError(f"{file} has {len(members)} such members: name one, as in archive.zip/name, or use iread")
        text = members[0]
    if file is not None and file.endswith(".feather"):
        raise ValueError("feather files are not read: use Parquet")
    if text is not None:
        if re.match(r"\s*<(!doctype|html)", text, re.I):
            raise OSError("HTML is no table")
        rows = spark.createDataFrame(list(enumerate(_records([text.removeprefix("\ufeff")], quotechar))), "__rid bigint, value string")
    else:
        rows = _file_records(spark, file, encoding or "UTF-8", quotechar)
    # Where the table begins: one aggregation over all records, not over a first part of them.
    begin = None
    if skip_to_line and skip_to_line > 1:
        before = rows.orderBy("__rid").limit(skip_to_line - 1).agg(F.max("__rid"), F.count("*")).first()
        rows = rows.where(F.col("__rid") > before[0]) if before[1] == skip_to_line - 1 else rows.where("false")
    if skip_to_string:
        begin = rows.where(F.contains("value", F.lit(skip_to_string))).agg(F.min("__rid")).first()[0]
        if begin is None:
            raise ValueError(f"no line holds {skip_to_string!r}")
        rows = rows.where(F.col("__rid") >= begin)
    if skip_blank_lines:
        rows = rows.where(F.trim(F.regexp_replace("value", r"[\r\t]", " ")) != "")
    first_lines = rows.orderBy("__rid").limit(101).collect()
    sample = [r["value"] for r in first_lines[:100]]
    if not sample:
        return Frame(spark.createDataFrame([], "C0 void"))
    sep = sep or _guess(sample, quotechar)
    import csv

    fields = next(csv.reader([sample[0].strip("\r")], delimiter=sep, quotechar=quotechar))
    if header is None:
        header = not any(_value_like(x) and x.strip() for x in fields) and any(x.strip() for x in fields)
    body = rows.where(F.col("__rid") > first_lines[0]["__rid"]) if header else rows
    if max_nrows is not None:
        body = body.orderBy("__rid").limit(max_nrows)
    # The widest record of all: what is quoted has no separators.
    q = re.escape(quotechar)
    bare = F.regexp_replace(F.trim("value") if sep != "\t" else F.col("value"), f"{q}[^{q}]*{q}", "") if quotechar else F.col("value")
    most = body.agg(F.max(F.char_length(bare) - F.char_length(F.replace(bare, F.lit(sep), F.lit(""))))).first()[0]
    width = len(fields) if most is None else max(len(fields), most // len(sep) + 1)
    if width > len(fields) and not fill:
        raise ValueError(f"a line has {width} fields where {len(fields)} are expected; fill=True makes room for them")
    names = unique_names([x.strip() for x in fields] + [None] * (width - len(fields)) if header else [None] * width)
    parse = F.from_csv("value", ", ".join(f"`c{k}` string" for k in range(width)), {"sep": sep, "quote": quotechar, "escape": quotechar, "multiLine": "true", "maxCharsPerColumn": "-1", "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": str(strip_whitespace).lower(), "ignoreTrailingWhiteSpace": str(strip_whitespace).lower()})
    df = body.select("__rid", parse.alias("p")).select("__rid", *(F.col(f"p.c{k}").alias(n) for k, n in enumerate(names)))
    missing = [*(na_strings or ["NA"]), ""]
    df = df.select("__rid", *(F.when(~F.col(f"`{n}`").isin(missing), F.col(f"`{n}`")).alias(n) for n in names))
    renamed, kept, kinds = dict.fromkeys(names), list(names), {}
    if callable(columns):
        columns = columns(names)
    if isinstance(columns, set):
        kept = [n for n in names if n in columns]
    elif isinstance(columns, list):
        kept = [n for n, c in zip(names, columns, strict=True) if c is not None and c is not False]
        renamed = {n: c for n, c in zip(names, columns, strict=True) if isinstance(c, str)}
        kinds = {n: t.as_type(c) for n, c in zip(names, columns, strict=True) if t.is_type(c)}
    elif isinstance(columns, dict):
        kept = [n for n in names if columns.get(n, True) is not None]
        renamed = {n: c for n, c in columns.items() if isinstance(c, str)}
        kinds = {n: t.as_type(c) for n, c in columns.items() if t.is_type(c)}
    kinds |= _infer(df, [n for n in kept if n not in kinds], dec)
    out = df.select("__rid", *(_parse(F.col(f"`{n}`"), kinds[n], dec).alias(renamed.get(n) or n) for n in kept))
    return Frame(out, order=[Order(F.col("__rid"))])


def _records(parts, quote: str) -> Iterator[str]:
    """The lines of a text given in parts; a line end within quotes does not end a record."""
    held = ""
    open_quote = False
    for part in parts:
        for line in re.split(r"\r\n|\n|\r", part):
            held = f"{held}\n{line}" if open_quote else line
            open_quote ^= bool(quote) and line.count(quote) % 2 == 1
            if not open_quote:
                yield held
    if open_quote:
        yield held


def _file_records(spark: SparkSession, file: str, encoding: str, quote: str) -> DataFrame:
    """``(__rid, value)`` of a text file's records.

    Files of other encodings than UTF-8, and those of which a line leaves a quote open, are divided by one task each.
    """
    lines, q = spark.read.text(file), F.lit(quote)
    other = encoding.lower().replace("_", "-") not in ("utf-8", "utf8", "utf-8-sig", "ascii")
    if other or quote and lines.where((F.char_length("value") - F.char_length(F.replace("value", q, F.lit("")))) % 2 == 1).limit(1).count():
        import bz2
        import gzip

        import pandas as pd

        code = encoding if other else "utf-8-sig"

        def records(batches):
            for batch in batches:
                for path, content in zip(batch["path"], batch["content"], strict=True):
                    content = gzip.decompress(content) if path.endswith(".gz") else bz2.decompress(content) if path.endswith(".bz2") else content
                    yield pd.DataFrame({"value": list(_records([content.decode(code).removesuffix("\n")], quote))})

        lines = spark.read.format("binaryFile").load(file).select("path", "content").mapInPandas(records, "value string")
    return lines.select(F.monotonically_increasing_id().alias("__rid"), F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), r"\r$", "").alias("value"))


def _plain(x, dec: str):
    x = F.trim(x)
    return F.regexp_replace(x, ",", ".") if dec == "," else x


def _parse(x, kind, dec: str):
    if kind == t.STR:
        return x
    if kind == t.BOOL:
        return F.when(F.lower(F.trim(x)).isin("true", "t", "1"), True).when(F.lower(F.trim(x)).isin("false", "f", "0"), False)
    if t.is_int(kind):
        return F.regexp_replace(F.trim(x), r"(?<=\d),(?=\d{3})", "").try_cast(kind.simpleString())
    if t.is_float(kind):
        y = _plain(x, dec)
        return t.drop_nan(F.when(F.lower(y).isin("inf", "+inf", "infinity"), float("inf")).when(F.lower(y).isin("-inf", "-infinity"), float("-inf")).otherwise(y.try_cast("double")), t.FLOAT64).cast(kind.simpleString())
    return x.try_cast(kind.simpleString())


def _infer(df: DataFrame, names: list[str], dec: str) -> dict:
    """The narrowest type that all values of a column parse as: one aggregation over all rows."""
    tests = [(t.BOOL, r"(?i)^\s*(true|false)\s*$"), (t.INT32, None), (t.INT64, None), (t.FLOAT64, None), (t.DATE, r"^\s*\d{4}-\d\d-\d\d\s*$"), (t.TIME, r"^\s*\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?\s*$")]
    aggs = []
    for k, n in enumerate(names):
        x = F.col(f"`{n}`")
        aggs.append(F.count(x).alias(f"n{k}"))
        for m, (kind, pattern) in enumerate(tests):
            ok = _parse(x, kind, dec).isNotNull() if not pattern else x.rlike(pattern) & _parse(x, kind, dec).isNotNull()
            if kind == t.FLOAT64:
                ok = ok | F.lower(F.trim(x)).isin("nan")
            aggs.append(F.count_if(ok).alias(f"k{k}_{m}"))
    row = df.agg(*aggs).first() if aggs else None
    out = {}
    for k, n in enumerate(names):
        fits = [kind for m, (kind, _) in enumerate(tests) if row[f"k{k}_{m}"] == row[f"n{k}"]]
        out[n] = fits[0] if fits and row[f"n{k}"] else t.STR
    return out


def _archive(path: str, encoding=None, member: str | None = None) -> Iterator[str]:
    """The texts of an archive's files, or of those that a name or pattern says."""
    import lzma
    import tarfile
    import zipfile
    from fnmatch import fnmatch

    wanted = lambda n: member is None or n == member or fnmatch(n, member) or n.startswith(f"{member}/")
    if path.endswith(".zip"):
        with zipfile.ZipFile(path) as z:
            for n in z.namelist():
                if not n.endswith("/") and wanted(n):
                    yield z.read(n).decode(encoding or "utf-8-sig")
    elif path.endswith(".xz"):
        with lzma.open(path) as x:
            yield x.read().decode(encoding or "utf-8-sig")
    else:
        with tarfile.open(path) as tar:
            for m in tar:
                if m.isfile() and wanted(m.name):
                    yield tar.extractfile(m).read().decode(encoding or "utf-8-sig")


def iread(sources, errors: str = "warn", **options) -> Iterator:
    """A frame of each source: paths, patterns, archives, or a list of them."""
    import glob
    import warnings

    for source in sources if isinstance(sources, (list, tuple)) else [sources]:
        if isinstance(source, str) and "\n" not in source and source.endswith((".zip", ".tar", ".tgz", ".tar.gz")):
            parts = [{"text": x} for x in _archive(source, options.get("encoding"))]
        elif isinstance(source, str) and glob.has_magic(source) and "\n" not in source:
            parts = [{"file": x} for x in sorted(glob.glob(source))]
        else:
            parts = [{"source": source}]
        for p in parts:
            try:
                yield fread(**p, **options)
            except Exception as e:
                if errors == "raise":
                    raise
                if errors == "warn":
                    warnings.warn(str(e), stacklevel=2)


def to_csv(frame, path: str = "", sep: str = ",", quoting: str = "minimal", append: bool = False, header: bool | None = None, bom: bool = False, compression: str | None = None):
    """Write CSV part files into the folder ``path``, or return text for an empty path. Truth values are True and False."""
    df = frame.sorted_df()
    df = df.select(*(t.cast(F.col(f"`{n}`"), k, t.STR).alias(n) if k == t.BOOL else F.col(f"`{n}`") for n, _, k in frame.fields))
    header = not append if header is None else header
    if not path:
        import csv
        import io

        out = io.StringIO()
        style = {"minimal": csv.QUOTE_MINIMAL, "all": csv.QUOTE_ALL, "nonnumeric": csv.QUOTE_NONNUMERIC, "none": csv.QUOTE_NONE}[quoting]
        writer = csv.writer(out, delimiter=sep, quoting=style, lineterminator="\n")
        if header:
            writer.writerow(df.columns)
        for r in df.toLocalIterator():
            writer.writerow(["" if x is None else x for x in r])
        return "\ufeff" * bom + out.getvalue()
    if bom or quoting in ("nonnumeric", "none"):
        raise ValueError("bom, and quoting nonnumeric or none, are for texts, not for folders")
    df.write.mode("append" if append else "overwrite").options(sep=sep, header=header, quoteAll=quoting == "all", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, compression=compression or "none").csv(path)
    return None


def save(frame, path: str) -> None:
    """The frame as Parquet; the key is kept in the columns' metadata."""
    df = frame.to_spark()
    for n in frame.key_names:
        df = df.withMetadata(n, {"key": frame.key_names.index(n)})
    df.write.mode("overwrite").parquet(path)


def load(path: str):
    """A frame written by :func:`save`, or any Parquet table."""
    from tessera.frame import Frame, Order

    df = SparkSession.active().read.parquet(path)
    key = sorted((x.metadata["key"], x.name) for x in df.schema if "key" in x.metadata)
    names = tuple(n for _, n in key)
    return Frame(df, key=names, order=[Order(F.col(f"`{n}`")) for n in names] or None)
