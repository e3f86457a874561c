"""CSV, JSON and Parquet readers."""

from __future__ import annotations

import csv
import datetime as dt
import glob
import io
import json
import os
import re
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import INVALID_ARGUMENT, FrameError
from ..functions.casts import cast
from ..params import to_bool, to_int
from ..schema import project, quoted, resolve
from ..typenames import parse
from .paths import canonical, head, is_glob, is_remote, lines, local, size_of

DELIMITERS = (",", "\t", ";", "|")
#: Characters of a CSV file that its dialect is guessed from; rows that types are inferred from.
SNIFFED, SAMPLE_ROWS = 64 << 10, 20_480


def _rows(sample: str, delimiter: str, quote: str) -> list[list[str]]:
    try:
        return [r for r in csv.reader(io.StringIO(sample, newline=""), delimiter=delimiter, quotechar=quote or None, quoting=csv.QUOTE_MINIMAL if quote else csv.QUOTE_NONE) if r]
    except csv.Error:
        return []


def guess_delimiter(sample: str, quote: str) -> str:
    """The candidate that parts the most rows into the same number of fields, two at least."""
    best, choice = (0.0, 0), ","
    for d in DELIMITERS:
        widths = [len(r) for r in _rows(sample, d, quote)][:200]
        common = max(set(widths), key=widths.count) if widths else 1
        if common > 1:
            score = (widths.count(common) / len(widths), common)
            if score > best:
                best, choice = score, d
    return choice


def _kind(x: str) -> str:
    x = x.strip()
    if not x:
        return "empty"
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", x):
        return "number"
    if re.fullmatch(r"\d{4}-\d{1,2}-\d{1,2}([ T].*)?", x):
        return "time"
    return "truth" if x.lower() in ("true", "false") else "text"


def guess_header(sample: str, delimiter: str, quote: str) -> bool:
    """The first row names columns if all its fields are texts; fields of texts throughout count as a header too."""
    rows = _rows(sample, delimiter, quote)
    return bool(rows) and all(_kind(x) == "text" for x in rows[0]) and len({x.strip().lower() for x in rows[0]}) == len(rows[0])


def _has_open_lines(spark: SparkSession, path: str, quote: str) -> bool:
    """Whether a quoted field may hold a line end: some line, of all of them, has an odd number of quotes."""
    if not quote:
        return False
    line, q = F.col("value"), F.lit(quote)
    quotes = F.length(line) - F.length(F.replace(line, q, F.lit("")))
    return not spark.read.text(path).filter(line.contains(quote)).filter(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, p: Mapping[str, Any]) -> DataFrame:
    """Dialect and header are guessed where they aren't given; types are inferred, hinted columns cast from text."""
    quote = p.get("quote")
    if quote is not None and len(str(quote)) != 1:
        raise FrameError(INVALID_ARGUMENT, "'quote' must be one character.")
    wanted = to_int(p.get("sample_size"))
    if wanted is not None and wanted < 1 and wanted != -1:
        raise FrameError(INVALID_ARGUMENT, "'sample_size' must be at least 1, or -1 for all rows.")
    hints = p.get("columns") or {}
    for name, kind in hints.items():
        if not re.fullmatch(r"[A-Za-z0-9_(), ]+", str(kind)):
            raise FrameError(INVALID_ARGUMENT, f"Type '{kind}' of column '{name}' is not valid.")
    sample = head(spark, path, SNIFFED)
    if len(sample) >= SNIFFED - 4:
        sample = sample[: sample.rfind("\n") + 1] or sample
    quote = str(quote) if quote is not None else '"'
    delimiter = str(p["delimiter"]) if p.get("delimiter") is not None else guess_delimiter(sample, quote)
    header = to_bool(p.get("header"))
    header = guess_header(sample, delimiter, quote) if header is None else header
    first = next(iter(_rows(sample, delimiter, quote)), [])
    options = {"sep": delimiter, "quote": quote, "escape": quote, "header": header, "multiLine": _has_open_lines(spark, path, quote), "nullValue": p.get("null_string") or "", "encoding": "UTF-8", "mode": "FAILFAST"}
    reader = spark.read.options(**options)
    names = [x if header and x else f"column{k}" for k, x in enumerate(first)]
    if not first:
        return spark.createDataFrame([], T.StructType([]))
    if wanted == -1:
        inferred = _infer_all(reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path), names)
    else:
        rows = csv.reader(lines(spark, path, (wanted or SAMPLE_ROWS) + header), delimiter=delimiter, quotechar=quote)
        inferred = _infer_sample(rows, len(names), header, str(p.get("null_string") or ""))
    own = {resolve(k, names): parse(str(v)) for k, v in hints.items()}
    for n, kind in own.items():
        inferred[names.index(n)] = kind
    typed = reader.schema(T.StructType([T.StructField(n, T.StringType() if n in own else k) for n, k in zip(names, inferred)])).csv(path)
    return project(typed, [(n, cast(quoted(n), T.StringType(), own[n]) if n in own else quoted(n)) for n in typed.columns])


#: From narrow to wide: type, pattern of its texts, and a further test.
_SHAPES: list[tuple[T.DataType, str, Callable[[str], Any]]] = [
    (T.LongType(), r"[+-]?[0-9]{1,19}", lambda x: -(2**63) <= int(x) < 2**63),
    (T.DoubleType(), r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", lambda x: True),
    (T.BooleanType(), r"(?i)true|false", lambda x: True),
    (T.DateType(), r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", lambda x: dt.date(*map(int, x.split("-")))),
    (T.TimestampNTZType(), r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?", lambda x: dt.date(*map(int, re.split("[ T]", x)[0].split("-")))),
]


def _fits(x: str, pattern: re.Pattern, test: Callable[[str], Any]) -> bool:
    try:
        return pattern.fullmatch(x) is not None and bool(test(x))
    except ValueError:
        return False


def _infer_sample(rows: Iterable[list[str]], width: int, header: bool, null: str) -> list[T.DataType]:
    """The narrowest type that all sampled values of each column fit, else text. The sample is bounded, so the driver looks at it."""
    shapes = [(re.compile(p), test) for _, p, test in _SHAPES]
    open_shapes, seen = [set(range(len(shapes))) for _ in range(width)], [False] * width
    for k, row in enumerate(rows):
        if header and k == 0:
            continue
        for i, x in enumerate(row[:width]):
            x = x.strip()
            if x and x != null:
                seen[i] = True
                open_shapes[i] = {s for s in open_shapes[i] if _fits(x, *shapes[s])} if open_shapes[i] else open_shapes[i]
    return [_SHAPES[min(o)][0] if o and s else T.StringType() for o, s in zip(open_shapes, seen)]


def _infer_all(texts: DataFrame, names: list[str]) -> list[T.DataType]:
    """As _infer_sample, of all rows, by one aggregation."""
    cells = [F.count_if(quoted(n).isNotNull() & ~(F.trim(quoted(n)).rlike(f"^({p})$") & F.trim(quoted(n)).try_cast(kind).isNotNull())).alias(f"x{i}_{k}") for i, n in enumerate(names) for k, (kind, p, _) in enumerate(_SHAPES)]
    found = texts.agg(*[F.count(quoted(n)).alias(f"n{i}") for i, n in enumerate(names)], *cells).first()
    return [next((kind for k, (kind, *_) in enumerate(_SHAPES) if found[f"n{i}"] and not found[f"x{i}_{k}"]), T.StringType()) for i in range(len(names))]


#: Larger files of one array aren't read as one text, and so keep keys beyond the sample in alphabetical order.
WHOLE_ARRAY = 1 << 30


def read_json(spark: SparkSession, path: str, p: Mapping[str, Any]) -> DataFrame:
    """An array of objects or one object a line; columns in the order in which the file names them."""
    sample = head(spark, path, SNIFFED)
    layout = p.get("format") or "auto"
    array = sample.lstrip().startswith("[") if layout == "auto" else layout == "array"
    df = spark.read.option("multiLine", array).option("primitivesAsString", False).json(path)
    order = _key_order(sample, array)
    if set(df.columns) - set(order):
        order = _all_keys(spark, path, array) or order
    names = sorted(df.columns, key=lambda c: order.index(c) if c in order else len(order))
    return df.select(*[quoted(c) for c in names]) if names else df


def _all_keys(spark: SparkSession, path: str, array: bool) -> list[str]:
    """Keys of all objects, by where they stand first. One row for each key comes to the driver."""
    if array:
        if size_of(spark, path) > WHOLE_ARRAY:
            return []
        objects = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("value"))
    else:
        objects = spark.read.text(path)
    keys = objects.select(F.monotonically_increasing_id().alias("row"), F.posexplode(F.json_object_keys("value")).alias("place", "key"))
    return [r["key"] for r in keys.groupBy("key").agg(F.min(F.struct("row", "place")).alias("at")).orderBy("at").collect()]


def _key_order(sample: str, array: bool) -> list[str]:
    """Keys of the first objects, as far as the sample holds whole ones."""
    decoder, order, text = json.JSONDecoder(), [], sample.lstrip()
    text = text[1:] if array else text
    for _ in range(100):
        text = text.lstrip(", \t\r\n")
        try:
            value, end = decoder.raw_decode(text)
        except ValueError:
            break
        order += [k for k in value if k not in order] if isinstance(value, dict) else []
        text = text[end:]
    return order


def read_parquet(spark: SparkSession, path: str, p: Mapping[str, Any]) -> DataFrame:
    """Files, globs or folders. Folders of the form k=v become columns, last, unless hive_partitioning is false."""
    hive, by_name = to_bool(p.get("hive_partitioning")), to_bool(p.get("union_by_name"))
    reader = spark.read.option("mergeSchema", bool(by_name))
    if is_remote(path):
        return (reader.option("recursiveFileLookup", True) if hive is False else reader).parquet(path)
    if is_glob(path):
        base = canonical(path)
        base = base[: base.rfind(os.sep, 0, re.search(r"[*?\[]", base).start())]
        names = sorted(n for n in glob.glob(local(path), recursive=True) if os.path.isfile(n) or not path.endswith("*"))
        names = names or [path]
        return (reader if hive is False else reader.option("basePath", base)).parquet(*names)
    if hive is False and os.path.isdir(local(path)):
        return reader.option("recursiveFileLookup", True).parquet(path)
    return reader.parquet(path)
