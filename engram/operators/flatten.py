"""Deeply nested JSON texts as flat, related child tables.

A first pass infers the merged schema of a collection: the set of generic array paths (``tool_graph[].args.edits[]``)
whose elements are objects, with the fields seen there and the type that all their values fit. A second pass explodes
each array level of that schema recursively, record by record, into child rows that carry the surrogate key of their
parent and their ordinal; ``child_tables`` gives one typed table for each path. The schema is the only thing gathered
to the driver; it grows with the number of distinct paths, not with the rows. Texts that hold no record are reported
by ``unread``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from json.decoder import scanstring
from json.scanner import NUMBER_RE

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.text import norm_id
from engram.sources.tables import newest


_SPACE = re.compile(r"[ \t\n\r]*")
_WORDS = {"null": None, "true": True, "false": False, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def _deep_loads(text: str) -> object:
    """json.loads for texts nested deeper than it reads: a stack of open objects and arrays instead of recursion."""
    skip = lambda i: _SPACE.match(text, i).end()
    top: list = []
    stack: list[list | dict] = [top]
    keys: list[str | None] = [None]  # beside each open one, the key that waits for its value
    i, fresh, done = skip(0), False, False  # fresh: just opened; done: just after a value
    while not (done and len(stack) == 1):
        at, c = stack[-1], text[i : i + 1]
        if len(stack) > 1 and c == ("}" if isinstance(at, dict) else "]") and (fresh or done):
            stack.pop()
            keys.pop()
            i, fresh, done = skip(i + 1), False, True
            continue
        if done:
            if c != ",":
                raise ValueError(i)
            i = skip(i + 1)
        if isinstance(at, dict):
            if text[i : i + 1] != '"':
                raise ValueError(i)
            keys[-1], i = scanstring(text, i + 1, True)
            i = skip(i)
            if text[i : i + 1] != ":":
                raise ValueError(i)
            i = skip(i + 1)
        c, fresh, done = text[i : i + 1], False, True
        if c in ("{", "["):
            value: object = {} if c == "{" else []
            i, fresh, done = i + 1, True, False
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        elif word := next((w for w in _WORDS if text.startswith(w, i)), None):
            value, i = _WORDS[word], i + len(word)
        elif m := NUMBER_RE.match(text, i):
            value, i = json.loads(m.group()), m.end()
        else:
            raise ValueError(i)
        if isinstance(at, dict):
            at[keys[-1]] = value
        else:
            at.append(value)
        if fresh:
            stack.append(value)
            keys.append(None)
        i = skip(i)
    if i != len(text):
        raise ValueError(i)
    return top[0]


def _loads(text: str) -> object:
    try:
        return json.loads(text)
    except RecursionError:
        return _deep_loads(text)


def _dumps(value: object) -> str:
    """Compact JSON, at any depth."""
    one = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    try:
        return one(value)
    except RecursionError:
        pass
    out, todo = [], [(False, value)]  # (whether it is text already, text or value)
    while todo:
        ready, x = todo.pop()
        if ready:
            out.append(x)
        elif isinstance(x, (dict, list)):
            named = isinstance(x, dict)
            todo.append((True, "}" if named else "]"))
            for n, (k, v) in reversed(list(enumerate(x.items() if named else ((None, v) for v in x)))):
                todo += [(False, v), (True, ("," if n else "") + (f"{one(k)}:" if named else ""))]
            out.append("{" if named else "[")
        else:
            out.append(one(x))
    return "".join(out)


def read_record(text: str | None) -> dict | None:
    """The record of a text: a JSON object, or a JSON string that holds one (however often wrapped); else None."""
    while isinstance(text, str):
        try:
            text = _loads(text)
        except ValueError:
            return None
    return text if isinstance(text, dict) else None


def _arrays(node: object, at: str, path: str) -> Iterator[tuple[str, str, list]]:
    """The arrays inside an object or array, nested objects looked through: generic path, path, elements."""
    if isinstance(node, dict):
        todo = [(node, at, path)]
        while todo:
            o, g, p = todo.pop()
            for k, v in o.items():
                gk, pk = (f"{g}.{k}", f"{p}.{k}") if g else (k, k)
                if isinstance(v, dict):
                    todo.append((v, gk, pk))
                elif isinstance(v, list):
                    yield f"{gk}[]", pk, v
    elif isinstance(node, list):
        yield f"{at}[]", path, node


def _walk(record: dict, known: frozenset[str] | None) -> Iterator[tuple[str, str, str, int, object]]:
    """Every element of every array: generic path, path, parent's path, ordinal, element."""
    todo: list[tuple[object, str, str, str]] = [(record, "", "", "")]
    while todo:
        node, at, path, owner = todo.pop()
        for g, p, items in _arrays(node, at, path):
            if known is not None and g not in known:
                continue
            for i, v in enumerate(items):
                here = f"{p}[{i}]"
                if isinstance(v, dict):
                    yield g, here, owner, i, v
                    todo.append((v, g, here, here))
                elif isinstance(v, list):
                    todo.append((v, g, here, owner))


def _lifted(record: dict, singles: frozenset[str]) -> dict:
    """A lone object where a top-level array of objects belongs is that array's element 0."""
    return {k: [v] if k in singles and isinstance(v, dict) else v for k, v in record.items()}


def record_texts(text: Column, singles: Iterable[str]) -> Column:
    """Each text's record as plain JSON: unwrapped, lone objects lifted, only objects in the arrays of ``singles``; null without a record."""
    lone = frozenset(singles)

    def read(text: str | None) -> str | None:
        if (r := read_record(text)) is None:
            return None
        objects = lambda k, v: [x for x in v if isinstance(x, dict)] if k in lone and isinstance(v, list) else v
        return _dumps({k: objects(k, v) for k, v in _lifted(r, lone).items()})

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(read)

    return plain(text.cast("string"))


def why_unread(text: str | None) -> str | None:
    """Why a text holds no record: 'null', 'blank', 'not JSON' (incomplete texts too) or 'no object'; None if it does."""
    if text is None:
        return "null"
    if not text.strip():
        return "blank"
    while isinstance(text, str):
        try:
            text = _loads(text)
        except ValueError:
            return "not JSON"
    return None if isinstance(text, dict) else "no object"


def unread(df: DataFrame, key_col: str, text_col: str, order_col: str | None = None) -> DataFrame:
    """(record_id, reason) of the records that ``flatten`` can't read; all others have their rows there."""
    rows = newest(df, norm_id(key_col), [order_col] if order_col else [], [text_col, key_col], "norm_key", wide=True)

    @F.pandas_udf("string")
    def reason(texts: pd.Series) -> pd.Series:
        return texts.map(why_unread)

    return rows.select(F.col(key_col).alias("record_id"), reason(F.col(text_col).cast("string")).alias("reason")).where(F.col("reason").isNotNull())


def with_text(json_text: Column, key: str, value: Column) -> Column:
    """A record's JSON with a text as the value of a top-level key; texts that hold no record stay as they are."""

    @F.pandas_udf("string")
    def put(texts: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for t, v in zip(texts, values):
            r = read_record(t)
            out.append(t if r is None else _dumps({**r, key: v}))
        return pd.Series(out, dtype=object)

    return put(json_text.cast("string"), value.cast("string"))


def _kind(value: object) -> str:
    """The type of a leaf; objects and arrays stay JSON."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "long" if -(1 << 63) <= value < 1 << 63 else "double"
    return "double" if isinstance(value, float) else "string" if isinstance(value, str) else "json"


def _fits(kinds: set[str]) -> str:
    """The one type that all these fit: text and other leaves together are text, JSON takes all."""
    kinds = kinds - {"null"}
    if len(kinds) == 1:
        return next(iter(kinds))
    return "double" if kinds == {"long", "double"} else "json" if "json" in kinds else "string"


def infer_schema(texts: DataFrame, text_col: str, singles: Iterable[str] = ()) -> dict[str, dict[str, str]]:
    """The merged schema: each generic path of an array with objects, with the fields of those objects and their types.

    Types are boolean, long, double, string, and json for objects, arrays and mixtures with them; a field that is always
    null is a string. Arrays of arrays on the way to an object are included. Only distinct (path, field, type) triples
    reach the driver.
    """
    lone = frozenset(singles)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, str, str]] = set()
        for pdf in batches:
            new = set()
            for text in pdf["text"]:
                if (r := read_record(text)) is not None:
                    for g, _, _, _, v in _walk(_lifted(r, lone), None):
                        new.add((g, "", ""))
                        new.update((g, k, _kind(x)) for k, x in v.items())
            new -= seen
            seen |= new
            yield pd.DataFrame(sorted(new), columns=["path", "field", "type"])

    found = texts.select(F.col(text_col).cast("string").alias("text")).mapInPandas(scan, "path string, field string, type string").distinct().collect()
    kinds: dict[str, dict[str, set[str]]] = {}
    for path, field, kind in sorted((r["path"], r["field"], r["type"]) for r in found):
        fields = kinds.setdefault(path, {})
        if kind:
            fields.setdefault(field, set()).add(kind)
    schema = {path: {f: _fits(ks) for f, ks in fields.items()} for path, fields in kinds.items()}
    for path in list(schema):  # arrays that hold only arrays lie on the way
        while path.endswith("[][]"):
            path = path[:-2]
            schema.setdefault(path, {})
    return schema


def flatten(
    df: DataFrame,
    key_col: str,
    text_col: str,
    order_col: str | None = None,
    singles: Iterable[str] = (),
    tables: Iterable[str] | None = None,
    carry_order: bool = False,
) -> DataFrame:
    """One row for each JSON object that is an element of an array, at any depth, of each record's text.

    ``row_id``/``parent_id`` are surrogate keys of 128 bits from the record's key and the element's path (the parent of a
    first-level element is its record, ``record_key``), ``child_table`` is the generic path, ``fields`` the object as JSON.
    ``tables``: only these child tables, without an inference pass. ``carry_order`` keeps ``order_col``. Rows of one key (compared without case and
    outer white space) are one row: that with the greatest ``order_col``. Null and blank keys, null, empty and
    incomplete texts, and texts that are not objects yield nothing. Other columns of ``df`` are ignored.
    """
    lone = frozenset(singles)
    rows = newest(df, norm_id(key_col), [order_col] if order_col else [], [text_col, key_col], "norm_key", wide=True).select(
        F.col(key_col).alias("key"), F.col(text_col).cast("string").alias("text"), *([F.col(order_col).alias("carried")] if carry_order else [])
    )
    known = frozenset(infer_schema(df, text_col, lone)) if tables is None else frozenset(tables)

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, at = [], []
            for n, (key, text) in enumerate(zip(pdf["key"], pdf["text"])):
                if (r := read_record(text)) is not None:
                    for g, path, owner, i, v in _walk(_lifted(r, lone), known):
                        out.append((key, g, path, owner, i, _dumps(v)))
                        at.append(n)
            made = pd.DataFrame(out, columns=["record_id", "child_table", "path", "parent_path", "ordinal", "fields"])
            yield made.assign(**{order_col: pdf["carried"].iloc[at].reset_index(drop=True)}) if carry_order else made

    extra = [rows.schema["carried"].dataType.simpleString()] if carry_order else []
    nodes = rows.mapInPandas(
        explode, "record_id string, child_table string, path string, parent_path string, ordinal int, fields string" + "".join(f", `{order_col}` {x}" for x in extra)
    )
    return nodes.select(
        "record_id",
        record_key(F.col("record_id"), F.col("path")).alias("row_id"),
        record_key(F.col("record_id"), F.col("parent_path")).alias("parent_id"),
        "child_table",
        "path",
        "ordinal",
        "fields",
        *([order_col] if carry_order else []),
    )


def record_key(record_id: Column, path: Column | None = None) -> Column:
    """The surrogate key of a record, or of the element at a path of it."""
    return F.md5(F.concat(record_id, F.lit("\x1f"), F.lit("") if path is None else path))


def child_table(nodes: DataFrame, name: str, fields: Iterable[str] | dict[str, str]) -> DataFrame:
    """One child table of ``flatten``: surrogate keys, ordinal and the given fields as columns f_... (null where absent).

    ``fields``: names, for text columns, or names with types as of ``infer_schema``; a value that does not fit is null.
    """
    types = fields if isinstance(fields, dict) else dict.fromkeys(fields, "string")
    keys = ["record_id", "row_id", "parent_id", "ordinal"]
    own = nodes.where(F.col("child_table") == name)
    if not types:
        return own.select(*keys)
    read = own.select(*keys, F.json_tuple("fields", *types).alias(*[f"f_{x}" for x in types]))
    typed = [F.col(f"`f_{x}`").try_cast("string" if t == "json" else t).alias(f"f_{x}") for x, t in types.items()]
    return read.select(*keys, *typed)


def child_tables(df: DataFrame, key_col: str, text_col: str, order_col: str | None = None, singles: Iterable[str] = ()) -> dict[str, DataFrame]:
    """A typed table for each array path of the collection's merged schema, related by row_id and parent_id."""
    singles = tuple(singles)
    schema = infer_schema(df, text_col, singles)
    nodes = flatten(df, key_col, text_col, order_col, singles, tables=schema)
    return {name: child_table(nodes, name, fields) for name, fields in schema.items()}
