"""Deeply nested records turned into flat tables that keep parent and place (problem 3).

Each JSON text is parsed as a stream of tokens into triples: the path from the root, the value, and
the ordinal of every step; typed columns give the same triples. Steps are array elements or object
members. Elements, numbered members and the members of a map are repeated ancestors: the path down
to the last of them names a child table, its ordinals the row and, less the last, the row's parent.
Every triple below becomes a member of that row, so that nothing of a record is left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = "struct<name:string,no:bigint,element:boolean>"
TRIPLE = f"steps array<{STEP}>, value string, kind string"

_TOKEN = re.compile(
    r"[ \t\r\n]*(?:(?P<mark>[{}\[\],:])"
    r'|(?P<text>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")'
    r"|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)(?![\w.+-])"
    r"|(?P<word>true|false|null)(?!\w))"
)
_DOTTED = re.compile(r"[^.]\.[^\W\d][^.]*\Z")
_BLANK = re.compile(r"[ \t\r\n]*\Z")

Step = tuple[str, int, bool]
Triple = tuple[list[Step], str | None, str]


class Malformed(ValueError):
    """The text is not valid JSON."""


def _text(token: str) -> str:
    value = json.loads(token) if "\\" in token else token[1:-1]
    return value.encode("utf-8", "replace").decode("utf-8")


def parse(text: str, split_dots: bool = True) -> Iterator[Triple]:
    """Triples of one JSON text, leaf by leaf; Malformed if it isn't valid.

    Leaves are scalars, nulls and empty containers. A text that is itself a JSON string holding JSON
    is parsed again. With ``split_dots`` the key ``a.b`` is the member b of the member a, unless what
    follows the last dot is no name (``gcc-4.9``). There is no recursion, so depth is bounded by memory alone.
    """
    stack: list[list] = []  # [is array, steps below the root, members so far, steps of the pending member]
    at, state, found = 0, "value", []
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            if state == "end" and _BLANK.match(text, at):
                break
            raise Malformed(f"at {at}")
        at = m.end()
        mark, kind = m["mark"], m.lastgroup
        if state == "end":
            raise Malformed(f"text behind the end at {at}")
        if state in ("key", "key or end"):
            if kind == "text":
                top = stack[-1]
                key = _text(m["text"])
                parts = key.rsplit(".", 1) if split_dots and _DOTTED.search(key) else [key]
                top[2] += 1
                top[3] = [*top[1], *((p, int(p) if p.isascii() and p.isdigit() and len(p) < 19 else top[2], False) for p in parts)]
                state = "colon"
                continue
            if mark == "}" and state == "key or end":
                top = stack.pop()
                found.append((top[1], None, "object"))
            else:
                raise Malformed(f"at {at}")
        elif state == "colon":
            if mark != ":":
                raise Malformed(f"at {at}")
            state = "value"
            continue
        elif state == "after":
            top = stack[-1]
            if mark == ",":
                state = "value" if top[0] else "key"
                continue
            if mark != ("]" if top[0] else "}"):
                raise Malformed(f"at {at}")
            stack.pop()
        elif mark == "]" and state == "value or end":
            top = stack.pop()
            found.append((top[1], None, "array"))
        else:  # a value
            steps: list[Step] = []
            if stack:
                top = stack[-1]
                if top[0]:
                    top[2] += 1
                    top[3] = [*top[1], ("", top[2], True)]
                steps = top[3]
            if mark in ("{", "["):
                stack.append([mark == "[", steps, 0, None])
                state = "value or end" if mark == "[" else "key or end"
                continue
            if mark:
                raise Malformed(f"at {at}")
            value = m[kind]
            found.append((steps, _text(value) if kind == "text" else None if value == "null" else value, {"text": "string", "word": "null" if value == "null" else "boolean"}.get(kind, kind)))
        state = "after" if stack else "end"
    if len(found) == 1 and not found[0][0] and found[0][2] == "string" and found[0][1].lstrip()[:1] in ("{", "[", '"'):
        yield from parse(found[0][1], split_dots)
    else:
        yield from found


def triples(records: DataFrame, record_id: str, text: str, split_dots: bool = True) -> DataFrame:
    """record_id, steps, value, kind of every leaf of every record's JSON text.

    Null, empty and malformed texts give nothing, and a record is read whole before any of its
    triples counts. Repeated rows count once.
    """
    kind = dict(records.dtypes)[record_id]
    step = pa.struct([("name", pa.string()), ("no", pa.int64()), ("element", pa.bool_())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, steps, values, kinds = [], [], [], []
            for k, record in enumerate(part.column(1).to_pylist()):
                if not record:
                    continue
                try:
                    found = list(parse(record, split_dots))
                except Malformed:
                    continue
                rows += [k] * len(found)
                steps += [[dict(zip(("name", "no", "element"), s)) for s in f[0]] for f in found]
                values += [f[1] for f in found]
                kinds += [f[2] for f in found]
            ids = part.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(steps, pa.list_(step)), pa.array(values, pa.string()), pa.array(kinds, pa.string())], ["record_id", "steps", "value", "kind"])

    wanted = records.select(F.col(record_id).alias("record_id"), F.col(text).alias("text")).where("record_id is not null and text is not null").distinct()
    return wanted.mapInArrow(run, f"record_id {kind}, {TRIPLE}")


def typed_triples(records: DataFrame, record_id: str, column: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    """The triples of a typed column, an array of structs: all members of its elements, or those named.

    Null elements keep their place and give no triple; a null member gives one of kind null.
    """
    element = records.schema[column].dataType.elementType
    step = lambda name, no, is_element: F.struct(F.lit(name).alias("name"), no.cast("bigint").alias("no"), F.lit(is_element).alias("element"))
    placed = records.where(F.col(record_id).isNotNull()).select(F.col(record_id).alias("record_id"), F.posexplode(column).alias("at", "e")).where("e is not null")
    each = []
    for k, f in enumerate(element.fields):
        if fields is None or f.name in fields:
            value = F.col("e")[f.name]
            text = value.cast("string") if not f.dataType.typeName() in ("array", "struct", "map") else F.to_json(value)
            kind = {"string": "string", "boolean": "boolean"}.get(f.dataType.typeName(), "number")
            steps = F.array(step(column, F.lit(1), False), step("", F.col("at") + 1, True), step(f.name, F.lit(k + 1), False))
            each.append(F.struct(steps.alias("steps"), text.alias("value"), F.when(value.isNull(), "null").otherwise(kind).alias("kind")))
    return placed.select("record_id", F.explode(F.array(*each)).alias("x")).select("record_id", "x.*")


def child_tables(found: DataFrame, wrappers: tuple[str, ...] = (), fields: tuple[str, ...] = ()) -> DataFrame:
    """All child tables of the triples, one row for each repeated ancestor of a record.

    record_id; ``path``, the names down to the ancestor with a star for each repeated step; ``row``, its
    ordinals, in reading order; ``parent``, the ``row`` of the ancestor above it (empty at the top);
    ``depth``, how many of its steps repeat; ``top`` and ``top_key``, row and name of its outermost
    ancestor; ``key``, its own name (null for elements); ``members``, every triple below it as
    (field, value, kind); ``plain``, the text of a row that is one itself; and a column for each of ``fields``, its text (the greatest, should a member repeat).

    The members of the record, below the ``wrappers``, are a map, so its keys repeat.
    """
    numbered = lambda s: s["element"] | s["name"].rlike("^[0-9]+$")
    first = F.array_position(F.transform("steps", lambda s: s["element"] | ~s["name"].isin(*wrappers)), F.lit(True)).cast("int")
    placed = found.withColumn("first", F.nullif(first, F.lit(0))).withColumn("at", F.filter(F.transform("steps", lambda s, i: F.when(numbered(s) | (i + 1 == F.col("first")), i + 1)), lambda x: x.isNotNull()))
    last = F.coalesce(F.element_at("at", F.when(F.size("at") > 0, -1)), F.lit(0))
    above = F.coalesce(F.element_at("at", F.when(F.size("at") > 1, -2)), F.lit(0))
    ordinals = lambda n: F.transform(F.slice("steps", F.lit(1), n), lambda s: s["no"])
    own = F.element_at("steps", F.when(F.size("at") > 0, last))
    named = placed.withColumn("last", last).select(
        "record_id",
        "value",
        "kind",
        ordinals(F.col("last")).alias("row"),
        ordinals(above).alias("parent"),
        ordinals(F.coalesce("first", F.lit(0))).alias("top"),
        F.element_at("steps", F.col("first"))["name"].alias("top_key"),
        F.size("at").alias("depth"),
        F.when(~own["element"], own["name"]).alias("key"),
        F.array_join(F.transform(F.slice("steps", F.lit(1), F.col("last")), lambda s, i: F.when(F.array_contains("at", i + 1), "*").otherwise(s["name"])), ".").alias("path"),
        F.array_join(F.transform(F.slice("steps", F.col("last") + 1, F.size("steps")), lambda s: s["name"]), ".").alias("field"),
    )
    text = lambda f, name: F.max(F.when((F.col("field") == f) & (F.col("kind") == "string"), F.col("value"))).alias(name)
    return named.groupBy("record_id", "path", "row").agg(
        *(F.first(c).alias(c) for c in ("parent", "top", "top_key", "depth", "key")), F.array_sort(F.collect_list(F.struct("field", "value", "kind"))).alias("members"), text("", "plain"), *(text(f, f) for f in fields)
    )


WRAPPERS = ("branches", "open", "closed")


def branch_tables(status: DataFrame) -> DataFrame:
    """The child tables of the backports of every status record: branches, their notes, the notes' replies."""
    found = triples(status, "status_id", "backports").repartition("record_id")
    return child_tables(found, WRAPPERS, ("branch", "branch_commit", "branch_commit.sha", "notes", "notes.text", "text"))


def backport_rows(status: DataFrame) -> DataFrame:
    """record_id, branch, item_no, note, branch_commit of the backports of every status record.

    Notes are counted from 1 per branch in reading order: numbered members by number, and a reply
    behind the note that it answers, wherever the text stands in its object. A branch without notes
    has one row with item_no 0. A branch named by several objects of one record is one branch.
    Nothing gathered is larger than a record.
    """
    rows = branch_tables(status)
    below = F.array_join(F.slice(F.split("path", r"\."), F.size("top") + 1, F.size(F.split("path", r"\."))), ".")
    own = F.col("depth") == 1
    note = F.when(own, F.coalesce(F.col("notes"), F.col("`notes.text`"))).when(below.rlike(r"^notes(\.|$)"), F.coalesce("text", "plain"))
    rows = rows.where("depth > 0").withColumn("note", note)
    some = F.length(F.trim("note")) > 0
    branch = rows.groupBy("record_id", "top").agg(
        F.max(F.when(own, F.trim("branch"))).alias("given"),
        F.max("top_key").alias("key"),
        F.max(F.when(own, F.trim(F.coalesce("branch_commit", F.col("`branch_commit.sha`"))))).alias("branch_commit"),
        F.array_sort(F.collect_list(F.when(some, F.struct("row", "note")))).alias("notes"),
    )
    named = branch.select("record_id", "top", F.coalesce("given", F.when(F.col("key") != "", F.col("key"))).alias("branch"), F.coalesce("branch_commit", F.lit("")).alias("branch_commit"), "notes").where("branch is not null")
    whole = named.groupBy("record_id", "branch").agg(F.max("branch_commit").alias("branch_commit"), F.array_sort(F.collect_list(F.struct("top", "notes"))).alias("parts"))
    notes = F.flatten(F.transform("parts", lambda p: F.transform(p["notes"], lambda n: n["note"])))
    each = whole.select("record_id", "branch", "branch_commit", F.posexplode_outer(notes).alias("at", "note"))
    return each.select("record_id", "branch", F.coalesce(F.col("at") + 1, F.lit(0)).cast("bigint").alias("item_no"), "note", "branch_commit")


def match_rows(findings: DataFrame, fields: tuple[str, ...] = ("project", "relpath")) -> DataFrame:
    """record_id, no and the named fields of every non-null match of every finding, pivoted from triples.

    Null and empty arrays give no row; repeated rows count once.
    """
    found = child_tables(typed_triples(findings, "finding_id", "matches", fields), ("matches",), fields)
    return found.select("record_id", F.element_at("row", -1).alias("no"), *fields)


def child_rows(status: DataFrame, findings: DataFrame) -> DataFrame:
    """record_table, record_id, child_key, item_no, child_value of both tables' nested records."""
    notes = backport_rows(status).select(F.lit("pr_status").alias("record_table"), "record_id", F.col("branch").alias("child_key"), "item_no", F.col("branch_commit").alias("child_value"))
    matches = match_rows(findings).select(F.lit("source_findings").alias("record_table"), "record_id", F.col("project").alias("child_key"), F.col("no").alias("item_no"), F.col("relpath").alias("child_value"))
    return notes.unionByName(matches)
