"""Metadata filters: a strict JSON tree, checked on the driver and compiled to a Column over a row's typed values."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# How deep and large a filter may be, bytes of a key, characters of a string.
DEPTH, NODES, OPERANDS, MEMBERS, KEY_BYTES, STRING_CHARS = 16, 256, 32, 64, 128, 1024
ORDERED = ("gt", "gte", "lt", "lte")
VALUES = "array<struct<key:string,ordinal:int,value_type:string,text_value:string,number_value:double,boolean_value:boolean>>"


class FilterError(ValueError):
    """A filter that isn't well formed; the message starts with its JSON path."""


@dataclass(frozen=True)
class Condition:
    key: str
    operator: str
    value: object


@dataclass(frozen=True)
class Group:
    operator: str  # and, or, not
    operands: tuple


def parse(text: str | dict):
    """A filter's tree."""
    node = json.loads(text) if isinstance(text, str) else text
    count = [0]

    def fail(path: str, why: str):
        raise FilterError(f"{path}: {why}")

    def only(n: dict, path: str, names: set[str]):
        if extra := set(n) - names:
            fail(path, f"unknown property {sorted(extra)[0]!r}")
        if lacking := names - set(n):
            fail(path, f"missing property {sorted(lacking)[0]!r}")

    def scalar(v: object, path: str):
        if not isinstance(v, (str, bool, int, float)):
            fail(path, "expected a string, number or boolean")
        if isinstance(v, float) and not math.isfinite(v):
            fail(path, "expected a finite number")
        if isinstance(v, str) and len(v) > STRING_CHARS:
            fail(path, f"more than {STRING_CHARS} characters")
        return v

    def walk(n: object, path: str, depth: int):
        count[0] += 1
        if count[0] > NODES:
            fail(path, f"more than {NODES} nodes")
        if depth > DEPTH:
            fail(path, f"deeper than {DEPTH}")
        if not isinstance(n, dict):
            fail(path, "expected an object")
        op = n.get("operator")
        if op in ("and", "or"):
            only(n, path, {"operator", "operands"})
            parts = n["operands"]
            if not isinstance(parts, list) or not 1 <= len(parts) <= OPERANDS:
                fail(f"{path}.operands", f"expected 1 to {OPERANDS} operands")
            return Group(op, tuple(walk(x, f"{path}.operands[{i}]", depth + 1) for i, x in enumerate(parts)))
        if op == "not":
            only(n, path, {"operator", "operand"})
            return Group(op, (walk(n["operand"], f"{path}.operand", depth + 1),))
        only(n, path, {"key", "operator", "value"})
        if not isinstance(n["key"], str) or not n["key"]:
            fail(f"{path}.key", "expected a key")
        if len(n["key"].encode()) > KEY_BYTES:
            fail(f"{path}.key", f"more than {KEY_BYTES} bytes")
        v, at = n["value"], f"{path}.value"
        if op == "exists":
            if not isinstance(v, bool):
                fail(at, "expected a boolean")
        elif op in ("in", "nin", "all"):
            if not isinstance(v, list) or not 1 <= len(v) <= MEMBERS:
                fail(at, f"expected 1 to {MEMBERS} values")
            if len({kind(scalar(x, f"{at}[{i}]")) for i, x in enumerate(v)}) > 1:
                fail(at, "values of different types")
            v = tuple(dict.fromkeys(v))
        elif op in ("eq", "ne", *ORDERED):
            scalar(v, at)
            if op in ORDERED and isinstance(v, bool):
                fail(at, "a boolean has no order")
        else:
            fail(f"{path}.operator", f"unknown operator {op!r}")
        return Condition(n["key"], op, v)

    return walk(node, "$", 1)


def kind(v: object) -> str:
    return "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"


def compile_filter(tree, values: Column) -> Column:
    """The tree as a predicate that is never null; values is of type VALUES."""
    if isinstance(tree, Group):
        parts = [compile_filter(x, values) for x in tree.operands]
        if tree.operator == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if tree.operator == "and" else out | p
        return out
    op, v = tree.operator, tree.value
    some = lambda test: F.coalesce(F.exists(values, lambda x: (x["key"] == tree.key) & test(x)), F.lit(False))
    if op == "exists":
        present = some(lambda x: F.lit(True))
        return present if v else ~present
    sample = v[0] if isinstance(v, tuple) else v
    k = kind(sample)
    field = {"string": "text_value", "number": "number_value", "boolean": "boolean_value"}[k]
    lit = lambda y: F.lit(float(y) if k == "number" else y)
    typed = lambda test: some(lambda x: (x["value_type"] == k) & test(x[field]))
    tests = {"gt": lambda c: c > lit(v), "gte": lambda c: c >= lit(v), "lt": lambda c: c < lit(v), "lte": lambda c: c <= lit(v)}
    if op in tests:
        return typed(tests[op])
    if op == "eq":
        return typed(lambda c: c == lit(v))
    if op == "ne":
        return typed(lambda c: F.lit(True)) & ~typed(lambda c: c == lit(v))
    if op == "in":
        return typed(lambda c: c.isin(*map(lit, v)))
    if op == "nin":
        return typed(lambda c: F.lit(True)) & ~typed(lambda c: c.isin(*map(lit, v)))
    out = F.lit(True)
    for y in v:
        out = out & typed(lambda c, y=y: c == lit(y))
    return out


def eligible(current_version: int) -> Column:
    """Rows whose metadata was extracted by the current version without an error."""
    return F.coalesce((F.col("extraction_version") == current_version) & F.col("extraction_error").isNull(), F.lit(False))
