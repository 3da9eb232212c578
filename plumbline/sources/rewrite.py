"""Source texts read for one question, or rewritten by the places of their syntax."""

from __future__ import annotations

import ast
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from plumbline.session import ship

LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")


class Unparsable(ValueError):
    """A rewritten text that no longer parses; measuring it would give no facts and look like a result."""


def _keys(node: ast.AST) -> set[str]:
    """String keys that an expression gives a mapping by itself: a display, or dict() with keywords."""
    if isinstance(node, ast.Dict):
        return {k.value for k in node.keys if isinstance(k, ast.Constant) and isinstance(k.value, str)}
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "dict":
        return {k.arg for k in node.keywords if k.arg}
    return set()


def returned_keys(text: str, function: str, aliases: bool = False) -> list[str]:
    """Sorted keys of the mappings that a function returns.

    Of a returned expression its own keys; of a returned name those of what is
    assigned to it, of items set on it and of mappings that update() takes. With
    `aliases` a name assigned from another name also has that one's keys. Other
    mappings in the function say nothing. No function of that name, or a text
    that doesn't parse, has no keys.
    """
    try:
        found = next(n for n in ast.walk(ast.parse(text)) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef) and n.name == function)
    except (SyntaxError, ValueError, RecursionError, StopIteration):
        return []
    keys: set[str] = set()
    names: set[str] = set()
    given: dict[str, set[str]] = {}
    same: dict[str, set[str]] = {}
    for n in ast.walk(found):
        match n:
            case ast.Return(value=ast.Name(id=name)):
                names.add(name)
            case ast.Return(value=ast.expr() as value):
                keys |= _keys(value)
            case ast.Assign(targets=targets, value=value):
                for target in targets:
                    match target:
                        case ast.Name(id=name):
                            given.setdefault(name, set()).update(_keys(value))
                            if isinstance(value, ast.Name):
                                same.setdefault(name, set()).add(value.id)
                        case ast.Subscript(value=ast.Name(id=name), slice=ast.Constant(value=str(key))):
                            given.setdefault(name, set()).add(key)
            case ast.Call(func=ast.Attribute(value=ast.Name(id=name), attr="update"), args=args):
                for arg in args:
                    given.setdefault(name, set()).update(_keys(arg))
    todo, seen = list(names), set()
    while todo:
        name = todo.pop()
        if name not in seen:
            seen.add(name)
            keys |= given.get(name, set())
            todo += same.get(name, ()) if aliases else ()
    return sorted(keys)


def _guards(tree: ast.AST) -> Iterator[ast.If]:
    """The outermost `if TYPE_CHECKING` statements; what stands inside one goes with it."""
    todo: list[ast.AST] = [tree]
    while todo:
        at = todo.pop()
        if isinstance(at, ast.If) and "TYPE_CHECKING" in (getattr(at.test, "id", None), getattr(at.test, "attr", None)):
            yield at
        else:
            todo += ast.iter_child_nodes(at)


def strip_type_checking(text: str) -> tuple[str, bool]:
    """(text with every `if TYPE_CHECKING` statement as one `pass`, whether there was any).

    The statement's first line keeps its indent and its line break, its other
    lines keep their breaks alone, so that all lines stay where they are; every
    other character stays. A text that doesn't parse comes back as it is. Twice
    is the same as once.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return text, False
    guards = list(_guards(tree))
    if not guards:
        return text, False
    lines = [m for m in LINE.findall(text) if m]
    for g in guards:
        for k in range(g.lineno - 1, g.end_lineno):
            body = lines[k].rstrip("\r\n")
            indent = body[: len(body) - len(body.lstrip(" \t\f"))] if k == g.lineno - 1 else None
            lines[k] = ("" if indent is None else indent + "pass") + lines[k][len(body) :]
    out = "".join(lines)
    try:
        ast.parse(out)
    except SyntaxError as e:
        raise Unparsable(f"a stripped text no longer parses: {e}") from e
    return out, True


def _each_text(files: DataFrame, work, columns: str) -> DataFrame:
    """files with columns of work(text); a null text counts as empty."""
    ship(files.sparkSession)
    names = [c.split()[0] for c in columns.split(", ")]
    kept = [c for c in files.columns if c not in names]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name in kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(10_000)
        for pdf in batches:
            made = pd.DataFrame([work(t if isinstance(t, str) else "") for t in pdf["text"]], columns=names, index=pdf.index)
            yield pd.concat([pdf[kept], made], axis=1)

    return files.mapInPandas(run, f"{ddl}, {columns}")


def without_type_checking(files: DataFrame) -> DataFrame:
    """files (..., text) for a reading of run-time dependencies alone, with `stripped`; see `strip_type_checking`."""
    return _each_text(files, strip_type_checking, "text string, stripped boolean")


def returned_mappings(files: DataFrame, function: str, aliases: bool = False) -> DataFrame:
    """files (..., text) with `keys`, the keys of the mapping that the function returns, and `shape`, the keys joined by bars."""

    def work(text: str) -> tuple:
        keys = returned_keys(text, function, aliases)
        return keys, "|".join(keys)

    return _each_text(files, work, "keys array<string>, shape string")
