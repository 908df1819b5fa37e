"""What a plan really reads: files and columns of its scans, and their closure over the tables written on the way."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

#: While a recording is on: path of a written table to (path, column) of what its plan read.
_recordings: list[dict[str, set[tuple[str, str]]]] = []


def plain_path(path: str) -> str:
    """A path without the scheme of local files, as scans and writers may name one path in several ways."""
    return re.sub(r"^file:/+", "/", path).rstrip("/")


def reads(df: DataFrame) -> set[tuple[str, str]]:
    """(path, column) of each file scan of the physical plan, after pruning; a scan of no column (a count) names none: ''."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    out = set()
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName() != "FileSourceScanExec":
            continue
        paths, names = leaf.relation().location().rootPaths(), list(leaf.requiredSchema().fieldNames())
        out |= {(plain_path(paths.apply(i).toString()), n) for i in range(paths.size()) for n in names or [""]}
    return out


def written(path: str, df: DataFrame) -> None:
    """Notes what a table about to be written reads, if a recording is on."""
    if _recordings:
        found = reads(df)
        for r in _recordings:
            r[plain_path(path)] = found


@contextmanager
def recording() -> Iterator[dict[str, set[tuple[str, str]]]]:
    """The tables written within, and what their plans read."""
    seen: dict[str, set[tuple[str, str]]] = {}
    _recordings.append(seen)
    try:
        yield seen
    finally:
        _recordings[:] = [r for r in _recordings if r is not seen]


def closure(first: set[tuple[str, str]], seen: dict[str, set[tuple[str, str]]]) -> set[tuple[str, str]]:
    """The reads behind ``first`` that no recorded plan wrote: the columns of the inputs.

    What a written table read counts for each of its columns, as far as its own plan
    was pruned.
    """
    out, done, todo = set(), set(), set(first)
    while todo:
        path, column = todo.pop()
        if path not in seen:
            out.add((path, column))
        elif path not in done:
            done.add(path)
            todo |= seen[path]
    return out
