"""The keyword language: words, ^prefixes, & or blank for and, | for or, parentheses."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import has, has_prefix


@dataclass(frozen=True)
class Word:
    text: str
    prefix: bool = False


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


_TOKEN = re.compile(r"\s*([|&()]|[^\s|&()]+)")


def parse(query: str):
    """The tree of a query; None for an empty one. Errors are ValueErrors that name the place."""
    tokens = [(m[1].lower(), m.start(1)) for m in _TOKEN.finditer(query or "")]
    if not tokens:
        return None
    at = 0

    def peek():
        return tokens[at][0] if at < len(tokens) else None

    def fail(what):
        where = tokens[at][1] if at < len(tokens) else len(query)
        raise ValueError(f"{what} at {where} in {query!r}")

    def either():
        nonlocal at
        parts = [both()]
        while peek() == "|":
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both():
        nonlocal at
        parts = [atom()]
        while peek() not in (None, "|", ")"):
            if peek() == "&":
                at += 1
            parts.append(atom())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def atom():
        nonlocal at
        t = peek()
        if t is None or t in "|&)":
            fail("a word or ( is missing")
        at += 1
        if t == "(":
            inner = either()
            if peek() != ")":
                fail(") is missing")
            at += 1
            return inner
        return Word(t.strip("^%"), t.startswith("^"))

    tree = either()
    if at < len(tokens):
        fail(f"{peek()} is out of place")
    return tree


def compile_tree(tree, keywords="keywords") -> Column:
    """The predicate of a tree over an array column; never null."""
    if tree is None:
        return F.lit(True)
    if isinstance(tree, Word):
        return has_prefix(keywords, tree.text) if tree.prefix else has(keywords, tree.text)
    parts = [compile_tree(p, keywords) for p in tree.parts]
    return reduce(lambda a, b: a & b if isinstance(tree, And) else a | b, parts)


def matches(query: str, keywords="keywords") -> Column:
    return compile_tree(parse(query), keywords)


def evaluate(tree, keywords) -> bool:
    """The same over a Python list."""
    if tree is None:
        return True
    if isinstance(tree, Word):
        found = [k for k in keywords or [] if k is not None]
        return any(k.startswith(tree.text) for k in found) if tree.prefix else tree.text in found
    return (all if isinstance(tree, And) else any)(evaluate(p, keywords) for p in tree.parts)
