"""Relations that follow from type expressions: one row for each type that an expression names.

An expression is walked with a stack of the spans still to be read, so nesting of
any depth is no limit. Names of fields and parameters, lengths of arrays and tags are
no types. An expression is text as written or tokens joined by blanks; statement
ends inside it are semicolons or line ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.semantics import BUILTIN_TYPES

TOKEN = re.compile(r"\"(?:\\.|[^\"\\])*\"|`[^`]*`|'(?:\\.|[^'\\])+'|[^\W\d]\w*|\d[\w.]*|\.\.\.|<-|\n|[^\s\w]")
OPEN, CLOSE = "([{", ")]}"
SCHEMA = "owner string, ordinal int, kind string, member string, target string, structural boolean, arguments array<string>"


def _is_name(token: str) -> bool:
    return token[0].isalpha() or token[0] == "_"


class Expression:
    """Tokens of a type expression, with the place that closes each bracket."""

    def __init__(self, text: str):
        tokens = TOKEN.findall(text)
        self.tokens = [";" if t == "\n" else t for t in tokens]
        self.match, opened = {}, []
        for k, t in enumerate(self.tokens):
            if t in OPEN:
                opened.append(k)
            elif t in CLOSE and opened:
                self.match[opened.pop()] = k

    def text(self, low: int, high: int) -> str:
        """The tokens as one text, with a blank between words, around bars, after commas, semicolons and channels' marks."""
        out = ""
        for a, b in pairwise([*self.tokens[low:high], ""]):
            out += a + (" " if b and ((a[-1].isalnum() or a == "_") and _is_name(b) or a in (",", ";", "|") or b == "|" or (a == ")" and _is_name(b))) else "")
        return out

    def skip(self, k: int) -> int:
        return self.match.get(k, len(self.tokens)) + 1 if self.tokens[k] in OPEN else k + 1

    def split(self, low: int, high: int, at: str) -> list[tuple[int, int]]:
        """The spans between marks outside brackets; empty ones are left out."""
        spans, begin, k = [], low, low
        while k < high:
            if self.tokens[k] == at:
                spans.append((begin, k))
                begin = k + 1
            k = self.skip(k)
        return [(a, b) for a, b in [*spans, (begin, high)] if a < b]

    def is_named(self, low: int, high: int) -> bool:
        """Does a name come before the type in a field or parameter?"""
        t = self.tokens
        if high - low < 2 or not _is_name(t[low]) or t[low] in ("map", "chan", "func", "struct", "interface"):
            return False
        after = t[low + 1]
        if after == "[":  # a name before an array, or a generic type alone
            return self.match.get(low + 1, high) + 1 < high
        return after not in (".", "|") and after[0] not in "\"`"

    def fields(self, low: int, high: int) -> Iterator[tuple[list[str], int, int]]:
        """Names and the type's span of each field of a struct, without tags."""
        for a, b in self.split(low, high, ";"):
            while b > a and self.tokens[b - 1][0] in "\"`":
                b -= 1
            names, k = [], a
            while k + 1 < b and _is_name(self.tokens[k]) and self.tokens[k + 1] == ",":
                names.append(self.tokens[k])
                k += 2
            if names or self.is_named(k, b):
                yield [*names, self.tokens[k]], k + 1, b
            elif a < b:
                yield [], a, b

    def parameters(self, low: int, high: int) -> Iterator[tuple[int, int]]:
        """Spans of the types of a parameter list; names that share a type give one."""
        parts = self.split(low, high, ",")
        if any(self.is_named(a, b) for a, b in parts):
            parts = [(a + 1, b) for a, b in parts if self.is_named(a, b)]
        yield from parts

    def signature(self, k: int, high: int) -> list[tuple[int, int]]:
        """Spans of the types of a signature, whose parameters open at k."""
        if k >= high or self.tokens[k] != "(":
            return []
        end = self.match.get(k, high)
        out = list(self.parameters(k + 1, end))
        if end + 1 < high:
            whole = self.tokens[end + 1] == "(" and self.match.get(end + 1) == high - 1
            out += list(self.parameters(end + 2, high - 1)) if whole else [(end + 1, high)]
        return out

    def bare(self, low: int, high: int) -> tuple[int, int]:
        """The span without stars and brackets around it."""
        while low < high and (self.tokens[low] == "*" or (self.tokens[low] == "(" and self.match.get(low) == high - 1)):
            low, high = (low + 1, high) if self.tokens[low] == "*" else (low + 1, high - 1)
        return low, high

    def target(self, low: int, high: int) -> tuple[str, bool, list[str]]:
        """The type that a span names, whether it is none but a structure, and its type arguments."""
        low, high = self.bare(low, high)
        t, dotted = self.tokens, low + 2 < high and self.tokens[low + 1] == "."
        end = low + 3 if dotted else low + 1
        named = low < high and _is_name(t[low]) and t[low] not in ("map", "chan", "func", "struct", "interface")
        if named and end < high and t[end] == "[" and self.match.get(end) == high - 1:
            return self.text(low, end), False, [self.text(*x) for x in self.split(end + 1, high - 1, ",")]
        if named and end == high:
            return self.text(low, end), False, []
        return "type:" + self.text(low, high), True, []

    def uses(self, low: int, high: int) -> Iterator[tuple[str, str, bool, list[str]]]:
        """(kind, target, structural, arguments) of all types in a span, uses and instantiates, from left to right."""
        stack, t = [(low, high)], self.tokens
        while stack:
            low, high = stack.pop()
            low, high = self.bare(low, high)
            if low >= high:
                continue
            parts = self.split(low, high, "|")
            first = t[low]
            if len(parts) > 1:
                stack += reversed(parts)
            elif first in ("~", "...", "<-", "chan"):
                stack.append((low + 1, high))
            elif first == "[":
                stack.append((self.skip(low), high))
            elif first == "map":
                stack += [(self.skip(low + 1), high), (low + 2, self.match.get(low + 1, high))]
            elif first == "func":
                stack += reversed(self.signature(low + 1, high))
            elif first == "struct":
                stack += reversed([(a, b) for _, a, b in self.fields(low + 2, high - 1)])
            elif first == "interface":
                inner = []
                for a, b in self.split(low + 2, high - 1, ";"):
                    method = b - a > 1 and _is_name(t[a]) and t[a + 1] == "("
                    inner += self.signature(a + 1, b) if method else [(a, b)]
                stack += reversed(inner)
            elif _is_name(first):
                name, structural, arguments = self.target(low, high)
                if structural:
                    continue
                end = low + 3 if low + 1 < high and t[low + 1] == "." else low + 1
                if end < high:
                    yield "instantiates", name, False, arguments
                    stack += reversed(self.split(end + 1, high - 1, ","))
                yield "uses", self.text(low, end), False, []


def relations(text: str, alias: bool) -> Iterator[tuple[str, str | None, str, bool, list[str]]]:
    """(kind, member, target, structural, arguments) of a declared type's expression.

    alias_of for the whole of an alias; embeds and constrains for what a struct
    or an interface is made of; uses and instantiates for all that is named, with
    the field or method that names it.
    """
    e = Expression(text)
    t, whole = e.tokens, (0, len(e.tokens))
    if not t:
        return
    if alias:
        yield "alias_of", None, *e.target(*whole)
    if t[0] == "struct" and t[-1] == "}":
        for names, a, b in e.fields(2, len(t) - 1):
            if names:
                yield from ((kind, n, *rest) for n in names if n != "_" for kind, *rest in e.uses(a, b))
            else:
                name = e.target(a, b)
                yield from ((kind, name[0].rpartition(".")[2], *rest) for kind, *rest in e.uses(a, b))
                yield "embeds", None, *name
    elif t[0] == "interface" and t[-1] == "}":
        for a, b in e.split(2, len(t) - 1, ";"):
            if b - a > 1 and _is_name(t[a]) and t[a + 1] == "(":
                yield from ((kind, t[a], *rest) for span in e.signature(a + 1, b) for kind, *rest in e.uses(*span))
                continue
            name, structural, arguments = e.target(a, b)
            starred = t[a] == "*"
            yield "constrains" if structural or starred or name in BUILTIN_TYPES else "embeds", None, name, structural, arguments
            yield from ((kind, None, *rest) for kind, *rest in e.uses(a, b))
    else:
        yield from ((kind, None, *rest) for kind, *rest in e.uses(*whole))


def expression_relations(types: DataFrame) -> DataFrame:
    """(owner, ordinal, kind, member, target, structural, arguments) of types (owner, alias, expression); null expressions give no row."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(owner, k, kind, *rest) for owner, alias, text in batch.itertuples(index=False) for k, (kind, *rest) in enumerate(relations(text or "", bool(alias)))]
            yield pd.DataFrame(rows, columns=["owner", "ordinal", "kind", "member", "target", "structural", "arguments"])

    return types.select(F.col("owner").cast("string"), "alias", "expression").mapInPandas(made, SCHEMA)
