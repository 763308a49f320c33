"""Predicate strings over metadata: checked token by token before Spark parses them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.errors import error

_token = re.compile(r"""\s*(?:(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<operator>==|!=|<>|<=|>=|=|<|>|\(|\)|,|-))""")
WORDS = {"and", "or", "not", "in", "between", "like", "is", "null", "true", "false"}
FUNCTIONS = {"array_contains"}


def _literal(token: str) -> str:
    """A string token as SQL that can mean nothing but its characters, which are given as bytes in hex; a backslash takes the next
    character as it is."""
    plain = re.sub(r"\\(.)", r"\1", token[1:-1], flags=re.DOTALL)
    return f"cast(X'{plain.encode().hex()}' as string)"


def parse(predicate: str, columns: list[str]) -> Column:
    """Columns, literals, comparisons, AND, OR, NOT, IN, BETWEEN, LIKE, IS NULL and array_contains; nothing else."""
    known, at, out = {c.lower(): c for c in columns}, 0, []
    text = predicate.rstrip()
    if not text:
        raise error("Predicate Error", "the predicate is empty")
    while at < len(text):
        m = _token.match(text, at)
        if not m:
            raise error("Predicate Error", f"unexpected character at {at}")
        if m["operator"] == "-" and not re.match(r"\s*\d", text[m.end() :]):
            raise error("Predicate Error", f"a number is expected after - at {at}")
        word = m["word"]
        if word is None:
            out.append(_literal(m["string"]) if m["string"] else m[m.lastgroup])
        elif word.lower() in WORDS:
            out.append(word)
        elif word.lower() in FUNCTIONS and text[m.end() :].lstrip().startswith("("):
            out.append(word)
        elif word.lower() in known:
            out.append(f"`{known[word.lower()]}`")
        else:
            raise error("Predicate Error", f"unknown name {word}")
        at = m.end()
    return F.expr(" ".join(out))
