"""Boolean text query (FLT-14) compiled to a Spark Column.

The query string is parsed on the driver (it is a parameter, not data)
into the same right-nested tree the source evaluates: ``left [op right]``
with OR, AND, NOT or implicit AND, no precedence. Leaves are terms or
``"phrases"``, optionally prefixed by ``-`` (negation) or ``+`` and
optionally scoped by ``field:``. Text that does not parse becomes one
literal term.

Leaf semantics: case-insensitive substring test. The ``to:`` field tests
the leading ``@name`` tokens of the text; text that does not start with
``@`` never matches, negated or not (the source behaves this way).
Deliberate difference: NOT is honoured (the source evaluates it as AND).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Term:
    term: str
    field: str | None = None
    negate: bool = False


@dataclass
class Node:
    left: object
    op: str | None = None          # "OR", "AND", "NOT", "<implicit>"
    right: object | None = None


_TOKEN = re.compile(r'\s*(\(|\)|[-+]?(?:[A-Za-z_]+:)?"[^"]*"|[^\s()]+)')


def _tokens(q: str) -> list[str]:
    out, pos = [], 0
    q = q.strip()
    while pos < len(q):
        m = _TOKEN.match(q, pos)
        if not m:
            raise ValueError(f"cannot tokenise at {pos}")
        out.append(m.group(1))
        pos = m.end()
    return out


def _leaf(tok: str) -> Term:
    neg = tok.startswith("-")
    if tok[:1] in "-+":
        tok = tok[1:]
    field = None
    m = re.match(r"([A-Za-z_]+):(.+)$", tok)
    if m:
        field, tok = m.group(1), m.group(2)
    if tok.startswith('"') and tok.endswith('"') and len(tok) >= 2:
        tok = tok[1:-1]
    if not tok:
        raise ValueError("empty term")
    return Term(tok, field, neg)


def parse(q: str):
    """Parse a query; falls back to one literal term on any error."""
    try:
        toks = _tokens(q)
        node, rest = _parse_seq(toks)
        if rest:
            raise ValueError("unbalanced")
        return node
    except (ValueError, IndexError):
        return Node(Term(q), "<implicit>")


def _parse_seq(toks):
    if not toks:
        raise ValueError("empty")
    left, toks = _parse_atom(toks)
    if not toks or toks[0] == ")":
        return Node(left), toks
    op = "<implicit>"
    if toks[0] in ("OR", "AND", "NOT", "||", "&&"):
        op = {"||": "OR", "&&": "AND"}.get(toks[0], toks[0])
        toks = toks[1:]
    right, toks = _parse_seq(toks)
    return Node(left, op, right), toks


def _parse_atom(toks):
    t = toks[0]
    if t == "(":
        node, rest = _parse_seq(toks[1:])
        if not rest or rest[0] != ")":
            raise ValueError("missing )")
        return node, rest[1:]
    if t == ")":
        raise ValueError("unexpected )")
    return _leaf(t), toks[1:]


def leading_names(text: Column) -> Column:
    """The run of ``@name`` tokens at the start of the text (lower-cased)."""
    run = F.regexp_extract(F.lower(text), r"^((?:@[^ ]*(?: |$))*)", 1)
    return F.split(run, " ")


def _leaf_col(text: Column, t: Term) -> Column:
    low = F.lower(text)
    term = t.term.lower()
    if t.field == "to":
        hit = F.array_contains(leading_names(text), "@" + term)
        return F.when(low.startswith("@"), ~hit if t.negate else hit).otherwise(F.lit(False))
    hit = F.contains(low, F.lit(term))
    return ~hit if t.negate else hit


def compile_query(text, q) -> Column:
    """Compile a query string (or parsed tree) against a text column."""
    text = F.col(text) if isinstance(text, str) else text
    tree = parse(q) if isinstance(q, str) else q
    return F.coalesce(_compile(text, tree), F.lit(False))


def _compile(text: Column, n) -> Column:
    if isinstance(n, Term):
        return _leaf_col(text, n)
    left = _compile(text, n.left)
    if n.right is None:
        return left
    right = _compile(text, n.right)
    if n.op == "OR":
        return left | right
    if n.op == "NOT":
        return left & ~right
    return left & right


def evaluate(text: str | None, q) -> bool:
    """Plain-Python evaluator of the same semantics (used by tests)."""
    tree = parse(q) if isinstance(q, str) else q
    return bool(_eval(text or "", tree))


def _eval(text: str, n) -> bool:
    if isinstance(n, Term):
        low, term = text.lower(), n.term.lower()
        if n.field == "to":
            if not low.startswith("@"):
                return False
            names = re.match(r"^((?:@[^ ]*(?: |$))*)", low).group(1).split(" ")
            hit = ("@" + term) in names
            return (not hit) if n.negate else hit
        hit = term in low
        return (not hit) if n.negate else hit
    left = _eval(text, n.left)
    if n.right is None:
        return left
    right = _eval(text, n.right)
    if n.op == "OR":
        return left or right
    if n.op == "NOT":
        return left and not right
    return left and right
