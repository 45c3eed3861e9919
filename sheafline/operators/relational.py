"""Selection, projection, renaming, cross products, joins and duplicates."""

from __future__ import annotations

import operator
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.rewrites import equality, wide_type
from ..relation import Field, Relation

#: The comparison signs and what they mean.
COMPARE = {
    "<": operator.lt,
    ">": operator.gt,
    "==": operator.eq,
    "!=": operator.ne,
    "<=": operator.le,
    ">=": operator.ge,
    "=>": operator.ge,
    "=<": operator.le,
}


def select(rel: Relation, left: str, op: str, right: int | float | str, column: bool = False) -> Relation:
    """Rows for which ``left op right`` holds; ``right`` is a value, or a column's name.

    A null on either side never compares. An empty table stays empty.
    """
    other = rel.col(right) if column else F.lit(right)
    return replace(rel, df=rel.df.where(COMPARE[op](rel.col(left), other)))


def project(rel: Relation, names: list[str]) -> Relation:
    """The named columns in that order; rows and repeated names stay."""
    if not names:
        raise ValueError("nothing to project")
    return rel.keep([rel.field(n) for n in names])


def rename(rel: Relation, old: str, new: str) -> Relation:
    if rel.has(new):
        raise ValueError(f"column {new} exists")
    first = rel.field(old)
    return replace(rel, fields=tuple(replace(f, name=new) if f is first else f for f in rel.fields))


def cross(left: Relation, right: Relation, left_name: str, right_name: str) -> Relation:
    """Every row of ``left`` with every row of ``right``, the left one's order outside.

    Only names both tables have get their table's name before them; a table
    crossed with itself gets 1 and 2 after its name.
    """
    same = left_name == right_name
    one, two = (f"{left_name}1", f"{right_name}2") if same else (left_name, right_name)
    right = right.renewed()
    clash = set(left.names) & set(right.names)
    mark = lambda f, t: replace(f, name=f"{t}_{f.name}", origin=t) if f.name in clash else replace(f, origin=t)
    fields = tuple(mark(f, one) for f in left.fields) + tuple(mark(f, two) for f in right.fields)
    return Relation(left.df.crossJoin(right.df), fields, left.order + right.order)


@dataclass(frozen=True)
class On:
    """``left == right``, or ``left sign right == constant``; names are (table, column)."""

    left: tuple[str, str]
    right: tuple[str, str]
    sign: str = ""
    constant: int = 0


def join(
    left: Relation,
    right: Relation,
    left_name: str,
    right_name: str,
    on: On,
    where: tuple[tuple[str, str], str, int] | None = None,
    columns: list[tuple[str, str]] | None = None,
) -> Relation:
    """Inner join on an equality, with one optional comparison and projection.

    An arithmetic condition is rewritten so that each side is a key of one
    table, ``a + b == k`` as ``a == k - b``; so it hashes instead of comparing
    all pairs, and is widened so that it cannot overflow. In a self-join the
    first name means the left copy, the second the right one, and in WHERE and
    PROJECT the left one. Null keys never join.
    """
    self_join = left_name == right_name
    right = right.renewed()
    sides = {left_name: left} if self_join else {left_name: left, right_name: right}

    def find(token: tuple[str, str]) -> Field:
        return sides[token[0]].field(token[1])

    if self_join:
        a, b, flipped = left.field(on.left[1]), right.field(on.right[1]), False
    else:
        if {on.left[0], on.right[0]} != {left_name, right_name}:
            raise KeyError("the condition must name both tables")
        flipped = on.left[0] == right_name
        a, b = (find(on.right), find(on.left)) if flipped else (find(on.left), find(on.right))
    x, y = F.col(a.physical), F.col(b.physical)
    kinds = [dict(left.df.dtypes)[a.physical], dict(right.df.dtypes)[b.physical]]
    cond = equality(x, y, on.sign, on.constant, flipped, wide_type(kinds, on.constant))
    df = left.df.join(right.df, cond, "inner")
    if where:
        token, op, value = where
        df = df.where(COMPARE[op](F.col(find(token).physical), F.lit(value)))
    fields = tuple(replace(f, origin=left_name) for f in left.fields) + tuple(replace(f, origin=right_name) for f in right.fields)
    out = Relation(df, fields, left.order + right.order)
    if columns:
        out = out.keep([replace(find(c), origin=c[0]) for c in columns])
    return out


def distinct(rel: Relation) -> Relation:
    """Each row once, in the order of first occurrence; nulls are equal here."""
    keys = list(dict.fromkeys(f.physical for f in rel.fields))
    first = F.min(F.struct(*[F.col(c) if up else _negative(rel, c) for c, up in rel.order])).alias("__first")
    df = rel.df.groupBy(*keys).agg(first)
    return Relation(df, rel.fields, (("__first", True),))


def _negative(rel: Relation, c: str) -> Column:
    """A value that sorts ascending as ``c`` does descending."""
    kind = dict(rel.df.dtypes)[c]
    if kind in ("string", "binary", "boolean", "date") or kind.startswith(("timestamp", "array", "struct")):
        raise TypeError(f"number the rows before removing duplicates: order key of type {kind} runs downwards")
    return -F.col(c)
