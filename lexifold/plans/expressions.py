"""Stage expressions: a small Python-like language compiled to Columns.

A name is a field if the table has it, else a string of its own letters; a
leading $ says field in any case. Only the listed operators and functions
exist, so an expression can do nothing but compute a value of its row.
"""

from __future__ import annotations

import ast
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import has

_ARITHMETIC = {ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod}
_COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


class Compiler:
    def __init__(self, df: DataFrame, names: dict | None = None):
        self.types = dict(df.dtypes)
        self.names = names or {}  # variables that a loop binds

    def column(self, text: str) -> Column:
        try:
            tree = ast.parse(re.sub(r"\$(\w+)", r"__field_\1", text.strip()), mode="eval")
        except SyntaxError as e:
            raise ValueError(f"not an expression: {text!r}") from e
        return self.visit(tree.body)[0]

    def condition(self, text: str) -> Column:
        """As a predicate: null, empty and zero are false."""
        tree = ast.parse(re.sub(r"\$(\w+)", r"__field_\1", text.strip()), mode="eval")
        return self.truth(*self.visit(tree.body))

    def truth(self, c: Column, kind: str) -> Column:
        if kind == "boolean":
            test = c
        elif kind == "string":
            test = c != ""
        elif kind.startswith(("array", "map")):
            test = F.size(c) > 0
        elif kind == "null":
            test = F.lit(False)
        elif kind in ("timestamp", "timestamp_ntz", "date"):
            test = c.isNotNull()
        else:
            test = c != 0
        return F.coalesce(test, F.lit(False))

    def visit(self, n):
        """(column, type name); numbers are all "number"."""
        f = getattr(self, "on_" + type(n).__name__, None)
        if f is None:
            raise ValueError(f"{type(n).__name__} is not allowed in an expression")
        return f(n)

    def on_Constant(self, n):
        v = n.value
        kind = "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"
        if kind == "string" and not isinstance(v, str):
            raise ValueError(f"{v!r} is not allowed in an expression")
        return F.lit(v), kind

    def on_Name(self, n):
        name = n.id.removeprefix("__field_")
        if name in self.names:
            return self.names[name]
        if name in ("true", "false"):
            return F.lit(name == "true"), "boolean"
        if name in ("null", "none"):
            return F.lit(None), "null"
        if name in self.types:
            kind = self.types[name]
            return F.col(f"`{name}`"), "number" if kind in ("int", "bigint", "double", "float", "smallint", "tinyint") or kind.startswith("decimal") else kind
        if n.id.startswith("__field_"):
            if "extdata" in self.types:
                return F.col("extdata")[name], "string"
            raise ValueError(f"no field {name}")
        return F.lit(name), "string"

    def on_BoolOp(self, n):
        parts = [self.truth(*self.visit(v)) for v in n.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(n.op, ast.And) else out | p
        return out, "boolean"

    def on_UnaryOp(self, n):
        c, kind = self.visit(n.operand)
        if isinstance(n.op, ast.Not):
            return ~self.truth(c, kind), "boolean"
        return (-c if isinstance(n.op, ast.USub) else c), kind

    def on_BinOp(self, n):
        (a, ka), (b, kb) = self.visit(n.left), self.visit(n.right)
        if isinstance(n.op, ast.Add):
            if ka.startswith("array") or kb.startswith("array") or "string" in (ka, kb):
                return F.concat(a, b), ka if ka != "null" else kb
            return a + b, "number"
        if isinstance(n.op, ast.FloorDiv):
            return F.floor(a / b), "number"
        if isinstance(n.op, ast.Pow):
            return F.pow(a, b), "number"
        if type(n.op) not in _ARITHMETIC:
            raise ValueError(f"{type(n.op).__name__} is not allowed in an expression")
        return _ARITHMETIC[type(n.op)](a, b), "number"

    def on_Compare(self, n):
        out, (left, kind) = None, self.visit(n.left)
        for op, right in zip(n.ops, n.comparators):
            c, k = self.visit(right)
            if isinstance(op, (ast.Eq, ast.Is)):
                test = left.eqNullSafe(c)
            elif isinstance(op, (ast.NotEq, ast.IsNot)):
                test = ~left.eqNullSafe(c)
            elif isinstance(op, (ast.In, ast.NotIn)):
                test = has(c, left) if k.startswith("array") else F.contains(c, left)
                test = F.coalesce(test, F.lit(False))
                test = ~test if isinstance(op, ast.NotIn) else test
            else:
                test = F.coalesce(_COMPARE[type(op)](left, c), F.lit(False))
            out, left, kind = test if out is None else out & test, c, k
        return out, "boolean"

    def on_IfExp(self, n):
        (a, k), (b, _) = self.visit(n.body), self.visit(n.orelse)
        return F.when(self.truth(*self.visit(n.test)), a).otherwise(b), k

    def on_List(self, n):
        parts = [self.visit(e) for e in n.elts]
        kind = parts[0][1] if parts else "string"
        return (F.array(*[c for c, _ in parts]) if parts else F.array().cast("array<string>")), f"array<{kind}>"

    on_Tuple = on_List

    def on_Dict(self, n):
        pairs = [x for k, v in zip(n.keys, n.values) for x in (self.visit(k)[0], self.visit(v)[0])]
        return F.create_map(*pairs), "map"

    def on_Subscript(self, n):
        c, kind = self.visit(n.value)
        if isinstance(n.slice, ast.Slice):
            lo = self.visit(n.slice.lower)[0] if n.slice.lower else F.lit(0)
            hi = self.visit(n.slice.upper)[0] if n.slice.upper else F.length(c) if kind == "string" else F.size(c)
            return (F.substring(c, (lo + 1).cast("int"), (hi - lo).cast("int")) if kind == "string" else F.slice(c, (lo + 1).cast("int"), (hi - lo).cast("int"))), kind
        i, _ = self.visit(n.slice)
        if kind.startswith("map") or kind == "map":
            return F.try_element_at(c, i), "string"
        if kind == "string":
            return F.substring(c, (i + 1).cast("int"), F.lit(1)), "string"
        return F.get(c, i.cast("int")), kind[6:-1] if kind.startswith("array<") else "string"

    def on_Call(self, n):
        args = [self.visit(a) for a in n.args]
        if isinstance(n.func, ast.Attribute):
            args = [self.visit(n.func.value), *args]
            name = n.func.attr
        elif isinstance(n.func, ast.Name):
            name = n.func.id
        else:
            raise ValueError("only named functions can be called")
        c, kind = args[0] if args else (None, "")
        rest = [a for a, _ in args[1:]]
        number = "number"
        table = {
            "len": lambda: (F.coalesce(F.length(c) if kind == "string" else F.size(c), F.lit(0)), number),
            "lower": lambda: (F.lower(c), "string"), "upper": lambda: (F.upper(c), "string"), "strip": lambda: (F.trim(c), "string"),
            "int": lambda: (F.expr("try_cast(NULL AS BIGINT)") if kind == "null" else c.try_cast("bigint"), number), "float": lambda: (c.try_cast("double"), number),
            "str": lambda: (c.cast("string"), "string"), "abs": lambda: (F.abs(c), number), "round": lambda: (F.round(c, *[int(a.value) for a in n.args[1:]]), number),
            "startswith": lambda: (F.coalesce(F.startswith(c, rest[0]), F.lit(False)), "boolean"),
            "endswith": lambda: (F.coalesce(F.endswith(c, rest[0]), F.lit(False)), "boolean"),
            "replace": lambda: (F.replace(c, rest[0], rest[1]), "string"), "split": lambda: (F.split(c, _quoted(n.args[-1])), "array<string>"),
            "join": lambda: (F.array_join(rest[0], n.func.value.value), "string"), "min": lambda: (F.least(*[a for a, _ in args]), kind), "max": lambda: (F.greatest(*[a for a, _ in args]), kind),
        }
        if name not in table:
            raise ValueError(f"no function {name}")
        return table[name]()


def _quoted(n):
    return r"\Q" + n.value + r"\E" if isinstance(n, ast.Constant) else r"\s+"


def compile_value(df: DataFrame, text: str, names=None) -> Column:
    return Compiler(df, names).column(text)


def compile_condition(df: DataFrame, text: str, names=None) -> Column:
    return Compiler(df, names).condition(text)
