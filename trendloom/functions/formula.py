"""Trend formulas, parsed once and never evaluated as Python: to Spark columns, to numpy with derivatives, and to power series."""

from __future__ import annotations

import ast

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS = ("sin", "cos", "exp", "sqrt", "log", "abs")
_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "**"}


class FormulaError(ValueError):
    pass


class Formula:
    """A formula in `var` and parameters (all other names, sorted by name)."""

    def __init__(self, text: str, var: str = "t"):
        self.text, self.var = text, var
        try:
            self.tree = self._read(ast.parse(text, mode="eval").body)
        except SyntaxError as e:
            raise FormulaError(f"not a formula: {text}") from e
        names: set[str] = set()
        self._names(self.tree, names)
        self.params = sorted(names - {var})

    def _read(self, node: ast.AST) -> tuple:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return ("num", float(node.value))
        if isinstance(node, ast.Name):
            return ("name", node.id)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            inner = self._read(node.operand)
            return ("*", ("num", -1.0), inner) if isinstance(node.op, ast.USub) else inner
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return (_BINARY[type(node.op)], self._read(node.left), self._read(node.right))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and len(node.args) == 1 and not node.keywords:
            return (node.func.id, self._read(node.args[0]))
        raise FormulaError(f"not allowed in a formula: {ast.dump(node)[:80]}")

    def _names(self, tree: tuple, out: set[str]) -> None:
        if tree[0] == "name":
            out.add(tree[1])
        elif tree[0] != "num":
            for x in tree[1:]:
                self._names(x, out)

    def shape(self) -> tuple:
        """The formula's tree with the variable and the parameters (in the order of their names) by number."""
        number = {p: i for i, p in enumerate(self.params)}

        def go(x: tuple) -> tuple:
            if x[0] == "name":
                return ("var",) if x[1] == self.var else ("param", number[x[1]])
            return x if x[0] == "num" else (x[0], *map(go, x[1:]))

        return go(self.tree)

    def column(self, t: Column, params: dict[str, Column | float]) -> Column:
        """The formula as a Spark expression."""

        def go(x: tuple) -> Column:
            if x[0] == "num":
                return F.lit(x[1])
            if x[0] == "name":
                if x[1] == self.var:
                    return t
                p = params[x[1]]
                return p if isinstance(p, Column) else F.lit(float(p))
            if x[0] in FUNCTIONS:
                return getattr(F, x[0])(go(x[1]))
            a, b = go(x[1]), go(x[2])
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "**": lambda: F.pow(a, b)}[x[0]]()

        return go(self.tree)

    def values(self, t: np.ndarray, params: np.ndarray | list[float], derivatives: bool = False):
        """Values at t; with derivatives, also the matrix of derivatives by parameter."""
        t = np.asarray(t, float)
        index = {p: i for i, p in enumerate(self.params)}
        m = len(self.params)

        def go(x: tuple) -> tuple[np.ndarray, np.ndarray]:
            if x[0] == "num":
                return np.full_like(t, x[1]), np.zeros((len(t), m))
            if x[0] == "name":
                d = np.zeros((len(t), m))
                if x[1] == self.var:
                    return t, d
                d[:, index[x[1]]] = 1
                return np.full_like(t, params[index[x[1]]]), d
            a, da = go(x[1])
            if x[0] in FUNCTIONS:
                v = {"sin": np.sin, "cos": np.cos, "exp": np.exp, "sqrt": np.sqrt, "log": np.log, "abs": np.abs}[x[0]](a)
                slope = {"sin": lambda: np.cos(a), "cos": lambda: -np.sin(a), "exp": lambda: v, "sqrt": lambda: 0.5 / v, "log": lambda: 1 / a, "abs": lambda: np.sign(a)}[x[0]]()
                return v, da * slope[:, None]
            b, db = go(x[2])
            if x[0] == "+":
                return a + b, da + db
            if x[0] == "-":
                return a - b, da - db
            if x[0] == "*":
                return a * b, da * b[:, None] + db * a[:, None]
            if x[0] == "/":
                return a / b, (da - db * (a / b)[:, None]) / b[:, None]
            v = np.power(a, b)
            d = da * (b * np.power(a, b - 1))[:, None]
            if np.any(db):
                d = d + db * (v * np.log(np.where(a > 0, a, 1)))[:, None]
            return v, d

        with np.errstate(all="ignore"):
            v, d = go(self.tree)
        return (v, d) if derivatives else v

    def series(self, params: np.ndarray | list[float], order: int) -> np.ndarray:
        """The first `order` coefficients of the power series in var at 0."""
        index = {p: i for i, p in enumerate(self.params)}

        def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.convolve(a, b)[:order]

        def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            c = np.zeros(order)
            for k in range(order):
                c[k] = (a[k] - sum(b[j] * c[k - j] for j in range(1, k + 1))) / b[0]
            return c

        def exp(a: np.ndarray) -> np.ndarray:
            c = np.zeros(order)
            c[0] = np.exp(a[0])
            for k in range(1, order):
                c[k] = sum(j * a[j] * c[k - j] for j in range(1, k + 1)) / k
            return c

        def wave(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            s, c = np.zeros(order), np.zeros(order)
            s[0], c[0] = np.sin(a[0]), np.cos(a[0])
            for k in range(1, order):
                s[k] = sum(j * a[j] * c[k - j] for j in range(1, k + 1)) / k
                c[k] = -sum(j * a[j] * s[k - j] for j in range(1, k + 1)) / k
            return s, c

        def log(a: np.ndarray) -> np.ndarray:
            c = np.zeros(order)
            c[0] = np.log(a[0])
            for k in range(1, order):
                c[k] = (a[k] - sum(j * c[j] * a[k - j] for j in range(1, k)) / k) / a[0]
            return c

        def power(a: np.ndarray, p: float) -> np.ndarray:
            if float(p).is_integer() and p >= 0:
                c = np.zeros(order)
                c[0] = 1
                for _ in range(int(p)):
                    c = times(c, a)
                return c
            return exp(p * log(a))

        def go(x: tuple) -> np.ndarray:
            c = np.zeros(order)
            if x[0] == "num":
                c[0] = x[1]
                return c
            if x[0] == "name":
                if x[1] == self.var:
                    if order > 1:
                        c[1] = 1
                else:
                    c[0] = params[index[x[1]]]
                return c
            a = go(x[1])
            if x[0] == "exp":
                return exp(a)
            if x[0] in ("sin", "cos"):
                return wave(a)[x[0] == "cos"]
            if x[0] == "log":
                return log(a)
            if x[0] == "sqrt":
                return power(a, 0.5)
            if x[0] == "abs":
                return a if a[0] >= 0 else -a
            b = go(x[2])
            if x[0] in "+-":
                return a + b if x[0] == "+" else a - b
            if x[0] == "*":
                return times(a, b)
            if x[0] == "/":
                return over(a, b)
            return power(a, b[0])

        with np.errstate(all="ignore"):
            return go(self.tree)

    def filled(self, params: np.ndarray | list[float]) -> str:
        """The formula's text with numbers for its parameters."""
        number = dict(zip(self.params, params))

        def go(x: tuple) -> str:
            if x[0] == "num":
                return repr(x[1])
            if x[0] == "name":
                return self.var if x[1] == self.var else repr(float(number[x[1]]))
            if x[0] in FUNCTIONS:
                return f"{x[0]}({go(x[1])})"
            return f"({go(x[1])} {x[0]} {go(x[2])})"

        return go(self.tree)

    def orders(self, order: int) -> list[int]:
        """Powers of var that the series has for parameters in general position."""
        found = np.zeros(order, bool)
        for seed in range(3):
            c = self.series(np.random.default_rng(seed).uniform(0.5, 1.5, len(self.params)), order)
            found |= np.abs(c) > 1e-12
        return np.flatnonzero(found).tolist()


def polynomial(rank: int, var: str = "t", name: str = "c") -> Formula:
    """name0 + name1*t + ... with `rank` coefficients."""
    return Formula(" + ".join([f"{name}0"] + [f"{name}{k}*{var}**{k}" for k in range(1, rank)]), var)
