"""Array columns as vectors, and Gram sums as plain aggregate columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v
    )


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v * v)


def difference(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a - b)


def zeros(dim: int) -> Column:
    return F.array(*[F.lit(0.0)] * dim)


def plus(terms: Sequence[str]) -> str:
    """SQL text of the sum of the terms, in order."""
    return "(" + " + ".join(terms) + ")"


def summed(columns: Sequence[str]) -> list[Column]:
    """Sum already summed columns again under their own names."""
    return [F.expr(f"sum({c}) AS {c}") for c in columns]


class Gram:
    """Sums ``x x'`` and ``reward x`` of a list of features under fixed column names.

    The sums are ordinary columns, so they combine on the map side and stay in generated code.
    Features are SQL text.
    """

    def __init__(self, name: str, dim: int) -> None:
        self.name, self.dim = name, dim
        self.pairs = [(i, j) for i in range(dim) for j in range(i, dim)]

    def xx(self, i: int, j: int) -> str:
        return f"{self.name}_xx_{min(i, j)}_{max(i, j)}"

    def rx(self, i: int) -> str:
        return f"{self.name}_rx_{i}"

    @property
    def columns(self) -> list[str]:
        return [self.xx(i, j) for i, j in self.pairs] + [self.rx(i) for i in range(self.dim)]

    def sums(self, features: Sequence[str], reward: str = "reward") -> list[Column]:
        return [
            F.expr(f"sum({features[i]} * {features[j]}) AS {self.xx(i, j)}") for i, j in self.pairs
        ] + [F.expr(f"sum({reward} * {features[i]}) AS {self.rx(i)}") for i in range(self.dim)]

    def totals(self) -> list[Column]:
        return summed(self.columns)

    def xx_array(self) -> Column:
        d = range(self.dim)
        return F.expr("array(" + ", ".join(self.xx(i, j) for i in d for j in d) + ")")

    def rx_array(self) -> Column:
        return F.expr("array(" + ", ".join(self.rx(i) for i in range(self.dim)) + ")")

    def residual_sums(self, param: str) -> list[str]:
        """``-2 (rx - xx param)``, the least-squares estimating function, from the sums."""
        d = range(self.dim)
        return [
            f"(-2D * ({self.rx(i)} - {plus([f'{self.xx(i, j)} * get({param}, {j})' for j in d])}))"
            for i in d
        ]


class ProbabilitySums:
    """Sums that give the derivative of a centred least-squares function in the probability.

    With features ``f`` and ``g = df/dprob`` the derivative of ``-2 (r - f.par) f`` is
    ``2 sum_c par_c (g_c f_a + f_c g_a) - 2 r g_a``. Each row also has a gradient of its
    probability, so the sums are kept per gradient entry ``e``. They need neither betas nor
    theta and are shared by every later block and horizon.
    """

    def __init__(self, name: str, base: int, treat: int, grad: int) -> None:
        self.name, self.base, self.dim, self.grad = name, base, base + treat, grad
        self.pairs = [
            (a, c) for a in range(self.dim) for c in range(a, self.dim) if c >= self.base
        ]

    def quad(self, a: int, c: int, e: int) -> str:
        return f"{self.name}_pq_{min(a, c)}_{max(a, c)}_{e}"

    def line(self, a: int, e: int) -> str:
        return f"{self.name}_pl_{a}_{e}"

    @property
    def columns(self) -> list[str]:
        grads = range(self.grad)
        return [self.quad(a, c, e) for a, c in self.pairs for e in grads] + [
            self.line(a, e) for a in range(self.base, self.dim) for e in grads
        ]

    def sums(
        self, features: Sequence[str], treat: Sequence[str], gradient: Sequence[str]
    ) -> list[Column]:
        g = {self.base + i: f"(-{x})" for i, x in enumerate(treat)}
        out = []
        for a, c in self.pairs:
            both = f"{g[c]} * {features[a]}" + (f" + {g[a]} * {features[c]}" if a in g else "")
            out += [
                F.expr(f"sum(({both}) * {gradient[e]}) AS {self.quad(a, c, e)}")
                for e in range(self.grad)
            ]
        return out + [
            F.expr(f"sum(reward * {g[a]} * {gradient[e]}) AS {self.line(a, e)}")
            for a in g
            for e in range(self.grad)
        ]

    def totals(self) -> list[Column]:
        return summed(self.columns)

    def derivative(self, a: int, e: int, param: str) -> str:
        """Entry (a, e) of the summed derivative for the parameter vector ``param``."""
        terms = [
            f"2D * get({param}, {c}) * {self.quad(a, c, e)}"
            for c in range(self.dim)
            if max(a, c) >= self.base
        ]
        if a >= self.base:
            terms.append(f"-2D * {self.line(a, e)}")
        return plus(terms)
