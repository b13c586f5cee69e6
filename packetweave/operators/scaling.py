"""Z-scores with population deviation; a constant feature keeps scale 1."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetweave.storage import attach

# A centre that does not exist: far enough never to be nearest, small enough
# that its squared distance stays finite.
ABSENT = 1e150


def moments(features: tuple[str, ...]) -> list[Column]:
    """``means`` and ``scales`` arrays as two aggregate columns of one pass."""
    def scale(name: str) -> Column:
        spread = F.stddev_pop(name)
        return F.when(spread == 0, F.lit(1.0)).otherwise(spread)

    return [
        F.array(*[F.avg(F.col(n).cast("double")) for n in features]).alias("means"),
        F.array(*[scale(n) for n in features]).alias("scales"),
    ]


def z_names(count: int) -> list[str]:
    return [f"z{i + 1}" for i in range(count)]


@dataclass(frozen=True)
class Terms:
    """How fitted numbers are written inside SQL expressions.

    Without keys there is one scope row and its numbers become literals, so a
    plan is scan, projection, aggregate.  With keys they are flat columns of
    the scope row, joined to the packets by ``place``.
    """

    by: tuple[str, ...]
    means: list[str]
    inverse: list[str]
    centres: list[list[str]]
    rows: DataFrame | None

    @classmethod
    def literal(cls, means: list[float], scales: list[float], centres: list[list[float] | None]) -> Terms:
        def number(value: float) -> str:
            return f"({float(value)!r}D)"

        absent = [ABSENT] * len(means)
        return cls(
            (), [number(x) for x in means], [number(1.0 / x) for x in scales],
            [[number(x) for x in (c or absent)] for c in centres], None,
        )

    @classmethod
    def of(cls, rows: DataFrame, by: tuple[str, ...], d: int, k: int = 0) -> Terms:
        if not by:
            row = rows.first()
            return cls.literal(row["means"], row["scales"], row["centres"][:k] if k else [])
        means = [f"_m{j}" for j in range(d)]
        inverse = [f"_s{j}" for j in range(d)]
        centres = [[f"_c{i}_{j}" for j in range(d)] for i in range(k)]
        flat = rows.selectExpr(
            *by,
            *[f"means[{j}] as {n}" for j, n in enumerate(means)],
            *[f"1D / scales[{j}] as {n}" for j, n in enumerate(inverse)],
            *[f"coalesce(centres[{i}][{j}], {ABSENT!r}D) as {n}" for i, c in enumerate(centres) for j, n in enumerate(c)],
        )
        return cls(by, means, inverse, centres, flat)

    def columns(self) -> list[str]:
        """Centre columns that projections must carry along."""
        return [n for c in self.centres for n in c] if self.rows is not None else []

    def place(self, facts: DataFrame, small: bool | None = None) -> DataFrame:
        return facts if self.rows is None else attach(facts, self.rows, self.by, small=small)


def with_z(df: DataFrame, features: tuple[str, ...], terms: Terms, keep: list[str]) -> DataFrame:
    """Standardised columns ``z1..zd`` of packets on which ``terms`` are placed.

    Features are never null; saying so with ``coalesce`` spares the null checks
    of some hundred operations in the generated distance code.
    """
    z = [
        f"coalesce((`{n}` - {terms.means[j]}) * {terms.inverse[j]}, 0D) as z{j + 1}"
        for j, n in enumerate(features)
    ]
    return df.selectExpr(*keep, *z)
