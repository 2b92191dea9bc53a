"""A feature catalog: a small expression language over columns, compiled to projections.

A feature is a column of the input or an operation on one or two features.
Its name says what it is (``a_log``, ``a_div_b``), its depth how many
operations deep it lies, its type is a number if all its inputs are and the
operation gives one.  Compiling selects one level at a time, so a shared part
is worked out once, and a catalog is stored as JSON.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.functions import numeric, other
from loomtab.operators.encoders import CategoricalEncoder

NUM, CAT = "num", "cat"
#: Operations on categories that need a fit.
ENCODERS = ("target", "freq", "count")


@dataclass(frozen=True)
class Feature:
    """A column, or an operation on features named ``left`` and ``right``."""

    name: str
    dtype: str
    weight: float = 1.0
    depth: int = 0
    op: str | None = None
    left: str | None = None
    right: str | None = None


class Registry:
    """Operations by input type and arity; more can be registered at run time."""

    def __init__(self):
        self.unary: dict[str, dict[str, Callable]] = {NUM: dict(numeric.UNARY), CAT: {}}
        self.binary: dict[str, dict[str, Callable]] = {NUM: dict(numeric.BINARY), CAT: {"concat": other.concat}}

    def register(self, dtype: str, arity: int, name: str, build: Callable[..., Column]) -> None:
        (self.unary if arity == 1 else self.binary)[dtype][name] = build

    def __call__(self, op: str, dtype: str, arity: int) -> Callable[..., Column]:
        return (self.unary if arity == 1 else self.binary)[dtype][op]


class Catalog:
    """Features in an order in which inputs come before what is made of them."""

    def __init__(self, features: list[Feature], registry: Registry | None = None, label: str | None = None):
        self.features: dict[str, Feature] = {}
        self.registry = registry or Registry()
        self.label = label
        self.encoder: CategoricalEncoder | None = None
        for f in features:
            self._put(f)

    @classmethod
    def of(cls, df: DataFrame, label: str | None = None, leave: tuple[str, ...] = ()) -> Catalog:
        """The columns of a frame: numbers as ``num``, text and booleans as ``cat``."""
        kinds = {c: NUM if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal") else CAT if t in ("string", "boolean") else None for c, t in df.dtypes}
        return cls([Feature(c, k) for c, k in kinds.items() if k and c != label and c not in leave], label=label)

    def _put(self, f: Feature) -> Feature:
        if f.name in self.features:
            raise ValueError(f"{f.name} is there already")
        for parent in (f.left, f.right):
            if parent is not None and parent not in self.features:
                raise ValueError(f"{f.name} needs {parent}")
        self.features[f.name] = f
        return f

    def name(self, op: str, left: str, right: str | None = None) -> str:
        """An operation's name; commutative ones name their inputs in order, so both ways are one feature."""
        if right is not None and op in numeric.COMMUTATIVE and right < left:
            left, right = right, left
        return f"{left}_{op}" + (f"_{right}" if right else "")

    def add(self, op: str, left: str, right: str | None = None) -> Feature:
        """A new feature; the same one if it is there."""
        name = self.name(op, left, right)
        if name in self.features:
            return self.features[name]
        parents = [self.features[p] for p in (left, right) if p]
        numbers = all(p.dtype == NUM for p in parents)
        if op not in ENCODERS:
            self.registry(op, NUM if numbers else CAT, len(parents))
        elif numbers or right:
            raise ValueError(f"{op} encodes one category")
        dtype = NUM if numbers or op in ENCODERS else CAT
        return self._put(Feature(name, dtype, sum(p.weight for p in parents) / len(parents), 1 + max(p.depth for p in parents), op, left, right))

    def children(self, name: str) -> set[str]:
        """All features made of one, directly or not."""
        found: set[str] = set()
        for f in self.features.values():
            if f.left == name or f.right == name or f.left in found or f.right in found:
                found.add(f.name)
        return found

    def drop(self, name: str) -> None:
        """Forget a feature; one that others are made of stays."""
        if self.children(name):
            raise ValueError(f"others are made of {name}")
        del self.features[name]

    def fit(self, df: DataFrame) -> Catalog:
        """Fit the encoders that the catalog's features need, over columns made so far."""
        wanted = {op: [f.left for f in self.features.values() if f.op == op] for op in ENCODERS}
        if any(wanted.values()):
            self.encoder = CategoricalEncoder(label=self.label, keep=True, **wanted).fit(self._levels(df, encoded=False))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with every made feature; NaN in number columns becomes null."""
        return self._levels(df, encoded=True)

    def _levels(self, df: DataFrame, encoded: bool) -> DataFrame:
        made = [f for f in self.features.values() if f.op]
        skip = {f.name for f in made if f.op in ENCODERS and not encoded}
        for f in made:
            if f.left in skip or f.right in skip:
                skip.add(f.name)
        for level in range(1, 1 + max((f.depth for f in made), default=0)):
            now = [f for f in made if f.depth == level and f.name not in skip]
            coded = [f for f in now if f.op in ENCODERS]
            if coded:
                if self.encoder is None:
                    raise ValueError("fit first")
                part = CategoricalEncoder(label=self.label, tables={f.left: self.encoder.tables[f.left] for f in coded}, prior=self.encoder.prior, **{op: [f.left for f in coded if f.op == op] for op in ENCODERS})
                df = part.transform(df)
            df = df.select("*", *[self._column(f).alias(f.name) for f in now if f.op not in ENCODERS])
        return df

    def _column(self, f: Feature) -> Column:
        parents = [self.features[p] for p in (f.left, f.right) if p]
        numbers = all(p.dtype == NUM for p in parents)
        inputs = [numeric.number(F.col(f"`{p.name}`")) if numbers else F.col(f"`{p.name}`") for p in parents]
        return self.registry(f.op, NUM if numbers else CAT, len(parents))(*inputs)

    def save(self, path: str) -> None:
        """The features as JSON; encoder tables as Parquet beside it, written by Spark."""
        with open(path, "w") as out:
            json.dump({"label": self.label, "features": [asdict(f) for f in self.features.values()], "prior": self.encoder.prior if self.encoder else None, "tables": list(self.encoder.tables) if self.encoder else []}, out)
        for c, table in (self.encoder.tables if self.encoder else {}).items():
            table.write.mode("overwrite").parquet(f"{path}.{c}")

    @classmethod
    def load(cls, spark, path: str) -> Catalog:
        with open(path) as src:
            held = json.load(src)
        out = cls([Feature(**f) for f in held["features"]], label=held["label"])
        if held["tables"]:
            out.encoder = CategoricalEncoder(label=held["label"], prior=held["prior"], tables={c: spark.read.parquet(f"{path}.{c}") for c in held["tables"]})
        return out
