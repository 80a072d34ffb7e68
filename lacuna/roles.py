"""Column roles of a table: what is a number, what is a category, what identifies a row."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Roles:
    """Roles declared beside a DataFrame.

    ``integer`` is the part of ``continuous`` whose fills are truncated to whole numbers.
    ``target`` is the label of the downstream classification and one of the features.
    """

    key: str
    continuous: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    integer: tuple[str, ...] = ()
    target: str | None = None
    features: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        for name in ("continuous", "categorical", "integer"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        object.__setattr__(self, "features", self.continuous + self.categorical)
        if len(set(self.features)) != len(self.features):
            raise ValueError("a column is declared twice")
        if not set(self.integer) <= set(self.continuous):
            raise ValueError("integer columns must be continuous columns")
        if self.key in self.features:
            raise ValueError("the key cannot be a feature")
        if self.target is not None and self.target not in self.features:
            raise ValueError("the target must be a feature")

    @property
    def covariates(self) -> tuple[str, ...]:
        return tuple(f for f in self.features if f != self.target)
