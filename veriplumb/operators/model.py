"""Constraints on the fields of a table, and their JSON form."""

from __future__ import annotations

import datetime
import getpass
import json
import logging
import socket
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..functions.dates import parse_date
from ..functions.types import LOGICAL

log = logging.getLogger("veriplumb")

#: Kinds in the order of output, with the suffix of each kind's row flags (fixed values).
KINDS = {
    "type": "type", "min": "min", "min_length": "min_length", "max": "max", "max_length": "max_length", "sign": "sign",
    "max_nulls": "nonnull", "no_duplicates": "nodups", "allowed_values": "values", "rex": "rex", "transform": "transform",
}
RELATIONS = ("lt", "lte", "eq", "gt", "gte")
SIGNS = ("positive", "non-negative", "zero", "non-positive", "negative", "null")
PRECISIONS = ("open", "closed", "fuzzy")
#: Keys of the metadata in the order of output (fixed values); others that a file has are kept, after these.
METADATA = ("as_at", "local_time", "utc_time", "creator", "rdbms", "source", "host", "user", "dataset", "n_records", "n_selected")


class InvalidConstraint(ValueError):
    """A constraint whose value its kind doesn't allow."""


@dataclass(frozen=True)
class Constraint:
    """One constraint; a value of None is always satisfied by a column that exists."""

    kind: str
    value: object
    precision: str | None = None

    def __post_init__(self):
        v = self.value
        wrong = False
        if self.kind not in KINDS and self.kind not in RELATIONS:
            raise InvalidConstraint(f"unknown kind {self.kind!r}")
        if self.precision is not None:
            wrong = self.kind not in ("min", "max") or self.precision not in PRECISIONS
        if v is not None:
            wrong = wrong or {
                "type": lambda: not all(t in LOGICAL for t in (v if isinstance(v, list) else [v])),
                "sign": lambda: v not in SIGNS,
                "min_length": lambda: isinstance(v, bool) or not isinstance(v, int) or v < 0,
                "max_length": lambda: isinstance(v, bool) or not isinstance(v, int) or v < 0,
                "max_nulls": lambda: isinstance(v, bool) or not isinstance(v, int) or v < 0,
                "no_duplicates": lambda: not isinstance(v, bool),
                "allowed_values": lambda: not isinstance(v, (list, tuple)),
                "rex": lambda: not isinstance(v, (list, tuple)) or not all(isinstance(r, str) for r in v),
                "min": lambda: isinstance(v, (list, dict)),
                "max": lambda: isinstance(v, (list, dict)),
            }.get(self.kind, lambda: False)()
        if wrong:
            raise InvalidConstraint(f"{self.kind}: value {v!r}, precision {self.precision!r}")

    def plain(self):
        """The JSON value."""
        v = self.value
        if isinstance(v, (datetime.date, datetime.datetime)):
            v = str(v)
        elif isinstance(v, (list, tuple)):
            v = [str(x) if isinstance(x, (datetime.date, datetime.datetime)) else x for x in v]
        return v if self.precision is None else {"value": v, "precision": self.precision}


@dataclass
class FieldConstraints:
    """A field's constraints by kind, iterated in the order of kinds."""

    name: str
    constraints: dict[str, Constraint] = field(default_factory=dict)

    def __init__(self, name: str, constraints=()):
        self.name = name
        self.constraints = {c.kind: c for c in constraints}

    def __iter__(self) -> Iterator[Constraint]:
        order = [*KINDS, *RELATIONS]
        return iter(sorted(self.constraints.values(), key=lambda c: order.index(c.kind)))

    def __len__(self) -> int:
        return len(self.constraints)

    def __contains__(self, kind: str) -> bool:
        return kind in self.constraints

    def __getitem__(self, kind: str) -> Constraint:
        return self.constraints[kind]

    def value(self, kind: str):
        return self.constraints[kind].value if kind in self.constraints else None


def _constraint(kind: str, said, is_date: bool) -> Constraint:
    precision = None
    if isinstance(said, dict):
        extra = set(said) - ({"value", "precision", "comment"} if kind in ("min", "max") else {"value", "comment"})
        if extra:
            raise InvalidConstraint(f"{kind}: unexpected {sorted(extra)}")
        precision, said = said.get("precision"), said.get("value")
    return Constraint(kind, parse_date(said) if is_date and kind in ("min", "max") else said, precision)


class DatasetConstraints:
    """Constraints of a table's fields, with metadata about where they come from."""

    def __init__(self, fields=(), path: str | None = None, postload=None, postdict=None):
        self.fields: dict[str, FieldConstraints] = {f.name: f for f in fields}
        self.metadata: dict[str, object] = {}
        self.postload, self.postdict, self.path = postload, postdict, path
        if path:
            with open(path, encoding="utf-8") as f:
                self.read(json.load(f))

    @classmethod
    def from_dict(cls, said: dict) -> DatasetConstraints:
        out = cls()
        out.read(said)
        return out

    def read(self, said: dict) -> None:
        for name, kinds in said.get("fields", {}).items():
            is_date = kinds.get("type") == "date" or isinstance(kinds.get("type"), list) and "date" in kinds["type"]
            known = []
            for kind, value in kinds.items():
                if kind in KINDS or kind in RELATIONS:
                    known.append(_constraint(kind, value, is_date))
                elif not kind.startswith("#"):
                    log.warning("constraint kind %s of field %s is unknown; it is ignored", kind, name)
            self.fields[name] = FieldConstraints(name, known)
        self.metadata = dict(said.get("creation_metadata", {}))
        if self.postload:
            try:
                self.postload(said)
            except Exception:  # noqa: BLE001
                log.warning("the hook after loading failed", exc_info=True)

    def __iter__(self) -> Iterator[FieldConstraints]:
        return iter(self.fields.values())

    def __getitem__(self, name: str) -> FieldConstraints:
        return self.fields[name]

    def __contains__(self, name: str) -> bool:
        return name in self.fields

    def __len__(self) -> int:
        return sum(len(f) for f in self)

    def add_field(self, f: FieldConstraints) -> None:
        self.fields[f.name] = f

    def remove_field(self, name: str) -> None:
        self.fields.pop(name, None)

    def sort_fields(self, order: list[str] | None = None) -> None:
        place = {n: i for i, n in enumerate(order or sorted(self.fields))}
        self.fields = dict(sorted(self.fields.items(), key=lambda kv: place.get(kv[0], -1)))

    def stamp(self, n_records: int | None = None, dataset: str | None = None, source: str | None = None, creator: str = "veriplumb") -> None:
        """Fills in the metadata of a discovery made now."""
        now = datetime.datetime.now(datetime.UTC).replace(microsecond=0)
        said = {"local_time": str(now.astimezone().replace(tzinfo=None)), "utc_time": str(now.replace(tzinfo=None)), "creator": creator, "source": source, "host": socket.gethostname(), "dataset": dataset, "n_records": n_records}
        try:
            said["user"] = getpass.getuser()
        except (KeyError, OSError):
            pass
        self.metadata |= {k: v for k, v in said.items() if v is not None}

    def to_dict(self) -> dict:
        out: dict = {}
        if self.metadata:
            out["creation_metadata"] = {k: self.metadata[k] for k in [*METADATA, *self.metadata] if k in self.metadata}
        out["fields"] = {f.name: {c.kind: c.plain() for c in f} for f in self}
        if self.postdict:
            try:
                self.postdict(out)
            except Exception:  # noqa: BLE001
                log.warning("the hook before writing failed", exc_info=True)
        return out

    def to_json(self) -> str:
        text = json.dumps(self.to_dict(), indent=4, ensure_ascii=False)
        return "\n".join(line.rstrip() for line in text.splitlines()) + "\n"

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json())

    def to_df(self, spark):
        """One row per constraint: field, kind, value (as JSON)."""
        rows = [(f.name, c.kind, json.dumps(c.plain(), ensure_ascii=False)) for f in self for c in f]
        return spark.createDataFrame(rows, "field string, kind string, value string")
