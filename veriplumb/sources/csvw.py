"""Metadata of delimited files in the CSVW vocabulary, as typed projections."""

from __future__ import annotations

import json
import logging
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import col

log = logging.getLogger("veriplumb")
#: CSVW and XSD datatypes by logical type (fixed values); all others are strings.
DATATYPES = {
    "bool": ("boolean",),
    "int": ("integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte", "nonPositiveInteger", "negativeInteger"),
    "number": ("number", "decimal", "double", "float"),
    "date": ("date",),
    "datetime": ("datetime", "dateTime", "dateTimeStamp"),
}
#: Suffixes of a sidecar file, in order of preference (fixed values).
SIDECARS = ("-metadata.json", ".metadata.json", "-csvmetadata.json", "-csv-metadata.json", ".csvmetadata.json", ".csv-metadata.json", "-csvw.json", ".schema.json", ".schema.yaml", ".resource.json", ".resource.yaml", ".package.json", ".package.yaml")


@dataclass
class FieldMetadata:
    name: str
    type: str = "string"
    format: str | None = None
    titles: list[str] = field(default_factory=list)
    required: bool = False
    null: list[str] = field(default_factory=list)


@dataclass
class TableMetadata:
    fields: list[FieldMetadata]
    url: str | None = None
    delimiter: str = ","
    header: bool = True
    quote: str = '"'
    escape: str = '"'
    encoding: str = "UTF-8"
    nulls: list[str] | None = None
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def apply(self, raw: DataFrame) -> DataFrame:
        """Columns of text as their types; by name or title, else by place."""
        out = []
        for i, f in enumerate(self.fields):
            source = next((n for n in [f.name, *f.titles] if n in raw.columns), raw.columns[i] if i < len(raw.columns) else None)
            c = F.lit(None).cast("string") if source is None else col(source)
            out.append(typed_column(c, f).alias(f.name, metadata={"titles": f.titles} if f.titles else {}))
        return raw.select(*out)

    def validated(self) -> TableMetadata:
        """Itself, with what is wrong or odd in ``errors`` and ``warnings``; both are logged."""
        for f in self.fields:
            if f.type in ("date", "datetime") and f.format and not re.search("[yM]", f.format):
                self.warnings.append(f"column {f.name}: {f.format!r} is no date format")
            if f.type == "bool" and f.format and f.format.count("|") != 1:
                self.warnings.append(f"column {f.name}: {f.format!r} isn't two texts parted by |")
            if not f.name.strip():
                self.errors.append("a column has no name")
        if len(self.delimiter) != 1:
            self.errors.append(f"the delimiter {self.delimiter!r} isn't one character")
        for said, level in ((self.errors, logging.ERROR), (self.warnings, logging.WARNING)):
            for x in said:
                log.log(level, "%s: %s", self.url or "metadata", x)
        return self

    def report(self) -> str:
        """Columns with their types, then errors and warnings."""
        lines = [f"{f.name}: {f.type}" + (f" ({f.format})" if f.format else "") + (", required" if f.required else "") for f in self.fields]
        return "\n".join([*lines, *(f"error: {x}" for x in self.errors), *(f"warning: {x}" for x in self.warnings)]) + "\n"

    def to_dict(self) -> dict:
        return {"url": self.url, "dialect": {"delimiter": self.delimiter, "header": self.header, "quoteChar": self.quote, "encoding": self.encoding}, "fields": [{k: v for k, v in vars(f).items() if v} for f in self.fields]}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=4, ensure_ascii=False) + "\n"


def typed_column(c: Column, f: FieldMetadata) -> Column:
    """Text cast to a field's type; what can't be is null."""
    if f.null:
        c = F.when(~c.isin(f.null), c)
    if f.type == "bool":
        yes, _, no = (f.format or "true|false").partition("|")
        return F.when(c.isin(yes, *(["1"] if not f.format else [])), True).when(c.isin(no, *(["0"] if not f.format else [])), False)
    if f.type == "int":
        return F.regexp_replace(F.trim(c), r"\.0+$", "").try_cast("long")
    if f.type == "number":
        percent = c.endswith("%")
        return F.when(percent, F.rtrim(F.regexp_replace(c, "%$", "")).try_cast("double") / 100).otherwise(F.trim(c).try_cast("double"))
    if f.type in ("date", "datetime"):
        t = F.try_to_timestamp(c, F.lit(spark_pattern(f.format))) if f.format else c.try_cast("timestamp")
        return t.cast("date") if f.type == "date" else t.cast("timestamp_ntz")
    return c


def spark_pattern(pattern: str) -> str:
    """A UAX-35 date pattern for Spark: the same, with a literal T quoted and fractions optional."""
    out = pattern if "'" in pattern else pattern.replace("T", "'T'")
    while out.endswith("S"):
        out = out[:-1]
        if not out.endswith("S"):
            out = out.rstrip(".") + "[.SSSSSSSSS][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"
    return out


def logical(base: str | None) -> str:
    return next((k for k, names in DATATYPES.items() if base in names), "string")


def _field(said: dict, place: int, inherited: dict) -> FieldMetadata:
    kind = said.get("datatype", inherited.get("datatype", "string"))
    base, form = (kind.get("base", "string"), kind.get("format")) if isinstance(kind, dict) else (kind, None)
    titles = said.get("titles", [])
    titles = [titles] if isinstance(titles, str) else [t for v in titles.values() for t in (v if isinstance(v, list) else [v])] if isinstance(titles, dict) else list(titles)
    null = said.get("null", inherited.get("null", []))
    return FieldMetadata(said.get("name") or (titles[0] if titles else f"_col.{place}"), logical(base), form if isinstance(form, str) else None, titles, bool(said.get("required")), [null] if isinstance(null, str) else list(null))


def parse(said: dict, folder: str = "", table_number: int | None = None, table_name: str | None = None) -> TableMetadata:
    """Metadata of one table: of several, the one by number or by the end of its URL, else the first."""
    tables = said.get("tables") or [said]
    if table_name is not None:
        t = next((t for t in tables if (t.get("url") or "").endswith(table_name)), None)
        if t is None:
            raise ValueError(f"no table {table_name!r}")
    else:
        if not 0 <= (table_number or 0) < len(tables):
            raise ValueError(f"no table number {table_number}")
        t = tables[table_number or 0]
    schema = t.get("tableSchema", said.get("tableSchema", {}))
    if isinstance(schema, str):
        with open(os.path.join(folder, schema), encoding="utf-8") as f:
            schema = json.load(f)
    dialect = {**said.get("dialect", {}), **t.get("dialect", {})} if isinstance(said.get("dialect", {}), dict) else {}
    fields = [_field(c, i + 1, {**said, **t, **schema}) for i, c in enumerate(schema.get("columns", [])) if not c.get("virtual")]
    out = TableMetadata(fields, t.get("url") or said.get("dc:replaces"), dialect.get("delimiter", ","), bool(dialect.get("header", dialect.get("headerRowCount", 1))), dialect.get("quoteChar") or "", '"' if dialect.get("doubleQuote", True) else "\\", dialect.get("encoding", "UTF-8"))
    if "quoteChar" not in dialect:
        out.quote = '"'
    seen: set[str] = set()
    for f in fields:
        if f.name in seen:
            out.errors.append(f"duplicate column name {f.name}")
        seen.add(f.name)
    if not fields:
        out.warnings.append("no columns are described")
    return out.validated()


def metadata_kind(path: str) -> str | None:
    """Kind of a metadata file by its name."""
    name = os.path.basename(path).lower()
    if name.endswith("-csvmetadata.json"):
        return "csvmetadata"
    if name.endswith("-metadata.json") or name.endswith(".json") and "csvw" in name:
        return "csvw"
    return "frictionless" if name.endswith((".json", ".yaml")) and any(w in name for w in ("package", "resource", "schema")) else None


def find_metadata(path: str) -> str | None:
    """The sidecar file of a delimited file, if there is one."""
    stem = os.path.splitext(path)[0]
    options = [base + s for base in (path, stem) for s in SIDECARS] + [os.path.join(os.path.dirname(path), "csv-metadata.json")]
    return next((p for p in options if os.path.exists(p)), None)


def load_metadata(path: str, table_number: int | None = None, table_name: str | None = None) -> TableMetadata:
    """Metadata from a file: CSVW or a table of fields in JSON, a table schema or data package in JSON or YAML."""
    with open(path, encoding="utf-8") as f:
        if path.lower().endswith((".yaml", ".yml")):
            import yaml  # not needed for anything else

            return frictionless(yaml.safe_load(f))
        said = json.load(f)
    context = said.get("@context")
    if not context or "csvw" not in json.dumps(context):
        if {"fields", "resources", "schema"} & set(said):
            return frictionless(said)
        raise ValueError(f"{path} is not CSVW metadata")
    return parse(said, os.path.dirname(path), table_number, table_name)


def frictionless(said: dict) -> TableMetadata:
    """A table schema or the first resource of a data package."""
    resource = (said.get("resources") or [said])[0]
    schema = resource.get("schema", resource)
    if not isinstance(schema, dict):
        raise ValueError("a schema in another file is not read")
    fields = []
    for f in schema.get("fields", []):
        kind = f.get("type") or f.get("datatype") or f.get("fieldtype") or "string"
        titles = [f["title"]] if "title" in f else []
        constraints = f.get("constraints") or {}
        form = f.get("format") if f.get("format") not in (None, "default", "any") else None
        fields.append(FieldMetadata(f["name"], kind if kind in ("bool",) else logical(kind), strptime_as_spark(form) if form and "%" in form else form if form and logical(kind) != "string" else None, titles, bool(constraints.get("required"))))
    dialect = resource.get("dialect") if isinstance(resource.get("dialect"), dict) else {}
    out = TableMetadata(fields, resource.get("path"), dialect.get("delimiter", resource.get("delimiter", ",")), bool(dialect.get("header", True)), dialect.get("quoteChar", '"'), encoding=resource.get("encoding", "UTF-8"), nulls=schema.get("missingValues"))
    return out.validated()


#: Spark's letters for those of strptime (fixed values).
STRPTIME = {"Y": "yyyy", "y": "yy", "m": "M", "d": "d", "H": "H", "M": "mm", "S": "ss", "f": "SSSSSS", "B": "MMMM", "b": "MMM", "j": "D", "T": "H:mm:ss"}


def strptime_as_spark(form: str) -> str:
    """A date format of per cent signs as Spark writes it; other letters are quoted."""
    parts = re.findall(r"%(.)|([A-Za-z]+)|([^%A-Za-z]+)", form)
    return "".join(STRPTIME.get(c, c) if c else f"'{w}'" if w else x for c, w, x in parts)
