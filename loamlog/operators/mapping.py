"""Managed indexes: typed document mappings, promoted columns, templates."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamlog.functions.text import attr_get

# Fixed values of the mapping language.
TYPES = {"text": "string", "json": "string", "long": "bigint", "double": "double", "bool": "boolean", "datetime": "timestamp", "bytes": "binary"}
TOKENIZERS = ("default", "raw", "stem")
MODES = ("dynamic", "lenient", "strict")
MAX_FIELDS = 256
RESIDUAL = "attributes"
CARRIER = ("host", "source", "sourcetype", "index", "raw")


class MappingError(ValueError):
    """A configuration or a batch that breaks its rules."""


@dataclass
class Field:
    name: str
    type: str
    required: bool = False
    tokenizer: str | None = None


@dataclass
class IndexConfig:
    index_id: str
    fields: list[Field]
    timestamp_field: str = "timestamp"
    mode: str = "dynamic"
    tag_fields: list[str] = field(default_factory=list)
    default_search_fields: list[str] = field(default_factory=list)
    retention_secs: int | None = None

    def validate(self) -> IndexConfig:
        if not re.fullmatch(r"[a-z0-9][a-z0-9_-]{0,127}", self.index_id):
            raise MappingError(f"bad index id {self.index_id!r}")
        if self.mode not in MODES:
            raise MappingError(f"unknown mode {self.mode!r}")
        if len(self.fields) > MAX_FIELDS:
            raise MappingError(f"more than {MAX_FIELDS} fields")
        known: dict[str, Field] = {}
        for f in self.fields:
            if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", f.name):
                raise MappingError(f"bad field name {f.name!r}")
            if f.name == RESIDUAL:
                raise MappingError(f"the field name {RESIDUAL} is reserved")
            if f.name in known:
                raise MappingError(f"the field {f.name} is declared twice")
            if f.type not in TYPES:
                raise MappingError(f"unknown type {f.type!r}")
            if f.tokenizer is not None and (f.type != "text" or f.tokenizer not in TOKENIZERS):
                raise MappingError(f"bad tokenizer of {f.name}")
            known[f.name] = f
        time = known.get(self.timestamp_field)
        if time is None or time.type != "datetime" or not time.required:
            raise MappingError("the timestamp field must be declared, a datetime and required")
        for name in self.tag_fields:
            if name not in known:
                raise MappingError(f"unknown tag field {name}")
        for name in self.default_search_fields:
            if name not in known or known[name].type != "text":
                raise MappingError(f"the search field {name} must be a declared text field")
        if self.retention_secs is not None and self.retention_secs <= 0:
            raise MappingError("retention must be positive")
        return self

    def schema(self) -> T.StructType:
        out = T.StructType([T.StructField(f.name, T._parse_datatype_string(TYPES[f.type]), not f.required) for f in self.fields])
        return out.add(RESIDUAL, "string")

    def etag(self) -> str:
        return '"' + hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:32] + '"'

    def evolve(self, new: IndexConfig) -> IndexConfig:
        """The new configuration, if it only appends optional fields to this one."""
        new.validate()
        if new.index_id != self.index_id or new.timestamp_field != self.timestamp_field:
            raise MappingError("the index id and the timestamp field can't change")
        if new.fields[: len(self.fields)] != self.fields:
            raise MappingError("declared fields can't change")
        if any(f.required for f in new.fields[len(self.fields) :]):
            raise MappingError("added fields must be optional")
        return new


def _scalar(json_text: Column, name: str) -> tuple[Column, Column]:
    """A literal member's text, and whether it is an object or array."""
    variant = F.try_parse_json(json_text)
    path = "$['" + name.replace("'", "\\'") + "']"
    text = F.get_json_object(json_text, path)
    kind = F.schema_of_variant(F.try_variant_get(variant, "$." + name if re.fullmatch(r"\w+", name) else path, "variant"))
    return text, kind.startswith("OBJECT") | kind.startswith("ARRAY")


def coerce(text: Column, kind: str) -> Column:
    """Attribute text to a promoted type: a number's fraction is cut off for integers, booleans are
    true and false only; null if it can't be."""
    if kind in ("long", "bigint"):
        return F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")), F.when(text.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), text.try_cast("double").try_cast("bigint")))
    if kind == "double":
        return text.try_cast("double")
    if kind in ("bool", "boolean"):
        return F.when(text == "true", True).when(text == "false", False)
    return text


def promote(df: DataFrame, columns: dict[str, tuple[str, str]], attributes: str = RESIDUAL) -> DataFrame:
    """Adds a typed column for each name: (attribute key, type). Text keeps objects as JSON."""
    return df.select("*", *[coerce(attr_get(F.col(attributes), key), kind).alias(name) for name, (key, kind) in columns.items()])


def map_events(events: DataFrame, config: IndexConfig) -> DataFrame:
    """Canonical events as rows of the index, with ``violation`` (true where strict mode meets an
    undeclared attribute).

    The timestamp field is the event's time, declared carrier names are its columns, other fields
    come from the attribute of their name: text from scalars only, datetime and bytes are null. What
    no field took stays in the residual column (dropped in lenient mode). Malformed attributes stay
    as they are.
    """
    config.validate()
    attributes = F.col(RESIDUAL)
    columns, taken = [], []
    for f in config.fields:
        if f.name == config.timestamp_field:
            value = F.col("timestamp")
        elif f.name == "timestamp_ns" and f.type == "long" and config.timestamp_field == "timestamp" and "timestamp_ns" in events.columns:
            value = F.col("timestamp_ns")
        elif f.name in CARRIER and f.type in ("text", "json"):
            value = F.col(f.name)
        elif f.type in ("datetime", "bytes"):
            value = F.lit(None).cast(TYPES[f.type])
        else:
            text, nested = _scalar(attributes, f.name)
            value = text if f.type == "json" else F.when(~F.coalesce(nested, F.lit(False)), coerce(text, "string" if f.type == "text" else f.type))
            taken.append(F.when(value.isNotNull(), F.lit(f.name)))
        columns.append(value.cast(TYPES[f.type]).alias(f.name))
    names = F.array_compact(F.array(*taken)) if taken else F.array().cast("array<string>")
    rest = F.filter(F.json_object_keys(attributes), lambda k: ~F.array_contains(names, k))
    members = F.from_json(attributes, "map<string,variant>")
    kept = F.map_filter(members, lambda k, v: ~F.array_contains(names, k))
    residual = F.when(rest.isNull(), attributes).when(F.size(rest) > 0, F.to_json(kept))
    violation = F.lit(config.mode == "strict") & residual.isNotNull()
    if config.mode == "lenient":
        residual = F.lit(None).cast("string")
    return events.select(*columns, residual.alias(RESIDUAL), violation.alias("violation"))


def check_required(mapped: DataFrame, config: IndexConfig) -> DataFrame:
    """The batch, or MappingError if a required field is null in some row. One small job."""
    required = [f.name for f in config.fields if f.required]
    bad = mapped.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in required]).first() if required else None
    for n in required:
        if bad[n]:
            raise MappingError(f"the required field {n} is null in {bad[n]} rows")
    return mapped


@dataclass
class Template:
    template_id: str
    patterns: list[str]
    priority: int
    fields: list[Field]
    timestamp_field: str = "timestamp"


def resolve(templates: list[Template], index_id: str) -> IndexConfig | None:
    """The configuration of the matching template of the highest priority, ties by id."""
    matching = [t for t in templates if any(fnmatch.fnmatchcase(index_id, p) for p in t.patterns)]
    if not matching:
        return None
    best = min(matching, key=lambda t: (-t.priority, t.template_id))
    return IndexConfig(index_id, best.fields, best.timestamp_field).validate()


class Registry:
    """Index configurations by id, changed only by who knows the current one's tag. With a ``store``
    they are durable: each change is a file created once, so of two writers one is refused."""

    def __init__(self, store=None):
        self.store, self.configs = store, {}
        for index_id in store.folders("indexes") if store else []:
            if (now := self._stored(index_id)[1]) is not None:
                self.configs[index_id] = now

    def _stored(self, index_id: str) -> tuple[int, IndexConfig | None]:
        versions = sorted(int(n[:-5]) for n, _, _ in self.store.names(f"indexes/{index_id}") if n.endswith(".json"))
        if not versions:
            return 0, None
        found = json.loads(self.store.read(f"indexes/{index_id}/{versions[-1]}.json"))
        return versions[-1], None if found is None else IndexConfig(**(found | {"fields": [Field(**f) for f in found["fields"]]}))

    def _write(self, index_id: str, config: IndexConfig | None, known: IndexConfig | None) -> None:
        if self.store:
            version, now = self._stored(index_id)
            if (now and now.etag()) != (known and known.etag()) or not self.store.create(f"indexes/{index_id}/{version + 1}.json", json.dumps(config and asdict(config))):
                raise MappingError("the index was changed by someone else")
        if config is None:
            del self.configs[index_id]
        else:
            self.configs[index_id] = config

    def create(self, config: IndexConfig) -> str:
        if config.index_id in self.configs:
            raise MappingError(f"the index {config.index_id} exists")
        self._write(config.index_id, config.validate(), None)
        return config.etag()

    def get_or_create(self, index_id: str, templates: list[Template]) -> IndexConfig:
        """The index events are ingested into: made by the template that matches, if there is none yet."""
        if index_id not in self.configs:
            config = resolve(templates, index_id)
            if config is None:
                raise KeyError(index_id)
            self.create(config)
        return self.configs[index_id]

    def _check(self, index_id: str, if_match: str) -> IndexConfig:
        now = self.configs.get(index_id)
        if now is None:
            raise KeyError(index_id)
        if if_match.startswith("W/") or if_match != now.etag():
            raise MappingError("the index was changed by someone else")
        return now

    def update(self, config: IndexConfig, if_match: str) -> str:
        now = self._check(config.index_id, if_match)
        self._write(config.index_id, now.evolve(config), now)
        return config.etag()

    def delete(self, index_id: str, if_match: str) -> None:
        self._write(index_id, None, self._check(index_id, if_match))
