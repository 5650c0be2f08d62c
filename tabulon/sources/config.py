"""Configuration: loading with fallbacks, saving, alias teaching, and its dimension tables."""

from __future__ import annotations

import json
import os
import re
import shutil
import warnings
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tabulon.sources import fixed_values as fixed


def norm(text: str) -> str:
    return re.sub("[^a-z0-9]", "", text.lower())


@dataclass
class Config:
    target_schema: list[str] = field(default_factory=lambda: list(fixed.TARGET_SCHEMA))
    header_aliases: dict[str, list[str]] = field(default_factory=lambda: {k: list(v) for k, v in fixed.HEADER_ALIASES.items()})
    title_case_lower: list[str] = field(default_factory=lambda: list(fixed.TITLE_CASE_LOWER))
    materials: list[str] = field(default_factory=lambda: list(fixed.MATERIALS))
    max_material_length: int = fixed.MAX_MATERIAL_LENGTH
    whole_word_materials: bool = False
    dimension_pattern: str = fixed.DIMENSION_PATTERN
    fuzzy_threshold: float = fixed.FUZZY_THRESHOLD
    language_detection: bool = False
    min_text_chars: int = fixed.MIN_TEXT_CHARS
    enable_ocr: bool = True
    score_confident: float = fixed.SCORE_CONFIDENT
    plate_pattern: str = fixed.PLATE_PATTERN
    skip_markers: list[str] = field(default_factory=lambda: list(fixed.SKIP_MARKERS))
    #: What a file held beyond these fields, by section ("" is the top); saved again, used by nothing.
    extra: dict[str, dict] = field(default_factory=dict)

    def phrases(self) -> list[tuple[int, str, str]]:
        """(ordinal, target, phrase): schema names first, then aliases."""
        pairs = [(c, c) for c in self.target_schema] + [(c, a) for c, names in self.header_aliases.items() for a in names]
        return [(i, c, p) for i, (c, p) in enumerate(pairs)]

    def shadowed(self) -> dict[str, list[str]]:
        """Normalised phrases under several targets (the last one wins), to be shown to people."""
        seen: dict[str, list[str]] = {}
        for _, target, phrase in self.phrases():
            targets = seen.setdefault(norm(phrase), [])
            if target not in targets:
                targets.append(target)
        return {k: v for k, v in seen.items() if len(v) > 1}

    def teach(self, header: str, target: str, move: bool = False) -> bool:
        """Adds a raw header as an alias; one that another target has is moved only if ``move``."""
        others = [t for t, names in self.header_aliases.items() if t != target and norm(header) in map(norm, names)]
        if others and not move:
            return False
        for t in others:
            self.header_aliases[t] = [x for x in self.header_aliases[t] if norm(x) != norm(header)]
        names = self.header_aliases.setdefault(target, [])
        if norm(header) not in map(norm, names):
            names.append(header)
        return True


def _field(name: str, value):
    """The value as the field's type."""
    default = getattr(Config(), name)
    if isinstance(default, bool):
        if not isinstance(value, bool):
            raise TypeError(f"{name}: {value!r}")
        return value
    if isinstance(default, (int, float)):
        return type(default)(value)
    if not isinstance(value, type(default)):
        raise TypeError(f"{name}: {value!r}")
    return value


def parse(found: dict) -> Config:
    """A configuration as people have it: schema and aliases at the top, thresholds and lists under
    ``rules`` and ``options``. Lists that it leaves out there are empty, all else has its default.
    (Names of fields at the top are read too.) What is not known is kept in ``extra``."""
    values, extra = {}, {}
    for key, value in found.items():
        names = fixed.CONFIG_NAMES.get(key)
        if names is None and key in Config.__dataclass_fields__ and key != "extra":
            values[key] = _field(key, value)
        elif names is None:
            extra.setdefault("", {})[key] = value
        else:
            for k, v in (value or {}).items():
                if k in names:
                    values[names[k]] = _field(names[k], v)
                elif k not in fixed.CONFIG_UNUSED:
                    extra.setdefault(key, {})[k] = v
    for name in ("title_case_lower", "materials", "skip_markers"):
        values.setdefault(name, [])
    return Config(**values, extra=extra)


def load(*paths: str) -> Config:
    """The first readable file wins; a corrupt file is kept as ``.bak`` and the next one tried; without
    any, the defaults. Keys that are not known are warned of."""
    for path in paths:
        if not os.path.exists(path):
            continue
        try:
            with open(path, encoding="utf-8") as f:
                config = parse(json.load(f))
        except (ValueError, TypeError, AttributeError):
            shutil.copy(path, path + ".bak")
            continue
        unknown = [f"{section}.{k}".lstrip(".") for section, keys in config.extra.items() for k in keys]
        if unknown:
            warnings.warn(f"{path}: not known and not used: {', '.join(unknown)}", stacklevel=2)
        return config
    return Config()


def save(config: Config, path: str) -> None:
    """In the shape that ``load`` reads, with what it did not know."""
    values = asdict(config)
    nested = {section: {k: values.pop(name) for k, name in names.items()} for section, names in fixed.CONFIG_NAMES.items()}
    extra = values.pop("extra")
    out = values | extra.get("", {}) | {section: keys | extra.get(section, {}) for section, keys in nested.items()}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=2, ensure_ascii=False)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of driver-side values, with a size that the optimiser knows."""
    names = ", ".join(x.split()[0] for x in schema.split(", "))
    text = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    known = {"string": text, "int": str, "bigint": lambda v: f"{v}L"}
    types = [x.split()[1] for x in schema.split(", ")]

    def cell(v, t: str) -> str:
        if v is None or t not in known:
            return f"cast({'NULL' if v is None else text(v) if isinstance(v, str) else v} as {t})"
        return known[t](v)

    body = ", ".join("(" + ", ".join(map(cell, r, types)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def phrase_table(spark: SparkSession, config: Config) -> DataFrame:
    return literal_rows(spark, [(i, c, p, norm(p)) for i, c, p in config.phrases()], "ordinal int, target string, phrase string, norm string")
