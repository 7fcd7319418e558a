"""Model registry: parsing, resolution of names, and what is installed."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The precision that a device runs.
DEVICE_PRECISION = {"cpu": "int8", "gpu": "fp16", "coreml": "fp32"}


@dataclass(frozen=True)
class Model:
    id: str
    label: str = ""
    family: str = ""
    precision: str = "fp32"
    url: str = ""
    file: str = ""
    sha256: str = ""
    size_mb: float = 0.0
    lossless: bool = False
    hidden: bool = False


@dataclass
class Registry:
    models: dict[str, Model]
    families: dict[str, tuple[str, str]] = field(default_factory=dict)  # id: (label, default)
    recommended: list[str] = field(default_factory=list)
    preferred: str = ""

    def variant(self, family: str, precision: str | None) -> Model | None:
        return next((m for m in self.models.values() if m.family == family and m.precision == precision), None)

    def for_device(self, family: str, device: str) -> Model:
        return self.variant(family, DEVICE_PRECISION.get(device)) or self.models[self.families[family][1]]

    def _lookup(self, name: str) -> Model | str:
        """A model, or a family's id; exact names first, then without regard to case."""
        for table in (self.models, self.families):
            if name in table:
                return self.models[name] if table is self.models else name
        for table in (self.models, self.families):
            for k in table:
                if k.lower() == name.lower():
                    return self.models[k] if table is self.models else k
        raise KeyError(f"unknown model {name!r}; known: {', '.join(sorted(self.models))}")

    def resolve(self, name: str, device: str = "cpu", variant: str | None = None) -> Model:
        found = self._lookup(str(name).strip())
        if isinstance(found, Model):
            return found
        kind = (variant or "default").strip().lower()
        if kind == "default":
            return self.for_device(found, device)
        if kind == "auto":
            m = self.variant(found, DEVICE_PRECISION.get(device))
            return m if m and m.lossless else self.models[self.families[found][1]]
        if kind not in ("fp32", "fp16", "int8"):
            raise ValueError(f"unknown variant {variant!r}")
        if m := self.variant(found, kind):
            return m
        raise KeyError(f"family {found!r} has no {kind} model")

    def visible(self) -> list[Model]:
        return [m for m in self.models.values() if not m.hidden]

    def default(self, device: str = "cpu") -> Model:
        named = next((n for n in [*self.recommended, self.preferred] if n in self.models), None) or next(iter(self.models), None)
        if named is None:
            raise KeyError("registry has no models")
        family = self.models[named].family
        return self.for_device(family, device) if family in self.families else self.models[named]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, m.id, m.family, m.precision, m.sha256, m.file, m.lossless, m.hidden) for i, m in enumerate(self.models.values())]
        return spark.createDataFrame(rows, "rank int, id string, family string, precision string, sha256 string, file string, lossless boolean, hidden boolean")


def parse(text: str) -> Registry:
    """A registry from JSON: schema 2, or a flat object of names and URLs."""
    raw = json.loads(text)
    if not isinstance(raw, dict) or not raw:
        raise ValueError("the registry is empty")
    if not (isinstance(raw.get("schema"), int) and raw["schema"] >= 2):
        named = {k.strip(): v if isinstance(v, str) else "" for k, v in raw.items() if k.strip()}
        if not named:
            raise ValueError("the registry has no models")
        return Registry({k: Model(k, k, url=u, file=k + (os.path.splitext(u.split("?")[0])[1] or ".onnx")) for k, u in named.items()})
    specs = raw.get("models")
    if not isinstance(specs, dict) or not specs:
        raise ValueError("a schema-2 registry needs models")
    models = {}
    for k, s in specs.items():
        if not isinstance(s, dict) or not str(s.get("url", "")).lower().startswith("http") or not str(s.get("file", "")).strip():
            raise ValueError(f"model {k!r} needs an http(s) url and a file")
        models[k] = Model(k, str(s.get("label", k)), str(s.get("family", "")), str(s.get("precision", "fp32")), s["url"], s["file"], str(s.get("sha256", "")).lower(), float(s.get("size_mb") or 0), bool(s.get("lossless")), bool(s.get("hidden")))
    families = {k: (str(f.get("label", k)), str(f.get("default", ""))) for k, f in (raw.get("families") or {}).items()}
    for k, (_, default) in families.items():
        if default not in models:
            raise ValueError(f"family {k!r} has an unknown default {default!r}")
    return Registry(models, families, list(raw.get("recommended") or []), str(raw.get("gui_default") or ""))


def verified(path: str, sha256: str) -> bool:
    """Whether a file's content has the digest; an empty digest accepts any file."""
    if not os.path.isfile(path):
        return False
    if not sha256:
        return True
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest() == sha256.lower()


def installed(models: DataFrame, files: DataFrame) -> DataFrame:
    """Models with the size of the first file found for each; files: file, dir_rank, bytes."""
    first = files.groupBy("file").agg(F.min(F.struct("dir_rank", "bytes")).alias("f"))
    return models.join(first, "file", "left").withColumns({"installed": F.col("f").isNotNull(), "bytes_on_disk": F.coalesce("f.bytes", F.lit(0))}).drop("f")


def family_summary(models: DataFrame) -> DataFrame:
    return models.groupBy("family").agg(F.count("*").alias("n_models"), F.count_if("installed").alias("n_present"), F.sum("bytes_on_disk").alias("bytes"))


def resolve_frame(models: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (request_id, name, want: a precision) with the id they resolve to, by priority:
    exact model, exact family, then either without regard to case; null if unknown."""
    by_id = models.select(F.lower("id").alias("k"), "id", F.col("id").alias("exact"), F.lit(None).cast("string").alias("p"), F.lit(0).alias("kind"))
    by_family = models.select(F.lower("family").alias("k"), "id", F.col("family").alias("exact"), F.col("precision").alias("p"), F.lit(1).alias("kind"))
    names = F.broadcast(by_id.unionByName(by_family))  # as many rows as the registry file has
    j = requests.join(names, F.lower("name") == F.col("k"), "left").filter("p IS NULL OR p = want")
    rank = F.col("kind") + F.when(F.col("exact") == F.col("name"), 0).otherwise(2)
    met = j.groupBy("request_id").agg(F.min(F.struct(rank.alias("r"), F.col("id"))).alias("m"))
    return requests.join(met, "request_id", "left").select("request_id", "name", "want", F.col("m.id").alias("id"))
