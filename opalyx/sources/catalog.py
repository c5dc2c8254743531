"""Source catalogue and ingest batches: configuration read on the driver, used as small tables."""

from __future__ import annotations

import glob
import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Source:
    source_id: str
    name: str
    kind: str
    jurisdiction: str
    base_url: str
    scan_method: str = "api"
    extractor: str = "generic"
    collector: str | None = None
    verifier: str | None = None
    source_tier: str = "secondary"
    priority: float = 0.5
    enabled: bool = True
    url_list: list[str] = field(default_factory=list)
    buyer_allowlist: list[str] = field(default_factory=list)
    regions: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    notes: str | None = None
    pack: str | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.priority <= 1:
            raise ValueError(f"{self.source_id}: priority must be from 0 to 1")


def _load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f) or {}
        import yaml  # where the configuration is in YAML

        return yaml.safe_load(f) or {}


def line_list(path: str) -> list[str]:
    """Lines of a list file without comments, blanks and repeats."""
    with open(path, encoding="utf-8") as f:
        return list(dict.fromkeys(s for line in f if (s := line.split("#")[0].strip())))


def load_catalog(path: str, _above: tuple[str, ...] = ()) -> list[Source]:
    """Sources of a file and of all it includes (paths or patterns, relative to it). A cycle or a repeated id is an error."""
    path = os.path.abspath(path)
    if path in _above:
        raise ValueError("include cycle: " + " -> ".join((*_above, path)))
    folder, data, out = os.path.dirname(path), _load(path), []
    for pattern in data.get("include", []):
        found = sorted(glob.glob(os.path.join(folder, pattern)))
        if not found and not glob.has_magic(pattern):
            raise FileNotFoundError(os.path.join(folder, pattern))
        for one in found:
            out += load_catalog(one, (*_above, path))
    for raw in data.get("sources") or []:
        values = dict(raw)
        for key in ("url_list", "buyer_allowlist"):
            if listed := values.pop(f"{key}_path", None):
                values[key] = list(dict.fromkeys([*values.get(key, []), *line_list(os.path.join(folder, listed))]))
        out.append(Source(**{"pack": os.path.splitext(os.path.basename(path))[0]} | values))
    if not _above:
        ids = [s.source_id for s in out]
        if repeated := sorted({i for i in ids if ids.count(i) > 1}):
            raise ValueError("repeated source ids: " + ", ".join(repeated))
    return out


def catalog_frame(spark: SparkSession, sources: list[Source]) -> DataFrame:
    schema = "source_id string, name string, kind string, jurisdiction string, base_url string, scan_method string, extractor string, collector string, verifier string, source_tier string, priority double, enabled boolean, url_list array<string>, buyer_allowlist array<string>, regions array<string>, languages array<string>, notes string, pack string"
    return spark.createDataFrame([tuple(asdict(s).values()) for s in sources], schema)


@dataclass
class Batch:
    batch_id: str
    include_kinds: list[str] = field(default_factory=list)
    include_source_ids: list[str] = field(default_factory=list)
    exclude_source_ids: list[str] = field(default_factory=list)
    enabled_only: bool = True
    limit_per_source: int = 20
    publication_window_days: int | None = None


#: The scheduled batches.
SCHEDULE = {"official_daytime": (["06:30", "14:30"], 7), "secondary_nightly": (["02:30"], 30)}


def select_sources(sources: list[Source], batch: Batch) -> list[Source]:
    """Sources of a batch; ids that no source has, or an empty result, are errors."""
    if missing := sorted(set(batch.include_source_ids) - {s.source_id for s in sources}):
        raise ValueError("unknown source ids: " + ", ".join(missing))
    chosen = bool(batch.include_source_ids or batch.include_kinds)
    out = [s for s in sources if s.source_id not in batch.exclude_source_ids and (s.enabled or not batch.enabled_only) and (not chosen or s.source_id in batch.include_source_ids or s.kind in batch.include_kinds)]
    if not out:
        raise ValueError(f"batch {batch.batch_id} has no sources")
    return out
