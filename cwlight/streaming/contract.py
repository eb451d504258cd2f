"""What a live stream declares of itself, and plans that name its channels."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from cwlight.streaming.feedback import Plan


@dataclass(frozen=True)
class StreamContract:
    """A regular stream of haemoglobin concentrations, a channel for each pair, in the order of its samples' numbers."""

    fs: float
    assay_name: str
    channel_ids: Sequence[str]
    source_index: Sequence[int]
    detector_index: Sequence[int]
    units: Sequence[str]
    assay_kind: str = "haemoglobin_concentration"
    identity_kind: str = "pair"
    name: str = ""
    clock: str = ""

    def __post_init__(self) -> None:
        if not (isinstance(self.fs, (int, float)) and math.isfinite(self.fs) and self.fs > 0):
            raise ValueError("a stream needs a regular, positive rate")
        if not self.assay_name or self.assay_kind != "haemoglobin_concentration" or self.identity_kind != "pair":
            raise ValueError("a stream must declare haemoglobin concentration of pairs, and its assay")
        ids, n = list(self.channel_ids), len(self.channel_ids)
        if not ids or not all(isinstance(x, str) and x for x in ids) or len(set(ids)) != n:
            raise ValueError("channels need names, each its own")
        if list(self.units) != ["uM"] * n:
            raise ValueError("every channel must declare unit 'uM'")
        pairs = list(zip(self.source_index, self.detector_index))
        if not len(self.source_index) == len(self.detector_index) == n or len(set(pairs)) != n or not all(isinstance(i, int) and i >= 1 for p in pairs for i in p):
            raise ValueError("every channel needs a source and a detector from 1, and no two the same")

    @property
    def fingerprint(self) -> str:
        """SHA-256 of all that is declared."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=list).encode()).hexdigest()

    def plan(self, regions: Mapping[str, Sequence[str]], contrast: Mapping[str, float] | Mapping[str, Mapping[str, float]], **pace: float) -> Plan:
        """A ``Plan`` whose regions name channels; a contrast of plain numbers has one target, ``feedback``."""
        at = {c: i for i, c in enumerate(self.channel_ids)}
        unknown = sorted({c for cs in regions.values() for c in cs} - set(at))
        if unknown:
            raise ValueError(f"regions name channels that the stream has not: {unknown}")
        plain = all(isinstance(w, (int, float)) for w in contrast.values())
        targets = {"feedback": dict(contrast)} if plain else {t: dict(w) for t, w in contrast.items()}
        return Plan(fs=float(self.fs), regions={r: tuple(at[c] for c in cs) for r, cs in regions.items()}, contrast=targets, **pace)
