"""Sources joined on time."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..axis import Axis
from .time_axis import deduplicated


def merge_by_time(sources, axis: Axis, how: str = "outer", prefix: bool | None = None, sep: str = "_", drop_empty: bool = True, duplicates: str | bool = "first") -> DataFrame:
    """Join frames on the axis's keys and timestamp. ``prefix``: True names all columns by their source, None those
    that several sources have, False raises ValueError on such. Columns without any value go first."""
    if how not in ("outer", "inner"):
        raise ValueError("how must be outer or inner")
    on = [*axis.keys, axis.ts]
    frames = {}
    for label, df in (sources if isinstance(sources, dict) else {str(i): s for i, s in enumerate(sources)}).items():
        df = deduplicated(df, axis, duplicates or "drop")
        rest = [c for c in df.columns if c not in on]
        if drop_empty and rest:
            n = df.agg(*(F.count(F.nanvl(F.col(c), F.lit(None)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)).alias(c) for c in rest)).first()
            rest = [c for c in rest if n[c]]
        frames[label] = df.select(*on, *rest)
    counts = Counter(c for f in frames.values() for c in f.columns if c not in on)
    shared = {c for c, n in counts.items() if n > 1}
    if shared and prefix is False:
        raise ValueError(f"several sources have {sorted(shared)}")
    out = None
    for label, df in frames.items():
        named = df.withColumnsRenamed({c: f"{label}{sep}{c}" for c in df.columns if c not in on and (prefix or prefix is None and c in shared)})
        out = named if out is None else out.join(named, on, "full" if how == "outer" else "inner")
    return out
