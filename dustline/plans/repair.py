"""The whole repair of frames: analysis, decision, reconstruction, writer, output."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dustline.operators import analysis, banded, stencil, writer
from dustline.sources.frames import cut


def stages(px: DataFrame, engine: str = "banded", hidden: bool = True) -> dict[str, DataFrame]:
    """The tables of a repair: rows (calibration), scored, decided, starts, sites and values.

    engine: `banded` computes neighbourhoods on arrays, one band of rows at a time; `expr` by window expressions. They agree bit for bit.
    hidden: whether the hidden rows before a frame draw from its random sequence; without them it begins at its seed.
    """
    work = analysis.working(px)
    rows = cut(analysis.calibration(analysis.latch(work)))
    scored = cut(analysis.weighted_planes(analysis.score_plane(analysis.auxiliary_plane(work, rows))))
    decided = cut(analysis.eligible(analysis.decision(scored)))
    starts = banded.startups(scored, rows)
    sites = {"banded": banded, "expr": stencil}[engine].reconstruction(scored, decided)
    return {"rows": rows, "scored": scored, "decided": decided, "starts": starts, "sites": sites, "values": writer.written(sites, starts if hidden else None)}


def repair(px: DataFrame, engine: str = "banded", hidden: bool = True) -> DataFrame:
    """frame_id, y, x, r, g, b with attempted, written and changed, for every pixel."""
    s = stages(px, engine, hidden)
    return writer.rendered(s["scored"], s["values"])
