"""Receipts of a regional repair: a canonical document of what went in and came out, its semantic checks, and its replay.

A receipt holds one frame's numbers and digests, so it is small; everything that it states is recomputed from tables by aggregates, joins and the repair itself.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustline.operators import composite as C
from dustline.operators import regions as R
from dustline.sources.frames import canonical_json, content_hash, cut

#: Every artefact that a receipt names has one of these roles, and each role is named exactly once.
ROLES = ("cache_manifest", "composite", "mask", "source")
COUNTS = ("frame_pixels", "at_floor_pixels", "synth_pixels", "non_floor_pixels", "regions", "routed_regions", "absorbed_regions", "routed_pixels", "absorbed_pixels")
KEYS = {"artefacts", "census", "cache_manifest_sha256", "composite_sha256", "frame_id", "limit", "provenance", "source_sha256", "version"}
_SHA = re.compile("[0-9a-f]{64}")


def provenance(source: str, device: str, statement: str) -> dict:
    """What a caller asserts about where a capture comes from; kept apart from what is measured."""
    if not all((source, device, statement)):
        raise ValueError("an assertion of provenance leaves nothing out")
    return {"asserted_by": "caller", "device": device, "source": source, "statement": statement}


def build(frame_id: str, source: DataFrame, routed: dict[str, DataFrame], image: DataFrame, anchor: str, artefacts: list[dict], limit: str, asserted: dict) -> bytes:
    """The receipt of one frame as canonical bytes; source and image are its pixels, artefacts rows of role, n_bytes and sha256."""
    own = F.col("frame_id") == frame_id
    census = routed["census"].where(own).select(*COUNTS).first().asDict()
    digest = lambda px: content_hash(px.where(own)).first()["sha256"]
    document = {
        "artefacts": sorted(artefacts, key=lambda a: a["role"]), "cache_manifest_sha256": anchor, "census": census, "composite_sha256": digest(image), "frame_id": frame_id, "limit": limit,
        "provenance": asserted, "source_sha256": digest(source), "version": 1,
    }
    if found := problems(document):
        raise ValueError("; ".join(found))
    return canonical_json(document)


def problems(document: dict) -> list[str]:
    """What contradicts itself in a receipt, apart from any data."""
    if set(document) != KEYS:
        return [f"keys are {sorted(document)}"]
    out, c = [], document["census"]
    if set(c) != set(COUNTS) or not all(type(v) is int and v >= 0 for v in c.values()):
        return ["counts are missing or aren't counts"]
    named = Counter(a.get("role") for a in document["artefacts"])
    out += [f"role {r} occurs {named[r]} times" for r in ROLES if named[r] != 1] + [f"role {r} isn't known" for r in named if r not in ROLES]
    digests = [document["cache_manifest_sha256"], document["composite_sha256"], document["source_sha256"], *(a.get("sha256") for a in document["artefacts"])]
    out += ["a digest isn't one"] * (not all(isinstance(d, str) and _SHA.fullmatch(d) for d in digests))
    by = {a.get("role"): a.get("sha256") for a in document["artefacts"]}
    out += [f"{role} differs from its artefact" for role, key in (("cache_manifest", "cache_manifest_sha256"), ("composite", "composite_sha256"), ("source", "source_sha256")) if by.get(role) != document[key]]
    if c["synth_pixels"] != c["routed_pixels"] + c["absorbed_pixels"] + c["non_floor_pixels"]:
        out.append("synthesis pixels don't add up")
    if c["at_floor_pixels"] > c["frame_pixels"] or c["routed_regions"] + c["absorbed_regions"] > c["regions"]:
        out.append("a part is larger than its whole")
    return out


def replay(spark: SparkSession, receipt: bytes, source: DataFrame, planes: DataFrame, image: DataFrame, anchor: str) -> DataFrame:
    """(check, ok): the receipt's form, then its routing and composite made again from source and cached planes and held against what it states and against image.

    source and image: (frame_id, y, x, r, g, b); planes: a verified cache's, with at_floor.
    """
    from json import loads

    document = loads(receipt)
    out = [("canonical", canonical_json(document) == receipt), ("semantics", not problems(document)), ("cache_manifest", document.get("cache_manifest_sha256") == anchor)]
    if not out[1][1]:
        return spark.createDataFrame(out, "check string, ok boolean")
    own = F.col("frame_id") == document["frame_id"]
    source, image = source.where(own), image.where(own)
    routed = R.route(planes.where(own).select("frame_id", "y", "x", F.col("at_floor").alias("mask")), document["limit"])
    census = routed["census"].select(*COUNTS).first()
    out.append(("source", content_hash(source).first()["sha256"] == document["source_sha256"]))
    out.append(("routing", census is not None and census.asDict() == document["census"]))
    again = cut(C.composite(source, routed["synth"], routed["final"], census=routed["census"])["image"])
    out.append(("composite", content_hash(image).first()["sha256"] == document["composite_sha256"]))
    a = image.select("frame_id", "y", "x", F.struct("r", "g", "b").alias("a"))
    differs = a.join(again.select("frame_id", "y", "x", F.struct("r", "g", "b").alias("b")), ["frame_id", "y", "x"], "full").where("NOT (a <=> b)")
    out.append(("composite_replay", not differs.limit(1).count()))
    out.append(("outside_mask", not C.outside_changes(source, image, routed["synth"]).limit(1).count()))
    return spark.createDataFrame(out, "check string, ok boolean")


def digest(receipt: bytes) -> str:
    return hashlib.sha256(receipt).hexdigest()
