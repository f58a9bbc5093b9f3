"""Cloud resource ids, business tags and the sightings of entities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R


def parse_resource_id(raw: Column, rules: list[tuple[str, str, int, str, int]] = R.RESOURCE_IDS, regions: dict[str, str] = R.ZONES) -> Column:
    """Struct ``provider, region, entity_type, name, matched`` of the first rule whose pattern matches the whole id.

    A rule: provider, anchored pattern, group of the zone or region (0: none), entity type,
    group of the name. Zones that ``regions`` does not know stand for themselves.
    """
    table = F.create_map(*[F.lit(x) for pair in regions.items() for x in pair]) if regions else F.create_map().cast("map<string,string>")
    shape = "struct<provider:string,region:string,entity_type:string,name:string,matched:boolean>"

    def found(provider: str, pattern: str, zone: int, kind: str, name: int) -> Column:
        place = F.regexp_extract(raw, pattern, zone) if zone else F.lit("")
        out = F.struct(F.lit(provider), F.coalesce(F.element_at(table, place), place), F.lit(kind), F.regexp_extract(raw, pattern, name), F.lit(True))
        return F.when(raw.rlike(pattern), out.cast(shape))

    unknown = F.struct(F.lit("unknown"), F.lit(""), F.lit(None).cast("string"), F.coalesce(raw, F.lit("")), F.lit(False)).cast(shape)
    return F.coalesce(*[found(*rule) for rule in rules], unknown)


def _map(tags: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in tags.items() for x in pair]).cast("map<string,string>")


def _over(base: Column, top: Column) -> Column:
    """Both maps; of a key in both, the value of ``top``."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k)), top)


def business_tags(entity_type: Column, name: Column, defaults: dict[str, str] = R.TAG_DEFAULTS, by_type: dict[str, dict[str, str]] = R.TAGS_BY_TYPE, rules: list[tuple[str | None, str, dict[str, str]]] = R.TAG_RULES) -> Column:
    """Defaults, over them the tags of the type, over them those of the first rule (type or None, pattern found in the name, tags)."""
    kinds = F.coalesce(*[F.when(entity_type == kind, _map(tags)) for kind, tags in by_type.items()], _map({}))
    hits = [F.when((F.lit(True) if kind is None else entity_type == kind) & name.rlike(pattern), _map(tags)) for kind, pattern, tags in rules]
    return _over(_over(_map(defaults), kinds), F.coalesce(*hits, _map({})))


def dedup_entities(sightings: DataFrame, ttl_seconds: int = 300) -> DataFrame:
    """One row per active window of an entity (``entity_id, raw_id, ts``); a window opens at the first sighting ``ttl_seconds`` after the last opening.

    An opening depends on the one before it, so a task walks the times of its entities in
    order: rows are partitioned by entity and sorted by Spark and stream through in
    batches, and only the current opening is kept. A hot entity needs one pass, no memory.
    """
    limit = ttl_seconds * 1_000_000

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity, opened = None, 0
        for batch in batches:
            out = np.empty(len(batch), np.int64)
            for k, (e, t) in enumerate(zip(batch["entity_id"], batch["at"], strict=True)):
                if e != entity or t - opened >= limit:
                    entity, opened = e, t
                out[k] = opened
            yield pd.DataFrame({"entity_id": batch["entity_id"], "at": batch["at"], "opened": out})

    # Distinct times alone are walked, so many sightings at one time are one row.
    times = sightings.where("entity_id IS NOT NULL AND ts IS NOT NULL").select("entity_id", F.unix_micros("ts").alias("at")).distinct()
    kind = times.schema["entity_id"].dataType.simpleString()
    opened = times.repartition("entity_id").sortWithinPartitions("entity_id", "at").mapInPandas(walk, f"entity_id {kind}, at long, opened long")
    rows = sightings.withColumn("at", F.unix_micros("ts")).join(opened, ["entity_id", "at"])
    out = rows.groupBy("entity_id", "opened").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("sightings"), F.sort_array(F.collect_set("raw_id")).alias("raw_ids"))
    return out.drop("opened")
