"""Regions, settings, lookups and the cache catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.geo import CONTINENT_ORDER, continent_case
from gridspark.operators import names

#: code: west, south, east, north. Fixed values.
RIVER_REGIONS = {"af": (-20, -35, 55, 38), "ar": (-180, 60, 180, 90), "as": (57, -5, 180, 60), "au": (112, -48, 180, -5), "eu": (-25, 35, 65, 72), "na": (-170, -10, -35, 85), "sa": (-82, -56, -28, 15), "si": (50, 47, 180, 75)}
#: Metres of road width by highway tag; others 3. Fixed values.
HIGHWAY_WIDTH = {
    "motorway": 12.0, "motorway_link": 6.0, "trunk": 10.0, "trunk_link": 5.0, "primary": 8.0, "primary_link": 4.0, "secondary": 7.0, "secondary_link": 3.5, "tertiary": 6.0, "tertiary_link": 3.0, "residential": 4.0,
    "living_street": 3.0, "service": 2.0, "track": 2.0, "footway": 1.5, "path": 1.5, "cycleway": 1.5, "steps": 1.0, "pedestrian": 3.0, "unclassified": 4.0,
}
#: Seconds an entry stays fresh, by namespace. Fixed values.
TTL = {"dem": 30 * 86400, "water": 14 * 86400, "satellite": 14 * 86400, "osm": 7 * 86400, "composite": 30 * 86400, "opentopo": 90 * 86400}


def _rows(df: DataFrame, rows, schema: str) -> DataFrame:
    """A lookup table of fixed size, broadcast."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def river_regions(boxes: DataFrame) -> DataFrame:
    """Each box with the codes of the river regions it overlaps; the eight regions are broadcast."""
    t = _rows(boxes, [(c, *map(float, b)) for c, b in RIVER_REGIONS.items()], "code string, __w double, __s double, __e double, __n double")
    return boxes.join(t, (F.col("west") < F.col("__e")) & (F.col("east") > F.col("__w")) & (F.col("south") < F.col("__n")) & (F.col("north") > F.col("__s"))).drop("__w", "__s", "__e", "__n")


def layers_by_tags(features: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Features with each layer one of whose (key, value) rules a tag meets; every (feature, layer) once."""
    t = _rows(features, rules, "layer string, __k string, __v string")
    tags = features.select("*", F.explode("props").alias("__tk", "__tv"))
    return tags.join(t, (F.col("__tk") == F.col("__k")) & (F.col("__tv") == F.col("__v"))).drop("__tk", "__tv", "__k", "__v").dropDuplicates(["feature_id", "layer"])


def violations(df: DataFrame, rules: list[tuple], name: str) -> DataFrame:
    """(name, violation): rules are (column, least, most, strict); with strict the least value itself is out."""
    bad = []
    for c, lo, hi, strict in rules:
        out = F.lit(False)
        if lo is not None:
            out = out | (F.col(c) <= lo if strict else F.col(c) < lo)
        if hi is not None:
            out = out | (F.col(c) > hi)
        bad.append(F.when(out, c))
    return df.select(name, F.explode(F.array_compact(F.array(*bad))).alias("violation"))


def layers_by_rules(features: DataFrame, rules: list[tuple[str, str, str | None, tuple[str, ...]]]) -> DataFrame:
    """(feature_id, layer): rules are (layer, key, value or None for any, geometry types). A feature belongs to a layer if a tag and its geom_type meet one of its rules."""
    t = _rows(features, [(a, k, v, list(g)) for a, k, v, g in rules], "layer string, __k string, __v string, __g array<string>")
    tags = features.select("feature_id", "geom_type", F.explode("props").alias("__tk", "__tv"))
    met = (F.col("__tk") == F.col("__k")) & (F.col("__v").isNull() | (F.col("__tv") == F.col("__v"))) & F.array_contains("__g", F.col("geom_type"))
    return tags.join(t, met).select("feature_id", "layer").distinct()


def parameter_violations(df: DataFrame, name: str, ranges: list[tuple] = (), allowed: dict[str, tuple] | None = None, whole: dict[str, int] | None = None) -> DataFrame:
    """(name, violation) of all rules that a row breaks: ranges as in violations(), allowed values by column, and columns that must be whole and at least a
    number. A null breaks no rule."""
    bad = [df.select(name, F.lit(None).cast("string").alias("violation")).where("false")]
    if ranges:
        bad.append(violations(df, list(ranges), name))
    more = [F.when(~F.col(c).isin(*v), F.lit(f"{c} not allowed")) for c, v in (allowed or {}).items()]
    more += [F.when((F.col(c) != F.floor(c)) | (F.col(c) < least), F.lit(f"{c} not whole or below {least}")) for c, least in (whole or {}).items()]
    if more:
        bad.append(df.select(name, F.explode(F.array_compact(F.array(*more))).alias("violation")))
    out = bad[0]
    for b in bad[1:]:
        out = out.unionByName(b)
    return out


def overlay(ids: DataFrame, saved: DataFrame, defaults: list[tuple[str, str, str]], key: str) -> DataFrame:
    """Defaults (group, key, value) overlaid for each id by its saved (key, value); unknown saved keys are left out."""
    d = _rows(ids, defaults, "grp string, key string, __d string")
    return ids.crossJoin(d).join(saved, [key, "key"], "left").select(key, "grp", "key", F.coalesce("value", "__d").alias("value"))


def merge(current: DataFrame, changes: DataFrame, key: str, seq: str, put: str) -> DataFrame:
    """Current rows with a change set applied: the last change of a key wins, put or delete."""
    cols = [c for c in current.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(put, *cols), seq).alias("__c"))
    out = current.join(last, key, "full_outer").where(F.col("__c").isNull() | F.col(f"__c.{put}"))
    return out.select(key, *(F.when(F.col("__c").isNotNull(), F.col(f"__c.{c}")).otherwise(F.col(c)).alias(c) for c in cols))


def newest(entries: DataFrame, most: int) -> DataFrame:
    """The newest `most` entries of each namespace with their rank n. They are cut down within hash parts first, so that no task ranks a whole namespace."""
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("cached_at"), F.desc("event_id")))
    some = entries.withColumn("__part", F.pmod(F.xxhash64("event_id"), F.lit(parts))).withColumn("n", rank("namespace", "__part")).where(F.col("n") <= most)
    return some.drop("__part").withColumn("n", rank("namespace")).where(F.col("n") <= most)


def prune(entries: DataFrame, now: Column, most: int) -> DataFrame:
    """All entries with why they go: stale past their namespace's time, excess beyond the newest `most` fresh ones, else null.

    An entry is in excess if it comes after the last one of the newest `most`, a row per namespace."""
    t = _rows(entries, list(TTL.items()), "namespace string, __ttl long")
    aged = entries.join(t, "namespace").withColumn("__fresh", F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("cached_at").cast("timestamp")) <= F.col("__ttl") * 1000000)
    last = newest(aged.where("__fresh").select("namespace", "cached_at", "event_id"), most).where(F.col("n") == most).select("namespace", F.struct("cached_at", "event_id").alias("__last"))
    out = aged.join(F.broadcast(last), "namespace", "left")  # a row per namespace of TTL
    return out.withColumn("why", F.when(~F.col("__fresh"), "stale").when(F.struct("cached_at", "event_id") < F.col("__last"), "excess")).drop("__ttl", "__fresh", "__last")


def by_continent(regions: DataFrame) -> DataFrame:
    """(continent, names, position): a non-blank label overrides the continent of the centre; known continents come first."""
    lat, lon = (F.col("north") + F.col("south")) / 2, (F.col("east") + F.col("west")) / 2
    r = regions.withColumn("lat", lat).withColumn("lon", lon).withColumn("continent", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.expr(continent_case())))
    at = F.array_position(F.array(*map(F.lit, CONTINENT_ORDER)), F.col("continent"))
    return r.groupBy("continent").agg(F.array_sort(F.collect_list("name")).alias("names")).withColumn("position", F.when(at > 0, at).otherwise(len(CONTINENT_ORDER) + 1).cast("int"))


def cache_status(entries: DataFrame, recent: int, now: Column | None = None) -> DataFrame:
    """Per namespace: entries, bytes and the most recent ids with, where now is given, their ages in whole seconds; the ranks are cut before anything is collected."""
    age = F.lit(None).cast("long") if now is None else (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("cached_at").cast("timestamp")))
    top = newest(entries, recent).groupBy("namespace").agg(F.array_sort(F.collect_list(F.struct("n", "event_id", age.alias("age")))).alias("t"))
    both = entries.groupBy("namespace").agg(F.count("*").alias("entries"), F.sum("size_bytes").alias("bytes")).join(top, "namespace")
    listed = lambda c: F.array_join(F.transform("t", lambda x: x[c].cast("string")), ",")
    return both.select("namespace", "entries", "bytes", listed("event_id").alias("recent"), *([] if now is None else [listed("age").alias("ages")]))


def with_settings(regions: DataFrame, settings: DataFrame) -> DataFrame:
    return regions.join(settings, "name", "left").withColumn("settings", F.coalesce("settings", F.lit("{}")))


def without_regions(settings: DataFrame, regions: DataFrame) -> DataFrame:
    """Settings of regions that still exist (the cascade of a delete)."""
    return settings.join(regions.select("name"), "name", "left_semi")


def lookup(want: DataFrame, entries: DataFrame, since: Column) -> tuple[DataFrame, DataFrame]:
    """Keys that have a fresh entry, and keys to fetch."""
    fresh = entries.where(F.col("cached_at") >= since).select("namespace", "key").distinct()
    return want.join(fresh, ["namespace", "key"], "left_semi"), want.join(fresh, ["namespace", "key"], "left_anti")


def best_at_most(want: DataFrame, have: DataFrame, key: str, limit: str, scale: str, by: list[str]) -> DataFrame:
    """(by, key, best, nearest): of the same key's scales within the limit the finest (least) and the one nearest the limit. Rows with none are left out.

    The nearest one is an as-of match by a sort of both tables' rows within ranges of scales, so that a frequent key is many tasks; what lies before a range is an entry of the key's array."""
    both = have.select(F.col(scale).alias("__at")).union(want.select(limit))
    at = lambda c: F.col(c).cast(both.schema["__at"].dataType).alias("__at")
    bounds = names.bounds_of(both, "__at")
    scales = names.in_ranges(have.select(key, at(scale)).where(F.col(key).isNotNull() & F.col("__at").isNotNull()).distinct(), "__at", bounds)
    ends = scales.groupBy(key, "__range").agg(F.min("__at").alias("least"), F.max("__at").alias("most"))
    keys = ends.groupBy(key).agg(F.min("least").alias("best"), F.min("__range").alias("__first"), F.array_sort(F.collect_list(F.struct("__range", "most"))).alias("__ends"))  # an entry a range
    until = lambda a, b: F.array_repeat(a["most"], F.coalesce(b["__range"], F.lit(len(bounds) + 1)) - a["__range"])
    keys = keys.withColumn("__most", F.flatten(F.zip_with("__ends", F.slice("__ends", 2, len(bounds) + 1), until))).drop("__ends")  # from the range after the first one on
    met = names.in_ranges(want.select(key, at(limit), *by).join(keys, key).where(F.col("best") <= F.col("__at")), "__at", bounds)
    met = met.withColumn("__before", F.get("__most", F.col("__range") - F.col("__first") - 1)).drop("__most", "__first")
    w = Window.partitionBy(key, "__range").orderBy("__at", F.asc_nulls_last("__scale")).rowsBetween(Window.unboundedPreceding, 0)
    rows = met.unionByName(scales.withColumn("__scale", F.col("__at")), allowMissingColumns=True)
    return rows.withColumn("__in", F.last("__scale", ignorenulls=True).over(w)).where("best is not null").select(*by, key, "best", F.coalesce("__in", "__before").alias("nearest"))


def road_width(roads: DataFrame) -> DataFrame:
    """roads plus width_m by their highway tag, or by the first one of a list of tags; an empty list counts as unclassified, unknown tags are 3 m wide."""
    listed = roads.schema["highway"].dataType.typeName() == "array"
    tag = F.when(F.size("highway") > 0, F.get("highway", F.lit(0))).when(F.col("highway").isNotNull(), "unclassified") if listed else F.col("highway")
    t = _rows(roads, list(HIGHWAY_WIDTH.items()), "__tag string, width_m double")
    return roads.join(t, tag == F.col("__tag"), "left").withColumn("width_m", F.coalesce("width_m", F.lit(3.0))).drop("__tag")


def settings_of(saved: Column, defaults: dict[str, dict[str, str]]) -> Column:
    """Settings as a map of groups to maps, values as JSON texts: defaults (group, key, JSON text) under a saved JSON object.

    An object whose first value is an object itself is grouped: each of the defaults' groups takes all of its keys. Another is flat: each key goes to the first group that has
    it, and keys that no group has are left out. A null or unreadable text changes nothing.
    """
    text = "map<string,string>"
    entry = lambda m: F.map_from_arrays(F.array(*map(F.lit, m)), F.array(*map(F.lit, m.values())))
    base = F.map_from_arrays(F.array(*map(F.lit, defaults)), F.array(*(entry(m) for m in defaults.values())))
    flat = F.coalesce(F.from_json(saved, text), F.create_map().cast(text))
    over = lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))
    is_object = lambda v: F.coalesce(F.startswith(F.ltrim(v), F.lit("{")), F.lit(False))
    grouped = F.transform_values(F.map_filter(flat, lambda g, v: F.array_contains(F.map_keys(base), g) & is_object(v)), lambda g, v: F.from_json(v, text))
    owner = {k: g for g, m in reversed(defaults.items()) for k in m}
    own = F.map_from_arrays(F.array(*map(F.lit, owner)), F.array(*map(F.lit, owner.values())))
    routed = lambda g: F.map_filter(flat, lambda k, v: F.try_element_at(own, k) == g)
    by_group = F.map_zip_with(base, grouped, lambda g, a, b: F.when(b.isNull(), a).otherwise(over(a, b)))
    by_key = F.transform_values(base, lambda g, a: over(a, routed(g)))
    return F.when(is_object(F.get(F.map_values(flat), F.lit(0))), by_group).otherwise(by_key)


def setting(settings: Column, group: str, key: str, kind: str) -> Column:
    """One setting by its type; null if it is missing or of another kind."""
    return F.try_variant_get(F.try_parse_json(F.try_element_at(F.try_element_at(settings, F.lit(group)), F.lit(key))), "$", kind)
