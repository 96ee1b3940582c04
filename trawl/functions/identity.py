"""Identity of packages: ids and versions from paths, version order, evidence tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions import rules

SEMVER = r"v?\d+(?:\.\d+){1,3}(?:[-+][\w.]+)?"


def identify(path: Column, is_dir: Column) -> Column:
    """``struct(id, publisher, name, version)`` of a package path.

    ``<pub.name>-<version>`` in the name itself, else a version as the name under the id, else
    a version folder under the id.
    """
    parts = F.split(F.regexp_replace(path, r"/+$", ""), "/")
    part = lambda k: F.coalesce(F.try_element_at(parts, F.lit(-k)), F.lit(""))
    base = F.when(is_dir, part(1)).otherwise(F.regexp_replace(part(1), r"(?<=.)\.[^.]*$", ""))
    parent, grand = part(2), part(3)
    named = F.when(is_dir & (base == "extension"), parent).otherwise(base)
    own_id, own_version = (F.regexp_extract(named, rf"^(.+?)-({SEMVER})$", k) for k in (1, 2))
    own, is_version = own_id.contains("."), lambda c: c.rlike(rf"^{SEMVER}$")
    found = F.when(own, own_id).when(is_version(base), parent).when(is_version(parent), grand).otherwise(base)
    found = F.when((found == "extension") & is_version(parent), grand).otherwise(found)
    version = F.when(own, own_version).when(is_version(base), base).when(is_version(parent), parent).otherwise("")
    dot = F.instr(found, ".")
    return F.struct(
        found.alias("id"),
        F.when(dot > 1, F.substring(found, F.lit(1), dot - 1)).otherwise("").alias("publisher"),
        F.when(dot > 1, F.substring(found, dot + 1, F.length(found))).otherwise(found).alias("name"),
        F.regexp_replace(version, "^v", "").alias("version"),
    )


def sample_key(id_: Column, version: Column) -> Column:
    """Ids ignore case, versions don't."""
    return F.concat(F.lower(id_), F.lit("@"), version)


def version_order(version: Column) -> Column:
    """An array that sorts as versions do: parts by number, a part without digits or missing as -1."""
    parts = F.transform(F.split(version, r"[.\-+]"), lambda p: F.coalesce(F.try_to_number(F.regexp_extract(p, r"^\s*([+-]?\d{1,18})", 1), F.lit("S999999999999999999")).cast("long"), F.lit(-1)))
    last = F.array_max(F.transform(parts, lambda p, i: F.when(p != -1, i + 1).otherwise(0)))
    return F.slice(parts, F.lit(1), F.greatest(last, F.lit(0)))


def tier_of(classification: Column) -> Column:
    """Evidence tier of a removal reason; of several reasons the strongest, an unknown one is policy."""
    raw = F.lower(F.trim(F.regexp_replace(F.coalesce(classification, F.lit("")), r'^"+|"+$', "")))
    known = F.create_map(*(F.lit(x) for pair in rules.TIERS.items() for x in pair))
    rank = F.create_map(*(F.lit(x) for i, t in enumerate(rules.TIER_NAMES) for x in (t, i)))
    tier = lambda part: F.coalesce(F.try_element_at(known, F.trim(part)), F.lit("policy"))
    best = F.array_max(F.transform(F.split(raw, r"[;,|]"), lambda p: F.try_element_at(rank, tier(p))))
    names = F.array(*map(F.lit, rules.TIER_NAMES))
    return F.when(raw == "", "unknown").otherwise(F.coalesce(F.try_element_at(known, raw), F.try_element_at(names, best + 1)))
