"""Table contracts and merges: upserts, resumption, completeness, validation, manifests."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and rows of old whose key new does not have."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_with_backup(old: DataFrame, new: DataFrame, key: str, old_source: str, new_source: str) -> tuple[DataFrame, DataFrame]:
    """(upserted rows with ``source`` and ``replaced``, the rows that were replaced)."""
    keys = new.select(key).distinct()
    kept = old.join(keys, key, "left_anti").withColumn("source", F.lit(old_source)).withColumn("replaced", F.lit(False))
    known = old.select(key).distinct().withColumn("known_", F.lit(True))
    fresh = new.join(known, key, "left").withColumn("source", F.lit(new_source)).withColumn("replaced", F.coalesce("known_", F.lit(False))).drop("known_")
    backup = old.join(keys, key, "left_semi").withColumn("source", F.lit("backup")).withColumn("replaced", F.lit(False))
    return kept.unionByName(fresh, allowMissingColumns=True), backup


def remaining(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cells still to do."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def completeness_gaps(df: DataFrame, keys: list[str], level: str) -> DataFrame:
    """(keys, level): the cells of keys x levels that df lacks. Only levels are broadcast,
    and they are few by meaning (a panel's layers or conditions)."""
    levels = F.broadcast(df.select(level).distinct())
    return df.select(*keys).distinct().crossJoin(levels).join(df.select(*keys, level).distinct(), [*keys, level], "left_anti")


@dataclass
class Spec:
    """What a published table must satisfy."""

    name: str
    columns: list[str]
    key: list[str] = field(default_factory=list)
    min_rows: int = 1
    distinct: dict[str, int] = field(default_factory=dict)
    complete: tuple[list[str], str] | None = None


def validate(df: DataFrame, spec: Spec) -> list[str]:
    """What is wrong with a table, by one aggregate and, where asked, one anti-join."""
    missing = [c for c in spec.columns if c not in df.columns]
    if missing:
        return [f"{spec.name}: no column {c}" for c in missing]
    keys = F.struct(*[F.col(c) for c in spec.key]) if spec.key else F.lit(1)
    r = df.agg(
        F.count("*").alias("rows_"),
        F.count_distinct(keys).alias("keys_"),
        F.sum(F.greatest(*[F.col(c).isNull().cast("int") for c in [*spec.key, *spec.key]]) if spec.key else F.lit(0)).alias("nulls_"),
        *[F.count_distinct(F.col(c)).alias(f"d_{c}") for c in spec.distinct],
    ).first()
    found = []
    if r["rows_"] < spec.min_rows:
        found.append(f"{spec.name}: {r['rows_']} rows, fewer than {spec.min_rows}")
    if spec.key and r["keys_"] != r["rows_"]:
        found.append(f"{spec.name}: key {spec.key} is not unique")
    if r["nulls_"]:
        found.append(f"{spec.name}: null in key {spec.key}")
    found += [f"{spec.name}: {r[f'd_{c}']} distinct {c}, not {n}" for c, n in spec.distinct.items() if r[f"d_{c}"] != n]
    if spec.complete and not completeness_gaps(df, *spec.complete).isEmpty():
        found.append(f"{spec.name}: not every {spec.complete[0]} has every {spec.complete[1]}")
    return found


def merged_manifest(old: DataFrame, new: DataFrame, listing: DataFrame, key: str, owner: str) -> DataFrame:
    """Other owners' rows of old and all of new, for tables that are still listed."""
    kept = old.join(new.select(owner).distinct(), owner, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True).join(listing.select(key).distinct(), key, "left_semi")


def largest_difference(a: DataFrame, b: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(n, max_abs): over keys that both have."""
    j = a.select(*keys, F.col(x).alias("xa")).join(b.select(*keys, F.col(x).alias("xb")), keys)
    return j.agg(F.count("*").alias("n"), F.max(F.abs(F.col("xa") - F.col("xb"))).alias("max_abs"))


# -- filters and lookups that fail loudly --------------------------------------------------


def allowed(df: DataFrame, column: str, allow: list[str], deny: list[str] = ()) -> DataFrame:
    """Rows whose value is allowed; denied values go, and a value of neither list is an error
    that names it (at most ten)."""
    unknown = df.where(~F.col(column).isin(*allow, *deny)).select(column).distinct().limit(10).collect()
    if unknown:
        raise ValueError(f"{column} has values that no list names: {sorted(str(r[0]) for r in unknown)}")
    return df.where(F.col(column).isin(*allow))


def first_column(df: DataFrame, prefixes: list[str], name: str) -> str:
    """The name of the first column <prefix><name> that df has."""
    for p in prefixes:
        if p + name in df.columns:
            return p + name
    raise ValueError(f"no column for {name} under {prefixes}")


def metrics_present(df: DataFrame, metrics: list[str], excluded: list[str] = ()) -> list[str]:
    """The metrics, in their order, that df has with a value in some row."""
    there = [m for m in metrics if m in df.columns and m not in excluded]
    n = df.agg(*[F.count(F.nanvl(F.col(m).cast("double"), F.lit(None))).alias(m) for m in there]).first() if there else {}
    return [m for m in there if n[m]]


def lookup(df: DataFrame, by: str, records: DataFrame, key: str, expected: str, found: str) -> DataFrame:
    """df with the record of its key and ``reason``: no_match, id_mismatch (expected and
    found differ), missing_record (the record holds nothing), null if all is well."""
    r = records.withColumn("hit_", F.lit(True))
    j = df.join(r, df[by] == r[key], "left")
    reason = F.when(F.col("hit_").isNull(), "no_match").when(F.col(found).isNull(), "missing_record").when(F.col(expected) != F.col(found), "id_mismatch")
    return j.withColumn("reason", reason).drop("hit_")


def same_order(a: DataFrame, b: DataFrame, place: str, key: str) -> DataFrame:
    """(place, a, b): the places where two listings do not name the same key."""
    x, y = a.select(F.col(place).alias("place"), F.col(key).alias("a")), b.select(F.col(place).alias("place"), F.col(key).alias("b"))
    return x.join(y, "place", "full").where(~F.col("a").eqNullSafe(F.col("b")))


def disagreements(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, only_in): keys that only one of two derivations has; empty if they agree."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("only_in", F.lit("a")).unionByName(y.join(x, keys, "left_anti").withColumn("only_in", F.lit("b")))


def must_agree(a: DataFrame, b: DataFrame, keys: list[str], what: str) -> None:
    """An error that names some keys where two derivations differ."""
    rows = disagreements(a, b, keys).limit(5).collect()
    if rows:
        raise ValueError(f"{what}: derivations differ at {[tuple(r) for r in rows]}")


def repeated(registry: DataFrame, name: str, accession: str) -> DataFrame:
    """(name, problem): names that share an accession."""
    twice = registry.groupBy(accession).agg(F.count("*").alias("n_")).where("n_ > 1").select(accession)
    return registry.join(twice, accession, "left_semi").select(F.col(name).alias("name"), F.lit(f"{accession} repeated").alias("problem"))


def broken_references(members: DataFrame, key: str, registry: DataFrame, name: str) -> DataFrame:
    """(name, problem): members of no registered name, and registered names without any."""
    m, r = members.select(F.col(key).alias("name")).distinct(), registry.select(F.col(name).alias("name")).distinct()
    return m.join(r, "name", "left_anti").withColumn("problem", F.lit("unregistered")).unionByName(r.join(m, "name", "left_anti").withColumn("problem", F.lit("empty")))


def in_every(df: DataFrame, key: str, group: str) -> DataFrame:
    """(key): keys that every group has."""
    n = df.agg(F.count_distinct(group).alias("groups_"))
    return df.groupBy(key).agg(F.count_distinct(group).alias("n_")).join(n, F.col("n_") == F.col("groups_")).select(key)


def in_curated_order(df: DataFrame, label: str, curated: list[str], least: int) -> DataFrame:
    """(label, place, n): labels of enough rows in a curated order; one outside it is an error."""
    n = allowed(df, label, curated).groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.withColumn("place", F.array_position(F.array(*map(F.lit, curated)), F.col(label)).cast("int") - 1)
