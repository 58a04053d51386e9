"""Audits across tables: completeness, leakage, orphans, duplicates, contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.operators.grouped import first_n, lookup_join, same_keys
from rollcall.session import settle


def examples(df: DataFrame, keys: Sequence[str], value: str, n: int = 10, name: str = "examples") -> DataFrame:
    """Row count and the n smallest values per group, joined by ``|``."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    few = first_n(df, keys, [value], n).groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(value)), lambda x: x.cast("string")), "|").alias(name)
    )
    return same_keys(counts, few, keys, "left")


def completeness(left: DataFrame, right: DataFrame, key: str, n: int = 3) -> DataFrame:
    """How many keys are on both sides or on one only, with a few of them."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(F.col(key).alias("_k")).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    both = a.join(b, F.col(key) == F.col("_k"), "full_outer")
    return examples(both.select(side.alias("side"), F.coalesce(key, "_k").alias(key)), ["side"], key, n)


def require_complete(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join, or an error naming keys that one side lacks."""
    report = completeness(left, right, key).filter("side <> 'both'").collect()
    if report:
        raise ValueError("; ".join(f"{r['side']}: {r['n']} ({r['examples']})" for r in report))
    return left.join(right, key)


def align_views(
    views: Mapping[str, DataFrame], base: DataFrame, key: str, target: str, view_tol: float = 1e-3, base_tol: float = 2e-2
) -> tuple[DataFrame, DataFrame]:
    """(aligned rows, violations): every view must have the ids and targets of the others."""
    names = list(views)
    joined = base.select(key, F.col(target).alias("_y"))
    for name in names:
        view = views[name]
        renamed = view.select(key, *[F.col(c).alias(f"{name}_{c}") for c in view.columns if c != key], F.lit(True).alias(f"_in_{name}"))
        joined = joined.join(renamed, key, "full_outer")
    first = F.col(f"{names[0]}_{target}")
    problems = [F.when(F.col("_y").isNull(), F.lit("not_in_base"))]
    for name in names:
        problems.append(F.when(F.col(f"_in_{name}").isNull(), F.lit(f"missing_{name}")))
        problems.append(F.when(F.abs(F.col(f"{name}_{target}") - first) > view_tol, F.lit(f"target_{name}")))
    problems.append(F.when(F.abs(first - F.col("_y")) > base_tol, F.lit("target_base")))
    marked = joined.withColumn("problem", F.coalesce(*problems))
    hidden = [f"_in_{n}" for n in names]
    return (
        marked.filter(F.col("problem").isNull()).drop("problem", *hidden),
        marked.filter(F.col("problem").isNotNull()).select(key, "problem"),
    )


def resolve_refs(manifest: DataFrame, key: str, paths: str, listing: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities with their existing paths, audit of the missing ones).

    The lists come from single manifest rows, so regrouping them is bounded by
    the row they came from.
    """
    refs = manifest.select(
        key,
        F.size(paths).alias("n_raw"),
        F.size(F.array_distinct(paths)).alias("n_unique"),
        F.posexplode_outer(F.array_distinct(paths)).alias("pos", path),
    )
    known = listing.select(path).distinct().withColumn("_known", F.lit(True))
    marked = lookup_join(refs, known, [path]).withColumn("found", F.coalesce("_known", F.lit(False)))
    kept = marked.groupBy(key).agg(
        F.max(F.col("n_raw") - F.col("n_unique")).cast("long").alias("n_deduped"),
        F.count_if(~F.col("found") & F.col(path).isNotNull()).alias("n_missing"),
        F.array_sort(F.collect_list(F.when(F.col("found"), F.struct("pos", path)))).alias("_kept"),
    )
    kept = kept.withColumn(paths, F.transform("_kept", lambda x: x[path])).drop("_kept")
    audit = marked.filter(~F.col("found") & F.col(path).isNotNull()).select(
        F.lit("missing_in_manifest").alias("reason"), F.col(path).alias("original_path"), key
    )
    return kept, audit


def orphans(listing: DataFrame, refs: DataFrame, path: str) -> DataFrame:
    """Existing paths nobody refers to."""
    return listing.join(refs.select(path).distinct(), path, "left_anti").select(
        F.lit("orphan").alias("reason"), F.col(path).alias("original_path"), F.lit("not_referenced").alias("details")
    )


def split_leakage(
    df: DataFrame, split: str, kinds: Mapping[str, Column], splits: Sequence[str] = ("train", "val", "test"), n: int = 10
) -> DataFrame:
    """Per kind of key and pair of splits: shared keys, the first few, leak flag.

    One distinct per (kind, key, split); no pairwise joins.
    """
    long = df.select(
        split, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in kinds.items()])).alias("_k")
    ).select(split, "_k.kind", "_k.key")
    seen = long.filter(F.col("key").isNotNull() & (F.col("key") != "")).distinct()
    sets = seen.groupBy("kind", "key").agg(F.collect_set(split).alias("_s")).filter(F.size("_s") > 1)
    pairs = [f"{a}_{b}" for a, b in combinations(splits, 2)]
    present = F.array_compact(
        F.array(
            *[
                F.when(F.array_contains("_s", a) & F.array_contains("_s", b), F.lit(f"{a}_{b}"))
                for a, b in combinations(splits, 2)
            ]
        )
    )
    shared = sets.select("kind", "key", F.explode(present).alias("pair"))
    found = examples(shared, ["kind", "pair"], "key", n)
    frame = df.sparkSession.createDataFrame([(k, p) for k in kinds for p in pairs], "kind string, pair string")
    out = same_keys(frame, found, ["kind", "pair"], "left")
    return out.select(
        "kind",
        "pair",
        F.coalesce("n", F.lit(0)).cast("long").alias("shared"),
        F.coalesce("examples", F.lit("")).alias("examples"),
        (F.coalesce("n", F.lit(0)) > 0).alias("has_leakage"),
    )


def require_no_leakage(report: DataFrame) -> None:
    """Raise when a leakage report has a shared key."""
    bad = report.filter("has_leakage").collect()
    if bad:
        raise ValueError("; ".join(f"{r['kind']} {r['pair']}: {r['shared']} ({r['examples']})" for r in bad))


def disjoint_problems(collected: DataFrame, roles: DataFrame, key: str, sealed: Sequence[str] = ("val", "test")) -> DataFrame:
    """Ids collected twice, or already used in a sealed split or in train."""
    counts = collected.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    used = roles.groupBy(key).agg(
        F.bool_or(F.col("split").isin(*sealed)).alias("_sealed"), F.bool_or(F.col("split") == "train").alias("_train")
    )
    joined = counts.join(used, key, "left")
    problems = F.array_compact(
        F.array(
            F.when(F.col("_n") > 1, "duplicate_id"),
            F.when(F.col("_sealed"), "overlap_sealed"),
            F.when(F.col("_train"), "overlap_train"),
        )
    )
    return joined.select(key, F.explode(problems).alias("problem"))


def hash_conflicts(df: DataFrame, digest: str, owner: str, n: int = 5) -> DataFrame:
    """Content owned by more than one entity."""
    pairs = settle(df.filter(F.col(digest).isNotNull() & (F.col(digest) != "")).select(digest, owner).distinct())
    many = pairs.groupBy(digest).agg(F.count(F.lit(1)).alias("n_owners")).filter("n_owners > 1")
    few = first_n(lookup_join(pairs, many.select(digest), [digest], "left_semi"), [digest], [owner], n)
    few = few.groupBy(digest).agg(F.array_join(F.array_sort(F.collect_list(owner)), "|").alias("owners"))
    return many.join(few, digest)


def attach_external(base: DataFrame, external: DataFrame, key: str, target: str, pred: str, tol: float = 2e-2) -> DataFrame:
    """External predictions, only if ids match exactly and all targets agree."""
    ext = external.select(F.col(key).alias("_k"), F.col(target).alias("_t"), F.col(pred).alias("external"))
    audit = base.select(key, target).join(ext, F.col(key) == F.col("_k"), "full_outer")
    bad = F.col(key).isNull() | F.col("_k").isNull() | ~F.coalesce(F.abs(F.col(target) - F.col("_t")) <= tol, F.lit(False))
    fine = audit.agg((F.count_if(bad) == 0).alias("ok")).select("ok").scalar()
    return base.join(ext, F.col(key) == F.col("_k")).drop("_k", "_t").filter(fine)


def contract_violations(expected: DataFrame, recorded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every recorded value that is not what was expected, missing ones included."""
    fields = [c for c in expected.columns if c not in keys]
    a = expected.select(*keys, *[F.col(c).cast("string").alias(f"_e_{c}") for c in fields], F.lit(True).alias("_in_e"))
    b = recorded.select(*keys, *[F.col(c).cast("string").alias(f"_r_{c}") for c in fields], F.lit(True).alias("_in_r"))
    joined = a.join(b, list(keys), "full_outer")
    checks = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(f"_e_{c}").eqNullSafe(F.col(f"_r_{c}")),
                    F.struct(F.lit(c).alias("field"), F.col(f"_e_{c}").alias("expected"), F.col(f"_r_{c}").alias("recorded")),
                )
                for c in fields
            ]
        )
    )
    return joined.select(*keys, F.explode(checks).alias("_v")).select(*keys, "_v.*")


def manifest_drift(expected: DataFrame, realised: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys that are missing and realised keys nobody expected."""
    a = expected.select(*keys).distinct().withColumn("_e", F.lit(True))
    b = realised.select(*keys).distinct().withColumn("_r", F.lit(True))
    joined = a.join(b, list(keys), "full_outer")
    return joined.filter(F.col("_e").isNull() | F.col("_r").isNull()).select(
        *keys, F.when(F.col("_r").isNull(), "missing").otherwise("unexpected").alias("drift")
    )


def with_params(rows: DataFrame, params: DataFrame, keys: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Parameters by group, with defaults for groups that have none."""
    joined = lookup_join(rows, params, keys)
    return joined.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in defaults.items()})


def specs_rows(rows: DataFrame, specs: Sequence[tuple], fields: Sequence[str]) -> DataFrame:
    """Every row under every spec; aggregate right after, so that only partials are shuffled."""
    grid = F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, spec)]) for spec in specs])
    return rows.withColumn("_spec", F.explode(grid)).select(*rows.columns, "_spec.*")


def duplicates(df: DataFrame, key: str, size: Column, digest: Column) -> DataFrame:
    """Content duplicates: only rows whose size collides are hashed; the smallest key stays.

    The kept key is a per-hash minimum joined back to the copies, so that a hash
    with very many copies is not gathered anywhere.
    """
    sized = df.withColumn("_size", size)
    colliding = sized.groupBy("_size").count().filter("count > 1").select("_size")
    hashed = lookup_join(sized, colliding, ["_size"], how="left_semi").select(key, digest.alias("digest"))
    first = hashed.groupBy("digest").agg(F.min(key).alias("same_content_as"), F.count(F.lit(1)).alias("n_copies"))
    joined = lookup_join(hashed, first.filter("n_copies > 1"), ["digest"], how="inner")
    return joined.filter(F.col(key) != F.col("same_content_as"))


def union_all(tables: Sequence[DataFrame], missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), tables)
