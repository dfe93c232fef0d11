"""Joins that attach, check, match and chunk records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.scalars import name_similarity
from panelweave.operators.select import with_position
from panelweave.spec import assert_unique, q


def join_many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str, how: str = "left") -> DataFrame:
    """Left join that insists on unique right keys; overlapping right columns get ``suffix``."""
    assert_unique(right, keys)
    names = {c: c + suffix for c in right.columns if c not in keys and c in left.columns}
    return left.join(right.withColumnsRenamed(names), list(keys), how)


def merge_all(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Inner join of several frames on the same keys."""
    return reduce(lambda a, b: a.join(b, list(keys), "inner"), frames)


def lookup(df: DataFrame, key: str, table: Mapping, alias: str) -> DataFrame:
    """Map values through a small dictionary; unknown values give NULL."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return df.withColumn(alias, F.try_element_at(F.create_map(*pairs), q(key)))


def chained_lookup(entities: DataFrame, entity: str, links: DataFrame, records: DataFrame, link_key: str, record_key: str) -> DataFrame:
    """entity -> link -> record by two left joins on unique keys. Nothing is copied; shared links are left to Spark's skew joins."""
    return entities.join(links, link_key, "left").join(records, record_key, "left")


def best_match(
    entities: DataFrame, links: DataFrame, records: DataFrame, entity: str, entity_name: str, link_key: str, record_key: str, record_name: str
) -> DataFrame:
    """Best record per entity by name similarity among the records its link key leads to.

    Candidates come from the link table only, so there are as many as there are links - never all pairs of a
    group. Repeated links collapse before they meet the entities. Both joins are plain equi-joins: both sides are whole
    tables, so copying one for salts would cost more than the splits that Spark makes of skewed partitions; the best candidate is an aggregate (``max_by`` over score and record key)
    that combines map-side. Ties go to the highest record key. ``include_company`` is false for entities without
    any record. Distinct links are dealt over all shuffle partitions: links merged by their size as they were shuffled take
    many times as much with the names in the sort before the aggregate.
    """
    known = entities.select(entity, entity_name, link_key).distinct()
    n = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = links.select(link_key, record_key).distinct().repartition(n, link_key).join(known, link_key)
    scored = pairs.drop(link_key).join(records.select(record_key, record_name), record_key)
    score = name_similarity(q(entity_name), q(record_name))
    rank = F.struct(score.alias("score"), q(record_key).alias("record"))
    best = scored.groupBy(entity).agg(F.max_by(F.struct(q(record_key), q(record_name), score.alias("score")), rank).alias("m"))
    out = known.select(entity, entity_name).distinct().join(best, entity, "left")
    return out.select(entity, entity_name, "m.*", F.col(f"m.{record_key}").isNotNull().alias("include_company"))


def collapse_ties(scored: DataFrame, score: str) -> DataFrame:
    """One row per distinct score: the maximum of every other column."""
    return scored.groupBy(score).agg(*[F.max(q(c)).alias(c) for c in scored.columns if c != score])


def chunk_size(row_limit: int, n_columns: int, years: int) -> int:
    """Entities per request so that a request stays within ``row_limit`` cells (four quarters per year, at least 4)."""
    return max(int(row_limit / n_columns / (years * 4)) - 1, 4)


def chunk_entities(df: DataFrame, key: str, size: int) -> DataFrame:
    """Groups of ``size`` entities in key order: (request_id, entities, n). ``key`` must be unique."""
    pos = with_position(df.select(key).distinct(), key, "__pos")
    request = F.floor(F.col("__pos") / size)
    return pos.groupBy(request.alias("request_id")).agg(F.array_sort(F.collect_list(key)).alias("entities"), F.count(F.lit(1)).alias("n"))


def tag_lineage(df: DataFrame, **tags: object) -> DataFrame:
    """Append constant lineage columns such as ``request_id`` or ``report_type``."""
    return df.select("*", *[F.lit(v).alias(k) for k, v in tags.items()])


def align_results(frames: Mapping[str, DataFrame], key: str, value: str) -> DataFrame:
    """Results side by side: one column per frame, aligned on ``key`` (missing = NULL)."""
    out: DataFrame | None = None
    for name, f in frames.items():
        one = f.select(key, q(value).alias(name))
        out = one if out is None else out.join(one, key, "full_outer")
    if out is None:
        raise ValueError("no frames")
    return out
