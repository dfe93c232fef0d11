"""Merkle manifest of a dataset: a tree of digests for each key, and one over their tops; few levels are kept.

Every row is a leaf. The leaves of a key, in order, are hashed in runs of eight, the digests again, until one is left: the
key's subroot. The subroots, in the order of the keys, are the leaves of the top tree, which ends in the root.

*Checkpoint*: only every third level of a tree is written. The tables hold one row for each aligned subtree of 512 nodes,
the digests of its bottom level in an array; a subtree's top comes from that array alone.

*Recompute*: proofs are made from the top down, one written level after the other. A subtree's row meets the path of its
own top, its two missing levels are hashed anew from the stored array, the siblings of every node at the bottom are sent
on, and the interior nodes are dropped. No level is ever gathered: a row never holds more than 512 nodes, and the number
of jobs is the number of written levels (three for a thousand billion leaves).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.llm.common import free_names, q, shuffle_partitions, stage

#: A power of two, eight children: positions lose three bits a level.
ARITY = 8
#: Levels from one written level to the next, and nodes of an aligned subtree's bottom level.
STRIDE = 3
SPAN = ARITY**STRIDE
#: Levels of the tallest tree whose leaves a long can count.
MOST = 21

PATH = "array<struct<left:string,right:string>>"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row: each field as its UTF-8 byte count, a colon and its text, or ``-`` where it is null."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return sha(F.concat(*parts))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; ``lower`` does that where every character is one byte, and is faster."""
    mapped = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(mapped)


def _folded(nodes: Column) -> Column:
    """The next level: every run of eight, the last maybe shorter, hashed."""
    runs = F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, 3))
    return F.transform(runs, lambda i: sha(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), "")))


def _with_levels(df: DataFrame, bottom: Column, steps: Column) -> DataFrame:
    """``level0 ... level3``: the digests of a subtree by level, as far up as ``steps``, then unchanged."""
    df = df.withColumn("level0", bottom)
    for k in range(1, STRIDE + 1):
        below = F.col(f"level{k - 1}")
        df = df.withColumn(f"level{k}", F.when(steps >= k, _folded(below)).otherwise(below))
    return df


def _siblings(level: Column, at: Column) -> Column:
    """The others of a node's run, joined: those on its left and those on its right."""
    place = at % ARITY
    left = F.array_join(F.slice(level, at - place + 1, place), "")
    right = F.array_join(F.slice(level, at + 2, ARITY - 1 - place), "")
    return F.struct(left.alias("left"), right.alias("right"))


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves; a lone leaf is its own top."""
    return reduce(lambda a, b: a + b, [(n > F.lit(ARITY**k)).cast("int") for k in range(MOST)])


@dataclass
class Tree:
    """The written levels of the trees of many keys, lowest first, and (key, height, digest) of each tree's top."""

    levels: list[DataFrame]
    tops: DataFrame
    carry: list[str]

    def proofs(self, above: DataFrame) -> DataFrame:
        """(key, pos, digest, carried columns, path) of every leaf; ``above`` has (key, path) of every top.

        ``path`` lists, from the leaf's level up, the joined siblings on the left and on the right.
        """
        tops = self.tops.join(above, "key").select("key", "height", F.lit(0).cast("long").alias("pos"), F.col("path").alias("above"))
        upper = None
        for k in reversed(range(len(self.levels))):
            base = k * STRIDE
            rows = self.levels[k]
            # A subtree's top is the top of its key's tree, or a node of the written level above.
            known = tops.filter(F.col("height") <= base + STRIDE).select("key", "pos", "above")
            if upper is not None:
                known = known.unionByName(upper.select("key", "pos", F.col("path").alias("above")))
            steps = F.least(F.lit(STRIDE), F.col("height") - base)
            rows = rows.join(known.withColumnRenamed("pos", "sub"), ["key", "sub"])
            rows = _with_levels(rows, F.transform("items", lambda x: x["digest"]), steps)
            own = lambda i: F.array(*[_siblings(F.col(f"level{s}"), F.shiftright(i, 3 * s)) for s in range(STRIDE)])
            path = lambda i: F.concat(F.slice(own(i), F.lit(1), steps), F.col("above"))
            items = F.transform("items", lambda x, i: F.struct(x.alias("item"), path(i).cast(PATH).alias("path")))
            upper = rows.select("key", F.inline(items)).select("key", "item.*", "path")
            if k:
                upper = stage(upper.select("key", "pos", "path"), "merkle-paths")
        return upper


def build(leaves: DataFrame, order: Sequence[str], carry: Sequence[str] = ()) -> Tree:
    """Trees over ``leaves``: a string ``key`` that is never null, a ``digest``, columns of ``order`` (nulls first) and to carry.

    Leaves that tie in the order stand in the order of their digests, so equal tables give equal roots.
    Positions are counted in ranges of (key, order), so a key of any size is dealt out over all tasks.
    """
    carry = list(carry)
    by = [F.col("key"), *[F.col(c).asc_nulls_first() for c in order], F.col("digest")]
    keep = ["key", "digest", *carry]
    dealt = leaves.repartitionByRange(shuffle_partitions(leaves.sparkSession), *by).sortWithinPartitions(*by)
    # The id holds the partition in its high bits and the row's place in it in the low 33.
    dealt = dealt.withColumn("row_", F.monotonically_increasing_id())
    dealt = stage(dealt.select(*keep, F.shiftright("row_", 33).alias("range_"), F.col("row_").bitwiseAND(F.lit((1 << 33) - 1)).alias("at_")), "merkle-leaves")
    runs = dealt.groupBy("key", "range_").agg(F.min("at_").alias("first_"), F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("key").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = stage(runs.select("key", "range_", (before - F.col("first_")).alias("base_"), F.sum("n_").over(Window.partitionBy("key")).alias("n_")), "merkle-runs")
    placed = dealt.join(runs, ["key", "range_"]).select(*keep, (F.col("at_") + F.col("base_")).alias("pos"), _height(F.col("n_")).alias("height"))
    tallest = runs.agg(F.max(_height(F.col("n_")))).first()[0] or 0

    levels, tops, nodes, own, base = [], None, placed, carry, 0
    while True:
        item = F.struct("pos", "digest", *own)
        rows = nodes.groupBy("key", F.shiftright("pos", 3 * STRIDE).alias("sub")).agg(F.first("height").alias("height"), F.sort_array(F.collect_list(item)).alias("items"))
        rows = stage(rows, "merkle-level")
        levels.append(rows)
        steps = F.least(F.lit(STRIDE), F.col("height") - base)
        up = _with_levels(rows, F.transform("items", lambda x: x["digest"]), steps)
        up = up.select("key", F.col("sub").alias("pos"), "height", F.col(f"level{STRIDE}")[0].alias("digest"))
        done = up.filter(F.col("height") <= base + STRIDE).select("key", "height", "digest")
        tops = done if tops is None else tops.unionByName(done)
        base += STRIDE
        if tallest <= base:
            return Tree(levels, stage(tops, "merkle-tops"), carry)
        nodes, own = up.filter(F.col("height") > base), []


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest, lambda acc, x: sha(F.concat(x["left"], acc, x["right"])))


def path_digest(path: Column) -> Column:
    """Digest of all siblings of a path, lowest level first, from left to right."""
    return sha(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))


@dataclass
class Manifest:
    """Trees of all keys and the tree over their subroots; ``root`` holds the one root (no row for an empty table)."""

    trees: Tree
    crown: Tree

    @property
    def root(self) -> DataFrame:
        return self.crown.tops.select(F.col("digest").alias("root"))

    def proofs(self) -> DataFrame:
        """(key, pos, digest, carried columns, subroot, root, path) of every leaf."""
        end = self.crown.tops.select("key", F.array().cast(PATH).alias("path"))
        crown = self.crown.proofs(end).join(self.crown.tops.select("key", F.col("digest").alias("root")), "key")
        crown = stage(crown.select(F.col("subkey").alias("key"), F.col("digest").alias("subroot"), "root", "path"), "merkle-crown")
        return self.trees.proofs(crown.select("key", "path")).join(crown.select("key", "subroot", "root"), "key")


def manifest(docs: DataFrame, by: str, order: Sequence[str], fields: Sequence[str], carry: dict[str, Column] | None = None) -> Manifest:
    """Manifest of ``docs``: a leaf for each row from ``fields``, a tree for each value of ``by`` (null is one, and first).

    Every row counts, repeated ones too; rows that tie in ``order`` stand in the order of their digests. Columns that are
    not named are not read. ``carry`` names small columns that travel with a row's leaf to its proof.
    """
    carry = carry or {}
    own = free_names(docs, "key_", "digest_", *[f"order{i}_" for i in range(len(order))], *[f"carry{i}_" for i in range(len(carry))])
    key, digest = own[:2]
    orders, held = own[2 : 2 + len(order)], own[2 + len(order) :]
    # An equals sign in front keeps a null key (empty) first and apart from an empty one.
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(q(by)).cast("string")), F.lit("")).alias(key),
        leaf_digest([F.col(q(c)) for c in fields]).alias(digest),
        *[F.col(q(c)).alias(a) for c, a in zip(order, orders, strict=True)],
        *[c.alias(a) for c, a in zip(carry.values(), held, strict=True)],
    )
    leaves = rows.select(F.col(key).alias("key"), F.col(digest).alias("digest"), *orders, *held)
    trees = build(leaves, orders, held)
    trees.carry = list(carry)
    trees.levels[0] = trees.levels[0].withColumn(
        "items", F.transform("items", lambda x: F.struct(x["pos"].alias("pos"), x["digest"].alias("digest"), *[x[a].alias(c) for c, a in zip(carry, held, strict=True)]))
    )
    subroots = trees.tops.select(F.lit("").alias("key"), "digest", F.col("key").alias("subkey"))
    return Manifest(trees, build(subroots, ["subkey"], ["subkey"]))


def audit(docs: DataFrame, claimed: Column, by: str = "lang", order: Sequence[str] = ("doc_id",), fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_column: str = "doc_id") -> DataFrame:
    """Proof of every row of ``docs``, and whether the leaf ``claimed`` for it leads to the root with the row's own siblings.

    Returns (doc_id, leaf, subroot, root, path, folded_root, verified). An empty table has no rows and no root.
    """
    made = manifest(docs, by, order, fields, {"doc_id": F.col(q(id_column)), "claim": claimed})
    rows = made.proofs().withColumn("folded_root", fold(F.col("claim"), F.col("path")))
    return rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered_audit(docs: DataFrame, every: int = 3) -> DataFrame:
    """The audit of ``documents`` where every third row, by the CRC-32 of its id, claims its text with A-Z lower-cased.

    A null id is never chosen; a null text stays null. ``proof_sha256`` is the digest of all siblings of a row's path.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    text = F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    rows = audit(docs, leaf_digest([*fields, text]))
    return rows.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def audit_sql(levels: int = 8) -> str:
    """The same rows in SQL for up to 8**levels rows of a key and as many keys."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(text: str) -> str:
        one = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
        return "sha256(" + " || ".join(one(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    crc = (
        "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))), lambda a, b: "
        + "list_reduce([xor(a, b), 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT], "
        + "lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END))"
    )

    def tree(name: str, source: str) -> str:
        """CTEs name0 ... nameN (key, node, d) up the levels and namepN (leaf, acc, sib) of every leaf."""
        ctes = [f"{name}0 AS ({source})", f"{name}p0 AS (SELECT key, pos AS leafpos, pos, claim AS acc, CAST('' AS VARCHAR) AS sib FROM {name}0)"]
        for k in range(levels):
            ctes.append(f"{name}g{k} AS (SELECT key, pos // 8 AS run, list(d ORDER BY pos) AS ds, max(c) AS c FROM (SELECT *, count(*) OVER (PARTITION BY key) AS c FROM {name}{k}) GROUP BY key, pos // 8)")
            ctes.append(f"{name}{k + 1} AS (SELECT key, run AS pos, CASE WHEN c > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM {name}g{k})")
            ctes.append(
                f"{name}p{k + 1} AS (SELECT p.key, leafpos, run AS pos, "
                f"CASE WHEN c > 1 THEN sha256(array_to_string(ds[1:pos % 8], '') || acc || array_to_string(ds[pos % 8 + 2:8], '')) ELSE acc END AS acc, "
                f"sib || CASE WHEN c > 1 THEN array_to_string(ds[1:pos % 8], '') || array_to_string(ds[pos % 8 + 2:8], '') ELSE '' END AS sib "
                f"FROM {name}p{k} AS p JOIN {name}g{k} AS g ON p.key = g.key AND p.pos // 8 = g.run)"
            )
        return ",\n".join(ctes)

    base = f"SELECT *, coalesce('=' || lang, '') AS key, {leaf('text')} AS d, CASE WHEN {crc} % 4294967296 IS NULL THEN {leaf('text')} WHEN xor({crc}, 4294967295::UBIGINT) % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS claim FROM documents"
    return f"""
WITH docs AS ({base}),
numbered AS (SELECT doc_id, key, d, claim, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, d) - 1 AS pos FROM docs),
{tree("t", "SELECT key, pos, d, claim FROM numbered")},
{tree("r", f"SELECT '' AS key, row_number() OVER (ORDER BY key) - 1 AS pos, d, d AS claim, key AS subkey FROM t{levels}")},
whole AS (SELECT d AS root FROM r{levels}),
crown AS (SELECT pos, subkey, d AS subroot FROM r0),
folded AS (
  SELECT n.doc_id, n.d AS leaf, c.subroot, c.pos AS place, p.acc, p.sib || u.sib AS sib
  FROM numbered n JOIN tp{levels} p ON n.key = p.key AND n.pos = p.leafpos JOIN crown c ON c.subkey = n.key JOIN rp{levels} u ON u.leafpos = c.pos),
up0 AS (SELECT *, place AS pos FROM folded),
{",".join(f"up{k + 1} AS (SELECT f.* EXCLUDE (pos, acc), run AS pos, CASE WHEN c > 1 THEN sha256(array_to_string(ds[1:pos % 8], '') || acc || array_to_string(ds[pos % 8 + 2:8], '')) ELSE acc END AS acc FROM up{k} AS f JOIN rg{k} AS g ON f.pos // 8 = g.run)" for k in range(levels))}
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM up{levels}, whole
"""
