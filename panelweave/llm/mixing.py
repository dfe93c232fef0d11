"""Mixing sources to target weights: fixed-length blocks, random slots, pseudorandom permutations. DataFrame only.

1. The words of each source are one stream (documents in the order of a hash), cut into blocks of ``block_words``.
   Streams are summed up in hash buckets, so a source that holds a third of all rows is no single task.
2. Targets share the total by weight; none is above ``most`` times its source, the excess is shared again. A source's
   target is a whole number of block slots.
3. The slots of all sources are dealt over output shards by a pseudorandom permutation of all slots. The sources' counts
   in a shard are so a multinomial draw, given that the shards' sums are the targets.
4. Slot k of a source takes the block to which a pseudorandom permutation of the source's block numbers, another one for
   every pass over the source, sends k. Slots and blocks are joined by (source, block); the joined mixture is staged, and
   what a document gives is summed up from it.

Permutations are swap-or-not networks: a round pairs x with (key - x) mod n and swaps the pair or not by a hash bit, so
each round maps 0..n-1 onto itself for any n. All keys are hashes of the seed, so a rerun draws the same mixture.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.llm.common import free_names, only, q, shuffle_partitions, stage, words_count
from panelweave.llm.ranks import with_running_total

BLOCK_WORDS = 32
SHARD_SLOTS = 4096
ROUNDS = 10
#: Documents of a hash bucket, and slots that a row of the slot generator stands for.
BUCKET_DOCS = 20_000
CHUNK = 4096
#: Parts of a copy in which the fractions of documents are added up.
UNIT = 1 << 30


def permuted(x: Column, n: Column, key: Sequence[Column], rounds: int = ROUNDS) -> Column:
    """Where a pseudorandom permutation of 0..n-1, one for each value of ``key``, sends ``x``."""

    def round_(x: Column, r: Column) -> Column:
        partner = F.array(F.pmod(F.pmod(F.xxhash64(r, *key), n) - x + n, n))
        swap = lambda p: F.xxhash64(r + rounds, *key, F.greatest(x, p)) % 2 == 0
        return F.transform(partner, lambda p: F.when(swap(p), p).otherwise(x))[0]

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x.cast("long"), round_)


def source_targets(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3) -> DataFrame:
    """(source, number, weight, source_size, target) of each source; ``sized`` has source and size.

    Sources are numbered by code point, null last; weights repeat in that order. Targets share the total size by weight
    up to ``most`` times the source's size; what is above is shared by weight among the others until none is above.
    A source of no words has target 0.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    numbered = with_running_total(totals, [F.col("source").isNull(), F.col("source")], "one", "number").drop("one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    table = stage(numbered.withColumn("weight", weight), "sources")
    cap, level = F.col("source_size") * float(most), 0.0
    total = table.agg(F.sum("source_size").cast("double")).first()[0] or 0.0
    while True:
        full = cap <= F.col("weight") * level if level else F.lit(False)
        held, free = table.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not free or (total - held) / free <= level * (1 + 1e-12):
            break
        level = (total - held) / free
    return table.withColumn("target", F.least(cap, F.col("weight") * level))


@dataclass
class Mixture:
    """``docs``: every row with its size, source figures and words taken; ``slots``: what each output slot takes.

    ``mixture``: the staged join of slots and blocks, a row for each piece of a document in a slot; ``taken`` is its sum.
    """

    docs: DataFrame
    slots: DataFrame
    mixture: DataFrame

    def shards(self) -> DataFrame:
        """(shard, slot, doc_id, begin, words): the pieces of documents in every slot."""
        return self.mixture.select("shard", "slot", "doc_id", "begin", "words")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: Sequence[float] = (1, 2, 3), most: int = 3, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 1) -> Mixture:
    """Mix ``docs``: ``Mixture.docs`` has (doc_id, th, source, size, source_size, target, taken) of every row.

    ``size`` counts runs of characters other than ASCII white space; a null or blank text has 0 and is never taken. A null
    source is a source of its own. Repeated rows are documents of their own; ``th`` is a hash of id and text. No block is taken
    more than ``most`` times (an integer), so no document exceeds that times its size. Only the columns named are read.
    """
    rows = only(docs, doc_id=id_column, text=text_column, source=source_column)
    sized = stage(rows.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("th"), words_count(F.col("text")).alias("size")), "sized")
    table = source_targets(sized, weights, most)
    blocks = F.ceil(F.col("source_size") / block_words)
    slots_of = F.when(F.col("source_size") > 0, F.least(F.lit(most) * blocks, F.round(F.col("target") / F.col("source_size") * blocks).cast("long"))).otherwise(0)
    table = stage(with_running_total(table.withColumn("blocks", blocks).withColumn("slots", slots_of), [F.col("number")], "slots", "before"), "sources")
    all_slots = int(table.agg(F.sum("slots")).first()[0] or 0)

    # Slots of the sources, in chunks that are spread before they are unfolded.
    n_chunks = F.ceil(F.col("slots") / CHUNK)
    chunks = table.filter("slots > 0").select("number", "slots", "blocks", "before", F.explode(F.sequence(F.lit(0).cast("long"), n_chunks - 1)).alias("c"))
    # By a number, so that these few small rows are not merged into one task again.
    chunks = chunks.repartition(shuffle_partitions(docs.sparkSession), "number", "c")
    slots = chunks.select("number", "blocks", "before", F.explode(F.sequence(F.col("c") * CHUNK, F.least(F.col("c") * CHUNK + CHUNK, F.col("slots")) - 1)).alias("k"))
    slots = slots.withColumn("pass_", F.floor(F.col("k") / F.col("blocks"))).withColumn("in_pass", F.col("k") % F.col("blocks")).withColumn("at", F.col("before") + F.col("k"))
    slots = slots.withColumn("block", permuted(F.col("in_pass"), F.col("blocks"), [F.lit(seed), F.col("number"), F.col("pass_")]))
    place = permuted(F.col("at"), F.lit(max(1, all_slots)).cast("long"), [F.lit(seed)])
    where = slots.withColumn("place", place).select((F.col("place") / shard_slots).cast("long").alias("shard"), (F.col("place") % shard_slots).alias("slot"), "number", "block")

    # Places of the documents in their source's stream: within hash buckets, then bucket by bucket.
    n_buckets = max(1, -(-sized.count() // BUCKET_DOCS))
    held = sized.withColumn("bucket", F.pmod("th", F.lit(n_buckets))).join(table.select(F.col("source").alias("src"), "number", "source_size", "target"), F.col("source").eqNullSafe(F.col("src")))
    own = Window.partitionBy("number", "bucket").orderBy("th", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.withColumn("own", F.sum("size").over(own) - F.col("size"))
    sums = sized.withColumn("bucket", F.pmod("th", F.lit(n_buckets))).groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("base", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base")
    placed = held.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = stage(placed.select("doc_id", "th", "source", "size", "number", "source_size", "target", (F.col("own") + F.col("base")).alias("start")), "placed")

    cut = placed.filter("size > 0").select("doc_id", "number", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))).alias("block"))
    first, last = F.greatest(F.col("start"), F.col("block") * block_words), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = cut.select("doc_id", "number", "start", "block", (first - F.col("start")).alias("begin"), (last - first).alias("words"))
    # Spark guesses the unfolded slots as small as the sources they come from: they must not be broadcast.
    mixture = stage(where.hint("merge").join(pieces, ["number", "block"]).select("shard", "slot", "number", "start", "doc_id", "begin", "words"), "mixture")
    taken = mixture.groupBy("number", "start").agg(F.sum("words").alias("taken"))
    # A document with words is known by its place in its source's stream.
    with_words = placed.filter("size > 0").join(taken, ["number", "start"], "left").select("doc_id", "th", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    done = with_words.unionByName(placed.filter("size = 0").select("doc_id", "th", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))
    return Mixture(done, where, mixture)


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: int = 1) -> DataFrame:
    """``docs`` with each row as often as the mixture takes it: taken / size times, rounded so that the sources keep their sums.

    Documents are whole. The fractions of a source's documents are added up in the order of their sizes, and a document has one
    copy more where the total passes a whole number: the words of a source differ from those taken by twice its largest
    document at most. Equal rows (id, text, source) share what they take and count as one document here. Columns stay as they
    are. Rows without words stay once: they weigh nothing in any source.
    """
    copies, th, id_, src, k = free_names(docs, "copies_", "th_", "id_", "src_", "k_")
    got = mix(docs, id_column, text_column, source_column, weights, most, seed=seed).docs
    # Equal rows share what they take, so that the join gives each row one partner.
    share = got.groupBy("doc_id", "th", "source").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    # Fractions are whole parts of UNIT, so that totals are exact in any order; the first one starts at a hash of the seed.
    fraction = F.when(F.col("size") > 0, F.round(F.col("taken") % F.col("size") / F.col("size") * UNIT).cast("long")).otherwise(0)
    order = [F.col("source").isNull(), F.col("source"), F.col("size"), F.col("th"), F.col("doc_id")]
    share = with_running_total(share.withColumn("fraction", fraction), order, "fraction", "before")
    begin = F.col("before") + F.pmod(F.xxhash64(F.lit(seed)), F.lit(UNIT))
    more = F.floor((begin + F.col("fraction")) / UNIT) - F.floor(begin / UNIT)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size")) + more).otherwise(1).cast("int")
    share = share.select(F.col("doc_id").alias(id_), F.col("th").alias(th), F.col("source").alias(src), times.alias(copies)).filter(F.col(copies) > 0)
    same = F.col(q(id_column)).eqNullSafe(F.col(id_)) & F.col(q(source_column)).eqNullSafe(F.col(src))
    keyed = docs.join(share, same & (F.xxhash64(q(id_column), q(text_column)) == F.col(th)))
    return keyed.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
