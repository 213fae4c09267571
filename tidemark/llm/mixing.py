"""Mixing sources to target weights by a multivariate hypergeometric splitting tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import WORD, by_group, kept, staged, task

#: Output shards and blocks of a source: at least so many, and more as there are more words.
SHARDS, BLOCKS = 32, 1024
WORDS_A_SHARD, WORDS_A_BLOCK = 50_000_000, 250_000
CAP = 3
#: Words before and behind a target's border whose documents are taken one by one, not as whole blocks.
ZONE = 50_000
#: Documents times words up to which the documents there that come nearest to the target are found exactly.
EXACT = 200_000_000
#: Groups of sources by hash that the tree is dealt in; segments that the order of a source's blocks has.
GROUPS, SEGMENTS = 64, 4096
#: Rows of a few numbers, some MB, up to which a table is broadcast; beyond it the join shuffles.
BROADCAST, SALTS = 100_000, 64
#: What numpy draws exactly; larger populations are drawn by the normal distribution of the same mean and deviation.
POPULATION = 10**9


def _one(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of `good` are among n drawn of good + bad without replacement."""
    total = good + bad
    if total < POPULATION:
        return int(rng.hypergeometric(good, bad, n)) if good and n else 0
    mean = n * (good / total)
    wide = (mean * (bad / total) * ((total - n) / (total - 1))) ** 0.5
    return int(min(max(round(rng.normal(mean, wide)), 0, n - bad), n, good))


def draw(quotas: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate hypergeometric draw: how many of each kind are among n of all, drawn without replacement."""
    total = int(quotas.sum())
    if total < POPULATION:
        return rng.multivariate_hypergeometric(quotas, n, method="marginals")
    part = np.zeros_like(quotas)
    for i, q in enumerate(quotas.tolist()):
        total -= q
        part[i] = _one(q, total, n, rng)
        n -= int(part[i])
    return part


def split_quotas(quotas: np.ndarray, room: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, source, count) of counts above 0, by shard: how many of each source's blocks each shard gets. room: blocks of
    each shard, as many in all as the quotas. The quotas at a node are split between its two halves by a multivariate
    hypergeometric draw of the left half's room, and so on to the shards."""
    ends = np.concatenate(([0], np.cumsum(room)))
    out, open_ = [(np.zeros(0, np.int64),) * 3], [(0, len(room), np.arange(len(quotas)), np.asarray(quotas, np.int64))]
    while open_:
        lo, hi, who, q = open_.pop()
        who, q = who[q > 0], q[q > 0]
        if not len(q):
            continue
        if hi - lo == 1:
            out.append((np.full(len(q), lo), who, q))
            continue
        mid = (lo + hi) // 2
        part = draw(q, int(ends[mid] - ends[lo]), rng)
        open_ += [(mid, hi, who, q - part), (lo, mid, who, part)]
    return tuple(np.concatenate(x) for x in zip(*out))


def even(total: int, shards: int) -> np.ndarray:
    """`total` blocks dealt evenly among shards."""
    return np.diff(np.arange(shards + 1, dtype=object) * total // shards).astype(np.int64)


def nearest(sizes: list[int], goal: int) -> np.ndarray:
    """Which of the documents to take, so that their words come near to the goal and not above it: each that still fits, in the order
    given, so that what is missing is less than any document left; if anything is missing and they are few, those that come nearest."""
    take, left = np.zeros(len(sizes), bool), goal
    for i, s in enumerate(sizes):
        if s <= left:
            take[i], left = True, left - s
    if left <= 0 or take.all() or len(sizes) * goal > EXACT:
        return take
    first = np.full(goal + 1, -1, np.int32)  # the document by which a sum is first reached
    first[0] = len(sizes)
    for i, s in enumerate(sizes):
        if s <= goal:
            first[np.flatnonzero((first[: goal + 1 - s] >= 0) & (first[s:] < 0)) + s] = i
    at = int(np.flatnonzero(first >= 0)[-1])
    take[:] = False
    while at:
        take[first[at]] = True
        at -= sizes[first[at]]
    return take


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _named(id_col: str, text_col: str, source_col: str):
    """(source's name, never null; 128 bits that name a row by id, source and text)."""
    part = lambda c: F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    own, source = F.col(id_col).cast("string"), F.col(source_col).cast("string")
    return F.coalesce(F.concat(F.lit("="), source), F.lit("")), F.unhex(F.md5(F.concat(part(own), part(source), part(F.col(text_col)))))


def source_targets(totals: DataFrame, cap: float = CAP) -> DataFrame:
    """(key, source_size, target) of (key, source_size): sources by code point, the one named "" (null) last, weigh 1, 2, 3, 1, ...
    and share the sum of all sizes by weight, none above `cap` times its own, what is cut off being shared again. `totals` is read several times.

    Sources are ranked in ranges of the order, and the share of one weight is found by sums over all sources, so there
    may be any number of them."""
    n = totals.count()
    placed = totals.repartitionByRange(1 + n // 100_000, (F.col("key") == "").cast("int"), "key").withColumn("part", F.spark_partition_id())
    placed = staged(placed, "sources")
    counts = placed.groupBy("part").count().collect()  # some numbers, one for 100,000 sources
    before, at = [], 0
    for r in sorted(counts, key=lambda r: r.part):
        before.append((r.part, at))
        at += r["count"]
    spark = totals.sparkSession
    nth = F.row_number().over(Window.partitionBy("part").orderBy((F.col("key") == "").cast("int"), "key")) - 1
    ranked = placed.withColumn("nth", nth).join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part")
    ranked = staged(ranked.select("key", "source_size", (1 + (F.col("before") + F.col("nth")) % 3).alias("weight")), "ranked", n)
    # a source whose cap is below its share at one unit is below it at all later, larger ones
    unit, over = 0.0, F.lit(False)
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    while True:
        cut, free = ranked.agg(F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        found = (whole - cap * (cut or 0)) / free if free else unit
        if found <= unit:
            break
        unit = found
        over = F.col("source_size") * F.lit(cap) < F.lit(unit) * F.col("weight")
    target = F.when(over, (F.col("source_size") * F.lit(cap)).cast("double")).otherwise(F.lit(unit) * F.col("weight"))
    return ranked.select("key", "source_size", target.alias("target"))


def _joined(rows: DataFrame, table: DataFrame, size: int, by: list[str], how: str = "inner") -> DataFrame:
    """`table`, which has so many rows, is broadcast up to a bound; beyond it a table of sources is dealt to salts, so that no
    source's rows meet in one task."""
    if size <= BROADCAST:
        return rows.join(F.broadcast(table), by, how)
    if by == ["key"]:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.join(table, ["key", "salt"], how).drop("salt")
    return rows.join(table, by, how)


class Decided:
    """What the mix takes: sources (key, source_size, target, blocks), blocks (key, block, rounds, whole, shards) and edge
    (key, block, row) of the documents that are taken once more than their block; all staged tables."""

    def __init__(self, rows: DataFrame, blocks: int | None, shards: int | None, cap: int, seed: int):
        self.seed = seed
        # tables whose rows are known are written in as few files as these need
        totals = kept(rows.groupBy("key").agg(F.sum("size").cast("long").alias("source_size")))
        sources = source_targets(totals, cap)
        of = F.lit(blocks).cast("long") if blocks else F.greatest(F.lit(BLOCKS).cast("long"), F.expr(f"source_size div {WORDS_A_BLOCK}"))
        self.n_sources, words = totals.agg(F.count(F.lit(1)), F.sum("source_size")).first()
        self.sources = staged(sources.withColumn("blocks", of), "targets", self.n_sources)
        self.shards = shards or max(SHARDS, (words or 0) // WORDS_A_SHARD)
        spans = kept(self._spans(rows))
        self.n_blocks = spans.count()
        zone = self._zone(rows, spans.where("edge"))
        last = zone.groupBy("key", "block").agg(F.max("spot").alias("spot"))
        self.n_edge = zone.count()
        self.edge = staged(zone.select("key", "block", "row"), "edge", self.n_edge)
        # the place in the last, partial round of each block that it takes anything of
        spans = spans.join(last, ["key", "block"], "left").withColumn("spot", F.when(F.col("whole"), F.col("nth")).otherwise(F.col("spot")))
        rounds = F.when(F.col("rounds") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1), lambda r: r * F.col("n") + F.col("nth"))).otherwise(F.array().cast("array<long>"))
        places = F.concat(rounds, F.when(F.col("spot").isNotNull(), F.array(F.col("rounds") * F.col("n") + F.col("spot"))).otherwise(F.array().cast("array<long>")))
        spans = staged(spans.select("key", "block", "rounds", "whole", places.alias("places")), "places", self.n_blocks)
        copies = spans.select("key", "block", F.posexplode("places").alias("copy", "place"))
        dealt = copies.join(self._dealt(spans), ["key", "place"]).groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).getField("shard").alias("shards"))
        self.blocks = staged(spans.drop("places").join(dealt, ["key", "block"], "left"), "blocks", self.n_blocks)

    def block(self, rows: DataFrame) -> DataFrame:
        """`rows` (key, row) with their source's columns and the block that their hash deals them to."""
        rows = _joined(rows, self.sources, self.n_sources, ["key"])
        return rows.withColumn("block", F.pmod(F.xxhash64("row", F.lit(self.seed)), F.col("blocks")))

    def taken(self, rows: DataFrame) -> DataFrame:
        """`rows` (key, row, size) with source_size, target, copies and shards, an array as long."""
        rows = self.block(rows)
        rows = _joined(rows, self.blocks, self.n_blocks, ["key", "block"], "left")
        rows = _joined(rows, self.edge.withColumn("more", F.lit(True)), self.n_edge, ["key", "block", "row"], "left")
        copies = F.col("rounds") + (F.col("whole") | F.coalesce("more", F.lit(False))).cast("int")
        rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.coalesce(copies, F.lit(0))).otherwise(F.lit(0)).cast("int"))
        return rows.withColumn("shards", F.coalesce(F.slice("shards", F.lit(1), F.col("copies")), F.array().cast("array<int>"))).drop("block", "blocks", "rounds", "whole", "more")

    def _spans(self, rows: DataFrame) -> DataFrame:
        """(key, block, rounds, rest, before, nth, n, whole, edge) of each block with words: the words before it in its source's
        permuted order and its number there, of n; whether the last round takes the whole of it or some of its documents.

        The order is by segment and then by hash, so that running sums need the segments of a source or the blocks of a
        segment together, never a source's blocks."""
        rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
        spans = self.block(rows.where("size > 0")).groupBy("key", "block").agg(F.sum("size").cast("long").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
        place = F.xxhash64("key", "block", F.lit(self.seed + 1))
        spans = spans.withColumns({"rounds": rounds, "place": place, "segment": F.pmod(place, F.lit(SEGMENTS))})
        spans = kept(spans)
        segments = spans.groupBy("key", "segment").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("c"))
        every, order = Window.partitionBy("key"), Window.partitionBy("key").orderBy("segment")
        segments = segments.select("key", "segment", (F.sum("w").over(order) - F.col("w")).alias("w"), (F.sum("c").over(order) - F.col("c")).alias("c"), F.sum("c").over(every).alias("n"))
        within = Window.partitionBy("key", "segment").orderBy("place", "block")
        spans = spans.withColumns({"before": F.sum("words").over(within) - F.col("words"), "nth": F.row_number().over(within) - 1}).join(segments, ["key", "segment"])
        rest = F.col("target") - F.col("rounds") * F.col("source_size")
        spans = spans.withColumns({"before": F.col("before") + F.col("w"), "nth": F.col("nth") + F.col("c"), "rest": rest})
        whole = F.col("before") + F.col("words") <= F.col("rest") - ZONE
        return spans.select("key", "block", "rounds", "rest", "before", "nth", "n", whole.alias("whole"), (~whole & (F.col("rest") >= 1) & (F.col("before") < F.col("rest") + ZONE)).alias("edge"))

    def _zone(self, rows: DataFrame, edge: DataFrame) -> DataFrame:
        """(key, block, row, spot) of the documents around each border that are taken: bounded words of a source, in one task."""

        def fill(own):
            key, nth, _, row, block, size, rest, before = own
            take = nearest(size, int(rest[0] - min(before)))
            spot = {n: nth[0] + i for i, n in enumerate(sorted({n for n, t in zip(nth, take) if t}))}
            for k, b, r, n, t in zip(key, block, row, nth, take):
                if t:
                    yield k, b, r, spot[n]

        def run(batches):
            found = list(zip(*by_group(batches, fill, 8))) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found, (pa.string(), pa.int64(), pa.binary(), pa.int64()))], ["key", "block", "row", "spot"])

        docs = _joined(self.block(rows.where("size > 0")), edge.select("key", "block", "rest", "before", "nth"), edge.count(), ["key", "block"])
        once = docs.groupBy("key", "block", "row").agg(F.sum("size").alias("size"), *(F.first(c).alias(c) for c in ("rest", "before", "nth")))
        once = once.withColumn("spot", F.xxhash64("row", F.lit(self.seed + 2)))
        once = once.select("key", "nth", "spot", "row", "block", "size", "rest", "before").repartition("key").sortWithinPartitions("key", "nth", "spot", "row")
        return kept(once.mapInArrow(task(run), "key string, block long, row binary, spot long"))

    def _dealt(self, spans: DataFrame) -> DataFrame:
        """(key, place, shard) of all places. Groups of sources are dealt among shards first, then the sources of each group
        in a task of their own; a source's places go to shards in runs, one after another."""
        quotas = spans.groupBy("key").agg(F.sum(F.size("places")).cast("long").alias("quota")).where("quota > 0").withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS)).cast("int"))
        quotas = staged(quotas, "quotas", self.n_sources)
        totals = np.zeros(GROUPS, np.int64)
        for r in quotas.groupBy("group").agg(F.sum("quota").alias("n")).collect():
            totals[r.group] = r.n
        shards, seed = self.shards, self.seed

        def deal(own):
            group, keys, quota = own[0][0], own[1], np.array(own[2], np.int64)
            shard, who, count = split_quotas(totals, even(int(totals.sum()), shards), np.random.default_rng(seed))
            room = np.zeros(shards, np.int64)
            room[shard[who == group]] = count[who == group]
            shard, who, count = split_quotas(quota, room, np.random.default_rng([seed, group]))
            by = np.lexsort((shard, who))
            shard, who, count = shard[by], who[by], count[by]
            start = np.cumsum(count) - count - (np.cumsum(quota) - quota)[who]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()).take(pa.array(who)), pa.array(start), pa.array(count), pa.array(shard.astype(np.int32))], ["key", "start", "count", "shard"])

        groups = quotas.select("group", "key", "quota").repartition("group").sortWithinPartitions("group", "key")
        runs = groups.mapInArrow(task(lambda batches: by_group(batches, deal, 3)), "key string, start long, count long, shard int")
        return runs.select("key", F.explode(F.expr("sequence(start, start + count - 1)")).alias("place"), "shard")


def _rows(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    key, row = _named(id_col, text_col, source_col)
    return df.select(key.alias("key"), row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"))


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int | None = None, shards: int | None = None, cap: int = CAP, seed: int = 17) -> DataFrame:
    """(row, id, source, size, source_size, target, copies, taken, shard, shards): one row for each row of `df`; row is 128 bits
    of id, source and text that name the row, copies how often the mix takes the whole of it, taken the words of
    all copies, shards the output shard of each copy, shard that of the first.

    Size is the number of words of the whole text (null: none). Documents are dealt into blocks of their source by hash, and a
    permutation by seed orders the blocks; a source's quota is whole rounds of all its blocks and then the first blocks, as far as
    its target goes. Within ZONE words of the border documents are taken one by one, those that fit, so that fewer words are
    missing than any document left there has. A tree of multivariate hypergeometric draws deals the quotas among
    shards; a source's copies of blocks go to them in disjoint runs, one after another, in the order of the permutation.

    Rows that repeat id, source and text are one document whose sizes add up and that is taken or left as one. Null ids,
    sources and texts are values like others. Shards and blocks are as many as the words ask for unless given. A source without words has
    target 0 and nothing taken. An empty table gives an empty result. Reruns with the same seed agree. There may be any number of
    sources: the driver holds one number for each GROUPS groups of them, and no step needs a source's rows together."""
    rows = kept(_rows(df, id_col, text_col, source_col))
    out = Decided(rows, blocks, shards, cap, seed).taken(rows)
    return out.select("row", "id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.get("shards", F.lit(0)).alias("shard"), "shards")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int | None = None, shards: int | None = None, cap: int = CAP, seed: int = 17, placed: bool = False) -> DataFrame:
    """The mixture itself: the rows of `df`, each as often as plan() takes it, with the columns of `df`; placed: and with
    `shard` and `place` in place of any columns so named.

    Partition n holds shard n, in the order of place, a hash by seed; so does the file of it that is written. Rows without words are
    never taken; nulls, repeated rows and empty tables are as in plan()."""
    key, row = _named(id_col, text_col, source_col)
    decided = Decided(kept(_rows(df, id_col, text_col, source_col)), blocks, shards, cap, seed)
    whole = df.select(F.struct(*df.columns).alias("doc"), key.alias("key"), row.alias("row"), word_count(text_col).alias("size"))
    rows = decided.taken(whole).select("doc", "row", F.posexplode("shards").alias("copy", "shard"))
    rows = rows.withColumn("place", F.xxhash64("row", "copy", F.lit(seed + 3)))
    rows = rows.repartitionById(decided.shards, F.col("shard")).sortWithinPartitions("place", "copy")
    columns = [c for c in df.columns if not placed or c not in ("shard", "place")]
    return rows.select(*(F.col("doc").getField(c).alias(c) for c in columns), *(("shard", "place") if placed else ()))
