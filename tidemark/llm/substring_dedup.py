"""Repeated passages: windows of words that start anywhere else too are cut out of every text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Words, chunks, list_array, mix, ranges_hash, small_batches, staged, task, utf8

WINDOW = 35
#: Words of a seed: the least length at which repetition is looked for, a quarter of a window.
SEED = 9
_SALT = np.uint64(0xA24BAED4963EE407)
ASK, TELL, SETTLED = 1, 2, 0
#: Bytes that name a seed's extension: where two that differ share them, more is looked at at the next length.
EXTENSION = 3
#: A seed that more than one in so many of all repeated ones are is hot: there are fewer of these than that; and the salts of one.
HOT, SALTS = 2000, 64


def least_seed(seeds: np.ndarray, span: int) -> np.ndarray:
    """For each i the place of the least of seeds[i:i + span], the leftmost of equals."""
    value, place, width = seeds, np.arange(len(seeds)), 1
    while 2 * width <= span:
        right = value[width:] < value[:-width]
        value, place, width = np.where(right, value[width:], value[:-width]), np.where(right, place[width:], place[:-width]), 2 * width
    if more := span - width:
        right = value[more:] < value[:-more]
        place = np.where(right, place[more:], place[:-more])
    return place


class Windows:
    """The windows of some texts: start and doc of each, and the place of its seed. All are numbers of words in `words`."""

    def __init__(self, texts: list[bytes], window: int, seed: int):
        w = self.words = Words(texts)
        count = np.maximum(w.n - window + 1, 0)
        self.doc = np.repeat(np.arange(len(texts)), count)
        self.start = np.arange(len(self.doc)) - np.repeat(np.cumsum(count) - count, count) + w.first[:-1][self.doc]
        if len(self.start):
            at = np.arange(len(w.hash) - seed + 1)
            self.seeds = ranges_hash(w.hash, at, at + seed)
            self.seed = least_seed(self.seeds, window - seed + 1)[self.start]
        else:
            self.seeds, self.seed = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def lengths(window: int, seed: int) -> list[int]:
    """The lengths that seeds are extended to: each twice the one before, while a window reaches so far from its seed on one
    side at least, wherever the seed is in it."""
    out, size = [], 2 * seed
    while 2 * (size - seed) <= window - seed:
        out.append(size)
        size *= 2
    return out


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text): key is 128 bits that name the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return small_batches(df).select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))


def _seeds(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(key, h, e, a, pos) of each different seed of a text: its hash, that of all words of windows around it, its extensions, and its
    places. a: for each of lengths() EXTENSION bytes that name the words that end with the seed and as many for those that start
    with it, 0 where the text has not so many. A text that says one thing over and over has one row for it."""
    steps = lengths(window, seed)

    def run(batches):
        for b in batches:
            raw = utf8(b.column(1))
            for i, j in chunks(raw):
                w = Windows(raw[i:j], window, seed)
                if not len(w.seed):
                    continue
                new = np.ones(len(w.seed), bool)  # a later window's seed is never to the left
                new[1:] = w.seed[1:] != w.seed[:-1]
                at, doc = w.seed[new], w.doc[new]
                low, high = w.words.first[doc], w.words.first[doc + 1]
                start, end = np.maximum(low, at - (window - seed)), np.minimum(high, at + window)
                with np.errstate(over="ignore"):
                    around = mix(ranges_hash(w.words.hash, start, end) + (at - start).astype(np.uint64) * _SALT)
                longer = np.zeros((len(at), 2 * len(steps)), ">u4")
                for n, size in enumerate(steps):
                    for side, (s, e) in enumerate(((at + seed - size, at + seed), (at, at + size))):
                        there = (s >= low) & (e <= high)
                        longer[there, 2 * n + side] = np.maximum(ranges_hash(w.words.hash, s[there], e[there]) >> np.uint64(64 - 8 * EXTENSION), np.uint64(1))
                h, pos = w.seeds[at], (at - low).astype(np.int32)
                order = np.lexsort((pos, around, h, doc))
                h, around, pos, doc, longer = h[order], around[order], pos[order], doc[order], longer[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (around[1:] != around[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                doc = doc[first]
                named = [x.tobytes() for x in longer[first].view(np.uint8).reshape(len(first), -1, 4)[:, :, 4 - EXTENSION :]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(doc + i)), pa.array(h[first].view(np.int64)), pa.array(around[first].view(np.int64)), pa.array(named, pa.binary()), list_array(pos, np.append(first, len(h)))],
                    ["key", "h", "e", "a", "pos"],
                )

    return docs.select("key", "text").mapInArrow(task(run), "key binary, h long, e long, a binary, pos array<int>")


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    """`rows` with a salt: those of a hot seed are dealt by a hash of a column."""
    return rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))


def _copied(rows: DataFrame) -> DataFrame:
    """One row of each seed, for all its salts."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), F.lit(SALTS - 1)).otherwise(F.lit(0))))).drop("hot")


def _repeated(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """The _seeds() that occur more than once, with `hot`: at the least length only they survive."""
    seeds = _seeds(docs, window, seed)
    twice = seeds.groupBy("h").agg(F.sum(F.size("pos")).alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 1")
    twice = staged(twice.select("h", "rows"), "repeated")
    total = twice.agg(F.sum("rows")).first()[0] or 0
    hot = twice.where(F.col("rows") * HOT > total).select("h", F.lit(True).alias("hot"))  # fewer than HOT rows
    seeds = seeds.join(F.broadcast(hot), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    twice = twice.select("h", (F.col("rows") * HOT > total).alias("hot"))
    return staged(_dealt(seeds, "key").join(_copied(twice), ["h", "salt"]).drop("salt"), "seeds")


def _extended(spans: DataFrame, window: int, seed: int) -> DataFrame:
    """`spans` (h, e, a, hot, n, first) with left and right: at how many of lengths() the words that end with the seed, and those that
    start with it, are repeated. What is repeated on neither side at one length is dropped and not looked at further."""
    spans = spans.withColumns({"left": F.lit(0), "right": F.lit(0)})
    for n, size in enumerate(lengths(window, seed)):
        for k, side in enumerate(("left", "right")):
            x = F.substring("a", EXTENSION * (2 * n + k) + 1, EXTENSION)
            own = spans.withColumn("x", F.when((F.col(side) == n) & (x != F.lit(bytes(EXTENSION))), x))
            again = own.where("x is not null").groupBy("h", "x").agg(F.sum("n").alias("c"), F.max("hot").alias("hot")).where("c > 1").select("h", "x", "hot", F.lit(1).alias("again"))
            spans = _dealt(own, "e").join(_copied(again), ["h", "x", "salt"], "left")
            spans = spans.withColumn(side, F.col(side) + F.coalesce("again", F.lit(0))).drop("x", "salt", "again")
        spans = staged(spans.where((F.col("left") > n) | (F.col("right") > n)), f"extended{size}")
        if spans.isEmpty():
            break
    return spans


def _states(raw: list[bytes], places, window: int, seed: int) -> tuple[Windows, np.ndarray]:
    """The windows, and for each what is known of it: -1 not repeated, else the state of its seed. places: of each text
    (positions, states, left, right). A window that reaches as far from its seed as a length needs that side to be repeated at it."""
    w = Windows(raw, window, seed)
    known = np.zeros((3, len(w.seeds) + 1), np.int8)
    known[0] = -1
    for n, (pos, *own) in enumerate(places):
        known[:, w.words.first[n] + pos] = own
    if not len(w.seed):
        return w, np.zeros(0, np.int8)
    state, left, right = known[:, w.seed]
    before = w.seed - w.start
    after = window - seed - before
    needs = lambda reach: np.searchsorted(np.array(lengths(window, seed), np.int64) - seed, reach, "right")
    short = (left < needs(before)) | (right < needs(after))
    return w, np.where(short & (state > SETTLED), np.int8(-1), state)


def _places(column: pa.Array) -> list[tuple[np.ndarray, ...]]:
    """An array column of pos << 12 | left << 7 | right << 2 | state."""
    out = []
    for x in column:
        v = np.asarray(x.values.to_numpy() if x.is_valid else [], np.int64)
        out.append((v >> 12, *((y & m).astype(np.int8) for y, m in ((v, 3), (v >> 7, 31), (v >> 2, 31)))))
    return out


def _asked(held: DataFrame, window: int, seed: int) -> DataFrame:
    """(h1, h2, key, p, ask) of the windows whose seed asks or tells."""

    def run(batches):
        for b in batches:
            raw, places = utf8(b.column(1)), _places(b.column(2))
            for i, j in chunks(raw):
                w, state = _states(raw[i:j], places[i:j], window, seed)
                take = state > SETTLED
                if not take.any():
                    continue
                start, doc = w.start[take], w.doc[take]
                with np.errstate(over="ignore"):
                    h = [ranges_hash(v, start, start + window) for v in (w.words.hash, mix(w.words.hash + _SALT))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), b.column(0).take(pa.array(doc + i)), pa.array((start - w.words.first[doc]).astype(np.int32)), pa.array(state[take] == ASK)],
                    ["h1", "h2", "key", "p", "ask"],
                )

    return held.select("key", "text", "places").mapInArrow(task(run), "h1 long, h2 long, key binary, p int, ask boolean")


def _cut(held: DataFrame, window: int, seed: int) -> DataFrame:
    """(key, n_removed, kept) of (key, text, places, starts)."""

    def run(batches):
        for b in batches:
            raw, places, starts = utf8(b.column(1)), _places(b.column(2)), b.column(3)
            removed, kept = [], []
            for i, j in chunks(raw):
                w, state = _states(raw[i:j], places[i:j], window, seed)
                again = (state == SETTLED) | (state == TELL)
                edge = np.zeros(len(w.words.hash) + 1, np.int64)
                np.add.at(edge, w.start[again], 1)
                np.add.at(edge, w.start[again] + window, -1)
                for n in range(i, j):
                    if starts[n].is_valid:
                        p = starts[n].values.to_numpy() + w.words.first[n - i]
                        np.add.at(edge, p, 1)
                        np.add.at(edge, p + window, -1)
                stay = np.cumsum(edge)[:-1] == 0
                for n in range(j - i):
                    s, e = w.words.first[n], w.words.first[n + 1]
                    own = raw[i + n].split()
                    left = [own[k] for k in np.flatnonzero(stay[s:e]).tolist()]
                    removed.append(len(own) - len(left))
                    kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["key", "n_removed", "kept"])

    return held.select("key", "text", "places", "starts").mapInArrow(task(run), "key binary, n_removed long, kept string")


def _whole(docs: DataFrame) -> DataFrame:
    """(id, key, n_words, words): every text's words, joined by one space."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            raw = utf8(b.column(2))
            for i, j in chunks(raw, 4 << 20):
                own = [t.split() for t in raw[i:j]]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(2)), pa.array([len(x) for x in own], pa.int64()), pa.array([b" ".join(x).decode() for x in own], pa.string())], ["id", "key", "n_words", "words"])

    return docs.mapInArrow(task(run), f"id {kind}, key binary, n_words long, words string")


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, cut): rows is (id, key, n_words, words) of every row of `df`; cut is (key, n_removed, kept) of each
    different text that has words removed, or a repeated seed at least (more than once where rows repeat id and text). A
    row joins its text's cut by key.

    A window is `window` consecutive words of one text. Every word that a window covers whose word sequence also starts
    anywhere else, in the same text too, is removed; windows are judged on the input. A null text has no words; texts of
    fewer words than a window lose none; rows that repeat a text make all its windows repeated; ids may be null
    or repeat; an empty table gives empty results; other columns are not read.

    Repetition is looked for at doubled lengths, and what is repeated at one length alone is extended to twice that, until
    nothing is left. The least length is `seed` words. Of the seeds in a window only that of the least hash is looked
    at, which equal windows share. Repeated seeds are extended to twice their length, to the left and to the right, and again to twice that
    while it is less than a window: a window that reaches so far from its seed on one side is not repeated unless these words are. What survives
    is extended to all the words of windows around it, almost twice a window: where these are repeated too, so is every window of the seed.
    For the others the windows are compared themselves, with those of one text for each such span. Repetition is
    counted by sums and told by joins, in which seeds that are a large share of all have salts, so a passage that a
    third of all texts hold is never in one task. Texts and windows are named by 128 bits, and so are spans with their seeds."""
    docs = _keyed(df, id_col, text_col)
    again = _repeated(docs, window, seed)
    spans = again.groupBy("h", "e").agg(F.sum(F.size("pos")).alias("n"), F.min("key").alias("first"), F.first("a").alias("a"), F.max("hot").alias("hot"))
    spans = _extended(staged(spans, "spans"), window, seed)
    alone = spans.where("n = 1").groupBy("h").agg(F.max("hot").alias("hot")).withColumn("open", F.lit(True))
    spans = _dealt(spans, "e").join(_copied(alone), ["h", "salt"], "left").select("h", "e", "n", "first", "left", "right", F.coalesce("open", F.lit(False)).alias("open"))
    told = again.select("key", "h", "e", "pos").join(spans, ["h", "e"])
    one = F.col("key") == F.col("first")
    told = told.select("key", "n", "left", "right", (F.col("open") & one).alias("tells"), F.posexplode("pos").alias("nth", "pos"))
    state = F.when(F.col("n") == 1, ASK).when(F.col("tells") & (F.col("nth") == 0), TELL).otherwise(SETTLED)
    places = told.select("key", (F.col("pos").cast("long") * 4096 + F.col("left") * 128 + F.col("right") * 4 + state).alias("place")).groupBy("key").agg(F.collect_set("place").alias("places"))
    owner = docs.groupBy("key").agg(F.min("id").alias("owner"))
    held = docs.join(places.join(owner, "key").withColumnRenamed("key", "own"), F.expr("key = own AND id <=> owner"))
    held = staged(held.select("key", "text", "places"), "held")
    asked = staged(_asked(held, window, seed), "windows")
    more = asked.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    starts = asked.where("ask").join(more, ["h1", "h2"]).groupBy("key").agg(F.collect_set("p").alias("starts"))
    cut = _cut(held.join(starts, "key", "left"), window, seed)
    return _whole(docs), cut


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_removed, kept) for every row: kept is the words that stay, joined by one space. Null texts, few words, repeated
    rows and empty tables are as in repeated_passages()."""
    rows, cut = repeated_passages(df, id_col, text_col, window, seed)
    cut = staged(cut.dropDuplicates(["key"]), "cut")
    both = rows.join(cut, "key", "left")
    return both.select("id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "words").alias("kept"))
