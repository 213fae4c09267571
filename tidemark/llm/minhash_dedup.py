"""Near duplicates by a chosen-path set similarity join over word shingles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Words, by_group, chunks, documents_select, kept, mix, staged, task, utf8
from .graph import components

SHINGLE = 5
#: Links have 100 * intersection >= threshold * union; the default.
THRESHOLD = 85
#: Trees of the first round, and the most trees there can be.
FIRST, MOST_TREES = 3, 64
#: Bytes of a sketch, one of each minwise token.
SKETCH = 128
#: A pair is compared in full unless its sketches agree in fewer bytes than at the threshold by so many deviations.
DEVIATIONS = 4
#: Deviations of a sketch, at the distance where it deviates most, by which a document must be too far from all others to leave a node.
SURE = 5
#: What a leaf holds at most, compared exhaustively: documents, and a thousand shingles count as one more.
LEAF = 4000
#: Levels after which a node is cut into blocks whose pairs are compared instead.
DEPTH = 12
#: Tasks that the documents of one large node are dealt to where they meet what is known of it.
SALTS = 32
#: Rows of an id and a key, some MB, up to which texts are looked up where they are read instead of being shuffled.
BROADCAST = 100_000
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 2**63, SKETCH + MOST_TREES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, SKETCH + MOST_TREES, np.uint64) * np.uint64(2)
_C = _RNG.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def agreement(threshold: int, deviations: float = DEVIATIONS) -> int:
    """Bytes that the sketches of a pair at the threshold agree in, less so many binomial deviations."""
    t = threshold / 100
    return max(0, math.floor(SKETCH * t - deviations * math.sqrt(SKETCH * t * (1 - t))))


def branching(threshold: int) -> float:
    """The share of nodes with two children: with a chance of the threshold to stay together in each, a pair at the
    threshold is expected in one child."""
    return min(1.0, 100 / threshold - 1)


def trees(threshold: int, missed: float = 3e-6) -> int:
    """As many trees as it takes that of pairs at the threshold not more than `missed` are in no leaf at the second level below the
    roots, if trees are independent."""
    t, two = threshold / 100, branching(threshold)
    lost = 0.0
    for _ in range(2):
        apart = 1 - t + t * lost
        lost = (1 - two) * apart + two * apart * apart
    apart = 1 - t + t * lost
    return min(MOST_TREES, max(FIRST, math.ceil(math.log(missed) / math.log(apart)))) if 0 < apart < 1 else FIRST


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the different shingles of k words of each text, ascending; of a text of fewer words the
    whole sequence; 64 bits each."""
    w = Words(texts, lower=True)
    start, end = w.first[:-1], w.first[1:]
    count = np.where(w.n > 0, np.maximum(w.n - k + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + start[doc]
    value = np.zeros(len(doc), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            there = at + j < end[doc]
            value += np.where(there, w.hash[np.minimum(at + j, max(0, len(w.hash) - 1))] * _C[j] + _C[63 - j], np.uint64(0)) if len(w.hash) else np.uint64(0)
    value = mix(value)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts))))).astype(np.int64)


def set_keys(value: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128 bits that name each set."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value + c)))) for c in (_C[20], _C[21])]
        both = np.stack([mix(s[offsets[1:]] - s[offsets[:-1]]) for s in sums], axis=1)
    raw = both.astype(">u8").tobytes()
    return [raw[16 * i : 16 * i + 16] for i in range(len(offsets) - 1)]


def signatures(value: np.ndarray, offsets: np.ndarray, n_trees: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(roots, sketch) of each set: its minwise token in each tree's root, in full, and SKETCH others as a byte each."""
    n = len(offsets) - 1
    full = np.flatnonzero(np.diff(offsets))
    mins = np.zeros((n, SKETCH + n_trees), np.uint64)
    with np.errstate(over="ignore"):
        if len(full):
            for j in range(SKETCH + n_trees):
                mins[full, j] = np.minimum.reduceat(value * _A[j] + _B[j], offsets[:-1][full])
    mins = mix(mins)
    return mins[:, SKETCH:], (mins[:, :SKETCH] & np.uint64(255)).astype(np.uint8)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, digest): the digest names the text, null as empty."""
    return documents_select(df, id_col, text_col).withColumn("digest", F.unhex(F.md5("text")))


def _described(df: DataFrame, id_col: str, text_col: str, k: int, n_trees: int) -> DataFrame:
    """(id, digest, n, key, roots, sketch) for every row."""
    kind = df.schema[id_col].dataType

    def run(batches):
        for b in batches:
            raw = utf8(b.column(1))
            for i, j in chunks(raw):
                value, offsets = shingle_sets(raw[i:j], k)
                roots, sketch = signatures(value, offsets, n_trees)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, roots.size + 1, n_trees), pa.int32()), pa.array(roots.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(np.diff(offsets)), pa.array(set_keys(value, offsets), pa.binary()), lists, pa.array([x.tobytes() for x in sketch], pa.binary())],
                    ["id", "digest", "n", "key", "roots", "sketch"],
                )

    return _texts(df, id_col, text_col).mapInArrow(task(run), f"id {kind.simpleString()}, digest binary, n long, key binary, roots array<long>, sketch binary")


def _agreeing(sketch: np.ndarray, agree: int, group: np.ndarray | None = None):
    """(i, j, agreement) of the pairs i < j that agree in so many bytes, in blocks of rows; group: only between
    different values."""
    n = len(sketch)
    step = max(1, (1 << 22) // (n * sketch.shape[1]))
    for s in range(0, n, step):
        block = sketch[s : s + step]
        same = (block[:, None, :] == sketch[None, s:, :]).sum(axis=2)
        same[np.arange(len(block))[:, None] >= np.arange(n - s)[None, :]] = 0
        if group is not None:
            same[group[s : s + step][:, None] == group[None, s:]] = 0
        i, j = np.nonzero(same >= agree)
        yield i + s, j + s, same[i, j]


def _screened(rows: DataFrame, agree: int) -> DataFrame:
    """Of (tree, node, key, sketch) the rows with another in their node that agrees with them enough."""

    def work(group):
        node, tree, key, sketch = group
        n = len(key)
        x = np.frombuffer(b"".join(sketch), np.uint8).reshape(n, -1)
        if n == 2:
            near = np.full(2, (x[0] == x[1]).sum() >= agree)
        else:
            near = np.zeros(n, bool)
            for i, j, _ in _agreeing(x, agree):
                near[i] = near[j] = True
        if near.any():
            take = np.flatnonzero(near).tolist()
            yield [tree[i] for i in take], [node[i] for i in take], [key[i] for i in take]

    kinds, names = (pa.int32(), pa.int64(), pa.binary()), ["tree", "node", "key"]

    def run(batches):
        out = ([], [], [])
        for found in by_group(batches, work, 4):
            for held, x in zip(out, found):
                held.extend(x)
            if len(out[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)
                out = ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)

    return rows.select("node", "tree", "key", "sketch").repartition("node").sortWithinPartitions("node").mapInArrow(task(run), "tree int, node long, key binary")


class Sets:
    """The sets of one leaf as rows of bits over those of their elements that several have."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), self.size)
        _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
        several = times > 1
        number = np.cumsum(several) - 1
        keep = several[code]
        column, row = number[code[keep]], row[keep]
        width = -(-max(1, int(several.sum())) // 64) * 8
        self.bits = np.zeros((len(sets), width), np.uint8)
        np.bitwise_or.at(self.bits, (row, column >> 3), np.left_shift(1, column & 7).astype(np.uint8))
        self.bits = self.bits.view(np.uint64)

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        step = max(1, (1 << 20) // self.bits.shape[1])
        for s in range(0, len(i), step):
            out[s : s + step] = np.bitwise_count(self.bits[i[s : s + step]] & self.bits[j[s : s + step]]).sum(axis=1)
        return out


def leaf_links(keys: list, comps: list, sketches: list[bytes], sets: list[np.ndarray], agree: int, threshold: int) -> list[tuple[bytes, bytes]]:
    """Edges that join what is not joined yet: from the documents of a leaf whose component grows to the least there, so
    that components are those of all links in it. Pairs whose sketches agree enough are compared in full, the most alike first, unless
    links found before already join them."""
    names: dict = {}
    root = np.array([names.setdefault(c, i) for i, c in enumerate(comps)])
    x = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(keys), -1)
    found = list(_agreeing(x, agree, root))
    i, j, same = (np.concatenate([f[c] for f in found]) for c in range(3))
    if not len(i):
        return []
    whole, before = Sets(sets), root.copy()
    order = np.argsort(-same, kind="stable")
    i, j = i[order], j[order]
    while len(i):
        a, b = i[:4096], j[:4096]
        shared = whole.shared(a, b)
        linked = 100 * shared >= threshold * (whole.size[a] + whole.size[b] - shared)
        for p, q in zip(a[linked].tolist(), b[linked].tolist()):
            if root[p] != root[q]:
                root[root == root[q]] = root[p]
        i, j = i[4096:], j[4096:]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    # one document stands for each old component; of those in a new one, each is tied to the least
    stands, out = {}, []
    for n in np.unique(before, return_index=True)[1].tolist():
        stands.setdefault(root[n], []).append(keys[n])
    for own in stands.values():
        least = min(own)
        out.extend((k, least) for k in own if k != least)
    return out


def _linked(rows: DataFrame, agree: int, threshold: int) -> DataFrame:
    """Edges (u, v) found in the leaves of (node, key, comp, sketch, elements)."""

    def work(group):
        _, keys, comps, sketches, sets = group
        first: dict = {}
        for n, key in enumerate(keys):
            first.setdefault(key, n)
        take = list(first.values())
        pick = lambda x: [x[n] for n in take]
        if len(take) > 1:
            if links := leaf_links(pick(keys), pick(comps), pick(sketches), [np.frombuffer(s, np.uint64) for s in pick(sets)], agree, threshold):
                yield links

    def run(batches):
        for links in by_group(batches, work, 5):
            u, v = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    cols = rows.select("node", "key", "comp", "sketch", "elements")
    return cols.repartition("node").sortWithinPartitions("node").mapInArrow(task(run), "u binary, v binary")


def _sets_of(df: DataFrame, needed: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(key, sketch, elements) of the documents whose (rep, key) are needed, from the texts of the rows that rep names."""

    def run(batches):
        for b in batches:
            raw = utf8(b.column(1))
            want = b.column(0).to_pylist()
            for i, j in chunks(raw):
                value, offsets = shingle_sets(raw[i:j], k)
                keys = set_keys(value, offsets)
                _, sketch = signatures(value, offsets)
                take = [n for n in range(j - i) if keys[n] == want[i + n]]
                columns = ([keys[n] for n in take], [sketch[n].tobytes() for n in take], [value[offsets[n] : offsets[n + 1]].tobytes() for n in take])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["key", "sketch", "elements"])

    needed = kept(needed)
    if needed.count() <= BROADCAST:
        needed = F.broadcast(needed)
    needed = needed.select("key", F.col("rep.id").alias("rep_id"), F.col("rep.digest").alias("rep_digest"))
    texts = _texts(df, id_col, text_col).join(needed, F.expr("id <=> rep_id AND digest = rep_digest")).select("key", "text")
    return texts.mapInArrow(task(run), "key binary, sketch binary, elements binary")


def _branch(rows: DataFrame, threshold: int) -> DataFrame:
    """The children of (node, key): by the token at the position that the node selects, and in a share of nodes by a
    second one, so that 100 / threshold children are expected."""
    at = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(SKETCH)).cast("int")
    token = lambda salt: F.xxhash64("node", F.lit(salt), F.substr("sketch", at(salt) + 1, F.lit(1)))
    second = F.pmod(F.xxhash64("node", F.lit("second")), F.lit(1000)) < int(1000 * branching(threshold))
    children = F.when(second, F.array(token("a"), token("b"))).otherwise(F.array(token("a")))
    return rows.select("tree", F.explode(children).alias("node"), "key", "weight", "sketch")


def _told(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """`rows` with the columns of their node, if `nodes` has it."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    nodes = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(nodes, ["node", "salt"], "left").drop("salt")


def _collapsed(rows: DataFrame, reps: DataFrame, df: DataFrame, id_col: str, text_col: str, k: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(edges, rows left) of nodes that are too large: each picks a pivot; documents whose sketches all but equal its are
    compared with it in full. Those that are linked to it leave the node unless something there could be linked to
    them but not to the pivot: by the triangle inequality of Jaccard distances, only what is nearer to the pivot than the
    threshold's distance and their own distance together. Their own distance is that of the whole sets; of the others only
    the sketch is known, and a margin of SURE deviations is added, whatever its distance. Sketches all but equal at half the
    threshold's distance and a little."""
    apart = 1 - threshold / 100
    core_far, margin = apart * 8 / 15, SURE * math.sqrt(0.25 / SKETCH)
    pivot = rows.groupBy("node").agg(F.min_by(F.struct("key", "sketch"), F.xxhash64("key", "node")).alias("p"))
    rows = _told(rows, pivot.select("node", F.col("p.key").alias("pivot"), F.col("p.sketch").alias("pivot_sketch")))

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in (4, 6))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(6)), pa.array((x != y).mean(axis=1))], [*_ROW, "pivot", "far"])

    rows = staged(rows.select(*_ROW, "pivot", "pivot_sketch").mapInArrow(task(run), "tree int, node long, key binary, weight double, sketch binary, pivot binary, far double"), "nodes")
    core = staged(rows.where((F.col("far") <= core_far) & (F.col("key") != F.col("pivot"))).select("key", "pivot").distinct(), "core")
    both = core.select("key").union(core.select("pivot")).distinct()
    sets = staged(_sets_of(df, both.join(reps, "key").select("rep", "key"), id_col, text_col, k), "sets")

    def compare(batches):
        for b in batches:
            key, pivot = b.column(0).to_pylist(), b.column(1).to_pylist()
            ok, own = [], []
            for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                n = len(np.intersect1d(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), assume_unique=True))
                union = (len(s) + len(t)) // 8 - n
                ok.append(100 * n >= threshold * union)
                own.append(1 - n / union)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(pivot, pa.binary()), pa.array(own, pa.float64())], ["u", "v", "own"]).filter(pa.array(ok, pa.bool_()))

    once = sets.groupBy("key").agg(F.first("elements").alias("elements"))
    other = once.select(F.col("key").alias("pivot"), F.col("elements").alias("pivot_elements"))
    edges = staged(core.join(once, "key").join(other, "pivot").select("key", "pivot", "elements", "pivot_elements").mapInArrow(task(compare), "u binary, v binary, own double"), "links")
    rows = rows.join(edges, (F.col("key") == F.col("u")) & (F.col("pivot") == F.col("v")), "left").withColumn("tied", F.col("u").isNotNull() | (F.col("key") == F.col("pivot"))).drop("u", "v")
    nearest = rows.where("not tied").groupBy("node").agg(F.min("far").alias("open"))
    left = _told(rows, nearest).where(~F.col("tied") | (F.coalesce("own", F.lit(0.0)) + apart + margin >= F.col("open")))
    return edges.select("u", "v"), left.select(*_ROW)


_ROW = ("tree", "node", "key", "weight", "sketch")


def _sizes(rows: DataFrame) -> DataFrame:
    """(node, size) of nodes with two documents or more."""
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("size")).where("n > 1").drop("n")


def _leaves(sigs: DataFrame, reps: DataFrame, df: DataFrame, id_col: str, text_col: str, k: int, threshold: int, leaf: int, depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """((tree, node, key, sketch) rows of leaves with two documents or more, edges found on the way)."""
    light = sigs.select("key", "weight", F.posexplode("roots").alias("tree", "token")).select("tree", F.xxhash64("tree", "token").alias("node"), "key", "weight")
    rows = kept(light.join(_sizes(light), "node").drop("weight").join(sigs.select("key", "weight", "sketch"), "key").select(*_ROW, "size"))
    leaves, edges = [rows.where(F.col("size") <= leaf).drop("size")], []
    level = 0
    while not (large := rows.where(F.col("size") > leaf)).isEmpty():
        found, left = _collapsed(large.drop("size"), reps, df, id_col, text_col, k, threshold)
        edges.append(found)
        if level == depth:
            leaves.append(_blocks(left, leaf))
            break
        level += 1
        children = staged(_branch(left, threshold), "nodes")
        rows = staged(children.join(_sizes(children), "node").select(*_ROW, "size"), "nodes")
        leaves.append(rows.where(F.col("size") <= leaf).drop("size"))
    return _union(leaves), edges


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _blocks(rows: DataFrame, leaf: int) -> DataFrame:
    """A leaf for every two blocks of half a leaf's documents of each node, and so one that holds any two of them."""
    sizes = rows.groupBy("node").agg(F.ceil(F.sum("weight") / (leaf / 4)).cast("int").alias("blocks"))
    rows = rows.join(sizes, "node").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("tree", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "key", "weight", "sketch")


def _judged(df: DataFrame, id_col: str, text_col: str, k: int, threshold: int, leaf: int, depth: int) -> DataFrame:
    """(id, digest, n, least) for every row: least is the (none, id, digest) of the first row of its component, by id, null
    last, and text; null for a row without shingles."""
    sigs = kept(_described(df, id_col, text_col, k, trees(threshold)))
    row = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    once = sigs.where("n > 0").groupBy("key").agg(F.min(row).alias("rep"), F.first(F.struct("roots", "sketch", (1 + F.col("n") / 1000).alias("weight"))).alias("s"))
    reps = staged(once.select("key", "rep", "s.*"), "reps")
    names = reps.select("key", "rep")
    leaves, edges = _leaves(reps, names, df, id_col, text_col, k, threshold, leaf, depth)
    near = kept(_screened(leaves, agreement(threshold)))
    needed = near.select("key").distinct().join(reps, "key")
    sets = kept(_sets_of(df, needed.select("rep", "key"), id_col, text_col, k))
    first = near.where(F.col("tree") < FIRST).withColumn("comp", F.col("key"))
    edges.append(staged(_linked(first.join(sets, "key"), agreement(threshold), threshold), "links"))
    found = staged(components(_union(edges)), "components")
    joined = found.select(F.col("node").alias("key"), "root")
    later = near.where(F.col("tree") >= FIRST).join(joined, "key", "left").withColumn("comp", F.coalesce("root", "key")).drop("root")
    mixed = later.groupBy("node").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b").select("node")
    later = later.join(mixed, "node")
    more = _linked(later.join(sets, "key"), agreement(threshold), threshold)
    stars = found.select(F.col("node").alias("u"), F.col("root").alias("v"))
    final = components(more.unionByName(stars)).select(F.col("node").alias("key"), "root")
    whole = names.join(final, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = whole.groupBy("root").agg(F.min("rep").alias("least"))
    of = whole.join(least, "root").select("key", "least")
    return sigs.select("id", "digest", "n", "key").join(of, "key", "left").drop("key")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: int = THRESHOLD, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of `df`.

    Rows are linked when the sets of k-word shingles of their whole texts (A-Z lower-cased; fewer words: the whole
    sequence) share `threshold` hundredths of their union; components are those of the links; component_id is the
    least id of a component and `kept` whether it is the row's own. A null text, or one without words, has no shingles and is a component
    of its own. A null id comes after all others; rows that repeat an id are rows like any other, and those of a
    component's least id are all kept. An empty table gives an empty result; other columns are not read.

    Rows of equal sets are one document. Each of trees(threshold) trees branches documents by their minwise token, again in nodes
    of more than `leaf` documents, until nodes are leaves, whose pairs are all compared: first sketches, then, where
    these agree, whole sets. What the first trees join is not compared again in the others. No step holds
    more than a leaf in one task or emits more edges than a leaf has documents. Pairs at the threshold are missed with small
    chances only: by all trees (the README has the figures), by sketches that agree DEVIATIONS deviations too
    little, or in a large node by a sketch that is SURE deviations off."""
    rows = _judged(df, id_col, text_col, k, threshold, leaf, depth)
    own = F.when(F.col("n") > 0, F.col("least.id")).otherwise(F.col("id"))
    return rows.select("id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def kept_only(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: int = 80, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """The rows of `df` that stay, with its columns: of each component of near_duplicates() the row of the least id, null last; of
    several texts with that id, that of the least digest; of rows that repeat both, all. Rows without shingles stay. An empty
    table gives an empty result; other columns pass through."""
    rows = _judged(df, id_col, text_col, k, threshold, leaf, depth)
    stay = (F.col("n") == 0) | (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("digest") == F.col("least.digest")))
    stay = rows.where(stay).select(F.col("id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return df.join(stay, F.col(id_col).eqNullSafe(F.col("__id")) & (digest == F.col("__digest")), "left_semi")
