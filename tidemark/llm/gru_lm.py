"""A gated recurrent language model in numpy: class-factored output, truncated backpropagation, states carried over."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import list_array, small_batches, staged, task, utf8

HIDDEN = 16
#: Words of the head, each with weights of its own, and of a class of them.
HEAD, CLASS = 2048, 64
#: Tail classes: other words by a hash of their last three bytes; within one, words have their corpus shares.
TAIL = 32
#: Words whose corpus counts every worker knows; those of the rest come by a join. None is longer than LONGEST bytes.
KNOWN, LONGEST = 1 << 18, 64
#: Tokens that one replica of the weights learns from, about, the rounds in which it does, and weights that are averaged together.
REPLICA, ROUNDS, BLOCK = 6_000_000, 3, 8192
#: How far the weights go along the mean step of several replicas, which has less noise than that of one.
BEYOND = 1.5
#: Steps that gradients go back, texts side by side at most and at least, tokens for each of them, and tokens that they are dealt from.
WINDOW, LANES, FEW, LANE, DEALT = 16, 256, 32, 8192, 3_000_000
#: Texts that are scored side by side, and bytes of their tokens that they are chosen from, so that few long ones seldom run alone.
SIDE, TOGETHER = 512, 1 << 23
#: Tokens whose classes are computed at once, so that their numbers stay in a processor's cache.
COLUMNS = 512
RATE = 0.2
END = b"\n"  # no word has a line break


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAIL


def words_of(text: bytes) -> list[bytes]:
    """Tokens but for the end: words, A-Z lower-cased."""
    return text.lower().split()


class Vocabulary:
    """head: words by falling count, END among them; counts of all KNOWN words; tail totals."""

    def __init__(self, known: list[tuple[bytes, int]], tail_tokens: np.ndarray, tail_words: np.ndarray, tokens: int, distinct: int, head: int = HEAD):
        order = sorted(known, key=lambda x: (-x[1], x[0]))
        first = [x for x in order if x[0] == END] or [(END, 0)]
        order = first + [x for x in order if x[0] != END]
        self.size = min(head, len(order))
        top = sorted(order[: self.size], key=lambda x: (-x[1], x[0]))
        order = top + order[self.size :]
        self.number = {w: i for i, (w, _) in enumerate(order)}
        self.end = self.number[END]
        self.count = np.array([c for _, c in order], np.int64)
        self.classes = -(-self.size // CLASS)
        tail = np.array([tail_class(w) for w, _ in order], np.int64)
        tail[: self.size] = -1
        #: token of each known word: its number in the head, or the size of all head classes and its tail class
        self.token = np.where(tail < 0, np.arange(len(order)), self.classes * CLASS + tail)
        self.inputs = self.classes * CLASS + TAIL
        self.kind = np.int16 if self.inputs < 1 << 15 else np.int32
        self.tokens, self.distinct = tokens, distinct
        self.tail_log = np.log10(np.maximum(tail_tokens + tail_words + 1, 1))
        #: log10 of the corpus share within its tail class; 0 in the head
        self.within = np.where(tail < 0, 0.0, np.log10(self.count + 1) - self.tail_log[np.maximum(tail, 0)])
        mass = np.zeros(self.classes * CLASS)
        mass[: self.size] = self.count[: self.size] + 1
        self.head_mass, self.tail_mass = mass, tail_tokens + tail_words + 1.0

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, token) of each."""
        number = np.fromiter(map(self.number.get, words, itertools.repeat(-1)), np.int64, len(words))
        token = self.token[number]
        for i in np.flatnonzero(number < 0).tolist():
            token[i] = self.classes * CLASS + tail_class(words[i])
        return number, token


def _exp(logit: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials, in place, and their sum) of each column. `reach` bounds the logits: far ones are shifted first, which
    leaves shares as they are."""
    if reach > 60:
        logit -= logit.max(axis=0)
    e = np.exp(logit, out=logit)
    return e, np.ones(len(e), e.dtype) @ e


def _logs(logit: np.ndarray, want: np.ndarray, at: np.ndarray, reach: float) -> np.ndarray:
    """The log of the wanted share of each column."""
    if reach > 60:
        logit -= logit.max(axis=0)
    out = logit[want, at]
    out -= np.log(_exp(logit, 0)[1])
    return out


class Gru:
    """One layer. z, r and n gates stand side by side; the input's part of them is a table with a row for each token."""

    def __init__(self, classes: int, mass: tuple[np.ndarray, np.ndarray], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.hidden, self.classes, h = hidden, classes, hidden
        heads, tails = mass
        by_class = np.concatenate((heads.reshape(classes, CLASS).sum(axis=1), tails))
        with np.errstate(divide="ignore"):
            self.p = {
                "x": rng.normal(0, 0.1, (len(heads) + len(tails), 3 * h)),
                "u": rng.normal(0, 0.3, (h, 3 * h)),
                "wc": np.zeros((h, len(by_class))),
                "bc": np.log(by_class / by_class.sum()),
                "ww": np.zeros((classes, CLASS, h)),
                "bw": np.maximum(np.log(heads), -30).reshape(classes, CLASS),
            }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.squares = {k: np.full(v.shape, 1e-2, np.float32) for k, v in self.p.items()}

    def step(self, x: np.ndarray, state: np.ndarray, into=(None, None, None, None)) -> np.ndarray:
        """The next state of each column, from the rows of the table "x" for what it reads, as columns. `into` are places
        for the state's part of the gates' inputs, gates z and r, n, and the result."""
        h, (a, zr, n, out) = self.hidden, into
        a = np.matmul(self.p["u"].T, state, out=a)
        zr = np.add(x[: 2 * h], a[: 2 * h], out=zr)
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        n = np.multiply(zr[h:], a[2 * h :], out=n)
        n += x[2 * h :]
        np.tanh(n, out=n)
        out = np.subtract(state, n, out=out)
        out *= zr[:h]
        out += n
        return out

    def output(self, state: np.ndarray, token: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray | None, np.ndarray | None]:
        """(natural log of the probability of each token, or of its tail class; None) or, with `grads`, (None; gradient of
        the sum by state). States are sorted by class and stand in columns, so that sums run along memory, with a row of ones,
        by which one product has the biases too."""
        p, h, heads = self.p, self.hidden, self.classes * CLASS
        of = np.where(token < heads, token // CLASS, token - heads + self.classes).astype(np.int16)
        order = np.argsort(of, kind="stable")
        of, t = of[order], token[order]
        s = np.empty((h + 1, len(t)), state.dtype)
        np.take(state.T, order, axis=1, out=s[:h], mode="clip")
        s[h] = 1
        edge = np.searchsorted(of, np.arange(self.classes + 1))
        at = np.arange(len(t))
        most = max(1.0, float(s.max()), -float(s.min()))
        reach = np.abs(p["bc"]).max() + most * np.abs(p["wc"]).sum(axis=0).max()
        reaches = np.abs(p["bw"]).max(axis=1) + most * np.abs(p["ww"]).sum(axis=2).max(axis=1)
        wc = np.concatenate((p["wc"], p["bc"][None])).T.copy()
        ww = np.concatenate((p["ww"], p["bw"][:, :, None]), axis=2)
        out = back = None
        if grads is None:
            out = np.empty(len(t), s.dtype)
        else:
            back = np.empty((h, len(t)), s.dtype)
            by_c = np.zeros_like(wc)
        for i in range(0, len(t), COLUMNS):
            j = min(i + COLUMNS, len(t))
            logit = wc @ s[:, i:j]
            if grads is None:
                out[i:j] = _logs(logit, of[i:j], at[: j - i], reach)
                continue
            # the gradient by logit, but for the factor `scale`, which is taken into what it is multiplied by
            d, total = _exp(logit, reach)
            d[of[i:j], at[: j - i]] -= total
            scale = -1 / total
            by_c += d @ (s[:, i:j] * scale).T
            np.matmul(p["wc"], d, out=back[:, i:j])
            back[:, i:j] *= scale
        for k in np.flatnonzero(np.diff(edge)).tolist():
            i, j = edge[k], edge[k + 1]
            logit = ww[k] @ s[:, i:j]
            if grads is None:
                out[i:j] += _logs(logit, t[i:j] - k * CLASS, at[: j - i], reaches[k])
                continue
            d, total = _exp(logit, reaches[k])
            d[t[i:j] - k * CLASS, at[: j - i]] -= total
            scale = -1 / total
            by_w = d @ (s[:, i:j] * scale).T
            grads["ww"][k] += by_w[:, :h]
            grads["bw"][k] += by_w[:, h]
            more = p["ww"][k].T @ d
            more *= scale
            back[:, i:j] += more
        if grads is None:
            logs = np.empty_like(out)
            logs[order] = out
            return logs, None
        grads["wc"] += by_c[:, :h].T
        grads["bc"] += by_c[:, h]
        place = np.empty_like(order)
        place[order] = at
        return None, np.take(back, place, axis=1).T

    def learn(self, texts: list[np.ndarray], end: int, lanes: int = LANES, window: int = WINDOW, rate: float = RATE) -> int:
        """One pass over whole texts, as tokens with the end: lanes read texts one after another; gradients go back
        `window` steps, or up to eight times as many where few lanes have begun; states go on. Adagrad. Returns the number of tokens."""
        h, p = self.hidden, self.p
        tokens, longest = sum(map(len, texts)), max(map(len, texts), default=1)
        # few where one text is most, or where there would be few steps
        lanes = max(1, min(lanes, len(texts), 4 * tokens // max(1, longest), max(FEW, tokens // LANE)))
        streams: list[list[np.ndarray]] = [[] for _ in range(lanes)]
        sizes = [0] * lanes
        for t in sorted(texts, key=len, reverse=True):
            k = sizes.index(min(sizes))
            streams[k].append(t)
            sizes[k] += len(t)
        steps = max(sizes)
        # lanes end together, so that the last steps are not those of one long text
        begin = steps - np.array(sizes)
        target = np.full((lanes, steps), -1, np.int32)
        for k, s in enumerate(streams):
            if s:
                target[k, begin[k] :] = np.concatenate(s)
        source = np.concatenate((np.full((lanes, 1), end, np.int32), target[:, :-1]), axis=1)
        full = np.flatnonzero(begin < steps)
        source[full, begin[full]] = end
        state = np.zeros((h, lanes), np.float32)
        squares = self.squares
        least, s = window, 0
        while s < steps:
            window = least * min(8, max(1, lanes // max(1, int((begin <= s).sum()))))  # as many tokens, where few lanes have begun
            live = np.flatnonzero(begin < min(s + window, steps))
            tok, src = target[live, s : s + window].T, source[live, s : s + window].T
            s += window
            read = np.maximum(src, 0).ravel()
            x = np.ascontiguousarray(p["x"][read].reshape(*src.shape, 3 * h).transpose(0, 2, 1))
            goes_on = (src != end).astype(np.float32)  # a text starts with an empty state
            own = state[:, live]
            before, a, zr, n, after = (np.empty((len(src), k * h, len(live)), x.dtype) for k in (1, 3, 2, 1, 1))
            for t in range(len(src)):
                np.multiply(own, goes_on[t], out=before[t])
                own = self.step(x[t], before[t], (a[t], zr[t], n[t], after[t]))
            state[:, live] = own
            grads = {k: np.zeros_like(v) for k, v in p.items() if k != "x"}
            columns = after.transpose(1, 0, 2).reshape(h, -1)
            want = tok.ravel()
            there = want >= 0
            if there.all():
                back = self.output(columns.T, want, grads)[1].T
            else:
                back = np.zeros_like(columns)
                back[:, there] = self.output(columns[:, there].T, want[there], grads)[1].T
            back = np.ascontiguousarray(back.reshape(h, len(src), -1).transpose(1, 0, 2))
            a, z, r = a[:, 2 * h :], zr[:, :h], zr[:, h:]
            # what a gradient by state is multiplied by for each gate's input, and for the state's part of that
            by_n, by_a = n * n, np.empty_like(x)
            np.subtract(1, by_n, out=by_n)
            rest = 1 - z
            by_n *= rest
            by_z, by_r, by_own = by_a[:, :h], by_a[:, h : 2 * h], by_a[:, 2 * h :]
            rest *= z
            np.subtract(before, n, out=by_z)
            by_z *= rest
            np.multiply(by_n, r, out=by_own)
            np.subtract(1, r, out=rest)
            rest *= a
            np.multiply(by_own, rest, out=by_r)
            z *= goes_on[:, None]
            carried = np.zeros_like(own)
            for t in reversed(range(len(src))):
                back[t] += carried
                gates = by_a[t].reshape(3, h, -1)
                gates *= back[t]
                carried = p["u"] @ by_a[t]
                carried *= goes_on[t]
                carried += back[t] * z[t]
            grads["u"] += np.matmul(before, by_a.transpose(0, 2, 1)).sum(axis=0)
            np.multiply(by_n, back, out=by_own)
            by = np.argsort(read.astype(np.int16), kind="stable")
            dx = by_a.transpose(0, 2, 1).reshape(-1, 3 * h)
            read, dx = read[by], dx[by]
            edge = np.flatnonzero(np.diff(read, prepend=-1))
            read, dx = read[edge], np.add.reduceat(dx, edge, axis=0)  # other rows have no gradient
            scale = np.float32(1 / max(1, there.sum()) ** 0.5)
            for k, g in grads.items():
                g *= scale
                squares[k] += g * g
                p[k] += np.float32(rate) * g / np.sqrt(squares[k])
            dx *= scale
            squares["x"][read] += dx * dx
            p["x"][read] += np.float32(rate) * dx / np.sqrt(squares["x"][read])
        return int(sum(sizes))

    def score(self, texts: list[np.ndarray], end: int, window: int = 32, lanes: int = SIDE) -> np.ndarray:
        """The natural log of the probability of each whole text, as tokens with the end; tail words but for their
        shares. Texts of about one length run side by side, a window of steps at a time, and leave as they end."""
        out = np.zeros(len(texts))
        every = np.argsort([-len(t) for t in texts], kind="stable")
        for order in (every[k : k + lanes] for k in range(0, len(every), lanes)):
            size = np.array([len(texts[i]) for i in order])
            flat = np.concatenate([texts[i] for i in order])
            first = np.cumsum(size) - size
            state, steps = np.zeros((self.hidden, len(order)), np.float32), int(size[0])
            a, zr, n = (np.empty((k * self.hidden, len(order)), self.p["x"].dtype) for k in (3, 2, 1))
            sums = np.zeros(len(order))
            for s in range(0, steps, window):
                spans = [int(np.searchsorted(-size, -t, "left")) for t in range(s, min(s + window, steps))]  # texts longer than t
                at = np.concatenate([first[:k] + t for t, k in enumerate(spans, s)])
                source = flat[at - 1]
                if not s:
                    source[: spans[0]] = end
                x, i = self.p["x"][source], 0
                states = np.empty((self.hidden, len(at)), x.dtype)
                for k in spans:
                    state = self.step(np.ascontiguousarray(x[i : i + k].T), state[:, :k], (a[:, :k], zr[:, :k], n[:, :k], states[:, i : i + k]))
                    i += k
                got, i = self.output(states.T, flat[at])[0], 0
                for k in spans:
                    sums[:k] += got[i : i + k]
                    i += k
            out[order] = sums
        return out

    def flat(self) -> np.ndarray:
        """Weights, and the squares that their steps are scaled by."""
        return np.concatenate([v.ravel() for own in (self.p, self.squares) for v in own.values()])

    def set(self, flat: np.ndarray) -> None:
        at = 0
        for own in (self.p, self.squares):
            for k, v in own.items():
                own[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
                at += v.size


def _docs(df: DataFrame, id_col: str, text_col: str, folds: int, held_out: int) -> DataFrame:
    """(id, key, held_out, text): key is 128 bits that name the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held_out, F.lit(False))
    return small_batches(df).select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("key"), held.alias("held_out"), text.alias("text"))


def token_counts(texts: DataFrame, most: int = 150_000) -> DataFrame:
    """(word, c) of all tokens of `texts` (text), ends included; summed in each partition first."""

    def run(batches):
        held: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
        for b in batches:
            for t in utf8(b.column(0)):
                held.update(words_of(t))
                held[END] += 1
                if len(held) > most:
                    yield flush()
                    held.clear()
        yield flush()

    return texts.select("text").mapInArrow(task(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, known: int = KNOWN, head: int = HEAD) -> Vocabulary:
    """From staged counts. The driver gets totals, a histogram of counts on a scale of logarithms, and `known` words at most."""
    n = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    bin_ = F.floor(F.log2("c") * 8)
    bins = sorted(((r.b, r.n) for r in counts.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, held = None, 0
    for b, k in bins:
        if held + k > known - 1:
            break
        least, held = b, held + k
    top = counts.where(((bin_ >= (least if least is not None else 10**6)) & (F.length("word") <= LONGEST)) | (F.col("word") == F.lit(END))).toArrow()
    words = list(zip(top.column("word").to_pylist(), top.column("c").to_pylist()))
    tail = F.crc32(F.substring("word", -3, 3)) % TAIL
    tokens, distinct = np.zeros(TAIL), np.zeros(TAIL)
    for r in counts.groupBy(tail.alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        tokens[r.k], distinct[r.k] = r.c, r.n
    first = Vocabulary(words, tokens, distinct, n[0] or 0, n[1], head)  # to know the head
    for w, i in first.number.items():
        if i < first.size and first.count[i]:
            tokens[tail_class(w)] -= first.count[i]
            distinct[tail_class(w)] -= 1
    return Vocabulary(words, tokens, distinct, n[0] or 0, n[1], head)


def _combined(parts: DataFrame, by: str, partitions: int) -> DataFrame:
    """Means of the values of (replica, block, tokens, values) over each partition, by tokens."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for replica, block, tokens, values in zip(*(c.to_pylist() for c in b.columns)):
                x = held.setdefault(block, [replica, 0, 0])
                x[1] += tokens
                x[2] = x[2] + np.frombuffer(values, np.float32) * np.float64(tokens)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in held.values()], pa.int32()), pa.array(list(held), pa.int32()), pa.array([v[1] for v in held.values()], pa.int64()), pa.array([(v[2] / v[1]).astype(np.float32).tobytes() for v in held.values()], pa.binary())], ["replica", "block", "tokens", "values"])

    return parts.repartition(partitions, by).sortWithinPartitions("block", "replica").mapInArrow(task(run), _PART)


_PART = "replica int, block int, tokens long, values binary"


_READ = "id {}, key binary, held_out boolean, deal long, n_tokens long, n_known long, base double, score double, n_rare long, tokens binary, words array<binary>, times array<int>"


def _read(docs: DataFrame, voc: Vocabulary) -> DataFrame:
    """_READ for every row: what the known words give, the rare words that are still to be looked up, and the text as tokens,
    numbers of type `voc.kind`. deal: how training texts are dealt, rows of one text by their ids."""
    kind = docs.schema["id"].dataType.simpleString()
    given = docs.sparkSession.sparkContext.broadcast(voc)
    names = [x.split()[0] for x in _READ.split(", ")]

    def run(batches):
        voc = given.value
        log_count = np.log10(voc.count + 1)
        for b in batches:
            sizes, base, score, known, rare, tokens = [], [], [], [], [], []
            for t in utf8(b.column(4)):
                words = words_of(t)
                words.append(END)
                number, token = voc.read(words)
                there = number[number >= 0]
                base.append(log_count[there].sum())
                score.append(voc.within[there].sum())
                known.append(int((voc.count[there] > 0).sum()))
                rare.append(Counter(words[i] for i in np.flatnonzero(number < 0).tolist()))
                sizes.append(len(token))
                tokens.append(token.astype(voc.kind).tobytes())
            ends = np.cumsum([0] + [len(c) for c in rare])
            columns = [*b.columns[:4], pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array([sum(c.values()) for c in rare], pa.int64()), pa.array(tokens, pa.binary())]
            columns += [list_array(pa.array([w for c in rare for w in c], pa.binary()), ends), list_array(pa.array([n for c in rare for n in c.values()], pa.int32()), ends)]
            yield pa.RecordBatch.from_arrays(columns, names)

    deal = F.xxhash64("text", F.col("id").cast("string"), F.lit("replica"))
    return docs.select("id", "key", "held_out", deal.alias("deal"), "text").mapInArrow(task(run), _READ.format(kind))


def fitted(docs: DataFrame, voc: Vocabulary) -> Gru:
    """The model after one pass over all training texts: replicas learn from their own rows side by side, a part of them in each of
    ROUNDS rounds, and after each their weights' steps are averaged by tokens, lengthened by BEYOND, and all go on from there. One replica alone needs one round.
    docs: rows of `_read`, or of `_docs`, which are then read in each round."""
    model = Gru(voc.classes, (voc.head_mass, voc.tail_mass))
    if not voc.tokens:
        return model
    spark = docs.sparkSession
    replicas = max(1, round(voc.tokens / REPLICA))
    rounds = ROUNDS if replicas > 1 else 1
    given = spark.sparkContext.broadcast(voc)
    read = docs if "tokens" in docs.columns else _read(docs, voc)
    texts = read.where(~F.col("held_out")).select("tokens", "deal")
    texts = texts.select("tokens", "deal", F.pmod(F.xxhash64("deal"), F.lit(replicas)).cast("int").alias("replica"), F.pmod("deal", F.lit(rounds)).alias("round"))
    for n in range(rounds):
        start = spark.sparkContext.broadcast(model.flat())

        def run(batches, start=start):
            voc, own, tokens, replica, held, waiting = given.value, None, 0, -1, [], 0

            def ended():
                nonlocal own, tokens, held, waiting
                if held:
                    tokens += own.learn(held, voc.end)
                if own is not None:
                    flat = own.flat().astype(np.float32)
                    blocks = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
                    yield pa.RecordBatch.from_arrays([pa.array([replica] * len(blocks), pa.int32()), pa.array(range(len(blocks)), pa.int32()), pa.array([tokens] * len(blocks), pa.int64()), pa.array(blocks, pa.binary())], ["replica", "block", "tokens", "values"])
                own, tokens, held, waiting = None, 0, [], 0

            for b in batches:
                for t, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if r != replica:
                        yield from ended()
                        own, replica = Gru(voc.classes, (voc.head_mass, voc.tail_mass)), r
                        own.set(start.value)
                    held.append(np.frombuffer(t, voc.kind))
                    waiting += len(held[-1])
                    if waiting >= DEALT:
                        tokens += own.learn(held, voc.end)
                        held, waiting = [], 0
            yield from ended()

        part = texts.where(F.col("round") == n).repartitionById(replicas, F.col("replica")).sortWithinPartitions("replica", "deal")
        parts = part.select("tokens", "replica").mapInArrow(task(run), _PART)
        sums = _combined(_combined(parts, "replica", math.ceil(math.sqrt(replicas))), "block", 8).collect()
        if sums:
            mean = np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(sums, key=lambda r: r.block)])
            if replicas > 1:
                weights, old = slice(0, sum(v.size for v in model.p.values())), model.flat()
                mean[weights] = old[weights] + np.float32(BEYOND) * (mean[weights] - old[weights])
            model.set(mean)
        start.unpersist()
    return model


_SCORED = ("id", "key", "held_out", "n_tokens", "n_known", "base", "score", "n_rare")


def _scored(read: DataFrame, voc: Vocabulary, model: Gru) -> DataFrame:
    """_SCORED for every row of `_read`: score has what the network gives, too."""
    given = read.sparkSession.sparkContext.broadcast((model, voc.end, voc.kind))

    def run(batches):
        model, end, kind = given.value
        held, texts, waiting = [], [], 0

        def ended():
            got, i = model.score(texts, end) / math.log(10), 0
            at = _SCORED.index("score")
            for columns in held:
                n = len(columns[at])
                columns[at] = pa.array(columns[at].to_numpy() + got[i : i + n])
                i += n
                yield pa.RecordBatch.from_arrays(columns, list(_SCORED))
            held.clear()
            texts.clear()

        for b in batches:
            held.append([c.take(pa.array(range(len(c)))) for c in b.columns[:-1]])  # without the batch that holds them
            texts.extend(np.frombuffer(t, kind) for t in b.column(len(_SCORED)).to_pylist())
            waiting += b.column(len(_SCORED)).nbytes
            if waiting >= TOGETHER:
                yield from ended()
                waiting = 0
        yield from ended()

    kinds = {f.name: f.dataType.simpleString() for f in read.schema}
    return read.select(*_SCORED, "tokens").mapInArrow(task(run), ", ".join(f"{c} {kinds[c]}" for c in _SCORED))


def language_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2, known: int = KNOWN, head: int = HEAD) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of `df`.

    Tokens are the words of the whole text, A-Z lower-cased, and one end; a null text counts as empty. Counts are over the
    tokens of all rows whose id's crc32, as text, modulo `folds` is not `held_out`; a null id is never held out, and rows that repeat an
    id or a text count each time. base_score is the log10 probability by counts with one added; score is the
    network's: the class of each token by a softmax over what the state holds, a head word in its class by another, any other
    word in its tail class by its share of the corpus there, one unseen word added. The state goes through the whole
    text. Without training rows both scores are defined by counts of nothing. An empty table gives an empty result; other columns are not read.

    The network's weights learn from all training texts, and counts cover all. The `known` most frequent words go to every worker; counts of the rest stay in a table and are joined."""
    docs = _docs(df, id_col, text_col, folds, held_out)
    counts = staged(token_counts(docs.where(~F.col("held_out"))), "counts")
    voc = vocabulary(counts, known, head)
    read = staged(_read(docs, voc), "read")
    rows = staged(_scored(read, voc, fitted(read, voc)), "scored")
    rare = read.where("n_rare > 0").select("key", F.explode(F.arrays_zip("words", "times")).alias("x")).select("key", F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    rare = rare.join(counts, "word", "left")
    logs = F.array(*(F.lit(float(x)) for x in voc.tail_log))
    share_log = F.log10(F.coalesce("c", F.lit(0)) + 1)
    tail = F.element_at(logs, (F.crc32(F.substring("word", -3, 3)) % TAIL).cast("int") + 1)
    sums = rare.groupBy("key").agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("seen"), F.sum(F.col("n") * share_log).alias("more"), F.sum(F.col("n") * (share_log - tail)).alias("more_score")
    )
    # texts that rows repeat are in the sums as often
    own = F.coalesce(F.col("n_rare") / F.col("all"), F.lit(0.0))
    both = rows.join(sums, "key", "left")
    return both.select(
        "id", "held_out", "n_tokens",
        (F.col("n_known") + F.round(F.coalesce(F.col("seen") * own, F.lit(0.0))).cast("long")).alias("n_known"),
        F.lit(int(voc.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("more") * own, F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(voc.tokens + voc.distinct + 1))).alias("base_score"),
        (F.col("score") + F.coalesce(F.col("more_score") * own, F.lit(0.0))).alias("score"),
    )
