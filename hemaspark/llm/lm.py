"""Language-model scoring: unigram statistics of the whole corpus, and a gated recurrent model with class-factored output in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_arrow, written

FOLDS, HELD_OUT = 5, 1
#: Words whose counts are sent to every task (the most frequent ones); the others' counts are joined.
DICTIONARY = 1 << 17
#: Words that the recurrent model knows; all others are one class, within which they share its chance by their counts.
CLASSES, CLASS_SIZE, HIDDEN = 32, 32, 32
#: Where the weights start from: EPOCHS passes by one task over a share of the training documents of some START_WORDS words (and START_DOCS
#: documents). From there all training documents are learnt from: one pass in ROUNDS shares, dealt by a hash of the document to
#: shards of some SHARD_WORDS words, whose weights are averaged.
START_WORDS, START_DOCS, EPOCHS, START_LANES = 400_000, 64, 3, 16
ROUNDS, SHARD_WORDS = (0.25, 0.75), 1 << 19
LANES, STEPS, WIDTH, RATE, SEED = 512, 24, 256, 0.1, 9
#: Words whose classes are computed together, and how often a word is in a window at most to be summed along with others: of what caches hold, no matter for results.
BLOCK, OFTEN = 2048, 48
#: Weights of so many tasks are averaged by one.
FAN_IN = 8
END = b""  # no word is empty

LOG10 = np.log(10.0)


def held_out(id_col: str | Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Whether a document is kept from learning; null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def tokens(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased, then one end."""
    return [*(text or b"").lower().split(), END]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words of all texts, as tokens makes them, without ends; how many words each text has)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, owner = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full).cast(pa.binary()), np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(lists)).astype(np.int64)


#: Words that are counted together by a task, and words that are scored together.
COUNTED, SCORED = 2_000_000, 4_000_000


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all tokens of docs: counted by task, summed by word. The end is the empty word."""
    bound_arrow(docs.sparkSession)
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("c", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def counted() -> pa.RecordBatch:
            found = pc.value_counts(pa.chunked_array([*held, pa.array([END] * (ends > 0), pa.binary())]))
            word, c = found.field(0), found.field(1).to_numpy().copy()
            if ends:
                c[pc.index(word, pa.scalar(END, pa.binary())).as_py()] = ends
            return pa.RecordBatch.from_arrays([word, pa.array(c, pa.int64())], names=schema.names)

        for batch in batches:
            words, lengths = split(batch.column(0))
            held.append(words)
            size, ends = size + len(words), ends + len(lengths)
            if size >= COUNTED:
                yield counted()
                held, size, ends = [], 0, 0
        if ends:
            yield counted()

    return docs.select(text_col).mapInArrow(run, schema).groupBy("word").agg(F.sum("c").alias("c"))


class GatedModel:
    """A gated recurrent unit; P(word) = P(class | state) * P(word | class, state). Ids from `known` on are the rare class."""

    def __init__(self, known: int, end: int, hidden: int = HIDDEN, size: int = CLASS_SIZE, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.known, self.end, self.hidden, self.size = known, end, hidden, size
        self.classes = -(-known // size)
        f = lambda *shape: (rng.normal(size=shape) * 0.1).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, np.float32)
        self.p = {"gates": f(known + 1, 3 * hidden), "u": f(hidden, 3 * hidden), "w1": f(hidden, self.classes + 1), "b1": zero(self.classes + 1), "w2": f(self.classes, hidden, size), "b2": zero(self.classes, size)}
        if known % size:  # places of the last class that no word has
            self.p["b2"][-1, known % size :] = -1e9
        #: Sums of squared gradients, by which the rate of each weight falls.
        self.seen = {k: np.full_like(v, 1e-8) for k, v in self.p.items()}

    def weights(self) -> np.ndarray:
        """All weights and sums of squares as one vector."""
        return np.concatenate([x.ravel() for d in (self.p, self.seen) for x in d.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for d in (self.p, self.seen):
            for k, x in d.items():
                d[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a window is read with: inputs of the three gates by word, one gate behind another, and their recurrent weights, so that each
        gate's values lie together; both negated, and those of the new state doubled, as sigmoids and tanh take them; and the weights
        as they are for the way back."""
        k = self.hidden
        cut = lambda w: np.stack([w[:, :k], w[:, k : 2 * k], w[:, 2 * k :]])
        u = cut(self.p["u"])
        signs = np.array([-1, -1, -2], u.dtype)[:, None, None]
        return (cut(self.p["gates"]) * signs).reshape(-1, k), u * signs, np.ascontiguousarray(u.transpose(0, 2, 1))

    def forward(self, h: np.ndarray, ids: np.ndarray, tables: tuple | None = None, keep: bool = True, room: dict | None = None) -> tuple[np.ndarray, tuple, np.ndarray]:
        """(states before each word, what the way back needs if it is kept, the last state) for ids by step and lane; below 0 there
        is no word. The state after an end is zero. With a room, the next window of this shape is written over this one."""
        (steps, lanes), k = ids.shape, self.hidden
        gates, u, _ = tables = tables or self.tables()
        at = np.maximum(ids, 0)[:, None] + (np.arange(3) * (self.known + 1))[:, None]
        ends = ids == self.end
        room = {} if room is None else room
        if (steps, lanes) not in room:
            room.clear()
            room[steps, lanes] = [np.empty(shape, u.dtype) for shape in ((steps + 1, lanes, k), (steps if keep else 1, 4, lanes, k), (3, lanes, k))]
        # held: the gates z and r, the new state's input from the state (times -2), and what the new state is mixed from.
        states, held, x = room[steps, lanes]
        states[0] = h
        with np.errstate(over="ignore"):  # 1 / (1 + infinity) is 0
            for t in range(steps):
                s, h, new = held[t if keep else 0], states[t], states[t + 1]
                np.take(gates, at[t], axis=0, out=x, mode="clip")
                np.matmul(h, u, out=s[:3])
                zr, a, n = s[:2], s[2], s[3]
                zr += x[:2]
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                np.multiply(zr[1], a, out=n)
                n += x[2]
                np.exp(n, out=n)  # tanh(x) = 2 sigmoid(2x) - 1, which takes numpy half the time
                n += 1
                np.reciprocal(n, out=n)
                n *= 2
                n -= 1
                np.subtract(h, n, out=new)
                new *= zr[0]
                new += n
                new[ends[t]] = 0
        return states[:-1], (states, held, ends, tables), states[-1]

    def log_probs(self, h: np.ndarray, ids: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of ids (a rare id: of its class; below 0: 0), and the gradient of their negative sum by state."""
        if len(ids) and ids.min() < 0:  # places that hold no word
            there = np.flatnonzero(ids >= 0)
            every, dh = np.zeros(len(ids)), None if grads is None else np.zeros_like(h)
            every[there], some = self.log_probs(h[there], ids[there], grads)
            if grads is not None:
                dh[there] = some
            return every, dh
        out = np.empty(len(ids))
        dh = None if grads is None else np.empty_like(h)

        def softmax(w: np.ndarray, b: np.ndarray, x: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Log-probabilities of the members for states x, and all probabilities less one at the member, the gradient, a row for each member."""
            d = w.T @ x.T
            d += b[:, None]
            np.minimum(d, 60, out=d)  # states are within 1, so larger logits don't come from a model that learns anything
            places = member * len(x) + np.arange(len(x))
            own = d.ravel().take(places).astype(float)
            np.exp(d, out=d)
            total = np.ones(len(d), d.dtype) @ d
            if grads is not None:
                d /= total
                d.ravel()[places] -= 1
            return own - np.log(total), d

        own = np.where(ids >= self.known, self.classes, ids // self.size).astype(np.int16)
        for a in range(0, len(ids), BLOCK):
            x = h[a : a + BLOCK]
            out[a : a + BLOCK], d = softmax(self.p["w1"], self.p["b1"], x, own[a : a + BLOCK].astype(np.int64))
            if grads is not None:
                grads["w1"] += (d @ x).T
                grads["b1"] += d.sum(axis=1)
                np.matmul(d.T, self.p["w1"].T, out=dh[a : a + BLOCK])
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(self.classes + 1))
        order = order[: cuts[-1]]  # the rare class has no words of its own
        sub, at, inner = h[order], ids[order], np.empty(len(order))
        dsub = None if grads is None else np.empty_like(sub)
        for c in range(self.classes):
            a, b = cuts[c], cuts[c + 1]
            if a == b:
                continue
            x = sub[a:b]
            inner[a:b], d = softmax(self.p["w2"][c], self.p["b2"][c], x, at[a:b] - c * self.size)
            if grads is not None:
                grads["w2"][c] += (d @ x).T
                grads["b2"][c] += d.sum(axis=1)
                np.matmul(d.T, self.p["w2"][c].T, out=dsub[a:b])
        out[order] += inner
        if grads is not None:
            dh[order] += dsub
        return out, dh

    def backward(self, saved: tuple, ids: np.ndarray, dh: np.ndarray, g: dict) -> tuple[np.ndarray, np.ndarray]:
        """Adds the gradients of a window to g, given those by state; for the gate inputs returns (rows, their gradients). What was
        saved is written over."""
        (steps, lanes), k = ids.shape, self.hidden
        states, held, ends, (_, _, ut) = saved
        back, x, y, by_state = np.zeros_like(dh[0]), np.empty_like(dh[0]), np.empty_like(dh[0]), np.empty((3, lanes, k), dh.dtype)
        du, unknown, rare = np.zeros((3, k, k), dh.dtype), (ids == self.known).astype(dh.dtype), np.zeros((4, k), dh.dtype)
        for t in range(steps - 1, -1, -1):
            # Gradients take the places of z and r (of their inputs), a (of the new state's input from the state) and n (of that from the word).
            h, (z, r, a, n) = states[t], held[t]
            back[ends[t]] = 0
            np.subtract(1, z, out=x)
            x *= back
            back *= z
            np.subtract(h, n, out=y)
            y *= z
            np.multiply(x, y, out=z)
            n *= n
            np.subtract(1, n, out=n)
            n *= x
            np.subtract(r, 1, out=x)
            x *= 0.5  # a was taken -2 times
            x *= a
            np.multiply(n, r, out=a)
            np.multiply(x, a, out=r)
            du += np.matmul(h.T, held[t, :3])
            np.matmul(held[t, :3], ut, out=by_state)
            back += by_state[0]
            back += by_state[1]
            back += by_state[2]
            back += dh[t]
            rare += unknown[t] @ held[t]
        g["u"] += np.concatenate(du, axis=1)
        flat = np.maximum(ids, 0).ravel()
        order = np.argsort(flat.astype(np.int16), kind="stable")
        order = order[: np.searchsorted(flat[order], self.known)]  # the rare class is often half of all words
        rows, sums = self._summed(flat[order], order // lanes * (4 * lanes) + order % lanes + (np.array([0, 1, 3]) * lanes)[:, None], held.reshape(-1, k))
        return np.append(rows, self.known), np.concatenate([np.concatenate(sums, axis=1), rare[[0, 1, 3]].reshape(1, -1)])

    @staticmethod
    def _summed(ids: np.ndarray, at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids there are, by how often each is there, gate by gate the sums of its rows of d): at has a row number for each gate and place of the
        ascending ids. Frequent ids are summed one by one, of the others all first rows, all second ones and so on."""
        starts = np.flatnonzero(np.diff(ids, prepend=-1))
        counts = np.diff(starts, append=len(ids))
        most = np.argsort(-counts, kind="stable")
        starts, counts = starts[most], counts[most]
        sums = np.zeros((len(at), len(starts), d.shape[1]), d.dtype)
        many = int(np.searchsorted(-counts, -OFTEN))  # those that are there more often
        for i in range(many):
            rows = d.take(at[:, starts[i] : starts[i] + counts[i]], axis=0)
            np.matmul(np.ones((1, counts[i]), d.dtype), rows, out=sums[:, i : i + 1])
        for j in range(int(counts[many]) if many < len(counts) else 0):
            n = int(np.searchsorted(-counts, -j))
            sums[:, many:n] += d.take(at[:, starts[many:n] + j], axis=0)
        return ids[starts], sums

    def learn(self, grid: np.ndarray, steps: int, rate: float) -> tuple[float, int]:
        """Truncated backpropagation through windows of `steps` words of a grid (lanes by words; below 0: none), states carried
        from window to window; returns (negative log-likelihood, words)."""
        h, loss, n, room = np.zeros((len(grid), self.hidden), np.float32), 0.0, 0, {}
        for a in range(0, grid.shape[1], steps):
            ids = np.ascontiguousarray(grid[:, a : a + steps].T)
            g = {k: np.zeros_like(x) for k, x in self.p.items() if k != "gates"}
            states, saved, h = self.forward(h, ids, room=room)
            logp, dh = self.log_probs(states.reshape(-1, self.hidden), ids.ravel(), g)
            count = int((ids >= 0).sum())
            rows, gates = self.backward(saved, ids, dh.reshape(states.shape), g)
            loss, n, scale = loss - float(logp.sum()), n + count, np.float32(1.0 / max(1, count))
            for k, grad in g.items():
                grad *= scale
                self.seen[k] += grad * grad
                self.p[k] -= np.float32(rate) * grad / np.sqrt(self.seen[k])
            gates *= scale
            seen = self.seen["gates"][rows] + gates * gates
            self.seen["gates"][rows] = seen
            self.p["gates"][rows] -= np.float32(rate) * gates / np.sqrt(seen)
        return loss, n

    def fit(self, documents: Iterable[np.ndarray], lanes: int = LANES, steps: int = STEPS, width: int = WIDTH, rate: float = RATE) -> tuple[float, int]:
        """Learns from a stream of documents of any length, each word once; returns (negative log-likelihood, words).

        The stream runs on from document to document and is cut into lanes of `width` words, so memory holds a grid, not the
        stream. What is left at its end is a smaller grid: no word is dropped.
        """
        held, size, loss, n = [], 0, 0.0, 0
        for d in documents:
            held.append(d)
            size += len(d)
            while size >= lanes * width:
                stream = np.concatenate(held)
                one, k = self.learn(stream[: lanes * width].reshape(lanes, width), steps, rate)
                loss, n, held, size = loss + one, n + k, [stream[lanes * width :]], size - lanes * width
        if size:
            stream = np.concatenate(held)
            rows = int(min(lanes, max(1, size // (4 * steps))))
            grid = np.full((rows, -(-size // rows)), -1, np.int32)
            grid.ravel()[:size] = stream
            one, k = self.learn(grid, steps, rate)
            loss, n = loss + one, n + k
        return loss, n

    def score(self, documents: list[np.ndarray], lanes: int = LANES, steps: int = 2 * STEPS) -> np.ndarray:
        """Log10-probability of each whole document (a rare id: of its class).

        Documents run one behind the other in lanes of about equal length, no more lanes than the longest document leaves work for;
        the state is carried across windows and is zero after an end, so neither a document's length nor its neighbours matter.
        """
        lengths = np.array([len(d) for d in documents], np.int64)
        lanes = int(max(1, min(lanes, len(documents), -(-2 * lengths.sum() // max(1, lengths.max(initial=1))))))
        load, queue = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
        for i in np.argsort(-lengths, kind="stable").tolist():
            k = int(np.argmin(load))
            queue[k].append(i)
            load[k] += lengths[i]
        order = np.argsort(-load, kind="stable")
        ids = np.full((int(load.max()), lanes), -1, np.int32)
        owner = np.zeros(ids.shape, np.int32)
        for row, k in enumerate(order.tolist()):
            if queue[k]:
                ids[: load[k], row] = np.concatenate([documents[i] for i in queue[k]])
                owner[: load[k], row] = np.repeat(queue[k], lengths[queue[k]])
        active = load[order]
        total, h, tables, room = np.zeros(len(documents)), np.zeros((lanes, self.hidden), np.float32), self.tables(), {}
        for a in range(0, len(ids), steps):
            n = int(np.searchsorted(-active, -a))  # lanes that are longer than what is read
            window = np.ascontiguousarray(ids[a : a + steps, :n])
            states, _, h = self.forward(h[:n], window, tables, keep=False, room=room)
            logp, _ = self.log_probs(states.reshape(-1, self.hidden), window.ravel())
            total += np.bincount(owner[a : a + steps, :n].ravel(), logp, len(documents))
        return total / LOG10


def _averaged(rows: DataFrame, tasks: int) -> np.ndarray | None:
    """The mean of models' weights by the words that each has read, from rows (task, n, weights): by tasks that take FAN_IN models
    each, again and again, so one vector reaches the driver."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, task = None, 0, 0
        for batch in batches:
            for task_, m, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                w = np.frombuffer(raw.as_buffer(), np.float32).astype(np.float64) * m
                total, n, task = w if total is None else total + w, n + m, task_
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=MODELS.names)

    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        rows = written(rows.repartition(tasks, F.pmod(F.xxhash64("task"), F.lit(tasks))).sortWithinPartitions("task").mapInArrow(mean, MODELS), "weights")
    found = rows.coalesce(1).sortWithinPartitions("task").mapInArrow(mean, MODELS).select("weights").collect()
    return np.frombuffer(found[0][0], np.float32) if found else None


MODELS = T.StructType([T.StructField("task", T.LongType()), T.StructField("n", T.LongType()), T.StructField("weights", T.BinaryType())])


def trained(encoded: DataFrame, model: GatedModel, n_words: int, n_docs: int, rounds: tuple[float, ...] = ROUNDS, start_words: int = START_WORDS, shard_words: int = SHARD_WORDS) -> GatedModel:
    """The model after learning from all rows of encoded (key: a hash of the document, ids: its words); n_words and n_docs: how many there are.

    First one task reads a share by hash that holds some start_words words, EPOCHS times: what all others start from. The
    share is cut from the table by all tasks and is small. Then each round is a share of the documents by hash, and all
    rounds together are all documents, dealt to shards by hash: each is gone through once, whole, from the weights of the round before, and
    the shards' weights are averaged by words. So what is learnt from grows with the input, what a shard learns doesn't depend on
    how the input is laid out in files, a task holds a shard's words, and a lost executor repeats its shards.
    """
    spark = encoded.sparkSession
    encoded = encoded.withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "key"), 11) / F.lit(float(1 << 53)))

    def learnt(part: DataFrame, shards: int, lanes: int, width: int, epochs: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(model)  # of fixed size

        def run(key: tuple, docs: pa.Table) -> pa.Table:
            import copy

            own = copy.deepcopy(shared.value)
            order = np.argsort(docs["key"].to_numpy(), kind="stable")
            texts = docs["ids"].combine_chunks()
            documents = [np.frombuffer(texts[i].as_buffer(), np.int16).astype(np.int32) for i in order.tolist()]
            _, n = own.fit(documents * epochs, lanes=lanes, width=width, rate=RATE)
            return pa.table({"task": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "weights": pa.array([own.weights().astype(np.float32).tobytes()], pa.binary())})

        return part.select(F.pmod(F.xxhash64(F.lit(SEED + 1), "key"), F.lit(shards)).alias("shard"), "key", "ids").groupBy("shard").applyInArrow(run, MODELS)

    share = min(1.0, max(start_words / max(1, n_words), START_DOCS / max(1, n_docs)))
    before = 0.0
    for k, size in enumerate((share, *rounds)):
        part = encoded.where(F.col("draw") < size) if not k else encoded.where((F.col("draw") >= before) & (F.col("draw") < before + size))
        before = 0.0 if not k else before + size
        if k == len(rounds):
            part = encoded.where(F.col("draw") >= 1.0 - size)
        shards = -(-int(n_words * size) // shard_words) if k else 1
        rows = written(learnt(part, max(1, shards), LANES if k else START_LANES, WIDTH if k else 4 * WIDTH, 1 if k else EPOCHS), "weights")
        flat = _averaged(rows, rows.count())
        if flat is not None:
            model.load(flat)
    return model


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary: int = DICTIONARY, classes: int = CLASSES, rounds: tuple[float, ...] = ROUNDS) -> DataFrame:
    """One row for each document: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the unigram model's log10-probability with half a count added, from all training tokens; score is the
    recurrent model's. Its chance of a word that it doesn't know is that of the rare class times the word's share of
    the class by counts with half a count added, so it is a distribution over words as the base is. It learns from all training
    documents, whole (see trained). Texts are split for the counts and once more to be written as ids, which training and
    scoring read. Counts of the `dictionary` most frequent words go to every task; those of other words, if there are any, are joined by word, from
    documents' words counted first. Null and empty texts are one end; null ids are training documents; repeated
    rows are scored each; an empty table gives an empty result; other columns are ignored. Texts are whole.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), held_out(id_col).alias("held_out"))
    counts = written(word_counts(base.where("not held_out"), "_text"), "counts")
    n_all, v_all = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The least count of which there are at most `dictionary` words or so, from a histogram (counts up to 4096, then by
    # powers of two), so that tasks send those words only.
    level = F.when(F.col("c") <= 4096, F.col("c")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("c"))).cast("long"))
    least, room = 1 << 62, dictionary
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if r["n"] > room:
            break
        least, room = r["level"], room - r["n"]
    top = sorted(counts.where((F.col("c") >= least) | (F.col("word") == F.lit(END))).collect(), key=lambda r: (bytes(r[0]) != END, -r[1], bytes(r[0])))
    rank = {bytes(r[0]): i for i, r in enumerate(top)}
    c = np.array([r[1] for r in top], float)
    # The model's vocabulary: the end, however rare (long texts), and the most frequent words.
    known = min(classes * CLASS_SIZE, len(top))
    unit = n_all + 0.5 * (v_all + 1)
    rare = n_all - c[:known].sum() + 0.5 * (v_all - known + 1)
    log_base = np.log10((c + 0.5) / unit)
    log_rare = np.where(np.arange(len(c)) < known, 0.0, np.log10((c + 0.5) / rare)) if len(c) else log_base
    complete, unseen_base, unseen_rare = v_all == len(top), float(np.log10(0.5 / unit)), float(np.log10(0.5 / rare))
    model = GatedModel(known, rank.get(END, 0))
    n_docs = int(c[rank[END]]) if END in rank else 0
    shared = spark.sparkContext.broadcast(([bytes(r[0]) for r in top], log_base, log_rare, rank.get(END, 0)))  # at most `dictionary` words
    rest_type = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())]))
    facts = [T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("more", T.DoubleType()), T.StructField("rest", rest_type)]
    head = [T.StructField("_row", T.LongType()), T.StructField("_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType())]
    schema = T.StructType([*head, T.StructField("key", T.LongType()), T.StructField("n_tokens", T.LongType()), *facts, T.StructField("ids", T.BinaryType())])
    arrow_rest = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary, log_base, log_rare, end = shared.value
        known_words = pa.array(vocabulary, pa.binary())
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            words, lengths = split(batch.column(3))
            if not len(lengths):
                continue
            # Places of the words and, behind each text's, its end.
            last = np.cumsum(lengths + 1) - 1
            at = np.full(len(words) + len(lengths), end, np.int64)
            inner = np.ones(len(at), bool)
            inner[last] = False
            at[inner] = pc.fill_null(pc.index_in(words, value_set=known_words), -1).to_numpy(zero_copy_only=False)
            new = at < 0
            first = last - lengths
            total = lambda x: np.add.reduceat(x, first)  # noqa: B023, E731
            base, more = total(np.where(new, unseen_base if complete else 0.0, log_base[at])), total(np.where(new, unseen_rare if complete else 0.0, log_rare[at]))
            rest = pa.array([[]] * len(lengths), arrow_rest)
            if not complete and new.any():
                coded = words.filter(pa.array(new[inner])).dictionary_encode()
                owner = np.repeat(np.arange(len(lengths)), lengths + 1)[new]
                pairs, n = np.unique(owner * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
                owner, code = np.divmod(pairs, len(coded.dictionary))
                entries = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(code)), pa.array(n, pa.int64())], fields=list(arrow_rest.value_type))
                rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(lengths) + 1)), pa.int32()), entries, type=arrow_rest)
            ids = np.where(new | (at >= known), known, at).astype(np.int16)
            row = np.arange(number, number + len(lengths))
            number += len(lengths)
            columns = [pa.array(lengths + 1), pa.array(total((~new).astype(np.int64))), pa.array(base), pa.array(more), rest]
            packed = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], 2 * (last + 1)]).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(row), batch.column(0), batch.column(1), batch.column(2), *columns, packed], names=schema.names)

    encoded = written(base.select("_id", "held_out", F.xxhash64(F.col("_id").cast("string"), "_text").alias("key"), "_text").mapInArrow(encode, schema), "encoded")
    model = GatedModel(known, rank.get(END, 0))
    if known:
        model = trained(encoded.where("not held_out").select("key", "ids"), model, n_all, n_docs, rounds)
    sent = spark.sparkContext.broadcast(model)
    result = T.StructType([*head, T.StructField("n_tokens", T.LongType()), *facts[:2], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, size = sent.value, [], 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            score = model.score([np.frombuffer(x.as_buffer(), np.int16).astype(np.int32) for x in t["ids"]]) + t["more"].to_numpy()
            return pa.RecordBatch.from_arrays([*[t[n].combine_chunks() for n in ("_row", "_id", "held_out", "n_tokens", "n_known", "base")], pa.array(score)], names=result.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += sum(batch.column(batch.schema.get_field_index("n_tokens")).to_pylist())
            if size >= SCORED:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    rows = encoded.drop("key", "rest").mapInArrow(run, result)
    if not complete:
        rows = written(rows, "scores")
        # Words that the dictionary lacks: by document and word already, so a word meets each document once.
        asked = encoded.select("_row", F.explode("rest").alias("r")).select("_row", "r.word", "r.n")
        seen = asked.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        sums = seen.groupBy("_row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / unit)).alias("b"), F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / rare)).alias("s"))
        rows = rows.join(sums, "_row", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("k", F.lit(0)), "base": F.col("base") + F.coalesce("b", F.lit(0.0)), "score": F.col("score") + F.coalesce("s", F.lit(0.0))})
    return rows.select(F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents, production parameters."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
