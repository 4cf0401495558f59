"""A gated recurrent language model with class-factored output, over whole documents."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import small_batches
from .hashing import LOWER, SPACED, word_hashes

#: Words with their own output, in CLASSES groups of SLOTS; all others share one class.
CLASSES, SLOTS = 48, 64
HIDDEN = 16
#: Words whose counts are sent to every task: a fixed bound of 8 MiB.
SENT = 1 << 19
#: Leading bits of a hash by which its place among the sent words is found.
LEADING = 20
#: Documents walked side by side, and states that are kept until their words are scored together.
SIDE_BY_SIDE, KEPT = 4096, 1 << 15
#: Every teaching row is learned once, in one of ROUNDS; weights of all tasks are averaged after each.
ROUNDS, RATE = 3, 0.01
#: Tokens of a stream that one update looks back over, the most streams, and updates a batch should make at least.
WINDOW, STREAMS, UPDATES = 16, 512, 128
#: Weights that travel together, and tasks that learn side by side at most.
PIECE, LEARNERS = 2048, 2048
#: Hash that stands for the end of a document; hash of no word for practical purposes.
END = np.uint64(0x9E3779B97F4A7C15)
_LN10 = float(np.log(10.0))


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): word hashes of each text and an end; A-Z are lower-cased."""
    h, n = word_hashes([(t or "").encode().translate(LOWER) for t in texts], SPACED)
    ends = np.cumsum(n)
    return np.insert(h, ends, END), n + 1


class Vocabulary:
    """Sorted hashes with corpus counts, and the output place of the most frequent ones.

    Words by falling count fill the classes one after another, so a class holds words of
    like frequency. A place is class * SLOTS + slot; all other words have place OTHER.
    """

    OTHER = CLASSES * SLOTS

    def __init__(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        top = np.lexsort((self.hashes, -self.counts))[: self.OTHER]
        self.places = np.full(len(hashes), self.OTHER, np.int32)
        self.places[top] = np.arange(len(top))
        self.n_top = int(self.counts[top].sum())
        self.v_top = len(top)
        self.firsts = np.searchsorted(self.hashes, np.arange(1 << LEADING, dtype=np.uint64) << np.uint64(64 - LEADING)).astype(np.int32)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, count) per hash; a hash that is not sent has place OTHER and count -1."""
        if not len(self.hashes):
            return np.full(len(h), self.OTHER, np.int32), np.full(len(h), -1, np.int64)
        at = self.firsts[(h >> np.uint64(64 - LEADING)).astype(np.int64)]
        # Few words share their leading bits, so a few steps lead to the first that is not less.
        behind = np.arange(len(h))
        while len(behind):
            here = at[behind]
            behind = behind[(here < len(self.hashes)) & (self.hashes[np.minimum(here, len(self.hashes) - 1)] < h[behind])]
            at[behind] += 1
        at = np.minimum(at, len(self.hashes) - 1)
        held = self.hashes[at] == h
        return np.where(held, self.places[at], self.OTHER).astype(np.int32), np.where(held, self.counts[at], -1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.negative(x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def _exps(logits: np.ndarray, small: bool = False) -> tuple[np.ndarray, np.ndarray | float]:
    """(exponentials in the place of logits, what was taken off each row first): nothing as long as they cannot overflow."""
    off: np.ndarray | float = 0.0
    if not small and logits.size and (logits.max() > 60 or logits.min() < -60):
        off = logits.max(axis=1, keepdims=True)
        logits -= off
    return np.exp(logits, out=logits), off


def _small(states: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no logit of these states can be beyond 60, which spares a look at each."""
    most = float(np.abs(states).max()) if states.size else 0.0
    return bool((most * np.abs(weights).sum(axis=-2) + np.abs(bias)).max() <= 60)


def _rows(x: np.ndarray) -> np.ndarray:
    """Sum of every row, as a product with ones, which is several times faster for narrow rows."""
    return x @ np.ones(x.shape[1], x.dtype)


def _columns(x: np.ndarray) -> np.ndarray:
    return np.ones(len(x), x.dtype) @ x


class Gru:
    """GRU over places with a softmax over classes and one over the slots of a class.

    The last class stands for all words without a place; what they are within it is left to
    corpus counts.
    """

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        scale = 0.1
        self.p = {
            "embed": rng.normal(0, scale, (Vocabulary.OTHER + 1, 3 * HIDDEN)), "hidden": rng.normal(0, scale, (HIDDEN, 3 * HIDDEN)),
            "bias": np.zeros(3 * HIDDEN), "class_w": rng.normal(0, scale, (HIDDEN, CLASSES + 1)), "class_b": np.zeros(CLASSES + 1),
            "slot_w": rng.normal(0, scale, (CLASSES, HIDDEN, SLOTS)), "slot_b": np.zeros((CLASSES, SLOTS)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @classmethod
    def start(cls, vocabulary: Vocabulary, total: int) -> Gru:
        """A network that says at first what the counts of the whole corpus say; slots without a word get next to nothing."""
        model = cls()
        counts = np.zeros(vocabulary.OTHER)
        held = vocabulary.places < vocabulary.OTHER
        counts[vocabulary.places[held]] = vocabulary.counts[held]
        counts = counts.reshape(CLASSES, SLOTS)
        within = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        model.p["slot_b"] = np.where(counts > 0, np.log(np.maximum(within, 1e-12)), -30.0).astype(np.float32)
        kinds = np.append(counts.sum(axis=1), max(total - vocabulary.n_top, 0))
        model.p["class_b"] = np.log((kinds + 0.5) / (kinds + 0.5).sum()).astype(np.float32)
        return model

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Gru:
        model = cls()
        with np.load(io.BytesIO(data)) as held:
            model.p = {k: held[k] for k in held.files}
        return model

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Next state, with what back-propagation needs."""
        p, k = self.p, HIDDEN
        a = p["embed"].take(x, axis=0)
        a += p["bias"]
        u = h @ p["hidden"][:, : 2 * k]
        u += a[:, : 2 * k]
        gates = _sigmoid(u)
        z, r = gates[:, :k], gates[:, k:]
        c = (r * h) @ p["hidden"][:, 2 * k :]
        c += a[:, 2 * k :]
        np.tanh(c, out=c)
        new = c - h
        new *= z
        new += h
        return new, z, r, c

    def _by_class(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class of each place, order by class, where each class begins and the last ends)."""
        kind = np.minimum(places // SLOTS, CLASSES)
        order = np.argsort(kind.astype(np.int8), kind="stable")
        return kind, order, np.searchsorted(kind[order], np.arange(CLASSES + 1))

    def log_probs(self, states: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Natural log probability of each place (its class only for words without one)."""
        p = self.p
        logits = states @ p["class_w"]
        logits += p["class_b"]
        kind, order, cuts = self._by_class(places)
        out = logits[np.arange(len(places)), kind]
        exps, off = _exps(logits, _small(states, p["class_w"], p["class_b"]))
        out -= np.log(_rows(exps))
        out -= off[:, 0] if isinstance(off, np.ndarray) else off
        sorted_states, slot = states[order], places[order]
        small = _small(states, p["slot_w"], p["slot_b"])
        for c in range(CLASSES):
            a, b = cuts[c], cuts[c + 1]
            if a < b:
                inner = sorted_states[a:b] @ p["slot_w"][c]
                inner += p["slot_b"][c]
                own = inner[np.arange(b - a), slot[a:b] - c * SLOTS]
                exps, off = _exps(inner, small)
                own -= np.log(_rows(exps))
                out[order[a:b]] += own - (off[:, 0] if isinstance(off, np.ndarray) else off)
        return out

    def totals(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log likelihood of whole documents: the state is carried from window to window.

        Documents are walked side by side from the longest on; one that ends drops out. Words are
        scored when KEPT states have come together, however few documents are still under way.
        """
        order = np.argsort(-counts, kind="stable")
        starts = (np.cumsum(counts) - counts)[order]
        lengths = counts[order]
        out = np.zeros(len(counts))
        h = np.zeros((len(counts), HIDDEN), np.float32)
        x = np.full(len(counts), Vocabulary.OTHER, np.int32)
        states, said, whose, kept = [], [], [], 0
        n_by_step = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")
        for t, n in enumerate(n_by_step.tolist()):
            h = self.step(h[:n], x[:n])[0]
            x = places[starts[:n] + t]
            states.append(h)
            said.append(x)
            whose.append(n)
            kept += n
            if kept >= KEPT or t + 1 == len(n_by_step):
                owner = np.concatenate([np.arange(n) for n in whose])
                out += np.bincount(owner, self.log_probs(np.concatenate(states), np.concatenate(said)), minlength=len(out))
                states, said, whose, kept = [], [], [], 0
        result = np.zeros(len(counts))
        result[order] = out
        return result

    def gradients(self, h: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of a window (steps x streams) and the state after it: truncated back-propagation."""
        p, k = self.p, HIDDEN
        kept, states = [], []
        for x in xs:
            new, z, r, c = self.step(h, x)
            kept.append((h, z, r, c))
            states.append(new)
            h = new
        flat, places = np.concatenate(states), ys.ravel()
        g = {name: np.zeros_like(v) for name, v in p.items()}
        kind, order, cuts = self._by_class(places)
        prob = flat @ p["class_w"]
        prob += p["class_b"]
        prob, _ = _exps(prob, _small(flat, p["class_w"], p["class_b"]))
        prob /= _rows(prob)[:, None]
        prob[np.arange(len(kind)), kind] -= 1
        g["class_w"], g["class_b"] = flat.T @ prob, _columns(prob)
        back = prob @ p["class_w"].T
        small = _small(flat, p["slot_w"], p["slot_b"])
        flat, slot, inner_back = flat.take(order, axis=0), places.take(order), np.zeros_like(back)
        for c in range(CLASSES):
            a, b = cuts[c], cuts[c + 1]
            if a < b:
                prob = flat[a:b] @ p["slot_w"][c]
                prob += p["slot_b"][c]
                prob, _ = _exps(prob, small)
                prob /= _rows(prob)[:, None]
                prob[np.arange(b - a), slot[a:b] - c * SLOTS] -= 1
                g["slot_w"][c], g["slot_b"][c] = flat[a:b].T @ prob, _columns(prob)
                inner_back[a:b] = prob @ p["slot_w"][c].T
        back[order] += inner_back
        back = back.reshape(len(xs), -1, k)
        dh = np.zeros_like(h)
        da = np.empty((len(xs), len(h), 3 * k), flat.dtype)
        gates, state = (np.ascontiguousarray(x.T) for x in (p["hidden"][:, : 2 * k], p["hidden"][:, 2 * k :]))
        before, z, r, c = (np.stack(part) for part in zip(*kept))
        slope, moved, on, off = 1 - c * c, c - before, 1 - z, 1 - r
        for t in range(len(xs) - 1, -1, -1):
            dh = dh + back[t]
            dhz = dh * z[t]
            dc, both = da[t, :, 2 * k :], da[t, :, : 2 * k]
            np.multiply(dhz, slope[t], out=dc)
            drh = dc @ state
            np.multiply(dhz, moved[t], out=both[:, :k])
            both[:, :k] *= on[t]
            np.multiply(drh, before[t], out=both[:, k:])
            both[:, k:] *= r[t]
            both[:, k:] *= off[t]
            dh -= dhz
            drh *= r[t]
            dh += drh
            dh += both @ gates
        da, x = da.reshape(-1, 3 * k), xs.ravel()
        before, gate = before.reshape(-1, k), r.reshape(-1, k)
        g["hidden"][:, : 2 * k] = before.T @ da[:, : 2 * k]
        g["hidden"][:, 2 * k :] = (gate * before).T @ da[:, 2 * k :]
        order = np.argsort(x.astype(np.int16), kind="stable")
        at = np.flatnonzero(np.diff(x[order], prepend=-1))
        g["embed"][x[order][at]] = np.add.reduceat(da.take(order, axis=0), at)
        g["bias"] = _columns(da)
        return g, h


class Learner:
    """Adam over streams of documents put end to end; states pass from window to window."""

    def __init__(self, model: Gru, rate: float) -> None:
        self.model, self.rate, self.updates = model, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in model.p.items()}

    def learn(self, said: np.ndarray, counts: np.ndarray) -> None:
        """One pass over documents, given as the places of all their tokens and the tokens of each.

        Tokens are cut into as many streams as leave UPDATES updates or more, STREAMS at most;
        the few that fill no stream come first in none of them and are left over.
        """
        streams = int(np.clip(len(said) // (WINDOW * UPDATES), 1, STREAMS))
        steps = len(said) // streams
        shape = lambda x: x[: steps * streams].reshape(streams, steps).T
        fresh = np.zeros(len(said), bool)
        fresh[(np.cumsum(counts) - counts)] = True
        ys, fresh = shape(said), shape(fresh)
        xs = np.vstack((np.full((1, streams), Vocabulary.OTHER, ys.dtype), ys[:-1]))
        xs[fresh] = Vocabulary.OTHER
        h = np.zeros((streams, HIDDEN), np.float32)
        for at in range(0, steps, WINDOW):
            h[fresh[at]] = 0
            g, h = self.model.gradients(h, xs[at : at + WINDOW], ys[at : at + WINDOW])
            self.updates += 1
            rate = self.rate * np.sqrt(1 - 0.999**self.updates) / (1 - 0.9**self.updates)
            for name, v in g.items():
                v /= v.dtype.type(streams * WINDOW)
                self.first[name] += np.float32(0.1) * (v - self.first[name])
                self.second[name] += np.float32(0.001) * (v * v - self.second[name])
                self.model.p[name] -= np.float32(rate) * self.first[name] / (np.sqrt(self.second[name]) + np.float32(1e-8))


def count_tokens(docs: DataFrame, text_col: str) -> DataFrame:
    """(token, n) of all texts: summed batch by batch in the tasks, then by token."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = np.unique(tokens(batch.column(0).to_pylist())[0], return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], names=["token", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "token bigint, n bigint")
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame) -> Vocabulary:
    """The most frequent words, SENT of them at most, as a table for all tasks.

    The least count that is sent comes from a histogram over logarithmic steps of counts,
    so no task or driver sees all words.
    """
    step = F.floor(F.log2(F.col("n")) * 64)
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).toPandas().sort_values("step", ascending=False)
    fit_in = steps[steps["words"].cumsum() <= SENT]
    least = int(fit_in["step"].min()) if len(fit_in) else 1 << 30
    top = counts.filter(step >= least).toPandas()
    return Vocabulary(top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64))


def _pieces(model: Gru) -> np.ndarray:
    flat = np.concatenate([v.ravel() for _, v in sorted(model.p.items())])
    return np.pad(flat, (0, -len(flat) % PIECE)).reshape(-1, PIECE)


def _joined(pieces: np.ndarray) -> Gru:
    model, flat, at = Gru(), pieces.ravel().astype(np.float32), 0
    for name, v in sorted(model.p.items()):
        model.p[name] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return model


def _average(rows: pa.Table) -> pa.Table:
    """Mean of a piece over tasks, weighted by the tokens that each has learned from, in a fixed order."""
    order = np.argsort(rows.column("task").to_numpy())
    weights = rows.column("tokens").to_numpy()[order].astype(np.float64)
    values = np.stack([np.frombuffer(v, "<f4") for v in rows.column("weights").to_pylist()])[order]
    mean = (weights / weights.sum()) @ values
    return pa.table({"piece": rows.column("piece").slice(0, 1), "weights": pa.array([mean.astype("<f4").tobytes()], pa.binary())})


def fit(docs: DataFrame, vocabulary: Vocabulary, total: int, id_col: str, text_col: str, rounds: int = ROUNDS) -> bytes:
    """Weights of a network that has learned from all given rows, each once.

    Rows are dealt to rounds by a hash of their id. In a round every task learns from its own
    rows, batch by batch, and the tasks' weights are averaged by tokens, piece by piece; the
    next round starts from the average at half the rate. Nothing but the weights, whose size
    is fixed, leaves a task.
    """
    spark, model = docs.sparkSession, Gru.start(vocabulary, total)
    words = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col), F.lit(13)), F.lit(rounds)).alias("round"), F.col(text_col).alias("text"))
    for number in range(rounds):
        sent, rate = spark.sparkContext.broadcast(model.save()), RATE * 0.5**number

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate) -> Iterator[pa.RecordBatch]:
            learner, seen = Learner(Gru.load(sent.value), rate), 0
            for batch in batches:
                h, n = tokens(batch.column(0).to_pylist())
                learner.learn(words.value.look_up(h)[0], n)
                seen += len(h)
            if seen:
                held = _pieces(learner.model)
                yield pa.record_batch([
                    pa.array(np.full(len(held), TaskContext.get().partitionId())), pa.array(np.arange(len(held))), pa.array(np.full(len(held), seen)),
                    pa.array([x.astype("<f4").tobytes() for x in held], pa.binary()),
                ], names=["task", "piece", "tokens", "weights"])

        learned = rows.filter(F.col("round") == number).select("text").coalesce(LEARNERS).mapInArrow(learn, "task bigint, piece bigint, tokens bigint, weights binary")
        found = learned.groupBy("piece").applyInArrow(_average, "piece bigint, weights binary").collect()  # the weights of one network
        if found:
            model = _joined(np.stack([np.frombuffer(r["weights"], "<f4") for r in sorted(found, key=lambda r: r["piece"])]))
    return model.save()


def score(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) per row of docs.

    Rows for which learn_from holds teach: all of them give the counts, and the network learns
    from all of them, in ROUNDS whose tasks' weights are averaged. base_score sums log10((c + 1) / (N + V + 1)) over a
    text's words and end. score is the network's log10 probability of the whole text: the
    class and slot of frequent words, and for the others their class times
    (c + 1) / (n + v + 1) with c, n, v counted among words without a slot, which leaves
    (1 / (n + v + 1)) to all unseen words together. Scores of all texts that are so many
    words thus add to one.

    Counts of the SENT most frequent words go to all tasks; rarer words of a text travel as
    (hash, row, times) and meet their count in a join, where a text's words are spread by
    hash. A null text counts as empty (an end only); repeated rows get equal scores; without
    any teaching row N and V are 0; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    teaching = docs.filter(learn_from)
    counts = materialise(count_tokens(teaching, text_col), "lm-counts")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, v_all = whole["n"], whole["v"]
    vocabulary = frequent(counts)
    sent = spark.sparkContext.broadcast((vocabulary, fit(teaching, vocabulary, n_all, id_col, text_col)))
    kind = docs.schema[id_col].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = sent.value[0], Gru.load(sent.value[1])
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, len(whole), SIDE_BY_SIDE):
                batch = whole.slice(at, SIDE_BY_SIDE)
                h, n = tokens(batch.column(1).to_pylist())
                places, c = words.look_up(h)
                owner = np.repeat(np.arange(len(n)), n)
                logs = np.log10(np.maximum(c, 0) + 1.0)
                other = places == Vocabulary.OTHER
                sums = [np.bincount(owner, x, minlength=len(n)) for x in (c > 0, logs, other, np.where(other, logs, 0.0))]
                far = np.flatnonzero(c < 0)
                fh, fo = h[far], owner[far]
                del h, owner, logs, other, c
                by = np.lexsort((fh, fo))
                fh, fo = fh[by], fo[by]
                new = np.flatnonzero(np.append(True, (fh[1:] != fh[:-1]) | (fo[1:] != fo[:-1]))) if len(fh) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(fh)))
                cuts = pa.array(np.append(0, np.cumsum(np.bincount(fo[new], minlength=len(n)))).astype(np.int32))
                yield pa.record_batch([
                    pa.array(np.arange(row, row + len(n))), batch.column(0), pa.array(n), *map(pa.array, sums), pa.array(model.totals(places, n) / _LN10),
                    pa.ListArray.from_arrays(cuts, pa.array(fh[new].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32))),
                ], names=["row", "id", "n_tokens", "near", "logs", "others", "other_logs", "network", "far", "times"])
                row += len(n)

    schema = f"row bigint, id {kind}, n_tokens bigint, near double, logs double, others double, other_logs double, network double, far array<bigint>, times array<int>"
    walked = materialise(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(walk, schema), "lm-rows")
    far = walked.select("row", F.explode(F.arrays_zip("far", "times")).alias("f")).select("row", F.col("f.far").alias("token"), F.col("f.times").alias("times"))
    met = far.join(counts, "token").groupBy("row").agg(F.sum("times").alias("far_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("far_logs"))
    rows = walked.drop("far", "times").join(met, "row", "left").na.fill(0, ["far_known", "far_logs"])
    base_at = float(np.log10(n_all + v_all + 1))
    other_at = float(np.log10(n_all - vocabulary.n_top + v_all - vocabulary.v_top + 1))
    return rows.select(
        "id", "n_tokens", (F.col("near") + F.col("far_known")).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("far_logs") - F.col("n_tokens") * base_at).alias("base_score"),
        (F.col("network") + F.col("other_logs") + F.col("far_logs") - F.col("others") * other_at).alias("score"),
    )
