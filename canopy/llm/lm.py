"""Language-model scoring with a gated recurrent network in numpy.

Tokens are lower-cased words and an end. Their counts over all training documents come from one shuffle of distinct words
(see _chunks) and return to the documents' chunks, so the counts, and all that is worked out from them, cover the corpus.
The output is factored by class: P(word | history) = P(class | state) P(word | class, state). FREQUENT words share classes
of CLASS_SIZE that were found by halving their co-occurrence in documents; within these a softmax over the state's scores
gives the word. All other words fall into RARE classes by their ending, where the corpus counts give the word with one
added to each and one unit left for unknown words.

The recurrence is a gated recurrent unit, trained by truncated backpropagation over windows of WINDOW tokens with Adam; its
state is dropped where a document begins. All training documents take part, each once: co-occurrence for the word classes is
summed over all of them, the biases of classes and words start from the corpus counts, and the network learns in ROUNDS that
each take a share of the documents by a hash. A round's documents are dealt into buckets of about BUCKET_TOKENS tokens that
train side by side from the same start; the weights are averaged by the buckets' tokens and start the next round. Scoring
runs many documents abreast and carries each one's state from window to window, so a document's log-likelihood is that of
its whole text.

Defined cases: null and empty texts consist of the end alone; repeated rows are scored (and counted) each; a null id
counts as empty text in the split into parts; with no training documents the counts are zero and the untrained network
scores; extra columns are ignored.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chunks import answered, chunked, pack, token_places, unpack, unpack_words
from ._common import crc_of_id, staged, trimmed, utf8

HELD_OUT = (7, 2)
FREQUENT = 1024
CLASS_SIZE = 32
RARE = 64
HIDDEN = 16
EMBED = 16
WINDOW = 32
EPOCHS = 2
ABREAST = 128
BUCKET_TOKENS = 2_000_000
#: Rounds of training: thousandths of the documents that are done after each, the rate that it starts with, lanes abreast.
ROUNDS = [(100, 0.015, 96), (300, 0.01, 192), (600, 0.008, 192), (1000, 0.006, 192)]
#: Lanes are fewer where a bucket's texts would fill fewer windows than these.
LEAST_WINDOWS = 128
PARTS = 16
#: Rows whose class scores are worked out at a time, so that they stay in the processor's cache.
CACHED_ROWS = 512

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def rare_class(word: bytes) -> int:
    """By the last two characters (up to four bytes of UTF-8), so that inflected forms of a language meet."""
    return zlib.crc32(word.decode("utf-8", "replace")[-2:].encode()) % RARE


class Vocabulary:
    """Frequent words (the end is number 0), what the counts give the rare classes, and totals."""

    def __init__(self, words: list[bytes], end_count: int, total: int, distinct: int, rare_total: np.ndarray, rare_distinct: np.ndarray):
        self.words, self.end_count, self.total, self.distinct = words, end_count, total, distinct
        self.number = {w: k + 1 for k, w in enumerate(words)}
        self.rare_room = rare_total + rare_distinct + 1.0

    def symbol(self, word: bytes) -> int:
        return self.number.get(word) or FREQUENT + rare_class(word)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / (self.total + self.distinct + 1.0))


def _powers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """e to the rows of x, which is overwritten, and the rows' sums. Scores of a bounded state never come near the bound of 60."""
    if x.size and x.max() > 60:
        np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


class Network:
    """A gated recurrent unit with a class-factored softmax. Symbols are frequent words, then rare classes; START begins."""

    START = FREQUENT + RARE
    CLASSES = FREQUENT // CLASS_SIZE + RARE

    def __init__(self, class_of: np.ndarray, seed: int = 3):
        r = np.random.default_rng(seed)
        self.class_of = np.concatenate([class_of, np.arange(RARE) + FREQUENT // CLASS_SIZE]).astype(np.int64)
        order = np.argsort(class_of, kind="stable")
        self.place = np.zeros(FREQUENT + RARE, np.int64)
        self.place[order] = np.arange(FREQUENT) % CLASS_SIZE
        scale = 1 / np.sqrt(HIDDEN)
        self.p = {
            "embed": r.normal(0, 0.3, (self.START + 1, EMBED)),
            "inward": r.normal(0, scale, (EMBED, 3 * HIDDEN)),
            "gates": r.normal(0, scale, (HIDDEN, 2 * HIDDEN)),
            "fresh": r.normal(0, scale, (HIDDEN, HIDDEN)),
            "bias": np.zeros(3 * HIDDEN),
            "to_class": r.normal(0, scale, (HIDDEN, self.CLASSES)),
            "class_bias": np.zeros(self.CLASSES),
            "to_word": r.normal(0, scale, (FREQUENT // CLASS_SIZE, HIDDEN, CLASS_SIZE)),
            "word_bias": np.zeros((FREQUENT // CLASS_SIZE, CLASS_SIZE)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, inputs: np.ndarray, h: np.ndarray, begins: np.ndarray | None = None) -> np.ndarray:
        """inputs (steps, abreast) -> states after each step. Where begins is true a document begins, and the state of the one before is dropped."""
        return self._steps(self._drive(), inputs, h.T, begins)[0].transpose(0, 2, 1)

    def _drive(self) -> np.ndarray:
        """What each symbol adds to the gates, halved, and to the fresh state."""
        drive = self.p["embed"] @ self.p["inward"] + self.p["bias"]
        drive[:, : 2 * HIDDEN] *= 0.5
        return drive

    def _steps(self, drive: np.ndarray, inputs: np.ndarray, h: np.ndarray, begins: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """From h (HIDDEN, abreast), for each step: states after and before it, both gates, fresh states.

        Lanes come last, so that each gate lies in one piece. The gates are sigmoids, (1 + tanh(x / 2)) / 2.
        """
        n, (steps, lanes), kind = HIDDEN, inputs.shape, drive.dtype
        to_gates, to_fresh = np.ascontiguousarray(self.p["gates"].T) * kind.type(0.5), np.ascontiguousarray(self.p["fresh"].T)
        gates, fresh = np.split(np.ascontiguousarray(drive[inputs].transpose(0, 2, 1)), [2 * n], axis=1)
        out, before = np.empty((steps, n, lanes), kind), np.empty((steps, n, lanes), kind)
        gate_part, part = np.empty((2 * n, lanes), kind), np.empty((n, lanes), kind)
        new = np.zeros(steps, bool) if begins is None else begins.any(1)
        for t in range(steps):
            held, gate, young, after = before[t], gates[t], fresh[t], out[t]
            held[:] = h
            if new[t]:
                held *= ~begins[t]
            np.matmul(to_gates, held, out=gate_part)
            gate += gate_part
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            np.multiply(gate[n:], held, out=part)
            np.matmul(to_fresh, part, out=after)
            young += after
            np.tanh(young, out=young)
            np.subtract(young, held, out=after)
            after *= gate[:n]
            after += held
            h = after
        return out, before, gates, fresh

    def by_class(self, classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """Rows of frequent classes in the order of the classes, and the part of these that each class that occurs has."""
        ends = np.cumsum([0, *np.bincount(classes, minlength=self.CLASSES)[: FREQUENT // CLASS_SIZE]]).tolist()
        order = np.argsort(classes.astype(np.uint8), kind="stable")[: ends[-1]]
        return order, [(c, slice(*x)) for c, x in enumerate(zip(ends[:-1], ends[1:], strict=True)) if x[0] < x[1]]

    def _within(self, rows: np.ndarray, parts: list[tuple[int, slice]], weights: np.ndarray) -> np.ndarray:
        """Scores of the words of each row's class; rows and weights as _rows and _weights give them."""
        inner = np.empty((len(rows), CLASS_SIZE), rows.dtype)
        for c, part in parts:
            np.matmul(rows[part], weights[c], out=inner[part])
        return inner

    def _rows(self, states: np.ndarray) -> np.ndarray:
        """States (any shape, HIDDEN) as rows that close with a one, which stands for the bias."""
        rows = np.ones((*states.shape[:-1], HIDDEN + 1), np.result_type(states, self.p["to_class"]))
        rows[..., :HIDDEN] = states
        return rows.reshape(-1, HIDDEN + 1)

    def _weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the classes and of the words in each, with the biases as last rows."""
        p = self.p
        return np.concatenate([p["to_class"], p["class_bias"][None]]), np.concatenate([p["to_word"], p["word_bias"][:, None]], 1)

    def log10_of(self, states: np.ndarray, targets: np.ndarray, rare_log10: np.ndarray) -> np.ndarray:
        """log10 probability of each target; rare_log10 is that of a rare word within its class."""
        classes, rows, (to_class, to_word) = self.class_of[targets], self._rows(states), self._weights()
        out, total = np.empty(len(targets), rows.dtype), np.empty(len(targets), rows.dtype)
        for at in range(0, len(targets), CACHED_ROWS):
            part = slice(at, at + CACHED_ROWS)
            logits = rows[part] @ to_class
            out[part] = logits[np.arange(len(logits)), classes[part]]
            total[part] = _powers(logits)[1]
        out -= np.log(total)
        own, parts = self.by_class(classes)
        inner = self._within(rows[own], parts, to_word)
        reached = inner[np.arange(own.size), self.place[targets[own]]]
        out[own] += reached - np.log(_powers(inner)[1])
        return out.astype(np.float64) / np.log(10) + rare_log10

    def gradients(
        self, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray, h: np.ndarray, begins: np.ndarray | None = None
    ) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean cross-entropy over one window, and the state to carry on."""
        p, n = self.p, HIDDEN
        out, before, gates, fresh = self._steps(self._drive(), inputs, h.T, begins)
        rows, goal, weight = self._rows(out.transpose(0, 2, 1)), targets.ravel(), mask.ravel().astype(np.float32) / max(1, mask.sum())
        classes, (to_class, to_word) = self.class_of[goal], self._weights()
        g, g_class, g_word = {k: np.zeros_like(v) for k, v in p.items()}, np.zeros_like(to_class), np.zeros_like(to_word)
        down = np.empty((goal.size, n), rows.dtype)
        # Errors stay multiples of the rows' sums of powers; the narrow matrices that they meet are divided by these instead.
        for at in range(0, goal.size, CACHED_ROWS):
            part = slice(at, at + CACHED_ROWS)
            error, total = _powers(rows[part] @ to_class)
            error[np.arange(len(error)), classes[part]] -= total
            share = (weight[part] / total)[:, None]
            g_class += (rows[part] * share).T @ error
            np.multiply(error @ p["to_class"].T, share, out=down[part])
        own, parts = self.by_class(classes)
        picked, back = rows[own], np.empty((own.size, n), rows.dtype)
        inner, total = _powers(self._within(picked, parts, to_word))
        inner[np.arange(own.size), self.place[goal[own]]] -= total
        share = (weight[own] / total)[:, None]
        picked *= share
        for c, part in parts:
            g_word[c] = picked[part].T @ inner[part]
            np.matmul(inner[part], p["to_word"][c].T, out=back[part])
        back *= share
        down[own] += back
        g["to_class"], g["class_bias"], g["to_word"], g["word_bias"] = g_class[:n], g_class[n], g_word[:, :n], g_word[:, n]

        down = np.ascontiguousarray(down.reshape(*inputs.shape, n).transpose(0, 2, 1))
        update, reset = gates[:, :n], gates[:, n:]
        stay, to_fresh = 1 - update, update * (1 - fresh * fresh)
        to_update, to_reset = (fresh - before) * update * stay, before * reset * (1 - reset)
        drive = np.empty((len(inputs), 3 * n, inputs.shape[1]), rows.dtype)
        back, inward, part = np.zeros_like(down[0]), np.empty_like(down[0]), np.empty_like(down[0])
        new = np.zeros(len(inputs), bool) if begins is None else begins.any(1)
        for t in range(len(inputs) - 1, -1, -1):
            d, both, d_fresh = down[t], drive[t, : 2 * n], drive[t, 2 * n :]
            d += back
            np.multiply(d, to_fresh[t], out=d_fresh)
            np.matmul(p["fresh"], d_fresh, out=inward)
            np.multiply(d, to_update[t], out=both[:n])
            np.multiply(inward, to_reset[t], out=both[n:])
            np.matmul(p["gates"], both, out=back)
            back += np.multiply(d, stay[t], out=part)
            back += np.multiply(inward, reset[t], out=part)
            if new[t]:
                back *= ~begins[t]
        rows = np.ascontiguousarray(drive.transpose(0, 2, 1))
        g["gates"] = np.matmul(before, rows[:, :, : 2 * n]).sum(0)
        g["fresh"] = np.matmul(reset * before, rows[:, :, 2 * n :]).sum(0)
        rows = rows.reshape(-1, 3 * n)
        symbols = inputs.ravel().astype(np.uint16)
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        starts = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        own, sums = symbols[starts], np.add.reduceat(rows[order], starts)
        g["bias"] = sums.sum(0)
        g["inward"] = p["embed"][own].T @ sums
        g["embed"][own] = sums @ p["inward"].T
        return g, out[-1].T

    def dump(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, class_of=self.class_of, place=self.place, **self.p)
        return file.getvalue()

    @classmethod
    def load(cls, dumped: bytes) -> Network:
        held = np.load(io.BytesIO(dumped))
        net = cls(np.repeat(np.arange(FREQUENT // CLASS_SIZE), CLASS_SIZE))
        net.class_of, net.place = held["class_of"], held["place"]
        net.p = {k: held[k] for k in net.p}
        return net


def co_occurrence(texts: Iterable[np.ndarray], at_once: int = 1_000) -> np.ndarray:
    """For each two frequent symbols, the texts that hold both."""
    together, texts = np.zeros((FREQUENT, FREQUENT), np.int64), iter(texts)
    while some := list(islice(texts, at_once)):
        seen = np.zeros((FREQUENT, len(some)), np.float32)
        for k, symbols in enumerate(some):
            seen[symbols[symbols < FREQUENT], k] = 1
        together += (seen @ seen.T).astype(np.int64)
    return together


def word_classes(together: np.ndarray) -> np.ndarray:
    """Classes of equal size: the frequent symbols are halved again and again along their main direction of co-occurrence."""
    root = np.sqrt(np.diag(together) + 1.0)
    products = together / root[:, None] / root
    groups = [np.arange(FREQUENT)]
    while len(groups[0]) > CLASS_SIZE:
        halves = []
        for g in groups:
            x = products[np.ix_(g, g)]
            x = x - x.mean(0) - x.mean(1)[:, None] + x.mean()
            v = x[int(np.argmax(np.diag(x)))]
            for _ in range(12):
                v = x @ v
                v /= np.linalg.norm(v) + 1e-12
            order = g[np.argsort(v, kind="stable")]
            halves += [order[: len(g) // 2], order[len(g) // 2 :]]
        groups = halves
    classes = np.zeros(FREQUENT, np.int64)
    for c, g in enumerate(groups):
        classes[g] = c
    return classes


def abreast(lengths: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Place sequences end to end in lanes of about equal length: each one's lane and first step, and the steps in all."""
    ends = [0] * max(1, min(lanes, len(lengths)))
    lane, first = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    import heapq

    heap = [(0, k) for k in range(len(ends))]
    for i in np.argsort(-lengths, kind="stable"):
        end, k = heapq.heappop(heap)
        lane[i], first[i] = k, end
        heapq.heappush(heap, (end + int(lengths[i]), k))
        ends[k] = end + int(lengths[i])
    return lane, first, max(ends, default=0)


def counted_network(together: np.ndarray, counts: np.ndarray) -> Network:
    """An untrained network with classes by co-occurrence and the biases that the symbols' counts give."""
    net = Network(word_classes(together))
    classes = np.bincount(net.class_of, weights=counts, minlength=Network.CLASSES) + 1.0
    net.p["class_bias"] = np.log(classes / classes.sum()).astype(np.float32)
    words = np.zeros((FREQUENT // CLASS_SIZE, CLASS_SIZE))
    words[net.class_of[:FREQUENT], net.place[:FREQUENT]] = counts[:FREQUENT] + 1.0
    net.p["word_bias"] = np.log(words / words.sum(1, keepdims=True)).astype(np.float32)
    return net


def train(texts: list[np.ndarray], epochs: int = EPOCHS, lanes: int = 64, rate: float = 0.01, net: Network | None = None) -> Network:
    """texts are symbol sequences that close with the end (0); a given network is trained on."""
    if net is None:
        net = counted_network(co_occurrence(texts), np.bincount(np.concatenate([np.zeros(0, np.int64), *texts]), minlength=FREQUENT + RARE))
    if not texts:
        return net
    lengths = np.array([len(t) for t in texts])
    lane, first, steps = abreast(lengths, lanes)
    used = np.bincount(lane, weights=lengths).astype(np.int64)
    order = np.argsort(-used, kind="stable")  # the longest lanes first, so that the lanes still running are a prefix
    lane, used = np.argsort(order, kind="stable")[lane], used[order]
    steps += -steps % WINDOW
    inputs = np.full((steps, lane.max() + 1), Network.START)
    targets, mask, fresh = np.zeros_like(inputs), np.zeros(inputs.shape, bool), np.zeros(inputs.shape, bool)
    for t, k, at in zip(texts, lane, first, strict=True):
        inputs[at + 1 : at + len(t), k] = t[:-1]
        targets[at : at + len(t), k], mask[at : at + len(t), k], fresh[at, k] = t, True, True
    weights = np.concatenate([v.ravel() for v in net.p.values()])
    parts = np.split(weights, np.cumsum([v.size for v in net.p.values()])[:-1])
    net.p = {k: x.reshape(v.shape) for (k, v), x in zip(net.p.items(), parts, strict=True)}  # views: a step on the weights is one on all
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    done, windows = 0, epochs * steps // WINDOW
    for _ in range(epochs):
        h = np.zeros((inputs.shape[1], HIDDEN), np.float32)
        for at in range(0, steps, WINDOW):
            now = slice(at, at + WINDOW), slice(0, int((used > at).sum()))
            grads, h = net.gradients(inputs[now], targets[now], mask[now], h[now[1]], fresh[now])
            done += 1
            step = rate * (1 - done / (windows + 1)) + 1e-4
            g = np.concatenate([grads[k].ravel() for k in net.p])
            g *= min(1.0, 1.0 / (float(np.sqrt(g @ g)) + 1e-9))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            weights -= step * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.999**done)) + 1e-8)
    return net


def document_scores(net: Network, symbols: list[np.ndarray], rare_log10: list[np.ndarray], lanes: int = ABREAST, window: int = 64) -> np.ndarray:
    """log10 probability of each whole sequence."""
    lengths = np.array([len(s) for s in symbols], np.int64)
    if not lengths.sum():
        return np.zeros(len(symbols))
    lane, first, _ = abreast(lengths, lanes)
    used = np.bincount(lane, weights=lengths).astype(np.int64)
    order = np.argsort(-used, kind="stable")  # the longest lanes first, so that the lanes still running are a prefix
    lane, used = np.argsort(order, kind="stable")[lane], used[order]
    running = len(used) - np.searchsorted(used[::-1], np.arange(used[0]), side="right")
    offsets = np.concatenate([[0], np.cumsum(running)])
    # Tokens lie step by step, and by lane in each: all lanes that run, without gaps.
    owner, begun = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths
    place = offsets[np.arange(owner.size) + np.repeat(first - begun, lengths)] + lane[owner]
    flat = np.concatenate(symbols)
    begun = begun[lengths > 0]
    targets, inputs, begins = np.empty(flat.size, np.int16), np.empty(flat.size, np.int16), np.zeros(flat.size, bool)
    targets[place], inputs[place[1:]] = flat, flat[:-1]
    inputs[place[begun]], begins[place[begun]] = Network.START, True
    logs, drive, h = np.empty(flat.size), net._drive(), np.zeros((HIDDEN, len(used)), np.float32)
    changes = np.flatnonzero(np.diff(running)) + 1
    for at in range(0, len(running), window):
        end = min(at + window, len(running))
        stops = [at, *changes[np.searchsorted(changes, at, side="right") : np.searchsorted(changes, end)].tolist(), end]
        out = []
        for a, b in zip(stops[:-1], stops[1:], strict=True):
            part, shape = slice(offsets[a], offsets[b]), (b - a, running[a])
            states = net._steps(drive, inputs[part].reshape(shape), h[:, : running[a]], begins[part].reshape(shape))[0]
            h = states[-1]
            out.append(states.transpose(0, 2, 1).reshape(-1, HIDDEN))
        part = slice(offsets[at], offsets[end])
        logs[part] = net.log10_of(np.concatenate(out), targets[part], 0.0)
    return np.bincount(owner, weights=logs[place] + np.concatenate(rare_log10), minlength=len(symbols))


def _statistics(tokens: DataFrame):
    """Per bucket: distinct words and occurrences in training by rare class, and the most frequent words."""

    def run(table: pa.Table) -> pa.Table:
        counts: dict[bytes, int] = {}
        for words, packed in zip(table["words"].to_pylist(), table["counts"].to_pylist(), strict=True):
            for w, c in zip(unpack_words(words), unpack(packed).tolist(), strict=True):
                if c:
                    counts[w] = counts.get(w, 0) + c
        by_class = np.zeros((2, RARE), np.int64)
        for w, c in counts.items():
            k = rare_class(w)
            by_class[0, k] += c
            by_class[1, k] += 1
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: FREQUENT - 1]
        n = len(top)
        return pa.table(
            {
                "word": pa.array([w for w, _ in top] + [None] * RARE, pa.binary()),
                "rare": pa.array([rare_class(w) for w, _ in top] + list(range(RARE)), pa.int32()),
                "total": pa.array([c for _, c in top] + by_class[0].tolist(), pa.int64()),
                "types": pa.array([1] * n + by_class[1].tolist(), pa.int64()),
            }
        )

    found = staged(tokens.groupBy("bucket").applyInArrow(run, "word binary, rare int, total long, types long"), "words")
    top = found.where("word is not null").orderBy(F.desc("total"), "word").limit(FREQUENT - 1).collect()
    sums = found.where("word is null").groupBy("rare").agg(F.sum("total").alias("total"), F.sum("types").alias("types")).collect()
    return top, sums


def _tokens_of(batch: pa.RecordBatch, i: int) -> tuple[pa.StructArray, list[np.ndarray], np.ndarray, np.ndarray]:
    """A chunk's rows, their texts as token numbers, and each token's count in training and symbol."""
    rows, lens = batch["rows"][i].values, np.array(batch["lens"][i].values, np.int64)
    codes, places = unpack(batch["codes"][i].as_py()), token_places(batch["buckets"][i].as_py())
    size = sum(p.size for p in places.values())
    counts, symbols = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for part in batch["answers"][i].as_py() or ():
        cut = 4 + int.from_bytes(part["packed"][:4], "little")
        counts[places[part["bucket"]]], symbols[places[part["bucket"]]] = unpack(part["packed"][4:cut]), unpack(part["packed"][cut:])
    return rows, np.split(codes, np.cumsum(lens)[:-1]), counts, symbols


def _symbols(chunks: DataFrame, id_type: str) -> DataFrame:
    """Rows (id, symbols binary) of the training documents: each text as packed symbols that close with the end."""

    def run(batches):
        end = np.zeros(1, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                rows, docs, _, symbols = _tokens_of(batch, i)
                own = np.flatnonzero(rows.field("training").to_numpy(zero_copy_only=False))
                packed = [pack(np.concatenate([symbols[docs[k]], end])) for k in own.tolist()]
                yield pa.RecordBatch.from_arrays([rows.field("id").take(pa.array(own)), pa.array(packed, pa.binary())], names=["id", "symbols"])

    return staged(chunks.mapInArrow(trimmed(run), f"id {id_type}, symbols binary"), "symbols")


def _together(symbols: DataFrame) -> np.ndarray:
    """co_occurrence of all texts: counts of each partition, summed in PARTS of the rows."""

    def run(batches):
        counts = co_occurrence(unpack(t) for b in batches for t in b["symbols"].to_pylist())
        packed = [pack(rows.ravel()) for rows in np.split(counts, PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(packed, pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        counts = np.zeros(FREQUENT * FREQUENT // PARTS, np.int64)
        for t in table["counts"].to_pylist():
            counts += unpack(t)
        return pa.table({"part": table["part"][:1], "counts": pa.array([counts.tobytes()], pa.binary())})

    parts = symbols.select("symbols").mapInArrow(trimmed(run), "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    together = np.zeros((PARTS, FREQUENT * FREQUENT // PARTS), np.int64)
    for r in parts:
        together[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return together.reshape(FREQUENT, FREQUENT)


def _averaged(symbols: DataFrame, start, buckets: int, rate: float, lanes: int) -> Network:
    """The network after one pass over the texts: each bucket trains from the same start, and weights are averaged by tokens."""
    net = Network.load(start.value)
    sizes = [v.size for v in net.p.values()]

    def learn(table: pa.Table) -> pa.Table:
        texts = [unpack(t).astype(np.int64) for t in sorted(table["symbols"].to_pylist())]
        order = np.random.default_rng(len(texts)).permutation(len(texts))
        n = sum(map(len, texts))
        own = train([texts[i] for i in order], 1, max(2, min(lanes, n // (WINDOW * LEAST_WINDOWS))), rate, Network.load(start.value))
        parts = np.array_split(np.concatenate([v.ravel() for v in own.p.values()]), PARTS)
        return pa.table(
            {
                "bucket": pa.array([table["bucket"][0].as_py()] * PARTS, pa.int64()),
                "part": pa.array(range(PARTS), pa.int32()),
                "tokens": pa.array([n] * PARTS, pa.int64()),
                "weights": pa.array([x.tobytes() for x in parts], pa.binary()),
            }
        )

    def mean(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["bucket"].to_pylist(), table["tokens"].to_pylist(), table["weights"].to_pylist(), strict=True))
        summed = sum(np.frombuffer(w, np.float32).astype(np.float64) * n for _, n, w in rows) / sum(n for _, n, _ in rows)
        return pa.table({"part": table["part"][:1], "weights": pa.array([summed.astype(np.float32).tobytes()], pa.binary())})

    dealt = symbols.select("symbols", F.pmod(F.xxhash64("id", "symbols"), F.lit(max(1, buckets))).alias("bucket"))
    learned = staged(dealt.groupBy("bucket").applyInArrow(learn, "bucket long, part int, tokens long, weights binary"), "learned")
    parts = {r["part"]: r["weights"] for r in learned.groupBy("part").applyInArrow(mean, "part int, weights binary").collect()}
    if parts:
        flat = np.frombuffer(b"".join(bytes(parts[k]) for k in range(PARTS)), np.float32)
        net.p = {k: x.reshape(v.shape).copy() for (k, v), x in zip(net.p.items(), np.split(flat, np.cumsum(sizes)[:-1]), strict=True)}
    return net


def score(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each document."""
    spark = documents.sparkSession
    parts, left_out = HELD_OUT
    held = F.pmod(crc_of_id(id_col), F.lit(parts)) == left_out
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"), (~held).alias("training"))
    chunks = chunked(source, ["id", "held_out", "training"], "text", words_of, binary=True, counted="training")

    id_type = source.schema["id"].dataType.simpleString()
    n_train = source.where("training").count()
    top, sums = _statistics(chunks.tokens)
    rare_total, rare_types = np.zeros(RARE), np.zeros(RARE)
    for r in sums:
        rare_total[r["rare"]], rare_types[r["rare"]] = r["total"], r["types"]
    total, distinct = int(rare_total.sum()) + n_train, int(rare_types.sum()) + (n_train > 0)
    for r in top:
        rare_total[r["rare"]] -= r["total"]
        rare_types[r["rare"]] -= 1
    vocabulary = spark.sparkContext.broadcast(([bytes(r["word"]) for r in top], n_train, total, distinct, rare_total, rare_types))

    # Words of the rarer classes are symbols of their own, after the frequent ones.
    own_counts = np.zeros(FREQUENT + RARE)
    own_counts[: len(top) + 1], own_counts[FREQUENT:] = [n_train, *(r["total"] for r in top)], rare_total

    def answer(lists: list[list[bytes]], counts: list[np.ndarray]) -> list[bytes]:
        own, known = Vocabulary(*vocabulary.value), {}
        for words, c in zip(lists, counts, strict=True):
            for w, k in zip(words, c.tolist(), strict=True):
                if k:
                    known[w] = known.get(w, 0) + k
        out = []
        for words in lists:
            a = pack(np.fromiter((known.get(w, 0) for w in words), np.int64, len(words)))
            b = pack(np.fromiter(map(own.symbol, words), np.int64, len(words)))
            out.append(len(a).to_bytes(4, "little") + a + b)
        return out

    known = staged(answered(chunks, answer), "known")
    symbols = _symbols(known, id_type)
    network = spark.sparkContext.broadcast(counted_network(_together(symbols), own_counts).dump())
    turn, done = F.pmod(F.xxhash64("symbols", "id"), F.lit(ROUNDS[-1][0])), 0
    for upto, rate, lanes in ROUNDS:
        buckets = -(-total * (upto - done) // (ROUNDS[-1][0] * BUCKET_TOKENS))
        learned = _averaged(symbols.where((turn >= done) & (turn < upto)), network, buckets, rate, lanes)
        network, done = spark.sparkContext.broadcast(learned.dump()), upto

    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def assemble(batches):
        own, net = Vocabulary(*vocabulary.value), Network.load(network.value)
        end_base = float(own.base(np.array([own.end_count]))[0])
        for batch in batches:
            for i in range(batch.num_rows):
                rows, docs, counts, symbols = _tokens_of(batch, i)
                base, seen, rare = own.base(counts), counts > 0, symbols >= FREQUENT
                inner = np.zeros(counts.size)
                inner[rare] = np.log10((counts[rare] + 1.0) / own.rare_room[symbols[rare] - FREQUENT])
                end, zero = np.zeros(1, np.int64), np.zeros(1)
                scores = document_scores(net, [np.concatenate([symbols[d], end]) for d in docs], [np.concatenate([inner[d], zero]) for d in docs])
                bases = [float(base[d].sum()) + end_base for d in docs]
                n_known = [int(seen[d].sum()) + (own.end_count > 0) for d in docs]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.field("id"),
                        rows.field("held_out"),
                        pa.array([len(d) + 1 for d in docs], pa.int64()),
                        pa.array(n_known, pa.int64()),
                        pa.array([own.total] * len(docs), pa.int64()),
                        pa.array(bases, pa.float64()),
                        pa.array(scores, pa.float64()),
                    ],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return known.mapInArrow(trimmed(assemble), schema).withColumnRenamed("id", id_col)
