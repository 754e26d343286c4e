"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its lower-case words, each spelled as its bytes and a space, and one end byte. Every byte is eight binary
decisions, most significant bit first. A decision is predicted from several hashed contexts: the last one, two, three and
four bytes of the word, the whole word so far, and the word so far in the kind (language) of the text. Each predictor is a
pair of counts in a table of 2**``SLOT_BITS`` slots; their stretched probabilities are mixed by weights that a gate (how well
known the word so far is, and its length) selects, and that are refined by online gradient steps. A second, adaptive table
refines what the mixer says from how often it was right. Bits multiply to the probability of a text.

The tables are gathered from all training documents: words are counted by Spark, block by block, so that a word costs one
row per block and is spelled once, weighted by its count. Scoring sends each block the log probability of its own words.
Within a document the model goes on learning: the kind of the text is inferred word by word, and a cache of the document's
own words is mixed in by a weight that follows, online, how often the cache knew the next word.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from activity_engine.llm import blocks
from activity_engine.llm.words import gathered, mix, slices
from activity_engine.session import durable

#: log2 of the counters of one context.
SLOT_BITS = 20
#: (bytes looked back on, 0 for the whole word so far; whether the kind of text counts), from weak to strong.
CONTEXTS = ((1, False), (2, False), (3, False), (4, False), (0, False), (0, True))
#: How many sights a context's own counts must outweigh.
LEAN = (0.4, 2.0, 2.0, 2.0, 0.7, 1.0)
GATES = 32
#: Parts into which tables are cut where they are summed.
PARTS = 64
#: Words on which a task takes its steps, about; every training word is stepped on, and the tasks' weights are averaged.
FIT_WORDS = 40_000
HELD_OUT, FOLDS = 2, 7
_U = np.uint64
END = b""


def is_held_out(doc_ids) -> np.ndarray:
    """Whether the CRC-32 of the id as text leaves the remainder that is kept out of training, as a null id is too."""
    return np.fromiter((d is None or zlib.crc32(str(d).encode()) % FOLDS == HELD_OUT for d in doc_ids.to_pylist()), bool, len(doc_ids))


class Spelled:
    """Bytes of many words side by side: one row per byte, with the contexts its bits are predicted from."""

    def __init__(self, words: list[bytes]):
        spelled = [w + b" " if w else b"\n" for w in words]
        self.lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.data = np.frombuffer(b"".join(spelled), np.uint8)
        self.word = np.repeat(np.arange(len(words)), self.lengths)
        begin = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(len(self.data)) - np.repeat(begin, self.lengths)
        self.contexts = {order: self._context(order) for order in {o for o, _ in CONTEXTS}}

    def first_sights(self, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(bytes up to which the word just before is not the same, for every byte the place among them of its equal).

        All contexts of a byte are what its word says so far, so where words begin alike it is judged once; in sorted words such
        words stand together. ``apart``: words that share nothing with the one before, as their kind differs.
        """
        n = len(self.data)
        begin = np.arange(n) - self.place
        before = np.cumsum(self.lengths) - self.lengths
        there = np.r_[0, before[:-1]][self.word] + self.place  # the byte at the same place in the word before
        inside = self.place < np.where(np.zeros(len(self.lengths), bool) if apart is None else apart, 0, np.r_[0, self.lengths[:-1]])[self.word]
        differ = np.cumsum(~inside | (self.data[np.where(inside, there, 0)] != self.data))
        new = differ > np.r_[0, differ][begin]
        order = np.argsort(self.place, kind="stable")  # the words' bytes at one place follow each other
        leader = order[np.maximum.accumulate(np.where(new[order], np.arange(n), 0))]
        place, own = np.empty(n, np.int64), np.flatnonzero(new)
        place[order] = (np.cumsum(new) - 1)[leader]
        return own, place

    def _context(self, order: int) -> np.ndarray:
        n = len(self.data)
        if order:
            value = np.zeros(n, _U)
            for back in range(1, order + 1):
                there = np.flatnonzero(self.place >= back)
                value[there] += (self.data[there - back].astype(_U) + _U(1)) << _U(9 * (back - 1))
            return mix(value + _U(order << 58))
        step = (self.data.astype(_U) + _U(1)) * np.cumprod(np.full(n, 0x9E3779B97F4A7C15, _U))
        total = np.r_[_U(0), np.cumsum(step)]
        first = np.arange(n) - self.place
        back = np.cumprod(np.full(n, pow(0x9E3779B97F4A7C15, -1, 1 << 64), _U))
        return mix((total[:-1] - total[first]) * back[first] + _U(77))

    def nodes(self, kinds: np.ndarray | int, which: np.ndarray | slice = slice(None)):
        """For each bit of all or ``which`` bytes: the bit, and each context's slot. ``kinds``: the kind of text that each byte's word stands in."""
        data, contexts = self.data[which], {order: c[which] for order, c in self.contexts.items()}
        bits = np.unpackbits(data[:, None], axis=1)
        node = np.ones(len(data), np.int64)
        kind = _kind(kinds)
        for k in range(8):
            turn = node.astype(_U) * _U(0xD6E8FEB86659FD93)
            plain = {order: c + turn for order, c in contexts.items()}
            yield bits[:, k], [_slots(plain[order] ^ kind if own else plain[order]) for order, own in CONTEXTS]
            node = 2 * node + bits[:, k]

    def shared_nodes(self, kinds: int, which: np.ndarray):
        """As ``nodes``, for several kinds at once: the bit, the slots of the contexts that hold for every kind, and those of each kind."""
        data, contexts = self.data[which], {order: c[which] for order, c in self.contexts.items()}
        bits = np.unpackbits(data[:, None], axis=1)
        node = np.ones(len(data), np.int64)
        for k in range(8):
            turn = node.astype(_U) * _U(0xD6E8FEB86659FD93)
            plain = {order: c + turn for order, c in contexts.items()}
            yield (bits[:, k], [_slots(plain[order]) for order, own in CONTEXTS if not own],
                   [_slots(plain[CONTEXTS[-1][0]] ^ _kind(kind)) for kind in range(kinds)])
            node = 2 * node + bits[:, k]


def _kind(kinds: np.ndarray | int) -> np.ndarray:
    return np.asarray(kinds + 1).astype(_U) * _U(0xA0761D6478BD642F)


def _slots(context: np.ndarray) -> np.ndarray:
    return (mix(context) >> _U(64 - SLOT_BITS)).astype(np.int64)


def _level(seen: np.ndarray) -> np.ndarray:
    """A third of log2(1 + seen), 3 at most."""
    return (seen >= 7).astype(np.int64) + (seen >= 63) + (seen >= 511)


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


class Mixer:
    """Counts per context, weights per gate, and the refining table per gate and stretched probability."""

    STEPS = 33

    def __init__(self, counts: np.ndarray):
        """``counts``: (contexts, slots, 2), how often each decision was 0 and 1 in training."""
        self.counts = counts
        self.weights = np.zeros((GATES, len(CONTEXTS)))
        self.weights[:, -1] = 1
        self.refined = np.tile(squash((np.arange(self.STEPS) - 16) / 1.5), (GATES, 1))
        self.sights = np.zeros((GATES, self.STEPS))  # weight of the decisions learnt from, where they met the refining table

    def __getstate__(self) -> dict:
        """Counters travel compressed: most are zero or small."""
        return self.__dict__ | {"counts": (zstandard.compress(np.ascontiguousarray(self.counts).view(np.uint8).data), self.counts.shape, self.counts.dtype.str)}

    def __setstate__(self, state: dict) -> None:
        packed, shape, kind = state["counts"]
        self.__dict__.update(state, counts=np.frombuffer(zstandard.decompress(packed), kind).reshape(shape))

    def _lean(self, context: int, slots: np.ndarray, p: np.ndarray, known: np.ndarray | None):
        """(probability by a context that leans on ``p`` as far as its own counts are few, those counts)."""
        both = self.counts[context].take(slots, axis=0).astype(float)
        zeros, ones = both[:, 0], both[:, 1]
        if known is not None:
            ones, zeros = np.maximum(0, ones - known), np.maximum(0, zeros - (1 - known))
        seen = ones + zeros
        return (ones + LEAN[context] * p) / (seen + LEAN[context]), seen

    def common(self, slots: list[np.ndarray], known: np.ndarray | None = None):
        """What the contexts say that hold for every kind of text: (stretched columns, last probability, last counts).
        ``known``, if given, is each decision's own bit: one sight of it is taken out, as the words the weights are fitted
        on stand in the tables themselves."""
        columns, p, seen = [], 0.5, None
        for context in range(len(CONTEXTS) - 1):
            p, seen = self._lean(context, slots[context], p, known)
            columns.append(stretch(np.clip(p, 1e-7, 1 - 1e-7)))
        return columns, p, seen

    def inputs(self, common, slots: np.ndarray, place: np.ndarray, known: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """(stretched columns, gate), which follow from the counts alone."""
        columns, p, seen = common
        p, own = self._lean(len(CONTEXTS) - 1, slots, p, known)
        return [*columns, stretch(np.clip(p, 1e-7, 1 - 1e-7))], (_level(own) * 4 + _level(seen)) * 2 + (place > 3)

    def mixed(self, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """Stretched probability before refining."""
        return sum(weights.take(gate) * column for weights, column in zip(np.ascontiguousarray(self.weights.T), inputs))

    def _step(self, mixed: np.ndarray):
        """(lower step of the refining table, how far it is to the next)."""
        at = np.clip(mixed * 1.5 + 16, 0, self.STEPS - 1.001)
        low = at.astype(np.int64)
        return low, at - low

    def predict(self, common, slots: np.ndarray, place: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """Probability of 1."""
        inputs, gate = self.inputs(common, slots, place, known)
        mixed = self.mixed(inputs, gate)
        low, part = self._step(mixed)
        flat, at = self.refined.reshape(-1), gate * self.STEPS + low
        fine = flat.take(at) * (1 - part) + flat.take(at + 1) * part
        inside = (low > 0) & (low < self.STEPS - 2)  # beyond the table's ends the mixer alone speaks
        raw = squash(mixed)
        return np.clip(np.where(inside, 0.5 * raw + 0.5 * fine, raw), 1e-7, 1 - 1e-7)

    def learn(self, words: list[bytes], kinds: np.ndarray, counts: np.ndarray, rate: float) -> None:
        """Online steps over words in the order given, a few thousand decisions at a time."""
        # inputs need no weights: they are made in sorted words, once for what begins alike, and dealt to the order given
        order = sorted(range(len(words)), key=lambda i: (kinds[i], words[i]))
        held, kinds = Spelled([words[i] for i in order]), kinds[order]
        which, at = held.first_sights(np.r_[True, np.diff(kinds) != 0])
        begin, length, rank = np.cumsum(held.lengths) - held.lengths, held.lengths, np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        own = gathered(np.arange(len(held.data)), begin[rank], length[rank])
        at, weight = at[own], np.repeat(counts, length[rank]).astype(float)
        place = held.place[which]
        for bits, slots in held.nodes(kinds[held.word[which]], which):
            known = bits.astype(np.int64)
            columns, gates = self.inputs(self.common(slots, known), slots[-1], place, known)
            for start in range(0, len(at), 4096):
                some = slice(start, start + 4096)
                mine = at[some]
                b, gate, inputs = known.take(mine), gates.take(mine), [c.take(mine) for c in columns]
                mixed = self.mixed(inputs, gate)
                low, part = self._step(mixed)
                step = gate * self.STEPS + low + (part >= 0.5)
                w = weight[some]
                error = (b - squash(mixed)) * w
                total = np.bincount(gate, w, GATES) + 20
                for column, told in enumerate(inputs):
                    self.weights[:, column] += rate * np.bincount(gate, error * told, GATES) / total
                self.sights += np.bincount(step, w, self.sights.size).reshape(self.sights.shape)
                self.refined += np.bincount(step, (b - self.refined.take(step)) * np.minimum(0.02, 0.002 * w), self.refined.size).reshape(self.refined.shape)

    def log10(self, words: list[bytes], kinds: int) -> np.ndarray:
        """(words, kinds): log10 probability of each word's spelling in texts of each kind. What neighbours in ``words`` begin with alike is
        judged once, so sorted words cost least."""
        held = Spelled(words)
        which, at = held.first_sights()
        place, chance = held.place[which], np.ones((kinds, len(which)))
        for bit, slots, own in held.shared_nodes(kinds, which):
            common = self.common(slots)
            for kind in range(kinds):
                p = self.predict(common, own[kind], place)
                chance[kind] *= np.where(bit == 1, p, 1 - p)  # eight of 1e-7 at least
        return np.stack([np.bincount(held.word, c[at], len(words)) for c in np.log10(chance)], axis=1)


def _lower_words(texts: pa.Array) -> list[list[bytes]]:
    return [text.lower().split() for text in texts.to_pylist()]


def _block_words(docs: pa.Table) -> pa.Table:
    """(block, word, n): the block's words, the empty word being the end, and how often training documents hold them."""
    counts: Counter = Counter()
    for part, texts in slices(docs):
        for words, aside in zip(_lower_words(texts), is_held_out(part.column("doc_id")).tolist()):
            if aside:
                for word in (END, *words):  # a set's difference with a Counter would go through the whole Counter
                    counts.setdefault(word, 0)
            else:
                counts.update(words)
                counts[END] += 1
    block = docs.column("block")[0].as_py()
    return pa.table([pa.array([block] * len(counts), pa.int32()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                    names=["block", "word", "n"])


def _batch_words(kinds: int):
    """(word, n_0, n_1, ...) of the training documents of each batch, by the kind of the text."""
    def run(batches):
        for batch in batches:
            counts = [Counter() for _ in range(kinds)]
            for part, texts in slices(batch):
                kind = part.column("kind").to_pylist()
                for i, (words, aside) in enumerate(zip(_lower_words(texts), is_held_out(part.column("doc_id")).tolist())):
                    if not aside:
                        counts[kind[i]].update(words)
                        counts[kind[i]][END] += 1
            words = list(dict.fromkeys(w for c in counts for w in c))
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), *[pa.array([c[w] for w in words], pa.int64()) for c in counts]],
                names=["word", *_columns(kinds)])

    return run


def _columns(kinds: int) -> list[str]:
    return [f"n_{k}" for k in range(kinds)]


def _table_parts(kinds: int):
    """Sums of the decisions of a partition's words, in ``PARTS`` runs of counters."""
    def run(batches):
        tables = np.zeros((len(CONTEXTS), 2 << SLOT_BITS))
        for batch in batches:
            counts = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in _columns(kinds)])
            words = batch.column("word").to_pylist()
            for kind in range(kinds):
                mine = sorted(np.flatnonzero(counts[kind]).tolist(), key=words.__getitem__)
                held = Spelled([words[i] for i in mine])
                which, at = held.first_sights()
                weight = np.bincount(at, counts[kind][mine][held.word], len(which))
                for bit, slots in held.nodes(kind, which):
                    for context in range(len(CONTEXTS)):
                        np.add.at(tables[context], 2 * slots[context] + bit, weight)
        rows = [(part, sums.astype("<f4").tobytes()) for part, sums in enumerate(np.split(tables.reshape(-1), PARTS))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(s.as_py(), "<f4").astype(float) for s in table.column("sums"))
    return pa.table([table.column("part").slice(0, 1), pa.array([total.astype("<f4").tobytes()], pa.binary())], names=["part", "sums"])


def _steps(fitted, weights: np.ndarray, refined: np.ndarray, kinds: int, rate: float):
    """One row: where online steps over a partition's words lead from the given weights, and what each part of them saw."""
    def run(batches):
        mixer, waiting = Mixer(fitted.value.counts), []
        mixer.weights, mixer.refined = weights.copy(), refined.copy()

        def learn(some) -> None:
            words, kind, n = zip(*some)
            mixer.learn(list(words), np.array(kind), np.array(n, float), rate)

        for batch in batches:
            numbers = [batch.column(c).to_pylist() for c in _columns(kinds)]
            for i, word in enumerate(batch.column("word").to_pylist()):
                waiting += [(word, kind, n[i]) for kind, n in enumerate(numbers) if n[i]]
                while len(waiting) >= 5_000:
                    learn(waiting[:5_000])
                    del waiting[:5_000]
        if waiting:
            learn(waiting)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (mixer.weights, mixer.refined, mixer.sights)],
                                         names=["weights", "refined", "sights"])

    return run


def _averaged(parts: np.ndarray, sights: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The parts' numbers, each counting as much as it saw; those that no part saw stay."""
    total = sights.sum(axis=0)
    return np.where(total > 0, (parts * sights).sum(axis=0) / np.maximum(total, 1e-300), before)


def train(vocabulary: DataFrame, kinds: int) -> Mixer:
    """A mixer from (word, n_0, n_1, ...) of all training words: tables and weights over all of them.

    The weights take two rounds. In each, tasks step over their words from the same weights, and the average of where they
    came to, by what they saw, is the next round's start. Up to ``FIT_WORDS`` words are one task's: plain online steps.
    """
    # tables have a fixed size; their sums are added part by part, not in one place
    few = vocabulary.coalesce(max(6, blocks.shuffle_partitions(vocabulary) // 8))
    sums = few.mapInArrow(_table_parts(kinds), "part int, sums binary").groupBy("part").applyInArrow(_added, "part int, sums binary")
    parts = {r.part: np.frombuffer(bytes(r.sums), "<f4") for r in sums.collect()}
    size = (len(CONTEXTS) << SLOT_BITS) * 2 // PARTS
    flat = np.concatenate([parts.get(p, np.zeros(size, np.float32)) for p in range(PARTS)])
    mixer = Mixer(flat.reshape(len(CONTEXTS), 1 << SLOT_BITS, 2))
    fitted = vocabulary.sparkSession.sparkContext.broadcast(mixer)
    tasks = -(-max(1, vocabulary.count()) // FIT_WORDS)
    dealt = durable(vocabulary.repartition(tasks, "word").sortWithinPartitions(F.xxhash64(F.lit(1), "word")))
    for rate in (0.02, 0.005):
        run = _steps(fitted, mixer.weights, mixer.refined, kinds, rate)
        # a row of 20 KB for each task
        rows = dealt.mapInArrow(run, "weights binary, refined binary, sights binary").collect()
        if not rows:  # no training words
            break
        weights, refined, sights = (np.stack([np.frombuffer(bytes(r[c]), float).reshape(GATES, -1) for r in rows]) for c in range(3))
        mixer.weights = _averaged(weights, sights.sum(axis=2, keepdims=True), mixer.weights)
        mixer.refined = _averaged(refined, sights, mixer.refined)
    return mixer


def _known(mixer: Mixer, kinds: int):
    """Add each word's log10 probabilities; equal words stand together and are spelled once."""
    def run(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            distinct = list(dict.fromkeys(words))
            place = {w: i for i, w in enumerate(distinct)}
            score = mixer.log10(distinct, kinds).astype("<f4") if distinct else np.zeros((0, kinds), "<f4")
            rows = [s.tobytes() for s in score]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([rows[place[w]] for w in words], pa.binary())],
                                             names=["block", "word", "count", "log10"])

    return run


def _log10_of_sequence(of: np.ndarray, log10: np.ndarray, prior: np.ndarray) -> float:
    """log10 probability of a text's tokens, given each token's number and (tokens, kinds) model scores.

    The kind of the text is inferred online: each kind weighs as much as it explains the tokens so far, from its share of
    the training tokens on. A cache, which says how often the token came before in this text, is mixed in with half the
    posterior of "half cache, half model" against "model alone", judged by every token so far.
    """
    n = len(of)
    log10 = np.ascontiguousarray(log10.T)  # a row for each kind
    start = np.log(prior)[:, None]
    weight = np.hstack([start, (np.cumsum(log10, axis=1) * np.log(10) + start)[:, :-1]])
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    best = log10.max(axis=0)
    log_model = best + np.log10((weight * np.exp((log10 - best) * np.log(10))).sum(axis=0) + 1e-300)
    order = np.argsort(of, kind="stable")
    new = np.r_[True, of[order][1:] != of[order][:-1]]
    run = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    before = np.empty(n)
    before[order] = run
    cache = before / np.maximum(1, np.arange(n))
    model = np.exp(np.maximum(log_model, -300) * np.log(10))
    gain = np.log(0.5 + 0.5 * cache / model)
    share = 0.5 * squash(np.r_[0.0, np.cumsum(gain)[:-1]] - 2)
    mixed = np.log10(share * cache + (1 - share) * model)
    return float(np.where(log_model > -300, mixed, log_model).sum())


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base_log10 double, score double"


def _scored(total: int, distinct: int, prior: np.ndarray):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        place = {w: i for i, w in enumerate(known.column("word").to_pylist())}
        count = known.column("count").to_numpy()
        log10 = np.frombuffer(b"".join(known.column("log10").to_pylist()), "<f4").reshape(len(count), len(prior)).astype(float)
        base = np.log10((count + 1.0) / (total + distinct + 1))
        rows = []
        for part, texts in slices(docs):
            doc_ids = part.column("doc_id").to_pylist()
            size = [len(t) for t in texts.to_pylist()]
            for doc, aside, words, n_bytes in zip(doc_ids, is_held_out(part.column("doc_id")).tolist(), _lower_words(texts), size):
                of = np.fromiter(map(place.__getitem__, [*words, END]), np.int64, len(words) + 1)
                rows.append((doc, aside, len(of), int((count[of] > 0).sum()), n_bytes, float(base[of].sum()), _log10_of_sequence(of, log10[of], prior)))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        names = [c.split()[0] for c in _SCORES.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

    return run


def _kinds(docs: DataFrame, column: str) -> list[str]:
    """The values of the column that tells kinds of text, commonest first; texts without one count as the first."""
    if column not in docs.columns:
        return []
    rows = docs.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
    return [r.v for r in rows.orderBy(F.desc("n"), "v").collect()]


def score_texts(docs: DataFrame, kind: str = "lang") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row of ``docs``.

    Tokens are lower-case (A-Z) words and one end. ``base_score`` adds log10((c + 1) / (N + V + 1)) of the training counts;
    ``score`` is the log10 probability of the tokens under the mixed model, and ``bits_per_byte`` its total bits over the
    bytes of the text (null for an empty one). Null counts as empty; a row without an id is held out. Repeated rows train
    repeatedly. An empty table gives no rows. ``kind`` names a column that tells kinds of training texts apart, if there is
    one; a text that is scored has its kind inferred from its words alone.
    """
    values = _kinds(docs, kind)
    kinds = max(1, len(values))
    which = F.lit(0)
    if values:
        numbers = F.create_map(*[F.lit(x) for number, value in enumerate(values) for x in (value, number)])
        which = F.coalesce(F.try_element_at(numbers, F.col(kind).cast("string")), which)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), which.alias("kind"))
    columns = _columns(kinds)
    vocabulary = durable(slim.mapInArrow(_batch_words(kinds), "word binary, " + ", ".join(f"{c} long" for c in columns))
                         .groupBy("word").agg(*[F.sum(c).alias(c) for c in columns]))
    shares = vocabulary.agg(F.count("*").alias("distinct"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]).first()
    total, distinct = sum(shares[c] for c in columns), shares["distinct"]
    prior = np.array([shares[c] + 1.0 for c in columns]) / (total + kinds)
    mixer = train(vocabulary, kinds)
    texts = blocks.dealt(docs, per_partition=0.5)
    mine = texts.groupBy("block").applyInArrow(_block_words, "block int, word binary, n long")
    counted = mine.select("block", "word", F.sum("n").over(Window.partitionBy("word")).alias("count"))
    known = counted.mapInArrow(_known(mixer, kinds), "block int, word binary, count long, log10 binary")
    scored = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_scored(total, distinct, prior), _SCORES)
    bits = -F.col("score") / float(np.log10(2)) / F.when(F.col("n_bytes") > 0, F.col("n_bytes"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                         F.col("base_log10").alias("base_score"), "score", bits.alias("bits_per_byte"))
