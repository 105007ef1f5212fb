"""Brown class model: words dealt into classes by exchange, texts scored by class transitions and word emissions.

Model. p(word | previous) = p(class | previous class) * p(word | class). Transitions are interpolated with the classes' own
frequencies; a word's emission is its share of its class. A token of END closes every text and stands before the first word of one.
Words never seen in training share the class UNKNOWN: its transitions are those of the words seen once, counted a second time, and its
probability is dealt evenly to the number of unseen words that the counts of words seen once and twice suggest (Chao). So the
probabilities of all words, known, unknown and END, sum to one after every class.

Training
  1. Every training text's words are counted, by 64-bit hash. The HEAD most frequent words get a rank that tasks look up in memory.
  2. One scan writes each text as ranks, two bytes a word, with the hashes of the other words beside it; later steps read this table.
  3. Exchange. A round adds up, for half of the ranked words, the classes before and after them; every word is then offered the class
     that raises the likelihood of the class bigrams most, by exact differences against the counts at the start of the round. Moves
     made together may harm each other: the bigrams are counted again, and if the likelihood fell, half of the moves are taken back, and
     so on, so it never falls. Tasks emit sparse blocks of 512 words, blocks are summed while they stream past, and only ranks, classes
     and gains come to the driver.
  4. All other words are exchanged once, by the classes around their occurrences, shuffled by word. No word is left out.
Scoring. Sums over ranked words need no shuffle. Occurrences of other words meet their word's class and count in a join (no such word
is frequent) and their neighbours in a window over the text, and come back as a sum per text.

Counts grow with the corpus; what a task or the driver holds does not: HEAD words times classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acreage.llm import text as X
from acreage.session import cut

#: Classes of words. END and OTHER (words without a rank while classes are exchanged; unknown words when texts are scored) come after.
CLASSES = 48
END, OTHER = CLASSES, CLASSES + 1
UNKNOWN = OTHER
GROUPS = CLASSES + 2
#: Ranked words; two bytes hold a rank, END_RANK or OTHER_RANK.
HEAD = 65_534
END_RANK, OTHER_RANK = 65_534, 65_535
ROUNDS = 6
#: Times that half of a round's moves are taken back before the round is given up.
HALVINGS = 6
BLOCK = 512
#: Weight of the classes' own frequencies in a transition.
SMOOTH = 20.0
#: Tokens a task counts at once.
TOKENS = 1 << 20


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_keys(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys of the words, words of each text) for runs of texts, in order."""
    for _, _, blob, starts, ends in X.blobs(X.encoded(texts, lower=True)):
        begins, stops = X.words(blob)
        keys = X.span_hashes(X.prefix_sums(blob), begins, stops).view(np.int64)
        yield keys, np.searchsorted(begins, ends) - np.searchsorted(begins, starts)


def word_counts(texts: DataFrame) -> DataFrame:
    """(key, n) of a column of texts; tasks count first."""

    def summed(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(parts) if parts else np.empty(0, np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for batch in X.pieces(batches, 0):
            for keys, _ in word_keys(batch.column(0).to_pylist()):
                parts.append(keys)
                if sum(map(len, parts)) > TOKENS:
                    yield summed(parts)
                    parts = []
        yield summed(parts)

    return texts.mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Head:
    """The ranked words: keys and counts by rank, and the ranks in order of the keys."""

    keys: np.ndarray
    counts: np.ndarray

    def __post_init__(self):
        self.order = np.argsort(self.keys, kind="stable").astype(np.int64)
        self.sorted = self.keys[self.order]

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), OTHER_RANK, np.uint16)
        at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
        return np.where(self.sorted[at] == keys, self.order[at], OTHER_RANK).astype(np.uint16)


def coded_texts(docs: DataFrame, head: Head) -> DataFrame:
    """doc_id, held_out, learn, ranks (two bytes a word), others (keys of the words without a rank, eight bytes each), row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.pieces(batches, 3):
            ranks, others = [], []
            for keys, sizes in word_keys(batch.column(3).to_pylist()):
                found = head.ranks(keys)
                at = 0
                for n in sizes.tolist():
                    own = found[at : at + n]
                    ranks.append(own.tobytes())
                    others.append(keys[at : at + n][own == OTHER_RANK].tobytes())
                    at += n
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ranks, pa.binary()), pa.array(others, pa.binary())], names=["doc_id", "held_out", "learn", "ranks", "others"])

    out = docs.select("doc_id", "held_out", "learn", "text").mapInArrow(work, "doc_id long, held_out boolean, learn boolean, ranks binary, others binary")
    return out.withColumn("row", F.monotonically_increasing_id())


def sequences(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, ranks of all its texts, place of the END after each text); an END stands before the first text too."""
    for batch in X.pieces(batches, column, 2 * TOKENS):
        texts = [t.as_buffer() for t in batch.column(column)]
        sizes = np.fromiter((t.size // 2 for t in texts), np.int64, len(texts))
        closes = np.cumsum(sizes + 1)
        line = np.full(int(closes[-1]) + 1 if len(closes) else 1, END_RANK, np.uint16)
        for text, size, close in zip(texts, sizes, closes):
            line[close - size : close] = np.frombuffer(text, np.uint16)
        yield batch, line, closes


def pair_counts(coded: DataFrame, table: np.ndarray, width: int, skip: int | None = None) -> np.ndarray:
    """Neighbouring tokens by the group that ``table`` gives their ranks, as a matrix; pairs with the group ``skip`` are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, np.int64)
        for _, line, _ in sequences(batches, 0):
            g = table[line].astype(np.int64)
            a, b = g[:-1], g[1:]
            if skip is not None:
                both = (a != skip) & (b != skip)
                a, b = a[both], b[both]
            total += np.bincount(a * width + b, minlength=width * width)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    rows = coded.select("ranks").mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    return _matrix(rows, width)


def _matrix(rows: pa.Table, width: int) -> np.ndarray:
    out = np.zeros(width * width, np.int64)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(width, width)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(pairs: np.ndarray, own: np.ndarray, count: np.ndarray, same: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Likelihood of the class bigrams after each word's move to each class, less that without the word; a row per word.

    ``pairs``: class bigrams. Per word: ``own`` class, ``count``, ``same`` (times it follows itself), and how often each class stands
    ``before`` and ``after`` it, itself among them.
    """
    words, every = np.arange(len(own)), slice(0, CLASSES)
    left, right = before.copy(), after.copy()
    left[words, own] -= same
    right[words, own] -= same
    out = np.zeros((len(own), CLASSES))
    middle = np.diagonal(pairs)[every]
    for counts, other, cells in ((left, right, pairs), (right, left, pairs.T)):  # cells[c, h]: class c beside the class h that the word moves to
        base = _xlogx(cells[:, every])
        word, group = np.nonzero(counts)
        for at in range(0, len(word), 1 << 14):
            w, c = word[at : at + (1 << 14)], group[at : at + (1 << 14)]
            first = np.flatnonzero(np.diff(w, prepend=-1))
            out[w[first]] += np.add.reduceat(_xlogx(cells[c, every] + counts[w, c][:, None]) - base[c], first, axis=0)
        # the cell beside the word's own class has lost the word's other side, and the diagonal cell is counted once, below
        full, mine, lost = cells[own, every], counts[words, own][:, None], other[:, every]
        out += _xlogx(full - lost + mine) - _xlogx(full - lost) - _xlogx(full + mine) + _xlogx(full)
        out -= _xlogx(middle + counts[:, every]) - _xlogx(middle)
    out += _xlogx(middle + left[:, every] + right[:, every] + same[:, None]) - _xlogx(middle)
    totals = pairs.sum(axis=1), pairs.sum(axis=0)
    for total in totals:
        out -= _xlogx(total[every] + count[:, None]) - _xlogx(total[every])
    stay = np.flatnonzero(own < CLASSES)
    if len(stay):  # where a word is already, the counts without it are lower
        g, at = own[stay], np.arange(len(stay))
        value = np.zeros(len(stay))
        for counts, cells in ((left, pairs), (right, pairs.T)):
            beside = cells[:, g].T
            part = _xlogx(beside) - _xlogx(beside - counts[stay])
            part[at, g] = 0
            value += part.sum(axis=1)
        value += _xlogx(pairs[g, g]) - _xlogx(pairs[g, g] - left[stay, g] - right[stay, g] - same[stay])
        for total in totals:
            value -= _xlogx(total[g]) - _xlogx(total[g] - count[stay])
        out[stay, g] = value
    return out


def chosen(value: np.ndarray) -> np.ndarray:
    """The best class of each row; classes within a millionth are alike and the lower one stands, whatever the order of the sums."""
    return np.round(value, 6).argmax(axis=1)


def best_moves(coded: DataFrame, head: Head, classes: np.ndarray, pairs: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, classes) of the words in ``wanted`` that a move raises the likelihood for, largest gain first."""
    width = 2 * GROUPS + 1  # classes after, classes before, itself after itself
    slot = np.full(1 << 16, -1, np.int64)
    slot[wanted] = np.arange(len(wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted) * width, np.int32)
        for _, line, _ in sequences(batches, 0):
            for at in range(0, len(line) - 1, TOKENS):
                some = line[at : at + TOKENS + 1]
                place, group = slot[some] * width, classes[some].astype(np.int64)
                a, b = place[:-1], place[1:]
                again = (a >= 0) & (some[:-1] == some[1:])
                cells = np.concatenate((a[a >= 0] + group[1:][a >= 0], b[b >= 0] + GROUPS + group[:-1][b >= 0], a[again] + 2 * GROUPS))
                total += np.bincount(cells, minlength=len(total)).astype(np.int32)
        found = np.flatnonzero(total)
        blocks, at = np.unique(found // (BLOCK * width), return_index=True)
        parts = [(found[i:j] - block * BLOCK * width, total[found[i:j]]) for block, i, j in zip(blocks, at, [*at[1:], len(found)])]
        payload = [x.astype(np.uint32).tobytes() + n.astype(np.uint32).tobytes() for x, n in parts]
        yield pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), pa.array(payload, pa.binary())], names=["block", "cells"])

    def best(block: int, total: np.ndarray) -> pa.RecordBatch:
        ranks = wanted[block * BLOCK : (block + 1) * BLOCK]
        rows = total.reshape(BLOCK, width)[: len(ranks)]
        value = gains(pairs, classes[ranks].astype(np.int64), head.counts[ranks], rows[:, -1], rows[:, GROUPS : 2 * GROUPS], rows[:, :GROUPS])
        new, at = chosen(value), np.arange(len(ranks))
        gain = np.round(value[at, new] - value[at, classes[ranks]], 6)
        moving = new != classes[ranks]
        return pa.RecordBatch.from_arrays([pa.array(c[moving]) for c in (ranks, new, gain)], names=["rank", "class", "gain"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, np.zeros(BLOCK * width, np.int64)
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                if current is not None and block != current:
                    yield best(current, total)
                    total[:] = 0
                current = block
                at, n = np.frombuffer(cells.as_buffer(), np.uint32).reshape(2, -1)
                total[at] += n
        if current is not None:
            yield best(current, total)

    counted = coded.select("ranks").mapInArrow(count, "block int, cells binary")
    moved = counted.repartition("block").sortWithinPartitions("block").mapInArrow(move, "rank long, class long, gain double").toArrow()
    ranks, new, gain = (moved.column(c).to_numpy() for c in ("rank", "class", "gain"))
    order = np.lexsort((ranks, -gain))
    return ranks[order], new[order]


def likelihood(pairs: np.ndarray) -> float:
    """The part of the log likelihood of class bigrams that classes change."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(axis=0)).sum() - _xlogx(pairs.sum(axis=1)).sum())


def head_classes(coded: DataFrame, head: Head, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The class of every rank after exchange, and the class bigrams; END and the words without a rank keep groups of their own."""
    classes = np.full(1 << 16, OTHER, np.uint8)
    classes[END_RANK] = END
    ranks = np.arange(len(head.keys))
    classes[ranks] = ranks % CLASSES
    pairs = pair_counts(coded, classes, GROUPS)
    for turn in range(rounds):
        wanted = ranks[(ranks // CLASSES + turn) % 2 == 0]
        blocks = max(1, -(-len(wanted) // BLOCK))
        wanted = np.concatenate([wanted[b::blocks] for b in range(blocks)])  # frequent words are dealt over all blocks
        if not len(wanted):
            continue
        moving, new = best_moves(coded, head, classes, pairs, wanted)
        for _ in range(HALVINGS):
            if not len(moving):
                break
            tried = classes.copy()
            tried[moving] = new
            counted = pair_counts(coded, tried, GROUPS)
            if likelihood(counted) > likelihood(pairs):
                classes, pairs = tried, counted
                break
            moving, new = moving[::2], new[::2]
    return classes, pairs


def occurrences(coded: DataFrame, state: np.ndarray) -> DataFrame:
    """row, learn, pos, key, left, right: a row per word without a rank; left and right are its neighbours' states, OTHER for such words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, line, closes in sequences(batches, 2):
            at = np.flatnonzero(line == OTHER_RANK)
            text = np.searchsorted(closes, at)
            keys = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64)
            row, learn = (batch.column(i).to_numpy(zero_copy_only=False)[text] for i in (0, 1))
            columns = [row, learn, at.astype(np.int64) - np.append(0, closes)[text], keys, state[line[at - 1]].astype(np.int16), state[line[np.minimum(at + 1, len(line) - 1)]].astype(np.int16)]
            for i in range(0, len(at), TOKENS):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + TOKENS]) for c in columns], names=["row", "learn", "pos", "key", "left", "right"])

    return coded.select("row", "learn", "ranks", "others").mapInArrow(work, "row long, learn boolean, pos long, key long, left short, right short")


def other_classes(found: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(key, n, class) of the words without a rank in the training texts, each exchanged once; a word's counts add up while its rows stream past."""

    def best(keys: np.ndarray, around: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        left, right = np.zeros((2, len(first), GROUPS), np.int64)
        np.add.at(left, (word, around // GROUPS), n)
        np.add.at(right, (word, around % GROUPS), n)
        total, none = left.sum(axis=1), np.zeros(len(first), np.int64)
        value = gains(pairs, np.full(len(first), OTHER), total, none, left, right)
        return pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(total), pa.array(chosen(value).astype(np.int16))], names=["key", "n", "class"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, around, n = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            around = np.concatenate((around, batch.column(1).to_numpy().astype(np.int64)))
            n = np.concatenate((n, np.ones(batch.num_rows, np.int64)))
            last = int(np.searchsorted(keys == keys[-1], True)) if len(keys) else 0
            yield best(keys[:last], around[:last], n[:last])
            kinds, at = np.unique(around[last:], return_inverse=True)  # the open word: at most a row per pair of classes
            keys, around, n = np.full(len(kinds), keys[-1] if len(keys) else 0), kinds, np.bincount(at, n[last:]).astype(np.int64)
        yield best(keys, around, n)

    around = F.pmod(F.col("left"), F.lit(GROUPS)) * GROUPS + F.pmod(F.col("right"), F.lit(GROUPS))
    rows = found.filter("learn").select("key", around.cast("short").alias("around")).repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(work, "key long, n long, class short")


@dataclass
class Model:
    """What scoring needs: by rank the class, log10 emission and log10(count + 1); log10 transitions; log10 of an unknown word's share."""

    classes: np.ndarray
    emission: np.ndarray
    base: np.ndarray
    transition: np.ndarray
    mass: np.ndarray
    unknown: float


def _collapsed(states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class bigrams, and the same with pairs of words seen once counted again for UNKNOWN."""
    s = states.reshape(2, GROUPS, 2, GROUPS)
    plain = s.sum(axis=(0, 2))
    full = plain.copy()
    full[:, UNKNOWN] += s[:, :, 1, :].sum(axis=(0, 2))
    full[UNKNOWN, :] += s[1].sum(axis=(0, 1))
    full[UNKNOWN, UNKNOWN] += s[1, :, 1, :].sum()
    return plain, full


def transitions(full: np.ndarray) -> np.ndarray:
    """log10 of the interpolated transition probabilities; a row per class sums to one."""
    share = (full.sum(axis=0) + 1.0) / (full.sum() + GROUPS)
    return np.log10((full + SMOOTH * share) / (full.sum(axis=1, keepdims=True) + SMOOTH))


def _line_sums(coded: DataFrame, model: Model) -> DataFrame:
    """row, doc_id, held_out, n_tokens, n_known, base, score of the ranked words and END."""
    known = np.ones(1 << 16, np.int64)
    known[OTHER_RANK] = 0
    known[END_RANK] = model.base[END_RANK] > 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, line, closes in sequences(batches, 3):
            starts, group = np.append(0, closes)[:-1], model.classes[line]
            a, b = group[:-1], group[1:]
            value = np.where((a == OTHER) | (b == OTHER), 0.0, model.transition[a, b]) + model.emission[line[1:]]
            sums = [np.add.reduceat(x, starts) if len(starts) else np.empty(0, x.dtype) for x in (known[line[1:]], model.base[line[1:]], value)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(closes - starts), *map(pa.array, sums)], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    return coded.select("row", "doc_id", "held_out", "ranks").mapInArrow(work, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")


def _other_sums(met: DataFrame, model: Model) -> DataFrame:
    """(row, o_known, o_base, o_score): what the words without a rank add to a text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, middle, right = (batch.column(i).to_numpy().astype(np.int64) % GROUPS for i in (1, 2, 3))
            n = batch.column(4).to_numpy()
            value = np.where(left == OTHER, 0.0, model.transition[left, middle]) + model.transition[middle, right]
            value += np.where(n > 0, np.log10(np.maximum(n, 1)) - model.mass[middle], model.unknown)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((n > 0).astype(np.int64)), pa.array(np.log10(n + 1.0)), pa.array(value)], names=["row", "known", "base", "score"])

    rows = met.select("row", F.when(F.col("open"), OTHER).otherwise(F.col("left")).cast("short").alias("left"), "middle", "right", "n").mapInArrow(work, "row long, known long, base double, score double")
    return rows.groupBy(F.col("row").alias("o_row")).agg(F.sum("known").alias("o_known"), F.sum("base").alias("o_base"), F.sum("score").alias("o_score"))


def score_texts(docs: DataFrame, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity: a row per row of ``docs`` (doc_id, text).

    ``head`` bounds the words held in memory (at most HEAD). Cases: null, empty and blank texts are one END; a null doc_id is neither
    held out nor learnt from; repeated rows count as often as they stand and are scored alike; without training texts nothing is
    known and every class is alike; other columns are ignored; an empty table gives an empty table.
    """
    learn = ~F.col("held_out") & F.col("doc_id").isNotNull()
    base = X.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").withColumn("learn", learn)
    counts = cut(word_counts(base.filter("learn").select("text")))
    facts = counts.agg(F.sum("n").alias("words"), F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).first()
    texts = base.filter("learn").count()
    tokens, kinds = (facts["words"] or 0) + texts, facts["kinds"] + (texts > 0)
    top = counts.orderBy(F.desc("n"), "key").limit(min(head, HEAD)).toArrow()
    ranked = Head(top.column("key").to_numpy(), top.column("n").to_numpy())
    coded = cut(coded_texts(base, ranked))
    learnt = coded.filter("learn")

    classes, pairs = head_classes(learnt, ranked, rounds)
    state = classes.copy()
    state[: len(ranked.counts)][ranked.counts == 1] += GROUPS  # words seen once stand for unknown words
    found = occurrences(coded, state)
    others = cut(other_classes(found, pairs))
    middle = F.coalesce(F.col("class") + F.when(F.col("n") == 1, GROUPS).otherwise(0), F.lit(UNKNOWN)).cast("short")
    named = others.select(F.col("key").alias("__key"), "n", "class")
    met = found.join(named, F.col("key") == F.col("__key"), "left").select("row", "learn", "pos", "left", "right", middle.alias("middle"), F.coalesce("n", F.lit(0)).alias("n"))
    follows = F.lead("middle").over(Window.partitionBy("row").orderBy("pos"))
    met = cut(met.withColumn("next", follows).select("row", "learn", (F.col("left") == OTHER).alias("open"), "left", "middle", F.when(F.col("right") == OTHER, F.col("next")).otherwise(F.col("right")).cast("short").alias("right"), "n"))

    width = 2 * GROUPS
    sides = F.array(F.when(~F.col("open"), F.col("left") * width + F.col("middle")), F.col("middle") * width + F.col("right"))
    pair = met.filter("learn").select(F.explode(sides).alias("pair")).filter("pair is not null").groupBy("pair").agg(F.count("*").alias("n")).toArrow()
    plain, full = _collapsed(pair_counts(learnt, state, width, skip=OTHER) + _matrix(pair, width))
    mass = np.log10(np.maximum(plain.sum(axis=0), 1))
    ever = np.zeros(1 << 16)
    ever[: len(ranked.counts)] = ranked.counts
    emission = np.where(ever > 0, np.log10(np.maximum(ever, 1)) - mass[classes], 0.0)
    ever[END_RANK] = texts
    unseen = 1 + facts["once"] * (facts["once"] - 1) / (2 * (facts["twice"] + 1))
    model = Model(classes, emission, np.log10(ever + 1), transitions(full), mass, -float(np.log10(unseen)))

    lines, rest = _line_sums(coded, model), _other_sums(met, model)
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = lines.join(rest, F.col("row") == F.col("o_row"), "left").withColumn("score", F.col("score") + zero("o_score"))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("o_known")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("o_base") - F.col("n_tokens") * float(np.log10(tokens + kinds + 1))).alias("base_score"), "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
