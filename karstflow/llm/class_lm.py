"""Language-model scores by Brown's class-based bigrams.

Every word of the training texts belongs to a class. Words with at least a
stated share of all training tokens are units: exchange clustering moves one
unit at a time to the class in which the class bigrams become most likely,
until no move helps; all tokens that aren't units stand there as one class
more, which doesn't move. Every other word, however rare, is then placed by
the same likelihood: in the class that makes its own neighbours, counted over
the whole corpus, likeliest. A word never seen in training goes with the class
that holds most words seen once. Class transitions are counted anew over all
training tokens with all words in their classes. A token's probability is that
of its class after the class before, times that of the word in its class; both
are smoothed.

What reaches the driver is bounded by the share and the number of classes: at
most 1 / share units, the bigrams among them that occur, and tables of classes.
Words, their neighbours and their classes stay distributed and grow with the
corpus. Documents are cut into blocks of bounded size as they are read. Each
block names its words with their neighbours there; sorted by word, these rows
stream through the task that places a word, whatever their number; sorted by
block, the placed words meet their block's texts again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstflow.llm.common import texts, tidy, written

#: The token that closes each text; words are never empty.
END = ""
#: Bytes of text in a block; one longer text is a block of its own.
BLOCK = 12_000_000
#: Rows of words handed on at once.
ROWS = 20_000
#: Partitions that blocks are dealt to at most; beyond that a partition has several, one after the other.
PARTS = 20_000


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, ids, sizes): the distinct words of texts, the words of all texts in order as places among them, and how many each text has.

    Words are runs without ASCII white space, with A-Z lower-cased. No word
    becomes a Python object here.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    sizes = pc.list_value_length(parts).to_numpy()
    coded = parts.flatten().dictionary_encode()
    words, ids = coded.dictionary, coded.indices.to_numpy()
    empty = pc.index(words, END).as_py()
    if empty >= 0:
        real = ids != empty
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
        ids = ids[real]
    return words, ids, sizes.astype(np.int64)


def stream(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The words of texts one after the other, with -1, for an end, before the first text and after each."""
    out = np.full(len(ids) + len(sizes) + 1, -1, np.int64)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes) + 1] = ids
    return out


def places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each word stands among others; their number where it doesn't."""
    return pc.fill_null(pc.index_in(words, value_set=among), len(among)).to_numpy(zero_copy_only=False).astype(np.int64)


def split(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held_out): a document is held out if crc32 of its id as text is a multiple of 10.

    A null id is the empty text, so it is held out.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return texts(docs).withColumn("held_out", F.crc32(F.encode(key, "utf-8")) % 10 == 0)


def vocabulary(train: DataFrame) -> DataFrame:
    """(word, c): the count of every token of the training texts, the end among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for batch in batches:
            words, ids, sizes = tokens(batch.column(0))
            ends += len(sizes)
            n = np.bincount(ids, minlength=len(words))
            some = np.flatnonzero(n)
            yield pa.record_batch([words.take(pa.array(some)), pa.array(n[some], pa.int64())], ["word", "c"])
        yield pa.record_batch([pa.array([END] if ends else [], pa.string()), pa.array([ends] if ends else [], pa.int64())], ["word", "c"])

    return train.select("text").mapInArrow(tidy(run), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def units_of(vocab: DataFrame, share: float) -> tuple[list[str], np.ndarray, int, int]:
    """(units, their counts, all tokens, all words): units have at least `share` of the tokens, the most frequent first."""
    total, distinct = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = vocab.filter(F.col("c") >= share * total).orderBy(F.col("c").desc(), "word").collect()
    return [r.word for r in top], np.array([r.c for r in top], np.int64), total, distinct


_BLOCKS = "kind int, block long, word string, before array<int>, after array<int>, n long, doc_id long, held_out boolean, text string"
_KINDS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("word", pa.string()), ("before", pa.list_(pa.int32())), ("after", pa.list_(pa.int32())), ("n", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string())])
_WORD, _DOC, _PAIR = 0, 1, 2


def _batch(rows: int, /, **columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) if isinstance(columns.get(f.name), np.ndarray) else columns.get(f.name, pa.nulls(rows, f.type)) for f in _KINDS], schema=_KINDS)


def blocks(docs: DataFrame, units: list[str]) -> DataFrame:
    """Documents (doc_id, text, held_out) in blocks, in rows of three kinds.

    _WORD: a word of the block that is no unit, with the units before and after
    each time that training texts of the block have it (their number where
    there is none); a word of held-out texts alone has none. _DOC: a document.
    _PAIR: a pair of units in `block` (before * (units + 1) + after) and its
    count `n` in training texts, an end before each text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, rest, end = pa.array(units, pa.string()), len(units), units.index(END)
        block = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        codes, counts, size = [], [], 0

        def pairs() -> None:
            if codes:
                code, at = np.unique(np.concatenate(codes), return_inverse=True)
                n = np.bincount(at, np.concatenate(counts), len(code)).astype(np.int64)
                codes[:], counts[:] = [code], [n]

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal block, size
            words, ids, sizes = tokens(pa.concat_arrays([x.column(1) for x in held]))
            out = np.concatenate([x.column(2).to_numpy(zero_copy_only=False) for x in held]).astype(bool)
            unit = places(words, known)
            word = stream(ids[~np.repeat(out, sizes)], sizes[~out])
            own = np.where(word < 0, end, unit[word])
            code = own[:-1] * (rest + 1) + own[1:]
            if (rest + 1) ** 2 <= 1 << 22:
                n = np.bincount(code)
                code = np.flatnonzero(n)
                n = n[code]
            else:
                code, n = np.unique(code, return_counts=True)
            codes.append(code)
            counts.append(n)
            if sum(map(len, codes)) > 1 << 22:
                pairs()
            # Every word that is no unit, also of held-out texts.
            rare = np.flatnonzero((np.bincount(ids, minlength=len(words)) > 0) & (unit == rest))
            at = np.flatnonzero(own == rest)
            which = np.searchsorted(rare, word[at])
            order = np.argsort(which, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(rare))))).astype(np.int32)
            before, after = (x.astype(np.int32)[order] for x in (own[at - 1], own[(at + 1) % len(own)]))
            names = words.take(pa.array(rare))
            # Only the rows to hand on stay.
            del words, ids, unit, word, own, at, which, order
            for a in range(0, len(rare), ROWS):
                n_rows = min(ROWS, len(rare) - a)
                cut = ends[a : a + n_rows + 1]
                lists = [pa.ListArray.from_arrays(pa.array(cut - cut[0]), pa.array(x[cut[0] : cut[-1]])) for x in (before, after)]
                yield _batch(n_rows, kind=np.full(n_rows, _WORD), block=np.full(n_rows, block), word=names.slice(a, n_rows), before=lists[0], after=lists[1])
            for x in held:
                yield _batch(x.num_rows, kind=np.full(x.num_rows, _DOC), block=np.full(x.num_rows, block), doc_id=x.column(0), text=x.column(1), held_out=x.column(2))
            held.clear()
            block, size = block + 1, 0

        for batch in batches:
            own = pc.binary_length(batch.column(1)).to_numpy().astype(np.int64) + 64
            first = 0
            while first < batch.num_rows:
                # As many rows as the block still takes; at least one in a new block.
                room = int(np.searchsorted(np.cumsum(own[first:]), BLOCK - size, side="right"))
                n = max(room, 0 if held else 1)
                if n:
                    held.append(batch.slice(first, n))
                    size += int(own[first : first + n].sum())
                    first += n
                if first < batch.num_rows:
                    yield from close()
        if held:
            yield from close()
        pairs()
        for code, n in zip(codes, counts, strict=True):
            yield _batch(len(code), kind=np.full(len(code), _PAIR), block=code, n=n)

    return docs.select("doc_id", "text", "held_out").mapInArrow(tidy(run), _BLOCKS)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(pairs: np.ndarray, cls: np.ndarray, classes: int) -> float:
    """The part of the log likelihood of the class bigrams that the classes decide."""
    member = np.eye(classes)[cls]
    n = member.T @ pairs.astype(np.float64) @ member
    return float(_f(n).sum() - _f(n.sum(0)).sum() - _f(n.sum(1)).sum())


class Pairs:
    """A sparse square matrix of counts by rows and by columns."""

    def __init__(self, code: np.ndarray, n: np.ndarray, size: int):
        self.size, self.n = size, n.astype(np.float64)
        self.row, self.column = code // size, code % size
        self._by = []
        for own, other in ((self.row, self.column), (self.column, self.row)):
            order = np.argsort(own, kind="stable")
            self._by.append((np.searchsorted(own[order], np.arange(size + 1)), other[order], self.n[order]))
        self.weight = np.bincount(self.row, self.n, size) + np.bincount(self.column, self.n, size)

    @classmethod
    def of(cls, dense: np.ndarray) -> Pairs:
        code = np.flatnonzero(dense.ravel())
        return cls(code, dense.ravel()[code], len(dense))

    def after(self, unit: int) -> tuple[np.ndarray, np.ndarray]:
        """What follows a unit, and how often."""
        cut, other, n = self._by[0]
        return other[cut[unit] : cut[unit + 1]], n[cut[unit] : cut[unit + 1]]

    def before(self, unit: int) -> tuple[np.ndarray, np.ndarray]:
        cut, other, n = self._by[1]
        return other[cut[unit] : cut[unit + 1]], n[cut[unit] : cut[unit + 1]]

    def to_classes(self, cls: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
        """(unit -> class, class -> unit) counts, both by unit and then class."""
        after = np.bincount(self.row * classes + cls[self.column], self.n, self.size * classes)
        before = np.bincount(self.column * classes + cls[self.row], self.n, self.size * classes)
        return after.reshape(self.size, classes), before.reshape(self.size, classes)


def exchange(pairs: Pairs, classes: int, starts: int = 2, fixed: int = 0) -> np.ndarray:
    """A class for each unit: the likeliest of several starts, each run until no move helps.

    fixed: so many units at the end have a class of their own after `classes`
    and don't move. The first start deals units to the classes by frequency,
    the others in a fixed shuffled order; of equals the first is taken.
    """
    free = pairs.size - fixed
    order = np.argsort(-pairs.weight[:free], kind="stable")
    best, most = None, -math.inf
    for k in range(starts):
        cls = np.arange(pairs.size) - free + classes
        cls[order if k == 0 else np.random.default_rng(k).permutation(free)] = np.arange(free) % classes
        n = _exchange(pairs, classes, cls, order)
        own = float(_f(n).sum() - _f(n.sum(0)).sum() - _f(n.sum(1)).sum())
        if best is None or own > most + 1e-9:
            best, most = cls, own
    return best


def _exchange(pairs: Pairs, classes: int, cls: np.ndarray, order: np.ndarray) -> np.ndarray:
    """One start: `cls` is changed in place; the matrix of class bigrams is returned.

    In each sweep every unit, the most frequent first, is taken from its class
    and put where the log likelihood of the class bigrams is greatest; of
    equals where it was, then the least class. Each move raises the likelihood,
    so the sweeps end.
    """
    size = int(cls.max(initial=classes - 1)) + 1
    after, before = pairs.to_classes(cls, size)
    n = np.stack([after[cls == c].sum(0) for c in range(size)])
    off = ~np.eye(size, dtype=bool)
    moved = True
    while moved:
        moved = False
        for u in order.tolist():
            if not pairs.weight[u]:
                continue
            follow, times = pairs.after(u)
            a, s = int(cls[u]), float(times[follow == u].sum())
            r, l = after[u].copy(), before[u].copy()
            r[a] -= s
            l[a] -= s
            n[a] -= r
            n[:, a] -= l
            n[a, a] -= s
            left, right = n.sum(1), n.sum(0)
            base = _f(n)
            rows = ((_f(n + r[None, :]) - base) * off).sum(1)
            cols = ((_f(n + l[:, None]) - base) * off).sum(0)
            own = np.diag(n)
            # Wherever the unit goes, what stands before it keeps its total and so does what follows it.
            left, right = left + l, right + r
            gain = rows + cols + _f(own + r + l + s) - _f(own) - (_f(left + r.sum() + s) - _f(left)) - (_f(right + l.sum() + s) - _f(right))
            b = int(gain[:classes].argmax())
            if gain[b] <= gain[a] + 1e-9 * max(1.0, abs(gain[a])):
                b = a
            n[b] += r
            n[:, b] += l
            n[b, b] += s
            if b != a:
                moved = True
                cls[u] = b
                lead, often = pairs.before(u)
                after[lead, a] -= often
                after[lead, b] += often
                before[follow, a] -= times
                before[follow, b] += times
    return n


def transitions(n: np.ndarray) -> np.ndarray:
    """log10 of the probability of a class after a class: counts beside one pseudo-count dealt by the classes' shares."""
    share = (n.sum(0) + 0.1) / (n.sum() + 0.1 * n.shape[1])
    return np.log10((n + share[None, :]) / (n.sum(1, keepdims=True) + 1))


class Classes:
    """The units' classes, and the rule that places every other word."""

    def __init__(self, units: list[str], counts: np.ndarray, pairs: Pairs, classes: int):
        self.units, self.counts, self.classes = units, counts, classes
        found = exchange(pairs, classes, fixed=1)
        #: The class of each unit; after them, that of all other tokens.
        self.unit = found
        after, _ = pairs.to_classes(found, classes + 1)
        n = np.stack([after[found == c].sum(0) for c in range(classes + 1)])
        logs = transitions(n)
        self._from, self._to = logs[:, :classes], logs[:classes].T
        self._size = np.bincount(found[:-1], counts, classes)

    def place(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The classes of words by their counts of the classes (rows: words) before and after them.

        Where transitions and the word's share of the class are likeliest; of
        equals the least class. Rounded, so that sums in another order agree.
        """
        c = before.sum(1, keepdims=True)
        logs = before @ self._from + after @ self._to - c * np.log10(np.maximum(self._size[None, :] + c, 1))
        return np.round(logs, 6).argmax(1)


def placed(rows: DataFrame, classes: Classes) -> DataFrame:
    """(block, word, c, cls, is_first) of the words of `blocks` that training texts have, a row for each block that names one.

    c: the count over all blocks. is_first: one of a word's rows. A word's rows
    stream by in sorted order; what is kept of it is counts of classes and the
    blocks that named it.
    """
    wide = classes.classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, in_blocks, counts = None, [], np.zeros((2, wide), np.int64)  # the word that may go on

        def out(block, word, c, cls, is_first) -> pa.RecordBatch:
            return pa.record_batch([pa.array(block, pa.int64()), word, pa.array(c, pa.int64()), pa.array(cls, pa.int32()), pa.array(is_first, pa.bool_())], ["block", "word", "c", "cls", "is_first"])

        def close() -> Iterator[pa.RecordBatch]:
            if last is not None and (c := int(counts[0].sum())):
                block = np.concatenate(in_blocks)
                cls = int(classes.place(counts[:1], counts[1:])[0])
                for a in range(0, len(block), ROWS):
                    n = len(block[a : a + ROWS])
                    yield out(block[a : a + n], pa.array([last] * n, pa.string()), np.full(n, c), np.full(n, cls), np.arange(a, a + n) == 0)

        for batch in batches:
            if not batch.num_rows:
                continue
            word, block = batch.column(0), batch.column(1).to_numpy()
            lists = [batch.column(i) for i in (2, 3)]
            fresh = np.concatenate(([True], pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)))
            group = np.cumsum(fresh) - 1
            starts = np.flatnonzero(fresh)
            of = np.repeat(group, pc.list_value_length(lists[0]).to_numpy())
            both = np.stack([np.bincount(of * wide + classes.unit[x.flatten().to_numpy()], minlength=len(starts) * wide).reshape(-1, wide) for x in lists])
            begin = word[0].as_py()
            if begin == last:
                both[:, 0] += counts
                if len(starts) == 1:
                    counts = both[:, 0].copy()
                    in_blocks.append(block)
                    continue
                # The word that went on ends in this batch.
                counts = both[:, 0].copy()
                in_blocks.append(block[: starts[1]])
                yield from close()
                begun = 1
            else:
                yield from close()
                begun = 0
            end = len(starts) - 1
            if end > begun:
                c = both[0].sum(1)
                cls = classes.place(both[0], both[1])
                rows_ = np.arange(starts[begun], starts[end])
                rows_ = rows_[c[group[rows_]] > 0]
                yield out(block[rows_], word.take(pa.array(rows_)), c[group[rows_]], cls[group[rows_]], fresh[rows_])
            last, in_blocks, counts = word[starts[end]].as_py(), [block[starts[end] :]], both[:, end].copy()
        yield from close()

    named = rows.filter(F.col("kind") == _WORD).select("word", "block", "before", "after")
    return named.repartition("word").sortWithinPartitions("word").mapInArrow(tidy(run), "block long, word string, c long, cls int, is_first boolean")


def _class_counts(rows: DataFrame, classes: Classes) -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens, words) of each class, and the class that holds most words of count 1."""
    tokens = np.bincount(classes.unit[:-1], classes.counts, classes.classes).astype(np.int64)
    types = np.bincount(classes.unit[:-1], minlength=classes.classes)
    once = np.bincount(classes.unit[:-1], classes.counts == 1, classes.classes).astype(np.int64)
    for r in rows.filter("is_first").groupBy("cls").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") == 1).alias("once")).collect():
        tokens[r.cls] += r.c
        types[r.cls] += r.n
        once[r.cls] += r.once
    return tokens, types, int(once.argmax())


_COUNTED = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, pairs array<int>, times array<int>"


def counted(rows: DataFrame, known: DataFrame, classes: Classes, unseen: int) -> DataFrame:
    """For each document its tokens, known tokens, sum of log10(c + 0.1), and its class bigrams (before * classes + after) with their counts."""
    most = rows.filter(F.col("kind") == _DOC).agg(F.max(F.shiftright("block", 32)), F.max(F.col("block").bitwiseAND(F.lit((1 << 32) - 1)))).first()
    tasks, each = ((x or 0) + 1 for x in most)
    place = F.shiftright("block", 32) * each + F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    width = classes.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = pa.array(classes.units, pa.string())
        end, block = classes.units.index(END), None
        new: list[tuple] = []
        among = c = cls = logs = None

        for batch in batches:
            kind, at = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if at[a] != block:
                    block, new, among = int(at[a]), [], None
                if kind[a] == _WORD:
                    new.append((batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a).to_numpy(), batch.column(4).slice(a, b - a).to_numpy()))
                    continue
                if among is None:
                    # One place more, for what training texts don't have.
                    among = pa.concat_arrays([units, *[x for x, _, _ in new]])
                    c = np.concatenate([classes.counts, *[x for _, x, _ in new], [0]])
                    cls = np.concatenate([classes.unit[: len(units)], *[x for _, _, x in new], [unseen]]).astype(np.int64)
                    logs = np.log10(c + 0.1)
                words, ids, sizes = tokens(batch.column(7).slice(a, b - a))
                word = stream(ids, sizes)
                place = np.where(word < 0, end, places(words, among)[word]) if len(words) else np.full(len(word), end)
                n_tokens = sizes + 1
                of = np.repeat(np.arange(b - a), n_tokens)
                known_ = np.bincount(of, c[place[1:]] > 0, b - a).astype(np.int64)
                own_cls = cls[place]
                # The end of a text stands before the next one, as an end before each text should.
                code, times = np.unique(of * width * width + own_cls[:-1] * width + own_cls[1:], return_counts=True)
                cut = np.searchsorted(code, np.arange(b - a + 1) * width * width).astype(np.int32)
                yield pa.record_batch([batch.column(5).slice(a, b - a), batch.column(6).slice(a, b - a), pa.array(n_tokens, pa.int64()), pa.array(known_), pa.array(np.bincount(of, logs[place[1:]], b - a)),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array((code % (width * width)).astype(np.int32))), pa.ListArray.from_arrays(pa.array(cut), pa.array(times.astype(np.int32)))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "logs", "pairs", "times"])

    null = F.lit(None)
    both = known.select(place.alias("at"), F.lit(_WORD).alias("kind"), "word", "c", "cls", null.cast("long").alias("doc_id"), null.cast("boolean").alias("held_out"), null.cast("string").alias("text")).unionByName(
        rows.filter(F.col("kind") == _DOC).select(place.alias("at"), F.lit(_DOC).alias("kind"), null.cast("string").alias("word"), null.cast("long").alias("c"), null.cast("int").alias("cls"), "doc_id", "held_out", "text")
    )
    parts = min(PARTS, tasks * each)
    return both.repartitionById(parts, (F.col("at") % parts).cast("int")).sortWithinPartitions("at", "kind").mapInArrow(tidy(run), _COUNTED)


def class_bigrams(docs: DataFrame, classes: int) -> np.ndarray:
    """The matrix of class bigrams of the training documents of `counted`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(), len(total)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["code", "n"])

    out = np.zeros(classes * classes, np.int64)
    for r in docs.filter("NOT held_out").select("pairs", "times").mapInArrow(tidy(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out.reshape(classes, classes)


def scored(docs: DataFrame, n: np.ndarray, tokens: np.ndarray, types: np.ndarray, total: int, distinct: int) -> DataFrame:
    """The score columns of the documents of `counted`, under class bigrams and the classes' tokens and words."""
    # Every class keeps room for one word that it never saw.
    logs = (transitions(n) - np.log10(tokens + 0.1 * (types + 1))[None, :]).ravel()
    base = math.log10(total + 0.1 * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(x["pairs"]).to_numpy())
            own = np.bincount(of, logs[x["pairs"].flatten().to_numpy()] * x["times"].flatten().to_numpy(), batch.num_rows)
            emitted, n_tokens = x["logs"].to_numpy(), x["n_tokens"].to_numpy()
            yield pa.record_batch([x["doc_id"], x["held_out"], x["n_tokens"], x["n_known"], pa.array(np.full(batch.num_rows, total, np.int64)), pa.array(emitted - n_tokens * base), pa.array(emitted + own)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.mapInArrow(tidy(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, share: float = 1e-4, classes: int = 32) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of (doc_id, text): one row for each row.

    share: least share of the training tokens of a word that exchange moves
    alone (the end always is one). classes: at least 1.
    """
    rows = split(docs)
    vocab = written(vocabulary(rows.filter(~F.col("held_out"))), "vocabulary")
    units, counts, total, distinct = units_of(vocab, share)
    if END not in units:
        units, counts = [*units, END], np.append(counts, vocab.filter(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    dealt = written(blocks(rows, units), "blocks", "zstd")
    found = dealt.filter(F.col("kind") == _PAIR).groupBy(F.col("block").alias("code")).agg(F.sum("n").alias("n")).toArrow()
    size = len(units) + 1
    model = Classes(units, counts, Pairs(found["code"].to_numpy(), found["n"].to_numpy(), size), classes)
    known = written(placed(dealt, model), "placed", "zstd")
    tokens, types, unseen = _class_counts(known, model)
    done = written(counted(dealt, known, model, unseen), "counted")
    return scored(done, class_bigrams(done, classes), tokens, types, total, distinct)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    A null or empty text is its end alone. Repeated rows count and are scored
    each. Without training texts every count is 0 and the smoothing alone
    gives the scores. An empty table gives no rows.
    """
    return score(docs).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
