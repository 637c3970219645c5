"""BPE encoding and decoding with a pair occurrence index.

Texts are cut into pretokens; the distinct pretokens of a batch that the cache
lacks are laid end to end in one list of symbols. An index maps each mergeable
pair to all its positions there. The active ranks wait in a heap: the lowest
is taken, all its positions are merged from left to right, and the pairs that
a merge makes beside it enter the index. A position whose symbols have changed
meanwhile is passed over.

The vocabulary file is a parameter and never part of this repository.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import threading
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from karstflow.llm.common import give_back, texts

#: Space as the file's normaliser sees it: str.split() also takes U+001C to U+001F.
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_SEPARATORS = re.compile("[\\x1c-\\x1f]")
#: Entries of a cache's young half; a full one becomes the old half, so memory stays bounded and frequent words stay.
CACHE = 500_000
#: Positions of a pair from which a list is long and merged as arrays, and short ones in a row that end that.
OFTEN, SHORT_ONES = 40, 20
#: Bytes of a pretoken up to which rounds merge it.
LONG = 48
#: Characters of text whose new words are merged together.
TOGETHER = 4_000_000


class Halves:
    """A cache of two generations."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def lacking(self, keys: set[str]) -> list[str]:
        """Make every known key young; give the others."""
        old, young, unknown = self.old, self.young, []
        for k in keys.difference(young):
            v = old.get(k)
            if v is None:
                unknown.append(k)
            else:
                young[k] = v
        return unknown

    def age(self) -> None:
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young


def _byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class PairIndexBPE:
    """Encoder and decoder of one vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._pretokens = regex.compile(split).findall
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self._utf8 = {i: t.encode() for i, t in self.token.items()}
        #: left id and right id in one integer -> (rank, id of the merged symbol)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(self.vocab[a] << 32 | self.vocab[b], (rank, self.vocab[a + b]))
        self._pairs = np.array(sorted(self.merges), np.int64)
        letters = _byte_letters()
        #: ids of a byte inside and at the end of a word
        self._letter = np.array([self.vocab[x] for x in letters], np.int64)
        self._last_letter = np.array([self.vocab[x + self.end] for x in letters], np.int64)
        #: (inside byte, any byte) -> rank of their pair, or -1; the second half is for last bytes
        self._first_rank = np.full((256, 512), -1, np.int64)
        for a, left in enumerate(self._letter.tolist()):
            for b, right in enumerate([*self._letter.tolist(), *self._last_letter.tolist()]):
                if m := self.merges.get(left << 32 | right):
                    self._first_rank[a, b] = m[0]
        self._known = Halves()
        #: Held while texts are encoded; how often texts have come.
        self.lock, self.used = threading.Lock(), 0

    def forget(self) -> None:
        """Empty the cache."""
        self._known = Halves()

    def merge(self, pretokens: list[str]) -> list[bytes]:
        """The ids of each pretoken (none of them empty)."""
        if not pretokens:
            return []
        merges = self.merges
        raw = [w.encode("utf-8", "surrogatepass") for w in pretokens]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        # A zero byte closes each word; its place becomes -1.
        text = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8).astype(np.int64)
        close = np.cumsum(size + 1) - 1
        laid = self._letter[text]
        laid[close - 1] = self._last_letter[text[close - 1]]
        laid[close] = -1
        second = text.copy()
        second[close - 1] += 256
        rank_at = self._first_rank[text[:-1], second[1:]]
        rank_at[close - 1] = -1
        rank_at[close[:-1]] = -1
        places = np.flatnonzero(rank_at >= 0)
        places = places[np.argsort(rank_at[places], kind="stable")]
        ranks = rank_at[places]
        n = len(laid)
        index: dict[int, list[int]] = {}
        pair_of: dict[int, tuple[int, int, int]] = {}
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rank, at = int(ranks[a]), int(places[a])
            index[rank] = places[a:b].tolist()
            left, right = int(laid[at]), int(laid[at + 1])
            pair_of[rank] = (left, right, merges[left << 32 | right][1])
        active = list(index)
        heapq.heapify(active)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        self._merge_often(index, pair_of, active, laid, after, before)
        symbols, after, before = laid.tolist(), after.tolist(), before.tolist()
        get = merges.get
        while active:
            rank = heapq.heappop(active)
            positions = index.pop(rank, None)
            if positions is None:
                continue
            a, b, made = pair_of[rank]
            if len(positions) > 1:
                positions.sort()
            for at in positions:
                if symbols[at] != a:
                    continue
                nxt = after[at]
                if symbols[nxt] != b:
                    continue
                symbols[at], symbols[nxt] = made, -2
                nxt = after[nxt]
                after[at] = nxt
                if nxt < n:
                    before[nxt] = at
                    right = symbols[nxt]
                    if right >= 0 and (m := get(made << 32 | right)):
                        if m[0] in index:
                            index[m[0]].append(at)
                        else:
                            index[m[0]] = [at]
                            pair_of[m[0]] = (made, right, m[1])
                            heapq.heappush(active, m[0])
                prev = before[at]
                if prev >= 0:
                    left = symbols[prev]
                    if left >= 0 and (m := get(left << 32 | made)):
                        if m[0] in index:
                            index[m[0]].append(prev)
                        else:
                            index[m[0]] = [prev]
                            pair_of[m[0]] = (left, made, m[1])
                            heapq.heappush(active, m[0])
        done = np.array(symbols, np.int64)
        ids = done[done >= 0].astype("<u4").tobytes()
        ends = (4 * np.cumsum(done >= 0)[close]).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _merge_often(self, index: dict[int, list[int]], pair_of: dict[int, tuple[int, int, int]], active: list[int], symbols: np.ndarray, after: np.ndarray, before: np.ndarray) -> None:
        """Take ranks from the heap as long as some of their lists are long, all positions of one at a time.

        After SHORT_ONES short lists in a row the rest is left for the caller.
        """
        n, short = len(symbols), 0
        while active and short < SHORT_ONES:
            rank = heapq.heappop(active)
            positions = index.pop(rank, None)
            if positions is None:
                continue
            short = short + 1 if len(positions) < OFTEN else 0
            a, b, made = pair_of[rank]
            at = np.unique(np.array(positions))
            at = at[symbols[at] == a]
            nxt = after[at]
            good = symbols[nxt] == b
            at, nxt = at[good], nxt[good]
            if a == b and len(at):
                # In a run of equals every other place is merged, from the left.
                begins = np.concatenate(([True], at[1:] != nxt[:-1]))
                place = np.arange(len(at))
                even = (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
                at, nxt = at[even], nxt[even]
            symbols[at], symbols[nxt] = made, -2
            nxt = after[nxt]
            after[at] = nxt
            inside = nxt < n
            before[nxt[inside]] = at[inside]
            prev = before[at]
            prev = prev[prev >= 0]
            # A new pair is named by its left place.
            left = np.unique(np.concatenate([at[inside], prev]))
            pairs = symbols[left] << 32 | symbols[after[left]]
            left, pairs = (x[(symbols[left] >= 0) & (symbols[after[left]] >= 0)] for x in (left, pairs))
            found = np.searchsorted(self._pairs, pairs)
            found[found == len(self._pairs)] = 0
            known = self._pairs[found] == pairs
            left, found = left[known], found[known]
            order = np.argsort(found, kind="stable")
            left, found = left[order], found[order]
            cuts = np.flatnonzero(np.diff(found, prepend=-1, append=-1)).tolist()
            for x, y in zip(cuts, cuts[1:]):
                pair = int(self._pairs[found[x]])
                new, whole = self.merges[pair]
                if new in index:
                    index[new] += left[x:y].tolist()
                else:
                    index[new] = left[x:y].tolist()
                    pair_of[new] = (pair >> 32, pair & 0xFFFFFFFF, whole)
                    heapq.heappush(active, new)

    def _learn(self, runs: list[str]) -> None:
        """Put the ids of runs without white space into the cache.

        A run of letters is one pretoken. A pretoken by itself is cut as it is
        in a run, so runs and pretokens share the cache.
        """
        letters = [r for r in runs if r.isalpha()]
        mixed = [r for r in runs if not r.isalpha()]
        cut = list(map(self._pretokens, mixed))
        new = list({*self._known.lacking(set().union(*cut)), *letters})
        known = self._known.young
        known.update(zip(new, self.merge(new), strict=True))
        for run, words in zip(mixed, cut, strict=True):
            if words != [run]:
                known[run] = b"".join([known[w] for w in words])

    def _runs_of(self, text: str) -> list[str]:
        if not text.isascii():
            # One character at a time, so a capital sigma at a word's end is like any other.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [r for r in _SPACE.split(text) if r] if _SEPARATORS.search(text) else text.split()

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers.

        Special tokens in a text are recognised as the library does.
        """
        with self.lock:
            self.used += 1
            return self._encoded(batch)

    def _encoded(self, batch: list[str]) -> list[bytes]:
        cut = [[self._runs_of(p) if k % 2 == 0 else self.special[p] for k, p in enumerate(self._cut_special.split(t))] if self._cut_special and "<|" in t else [self._runs_of(t)] for t in batch]
        self._known.age()
        seen: set[str] = set()
        for parts in cut:
            for p in parts:
                if type(p) is list:
                    seen.update(p)
        self._learn(self._known.lacking(seen))
        known = self._known.young.__getitem__
        return [b"".join(b"".join(map(known, p)) if type(p) is list else p.to_bytes(4, "little") for p in parts) for parts in cut]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens, with a space between two, as a file without a decoder asks for."""
        return b" ".join(map(self._utf8.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class RoundsBPE(PairIndexBPE):
    """The same encoder for the operators that only need the ids: short pretokens are merged in rounds.

    In a round every pretoken has its lowest rank merged wherever it stands,
    all pretokens at once. A pretoken of n bytes takes less than n rounds, so
    those over LONG bytes are left to the index, as is a file in which two
    merges make the same symbol: there a lower rank may appear late.
    """

    def __init__(self, path: str):
        super().__init__(path)
        by_rank = dict(self.merges.values())
        self._made = np.zeros(1 + max(by_rank, default=0), np.int64)
        self._made[list(by_rank)] = list(by_rank.values())
        self._late = len(set(by_rank.values())) < len(self.merges)
        #: rank of each of _pairs
        self._rank = np.array([self.merges[p][0] for p in self._pairs.tolist()], np.int64)

    def merge(self, pretokens: list[str]) -> list[bytes]:
        if self._late:
            return super().merge(pretokens)
        raw = [w.encode("utf-8", "surrogatepass") for w in pretokens]
        short = [w for w in raw if len(w) <= LONG]
        merged = iter(self._rounds(short) if short else [])
        indexed = iter(super().merge([w for w, r in zip(pretokens, raw, strict=True) if len(r) > LONG]))
        return [next(merged) if len(r) <= LONG else next(indexed) for r in raw]

    def _rounds(self, raw: list[bytes]) -> list[bytes]:
        none = np.int64(1 << 40)
        words, size = np.arange(len(raw)), np.fromiter(map(len, raw), np.int64, len(raw))
        text = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        ends = np.cumsum(size) - 1
        symbols = self._letter[text]
        symbols[ends] = self._last_letter[text[ends]]
        second = text.copy()
        second[ends] += 256
        rank = np.full(len(text), none)
        rank[:-1] = self._first_rank[text[:-1], second[1:]]
        rank[rank < 0] = none
        rank[ends] = none
        last = np.zeros(len(text), bool)
        last[ends] = True
        # What is done: pretokens, how many symbols they have, and the symbols.
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(words):
            least = np.minimum.reduceat(rank, np.cumsum(size) - size)
            active = least < none
            if not active.all():
                inside = np.repeat(active, size)
                done.append((words[~active], size[~active], symbols[~inside]))
                words, size, least = words[active], size[active], least[active]
                symbols, rank, last = symbols[inside], rank[inside], last[inside]
                if not len(words):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            # In a run of equals every other place is merged, from the left.
            begins = np.concatenate(([True], at[1:] != at[:-1] + 1))
            if not begins.all():
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
            symbols[at] = self._made[rank[at]]
            last[at] = last[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            size = np.add.reduceat(keep, np.cumsum(size) - size, dtype=np.int64)
            symbols, rank, last = symbols[keep], rank[keep], last[keep]
            at -= np.arange(len(at))
            rank[at] = none
            before = at[at > 0] - 1
            left = np.concatenate([at[~last[at]], before[~last[before]]])
            pairs = symbols[left] << 32 | symbols[left + 1]
            found = np.searchsorted(self._pairs, pairs)
            found[found == len(self._pairs)] = 0
            rank[left] = np.where(self._pairs[found] == pairs, self._rank[found], none)
        out = [b""] * len(raw)
        for which, count, own in done:
            ids, stop = own.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
            for w, a, b in zip(which.tolist(), [0, *stop[:-1]], stop, strict=True):
                out[w] = ids[a:b]
        return out


#: Seconds without text after which a worker lets go of its vocabulary and the words it has learned, so that other work has the memory.
IDLE = 8.0
_LOADED: dict[tuple[type[PairIndexBPE], str], PairIndexBPE] = {}


def tokenizer(path: str, kind: type[PairIndexBPE] = PairIndexBPE) -> PairIndexBPE:
    """One a worker process, kind and file."""
    own = _LOADED.get((kind, path))
    if own is None:
        own = _LOADED[kind, path] = kind(path)
    return own


def _rest(bpe: PairIndexBPE) -> None:
    """Let go of `bpe` and what it has learned unless it gets text within IDLE seconds."""
    used = bpe.used = bpe.used + 1

    def let_go() -> None:
        nonlocal bpe
        with bpe.lock:
            if bpe.used != used:
                return
            bpe.forget()
            for key in [k for k, x in list(_LOADED.items()) if x is bpe]:
                _LOADED.pop(key, None)
        bpe = None
        gc.collect()
        give_back()

    timer = threading.Timer(IDLE, let_go)
    timer.daemon = True
    timer.start()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded_rows(batch: pa.RecordBatch, bpe: PairIndexBPE) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) of a batch of (doc_id, text), some megabytes of text at a time."""
    keys, held, size = [], [], 0
    for key, text in zip(batch.column(0), batch.column(1), strict=True):
        keys.append(key.as_py())
        held.append(text.as_py())
        size += len(held[-1])
        if size > TOGETHER:
            yield from zip(keys, bpe.encode_batch(held), strict=True)
            keys, held, size = [], [], 0
    yield from zip(keys, bpe.encode_batch(held), strict=True)
    _rest(bpe)


def encode(docs: DataFrame, path: str, end_id: int | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit): one row for each row of `docs`.

    end_id, if given, follows each text. A null or empty text has no ids else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, tail = tokenizer(path), b"" if end_id is None else end_id.to_bytes(4, "little")
        for batch in batches:
            keys, out = [], []
            for key, ids in encoded_rows(batch, bpe):
                keys.append(key)
                out.append(ids + tail)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts_ = [bpe.decode(x.as_py() or b"").decode() for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts_, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded and its ids decoded again.

    A null or empty text has no tokens and the digests of nothing. Repeated
    rows give equal rows; an empty table gives none. Nothing is shuffled.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            keys, counts, ids_sha, text_sha = [], [], [], []
            for key, ids in encoded_rows(batch, bpe):
                keys.append(key)
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
