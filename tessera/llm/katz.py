"""Katz backoff scores: Good-Turing discounts, exactly normalised backoff weights, any order.

    p(w | ctx) = d(c(ctx w)) c(ctx w) / c(ctx)     if c(ctx w) > 0
               = alpha(ctx) p(w | shorter ctx)     otherwise (alpha = 1 where ctx never trained)
    p(w)       = d(c(w)) c(w) / N, and what is left for the one unknown word
    alpha(ctx) = (1 - sum of the seen p(.|ctx)) / (1 - sum of p(.|shorter ctx) over the seen words)

The order is a parameter. Texts begin with order - 1 start marks and close with
an end token, so counts of shorter n-grams are sums over those of full order.
Everything moves through tables of packed arrays, dealt by word to parts of
bounded size; no side is broadcast but scalars and at most HOT_MOST words.

1. Words: each chunk of documents sends its distinct words with their counts to
   the words' parts. The merged counts tell the words too frequent for one part
   (a matter of the plan only: they are dealt by word pair instead).
2. N-grams: each chunk sends its distinct n-grams, with the documents they stand
   in, to the part of their last word, where the counts of all its n-grams are
   complete. Stored: the n-gram table; per token of the texts how far down it
   has to back off and the count met there; where it does back off, requests
   for the weights of the contexts passed.
3. Weights: the n-gram table's rows are summed by context, in the part of the
   context's last word, and become backoff weights, stored as a table too; the
   requests are answered there.
4. Texts: each chunk gets its tokens' levels and counts and the answers, applies
   the discounts token by token, and adds up.

The last word of one context is the token before it, so a token's own part also
knows how often the next token's full context occurred; that normaliser is
taken from there, and requests for full contexts bring alpha times count.

`train` returns the model with its tables; `Model.score` scores any other texts
with them by the same steps.

Defined cases: null, empty and word-less texts hold the end token only; texts of
any length count whole; null ids train and score like others; repeated rows
count and return once each; an empty training set makes every token the unknown
word with probability one; an empty table gives no row; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACED, Scratch, held_out, join_hashes, text_blocks, trim, word_hashes, words
from .packed import COLUMNS, batches_of, blob_rows, by_key, by_part, grouped, pack, part_of, slices, unpack

ORDER = 3
#: Counts up to CUT get Good-Turing discounts; larger ones keep all but a sliver, so that every context has mass to give.
CUT = 5
LARGE = 0.999
#: Tokens aimed at per part, and bytes of text per chunk.
PART_TOKENS = 1_750_000
CHUNK_BYTES = 16 << 20
#: Bytes of text tokenised at once: arrays over them stay in a core's cache.
TOKEN_BYTES = 1 << 18
#: Words dealt by pair at most; which ones changes no result.
HOT_MOST = 1 << 20
#: Hashes that stand for the end and the start of a text.
END, START = np.uint64(0x5BD1E995A3C59AC3), np.uint64(0x0000AE3D27D4EB4F)
#: What a request asks of a context: alpha times its count, alpha, or one over its count.
FULL, ALPHA, COUNT = range(3)

RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a block of texts as hashes, and their rows."""
    low = LOWER[data]
    starts, ends, rows = words(low, offs, SPACED)
    return word_hashes(low, starts, ends), rows


class Chunk:
    """The token stream of some documents, held as each block's distinct words and indices into them."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.bytes = self.docs = 0
        self.ids: list = []
        self.out: list = []

    def add(self, batch: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> None:
        hashes, rows = _tokens(data, offs)
        n = batch.num_rows
        token = np.full(len(rows) + n, END, np.uint64)
        token[np.arange(len(rows)) + rows] = hashes
        word, index = np.unique(token, return_inverse=True)
        self.parts.append((word, index.astype(np.int32), np.bincount(rows, minlength=n) + 1))
        self.ids += batch.column(0).to_pylist()
        self.out += batch.column(1).to_pylist()
        self.docs += n
        self.bytes += len(data)

    def streams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words and START, sorted; the tokens of all documents as indices into them; tokens and training flag of each document."""
        word, place = np.unique(np.concatenate([*(p[0] for p in self.parts), np.array([START])]), return_inverse=True)
        place, counts = place.astype(np.int32), np.concatenate([p[2] for p in self.parts])
        index, at, to = np.empty(sum(len(p[1]) for p in self.parts), np.int32), 0, 0
        for own, local, _ in self.parts:
            index[at : at + len(local)] = place[to : to + len(own)][local]
            at, to = at + len(local), to + len(own)
        self.parts.clear()
        return word, index, counts, ~np.array(self.out, bool)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
    """Numbered chunks of a partition: the same ones whenever the partition is computed."""
    part, seq, chunk = TaskContext.get().partitionId(), 0, Chunk()
    for batch, data, offs in text_blocks(batches, "__text", TOKEN_BYTES):
        if chunk.docs and chunk.bytes + len(data) > CHUNK_BYTES:
            yield (part << 24) + seq, chunk
            seq, chunk = seq + 1, Chunk()
        chunk.add(batch, data, offs)
    if chunk.docs:
        yield (part << 24) + seq, chunk


@dataclass
class Plan:
    """What all tasks know: the order, the parts, and the words dealt by pair with their counts."""

    order: int
    parts: int
    hot: np.ndarray
    hot_counts: np.ndarray

    def known(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are hot, and where in the list."""
        if not len(self.hot):
            return np.zeros(len(word), bool), np.zeros(len(word), np.int64)
        slot = np.minimum(np.searchsorted(self.hot, word), len(self.hot) - 1)
        return self.hot[slot] == word, slot

    def place(self, word: np.ndarray, index: np.ndarray, second: np.ndarray | None) -> np.ndarray:
        """The part of each row by its word, and of a hot word by the pair. index, second: into `word`."""
        where, hot = part_of(word, self.parts), self.known(word)[0]
        out = where[index]
        if second is not None and hot.any():
            at = np.flatnonzero(hot[index])
            out[at] = part_of(join_hashes(word[index[at]], word[second[at]]), self.parts)
        return out


def _word_counts(parts: int):
    """The distinct words of the training texts, with their counts, some chunks of text at a time."""

    def flush(number: int, held: list[tuple]) -> pa.RecordBatch:
        word, index = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        count = np.bincount(index, weights=np.concatenate([c for _, c in held])).astype(np.int64)
        held.clear()
        where = part_of(word, parts)
        order = np.argsort(where, kind="stable")
        rows = [(p, number, pack(word[order[a:b]], count[order[a:b]].astype(np.uint64))) for p, a, b in slices(where[order])]
        del word, index, count, where, order
        trim()
        return blob_rows(rows, ("key", "chunk", "blob"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 24
        for batch, data, offs in text_blocks(batches, "__text", TOKEN_BYTES):
            train = ~batch.column(1).to_numpy(zero_copy_only=False)
            if not train.any():
                continue
            hashes, rows = _tokens(data, offs)
            held += [np.unique(hashes[train[rows]], return_counts=True), (np.array([END]), np.array([train.sum()]))]
            size += len(data)
            if size > CHUNK_BYTES:
                yield flush(number, held)
                size, number = 0, number + 1
        if held:
            yield flush(number, held)

    return run


def _merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in grouped(batches, ("key", "blob")):
        arrays = [unpack(blob) for (blob,) in rows]
        word, inverse = np.unique(np.concatenate([a[0] for a in arrays]).astype(np.uint64), return_inverse=True)
        count = np.bincount(inverse, weights=np.concatenate([a[1] for a in arrays])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], names=["word", "n"])


def _own_words(words_: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The words that the columns of indices use, and the columns as indices into those."""
    if len(columns) * len(columns[0]) * 16 < len(words_):
        used, back = np.unique(np.concatenate(columns), return_inverse=True)
        return words_[used], np.split(back, len(columns))
    used = np.zeros(len(words_), bool)
    for c in columns:
        used[c] = True
    place = np.cumsum(used) - 1
    return words_[used], [place[c] for c in columns]


def _one_key(columns: list[np.ndarray], size: int) -> np.ndarray:
    """A number for each row of columns of values under `size`, in the columns' order."""
    key, top = columns[0].astype(np.uint64), size
    for c in columns[1:]:
        if top * size >= 1 << 63:
            values, key = np.unique(key, return_inverse=True)
            key, top = key.astype(np.uint64), len(values)
        key = key * np.uint64(size) + c.astype(np.uint64)
        top *= size
    return key


def _order(where: np.ndarray, key: np.ndarray) -> np.ndarray:
    """An order by `where` and then `key`, both from 0 on; rows alike in both come in any order."""
    top = int(key.max(initial=0)) + 1
    if (int(where.max(initial=0)) + 1) * top >= 1 << 63:
        return np.lexsort((key, where))
    return np.argsort(where.astype(np.uint64) * np.uint64(top) + key.astype(np.uint64))


def _ngrams(plan: Plan, first: int, last: int, about: bool):
    """N: the chunk's distinct n-grams and their documents, to parts first to last; docs, if `about`: the chunk's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in _chunks(batches):
            word, index, counts, train = chunk.streams()
            if about:
                ids = np.array([0 if i is None else i for i in chunk.ids], np.int64)
                null = np.array([i is None for i in chunk.ids], np.uint8)
                yield blob_rows([("docs", first + crc32(b"%d" % number) % (last - first), number, pack(ids, null, train.astype(np.uint8), counts.astype(np.uint64)))])
            start = np.searchsorted(word, START)
            doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
            inside = np.arange(len(index), dtype=np.int32) - np.repeat((np.cumsum(counts) - counts).astype(np.int32), counts)
            columns = [index]
            for j in range(1, plan.order):
                before = np.full(len(index), start, np.int32)
                before[j:] = index[:-j] if j < len(index) else index[:0]
                before[inside < j] = start
                columns.append(before)
            where = plan.place(word, index, columns[1] if plan.order > 1 else None)
            keep = np.flatnonzero((where >= first) & (where < last)).astype(np.int32)
            columns, where, doc = [c[keep] for c in columns], where[keep], doc[keep]
            del index, inside, keep
            key = _one_key(columns, len(word))
            order = _order(where - first, key)
            # Rows alike by place, so that their documents ascend.
            where, key = where[order], key[order]
            run = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (where[1:] != where[:-1])])[: len(key)])
            order = np.sort((run << 32) + order) & 0xFFFFFFFF
            doc = doc[order]
            columns = [c[order] for c in columns]
            code = doc.astype(np.uint32) * np.uint32(2) + train[doc]
            del doc, run, order
            rows = []
            for p, a, b in slices(where):
                new = np.flatnonzero(np.concatenate([[True], key[a + 1 : b] != key[a : b - 1]]))
                times = np.diff(np.append(new, b - a))
                own, local = _own_words(word, [c[a:b][new] for c in columns])
                rows.append(("N", p, number, pack(own, *(c.astype(np.uint64) for c in local), times.astype(np.uint64), code[a:b])))
            del word, columns, where, key, code
            trim()
            yield from batches_of(rows, 16)

    return run


class Counts:
    """The n-grams of one part: distinct rows of full order, with the trained counts of every length.

    ids[k - 1]: the number of each row's k-gram (its last word and k - 1 words
    before); of[k - 1]: its count; links[k - 1]: the shorter k-gram and the added
    word of every k-gram (for k = 1 the word).
    """

    def __init__(self, plan: Plan, parts: list[tuple[np.ndarray, list[np.ndarray], np.ndarray]]):
        """parts: (words, columns of indices into them, trained count) of some rows each; used up."""
        every = np.concatenate([w for w, _, _ in parts])
        self.words, back = np.unique(every, return_inverse=True)
        at, columns = 0, [[] for _ in range(plan.order)]
        for w, local, _ in parts:
            mine = back[at : at + len(w)].astype(np.int32)
            at += len(w)
            for out, c in zip(columns, local, strict=True):
                out.append(mine[c.astype(np.int64)])
        self.columns = [np.concatenate(c) for c in columns]
        trained = np.concatenate([t for _, _, t in parts]).astype(np.float64)
        parts.clear()
        del every, back, columns
        size = len(self.words)
        self.ids, self.of, self.links = [], [], []
        key, before = self.columns[0].astype(np.int64), None
        for k in range(plan.order):
            if k:
                key = before.astype(np.int64) * size + self.columns[k]
            values, before = np.unique(key, return_inverse=True)
            before = before.astype(np.int32)
            self.ids.append(before)
            self.of.append(np.bincount(before, weights=trained, minlength=len(values)).astype(np.int64))
            self.links.append((values // size, values % size) if k else (values, values))
        hot, slot = plan.known(self.words[self.links[0][0]])
        self.of[0][hot] = plan.hot_counts[slot[hot]]

    def table(self) -> bytes:
        """The trained n-grams: words; last word and count; and for longer ones shorter n-gram, added word, count."""
        out, renamed = [self.words], None
        for k, ((link, added), count) in enumerate(zip(self.links, self.of, strict=True)):
            live = np.flatnonzero(count > 0)
            if k:
                out.append(renamed[link[live]].astype(np.uint64))
            out += [added[live].astype(np.uint64), count[live].astype(np.uint64)]
            renamed = np.cumsum(count > 0) - 1
        return pack(*out)


def _table_rows(blob: bytes, order: int) -> tuple[np.ndarray, list[list[np.ndarray]], list[np.ndarray], list[np.ndarray]]:
    """Words; for each k the columns of its k-grams, their counts, and the counts of the next shorter ones."""
    word, *rest = unpack(blob)
    columns, counts, shorter = [[rest[0].astype(np.int64)]], [rest[1].astype(np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, order):
        link, added, count = (x.astype(np.int64) for x in rest[3 * k - 1 : 3 * k + 2])
        columns.append([*(c[link] for c in columns[-1]), added])
        shorter.append(counts[-1][link])
        counts.append(count)
    return word.astype(np.uint64), columns, counts, shorter


def _chain(words_: list[np.ndarray]) -> np.ndarray:
    """The name of each context: a hash of its words, the last first."""
    out = words_[0]
    for w in words_[1:]:
        out = join_hashes(out, w)
    return out


def _count(plan: Plan):
    """Of each part's n-grams: their table, how many have each small count, the levels of the texts' tokens, and requests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in grouped(batches, ("key", "kind", "chunk", "blob")):
            yield from batches_of([("docs", chunk, chunk, blob) for kind, chunk, blob in rows if kind == "docs"], 16)
            stored = [blob for kind, _, blob in rows if kind == "ngrams"]
            parts, sizes, codes, chunks = [], [], [], []
            for blob in stored:
                word, columns, counts, _ = _table_rows(blob, plan.order)
                parts.append((word, columns[-1], counts[-1]))
            given = sum(len(p[2]) for p in parts)
            for kind, chunk, blob in rows:
                if kind != "N":
                    continue
                word, *columns, times, code = unpack(blob)
                chunks.append(chunk)
                times = times.astype(np.int64)
                codes.append(code.astype(np.uint32))
                begin = np.cumsum(times) - times
                parts.append((word.astype(np.uint64), columns, np.add.reduceat(codes[-1] & 1, begin)))
                sizes.append(times)
            del rows[:]
            if not parts:
                continue
            counts = Counts(plan, parts)
            out = []
            if not stored:
                out.append(("ngrams", key, 0, counts.table()))
                # Words are counted whole in step 1, as a hot one's rows are in several parts.
                small = [np.bincount(np.minimum(c, CUT + 2), minlength=CUT + 3)[1 : CUT + 2] for c in counts.of[1:]]
                out.append(("stats", 0, 0, pack(*(s.astype(np.int64) for s in small))))
            by_row = [of[ids] for of, ids in zip(counts.of, counts.ids, strict=True)]
            level = np.zeros(len(by_row[0]), np.uint8)
            for k, c in enumerate(by_row):
                level[c > 0] = k + 1
            met = np.choose(level, [np.zeros(len(level), np.int64), *by_row])
            end = counts.words[counts.columns[0]] == END
            following = np.where(end, 0, by_row[plan.order - 2]) if plan.order > 1 else np.zeros(len(level), np.int64)
            at, lost = given, []
            for i, (chunk, times, code) in enumerate(zip(chunks, sizes, codes, strict=True)):
                s = slice(at, at + len(times))
                at += len(times)
                event = np.repeat(np.arange(s.start, s.stop), times)
                doc = code >> 1
                out.append(("tokens", chunk, chunk, pack(doc.astype(np.uint64), *(x[event].astype(np.uint64) for x in (level, met, by_row[0], following)))))
                down = np.flatnonzero(level[event] < plan.order)
                lost.append((event[down], doc[down], np.full(len(down), i, np.uint32)))
            if plan.order > 1 and lost:
                out += _requests(plan, counts, level, key, np.array(chunks, np.uint64), *(np.concatenate([x[i] for x in lost]) for i in range(3)))
            yield from batches_of(out, 64)

    return run


def _requests(plan: Plan, counts: Counts, level: np.ndarray, key: int, chunks: np.ndarray, row: np.ndarray, doc: np.ndarray, which: np.ndarray) -> list[tuple]:
    """ask: what the tokens of some rows (in documents of the which-th chunk) need of the contexts passed on the way down; often: the same of contexts that all know."""
    asked: list[tuple] = []
    for m in range(1, plan.order):  # contexts of m words, passed by tokens met at level m or below, or the ground of level m + 1
        names = _chain([counts.words[c[row]] for c in counts.columns[1 : m + 1]])
        passed = level[row] <= m
        ground = (level[row] == m + 1) & (m + 1 < plan.order)
        for mask, what in ((passed, FULL if m + 1 == plan.order else ALPHA), (ground, COUNT)):
            i = np.flatnonzero(mask)
            if len(i):
                first = counts.columns[1][row[i]]
                second = counts.columns[2][row[i]] if m > 1 else None
                often = plan.known(counts.words)[0][first] if m == 1 else np.zeros(len(i), bool)
                often |= names[i] == _chain([np.array([START])] * m)[0]
                asked.append((names[i], np.full(len(i), what, np.uint8), doc[i], which[i], plan.place(counts.words, first, second), often))
    if not asked:
        return []
    name, what, of, which, where, often = (np.concatenate([a[i] for a in asked]) for i in range(6))
    told = lambda i: pack(chunks, name[i], what[i], of[i].astype(np.uint64), which[i].astype(np.uint64))
    out = [("often", key, key, told(often))] if often.any() else []
    i = np.flatnonzero(~often)
    i = i[np.argsort(name[i])]
    i = i[np.argsort(where[i].astype(np.uint16 if plan.parts <= 1 << 16 else np.int32), kind="stable")]
    return out + [("ask", p, key, told(i[a:b])) for p, a, b in slices(where[i])]


def _contexts(plan: Plan, first: int, last: int):
    """The n-gram table's rows summed by context, to parts first to last: words, and of each class of counts (own and shorter) how many and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                word, columns, counts, shorter = _table_rows(blob, plan.order)
                out = []
                for k in range(1, plan.order):
                    context = columns[k][1:]
                    n2, n1 = counts[k], shorter[k]
                    # The part of a context's last word, or of its last two where that is hot.
                    where = plan.place(word, context[0], context[1] if k > 1 else None)
                    mine = np.flatnonzero((where >= first) & (where < last))
                    if not len(mine):
                        continue
                    context, n2, n1, where = [c[mine] for c in context], n2[mine], n1[mine], where[mine]
                    cls = np.minimum(n2, CUT + 1) * (CUT + 2) + np.minimum(n1, CUT + 1)
                    name = _one_key([*context, cls], max(len(word), (CUT + 2) ** 2))
                    order = _order(where, name)
                    new = np.flatnonzero(np.concatenate([[True], (name[order][1:] != name[order][:-1]) | (where[order][1:] != where[order][:-1])]))
                    n = np.diff(np.append(new, len(order)))
                    s2 = np.add.reduceat(np.where(n2 > CUT, n2, 0)[order], new)
                    s1 = np.add.reduceat(np.where(n1 > CUT, n1, 0)[order], new)
                    one = order[new]
                    for p, a, b in slices(where[one]):
                        i = one[a:b]
                        own, local = _own_words(word, [c[i] for c in context])
                        out.append((f"context{k}", p, key, pack(own, *(x.astype(np.uint64) for x in (*local, cls[i], n[a:b], s2[a:b], s1[a:b])))))
                yield from batches_of(out, 64)

    return run


def _sizes(cls: np.ndarray, n: np.ndarray, s2: np.ndarray, s1: np.ndarray) -> tuple[np.ndarray, ...]:
    """Classes of both counts, and the sums of both counts."""
    k2, k1 = cls // (CUT + 2), cls % (CUT + 2)
    return k2, k1, np.where(k2 > CUT, s2, n * k2), np.where(k1 > CUT, s1, n * k1)


class Weights:
    """The backoff weights of one part's contexts: by length, names, log10 alpha and log10 count, sorted by name."""

    def __init__(self, lengths: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.lengths = lengths

    @classmethod
    def of(cls, plan: Plan, discounts: list[np.ndarray], total: int, blobs: dict[int, list[bytes]]) -> Weights:
        lengths: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for m in range(1, plan.order):
            arrays = [unpack(b) for b in blobs.get(m, ())]
            if not arrays:
                lengths.append((np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)))
                continue
            names, shorter = [], []
            for a in arrays:
                context = [a[0].astype(np.uint64)[c.astype(np.int64)] for c in a[1 : m + 1]]
                names.append(_chain(context))
                shorter.append(_chain(context[:-1]) if m > 1 else context[0])
            k2, k1, c2, c1 = _sizes(*(np.concatenate([a[m + 1 + i] for a in arrays]).astype(np.int64) for i in range(4)))
            name, one, back = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
            count = np.bincount(back, weights=c2)
            left = np.bincount(back, weights=c2 * (1 - discounts[m][k2])) / count
            mass = np.bincount(back, weights=c1 * discounts[m - 1][k1])
            if m == 1:
                mass /= total
            else:
                less = np.concatenate(shorter)[one]
                before, _, log = lengths[m - 2]
                at = np.minimum(np.searchsorted(before, less), max(len(before) - 1, 0))
                ground = 10 ** log[at] if len(before) else np.ones(len(less))
                if m == 2:  # hot words are whole in the plan only
                    hot, slot = plan.known(less)
                    ground = np.where(hot, plan.hot_counts[slot] if len(plan.hot) else 1, ground)
                mass /= np.rint(ground)
            lengths.append((name, np.log10(left / np.maximum(1 - mass, 1e-12)), np.log10(count)))
        return cls(lengths)

    def pack(self) -> bytes:
        """Few contexts have a weight or a count of their own, so both are stored by value."""
        out = []
        for name, alpha, count in self.lengths:
            out.append(name)
            for v in (alpha, count):
                value, index = np.unique(v, return_inverse=True)
                out += [value, index.astype(np.uint64)]
        return pack(*out)

    @classmethod
    def unpack(cls, blob: bytes) -> Weights:
        a = unpack(blob)
        return cls([(a[i].astype(np.uint64), a[i + 1][a[i + 2].astype(np.int64)], a[i + 3][a[i + 4].astype(np.int64)]) for i in range(0, len(a), 5)])

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All contexts by name."""
        name, alpha, count = (np.concatenate([x[i] for x in self.lengths]) for i in range(3))
        order = np.argsort(name)
        return name[order], alpha[order], count[order]


def _answers(known: tuple[np.ndarray, np.ndarray, np.ndarray], blobs: list[bytes]) -> list[tuple]:
    """more, by chunk: per document the sum of what its requests ask for; contexts never trained add nothing."""
    names, alpha, count = known
    if not blobs or not len(names):
        return []
    asked = [unpack(b) for b in blobs]
    chunks = np.unique(np.concatenate([a[0].astype(np.int64) for a in asked]))
    which = np.concatenate([np.searchsorted(chunks, a[0].astype(np.int64))[a[4]] for a in asked])
    name, what, doc = (np.concatenate([a[i] for a in asked]) for i in range(1, 4))
    at = np.minimum(np.searchsorted(names, name.astype(np.uint64)), len(names) - 1)
    here = np.choose(what, [alpha[at] + count[at], alpha[at], -count[at]])
    room = int(doc.max(initial=0)) + 1
    one, back = np.unique(which * room + doc.astype(np.int64), return_inverse=True)
    value = np.bincount(back, weights=np.where(names[at] == name, here, 0.0))
    out = []
    for w, a, b in slices(one // room):
        c = int(chunks[w])
        out.append(("more", c, c, pack((one[a:b] % room).astype(np.uint64), value[a:b])))
    return out


def _back_off(plan: Plan, discounts: list[np.ndarray], total: int):
    """weights: those of the part's contexts (made, unless given); more: answers, by chunk; all: weights that every task gets."""
    common = [*plan.hot.tolist(), *(int(_chain([np.array([START])] * m)[0]) for m in range(1, plan.order))]
    common = np.array(sorted(set(common)), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in grouped(batches, ("key", "kind", "chunk", "blob")):
            given = [blob for kind, _, blob in rows if kind == "weights"]
            if given:
                weights = Weights.unpack(given[0])
            else:
                weights = Weights.of(plan, discounts, total, {m: [b for kind, _, b in rows if kind == f"context{m}"] for m in range(1, plan.order)})
            known = weights.joined()
            out = [] if given else [("weights", key, 0, weights.pack())]
            at = np.isin(known[0], common)
            if at.any() and not given:
                out.append(("all", 0, 0, pack(*(x[at] for x in known))))
            out += _answers(known, [blob for kind, _, blob in rows if kind == "ask"])
            yield from batches_of(out, 64)

    return run


def _often(known: tuple[np.ndarray, np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                yield from batches_of(_answers(known, [blob]), 64)

    return run


def discounts_of(counts: list[int]) -> np.ndarray:
    """d[0..CUT+1] from the numbers of types seen 1 to CUT+1 times; d[CUT+1] is that of larger counts."""
    n = [0, *counts]
    d = np.ones(CUT + 2)
    d[CUT + 1] = LARGE
    ratio = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        value = ((r + 1) * n[r + 1] / (n[r] * r) - ratio) / (1 - ratio) if n[r] and ratio < 1 else 0.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r  # too few types for Good-Turing: absolute discounting
    return d


@dataclass
class Model:
    """The tables of a trained model, and what all of it is normalised by.

    ngrams: rows (key, blob), one per part of the last words; weights: rows
    (key, blob), one per part of the contexts' last words.
    """

    plan: Plan
    discounts: list[np.ndarray]
    total: int
    types: int
    starts: int
    unknown: float
    ngrams: DataFrame
    weights: DataFrame
    common: tuple[np.ndarray, np.ndarray, np.ndarray]

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, held_out (true), n_tokens, n_known, train_tokens, base_score, score of any texts."""
        spark, plan = docs.sparkSession, self.plan
        scratch = Scratch(spark)
        df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("held_out"), F.col("text").cast("string").alias("__text"))
        asked = df.mapInArrow(_ngrams(plan, 0, plan.parts, True), COLUMNS)
        told = self.ngrams.select(F.lit("ngrams").alias("kind"), "key", F.lit(0).cast("long").alias("chunk"), "blob")
        met = scratch.cut(by_part(asked.unionByName(told), plan.parts).mapInArrow(_count(plan), COLUMNS), by="kind")
        asks = met.filter("kind = 'ask'").select("key", "kind", "chunk", "blob")
        weights = self.weights.select("key", F.lit("weights").alias("kind"), F.lit(0).cast("long").alias("chunk"), "blob")
        backed = scratch.cut(by_part(asks.unionByName(weights), plan.parts).mapInArrow(_back_off(plan, self.discounts, self.total), COLUMNS), by="kind")
        return self.finish(met, backed)

    def finish(self, met: DataFrame, backed: DataFrame) -> DataFrame:
        kind = lambda df, *kinds: df.filter(F.col("kind").isin(*kinds)).select("key", "kind", "blob")
        frequent = met.filter("kind = 'often'").select("chunk", "blob").mapInArrow(_often(self.common), COLUMNS)
        every = kind(met, "docs", "tokens").unionByName(kind(backed, "more")).unionByName(frequent.select("key", "kind", "blob"))
        return by_key(every, self.plan.parts).mapInArrow(_finish(self.plan.order, self.discounts, self.total, self.types, self.starts, self.unknown), RESULT)


def _log(count: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(count, 1).astype(np.float64))


def _finish(order: int, discounts: list[np.ndarray], total: int, types: int, starts: int, unknown: float):
    kept = np.concatenate([np.zeros((1, CUT + 2)), np.log10(np.array(discounts))])
    log_total = math.log10(total) if total else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, ("key", "kind", "blob")):
            ids, null, train, tokens = next(unpack(b) for kind, b in rows if kind == "docs")
            n = len(ids)
            base, score = np.zeros(n), np.zeros(n)
            known = np.zeros(n, np.int64)
            for kind, blob in rows:
                if kind == "tokens":
                    doc, level, met, word, following = unpack(blob)
                    # d(c) c, at the level where the token was met; what the lowest level divides by; the next full context's count.
                    value = np.where(level == 0, math.log10(unknown), kept[level, np.minimum(met, CUT + 1)] + _log(met))
                    value = np.where(level == 1, value - log_total, value) - _log(following)
                    score += np.bincount(doc, weights=value, minlength=n)
                    base += np.bincount(doc, weights=np.log10(word + 1.0), minlength=n)
                    known += np.bincount(doc[word > 0], minlength=n)
                elif kind == "more":
                    doc, value = unpack(blob)
                    score[doc] += value
            if order > 1 and total:
                score -= math.log10(starts)  # the start context of every text
            if not total:
                score[:] = 0.0
            base -= tokens.astype(np.float64) * math.log10(total + types + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, mask=null.astype(bool)),
                    pa.array(~train.astype(bool)),
                    pa.array(tokens.astype(np.int64)),
                    pa.array(known),
                    pa.array(np.full(n, total, np.int64)),
                    pa.array(base),
                    pa.array(score),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def train(spark: SparkSession, docs: DataFrame, order: int = ORDER, modulus: int = 7, remainder: int = 2) -> tuple[Model, DataFrame]:
    """The model of the rows whose crc32(id) mod `modulus` is not `remainder`, and the scores of all rows."""
    scratch = Scratch(spark)
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(modulus, remainder).alias("held_out"), F.col("text").cast("string").alias("__text"))
    size, starts = df.agg(F.sum(F.octet_length("__text")), F.count_if(~F.col("held_out"))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((size or 0) / 6 / PART_TOKENS))

    counted = scratch.cut(by_part(df.mapInArrow(_word_counts(parts), "key bigint, chunk bigint, blob binary"), parts).mapInArrow(_merge_words, "word bigint, n bigint"))
    stats = counted.agg(F.sum("n"), F.count("n"), *(F.count_if(F.col("n") == r) for r in range(1, CUT + 2)), F.sum(F.when(F.col("n") > CUT, F.col("n")))).first()
    total, types, large = stats[0] or 0, stats[1], stats[-1] or 0
    discounts = [discounts_of(list(stats[2:-1]))]
    unknown = (sum(stats[1 + r] * r * (1 - discounts[0][r]) for r in range(1, CUT + 1)) + large * (1 - LARGE)) / total if total else 1.0
    often = counted.filter(F.col("n") >= max(1, total // (2 * parts))).orderBy(F.col("n").desc(), "word").limit(HOT_MOST).collect()
    hot = {int(np.int64(r["word"]).astype(np.uint64)): r["n"] for r in often}
    if starts >= max(1, total // (2 * parts)):
        hot[int(START)] = starts
    names = sorted(hot)
    plan = Plan(order, parts, np.array(names, np.uint64), np.array([hot[h] for h in names], np.int64))
    scratch.drop(counted)

    # Long n-grams take more bytes, so they go in waves of parts, of which only one is under way.
    waves = [(f, t) for f, t in ((parts * w // order, parts * (w + 1) // order) for w in range(order)) if t > f]
    tables = [scratch.cut(by_part(df.mapInArrow(_ngrams(plan, f, t, i == 0), COLUMNS), t - f, f).mapInArrow(_count(plan), COLUMNS), by="kind") for i, (f, t) in enumerate(waves)]
    met = reduce(DataFrame.unionByName, tables)
    small = [unpack(r["blob"]) for r in met.filter("kind = 'stats'").select("blob").toLocalIterator()]
    for k in range(1, order):
        discounts.append(discounts_of(np.sum([s[k - 1] for s in small], axis=0).tolist() if small else [0] * (CUT + 1)))
    ngrams = met.filter("kind = 'ngrams'").select("key", "blob")
    asks = met.filter("kind = 'ask'").select("key", "kind", "chunk", "blob")
    answers = []
    for f, t in waves:
        summed = ngrams.mapInArrow(_contexts(plan, f, t), COLUMNS).select("key", "kind", "chunk", "blob")
        met_here = by_part(summed.unionByName(asks.filter(F.col("key").between(f, t - 1))), t - f, f)
        answers.append(scratch.cut(met_here.mapInArrow(_back_off(plan, discounts, total), COLUMNS), by="kind"))
    backed = reduce(DataFrame.unionByName, answers)
    scratch.drop(*tables, kind="ask")
    shared = [unpack(r["blob"]) for r in backed.filter("kind = 'all'").select("blob").toLocalIterator()]
    common = [np.concatenate([s[i] for s in shared]) if shared else np.zeros(0) for i in range(3)]
    at = np.argsort(common[0])
    common = (common[0][at].astype(np.uint64), common[1][at], common[2][at])
    model = Model(plan, discounts, total, types, starts, unknown, ngrams, backed.filter("kind = 'weights'").select("key", "blob"), common)
    return model, model.finish(met, backed)


def score(spark: SparkSession, docs: DataFrame, order: int = ORDER, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    return train(spark, docs, order, modulus, remainder)[1]
