"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, and weighted votes.

Terms are words (runs of letters and digits, A-Z lower-cased) and stems (their first four and five bytes).  From a
bounded sample of labelled rows (``max_train`` rows, ``max_bytes`` of text; near copies count once in frequencies) every
word is indexed, and every stem that toxic rows hold significantly more often.  A term's weight is (1 + ln tf) idf times
its relevance: 1 for words and stems that toxic rows hold significantly more often, ``PLAIN`` for all others, so that one
abusive word decides who the neighbours of a long text are, and texts without one still have theirs.  All rows of the
sample are examples.

The index holds, per term, its postings in blocks of ``BLOCK`` examples and the largest weight of each block; examples
that are alike share blocks.  A query adds up the blocks' bounds, visits blocks from the highest bound on, a few at a
time, and stops when no bound reaches the k-th best cosine: the k nearest are exact, ties going to the smaller id.  The
neighbours vote with their cosines as weights, drawn toward the (smoothed) toxic share of sample rows without a relevant term.  The
score is that vote, calibrated by a logistic curve: it is fitted on the votes that a fifth of the sample gets from an
index of the other four.  Neighbours and cosines come along as evidence.

Defined results: null and empty texts, and texts that share no term with the sample, have no neighbours and get the
calibrated share as their score; repeated rows get equal scores; null ids stay null; without toxic sample rows every
score is 0.  Labels, language, source and id are no inputs of a score.  Other columns are not read (``kept`` passes them
through).

At scale: the model is bounded by ``max_train`` and ``max_bytes`` and is broadcast once; scoring is one map without a
shuffle, a text's work being bounded by the index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import labelled
from quern.llm.storage import modest_batches
from quern.llm.textcore import WORDY, Words, chunks, text_buffers, trim, trimmed

STEMS = (4, 5)
MAX_TRAIN, MAX_BYTES, NEIGHBOURS, BLOCK, PLAIN = 6000, 1 << 26, 15, 256, 0.01
#: Terms at most whose postings are also held as dense columns.
DENSE = 512
#: Bytes of text scored together: more visit a block together then.
SCORED_BYTES = 1 << 19
#: Rows whose bounds, and terms whose dense columns, are made at a time.
PART = 32


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, term hash, whether it is a word) of every occurrence."""
    words = Words(data, offsets, solid=WORDY)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    docs, out = [doc], [words.hash]
    for n in STEMS:
        long = words.end - words.start > n
        out.append(words.stretch(words.start[long], words.start[long] + n) ^ np.uint64(n))
        docs.append(doc[long])
    doc = np.concatenate(docs)
    return doc, np.concatenate(out), np.arange(len(doc)) < len(words.hash)


class Lookup:
    """Numbers of known 64-bit hashes, by open addressing."""

    def __init__(self, hashes: np.ndarray):
        self.bits = max(8, int(2 * len(hashes) + 1).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        at, left = (hashes >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            _, first = np.unique(at[free], return_index=True)  # of several for one slot, one takes it
            won = free[first]
            self.keys[at[won]], self.values[at[won]] = hashes[won], won
            left = left[self.values[at[left]] != left]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[at] == h, self.values[at], -1)
        left = np.flatnonzero((self.keys[at] != h) & (self.keys[at] != 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            key = self.keys[at[left]]
            hit = key == h[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (key != 0)]
        return out


def unit_rows(row: np.ndarray, term: np.ndarray, tf: np.ndarray, factor: np.ndarray, n_rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row its terms and unit weights; cells ascend by row and term."""
    weight = (1 + np.log(tf)) * factor[term] if len(term) else np.zeros(0)
    norm = np.sqrt(np.bincount(row, weight * weight, minlength=n_rows))
    weight = weight / norm[row]
    ends = np.searchsorted(row, np.arange(n_rows + 1))
    return [(term[a:b], weight[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def vectors(known: Lookup, factor: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per document its known terms and unit weights."""
    doc, h, _ = terms(data, offsets)
    number = known.find(h)
    hit = number >= 0
    n_docs, n_terms = len(offsets) - 1, max(1, len(factor))
    cell, tf = np.unique(doc[hit] * n_terms + number[hit], return_counts=True)
    return unit_rows(cell // n_terms, cell % n_terms, tf, factor, n_docs)


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one range after another, and the number of the range of each."""
    return _numbers(start, stop), np.repeat(np.arange(len(start)), stop - start)


def _numbers(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after another."""
    size = stop - start
    out = np.repeat(start - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


class BlockMaxIndex:
    """Postings of unit vectors by term and block, with each block's largest weight per term."""

    def __init__(self, ids: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        size = np.array([len(t) for t, _ in rows], np.int64)
        row = np.repeat(np.arange(len(rows), dtype=np.int32), size)
        term = np.concatenate([r[0] for r in rows] + [np.zeros(0, np.int32)]).astype(np.int32)
        weight = np.concatenate([r[1] for r in rows] + [np.zeros(0)])
        alike = self._alike(np.asarray(ids), row, term, weight, n_terms)
        alike = alike[np.lexsort((np.asarray(ids)[alike], np.arange(len(rows)) // block))]  # blocks ascend by id inside
        place = np.empty(len(rows), np.int32)
        place[alike] = np.arange(len(rows))
        self.block, self.n_blocks = block, -(-len(rows) // block)
        self.ids = np.empty(len(rows), np.int64)
        self.ids[place] = ids
        order = np.argsort(term * np.int64(max(1, len(rows))) + place[row], kind="stable")
        term, self.at, self.weight = term[order], place[row[order]], weight[order]
        del order, row, weight
        first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(self.at // block, prepend=-1) != 0))
        #: Of each term and block that meet: the block, its largest weight, and where its postings start.
        self.run_block, self.run_most = (self.at[first] // block).astype(np.int16), np.maximum.reduceat(self.weight, first) if len(first) else self.weight
        self.run_edge = np.append(first, len(term)).astype(np.int32)
        self.runs = np.searchsorted(term[first], np.arange(n_terms + 1))

    @staticmethod
    def _alike(ids: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int, seeds: int = 24) -> np.ndarray:
        """An order in which rows that are near to the same of a few seed rows lie together; it only makes visits fewer."""
        n = len(ids)
        near, best = np.zeros(n, np.int64), np.zeros(n)
        for k, s in enumerate(np.argsort(ids * 2654435761 % 4294967291, kind="stable")[:seeds].tolist()):
            own = np.zeros(n_terms)
            own[term[row == s]] = weight[row == s]
            cosine = np.bincount(row, weight * own[term], minlength=n)
            near, best = np.where(cosine > best, k + 1, near), np.maximum(cosine, best)
        return np.lexsort((ids, near))

    def ready(self) -> BlockMaxIndex:
        """Also holds the postings of the commonest terms as dense columns, block after block: they meet nearly all blocks."""
        if not hasattr(self, "panel"):
            size = np.diff(self.run_edge[self.runs].astype(np.int64))
            common = np.argsort(-size, kind="stable")[:DENSE]
            common = common[size[common] > len(self.ids) // 32]
            self.dense_of = np.full(len(size), -1)
            self.dense_of[common] = np.arange(len(common))
            self.panel = np.zeros((self.n_blocks, len(common), self.block))
            for a in range(0, len(common), PART):  # else all their postings' numbers are held at once
                some = common[a : a + PART]
                run, which = _ranges(self.runs[some], self.runs[some + 1])
                post, of = _ranges(self.run_edge[run], self.run_edge[run + 1])
                self.panel[self.at[post] // self.block, a + which[of], self.at[post] % self.block] = self.weight[post]
        return self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("panel", "dense_of")}

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the k examples of largest cosine above 0, and the cosines; ties to the smaller id."""
        return self.nearest_of([(term, weight)], k)[0]

    def nearest_of(self, rows: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of many unit vectors: those that visit the same block do so together."""
        self.ready()
        n, blocks = len(rows), self.n_blocks
        ends = np.concatenate(([0], np.cumsum([len(t) for t, _ in rows], dtype=np.int64)))
        doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(ends))
        term, weight = (np.concatenate([r[j] for r in rows] + [np.zeros(0)]) for j in (0, 1))
        term = term.astype(np.int64)
        column = self.dense_of[term]
        # a few rows' runs at a time: only those of terms without a dense column stay, by their numbers
        bounds, run, which = np.zeros((n, blocks)), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a in range(0, n, PART):
            b = min(n, a + PART)
            own = slice(int(ends[a]), int(ends[b]))
            runs, cell = _ranges(self.runs[term[own]], self.runs[term[own] + 1])
            cell += own.start
            bounds[a:b] = np.bincount((doc[cell] - a) * np.int64(blocks) + self.run_block[runs], weight[cell] * self.run_most[runs], minlength=(b - a) * blocks).reshape(b - a, blocks)
            rare = column[cell] < 0
            run.append(runs[rare].astype(np.int32))
            which.append(cell[rare])
        run, which = np.concatenate(run), np.concatenate(which)
        order = np.argsort(-bounds, axis=1, kind="stable")
        bounds = np.take_along_axis(bounds, order, 1)
        dense = np.zeros((n, self.panel.shape[1]))
        dense[doc[column >= 0], column[column >= 0]] = weight[column >= 0]
        by_block = np.argsort(self.run_block[run], kind="stable")
        run, which = run[by_block], which[by_block]
        edge = np.searchsorted(self.run_block[run], np.arange(blocks + 1))
        owner, own = doc[which], weight[which]
        del by_block, which
        best, best_at = np.full((n, k), -1.0), np.full((n, k), -1, np.int64)
        place = np.empty(n, np.int64)
        live, done, step = np.arange(n), 0, 2
        while done < blocks:
            may = (bounds[live] > 0) & (bounds[live] >= best[live, -1:] - 1e-9)
            live, may = live[may[:, done]], may[may[:, done], done : done + step]
            if not len(live):
                break
            at, turn = np.nonzero(may)
            visitor, visited = live[at], order[live[at], done + turn]
            by_block = np.argsort(visited, kind="stable")
            for x in np.split(by_block, np.flatnonzero(np.diff(visited[by_block])) + 1):
                who, b = visitor[x], int(visited[x[0]])
                place[:] = -1
                place[who] = np.arange(len(who))
                cosine = dense[who] @ self.panel[b]
                mine = edge[b] + np.flatnonzero(place[owner[edge[b] : edge[b + 1]]] >= 0)
                start, stop = self.run_edge[run[mine]].astype(np.int64), self.run_edge[run[mine] + 1]
                post = _numbers(start, stop)
                cell = np.repeat(place[owner[mine]] * self.block - b * self.block, stop - start) + self.at[post]
                cosine += np.bincount(cell, self.weight[post] * np.repeat(own[mine], stop - start), minlength=cosine.size).reshape(cosine.shape)
                self._offer(who, b, np.round(cosine, 12), best, best_at)
            done, step = done + step, step * 2
        return [(p[p >= 0], c[p >= 0]) for p, c in zip(best_at, best, strict=True)]

    def _offer(self, who: np.ndarray, b: int, cosine: np.ndarray, best: np.ndarray, best_at: np.ndarray) -> None:
        """Takes up a block's cosines; a block's examples ascend by id, so a stable sort leaves ties to the smaller id."""
        some = cosine.max(axis=1) >= np.maximum(best[who, -1], 1e-12)
        who, cosine = who[some], np.where(cosine[some] > 0, cosine[some], -1.0)
        if not len(who):
            return
        first = np.argsort(-cosine, axis=1, kind="stable")[:, : best.shape[1]]
        new = np.take_along_axis(cosine, first, 1)
        all_c = np.concatenate([best[who], new], axis=1)
        all_at = np.concatenate([best_at[who], np.where(new > 0, first + b * self.block, -1)], axis=1)
        keep = np.lexsort((self.ids[all_at], -all_c), axis=1)[:, : best.shape[1]]
        best[who] = np.take_along_axis(all_c, keep, 1)
        best_at[who] = np.take_along_axis(all_at, keep, 1)


@dataclass
class Model:
    """``hashes`` and ``factor`` of terms, the examples' index, their labels in its order, and the calibration."""

    hashes: np.ndarray
    factor: np.ndarray
    index: BlockMaxIndex | None
    toxic: np.ndarray
    floor: float
    k: int = NEIGHBOURS
    pull: float = 1.0
    curve: tuple[float, float] | None = None

    def ready(self) -> Model:
        if not hasattr(self, "known"):
            self.known = Lookup(self.hashes)
        return self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def votes(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each vector the vote, the neighbours' ids and their cosines."""
        none = np.zeros(0, np.int64), np.zeros(0)
        found = self.index.nearest_of(rows, self.k) if self.index is not None and rows else [none] * len(rows)
        return [(round(float((c @ self.toxic[at] + self.pull * self.floor) / (c.sum() + self.pull)), 12), self.index.ids[at], c) if len(at) else (self.floor, *none) for at, c in found]

    def calibrated(self, vote: float) -> float:
        if self.curve is None:
            return vote
        return float(1 / (1 + np.exp(-(self.curve[0] * _logit(vote) + self.curve[1]))))

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int], list[float]]]:
        return [(self.calibrated(vote), ids.tolist(), cosine.tolist()) for vote, ids, cosine in self.votes(rows)]


def _logit(p: float | np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def logistic_curve(votes: np.ndarray, toxic: np.ndarray, rounds: int = 50) -> tuple[float, float] | None:
    """Slope and offset of Platt's curve (with his smoothed targets) by Newton steps; None where a class is missing."""
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not n0:
        return None
    x = np.stack([_logit(votes), np.ones(len(votes))])
    y = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (p - y) + 1e-3 * (w - [1, 0]))
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else None


def distinct_rows(sets: list[np.ndarray], sketch: int = 16, same: int = 9) -> np.ndarray:
    """Numbers of rows that are no near copies of an earlier row (fewer than ``same`` of ``sketch`` minima agree)."""
    seeds = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, sketch, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    minima = np.zeros((len(sets), sketch), np.uint32)
    for i, s in enumerate(sets):
        if len(s):
            minima[i] = ((s[:, None] * seeds[None]) >> np.uint64(32)).min(0)
    kept: list[int] = []
    held = np.zeros_like(minima)
    for i in range(len(sets)):
        if not kept or (held[: len(kept)] == minima[i]).sum(1).max() < same:
            held[len(kept)] = minima[i]
            kept.append(i)
    return np.array(kept, np.int64)


def choose_terms(sets: list[np.ndarray], toxic: np.ndarray, z: float = 2.8, ratio: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """Terms that toxic rows hold significantly more often, and their document frequencies."""
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not sum(len(s) for s, y in zip(sets, toxic, strict=True) if y):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    many, c1 = np.unique(np.concatenate([s for s, y in zip(sets, toxic, strict=True) if y]), return_counts=True)
    c0 = np.zeros(len(many), np.int64)
    for s in (s for s, y in zip(sets, toxic, strict=True) if not y and len(s)):
        at = np.minimum(np.searchsorted(many, s), len(many) - 1)
        np.add.at(c0, at[many[at] == s], 1)
    odds = np.log((c1 + 0.5) / (n1 - c1 + 0.5)) - np.log((c0 + 0.5) / (n0 - c0 + 0.5))
    error = np.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))
    keep = (odds / error >= z) & (c1 * max(1, n0) >= ratio * c0 * n1) & (c1 >= 2)
    return many[keep], (c1 + c0)[keep]


def train(ids: np.ndarray, toxic: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> Model:
    """A model of rows given as (term hashes ascending, counts, whether they are words), not yet calibrated."""
    single = distinct_rows([s[0] for s in sets])
    relevant, _ = choose_terms([sets[i][0] for i in single], toxic[single])
    if not len(relevant):
        return Model(relevant, np.zeros(0), None, np.zeros(0), float(toxic.mean()) if len(toxic) else 0.0, k)
    hashes = relevant
    for i in range(0, len(sets), 256):
        hashes = np.union1d(hashes, np.concatenate([h[word] for h, _, word in sets[i : i + 256]]))
    # one row at a time, so that beside the index only its own terms are held
    cells, df, held = [], np.zeros(len(hashes), np.int64), np.zeros(len(sets), bool)
    strong = np.isin(hashes, relevant)
    for i, (h, count, _) in enumerate(sets):
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[at] == h
        cells.append((at[hit].astype(np.int32), count[hit]))
        held[i] = strong[at[hit]].any()
    for i in single:
        df[cells[i][0]] += 1
    factor = np.log((len(single) + 1) / (df + 0.5)) * np.where(strong, 1.0, PLAIN)
    rows = [unit_rows(np.zeros(len(t), np.int64), t, count, factor, 1)[0] for t, count in cells]
    index = BlockMaxIndex(ids, rows, len(hashes))
    label = dict(zip(ids.tolist(), toxic.tolist(), strict=True))
    return Model(hashes, factor, index, np.array([label[i] for i in index.ids.tolist()], float), float((toxic[~held].sum() + 0.5) / ((~held).sum() + 1)), k)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, k: int = NEIGHBOURS, label_col: str = "toxic", max_bytes: int = MAX_BYTES) -> Model:
    """Fits on at most ``max_train`` labelled rows of ``max_bytes`` in all; every other figure follows from them."""
    modest_batches(docs.sparkSession)
    rows = labelled.sample(docs, labels, label_col, max_train, max_bytes=max_bytes)

    def work(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            cells = []
            for a, b in chunks(offsets):
                doc, h, word = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                order = np.argsort(doc, kind="stable")
                ends = np.searchsorted(doc[order], np.arange(b - a + 1))
                for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    own, first, count = np.unique(h[order[x:y]], return_index=True, return_counts=True)
                    cells.append((own.tobytes(), count.astype("<u4").tobytes(), word[order[x:y]][first].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, pa.binary()) for c in (zip(*cells, strict=True) if cells else ([], [], [])))], names=["doc_id", "label", "terms", "counts", "words"])

    got = rows.select("doc_id", "text", "label").mapInArrow(trimmed(work), "doc_id long, label int, terms binary, counts binary, words binary").toArrow().sort_by("doc_id")
    cells = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind) for x in got.column(c)]  # noqa: E731  views, no copies
    sets = list(zip(cells("terms", np.uint64), cells("counts", "<u4"), cells("words", bool), strict=True))
    toxic, ids = got.column("label").to_numpy() == 1, got.column("doc_id").to_numpy()
    curve = cross_votes(ids, toxic, sets, k) if toxic.any() else None
    whole = train(ids, toxic, sets, k)
    whole.curve = curve if whole.index is not None else None
    del got, sets
    trim()  # the driver stays as large as it once was, otherwise
    return whole


def cross_votes(ids: np.ndarray, toxic: np.ndarray, sets: list, k: int) -> tuple[float, float] | None:
    """The calibration: votes for a fifth of the rows, by a hash of the id, from a model of the others."""
    fifth = np.argsort(np.argsort(ids * 2654435761 % 4294967291, kind="stable"), kind="stable") % 5 == 0
    part = train(ids[~fifth], toxic[~fifth], [s for s, f in zip(sets, fifth, strict=True) if not f], k)
    if part.index is None:
        return None
    votes = []
    for i in np.flatnonzero(fifth).tolist():
        h, count, _ = sets[i]
        at = np.minimum(np.searchsorted(part.hashes, h), len(part.hashes) - 1)
        hit = part.hashes[at] == h
        votes.append(part.votes(unit_rows(np.zeros(int(hit.sum()), np.int64), at[hit], count[hit], part.factor, 1))[0][0])
    return logistic_curve(np.array(votes), toxic[fifth])


def _scored(model: Model, column) -> tuple[list, list, list]:
    data, offsets = text_buffers(column)
    out = []
    for a, b in chunks(offsets, SCORED_BYTES):
        out += model.scores(vectors(model.known, model.factor, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
    return tuple(map(list, zip(*out, strict=True))) if out else ([], [], [])


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, evidence (neighbours' ids, nearest first) and their cosines."""
    modest_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            scores, ids, cosines = _scored(held.value.ready(), batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], names=["doc_id", "held_out", "score", "predicted", "evidence", "cosines"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), labelled.held_out(id_col).alias("held_out"))
    return rows.mapInArrow(trimmed(work, held), "doc_id long, held_out boolean, score double, predicted int, evidence array<long>, cosines array<double>")


def kept(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, unchanged."""
    modest_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            scores, _, _ = _scored(held.value.ready(), batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(trimmed(work, held), docs.schema)
