"""Evaluation texts leaking into training text (problem 7).

Each shard (a block of training texts) gets a suffix array over its words; all
test suffixes are binary-searched in it, which yields every verbatim match of
EXACT words; ``places`` has the longest one of each case with its length and
place. The array is sparse: a training suffix is in it only if
its first words are a gram of some test item, as no other suffix can match.
Items leak verbatim (EXACT words in a row) or altered; altered copies have
verbatim seeds too, and the few candidates are then aligned exactly.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

EXACT = 12  # consecutive words that make a case
EDITS = 6  # one edit in so many words is tolerated
PART = 2  # one half of the item's words at least
WINDOW = 32  # words of a suffix that the array sorts by
SHARD = 1_000_000  # words of a shard
ITEM_WORDS = 2_000_000  # words of items that one scan looks for
PAIRS = 1_000_000  # matches looked at together
PLACE = ("words", "item_offset", "text_offset")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _WORD.findall((text or "").lower())


def spans(n: int) -> range:
    """Numbers of item words that an altered copy may follow."""
    return range(max(1, -(-n // PART)), n + 1)


def seed_words(n: int) -> int:
    """The longest run, up to 4 words, that every altered copy of an item of n
    words holds verbatim: m words with e edits leave m - e in e + 1 runs."""
    return min(4, *(-(-(m - m // EDITS) // (m // EDITS + 1)) for m in spans(n)))


def least_covered(n: int, k: int) -> int:
    """The fewest item words that an altered copy has in runs of k or more."""
    return max(k, min(m - m // EDITS * k for m in spans(n)))


def follows(item: np.ndarray, doc: np.ndarray) -> bool:
    """Whether a stretch of ``doc`` follows ``item`` within the tolerance.

    There must be item words i..j, j - i >= half of the item, and a stretch of
    the text at an edit distance (replaced, added, dropped words) of at most
    (j - i) / EDITS. All starts i are aligned side by side, row by row.
    """
    n, least = len(item), spans(len(item))[0]
    starts = np.arange(n - least + 1)
    across = np.arange(len(doc) + 1)
    d = np.full((len(starts), len(doc) + 1), 1 << 20, dtype=np.int32)
    for row in range(n):
        if row < len(starts):
            d[row] = 0  # the alignment that starts at this item word may start anywhere in the text
        live = d[: min(row + 1, len(starts))]
        new = live + 1  # dropped
        np.minimum(new[:, 1:], live[:, :-1] + (doc != item[row]), out=new[:, 1:])
        new = np.minimum.accumulate(new - across, axis=1) + across  # added
        d[: len(live)] = new
        span = row + 1 - starts[: len(live)]
        if ((span >= least) & (new.min(axis=1) * EDITS <= span)).any():
            return True
    return False


def longest_run(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """(words, item offset, text offset) of the longest common run, the first in the text and then in the item."""
    best = (0, 0, 0)
    ends = np.zeros(len(doc) + 1, dtype=np.int32)
    for row, w in enumerate(item.tolist()):
        ends[1:] = np.where(doc == w, ends[:-1] + 1, 0)
        at = int(ends.argmax())
        n = int(ends[at])
        if n and (n, -(at - n)) > (best[0], -best[2]):
            best = (n, row + 1 - n, at - n)
    return best


class Items:
    """The test side: words numbered from 1, every suffix, and the grams to look for."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids, texts = [], []
        for i, text in rows:
            w = words_of(text)
            if i is not None and w:
                self.ids.append(i)
                texts.append(w)
        self.number: dict[str, int] = {}
        for w in texts:
            for x in w:
                self.number.setdefault(x, len(self.number) + 1)
        self.words = [np.array([self.number[x] for x in w], dtype=np.int64) for w in texts]
        self.lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        seeds = {n: seed_words(n) for n in set(self.lengths.tolist())}
        self.seed = np.array([seeds[n] for n in self.lengths.tolist()], dtype=np.int64)
        self.least = np.array([least_covered(n, seeds[n]) for n in self.lengths.tolist()], dtype=np.int64)
        self.text = np.concatenate([np.r_[w, np.zeros(WINDOW, dtype=np.int64)] for w in self.words]) if texts else np.zeros(0, dtype=np.int64)
        begins = np.cumsum(np.r_[0, self.lengths[:-1] + WINDOW]) if texts else np.zeros(0, dtype=np.int64)
        self.item_at = np.repeat(np.arange(len(self.words)), self.lengths)
        self.offset = np.concatenate([np.arange(n) for n in self.lengths]) if texts else np.zeros(0, dtype=np.int64)
        self.at = begins[self.item_at] + self.offset if texts else np.zeros(0, dtype=np.int64)
        self.room = self.lengths[self.item_at] - self.offset if texts else np.zeros(0, dtype=np.int64)
        base = len(self.number) + 1
        self.base = base
        # Sorted tables of the items' grams of 1..4 words; a gram is the pair of its halves' places.
        self.kinds = sorted(set(self.seed.tolist()))
        self.pairs = self._table(self.text[:-1] * base + self.text[1:], (self.text[:-1] > 0) & (self.text[1:] > 0))

    @staticmethod
    def _table(keys: np.ndarray, ok: np.ndarray) -> np.ndarray:
        return np.unique(keys[ok])

    def grams(self, text: np.ndarray, k: int) -> np.ndarray:
        """For each place the number of its gram of k words, or -1 where no item has its pairs."""
        if k == 1:
            return np.where(text > 0, text, -1)
        if not len(self.pairs) or len(text) < k:
            return np.full(len(text), -1, dtype=np.int64)
        raw = text[:-1] * self.base + text[1:]
        place = np.minimum(np.searchsorted(self.pairs, raw), len(self.pairs) - 1)
        two = np.where((self.pairs[place] == raw) & (text[:-1] > 0) & (text[1:] > 0), place, -1)
        out = np.full(len(text), -1, dtype=np.int64)
        if k == 2:
            out[: len(two)] = two
        else:
            far = two[k - 2 :]
            near = two[: len(far)]
            out[: len(far)] = np.where((near >= 0) & (far >= 0), near * (len(self.pairs) + 1) + far, -1)
        return out


def _windows(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The WINDOW words from each place as byte strings whose order is that of the words."""
    padded = np.concatenate([text, np.zeros(WINDOW, dtype=text.dtype)]).astype(">u4")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[at]).view(f"S{4 * WINDOW}").ravel()


def _head(windows: np.ndarray, k: int, last: int) -> np.ndarray:
    """Windows cut to k words and filled with ``last``: a bound of their range in the array."""
    raw = windows.view(np.uint8).reshape(len(windows), 4 * WINDOW).copy()
    raw[:, 4 * k :] = last
    return raw.view(f"S{4 * WINDOW}").ravel()


def search(items: Items, docs: list[list[str]]) -> Iterator[tuple[int, int, int]]:
    """(document, item, longest verbatim run in words, EXACT at most) of one shard's cases."""
    get = items.number.get
    lengths = np.array([len(w) for w in docs], dtype=np.int64)
    begins = np.cumsum(np.r_[0, lengths[:-1] + WINDOW])
    text = np.zeros(int((lengths + WINDOW).sum()), dtype=np.int64)
    for b, w in zip(begins.tolist(), docs, strict=True):
        text[b : b + len(w)] = [get(x, 0) for x in w]
    exact: set[tuple[int, int]] = set()
    altered: dict[tuple[int, int], list[np.ndarray]] = {}
    for k in items.kinds:
        own = items.grams(items.text, k)
        wanted = np.unique(own[items.at[(items.seed[items.item_at] == k) & (items.room >= k)]])
        mine = items.grams(text, k)
        at = np.flatnonzero(mine >= 0)
        at = at[np.isin(mine[at], wanted)]
        if not len(at):
            continue
        windows = _windows(text, at)
        order = np.argsort(windows, kind="stable")
        array, places = windows[order], at[order]  # the shard's suffix array
        suffixes = np.flatnonzero((items.seed[items.item_at] == k) & (items.room >= k))
        mine_q = _windows(items.text, items.at[suffixes])
        lo, hi = np.searchsorted(array, _head(mine_q, k, 0), "left"), np.searchsorted(array, _head(mine_q, k, 255), "right")
        doc_of = np.searchsorted(begins, places, "right") - 1
        long = items.room[suffixes] >= EXACT
        lo12, hi12 = np.searchsorted(array, _head(mine_q[long], EXACT, 0), "left"), np.searchsorted(array, _head(mine_q[long], EXACT, 255), "right")
        for s, a, b in zip(suffixes[long].tolist(), lo12.tolist(), hi12.tolist(), strict=True):
            if b > a:
                exact.update((int(d), int(items.item_at[s])) for d in np.unique(doc_of[a:b]))
        for i in np.unique(items.item_at[suffixes]).tolist():
            own_s = np.flatnonzero(items.item_at[suffixes] == i)
            for key, windows_of in _candidates(items, i, suffixes[own_s], lo[own_s], hi[own_s], places, doc_of, begins).items():
                altered.setdefault((key, i), []).extend(windows_of)
    for d, i in sorted(exact):
        yield d, i, EXACT
    for (d, i), around in altered.items():
        if (d, i) in exact:
            continue
        doc = text[begins[d] : begins[d] + lengths[d]]
        if any(follows(items.words[i], doc[max(0, a) : b]) for a, b in around):
            yield d, i, 0


def _candidates(items: Items, i: int, suffixes, lo, hi, places, doc_of, begins) -> dict[int, list[tuple[int, int]]]:
    """Documents and windows in which enough of item i's words are covered by seeds.

    An altered copy lies within n // EDITS diagonals to either side of each of
    its seeds, so seeds are gathered in overlapping bands of diagonals.
    """
    n, k = int(items.lengths[i]), int(items.seed[i])
    slack = n // EDITS + 1
    band = 2 * slack
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    seen: dict[tuple[int, int], np.ndarray] = {}
    sizes = hi - lo
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(np.cumsum(sizes[start:]), PAIRS, "right")) + start)
        if not sizes[start:stop].any():
            start = stop
            continue
        take = np.repeat(lo[start:stop] - np.r_[0, np.cumsum(sizes[start:stop])[:-1]], sizes[start:stop]) + np.arange(sizes[start:stop].sum())
        q = np.repeat(items.offset[suffixes[start:stop]], sizes[start:stop])
        d = doc_of[take]
        diagonal = places[take] - begins[d] - q + n
        for shift in (0, 1):
            cell = diagonal // band * 2 if not shift else (diagonal + slack) // band * 2 + 1
            order = np.lexsort((q, cell, d))
            dd, cc, qq = d[order], cell[order], q[order]
            cut = np.flatnonzero(np.r_[True, (dd[1:] != dd[:-1]) | (cc[1:] != cc[:-1])])
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(dd)], strict=True):
                mask = seen.setdefault((int(dd[a]), int(cc[a])), np.zeros(n + k, dtype=bool))
                for j in range(k):
                    mask[qq[a:b] + j] = True
        start = stop
    for (d, c), mask in seen.items():
        if mask[:n].sum() >= items.least[i]:
            first = c // 2 * band - (slack if c % 2 else 0) - n
            out[d].append((first - slack, first + band + n + 2 * slack))
    return out


def _hits(documents: DataFrame, eval_items: DataFrame, located: bool) -> DataFrame:
    """(doc_id, item_id, verbatim) of each text's cases, with PLACE if ``located``."""
    spark = documents.sparkSession
    blocks: list[list] = [[]]
    size = 0
    for r in eval_items.select(F.col("item_id").cast("long"), F.col("item_text").cast("string")).toLocalIterator():
        n = len(r[1] or "") // 4 + 1
        if size + n > ITEM_WORDS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((r[0], r[1]))
        size += n
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null and doc_id is not null")
    slim = spread(slim, "doc_id")
    out = None
    for rows in blocks:
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value)
            ids: list[int] = []
            docs: list[list[str]] = []

            def flush() -> pa.RecordBatch:
                hits = list(search(items, docs)) if docs else []
                cols = {"doc_id": pa.array([ids[d] for d, _, _ in hits], pa.int64()), "item_id": pa.array([items.ids[i] for _, i, _ in hits], pa.int64()), "verbatim": pa.array([run > 0 for _, _, run in hits], pa.bool_())}
                if located:
                    runs = [longest_run(items.words[i], np.array([items.number.get(x, 0) for x in docs[d]], dtype=np.int64)) for d, i, _ in hits]
                    cols |= {c: pa.array([r[k] for r in runs], pa.int32()) for k, c in enumerate(PLACE)}
                made = pa.RecordBatch.from_pydict(cols)
                ids.clear(), docs.clear()
                return made

            total = 0
            for batch in batches:
                for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    w = words_of(text.as_py())
                    if total + len(w) > SHARD and docs:
                        yield flush()
                        total = 0
                    ids.append(i), docs.append(w)
                    total += len(w)
            yield flush()

        part = slim.mapInArrow(run, "doc_id long, item_id long, verbatim boolean" + "".join(f", {c} int" for c in PLACE) * located)
        out = part if out is None else out.unionByName(part)
    return out


def leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, verbatim): every text that holds part of an item, whole texts.

    ``verbatim`` tells whether EXACT words in a row match; other cases follow
    the item with alterations. The stated item set is searched in blocks of
    ITEM_WORDS words against all texts; it has to fit on the driver. Null and empty
    texts and items match nothing; items of very few words are found by runs
    as short as they are. Repeated items and texts each give their own rows.
    """
    return _hits(documents, eval_items, False).groupBy("doc_id", "item_id").agg(F.max("verbatim").alias("verbatim"))


def places(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, verbatim, words, item_offset, text_offset): the cases of ``leaks``
    with the longest run of words that text and item share, and where it begins
    in both, in words from 0; the first in the text, then in the item, among equals.
    """
    best = F.max(F.struct("words", -F.col("text_offset"), -F.col("item_offset"), "item_offset", "text_offset"))
    by = _hits(documents, eval_items, True).groupBy("doc_id", "item_id").agg(F.max("verbatim").alias("verbatim"), best.alias("b"))
    return by.select("doc_id", "item_id", "verbatim", *[F.col(f"b.{c}") for c in PLACE])


def without_leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """The documents that hold no part of any item."""
    return documents.join(leaks(documents, eval_items).select("doc_id").distinct(), "doc_id", "left_anti")
