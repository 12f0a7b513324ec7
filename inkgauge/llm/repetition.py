"""Repetition inside a single document (problem 8).

The kernel measures each text; the host-level rule then adds up the failures
of each source, shrinks its rate with a beta prior fitted to all sources, and
joins the verdict back to the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle, spread

#: Words of a run; percent of repeated words from which a text fails.
RUN, PERCENT = 8, 30
#: A source whose shrunk rate of failing texts is above this is marked.
HOST_RATE = 0.2
_WORD = re.compile(r"[^\W\d_]+")
_LINE = re.compile(r"^-[^\n]*", re.M)
#: Words that the kernel looks at together; a longer text is looked at alone.
BLOCK = 400_000


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, without the lines that begin with ``-``."""
    words = _WORD.findall(_LINE.sub("", text).lower())
    if text.isascii():
        return words
    # Beyond ASCII the pattern also takes signs like a superscript two, which are no letters.
    return [x for w in words for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers for the pairs (a, b): equal exactly where the pairs are."""
    both = a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b
    order = np.argsort(both, kind="stable")
    ordered = both[order]
    out = np.empty(len(both), dtype=np.int64)
    out[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]]) if len(both) else 0
    return out


def repeated_words(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many words of each text lie in a run of RUN words that began before in it.

    ``ids`` has the word numbers of the texts one after the other. Runs are
    numbered by doubling (1, 2, 4, 8 words), which is exact.
    """
    total = np.zeros(len(lengths), dtype=np.int64)
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = np.flatnonzero(np.arange(len(ids)) + RUN <= ends[doc]) if len(ids) else np.empty(0, dtype=np.int64)
    if not len(at):
        return total
    number, step = ids, 1
    while step < RUN:
        number = _pair(number[: len(number) - step], number[step:])
        step *= 2
    key = _pair(doc[at], number[at])
    order = np.argsort(key, kind="stable")
    again = order[1:][key[order][1:] == key[order][:-1]]
    size = len(ids) + 1
    marks = np.bincount(at[again], minlength=size) - np.bincount(at[again] + RUN, minlength=size)
    return np.bincount(doc[np.cumsum(marks[:-1]) > 0], minlength=len(lengths)).astype(np.int64)


def measure(documents: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, repeated) of every row; null texts have no words.

    Texts are taken whole. One pass, no shuffle, no rows in Python but the
    counts that leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, repeated = [], []
            ids: list[int] = []
            lengths: list[int] = []
            seen: dict[str, int] = {}

            def flush() -> None:
                repeated.extend(repeated_words(np.asarray(ids, dtype=np.int64), np.asarray(lengths, dtype=np.int64)).tolist())
                ids.clear(), lengths.clear(), seen.clear()

            for text in batch.column("text"):
                words = words_of(text.as_py() or "")
                if lengths and len(ids) + len(words) > BLOCK:
                    flush()
                number = seen.setdefault
                ids.extend([number(w, len(seen)) for w in words])
                lengths.append(len(words))
                n_words.append(len(words))
            flush()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n_words, pa.int64()), pa.array(repeated, pa.int64())], names=["doc_id", "source", "n_words", "repeated"])

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return spread(slim, "doc_id").mapInArrow(run, "doc_id long, source string, n_words long, repeated long")


def hosts(measured: DataFrame) -> DataFrame:
    """(source, texts, failing, rate, verdict) per source.

    The prior is a beta distribution with the mean and variance of the sources'
    own rates (by moments, over sources of two texts or more); its strength is
    kept between 1 and 1000 texts, and 1 where the rates don't vary. Null is a
    source of its own.
    """
    by = measured.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_if(fails()).alias("failing"))
    own = F.col("failing") / F.col("texts")
    m, v = F.coalesce(F.avg(F.when(F.col("texts") > 1, own)), F.sum("failing") / F.sum("texts")), F.coalesce(F.var_pop(F.when(F.col("texts") > 1, own)), F.lit(0.0))
    prior = by.agg(m.alias("_m"), v.alias("_v")).select("_m", F.when(F.col("_v") > 0, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.col("_m") * (1 - F.col("_m")) / F.col("_v") - 1))).otherwise(1.0).alias("_s"))
    one = F.broadcast(prior.withColumn("_one", F.lit(1)))  # a single row
    rate = (F.col("failing") + F.col("_m") * F.col("_s")) / (F.col("texts") + F.col("_s"))
    return by.withColumn("_one", F.lit(1)).join(one, "_one").select("source", "texts", "failing", rate.alias("rate")).withColumn("verdict", F.col("rate") > HOST_RATE)


def fails():
    return (F.col("n_words") > 0) & (F.col("repeated") * 100 >= PERCENT * F.col("n_words"))


def repetition(documents: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, repeated, share, repetitive, host_rate, host_marked).

    ``share`` is null where there are no words. ``repetitive`` is the text's
    own measure, ``host_marked`` the verdict on its source.
    """
    measured = settle(measure(documents))
    verdict = hosts(measured).select(F.col("source").alias("_s"), F.col("rate").alias("host_rate"), F.col("verdict").alias("host_marked"))
    joined = measured.join(verdict, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return joined.select("doc_id", "source", "n_words", "repeated", (F.col("repeated") / F.nullif("n_words", F.lit(0))).alias("share"), fails().alias("repetitive"), "host_rate", "host_marked")


def found(documents: DataFrame) -> DataFrame:
    return repetition(documents).filter("repetitive").select("doc_id").distinct()
