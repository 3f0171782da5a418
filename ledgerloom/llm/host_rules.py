"""Quality rules with a verdict on whole hosts.

Every document is measured; rule failures are summed by host (the ``source``
column), the rates are shrunk by a beta prior fitted to all hosts, and a host
whose shrunk rate is above ``max_host_rate`` is rejected with its documents.

Null or empty text has no words and fails. A null source is no host: such
documents are judged by the rules alone. Rows are judged one by one, so
repeated rows and repeated or null IDs give a row each; further columns are
ignored (or, in ``accepted``, passed through). Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import common as C
from ledgerloom.runtime import durable

#: Base rules: fewer words, or a larger share (in %) of words in repeated windows, fail.
MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 10, 20, 5
#: Hosts above this shrunk failure rate are rejected.
MAX_HOST_RATE = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    starts, ends, before = C.words(data, offsets)
    inside = ~C.SPACE[data] & ((data & 0xC0) != 0x80)
    sums = C.prefix(data)
    # lines
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:] |= np.append(data == 10, False)[:-1]
    line_start = np.flatnonzero(edge[:-1]) if len(data) else np.zeros(0, np.int64)
    line_end = np.append(line_start[1:], len(data))[: len(line_start)]
    cut = (line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10) if len(line_start) else np.zeros(0, bool)
    text_end = line_end - cut
    owner = np.searchsorted(offsets, line_start, "right") - 1
    with_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, text_end, owner = line_start[with_word], text_end[with_word], owner[with_word]
    keys = C.mix(C.span_hash(sums, line_start, text_end) + C.mix(owner.astype(C.U64)))
    again = C.repeated(keys)
    _, first = np.unique(keys[again], return_index=True)
    later = np.ones(len(again), bool)
    later[first] = False
    dup_lines = np.bincount(owner[again[later]], minlength=len(offsets) - 1)
    # windows of words
    word_doc = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    runs = C.rolling(C.span_hash(sums, starts, ends), WINDOW)
    valid = np.flatnonzero(word_doc[: len(runs)] == word_doc[WINDOW - 1:]) if len(runs) else np.zeros(0, np.int64)
    again = valid[C.repeated(C.mix(runs[valid] + C.mix(word_doc[valid].astype(C.U64))))]
    cover = np.zeros(len(starts) + WINDOW, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    covered = np.cumsum(cover)[: len(starts)] > 0
    return [np.diff(before), C.per_document(inside, offsets), C.per_document(_SYMBOL[data], offsets), dup_lines,
            C.per_document(covered, before)]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    C.own("host_rules")
    for batch in batches:
        data, offsets = C.flat(batch.column("text"))
        parts = [_measure(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]) for a, b in C.steps(offsets)]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        columns = [pa.array(np.concatenate([p[i] for p in parts]) if parts else [], pa.int64()) for i in range(5)]
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in rest] + columns, names=rest + names)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, the measures and ``base_failed`` of every row."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    found = found.mapInArrow(_measured, f"doc_id long, source string, {MEASURES}")
    return found.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))


def host_rates(measured: DataFrame) -> DataFrame:
    """source, n, failures and the shrunk failure ``rate`` of every host.

    The prior is the beta distribution with the mean and the spread between
    hosts (moments, each host weighted by its rows); without any spread
    beyond chance the hosts share one rate.
    """
    hosts = measured.where("source is not null").groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    hosts = durable(hosts)
    s = hosts.agg(
        F.sum("n").alias("n"), F.sum("failures").alias("f"), F.count("*").alias("k"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("ff")).first()
    n, f, k = s["n"] or 0, s["f"] or 0, s["k"]
    mean = (f + 0.5) / (n + 1)
    between = max(0.0, (s["ff"] or 0.0) - f * f / n) if n else 0.0
    chance = mean * (1 - mean)
    room = (n - s["nn"] / n) if n else 0.0
    spread = (between - (k - 1) * chance) / room if room > 0 else 0.0
    strength = max(1.0, chance / spread - 1) if spread > chance * 1e-6 else 1e6
    return hosts.withColumn("rate", (F.col("failures") + mean * strength) / (F.col("n") + strength))


def judge(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The measures of every row with its host's rate and the verdict ``kept``."""
    measured = durable(measure(docs))
    rates = durable(host_rates(measured).select("source", F.col("rate").alias("host_rate")))
    return measured.join(rates, "source", "left").withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= max_host_rate))


def accepted(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Rows of ``docs`` that pass the rules and whose host does; all columns stay.

    The rules are measured again where the text is, so that no text is moved.
    """
    rejected = durable(host_rates(measure(docs)).where(F.col("rate") > max_host_rate).select(F.col("source").alias("_ll_host")))
    names = docs.columns
    schema = docs.select("*", F.lit(False).alias("_ll_kept")).schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.own("host_rules")
        for batch in batches:
            data, offsets = C.flat(batch.column("text"))
            kept = np.zeros(len(batch), bool)
            for a, b in C.steps(offsets):
                n, _, _, _, again = _measure(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                kept[a:b] = (n >= MIN_WORDS) & (100 * again <= MAX_REPEAT_PCT * n)
            yield batch.filter(pa.array(kept)).append_column("_ll_kept", pa.array(np.ones(kept.sum(), bool)))

    passed = docs.mapInArrow(keep, schema)
    return passed.join(rejected, passed["source"].cast("string") == F.col("_ll_host"), "left_anti").select(*names)
