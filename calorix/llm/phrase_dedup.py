"""Repeated passages by phrase automata.

1. Confirm recurring phrases. Of the eight-word phrases of each 35-word window the one with the
   least hash is its anchor; two equal windows have equal anchors, so a window can only recur if
   its anchor does. Only anchors, a few per cent of all phrases, are shuffled and counted.
2. Documents are dealt over shards of about the same size. A shard compiles the recurring phrases
   it holds into an Aho-Corasick automaton and streams its documents through it, which locates
   every occurrence; the windows around them are hashed and counted over all shards.
3. The shard removes every word that a recurring window covers.

A phrase or window that most documents hold is counted once per task and shard, so no key and no
shard grows with the frequency of a passage, and the automata together grow with the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.llm.base import query, recurring, shard_count, table
from calorix.llm.text import (
    chunks,
    counted,
    span_hashes,
    text_bytes,
    window_minima,
    windows,
    word_spans,
)


@dataclass(frozen=True)
class PhraseRules:
    """size: words of a window; phrase: words of an anchor; shard_bytes: text of a shard."""

    size: int = 35
    phrase: int = 8
    shard_bytes: int = 4_000_000


class Texts:
    """Words of a run of texts, their hashes, and the windows that lie inside one text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rules: PhraseRules):
        self.data, self.offsets, self.rules = data, offsets, rules
        self.starts, self.ends, self.first = word_spans(data, offsets)
        self.words = span_hashes(data, self.starts, self.ends)
        # windows that begin so near the end of a text that they would leave it are not valid
        n = max(0, len(self.words) - rules.size + 1)
        self.valid = np.ones(n, bool)
        last = self.first[1:]
        edge = np.zeros(len(self.words) + 1, np.int64)
        counts = np.diff(self.first)
        cut = np.minimum(counts, rules.size - 1)
        np.add.at(edge, last - cut, 1)
        np.add.at(edge, last, -1)
        self.valid &= np.cumsum(edge)[:n] == 0

    def phrases(self) -> np.ndarray:
        return windows(self.words, self.rules.phrase)

    def anchors(self, phrases: np.ndarray) -> np.ndarray:
        """For each window the place of its anchor."""
        return window_minima(phrases, self.rules.size - self.rules.phrase + 1)

    def windows(self) -> np.ndarray:
        return windows(self.words, self.rules.size)

    def text_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, "right") - 1


def _located(texts: Texts, phrases: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each place begins an occurrence of a wanted phrase.

    ``wanted`` are hashes of phrases that occur in these texts; their words are read at one
    occurrence, compiled into an automaton over word numbers, and the texts streamed through it.
    """
    hit = np.zeros(len(phrases), bool)
    if not len(wanted) or not len(phrases):
        return hit
    held, at = np.unique(phrases, return_index=True)
    at = at[np.isin(held, wanted)]
    letters = (texts.words >> np.uint64(33)).astype(np.int64).tolist()
    size = texts.rules.phrase
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for a in at.tolist():
        automaton.add_word(tuple(letters[a : a + size]))
    if not len(automaton):
        return hit
    automaton.make_automaton()
    found = [end - size + 1 for end, _ in automaton.iter(tuple(letters))]
    hit[found] = True
    return hit


def sharded(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int, also: list | None = None) -> DataFrame:
    """``shard, doc_id, text`` and the columns ``also``; rows are dealt by a hash of id and text."""
    shards = shard_count(docs, text_col, shard_bytes)
    key = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(shards)).cast("int")
    return docs.select(
        key.alias("shard"),
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        *(also or []),
    )


def recurring_windows(texts: DataFrame, rules: PhraseRules) -> DataFrame:
    """``shard, window``: hashes of the windows that occur twice or more, in the shards with them."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            shard = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(offsets):
                at = offsets[lo : hi + 1]
                read = Texts(data[at[0] : at[-1]], at - at[0], rules)
                phrases = read.phrases()
                place = np.unique(read.anchors(phrases)[read.valid])
                yield counted(phrases[place], shard[lo:hi][read.text_of(place)], "phrase")

    found = texts.select("shard", "text").mapInArrow(anchors, "phrase long, shard int, n long")
    phrases = recurring(found, "phrase")

    def around(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        wanted = right["phrase"].to_numpy().view(np.uint64)
        data, offsets = text_bytes(left["text"])
        for lo, hi in chunks(offsets) if len(wanted) else ():
            at = offsets[lo : hi + 1]
            read = Texts(data[at[0] : at[-1]], at - at[0], rules)
            phrases = read.phrases()
            hit = _located(read, phrases, wanted)
            place = read.anchors(phrases)
            keys = read.windows()[read.valid & hit[place]]
            out.append(keys)
        keys = np.concatenate([np.zeros(0, np.uint64), *out])
        shard = left["shard"][0].as_py() if len(left) else 0
        batch = counted(keys, np.full(len(keys), shard), "window")
        return pa.Table.from_batches([batch])

    near = texts.groupBy("shard").cogroup(phrases.groupBy("shard"))
    return recurring(near.applyInArrow(around, "window long, shard int, n long"), "window")


def remove_phrases(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: PhraseRules | None = None,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row; ``kept`` has one blank between words.

    Removed is each word in a window of ``size`` words whose words also stand, in that order, at
    another place of any text, the same one included; equal means equal 64-bit hashes. Windows
    are judged on the input. Null and empty texts have no words; of repeated rows all copies go.
    """
    rules = rules or PhraseRules()
    texts = sharded(docs, id_col, text_col, rules.shard_bytes)
    found = recurring_windows(texts, rules)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = np.sort(right["window"].to_numpy().view(np.uint64))
        data, offsets = text_bytes(left["text"])
        n_words, n_removed, kept = [], [], []
        for lo, hi in chunks(offsets):
            at = offsets[lo : hi + 1]
            part = data[at[0] : at[-1]]
            read = Texts(part, at - at[0], rules)
            gone = np.zeros(len(read.words) + 1, np.int64)
            if len(wanted):
                keys = read.windows()
                near = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                start = np.flatnonzero(read.valid & (wanted[near] == keys))
                gone[start] += 1
                np.add.at(gone, start + rules.size, -1)
            gone = np.cumsum(gone)[:-1] > 0
            n_words.append(np.diff(read.first))
            total = np.concatenate([[0], np.cumsum(gone)])
            n_removed.append(np.diff(total[read.first]))
            raw = part.tobytes()
            for i in range(hi - lo):
                words = raw[at[i] - at[0] : at[i + 1] - at[0]].split()
                if n_removed[-1][i]:
                    stay = np.flatnonzero(~gone[read.first[i] : read.first[i + 1]])
                    words = [words[k] for k in stay.tolist()]
                kept.append(b" ".join(words))
        empty = np.zeros(0, np.int64)
        return pa.table(
            {
                "doc_id": left["doc_id"],
                "n_words": pa.array(np.concatenate([empty, *n_words]), pa.int64()),
                "n_removed": pa.array(np.concatenate([empty, *n_removed]), pa.int64()),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    near = texts.groupBy("shard").cogroup(found.groupBy("shard"))
    kind = dict(docs.dtypes)[id_col]
    return near.applyInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string")


#: Words of every text, windows of 35 words that start twice, and the words outside all of them.
SQL = """
WITH texts AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''),
        '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS w FROM documents),
    starts AS MATERIALIZED (
        SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s
        FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM texts WHERE len(w) >= 35)),
    again AS (SELECT s FROM starts GROUP BY s HAVING count(*) > 1),
    gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM starts SEMI JOIN again USING (s)),
    lost AS (SELECT r, list(i) AS places FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
    sha256(array_to_string(CASE WHEN places IS NULL THEN w
        ELSE list_filter(w, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM texts LEFT JOIN lost USING (r)
"""


@query("op9_substring_dedup", SQL)
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What every document loses of its repeated passages."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return remove_phrases(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
