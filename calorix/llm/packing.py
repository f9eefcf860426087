"""Packing documents into sequences with lexical neighbours.

The terms of all documents are counted first. Each document goes to the nearest of the topics that
are fitted to some of them, and the documents are sorted into shards by topic and by a lexical key,
their heaviest terms by BM25 over the corpus, so related ones lie together; a topic or key of any
size is cut over shards. A shard holds a BM25 index of its documents, weighted by the counts of the
corpus; neighbours in other shards are not seen (the README has their share):
each seed document, the longest first, asks it for its unused neighbours, which fill the seed's
window in the order of their scores; the one that no longer fits is cut, and its rest stays unused. So every
window is full; what is left at the end of a shard is cut at powers of two.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.llm.base import query, shard_count, table
from calorix.llm.text import chunks, mix, ranges, span_hashes, text_bytes, word_spans
from calorix.session import collect_bounded, durable


@dataclass(frozen=True)
class PackRules:
    """window: tokens of a sequence; end_id: added to every document; shard_bytes: text of a shard;
    topics, topic_rows, topic_width: number of topics, documents they are fitted to, size of their
    vectors; key_terms: terms of a lexical key; border_rows: documents a shard that its borders are
    drawn from; k1, b: of BM25; memo: words whose ids a task remembers."""

    window: int = 4096
    end_id: int = 2
    shard_bytes: int = 16_000_000
    topics: int = 64
    topic_rows: int = 8_000
    topic_width: int = 256
    key_terms: int = 4
    border_rows: int = 64
    k1: float = 1.2
    b: float = 0.75
    memo: int = 800_000


_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves,
    the others, in order, for the letters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()
_TAIL = b".,;:!?*#$%&|\"()"
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


class WordIds:
    """Token ids of the words of texts.

    Words are told apart by ASCII white space, which the vocabulary's pre-tokenizer drops, so a
    text's ids are those of its words in a row. Its pre-tokenizer also cuts between a letter or
    digit and marks, and it folds case, so a new word is looked up in lower case and as core and
    tail. Words that are known stand in a sorted array of 64-bit hashes with their ids: two of
    ``limit`` = 800,000 words share one with a chance of 2e-8.
    """

    def __init__(self, vocabulary: str, limit: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.limit = limit
        plain = self.tokenizer.to_str()
        #: whether words may be folded and cut: the rules below hold for this kind of vocabulary
        self.folds = all(
            x in plain
            for x in ('"Lowercase"', '"ByteLevel"', "[\\\\p{L}]+", "[^\\\\s\\\\p{L}\\\\p{N}]+")
        )
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.parts: dict[bytes, bytes] = {}
        self.keys = np.zeros(0, np.uint64)
        self.begin = self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.kind)

    def _encode(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode() for w in words]
        # a word of Latin letters is one pre-token, whose bytes the model can merge at once
        plain = [self.folds and _LATIN(t) is not None for t in texts]
        rest = [t for t, p in zip(texts, plain, strict=True) if not p]
        asked = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        tokenize, code = self.model.tokenize, "H" if self.kind.itemsize == 2 else "I"
        out = []
        for text, p in zip(texts, plain, strict=True):
            if not p:
                out.append(array(code, next(asked).ids).tobytes())
                continue
            letters = text.lower()
            if not letters.isascii():
                letters = letters.encode().decode("latin-1").translate(_BYTE_LETTERS)
            out.append(array(code, [t.id for t in tokenize(letters)]).tobytes())
        return out

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, those of their parts in a row; unknown parts are encoded at once."""
        cut, ask = [], set()
        for word in words:
            core = word.rstrip(_TAIL) if self.folds else word
            if core and core != word and core[-1:].isalnum() and b"<|" not in word:
                cut.append((core, word[len(core) :]))
            else:
                cut.append((word,))
            ask.update(x for x in cut[-1] if x not in self.parts)
        new = list(ask)
        self.parts.update(zip(new, self._encode(new), strict=True))
        parts = self.parts
        return [parts[x[0]] if len(x) == 1 else parts[x[0]] + parts[x[1]] for x in cut]

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Add words, which are not known, by their sorted keys."""
        found = self._of_words(words)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        begin = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), self.kind)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.size = (
            np.insert(x, at, y)
            for x, y in ((self.keys, keys), (self.begin, begin), (self.size, size))
        )

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where keys stand among the known ones, and which of them do."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        return at, known

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids before each text (and in total)."""
        if self.folds:
            lower = _LOWER[data]
            marked = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
            for text in np.unique(np.searchsorted(offsets, marked, "right") - 1):
                lower[offsets[text] : offsets[text + 1]] = data[offsets[text] : offsets[text + 1]]
            data = lower
        starts, ends, first = word_spans(data, offsets)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
        keys = span_hashes(data, starts, ends) + (ends - starts).astype(np.uint64)
        keys, place, number = np.unique(keys, return_index=True, return_inverse=True)
        at, known = self._places(keys)
        if not known.all():
            if len(self.keys) + int((~known).sum()) > self.limit:
                self.clear()
                known[:] = False
            new = place[~known]
            words = [data[a:b].tobytes() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            self._learn(keys[~known], words)
            at, _ = self._places(keys)
        counts = self.size[at][number]
        ids = self.ids[ranges(self.begin[at][number], counts)]
        return ids, np.concatenate([[0], np.cumsum(counts)])[first]


_known: dict[int, WordIds] = {}


def word_ids(vocabulary: str, limit: int) -> WordIds:
    """The words this worker process knows already, kept from task to task."""
    key = hash((vocabulary, limit))
    if key not in _known:
        _known[key] = WordIds(vocabulary, limit)
    return _known[key]


def token_ids(
    docs: DataFrame, vocabulary: str, id_col: str, text_col: str, rules: PackRules
) -> DataFrame:
    """``doc_id, ids`` (16 bits each, or 32 for large vocabularies) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    end = rules.end_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(sent.value, rules.memo)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                some = data[offsets[lo] : offsets[hi]]
                ids, at = words.of(some, offsets[lo : hi + 1] - offsets[lo])
                ids = np.insert(ids, at[1:], end)
                at = (at + np.arange(len(at))) * words.kind.itemsize
                out = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), hi - lo, [None, pa.py_buffer(at), pa.py_buffer(ids)]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], out.cast(pa.binary())], names=["doc_id", "ids"]
                )

    texts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
    )
    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, ids binary")


@dataclass(frozen=True)
class Corpus:
    """n: documents; mean: ids of one; df: by term, documents that hold it. Only what is left of a
    document after its full windows is looked up, and counted."""

    n: int
    mean: float
    df: np.ndarray


def _postings(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count, sorted; about a million ids at a time."""
    lengths = np.array([len(d) for d in docs], np.int64)
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo, hi in chunks(np.concatenate([[0], np.cumsum(lengths)])):
        both = np.repeat(np.arange(lo, hi) << 32, lengths[lo:hi])
        both |= np.concatenate(docs[lo:hi]).astype(np.int64)
        parts.append(np.unique(both, return_counts=True))
    both, tf = map(np.concatenate, zip(*parts, strict=True))
    return both >> 32, both & 0xFFFFFFFF, tf


def _rests(ids: pa.Array, kind: np.dtype, window: int) -> list[np.ndarray]:
    data, offsets = text_bytes(ids)
    flat, at = data.view(kind), offsets // kind.itemsize
    full = (at[1:] - at[:-1]) // window * window
    return [flat[a + n : b] for a, b, n in zip(at[:-1], at[1:], full, strict=True)]


def corpus_statistics(ids: DataFrame, kind: np.dtype, size: int, rules: PackRules) -> Corpus:
    """Counts over all documents; ``size`` is that of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the places after the terms count documents and ids
        counts = np.zeros(size + 2, np.int64)
        for batch in batches:
            docs = _rests(batch.column(0), kind, rules.window)
            counts[:size] += np.bincount(_postings(docs)[1], minlength=size)
            counts[size:] += len(docs), sum(map(len, docs))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["term", "n"])

    counted = ids.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = np.zeros(size + 2, np.int64)
    for term, n in collect_bounded(counted, size + 2, "terms"):
        counts[term] = n
    return Corpus(int(counts[size]), counts[size + 1] / max(1, counts[size]), counts[:size])


def _weights(tf: np.ndarray, terms: np.ndarray, lengths: np.ndarray, corpus: Corpus, rules: PackRules) -> np.ndarray:
    """BM25 weights of terms in documents of these lengths."""
    df = corpus.df[terms]
    norm = rules.k1 * (1 - rules.b + rules.b * lengths / max(1.0, corpus.mean))
    return np.log1p((corpus.n - df + 0.5) / (df + 0.5)) * tf * (rules.k1 + 1) / (tf + norm)


def lexical_keys(docs: list[np.ndarray], corpus: Corpus, rules: PackRules) -> np.ndarray:
    """The heaviest terms of every document that another one holds too, plus 1, in a row of
    ``key_terms``: the heaviest first, the smaller of equals; 0 where there are no more."""
    return _keys(*_weighted(docs, corpus, rules), len(docs), corpus, rules)


def _weighted(docs: list[np.ndarray], corpus: Corpus, rules: PackRules) -> tuple[np.ndarray, ...]:
    """Document, term and weight."""
    doc, terms, tf = _postings(docs)
    return doc, terms, _weights(tf, terms, np.array([len(d) for d in docs])[doc], corpus, rules)


def _keys(
    doc: np.ndarray, terms: np.ndarray, weight: np.ndarray, n: int, corpus: Corpus, rules: PackRules
) -> np.ndarray:
    kept = corpus.df[terms] > 1
    doc, terms, weight = doc[kept], terms[kept], weight[kept]
    out = np.zeros((n, rules.key_terms), np.int64)
    if not len(doc):
        return out
    held, first = np.unique(doc, return_index=True)
    sizes = np.diff(np.append(first, len(doc)))
    for k in range(rules.key_terms):
        most = np.maximum.reduceat(weight, first)
        hit = np.flatnonzero(weight == np.repeat(most, sizes))
        hit = hit[np.searchsorted(hit, first)]
        out[held, k] = np.where(most > 0, terms[hit] + 1, 0)
        weight[hit] = 0
    return out


def _vectors(
    doc: np.ndarray, terms: np.ndarray, weight: np.ndarray, n: int, rules: PackRules
) -> np.ndarray:
    """Weights of the terms, hashed to ``topic_width`` places with signs, of length 1."""
    mixed = terms * 2654435761 % (1 << 32)
    place = (mixed >> 8) % rules.topic_width
    sign = np.where(mixed >> 31, 1, -1)
    shape = n, rules.topic_width
    held = np.bincount(doc * shape[1] + place, weight * sign, n * shape[1]).reshape(shape)
    return held / np.maximum(np.linalg.norm(held, axis=1, keepdims=True), 1e-9)


def fit_topics(ids: DataFrame, corpus: Corpus, kind: np.dtype, rules: PackRules) -> np.ndarray:
    """Centres by k-means over about ``topic_rows`` distinct documents, each next to a near one."""
    h, held, full = F.xxhash64("ids"), F.col("ids"), rules.window * kind.itemsize
    some = ids.where(F.pmod(h, F.lit(-(-max(1, corpus.n) // rules.topic_rows))) == 0)
    start = F.floor(F.octet_length(held) / full).cast("int") * full + 1
    some = some.select(h.alias("h"), held.substr(start, F.lit(full)).alias("rest")).dropDuplicates(["h"])
    rows = some.orderBy("h").limit(rules.topic_rows).collect()
    if not rows:
        return np.zeros((1, rules.topic_width))
    docs = [np.frombuffer(r.rest, kind) for r in rows]
    points = _vectors(*_weighted(docs, corpus, rules), len(docs), rules)
    centres = points[: rules.topics]  # in the order of a hash
    for _ in range(8):
        near = (points @ centres.T).argmax(1)
        sums = [points[near == k].sum(0) for k in range(len(centres))]
        sizes = [max(np.linalg.norm(x), 1e-9) for x in sums]
        centres = np.array([x / n for x, n in zip(sums, sizes, strict=True)])
    order, left = [0], set(range(1, len(centres)))
    while left:
        order.append(max(sorted(left), key=lambda k: centres[order[-1]] @ centres[k]))
        left.remove(order[-1])
    return centres[order]


def _places(
    ids: pa.Array, corpus: Corpus, topics: np.ndarray, kind: np.dtype, salt: np.ndarray, rules: PackRules
) -> np.ndarray:
    """Where documents stand in the order of topic, lexical key and salt: bytes to be compared."""
    docs = _rests(ids, kind, rules.window)
    held = _weighted(docs, corpus, rules)
    topic = (_vectors(*held, len(docs), rules) @ topics.T).argmax(1)
    parts = [topic.astype(">u2"), _keys(*held, len(docs), corpus, rules).astype(">u4"), salt.astype(">u8")]
    width = 2 + 4 * rules.key_terms + 8
    rows = [np.ascontiguousarray(x).view(np.uint8).reshape(len(docs), -1) for x in parts]
    return np.ascontiguousarray(np.hstack(rows)).view(f"S{width}").ravel()


def _salts(n: int, row: int) -> np.ndarray:
    """A number for each of the task's rows from ``row`` on, so that equal documents are spread."""
    return mix(np.arange(row, row + n, dtype=np.uint64) + (np.uint64(TaskContext.get().partitionId()) << np.uint64(40)))


def in_shards(ids: DataFrame, corpus: Corpus, kind: np.dtype, shards: int, rules: PackRules) -> DataFrame:
    """``shard, doc_id, ids``, a shard a partition, by topic and lexical key; equal rows are spread.

    Shards are ranges of about the same number of bytes. Their borders come from some
    ``border_rows`` documents a shard; every document is then placed between them.
    """
    context = ids.sparkSession.sparkContext
    sent = context.broadcast((corpus, fit_topics(ids, corpus, kind, rules)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        row = 0
        for batch in batches:
            corpus, topics = sent.value
            salt = _salts(len(batch), row)
            row += len(batch)
            yield batch, _places(batch.column(1), corpus, topics, kind, salt, rules)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, place in placed(batches):
            size = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(place.tolist(), pa.binary()), size], names=["place", "size"])

    borders = np.zeros(0, "S1")
    if shards > 1:
        most = rules.border_rows * shards
        h = F.xxhash64(F.monotonically_increasing_id())
        some = ids.where(F.pmod(h, F.lit(max(1, corpus.n // most))) == 0)
        rows = collect_bounded(some.mapInArrow(sample, "place binary, size long"), 4 * most + 1000, "borders")
        place = np.array([bytes(r[0]) for r in rows], f"S{2 + 4 * rules.key_terms + 8}")
        order = np.argsort(place, kind="stable")
        size = np.cumsum(np.array([r[1] for r in rows], np.int64)[order])
        if len(order):
            share = np.arange(1, shards) * (size[-1] / shards)
            borders = place[order][np.minimum(np.searchsorted(size, share), len(order) - 1)]
    cuts = context.broadcast(borders)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, place in placed(batches):
            shard = np.searchsorted(cuts.value, place, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], names=["shard", "doc_id", "ids"])

    kept = dict(ids.dtypes)["doc_id"]
    return ids.mapInArrow(deal, f"shard int, doc_id {kept}, ids binary").repartitionById(shards, "shard")


class Neighbours:
    """Inverted BM25 index of documents, by the counts of ``corpus`` or else of these documents.

    Each term has a list of documents and weights. A seed reads the lists of its own terms; those
    that hold over an eighth of the documents are rows of a matrix, which it sums by a product.
    """

    def __init__(self, docs: list[np.ndarray], rules: PackRules, corpus: Corpus | None = None):
        lengths = np.array([len(d) for d in docs])
        doc, terms, tf = _postings(docs)
        df = np.bincount(terms, minlength=1)
        corpus = corpus or Corpus(len(docs), lengths.mean() if len(docs) else 1.0, df)
        weight = _weights(tf, terms, lengths[doc], corpus, rules)
        # a term of one document here finds nothing
        shared = df[terms] > 1
        number = np.cumsum(df > 1) - 1
        self.members = self.place = np.arange(len(docs))
        self._fill(doc[shared], number[terms[shared]], weight[shared])

    def _fill(self, doc: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> None:
        n = len(self.members)
        df = np.bincount(terms, minlength=1)
        self.doc, self.terms, self.own_weight = doc, terms, weight
        self.first = np.searchsorted(doc, np.arange(n + 1))
        wide = 8 * df > n
        self.row = np.where(wide, np.cumsum(wide) - 1, -1)
        held = wide[terms]
        self.matrix = np.zeros((int(wide.sum()), n))
        self.matrix[self.row[terms[held]], doc[held]] = weight[held]
        doc, terms, weight = doc[~held], terms[~held], weight[~held]
        order = np.argsort(terms.astype(np.uint16) if len(df) <= 1 << 16 else terms, kind="stable")
        self.listed, self.weight = doc[order], weight[order]
        self.at = np.concatenate([[0], np.cumsum(np.where(wide, 0, df))])

    def among(self, unused: np.ndarray) -> Neighbours:
        """The same index of its unused documents only."""
        kept = unused[self.members]
        out = object.__new__(Neighbours)
        out.members = self.members[kept]
        out.place = np.full(len(unused), -1)
        out.place[out.members] = np.arange(len(out.members))
        held = kept[self.doc]
        number = np.cumsum(kept) - 1
        out._fill(number[self.doc[held]], self.terms[held], self.own_weight[held])
        return out

    def scores(self, seed: int) -> np.ndarray:
        """Of every member with all terms of the seed."""
        at = self.place[seed]
        own = self.terms[self.first[at] : self.first[at + 1]]
        rows = self.row[own]
        asked = np.zeros(len(self.matrix))
        asked[rows[rows >= 0]] = 1
        own = own[rows < 0]
        some = ranges(self.at[own], self.at[own + 1] - self.at[own])
        return asked @ self.matrix + np.bincount(self.listed[some], self.weight[some], len(self.members))

    def of(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents with a common term, the best match first, the first of equals."""
        score = self.scores(seed)
        score[~unused[self.members]] = 0
        many, done = 64, 0
        while True:
            least = -np.partition(-score, many)[many] if many < len(score) else 0.0
            top = np.flatnonzero((score >= least) & (score > 0))
            top = top[np.argsort(-score[top], kind="stable")]
            yield from self.members[top[done:]].tolist()
            if least <= 0:
                return
            many, done = 8 * many, len(top)


def pack_shard(
    docs: list[np.ndarray], rules: PackRules, corpus: Corpus | None = None
) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of a shard."""
    window, pieces, sequence = rules.window, [], 0
    start = np.zeros(len(docs), np.int64)
    left = np.array([len(d) for d in docs], np.int64)
    for d in np.flatnonzero(left >= window):
        while left[d] >= window:
            pieces.append((int(d), int(start[d]), window, sequence, 0))
            start[d], left[d], sequence = start[d] + window, left[d] - window, sequence + 1
    index = Neighbours([x[s:] for x, s in zip(docs, start, strict=True)], rules, corpus)
    unused = left > 0
    seeds = np.argsort(-left, kind="stable").tolist()
    total, at = int(left.sum()), 0
    start, left = start.tolist(), left.tolist()

    def put(d: int, size: int, offset: int) -> None:
        pieces.append((d, start[d], size, sequence, offset))
        start[d], left[d] = start[d] + size, left[d] - size
        unused[d] = left[d] > 0

    while total >= window:
        while not unused[seeds[at]]:
            at += 1
        if 4 * np.count_nonzero(unused) < 3 * len(index.members):
            index = index.among(unused)
        seed, used = seeds[at], left[seeds[at]]
        put(seed, used, 0)
        for d in index.of(seed, unused):
            size = min(left[d], window - used)
            put(d, size, used)
            used += size
            if used == window:
                break
        rest = at
        while used < window:
            # nothing left that shares a term: the next documents in order
            while not unused[seeds[rest]]:
                rest += 1
            size = min(left[seeds[rest]], window - used)
            put(seeds[rest], size, used)
            used += size
        total -= window
        sequence += 1
    # the rest of the shard in sequences of powers of two, which need no padding
    size, used = 1 << max(0, total.bit_length() - 1), 0
    for d in seeds:
        while unused[d]:
            some = min(left[d], size - used)
            put(d, some, used)
            used, total = used + some, total - some
            if used == size:
                sequence, used, size = sequence + 1, 0, 1 << max(0, total.bit_length() - 1)
    return pieces


PIECES = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " token_ids binary"
)


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: PackRules | None = None,
) -> DataFrame:
    """One row per piece: ``doc_id`` (of the type of ``id_col``), a run of a document's ids and its
    place in a sequence.

    ``vocabulary`` is the text of a tokenizers file. Every id of every row lies in one piece;
    null and empty texts consist of the end id. Repeated rows are packed each for itself, rows with
    a null id too. Sequences hold ``window`` ids, the last ones of a shard a power of two.
    ``token_ids`` holds the ids (16 or 32 bits, little-endian). An empty table gives no pieces.
    """
    rules = rules or PackRules()
    shards = shard_count(docs, text_col, rules.shard_bytes)
    words = WordIds(vocabulary, 0)
    kind, size = words.kind, words.tokenizer.get_vocab_size()
    ids = durable(token_ids(docs, vocabulary, id_col, text_col, rules), "token-ids")
    corpus = corpus_statistics(ids, kind, size, rules)
    sent = docs.sparkSession.sparkContext.broadcast(corpus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            yield pack(pa.Table.from_batches(held))

    def pack(rows: pa.Table) -> pa.RecordBatch:
        shard = rows.column("shard")[0].as_py()
        rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("ids", "ascending")]))
        data, offsets = text_bytes(rows.column("ids"))
        flat, at = data.view(kind), offsets // kind.itemsize
        pieces = pack_shard([flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], rules, sent.value)
        d, start, length, sequence, offset = np.array(pieces, np.int64).reshape(-1, 5).T
        ends = at[d] + start + length
        cut = [flat[a:b] for a, b in zip(ends - length, ends, strict=True)]
        columns = {
            "doc_id": rows.column("doc_id").combine_chunks().take(pa.array(d)),
            "start": pa.array(start),
            "length": pa.array(length),
            "ids_crc32": pa.array([zlib.crc32(x.astype("<u4")) for x in cut], pa.int64()),
            "doc_tokens": pa.array(np.diff(at)[d]),
            "sequence_id": pa.array((shard << 32) + sequence),
            "offset": pa.array(offset),
            "token_ids": pa.array([x.tobytes() for x in cut], pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    dealt = in_shards(ids, corpus, kind, shards, rules)
    return dealt.mapInArrow(run, f"doc_id {dict(ids.dtypes)['doc_id']}, {PIECES}")


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text()


@query("op8_packing")
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pack_documents(docs, public_vocabulary()).drop("token_ids")
