"""LM scoring with a log-frequency Bloom filter.

Counts of words and word pairs are quantised on a logarithmic scale, and an n-gram enters the filter once for each
level up to its own. Reading a count is probing level after level until one is missing. The filter grows with the
levels that were counted, so every word and every pair is in it at every size; each n-gram's bits lie in one segment, so
executors build the segments. A filter of 2**BROADCAST_BITS bits or less is broadcast. A larger one stays a table: pieces of text
send each segment one packed request for their different n-grams, the answers (a byte for each, and the exact counts of words) meet the texts again,
and no row is made for a pair.

p(w | u) interpolates the pair's share with the add-one unigram. A quantised numerator is its level's least
count and a denominator its level's largest, so quantisation alone never adds probability mass.

Exact unigram counts, for the base score, meet the tokens in an equi-join; only the HOT most frequent words are
broadcast, since they would make hot keys.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaloom.llm._shared import WordHasher, documents, fold_case, forget, mix, remove, share, share_bits, small_batches, text_chunks, training_part, view_bits, word_spans, write_out

#: 2**SEGMENTS segments of 2**LEAST_BITS bits (4 MB) or more; up to 2**BROADCAST_BITS bits (128 MB) are broadcast.
SEGMENTS, LEAST_BITS, BROADCAST_BITS = 12, 13, 30
PROBES = 6
BASE = 1.5
LAMBDA = 0.3
HOT = 65_536
#: Tokens that a counting task holds before it adds up equal n-grams, and bytes of text that one scoring step takes.
HELD, STEP = 3 << 19, 1 << 20
#: N-grams that are sent or added up at once (whole segments of them where they are added up), and that are read from the filter at once.
PARCEL, READ = 1 << 18, 1 << 14
#: Bytes of text that ask a filter too large to be broadcast together, and the base-2 logarithm of the rows that are shuffled as one.
PIECE, TOGETHER = 4 << 20, 10
_LENGTH, _FULL_SALTS = np.uint64(56), (np.uint64(0x3C6EF372FE94F82B), np.uint64(0xA54FF53A5F1D36F1))
#: The end of a text and what stands before its first token, as words of lengths that no word has.
_END, _START = mix(np.array([0, 255], dtype=np.uint64) << _LENGTH)
_IN_SEGMENT = np.uint64(64 - SEGMENTS)
_PARCELS = "segment int, word boolean, low binary, high binary, count binary"
_ASKED = ["words", "words_high", "pairs", "pairs_high"]
_WORD_SALT, _PAIR_SALT = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)
#: Least count of each level, the last one beyond all 64-bit counts.
_FLOORS = np.array(sorted({int(np.ceil(BASE**k)) for k in range(110)}), dtype=np.float64)
_LEVEL_SALTS = np.arange(len(_FLOORS) + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)


def level_of(count: np.ndarray) -> np.ndarray:
    """Levels 1, 2, ... of counts; 0 for none."""
    return np.searchsorted(_FLOORS, count, side="right")


def bit_positions(hashes: np.ndarray, level: int, bits: int):
    """Yield the PROBES positions of (n-gram, level) within the n-gram's segment of 2**bits bits.

    A reader that has ruled n-grams out sends the numbers of those that are left, and later positions are theirs alone.
    """
    mask, x = np.uint64((1 << bits) - 1), hashes
    shifts = (0, 21, 42) if bits <= 21 else (0, 32)
    for _ in range(PROBES // len(shifts)):
        x = mix(x ^ _LEVEL_SALTS[level])
        for shift in shifts:
            left = yield (x >> np.uint64(shift)) & mask
            if left is not None:
                x = x[left]
                yield x  # the answer to send(); the next position follows


class CountFilter:
    """Reads quantised counts from 2**segments segments; none: a single one that is known to be the n-grams'."""

    def __init__(self, bits: np.ndarray, segments: int = SEGMENTS):
        self.bits, self.segments, self.size = bits, segments, (8 * len(bits)).bit_length() - 1 - segments

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Level of each n-gram, by probing from level 1 on; 0 if that one is missing.

        Most of the time goes into bits that are in no cache, so n-grams that repeat are read once, in order of their segments.
        """
        left, at = np.unique(hashes, return_inverse=True)
        out, active, level = np.zeros(len(left), dtype=np.int64), np.arange(len(left)), 1
        while len(left) and level < len(_FLOORS):
            kept = np.concatenate([first + self.holds(left[first : first + READ], level) for first in range(0, len(left), READ)])
            left, active = left[kept], active[kept]
            out[active] = level
            level += 1
        return out[at]

    def holds(self, hashes: np.ndarray, level: int) -> np.ndarray:
        """The numbers of the n-grams that have all bits of a level."""
        base = hashes >> np.uint64(64 - self.segments) << np.uint64(self.size) if self.segments else np.zeros_like(hashes)
        alive, positions = np.arange(len(hashes)), bit_positions(hashes, level, self.size)
        for at in positions:
            at |= base
            bit = self.bits.take((at >> np.uint64(3)).view(np.int64)) >> (at & np.uint64(7)).astype(np.uint8)
            left = np.flatnonzero((bit & np.uint8(1)).view(bool))
            alive, base = alive[left], base[left]
            positions.send(left)
        return alive


class TokenHasher(WordHasher):
    """64-bit names of words: up to 7 bytes by a bijection of their bytes and length, so no two of them share one, whatever texts
    are built to do. Words of 8 bytes get the sum of two bijections, which cannot be solved for a word to match a given name as a bijection can;
    longer ones a cryptographic digest."""

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        size = ends - starts
        short = np.minimum(size, 7)
        out = mix((eight[starts] & self.masks[short]) | (short.astype(np.uint64) << _LENGTH))
        full, long = np.flatnonzero(size == 8), np.flatnonzero(size > 8)
        if len(full):
            word = eight[starts[full]]
            out[full] = mix(word ^ _FULL_SALTS[0]) + mix(mix(word) ^ _FULL_SALTS[1])
        if len(long):
            text, digest = memoryview(data), hashlib.blake2b
            found = b"".join([digest(text[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist())])
            out[long] = np.frombuffer(found, dtype="<u8")
        return out


def sequences(data: np.ndarray, bounds: np.ndarray, hasher: TokenHasher):
    """Tokens of some texts, an end after each: (token hashes, hashes of what stands before, owner).

    Words and pairs are told apart by the salts with which they go into the filter.
    """
    folded = fold_case(data)
    starts, ends, per_doc = word_spans(folded, bounds)
    docs = len(per_doc)
    owner = np.repeat(np.arange(docs), per_doc + 1)
    stops = np.cumsum(per_doc + 1) - 1
    tokens = np.full(len(owner), _END, dtype=np.uint64)
    inner = np.ones(len(owner), dtype=bool)
    inner[stops] = False
    tokens[inner] = hasher(folded, starts, ends)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[stops[:-1] + 1] = _START
    before[:1] = _START
    return tokens, before, owner


def pair_hash(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix((before * np.uint64(3) + tokens) ^ _PAIR_SALT) | np.uint64(1)


def count_ngrams(texts: DataFrame) -> DataFrame:
    """The words and pairs of a table with one column of texts, counted and packed.

    Few n-grams of a task are equal, so adding them up before the shuffle costs more than it saves: each task adds up what it
    holds.
    """

    def run(batches):
        hasher, found, held = TokenHasher(), ([], []), 0
        for batch in batches:
            for _, _, data, bounds in text_chunks(batch.column(0)):
                tokens, before, _ = sequences(data, bounds, hasher)
                found[0].append(tokens)
                found[1].append(pair_hash(before, tokens))
                held += len(tokens)
                if held >= HELD:
                    yield from counted(found)
                    found, held = ([], []), 0
        yield from counted(found)

    def counted(found):
        for word, parts in zip((True, False), found):
            if parts:
                hashes, count = np.unique(np.concatenate(parts), return_counts=True)
                if word:
                    hashes = mix(hashes ^ _WORD_SALT)
                    order = np.argsort(hashes)
                    hashes, count = hashes[order], count[order]
                yield from parcels(hashes, word, count)

    return packed(texts.mapInArrow(run, _PARCELS))


def parcels(keys: np.ndarray, word: bool, count: np.ndarray):
    """Batches of rows (segment, word, low, high, count) for counted n-grams in order of their keys: a row for each segment, not for each n-gram."""
    for first in range(0, len(keys), PARCEL):
        key = keys[first : first + PARCEL]
        segment = key >> _IN_SEGMENT
        start = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        edges = np.append(start, len(key))
        columns = [_blobs(part, edges) for part in (*_steps(key), count[first : first + PARCEL].astype("<i8"))]
        yield pa.RecordBatch.from_arrays([pa.array(segment[start].astype(np.int32)), pa.array(np.full(len(start), word)), *columns], names=["segment", "word", "low", "high", "count"])


def packed(rows: DataFrame) -> DataFrame:
    """Rows of ``parcels``, summed: a row (key, count) for each word; a row (segment, load, hashes, levels) for each segment.

    Rows sorted by segment after the shuffle stream by; the n-grams of some whole segments are sorted and added up together.
    """

    def run(batches):
        now, held, size = None, [], 0
        for batch in batches:
            segment = batch.column(0).to_numpy()
            for a, b in _runs(segment):
                if segment[a] != now and size >= PARCEL:
                    yield from summed(pa.Table.from_batches(held))
                    held, size = [], 0
                now, part = segment[a], batch.slice(a, b - a)
                held.append(part)
                size += pc.sum(pc.binary_length(part.column(3))).as_py()
        if held:
            yield from summed(pa.Table.from_batches(held))

    def summed(rows):
        key, edges = _keys(rows.column(0).to_numpy(), rows.column(2), rows.column(3))
        word, count = np.repeat(rows.column(1).to_numpy(), np.diff(edges)), np.frombuffer(b"".join(rows.column(4).to_pylist()), dtype="<i8")
        order = np.argsort(key)
        key, word, count = key[order].view(np.int64), word[order], count[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, word, count = key[start], word[start].astype(bool), np.add.reduceat(count, start)
        level = level_of(count).astype(np.uint8)
        segment = key.view(np.uint64) >> _IN_SEGMENT
        edges = np.concatenate(([0], np.flatnonzero(segment[1:] != segment[:-1]) + 1, [len(key)]))
        parts, n = list(zip(edges[:-1], edges[1:])), int(word.sum())
        yield pa.RecordBatch.from_arrays([pa.array(key[word]), pa.array(count[word]), *(pa.nulls(n, kind) for kind in (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=names)
        loads = np.add.reduceat(level.astype(np.int64), edges[:-1])
        hashes, levels = (pa.array([x[a:b].tobytes() for a, b in parts], pa.binary()) for x in (key, level))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64()), pa.array(segment[edges[:-1]].astype(np.int32)), pa.array(loads), hashes, levels], names=names)

    names = ["key", "count", "segment", "load", "hashes", "levels"]
    dealt = rows.repartition("segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(run, "key bigint, count bigint, segment int, load bigint, hashes binary, levels binary")


def filter_segments(counts: DataFrame):
    """(rows (segment, bits), their path, the base-2 logarithm of the bits in one): every word and pair of a packed table."""
    load = counts.agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
    size = max(LEAST_BITS, int(np.ceil(np.log2(max(load, 1) * PROBES / np.log(2)))) - SEGMENTS)

    def fill(batches):
        for batch in batches:
            for segment, hashes, levels in zip(*(batch.column(k) for k in range(3))):
                flags = np.zeros(1 << size, dtype=bool)
                hashes, levels = np.frombuffer(hashes.as_buffer(), dtype=np.uint64), np.frombuffer(levels.as_buffer(), dtype=np.uint8)
                for step in range(1, int(levels.max()) + 1):
                    for at in bit_positions(hashes[levels >= step], step, size):
                        flags[at.view(np.int64)] = True
                yield pa.RecordBatch.from_arrays([pa.array([segment.as_py()], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

    rows = counts.where("segment is not null").select("segment", "hashes", "levels")
    return *write_out(rows.mapInArrow(fill, "segment int, bits binary"), "filter-segments"), size


def gathered(segments: DataFrame, size: int) -> np.ndarray:
    """The whole filter; made by all executors, read a part at a time: the driver holds it once."""
    bits, width = np.zeros(1 << (SEGMENTS + size - 3), dtype=np.uint8), 1 << (size - 3)
    for row in segments.toLocalIterator():
        bits[row.segment * width : (row.segment + 1) * width] = np.frombuffer(row.bits, dtype=np.uint8)
    return bits


def build_filter(counts: DataFrame):
    """(bits, the base-2 logarithm of the bits in a segment) of rows (hash, count); hashes of words are even."""

    def keyed(batches):
        for batch in batches:
            hashes, count = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for word in (True, False):
                here = np.flatnonzero((hashes & 1 == 0) == word)
                key = hashes[here].view(np.uint64)
                key = mix(key ^ _WORD_SALT) if word else key
                order = np.argsort(key)
                yield from parcels(key[order], word, count[here][order])

    table, path = write_out(packed(counts.select("hash", "count").mapInArrow(keyed, _PARCELS)), "ngrams")
    segments, filled, size = filter_segments(table)
    bits = gathered(segments, size)
    remove(counts.sparkSession, path)
    remove(counts.sparkSession, filled)
    return bits, size


def _blobs(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary values: the bytes of ``values`` between each two edges."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _runs(*columns: np.ndarray):
    """(first, last) of the rows that agree in all columns."""
    change = np.zeros(max(len(columns[0]) - 1, 0), dtype=bool)
    for column in columns:
        change |= column[1:] != column[:-1]
    edges = np.concatenate(([0], np.flatnonzero(change) + 1, [len(columns[0])])).tolist()
    return [x for x in zip(edges[:-1], edges[1:]) if x[0] < x[1]]


def _steps(keys: np.ndarray) -> list[np.ndarray]:
    """Ordered keys as what each exceeds the one before it in its segment: six low bytes of each, and the seventh, which compresses away."""
    least = np.maximum(np.append(np.uint64(0), keys[:-1]), keys >> _IN_SEGMENT << _IN_SEGMENT)
    steps = (keys - least).astype("<u8").view(np.uint8).reshape(-1, 8)
    return [np.ascontiguousarray(steps[:, :6]).view("V6")[:, 0], np.ascontiguousarray(steps[:, 6])]


def _keys(segments: np.ndarray, low: pa.Array, high: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the keys of some rows, each with those of a segment, their edges) from the bytes of ``_steps``."""
    edges = np.append(0, np.cumsum([len(v) for v in high.to_pylist()])).astype(np.int64)
    steps = np.zeros((edges[-1], 8), dtype=np.uint8)
    steps[:, :6] = np.frombuffer(b"".join(low.to_pylist()), dtype=np.uint8).reshape(-1, 6)
    steps[:, 6] = np.frombuffer(b"".join(high.to_pylist()), dtype=np.uint8)
    total = np.append(np.uint64(0), np.cumsum(steps.view("<u8")[:, 0], dtype=np.uint64))
    return total[1:] + np.repeat((segments.astype(np.uint64) << _IN_SEGMENT) - total[edges[:-1]], np.diff(edges)), edges


def requests(texts: DataFrame) -> DataFrame:
    """Rows (row, segment, words, words_high, pairs, pairs_high) of a table (row, text_): the different n-grams of each piece of text that lie in a segment, in order.

    ``row`` is the first one of the piece. A piece lies within 2**TOGETHER rows of one reader, however the table is split among tasks.
    """

    piece, together = PIECE, TOGETHER

    def run(batches):
        hasher, every = TokenHasher(), np.arange((1 << SEGMENTS) + 1, dtype=np.uint64)
        for batch in batches:
            row = batch.column(0).to_numpy()
            for a, b in _runs(row >> together):
                for first, _, data, bounds in text_chunks(batch.column(1).slice(a, b - a), piece):
                    tokens, before, _ = sequences(data, bounds, hasher)
                    keys = np.unique(mix(np.unique(tokens) ^ _WORD_SALT)), np.unique(pair_hash(before, tokens))
                    edges = [np.searchsorted(x >> _IN_SEGMENT, every) for x in keys]
                    asked = np.flatnonzero((edges[0][1:] > edges[0][:-1]) | (edges[1][1:] > edges[1][:-1]))
                    sent = [_blobs(part, e[np.append(asked, asked[-1] + 1)]) for x, e in zip(keys, edges) for part in _steps(x)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), row[a + first])), pa.array(asked.astype(np.int32)), *sent], names=["row", "segment", *_ASKED])

    return texts.select("row", "text_").mapInArrow(run, "row bigint, segment int, words binary, words_high binary, pairs binary, pairs_high binary")


def answers(asked: DataFrame, segments: DataFrame, words: DataFrame) -> DataFrame:
    """Rows (row, segment, words, counts, pairs): the levels of the n-grams of each request as bytes, the exact counts of words as longs.

    A segment's bits come first in its sorted partition, then its words, then its requests, which stream by.
    """

    def run(batches):
        now, bits, keys, counts = None, None, [], []
        for batch in batches:
            segment, kind = (batch.column(k).to_numpy() for k in (0, 1))
            for a, b in _runs(segment, kind):
                if segment[a] != now:
                    now, bits, keys, counts = segment[a], None, [], []
                if kind[a] == 0:
                    bits = np.frombuffer(batch.column(5)[a].as_py(), dtype=np.uint8)
                elif kind[a] == 1:
                    keys.append(batch.column(2).slice(a, b - a).to_numpy().view(np.uint64).copy())
                    counts.append(batch.column(3).slice(a, b - a).to_numpy().copy())
                else:
                    yield told(now, bits, keys, counts, *(batch.column(k).slice(a, b - a) for k in range(4, 9)))

    def told(segment, bits, keys, counts, row, *asked):
        segments = np.full(len(row), segment)
        flat, edges = zip(_keys(segments, *asked[:2]), _keys(segments, *asked[2:]))
        level = [(CountFilter(bits, 0).levels(x) if bits is not None else np.zeros(len(x))).astype(np.uint8) for x in flat]
        count = np.zeros(len(flat[0]), dtype=np.int64)
        if keys:
            keys, counts = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            at = np.minimum(np.searchsorted(keys, flat[0]), len(keys) - 1)
            count = np.where(keys[at] == flat[0], counts[at], 0)
        columns = [_blobs(level[0], edges[0]), _blobs(count, edges[0]), _blobs(level[1], edges[1])]
        return pa.RecordBatch.from_arrays([row, pa.array(np.full(len(row), segment, dtype=np.int32)), *columns], names=["row", "segment", "words", "counts", "pairs"])

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    held = segments.select("segment", F.lit(0).alias("kind"), none("bigint", "key"), none("bigint", "count"), none("bigint", "row"), F.col("bits").alias("words"), *[none("binary", name) for name in _ASKED[1:]])
    known = words.select(F.shiftrightunsigned("hash", 64 - SEGMENTS).cast("int").alias("segment"), F.lit(1).alias("kind"), F.col("hash").alias("key"), "count", none("bigint", "row"), *[none("binary", name) for name in _ASKED])
    asking = asked.select("segment", F.lit(2).alias("kind"), none("bigint", "key"), none("bigint", "count"), "row", *_ASKED)
    dealt = held.unionByName(known).unionByName(asking).repartition("segment").sortWithinPartitions("segment", "kind")
    return dealt.mapInArrow(run, "row bigint, segment int, words binary, counts binary, pairs binary")


def answered(texts: DataFrame, told: DataFrame, kind: str, judge) -> DataFrame:
    """What ``judge`` makes of each piece of a table (row, id, text_) and the answers to it: rows (id, n_tokens, n_known, base, score)."""

    def run(batches):
        held, docs = [], []
        for batch in batches:
            sort = batch.column(1).to_numpy()
            for a, b in _runs(sort):
                part = batch.slice(a, b - a)
                if sort[a] == 0 and docs:  # the next piece begins
                    yield judged(held, docs)
                    held, docs = [], []
                (docs if sort[a] else held).append(part)
        if docs:
            yield judged(held, docs)

    def judged(held, docs):
        answer = pa.Table.from_batches(held)
        level, count, pair = (np.frombuffer(b"".join(answer.column(name).to_pylist()), dtype=form) for name, form in (("words", np.uint8), ("counts", np.int64), ("pairs", np.uint8)))
        table = pa.Table.from_batches(docs)
        _, _, data, bounds = next(text_chunks(table.column("text_"), 1 << 60))
        found = judge(data, bounds, level.astype(np.int64), count, pair.astype(np.int64))
        return pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), *map(pa.array, found)], names=["id", "n_tokens", "n_known", "base", "score"])

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    blank = [none("binary", name) for name in ("words", "counts", "pairs")]
    rows = texts.select("row", F.lit(1).alias("sort"), F.lit(0).alias("segment"), "id", "text_", *blank)
    every = told.select("row", F.lit(0).alias("sort"), "segment", none(kind, "id"), none("string", "text_"), "words", "counts", "pairs").unionByName(rows)
    dealt = every.repartition(F.shiftright("row", TOGETHER)).sortWithinPartitions("row", "sort", "segment")
    return dealt.mapInArrow(run, f"id {kind}, n_tokens bigint, n_known bigint, base double, score double")


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text of ``docs`` by what the texts of ``training`` hold.

    Returns id_col, n_tokens, n_known, train_tokens (long), base_score (add-one unigrams on exact counts) and score
    (the model's log10 probability). Tokens are words with A-Z folded and one end.

    * Nulls: a null text counts as empty, a null id stays. An empty text has one token, its end.
    * Very long texts are scored whole.
    * Ties: of equally frequent words the smaller hash is broadcast, which changes no result.
    * Repeated rows: a row for each input row; training counts each. Without training rows every token is
      unknown; an empty table gives an empty result.
    * Other columns are not carried, so their names cannot clash.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    texts = training.select(F.col(text_col).cast("string").alias("t"))
    counts, counted = write_out(count_ngrams(texts), "ngrams")
    words = counts.where("key is not null").select(F.col("key").alias("hash"), "count")
    total, kinds = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    end = mix(np.array([_END]) ^ _WORD_SALT).view(np.int64)[0]
    trained = words.where(F.col("hash") == int(end)).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    segments, path, size = filter_segments(counts)
    whole, room = SEGMENTS + size <= BROADCAST_BITS, float(total + kinds + 1)

    def logs(level: np.ndarray, pairs, word: np.ndarray, before: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
        low, high = np.where(level > 0, _FLOORS[level - 1], 0.0), np.where(level > 0, _FLOORS[level] - 1, 0.0)
        context = np.append(0.0, high[word[:-1]])  # the count of what stands before
        context[before == _START] = trained
        p = (low[word] + 1) / room
        seen = np.flatnonzero((p > 1 / room) & (context > 0))
        pair = pairs(seen)
        share_of = np.where(pair > 0, _FLOORS[pair - 1], 0.0) / context[seen]
        p[context > 0] *= 1 - LAMBDA
        p[seen] += LAMBDA * np.minimum(share_of, 1.0)
        return np.bincount(owner, weights=np.log10(np.minimum(p, 1.0)), minlength=docs)

    def judge(data, bounds, level, count, pair):
        """(n_tokens, n_known, base, score) of the texts of a piece, from what was answered for its words and pairs in order of their keys."""
        tokens, before, owner = sequences(data, bounds, TokenHasher())
        docs = len(bounds) - 1
        unique, word = np.unique(tokens, return_inverse=True)
        place = np.argsort(np.argsort(mix(unique ^ _WORD_SALT)))
        level, count = level[place], count[place]
        _, at = np.unique(pair_hash(before, tokens), return_inverse=True)
        known, base = (np.bincount(owner, weights=x[word], minlength=docs) for x in ((count > 0).astype(float), np.log10(count + 1.0)))
        return np.bincount(owner, minlength=docs), known.astype(np.int64), base, logs(level, lambda seen: pair[at[seen]], word, before, owner, docs)

    final = lambda rows: rows.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.log10(F.lit(room))).alias("base_score"), "score")
    if not whole:
        words, _ = write_out(words, "lm-words")
        remove(spark, counted)
        source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text_"))
        source, _ = write_out(source, "lm-texts", compression="zstd")  # numbers are fixed once written
        forget(spark)
        told, _ = write_out(answers(requests(source), segments, words), "lm-answers")
        remove(spark, path)
        forget(spark)
        return final(answered(source, told, kind, judge))
    top = words.orderBy(F.desc("count"), "hash").limit(HOT).toArrow()
    hot = top.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hot)
    hot, hot_logs = hot[order], np.log10(top.column("count").to_numpy()[order].astype(np.float64) + 1)
    bits = gathered(segments, size)
    shared = share(spark, (hot, hot_logs, CountFilter(bits).levels(hot)))  # HOT words; their levels are the highest, and are read once
    shared_bits = share_bits(spark, bits)  # 128 MB
    del bits
    remove(spark, path)

    def run(batches):
        hot, hot_logs, hot_levels = pickle.loads(shared.value)
        find, hasher = CountFilter(view_bits(shared_bits)), TokenHasher()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, last, data, bounds in text_chunks(batch.column(1), STEP):
                tokens, before, owner = sequences(data, bounds, hasher)
                docs = last - first
                unique, word = np.unique(tokens, return_inverse=True)
                unique = mix(unique ^ _WORD_SALT)
                at = np.minimum(np.searchsorted(hot, unique), max(len(hot) - 1, 0))
                is_hot = hot[at] == unique if len(hot) else np.zeros(len(unique), dtype=bool)
                worth = np.where(is_hot, hot_logs[at], 0.0) if len(hot) else np.zeros(len(unique))
                level = hot_levels[at] if len(hot) else np.zeros(len(unique), dtype=np.int64)
                level[~is_hot] = find.levels(unique[~is_hot])
                common = is_hot[word]
                base, known = (np.bincount(owner, weights=x[word], minlength=docs) for x in (worth, is_hot.astype(float)))
                known, size = known.astype(np.int64), np.bincount(owner, minlength=docs)
                model = pa.array(logs(level, lambda seen: find.levels(pair_hash(before[seen], tokens[seen])), word, before, owner, docs))
                rows = row + np.arange(docs)
                ids, empty = batch.column(0).slice(first, docs), pa.nulls(docs, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rows), ids, pa.array(mix(rows.astype(np.uint64)).view(np.int64)), empty, pa.array(size), pa.array(known), pa.array(base), model], names=names)
                rare = np.flatnonzero(~common)
                key, times = np.unique(owner[rare] * len(unique) + word[rare], return_counts=True)
                n = len(key)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[key // len(unique)]), pa.nulls(n, ids.type), pa.array(unique[key % len(unique)].view(np.int64)), pa.array(times), *(pa.nulls(n, kind) for kind in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=names)
                row += docs

    names = ["row", "id", "hash", "times", "n_tokens", "n_known", "base", "model"]
    found = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_")).mapInArrow(run, f"row bigint, id {kind}, hash bigint, times bigint, n_tokens bigint, n_known bigint, base double, model double")
    joined = found.join(words.withColumnRenamed("count", "c"), (found.hash == words.hash) & found.times.isNotNull(), "left")
    grouped = joined.groupBy("row").agg(
        F.max("id").alias("id"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("times"))), F.lit(0))).alias("n_known"),
        (F.max("base") + F.coalesce(F.sum(F.col("times") * F.log10(F.col("c") + 1)), F.lit(0.0))).alias("base"),
        F.max("model").alias("score"),
    )
    return final(grouped)


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; those whose crc32 modulo 7 is 2 are held out of the counts."""
    small_batches(spark)
    held = training_part(F.col("doc_id"), 7) == 2
    docs = documents(spark, sf_dir)
    found = score(docs, docs.where(~F.coalesce(held, F.lit(False))))
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
