"""Phrase collocation mining: frequent words get numbers, and phrases of them are counted as fixed-width binary keys.

Texts become blocks: the words of some texts of one language, coded by the block's own dictionary, with a break where a piece
ends. Adding up the dictionaries counts the words; frequent ones get a dense number, and a join of the dictionaries with
them (never of single words) gives each block its numbers. All other words become breaks, for no phrase that holds one can be
frequent. Within a block the phrases of one length are packed, sorted and run-length counted, so that what is shuffled is
one row for each different phrase of a block: its key, four bytes a word, big-endian (so Spark's sort needs nothing but the prefix of a pair). Keys are range-partitioned, sorted by
their prefix and run-length counted again, which adds up the blocks.

Lengths are taken in turn. A phrase is only packed if both its parts one word shorter may be frequent, which a bitmap of fixed
size tells; it lets some others through and holds none back, so it saves rows and changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from deltaloom.llm._shared import documents, fold_case, mix, remove, small_batches, text_chunks, view_bits, write_out
from deltaloom.llm.bitmap import holds, shared_bitmap

#: Phrases of so many words, and the least count of a candidate.
LONGEST, LEAST = 4, 30
#: A phrase is dropped for a longer one that has this share (in hundredths) of its count; so many are returned of a language.
SHARE, TOP = 80, 2000
#: Words of one language in a block, and of all languages that one task holds before it writes them.
BLOCK_WORDS, HELD_WORDS = 1_000_000, 2_000_000
#: Bytes of a word's number in a key, and from how many frequent words on it takes WIDE bytes.
NARROW, WIDE, MANY = 4, 8, 1 << 32
#: Rows that a task hands on at once.
_ROWS = 200_000
_SPLITS = np.zeros(256, dtype=bool)
_SPLITS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAPS = np.zeros(256, dtype=bool)
_GAPS[[0x20, 0x09]] = True


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of some texts, and which of them begin a piece (as every first word of a text does)."""
    cut = _SPLITS[data]
    inside = ~(cut | _GAPS[data])
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    before, here = np.append(False, inside), np.append(inside, False)
    starts, ends = np.flatnonzero(here & (~before | edge)), np.flatnonzero(before & (~here | edge))
    cuts = np.cumsum(np.append(cut, False) | edge)
    first = np.ones(len(starts), dtype=bool)
    first[1:] = cuts[starts[1:]] != cuts[ends[:-1] - 1]
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    array = pa.Array.from_buffers(pa.large_utf8(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside].tobytes())])
    return array.dictionary_encode(), first


class _Held:
    """Words of one language that a task has read and not yet written."""

    def __init__(self):
        self.words, self.first, self.n = [], [], 0

    def add(self, words: pa.DictionaryArray, first: np.ndarray) -> None:
        self.words.append(words)
        self.first.append(first)
        self.n += len(first)

    def blocks(self):
        """(codes, own, words, counts): codes number the block's words from 1, 0 is a break; own codes are counted here, the few
        after them belong to the next block and only end phrases."""
        whole = pa.chunked_array(self.words).unify_dictionaries()
        dictionary = whole.chunk(0).dictionary
        codes = np.concatenate([np.asarray(c.indices) for c in whole.chunks]).astype(np.int64)
        first = np.concatenate(self.first)
        for a in range(0, len(codes), BLOCK_WORDS):
            b = min(len(codes), a + BLOCK_WORDS)
            more = min(len(codes), b + LONGEST - 1)
            here, found = np.unique(codes[a:more], return_inverse=True)
            at = np.arange(more - a) + np.cumsum(first[a:more])
            out = np.zeros(at[-1] + 1, dtype=np.uint32)
            out[at] = found + 1
            counts = np.bincount(found[: b - a], minlength=len(here))
            yield out.tobytes(), int(at[b - a - 1]) + 1, dictionary.take(pa.array(here)), counts


def blocks(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(block, lang, own, tokens, codes, words, counts) of all texts."""

    def run(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, {}

        def written(lang):
            nonlocal number
            for codes, own, words, counts in held.pop(lang).blocks():
                number += 1
                lists = [pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), x).cast(pa.list_(x.type)) for x in (words.cast(pa.string()), pa.array(counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([lang]), pa.array([own], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([codes], pa.binary()), *lists], names=["block", "lang", "own", "tokens", "codes", "words", "counts"])

        for batch in batches:
            langs = batch.column(0)
            for lang in langs.unique().to_pylist():
                texts = batch.column(1).filter(pa.compute.equal(langs, lang))
                for _, _, data, bounds in text_chunks(texts):
                    words, first = words_of(fold_case(data), bounds)
                    if len(first):
                        held.setdefault(lang, _Held()).add(words, first)
                        if held[lang].n >= BLOCK_WORDS:
                            yield from written(lang)
            if sum(x.n for x in held.values()) >= HELD_WORDS:
                for lang in list(held):
                    yield from written(lang)
        for lang in list(held):
            yield from written(lang)

    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col).cast("string"))
    return source.mapInArrow(run, "block bigint, lang string, own bigint, tokens bigint, codes binary, words array<string>, counts array<bigint>")


def numbered(words: DataFrame) -> tuple[DataFrame, int]:
    """The rows with a dense ``id`` from 1, and the bytes that an id takes. The driver sees a count for each partition."""
    table, _ = write_out(words.withColumn("at", F.monotonically_increasing_id()), "frequent")
    part, at = F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((row.part, row["count"]) for row in table.groupBy(part).count().collect())
    before = np.concatenate(([0], np.cumsum([n for _, n in sizes])))
    lead = words.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, before)], "part bigint, lead bigint")
    placed = table.withColumn("part", part).join(F.broadcast(lead), "part")
    return placed.select(*words.columns, (F.col("lead") + at + 1).alias("id")), NARROW if before[-1] < MANY else WIDE


def _key(number: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(number), 2 * width, "0"))


def encode(coded: DataFrame, frequent: DataFrame) -> DataFrame:
    """(codes, own, ids) of each block: codes of its frequent words alone, and the dense numbers that they stand for (ids[code - 1])."""
    local = coded.select("block", "lang", F.posexplode("words").alias("code", "word"))
    known = local.join(frequent.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("code", "id")).alias("found"))
    both = coded.select("block", "codes", "own").join(known, "block").select("codes", "own", F.col("found.code").alias("code"), F.col("found.id").alias("id"))

    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                codes = np.frombuffer(batch.column(0)[k].as_buffer(), dtype=np.uint32)
                code, ids = (batch.column(c)[k].values.to_numpy() for c in (2, 3))
                order = np.argsort(code)
                again = np.zeros(max(int(codes.max(initial=0)), int(code.max(initial=0)) + 1) + 1, dtype=np.uint32)
                again[code[order] + 1] = np.arange(1, len(code) + 1)
                out.append((again[codes].tobytes(), batch.column(1)[k].as_py(), ids[order].astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.binary()))] if out else [pa.array([], t) for t in (pa.binary(), pa.int64(), pa.binary())], names=["codes", "own", "ids"])

    return both.mapInArrow(run, "codes binary, own bigint, ids binary")


def phrase_hashes(numbers: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of phrases from the numbers of their words, for the bitmap only."""
    out = np.zeros(len(numbers[0]), dtype=np.uint64)
    for x in numbers:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64))
    return out


def _packed(columns: list[np.ndarray], top: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(the different phrases, column by column, and their counts): packed to one number each, sorted, runs counted."""
    bits = max(1, int(top).bit_length())
    if bits * len(columns) <= 64:
        key = columns[0].astype(np.uint64)
        for x in columns[1:]:
            key <<= np.uint64(bits)
            key |= x.astype(np.uint64)
        key.sort()
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        kinds, count = key[starts], np.diff(np.append(starts, len(key)))
        mask = np.uint64((1 << bits) - 1)
        return [((kinds >> np.uint64(bits * k)) & mask).astype(np.int64) for k in range(len(columns) - 1, -1, -1)], count
    key, width = columns[0].astype(np.uint64), bits
    for x in columns[1:]:
        if width + bits > 64:  # ranks in place of what is packed so far
            kinds, key = np.unique(key, return_inverse=True)
            key, width = key.astype(np.uint64), max(1, len(kinds).bit_length())
        key, width = (key << np.uint64(bits)) | x.astype(np.uint64), width + bits
    _, at, count = np.unique(key, return_index=True, return_counts=True)
    return [x[at].astype(np.int64) for x in columns], count


def _bytes_of(numbers: list[np.ndarray], width: int) -> np.ndarray:
    """Keys of phrases: ``width`` big-endian bytes a word."""
    wide = np.stack(numbers, axis=1).astype(">u8").view(np.uint8).reshape(len(numbers[0]), len(numbers), 8)
    return np.ascontiguousarray(wide[:, :, 8 - width :]).reshape(len(numbers[0]), -1)


def _keyed(keys: np.ndarray, *columns: np.ndarray, names: list[str]) -> pa.RecordBatch:
    n, width = keys.shape
    offsets = pa.py_buffer((np.arange(n + 1, dtype=np.int64) * width).astype(np.int32))
    array = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(keys.tobytes())])
    return pa.RecordBatch.from_arrays([array, *[pa.array(c, pa.int64()) for c in columns]], names=["key", *names])


def runs(encoded: DataFrame, n: int, width: int, shared=None) -> DataFrame:
    """(key, seen): how often each phrase of ``n`` words starts in each block, if both its parts of n - 1 words may be frequent."""

    def starts(codes, own, ids, bits):
        """Where phrases start, found in slices."""
        m, known = len(codes) - n + 1, codes > 0
        for a in range(0, min(m, own), _ROWS):
            b = min(m, own, a + _ROWS)
            good = known[a:b].copy()
            for j in range(1, n):
                good &= known[a + j : b + j]
            at = a + np.flatnonzero(good)
            if bits is not None and len(at):
                part = [ids[codes[at + j] - 1] for j in range(n)]
                at = at[holds(bits, phrase_hashes(part[:-1])) & holds(bits, phrase_hashes(part[1:]))]
            yield at

    def run(batches):
        bits = None if shared is None else view_bits(shared)
        for batch in batches:
            for k in range(batch.num_rows):
                codes, ids = np.frombuffer(batch.column(0)[k].as_buffer(), dtype=np.uint32), np.frombuffer(batch.column(2)[k].as_buffer(), dtype=np.int64)
                at = np.concatenate([np.zeros(0, np.int64), *starts(codes, batch.column(1)[k].as_py(), ids, bits)])
                if not len(at):
                    continue
                kinds, count = _packed([codes[at + j] for j in range(n)], len(ids))
                for a in range(0, len(count), _ROWS):
                    yield _keyed(_bytes_of([ids[x[a : a + _ROWS] - 1] for x in kinds], width), count[a : a + _ROWS], names=["seen"])

    return encoded.mapInArrow(run, "key binary, seen bigint")


def counted(found: DataFrame, least: int, width: int) -> DataFrame:
    """(key, a, hash) of the keys with a sum of ``least`` and more: range-partitioned, sorted, run-length counted."""
    dealt = found.repartitionByRange("key").sortWithinPartitions("key")

    def run(batches):
        last, total = None, 0  # the run that the next batch may continue

        def kept(keys, sums):
            keep = sums >= least
            if keep.any():
                wide = np.zeros((int(keep.sum()), keys.shape[1] // width, 8), dtype=np.uint8)
                wide[:, :, 8 - width :] = keys[keep].reshape(len(wide), -1, width)
                numbers = wide.reshape(len(wide), -1).view(">u8").astype(np.uint64)
                yield _keyed(keys[keep], sums[keep], phrase_hashes(list(numbers.T)).view(np.int64), names=["a", "hash"])

        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0)
            size = len(column[0].as_buffer())
            start = column.offset * size
            keys = np.frombuffer(column.buffers()[2], dtype=np.uint8)[start : start + len(column) * size].reshape(-1, size)
            seen = batch.column(1).to_numpy()
            if last is not None:
                keys, seen = np.vstack((last, keys)), np.append(total, seen)
            new = np.append(True, (keys[1:] != keys[:-1]).any(1))
            at = np.flatnonzero(new)
            sums = np.add.reduceat(seen, at)
            yield from kept(keys[at[:-1]], sums[:-1])
            last, total = keys[at[-1:]].copy(), int(sums[-1])
        if last is not None:
            yield from kept(last, np.array([total]))

    return dealt.mapInArrow(run, "key binary, a bigint, hash bigint")


def scored(phrases: DataFrame, frequent: DataFrame, width: int) -> DataFrame:
    """(key, a, l, r, score) of every candidate at its lowest-scoring cut, ties to the earliest."""
    parts = frequent.select(_key(F.col("id"), width).alias("part"), F.col("f").alias("of")).unionByName(phrases.select(F.col("key").alias("part"), F.col("a").alias("of")))
    cuts = phrases.select("key", "a", F.explode(F.sequence(F.lit(1), _size(width) - 1)).alias("k")).select("key", "a", "k", F.expr(f"substring(key, 1, k * {width})").alias("left"), F.expr(f"substring(key, k * {width} + 1)").alias("right"))
    cuts = cuts.join(parts.select(F.col("part").alias("left"), F.col("of").alias("l")), "left").join(parts.select(F.col("part").alias("right"), F.col("of").alias("r")), "right")
    score = F.expr("(cast(2000000 as decimal(8, 0)) * cast(a as decimal(20, 0))) div cast(cast(l as decimal(20, 0)) + r as decimal(21, 0))")
    best = cuts.withColumn("score", score).groupBy("key").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("key", "a", "cut.l", "cut.r", "cut.score")


def _size(width: int) -> Column:
    return (F.length("key") / width).cast("int")


def outside_longer(phrases: DataFrame, share: int, width: int) -> DataFrame:
    """The candidates that no longer candidate with ``share`` hundredths of their count holds."""
    size = _size(width)
    inner = phrases.where(size > 2).select("a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(0), size - n), lambda i: F.substring(F.col("key"), i * width + 1, n * width))))).alias("key"))
    most = inner.groupBy("key").agg(F.max("a").alias("most"))
    held = F.expr(f"100 * cast(most as decimal(20, 0)) >= {share} * cast(a as decimal(20, 0))")
    return phrases.join(most, "key", "left").where(~F.coalesce(held, F.lit(False))).select("key", "a")


def phrases_of(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """Collocations of every language: lang, rank, phrase, a, l, r, n, score (numbers long).

    ``a`` counts the phrase, ``l`` and ``r`` its two parts at the lowest-scoring cut, ``n`` all words of the language. The
    ``top`` first of each language by score, a (both descending) and phrase.

    * Null texts and empty ones hold no words; a null language is ``und``. Very long texts and pieces are read whole, over several blocks.
    * Ties: of equal cuts the earliest, of equal candidates the least phrase by its UTF-8 bytes.
    * Repeated rows count as often as they are there. An empty table, or one without frequent phrases, gives an empty result.
    * Other columns are not read, so their names cannot clash.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words")
    spark = docs.sparkSession
    coded, raw = write_out(blocks(docs, lang_col, text_col), "blocks")
    totals = coded.groupBy("lang").agg(F.sum("tokens").alias("n"))
    one = F.explode(F.arrays_zip("words", "counts")).alias("one")
    words = coded.select("lang", one).groupBy("lang", F.col("one.words").alias("word")).agg(F.sum("one.counts").alias("f")).where(F.col("f") >= least)
    frequent, width = numbered(words)
    encoded, path = write_out(encode(coded, frequent), "encoded")
    totals, _ = write_out(totals, "totals")
    remove(spark, raw)
    levels, shared = [], None
    for n in range(2, longest + 1):
        level, _ = write_out(counted(runs(encoded, n, width, shared), least, width), f"phrases-{n}")
        levels.append(level)
        if n < longest:
            shared = shared_bitmap(level.select("hash"))
    remove(spark, path)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    best = scored(found, frequent, width).join(outside_longer(found, share, width).select("key"), "key")
    spelled = best.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), _size(width) - 1), lambda i: F.substring(F.col("key"), i * width + 1, F.lit(width)))).alias("at", "word_key"))
    spelled = spelled.join(frequent.select(_key(F.col("id"), width).alias("word_key"), "word", "lang"), "word_key").groupBy("key").agg(F.first("lang").alias("lang"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])).alias("phrase"))
    named = best.join(spelled, "key").join(totals, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return named.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first collocations of every language of the documents."""
    small_batches(spark)
    return phrases_of(documents(spark, sf_dir, "lang", "text"))
