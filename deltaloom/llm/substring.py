"""Substring dedup by relative Lempel-Ziv parsing.

A document is parsed against what the documents with smaller ids hold. A reference block is named by its anchor, the least
hash of the GRAM-word groups in a window of WINDOW words, which depends on nothing but the window's words: the windows
that follow each other with one anchor are one block, and so are all words under them. Blocks are indexed where they stand first
(least id). Blocks of a document that the index has as a whole are parsed at once. Around the ends of passages blocks differ,
so there every window is looked up by itself, which is indexed where it stands first as well.

A factor (source, position there, length) begins at the first window that was found and goes on, greedily, as long as the next
window stands next in the same source. Where it ends, the factor boundary is checked: the windows that begin before the
boundary and end beyond it were looked up too, and the next factor begins with the first of them that another source holds. So
factors may overlap and no repeated window is lost between two of them. Words under factors go; shorter matches
are no factors.

Blocks and windows are identified by 128-bit cryptographic digests of their words as text, so equal digests are equal words; no hash
that texts could be built to defeat decides. Anchors that one document alone holds, and blocks parsed already, are left out by
bitmaps; what the second lets through or holds back by chance is looked up apart. Texts are read again in each step rather than shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaloom.llm._shared import WordHasher, documents, mix, powers, small_batches, text_chunks, view_bits, word_spans, write_out
from deltaloom.llm.bitmap import holds, shared_bitmap

WINDOW = 50
GRAM = 16
#: Ids with blocks held back by chance are broadcast up to this number (16 MB), and joined by shuffle beyond it.
BROADCAST_IDS = 2_000_000
_MULTIPLIER = 0xA0761D6478BD642F


class Windows:
    """The windows of some texts, the anchors that name their blocks, and their digests."""

    def __init__(self, window: int = WINDOW):
        self.window, self.gram, self.hasher = window, min(GRAM, window), WordHasher()
        self.table = (np.zeros(0, np.uint64),) * 2

    def _grams(self, words: np.ndarray) -> np.ndarray:
        n, width = len(words), self.gram
        if len(self.table[0]) < n:
            self.table = powers(_MULTIPLIER, n), powers(pow(_MULTIPLIER, -1, 1 << 64), n)
        up, down = self.table
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words * up[:n], out=prefix[1:])
        return mix((prefix[width:] - prefix[:-width]) * down[: n - width + 1])

    def __call__(self, data: np.ndarray, bounds: np.ndarray):
        """(owner, position in its document, anchor) of every window."""
        starts, ends, per_doc = word_spans(data, bounds)
        n, w = len(starts), self.window
        if n < w:
            none = np.zeros(0, np.int64)
            return none, none, none.view(np.uint64)
        owner = np.repeat(np.arange(len(per_doc)), per_doc)
        self.data, self.bounds, self.sizes = data, bounds, ends - starts
        self.first = np.flatnonzero(owner[: n - w + 1] == owner[w - 1 :])
        anchor = _sliding_min(self._grams(self.hasher(data, starts, ends)), w - self.gram + 1)[self.first]
        begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(per_doc)))
        return owner[self.first], self.first - begin[owner[self.first]], anchor

    def runs(self, data: np.ndarray, bounds: np.ndarray):
        """(owner, position, windows, anchor, number of the first window) of every run of windows with one anchor."""
        owner, position, anchor = self(data, bounds)
        heads = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))[: len(owner)])
        return owner[heads], position[heads], np.diff(np.append(heads, len(owner))), anchor[heads], heads

    def digests(self, which: np.ndarray, windows: np.ndarray | int = 1) -> np.ndarray:
        """Digests of some runs of the last texts, two longs each: of the words joined by one space."""
        text, bounds = self.data.tobytes(), self.bounds.tolist()
        plain = memoryview(b" ".join([b" ".join(words) for a, b in zip(bounds[:-1], bounds[1:]) if (words := text[a:b].split())]))
        ends = np.cumsum(self.sizes + 1) - 1
        begins, stops = (ends - self.sizes)[self.first[which]], ends[self.first[which] + windows + self.window - 2]
        digest = hashlib.blake2b
        found = b"".join([digest(plain[a:b], digest_size=16).digest() for a, b in zip(begins.tolist(), stops.tolist())])
        return np.frombuffer(found, dtype="<i8").reshape(-1, 2)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from running minima of blocks forwards and backwards."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def factors(found: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, source, position in the source, words) of one document.

    ``found`` has rows (first word of a run of windows, windows, source, position there). A factor grows while the next window
    stands next in the same source; the windows over its end are then tried one by one.
    """
    windows = found[:, 1]
    step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    found = np.repeat(found, windows, axis=0)
    position, source, at = found[:, 0] + step, found[:, 2], found[:, 3] + step
    order = np.lexsort((at, source, position))
    position, source, at = position[order], source[order], at[order]
    fresh = np.append(True, np.diff(position) > 0)[: len(position)]  # a window may be found twice: in repeated rows of one id
    position, source, at = position[fresh], source[fresh], at[fresh]
    goes_on = (np.diff(position) == 1) & (np.diff(at) == 1) & (np.diff(source) == 0)
    heads = np.flatnonzero(np.append(True, ~goes_on)[: len(position)])
    length = np.diff(np.append(heads, len(position))) + window - 1
    return list(zip(position[heads].tolist(), source[heads].tolist(), at[heads].tolist(), length.tolist()))


def _kept(text: bytes, found: list[tuple[int, int, int, int]]) -> tuple[int, int, str, list]:
    """(words, removed words, digest of the kept words, removed spans of words) of one text and its factors."""
    words, spans = text.split(), []
    kept = words
    if found:
        for a, _, _, n in found:
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], a + n))
            else:
                spans.append((a, a + n))
        edges = [0, *(x for span in spans for x in span), len(words)]
        kept = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), spans


def _parsed_key(high: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix(high.view(np.uint64) ^ mix(ids.astype(np.int64).view(np.uint64)))


def _texts(batches, find: Windows, bits: np.ndarray):
    """(numbers of the texts in their batch, ids, runs whose anchor is shared) of some rows (id, text_, ...)."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for first, _, data, bounds in text_chunks(batch.column(1)):
            owner, *rest = find.runs(data, bounds)
            hit = np.flatnonzero(holds(bits, rest[2]))
            if len(hit):
                position, windows, _, heads = (x[hit] for x in rest)
                yield batch, first + owner[hit], ids[first + owner[hit]], position, windows, heads


def _first_places(rows: DataFrame, *key: str) -> DataFrame:
    """Rows (key, source, at) of what stands in several ids: where it stands first. As a table, so that both sides of joins with
    it are plain exchanges, whose hot keys AQE splits."""
    firsts = rows.where("fresh").groupBy(*key).agg(F.min("id").alias("source"), F.min_by("position", "id").alias("at"), F.max("id").alias("last")).where("source < last")
    return write_out(firsts.drop("last"), "reference")[0]


def _fresh(digest: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which rows are the first of their digest in their text (rows stand in order)."""
    key = mix(digest[:, 0].view(np.uint64) ^ mix(text.astype(np.uint64)))
    out = np.zeros(len(digest), dtype=bool)
    out[np.unique(key, return_index=True)[1]] = True
    return out


def reference_runs(source: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (id, position, windows, source, at) of rows (id, text_): runs of windows that stand in a smaller id too."""

    def anchors(batches):
        find = Windows(window)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, _, data, bounds in text_chunks(batch.column(1)):
                owner, _, _, anchor, _ = find.runs(data, bounds)
                if len(owner):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(ids[first + owner])], names=["anchor", "id"])

    shares = source.mapInArrow(anchors, "anchor bigint, id bigint").groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    shared = shared_bitmap(shares.where("a < b").select("anchor"))
    names, schema = ["high", "low", "id", "position", "windows", "fresh"], "high bigint, low bigint, id bigint, position int, windows int, fresh boolean"

    def rows(digest, ids, position, windows, text):
        arrays = [digest[:, 0], digest[:, 1], ids, position.astype(np.int32), windows.astype(np.int32), _fresh(digest, text)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)

    def blocks(batches):
        find = Windows(window)
        for _, text, ids, position, windows, heads in _texts(batches, find, view_bits(shared)):
            yield rows(find.digests(heads, windows), ids, position, windows, text)

    held, _ = write_out(source.mapInArrow(blocks, schema), "blocks")
    places = _first_places(held, "high", "low", "windows")
    whole, _ = write_out(held.join(places, ["high", "low", "windows"]).where("id > source").select("high", "low", "id", "position", "windows", "source", "at"), "parsed-blocks")

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_parsed_key(batch.column(0).to_numpy(), batch.column(1).to_numpy()).view(np.int64))], names=["key"])

    parsed = shared_bitmap(whole.select("high", "id").mapInArrow(keys, "key bigint"))

    def single(find, text, ids, position, windows, heads):
        step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        text, ids, position, heads = (np.repeat(x, windows) for x in (text, ids, position, heads))
        position, heads = position + step, heads + step
        for k in range(0, len(heads), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield rows(find.digests(heads[part]), ids[part], position[part], np.ones(len(heads[part])), text[part])

    def open_windows(batches):
        find, bits = Windows(window), view_bits(parsed)
        for _, text, ids, position, windows, heads in _texts(batches, find, view_bits(shared)):
            left = np.flatnonzero(~holds(bits, _parsed_key(np.ascontiguousarray(find.digests(heads, windows)[:, 0]), ids)))
            yield from single(find, text[left], ids[left], position[left], windows[left], heads[left])

    def chance(batches):  # blocks that are not parsed though the bitmap says so
        bits = view_bits(parsed)
        for batch in batches:
            yield batch.filter(pa.array(holds(bits, _parsed_key(batch.column(0).to_numpy(), batch.column(2).to_numpy()))))

    def missed_windows(batches):
        find = Windows(window)
        for batch, text, ids, position, windows, heads in _texts(batches, find, view_bits(shared)):
            wanted = [set(x.as_py()) for x in batch.column(2)]
            left = np.flatnonzero([p in wanted[t] for t, p in zip(text.tolist(), position.tolist())])
            yield from single(find, text[left], ids[left], position[left], windows[left], heads[left])

    found = source.mapInArrow(open_windows, schema)
    missed = held.mapInArrow(chance, schema).join(whole.select("high", "low", "windows", "id"), ["high", "low", "windows", "id"], "left_anti")
    missed, _ = write_out(missed.groupBy("id").agg(F.collect_set("position").alias("positions")), "missed-blocks")
    listed = missed.count()
    if listed:
        hint = F.broadcast if listed <= BROADCAST_IDS else (lambda df: df)
        found = found.unionByName(source.join(hint(missed), "id").select("id", "text_", "positions").mapInArrow(missed_windows, schema))
    met = found.select("high", "low", "id", "position", "windows").join(_first_places(found, "high", "low"), ["high", "low"]).where("id > source")
    columns = ["id", "position", "windows", "source", "at"]
    return whole.select(columns).unionByName(met.select(columns))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Remove every word covered by a ``window``-word window that also starts in a document with a smaller id.

    Returns id_col, n_words, n_removed (long), kept_sha256 (of the kept words joined by one space), spans (array of the
    removed [start, end) word ranges) and factors (array of (start, source, at, words): where the parse found them), a row for each input row.

    * Nulls: a null text has no words. Rows with a null id lose nothing and are no reference.
    * Empty and short texts have no window and keep all words. Very long texts are parsed whole.
    * Ties: windows are judged on the input. A block's or window's source is the smallest id that holds it.
    * Repeated rows: rows of one id are one document that they all get the result of; they do not remove each other.
    * An empty table gives an empty result. Other columns are not carried, so their names cannot clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text_"))
    runs = reference_runs(named, window).groupBy("id").agg(F.collect_list(F.struct("position", "windows", "source", "at")).alias("found"))
    lists, _ = write_out(runs, "repeats")
    marked = shared_bitmap(lists.select(F.xxhash64("id")))
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_"), F.xxhash64(F.col(id_col).cast("long")).alias("slot_"))
    schema = f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:int,end:int>>, factors array<struct<start:int,source:bigint,at:int,words:int>>"
    hit = pa.list_(pa.struct([("position", pa.int32()), ("windows", pa.int32()), ("source", pa.int64()), ("at", pa.int32())]))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    factor = pa.list_(pa.struct([("start", pa.int32()), ("source", pa.int64()), ("at", pa.int32()), ("words", pa.int32())]))

    def marked_rows(batches):
        bits = view_bits(marked)
        for batch in batches:
            yield batch.filter(pa.array(holds(bits, batch.column(2).to_numpy())))

    def clear_rows(batches):
        bits = view_bits(marked)
        for batch in batches:
            rest = batch.filter(pa.array(~holds(bits, batch.column(2).to_numpy())))
            yield from cut([pa.RecordBatch.from_arrays([rest.column(0), rest.column(1), pa.nulls(rest.num_rows, hit)], names=[id_col, "text_", "found"])])

    def cut(batches):
        for batch in batches:
            texts, lists, rows = batch.column(1).fill_null("").cast(pa.large_binary()), batch.column(2), []
            for i in range(batch.num_rows):
                own = lists[i].values
                parsed = factors(np.stack([own.field(k).to_numpy().astype(np.int64) for k in range(4)], axis=1), window) if own is not None and len(own) else []
                rows.append((*_kept(texts[i].as_py(), parsed), parsed))
            columns = list(zip(*rows)) or [[]] * 5
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for s in columns[3]], span)
            parses = pa.array([[dict(zip(("start", "source", "at", "words"), x)) for x in s] for s in columns[4]], factor)
            arrays = [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), spans, parses]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_words", "n_removed", "kept_sha256", "spans", "factors"])

    row = f"`{id_col}` {kind}, text_ string, slot_ bigint"
    clear = source.mapInArrow(clear_rows, schema)
    other = source.mapInArrow(marked_rows, row)
    other = other.join(lists.withColumnRenamed("id", "id_"), F.col(id_col).cast("long") == F.col("id_"), "left").select(id_col, "text_", "found")
    return clear.unionByName(other.mapInArrow(cut, schema))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and a digest of the kept words of every document."""
    small_batches(spark)
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")
