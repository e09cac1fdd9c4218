"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression. Code points become classes (with what the pattern looks ahead for: white space
before visible text, and the letters that can follow an apostrophe), and the public pattern is an automaton over them. A
class is a transition function of its states, and functions compose associatively, so the scan is parallel: every block of
BLOCK code points is composed to one function, all blocks at once; an associative scan over the blocks' functions gives the
state in which each begins; and from these all blocks are run again at once to mark where tokens begin. The slices
between the marks feed pair merging through a bounded cache. Their offsets are kept and returned, and decoding gives each
slice's bytes back by them.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaloom.llm._shared import documents, small_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct slices that one task remembers; the cache starts anew beyond it.
CACHE_SLICES = 400_000
#: Code points that one vectorised scan looks at (a single longer text is still taken whole).
STEP_CHARS = 1 << 20
_OTHER, _LETTER, _NUMBER, _SPACE, _GAP = range(5)
_GAP_CODE = 0x110000
_NONE = 1 << 40
#: Code points that one block of the scan composes.
BLOCK = 128
#: Unicode's White_Space code points.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point; one more entry for the gap between documents.

    Letters and numbers of newer Unicode versions, on which the installed tables disagree, count as the public
    tokenizer library counts them.
    """
    names, kinds = list(map(unicodedata.category, map(chr, range(_GAP_CODE)))), {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(name[0], _OTHER) for name in names), np.uint8, _GAP_CODE)
    for pattern, kind in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER)):
        newer, ranks = regex.compile(pattern), {bytes([b]): b for b in range(256)}
        judge = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for code in (c for c, name in enumerate(names) if name == "Cn" and newer.match(chr(c))):
            if judge.encode_ordinary(chr(code)):
                table[code] = kind
    table[_WHITE] = _SPACE
    return np.append(table, np.uint8(_GAP))


#: Classes of the scan: the letters after an apostrophe (s, t, m, d alone; r and v before e, l before l) and white space
#: before visible text (U+0020, which joins it, and others) are told apart.
_CLASSES = ("other", "letter", "number", "white", "gap", "quote", "one", "two", "join", "alone")
#: States: what the code points since the last token began are.
_STATES = ("start", "letters", "numbers", "others", "quote", "two", "done", "white", "join", "alone")
_BEGIN = 16


@lru_cache(1)
def transitions() -> np.ndarray:
    """Table [16 * class + state]: the next state, plus _BEGIN if a token begins at the code point."""
    fresh = {"other": "others", "letter": "letters", "number": "numbers", "white": "white", "quote": "quote", "one": "letters", "two": "letters", "join": "join", "alone": "alone"}
    letters, marks = ("letter", "one", "two"), ("other", "quote")
    goes_on = {"letters": dict.fromkeys(letters, "letters"), "numbers": {"number": "numbers"}, "others": dict.fromkeys(marks, "others"), "white": {"white": "white"}}
    goes_on["quote"] = dict.fromkeys(marks, "others") | {"one": "done", "two": "two"}
    goes_on["two"] = dict.fromkeys(letters, "done")
    goes_on["join"] = goes_on["letters"] | goes_on["numbers"] | goes_on["others"]
    table = np.zeros(16 * len(_CLASSES), dtype=np.uint8)
    for c, kind in enumerate(_CLASSES):
        for k, state in enumerate(_STATES):
            stays = goes_on.get(state, {}).get(kind)
            if stays:
                table[16 * c + k] = _STATES.index(stays)
            elif kind != "gap":
                table[16 * c + k] = _BEGIN + _STATES.index(fresh[kind])
    return table


def scan_classes(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The scan's class of each code point, looking ahead by two at most."""
    kind = table[codes]
    out = kind.copy()
    visible = np.append((kind[1:] != _SPACE) & (kind[1:] != _GAP), False)
    space = kind == _SPACE
    out[space & visible] = _CLASSES.index("alone")
    out[(codes == 0x20) & visible] = _CLASSES.index("join")
    quote = np.flatnonzero(codes == 0x27)
    out[quote] = _CLASSES.index("quote")
    after = quote[quote + 1 < len(codes)] + 1
    out[after[np.isin(codes[after], np.frombuffer("stmd".encode("utf-32-le"), np.uint32))]] = _CLASSES.index("one")
    after = after[after + 1 < len(codes)]
    for a, b in ("re", "ve", "ll"):
        out[after[(codes[after] == ord(a)) & (codes[after + 1] == ord(b))]] = _CLASSES.index("two")
    return out


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Transition functions one after the other; a function is a row of next states."""
    return np.take_along_axis(then, first, axis=1)


def token_starts(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Positions where pre-tokens begin in code points of texts, each text followed by one gap."""
    n, step, states = len(codes), transitions(), len(_STATES)
    blocks = -(-n // BLOCK)
    kinds = np.full(blocks * BLOCK, 16 * _GAP, dtype=np.uint8)
    kinds[:n] = 16 * scan_classes(codes, table)
    columns = np.ascontiguousarray(kinds.reshape(blocks, BLOCK).T)
    done = np.repeat(np.arange(states, dtype=np.uint8)[:, None], blocks, axis=1)  # [state, block]: what the block makes of it
    for column in columns:
        done = step[done + column] & (_BEGIN - 1)
    through, reach = np.ascontiguousarray(done.T).astype(np.intp), 1  # inclusive scan: block k after block k - 1, k - 2, ...
    while reach < blocks:
        through[reach:] = compose(through[:-reach].copy(), through[reach:])
        reach *= 2
    state = np.concatenate(([0], through[:-1, 0])).astype(np.uint8)
    begin = np.empty((BLOCK, blocks), dtype=bool)
    for k, column in enumerate(columns):
        state = step[state + column]
        begin[k] = state >= _BEGIN
        state &= _BEGIN - 1
    return np.flatnonzero(np.ascontiguousarray(begin.T).ravel()[:n])


class Vocabulary:
    """Ranks of a public tokenizer: pair merging for encoding, byte offsets for decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        get, self.pairs = self.ranks.get, {}
        for piece, rank in self.ranks.items():
            for cut in range(1, len(piece)):
                left = get(piece[:cut])
                if left is not None and (right := get(piece[cut:])) is not None:
                    self.pairs[left << 20 | right] = rank
        ordered = sorted((rank, piece) for piece, rank in self.ranks.items())
        size = ordered[-1][0] + 1
        self.length = np.zeros(size, dtype=np.int64)
        self.length[[rank for rank, _ in ordered]] = [len(piece) for _, piece in ordered]
        self.offset = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.data = np.frombuffer(b"".join(piece for _, piece in ordered), dtype=np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token: the lowest-ranked adjacent pair is merged, leftmost first, until none is left."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        if len(piece) > 400:
            return self._merge_long(piece)
        get, single = self.pairs.get, self.single
        ids = [single[b] for b in piece]
        near = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while near:
            best = min(near)
            if best == _NONE:
                break
            at = near.index(best)
            ids[at] = best
            del ids[at + 1], near[at]
            if at < len(near):
                near[at] = get(best << 20 | ids[at + 1], _NONE)
            if at:
                near[at - 1] = get(ids[at - 1] << 20 | best, _NONE)
        return ids

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and a linked list: long runs of letters take n log n steps."""
        get = self.pairs.get
        ids = [self.single[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(rank << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            h = before[i]
            if h >= 0 and (r := get(ids[h] << 20 | rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, gathered from the vocabulary by offsets."""
        if not len(ids):
            return b""
        size = self.length[ids]
        end = np.cumsum(size)
        index = np.arange(end[-1]) + np.repeat(self.offset[ids] - (end - size), size)
        return self.data[index].tobytes()

    def slice_ends(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ends in bytes of the pre-tokens of a text, which have ``counts`` ids each."""
        return np.concatenate((np.zeros(1, np.int64), np.cumsum(self.length[ids])))[np.cumsum(counts)]


class _Cache(dict):
    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_SLICES:
            self.clear()
        ids = np.array(self.vocabulary.merge(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def encode_texts(texts: list[str], cache: _Cache, table: np.ndarray) -> list[tuple[bytes, list[int], list[int]]]:
    """(ids as little-endian unsigned 32-bit integers, where pre-tokens begin in code points, ids of each) of every text."""
    out, i = [], 0
    while i < len(texts):
        group, size = [], 0
        while i < len(texts) and (not group or size + len(texts[i]) <= STEP_CHARS):
            group.append(texts[i])
            size += len(texts[i]) + 1
            i += 1
        lengths = np.array([len(t) for t in group])
        codes = np.frombuffer("\n".join(group).encode("utf-32-le") + b"\n\0\0\0", dtype=np.uint32).copy()
        stops = np.cumsum(lengths + 1) - 1
        codes[stops] = _GAP_CODE
        begins = token_starts(codes, table)
        owner = np.searchsorted(begins, np.concatenate(([0], stops + 1)))
        for k, text in enumerate(group):
            base = int(stops[k] - lengths[k])
            marks = (begins[owner[k] : owner[k + 1]] - base).tolist()
            slices = [cache[text[a:b]] for a, b in zip(marks, [*marks[1:], len(text)])]
            out.append((b"".join(slices), marks, [len(x) // 4 for x in slices]))
    return out


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, offsets: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns id_col, ``ids`` (binary: little-endian unsigned 32-bit token ids) and ``decoded`` (binary: the decoded
    bytes); with ``offsets`` also ``slices``, an array of (start, tokens, end_byte) for the pre-tokens: where each begins in the text
    (code points), how many ids it has and where its bytes end in ``decoded``. ``path`` is a rank file that executors can open;
    the default is the public file installed with the tokenizers.

    * Nulls: a null text counts as empty, a null id stays.
    * An empty text has no ids. Very long texts are encoded whole; a slice beyond 400 bytes is merged with a heap.
    * Ties: of equal ranks the leftmost pair is merged first.
    * Repeated rows: a row for each input row. An empty table gives an empty result.
    * Other columns of the input are not carried, so their names cannot clash.
    """
    kind, packed = docs.schema[id_col].dataType.simpleString(), zlib.compress(classes().tobytes())
    names = [id_col, "ids", "decoded"] + ["slices"] * offsets
    slot = pa.list_(pa.struct([("start", pa.int32()), ("tokens", pa.int32()), ("end_byte", pa.int32())]))

    def placed(vocabulary, ids, marks, counts):
        ends = vocabulary.slice_ends(ids, np.array(counts, dtype=np.int64)).tolist()
        return [{"start": a, "tokens": n, "end_byte": b} for a, n, b in zip(marks, counts, ends)]

    def run(batches):
        vocabulary = Vocabulary(path or public_tokenizers.path(VOCABULARY))
        cache, table = _Cache(vocabulary), np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                coded = encode_texts(part.column(1).fill_null("").to_pylist(), cache, table)
                ids = [np.frombuffer(x, dtype="<u4") for x, _, _ in coded]
                arrays = [part.column(0), pa.array([x for x, _, _ in coded], pa.binary()), pa.array([vocabulary.decode(x) for x in ids], pa.binary())]
                if offsets:
                    arrays.append(pa.array([placed(vocabulary, x, marks, counts) for x, (_, marks, counts) in zip(ids, coded)], slot))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"`{id_col}` {kind}, ids binary, decoded binary" + ", slices array<struct<start:int,tokens:int,end_byte:int>>" * offsets
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_")).mapInArrow(run, schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every whole document."""
    small_batches(spark)
    coded = encode_decode(documents(spark, sf_dir))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
