"""Language ID by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over
all its segmentations into pieces, which the forward algorithm computes for all languages at once; a text's is
the product over its words. The piece probabilities come from expectation maximisation (forward and backward passes) on
a bounded sample of labelled documents. Each task remembers the scores of words it has met, within a bound.

A word is a whole run of letters, however long: the forward pass keeps as many positions as the longest piece has letters,
scaled so that nothing underflows, so unspaced text is summed over all its segmentations in bounded memory.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from deltaloom.llm._shared import SpanHasher, documents, give_back, keyed_texts, mix, share, small_batches, training_part
from deltaloom.llm.bpe import _LETTER, classes

VOCABULARY = "piece_bpe_32k.model"
#: Bounds of the training sample: so many documents of each language at most, those with the smallest crc32 of the id, and
#: whole documents until so many characters are reached.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 8_000_000
#: Training, which keeps whole tables, teaches from longer runs of letters in parts of so many (scoring never cuts).
LONGEST = 32
#: (word, position) pairs for which pieces are looked up at once, words that are scored together, and when to scale up.
_CELLS, _TOGETHER, _TINY = 1 << 16, 8192, 2.0**-600
#: Distinct words whose scores one task remembers.
CACHE_WORDS = 300_000
#: Longer words are scored each time they come.
CACHE_BYTES = 256
_STEP_CHARS = 1 << 20
_UNKNOWN = 1e-7
_BITS = 22
_START = np.uint64(0x5851F42D4C957F2D)


class Pieces:
    """Hash table of the vocabulary: pieces that begin a word and pieces inside one are told apart."""

    def __init__(self, pieces: list[str]):
        self.hasher = SpanHasher()
        keys = []
        for piece in pieces:
            head = piece.startswith("▁")
            codes = np.frombuffer(piece.lstrip("▁").encode("utf-32-le"), dtype=np.uint32)
            if len(codes):
                h = self.hasher(codes, np.array([0]), np.array([len(codes)]))[0]
                keys.append((h ^ _START if head else h, head, codes))
        self.keys, index = np.unique(np.array([k for k, _, _ in keys], dtype=np.uint64), return_index=True)
        self.longest = max((len(codes) for _, _, codes in keys), default=1)
        self.heads, self.sizes = np.array([keys[k][1] for k in index], dtype=bool), np.array([len(keys[k][2]) for k in index])
        self.letters = np.zeros((len(index), self.longest), dtype=np.uint32)
        for row, k in enumerate(index):
            self.letters[row, : len(keys[k][2])] = keys[k][2]
        self.there = np.zeros(1 << _BITS, dtype=bool)
        self.there[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray, heads: np.ndarray | bool = False, starts: np.ndarray | None = None, length: int = 0) -> np.ndarray:
        """Numbers of the pieces with these hashes; len(keys) for none.

        With ``starts`` the code points loaded in the hasher decide, and which spans begin a word: spans of ``length`` code points that
        were built to collide with a piece are none.
        """
        out = np.full(len(hashes), len(self.keys), dtype=np.int32)
        maybe = np.flatnonzero(self.there[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == hashes[maybe])
        maybe, at = maybe[hit], at[hit]
        if starts is None:
            out[maybe] = at
            return out
        same = (self.sizes[at] == length) & (self.heads[at] == (heads if isinstance(heads, bool) else heads[maybe]))
        for k in range(length if len(at) else 0):
            same &= self.letters[at, k] == self.hasher.codes[starts[maybe] + k]
        out[maybe[same]] = at[same]
        return out


class Lattice:
    """All segmentations of some short words (spans of code points), words ordered by falling length, for training.

    ``inner`` marks spans that begin inside a word.
    """

    def __init__(self, pieces: Pieces, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, inner: np.ndarray | None = None):
        self.pieces, size = pieces, ends - starts
        self.order = np.argsort(-size, kind="stable")
        self.starts, self.size = starts[self.order], size[self.order]
        begins = np.ones(len(size), dtype=bool) if inner is None else ~inner[self.order]
        head = np.where(begins, _START, np.uint64(0))
        self.most = int(self.size[0]) if len(size) else 0
        self.reach = np.searchsorted(-self.size, -np.arange(1, self.most + 1), side="right")
        self.arcs = []
        for j in range(1, self.most + 1):
            n = self.reach[j - 1]
            for i in range(max(0, j - pieces.longest), j):
                h = pieces.hasher.again(self.starts[:n] + i, self.starts[:n] + j)
                found = pieces.find(h ^ head[:n] if i == 0 else h, begins[:n] if i == 0 else False, self.starts[:n] + i, j - i)
                rows = np.flatnonzero(found < len(pieces.keys)) if j - i > 1 else np.arange(n)
                if len(rows):
                    self.arcs.append((i, j, rows, found[rows]))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[word, position, language]; p: a row for each piece, the last for unknown letters."""
        alpha = np.zeros((len(self.size), self.most + 1, p.shape[1]))
        alpha[:, 0] = 1
        for i, j, rows, found in self.arcs:
            alpha[rows, j] += alpha[rows, i] * p[found]
        return alpha

    def totals(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[np.arange(len(self.size)), self.size]

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by each language; counts: of each word in each language."""
        alpha = self.forward(p)
        beta = np.zeros_like(alpha)
        beta[np.arange(len(self.size)), self.size] = 1
        for i, j, rows, found in reversed(self.arcs):
            beta[rows, i] += beta[rows, j] * p[found]
        share = counts[self.order] / self.totals(alpha)
        uses = np.zeros_like(p)
        for i, j, rows, found in self.arcs:
            gain = alpha[rows, i] * p[found] * beta[rows, j] * share[rows]
            for k in range(p.shape[1]):
                uses[:, k] += np.bincount(found, weights=gain[:, k], minlength=len(p))
        return uses


def split_lattices(pieces: Pieces, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, inner: np.ndarray | None = None, words: int = _TOGETHER):
    """Yield (word numbers, lattice) for words in groups of similar length, so that no table is large."""
    order = np.argsort(ends - starts, kind="stable")
    for first in range(0, len(order), words):
        own = order[first : first + words]
        yield own, Lattice(pieces, codes, starts[own], ends[own], None if inner is None else inner[own])


def log_totals(pieces: Pieces, starts: np.ndarray, ends: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations of each word in each language; the code points are loaded in the hasher.

    Words of similar length go through the forward pass together, a ring of alphas as long as the longest piece.
    """
    out = np.empty((len(starts), p.shape[1]))
    by_size = np.argsort(starts - ends, kind="stable")  # longest first
    for first in range(0, len(by_size), _TOGETHER):
        own = by_size[first : first + _TOGETHER]
        out[own] = _forward(pieces, starts[own], ends[own] - starts[own], p)
    return out


def _forward(pieces: Pieces, starts: np.ndarray, size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log_totals of some words ordered by falling length."""
    depth, n, most = pieces.longest + 1, len(size), int(size[0])
    ring, scaled, out = np.zeros((depth, n, p.shape[1])), np.zeros((n, p.shape[1])), np.empty((n, p.shape[1]))
    ring[0] = 1
    low, first = np.log(_TINY), 1
    while first <= most:
        live = int(np.searchsorted(-size, -first, side="right"))
        last = min(most, first + max(1, _CELLS // live) - 1)
        word = np.repeat(np.arange(live), np.minimum(size[:live], last) - first + 1)  # all (word, end) of these steps
        end = np.arange(len(word)) - np.repeat(np.searchsorted(word, np.arange(live)), np.minimum(size[:live], last) - first + 1) + first
        hits = []
        for length in range(1, min(pieces.longest, last) + 1):
            some = slice(None) if length <= first else np.flatnonzero(end >= length)
            w, e = word[some], end[some]
            h = pieces.hasher.again(starts[w] + e - length, starts[w] + e)
            found = pieces.find(np.where(e == length, h ^ _START, h) if first <= length else h, e == length, starts[w] + e - length, length)
            kept = slice(None) if length == 1 else np.flatnonzero(found < len(pieces.keys))
            hits.append((e[kept], w[kept], np.full(len(w[kept]), length), found[kept]))
        e, w, length, found = (np.concatenate(x) for x in zip(*hits))
        order = np.lexsort((w, e))
        e, w, came, found = e[order], w[order], (e - length)[order] % depth, found[order]
        heads = np.flatnonzero(np.append(True, (e[1:] != e[:-1]) | (w[1:] != w[:-1])))  # every (end, word) has its last letter
        cuts, groups = np.searchsorted(e, np.arange(first, last + 2)), np.searchsorted(e[heads], np.arange(first, last + 2))
        for k in range(last - first + 1):
            a, b, j = cuts[k], cuts[k + 1], first + k
            now = np.add.reduceat(ring[came[a:b], w[a:b]] * p[found[a:b]], heads[groups[k] : groups[k + 1]] - a, axis=0)
            ring[j % depth, : len(now)] = now
            small = np.nonzero(now < _TINY)
            if len(small[0]):
                ring[:, small[0], small[1]] /= _TINY
                scaled[small] += low
            done = slice(int(np.searchsorted(-size, -j, side="left")), len(now))
            if done.start < done.stop:
                out[done] = np.log(ring[j % depth, done]) + scaled[done]
        first = last + 1
    return out


class _CodeHasher(SpanHasher):
    """Hashes of spans of one array of code points, asked for again and again."""

    def load(self, codes: np.ndarray) -> None:
        self(codes, np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.codes = codes
        self.prefix = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.up[: len(codes)], out=self.prefix[1:])

    def again(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.down[starts])


def letter_runs(texts: list[str], table: np.ndarray):
    """Lower-cased code points of the texts, and the runs of letters in them: (codes, starts, ends, owner)."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le"), dtype=np.uint32)
    letter = np.concatenate(([False], table[codes] == _LETTER, [False]))
    starts = np.flatnonzero(letter[1:] & ~letter[:-1])
    ends = np.flatnonzero(letter[:-1] & ~letter[1:])
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), starts, side="right")
    return codes, starts, ends, owner


def named(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(number of each run's word, where each word stands first among the runs, the words as bytes): equal numbers mean equal words."""
    inside = np.zeros(len(codes) + 1, dtype=np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    letters = codes[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64) * 4
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters.tobytes())]).dictionary_encode()
    number = words.indices.to_numpy()
    first = np.empty(len(words.dictionary), dtype=np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    return number, first, words.dictionary.to_pylist()


def _packed(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where spans start and end once nothing lies between them."""
    stop = np.cumsum(ends - starts)
    return stop - (ends - starts), stop


def _places(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of all letters of some spans, span by span."""
    size, most = ends - starts, int(ends.max(initial=0))
    kind = np.int32 if max(most, int(size.sum())) < 1 << 31 else np.int64
    at = np.arange(int(size.sum()), dtype=kind)
    at += np.repeat((starts - _packed(starts, ends)[0]).astype(kind), size)
    return at


def named_parts(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of spans that may touch: equal numbers mean equal spans."""
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64) * 4
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(codes[_places(starts, ends)])])
    return spans.dictionary_encode().indices.to_numpy().astype(np.int64)


def short_parts(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray):
    """Runs in parts of LONGEST letters at most: (starts, ends, owner, which begin inside a run)."""
    parts = (ends - starts + LONGEST - 1) // LONGEST
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(starts, parts) + nth * LONGEST
    return starts, np.minimum(np.repeat(ends, parts), starts + LONGEST), np.repeat(owner, parts), nth > 0


class Model:
    """Piece probabilities of each language."""

    def __init__(self, path: str | None, texts: dict[str, list[str]], rounds: int = 4):
        reader = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
        usable = (k for k in range(reader.get_piece_size()) if not (reader.is_control(k) or reader.is_unknown(k) or reader.is_byte(k)))
        self.pieces = Pieces([reader.id_to_piece(k) for k in usable])
        self.pieces.hasher = _CodeHasher()
        self.table = zlib.compress(classes().tobytes())
        self.languages = sorted(texts)
        self.p = np.full((len(self.pieces.keys) + 1, len(texts)), 1.0 / (len(self.pieces.keys) + 1))
        if not texts:
            return
        table = self.classes()
        flat = [(k, t) for k, name in enumerate(self.languages) for t in texts[name]]
        codes, starts, ends, owner = letter_runs([t for _, t in flat], table)
        if not len(starts):
            return
        starts, ends, owner, inner = short_parts(starts, ends, owner)
        language = np.array([k for k, _ in flat])[owner]
        del flat, owner
        _, first, word = np.unique(named_parts(codes, starts, ends) * 2 + inner, return_index=True, return_inverse=True)
        codes, starts, ends, inner = codes[_places(starts[first], ends[first])], *_packed(starts[first], ends[first]), inner[first]  # each word once
        self.pieces.hasher.load(codes)
        counts = np.zeros((len(first), len(self.languages)))
        np.add.at(counts, (word, language), 1.0)
        lattices = list(split_lattices(self.pieces, codes, starts, ends, inner))
        for _ in range(rounds):
            uses = sum(lattice.expected(self.p, counts[own]) for own, lattice in lattices)
            pooled = uses.sum(1, keepdims=True)
            pooled = (pooled + 0.01) / (pooled + 0.01).sum()
            own = (uses + 5.0 * pooled) / (uses.sum(0) + 5.0)
            self.p = np.maximum(own, _UNKNOWN * 1e-2)
            self.p[-1] = _UNKNOWN

    def classes(self) -> np.ndarray:
        return np.frombuffer(zlib.decompress(self.table), dtype=np.uint8)


class Scorer:
    """Log probabilities of texts in each language."""

    def __init__(self, model: Model):
        self.model, self.table = model, model.classes()
        self._clear()

    def _clear(self):
        self.known, self.values = {}, np.zeros((0, len(self.model.languages)))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the words' log probabilities, words) of each text, which depend on the text alone."""
        pieces = self.model.pieces
        codes, starts, ends, owner = letter_runs(texts, self.table)
        total = np.zeros((len(texts), len(self.model.languages)))
        if len(starts):
            pieces.hasher.load(codes)
            word, first, words = named(codes, starts, ends)
            if len(self.values) > CACHE_WORDS:
                self._clear()
            at = np.array([self.known.get(w, -1) for w in words], dtype=np.int64)
            new = np.flatnonzero(at < 0)
            if len(new):
                fresh = log_totals(pieces, starts[first[new]], ends[first[new]], self.model.p)
                at[new] = np.arange(len(self.values), len(self.values) + len(new))
                self.known.update((words[k], row) for k, row in zip(new.tolist(), at[new].tolist()) if len(words[k]) <= CACHE_BYTES)
                self.values = np.concatenate((self.values, fresh))
            scores = self.values[at][word]
            for k in range(total.shape[1]):
                total[:, k] = np.bincount(owner, weights=scores[:, k], minlength=len(texts))
        return total, np.bincount(owner, minlength=len(texts)) if len(starts) else np.zeros(len(texts), np.int64)


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, path: str | None = None, bound: int = SAMPLE_DOCS) -> Model:
    """Fit on ``bound`` documents of each language at most; rows without a text or a language teach nothing.

    Only whole documents are taken, until SAMPLE_CHARS characters are reached, one of each language at least.
    """
    docs = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {row[0]: row[1] for row in docs.groupBy(F.col(lang_col).alias("l")).count().collect()}
    texts: dict[str, list[str]] = {name: [] for name in counts}
    if counts:
        order = F.crc32(F.col(id_col).cast("string").cast("binary"))
        share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(2**32, int(1.5 * (bound + 20) / n * 2**32)))])
        rows = docs.where(order < share[F.col(lang_col)]).select(F.col(lang_col).alias("l"), order.alias("o"), F.col(id_col).alias("i"), F.col(text_col).alias("t"))
        size = F.sum(F.length("t")).over(Window.partitionBy("l").orderBy("o", F.col("i").cast("string")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        room = SAMPLE_CHARS // len(counts)
        rows = rows.withColumn("held", size).where((F.col("held") <= room) | (F.col("held") == F.length("t")))
        for row in sorted(rows.collect(), key=lambda r: (r.o, str(r.i))):
            if len(texts[row.l]) < bound:
                texts[row.l].append(row.t)
    model = Model(path, texts)
    del texts
    give_back()
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Rows (id_col, lang_pred string, score double): the likeliest learned language of every whole text.

    ``score`` is its share of the probability, 0 to 1. With ``carry`` the first column is not the id but ``row``, a struct of the
    whole input row.

    * Nulls and empty texts: a text that is null or holds no letter is ``und`` with score 0, as is everything if no
      language was learned; a null id stays.
    * Very long texts, and very long runs of letters, are scored whole.
    * Ties go to the smaller name. Repeated rows: a row for each input row. An empty table gives an empty result.
    * Other columns are not carried but in ``row``, so their names cannot clash.
    """
    source, head = keyed_texts(docs, id_col, text_col, carry)
    key = source.columns[0]
    model.pieces.hasher = _CodeHasher()
    shared = share(docs.sparkSession, model)  # bounded: vocabulary times languages

    def run(batches):
        scorer = Scorer(pickle.loads(shared.value))
        names = np.array(["und", *scorer.model.languages], dtype=object)
        for batch in batches:
            texts, pred, score = batch.column(1).fill_null("").to_pylist(), [], []
            first = 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) <= _STEP_CHARS):
                    size += len(texts[last])
                    last += 1
                total, words = scorer(texts[first:last])
                if total.shape[1]:
                    best = total.argmax(1)
                    odds = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                    pred.append(names[np.where(words > 0, best + 1, 0)])
                    score.append(np.where(words > 0, odds, 0.0))
                else:
                    pred.append(names[np.zeros(last - first, np.int64)])
                    score.append(np.zeros(last - first))
                first = last
            arrays = [pa.array(np.concatenate(pred), pa.string()), pa.array(np.concatenate(score))] if pred else [pa.array([], pa.string()), pa.array([], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, "lang_pred", "score"])

    return source.mapInArrow(run, f"{head}, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; those whose crc32 modulo 4 is 2 are held out."""
    small_batches(spark)
    held = training_part(F.col("doc_id"), 4) == 2
    model = train(documents(spark, sf_dir, "doc_id", "text", "lang").where(~held), "doc_id", "text", "lang")
    found = identify(documents(spark, sf_dir), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
