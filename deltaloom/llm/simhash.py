"""SimHash near-dedup with pigeonring filtering.

A 64-bit fingerprint has eight segments of eight bits in a ring. If two fingerprints differ in at most 3 bits,
some rotation exists at which, for every l, the first l segments differ in at most floor(3 l / 8) bits (the
pigeonring principle). So segments 1-2 are equal and segments 1-5 differ in at most one bit, which lies in one
of two halves of segments 3-5: 16 equal bits and 12 equal bits make a 28-bit key, two for each of 8 rotations.
Candidates that share a key must keep the whole chain within its budgets before the full Hamming check.

Looser similarities differ in too many bits for equal segments, so ``similar_documents`` compares fingerprints of WIDE bits
whose chains start at sampled bits: each of several keys is some bits drawn at random, as many as keep a chance
bucket at BUCKET rows, and there are so many keys that a pair just at the threshold shares one with probability FOUND. From there the lanes of 64 bits are a ring as above: cumulative differences must stay within
proportional budgets (and a slack of three standard deviations, for a start is sampled and not the best one). What that
joins are candidates only: within each of their components the sets of shingles are compared, and exact similarity makes the links.

Equal fingerprints are one node. Buckets larger than BLOCK are first searched in hashed blocks, each alone. What that joins
needs no more comparing: of each bucket only the rows outside its largest component then meet the others, block by block. A hot
bucket of near copies costs its rows, not its square, and each task returns only a spanning forest of the links it finds.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaloom.llm._shared import documents, fold_case, mix, small_batches, text_chunks, write_out
from deltaloom.llm.components import connected_components, least_of_component

DISTANCE = 3
SHINGLE = 3
BLOCK = 1024
#: Of ``similar_documents``: bits, words of a shingle, Jaccard similarity, rows of a chance bucket, recall of the keys.
WIDE, WORDS, SIMILARITY, BUCKET, FOUND = 512, 5, 0.8, 256, 0.99
#: Standard deviations of a fingerprint that its keys, and its full check, allow for.
KEYED, CHECKED = 1, 3
#: Shingles that count as one more row of a block (16 kB), so that blocks of sets stay near 16 MB.
ROW_SHINGLES = 2048
#: Ids are broadcast up to this number (16 MB), and joined by shuffle beyond it.
BROADCAST_IDS = 2_000_000


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the space-joined shingles of a sequence of words, repeats included; fewer words make one shingle, none make none."""
    if not words:
        return np.zeros(0, "<u8")
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    width = min(shingle, len(words))
    starts, ends = (ends - size)[: len(words) - width + 1], ends[width - 1 :]
    joined, digest, out = b" ".join(words), xxhash.xxh64_intdigest, np.empty(len(starts), "<u8")
    for first in range(0, len(starts), 8192):
        last = first + 8192
        out[first:last] = [digest(joined[a:b], 42) for a, b in zip(starts[first:last].tolist(), ends[first:last].tolist())]
    return out


def fingerprint(hashes: np.ndarray, bits: int = 64) -> bytes:
    """Fingerprint of shingle hashes, least bit first: a bit is set if it is set in over half of the hashes; zero without any.

    Beyond 64 bits the hashes are mixed again for each further lane.
    """
    total = np.zeros(bits, dtype=np.int64)
    for first in range(0, len(hashes), 8192):
        part = hashes[first : first + 8192]
        lanes = [part] + [mix(part + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) for k in range(1, bits // 64)]
        flags = np.unpackbits(np.stack(lanes, axis=1).view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(flags), 255):  # sums of 255 rows fit a byte
            total += np.add.reduce(flags[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes), bitorder="little").tobytes()


def text_fingerprint(words: list[bytes], shingle: int = SHINGLE, bits: int = 64) -> bytes:
    """Fingerprint of a sequence of words; zero without words."""
    return fingerprint(shingle_hashes(words, shingle), bits)


def _from_words(docs: DataFrame, id_col: str, text_col: str, columns: dict[str, pa.DataType], make, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id_col, *columns, *carry): the columns are bytes that ``make`` finds in the words of a text, A-Z as a-z."""
    kept = [docs.schema[c] for c in (id_col, *carry)]
    names = [id_col, *columns, *carry]

    def run(batches):
        for batch in batches:
            values = []
            for first, last, data, bounds in text_chunks(batch.column(1)):
                text = fold_case(data).tobytes()
                values += [make(text[bounds[i] : bounds[i + 1]].split()) for i in range(last - first)]
            found = [pa.array(np.frombuffer(b"".join(v[k] for v in values), dtype="<i8")) if pa.types.is_int64(kind) else pa.array([v[k] for v in values], kind) for k, kind in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found, *batch.columns[2:]], names=names)

    kinds = [f"`{c.name}` {c.dataType.simpleString()}" for c in kept]
    schema = ", ".join([kinds[0], *[f"{c} " + ("bigint" if pa.types.is_int64(kind) else "binary") for c, kind in columns.items()], *kinds[1:]])
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_"), *[F.col(c) for c in carry]).mapInArrow(run, schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id_col, fingerprint long, *carry).

    A-Z count as a-z; null and empty texts get fingerprint zero. A row for each input row, repeated rows included.
    """
    return _from_words(docs, id_col, text_col, {"fingerprint": pa.int64()}, lambda words: (text_fingerprint(words, shingle),), carry)


def shingle_set(words: list[bytes], shingle: int = WORDS) -> np.ndarray:
    """The different shingle hashes of a sequence of words, in order."""
    return np.unique(shingle_hashes(words, shingle))


def set_marks(docs: DataFrame, id_col: str, text_col: str, shingle: int, bits: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id_col, digest, fingerprint, *carry) of the set of shingles of each text; equal digests are equal sets."""

    def make(words):
        held = shingle_set(words, shingle)
        return hashlib.blake2b(held.tobytes(), digest_size=16).digest(), fingerprint(held, bits)

    return _from_words(docs, id_col, text_col, {"digest": pa.binary(), "fingerprint": pa.binary()}, make, carry)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows (id_col, digest, shingles): the set of shingles of each text as ordered 64-bit integers, and its digest."""

    def make(words):
        held = shingle_set(words, shingle).tobytes()
        return hashlib.blake2b(held, digest_size=16).digest(), held

    return _from_words(docs, id_col, text_col, {"digest": pa.binary(), "shingles": pa.binary()}, make)


def ring_keys():
    """Array of the 16 keys of the column ``fingerprint``."""
    keys = []
    for turn in range(8):
        f = "fingerprint" if not turn else f"((fingerprint << {8 * turn}) | shiftrightunsigned(fingerprint, {64 - 8 * turn}))"
        for half in range(2):
            keys.append(f"({2 * turn + half}L << 28) | ((shiftrightunsigned({f}, 48) & 65535L) << 12) | (shiftrightunsigned({f}, {36 - 12 * half}) & 4095L)")
    return F.expr(f"array({', '.join(keys)})")


def _within(x: np.ndarray, turn: int, distance: int) -> np.ndarray:
    """Indices of differences ``x`` whose chain from segment ``turn`` keeps its budgets, ending in the full check."""
    ring = (x << np.uint64(8 * turn)) | (x >> np.uint64(64 - 8 * turn)) if turn else x
    alive = np.arange(len(x))
    for l in range(3, 9):
        alive = alive[np.bitwise_count(ring[alive] >> np.uint64(64 - 8 * l)) <= distance * l // 8]
    return alive


def _forest(values: np.ndarray, nodes: np.ndarray, turn: int, distance: int, out: list) -> None:
    """Append the (node, node) edges of a spanning forest of the links inside one bucket."""
    left = np.arange(len(values))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = _within(values[left] ^ values[i], turn, distance)
            if len(hit):
                found = left[hit]
                out.extend((int(nodes[i]), int(nodes[j])) for j in found)
                queue.extend(found)
                left = np.delete(left, hit)


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy().view(np.uint64)[:, None]


def _lanes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(len(column), -1)


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v, dtype="<u8") for v in column.to_pylist()]


def _ring_compare(key: int, values: np.ndarray, nodes: np.ndarray, distance: int, out: list) -> None:
    _forest(values[:, 0], nodes, key >> 29, distance, out)


def budgets(distance: int, lanes: int) -> list[int]:
    """Most differing bits in the first 1, 2, ... lanes of a chain; the last is ``distance``."""
    share = distance / (64 * lanes)
    loose = [math.floor(distance * l / lanes + 3 * math.sqrt(64 * l * share * (1 - share))) for l in range(1, lanes)]
    return [*(min(x, distance) for x in loose), distance]


def _lane_compare(key: int, values: np.ndarray, nodes: np.ndarray, distance: int, out: list) -> None:
    """Append a forest of the links between wide fingerprints: pairs whose chain from the key's lane keeps its budgets."""
    lanes = values.shape[1]
    ring = np.roll(values, -(key >> 40) % lanes, axis=1)
    allowed = budgets(distance, lanes)
    i, j = np.nonzero(np.triu(np.bitwise_count(ring[:, None, 0] ^ ring[None, :, 0]) <= allowed[0], 1))
    apart = np.bitwise_count(ring[i, 0] ^ ring[j, 0]).astype(np.int64)
    for l in range(1, lanes):
        apart += np.bitwise_count(ring[i, l] ^ ring[j, l])
        near = np.flatnonzero(apart <= allowed[l])
        i, j, apart = i[near], j[near], apart[near]
    label = np.arange(len(nodes))
    while len(i):
        up = np.arange(len(nodes))
        np.minimum.at(up, i, j)
        np.minimum.at(up, j, i)
        while (up[up] != up).any():
            up = up[up]
        label, i, j = up[label], up[i], up[j]
        i, j = i[i != j], j[i != j]
    out.extend((int(nodes[k]), int(nodes[label[k]])) for k in np.flatnonzero(label != np.arange(len(nodes))))


def _set_compare(key: int, values: list[np.ndarray], nodes: np.ndarray, similarity: float, out: list) -> None:
    """Append a forest of the links between sets of shingles: pairs of at least this Jaccard similarity."""
    size = np.array([len(v) for v in values], dtype=np.int64)
    _, number, times = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = times[number] > 1  # the others are in no intersection
    number, owner = number[shared], np.repeat(np.arange(len(values)), size)[shared]
    mine = np.split(number, np.searchsorted(owner, np.arange(1, len(values))))
    left = np.ones(len(values), dtype=bool)
    for first in range(len(values)):
        if not left[first]:
            continue
        left[first], queue = False, [first]
        while queue:
            i = queue.pop()
            held = np.zeros(len(times), dtype=bool)
            held[mine[i]] = True
            both = np.bincount(owner[held[number]], minlength=len(values))
            hit = np.flatnonzero(left & (both > 0) & (both >= similarity * (size[i] + size - both) - 1e-9))
            if len(hit):
                out.extend((int(nodes[i]), int(nodes[j])) for j in hit)
                left[hit] = False
                queue.extend(hit.tolist())
                stays = left[owner]
                number, owner = number[stays], owner[stays]


def _compared(dealt: DataFrame, compare, limit: float, read) -> DataFrame:
    """Links (a, b) within groups of rows (key, part, x, y, fingerprint, node)."""

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None else table
            group = np.stack([rest.column(k).to_numpy() for k in range(4)])
            cut = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1
            if len(cut):
                yield from links(rest.slice(0, int(cut[-1])), cut[:-1])
                rest = rest.slice(int(cut[-1]))
        if rest is not None and rest.num_rows:
            yield from links(rest, np.zeros(0, np.int64))

    def links(table, cut):
        key, nodes, values, out = table.column(0).to_numpy(), table.column(5).to_numpy(), read(table.column(4)), []
        edges = np.concatenate(([0], cut, [len(key)]))
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > 1:
                compare(int(key[a]), values[a:b], nodes[a:b], limit, out)
        if out:
            pairs = np.array(out, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    group = ["key", "part", "x", "y"]
    return dealt.select(*group, "fingerprint", "node").repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a bigint, b bigint")


def bucket_links(keyed: DataFrame, compare, limit: float, read, block: int | None = None) -> DataFrame:
    """Links (a, b) between rows (key, fingerprint, node) that share a key: forests with the components of all links.

    A row counts as one row of a block, or as its ``weight`` if there is such a column.
    """
    block = block or BLOCK
    keyed = keyed if "weight" in keyed.columns else keyed.withColumn("weight", F.lit(1))
    counts = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.sum("weight").alias("total")).where("rows > 1")
    counts, _ = write_out(counts.select("key", "total"), "simhash-buckets")
    deal = lambda n, salt: F.expr(f"cast(pmod(xxhash64(node, {salt}), {n}) as int)")
    rows = keyed.join(counts, "key").withColumn("blocks", F.ceil(F.col("total") / block).cast("int"))
    alone = rows.select("key", F.lit(0).alias("part"), deal("blocks", 0).alias("x"), F.lit(0).alias("y"), "fingerprint", "node")
    links, _ = write_out(_compared(alone, compare, limit, read), "simhash-links")
    if counts.where(F.col("total") > block).isEmpty():
        return links
    joined = connected_components(links, "simhash-parts")
    large = rows.where("blocks > 1").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")).select("key", "fingerprint", "node", "weight", "component")
    large, _ = write_out(large, "simhash-large")
    mains = large.groupBy("key", "component").agg(F.sum("weight").alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("held"), F.sum("n").alias("all"))
    mains = mains.where("held < all").select("key", "main", F.ceil(F.col("held") / block).cast("int").alias("main_blocks"), F.ceil((F.col("all") - F.col("held")) / block).cast("int").alias("blocks"))
    met, each = large.join(mains, "key"), lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    inner, other = met.where("component = main"), met.where("component <> main")
    shape = lambda df, part, x, y: df.select("key", F.lit(part).alias("part"), x.alias("x"), "fingerprint", "node", "blocks", "main_blocks").withColumn("y", y).select("key", "part", "x", "y", "fingerprint", "node")
    between = shape(inner, 1, deal("main_blocks", 1), each("blocks")).unionByName(shape(other, 1, each("main_blocks"), deal("blocks", 2)))
    among = other.withColumn("mine", deal("blocks", 3)).withColumn("other", each("blocks")).select("key", F.lit(2).alias("part"), F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "fingerprint", "node")
    return links.unionByName(_compared(between.unionByName(among), compare, limit, read))


def ring_links(classes: DataFrame, distance: int = DISTANCE, block: int | None = None) -> DataFrame:
    """Links (a, b) between rows (fingerprint, node) of distinct fingerprints within ``distance`` bits, 3 at most."""
    return bucket_links(classes.select(F.explode(ring_keys()).alias("key"), "fingerprint", "node"), _ring_compare, distance, _longs, block)


def threshold(similarity: float, bits: int, deviations: float = KEYED) -> int:
    """Bits that texts of this Jaccard similarity differ in, and so many standard deviations more.

    Sets of one size and similarity s share 2 s / (1 + s) of their shingles; that is the cosine of their count vectors.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return min(bits, math.floor(bits * share + deviations * math.sqrt(bits * share * (1 - share))))


def key_plan(nodes: int, distance: int, bits: int) -> tuple[int, int]:
    """(sampled bits of a key, keys): a chance bucket holds BUCKET of the nodes, a pair at ``distance`` shares a key with FOUND."""
    width = max(8, math.ceil(math.log2(max(nodes, 1) / BUCKET)))
    return width, math.ceil(math.log(1 - FOUND) / math.log1p(-((1 - distance / bits) ** width)))


def lane_links(classes: DataFrame, similarity: float, bits: int = WIDE, block: int | None = None) -> DataFrame:
    """Links (a, b) between rows (fingerprint binary, node) as near as those of sets with this similarity (``CHECKED``)."""
    width, count = key_plan(classes.count(), threshold(similarity, bits), bits)
    drawn = np.stack([np.random.default_rng([17, k]).permutation(bits)[:width] for k in range(count)])

    def run(batches):
        weight = np.int64(1) << np.arange(width, dtype=np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 8192):
                part = batch.slice(first, 8192)
                flags = np.unpackbits(np.frombuffer(b"".join(part.column(0).to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1), axis=1, bitorder="little")
                for k in range(count):
                    key = flags[:, drawn[k]].astype(np.int64) @ weight + (k << 40)
                    yield pa.RecordBatch.from_arrays([pa.array(key), *part.columns], names=["key", "fingerprint", "node"])

    keyed = classes.select("fingerprint", "node").mapInArrow(run, "key bigint, fingerprint binary, node bigint")
    return bucket_links(keyed, _lane_compare, threshold(similarity, bits, CHECKED), _lanes, block)


def set_links(docs: DataFrame, classes: DataFrame, candidates: DataFrame, id_col: str, text_col: str, similarity: float, shingle: int, block: int | None = None) -> DataFrame:
    """Links (a, b) between rows (digest, rep, node) of ``classes`` whose sets of shingles have this similarity.

    Only nodes in one component of ``candidates`` (node, component) meet. One text of each is read again; their blocks
    are bounded by shingles as well as by rows.
    """
    wanted, _ = write_out(classes.join(candidates, "node").select("digest", "node", F.col("component").alias("key"), "rep"), "simhash-wanted")
    ids = wanted.select(F.col("rep").alias(id_col)).distinct()
    texts = docs.select(id_col, text_col).join(F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids, id_col, "left_semi")
    sets = shingle_sets(texts, id_col, text_col, shingle).dropDuplicates(["digest"])
    weight = (F.length("shingles") / (8 * ROW_SHINGLES)).cast("long") + 1
    keyed, _ = write_out(sets.join(wanted, "digest").select("key", F.col("shingles").alias("fingerprint"), "node", weight.alias("weight")), "simhash-sets")
    return bucket_links(keyed, _set_compare, similarity, _sets, block)


def _numbered(marked: DataFrame, id_col: str, name: str, *others: str) -> DataFrame:
    """Rows (name, *others, rep, node): one for each value of ``name``, with its smallest id and a number."""
    classes = marked.groupBy(name, *others).agg(F.min(id_col).alias("rep"))
    return write_out(classes.withColumn("node", F.monotonically_increasing_id()), "simhash-classes")[0]  # numbers are fixed once written


def _named(marked: DataFrame, classes: DataFrame, links: DataFrame, name: str, id_col: str, carry: tuple[str, ...]) -> DataFrame:
    named = least_of_component(classes, connected_components(links, "simhash-components"), "rep", "component_id")
    return marked.join(named.select(name, "component_id"), name).select(id_col, "fingerprint", "component_id", *carry)


def _named_rows(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).withColumn(id_col, F.col(id_col).cast("long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id_col, fingerprint long, component_id, *carry): fingerprints link at ``distance`` or fewer differing bits.

    ``component_id`` is the smallest id reachable by links, the row's own included.

    * Nulls: rows with a null id are left out, as nothing could name them; a null text counts as empty.
    * Empty texts share fingerprint zero and link like any other. Very long texts are hashed whole.
    * Ties: a bit set in exactly half of the hashes is not set.
    * Repeated rows stay, a row for each. Rows of one id with different texts are judged each by its own text.
    * An empty table gives an empty result. Other columns than those of ``carry`` are not carried, so their names cannot clash.
    """
    if distance > DISTANCE:
        raise ValueError("the ring of eight segments serves distances up to 3")
    marked, _ = write_out(fingerprints(_named_rows(docs, id_col), id_col, text_col, SHINGLE, carry), "simhash")
    classes = _numbered(marked, id_col, "fingerprint")
    return _named(marked, classes, ring_links(classes, distance), "fingerprint", id_col, carry)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = WORDS, bits: int = WIDE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id_col, fingerprint binary, component_id, *carry): texts link whose sets of ``shingle``-word shingles have at
    least this Jaccard similarity, as far as their fingerprints make them candidates.

    No pair below the similarity links. Of those at the similarity itself, FOUND share a key and all but one or two in a
    thousand are near enough in full; nearer ones are missed less. Equal sets are one node. A text of fewer words is one shingle. Texts
    without words equal each other and nothing else. Nulls, very long texts, repeated rows, empty tables and clashing columns
    are as in ``near_duplicates``.
    """
    docs = _named_rows(docs, id_col)
    marked, _ = write_out(set_marks(docs, id_col, text_col, shingle, bits, carry), "simhash")
    classes = _numbered(marked, id_col, "digest", "fingerprint")
    candidates = connected_components(lane_links(classes, similarity, bits), "simhash-candidates")
    return _named(marked, classes, set_links(docs, classes, candidates, id_col, text_col, similarity, shingle), "digest", id_col, carry)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    small_batches(spark)
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
