"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Tokens are words; a sequence is a line. Each token is tagged outside, begin or inside by its shape, the hashed
words around it and features of the whole file; Viterbi decodes the tags. The field is trained on the driver by
gradient ascent of the conditional log-likelihood, on a bounded sample of documents labelled by the patterns
and on generated lines that hold other kinds of credentials and look-alikes (mail addresses, numbers, versions).
"""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaloom.llm._shared import SpanHasher, documents, fold_case, give_back, keyed_texts, small_batches, text_chunks, word_spans

#: The patterns, in the order in which spans of equal start are listed.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Bounds of the training sample: so many documents at most, those with the smallest crc32 of the id, and whole documents
#: until so many characters are reached.
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 16_000_000
#: Features met less often in training carry no weight.
LEAST_SEEN = 5
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = 1 << 13
_SHAPES = 6 * 4 * 3 * 3 * 8
_FILES = 4 * 4
O, B, I = range(3)
_FORBIDDEN = -1e4


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """Spans (start, kind number, end, start of the value) of the patterns, in code points."""
    spans = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        spans += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end(), m.start()) for m in _LONG_HEX.finditer(text)]
    return sorted(spans)


def _bucket(x: np.ndarray, edges: tuple) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, side="right")


class Features:
    """Feature numbers of all tokens of some texts: a shape each, hashed words, and a file class per text."""

    def __init__(self):
        self.hasher = SpanHasher()
        code = np.arange(256)
        self.digit = ((code >= 48) & (code < 58)).astype(np.int32)
        self.upper = ((code >= 65) & (code < 91)).astype(np.int32)
        self.lower = ((code >= 97) & (code < 123)).astype(np.int32)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> dict:
        starts, ends, per_doc = word_spans(data, bounds)
        n = len(starts)
        total = lambda flags: np.concatenate(([0], np.cumsum(flags, dtype=np.int32)))
        digits, uppers, lowers = (total(t[data]) for t in (self.digit, self.upper, self.lower))
        switch = np.zeros(len(data), dtype=np.int32)
        if len(data):
            is_digit, is_letter = self.digit[data], self.upper[data] | self.lower[data]
            switch[1:] = (is_digit[1:] & is_letter[:-1]) | (is_letter[1:] & is_digit[:-1])
        switches = total(switch)
        size = ends - starts
        of = lambda sums: (sums[ends] - sums[starts])
        d, u, w, s = of(digits), of(uppers), of(lowers), of(switches)
        marks = size - d - u - w
        shape = _bucket(size, (4, 8, 16, 24, 40))
        shape = shape * 4 + np.where(d == 0, 0, _bucket(d / np.maximum(size, 1), (0.3, 0.75)) + 1)
        shape = shape * 3 + np.where(u == 0, 0, np.where(w == 0, 2, 1))
        shape = shape * 3 + _bucket(s, (1, 4))
        has = lambda c: of(total((data == ord(c)).astype(np.int32))) > 0
        shape = shape * 8 + has("@") * 4 + (marks > 2) * 2 + (has("=") | has(":"))
        words = (self.hasher(fold_case(data), starts, ends) >> np.uint64(64 - 13)).astype(np.int64) if n else np.zeros(0, np.int64)
        words[(d > 0) | (size > 24)] = _WORDS + 1  # what looks like a code is told by its shape alone
        around = np.full(n + 3, _WORDS, dtype=np.int64)
        around[2 : n + 2] = words
        owner = np.repeat(np.arange(len(per_doc)), per_doc)
        lines = total(data == 10)
        line = lines[starts] if n else np.zeros(0, np.int32)
        first = np.ones(n, dtype=bool)
        if n:
            first[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
        position = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        last = np.append(first[1:], True)[:n]
        prev1, prev2, following = around[1 : n + 1].copy(), around[:n].copy(), around[3:].copy()
        prev1[position < 1], prev2[position < 2], following[last] = _WORDS, _WORDS, _WORDS
        length = np.maximum(np.diff(bounds), 1)
        share = (digits[bounds[1:]] - digits[bounds[:-1]]) / length
        file = _bucket(share, (0.002, 0.01, 0.05)) * 4 + _bucket(length, (500, 4000, 40000))
        return {"starts": starts, "ends": ends, "owner": owner, "first": np.flatnonzero(first), "shape": shape, "word": words, "prev1": prev1, "prev2": prev2, "next": following, "file": file[owner]}


class Field:
    """Weights of the conditional random field and its decoder."""

    FAMILIES = (("shape", _SHAPES), ("word", _WORDS + 2), ("prev1", _WORDS + 2), ("prev2", _WORDS + 2), ("next", _WORDS + 2), ("file", _FILES))

    def __init__(self):
        self.weights = {name: np.zeros((size, 3), dtype=np.float32) for name, size in self.FAMILIES}
        self.move = np.zeros((3, 3))
        self.move[O, I] = _FORBIDDEN
        self.start = np.array([0.0, 0.0, _FORBIDDEN])

    def emissions(self, features: dict) -> np.ndarray:
        return sum(self.weights[name][features[name]] for name, _ in self.FAMILIES)

    @staticmethod
    def rounds(first: np.ndarray, n: int):
        """Sequences by length, longest first: (token numbers of step t, how many sequences reach it) for each t."""
        lengths = np.diff(np.append(first, n))
        order = np.argsort(-lengths, kind="stable")
        heads, sizes = first[order], lengths[order]
        reach = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        return heads, reach

    def fit(self, features: dict, labels: np.ndarray, epochs: int = 30, rate: float = 0.3) -> None:
        """Adagrad on the conditional log-likelihood of all sequences together, by forward and backward passes."""
        n = len(labels)
        if not n:
            return
        heads, reach = self.rounds(features["first"], n)
        rare = {name: np.bincount(features[name], minlength=len(w)) < LEAST_SEEN for name, w in self.weights.items()}
        squares = {name: np.full_like(w, 1e-6) for name, w in self.weights.items()}
        move_squares, truth = np.full((3, 3), 1e-6), np.eye(3)[labels]
        inner = np.ones(n, dtype=bool)
        inner[features["first"]] = False
        steps = np.flatnonzero(inner)
        seen = np.zeros((3, 3))
        np.add.at(seen, (labels[steps - 1], labels[steps]), 1)
        weight = np.where(labels == O, 1.0, 8.0)[:, None]  # begin and inside are rare
        for _ in range(epochs):
            e = self.emissions(features).astype(np.float64)
            forward, backward = np.empty((n, 3)), np.zeros((n, 3))
            forward[heads] = e[heads] + self.start
            for t in range(1, len(reach)):
                at = heads[: reach[t]] + t
                forward[at] = e[at] + _logsum(forward[at - 1][:, :, None] + self.move[None], 1)
            for t in range(len(reach) - 1, 0, -1):
                at = heads[: reach[t]] + t
                backward[at - 1] = _logsum(self.move[None] + (e[at] + backward[at])[:, None, :], 2)
            total = forward + backward
            norm = _logsum(total, 1)
            wrong = (truth - np.exp(total - norm[:, None])) * weight
            pair = forward[steps - 1][:, :, None] + self.move[None] + (e[steps] + backward[steps])[:, None, :]
            moved = seen - np.exp(pair - norm[steps][:, None, None]).sum(0)
            for name, w in self.weights.items():
                slope = np.zeros(w.shape)
                for k in range(3):
                    slope[:, k] = np.bincount(features[name], weights=wrong[:, k], minlength=len(w))
                slope -= 0.02 * w
                slope[rare[name]] = 0
                squares[name] += slope**2
                w += (rate * slope / np.sqrt(squares[name])).astype(np.float32)
            move_squares += moved**2
            self.move += rate * moved / np.sqrt(move_squares)
            self.move[O, I] = _FORBIDDEN

    def decode(self, features: dict) -> np.ndarray:
        """Best tags by Viterbi. Lines in which no token can pay for leaving O are all O, and are not stepped through."""
        n = len(features["owner"])
        tags = np.zeros(n, dtype=np.int8)
        if not n:
            return tags
        e = self.emissions(features).astype(np.float64)
        gain = max(0.0, float(np.where(self.move > _FORBIDDEN / 2, self.move, 0).max() - self.move[O, O]))
        hope = e[:, 1:].max(1) - e[:, O] + 2 * gain > 0
        line = np.zeros(n, dtype=np.int64)
        line[features["first"]] = 1
        line = np.cumsum(line) - 1
        live = np.unique(line[hope])
        if not len(live):
            return tags
        bounds = np.append(features["first"], n)
        lengths = bounds[live + 1] - bounds[live]
        order = np.argsort(-lengths, kind="stable")
        heads, sizes = bounds[live][order], lengths[order]
        reach = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        score, back = np.empty((n, 3)), np.zeros((n, 3), dtype=np.int8)
        score[heads] = e[heads] + self.start
        for t in range(1, len(reach)):
            at = heads[: reach[t]] + t
            ways = score[at - 1][:, :, None] + self.move[None]
            back[at] = ways.argmax(1)
            score[at] = e[at] + ways.max(1)
        ends = heads + sizes - 1
        tags[ends] = score[ends].argmax(1)
        for t in range(len(reach) - 1, 0, -1):
            at = heads[: reach[t]] + t
            tags[at - 1] = back[at, tags[at]]
        return tags


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def generated_lines(count: int = 1500, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines (text, spans of credentials) of kinds that the patterns do not name, and of look-alikes without any."""
    pick = random.Random(seed)
    mixed, word = string.ascii_letters + string.digits, lambda: "".join(pick.choices(string.ascii_lowercase, k=pick.randint(2, 9)))
    digits = lambda k: "".join(pick.choices(string.digits, k=k))
    secret = lambda k: "".join(pick.choices(mixed, k=k - 2)) + pick.choice(string.digits) + pick.choice(string.ascii_letters)
    lines = []
    for i in range(count):
        before, after = (" ".join(word() for _ in range(pick.randint(0, 8))) for _ in range(2))
        if i % 2:
            lead = pick.choice(("bearer ", "Authorization: Bearer ", "pwd = ", "pwd: ", "credential ", "private_key = ", "access key ", "auth ", "key: ", "passphrase "))
            value = pick.choice((secret(pick.randint(20, 44)), f"ghp_{secret(36)}", f"sk-{secret(40)}", f"xoxb-{digits(11)}-{secret(24)}", secret(32).upper()))
        else:
            lead = ""
            value = pick.choice((f"{word()}@{word()}.example.com", digits(16), f"+1 ({digits(3)}) 555-{digits(4)}", ".".join(str(pick.randint(1, 255)) for _ in range(4)), f"version {digits(1)}.{digits(1)}.", f"https://{word()}.example.org/{word()}/{digits(4)}", "".join(word() for _ in range(pick.randint(3, 6))), f"{word().upper()}{word().upper()}!!", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"{word()}###", "".join(word() for _ in range(3)).capitalize() + ",", f"{word()}_{word()}_{digits(2)}"))
        text = f"{before} {lead}{value} {after}".strip()
        at = text.find(value)
        lines.append((text, [(at, at + len(value))] if i % 2 else []))
    return lines


def train(texts: list[str]) -> Field:
    """Fit the field on texts labelled by the patterns, and on the generated lines."""
    whole, marks = [], []
    for text in texts:
        spans = [(value, end) for _, _, end, value in base_spans(text)]
        at = 0
        for line in text.split("\n"):  # keep lines with a span or a digit, and an eighth of the others
            own = [(max(a - at, 0), b - at) for a, b in spans if a < at + len(line) and b > at]
            if own or len(line) % 8 == 0 or any(c.isdigit() for c in line):
                whole.append(line)
                marks.append(own)
            at += len(line) + 1
    for text, own in generated_lines():
        whole.append(text)
        marks.append(own)
    raw = [line.encode() for line in whole]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    features = Features()(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds)
    labels = np.zeros(len(features["owner"]), dtype=np.int64)
    for k in (k for k, own in enumerate(marks) if own):
        for a, b in marks[k]:
            a, b = (bounds[k] + len(whole[k][:x].encode()) for x in (a, b))
            hit = np.flatnonzero((features["starts"] < b) & (features["ends"] > a))
            labels[hit], labels[hit[:1]] = I, B
    field = Field()
    field.fit(features, labels)
    del features, labels, raw, whole, marks
    give_back()
    return field


def sample_texts(docs: DataFrame, id_col: str, text_col: str, bound: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[str]:
    """Whole texts of at most ``bound`` documents, those with the smallest crc32 of the id (ties by id), until ``chars`` are reached."""
    order = F.crc32(F.col(id_col).cast("string").cast("binary"))
    texts = docs.where(F.col(text_col).isNotNull())
    few = texts.select(order.alias("o"), F.col(id_col).alias("i"), F.length(F.col(text_col).cast("string")).alias("n")).orderBy("o", "i", "n").limit(bound).collect()
    held = np.cumsum([row.n for row in few])
    keep = max(1, int(np.searchsorted(held, chars, side="right"))) if few else 0
    if not keep:
        return []
    rows = texts.where(order <= few[keep - 1].o).select(order.alias("o"), F.col(id_col).alias("i"), F.length(F.col(text_col).cast("string")).alias("n"), F.col(text_col).cast("string").alias("t"))
    return [row.t for row in rows.orderBy("o", "i", "n").limit(keep).select("t").collect()]


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None, carry: bool = False) -> DataFrame:
    """Secrets of every whole text.

    Returns id_col, n_assign, n_access, n_hex, n_crf (long), base_spans and spans (string: kind:start:end by start, then
    kind; code points, end exclusive). ``spans`` holds every base span and those of the field that touch none. With
    ``carry`` the first column is not the id but ``row``, a struct of the whole input row. Without ``field`` one is
    trained on a sample of ``docs`` (SAMPLE_DOCS documents and SAMPLE_CHARS characters at most).

    * Nulls and empty texts have no spans; a null id stays. Very long texts and lines are scanned whole.
    * Ties: of equally good taggings Viterbi takes the one with more tokens outside; spans of one start are listed by kind.
    * Repeated rows: a row for each input row. An empty table gives an empty result.
    * Other columns are not carried but in ``row``, so their names cannot clash.
    """
    field = field or train(sample_texts(docs, id_col, text_col))
    source, head = keyed_texts(docs, id_col, text_col, carry)
    key = source.columns[0]
    trim = np.zeros(256, dtype=bool)
    trim[[ord(c) for c in "\"'`,;:.!?()[]{}<>#$%&|="]] = True

    def run(batches):
        features = Features()
        for batch in batches:
            rows = []
            for first, last, data, bounds in text_chunks(batch.column(1)):
                texts = [x or "" for x in batch.column(1).slice(first, last - first).to_pylist()]
                found = features(data, bounds)
                tags = field.decode(found)
                begin = np.flatnonzero(tags == B)
                extra: dict = {}
                for token in begin.tolist():
                    stop = token + 1
                    while stop < len(tags) and tags[stop] == I and found["owner"][stop] == found["owner"][token]:
                        stop += 1
                    a, b = int(found["starts"][token]), int(found["ends"][stop - 1])
                    while a < b and trim[data[a]]:
                        a += 1
                    while a < b and trim[data[b - 1]]:
                        b -= 1
                    if a < b:
                        extra.setdefault(int(found["owner"][token]), []).append((a, b))
                for k, text in enumerate(texts):
                    base = [(a, n, b) for a, n, b, _ in base_spans(text)]
                    spans = base
                    if k in extra:
                        lead = np.concatenate(([0], np.cumsum((data[bounds[k] : bounds[k + 1]] & 0xC0) != 0x80)))
                        at = [(int(lead[a - bounds[k]]), 3, int(lead[b - bounds[k]])) for a, b in extra[k]]
                        spans = sorted(base + [x for x in at if not any(x[0] < b and a < x[2] for a, _, b in base)])
                    counts = [sum(x[1] == n for x in spans) for n in range(4)]
                    rows.append((*counts, _joined(base), _joined(spans)))
            columns = [list(c) for c in zip(*rows)] or [[]] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.string()) for c in columns[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, "n_assign", "n_access", "n_hex", "n_crf", "base_spans", "spans"])

    schema = f"{head}, n_assign bigint, n_access bigint, n_hex bigint, n_crf bigint, base_spans string, spans string"
    return source.mapInArrow(run, schema)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None, mask: str = "[SECRET]") -> DataFrame:
    """The input with every found span of its texts replaced by ``mask`` (spans that overlap: once)."""
    found = scan(docs, id_col, text_col, field, carry=True)
    spans = F.expr("transform(filter(split(spans, ','), s -> s <> ''), s -> struct(cast(split(s, ':')[1] as int) as a, cast(split(s, ':')[2] as int) as b))")
    text = F.expr(
        f"""aggregate(spans, struct('' as done, 0 as at),
            (x, s) -> if(s.b <= x.at, x, struct(concat(x.done, if(s.a >= x.at, concat(substring(row.`{text_col}`, x.at + 1, s.a - x.at), '{mask}'), '')) as done, s.b as at)),
            x -> concat(x.done, substring(row.`{text_col}`, x.at + 1)))"""
    )
    clean = F.when(F.size("spans") > 0, text).otherwise(F.col(f"row.`{text_col}`"))
    table = found.select("row", spans.alias("spans")).withColumn("clean", clean)
    return table.select(*[F.col("clean").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with the digest of the base spans."""
    small_batches(spark)
    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_crf")
