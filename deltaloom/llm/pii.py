"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

Tokens are words. Only a token that holds a digit or an @ can be part of an entity; it is a variable of the field, all others are
known to be outside. Variables are tagged begin or inside of an email, ip, card or phone, or outside, by their shape, the words around
and the file. Neighbouring variables share a transition potential. Distant ones of one document that repeat each other, or look alike
(equal local parts of mail addresses, equal last digits however they are punctuated), share a skip potential, which links each with the
next such token, never all pairs. Messages pass along the chains exactly, forwards and backwards, then over the skip links, for a fixed
number of rounds; Viterbi decodes the chains with the last skip messages added, so labels of one entity agree across the document.

The field is trained on the driver by gradient ascent with the same messages, on a bounded sample of documents labelled by the
patterns and on generated documents that hold other spellings, look-alikes, and entities that recur without a word that names them.
"""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaloom.llm._shared import WordHasher, documents, fold_case, keyed_texts, small_batches, text_chunks, word_spans
from deltaloom.llm.secrets import _bucket, _logsum, sample_texts

#: The kinds in their order, and the patterns; those of addresses start at an @ and at a digit after none.
KINDS = ("email", "ip", "card", "phone")
LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Bounds of the training sample: documents with the smallest crc32 of the id, and whole ones until so many characters are reached.
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 8_000_000
#: Rounds of messages over the skip links.
ROUNDS = 4
LEAST_SEEN = 3
_WORDS = 1 << 16
_SHAPES = 6 * 6 * 2 * 2 * 5 * 3 * 2 * 3
_FILES = 4 * 4
_LABELS = 1 + 2 * len(KINDS)  # 0 outside, then begin and inside of each kind
_FORBIDDEN = -1e4
_DIGIT, _CANDIDATE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_DIGIT[48:58] = _CANDIDATE[48:58] = _CANDIDATE[64] = True
_STRIP = b"\"'`,;:.!?()[]{}<>#$%&|=*"
_TRIM = np.zeros(256, dtype=bool)
_TRIM[list(_STRIP)] = True
_NOT_DIGITS = bytes(x for x in range(256) if not 48 <= x < 58)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (kind number, start, end) of the patterns, in code points, by kind and start. Time grows with the text's length."""
    spans, last, before = [], 0, 0
    at = text.find("@")
    while at >= 0:
        lead = text[max(last, before) : at]
        size = len(lead) - len(lead.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if size else None
        if found:
            spans.append((0, at - size, found.end()))
            last = found.end()
        before = at + 1
        at = text.find("@", max(last, before))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                spans.append((3, m.start(), m.end()))
    return spans


def _described(token: bytes) -> tuple[int, bytes]:
    """(shape, signature) of a candidate; tokens of a document with one signature are linked, an empty one links nothing."""
    digits = token.translate(None, _NOT_DIGITS)
    bare = token.strip(_STRIP)
    letters, dots, at = sum(65 <= x & 0xDF <= 90 for x in token[:64]), bare.count(b"."), b"@" in token
    n, parts, valid = len(digits), bare.split(b":")[0].split(b"."), 0
    if 16 <= n <= 19 and not letters:
        valid = 1 + luhn(digits.decode())
    elif len(parts) == 4 and all(p.isdigit() for p in parts):
        valid = 1 + all(len(p) <= 3 and int(p) <= 255 for p in parts)
    lead = 1 if token[:1] == b"+" else 2 if token[:1] == b"(" else 0
    shape = int(np.searchsorted((4, 7, 10, 14, 20), len(bare), side="right"))
    for size, part in ((6, int(np.searchsorted((1, 4, 7, 10, 16), n, side="right"))), (2, letters > 0), (2, at), (5, min(dots, 4)), (3, lead), (2, b"-" in bare), (3, valid)):
        shape = shape * size + int(part)
    if at:
        local = bare.split(b"@")[0].lower()
        return shape, b"@" + local if len(local) >= 4 else b""
    return shape, digits[-7:] if n >= 4 else b""


class Candidates:
    """The tokens of some texts that can be part of an entity: features, chains and skip links."""

    def __init__(self):
        self.hasher = WordHasher()

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> dict:
        starts, ends, per_doc = word_spans(data, bounds)
        n, marks = len(starts), np.concatenate(([0], np.cumsum(_CANDIDATE[data], dtype=np.int64)))
        here = np.flatnonzero(marks[ends] > marks[starts])
        owners = np.repeat(np.arange(len(per_doc)), per_doc)
        owner = owners[here]
        folded = fold_case(data)
        around = {}
        for name, step in (("prev1", -1), ("prev2", -2), ("next", 1)):
            k = np.clip(here + step, 0, max(n - 1, 0))
            inside = (here + step >= 0) & (here + step < n) & (owners[k] == owner)
            code = inside & (marks[ends[k]] > marks[starts[k]])
            a, b = starts[k], ends[k].copy()
            for _ in range(2):
                b -= (b - a > 1) & _TRIM[data[b - 1]]
            words = (self.hasher(folded, a, b) >> np.uint64(64 - 16)).astype(np.int64)
            words[code], words[~inside] = _WORDS + 1, _WORDS
            around[name] = words
        told = [_described(data[a:b].tobytes()) for a, b in zip(starts[here].tolist(), ends[here].tolist())]
        shape = np.array([x for x, _ in told], dtype=np.int64)
        first = np.ones(len(here), dtype=bool)
        first[1:] = (np.diff(here) > 1) | (owner[1:] != owner[:-1])
        near = np.full(len(here) + 2, _SHAPES, dtype=np.int64)
        near[1:-1] = shape
        seen, links = {}, []
        for k, (doc, (_, signature)) in enumerate(zip(owner.tolist(), told)):
            if signature:
                if (doc, signature) in seen:
                    links.append((seen[doc, signature], k))
                seen[doc, signature] = k
        total = np.concatenate(([0], np.cumsum(_DIGIT[data], dtype=np.int64)))
        length = np.maximum(np.diff(bounds), 1)
        file = _bucket((total[bounds[1:]] - total[bounds[:-1]]) / length, (0.002, 0.01, 0.05)) * 4 + _bucket(length, (500, 4000, 40000))
        return around | {
            "starts": starts[here], "ends": ends[here], "owner": owner, "first": np.flatnonzero(first), "links": np.array(links, dtype=np.int64).reshape(-1, 2), "shape": shape, "file": file[owner],
            "shape1": np.where(first, _SHAPES, near[:-2]), "shape2": np.where(np.append(first[1:], True)[: len(here)], _SHAPES, near[2:]),
        }


def _chains(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Heads of the chains, longest first, and how many chains reach each step."""
    sizes = np.diff(np.append(first, n))
    order = np.argsort(-sizes, kind="stable")
    longest = sizes[order[0]] if len(sizes) else 0
    return first[order], np.searchsorted(-sizes[order], -np.arange(1, longest + 1), side="right")


def _norm(x: np.ndarray) -> np.ndarray:
    return x - _logsum(x, 1)[:, None]


class SkipChain:
    """Weights of the field, its messages and its decoder."""

    FAMILIES = (("shape", _SHAPES), ("shape1", _SHAPES + 1), ("shape2", _SHAPES + 1), ("prev1", _WORDS + 2), ("prev2", _WORDS + 2), ("next", _WORDS + 2), ("file", _FILES))

    def __init__(self):
        self.weights = {name: np.zeros((size, _LABELS), dtype=np.float32) for name, size in self.FAMILIES}
        self.move, self.skip = np.zeros((_LABELS, _LABELS)), np.zeros((_LABELS, _LABELS))
        self.banned = np.zeros((_LABELS, _LABELS), dtype=bool)  # an inside follows only its own kind
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            self.banned[:, inside] = True
            self.banned[[inside - 1, inside], inside] = False
        self.start = np.where(self.banned[0], _FORBIDDEN, 0.0)
        self.move[self.banned] = _FORBIDDEN

    def emissions(self, found: dict) -> np.ndarray:
        return sum((self.weights[name][found[name]] for name, _ in self.FAMILIES), np.zeros((len(found["owner"]), _LABELS)))

    def chain(self, e: np.ndarray, heads: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward messages of all chains together."""
        forward, backward = np.empty_like(e), np.zeros_like(e)
        forward[heads] = e[heads] + self.start
        for t in range(1, len(reach)):
            at = heads[: reach[t]] + t
            forward[at] = e[at] + _logsum(forward[at - 1][:, :, None] + self.move[None], 1)
        for t in range(len(reach) - 1, 0, -1):
            at = heads[: reach[t]] + t
            backward[at - 1] = _logsum(self.move[None] + (e[at] + backward[at])[:, None, :], 2)
        return forward, backward

    def messages(self, e: np.ndarray, found: dict, rounds: int = ROUNDS):
        """(emissions with the skip messages added, forward, backward, messages to the second and to the first end of each link)."""
        heads, reach = _chains(found["first"], len(e))
        i, j = found["links"].T
        ahead, back, whole = np.zeros((len(i), _LABELS)), np.zeros((len(i), _LABELS)), e
        forward, backward = self.chain(e, heads, reach)
        for _ in range(rounds if len(i) else 0):
            belief = _norm(forward + backward)
            ahead, back = _norm(_logsum((belief[i] - back)[:, :, None] + self.skip[None], 1)), _norm(_logsum((belief[j] - ahead)[:, None, :] + self.skip[None], 2))
            whole = e.copy()
            np.add.at(whole, j, ahead)
            np.add.at(whole, i, back)
            forward, backward = self.chain(whole, heads, reach)
        return whole, forward, backward, ahead, back

    def fit(self, found: dict, labels: np.ndarray, epochs: int = 40, rate: float = 0.3) -> None:
        """Adagrad on the likelihood as the messages estimate it."""
        n = len(labels)
        if not n:
            return
        rare = {name: np.bincount(found[name], minlength=len(w)) < LEAST_SEEN for name, w in self.weights.items()}
        squares = {name: np.full_like(w, 1e-6) for name, w in self.weights.items()}
        move_squares, skip_squares = np.full(self.move.shape, 1e-6), np.full(self.skip.shape, 1e-6)
        inner = np.ones(n, dtype=bool)
        inner[found["first"]] = False
        steps, (i, j) = np.flatnonzero(inner), found["links"].T
        seen, agreed, truth = np.zeros_like(self.move), np.zeros_like(self.skip), np.eye(_LABELS)[labels]
        np.add.at(seen, (labels[steps - 1], labels[steps]), 1)
        np.add.at(agreed, (labels[i], labels[j]), 1)
        for _ in range(epochs):
            e = self.emissions(found)
            whole, forward, backward, ahead, back = self.messages(e, found, 2)
            belief = _norm(forward + backward)
            wrong = truth - np.exp(belief)
            for name, w in self.weights.items():
                slope = np.stack([np.bincount(found[name], weights=wrong[:, k], minlength=len(w)) for k in range(_LABELS)], axis=1) - 0.02 * w
                slope[rare[name]] = 0
                squares[name] += slope**2
                w += (rate * slope / np.sqrt(squares[name])).astype(np.float32)
            if len(steps):
                pair = forward[steps - 1][:, :, None] + self.move[None] + (whole[steps] + backward[steps])[:, None, :]
                moved = seen - np.exp(pair - _logsum(pair.reshape(len(steps), -1), 1)[:, None, None]).sum(0)
                move_squares += moved**2
                self.move += rate * moved / np.sqrt(move_squares)
                self.move[self.banned] = _FORBIDDEN
            if len(i):
                pair = (belief[i] - back)[:, :, None] + self.skip[None] + (belief[j] - ahead)[:, None, :]
                moved = agreed - np.exp(pair - _logsum(pair.reshape(len(i), -1), 1)[:, None, None]).sum(0) - 0.02 * self.skip
                skip_squares += moved**2
                self.skip += rate * moved / np.sqrt(skip_squares)

    def decode(self, found: dict) -> np.ndarray:
        """Best labels of the chains with the skip messages added. Of equal paths the one with smaller labels from its end backwards."""
        n = len(found["owner"])
        tags = np.zeros(n, dtype=np.int64)
        if not n:
            return tags
        e = self.messages(self.emissions(found), found)[0]
        heads, reach = _chains(found["first"], n)
        score, back = np.empty((n, _LABELS)), np.zeros((n, _LABELS), dtype=np.int64)
        score[heads] = e[heads] + self.start
        for t in range(1, len(reach)):
            at = heads[: reach[t]] + t
            ways = score[at - 1][:, :, None] + self.move[None]
            back[at], score[at] = ways.argmax(1), e[at] + ways.max(1)
        sizes = np.diff(np.append(found["first"], n))
        ends = found["first"] + sizes - 1
        tags[ends] = score[ends].argmax(1)
        for t in range(len(reach) - 1, 0, -1):
            at = heads[: reach[t]] + t
            tags[at - 1] = back[at, tags[at]]
        return tags


def generated_documents(count: int = 900, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Documents (text, spans): other spellings and look-alikes, named by a word the first time and bare when they recur."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choices(string.ascii_lowercase, k=pick.randint(2, 9)))
    digits = lambda k: "".join(pick.choices(string.digits, k=k))
    three = lambda: str(pick.randint(200, 999))
    out = []
    for n in range(count):
        kind = n % 5
        a, b, c = three(), three(), digits(4)
        spellings = pick.choice(([f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}"], [f"{a}{b}{c}", f"{a}-{b}-{c}"], [f"({a}) {b}-{c}"] * 2))
        if kind == 0:
            label, leads, forms = 3, ("phone", "tel:", "call", "mobile:", "telephone", "fax", "Phone:"), spellings
        elif kind == 1:
            name = f"{word()}.{digits(2)}"
            label, leads, forms = 0, ("email", "mail", "e-mail:", "write", "Email:", "contact"), [f"{name}@{word()}", f"<{name}@{word()}>"]
        elif kind == 2:
            number = digits(16)
            while luhn(number):
                number = digits(16)
            four = "-".join(number[k : k + 4] for k in range(0, 16, 4))
            label, leads, forms = 2, ("card", "visa", "Card:", "mastercard"), [four, number, four.replace("-", ".")]
        elif kind == 3:  # the same shapes under other names
            label, leads = None, ("order", "ref", "part", "invoice", "id", "ticket", "isbn", "serial")
            forms = pick.choice((spellings, [digits(16)], [digits(10), digits(12)], ["-".join(digits(4) for _ in range(4))]))
        else:
            label, leads = None, ("version", "on", "of", "page", "about", "")
            forms = [pick.choice((f"{pick.randint(1, 9)}.{pick.randint(0, 20)}.{pick.randint(0, 9)}", f"20{digits(2)}-0{pick.randint(1, 9)}-1{digits(1)}", f"@{word()}", digits(pick.randint(1, 6)), f"{word()}{digits(2)}", f"{digits(2)}:{digits(2)}", f"{pick.randint(300, 999)}.{digits(3)}.{digits(3)}.{digits(3)}", f"{word()}_{digits(4)}", f"${digits(3)}.{digits(2)}", digits(16), digits(20)))]
        text, spans = "", []
        for k in range(pick.randint(1, 4)):
            lead = pick.choice(leads) + " " if k == 0 or pick.random() < 0.3 else ""
            text += " ".join(word() for _ in range(pick.randint(0, 7))) + " " + lead
            value = forms[0] if k == 0 else pick.choice(forms)
            if label is not None:
                spans.append((label, len(text), len(text) + len(value)))
            text += value + pick.choice((" ", ", ", ".\n", " ")) + " ".join(word() for _ in range(pick.randint(1, 6))) + pick.choice((" ", "\n"))
        out.append((text, spans))
    return out


def train(texts: list[str]) -> SkipChain:
    """Fit the field on whole texts labelled by the patterns, and on the generated documents."""
    marked = [(text, base_spans(text)) for text in texts] + generated_documents()
    raw = [text.encode() for text, _ in marked]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    found = Candidates()(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds)
    labels = np.zeros(len(found["owner"]), dtype=np.int64)
    for k, (text, spans) in enumerate(marked):
        for kind, a, b in sorted(spans, reverse=True):  # where kinds overlap the first listed is taken
            a, b = (int(bounds[k]) + len(text[:x].encode()) for x in (a, b))
            hit = np.arange(np.searchsorted(found["ends"], a, side="right"), np.searchsorted(found["starts"], b))
            labels[hit] = 2 + 2 * kind
            labels[hit[:1]] = 1 + 2 * kind
    head = np.append(True, np.diff(found["owner"]) != 0)[: len(labels)]
    head[found["first"]] = True
    alone = (labels > 0) & (labels % 2 == 0) & (head | (np.roll(labels, 1) != labels) & (np.roll(labels, 1) != labels - 1))
    labels[alone] -= 1  # an inside that follows nothing of its kind begins
    field = SkipChain()
    field.fit(found, labels)
    return field


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: SkipChain | None = None, carry: bool = False) -> DataFrame:
    """Personal data of every whole text.

    Returns id_col, n_email, n_ip, n_card, n_phone (long, of the patterns), n_added (long), base_spans and spans (string:
    kind:start:end by kind, then start; code points, end exclusive). ``spans`` holds every base span and those of the field that touch
    none. With ``carry`` the first column is not the id but ``row``, a struct of the whole input row. Without ``field`` one is trained on a
    sample of ``docs`` (SAMPLE_DOCS documents and SAMPLE_CHARS characters at most).

    * Nulls and empty texts have no spans; a null id stays. Very long texts are scanned whole, and the field's links reach across them.
    * Ties: of equally good taggings that with the smaller labels (outside first) from the end of each chain.
    * Repeated rows: a row for each input row. An empty table gives an empty result. A document's spans depend on its text and the field only.
    * Other columns are not carried but in ``row``, so their names cannot clash.
    """
    field = field or train(sample_texts(docs, id_col, text_col, SAMPLE_DOCS, SAMPLE_CHARS))
    source, head = keyed_texts(docs, id_col, text_col, carry)
    key = source.columns[0]
    names = [*(f"n_{k}" for k in KINDS), "n_added", "base_spans", "spans"]

    def run(batches):
        candidates = Candidates()
        for batch in batches:
            rows = []
            for first, last, data, bounds in text_chunks(batch.column(1)):
                texts = [x or "" for x in batch.column(1).slice(first, last - first).to_pylist()]
                found = candidates(data, bounds)
                tags = field.decode(found)
                extra: dict = {}
                for token in np.flatnonzero(tags % 2 == 1).tolist():
                    stop = token + 1
                    while stop < len(tags) and tags[stop] == tags[token] + 1 and found["owner"][stop] == found["owner"][token]:
                        stop += 1
                    a, b = int(found["starts"][token]), int(found["ends"][stop - 1])
                    while a < b and _TRIM[data[a]] and data[a] != 40:  # a phone number may begin with a bracket
                        a += 1
                    while a < b and _TRIM[data[b - 1]]:
                        b -= 1
                    if a < b:
                        extra.setdefault(int(found["owner"][token]), []).append((int(tags[token] - 1) // 2, a, b))
                for k, text in enumerate(texts):
                    base = base_spans(text)
                    spans = base
                    if k in extra:
                        lead = np.concatenate(([0], np.cumsum((data[bounds[k] : bounds[k + 1]] & 0xC0) != 0x80)))
                        at = [(kind, int(lead[a - bounds[k]]), int(lead[b - bounds[k]])) for kind, a, b in extra[k]]
                        spans = sorted(base + [x for x in at if not _touches(x, base)])
                    counts = [sum(x[0] == n for x in base) for n in range(len(KINDS))]
                    rows.append((*counts, len(spans) - len(base), _joined(base), _joined(spans)))
            columns = [list(c) for c in zip(*rows)] or [[]] * 7
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.string()) for c in columns[5:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, *names])

    schema = f"{head}, {', '.join(f'{n} bigint' for n in names[:5])}, base_spans string, spans string"
    return source.mapInArrow(run, schema)


def _touches(span: tuple, base: list) -> bool:
    return any(a < span[2] and span[1] < b for _, a, b in base)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: SkipChain | None = None) -> DataFrame:
    """The input with every found span of its texts replaced by its kind in brackets (spans that overlap: once, by the first)."""
    found = scan(docs, id_col, text_col, field, carry=True)
    spans = F.expr("array_sort(transform(filter(split(spans, ','), s -> s <> ''), s -> struct(cast(split(s, ':')[1] as int) as a, cast(split(s, ':')[2] as int) as b, split(s, ':')[0] as kind)))")
    text = F.expr(
        f"""aggregate(spans, struct('' as done, 0 as at),
            (x, s) -> if(s.b <= x.at, x, struct(concat(x.done, if(s.a >= x.at, concat(substring(row.`{text_col}`, x.at + 1, s.a - x.at), '[', upper(s.kind), ']'), '')) as done, s.b as at)),
            x -> concat(x.done, substring(row.`{text_col}`, x.at + 1)))"""
    )
    clean = F.when(F.size("spans") > 0, text).otherwise(F.col(f"row.`{text_col}`"))
    table = found.select("row", spans.alias("spans")).withColumn("clean", clean)
    return table.select(*[F.col("clean").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, with the digest of the base spans."""
    small_batches(spark)
    found = scan(documents(spark, sf_dir))
    counts = [f"n_{k}" for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_added")
