"""Operator 7: secrets by patterns and by a linear-chain conditional random field.

The patterns find assignments, access keys and runs of hex digits. The field tags tokens as the beginning, the inside or the outside of a secret. A token's score is a sum of
table entries: its shape, how it is set off, its word, the words and shapes beside it, and features of the whole file. Lines are its sequences. It is
trained by likelihood on windows of a bounded sample and decoded by Viterbi; what it finds beside the patterns' spans is added to them.

Training doesn't stop at what the patterns know: into lines of the sampled texts, made-up secrets that mostly no pattern matches are put behind cues or bare, and
ordinary things (words, numbers, dates, versions, paths, addresses) behind the same cues, tagged as outside. Windows with and without secrets are taken in equal numbers at most.

Decoding skips, exactly, tokens whose outside score leads by more than transitions could ever make up: any best path is outside there, so the stretches between are independent.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "crf")
#: Fixed patterns; letters of an assignment's name count in either case, and only ASCII ones.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
#: Bounds of training: documents sampled, windows taken with secrets and as many without, tokens of a window, windows of each sort taken from anywhere in a document, and secrets put into lines of it.
TRAIN_DOCS, TRAIN_WINDOWS, SPAN, EACH, STAGED = 3_000, 8_000, 15, 3, 8
#: What made-up secrets and ordinary things follow in training, and how made-up secrets begin.
CUES = ("", "", "", "key ", "key: ", "api key ", "credential = ", "token is ", "token ", "pwd=", "auth: ", "bearer ", "login with ", "secret ", "use ", "id: ")
PREFIXES = ("", "", "", "sk_", "pk-", "key-")
DIGITS, SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz"
EPOCHS, BATCH, RATE, DECAY = 8, 128, 0.3, 1e-5
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
WORDS = 1 << 12
#: Entries of the tables: shape, setting, word, word before, shape before, shape after, file.
SIZES = (3072, 16, WORDS, WORDS, 3072, 3072, 32)
MASK = "[SECRET]"


def _classes() -> np.ndarray:
    """For each byte: 0 apart, 1 digit, 2 capital, 3 small letter, 4 sign within tokens, 5 part of another character."""
    out = np.zeros(256, np.uint8)
    for members, k in ((b"0123456789", 1), (range(65, 91), 2), (range(97, 123), 3), (b"+/_-.", 4), (range(128, 256), 5)):
        out[list(members)] = k
    return out


_CLASS = _classes()
_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the patterns' matches, in order of start, then kind; in code points, ends exclusive."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


@dataclass
class Tokens:
    """Tokens of a run of texts: bytes [begin, end), the text each is in, whether it opens a line, and its table entries (7 x tokens)."""

    begins: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    opens: np.ndarray
    entries: np.ndarray


def tokens(texts: list[bytes]) -> Tokens:
    """Cuts texts into tokens and finds the entries that they look up."""
    data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)  # a line's end before, between and after texts
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    kind = _CLASS[data]
    inside = (kind > 0).astype(np.int8)
    edges = np.diff(inside)
    begins, ends = np.nonzero(edges == 1)[0] + 1, np.nonzero(edges == -1)[0] + 1
    n = len(begins)
    text = np.searchsorted(bounds, begins, side="right") - 1
    if not n:
        return Tokens(begins, ends, text, np.empty(0, bool), np.empty((7, 0), np.int32))
    length = ends - begins
    edges_at = np.ravel(np.column_stack([begins, ends]))[:-1] if ends[-1] == len(data) else np.ravel(np.column_stack([begins, ends]))
    each = lambda values: np.add.reduceat(values, edges_at)[::2]
    digits, capitals, small, signs, other = (each((kind == k).astype(np.int32)) for k in (1, 2, 3, 4, 5))
    share = lambda x, *cuts: np.searchsorted(np.array(cuts), x / length, side="left")
    hexes = each(_HEX[data].astype(np.int32)) == length
    size = np.searchsorted([3, 7, 11, 15, 19, 31, 47], length)
    shape = ((((size * 4 + share(digits, 1e-9, 0.25, 0.6)) * 3 + share(capitals, 1e-9, 0.25)) * 2 + (small > 0)) * 2 + (signs > 0)) * 2 + (other > 0)
    shape = (shape * 2 + hexes).astype(np.int32)
    lowered = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(np.append(0, begins), np.diff(np.concatenate([[0], begins, [len(data)]]))).astype(np.uint64)
    mixed = (lowered + np.uint64(1)) * ((place * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    word = (each(mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(52)).astype(np.int32) % WORDS
    # what sets a token off from the one before: an assignment's sign, a quote, the end of a line, and a quote after it
    def gap_only(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return total[begins] - total[np.append(0, ends[:-1])]

    opens = gap_only(data == 10) > 0
    quote = (data == 34) | (data == 39)
    setting = (gap_only((data == 61) | (data == 58)) > 0) * 8 + (quote[begins - 1]) * 4 + opens * 2 + quote[np.minimum(ends, len(data) - 1)]
    before = lambda x: np.where(opens, 0, np.append(0, x[:-1]))
    closes = np.append(opens[1:], True)
    after = np.where(closes, 0, np.append(shape[1:], 0))
    per_text = np.bincount(text, minlength=len(texts))
    assigned = np.bincount(text, weights=setting >= 8, minlength=len(texts)) > 0
    figures = np.bincount(text, weights=digits > 0, minlength=len(texts)) * 20 > per_text
    file = (np.minimum(np.log2(per_text + 1).astype(int) // 2, 7) * 4 + assigned * 2 + figures)[text]
    entries = np.stack([shape, setting, word, before(word), before(shape), after, file]).astype(np.int32)
    return Tokens(begins, ends, text, opens, entries)


@dataclass
class Field:
    """Tables (entries x 3 tags), transitions (tag x next tag), and scores of a line's first tag."""

    tables: list[np.ndarray]
    transitions: np.ndarray
    first: np.ndarray

    def emissions(self, entries: np.ndarray) -> np.ndarray:
        return sum(t[e] for t, e in zip(self.tables, entries))

    def decode(self, entries: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """The best tags of all lines, by Viterbi over stretches between tokens that can only be outside; all stretches step together."""
        e, t = self.emissions(entries), self.transitions
        n = len(e)
        tags = np.zeros(n, np.uint8)
        into = max(t.max(), self.first.max()) - min(t[:, OUTSIDE].min(), self.first[OUTSIDE])
        lead = into + max(t.max() - t[OUTSIDE].min(), 0)
        (free,) = np.nonzero(e[:, OUTSIDE] - e[:, 1:].max(1) <= lead)
        if not len(free):
            return tags
        new = opens[free] | (np.diff(free, prepend=-2) > 1)
        at = np.nonzero(new)[0]
        begin, size = free[at], np.diff(np.append(at, len(free)))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        end = begin + size
        score = np.where(opens[begin][:, None], self.first, t[OUTSIDE]) + e[begin]
        back = np.zeros((n, 3), np.uint8)
        active = len(begin)
        final = np.empty((len(begin), 3))
        for k in range(1, int(size[0]) + 1):
            done = int(np.searchsorted(-size, -k, side="right"))  # stretches of more than k - 1 tokens
            going = int(np.searchsorted(-size, -k, side="left"))
            final[going:done] = score[going:active][: done - going]
            active = going
            if not active:
                break
            paths = score[:active, :, None] + t
            best = paths.argmax(1)
            back[begin[:active] + k] = best
            score = np.take_along_axis(paths, best[:, None], 1)[:, 0] + e[begin[:active] + k]
        closed = (end < n) & ~opens[np.minimum(end, n - 1)]  # followed by an outside token of the same line
        tag = (final + np.where(closed[:, None], t[:, OUTSIDE], 0)).argmax(1).astype(np.uint8)
        for k in range(int(size[0])):
            rows = int(np.searchsorted(-size, -k, side="left"))
            place = end[:rows] - 1 - k
            tags[place] = tag[:rows]
            tag[:rows] = back[place, tag[:rows]]
        return tags


def fit(entries: np.ndarray, tags: np.ndarray, seed: int = 5) -> Field:
    """Trains on windows: entries (windows x 7 x tokens, -1 past the end) and tags (windows x tokens)."""
    rng = np.random.default_rng(seed)
    field = Field([np.zeros((s, 3)) for s in SIZES], np.zeros((3, 3)), np.zeros(3))
    params = [*field.tables, field.transitions, field.first]
    square = [np.full(p.shape, 1e-4) for p in params]
    rows = np.arange(len(tags))
    for _ in range(EPOCHS if len(tags) else 0):
        rng.shuffle(rows)
        for a in range(0, len(rows), BATCH):
            x, y = entries[rows[a : a + BATCH]], tags[rows[a : a + BATCH]]
            live = x[:, 0] >= 0
            x = np.maximum(x, 0)
            b, length = y.shape
            e = sum(t[x[:, k]] for k, t in enumerate(field.tables)) * live[..., None]
            t = field.transitions
            alpha, beta = np.zeros((length, b, 3)), np.zeros((length, b, 3))
            soft = lambda v, axis: np.log(np.exp(v - v.max(axis, keepdims=True)).sum(axis)) + v.max(axis)
            alpha[0] = field.first + e[:, 0]
            for k in range(1, length):
                step = soft(alpha[k - 1][:, :, None] + t, 1) + e[:, k]
                alpha[k] = np.where(live[:, k, None], step, alpha[k - 1])
            for k in range(length - 2, -1, -1):
                step = soft(t + (e[:, k + 1] + beta[k + 1])[:, None, :], 2)
                beta[k] = np.where(live[:, k + 1, None], step, 0)
            total = soft(alpha[-1], 1)
            node = np.exp(alpha + beta - total[:, None]).transpose(1, 0, 2) * live[..., None]
            true = np.eye(3)[y] * live[..., None]
            grad_e = (node - true) / b
            grads = []
            for k, table in enumerate(field.tables):
                g = np.zeros_like(table)
                np.add.at(g, x[:, k][live], grad_e[live])
                grads.append(g)
            g = np.zeros((3, 3))
            for k in range(1, length):
                on = live[:, k]
                pair = np.exp(alpha[k - 1][:, :, None] + t + (e[:, k] + beta[k])[:, None, :] - total[:, None, None])
                g += (pair[on].sum(0) - np.einsum("bi,bj->ij", true[on, k - 1], true[on, k])) / b
            grads += [g, grad_e[:, 0].sum(0)]
            for p, g, s in zip(params, grads, square):
                g = g + DECAY * p
                s += g * g
                p -= RATE * g / np.sqrt(s)
    return field


def made_up(rng: np.random.Generator) -> str:
    """A secret of 10 to 44 characters, with figures, from letters and figures of one case or both, at times with signs."""
    letters = [SMALL, SMALL.upper(), SMALL + SMALL.upper(), SMALL + SMALL.upper(), "ABCDEF"][rng.integers(5)]
    signs = "+/_-" if rng.random() < 0.2 else ""
    body = list(rng.choice(list(letters + DIGITS * int(rng.integers(1, 4)) + signs), rng.integers(10, 45)))
    for at in (0, -1):
        body[at] = rng.choice(list(letters + DIGITS))
    body[rng.integers(1, len(body) - 1)] = rng.choice(list(DIGITS))
    return PREFIXES[rng.integers(len(PREFIXES))] + "".join(body)


def ordinary(rng: np.random.Generator, words: list[str]) -> str:
    """Something that isn't secret, made of a text's words and small figures."""
    word = lambda: words[rng.integers(len(words))]
    n = lambda most: str(rng.integers(most))
    forms = (
        word, word, word, word, lambda: word().upper(), lambda: word().title(), lambda: f"{word()}-{word()}", lambda: f"{word()}_{word()}", lambda: word() + word().title(), lambda: word() + n(100),
        lambda: n(10 ** int(rng.integers(1, 13))), lambda: f"{n(20)}.{n(20)}.{n(9)}", lambda: f"20{rng.integers(10, 40)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", lambda: f"{rng.integers(10, 24)}:{rng.integers(10, 60)}",
        lambda: f"{word()}/{word()}.{word()}", lambda: f"{word()}.{n(100)}@mail{n(9)}.example.com", lambda: f"www.{word()}.com/{word()}/{n(1000)}", lambda: f"+{n(90)} ({n(900)}) {n(900)}-{n(9000)}",
    )
    return forms[rng.integers(len(forms))]()


def staged(text: str, rng: np.random.Generator) -> tuple[str, list[tuple[int, int]], list[int]]:
    """Lines with something put in: the lines, (begin, end) of the secrets put in, and where anything is put in; every other thing is a secret."""
    words = [w for w in text.split() if w.isalpha()]
    lines, spans, places, size = [], [], [], 0
    for k in range(2 * STAGED if words else 0):
        at = int(rng.integers(len(text) + 1))
        before, after = text[max(0, at - 60) : at].rpartition("\n")[2].rpartition(" ")[0], text[at : at + 60].partition("\n")[0].partition(" ")[2]
        quote = ("", "", '"', "'")[rng.integers(4)]
        head = (before + " " if before else "") + CUES[rng.integers(len(CUES))] + quote
        value = ordinary(rng, words) if k % 2 else made_up(rng)
        lines.append(head + value + quote + ("", "", ".", ",")[rng.integers(4)] + (" " + after if after else ""))
        places.append(size + len(head))
        if k % 2 == 0:
            spans.append((places[-1], places[-1] + len(value)))
        size += len(lines[-1]) + 1
    return "\n".join(lines), spans, places


def _places(raw: np.ndarray) -> np.ndarray:
    """Where each code point of UTF-8 bytes begins, and their end."""
    return np.append(np.nonzero((raw & 0xC0) != 0x80)[0], len(raw))


def _tagged(text: str, spans: list[tuple[int, int]]) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """The tokens of a text, their tags for secrets at the given code points, and where its code points begin."""
    raw = text.encode()
    toks, places = tokens([raw]), _places(np.frombuffer(raw, np.uint8))
    tags = np.zeros(len(toks.begins), np.int64)
    for start, end in spans:
        a, b = np.searchsorted(toks.ends, places[start] + 1, side="right"), np.searchsorted(toks.begins, places[end] + 1)  # tokens count from a byte before the text
        own = np.arange(a, b)
        fresh = own[tags[own] == OUTSIDE]
        tags[fresh] = INSIDE
        if len(fresh) and fresh[0] == a:
            tags[a] = BEGIN
    return toks, tags, places


def _windows(text: str, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training windows (entries, tags): around secrets, other tokens with figures or of some length, and any token of a text, from all over it; and around what is staged."""
    rng = np.random.default_rng(seed)
    toks, tags, _ = _tagged(text, [(start, end) for _, _, end, start in base_spans(text)])
    if not len(tags):
        return []
    some = lambda at: rng.choice(at, min(EACH, len(at)), replace=False).tolist()
    odd = (tags == OUTSIDE) & ((toks.entries[0] // 48 % 4 > 0) | (toks.ends - toks.begins > 15))
    out = []

    def cut(entries: np.ndarray, opens: np.ndarray, tags: np.ndarray, centre: int) -> None:
        a = max(0, centre - int(rng.integers(SPAN)))
        lines = np.cumsum(opens[a : a + SPAN])
        same = np.nonzero(lines == lines[centre - a])[0] + a
        out.append((entries[:, same], tags[same]))

    for centre in [*some(np.nonzero(tags == BEGIN)[0]), *some(np.nonzero(odd)[0]), *some(np.arange(len(tags)))]:
        cut(toks.entries, toks.opens, tags, centre)
    lines, spans, at = staged(text, rng)
    own, marks, places = _tagged(lines, spans)
    if len(marks):
        own.entries[6] = toks.entries[6, 0]  # they stand in the file that they are put into
        for centre in np.searchsorted(own.ends, places[at] + 1, side="right").clip(0, len(marks) - 1).tolist():
            cut(own.entries, own.opens, marks, centre)
    return out


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_windows: int = TRAIN_WINDOWS) -> Field:
    """Fits on windows of a bounded sample of documents. An empty table, or one without a token, gives a field that adds nothing."""
    common.prepare(docs.sparkSession)
    usable = docs.where("text is not null").select("text", F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns]).alias("key"))
    n = usable.count()
    sample = usable.where(common.sampled(F.col("key"), train_docs / max(n, 1)))

    def cut(batches):
        import pyarrow as pa

        for batch in common.short(batches):
            out = []
            for text, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(np.ascontiguousarray(entries, np.int16).tobytes(), tags.astype(np.int8).tobytes(), bool(tags.any())) for entries, tags in _windows(text, key & 0xFFFFFFFF)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.binary(), pa.binary(), pa.bool_()))], ["entries", "tags", "secret"])

    # a bounded number of windows of bounded size
    windows = common.stored(sample.mapInArrow(cut, "entries binary, tags binary, secret boolean").distinct(), "windows")
    got = [r for secret in (True, False) for r in windows.where(F.col("secret") == secret).orderBy(F.xxhash64("entries", "tags"), "entries", "tags").limit(train_windows).collect()]
    common.discard(windows)
    if n and not got and docs.where(F.col("text").rlike("[A-Za-z0-9]")).limit(1).count() and n > train_docs:
        raise ValueError("no window was sampled")
    entries, tags = np.full((len(got), 7, SPAN), -1, np.int32), np.zeros((len(got), SPAN), np.int64)
    for k, row in enumerate(got):
        y = np.frombuffer(row["tags"], np.int8)
        tags[k, : len(y)] = y
        entries[k, :, : len(y)] = np.frombuffer(row["entries"], np.int16).reshape(7, len(y))
    return fit(entries, tags)


def find(field: Field | None, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of each text's secrets in order of start, then kind: all the patterns' and what the field adds clear of them."""
    out = [[s[:3] for s in base_spans(t)] for t in texts]
    raw = [t.encode() for t in texts]
    toks = tokens(raw)
    if field is None or not len(toks.begins):
        return out
    tags = field.decode(toks.entries, toks.opens)
    (secret,) = np.nonzero(tags)
    if not len(secret):
        return out
    head = (tags[secret] == BEGIN) | (np.diff(secret, prepend=-2) > 1) | toks.opens[secret]
    bounds = np.cumsum([1, *(len(t) + 1 for t in raw)])
    points = np.cumsum((np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8) & 0xC0) != 0x80)  # code points up to and with each byte
    firsts = np.nonzero(head)[0]
    a, b = secret[firsts], secret[np.append(firsts[1:], len(secret)) - 1]
    text = toks.text[a]
    start, end = (points[x - 1] - points[bounds[text] - 1] for x in (toks.begins[a], toks.ends[b]))
    for k in np.unique(text):
        own, base = np.nonzero(text == k)[0] if len(texts) > 1 else slice(None), out[k]
        s, e = start[own], end[own]
        if base:  # those that no pattern's span overlaps: of the spans that begin before the end, none ends after the start
            before = np.searchsorted([x[0] for x in base], e)
            reach = np.append(np.maximum.accumulate([x[2] for x in base]), -1)[before - 1]
            clear = (before == 0) | (reach <= s)
            s, e = s[clear], e[clear]
        out[k] = sorted([*base, *((int(x), 3, int(y)) for x, y in zip(s, e))])
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row, from its whole text however long. Null text: empty. Repeated rows and null ids stay.

    Of equally good tag sequences the one whose tags come first (outside, begin, inside) is taken.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(field)  # of fixed size

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        for batch in common.short(batches):
            spans = find(shared.value, [t or "" for t in batch.column(1).to_pylist()])
            counts = [pa.array([sum(s[1] == k for s in x) for x in spans], pa.int64()) for k in range(3)]
            base = pa.array([hashlib.sha256(joined([s for s in x if s[1] < 3]).encode()).hexdigest() for x in spans], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, base, pa.array(map(joined, spans), pa.string())], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of secrets replaced by MASK."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame, field: Field) -> DataFrame:
    """All rows and columns, with the secrets of text masked and n_chars, where that column is there, made the new length. A null text stays null."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared, at = spark.sparkContext.broadcast(field), docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in common.short(batches):
            texts = batch.column(at).to_pylist()
            new = [None if t is None else masked(t, s) for t, s in zip(texts, find(shared.value, [t or "" for t in texts]))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    docs = common.table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
