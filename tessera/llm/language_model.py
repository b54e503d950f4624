"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and mapped into memory by workers.

Tokens are the words of a text, A-Z in lower case, and one end. A token is the 64-bit hash
of its bytes, an n-gram the hash of its tokens' hashes.

Counting: tasks count the n-grams of some millions of tokens at a time and send them on in
packets by the leading bits of their hash; the task of a shard sums them, writes the shard's
table and sends the next lower order on: an (n-1)-gram's adjusted count is the number of
n-grams that end with it. It also sends, for each context, the number of its continuations
that occur once, twice and more often. Hot words are no hot keys, since shards are dealt by
whole n-grams and a context is summed in each shard first.

Tables: for each order and shard a file in the shared folder, with the hashes of n-grams (and
of contexts) in order and their counts beside them as arrays. Workers map the files into
memory; a task looks up some millions of tokens at once, sorted, so that it goes through the
shards in order and holds pages no longer than the system likes. The file's name holds its
order and shard, it is renamed into place when complete, and a repeated task writes the same.

Probabilities: three discounts an order from the counts of counts (0.5, 1 and 1.5 where they
give none), interpolated down to single tokens and then to 1 / (V + 1), V the distinct
training tokens, the end among them. The start of a text counts as a context only.

Edge cases: a null text is empty and has the end alone; a null id reads as empty in the
checksum; repeated rows count again; without training texts every token has the
probability 1 / (V + 1) = 1; an empty table gives no rows; texts of any length are read in
pieces; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, held, shared_dir, text_or_empty

#: The production order. Trigrams would not fit the disk that the check allows (README).
ORDER = 2
#: Bytes of text a shard is made for, bytes of text hashed at once, tokens counted at once and looked up at once.
SHARD_BYTES, PIECE, TOKENS, SCORED = 16 << 20, 1 << 20, 2_500_000, 800_000
TEST_FOLD, FOLDS = 1, 5

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit numbers (the finalizer of SplitMix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate((np.ones(1, U), np.full(n - 1, base, U))), dtype=U)


def key_of(tokens: list[np.ndarray]) -> np.ndarray:
    """The hash of n-grams, given their tokens by place. Of a single token it is the token."""
    key = tokens[0]
    for t in tokens[1:]:
        key = mix(key * U(_PRIME) ^ t)
    return key


with np.errstate(over="ignore"):
    _BYTES = mix(np.arange(256, dtype=U) + U(0x51))
    _BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
    START, END = (int(x) for x in mix(np.array([0xA5A5, 0x5A5A], U)))


class Hasher:
    """Words of a stretch of bytes as 64-bit hashes."""

    def __init__(self) -> None:
        self.powers, self.inverses = _powers(_PRIME, 1), _powers(_INVERSE, 1)

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places where words start, and their hashes."""
        raw = np.frombuffer(data, np.uint8)
        if len(raw) >= len(self.powers):
            self.powers, self.inverses = _powers(_PRIME, len(raw) + 1), _powers(_INVERSE, len(raw) + 1)
        solid = np.concatenate(([False], ~_SPACE[raw], [False]))
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        starts, ends = edges[::2], edges[1::2]
        # A polynomial of the bytes, shifted to its own start, from running sums modulo 2 ** 64.
        sums = np.concatenate((np.zeros(1, U), np.cumsum(_BYTES[raw] * self.powers[: len(raw)], dtype=U)))
        return starts, mix((sums[ends] - sums[starts]) * self.inverses[starts] ^ (ends - starts).astype(U))


_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """A text in stretches that end at white space, and whether each is the last."""
    at = 0
    while len(text) - at > PIECE:
        found = _BREAK.search(text, at + PIECE)
        if found is None:
            break
        yield text[at : found.start()], False
        at = found.end()
    yield text[at:], True


def chunks(texts: Iterator[bytes], order: int, limit: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Of some ``limit`` tokens each: the number of the token's text, and the n tokens up to it.

    Texts are numbered from 0 in the order given; what precedes a text are starts.
    """
    hasher, pre = Hasher(), order - 1
    carried = np.full(pre, START, U)
    stretch: list[tuple[int, bytes, bool]] = []
    size, made, total = 0, [], 0

    def hashed() -> tuple[np.ndarray, list[np.ndarray]]:
        """Tokens of the stretches at hand; starts or what a text had before are put before each."""
        nonlocal carried
        starts, words = hasher(b"\n".join(x for _, x, _ in stretch))
        limits = np.cumsum([len(x) + 1 for _, x, _ in stretch])
        own = np.searchsorted(limits, starts, "right")
        ends = np.array([last for _, _, last in stretch])
        n = np.bincount(own, minlength=len(stretch))
        base = np.concatenate(([0], np.cumsum(n + pre + ends)))
        full = np.empty(base[-1], U)
        is_token = np.ones(base[-1], bool)
        place = base[:-1][:, None] + np.arange(pre)[None, :]
        full[place] = START
        is_token[place] = False
        full[: pre] = carried
        full[np.arange(len(words)) + (base[:-1] + pre - np.concatenate(([0], np.cumsum(n)[:-1])))[own]] = words
        full[base[1:][ends] - 1] = END
        at = np.flatnonzero(is_token)
        carried = np.full(pre, START, U) if ends[-1] else full[len(full) - pre :].copy()
        number = np.repeat(np.array([k for k, _, _ in stretch]), n + ends)
        return number, [full[at - j] for j in range(pre, -1, -1)]

    def joined() -> tuple[np.ndarray, list[np.ndarray]]:
        number = np.concatenate([x for x, _ in made])
        columns = [[x[j] for _, x in made] for j in range(order)]
        made.clear()
        # One column after the other, so that parts and whole are held of one at a time.
        return number, [np.concatenate(columns.pop(0)) for _ in range(order)]

    for k, text in enumerate(texts):
        for x, last in pieces(text):
            stretch.append((k, x, last))
            size += len(x) + 1
            if size >= PIECE or not last:
                made.append(hashed())
                total += len(made[-1][0])
                stretch, size = [], 0
                if total >= limit:
                    yield joined()
                    total = 0
    if stretch:
        made.append(hashed())
    if made:
        yield joined()


# What is sent on: packets of rows. Of n-grams: their tokens, count, occurrences of the last token. Of contexts:
# the key, occurrences, continuations seen once, twice, more often. Tokens are numbered within a packet: its
# different tokens are written once, in order, as the steps between them, and rows by their numbers.
_GRAMS, _CONTEXTS = b"g", b"c"
SCHEMA = "shard int, data binary"


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as the largest needs; none for zeros alone."""
    most = int(x.max()) if len(x) else 0
    return x.astype(next(d for d, end in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (U, 64)) if most < 1 << end))


def packed(kind: bytes, tokens: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    known, numbers = np.unique(np.concatenate(tokens), return_inverse=True)
    numbers = numbers.reshape(len(tokens), -1)
    order = np.lexsort(numbers[::-1])
    first, *others = numbers[:, order]
    columns = [narrow(x) for x in (np.diff(first, prepend=0), *others, *(c[order] for c in counts))]
    head = np.array([len(known), len(first), len(tokens), *(x.itemsize for x in columns)], U)
    steps = np.diff(known, prepend=U(0)).view(np.uint8).reshape(-1, 8).T  # like bytes beside each other
    body = b"".join([np.ascontiguousarray(steps).tobytes(), *(x.tobytes() for x in columns)])
    return kind + bytes([len(head)]) + head.tobytes() + zstandard.ZstdCompressor(level=1).compress(body)


def unpacked(data: bytes) -> tuple[bytes, np.ndarray]:
    """The kind, and a matrix with a row for each token's place and each count."""
    head = np.frombuffer(data[2 : 2 + 8 * data[1]], U).astype(int)
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[2 + 8 * data[1] :]), np.uint8)
    (n_known, n, n_tokens), sizes = head[:3], head[3:]
    known = np.cumsum(np.ascontiguousarray(body[: 8 * n_known].reshape(8, -1).T).view(U).ravel(), dtype=U)
    at, columns = 8 * n_known, []
    for size in sizes:
        columns.append(body[at : at + n * size].view(f"u{size}"))
        at += n * size
    columns[0] = np.cumsum(columns[0], dtype=np.int64)
    return data[:1], np.stack([known[x] for x in columns[:n_tokens]] + [x.astype(U) for x in columns[n_tokens:]])


def packets(kind: bytes, key: np.ndarray, tokens: list[np.ndarray], counts: list[np.ndarray], bits: int) -> Iterator[tuple[int, bytes]]:
    """Rows sorted by ``key``, as a packet for each shard."""
    shard = (key >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
        yield int(shard[a]), packed(kind, [t[a:b] for t in tokens], [c[a:b] for c in counts])


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and where in it each different key begins."""
    order = np.argsort(key, kind="stable")
    found = key[order]
    return order, np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(key) else np.zeros(0, np.int64)


def rows_of(found: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    shards, data, size = [], [], 0
    for shard, x in found:
        shards.append(shard)
        data.append(x)
        size += len(x)
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(data, pa.binary())], ["shard", "data"])
            shards, data, size = [], [], 0
    if shards:
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(data, pa.binary())], ["shard", "data"])


def texts_of(batch_iter: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[bytes]:
    for batch in batch_iter:
        for x in batch.column(column):
            yield x.as_py()


def counter(order: int, bits: int):
    """Texts to packets of the highest order."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_packets() -> Iterator[tuple[int, bytes]]:
            for _, tokens in chunks(texts_of(found), order, TOKENS):
                key = key_of(tokens)
                at, first = grouped(key)
                n = np.diff(np.append(first, len(key))).astype(U)
                at = at[first]
                yield from packets(_GRAMS, key[at], [t[at] for t in tokens], [n, n], bits)
            give_back()

        yield from rows_of(all_packets())

    return run


def path_of(folder: str, order: int, shard: int) -> str:
    return f"{folder}/{order}-{shard:08d}"


def local(uri: str) -> str:
    """The shared folder as workers open it: they map files, so it has to be mounted where they run."""
    if re.match(r"[a-z0-9]+://", uri) and not uri.startswith("file://"):
        raise ValueError(f"{uri}: the tables are mapped into memory, so spark.checkpoint.dir must be a mounted folder")
    return re.sub("^file:(//)?", "", uri)


def save(path: str, columns: list[np.ndarray]) -> None:
    """Arrays one after the other behind a head (rows, bytes of a number of each), renamed into place. Zeros alone take no bytes."""
    columns = [columns[0], *map(narrow, columns[1:])]
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as out:
        out.write(np.array([len(columns[0]), *(x.itemsize if x.any() else 0 for x in columns)], U).tobytes())
        for x in columns:
            if x.any():
                out.write(x.tobytes())
                out.write(bytes(-x.nbytes % 8))
    os.replace(temporary, path)


def mapped(path: str, columns: int) -> list[np.ndarray] | None:
    """The arrays of a table as memory maps; None where no n-gram fell into the shard."""
    if not os.path.exists(path):
        return None
    raw = np.memmap(path, np.uint8, "r")
    head = raw[: 8 * (columns + 1)].view(U)
    n, at, out = int(head[0]), 8 * (columns + 1), []
    for k in range(columns):
        size = int(head[k + 1])
        out.append(raw[at : at + n * size].view(f"u{size}") if size else np.broadcast_to(np.uint8(0), n))
        at += -(-n * size // 8) * 8
    return out


#: Columns of a table: keys; count; occurrences (single tokens only); of contexts: occurrences, continuations seen once, twice, more often.
COLUMNS = 7


def merged(order: int, top: int, folder: str, bits: int, shard: int, found: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Sum a shard's packets, write its table, and send on what the order below needs, and the counts of counts."""
    grams, contexts = [], []
    for x in found:
        kind, columns = unpacked(x)
        (grams if kind == _GRAMS else contexts).append(columns)
    table = np.concatenate(grams, 1) if grams else np.zeros((order + 2, 0), U)
    tokens, n, seen = list(table[:order]), table[order], table[order + 1]
    key = key_of(tokens)
    at, first = grouped(key)
    one = at[first]
    tokens, key = [t[one] for t in tokens], key[one]
    n, seen = (np.add.reduceat(x[at], first) if len(first) else x for x in (n, seen))
    # Contexts of the order above share the table, and its keys.
    held_contexts = np.concatenate(contexts, 1) if contexts else np.zeros((5, 0), U)
    at, first = grouped(held_contexts[0])
    context_key = held_contexts[0][at[first]]
    sums = [np.add.reduceat(x[at], first) if len(first) else x[:0] for x in held_contexts[1:]]
    keys = np.union1d(key, context_key)
    columns = [keys]
    for own, values in [(key, [n, seen if order == 1 else seen[:0]]), (context_key, sums)]:
        for x in values:
            spread = np.zeros(len(keys), U)
            if len(x):
                spread[np.searchsorted(keys, own)] = x
            columns.append(spread)
    save(path_of(folder, order, shard), columns)
    ones = [int((n == k).sum()) for k in (1, 2, 3, 4)]
    yield -1, ",".join(map(str, [order, *ones, int((n > 2).sum()), int(n.sum()), len(n), int(seen.sum())])).encode()
    if order == 1:
        return
    context = key_of(tokens[:-1])
    at, first = grouped(context)
    rows = [n, *(cond.astype(U) for cond in (n == 1, n == 2, n > 2))]
    rows = [np.add.reduceat(x[at], first) if len(first) else x for x in rows]
    yield from packets(_CONTEXTS, context[at[first]], [context[at[first]]], rows, bits)
    lower = key_of(tokens[1:])
    at, first = grouped(lower)
    rows = [np.add.reduceat(x[at], first) if len(first) else x for x in (np.ones(len(n), U), seen)]
    one = at[first]
    yield from packets(_GRAMS, lower[one], [t[one] for t in tokens[1:]], rows, bits)


def merger(order: int, top: int, folder: str, bits: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_packets() -> Iterator[tuple[int, bytes]]:
            shard, packed = None, []
            for batch in found:
                for at, x in zip(batch.column("shard").to_pylist(), batch.column("data"), strict=True):
                    if at < 0:
                        yield at, x.as_py()
                        continue
                    if at != shard and packed:
                        yield from merged(order, top, folder, bits, shard, packed)
                        packed = []
                    shard = at
                    packed.append(x.as_py())
            if packed:
                yield from merged(order, top, folder, bits, shard, packed)
            give_back()

        yield from rows_of(all_packets())

    return run


class Counts(NamedTuple):
    """Counts of one order: n-grams seen once to four times and over twice, their sum, how many there are, occurrences."""

    ones: int
    twos: int
    threes: int
    fours: int
    more: int
    total: int
    types: int
    seen: int

    def discounts(self) -> tuple[float, float, float]:
        n = self[:4]
        if not all(n):
            return 0.5, 1.0, 1.5
        y = n[0] / (n[0] + 2 * n[1])
        found = tuple(k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3))
        return found if all(0 <= d <= k + 1 for k, d in enumerate(found)) else (0.5, 1.0, 1.5)


class Model(NamedTuple):
    folder: str
    order: int
    bits: int
    counts: dict[int, Counts]

    @property
    def tokens(self) -> int:
        """Training tokens."""
        return self.counts[1].seen

    @property
    def types(self) -> int:
        """Distinct training tokens."""
        return self.counts[1].types


def fit(docs: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> Model:
    """The model of the texts of ``docs``: counted, summed and written by Spark, order by order."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_or_empty()) + 1), F.lit(0))).first()[0]
    bits = math.ceil(math.log2(max(1, size / shard_bytes, 2 * spark.sparkContext.defaultParallelism)))
    folder = f"{local(shared_dir(spark))}/ngrams-{uuid.uuid4().hex}"
    os.makedirs(folder)
    texts = docs.select(text_or_empty().cast("binary").alias("text"))
    found = texts.mapInArrow(counter(order, bits), SCHEMA)
    for k in range(order, 0, -1):
        # A partition for each shard; told counts (-1) go along with the last.
        found = found.repartitionById(1 << bits, "shard").sortWithinPartitions("shard").mapInArrow(merger(k, order, folder, bits), SCHEMA)
    names = Counts._fields
    told = F.split(F.col("data").cast("string"), ",")
    told = found.select(told[0].cast("int").alias("order"), *(told[k + 1].cast("long").alias(c) for k, c in enumerate(names)))
    rows = told.groupBy("order").agg(*(F.sum(c).alias(c) for c in names)).collect()
    counts = {k: Counts(*[0] * len(names)) for k in range(1, order + 1)}
    return Model(folder, order, bits, counts | {r["order"]: Counts(*r[1:]) for r in rows})


class Tables:
    """A worker's view of the model's files, mapped when first asked for."""

    def __init__(self, model: Model) -> None:
        self.model, self.files = model, {}

    def table(self, order: int, shard: int) -> list[np.ndarray] | None:
        if (order, shard) not in self.files:
            if len(self.files) >= 4096:
                self.files.clear()
            self.files[order, shard] = mapped(path_of(self.model.folder, order, shard), COLUMNS)
        return self.files[order, shard]

    def look_up(self, order: int, key: np.ndarray, columns: list[int]) -> list[np.ndarray]:
        """The columns' values of each key, 0 where there is none; keys are looked up once each and in order."""
        keys, back = np.unique(key, return_inverse=True)
        out = [np.zeros(len(keys), np.float64) for _ in columns]
        bits = self.model.bits
        shard = (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            table = self.table(order, int(shard[a]))
            if table is None or not len(table[0]):
                continue
            own = keys[a:b]
            at = np.minimum(np.searchsorted(table[0], own), len(table[0]) - 1)
            hit = np.asarray(table[0][at]) == own
            for x, c in zip(out, columns, strict=True):
                x[a:b][hit] = table[c][at[hit]]
        return [x[back] for x in out]

    def score(self, tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in training and log10 probability of each n-gram's last token."""
        counts = self.model.counts
        p = np.full(len(tokens[0]), 1 / (self.model.types + 1))
        seen = np.zeros(len(p))
        for k in range(1, self.model.order + 1):
            # What follows the columns of a context is kept with the order below.
            if k == 1:
                n, seen = self.look_up(1, tokens[-1], [1, 2])
                total, *after = (np.full(len(p), float(x)) for x in (counts[1].total, counts[1].ones, counts[1].twos, counts[1].more))
            else:
                (n,) = self.look_up(k, key_of(tokens[-k:]), [1])
                total, *after = self.look_up(k - 1, key_of(tokens[-k:-1]), [3, 4, 5, 6])
            d = counts[k].discounts()
            discount = np.select([n == 0, n == 1, n == 2], [0, d[0], d[1]], d[2])
            rest = sum(x * y for x, y in zip(d, after, strict=True))
            known = total > 0
            p[known] = (n[known] - discount[known] + rest[known] * p[known]) / total[known]
        return seen, np.log10(p)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is in the fold that is not learned from."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % FOLDS == TEST_FOLD


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, base_score, score)`` of each row of ``docs``."""
    base_total = model.tokens + 0.5 * (model.types + 1)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = held(model.folder, lambda: Tables(model))
        ids: list[pa.RecordBatch] = []

        def texts() -> Iterator[bytes]:
            for batch in found:
                ids.append(batch.select(["doc_id", "held_out"]))
                for x in batch.column("text"):
                    yield x.as_py()

        # Sums of the texts that were begun and not yet told: a text may go on in the next chunk.
        first, sums = 0, np.zeros((4, 0))

        def told(upto: int) -> Iterator[pa.RecordBatch]:
            """Whole batches of texts numbered below ``upto``."""
            nonlocal first, sums
            while ids and first + len(ids[0]) <= upto:
                batch = ids.pop(0)
                own, sums = sums[:, : len(batch)], sums[:, len(batch) :]
                first += len(batch)
                values = [pa.array(own[0].astype(np.int64)), pa.array(own[1].astype(np.int64)), pa.array(own[2]), pa.array(own[3])]
                names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
                yield pa.RecordBatch.from_arrays([*batch.columns, *values], names)

        for number, tokens in chunks(texts(), model.order, SCORED):
            seen, score = tables.score(tokens)
            base = np.log10((seen + 0.5) / base_total)
            number = number - first
            upto = int(number[-1]) + 1
            if sums.shape[1] < upto:
                sums = np.concatenate((sums, np.zeros((4, upto - sums.shape[1]))), 1)
            for row, x in zip(sums, (None, seen > 0, base, score), strict=True):
                row[:upto] += np.bincount(number, x, minlength=upto)
            # The last text may not be complete.
            yield from told(first + upto - 1)
        yield from told(first + sums.shape[1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), text_or_empty().cast("binary").alias("text"))
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return rows.mapInArrow(run, schema)


def perplexity_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Learn from all folds but the test fold, score every document."""
    model = fit(docs.filter(~held_out()), order)
    out = scored(docs, model).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
