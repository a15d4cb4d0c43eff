"""Removal of repeated 400-byte strings by suffix grouping, and passages of words that documents share.

A byte goes if a string of 400 bytes that covers it also starts anywhere else in the corpus.

1. Each window of 400 bytes has an anchor: the leftmost of its 64-byte strings with the least hash.
   Equal windows have equal anchors at equal places, so only windows whose anchor occurs twice can
   repeat: no other window is looked at again. Neighbouring windows share an anchor and make a run;
   a run is known by two 64-bit hashes, of its anchor and of all its text.
2. A run whose text occurs twice repeats in full. Where an anchor has one text only, that is all.
3. Other runs are cut, at places counted from the anchor, into blocks of up to 16 windows. What all
   windows of a block share, 385 bytes, becomes one symbol: the core. A block is thus a string of up
   to 31 symbols, and its windows are the substrings of 16 symbols. Blocks are dealt by core; in each
   task, the strings of many cores are suffix-sorted by linear grouping (suffixes.py), and windows
   whose 16 symbols equal those of a neighbour in the order repeat.
4. A hot core, one with over HOT different blocks, is split before it is dealt: its blocks are cut into
   blocks of 4 windows, which share 397 bytes and so have other cores, and these once more into
   single windows. Their parts are sorted in the same way; all blocks of one window and one core are
   equal, so no core stays hot.

Passages: `passage_words` counts the words of a document that stand in a string of 51 words which
another document has too. Words are what white space (\\x20, \\x09-\\x0D) separates, A-Z in lower case.
A passage of 51 words may have fewer than 400 bytes, in which case nothing of it is removed: the
column says that it is there. It is found on the way and in the same manner, with words in place of
bytes: anchors of 8 words, cores of 36 words, symbols of 32 bits of a word's hash beside a core.

Copies of a run, in one document or in many, are one row with a count from the start, so groups of
copies of any size cost one row for each task. Equality is that of 128 bits of hashes: at 10^11 runs,
two that differ are taken for equal with a chance of about 10^-17.

Nulls: a null text is empty; texts of under 400 bytes, and windows that cross documents, never match.
A null doc_id is kept, a repeated row is another document: its text repeats. An empty table gives an
empty result. Further columns are ignored by removals() and kept by deduplicated(). Where a removed
run cuts a character in two, deduplicated() drops the character's remaining bytes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import discard, table, texts, utf8, written
from lexgrove.llm.near_dedup import mixed
from lexgrove.llm.suffixes import suffix_array

SPAN, GRAM, BLOCK = 400, 64, 16
#: Words of a shared passage, and of its anchors.
PASSAGE, PASSAGE_GRAM = 51, 8
#: Different blocks of one core that go to one task, and the windows of a block before and after hot cores are split.
HOT, WIDTHS = 4096, (16, 4, 1)
#: Bytes or words whose windows are gone through at once, bytes whose words are hashed at once, and symbols sorted at once.
SEGMENT, PIECE, SYMBOLS = 2 << 20, 1 << 20, 1 << 18
POSITION = np.uint64((1 << 26) - 1)

_random = np.random.default_rng(400)
BYTE_HASHES = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = _random.integers(0, 1 << 63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWER = FACTORS[1]
INVERSE = np.uint64(pow(int(POWER), -1, 1 << 64))


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` hashes, the place of the leftmost least one."""
    v = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while 2 * reach <= width:
        v = np.minimum(v[:-reach], v[reach:])
        reach *= 2
    v = np.minimum(v[: len(v) - (width - reach)], v[width - reach :])
    return (v & POSITION).astype(np.int64)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of bytes, the place of its anchor; for each place, the hash of its 64 bytes."""
    h = BYTE_HASHES[data]
    for i, factor in enumerate(FACTORS):
        h = h[: -(1 << i)] * factor + h[1 << i :]
    h = mixed(h)
    return least_places(h, SPAN - GRAM + 1), h


def word_anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As anchors(), for windows of words, given by their hashes."""
    h = words
    for i, factor in enumerate(FACTORS[: PASSAGE_GRAM.bit_length() - 1]):
        h = h[: -(1 << i)] * factor + h[1 << i :]
    h = mixed(h + np.uint64(PASSAGE))
    return least_places(h, PASSAGE - PASSAGE_GRAM + 1), h


LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Weights of a word's bytes by place: LOW[place % 4096], times HIGH[place / 4096] in longer words.
LOW = np.multiply.accumulate(np.full(4096, POWER, np.uint64))
HIGH = np.multiply.accumulate(np.append(np.uint64(1), np.full((1 << 16) - 1, FACTORS[2], np.uint64)))


def word_hashes(data: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of bytes: where words begin, and the words' hashes, A-Z in lower case. A word ends before each of `breaks`, too.

    Goes through PIECE bytes at a time; a word that goes on in the next piece is added up there.
    """
    begins, sums, inside = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], False
    opened = 0
    for base in range(0, len(data), PIECE):
        part = LOWER[data[base : base + PIECE]]
        blank = BLANK[part]
        first = ~blank
        first[1:] &= blank[:-1]
        first[0] &= not inside
        if breaks is not None:
            here = breaks[np.searchsorted(breaks, base) : np.searchsorted(breaks, base + len(part))] - base
            first[here] = ~blank[here]
        starts = np.flatnonzero(first)
        h = BYTE_HASHES[part]
        h[blank] = 0
        head = int(starts[0]) if len(starts) else len(part)
        if inside and head and len(sums[-1]):
            sums[-1][-1:] += (h[:head] * weights(np.arange(base - opened, base - opened + head))).sum()
        if len(starts):
            lengths = np.diff(np.append(starts, len(part)))
            place = np.arange(head, len(part)) - np.repeat(starts, lengths)
            sums.append(np.add.reduceat(h[head:] * weights(place), starts - head))
            begins.append(starts + base)
            opened = base + int(starts[-1])
        inside = not blank[-1]
    return np.concatenate(begins), mixed(np.concatenate(sums))


def weights(place: np.ndarray) -> np.ndarray:
    w = LOW[place & 4095]
    return w * HIGH[(place >> 12) & 0xFFFF] if len(place) and place.max() > 4095 else w


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def doc_key(doc_id: int | None, text: bytes) -> int:
    """Rows with one doc_id and one text are alike in all results and share a key."""
    return signed(xxhash.xxh3_64_intdigest(text, seed=0 if doc_id is None else (doc_id * 2 + 1) & (2**64 - 1)))


#: shape: a run's number of windows, times 1024, and how far its anchor is from its start.
RUNS = pa.schema([("anchor", pa.int64()), ("ctx", pa.int64()), ("doc", pa.int64()), ("words", pa.bool_()), ("shape", pa.int32()), ("start", pa.int32()), ("starts", pa.binary())])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def runs_of(units: np.ndarray, owner: np.ndarray, span: int, anchored) -> Iterator[tuple[np.ndarray, ...]]:
    """Segment by segment, of each run of windows in one text: first and last window, place of the anchor, and its hash.

    units: the bytes or words of some texts, end to end; owner: the text of each.
    """
    for base in range(0, max(0, len(units) - span + 1), SEGMENT):
        at, h = anchored(units[base : base + SEGMENT + span - 1])
        own = owner[base : base + len(at) + span - 1]
        windows = np.flatnonzero(own[: len(at)] == own[span - 1 :])
        if len(windows):
            at = at[windows]
            new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            last = windows[np.append(new[1:], len(at)) - 1]
            where = at[new]
            yield windows[new] + base, last + base, where + base, h[where].view(np.int64)


def run_batch(keys: np.ndarray, begins: np.ndarray, owner: np.ndarray, words: bool, found: tuple[np.ndarray, ...], ctx: np.ndarray) -> pa.RecordBatch:
    """Rows of RUNS: a run that occurs several times in one text is one row."""
    first, last, where, h = found
    own = owner[first]
    order = np.lexsort((ctx, own))
    first, last, where, h, ctx, own = (x[order] for x in (first, last, where, h, ctx, own))
    shape = ((last - first + 1) * 1024 + where - first).astype(np.int32)
    same = (own[1:] == own[:-1]) & (ctx[1:] == ctx[:-1]) & (h[1:] == h[:-1]) & (shape[1:] == shape[:-1])
    new = np.flatnonzero(np.append(True, ~same))
    start = (first - begins[own]).astype(np.int32)
    starts = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer((np.append(new, len(own)) * 4).astype(np.int32)), pa.py_buffer(start)])
    columns = [h[new], ctx[new], keys[own[new]], np.full(len(new), words), shape[new], start[new]]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), starts], schema=RUNS)


def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> one row for each different run of bytes or words of each, with all its starts there.

    Short texts are gone through together; windows that cross from one into the next are left out.
    """
    for batch in batches:
        ids = batch.column(0).to_pylist()
        data, offsets = utf8(batch.column(1))
        at = 0
        while at < len(ids):
            to = at + 1
            while to < len(ids) and offsets[to + 1] - offsets[at] <= SEGMENT:
                to += 1
            body = data[offsets[at] : offsets[to]]
            keys = np.array([doc_key(i, data[a:b]) for i, a, b in zip(ids[at:to], offsets[at:to], offsets[at + 1 : to + 1])], np.int64)
            edges = np.array(offsets[at : to + 1], np.int64) - offsets[at]
            units, begins = np.frombuffer(body, np.uint8), edges[:-1]
            owner = np.repeat(np.arange(to - at, dtype=np.int32), np.diff(edges))
            for found in runs_of(units, owner, SPAN, anchors):
                ctx = [xxhash.xxh3_64_intdigest(body[a : b + SPAN], seed=c - a) for a, b, c in zip(*(x.tolist() for x in found[:3]))]
                yield run_batch(keys, begins, owner, False, found, np.array(ctx, np.uint64).view(np.int64))
            at_word, hashes = word_hashes(units, begins[begins < len(units)])
            word_owner = owner[at_word]
            del owner
            begins = np.searchsorted(at_word, begins)
            for found in runs_of(hashes, word_owner, PASSAGE, word_anchors):
                yield run_batch(keys, begins, word_owner, True, found, word_contexts(hashes, *found[:3]))
            at = to


def word_contexts(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Hashes of the runs' words: polynomials, from differences of running sums, and the place of the anchor."""
    low, high = int(first[0]), int(last[-1]) + PASSAGE
    powers, inverse = (np.multiply.accumulate(np.full(high - low, x, np.uint64)) for x in (POWER, INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[low:high] * powers)])
    body = mixed((sums[last + PASSAGE - low] - sums[first - low]) * inverse[first - low])
    return mixed(body + (where - first).astype(np.uint64) * FACTORS[0]).view(np.int64)


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their key and compressed text, for the shuffles."""
    coder = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        ids = batch.column(0)
        bodies = list(texts(batch))
        keys = [doc_key(i, t) for i, t in zip(ids.to_pylist(), bodies)]
        yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.int64()), pa.array([coder.compress(t) for t in bodies], pa.binary())], names=["doc_id", "doc", "body"])


BLOCKS = pa.schema([("core", pa.binary()), ("left", pa.binary()), ("right", pa.binary()), ("windows", pa.int32()), ("anchor", pa.int64()), ("ctx", pa.int64()), ("words", pa.bool_()), ("doc", pa.int64()), ("first", pa.int32())])


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the runs to be looked into -> their blocks. first: the block's first window, counted from the run's."""
    coder = zstandard.ZstdDecompressor()
    for batch in batches:
        rows: list[tuple] = []
        for doc, body, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            text, symbols = coder.decompress(body.as_py()), None
            for run in runs:
                lo, (n, off) = run["start"], divmod(run["shape"], 1024)
                hi, known = lo + n - 1, (run["anchor"], run["ctx"], run["words"], doc)
                anchor, wide, span, unit, beside, size = lo + off, 1, SPAN, text, text, 1
                if run["words"]:
                    if symbols is None:
                        # Cores are told apart by whole hashes, what stands beside them by symbols.
                        _, hashes = word_hashes(np.frombuffer(text, np.uint8))
                        raw, symbols = hashes.tobytes(), hashes.astype(np.uint32).tobytes()
                    wide, span, unit, beside, size = 8, PASSAGE, raw, symbols, 4
                for b in range((anchor - hi) // BLOCK, (anchor - lo) // BLOCK + 1):
                    top, low = anchor - b * BLOCK, anchor - b * BLOCK - BLOCK + 1
                    a, z = max(lo, low), min(hi, top)
                    core = core_of(unit[wide * top : wide * (low + span)], b * BLOCK, BLOCK, run["words"])
                    rows.append((core, beside[size * a : size * top], beside[size * (low + span) : size * (z + span)], z - a + 1, *known, a - lo))
            if len(rows) > 20_000:
                yield batch_of(rows, BLOCKS)
                rows = []
        if rows:
            yield batch_of(rows, BLOCKS)


def core_of(text: bytes, place: int, width: int, words: bool) -> bytes:
    """A block's core: what its windows share, at its place before the anchor."""
    return xxhash.xxh3_128_digest(text, seed=((place + SPAN) * 2 * BLOCK + width) * 2 + words)


#: Different blocks. a, b: the least and the largest of the places where a block occurs (of bytes) or of the documents that have it (of words).
DIFFERENT = pa.schema([("core", pa.binary()), ("left", pa.binary()), ("right", pa.binary()), ("windows", pa.int32()), ("words", pa.bool_()), ("a", pa.int64()), ("b", pa.int64())])


def symbols_of(side: bytes, words: bool) -> list[int]:
    """Bytes, or halves of words' hashes, as symbols above those of ends; cores have symbols above all of these."""
    return [c + 2 for c in (np.frombuffer(side, np.uint32).tolist() if words else side)]


def repeated_windows(rows: list[tuple], width: int) -> list[int]:
    """Different blocks -> bits of the windows that occur at another place, or in another document."""
    s: list[int] = []
    begins: list[int] = []
    numbers: dict[bytes, int] = {}
    for core, left, right, _, words, _, _ in rows:
        begins.append(len(s))
        s += symbols_of(left, words)
        s.append((1 << 33) + numbers.setdefault(core, len(numbers)))
        s += symbols_of(right, words)
        s.append(1)
    owner: dict[int, tuple[int, int]] = {b + i: (k, i) for k, (b, x) in enumerate(zip(begins, rows)) for i in range(x[3])}
    bits = [(1 << x[3]) - 1 if x[5] != x[6] else 0 for x in rows]
    alike: list[int] = []

    def settle() -> None:
        if len(alike) > 1:
            members = [owner[at] for at in alike]
            if min(rows[k][5] for k, _ in members) != max(rows[k][6] for k, _ in members):
                for k, i in members:
                    bits[k] |= 1 << i

    for at in suffix_array(s):
        if at not in owner:
            settle()
            alike = []
        elif alike and s[alike[-1] : alike[-1] + width] == s[at : at + width]:
            alike.append(at)
        else:
            settle()
            alike = [at]
    settle()
    return bits


MASKS = pa.schema([*list(DIFFERENT)[:4], ("bits", pa.int32())])


def grouped(width: int):
    """Different blocks sorted by core -> the bits of their repeated windows, if any."""
    most = SYMBOLS // (2 * width)

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        # A core's only block is there because it occurs twice; nothing is to be sorted.
        alone = Counter(r[0] for r in rows)
        out = [(*r[:4], (1 << r[3]) - 1) for r in rows if alone[r[0]] == 1 and r[5] != r[6]]
        rows = [r for r in rows if alone[r[0]] > 1]
        if out := out + [(*r[:4], b) for r, b in zip(rows, repeated_windows(rows, width)) if b]:
            yield batch_of(out, MASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held.extend(zip(*(c.to_pylist() for c in batch.columns)))
            # The last core's rows may go on in the next batch.
            k = len(held)
            while k and len(held) > most and held[k - 1][0] == held[-1][0]:
                k -= 1
            if len(held) > most and k:
                for part in cores_up_to(held[:k], most):
                    yield from flush(part)
                held = held[k:]
        for part in cores_up_to(held, most):
            yield from flush(part)

    return run


CUT = pa.schema([*list(DIFFERENT), ("_core", pa.binary()), ("_left", pa.binary()), ("_right", pa.binary()), ("_windows", pa.int32()), ("shift", pa.int32())])


def narrowed(width: int, to: int):
    """Blocks of up to `width` windows -> each with its blocks of up to `to` windows, and where they begin in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                core, left, right, windows, words, _, _ = row
                size = 4 if words else 1
                n = len(left) // size
                for g in range(width // to):
                    # Windows are told apart by how many symbols before the core they have.
                    least, most = max(n - windows + 1, to * g), min(n, to * g + to - 1)
                    if least <= most:
                        i, j = n - to * g, width - to * (g + 1)
                        inner = core_of(core + left[size * i :] + b"|" + right[: size * j], g, to, words)
                        rows.append((*row, inner, left[size * (n - most) : size * i], right[size * j : size * (width - 1 - least)], most - least + 1, n - most))
            if rows:
                yield batch_of(rows, CUT)

    return run


def cores_up_to(rows: list[tuple], most: int) -> Iterator[list[tuple]]:
    """Rows in lists of about `most`, each core in one list."""
    part: list[tuple] = []
    for r in rows:
        if len(part) >= most and r[0] != part[-1][0]:
            yield part
            part = []
        part.append(r)
    if part:
        yield part


def covered(size: int, span: int, runs: list[dict]) -> np.ndarray:
    """Which of `size` bytes or words repeated windows cover."""
    cover = np.zeros(size + 1, np.int32)
    for r in runs:
        for start in np.frombuffer(r["starts"], np.int32).tolist():
            if r["full"]:
                cover[start] += 1
                cover[start + (r["shape"] >> 10) - 1 + span] -= 1
            else:
                for part in r["parts"] or ():
                    for i in range(BLOCK):
                        if part["bits"] >> i & 1:
                            cover[start + part["first"] + i] += 1
                            cover[start + part["first"] + i + span] -= 1
    return np.cumsum(cover)[:-1] > 0


def spans(text: bytes, runs: list[dict] | None) -> list[tuple[int, int]]:
    """The removed runs of a text: from, to (exclusive)."""
    mine = [r for r in runs or () if not r["words"]]
    if not mine:
        return []
    edge = np.flatnonzero(np.diff(covered(len(text), SPAN, mine), prepend=False, append=False))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def passage_words(text: bytes, runs: list[dict] | None) -> int:
    mine = [r for r in runs or () if r["words"]]
    return int(covered(len(text.split()), PASSAGE, mine).sum()) if mine else 0


def cut(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in gone:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


VERDICTS = pa.schema([*((c, pa.int64()) for c in ("doc_id", "doc", "n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string()), ("passage_words", pa.int64()), ("text_sha256", pa.string()), ("gone", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))])


def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for doc_id, key, body, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
            text = coder.decompress(body.as_py())
            gone = spans(text, runs)
            rows.append((doc_id, key, len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(cut(text, gone)).hexdigest(), passage_words(text, runs), hashlib.sha256(text).hexdigest(), [{"from": a, "to": b} for a, b in gone]))
        if rows:
            yield batch_of(rows, VERDICTS)


BLOCK_KEY = ["core", "left", "right", "windows"]


def masks(blocks: DataFrame, hot: int, level: int = 0) -> DataFrame:
    """DIFFERENT blocks -> core, left, right, windows, and the bits of their repeated windows."""
    width, columns = WIDTHS[level], DIFFERENT.names
    if width == 1:
        return blocks.where("a <> b").select(*BLOCK_KEY, F.lit(1).alias("bits"))
    sizes = blocks.groupBy("core").agg(F.count("*").alias("k"), F.min("a").alias("_a"), F.max("b").alias("_b")).where("_a <> _b").select("core", "k")
    sized = blocks.join(sizes.hint("merge"), "core")
    cold = sized.where(F.col("k") <= hot).select(*columns).repartition("core").sortWithinPartitions("core", "left", "right")
    out = cold.mapInArrow(grouped(width), "core binary, left binary, right binary, windows int, bits int")
    if blocks.groupBy("core").count().where(F.col("count") > hot).isEmpty():
        return out
    kinds = "core binary, left binary, right binary, windows int, words boolean, a long, b long, _core binary, _left binary, _right binary, _windows int, shift int"
    rows = written(sized.where(F.col("k") > hot).select(*columns).mapInArrow(narrowed(width, WIDTHS[level + 1]), kinds), "hot")
    inner = [f"_{c}" for c in BLOCK_KEY]
    finer = rows.groupBy(*inner).agg(F.first("words").alias("words"), F.min("a").alias("a"), F.max("b").alias("b"))
    finer = written(finer.select(*[F.col(f"_{c}").alias(c) for c in BLOCK_KEY], "words", "a", "b"), "finer")
    found = masks(finer, hot, level + 1).select(*[F.col(c).alias(f"_{c}") for c in BLOCK_KEY], "bits")
    bits = rows.join(found, inner).groupBy(*BLOCK_KEY).agg(F.expr("cast(bit_or(shiftleft(bits, shift)) as int)").alias("bits"))
    return out.unionByName(bits)


def removals(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, passage_words, text_sha256, gone (byte ranges): one row for each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    runs = written(docs.mapInArrow(run_rows, "anchor long, ctx long, doc long, words boolean, shape int, start int, starts binary"), "runs")
    # A passage counts once for each document that has it, a string of bytes as often as it starts.
    times = F.when(F.col("words"), 1).otherwise(F.length("starts") / 4)
    several = runs.groupBy("anchor").agg(F.sum(times).alias("n"), F.min("ctx").alias("a"), F.max("ctx").alias("b")).where("n > 1")
    several = several.select("anchor", (F.col("a") != F.col("b")).alias("differ"))
    met = written(runs.join(several.hint("merge"), "anchor"), "repeats")
    discard(runs)
    each = met.where("differ").groupBy("anchor", "ctx").agg(F.sum(times).cast("long").alias("n"), F.min(F.struct("doc", "words", "shape", "start")).alias("rep"))
    each = written(each, "contexts")
    run = F.struct("anchor", "ctx", F.col("rep.words").alias("words"), F.col("rep.shape").alias("shape"), F.col("rep.start").alias("start"))
    inside = each.groupBy(F.col("rep.doc").alias("doc")).agg(F.collect_list(run).alias("runs"))
    packed = docs.mapInArrow(squeezed, "doc_id long, doc long, body binary")
    once = packed.join(inside, "doc").dropDuplicates(["doc"]).select("doc", "body", "runs")
    blocks = written(once.mapInArrow(block_rows, "core binary, left binary, right binary, windows int, anchor long, ctx long, words boolean, doc long, first int"), "blocks")
    weighed = blocks.join(each.select("anchor", "ctx", "n"), ["anchor", "ctx"])
    different = weighed.groupBy(*BLOCK_KEY).agg(F.first("words").alias("words"), F.sum("n").alias("n"), F.max("n").alias("most"), F.min("doc").alias("low"), F.max("doc").alias("high"))
    # Rows that repeat a document have one key between them, but are documents each.
    several = F.when(F.col("words"), F.col("most") > 1).otherwise(F.col("n") > 1)
    a, b = (F.when(several, F.lit(end)).otherwise(F.when(F.col("words"), F.col(c)).otherwise(F.xxhash64(*BLOCK_KEY))) for c, end in (("low", -(1 << 63)), ("high", (1 << 63) - 1)))
    different = written(different.select(*BLOCK_KEY, "words", a.alias("a"), b.alias("b")), "different")
    bits = masks(different, hot)
    parts = blocks.join(bits, BLOCK_KEY).groupBy("anchor", "ctx").agg(F.collect_list(F.struct("first", "bits")).alias("parts"))
    parts = written(parts, "parts")
    discard(blocks, different)
    copies = each.where("n > 1").select("anchor", "ctx").withColumn("copied", F.lit(True))
    known = met.join(copies, ["anchor", "ctx"], "left").withColumn("full", ~F.col("differ") | F.coalesce("copied", F.lit(False)))
    known = known.join(parts, ["anchor", "ctx"], "left").where("full or parts is not null")
    of = known.groupBy("doc").agg(F.collect_list(F.struct("words", "starts", "shape", "full", F.when(~F.col("full"), F.col("parts")).alias("parts"))).alias("runs"))
    of = written(of, "covered")
    discard(met, each, parts)
    # A row that repeats a document has the same key: all its windows occur in the other.
    return packed.join(of, "doc", "left").select("doc_id", "doc", "body", "runs").mapInArrow(verdicts, "doc_id long, doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage_words long, text_sha256 string, gone array<struct<from: long, to: long>>").drop("doc")


def cutter(column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, gone = batch.column(column).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            left = [t if not g else cut(t.encode(), [(x["from"], x["to"]) for x in g]).decode("utf-8", "ignore") for t, g in zip(text, gone)]
            columns = batch.columns[:-1]
            columns[column] = pa.array(left, batch.column(column).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return run


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with the removed bytes out of text; the same rows and columns. A null text stays null."""
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    gone = removals(docs).where("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_text"), "gone").dropDuplicates(["_id", "_text"])
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_own"), sha.alias("_sha"))
    met = rows.join(gone, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_text")), "left")
    return met.select(*[F.col("_row")[c].alias(c) for c in docs.columns], F.col("gone").alias("_gone")).mapInArrow(cutter(docs.columns.index("text")), docs.schema)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents")).drop("gone", "text_sha256")


#: Windows are cut from pieces of 911 bytes and grouped by their hashes, which DuckDB keeps in 64 bits; what is left of a text is put together as hexadecimal digits.
OP6_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS x FROM documents),
u AS (SELECT doc_id, strlen(text) AS n, encode(text) AS e, unnest(range(0, strlen(text) - 399, 512)) AS a FROM t),
b AS (SELECT doc_id, a, e[a + 1:a + 911] AS e, unnest(range(0, least(512, n - 399 - a))) AS p FROM u),
h AS MATERIALIZED (SELECT doc_id, a + p AS p, hash(e[p + 1:p + 400]) AS h FROM b),
twice AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
r AS (SELECT doc_id, p, p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400, -1) AS gap FROM h WHERE h IN (FROM twice)),
i AS (SELECT doc_id, p, sum((gap > 0 OR p = 0)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM r),
g AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS z FROM i GROUP BY doc_id, island),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM g),
kept AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS x
  FROM k JOIN t USING (doc_id) GROUP BY doc_id),
w AS (SELECT doc_id, [x for x in string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM t),
v AS MATERIALIZED (SELECT doc_id, unnest([{'p': i, 'h': hash(array_to_string(w[i:i + 50], ' '))} for i in range(1, len(w) - 49)], recursive := true) FROM w),
shared AS (SELECT h FROM v GROUP BY h HAVING count(DISTINCT doc_id) > 1),
q AS (SELECT doc_id, count(DISTINCT n) AS passage_words FROM (SELECT doc_id, unnest(range(p, p + 51)) AS n FROM v WHERE h IN (FROM shared)) GROUP BY 1)
SELECT t.doc_id, strlen(t.text)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept.x, t.x))) AS kept_sha256, coalesce(passage_words, 0)::BIGINT AS passage_words
FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN q USING (doc_id)
"""
