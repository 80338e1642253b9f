"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of pairs of neighbouring words in the training texts are quantised to levels
that grow by about 1.3; an n-gram of level q is put into a Bloom filter q times, as (n-gram, 1)
to (n-gram, q). Asking for (n-gram, 1), (n-gram, 2), ... until one is absent gives the level back:
never too low, and too high with a probability that falls with every level.

    P1(w)   = (c(w) + 1) / (N + V + 1)
    P(w|v)  = (c(v w) + MU * P1(w)) / (c(v) + MU)

with c from the filter; a pair counts only where both of its words are known. Quantised counts and
false positives make the P(w|v) of a v sum to about 1 only (the README has measured sums). Pairs
seen once are kept. MU has the best score of those tried on a fold of the training texts.

The filter is cut into regions by the leading bits of an n-gram's 64-bit hash, each as large as
its own n-grams ask for: BITS_PER_ENTRY bits for every level put in, whatever the corpus. A region
also has the exact counts of its words, for the base score. Within a region a pair stands as the
next 32 bits of its hash, so that another pair of the region stands for it with a probability of
pairs / 2**32. A probe reads one 64-bit word of the filter.

Regions of up to BROADCAST_BYTES together are broadcast. Beyond that they stay a table: texts are
dealt to blocks, each block asks the regions for its distinct n-grams, and the answers come back to
the blocks. Both ways give the same scores. Texts never meet by key, so no word, source or copy can
crowd a task; a hot n-gram is asked for once a block.

Words are maximal runs of bytes other than ASCII white space; a 64-bit hash stands for a word
throughout.

Cases: null and empty texts have one token, their end; a null doc_id counts as the empty text in
the split; repeated rows are scored, and learned from, each; without training texts every score is
that of an empty model; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACES, LOWER_AZ, documents, materialize

MU = 500.0
BITS_PER_ENTRY, PROBES = 12, 5
#: Of all regions, for them to be broadcast.
BROADCAST_BYTES = 32 << 20
#: Of texts: what a region is for (more where regions would be over 2**MOST_REGION_BITS), what a block has.
REGION_BYTES, BLOCK_BYTES = 8 << 20, 10 << 20
LEAST_REGION_BITS, MOST_REGION_BITS = 4, 18
#: Of a task's n-grams, before they are counted and sent.
TASK_TOKENS = 3_000_000
#: Bytes of texts that are hashed at once.
SLICE_BYTES, CHUNK_BYTES = 4 << 20, 1 << 18
#: Longer words are hashed one by one: sums of powers of 2**10 bytes and more can be made to agree.
LONG_WORD = 256
SPLIT, HELD_OUT = 7, 2


def level_starts() -> np.ndarray:
    """The least count of each level: every count up to 4, then steps of about 1.3."""
    out = [1]
    while out[-1] < 1 << 50:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * 1.3)))
    return np.array(out, np.int64)


STARTS = level_starts()
#: The count that a level stands for; level 0: none.
COUNT_OF = np.r_[0.0, (STARTS[:-1] + STARTS[1:] - 1) / 2]


def level_of(c: np.ndarray) -> np.ndarray:
    return np.searchsorted(STARTS, c, "right")


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(0x9E3779B97F4A7C15) + mix(w))


#: No word has this hash but by chance. It also stands before a text's first word.
END = mix(np.array([0xE17D], np.uint64))
_BASE = 0xD1342543DE82EF95
_POWERS = np.multiply.accumulate(np.r_[np.uint64(1), np.full(CHUNK_BYTES, _BASE, np.uint64)])
_INVERSE = np.multiply.accumulate(np.r_[np.uint64(1), np.full(CHUNK_BYTES, pow(_BASE, -1, 1 << 64), np.uint64)])
#: A number for each byte, the same for A-Z and a-z.
_OF_BYTE = mix(np.frombuffer(LOWER_AZ, np.uint8).astype(np.uint64) + np.uint64(1))
_SOLID = np.array([chr(b) not in ASCII_SPACES for b in range(256)])


def hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, A-Z as a-z: all of them, each text's END behind it, and
    where texts end. A word's hash is that of its bytes' sum, weighted by powers of a base."""
    texts = texts.cast(pa.large_string())
    _, at, raw = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    n = len(data)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = _SOLID[data]
    edge = np.zeros(n + 1, bool)  # before byte i a text begins
    edge[at] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    h = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        k = max(i + 1, int(np.searchsorted(ends, a + CHUNK_BYTES, "right")))
        if ends[i] - a <= CHUNK_BYTES:
            part = data[a : ends[k - 1]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_OF_BYTE[part] * _POWERS[: len(part)], out=sums[1:])
            s, e = starts[i:k] - a, ends[i:k] - a
            h[i:k] = (sums[e] - sums[s]) * _INVERSE[s] + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        i = k
    h = mix(h)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes().translate(LOWER_AZ))
    last = np.searchsorted(starts, at[1:]) + np.arange(1, len(at))
    out = np.empty(len(h) + len(texts), np.uint64)
    word = np.ones(len(out), bool)
    word[last - 1] = False
    out[word], out[last - 1] = h, END
    return out, last


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[pa.Array]:
    """Runs of texts of SLICE_BYTES or a text more."""
    for part in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        sizes = np.cumsum(np.array([0, *pc.binary_length(part).to_pylist()], np.int64))
        lo = 0
        while lo < len(part):
            hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + SLICE_BYTES)))
            yield part.slice(lo, hi - lo)
            lo = hi


def all_hashes(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """hashes(), slice by slice."""
    parts, ends, n = [], [], 0
    for s in slices(texts):
        h, e = hashes(s)
        parts.append(h)
        ends.append(e + n)
        n += len(h)
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([np.zeros(0, np.int64), *ends])


def previous(h: np.ndarray) -> np.ndarray:
    """The word before each, END before a text's first: ends stand in h already."""
    return np.concatenate([END, h[:-1]])


def pair_keys(h: np.ndarray, bits: int) -> np.ndarray:
    """region << 32 | the 32 bits that stand for a pair there, of every word with the one before."""
    return pair_hash(previous(h), h) >> np.uint64(32 - bits)


def by_region(keys: np.ndarray, shift: int, regions: int) -> np.ndarray:
    """Where the regions begin and end in sorted keys."""
    return np.r_[np.searchsorted(keys, np.arange(regions, dtype=np.uint64) << np.uint64(shift)), len(keys)]


def of_words(h: np.ndarray) -> np.ndarray:
    return mix(h ^ np.uint64(0xA0761D6478BD642F))


def of_pairs(low: np.ndarray) -> np.ndarray:
    return mix(low.astype(np.uint64) + np.uint64(0xE7037ED1A0B428DB))


def places(x: np.ndarray, level: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (n-gram, level): the 64-bit word of the filter, and what gives its bits there, 6 bits each."""
    y = mix(x + np.uint64(0xD6E8FEB86659FD93 * level & (1 << 64) - 1))
    return (((y >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32)).astype(np.int64), y & np.uint64(0xFFFFFFFF)


@dataclass
class Region:
    """A region of the filter and its words, in the order of their hashes, with exact counts."""

    bits: np.ndarray
    words: np.ndarray
    counts: np.ndarray

    @staticmethod
    def build(words: np.ndarray, word_counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray) -> Region:
        x = np.concatenate([of_words(words), of_pairs(pairs)])
        level = level_of(np.concatenate([word_counts, pair_counts]))
        size = -(-int(level.sum()) * BITS_PER_ENTRY // 64) + 1
        on = np.zeros(64 * size, np.uint8)
        for j in range(1, int(level.max(initial=0)) + 1):
            x, level = x[level >= j], level[level >= j]
            at, low = places(x, j, size)
            for i in range(PROBES):
                on[(at << 6) + (low >> np.uint64(6 * i) & np.uint64(63)).astype(np.int64)] = 1
        return Region(np.packbits(on, bitorder="little").view("<u8"), words, word_counts)

    def levels(self, x: np.ndarray) -> np.ndarray:
        """The level of each n-gram: probes until one is absent."""
        out, open_ = np.zeros(len(x), np.uint8), np.arange(len(x))
        for level in range(1, len(COUNT_OF)):
            at, low = places(x, level, len(self.bits))
            mask = np.uint64(1) << (low & np.uint64(63))
            for i in range(1, PROBES):
                mask |= np.uint64(1) << (low >> np.uint64(6 * i) & np.uint64(63))
            inside = self.bits[at] & mask == mask
            open_, x = open_[inside], x[inside]
            if not len(open_):
                break
            out[open_] = level
        return out

    def answer(self, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(exact counts of words, their levels, levels of pairs)."""
        exact = np.zeros(len(words), np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            exact = np.where(self.words[at] == words, self.counts[at], 0)
        return exact, self.levels(of_words(words)), self.levels(of_pairs(pairs))


NOTHING = Region(np.zeros(1, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
REGION = "region int, bits binary, words binary, counts binary, n_words long, n_tokens long"


def region_of(bits: bytes, words: bytes, counts: bytes) -> Region:
    return Region(np.frombuffer(bits, "<u8"), np.frombuffer(words, "<u8"), np.frombuffer(counts, "<i8"))


def region_bits(text_bytes: int) -> int:
    """How many leading bits of a hash name its region."""
    return min(MOST_REGION_BITS, max(LEAST_REGION_BITS, math.ceil(math.log2(max(1, text_bytes / REGION_BYTES)))))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def filter_regions(train: DataFrame, bits: int) -> DataFrame:
    """REGION of the n-grams of train (text). They are counted in each task, sent to their
    regions as packed arrays and added up there; regions without any are left out."""
    regions = 1 << bits

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(held)
        pairs, n = np.unique(pair_keys(h, bits), return_counts=True)
        words, c = np.unique(h, return_counts=True)
        del h
        w, p, rows = by_region(words, 64 - bits, regions), by_region(pairs, 32, regions), []
        for r in range(regions):
            own, k = pairs[p[r] : p[r + 1]].astype(np.uint32), n[p[r] : p[r + 1]]
            some = words[w[r] : w[r + 1]]
            if len(own) or len(some):
                rows.append((r, some.tobytes(), c[w[r] : w[r + 1]].astype(np.uint32).tobytes(), own[k == 1].tobytes(), own[k > 1].tobytes(), k[k > 1].astype(np.uint32).tobytes()))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(x, pa.binary()) for x in cols[1:]]], ["region", "words", "counts", "once", "more", "more_counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for s in slices(batch.column(0)):
                held.append(hashes(s)[0])
                n += len(held[-1])
                if n >= TASK_TOKENS:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    def add(group: pa.Table) -> pa.Table:
        join = lambda name, t: np.frombuffer(b"".join(group.column(name).to_pylist()), t)
        words, c = summed(join("words", np.uint64), join("counts", np.uint32).astype(np.int64))
        once, more = join("once", np.uint32), join("more", np.uint32)
        pairs, n = summed(np.concatenate([once, more]), np.concatenate([np.ones(len(once), np.int64), join("more_counts", np.uint32).astype(np.int64)]))
        made = Region.build(words, c, pairs, n)
        binary = lambda x: pa.array([x.tobytes()], pa.binary())
        return pa.table([group.column("region").slice(0, 1), binary(made.bits), binary(words), binary(c), pa.array([len(words)], pa.int64()), pa.array([int(c.sum())], pa.int64())], ["region", "bits", "words", "counts", "n_words", "n_tokens"])

    sent = train.select("text").mapInArrow(count, "region int, words binary, counts binary, once binary, more binary, more_counts binary")
    return sent.groupBy("region").applyInArrow(add, REGION)


def split_tokens(texts: pa.ChunkedArray, bits: int):
    """(ends, distinct words, which of them each token is, distinct pairs, which each token ends)."""
    h, ends = all_hashes(texts)
    pairs, pair = np.unique(pair_keys(h, bits), return_inverse=True)
    words, word = np.unique(h, return_inverse=True)
    return ends, words, word, pairs, pair


def ask_regions(blocks: DataFrame, table: DataFrame, bits: int) -> DataFrame:
    """block, region, exact, levels, pair_levels: what the regions answer to each block (block,
    doc_id, text, held_out) about its distinct n-grams, which stand in the order of their hashes."""
    regions = 1 << bits

    def ask(group: pa.Table) -> pa.Table:
        h, _ = all_hashes(group.column("text"))
        words, pairs = np.unique(h), np.unique(pair_keys(h, bits))
        w, p = by_region(words, 64 - bits, regions), by_region(pairs, 32, regions)
        there = np.flatnonzero((np.diff(w) > 0) | (np.diff(p) > 0))
        own = [words[w[r] : w[r + 1]].tobytes() for r in there.tolist()]
        low = [pairs[p[r] : p[r + 1]].astype(np.uint32).tobytes() for r in there.tolist()]
        block = pa.array(np.full(len(there), group.column("block")[0].as_py(), np.int64))
        return pa.table([block, pa.array(there.astype(np.int32)), pa.array(own, pa.binary()), pa.array(low, pa.binary())], ["block", "region", "words", "pairs"])

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        made = region_of(*[own.column(c)[0].as_py() for c in ("bits", "words", "counts")]) if own.num_rows else NOTHING
        out = [made.answer(np.frombuffer(w.as_py(), np.uint64), np.frombuffer(p.as_py(), np.uint32)) for w, p in zip(asked.column("words"), asked.column("pairs"), strict=True)]
        binary = [pa.array([x[k].tobytes() for x in out], pa.binary()) for k in range(3)]
        return pa.table([asked.column("block"), asked.column("region"), *binary], ["block", "region", "exact", "levels", "pair_levels"])

    asked = blocks.groupBy("block").applyInArrow(ask, "block long, region int, words binary, pairs binary")
    return asked.groupBy("region").cogroup(table.groupBy("region")).applyInArrow(answer, "block long, region int, exact binary, levels binary, pair_levels binary")


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all documents."""
    spark = docs.sparkSession
    both = documents(docs).withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % SPLIT == HELD_OUT)
    text_bytes = both.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = region_bits(text_bytes)
    regions = 1 << bits
    table = materialize(spark, filter_regions(both.where("not held_out"), bits), "ngrams")
    n_train, v, size = (x or 0 for x in table.agg(F.sum("n_tokens"), F.sum("n_words"), F.sum(F.length("bits") + F.length("words") + F.length("counts"))).first())
    total = n_train + v + 1

    def scores(doc_id, held_out, ends, word, exact, c1, pair, c2) -> pa.Table:
        """word, pair: which distinct one each token is; exact, c1, c2: of those."""
        starts = np.r_[0, ends[:-1]]
        end = word[ends[0] - 1]
        before = np.r_[end, word[:-1]]
        p1 = (c1 + 1) / total
        together = np.minimum(c2[pair], np.minimum(c1[before], c1[word]))
        p = np.log10((together + MU * p1[word]) / (c1[before] + MU))
        base = np.log10(exact + 1.0) - math.log10(total)
        n = pa.array((ends - starts).astype(np.int64))
        return pa.table(
            [doc_id, held_out, n, pa.array(np.add.reduceat((exact > 0).astype(np.int64)[word], starts)), pa.array(np.add.reduceat(base[word], starts)), pa.array(np.add.reduceat(p, starts))],
            ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({r.region: (bytes(r.bits), bytes(r.words), bytes(r.counts)) for r in table.toLocalIterator()})

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = {r: region_of(*x) for r, x in shared.value.items()}
            for batch in batches:
                lo = 0
                for s in slices(batch.column(1)):
                    ends, words, word, pairs, pair = split_tokens(s, bits)
                    w, p = by_region(words, 64 - bits, regions), by_region(pairs, 32, regions)
                    got = [made.get(r, NOTHING).answer(words[w[r] : w[r + 1]], pairs[p[r] : p[r + 1]].astype(np.uint32)) for r in range(regions)]
                    exact, c1, c2 = (np.concatenate([x[k] for x in got]) for k in range(3))
                    own = batch.slice(lo, len(s))
                    yield from scores(own.column(0), own.column(2), ends, word, exact, COUNT_OF[c1], pair, COUNT_OF[c2]).to_batches()
                    lo += len(s)

        out = both.mapInArrow(score, SCORED)
    else:

        def score_block(texts: pa.Table, answers: pa.Table) -> pa.Table:
            answers = answers.sort_by("region")
            join = lambda name, t: np.frombuffer(b"".join(answers.column(name).to_pylist()), t)
            exact, c1, c2 = join("exact", np.int64), COUNT_OF[join("levels", np.uint8)], COUNT_OF[join("pair_levels", np.uint8)]
            ends, _, word, _, pair = split_tokens(texts.column("text"), bits)
            return scores(texts.column("doc_id"), texts.column("held_out"), ends, word, exact, c1, pair, c2)

        n_blocks = max(1, -(-text_bytes // BLOCK_BYTES))
        # a row's place in the input deals it out, so that copies don't gather
        blocks = both.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).alias("block"), "doc_id", "text", "held_out")
        answers = ask_regions(blocks, table, bits)
        out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score_block, SCORED)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n_train)).cast("long").alias("train_tokens"), "base_score", "score")


def held_out_doc(doc_id: int | None) -> bool:
    """The split that score_documents() uses."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % SPLIT == HELD_OUT
