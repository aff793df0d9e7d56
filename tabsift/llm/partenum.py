"""Jaccard self-join of word-shingle sets by PartEnum signatures, as connected components.

Two sets within the similarity differ in at most k elements, k following from their sizes. Sizes fall into bands; an
instance joins a band with the one below it. An instance hashes the feature domain into ``n1`` partitions of ``n2`` parts:
a linked pair differs in at most ``k2`` elements of some partition, so it agrees on some choice of ``n2 - k2`` of its parts, and
the elements there make a signature that both sets have. ``n1`` leaves ``spare`` more such partitions than needed:
a set whose signatures of under ``WEAK`` elements lie in at most ``spare`` partitions leaves those signatures out (both sets
of a matching one see the same elements), which keeps empty and one-element signatures from gathering strangers.

Equal sets are merged first, and each gets a parity sketch (a lower bound of the difference). Signatures are dealt by hash and
streamed in order; what shares none is done. Of each bucket only its first set and the others' ids leave the task. Every set is
first compared with the bucket head that it meets most often, by sketch and then in whole; groups follow. Buckets that still hold several groups are looked through in chunks: sketches rule pairs out, groups that may touch give a few candidate pairs, whole sets decide, and
in three rounds: a few candidates for each group reached, more of them, and at last, in buckets where some proved too different,
every pair of two groups that the sketches leave. Members of one group are never paired.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, checked_broadcast, fields, joined_by_key, pieces_of, written
from .components import component_roots

SHINGLE_WORDS, PERCENT = 4, 85
#: A signature of fewer elements is weak.
WEAK = 2
#: Sets of one bucket that are looked through together, and sets up to which every pair of a bucket is.
CHUNK, SMALL = 4096, 8
#: Joined roots up to which a round's result is broadcast, and links up to which one task unites them.
MAX_BROADCAST_ROWS, TASK_LINKS = 200_000, 200_000
_U = np.uint64


# ---------------------------------------------------------------- sets
def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; fewer words make one, no words none."""
    import xxhash
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), size)[real]
    coded = pc.dictionary_encode(flat.filter(pa.array(real)))
    table = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    word = table[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else table
    count = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(count)
    hashed = _mix(word)
    for i in range(1, shingle):
        hashed = _mix(hashed[:max(len(word) - i, 0)] + word[i:] + _U(i))
    out = []
    for n, end in zip(count.tolist(), ends.tolist(), strict=True):
        if n >= shingle:
            out.append(np.unique(hashed[end - n:end - shingle + 1]))
        elif n:
            one = _mix(word[end - n:end - n + 1])
            for i in range(1, n):
                one = _mix(one + word[end - n + i] + _U(i))
            out.append(one)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    import xxhash
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), seed=len(hashes))).view(np.int64))


# ---------------------------------------------------------------- signatures
class Scheme(NamedTuple):
    n1: int
    n2: int
    k2: int
    spare: int


def scheme(k: int) -> Scheme:
    """The partitions for a difference of at most ``k``: n1 · (k2 + 1) > k + spare · (k2 + 1)."""
    if k <= 5:
        return Scheme(1, k + 2, k, 0)
    if k <= 8:
        return Scheme(k // 4 + 1, 5, 3, 0)
    base = k // 2 + 1
    spare = max(1, round(0.15 * base))
    return Scheme(base + spare, 2, 1, spare)


@functools.lru_cache(maxsize=8)
def _bands(percent: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last size of each band: sizes within the similarity lie in one band or two neighbouring ones."""
    first, last, at = [], [], 1
    while not last or last[-1] < upto:
        first.append(at)
        last.append(at * 100 // percent)
        at = last[-1] + 1
    return np.array(first), np.array(last)


def allowed(a, b, percent: int):
    """The largest difference of two sets of sizes a and b within the similarity."""
    return (a + b) * (100 - percent) // (100 + percent)


def signatures(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(signature, which set). A signature's lowest bit tells sets of an instance's lower band (1) from the upper (0)."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not len(sizes) or not sizes.max(initial=0):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first, last = _bands(percent, 1 << int(sizes.max() * 100 // percent + 2).bit_length())
    band = np.searchsorted(last, sizes)
    out_sig, out_set = [], []
    for lower in (0, 1):
        instance = band + lower
        k = allowed(last[instance], last[instance], percent)
        used = (sizes > 0) & (k > 0)
        if lower:  # some larger size must be within reach
            used &= sizes * 100 // percent >= first[instance]
        who = np.flatnonzero(used)
        for scheme_k in np.unique(k[who]).tolist():
            members = who[k[who] == scheme_k]
            sig, owner = _of_scheme([sets[i] for i in members.tolist()], instance[members], scheme(scheme_k))
            out_sig.append((sig & ~_U(1)) | _U(lower))
            out_set.append(members[owner])
    return np.concatenate(out_sig or [np.zeros(0, np.uint64)]), np.concatenate(out_set or [np.zeros(0, np.int64)])


def _of_scheme(sets: list[np.ndarray], instance: np.ndarray, how: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets that share a scheme (and which set each is of)."""
    parts = how.n1 * how.n2
    sizes = np.array([len(s) for s in sets])
    element = np.concatenate(sets)
    salt = _mix(instance.astype(np.uint64) + _U(1 << 40))
    part = _mix(element ^ np.repeat(salt, sizes)) % _U(parts)
    cell = np.repeat(np.arange(len(sets)) * parts, sizes) + part.astype(np.int64)
    count = np.bincount(cell, minlength=len(sets) * parts).reshape(-1, how.n2)
    total = np.zeros(len(sets) * parts, dtype=np.uint64)
    np.add.at(total, cell, _mix(element + _U(0x9E3779B97F4A7C15)))
    total = total.reshape(-1, how.n2)
    choices = list(combinations(range(how.n2), how.n2 - how.k2))
    held = np.stack([count[:, c].sum(axis=1) for c in choices], axis=1)
    digest = np.stack([total[:, c].sum(axis=1, dtype=np.uint64) for c in choices], axis=1)
    partition = np.tile(np.arange(how.n1, dtype=np.uint64), len(sets))
    tag = _mix((np.repeat(instance.astype(np.uint64), how.n1) << _U(32)) | partition)[:, None] + np.arange(len(choices), dtype=np.uint64)[None, :]
    weak = held < WEAK
    weak_partitions = weak.any(axis=1).reshape(len(sets), how.n1).sum(axis=1)
    kept = ~weak | np.repeat(weak_partitions > how.spare, how.n1)[:, None]
    owner = np.repeat(np.arange(len(sets)), how.n1)[:, None].repeat(len(choices), axis=1)
    return _mix(digest + _mix(tag))[kept], owner[kept]


# ---------------------------------------------------------------- sketches
def sketch_of(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Parities of the elements by the low bits of their hash, in 64-bit words. Two sketches differ in at most as many bits as
    the sets in elements; a sketch folded in half by exclusive or is the sketch of half the width."""
    bits = max(64, 1 << (16 * max(int(allowed(len(hashes), len(hashes), percent)), 1) - 1).bit_length())
    odd = np.bincount((_mix(hashes) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(sketches: list[np.ndarray]) -> np.ndarray:
    """Sketches of one width, the least of all, as rows."""
    least = min(len(s) for s in sketches)
    return np.stack([np.bitwise_xor.reduce(s.reshape(-1, least), axis=0) for s in sketches])


def near_pairs(ids: list, groups: list, sizes: list, sketches: list[bytes], known: list, percent: int) -> list[tuple[int, int]]:
    """Every candidate pair between the groups of a small bucket."""
    out, numbers = [], [int.from_bytes(s, "little") for s in sketches]
    for i, j in combinations(range(len(ids)), 2):
        a, b = sizes[i], sizes[j]
        if groups[i] == groups[j] or 100 * min(a, b) < percent * max(a, b) or (known[i] and ids[j] in known[i]):
            continue
        x, y, wide, narrow = numbers[i], numbers[j], len(sketches[i]) * 8, len(sketches[j]) * 8
        if wide < narrow:
            x, y, wide, narrow = y, x, narrow, wide
        while wide > narrow:
            wide //= 2
            x = (x >> wide) ^ (x & ((1 << wide) - 1))
        if (x ^ y).bit_count() <= allowed(a, b, percent):
            out.append((ids[i], ids[j]))
    return out


def touching(ids: np.ndarray, groups: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, known: list, most: int | None,
             percent: int) -> list[tuple[int, int]]:
    """Candidate pairs that would connect the groups of a chunk, up to ``most`` for each group reached; None: all between groups.

    Groups grow from one member at a time against the members not yet reached; ``known`` holds each member's partners that are
    known to be too different.
    """
    def near(q: int, at: np.ndarray) -> np.ndarray:
        low, high = np.minimum(sizes[at], sizes[q]), np.maximum(sizes[at], sizes[q])
        at = at[low * 100 >= high * percent]
        if len(at):
            differ = np.bitwise_count(sketches[at] ^ sketches[q]).sum(axis=1, dtype=np.int64)
            at = at[differ <= allowed(sizes[at], sizes[q], percent)]
        return at[~np.isin(ids[at], np.array(known[q]))] if known[q] and len(at) else at

    if most is None:
        each = np.arange(len(ids))
        return [(int(ids[q]), int(ids[m])) for q in range(len(ids)) for m in near(q, each[q + 1:][groups[q + 1:] != groups[q]]).tolist()]
    left, out = np.ones(len(ids), dtype=bool), []
    while left.any():
        start = groups[np.argmax(left)]
        queue = np.flatnonzero(groups == start).tolist()
        left[queue] = False
        while queue and left.any():
            q = queue.pop()
            at = near(q, np.flatnonzero(left))
            for g in np.unique(groups[at]).tolist():
                out += [(int(ids[q]), int(ids[m])) for m in at[groups[at] == g][:most].tolist()]
                reached = np.flatnonzero(left & (groups == g))
                left[reached] = False
                queue += reached.tolist()
    return out


# ---------------------------------------------------------------- the join
def _set_rows(docs: DataFrame, text: str, doc_id: str, shingle: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, id (null without words) and sketch (null where the task has met the set before) of every row."""
    schema = T.StructType([*fields(docs, doc_id), T.StructField("n_shingles", T.LongType()), T.StructField("id", T.LongType()), T.StructField("sketch", T.BinaryType())])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces_of(batches, text):
            sets = shingle_sets(batch.column(text), shingle)
            names = [set_id(s) if len(s) else None for s in sets]
            sketches = []
            for s, name in zip(sets, names, strict=True):
                sketches.append(None if name is None or name in seen else sketch_of(s, percent).tobytes())
                seen.add(name)
            yield pa.RecordBatch.from_arrays([batch.column(doc_id).cast(arrow.field(0).type), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array(names, pa.int64()), pa.array(sketches, pa.binary())], schema=arrow)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def _signature_rows(docs: DataFrame, text: str, shingle: int, percent: int) -> DataFrame:
    """(sig, id) of every set; a set that a task meets again is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces_of(batches, text):
            sets, names = [], []
            for s in shingle_sets(batch.column(text), shingle):
                if len(s) and (name := set_id(s)) not in seen:
                    seen.add(name)
                    sets.append(s)
                    names.append(name)
            sig, owner = signatures(sets, percent)
            named = np.array(names, dtype=np.int64)
            for at in range(0, len(sig), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(sig[at:at + (1 << 16)].view(np.int64)), pa.array(named[owner[at:at + (1 << 16)]])], ["sig", "id"])

    return docs.select(text).mapInArrow(run, "sig long, id long")


def _shared_buckets(rows: DataFrame, chunk: int) -> DataFrame:
    """(bucket, chunk, id, head) of every bucket with two sets or more, one of the upper band; its head is the first in order.

    Rows come sorted and leave as they come; a bucket's head is emitted with the second row, so nothing is held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_sig, last_id, head, head_sig, place = None, None, 0, 1, 0
        for batch in batches:
            sig, name = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "id"))
            fresh = np.r_[True, (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])] if len(sig) else np.zeros(0, bool)
            if len(sig) and last_sig is not None and sig[0] == last_sig and name[0] == last_id:
                fresh[0] = False
            sig, name = sig[fresh], name[fresh]
            if not len(sig):
                continue
            bucket = sig >> 1
            new = np.r_[last_sig is None or bucket[0] != last_sig >> 1, bucket[1:] != bucket[:-1]]
            starts = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1  # -1: the bucket goes on from the last batch
            heads, head_sigs = np.r_[name[starts], head], np.r_[sig[starts], head_sig]  # index -1 is the one that goes on
            begin = np.r_[starts, -place - 1] if not new[0] else np.r_[starts, 0]
            at = np.arange(len(sig)) - begin[run_of]
            own_head, upper = heads[run_of], (head_sigs[run_of] & 1) == 0
            kept = upper & (at > 0)
            second = kept & (at == 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[bucket[kept], bucket[second]]), pa.array(np.r_[at[kept] // chunk, np.zeros(second.sum(), np.int64)]),
                 pa.array(np.r_[name[kept], own_head[second]]), pa.array(np.r_[own_head[kept], own_head[second]])], ["bucket", "chunk", "id", "head"])
            last_sig, last_id, place = sig[-1], name[-1], int(at[-1])
            head, head_sig = own_head[-1], head_sigs[run_of[-1]]

    dealt = rows.repartition(F.shiftright("sig", 1)).sortWithinPartitions("sig", "id")
    return dealt.mapInArrow(run, "bucket long, chunk long, id long, head long")


def _whole_sets(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str, shingle: int) -> DataFrame:
    """(id, hashes) of the sets in ``wanted`` (id and the least doc_id that has it), read from that document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces_of(batches, text):
            ids, whole = [], []
            for s, want in zip(shingle_sets(batch.column(text), shingle), batch.column("want_").to_pylist(), strict=True):
                name = set_id(s) if len(s) else None
                if name is not None and (want is None or name == want) and name not in seen:
                    seen.add(name)
                    ids.append(name)
                    whole.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(whole, pa.binary())], ["id", "hashes"])

    schema = "id long, hashes binary"
    have = wanted.filter(F.col("least").isNotNull()).select(F.col("least").alias(doc_id), F.col("id").alias("want_"))
    have = checked_broadcast(have, wanted.count(), MAX_BROADCAST_ROWS)  # more: the texts are shuffled once
    sets = docs.select(doc_id, text).join(have, doc_id).select(text, "want_").mapInArrow(run, schema)
    nameless = wanted.filter(F.col("least").isNull()).select("id")
    if nameless.limit(1).count():  # sets that only rows without an id have
        rows = docs.filter(F.col(doc_id).isNull()).select(text, F.lit(None).cast("long").alias("want_")).mapInArrow(run, schema)
        sets = sets.unionByName(rows.join(nameless, "id", "left_semi"))
    return written(sets, "whole-sets")


def _streamed(pairs: DataFrame, table: DataFrame, holds, name: str) -> DataFrame:
    """``pairs`` (a, b) and ``linked``: what ``holds`` says of the two rows' ``data`` in ``table`` (id, data). Rows b that many pairs
    share are dealt with a salt: b travels once for each salt, then the rows a stream past it."""
    salts = max(16, pairs.count() >> 16)
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)))
    fixed = salted.select("b", "salt").distinct().join(table.select(F.col("id").alias("b"), "data"), "b").select("b", "salt", F.lit(None).cast("long").alias("a"), "data")
    moving = salted.join(table.select(F.col("id").alias("a"), "data"), "a").select("b", "salt", "a", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        against = b""
        for batch in batches:
            a, b, linked = [], [], []
            for one, other, raw in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("data"), strict=True):
                if one is None:
                    against = raw.as_py()
                    continue
                a.append(one)
                b.append(other)
                linked.append(holds(raw.as_buffer(), against))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    rows = fixed.unionByName(moving).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return written(rows.mapInArrow(run, "a long, b long, linked boolean"), name)


def _decided(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) and whether they link, by whole sets."""
    def holds(one, other) -> bool:
        hashes, against = np.frombuffer(one, dtype="<u8"), np.frombuffer(other, dtype="<u8")
        place = np.searchsorted(against, hashes)
        place[place == len(against)] = 0
        both = int(np.count_nonzero(against[place] == hashes))
        return 100 * both >= percent * (len(against) + len(hashes) - both)

    return _streamed(pairs, sets.withColumnRenamed("hashes", "data"), holds, "decided")


def _sieved(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` that the sketches leave possible."""
    def holds(one, other) -> bool:
        one, other = bytes(one), bytes(other)
        a, b = (int.from_bytes(x[:8], "big") for x in (one, other))
        return bool(near_pairs([0, 1], [0, 1], [a, b], [one[8:], other[8:]], [None, None], percent))

    size = F.unhex(F.lpad(F.hex("size"), 16, "0"))  # eight bytes in front of the sketch
    left = _streamed(pairs, sketches.select("id", F.concat(size, "sketch").alias("data")), holds, "sieved")
    return left.filter("linked").select("a", "b")


def _touching_pairs(members: DataFrame, roots: DataFrame, sketches: DataFrame, apart: DataFrame | None, most: int | None, percent: int) -> DataFrame:
    """(bucket, a, b): candidate pairs between groups that share a bucket; buckets with the same members are looked at once."""
    grouped = written(members.join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
                      .select("bucket", "chunk", "id", F.coalesce("root", "id").alias("grp")), "grouped")
    mark = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    several = (grouped.groupBy("bucket").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.max("chunk").alias("top"), F.count(F.lit(1)).alias("n"), *mark)
               .filter("low <> high").groupBy("n", "x1", "x2").agg(F.min("bucket").alias("bucket"), F.max("top").alias("top")).select("bucket", "top"))
    chunks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("top")), lambda t: F.struct(F.least(t, F.col("chunk")).alias("i"), F.greatest(t, F.col("chunk")).alias("j")))
    rows = grouped.join(several, "bucket").join(sketches, "id")
    if apart is not None:
        both = apart.select(F.col("a").alias("id"), F.col("b").alias("o")).unionByName(apart.select(F.col("b").alias("id"), F.col("a").alias("o")))
        rows = rows.join(both.groupBy("id").agg(F.collect_set("o").alias("known")), "id", "left")
    else:
        rows = rows.withColumn("known", F.lit(None).cast("array<long>"))
    rows = rows.withColumn("p", F.explode(chunks)).select("bucket", "p.i", "p.j", "id", "grp", "size", "sketch", "known")
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")
    pairs = dealt.mapInArrow(_bucket_reader(most, percent), "bucket long, a long, b long")
    return written(pairs.select("bucket", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "touching")


def _bucket_reader(most: int | None, percent: int):
    """Reads rows sorted by bucket and chunk pair, and looks through one such group after the other."""
    def found(part: dict) -> list[tuple[int, int]]:
        first = {}
        for at, name in enumerate(part["id"]):
            first.setdefault(name, at)  # a set may have been read twice
        ids, groups, sizes, sketches, known = ([part[c][i] for i in first.values()] for c in ("id", "grp", "size", "sketch", "known"))
        if len(ids) <= SMALL:
            return near_pairs(ids, groups, sizes, sketches, known, percent)
        rows = folded([np.frombuffer(x, "<u8") for x in sketches])
        return touching(np.array(ids), np.array(groups), np.array(sizes), rows, known, most, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        place, names = None, ("id", "grp", "size", "sketch", "known")
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "i", "j")]
            new = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]).tolist() if batch.num_rows else []
            columns, out = {c: batch.column(c).to_pylist() for c in names}, []
            for a, b in zip(new, [*new[1:], batch.num_rows], strict=True):
                here = tuple(int(k[a]) for k in keys)
                if here == place:
                    for c in names:
                        held[c] += columns[c][a:b]
                    continue
                if place is not None:
                    out += [(place[0], *p) for p in found(held)]
                place, held = here, {c: columns[c][a:b] for c in names}
            yield _triples(out)
        if place is not None:
            yield _triples([(place[0], *p) for p in found(held)])

    return run


def _triples(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["bucket", "a", "b"])


def _roots(links: DataFrame) -> DataFrame:
    """(node, root) of a written link table: up to ``TASK_LINKS`` links are united in one task, more by rounds of joins."""
    if links.count() > TASK_LINKS:
        return component_roots(links)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(n: int) -> int:
            while up.setdefault(n, n) != n:
                up[n] = up[up[n]]
                n = up[n]
            return n

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], ["node", "root"])

    return links.coalesce(1).mapInArrow(unite, "node long, root long")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further links: only the roots that they join are contracted."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}r"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ar", "a").alias("a"), F.coalesce("br", "b").alias("b"))
    up = written(_roots(written(ends, "joined-ends")), "joined-roots")
    up = checked_broadcast(up, up.count(), MAX_BROADCAST_ROWS)
    moved = roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    fresh = up.join(roots.select("node"), "node", "left_anti").select("node", "root")
    return written(moved.unionByName(fresh), "roots")


def set_roots(docs: DataFrame, classes: DataFrame, sketches: DataFrame, shingle: int = SHINGLE_WORDS, percent: int = PERCENT, text: str = "text",
              doc_id: str = "doc_id", chunk: int = CHUNK) -> DataFrame | None:
    """(node, root) of the set ids that have a link; sets of one component share a root. None where no sets meet.

    Whole sets are read only for pairs that the sketches leave possible. After each round only buckets with a candidate pair
    that proved too different are looked at again: in the others every two groups that touch have been joined. The last round
    decides every pair of groups that the sketches leave there.
    """
    members = written(_shared_buckets(_signature_rows(docs, text, shingle, percent), chunk), "members")
    often = members.filter("id <> head").groupBy("id", "head").agg(F.count(F.lit(1)).alias("n"))
    pairs = often.groupBy("id").agg(F.max(F.struct("n", "head")).alias("m")).select(F.col("id").alias("a"), F.col("m.head").alias("b"))
    pairs = written(pairs, "head-pairs")
    if not pairs.limit(1).count():
        return None
    sets = None

    def decided_by_sets(some: DataFrame) -> DataFrame:
        nonlocal sets
        needed = some.select(F.col("a").alias("id")).unionByName(some.select(F.col("b").alias("id"))).distinct()
        if sets is not None:
            needed = needed.join(sets.select("id"), "id", "left_anti")
        wanted = written(classes.select("id", "least").join(needed, "id", "left_semi"), "wanted-sets")
        more = _whole_sets(docs, wanted, text, doc_id, shingle)
        sets = more if sets is None else sets.unionByName(more)
        return _decided(some, sets, percent)

    decided = decided_by_sets(written(_sieved(pairs, sketches, percent), "near-heads"))
    roots = written(_roots(decided.filter("linked").select("a", "b")), "roots")
    apart = decided.filter("not linked").select("a", "b")
    for most in (4, 64, None):
        found = _touching_pairs(members, roots, sketches, apart, most, percent)
        candidates = written(found.select("a", "b").distinct(), "candidates")
        if not candidates.limit(1).count():
            break
        decided = decided_by_sets(candidates)
        roots = _merged(roots, decided.filter("linked").select("a", "b"))
        wrong = decided.filter("not linked").select("a", "b").distinct()
        again = written(found.join(wrong, ["a", "b"]).select("bucket").distinct(), "again")
        if most is None or not again.limit(1).count():
            break
        members = written(members.join(again, "bucket", "left_semi"), "members")
        apart = written(apart.unionByName(wrong), "apart")
    return roots


def joined_sets(docs: DataFrame, shingle: int = SHINGLE_WORDS, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id",
                chunk: int = CHUNK, hot_share: int = 1000) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row.

    Documents link when 100 · |common shingles| >= percent · |all shingles|, over sets of distinct shingles of ``shingle``
    words, ASCII lower-cased. Fewer words make one shingle; null and empty texts and white space have none and stay alone.
    A null doc_id keeps its row, links others, and names no component (alone or among its like: null). Repeated rows stay,
    each with the same answer. Columns other than doc_id and text are not read; an empty table gives an empty result.
    Shingles and sets go by 64-bit hashes: two different sets count as one with probability under n² / 2⁶⁵.
    """
    name, docs = doc_id, docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    doc_id, text = "doc", "text"
    rows = written(_set_rows(docs, text, doc_id, shingle, percent), "sets")
    sketches = rows.filter(F.col("sketch").isNotNull()).select("id", F.col("n_shingles").alias("size"), "sketch")
    worded = rows.filter(F.col("id").isNotNull()).drop("sketch")
    classes = written(worded.groupBy("id").agg(F.min(doc_id).alias("least"), F.count(F.lit(1)).alias("rows_")), "classes")
    roots = set_roots(docs, classes, sketches, shingle, percent, text, doc_id, chunk)
    if roots is None:
        named = classes.select("id", "rows_", F.col("least").alias("component_id"))
    else:
        roots = roots.select(F.col("node").alias("id"), "root")
        rooted = written(classes.join(roots, "id"), "rooted")
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("rows_"))
        grouped = joined_by_key(rooted.select("id", F.col("rows_").alias("copies"), "root"), written(least, "least"), "root", hot_share)
        alone = classes.join(roots, "id", "left_anti").select("id", F.col("rows_").alias("copies"), F.col("least").alias("component_id"))
        named = grouped.select("id", "copies", "component_id").unionByName(alone).withColumnRenamed("copies", "rows_")
    out = joined_by_key(worded, written(named, "named"), "id", hot_share).select(doc_id, "n_shingles", "component_id")
    out = out.unionByName(rows.filter(F.col("id").isNull()).select(doc_id, "n_shingles", F.col(doc_id).alias("component_id")))
    return out.withColumnRenamed(doc_id, name)

