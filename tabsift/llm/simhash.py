"""SimHash near-duplicates by multi-index hashing.

Every whole text gets a 64-bit fingerprint. Equal fingerprints are merged first. The 64 bits are cut into segments with
one table entry per fingerprint and segment value; a fingerprint also asks for the values in a small Hamming ball
around its own. With radii r_i whose sum of (r_i + 1) is the distance + 1, two fingerprints within the distance must be
that near in some segment, so every link shares a bucket; complete distances are then checked there. Of each flip set
only the fingerprint asks whose lowest flipped bit is 0, so a link is asked for once.

Inside a bucket no pairs are listed: linked groups are grown from one member at a time against the members not yet
reached, and a group leaves as a star. A bucket over ``MAX_BUCKET`` fingerprints is cut into chunks, and each two chunks
meet in a task of their own, so every task is bounded and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batch_of, fields, joined_by_key, pieces_of, written
from .components import component_roots

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
#: Distinct fingerprints up to which three segments are used; beyond, two wider ones with larger balls. Results are equal.
THREE_SEGMENTS = 1 << 27
#: Fingerprints of one bucket that a task compares at most.
MAX_BUCKET = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a whole text; 0 without words."""
    import xxhash
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    k = min(shingle, len(words))
    starts = (ends - sizes)[:len(words) - k + 1]
    parts = [joined[a:b] for a, b in zip(starts.tolist(), ends[k - 1:].tolist(), strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), dtype="<u8", count=len(parts))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    schema = T.StructType([*fields(docs, doc_id), T.StructField("fp", T.LongType())])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, text):
            values = np.array([fingerprint(v, shingle) for v in batch.column(text).to_pylist()], dtype=np.uint64)
            yield batch_of(arrow, {doc_id: batch.column(doc_id), "fp": values.view(np.int64)})

    return docs.select(doc_id, text).mapInArrow(run, schema)


def _with_fingerprint(docs: DataFrame, shingle: int, text: str, name: str) -> DataFrame:
    """``docs`` and the column ``name`` with the fingerprint of each row."""
    schema = T.StructType([*docs.schema, T.StructField(name, T.LongType())])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, text):
            values = np.array([fingerprint(v, shingle) for v in batch.column(text).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)), pa.array(values.view(np.int64))], schema=arrow)

    return docs.mapInArrow(run, schema)


def segment_plan(segments: int, max_bits: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of each segment; radii add up so that no link within ``max_bits`` is missed."""
    segments = min(segments, max_bits + 1)
    spare, plan, at = max_bits + 1 - segments, [], 0
    for i in range(segments):
        width = 64 // segments + (i >= segments - 64 % segments)
        plan.append((at, width, spare // segments + (i < spare % segments)))
        at += width
    return plan


def asked_keys(fps: np.ndarray, plan: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket key, fingerprint) rows: a table entry per segment, and the half balls around it."""
    keys, who = [], []
    for number, (at, width, radius) in enumerate(plan):
        value = (fps >> np.uint64(at)) & np.uint64((1 << width) - 1)
        tag = np.uint64(number << 33)
        keys.append(value | tag)
        who.append(fps)
        for r in range(1, radius + 1):
            for bits in combinations(range(width), r):
                zero = (value >> np.uint64(bits[0])) & np.uint64(1) == 0
                keys.append((value[zero] ^ np.uint64(sum(1 << b for b in bits))) | tag)
                who.append(fps[zero])
    return np.concatenate(keys).view(np.int64), np.concatenate(who)


def bucket_links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Star links of the linked groups in a bucket: each member is compared with the members not yet reached only."""
    fps = np.unique(fps)
    out: list[tuple[int, int]] = []
    left = fps
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= max_bits
            if near.any():
                reached, left = left[near], left[~near]
                out += zip(repeat(int(root)), reached.tolist())
                queue.extend(reached)
    return out


def _sorted_links(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in the buckets of sorted rows: small buckets by shifted comparison, larger ones group by group."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    large = sizes > 8
    small = np.repeat(~large & (sizes > 1), sizes)
    k, f = key[small], fp[small]
    a, b = [], []
    for d in range(1, 8):
        if len(k) > d:
            hit = (k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= max_bits) & (f[d:] != f[:-d])
            a.append(f[:-d][hit])
            b.append(f[d:][hit])
    for at, n in zip(starts[large].tolist(), sizes[large].tolist(), strict=True):
        if found := bucket_links(fp[at:at + n], max_bits):
            pairs = np.array(found, dtype=np.uint64)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def linked_fingerprints(distinct: DataFrame, max_bits: int = MAX_BITS, segments: int | None = None,
                        max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b) long: links that connect every group of distinct fingerprints (column fp) within ``max_bits``."""
    if segments is None:
        segments = 3 if distinct.count() <= THREE_SEGMENTS else 2
    plan = segment_plan(segments, max_bits)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.column("fp").slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                key, fp = asked_keys(part, plan)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64))], ["key", "fp"])

    asked = distinct.select("fp").mapInArrow(ask, "key long, fp long")
    sizes = asked.groupBy("key").count().filter(F.col("count") > max_bucket)
    hot = written(sizes.select("key", F.ceil(F.col("count") / max_bucket).alias("chunks")), "hot-buckets")
    if hot.count():  # every two chunks of a hot bucket meet
        chunk = F.pmod(F.xxhash64("fp"), F.col("chunks"))
        spread = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                             lambda t: F.struct(F.least(t, chunk).alias("i"), F.greatest(t, chunk).alias("j")))
        asked = (asked.join(hot, "key", "left")
                 .withColumn("p", F.explode(F.when(F.col("chunks").isNotNull(), spread)
                                            .otherwise(F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))))))
                 .select(F.xxhash64("key", "p.i", "p.j").alias("key"), "fp"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def found(k, f):
            a, b = _sorted_links(k, f, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(key) and key[0] != key[-1]:  # the last bucket may go on
                cut = int(np.searchsorted(key, key[-1]))
                yield found(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield found(key, fp)

    return asked.repartition("key").sortWithinPartitions("key").mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, text: str = "text",
                    doc_id: str = "doc_id", segments: int | None = None, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable over links).

    Texts without words (null, empty, white space) have fingerprint zero and link like any other. A null doc_id keeps
    its row but names no component (its component_id is null if no member has an id). Repeated rows stay, each with the
    same answer. Columns other than doc_id and text are not read; an empty table gives an empty result.
    """
    return (_grouped(docs, shingle, max_bits, text, doc_id, segments, max_bucket)
            .select(doc_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def _grouped(docs: DataFrame, shingle: int, max_bits: int, text: str, doc_id: str, segments: int | None = None,
             max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, fp, component_id and root (one fingerprint for each component) of every row."""
    found = written(fingerprints(docs, shingle, text, doc_id), "fingerprints")
    distinct = written(found.groupBy("fp").agg(F.min(doc_id).alias("least"), F.count(F.lit(1)).alias("rows_")), "distinct-fingerprints")
    roots = component_roots(linked_fingerprints(distinct, max_bits, segments, max_bucket))
    rooted = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted.withColumnRenamed("rows_", "copies"), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("rows_")), "least-ids")
    named = joined_by_key(rooted, least, "root").select("fp", "component_id", "root", F.col("copies").alias("rows_"))
    return joined_by_key(found, written(named, "named"), "fp").select(doc_id, "fp", "component_id", "root")


def representatives(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, text: str = "text",
                    doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one whose doc_id names the group.

    Rows of one doc_id in one group are one document, of which the row with the least text stays; rows of one doc_id in
    several groups are judged each by its own. Rows without a doc_id cannot stand for a group and are never removed.
    """
    found = _grouped(docs, shingle, max_bits, text, doc_id).filter(F.col(doc_id).isNotNull())
    ids = written(found.groupBy(doc_id).agg(F.max(F.col(doc_id) == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("rows")),
                  "near-duplicates")
    gone = written(ids.filter("not stays").select(doc_id), "removed-ids")  # far fewer than those that stay
    kept = docs.join(gone, doc_id, "left_anti").select(*docs.columns)
    repeated = ids.filter("stays and rows > 1").select(doc_id)
    if repeated.limit(1).count():
        repeated = written(repeated, "repeated-ids")
        name = "row"
        while {name, f"{name}_fp", f"{name}_root"} & set(docs.columns):
            name += "_"
        own = (found.filter(F.col(doc_id) == F.col("component_id")).join(repeated, doc_id, "left_semi")
               .select(F.col(doc_id), F.col("fp").alias(f"{name}_fp"), F.col("root").alias(f"{name}_root")).distinct())
        rows = _with_fingerprint(docs.join(repeated, doc_id, "left_semi").select(*docs.columns), shingle, text, f"{name}_fp")
        order = (Window.partitionBy(doc_id, f"{name}_root")
                 .orderBy(F.col(text).asc_nulls_last(), *(F.col(c) for c in docs.columns if c not in (doc_id, text))))
        first = rows.join(own, [doc_id, f"{name}_fp"]).withColumn(name, F.row_number().over(order)).filter(F.col(name) == 1)
        kept = kept.join(repeated, doc_id, "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))
    return kept
