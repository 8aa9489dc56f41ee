"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits, one per bit position of the shingles' XXH64. Two
fingerprints at 4 or fewer differing bits agree, but for one bit at most, in one of
three segments. Each distinct fingerprint is indexed under every segment with one
bit left out, and under the whole segments; an equality join on these keys meets
every linked pair, and exact bit counts verify it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from polysense.llm.common import EDGE, Forest, batch_of, byte_texts, components, edge_batch, rows_of
from polysense.sources.store import materialize

#: first bit and width of the segments; with one more segment than half the distance, one differs by a bit at most
SEGMENTS = ((0, 22), (22, 21), (43, 21))
KEY_BITS = 22
MAX_DISTANCE = 4
SHINGLE_WORDS = 4
HASH_SEED = 42
#: keys with more fingerprints than this are compared in blocks, one task per pair of blocks
BLOCK = 4096
_CHUNK = 1 << 16


def fingerprint(text: bytes, k: int = SHINGLE_WORDS) -> int:
    """Majority bits of the hashes of all ``k``-word shingles; 0 for a text without words."""
    words = text.lower().split()  # bytes: only A-Z are lowered, words end at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(words))
    pairs = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    hashed = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    values = np.fromiter((hashed(joined[s:e], HASH_SEED) for s, e in pairs), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = values[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little").view(np.int64)
    return int(bits[0])


_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _fingerprints(k: int, schema: pa.Schema = _FP):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(schema, batch.column(0).cast(pa.int64()), [fingerprint(t, k) for t in byte_texts(batch.column(1))], *batch.columns[2:])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, **beside: str) -> DataFrame:
    """``(doc_id, fp)`` per row; null and wordless texts have fingerprint 0. Repeated rows stay.

    ``beside`` names bigint columns that are carried along.
    """
    schema = pa.schema([*_FP, *[(name, pa.int64()) for name in beside]])
    return rows_of(docs, doc_id=id_col, text=text_col, **beside).mapInArrow(
        _fingerprints(k, schema), ", ".join(f"{name} long" for name in schema.names))


def _variant_keys(fp: str) -> Column:
    """All index keys: variant number above the segment's bits, the left-out bit cleared."""
    keys, number = [], 0
    for first, width in SEGMENTS:
        for bit in (None, *range(width)):
            mask = (1 << width) - 1 - (0 if bit is None else 1 << bit)
            keys.append(f"cast(((shiftrightunsigned({fp}, {first}) & {mask}L) | {number << KEY_BITS}L) AS int)")
            number += 1
    return F.expr(f"array({', '.join(keys)})")


def _link_runs(key: np.ndarray, fp: np.ndarray, max_distance: int, forest: Forest) -> None:
    """Link rows of equal key; ``key`` is sorted. Steps through distances in the order, all runs at once."""
    single = np.ones(len(key), bool)
    same = key[1:] == key[:-1]
    single[1:] &= ~same
    single[:-1] &= ~same
    key, fp = key[~single], fp[~single]
    if not len(key):
        return
    names, at = np.unique(fp, return_inverse=True)
    label = np.arange(len(names))
    left = np.arange(len(key) - 1)
    gap = 1
    while len(left := left[left + gap < len(key)]) and len(left := left[key[left] == key[left + gap]]):
        a, b = at[left], at[left + gap]
        near = np.bitwise_count((names[a] ^ names[b]).view(np.uint64)) <= max_distance
        a, b = a[near], b[near]
        fresh = np.flatnonzero(label[a] != label[b])
        if len(fresh):
            _, first = np.unique(label[a[fresh]] * len(names) + label[b[fresh]], return_index=True)
            merged = Forest()
            for i in fresh[first].tolist():
                forest.join(int(names[a[i]]), int(names[b[i]]))
                merged.join(int(label[a[i]]), int(label[b[i]]))
            renamed = np.arange(len(names))
            for x in list(merged.parent):
                renamed[x] = merged.find(x)
            label = renamed[label]
        gap += 1


def _verify(max_distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows, forest = 0, Forest()

        def flush(last: bool):
            nonlocal held, rows, forest
            key, fp = (np.concatenate(x) for x in zip(*held))
            cut = len(key) if last else int(np.searchsorted(key, key[-1]))
            _link_runs(key[:cut], fp[:cut], max_distance, forest)
            held, rows = [(key[cut:], fp[cut:])], len(key) - cut

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows > 1 << 18:
                flush(False)
            if len(forest.a) > 200_000:
                yield edge_batch(forest.a, forest.b)
                forest = Forest()
        if held:
            flush(True)
        yield edge_batch(forest.a, forest.b)
    return run


def near_links(nodes: DataFrame, max_distance: int = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges ``(u, v)`` that span every class of the distinct fingerprints ``nodes(fp)``.

    No pair of a dense class is lost for the classes, but only spanning edges leave a
    task. A key above ``block`` fingerprints is cut into blocks that meet pairwise.
    """
    rows = nodes.select("fp", F.explode(_variant_keys("fp")).alias("key"))
    heads = [sum(1 + w for _, w in SEGMENTS[:i]) for i in range(len(SEGMENTS))]
    whole = rows.filter(F.shiftrightunsigned(F.col("key"), KEY_BITS).isin(heads))
    hot = materialize(whole.groupBy("key").count().filter(F.col("count") > block), "hotkeys")
    cell = F.col("key").cast("bigint")
    if not hot.isEmpty():
        number, value = F.shiftrightunsigned(F.col("key"), KEY_BITS), F.col("key").bitwiseAND(F.lit((1 << KEY_BITS) - 1))
        widths = F.element_at(F.create_map(*[F.lit(x) for i, h in enumerate(heads) for x in (h, SEGMENTS[i][1])]), number)
        spread = hot.select("count", F.explode(F.transform(
            F.sequence(F.lit(-1), widths - 1),
            lambda b: F.when(b < 0, F.col("key")).otherwise(
                F.shiftleft(number + 1 + b, KEY_BITS).bitwiseOR(value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1), b))))),
        )).alias("key"))
        blocks = spread.groupBy("key").agg(F.ceil(F.sum("count") * 2 / block).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        met = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda o: (F.least(o, own) * F.col("blocks") + F.greatest(o, own)).cast("bigint"))))
        rows = rows.join(blocks, "key", "left").select("fp", "key", met.alias("cell"))
        cell = F.xxhash64("key", "cell")  # cells that share a number are compared as one: more work, same links
    return (rows.select(cell.alias("key"), "fp").repartition("key").sortWithinPartitions("key")
            .mapInArrow(_verify(max_distance), EDGE))


def _rooted(nodes: DataFrame, max_distance: int) -> DataFrame:
    """``nodes`` of distinct fingerprints with ``root``, the same in every node of a component and in no other."""
    if max_distance > 2 * len(SEGMENTS) - 1:
        raise ValueError("the segments guarantee distances up to 5")
    roots = components(near_links(nodes.select("fp"), max_distance))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
                    max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    Texts whose fingerprints differ in ``max_distance`` or fewer bits are linked;
    ``component_id`` is the smallest id that links reach. Equal texts and repeated rows
    share a fingerprint and a component. A null id never names a component, unless
    no member has an id (then it is null). An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, k), "fingerprints")
    rooted = _rooted(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), max_distance)
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.join(names, "root").select("fp", "component_id")
    return fps.join(labels, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _placed(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """``docs`` with what tells each of its rows apart: its file and its number there.

    A table that is not read from files is written first.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta["row_index"]).schema
    except AnalysisException:
        docs = materialize(docs, "rows")
        meta = docs.metadataColumn("_metadata")
    return docs, F.xxhash64(meta["file_path"]), meta["row_index"]


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
                      max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row of ``docs`` for each component of ``near_duplicates``, with all its columns.

    It is the row of the smallest id, and one without an id only if no member has one.
    Rows of an id are told apart by a digest of their plain columns, then by their place
    (file and row number), which tells rows apart that are equal in all of them. Only
    the places of the rows that go are joined back: while those are few they are broadcast
    and no text is shuffled.
    """
    docs, file, row = _placed(docs)
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(*plain).alias("digest"), file.alias("file"), row.alias("row"))
    fps = materialize(fingerprints(rows, "id", "text", k, digest="digest", file="file", row="row"), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "file", "row")
    rooted = _rooted(fps.groupBy("fp").agg(F.min(order).alias("first")), max_distance)
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    heads = materialize(rooted.select("fp", "root", "first").join(best, "root").select(
        "fp", F.when(F.col("first") == F.col("best"), F.col("best")).alias("kept")), "heads")
    mine = F.struct(F.col("file").alias("f"), F.col("row").alias("r"))
    keeps = F.coalesce(mine == F.struct("kept.file", "kept.row"), F.lit(False))
    gone = materialize(fps.join(heads, "fp").filter(~keeps).select(F.col("file").alias("_gone_file"), F.col("row").alias("_gone_row")), "gone")
    return docs.join(gone, (file == F.col("_gone_file")) & (row == F.col("_gone_row")), "left_anti")
