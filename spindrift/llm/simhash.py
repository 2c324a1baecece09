"""SimHash near-duplicates: exact comparison of tiles of fingerprints with numpy."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch_rows, record_batch, small_batches, stored, words_of
from .components import connected_components

SEED = 42


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included (fewer words: the whole sequence)."""
    parts, carry = [], []
    for words in words_of(data.lower()):
        words = carry + words
        if len(words) >= width:
            runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            parts.append(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(words) - width + 1))
        carry = words[-(width - 1) :] if width > 1 else []
    if parts:
        return np.concatenate(parts)
    return np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)] if carry else [], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes give zero."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def second_hashes(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles, mixed from the first."""
    h = hashes ^ np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, distinct: bool = False, short: int = 0) -> DataFrame:
    """``(doc, fp, shingles, words, fp2, marks)``: id, fingerprint as a signed long, and the number of shingles.

    If ``distinct``, a shingle counts once, ``words`` is a 128-bit hash of the word sequence,
    ``fp2`` a second fingerprint, and ``marks``, of at most ``short`` shingles, the exclusive-or of
    all hashes and of all without each (else they are empty and zero).
    """
    schema = pa.schema([("doc", pa.int64()), ("fp", pa.int64()), ("shingles", pa.int64()), ("words", pa.binary()), ("fp2", pa.int64()), ("marks", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, more, sizes, keys, marks = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                data = as_bytes(text)
                hashes = shingle_hashes(data, width)
                key, other, mark = b"", 0, []
                if distinct:
                    key = xxhash.xxh3_128_digest(hashes.tobytes())
                    hashes = np.unique(hashes)
                    other = fingerprint(second_hashes(hashes))
                    if 0 < len(hashes) <= short:
                        whole = np.bitwise_xor.reduce(hashes)
                        mark = np.r_[whole, whole ^ hashes].view(np.int64).tolist()
                more.append(other)
                marks.append(mark)
                fps.append(fingerprint(hashes))
                sizes.append(len(hashes))
                keys.append(key)
            yield record_batch(schema, (batch.column(0), np.array(fps, np.uint64).view(np.int64), sizes, keys, np.array(more, np.uint64).view(np.int64), marks))

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, "doc long, fp long, shingles long, words binary, fp2 long, marks array<long>")


def spanning_links(near: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what all pairs within the radius join, the closest first (Boruvka's rounds).

    ``near`` is a square matrix of distances, over ``radius`` where two rows are no pair. A group of
    n copies gives n - 1 links here, never n * n.
    """
    n = len(near)
    label, links = np.arange(n), []
    while True:
        free = np.where(label[:, None] == label[None, :], 255, near)
        best = free.argmin(axis=1)
        least = free[np.arange(n), best]
        rows = np.flatnonzero(least <= radius)
        if not len(rows):
            return links
        order = rows[np.lexsort((rows, least[rows], label[rows]))]
        first = order[np.r_[True, label[order][1:] != label[order][:-1]]]
        for i in first.tolist():
            j = int(best[i])
            if label[i] != label[j]:
                links.append((i, j))
                label[label == max(label[i], label[j])] = min(label[i], label[j])


def tile_distances(left: np.ndarray, right: np.ndarray | None, radius: int, whole: int) -> np.ndarray:
    """Differing bits of every pair between two tiles, or within one; over ``whole`` where two rows are no pair.

    Tiles have a row for each fingerprint, and a row of second ones. A pair links within ``radius``
    bits of the first and ``whole`` bits of both.
    """
    other = left if right is None else right
    near = np.bitwise_count(left[0][:, None] ^ other[0][None, :])
    if right is None:
        np.fill_diagonal(near, 255)
    if whole > radius:
        hit = near <= radius
        i, j = np.nonzero(hit)
        near[i, j] += np.bitwise_count(left[1][i] ^ other[1][j])
        near[~hit] = 255
    return near


def compare_tiles(left: np.ndarray, right: np.ndarray | None, radius: int, whole: int) -> list[tuple[int, int, int]]:
    """Spanning links between two tiles, or within one, as ``(i, j, distance)``; ``j`` counts on after ``left``."""
    near = tile_distances(left, right, radius, whole)
    hit = near <= whole
    rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    if not len(rows):
        return []
    if right is None:
        square, names = near[np.ix_(rows, rows)], rows
    else:
        square = np.full((len(rows) + len(cols),) * 2, 255, np.uint8)
        square[: len(rows), len(rows) :] = near[np.ix_(rows, cols)]
        square[len(rows) :, : len(rows)] = square[: len(rows), len(rows) :].T
        names = np.r_[rows, len(left[0]) + cols]
    return [(int(names[i]), int(names[j]), int(square[i, j])) for i, j in spanning_links(square, whole)]


def decide_open(names: np.ndarray, codes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, radius: int, whole: int, similarity: float) -> list[tuple[int, int]]:
    """Verified links of one tile pair: of its pairs within the radius, enough of those alike to join what all join.

    Rows have a name, both fingerprints, a label (rows of one label are joined already), a set of
    shingle hashes and the side, 0 or 1; rows of one tile have side 0 alone. Each row is compared
    with its partners of other labels at once: their shingles are looked up in a mask of its own.
    """
    labels, sizes = labels.copy(), np.array([len(x) for x in sets], np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mine, links = np.zeros(len(flat), bool), []
    left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    same = not len(right)
    right = left if same else right
    near = tile_distances(codes[:, left], None if same else codes[:, right], radius, whole) <= whole
    for row, i in enumerate(left.tolist()):
        j = right[near[row]]
        j = j[(labels[j] != labels[i]) & (np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i]))]
        if not len(j):
            continue
        own = flat[starts[i] : ends[i]]
        mine[own] = True
        stops = np.cumsum(sizes[j])
        at = np.repeat(starts[j] - stops + sizes[j], sizes[j]) + np.arange(stops[-1])
        hits = np.r_[0, np.cumsum(mine[flat[at]])]
        both = hits[stops] - hits[stops - sizes[j]]
        mine[own] = False
        alike = j[both >= similarity * (sizes[i] + sizes[j] - both)]
        joined, first = np.unique(labels[alike], return_index=True)
        if len(joined):
            links += [(int(names[i]), int(names[k])) for k in alike[first]]
            labels[np.isin(labels, joined)] = labels[i]
    return links


def neighbour_offsets(radius: int, parts: int, step: int, bands: int) -> list[int]:
    """Offsets of the cells that can hold a partner, those of one direction only.

    A cell is a vector of population counts (of ``parts`` pieces of the fingerprint, in bins of
    ``step``) and a size band. The counts of two fingerprints differ by no more than their bits do,
    so cells whose counts differ by more than the radius are skipped.
    """
    reach = radius // step + 1
    out = []
    for *bins, band in product(*[range(-reach, reach + 1)] * parts, range(-bands, bands + 1)):
        if sum(max(0, (abs(d) - 1) * step + 1) for d in bins) <= radius:
            offset = sum(d * 128**i for i, d in enumerate([*bins, band]))
            if offset >= 0:
                out.append(offset)
    return sorted(out)


#: What names a tile pair.
PAIR = ["cell", "sub", "cell2", "sub2"]


def tiles_of(nodes: DataFrame, parts: int, step: int, tile: int, whole: int | None) -> DataFrame:
    """``(cell, sub, items)``: the nodes of each tile, about ``tile`` of them, and at most about 512 shingles for each.

    Long texts have smaller tiles, so that the sets of two tiles fit a task (``nodes`` has ``shingles`` then).
    """
    weight = F.col("shingles") if "shingles" in nodes.columns else F.lit(0).cast("long")
    width = 64 // parts
    cell = F.col("band").cast("long") * (128**parts)
    for i in range(parts):
        piece = F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        cell = cell + F.floor(F.bit_count(piece) / step).cast("long") * (128**i)
    other = F.col("fp2") if whole else F.lit(0).cast("long")
    nodes = stored(nodes.select("node", "fp", other.alias("fp2"), cell.alias("cell"), weight.alias("weight")))
    # At most (64 / parts / step + 1) ** parts cells a band: 83,521 for four pieces, so a broadcast stays under 3 MB.
    sizes = nodes.groupBy("cell").agg(F.ceil(F.greatest(F.count("*") / tile, F.sum("weight") / (512 * tile))).cast("int").alias("n"))
    tiles = nodes.join(F.broadcast(sizes), "cell").withColumn("sub", F.pmod(F.xxhash64("fp", "node"), F.col("n")).cast("int"))
    return stored(tiles.groupBy("cell", "sub").agg(F.collect_list(F.struct("node", "fp", "fp2")).alias("items")))


def pairs_of(tiles: DataFrame, radius: int, parts: int, step: int, bands: int) -> DataFrame:
    """The tile pairs that can hold a link, with the items of both."""
    offsets = F.array(*[F.lit(x).cast("long") for x in neighbour_offsets(radius, parts, step, bands)])
    left = tiles.select(F.col("cell").alias("from"), "sub", F.col("items").alias("left"), "cell", F.explode(offsets).alias("offset"))
    left = left.select("from", "sub", "left", "offset", (F.col("cell") + F.col("offset")).alias("cell"))
    right = tiles.select("cell", F.col("sub").alias("sub2"), F.col("items").alias("right"))
    pairs = left.join(right, "cell").where("offset > 0 or sub2 >= sub")
    return pairs.select("left", "right", F.expr("offset = 0 and sub = sub2").alias("same"), F.col("from").alias("cell"), "sub", F.col("cell").alias("cell2"), "sub2")


def sides_of(batch: pa.RecordBatch) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]]]:
    """Each row's number and its tiles, one or two: nodes, both fingerprints and, where items have them, labels."""
    same, sides = batch.column(2).to_pylist(), []
    for column in (batch.column(0), batch.column(1)):
        flat = column.values
        codes = np.stack([flat.field(f).to_numpy(zero_copy_only=False).view(np.uint64) for f in ("fp", "fp2")])
        labels = flat.field("label").to_numpy(zero_copy_only=False) if flat.type.get_field_index("label") >= 0 else None
        sides.append((column.offsets.to_numpy(), flat.field("node").to_numpy(zero_copy_only=False), codes, labels))
    for r in range(batch.num_rows):
        cut = [(nodes[at[r] : at[r + 1]], codes[:, at[r] : at[r + 1]], None if labels is None else labels[at[r] : at[r + 1]]) for at, nodes, codes, labels in sides]
        yield r, cut[:1] if same[r] else cut


#: Rows of an Arrow batch of tile pairs.
PAIR_ROWS = 64


def links_in(pairs: DataFrame, radius: int, whole: int) -> DataFrame:
    """``(a, b, distance)`` and the tile pair's name: spanning links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int32()), ("cell", pa.int64()), ("sub", pa.int32()), ("cell2", pa.int64()), ("sub2", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, tiles in sides_of(batch):
                i, j, d = np.array(compare_tiles(tiles[0][1], tiles[1][1] if len(tiles) > 1 else None, radius, whole), np.int64).reshape(-1, 3).T
                if len(i):
                    names = np.concatenate([t[0] for t in tiles])
                    yield record_batch(schema, (names[i], names[j], d.astype(np.int32), *(pa.repeat(batch.column(c)[r], len(i)) for c in range(3, 7))))

    return pairs.select("left", "right", "same", *PAIR).mapInArrow(run, "a long, b long, distance int, cell long, sub int, cell2 long, sub2 int")


def open_nodes(pairs: DataFrame, radius: int, whole: int) -> DataFrame:
    """``(node, fp, fp2, label, side)`` and the tile pair's name: nodes with a partner within the radius of another label."""
    schema = pa.schema([("node", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("label", pa.int64()), ("side", pa.int32()), ("cell", pa.int64()), ("sub", pa.int32()), ("cell2", pa.int64()), ("sub2", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, tiles in sides_of(batch):
                other = tiles[-1]
                near = tile_distances(tiles[0][1], other[1] if len(tiles) > 1 else None, radius, whole) <= whole
                near &= tiles[0][2][:, None] != other[2][None, :]
                for side, (names, codes, labels) in enumerate(tiles):
                    at = np.flatnonzero(near.any(axis=1 - side))
                    if len(at):
                        yield record_batch(schema, (names[at], *codes[:, at].view(np.int64), labels[at], np.full(len(at), side, np.int32), *(pa.repeat(batch.column(c)[r], len(at)) for c in range(3, 7))))

    return pairs.select("left", "right", "same", *PAIR).mapInArrow(run, "node long, fp long, fp2 long, label long, side int, cell long, sub int, cell2 long, sub2 int")


def open_links(nodes: DataFrame, sets: DataFrame, radius: int, whole: int, similarity: float) -> DataFrame:
    """``(a, b)``: verified links between the open nodes of each tile pair, which meet in one task with their sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        node, fp, fp2, label, side = (table.column(c).to_numpy() for c in ("node", "fp", "fp2", "label", "side"))
        held = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        links = decide_open(node, np.stack([fp, fp2]).view(np.uint64), label, held, side, radius, whole, similarity)
        return pa.Table.from_batches([record_batch(schema, list(zip(*links, strict=True)) or ([], []))])

    held = sets.select(F.col("doc").alias("node"), F.col("shingles").alias("set"))
    return nodes.join(held, "node").groupBy(*PAIR).applyInArrow(run, "a long, b long")


def tile_links(nodes: DataFrame, radius: int, parts: int = 4, step: int = 1, bands: int = 0, tile: int = 1024, whole: int | None = None) -> DataFrame:
    """``(a, b, distance)``: links whose components are those of all pairs within the radius.

    ``nodes`` has ``node``, a distinct fingerprint ``fp`` each (as a rule) and ``band``; with ``whole``,
    also ``fp2``, and pairs must be within that many bits of both fingerprints. Cells are
    split into tiles of about ``tile`` rows, and tile pairs are compared exactly, so no group of
    any size meets in one task and nothing is dropped. Each tile pair gives spanning links only.
    """
    pairs = pairs_of(tiles_of(nodes, parts, step, tile, whole), radius, parts, step, bands)
    with batch_rows(nodes.sparkSession, PAIR_ROWS):
        return stored(links_in(pairs, radius, whole or radius).select("a", "b", "distance"))


def verified_links(nodes: DataFrame, more: DataFrame, sets_for: Callable[[DataFrame], DataFrame], similarity: float, radius: int, whole: int, step: int, tile: int) -> DataFrame:
    """``(a, b)``: verified links whose components are those of all proposed pairs that are alike enough.

    Proposed are all pairs within the radius, and those of ``more``. A tile pair proposes spanning
    links first. Where one of them fails, that tile pair is decided whole: its nodes with a partner
    that verified links do not join to them meet in a task with their shingle sets, and every such
    pair is compared there until it is joined. So no pair is passed over because of a link that
    failed, no pair is a row before it is verified, and a group of n copies still gives n - 1 links.
    """
    spark = nodes.sparkSession
    tiles = tiles_of(nodes, 1, step, tile, whole)
    with batch_rows(spark, PAIR_ROWS):
        links = stored(links_in(pairs_of(tiles, radius, 1, step, 1), radius, whole).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *PAIR))
    asked = stored(links.select("a", "b").unionByName(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct())
    sets = sets_for(asked.select(F.explode(F.array("a", "b")).alias("doc")).distinct())
    good = stored(verify(asked, sets, similarity).distinct())
    failed = stored(links.join(good, ["a", "b"], "left_anti").select(*PAIR).distinct())
    if failed.isEmpty():
        return good
    labels = stored(connected_components(good, "a", "b"))
    used = failed.select("cell", "sub").unionByName(failed.select(F.col("cell2").alias("cell"), F.col("sub2").alias("sub"))).distinct()
    items = tiles.join(used, ["cell", "sub"], "left_semi").select("cell", "sub", F.explode("items").alias("item")).select("cell", "sub", "item.*")
    items = items.join(labels, "node", "left").select("cell", "sub", F.struct("node", "fp", "fp2", F.coalesce("component", "node").alias("label")).alias("item"))
    held = stored(items.groupBy("cell", "sub").agg(F.collect_list("item").alias("items")))
    right = held.select(F.col("cell").alias("cell2"), F.col("sub").alias("sub2"), F.col("items").alias("right"))
    pairs = failed.join(held.withColumnRenamed("items", "left"), ["cell", "sub"]).join(right, ["cell2", "sub2"]).withColumn("same", F.expr("cell = cell2 and sub = sub2"))
    with batch_rows(spark, PAIR_ROWS):
        still = stored(open_nodes(pairs, radius, whole))
    found = open_links(still, sets_for(still.select(F.col("node").alias("doc")).distinct()), radius, whole, similarity)
    return good.unionByName(stored(found.distinct()))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, tile: int = 1024) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row.

    Words are runs without ASCII white space, A-Z lowered; shingles are ``width`` words joined by a
    space, repeats included. Fingerprints within ``radius`` bits link, equal ones too, and the
    component id is the smallest id that can be reached.

    Null or empty text: fingerprint zero, linked like any other. Null id: the row returns with the
    component of its fingerprint, but never names one (null if no row with an id has that
    fingerprint). Repeated rows: each returns. Empty table: empty result. Other columns are ignored.
    """
    prints = stored(fingerprints(docs, id_col, text_col, width).select("doc", "fp"))
    classes = prints.groupBy("fp").agg(F.min("doc").alias("node"))
    links = tile_links(classes.where("node is not null").select("node", "fp", F.lit(0).alias("band")), radius, tile=tile)
    found = connected_components(links, "a", "b")
    named = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select(F.col("doc").alias("doc_id"), "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 20, whole: int = 32, tile: int = 1024) -> DataFrame:
    """``(doc, component)``: groups of documents whose sets of word shingles are alike.

    Equal word sequences form a class first. SimHash over distinct shingles proposes links between
    classes: within ``radius`` bits of one fingerprint and ``whole`` bits of two. At the similarity,
    9.7 and 19.4 bits are expected to differ, with deviations of 2.9 and 4.1, so about one pair in
    a thousand at the limit is passed over, and hardly any unlike pair is proposed. Tiles are also
    cut by the number of shingles: sets that are alike differ in size by a factor of 1 / similarity
    at most, so other tile pairs are skipped. Texts so short that alike ones differ in one shingle
    at most are joined exactly on their sets (``short_links``). Every link used is verified on the whole sets (Jaccard
    at least ``similarity``), and where one fails, the pairs that it stood for are compared in its place.

    Null and empty texts have no shingles: they are copies of one another. Rows with a null id take
    no part. Repeated ids and rows: one entry each id, in the smallest component of its texts.
    """
    prints = stored(fingerprints(docs, id_col, text_col, width, distinct=True, short=short_limit(similarity)).where("doc is not null"))
    key = ["words", "fp", "fp2", "shingles"]
    classes = stored(prints.groupBy(*key).agg(F.min("doc").alias("node"), F.any_value("marks").alias("marks")))
    band = F.floor(F.log(F.greatest(F.col("shingles"), F.lit(1))) / math.log(1 / similarity) + 1e-9).cast("int")

    def sets_for(ends: DataFrame) -> DataFrame:
        held = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
        return stored(shingle_sets(marked_rows(held, ends), "doc", "text", width))

    checked = verified_links(classes.select("node", "fp", "fp2", "shingles", band.alias("band")), short_links(classes, similarity), sets_for, similarity, radius, whole, 8, tile)
    same = prints.join(classes, key).where("doc <> node").select(F.col("doc").alias("a"), F.col("node").alias("b")).distinct()
    found = connected_components(checked.unionByName(same), "a", "b")
    return prints.select("doc").distinct().join(found.withColumnRenamed("node", "doc"), "doc", "left").select("doc", F.coalesce("component", "doc").alias("component"))


def short_limit(similarity: float) -> int:
    """The most shingles of sets that differ, where alike, in one shingle of the larger at most."""
    return math.ceil(2 * similarity / (1 - similarity) - 1e-9) if similarity < 1 else 1


def short_links(classes: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: links of short texts, by equal sets or by sets that are equal without one shingle of the larger.

    ``marks`` are 64-bit marks of the set, and of the set without each shingle in turn. The smallest
    node stands for all nodes of an equal set, so a key of any size meets one row.
    """
    short = classes.where("size(marks) > 0").select("node", "marks", "shingles")
    sets = stored(short.groupBy(F.col("marks")[0].alias("mark"), F.col("shingles").alias("n")).agg(F.min("node").alias("b")))
    equal = short.select(F.col("node").alias("a"), F.col("marks")[0].alias("mark"), F.col("shingles").alias("n"))
    less = short.where(F.col("shingles") - 1 >= similarity * F.col("shingles") - 1e-9).select(F.col("node").alias("a"), F.explode(F.expr("slice(marks, 2, size(marks))")).alias("mark"), (F.col("shingles") - 1).alias("n"))
    return equal.unionByName(less).join(sets, ["mark", "n"]).where("a <> b").select("a", "b").distinct()


#: Bits of a bit table for each id, in one of its rows, and in all: 16 MB at most, whatever the number of ids.
ID_BITS, ROW_BITS, MOST_BITS = 16, 1 << 15, 1 << 27


def marked_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` (``doc``, ``text``) whose id is in ``ids``, and a few others, without a shuffle of the texts.

    Ids set a bit each in a table of bounded size, which every task has; a row stays if its bit is
    set. Of the other rows one in 16 stays at most, until there are more than 8 million ids, and
    then more: joins on the id drop them later. Null ids go.
    """
    bits = max(ROW_BITS, min(1 << (ID_BITS * ids.count()).bit_length(), MOST_BITS))
    place = F.pmod(F.xxhash64("doc"), F.lit(bits)) + 1
    row, at = F.bitmap_bucket_number(place).alias("row"), F.bitmap_bit_position(place).alias("at")
    table = stored(ids.select(row, at).groupBy("row").agg(F.bitmap_construct_agg("at").alias("bits")))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    kept = docs.where("doc is not null").select("doc", "text", row, at).join(F.broadcast(table), "row")
    return kept.where(F.call_function("getbit", byte, (F.col("at") % 8).cast("int")) == 1).select("doc", "text")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(doc, shingles)``: the sorted distinct shingle hashes of each row, packed."""
    schema = pa.schema([("doc", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record_batch(schema, (batch.column(0), [np.unique(shingle_hashes(as_bytes(t), width)).tobytes() for t in batch.column(1).to_pylist()]))

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, "doc long, shingles binary")


def verify(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links whose two sets have a Jaccard similarity of at least ``similarity``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    out.append((a, b))
            yield record_batch(schema, list(zip(*out, strict=True)) or ([], []))

    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("right"))
    return links.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")
