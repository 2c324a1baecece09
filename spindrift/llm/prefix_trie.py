"""Prefix trie of conversations, built as a burst trie.

A turn is an id. Suffixes of equal value lie in containers under the heads of the trie. A container
with too many of them bursts: its suffixes are dealt out again by their next turn id, below the part
that all of them share. What is small enough is sorted, and one sweep over the sorted suffixes of a
container makes its nodes. Sums over a subtree are sums over what lies in its containers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import record_batch, stored

#: Different suffixes that a container may hold, and turns in a piece of a sequence.
CONTAINER, PIECE = 4096, 512

#: Turns at most that a conversation takes from the one it continues, and conversations that share one.
TAKEN, FAMILY = 8, 5

NODE = """head string, is_top boolean, anc array<string>, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long,
n_leaves long, saved_tokens long, own_saved long, is_leaf boolean, n_end long, lo_end long, end_id string"""


def turn_id(role: Column, text: Column) -> Column:
    """128 bits of SHA-256 of both, with the role's length first, so that no two pairs read alike."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)


def numbered_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv, idx, tid, size)`` of every turn, numbered from 0 in its conversation, and ``(conv, n)``.

    Turns are sorted over all tasks by ranges, so a conversation of any length is spread: each task
    numbers its own part, and the parts before it are added. Only ids and lengths move.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("t"), F.substring(role, 1, 32).alias("r"), F.substring(text, 1, 64).alias("x"),
        turn_id(role, text).alias("tid"), F.octet_length(text).cast("long").alias("size"),
    )
    order = [F.col("conv"), F.col("t").asc_nulls_first(), F.col("r"), F.col("x"), F.col("tid")]
    schema = pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("local", pa.int64()), ("tid", pa.binary()), ("size", pa.int64())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            lengths = np.diff(np.r_[starts, len(conv)])
            local = np.arange(len(conv)) - np.repeat(starts, lengths)
            if conv[0] == last:
                local[: lengths[0]] += seen
            last, seen = conv[-1], int(local[-1]) + 1
            yield record_batch(schema, (batch.column(0), np.full(len(conv), part, np.int32), local, batch.column(1), batch.column(2)))

    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "tid", "size")
    rows = stored(spread.mapInArrow(number, "conv long, part int, local long, tid binary, size long"))
    parts = rows.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    # A task continues one conversation of the task before it at most: no more rows than tasks.
    before = before.where("before is not null").select("conv", "part", "before")
    idx = F.col("local") + F.coalesce("before", F.lit(0))
    return rows.join(F.broadcast(before), ["conv", "part"], "left").select("conv", idx.alias("idx"), "tid", "size"), parts.groupBy("conv").agg(F.sum("n").alias("n"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv, pos, tid, size)`` of all rebuilt conversations, and ``conv`` of those without a turn.

    Conversation c takes the first h turns of c - c % 5, as in SQL (the remainder has the sign of c).
    """
    own, sizes = numbered_turns(turns)
    own, sizes = stored(own), stored(sizes)
    base = F.col("conv") - F.col("conv") % FAMILY
    convs = sizes.select("conv", "n", base.alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % (TAKEN + 1)).alias("h"))
    convs = convs.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = stored(convs.withColumn("total", F.when(F.col("conv") == F.col("base"), F.col("n")).otherwise(F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))))
    taken = own.where((F.col("idx") < TAKEN) & (F.col("conv") % FAMILY == 0)).withColumnRenamed("conv", "base")
    taken = convs.where("conv <> base and k > 0").join(taken, "base").where("idx < k").select("conv", F.col("idx").alias("pos"), "tid", "size")
    # h is known from the id; only where the other conversation is shorter do turns move up.
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (TAKEN + 1)
    kept = own.where((F.col("conv") % FAMILY == 0) | (F.col("idx") >= h))
    short = convs.where("conv <> base and k < h and total > k").select("conv", (F.col("h") - F.col("k")).alias("up"))
    kept = kept.join(short, "conv", "left").select("conv", (F.col("idx") - F.coalesce("up", F.lit(0))).alias("pos"), "tid", "size")
    return taken.unionByName(kept), convs.where("total = 0").select("conv")


def pieces_of(rows: DataFrame, empty: DataFrame, piece: int) -> tuple[DataFrame, DataFrame]:
    """``(conv, level, head, next, tids, sizes)``: sequences in pieces of ``piece`` turns; and the same of long ones only.

    ``head`` names all turns before the piece by the exclusive-or of 128 bits of each piece with its
    place, so that it is summed up along a conversation; ``next`` is null in the last piece.
    """
    cut = rows.groupBy("conv", F.floor(F.col("pos") / piece).alias("level")).agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "size"))).alias("turns"))
    cut = cut.select("conv", "level", F.col("turns.tid").alias("tids"), F.col("turns.size").alias("sizes"))
    cut = stored(cut.unionByName(empty.select("conv", F.lit(0).cast("long").alias("level"), F.expr("cast(array() as array<binary>)").alias("tids"), F.expr("cast(array() as array<bigint>)").alias("sizes"))))
    top, none = F.lit("0").alias("head"), F.lit(None).cast("string").alias("next")
    short = cut.where((F.col("level") == 0) & (F.size("tids") < piece)).select("conv", "level", top, none, "tids", "sizes")
    along = Window.partitionBy("conv").orderBy("level")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    marks = [F.bit_xor(F.xxhash64(F.lit(salt), "level", "tids")).over(before) for salt in (1, 2)]
    head = F.when(F.col("level") == 0, F.lit("0")).otherwise(F.concat_ws(":", "level", *marks))
    long = cut.where((F.col("level") > 0) | (F.size("tids") == piece)).withColumn("head", head)
    long = long.select("conv", "level", "head", F.lead("head").over(along).alias("next"), "tids", "sizes")
    return short, stored(long)


def end_name(head: Column, tids: Column) -> Column:
    return F.md5(F.concat(head, F.lit("|"), F.array_join(F.transform(tids, F.hex), "")).cast("binary"))


def containers(pieces: DataFrame, kids: DataFrame | None) -> DataFrame:
    """Equal suffixes under a head become one, with its number of conversations and the smallest one.

    ``rest_leaves`` and ``rest_saved`` come with the pieces: what lies below their last turn. ``kids``
    has the number of children below a head.
    """
    ends = F.col("next").isNull()
    out = pieces.groupBy("head", "level", "tids").agg(
        F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv").alias("lo"), F.count_if(ends).alias("n_end"), F.min(F.when(ends, F.col("conv"))).alias("lo_end"),
        F.sum("rest_leaves").alias("rest_leaves"), F.sum("rest_saved").alias("rest_saved"), F.max("next").alias("next"),
    )
    if kids is None:
        out = out.withColumn("kids", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long"))
    else:
        out = out.join(kids, "next", "left").withColumn("kids", F.coalesce("kids", F.lit(0).cast("long")))
    return out.withColumn("end_id", F.when(F.col("n_end") > 1, end_name(F.col("head"), F.col("tids"))))


def burst(items: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Suffixes in containers of at most ``most``, and the heads of the containers that burst.

    A round bursts every container that is too large, below the longest start that its suffixes share
    (that of the least and the greatest suggests it), so rounds follow branchings, not turns.
    """
    place = [F.col("head").alias("box"), F.lit(0).alias("p"), F.lit(None).cast("long").alias("up"), F.expr("cast(array() as array<string>)").alias("anc")]
    now, closed, heads = stored(items.select("*", *place)), [], []
    while True:
        fat = now.groupBy("box").agg(
            F.count("*").alias("items"), F.min("tids").alias("least"), F.max("tids").alias("most"), F.first("sizes").alias("sizes"), F.sum("n").alias("n"), F.min("lo").alias("lo"),
            *(F.first(c).alias(c) for c in ("head", "level", "p", "up", "anc")),
        ).where(F.col("items") > most)
        shared = "aggregate(sequence(0, size(least)), 0, (a, i) -> if(a = i and i < size(least) and i < size(most) and least[i] = most[i], i + 1, a))"
        fat = stored(fat.withColumn("q", F.expr(shared)).withColumn("sizes", F.expr("slice(sizes, 1, q)")).drop("least", "most", "items"))
        if fat.isEmpty():
            break
        asked = fat.select("box", "q", F.col("lo").alias("box_lo"))
        closed.append(now.join(asked, "box", "left_anti"))
        hit = now.join(asked, "box")
        below = F.md5(F.concat("box", F.lit("/"), F.array_join(F.transform(F.expr("slice(tids, p + 1, q - p + 1)"), F.hex), "")).cast("binary"))
        deeper = hit.where(F.size("tids") > F.col("q")).withColumn("anc", F.concat("anc", F.array("box"))).withColumn("box", below)
        now = stored(deeper.withColumns({"p": F.col("q") + 1, "up": F.col("box_lo")}).select(*now.columns))
        kids = now.groupBy(F.element_at("anc", -1).alias("box")).agg(F.count_distinct("box").alias("n_kids"))
        ended = hit.where(F.size("tids") == F.col("q")).select("box", "n_end", "lo_end", "end_id")
        heads.append(stored(fat.join(kids, "box").join(ended, "box", "left")))
    closed.append(now)
    union = lambda tables: tables[0] if len(tables) == 1 else union([tables[0].unionByName(tables[1]), *tables[2:]])
    return union(closed), union(heads) if heads else None


class Open:
    """A node whose suffixes are not all seen yet."""

    __slots__ = ("ends", "found", "kids", "leaves", "lo", "n", "saved", "size")

    def __init__(self, size: int):
        self.size, self.n, self.lo, self.leaves, self.saved, self.kids, self.ends, self.found = size, 0, None, 0, 0, 0, (0, None, None), []

    def add(self, n: int, lo: int, leaves: int, saved: int, kids: int) -> None:
        self.n, self.leaves, self.saved, self.kids = self.n + n, self.leaves + leaves, self.saved + saved, self.kids + kids
        self.lo = lo if self.lo is None else min(lo, self.lo)


class Container:
    """The open path of a container from its top down; a node is written when its parent closes."""

    def __init__(self, row: dict, piece: int):
        self.box, self.head, self.anc, self.up, self.p = row["box"], row["head"], row["anc"], row["up"], row["p"]
        self.first = row["level"] * piece
        self.path, self.open = row["tids"][: self.p], [Open(row["sizes"][self.p - 1] if self.p else 0)]

    def close_to(self, depth: int) -> Iterator[tuple]:
        while self.p + len(self.open) - 1 > depth:
            at, node = self.p + len(self.open) - 1, self.open.pop()
            record = yield from self.written(node, at)
            self.open[-1].add(node.n, node.lo, record[8], record[9], 1)
            self.open[-1].found.append(record)
        del self.path[depth:]

    def written(self, node: Open, at: int) -> Iterator[tuple]:
        """Writes the children, whose parent is now known; returns the node's own row, without its parent."""
        for row in node.found:
            yield (*row[:5], node.lo, *row[6:])
        own, leaf = (node.n - 1) * node.size, node.kids == 0
        return (self.head, False, None, self.first + at, node.lo, None, node.n, node.kids, node.leaves + leaf, node.saved + own, own, leaf, *node.ends)

    def add(self, row: dict) -> Iterator[tuple]:
        tids, shared = row["tids"], self.p
        most = min(len(tids), len(self.path))
        while shared < most and tids[shared] == self.path[shared]:
            shared += 1
        yield from self.close_to(shared)
        self.open += [Open(size) for size in row["sizes"][shared:]]
        self.path = list(tids)
        self.open[-1].add(row["n"], row["lo"], row["rest_leaves"], row["rest_saved"], row["kids"])
        self.open[-1].ends = (row["n_end"], row["lo_end"], row["end_id"])

    def end(self) -> Iterator[tuple]:
        yield from self.close_to(self.p)
        record = yield from self.written(self.open[0], self.p)
        if self.p or not self.first:  # else the piece before has this node
            yield (record[0], True, self.anc, *record[3:5], self.up, *record[6:])


def swept(closed: DataFrame, piece: int) -> DataFrame:
    """The nodes of all containers: sorted suffixes, read once, with the open path in memory."""
    schema = pa.schema([
        ("head", pa.string()), ("is_top", pa.bool_()), ("anc", pa.list_(pa.string())), *((c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "own_saved")),
        ("is_leaf", pa.bool_()), ("n_end", pa.int64()), ("lo_end", pa.int64()), ("end_id", pa.string()),
    ])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now = None
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["box"] != now.box:
                    if now:
                        yield from now.end()
                    now = Container(row, piece)
                yield from now.add(row)
        if now:
            yield from now.end()

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = []
        for node in nodes(batches):
            some.append(node)
            if len(some) == 10_000:
                yield record_batch(schema, list(zip(*some, strict=True)))
                some = []
        if some:
            yield record_batch(schema, list(zip(*some, strict=True)))

    return closed.repartition("box").sortWithinPartitions("box", "tids").mapInArrow(sweep, NODE)


def head_nodes(heads: DataFrame, nodes: DataFrame, piece: int) -> DataFrame:
    """The nodes of containers that burst: sums over the containers below, and the chain that all suffixes share."""
    chain = "(n - 1) * aggregate(slice(sizes, greatest(p, 1), q - greatest(p, 1) + 1), 0L, (a, x) -> a + x)"
    chain = F.expr(f"case when q >= greatest(p, 1) then {chain} else 0L end")
    below = nodes.where("is_top").select(F.explode("anc").alias("box"), "n_leaves", F.col("saved_tokens").alias("saved"))
    below = below.unionByName(heads.select(F.explode("anc").alias("box"), F.lit(0).cast("long").alias("n_leaves"), chain.alias("saved")))
    all_ = heads.join(below.groupBy("box").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("below")), "box")
    each = all_.withColumn("i", F.explode(F.sequence("p", "q"))).where("i > 0 or level = 0")
    last, own = F.expr("i = q"), F.expr("case when i > 0 then (n - 1) * sizes[i - 1] else 0L end")
    onwards = F.expr("case when q >= greatest(i, 1) then (n - 1) * aggregate(slice(sizes, greatest(i, 1), q - greatest(i, 1) + 1), 0L, (a, x) -> a + x) else 0L end")
    return each.select(
        "head", F.lit(False).alias("is_top"), F.lit(None).cast("array<string>").alias("anc"), (F.col("level") * piece + F.col("i")).alias("depth"), F.col("lo").alias("conv_id"),
        F.when(F.expr("i = p and p > 0"), F.col("up")).when(F.expr("i > 0"), F.col("lo")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("n_kids")).otherwise(1).alias("n_children"), "n_leaves", (F.col("below") + onwards).alias("saved_tokens"), own.alias("own_saved"),
        F.lit(False).alias("is_leaf"), F.when(last, F.coalesce("n_end", F.lit(0))).otherwise(0).cast("long").alias("n_end"), F.when(last, F.col("lo_end")).alias("lo_end"), F.when(last, F.col("end_id")).alias("end_id"),
    )


def nodes_of(items: DataFrame, most: int, piece: int) -> DataFrame:
    closed, heads = burst(items.drop("next"), most)
    nodes = stored(swept(closed, piece))
    return nodes if heads is None else nodes.unionByName(head_nodes(heads, nodes, piece))


def end_digests(pieces: DataFrame, items: DataFrame) -> DataFrame:
    """``(end_id, ends)``: SHA-256 of the ids of conversations that are equal as a whole.

    The hash has to read the ids in order. They are joined to short strings by blocks of the id first,
    then each group's strings are streamed through the hash, sorted, in constant memory.
    """
    several = stored(items.where("n_end > 1").select("end_id"))
    ends = stored(pieces.where("next is null").select("conv", end_name(F.col("head"), F.col("tids")).alias("end_id"))).join(several, "end_id", "left_semi")
    packed = ends.groupBy("end_id", F.shiftright("conv", 12).alias("block")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    packed = packed.select("end_id", "block", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    schema = pa.schema([("end_id", pa.string()), ("ends", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, said = None, None
        for batch in batches:
            done = []
            for end, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if end != name:
                    if name is not None:
                        done.append((name, said.hexdigest()))
                    name, said = end, hashlib.sha256(ids.encode())
                else:
                    said.update(b"," + ids.encode())
            if done:
                yield record_batch(schema, list(zip(*done, strict=True)))
        if name is not None:
            yield record_batch(schema, ([name], [said.hexdigest()]))

    return packed.repartition("end_id").sortWithinPartitions("end_id", "block").mapInArrow(digest, "end_id string, ends string")


def conversation_trie(turns: DataFrame, most: int = CONTAINER, piece: int = PIECE) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, one row each.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``. Turns are ordered by ``turn``, null first.
    Conversation c continues c - c % 5: it takes that one's first turns (as many as its id's checksum
    says), then its own after as many. A node is a start that rebuilt conversations share; its columns are
    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``.

    Null role or text: empty. Null conv_id: the row is in no conversation and goes. Ties within a turn
    number: by role and text (their first 32 and 64 characters), then by the turn's hash. Repeated rows: each is a turn. Turnless
    conversations, where nothing is left: members of the root. Texts of any length are hashed once and never
    moved. Empty table: no node, not even the root. Extra columns are ignored.
    """
    short, long = pieces_of(*rebuilt(turns), piece)
    zero = {"rest_leaves": F.lit(0).cast("long"), "rest_saved": F.lit(0).cast("long")}
    kids, rest = None, long.withColumns(zero)
    if not long.where("level > 0").isEmpty():
        # What lies below the last turn of a piece: each head's own sums, booked on its smallest conversation.
        below = nodes_of(containers(long.where("level > 0").withColumns(zero), None), most, piece)
        sums = below.groupBy("head").agg(
            F.min("conv_id").alias("conv"), F.count_if(F.col("is_leaf")).alias("leaves"), F.sum("own_saved").alias("saved"),
            F.count_if(F.col("depth") % piece == 1 % piece).alias("kids"),
        )
        sums = stored(sums)
        kids = sums.select(F.col("head").alias("next"), "kids")
        deeper = Window.partitionBy("conv").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)
        rest = long.join(sums.select("head", "conv", "leaves", "saved"), ["head", "conv"], "left")
        rest = rest.withColumns({"rest_leaves": F.coalesce(F.sum("leaves").over(deeper), F.lit(0)), "rest_saved": F.coalesce(F.sum("saved").over(deeper), F.lit(0))}).drop("leaves", "saved")
    pieces = short.withColumns(zero).unionByName(rest)
    items = stored(containers(pieces, kids))
    nodes = nodes_of(items, most, piece)
    if kids is not None:  # conversations that end with the piece before are members of that node too
        upper = items.where("next is not null").select(F.col("next").alias("head"), F.col("lo").alias("upper"))
        first = (F.col("depth") > piece) & (F.col("depth") % piece == 1 % piece)
        nodes = nodes.join(upper, "head", "left").withColumn("parent_conv_id", F.when(first, F.col("upper")).otherwise(F.col("parent_conv_id")))
    none, one = F.sha2(F.lit("").cast("binary"), 256), F.sha2(F.col("lo_end").cast("string").cast("binary"), 256)
    nodes = nodes.join(end_digests(short.unionByName(long), items), "end_id", "left")
    ends = F.when(F.col("n_end") == 0, none).when(F.col("n_end") == 1, one).otherwise(F.col("ends"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))
