"""Alignment of two tokenizers: where both end a token, and which tokens overlap.

Each text is cut into tokens twice. Both lists of byte offsets where tokens end are sorted, so the
places that are in both are found by galloping: the shorter list asks, and each question steps
through the longer one by powers of two and then halves the last step. Ranks around a token's start
and end give the range of tokens that it overlaps.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shipped, batch_rows, record_batch, stored

#: Tokens' words that a worker keeps, words that are aligned at once, and links of a chunk of documents.
WORDS, BLOCK, CHUNK = 200_000, 50_000, 1_000_000

#: Questions that share a starting point.
STRIDE = 32


class Vocabularies:
    """Both vocabularies as files' contents, which ship to the workers; each builds its encoders once.

    ``first`` is a byte-level vocabulary as a ``tokenizers`` file, ``fast`` the same one as ranks and
    ``pattern`` its pattern of pieces: two encoders, of which the faster one takes words of letters that
    every version of Unicode knows alike. ``second`` is a model of pieces with byte fallback, in which a
    space is U+2581.
    """

    def __init__(self, first: str, fast: bytes, pattern: str, second: bytes):
        self.first, self.fast, self.pattern, self.second = first, fast, pattern, second
        self.state = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"state": None}

    def words(self) -> Words:
        if self.state is None:
            self.state = Words(self)
        return self.state


class Words:
    """Tokens of words, in growing arrays: a word is tokenised once while it is kept.

    A word starts with a space that follows no white space, and neither tokenizer joins text across
    such a place: the first cuts pieces there, and no token of the second has a space after another
    character (checked when it is loaded). So a text's tokens are its words' tokens in a row.
    """

    def __init__(self, v: Vocabularies):
        import sentencepiece
        import tiktoken
        import tokenizers

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, v.fast.splitlines())}
        self.fast = tiktoken.Encoding("first", pat_str=v.pattern, mergeable_ranks=ranks, special_tokens={})
        self.one = tokenizers.Tokenizer.from_str(v.first)
        self.one.encode_special_tokens = True  # their strings in a text are plain text
        self.one.no_truncation()
        self.one.no_padding()
        self.two = sentencepiece.SentencePieceProcessor(model_proto=v.second)
        n = self.two.get_piece_size()
        pieces = [self.two.id_to_piece(i) for i in range(n)]
        self.bytes_two = [bytes([int(p[3:5], 16)]) if self.two.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any(" " in b.decode().lstrip(" ") for i, b in enumerate(self.bytes_two) if not self.two.is_byte(i))
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        self.sizes = (sizes, np.array([len(b) for b in self.bytes_two], np.int64))
        self.wide = n
        digits = lambda count: [b"%d" % i for i in range(count)]
        # A token's decimal id with each sign that can follow it.
        self.said = [*(b + s for s in (b",", b"|") for b in digits(len(sizes))), *(b + s for s in (b",", b";") for b in digits(n))]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        none = np.zeros(0, np.int64)
        self.n, self.ids, self.good = [none, none], [none, none], np.zeros(0, bool)
        self.packed = [(none, none, none)] * 2

    def first_ids(self, word: str) -> list[int]:
        if max(word, default="") < "\u0250":
            return self.fast.encode_ordinary(" " + word)
        return self.one.encode(" " + word, add_special_tokens=False).ids

    def split(self, text: str) -> Iterator[str]:
        """The words of space + text, without their leading spaces."""
        if not self.apart:
            yield text
            return
        at, block = 0, 1 << 20
        while len(text) - at > block:  # a very long text is split a part at a time
            cut = text.find(" ", at + block)
            while cut > 0 and text[cut - 1].isspace():
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield from self.split_part(text[at:cut])
            at = cut + 1
        yield from self.split_part(text[at:] if at else text)

    @staticmethod
    def split_part(text: str) -> Iterator[str]:
        held = None
        for part in text.split(" "):
            if held is not None:
                part = f"{held} {part}"
            if not part or part[-1].isspace():  # the next space follows white space
                held = part
            else:
                held = None
                yield part
        if held is not None:
            yield held

    def find(self, words: list[str]) -> np.ndarray:
        """The place of each word; unknown ones are tokenised together."""
        known = self.known
        new = list({w: 0 for w in words if w not in known})
        if new:
            ones, twos = [self.first_ids(w) for w in new], self.two.encode(new, num_threads=1)
            if "" in new:  # a text's last space, which the second one would drop as its own
                twos[new.index("")] = [self.two.piece_to_id("▁")]
            pieces, before = self.bytes_two, len(known)
            known.update(zip(new, range(before, before + len(new)), strict=True))
            self.good = np.r_[self.good, [b"".join([pieces[i] for i in b]) == b" " + w.encode() for w, b in zip(new, twos, strict=True)]]
            for side, lists in enumerate((ones, twos)):
                self.n[side] = np.r_[self.n[side], np.array([len(x) for x in lists], np.int64)]
                self.ids[side] = np.r_[self.ids[side], np.fromiter(chain.from_iterable(lists), np.int64)]
            self.packed = [(ids, n, np.cumsum(n) - n) for ids, n in zip(self.ids, self.n, strict=True)]
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` for each start, so many as its count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def gallop(asked: np.ndarray, among: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many of ``among`` are less than each of ``asked``; at least ``start`` of them are known to be.

    Both are sorted. Every question goes on from its start by 1, 2, 4, ... until it has passed its
    value, and then halves the last step: the distance decides, not the length of ``among``.
    """
    low, step = start.copy(), 1
    more = np.flatnonzero(low < len(among))
    high = np.minimum(low, len(among))
    while len(more):
        probe = low[more] + (step - 1)
        inside = probe < len(among)
        less = inside.copy()
        less[inside] = among[probe[inside]] < asked[more[inside]]
        high[more[~less]] = np.minimum(probe[~less], len(among))
        more = more[less]
        low[more] = probe[less] + 1
        high[more] = low[more]
        step *= 2
    while len(more := np.flatnonzero(low < high)):
        middle = (low[more] + high[more]) >> 1
        less = among[middle] < asked[more]
        low[more[less]] = middle[less] + 1
        high[more[~less]] = middle[~less]
    return low


def ranks(asked: np.ndarray, among: np.ndarray, start: np.ndarray) -> np.ndarray:
    """``gallop`` in two steps: every ``STRIDE``-th question first, the others go on from there.

    A question's start is that of its text or of the question before it, whichever is further.
    """
    anchors = np.arange(0, len(asked), STRIDE)
    found = gallop(asked[anchors], among, start[anchors])
    return gallop(asked, among, np.maximum(start, np.repeat(found, STRIDE)[: len(asked)]))


def align(short: np.ndarray, long: np.ndarray, start: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of the asking side: whether its end is an end of the other one, and the range of tokens it overlaps.

    ``short`` and ``long`` are ends of tokens, over several texts in a row. ``start`` is the rank in
    ``long`` of the text's first token, ``first`` marks the first token of a text.
    """
    below = ranks(short, long, start)
    same = long[np.minimum(below, len(long) - 1)] == short
    # A token starts where the one before it ends: past all ends up to there.
    upto = below + same
    begin = np.where(first, start, np.r_[0, upto[:-1]])
    return same, begin, below - begin + 1


class Aligned:
    """What is known of a text while its blocks are aligned."""

    def __init__(self, key: int | None):
        self.key, self.good, self.n, self.groups, self.links, self.said, self.codes = key, True, [0, 0], 0, 0, hashlib.sha256(), []

    def row(self) -> tuple:
        """Counts, hash, and different links with their numbers; zeros where the tokens are not the text."""
        if not self.good or not self.n[0]:
            return self.key, 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, times = self.codes[0] if len(self.codes) == 1 else merged(self.codes)
        return self.key, *self.n, self.groups, self.links, self.said.hexdigest(), codes.copy(), times.astype(np.uint32)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([t for _, t in parts]), len(codes)).astype(np.int64)


def align_block(words: Words, texts: list[Aligned], parts: list[list[str]]) -> None:
    """Align so many words of so many texts, and add what is found to each."""
    places = words.find([w for part in parts for w in part])
    n_words = np.array([len(p) for p in parts])
    good = words.good[places]
    text_of = np.repeat(np.arange(len(parts)), n_words)
    for i in np.unique(text_of[~good]):
        texts[i].good = False
    use = np.array([t.good for t in texts], bool)
    places, text_of = places[use[text_of]], text_of[use[text_of]]
    if not len(places):
        return
    ids, ends, owner = [], [], []
    for (all_ids, n, at), sizes in zip(words.packed, words.sizes, strict=True):
        own = all_ids[spread(at[places], n[places])]
        ids.append(own)
        ends.append(np.cumsum(sizes[own]))
        owner.append(np.repeat(text_of, n[places]))
    counts = [np.bincount(o, minlength=len(parts)) for o in owner]
    firsts = [np.cumsum(c) - c for c in counts]
    codes, text_of_link = [], []
    ended = [np.zeros(len(e), bool) for e in ends]  # ends that both have
    for side in (0, 1):
        other = 1 - side
        # The shorter list of a text asks; of two equal ones the first.
        asks = counts[side] <= counts[other] if side == 0 else counts[side] < counts[other]
        mine = np.flatnonzero(asks[owner[side]])
        if not len(mine):
            continue
        text = owner[side][mine]
        first = np.r_[True, text[1:] != text[:-1]]
        same, begin, width = align(ends[side][mine], ends[other], firsts[other][text], first)
        ended[side][mine] = same
        ended[other][(begin + width - 1)[same]] = True
        partner = ids[other][spread(begin, width)]
        own = np.repeat(ids[side][mine], width)
        codes.append(own * words.wide + partner if side == 0 else partner * words.wide + own)
        text_of_link.append(np.repeat(text, width))
    codes, text_of_link = np.concatenate(codes), np.concatenate(text_of_link)
    both, times = np.unique(text_of_link * (len(words.sizes[0]) * words.wide) + codes, return_counts=True)
    link_text, both = np.divmod(both, len(words.sizes[0]) * words.wide)
    cut = np.searchsorted(link_text, np.arange(len(parts) + 1))
    n_links = np.bincount(text_of_link, minlength=len(parts))
    groups = np.bincount(owner[0][ended[0]], minlength=len(parts))
    # Tokens in the order in which groups name them: the first side's of a group, then the second's.
    group = [np.cumsum(e) - e for e in ended]
    said = [ids[side] + len(words.sizes[side]) * ended[side] for side in (0, 1)]
    order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
    in_order = np.concatenate([said[0], said[1] + 2 * len(words.sizes[0])])[order].tolist()
    ends_at = np.cumsum(counts[0] + counts[1])
    for i, t in enumerate(texts):
        if not use[i] or not counts[0][i]:
            continue
        own = b"".join([words.said[k] for k in in_order[ends_at[i] - counts[0][i] - counts[1][i] : ends_at[i]]])
        t.said.update((b";" if t.n[0] else b"") + own[:-1])
        t.n = [t.n[0] + int(counts[0][i]), t.n[1] + int(counts[1][i])]
        t.groups += int(groups[i])
        t.links += int(n_links[i])
        t.codes.append((both[cut[i] : cut[i + 1]], times[cut[i] : cut[i + 1]]))
        if len(t.codes) > 8:
            t.codes = [merged(t.codes)]


def aligned_texts(words: Words, rows: Iterator[tuple[int | None, str | None]]) -> Iterator[tuple]:
    """``Aligned.row`` of each text in turn. Words of several texts, or a part of a long one, are aligned at once."""
    texts, parts, held = [], [], 0

    def flush() -> None:
        if len(words.known) > WORDS:
            words.clear()
        align_block(words, texts, parts)

    for key, text in rows:
        texts.append(Aligned(key))
        parts.append([])
        for word in words.split(text) if text else ():
            parts[-1].append(word)
            held += 1
            if held == BLOCK:
                flush()
                yield from (t.row() for t in texts[:-1])
                texts, parts, held = texts[-1:], [[]], 0
    if texts:
        flush()
        yield from (t.row() for t in texts)


def link_tables(docs: DataFrame, vocabularies: Shipped, id_col: str, text_col: str) -> DataFrame:
    """Documents with their links, and the different links of each chunk of them, in one stored table.

    A document's row has counts, and its links as places in its chunk's list; a chunk's row has that
    list and the number of its documents with each.
    """
    fields = [
        ("chunk", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()),
        ("places", pa.binary()), ("times", pa.binary()), ("codes", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32())),
    ]
    schema = pa.schema(fields)
    ddl = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, codes array<long>, docs array<int>"

    def packed(chunk: int, held: list[tuple]) -> pa.RecordBatch:
        codes, at, n = np.unique(np.concatenate([h[6] for h in held]), return_inverse=True, return_counts=True)
        cuts = np.cumsum([len(h[6]) for h in held])[:-1]
        rows = [(chunk, *h[:6], p.astype(np.uint32).tobytes(), h[7].astype(np.uint32).tobytes(), None, None) for h, p in zip(held, np.split(at, cuts), strict=True)]
        rows.append((chunk, None, None, None, None, None, None, None, None, codes, n.astype(np.int32)))
        return record_batch(schema, list(zip(*rows, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabularies.value.words()
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for row in aligned_texts(words, rows):
            held.append(row)
            size += len(row[6]) + 100
            if size >= CHUNK:
                yield packed(chunk, held)
                chunk, held, size = chunk + 1, [], 0
        if held:
            yield packed(chunk, held)
        words.clear()  # the worker goes on to other tasks

    with batch_rows(docs.sparkSession, 200):
        return stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl))


def token_links(docs: DataFrame, first: str, fast: bytes, pattern: str, second: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: tokens of both tokenizers, groups between common ends, links of overlapping tokens, and how common they are.

    Columns: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``. A link is a pair of
    tokens, one of each tokenizer, whose byte ranges in space + text overlap. The count of a pair of ids is
    the number of rows that have such a link; ``n_best`` are links whose count is the highest of their
    first id, ``count_sum`` adds the counts up.

    A chunk's different links travel, not each document's. Counts are sums over chunks; the highest of
    each id are no more rows than the vocabulary has, whatever the data, and are broadcast.

    Null or empty text, or one that the tokens do not give back byte for byte (characters that the second
    tokenizer rewrites, U+2581 itself): zeros and an empty string. Null id: the row returns with it.
    Repeated rows: each returns, and counts as a document. Ties for the highest count: all of them. Very long
    texts: aligned a block of words at a time, with the same result; a text without spaces is one word.
    Empty table: empty result. Extra columns are ignored.
    """
    spark = docs.sparkSession
    shipped = Shipped(spark, Vocabularies(first, fast, pattern, second))
    wide = vocabulary_size(second)
    table = link_tables(docs, shipped, id_col, text_col)
    links = table.where("codes is not null").select("chunk", F.posexplode(F.arrays_zip("codes", "docs")).alias("place", "z"))
    links = links.select("chunk", "place", F.col("z.codes").alias("code"), F.col("z.docs").alias("docs"))
    counts = stored(links.groupBy("code").agg(F.sum("docs").alias("n")))
    first_id = F.expr(f"code div {wide}L")
    top = counts.groupBy(first_id.alias("a")).agg(F.max("n").alias("most"))
    counts = stored(counts.withColumn("a", first_id).join(F.broadcast(top), "a").select("code", "n", (F.col("n") == F.col("most")).alias("best")))
    answers = links.join(counts, "code").select(F.col("chunk").alias("of"), "place", "n", "best")
    told = table.where("codes is null").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times")
    return told.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(
        summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )


def summed(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """A chunk's documents with the counts of their links."""
    size = answers.num_rows
    n, best = np.zeros(size, np.int64), np.zeros(size, bool)
    if size:
        place = answers.column("place").to_numpy()
        n[place] = answers.column("n").to_numpy()
        best[place] = answers.column("best").to_numpy()
    n_best, count_sum = [], []
    for at, times in zip(docs.column("places").to_pylist(), docs.column("times").to_pylist(), strict=True):
        at, times = np.frombuffer(at, np.uint32), np.frombuffer(times, np.uint32).astype(np.int64)
        n_best.append(int(times[best[at]].sum()))
        count_sum.append(int((times * n[at]).sum()))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    columns = {c: docs.column(c) for c in names if c in docs.column_names} | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.table([columns[c] for c in names], names=names)


def vocabulary_size(second: bytes) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=second).get_piece_size()


def public_vocabularies(name_of: Callable[[str], str] | None = None) -> tuple[str, bytes, str, bytes]:
    """The public vocabularies of this machine (their places are a parameter of every caller)."""
    import public_tokenizers

    name_of = name_of or public_tokenizers.path
    names = [name_of(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
    with open(names[0], encoding="utf-8") as one, open(names[1], "rb") as fast, open(names[2], "rb") as two:
        return one.read(), fast.read(), public_tokenizers.PATTERN, two.read()
