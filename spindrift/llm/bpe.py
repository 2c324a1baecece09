"""Byte-level BPE as a streaming transducer with bounded lookahead, and a streaming decoder."""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shipped, record_batch, small_batches

#: Fixed values of the public byte-level vocabulary: how text is split before the merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces in each half of the cache that a task keeps; a full half replaces the older one.
CACHE = 150_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such vocabulary files, letter to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary with its merge list, as plain tables that ship to executors."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int]):
        self.text = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in special.items()}
        self.special = special
        self.single = [vocab.get(bytes([b])) for b in range(256)]
        self.rank = {(vocab[a] << 32) | vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.longest = max(map(len, vocab), default=1)
        self.lookahead = sufficient_lookahead(merges)

    @classmethod
    def from_json(cls, content: str) -> Merges:
        """From the text of a ``tokenizers`` file of kind byte-level BPE without a normaliser."""
        spec, letters = json.loads(content), byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        return cls(vocab, [(raw(a), raw(b)) for a, b in pairs], special)


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes right of a possible boundary that can still change whether a merge across it happens.

    Rule ``r`` joins ``u`` and ``v``. It fails if an earlier rule takes ``v`` first, joined with what
    follows, which in turn depends on still earlier rules that start with the right part of that
    one; or if ``v`` is not formed at all, because an earlier rule takes ``v``'s own right part.
    One pass in order of rank finds the longest such chain.
    """
    reach: dict[bytes, int] = {}
    formed: dict[bytes, tuple[bytes, int]] = {}
    most = 1
    for u, v in merges:
        far = len(v) + reach.get(v, 0)
        inner = formed.get(v)
        if inner:
            far = max(far, len(inner[0]) + inner[1])
        reach[u] = max(reach.get(u, 0), far)
        formed.setdefault(u + v, (u, far))
        most = max(most, far)
    return most


def merge_all(ids: list[int], rank: dict, made: list) -> list[int]:
    """Apply the merges in order of rank, the leftmost first, to a short list of ids."""
    none = len(made)
    get = rank.get
    ranks = [get((a << 32) | b, none) for a, b in zip(ids, ids[1:], strict=False)]
    while ranks:
        best = min(ranks)
        if best == none:
            break
        i = ranks.index(best)
        new = made[best]
        ids[i : i + 2] = (new,)
        del ranks[i]
        if i:
            ranks[i - 1] = get((ids[i - 1] << 32) | new, none)
        if i < len(ranks):
            ranks[i] = get((new << 32) | ids[i + 1], none)
    return ids


def transduce(piece: Iterable[int], m: Merges) -> Iterator[int]:
    """Ids of one piece, read byte by byte, with memory that does not grow with the piece.

    The buffer holds a few times the longest token and the lookahead. A token that ends at least
    the lookahead before the buffer's end is stable: no byte that follows can change it, and what
    follows it encodes as if it stood alone. So it is emitted and its bytes are let go.
    """
    room = 2 * (m.longest + m.lookahead)
    buffer = bytearray()
    for byte in piece:
        buffer.append(byte)
        if len(buffer) >= room:
            end = 0
            for token in merge_all([m.single[b] for b in buffer], m.rank, m.made):
                size = len(m.text[token])
                if end + size > len(buffer) - m.lookahead:
                    break
                end += size
                yield token
            del buffer[:end]
    yield from merge_all([m.single[b] for b in buffer], m.rank, m.made)


class Encoder:
    """Encodes texts; keeps the ids of the latest pieces, packed, in a cache of bounded size."""

    def __init__(self, merges: Merges):
        self.merges, self.young, self.old = merges, {}, {}
        self.decimal = {i: b"%d" % i for i in merges.text}
        self.split = regex.compile(SPLIT)
        names = "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))
        self.cut = regex.compile(names) if names else None

    def piece(self, text: str) -> bytes:
        """The ids as four bytes each."""
        found = self.old.get(text)
        if found is None:
            m, data = self.merges, text.encode()
            short = len(data) < 2 * (m.longest + m.lookahead)  # what the transducer would keep whole
            ids = merge_all([m.single[b] for b in data], m.rank, m.made) if short else transduce(data, m)
            found = array("i", ids).tobytes()
        if len(text) <= 64:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[text] = found
        return found

    def encode(self, text: str) -> Iterator[bytes]:
        """The packed ids of each piece of the text in order; special tokens stand for themselves."""
        at = 0
        for hit in self.cut.finditer(text) if self.cut else ():
            yield from self._plain(text[at : hit.start()])
            yield array("i", [self.merges.special[hit[0]]]).tobytes()
            at = hit.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> Iterator[bytes]:
        get, piece = self.young.get, self.piece
        pieces = self.split.findall(text) if len(text) <= 1 << 20 else (hit[0] for hit in self.split.finditer(text))
        for p in pieces:
            yield get(p) or piece(p)


class Decoder:
    """Tokens to text: holds back the bytes of an unfinished character only."""

    def __init__(self, merges: Merges):
        self.text = merges.text
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.state.decode(b"".join(map(self.text.__getitem__, ids)), final)


def round_trip(text: str, encoder: Encoder, keep_ids: bool, keep_text: bool, block: int = 8192) -> tuple[int, str, str, np.ndarray, str]:
    """Number of ids, both hashes, and the ids and the decoded text if they are to be kept, in blocks of pieces."""
    n, said, back = 0, hashlib.sha256(), hashlib.sha256()
    ids, plain = [np.zeros(0, np.int32)], []
    decoder, pieces = Decoder(encoder.merges), encoder.encode(text)
    while some := list(islice(pieces, block)):
        packed = np.frombuffer(b"".join(some), np.int32)
        own = packed.tolist()
        said.update((b"," if n else b"") + b",".join(map(encoder.decimal.__getitem__, own)))
        n += len(own)
        chunk = decoder.feed(own)
        back.update(chunk.encode())
        if keep_ids:
            ids.append(packed)
        if keep_text:
            plain.append(chunk)
    rest = decoder.feed((), True)
    back.update(rest.encode())
    return n, said.hexdigest(), back.hexdigest(), np.concatenate(ids), "".join([*plain, rest])


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of each row, and ``ids`` or ``decoded`` if asked for.

    ``vocabulary`` is the path of a ``tokenizers`` file on the driver; its tables are shipped once to
    each executor (about 50,000 entries, whatever the data). Ids equal those of that library without
    added special tokens; a special token's own string in a text gets its id.

    Null or empty text: no ids, both hashes those of the empty string. Null id: the row returns with
    it. Repeated rows: each returns. Empty table: empty result. Extra columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary, encoding="utf-8") as file:
        shipped = Shipped(spark, Merges.from_json(file.read()))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        ddl += ", ids array<int>"
    if keep_text:
        fields.append(("decoded", pa.string()))
        ddl += ", decoded string"
    schema = pa.schema(fields)
    parts = [0, 1, 2, *([3] if keep_ids else []), *([4] if keep_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The cache goes with its task: Spark keeps more workers than run at a time, and idle ones would each hold one.
        encoder = Encoder(shipped.value)
        for batch in batches:
            done = [round_trip(t or "", encoder, keep_ids, keep_text) for t in batch.column(1).to_pylist()]
            yield record_batch(schema, (batch.column(0), *([x[i] for x in done] for i in parts)))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def vocabulary_path(spark: SparkSession | None = None) -> str:
    """The public byte-level vocabulary of this machine (a parameter of every caller)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
