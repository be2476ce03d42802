"""Token ids as fixed-width packed blocks (operator 1).

Texts are dealt by range of doc_id and tokenized; each task writes one shard, its documents in ascending order.  A
shard is a Parquet file whose rows are blocks: whole documents up to about ``block_ids`` ids (a longer document
is a block of its own).  A block holds its ids in ``bits`` bits each, the fewest that the vocabulary needs, beside the
documents' offsets.  Id k of a block stands at bit k * bits, so any slice is unpacked with numpy without the ids
before it, and a document is found through the file's statistics on first_doc and last_doc.

Null texts count as empty and hold the end id alone.  Rows that repeat an id stay apart, in order of their text.
Rows with a null id come first.  An empty table writes no block.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textops import mix, small_batches, stored

#: Distinct pieces of text whose ids a worker remembers before it starts anew (some 150 bytes each), and slots of its table of them.
MEMORY = 600_000
SLOTS = 1 << 22
_LONG = 16  # bytes; a longer piece is looked up by itself
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LETTER, _DIGIT, _SIGN, _QUOTE, _BLANK, _BREAK = range(1, 7)  # 0: control characters and all beyond ASCII
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _SIGN
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58], _KIND[39], _KIND[32], _KIND[9:14] = _DIGIT, _QUOTE, _BLANK, _BREAK
_DOUBTFUL = np.array([0x7F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF], np.uint8)  # 127, and first bytes of white space beyond ASCII
#: Kinds of two neighbours between which the pre-tokenizer always begins a token.  A quote may begin a contraction and a blank may belong to what follows.
_PARTED = np.zeros((7, 7), bool)
for _one, _next in {
    _LETTER: (_DIGIT, _SIGN, _QUOTE, _BLANK, _BREAK), _DIGIT: (_LETTER, _SIGN, _QUOTE, _BLANK, _BREAK), _SIGN: (_LETTER, _DIGIT, _BLANK, _BREAK),
    _QUOTE: (_BLANK, _BREAK), _BREAK: (_LETTER, _DIGIT, _SIGN, _QUOTE),
}.items():
    _PARTED[_one, _next] = True
_PARTED = _PARTED.ravel()


def bits_for(ids: int) -> int:
    """Bits that hold every id below ``ids``."""
    return max(1, (ids - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first.  An id that needs more bits is an error."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """The ids start..stop of a packed block, without reading those before."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", stop - start, start * bits // 8).astype(np.uint32)
    low, high = start * bits, stop * bits
    raw = np.unpackbits(np.frombuffer(payload, np.uint8, (high + 7) // 8 - low // 8, low // 8), bitorder="little")
    return (raw[low % 8 : low % 8 + high - low].reshape(-1, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def _solid(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is surely no white space.

    Beyond ASCII, the exceptions hold the white space of any definition, and some more: leaving a place out is always right.
    """
    one, two, three = data[at - 1], data[at - 2], data[at - 3]
    loose = one <= 0x20
    far = np.flatnonzero(one >= 0x80)
    one, two, three = one[far], two[far], three[far]
    latin = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    general = (three == 0xE2) & ((two == 0x80) & ((one <= 0x8F) | (one >= 0xA8) & (one <= 0xAF)) | (two == 0x81) & (one >= 0x9F) & (one <= 0xAF))
    other = (three == 0xE1) & (((two == 0x9A) & (one == 0x80)) | ((two == 0xA0) & (one == 0x8E))) | (three == 0xE3) & (two == 0x80) & (one == 0x80) | (three == 0xEF) & (two == 0xBB) & (one == 0xBF)
    loose[far] = latin | general | other
    return ~loose


def _cuts(data: np.ndarray, low: int) -> np.ndarray:
    """Places after ``low`` where a token begins whatever else the text holds."""
    kind = _KIND[data[low:]]
    at = np.flatnonzero(_PARTED[kind[:-1] * np.uint8(7) + kind[1:]])
    before = kind[at - 1]  # of several breaks the last one is a token of its own, but not where a text ends there: only single ones part
    at = at[(kind[at] != _BREAK) | (at > 0) & (before > 0) & (before < _BLANK)] + low + 1
    far = np.flatnonzero((kind[1:] == _BLANK) & (kind[:-1] == 0)) + low + 1
    return np.concatenate([at, far[_solid(data, far)]])


def _fresh(*keys: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


class Encoder:
    """Byte-level BPE of whole texts.

    A text is encoded piece by piece between places where a token begins whatever else the text holds (``_cuts``), and each
    distinct piece only once while it is remembered.  Pieces of up to 16 bytes are found many
    at a time: their first and last eight bytes and their length are the key, compared exactly, and a hash of it the slot
    of a table.  New pieces are encoded many at a time in one string; the lengths of the tokens in bytes tell which
    belong to which piece.  Longer pieces are remembered within a batch only.
    """

    def __init__(self, path: str, end_id: int | None = None):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.path, self.whole = path, None
        self.literals = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lengths = np.array([len(self.tokenizer.id_to_token(k) or "") for k in range(self.tokenizer.get_vocab_size())], np.int64)
        self.end = np.array([] if end_id is None else [end_id], np.uint32)
        self.forget()

    def forget(self) -> None:
        self.used = 1  # piece 0 is the end of a document
        self.keys = np.zeros((3, 1 << 14), np.uint64)  # first and last eight bytes, length
        self.first, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.count[0] = len(self.end)
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), len(self.end)
        self.ids[: self.n_ids] = self.end
        self.slot = np.zeros(SLOTS, np.int32)  # piece of each slot; 0: none

    def with_literals(self, text: str) -> list[int]:
        """Ids of a text that holds the literal of an added token, which is one id: such texts are rare, so their tokenizer waits for the first one."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.whole.encode(text, add_special_tokens=False).ids

    def plainly(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of new pieces, with their ids in the table."""
        kind, then = _KIND[data[start]], data[start + 1]
        joins = _solid(data, end) & (kind > 0) & (kind != _BREAK) & ((kind != _BLANK) | (then > 0x20) & ~np.isin(then, _DOUBTFUL))
        together, alone = np.flatnonzero(joins), np.flatnonzero(~joins)
        upto = np.cumsum(size := (end - start)[together] + 1)  # each after a line feed, which stays a token of its own
        text = data[np.repeat(start[together] - 1 - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]
        text[upto - size] = 0x0A
        raw, edge = text.tobytes(), [0, *upto[63::64].tolist(), *upto[-1:].tolist()]
        parts = self.plainly([raw[i:j].decode() for i, j in zip(edge[:-1], edge[1:], strict=True) if i < j])
        got = np.concatenate([np.empty(0, np.uint32), *parts])
        ends = np.cumsum(self.lengths[got])
        begin, cut = np.searchsorted(ends, upto - size + 1) + 1, np.searchsorted(ends, upto) + 1
        if not (np.array_equal(ends[cut - 1], upto) and np.array_equal(ends[begin - 1], upto - size + 1)):
            raise ValueError("tokens do not end where pieces do")
        got = np.delete(got, begin - 1)
        cut = cut - np.arange(1, len(cut) + 1)
        single = self.plainly([data[i:j].tobytes().decode() for i, j in zip(start[alone].tolist(), end[alone].tolist(), strict=True)])
        ids = np.concatenate([got, *single])
        per = np.concatenate([np.diff(cut, prepend=0), np.array([len(x) for x in single], np.int64)]).astype(np.int64)
        numbers = np.arange(self.used, self.used + len(per))
        while self.used + len(per) > len(self.first):
            self.first, self.count = np.append(self.first, np.zeros_like(self.first)), np.append(self.count, np.zeros_like(self.count))
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)], axis=1)
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.first[numbers], self.count[numbers] = self.n_ids + np.cumsum(per) - per, per
        self.used, self.n_ids = self.used + len(per), self.n_ids + len(ids)
        out = np.empty(len(start), np.int64)
        out[np.concatenate([together, alone])] = numbers
        return out

    def pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The numbers of pieces of ``data``, which has eight bytes before the first and after the last."""
        size = (end - start).astype(np.uint64)
        loads = np.ndarray(len(data) - 7, "<u8", data.data, strides=(1,))
        within = np.minimum(size, np.uint64(8))
        head = loads[start] & _MASK[within.astype(np.int64)]
        tail = loads[end - 8] >> (np.uint64(64) - np.uint64(8) * within)  # no piece is empty
        key = mix(head ^ mix(tail + size))
        slots = [(key >> np.uint64(k)).astype(np.int64) & (SLOTS - 1) for k in (42, 20)]
        number, ask = np.zeros(len(start), np.int64), np.flatnonzero(size <= _LONG)
        for slot in slots:  # a piece stands in the first slot or, where another was there, in the second
            n = self.slot[slot[ask]].astype(np.int64)
            hit = (self.keys[0, n] == head[ask]) & (self.keys[1, n] == tail[ask]) & (self.keys[2, n] == size[ask])
            number[ask] = np.where(hit, n, 0)
            ask = ask[~hit]
        order = ask[np.argsort(key[ask])]
        fresh = _fresh(head[order], tail[order], size[order])
        one = order[fresh]
        if len(one):
            made = self.learn(data, start[one], end[one])
            self.keys[0, made], self.keys[1, made], self.keys[2, made] = head[one], tail[one], size[one]
            number[order] = made[np.cumsum(fresh) - 1]
            free = self.slot[slots[0][one]] == 0
            self.slot[np.where(free, slots[0][one], slots[1][one])] = made  # who was there before is learned anew when it comes again
        far = np.flatnonzero(size > _LONG)
        if len(far):
            at: dict[bytes, int] = {}
            for i, k in enumerate(far.tolist()):
                at.setdefault(data[start[k] : end[k]].tobytes(), i)
            first = far[list(at.values())]
            made = dict(zip(at, self.learn(data, start[first], end[first]).tolist(), strict=True))
            number[far] = [made[data[start[k] : end[k]].tobytes()] for k in far.tolist()]
        return number

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), each with the end id, one after the other, and how many each text has."""
        if self.used > MEMORY or self.n_ids > 16 * MEMORY:
            self.forget()
        texts = texts.cast(pa.large_string()).fill_null("")
        marked = np.zeros(len(texts), bool)
        for literal in self.literals:
            marked |= pc.match_substring(texts, literal).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(marked), pa.scalar("", pa.large_string()), texts) if marked.any() else texts
        _, offsets, values = plain.buffers()
        bounds = np.frombuffer(offsets, np.int64)[plain.offset : plain.offset + len(plain) + 1]
        raw = np.frombuffer(values, np.uint8) if values is not None and values.size else np.empty(0, np.uint8)
        data = np.concatenate([np.zeros(8, np.uint8), raw[bounds[0] : bounds[-1]], np.zeros(8, np.uint8)])
        bounds = bounds - bounds[0] + 8
        edges = np.sort(np.concatenate([bounds, _cuts(data[: bounds[-1]], 8)]))
        edges = edges[_fresh(edges)]
        number = self.pieces(data, edges[:-1], edges[1:])
        last = np.searchsorted(edges, bounds)  # pieces before the end of each text
        number = np.insert(number, last[1:], 0)
        per = self.count[number]
        upto = np.cumsum(per)
        ids = self.ids[np.repeat(self.first[number] - upto + per, per) + np.arange(upto[-1] if len(per) else 0)]
        counts = np.diff(np.concatenate([[0], upto])[last + np.arange(len(last))])
        if marked.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in np.flatnonzero(marked).tolist():
                parts[k] = np.append(np.array(self.with_literals(texts[k].as_py()), np.uint32), self.end)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _ENCODERS:  # one for each Python worker, kept between its tasks
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


_BLOCK = pa.schema([("block", pa.int32()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])
_BLOCK_SQL = "block int, n_ids long, bits int, first_doc long, last_doc long, doc_ids array<long>, offsets array<long>, payload binary"


def _blocks(path: str, end_id: int, bits: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, docs, parts, held, number = _encoder(path, end_id), [], [], 0, 0

        def block() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            known = [d for d in docs if d is not None]
            row = [number, int(offsets[-1]), bits, known[0] if known else None, known[-1] if known else None, docs, offsets.tolist(), pack(np.concatenate(parts), bits)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

        for batch in small_batches(batches, "text"):
            ids, counts = encoder.encode(batch.column("text"))
            at = 0
            for doc, n in zip(batch.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                docs.append(doc)
                parts.append(ids[at : at + n])
                at, held = at + n, held + n
                if held >= block_ids:
                    yield block()
                    docs, parts, held, number = [], [], 0, number + 1
        if docs:
            yield block()

    return run


def write_tokens(docs: DataFrame, path: str, end_id: int, vocabulary: int | None = None, block_ids: int = 65536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize whole texts with the vocabulary file at ``path``, write the shards, and return them as read again.

    ``vocabulary`` is the number of ids, that of the file where it is not given; a larger id is an error.
    """
    if vocabulary is None:
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(path).get_vocab_size()
    if not 0 <= end_id < vocabulary:
        raise ValueError(f"end id {end_id} is outside the vocabulary of {vocabulary}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    shards = dealt.mapInArrow(_blocks(path, end_id, bits_for(vocabulary), block_ids), _BLOCK_SQL).withColumn("shard", F.spark_partition_id())
    return stored(shards, "tokens")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):  # one block at a time
            row = batch.slice(k, 1).to_pylist()[0]
            ids = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
            n, cut = len(row["doc_ids"]), row["offsets"]
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([row["shard"]] * n, pa.int32()), "block": pa.array([row["block"]] * n, pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "inside": pa.array(cut[:-1], pa.int64()), "n_tokens": pa.array(np.diff(cut).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64()),
            })


def token_index(shards: DataFrame) -> DataFrame:
    """Read the shards: one row per document with start (ids of all documents before it), n_tokens and ids_crc32.

    Starts come from running sums of blocks within a shard and of shards; only counts are summed, never ids.
    """
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = shards.select("shard", "block", "n_ids").withColumn("in_shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    totals = shards.groupBy("shard").agg(F.sum("n_ids").alias("all"))  # one row a shard
    totals = totals.withColumn("base", F.coalesce(F.sum("all").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("all")
    starts = blocks.join(totals, "shard").select("shard", "block", (F.col("in_shard") + F.col("base")).alias("at"))
    found = shards.select("shard", "block", "bits", "n_ids", "doc_ids", "offsets", "payload").mapInArrow(_documents, "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["shard", "block"]).select("doc_id", (F.col("at") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "shard", "block", "inside")
