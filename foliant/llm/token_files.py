"""Token-id files coded by a static range asymmetric numeral system.

One frequency table, counted over all ids, is shared by all files. A file is a run of blocks; each holds whole documents and
is coded by itself in interleaved lanes, with its lane states, its documents' lengths and a checksum, so that any block can be
decoded by any task. An index table has a checkpoint for every block: file, place, bytes, and the ids that lie before it.

Layout of a block, little endian: lane count, id count, word count, bytes of the document list (four unsigned 32-bit integers);
the lane states (64 bits each); the words (32 bits each); the document list as an Arrow stream (doc_id, n_tokens); CRC-32 of all this.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_dir, held, small_batches, written
from .files import make_dir, new_file, opened
from .units import UnitMemory

MAGIC = b"TKRANS01"
#: Bits of the frequency table's total; lanes of a block; ids after which a block ends.
BITS, LANES, BLOCK_IDS = 20, 2048, 1 << 19
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
#: Units that go to the library at once.
LINES = 256


class Table:
    """Frequencies that sum to 2**bits; every symbol that was counted has one of at least 1."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray, bits: int) -> None:
        self.symbols, self.freq, self.bits = symbols.astype(np.uint32), freq.astype(np.uint64), bits
        self.cum = np.cumsum(self.freq) - self.freq
        top = int(symbols.max()) + 1 if len(symbols) else 0
        self.place = np.full(top, -1, dtype=np.int64)
        self.place[symbols] = np.arange(len(symbols))
        self.slots = np.repeat(np.arange(len(symbols), dtype=np.int32), freq.astype(np.int64))

    def __getstate__(self) -> tuple:
        return self.symbols, self.freq, self.bits

    def __setstate__(self, s: tuple) -> None:
        self.__init__(*s)

    @classmethod
    def of(cls, symbols: np.ndarray, counts: np.ndarray, bits: int = BITS) -> Table:
        bits = max(bits, int(max(1, len(symbols)) - 1).bit_length() + 1)
        if not len(symbols):
            return cls(symbols.astype(np.int64), counts.astype(np.int64), bits)
        order = np.argsort(symbols, kind="stable")
        symbols, counts = symbols[order].astype(np.int64), counts[order].astype(np.float64)
        freq = np.maximum(1, np.floor(counts / counts.sum() * (1 << bits))).astype(np.int64)
        over = int(freq.sum()) - (1 << bits)
        for i in np.argsort(-freq, kind="stable"):
            if over <= 0:
                freq[i] -= over
                break
            cut = min(over, int(freq[i]) // 2)
            freq[i] -= cut
            over -= cut
        return cls(symbols, freq, bits)


def coded(ids: np.ndarray, table: Table, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """(lane states, words) of ids. Id i belongs to lane i mod the number of lanes."""
    n = len(ids)
    lanes = max(1, min(lanes, n // 64 + 1))
    at = table.place[ids]
    if n and at.min() < 0:
        raise ValueError("an id is not in the frequency table")
    freq, cum, bits = table.freq[at], table.cum[at], np.uint64(table.bits)
    state = np.full(lanes, _LOW, dtype=np.uint64)
    groups = []
    for begin in range((n - 1) // lanes * lanes if n else -1, -1, -lanes):
        f, c = freq[begin : begin + lanes], cum[begin : begin + lanes]
        x = state[: len(f)]
        out = (x >> np.uint64(63 - table.bits)) >= f
        if out.any():
            groups.append(x[out].astype(np.uint32))
            x = np.where(out, x >> _32, x)
        q = x // f
        state[: len(f)] = (q << bits) + (x - q * f) + c
    return state, np.concatenate(groups[::-1]) if groups else np.zeros(0, np.uint32)


def uncoded(state: np.ndarray, words: np.ndarray, n: int, table: Table) -> np.ndarray:
    lanes, bits, mask = len(state), np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    state, words, at = state.copy(), words.astype(np.uint64), 0
    out = np.empty(n, dtype=np.int32)
    for begin in range(0, n, lanes):
        x = state[: min(lanes, n - begin)]
        slot = x & mask
        s = table.slots[slot.astype(np.int64)]
        out[begin : begin + len(x)] = s
        x = table.freq[s] * (x >> bits) + slot - table.cum[s]
        low = np.flatnonzero(x < _LOW)
        if len(low):
            x[low] = (x[low] << _32) | words[at : at + len(low)]
            at += len(low)
        state[: len(x)] = x
    if at != len(words) or (state != _LOW).any():
        raise ValueError("a block does not decode to its start")
    return table.symbols[out]


def block_bytes(ids: np.ndarray, docs: pa.RecordBatch, table: Table) -> bytes:
    state, words = coded(ids, table)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as w:
        w.write_batch(docs)
    listed = sink.getvalue().to_pybytes()
    body = struct.pack("<4I", len(state), len(ids), len(words), len(listed)) + state.astype("<u8").tobytes() + words.astype("<u4").tobytes() + listed
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(raw: bytes, table: Table) -> tuple[np.ndarray, pa.RecordBatch]:
    if len(raw) < 20 or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("a block's checksum does not hold")
    lanes, n, n_words, listed = struct.unpack_from("<4I", raw)
    state = np.frombuffer(raw, "<u8", lanes, 16)
    words = np.frombuffer(raw, "<u4", n_words, 16 + 8 * lanes)
    at = 16 + 8 * lanes + 4 * n_words
    docs = pa.ipc.open_stream(raw[at : at + listed]).read_next_batch()
    return uncoded(state, words, n, table), docs


class _Encoder:
    """ids(column), as in UnitMemory, by the library's contract: a text that holds the content of an added token goes to the library whole, since the token can span units."""

    def __init__(self, tokenizer: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, t = Tokenizer.from_buffer(tokenizer), Tokenizer.from_buffer(tokenizer)
        self.added = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        # Units of the other texts hold no added token, so nothing need be looked for in them.
        t.encode_special_tokens = True
        self.plain, self.line = t, np.array(t.encode("\n", add_special_tokens=False).ids, "<u4")
        self.memory = UnitMemory(self._encode)

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units go to the library in lines, many at once: a line end after and before what is no white space is a pre-token, and its id shows where a unit ends."""
        lone = [i for i, u in enumerate(units) if "\n" in u or u[-1].isspace() or (u[0].isspace() and (u[0] != " " or u[1].isspace()))]
        groups, at = [], 0
        for i in [*lone, len(units)]:
            groups += [units[j : min(j + LINES, i)] for j in range(at, i, LINES)] + [units[i : i + 1]] * (i < len(units))
            at = i + 1
        flat, length = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for group, e in zip(groups, self.plain.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            if len(group) > 1:
                ends = np.flatnonzero(ids == self.line)
                if len(ends) != len(group) - 1:
                    raise ValueError("units of a line do not come apart")
                length.append(np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1)
                ids = np.delete(ids, ends)
            else:
                length.append(np.array([len(ids)]))
            flat.append(ids)
        return np.concatenate(flat), np.concatenate(length)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = np.zeros(len(column), dtype=bool)
        for a in self.added:
            odd |= pc.match_substring(column, a).fill_null(False).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.memory.ids(column)
        got = [np.array(e.ids, "<u4") for e in self.whole.encode_batch_fast(column.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)]
        flat, per = self.memory.ids(pc.if_else(pa.array(odd), pa.scalar(None, column.type), column))
        sizes = [len(x) for x in got]
        flat = np.insert(flat, np.repeat(np.cumsum(per)[odd], sizes), np.concatenate(got))
        per[odd] = sizes
        return flat, per


def token_rows(docs: DataFrame, tokenizer: bytes, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (the end id included, compressed) for each document."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(tokenizer)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, press = held(f"tokens-{zlib.crc32(shipped.value)}", lambda: _Encoder(shipped.value)), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            flat, per = memory.ids(batch.column(1))
            flat = np.insert(flat, np.cumsum(per), end_id).astype("<u4")
            ends = np.cumsum(per + 1)
            raw, cut = memoryview(flat.tobytes()), [0, *ends.tolist()]
            ids = [press.compress(raw[4 * a : 4 * b]) for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(per + 1, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, ids binary")


def frequency_table(rows: DataFrame, bits: int = BITS) -> Table:
    """Counts over all ids; what comes to the driver is one row for each entry of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, n = zstandard.ZstdDecompressor(), np.zeros(0, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(unpack.decompress(x) for x in batch.column(0).to_pylist()), "<u4")
            more = np.bincount(ids)
            n = np.pad(n, (0, max(0, len(more) - len(n))))
            n[: len(more)] += more
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["id", "n"])

    got = rows.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return Table.of(got["id"].to_numpy(np.int64), got["n"].to_numpy(np.int64), bits)


def write_token_files(docs: DataFrame, tokenizer: bytes, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> tuple[DataFrame, Table]:
    """Writes the files and returns their index (path, file_no, offset, bytes, docs, ids, start) and the frequency table.

    Documents lie in ascending id order (null first; rows that repeat an id lie next to one another in the order of their ids'
    bytes). A null text is empty, so the end id alone stands for it. An empty table gives an index without rows. Other columns
    are not read. A task that is run again writes files of other names, and the index has those of one attempt only.
    """
    spark = docs.sparkSession
    rows = written(token_rows(docs, tokenizer, end_id, id_col, text_col), "op4-ids", "uncompressed")
    table = frequency_table(rows)
    folder = folder or fresh_dir(spark, "op4-files")
    make_dir(folder)
    shipped = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, no = zstandard.ZstdDecompressor(), TaskContext.get().partitionId()
        first = next(batches, None)
        if first is None:
            return
        index: list[tuple] = []
        with new_file(folder, f"ids-{no:06d}", ".rans") as (f, name):
            f.write(MAGIC)
            at = len(MAGIC)
            kept: list[pa.RecordBatch] = []
            ids: list[bytes] = []
            n = 0

            def flush() -> None:
                nonlocal at, kept, ids, n
                if kept:
                    flat = np.frombuffer(b"".join(ids), "<u4")
                    listed = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                    raw = block_bytes(flat, listed, shipped.value)
                    f.write(raw)
                    index.append((name, no, at, len(raw), listed.num_rows, len(flat)))
                    at, kept, ids, n = at + len(raw), [], [], 0

            def cuts() -> Iterator[pa.RecordBatch]:
                yield first
                yield from batches

            for batch in cuts():
                sizes, begin = batch.column(1).to_pylist(), 0
                for i, size in enumerate(sizes):
                    n += size
                    if n >= block_ids or i == len(sizes) - 1:
                        kept.append(batch.slice(begin, i + 1 - begin).select(["doc_id", "n_tokens"]))
                        ids += [unpack.decompress(x) for x in batch.column(2).slice(begin, i + 1 - begin).to_pylist()]
                        begin = i + 1
                        if n >= block_ids:
                            flush()
            flush()
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], names=["path", "file_no", "offset", "bytes", "docs", "ids"])

    blocks = written(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids").mapInArrow(run, "path string, file_no int, offset bigint, bytes bigint, docs bigint, ids bigint"), "op4-index")
    # One row for each file meets in the second window; the first runs inside each file.
    before = Window.orderBy("file_no")
    files = blocks.groupBy("file_no").agg(F.sum("ids").alias("n")).select("file_no", (F.sum("n").over(before) - F.col("n")).alias("base"))
    inside = Window.partitionBy("file_no").orderBy("offset")
    return blocks.join(files, "file_no").select("path", "file_no", "offset", "bytes", "docs", "ids", (F.col("base") + F.sum("ids").over(inside) - F.col("ids")).alias("start")), table


def read_token_files(index: DataFrame, table: Table, id_type: str = "bigint", keep_ids: bool = False) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids. Blocks are decoded in any order, by any number of tasks."""
    spark = index.sparkSession
    shipped = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                with opened(b["path"]) as f:
                    f.seek(b["offset"])
                    ids, docs = read_block(f.read(b["bytes"]), shipped.value)
                per = docs.column(1).to_numpy()
                if len(ids) != b["ids"] or per.sum() != len(ids):
                    raise ValueError(f"a block of {b['path']} differs from the index")
                ends = np.cumsum(per)
                raw, cut = memoryview(ids.astype("<u4").tobytes()), [0, *ends.tolist()]
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(cut, cut[1:], strict=False)]
                columns = [docs.column(0), pa.array(b["start"] + ends - per, pa.int64()), docs.column(1), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.asarray(cut, dtype=np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids])

    small = index.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "path", "offset").select("path", "offset", "bytes", "ids", "start")
    return small.mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids)


def op4_query(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    with open(tokenizer_path, "rb") as f:
        index, table = write_token_files(docs, f.read(), end_id)
    return read_token_files(index, table, docs.schema["doc_id"].dataType.simpleString())
