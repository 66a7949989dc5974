"""Token ids as binary shards: frequency-ranked ids, byte-aligned variable-length coding.

Three passes. (1) Every text is encoded once; its ids, and each task's counts of them, are
written to the shared folder. (2) The counts are added up over the whole corpus and ids are ranked, most
frequent first, so that common tokens take one byte. (3) The ids are range-partitioned by the order
columns, sorted, and written as shards; a manifest says where each shard starts.

A shard keeps the control bytes apart from the data bytes: four values share one
control byte (two bits each: bytes in the value less one), so a decoder finds all
value positions by looking control bytes up in fixed tables, without a branch.

Layout of a shard, little-endian: magic (8 bytes), n_docs u64, n_tokens u64,
n_control u64, n_data u64, doc ids i64[n_docs], null flags u8[n_docs],
lengths u64[n_docs], control u8[n_control], data u8[n_data].
``ranks.bin`` beside the shards holds the vocabulary: u32 id of each rank.

Cases: a null text counts as empty (just the end id); a null doc_id is kept and sorts
first; repeated ids are all kept, ordered by their tokens; an empty table writes an
empty manifest. Other columns are ignored. Shards are written under a name of the
attempt and then moved, so a repeated task leaves the same file.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import discard, fresh_path, materialize, shuffle_partitions, slices, tidy

MAGIC = b"CRNTOK01"
HEADER = struct.Struct("<8sQQQQ")
#: Tokens in a shard, and in the pieces in which it is decoded.
SHARD_TOKENS, CHUNK_TOKENS = 1 << 24, 1 << 20
#: Text that is encoded at a time; what a task's remembered words may take, and what each takes besides its letters and ids.
SLICE_BYTES, WORD_BYTES, WORD_OVERHEAD = 8 << 20, 32 << 20, 200
#: What a worker's remembered pieces take before no more are added, and the longest that is remembered.
PIECE_BYTES, LONG_PIECE = 40 << 20, 64

# Decoding tables, by control byte: bytes of each of the four values, their offsets, their sum.
LANE_BYTES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1
LANE_START = np.cumsum(LANE_BYTES, axis=1) - LANE_BYTES
GROUP_BYTES = LANE_BYTES.sum(axis=1)
VALUE_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    codes = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    codes[: len(v)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` values; decodes by looking control bytes up in the tables above."""
    if not count:
        return np.zeros(0, dtype=np.uint32)
    group_end = np.cumsum(GROUP_BYTES[control])
    at = ((group_end - GROUP_BYTES[control])[:, None] + LANE_START[control]).ravel()[:count]
    size = LANE_BYTES[control].ravel()[:count]
    padded = np.concatenate([data, np.zeros(4, dtype=np.uint8)]).astype(np.uint32)
    raw = padded[at] | padded[at + 1] << 8 | padded[at + 2] << 16 | padded[at + 3] << 24
    return raw & VALUE_MASK[size]


#: Fixed value: the pattern by which byte-level tokenizers break a text into words.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: white space, and what some libraries take for it, as the inside of a character class.
SPACES = r"\t-\r \x1c-\x1f\x85\xa0\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}"


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """Encodes texts with a tokenizer file, a slice of them at a time.

    A byte-level tokenizer without a normalizer always breaks before a space that a non-space
    follows, and around a line break between two non-spaces. So texts are cut there by Arrow, each
    piece that a slice holds is spelled once (broken into words by the tokenizer's pattern, words put
    to its model), and the ids of the slice are gathered with numpy. Texts with other white space after a
    space, with an added token of the tokenizer, and all texts of other tokenizers go to the library whole.
    Words are remembered until they take ``WORD_BYTES``, and only for the length of a task; pieces, as Arrow and numpy
    arrays, until they take ``PIECE_BYTES`` (and the last slice's), as long as the worker lives.
    """

    _own: dict[str, PieceEncoder] = {}

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.dtype, self.code = ("<u2", "H") if self.vocabulary <= 1 << 16 else ("<u4", "I")
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.byte_level = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.break_up = regex.compile(BYTE_LEVEL_PATTERN).findall
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.held = 0
        self.pieces, self.piece_ids, self.piece_ends = pa.array([], pa.string()), np.zeros(0, self.dtype), np.zeros(1, np.int64)

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def forget(self) -> None:
        """Lets all words go; called when a task ends."""
        self.words, self.held = {}, 0

    def _keep(self, piece: str, ids: bytes) -> bytes:
        if self.held < WORD_BYTES:
            self.words[piece] = ids
            self.held += WORD_OVERHEAD + len(piece) + len(ids)
        return ids

    def _ids(self, letters: str) -> bytes:
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is not None:
            return got
        if word.isascii() and word[1:].isalpha() and word[0] == " ":
            return self._keep(word, self._ids(self.letters[32] + word[1:]))
        return self._keep(word, self._ids(word.encode("utf-8", "replace").decode("latin-1").translate(self.letters)))

    def _spell(self, piece: str) -> bytes:
        # A space and letters are one word, and so is a mark after them; anything else goes through the pattern.
        if piece[:1] == " ":
            if piece[1:].isalpha():
                return self._word(piece)
            if piece[-1] in ".," and piece[1:-1].isalpha():
                return self._word(piece[:-1]) + self._word(piece[-1])
        return b"".join(map(self._word, self.break_up(piece)))

    def _spelled(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, laid end to end, and where in them each of ``distinct`` starts and ends; new pieces are remembered."""
        place = pc.index_in(distinct, value_set=self.pieces)
        new = distinct.filter(pc.is_null(place))
        got = [self._spell(p[1:] if p[1:2] == "\n" else p) for p in new.to_pylist()]
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // np.dtype(self.dtype).itemsize
        ids = np.frombuffer(b"".join(got), self.dtype)
        every = np.concatenate([self.piece_ids, ids])
        ends = np.concatenate([self.piece_ends, self.piece_ends[-1] + np.cumsum(sizes)])
        at = place.to_numpy(zero_copy_only=False)
        at = np.where(np.isnan(at), len(self.pieces) - 1 + np.cumsum(np.isnan(at)), at).astype(np.int64) if len(new) else at.astype(np.int64)
        if len(new) and self.pieces.nbytes + self.piece_ids.nbytes + self.piece_ends.nbytes < PIECE_BYTES:
            short = pc.less_equal(pc.binary_length(new), LONG_PIECE).to_numpy(zero_copy_only=False)
            self.pieces = pa.concat_arrays([self.pieces, new.filter(pa.array(short))])
            self.piece_ids = np.concatenate([self.piece_ids, ids[np.repeat(short, sizes)]])
            self.piece_ends = np.concatenate([self.piece_ends, self.piece_ends[-1] + np.cumsum(sizes[short])])
        return every, ends[at], ends[at + 1]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with ``end_id`` after it, and how many each has; null counts as empty."""
        n, end = len(texts), np.array([] if end_id is None else [end_id], self.dtype)
        texts = pc.fill_null(texts, "")
        cut = np.full(n, bool(self.byte_level))
        if self.byte_level:
            cut &= ~_matches(texts, f" [{SPACES}]| $")
            for token in self.added:
                cut &= ~pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        whole = np.nonzero(~cut)[0]
        ids, sizes = self._gather(texts.filter(pa.array(cut)) if len(whole) else texts, end)
        if not len(whole):
            return ids, sizes
        parts: list = [None] * n
        for i, got in zip(np.nonzero(cut)[0].tolist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=False):
            parts[i] = got
        for i, got in zip(whole.tolist(), self._whole(texts.take(pa.array(whole)).to_pylist()), strict=True):
            parts[i] = np.concatenate([got, end])
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _gather(self, texts: pa.Array, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        # A line break between non-spaces is written " \n", which no such text holds itself.
        single = ~_matches(texts, f"[{SPACES}]\n|\n[{SPACES}]|\n$|^\n")
        texts = pc.if_else(pa.array(single), pc.replace_substring(texts, "\n", " \n"), texts)
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        offsets -= offsets[0]
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        heads = [b"".join(map(self._word, self.break_up(p))) for p in coded.dictionary.take(pa.array(at[offsets[:-1]])).to_pylist()]
        flat, starts, ends = self._spelled(pc.binary_join_element_wise("", coded.dictionary, " "))
        at[offsets[:-1]] = len(coded.dictionary) + np.arange(n)
        at = np.insert(at, offsets[1:], len(coded.dictionary) + n)
        rest = [*heads, end.tobytes()]
        sizes = np.fromiter(map(len, rest), np.int64, n + 1) // np.dtype(self.dtype).itemsize
        lengths = np.concatenate([ends - starts, sizes])
        starts = np.concatenate([starts, len(flat) + np.cumsum(sizes) - sizes])
        flat = np.concatenate([flat, np.frombuffer(b"".join(rest), self.dtype)])
        each = lengths[at]
        until = np.cumsum(each)
        total = int(until[-1])
        wide = np.int32 if total < 1 << 31 else np.int64
        where = np.repeat((starts[at] - (until - each)).astype(wide), each)
        where += np.arange(total, dtype=wide)
        ids = flat[where]
        ends = until[offsets[1:] + np.arange(n)]
        return ids, np.diff(ends, prepend=0)


def _matches(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


def _encode_batches(path: str, end_id: int | None, size: int):
    """Rows with their ids; after a task's last, a row with the counts of its ids."""

    def run(batches):
        encoder = PieceEncoder.of(path)
        width = np.dtype(encoder.dtype).itemsize
        total, names, kinds = np.zeros(size, dtype=np.int64), None, []
        for batch in batches:
            keys, texts = batch.columns[:-1], batch.column(batch.num_columns - 1)
            names, kinds = [*batch.schema.names[:-1], "ids", "token", "times"], [k.type for k in keys]
            for at, rows in slices(texts, SLICE_BYTES):
                ids, sizes = encoder.encode(texts.slice(at, rows), end_id)
                total += np.bincount(ids, minlength=size)
                ends = np.concatenate([[0], np.cumsum(sizes)]) * width
                held = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(k.slice(at, rows) for k in keys), held, pa.nulls(rows, pa.list_(pa.int32())), pa.nulls(rows, pa.list_(pa.int64()))], names=names)
        encoder.forget()
        if names:
            found = np.nonzero(total)[0]
            counts = [pa.array([found], pa.list_(pa.int32())), pa.array([total[found]], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.nulls(1, pa.binary()), *counts], names=names)

    return run


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _write_file(path: str, parts: list[bytes]) -> None:
    store, at = _filesystem(path)
    attempt = f"{at}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(attempt) as out:
        for p in parts:
            out.write(p)
    store.move(attempt, at)


def _read_file(path: str) -> bytes:
    store, at = _filesystem(path)
    with store.open_input_file(at) as f:
        return f.read()


def write_shard(path: str, doc_ids: list[int | None], lengths: list[int], ranked: np.ndarray) -> int:
    """Writes one shard and returns its bytes."""
    control, data = [], []
    for i in range(0, len(ranked), CHUNK_TOKENS):
        c, d = pack(ranked[i : i + CHUNK_TOKENS])
        control.append(c)
        data.append(d)
    n_control, n_data = sum(map(len, control)), sum(map(len, data))
    head = HEADER.pack(MAGIC, len(doc_ids), len(ranked), n_control, n_data)
    index = [np.array([d or 0 for d in doc_ids], dtype="<i8"), np.array([d is None for d in doc_ids], dtype="u1"), np.array(lengths, dtype="<u8")]
    _write_file(path, [head, *(x.tobytes() for x in index), *control, *data])
    return len(head) + 17 * len(doc_ids) + n_control + n_data


def read_shard(path: str, ids_by_rank: np.ndarray):
    """Yields (doc_id, ids as u32) of a shard, decoding a piece of it at a time."""
    raw = _read_file(path)
    magic, n_docs, n_tokens, n_control, n_data = HEADER.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError(f"{path} is not a token shard")
    at = HEADER.size
    doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
    nulls = np.frombuffer(raw, "u1", n_docs, at + 8 * n_docs)
    lengths = np.frombuffer(raw, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 17 * n_docs
    control, data = np.frombuffer(raw, "u1", n_control, at), np.frombuffer(raw, "u1", n_data, at + n_control)
    held, done, used = [], 0, 0
    have = 0

    def more():
        nonlocal done, used, have
        count = min(CHUNK_TOKENS, n_tokens - done)
        c = control[done // 4 : done // 4 + -(-count // 4)]
        # Padding values at the end of the shard take a byte each in the tables but none in the data.
        size = int(GROUP_BYTES[c].sum())
        got = ids_by_rank[unpack(c, data[used : used + size], count)]
        used, done, have = used + size, done + count, have + count
        held.append(got)

    for doc_id, null, length in zip(doc_ids.tolist(), nulls.tolist(), lengths.tolist(), strict=True):
        while have < length:
            more()
        joined = held[0] if len(held) == 1 else np.concatenate(held) if held else np.zeros(0, np.uint32)
        held[:] = [joined[length:]]
        have -= length
        yield (None if null else doc_id), joined[:length]


def _shard_batches(out_dir: str, dtype: str, rank_of: np.ndarray):
    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        tokens = 0

        def flush():
            nonlocal seq, tokens
            name = f"shard-{part:06d}-{seq:06d}.bin"
            size = write_shard(f"{out_dir}/{name}", doc_ids, lengths, np.concatenate(held) if held else np.zeros(0, np.uint32))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "name": name, "docs": len(doc_ids), "tokens": tokens, "bytes": size}], schema=MANIFEST_ARROW)
            doc_ids.clear(), lengths.clear(), held.clear()
            seq, tokens = seq + 1, 0
            return row

        for batch in batches:
            for doc_id, ids in zip(batch.column(0), batch.column(1), strict=True):
                got = rank_of[np.frombuffer(ids.as_py(), dtype=dtype)]
                doc_ids.append(doc_id.as_py())
                lengths.append(len(got))
                held.append(got)
                tokens += len(got)
                if tokens >= SHARD_TOKENS:
                    yield flush()
        if doc_ids:
            yield flush()

    return run


MANIFEST = "part int, seq int, name string, docs long, tokens long, bytes long"
MANIFEST_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])


def write_token_files(docs: DataFrame, tokenizer_path: str, out_dir: str | None = None, end_id: int | None = 2, text: str = "text", doc_id: str = "doc_id", order: list[Column] | None = None) -> tuple[str, DataFrame]:
    """Encodes, ranks and writes all documents; returns the folder and the manifest.

    ``order`` (default: ascending doc_id) is the order of documents over all shards.
    """
    spark = docs.sparkSession
    out_dir = out_dir or fresh_path(spark, "tokens")
    order = order or [F.col(doc_id)]
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    chosen = docs.select(*keys, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    added = [T.StructField("ids", T.BinaryType()), T.StructField("token", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.LongType()))]
    schema = T.StructType([*chosen.schema.fields[:-1], *added])
    encoder = PieceEncoder.of(tokenizer_path)
    dtype, size = encoder.dtype, max(encoder.vocabulary, (end_id or 0) + 1)
    held = materialize(chosen.mapInArrow(tidy(_encode_batches(tokenizer_path, end_id, size)), schema), "ids")
    each = held.where("token is not null").select(F.explode(F.arrays_zip("token", "times")).alias("e"))
    # At most a row for each entry of the vocabulary: a size that no corpus changes.
    counts = each.groupBy(F.col("e.token").alias("id")).agg(F.sum("e.times").alias("n")).toPandas()
    ids = held.where("token is null").drop("token", "times")
    seen = counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(dtype=np.int64)
    ids_by_rank = np.concatenate([seen, np.setdiff1d(np.arange(size), seen)]).astype(np.uint32)
    rank_of = np.empty(size, dtype=np.uint32)
    rank_of[ids_by_rank] = np.arange(size, dtype=np.uint32)
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(out_dir)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    _write_file(f"{out_dir}/ranks.bin", [ids_by_rank.astype("<u4").tobytes()])
    by = [f"_o{i}" for i in range(len(order))]
    ties = F.xxhash64("ids")
    dealt = ids.repartitionByRange(shuffle_partitions(spark), *by, ties).sortWithinPartitions(*by, ties, "ids")
    manifest = materialize(dealt.select("doc_id", "ids").mapInArrow(tidy(_shard_batches(out_dir, dtype, rank_of)), MANIFEST), "manifest")
    discard(held)
    return out_dir, manifest


def read_token_files(out_dir: str, manifest: DataFrame) -> DataFrame:
    """A row for each document of the shards: doc_id, start, n_tokens, ids_crc32, shard."""
    spark = manifest.sparkSession
    # One row for each task that wrote: as many as partitions.
    totals = sorted((r["part"], r["n"]) for r in manifest.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    starts, at = [], 0
    for part, n in totals:
        starts.append((part, at))
        at += n
    before = spark.createDataFrame(starts, "part int, before long")
    w = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("ahead", F.coalesce(F.sum("tokens").over(w), F.lit(0))).join(before, "part")
    files = placed.select("name", (F.col("before") + F.col("ahead")).alias("start")).repartition(shuffle_partitions(spark), "name")

    def run(batches):
        ids_by_rank = None
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids_by_rank is None:
                    ids_by_rank = np.frombuffer(_read_file(f"{out_dir}/ranks.bin"), "<u4")
                rows: list[list] = [[], [], [], []]
                for doc_id, ids in read_shard(f"{out_dir}/{name}", ids_by_rank):
                    for column, value in zip(rows, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        column.append(value)
                    start += len(ids)
                arrays = [pa.array(c, pa.int64()) for c in rows]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([name] * len(rows[0]), pa.string())], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return files.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def token_output(docs: DataFrame, tokenizer_path: str, **kw) -> DataFrame:
    """Writes the files and reads them back: one row for each document."""
    return read_token_files(*write_token_files(docs, tokenizer_path, **kw))
