"""Token ids in shards of independent zstandard frames with a trailing seek table.

Shard layout, integers little-endian:

* frames, each one zstandard frame of whole documents' ids (unsigned 32 bit);
* the seek table, itself one zstandard frame holding, for every frame, `offset u64,
  bytes u32, crc32 u32 (of the compressed bytes), documents u32` and then, for every
  document, `doc_id i64, null u8, ids u32`;
* a footer: `table offset u64, table bytes u32, table crc32 u32, frames u32, documents
  u64, magic "QMTOKEN1"`.

A reader takes the footer, the table, and then only the frames that hold the wanted
documents; every frame is checked before it is decompressed.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MAGIC = b"QMTOKEN1"
FOOTER = struct.Struct("<QIIIQ8s")
FRAME = np.dtype([("offset", "<u8"), ("bytes", "<u4"), ("crc", "<u4"), ("docs", "<u4")])
DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("ids", "<u4")])
END = 1
#: Characters whose lower case and composition are plain, and the tokenizer's own pattern over them.
SAFE = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
SAFE_TEXT = re.compile("[\n\x20-\x7eÀ-ÖØ-öø-ÿ]*+")
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Pieces that a worker keeps, and characters of the longest of them, which bounds it in bytes: some 250 MB at the worst.
KEEP, LONGEST = 600_000, 48
#: Bytes of ids that a task reads back, or one shard of more.
READ_BYTES = 128 << 20
_encoders: dict[str, Encoder] = {}


#: Text on which the shortcut and the tokenizer must agree, or the shortcut isn't taken.
PROBE = (
    "It's WE'LL they'd I'm you've x're 'S \"Quoted\" (a-b) c/d e_f 007 3.14 1,000% $5 #tag @at a&b ~ ^ ` | \\ <b>Tag</b> {x} [y] *z* +1 = ; : ! ? ...",
    "Ångström ÀÉÎÕÜ çà ñandú straße ÆØÅ ÿÝ ¿qué? « oui » – “x” naïve\tTab\r\nLine\n\n漢字 Ελλάς привет ﬁ ½ x² ™ 🙂 e\u0301 İ ß",
    "loremipsumdolorsitametconsecteturadipiscing zzzzqqqqxxxx a aa aaa 12ab34 ab12 x1y2 UPPERCASE MixedCase",
)


class Encoder:
    """The tokenizer, called once for each distinct part of the texts of a batch.

    The tokenizer drops white space and no token spans it, so a text's ids are those of
    its pieces between blanks and line feeds, which Arrow parts, numbers and puts together
    again. Pieces of plain characters consist of the parts that its pattern matches; new
    parts are encoded many to a call and told apart again by their last ids, which alone
    end a word. All other pieces are encoded whole.
    Pieces longer than LONGEST are forgotten after their batch.
    A tokenizer of another make, which PROBE shows, encodes every text whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.parted = self.by_parts(list(PROBE)) == [self.whole(t) for t in PROBE]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        """All ids of each text, without the end id."""
        return self.by_parts(texts) if self.parted else [self.whole(t) for t in texts]

    def by_parts(self, texts: list[str]) -> list[bytes]:
        low = [(t.lower() if (t.isascii() or SAFE_TEXT.fullmatch(t)) and "<|" not in t else t).replace("\n", " ") for t in texts]
        split = pc.split_pattern(pa.array(low, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        if len(self.known) > KEEP:
            self.known = {"": b""}
        known = self.known
        plain, fresh, every = {}, set(), coded.dictionary.to_pylist()
        got = list(map(known.get, every))
        at = [i for i, ids in enumerate(got) if ids is None]
        new = [every[i] for i in at]
        for piece in new:
            if (piece.isascii() and piece.isprintable() or SAFE.fullmatch(piece)) and "<|" not in piece:
                low = piece.lower()
                if not low.isalpha():
                    plain[piece] = parts = PARTS.findall(low)
                    fresh.update(parts)
                else:
                    fresh.add(low)
                    if low != piece:
                        plain[piece] = [low]
            else:
                known[piece] = self.whole(piece)
        self._learn(list(fresh - known.keys()))
        part, join = known.__getitem__, b"".join
        long = [piece for piece in (*fresh, *new) if len(piece) > LONGEST]
        for piece, parts in plain.items():
            known[piece] = part(parts[0]) if len(parts) == 1 else join(map(part, parts))
        for i, piece in zip(at, new):
            got[i] = part(piece)
        ids = pa.array(got, pa.large_binary()).take(coded.indices)
        for piece in long:
            known.pop(piece, None)
        # The ids of all pieces stand one after another; a text's begin where its first piece's do.
        data, starts = ids.buffers()[2], np.frombuffer(ids.buffers()[1], np.int64)
        cuts = starts[split.offsets.to_numpy()].tolist()
        return [data[a : b].to_pybytes() if b > a else b"" for a, b in zip(cuts, cuts[1:])]

    def _learn(self, parts: list[str], at_once: int = 256) -> None:
        groups = [parts[a : a + at_once] for a in range(0, len(parts), at_once)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(group) and last[-1] == len(ids):
                data, a = ids.tobytes(), 0
                for word, b in zip(group, (last * 4).tolist()):
                    self.known[word] = data[a:b]
                    a = b
            else:
                self.known |= {word: self.whole(word) for word in group}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        common.own("tokens", _encoders.clear)
        _encoders[path] = Encoder(path)
    return _encoders[path]


class ShardWriter:
    """Yields the bytes of a shard; frames close at frame_bytes of ids and never split a document."""

    def __init__(self, frame_bytes: int = 1 << 20, level: int = 1):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple] = []
        self.docs: list[tuple] = []
        self.at = self.ids = 0

    def write(self, rows: Iterator[tuple[int | None, bytes]]) -> Iterator[bytes]:
        held: list[bytes] = []
        size = 0
        for doc_id, ids in rows:
            held.append(ids)
            size += len(ids)
            self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4))
            self.ids += len(ids) // 4
            if size >= self.frame_bytes:
                yield self._frame(held)
                held, size = [], 0
        if held:
            yield self._frame(held)
        table = self.packer.compress(np.array(self.frames, FRAME).tobytes() + np.array(self.docs, DOC).tobytes())
        yield table
        yield FOOTER.pack(self.at, len(table), zlib.crc32(table), len(self.frames), len(self.docs), MAGIC)

    def _frame(self, held: list[bytes]) -> bytes:
        data = self.packer.compress(b"".join(held))
        self.frames.append((self.at, len(data), zlib.crc32(data), len(held)))
        self.at += len(data)
        return data


class ShardReader:
    """Random access to one shard."""

    def __init__(self, uri: str):
        store, path = common.open_fs(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        at, n, crc, frames, docs, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        table = self._read(at, n)
        if zlib.crc32(table) != crc:
            raise ValueError(f"{uri}: the seek table is damaged")
        table = zstandard.ZstdDecompressor().decompress(table)
        self.frames = np.frombuffer(table, FRAME, frames)
        self.docs = np.frombuffer(table, DOC, docs, frames * FRAME.itemsize)
        self.first = np.concatenate(([0], np.cumsum(self.frames["docs"].astype(np.int64))))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> list[np.ndarray]:
        """The ids of each document of frame k."""
        f = self.frames[k]
        data = self._read(int(f["offset"]), int(f["bytes"]))
        if zlib.crc32(data) != f["crc"]:
            raise ValueError(f"frame {k} is damaged")
        n = self.docs["ids"][self.first[k] : self.first[k + 1]].astype(np.int64)
        ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=int(n.sum()) * 4), "<u4")
        return np.split(ids, np.cumsum(n)[:-1])

    def document(self, k: int) -> np.ndarray:
        """The ids of the shard's k-th document; only its frame is read."""
        at = int(np.searchsorted(self.first, k, "right")) - 1
        return self.frame(at)[k - int(self.first[at])]

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of all documents of that id."""
        return [self.document(int(k)) for k in np.flatnonzero((self.docs["doc_id"] == doc_id) & (self.docs["null"] == 0))]


def write(docs: DataFrame, folder: str, tokenizer_path: str, frame_bytes: int = 1 << 20, order: tuple[Column, ...] = ()) -> DataFrame:
    """Write docs(doc_id, text) in the given order, or in that of doc_id; (shard, uri, n_docs, n_ids, start) of the shards, few rows.

    Null texts are empty: such documents hold the end id alone. Null ids come first;
    rows of equal keys are ordered by id and a hash of their text, and repeated rows are
    all written. Other columns are not read. An empty table gives no shard. A range of
    keys makes a shard, so shards follow each other in order, and a repeated or lost
    task leaves one whole file of its name.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *(c.alias(f"key{i}") for i, c in enumerate(order)))
    keys = [F.col(c).asc_nulls_first() for c in (*(f"key{i}" for i in range(len(order))), "doc_id")] + [F.xxhash64("text")]
    rows = rows.repartitionByRange(common.parts_for(rows), *keys).sortWithinPartitions(*keys)
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        writer = ShardWriter(frame_bytes)
        source = ((i, ids + end) for batch in batches for i, ids in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer_path).batch(common.texts(batch))))
        first = next(source, None)
        if first is None:
            return
        name = f"shard-{shard:06d}.qmt"
        common.write_whole(folder, name, writer.write(row for part in ((first,), source) for row in part))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "uri": [f"{folder}/{name}"], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.ids], pa.int64())})

    shards = sorted(rows.mapInArrow(run, "shard int, uri string, n_docs long, n_ids long").collect())
    out, start = [], 0
    for r in shards:
        out.append((*r, start))
        start += r["n_ids"]
    return spark.createDataFrame(out, "shard int, uri string, n_docs long, n_ids long, start long")


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and shard of every document, decoded from the files.

    A row for each document written, repeated ones too, null ids as null; an empty text
    has its end id alone. A damaged or cut shard is an error. No shards, no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                reader, start, k = ShardReader(s["uri"]), s["start"], 0
                for f in range(len(reader.frames)):
                    ids = reader.frame(f)
                    held = reader.docs[k : k + len(ids)]
                    n = np.array([len(x) for x in ids], np.int64)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(held["doc_id"].astype(np.int64), mask=held["null"] == 1),
                            "start": pa.array(start + np.cumsum(n) - n),
                            "n_tokens": pa.array(n),
                            "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                            "shard": pa.array([s["shard"]] * len(ids), pa.int32()),
                        }
                    )
                    start, k = start + int(n.sum()), k + len(ids)

    n, ids = shards.agg(F.count("*"), F.sum("n_ids")).first()
    n = min(max(1, n), max(4 * shards.sparkSession.sparkContext.defaultParallelism, -(-4 * (ids or 0) // READ_BYTES)))
    return shards.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def export(docs: DataFrame, tokenizer_path: str, order: tuple[Column, ...] = ()) -> DataFrame:
    """Write docs to the shared folder and read every document back from the files; nulls, ties, repeated rows and empty tables as in `write` and `read`."""
    return read(write(docs, common.shared_dir(docs.sparkSession, "tokens"), tokenizer_path, order=order))
