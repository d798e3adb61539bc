"""Operator 8: token ids in seekable zstandard files.

A file holds the ids of consecutive documents as unsigned 32-bit little-endian
numbers.  Each document is one or more frames of its own; a skippable frame
names the documents, and a last skippable frame is the seek table, in the
layout of the public seekable format: for each frame its compressed size, its
size and the low 32 bits of XXH64 of its contents.  A reader seeks to the
table at the end and decompresses only the frames of the documents it wants.
"""

from __future__ import annotations

import io
import re
import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, Block, Scratch, blocks, id_text, table

#: Fixed values of the file format.
SEEK_FRAME, SEEK_MAGIC, NAMES_FRAME = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
#: Ids in one frame at most; a longer document has several frames.
FRAME_IDS = 1 << 22
#: Compressed bytes of one file, about.
FILE_BYTES = 32 << 20
#: Distinct words whose ids a worker remembers; it starts anew beyond.
WORDS = 600_000
#: Words that are encoded as one text, and what stands between them.
JOINED, DIVIDER = 500, "\x01"
#: Texts whose words a tokenizer must encode alike alone and together, for words to be looked up.
PROBE = " It's  a\ttest:\n\n\n3 cafe\u0301s, 12\r\n34 don 't \x0b stop \x0c... ' s U.S. x,y , z ", "a\nb", "  ", "\u4f60 \u597d \u0301 \U0001f600 !? ! ?"


class WordIds:
    """Encodes texts; with a tokenizer that treats white-space-separated words alone, word by word.

    A word is then encoded once and looked up.  Only ASCII white space
    divides; the tokenizer sees all else.  Whether it treats words alone is
    tried on ``PROBE``; another one encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # between words stands a control character that is one id of its own, if the tokenizer has such a one
        ids = self.tokenizer.encode(f"a {DIVIDER} a", add_special_tokens=False).ids
        self.divider = ids[1] if len(ids) == 3 and ids[0] == ids[2] else None
        self.alone = all(self._each([x])[0].tolist() == self._each([*map(bytes.decode, x.encode().split())])[0].tolist() for x in PROBE)
        self.clear()

    @staticmethod
    def of_worker(path: str) -> WordIds:
        """The worker's own, kept from task to task; what it remembers changes no result."""
        found = sys.__dict__.setdefault("_tabulon_word_ids", {})
        if path not in found:
            found[path] = WordIds(path)
        return found[path]

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def learn(self, words: list[bytes]) -> None:
        parts = [self._ids([w.decode() for w in words[i : i + 50 * JOINED]]) for i in range(0, len(words), 50 * JOINED)]
        flat, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        first = len(self.index) - len(words)
        while len(self.at) < len(self.index):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        while len(self.flat) < self.used + len(flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.size[first : len(self.index)] = sizes
        self.at[first : len(self.index)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each has."""
        joined = [f" {DIVIDER} ".join(texts[i : i + JOINED]) + f" {DIVIDER}" for i in range(0, len(texts), JOINED)]
        if self.divider is None or sum(x.count(DIVIDER) for x in joined) != len(texts):
            return self._each(texts)  # a word holds the divider
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(flat == self.divider)
        if len(ends) != len(texts):
            return self._each(texts)  # something else became the divider's id, or it became part of another
        return flat[flat != self.divider], np.diff(ends, prepend=-1) - 1

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same, each text alone."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for one in ids for i in one], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's documents, and the number of each document's."""
        if len(self.index) > WORDS:
            self.clear()
        raw, index = block.data.tobytes(), self.index
        if not self.alone:
            return self._each([raw[a:b].decode() for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)])
        split = [raw[a:b].split() for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)]
        fresh: list[bytes] = []
        found: list[int] = []
        for words in split:
            for w in words:
                k = index.get(w)
                if k is None:
                    k = index[w] = len(index)
                    fresh.append(w)
                found.append(k)
        if fresh:
            self.learn(fresh)
        k = np.array(found, dtype=np.int64)
        sizes = self.size[k]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.at[k] - (ends - sizes), sizes) + np.arange(total)]
        words_of = np.fromiter(map(len, split), np.int64, len(split))
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words_of)])]
        return ids, np.diff(upto)


def _frames(ids: np.ndarray, frame_ids: int, level: int = 3) -> Iterator[tuple[bytes, int, int]]:
    import xxhash
    import zstandard

    made = zstandard.ZstdCompressor(level=level)
    for a in range(0, max(len(ids), 1), frame_ids):
        raw = ids[a : a + frame_ids].astype("<u4").tobytes()
        yield made.compress(raw), len(raw), xxhash.xxh64_intdigest(raw)


def encoded(docs: DataFrame, tokenizer: str, end_id: int, frame_ids: int = FRAME_IDS) -> DataFrame:
    """(doc_id, lead, row, part, frame, size, check): every document's frames, in input order.

    ``lead`` orders rows that share an id by their contents; ``row`` keeps the
    frames of each apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = WordIds.of_worker(tokenizer)
        row = TaskContext.get().partitionId() << 33
        for block in blocks(batches, 2 << 20):
            ids, counts = words.encode(block)
            rows, at = [], 0
            for doc, n in zip(block.ids.tolist(), counts.tolist(), strict=True):
                own = np.append(ids[at : at + n], np.uint32(end_id))
                at += n
                doc = None if doc == NULL_ID else doc
                made = list(_frames(own, frame_ids))
                lead = _lead([x[2] for x in made])
                rows += [(doc, lead, row, k, frame, size, digest & 0xFFFFFFFF) for k, (frame, size, digest) in enumerate(made)]
                row += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["doc_id", "lead", "row", "part", "frame", "size", "check"],
            )

    return id_text(docs).mapInArrow(run, "doc_id long, lead long, row long, part int, frame binary, size long, check long")


def _lead(digests: list[int]) -> int:
    """One signed 64-bit number for a document, of the digests of its frames."""
    import xxhash

    whole = digests[0] if len(digests) == 1 else xxhash.xxh64_intdigest(struct.pack(f"<{len(digests)}Q", *digests))
    return whole - (1 << 64) if whole >> 63 else whole


def _open(uri: str, write: bool = False):
    """A file of the shared folder, from an executor; Hadoop's names of object stores are read too."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
    return system, path, (system.open_output_stream if write else system.open_input_file)(path)


class TokenFile:
    """Random access to one file: ``ids(k)`` decompresses the k-th document alone."""

    def __init__(self, uri: str):
        _, _, self.file = _open(uri)
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError(f"no seek table at the end of {uri}")
        whole = 8 + 12 * frames + 9
        kind, _ = struct.unpack("<II", self._read(size - whole, 8))
        if kind != SEEK_FRAME:
            raise ValueError(f"damaged seek table in {uri}")
        rows = np.frombuffer(self._read(size - whole + 8, 12 * frames), "<u4").reshape(-1, 3)
        self.sizes, self.checks = rows[:, 1], rows[:, 2]
        self.at = np.concatenate([[0], np.cumsum(rows[:, 0], dtype=np.int64)])
        kind, length = struct.unpack("<II", self._read(int(self.at[-1]), 8))
        names = np.frombuffer(self._read(int(self.at[-1]) + 8, length), "<i8").reshape(-1, 2)
        self.doc_ids, self.first = names[:, 0], np.append(names[:, 1], frames)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, k: int) -> np.ndarray:
        import xxhash
        import zstandard

        out, made = [], zstandard.ZstdDecompressor()
        for f in range(int(self.first[k]), int(self.first[k + 1])):
            raw = made.decompress(self._read(int(self.at[f]), int(self.at[f + 1] - self.at[f])))
            if len(raw) != self.sizes[f] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[f]:
                raise ValueError(f"frame {f} does not match its checksum")
            out.append(np.frombuffer(raw, "<u4"))
        return np.concatenate(out)


def write_files(spark: SparkSession, docs: DataFrame, folder: str, scratch: Scratch, tokenizer: str, end_id: int, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Writes the files in ascending doc_id order; (file, uri, docs, tokens) of each.

    A document without an id comes last; rows that share an id are next to
    each other, ordered by a hash of their contents, so that equal ids may
    fill any number of files.  A file appears under its name only when it is whole, so a
    repeated task replaces it.
    """
    frames = scratch.keep(encoded(docs, tokenizer, end_id, frame_ids), "frames")
    total = frames.agg(F.sum(F.length("frame"))).first()[0] or 0
    # a few files for each task slot where the data are small, whole files where they are not
    files = max(-(-total // FILE_BYTES), min(spark.sparkContext.defaultParallelism, -(-total // (1 << 20))), 1)
    # null sorts first in a range: the id that follows all others stands for it
    ordered = frames.withColumn("key", F.coalesce("doc_id", F.lit(int(NULL_ID))))
    # all frames of a row share its range
    ordered = ordered.repartitionByRange(files, "key", "lead", "row").sortWithinPartitions("key", "lead", "row", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{folder}/ids-{task.partitionId():06d}.zst"
        system, path, out = _open(f"{name}.{task.taskAttemptId()}.part", True)
        table_rows, names, tokens, done = io.BytesIO(), [], 0, 0
        with out:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "frame", "size", "check")), strict=True):
                    key, part, frame, size, check = row
                    if part == 0:
                        names.append((key, done))
                    out.write(frame)
                    table_rows.write(struct.pack("<III", len(frame), size, check))
                    tokens += size // 4
                    done += 1
            listed = np.array(names, dtype="<i8").tobytes()
            out.write(struct.pack("<II", NAMES_FRAME, len(listed)) + listed)
            out.write(struct.pack("<II", SEEK_FRAME, 12 * done + 9) + table_rows.getvalue())
            out.write(struct.pack("<IBI", done, 0x80, SEEK_MAGIC))
        if not done:
            system.delete_file(path)
            return
        system.move(path, path[: path.rindex(".zst") + 4])
        yield pa.RecordBatch.from_arrays(
            [pa.array([task.partitionId()]), pa.array([name]), pa.array([len(names)]), pa.array([tokens])],
            names=["file", "uri", "docs", "tokens"],
        )

    # the folder itself must be there before executors open files in it
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    made = ordered.mapInArrow(run, "file long, uri string, docs long, tokens long")
    made = scratch.keep(made, "files")
    scratch.drop(frames)
    return made


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = files.select("file", "uri", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist(), strict=True):
                one = TokenFile(uri)
                starts, counts, sums = [], [], []
                for k in range(len(one.doc_ids)):
                    ids = one.ids(k)
                    starts.append(base)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.tobytes()))
                    base += len(ids)
                docs = pa.array(one.doc_ids, pa.int64(), mask=one.doc_ids == NULL_ID)
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = max(1, files.count())
    return placed.repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encodes ``docs`` to files in the shared folder and reads them back.

    Null texts are empty, an empty text has the end id alone, and a text of
    more than ``frame_ids`` ids has several frames.  Rows that share an id all
    stay, in an order given by their contents; rows without one come last.
    Other columns are not read.
    """
    scratch = Scratch(spark, "ids")
    return read_files(write_files(spark, docs, scratch.path("zst"), scratch, tokenizer, end_id, frame_ids))


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return write_and_read(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
