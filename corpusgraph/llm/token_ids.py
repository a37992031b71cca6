"""Operator 3: token ids as a binary file format of bit planes.

A file set is a Parquet table of chunks, so that Spark's writers commit it and any store holds it. A chunk has whole
documents, its ids cut into blocks of a fixed number; each block is turned into its bit or byte planes, each plane is
compressed with zstandard, and the chunk's index holds every plane's place. Shards follow one another in the order of
the documents' ids.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import held, shared_dir, texts

#: Ids of a block, and of a chunk about (a longer document has a chunk of its own).
BLOCK, CHUNK = 16_384, 262_144
#: Bytes of text that are encoded at once, about: the words that come again among them are looked up once.
TEXT = 1 << 23
CHUNKS = "shard int, chunk int, first long, n_ids long, doc_ids array<long>, doc_tokens array<long>, block int, bits boolean, planes array<int>, payload binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit numbers.

    Byte-level BPE never joins over a lone space or line feed between two words, nor between a letter and the marks that
    end a word, so such parts have the same ids wherever they stand. Ids of parts already seen are kept, in two
    generations of `keep` parts: when the younger is full it becomes the older, so frequent parts stay. A tokenizer of
    another kind, and a text that holds one of its special strings, are encoded whole.
    """

    MARKS = ".,;:!?*#$%&|"
    _SPACE = re.compile(r"[^\S \n]")
    _WORD = re.compile(r" \S+")

    def __init__(self, path: str, keep: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        cut = made.get("pre_tokenizer") or {}
        self.in_parts = made["model"]["type"] == "BPE" and not made.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.special = [x["content"] for x in made.get("added_tokens", ())]
        self.young, self.old, self.keep = {}, {}, keep
        vocab = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocab.values(), default=0) + 1, bool)  # tokens whose first byte is a space
        self.begins[[i for x, i in vocab.items() if x[:1] in ("\u0120", " ")]] = True
        self.joins = self.in_parts and not any(c.isspace() for x in self.special for c in x)
        self.line_feed = self._ids(["\n"])[0]

    def _ids(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        """The same for parts that are a space and a word, which are encoded as one text: a word's ids begin with the one
        token in it that begins with a space."""
        raw = self._ids(["".join(words)])[0]
        at = np.flatnonzero(self.begins[np.frombuffer(raw, np.uint32)])
        if len(at) != len(words) or at[0]:
            return self._ids(words)
        ends = (4 * at).tolist() + [len(raw)]
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of all parts, of which those not seen are encoded; the younger generation then holds them all."""
        young, old = self.young, self.old
        new = parts.difference(young)
        if len(young) + len(new) > self.keep:
            self.old, self.young = young, {}
            young, old, new = self.young, self.old, parts
        fresh, split, cores = [], [], []
        again = [p for p in new if p in old] if old else []
        young.update(zip(again, map(old.__getitem__, again)))
        for p in new.difference(again) if again else new:
            core = p.rstrip(self.MARKS)
            if core != p and core and core[-1] <= "\u024f" and core[-1].isalpha():
                split.append(p)
                cores.append(core)
            else:
                fresh.append(p)
        marks = [p[len(core) :] for p, core in zip(split, cores)]
        fresh += [x for x in {*cores, *marks} if x not in young and x not in new]
        words, rest = [], []
        alone = self._WORD.fullmatch if self.joins else lambda p: None
        for p in fresh:
            (words if alone(p) else rest).append(p)
        for some, ids_of, most in ((words, self._ids_of_words, 2_000), (rest, self._ids, 20_000)):
            for at in range(0, len(some), most):
                young.update(zip(some[at : at + most], ids_of(some[at : at + most])))
        get, known = young.get, self._known
        for p, core, mark in zip(split, cores, marks):
            young[p] = (get(core) or known(core)) + (get(mark) or known(mark))
        return young

    def _known(self, part: str) -> bytes:
        got = self.young.get(part)
        if got is None:
            got = self.old.get(part)
        return self._ids([part])[0] if got is None else got

    def plain(self, text: str) -> bool:
        """Whether lone spaces and line feeds, each between two words, are all the white space."""
        return bool(text) and "  " not in text and "\n\n" not in text and " \n" not in text and "\n " not in text and text[0] not in " \n" and text[-1] not in " \n" and not self._SPACE.search(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.in_parts:
            return self._ids(texts)
        if any(s in x for s in self.special for x in texts):
            whole = [any(s in x for s in self.special) for x in texts]
            rest = iter(self.encode([x for x, w in zip(texts, whole) if not w]))
            return [self._ids([x])[0] if w else next(rest) for x, w in zip(texts, whole)]
        plain = ["\0" not in x and self.plain(x) for x in texts]
        rest = [None if p else pieces(x) for x, p in zip(texts, plain)]
        get = self._learn(set(chain.from_iterable(filter(None, rest)))).__getitem__
        rest = [None if x is None else b"".join(map(get, x)) for x in rest]
        made = self._ids_of_plain([x for x, p in zip(texts, plain) if p])
        return [next(made) if x is None else x for x in rest]

    def _ids_of_plain(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts without NUL that are plain(). Parts become numbers in Arrow, so each different one is looked up
        once. A line's first word has no space before it; the others get theirs from the marked split; a line feed is a
        part of its own."""
        if not texts:
            return
        marked = "\0".join(texts).replace("\n", "\0\n\0").replace(" ", "\0 ")
        parts = pc.split_pattern(pa.array([marked], pa.large_string()), "\0").values.dictionary_encode()
        different, of = parts.dictionary.to_pylist(), parts.indices.to_numpy()
        known = list(map(self._learn(set(different)).__getitem__, different))
        ids = np.frombuffer(b"".join(known), np.uint32)
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(lengths) - lengths
        first = np.cumsum([0] + [1 + x.count(" ") + 2 * x.count("\n") for x in texts])
        for k in range(0, len(texts), 100):  # so that what is as long as the ids stays small
            part = first[k : k + 101]
            mine = of[part[0] : part[-1]]
            n = lengths[mine]
            ends = np.cumsum(n)
            some = ids[np.repeat(starts[mine] - (ends - n), n) + np.arange(ends[-1])]
            cuts = ends[part[1:] - part[0] - 1].tolist()
            for at, to in zip([0, *cuts], cuts):
                yield some[at:to].tobytes()


def pieces(text: str) -> list[str]:
    """The text cut before each lone space that has no white space at either side."""
    parts = text.split(" ")
    out, last = [parts[0]], parts[0][-1:]
    for p in parts[1:]:
        if p and last and not p[0].isspace() and not last.isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
        last = p[-1:]
    return [p for p in out if p]


def encoder(path: str) -> Encoder:
    return held(f"encoder {path}", lambda: Encoder(path))


def slices(text: pa.Array, most: int = TEXT) -> Iterator[tuple[int, int]]:
    """(first, end) of rows that follow one another, with about so many bytes of text together and one row at least."""
    total, at = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(total):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def pack(ids: np.ndarray, block: int, bits: bool, level: int = 3) -> tuple[list[int], bytes]:
    """(length of each compressed plane, the planes): block by block, from the lowest plane."""
    squeeze, sizes, out = zstandard.ZstdCompressor(level=level), [], []
    for at in range(0, len(ids), block):
        raw = np.ascontiguousarray(ids[at : at + block], "<u4").view("u1").reshape(-1, 4)
        if bits:
            planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)
        else:
            planes = np.ascontiguousarray(raw.T)
        for plane in planes:
            made = squeeze.compress(plane.tobytes()) if plane.any() else b""
            sizes.append(len(made))
            out.append(made)
    return sizes, b"".join(out)


def unpack(n: int, block: int, bits: bool, sizes: list[int], payload: bytes) -> np.ndarray:
    """The ids that pack() was given."""
    open_up, out, at, k = zstandard.ZstdDecompressor(), np.empty(n, "<u4"), 0, 32 if bits else 4
    for b, first in enumerate(range(0, n, block)):
        m = min(block, n - first)
        width = (m + 7) // 8 if bits else m
        planes = np.zeros((k, width), "u1")
        for j, size in enumerate(sizes[b * k : (b + 1) * k]):
            if size:
                planes[j] = np.frombuffer(open_up.decompress(payload[at : at + size], max_output_size=width), "u1")
                at += size
        raw = np.packbits(np.unpackbits(planes, axis=1, count=m).T, axis=1, bitorder="little") if bits else planes.T
        out[first : first + m] = np.ascontiguousarray(raw).view("<u4").ravel()
    return out


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, chunk: int = CHUNK, bits: bool = False) -> None:
    """Encodes each whole text, ends it with end_id, and writes the ids in ascending order of id at path.

    A null text is the empty one; null ids come first; rows of one id follow each other by text; no rows give an empty
    file set. The range partitions bound what a task holds: its documents pass one chunk at a time.
    """
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("block", pa.int32()), ("bits", pa.bool_()), ("planes", pa.list_(pa.int32())), ("payload", pa.binary())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        state = {"chunk": 0, "first": 0}
        held_ids, held, n = [], [], 0

        def close() -> pa.RecordBatch:
            counts = [len(x) // 4 for x in held]
            sizes, payload = pack(np.frombuffer(b"".join(held), "<u4"), block, bits)
            row = [[shard], [state["chunk"]], [state["first"]], [sum(counts)], [list(held_ids)], [counts], [block], [bits], [sizes], [payload]]
            state["chunk"] += 1
            state["first"] += sum(counts)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, schema.types)], schema=schema)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, to in slices(batch.column(1)):
                for i, made in zip(ids[at:to], enc.encode(batch.column(1).slice(at, to - at).to_pylist())):
                    held_ids.append(i)
                    held.append(made + end)
                    n += len(made) // 4 + 1
                    if n >= chunk:
                        yield close()
                        held_ids, held, n = [], [], 0
        if held:
            yield close()

    ordered.mapInArrow(run, CHUNKS).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the chunks at path: start counts the ids of all documents
    before it, ids_crc32 is the checksum of its ids as little-endian unsigned 32-bit numbers."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    schema = pa.schema([("shard", pa.int32()), ("id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = batch.slice(i, 1).to_pylist()[0]
                raw = memoryview(unpack(c["n_ids"], c["block"], c["bits"], c["planes"], c["payload"]).tobytes())
                ends = np.cumsum(c["doc_tokens"])
                starts = ends - np.array(c["doc_tokens"])
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([c["shard"]] * len(crc), c["doc_ids"], (starts + c["first"]).tolist(), c["doc_tokens"], crc), schema.types)], schema=schema)

    docs = chunks.mapInArrow(run, "shard int, id long, at long, n_tokens long, ids_crc32 long")
    sums = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row for each shard
    base = sums.select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return docs.join(base, F.col("shard") == F.col("s")).select("id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, name: str = "ids", **options) -> DataFrame:
    """Writes docs in the shared folder and reads them back."""
    import uuid

    path = f"{shared_dir(docs.sparkSession)}/corpusgraph/{name}-{uuid.uuid4().hex}"
    write_ids(docs, path, **options)
    return read_ids(docs.sparkSession, path)
