"""Token-ID output: length-delimited binary records with a separate offset index.

Record: length (unsigned 64-bit, little-endian), masked checksum of those eight bytes, payload, masked checksum
of the payload. Payload: doc_id (signed 64-bit), a null flag byte, a byte with the width of an id (2 or 4), then
the ids, little-endian, the end id included. The mask rotates the CRC-32 right by 15 bits and adds a constant,
so that a checksum stored inside checked data doesn't disturb the outer one. ``<file>.idx`` has the offset of
each record as unsigned 64-bit integers, for reads in any order.

Edge cases: a null or empty text is a document of the end id alone; equal doc_ids keep a record each, ordered by
text (starts follow that order); a null doc_id comes first; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from chronoflow.llm.store import Output, fresh_folder, open_input, written
from chronoflow.llm.textkit import frugal

MASK_DELTA = 0xA282EAD8
END_ID = 2
CHUNK = 16 << 20
_HEAD, _DOC = "<QI", "<qBB"

# Words of these characters alone need no Unicode normalisation and lower-case one to one, so that their pieces
# can be cut here; any other word goes to the tokenizer whole.
_PLAIN = re.compile(r"[!-;=-~¡-§©-®°±¶·»¿-ÿ‐-‧€]+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


class Encoder:
    """Encoding by a ``tokenizers`` file, equal to encoding whole texts.

    White space ends every piece of the word-BPE files (their pre-tokenizer drops it), so a text's ids are those of its
    words in order. Texts go by chunks: each distinct word of a chunk is encoded once, and where the pipeline is the known
    word-BPE one, plain words are cut into pieces, of which each distinct one is encoded once, in one call that is split
    at the word-end ids. Nothing is kept from chunk to chunk but the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self._whole, vocab = path, None, spec["model"]["vocab"]
        top = max([*vocab.values(), *(x["id"] for x in spec.get("added_tokens") or [])])
        self.width = 2 if top < 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = bool(cuts) and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
        suffix = spec["model"].get("end_of_word_suffix")
        known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.by_piece = self.by_word and bool(suffix) and steps == ["NFC", "Replace", "Lowercase"] and cuts[0]["pattern"].get("Regex") == known
        if self.by_piece:
            self.fast = Tokenizer.from_file(path)
            self.fast.normalizer = None
            self.fast.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(top + 1, bool)
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

    @property
    def whole(self):
        """The tokenizer as it is in the file, loaded when the first word needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def _packed(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def words(self, distinct: list[str]) -> list[bytes]:
        """The ids of each word, packed."""
        out: list[bytes | None] = [None] * len(distinct)
        if self.by_piece:
            cut = [_PIECE.findall(w.lower()) if _PLAIN.fullmatch(w) else None for w in distinct]
            pieces, ids_of = list(dict.fromkeys(p for ps in cut if ps for p in ps)), {}
            for at in range(0, len(pieces), 20_000):
                some = pieces[at : at + 20_000]
                ids = np.array(self.fast.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
                stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                assert len(stops) == len(some)
                raw, begin = ids.tobytes(), 0
                for p, stop in zip(some, stops):
                    ids_of[p] = raw[begin * self.width : stop * self.width]
                    begin = stop
            out = [None if ps is None else b"".join([ids_of[p] for p in ps]) for ps in cut]
        odd = [k for k, x in enumerate(out) if x is None]
        for at in range(0, len(odd), 20_000):
            some = odd[at : at + 20_000]
            for k, e in zip(some, self.whole.encode_batch_fast([distinct[k] for k in some], add_special_tokens=False)):
                out[k] = self._packed(e.ids)
        return out

    def chunk(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of an array without nulls, packed."""
        if not self.by_word:
            for e in self.whole.encode_batch_fast(texts.to_pylist(), add_special_tokens=False):
                yield self._packed(e.ids)
            return
        split = pc.ascii_split_whitespace(texts)
        words, offsets = split.flatten().dictionary_encode(), split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        coded = self.words(words.dictionary.to_pylist())
        ids, size = np.frombuffer(b"".join(coded), self.kind), np.array([len(x) // self.width for x in coded], np.int64)
        start, place = np.cumsum(size) - size, words.indices.to_numpy()
        for k in range(len(texts)):
            word = place[offsets[k] : offsets[k + 1]]
            n = size[word]
            end = np.cumsum(n)
            yield ids[np.arange(n.sum()) - np.repeat(end - n, n) + np.repeat(start[word], n)].tobytes()

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text (null: none), packed, by chunks of some megabytes (a longer text is one of its own)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
            yield from self.chunk(texts.slice(at, stop - at))
            at = stop


_MANIFEST = "part int, uri string, n_docs long, n_tokens long"


def _writer(tokenizer: str, folder: str, doc_id: str, text: str, end_id: int):
    def write(batches):
        enc, part = None, TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.rec"
        out, at, offsets, tokens = None, 0, [], 0
        for batch in batches:
            if out is None and batch.num_rows:
                out, enc = Output(uri), Encoder(tokenizer)
                end = np.array([end_id], enc.kind).tobytes()
            buffer, held = [], 0
            for i, packed in zip(batch.column(doc_id).to_pylist(), enc.encode(batch.column(text)) if batch.num_rows else ()):
                record = frame(struct.pack(_DOC, i or 0, i is None, enc.width) + packed + end)
                tokens += len(packed) // enc.width + 1
                offsets.append(at)
                at += len(record)
                buffer.append(record)
                held += len(record)
                if held > 1 << 20:
                    out.write(b"".join(buffer))
                    buffer, held = [], 0
            if buffer:
                out.write(b"".join(buffer))
        if out is not None:
            out.close()
            index = Output(f"{uri}.idx")
            index.write(np.array(offsets, "<u8").tobytes())
            index.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "uri": [uri], "n_docs": pa.array([len(offsets)], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    return write


def write_records(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Encodes ``docs`` and writes record and index files in ascending order of ``doc_id``, one pair a partition.
    Returns the manifest (part, uri, n_docs, n_tokens), itself a written table: only files of tasks that ended
    well are in it, so repeated tasks add nothing."""
    folder = folder or fresh_folder(docs.sparkSession, "tokens")
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(frugal(_writer(tokenizer, folder, "doc_id", "text", end_id)), _MANIFEST), "manifest")


def offsets_of(uri: str) -> np.ndarray:
    """The index of a record file."""
    with open_input(f"{uri}.idx") as f:
        return np.frombuffer(f.read(), "<u8")


def read_record(data: bytes, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """The document at an offset: its id, its token ids, and where the next record starts. Raises on damage."""
    length, check = struct.unpack_from(_HEAD, data, at)
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"damaged length at {at}")
    payload = data[at + 12 : at + 12 + length]
    if len(payload) != length or masked(payload) != struct.unpack_from("<I", data, at + 12 + length)[0]:
        raise ValueError(f"damaged payload at {at}")
    i, null, width = struct.unpack_from(_DOC, payload)
    return None if null else i, np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(_DOC)), at + 16 + length


_READ = 8 << 20


def iter_records(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """All records of a file in order, holding some megabytes (or one record) at a time."""
    with open_input(uri) as f:
        data, at, more = b"", 0, True
        while more or at < len(data):
            if at + 12 > len(data) or at + 16 + struct.unpack_from(_HEAD, data, at)[0] > len(data):
                new = f.read(_READ)
                more = bool(new)
                if not new and at < len(data):
                    read_record(data, at)
                data, at = data[at:] + new, 0
                continue
            i, ids, at = read_record(data, at)
            yield i, ids


def _digests(batches):
    for batch in batches:
        for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist()):
            rows: list[tuple] = []
            for i, ids in iter_records(uri):
                rows.append((i, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                base += len(ids)
                if len(rows) == 10_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame) -> DataFrame:
    """Reads the files of a manifest back, checking every checksum: doc_id, start, n_tokens, ids_crc32."""
    # A row a file: few enough to be numbered in one task.
    before = F.sum("n_tokens").over(W.orderBy("part", "uri").rowsBetween(W.unboundedPreceding, -1))
    files = manifest.select("uri", F.coalesce(before, F.lit(0)).alias("base")).repartition(max(1, manifest.count()))
    return files.mapInArrow(frugal(_digests), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes ``docs`` as records and returns what reading them back gives."""
    return read_digests(write_records(docs, tokenizer, **options))
