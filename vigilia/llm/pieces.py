"""Offset-preserving SentencePiece encoding, and decoding.

The model file's normaliser is read from its protobuf. Normalising walks the source: a stretch that begins no entry of the
compiled character map (a double-array trie and a pool of replacements) is copied, elsewhere the longest entry is replaced;
white space is squeezed, escaped and prefixed as the model says. Every byte of the normalised text keeps the source byte from
which it came. The sentencepiece library segments the normalised text with the same vocabulary and no normaliser. The running
sum of the pieces' lengths are their places in the normalised text, and the alignment projects each to its span of source
bytes; of a symbol spelt by bytes, the last byte's piece has the span.

Each row is on its own: no shuffle, ``BATCH`` documents in memory at a time; the model travels once as a broadcast of its
file's bytes. Decoding turns lists of ids into text with the library.

Cases: null and empty texts give no ids and decode to the empty text; bytes that are no UTF-8 count as U+FFFD each; very long
texts are encoded whole; repeated rows and null ids are rows like any other; an empty table gives an empty result; other
columns are left out. Models without byte fallback or with user-defined pieces are refused with a ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"  # stands for a space in pieces
USER_DEFINED, BYTE = 4, 6  # kinds of pieces in the model's format
BATCH = 256  # documents at a time


class CharMap:
    """Longest-prefix replacement through a compiled character map."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.pool = blob[4 + size:]
        heads = sorted(b for b in range(256) if self._step(0, b) is not None) if size else []
        self.heads = re.compile(b"[" + re.escape(bytes(heads)) + b"]") if heads else None

    def _step(self, node: int, byte: int) -> int | None:
        """Node behind ``byte``: a unit holds its label in the low byte and the offset of its children above."""
        unit = self.units[node]
        to = node ^ ((unit >> 10) << ((unit & 0x200) >> 6)) ^ byte
        return to if to < len(self.units) and self.units[to] & 0x800000FF == byte else None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest entry that begins at ``at``."""
        node, found = 0, None
        for i in range(at, len(text)):
            if (node := self._step(node, text[i])) is None:
                break
            unit = self.units[node]
            if unit & 0x100:  # an entry ends here: its value is the leaf's
                leaf = self.units[node ^ ((unit >> 10) << ((unit & 0x200) >> 6))]
                found = i + 1 - at, leaf & 0x7FFFFFFF
        if found is None:
            return None
        n, start = found
        return n, self.pool[start:self.pool.index(b"\0", start)]

    def replaced(self, text: bytes) -> Iterator[tuple[int, int, bytes | None]]:
        """(begin, end, replacement) of consecutive parts of the source; None: copied as it is."""
        copied = at = 0
        while self.heads and (m := self.heads.search(text, at)):
            at = m.start()
            if (hit := self.longest(text, at)) is None:
                at += 1
                while at < len(text) and text[at] & 0xC0 == 0x80:  # entries begin at characters
                    at += 1
                continue
            if copied < at:
                yield copied, at, None
            yield at, at + hit[0], hit[1]
            copied = at = at + hit[0]
        if copied < len(text):
            yield copied, len(text), None


def valid(text: bytes) -> tuple[bytes, np.ndarray | None]:
    """Text with each byte that is no UTF-8 as U+FFFD, and the source byte of every byte (None: its own place)."""
    try:
        text.decode("utf-8")
        return text, None
    except UnicodeDecodeError:
        out, at, i = [], [], 0
        while i < len(text):
            n = next((n for n in (1, 2, 3, 4) if _is_char(text[i:i + n])), 0)
            part = text[i:i + n] if n else "�".encode()
            out.append(part)
            at += range(i, i + n) if n else [i] * len(part)
            i += n or 1
        return b"".join(out), np.array([*at, len(text)], np.int32)


def _is_char(part: bytes) -> bool:
    try:
        return len(part.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


class Normaliser:
    """Text to normalised text and the source byte of each of its bytes (and of its end)."""

    def __init__(self, charmap: bytes = b"", dummy_prefix: bool = True, squeeze: bool = True, escape: bool = True, suffix: bool = False):
        self.map, self.dummy_prefix, self.squeeze, self.escape, self.suffix = CharMap(charmap), dummy_prefix, squeeze, escape, suffix

    def __call__(self, source: bytes) -> tuple[bytes, np.ndarray]:
        text, places = valid(source)
        parts, spans = [], []
        for begin, end, new in self.map.replaced(text):
            part = np.frombuffer(text[begin:end] if new is None else new, np.uint8)
            parts.append(part)
            if new is not None:
                spans.append(np.full(len(part), begin, np.int32))
            else:  # every byte belongs to its character's first byte
                place = np.arange(begin, end, dtype=np.int32)
                spans.append(place if text.isascii() else np.maximum.accumulate(np.where(part & 0xC0 == 0x80, 0, place)))
        out = np.concatenate([np.zeros(0, np.uint8), *parts])
        align = np.concatenate([np.zeros(0, np.int32), *spans])
        if self.squeeze:
            space = out == 32
            keep = ~(space & np.concatenate([[True], space[:-1]])[:len(out)])
            out, align = out[keep], align[keep]
        if self.dummy_prefix and len(out if self.squeeze else text):
            end = len(text)
            if self.suffix:
                out, align = np.append(out, np.uint8(32)), np.append(align, np.int32(end))
            else:
                out, align = np.concatenate([np.array([32], np.uint8), out]), np.concatenate([align[:1] if len(align) else np.array([end], np.int32), align])
        data, mark = out.tobytes(), b" "
        if self.escape:
            mark = MARK.encode()
            data, align = data.replace(b" ", mark), np.repeat(align, np.where(out == 32, len(mark), 1))
        align = np.append(align, np.int32(len(text)))
        if self.squeeze:  # marks at the end go, also those that the source spells
            n = len(data)
            while data.endswith(mark, 0, n):
                n -= len(mark)
            data, align = data[:n], align[:n + 1]
        return data, align if places is None else places[align]


class Encoder:
    """Pieces of texts and their spans of source bytes."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto.FromString(model)
        if not m.trainer_spec.byte_fallback or any(p.type == USER_DEFINED for p in m.pieces):
            raise ValueError("only models with byte fallback and without user-defined pieces are encoded")
        self.lengths = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in m.pieces], np.int32)
        n = m.normalizer_spec
        self.normalise = Normaliser(n.precompiled_charsmap, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces, m.trainer_spec.treat_whitespace_as_suffix)
        # the same vocabulary for text that is normalised already
        n.precompiled_charsmap, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = b"", False, False, False
        self.segment = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString()).encode

    def encode(self, sources: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begins, ends) of each text: every piece and its span of source bytes."""
        texts = [self.normalise(s) for s in sources]
        out = []
        for ids, (_, align) in zip(self.segment([t for t, _ in texts], num_threads=1, return_type="numpy") if texts else [], texts, strict=True):
            places = align[np.concatenate([np.zeros(1, np.int32), np.cumsum(self.lengths[ids], dtype=np.int32)])]
            out.append((ids, places[:-1], places[1:]))
        return out


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]), pa.int32()))


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, begins, ends) per row: piece i covers the source bytes from begins[i] to ends[i]."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                got = encoder.encode(part.column("text").to_pylist())
                yield pa.record_batch({"doc_id": part.column("doc_id"), **{c: _lists([g[k] for g in got]) for k, c in enumerate(("ids", "begins", "ends"))}})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, model: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids (null ids: the empty text)."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                ids = part.column(ids_col).fill_null([])
                lists = np.split(ids.flatten().to_numpy().astype(np.int32, copy=False), np.cumsum(ids.value_lengths().to_numpy())[:-1])
                yield pa.record_batch([*part.columns, pa.array(processor.decode(lists, num_threads=1), pa.string())], [*part.schema.names, out_col])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())]))


def id_list(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
