"""SentencePiece encoding that keeps byte offsets, and decoding.

The text is normalised here, not by the library: at each position the longest prefix in the model's compiled character
map is replaced, and every byte written records the source byte it came from.  The library then cuts the normalised
text into pieces (its own normaliser switched off), and each piece is projected through the record to the bytes of the
original text.  A model with an empty map (such as ``piece_bpe_32k.model``) goes the same way; no prefix matches, so only
spaces and the leading mark are written anew.  Where no piece of a BPE vocabulary crosses the start of a word, words are cut
once and remembered, up to ``HELD_BYTES``.

Null and empty texts have no pieces and decode to the empty string.  Extra columns of the input are not carried; columns
``ids``, ``starts``, ``ends`` and ``decoded`` of the result never clash with them.  Repeated rows give repeated rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG_WORD, slices

SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Distinct words that a worker remembers, bytes of words and ids that it holds before it forgets the rarer ones, and bytes
#: of text that it turns into one batch.
REMEMBERED, HELD_BYTES, SLICE = 300_000, 48 << 20, 2 << 20


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] numbers), then the same for first[1], and so on."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 bytes, and the replacement strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :] if size else b""
        # a key can start only where its first byte stands
        root = (self.units[0] >> 10) << ((self.units[0] & 0x200) >> 6) if size else 0
        first = bytes(b for b in range(1, 256) if size and (root ^ b) < len(self.units) and self.units[root ^ b] & 0x800000FF == b)
        self.start = re.compile(b"[" + re.escape(first) + b"]") if first else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at``, and its replacement."""
        units, found = self.units, None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if (unit >> 8) & 1:
                value = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, value)
        if found is None:
            return None
        length, value = found
        return length, self.strings[value : self.strings.index(b"\0", value)]


class Normaliser:
    """Rewrites a text for a model and records, for every byte written, the byte of the source it stands for."""

    def __init__(self, proto):
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix = spec.add_dummy_prefix
        self.squeeze = spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        kept = sorted((p.piece.encode() for p in proto.pieces if p.type == p.USER_DEFINED), key=len, reverse=True)
        self.kept = re.compile(b"|".join(map(re.escape, kept))) if kept else None
        self.plain = not (self.kept or self.squeeze or self.suffix) and self.prefix and self.escape

    def step(self, data: bytes, at: int) -> tuple[bytes, int]:
        if self.kept and (m := self.kept.match(data, at)):
            return m[0], len(m[0])
        if self.map.units and (hit := self.map.longest(data, at)):
            return hit[1], hit[0]
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + n], n

    def substituted(self, data: bytes) -> tuple[bytes, np.ndarray | None]:
        """The bytes after the map's longest prefixes were replaced, and source offsets as below; none where nothing was."""
        if not self.map.start or not (m := self.map.start.search(data)):
            return data, None
        out, sources, kept = [], [], 0
        while m:
            at = m.start()
            if hit := self.map.longest(data, at):
                length, new = hit
                out += (data[kept:at], new)
                sources += (np.arange(kept, at), np.full(len(new), at))
                kept = at = at + length
            else:  # to the next character
                at += 1
                while at < len(data) and data[at] & 0xC0 == 0x80:
                    at += 1
            m = self.map.start.search(data, at)
        if not kept:
            return data, None
        return b"".join([*out, data[kept:]]), np.concatenate([*sources, np.arange(kept, len(data) + 1)]).astype(np.int32)

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and source offsets: one for each of them and one for the end."""
        out, source, at, end = bytearray(), [], 0, len(data)
        space = SPACE.encode() if self.escape else b" "
        if self.squeeze:
            while at < end:
                new, n = self.step(data, at)
                if new != b" ":
                    break
                at += n
        if at == end:
            return b"", np.zeros(1, np.int32)

        def put(piece: bytes) -> None:
            out.extend(piece)
            source.extend([at] * len(piece))

        if self.prefix and not self.suffix:
            put(space)
        after_space = self.squeeze
        while at < end:
            new, n = self.step(data, at)
            if after_space:
                new = new.lstrip(b" ")
            if new:
                put(new.replace(b" ", space))
                after_space = new.endswith(b" ")
            at += n
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            while out.endswith(space):
                at = source[len(out) - len(space)]
                del out[-len(space) :], source[-len(space) :]
        if self.prefix and self.suffix:
            put(space)
        return bytes(out), np.array([*source, at], np.int32)


class Encoder:
    """One model, loaded once in a worker."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            raw = f.read()
        proto = pb.ModelProto.FromString(raw)
        self.normaliser = Normaliser(proto)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=raw)
        spec = proto.normalizer_spec
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.length = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.measured = bool(proto.trainer_spec.byte_fallback)  # no unknown piece: an id tells its length
        crossing = any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces)
        self.by_word = self.measured and proto.trainer_spec.model_type == proto.trainer_spec.BPE and not crossing
        self.forget()

    def forget(self) -> None:
        self.word: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.first, self.count, self.hits = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.used = self.letters = 0

    def shrink(self) -> None:
        """Forget the words met least often and all long ones; the rest stay, cut as they are."""
        kept = [(w, i) for w, i in self.word.items() if self.hits[i] > 2 and len(w) <= LONG_WORD][: REMEMBERED // 2]
        at = np.fromiter((i for _, i in kept), np.int64, len(kept))
        count, first, hits = self.count[at], self.first[at], self.hits[at]
        flat = self.flat[ranges(first, count)]
        self.forget()
        self.store([w for w, _ in kept], flat, count)
        self.hits[: len(kept)] = hits // 2

    def store(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        base, end = len(self.word), self.used + len(flat)
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while base + len(words) > len(self.first):
            self.first, self.count, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count, self.hits))
        self.flat[self.used : end] = flat
        self.first[base : base + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.count[base : base + len(words)] = sizes
        self.word.update(zip(words, range(base, base + len(words)), strict=True))
        self.used = end
        self.letters += sum(map(len, words))

    def full(self) -> bool:
        return len(self.word) > REMEMBERED or 4 * (self.used + self.letters) > HELD_BYTES

    def find(self, words: list[str]) -> np.ndarray:
        """Numbers of distinct words (with their leading space marks); those not met before are cut now."""
        if new := [w for w in words if w not in self.word]:
            lists = self.cutter.encode(new, num_threads=1)
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            self.store(new, np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes)
        return np.fromiter(map(self.word.__getitem__, words), np.int64, len(words))

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of source texts in a row, and how many each text has."""
        odd = [t and ("  " in t or t[0] == " " or t[-1] == " " or SPACE in t) for t in texts]
        split = pa.compute.split_pattern(pa.array(["" if o else t for t, o in zip(texts, odd, strict=True)], pa.string()), " ")
        values = split.flatten().dictionary_encode()
        at = self.find([SPACE + w for w in values.dictionary.to_pylist()])[values.indices.to_numpy()]
        per = np.diff(split.offsets.to_numpy())
        if any(odd) or "" in texts:
            parts = np.split(at, np.cumsum(per)[:-1]) if len(texts) > 1 else [at]
            for i, t in enumerate(texts):
                if not t:
                    parts[i] = at[:0]
                elif odd[i]:
                    words = pa.array(WORD.findall(SPACE + t.replace(" ", SPACE)), pa.string()).dictionary_encode()
                    parts[i] = self.find(words.dictionary.to_pylist())[words.indices.to_numpy()]
            at, per = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return at, per

    def cut_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``cut``, from source texts of a model whose normaliser is plain and whose words can be cut one by one."""
        if self.full():
            self.shrink()
        at, per = self.numbered(texts)
        count = self.count[at]
        np.add.at(self.hits, at, 1)
        ids = self.flat[ranges(self.first[at], count)]
        ends = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(per)])]
        return ids, self.length[ids], np.diff(ends)

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all normalised texts in a row, their lengths in bytes, and the number of ids of each text."""
        if self.measured:
            lists = self.cutter.encode(texts, num_threads=1) if texts else []
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum()))
            return ids, self.length[ids], counts
        ids, lengths, counts = [], [], []
        for text in texts:
            pieces = self.cutter.encode(text, out_type="immutable_proto").pieces if text else []
            counts.append(len(pieces))
            ids.extend(p.id for p in pieces)
            lengths.extend(len(p.surface.encode()) for p in pieces)
        return np.array(ids, np.int32), np.array(lengths, np.int64), np.array(counts, np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and ends (bytes of the original text) of all texts in a row, and the number of ids of each."""
        data = [(t or "").encode() for t in column.to_pylist()]
        mapped = [self.normaliser.substituted(d) for d in data] if self.normaliser.plain else []
        if self.normaliser.plain and all(bool(d) == bool(m) for d, (m, _) in zip(data, mapped, strict=True)):
            texts = [m.decode() for m, _ in mapped]
            if self.by_word:
                ids, length, counts = self.cut_words(texts)
            else:
                ids, length, counts = self.cut([SPACE + t.replace(" ", SPACE) if t else "" for t in texts])
            source = self.plain_source([m for m, _ in mapped], [o for _, o in mapped])
        else:
            done = [self.normaliser(d) for d in data]
            ids, length, counts = self.cut([d[0].decode() for d in done])
            source = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int32)
        begin = np.cumsum(length) - length  # among the normalised bytes of all texts
        begin += np.repeat(np.arange(len(data)), counts)  # each text's record has one entry more than bytes
        return ids, source[begin], source[begin + length], counts

    @staticmethod
    def plain_source(data: list[bytes], offsets: list[np.ndarray | None]) -> np.ndarray:
        """The records of texts whose map is done (``offsets``), after spaces and the prefix took three bytes each."""
        size = np.fromiter(map(len, data), np.int64, len(data))
        joined = np.frombuffer(b"".join(d + b"." for d in data), np.uint8)  # the dot stands for the end
        ends = np.cumsum(size + 1)
        width = np.where(joined == 32, np.int8(3), np.int8(1))
        width[ends - 1] = 1
        full = size > 0
        local = (np.arange(len(joined)) - np.repeat(ends - size - 1, size + 1)).astype(np.int32)
        for i, found in enumerate(offsets):
            if found is not None:
                local[ends[i] - size[i] - 1 : ends[i]] = found
        width[(ends - size - 1)[full]] += 3
        return np.repeat(local, width)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


SCHEMA = "ids array<int>, starts array<int>, ends array<int>, decoded string"


def encode(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``ids``, ``starts``, ``ends`` (byte spans in the original text, end exclusive) and ``decoded`` of each row.

    ``model`` is a path that every executor can open: the model is part of the installation, or shipped with the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(model)
        for part in slices(batches, 1, SLICE):
            ids, starts, ends, counts = tool.encode(part.column(1))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            decoded = [tool.whole.decode(ids[a:b].tolist()) if b > a else "" for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (ids, starts, ends)]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists, pa.array(decoded, pa.string())], names=["key", "ids", "starts", "ends", "decoded"])

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of encoded rows; ``covered_to`` is the byte at which the last piece ends."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.when(F.size("ends") > 0, F.element_at("ends", -1)).otherwise(0).cast("long").alias("covered_to"),
    )
