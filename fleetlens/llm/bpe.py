"""Byte-pair encoding and decoding with forced boundaries.

Two neighbouring bytes that occur next to each other inside no token of the vocabulary always belong to two tokens. Such a
position is a certain cut, and the fragments between cuts can be encoded on their own, if the splitting pattern also acts
on them as on the whole text. That holds when the byte before the cut is no white space (the pattern looks ahead only over
white space), the cut lies between two characters, and the fragment behind it does not begin with an apostrophe (which
might start a contraction only there). Pairs inside special strings and contractions count as occurring in a token.

Fragments are mostly single words, so equal ones are encoded once per worker and looked up afterwards.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from fleetlens.llm.texts import SPACE, Block, byte_blocks
from fleetlens.llm.token_count import encoder, read_vocabulary

CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SCHEMA = "doc_id long, n_tokens long, ids string, decoded string"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def joined_pairs(path: str) -> np.ndarray:
    """256 x 256 flags: the pair stands inside some token."""
    ranks, special = read_vocabulary(path)
    table = np.zeros((256, 256), bool)
    for token in [*ranks, *(s.encode() for s in special), *(c.encode() for c in CONTRACTIONS)]:
        table[list(token[:-1]), list(token[1:])] = True
    return table


class Codec:
    """Encodes and decodes fragments and remembers up to ``remembered`` of them (about 300 bytes each)."""

    def __init__(self, path: str, remembered: int = 500_000):
        self.encoder = encoder(path)
        self.apart = ~joined_pairs(path).ravel()
        self.seen: dict[bytes, tuple[int, str, str]] = {}
        self.remembered = remembered

    def cuts(self, block: Block) -> np.ndarray:
        """Sorted starts of fragments, the end of the block as last element."""
        data = block.data
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            left, right = data[:-1], data[1:]
            free = self.apart[left.astype(np.uint16) * np.uint16(256) + right]
            cut[1:-1] = free & ~SPACE[left] & ((right < 0x80) | (right >= 0xC0)) & (right != 39) & ~self._wide_space(data)[:-1]
        cut[block.starts] = True
        cut[len(data)] = True
        return np.flatnonzero(cut)

    @staticmethod
    def _wide_space(data: np.ndarray) -> np.ndarray:
        """Last bytes of what may be white space outside ASCII."""
        found = np.zeros(len(data), bool)
        high = data >= 0x80
        found[1:] = high[1:] & (data[:-1] == 0xC2) & np.isin(data[1:], (0x85, 0xA0))
        if len(data) > 2:
            found[2:] |= high[2:] & (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3) & np.isin(data[1:-1], (0x80, 0x81, 0x9A))
        return found

    def encode(self, fragments: list[bytes]) -> list[tuple[int, str, str]]:
        """Number of ids, ids joined by commas and decoded text of each distinct fragment."""
        new = [f for f in fragments if f not in self.seen]
        if new:
            if len(self.seen) + len(new) > self.remembered:
                self.seen.clear()
                new = fragments
            plain, whole, tokens = self.encoder.core.encode_ordinary, self.encoder.ids, self.encoder.tokens
            for fragment in new:
                text = fragment.decode()
                ids = whole(text).tolist() if any(s in text for s in self.encoder.special) else plain(text)
                self.seen[fragment] = len(ids), ",".join(map(str, ids)), b"".join([tokens[i] for i in ids]).decode(errors="replace")
        return [self.seen[f] for f in fragments]

    def block(self, block: Block) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Token counts, joined ids and decoded texts of the rows of a block."""
        at = self.cuts(block) if len(block.data) else np.zeros(1, np.int64)
        fragments = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(block.data)])
        coded = fragments.dictionary_encode()
        known = self.encode(coded.dictionary.to_pylist())
        index = coded.indices
        first = np.searchsorted(at[:-1], block.starts)
        offsets = pa.array(np.append(first, len(at) - 1), pa.int32())
        sizes = np.array([k[0] for k in known], np.int64)[np.asarray(index)] if known else np.zeros(0, np.int64)
        before = np.concatenate(([0], np.cumsum(sizes)))
        edges = np.append(first, len(at) - 1)
        counts = before[edges[1:]] - before[edges[:-1]]
        joined = [pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array([k[i] for k in known], pa.string()).take(index)), glue)
                  for i, glue in ((1, ","), (2, ""))]
        return counts, *joined


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _sha256(column: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in column], pa.string())


def encode_decode(docs: DataFrame, tokenizer: str, digests: bool = False) -> DataFrame:
    """Ids (joined by commas) and decoded text of every whole text; with ``digests`` their SHA-256 instead.

    Null and empty texts have no ids and decode to the empty text. Rows pass through one by one, so repeated rows and null
    ids stay; further columns are ignored.
    """
    schema = DIGEST_SCHEMA if digests else SCHEMA
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer)
        for batch in batches:
            for block in byte_blocks(batch.column(1)):
                counts, ids, texts = coder.block(block)
                if digests:
                    ids, texts = _sha256(ids), _sha256(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(counts)), pa.array(counts, pa.int64()), ids, texts], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
