"""Token counts of whole texts by overlap resynchronisation.

A huge text is encoded as overlapping chunks. Inside each overlap the two encodings are spliced at a byte position that is
a token boundary in both of them and that is proven stable: a character that is no white space stands before it and a
plain blank, tab or line break behind it. No pre-token of a byte-level tokenizer holds white space after another
character, and the only look-ahead of its splitting pattern concerns runs of white space, so what is encoded up to such a
position does not depend on what follows, and what is encoded from there on does not depend on what precedes. If an overlap
holds no such position, it is widened, up to the end of the text if need be.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The splitting pattern of byte-level tokenizers of this family (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STABLE = re.compile(r"\S(?=[ \t\r\n])")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, n_chunks int"


def byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes to ids, and special strings to ids, of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    table = byte_of()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(table[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    return ranks, special


class Encoder:
    """Ids of a text and the byte offset at which each token ends."""

    def __init__(self, path: str):
        import tiktoken

        ranks, special = read_vocabulary(path)
        self.core = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.tokens = {rank: token for token, rank in ranks.items()} | {rank: token.encode() for token, rank in special.items()}
        self.lengths = np.zeros(max(self.tokens) + 1, np.int64)
        for rank, token in self.tokens.items():
            self.lengths[rank] = len(token)

    def ids(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, allowed_special=self.special)

    def chunk(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = self.ids(text)
        return ids, np.cumsum(self.lengths[ids])

    def long_ids(self, text: str, chunk: int, overlap: int) -> tuple[np.ndarray, int]:
        """Ids of a text of any length and the number of chunks it took. ``chunk`` and ``overlap`` are characters."""
        parts, chunks, start, skip = [], 1, 0, 0
        end = min(len(text), chunk + overlap)
        ids, ends = self.chunk(text[start:end])
        while end < len(text):
            follow, width = start + chunk, overlap
            chunks += 1
            while True:
                stop = min(len(text), max(follow + chunk + overlap, end))
                next_ids, next_ends = self.chunk(text[follow:stop])
                cut = self._splice(text, start, follow, end, ends, next_ends)
                if cut is not None or end == len(text):
                    break
                width *= 2
                end = min(len(text), follow + width)
                ids, ends = self.chunk(text[start:end])
            if cut is None:  # the left chunk now reaches the end of the text
                break
            left, right = cut
            parts.append(ids[skip:left])
            ids, ends, skip, start, end = next_ids, next_ends, right, follow, stop
        parts.append(ids[skip:])
        return np.concatenate(parts), chunks

    @staticmethod
    def _splice(text: str, start: int, follow: int, end: int, ends: np.ndarray, next_ends: np.ndarray) -> tuple[int, int] | None:
        """Numbers of tokens before the first proven boundary in ``follow .. end`` that both encodings share."""
        base = len(text[start:follow].encode())
        for match in STABLE.finditer(text, follow, end):
            if match.end() >= end:
                break
            at = len(text[follow : match.end()].encode())
            left, right = int(np.searchsorted(ends, base + at)), int(np.searchsorted(next_ends, at))
            if left < len(ends) and right < len(next_ends) and ends[left] == base + at and next_ends[right] == at:
                return left + 1, right + 1
        return None


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def count_tokens(docs: DataFrame, tokenizer: str, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes, n_tokens, n_chunks``; other columns are ignored.

    ``tokenizer`` is the path of a byte-level tokenizer file on the executors; special strings in a text count as one token,
    no others are added. A null or empty text has 0 bytes and 0 tokens. Null and repeated ids and texts pass through row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            sizes, counts, chunks = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                ids, n = (coder.ids(text), 1) if len(text) <= chunk + overlap else coder.long_ids(text, chunk, overlap)
                counts.append(len(ids))
                chunks.append(n)
                sizes.append(int(coder.lengths[ids].sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(chunks, pa.int32())],
                ["doc_id", "n_bytes", "n_tokens", "n_chunks"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
