"""Byte-level BPE encoding and decoding with an index from pairs to all their positions.

A task collects the distinct words of a stretch of texts, lays their bytes out as one symbol array and maps every
adjacent pair that has a rank to all its positions. Active ranks are applied in ascending order, each to all
its positions at once, and only the lists of the pairs beside a merged position change. The texts are then
put together from their words' ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from demandgrid.llm.shared import binary_texts, frugal, slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
# The split of the vocabulary's library, whose white space is the Unicode property. Fixed value.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) != " "]
NO_RANK = np.int32(2**31 - 1)
MOST_WORDS = 100_000  # pieces remembered between slices, about 20 MB
AT_ONCE = 16_000  # words merged at once, so that their symbols, links and positions stay small


class PairMerges:
    """The vocabulary as arrays, and the merging of many words at once."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        shown = self.shown_bytes()
        self.tokens = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, number in vocab.items():
            self.tokens[number] = bytes(map(shown.__getitem__, token))
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        for token, number in self.special.items():
            self.tokens[number] = token.encode()
        self.byte_ids = np.zeros(256, np.int32)
        for char, byte in shown.items():
            self.byte_ids[byte] = vocab[char]
        self.size = len(self.tokens)
        pairs = [merge if isinstance(merge, list) else merge.split(" ") for merge in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.left = np.array([vocab[a] for a, _ in pairs])
        self.right = np.array([vocab[b] for _, b in pairs])
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)

    @staticmethod
    def shown_bytes() -> dict[str, int]:
        """The characters that stand for bytes in the vocabulary: printable Latin ones for themselves, the rest from 256 on."""
        plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        rest = [byte for byte in range(256) if byte not in set(plain)]
        return {chr(byte): byte for byte in plain} | {chr(256 + k): byte for k, byte in enumerate(rest)}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_RANK)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbols)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(sizes)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        rank = np.full(n, NO_RANK)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.rank_of(symbols[inner], symbols[inner + 1])
        alive, here = np.ones(n, bool), np.zeros(n, bool)
        positions: dict[int, list[np.ndarray]] = {}

        def listed(at: np.ndarray) -> None:
            at = at[rank[at] != NO_RANK]
            at = at[np.argsort(rank[at], kind="stable")]
            ranks = rank[at]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.r_[0, cuts]].tolist() if len(at) else [], np.split(at, cuts)):
                if r in positions:
                    positions[r].append(part)
                else:
                    positions[r] = [part]
                    heapq.heappush(active, r)

        active: list[int] = []
        listed(inner)
        while active:
            r = heapq.heappop(active)
            lists = positions.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = np.sort(at[rank[at] == r])
            if len(lists) > 1:
                at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
            if not len(at):
                continue
            if self.left[r] == self.right[r] and len(at) > 1:  # in a run of one symbol every other pair, from its left end
                chained = np.r_[False, after[at[:-1]] == at[1:]]
                start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            gone = after[at]
            symbols[at] = self.merged[r]
            alive[gone] = False
            rank[gone] = NO_RANK
            follow = after[gone]
            after[at] = follow
            has_follow = follow >= 0
            before[follow[has_follow]] = at[has_follow]
            rank[at[~has_follow]] = NO_RANK
            ahead = before[at]
            ahead = ahead[ahead >= 0]
            here[at] = True
            touched = np.concatenate([at[has_follow], ahead[~here[ahead]]])
            here[at] = False
            rank[touched] = self.rank_of(symbols[touched], symbols[after[touched]])
            listed(touched)
        counts = np.add.reduceat(alive, (ends - sizes)[sizes > 0]) if n else np.empty(0, np.int64)
        per_word = np.zeros(len(words), np.int64)
        per_word[sizes > 0] = counts
        return symbols[alive].astype(np.uint32), per_word


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches ``values[start : start + size]`` one after another."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


class Pieces(dict):
    """Numbers of pieces of text; a new piece gets the next number and joins the encoder's list of new ones."""

    def __init__(self, encoder: TextEncoder, space: str):
        self.encoder, self.space = encoder, space

    def __missing__(self, piece: str) -> int:
        number = self[piece] = self.encoder.known + len(self.encoder.new)
        self.encoder.new.append(self.space + piece)
        return number


class TextEncoder:
    """Turns texts into ids; remembers the ids of up to ``MOST_WORDS`` pieces between calls."""

    def __init__(self, content: bytes):
        self.merges = PairMerges(content)
        self.split = regex.compile(SPLIT)
        special = "|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True)))
        self.at_special = re.compile(f"({special})") if special else None
        self.forget()

    def forget(self) -> None:
        self.first, self.later = Pieces(self, ""), Pieces(self, " ")
        self.new: list[str] = []
        self.known = 0
        self.ids, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def pieces(self, text: str) -> list[int]:
        """Numbers of the pieces of a text: words cut at lone spaces, where no pre-token crosses; else its pre-tokens."""
        if not text:
            return []
        if text[0].isspace() or text[-1].isspace() or "  " in text or any(c in text and (c + " " in text or " " + c in text) for c in OTHER_SPACE):
            return list(map(self.first.__getitem__, self.split.findall(text)))
        head, *rest = text.split(" ")
        return [self.first[head], *map(self.later.__getitem__, rest)]

    def learn(self) -> None:
        """Encodes the pieces met since the last call."""
        words: dict[str, int] = {}
        flat, cut = [], []  # the words of all new pieces, and how many words the pieces that are not one word have
        for number, piece in enumerate(self.new):
            if piece.isalpha() or piece[0] == " " and piece[1:].isalpha():
                flat.append(words.setdefault(piece, len(words)))
            else:
                found = self.split.findall(piece)
                cut.append((number, len(found)))
                for word in found:
                    flat.append(words.setdefault(word, len(words)))
        distinct = [word.encode() for word in words]
        merged = [self.merges.encode(distinct[k : k + AT_ONCE]) for k in range(0, max(1, len(distinct)), AT_ONCE)]
        ids, counts = map(np.concatenate, zip(*merged))
        flat, per_piece = np.array(flat, np.int64), np.ones(len(self.new), np.int64)
        if cut:
            at, found = np.array(cut).T
            per_piece[at] = found
        of_piece = np.repeat(np.arange(len(per_piece)), per_piece)
        sizes = np.bincount(of_piece, weights=counts[flat], minlength=len(per_piece)).astype(np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, gathered(ids, (np.cumsum(counts) - counts)[flat], counts[flat])])
        self.known += len(self.new)
        self.new = []

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        if self.known > MOST_WORDS:
            self.forget()
        numbered = []
        for text in texts:
            sections = self.at_special.split(text) if self.at_special and any(s in text for s in self.merges.special) else [text]
            numbered.append([
                self.merges.special[section] if k % 2 else np.array(self.pieces(section), np.int32) for k, section in enumerate(sections)
            ])
        self.learn()
        for sections in numbered:
            parts = [
                np.array([s], np.uint32) if isinstance(s, int) else gathered(self.ids, self.starts[s], self.sizes[s]) for s in sections
            ]
            yield parts[0] if len(parts) == 1 else np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a list of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.merges.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encoded(
    docs: DataFrame, vocabulary: str = VOCABULARY, ids: bool = True, decoded: bool = False, digests: bool = False,
    most_bytes: int = 4 << 20,
) -> DataFrame:
    """(doc_id, n_tokens, and on request ids, decoded, ids_sha256, decoded_sha256) for every row of ``docs``.

    ``vocabulary`` is a byte-level BPE file in the tokenizers library's JSON form; the driver reads it and broadcasts its
    bytes (the file is the size bound). Its special strings become their own ids. ``ids_sha256`` is over the ids as little-endian
    unsigned 32-bit integers, ``decoded_sha256`` over the decoded text in UTF-8. A null text is an empty one, with no
    tokens. A null or repeated doc_id is carried along; other columns are not read. Texts are never cut; a task holds
    about ``most_bytes`` of text with its distinct words at a time, and the ids of 100,000 more.
    """
    with open(vocabulary, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    fields = [("doc_id", docs.schema["doc_id"].dataType.simpleString()), ("n_tokens", "bigint")]
    fields += [("ids", "array<int>")] * ids + [("decoded", "string")] * decoded
    fields += [("ids_sha256", "string"), ("decoded_sha256", "string")] * digests

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in slices(batches, "text", most_bytes):
            encoder = encoder or TextEncoder(content.value)
            texts = [value.decode("utf-8", "replace") for value in binary_texts(batch.column("text"))]
            out = {name: [] for name, _ in fields[1:]}
            for one in encoder.encode(texts):
                out["n_tokens"].append(len(one))
                text = encoder.decode(one) if decoded or digests else None
                if ids:
                    out["ids"].append(one.astype(np.int32))
                if decoded:
                    out["decoded"].append(text)
                if digests:
                    out["ids_sha256"].append(hashlib.sha256(one.astype("<u4").tobytes()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out.values())], [name for name, _ in fields])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), ", ".join(f"{name} {kind}" for name, kind in fields))


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """Nulls, empty and long texts, ties, repeated rows and empty tables: see :func:`encoded`."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=False, digests=True)
