"""Byte-level BPE as a reduction over a tree: halves are encoded on their own and joined at their border; decoding concatenates."""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Characters of text encoded without being halved, bytes of one match merged without being halved.
LEAF_CHARS, LEAF_BYTES = 4096, 16
#: Bytes whose least pair is sought anew for each merge; longer stretches keep a queue.
SHORT = 48
#: A worker keeps the tokens of so many matches of up to so many characters, and of so many pairs of tokens; then it starts anew.
KEPT, KEPT_CHARS = 1 << 18, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base-64 token and its rank on each line."""
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


class Coder:
    """Encodes and decodes by ranks: of two neighbours whose bytes together are a token, those of least rank, the left one first, become it.

    Two facts carry the joins. Merges that cross a border between two tokens depend on these two tokens alone: as long as
    no border was crossed, what happens within two neighbours is what would happen to them on their own. So a row of
    tokens encodes its bytes if and only if each neighbouring pair does (`stands`). And a match of the pattern depends on
    its own characters and the two after it, never on those before: one that ends two characters before the border is
    final, and from the first place where both sides begin a match the right side's matches hold.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.leaf_chars, self.leaf_bytes = max(1, leaf_chars), max(1, leaf_bytes)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.matches = _Matches(self)

    # one match of the pattern

    def merged(self, data: bytes) -> list[int]:
        """The merges, least rank first, over the whole of a stretch of bytes."""
        if len(data) > SHORT:
            return self._merged_long(data)
        ranks, none = self.ranks, 1 << 62
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def _merged_long(self, data: bytes) -> list[int]:
        """The same with a queue of pairs, so that the time grows with the length but for a logarithm."""
        ranks, size = self.ranks, len(data)
        ends = list(range(1, size + 1))  # ends[i]: end of the part that starts at i
        before = list(range(-1, size - 1))  # start of the part before
        queue = [(ranks[two], i, i + 2) for i in range(size - 1) if (two := data[i : i + 2]) in ranks]
        heapq.heapify(queue)
        while queue:
            _, i, end = heapq.heappop(queue)
            if not (middle := ends[i]) or middle >= size or ends[middle] != end:
                continue  # one of the two was merged meanwhile
            ends[i], ends[middle] = end, 0
            if end < size:
                before[end] = i
                if (rank := ranks.get(data[i : ends[end]])) is not None:
                    heapq.heappush(queue, (rank, i, ends[end]))
            if i and (rank := ranks.get(data[(left := before[i]) : end])) is not None:
                heapq.heappush(queue, (rank, left, end))
        out, i = [], 0
        while i < size:
            out.append(ranks[data[i : ends[i]]])
            i = ends[i]
        return out

    def pair(self, a: int, b: int) -> list[int]:
        """Tokens of two neighbouring tokens' bytes together."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b])
        return known

    def stands(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens stay as they are."""
        return self.pair(a, b) == [a, b]

    def joined(self, a: list[int], b: list[int]) -> list[int]:
        """Tokens of two stretches together: the tokens at their border are encoded anew, ever more of them, until the pairs at both ends of what came out stand."""
        if not a or not b:
            return a + b
        x = y = 1
        new = self.pair(a[-1], b[0])
        while True:
            left = x >= len(a) or self.stands(a[-x - 1], new[0])
            right = y >= len(b) or self.stands(new[-1], b[y])
            if left and right:
                return a[: len(a) - x] + new + b[y:]
            x, y = x if left else min(2 * x, len(a)), y if right else min(2 * y, len(b))
            new = self.merged(b"".join(map(self.bytes_of.__getitem__, a[-x:] + b[:y])))

    def halved(self, data: bytes) -> list[int]:
        """Tokens of one match: those of its halves, joined."""
        if len(data) <= self.leaf_bytes:
            return self.merged(data)
        middle = len(data) // 2
        return self.joined(self.halved(data[:middle]), self.halved(data[middle:]))

    # whole texts

    def _leaf(self, text: str, low: int, high: int) -> _Part:
        found = self.pattern.findall(text, low, high)
        tokens = list(map(self.matches.__getitem__, found))
        return _Part(low, array("q", accumulate(map(len, found), initial=low))[1:], array("I", map(len, tokens)), array("I", chain.from_iterable(tokens)))

    def _both(self, text: str, a: _Part, b: _Part) -> _Part:
        """One part of two neighbours: matches at the border are sought anew, from the last final one of the left side to the first that the right side has too."""
        middle, high = b.low, b.ends[-1]
        cut, dropped = len(a.ends), 0
        while cut and a.ends[cut - 1] > middle - 2:
            cut -= 1
            dropped += a.counts[cut]
        at = a.ends[cut - 1] if cut else a.low
        # what both sides know of the stretch in between: (start, end, tokens)
        known, first = [], len(a.ids) - dropped
        for k in range(cut, len(a.ends)):
            known.append((a.ends[k - 1] if k else a.low, a.ends[k], a.ids[first : first + a.counts[k]]))
            first += a.counts[k]
        kept = len(a.ids) - dropped
        ends, counts, ids = a.ends[:cut], a.counts[:cut], a.ids[:kept]
        of_b = used = 0  # matches and tokens of b that the new ones replace
        while at < high:
            begins = b.ends[of_b - 1] if of_b else middle
            if at == begins:
                break
            if at > begins:
                known.append((begins, b.ends[of_b], b.ids[used : used + b.counts[of_b]]))
                used += b.counts[of_b]
                of_b += 1
                continue
            end = self.pattern.match(text, at, high).end()
            while of_b < len(b.ends) and b.ends[of_b] <= end:
                known.append((b.ends[of_b - 1] if of_b else middle, b.ends[of_b], b.ids[used : used + b.counts[of_b]]))
                used += b.counts[of_b]
                of_b += 1
            tokens = self._known(text, at, end, known)
            ends.append(end)
            counts.append(len(tokens))
            ids.extend(tokens)
            at = end
        return _Part(a.low, ends + b.ends[of_b:], counts + b.counts[of_b:], ids + b.ids[used:])

    def _known(self, text: str, low: int, high: int, known: list[tuple[int, int, array]]) -> list[int]:
        """Tokens of a match: a long one joins those of the old matches within it and encodes only what lies between."""
        if high - low <= self.leaf_chars or text[low:high].encode() in self.ranks:
            return self.matches[text[low:high]]
        out, at = [], low
        for start, end, tokens in known:
            if at <= start and end <= high and len(tokens) > 1:  # one token may be one that no merges make
                if at < start:
                    out = self.joined(out, self.halved(text[at:start].encode()))
                out, at = self.joined(out, list(tokens)), end
        return self.joined(out, self.halved(text[at:high].encode())) if at < high else out

    def _part(self, text: str, low: int, high: int) -> _Part:
        if high - low <= self.leaf_chars:
            return self._leaf(text, low, high)
        middle = (low + high) // 2
        return self._both(text, self._part(text, low, middle), self._part(text, middle, high))

    def encode(self, text: str) -> array:
        """Token ids of a text, without special tokens."""
        if len(text) <= self.leaf_chars:
            return array("I", chain.from_iterable(map(self.matches.__getitem__, self.pattern.findall(text))))
        return self._part(text, 0, len(text)).ids

    def decode(self, ids: array) -> bytes:
        """Bytes of the tokens: those of both halves, one after the other."""
        if len(ids) <= self.leaf_chars:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


class _Part:
    """Encoded stretch of a text: where it starts, where each match ends, how many tokens each has, all tokens."""

    __slots__ = ("low", "ends", "counts", "ids")

    def __init__(self, low: int, ends: array, counts: array, ids: array):
        self.low, self.ends, self.counts, self.ids = low, ends, counts, ids


class _Matches(dict):
    """Tokens of each match seen; a match that is a token as a whole is that token. When full, it starts anew and takes from what it held what comes again."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder, self.held = coder, {}

    def __missing__(self, match: str) -> list[int]:
        tokens = self.held.get(match)
        if tokens is None:
            data = match.encode()
            tokens = [self.coder.ranks[data]] if data in self.coder.ranks else self.coder.halved(data)
        if len(match) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.held = dict(self)
                self.clear()
            self[match] = tokens
        return tokens


_coders: dict[tuple[str, str], Coder] = {}


def _coded(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ranks, pattern = sent.value
        if (name, pattern) not in _coders:  # kept for all tasks of a worker
            _coders.clear()
            _coders[name, pattern] = Coder(ranks, pattern)
        coder = _coders[name, pattern]
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                ids = [coder.encode((t or b"").decode("utf-8", "replace")) for t in part.column("data").to_pylist()]
                packed = pa.array([np.frombuffer(i, np.uint32).astype("<u4").tobytes() for i in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), packed, pa.array([coder.decode(i) for i in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return run


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary: the tokens of the whole text as little-endian numbers of 32 bits) and decoded (their bytes) of each row of docs.

    ranks_path: file of ranks, read by the driver and sent once to each executor (its size is that of the vocabulary).
    A null text counts as empty and has no tokens. Text that spells a special token is ordinary text; bytes that are
    no UTF-8 count as U+FFFD. Repeated rows come out as often as they go in, a null doc_id stays null, other columns are not
    read, an empty table gives an empty one. A row is encoded in one task, without a shuffle; long texts and long matches
    are halved and joined, so that their cost grows with their length but for a logarithm.
    """
    ranks = read_ranks(ranks_path)
    name = hashlib.sha256(b"".join(sorted(ranks, key=ranks.__getitem__))).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast((name, ranks, pattern))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("data"))
    return given.mapInArrow(_coded(sent), "doc_id long, ids binary, decoded binary")


def token_digests(coded: DataFrame) -> DataFrame:
    """Per row of encoded: n_tokens, and digests of the ids and of the decoded bytes."""
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
