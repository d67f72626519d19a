"""Order-preserving packing by dynamic programming.

The documents of one input partition, in their stored order, form a stream of
tokens.  Windows of at most 2048 tokens are cut at document ends, at sentence
ends, or (only inside sentences longer than 512 tokens) at fixed steps.  With
f the least cost of cutting up to a candidate,

    f[i] = cut[i] + open + min over j of f[j] + padding(pos[i] - pos[j])

where padding is 2048 - length, and nothing at a power of two.  The first form
is linear in pos, so the minimum over the last 2048 tokens is the head of a
monotone queue; the exempt lengths 256, 512 and 1024 are direct transitions.
What is left at a partition's end is cut at powers of two, without padding.

No row is shuffled: a partition packs its own documents, and its number makes the
sequence ids distinct.  About every million tokens the windows are given out up to
the last cut on which the best ways to all open candidates agree, so whatever
follows, the cuts are those of the whole stream.  Of ways of equal cost the one with
the shortest last window counts, so that ways meet; where they still stay apart for
half a million tokens, as periodic documents can make them, the best way so far is
taken.  So a task holds at most some million and a half tokens beside the text it
reads, and its time grows with its tokens.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections import defaultdict, deque
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from hearthbook.llm import _text

WINDOW, OPEN_COST, SENTENCE_COST, INSIDE_COST, INSIDE_STEP = 2048, 24, 16, 64, 512
EXEMPT = (256, 512, 1024)
SEGMENT_TOKENS = 1 << 20
#: Tokens solved at once, and those after which ways that stay apart are decided.
MOST_TOKENS, APART_TOKENS = 1 << 20, 1 << 19
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_workers: dict[int, ChunkTokenizer] = {}


class ChunkTokenizer:
    """Ids of whole texts, encoding each distinct space-led chunk once.

    The byte-level pre-tokeniser always ends a token before a space that follows
    visible ASCII or is followed by it, so a text's ids are its chunks' ids in turn.
    Texts that hold an added token's content are encoded whole by the tokenizer.
    Chunks are known by a 64-bit hash; a second one, of another base, tells chunks
    apart that share it, and texts with such a chunk are encoded whole too.
    """

    MOST = 1_000_000
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # of byte-level BPE
    PROBE = "It's  a probe:\n\n naïve 12345 — 日本語\t<|end of text|> they'll "

    def __init__(self, vocabulary: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in added if t.content]
        self.all_whole = self.tokenizer.normalizer is not None and any(t.normalized for t in added)  # their contents may stand in texts in another form
        self.fast = self._fast(json.loads(vocabulary))
        ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        for token, k in self.tokenizer.get_vocab().items():
            ends[k] = token[-1] in ".!?。Ċ"  # the last stands for a line feed
        self.ends = ends
        self._clear()

    def _fast(self, described: dict):
        """A merging loop for single chunks over the same vocabulary, four times as fast; None unless ids follow the merges' order."""
        import tiktoken

        model, vocab = described["model"], described["model"].get("vocab", {})
        merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model.get("merges", [])]
        if (described.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or not merged or merged != list(range(merged[0], merged[0] + len(merged))):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE writes as themselves; the others follow from 256
        letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(letter[c] for c in token): k for token, k in vocab.items() if k < merged[0] + len(merged)}
        encode = tiktoken.Encoding("chunks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return encode if encode(self.PROBE) == self.tokenizer.encode(self.PROBE, add_special_tokens=False).ids else None

    def _ids(self, chunks: list[str]) -> list[list[int]]:
        if self.fast:
            return [self.fast(c) for c in chunks]
        return [e.ids for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False)]

    def _clear(self):
        self.known: dict[int, int] = {}
        self.pool, self.held = np.zeros(1 << 16, np.uint32), 0
        self.sizes, self.begins, self.checks = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def _cuts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        visible = (data > 0x20) & (data < 0x7F)
        cut = data == 0x20
        near = np.zeros(len(data), dtype=bool)
        near[1:] |= visible[:-1]
        last = np.zeros(len(data), dtype=bool)
        last[at[1:][at[1:] > at[:-1]] - 1] = True
        near[:-1] |= visible[1:] & ~last[:-1]
        cut &= near
        cut[at[:-1][at[1:] > at[:-1]]] = True
        return np.flatnonzero(cut)

    def _whole(self, data: np.ndarray, at: np.ndarray) -> list[int]:
        """Indices of the texts that hold an added token's content."""
        if self.all_whole:
            return list(range(len(at) - 1))
        held, found = data.tobytes(), set()
        for content in self.added:
            place = held.find(content)
            while place >= 0:
                k = int(np.searchsorted(at, place, "right")) - 1
                inside = place + len(content) <= at[k + 1]
                found |= {k} if inside else set()
                place = held.find(content, int(at[k + 1]) if inside else place + 1)
        return sorted(found)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts in a byte buffer."""
        whole = self._whole(data, at)
        if not whole:
            ids, bounds, doubted = self._chunked(data, at)
            if not doubted:
                return ids, bounds
            whole = doubted
        return self._mixed(data, at, whole)

    def _mixed(self, data: np.ndarray, at: np.ndarray, whole: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The same with some texts encoded whole."""
        ids = self.tokenizer.encode_batch([data[at[k] : at[k + 1]].tobytes().decode() for k in whole], add_special_tokens=False)
        parts, sizes, after = [], [], 0
        for k, encoded in zip([*whole, len(at) - 1], [*ids, None], strict=True):
            some, bounds, doubted = self._chunked(data[at[after] : at[k]], at[after : k + 1] - at[after])
            if doubted:
                return self._mixed(data, at, sorted({*whole, *(after + d for d in doubted)}))
            parts.append(some)
            sizes.append(np.diff(bounds))
            if encoded is not None:
                parts.append(np.array(encoded.ids, np.uint32))
                sizes.append(np.array([len(encoded.ids)], np.int64))
            after = k + 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)

    def _chunked(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(ids, offsets) for texts without added tokens, and the texts whose ids may be another chunk's."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64), []
        starts = self._cuts(data, at)
        stops = np.append(starts[1:], len(data))
        hashes, checks = _text.span_hashes(data, starts, stops), _text.span_hashes(data, starts, stops, "2")
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.MOST:
            self._clear()
        known = self.known
        slots = [known.get(h, -1) for h in distinct.tolist()]
        new = [k for k, s in enumerate(slots) if s < 0]
        if new:
            held = data.tobytes()
            encoded = self._ids([held[starts[first[k]] : stops[first[k]]].decode() for k in new])
            for k in new:
                slots[k] = known[int(distinct[k])] = len(known)
            lengths = np.array([len(e) for e in encoded], np.int64)
            flat = np.fromiter(itertools.chain.from_iterable(encoded), dtype=np.uint32, count=int(lengths.sum()))
            if self.held + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(flat), len(self.pool)), np.uint32)])
            self.pool[self.held : self.held + len(flat)] = flat
            self.begins = np.concatenate([self.begins, self.held + np.cumsum(lengths) - lengths])
            self.sizes = np.concatenate([self.sizes, lengths])
            self.checks = np.concatenate([self.checks, checks[first[new]]])
            self.held += len(flat)
        slot = np.array(slots, dtype=np.int64)[which]
        other = np.flatnonzero(self.checks[slot] != checks)
        doubted = np.unique(np.searchsorted(at, starts[other], "right") - 1).tolist()
        lengths = self.sizes[slot]
        ends = np.cumsum(lengths)
        ids = self.pool[np.repeat(self.begins[slot] - (ends - lengths), lengths) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[np.searchsorted(starts, at)], doubted


def cut_windows(pos: np.ndarray, cost: np.ndarray, last: bool = True) -> np.ndarray:
    """Indices of the chosen cuts; pos ascends from 0 by steps of at most 2048, cost is each cut's penalty.

    Unless last, only those that stay chosen whatever candidates follow, or, where more
    than APART_TOKENS would wait for that, those of the best way to the last candidate.
    """
    exempt: dict[int, list[int]] = defaultdict(list)
    for length in EXEMPT:
        j = np.searchsorted(pos, pos - length)
        for i in np.flatnonzero((pos >= length) & (pos[j] == pos - length)).tolist():
            exempt[i].append(int(j[i]))
    p, extra = pos.tolist(), cost.tolist()
    value, back = [0] * len(p), [0] * len(p)  # value[j] = f[j] + pos[j]
    queue, head = [0], 0
    for i in range(1, len(p)):
        at = p[i]
        while p[queue[head]] < at - WINDOW:
            head += 1
        j = queue[head]
        best = value[j] + WINDOW - at
        if i in exempt:
            for k in exempt[i]:
                if (value[k] - p[k], -k) < (best, -j):
                    best, j = value[k] - p[k], k
        back[i] = j
        now = value[i] = best + OPEN_COST + extra[i] + at
        while len(queue) > head and value[queue[-1]] >= now:
            queue.pop()
        queue.append(i)
    end = len(p) - 1
    if not last:
        # what follows starts from a candidate of the last 2048 positions; the ways to all of them meet at the end's root
        open_ = set(range(int(np.searchsorted(pos, p[-1] - WINDOW + 1)), len(p)))
        latest = [-k for k in open_]
        heapify(latest)
        while len(open_) > 1:
            k = -heappop(latest)
            open_.discard(k)
            if back[k] not in open_:
                open_.add(back[k])
                heappush(latest, -back[k])
        end = open_.pop()
        if p[-1] - p[end] > APART_TOKENS:
            end = back[-1]
    out = [end]
    while out[-1]:
        out.append(back[out[-1]])
    return np.array(out[::-1])


def _candidates(ids: np.ndarray, ends: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, costs) of the cuts that the stream allows, 0 included; its end only where it is one of theirs."""
    sentence = np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1
    known = np.union1d(np.concatenate([[0], sentence]), doc_ends)
    stops = np.append(known[1:], len(ids))
    wide = np.flatnonzero(stops - known > INSIDE_STEP)
    inside = [np.arange(known[k] + INSIDE_STEP, stops[k], INSIDE_STEP) for k in wide]
    pos = np.union1d(known, np.concatenate(inside)) if inside else known
    cost = np.full(len(pos), INSIDE_COST, dtype=np.int64)
    cost[np.searchsorted(pos, known)] = SENTENCE_COST
    cost[np.searchsorted(pos, doc_ends)] = 0
    cost[0] = 0
    return pos, cost


class _Stream:
    """Documents waiting for their windows; emits pieces in order."""

    def __init__(self, shard: int, tokenizer: ChunkTokenizer):
        self.next, self.tokenizer = shard << 33, tokenizer
        self.docs: deque[list] = deque()  # key, ids still to place, ids already placed, all ids
        self.tokens = 0
        self.open = 0  # of those, solved before without a sure window

    def add(self, key, ids: np.ndarray) -> None:
        self.docs.append([key, ids, 0, len(ids)])
        self.tokens += len(ids)

    def ready(self, segment: int, last: bool = False):
        """Solves while so many new tokens wait, or, if last, all; yields (keys, rows of the PIECES)."""
        while self.tokens - self.open > (MOST_TOKENS if last else segment):
            yield self.solve(False)
        if last and self.docs:
            yield self.solve(True)

    def solve(self, last: bool):
        """(keys, rows of the PIECES) of the first tokens that wait; the tokens after the last sure window stay unless last."""
        taken, size = [], 0
        for doc in self.docs:
            taken.append(doc)
            size += len(doc[1])
            if size >= MOST_TOKENS and not last:
                break
        doc_ends = np.cumsum([len(d[1]) for d in taken])
        size = size if last else min(size, MOST_TOKENS)  # of a long document only its beginning
        begin = np.concatenate([[0], doc_ends[:-1]])
        ids = np.concatenate([d[1][: size - b] for d, b in zip(taken, begin.tolist(), strict=True)])
        pos, cost = _candidates(ids, self.tokenizer.ends, doc_ends[doc_ends <= size])
        chosen = pos[cut_windows(pos, cost, last)]
        if last:  # the rest at powers of two
            rest, at = int(chosen[-1] - chosen[-2]), int(chosen[-2])
            tail = []
            while rest:
                power = 1 << (rest.bit_length() - 1)
                at, rest = at + power, rest - power
                tail.append(at)
            chosen = np.concatenate([chosen[:-1], tail]) if chosen[-1] - chosen[-2] < WINDOW else chosen
        stop = int(chosen[-1])
        starts = np.union1d(begin, chosen[:-1])
        starts = starts[starts < stop]
        lengths = np.diff(np.append(starts, stop))
        doc = np.searchsorted(doc_ends, starts, "right")
        window = np.searchsorted(chosen, starts, "right") - 1
        placed, total = np.array([d[2] for d in taken]), np.array([d[3] for d in taken])
        raw = ids.astype("<u4", copy=False)
        crc = np.array([zlib.crc32(raw[a : a + n]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)], dtype=np.int64)
        rows = np.stack([starts - begin[doc] + placed[doc], lengths, crc, total[doc], self.next + window, starts - chosen[window]]) if len(starts) else np.zeros((6, 0), np.int64)
        keys = [taken[k][0] for k in doc.tolist()]
        self.next += len(chosen) - 1
        for d, b, e in zip(taken, begin.tolist(), doc_ends.tolist(), strict=True):
            if e <= stop:
                self.docs.popleft()
            elif b < stop:
                d[1], d[2] = d[1][stop - b :], d[2] + stop - b
        self.tokens -= stop
        self.open = size - stop
        return keys, rows


def pack(docs: DataFrame, vocabulary: bytes, end_id: int = 1, segment: int = SEGMENT_TOKENS) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    vocabulary is a tokenizer file's content; every text's ids are followed by
    end_id.  Null and empty texts are the one id end_id.  Repeated rows and
    doc_ids are packed as often as they occur, in their stored order; a text of
    any length is cut into several windows.  Other columns are ignored.  segment is
    about how many tokens a task gathers before it gives windows out; results do not
    depend on it, save where equal documents keep ways apart (see above).
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key = hash(shared.value)
        if key not in _workers:
            _workers.clear()
            _workers[key] = ChunkTokenizer(shared.value)
        stream = _Stream(TaskContext.get().partitionId(), _workers[key])
        doc_kind = None
        end = np.array([end_id], dtype=np.uint32)

        def out(pieces) -> pa.RecordBatch:
            keys, rows = pieces
            return pa.RecordBatch.from_arrays([pa.array(keys, doc_kind), *map(pa.array, rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for whole in batches:
            doc_kind = whole.schema.field("doc_id").type
            for batch in _text.passes(whole, "text"):
                ids, at = stream.tokenizer.encode(*_text.utf8(batch.column("text")))
                for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    stream.add(doc_id, np.concatenate([ids[a:b], end]))
                yield from map(out, stream.ready(segment))
        if doc_kind is not None:
            yield from map(out, stream.ready(segment, last=True))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {PIECES}")
