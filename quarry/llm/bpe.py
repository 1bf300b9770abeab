"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Texts are cut into pieces by the tokenizer's pattern, all texts of a batch together (``pieces``). The corpus's most frequent
pieces (counted over all of it; LEXICON of them at most) are encoded once and compiled into a minimal acyclic automaton:
states with equal continuations are one, arcs carry numbers whose sum along a word is the word's number, and that number
finds its ids. The file (a few MB, bounded by LEXICON) is written to the shared checkpoint folder, sent to executors by
Spark and memory-mapped there. The new pieces of a batch walk the automaton together; those that it lacks are merged
exactly, in rank order, all together as well.

A null text is empty: no ids, and the digest of nothing. The added token's text encodes as that token. A very long text is
taken in sections, cut where a blank between two words lets no merge cross. Rows are independent, any other column may be
null, rows may repeat, and an empty table gives an empty result. Texts are never shuffled, only counts of pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, documents, durable, parts
from .pieces import ODD, WIDEST, Pieces, Table

LEXICON = 65_536
#: Distinct pieces that a task keeps at once, and characters of text that it takes at once.
MEMO, AT_ONCE = 200_000, 1 << 19
NONE, NEVER = np.int32(2**31 - 1), np.int64(2**62)
#: A blank between two characters that are no white space: a piece begins there whatever is around.
CUT = re.compile(r"\S (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable Latin-1 stands for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Vocabulary, merges and added tokens of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.first = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.table: list[bytes] = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        pairs = {}
        self.made = np.zeros(len(spec["model"]["merges"]) + 1, np.int32)
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            pairs.setdefault((vocab[a] << 32) | vocab[b], rank)
            self.made[rank] = vocab[a + b]
        # ranks of pairs of ids, by open addressing
        self.log_slots = (4 * len(pairs) + 4).bit_length()
        self.pair, self.pair_rank = np.full(1 << self.log_slots, -1, np.int64), np.full(1 << self.log_slots, NONE)
        keys, ranks = np.array([*pairs.keys()], np.int64), np.array([*pairs.values()], np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            own = slot[left]
            free = self.pair[own] < 0
            self.pair[own[free]], self.pair_rank[own[free]] = keys[left[free]], ranks[left[free]]
            left = left[self.pair[own] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.pair) - 1)
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * ODD) >> np.uint64(64 - self.log_slots)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids, NONE where there is none."""
        key = (a.astype(np.int64) << 32) | b
        slot = self._slot(key)
        there = self.pair[slot]
        out = np.where(there == key, self.pair_rank[slot], NONE)
        left = np.flatnonzero((there != key) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.pair) - 1)
            there = self.pair[slot[left]]
            out[left] = np.where(there == key[left], self.pair_rank[slot[left]], NONE)
            left = left[(there != key[left]) & (there >= 0)]
        return out

    def merge_long(self, word: bytes) -> np.ndarray:
        """Exact merges of one word by a heap of pairs and a linked list."""
        start = self.first[np.frombuffer(word, np.uint8)]
        ids, ranks = start.tolist(), self.rank(start[:-1], start[1:]).tolist()
        after, ahead = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(rank, i, ids[i], ids[i + 1]) for i, rank in enumerate(ranks) if rank != NONE]
        heapq.heapify(heap)
        one = np.zeros((2, 1), np.int32)

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0:
                one[:, 0] = ids[i], ids[j]
                if (rank := int(self.rank(one[0], one[1])[0])) != NONE:
                    heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                ahead[after[j]] = i
            if ahead[i] >= 0:
                offer(ahead[i])
            offer(i)
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact merges of many words of WIDEST bytes or less, given one after the other: ids, and where and how many each word's are.

        In each round, every word makes its leftmost merge of least rank. A place is known by the byte it began with.
        """
        at, count, flat, known = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), [], 0
        words, size = np.arange(len(size)), size.astype(np.int64)
        ids = self.first[data]
        start = np.cumsum(size) - size
        place = np.arange(len(ids)) - np.repeat(start, size)
        key = np.full(len(ids), NEVER)
        last = start + size - 1
        pairs = np.ones(len(ids), bool)
        pairs[last] = False
        pairs = np.flatnonzero(pairs)
        rank = self.rank(ids[pairs], ids[pairs + 1])
        key[pairs] = np.where(rank == NONE, NEVER, rank.astype(np.int64) * WIDEST + place[pairs])
        while len(words):
            best = np.minimum.reduceat(key, start)
            going = best != NEVER
            if not going.all():
                stay, over = np.repeat(going, size), words[~going]
                flat.append(ids[~stay])
                count[over] = size[~going]
                at[over] = known + np.cumsum(size[~going]) - size[~going]
                known += len(flat[-1])
                words, size, best, ids, key, place = words[going], size[going], best[going], ids[stay], key[stay], place[stay]
                if not len(words):
                    break
            here = np.flatnonzero(key == np.repeat(best, size))
            ids[here] = self.made[best // WIDEST]
            stay = np.ones(len(ids), bool)
            stay[here + 1] = False
            ids, key, place, size = ids[stay], key[stay], place[stay], size - 1
            here -= np.arange(len(here))  # each word before has lost one
            start = np.cumsum(size) - size
            ended = here == start + size - 1
            key[here[ended]] = NEVER
            for x in (here[~ended], here[here > start] - 1):
                rank = self.rank(ids[x], ids[x + 1])
                key[x] = np.where(rank == NONE, NEVER, rank.astype(np.int64) * WIDEST + place[x])
        return np.concatenate([np.zeros(0, np.int32), *flat]), at, count


@lru_cache(4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def compile_lexicon(entries: dict[bytes, np.ndarray]) -> bytes:
    """File of the minimal automaton of the words, with the ids of each."""
    words = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settled(node: list) -> int:
        """Number of the state with this ending and these arcs."""
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # nodes of the last word that may still get arcs: final, arcs to settled states, byte that leads to the next
    last = b""
    for w in words:
        shared = 0
        while shared < min(len(w), len(last)) and w[shared] == last[shared]:
            shared += 1
        while len(path) > shared + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settled(node)))
        path += [[False, []] for _ in w[shared:]]
        path[-1][0] = True
        last = w
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], settled(node)))
    start = settled(path[0])

    below = [0] * len(states)  # words from each state on; a state's arcs lead to states settled before it
    keys, to, out = [], [], []
    for s, (final, arcs) in enumerate(states):
        n = int(final)
        for byte, t in arcs:
            keys.append(s * 256 + byte)
            to.append(t)
            out.append(n)
            n += below[t]
        below[s] = n
    # arcs by open addressing
    slots = 1 << (2 * len(keys)).bit_length()
    arcs = np.full((3, slots), -1, "<i4")
    for key, t, n in zip(keys, to, out, strict=True):
        at = slot_of(key, slots)
        while arcs[0, at] >= 0:
            at = (at + 1) & (slots - 1)
        arcs[:, at] = key, t, n
    ends = np.cumsum([0, *(len(entries[w]) for w in words)])
    ids = np.concatenate([np.zeros(0, "<i4"), *(entries[w] for w in words)])
    parts = [np.array([start, len(states), slots, len(words)], "<i8"), arcs, ends.astype("<i4"), np.array([f for f, _ in states], "<i4"), ids.astype("<i4")]
    return b"".join(p.tobytes() for p in parts)


def slot_of(key, slots: int):
    """Where an arc's search begins; for one key or an array of them."""
    return (key * 0x9E3779B1 >> 7) & (slots - 1)


class Lexicon:
    """The mapped file."""

    def __init__(self, data) -> None:
        self.start, n, self.slots, words = np.frombuffer(data, "<i8", 4).tolist()
        at = 32

        def take(count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, "<i4", count, at) if count else np.zeros(0, "<i4")
            at += found.nbytes
            return found

        self.key, self.to, self.out = take(self.slots), take(self.slots), take(self.slots)
        self.ends, self.final = take(words + 1), take(n)
        self.ids = take(int(self.ends[-1]))

    def find(self, pieces: Pieces, which: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 where the lexicon lacks it."""
        found, number = np.full(len(which), -1, np.int64), np.zeros(len(which), np.int64)
        walking, state = np.arange(len(which)), np.full(len(which), self.start, np.int64)
        start, size = pieces.start[which], pieces.size[which]
        for k in range(WIDEST + 1):
            over = size[walking] == k
            if over.any():
                ended = walking[over]
                ended = ended[self.final[state[over]] == 1]
                found[ended] = number[ended]
                walking, state = walking[~over], state[~over]
            if not len(walking):
                break
            key = state * 256 + pieces.data[start[walking] + k]
            at = slot_of(key, self.slots)
            there = self.key[at]
            left = np.flatnonzero((there != key) & (there >= 0))
            while len(left):
                at[left] = (at[left] + 1) & (self.slots - 1)
                there[left] = self.key[at[left]]
                left = left[(there[left] != key[left]) & (there[left] >= 0)]
            hit = there == key
            walking, at = walking[hit], at[hit]
            number[walking] += self.out[at]
            state = self.to[at].astype(np.int64)
        return found


@lru_cache(2)
def mapped(name: str) -> Lexicon:
    with open(SparkFiles.get(name), "rb") as f:
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class Encoder:
    """Encodes texts through a lexicon; the ids of pieces that it has looked up it keeps, MEMO of them at most."""

    def __init__(self, tok: Tokenizer, lexicon: Lexicon) -> None:
        self.tok, self.lexicon = tok, lexicon
        self.forget(MEMO)

    def forget(self, room: int) -> None:
        self.known, self.wide = Table(room), {}  # by number; number of longer pieces
        self.at, self.count = np.zeros(room, np.int64), np.zeros(room, np.int64)
        self.pool, self.used = np.zeros(4 * room, np.int32), 0

    def keep(self, numbers: np.ndarray, ids: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        """Notes that the pieces with these numbers have ``count`` of ``ids``, from ``at`` on."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[numbers], self.count[numbers] = self.used + at, count
        self.used += len(ids)

    def look_up(self, pieces: Pieces, which: np.ndarray, key: np.ndarray) -> None:
        """Adds pieces with different keys to what is known: by the lexicon, or else by merging."""
        numbers, entry = self.known.add(pieces, which, key), self.lexicon.find(pieces, which)
        hit, missed = np.flatnonzero(entry >= 0), np.flatnonzero(entry < 0)
        first, count = self.lexicon.ends[entry[hit]].astype(np.int64), self.lexicon.ends[entry[hit] + 1].astype(np.int64)
        count -= first
        ends = np.cumsum(count)
        ids = self.lexicon.ids[np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
        self.keep(numbers[hit], ids, ends - count, count)
        if len(missed):
            self.keep(numbers[missed], *self.tok.merge(pieces.flat(which[missed]), pieces.size[which[missed]]))

    def numbers(self, pieces: Pieces) -> np.ndarray:
        """The number under which each piece is known; all are, afterwards."""
        out = np.full(len(pieces.size), -2, np.int64)
        which = np.flatnonzero(pieces.size <= WIDEST)
        key = pieces.keys(which)
        for again in (False, True):
            found = self.known.find(pieces, which, key)
            new = np.flatnonzero(found == -1)
            if len(new):
                distinct, first = np.unique(key[new], return_index=True)
                if self.known.n + len(distinct) > self.known.room - len(out) // 8 and not again:
                    self.forget(max(MEMO, 2 * len(out)))
                    continue
                self.look_up(pieces, which[new[first]], distinct)
                found[new] = self.known.find(pieces, which[new], key[new])
            out[which] = found
            break
        for i in np.flatnonzero(out == -2).tolist():  # longer pieces, and any whose key another has
            piece = pieces.bytes_of(i)
            if piece not in self.wide:
                if self.known.n == self.known.room:
                    self.forget(max(MEMO, 4 * len(out)))
                    return self.numbers(pieces)
                ids = self.tok.merge_long(piece)
                self.wide[piece] = self.known.n
                self.keep(np.array([self.known.n]), ids, np.zeros(1, np.int64), np.array([len(ids)]))
                self.known.n += 1
            out[i] = self.wide[piece]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        sections, own = [], []  # own, of each text: an added token's id as an array, or the place of a section
        for text in texts:
            own.append([])
            for k, part in enumerate(self.tok.at_added.split(text) if self.tok.at_added and any(a in text for a in self.tok.added) else [text]):
                if k % 2:
                    own[-1].append(np.array([self.tok.added[part]], np.int32))
                    continue
                while len(part) > 2 * AT_ONCE and (m := CUT.search(part, AT_ONCE)):
                    own[-1].append(len(sections))
                    sections.append(part[: m.start() + 1])
                    part = part[m.start() + 1 :]
                own[-1].append(len(sections))
                sections.append(part)
        ids: list[np.ndarray] = []
        for some in some_at_once(sections):
            pieces = Pieces(some)
            number = self.numbers(pieces)
            count = self.count[number]
            ends = np.cumsum(count)
            flat = self.pool[np.repeat(self.at[number] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
            cuts = np.concatenate([[0], ends])[pieces.first].tolist()
            ids += [flat[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
        parts = [[ids[x] if isinstance(x, int) else x for x in xs] for xs in own]
        return [xs[0] if len(xs) == 1 else np.concatenate(xs) for xs in parts]


def some_at_once(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Texts in lists of about AT_ONCE characters."""
    held, n = [], 0
    for t in texts:
        held.append(t or "")
        n += len(held[-1])
        if n >= AT_ONCE:
            yield held
            held, n = [], 0
    if held:
        yield held


def count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of WIDEST bytes or less, with the times that a task has met each since it last gave out what it had."""
    known, counts = Table(MEMO), np.zeros(MEMO, np.int64)

    def out() -> pa.RecordBatch:
        ends, data = known.all_bytes()
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        words = pa.StringArray.from_buffers(known.n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
        return pa.RecordBatch.from_arrays([words, pa.array(counts[: known.n])], ["word", "n"])

    for batch in parts(batches):
        for texts in some_at_once(batch.column(0).to_pylist()):
            pieces = Pieces(texts)
            which = np.flatnonzero(pieces.size <= WIDEST)
            key = pieces.keys(which)
            number = known.find(pieces, which, key)
            new = np.flatnonzero(number == -1)
            distinct, first = np.unique(key[new], return_index=True)
            if known.n + len(distinct) > known.room:
                yield out()
                new = np.arange(len(which))
                distinct, first = np.unique(key, return_index=True)
                known, counts = Table(max(MEMO, len(distinct))), np.zeros(max(MEMO, len(distinct)), np.int64)
            known.add(pieces, which[new[first]], distinct)
            number[new] = known.find(pieces, which[new], key[new])
            counts[: known.n] += np.bincount(number[number >= 0], minlength=known.n)
    yield out()


def build_lexicon(docs: DataFrame, tokenizer_path: str, size: int = LEXICON) -> str:
    """Compiles the corpus's most frequent pieces and sends the file to the executors; its name there."""
    spark = docs.sparkSession
    counts = docs.select("text").mapInArrow(count_pieces, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = durable(counts.filter("n > 1").withColumn("level", F.floor(F.log2("n") * 16).cast("int")))
    # a level is a narrow range of counts, so that there are about a thousand; the highest are taken whole, and of the first that doesn't fit, a share by hash
    cut, room, share = -1, size, 0.0
    for level, n in sorted(counts.groupBy("level").agg(F.count(F.lit(1))).collect(), reverse=True):
        if n > room:
            cut, share = level, room / n
            break
        room -= n
    by_hash = F.pmod(F.xxhash64("word"), F.lit(2**31)) < int(share * 2**31)
    frequent = [r[0].encode() for r in counts.filter((F.col("level") > cut) | ((F.col("level") == cut) & by_hash)).select("word").limit(size).collect()]  # at most ``size``
    data = compile_lexicon(merged(tokenizer(tokenizer_path), frequent))
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:20]}.bin"
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark), name)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):  # the name tells the content, which another session may have left
        part = path.suffix(f".{uuid.uuid4().hex}")
        stream = fs.create(part, True)
        stream.write(data)
        stream.close()
        if not fs.rename(part, path):
            fs.delete(part, False)
    sc.addFile(fs.makeQualified(path).toString())
    return name


def merged(tok: Tokenizer, words: list[bytes]) -> dict[bytes, np.ndarray]:
    """Ids of words of WIDEST bytes or less."""
    ids, at, count = tok.merge(np.array(bytearray().join(words), np.uint8), np.array([len(w) for w in words], np.int64))
    return {w: ids[a : a + n] for w, a, n in zip(words, at.tolist(), count.tolist(), strict=True)}


def encode(docs: DataFrame, tokenizer_path: str, keep_ids: bool = False, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ``ids`` of every row.

    A carried column that has the name of one of these comes out as ``carried_<name>``.
    """
    name = build_lexicon(docs, tokenizer_path)
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    carried = [f"carried_{c}" if c in made else c for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        coder, table = Encoder(tok, mapped(name)), tok.table
        for batch in parts(batches):
            done = 0
            for texts in some_at_once(batch.column(len(carry)).to_pylist()):
                coded = coder.encode(texts)
                columns = [batch.column(k).slice(done, len(texts)) for k in range(len(carry))]
                columns.append(pa.array([len(x) for x in coded], pa.int64()))
                columns.append(pa.array([hashlib.sha256(x.astype("<i4", copy=False).tobytes()).hexdigest() for x in coded], pa.string()))
                columns.append(pa.array([hashlib.sha256(decode(x.tolist(), table).encode()).hexdigest() for x in coded], pa.string()))
                if keep_ids:
                    columns.append(pa.array(coded, pa.list_(pa.int32())))
                done += len(texts)
                yield pa.RecordBatch.from_arrays(columns, [*carried, *made])

    kinds = ", ".join(f"`{c}` {docs.schema[o].dataType.simpleString()}" for c, o in zip(carried, carry, strict=True))
    schema = f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(*carry, F.col("text").alias("_text")).mapInArrow(run, schema)


def decode(ids: list[int], table: list[bytes]) -> str:
    """Text of ids; bytes that are no UTF-8 become U+FFFD."""
    return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
