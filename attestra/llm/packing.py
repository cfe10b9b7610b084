"""Best-fit packing of tokenised documents by swap-based local search.

Pieces are dealt to groups of bounded size by a hash of their number, so groups are alike whatever the
documents are. In a group, longest pieces go first, each to the fullest bin that holds it. Then
the emptiest bins give away what they hold: a piece, or a pair, moves to another bin or is
exchanged for a shorter piece or pair, whatever raises the sum of squared fills most, until no bin
gets empty any more. Full bins are done. Those that are not full are dealt again, whole, to fewer
groups, and the search goes on from there, as long as it empties bins.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import as_bytes, by_volume, materialize, sliced

#: Tokens of a sequence, and the id that ends a document.
LENGTH, END = 2048, 0
#: Pieces of a group, about.
GROUP_ROWS = 8192
#: Distinct words, and pieces of words, whose ids a task keeps, and bytes of text that it cuts into words at once.
CACHE_WORDS, STRETCH = 1 << 20, 1 << 20
#: Another round is worth it if the last one emptied this share of the bins that it had.
WORTHWHILE = 1 / 1000
BLANK = b" \t\n\r\x0b\x0c"
#: How a tokenizer prepares its text (composed, lower case; contractions, runs of letters, single digits, runs of other signs; bytes as signs), and what that makes of words of printable ASCII and U+00C0 to U+00FF, lower-cased.
PREPARED = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]
COMMON, PIECE = re.compile("[!-~À-ÿ]+"), re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit numbers. Words between ASCII white space are encoded once each, as long as they are kept.

    That gives the ids of the whole text for tokenizers that never join what white space parts; ``apart`` says if this one does. Where the
    tokenizer prepares its text in the one way that is known here (``PREPARED``), words of printable ASCII and of U+00C0 to U+00FF are cut as it
    would cut them, and the pieces given to its model: the ids are the same, without the cost of preparing each word by itself.
    """

    def __init__(self, model: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.kept, self.pieces = Tokenizer.from_str(model), {}, {}
        spec = json.loads(model)
        self.plain = [spec["normalizer"], spec["pre_tokenizer"]] == PREPARED
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        probe = "It's 1 of the\n\n two\ttests , <a> ' ! It's  won 't"
        self.apart = self.ids(probe.encode()) == b"".join(map(self.ids, probe.encode().split()))

    def ids(self, text: bytes) -> bytes:
        return packed_ids(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.words, stretches(text))) if self.apart else self.ids(text)

    def words(self, text: bytes) -> bytes:
        own = text.split()
        try:
            return b"".join(map(self.kept.__getitem__, own))
        except KeyError:
            self.learn(own)
            return b"".join(map(self.kept.__getitem__, own))

    def learn(self, own: list[bytes]) -> None:
        """Words to keep, all of these among them."""
        if len(self.kept) + len(self.pieces) > CACHE_WORDS:
            self.kept.clear()
            self.pieces.clear()
        rest = []
        for raw in set(own):
            if raw not in self.kept:
                word = raw.decode()
                if self.plain and COMMON.fullmatch(word) and not any(s in word for s in self.special):
                    self.kept[raw] = b"".join(map(self.piece, PIECE.findall(word.lower())))
                else:
                    rest.append(raw)
        for raw, found in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            self.kept[raw] = packed_ids(found.ids)

    def piece(self, piece: str) -> bytes:
        if (found := self.pieces.get(piece)) is None:
            signs = piece if piece.isascii() else self.signs.pre_tokenize_str(piece)[0][0]
            found = self.pieces[piece] = packed_ids([t.id for t in self.tokenizer.model.tokenize(signs)])
        return found


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def encoder_of(model: str) -> Encoder:
    """One for each Python worker, which runs task after task."""
    return Encoder(model)


def stretches(text: bytes) -> Iterator[bytes]:
    """The text in parts of about STRETCH bytes, cut at white space."""
    begin = 0
    while len(text) - begin > STRETCH:
        ends = [at for b in BLANK if (at := text.find(b, begin + STRETCH)) >= 0]
        if not ends:
            break
        yield text[begin : (begin := min(ends))]
    yield text[begin:]


def tokenized(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece (from 0), start (ids of the document before it), length, ids (little-endian unsigned 32-bit numbers): documents with the id ``end`` behind each, cut where they are longer than ``length``.

    tokenizer: a file of the tokenizers library. Its text goes to the tasks, so executors need no file.
    """
    model = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())
    last, most = struct.pack("<I", end), 4 * length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model.value)
        for batch in sliced(batches):
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            texts = [t or b"" for t in texts]
            for part in by_volume(texts):
                rows: list[tuple] = []
                for i in part:
                    found = encoder.encode(texts[i]) + last
                    rows += [(ids[i], n, at // 4, len(found[at : at + most]) // 4, found[at : at + most]) for n, at in enumerate(range(0, len(found), most))]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


# one group


def best_fit(sizes: list[int], most: int) -> list[list[int]]:
    """Bins of sizes: the longest first, each to the fullest bin that holds it."""
    rooms: dict[int, list[int]] = defaultdict(list)
    bins: list[list[int]] = []
    open_rooms = 0  # bit r: there are bins with room for r
    for size in sorted(sizes, reverse=True):
        if fitting := open_rooms >> size:
            room = size + (fitting & -fitting).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
            bins[at].append(size)
        else:
            room, at = most, len(bins)
            bins.append([size])
        if left := room - size:
            rooms[left].append(at)
            open_rooms |= 1 << left
    return bins


def offers_of(sizes: list[int]) -> dict[int, tuple[int, ...]]:
    """What a bin can give in exchange, by its sum: nothing, a piece, or two."""
    kinds = Counter(sizes)
    out: dict[int, tuple[int, ...]] = {a + b: (a, b) for a, b in combinations(kinds, 2)}
    out |= {2 * a: (a, a) for a, n in kinds.items() if n > 1}
    return out | {a: (a,) for a in kinds} | {0: ()}


class Receivers:
    """Bins that may take pieces, by their room, and what those of a room can give in exchange."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.count = np.zeros((most, most), np.int32)
        #: By room and number: the least sum from that number on that a bin can give; ``most`` if there is none.
        self.next = np.full((most, most + 1), most, np.int32)
        self.bins: dict[int, dict[int, dict[int, tuple[int, ...]]]] = defaultdict(dict)

    def change(self, at: int, sizes: list[int], by: int) -> None:
        room = self.most - sum(sizes)
        if not 0 < room < self.most:
            return
        offers = offers_of(sizes) if by > 0 else self.bins[room].pop(at)
        if by > 0:
            self.bins[room][at] = offers
        elif not self.bins[room]:
            del self.bins[room]
        counts = self.count[room]
        counts[list(offers)] += by
        there = np.where(counts > 0, np.arange(self.most), self.most)
        self.next[room, :-1] = np.minimum.accumulate(there[::-1])[::-1]

    def best(self, units: np.ndarray, fill: int) -> tuple[int, int, int] | None:
        """(unit, room, what the receiver gives): the exchange that raises the sum of squared fills most, for a bin of that fill; none: nothing does."""
        if not self.bins:
            return None
        rooms = np.array(sorted(self.bins))
        given = self.next[rooms[None, :], np.maximum(units[:, None] - rooms[None, :], 0)].astype(np.int64)
        shift = units[:, None] - given
        gain = np.where(shift > 0, shift * (shift + (self.most - rooms)[None, :] - fill), 0)
        at = int(gain.argmax())
        i, j = divmod(at, len(rooms))
        return (int(units[i]), int(rooms[j]), int(given[i, j])) if gain[i, j] > 0 else None

    def one_of(self, room: int, given: int) -> tuple[int, tuple[int, ...]]:
        return next((at, offers[given]) for at, offers in self.bins[room].items() if given in offers)


def fewest(sizes: list[int], most: int) -> int:
    """No packing has fewer bins: by volume, and by pieces of which no two fit together."""
    return max(-(-sum(sizes) // most), sum(1 for s in sizes if 2 * s > most))


def searched(bins: list[list[int]], most: int) -> list[list[int]]:
    """Local search over the bins that aren't full: sweeps from the emptiest bin on, until one empties no bin. Every step raises the sum of squared fills."""
    full, rest = [b for b in bins if sum(b) == most], [list(b) for b in bins if sum(b) < most]
    least = fewest([s for b in rest for s in b], most)
    while len(rest) > least:
        receivers = Receivers(most)
        for at, sizes in enumerate(rest):
            receivers.change(at, sizes, 1)
        stuck: set[tuple[int, ...]] = set()
        for at in sorted(range(len(rest)), key=lambda i: (sum(rest[i]), i)):
            own = rest[at]
            if sum(own) == most or tuple(own) in stuck:
                continue
            receivers.change(at, own, -1)
            while own:
                offers = offers_of(own)
                singles = np.array(sorted(s for s, x in offers.items() if len(x) == 1))
                pairs = np.array(sorted(s for s, x in offers.items() if len(x) == 2), np.int64)
                step = receivers.best(singles, sum(own)) or (receivers.best(pairs, sum(own)) if len(pairs) else None)
                if not step:
                    break
                unit, room, given = step
                to, back = receivers.one_of(room, given)
                receivers.change(to, rest[to], -1)
                for s in offers[unit]:
                    own.remove(s)
                    rest[to].append(s)
                for s in back:
                    rest[to].remove(s)
                    own.append(s)
                receivers.change(to, rest[to], 1)
                stuck.clear()
            receivers.change(at, own, 1) if own else None
            stuck.add(tuple(own))
        before, rest = len(rest), [b for b in rest if b]
        if len(rest) == before:
            break
    return full + rest


def packed_group(table: pa.Table, most: int) -> pa.Table:
    """pid, length, sequence_id (null: in no bin yet) of a group, as placed: pid, length, sequence_id (its first piece's pid), offset, fill."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("pid", "length", "sequence_id")), strict=True), key=lambda r: r[0])
    bins = best_fit([n for _, n, _ in rows], most)
    if rows[0][2] is not None:
        before: dict[int, list[int]] = defaultdict(list)
        for _, n, s in rows:
            before[s].append(n)
        merit = lambda x: (len(x), -sum(sum(b) ** 2 for b in x))
        bins = min(list(before.values()), bins, key=merit)
    of_size: dict[int, list[int]] = defaultdict(list)
    for pid, n, _ in reversed(rows):
        of_size[n].append(pid)
    out = []
    for sizes in searched(bins, most):
        place, first, fill = 0, None, sum(sizes)
        for n in sizes:
            pid = of_size[n].pop()
            first = pid if first is None else first
            out.append((pid, n, first, place, fill))
            place += n
    return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["pid", "length", "sequence_id", "offset", "fill"])


# all groups


def packed(pieces: DataFrame, most: int = LENGTH) -> DataFrame:
    """pieces: length (1 to most) and any other columns. Adds sequence_id (any numbers) and offset (place in the sequence, gapless from 0)."""
    numbered = materialize(pieces.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    waiting = numbered.where(F.col("length") < most).select("pid", F.col("length").cast("long").alias("length"), F.lit(None).cast("long").alias("sequence_id"))
    done, bins = None, None
    for turn in range(64):
        n = waiting.count()
        if not n:
            break
        groups = -(-n // GROUP_ROWS)
        dealt = waiting.withColumn("part", F.pmod(F.xxhash64(F.coalesce("sequence_id", "pid"), F.lit(turn)), F.lit(groups)))
        placed = materialize(dealt.groupBy("part").applyInArrow(lambda table: packed_group(table, most), "pid long, length long, sequence_id long, offset long, fill long"), "placed")
        left = placed.where(F.col("fill") < most)
        before, bins = bins, left.where(F.col("offset") == 0).count()
        last = groups == 1 or (before is not None and before - bins - placed.where((F.col("fill") == most) & (F.col("offset") == 0)).count() <= before * WORTHWHILE)
        part = placed if last else placed.where(F.col("fill") == most)
        part = part.select("pid", "sequence_id", "offset")
        done = part if done is None else done.unionByName(part)
        if last:
            break
        waiting = left.select("pid", "length", "sequence_id")
    whole = numbered.where(F.col("length") == most).withColumn("sequence_id", F.col("pid")).withColumn("offset", F.lit(0).cast("long"))
    return (whole.unionByName(numbered.join(done, "pid")) if done is not None else whole).drop("pid")


def packed_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, sequence_id, offset.

    A document is its text's ids and the id ``end``; a null or empty text has that one only. Documents of more than
    ``length`` ids are cut into pieces of it, the last may be shorter; no other is cut. Repeated rows are documents of
    their own, null ids stay null. Other columns are not looked at; an empty table gives an empty result.
    """
    return packed(tokenized(docs, tokenizer, length, end), length)


def sequences(pieces: DataFrame) -> DataFrame:
    """pieces: of packed_documents. One row per sequence: sequence_id, ids (all of them, little-endian), parts (doc_id, piece, start, length, offset, in order)."""
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids"))).alias("rows"))
    ids = F.aggregate("rows", F.lit(b"").cast("binary"), lambda a, r: F.concat(a, r["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), F.transform("rows", lambda r: F.struct(r["doc_id"], r["piece"], r["start"], r["length"], r["offset"])).alias("parts"))


def packed_digests(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """As packed_documents, with ids_crc32 (unsigned) in place of ids: these take no part in the shuffles."""
    pieces = tokenized(docs, tokenizer, length, end).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packed(pieces, length).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
