"""Links between the tokens of two tokenizers that cover the same bytes, and how often each pair of ids is linked."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import own_columns, small_batches, written
from .tokens import PieceEncoder, pieces
from .vec import BYTE_VALUES, U64, pack_ints, pack_sorted, prefix, spans, take_ranges, text_buffers, unpack_ints, unpack_sorted

#: Bytes of text of a block, and of a part of one text that is encoded at a time.
BLOCK_BYTES, PART_BYTES = 16 << 20, 1 << 20
#: Ids of the second tokenizer that a dense block has rows for at most, and blocks (or partial sums) that one task adds up.
STRIPE, FAN = 64, 64
#: Pieces of text that a worker keeps the ids of.
MOST_PIECES = 700_000


def byte_level() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Ids and links of pieces of text (white space and what follows it), each piece being encoded once.

    A piece begins at a run of spaces, where neither tokenizer joins the two sides, so what holds for a text is what holds for
    its pieces one after another.  `na`, `nb`, `groups`, `links`: counts of a piece; `valid`: both sides' tokens spell it.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.space = self.b.encode("a ")[len(self.b.encode("a")) :]
        place = byte_level()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.n_a, self.n_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        self.a_bytes = [b""] * self.n_a
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(place[c] for c in token) if all(c in place for c in token) else token.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.n_b)))]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        n = max(self.n_a, self.n_b)
        digits = [str(i).encode() for i in range(n)]
        self.digits_len = np.array([len(d) for d in digits], np.int64)
        self.digits = np.frombuffer(b"".join(d.ljust(int(self.digits_len[-1]), b"\0") for d in digits), np.uint8).reshape(n, -1)
        self.reset()

    def reset(self) -> None:
        self.size, self.known = 1 << 16, 0
        self.keys, self.slot = np.zeros(self.size, U64), np.zeros(self.size, np.int32)
        z = lambda kind: np.zeros(0, kind)
        self.na, self.nb, self.groups, self.links, self.valid = z(np.int32), z(np.int32), z(np.int32), z(np.int32), z(bool)
        self.link_at, self.link, self.name_at, self.name_len, self.name = z(np.int64), z(np.int64), z(np.int64), z(np.int32), z(np.uint8)

    find, put = PieceEncoder.find, PieceEncoder.put

    def _ids(self, raw: list[bytes], texts: list[str]) -> list[tuple[list[int], list[int]]] | None:
        """Ids of all texts together as both tokenizers have them, or nothing where either one doesn't spell them."""
        whole, spelt = "".join(texts), b"".join(raw)
        a = self.a.encode(whole, add_special_tokens=False).ids
        b = self.b.encode(whole[1:], num_threads=1) if len(whole) > 1 else self.space  # nothing is put before an empty text
        if b"".join(map(self.a_bytes.__getitem__, a)) != spelt or b"".join(map(self.b_bytes.__getitem__, b)) != spelt:
            return None
        return a, b

    def learn(self, h: np.ndarray, raw: list[bytes]) -> None:
        texts = [r.decode("utf-8", "replace") for r in raw]
        # a piece that ends in white space, or that the second tokenizer can't spell, is encoded by itself
        alone = np.array([t[-1].isspace() or t[-1] < "!" or "▁" in t for t in texts], bool)
        ids_a, ids_b, order, bad = [], [], [], []

        def take(part: list[int]) -> None:
            got = self._ids([raw[i] for i in part], [texts[i] for i in part])
            if got is None and len(part) > 1:
                for i in part:
                    take([i])
            elif got is None:
                bad.extend(part)
            else:
                ids_a.extend(got[0])
                ids_b.extend(got[1])
                order.extend(part)

        together = np.flatnonzero(~alone).tolist()
        for k in range(0, len(together), 2000):
            take(together[k : k + 2000])
        for i in np.flatnonzero(alone).tolist():
            take([i])
        sequence = np.array(order + bad, np.int64)
        size = np.array([len(raw[i]) for i in order], np.int64)
        a, b, ends = np.array(ids_a, np.int64), np.array(ids_b, np.int64), np.cumsum(size)
        self._keep(h[sequence], len(order), a, b, np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b]), ends)

    def _keep(self, h: np.ndarray, good: int, a: np.ndarray, b: np.ndarray, ea: np.ndarray, eb: np.ndarray, ends: np.ndarray) -> None:
        """Keeps new pieces, the first `good` of which have tokens that end at ea and eb; the pieces end at `ends`."""
        n = len(h)
        count = lambda at: np.bincount(np.searchsorted(ends, at), minlength=n).astype(np.int32)
        both, common = np.union1d(ea, eb), np.intersect1d(ea, eb)
        links = b[np.searchsorted(eb, both)] * self.n_a + a[np.searchsorted(ea, both)]
        # the groups' text: each token's id and what follows it
        ga, gb = np.searchsorted(common, ea), np.searchsorted(common, eb)
        sa, sb = np.full(len(a), ord(","), np.uint8), np.full(len(b), ord(","), np.uint8)
        sa[np.searchsorted(ea, common)], sb[np.searchsorted(eb, common)] = ord("|"), ord(";")
        o = np.argsort(np.concatenate([2 * ga, 2 * gb + 1]), kind="stable")
        ids, follows, at = np.concatenate([a, b])[o], np.concatenate([sa, sb])[o], np.concatenate([ea, eb])[o]
        size = self.digits_len[ids] + 1
        start = np.cumsum(size) - size
        text = np.empty(int(size.sum()), np.uint8)
        for k in range(self.digits.shape[1]):
            some = np.flatnonzero(size - 1 > k)
            text[start[some] + k] = self.digits[ids[some], k]
        text[start + size - 1] = follows
        name_len = np.bincount(np.searchsorted(ends, at), weights=size, minlength=n).astype(np.int32)
        n_links = count(both)
        valid = np.arange(n) < good
        for name, new in (("na", count(ea)), ("nb", count(eb)), ("groups", count(common)), ("links", n_links), ("valid", valid), ("name_len", name_len)):
            setattr(self, name, np.append(getattr(self, name), new))
        self.link_at = np.append(self.link_at, len(self.link) + np.cumsum(n_links) - n_links)
        self.name_at = np.append(self.name_at, len(self.name) + np.cumsum(name_len) - name_len)
        self.link, self.name = np.append(self.link, links), np.append(self.name, text)
        if 2 * (self.known + n) > self.size:
            keys, slots = self.keys[self.keys != 0], self.slot[self.keys != 0]
            while 2 * (self.known + n) > self.size:
                self.size *= 2
            self.keys, self.slot = np.zeros(self.size, U64), np.zeros(self.size, np.int32)
            self.put(keys, slots)
        self.put(h, np.arange(self.known, self.known + n, dtype=np.int32))
        self.known += n

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces, and where each document's begin; each document has to begin with a space."""
        starts, first = cuts(data, off)
        if len(starts) == 0:
            return np.zeros(0, np.int32), first
        ends = np.append(starts[1:], len(data))
        h = np.maximum(spans(prefix(BYTE_VALUES[data], "byte"), starts, ends, "byte"), U64(1))
        number = self.find(h)
        if len(miss := np.flatnonzero(number < 0)):
            new, where = np.unique(h[miss], return_index=True)
            raw = data.tobytes()
            self.learn(new, [raw[p:q] for p, q in zip(starts[miss[where]].tolist(), ends[miss[where]].tolist())])
            number[miss] = self.find(h[miss])
        return number, first


def cuts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin: at a run of white space that begins with a space, where `pieces` cuts; each document's first one."""
    starts = pieces(data, off)[0]
    starts = starts[data[starts] == 32]
    return starts, np.searchsorted(starts, off)


def spaced(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each; empty ones stay empty."""
    size = np.diff(off)
    full = size > 0
    out_off = np.concatenate([[0], np.cumsum(size + full)])
    out = np.full(out_off[-1], 32, np.uint8)
    out[take_ranges(out_off[:-1] + full, size)] = data
    return out, out_off


def parts(data: np.ndarray, off: np.ndarray, limit: int = PART_BYTES):
    """(first document, data, offsets, whether a document ends here): documents of `limit` bytes together, or a longer one's parts, cut between pieces."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        if j > i:
            yield i, *spaced(data[off[i] : off[j]], off[i : j + 1] - off[i]), True
            i = j
            continue
        text, at, want = np.concatenate([np.array([32], np.uint8), data[off[i] : off[i + 1]]]), 0, limit
        while at < len(text):
            end = min(len(text), at + want)
            if end < len(text):
                starts = cuts(text[at : end + 1], np.array([0, end + 1 - at]))[0]
                if len(starts) < 2:
                    want *= 2
                    continue
                end = at + int(starts[-1])
            yield i, text[at:end], np.array([0, end - at]), end == len(text)
            at, want = end, limit
        i += 1


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner of two tokenizer files."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


BLOCKS = "block long, stripe int, pairs binary, links binary, doc_ids array<long>, shas array<string>"
_BLOCKS = pa.schema([("block", pa.int64()), ("stripe", pa.int32()), ("pairs", pa.binary()), ("links", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("shas", pa.list_(pa.string()))])


class _Block:
    """Documents of a task one after another, until they are written as one block."""

    def __init__(self):
        self.ids, self.shas, self.counts, self.numbers, self.bytes = [], [], [], [], 0

    def rows(self, al: Aligner, block: int):
        """A row with the documents' pieces, and one for each stripe of second ids with the block's distinct pairs and their counts."""
        numbers = np.concatenate([np.zeros(0, np.int32), *self.numbers])
        own, local, times = np.unique(numbers, return_inverse=True, return_counts=True)
        n = al.links[own].astype(np.int64)
        code, pair = np.unique(al.link[take_ranges(al.link_at[own], n)], return_inverse=True)
        count = np.bincount(pair, weights=np.repeat(times, n), minlength=len(code)).astype(np.int64)
        counts = np.array(self.counts, np.int64).reshape(-1, 5)
        blob = b"".join(pack_ints(x) for x in (*counts.T, local, n, pair))
        yield pa.RecordBatch.from_pydict({"block": [block], "stripe": [-1], "pairs": [None], "links": [blob], "doc_ids": [self.ids], "shas": [self.shas]}, schema=_BLOCKS)
        stripe = code // (al.n_a * STRIPE)
        edge = np.flatnonzero(np.diff(stripe, prepend=-1)).tolist() + [len(code)]
        blobs = [pack_sorted(code[p:q]) + pack_ints(count[p:q]) for p, q in zip(edge, edge[1:])]
        none, k = [None] * len(blobs), len(blobs)
        yield pa.RecordBatch.from_pydict({"block": [block] * k, "stripe": stripe[edge[:-1]].tolist(), "pairs": blobs, "links": none, "doc_ids": none, "shas": none}, schema=_BLOCKS)


def _blocks(a_path: str, b_path: str):
    def run(batches):
        from pyspark import TaskContext

        al = aligner(a_path, b_path)
        part, made, block = TaskContext.get().partitionId(), 0, _Block()
        for b in batches:
            data, off = text_buffers(b.column("text"))
            ids = b.column("doc_id").to_pylist()
            own: list = []  # pieces of a document so far
            sha, valid = hashlib.sha256(), True
            for i, text, at, ended in parts(data, off):
                if not own and (block.bytes >= BLOCK_BYTES or al.known > MOST_PIECES):
                    yield from block.rows(al, part << 32 | made)
                    made, block = made + 1, _Block()
                    if al.known > MOST_PIECES:
                        al.reset()
                number, first = al(text, at)
                size = al.name_len[number].astype(np.int64)
                names, edge = al.name[take_ranges(al.name_at[number], size)].tobytes(), np.concatenate([[0], np.cumsum(size)])[first]
                bad = np.concatenate([[0], np.cumsum(~al.valid[number])])[first]
                block.bytes += len(text)
                for d in range(len(at) - 1):
                    p, q = first[d], first[d + 1]
                    valid &= bad[d + 1] == bad[d]
                    sha.update((b";" if own else b"") + names[edge[d] : edge[d + 1]][:-1])
                    own.append(number[p:q])
                    if ended:
                        mine = np.concatenate(own) if valid else np.zeros(0, np.int32)
                        block.numbers.append(mine)
                        block.counts.append((len(mine), *(int(x[mine].sum()) for x in (al.na, al.nb, al.groups, al.links))))
                        block.ids.append(ids[i + d])
                        block.shas.append(sha.hexdigest() if len(mine) else "")
                        own, sha, valid = [], hashlib.sha256(), True
        if block.ids:
            yield from block.rows(al, part << 32 | made)

    return run


def _dense(t, n_a: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts of a stripe's pairs as a dense block: a column for each first id, and a row for each second id (the other result) that has pairs."""
    blobs = [(code.astype(np.int64), unpack_ints(blob, at)[0].astype(np.int64)) for blob in t.column("pairs").to_pylist() for code, at in [unpack_sorted(blob)]]
    ids = np.unique(np.concatenate([np.zeros(0, np.int64), *(code // n_a for code, _ in blobs)]))
    m = np.zeros((len(ids), n_a), np.int64)
    for code, n in blobs:
        np.add.at(m.reshape(-1), _cells(code, ids, n_a), n)
    return m, ids


def _cells(code: np.ndarray, ids: np.ndarray, n_a: int) -> np.ndarray:
    return np.searchsorted(ids, code // n_a) * n_a + code % n_a


def _summed(n_a: int):
    def run(key, t):
        m, ids = _dense(t, n_a)
        row, column = np.nonzero(m)
        packed = pack_sorted(ids[row] * n_a + column) + pack_ints(m[row, column])
        return pa.table({"stripe": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "pairs": pa.array([packed], pa.binary())})

    return run


def _scored(n_a: int):
    def run(key, asked, known):
        """For each block's pairs of a stripe, in their order: the corpus-wide count, and whether it is the second id's highest."""
        m, ids = _dense(known, n_a)
        best, out = m.max(axis=1), []
        for blob in asked.column("pairs").to_pylist():
            at = _cells(unpack_sorted(blob)[0].astype(np.int64), ids, n_a)
            count = m.reshape(-1)[at]
            out.append(pack_ints(count) + np.packbits(count == best[at // n_a]).tobytes())
        return pa.table({"block": asked.column("block"), "stripe": asked.column("stripe"), "answer": pa.array(out, pa.binary())})

    return run


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _documents(block, answers):
    """The documents of a block, by the answers for its pairs."""
    counts, best = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for blob in answers.sort_by("stripe").column("answer").to_pylist():
        count, at = unpack_ints(blob)
        counts.append(count.astype(np.int64))
        best.append(np.unpackbits(np.frombuffer(blob, np.uint8, offset=at))[: len(count)].astype(np.int64))
    out, at = [], 0
    for _ in range(8):
        x, at = unpack_ints(block.column("links")[0].as_py(), at)
        out.append(x.astype(np.int64))
    n_pieces, na, nb, groups, links, local, n, pair = out
    piece, doc = (np.concatenate([[0], np.cumsum(x)]) for x in (n, n_pieces))

    def total(x: np.ndarray) -> np.ndarray:
        of_piece = np.diff(np.concatenate([[0], np.cumsum(x[pair])])[piece])
        return np.diff(np.concatenate([[0], np.cumsum(of_piece[local])])[doc])

    ids, shas = (block.column(c).chunk(0).flatten() for c in ("doc_ids", "shas"))
    return pa.table([ids, pa.array(na), pa.array(nb), pa.array(groups), pa.array(links), pa.array(total(np.concatenate(best))), pa.array(total(np.concatenate(counts))), shas], names=[x.split()[0] for x in ALIGNED.split(", ")])


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Both tokenizers' tokens of each text, linked where their bytes overlap: a row for each document.

    a_path: a byte-level BPE of the tokenizers library, which encodes a space and the text; b_path: a sentencepiece model,
    which adds that space itself.  n_a, n_b: tokens; n_groups: byte places where tokens of both end; n_links: overlapping
    pairs; n_best: links whose pair of ids is linked as often in all documents as any pair of that second id; count_sum:
    all links' counts; groups_sha256: of the ids group by group, as `a1,a2|b1;a3|b2`.  Null and empty texts, and those that
    either side doesn't spell byte by byte, have zeros and ''.  Repeated rows count each for itself; a null doc_id stays
    null; very long texts go in parts, but a stretch without a space is one piece; other columns are left out; an empty
    table has no rows.

    Each task keeps its documents in blocks and sends each block's distinct pairs to their stripe of second ids, where
    they are added into dense blocks (in levels of FAN blocks, so no task adds more).  The stripes' row maxima are the
    best counts; blocks' pairs are scored where their stripe is, and the answers go back to the blocks.
    """
    n_a = Aligner(a_path, b_path).n_a
    made = written(small_batches(own_columns(docs, "doc_id", "text")).mapInArrow(_blocks(a_path, b_path), BLOCKS), "blocks")
    asked = made.where("stripe >= 0").select("block", "stripe", "pairs")
    blocks = made.where("stripe < 0").select("block", "links", "doc_ids", "shas")

    def dealt(on: str, width: int):
        return F.pmod(F.xxhash64(on), F.lit(width)).alias("part")

    width = first = max(1, -(-blocks.count() // FAN))
    sums = asked.select("stripe", dealt("block", width), "pairs")
    while True:
        sums = sums.groupBy("stripe", "part").applyInArrow(_summed(n_a), "stripe int, part long, pairs binary")
        if width == 1:
            break
        width = -(-width // FAN)
        sums = sums.select("stripe", dealt("part", width), "pairs")
    known = written(sums.select("stripe", "pairs"), "counts").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(first - 1).cast("long"))))
    mine = asked.withColumn("part", dealt("block", first))
    answers = mine.groupBy("stripe", "part").cogroup(known.groupBy("stripe", "part")).applyInArrow(_scored(n_a), "block long, stripe int, answer binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_documents, ALIGNED)
