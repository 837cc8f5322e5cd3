import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest
from tokenizers import Tokenizer

from lectern.llm import huffman, packing, tokens, vec


@pytest.mark.parametrize("name,keep", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_pieces_encode_as_whole_texts(name, keep):
    r = random.Random(1)
    alphabet = " \n\t  　 '<|>a bE9é.,\x1cı̈"
    xs = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(3000)] + ["a <|endoftext|> b<|endoftext|>", "don't we'LL"]
    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    enc = tokens.PieceEncoder(tokens.tokenizer_path(name), keep, most=500)  # forgets again and again
    for part in (xs[:1000], xs[1000:], xs[:50]):
        ids, at = enc(*vec.text_buffers(pa.array(part)))
        for i, e in enumerate(t.encode_batch(part, add_special_tokens=False)):
            assert ids[at[i] : at[i + 1]].tolist() == e.ids, part[i]


def brute_ids(rows, name, end):
    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    return [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids + [end]) for r in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_huffman_round_trip(docs, rows):
    got = huffman.tokens_round_trip(docs, tokens.tokenizer_path("word_bpe_49k.json"), 1).collect()
    want = brute_ids(rows, "word_bpe_49k.json", 1)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(i), crc(i)) for d, i in want)
    at = 0
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)):
        assert r.start == at
        at += r.n_tokens


def test_huffman_files_ascend(spark, docs, rows, tmp_path, monkeypatch):
    """Files hold ranges of doc_id in order, also where one doc_id, or none, has most rows; ids beyond 17 bits are read back."""
    monkeypatch.setattr(huffman, "FILE_IDS", 3000)
    monkeypatch.setattr(huffman, "BLOCK_IDS", 500)
    hot = spark.createDataFrame([(7, "the same words " * 20)] * 150 + [(None, "no number " * 9)] * 150, "doc_id long, text string")
    huffman.write_tokens(docs.select("doc_id", "text").unionByName(hot), str(tmp_path), tokens.tokenizer_path("word_bpe_49k.json"), 1)
    files = sorted((p.name, pa.parquet.read_table(p)) for p in (tmp_path / "blocks").glob("part-*"))
    seen = [d if d is not None else -1 for _, t in files for x in t.sort_by("block").column("doc_ids").to_pylist() for d in x]
    assert seen == sorted(seen) and sum(t.num_rows > 0 for _, t in files) > 5
    assert max(len(x) for _, t in files for x in t.column("doc_ids").to_pylist()) < 100
    got = huffman.read_tokens(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 300 and len({r.start for r in got}) == len(got)


def test_huffman_empty(no_docs):
    assert huffman.tokens_round_trip(no_docs, tokens.tokenizer_path("word_bpe_49k.json"), 1).count() == 0


@pytest.mark.parametrize("counts,limit", [([5, 1, 1, 0, 9], 20), ([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144], 5), ([0, 4], 20), ([3] * 37, 6)])
def test_code_lengths(counts, limit):
    bits = huffman.code_lengths(np.array(counts), limit)
    used = [b for b, c in zip(bits, counts) if c]
    assert max(used) <= limit and all((b > 0) == (c > 0) for b, c in zip(bits, counts))
    assert sum(2.0**-b for b in used) <= 1
    codes = huffman.canonical(bits)
    words = [format(codes[i], f"0{bits[i]}b") for i in range(len(counts)) if counts[i]]
    assert not any(a != b and b.startswith(a) for a in words for b in words)
    if limit == 20 and len(used) > 1:  # as short as without a limit
        import heapq

        h, total = [c for c in counts if c], 0
        heapq.heapify(h)
        while len(h) > 1:
            s = heapq.heappop(h) + heapq.heappop(h)
            total += s
            heapq.heappush(h, s)
        assert sum(b * c for b, c in zip(bits, counts)) == total


@pytest.mark.parametrize("most", [16, 2048])
def test_packing(docs, rows, most):
    got = packing.pack_documents(docs, tokens.tokenizer_path("byte_bpe_50k.json"), 0, most, with_ids=True).collect()
    want = Counter()
    for d, ids in brute_ids(rows, "byte_bpe_50k.json", 0):
        for p, (s, n) in enumerate(packing.cut(len(ids), most)):
            want[d, p, s, n, crc(ids[s : s + n])] += 1
            assert n == most or p == 0
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 for r in got)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= most
    # as few as best fit over the single pieces
    rooms = []
    for n in sorted((r.length for r in got), reverse=True):
        fit = min((x for x in rooms if x >= n), default=None)
        if fit is None:
            rooms.append(most - n)
        else:
            rooms.remove(fit)
            rooms.append(fit - n)
    assert len(filled) == len(rooms)


def test_packing_empty(no_docs):
    assert packing.pack_documents(no_docs, tokens.tokenizer_path("byte_bpe_50k.json")).count() == 0
