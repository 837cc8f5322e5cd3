import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lectern.llm import alignment, vec
from lectern.llm.tokens import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B), alignment.byte_level(), {i: t for t, i in a.get_vocab().items()}


def sides(text, tokenizers):
    """(id, start, end) of both sides' tokens; nothing where a side doesn't spell the text."""
    a, b, place, token = tokenizers
    if not text:
        return [], []
    out = []
    for pairs in (
        [(i, bytes(place[c] for c in token[i])) for i in a.encode(" " + text, add_special_tokens=False).ids],
        [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)],
    ):
        if b"".join(x for _, x in pairs) != (" " + text).encode():
            return [], []
        ends = np.cumsum([len(x) for _, x in pairs]).tolist()
        out.append([(i, e - len(x), e) for (i, x), e in zip(pairs, ends)])
    return out


def brute(rows, tokenizers):
    both = [sides(t, tokenizers) for _, t in rows]
    def overlaps(a, b):
        ends, starts = [y[2] for y in b], [y[1] for y in b]
        return [(x[0], y[0]) for x in a for y in b[bisect.bisect_right(ends, x[1]) : bisect.bisect_left(starts, x[2])]]

    links = [overlaps(a, b) for a, b in both]
    count = Counter(p for x in links for p in x)
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = Counter()
    for (d, _), (a, b), x in zip(rows, both, links):
        shared = sorted({e for _, _, e in a} & {e for _, _, e in b})
        own = [[[] for _ in shared] for _ in "ab"]
        for side, lists in zip((a, b), own):
            for i, _, f in side:
                lists[bisect.bisect_left(shared, f)].append(str(i))
        groups = ["|".join(map(",".join, x)) for x in zip(*own)]
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out[d, len(a), len(b), len(shared), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), sha] += 1
    return out


def table():
    r = random.Random(4)
    alphabet = " \n\t　'<|>a bE9é.,\x1cı̈▁日ß\r"
    odd = [(1000 + i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))) for i in range(300)]
    vocabulary = ["the", "theatre", "wording", "Über", "naïve", "don't", "x_y", "12,345", "日本語", "a.b", "it's"]
    prose = [(2000 + i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 5, 60])))) for i in range(80)]
    rows = [(1, None), (2, ""), (3, " "), (4, "  "), (5, "\n"), (6, "<|endoftext|> a"), (7, "</s> <s> <unk> <0x41>"), (8, "▁"), (9, "fine ▁ not"), (10, "a\x00b"), (11, "ends in space "), (12, "ends  \n "), (13, "日" * 50), (None, "no number"), (None, None)]
    return rows + odd + prose + [prose[3], prose[3], odd[5]]


def tuples(df):
    return Counter(tuple(x) for x in df.select(*[c.split()[0] for c in alignment.ALIGNED.split(", ")]).collect())


def test_align(spark, tokenizers):
    rows = table()
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, block int, part int, n_a int").repartition(4)
    assert tuples(alignment.align(df, A, B)) == brute(rows, tokenizers)


def test_levels(spark, tokenizers, monkeypatch):
    """More blocks than one task adds up: sums of sums, and scores in several parts of a stripe."""
    monkeypatch.setattr(alignment, "FAN", 3)
    rows = table()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    assert tuples(alignment.align(df, A, B)) == brute(rows, tokenizers)


def test_conftest_rows(docs, rows, no_docs, tokenizers):
    assert tuples(alignment.align(docs, A, B)) == brute([(x[0], x[1]) for x in rows], tokenizers)
    assert alignment.align(no_docs, A, B).count() == 0


@pytest.mark.parametrize("limit", [1, 20, 400])
def test_parts_are_cut_between_pieces(limit, tokenizers):
    texts = [t or "" for _, t in table()] + ["long text " * 30 + "x" * 90 + " end"]
    al = alignment.Aligner(A, B)
    data, off = vec.text_buffers(pa.array(texts))
    got = [[] for _ in texts]
    for i, part, at, _ in alignment.parts(data, off, limit):
        number, first = al(part, at)
        for d in range(len(at) - 1):
            got[i + d] += number[first[d] : first[d + 1]].tolist()
    for text, own in zip(texts, got):
        a, b = sides(text, tokenizers)
        if all(al.valid[own]):
            assert (int(al.na[own].sum()), int(al.nb[own].sum())) == (len(a), len(b)), text
        else:
            assert not a


def test_a_worker_forgets(spark, tokenizers):
    al = alignment.Aligner(A, B)
    data, off = alignment.spaced(*vec.text_buffers(pa.array(["one two three", "two three four"])))
    before = al(data, off)[0].tolist()
    al.reset()
    assert al(data, off)[0].tolist() == before and al.known == len(set(before))
