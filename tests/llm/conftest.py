import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot int, rank long, shard string, length int, h long, n long, block string, id long"


def texts(seed: int = 5) -> list:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = [prose(70), prose(30), prose(13), prose(12)]
    out = [None, "", " ", "\n\t", "x", "x y", "日本 語", "<|endoftext|> a", "a " * 50, "no break  two\r\nlines\n", "1 2 3 ...", "#$% &&& ***"]
    for i in range(60):
        body = prose(r.choice([3, 10, 40, 120, 400]))
        if r.random() < 0.5:
            body = body + r.choice([" ", "\n", "  "]) + r.choice(shared) + " " + prose(r.choice([0, 5, 60]))
        out.append(body)
    out += out[14:20]  # repeated texts
    out += [t[:-3] for t in out[20:26] if t]
    long = prose(9000)
    out += [long, long + " tail", prose(3000) + " " + long[:6000]]
    return out


@pytest.fixture(scope="session")
def rows():
    t = texts()
    out = [(i * 3 + 1, x, ["en", "fr", None][i % 3], f"s{i % 4}", None, 7, 8, "z", 9, 1, 2, "b", 3) for i, x in enumerate(t)]
    out += [out[15], out[15], out[16]]  # repeated rows
    out += [(None, t[17], None, None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
