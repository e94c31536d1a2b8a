import hashlib
import random

import duckdb
import pytest

from hemaspark.llm import substring


def brute(docs, window=20):
    first, rows = {}, []
    split = [(i, (t or "").encode().split()) for i, t in docs]
    key = lambda i: (i is not None, i or 0)
    for i, w in split:
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            first[k] = min(first.get(k, ((2,), 0)), (key(i), a))
    for i, w in split:
        gone = set()
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < (key(i), a):
                gone |= set(range(a, a + window))
        rows.append((repr(i), len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(rows)


def got(df):
    return sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def planted(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 40))
    passages = [[word() for _ in range(rng.randint(18, 60))] for _ in range(8)]
    docs = []
    for i in range(150):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 30))]
            if rng.random() < 0.1:
                w += ["x"] * rng.randint(1, 60)
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    shared = " ".join(f"s{i}" for i in range(30))
    docs += [(600, "p q r " + shared), (600, shared), (600, "p " + shared + " q"), (601, shared)]
    docs += [(7, docs[3][1]), (7, docs[7][1]), (None, docs[5][1]), (None, docs[6][1]), (500, docs[5][1]), (501, None), (502, ""), (-4, docs[9][1])]
    return docs


@pytest.mark.parametrize("chunk,group,entries", [(1 << 19, 1 << 20, 64), (300, 500, 1), (200, 500, 64)])
def test_equals_brute_force(spark, chunk, group, entries):
    docs = planted(chunk)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(substring.remove_repeats(df, chunk_words=chunk, group_words=group, row_entries=entries)) == brute(docs)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    rows = con.sql(substring.SQL).fetchall()
    assert got(substring.query(spark, sf)) == sorted((repr(i), n, r, h) for i, n, r, h in rows)


def test_odd_rows(odd_docs, empty_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    df = substring.remove_repeats(odd_docs, with_text=True)
    assert got(df) == brute(docs)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in df.collect())
    assert substring.remove_repeats(empty_docs).count() == 0


def test_packing_of_integers():
    import numpy as np

    a, b = np.array([0, 1, 2**63 + 5], np.uint64), np.array([3, 70000, 2**40], np.uint64)
    assert [x.tolist() for x in substring._columns(substring._planes(a, b), 3, 2)] == [a.tolist(), b.tolist()]
    assert substring._unpacked(substring._packed(b, 5), 5).tolist() == (b & np.uint64(2**40 - 1)).tolist()


def test_word_hashes_without_splitting():
    """Every text's words are counted as split() finds them; equal words share a hash and different ones don't, whatever their length."""
    draw = random.Random(1)
    parts = [b"a", b"b", b"\xc3\xa9", b"\x00", b"\x1c\xc2\x85", b" ", b"\t\n", b"\x0b\x0c\r", *(b"xyzw" * k for k in (1, 2, 3, 15, 16, 17, 400))]
    texts = [b"", b" \n", b"a", *(b"".join(draw.choices(parts, k=draw.randint(0, 60))) for _ in range(300))]
    hashes, counts = substring.word_hashes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    names: dict[bytes, int] = {}
    for word, h in zip((w for t in texts for w in t.split()), hashes.tolist(), strict=True):
        assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)
    assert [len(x) for x in substring.word_hashes([])] == [0, 0]
