import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hemaspark.llm import packing


def brute_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, docs, limit=1024):
    want = []
    for i, text in docs:
        ids = brute_ids(text)
        a, k = 0, 0
        while a < len(ids):
            b = a + ((len(ids) % limit or limit) if k == 0 else limit)
            want.append((repr(i), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
            a, k = b, k + 1
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(bins), sum(r.length for r in rows) / limit


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, bound = check(packing.query(spark, sf).collect(), docs)
    assert n <= 1.05 * bound + 2


def test_odd_rows(odd_docs, empty_docs):
    rows = packing.pack(packing.token_pieces(odd_docs)).collect()
    check(rows, [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert packing.pack(packing.token_pieces(empty_docs)).count() == 0


def test_both_encoders_agree():
    for text in ("plain words, 12 <|endoftext|> 3", "a b c\x1cd\x85e  f \n\n g", "汉字 ไทย 😀 ß", "x" * 5000, "l'été aujourd’hui's"):
        assert packing.encode(text).tolist() == brute_ids(text)[:-1]


def test_all_capacities_hold(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 400, 3000))]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    for rule in ("norm", "dot"):
        out = packing.pack(df, max_documents=4, max_attention=250_000, rule=rule, group=1000).toPandas()
        g = out.groupby("sequence_id")["length"]
        assert g.sum().max() <= 1024 and g.count().max() <= 4 and g.apply(lambda x: (x**2).sum()).max() <= 250_000 and len(out) == 3000
        assert g.ngroups <= 1.25 * max(out["length"].sum() / 1024, 3000 / 4, (out["length"] ** 2).sum() / 250_000)
    with pytest.raises(ValueError):
        packing.best_fit(np.array([[2000.0, 1, 1]]), np.array([1024.0, 4, 10]), np.ones(3))


def test_real_ids(spark, sf):
    r = packing.token_pieces(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id = 3"), with_ids=True).orderBy("piece").collect()
    text = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id = 3").first().text
    assert [x for p in r for x in p.ids] == brute_ids(text)


def test_special_strings_are_the_tokenizers_own():
    for text in ("hello <|endoftext|> there", "<|endoftext|>", "é<|endoftext|><|endof text|>", "a <|endoftext|>\n" * 50):
        assert [*packing.encode(text), 2] == brute_ids(text)


def test_rows_that_are_alike_share_out(spark):
    """Ten thousand equal rows go to many groups, and the files they come from don't matter."""
    docs = spark.range(10_000).selectExpr("cast(7 as long) as doc_id", "'some few words' as text").repartition(7)
    one = packing.pack(packing.token_pieces(docs), group=512).drop("doc_id").collect()
    two = packing.pack(packing.token_pieces(docs.coalesce(1)), group=512).drop("doc_id").collect()
    assert sorted(one) == sorted(two) and len(one) == 10_000
    sizes = {}
    for r in one:
        sizes[r.sequence_id >> 32] = sizes.get(r.sequence_id >> 32, 0) + 1
    assert max(sizes.values()) < 700
