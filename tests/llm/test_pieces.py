from __future__ import annotations

import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gritstone.llm import pieces as P
from tests.llm.conftest import SCHEMA, row

V = P.load(P.MODEL)
SP = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
ALPHABET = "aeinrstl  \n.,-:012ABßéñ€漢😀▁\t"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=120))
def test_ids_are_the_library_s(text):
    ids = P.words_of(P.MODEL).encode(P.pa.array([text, text[:5]]))[0].tolist()
    assert ids == SP.encode(text) + SP.encode(text[:5])


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=300), st.integers(1, 80))
def test_chunks_change_nothing(text, size):
    assert P.encode_chunked(V, text, size) == SP.encode(text)


def test_transfer_products_are_associative():
    s = ("the quick antidisestablishmentarianism " * 30).replace(" ", P.BLANK)
    made = [P.Chunk(V, c, a, b, k == 0, False).transfer() for k, (c, a, b) in enumerate(P.chunks(V, s, 64))][:4]
    a, b, c, d = made
    assert ((a @ b) @ (c @ d)).entries == (a @ (b @ (c @ d))).entries == (((a @ b) @ c) @ d).entries


@pytest.mark.parametrize("blanks", [True, False])
def test_giants(spark, blanks):
    r = random.Random(5)
    text = "".join(r.choice("abcdefghijklmnop" + " " * 4 * blanks) for _ in range(9000))
    docs = spark.createDataFrame([row(1, text), row(1, text), row(2, text[:50]), row(None, text[1:])], SCHEMA)
    out = P.encode_texts(docs, giant=500, size=200, fan=3).collect()  # four levels of products
    assert len(out) == 4 and all(r.lossless for r in out)
    want = {1: SP.encode(text), 2: SP.encode(text[:50]), None: SP.encode(text[1:])}
    assert all(r.ids == want[r.doc_id] and r.n_tokens == len(r.ids) for r in out)


def test_odd_rows(odd, empty):
    out = P.encode_texts(odd, keep=("item", "key")).collect()
    texts = {(r.doc_id, r.text) for r in odd.collect()}
    assert len(out) == odd.count() and out[0].item == 7
    for i, t in texts:
        assert any(r.doc_id == i and r.ids == (SP.encode(t) if t else []) for r in out)
    assert [r.doc_id for r in out if not r.lossless] == [7]  # U+2581 itself decodes to a blank
    assert P.encode_texts(empty).count() == 0


def test_states_go_down_the_tree_as_by_a_scan():
    s = ("the quick antidisestablishmentarianism " * 60).replace(" ", P.BLANK)
    parts = P.chunks(V, s, 64)
    made = [P.Chunk(V, c, a, b, k == 0, k == len(parts) - 1).transfer() for k, (c, a, b) in enumerate(parts)]
    whole = P.boundary_states(made)
    runs = [made[i : i + 4] for i in range(0, len(made), 4)]
    ends = P.boundary_states([P.product(x) for x in runs])
    assert ends == whole[::4] + ([] if len(made) % 4 == 0 else [whole[-1]])
    assert [x for k, run in enumerate(runs) for x in P.boundary_states(run, ends[k], ends[k + 1])[:-1]] == whole[:-1]


def test_decode_takes_no_strange_ids(spark):
    df = spark.createDataFrame([(1, [5, None, 300]), (2, None), (3, []), (4, SP.encode("漢字 x")[:2])], "i int, ids array<int>")
    got = {r.i: r.t for r in df.select("i", P.decoded(df["ids"]).alias("t")).collect()}
    assert got[2] is None and got[3] == "" and got[1] == V.decode([5, 300]) and got[4] == V.decode(SP.encode("漢字 x")[:2])
    with pytest.raises(Exception, match="vocabulary lacks"):
        df.select(P.decoded(P.F.array(P.F.lit(10_000_000))).alias("t")).collect()


def test_decode(spark):
    texts = ["a b", "", "ß€😀", "  two  blanks ", "line\nbreak"]
    df = spark.createDataFrame([(i, SP.encode(t)) for i, t in enumerate(texts)], "i int, ids array<int>")
    got = df.select("i", P.decoded(df["ids"]).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == texts


def test_memory_beside_a_batch_does_not_follow_its_size():
    import tracemalloc

    import pyarrow as pa

    from gritstone.llm import pieces as P

    memory = P.words_of(P.MODEL)
    some = ["", None, "a ▁ b", "ü " * 400_000] + [f"line {k % 50} of many, again and again. " * 60 for k in range(4000)]
    arr = pa.array(some)
    parts = [len(x) for x in P._parts(arr, np.array([len((x or "").encode()) for x in some]))]
    assert sum(parts) == len(some) and len(parts) > 8
    tracemalloc.start()
    made = P._encoded(memory, arr)
    back = P._decoded(memory, made.field("ids"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert back.to_pylist() == [(x or "").replace("▁", " ") for x in some]
    assert made.field("lossless").to_pylist() == ["▁" not in (x or "") for x in some]
    # 9 MB of text: whole, it took more than 300 MB
    assert arr.nbytes > 9e6 and peak < 120e6, peak
    ids, edges, same = memory.encode(arr)
    assert made.equals(pa.StructArray.from_arrays([P._list(ids, edges), pa.array(same)], fields=list(P._TYPE)))
