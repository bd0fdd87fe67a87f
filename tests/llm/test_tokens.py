"""Token files and packing against the tokenizers library."""

import random
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import odd
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rigtable.llm import packing, tokenfile
from rigtable.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def test_files_hold_what_the_library_gives(spark, library):
    rows = odd.rows()
    want, start = Counter(), 0
    for r in in_order(rows):
        ids = ids_of(library, r[1])
        want[(r[0], len(ids), crc(ids))] += 1
        start += len(ids)
    got = tokenfile.op4(spark, odd.frame(spark), PATH).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ranges = sorted({(r.start, r.n_tokens) for r in got})
    assert ranges[0][0] == 0 and max(a + n for a, n in ranges) == start
    by_id = [(r.doc_id, r.start) for r in got if r.doc_id is not None]
    assert sorted(by_id) == sorted(by_id, key=lambda x: (x[1], x[0]))


def test_keyed_lookup(spark, library):
    docs = odd.frame(spark)
    manifest = tokenfile.write_tokens(docs, PATH, scratch_path(spark, "tokens"))
    keys = spark.createDataFrame([(k,) for k in (0, 12, 15, 30, 1, -5, 10**9, None)], "doc_id long")
    got = {r.key: r.ids for r in tokenfile.lookup(manifest, keys).collect()}
    text = {r[0]: r[1] for r in odd.rows()}
    assert got == {k: ids_of(library, text[k]) for k in (0, 12, 15, 30)}


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        index = tokenfile.PerfectHash.build(keys)
        assert sorted(index.slot(keys).tolist()) == list(range(len(keys)))
        assert len(index.words) * 64 <= 8 * max(n, 64)


def test_empty_tables(spark):
    assert tokenfile.op4(spark, odd.empty(spark), PATH).count() == 0
    assert packing.pack(odd.empty(spark), PATH).count() == 0


@pytest.mark.parametrize("size", [2048, 16])
def test_pieces_cover_every_id_once(spark, library, size):
    rows = odd.rows()
    got = packing.pack(odd.frame(spark), PATH, size).collect()
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(windows) == list(range(len(windows)))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    want, have = Counter(), Counter()
    for r in rows:
        ids = ids_of(library, r[1])
        want[r[0]] += len(ids)
    for r in got:
        have[r.doc_id] += r.length
    assert have == want
    ids = {r[0]: ids_of(library, r[1]) for r in rows}
    for r in got:
        if r.doc_id is not None and r.doc_id != 15:
            assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])


def test_cuts_are_the_cheapest():
    rng = random.Random(2)
    for _ in range(200):
        at = np.array(sorted({0, *rng.sample(range(1, 60), 20)}))
        size = max(int(np.diff(at).max()), rng.randint(8, 20))
        cost = np.array([0, *[rng.choice([0, 3, 9]) for _ in at[1:]]])
        best = {0: 0}
        for j in range(1, len(at)):
            best[j] = min(best[i] + size - (at[j] - at[i]) + cost[j] for i in range(j) if at[j] - at[i] <= size)
        chosen = packing.cuts(at, cost, size).tolist()
        spent = sum(size - (b - a) + cost[at.tolist().index(b)] for a, b in zip(chosen, chosen[1:], strict=False))
        assert spent == best[len(at) - 1] and max(np.diff(chosen)) <= size


def test_ids_that_do_not_fit_raise(tmp_path):
    made = lambda *ids: SimpleNamespace(ids=np.array(ids, np.int64), ends=np.array([len(ids)]))
    writer = tokenfile.ShardWriter(f"file://{tmp_path}", 0, 2)
    writer.add(np.array([1]), np.array([False]), made(5, 65_535))
    with pytest.raises(ValueError, match="does not fit"):
        writer.add(np.array([2]), np.array([False]), made(5, 65_536))
    tokenfile.ShardWriter(f"file://{tmp_path}", 1, 4).add(np.array([2]), np.array([False]), made(5, 65_536))


def test_packing_encodes_slices_of_a_batch():
    """Memory follows ``BYTES`` of text, not the batch."""
    texts = ["some plain words of a text that is long enough. " * 40] * 10_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(texts)], ["key", "text"])
    tracemalloc.start()
    lengths = sum(sum(out.column("length").to_pylist()) for out in packing.planned(iter([batch]), 0, PATH, 2048))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lengths == 10_000 * len(packing.Tokens(pa.array(texts[:1]), PATH).ids)
    assert peak < 170e6
