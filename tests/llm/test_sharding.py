import zlib

from llm_support import docs, llm  # noqa: F401

from shoal.llm.sharding import assign_shards

ODD = [None, "", "a", "é" * 40, "same", "same", "x" * 5000]


def test_shards_are_contiguous_balanced_and_gapless(docs):
    texts = ["w" * (i * 37 % 200) for i in range(300)]
    rows = sorted(assign_shards(docs(texts), 7).collect(), key=lambda r: r.doc_id)
    assert [r.size for r in rows] == [len(t) + 8 for t in texts]
    assert [r.text_crc32 for r in rows] == [zlib.crc32(t.encode()) for t in texts]
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    total = sum(r.size for r in rows)
    for s in range(7):
        own = [r for r in rows if r.shard == s]
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 7) <= max(r.size for r in rows)


def test_nulls_repeats_and_long_texts(docs):
    rows = assign_shards(docs(ODD, [5, None, 3, 3, 2, 2, None]), 3).collect()
    assert len(rows) == len(ODD)
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 8 for t in ODD)
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_repeated_rows_each_take_a_slot(docs):
    rows = assign_shards(docs(["same"] * 40, [1] * 40), 4).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(4) for k in range(10)]


def test_empty_table(docs):
    assert assign_shards(docs([]), 4).collect() == []
