import tracemalloc

import pytest
import sentencepiece
from llm_support import PIECES, by_id, docs, llm  # noqa: F401

from shoal.llm.unigram import ENCODED_LIMIT, UnigramModel, _parts, encoded, encoding_digest

TEXTS = [None, "", " ", "  a  b ", "plain words here", "𝔘𝔫 ok\n\n x\t", "日本語 テキスト", "x" * 3000, "é" * 50, "%%% ***$$$ 12345", "a\x00b", "<s> </s> <0x41>"]


@pytest.fixture(scope="module")
def model():
    return UnigramModel(*_parts(PIECES))


@pytest.fixture(scope="module")
def library(model):
    """The library's own unigram search over the same pieces and scores."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    with open(PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p, s in zip(proto.pieces, model.table.scores):
        p.score = s
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_best_sequences_match_the_library(model, library):
    score = lambda ids: sum(model.table.scores[i] for i in ids if model.table.normal[i])
    texts = [t for t in TEXTS if t and "\x00" not in t]
    for t, want in zip(texts, library.encode(texts)):
        ids, _ = model.encode(t)
        assert score(ids) == pytest.approx(score(want)) and model.decode(ids) == library.decode(want)


def test_every_piece_is_in_the_trie(model):
    trie = model.trie
    for i, p in enumerate(model.table.pieces):
        if not model.table.normal[i]:
            continue
        state = 0
        for c in p:
            nxt = trie.base[state] + trie.code[c]
            assert trie.check[nxt] == state
            state = nxt
        assert trie.piece[state] == i


def test_round_trip_in_spark(docs):
    texts = [*TEXTS, TEXTS[4]]
    out = by_id(encoded(docs(texts), PIECES, ["doc_id"]), "ids", "decoded")
    assert {i: v[1] for i, v in out.items()} == {i: t or "" for i, t in enumerate(texts)}
    assert out[0][0] == [] and out[1][0] == []
    rows = encoding_digest(docs(texts), PIECES, ["doc_id"]).collect()
    assert all(r.restored for r in rows) and {r.doc_id: r.n_tokens for r in rows} == {i: len(v[0]) for i, v in out.items()}
    assert encoded(docs([]), PIECES, ["doc_id"]).collect() == []


def test_the_search_of_many_chunks_is_that_of_each(model):
    words = ["", "a", "the", "x1$$$", "éß日", "𝔘", "ing", "cion", "▁", "qqq"]
    for n in range(6):
        chunks = sorted({"▁" + (a + b + c)[:n].ljust(n, "z") for a in words for b in words for c in words})
        assert model.search(chunks) == [model.chunk(c) for c in chunks]


def test_chunks_that_are_met_take_little_memory():
    """Remembered chunks of a task that makes ids and texts: under 400 bytes each, in two generations of 100,000 at most."""
    table, trie = _parts(PIECES)
    texts = [" ".join(f"w{i * 50 + j:x}q" for j in range(50)) for i in range(100)]
    tracemalloc.start()
    model = UnigramModel(table, trie, limit=2_000)
    before = tracemalloc.get_traced_memory()[0]
    for _ in model.batch(texts):
        pass
    after = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    held = len(model.met) + len(model.older)
    assert 2_000 <= held <= 4_000 and (after - before) / held < 400
    assert ENCODED_LIMIT < UnigramModel.LIMIT
    plain, small = UnigramModel(table, trie), UnigramModel(table, trie, limit=2_000)
    assert [small.ids_of(f).tolist() for f in small.batch(texts)] == [plain.ids_of(f).tolist() for f in plain.batch(texts)]
