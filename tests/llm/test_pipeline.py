import duckdb
import pytest
from check_oracle import TABLES, compare
from llm_support import docs, llm  # noqa: F401
from test_decontaminate import brute as brute_hits
from test_jaccard_join import brute as brute_components
from test_secret_scan import brute as brute_spans

import corpus_pipeline
from shoal.llm.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_brute_force(llm):
    table = llm.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in llm.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = [table]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stage(llm, kept[-1], SMALL).persist())
    start, good, single, clean, masked, last = map(rows, kept)
    assert all(k.columns == table.columns for k in kept[:-1])
    labels = {r.doc_id: r.quality for r in llm.read.parquet(f"{SMALL}/labels.parquet").collect()}
    lost = [k for k in start if k not in good]
    # About sixty labelled documents to learn from at this size.
    assert lost and sum(labels.get(k, 0) for k in lost) <= 0.05 * len(labels)
    ids = sorted(good)
    component = brute_components([good[k].text for k in ids], ids)
    assert set(single) == {k for k in ids if component[k][1] == k}
    assert set(clean) == {k for k in single if not brute_hits(single[k].text, items)[1]}
    assert set(masked) == set(clean) == set(last)
    for k, r in masked.items():
        assert (r.text == clean[k].text) == (brute_spans(clean[k].text) == "") and r.n_chars == len(r.text)
        assert brute_spans(r.text) == "" and last[k].decoded == r.text


def test_run_gives_the_last_stage(llm):
    out = corpus_pipeline.run(llm, SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids", "log_score", "decoded"] and out.count() > 100


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(llm, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert compare(llm, con, name, SMALL).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_give_a_row_each(llm, name):
    n = llm.read.parquet(f"{SMALL}/documents.parquet").count()
    out = QUERIES[name](llm, SMALL)
    if name == "op1_chat_formatting":
        n = llm.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id").distinct().count() + 1
    assert out.count() == n


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(llm, docs, empty):
    texts = [None, "", " \n", "same words here", "same words here", "long " * 20000, "token = abcdefgh12", "é\x00▁ x"]
    table = docs(texts, [0, 1, 2, 3, 3, 4, 5, None])
    table = table.limit(0) if empty else table
    for name, stage in corpus_pipeline.STAGES:
        out = stage(llm, table, SMALL)
        if name != "sentencepiece":
            assert out.columns == table.columns
        got = out.collect()
        assert not empty or got == []
        if name in ("secret_scan", "sentencepiece"):
            assert len(got) == table.count()
        if name == "decontamination":
            assert len(got) == table.count()
        if name == "sentencepiece" and not empty:
            # A whitespace marker in a text becomes a blank.
            assert sorted(r.decoded for r in got) == sorted((t or "").replace("▁", " ") for t in texts)
            assert all(r.n_tokens == len(r.ids) for r in got)
