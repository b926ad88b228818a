"""Each stage of the corpus pipeline on what the one before kept, against plain versions."""

from collections import Counter

import duckdb
import pandas as pd
from llm.conftest import clashing
from llm.test_joins import brute_cut, brute_kept
from llm.test_texts import check_packing

import corpus_pipeline
from arcweave.llm import toxicity
from arcweave.llm.decontamination import ORACLE
from arcweave.llm.frames import table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, SF)
        if name != "best_fit_packing":
            out = written(out)
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = out.collect()
        if name == "toxicity":
            scores = toxicity.score(docs, toxicity.train(docs, table(spark, SF, "labels"))).collect()
            assert {r.doc_id for r in got} == {r.doc_id for r in scores if r.score < 0.3} and len(got) < len(before)
        elif name == "ngram_jaccard_join":
            assert Counter((r.doc_id, r.text or "") for r in got) == Counter(brute_kept(before, 5, 80)) and len(got) < len(before)
        elif name == "substring_dedup":
            want = [(x[0], x[4]) for x in brute_cut(before, 50) if not x[1] or x[2] < x[1]]
            assert Counter((r.doc_id, r.text) for r in got) == Counter(want)
            assert all(r.n_chars == len(r.text or "") for r in got)
        elif name == "benchmark_decontamination":
            con = duckdb.connect()
            con.register("documents", pd.DataFrame(before, columns=docs.columns))
            con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
            bad = {r[0] for r in con.execute(ORACLE).fetchall()}
            assert {r.doc_id for r in got} == {r[0] for r in before} - bad and bad
        else:
            used, total = check_packing(got, docs.select("doc_id", "text").collect(), 1024)
            assert used <= -(-total // 1024) + 1
        docs = out


def test_stages_on_messy_rows(spark, messy, empty):
    """Nulls, empty and very long texts, repeated rows and columns with clashing names go through; so does an empty table."""
    docs = clashing(messy)
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF))
        if name != "best_fit_packing":
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
            assert set(out.columns) >= {"doc_id", "text", "__key", "n_words"} and out.filter("node <> 'x' or node is null").count() == 0
        else:
            check_packing(out.collect(), docs.select("doc_id", "text").collect(), 1024)
        docs = out
    docs = clashing(empty)
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF))
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == docs.columns)
        docs = out


def test_a_worker_gives_back_what_a_stage_has_freed():
    """Small blocks below one that is still held would stay with the worker while later stages run."""
    import os
    from pathlib import Path

    from arcweave.llm.frames import lean

    held = []

    def size():
        return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    def run(batches):
        for b in batches:
            own = [bytearray(2000) for _ in range(50_000)]
            held.append(bytearray(2000))
            yield len(own) + b

    began = size()
    assert list(lean(run)([1, 2])) == [50_001, 50_002] and len(held) == 2
    assert size() - began < 40e6
