import re
from collections import Counter

import corpus_pipeline
from strata.llm import quality, secrets, substring

from ..conftest import SF
from .test_dedup import line_rule, removals, resembling
from .test_tokens import ids_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_each_stage_works_on_all_that_is_left(spark, tmp_path):
    """The stages, each written and read again, against brute force on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert docs.columns == columns
            after = {r.doc_id: r for r in docs.collect()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        if name == "quality rules":
            removed = line_rule([(r.doc_id, r.text, r.source) for r in before.values()])
            stats = {r.doc_id: r for r in quality.verdicts(quality.statistics(spark.read.parquet(f"{SF}/documents.parquet"))).collect()}
            assert set(after) == {d for d, r in stats.items() if r.kept} and 0 < len(after) < len(before)
            for d, r in after.items():
                gone = removed(before[d].text, before[d].source)
                assert r.text == "\n".join(x for x in before[d].text.split("\n") if x not in gone)
        elif name == "near dedup":
            ids = sorted(before)
            root, _ = resembling([before[d].text for d in ids], 5)
            assert set(after) == {ids[k] for k in root} and all(after[d] == before[d] for d in after)
        elif name == "substring dedup":
            assert set(after) == set(before)
            ids = sorted(before)
            for d, (ws, gone) in zip(ids, removals([before[d].text for d in ids])):
                assert WORD.findall(after[d].text) == [w for i, w in enumerate(ws) if i not in gone]
                assert gone or after[d].text == before[d].text
        elif name == "secret scan":
            assert {d: r.text for d, r in after.items()} == {d: secrets.redacted(r.text) for d, r in before.items()}
        else:
            rows = docs.collect()
            assert Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == Counter((d, len(ids_of(r.text)) + 1) for d, r in before.items())
            assert sum(r.length for r in rows) == sum(len(ids_of(r.text)) + 1 for r in before.values())


def test_run_is_the_stages_in_turn(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "substring dedup", "secret scan", "packing"]
    assert substring.WINDOW == 35


def test_stages_take_odd_tables(spark, docs, empty):
    """Nulls in every column, repeated rows and ids, empty and long texts, clashing columns; and no rows at all."""
    for rows in (docs, empty):
        for name, stage in corpus_pipeline.STAGES:
            columns, n = rows.columns, rows.count()
            out = stage(spark, rows, "")
            if name == "packing":
                assert (out.count() > 0) == (n > 0)
                break
            assert out.columns == columns and (0 < out.count() <= n or not n)
            rows = out
