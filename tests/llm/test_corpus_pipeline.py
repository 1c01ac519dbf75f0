"""The pipeline's stages by SQL and brute force, each on what its predecessor kept."""

import corpus_pipeline
import duckdb
import numpy as np
from pyspark.sql import functions as F

from tractloom.llm import secrets, simhash
from tractloom.llm.common import settle
from tractloom.llm.oracle import ORACLE_SQL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def sql(docs, benchmark, name):
    duck = duckdb.connect()
    duck.register("documents", docs)
    duck.register("benchmark", benchmark)
    return duck.execute(ORACLE_SQL[name]).df()


def smallest_of_each_group(docs):
    fps = np.array([simhash.fingerprint((t or "").encode()) for t in docs["text"]], np.uint64)
    ids = docs["doc_id"].to_numpy()
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4):
            a, b = sorted((find(i), find(i + 1 + int(j))))
            root[b] = a
    groups = {}
    for i in range(len(fps)):
        groups[find(i)] = min(groups.get(find(i), 1 << 60), ids[i])
    return set(groups.values())


def redacted(text):
    out, at = [], 0
    for kind, start, end in secrets.all_spans(text):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_stages_by_sql_and_brute_force(spark, folder):
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet").toPandas()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, folder), "test-stage")
        if name == "quality rules":
            judged = sql(plain, benchmark, "op10_quality_rules")
            plain = plain[plain["doc_id"].isin(judged[judged["kept"]]["doc_id"])]
        elif name == "SimHash near-dedup":
            plain = plain[plain["doc_id"].isin(smallest_of_each_group(plain))]
        elif name == "benchmark decontamination":
            judged = sql(plain, benchmark, "op9_decontamination")
            plain = plain[~plain["doc_id"].isin(judged[judged["contaminated"]]["doc_id"])]
        elif name == "secret scans":
            texts = [redacted(t) for t in plain["text"]]
            lengths = [len(t) if t != o else n for t, o, n in zip(texts, plain["text"], plain["n_chars"], strict=True)]
            plain = plain.assign(text=texts, n_chars=lengths)
        else:
            mix = sql(plain, benchmark, "op7_source_mixing")
            plain = plain.merge(mix[mix["taken"] > 0], on="doc_id")
            assert [r.finish for r in docs.select("finish").collect()] == sorted(
                r.finish for r in docs.select("finish").collect()
            )
            docs = docs.drop("finish")
        wanted = sorted(plain.itertuples(index=False, name=None), key=repr)
        assert sorted(map(tuple, docs.select(*plain.columns).collect()), key=repr) == wanted
        assert name == "source mixing" or docs.columns == COLUMNS


def test_run_is_the_stages_one_after_the_other(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == [*COLUMNS, "size", "source_size", "target", "taken", "finish"]
    assert rows.filter(F.col("taken") <= 0).count() == 0
    assert rows.count() > 0


def test_stages_on_no_documents_and_clashing_names(spark, folder):
    docs = spark.createDataFrame([(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(1) for c in ("d", "doc", "row", "kept", "size", "fp", "words", "items", "key")})
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs, folder).count() == 1
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs, folder).columns == docs.columns


def test_first_and_last_stage_on_nulls_ties_no_documents_and_clashing_names(spark, folder):
    text = "twelve different words that no rule could object to, as we hope"
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, text, "en", "a", 63), (2, text, "en", "a", 63)]
    rows += [(None, text, None, None, 63), (3, text + " x" * 20, "en", "b", 103)]
    docs = spark.createDataFrame(rows, kind).withColumns(
        {c: F.lit(1) for c in ("d", "kept", "n_words", "n", "key", "rank", "taken", "finish", "size", "range", "cum")}
    )
    quality, mixing = corpus_pipeline.STAGES[0][1], corpus_pipeline.STAGES[4][1]
    assert quality(spark, docs, folder).columns == docs.columns
    assert quality(spark, docs.limit(0), folder).count() == 0
    kept = sorted((r.doc_id or 0, r.text) for r in quality(spark, docs, folder).collect())
    assert kept == [(0, text), (2, text), (2, text)]  # too few words, and a word repeated twenty times, are rejected
    mix = mixing(spark, docs, folder)
    assert set(mix.columns) == {*docs.columns, "source_size", "target"} and len(set(mix.columns)) == len(mix.columns)
    assert mixing(spark, docs.limit(0), folder).count() == 0
    taken = mix.collect()
    assert all(0 < r.taken <= 2 * r.size and r.size == len(r.text.split()) for r in taken)
    total = sum(len((r[1] or "").split()) for r in rows)
    assert sum(r.taken for r in taken) == total * 3 // 2
    assert [r.finish for r in taken] == sorted(r.finish for r in taken)
