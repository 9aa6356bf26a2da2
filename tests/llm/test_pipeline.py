"""The pipeline's stages on small tables against what each must do, and its registration."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    common = "the of and to a in is that was for".split()
    return " ".join(str(rng.choice(common)) if rng.random() < 0.4 else "".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(n))


def table(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "\n".join(prose(rng, 15) for _ in range(6)), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100, rows[0][1], "en", "s0", 1), (101, rows[1][1].replace("the", "teh", 1), "en", "s0", 1)]
    rows += [(200, "x y", "en", "s0", 1), (201, None, "en", "s0", 1), (202, "##|| " * 80, "en", "s0", 1)]
    return spark.createDataFrame(rows, DDL)


def test_stages_in_order(spark, tmp_path):
    docs, seen = table(spark), []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, "unused")
        out.write.parquet(str(tmp_path / str(k)))
        nxt = spark.read.parquet(str(tmp_path / str(k)))
        if name != "sentencepiece":
            assert nxt.columns == docs.columns
        seen.append((name, {r[0]: r[1] for r in nxt.select("doc_id", "text").collect()}))
        docs = nxt
    by = dict(seen)
    assert not by["quality_rules"].keys() & {200, 201, 202} and set(range(40)) <= by["quality_rules"].keys()
    assert 100 not in by["line_dedup"] and set(range(40)) <= by["line_dedup"].keys()
    assert all(by["line_dedup"][i] == by["quality_rules"][i] for i in range(40))
    assert set(range(40)) <= by["minhash_near_dedup"].keys()
    assert by["mix_sources"].keys() == by["minhash_near_dedup"].keys()
    assert docs.where("not decoded_ok").count() == 0 and docs.where(F.size("token_ids") != F.col("n_tokens")).count() == 0


def test_pipeline_brute_force(spark, tmp_path):
    """All stages at once against plain loops (the quality verdicts against the SQL of operator 7)."""
    import duckdb
    import sentencepiece
    from test_operators import brute_components, runs_by_hand

    from quantloom.llm import queries

    rng = np.random.default_rng(17)
    base = table(spark).collect()
    passage = "\n".join(prose(rng, 9) for _ in range(7))
    rows = [tuple(r) for r in base]
    rows += [(300 + k, "\n".join([prose(rng, 14), prose(rng, 12), passage, prose(rng, 11), prose(rng, 13), prose(rng, 15), prose(rng, 16)]), "en", "s1", 1) for k in range(5)]
    long = prose(rng, 160).split()
    rows += [(400 + k, " ".join(long[:k] + ["other"] + long[k + 1 :]), "en", "s2", 1) for k in range(20, 26)]
    rows += [(500, "", "en", None, 1), (501, prose(rng, 90), None, None, None)]
    spark.createDataFrame(rows, DDL).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in P.run(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    kept = {r[0] for r in con.sql(f"select doc_id from ({queries.ORACLE['op7_quality_rules']}) where kept").fetchall()}
    texts = [(r[0], r[1]) for r in rows if r[0] in kept]
    gone, left = runs_by_hand(texts), []
    for i, t in texts:
        new = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        if not gone[i] or new.strip():
            left.append((i, new))
    assert any(gone[i] for i in range(301, 305))
    comp, _ = brute_components(left, 5)
    want = {i: t for i, t in left if comp[i] == i}
    assert len(left) > len(want) and {i: r["text"] for i, r in got.items()} == want
    truth = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL_PATH)
    assert all(r["token_ids"] == truth.encode(r["text"]) for r in got.values())


def test_near_copies_go(spark):
    rng = np.random.default_rng(6)
    words = prose(rng, 200).split()
    near = [" ".join([*words[:100], "changed", *words[101:]]), " ".join(words)]
    docs = spark.createDataFrame([(1, near[0], "en", "a", 1), (2, near[1], "en", "a", 1), (3, prose(rng, 200), "en", "a", 1)], DDL)
    assert sorted(r["doc_id"] for r in P.near_dedup_stage(spark, docs, "").collect()) == [1, 3]


def test_stages_on_an_empty_table(spark):
    docs = table(spark).limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "unused")
    assert docs.count() == 0


def test_registered():
    q, sql = entry.queries(), entry.oracle_sql()
    assert "pipeline" in q and all(any(n.startswith(f"op{k}_") for n in q) for k in range(1, 11))
    assert set(sql) <= set(q)
