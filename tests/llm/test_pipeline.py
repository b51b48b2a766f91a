"""The pipeline's stages on the smallest tables: what each keeps, and that its columns stay."""

import re

import corpus_pipeline as c

from terragrid.llm.runtime import settle

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in c.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = settle(stage(spark, docs, D), "t")
        assert docs.columns == columns
        after = [r.doc_id for r in docs.collect()]
        assert set(after) <= set(before)
        if name != "mixing sources":
            assert len(after) == len(set(after))
        if name == "quality rules":
            assert all(len((before[i] or "").split()) >= 20 for i in after)
        if name == "benchmark decontamination":
            words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
            grams = lambda t: {tuple(w[j : j + 10]) for w in [words.findall(t.lower())] for j in range(len(w) - 9)}
            bench = set().union(*(grams(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()))
            assert {i for i, t in before.items() if not grams(t) & bench} == set(after)
        kept.append(len(after))
    out = c.STAGES[-1][1](spark, docs, D)
    assert out.count() == kept[-1]
    print(kept)


def odd(spark, path, rows):
    """Tables with nulls in every column, empty and long texts, repeated rows and columns named like the operators' own."""
    extra = "doc_id long, text string, lang string, source string, n_chars long, n int, t string, id int, key string, `row` string, tokens int"
    spark.createDataFrame([(*r, 1, "t", 2, "k", "r", 3) for r in rows], extra).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("a", "one two three four five six seven eight nine ten eleven"), (None, None), ("e", "")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_rows(spark, tmp_path):
    prose = lambda i, n: " ".join(f"This is sentence {j} of text {i} with w{i}x{j} in it." for j in range(n))
    rows = [(i, prose(i, 4 + i % 3), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(None, prose(77, 5), None, None, None), (40, None, "en", "s1", 0), (41, "", "en", "s1", 0), (42, " \n\t", None, "s1", 0), (43, prose(43, 3000), "en", "s2", 9), (44, prose(3, 4 + 3 % 3), "en", "s0", 1), (45, prose(3, 4 + 3 % 3), "en", "s0", 1), (46, prose(46, 4) + " One two, three four five six seven EIGHT nine ten.", "en", "s1", 1), (0, rows[0][1], "en", "s0", 1)]
    path = odd(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, ids = docs.columns, []
    for _, stage in c.STAGES[:-1]:
        docs = settle(stage(spark, docs, path), "t")
        assert docs.columns == columns
        ids.append(sorted((r.doc_id is not None, r.doc_id or 0) for r in docs.select("doc_id").collect()))
    assert {i for _, i in ids[0]} == {0, *range(30), 43, 44, 45, 46} and (False, 0) in ids[0] and len(ids[0]) == 36
    # of equal texts one stays
    assert {i for ok, i in ids[1] if ok} == {*range(30), 43, 46} and len(ids[1]) == 33
    assert {i for ok, i in ids[2] if ok} == {*range(30), 43} and (False, 0) in ids[2]
    assert set(ids[3]) <= set(ids[2])
    out = c.run(spark, path)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == len(ids[3])


def test_empty_table(spark, tmp_path):
    assert c.run(spark, odd(spark, tmp_path, [])).count() == 0
