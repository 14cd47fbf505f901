"""Stages of the pipeline on rows whose doc_id is null or shared."""

import corpus_pipeline


def test_null_and_shared_ids(spark, tmp_path):
    leak = "which river runs through the old city of the northern kings and where does it end"
    plain = "twelve boats left harbour early while gulls circled above grey water looking for bread"
    other = "my neighbour grows tomatoes beans and onions behind a low wall built by her father"
    rows = [(None, leak), (None, plain), (None, plain), (7, leak), (7, other), (8, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([r for r in rows if r[1] != leak], key=str)
    texts = [r["text"] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()]
    assert sorted(t for t in texts if t) == sorted([leak, plain, other]) and texts.count(None) == 2


ODD_LEAK = "which river runs through the old city of the northern kings and where does it end"


def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and columns whose names the operators use."""
    long = " ".join(f"w{k}" for k in range(40_000))
    near = long.replace("w7 ", "q7 ").replace("w9000 ", "")
    boiler = "\n".join(["all rights are kept by this site", "{}"])
    rows = [(1, "s", long), (2, "s", near), (3, None, "short"), (4, None, "short"), (4, None, "short"), (None, "s", None), (5, "t", ""), (None, None, "a b c d e f g h"), (6, "é", ODD_LEAK + " and more words"), (None, "t", ODD_LEAK), (7, "t", "\n \n"), (8, "t", "idiot")]
    rows += [(100 + k, "site", boiler.format(f"page number {k} tells of boat {k} and gull {k} on day {k}")) for k in range(20)]
    return spark.createDataFrame([(i, t, s, len(t) if t is not None else None, "x", 5, 0.5, None) for i, s, t in rows], "doc_id long, text string, source string, n_chars long, lang string, size int, score double, kept boolean")


def tables(spark, folder):
    spark.createDataFrame([(1, ODD_LEAK), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(3, 1, 0), (None, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_on_odd_rows(spark, tmp_path):
    tables(spark, tmp_path)
    docs = odd_docs(spark)
    have = [tuple(r) for r in docs.collect()]
    out = {name: stage(spark, docs, str(tmp_path)) for name, stage in corpus_pipeline.STAGES}
    for name in ("toxicity", "line_dedup", "near_dedup", "decontamination"):
        assert out[name].columns == docs.columns
    text = lambda rows: sorted((str(r[0]), str(r[1])) for r in rows)
    # without labels of both classes the seed lexicon decides
    assert text(out["toxicity"].collect()) == text(r for r in have if r[1] != "idiot")
    lines = out["line_dedup"].collect()
    assert len(lines) == len(have) and sum("all rights" in (r["text"] or "") for r in lines) == 0
    assert text(r for r in lines if r["source"] != "site") == text(r for r in have if r[2] != "site")
    # of 1 and 2, of the equal rows of 3 and 4, and of the two with the item (12 of 15 shingles), one stays; null ids are documents of their own, as are texts without words
    near = out["near_dedup"].collect()
    assert len([r for r in near if r["doc_id"] in (1, 2)]) == 1 and len([r for r in near if r["text"] == "short"]) == 1
    assert len([r for r in near if not (r["text"] or "").strip()]) == 3 and len(near) == len(have) - 4
    assert text(out["decontamination"].collect()) == text(r for r in have if ODD_LEAK not in (r[1] or ""))
    mixed = out["mixing"].collect()
    words = sum(len((r[1] or "").split()) for r in have)
    assert abs(sum(r["n_words"] for r in mixed) - 1.5 * words) <= 4 and all(len(r["text"].split()) == r["n_words"] for r in mixed)
    assert len({(r["shard"], r["slot"], r["doc_id"], r["first_word"]) for r in mixed}) >= len(mixed) - 2


def test_empty_documents_and_run(spark, tmp_path):
    tables(spark, tmp_path)
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r["doc_id"] for r in mixed}
    assert 6 not in texts and 8 not in texts and len(texts & {1, 2}) == 1 and {100, 119} <= texts and not [r for r in mixed if "all rights" in r["text"]]
