"""The stages on planted rows, each held against what it must keep and change."""

import re

import corpus_pipeline as cp
from tessella.llm import mixing


def test_stages(spark, tmp_path):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    item = benchmark.orderBy("item_id").first().text
    plain = documents.where("doc_id = 4").first().text
    words = [f"planted{i}" for i in range(60)]
    more = [(9001, " ".join(words)), (9002, " ".join([*words[:-1], "x"])), (9003, f"so {item} it"), (9004, "12345 !!"), (9005, None), (9006, "alpha beta password=Zx9Qw8Er7Ty6Ui5 gamma"), (9007, " ".join(words))]
    rows = spark.createDataFrame([(i, t, None, "planted", len(t or "")) for i, t in more], documents.schema)
    folder = str(tmp_path)
    documents.unionByName(rows).write.parquet(f"{folder}/documents.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, folder)
        if i < 4:
            assert out.columns == docs.columns and out.schema == docs.schema
        out.write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        kept.append({r.doc_id: r for r in docs.collect()})
    assert {9004, 9005} & kept[0].keys() == set() and len(kept[0]) == documents.count() + 5
    assert kept[1].keys() & {9001, 9002, 9007} == {9001}
    assert 9003 in kept[1] and 9003 not in kept[2] and 9006 in kept[2]
    assert kept[3].keys() == kept[2].keys() and kept[3][9006].text == "alpha beta [secret] gamma" and kept[3][9006].n_chars == 25
    assert kept[4].keys() == kept[3].keys() and all(r.taken <= 3 * r["size"] for r in kept[4].values())
    assert plain and sum(r["size"] for r in kept[4].values()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in kept[3].values())


def test_run_gives_the_last_stage(spark):
    rows = cp.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == mixing.mixed(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).columns and rows.count() > 50


def test_language_stage_without_labels(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "some clean text", None, "a", 15), (2, "12345 !!", None, "a", 8), (3, "ещё", None, "a", 3), (4, None, None, "a", 0), (None, "x", None, "a", 1)]
    got = cp.language_stage(spark, spark.createDataFrame(rows, schema), "")
    assert got.columns == [x.split()[0] for x in schema.split(", ")] and {r.doc_id for r in got.collect()} == {1, 3, None} and got.count() == 3
    one = spark.createDataFrame([(i, f"some clean text {i}", "en", "a", 17) for i in range(60)] + rows, schema)
    assert {r.doc_id for r in cp.language_stage(spark, one, "").where("doc_id IS NULL OR doc_id > 4 OR lang IS NULL").collect()} == {None, 1, 3, *range(5, 60)}


def test_language_stage_rejects_unlearned_languages(spark):
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IN ('de', 'en', 'fr')")
    rows = [(9001, "天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏" * 4), (9002, "Съешь же ещё этих мягких французских булок да выпей чаю " * 4)]
    rows += [(9003, "Call +1 (269) 555-3296 or 4524132264652876, write to nmftmlee.22@mail7.example.com"), (9004, "Съешь же ещё"), (9005, "4524132264652876 +1 (654) 555-4136")]
    long = {lang: [r.text for r in known.where(f"lang = '{lang}' AND length(text) BETWEEN 500 AND 1500").orderBy("doc_id").limit(30).collect()] for lang in ("en", "fr")}
    rows += [(9100 + i, f"{a} {b}") for i, (a, b) in enumerate(zip(*long.values(), strict=False))]  # halves of two languages
    docs = known.unionByName(spark.createDataFrame([(i, t, None, "a", len(t)) for i, t in rows], known.schema))
    kept = {r.doc_id for r in cp.language_stage(spark, docs, "").select("doc_id").collect()}
    lettered = {r.doc_id for r in known.where("text RLIKE '\\\\p{L}'").select("doc_id").collect()}
    assert kept & {9001, 9002, 9003, 9004, 9005} == {9003, 9004}  # texts shorter than a window stay if they have letters
    assert len(rows) > 20 and {i for i, _ in rows if i >= 9100} <= kept and lettered <= kept


def test_near_duplicate_stage_keeps_one_row_of_a_group(spark):
    words = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(f"o{i}" for i in range(20))
    rows = [(7, text), (7, text), (None, text), (None, text), (9, near), (None, other), (None, other), (7, "on its own here and now"), (3, None), (3, None), (None, None), (5, "lone text")]
    docs = spark.createDataFrame([(i, t, None, "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = cp.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    wanted = [(7, text), (None, other), (7, "on its own here and now"), (3, None), (3, None), (None, None), (5, "lone text")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(wanted, key=str)
