import pytest

from tessella.plans import engine
from tessella.sources import generations

FILES = {
    "src/cli.py": "from src.money import rounded\n\n\ndef receipt(total):\n    return rounded(total) + ' paid beacon'\n\n\ndef main():\n    receipt(12)\n",
    "src/money.py": "def rounded(amount):\n    return f'{amount:.2f}'\n",
    "README.md": "# Till\nA till with a beacon.\n\nIt adds up.\nThen it prints.\n# Money\nCents are kept.\n",
    "data.txt": "\n".join(f"line {i}" for i in range(100)),
}


@pytest.fixture
def repository(tmp_path):
    for name, text in FILES.items():
        (tmp_path / "repo" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / name).write_text(text)
    return tmp_path


def test_build_search_pack_and_map(spark, repository):
    source, root = f"file://{repository}/repo", f"file://{repository}/index"
    first = engine.build(spark, source, root)
    assert (first["parsed"], first["reused"]) == (4, 0)
    assert engine.build(spark, source, root)["build"] == first["build"]
    (repository / "repo/src/money.py").write_text(FILES["src/money.py"] + "\n\ndef more():\n    return 1\n")
    with pytest.raises(generations.StaleIndexError):
        engine.opened(spark, root, source)
    again = engine.build(spark, source, root)
    assert (again["parsed"], again["reused"]) == (1, 3)
    index = engine.opened(spark, root, source)
    spans = {(r.path, r.start_line, r.end_line) for r in index.chunks.collect()}
    assert {("README.md", 1, 2), ("README.md", 4, 5), ("README.md", 6, 7), ("data.txt", 1, 80), ("data.txt", 71, 100), ("src/cli.py", 4, 5)} <= spans
    best = engine.search(index, "receipt", 5).first()
    assert (best.path, best.start_line, best.structural_rank) == ("src/cli.py", 4, 1)
    found = engine.search(index, "beacon", 5).collect()
    assert {r.path for r in found} == {"src/cli.py", "README.md"} and found[0].structural_rank is None
    packed = engine.context(index, "beacon", 200, 5).collect()
    assert {r.status for r in packed} == {"packed"} and sum(r.cost for r in packed) <= 200
    assert {r.status for r in engine.context(index, "beacon", 70, 5).collect()} == {"budget"}
    tables = engine.repository_map(index)
    assert {(r.source, r.target) for r in tables["rollup"].where("level = 'file'").collect()} == {("src/cli.py", "src/money.py")}
    assert tables["importance"].orderBy("rank").first().node in ("src/cli.py", "src/money.py") and tables["flows"].count() == 1
    with pytest.raises(ValueError, match="characters"):
        engine.search(index, "  ")
    vectors = index.chunks.selectExpr("chunk_id", "content_hash", "array(1.0F, 0.0F) AS embedding")
    assert engine.search(index, "beacon", 5, vectors, [1.0, 0.0]).where("vector_rank IS NOT NULL").count() == 5
    with pytest.raises(ValueError, match="dimensions"):
        engine.search(index, "beacon", 5, vectors, [1.0])
    assert engine.search(index, "beacon", 5, vectors, [1.0], strict=False).count() == 2
